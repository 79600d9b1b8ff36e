"""Substring dedup by hashing text units.

Units are lines, paragraphs (lines up to an empty one) and sentences, cut at line breaks and after
sentence ends. A unit is normalised (lower case, runs of white space become one space; signs and marks count)
and hashed to 128 bits; the mark that ends a sentence is left off. Digests are grouped over all documents; the occurrence with the smallest
(doc_id, hash of the text, start) is the earliest and is kept.

Every later occurrence of a line or paragraph of ``line_chars`` code points, normalised, is removed.
For passages inside other text, runs of successive later sentences that come to ``run_words`` words or
``run_chars`` code points go too; sentences of fewer than ``unit_words`` words and ``unit_chars`` code
points are not hashed and do not interrupt a run. Code points count where words are not set apart by
spaces. What is removed is merged to spans, with their offsets in the original text retained.

Defined results: a null or empty text has no units; rows with a null id keep their text and are not
compared; rows that repeat an id with the same text are one document, those with another text are
documents of their own; other columns stay, except removed_spans, which gives way.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bundlescan.llm.common import prepare, with_columns, written

_UNIT = re.compile(r"\S[^\n]*?(?:[.!?](?=\s)|[。！？｡]|(?=\n)|\Z)")
_LINE = re.compile(r"\S(?:[^\n]*\S)?")
_ENDING = ".!?。！？｡ "  # a passage may be a sentence here and a line there
_WORD = re.compile(r"[^\W_]+")
_PIECES = pa.list_(pa.struct([("place", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("word", pa.int32()), ("word_stop", pa.int32()),
                              ("words", pa.int32()), ("chars", pa.int32()), ("whole", pa.bool_()), ("digest", pa.binary())]))


def _unit(text: str, start: int, stop: int, ending: str = "") -> dict:
    plain = " ".join(text[start:stop].lower().split()).rstrip(ending or None)
    digest = xxhash.xxh3_128_digest(plain.encode("utf-8", "surrogatepass"))
    return {"start": start, "stop": stop, "words": len(_WORD.findall(plain)), "chars": len(plain), "digest": digest}


def units(text: str | None, unit_words: int, unit_chars: int = 20) -> list[dict]:
    """The hashed sentences of a text, numbered in order, with offsets in code points."""
    out = []
    for m in _UNIT.finditer(text or ""):
        u = _unit(text, *m.span(), ending=_ENDING)
        if u["words"] >= unit_words or u["chars"] >= unit_chars:
            out.append({"place": len(out), **u})
    return out


def _lines(text: str) -> list[tuple[int, int]]:
    """The lines that are not empty, and the paragraphs of several lines."""
    lines = [m.span() for m in _LINE.finditer(text)]
    first, out = 0, list(lines)
    for i in range(1, len(lines) + 1):
        if i == len(lines) or text.count("\n", lines[i - 1][1], lines[i][0]) > 1:
            if i - first > 1:
                out.append((lines[first][0], lines[i - 1][1]))
            first = i
    return out


def pieces(text: str | None, unit_words: int, unit_chars: int, line_chars: int) -> list[dict]:
    """The sentences (with a place), lines and paragraphs (whole) of a text, with the numbers of their
    words; a sentence that is a line is one piece."""
    out = [{**u, "whole": False} for u in units(text, unit_words, unit_chars)]
    there = {(u["start"], u["digest"]): u for u in out}
    for start, stop in _lines(text or ""):
        if stop - start >= line_chars and (u := _unit(text, start, stop))["chars"] >= line_chars:
            there.setdefault((start, u["digest"]), {"place": None, **u})["whole"] = True
    starts = [m.start() for m in _WORD.finditer(text or "")] if there else []
    return [{**u, "word": bisect_left(starts, u["start"]), "word_stop": bisect_left(starts, u["stop"])} for u in there.values()]


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit_words: int = 4,
            run_words: int = 20, unit_chars: int = 20, run_chars: int = 100, line_chars: int = 40) -> DataFrame:
    """(doc_id, start, stop, n_words, kept_in): the spans to remove, as code point offsets, the words in
    them, and the document that holds the earliest occurrence of the span's first unit."""
    return _spans(docs, doc_id, text, unit_words, run_words, unit_chars, run_chars, line_chars).drop("body")


def _spans(docs: DataFrame, doc_id: str, text: str, unit_words: int, run_words: int, unit_chars: int, run_chars: int, line_chars: int) -> DataFrame:
    """repeats() with body, the hash that tells apart the texts of one id."""
    prepare(docs.sparkSession)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([pieces(t, unit_words, unit_chars, line_chars) for t in batch.column("text").to_pylist()], _PIECES)]

    own = docs.filter(F.col(f"`{doc_id}`").isNotNull()).select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(f"`{text}`").alias("body"), F.col(f"`{text}`").alias("text"))
    every = written(
        with_columns(own, make, "units array<struct<place:int,start:int,stop:int,word:int,word_stop:int,words:int,chars:int,"
                                "whole:boolean,digest:binary>>", ["doc_id", "body"])
        .select("doc_id", "body", F.inline("units")), "units")
    at = F.struct("doc_id", "body", "start")
    first = (every.groupBy("digest").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n"))
             .filter(F.col("n") > 1).select("digest", "first"))
    later = written(every.join(first, "digest").filter(at > F.col("first"))
                    .select(*(c for c in every.columns if c != "digest"), F.col("first.doc_id").alias("kept_in")).distinct(), "later")
    run = F.col("place") - F.row_number().over(Window.partitionBy("doc_id", "body").orderBy("place"))
    runs = (later.filter(F.col("place").isNotNull()).withColumn("run", run).groupBy("doc_id", "body", "run")
            .agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("word").alias("word"), F.max("word_stop").alias("word_stop"),
                 F.min_by("kept_in", "place").alias("kept_in"), F.sum("words").alias("words"), F.sum("chars").alias("chars"))
            .filter((F.col("words") >= run_words) | (F.col("chars") >= run_chars)))
    cols = ["doc_id", "body", "start", "stop", "word", "word_stop", "kept_in"]
    both = later.filter("whole").select(*cols).unionByName(runs.select(*cols))
    order = Window.partitionBy("doc_id", "body").orderBy("start", F.desc("stop"), "kept_in")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return (both.withColumn("end", F.max("stop").over(before)).withColumn("word_end", F.max("word_stop").over(before))
            .withColumn("span", F.sum((F.col("end").isNull() | (F.col("start") > F.col("end"))).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("doc_id", "body", "span")
            .agg(F.min("start").cast("long").alias("start"), F.max("stop").cast("long").alias("stop"),
                 F.sum(F.greatest(F.lit(0), F.col("word_stop") - F.greatest("word", F.coalesce("word_end", F.lit(0))))).alias("n_words"),
                 F.min_by("kept_in", F.struct("start", -F.col("stop"), "kept_in")).alias("kept_in")).drop("span"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit_words: int = 4,
          run_words: int = 20, unit_chars: int = 20, run_chars: int = 100, line_chars: int = 40) -> DataFrame:
    """docs with the text that is left and removed_spans, the offsets in the original text."""
    mark = uuid.uuid4().hex  # of columns that no input has
    held, span_id, span_body = f"spans_{mark}", f"id_{mark}", f"body_{mark}"
    spans = (_spans(docs, doc_id, text, unit_words, run_words, unit_chars, run_chars, line_chars)
             .groupBy(F.col("doc_id").alias(span_id), F.col("body").alias(span_body))
             .agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias(held)))
    joined = docs.join(spans, (docs[f"`{doc_id}`"] == spans[span_id]) & (F.xxhash64(docs[f"`{text}`"]) == spans[span_body]), "left").drop(span_id, span_body)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        texts, removed = [], []
        for t, cut in zip(batch.column(text).to_pylist(), batch.column(held).to_pylist()):
            left, at = [], 0
            for s in cut or ():
                left.append(t[at:s["start"]])
                at = s["stop"]
            texts.append("".join([*left, t[at:]]) if cut else t)
            removed.append(cut or [])
        return [pa.array(texts, pa.string()),
                pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]

    kept = [c for c in docs.columns if c != "removed_spans"]
    return with_columns(joined, make, f"`{text}` string, removed_spans array<struct<start:bigint,stop:bigint>>",
                        [c for c in kept if c != text]).select(*(f"`{c}`" for c in kept), "removed_spans")
