"""Token ids of documents in files of 64-bit words (Simple-8b), and back.

A word holds a selector in its top four bits and, below, as many ids of one width as fit into 60
bits: 60 ids of one bit, 30 of two, ... one of 60. Selector 1 stands for 120 zeros. Selector 0 is an
escape: its low 60 bits number an entry of the file's list of plain 64-bit ids, so any id can be
stored. A file's ids are cut into blocks of BLOCK ids, and no word goes across blocks; each block's
first word is listed, so any range of ids is decoded alone. Encoding takes the fullest selector that
fits, in step over all blocks at once; decoding unpacks all words of a selector at once.

File: header, document ids, which of them are null, documents' sizes, blocks' first words, words,
escapes; integers are little-endian. Files hold whole documents in order, FILE_IDS ids or one
document each at least, and are named by their place in the order; the manifest lists how many ids
stand before each file.

Defined results: ids ascend, null ids come first, rows of one id by their text's hash; a null or
empty text is one end id; an empty table has no files. Other columns are not stored. A task that
runs again writes the same files.
"""

from __future__ import annotations

import json
import math
import os
import re
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlescan.llm.common import prepare, release

BLOCK = 1024
FILE_IDS = 1 << 20
PART_BYTES = 64 << 20  # text of a writing task
CALL_BYTES = 16 << 20  # of a call of its encoder
PIECE_BYTES = 2 << 20  # that is split into words at once
MAGIC = b"IDS8B\x00\x01\x00"
_HEADER = struct.Struct("<8sQQQQQ")

#: Of each selector, how many ids a word holds and of how many bits.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_LOW = np.uint64((1 << 60) - 1)


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block, escapes) of unsigned 64-bit ids."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    n_blocks = -(-n // block)
    if not n:
        return np.empty(0, np.uint64), np.zeros(1, np.int64), np.empty(0, np.uint64)
    bits = np.zeros(n_blocks * block, np.uint8)
    bits[:n] = _bits(ids)
    bits = bits.reshape(n_blocks, block)
    # how many selectors fit at each place, past a block's end nothing has to: where one fits, so do all
    # that are less full
    fits = np.zeros((n_blocks, block), np.uint8)
    widest = {1: bits}  # of the next so many ids, the widest
    for reach in (1, 2, 4, 8, 16, 32):
        widest[2 * reach] = _ahead(widest[reach], widest[reach], reach)
    for s in range(1, len(COUNTS)):
        count = int(COUNTS[s])
        reach = 1 << count.bit_length() - 1
        wide = widest[reach] if count == reach else _ahead(widest[reach], widest[reach], count - reach)
        fits += (wide <= np.uint8(WIDTHS[s])).view(np.uint8)
    best = (len(COUNTS) - fits) % len(COUNTS)  # the fullest, or 0
    # all blocks walk from word to word together
    at, row, starts, rows = np.zeros(n_blocks, np.int64), np.arange(n_blocks), [], []
    end = np.full(n_blocks, block)
    end[-1] = n - (n_blocks - 1) * block
    flat = best.reshape(-1)
    while len(row):
        starts.append(at)
        rows.append(row)
        at = at + COUNTS[flat[row * block + at]]
        on = at < end[row]
        if not on.all():
            at, row = at[on], row[on]
    start, row = np.concatenate(starts), np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    start, row = start[order], row[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n_blocks))])
    stop = np.minimum((row + 1) * block, n)
    start = row * block + start
    chosen = flat[start]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in range(2, len(COUNTS)):
        own = np.flatnonzero(chosen == s)
        if len(own):
            count, width = int(COUNTS[s]), int(WIDTHS[s])
            full = start[own] + count <= stop[own]
            own, part = own[full], own[~full]
            word, i = words[own], start[own]
            for k in range(count):
                word |= ids[i + k] << np.uint64(width * k)
            words[own] = word
            for k in range(count if len(part) else 0):  # the last word of a block may be part empty
                part = part[start[part] + k < stop[part]]
                words[part] |= ids[start[part] + k] << np.uint64(width * k)
    escaped = np.flatnonzero(chosen == 0)
    words[escaped] = np.arange(len(escaped), dtype=np.uint64)
    return words, first, ids[start[escaped]]


def _ahead(a: np.ndarray, b: np.ndarray, by: int) -> np.ndarray:
    """The larger of a and of b as it is by places ahead."""
    out = a.copy()
    np.maximum(out[:, :-by], b[:, by:], out=out[:, :-by])
    return out


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs, or 61 to 64 for more than 60."""
    if int(ids.max()) < 1 << 24:  # the exponent of an exact float
        return ((ids.astype(np.float32).view(np.uint32) >> np.uint32(23)).astype(np.int16) - 126).clip(0).astype(np.uint8)
    if int(ids.max()) < 1 << 50:  # or double
        return ((ids.astype(np.float64).view(np.uint64) >> np.uint64(52)).astype(np.int64) - 1022).clip(0).astype(np.uint8)
    high = (ids >> np.uint64(50)) > 0
    return np.where(high, np.uint8(50) + _bits(ids >> np.uint64(50)), _bits(ids & np.uint64((1 << 50) - 1)))


def unpack(words: np.ndarray, first: np.ndarray, escapes: np.ndarray, n: int, block: int = BLOCK,
           low: int = 0, high: int | None = None) -> np.ndarray:
    """Ids low to high (all) of the n that were packed; only the blocks that hold them are read."""
    high = n if high is None else high
    if low >= high:
        return np.empty(0, np.uint64)
    b0, b1 = low // block, -(-high // block)
    own = words[first[b0]:first[b1]]
    chosen = (own >> np.uint64(60)).astype(np.int64)
    block_of = np.repeat(np.arange(b1 - b0), np.diff(first[b0:b1 + 1]))
    # each word's place in its block: ids of the block's words before it
    before = np.cumsum(COUNTS[chosen]) - COUNTS[chosen]
    place = block_of * block + before - before[first[b0:b1] - first[b0]][block_of]
    out = np.zeros((b1 - b0) * block + int(COUNTS.max()), np.uint64)
    stop = (block_of + 1) * block
    for s in range(2, len(COUNTS)):
        of = np.flatnonzero(chosen == s)
        if len(of):
            count, width = int(COUNTS[s]), int(WIDTHS[s])
            full = place[of] + count <= stop[of]
            of, part = of[full], of[~full]
            word, to = own[of], place[of]
            for k in range(count):
                out[to + k] = word >> np.uint64(width * k) & np.uint64((1 << width) - 1)
            for k in range(count if len(part) else 0):  # a block's last word may be part empty
                part = part[place[part] + k < stop[part]]
                out[place[part] + k] = own[part] >> np.uint64(width * k) & np.uint64((1 << width) - 1)
    of = np.flatnonzero(chosen == 0)
    out[place[of]] = escapes[(own[of] & _LOW).astype(np.int64)]
    return out[low - b0 * block:high - b0 * block]


def file_bytes(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    words, first, escapes = pack(ids)
    return b"".join([
        _HEADER.pack(MAGIC, len(doc_ids), len(ids), BLOCK, len(words), len(escapes)),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], "u1").tobytes(), np.array(sizes, "<u8").tobytes(),
        first.astype("<u8").tobytes(), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes()])


class File:
    """A file's tables, and its ids by range or by document."""

    def __init__(self, data: bytes):
        magic, docs, self.n, self.block, words, escapes = _HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        at = _HEADER.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        own, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else d for d, z in zip(own.tolist(), null.tolist())]
        self.starts = np.concatenate([[0], np.cumsum(take("<u8", docs).astype(np.int64))])
        self.first = take("<u8", -(-self.n // self.block) + 1).astype(np.int64)
        self.words, self.escapes = take("<u8", words), take("<u8", escapes)

    def ids(self, low: int = 0, high: int | None = None) -> np.ndarray:
        return unpack(self.words, self.first, self.escapes, self.n, self.block, low, high)


# ------------------------------------------------------------------ ids of texts

_CUT = re.compile(r" (?=\S)")
# all that some version of Unicode calls white space or a control or format character near it
_SPACES = r"[\x00-\x20\x7f-\xa0\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{2060}\x{3000}\x{feff}]"
# after these letters these marks begin a piece of their own
_LETTER, _MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]$", ".,;:!?)]}\"'"
_END_MARKS = "(?P<marks>[" + re.escape(_MARKS) + "]+)$"


class Encoder:
    """Ids of texts by a file of the tokenizers library, without special tokens; their names in a text
    are ordinary text. Where the file splits texts as byte-level BPE does, no piece goes across a
    space or a single line feed before a word, nor from a letter to a punctuation mark, so each
    distinct stretch between such places is encoded once and kept; once there are more than memo of
    them, those that no second call has used are forgotten. That changes no result. For other files
    texts are encoded whole."""

    def __init__(self, path: str, memo: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        split, names = rules.get("pre_tokenizer") or {}, [t["content"] for t in rules.get("added_tokens", []) if t.get("special")]
        self.parts = (split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
                      and not rules.get("normalizer") and len(names) == len(rules.get("added_tokens", [])) > 0)
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.plain.no_truncation()
        self.plain.no_padding()
        self.names, self.memo = names, memo
        if self.parts:
            # a special token ends a piece for certain: it divides the stretches of one call
            self.divided, self.mark = Tokenizer.from_file(path), names[0]
            self.divided.no_truncation()
            self.divided.no_padding()
            self.mark_id = self.divided.token_to_id(self.mark)
            # in the vocabulary's own spelling of bytes a space is this letter
            named = self.plain.get_vocab(with_added_tokens=True)
            self.spaced = np.zeros(max(named.values()) + 1, bool)
            self.spaced[[i for t, i in named.items() if t.startswith("\u0120")]] = True
        # a name that starts with a space stands for what follows it, any other for itself with a
        # space before it; used: how many calls had it since names were last forgotten
        self.words = pa.array([], pa.large_string())
        self.word_ids = np.empty(0, np.uint32), np.zeros(1, np.int64)
        self.used = np.empty(0, np.int32)

    def __call__(self, texts: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
        """Ids of each text."""
        pieces = list(_pieces(texts))
        if not self.parts or not pieces:
            return [np.array(self.plain.encode(t, add_special_tokens=False).ids, np.uint32) for p in pieces for t in p.to_pylist()]
        # stretches are numbered in each piece, and the distinct ones of the pieces together
        coded, firsts = [], []
        for piece in pieces:
            lists = pc.split_pattern(pc.replace_substring(piece, "\n", " \n"), " ")
            firsts.append(lists.offsets.to_numpy() - lists.offsets[0].as_py())
            coded.append(lists.flatten().dictionary_encode())
        names = pa.concat_arrays([c.dictionary for c in coded]).dictionary_encode()
        own_names = np.split(names.indices.to_numpy(), np.cumsum([len(c.dictionary) for c in coded])[:-1])
        places = [own[c.indices.to_numpy()] for own, c in zip(own_names, coded)]
        names = names.dictionary
        del coded, lists
        feed = pc.starts_with(names, "\n")  # no space stands before it
        body = pc.if_else(feed, pc.utf8_slice_codeunits(names, 1), names)
        # a stretch starts with what is no space: other texts are cut in a slower way
        loose = pc.or_(pc.equal(pc.binary_length(body), 0), pc.utf8_is_space(pc.utf8_slice_codeunits(body, 0, 1))).to_numpy(zero_copy_only=False)
        parts = {}  # by piece and text
        for k, (at, first) in enumerate(zip(places, firsts)):
            is_loose = loose[at]
            is_loose[first[:-1]] = False
            for i in np.flatnonzero(np.add.reduceat(is_loose, first[:-1], dtype=np.int64)).tolist():
                parts[k, i] = self._slow(pieces[k][i].as_py())
        # a stretch is up to three words: a line feed, what it says, and the marks at its end
        stem = pc.utf8_rtrim(body, characters=_MARKS)
        cut = pc.and_(pc.less(pc.binary_length(stem), pc.binary_length(body)), pc.match_substring_regex(stem, _LETTER))
        stem = pc.if_else(cut, stem, body)
        stem = pc.if_else(feed, _spaced(stem), stem)
        has_marks = np.flatnonzero(cut.to_numpy(zero_copy_only=False))
        marks = pc.struct_field(pc.extract_regex(body.take(pa.array(has_marks)), _END_MARKS), "marks")
        # what starts a text has no space before it, and nothing is cut off it
        heads = names.take(pa.array(np.concatenate([at[first[:-1]] for at, first in zip(places, firsts)])))
        kind = pa.large_string()
        number = self._numbers(pa.concat_arrays([
            stem, _spaced(marks), _spaced(heads), pa.array([" \n"], kind), pa.array([x for p in parts.values() for x in p], kind)]))
        stems, marked, own, line, rest = np.split(number, np.cumsum([len(names), len(has_marks), len(heads), 1]))
        three = np.full((len(names) + len(heads), 3), -1, np.int64)
        three[np.flatnonzero(feed.to_numpy(zero_copy_only=False)), 0] = line
        three[:, 1] = np.concatenate([stems, own])
        three[has_marks, 2] = marked
        # ids of the stretches, and of the texts
        used = three.reshape(-1)
        ids, size = _gather(*self.word_ids, used[used >= 0])
        per = np.zeros(len(used), np.int64)
        per[used >= 0] = size
        stretch_ids = ids, np.concatenate([[0], np.cumsum(per.reshape(-1, 3).sum(1))])
        bounds = np.cumsum([0, *map(len, parts.values())]).tolist()
        slow = {key: rest[a:z] for key, a, z in zip(parts, bounds, bounds[1:])}
        out = []
        for k, (at, first) in enumerate(zip(places, firsts)):
            at[first[:-1]] = np.arange(len(names) + len(out), len(names) + len(out) + len(first) - 1)
            out += [_gather(*self.word_ids, slow[k, i])[0] if (k, i) in slow else _gather(*stretch_ids, at[a:z])[0]
                    for i, (a, z) in enumerate(zip(first[:-1].tolist(), first[1:].tolist()))]
        self._trim()
        return out

    def _numbers(self, names: pa.Array) -> np.ndarray:
        """Numbers of the names; new ones are learned."""
        names = names.dictionary_encode()
        number = pc.index_in(names.dictionary, value_set=self.words)
        fresh = names.dictionary.filter(number.is_null())
        number = number.fill_null(-1).to_numpy().astype(np.int64)
        number[number < 0] = np.arange(len(self.words), len(self.words) + len(fresh))
        self._learn(fresh)
        self.used[number] += 1
        return number[names.indices.to_numpy()]

    def _trim(self) -> None:
        if len(self.words) > self.memo:
            need = 2
            while np.count_nonzero(self.used >= need) > self.memo // 2:
                need += 1
            kept = np.flatnonzero(self.used >= need)
            self.words = self.words.take(pa.array(kept))
            ids, sizes = _gather(*self.word_ids, kept)
            self.word_ids = ids, np.concatenate([[0], np.cumsum(sizes)])
            self.used = np.ones(len(kept), np.int32)

    def _slow(self, text: str) -> list[str]:
        """Names of the stretches of a text with white space beside white space."""
        head, *parts = _CUT.split(text)
        return [" " + head, *parts]

    def _learn(self, fresh: pa.Array) -> None:
        """Ids of names that are new."""
        if not len(fresh):
            return
        odd = pc.or_(pc.equal(pc.binary_length(fresh), 0), pc.match_substring_regex(fresh, _SPACES))
        plain, others = fresh.filter(pc.invert(odd)), fresh.filter(odd).to_pylist()
        ids, sizes = _in_parts(self._encode, [w[1:] if w[:1] == " " else " " + w for w in others])
        more, more_sizes = _in_parts(self._encode_plain, plain)
        # numbers follow the order in which the names came
        sizes = np.concatenate([more_sizes, sizes])
        back = np.empty(len(fresh), np.int64)
        back[np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(fresh))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        self.word_ids = _joined(self.word_ids, *_gather(np.concatenate([more, ids]), starts, back))
        self.words = pa.concat_arrays([self.words, fresh])
        self.used = np.concatenate([self.used, np.zeros(len(fresh), np.int32)])

    def _encode_plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without white space, each with a space before it, and how many each has: every
        space begins a word, and the id that holds it is the word's first."""
        text = " ".join(["", *words.to_pylist()])
        ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        return ids, np.diff(np.append(np.flatnonzero(self.spaced[ids]), len(ids)))

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, end to end, and how many each has."""
        odd = {i: self.plain.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts) if any(n in t for n in self.names)}
        joined = self.mark.join("" if i in odd else t for i, t in enumerate(texts))
        ids = np.array(self.divided.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(ids == self.mark_id)
        sizes = np.diff(np.concatenate([[-1], ends, [len(ids)]])) - 1
        ids = ids[ids != self.mark_id]
        if odd:
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for i, own in odd.items():
                parts[i], sizes[i] = np.array(own, np.uint32), len(own)
            ids = np.concatenate(parts)
        return ids, sizes


def _pieces(texts: pa.Array | pa.ChunkedArray) -> Iterator[pa.Array]:
    """Runs of texts of PIECE_BYTES or one text; a null text is empty."""
    for chunk in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        chunk = chunk.cast(pa.large_string()).fill_null("")
        ends = np.cumsum(pc.binary_length(chunk).to_numpy())
        low = 0
        while low < len(chunk):
            high = max(low + 1, int(np.searchsorted(ends, PIECE_BYTES + (ends[low - 1] if low else 0), "right")))
            yield chunk.slice(low, high - low)
            low = high


def _in_parts(encode: Callable, words: list[str] | pa.Array, size: int = 5_000) -> tuple[np.ndarray, np.ndarray]:
    """Ids and sizes of words, encoded some at a time: the library holds much about each id."""
    parts = [encode(words[k:k + size]) for k in range(0, len(words), size)]
    ids, sizes = zip(*parts) if parts else ((np.empty(0, np.uint32),), (np.empty(0, np.int64),))
    return np.concatenate(ids), np.concatenate(sizes)


def _spaced(texts: pa.Array) -> pa.Array:
    """Each with a space before it."""
    kind = pa.large_string()
    return pc.binary_join_element_wise(pa.scalar(" ", kind), texts.cast(kind), pa.scalar("", kind))


def _joined(held: tuple[np.ndarray, np.ndarray], ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([held[0], ids]), np.concatenate([held[1], held[1][-1] + np.cumsum(sizes)])


def _gather(ids: np.ndarray, starts: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the numbered lists, end to end, and how many each has."""
    first = starts[numbers]
    size = starts[numbers + 1] - first
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    return ids[np.arange(total) + np.repeat(first - stop + size, size)], size


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# ------------------------------------------------------------------ files

MANIFEST = "file string, docs bigint, ids bigint"


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of docs into files in folder, any place that pyarrow and Spark both reach. doc_id:
    a whole number. -> the manifest (file, docs, ids, before), kept in folder as well."""
    spark = docs.sparkSession
    prepare(spark)
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # rows of one id are many at times: their hash and place keep a range of them from being one task
    ranked = own.withColumn("_hash", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    keys = [F.col("doc_id").asc_nulls_first(), F.col("_hash"), F.col("_row")]
    dealt = ranked.repartitionByRange(max(1, math.ceil(size / PART_BYTES)), *keys).sortWithinPartitions(*keys)
    store, root = fs.FileSystem.from_uri(_uri(folder))
    store.create_dir(root, recursive=True)
    uri = _uri(folder)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        held: tuple[list, list, list] = ([], [], [])
        total = 0

        def close() -> pa.RecordBatch:
            name = f"part-{part:07d}-{number:05d}.ids8b"
            _put(uri, name, file_bytes(held[0], held[1], np.concatenate(held[2])))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held[0])], pa.int64()), pa.array([total], pa.int64())],
                                              ["file", "docs", "ids"])

        for doc_ids, texts in _grouped(batches):
            for d, own in zip(doc_ids, ids_of(texts)):
                ids = np.append(own, np.uint32(end_id))
                for x, y in zip(held, (d, len(ids), ids)):
                    x.append(y)
                total += len(ids)
                if total >= FILE_IDS:
                    yield close()
                    held, total, number = ([], [], []), 0, number + 1
            release()
        if held[0]:
            yield close()
        release()

    files = sorted(tuple(r) for r in dealt.select("doc_id", "text").mapInArrow(stage, MANIFEST).collect())  # a row a file
    before = np.concatenate([[0], np.cumsum([n for _, _, n in files])]).tolist()
    manifest = spark.createDataFrame([(*f, b) for f, b in zip(files, before)], MANIFEST + ", before bigint").coalesce(1)
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], pa.ChunkedArray]]:
    """Document ids and texts of some batches at a time: each call of the encoder looks through all it knows."""
    doc_ids, texts, size = [], [], 0
    for batch in batches:
        doc_ids += batch.column("doc_id").to_pylist()
        texts.append(batch.column("text"))
        size += batch.nbytes
        if size >= CALL_BYTES:
            yield doc_ids, pa.chunked_array(texts)
            doc_ids, texts, size = [], [], 0
    if texts:
        yield doc_ids, pa.chunked_array(texts)


def read(spark: SparkSession, folder: str, columns: tuple[str, ...] = ("token_ids",)) -> DataFrame:
    """(doc_id, start, n_tokens) of each document in folder, and token_ids, its ids as little-endian
    unsigned 32-bit integers, if it is in columns. start: how many ids stand before it in all files."""
    prepare(spark)
    ids = "token_ids" in columns
    schema = "file string, doc_id bigint, at bigint, n_tokens bigint" + (", token_ids binary" if ids else "")

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                f = File(content.as_buffer())
                n = len(f.doc_ids)
                cols = [pa.array([os.path.basename(path)] * n), pa.array(f.doc_ids, pa.int64()), pa.array(f.starts[:-1]), pa.array(np.diff(f.starts))]
                if ids:
                    cols.append(_slices(f.ids().astype("<u4"), f.starts))
                yield pa.RecordBatch.from_arrays(cols, ["file", "doc_id", "at", "n_tokens", "token_ids"][:len(cols)])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids8b").load(folder).select("path", "content")
    found = files.mapInArrow(stage, schema)
    before = spark.read.parquet(f"{folder}/manifest").select("file", "before")
    return found.join(before, "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", *(["token_ids"] if ids else []))


def _slices(ids: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The bytes of ids between each start and the next."""
    offsets = pa.py_buffer((starts * ids.itemsize).astype(np.int64))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, offsets, pa.py_buffer(ids)]).cast(pa.binary())


def _uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}"


def _put(uri: str, name: str, data: bytes) -> None:
    """Write under a name of this attempt's own, then rename."""
    store, root = fs.FileSystem.from_uri(uri)
    part = f"{root}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, f"{root}/{name}")
