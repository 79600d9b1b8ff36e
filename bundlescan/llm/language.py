"""Language identification with a blended-spectrum string kernel.

Two texts are compared by the set of character n-grams (n = 1 to 3, blended) that they share: the
presence kernel, normalised to 1 for a text with itself. N-grams are taken over letters, lower-cased,
with one separator for a run of anything else. All letters of the landmarks count, of whatever
script; a letter that no landmark has is in none of their n-grams.

Training: ``per_language`` texts of each language, those with the smallest hash of their id (the
documented bound of the sample), are collected; ``landmarks`` of them, dealt evenly over the
languages and PER_LANGUAGE of each at least, make the Nyström map K(x, L) K(L, L)^(-1/2), and ridge regression fits one linear machine
a language, one versus the rest. N-grams that no landmark has cannot contribute to K(x, L); they are
left out of the feature space.

Prediction: the n-grams of a batch of whole texts become a presence matrix; its product with that of
the landmarks is the kernel, and the kernel's product with the trained weights the scores. The score
is the softmax of the machines' outputs, sharpened by a fixed factor.

Defined results: ``und`` with score 0 for a null text, one without a letter, and where there was
nothing to learn from; a text of unknown letters alone gets the language with the largest constant;
ties go to the first language in order. Columns that clash with new names give way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bundlescan.llm.common import prepare, with_columns

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_SHARPNESS = 6.0
_ROWS = 128
_PIECE = 1 << 19
_TABLE = 1 << 24
#: Landmarks of each language, at least.
PER_LANGUAGE = 4


class Grams:
    """Numbers the n-grams of texts over the letters of some of them. Letters are 2 and up, 1 is any
    other letter, 0 the separator."""

    def __init__(self, texts: list[str]):
        known = sorted({c for t in texts for c in t.lower() if _LETTER.match(c)})
        self.base = len(known) + 2
        self.code = np.zeros(0x110000, np.uint32)
        for lo in range(0, 0x110000, 0x1000):
            block = [chr(i) for i in range(lo, lo + 0x1000) if not 0xD800 <= i < 0xE000]
            for c in block:
                if c.isalpha():
                    self.code[ord(c)] = 1
        for i, c in enumerate(known):
            self.code[ord(c)] = i + 2

    def numbers(self, text: str) -> Iterator[np.ndarray]:
        """The numbers of all n-grams, in no order, with repeats, of a piece of the text at a time."""
        raw = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        c = np.concatenate([[0], self.code[raw], [0]]).astype(np.uint32)
        c = c[np.append(True, (c[1:] != 0) | (c[:-1] != 0))]
        b = self.base
        for low in range(0, len(c), _PIECE):
            own = c[low:low + _PIECE + 2].astype(np.int64)  # the pieces share two places
            two = own[:-1] * b + own[1:]
            yield np.concatenate([own, b + two, b + b * b + two[:-1] * b + own[2:]])


class Columns:
    """The columns of the n-grams that landmarks have; all others have the last one."""

    def __init__(self, used: np.ndarray, space: int):
        self.used = used
        # a table where there is room for one, else a search
        self.table = np.full(space, len(used), np.int32) if space <= _TABLE else None
        if self.table is not None:
            self.table[used] = np.arange(len(used))

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[numbers]
        at = np.minimum(np.searchsorted(self.used, numbers), len(self.used) - 1)
        return np.where(self.used[at] == numbers, at, len(self.used))


class Model:
    """Landmarks and one ridge machine a language."""

    def __init__(self, texts: list[str], langs: list[str], landmarks: int, ridge: float):
        self.langs = sorted(set(langs))
        by_lang = {k: [i for i, lang in enumerate(langs) if lang == k] for k in self.langs}
        each = max(PER_LANGUAGE, landmarks // len(self.langs))
        marks = [i for k in self.langs for i in by_lang[k][:each]]
        self.grams = Grams([texts[i] for i in marks])
        sets = [np.unique(np.concatenate(list(self.grams.numbers(texts[i])))) for i in marks]
        used = np.unique(np.concatenate(sets))
        b = self.grams.base
        self.column = Columns(used, b + b ** 2 + b ** 3)
        self.marks = np.zeros((len(used), len(marks)), np.float32)
        for k, s in enumerate(sets):
            self.marks[self.column(s), k] = 1 / np.sqrt(len(s))
        between = self.marks.T.astype(np.float64) @ self.marks
        value, vector = np.linalg.eigh(between)
        good = value > 1e-6 * value.max()
        root = vector[:, good] / np.sqrt(value[good])  # the Nyström map of a kernel row
        x = np.concatenate([self.kernel(texts[i:i + _ROWS]) for i in range(0, len(texts), _ROWS)]) @ root
        y = np.where(np.array(langs)[:, None] == np.array(self.langs), 1.0, -1.0)
        share = np.array([1 / len(by_lang[k]) for k in langs])  # each language weighs the same
        share /= share.sum()
        mean_x, mean_y = share @ x, share @ y
        xc, yc = (x - mean_x) * np.sqrt(share)[:, None], (y - mean_y) * np.sqrt(share)[:, None]
        w = np.linalg.solve(xc.T @ xc + ridge * np.eye(x.shape[1]), xc.T @ yc)
        self.weights = root @ w
        self.constant = mean_y - mean_x @ w

    def kernel(self, texts: list[str]) -> np.ndarray:
        """K(x, L), one row a text."""
        present = np.zeros((len(texts), len(self.marks) + 1), np.float32)
        for k, t in enumerate(texts):
            for part in self.grams.numbers(t):
                present[k, self.column(part)] = 1
        present = present[:, :-1]
        size = np.sqrt(np.maximum(present.sum(1, dtype=np.float64), 1))
        return (present @ self.marks) / size[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        out_lang, out_score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        todo = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        for lo in range(0, len(todo), _ROWS):
            part = todo[lo:lo + _ROWS]
            f = self.kernel([texts[i] for i in part]) @ self.weights + self.constant
            e = np.exp(_SHARPNESS * (f - f.max(1, keepdims=True)))
            e /= e.sum(1, keepdims=True)
            for i, k, row in zip(part, f.argmax(1).tolist(), e):
                out_lang[i], out_score[i] = self.langs[k], float(row[k])
        return out_lang, out_score


def train(docs: DataFrame, learn_from: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          per_language: int = 200, landmarks: int = 96, ridge: float = 1e-4) -> Model | None:
    """A model from at most per_language texts of every language; None if there are none."""
    prepare(docs.sparkSession)
    own = (docs.filter(learn_from).select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"))
           .filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    order = F.xxhash64(F.col("id"), F.lit("sample"))
    counts = own.groupBy("lang").count().orderBy("lang").collect()  # a row a language
    # the ids' hashes are spread evenly: twice the bound's share of each language holds enough
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 2.0 * (per_language + 20) / r["count"])))]) if counts else None
    if share is None:
        return None
    near = own.filter((order / F.lit(float(2 ** 64)) + 0.5) < share[F.col("lang")])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(order, "id", "text"))
    rows = (near.withColumn("rank", rank).filter(F.col("rank") <= per_language)
            .select("lang", "rank", "text").collect())
    rows = sorted((r for r in rows if _LETTER.search(r["text"])), key=lambda r: (r["lang"], r["rank"]))
    if not rows:
        return None
    return Model([r["text"] for r in rows], [r["lang"] for r in rows], landmarks, ridge)


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) with lang_pred and score."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column(text).to_pylist()
        own = shared.value
        langs, scores = own.predict(texts) if own else ([UNKNOWN] * len(texts), [0.0] * len(texts))
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    return with_columns(docs, make, "lang_pred string, score double", keep)
