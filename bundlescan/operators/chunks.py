"""Embedding data work: overlapping token chunks, mean pooling, text vectors.

* ``token_chunks``: window 254 (= model max 256 - 2), overlap min(64, 254 // 2) = 64,
  stride 190; starts 0, 190, 380, … < n; a text of at most 254 tokens is one chunk.
  Tokens are whitespace-separated words (the reference's model tokenizer is not part of
  this build; the window arithmetic is the same).
* ``mean_pool``: unweighted element-wise mean of vectors per group — ``posexplode`` and
  a ``groupBy(group, pos)`` average (partial aggregation; a hot group is combined per task),
  re-assembled into at most ``dim`` elements per group.
* ``embed_text``: the default encoder is native and deterministic — a hashed bag of
  words: token -> bucket (first 8 hex digits of MD5 as an integer, mod ``dim``), chunk
  vector = bucket counts / chunk length, text vector = mean of its chunk vectors. Blank
  or missing text gives no vector. ``encode_chunks`` plugs in any Python encoder as an
  iterator pandas UDF (loaded once per worker, Arrow batches).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules

# FIXED VALUES: chunk geometry
MODEL_MAX_TOKENS = 256
WINDOW = MODEL_MAX_TOKENS - 2
OVERLAP = min(64, WINDOW // 2)
STRIDE = WINDOW - OVERLAP
HASH_DIM = 64

_WS = r"[\t-\r\x1c-\x20\x85\p{Z}]+"


def tokens(text: Column) -> Column:
    """Whitespace tokens, as ``str.split()`` (no empty tokens)."""
    return F.filter(F.split(text, _WS, -1), lambda t: t != "")


def _ids(id_col: str | list[str]) -> list[str]:
    return [id_col] if isinstance(id_col, str) else list(id_col)


def token_chunks(df: DataFrame, id_col: str | list[str], text_col: str = "text") -> DataFrame:
    """-> id, chunk (0-based), start (token offset), n_tokens, chunk_text."""
    ids = _ids(id_col)
    t = df.select(*ids, tokens(F.col(text_col)).alias("_tok"))
    t = t.select(*ids, "_tok", F.size("_tok").alias("_n"))
    # no Filter on _n (it would be pushed down and re-tokenise): an empty text has no starts
    starts = (F.when(F.col("_n") == 0, F.lit(None))
              .when(F.col("_n") <= WINDOW, F.array(F.lit(0)))
              .otherwise(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(STRIDE))))
    c = t.select(*ids, "_tok", F.size(starts).alias("_k"), F.posexplode(starts).alias("chunk", "start"))
    piece = F.when(F.size("_tok") <= WINDOW, F.col("_tok")).otherwise(
        F.slice("_tok", F.col("start") + 1, WINDOW))
    return c.select(*ids, F.col("chunk").cast("long").alias("chunk"), F.col("start").cast("long").alias("start"),
                    F.size(piece).cast("long").alias("n_tokens"), F.array_join(piece, " ").alias("chunk_text"),
                    F.col("_k").cast("long").alias("_k"))


def mean_pool(df: DataFrame, group_cols: list[str], vec_col: str) -> DataFrame:
    """Element-wise mean per group -> group.., dim (0-based), value (double)."""
    e = df.select(*group_cols, F.posexplode(vec_col).alias("dim", "_v"))
    return e.groupBy(*group_cols, "dim").agg(F.avg(F.col("_v").cast("double")).alias("value"))


def as_vectors(long: DataFrame, group_cols: list[str], dim_col: str = "dim", value_col: str = "value") -> DataFrame:
    """Long (group.., dim, value) -> group.., vector ARRAY<DOUBLE> ordered by dim."""
    agg = long.groupBy(*group_cols).agg(F.sort_array(F.collect_list(F.struct(dim_col, value_col))).alias("_p"))
    return agg.select(*group_cols, F.transform("_p", lambda s: s[value_col]).alias("vector"))


def embed_text(df: DataFrame, id_col: str | list[str], text_col: str = "text", dim: int = HASH_DIM) -> DataFrame:
    """Long form (id, dim, value): mean over chunks of (bucket counts / chunk length).
    Each token occurrence in a chunk carries weight 1 / (chunk length x number of
    chunks), so a single ``groupBy(id, bucket).sum`` — combined map-side, at most ``dim``
    rows per text leave each task — gives the mean directly. Blank text gives nothing."""
    chunks = token_chunks(df, id_col, text_col)
    tok = chunks.select(*_ids(id_col), "n_tokens", "_k", F.explode(tokens(F.col("chunk_text"))).alias("_t"))
    bucket = (F.conv(F.substring(F.md5(F.col("_t")), 1, 8), 16, 10).cast("long") % dim).cast("long")
    w = F.lit(1.0) / (F.col("n_tokens") * F.col("_k"))
    return tok.groupBy(*_ids(id_col), bucket.alias("dim")).agg(F.sum(w).alias("value"))


def encode_chunks(chunks: DataFrame, encoder_factory: Callable[[], Callable[[list[str]], np.ndarray]],
                  text_col: str = "chunk_text") -> DataFrame:
    """Pluggable encoder: ``encoder_factory()`` runs once per Python worker and returns a
    function list[str] -> (n, d) array; chunks are sent in Arrow batches. A batch that fails is
    halved until the texts that make it fail stand alone: those have a null ``vector`` and their
    error in ``encode_error``, all others their vector."""

    @F.pandas_udf("struct<vector: array<float>, error: string>")
    def enc(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = encoder_factory()
        for s in batches:
            yield pd.DataFrame(encoded(model, s.tolist()), columns=["vector", "error"])

    held = chunks.withColumn("_encoded", enc(F.col(text_col)))
    return held.withColumn("vector", F.col("_encoded.vector")).withColumn("encode_error", F.col("_encoded.error")).drop("_encoded")


def encoded(model: Callable[[list[str]], np.ndarray], texts: list[str]) -> list[tuple[np.ndarray | None, str | None]]:
    """(vector, error) of each text."""
    try:
        out = np.asarray(model(texts), dtype=np.float32) if texts else []
        if len(out) != len(texts):
            raise ValueError(f"{len(out)} vectors for {len(texts)} texts")
        return [(row, None) for row in out]
    except Exception as e:  # noqa: BLE001 - one bad text never stops the rest
        if len(texts) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
        half = len(texts) // 2
        return encoded(model, texts[:half]) + encoded(model, texts[half:])


def embed_files(entries: DataFrame, dim: int = HASH_DIM) -> DataFrame:
    """(bundle_id, path, extracted_from, dim, value): the vector of each text file of a bundle that the
    listing of its folder takes (by suffix), in archives too."""
    named = entries.select("bundle_id", "path", "extracted_from", F.when(F.col("suffix").isin(*rules.EMBED_DIR_EXTENSIONS), F.col("text")).alias("text"))
    return embed_text(named, ["bundle_id", "path", "extracted_from"], dim=dim)
