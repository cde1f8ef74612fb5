"""Exact deduplication by content-defined chunk recipes.

A text is normalised (each run of bytes 9-13 and 32 becomes one space) and cut
where a gear hash of the last bytes says so, so that equal stretches of text cut
alike wherever they stand.  Chunks are deduplicated by their *bytes*: each
distinct chunk moves once through one shuffle and gets a verified identifier
(its 128-bit hash and a number that tells apart different bytes with one hash).
A text is then the ordered list of its chunk identifiers, and texts are equal
exactly when these recipes are; only recipes move from there on.

Defined results: null text counts as empty; all empty texts are one group;
repeated rows (one doc_id twice) are separate rows of a group, of which one is
kept; a null doc_id counts as smaller than any other; further columns may have
any names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, modest_batches, slices, unused

_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)
_WINDOW = 16


def normalise(text: bytes) -> bytes:
    """Each run of bytes 9-13 and 32 becomes one space."""
    if not text:
        return text
    body = b" ".join(text.split())
    if not body:
        return b" "
    white = b" \t\n\r\x0b\x0c"
    return (b" " if text[0] in white else b"") + body + (b" " if text[-1] in white else b"")


def cut_points(data: np.ndarray, least: int, mean: int, most: int) -> list[int]:
    """Ends of the chunks of one text; the last is the text's length."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    g = _GEAR[data]
    h = g.copy()
    for j in range(1, _WINDOW):
        h[j:] += g[:-j] << np.uint32(j)
    bits = np.uint32(32 - max(1, int(mean - least).bit_length() - 1))
    ends: list[int] = []
    last = 0
    for p in (np.flatnonzero((h >> bits) == 0) + 1).tolist():
        while p - last > most:
            last += most
            ends.append(last)
        if p - last >= least and p < n:
            ends.append(p)
            last = p
    while n - last > most:
        last += most
        ends.append(last)
    ends.append(n)
    return ends


def _chunks_of(text: bytes, least: int, mean: int, most: int):
    """(hash, bytes) of the chunks of a normalised text; an empty text is one empty chunk."""
    last = 0
    for end in cut_points(np.frombuffer(text, np.uint8), least, mean, most) or [0]:
        chunk = text[last:end]
        yield xxhash.xxh3_128_digest(chunk), chunk
        last = end


def _texts(batches):
    """(batch, first row, normalised texts) of slices of whole texts."""
    for batch in batches:
        for lo, hi, data, off in slices(batch):
            raw = data.tobytes()
            yield batch, lo, [normalise(raw[off[i] : off[i + 1]]) for i in range(hi - lo)]


def chunk_table(docs: DataFrame, least: int = 512, mean: int = 2048, most: int = 8192) -> DataFrame:
    """(h binary, chunk binary): the chunks of each whole text."""

    def run(batches):
        for _, _, texts in _texts(batches):
            out = [pair for t in texts for pair in _chunks_of(t, least, mean, most)]
            cols = list(zip(*out, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in cols], names=["h", "chunk"])

    return docs.select("text").mapInArrow(run, "h binary, chunk binary")


def clashing_hashes(chunks: DataFrame) -> DataFrame:
    """Chunk hashes that stand for more than one byte string.

    Grouping by hash *and bytes* compares the bytes themselves; with map-side
    combining each distinct chunk moves about once.  The result is empty unless
    different chunks collide in 128 bits, and then their identifiers are told
    apart by SHA-512."""
    distinct = chunks.groupBy("h", "chunk").agg(F.lit(1).alias("one"))
    return distinct.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")


def with_recipes(docs: DataFrame, recipe: str, sha: str, clash: frozenset[bytes], least: int, mean: int, most: int) -> DataFrame:
    """All columns of ``docs`` and two more: the chunk identifiers of each text, joined in order, and the SHA-256 of the normalised text.

    A chunk is identified by its hash, one whose hash is in ``clash`` by its hash and its SHA-512."""

    def run(batches):
        for batch, lo, texts in _texts(batches):
            got = []
            for t in texts:
                got.append(b"".join(h + hashlib.sha512(c).digest() if h in clash else h for h, c in _chunks_of(t, least, mean, most)))
            n = len(texts)
            columns = [batch.column(i).slice(lo, n) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(got, pa.binary()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())], names=[*batch.schema.names, recipe, sha]
            )

    schema = T.StructType([*docs.schema.fields, T.StructField(recipe, T.BinaryType()), T.StructField(sha, T.StringType())])
    return docs.mapInArrow(run, schema)


def _identified(docs: DataFrame, least: int = 512, mean: int = 2048, most: int = 8192) -> tuple[DataFrame, str, str]:
    """``docs`` with its recipes and digests, and the names of these two columns."""
    modest_batches(docs.sparkSession)
    recipe, sha = unused(docs, "recipe"), unused(docs, "sha")
    clash = frozenset(bytes(r["h"]) for r in clashing_hashes(chunk_table(docs, least, mean, most)).collect())  # none, or accidents of 128 bits
    return with_recipes(docs, recipe, sha, clash, least, mean, most), recipe, sha


def exact_groups(docs: DataFrame, **chunks: int) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs``; one row of a group is kept.

    Rows are stored with their recipes and a number once, and everything after
    that reads this table, so that numbers of different scans never meet.  Of a
    group the row with the smallest doc_id, then the smallest number, stays."""
    made, recipe, sha = _identified(docs.select("doc_id", "text"), **chunks)
    rows = materialize(made.drop("text").withColumn("row", F.monotonically_increasing_id()), "recipes")
    groups = rows.groupBy(recipe).agg(F.min(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size"))
    return rows.join(groups, recipe).select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), F.col(sha).alias("text_sha256"))


def without_copies(docs: DataFrame) -> DataFrame:
    """One row of each group, with all its columns: the one with the smallest doc_id, of several the smallest text as it is written.

    One aggregation: copies go in the task that reads them, before anything moves."""
    made, recipe, _ = _identified(docs)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = made.groupBy(recipe).agg(F.min_by(F.struct(*columns), F.struct("doc_id", "text")).alias("kept"))
    return kept.select("kept.*")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
