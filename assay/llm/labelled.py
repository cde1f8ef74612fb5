"""Labelled samples of documents for the classifiers: bounded in rows, drawn by hash, stored once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize


def crc_mod(n: int):
    """crc32 of doc_id as text, modulo n (null doc_id: 0)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n, F.lit(0)).cast("int")


def drawn(of: list[str], limit: int, n: int, seed: int) -> Column:
    """Whether a row is drawn: about ``limit`` of ``n`` rows by a hash of some columns, the same ones in every run."""
    if n <= limit:
        return F.lit(True)
    return F.xxhash64(*[F.col(c) for c in of], F.lit(seed)) < int((2 * limit / n - 1) * (1 << 63))


def hash_sample(rows: DataFrame, limit: int) -> DataFrame:
    """About ``limit`` rows of (doc_id, ...), all if there are fewer; ``rows`` has each doc_id once."""
    return rows.filter(drawn(["doc_id"], limit, rows.count(), 17))


def stored_sample(rows: DataFrame, limit: int, name: str, text: str = "text") -> DataFrame:
    """About ``limit`` rows of (doc_id, a text, ...), all if there are fewer, as a stored table.

    Rows are drawn by doc_id and text and stand once in the sample, so neither a
    doc_id nor a text of very many rows makes it longer."""
    n = rows.select("doc_id").count()
    return materialize(rows.filter(drawn(["doc_id", text], limit, n, 18)).distinct(), name)


def training_rows(labels: DataFrame, label: str, modulus: int, held_out: int, limit: int) -> DataFrame:
    """(doc_id, y) of labelled rows that may be learned from, ``limit`` at most in expectation.

    A doc_id labelled twice takes its largest label; null labels are left out."""
    rows = labels.filter(F.col(label).isNotNull() & (crc_mod(modulus) != held_out))
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    return hash_sample(rows, limit)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, limit: int) -> DataFrame:
    """(doc_id, text, y) of a stored sample of the labelled rows, ``limit`` at most in expectation.

    The ids are drawn first, so they are broadcast; then rows are, as an id may have many."""
    ids = training_rows(labels, label, modulus, held_out, limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return stored_sample(rows, limit, f"sample-{label}")
