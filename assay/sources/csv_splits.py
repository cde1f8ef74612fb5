"""CSV files whose quoted fields hold line breaks, read by many tasks.

A line break ends a record only where the number of quotes before it is even.
Every split of a file reports whether it holds an odd number of quotes; prefix
sums of these parities over the splits of a file tell each split whether it
starts inside a field.  Then each task puts its own lines together; what a split
holds of a record that began before it (its first lines) is stored and joined to
the record's head.  Lines never move: only parities and such tails do.

Quotes in fields that are not quoted have no meaning in such a file, and would
turn the parity: records that are not well formed are looked for before
(``well_formed``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import scratch_path

_SPLIT = ["file", "start"]
#: A record of fields without quotes, or quoted with inner quotes doubled.
_FIELD = r'(?:"(?:[^"]|"")*+"|[^",]*+)'
_WELL_FORMED = rf"^{_FIELD}(?:,{_FIELD})*+$"


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with their file, the start of their split and the number of quotes in them."""
    t = spark.read.option("lineSep", "\n").text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return t.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), quotes.alias("quotes"))


def split_parities(lines: DataFrame) -> DataFrame:
    """file, start, inside (whether the split starts inside a quoted field), as a stored table: a row for each split."""
    odd = lines.groupBy(*_SPLIT).agg((F.sum("quotes") % 2).alias("odd"))
    before = F.coalesce(F.sum("odd").over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    path = scratch_path(lines.sparkSession, "csv-parities")
    odd.select(*_SPLIT, (before % 2 == 1).alias("inside")).write.parquet(path)
    return lines.sparkSession.read.parquet(path)


def _pieces(batches: Iterator[pa.RecordBatch], heads: bool) -> Iterator[tuple[str, int, int, str, bool]]:
    """(file, start, number, text, open) of the records that start in each split, or of the tails that splits start with.

    Numbers count the records of a split; an open record goes on in the next
    split.  A tail is open if its split does not end it either."""
    at, held, number, tail, inside = None, [], 0, False, False
    for batch in batches:
        for value, file, start, quotes, starts_inside in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, start) != at:
                if held and tail != heads:
                    yield (*at, number, "\n".join(held), True)
                at, held, number, inside = (file, start), [], 0, starts_inside
                tail = inside
            if not heads and not tail:
                continue  # the tail of this split is through
            if not inside and not held and value in ("", "\r"):
                continue
            held.append(value)
            inside ^= bool(quotes % 2)
            if not inside:
                if tail != heads:
                    yield (*at, number, "\n".join(held).removesuffix("\r"), False)
                number += not tail
                held, tail = [], False
    if held and tail != heads:
        yield (*at, number, "\n".join(held), True)


def _made(lines: DataFrame, heads: bool) -> DataFrame:
    def run(batches):
        out: list[tuple] = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)], names=["file", "start", "number", "text", "open"])
        size = 0
        for piece in _pieces(batches, heads):
            out.append(piece)
            size += len(piece[3])
            if size > 4 << 20:
                yield pack()
                out, size = [], 0
        if out:
            yield pack()

    return lines.select("value", *_SPLIT, "quotes", "inside").mapInArrow(run, "file string, start long, number long, text string, open boolean")


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, start, number, text: the records of CSV files with the split that each starts in and its number there (from 0 on)."""
    lines = _lines(spark, path)
    parities = split_parities(lines)
    lines = lines.join(parities, _SPLIT)
    # a head is followed by the tails of the next splits, up to the first one that ends it
    tails = _made(lines, False)
    places = parities.join(tails, _SPLIT, "left")
    after = W.partitionBy("file").orderBy("start")
    ended = F.coalesce(F.sum(F.when(~F.coalesce("open", F.lit(True)) | ~F.col("inside"), 1).otherwise(0)).over(after.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # the head stands in the split before a run of tails
    runs = places.withColumn("run", ended).filter("inside").withColumn("first", F.min("start").over(W.partitionBy("file", "run")))
    before = parities.select("file", "start", F.lag("start").over(after).alias("head"))
    runs = runs.join(before.select("file", F.col("start").alias("first"), "head"), ["file", "first"])
    rest = runs.groupBy("file", F.col("head").alias("start")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "\n").alias("rest"))
    stored = scratch_path(spark, "csv-tails")
    rest.withColumn("open", F.lit(True)).write.parquet(stored)
    rest = spark.read.parquet(stored)
    made = _made(lines, True).join(rest, [*_SPLIT, "open"], "left")
    whole = F.when(F.col("rest").isNotNull(), F.concat("text", F.lit("\n"), "rest")).otherwise(F.col("text"))
    return made.select(*_SPLIT, "number", whole.alias("text"))


def well_formed(made: DataFrame) -> bool:
    """Whether quotes stand around whole fields only."""
    return made.filter(F.contains("text", F.lit('"')) & ~F.col("text").rlike(_WELL_FORMED)).isEmpty()


def numbered(made: DataFrame, row_id: str) -> DataFrame:
    """``records`` without headers, with a row id: files by path, records as they stand in them."""
    header = (F.col("start") == 0) & (F.col("number") == 0)
    body = made.filter(~header)
    sizes = made.groupBy(*_SPLIT).agg(F.count_if(~header).alias("n"))
    # a row for each split
    base = sizes.select(*_SPLIT, F.coalesce(F.sum("n").over(W.orderBy(*_SPLIT).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    path = scratch_path(made.sparkSession, "csv-sizes")
    base.write.parquet(path)
    out = body.join(made.sparkSession.read.parquet(path), _SPLIT)
    # the first split of a file starts with the header
    return out.withColumn(row_id, F.col("base") + F.col("number") - (F.col("start") == 0).cast("long"))
