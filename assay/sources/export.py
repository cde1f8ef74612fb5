"""Annotated export of a stored dataset in row order, without a sort over the rows.

A stored dataset holds row ids in runs: each split of its files has the ids from
one to another.  Every run becomes a folder of its own that is named by its
first id, so that the folders' order is the rows' order, and rows never move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.rules import resolve
from ..operators.search import ROW_ID, data_columns
from .scratch import scratch_path
from .tables import CSV_WRITE, PREFIX, export_frame

#: Annotations that are sent to every task; more of them are joined by shuffling, and then rows are sorted.
MOST_SENT = 1_000_000
#: No query can name this column, as scopes hold no spaces.
_RUN = "__rows from"
_PLACE = ["_metadata.file_path", "_metadata.file_block_start"]


def stored_runs(spark: SparkSession, dataset: str, row_id_col: str = ROW_ID) -> DataFrame | None:
    """file, start, first: the first row id of each split, as a stored table; None if the ids of splits overlap. Reads the ids only."""
    ids = spark.read.parquet(dataset).select(F.col(_PLACE[0]).alias("file"), F.col(_PLACE[1]).alias("start"), F.col(row_id_col).alias("id"))
    path = scratch_path(spark, "runs")
    ids.groupBy("file", "start").agg(F.min("id").alias("first"), F.max("id").alias("last")).write.parquet(path)
    runs = spark.read.parquet(path)
    # a row for each split
    overlap = runs.withColumn("next", F.lead("first").over(W.orderBy("first"))).filter(F.col("next") <= F.col("last"))
    return runs.select("file", "start", "first") if overlap.isEmpty() else None


def ordered_export(
    spark: SparkSession, dataset: str, annotations: DataFrame, rules: DataFrame | list[dict], prefix: str = PREFIX, row_id_col: str = ROW_ID, drop_reserved: bool = False
) -> DataFrame:
    """``export_frame`` of a stored dataset with a column that names the run of each row, rows in order inside each run.

    Where runs overlap, or annotations are too many to be sent to every task, all rows are one run and sorted."""
    runs = stored_runs(spark, dataset, row_id_col)
    sent = annotations.limit(MOST_SENT + 1).count() <= MOST_SENT
    data = spark.read.parquet(dataset)
    columns = data_columns(data, row_id_col)
    how = {"mode": "export", "columns": columns, "row_id_col": row_id_col, "flag_col": "__flag", "memo_col": "__memo"}
    if runs is None or not sent:
        resolved = resolve(data, annotations, rules, **how)
        return export_frame(resolved, prefix, row_id_col, "__flag", "__memo", drop_reserved).withColumn(_RUN, F.lit("0" * 19))
    placed = data.select("*", F.col(_PLACE[0]).alias("__file"), F.col(_PLACE[1]).alias("__start"))
    placed = placed.join(runs.withColumnsRenamed({"file": "__file", "start": "__start"}), ["__file", "__start"])
    placed = placed.select(*[F.col(f"`{c}`") for c in data.columns], F.lpad(F.col("first").cast("string"), 19, "0").alias(_RUN))
    resolved = resolve(placed, F.broadcast(annotations.select("row_id", "flag", "memo")), rules, **how)
    # what a task holds of a run is in order already, or nearly so
    return export_frame(resolved.sortWithinPartitions(_RUN, row_id_col), prefix, row_id_col, "__flag", "__memo", drop_reserved, ordered=True)


def write_export(spark: SparkSession, dataset: str, annotations: DataFrame, rules: DataFrame | list[dict], path: str, **how) -> None:
    """A folder for each run of rows, named by its first row id; ``read_csv`` of ``path + "/*"`` reads them back in order."""
    out = ordered_export(spark, dataset, annotations, rules, **how).withColumnRenamed(_RUN, "rows_from")
    out.write.mode("overwrite").partitionBy("rows_from").options(**CSV_WRITE).csv(path)
