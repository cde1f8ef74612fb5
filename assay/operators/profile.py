"""Column profile: the longest display text of every column, its name included."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import display_length, field
from .search import ROW_ID, data_columns


def column_profile(df: DataFrame, row_id_col: str = ROW_ID) -> DataFrame:
    """(column, max_chars): one aggregation over all columns, then one row each."""
    names = data_columns(df, row_id_col)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, max_chars long")
    longest = [F.greatest(F.coalesce(F.max(display_length(field(c), df.schema[c].dataType)), F.lit(0)), F.lit(len(c))).cast("long").alias(str(i)) for i, c in enumerate(names)]
    wide = df.agg(*longest)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{i}`").alias("max_chars")) for i, c in enumerate(names)])
    return wide.select(F.explode(pairs).alias("p")).select("p.column", "p.max_chars")


_FILES = "file string, modified timestamp, column string, max_chars long"


def same_path(c: Column) -> Column:
    """Paths without the number of slashes after the scheme, which sources write differently."""
    return F.regexp_replace(c, "^([A-Za-z0-9]+):/+", "$1:/")


def dataset_files(spark: SparkSession, dataset: str) -> DataFrame:
    """file, path, modified: the files of a stored dataset; nothing in them is read."""
    listed = spark.read.format("binaryFile").options(pathGlobFilter="*.parquet", recursiveFileLookup="true").load(dataset)
    return listed.select(same_path(F.col("path")).alias("file"), "path", F.col("modificationTime").alias("modified"))


def file_profiles(spark: SparkSession, paths: list[str], row_id_col: str = ROW_ID) -> DataFrame:
    """file, modified, column, max_chars of some files: profiles that can be merged, a row for each file and column."""
    df = spark.read.parquet(*paths)
    names = data_columns(df, row_id_col)
    longest = [F.coalesce(F.max(display_length(field(c), df.schema[c].dataType)), F.lit(0)).cast("long").alias(str(i)) for i, c in enumerate(names)]
    by_file = df.groupBy(same_path(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_modification_time").alias("modified")).agg(*longest)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.greatest(F.col(f"`{i}`"), F.lit(len(c))).alias("max_chars")) for i, c in enumerate(names)])
    return by_file.select("file", "modified", F.explode(pairs).alias("p")).select("file", "modified", "p.column", "p.max_chars")


def kept_profile(spark: SparkSession, dataset: str, store: str, row_id_col: str = ROW_ID) -> tuple[DataFrame, list[str]]:
    """(the profile of a dataset, the files that were read for it).

    ``store`` keeps a profile of each file.  Files that are not in it, were
    written anew or lack a column there are read and added; profiles of files
    that are gone do not count any more.  A file without rows is read each time."""
    names = data_columns(spark.read.parquet(dataset), row_id_col)
    try:
        stored = spark.read.schema(_FILES).parquet(store)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], _FILES)
    files = dataset_files(spark, dataset)
    known = stored.filter(F.col("column").isin(names)).groupBy("file", "modified").agg(F.countDistinct("column").alias("n")).filter(F.col("n") == len(names))
    new = [r["path"] for r in files.join(known, ["file", "modified"], "left_anti").orderBy("path").collect()]  # names of files
    if new:
        file_profiles(spark, new, row_id_col).write.mode("append").parquet(store)
        stored = spark.read.schema(_FILES).parquet(store)
    present = stored.join(files.select("file", "modified"), ["file", "modified"], "left_semi")
    longest = present.groupBy("column").agg(F.max("max_chars").alias("max_chars"))
    every = spark.createDataFrame([(c, len(c)) for c in names], "column string, least long")
    return every.join(longest, "column", "left").select("column", F.greatest(F.coalesce("max_chars", F.lit(0)), "least").alias("max_chars")), new


def missing_columns(df: DataFrame, profile: DataFrame, row_id_col: str = ROW_ID) -> DataFrame:
    """Columns that a stored profile does not have."""
    names = df.sparkSession.createDataFrame([(c,) for c in data_columns(df, row_id_col)], "column string")
    return names.join(profile, "column", "left_anti")


def load_profile(df: DataFrame, stored: DataFrame | None, row_id_col: str = ROW_ID) -> DataFrame:
    """The stored profile, or a new one if there is none or it lacks a column."""
    if stored is None or not missing_columns(df, stored, row_id_col).isEmpty():
        return column_profile(df, row_id_col)
    return stored
