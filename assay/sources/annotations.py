"""Stored annotations: a JSON map, or versions of a Parquet table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.annotations import SCHEMA


def read_annotation_map(spark: SparkSession, path: str) -> DataFrame:
    """``{"<row>": {"flag": ..., "memo": ...}}`` → annotations."""
    whole = spark.read.text(path, wholetext=True)
    m = F.from_json("value", "map<string,struct<flag:string,memo:string>>")
    return whole.select(F.explode(m).alias("k", "v")).select(F.col("k").try_cast("long").alias("row_id"), "v.flag", "v.memo").filter("row_id is not null")


def annotation_map(annotations: DataFrame) -> DataFrame:
    """JSON text of the map form, one object a row (``write.text`` stores it)."""
    entry = F.struct("flag", "memo")
    return annotations.select(F.to_json(F.create_map(F.col("row_id").cast("string"), entry), {"ignoreNullFields": "false"}).alias("value"))


def replace_annotations(annotations: DataFrame, path: str) -> str:
    """Writes the whole set as a new version beside the others and returns it; readers of older versions are not disturbed."""
    version = f"{path}/version-{uuid.uuid4().hex}"
    annotations.select("row_id", "flag", "memo").write.parquet(version)
    return version


def read_annotations(spark: SparkSession, version: str | None) -> DataFrame:
    """A stored version; no version is no annotations."""
    return spark.read.schema(SCHEMA).parquet(version) if version else spark.createDataFrame([], SCHEMA)
