"""Stored rules: JSON arrays, JSON lines and CSV."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.flags import normalize_flag
from ..functions.text import trim_all
from ..operators.rules import SCHEMA
from .tables import CSV_WRITE

_RULE = "struct<flag:string,tag:string,query:string>"


def _clean(df: DataFrame) -> DataFrame:
    text = lambda c: trim_all(F.coalesce(c, F.lit(""))).alias(c)
    return df.select("rule_no", normalize_flag(F.col("flag")).alias("flag"), text("tag"), text("query"))


def read_rules_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of {flag, tag, query} in its order; a missing file is no rules; empty queries stay."""
    try:
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], SCHEMA)
        raise
    r = whole.select(F.posexplode(F.from_json("value", f"array<{_RULE}>")).alias("i", "r"))
    return _clean(r.select((F.col("i") + 1).cast("int").alias("rule_no"), "r.flag", "r.tag", "r.query"))


def write_rules_json(rules: DataFrame, path: str) -> None:
    """JSON lines with rule_no."""
    rules.select("rule_no", "flag", "tag", "query").write.mode("overwrite").json(path)


def read_rules_lines(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_rules_json`` wrote."""
    return _clean(spark.read.schema(SCHEMA).json(path))


def read_rules_csv(spark: SparkSession, path: str) -> DataFrame:
    """Columns by place (flag, tag, query), whatever the header says; rows without a query are dropped."""
    raw = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    first = raw.select(*[F.col(f"`{c}`") for c in raw.columns[:3]]).toDF("flag", "tag", "query").withColumn("m", F.monotonically_increasing_id())
    r = first.filter(trim_all(F.coalesce("query", F.lit(""))) != "")
    # a rule file is small: its order is numbered in one task
    return _clean(r.withColumn("rule_no", F.row_number().over(W.orderBy("m")).cast("int")))


def write_rules_csv(rules: DataFrame, path: str) -> None:
    """Header flag,tag,query in stored order, one file."""
    rules.orderBy("rule_no").select("flag", "tag", "query").coalesce(1).write.mode("overwrite").options(**CSV_WRITE).csv(path)


def replace_rules(rules: DataFrame, path: str) -> str:
    """Stores the full set anew (see ``replace_annotations``); counts are then taken by ``rule_applied_records``."""
    version = f"{path}/version-{uuid.uuid4().hex}"
    rules.write.parquet(version)
    return version
