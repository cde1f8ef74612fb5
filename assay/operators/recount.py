"""Rule-applied counts that are kept up to date: edits and changed rules are matched again, nothing else.

A store keeps, for every rule by the text of its compiled query, the ids of the
rows that it finds, in ranges of ids.  Which rows count is then a matter of ids:
those that any present rule finds, without those that the user flagged.  New
rules are matched in one pass over the data; rules that only change their flag,
tag or place, and annotations, need no pass at all.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.flags import normalize_flag
from .annotations import last_edits
from .rules import compiled, rule_matches
from .search import ROW_ID

_HITS = "row_id long, rule_key string"
_KEYS = "rule_key string"
#: Edited ids that are looked up in the store by value, so that its files are skipped by their ranges.
LOOKED_UP = 1000


def rule_key(rule: dict) -> str:
    """What a rule finds depends on its compiled query alone."""
    return hashlib.sha256(str([[(x.column, x.term, x.negated) for x in c] for c in rule["query"].clauses]).encode()).hexdigest()


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def keep_hits(df: DataFrame, rules: DataFrame | list[dict], store: str, row_id_col: str = ROW_ID) -> list[str]:
    """Matches the rules whose hits are not in the store yet, in one pass, and returns their keys.

    The store belongs to one dataset as it is; another one needs another store."""
    spark = df.sparkSession
    present = {rule_key(r): r for r in compiled(rules) if not r["query"].blank}
    known = {r["rule_key"] for r in _stored(spark, f"{store}/keys", _KEYS).collect()}  # a row for each rule
    new = sorted(set(present) - known)
    if new:
        made = [present[k] | {"rule_no": i} for i, k in enumerate(new)]
        keys = F.array(*map(F.lit, new))
        hits = rule_matches(df, made, row_id_col=row_id_col).select(F.col(row_id_col).cast("long").alias("row_id"), F.get(keys, F.col("rule_no")).alias("rule_key"))
        hits.repartitionByRange("row_id").sortWithinPartitions("row_id").write.mode("append").parquet(f"{store}/hits")
        spark.createDataFrame([(k,) for k in new], _KEYS).coalesce(1).write.mode("append").parquet(f"{store}/keys")
    return new


def _found(spark: SparkSession, rules: DataFrame | list[dict], store: str) -> DataFrame:
    """Hits of the rules that there are now."""
    keys = spark.createDataFrame([(k,) for k in {rule_key(r) for r in compiled(rules)}], _KEYS)
    return _stored(spark, f"{store}/hits", _HITS).join(keys, "rule_key", "left_semi")


def kept_count(spark: SparkSession, rules: DataFrame | list[dict], annotations: DataFrame, store: str) -> DataFrame:
    """``rule_applied_records`` from stored hits; the data are not read."""
    flagged = annotations.filter(normalize_flag(F.col("flag")) != "").select("row_id")
    found = _found(spark, rules, store).select("row_id").distinct()
    return found.join(flagged, "row_id", "left_anti").agg(F.count("*").alias("ioc_applied_records"))


def count_change(spark: SparkSession, rules: DataFrame | list[dict], annotations: DataFrame, edits: DataFrame, store: str) -> DataFrame:
    """By how much edits (row_id, flag, memo, seq) of ``annotations`` change the count: only edited rows are looked at.

    Of the edited rows that a rule finds, those count that have no flag."""
    last = last_edits(edits).select("row_id", (normalize_flag(F.col("flag")) != "").alias("after"))
    ids = [r["row_id"] for r in last.select("row_id").limit(LOOKED_UP + 1).collect()]
    few = len(ids) <= LOOKED_UP
    hits, old = _found(spark, rules, store), annotations
    if few:
        hits, old = hits.filter(F.col("row_id").isin(ids)), old.filter(F.col("row_id").isin(ids))
    before = old.select("row_id", (normalize_flag(F.col("flag")) != "").alias("before"))
    found = hits.select("row_id").distinct().join(last, "row_id").join(before, "row_id", "left")
    change = F.coalesce("before", F.lit(False)).cast("long") - F.col("after").cast("long")
    return found.agg(F.coalesce(F.sum(change), F.lit(0)).alias("change"))
