"""Annotations: a flag and a memo for some rows, as a table (row_id, flag, memo)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.flags import normalize_flag
from ..functions.text import trim_all

SCHEMA = "row_id long, flag string, memo string"


def blank(c: Column) -> Column:
    """Null, empty or white space."""
    return F.coalesce(trim_all(c), F.lit("")) == ""


def join_annotations(df: DataFrame, annotations: DataFrame, row_id_col: str) -> DataFrame:
    """Adds __triage_annotated, __triage_user_flag (normalised) and __triage_user_memo to every row; annotations of other rows are left out."""
    a = annotations.select(
        F.col("row_id").alias("__row_id"), F.lit(True).alias("__triage_annotated"), normalize_flag(F.col("flag")).alias("__triage_user_flag"), F.col("memo").alias("__triage_user_memo")
    )
    out = df.join(a, df[row_id_col] == F.col("__row_id"), "left").drop("__row_id")
    return out.withColumns({"__triage_annotated": F.coalesce("__triage_annotated", F.lit(False)), "__triage_user_flag": F.coalesce("__triage_user_flag", F.lit(""))})


def unflagged_rows(df: DataFrame, annotations: DataFrame, row_id_col: str) -> DataFrame:
    """Rows without a user flag (those with a memo only are among them)."""
    flagged = annotations.filter(normalize_flag(F.col("flag")) != "").select(F.col("row_id").alias(row_id_col))
    return df.join(flagged, row_id_col, "left_anti")


def last_edits(edits: DataFrame) -> DataFrame:
    """Of several edits (row_id, flag, memo, seq) of one row the last one."""
    return edits.groupBy("row_id").agg(F.max_by(F.struct("flag", "memo"), "seq").alias("e")).select("row_id", "e.flag", "e.memo")


def apply_edits(annotations: DataFrame, edits: DataFrame) -> DataFrame:
    """Upserts flags and memos as they are; an edit with blank flag and blank memo clears its row.

    Either side may be large: it is one anti-join and a union."""
    last = last_edits(edits)
    kept = annotations.join(last.select("row_id"), "row_id", "left_anti").select("row_id", "flag", "memo")
    return kept.unionByName(last.filter(~(blank(F.col("flag")) & blank(F.col("memo")))))


def toggle_flags(annotations: DataFrame, choices: DataFrame) -> DataFrame:
    """Edits for chosen flags (row_id, flag, seq): choosing the flag that a row has clears it."""
    cur = annotations.select("row_id", normalize_flag(F.col("flag")).alias("__cur"), "memo")
    last = choices.groupBy("row_id").agg(F.max_by("flag", "seq").alias("flag"), F.max("seq").alias("seq"))
    new = normalize_flag(F.col("flag"))
    flag = F.when(F.coalesce("__cur", F.lit("")) == new, "").otherwise(new).alias("flag")
    return last.join(cur, "row_id", "left").select("row_id", flag, "memo", "seq")


def flagged_records(annotations: DataFrame) -> DataFrame:
    """One row: annotations whose flag is not blank, known or not."""
    return annotations.agg(F.count_if(~blank(F.col("flag"))).alias("flagged_records"))
