"""Summaries of datasets: sizes, flag counts and hidden columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .annotations import flagged_records
from .rules import rule_applied_records
from .search import ROW_ID
from .view import one_row


@dataclass
class Dataset:
    id: str
    name: str
    data: DataFrame
    annotations: DataFrame
    rules: DataFrame | list[dict]
    created_at: datetime
    description: str | None = None
    hidden_columns: list[str] = field(default_factory=list)
    row_id_col: str = ROW_ID


def dataset_summary(d: Dataset) -> DataFrame:
    """One row of counts and metadata."""
    counts = d.data.agg(F.count("*").alias("total_records"))
    counts = one_row(counts, flagged_records(d.annotations), rule_applied_records(d.data, d.annotations, d.rules, d.row_id_col))
    hidden = F.array(*[F.lit(c) for c in d.hidden_columns]).cast("array<string>")
    return counts.select(
        F.lit(d.id).alias("id"), F.lit(d.name).alias("name"), F.lit(d.description).cast("string").alias("description"), F.lit(d.created_at).cast("timestamp").alias("created_at"),
        "total_records", "flagged_records", "ioc_applied_records", hidden.alias("hidden_columns"),
    )


def list_datasets(datasets: list[Dataset]) -> DataFrame:
    """All summaries, the newest first."""
    return reduce(DataFrame.unionByName, map(dataset_summary, datasets)).orderBy(F.desc("created_at"))
