"""Views of a table: visible columns, flag filter, mixed sort, pages and totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.flags import normalize_flag
from ..functions.text import field, sort_key
from ..sources.scratch import scratch_path
from .rules import resolve
from .search import ROW_ID, data_columns, search_filter

PAGE = 250


def visible_columns(df: DataFrame, hidden: list[str], row_id_col: str = ROW_ID) -> DataFrame:
    """The row id and the data columns that are not hidden, in order."""
    return df.select(*[field(c) for c in df.columns if c == row_id_col or c not in set(hidden)])


def toggle_column(hidden: Column, name: Column) -> Column:
    """The hidden set with a column added, or taken out if it was there."""
    return F.when(F.array_contains(hidden, name), F.array_remove(hidden, name)).otherwise(F.array_append(hidden, name))


def records(df: DataFrame, row_id_col: str = ROW_ID, flag_col: str = "flag", memo_col: str = "memo") -> DataFrame:
    """Row records: (row_index, data, flag, memo) of a resolved table."""
    data = [c for c in data_columns(df, row_id_col) if c not in (flag_col, memo_col)]
    return df.select(field(row_id_col).alias("row_index"), F.struct(*[field(c) for c in data]).alias("data"), normalize_flag(field(flag_col)).alias("flag"), field(memo_col).alias("memo"))


def lookup(df: DataFrame, wanted: DataFrame, row_id_col: str = ROW_ID) -> DataFrame:
    """Rows at the ids of ``wanted`` (pos, id), with ``pos``; Spark broadcasts the smaller side by its size."""
    return wanted.select(F.col("pos"), F.col("id").alias(row_id_col)).join(df, row_id_col)


def row_at(df: DataFrame, row_id: int, row_id_col: str = ROW_ID) -> DataFrame:
    """One row by its id."""
    return df.filter(F.col(row_id_col) == row_id)


def flag_filter(df: DataFrame, choice: str | None, flag_col: str = "flag") -> DataFrame:
    """all, none (no flag), priority (suspicious or critical), or one flag; anything else keeps all rows."""
    c = F.col(flag_col)
    if choice == "none":
        return df.filter(c == "")
    if choice == "priority":
        return df.filter(c.isin("suspicious", "critical"))
    return df.filter(c == choice) if choice in ("safe", "suspicious", "critical") else df


_SORT = "__triage_sort"


def _keyed(df: DataFrame, key: str | None) -> DataFrame:
    """Adds the sort key of a column, worked out once a row; an unknown key is none."""
    known = key is not None and key in df.columns
    return df.withColumn(_SORT, sort_key(field(key), df.schema[key].dataType) if known else F.lit(0))


def _order(descending: bool, row_id_col: str) -> list[Column]:
    """Ties go by row id, always upward."""
    return [F.col(_SORT).desc() if descending else F.col(_SORT).asc(), F.col(row_id_col).asc()]


def page(df: DataFrame, key: str | None = None, descending: bool = False, offset: int = 0, limit: int = PAGE, row_id_col: str = ROW_ID) -> DataFrame:
    """One page of the sorted table with ``pos`` (from 1 on): a top-k, not a full sort.

    Without a known key the rows keep the order of their ids.  Far pages keep
    offset + limit rows; ``page_at`` and ``page_after`` do not."""
    order = _order(descending and key in df.columns, row_id_col)
    rows = _keyed(df, key).orderBy(*order).offset(offset).limit(max(1, limit))
    return rows.withColumn("pos", F.row_number().over(W.orderBy(*order)) + offset).drop(_SORT)


def page_at(df: DataFrame, key: str | None = None, descending: bool = False, offset: int = 0, limit: int = PAGE, row_id_col: str = ROW_ID, ranges: int | None = None) -> DataFrame:
    """``page`` for far offsets, by order statistics: no task keeps the rows before the page.

    Sort keys and row ids alone are dealt into ranges of the order, as a stored
    table; the counts of the ranges tell which of them the page lies in; only
    these are sorted, and only the page's rows are fetched from ``df``.  Row ids
    are distinct."""
    spark = df.sparkSession
    order = _order(descending and key in df.columns, row_id_col)
    slim = _keyed(df, key).select(_SORT, field(row_id_col))
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "order")
    slim.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    before, some, at = 0, [], None
    for r in dealt.groupBy("__range").count().orderBy("__range").collect():  # a row for each range
        if before < offset + max(1, limit) and before + r["count"] > offset:
            some.append(r["__range"])
            at = before if at is None else at
        before += r["count"]
    rows = dealt.filter(F.col("__range").isin(some)).orderBy(*order).offset(offset - (at or 0)).limit(max(1, limit))
    rows = rows.select(field(row_id_col), (F.row_number().over(W.orderBy(*order)) + offset).alias("pos"))
    return df.join(F.broadcast(rows), row_id_col).select(*[field(c) for c in df.columns], "pos")  # ``limit`` rows


def page_after(df: DataFrame, last: dict, key: str | None = None, descending: bool = False, limit: int = PAGE, row_id_col: str = ROW_ID) -> DataFrame:
    """The page after a row of which ``last`` has the key's value and the row id: a filter and a top-k, however far."""
    if key is None or key not in df.columns:
        return df.filter(F.col(row_id_col) > last[row_id_col]).orderBy(row_id_col).limit(max(1, limit))
    kind = df.schema[key].dataType
    a, b = F.col(_SORT), sort_key(F.lit(last[key]).cast(kind), kind)
    # fields are compared as the sort compares them: null is the smallest
    less = lambda x, y: (x["c"] < y["c"]) | ((x["c"] == y["c"]) & (F.coalesce(x["n"] < y["n"], F.lit(False)) | F.coalesce(x["t"] < y["t"], F.lit(False))))
    beyond = less(a, b) if descending else less(b, a)
    rest = _keyed(df, key).filter(beyond | (a.eqNullSafe(b) & (F.col(row_id_col) > last[row_id_col])))
    return rest.orderBy(*_order(descending, row_id_col)).limit(max(1, limit)).drop(_SORT)


def totals(everything: DataFrame, filtered: DataFrame, flag_col: str = "flag") -> DataFrame:
    """One row: rows before filters, after them, and of these the ones with a flag."""
    a = everything.agg(F.count("*").alias("total_rows"))
    b = filtered.agg(F.count("*").alias("total_filtered_rows"), F.count_if(F.col(flag_col) != "").alias("total_flagged"))
    return one_row(a, b)


def one_row(*rows: DataFrame) -> DataFrame:
    """Single rows with different columns as one row."""
    both = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), rows)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def query_rows(
    df: DataFrame, annotations: DataFrame, rules: DataFrame | list[dict], query: str = "", flag: str | None = None, columns: list[str] | None = None,
    key: str | None = None, descending: bool = False, offset: int = 0, limit: int = PAGE, row_id_col: str = ROW_ID,
) -> tuple[DataFrame, DataFrame]:
    """(page, totals) of a searched, resolved, filtered and sorted table; the page has row records (``records``) with their ``pos``.

    The search runs before flags are resolved, and rule matches go with the rows
    into the top-k.  Both frames are lazy, so each that is used scans the table;
    ``query_page`` gets both in one pass."""
    kept = flag_filter(_resolved_rows(df, annotations, rules, query, columns, row_id_col), flag, "__flag")
    shown = page(kept, key, descending, offset, limit, row_id_col)
    data = F.struct(*[field(c) for c in data_columns(df, row_id_col)]).alias("data")
    return shown.select(field(row_id_col).alias("row_index"), data, F.col("__flag").alias("flag"), F.col("__memo").alias("memo"), "pos"), totals(df, kept, "__flag")


def query_page(
    df: DataFrame, annotations: DataFrame, rules: DataFrame | list[dict], query: str = "", flag: str | None = None, columns: list[str] | None = None,
    key: str | None = None, descending: bool = False, offset: int = 0, limit: int = PAGE, row_id_col: str = ROW_ID,
) -> tuple[list[Row], dict[str, int]]:
    """``query_rows``, done: the page's records and its totals, which are observed in the same pass."""
    every, some = Observation(), Observation()
    found = _resolved_rows(df.observe(every, F.count(F.lit(1)).alias("total_rows")), annotations, rules, query, columns, row_id_col)
    kept = flag_filter(found, flag, "__flag").observe(some, F.count(F.lit(1)).alias("total_filtered_rows"), F.count_if(F.col("__flag") != "").alias("total_flagged"))
    data = F.struct(*[field(c) for c in data_columns(df, row_id_col)]).alias("data")
    rows = page(kept, key, descending, offset, limit, row_id_col).select(field(row_id_col).alias("row_index"), data, F.col("__flag").alias("flag"), F.col("__memo").alias("memo"), "pos").collect()
    return rows, every.get | some.get


def _resolved_rows(df: DataFrame, annotations: DataFrame, rules: DataFrame | list[dict], query: str, columns: list[str] | None, row_id_col: str) -> DataFrame:
    return resolve(search_filter(df, query, columns, row_id_col), annotations, rules, "view", None, row_id_col, "__flag", "__memo")


def observed_page(df: DataFrame, flag_col: str = "flag", **how) -> tuple[DataFrame, Observation]:
    """A page of a resolved table whose full counts are observed in the same pass."""
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("total_filtered_rows"), F.count_if(F.col(flag_col) != "").alias("total_flagged"))
    return page(counted, **how), seen


def preview(df: DataFrame, annotations: DataFrame, rules: DataFrame | list[dict], limit: int = PAGE, row_id_col: str = ROW_ID) -> DataFrame:
    """The first rows with their preview flags and memos."""
    return resolve(df.orderBy(row_id_col).limit(limit), annotations, rules, "preview", None, row_id_col)
