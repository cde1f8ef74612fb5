"""Boolean text search over the rows of any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import field, search_text
from ..plans.predicates import Texts, row_predicate, scope_names
from ..plans.query import compile_query

ROW_ID = "__rowid"


def data_columns(df: DataFrame, row_id_col: str = ROW_ID) -> list[str]:
    """All columns but the row id, in order."""
    return [c for c in df.columns if c != row_id_col]


def texts_of(df: DataFrame, columns: list[str] | None = None, row_id_col: str = ROW_ID, text_col: str | None = None) -> Texts:
    """Texts of ``columns`` (unknown names are skipped; None: all data columns).

    Scoped terms may name any data column, whatever ``columns`` says."""
    every = [c for c in data_columns(df, row_id_col) if c != text_col]
    some = every if columns is None else [c for c in columns if c in every]
    hidden = [c for c in (row_id_col, text_col) if c]
    return Texts(df, some, scope_names(df, hidden), text_col)


def search_filter(df: DataFrame, query: str, columns: list[str] | None = None, row_id_col: str = ROW_ID, text_col: str | None = None) -> DataFrame:
    """Rows that the query finds; all rows if it has no term.

    ``text_col`` names a stored row text of the same columns (``with_row_text``)."""
    q = compile_query(query)
    return df if q.blank else df.filter(row_predicate(texts_of(df, columns, row_id_col, text_col), q))


def has_text(df: DataFrame, row_id_col: str = ROW_ID) -> Column:
    """Whether any data column has a text; without building the row text."""
    out = F.lit(False)
    for c in data_columns(df, row_id_col):
        kind = df.schema[c].dataType
        one = field(c).isNotNull() if isinstance(kind, (T.NumericType, T.BooleanType, T.DatetimeType)) else F.coalesce(search_text(field(c), kind), F.lit("")) != ""
        out = out | one
    return out


def row_matches(df: DataFrame, query: str, columns: list[str] | None = None, row_id_col: str = ROW_ID) -> Column:
    """Whether the query finds a single row; a query without terms finds none (as rules do), and a row without any text is never found."""
    q = compile_query(query)
    return F.lit(False) if q.blank else has_text(df, row_id_col) & row_predicate(texts_of(df, columns, row_id_col), q)


def with_row_text(df: DataFrame, columns: list[str] | None = None, row_id_col: str = ROW_ID, text_col: str = "__text") -> DataFrame:
    """Adds the row text as a column, to be stored once and searched often."""
    return df.withColumn(text_col, texts_of(df, columns, row_id_col).row())
