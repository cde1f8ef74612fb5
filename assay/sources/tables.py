"""Reading and writing tables: CSV import with row ids, Parquet datasets, annotated export."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import field, search_text, trim_all
from ..operators.search import ROW_ID
from . import csv_splits

#: Prefix of the reserved columns ``<prefix>-safe``, ``-suspicious``, ``-critical`` and ``-memo``.
PREFIX = "triage"
FLAGS = ("critical", "suspicious", "safe")
CSV_WRITE = {"header": True, "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


#: Bytes of values, about, that one file is to hold: more than a split of a file that is read.
FILE_BYTES = 256 << 20


def in_ranges(df: DataFrame, key: str, least: int = 1) -> DataFrame:
    """``df`` by ranges of a column, as many as its values need at ``FILE_BYTES`` each, ``least`` at least.

    So no task has to take or write more of a longer table; one pass adds up the lengths of the texts."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    of_row = sum((F.coalesce(F.octet_length(field(c)), F.lit(0)) for c in texts), F.lit(8 * (len(df.columns) - len(texts))).cast("long"))
    size = df.agg(F.sum(of_row)).first()[0] or 0
    return df.repartitionByRange(max(least, -(-size // FILE_BYTES)), field(key))


def broken_fields(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether a quoted field may go over a line break: some line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, multi_line: bool | None = None, row_id_col: str | None = None) -> DataFrame:
    """A CSV with a header; any malformed row is an error.

    Without a schema a column is long, double or boolean if all of its values
    are, else it stays the text as written (dates too, and whole numbers beyond
    64 bits).  ``multi_line`` says whether fields hold line breaks, None looks
    (``broken_fields``); such files are split too (``csv_splits``), unless quotes
    stand inside fields that are not quoted: then a file is one task.
    ``row_id_col`` names a column for row ids, 0..n-1 in the order of the rows."""
    if multi_line is None:
        multi_line = broken_fields(spark, path)
    if multi_line:
        made = csv_splits.records(spark, path)
        if csv_splits.well_formed(made):
            return _parsed(spark, path, made, schema, row_id_col)
    options = {"header": True, "multiLine": multi_line, "escape": '"', "mode": "FAILFAST"}
    if schema is not None:
        rows = spark.read.options(**options).schema(schema).csv(path)
    else:
        rows = _typed(spark.read.options(**options, inferSchema=False).csv(path))
    return with_row_ids(rows, row_id_col) if row_id_col else rows


def _typed(text: DataFrame, but: str | None = None) -> DataFrame:
    kinds = inferred(text.drop(but) if but else text)
    return text.select(*[field(c).cast(kinds[c]).alias(c) if kinds.get(c, "string") != "string" else field(c) for c in text.columns])


def _parsed(spark: SparkSession, path: str | list[str], made: DataFrame, schema: T.StructType | str | None, row_id_col: str | None) -> DataFrame:
    """The fields of records that are put together already."""
    names = spark.read.options(header=True, multiLine=True, escape='"', inferSchema=False).csv(path).columns
    given = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema) if schema else T.StructType([T.StructField(c, T.StringType()) for c in names])
    rows = csv_splits.numbered(made, "__csv_row")
    fields = F.from_csv("text", given.toDDL(), {"escape": '"', "mode": "FAILFAST", "multiLine": "true"})
    # the struct is a column of its own: it is parsed once a row, not once a field
    out = rows.select("__csv_row", fields.alias("__csv")).select(F.col("__csv_row").alias(row_id_col or "__csv_row"), "__csv.*")
    out = out if schema is not None else _typed(out, row_id_col or "__csv_row")
    return out if row_id_col else out.drop("__csv_row")


def inferred(text: DataFrame) -> dict[str, str]:
    """For each string column the narrowest of long, double, boolean and string that holds every value: one pass.

    A whole number that is no long makes its column a string: a double would merge different ids."""
    whole = lambda c: c.rlike(r"^[+-]?\d+$")
    tests = {
        "long": lambda c: whole(c) & c.try_cast("long").isNotNull(),
        "double": lambda c: c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") & (~whole(c) | c.try_cast("long").isNotNull()),
        "boolean": lambda c: c.isin("true", "false"),
    }
    names = list(enumerate(text.columns))
    if not names:
        return {}
    # of a null the tests are null, which bool_and leaves out
    got = text.agg(*[F.coalesce(F.bool_and(F.when(field(c).isNotNull(), t(field(c)))), F.lit(False)).alias(f"{k}_{i}") for i, c in names for k, t in tests.items()]).first()
    return {c: next((k for k in tests if got[f"{k}_{i}"]), "string") for i, c in names}


def annotation_columns(df: DataFrame, prefix: str = PREFIX) -> list[str]:
    return [c for c in df.columns if c in {f"{prefix}-{x}" for x in (*FLAGS, "memo")}]


def lift_annotations(df: DataFrame, prefix: str = PREFIX, row_id_col: str = ROW_ID) -> tuple[DataFrame, DataFrame]:
    """(data without the reserved columns, annotations from them).

    A flag column is set where its text is neither null, empty nor ``0``; the
    most severe one wins.  Rows without flag and memo have no annotation."""
    reserved = annotation_columns(df, prefix)
    text = lambda c: search_text(field(c), df.schema[c].dataType)
    flag: Column = F.lit("")
    for x in reversed(FLAGS):
        if f"{prefix}-{x}" in reserved:
            t = text(f"{prefix}-{x}")
            flag = F.when(t.isNotNull() & ~t.isin("", "0"), x).otherwise(flag)
    memo = F.nullif(trim_all(text(f"{prefix}-memo")), F.lit("")) if f"{prefix}-memo" in reserved else F.lit(None).cast("string")
    a = df.select(field(row_id_col).alias("row_id"), flag.alias("flag"), memo.alias("memo"))
    return df.drop(*reserved), a.filter((F.col("flag") != "") | F.col("memo").isNotNull())


def _places(df: DataFrame) -> DataFrame:
    """``df`` with where each row stands: its file and the start of its split, else its partition, and a number that grows inside them."""
    try:
        where = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"))
    except AnalysisException:  # no files are read: partitions are in order
        where = df.withColumns({"__file": F.lit(""), "__start": F.shiftright(F.monotonically_increasing_id(), 33)})
    return where.withColumn("__m", F.monotonically_increasing_id())


def with_row_ids(df: DataFrame, row_id_col: str = ROW_ID) -> DataFrame:
    """Ids 0..n-1 in the order of the rows: files by path, rows as they stand in them.

    Sizes of splits are summed up in that order and joined to the rows as a
    small table.  Two passes over ``df``, no shuffle of rows and no global sort;
    ``df`` has to give the same splits twice, as a table scan does, and a row
    whose split is not found again is an error."""
    key = ["__file", "__start"]
    raw = _places(df)
    sizes = raw.groupBy(*key).agg(F.count("*").alias("__n"), F.min("__m").alias("__first"))
    # one row per split of the input
    before = F.coalesce(F.sum("__n").over(W.orderBy(*key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before")
    base = sizes.select(*key, "__n", "__first", before)
    place = F.col("__m") - F.col("__first")
    found = (place >= 0) & (place < F.col("__n"))
    row_id = F.when(found, F.col("__before") + place).otherwise(F.raise_error(F.lit("the input has other splits than before")).cast("long"))
    return raw.join(base, key, "left").select(row_id.cast("long").alias(row_id_col), *[field(c) for c in df.columns])


def write_dataset(df: DataFrame, path: str) -> None:
    """A dataset as Parquet, in as many files as there are partitions."""
    df.write.mode("overwrite").parquet(path)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def import_csv(spark: SparkSession, path: str, dataset: str, prefix: str = PREFIX, **how) -> tuple[DataFrame, DataFrame]:
    """CSV → (stored dataset with row ids, its lifted annotations)."""
    data, annotations = lift_annotations(read_csv(spark, path, row_id_col=ROW_ID, **how), prefix)
    write_dataset(data, f"{dataset}/data")
    return read_dataset(spark, f"{dataset}/data"), annotations


def export_frame(resolved: DataFrame, prefix: str = PREFIX, row_id_col: str = ROW_ID, flag_col: str = "flag", memo_col: str = "memo", drop_reserved: bool = False, ordered: bool = False) -> DataFrame:
    """The annotated table in row order: three 0/1 columns, the memo, then the data columns.

    ``resolved`` has the flag and memo of ``resolve(..., mode="export")``.
    ``drop_reserved`` leaves out data columns named flag or memo as well;
    ``ordered`` says that the rows are in order already (``sources.export``)."""
    out = {row_id_col, flag_col, memo_col, *(("flag", "memo") if drop_reserved else ())}
    flags = [(field(flag_col) == x).cast("int").alias(f"{prefix}-{x}") for x in ("safe", "suspicious", "critical")]
    memo = F.coalesce(field(memo_col), F.lit("")).alias(f"{prefix}-memo")
    rows = resolved if ordered else resolved.orderBy(row_id_col)
    return rows.select(*flags, memo, *[field(c) for c in resolved.columns if c not in out])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV that ``read_csv`` reads back: values are not trimmed, empty texts stay empty."""
    df.write.mode("overwrite").options(**CSV_WRITE).csv(path)
