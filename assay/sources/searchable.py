"""Stored row text with an index from trigrams to files, so that searches skip files.

A dataset is stored with its row text (``search.with_row_text``).  Beside it
stands a table of which trigrams, by hash, each file's texts hold: at most
``BUCKETS`` short rows a file.  A clause of a query can only hold in files that
have all trigrams of all its positive terms; the others are not opened.  Files
that the index does not know (those without rows too), or knows as they were
before, are always read, and every row is still tested, so the rows found are
those of a full search.

Trigrams are three UTF-16 units and are taken with numpy: a pass marks the buckets of each
batch in an array of ``BUCKETS``, so that what a task hands on does not grow with
its texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import field
from ..operators.profile import dataset_files, same_path
from ..operators.search import ROW_ID, data_columns, search_filter, with_row_text
from ..plans.query import Query, compile_query

BUCKETS = 1 << 16
#: Bytes of texts that are decoded together, about; UTF-16 units whose trigrams are taken together.
SLICE_BYTES, SLICE_UNITS = 4 << 20, 1 << 18
TEXT = "__text"
#: Folder of the index; another way to make buckets needs another name.
_FOLDER = "trigrams-utf16"
_INDEX = "file string, modified timestamp, bucket int"


def write_searchable(df: DataFrame, dataset: str, columns: list[str] | None = None, row_id_col: str = ROW_ID) -> None:
    """Appends rows with their row text to a stored dataset and indexes the files that are new."""
    with_row_text(df, columns, row_id_col, TEXT).write.mode("append").parquet(f"{dataset}/data")
    index_files(df.sparkSession, dataset)


def _index(spark: SparkSession, dataset: str) -> DataFrame:
    try:
        return spark.read.schema(_INDEX).parquet(f"{dataset}/{_FOLDER}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _INDEX)


def _buckets(units: np.ndarray) -> np.ndarray:
    """The bucket of the trigram that starts at each UTF-16 unit but the last two."""
    u = units.astype(np.uint32)
    return ((u[:-2] * np.uint32(0x9E3779B1) + u[1:-1] * np.uint32(0x85EBCA6B) + u[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)) >> np.uint32(16)


def _units(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, modified, bucket) of (file, modified, text): each bucket once for a file whose rows come one after another.

    Texts are looked at as one, a line each; the trigrams where they meet can only make a file read."""

    def taken(at, has):
        found = np.append(np.flatnonzero(has), -1)  # -1: the file is in the index
        return pa.RecordBatch.from_arrays([pa.array([at[0]] * len(found), pa.string()), pa.array([at[1]] * len(found), pa.int64()), pa.array(found, pa.int32())], names=["file", "modified", "bucket"])

    at, has = None, None
    for batch in batches:
        texts, n = batch.column(2), batch.num_rows
        files, step = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), max(1, SLICE_BYTES * n // max(1, texts.nbytes))
        starts = [i for i in range(n) if i == 0 or files[i] != files[i - 1]]
        for a, b in zip(starts, [*starts[1:], n], strict=True):
            if files[a] != at:
                if at:
                    yield taken(at, has)
                at, has = files[a], np.zeros(BUCKETS, bool)
            for i in range(a, b, step):
                # bytes that are no UTF-8 are in no term
                units = _units(b"\n".join(texts.slice(i, min(step, b - i)).drop_null().to_pylist()).decode(errors="replace"))
                for j in range(0, len(units), SLICE_UNITS):
                    has[_buckets(units[j : j + SLICE_UNITS + 2])] = True
    if at:
        yield taken(at, has)


def index_files(spark: SparkSession, dataset: str) -> list[str]:
    """Adds the trigrams of files that are not in the index yet, and returns these files. One pass over their texts alone."""
    known = _index(spark, dataset).select("file", "modified").distinct()
    new = [r["path"] for r in dataset_files(spark, f"{dataset}/data").join(known, ["file", "modified"], "left_anti").collect()]  # names of files
    if new:
        at = [same_path(F.col("_metadata.file_path")).alias("file"), F.unix_micros("_metadata.file_modification_time").alias("modified")]
        rows = spark.read.parquet(*new).select(*at, F.col(TEXT).cast("binary")).mapInArrow(_marked, "file string, modified long, bucket int")
        rows = rows.withColumn("modified", F.timestamp_micros("modified"))
        rows.distinct().sortWithinPartitions("bucket").write.mode("append").parquet(f"{dataset}/{_FOLDER}")
    return new


def _wanted(query: Query, scoped: bool) -> list[set[int]] | None:
    """For each clause the buckets that a file must have; None if a clause asks for none."""
    out = []
    for clause in query.clauses:
        terms = [x.term for x in clause if not x.negated and (x.column is None or scoped)]
        out.append({int(b) for t in terms for b in _buckets(_units(t))})
    return out if all(out) else None


def files_to_read(spark: SparkSession, dataset: str, query: str, scoped: bool = True) -> list[str]:
    """The files in which the query may hold. ``scoped`` says that the stored text covers all columns."""
    files, index = dataset_files(spark, f"{dataset}/data"), _index(spark, dataset)
    q = compile_query(query)
    wanted = None if q.blank else _wanted(q, scoped)
    if wanted is None:
        return [r["path"] for r in files.select("path").collect()]
    every = sorted(set().union(*wanted) | {-1})
    has = index.filter(F.col("bucket").isin(every)).groupBy("file", "modified").agg(F.collect_set("bucket").alias("has"))  # a query's buckets at most
    clause = lambda buckets: F.size(F.array_except(F.array(*map(F.lit, sorted(buckets))), F.coalesce("has", F.array().cast("array<int>")))) == 0
    may = F.col("has").isNull()
    for buckets in wanted:
        may = may | clause(buckets)
    return [r["path"] for r in files.join(has, ["file", "modified"], "left").filter(may).select("path").collect()]


def search_stored(spark: SparkSession, dataset: str, query: str, columns: list[str] | None = None, row_id_col: str = ROW_ID) -> DataFrame:
    """``search_filter`` of a stored dataset, without its row text; files in which the query cannot hold are not opened.

    ``columns`` are those that the row text was stored with."""
    paths = files_to_read(spark, dataset, query, columns is None)
    whole = spark.read.parquet(f"{dataset}/data")
    rows = spark.read.schema(whole.schema).parquet(*paths) if paths else whole.limit(0)
    found = search_filter(rows, query, columns, row_id_col, TEXT)
    return found.select(field(row_id_col), *[field(c) for c in data_columns(whole, row_id_col) if c != TEXT])
