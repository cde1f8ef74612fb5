"""Search and rules on streams: both look at one row at a time, so they need no state.

Annotations and rules are static; annotations join by row id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.rules import compiled, resolve
from ..operators.search import search_filter
from ..operators.view import flag_filter


def triage_stream(stream: DataFrame, rules: DataFrame | list[dict], query: str = "", flag: str | None = None, row_id_col: str = "__rowid", annotations: DataFrame | None = None) -> DataFrame:
    """A streaming table, searched and with effective flags and memos."""
    if annotations is None:
        annotations = stream.sparkSession.createDataFrame([], "row_id long, flag string, memo string")
    found = search_filter(stream, query, row_id_col=row_id_col)
    return flag_filter(resolve(found, annotations, compiled(rules), "view", row_id_col=row_id_col), flag)


def write_triaged(out: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the triaged rows to a Parquet table, all that is available now."""
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
