"""Best-fit packing of token sequences, planned on a histogram of lengths.

Texts are tokenized in Spark tasks; only those longer than a sequence are cut.
Pieces of full length are sequences by themselves.  The others are counted by
length (at most ``room - 1`` counts, whatever the input), and best-fit
decreasing runs over these *counts*: bins of one content are one group, and a
step puts one length into as many bins of a group as there are pieces.  The plan
is a bounded list of runs: ranks a to b of a length go to bins s, s+1, ... at one
offset.  Pieces take their slots by joining on their rank within their length;
ranks come from counts by partition and length and a window inside each
partition, so no length is one group.

Defined results: null and empty texts are the end token alone; repeated rows are
packed as separate documents; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import os
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import materialize, modest_batches

ROOM, END = 1024, 2

#: Both tokenizer libraries split and merge characters of these blocks alike, so
#: the faster one takes texts that have no others.
_PLAIN = regex.compile(r"[^\t\n\r\x20-\x7e¡-¬®-ɏ‐-‧‰-⁞]")
_encoders: dict[str, tuple] = {}


def encoders(vocabulary: str) -> tuple:
    """The vocabulary file's tokenizer as it is, the same ranks in tiktoken (None if there is no such file beside it), and the tokens that stand for themselves in a text."""
    if vocabulary not in _encoders:
        slow = Tokenizer.from_file(vocabulary)
        beside, fast = vocabulary.removesuffix(".json") + ".tiktoken", None
        if os.path.exists(beside):
            with open(beside, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _encoders[vocabulary] = slow, fast, [t.content for t in slow.get_added_tokens_decoder().values()]
    return _encoders[vocabulary]


def token_ids(text: str, vocabulary: str) -> np.ndarray:
    """The ids of a whole text, no special tokens added; those that the text itself holds are single ids."""
    slow, fast, added = encoders(vocabulary)
    if not text:
        return np.zeros(0, np.uint32)
    if fast is None or _PLAIN.search(text) or any(t in text for t in added):
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    return np.array(fast.encode_ordinary(text), np.uint32)


_PIECES = "row long, doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, room: int = ROOM, end: int = END) -> DataFrame:
    """Every document's pieces: ids and the end token, cut from the back so that only the first may be short."""

    def run(batches):
        for batch in batches:
            ids, texts, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out = []
            for row, doc, text in zip(rows, ids, texts, strict=True):
                t = np.append(token_ids(text or "", vocabulary), np.uint32(end)).astype("<u4")
                first = len(t) % room or room
                for k, lo in enumerate([0, *range(first, len(t), room)]):
                    hi = first if k == 0 else lo + room
                    out.append((row, doc, k, lo, hi - lo, zlib.crc32(t[lo:hi].tobytes())))
                if len(out) > 20_000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    def _batch(out):
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["row", "doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).mapInArrow(run, _PIECES)


def best_fit_plan(counts: dict[int, int], room: int = ROOM) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first bin, offset) for ``counts`` pieces of each length.

    Best-fit decreasing over counts: the pieces of a length go, longest length
    first, into the open bins with the least room that still holds them.  A
    group of bins is (first bin, number) for each amount of room left."""
    groups: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    runs: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def put(left: int, first: int, number: int) -> None:
        if left and number:
            if left not in groups:
                groups[left] = []
                insort(rooms, left)
            groups[left].append((first, number))

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        while todo:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                first, number = groups[left].pop()
                if not groups[left]:
                    del groups[left], rooms[at]
            else:
                left, first = room, bins
                each = room // length
                number = -(-todo // each)  # as many new bins as the rest of this length fills
                bins += number
            deep = min(left // length, -(-todo // number)) if number <= todo else 1
            if number > todo:  # only some bins of the group take a piece
                put(left, first + todo, number - todo)
                number = todo
            offset = room - left
            for _ in range(deep):
                some = min(number, todo)
                runs.append((length, rank, rank + some, first, offset))
                rank, todo = rank + some, todo - some
                if some < number:
                    put(left, first + some, number - some)
                    number = some
                left -= length
                offset += length
            put(left, first, number)
    return runs


def packed(docs: DataFrame, vocabulary: str, room: int = ROOM, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row of ``docs``."""
    spark = docs.sparkSession
    modest_batches(spark)
    p = materialize(pieces(docs, vocabulary, room, end).withColumn("part", F.spark_partition_id()), "pieces")
    full, short = p.filter(F.col("length") == room), p.filter(F.col("length") < room)
    by_part = short.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most room - 1 rows
    runs = best_fit_plan(counts, room)
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(W.partitionBy("part", "length").orderBy("row", "piece")) - 1
    ranked = short.withColumn("inside", inside).join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("inside"))
    # the plan: for each length its runs in order of rank; bounded by the room, never by the input
    by_length: dict[int, list] = {}
    for length, a, b, first, offset in runs:
        by_length.setdefault(length, []).append((a, b, first, offset))
    plan = spark.createDataFrame([(k, v) for k, v in by_length.items()], "length int, runs array<struct<a:long,b:long,first:long,offset:long>>")
    slot = F.filter("runs", lambda r: (r.a <= F.col("rank")) & (F.col("rank") < r.b))[0]
    placed = ranked.join(F.broadcast(plan), "length").withColumn("slot", slot)
    cols = ["doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32"]
    out = placed.select(*cols, (F.col("slot.first") + F.col("rank") - F.col("slot.a")).alias("sequence_id"), F.col("slot.offset").alias("offset"))
    # full pieces are sequences by themselves: numbers below zero, from the row and the piece
    n = full.groupBy("part").agg(F.count("*").alias("n"))
    start = n.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    number = F.row_number().over(W.partitionBy("part").orderBy("row", "piece"))
    whole = full.withColumn("number", number).join(start, "part")
    return out.unionByName(whole.select(*cols, (-F.col("base") - F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
