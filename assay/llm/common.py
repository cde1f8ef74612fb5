"""Shared helpers of the corpus operators: Arrow text slices, vectorised word
hashing, materialised tables and connected components.

Everything here works on whole texts.  The numpy helpers run inside Spark tasks
on slices of one Arrow batch, so their memory is bounded by the slice size (or
by the longest single text).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the numpy helpers look at together.
SLICE_BYTES = 2 << 20

U64 = np.uint64
_P = 0x9E3779B97F4A7C55 | 1
_P_INV = pow(_P, -1, 1 << 64)
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True

_rng = np.random.default_rng(20240229)
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
LOWER_VALUE = BYTE_VALUE.copy()
LOWER_VALUE[65:91] = BYTE_VALUE[97:123]
LOWER_VALUE[WHITE] = 0
_powers = {"p": np.ones(1, np.uint64), "inv": np.ones(1, np.uint64)}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a folder of
    our own where it is unset and all runs on one machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: tables on the way need a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs only its running tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def modest_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches of texts and packed blocks of at most ``size``, unless the session sets its own limit.

    The default of 64 MB is held several times over, in the JVM and in Python,
    by every running task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("bB") in ("67108864", "64m", "64M"):
        spark.conf.set(key, size)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name in taken:
        name += "_"
    return name


def known_id() -> Column:
    """doc_id; a row without one is known by a hash of its text, so that joins and hash deals keep it."""
    return F.coalesce(F.col("doc_id"), F.xxhash64("text"))


def partitions_for(rows: int, per_partition: int) -> int:
    return max(1, -(-int(rows) // per_partition))


def binary_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and its n+1 offsets; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).fill_null(b"")
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64, len(col) + 1 + col.offset)[col.offset :]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data, off


def slices(batch: pa.RecordBatch, name: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows of about ``limit`` bytes."""
    data, off = binary_column(batch, name)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i < n."""
    if len(_powers["p"]) < n:
        size = max(n, SLICE_BYTES + 1024)
        for key, base in (("p", _P), ("inv", _P_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["p"][:n], _powers["inv"][:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """c with c[j]-c[i] = sum of values[k]*P^k over i <= k < j."""
    p, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p, out=out[1:])
    return out


def range_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes in [start, end), the same wherever they stand."""
    _, inv = powers(len(c))
    return mix((c[end] - c[start]) * inv[start] + (end - start).astype(np.uint64) * U64(0x9FB21C651E98DF25))


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes other than 9-13 and 32), and
    for each text the index of its first word (n+1 values)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~WHITE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


_K = mix(np.arange(1, 9, dtype=np.uint64) * U64(0xD6E8FEB86659FD93)) | U64(1)


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For each text its sorted distinct hashed word shingles (A-Z lower-cased).

    A text with fewer words than ``size`` gives its whole sequence as one
    shingle; one without words gives none."""
    starts, ends, first = words_of(data, off)
    out: list[np.ndarray] = []
    if len(starts):
        w = range_hash(prefix_hash(LOWER_VALUE[data]), starts, ends)
        m = len(w) - size + 1
        if m > 0:
            g = w[:m] * _K[0]
            for j in range(1, size):
                g = g + w[j : j + m] * _K[j]
            g = mix(g)
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if hi - lo >= size:
            s = np.sort(g[lo : hi - size + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif hi > lo:
            with np.errstate(over="ignore"):
                one = (w[lo:hi] * _K[: hi - lo]).sum(dtype=np.uint64) + U64(hi - lo) * U64(0xA24BAED4963EE407)
            out.append(mix(np.array([one], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of 64-bit values, as two signed numbers."""
    a = mix(s ^ U64(0x6A09E667F3BCC908)).sum(dtype=np.uint64)
    b = mix(s ^ U64(0xBB67AE8584CAA73B)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component, for edges a[i]-b[i] among n nodes."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new[label]]
        if np.array_equal(new, label):
            break
        label = new
    return label


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of ``edges`` (a, b) with the smallest node it reaches.

    Alternating large-star and small-star contraction: the edge set shrinks to
    one star a component in a logarithmic number of rounds.  Neighbour minima
    are aggregated map-side and joined back, so a node with very many
    neighbours is a skewed join that Spark splits, not one group in a task."""
    e = (
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e = materialize(e, "edges")
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.union(low2.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
