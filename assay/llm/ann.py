"""Approximate nearest neighbours: inverted lists of product-quantised residuals.

Coarse centroids (k-means) and the codebooks of residual sub-vectors are fitted
on a bounded sample; every vector is then assigned to its list and coded.  A
query probes the lists that can hold one of its nearest, adds up table look-ups
for the codes of their vectors (asymmetric: the query is not quantised; the inner
product with the centroid is exact), and the vectors that can be among the nearest
by that estimate are ranked again by the exact inner product of the original
vectors in double precision.

What can be: a list has the radius of its vectors around the centroid, and a
vector the length of what its code leaves off.  By Cauchy-Schwarz no inner
product is above the centroid's, or the estimate, by more than that length times
the query's.  It is compared with the ``k + 1``-th best product that is known, of
some of the sampled vectors at first and then of the block's best estimates.  So
nothing that is nearest is left out, whatever the rows are like; rows that
the index fits badly only make more work.

Equal vectors are one class, with its ``k + 1`` smallest vec_ids: no query needs
more of them.  Lists are dealt out in blocks of a bounded number of classes
(several small lists, or a part of a hot one), the queries in chunks of a bounded
number.  A block ranks its vectors again where they are, and only the best ``k``
of each query leave it.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part, as queries or candidates;
rows with one vec_id are separate candidates and separate queries, whose results
stand beside each other; a query without candidates has no row; an empty table
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, modest_batches
from .labelled import drawn

#: Vectors that the index is fitted on, at most; lists, at most.
TRAIN_VECTORS, LISTS = 20_000, 1024
#: Of the sampled vectors so many give a first bound to each query; queries whose estimates are made together.
BOUND_VECTORS, TOGETHER = 4096, 32
#: Room for rounding in bounds, as a share of the lengths.
SLACK = 1e-9


def kmeans(x: np.ndarray, k: int, rounds: int = 6, seed: int = 1) -> np.ndarray:
    """Centroids by Lloyd's algorithm; empty ones move to random points."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float64)
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        total = np.stack([np.bincount(at, x[:, j], len(c)) for j in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), len(c))])
    return c


def nearest(x: np.ndarray, c: np.ndarray, rows: int = 8192) -> np.ndarray:
    half = (c**2).sum(axis=1) / 2
    return np.concatenate([(x[i : i + rows] @ c.T - half).argmax(axis=1) for i in range(0, len(x), rows)]) if len(x) else np.zeros(0, int)


@dataclass
class Index:
    coarse: np.ndarray  # lists x dimensions
    books: list[np.ndarray]  # for each sub-vector its centroids
    cuts: np.ndarray  # where sub-vectors begin and end

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, code, distance from the list's centroid and length of what the code leaves off."""
        at = nearest(x, self.coarse)
        r = x - self.coarse[at]
        radius = np.linalg.norm(r, axis=1)
        code = np.stack([nearest(r[:, a:b], book) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)], axis=1)
        left = r - np.concatenate([book[c] for book, c in zip(self.books, code.T, strict=True)], axis=1)
        return at, code.astype(np.uint8), radius, np.linalg.norm(left, axis=1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of the sub-vectors of some queries with every centroid of the books: books x 256 x queries."""
        out = np.zeros((len(self.books), 256, len(q)))
        for j, (a, b, book) in enumerate(zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)):
            out[j, : len(book)] = book @ q[:, a:b].T
        return out


def fit(x: np.ndarray, n: int, per_code: int = 2) -> Index:
    """An index for ``n`` vectors from the sample ``x``: about sqrt(n) lists, one byte for ``per_code`` dimensions."""
    lists = int(np.clip(np.sqrt(n), 1, min(LISTS, max(1, len(x) // 8))))
    coarse = kmeans(x, lists)
    r = x - coarse[nearest(x, coarse)]
    cuts = np.unique(np.append(np.arange(0, x.shape[1], per_code), x.shape[1]))
    return Index(coarse, [kmeans(r[:, a:b], 256, 4) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], cuts)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding): every row with a finite, non-zero vector of the usual length; floats stay floats."""
    v = vectors.filter("vec_id is not null and embedding is not null").select("vec_id", "embedding")
    v = v.filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
    usual = v.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return v.filter(F.size("embedding") == (usual["d"] if usual else 0))


def classes_of(base: DataFrame, k: int) -> DataFrame:
    """(ids, embedding): each different vector with its ``k + 1`` smallest vec_ids, in order.

    The limit inside each group works before the shuffle, so a vector of very many rows is no hot group."""
    place = F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))
    few = base.withColumn("place", place).filter(F.col("place") <= k + 1)
    return few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("ids", "embedding")


def _matrix(col: pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def coded(classes: DataFrame, shared) -> DataFrame:
    """Adds each class's list and code, its distance from the list's centroid and what the code leaves off."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                at, code, radius, left = shared.value[0].encode(_matrix(batch.column(1)))
                cols = [batch.column(0), batch.column(1), pa.array(at, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(radius), pa.array(left)]
                yield pa.RecordBatch.from_arrays(cols, names=["ids", "embedding", "list", "code", "radius", "left"])

    kind = classes.schema["embedding"].dataType.simpleString()
    return classes.mapInArrow(run, f"ids array<long>, embedding {kind}, list int, code binary, radius double, left double")


def bins_of(sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """For each list its bin and the number of blocks of that bin: lists larger
    than ``block`` are bins by themselves, in several blocks; others share one."""
    bins, blocks, load, now = np.zeros(len(sizes), int), np.ones(len(sizes), int), 0, 0
    large = sizes > block
    for i in np.flatnonzero(~large):
        if load + sizes[i] > block:
            now, load = now + 1, 0
        bins[i], load = now, load + sizes[i]
    bins[large] = now + 1 + np.arange(large.sum())
    blocks[large] = -(-sizes[large] // block)
    return bins, blocks


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th largest of each row, -inf if it has fewer."""
    n = scores.shape[1]
    return np.partition(scores, n - k, axis=1)[:, n - k] if n >= k else np.full(len(scores), -np.inf)


def _probes(shared, k: int, radius: np.ndarray, probes: int, bins: np.ndarray, blocks: np.ndarray, chunks: int):
    """Each query once for every block of every bin with lists that it probes: all
    that can hold one of its ``k`` nearest, and ``probes`` at least. ``shared`` has the index and some vectors;
    lists without vectors have a negative radius."""

    def run(batches):
        index, some = shared.value
        longest = np.linalg.norm(index.coarse, axis=1) + radius
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                q = _matrix(part.column(1))
                length = np.linalg.norm(q, axis=1)
                bound = _kth(q @ some.T, k + 1)  # one of these may be the query itself
                products = q @ index.coarse.T
                out = []
                for i, v, p, s, known, own in zip(part.column(0).to_pylist(), q, part.column(2).to_pylist(), products, bound, length, strict=True):
                    order = np.argsort(-s, kind="stable")
                    order = order[radius[order] >= 0]
                    far = s + own * radius < known - SLACK * own * longest  # not true of what is no number
                    probed = order[(np.arange(len(order)) < probes) | ~far[order]]
                    for b in np.unique(bins[probed]):
                        mine = probed[bins[probed] == b]
                        out += [(int(b), m, p % chunks, i, p, mine, v, known) for m in range(int(blocks[mine[0]]))]
                if out:
                    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["bin", "block", "chunk", "query_id", "place", "lists", "q", "known"])

    return run


def best_of(estimate: np.ndarray, rerank: int) -> np.ndarray:
    """The ``rerank`` largest estimates and all that tie with the last of them."""
    if len(estimate) <= rerank:
        return np.arange(len(estimate))
    return np.flatnonzero(estimate >= np.partition(estimate, len(estimate) - rerank)[len(estimate) - rerank])


def _scan(shared, rerank: int, k: int):
    """Asymmetric distances of one chunk of queries to the probed lists of one block; the vectors
    that can be among a query's ``k`` nearest are ranked by exact products, the best ``k`` rows stay."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        index, out = shared.value[0], []
        if right.num_rows and left.num_rows:
            queries, places, known = (left.column(c).to_numpy() for c in ("query_id", "place", "known"))
            lists = left.column("lists").to_pylist()
            members = [np.array(x) for x in right.column("ids").to_pylist()]
            smallest = np.array([m[0] for m in members])
            x, q = _matrix(right.column("embedding")), _matrix(left.column("q"))
            codes = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(len(members), -1).astype(np.intp)
            at, off = right.column("list").to_numpy(), right.column("left").to_numpy()
            length, room = np.linalg.norm(q, axis=1), SLACK * (np.linalg.norm(x, axis=1).max() + np.linalg.norm(index.coarse[at], axis=1).max())
            alike = np.argsort([x[0] for x in lists], kind="stable")  # queries together probe much the same lists
            for some in (alike[j : j + TOGETHER] for j in range(0, len(alike), TOGETHER)):
                on = np.zeros((len(some), len(index.coarse)), bool)
                for j, i in enumerate(some):
                    on[j, lists[i]] = True
                near = np.flatnonzero(on.any(axis=0)[at])
                estimates = (index.coarse @ q[some].T)[at[near]]
                for table, code in zip(index.tables(q[some]), codes[near].T, strict=True):
                    estimates += table[code]
                for j, i in enumerate(some):
                    mine = np.flatnonzero(on[j, at[near]])
                    rows, estimate = near[mine], estimates[mine, j]
                    product = lambda r: (x[r] * q[i]).sum(axis=1)  # noqa: B023, E731  # one row like another, so that equal vectors score equally
                    most, least = estimate + length[i] * off[rows], known[i]
                    can = ~(most < least - room * length[i])  # what is no number may be anything
                    if can.sum() > rerank:
                        first = product(rows[best_of(np.nan_to_num(estimate), rerank)])
                        least = max(least, np.nan_to_num(_kth(first[None], k + 1)[0], nan=-np.inf))
                        can = ~(most < least - room * length[i])
                    rows = rows[can]
                    exact = product(rows)
                    best = np.lexsort((smallest[rows], -exact))[: k + 1]  # one may hold the query alone
                    found = []
                    for r in best:
                        ids = members[rows[r]]
                        if (x[rows[r]] == q[i]).all():  # the query's own row is one of these
                            own = np.flatnonzero(ids == queries[i])[:1]
                            ids = np.delete(ids, own)
                        found += [(queries[i], places[i], int(v), float(exact[r])) for v in ids]
                    out += sorted(found, key=lambda f: (-f[3], f[2]))[:k]
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "place", "vec_id", "score"])

    return run


def search(vectors: DataFrame, is_query, k: int = 20, share: float = 0.0, rerank: int = 200, block: int = 8192, chunk: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row for which ``is_query`` holds.

    A query probes every list that can hold one of them (``share`` of the lists at
    least), and a block ranks every vector exactly for it that can be one.  If
    these are more than ``rerank``, that many vectors are ranked before to tell
    better what can be.  Vectors without clear clusters leave no list out."""
    spark = vectors.sparkSession
    modest_batches(spark)
    base = materialize(usable(vectors), "vectors")
    classes = materialize(classes_of(base, k), "classes")
    n = classes.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = classes.filter(drawn(["embedding"], TRAIN_VECTORS, n, 17)).select("embedding").toArrow()
    x = _matrix(sample.column(0))
    x = x[np.lexsort(x.T[::-1])]
    index = fit(x, n)
    some = x[np.random.default_rng(2).permutation(len(x))[:BOUND_VECTORS]]
    shared = spark.sparkContext.broadcast((index, some))
    table = materialize(coded(classes, shared), "codes")
    sizes, radius = np.zeros(len(index.coarse), int), np.full(len(index.coarse), -1.0)
    for r in table.groupBy("list").agg(F.count("*").alias("n"), F.max("radius").alias("radius")).collect():  # one row per list, LISTS at most
        sizes[r["list"]], radius[r["list"]] = r["n"], r["radius"]
    bins, blocks = bins_of(sizes, block)
    # queries are stored with a number of their own, which tells rows of one vec_id apart
    asking = materialize(base.filter(is_query).withColumn("place", F.monotonically_increasing_id()), "queries")
    chunks = max(1, -(-asking.count() // chunk))
    probe = _probes(shared, k, np.nan_to_num(radius, nan=np.inf, posinf=np.inf), int(np.ceil(share * len(sizes))), bins, blocks, chunks)
    asked = asking.mapInArrow(probe, "bin int, block int, chunk int, query_id long, place long, lists array<int>, q array<double>, known double")
    of_list = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("list") + 1)
    dealt = table.select(
        of_list(bins).alias("bin"), F.pmod(F.xxhash64("embedding"), of_list(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "ids", "embedding", "list", "code", "left",
    )
    key = ["bin", "block", "chunk"]
    found = asked.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(_scan(shared, rerank, k), "query_id long, place long, vec_id long, score double")
    top = W.partitionBy("query_id", "place").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(top).cast("int"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
