"""Mixing sources to target weights by weighted fair queueing (DataFrame operations only).

Every source's documents are shuffled (ordered by a hash of their id) and queue
up, once for each permitted repeat.  A copy's virtual finish time is the words
of its source up to and including it, divided by the source's target weight.
All copies are range-sorted by that time and the mix is cut at the total
budget: what stands before the cut is taken, whatever its source.  A source is
off its target by at most what stands at the cut, so the copy of each source
that is in service at virtual time one, when all targets are met, queues as
packets of ``PACKET`` words with finish times of their own.

Water-filling of the targets, prefix sums inside sources (hash buckets of a
bounded size, so a hot source is many groups) and the running total over range
partitions are all distributed; the only one-task step is a window over one row
per source.

Defined results: null text and text without words have size 0, are never taken;
null is a source of its own, last in order; repeated rows queue as separate
documents; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import known_id, materialize, partitions_for, unused

WORD = r"[^\x20\x09-\x0D]+"
#: Words of the pieces in which the copies in service at virtual time one queue.
PACKET = 64


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the whole text), h (place in the shuffled order)."""
    size = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(WORD)))
    h = F.conv(F.substring(F.md5(known_id().cast("string")), 1, 15), 16, 10).cast("long")
    return docs.select("doc_id", "source", size.cast("long").alias("size"), h.alias("h"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3) -> DataFrame:
    """source, source_size, n_rows, weight, target: water-filled shares of all words.

    Sources by code point, null last, weigh ``weights`` in turn.  A target stops
    at ``most`` times its source's size and the excess goes to the others by
    weight.  In order of most*size/weight, a source is stopped exactly if its
    limit is at most its share of what the stopped ones before it leave."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    s = s.withColumn("weight", weight.cast("long")).withColumn("limit", F.col("source_size") * most)
    by = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by.rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("source_size").over(W.partitionBy()) * F.lit(share)
    s = s.withColumn("budget", total).withColumn("left", F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0)))
    s = s.withColumn("open", F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("stopped", F.col("limit") * F.col("open") <= F.col("left") * F.col("weight"))
    # what the sources that are not stopped share, and by which weights
    kept = F.max(F.when(~F.col("stopped"), F.struct("open", "left"))).over(W.partitionBy())
    level = F.col("weight") * (F.col("kept.left") / F.col("kept.open"))
    s = s.withColumn("kept", kept)
    return s.select(
        "source", "source_size", "n_rows", "weight",
        F.when(F.col("stopped"), F.col("limit").cast("double")).otherwise(level.cast("double")).alias("target"),
    )


def queue_places(sizes: DataFrame, targets: DataFrame, bucket_rows: int = 2_000) -> DataFrame:
    """Adds to each document its place ``k`` and the words ``before`` it in its source's shuffled queue.

    Queues are cut into hash buckets (so many that a source with all rows would
    have ``bucket_rows`` in each): bucket sums are prefix-summed, then documents
    inside each bucket.  Documents are only ever dealt out by source *and*
    bucket; the targets come to them with the bucket sums."""
    n = partitions_for(sizes.count(), bucket_rows)
    no_source, source_key = F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key")
    bucket = (F.col("h") / F.lit(float(1 << 60)) * n).cast("long").alias("bucket")
    d = sizes.select("doc_id", "size", "h", no_source, source_key, bucket)
    key = ["no_source", "source_key", "bucket"]
    sums = d.groupBy(*key).agg(F.sum("size").alias("bs"), F.count("*").alias("bn"))
    w = W.partitionBy("no_source", "source_key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select(*key, F.coalesce(F.sum("bs").over(w), F.lit(0)).alias("base"), F.coalesce(F.sum("bn").over(w), F.lit(0)).alias("base_n"))
    base = base.join(targets.select(no_source, source_key, "source_size", "target"), ["no_source", "source_key"])
    inner = W.partitionBy(*key).orderBy("h", "doc_id", "size")
    d = d.withColumn("in_bucket", F.coalesce(F.sum("size").over(inner.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    d = d.withColumn("in_n", F.row_number().over(inner)).join(base, key)
    return d.select(
        "no_source", "source_key", "doc_id", "size", "source_size", "target",
        (F.col("base") + F.col("in_bucket")).alias("before"), (F.col("base_n") + F.col("in_n")).alias("k"),
    )


def mix_queue(placed: DataFrame, most: int = 3, rows_per_partition: int = 1_000_000) -> DataFrame:
    """The mix: copies, or packets of them, in order of virtual finish time with the words taken from each.

    ``mix_at`` is the words of the mix before it.  Running totals go over range
    partitions: sums of partitions, then rows inside each; nothing but the
    running total and the budget decides what is taken."""
    turns = F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("turn")
    c = placed.filter("size > 0").select("*", turns)
    c = c.withColumn("start", F.col("before") + F.col("turn") * F.col("source_size"))
    served = (F.col("start") < F.col("target")) & (F.col("start") + F.col("size") > F.col("target"))
    step = F.when(served, F.lit(PACKET)).otherwise(F.col("size")).cast("long")
    c = c.withColumn("step", step).withColumn("packet", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / F.col("step")))))
    c = c.withColumn("words", F.least(F.col("step"), F.col("size") - F.col("packet") * F.col("step")))
    c = c.withColumn("finish", (F.col("start") + F.col("packet") * F.col("step") + F.col("words")) / F.col("target"))
    c = c.select("no_source", "source_key", "k", "turn", "packet", "doc_id", "words", "finish", "budget")
    order = ["finish", "no_source", "source_key", "turn", "k", "packet"]
    parts = partitions_for(placed.count() * most, rows_per_partition)
    ranged = materialize(c.repartitionByRange(max(parts, 2), *order).withColumn("part", F.spark_partition_id()), "mix")
    sums = ranged.groupBy("part").agg(F.sum("words").alias("s"), F.max("budget").alias("budget"))
    # one row per range partition: a partition's own rows are a million or so
    base = sums.select("part", "budget", F.coalesce(F.sum("s").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    base = base.filter("base < budget").select("part", "base")  # partitions beyond the cut have nothing to be summed
    run = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    m = ranged.join(F.broadcast(base), "part").withColumn("run", F.coalesce(F.sum("words").over(run), F.lit(0)))
    m = m.withColumn("mix_at", F.col("base") + F.col("run"))
    taken = F.greatest(F.lit(0), F.least(F.col("words"), F.floor(F.col("budget")) - F.col("mix_at"))).cast("long")
    return m.withColumn("taken", taken).filter("taken > 0").select("no_source", "source_key", "k", "turn", "packet", "doc_id", "finish", "mix_at", "taken")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(documents with source_size and target, mix of copies) of ``docs`` (doc_id, text, source)."""
    sizes = materialize(sized(docs), "sizes")
    targets = source_targets(sizes, weights, share, most)
    placed = materialize(_with_budget(queue_places(sizes, targets), sizes, share), "queue")
    return placed, mix_queue(placed, most)


def _with_budget(placed: DataFrame, sizes: DataFrame, share: float) -> DataFrame:
    total = sizes.agg(F.sum("size")).first()[0] or 0
    return placed.withColumn("budget", F.lit(float(total)) * F.lit(share))


def taken_words(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, first_at of every row of ``docs``.

    ``copies`` counts the copies of which at least half is taken; ``first_at``
    is where the document first stands in the mix (null if not taken)."""
    placed, mix = mix_sources(docs, weights, share, most)
    key = ["no_source", "source_key", "k"]
    by_turn = mix.groupBy(*key, "turn").agg(F.sum("taken").alias("taken"), F.min("mix_at").alias("mix_at"))
    slim = by_turn.groupBy(*key).agg(F.collect_list("taken").alias("each"), F.sum("taken").alias("taken"), F.min("mix_at").alias("first_at"))  # ``most`` turns at most
    copies = F.coalesce(F.aggregate("each", F.lit(0), lambda a, x: a + (x * 2 >= F.col("size")).cast("int")), F.lit(0))
    return placed.join(slim, key, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), copies.alias("copies"), "first_at")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix as rows: each document of ``docs`` as often as at least half of it is taken.

    Rows of one doc_id (of one text, where the doc_id is null) come as often as the one of them that is taken most."""
    key, n, turn = unused(docs, "id"), unused(docs, "times"), unused(docs, "turn")
    known = docs.select(known_id().alias("doc_id"), "text", "source")
    times = taken_words(known).filter("copies > 0").groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").alias(n))
    return docs.withColumn(key, known_id()).join(times, key).withColumn(turn, F.explode(F.sequence(F.lit(1), n))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h
  FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), s1 AS (
  SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight, source_size * 3 AS lim FROM s0
), s2 AS (
  SELECT *, (SELECT sum(source_size) FROM s0) - coalesce(sum(lim) OVER (ORDER BY lim / weight, source IS NULL, source
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY lim / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM s1
), s3 AS (
  SELECT *, lim * open <= rest * weight AS stopped FROM s2
), s4 AS (
  SELECT *, (SELECT max(open) FROM s3 WHERE NOT stopped) AS k_open,
         (SELECT max_by(rest, open) FROM s3 WHERE NOT stopped) AS k_left FROM s3
), s AS (
  SELECT source, source_size, CASE WHEN stopped THEN lim::DOUBLE ELSE weight * (k_left::DOUBLE / k_open::DOUBLE) END AS target FROM s4
), q AS (
  SELECT d.doc_id, d.source, d.size, d.h, s.source_size, s.target, p.turn,
         coalesce(sum(d.size) OVER (PARTITION BY d.source, p.turn ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           + p.turn * s.source_size AS start
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source CROSS JOIN (VALUES (0), (1), (2)) p(turn)
), e AS (
  SELECT *, CASE WHEN start < target AND start + size > target THEN 64 ELSE size END AS step FROM q WHERE size > 0
), f AS (
  SELECT *, unnest(range((size - 1) // step + 1)) AS packet FROM e
), c AS (
  SELECT *, least(step, size - packet * step)::BIGINT AS words, (start + packet * step + least(step, size - packet * step))::DOUBLE / target AS finish FROM f
), m AS (
  SELECT *, coalesce(sum(words) OVER (ORDER BY finish, source IS NULL, source, turn, h, doc_id, size, packet ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mix_at FROM c
), t AS (
  SELECT doc_id, turn, size, sum(greatest(0, least(words, (SELECT sum(size) FROM d) - mix_at))) AS taken, min(mix_at) FILTER (mix_at < (SELECT sum(size) FROM d)) AS at
  FROM m GROUP BY ALL
)
SELECT d.doc_id, d.size, s.source_size, s.target, coalesce(sum(t.taken), 0)::BIGINT AS taken,
       coalesce(sum((t.taken * 2 >= d.size)::INT), 0)::INT AS copies, min(t.at)::BIGINT AS first_at
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN t ON t.doc_id = d.doc_id
GROUP BY d.doc_id, d.size, s.source_size, s.target
"""
