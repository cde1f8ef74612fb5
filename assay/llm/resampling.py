"""Importance resampling towards a target distribution, by hashed n-grams of bytes.

A 256-byte table lower-cases A-Z and blanks separators of the UTF-8 text,
``bytes.split`` yields the words, and chained ``zlib.crc32`` seeds extend an
n-gram by a word (the checksum of "a b" is that of " b" seeded with "a"'s).
Counters of each slice add up to 10,000 bucket counts in Spark, once over the
raw documents and once over the target texts.  A bucket's gain is the logarithm
of how much commoner it is in the target; a document weighs the sum of its
features' gains, and Gumbel noise that depends on its doc_id alone turns the
highest scores into a draw without replacement.

The draw is ranked without a global sort in one task: scored rows are dealt by
ranges of their order, ranges are counted, and a row's rank is the rows of the
ranges before plus its place in its own.  Only the bucket counts (10,000 at
most, whatever the input) come to the driver and go back to the tasks.

Defined results: null and empty texts and texts without words have no features
and weight 0; very long texts are read whole, in stretches of ``STRETCH``
bytes that overlap by two words; repeated rows are separate documents and
drawn each for itself; a null doc_id is hashed as the empty text and stands
before all others in ties; further columns may have any names; an empty table
gives no rows, and without target texts the gains still follow the formula.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, modest_batches, partitions_for

BUCKETS = 10_000
LONGEST = 3
#: Bytes of a text whose words are in memory at a time.
STRETCH = 1 << 20
#: Words that a document needs to be drawn.
LEAST_WORDS = 20

#: Digits, lower-case letters and all bytes of longer UTF-8 sequences stay, A-Z become lower case, the rest is blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def stretches(text: bytes) -> Iterator[bytes]:
    """A translated text in stretches of about ``STRETCH`` bytes, cut at blanks."""
    lo = 0
    while len(text) - lo > STRETCH:
        hi = text.find(b" ", lo + STRETCH)
        if hi < 0:
            break
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


def features(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(new words, buckets of the n-grams that end in them) of each stretch of a text."""
    kept: list[bytes] = []
    for part in stretches(text.translate(TABLE)):
        words = kept + part.split()
        old = len(kept)
        seeds = list(map(zlib.crc32, words))
        spaced = [b" " + w for w in words]
        sums = seeds[old:]
        for n in range(1, LONGEST):
            # seeds[i] becomes the checksum of the n-gram that starts at word i
            seeds = list(map(zlib.crc32, spaced[n:], seeds))
            sums += seeds[max(0, old - n) :]
        yield len(words) - old, np.array(sums, np.int64) % BUCKETS
        kept = words[max(0, len(words) - LONGEST + 1) :]


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all texts are in each bucket."""

    def run(batches):
        counts: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.large_binary()):
                if text.is_valid:
                    for _, buckets in features(text.as_py()):
                        counts.update(buckets.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["bucket", "n"])

    sums = texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in sums.collect():  # BUCKETS rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(p/q)) of each bucket, with one feature added to every bucket of both."""
    s_all, t_all = float(raw.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None) -> int:
    """Gumbel noise in thousandths, from the doc_id alone."""
    h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            words, n, weight = [], [], []
            for text in batch.column(1).cast(pa.large_binary()):
                made = [0, 0, 0]
                for new, buckets in features(text.as_py()) if text.is_valid else ():
                    made = [made[0] + new, made[1] + len(buckets), made[2] + int(gain[buckets].sum())]
                words.append(made[0])
                n.append(made[1])
                weight.append(made[2])
            score = [w + noise(i) for i, w in zip(ids, weight, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, words, n, weight, score)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, take: int, rows_per_range: int = 500_000) -> DataFrame:
    """``rows`` with their rank (from 1) by score downward, then doc_id; null beyond the first ``take``."""
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # equal rows are dealt to several ranges
    rows = materialize(rows, "scores")
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("row")]
    ranges = max(2, partitions_for(rows.count(), rows_per_range))
    dealt = materialize(rows.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each range
    place = F.row_number().over(W.partitionBy("part").orderBy(*order))
    rank = (F.col("before") + F.col("place")).cast("long")
    out = dealt.withColumn("place", place).join(before, "part")
    return out.withColumn("rank", F.when(rank <= take, rank)).drop("row", "part", "place", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = LEAST_WORDS) -> DataFrame:
    """Every row's n_words, n_features, weight and score, and the rank of those that are drawn: ``percent`` of the rows with enough words."""
    modest_batches(docs.sparkSession)
    gain = gains(bucket_counts(docs), bucket_counts(target))
    rows = materialize(scored(docs, gain), "weights")
    fit = rows.filter(F.col("n_words") >= least_words)
    drawn = ranked(fit, fit.count() * percent // 100)
    return drawn.unionByName(rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


# CRC-32 is linear: the checksum of n bytes is the exclusive or of an entry for each byte and its distance
# from the end, and of the entry of the starting value (b = -1) after n bytes; all bits are flipped at the end.
OP13_SQL = r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT src, row, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
    SELECT src, row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM (
      SELECT 'd' AS src, row_number() OVER () AS row, text FROM documents UNION ALL SELECT 't', row_number() OVER (), text FROM benchmark))
), grams AS MATERIALIZED (
  SELECT src, row, unnest([w, w || ' ' || w2, w || ' ' || w2 || ' ' || w3]) AS g FROM (
    SELECT src, row, w, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM words WINDOW p AS (PARTITION BY src, row ORDER BY i))
), counted AS MATERIALIZED (
  SELECT src, row, g, count(*) AS n FROM grams WHERE g IS NOT NULL GROUP BY ALL
), step AS MATERIALIZED (
  SELECT b, list_reduce([b::UINTEGER] || list_transform(range(8), lambda x: 0::UINTEGER), lambda c, i: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384::UINTEGER ELSE 0::UINTEGER END)) AS v FROM (SELECT unnest(range(256)) AS b)
), longest AS MATERIALIZED (
  SELECT max(strlen(g)) AS n FROM counted
), tab(d, b, v) AS (
  SELECT 0, b, v FROM step UNION ALL SELECT 0, -1, 4294967295::UINTEGER
  UNION ALL
  SELECT tab.d + 1, tab.b, xor(tab.v >> 8, step.v) FROM tab JOIN step ON step.b = tab.v % 256 WHERE tab.d < (SELECT n FROM longest)
), bytes AS (
  SELECT g, strlen(g) AS n, unnest(range(strlen(g))) AS place, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM counted)
), body AS (
  SELECT f.g, any_value(f.n) AS n, bit_xor(tab.v) AS v FROM bytes f JOIN tab ON tab.d = f.n - 1 - f.place AND tab.b = ('0x' || substr(f.x, 2 * f.place + 1, 2))::INT GROUP BY f.g
), crc AS MATERIALIZED (
  SELECT body.g, xor(xor(body.v, tab.v), 4294967295::UINTEGER) % 10000 AS bucket FROM body JOIN tab ON tab.d = body.n AND tab.b = -1
), per AS MATERIALIZED (
  SELECT src, row, bucket, sum(n)::BIGINT AS n FROM counted JOIN crc USING (g) GROUP BY ALL
), tot AS (
  SELECT bucket, coalesce(sum(n) FILTER (src = 'd'), 0)::BIGINT AS s, coalesce(sum(n) FILTER (src = 't'), 0)::BIGINT AS t FROM per GROUP BY bucket
), sums AS (
  SELECT sum(s)::BIGINT AS s_all, sum(t)::BIGINT AS t_all FROM tot
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM tot, sums
), weights AS (
  SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM per JOIN gain USING (bucket) WHERE src = 'd' GROUP BY row
), score AS (
  SELECT d.doc_id, d.row, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(c.n, 0) AS n_words,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score
  FROM (SELECT doc_id, row_number() OVER () AS row FROM documents) d LEFT JOIN weights USING (row) LEFT JOIN (SELECT row, count(*) AS n FROM words WHERE src = 'd' GROUP BY row) c USING (row)
), rank AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM score WHERE n_words >= 20 QUALIFY rank <= (SELECT 5 * count(*) // 100 FROM score WHERE n_words >= 20)
)
SELECT doc_id, n_features, weight, score, rank.rank FROM score LEFT JOIN rank USING (row)
"""
