"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct hashed n-grams (three to six bytes of the lower-cased
text) of a whole text.  Each is scaled by the log ratio of its smoothed
document frequencies in the two classes; a logistic regression over the scaled
features is trained by gradient descent on a bounded sample of labelled texts.
Features whose counts do not tell the classes apart have no weight at all, so
scoring gathers weights for every n-gram and only then removes repeats.

Defined results: null and empty texts have no feature and get the score of the
intercept; repeated rows are repeated; without labels of both classes every
score is the share of label 1 (0 if there is none).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import modest_batches, slices
from .labelled import crc_mod, labelled_texts

#: Labelled documents that are learned from, at most.
TRAIN_DOCS = 20_000
BITS = 20
ORDERS = (3, 4, 5, 6)

_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[[9, 10, 11, 12, 13]] = 32


def ngram_buckets(data: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(order, bucket of the n-gram that starts at each byte)."""
    b = _FOLD[data]
    out, code = [], b
    for k in range(1, max(ORDERS)):
        code = code[: max(0, len(b) - k)] | (b[k:] << np.uint64(8 * k))
        if k + 1 in ORDERS:
            h = (code + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            out.append((k + 1, ((h ^ (h >> np.uint64(29))) >> np.uint64(8)).astype(np.uint32) & np.uint32((1 << BITS) - 1)))
    return out


def present(data: np.ndarray, off: np.ndarray, keep: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs, of all buckets or of those that ``keep`` marks."""
    pairs = []
    for k, h in ngram_buckets(data):
        at = np.flatnonzero(keep[h]) if keep is not None else np.arange(len(h))
        doc = np.searchsorted(off, at, "right") - 1
        ok = at + k <= off[doc + 1]
        pairs.append((doc[ok] << BITS) | h[at[ok]])
    u = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return u >> BITS, u & ((1 << BITS) - 1)


@dataclass
class Model:
    keep: np.ndarray  # bucket → has a weight
    weight: np.ndarray  # bucket → weight times log-count ratio
    bias: float

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        doc, bucket = present(data, off, self.keep)
        z = np.bincount(doc, self.weight[bucket], len(off) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _counts(batches):
    for batch in batches:
        y = batch.column(1).to_numpy(zero_copy_only=False)
        for lo, hi, data, off in slices(batch, limit=1 << 20):
            doc, bucket = present(data, off, None)
            one = y[lo:hi][doc] == 1
            u, at = np.unique(bucket, return_inverse=True)
            pos = np.bincount(at[one], minlength=len(u)) if len(u) else np.zeros(0)
            neg = np.bincount(at[~one], minlength=len(u)) if len(u) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(pos, pa.int64()), pa.array(neg, pa.int64())], names=["bucket", "pos", "neg"])


def log_count_ratios(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, alpha: float = 1.0) -> np.ndarray:
    p, q = (pos + alpha) / (n_pos + 2 * alpha), (neg + alpha) / (n_neg + 2 * alpha)
    return np.log(p / q)


def _rows(keep: np.ndarray):
    def run(batches):
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, off in slices(batch):
                doc, bucket = present(data, off, keep)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                got = [bucket[a:b].astype(np.uint32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(y[lo:hi], pa.int32()), pa.array(got, pa.binary())], names=["y", "x"])

    return run


def descend(x: list[np.ndarray], y: np.ndarray, scale: np.ndarray, epochs: int = 30, rate: float = 0.3, decay: float = 1e-4, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights of the scaled features and the intercept: logistic loss, AdaGrad steps over minibatches."""
    w, bias = np.ones(len(scale)) * 0.1, float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    gw, gb = np.full(len(scale), 1e-2), 1e-2
    rng = np.random.default_rng(seed)
    size = np.array([len(i) for i in x])
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(order), 64):
            at = order[lo : lo + 64]
            idx = np.concatenate([x[i] for i in at]).astype(np.int64)
            row = np.repeat(np.arange(len(at)), size[at])
            z = np.bincount(row, (w * scale)[idx], len(at)) + bias
            d = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[at]
            g = np.bincount(idx, d[row] * scale[idx], len(scale)) / len(at) + decay * w
            gw += g * g
            w -= rate * g / np.sqrt(gw)
            gb += d.mean() ** 2
            bias -= rate * d.mean() / np.sqrt(gb)
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, held_out: int = 0, limit: int = TRAIN_DOCS) -> Model:
    """Counts of the sample are summed in Spark (at most 2^20 buckets); its rows come back with kept features only."""
    modest_batches(docs.sparkSession)
    texts = labelled_texts(docs, labels, label, modulus, held_out, limit).select("text", "y")
    n = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = n.get(1, 0), sum(v for k, v in n.items() if k != 1)
    none = np.zeros(1 << BITS, bool)
    if not n_pos or not n_neg:
        return Model(none, np.zeros(1 << BITS), 60.0 if n_pos else -60.0)
    c = texts.mapInArrow(_counts, "bucket long, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # only features that tell the classes apart come to the driver: by the z-score of their two frequencies
    n = float(n_pos + n_neg)
    share = (F.col("pos") + F.col("neg")) / n
    z = F.abs(F.col("pos") / n_pos - F.col("neg") / n_neg) / F.sqrt(share * (1 - share) * (1 / n_pos + 1 / n_neg) + 1e-12)
    c = c.filter("pos + neg >= 4").withColumn("z", z).filter("z >= 4.5").select("bucket", "pos", "neg").toPandas()
    r = log_count_ratios(c["pos"].to_numpy(float), c["neg"].to_numpy(float), n_pos, n_neg)
    scale = np.zeros(1 << BITS)
    scale[c["bucket"].to_numpy(int)] = r
    rows = texts.mapInArrow(_rows(scale != 0), "y int, x binary").toPandas().sort_values(["y", "x"])
    y = (rows["y"].to_numpy() == 1).astype(float)
    place = (np.cumsum(scale != 0) - 1).astype(np.int32)
    x = [place[np.frombuffer(b, np.uint32)] for b in rows["x"]]
    w, bias = descend(x, y, scale[scale != 0]) if (scale != 0).any() else (np.zeros(0), float(np.log(n_pos / n_neg)))
    weight = np.zeros(1 << BITS)
    weight[scale != 0] = w * scale[scale != 0]
    return Model(scale != 0, weight, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row, from whole texts."""
    modest_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((np.flatnonzero(model.keep), model.weight[model.keep], model.bias))

    def run(batches):
        at, values, bias = shared.value
        weight, keep = np.zeros(1 << BITS), np.zeros(1 << BITS, bool)
        weight[at], keep[at] = values, True
        m = Model(keep, weight, bias)
        for batch in batches:
            for lo, hi, data, off in slices(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(m.scores(data, off), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", (crc_mod(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
