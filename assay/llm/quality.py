"""Quality: histogram gradient-boosted trees over document statistics.

Statistics of the whole text (lengths, character classes, repeats of words,
word pairs and lines) are computed in numpy over slices of many texts.  Trees
are grown level by level on binned statistics of a bounded sample of labelled
texts, with logistic loss, and flattened into arrays: prediction moves an array
of node numbers down all trees at once.

Defined results: null and empty texts have all statistics 0 and get a score like
any other; repeated rows are repeated; without labels of both classes every
score is the share of label 1 (0 if there is none).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_VALUE, LOWER_VALUE, modest_batches, prefix_hash, range_hash, slices, words_of
from .labelled import crc_mod, labelled_texts

#: Labelled documents that are learned from, at most.
TRAIN_DOCS = 12_000
BINS, TREES, DEPTH, RATE = 64, 60, 4, 0.2

_KINDS = ["lower", "upper", "digit", "space", "line", "stop", "comma", "bang", "bar", "mark", "bracket", "wide", "other"]
_KIND = np.full(256, _KINDS.index("other"), np.uint8)
for _name, _bytes in {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": b" \t", "line": b"\n\r\x0b\x0c", "stop": b".?",
    "comma": b",;:'\"-", "bang": b"!", "bar": b"|", "mark": b"#$%&*+=@^_~\\/", "bracket": b"()[]{}<>", "wide": range(128, 256),
}.items():
    _KIND[list(_bytes)] = _KINDS.index(_name)
STATISTICS = [
    "log_bytes", "log_words", *[f"share_{k}" for k in _KINDS], "word_length", "word_spread", "short_words", "long_words", "distinct_words",
    "top_word", "word_repeats", "distinct_pairs", "words_a_line", "distinct_lines", "short_lines", "stops_a_word", "capitals_a_word", "marks_a_word",
]


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text."""
    n = len(off) - 1
    size = np.diff(off)
    doc = np.repeat(np.arange(n), size)
    kind = np.bincount(doc * len(_KINDS) + _KIND[data], minlength=n * len(_KINDS)).reshape(n, -1) if len(data) else np.zeros((n, len(_KINDS)))
    share = kind / np.maximum(size, 1)[:, None]
    starts, ends, first = words_of(data, off)
    words = np.diff(first)
    some = np.maximum(words, 1)
    length = (ends - starts).astype(float)
    wdoc = np.repeat(np.arange(n), words)
    mean = np.bincount(wdoc, length, n) / some
    spread = np.sqrt(np.maximum(0, np.bincount(wdoc, length**2, n) / some - mean**2))
    short, long_ = np.bincount(wdoc, length <= 3, n) / some, np.bincount(wdoc, length >= 14, n) / some
    distinct, top, again, pairs = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    line_words, line_distinct, line_short = np.zeros(n), np.zeros(n), np.zeros(n)
    if len(starts):
        w = range_hash(prefix_hash(LOWER_VALUE[data]), starts, ends)
        pair = w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:]
        same = np.concatenate([[0], np.cumsum(w[1:] == w[:-1])])
        breaks = np.concatenate([[0], np.flatnonzero((data == 10)) + 1, off])
        breaks = np.unique(breaks[breaks <= len(data)])
        lines = range_hash(prefix_hash(BYTE_VALUE[data]), breaks[:-1], breaks[1:])
        line_length = np.diff(breaks)
        line_first = np.searchsorted(breaks, off)
        for i in range(n):
            a, b = first[i], first[i + 1]
            if a == b:
                continue
            _, c = np.unique(w[a:b], return_counts=True)
            distinct[i], top[i] = len(c) / (b - a), c.max() / (b - a)
            if b - a > 1:
                again[i] = (same[b - 1] - same[a]) / (b - a - 1)
                pairs[i] = len(np.unique(pair[a : b - 1])) / (b - a - 1)
            x, y = line_first[i], line_first[i + 1]
            line_words[i] = (b - a) / max(1, y - x)
            line_distinct[i] = len(np.unique(lines[x:y])) / max(1, y - x)
            line_short[i] = (line_length[x:y] < 30).mean() if y > x else 0
    each = lambda name: kind[:, _KINDS.index(name)] / some
    return np.column_stack([
        np.log1p(size), np.log1p(words), share, mean, spread, short, long_, distinct, top, again, pairs,
        np.log1p(line_words), line_distinct, line_short, each("stop"), each("upper"), each("mark"),
    ])


@dataclass
class Trees:
    """All trees in one set of arrays; a leaf's children are itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    root: np.ndarray
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.root, (len(x), len(self.root))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            go = x[row, self.feature[node]] <= self.threshold[node]
            node = np.where(go, self.left[node], self.right[node])
        z = self.base + self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE, least: int = 10, ridge: float = 1.0) -> Trees:
    """Second-order boosting with logistic loss; splits are searched in histograms of bins."""
    n, m = x.shape
    mean = float(np.clip(y.mean() if n else 0, 1e-4, 1 - 1e-4))
    base = float(np.log(mean / (1 - mean)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)] if n else []
    flat: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}

    def node(value: float) -> int:
        i = len(flat["value"])
        for k, v in (("feature", 0), ("threshold", 0.0), ("left", i), ("right", i), ("value", value)):
            flat[k].append(v)
        return i

    roots = []
    if n and 0 < y.sum() < n:
        bins = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
        code = bins + np.arange(m) * BINS
        z = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            at = np.full(n, node(0.0))
            roots.append(int(at[0]))
            level = [int(at[0])]
            for depth in range(DEPTH + 1):
                nxt = []
                for i in level:
                    rows = np.flatnonzero(at == i)
                    gs, hs = g[rows].sum(), h[rows].sum()
                    flat["value"][i] = float(rate * gs / (hs + ridge))
                    if depth == DEPTH or len(rows) < 2 * least:
                        continue
                    c = code[rows].ravel()
                    hist = [np.bincount(c, np.repeat(v, m), m * BINS).reshape(m, BINS).cumsum(axis=1) for v in (g[rows], h[rows], np.ones(len(rows)))]
                    gl, hl, nl = hist
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    gain[(nl < least) | (len(rows) - nl < least)] = -1
                    j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[j, b] <= 1e-6 or b >= len(edges[j]):
                        continue
                    flat["feature"][i], flat["threshold"][i] = int(j), float(edges[j][b])
                    flat["left"][i], flat["right"][i] = node(0.0), node(0.0)
                    at[rows] = np.where(bins[rows, j] <= b, flat["left"][i], flat["right"][i])
                    nxt += [flat["left"][i], flat["right"][i]]
                level = nxt
            z += np.array(flat["value"])[at]
    elif n:
        base = 60.0 if y.sum() else -60.0
    else:
        base = -60.0
    return Trees(*(np.array(flat[k]) if flat[k] else np.zeros(0, int) for k in ("feature", "threshold", "left", "right", "value")), np.array(roots, int), base)


def _features(batches):
    for batch in batches:
        y = batch.column(batch.schema.get_field_index("y"))
        for lo, hi, data, off in slices(batch):
            x = statistics(data, off)
            yield pa.RecordBatch.from_arrays([y.slice(lo, hi - lo), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, held_out: int = 1, limit: int = TRAIN_DOCS) -> Trees:
    """Trees from a bounded sample of the labelled texts; only their statistics come to the driver."""
    rows = labelled_texts(docs, labels, label, modulus, held_out, limit).select("text", "y")
    got = rows.mapInArrow(_features, "y int, x array<double>").toPandas()
    x = np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, len(STATISTICS)))
    y = got["y"].to_numpy()
    order = np.lexsort((*x.T[::-1], y))
    return grow(x[order], (y[order] == 1).astype(float))


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """(doc_id, score) of every row, from whole texts."""
    modest_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        m = shared.value
        for batch in batches:
            for lo, hi, data, off in slices(batch):
                s = m.scores(statistics(data, off))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", (crc_mod(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
