"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its letter n-grams (two to four
bytes of the lower-cased text with every run of ASCII that is no letter as one
space), hashed to a fixed number of buckets; a linear layer and a softmax
follow.  It is trained by stochastic gradient descent in numpy on whole texts of
a bounded sample of labelled documents and on stretches of them.  As both layers
are linear, prediction adds up one row of bucket scores for each n-gram of the
whole text.

Rejection: one more class of the softmax stands for texts in no learned
language.  It learns from noise made of the sample itself and of other scripts
(``noise``).  Documents kept whole out of the training calibrate: the softmax
temperature, one for each range of text lengths, so that the score is a
calibrated probability of the language, and the thresholds of the other class's
probability beyond which a text is rejected: it has to be the likelier case, and
not more than a share of the clean texts of that length may be lost (``LOST``).  A text's length is its number of different n-grams here,
as a word repeated a hundred times says no more than the word.

Defined results: null, empty and letterless texts are ``und`` with score 0 and
rejected; a rejected text keeps the most likely learned language as its
prediction; rows repeated in the input are repeated in the result; without any
labelled text everything is ``und`` and only texts without letters are rejected.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, modest_batches, slices
from .labelled import crc_mod, stored_sample

#: Documents that are learned from, at most.
TRAIN_DOCS = 1_500
BITS, DIM = 17, 16
#: Share of clean texts of each length that may be rejected, as calibrated.
LOST = 0.003
#: Different 4-byte n-grams of the longest texts of each range but the last.
LENGTHS = (6, 15, 40, 100, 300)
#: Stretches of a document that are learned from, and of one kept out.
STRETCHES = (2, 8)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_LETTER = regex.compile(r"\p{L}")


def folded(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts in lower case with one space before, between and after words; their new offsets."""
    n = len(off) - 1
    at = np.arange(len(data)) + np.repeat(np.arange(n), np.diff(off)) * 2 + 1
    b = np.full(len(data) + 2 * n, 32, np.uint8)
    b[at] = _FOLD[data]
    accent = np.flatnonzero(b[:-1] == 0xC3) + 1  # capital letters with accents of Latin-1
    capital = accent[(b[accent] >= 0x80) & (b[accent] <= 0x9E) & (b[accent] != 0x97)]
    b[capital] += 0x20
    edge = off + 2 * np.arange(n + 1)
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
    keep[edge[:-1]] = True
    return b[keep], np.concatenate([[0], np.cumsum(keep)])[edge]


def buckets(b: np.ndarray) -> list[np.ndarray]:
    """Hashed n-grams (2, 3 and 4 bytes) that start at each byte; the last few are short by 1 to 3."""
    b = b.astype(np.uint32)
    out, code = [], b
    for k in (1, 2, 3):
        code = code[: max(0, len(b) - k)] | (b[k:] << np.uint32(8 * k))
        h = code * np.uint32(2654435761) + np.uint32(k * 40503)
        out.append(((h ^ (h >> np.uint32(15))) * np.uint32(2246822519)) >> np.uint32(32 - BITS))
    return out


def bag(text: str) -> tuple[np.ndarray, int]:
    """All buckets of one text, and how many different ones its longest n-grams have."""
    raw = np.frombuffer(text.encode(), np.uint8)
    every = buckets(folded(raw, np.array([0, len(raw)]))[0])
    return np.concatenate(every), len(np.unique(every[-1]))


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # buckets x (languages, and one for none of them)
    bias: np.ndarray
    temperature: np.ndarray  # by range of lengths
    threshold: np.ndarray  # the same: the largest probability of no language that passes

    def logits(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean bucket scores of each text and its number of different n-grams; n-grams that cross texts are left out."""
        b, off = folded(data, off)
        n = len(off) - 1
        total, distinct = np.zeros((n, len(self.langs) + 1)), np.zeros(n, np.int64)
        every = buckets(b)
        for k, h in enumerate(every, 1):
            some = np.flatnonzero(np.diff(off) > k)
            if not len(some):
                continue
            s = self.scores[h]
            for j in range(1, k + 1):  # n-grams that cross texts
                cross = off[1:] - j
                s[cross[(cross >= 0) & (cross < len(s))]] = 0
            total[some] += np.add.reduceat(s, off[:-1][some], axis=0, dtype=np.float64)
        seen = np.zeros(1 << BITS, bool)
        for i, (lo, hi) in enumerate(zip(off[:-1], off[1:] - 3, strict=True)):
            if hi > lo:
                mine = every[-1][lo:hi]
                seen[mine] = True
                distinct[i] = np.count_nonzero(seen) if hi - lo > 2000 else len(np.unique(mine))
                seen[mine] = False
        grams = sum(np.maximum(0, off[1:] - off[:-1] - k) for k in (1, 2, 3))
        return total / np.maximum(1, grams)[:, None] + self.bias, distinct

    def judge(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, rejected) of each text: the most likely of the learned languages, its calibrated probability, and whether no language is too likely."""
        z, distinct = self.logits(data, off)
        size = np.searchsorted(LENGTHS, distinct)
        p = softmax(z / self.temperature[size][:, None])
        known = p[:, :-1]
        return known.argmax(axis=1), known.max(axis=1), p[:, -1] > self.threshold[size]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


#: First and last letters of some scripts; a noise text in another script draws from one of them.
SCRIPTS = ((0x0391, 0x03C9), (0x0410, 0x044F), (0x0531, 0x0586), (0x05D0, 0x05EA), (0x0621, 0x064A), (0x0905, 0x0939), (0x0E01, 0x0E2E), (0x10D0, 0x10F0), (0x3041, 0x3096), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))


def noise(words: list[str], rng: np.random.Generator) -> str:
    """Letters in no learned language: another script, or Latin words whose letters or syllables do not follow on each other as in ``words``."""
    kind = rng.integers(7)
    n = int(np.exp(rng.uniform(0, 5)))
    if kind == 0:
        lo, hi = SCRIPTS[rng.integers(len(SCRIPTS))]
        gap = " " if lo < 0x3000 and lo != 0x0E01 else ""
        return gap.join("".join(map(chr, np.minimum(hi, lo + rng.exponential((hi - lo) / 4, rng.integers(2, 9)).astype(int)))) for _ in range(n))
    if kind == 1:
        return " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(2, 11)))) for _ in range(n))
    if kind == 2:  # syllables as many languages have them
        syllables = ["".join((rng.choice(list("bcdfghjklmnprstvwz")), rng.choice(list("aeiouy")), rng.choice(["", "", "n", "l", "r", "s", "m", "k", "t"]))) for _ in range(40)]
        return " ".join("".join(rng.choice(syllables, rng.integers(1, 5))) for _ in range(n))
    some = [words[i] for i in rng.integers(0, len(words), n)]
    if kind == 3:
        return " ".join("".join(rng.permutation(list(w))) for w in some)
    if kind == 4:
        return " ".join(w[::-1] for w in some)
    swap = dict(zip("bcdfghjklmnpqrstvwxz", rng.permutation(list("bcdfghjklmnpqrstvwxz")), strict=True)) | dict(zip("aeiouy", rng.permutation(list("aeiouy")), strict=True))
    return " ".join("".join(swap.get(c, c) for c in w.lower()) for w in some)


_EXAMPLES = "lang string, cut boolean, kept_out boolean, buckets binary, shares binary, distinct long"


def _examples(batches):
    """Bags of each whole text (``cut`` false), of stretches of it and of noise texts (null language); a fifth of the texts is kept out."""
    for batch in batches:
        out = []
        for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seed = zlib.crc32(t.encode())
            rng = np.random.default_rng(seed)
            words = t.split()
            if not words or not _LETTER.search(t):
                continue
            texts = [(t, y, False)]
            kept_out = seed % 5 == 0
            for _ in range(STRETCHES[kept_out]):
                n = int(np.exp(rng.uniform(0, 5)))
                at = rng.integers(0, max(1, len(words) - n))
                texts.append((" ".join(words[at : at + n]), y, True))
            texts += [(noise(words, rng), None, True) for _ in range(2)]
            for text, lang, cut in texts:
                if not _LETTER.search(text):
                    continue
                every, distinct = bag(text)
                u, c = np.unique(every, return_counts=True)
                out.append((lang, cut, kept_out, u.astype("<u4").tobytes(), (c / c.sum()).astype("<f4").tobytes(), distinct))
        cols = list(zip(*out, strict=True)) or [()] * 6
        kinds = (pa.string(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["lang", "cut", "kept_out", "buckets", "shares", "distinct"])


def calibrate(model: Model, z: np.ndarray, y: np.ndarray, size: np.ndarray) -> None:
    """Sets the temperature and the threshold of each range of lengths from the logits of texts kept out.

    A range with few texts takes those of the ranges beside it as well."""
    none = len(model.langs)
    grid = np.geomspace(0.2, 20, 60)
    for r in range(len(LENGTHS) + 1):
        some = np.zeros(len(y), bool)
        for wide in range(len(LENGTHS) + 1):
            some = np.abs(size - r) <= wide
            if (some & (y < none)).sum() >= 200:
                break
        if not some.any():
            continue
        loss = [-np.log(softmax(z[some] / t)[np.arange(some.sum()), y[some]] + 1e-12).mean() for t in grid]
        model.temperature[r] = grid[int(np.argmin(loss))]
        clean = softmax(z[some & (y < none)] / model.temperature[r])[:, -1]
        if len(clean):
            model.threshold[r] = max(0.5, np.quantile(clean, 1 - LOST))


def train(examples: list[tuple], epochs: int = 3, rate: float = 0.5, seed: int = 1) -> Model:
    """Stochastic gradient descent over single examples' bags in minibatches, then calibration on the documents kept out.

    ``examples`` are (language or None, is a stretch, is kept out, buckets, their shares of the n-grams, different ones of the longest)."""
    names = sorted({x[0] for x in examples if x[0] is not None})
    place = {x: i for i, x in enumerate(names)} | {None: len(names)}
    y = np.array([place[x[0]] for x in examples])
    kept_out = np.array([x[2] for x in examples])
    if not (~kept_out & (y < len(names))).any():  # too few documents to keep some out
        kept_out[:] = False
    rng = np.random.default_rng(seed)
    e = np.zeros((1 << BITS, DIM), np.float32)  # what is never seen says nothing
    w, bias = rng.normal(0, DIM**-0.5, (DIM, len(names) + 1)).astype(np.float32), np.zeros(len(names) + 1, np.float32)
    fit = np.flatnonzero(~kept_out)
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs)
        order = rng.permutation(fit)
        for lo in range(0, len(order), 32):
            at = order[lo : lo + 32]
            n = np.array([len(examples[i][3]) for i in at])
            idx = np.concatenate([examples[i][3] for i in at])
            share = np.concatenate([examples[i][4] for i in at])[:, None]
            start = np.concatenate([[0], np.cumsum(n)[:-1]])
            x = np.add.reduceat(e[idx] * share, start, axis=0)
            p = softmax(x @ w + bias)
            p[np.arange(len(at)), y[at]] -= 1
            back = p @ w.T
            w -= lr * 0.1 * (x.T @ p).astype(np.float32)
            bias -= lr * 0.01 * p.sum(axis=0).astype(np.float32)
            for i, g in zip(at, back, strict=True):  # an example has each of its buckets once
                e[examples[i][3]] -= (lr * 20) * np.outer(examples[i][4], g).astype(np.float32)
    model = Model(names, (e @ w).astype(np.float32), bias.astype(np.float64), np.ones(len(LENGTHS) + 1), np.ones(len(LENGTHS) + 1))
    check = np.flatnonzero(kept_out if kept_out.any() else ~kept_out)
    z = np.stack([(model.scores[examples[i][3]] * examples[i][4][:, None]).sum(axis=0, dtype=np.float64) for i in check]) + bias
    calibrate(model, z, y[check], np.searchsorted(LENGTHS, [examples[i][5] for i in check]))
    return model


_MODEL = "langs array<string>, scores binary, bias binary, temperature binary, threshold binary"


def _trained(batches):
    """All examples → one row, the model; no row without an example of a language."""
    rows = [r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
    rows.sort(key=lambda r: (r[0] or "", r[1:]))
    if not any(r[0] is not None for r in rows):
        return
    m = train([(a, b, c, np.frombuffer(u, "<u4"), np.frombuffer(s, "<f4"), n) for a, b, c, u, s, n in rows])
    arrays = [pa.array([x.tobytes()], pa.binary()) for x in (m.scores, m.bias, m.temperature, m.threshold)]
    yield pa.RecordBatch.from_arrays([pa.array([m.langs], pa.list_(pa.string())), *arrays], names=["langs", "scores", "bias", "temperature", "threshold"])


def fit(docs: DataFrame, modulus: int = 4, held_out: int = 2, limit: int = TRAIN_DOCS) -> Model | None:
    """A model from a bounded sample of the labelled documents that may be learned from; None without any.

    Bags of the sample's whole texts, of stretches of them and of noise are made in
    tasks and stored; one task learns from them, as their number is bounded by
    ``limit`` whatever the input, and only the model comes to the driver."""
    modest_batches(docs.sparkSession)
    able = docs.filter(F.col("lang").isNotNull() & (crc_mod(modulus) != held_out))
    sample = stored_sample(able.select("doc_id", "text", "lang"), limit, "sample-lang")
    made = materialize(sample.filter("text is not null").select("text", "lang").mapInArrow(_examples, _EXAMPLES), "examples")
    got = made.coalesce(1).mapInArrow(_trained, _MODEL).first()
    if got is None:
        return None
    scores, bias = np.frombuffer(got["scores"], np.float32), np.frombuffer(got["bias"], np.float64)
    # calibration writes to the ranges of a model, so these are copies
    return Model(list(got["langs"]), scores.reshape(1 << BITS, len(bias)), bias, np.array(np.frombuffer(got["temperature"])), np.array(np.frombuffer(got["threshold"])))


def judged(model: Model | None, texts: pa.Array, data: np.ndarray, off: np.ndarray) -> tuple[list[str], list[float], list[bool]]:
    """(language, score, rejected) of each text."""
    some = [bool(t) and _LETTER.search(t) is not None for t in texts.to_pylist()]
    if model is None:
        return ["und"] * len(some), [0.0] * len(some), [not ok for ok in some]
    at, p, out = model.judge(data, off)
    lang = [model.langs[b] if ok else "und" for b, ok in zip(at, some, strict=True)]
    score = [float(x) if ok else 0.0 for x, ok in zip(p, some, strict=True)]
    return lang, score, [bool(x) or not ok for x, ok in zip(out, some, strict=True)]


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row, from whole texts; other columns are not read."""
    modest_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for lo, hi, data, off in slices(batch, limit=1 << 20):
                lang, score, bad = judged(shared.value, batch.column(1).slice(lo, hi - lo), data, off)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bad, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns."""
    modest_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            for lo, hi, data, off in slices(batch, limit=1 << 20):
                bad = judged(shared.value, texts.slice(lo, hi - lo), data, off)[2]
                yield batch.slice(lo, hi - lo).filter(pa.array([not x for x in bad], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, fit(docs))
    return out.select("doc_id", (crc_mod(4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
