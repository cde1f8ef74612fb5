"""Importance resampling against a plain-Python version of the contract and against SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from compare import same

from assay.llm import resampling as R


def plain_features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    grams = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), Counter(zlib.crc32(g.encode()) % 10000 for g in grams)


def plain(docs, target):
    """{row: (n_features, weight, score, rank)}; rows are (doc_id, text)."""
    made = [plain_features(t) for _, t in docs]
    s, t = Counter(), Counter()
    for _, c in made:
        s.update(c)
    for x in target:
        t.update(plain_features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000))))
    out = []
    for (i, _), (n, c) in zip(docs, made, strict=True):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(k * gain(b) for b, k in c.items())
        out.append([i, sum(c.values()), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for rank, r in enumerate(fit[: 5 * len(fit) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


def test_matches_sql(spark, sf, duck):
    same(R.op13(spark, sf), duck.execute(R.OP13_SQL))


def test_edges(spark, edges, no_rows):
    """Nulls, empty and very long texts, repeated rows, a null doc_id, clashing column names, an empty table."""
    rows = [(r["doc_id"], r["text"]) for r in edges.collect()]
    many = [(100 + i, f"Aa{i % 7} b-c {'x ' * (i % 40)} É{i} {i * i}") for i in range(400)] + [(None, "a b c d e " * 9)]
    extra = spark.createDataFrame([(i, t, "r", 1, 2) for i, t in many], "doc_id long, text string, row string, part int, n_words int")
    docs = edges.select("doc_id", "text").unionByName(extra.select("doc_id", "text"))
    target = spark.createDataFrame([("a b x x",), (None,), ("word1 x1 " * 50,)], "text string")
    got = R.resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
    want = plain(rows + many, ["a b x x", None, "word1 x1 " * 50])
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert sum(r[4] is not None for r in want) > 10
    assert R.resample(edges, target).count() == len(rows)
    assert R.resample(no_rows, target).count() == 0
    assert R.resample(edges, target.limit(0)).filter("weight is null").count() == 0


@pytest.mark.parametrize("text", [b"", b"  ", b"a", b"Ab_c 12", "Ä ö,ü \x00 漢字🙂".encode(), b"ab " * 20 + b"x" * 50 + b" c d"])
def test_stretches_change_nothing(monkeypatch, text):
    whole = [b for _, bs in R.features(text) for b in bs.tolist()]
    for size in (1, 2, 7):
        monkeypatch.setattr(R, "STRETCH", size)
        parts = list(R.features(text))
        assert Counter(b for _, bs in parts for b in bs.tolist()) == Counter(whole)
        assert sum(n for n, _ in parts) == len(text.translate(R.TABLE).split())


def test_ranks_are_whole_over_many_ranges(spark):
    rows = spark.createDataFrame([(i, 25, 1, 0, i % 13) for i in range(2000)] + [(5, 25, 1, 0, 5)] * 50, "doc_id long, n_words long, n_features long, weight long, score long")
    got = sorted((r["rank"], r["score"], r["doc_id"]) for r in R.ranked(rows, 1000, 100).collect() if r["rank"])
    want = sorted([(i, i % 13) for i in range(2000)] + [(5, 5)] * 50, key=lambda x: (-x[1], x[0]))[:1000]
    assert got == [(k, s, i) for k, (i, s) in enumerate(want, 1)]
