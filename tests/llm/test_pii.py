"""Personal data: base spans against plain ``re``, discovery against a plain-Python version of the scoring."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from assay.llm import pii as P


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def plain_base(text):
    n = lambda m: re.sub(r"[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(n(m)) <= 19 and luhn(n(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(n(m)) <= 15),
    ]
    found = [(m.start(), i, m.end(), kind) for i, (kind, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m[0])]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def plain(texts, rounds=P.ROUNDS, trust=P.TRUST):
    """[(base spans, all spans)] of each text, by the definitions in the module's docstring."""
    digits = lambda m: re.sub(r"[^0-9]", "", m)
    at = []  # (text, start, end, kinds, identifiers, patterns, base)
    bases = []
    for t, text in enumerate(texts):
        base = [s.split(":") for s in plain_base(text)]
        bases.append([(int(a), P.KINDS.index(k), int(b)) for k, a, b in base])
        for a, k, b in bases[-1]:
            at.append((t, a, b, [k], text[a:b], True))
        for k, p in enumerate(P.PATTERNS[4:], 4):
            for m in re.finditer(p, text):
                n = len(digits(m[0]))
                kinds = {4: [0], 5: [1]}.get(k, [x for x, lo, hi in ((2, 14, 19), (3, 7, 15)) if lo <= n <= hi])
                if kinds and (k < 6 or n <= 19) and not any(a < m.end() and m.start() < b for a, _, b in bases[-1]):
                    at.append((t, m.start(), m.end(), kinds, m[0], False))

    def around(t, a, b, pieces):
        before, after = pieces
        norm = lambda s: re.sub("[0-9]+", "0", s.lower()).split()
        left, right = norm(before[-P.CONTEXT :]), norm(after[: P.CONTEXT])
        one, two, r = (left[-1:] or [None])[0], (left[-2:-1] or [None])[0], (right[:1] or [None])[0]
        has = lambda *ws: any(w and re.search(r"[^\W\d_]", w) for w in ws)
        if one and has(one):
            yield f"1 {one}"
        if one and two and has(one, two):
            yield f"2 {two} {one}"
        if one and r and has(one, r):
            yield f"3 {one} _ {r}"

    edges = {}
    for t, a, b, kinds, m, base in at:
        # the text up to the match of the same pattern before and from there to the next one
        which = kinds[0] if base else 4 if kinds == [0] else 5 if kinds == [1] else 6
        found = [x.span() for x in re.finditer(P.PATTERNS[which].replace(r"\G|", ""), texts[t])]
        lo = max([y for _, y in found if y <= a], default=0)
        hi = min([x for x, _ in found if x >= b], default=len(texts[t]))
        for k in kinds:
            ident = digits(m) if k in (2, 3) else m.lower()
            for p in around(t, a, b, (texts[t][lo:a], texts[t][b:hi])):
                edges[k, p, ident] = edges.get((k, p, ident), False) or base
    worth, found = {e: 1000 * s for e, s in edges.items()}, {}
    for _ in range(rounds):
        groups = {}
        for (k, p, _), s in edges.items():
            groups.setdefault((k, p), []).append(s)
        score = {g: sum(worth[e] for e in edges if e[:2] == g) // (len(s) + 1) for g, s in groups.items() if sum(s) >= P.LEAST_SEEDS}
        found = {}
        for (k, p, i), s in edges.items():
            if not s and score.get((k, p), 0) >= trust:
                found[k, i] = max(found.get((k, i), 0), score[k, p])
        worth = {e: 1000 if s else found.get((e[0], e[2]), 0) for e, s in edges.items()}
    out = [(list(b), list(b)) for b in bases]
    for t, a, b, kinds, m, base in at:
        if not base:
            best = [(-found[k, i], k) for k in kinds if (k, i := digits(m) if k in (2, 3) else m.lower()) in found]
            if best:
                out[t][1].append((a, min(best)[1], b))
    text = lambda spans: ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return [(text(b), text(s)) for b, s in out]


def got_of(spark, texts, **how):
    docs = spark.createDataFrame([(i, t, "r", 1) for i, t in enumerate(texts)], "doc_id long, text string, row string, kind int").repartition(3)
    rows = P.personal_data(docs, **how).select("doc_id", P.span_text(F.col("base_spans")), P.span_text(F.col("spans"))).collect()
    return [(r[1], r[2]) for r in sorted(rows)]


def numbers(rng, n):
    return "".join(rng.choice("0123456789") for _ in range(n))


@pytest.fixture(scope="module")
def mails():
    rng = random.Random(9)
    ok = []
    while len(ok) < 30:
        d = numbers(rng, 16)
        ok += [d] if luhn(d) else []
    texts = [f"Ünï please call me at +1 ({numbers(rng, 3)}) 555-{numbers(rng, 4)} before noon" for _ in range(30)]
    texts += [f"write to us via user{i}@mail{i % 3}.example.org thanks" for i in range(30)]
    texts += [f"the card number {d} expires" for d in ok] + [f"login from host 10.{i}.0.{i * 7} ok" for i in range(30)]
    # without prefix, written out, version 6, with a wrong check digit: only their surroundings tell
    texts += ["please call me at (415) 555-0199 before noon", "write to us via jane [at] corp [dot] com thanks", "login from host fe80::1:2ab ok", "the card number 1234 5678 9012 3456 expires"]
    # the same identifiers in other places, one of them in a place that now leads on
    texts += ["ring 415-555-0199 now", "x 1234567890123456 y", "order 5550001111222233 of 2024-01-02 12:30", "nothing here at example.com, 7 of 9"]
    return texts


def test_discovers_by_surroundings(spark, mails):
    got, want = got_of(spark, mails), plain(mails)
    assert got == want
    added = [sorted(set(s.split(",")) - set(b.split(",")) - {""}) for b, s in got]
    assert added[120:126] == [["phone:18:32"], ["email:16:40"], ["ip:16:27"], ["card:16:35"], ["phone:5:17"], ["card:2:18"]]
    assert not any(added[:120]) and not any(added[126:])


def test_random_texts(spark):
    rng = random.Random(3)
    atoms = ["a@b.c", "x_y@q-r.st.uv", "a@b", "@", "1.2.3.4", "256.1.1.1", "1.2.3", ".", "4539 1488 0343 6467", "4539148803436467", "-", " ", "+1 (168) 555-5254", "+12", "7", "00", "call ", "é", "_d@e.f", "+", "(", "🙂 ", "2001:db8::1", "me at x.org"]
    texts = ["".join(rng.choice(atoms) + rng.choice(["", " ", ""]) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    assert [b for b, _ in got_of(spark, texts)] == [",".join(plain_base(t)) for t in texts]


def test_base_digest_matches_plain(spark, sf):
    rows = {r["doc_id"]: r for r in P.op12(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for i, text in docs:
        base = plain_base(text or "")
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(rows[i]["spans"].split(",")) | {""}
        assert [rows[i][f"n_{k}"] for k in P.KINDS] == [sum(s.startswith(k) for s in base) for k in P.KINDS]


def test_edges(spark, edges, no_rows):
    got = P.personal_data(edges)
    assert got.count() == edges.count() and got.filter("size(spans) > 0").count() == 0
    assert P.personal_data(no_rows).count() == 0
    unknown = edges.select(F.lit(None).cast("long").alias("doc_id"), F.lit("x@y.zz").alias("text"))
    assert P.personal_data(unknown).filter("n_email = 1").count() == edges.count()


def test_long_runs_take_linear_time(spark):
    n = 300_000
    texts = ["a" * n, "a." * n, "1" * n, "1 " * n, "1." * n, "a@b" + ".c" * n, "+" * n, "+1" + "(" * n, "a@" * n, "1:" * n, "x at " * n, "1-2" * n]
    got = got_of(spark, texts)
    assert got[4][0].count("ip:") == n // 4
    assert [b for b, _ in got[:4] + got[5:]] == [*[""] * 4, f"email:0:{3 + 2 * n}", *[""] * 6]
