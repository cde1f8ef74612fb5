import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from compare import same
from pyspark.sql import functions as F

from assay.llm import exact_dedup, mixing, ngram_join, substring_dedup
from assay.llm.common import connected_components, shingle_sets
from assay.llm.exact_dedup import cut_points, normalise
from assay.llm.suffix_array import permuted_lcp, suffix_array


def texts(df):
    return [(r["doc_id"], (r["text"] or "").encode()) for r in df.select("doc_id", "text").collect()]


def shingles(text):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in text).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    label = {i: i for i in range(len(sets))}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    links = Counter()
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                links[i] += 1
                links[j] += 1
                label[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        low[root(i)] = min(d, low.get(root(i), d))
    return sorted((d, len(s), low[root(i)], links[i]) for i, (d, s) in enumerate(sets))


def near_copies(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.choice([6, 40, 90]))] for _ in range(12)]
    rows = []
    for i in range(150):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(words).upper()
        rows.append((i, " ".join(t)))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("how", [{}, {"tile": 4, "part_grams": 2000}])
def test_ngram_join_brute_force(spark, edges, how):
    for df in (near_copies(spark), edges):
        got = sorted(tuple(r) for r in ngram_join.ngram_components(df, **how).collect())
        assert got == brute_components(texts(df))


def test_ngram_join_hot_grams(spark, monkeypatch):
    df = near_copies(spark)
    every = np.concatenate([shingle_sets(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for _, t in texts(df)])
    g, c = np.unique(every, return_counts=True)
    monkeypatch.setattr(ngram_join, "hot_grams", lambda *a, **k: g[c > 5])
    assert sorted(tuple(r) for r in ngram_join.ngram_components(df, tile=8).collect()) == brute_components(texts(df))


def test_ngram_join_deals_twice(spark, monkeypatch):
    """More parts than a slice is dealt to: the second step gives the same rows, with and without hot n-grams."""
    df = near_copies(spark)
    want = brute_components(texts(df))
    monkeypatch.setattr(ngram_join, "COARSE", 3)
    monkeypatch.setattr(ngram_join, "DEAL_GRAMS", 500)
    assert sorted(tuple(r) for r in ngram_join.ngram_components(df, part_grams=200).collect()) == want
    every = np.concatenate([shingle_sets(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for _, t in texts(df)])
    g, c = np.unique(every, return_counts=True)
    monkeypatch.setattr(ngram_join, "hot_grams", lambda *a, **k: g[c > 5])
    assert sorted(tuple(r) for r in ngram_join.ngram_components(df, part_grams=200).collect()) == want


def test_blocks_of_a_slice_do_not_grow_with_the_parts():
    rng = random.Random(4)
    words = [[f"w{rng.randrange(10**6)}" for _ in range(2_000)] for _ in range(60)]
    batch = pa.RecordBatch.from_pydict({"text": [" ".join(w) for w in words]})
    none = np.zeros(0, np.uint64)
    few, many = (list(ngram_join._deal(parts, 5, none, frozenset(), ngram_join.COARSE)(iter([batch]))) for parts in (ngram_join.COARSE, 1_000_000))
    assert sum(b.num_rows for b in many) <= ngram_join.COARSE
    assert sum(b.nbytes for b in many) < 1.1 * sum(b.nbytes for b in few)
    again = list(ngram_join._deal_again(1_000_000, 1 << 20)(iter(many)))
    parts = [p for b in again for p in b.column(0).to_pylist()]
    grams = [len(x) // 2 for b in again for x in b.column(1).to_pylist()]
    assert sum(grams) == 60 * 1_996 and len(set(parts)) > 100_000


@pytest.mark.parametrize("module,name", [(ngram_join, "op1"), (mixing, "op3"), (substring_dedup, "op4"), (exact_dedup, "op5")])
def test_against_sql(spark, sf, duck, module, name):
    same(getattr(module, name)(spark, sf), duck.execute(getattr(module, name.upper() + "_SQL")))


def test_overlaps_of_very_long_texts_are_exact():
    """Just below and at the bound with two million shared n-grams, where single precision could not tell."""
    shared = np.arange(1_864_136, dtype=np.uint64)
    for extra in (466_033, 466_034, 466_035):
        g = [shared, np.concatenate([shared, np.arange(1 << 40, (1 << 40) + extra, dtype=np.uint64)])]
        got = ngram_join.block_links(np.array([len(x) for x in g]), np.zeros(2), g, columns=1 << 20)
        assert bool(got[0, 1]) == (100 * len(shared) >= 80 * (len(shared) + extra))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1080)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    while True:
        new = dict(label)
        for a, b in edges:
            if a != b:
                new[a] = new[b] = min(new[a], new[b])
        if new == label:
            break
        label = new
    assert got == label
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_groups(edges, no_rows):
    got = sorted(tuple(r) for r in exact_dedup.exact_groups(edges).collect())
    by = {}
    for d, t in texts(edges):
        by.setdefault(normalise(t), []).append(d)
    want = {(d, min(v), len(v), hashlib.sha256(t).hexdigest()) for t, v in by.items() for d in v}
    assert {(r[0], r[1], r[2], r[4]) for r in got} == want and len(got) == edges.count()
    assert sum(r[3] for r in got) == len(by)
    assert exact_dedup.exact_groups(no_rows).count() == 0


def test_clashing_chunks_are_told_apart(spark, monkeypatch):
    """Chunks of which all have one hash, in the workers too: the function that cuts travels with the task as it stands here."""
    real = exact_dedup._chunks_of

    def clashing(text, *how):
        for _, chunk in real(text, *how):
            yield bytes(16), chunk

    found = []
    hashes = exact_dedup.clashing_hashes
    monkeypatch.setattr(exact_dedup, "clashing_hashes", lambda chunks: found.append(hashes(chunks)) or found[-1])
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "b  c"), (5, "b c"), (6, "x" * 30_000), (7, "x" * 30_000), (8, "x" * 29_999)], "doc_id long, text string")
    monkeypatch.setattr(exact_dedup, "_chunks_of", clashing)
    got = exact_dedup.exact_groups(df).select("doc_id", "keep_id").collect()
    assert dict(got) == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8}
    assert [bytes(r["h"]) for r in found[0].collect()] == [bytes(16)]


def test_rows_that_stay_keep_their_columns(spark):
    rows = [(1, "a b", "p"), (1, "a  b", "q"), (2, "a b", "r"), (None, "c", "s"), (3, "c", "t"), (4, "", "u"), (5, None, "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __row string").withColumns({"__recipe": F.lit(1), "__KEEP": F.lit(2), "__times": F.lit(3), "__id": F.lit(4)})
    for op, want in ((exact_dedup.without_copies, [{1}, {None}, {4}]), (mixing.mixed, None)):
        got = op(df.withColumn("source", F.lit("s")))
        assert got.columns == [*df.columns, "source"]
        if want:
            assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(str(x) for w in want for x in w)


def test_chunks_are_cut_by_content():
    rng = np.random.default_rng(3)
    body = rng.integers(97, 123, 60_000).astype(np.uint8)
    a, b = cut_points(body, 512, 2048, 8192), cut_points(np.concatenate([rng.integers(97, 123, 777).astype(np.uint8), body]), 512, 2048, 8192)
    assert len({x + 777 for x in a} & set(b)) > len(a) * 0.8
    assert max(np.diff([0, *a])) <= 8192 and cut_points(body[:0], 512, 2048, 8192) == []


def brute_strip(rows, w=200):
    n = Counter(t[i : i + w] for _, t in rows for i in range(len(t) - w + 1))
    out = []
    for d, t in rows:
        cover = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - w + 1):
            if n[t[i : i + w]] > 1:
                cover[i] += 1
                cover[i + w] -= 1
        gone = np.cumsum(cover)[: len(t)] > 0
        rest = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((d, len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return sorted(out)


def passages(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(6))
    shared = [" ".join(word() for _ in range(n)) for n in (20, 29, 30, 40, 80)]
    rows = [(i, " ".join([word() for _ in range(20)] + rng.sample(shared, 2) + [word() for _ in range(25)] + rng.sample(shared, 1))) for i in range(60)]
    rows += [(100, "a" * 700), (101, "ab" * 300), (102, "xyz " * 60), (102, "xyz " * 60), (103, "q" * 199), (104, None), (105, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("how", [{}, {"part_bytes": 8_000, "shard_bytes": 10_000}])
def test_strip_repeats_brute_force(spark, edges, no_rows, how):
    for df in (passages(spark), edges.filter("doc_id < 8 or doc_id > 9")):
        assert sorted(tuple(r) for r in substring_dedup.strip_repeats(df, **how).drop("kept").collect()) == brute_strip(texts(df))
    assert substring_dedup.strip_repeats(no_rows).count() == 0
    big = {r["doc_id"]: r for r in substring_dedup.strip_repeats(edges.filter("doc_id in (8, 9)")).collect()}
    assert big[8]["n_removed"] == big[8]["n_bytes"] and big[9]["n_bytes"] - big[9]["n_removed"] == 4


def test_strip_repeats_hot_minimizers(spark, monkeypatch):
    df = passages(spark)
    rows = texts(df)
    every = np.concatenate([substring_dedup.segments(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 200)[4] for _, t in rows])
    monkeypatch.setattr(substring_dedup, "hot_minimizers", lambda *a, **k: np.unique(every)[::2])
    assert sorted(tuple(r) for r in substring_dedup.strip_repeats(df, part_bytes=8_000).drop("kept").collect()) == brute_strip(rows)


def test_suffix_array_recursion(monkeypatch):
    """Scans suffix by suffix give what scans by buckets give, on every level."""
    for buckets in (1, 3, 60):
        monkeypatch.setattr("assay.llm.suffix_array.BUCKETS", buckets)
        test_suffix_array()
    text = (" ".join(f"{i % 37} {i * i % 91} word" for i in range(1500))).encode()
    assert suffix_array(np.frombuffer(text, np.uint8)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_array():
    rng = np.random.default_rng(0)
    for turn in range(300):
        t = rng.integers(97, 97 + rng.integers(1, 5), rng.integers(1, 120)).astype(np.uint8)
        if turn % 3 == 0:
            t = np.tile(t[: max(1, len(t) // 4)], 4)
        b = t.tobytes()
        sa = suffix_array(t)
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        lcp, before = permuted_lcp(t, sa)
        for i in range(len(b)):
            x, y = b[i:], b[before[i] :] if before[i] >= 0 else b""
            m = next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
            assert lcp[i] == m


def test_mixing(edges, no_rows):
    rows = [r.asDict() for r in mixing.taken_words(edges).collect()]
    assert len(rows) == edges.count()
    by = {}
    for r, (d, t) in zip(sorted(rows, key=lambda r: r["doc_id"]), sorted(texts(edges)), strict=True):
        assert r["size"] == len(t.split()) and 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    for (size, target), taken in by.items():
        assert target <= 3 * size and abs(sum(taken) - target) <= mixing.PACKET
    assert abs(sum(t for _, t in by) - sum(r["size"] for r in rows)) < 1e-6
    assert sorted(map(str, mixing.taken_words(edges).collect())) == sorted(map(str, mixing.taken_words(edges).collect()))
    assert mixing.taken_words(no_rows).count() == 0
    placed, mix = mixing.mix_sources(edges, share=0.25)
    total = sum(r["size"] for r in rows)
    assert mix.agg({"taken": "sum"}).first()[0] == int(total * 0.25)


def test_the_cut_decides_the_mix(spark):
    """Plain fair queueing: copies by virtual finish time until the budget is used up; the cut falls inside a copy or packet and the queue goes on behind it."""
    rng = random.Random(12)
    rows = [(i, " ".join(["w"] * rng.choice([1, 30, 200, 700])), f"s{rng.choice([0, 0, 0, 1, 1, 2, 3, 4])}") for i in range(120)] + [(500, " ".join(["w"] * 9000), "s5")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    placed, mix = mixing.mix_sources(df)
    places = placed.collect()
    queue = []
    for r in places:
        for turn in range(3):
            start = r["before"] + turn * r["source_size"]
            step = 64 if start < r["target"] < start + r["size"] else r["size"]
            for j, lo in enumerate(range(0, r["size"], step)):
                n = min(step, r["size"] - lo)
                queue.append(((start + lo + n) / r["target"], r["source_key"], turn, r["k"], j, r["doc_id"], n))
    left, want = sum(r["size"] for r in places), Counter()
    beyond = 0
    for *_, doc, n in sorted(queue):
        want[doc] += min(n, left)
        beyond += n > left
        left -= min(n, left)
    got = Counter()
    for r in mix.collect():
        got[r["doc_id"]] += r["taken"]
    assert got == Counter({d: n for d, n in want.items() if n}) and left == 0 and beyond > 10
    by = {}
    for r in places:
        by.setdefault((r["source_key"], r["target"]), []).append(got[r["doc_id"]])
    assert all(abs(sum(v) - t) <= mixing.PACKET for (_, t), v in by.items())


def test_strip_repeats_hot_keys(spark, monkeypatch):
    """One passage in contexts of their own: its pieces do not collect under one key."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh ") for _ in range(6))
    passage = [" ".join(word() for _ in range(60)), " ".join(word() for _ in range(25))]
    rows = [(i, " ".join([word() for _ in range(30)] + [passage[i % 4 == 0]] + [word() for _ in range(30)])) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sort_shard = substring_dedup._sort_shard

    def watched(dests, width):
        real = sort_shard(dests, width)

        def run(table):
            keys = np.concatenate([np.frombuffer(b, np.uint64) for b in table.column("key").to_pylist()])
            assert np.unique(keys, return_counts=True)[1].max() <= 12
            return real(table)

        return run

    monkeypatch.setattr(substring_dedup, "_sort_shard", watched)
    got = sorted(tuple(r) for r in substring_dedup.strip_repeats(df, part_bytes=8_000, shard_bytes=10_000).drop("kept").collect())
    assert got == brute_strip(texts(df))


def test_null_ids(spark):
    """Rows without a doc_id stay, link and repeat like others; large ids beside them keep all their digits."""
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    base, alone, pair, shared = text(100).split(), text(50), text(60), text(40)
    chain = [" ".join(base[:i] + ["other"] + base[i + 1 :]) for i in (4, 96)]  # each links with base
    ends = [" ".join(["x", "y", *base[5:]]), " ".join(base[:88])]
    rows = [(None, alone), (None, pair), (None, pair), (None, " ".join(base)), ((1 << 60) + 1, chain[0]), (7, chain[1]), (None, ends[0]), (9, ends[1])]
    rows += [(None, f"{text(30)} {shared} {text(30)}"), ((1 << 60) + 3, f"{text(30)} {shared} {text(30)}")]
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, source string").coalesce(1)
    # each row as a number; with ids, numbers sort as ids do and rows without one come last
    ids = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    want = brute_components([(n, rows[i][1].encode()) for n, i in enumerate(ids)])
    back = lambda n: rows[ids[n]][0]
    order = lambda r: tuple((x is None, x or 0) for x in r)
    got = [tuple(r) for r in ngram_join.ngram_components(df).collect()]
    assert sorted(got, key=order) == sorted([(back(d), n, back(c), m) for d, n, c, m in want], key=order)
    stay = sorted((r["doc_id"] or 0, r["text"]) for r in ngram_join.one_of_each(df).collect())
    assert stay == sorted((back(d) or 0, rows[ids[d]][1]) for d, _, c, _ in want if d == c)
    got = [tuple(r) for r in substring_dedup.strip_repeats(df).drop("kept").collect()]
    assert sorted(got, key=lambda r: (r[0] or 0, r[4])) == sorted([(d or None, *r) for d, *r in brute_strip([(d or 0, t.encode()) for d, t in rows])], key=lambda r: (r[0] or 0, r[4]))
    assert len(mixing.taken_words(df).collect()) == len(rows)
    assert {r["text"] for r in mixing.mixed(df).collect()} == {t for _, t in rows}


def test_near_copies_of_one_doc_id(spark):
    """Rows of one doc_id are compared with each other; columns that are named like helpers stay as they are."""
    words = [f"w{i}" for i in range(60)]
    near, far = " ".join(words), " ".join(f"v{i}" for i in range(60))
    rows = [(5, near), (5, " ".join([*words[:58], "x", "y"])), (5, far), (5, ""), (5, ""), (3, far), (8, " ".join(["z", *words[1:]])), (9, None), (9, None), (4, "ab"), (4, "ab")]
    df = spark.createDataFrame([(d, t, "r", 1) for d, t in rows], "doc_id long, text string, __row string, __in int")
    got = ngram_join.one_of_each(df)
    assert got.columns == df.columns and {(r["__row"], r["__in"]) for r in got.collect()} == {("r", 1)}
    kept = sorted((r["doc_id"], r["text"] or "") for r in got.collect())
    assert len(kept) == 7 and [k for k in kept if k[1] in ("", "ab") or k[1] == far] == [(3, far), (4, "ab"), (5, ""), (5, ""), (9, ""), (9, "")]
    assert [d for d, t in kept if t.split()[1:2] in (["w1"], ["w0"])] == [5]
