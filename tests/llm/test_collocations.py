"""Collocations by dynamic itemset counting against plain counting and against SQL."""

import random
import re
from collections import Counter

import pytest
from compare import same
from pyspark.sql import functions as F

from assay.llm import collocations as C


def plain_counts(rows):
    f, n = Counter(), Counter()
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(ws)
            f.update((lang or "und", tuple(ws[i : i + k])) for k in (1, 2, 3, 4) for i in range(len(ws) - k + 1))
    return f, n


def plain(rows, least, first):
    f, n = plain_counts(rows)
    f = {p: v for p, v in f.items() if v >= least}
    out = []
    for (lang, w), a in f.items():
        if len(w) < 2:
            continue
        if any(v * 100 >= 80 * a for (other, x), v in f.items() if other == lang and len(x) > len(w) and any(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1))):
            continue
        score, _, l, r = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, l, r, n[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    ranked = []
    for x in out:
        rank = 1 + sum(y[0] == x[0] for y in ranked)
        ranked.append((x[0], rank, *x[1:]))
    return [x for x in ranked if x[1] <= first]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["Alpha", "beta", "GAMMA", "é", "d-e", "z", "10", "漢字", "x"]
    made = []
    for _ in range(150):
        ws = [rng.choice(words[: rng.choice((3, 5, 9))]) + rng.choice(["", "", "", ",", ".\n", "  ", "\t", " :", "\x0b", "!?"]) for _ in range(rng.randint(0, 60))]
        made.append((rng.choice(["en", "en", "de", None, "und"]), " ".join(ws)))
    return made + [("en", None), (None, ""), ("fr", " .,. "), ("en", "alpha beta gamma z " * 3000)] + [("es", "uno dos tres cuatro cinco")] * 40


def test_matches_sql(spark, sf, duck):
    same(C.op11(spark, sf), duck.execute(C.OP11_SQL))


@pytest.mark.parametrize("cycle,bits", [(3, 22), (1, 16), (5, 3)])
def test_plain_counting(spark, rows, cycle, bits):
    """Few slots make phrases start early, and many shards make them start late: counts stay whole."""
    docs = spark.createDataFrame([(*r, i, "n", 3, 4) for i, r in enumerate(rows)], "lang string, text string, doc_id long, n string, k int, shard int").repartition(6)
    got = sorted(tuple(r) for r in C.collocations(docs, 8, 60, cycle=cycle, bits=bits).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == sorted(plain(rows, 8, 60))
    assert {r[0] for r in got} >= {"en", "de", "und", "es"}


def test_every_frequent_phrase_counts_once(spark, rows):
    f, _ = plain_counts(rows)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    table, words = C.phrase_counts(docs, 5, 4, 12)
    assert {(r["lang"], tuple(r["phrase"].split(" "))): r["f"] for r in table.collect()} == {p: v for p, v in f.items() if v >= 5}
    assert table.filter("k > 4").isEmpty() and words.count() == len({r[0] or "und" for r in rows if r[1]})


def test_edges(spark, edges, no_rows):
    assert C.collocations(no_rows).count() == 0
    assert C.collocations(edges.filter("text is null or text = ''")).count() == 0
    got = C.collocations(edges, least=20).select("lang", "phrase", "a")
    want = plain([(r["lang"], r["text"]) for r in edges.collect()], 20, 2000)
    assert sorted(tuple(r) for r in got.collect()) == sorted((r[0], r[2], r[3]) for r in want)


def test_long_products_are_exact(spark):
    big = 9_000_000_000_000_000_000
    table = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 7)], "lang string, k int, phrase string, f long")
    assert C.best_cuts(table).select(F.col("score")).first()[0] == 2000000 * (big - 7) // (big + big - 1)


@pytest.fixture(scope="module")
def varied():
    """Texts of many words, whose phrases reach the threshold sooner or later or not at all; words of every length up to long ones."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeé0") for _ in range(n)) for n in (*range(1, 20), 31, 32, 33, 63, 64, 65, 66, 300)] + [f"w{i}" for i in range(140)]
    made = []
    for _ in range(400):
        ws = [words[min(int(rng.expovariate(0.03)), len(words) - 1)] for _ in range(rng.randint(1, 50))]
        ws += [rng.choice(words)] * rng.choice((0, 0, 0, 5, 9))
        made.append((rng.choice(["en", "de"]), rng.choice([" ", " ", "  ", " \t"]).join(ws)))
    return made


def frequent(rows, least):
    return {p: v for p, v in plain_counts(rows)[0].items() if v >= least}


def found(table):
    return {(r["lang"], tuple(r["phrase"].split(" "))): r["f"] for r in table.collect()}


@pytest.mark.parametrize("cycle,bits", [(3, 7), (3, 9), (5, 8), (2, 10)])
def test_slots_that_others_mark_first(spark, varied, monkeypatch, cycle, bits):
    """Slots of a phrase can be marked before those of its subphrases; ranges of hashes and tasks are small here."""
    monkeypatch.setattr(C, "PART_BYTES", 4096, raising=False)
    monkeypatch.setattr(C, "TASK_BYTES", 8192)
    docs = spark.createDataFrame(varied, "lang string, text string").repartition(3)
    table, _ = C.phrase_counts(docs, 6, cycle, bits)
    assert found(table) == frequent(varied, 6)


def test_texts_of_one_hash(spark):
    """Two words of 16 bytes with one hash count apart, next to each other and in other texts."""
    rng, letters = random.Random(2), "abcdefghijklmnopqrstuvwxyz0123456789#$%&'()*+-/<=>@[]^_{|}~"
    top = 1 << 64

    def first_chunk(x):
        size = C.np.array([16], C.np.uint64)
        return int((C.mix(size * C._SEED[0] + C.np.frombuffer(x.encode(), "<u8")) * C._FACTOR)[0])

    def second_chunks(gap):
        """Two texts of eight letters whose numbers are ``gap`` apart."""
        a, b, carry = "", "", 0
        for i in range(8):
            step = (gap >> 8 * i & 255) + carry
            fit = [(x, y) for x in letters for y in letters if (ord(x) + step) % 256 == ord(y)]
            if not fit:
                return None
            x, y = rng.choice(fit)
            a, b, carry = a + x, b + y, (ord(x) + step) // 256
        return a, b

    pair = None
    while not pair:
        x, y = ("".join(rng.choice(letters) for _ in range(8)) for _ in "xy")
        rest = second_chunks((first_chunk(x) - first_chunk(y)) % top)
        pair = rest and (x + rest[0], y + rest[1])
    x, y = pair
    data = C.np.frombuffer(f"{x} {y}".encode(), C.np.uint8)
    (h, g) = C.word_hashes(data, C.np.array([0, 17]), C.np.array([16, 33]), C._SEED)
    assert x != y and h[0] == h[1] and g[0] != g[1]
    rows = [("en", f"{x} {y} z")] * 9 + [("en", f"z {x}")] * 4 + [("en", f"{y} z")] * 2 + [("en", f"q {y} {y}")] * 3
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    table, words = C.phrase_counts(docs, 8)
    assert found(table) == frequent(rows, 8)
    assert [tuple(r) for r in words.collect()] == [("en", sum(len(t.split()) for _, t in rows))]


def test_what_moves_is_blocks(spark):
    """Phrases that are counted and not frequent do not move one by one."""
    rng = random.Random(3)
    rows = [("en", " ".join(f"w{rng.randrange(150)}" for _ in range(100))) for _ in range(400)]
    counted = sum(len(w) == 2 for _, w in plain_counts(rows)[0])
    sc = spark.sparkContext
    sc.setJobGroup("collocations", "what moves")
    table, _ = C.phrase_counts(spark.createDataFrame(rows, "lang string, text string").repartition(2), 30)
    sc.setLocalProperty("spark.jobGroup.id", None)
    tracker, store, total = sc.statusTracker(), sc._jsc.sc().statusStore(), 0
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    for stage in {x for job in tracker.getJobIdsForGroup("collocations") for x in tracker.getJobInfo(job).stageIds}:
        total += store.lastStageAttempt(stage).shuffleWriteRecords()
    assert found(table) == frequent(rows, 30)
    assert counted > 15_000 and 0 < total < counted / 4


def test_places_of_phrases_that_were_handed_on():
    rng = C.np.random.default_rng(1)
    h, g = rng.integers(1, 1 << 63, (2, 40), dtype=C.np.uint64)
    seen = C._Seen(3)
    seen.add(h, g)
    left = seen.missing(h, g)
    assert 0 < len(h) - len(left) <= 16
    assert len(seen.missing(h, g + C.np.uint64(2))) == len(h)
    i, n = C._distinct(h[[0, 1, 0, 1, 1]], g[[0, 1, 0, 2, 1]])
    assert sorted(n.tolist()) == [1, 2, 2] and len(set(i.tolist())) == 3


def test_many_ranges_of_texts(spark, varied, monkeypatch):
    """Texts of phrases are brought together by ranges of hashes, from several tasks."""
    monkeypatch.setattr(C, "PART_PHRASES", 16, raising=False)
    monkeypatch.setattr(C, "TEXT_TASK_BYTES", 8192, raising=False)
    docs = spark.createDataFrame(varied, "lang string, text string").repartition(3)
    table, words = C.phrase_counts(docs, 6)
    assert found(table) == frequent(varied, 6)
    assert {r["lang"]: r["n"] for r in words.collect()} == dict(plain_counts(varied)[1])
