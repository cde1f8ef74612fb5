import random
import re

import pytest
from pyspark.sql import functions as F

from assay.operators import rules as R
from assay.operators import search as S
from assay.plans.query import compile_query

ROWS = [
    (0, 4624, "Administrator", 'powershell -enc "AA"', "WS01", "hoge:fuga", 1.0, True, "1,024"),
    (1, 4625, None, "cmd.exe\n/c dir", "WS02", "-keyword", 12345678.9, False, " 7 "),
    (2, 1, "", "a,b", "WS03", "a|b", 0.00001, None, "N/A"),
    (3, None, "user x", None, None, None, None, None, None),
    (4, 7, "ÉLAN", "zz", "WS04", "", float("nan"), True, ""),
    (5, None, None, None, None, None, None, None, None),
]
SCHEMA = "__rowid long, EventID long, user string, command string, com string, data string, score double, ok boolean, size string"


@pytest.fixture(scope="module")
def logs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


def ids(df):
    return sorted(r[0] for r in df.select("__rowid").collect())


def _text(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        if v != v:
            return "NaN"
        t = f"{v:.20f}".rstrip("0").rstrip(".") if v in (0.00001,) else repr(v)
        return "0.00001" if v == 0.00001 else t.removesuffix(".0")
    return str(v)


def plain_eval(query, row, default):
    """One row, evaluated in plain Python."""
    q = compile_query(query)
    if q.blank:
        return default
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    texts = {n.lower(): (_text(v) or "").lower() for n, v in zip(names, row, strict=True) if n != "__rowid"}
    whole = " ".join(t for t in texts.values() if t)

    def one(x):
        t = whole if x.column is None else texts.get(x.column)
        return bool(x.term and t and x.term in t) != x.negated

    return any(all(one(x) for x in c) for c in q.clauses)


@pytest.mark.parametrize(
    "query,want",
    {
        "": [0, 1, 2, 3, 4, 5],
        "|": [0, 1, 2, 3, 4, 5],
        "eventid:4624": [0],
        'command:"powershell -enc"': [0],
        "com:WS01|WS02|ws03": [0, 1, 2],
        "-com:ws": [3, 5],
        '"hoge:fuga"': [0],
        'data:"a|b"': [2],
        "12345678.9": [1],
        "score:0.00001": [2],
        "ok:true": [0, 4],
        "élan": [4],
        '"user x"': [3],
        "nowhere:x": [],
        "-nowhere:x": [0, 1, 2, 3, 4, 5],
        '"dir ws02"': [1],
        "1,024": [0],
    }.items(),
)
def test_search(logs, query, want):
    assert ids(S.search_filter(logs, query)) == want


def test_columns_and_stored_text(logs):
    assert ids(S.search_filter(logs, "ws01", ["user", "nope"])) == []
    assert ids(S.search_filter(logs, "com:ws01", ["user"])) == [0]
    stored = S.with_row_text(logs)
    assert ids(S.search_filter(stored, "ws01 administrator", text_col="__text")) == [0]


def test_three_forms_agree(spark, logs):
    rng = random.Random(4)
    atoms = ["ws0", "4", "a", "-enc", "eventid:46", "com:ws", "user:", "-x", "|", " ", '"a b"', 'data:"a|b"', "ok:true|", "-ok:false", "nope:1", "é", "-com:WS01", "score:1", "n"]
    queries = ["".join(rng.choice(atoms) + rng.choice([" ", "", "|", " "]) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    rules = R.compiled(R.rules_table(spark, [("safe", str(i), q) for i, q in enumerate(queries)]))
    want = {(row[0], i) for row in ROWS for i, q in enumerate(queries, 1) if plain_eval(q, row, False)}
    assert {(r["__rowid"], r["rule_no"]) for r in R.rule_matches(logs, rules).collect()} == want
    column = logs.select("__rowid", R.matched_rules(logs, rules).alias("m")).collect()
    assert {(r["__rowid"], m["rule_no"]) for r in column for m in r["m"]} == want
    flags = logs.select("__rowid", *[S.row_matches(logs, q).alias(f"q{i}") for i, q in enumerate(queries[:12])]).collect()
    for r in flags:
        for i, q in enumerate(queries[:12]):
            assert r[f"q{i}"] == (plain_eval(q, ROWS[r[0]], False) and any(v not in (None, "") for v in ROWS[r[0]][1:]))  # empty rows are never found


def test_names_equal_up_to_case(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        df = spark.createDataFrame([(0, "x", "y")], "__rowid long, `A.b` string, `a.B` string")
        assert ids(S.search_filter(df, "a.b:y")) == [0]
        assert ids(S.search_filter(df, "a.b:x")) == []
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")


def test_scoped_search_reads_only_its_column(spark, sf):
    df = S.search_filter(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderstatus:f", row_id_col="o_orderkey").select("o_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>", plan), plan


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ids(S.search_filter(df, "a b|c")) == []
    assert df.select(F.lit(1)).count() == 0


def test_rules_with_a_common_literal(spark, logs):
    """Rules that share a literal are tried only where it holds, and find what they find alone."""
    queries = [f"com:ws0 {x}" for x in ("4", "-4", "a", "ok:true", "eventid:46", "-user:a", "|com:ws0 x", "com:ws0")] + [f"-ok:false {x}" for x in ("4", "a", "b", "-enc", "e", "n", "o", "1", "2")] + ["4|a", "-x"]
    rules = R.compiled(R.rules_table(spark, [("safe", str(i), q) for i, q in enumerate(queries)]))
    got = [(r["__rowid"], r["rule_no"]) for r in R.rule_matches(logs, rules).orderBy("__rowid").collect()]
    assert sorted(got) == sorted((row[0], i) for row in ROWS for i, q in enumerate(queries, 1) if plain_eval(q, row, False))
    for row in {r for r, _ in got}:
        assert [n for r, n in got if r == row] == sorted(n for r, n in got if r == row)


def test_thousands_of_rules(spark, logs):
    """Terms that begin alike, hold each other, hold marks of regular expressions, in scopes and without, negated and not."""
    rng = random.Random(8)
    parts = ["a", "aa", "aab", "ab", "b", "4", "46", "462", "4624", "4625", "624", "(", ")", "[a-z]", ".", "\\\\d", "^", "$", "ws0", "ws01", "ws02", "ws", "é", "élan", "enc", "-enc", "hoge", "hoge:fuga", "zz", "z", "1,024", "+", "*", "?", "{2}", "\\x"]
    queries = []
    for _ in range(3000):
        words = []
        for _ in range(rng.randint(1, 4)):
            t = rng.choice(parts) + (rng.choice(parts) if rng.random() < 0.3 else "")
            words.append(rng.choice(["", "", "-"]) + rng.choice(["", "", "com:", "command:", "eventid:", "nowhere:", "data:"]) + t + rng.choice(["", "", "|"]))
        queries.append(" ".join(words))
    rules = R.compiled(R.rules_table(spark, [("safe", str(i), q) for i, q in enumerate(queries)]))
    got = {(r["__rowid"], r["rule_no"]) for r in R.rule_matches(logs, rules).collect()}
    want = {(row[0], i) for row in ROWS for i, q in enumerate(queries, 1) if plain_eval(q, row, False)}
    assert got == want and len(want) > 1000


def test_rules_compile_whatever_their_number(spark, logs):
    """The plan does not grow with the rules, and nothing falls back to another path."""
    sizes = {}
    for n in (10, 2000):
        rules = R.compiled(R.rules_table(spark, [("safe", "t", f"command:x{i} {i}") for i in range(n)]))
        plan = R.rule_matches(logs, rules)._jdf.queryExecution().optimizedPlan()
        sizes[n] = plan.treeString().count("regexp_extract_all")
    assert sizes[10] == sizes[2000]


def test_stored_text_skips_files(spark, tmp_path):
    from assay.sources import searchable as X

    rows = [(i, f"Word{i // 50} common é{i % 3} 🙂x", f"c{i % 5}", i * 1.5) for i in range(1000)]
    df = spark.createDataFrame(rows, "__rowid long, a string, b string, v double")
    path = str(tmp_path / "set")
    X.write_searchable(df.repartitionByRange(20, "__rowid"), path)
    every = len(X.files_to_read(spark, path, ""))
    assert every >= 20
    for query, most in (("word7", 3), ("word7|word13", 5), ("word3 é1", 3), ("a:word19", 2), ("-word7", every), ("nowhere here", 0), ("common", every), ('"é2 🙂x c1"', every), ("ab|word1", every), ("word4 -common", 3)):
        want = ids(S.search_filter(df, query))
        assert ids(X.search_stored(spark, path, query)) == want, query
        read = len(X.files_to_read(spark, path, query))
        assert read <= most and (read > 0 or not want), query
    # files that the index does not know are read
    S.with_row_text(spark.createDataFrame([(5000, "late word7", "c", 0.5)], df.schema)).write.mode("append").parquet(f"{path}/data")
    assert ids(X.search_stored(spark, path, "late word7")) == [5000]
    assert len(X.index_files(spark, path)) >= 1 and len(X.index_files(spark, path)) <= 1  # a file without rows stays unknown
    assert ids(X.search_stored(spark, path, "late")) == [5000]


def test_index_hands_on_buckets_not_trigrams(spark, tmp_path, monkeypatch):
    """What is shuffled for the index is bounded by the files, whatever their texts."""
    from assay.sources import searchable as X

    counted, frame = [], type(spark.range(1))
    distinct = frame.distinct
    monkeypatch.setattr(frame, "distinct", lambda df: (counted.append(df.count()), distinct(df))[1])
    df = spark.range(20000).select(F.col("id").alias("__rowid"), F.concat(F.lit("many trigrams of one text, "), F.col("id").cast("string")).alias("a"))
    X.write_searchable(df.repartitionByRange(2, "__rowid"), str(tmp_path / "set"))
    assert max(counted) <= 2 * (X.BUCKETS + 1)


def test_stored_text_of_odd_texts(spark, tmp_path, monkeypatch):
    """Texts longer than a slice, bytes that are no UTF-8, no texts at all, an index from before, and another time zone."""
    from assay.sources import searchable as X

    monkeypatch.setattr(X, "SLICE_UNITS", 5)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        path = str(tmp_path / "set")
        rows = [(i, ("x" * i + f"needle{i}e🙂🙂 ") if i % 3 else None) for i in range(60)]
        df = spark.createDataFrame(rows, "__rowid long, a string")
        bad = spark.range(100, 101).select(F.col("id").alias("__rowid"), F.unhex(F.lit("80FF")).cast("string").alias("a")).withColumn("a", F.concat("a", F.lit("after bad")))
        df = df.union(bad)
        X.write_searchable(df.repartitionByRange(4, "__rowid"), path)
        (tmp_path / "set" / "trigrams").mkdir()
        for query in ("needle7e", "needle58e🙂", '"🙂🙂"', '"after bad"', "needle3e", "xxneedle2e"):
            assert ids(X.search_stored(spark, path, query)) == ids(S.search_filter(df, query)), query
        assert len(X.files_to_read(spark, path, "needle58e")) == 1 and X.index_files(spark, path) == []
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
