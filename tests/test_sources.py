import csv

from pyspark.sql import functions as F

from assay.operators import annotations as A
from assay.operators import profile as P
from assay.operators import rules as R
from assay.sources import annotations as SA
from assay.sources import rules as SR
from assay.sources import tables as T
from assay.streaming.live import triage_stream, write_triaged

CSV = 'id,triage-safe,triage-suspicious,triage-critical,triage-memo,txt,when,ok,x\n1,0,0,1, m ,"a ""q"", b\nc",2024-01-01,true,1.5\n2,1,,,,,2024-01-02,false,2\n3,,false,,  ," p ",x,true,-3e2\n4,0,0,0,,k,,true,\n'


def test_import_lifts_annotations(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV)
    data, notes = T.import_csv(spark, str(tmp_path / "a.csv"), str(tmp_path / "set"))
    assert dict(data.dtypes) == {"__rowid": "bigint", "id": "bigint", "txt": "string", "when": "string", "ok": "boolean", "x": "double"}
    rows = {r["__rowid"]: r for r in data.collect()}
    assert rows[0]["txt"] == 'a "q", b\nc' and rows[2]["txt"] == " p " and rows[3]["when"] is None and rows[2]["x"] == -300.0
    assert {tuple(r) for r in notes.collect()} == {(0, "critical", "m"), (1, "safe", None), (2, "suspicious", None)}


def test_export_round_trip(spark, tmp_path):
    data = spark.createDataFrame([(0, "error", "f"), (1, ' "x", y\n', "g"), (2, "", "h")], "__rowid long, msg string, memo string")
    notes = spark.createDataFrame([(1, "safe", "keep, this")], A.SCHEMA)
    rules = R.rules_table(spark, [("critical", "t", "error")])
    r = R.resolve(data, notes, rules, "export", flag_col="__f", memo_col="__m")
    T.write_csv(T.export_frame(r, flag_col="__f", memo_col="__m").coalesce(1), str(tmp_path / "out"))
    back, again = T.lift_annotations(T.with_row_ids(T.read_csv(spark, str(tmp_path / "out"))))
    assert {tuple(x) for x in again.collect()} == {(0, "critical", "[t]"), (1, "safe", "keep, this")}
    assert [x["msg"] for x in back.orderBy("__rowid").collect()][:2] == ["error", ' "x", y\n']
    assert back.columns == ["__rowid", "msg", "memo"]
    assert "memo" not in T.export_frame(r, flag_col="__f", memo_col="__m", drop_reserved=True).columns


def test_row_ids(spark, tmp_path):
    spark.range(1000).repartition(7).write.parquet(str(tmp_path / "p"))
    df = T.with_row_ids(spark.read.parquet(str(tmp_path / "p")))
    assert sorted(r[0] for r in df.select("__rowid").collect()) == list(range(1000))
    assert T.with_row_ids(spark.createDataFrame([], "a int")).count() == 0


def test_rules_files(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"flag":" Critical ","tag":" t ","query":" a|b "},{"flag":"odd","tag":"","query":""}]')
    got = [tuple(r) for r in SR.read_rules_json(spark, str(tmp_path / "r.json")).orderBy("rule_no").collect()]
    assert got == [(1, "critical", "t", "a|b"), (2, "", "", "")]
    assert SR.read_rules_json(spark, str(tmp_path / "none.json")).count() == 0
    r = R.rules_table(spark, [("safe", "t,1", 'a "b c"'), ("critical", "", "x\ny"), ("safe", "q", "  ")])
    SR.write_rules_csv(r, str(tmp_path / "csv"))
    assert [tuple(x)[1:] for x in SR.read_rules_csv(spark, str(tmp_path / "csv")).orderBy("rule_no").collect()] == [("safe", "t,1", 'a "b c"'), ("critical", "", "x\ny")]
    SR.write_rules_json(r, str(tmp_path / "json"))
    assert SR.read_rules_lines(spark, str(tmp_path / "json")).count() == 3


def test_annotation_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"3": {"flag": "safe", "memo": null}, "5": {"flag": "", "memo": "x"}, "z": {"flag": "safe"}}')
    got = sorted(tuple(r) for r in SA.read_annotation_map(spark, str(tmp_path / "a.json")).collect())
    assert got == [(3, "safe", None), (5, "", "x")]
    one = SA.replace_annotations(SA.read_annotation_map(spark, str(tmp_path / "a.json")), str(tmp_path / "store"))
    two = SA.replace_annotations(SA.read_annotations(spark, one).filter("row_id = 3"), str(tmp_path / "store"))
    assert SA.read_annotations(spark, one).count() == 2 and SA.read_annotations(spark, two).count() == 1
    assert SA.read_annotations(spark, None).count() == 0


def test_profile(spark):
    df = spark.createDataFrame([(0, "ab", [1.5], True), (1, None, None, None)], "__rowid long, a_long_name string, v array<double>, b boolean")
    got = {r["column"]: r["max_chars"] for r in P.column_profile(df).collect()}
    assert got == {"a_long_name": 11, "v": 5, "b": 4}
    stored = spark.createDataFrame([("v", 1)], "column string, max_chars long")
    assert P.load_profile(df, stored).count() == 3
    assert P.load_profile(df.select("__rowid", "v"), stored).first()["max_chars"] == 1


def test_stream(spark, tmp_path):
    spark.createDataFrame([(i, "error" if i % 3 == 0 else "ok") for i in range(30)], "__rowid long, msg string").write.parquet(str(tmp_path / "in"))
    rules = R.rules_table(spark, [("critical", "t", "error")])
    notes = spark.createDataFrame([(3, "safe", None)], A.SCHEMA)
    stream = spark.readStream.schema("__rowid long, msg string").parquet(str(tmp_path / "in"))
    q = write_triaged(triage_stream(stream, rules, "msg:error", annotations=notes), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 10 and out.filter(F.col("flag") == "critical").count() == 9


def test_whole_numbers_keep_all_digits(spark, tmp_path):
    (tmp_path / "n.csv").write_text("a,b,c,d\n9223372036854775807,9223372036854775808,1.5,-9223372036854775808\n9223372036854775806,1,9223372036854775807,\n,,,\n")
    x = T.read_csv(spark, str(tmp_path / "n.csv"))
    assert dict(x.dtypes) == {"a": "bigint", "b": "string", "c": "double", "d": "bigint"}
    assert [r["a"] for r in x.collect()] == [9223372036854775807, 9223372036854775806, None]


def test_line_breaks_in_fields_are_looked_for(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n"x ""y"", z",1\nw,2\n')
    (tmp_path / "b.csv").write_text('a,b\n"x\ny",1\nw,2\n')
    assert not T.broken_fields(spark, str(tmp_path / "a.csv")) and T.broken_fields(spark, str(tmp_path / "b.csv"))
    assert [r["a"] for r in T.read_csv(spark, str(tmp_path / "a.csv")).collect()] == ['x "y", z', "w"]
    assert [r["a"] for r in T.read_csv(spark, str(tmp_path / "b.csv")).collect()] == ["x\ny", "w"]


def test_ids_follow_paths(spark, tmp_path):
    for name, n in (("c", 5), ("a", 3), ("b", 900)):
        (tmp_path / f"{name}.csv").write_text("v\n" + "".join(f"{name}{i}\n" for i in range(n)))
    x = T.with_row_ids(T.read_csv(spark, [str(tmp_path / f"{k}.csv") for k in "bca"]))
    want = [f"a{i}" for i in range(3)] + [f"b{i}" for i in range(900)] + [f"c{i}" for i in range(5)]
    assert [r["v"] for r in x.orderBy("__rowid").collect()] == want


def _messy(rng, n):
    """Records whose fields hold line breaks, quotes, commas, both line ends and nothing at all."""
    parts = ["a", "b c", '""', ",", "\n", "\r\n", "\n\n", "é", "x" * 40]
    for i in range(n):
        long = rng.random() < 0.01
        quoted = "".join(rng.choice(parts) for _ in range(rng.randint(0, 600 if long else 6)))
        yield f'{i},"{quoted}",{rng.choice(["", "p", "q r"])}'


def test_line_breaks_in_fields_are_read_by_many_tasks(spark, tmp_path):
    import random

    rng = random.Random(12)
    for name, n, end in (("a", 4000, "\n"), ("b", 3, "\n"), ("c", 900, "\r\n")):
        (tmp_path / f"{name}.csv").write_bytes(("id,t,u" + end + end.join(_messy(rng, n)) + (end if name == "a" else "")).encode())
    paths = [str(tmp_path / f"{k}.csv") for k in "abc"]
    want = [r for p in paths for r in list(csv.reader(open(p, newline="", encoding="utf-8")))[1:]]  # noqa: SIM115
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    whole = spark.read.options(header=True, multiLine=True, escape='"').csv(paths)
    try:
        for size in ("1777", "20000", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = T.read_csv(spark, paths, row_id_col="r")
            assert dict(got.dtypes) == {"r": "bigint", "id": "bigint", "t": "string", "u": "string"}
            rows = got.orderBy("r").collect()
            assert [r["r"] for r in rows] == list(range(4903))
            assert [r["id"] for r in rows] == [*range(4000), *range(3), *range(900)]
            assert [[str(r["id"]), r["t"] or "", r["u"] or ""] for r in rows] == want  # as written, line ends of both kinds too
            # Spark's own reading of whole files writes all line ends in fields as line feeds
            unix = lambda t: t and t.replace("\r\n", "\n")
            assert sorted(((r["id"], unix(r["t"]), r["u"]) for r in rows), key=repr) == sorted(((int(r["id"]), unix(r["t"]), r["u"]) for r in whole.collect()), key=repr)
            if size == "1777":
                assert got.rdd.getNumPartitions() > 50  # and the longest fields go over several splits
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_quotes_inside_plain_fields_fall_back(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n5" x,1\n"y\nz",2\n6" w,3\n')
    assert sorted(r["a"] for r in T.read_csv(spark, str(tmp_path / "a.csv")).collect()) == ['5" x', '6" w', "y\nz"]


def test_ordered_export_moves_no_rows(spark, tmp_path):
    from assay.sources import export as X

    data = spark.range(5000).select(F.col("id").alias("__rowid"), F.concat(F.lit("msg,\n"), F.col("id").cast("string")).alias("msg"), (F.col("id") % 7).alias("n"))
    data.repartitionByRange(6, "__rowid").sortWithinPartitions("__rowid").write.parquet(str(tmp_path / "data"))
    notes = spark.createDataFrame([(3, "safe", "m"), (4000, "", "x")], A.SCHEMA)
    rules = R.rules_table(spark, [("critical", "t", "n:3"), ("safe", "from", "from:0")])
    frame = X.ordered_export(spark, str(tmp_path / "data"), notes, rules)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "rangepartitioning" not in plan
    X.write_export(spark, str(tmp_path / "data"), notes, rules, str(tmp_path / "out"))
    back = T.read_csv(spark, str(tmp_path / "out/*"), row_id_col="r")
    rows = back.orderBy("r").collect()
    assert [r["msg"] for r in rows] == [f"msg,\n{i}" for i in range(5000)] and back.columns[1:] == ["triage-safe", "triage-suspicious", "triage-critical", "triage-memo", "msg", "n"]
    assert [i for i, r in enumerate(rows) if r["triage-critical"]] == [i for i in range(3, 5000, 7) if i not in (3, 4000)]
    assert rows[3]["triage-memo"] == "m [t]" and rows[3]["triage-safe"] == 1
    # ids that are not stored in runs are sorted
    spark.read.parquet(str(tmp_path / "data")).repartition(5).write.parquet(str(tmp_path / "mixed"))
    X.write_export(spark, str(tmp_path / "mixed"), notes, rules, str(tmp_path / "out2"))
    again = T.read_csv(spark, str(tmp_path / "out2/*"), row_id_col="r").orderBy("r").collect()
    assert again == rows


def test_profiles_read_new_files_only(spark, tmp_path):
    data, store = str(tmp_path / "data"), str(tmp_path / "store")
    made = lambda rows: spark.createDataFrame(rows, "__rowid long, a string, b double").coalesce(1)
    made([(0, "x" * 9, 1.0), (1, None, 22.5)]).write.parquet(data)
    got, read = P.kept_profile(spark, data, store)
    assert {tuple(r) for r in got.collect()} == {("a", 9), ("b", 4)} and len(read) == 1
    got, read = P.kept_profile(spark, data, store)
    assert {tuple(r) for r in got.collect()} == {("a", 9), ("b", 4)} and read == []
    made([(2, "y" * 12, 123456.5)]).write.mode("append").parquet(data)
    got, read = P.kept_profile(spark, data, store)
    assert {tuple(r) for r in got.collect()} == {("a", 12), ("b", 8)} and len(read) == 1
    # all files are others now
    made([(2, "z", 1.5)]).write.mode("overwrite").parquet(data)
    got, read = P.kept_profile(spark, data, store)
    assert {tuple(r) for r in got.collect()} == {("a", 1), ("b", 3)} and len(read) == 1


def test_files_of_longer_tables_are_more(spark, sf, monkeypatch):
    """A query that stores a table writes more files of a longer one, not longer files."""
    from assay import queries as Q

    written = []
    write = T.write_csv
    monkeypatch.setattr(T, "FILE_BYTES", 1 << 16, raising=False)
    monkeypatch.setattr(T, "write_csv", lambda df, path: (written.append(df.rdd.getNumPartitions()), write(df, path)))
    rows = Q.a1_multi_line(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    assert written[0] >= size >> 16 > 3
    ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert [tuple(r) for r in rows.select("row_id", "doc_id").orderBy("row_id").collect()] == list(enumerate(sorted(ids)))


def test_ranges_of_any_table(spark):
    odd = spark.createDataFrame([(1, None, "é"), (2, "b", "c")], "id long, `a.b` string, c string")
    assert T.in_ranges(odd, "id", 2).count() == 2 and T.in_ranges(odd, "a.b").count() == 2
    assert T.in_ranges(odd.limit(0), "id", 3).count() == 0
