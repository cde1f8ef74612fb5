"""Comparison of a DataFrame with a DuckDB result."""


def same(spark_rows, duck_relation):
    """Compares rows of a DataFrame and a DuckDB result, columns by name, rows in any order."""
    names = sorted(c[0] for c in duck_relation.description)
    assert sorted(spark_rows.columns) == names
    got = sorted((tuple(r) for r in spark_rows.select([f"`{n}`" for n in names]).collect()), key=repr)
    at = sorted(range(len(names)), key=lambda i: duck_relation.description[i][0])
    want = sorted((tuple(r[i] for i in at) for r in duck_relation.fetchall()), key=repr)
    assert len(got) == len(want)
    assert [x for x in zip(got, want, strict=True) if x[0] != x[1]] == []
