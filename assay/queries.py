"""Registered queries of the table operators, each with its DuckDB SQL.

Every query reads whole tables; a limit stands only where paging is the feature.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import flags as fl
from .functions import text as tx
from .operators import annotations as an
from .operators import profile, recount, rules, search, summary, view
from .sources import annotations as src_annotations
from .sources import rules as src_rules
from .sources import export, searchable, tables
from .sources.scratch import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: (flag, tag, query) of the rules on ``events``: a low severity stands before a
#: high one, one flag is unknown, one query is blank and one has no term.
RULES = [
    ("safe", " view ", "event_type:view|error user_id:1"),
    ("suspicious", "slow", "event_type:error"),
    ("critical", "buy", "event_type:purchase user_id:12|12"),
    ("bogus", "odd", "props:7 -event_type:click"),
    ("?", "", "event_type:signup user_id:33"),
    ("critical", "never", "  "),
    ("critical", "none", "|"),
    (" Critical ", "slow", "event_type:error user_id:4"),
]


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events")


def _annotations(events: DataFrame) -> DataFrame:
    """Annotations by a formula on the key; some belong to rows that do not exist."""
    i = F.col("event_id")
    flag = F.when(i % 7 == 0, " Safe ").when(i % 11 == 0, "?").when(i % 17 == 0, "bogus").otherwise("")
    memo = F.when(i % 13 == 0, "seen [slow]").when(i % 10 == 0, "note ").when(i % 19 == 0, "")
    a = events.select(i.alias("row_id"), flag.alias("flag"), memo.alias("memo"))
    beyond = events.select((-i - 1).alias("row_id"), F.lit("safe").alias("flag"), F.lit(None).cast("string").alias("memo")).filter(i % 100 == 0)
    return a.filter((F.col("flag") != "") | F.col("memo").isNotNull()).union(beyond)


def _rules(spark: SparkSession) -> DataFrame:
    return rules.rules_table(spark, RULES)


_AN_SQL = """
an0 AS (SELECT event_id AS row_id,
  CASE WHEN event_id % 7 = 0 THEN ' Safe ' WHEN event_id % 11 = 0 THEN '?' WHEN event_id % 17 = 0 THEN 'bogus' ELSE '' END AS flag,
  CASE WHEN event_id % 13 = 0 THEN 'seen [slow]' WHEN event_id % 10 = 0 THEN 'note ' WHEN event_id % 19 = 0 THEN '' END AS memo FROM events),
an AS (SELECT * FROM an0 WHERE flag <> '' OR memo IS NOT NULL
  UNION ALL SELECT -event_id - 1, 'safe', NULL FROM events WHERE event_id % 100 = 0),
nan AS (SELECT row_id, CASE lower(trim(flag)) WHEN 'safe' THEN 'safe' WHEN 'suspicious' THEN 'suspicious' WHEN 'critical' THEN 'critical' WHEN '?' THEN 'suspicious' ELSE '' END AS uflag, memo AS umemo FROM an)"""
_MATCH_SQL = """
m AS (SELECT event_id, [x FOR x IN [
  CASE WHEN contains(event_type, 'view') OR (contains(event_type, 'error') AND contains(user_id::VARCHAR, '1')) THEN {'no': 1, 'flag': 'safe', 'rank': 1, 'tag': 'view'} END,
  CASE WHEN contains(event_type, 'error') THEN {'no': 2, 'flag': 'suspicious', 'rank': 2, 'tag': 'slow'} END,
  CASE WHEN (contains(event_type, 'purchase') AND contains(user_id::VARCHAR, '12')) OR contains(user_id::VARCHAR, '12') THEN {'no': 3, 'flag': 'critical', 'rank': 3, 'tag': 'buy'} END,
  CASE WHEN contains(props, '7') AND NOT contains(event_type, 'click') THEN {'no': 4, 'flag': '', 'rank': 0, 'tag': 'odd'} END,
  CASE WHEN contains(event_type, 'signup') AND contains(user_id::VARCHAR, '33') THEN {'no': 5, 'flag': 'suspicious', 'rank': 2, 'tag': ''} END,
  CASE WHEN contains(event_type, 'error') AND contains(user_id::VARCHAR, '4') THEN {'no': 8, 'flag': 'critical', 'rank': 3, 'tag': 'slow'} END
] IF x IS NOT NULL] AS m FROM events)"""
_HIGH = "CASE list_max([x.rank FOR x IN m]) WHEN 3 THEN 'critical' WHEN 2 THEN 'suspicious' WHEN 1 THEN 'safe' ELSE '' END"
# tokens in stored order, each once, that the memo does not hold
_TOKENS = "[t FOR t, i IN [('[' || x.tag || ']') FOR x IN m IF x.tag <> ''] IF list_position([('[' || x.tag || ']') FOR x IN m IF x.tag <> ''], t) = i AND NOT contains(mm, t)]"
_TAGGED = "CASE WHEN len(tk) = 0 THEN mm WHEN mm = '' OR ends_with(mm, ' ') THEN mm || array_to_string(tk, ' ') ELSE mm || ' ' || array_to_string(tk, ' ') END"
_JOINED_SQL = f"""
j AS (SELECT e.event_id, m.m, coalesce(nan.uflag, '') AS uflag, nan.umemo, nan.row_id IS NOT NULL AS annotated, coalesce(nan.umemo, '') AS mm
  FROM events e JOIN m USING (event_id) LEFT JOIN nan ON nan.row_id = e.event_id),
k AS (SELECT *, {_TOKENS} AS tk, {_HIGH} AS high FROM j),
r AS (SELECT *, {_TAGGED} AS tagged FROM k)"""
_RESOLVE = f"WITH {_AN_SQL},{_MATCH_SQL},{_JOINED_SQL}"
_VIEW = f"{_RESOLVE}, v AS (SELECT event_id, CASE WHEN uflag <> '' THEN uflag ELSE high END AS flag, CASE WHEN uflag = '' AND tagged <> mm THEN tagged ELSE nullif(umemo, '') END AS memo FROM r)"
_ROW = "lower(concat_ws(' ', nullif(event_type, ''), user_id::VARCHAR, nullif(props, '')))"
_EVENT_TEXT = ["event_type", "user_id", "props"]


# -- search ---------------------------------------------------------------------------------------


def _search(name: str, table: str, key: str, text: str, where: str, columns: list[str] | None = None) -> None:
    """Registers a search of a table that returns the keys it finds."""
    QUERIES[name] = lambda s, d: search.search_filter(_table(s, d, table), text, columns, row_id_col=key).select(key)
    SQL[name] = f"SELECT {key} FROM {table} WHERE {where}"


_search("c1_search_filter", "events", "event_id", "event_type:error|purchase user_id:12", "contains(event_type, 'error') OR (contains(event_type, 'purchase') AND contains(user_id::VARCHAR, '12'))")
_search("c1_search_blank", "events", "event_id", ' "  " | ', "true")
_search("c2_term", "events", "event_id", "ERROR 7", f"contains({_ROW}, 'error') AND contains({_ROW}, '7')", _EVENT_TEXT)
# every column: times and doubles too, as their texts
_ALL = "lower(concat_ws(' ', ts::VARCHAR, user_id::VARCHAR, nullif(event_type, ''), regexp_replace(value::VARCHAR, '\\.0$', ''), nullif(props, '')))"
_search("c2_all_columns", "events", "event_id", '"-01-0" 3.1|"click 5"|value:99 -ts:00', f"(contains({_ALL}, '-01-0') AND contains({_ALL}, '3.1')) OR contains({_ALL}, 'click 5') OR (contains(value::VARCHAR, '99') AND NOT contains(ts::VARCHAR, '00'))")
_search("c3_scoped_term", "orders", "o_orderkey", "http://x|O_OrderStatus:f", "contains(lower(o_orderstatus), 'f')")
_search("c3_unknown_column", "pages", "page_id", "http://example", "false", ["url"])
_search("c4_phrase", "orders", "o_orderkey", '"4-NOT SPECIFIED"', "contains(lower(o_orderpriority), '4-not specified')", ["o_orderpriority"])
_search("c4_phrase_colon", "pages", "page_id", '"http://"', "contains(lower(url), 'http://')", ["url"])
_search("c5_scoped_phrase", "part", "p_partkey", 'p_name: "small ring"', "contains(lower(p_name), 'small ring')")
_search("c6_not", "events", "event_id", "user_id:1 -event_type:view --x", "contains(user_id::VARCHAR, '1') AND NOT contains(event_type, 'view') AND NOT contains(" + _ROW + ", '-x')", _EVENT_TEXT)
_search("c7_and", "documents", "doc_id", "the ING OR", "contains(lower(text), 'the') AND contains(lower(text), 'ing') AND contains(lower(text), 'or')", ["text"])
_search("c8_or", "documents", "doc_id", "|stupid || idiot | trash|", "contains(lower(text), 'stupid') OR contains(lower(text), 'idiot') OR contains(lower(text), 'trash')", ["text"])
_search("c8_long_text", "documents", "doc_id", 'ÉAUX "der eine" -stupid|ñó', "(contains(lower(text), 'éaux') AND contains(lower(text), 'der eine') AND NOT contains(lower(text), 'stupid')) OR contains(lower(text), 'ñó')", ["text"])
_search("c9_carry", "events", "event_id", "event_type:error|-click user_id:3", "contains(event_type, 'error') OR (NOT contains(event_type, 'click') AND contains(user_id::VARCHAR, '3'))")
_search("c9_carry_pending", "events", "event_id", "event_type:error|user_id:12 view", "contains(event_type, 'error') OR (contains(user_id::VARCHAR, '12') AND contains(event_type, 'view'))")
_search("c10_empty_term", "events", "event_id", "event_type: error", "false", _EVENT_TEXT)
_search("c10_empty_negated", "events", "event_id", "-event_type: error", f"contains({_ROW}, 'error')", _EVENT_TEXT)
_search("c11_column_subset", "part", "p_partkey", '"economy small ring"|p_brand:17', "contains(lower(p_type) || ' ' || lower(p_name), 'economy small ring') OR contains(lower(p_brand), '17')", ["p_type", "nowhere", "p_name"])


@query("c2_stored_text", "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'token =') OR (contains(lower(text), 'idiot') AND NOT contains(lower(text), 'der') AND contains(source, '1'))")
def c2_stored(s, d):
    """A dataset with stored row text in many files; rare terms open few of them."""
    path = scratch_path(s, "searchable")
    searchable.write_searchable(tables.in_ranges(_table(s, d, "documents").select("doc_id", "text", "source"), "doc_id", 20), path, row_id_col="doc_id")
    return searchable.search_stored(s, path, '"token ="|idiot -der source:1', row_id_col="doc_id").select("doc_id", "source")


@query("c12_flag_filter", f"{_VIEW} SELECT event_id, flag FROM v WHERE flag IN ('suspicious', 'critical')")
def c12(s, d):
    e = _events(s, d)
    return view.flag_filter(rules.resolve(e, _annotations(e), _rules(s), row_id_col="event_id"), "priority").select("event_id", "flag")


@query(
    "c13_row_match",
    "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN false ELSE NOT contains(event_type, 'error') OR (event_id % 4 = 1 AND contains(props, '7')) END AS hit, false AS none FROM events",
)
def c13(s, d):
    i = F.col("event_id")
    e = _events(s, d).select("event_id", F.when(i % 4 > 0, F.col("event_type")).otherwise("").alias("event_type"), F.when(i % 4 == 1, F.col("props")).alias("props"))
    return e.select("event_id", search.row_matches(e, "-event_type:error|props:7", row_id_col="event_id").alias("hit"), search.row_matches(e, " | ", row_id_col="event_id").alias("none"))


# -- annotations and rules ------------------------------------------------------------------------


@query("d1_annotation_lookup", f"WITH {_AN_SQL} SELECT event_id, coalesce(uflag, '') AS flag, umemo AS memo, row_id IS NOT NULL AS annotated FROM events LEFT JOIN nan ON row_id = event_id")
def d1(s, d):
    e = _events(s, d)
    return an.join_annotations(e, _annotations(e), "event_id").select("event_id", F.col("__triage_user_flag").alias("flag"), F.col("__triage_user_memo").alias("memo"), F.col("__triage_annotated").alias("annotated"))


@query("d2_rule_match", f"WITH {_MATCH_SQL} SELECT event_id, x.no AS rule_no, x.flag AS flag, x.tag AS tag FROM (SELECT event_id, unnest(m) AS x FROM m)")
def d2(s, d):
    return rules.rule_matches(_events(s, d), _rules(s), row_id_col="event_id")


def _many_rules(s: SparkSession) -> DataFrame:
    return rules.rules_table(s, [(("safe", "suspicious", "critical")[i % 3], f"t{i}", f"event_type:error user_id:{i}") for i in range(300)])


@query(
    "d2_many_rules",
    "SELECT e.event_id, count(*) AS n, max(i.i % 3 + 1)::INT AS top FROM events e JOIN (SELECT unnest(range(300)) AS i) i"
    " ON contains(e.user_id::VARCHAR, i.i::VARCHAR) WHERE e.event_type = 'error' GROUP BY 1",
)
def d2_many(s, d):
    e = _events(s, d)
    m = rules.matched_rules(e, _many_rules(s), row_id_col="event_id")
    out = e.select("event_id", m.alias("m")).filter(F.size("m") > 0)
    return out.select("event_id", F.size("m").cast("long").alias("n"), F.array_max(F.transform("m", lambda r: r["rank"])).alias("top"))


@query(
    "d2_two_thousand_rules",
    f"""WITH e AS MATERIALIZED (SELECT event_id, user_id::VARCHAR AS u, event_type AS t, props AS p, {_ROW} AS x FROM events), i AS (SELECT unnest(range(2000)) AS i),
hit AS (SELECT event_id, i, (contains(u, i::VARCHAR) AND NOT contains(p, (i % 10)::VARCHAR)) OR (contains(t, 'er') AND contains(x, 'error ' || i)) OR (i = 7 AND NOT contains(t, 'e')) AS hit FROM e, i)
SELECT event_id, count(*) AS n, min(i + 1)::INT AS first_rule, sum(i + 1)::BIGINT AS all_rules FROM hit WHERE hit GROUP BY event_id""",
)
def d2_two_thousand(s, d):
    """Scoped terms that hold each other, negated terms, phrases over columns and one rule of a negation alone."""
    e = _table(s, d, "events").select("event_id", "event_type", "user_id", "props")
    made = rules.rules_table(s, [("safe", f"t{i}", f'"error {i}" event_type:er|user_id:{i} -props:{i % 10}' + ("|-event_type:e" if i == 7 else "")) for i in range(2000)])
    return rules.rule_matches(e, made, row_id_col="event_id").groupBy("event_id").agg(F.count("*").alias("n"), F.min("rule_no").alias("first_rule"), F.sum("rule_no").alias("all_rules"))


@query("d3_unflagged_rows", f"WITH {_AN_SQL} SELECT event_id FROM events WHERE event_id NOT IN (SELECT row_id FROM nan WHERE uflag <> '')")
def d3(s, d):
    e = _events(s, d)
    return an.unflagged_rows(e, _annotations(e), "event_id").select("event_id")


def _resolved(mode: str) -> Query:
    def run(s, d):
        e = _events(s, d)
        return rules.resolve(e, _annotations(e), _rules(s), mode, row_id_col="event_id").select("event_id", "flag", "memo")

    return run


QUERIES["e1_effective_flag_view"], SQL["e1_effective_flag_view"] = _resolved("view"), f"{_VIEW} SELECT * FROM v"
QUERIES["e2_effective_flag_preview"] = _resolved("preview")
SQL["e2_effective_flag_preview"] = (
    f"{_RESOLVE} SELECT event_id, CASE WHEN uflag <> '' THEN uflag ELSE coalesce([x.flag FOR x IN m IF x.rank > 0][1], '') END AS flag,"
    " CASE WHEN tagged <> mm THEN nullif(trim(tagged), '') ELSE umemo END AS memo FROM r"
)
QUERIES["e3_effective_flag_export"] = _resolved("export")
SQL["e3_effective_flag_export"] = f"{_RESOLVE} SELECT event_id, CASE WHEN annotated THEN uflag ELSE high END AS flag, tagged AS memo FROM r"


@query("e4_tag_memo", "SELECT doc_id, CASE WHEN contains(source, '1') THEN source || ' [one]' || CASE WHEN lang = 'en' THEN ' [en]' ELSE '' END WHEN lang = 'en' THEN source || ' [en]' ELSE source END AS memo FROM documents")
def e4(s, d):
    docs = _table(s, d, "documents")
    tokens = F.filter(F.array(F.when(F.contains("source", F.lit("1")), "[one]"), F.when(F.col("lang") == "en", "[en]"), F.when(F.col("lang") == "en", "[en]")), lambda t: t.isNotNull())
    return docs.select("doc_id", tx.append_tag(F.col("source"), tokens).alias("memo"))


_RULE_VALUES = "(VALUES " + ", ".join("({}, '{}', '{}', '{}')".format(i, *r) for i, r in enumerate(RULES, 1)) + ") t(rule_no, flag, tag, query)"
_NORM = "CASE lower(trim(flag)) WHEN 'safe' THEN 'safe' WHEN 'suspicious' THEN 'suspicious' WHEN 'critical' THEN 'critical' WHEN '?' THEN 'suspicious' ELSE '' END"
_RANK = f"CASE {_NORM} WHEN 'critical' THEN 3 WHEN 'suspicious' THEN 2 WHEN 'safe' THEN 1 ELSE 0 END"


def _derived_rules(s: SparkSession, d: str) -> DataFrame:
    """A rule for every brand and size of parts: rules from a table, as many as it has such pairs."""
    p = _table(s, d, "part").groupBy("p_brand", "p_size").agg(F.min("p_partkey").cast("int").alias("rule_no"), F.min("p_name").alias("p_name"))
    flag = F.when(F.col("p_size") % 3 == 0, " Safe").when(F.col("p_size") % 3 == 1, "?").otherwise("odd")
    return p.select("rule_no", flag.alias("flag"), F.concat(F.lit(" "), "p_brand").alias("tag"), F.when(F.col("p_size") % 5 > 0, F.col("p_name")).otherwise(" ").alias("query"))


_DERIVED = """(SELECT min(p_partkey)::INT AS rule_no, CASE p_size % 3 WHEN 0 THEN ' Safe' WHEN 1 THEN '?' ELSE 'odd' END AS flag, ' ' || p_brand AS tag,
  CASE WHEN p_size % 5 > 0 THEN min(p_name) ELSE ' ' END AS query FROM part GROUP BY p_brand, p_size)"""


@query("e6_prepare_rules", f"SELECT row_number() OVER (ORDER BY trim(tag), rule_no)::INT AS rule_no, {_NORM} AS flag, trim(tag) AS tag, trim(query) AS query FROM {_DERIVED} WHERE trim(query) <> ''")
def e6(s, d):
    return rules.prepared_rules(_derived_rules(s, d))


@query("e7_severity_order", f"SELECT rule_no, {_RANK} AS rank, row_number() OVER (ORDER BY {_RANK} DESC, rule_no)::INT AS place FROM {_DERIVED}")
def e7(s, d):
    return rules.by_severity(_derived_rules(s, d)).select("rule_no", "rank", "place")


def _edits(e: DataFrame) -> DataFrame:
    i = F.col("event_id")
    one = e.filter(i % 3 == 0).select(i.alias("row_id"), F.when(i % 2 == 0, "critical").otherwise(" ").alias("flag"), F.when(i % 9 == 0, "m").alias("memo"), i.alias("seq"))
    two = e.filter(i % 6 == 0).select(i.alias("row_id"), F.lit("bogus").alias("flag"), F.lit(None).cast("string").alias("memo"), (i + 1).alias("seq"))
    return one.union(two)


_EDITS = """ed AS (SELECT row_id, arg_max({'flag': flag, 'memo': memo}, seq) AS x FROM (
  SELECT event_id AS row_id, CASE WHEN event_id % 2 = 0 THEN 'critical' ELSE ' ' END AS flag, CASE WHEN event_id % 9 = 0 THEN 'm' END AS memo, event_id AS seq FROM events WHERE event_id % 3 = 0
  UNION ALL SELECT event_id, 'bogus', NULL, event_id + 1 FROM events WHERE event_id % 6 = 0) GROUP BY row_id)"""


@query(
    "e8_annotation_upsert",
    f"WITH {_AN_SQL}, {_EDITS} SELECT row_id, flag, memo FROM an WHERE row_id NOT IN (SELECT row_id FROM ed) UNION ALL"
    " SELECT row_id, x.flag AS flag, x.memo AS memo FROM ed WHERE NOT (trim(x.flag) = '' AND trim(coalesce(x.memo, '')) = '')",
)
def e8(s, d):
    e = _events(s, d)
    return an.apply_edits(_annotations(e), _edits(e))


@query("e9_annotation_clear", f"WITH {_AN_SQL} SELECT row_id, flag, memo FROM an WHERE row_id % 2 <> 0")
def e9(s, d):
    e = _events(s, d)
    clear = e.filter("event_id % 2 = 0").select(F.col("event_id").alias("row_id"), F.lit("").alias("flag"), F.lit(" ").alias("memo"), F.lit(1).alias("seq"))
    beyond = e.filter("event_id % 100 = 0").select((-F.col("event_id") - 2).alias("row_id"), F.lit("").alias("flag"), F.lit(None).cast("string").alias("memo"), F.lit(1).alias("seq"))
    return an.apply_edits(_annotations(e), clear.union(beyond))


@query(
    "e10_toggle_flag",
    f"WITH {_AN_SQL} SELECT event_id AS row_id, CASE WHEN coalesce(uflag, '') = 'safe' THEN '' ELSE 'safe' END AS flag, umemo AS memo FROM events LEFT JOIN nan ON row_id = event_id WHERE event_id % 5 = 0",
)
def e10(s, d):
    e = _events(s, d)
    choices = e.filter("event_id % 5 = 0").select(F.col("event_id").alias("row_id"), F.lit("SAFE").alias("flag"), F.lit(1).alias("seq"))
    return an.toggle_flags(_annotations(e), choices).select("row_id", "flag", "memo")


@query("e11_replace_rules", f"SELECT row_number() OVER (ORDER BY trim(tag), rule_no)::INT AS rule_no, {_NORM} AS flag, trim(tag) AS tag, trim(query) AS query FROM {_DERIVED} WHERE trim(query) <> ''")
def e11(s, d):
    version = src_rules.replace_rules(rules.prepared_rules(_derived_rules(s, d)), scratch_path(s, "rules"))
    return s.read.parquet(version)


# -- counts ---------------------------------------------------------------------------------------


@query("f1_f3_totals", f"{_VIEW} SELECT (SELECT count(*) FROM events) AS total_rows, count(*) AS total_filtered_rows, count(*) FILTER (flag <> '') AS total_flagged FROM v JOIN events USING (event_id) WHERE contains(event_type, 'e')")
def f123(s, d):
    e = _events(s, d)
    found = search.search_filter(e, "event_type:e", row_id_col="event_id")
    return view.totals(e, rules.resolve(found, _annotations(e), _rules(s), row_id_col="event_id"))


@query("f4_flagged_records", f"WITH {_AN_SQL} SELECT count(*) AS flagged_records FROM an WHERE trim(flag) <> ''")
def f4(s, d):
    return an.flagged_records(_annotations(_events(s, d)))


@query("f5_rule_applied_records", f"{_RESOLVE} SELECT count(*) AS ioc_applied_records FROM r WHERE uflag = '' AND len(m) > 0")
def f5(s, d):
    e = _events(s, d)
    return rules.rule_applied_records(e, _annotations(e), _rules(s), row_id_col="event_id")


@query(
    "f5_recount_after_edits",
    f"{_RESOLVE}, {_EDITS}, after AS (SELECT row_id, flag FROM an WHERE row_id NOT IN (SELECT row_id FROM ed) UNION ALL SELECT row_id, x.flag FROM ed),"
    f" flagged AS (SELECT row_id FROM after WHERE {_NORM} <> '') SELECT count(*) FILTER (uflag = '') AS before, count(*) FILTER (event_id NOT IN (SELECT row_id FROM flagged)) AS after FROM r WHERE len(m) > 0",
)
def f5_recount(s, d):
    """Counts before and after edits from stored hits: the data are matched once."""
    e, store = _events(s, d), scratch_path(s, "hits")
    notes, edits = _annotations(e), _edits(e)
    recount.keep_hits(e, _rules(s), store, "event_id")
    before = recount.kept_count(s, _rules(s), notes, store).select(F.col("ioc_applied_records").alias("before"))
    change = recount.count_change(s, _rules(s), notes, edits, store)
    return view.one_row(before, change).select("before", (F.col("before") + F.col("change")).alias("after"))


@query(
    "f6_column_profile",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", greatest({len(c)}, max(length({t})))::BIGINT AS max_chars FROM customer" for c, t in (("c_name", "c_name"), ("c_nationkey", "c_nationkey::VARCHAR"), ("c_acctbal", "c_acctbal::VARCHAR"), ("c_mktsegment", "c_mktsegment"))),
)
def f6(s, d):
    return profile.column_profile(_table(s, d, "customer"), "c_custkey")


@query(
    "f7_dataset_summary",
    f"{_RESOLVE} SELECT 'e' AS id, 'events' AS name, 'log' AS description, (SELECT count(*) FROM events) AS total_records, (SELECT count(*) FROM an WHERE trim(flag) <> '') AS flagged_records,"
    " (SELECT count(*) FROM r WHERE uflag = '' AND len(m) > 0) AS ioc_applied_records, 'props' AS hidden"
    " UNION ALL SELECT 'c', 'customers', NULL, (SELECT count(*) FROM customer), 0, 0, ''",
)
def f7(s, d):
    e, c = _events(s, d), _table(s, d, "customer")
    none = s.createDataFrame([], an.SCHEMA)
    got = summary.list_datasets([
        summary.Dataset("e", "events", e, _annotations(e), _rules(s), datetime(2024, 1, 1), "log", ["props"], "event_id"),
        summary.Dataset("c", "customers", c, none, [], datetime(2024, 1, 2), row_id_col="c_custkey"),
    ])
    return got.select("id", "name", "description", "total_records", "flagged_records", "ioc_applied_records", F.array_join("hidden_columns", ",").alias("hidden"))


# -- sort and pages -------------------------------------------------------------------------------

_MIXED = "CASE event_id % 3 WHEN 0 THEN user_id::VARCHAR || CASE WHEN event_id % 2 = 0 THEN ',5 ' ELSE '' END WHEN 1 THEN NULL ELSE upper(event_type) END"
_KEYS = f"""x AS (SELECT event_id, {_MIXED} AS k FROM events),
y AS (SELECT event_id, k, TRY_CAST(replace(trim(k), ',', '') AS DOUBLE) AS n, lower(replace(trim(k), ',', '')) AS t FROM x),
z AS (SELECT event_id, k, CASE WHEN n IS NOT NULL THEN 0 WHEN k IS NULL THEN 1 ELSE 2 END AS c, n, CASE WHEN n IS NULL THEN t END AS t FROM y)"""


def _mixed(s: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    number = F.concat(F.col("user_id").cast("string"), F.when(i % 2 == 0, ",5 ").otherwise(""))
    return _table(s, d, "events").select("event_id", F.when(i % 3 == 0, number).when(i % 3 == 2, F.upper("event_type")).alias("k"))


def _sorted(name: str, descending: bool, offset: int, limit: int) -> None:
    way = "DESC NULLS LAST" if descending else "ASC NULLS FIRST"
    QUERIES[name] = lambda s, d: view.page(_mixed(s, d), "k", descending, offset, limit, "event_id").select("event_id", "k", "pos")
    SQL[name] = f"WITH {_KEYS} SELECT event_id, k, row_number() OVER (ORDER BY c {way}, n {way}, t {way}, event_id)::INT AS pos FROM z QUALIFY pos > {offset} AND pos <= {offset + limit}"


_sorted("g1_mixed_sort", False, 0, 250)
_sorted("g2_descending", True, 0, 250)
_sorted("g3_stable_ties", False, 3000, 500)
_sorted("g5_page", True, 4000, 250)


QUERIES["g5_page_at"] = lambda s, d: view.page_at(_mixed(s, d), "k", True, 4000, 250, "event_id", 16).select("event_id", "k", "pos")
SQL["g5_page_at"] = SQL["g5_page"]


@query("g1_sort_keys", f"WITH {_KEYS} SELECT event_id, c, n, t FROM z")
def g1_keys(s, d):
    m = _mixed(s, d)
    c, n, t = tx.sort_keys(F.col("k"), m.schema["k"].dataType)
    return m.select("event_id", c.alias("c"), n.alias("n"), t.alias("t"))


@query("g4_unknown_key", "SELECT event_id, (event_id + 1)::INT AS pos FROM events ORDER BY event_id LIMIT 250")
def g4(s, d):
    return view.page(_mixed(s, d), "nowhere", True, row_id_col="event_id").select("event_id", "pos")


@query("g5_page_after", f"WITH {_KEYS}, p AS (SELECT event_id, k, row_number() OVER (ORDER BY c, n NULLS FIRST, t NULLS FIRST, event_id) AS pos FROM z) SELECT event_id, k FROM p WHERE pos > 250 AND pos <= 500")
def g5_after(s, d):
    m = _mixed(s, d)
    last = view.page(m, "k", row_id_col="event_id").orderBy(F.desc("pos")).first()
    return view.page_after(m, {"k": last["k"], "event_id": last["event_id"]}, "k", row_id_col="event_id")


@query(
    "g6_preview",
    f"{_RESOLVE} SELECT event_id, CASE WHEN uflag <> '' THEN uflag ELSE coalesce([x.flag FOR x IN m IF x.rank > 0][1], '') END AS flag,"
    " CASE WHEN tagged <> mm THEN nullif(trim(tagged), '') ELSE umemo END AS memo FROM r ORDER BY event_id LIMIT 250",
)
def g6(s, d):
    e = _events(s, d)
    return view.preview(e, _annotations(e), _rules(s), row_id_col="event_id").select("event_id", "flag", "memo")


@query(
    "flagship_triage",
    f"{_VIEW}, p AS (SELECT v.event_id, event_type, user_id, flag, memo, row_number() OVER (ORDER BY user_id DESC, event_id)::INT AS pos FROM v JOIN events USING (event_id)"
    " WHERE flag IN ('suspicious', 'critical') AND (contains(event_type, 'error') OR contains(event_type, 'signup') OR contains(user_id::VARCHAR, '12'))) SELECT * FROM p WHERE pos <= 250",
)
def flagship(s, d):
    e = _events(s, d)
    got, _ = view.query_rows(e, _annotations(e), _rules(s), "event_type:error|signup|user_id:12", "priority", None, "user_id", True, row_id_col="event_id")
    return got.select(F.col("row_index").alias("event_id"), "data.event_type", "data.user_id", "flag", "memo", "pos")


@query(
    "g5_page_with_totals",
    f"{_VIEW}, hits AS (SELECT v.event_id, user_id, flag FROM v JOIN events USING (event_id)"
    " WHERE contains(event_type, 'error') OR contains(event_type, 'signup') OR contains(user_id::VARCHAR, '12')),"
    " p AS (SELECT event_id, flag, row_number() OVER (ORDER BY user_id DESC, event_id)::INT AS pos FROM hits)"
    " SELECT event_id, flag, pos, (SELECT count(*) FROM events) AS total_rows, (SELECT count(*) FROM hits) AS total_filtered_rows,"
    " (SELECT count(*) FROM hits WHERE flag <> '') AS total_flagged FROM p WHERE pos > 100 AND pos <= 350",
)
def g5_totals(s, d):
    e = _events(s, d)
    rows, seen = view.query_page(e, _annotations(e), _rules(s), "event_type:error|signup|user_id:12", None, None, "user_id", True, 100, row_id_col="event_id")
    got = s.createDataFrame([(r["row_index"], r["flag"], r["pos"]) for r in rows], "event_id long, flag string, pos int")  # one page
    return got.select("*", *[F.lit(seen[c]).cast("long").alias(c) for c in ("total_rows", "total_filtered_rows", "total_flagged")])


# -- columns and functions ------------------------------------------------------------------------


@query("b1_data_columns", "SELECT * EXCLUDE (c_custkey) FROM customer")
def b1(s, d):
    c = _table(s, d, "customer")
    return c.select(search.data_columns(c, "c_custkey"))


@query("b2_visible_columns", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def b2(s, d):
    return view.visible_columns(_table(s, d, "customer"), ["c_acctbal", "c_nationkey", "nowhere"], "c_custkey")


@query("b3_row_record", f"{_VIEW} SELECT event_id AS row_index, event_type AS data_flag, user_id AS data_user, props AS data_memo, flag, memo FROM v JOIN events USING (event_id)")
def b3(s, d):
    e = _events(s, d).withColumnsRenamed({"event_type": "flag", "props": "memo"})
    rs = [(f, t, x.replace("event_type:", "flag:").replace("props:", "memo:")) for f, t, x in RULES]
    r = view.records(rules.resolve(e, _annotations(e), rules.rules_table(s, rs), row_id_col="event_id", flag_col="f", memo_col="m"), "event_id", "f", "m")
    return r.select("row_index", F.col("data.flag").alias("data_flag"), F.col("data.user_id").alias("data_user"), F.col("data.memo").alias("data_memo"), "flag", "memo")


@query("b4_row_lookup", "SELECT o_orderkey AS pos, s_suppkey, s_name FROM orders JOIN supplier ON s_suppkey = o_orderkey % 150")
def b4(s, d):
    wanted = _table(s, d, "orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") % 150).alias("id"))
    return view.lookup(_table(s, d, "supplier"), wanted, "s_suppkey").select("pos", "s_suppkey", "s_name")


@query("b5_toggle_column", "SELECT p_partkey, CASE WHEN p_type IN ('SMALL', 'ECONOMY') THEN array_to_string([x FOR x IN ['SMALL', 'ECONOMY'] IF x <> p_type], ',') ELSE 'SMALL,ECONOMY,' || p_type END AS hidden FROM part")
def b5(s, d):
    hidden = F.array(F.lit("SMALL"), F.lit("ECONOMY"))
    return _table(s, d, "part").select("p_partkey", F.array_join(view.toggle_column(hidden, F.col("p_type")), ",").alias("hidden"))


@query("h1_h2_flags", "WITH x AS (SELECT event_id, [' Safe ', 'CRITICAL', '?', '◯', '✗', 'bogus', '', NULL][event_id % 8 + 1] AS f FROM events) SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'safe' WHEN 1 THEN 'critical' WHEN 2 THEN 'suspicious' WHEN 3 THEN 'safe' WHEN 4 THEN 'critical' ELSE '' END AS flag, [1, 3, 2, 1, 3, 0, 0, 0][event_id % 8 + 1] AS rank, CASE event_id % 8 WHEN 1 THEN 'critical' WHEN 2 THEN 'suspicious' WHEN 4 THEN 'critical' ELSE 'safe' END AS edited FROM x")
def h12(s, d):
    raw = F.array(*[F.lit(x) for x in (" Safe ", "CRITICAL", "?", "◯", "✗", "bogus", "", None)])
    f = F.element_at(raw, (F.col("event_id") % 8 + 1).cast("int"))
    flag = fl.normalize_flag(f)
    return _table(s, d, "events").select("event_id", flag.alias("flag"), fl.severity_rank(flag).alias("rank"), fl.rule_flag_default(f).alias("edited"))


@query("h3_search_text", "SELECT c_custkey, regexp_replace(c_acctbal::VARCHAR, '\\.0$', '') AS a, regexp_replace((c_acctbal * 100000000)::DECIMAL(38, 0)::VARCHAR, '\\.0$', '') AS big, c_nationkey::VARCHAR AS n, CASE WHEN c_nationkey > 9 THEN 'true' ELSE 'false' END AS b FROM customer")
def h3(s, d):
    c = _table(s, d, "customer")
    e = c.withColumns({"big": F.round(F.col("c_acctbal") * 100000000), "b": F.col("c_nationkey") > 9})
    t = lambda x: tx.search_text(F.col(x), e.schema[x].dataType)
    return e.select("c_custkey", t("c_acctbal").alias("a"), t("big").alias("big"), t("c_nationkey").alias("n"), t("b").alias("b"))


@query(
    "h3_extreme_doubles",
    r"""WITH x AS (SELECT c_custkey, (c_custkey || '.' || c_nationkey || 'e' || ((c_custkey % 63) * 10 - 322))::DOUBLE AS v FROM customer),
    p AS (SELECT c_custkey, regexp_extract(v::VARCHAR, '^(\d+)(?:\.(\d+))?(?:e([+-]\d+))?$', ['i', 'f', 'e']) AS m FROM x),
    q AS (SELECT c_custkey, m.i || m.f AS a, length(m.i) + coalesce(nullif(m.e, '')::INT, 0) AS p FROM p),
    r AS (SELECT c_custkey, rtrim(ltrim(a, '0'), '0') AS d, p - (length(a) - length(ltrim(a, '0'))) AS p FROM q)
    SELECT c_custkey, CASE WHEN p <= 0 THEN '0.' || repeat('0', -p) || d WHEN p >= length(d) THEN d || repeat('0', p - length(d)) ELSE d[:p] || '.' || d[p + 1:] END AS t FROM r""",
)
def h3_extreme(s, d):
    c = _table(s, d, "customer")
    v = F.concat("c_custkey", F.lit("."), "c_nationkey", F.lit("e"), (F.col("c_custkey") % 63 * 10 - 322).cast("string")).cast("double")
    e = c.select("c_custkey", v.alias("v"))
    return e.select("c_custkey", tx.search_text(F.col("v"), e.schema["v"].dataType).alias("t"))


@query("h4_row_text", f"SELECT event_id, {_ROW} AS t FROM events")
def h4(s, d):
    return search.with_row_text(_table(s, d, "events"), _EVENT_TEXT, "event_id", "t").select("event_id", "t")


@query("h5_h6_display", "SELECT c_custkey, c_acctbal::VARCHAR AS a, length(c_acctbal::VARCHAR) AS n, CASE WHEN c_nationkey % 2 = 0 THEN 4 ELSE 5 END AS b FROM customer")
def h56(s, d):
    c = _table(s, d, "customer").withColumn("b", F.col("c_nationkey") % 2 == 0)
    kind = lambda x: c.schema[x].dataType
    return c.select("c_custkey", tx.display_text(F.col("c_acctbal"), kind("c_acctbal")).alias("a"), tx.display_length(F.col("c_acctbal"), kind("c_acctbal")).alias("n"), tx.display_length(F.col("b"), kind("b")).alias("b"))


@query("h7_sort_number", "SELECT o_orderkey, TRY_CAST(replace(trim(split_part(o_orderpriority, '-', 1)), ',', '') AS DOUBLE) AS a, NULL::DOUBLE AS b FROM orders")
def h7(s, d):
    o = _table(s, d, "orders").withColumn("a", F.substring_index("o_orderpriority", "-", 1))
    return o.select("o_orderkey", tx.sort_number(F.col("a"), o.schema["a"].dataType).alias("a"), tx.sort_number(F.concat("a", F.lit("d")), o.schema["a"].dataType).alias("b"))


@query("h9_sanitize_memo", "SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS memo FROM pages")
def h9(s, d):
    return _table(s, d, "pages").select("page_id", tx.sanitize_memo(F.concat(F.lit("\x01\x1f"), "html")).alias("memo"))


@query("h11_csv_escape", """SELECT event_id, '"' || replace(props, '"', '""') || '"' AS p, event_type AS t FROM events""")
def h11(s, d):
    return _table(s, d, "events").select("event_id", tx.csv_escape(F.col("props")).alias("p"), tx.csv_escape(F.col("event_type")).alias("t"))


# -- sources and sinks ----------------------------------------------------------------------------


@query(
    "a1_csv_import",
    "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment, 'a \"b\", ' || c_name || chr(10) || 'z' AS q, '2024-01-01' AS w,"
    " 9123456789012345678 + c_custkey AS id19, (c_custkey + 92233720368547758070::HUGEINT)::VARCHAR AS id20 FROM customer",
)
def a1(s, d):
    path = scratch_path(s, "csv")
    more = {"q": F.concat(F.lit('a "b", '), "c_name", F.lit("\nz")), "w": F.lit("2024-01-01"), "id19": F.lit(9123456789012345678) + F.col("c_custkey"), "id20": (F.lit("92233720368547758070").cast("decimal(38,0)") + F.col("c_custkey")).cast("string")}
    tables.write_csv(_table(s, d, "customer").withColumns(more), path)
    return tables.read_csv(s, path)


@query("a1_multi_line_csv", "SELECT doc_id, nullif(text, '') AS text, lang, source, n_chars, (row_number() OVER (ORDER BY doc_id) - 1) AS row_id FROM documents")
def a1_multi_line(s, d):
    """Texts with line breaks, quotes and commas in them, in files that are split wherever it may be."""
    path = scratch_path(s, "texts")
    tables.write_csv(tables.in_ranges(_table(s, d, "documents"), "doc_id", 3).sortWithinPartitions("doc_id"), path)
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    return tables.read_csv(s, path, schema=kinds, row_id_col="row_id")


@query(
    "a2_lift_annotations",
    "SELECT doc_id AS row_id, CASE WHEN toxic = 1 THEN 'critical' WHEN quality = 0 THEN 'suspicious' ELSE '' END AS flag, CASE WHEN doc_id % 5 = 0 THEN 'm' END AS memo FROM labels"
    " WHERE toxic = 1 OR quality = 0 OR doc_id % 5 = 0",
)
def a2(s, d):
    x = _table(s, d, "labels").select("doc_id", F.col("toxic").alias("triage-critical"), (F.col("quality") == 0).cast("int").alias("triage-suspicious"), F.lit(None).cast("string").alias("triage-safe"), F.when(F.col("doc_id") % 5 == 0, " m ").otherwise("  ").alias("triage-memo"))
    return tables.lift_annotations(x, row_id_col="doc_id")[1]


@query("a3_row_ids", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey % 3, o_orderkey) - 1 AS row_id FROM orders")
def a3(s, d):
    """Three CSV files of different sizes: ids go by path, then by place."""
    path = scratch_path(s, "parts")
    o = _table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 1, F.repeat("o_orderstatus", F.lit(50))).otherwise("").alias("filler"))
    for i in range(3):
        tables.write_csv(tables.in_ranges(o.filter(F.col("o_orderkey") % 3 == i), "o_orderkey", 2).sortWithinPartitions("o_orderkey"), f"{path}/{'abc'[i]}")
    x = tables.with_row_ids(tables.read_csv(s, [f"{path}/{k}" for k in "abc"]))
    return x.select("o_orderkey", F.col("__rowid").alias("row_id"))


@query("a4_a5_dataset", "SELECT * FROM supplier")
def a45(s, d):
    path = scratch_path(s, "dataset")
    tables.write_dataset(_table(s, d, "supplier"), path)
    return tables.read_dataset(s, path)


@query("a6_annotation_map", f"WITH {_AN_SQL} SELECT row_id, flag, memo FROM an")
def a6(s, d):
    """Files of one JSON object each, with the annotations of a thousand rows."""
    path = scratch_path(s, "map")
    a = _annotations(_events(s, d)).select(F.col("row_id").cast("string").alias("k"), F.struct("flag", "memo").alias("v"), F.floor(F.col("row_id") / 1000).alias("file"))
    maps = a.groupBy("file").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v"))), {"ignoreNullFields": "false"}).alias("value"))
    maps.write.partitionBy("file").text(path)
    return src_annotations.read_annotation_map(s, path)


@query("a7_annotation_table", f"WITH {_AN_SQL} SELECT row_id, flag, memo FROM an")
def a7(s, d):
    return src_annotations.read_annotations(s, src_annotations.replace_annotations(_annotations(_events(s, d)), scratch_path(s, "annotations")))


@query("a8_a9_rules_json", f"SELECT rule_no, {_NORM} AS flag, trim(tag) AS tag, trim(query) AS query FROM {_DERIVED}")
def a89(s, d):
    path = scratch_path(s, "rules-json")
    src_rules.write_rules_json(_derived_rules(s, d), path)
    return src_rules.read_rules_lines(s, path)


@query("a8_rules_array", f"SELECT row_number() OVER (ORDER BY rule_no)::INT AS rule_no, {_NORM} AS flag, trim(tag) AS tag, trim(query) AS query FROM {_DERIVED}")
def a8(s, d):
    """One file with a JSON array of all rules (one for each brand and size of parts)."""
    path = scratch_path(s, "rules-array")
    r = F.sort_array(F.collect_list(F.struct("rule_no", "flag", "tag", "query")))
    _derived_rules(s, d).agg(F.to_json(r).alias("value")).write.text(path)
    return src_rules.read_rules_json(s, path)


@query("a10_a11_rules_csv", f"SELECT row_number() OVER (ORDER BY rule_no)::INT AS rule_no, {_NORM} AS flag, trim(tag) AS tag, trim(query) AS query FROM {_DERIVED} WHERE trim(query) <> ''")
def a1011(s, d):
    path = scratch_path(s, "rules-csv")
    src_rules.write_rules_csv(_derived_rules(s, d), path)
    return src_rules.read_rules_csv(s, path)


@query(
    "a12_export",
    f"{_RESOLVE}, x AS (SELECT event_id, CASE WHEN annotated THEN uflag ELSE high END AS flag, tagged AS memo FROM r)"
    " SELECT (flag = 'safe')::INT AS \"triage-safe\", (flag = 'suspicious')::INT AS \"triage-suspicious\", (flag = 'critical')::INT AS \"triage-critical\", memo AS \"triage-memo\","
    " events.* EXCLUDE (event_id) FROM x JOIN events USING (event_id)",
)
def a12(s, d):
    e = _events(s, d)
    return tables.export_frame(rules.resolve(e, _annotations(e), _rules(s), "export", row_id_col="event_id"), row_id_col="event_id")


@query(
    "a12_ordered_export",
    f"{_RESOLVE}, x AS (SELECT event_id, CASE WHEN annotated THEN uflag ELSE high END AS flag, tagged AS memo FROM r)"
    " SELECT (row_number() OVER (ORDER BY event_id) - 1) AS at, (flag = 'safe')::INT AS safe, (flag = 'suspicious')::INT AS suspicious, (flag = 'critical')::INT AS critical, nullif(memo, '') AS memo, event_id AS id, user_id, event_type"
    " FROM x JOIN events USING (event_id)",
)
def a12_ordered(s, d):
    """A stored dataset of many files, exported in order without a sort over its rows, and read again."""
    e, path = _events(s, d), scratch_path(s, "export")
    tables.write_dataset(tables.in_ranges(e.withColumn("id", F.col("event_id")), "event_id", 7).sortWithinPartitions("event_id"), f"{path}/data")
    export.write_export(s, f"{path}/data", _annotations(e), _rules(s), f"{path}/out", row_id_col="event_id")
    back = tables.read_csv(s, f"{path}/out/*", row_id_col="at")
    flags = {f"triage-{x}": x for x in ("safe", "suspicious", "critical")}
    return back.select("at", *[F.col(f"`{k}`").cast("int").alias(v) for k, v in flags.items()], F.col("`triage-memo`").alias("memo"), "id", "user_id", "event_type")


@query("a12_a2_round_trip", f"{_RESOLVE}, x AS (SELECT event_id, CASE WHEN annotated THEN uflag ELSE high END AS flag, nullif(trim(tagged), '') AS memo FROM r) SELECT event_id, flag, memo FROM x WHERE flag <> '' OR memo IS NOT NULL")
def a12_a2(s, d):
    e, path = _events(s, d), scratch_path(s, "export")
    resolved = rules.resolve(e, _annotations(e), _rules(s), "export", row_id_col="event_id").withColumn("id", F.col("event_id"))
    tables.write_csv(tables.export_frame(resolved, row_id_col="event_id"), path)
    return tables.lift_annotations(tables.read_csv(s, path), row_id_col="id")[1].withColumnRenamed("row_id", "event_id")


@query(
    "a13_profile_store",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", greatest({len(c)}, max(length({c}::VARCHAR)))::BIGINT AS max_chars FROM supplier" for c in ("s_name", "s_nationkey", "s_acctbal")),
)
def a13(s, d):
    x, path = _table(s, d, "supplier"), scratch_path(s, "profile")
    profile.column_profile(x.drop("s_acctbal"), "s_suppkey").write.parquet(path)
    return profile.load_profile(x, s.read.parquet(path), "s_suppkey")


@query("a13_kept_profile", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", greatest({len(c)}, max(length({t})))::BIGINT AS max_chars FROM orders" for c, t in (("o_custkey", "o_custkey::VARCHAR"), ("o_orderstatus", "o_orderstatus"), ("o_totalprice", "o_totalprice::VARCHAR"), ("o_orderpriority", "o_orderpriority"))))
def a13_kept(s, d):
    """A dataset that grows: the second profile reads the files that came after the first one."""
    o, path = _table(s, d, "orders").drop("o_orderdate"), scratch_path(s, "grows")
    o.filter("o_orderkey % 3 > 0").write.parquet(f"{path}/data")
    profile.kept_profile(s, f"{path}/data", f"{path}/profile", "o_orderkey")
    o.filter("o_orderkey % 3 = 0").write.mode("append").parquet(f"{path}/data")
    return profile.kept_profile(s, f"{path}/data", f"{path}/profile", "o_orderkey")[0]
