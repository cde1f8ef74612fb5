"""Rules: a query that flags and tags the rows it finds, as a table (rule_no, flag, tag, query).

Rules are few (``MOST_RULES``), their queries compile on the driver to an index
from literals to rules (``plans.predicates``); rows are never moved for them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.flags import RANKS, normalize_flag, normalized, rank_flag, severity_rank
from ..functions.text import append_tag, trim_all
from ..plans.predicates import MATCH, matching, with_matching
from ..plans.query import compile_query
from .annotations import join_annotations, unflagged_rows
from .search import ROW_ID, has_text, texts_of

SCHEMA = "rule_no int, flag string, tag string, query string"
MOST_RULES = 100_000


def rules_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(flag, tag, query) in stored order → the rules table."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rules, 1)], SCHEMA)


def prepared_rules(rules: DataFrame) -> DataFrame:
    """Rules as they are saved: flags normalised, tags and queries trimmed, empty queries dropped, sorted by tag (stable)."""
    r = rules.select(
        "rule_no", normalize_flag(F.col("flag")).alias("flag"), trim_all(F.coalesce("tag", F.lit(""))).alias("tag"), trim_all(F.coalesce("query", F.lit(""))).alias("query")
    ).filter("query <> ''")
    return r.withColumn("rule_no", F.row_number().over(W.orderBy("tag", "rule_no")).cast("int"))


def by_severity(rules: DataFrame) -> DataFrame:
    """Rules with their rank and their place when the most severe come first (stable)."""
    rank = severity_rank(normalize_flag(F.col("flag")))
    r = rules.withColumn("rank", rank)
    return r.withColumn("place", F.row_number().over(W.orderBy(F.desc("rank"), "rule_no")))


def compiled(rules: DataFrame | list[dict]) -> list[dict]:
    """Rules as dicts with compiled queries, in stored order."""
    if isinstance(rules, list):
        return rules
    rows = rules.orderBy("rule_no").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    out = []
    for r in rows:
        flag = normalized(r["flag"])
        out.append({"rule_no": r["rule_no"], "flag": flag, "rank": RANKS.get(flag, 0), "tag": (r["tag"] or "").strip(), "query": compile_query(r["query"] or "")})
    return out


def matched_rules(df: DataFrame, rules: DataFrame | list[dict], columns: list[str] | None = None, row_id_col: str = ROW_ID) -> Column:
    """Array of (rule_no, flag, rank, tag) of the rules that find a row, in stored order."""
    return matching(texts_of(df, columns, row_id_col), compiled(rules))


def rule_matches(df: DataFrame, rules: DataFrame | list[dict], columns: list[str] | None = None, row_id_col: str = ROW_ID) -> DataFrame:
    """(row id, rule_no, flag, tag): a row for every rule that finds a row."""
    m = with_matching(df, texts_of(df, columns, row_id_col), compiled(rules), "__triage_matches")
    # an inner explode would put a filter with all of the matching, written out several times, below itself
    return m.select(F.col(row_id_col), F.explode_outer("__triage_matches").alias("m")).filter("m is not null").select(row_id_col, "m.rule_no", "m.flag", "m.tag")


def _tokens(matches: Column) -> Column:
    return F.transform(F.filter(matches, lambda r: r["tag"] != ""), lambda r: F.concat(F.lit("["), r["tag"], F.lit("]")))


def resolve(
    df: DataFrame, annotations: DataFrame, rules: DataFrame | list[dict], mode: str = "view", columns: list[str] | None = None,
    row_id_col: str = ROW_ID, flag_col: str = "flag", memo_col: str = "memo", tags: bool = True,
) -> DataFrame:
    """Adds the effective flag and the memo with the tags of matching rules.

    - ``view``: the user's flag, else the highest severity of the matching rules; tags where the user set no flag; an empty memo is null;
    - ``preview``: the user's flag, else that of the first matching rule with a known flag; tags everywhere, memo trimmed, blank is null; a row without any text matches no rule;
    - ``export``: if a row is annotated its flag counts even if empty, else the highest severity; tags everywhere, memo never null.

    Data columns stay as they are: a data column with the name of one of the two is an error."""
    if clash := {flag_col, memo_col} & set(df.columns):
        raise ValueError(f"data columns {sorted(clash)}: give the flag and the memo other names (flag_col, memo_col)")
    j = join_annotations(df, annotations, row_id_col)
    j = with_matching(j, texts_of(df, columns, row_id_col), compiled(rules), "__triage_matches")
    if mode == "preview":
        j = j.withColumn("__triage_matches", F.when(has_text(df, row_id_col), F.col("__triage_matches")).otherwise(F.array().cast(f"array<{MATCH}>")))
    m, user, memo = F.col("__triage_matches"), F.col("__triage_user_flag"), F.coalesce("__triage_user_memo", F.lit(""))
    highest = rank_flag(F.array_max(F.transform(m, lambda r: r["rank"])))
    tagged = append_tag(memo, _tokens(m)) if tags else memo
    if mode == "view":
        flag = F.when(user != "", user).otherwise(highest)
        text = F.when((user == "") & (tagged != memo), tagged).otherwise(F.nullif(F.col("__triage_user_memo"), F.lit("")))
    elif mode == "preview":
        first = F.try_element_at(F.filter(m, lambda r: r["rank"] > 0), F.lit(1))["flag"]
        flag = F.when(user != "", user).otherwise(F.coalesce(first, F.lit("")))
        text = F.when(tagged != memo, F.nullif(trim_all(tagged), F.lit(""))).otherwise(F.col("__triage_user_memo"))
    elif mode == "export":
        flag = F.when(F.col("__triage_annotated"), user).otherwise(highest)
        text = tagged
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return j.withColumns({flag_col: flag, memo_col: text}).drop("__triage_matches", "__triage_annotated", "__triage_user_flag", "__triage_user_memo")


def rule_applied_records(df: DataFrame, annotations: DataFrame, rules: DataFrame | list[dict], row_id_col: str = ROW_ID) -> DataFrame:
    """One row: rows without a user flag that any rule finds, in all data columns."""
    rest = unflagged_rows(df, annotations, row_id_col)
    hit = with_matching(rest, texts_of(df, None, row_id_col), compiled(rules), "__triage_matches")
    return hit.agg(F.count_if(F.size("__triage_matches") > 0).alias("ioc_applied_records"))
