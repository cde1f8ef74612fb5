"""Turns compiled queries into Columns over a table.

Row text is costly and needed once for each term, so it is bound once: the
predicate is a lambda over a one-element array.  Queries that only name columns
stay plain predicates, and read only those columns.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import Counter
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import column_text, row_text
from .query import Literal, Query


def scope_names(df: DataFrame, hidden: Iterable[str] = ()) -> dict[str, str]:
    """Lower-case name → column; of names equal up to case the last one counts."""
    return {c.lower(): c for c in df.columns if c not in set(hidden)}


class Texts:
    """Texts that literals look into, for one table and one choice of columns."""

    def __init__(self, df: DataFrame, columns: list[str], scopes: dict[str, str], text_col: str | None = None):
        self.df, self.columns, self.scopes, self.text_col = df, columns, scopes, text_col

    def row(self) -> Column:
        return F.col(self.text_col) if self.text_col else row_text(self.df, self.columns)

    def of(self, lit: Literal, bound: Column | None = None) -> Column | None:
        """The text that a literal looks into; None if there is no such column."""
        if lit.column is None:
            return bound["t"] if bound is not None else self.row()
        if lit.column not in self.scopes:
            return None
        return bound["c_" + lit.column] if bound is not None else column_text(self.df, self.scopes[lit.column])

    def struct(self, literals: list[Literal]) -> Column:
        fields = [self.row().alias("t")] if any(x.column is None for x in literals) else []
        for name in sorted({x.column for x in literals if x.column in self.scopes}):
            fields.append(column_text(self.df, self.scopes[name]).alias("c_" + name))
        return F.struct(*fields) if fields else F.struct(F.lit("").alias("t"))


def _literal(texts: Texts, lit: Literal, bound: Column | None) -> Column:
    text = texts.of(lit, bound) if lit.term else None
    hit = F.lit(False) if text is None else F.coalesce(F.contains(text, F.lit(lit.term)), F.lit(False))
    return ~hit if lit.negated else hit


def predicate(texts: Texts, query: Query, bound: Column | None = None) -> Column:
    """True where the query holds; never null.  False for a query without clauses."""
    whole = F.lit(False)
    for i, clause in enumerate(query.clauses):
        all_ = _literal(texts, clause[0], bound)
        for lit in clause[1:]:
            all_ = all_ & _literal(texts, lit, bound)
        whole = all_ if i == 0 else whole | all_
    return whole


def with_texts(texts: Texts, literals: list[Literal], body: Callable[[Column], Column]) -> Column:
    """``body`` of a struct of the texts that the literals need, each computed once a row."""
    return F.transform(F.array(texts.struct(literals)), body)[0]


def row_predicate(texts: Texts, query: Query) -> Column:
    """The predicate of one query, with the row text bound where several terms look into it."""
    plain = texts.text_col is not None or sum(x.column is None for x in query.literals) <= 1
    if plain:
        return predicate(texts, query)
    return F.exists(F.array(texts.struct(query.literals)), lambda b: predicate(texts, query, b))


MATCH = "struct<rule_no:int,flag:string,rank:int,tag:string>"
_CLAUSE = "struct<r:int,p:array<int>,n:array<int>>"


def _escaped(text: str) -> str:
    return "".join(c if c.isalnum() or ord(c) > 127 else "\\x{%x}" % ord(c) for c in text)


def _trie_pattern(terms: list[str]) -> str:
    """A regular expression for the longest of some terms that starts at a place.

    Terms share their beginnings, so that a place is left after the first
    character that no term goes on with, however many terms there are."""

    def branch(some: list[str]) -> str:
        """``some`` are distinct and sorted."""
        ends, groups = some[0] == "", {}
        for t in some[ends:]:
            groups.setdefault(t[0], []).append(t)
        made = []
        for group in groups.values():
            shared = os.path.commonprefix([group[0], group[-1]])
            made.append(_escaped(shared) + (branch([t[len(shared) :] for t in group]) if len(group) > 1 else ""))
        return "(?:" + "|".join(made) + ")" + ("?" if ends else "") if made else ""

    return branch(sorted(set(terms)))


class RuleIndex:
    """Rules as an index from literals to clauses, built on the driver.

    Every distinct (column, term) is looked for once in a row: all terms of a
    column are one trie, of which a scan of the text gives the longest term at
    every place; the terms it starts with are there too.  What is found leads to
    the clauses that have it as their key (of a clause's positive literals the
    one in the fewest clauses), and these are decided by what else was found.
    Clauses without positive literals are always looked at.  So the work for a
    row follows its text and its finds, not the number of rules."""

    def __init__(self, texts: Texts, rules: list[dict]):
        self.rules, self.ids = rules, {}
        clauses, uses = [], Counter()
        for r, rule in enumerate(rules, 1):
            for clause in rule["query"].clauses:
                known = lambda x: bool(x.term) and (x.column is None or x.column in texts.scopes)
                if all(known(x) or x.negated for x in clause):
                    pos, neg = ({self.ids.setdefault((x.column, x.term), len(self.ids)) for x in clause if known(x) and x.negated == no} for no in (False, True))
                    clauses.append({"r": r, "p": sorted(pos), "n": sorted(neg)})
                    uses.update(pos)
        self.always = [c for c in clauses if not c["p"]]
        self.keyed: list[list[dict]] = [[] for _ in self.ids]
        for c in clauses:
            if c["p"]:
                key = min(c["p"], key=lambda i: (uses[i], i))
                self.keyed[key].append(c | {"p": [i for i in c["p"] if i != key]})
        self.terms: dict[str | None, dict[str, int]] = {}
        for (column, term), i in self.ids.items():
            self.terms.setdefault(column, {})[term] = i

    def _found(self, column: str | None, text: Column) -> Column:
        """Numbers of the literals of one column that its text holds."""
        terms = self.terms[column]
        every = F.array_distinct(F.regexp_extract_all(text, F.lit("(?=(" + _trie_pattern(list(terms)) + "))"), F.lit(1)))
        size = 1 << max(0, len(terms) - 1).bit_length()
        buckets: list[dict[str, list[int]]] = [{} for _ in range(size)]
        for t in terms:
            buckets[zlib.crc32(t.encode()) % size][t] = [terms[t[:n]] for n in range(1, len(t) + 1) if t[:n] in terms]
        table = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,array<int>>>")
        return F.flatten(F.transform(every, lambda t: F.element_at(F.get(table, F.crc32(t.cast("binary")) % size), t)))

    def finds(self, text_of: Callable[[str | None], Column]) -> Column:
        """Numbers of all literals that a row holds."""
        some = [self._found(c, text_of(c)) for c in self.terms]
        return F.array_distinct(F.concat(*some)) if some else F.array().cast("array<int>")

    def holding(self, found: Column) -> Column:
        """Numbers (from 1 on) of the rules that hold, upward."""
        keyed = F.from_json(F.lit(json.dumps(self.keyed)), f"array<array<{_CLAUSE}>>")
        always = F.from_json(F.lit(json.dumps(self.always)), f"array<{_CLAUSE}>")
        led_to = F.flatten(F.transform(found, lambda i: F.get(keyed, i)))
        tried = F.concat(always, led_to) if self.always else led_to
        holds = lambda c: F.forall(c["p"], lambda i: F.array_contains(found, i)) & ~F.exists(c["n"], lambda i: F.array_contains(found, i))
        return F.sort_array(F.array_distinct(F.transform(F.filter(tried, holds), lambda c: c["r"])))

    def matches(self, numbers: Column) -> Column:
        heads = F.from_json(F.lit(json.dumps([{k: r[k] for k in ("rule_no", "flag", "rank", "tag")} for r in self.rules])), f"array<{MATCH}>")
        return F.transform(numbers, lambda i: F.element_at(heads, i))


def matching(texts: Texts, rules: list[dict]) -> Column:
    """Array of (rule_no, flag, rank, tag) of the rules whose query holds, in stored order.

    ``rules`` are dicts with these keys and a compiled ``query``.  The plan's
    size does not grow with the rules: they are literals."""
    rules = [r for r in rules if not r["query"].blank]
    if not rules:
        return F.array().cast(f"array<{MATCH}>")
    index = RuleIndex(texts, rules)
    literals = [Literal(c, t) for c, t in index.ids]
    found = with_texts(texts, literals, lambda b: index.finds(lambda c: F.coalesce(b["t"] if c is None else b["c_" + c], F.lit(""))))
    return F.transform(F.array(found), lambda f: index.matches(index.holding(f)))[0]


def with_matching(df: DataFrame, texts: Texts, rules: list[dict], out: str) -> DataFrame:
    """Adds ``matching`` as a column.

    What is looked at more than once (the finds, the numbers of the rules that
    hold) is a column of its own, so that it is worked out once a row."""
    rules = [r for r in rules if not r["query"].blank]
    if not rules:
        return df.withColumn(out, matching(texts, rules))
    index = RuleIndex(texts, rules)
    text_of = lambda c: F.coalesce(texts.row() if c is None else column_text(texts.df, texts.scopes[c]), F.lit(""))
    wide = df.withColumn("__triage_found", index.finds(text_of))
    wide = wide.withColumn("__triage_holding", index.holding(F.col("__triage_found")))
    return wide.withColumn(out, index.matches(F.col("__triage_holding"))).drop("__triage_found", "__triage_holding")
