"""Personal data by bootstrapped contextual extraction (DataFrame operations only).

Fixed patterns find seeds: e-mail and IP addresses, card and phone numbers that
pass their checks.  The words around seeds are lexical patterns, and these, with
the identifiers that they surround, form a graph.  Spark scores it in rounds: a
pattern's confidence is what its distinct identifiers are worth (seeds 1000)
divided by one more than their number, so that a pattern is trusted only if it
surrounds many seeds and hardly anything else; an identifier is worth the best
trusted pattern around it, and then lends that worth to its other patterns.
Identifiers that no fixed pattern finds (written-out addresses, numbers without
prefix or with a wrong check digit, addresses of version 6) are discovered that
way, and marked wherever they stand.  Base spans always stay.

Texts are read in one pass that keeps what was found, its distance from the
find before it and 48 characters on both sides; places are running sums over
those distances.  Everything after that is joins and aggregations over these
small rows.  Regular expressions are possessive and start at the ends of runs
only, so they are linear in the text, however long.

Defined results: null and empty texts hold nothing (the digest of no span is
that of the empty text); very long texts are read whole; repeated rows and rows
without doc_id are separate documents, numbered when the finds are stored;
spans of two kinds may overlap, discovered ones never overlap base spans; an
identifier that could be of two kinds takes the one with more confidence, then
the first as listed; further columns may have any names; an empty table gives
no rows.  ``n_*`` count base spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone")
#: What a pattern must be worth, in thousandths, and how many distinct seeds it must surround.
TRUST = 800
LEAST_SEEDS = 4
ROUNDS = 4
CONTEXT = 48

# A run is only entered at its start or where the find before ended (\G), which finds the same as
# trying every place: a match from inside a run would also be one from its start.
_MAIL = "[A-Za-z0-9._%+-]"
_AT = r"(?:\x20?[\[({]\x20?(?:at|AT|@)\x20?[\])}]\x20?|\x20(?:at|AT)\x20)"
_DOT = r"(?:\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?|\x20(?:dot|DOT)\x20|\.)"
#: The base kinds, in order, and after them what else may be an identifier: written-out e-mail addresses, addresses of version 6, chains of digits.
PATTERNS = (
    rf"(?:\G|(?<!{_MAIL})){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    r"[0-9]++(?:[\x20-][0-9]++)*+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    rf"(?<!{_MAIL}){_MAIL}++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}+(?::{1,2}+[0-9A-Fa-f]{1,4}+){2,7}+(?![0-9A-Za-z:])",
    r"(?<![0-9A-Za-z])(?:\((?=[0-9]))?+[0-9]++(?:[\x20().-]{1,2}+[0-9]++)*+",
)
_LOOSE_MAIL, _LOOSE_IP, _CHAIN = 4, 5, 6
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


def _may_hold(text: Column, kind: int) -> Column:
    """A quick look whether a text can hold a kind at all."""
    if kind == 0:
        return F.contains(text, F.lit("@"))
    if kind == 3:
        return F.contains(text, F.lit("+"))
    if kind == _LOOSE_IP:
        return F.contains(text, F.lit(":"))
    return text.rlike("[0-9]") if kind != _LOOSE_MAIL else F.lit(True)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def finds(docs: DataFrame) -> DataFrame:
    """doc_id and ``hits`` of every row: for each pattern its matches in order (kind, j, gap before, length, text, what stands before and after)."""
    text = F.col("text")
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    n = range(len(PATTERNS))
    d = d.select("doc_id", *[F.when(_may_hold(text, k), F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0))).otherwise(none).alias(f"m{k}") for k in n], "text")
    d = d.select("doc_id", *[f"m{k}" for k in n], *[F.when(F.size(f"m{k}") > 0, F.split("text", PATTERNS[k], -1)).otherwise(none).alias(f"p{k}") for k in n])
    return d.select("doc_id", F.concat(*[_hits(k) for k in n]).alias("hits"))


def _hits(k: int) -> Column:
    """The matches of one pattern with the pieces of text around them (columns m and p of this pattern)."""
    none = F.array().cast("array<string>")
    after = F.when(F.size(f"p{k}") > 0, F.slice(f"p{k}", F.lit(2), F.size(f"p{k}"))).otherwise(none)
    # the last piece has no match after it
    z = F.arrays_zip(F.slice(f"p{k}", F.lit(1), F.size(f"m{k}")).alias("p"), F.col(f"m{k}").alias("m"), after.alias("q"))
    # chains of few or very many digits only count for distances
    text = lambda m: F.when(F.length(_digits(m)).between(7, 19), m) if k == _CHAIN else m
    one = lambda x, j: F.struct(
        F.lit(k).alias("kind"), j.alias("j"), F.char_length(x["p"]).alias("gap"), F.char_length(x["m"]).alias("len"), text(x["m"]).alias("m"),
        F.substring(x["p"], -CONTEXT, CONTEXT).alias("before"), F.substring(x["q"], 1, CONTEXT).alias("after"),
    )
    return F.transform(z, one)


def _valid(kind: Column, m: Column) -> Column:
    """Whether a match of a base pattern passes the checks of its kind."""
    n = F.length(_digits(m))
    card = F.when(n.between(14, 19), F.call_function("luhn_check", _digits(m))).otherwise(False)
    return F.when(kind == 0, True).when(kind == 1, m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")).when(kind == 2, card).when(kind == 3, n.between(10, 15)).otherwise(False)


def places(stored: DataFrame) -> DataFrame:
    """row, kind, start, end, m, before, after, base of every stored find; base ones have passed their checks, others are candidates."""
    x = stored.select("row", F.explode("hits").alias("x")).select("row", "x.*")
    so_far = F.sum(F.col("gap").cast("long") + F.col("len")).over(W.partitionBy("row", "kind").orderBy("j").rowsBetween(W.unboundedPreceding, 0))
    x = x.withColumn("end", so_far).withColumn("start", F.col("end") - F.col("len"))
    base = _valid(F.col("kind"), F.col("m"))
    return x.withColumn("base", base).filter("base or (kind > 3 and m is not null)").select("row", "kind", "start", "end", "m", "before", "after", "base")


def candidates(spans: DataFrame) -> DataFrame:
    """The finds of loose patterns that overlap no base span of their text."""
    up = W.partitionBy("row").orderBy(F.asc("start"), F.desc("base")).rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("row").orderBy(F.desc("start"), F.desc("base")).rowsBetween(W.unboundedPreceding, 0)
    only = lambda c: F.when(F.col("base"), F.col(c))
    x = spans.withColumn("ended", F.max(only("end")).over(up)).withColumn("next", F.min(only("start")).over(down))
    free = (F.coalesce("ended", F.lit(0)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("end")))
    return x.filter(~F.col("base") & free).drop("ended", "next")


def _kinds(kind: Column, m: Column) -> Column:
    """The base kinds that a find may be of."""
    n = F.length(_digits(m))
    chain = F.filter(F.array(F.when(n.between(14, 19), 2), F.when(n.between(7, 15), 3)), lambda k: k.isNotNull())
    return F.when(kind < _LOOSE_MAIL, F.array(kind)).when(kind == _LOOSE_MAIL, F.array(F.lit(0))).when(kind == _LOOSE_IP, F.array(F.lit(1))).otherwise(chain)


def _identifier(kind: Column, m: Column) -> Column:
    return F.when(kind.isin(2, 3, _CHAIN), _digits(m)).otherwise(F.lower(m))


def patterns(before: Column, after: Column) -> Column:
    """The lexical patterns of a place: the word before, the two words before, the words on both sides; digits are alike."""
    norm = lambda c: F.regexp_replace(F.lower(c), "[0-9]+", "0")
    words = F.filter(F.split(norm(before), r"\s+"), lambda w: w != "")
    one, two = F.try_element_at(words, F.lit(-1)), F.try_element_at(words, F.lit(-2))
    right = F.try_element_at(F.filter(F.split(norm(after), r"\s+"), lambda w: w != ""), F.lit(1))
    lexical = lambda w: w.rlike(r"\p{L}")
    made = F.array(
        F.when(lexical(one), F.concat(F.lit("1 "), one)), F.when(lexical(one) | lexical(two), F.concat(F.lit("2 "), two, F.lit(" "), one)),
        F.when(lexical(one) | lexical(right), F.concat(F.lit("3 "), one, F.lit(" _ "), right)),
    )
    return F.filter(made, lambda p: p.isNotNull())


def graph(spans: DataFrame) -> DataFrame:
    """kind, pattern, id, seed: distinct edges between patterns with enough seeds and the identifiers that they surround."""
    x = spans.select(F.explode(_kinds(F.col("kind"), F.col("m"))).alias("kind"), _identifier(F.col("kind"), F.col("m")).alias("id"), patterns(F.col("before"), F.col("after")).alias("p"), "base")
    x = x.select("kind", "id", F.explode("p").alias("pattern"), "base").groupBy("kind", "pattern", "id").agg(F.max("base").alias("seed"))
    enough = x.groupBy("kind", "pattern").agg(F.count_if("seed").alias("seeds")).filter(F.col("seeds") >= LEAST_SEEDS).select("kind", "pattern")
    return x.join(enough, ["kind", "pattern"])


def discovered(edges: DataFrame, rounds: int = ROUNDS, trust: int = TRUST) -> DataFrame:
    """kind, id, worth of the identifiers that trusted patterns surround and that are no seeds, after some rounds over the graph."""
    edges = materialize(edges.withColumn("worth", F.when(F.col("seed"), 1000).otherwise(0).cast("long")), "pii-graph")
    found = None
    for _ in range(rounds):
        score = F.floor(F.sum("worth") / (F.count("*") + 1)).cast("long")
        trusted = edges.groupBy("kind", "pattern").agg(score.alias("score")).filter(F.col("score") >= trust)
        ids = edges.filter(~F.col("seed")).join(trusted, ["kind", "pattern"]).groupBy("kind", "id").agg(F.max("score").alias("worth"))
        before, found = found, materialize(ids, "pii-found")
        same = found.agg(F.count("*"), F.sum("worth")).first()
        if same[0] == 0 or (before is not None and same == before.agg(F.count("*"), F.sum("worth")).first()):
            break
        edges = edges.drop("worth").join(found.withColumnRenamed("worth", "new"), ["kind", "id"], "left")
        edges = materialize(edges.withColumn("worth", F.when(F.col("seed"), 1000).otherwise(F.coalesce("new", F.lit(0))).cast("long")).drop("new"), "pii-graph")
    return found


def personal_data(docs: DataFrame, rounds: int = ROUNDS, trust: int = TRUST) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base and all spans of every row: arrays of (start, kind, end), by start, then kind as listed."""
    stored = materialize(finds(docs).withColumn("row", F.monotonically_increasing_id()), "pii-finds")
    spans = materialize(places(stored), "pii-places")
    loose = materialize(candidates(spans), "pii-candidates")
    found = discovered(graph(spans.filter("base").unionByName(loose)), rounds, trust)
    at = loose.select("row", "start", "end", F.explode(_kinds(F.col("kind"), F.col("m"))).alias("kind"), _identifier(F.col("kind"), F.col("m")).alias("id")).join(found, ["kind", "id"])
    best = at.groupBy("row", "start", "end").agg(F.min(F.struct((-F.col("worth")).alias("w"), "kind")).alias("b")).select("row", "start", F.col("b.kind").alias("kind"), "end", F.lit(False).alias("base"))
    every = spans.filter("base").select("row", "start", "kind", "end", "base").unionByName(best)
    span = F.struct("start", "kind", "end")
    by_row = every.groupBy("row").agg(F.sort_array(F.collect_list(F.when(F.col("base"), span))).alias("base_spans"), F.sort_array(F.collect_list(span)).alias("spans"))  # spans of one text
    out = stored.select("row", "doc_id").join(by_row, "row", "left")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("base_spans", "spans")})
    kinds = F.transform("base_spans", lambda s: s["kind"])
    return out.select("doc_id", *[(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)], "base_spans", "spans")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return p.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(span_text(F.col("base_spans")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
