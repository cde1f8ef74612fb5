"""Texts of column values: for searching, for display and for sorting.

Everything is a Column of built-in expressions; no Python runs on rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def field(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def trim_all(c: Column) -> Column:
    """Without any Unicode white space at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _fewer(number: Column, size: Column) -> Column:
    """(digits, point) with one digit fewer where that still is the same double, else as given."""
    digits, point = number["d"], number["p"]
    n = F.length(digits)
    head = F.substring(digits, F.lit(1), n - 1)
    up = (head.cast("decimal(20,0)") + 1).cast("decimal(20,0)").cast("string")
    is_it = lambda d: F.coalesce(F.concat(d, F.lit("E"), (point - n + 1).cast("string")).try_cast("double") == size, F.lit(False))
    down_made = F.struct(F.rtrim(head, F.lit("0")).alias("d"), point.alias("p"))
    up_made = F.struct(F.rtrim(up, F.lit("0")).alias("d"), (point + F.length(up) - n + 1).alias("p"))
    last = F.substring(digits, -1, 1)
    # of a 5 whole numbers tell on which side of it they are
    beyond = F.concat(digits, F.repeat(F.lit("0"), point - n)).try_cast("decimal(38,0)") <= size.try_cast("long").cast("decimal(38,0)")
    nearer = (last > "5") | ((last == "5") & ((size < 9e15) | F.coalesce(beyond, F.lit(True))))
    # the language's own text may have a digit too many: a 16th or later one, and the second one of the smallest doubles
    long = (n >= 16) | ((n == 2) & (size < 1e-300))
    return F.when(long & nearer & is_it(up), up_made).when(long & is_it(head), down_made).when(long & is_it(up), up_made).otherwise(number)


def _shifted(size: Column) -> Column:
    """The shortest digits of a positive double with the point moved to its place, without decimals in between."""
    s = size.cast("string")
    whole, part = F.regexp_extract(s, r"^(\d+)", 1), F.regexp_extract(s, r"\.(\d+)", 1)
    power = F.coalesce(F.nullif(F.regexp_extract(s, r"E(-?\d+)$", 1), F.lit("")).cast("int"), F.lit(0))
    every = F.concat(whole, part)
    digits = F.ltrim(every, F.lit("0"))
    point = F.length(whole) + power - (F.length(every) - F.length(digits))
    bound = lambda c, f: F.transform(F.array(c), f)[0]  # noqa: E731  each step looks at the last one several times
    number = F.struct(F.rtrim(digits, F.lit("0")).alias("d"), point.alias("p"))
    for _ in range(2):
        number = bound(number, lambda x: _fewer(x, size))

    def written(x: Column) -> Column:
        d, at, n = x["d"], x["p"], F.length(x["d"])
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -at), d)
        return F.when(at <= 0, small).when(at >= n, F.concat(d, F.repeat(F.lit("0"), at - n))).otherwise(F.concat(F.substring(d, F.lit(1), at), F.lit("."), F.substring(d, at + 1, n)))

    return bound(number, written)


def plain_double(c: Column) -> Column:
    """Shortest decimal text of a double, without exponent and without a trailing ``.0``, however large or small."""
    x = c.cast("double")
    s = x.cast("string")
    special = F.when(F.isnan(x), "NaN").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    short = F.when(F.endswith(s, F.lit(".0")), F.substr(s, F.lit(1), F.length(s) - 2)).otherwise(s)
    # only texts with an exponent or very many digits take the long way
    plain = ~F.contains(s, F.lit("E")) & (F.length(s) < 17)
    signed = F.concat(F.when(x < 0, "-").otherwise(""), _shifted(F.abs(x)))
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.when(plain, short).otherwise(signed)).otherwise(special)


def search_text(c: Column, kind: T.DataType) -> Column:
    """Text of a value as searches see it; null stays null."""
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return c.cast("string")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return plain_double(c)
    if isinstance(kind, T.ArrayType):
        parts = F.filter(F.transform(c, lambda x: search_text(x, kind.elementType)), lambda x: x.isNotNull())
        return F.when(F.size(parts) > 0, F.array_join(parts, ","))
    if isinstance(kind, (T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def column_text(df: DataFrame, name: str) -> Column:
    """Lower-case search text of one column."""
    return F.lower(search_text(field(name), df.schema[name].dataType))


def row_text(df: DataFrame, columns: list[str]) -> Column:
    """Lower-case search texts of the columns, empty ones skipped, joined by one space; never null."""
    return F.concat_ws(" ", *[F.nullif(column_text(df, c), F.lit("")) for c in columns]) if columns else F.lit("")


def _json_number(c: Column) -> Column:
    """A double as JSON writes it: ``1.0``, ``1e16``, ``1.5e-7``; null for what is not finite."""
    x = c.cast("double")
    p, s = plain_double(c), x.cast("string")
    near = ((F.abs(x) >= 1e-5) & (F.abs(x) < 1e16)) | (x == 0)
    plain = F.when(p.contains("."), p).otherwise(F.concat(p, F.lit(".0")))
    far = F.lower(F.regexp_replace(s, r"\.0E", "E"))
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.when(~F.contains(s, F.lit("E")), s).when(near, plain).otherwise(far))


def _json(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.coalesce(_json_number(c), F.lit("null"))
    if isinstance(kind, T.ArrayType):
        inner = F.transform(c, lambda x: _json(x, kind.elementType))
        return F.when(c.isNull(), "null").otherwise(F.concat(F.lit("["), F.array_join(inner, ","), F.lit("]")))
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.BooleanType)):
        return F.coalesce(c.cast("string"), F.lit("null"))
    text = F.regexp_replace(F.to_json(F.array(c.cast("string"))), r"^\[|\]$", "")
    return F.when(c.isNull(), "null").otherwise(text)


def display_text(c: Column, kind: T.DataType) -> Column:
    """Text of a value as a table shows it; null is empty."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.coalesce(_json_number(c), F.lit(""))
    if isinstance(kind, T.ArrayType):
        return F.when(c.isNull(), "").otherwise(_json(c, kind))
    if isinstance(kind, (T.MapType, T.StructType)):
        return F.coalesce(F.to_json(c), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def display_length(c: Column, kind: T.DataType) -> Column:
    """Characters of the display text."""
    return F.char_length(display_text(c, kind))


def _text_keys(t: Column) -> tuple[Column, Column, Column]:
    number = F.when(t.rlike(_NUMBER), t.try_cast("double"))
    kind = F.when(number.isNotNull(), 0).when(t.isNull(), 1).otherwise(2)
    return kind, number, F.when(number.isNull(), F.lower(t))


def _sort_text(c: Column, kind: T.DataType) -> Column:
    return F.replace(F.replace(trim_all(search_text(c, kind)), F.lit(","), F.lit("")), F.lit("\u00a0"), F.lit(""))


def sort_keys(c: Column, kind: T.DataType) -> tuple[Column, Column, Column]:
    """(class, number, text) of a value for the mixed sort: numbers, then nulls, then texts.

    Numeric columns are numbers as they are, without a detour over text; what is
    not finite sorts as text."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)):
        return F.when(c.isNull(), 1).otherwise(0), c.cast("double"), F.lit(None).cast("string")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        x = c.cast("double")
        finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
        text = F.when(~finite, F.when(F.isnan(x), "nan").when(x > 0, "inf").otherwise("-inf"))
        return F.when(x.isNull(), 1).when(finite, 0).otherwise(2), F.when(finite, x), text
    return _text_keys(_sort_text(c, kind))


def sort_key(c: Column, kind: T.DataType) -> Column:
    """The sort keys as one struct; the text of a value is worked out once."""
    named = lambda keys: F.struct(keys[0].alias("c"), keys[1].alias("n"), keys[2].alias("t"))
    if isinstance(kind, T.NumericType):
        return named(sort_keys(c, kind))
    return F.transform(F.array(_sort_text(c, kind)), lambda t: named(_text_keys(t)))[0]


def sort_number(c: Column, kind: T.DataType) -> Column:
    """The number that the mixed sort sees in a value, or null."""
    return sort_keys(c, kind)[1]


def sanitize_memo(c: Column) -> Column:
    """Without control characters (tab, line feed and carriage return stay) and without ``<...>``."""
    return F.regexp_replace(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), r"<[^>]*>", "")


def append_tag(memo: Column, tokens: Column) -> Column:
    """``memo`` with every token that it does not hold yet, one space between."""

    def add(m: Column, t: Column) -> Column:
        return F.when(F.contains(m, t), m).when((m == "") | F.endswith(m, F.lit(" ")), F.concat(m, t)).otherwise(F.concat(m, F.lit(" "), t))

    return F.aggregate(tokens, memo, add)


def csv_escape(c: Column) -> Column:
    """A CSV field: quoted, with doubled quotes, where it holds a quote, comma or line break."""
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.rlike(r'[",\n\r]'), quoted).otherwise(c)
