"""Compiles search text to an OR of ANDs of literals.

The syntax has no parentheses and NOT binds tighter than AND, AND tighter than
OR, so every query is a list of clauses of literals.  Terms are separated by
white space (AND) or ``|`` (OR); ``-`` before a term negates it; ``"..."`` is a
phrase; ``col:term`` looks in one column, and goes on over ``|``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Literal:
    """``term`` in the text of ``column`` (None: of the row), or not in it."""

    column: str | None
    term: str
    negated: bool = False

    def __str__(self) -> str:
        where = "" if self.column is None else f"{self.column}/"
        return ("!" if self.negated else "") + where + (self.term or "(empty)")


@dataclass(frozen=True)
class Query:
    clauses: tuple[tuple[Literal, ...], ...]

    @property
    def blank(self) -> bool:
        """No literal has a term: the query says nothing."""
        return not any(x.term for clause in self.clauses for x in clause)

    @property
    def literals(self) -> list[Literal]:
        return [x for clause in self.clauses for x in clause]

    def __str__(self) -> str:
        return " ; ".join(" & ".join(map(str, c)) for c in self.clauses)


_SCAN = re.compile(r'"(?P<phrase>[^"]*)(?:"|$)|(?P<bar>\|)|(?P<word>[^\s"|]+)')


def _parts(text: str) -> list[tuple[str, str]]:
    """(kind, text) of phrases, bars and words; empty phrases are dropped."""
    found = [(m.lastgroup, m[m.lastgroup].strip()) for m in _SCAN.finditer(text)]
    return [(kind, t) for kind, t in found if t]


def _operands(parts: list[tuple[str, str]]) -> list[Literal | None]:
    """Literals with the scopes they name themselves; None for a bar."""
    out: list[Literal | None] = []
    skip = False
    for i, (kind, text) in enumerate(parts):
        if skip:
            skip = False
        elif kind == "bar":
            out.append(None)
        elif kind == "phrase":
            out.append(Literal(None, text.lower()))
        elif text.endswith(":") and parts[i + 1 : i + 2] and parts[i + 1][0] == "phrase":
            # a scope and a phrase; a leading hyphen is part of the column's name here
            out.append(Literal(text[:-1].lower(), parts[i + 1][1].lower()))
            skip = True
        else:
            negated = len(text) > 1 and text[0] == "-"
            column, colon, term = text[negated:].partition(":")
            out.append(Literal(column.lower(), term.lower(), negated) if colon else Literal(None, column.lower(), negated))
    return out


def compile_query(text: str) -> Query:
    """The query of a search text.

    A bar hands the column of the operand before it to the next operand without
    a column of its own; operands that have one leave it pending."""
    clauses: list[list[Literal]] = [[]]
    pending = last = None
    for x in _operands(_parts(text)):
        if x is None:
            clauses.append([])
            pending = last
            continue
        if x.column is None and pending is not None:
            x, pending = Literal(pending, x.term, x.negated), None
        last = x.column
        clauses[-1].append(x)
    return Query(tuple(tuple(c) for c in clauses if c))
