"""Null-strict scores, safe arithmetic, ordered cascades, text rules.

Scores must stay unknown where an input is unknown, but Spark's greatest and least
skip nulls; clamp() therefore checks first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), x)))


def half_up(x: Column, digits: int = 2) -> Column:
    """Rounding half away from zero by floor; within a millionth of a half counts as a half.

    Sums in another order differ in their last bits; so they round alike all the same.  The price: a value
    up to 1e-6 (in units of the last digit) below a half is rounded up.
    """
    p = F.lit(float(10**digits))
    return F.signum(x) * F.floor(F.abs(x) * p + F.lit(0.500001)) / p


def whole(x: Column) -> Column:
    """A rounded number as text, without decimals; null stays null."""
    return half_up(x, 0).cast("long").cast("string")


def pct_change(now: Column, before: Column) -> Column:
    return F.try_divide(now - before, before) * 100


def months_between_starts(later: Column, earlier: Column) -> Column:
    """Month boundaries between two dates."""
    return (F.year(later) * 12 + F.month(later)) - (F.year(earlier) * 12 + F.month(earlier))


def first_match(rules: list[tuple[Column, object]], otherwise: object) -> Column:
    """The label of the first rule that holds; an unknown predicate does not hold."""
    out = F.when(rules[0][0], F.lit(rules[0][1]))
    for predicate, label in rules[1:]:
        out = out.when(predicate, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def looked_up(key: Column, found: dict, default: object) -> Column:
    """A small fixed table as a cascade: no join."""
    return first_match([(key == k, v) for k, v in found.items()], default)


def codes(rules: list[tuple[Column, str]]) -> Column:
    """The labels of all rules that hold, in their order."""
    return F.array_compact(F.array(*[F.when(p, F.lit(label)) for p, label in rules]))


def group(text: Column, pattern: str, k: int = 1) -> Column:
    """A regex group, null without a match."""
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))


#: What counts as a numeric claim, in any case of letters.
NUMERIC_CLAIM = r"(?i)\$\s?\d|\d+(\.\d+)?\s?%|\b\d{1,3}(,\d{3})+(\.\d+)?\b|\b\d+\.\d+\b|\b\d+\s?(million|billion|basis points|bps)\b"


def numeric_claim(text: Column) -> Column:
    return text.rlike(NUMERIC_CLAIM)


def price_text(text: Column) -> Column:
    """A price out of text such as "$1,234.50"; null where what remains is no number."""
    return F.regexp_replace(text, r"[$,\s]", "").try_cast("double")


#: Entities that are written out; the ampersand comes last, so that nothing is replaced twice.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def html_text(html: Column, least: int = 0) -> Column:
    """Visible text in lines that are not blank: no script, style, nav, header, footer, comments or tags.

    Null where fewer than `least` characters remain.
    """
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in ("script", "style", "nav", "header", "footer"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", "\n")
    for entity, char in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    lines = F.filter(F.transform(F.split(out, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\f]+", " "))), lambda x: x != "")
    text = F.array_join(lines, "\n")
    return F.when(F.char_length(text) >= least, text) if least else text
