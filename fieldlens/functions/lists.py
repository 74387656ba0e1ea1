"""Array and map helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fieldlens.functions.text import _c


def from_text(x, sep: str = ",") -> Column:
    """Separated text to an array; '' gives an empty array."""
    x = F.coalesce(_c(x), F.lit(""))
    return F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, sep))


def first_n_join(arr: Column, n: int, sep: str = ", ", more: str = "...") -> Column:
    """First ``n`` items joined, ``more`` appended when some are left out."""
    return F.concat(F.array_join(F.slice(arr, 1, n), sep),
                    F.when(F.size(arr) > n, F.lit(more)).otherwise(F.lit("")))


def head_with_more(arr: Column, total: Column, n: int, sep: str = ", ", template: str = " (+%d more)") -> Column:
    """First ``n`` items plus how many were left out of ``total``."""
    return F.concat(F.array_join(F.slice(arr, 1, n), sep),
                    F.when(total > n, F.format_string(template, total - n)).otherwise(F.lit("")))


def changed_fields(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Array of (field, old, new) for the fields whose values differ."""
    rows = F.array(*[F.struct(F.lit(k).alias("field"), a[k].alias("old"), b[k].alias("new")) for k in a])
    return F.filter(rows, lambda r: ~r["old"].eqNullSafe(r["new"]))


def jaccard_pct(a: Column, b: Column) -> Column:
    """100 * |a and b| / |a or b| of two word sets, one decimal; both empty 100, one empty 0."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(100.0))
            .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
            .otherwise(F.floor(F.lit(1000.0) * both / either + 0.5) / 10))


def words(text: Column) -> Column:
    """Blank-separated words of a text; no words for an empty text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def path_similarity(p: Column, q: Column) -> Column:
    """Share of equal positions of two paths of the same length."""
    a, b = F.split(p, "/"), F.split(q, "/")
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)),
                       F.lit(0), lambda acc, v: acc + v)
    return F.when(F.size(a) == F.size(b), same / F.size(a)).otherwise(F.lit(0.0))


def parse_ranges(spec: Column) -> Column:
    """'1-5,8,10-12' to an array of (part, first, last); unreadable parts have null bounds."""
    def one(part):
        part = F.trim(part)
        lo = F.regexp_extract(part, r"^(\d+)\s*(?:-\s*\d+)?$", 1)
        hi = F.regexp_extract(part, r"^\d+\s*-\s*(\d+)$", 1)
        first = F.when(lo != "", lo.try_cast("int"))
        last = F.when(hi != "", hi.try_cast("int")).otherwise(first)
        return F.struct(part.alias("part"), first.alias("first"), last.alias("last"))

    return F.transform(F.filter(F.split(spec, ","), lambda p: F.trim(p) != ""), one)


def merge_wrapped(lines: Column) -> Column:
    """Lines without a '+' prefix are appended to the line before; empty lines are dropped."""
    kept = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
    empty = F.array().cast("array<string>")
    return F.aggregate(
        kept, empty,
        lambda acc, x: F.when((F.size(acc) == 0) | x.startswith("+"), F.concat(acc, F.array(x))).otherwise(
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                     F.array(F.concat(F.try_element_at(acc, F.lit(-1)), F.lit(" "), x)))))
