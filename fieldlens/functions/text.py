"""String helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank(x: ColumnOrName) -> Column:
    return F.coalesce(_c(x), F.lit(""))


def collapse_ws(x: ColumnOrName) -> Column:
    """Runs of blanks become one space, ends trimmed, null becomes ''."""
    return F.trim(F.regexp_replace(blank(x), r"\s+", " "))


def strip_ns(x: ColumnOrName) -> Column:
    """Drop a ``{uri}`` or ``prefix:`` in front of a name."""
    return F.regexp_replace(blank(x), r"^(\{[^}]*\}|[^:/{}]*:)", "")


def last_segment(x: ColumnOrName, sep: str = "/") -> Column:
    return F.substring_index(_c(x), sep, -1)


def parent_path(x: ColumnOrName) -> Column:
    """Path without its last segment; '' for a top-level path."""
    return F.regexp_replace(_c(x), r"/?[^/]*$", "")


def depth(x: ColumnOrName) -> Column:
    return F.size(F.split(_c(x), "/")) - 1


def truncate(x: ColumnOrName, n: int, suffix: str = "") -> Column:
    x = _c(x)
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit(suffix))).otherwise(x)


def or_none(x: ColumnOrName) -> Column:
    """Empty and null values shown as None."""
    return F.when(blank(x) == "", F.lit("None")).otherwise(_c(x))


def matches(x: ColumnOrName, pattern: str) -> Column:
    return F.trim(_c(x)).rlike(pattern)


def normalise_rule(x: ColumnOrName) -> Column:
    return collapse_ws(F.lower(blank(x)))


def rules_differ(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Case- and blank-insensitive inequality; two empty texts are the same."""
    return normalise_rule(a) != normalise_rule(b)


def norm_mult(x: ColumnOrName) -> Column:
    return F.replace(F.replace(blank(x), F.lit("unbounded"), F.lit("n")), F.lit(" "), F.lit(""))


def mult_differs(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Multiplicities disagree; a guide without a value never disagrees."""
    return (blank(b) != "") & (norm_mult(a) != norm_mult(b))


def multiplicity(lo: ColumnOrName, hi: ColumnOrName) -> Column:
    return F.concat(_c(lo), F.lit(".."), _c(hi))


def min_of(mult: ColumnOrName) -> Column:
    return F.trim(F.split_part(F.trim(blank(mult)), F.lit(".."), F.lit(1)))


def length_text(lo: ColumnOrName, hi: ColumnOrName) -> Column:
    """'a .. b', or '1 .. b' when only a maximum is known."""
    lo, hi = blank(lo), blank(hi)
    return F.when(hi == "", F.lit("")).otherwise(
        F.concat(F.when(lo == "", F.lit("1")).otherwise(lo), F.lit(" .. "), hi))


def yes_no(flag: Column) -> Column:
    return F.when(flag, F.lit("Yes")).otherwise(F.lit("No"))


def indent(name: ColumnOrName, level: ColumnOrName, unit: str = "  ") -> Column:
    return F.concat(F.expr(f"repeat('{unit}', {level})") if isinstance(level, str)
                    else F.repeat(F.lit(unit), level), _c(name))


def pad_or_cut(x: ColumnOrName, lo: Column, hi: Column) -> Column:
    """Pad with X up to ``lo`` characters, cut at ``hi``."""
    x = _c(x)
    padded = F.when(F.length(x) < lo, F.rpad(x, lo, F.lit("X"))).otherwise(x)
    return F.left(padded, hi)


def dotted(x: ColumnOrName) -> Column:
    """Sheet name to message name."""
    return F.replace(_c(x), F.lit("_"), F.lit("."))


def pct(n: Column, total: Column, dp: int = 1) -> Column:
    """Percent text, '0%' when there is nothing to divide by."""
    scale = 10.0 ** dp
    value = F.floor(F.try_divide(n * 100.0, total) * scale + 0.5) / scale
    return F.when(total > 0, F.format_string(f"%.{dp}f%%", value)).otherwise(F.lit("0%"))


def decimals(x: ColumnOrName) -> Column:
    """Characters after the first point of a lexical number."""
    return F.length(F.split_part(blank(x), F.lit("."), F.lit(2)))


def to_number(x: ColumnOrName) -> Column:
    """Double for a plain decimal or exponent literal, else null."""
    x = F.trim(blank(x))
    return F.when(x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), x.try_cast("double"))


def first_match(x: ColumnOrName, rules) -> Column:
    """Label of the first (pattern, label) whose pattern is found, case-insensitive; '' if none."""
    x = _c(x)
    out = F.lit("")
    for pattern, label in reversed(tuple(rules)):
        out = F.when(x.rlike("(?i)" + pattern), F.lit(label)).otherwise(out)
    return out


def all_matches(x: ColumnOrName, rules, sep: str = "  ") -> Column:
    """Every label whose pattern is found, in rule order."""
    x = _c(x)
    return F.array_join(F.array_compact(F.array(
        *[F.when(x.rlike(pattern), F.lit(label)) for pattern, label in rules])), sep)


def pointer_unescape(x: ColumnOrName) -> Column:
    """JSON pointer segment: ``~1`` is ``/``, then ``~0`` is ``~``."""
    return F.replace(F.replace(_c(x), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def safe_name(x: ColumnOrName, maxlen: int = 31, reserved: str = r"[\\/*?:\[\]]", fill: str = "_") -> Column:
    """Sheet or file key: reserved characters replaced, blanks collapsed and trimmed, cut at ``maxlen``."""
    return F.left(F.trim(F.regexp_replace(F.regexp_replace(_c(x), reserved, fill), r"\s+", " ")), F.lit(maxlen))
