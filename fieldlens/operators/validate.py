"""Message validation by rule tables. All rules but the catalog checks are local to a node row."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from fieldlens import fixed
from fieldlens.functions import text as t
from fieldlens.operators import joins
from fieldlens.operators.flatten import RULE_COLUMNS, flatten_xml

ISSUE = ("severity", "category", "path", "element", "message", "value", "expected", "suggestion")


def _issue(when: Column, severity, category: str, message: Column, value=None, expected=None, suggestion=None,
           path: Column | None = None) -> Column:
    text = lambda x: (F.lit(None).cast("string") if x is None else F.lit(x) if isinstance(x, str) else x)
    return F.when(when, F.struct(
        text(severity).alias("severity"), F.lit(category).alias("category"), (F.col("path") if path is None else path).alias("path"),
        F.col("tag").alias("element"), text(message).alias("message"), text(value).alias("value"),
        text(expected).alias("expected"), text(suggestion).alias("suggestion")))


def either_or_issues(rules: Sequence = fixed.EITHER_OR) -> list[Column]:
    """A parent with more exclusive children than allowed; direct children only."""
    out = []
    for parent, children, rule, at_most, _ in rules:
        wanted = F.array(*[F.lit(c) for c in children])
        found = F.filter(wanted, lambda c: F.array_contains("child_tags", c))
        names = F.array_join(found, ", ")
        out.append(_issue((F.col("tag") == parent) & (F.size(found) > at_most), "ERROR", "Business Rule",
                          F.concat(F.lit("Multiple mutually exclusive elements found: "), names),
                          expected="Only one of: " + ", ".join(children),
                          suggestion=F.concat(F.lit("Remove one of: "), names, F.lit(". " + rule))))
    return out


def format_issues(tag_formats: dict[str, str] | None = None, formats: dict[str, str] | None = None) -> list[Column]:
    """Element text that does not match the pattern of its tag's format."""
    tag_formats, formats = tag_formats or fixed.TAG_FORMATS, formats or fixed.FORMATS
    out = []
    for fmt, pattern in formats.items():
        tags = [k for k, v in tag_formats.items() if v == fmt]
        if tags:
            out.append(_issue(F.col("tag").isin(*tags) & F.col("value").isNotNull() & ~F.col("value").rlike(pattern),
                              "ERROR", "Format Validation", f"Invalid {fmt} format", F.col("value"),
                              f"Pattern: {pattern}", fixed.FORMAT_HINTS.get(fmt, "Check the format requirements")))
    return out


def amount_issues(tags: Sequence[str] = fixed.AMOUNT_TAGS, amount: Column | None = None, most: Column | None = None) -> list[Column]:
    """Empty, not a number, negative, more than two (``most``) decimals, missing or bad currency."""
    amount = F.col("tag").isin(*tags) if amount is None else amount
    most = F.lit(2) if most is None else most
    value, ccy = F.col("value"), F.try_element_at("attrs", F.lit("Ccy"))
    filled, number, places = amount & value.isNotNull(), t.to_number("value"), t.decimals("value")
    cat = "Amount Validation"
    return [
        _issue(amount & value.isNull(), "ERROR", cat, "Amount element is empty", suggestion="Provide a numeric value (e.g., 1234.56)"),
        _issue(filled & (number < 0), "ERROR", cat, "Amount cannot be negative", value, suggestion="Use a positive amount value"),
        _issue(filled & number.isNotNull() & (places > most), "WARNING", cat,
               F.concat(F.lit("Amount has "), places.cast("string"), F.lit(" decimal places (max "), most.cast("string"), F.lit(" recommended)")), value,
               suggestion=F.concat(F.lit("Round to "), most.cast("string"), F.lit(" decimal places"))),
        _issue(filled & number.isNull(), "ERROR", cat, "Amount is not a valid number", value, suggestion="Provide a valid numeric value"),
        _issue(filled & (t.blank(ccy) == ""), "ERROR", cat, "Missing 'Ccy' (currency) attribute", suggestion='Add Ccy attribute (e.g., Ccy="EUR")'),
        _issue(filled & (t.blank(ccy) != "") & ~t.blank(ccy).rlike("^[A-Z]{3}$"), "ERROR", cat,
               F.concat(F.lit("Invalid currency code: "), ccy), ccy, "3-letter ISO currency code",
               "Use valid ISO 4217 currency code (e.g., EUR, USD, GBP)"),
    ]


def single_issues(tags: Sequence[str] = fixed.SINGLE_TAGS, wanted: Column | None = None) -> list[Column]:
    """Tags expected once but repeated; reported at the first occurrence."""
    tag = F.col("tag")
    return [_issue((tag.isin(*tags) if wanted is None else wanted) & (F.col("tag_occ") == 1) & (F.col("tag_total") > 1), "WARNING", "Cardinality",
                   F.concat(F.lit("Element '"), tag, F.lit("' appears "), F.col("tag_total").cast("string"), F.lit(" times (expected 1)")),
                   suggestion=F.concat(F.lit("Remove duplicate '"), tag, F.lit("' elements")), path=F.lit(""))]


def apply_rules(nodes: DataFrame, rules: Sequence[Column], doc_id: str = "msg_id") -> DataFrame:
    """Issues of node-local rules in one pass, without a shuffle."""
    return (nodes.filter(F.col("kind") == "element")
            .select(doc_id, F.inline(F.array_compact(F.array(*rules)))))


def validate_nodes(nodes: DataFrame, doc_id: str = "msg_id") -> DataFrame:
    """All node-local rules; a malformed document gives its parse issue and nothing else."""
    bad = F.col("kind") == "parse_error"
    parse = _issue(bad, "ERROR", "XML Parsing", F.col("value"), path=F.lit(""))
    rules = [parse] + [F.when(~bad, r) for r in either_or_issues() + format_issues() + amount_issues() + single_issues()]
    return (nodes.filter(F.col("kind").isin("element", "parse_error"))
            .select(doc_id, F.inline(F.array_compact(F.array(*rules)))))


# ---- rules as tables -----------------------------------------------------------------

MOST_RULES = 20_000
RULE_TABLES = {
    "either_or": "tag string, children array<string>, at_most int, rule string",
    "formats": "tag string, format string, pattern string, hint string",
    "amounts": "tag string, decimals int",
    "single": "tag string",
}


def default_rules(spark: SparkSession) -> dict[str, DataFrame]:
    """The built-in rules as tables; users add their own rows or replace a table."""
    rows = {
        "either_or": [(parent, list(children), most, rule) for parent, children, rule, most, _ in fixed.EITHER_OR],
        "formats": [(tag, name, fixed.FORMATS[name], fixed.FORMAT_HINTS.get(name)) for tag, name in fixed.TAG_FORMATS.items()],
        "amounts": [(tag, 2) for tag in fixed.AMOUNT_TAGS],
        "single": [(tag,) for tag in fixed.SINGLE_TAGS],
    }
    return {name: spark.createDataFrame(rows[name], schema) for name, schema in RULE_TABLES.items()}


def rules_by_tag(rules: dict[str, DataFrame]) -> DataFrame:
    """One row a tag: its exclusive children, formats, decimals of an amount, whether it stands once. Absent tables give no rules."""
    parts = None
    for name, schema in RULE_TABLES.items():
        if name not in rules:
            continue
        columns = [c.split()[0] for c in schema.split(", ")]
        one = rules[name].filter("tag is not null").select("tag", F.lit(name).alias("kind"), F.to_json(F.struct(*columns)).alias("rule"))
        parts = one if parts is None else parts.unionByName(one)
    if parts is None:
        raise ValueError("no rule table given")
    read = lambda kind, schema: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.from_json("rule", schema)))).alias(kind)
    return parts.groupBy("tag").agg(
        read("either_or", RULE_TABLES["either_or"]), read("formats", RULE_TABLES["formats"]),
        F.min(F.when(F.col("kind") == "amounts", F.from_json("rule", RULE_TABLES["amounts"])["decimals"])).alias("decimals"),
        F.bool_or(F.col("kind") == "amounts").alias("amount"), F.bool_or(F.col("kind") == "single").alias("single"))


def validate_by_tables(messages: DataFrame, rules: dict[str, DataFrame], doc_id: str = "msg_id", xml: str = "xml") -> DataFrame:
    """``validate`` with rules that are data: a table a kind (``RULE_TABLES``). A node meets the rules of its tag in one lookup, without a shuffle."""
    by_tag = rules_by_tag(rules)
    if not joins.fits_broadcast(by_tag, MOST_RULES):
        raise ValueError(f"rules for more than {MOST_RULES} tags, or larger than a broadcast may be")
    tags = [r["tag"] for r in by_tag.select("tag").collect()]  # as few as checked above
    nodes = flatten_xml(messages, doc_id, xml, columns=RULE_COLUMNS, attributes=False, tags=tags).filter(F.col("kind").isin("element", "parse_error"))
    met = nodes.join(F.broadcast(by_tag.withColumnRenamed("kind", "rule_kind") if "kind" in by_tag.columns else by_tag), "tag", "left")  # checked above
    found = lambda r: F.filter(r["children"], lambda c: F.array_contains("child_tags", c))
    names = lambda r: F.array_join(found(r), ", ")

    def issue(category, message, value, expected, suggestion):
        return F.struct(F.lit("ERROR").alias("severity"), F.lit(category).alias("category"), F.col("path").alias("path"), F.col("tag").alias("element"),
                        message.alias("message"), value.alias("value"), expected.alias("expected"), suggestion.alias("suggestion"))

    either = F.transform(F.filter("either_or", lambda r: F.size(found(r)) > r["at_most"]), lambda r: issue(
        "Business Rule", F.concat(F.lit("Multiple mutually exclusive elements found: "), names(r)), F.lit(None).cast("string"),
        F.concat(F.lit("Only one of: "), F.array_join(r["children"], ", ")),
        F.concat(F.lit("Remove one of: "), names(r), F.lit(". "), F.coalesce(r["rule"], F.lit("")))))
    formats = F.transform(F.filter("formats", lambda r: F.col("value").isNotNull() & ~F.rlike("value", r["pattern"])), lambda r: issue(
        "Format Validation", F.concat(F.lit("Invalid "), r["format"], F.lit(" format")), F.col("value"), F.concat(F.lit("Pattern: "), r["pattern"]),
        F.coalesce(r["hint"], F.lit("Check the format requirements"))))
    bad = F.col("kind") == "parse_error"
    parse = _issue(bad, "ERROR", "XML Parsing", F.col("value"), path=F.lit(""))
    plain = amount_issues(amount=F.col("amount"), most=F.col("decimals")) + single_issues(wanted=F.col("single"))
    local = F.array_compact(F.array(parse, *[F.when(~bad, r) for r in plain]))
    none = F.filter(local, lambda _: F.lit(False))
    return met.select(doc_id, F.inline(F.concat(local, F.coalesce(F.when(~bad, either), none), F.coalesce(F.when(~bad, formats), none))))


def validate(messages: DataFrame, doc_id: str = "msg_id", xml: str = "xml") -> DataFrame:
    """Issues of raw messages: parse once, then every node-local rule in the same stage."""
    # every rule is about certain tags: nodes of other ones need not leave the parse
    tags = {*(parent for parent, *_ in fixed.EITHER_OR), *fixed.TAG_FORMATS, *fixed.AMOUNT_TAGS, *fixed.SINGLE_TAGS}
    return validate_nodes(flatten_xml(messages, doc_id, xml, columns=RULE_COLUMNS, attributes=False, tags=tags), doc_id)


def validate_schema(messages: DataFrame, xsd_path: str, doc_id: str = "msg_id", xml: str = "xml", row_tag: str = "Document") -> DataFrame:
    """(doc_id, valid): verdict of an XSD on every message.

    ``xsd_path`` must be readable by the executors, for example a file added with addFile.
    """
    options = {"rowTag": row_tag, "rowValidationXSDPath": xsd_path, "columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}
    parsed = F.from_xml(F.col(xml), "_corrupt string", options)
    return messages.select(doc_id, parsed["_corrupt"].isNull().alias("valid"))


# ---- against a field catalog -------------------------------------------------------

NAME_ESCAPES = {"i": r"[\p{L}_:]", "c": r"[\p{L}\p{N}_:.\-]", "I": r"[^\p{L}_:]", "C": r"[^\p{L}\p{N}_:.\-]"}
PLAIN_ESCAPES = set("dDwWsSnrt\\|.?*+(){}[]^$-/")


def translate_pattern(pattern: str | None) -> str | None:
    """An XSD pattern as a regular expression of the engine, or None where it is blank or cannot be read.

    One pass over the tokens; open groups and classes lie on stacks, so they may be nested to any depth.
    """
    text = (pattern or "").strip()
    out: list[str] = []
    groups, at, operand = 0, 0, False  # operand: a quantifier may follow

    def escape(k: int) -> tuple[str, int] | None:
        """The escape at ``k`` and the place after it."""
        nxt = text[k + 1:k + 2]
        if nxt in NAME_ESCAPES and nxt:
            return NAME_ESCAPES[nxt], k + 2
        if nxt in ("p", "P"):
            end = text.find("}", k)
            name = text[k + 3:end]
            if text[k + 2:k + 3] != "{" or end < 0 or not name or not all(c.isascii() and (c.isalnum() or c in "-_") for c in name):
                return None
            return (rf"\{nxt}{{In{name[2:].replace('-', '')}}}" if name.startswith("Is") else rf"\{nxt}{{{name}}}"), end + 1
        return (text[k:k + 2], k + 2) if nxt in PLAIN_ESCAPES and nxt else None

    def bracket(k: int) -> tuple[str, int] | None:
        """The class at ``k`` with its subtractions, and the place after it."""
        # open classes: whether each is subtracted from the one around it, whether it is written as a complement, where it starts
        made, open_, first = [], [], True
        while k < len(text):
            c = text[k]
            if c == "[":
                inner = bool(open_)
                minus = inner and not first and made[-1] == "-"
                if inner and (not minus or (open_[-1][0] and open_[-1][1])):
                    return None
                if minus:
                    made[-1] = "&&"
                    if open_[-1][1]:
                        made[open_[-1][2]], made[-1] = "[[^", "]&&"
                negated = text[k + 1:k + 2] == "^"
                open_.append((minus, negated != minus, len(made)))
                # what is subtracted is what the class must not be
                made.append("[" if negated == minus else "[^")
                k, first = k + 1 + negated, True
                continue
            if c == "]":
                if first:
                    return None
                made.append("]")
                k += 1
                open_.pop()
                if not open_:
                    return "".join(made), k
                if text[k:k + 1] != "]":
                    return None
                continue
            if c == "\\":
                found = escape(k)
                if found is None:
                    return None
                made.append(found[0])
                k = found[1]
            else:
                made.append("\\&" if c == "&" else c)
                k += 1
            first = False
        return None

    while at < len(text):
        c = text[at]
        if c == "[":
            found = bracket(at)
        elif c == "\\":
            found = escape(at)
        elif c in "*+?":
            if not operand:
                return None
            out.append(c)
            at, operand = at + 1, False
            continue
        elif c == "{":
            end = text.find("}", at)
            least, comma, most = text[at + 1:end].partition(",")
            if not operand or end < 0 or not least.isdecimal() or not least.isascii() or len(least) > 6 or (most and not (most.isdecimal() and most.isascii() and len(most) <= 6)):
                return None
            if comma and most and int(most) < int(least):
                return None
            out.append(text[at:end + 1])
            at, operand = end + 1, False
            continue
        elif c == "(":
            if text[at + 1:at + 2] == "?":
                return None
            groups += 1
            out.append("(?:")
            at, operand = at + 1, False
            continue
        elif c == ")":
            groups -= 1
            if groups < 0:
                return None
            found = (")", at + 1)
        elif c in "]}":
            return None
        else:
            out.append(c)
            at, operand = at + 1, c not in "|^$"
            continue
        if found is None:
            return None
        out.append(found[0])
        at, operand = found[1], True
    return "".join(out) if text and not groups else None


def xsd_regex(pattern: str) -> Column:
    """An XSD pattern as a regular expression of the engine, anchored; null where it is blank or cannot be read.

    Name characters (``\\i``, ``\\c`` and their complements), class subtraction and block names are translated; ``^`` and
    ``$`` stay anchors, as catalogs write them. For the rows of a catalog, not of messages.
    """

    @F.pandas_udf("string")
    def translated(patterns: pd.Series) -> pd.Series:
        return patterns.map(lambda p: f"^(?:{made})$" if (made := translate_pattern(p)) is not None else None)

    return translated(F.col(pattern))


def validate_catalog(nodes: DataFrame, catalog: DataFrame, doc_id: str = "msg_id") -> DataFrame:
    """Itemised issues against a catalog: unknown path, missing child, enum, pattern, length, bounds, digits.

    ``catalog`` needs path, tag, min_occurs, enums (array), pattern, min_length, max_length,
    min_value, max_value, total_digits, fraction_digits.
    """
    required = (catalog.filter((F.col("min_occurs") != "0") & ~F.col("path").contains("@"))
                .groupBy(t.parent_path("path").alias("path")).agg(F.array_sort(F.collect_set("tag")).alias("required")))
    rules = catalog.select(
        "path", F.lit(True).alias("known"), F.col("enums").alias("c_enums"), F.col("pattern").alias("c_pattern"), xsd_regex("pattern").alias("c_regex"),
        *[F.col(c).cast("int").alias(f"c_{c}") for c in ("min_length", "max_length", "total_digits", "fraction_digits")],
        *[F.col(c).try_cast("decimal(38,9)").alias(f"c_{c}") for c in ("min_value", "max_value")],
    ).join(required, "path", "left")
    # a rule that a path does not have is not worked out for its nodes
    joined = joins.dim_join(nodes.filter(F.col("kind").isin("element", "attribute")), rules, ["path"])
    value, number = F.col("value"), F.col("value").try_cast("decimal(38,9)")
    size = F.length("value")
    digits = F.length(F.regexp_replace("value", r"[^0-9]", ""))
    element = F.col("kind") == "element"
    known = F.col("known").isNotNull()
    missing = F.array_except(F.col("required"), F.col("child_tags"))

    def check(when, category, message, expected):
        return _issue(known & value.isNotNull() & when, "ERROR", category, message, value, expected)

    issues = F.array_compact(F.array(
        _issue(~known, "ERROR", "XSD Validation", F.concat(F.lit("Unexpected "), F.when(element, "element").otherwise("attribute"), F.lit(": "), F.col("tag"))),
        _issue(known & element & (F.size(missing) > 0), "ERROR", "Missing Element",
               F.concat(F.lit("Missing required: "), F.array_join(missing, ", ")), expected=F.array_join("required", ", ")),
        check((F.size("c_enums") > 0) & ~F.array_contains("c_enums", value), "Invalid Value", "Value is not in the enumeration", F.array_join("c_enums", ", ")),
        check(F.col("c_regex").isNotNull() & ~F.rlike(value, "c_regex"), "Pattern Mismatch", "Value does not match the pattern", F.col("c_pattern")),
        _issue(known & value.isNotNull() & (t.blank("c_pattern") != "") & F.col("c_regex").isNull(), "WARNING", "Pattern Not Checked", "Pattern cannot be read", value, F.col("c_pattern")),
        check((size < F.col("c_min_length")) | (size > F.col("c_max_length")), "Length Constraint", "Length is out of range",
              F.concat_ws("..", F.col("c_min_length").cast("string"), F.col("c_max_length").cast("string"))),
        check((F.col("c_min_value").isNotNull() | F.col("c_max_value").isNotNull()) & ((number < F.col("c_min_value")) | (number > F.col("c_max_value"))), "XSD Validation", "Value is out of bounds",
              F.concat_ws("..", F.col("c_min_value").cast("string"), F.col("c_max_value").cast("string"))),
        check((F.col("c_fraction_digits").isNotNull() | F.col("c_total_digits").isNotNull())
              & ((t.decimals("value") > F.col("c_fraction_digits")) | (digits > F.col("c_total_digits"))), "XSD Validation", "Too many digits",
              F.concat_ws(",", F.col("c_total_digits").cast("string"), F.col("c_fraction_digits").cast("string"))),
    ))
    return joined.select(doc_id, F.inline(issues))


# ---- summaries ---------------------------------------------------------------------

def summarise(issues: DataFrame, doc_id: str = "msg_id") -> DataFrame:
    """Per message: valid, totals by severity and a count per category as text."""
    per_category = issues.groupBy(doc_id, "category").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("ERROR", "WARNING", "INFO")])
    # at most one row per rule category and message from here on
    return per_category.groupBy(doc_id).agg(
        (F.sum("ERROR") == 0).alias("valid"), F.sum("n").alias("total_issues"), F.sum("ERROR").alias("errors"),
        F.sum("WARNING").alias("warnings"), F.sum("INFO").alias("infos"),
        F.array_join(F.array_sort(F.collect_list(F.concat("category", F.lit("="), F.col("n").cast("string")))), ", ").alias("by_category"))


def results(messages: DataFrame, issues: DataFrame, doc_id: str = "msg_id") -> DataFrame:
    """One row per message with its error count, also for messages without issues."""
    errors = issues.filter(F.col("severity") == "ERROR").groupBy(doc_id).agg(F.count("*").alias("error_count"))
    return messages.select(doc_id).join(errors, doc_id, "left").select(
        doc_id, F.coalesce("error_count", F.lit(0)).cast("bigint").alias("error_count")).withColumn("valid", F.col("error_count") == 0)


def batch_report(rows: DataFrame, elapsed: str | None = None) -> DataFrame:
    """Totals of a batch: passed, failed, pass rate text, errors and mean time."""
    mean = F.round(F.avg(elapsed), 2) if elapsed else F.lit(None).cast("double")
    one = rows.agg(F.count("*").alias("total"), F.count_if("valid").alias("passed"),
                   F.count_if(~F.col("valid")).alias("failed"), F.coalesce(F.sum("error_count"), F.lit(0)).alias("total_errors"),
                   mean.alias("mean_time_ms"))
    rate = F.when(F.col("total") > 0, t.pct(F.col("passed"), F.col("total"))).otherwise("N/A")
    return one.withColumn("pass_rate", rate)


def error_digest(issues: DataFrame, n: int, doc_id: str = "msg_id") -> DataFrame:
    """First ``n`` errors per message and '... and k more'; ranked before anything is collected."""
    errors = issues.filter(F.col("severity") == "ERROR")
    counts = errors.groupBy(doc_id).agg(F.count("*").alias("total"))
    window = W.partitionBy(doc_id).orderBy("category", "path", "message", "value")
    first = (errors.withColumn("rn", F.row_number().over(window)).filter(F.col("rn") <= n)
             .groupBy(doc_id).agg(F.array_sort(F.collect_list(F.struct("rn", "message"))).alias("rows")))
    return counts.join(first, doc_id).select(
        doc_id, "total", F.array_join(F.transform("rows", lambda r: F.left(r["message"], F.lit(100))), "; ").alias("first"),
        F.when(F.col("total") > n, F.format_string("... and %d more", F.col("total") - n)).otherwise("").alias("more"))


def cap(issues: DataFrame, n: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A report's limit: the first ``n`` rows per key."""
    window = W.partitionBy(*by).orderBy(*order)
    return issues.withColumn("rn", F.row_number().over(window)).filter(F.col("rn") <= n).drop("rn")


