"""Implementation guides: status, differences between two guides, schema cross-reference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fieldlens import fixed
from fieldlens.functions import lists, text as t
from fieldlens.operators import joins, ordered

SIDE_COLUMNS = ("idx", "mult", "tag", "type", "length", "usage_rule", "rulebook", "format_rule",
                "code_restrictions", "row_color")


# ---- sheets ------------------------------------------------------------------------

def sheet_list(guide: DataFrame, order: str = "pos") -> DataFrame:
    """Sheets (messages) of a guide with the position of their first row."""
    return guide.groupBy("message").agg(F.min(order).alias("first_pos"))


def resolve_sheet(guide: DataFrame, name: str, order: str = "pos") -> DataFrame:
    """One row: the exact sheet, else the first that contains or is contained in ``name``.

    An empty name takes the first sheet that is not the summary. ``sheet`` is null when
    nothing fits; ``available`` then lists what exists.
    """
    sheets = sheet_list(guide, order)
    low, want = F.lower("message"), F.lit(name.lower())
    if name == "":
        rank = F.when(F.col("message") != "Summary", 0)
    else:
        rank = F.when(F.col("message") == name, 0).when(low.contains(want) | want.contains(low), 1)
    return sheets.withColumn("rank", rank).agg(
        F.min_by(F.when(F.col("rank").isNotNull(), F.col("message")),
                 F.struct(F.coalesce("rank", F.lit(9)), "first_pos")).alias("sheet"),
        F.array_join(F.array_sort(F.collect_set("message")), ", ").alias("available"),
    ).select(F.lit(name).alias("requested"), "sheet", F.when(F.col("sheet").isNull(), F.col("available")).otherwise("").alias("available"))


def canonical_sheet(column: str = "message") -> Column:
    """Lower-case sheet key without a duplicate-instance suffix ``_2`` to ``_9``."""
    return F.lower(F.regexp_replace(column, r"_([2-9])$", ""))


def pair_sheets(a: DataFrame, b: DataFrame, order: str = "pos") -> DataFrame:
    """Sheets of two guides paired on their canonical key; the first sheet per key counts."""
    def first(guide, name):
        return (sheet_list(guide, order).groupBy(canonical_sheet().alias("key"))
                .agg(F.min_by("message", F.struct("first_pos", "message")).alias(name)))

    return first(a, "sheet_a").join(first(b, "sheet_b"), "key", "full")


def attach_labels(sheets: DataFrame, summary: DataFrame) -> DataFrame:
    """Message id and label of each sheet, derived from its name when the summary has none."""
    return joins.dim_join(sheets, summary.select("sheet", "message_id", "label"), ["sheet"]).select(
        "sheet", F.coalesce("message_id", t.dotted("sheet")).alias("message_id"),
        F.coalesce("label", "sheet").alias("label"))


def distinct_messages(guide: DataFrame, order: str = "pos") -> DataFrame:
    """Messages in first-seen order."""
    return sheet_list(guide, order).orderBy("first_pos")


def keep_last(guide: DataFrame, keys: Sequence[str], order: str = "pos") -> DataFrame:
    """One row per key: the last one wins, as when rows are read into a map."""
    rest = [c for c in guide.columns if c not in keys]
    return guide.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*")


# ---- status ------------------------------------------------------------------------

def colour_status() -> Column:
    """Status from the row colour alone."""
    return (F.when(F.col("row_color") == "yellow", "Mandatory")
            .when(F.col("row_color") == "red", "Not Permitted").otherwise("Optional"))


def with_guide_status(guide: DataFrame) -> DataFrame:
    """Status by colour, then minimum occurrence, then a usage rule starting with 'mandatory'."""
    low, colour = t.min_of("mult"), F.col("row_color")
    mandatory_rule = F.lower(F.trim(t.blank("usage_rule"))).startswith("mandatory")
    status = (F.when(colour == "yellow", "Mandatory").when(colour == "red", "Not Permitted")
              .when(low == "1", "Mandatory").when(mandatory_rule, "Conditional").otherwise("Optional"))
    mult = t.blank("mult")
    source = (F.when(colour.isin("yellow", "red"), F.concat(F.lit("explicit (cell colour: "), F.initcap(colour), F.lit(")")))
              .when(low == "1", F.concat(F.lit("derived (Multiplicity="), mult, F.lit(")")))
              .when(mandatory_rule, 'derived (Usage Rule starts with "Mandatory")')
              .otherwise(F.concat(F.lit("derived (Multiplicity="), mult, F.lit(", no colour)"))))
    return guide.withColumn("status", status).withColumn("status_source", source)


def has_colour(guide: DataFrame, by: Sequence[str] = ("message",)) -> DataFrame:
    """Whether any row of a sheet carries a colour."""
    return guide.groupBy(*by).agg(F.bool_or(F.col("row_color").isin("yellow", "red")).alias("has_colour"))


def filter_status(guide: DataFrame, mode: str = "all") -> DataFrame:
    """``all``, ``mandatory`` or ``exclude_notperm``."""
    if mode == "mandatory":
        return guide.filter(F.col("status") == "Mandatory")
    return guide.filter(F.col("status") != "Not Permitted") if mode == "exclude_notperm" else guide


def match_messages(df: DataFrame, terms: Sequence[str], column: str = "message") -> DataFrame:
    """Messages equal to a term, starting with ``term.`` or containing it; case-insensitive."""
    low = F.lower(column)
    wanted = F.lit(False)
    for term in terms:
        term = term.lower().strip()
        # equality and the dotted prefix are special cases of containment
        wanted = wanted | low.contains(term)
    return df.filter(wanted)


def match_keys(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    return df.filter(F.col(column).isin(*keys))


# ---- guide against guide -----------------------------------------------------------

def guide_diff(a: DataFrame, b: DataFrame, by: Sequence[str] = (), order: str = "pos") -> DataFrame:
    """ADDED, REMOVED, STATUS, RULES, BOTH or UNCHANGED per xpath, with the changed fields.

    Of a repeated xpath the last row counts: the one with the highest ``order``, without that column the largest one. Rows are reduced before they
    meet, by the columns they meet by, so this adds no exchange.
    """
    keys = [*by, "xpath"]

    def side(guide: DataFrame, name: str) -> DataFrame:
        row = F.struct(*SIDE_COLUMNS)
        place = F.struct(F.col(order).alias("at"), row.alias("row")) if order in guide.columns else row
        last = guide.groupBy(*keys).agg(F.max_by(row, place).alias("r"))
        return last.select(*keys, F.lit(True).alias(f"in_{name}"), *[F.col("r")[c].alias(f"{name}_{c}") for c in SIDE_COLUMNS])

    pairs = side(a, "a").join(side(b, "b"), keys, "full")
    old = {c: F.trim(t.blank(f"a_{c}")) for c in fixed.RULE_COLUMNS}
    new = {c: F.trim(t.blank(f"b_{c}")) for c in fixed.RULE_COLUMNS}
    label = F.create_map(*[F.lit(x) for kv in fixed.COLOUR_STATUS.items() for x in kv])
    old["status"], new["status"] = label[F.col("a_row_color")], label[F.col("b_row_color")]
    both = F.col("in_a") & F.col("in_b")
    nothing = F.expr("cast(array() as array<struct<field:string,old:string,new:string>>)")
    with_changes = pairs.withColumn("changed", F.when(both, lists.changed_fields(old, new)).otherwise(nothing))
    status = F.exists("changed", lambda c: c["field"] == "status")
    return with_changes.withColumn(
        "change", F.when(F.col("in_a").isNull(), "ADDED").when(F.col("in_b").isNull(), "REMOVED")
        .when(F.size("changed") == 0, "UNCHANGED").when(status & (F.size("changed") > 1), "BOTH")
        .when(status, "STATUS").otherwise("RULES"))


def what_changed(changed: str = "changed", n: int = 60) -> Column:
    """One text line per changed field; a dash when there is none."""
    labels = F.create_map(*[F.lit(x) for kv in fixed.RULE_LABELS.items() for x in kv])

    def line(c):
        name, old, new = labels[c["field"]], t.blank(c["old"]), t.blank(c["new"])
        return (F.when((old != "") & (new != ""), F.concat(name, F.lit(":\n  A: "), F.left(old, F.lit(n)), F.lit("\n  B: "), F.left(new, F.lit(n))))
                .when(new != "", F.concat(name, F.lit(": (new) "), F.left(new, F.lit(n))))
                .otherwise(F.concat(name, F.lit(": (removed)"))))

    return F.when(F.size(changed) == 0, F.lit("—")).otherwise(F.array_join(F.transform(changed, line), "\n"))


def guide_impact(a_label: str = "EPC", b_label: str = "NPC") -> Column:
    """What a guide difference means for an implementation."""
    A, B, lit = a_label, b_label, F.lit

    def entry(c):
        return F.try_element_at(F.filter("changed", lambda r: r["field"] == c), lit(1))

    found = {c: entry(c) for c in (*fixed.RULE_COLUMNS, "status")}
    old = lambda c: t.blank(found[c]["old"])
    new = lambda c: t.blank(found[c]["new"])
    has = lambda c: found[c].isNotNull()
    oldst, newst = old("status"), new("status")
    core, blocked, optional = (lambda s: s.contains("Core")), (lambda s: s.contains("NotPermitted")), (lambda s: s.contains("Optional"))
    status = F.when(has("status"), (
        F.when(core(oldst) & optional(newst), f"Status RELAXED: was Core Mandatory in {A}, is Optional in {B}. {B} implementations are not required to populate this field.")
        .when(optional(oldst) & core(newst), f"Status ELEVATED: was Optional in {A}, is Core Mandatory in {B}. This field must be present in every {B} message.")
        .when(blocked(newst), f"Field BLOCKED in {B}: must NOT be included in {B} messages. {A} implementations that populate this field need a separate {B} code path.")
        .when(blocked(oldst) & core(newst), f"Field UNBLOCKED in {B}: was Not Permitted in {A}, is now Core Mandatory. {B} must include this field.")
        .when(blocked(oldst), f"Field UNBLOCKED in {B}: was Not Permitted in {A}, is now Optional in {B}.")
        .otherwise(F.concat(lit("Status changed from "), oldst, lit(f" ({A}) to "), newst, lit(f" ({B}).")))))

    def three(c, both, added, gone):
        return F.when(has(c), F.when((old(c) != "") & (new(c) != ""), both).when(new(c) != "", added).when(old(c) != "", gone))

    lines = F.array_compact(F.array(
        status,
        three("length",
              F.concat(lit(f"Length constraint changed: {A} allows "), old("length"), lit(f", {B} allows "), new("length"), lit(". Validate field values against the applicable limit per scheme.")),
              F.concat(lit(f"{B} adds a length constraint: "), new("length"), lit(f". No constraint existed in {A}.")),
              F.concat(lit(f"{A} had a length constraint ("), old("length"), lit(f") that is not present in {B}."))),
        F.when(has("mult"), F.concat(lit(f"Multiplicity changed: {A} "), old("mult"), lit(f" → {B} "), new("mult"), lit(". Check cardinality handling in your implementation."))),
        three("usage_rule", lit(f"Usage rules differ between {A} and {B}. Review the rules in both columns and ensure your implementation satisfies the applicable scheme."),
              lit(f"{B} adds a usage rule not present in {A}. Review the {B} constraint."),
              lit(f"{A} had a usage rule that is not present in {B} — the constraint is relaxed.")),
        F.when(has("rulebook"), F.concat(lit(f'Rulebook reference differs: {A} references "'), old("rulebook"), lit(f'", {B} references "'), new("rulebook"), lit('". Ensure the correct AT-number is used per scheme.'))),
        F.when(has("format_rule"), lit("Format rules differ. Review format constraints per scheme before implementing.")),
        F.when(has("code_restrictions"), lit(f"Code set restrictions differ between {A} and {B}. Validate allowed code values per scheme.")),
    ))
    added = F.concat(
        lit('Field "'), t.blank("b_tag"), lit('"'),
        F.when(t.blank("b_mult") == "", "").otherwise(F.concat(lit(" (multiplicity "), F.col("b_mult"), lit(")"))),
        lit(f" is new in {B} and does not exist in {A}."),
        F.when(F.col("b_row_color") == "yellow", f" It is Core Mandatory — must be included in every {B} message.")
        .when(F.col("b_row_color") == "red", f" It is blocked in {B} — do not include this field.")
        .otherwise(f" It is optional in {B}."))
    removed = F.concat(
        lit('Field "'), t.blank("a_tag"), lit(f'" exists in {A} but is not present in {B}.'),
        F.when(F.col("a_row_color") == "yellow", f" It was Core Mandatory in {A}.").otherwise(""),
        lit(f" {B} processing can omit this field."))
    return (F.when(F.col("change") == "UNCHANGED", "").when(F.col("change") == "ADDED", added)
            .when(F.col("change") == "REMOVED", removed)
            .when(F.size(lines) == 0, "No business-relevant differences.").otherwise(F.array_join(lines, " ")))


def context_value(name: str, sep: str = " / ") -> Column:
    """B's value before A's; both when they differ."""
    a, b = F.trim(t.blank(f"a_{name}")), F.trim(t.blank(f"b_{name}"))
    return (F.when((a != "") & (b != "") & (a != b), F.concat(F.lit("A: "), a, F.lit(f"{sep}B: "), b))
            .when(b != "", b).otherwise(a))


def sheet_stats(diff: DataFrame, sheet: str = "message") -> DataFrame:
    """Counts of the six categories per sheet with their sum of changes, and a TOTAL row."""
    names = ("ADDED", "REMOVED", "STATUS", "RULES", "BOTH", "UNCHANGED")
    return diff.rollup(sheet).agg(
        *[F.count_if(F.col("change") == n).alias(n.lower()) for n in names],
        F.count_if(F.col("change") != "UNCHANGED").alias("changes"),
    ).withColumn(sheet, F.coalesce(sheet, F.lit("TOTAL")))


# ---- schema against guide ----------------------------------------------------------

def with_schema_status(catalog: DataFrame) -> DataFrame:
    """Status of a schema field from its class, else from its minimum occurrence."""
    cls, low, high = F.coalesce("field_class", F.lit("NA")), F.col("min_occurs"), F.col("max_occurs")
    status = (F.when(cls == "RED", "Not Permitted")
              .when((cls == "YELLOW") & (low == "0"), "Conditional").when(cls == "YELLOW", "Mandatory")
              .when(cls == "WHITE", "Optional").when(low == "1", "Mandatory").otherwise("Optional"))
    source = (F.when(cls == "RED", "explicit (Red annotation)")
              .when((cls == "YELLOW") & (low == "0"), F.concat(F.lit("explicit (Yellow annotation, minOccurs="), low, F.lit(".."), high, F.lit(")")))
              .when(cls == "YELLOW", F.concat(F.lit("explicit (Yellow annotation, minOccurs="), low, F.lit(")")))
              .when(cls == "WHITE", "explicit (White annotation)")
              .when(low == "1", "derived (minOccurs=1, no colour annotation)")
              .otherwise(F.concat(F.lit("derived (minOccurs="), low, F.lit(", no colour annotation)"))))
    return catalog.withColumn("status", status).withColumn("status_source", source)


def schema_side(catalog: DataFrame) -> DataFrame:
    """Catalog columns as the schema side of a cross-reference; needs path, seq and status."""
    have = set(catalog.columns)
    opt = lambda c, default="": F.col(c) if c in have else F.lit(default)
    return catalog.select(
        "tag", F.col("seq").cast("bigint").alias("x_pos"), F.col("path").alias("x_path"),
        t.multiplicity("min_occurs", "max_occurs").alias("x_mult"), F.col("status").alias("x_status"),
        F.col("status_source").alias("x_source"), t.blank(opt("usage_rules")).alias("x_usage"),
        t.blank(opt("format_rules")).alias("x_format"), t.blank(opt("length_text")).alias("x_length"))


def guide_side(guide: DataFrame, order: str = "pos") -> DataFrame:
    return guide.select(
        "tag", F.col(order).cast("bigint").alias("g_pos"), F.col("xpath").alias("g_path"), F.col("idx").alias("g_index"),
        F.col("mult").alias("g_mult"), F.col("status").alias("g_status"), F.col("status_source").alias("g_source"),
        t.blank("usage_rule").alias("g_usage"), t.blank("format_rule").alias("g_format"), t.blank("length").alias("g_length"))


def pair_by_tag_position(x: DataFrame, g: DataFrame, by: str = "position", width: int = ordered.CHUNK_ROWS) -> DataFrame:
    """Within a tag the i-th schema row meets the i-th guide row; leftovers stay one-sided.

    Positions are counted in chunks, so a tag holding a third of all rows is spread out.
    ``by='path'`` pairs on the path instead.
    """
    if by == "path":
        return x.join(g.withColumn("x_path", F.col("g_path")), ["tag", "x_path"], "full")
    xn = ordered.row_number(x, ["tag"], ["x_pos", "x_path"], "rn", width)
    gn = ordered.row_number(g, ["tag"], ["g_pos", "g_path"], "rn", width)
    return xn.join(gn, ["tag", "rn"], "full")


def gap_category() -> Column:
    xs, gs = F.col("x_status"), F.col("g_status")
    status = (((xs == "Mandatory") & (gs != "Mandatory")) | ((xs == "Not Permitted") & (gs != "Not Permitted"))
              | ((xs == "Optional") & (gs == "Mandatory"))
              | ((xs == "Conditional") & (gs == "Mandatory") & (F.col("g_source") != "explicit (cell colour: Yellow)")))
    rules = (t.rules_differ("x_usage", "g_usage") | t.rules_differ("x_format", "g_format") | t.rules_differ("x_length", "g_length"))
    return (F.when(F.col("g_path").isNull(), "XSD_ONLY").when(F.col("x_path").isNull(), "EXCLUDED")
            .when(status & rules, "BOTH_DIFF").when(status, "STATUS_DIFF").when(rules, "RULES_DIFF")
            .when(t.mult_differs("x_mult", "g_mult"), "MULT_DIFF").otherwise("ALIGNED"))


def finding_text() -> Column:
    """Human text of a gap: status, multiplicity, length, usage and format parts."""
    lit = F.lit
    xs, gs, xl, gl = F.col("x_status"), F.col("g_status"), t.blank("x_length"), t.blank("g_length")
    xu, gu = t.normalise_rule("x_usage"), t.normalise_rule("g_usage")
    parts = F.array_compact(F.array(
        F.when((xs != gs) & (xs == "Conditional"), F.concat(
            lit("XSD marks as Conditional (Yellow, "), F.col("x_mult"), lit(') — mandatory when condition is met. IG shows "'), gs, lit('" ['), F.col("g_source"), lit("].")))
        .when(xs != gs, F.concat(lit('Status: XSD says "'), xs, lit('" ['), F.col("x_source"), lit(']. IG says "'), gs, lit('" ['), F.col("g_source"), lit("]."))),
        F.when((t.blank("x_mult") != "") & t.mult_differs("x_mult", "g_mult"), F.concat(lit("Multiplicity: XSD="), F.col("x_mult"), lit(", IG="), F.col("g_mult"), lit("."))),
        F.when((xl != "") & (gl != "") & (t.normalise_rule("x_length") != t.normalise_rule("g_length")), F.concat(lit('Length: XSD="'), xl, lit('", IG="'), gl, lit('".')))
        .when((xl != "") & (gl == ""), F.concat(lit("Length constraint in XSD ("), xl, lit(") not documented in IG.")))
        .when((gl != "") & (xl == ""), F.concat(lit("Length in IG ("), gl, lit(") not reflected in XSD type."))),
        F.when((xu != "") & (gu == ""), "Usage rule in XSD annotation not present in IG.")
        .when((gu != "") & (xu == ""), "Usage rule in IG not captured in XSD annotation.")
        .when(xu != gu, "Usage rules differ between XSD and IG — review both."),
        F.when(t.rules_differ("x_format", "g_format"), "Format rules differ."),
    ))
    gap = F.col("gap")
    return (F.when(gap == "ALIGNED", "")
            .when(gap == "EXCLUDED", F.concat(lit("Field exists in the guide (index "), t.blank("g_index"), lit(") but is absent from the schema — the scheme does not permit this field.")))
            .when(gap == "XSD_ONLY", "Field defined in the schema but not found in the guide — may be a sub-element or new constraint not yet documented.")
            .when(F.size(parts) == 0, "Difference detected — review both columns.").otherwise(F.array_join(parts, " ")))


def cross_reference(catalog: DataFrame, guide: DataFrame, by: str = "position", order: str = "pos", width: int = ordered.CHUNK_ROWS) -> DataFrame:
    """Schema fields against guide fields with gap category and finding text."""
    x = catalog if "status" in catalog.columns else with_schema_status(catalog)
    g = guide if "status" in guide.columns else with_guide_status(guide)
    pairs = pair_by_tag_position(schema_side(x), guide_side(g, order), by, width)
    return pairs.withColumn("gap", gap_category()).withColumn("finding", finding_text())


def by_gap(rows: DataFrame, category: str) -> DataFrame:
    return rows.filter(F.col("gap") == category)


def mandatory_checklist(rows: DataFrame) -> DataFrame:
    needed = ("Mandatory", "Conditional")
    return rows.filter(F.col("x_status").isin(*needed) | F.col("g_status").isin(*needed))


def conditional_fields(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("x_status") == "Conditional")


def gap_stats(rows: DataFrame) -> DataFrame:
    """Count and percent per gap category in report order with meaning and action, and a TOTAL."""
    names = [g[0] for g in fixed.GAPS]
    one = rows.agg(F.count("*").alias("TOTAL"), *[F.count_if(F.col("gap") == n).alias(n) for n in names])
    total = F.col("TOTAL")
    structs = [F.struct(F.lit(i).alias("position"), F.lit(n).alias("gap"), F.col(n).alias("n"),
                        t.pct(F.col(n), total).alias("percent"), F.lit(m).alias("meaning"), F.lit(a).alias("action"))
               for i, (n, m, a) in enumerate(fixed.GAPS)]
    structs.append(F.struct(F.lit(len(names)).alias("position"), F.lit("TOTAL").alias("gap"), total.alias("n"),
                            F.lit("").alias("percent"), F.lit("").alias("meaning"), F.lit("").alias("action")))
    return one.select(F.inline(F.array(*structs)))


def status_stats(guide: DataFrame) -> DataFrame:
    """Mandatory, optional and not permitted per message, percent, priority, and a TOTAL row."""
    counted = guide.rollup("message").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("status") == s).alias(n) for s, n in
          (("Mandatory", "mandatory"), ("Optional", "optional"), ("Not Permitted", "not_permitted"))])
    priority = F.lit(fixed.PRIORITY_REST)
    for above, text in reversed(fixed.PRIORITIES):
        priority = F.when(F.col("mandatory") > above, text).otherwise(priority)
    return counted.select(
        F.coalesce("message", F.lit("TOTAL")).alias("message"), "total", "mandatory", "optional", "not_permitted",
        t.pct(F.col("mandatory"), F.col("total"), 0).alias("percent"),
        F.when(F.col("message").isNull(), "").otherwise(priority).alias("priority"))


def guide_enrich(guide: DataFrame, facets: DataFrame, order: str = "pos") -> DataFrame:
    """Guide rows with pattern, codes and length of the schema field at the same tag and position.

    ``facets`` needs tag, seq, path, pattern, enums (text) and length_text.
    """
    g = ordered.row_number(guide, ["tag"], [order, "xpath"], "rn")
    x = ordered.row_number(
        facets.select("tag", F.col("seq").cast("bigint").alias("x_pos"), F.col("path").alias("x_path"),
                      F.col("pattern").alias("x_pattern"), F.col("enums").alias("x_enums"), F.col("length_text").alias("x_length")),
        ["tag"], ["x_pos", "x_path"], "rn")
    enriched = (t.blank("x_pattern") != "") | (t.blank("x_enums") != "") | (t.blank("x_length") != "")
    return g.join(x, ["tag", "rn"], "left").select(
        *[F.col(c) for c in guide.columns], t.blank("x_pattern").alias("schema_pattern"), t.blank("x_enums").alias("schema_codes"),
        F.when(t.blank("x_length") != "", F.col("x_length")).otherwise(t.blank("length")).alias("effective_length"),
        enriched.alias("enriched"))


def gap_percent(rows: DataFrame) -> DataFrame:
    """Share of each category in all rows and its bar width against the largest category."""
    # at most seven rows reach these windows
    counts = rows.groupBy("gap").agg(F.count("*").alias("n"))
    whole = W.partitionBy()
    return counts.select(
        "gap", "n", (F.floor(F.col("n") * 1000.0 / F.sum("n").over(whole) + 0.5) / 10).alias("percent"),
        F.floor(F.col("n") * 200.0 / F.max("n").over(whole) + 0.5).cast("bigint").alias("bar_width"))


def mapping_hints(guide: DataFrame, status: str = "status") -> DataFrame:
    """Likely source system and hard-coded default per tag; nothing for not-permitted fields."""
    lookup = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("tag")]
    indicator = F.lower(t.blank("type")).contains("indicator")
    return (guide
            .withColumn("source_system", F.when(F.col(status) == "Not Permitted", "").otherwise(F.coalesce(lookup(fixed.SOURCE_SYSTEMS), F.lit(""))))
            .withColumn("default_hint", F.coalesce(lookup(fixed.GUIDE_DEFAULTS), F.when(indicator, "false").otherwise(""))))


def guide_sample() -> Column:
    """Sample value of a guide field: by tag, else by type."""
    low = F.lower(t.blank("type"))
    known = F.create_map(*[F.lit(x) for kv in fixed.GUIDE_SAMPLES.items() for x in kv])[F.trim(F.col("tag"))]
    width = F.regexp_extract(low, r"max(\d+)", 1)
    has = low.contains
    return F.coalesce(
        known,
        F.when(has("date") & has("time"), "2024-01-15T10:30:00").when(has("date"), "2024-01-15")
        .when(has("iban"), "DE89370400440532013000").when(has("bic"), "DEUTDEFFXXX")
        .when(has("amount") | has("decimal"), "1000.00").when(has("numeric") | has("integer"), "1")
        .when(low.rlike(r"max\d+text"), F.concat(F.lit("SAMPLE"), F.least(width.try_cast("bigint"), F.lit(20)).cast("string")))
        .when(has("indicator") | has("boolean"), "true").when(has("code"), "SLEV").otherwise(""))


def guide_template(guide: DataFrame, mode: str = "all") -> DataFrame:
    """Guide columns with sample, source-system and default hints and a work status."""
    rows = filter_status(guide.withColumn("status", colour_status()), mode)
    return mapping_hints(rows).select(
        "message", "xpath", "idx", "tag", "mult", "type", "status", "length", "usage_rule", "rulebook",
        "format_rule", "code_restrictions", guide_sample().alias("transformation"), "source_system", "default_hint",
        F.lit("").alias("source_field"), F.lit("").alias("validation_rule"), F.lit("").alias("owner"), F.lit("").alias("notes"),
        F.when(F.col("status") == "Not Permitted", "N/A").otherwise("TODO").alias("work_status"))
