"""Records rebuilt from raw table rows: guide records, change logs, sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fieldlens import fixed
from fieldlens.functions import lists, text as t
from fieldlens.operators import joins, ordered
from fieldlens.session import checkpoint


def islands(rows: DataFrame, keys: Sequence[str], order: Sequence[str], start: Column, name: str = "rec",
            width: int = ordered.CHUNK_ROWS) -> DataFrame:
    """Number the runs that begin at each ``start`` row; rows before the first start have 0."""
    return ordered.running_sum(rows, keys, order, F.when(start, 1).otherwise(0), name, width)


def group_records(rows: DataFrame, keys: Sequence[str], order: str, start: Column, text: str, sep: str = "\n",
                  width: int = ordered.CHUNK_ROWS) -> DataFrame:
    """Start rows with the text of the rows up to the next start appended.

    A record's text becomes one value in any case, so only its own rows are gathered.
    """
    numbered = islands(rows, keys, [order], start, "rec", width).filter("rec > 0")
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("txt"))))
    return (numbered.groupBy(*keys, "rec")
            .agg(F.min(order).alias("first_row"), F.count("*").alias("n_rows"), parts.alias("parts"))
            .select(*keys, "rec", "first_row", "n_rows", F.array_join(F.transform("parts", lambda p: p["txt"]), sep).alias("text")))


# ---- guide tables ------------------------------------------------------------------

def depth_path(lines: Column) -> Column:
    """'+'-prefixed lines to a path: wrapped lines merged, deeper goes below, shallower pops.

    A line stays on the path when every later line is deeper, which one backward pass decides.
    """
    merged = lists.merge_wrapped(lines)
    entries = F.filter(F.transform(merged, lambda x: F.struct(
        (F.length(x) - F.length(F.ltrim(x, F.lit("+")))).alias("d"), F.trim(F.ltrim(x, F.lit("+"))).alias("name"))), lambda e: e["name"] != "")
    start = F.struct(F.lit(1_000_000).alias("d"), F.array().cast("array<string>").alias("path"))
    last = F.aggregate(F.reverse(entries), start, lambda acc, e: F.when(
        e["d"] < acc["d"], F.struct(e["d"].alias("d"), F.concat(F.array(e["name"]), acc["path"]).alias("path"))).otherwise(acc))
    return F.array_join(last["path"], "/")


def with_label_values(rows: DataFrame, block: Column, out: str = "labels") -> DataFrame:
    """Adds a map label -> value of a requirement block; text before the first label is ``Rules``.

    The block is cut once into a column of its parts, so no label repeats the pattern matching.
    """
    mark, mid = "\u0001", "\u0002"
    pattern = "|".join(fixed.REQUIREMENT_LABELS)
    parts = F.split(F.regexp_replace(t.collapse_ws(block), f"({pattern})\\s+", f"{mark}$1{mid}"), mark)
    pair = lambda p: F.struct(F.substring_index(p, mid, 1).alias("label"), F.trim(F.substring_index(p, mid, -1)).alias("value"))
    first = F.trim(F.element_at("__parts", 1))
    labelled = F.transform(F.slice("__parts", F.lit(2), F.size("__parts") - 1), pair)
    pairs = F.when(first != "", F.concat(F.array(F.struct(F.lit("Rules").alias("label"), first.alias("value"))), labelled)).otherwise(labelled)
    cut = rows.withColumn("__parts", parts).withColumn("__pairs", pairs).withColumn(
        "__names", F.array_distinct(F.transform("__pairs", lambda x: x["label"])))
    # a label seen twice continues its first value
    values = F.transform("__names", lambda n: F.array_join(F.transform(F.filter("__pairs", lambda x: x["label"] == n), lambda x: x["value"]), " "))
    return cut.withColumn(out, F.map_from_arrays("__names", values)).drop("__parts", "__pairs", "__names")


def guide_records(cells: DataFrame, keys: Sequence[str] = ("doc_id",), order: str = "row_no", width: int = ordered.CHUNK_ROWS) -> DataFrame:
    """Four-column table rows (c0..c3, colour) to guide rows.

    An index in the first cell starts a record, a choice row stands alone and closes the one
    before it, other rows continue the open record. Red overrides yellow overrides white.
    """
    c0, c1, c2, c3 = (F.trim(t.blank(f"c{i}")) for i in range(4))
    rows = cells.filter((c0 != "#") & (c1 != "Mult"))
    is_new = c0.rlike(r"^\d+\.\d+")
    is_choice = ~is_new & c3.contains("xs:choice")
    rank = F.when(F.col("colour") == "red", 2).when(F.col("colour") == "yellow", 1).otherwise(0)
    flagged = rows.select(*keys, order, c0.alias("c0"), c1.alias("c1"), c2.alias("c2"), c3.alias("c3"), is_new.alias("is_new"),
                          is_choice.alias("is_choice"), rank.alias("rank"))
    numbered = islands(flagged, keys, [order], F.col("is_new") | F.col("is_choice"), "rec", width).filter("rec > 0")
    first = F.struct(order)
    per = numbered.groupBy(*keys, "rec").agg(
        F.min_by("is_choice", first).alias("is_choice"), F.min_by("c0", first).alias("idx"), F.min_by("c1", first).alias("mult"),
        F.min_by("c2", first).alias("choice_line"), F.min_by("rank", first).alias("first_rank"), F.max("rank").alias("rank"),
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "c2", "c3"))).alias("parts"), F.min(order).alias("first_row"))
    choice = F.col("is_choice")
    some = lambda f: F.filter(F.transform("parts", lambda p: p[f]), lambda x: x != "")
    lines = F.when(choice, F.filter(F.array("choice_line"), lambda x: x != "")).otherwise(some("c2"))
    block = F.when(choice, F.lit("XML Tag xs:choice")).otherwise(F.array_join(some("c3"), " "))
    parsed = with_label_values(per.withColumn("xpath", depth_path(lines)), block)
    get = lambda *names: F.coalesce(*[F.try_element_at("labels", F.lit(n)) for n in names], F.lit(""))
    colour = F.when(choice, F.col("first_rank")).otherwise(F.col("rank"))
    return parsed.select(
        *keys, "rec", "first_row", F.when(choice, "").otherwise(F.col("idx")).alias("idx"), "mult", "xpath",
        F.when(F.col("xpath") != "", t.last_segment("xpath")).otherwise(get("ISO Name")).alias("element_name"),
        get("ISO Name").alias("iso_name"), get("ISO Definition").alias("iso_definition"), get("XML Tag").alias("tag"), get("Type").alias("type"),
        get("ISO Length").alias("iso_length"), get("SEPA Length", "NPC Length").alias("length"),
        get("SEPA Usage Rule(s)", "NPC Usage Rule(s)", "Rules").alias("usage_rule"), get("SEPA Rulebook", "NPC Rulebook").alias("rulebook"),
        get("SEPA Format Rule(s)", "NPC Format Rule(s)").alias("format_rule"), get("SEPA FractDigits", "NPC FractDigits").alias("fract_digits"),
        get("SEPA Inclusive", "NPC Inclusive").alias("inclusive"), get("SEPA Code Restrictions", "NPC Code Restrictions").alias("code_restrictions"),
        F.when(colour == 2, "red").when(colour == 1, "yellow").otherwise("white").alias("row_color"), choice.alias("is_choice"))


def drop_structural(records: DataFrame) -> DataFrame:
    """Without choice markers and without records that have neither index, tag nor name."""
    return records.filter(~F.col("is_choice") & ((F.col("idx") != "") | (F.col("tag") != "") | (F.col("iso_name") != "")))


def section_stats(records: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    return records.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(F.col("row_color") == "yellow").alias("yellow"), F.count_if(F.col("row_color") == "red").alias("red"),
        (F.count("*") - F.count_if(F.col("row_color").isin("yellow", "red"))).alias("white"))


# ---- sections ----------------------------------------------------------------------

def section_headings(pages: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All 'n.n Use of X (aaaa.nnn.nnn.nn)' headings; dotted contents lines are skipped."""
    heading = fixed.SECTION_PATTERN.removeprefix("(?i)")
    with_context = r"(?is)(.{0,10})(?<!\d)(?<!\d\.)" + heading + r"(?=(.{0,20}))"
    part = lambda i: F.regexp_extract_all(F.col(text), F.lit(with_context), F.lit(i))
    # few pages carry a heading; the others are not matched at all
    likely = pages.filter(F.lower(F.col(text)).contains("use of"))
    found = likely.select(doc_id, "page_no", F.posexplode(F.arrays_zip(part(0).alias("whole"), part(5).alias("after"))).alias("i", "h"))
    group = lambda i: F.trim(F.regexp_extract("h.whole", r"(?is)(?<!\d)(?<!\d\.)" + heading + "$", i))
    return (found.filter(~F.concat("h.whole", "h.after").rlike(r"\.{5,}"))
            .select(doc_id, F.col("page_no").alias("page_start"), "i", group(1).alias("section_number"), group(2).alias("label"), F.lower(group(3)).alias("message")))


def dedupe_first(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key, chosen by partial aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def sections(pages: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = ordered.CHUNK_ROWS) -> DataFrame:
    """Headings with page range, instance number and sheet name."""
    found = dedupe_first(section_headings(pages, doc_id, text), [doc_id, "message", "page_start"], ["i"])
    found = found.withColumn("ord", F.col("page_start").cast("bigint") * 10_000 + F.col("i")).withColumn("neg", -F.col("ord"))
    ranged = ordered.previous(found, [doc_id], ["neg"], F.col("page_start"), "next_start", width)
    counts = pages.groupBy(doc_id).agg(F.max("page_no").alias("n_pages"))
    ranged = ranged.join(counts, doc_id).withColumn("page_end", F.coalesce(F.col("next_start") - 1, F.col("n_pages")).cast("int"))
    named = ordered.row_number(ranged, [doc_id, "message"], ["ord"], "section_id", width)
    base = F.replace("message", F.lit("."), F.lit("_"))
    return named.select(
        doc_id, "section_number", "label", "message", "page_start", "page_end", "section_id",
        F.when(F.col("section_id") == 1, base).otherwise(F.concat(base, F.lit("_"), F.col("section_id").cast("string"))).alias("sheet_name"))


def changes_start(pages: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """First page after the sixth that contains 'list of changes'; documents without one are absent."""
    hit = F.lower(F.col(text)).contains("list of changes") & (F.col("page_no") > 6)
    return pages.filter(hit).groupBy(doc_id).agg(F.min("page_no").alias("page_no"))


# ---- change logs -------------------------------------------------------------------

def infer_dataset(x) -> Column:
    return t.first_match(x, fixed.DATASETS)


def business_note(change_type: Column, description: Column) -> Column:
    prefix = F.create_map(*[F.lit(x) for kv in fixed.LOG_PREFIX.items() for x in kv])[change_type]
    notes = t.all_matches(F.lower(description), fixed.LOG_NOTES)
    return F.when(notes != "", F.concat(t.blank(prefix), F.lit("  "), notes)).otherwise(t.blank(prefix))


def _clean_cells(rows: DataFrame) -> DataFrame:
    cells = F.transform("cells", lambda c: F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))))
    return rows.withColumn("cells", cells).filter(F.exists("cells", lambda c: c != ""))


def change_log(rows: DataFrame, doc_id: str = "doc_id", order: str = "row_no", width: int = ordered.CHUNK_ROWS) -> DataFrame:
    """Table rows (cells array) to change-log entries.

    A number in the first cell starts an entry. Other rows name a dataset, which later entries
    inherit, or continue the description. The layout (with or without a status column) is
    the one of the document's first numbered row. Header rows are skipped.
    """
    cell = lambda i: F.coalesce(F.get("cells", F.lit(i)), F.lit(""))
    n = F.size("cells")
    clean = _clean_cells(rows)
    head = F.lower(F.rtrim(cell(0), F.lit("."))).isin(*fixed.LOG_HEADERS)
    header = head & ((n < 4) | F.lower(cell(3)).isin("description", ""))
    kept = clean.filter(~header)
    number = F.regexp_extract(cell(0), r"^(\d+)\.?$", 1)
    joined = F.array_join(F.filter("cells", lambda c: c != ""), " ")
    marked = kept.select(
        doc_id, order, "cells", number.alias("number"), F.when(number == "", F.nullif(infer_dataset(joined), F.lit(""))).alias("marker"),
        F.when(number != "", (n >= 6) & cell(4).isin(*fixed.LOG_STATUS)).alias("layout"))
    # read three times below; the pattern matching above is done once
    marked = checkpoint(marked)
    starts = F.when(F.col("number") != "", 1).otherwise(0).cast("bigint")
    numbered = ordered.running(marked, [doc_id], [order], {"rec": starts}, {"carried": F.col("marker")}, width).filter("rec > 0")
    extra = (F.when((F.col("number") != "") | F.col("marker").isNotNull(), "").when((n > 3) & (cell(3) != ""), cell(3))
             .when((cell(0) != "") & ~cell(0).startswith("N"), cell(0)).otherwise(""))
    first = F.struct(order)
    entries = numbered.withColumn("extra", extra).groupBy(doc_id, "rec").agg(
        F.min_by("cells", first).alias("cells"), F.min_by("number", first).alias("number"), F.min_by("carried", first).alias("carried"),
        F.array_sort(F.collect_list(F.when(F.col("extra") != "", F.struct(F.col(order).alias("o"), "extra")))).alias("more"))
    layouts = marked.filter(F.col("layout").isNotNull()).groupBy(doc_id).agg(F.min_by("layout", first).alias("with_status"))
    wide = F.col("with_status") & (n >= 6)
    kind = F.upper(F.when(wide, F.when(cell(5) == "", "CHAN").otherwise(cell(5))).when(n > 4, cell(4)).otherwise("CHAN"))
    kind = F.when(kind.isin(*fixed.LOG_TYPES), kind).otherwise("CHAN")
    text = t.collapse_ws(F.concat_ws(" ", F.array(cell(3)), F.transform("more", lambda m: m["extra"])))
    own = F.nullif(infer_dataset(F.concat(cell(1), F.lit(" "), cell(2))), F.lit(""))
    return joins.dim_join(entries, layouts, [doc_id], "inner").select(
        doc_id, "rec", "number", cell(1).alias("section_ref"), cell(2).alias("element_ref"), text.alias("description"),
        F.when(wide, cell(4)).otherwise("").alias("status"), kind.alias("change_type"),
        F.coalesce(own, "carried", F.lit(fixed.GENERAL_DATASET)).alias("dataset"),
    ).withColumn("business_note", business_note(F.col("change_type"), F.col("description")))


def change_log_stats(entries: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    return entries.groupBy(*by).agg(F.count("*").alias("total"), *[
        F.count_if(F.col("change_type") == c).alias(c.lower()) for c in fixed.LOG_TYPES])


# ---- runs --------------------------------------------------------------------------

def carry_forward(rows: DataFrame, keys: Sequence[str], order: Sequence[str], label: Column, name: str = "section",
                  default: str = fixed.GENERAL_DATASET, width: int = ordered.CHUNK_ROWS) -> DataFrame:
    """Last seen label for each row, its own first; a default before any label."""
    return ordered.last_known(rows, keys, order, label, name, width).withColumn(name, F.coalesce(name, F.lit(default)))


def section_breaks(rows: DataFrame, keys: Sequence[str], order: Sequence[str], section: str, width: int = ordered.CHUNK_ROWS) -> DataFrame:
    """Marks rows whose section differs from the row before (also the first row)."""
    return (ordered.previous(rows, keys, order, F.col(section), "__prev", width)
            .withColumn("is_break", ~F.col(section).eqNullSafe(F.col("__prev"))).drop("__prev"))


def contiguous_blocks(rows: DataFrame, keys: Sequence[str], position: str, flag: Column, width: int = ordered.CHUNK_ROWS) -> DataFrame:
    """Start and end position of each run of flagged rows; ``position`` numbers all rows without gaps."""
    flagged = rows.filter(flag).select(*keys, position)
    ranked = ordered.row_number(flagged, keys, [position], "__rn", width)
    return (ranked.groupBy(*keys, (F.col(position) - F.col("__rn")).alias("__g"))
            .agg(F.min(position).alias("first_row"), F.max(position).alias("last_row")).drop("__g"))


def format_once(rows: DataFrame, keys: Sequence[str], order: str, layout: Column) -> DataFrame:
    """The first known layout per document on all of its rows."""
    first = rows.withColumn("__l", layout).filter(F.col("__l").isNotNull()).groupBy(*keys).agg(F.min_by("__l", order).alias("layout"))
    # one document may hold most of the rows
    return joins.dim_join(rows, first, list(keys))
