"""Page text of documents: pages, similarity, line and word differences, page plans, tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fieldlens import fixed
from fieldlens.functions import lists, text as t
from fieldlens.operators import joins, ordered
from fieldlens.session import checkpoint


def read_pages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lines_per_page: int = 5) -> DataFrame:
    """(doc_id, page_no, raw, text): pages of ``lines_per_page`` lines, whitespace-cleaned text beside the raw one."""
    lines = F.split(F.col(text), "\n")
    n = F.ceil(F.size(lines) / lines_per_page).cast("int")
    pages = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda p: F.struct(
        p.alias("page_no"), F.array_join(F.slice(lines, (p - 1) * lines_per_page + 1, lines_per_page), "\n").alias("raw")))
    return docs.select(doc_id, F.inline(pages)).withColumn("text", t.collapse_ws("raw"))


def pair_documents(docs: DataFrame, doc_id: str = "doc_id", within: str = "source") -> DataFrame:
    """Each document with the next one of its source: (pair_id, left_doc, right_doc).

    A source may hold a third of all documents, so the look-back is chunked.
    """
    ids = docs.select(within, F.col(doc_id).cast("bigint").alias("right_doc"))
    paired = ordered.previous(ids, [within], ["right_doc"], F.col("right_doc"), "left_doc")
    # ids only, and both sides of every comparison read them
    return checkpoint(paired.filter(F.col("left_doc").isNotNull()).select(F.col("left_doc").alias("pair_id"), "left_doc", "right_doc"))


def pair_pages(pages: DataFrame, pairs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Page n meets page n of the paired document; unmatched pages are one-sided."""
    def side(column, name):
        keys = pairs.select("pair_id", F.col(column).alias(doc_id))
        return joins.dim_join(pages, keys, [doc_id], "inner").select(
            "pair_id", "page_no", F.col("text").alias(f"{name}_text"), F.col("raw").alias(f"{name}_raw"))

    return side("left_doc", "a").join(side("right_doc", "b"), ["pair_id", "page_no"], "full")


def page_similarity() -> Column:
    """Jaccard percent of the lower-cased word sets of both sides."""
    words = lambda c: lists.words(F.lower(t.blank(c)))
    return lists.jaccard_pct(words("a_text"), words("b_text"))


def page_badge(similarity: str = "similarity") -> Column:
    s = F.col(similarity)
    return (F.when(F.col("a_text").isNull(), "Added in B").when(F.col("b_text").isNull(), "Only in A")
            .when(s >= 99, "Identical").when(s >= 70, "Similar").otherwise("Changed"))


def page_stats(pairs: DataFrame) -> DataFrame:
    """Per document pair: mean similarity, identical and changed pages, page-count difference."""
    both = F.col("a_text").isNotNull() & F.col("b_text").isNotNull()
    s = F.when(both, F.col("similarity"))
    # tenths are summed as integers, so the mean does not depend on the order of addition
    tenths = F.round(s * 10).cast("bigint")
    return pairs.groupBy("pair_id").agg(
        F.coalesce(F.floor(F.sum(tenths) / F.count(s) + 0.5) / 10, F.lit(0.0)).alias("mean_similarity"),
        F.count_if(s >= 99).alias("identical"), F.count_if(s < 99).alias("changed"),
        (F.count("b_text") - F.count("a_text")).alias("extra_in_b"))


def page_counts(pages: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return pages.groupBy(doc_id).agg(F.count("*").alias("pages"))


# ---- differences -------------------------------------------------------------------

def _met_items(pairs: DataFrame, keys: Sequence[str], a: str, b: str, unit: Column) -> DataFrame:
    """Words or lines of both sides with their occurrence number and where else they occur.

    ``unit`` (word or line) is chosen per pair. One repartition by (pair, item) serves the
    occurrence numbers, the membership flags and the pairing that follows.
    """
    both = F.array(F.struct(F.lit("a").alias("side"), F.col(a).alias("txt")), F.struct(F.lit("b").alias("side"), F.col(b).alias("txt")))
    rows = pairs.select(*keys, unit.alias("unit"), F.inline(both)).filter(F.col("txt").isNotNull())
    parts = F.when(F.col("unit") == "word", lists.words(F.col("txt"))).otherwise(F.split("txt", "\n"))
    items = rows.select(*keys, "unit", "side", F.posexplode(parts).alias("pos", "item")).repartition(*keys, "item")
    same = W.partitionBy(*keys, "item")
    return (items.withColumn("n", F.row_number().over(W.partitionBy(*keys, "item", "side").orderBy("pos")))
            .withColumn("in_a", F.max(F.col("side") == "a").over(same)).withColumn("in_b", F.max(F.col("side") == "b").over(same)))


def line_diff(pairs: DataFrame, keys: Sequence[str] = ("pair_id",), a: str = "a_raw", b: str = "b_raw") -> DataFrame:
    """Lines of A tagged eq or del by membership in B, then lines of B not in A as ins.

    Order and duplicates are kept through (side, pos).
    """
    rows = _met_items(pairs, keys, a, b, F.lit("line")).filter((F.col("side") == "a") | ~F.col("in_a"))
    tag = F.when(F.col("side") == "b", "ins").when(F.col("in_b"), "eq").otherwise("del")
    return rows.select(*keys, "side", "pos", F.col("item").alias("line"), tag.alias("tag"))


def word_diff(pairs: DataFrame, keys: Sequence[str] = ("pair_id", "page_no"), a: str = "a_text", b: str = "b_text") -> DataFrame:
    """eq, del and ins words of text pairs; the n-th occurrence of a word in A meets the n-th in B."""
    rows = _met_items(pairs, keys, a, b, F.lit("word"))
    met = rows.groupBy(*keys, "item", "n").agg(
        F.max(F.when(F.col("side") == "a", F.col("pos"))).alias("a_pos"), F.max(F.when(F.col("side") == "b", F.col("pos"))).alias("b_pos"))
    tag = F.when(F.col("a_pos").isNull(), "ins").when(F.col("b_pos").isNull(), "del").otherwise("eq")
    return met.select(*keys, "item", "a_pos", "b_pos", tag.alias("tag"))


def compare_metadata(a: DataFrame, b: DataFrame, key: str, labels: Sequence[str]) -> DataFrame:
    """Label-wise comparison of two metadata rows with a changed flag."""
    def long(df, name):
        pairs = F.array(*[F.struct(F.lit(x).alias("label"), F.col(x).cast("string").alias(name)) for x in labels])
        return df.select(key, F.inline(pairs))

    return long(a, "left_value").join(long(b, "right_value"), [key, "label"], "full").withColumn(
        "changed", ~F.col("left_value").eqNullSafe(F.col("right_value")))


def doc_metadata(pages: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Document number, version, dates and scheme from the first page."""
    text = F.col("text")
    grab = lambda p, g=1: F.trim(F.regexp_extract(text, p, g))
    number = r"((?:EPC|NPC)\d+-\d+)\s*/\s*(\d{4}\s+Version\s+[\d.]+)"
    date = r"(?i)Date %s[:\s]+([\d]+\s+\w+\s+\d{4}|\d{4}-\d{2}-\d{2})"
    return pages.filter("page_no = 1").select(
        doc_id, grab(number).alias("doc_number"), grab(number, 2).alias("version"),
        grab(date % "issued").alias("date_issued"), grab(date % "effective").alias("date_effective"),
        F.when(text.rlike("Nordic|NPC"), "NCT Inst (NPC)").when(text.rlike(r"SEPA|SCT\s*Inst"), "SCT Inst (EPC)").otherwise("").alias("scheme"))


# ---- page plans --------------------------------------------------------------------

def page_plan(counts: DataFrame, mode: str, chunk: int = 1, ranges: str = "", doc_id: str = "doc_id") -> DataFrame:
    """Which pages go to which output part: mode ``pages``, ``chunks`` or ``ranges``.

    Unreadable or out-of-bounds ranges give an error row without pages.
    """
    n = F.col("pages").cast("int")
    if mode == "ranges":
        parts = counts.select(doc_id, n.alias("pages"), F.posexplode(lists.parse_ranges(F.lit(ranges))).alias("i", "r"))
        ok = (F.col("r.first") >= 1) & (F.col("r.first") <= F.col("r.last")) & (F.col("r.last") <= F.col("pages"))
        parts = parts.withColumn("ok", F.coalesce(ok, F.lit(False)))
        pages = F.when(F.col("ok"), F.sequence("r.first", "r.last")).otherwise(F.array(F.lit(None).cast("int")))
        return parts.select(
            doc_id, (F.col("i") + 1).alias("part"), F.explode(pages).alias("page_no"),
            F.when(F.col("ok"), F.concat(F.lit("pages_"), F.col("r.first").cast("string"), F.lit("-"), F.col("r.last").cast("string")))
            .otherwise(F.concat(F.lit("invalid range: "), F.col("r.part"))).alias("part_name"))
    size = 1 if mode == "pages" else chunk
    rows = counts.select(doc_id, n.alias("pages"), F.explode(F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).alias("page_no"))
    part = (F.floor((F.col("page_no") - 1) / size) + 1).cast("int")
    name = (F.concat(F.lit("page_"), F.col("page_no").cast("string")) if mode == "pages" else
            F.concat(F.lit("part_"), part.cast("string")))
    return rows.select(doc_id, part.alias("part"), "page_no", name.alias("part_name"))


def concat_pages(pages: DataFrame, doc_id: str = "doc_id", width: int = ordered.CHUNK_ROWS) -> DataFrame:
    """Pages of several documents numbered through in document order.

    Offsets come from the page counts per document, so no task ever sees all pages.
    """
    counts = page_counts(pages, doc_id).withColumn("doc_pos", F.col(doc_id).cast("bigint"))
    total = ordered.running_sum(counts, [], ["doc_pos"], F.col("pages"), "through", width)
    offsets = total.select(doc_id, (F.col("through") - F.col("pages")).alias("offset"))
    return joins.dim_join(pages, offsets, [doc_id], "inner").select(doc_id, "page_no", (F.col("offset") + F.col("page_no")).alias("out_page"))


# ---- tables on pages ---------------------------------------------------------------

def page_tables(docs: DataFrame, tables: str = "tables", doc_id: str = "doc_id") -> DataFrame:
    """Cells of nested page tables: (doc_id, page_no, table_no, row_no, col_no, text, key).

    ``tables`` is an array over pages of arrays of tables of rows of cells. Tables with fewer
    than two rows are dropped; numbering starts at one and counts all tables of the page.
    """
    pages = docs.select(doc_id, F.posexplode(tables).alias("p", "page"))
    found = pages.select(doc_id, "p", F.posexplode("page").alias("tn", "tbl")).filter(F.size("tbl") >= 2)
    rows = found.select(doc_id, "p", "tn", F.posexplode("tbl").alias("r", "row"))
    return rows.select(doc_id, (F.col("p") + 1).alias("page_no"), (F.col("tn") + 1).alias("table_no"), (F.col("r") + 1).alias("row_no"),
                       F.posexplode("row").alias("c", "cell")).select(
        doc_id, "page_no", "table_no", "row_no", (F.col("c") + 1).alias("col_no"), t.collapse_ws("cell").alias("text"),
        F.format_string("P%d_T%d", "page_no", "table_no").alias("key"))


def table_summary(cells: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Data rows (without the header) and columns per table."""
    return cells.groupBy(doc_id, "key").agg((F.max("row_no") - 1).alias("data_rows"), F.max("col_no").alias("columns"))


def table_compare(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("pair_id",)) -> DataFrame:
    """Cells of table i of page n against the same cell of the other side; only the differing ones."""
    on = [*keys, "page_no", "table_no", "row_no", "col_no"]
    both = a.select(*on, F.col("text").alias("left_text")).join(b.select(*on, F.col("text").alias("right_text")), on, "full")
    return both.filter(~F.col("left_text").eqNullSafe(F.col("right_text")))


def row_colour(cells: DataFrame, rects: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Colour of table rows: midpoint inside a coloured rectangle of the page, red before yellow.

    ``cells`` has (doc_id, page_no, row_no, top, bottom), ``rects`` (doc_id, page_no, top, bottom, r, g, b).
    """
    def near(rgb, tol):
        return ((F.abs(F.col("r") - rgb[0]) < tol) & (F.abs(F.col("g") - rgb[1]) < tol) & (F.abs(F.col("b") - rgb[2]) < tol))

    rank = F.lit(0)
    for name, *rgb, tol in fixed.RECT_COLOURS:
        rank = F.greatest(rank, F.when(near(rgb, tol), 2 if name == "red" else 1).otherwise(0))
    # a page holds few rectangles; they are gathered per page so rows are not multiplied
    per_page = (rects.withColumn("rank", rank).filter("rank > 0").groupBy(doc_id, "page_no")
                .agg(F.collect_set(F.struct("top", "bottom", "rank")).alias("areas")))
    mid = (F.col("top") + F.col("bottom")) / 2
    inside = F.filter("areas", lambda x: (mid >= x["top"]) & (mid <= x["bottom"]))
    best = F.coalesce(F.array_max(F.transform(inside, lambda x: x["rank"])), F.lit(0))
    return cells.join(per_page, [doc_id, "page_no"], "left").withColumn(
        "colour", F.when(best == 2, "red").when(best == 1, "yellow").otherwise("white")).drop("areas")
