"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders, so a question with other parameters keeps its template. Windows of
``WIDTH`` template tokens, of a third of a shorter item, are hash-joined with those of the benchmark. Windows of one
document and one item on neighbouring diagonals (less than the item's length apart) belong together, so an inserted or
deleted word does not part them. They count if their slot values map one to one (the same benchmark value always became
the same document value); where they do not, those on a diagonal that does count alone, or those with unchanged values.
What counts must cover ``coverage`` of the item's windows. An item of 11 tokens or more stands any one changed word.

A bit table of fixed size, made from the benchmark's windows, lets a task drop its other windows before the shuffle;
false hits fall out in the join. Items up to ``WIDTH`` tokens are one window of their own length.
Items whose windows all hold too few plain tokens for a template ("What is 17 times 23?") are met word by word instead:
their windows are those of the words as they stand, so they are found verbatim, not re-parameterised.

Defined results: null and empty texts match nothing; an item without a plain token matches nothing; equal items are all
reported; rows with equal id and text share one result; the result has one row per (document, item) found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from fieldlens.llm.base import arrow_map, bit_table, CACHE, free_name, in_bits, signed, text_of, windows, without

WIDTH = 8  # the first word of a sentence is plain: its capital says nothing
LEAST_PLAIN = 4  # plain tokens a window needs, or all of a shorter item but one
COVERAGE = 0.5
CHUNK = 200_000  # tokens of texts looked at together
EDGE = ".,;:!?\"'()[]{}*"
NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*(?:%|st|nd|rd|th|[a-zA-Z]{1,3})?")
NUMBER_WORDS = frozenset("one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty hundred thousand million".split())
UNITS = frozenset((
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons pound pounds ounce ounces ml l litre litres liter liters gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees volt volts watt watts"
).split())
PLAIN, NUM, NAME, UNIT = range(4)


def _class(raw: str) -> tuple[int, int, str, bool, bool]:
    """(kind, hash, value, capitalised, ends a sentence); an empty value means no token."""
    value = raw.strip(EDGE)
    ends = raw[-1:] in ".!?:" and bool(raw)
    low = value.lower()
    if not value:
        return PLAIN, 0, "", False, ends
    if NUMBER.fullmatch(value) or low in NUMBER_WORDS:
        return NUM, 1, low, False, ends
    return UNIT if low in UNITS else PLAIN, xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass")), low, value[0].isupper(), ends


class Templates:
    """Template tokens of a text: hashes, slot values (None for plain tokens)."""

    def __init__(self) -> None:
        self.seen: dict[str, tuple] = {}
        self.known: dict[str, int] = {}

    def of(self, text: str) -> tuple[np.ndarray, list[str | None]]:
        seen, hashes, slots = self.seen, [], []
        if len(seen) > CACHE:
            seen.clear()
        start, last = True, PLAIN
        for line in text.split("\n"):
            start = True
            for raw in line.split():
                got = seen.get(raw)
                if got is None:
                    got = seen[raw] = _class(raw)
                kind, h, value, capital, ends = got
                if value:
                    if kind == PLAIN and capital and not start:
                        kind = NAME
                    if kind == UNIT and last != NUM:
                        kind = PLAIN
                    if kind == PLAIN:
                        hashes.append(h)
                        slots.append(None)
                    elif kind == NAME and last == NAME:  # names of several words are one slot
                        slots[-1] += " " + value
                    else:
                        hashes.append(kind)
                        slots.append(value)
                    last = kind
                start = ends
        return np.array(hashes, np.uint64), slots

    def words(self, text: str) -> tuple[np.ndarray, list[None]]:
        """Hashes of the words as they stand, slots and plain ones alike; no word has a slot value."""
        known, out = self.known, []
        if len(known) > CACHE:
            known.clear()
        for raw in text.split():
            h = known.get(raw)
            if h is None:
                value = raw.strip(EDGE).lower()
                h = known[raw] = xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass"), seed=1) if value else -1
            if h >= 0:
                out.append(h)
        return np.array(out, np.uint64), [None] * len(out)


def every_window(hashes: np.ndarray, slots: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of all windows."""
    keys = windows(hashes, width) if len(hashes) >= width else np.zeros(0, np.uint64)
    return np.arange(len(keys)), keys


def found_windows(hashes: np.ndarray, slots: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the windows with enough plain tokens."""
    if len(hashes) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    plain = np.concatenate([[0], np.cumsum(hashes > 3)])
    places = np.flatnonzero(plain[width:] - plain[:-width] >= min(LEAST_PLAIN, max(1, width - 1)))
    return places, windows(hashes, width)[places]


def item_width(tokens: int) -> int:
    """Tokens of an item's windows: one changed token of 11 or more leaves half of the windows."""
    return tokens if tokens <= WIDTH else max(LEAST_PLAIN, min(WIDTH, (tokens + 1) // 3))


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    templates = Templates()
    for batch in batches:
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), text_of(batch.column(1)), strict=True):
            hashes, slots = templates.of(text)
            width = item_width(len(hashes))
            if width:
                places, keys = found_windows(hashes, slots, width)
                verbatim = not len(places) and bool((hashes > 3).any())
                if verbatim:
                    hashes, slots = templates.words(text)
                    width = min(WIDTH, len(hashes))
                    places, keys = every_window(hashes, slots, width)
                rows += [(item, width, verbatim, int(p), int(k), len(hashes), len(places), [s for s in slots[p:p + width] if s is not None]) for p, k in zip(places, signed(keys), strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (batch.schema.field(0).type, pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())), strict=True)],
                                             names=["item_id", "width", "verbatim", "item_at", "key", "item_tokens", "item_windows", "item_slots"])


def _hits(made: list[tuple[np.ndarray, list]], widths: list[int], bits: np.ndarray, of_width=found_windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """(text, place, hash, slot values) of the windows of several texts that fall on a set bit; texts lie end to end, no window spans two."""
    lengths = np.array([len(h) for h, _ in made], np.int64)
    starts, flat = np.cumsum(lengths) - lengths, np.concatenate([np.zeros(0, np.uint64), *[h for h, _ in made]])
    text = np.repeat(np.arange(len(made)), lengths)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), 0)]
    for width in widths:
        where, keys = of_width(flat, [], width)
        own = (text[where] == text[where + width - 1]) & in_bits(bits, signed(keys))
        found.append((where[own], keys[own], width))
    at = np.concatenate([text[w] for w, _, _ in found]) if len(flat) else np.zeros(0, np.int64)
    places = np.concatenate([w for w, _, _ in found]) - (starts[at] if len(at) else 0)
    of = np.concatenate([np.full(len(w), n, np.int64) for w, _, n in found])
    values = [[s for s in made[k][1][p:p + n] if s is not None] for k, p, n in zip(at.tolist(), places.tolist(), of.tolist(), strict=True)]
    return at, places, np.concatenate([k for _, k, _ in found]), values


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", coverage: float = COVERAGE) -> DataFrame:
    """doc_id, row_key, item_id, matched windows, windows of the item, ``exact`` (all slots unchanged) for every leak."""
    kinds = docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).transform(
        arrow_map,
        _item_windows, f"item_id {kinds[1]}, width int, verbatim boolean, item_at long, key long, item_tokens long, item_windows long, item_slots array<string>")
    kept = items.select("verbatim", "width").distinct().collect()  # at most WIDTH of either kind
    widths, verbatim = ([r["width"] for r in sorted(kept) if r["verbatim"] is v] for v in (False, True))
    bits = bit_table(items, "key")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for batch in batches:
            made, plain, size, first = [], [], 0, 0
            for k, t in enumerate(text_of(batch.column(2))):
                made.append(templates.of(t))
                if verbatim:
                    plain.append(templates.words(t))
                size += len(made[-1][0])
                if size > CHUNK or k == len(batch) - 1:
                    for at, places, keys, values in (_hits(made, widths, bits), *([_hits(plain, verbatim, bits, every_window)] if verbatim else [])):
                        take = pa.array(at + first)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(places), pa.array(signed(keys)), pa.array(values, pa.list_(pa.string()))],
                                                         names=["doc_id", "row_key", "doc_at", "key", "doc_slots"])
                    made, plain, size, first = [], [], 0, k + 1

    keyed = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"), F.col(text).alias("text"))
    hits = keyed.transform(arrow_map, rows, f"doc_id {kinds[0]}, row_key long, doc_at long, key long, doc_slots array<string>")
    pairs = hits.join(items, "key").where(F.size("doc_slots") == F.size("item_slots"))
    found = ["doc_id", "row_key", "item_id", "item_windows"]
    lines = pairs.groupBy(*found, "item_tokens", (F.col("doc_at") - F.col("item_at")).alias("diagonal")).agg(
        F.collect_set("item_at").alias("places"), F.collect_set(F.when(F.col("item_slots") == F.col("doc_slots"), F.col("item_at"))).alias("same"),
        F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("item_slots", "doc_slots")))).alias("slots"))
    sizes = [F.expr(f"size(array_distinct(transform(slots, s -> s.{n})))") for n in ("item_slots", "doc_slots")]
    one_to_one = (sizes[0] == F.size("slots")) & (sizes[1] == F.size("slots"))
    unchanged = F.forall("slots", lambda s: s["item_slots"] == s["doc_slots"])
    enough = lambda n: n >= coverage * F.col("item_windows")
    lines = lines.withColumn("alone", F.when(one_to_one, F.size("places")).otherwise(0)).withColumn("alone_exact", unchanged & enough(F.size("places")))
    # neighbouring diagonals
    order = Window.partitionBy("doc_id", "row_key", "item_id").orderBy("diagonal")
    lines = lines.withColumn("apart", F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) >= F.col("item_tokens"), F.lit(False)).cast("int")).withColumn("near", F.sum("apart").over(order))
    joined = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    groups = lines.groupBy(*found, "near").agg(joined("places").alias("places"), joined("same").alias("same"), joined("slots").alias("slots"), F.max("alone").alias("alone"), F.max("alone_exact").alias("alone_exact"))
    groups = groups.withColumn("n_windows", F.greatest("alone", F.when(one_to_one, F.size("places")).otherwise(F.size("same"))).cast("long")).where(enough(F.col("n_windows")))
    return groups.groupBy(*found).agg(F.max("n_windows").alias("n_windows"), F.max(F.col("alone_exact") | unchanged).alias("exact"))


def row_key(doc_id: str, text: str):
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a leaked item; columns as they were."""
    key = free_name(docs, "key")
    bad = leaks(docs, benchmark, doc_id, text).select(F.col("row_key").alias(key)).distinct()
    return without(docs.withColumn(key, row_key(doc_id, text)), bad, key).drop(key)
