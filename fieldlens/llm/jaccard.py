"""Exact Jaccard join on word shingles with a token-group matrix.

Documents with equal shingle sets form a class; all work is on classes. A pair is linked when its Jaccard similarity is
``NUM/DEN`` or more. What is asked for are the components of the links, so a group of copies is never expanded to pairs:

1. A pass over the texts gives class keys, set sizes, min-hash keys and a count sketch of all shingles.
2. Partition into groups: classes that share a min-hash key are compared with the most typical class of that key (one
   pair per member); verified links give first components. Components are cut into groups of about ``GROUP`` classes.
3. Token-group matrix: shingles are ordered from rare to frequent (by the sketch). Similar sets must share one of their
   first n - ceil(0.8 n) + 1 shingles, so these are all a group has to store: its token union with the sizes of its classes.
4. Bound: a class can only be similar to a member of a foreign group if one of its own first shingles is in the union,
   the sizes fit, and both have enough shingles after it. Only such groups are opened; their members are compared, first by
   the leading bits of the hashes of their shingles (which can only overrate a pair), what is left exactly.
5. New links join the first ones; the smallest doc_id of a component names it.

Only the sets of classes that take part in a comparison are made again and shuffled; every class is asked for by the hash
of one of its texts, and a bit table of fixed size tells a task which texts are meant.
Shingles and classes are known by 64-bit hashes. No cap anywhere: the sketch and the min-hash keys only steer how much
work is done.

Defined results: null texts and texts without words have an empty set, n_shingles 0 and themselves as component; a row
with a null id takes part and gets the smallest id of its component (null if there is none); equal rows are one class.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldlens.llm.base import CACHE, arrow_map, bit_table, components, hit, in_bits, mix, signed, stored, text_of, windows, WordHash

WIDTH = 5
NUM, DEN = 80, 100
#: min-hash keys: which minima make up each; keys of few minima find distant pairs, keys of many the close ones
KEYS = [*[range(k, k + 2) for k in range(0, 10, 2)], *[range(k, k + 4) for k in range(0, 24, 6)],
        *[range(k, 24, 3) for k in range(3)], *[range(k, k + 8) for k in range(0, 24, 8)]]
GROUP = 64
SKETCH_LOG = 22
_BLOCK = 1 << 14
SHORT = 24  # leading bits of a shingle's hash in the first look at opened pairs
CHUNK = 2_000_000  # shingles held at a time
_ODD = mix(np.arange(1, 25, dtype=np.uint64)) | np.uint64(1)


def shingles(text: str, seen: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; A to Z count as a to z."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.unique(windows(np.fromiter(map(seen.__getitem__, words), np.uint64, len(words)), WIDTH))


def class_key(own: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).view(np.int64)))


def prefix(n: int) -> int:
    """How many of the first shingles one must share with any similar set."""
    return n - -(-n * NUM // DEN) + 1


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its class, size, min-hash keys and typicality; at the end the task's part of the sketch, block by block.

    The sketch counts shingles that occur in two classes of a chunk or more: what is unique stays out of it and cannot
    blur the counts of what repeats. Typicality is the share of a document's shingles that repeat in its chunk: the
    common source of near copies has the highest.
    """
    seen, sketch, kind = WordHash(), np.zeros(1 << SKETCH_LOG, np.int64), pa.int64()
    names = ["doc_id", "of_text", "class", "n", "keys", "typical", "block", "counts"]

    def out(ids: pa.Array, texts: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        keys = [class_key(s) if len(s) else None for s in sets]
        flat = np.concatenate([np.zeros(0, np.uint64), *{k: s for k, s in zip(keys, sets, strict=True) if k is not None}.values()])
        flat.sort()
        values, counts = np.unique(flat, return_counts=True)
        values, counts = values[counts > 1], counts[counts > 1]
        np.add.at(sketch, (values >> np.uint64(64 - SKETCH_LOG)).astype(np.int64), counts)
        lows = [np.array([(s * o).min() for o in _ODD]) if len(s) else None for s in sets]
        mins = [[] if x is None else [xxhash.xxh3_64_intdigest(x[k].tobytes(), n) - (1 << 63) for n, k in enumerate(KEYS)] for x in lows]
        share = [float((values[np.minimum(np.searchsorted(values, s), len(values) - 1)] == s).mean()) if len(s) and len(values) else 0.0 for s in sets]
        none = [None] * len(sets)
        return pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.int64()), pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(mins, pa.list_(pa.int64())),
                                           pa.array(share, pa.float64()), pa.array(none, pa.int32()), pa.array(none, pa.binary())], names=names)

    ids, texts, sets, size = [], [], [], 0
    for batch in batches:
        kind = batch.schema.field(0).type
        for doc, text, of_text in zip(batch.column(0).to_pylist(), text_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            ids.append(doc)
            texts.append(of_text)
            sets.append(shingles(text, seen))
            size += len(sets[-1])
            if size > CHUNK:
                yield out(pa.array(ids, kind), texts, sets)
                ids, texts, sets, size = [], [], [], 0
    yield out(pa.array(ids, kind), texts, sets)
    blocks = [b for b in range(len(sketch) // _BLOCK) if sketch[b * _BLOCK:(b + 1) * _BLOCK].any()]
    none = [None] * len(blocks)
    yield pa.RecordBatch.from_arrays([pa.array(none, kind), *[pa.array(none, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64())], pa.array(blocks, pa.int32()),
                                      pa.array([zlib.compress(sketch[b * _BLOCK:(b + 1) * _BLOCK].astype(np.uint32).tobytes(), 1) for b in blocks], pa.binary())], names=names)


def _ranks(profiles: DataFrame) -> np.ndarray:
    """Rank (0 rare, 127 frequent) of every sketch slot; 4 MB whatever the input."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[block] = total.get(block, 0) + np.frombuffer(zlib.decompress(counts), np.uint32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(np.minimum(v, 2**32 - 1).astype(np.uint32).tobytes(), 1) for v in total.values()], pa.binary())], names=["block", "counts"])

    parts = profiles.where("block is not null").select("block", "counts")
    parts = parts.repartition(32, "block").transform(arrow_map, add, "block int, counts binary")
    out = np.zeros(1 << SKETCH_LOG)
    for r in parts.collect():
        out[r["block"] * _BLOCK:(r["block"] + 1) * _BLOCK] = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    return np.minimum(4 * np.log2(out + 1), 127).astype(np.uint8)


def _gaps(own: np.ndarray) -> bytes:
    """A sorted set as its gaps, byte by byte: the first bytes are zeros that a shuffle compresses away."""
    return np.diff(own, prepend=np.uint64(0)).astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_gaps(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(np.uint64), dtype=np.uint64)


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, kept_bits: int = 64) -> DataFrame:
    """Pairs (a, b) of classes that are similar enough: one text of every class in ``pairs`` is made to a set anew, no other text.

    With fewer ``kept_bits`` the sets travel as leading bits of their hashes, and what comes back are the pairs that may be
    similar enough: shingles that fall together count as shared, so no link is lost.
    """
    asked = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    bits = bit_table(classes.join(asked, "class", "left_semi"), "of_text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, done = WordHash(), set()
        for batch in batches:
            keys, sizes, data = [], [], []
            for text in text_of(batch.filter(pa.array(in_bits(bits, batch.column(1).to_numpy()))).column(0)):
                own = shingles(text, seen)
                if len(own) and (key := class_key(own)) not in done:
                    if len(done) >= CACHE:
                        done.clear()
                    done.add(key)
                    keys.append(key)
                    sizes.append(len(own))
                    data.append(_gaps(np.unique(own >> np.uint64(64 - kept_bits))))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())], names=["k", "n", "own"])

    own = docs.select("text", F.xxhash64("text").alias("of_text")).transform(arrow_map, sets, "k long, n long, own binary").dropDuplicates(["k"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, n_a, n_b in zip(*(batch.column(c).to_pylist() for c in ("own_a", "own_b", "n_a", "n_b")), strict=True):
                left, right = _from_gaps(x), _from_gaps(y)
                both = np.concatenate([left, right])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum()) + min(n_a - len(left), n_b - len(right))
                keep.append(DEN * shared >= NUM * (n_a + n_b - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a, b = (own.select(F.col("k").alias(c), F.col("own").alias(f"own_{c}"), F.col("n").alias(f"n_{c}")) for c in ("a", "b"))
    return pairs.select("a", "b").join(a, "a").join(b, "b").transform(arrow_map, check, "a long, b long")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, class (key of the shingle set), n_in_class and root (a class that stands for the component) of every row."""
    kind = docs.schema[doc_id].dataType.simpleString()
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    profiles = stored(docs.withColumn("of_text", F.xxhash64("text")).transform(arrow_map, _profiles, f"doc_id {kind}, of_text long, class long, n long, keys array<long>, typical double, block int, counts binary"))
    rows = profiles.where("block is null").select("doc_id", "of_text", "class", "n", "keys", "typical")
    ranks = _ranks(profiles)
    classes = rows.where("class is not null").groupBy("class").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.max("typical").alias("typical"), F.count("*").alias("copies"), F.min("doc_id").alias("low"), F.min("of_text").alias("of_text"))
    classes = stored(classes)

    # first groups: members of a min-hash key against its most typical class
    keyed = classes.select("class", "n", "typical", F.explode("keys").alias("key"))
    heads = stored(keyed.groupBy("key").agg(F.max(F.struct("typical", "class", "n")).alias("head"), F.count("*").alias("m")).where("m > 1"))
    stars = keyed.where(hit(bit_table(heads, "key"), F.col("key"))).join(heads, "key").where(F.col("class") != F.col("head.class")).where(_sizes_fit("n", "head.n"))
    stars = stored(stars.select(F.col("class").alias("a"), F.col("head.class").alias("b")).distinct())
    links = stored(_verified(docs, classes, stars))

    # token unions of groups
    members = _grouped(classes, links)
    tokens = docs.select("text").transform(arrow_map, _prefixes(ranks), "token long, class long, at int")
    over = Window.partitionBy("token")
    tokens = tokens.select("token", "class", "at", F.min("class").over(over).alias("__low"), F.max("class").over(over).alias("__high")).where("__low <> __high").select("token", "class", "at").distinct()
    tokens = stored(tokens.join(members, "class"))
    alone = tokens.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    tokens = tokens.join(alone, "token", "left_semi")
    matrix = tokens.groupBy("token", "root", "grp").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("at")).alias("room")).withColumnsRenamed({"root": "other"})
    # the first shingle that two similar sets share leaves both with enough shingles after it
    needed = (F.col("n") + F.greatest("least", F.ceil(F.col("n") * NUM / DEN))) * NUM
    bound = tokens.select("token", "class", "n", "at", "root").join(matrix, "token").where("root < other").where(
        (F.col("most") * DEN >= F.col("n") * NUM) & (F.col("n") * DEN >= F.col("least") * NUM)
        & ((F.col("n") - F.col("at")) * (NUM + DEN) >= needed) & (F.col("room") * (NUM + DEN) >= needed))
    opened = bound.select("class", "n", "other", F.col("grp")).distinct()
    inside = members.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("other"), "grp")
    pairs = opened.join(inside, ["other", "grp"]).where(_sizes_fit("n", "n_b")).select(F.col("class").alias("a"), "b").distinct()
    likely = stored(_verified(docs, classes, stored(pairs), SHORT))
    links = links.unionByName(_verified(docs, classes, likely))
    roots = components(links, "a", "b")

    # the smallest id of every component, back to the rows
    named = classes.select("class", "low", "copies").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "root").select("class", "component_id", "copies", "root")
    return rows.join(named, "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "class", F.coalesce("copies", F.lit(1)).alias("n_in_class"), "root")


def _grouped(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(class, n, root, grp): components of ``links`` in groups of about ``GROUP`` classes."""
    known = components(links, "a", "b")
    sizes = known.groupBy("root").agg((F.count("*") + 1).alias("size"))
    members = classes.select("class", "n").join(known.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    return stored(members.join(sizes, "root", "left").select("class", "n", "root", F.pmod(F.xxhash64("class"), F.ceil(F.coalesce("size", F.lit(1)) / GROUP)).alias("grp")))


def _sizes_fit(a: str, b: str):
    return (F.col(a) * DEN >= F.col(b) * NUM) & (F.col(b) * DEN >= F.col(a) * NUM)


def _prefixes(ranks: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, done = WordHash(), set()
        for batch in batches:
            tokens, keys, sizes = [], [], []
            for text in text_of(batch.column(0)):
                own = shingles(text, seen)
                if len(own) and (key := class_key(own)) not in done:
                    done.add(key)
                    ranked = (ranks[(own >> np.uint64(64 - SKETCH_LOG)).astype(np.int64)].astype(np.uint64) << np.uint64(57)) | (mix(own) >> np.uint64(7))
                    p = prefix(len(own))
                    tokens.append(np.sort(np.partition(ranked, p - 1)[:p]))
                    keys.append(key)
                    sizes.append(p)
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(tokens))), pa.array(np.repeat(np.array(keys, np.int64), sizes)),
                                                  pa.array(np.concatenate([np.arange(p, dtype=np.int32) for p in sizes]))], names=["token", "class", "at"])

    return rows


def _class_of(text: str) -> Column:
    """The class of a text; null for an empty set."""

    @F.pandas_udf("long")
    def classes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen = WordHash()
        for texts in batches:
            sets = [shingles(t or "", seen) for t in texts]
            yield pd.Series([class_key(own) if len(own) else None for own in sets], dtype="Int64")

    return classes(F.col(text))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of every component: the one with the smallest id, of equal ids the smallest text, of equal texts one row.

    A null id is larger than any other. Rows with an empty set stay. Rows are judged by id and class together, so a row of
    another component with the same id is not touched. Only rows whose id falls on the bit table of ids to judge are shuffled.
    """
    found = jaccard_components(docs, doc_id, text).where("n_shingles > 0").groupBy("doc_id", "class", "root", "component_id").agg(F.count("*").alias("n"))
    found = stored(found.withColumn("lowest", F.expr("doc_id <=> component_id")))
    several = found.where("lowest").groupBy("root").agg(F.sum("n").alias("rows")).where("rows > 1").select("root", F.lit(True).alias("several"))
    judged = stored(found.join(several, "root", "left").where("not lowest or several").select(F.col("doc_id").alias("__id"), F.col("class").alias("__class"), "root", "lowest"))
    id_key = lambda c: F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("")))
    bits = bit_table(judged.select(id_key("__id").alias("k")), "k")
    marked = docs.withColumn("__hit", hit(bits, id_key(doc_id)))
    rows = marked.where("__hit").select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row"), F.col(doc_id).alias("id"), F.col(text).alias("text")).withColumn("class", _class_of("text"))
    met = stored(rows.join(judged, F.col("id").eqNullSafe(F.col("__id")) & (F.col("class") == F.col("__class")), "left").select("row", "text", "root", "lowest"))
    # rows of the smallest id: the least (text, rest of the row) is found task by task before the shuffle
    order = F.struct(F.col("text"), F.to_json("row"))
    one = met.where("lowest").groupBy("root").agg(F.min_by("row", order).alias("row")).select("row")
    return marked.where("not __hit").drop("__hit").unionByName(met.where("root is null").select("row.*")).unionByName(one.select("row.*"))
