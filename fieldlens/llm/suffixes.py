"""Removal of bytes that repeat an earlier document, by suffix arrays over the regions where texts meet.

A byte goes when it lies in a ``LENGTH``-byte string that also starts in a document with a smaller id. Every such string
has an anchor, chosen from its content alone: the place of its smallest ``GRAM``-byte hash. Equal strings have equal
anchors, so texts only have to be compared where anchors meet:

1. A pass over the texts packs the anchor hashes of a piece of a task, one row per hash bucket; an anchor that occurs in several
   documents of a piece is packed twice. A hash that a bucket holds twice occurs in two documents or more (or in two rows of
   one id, which only costs time); a bit table of fixed size holds these.
2. A second pass cuts out the fragment around each such anchor: all strings it is the anchor of.
3. Per anchor bucket, equal fragments collapse to the smallest id. Where an anchor has different fragments, a suffix
   array of them is built by two-stage sorting: suffixes smaller than their successor are sorted directly, all others
   follow from bucket scans. Adjacent common prefixes of ``LENGTH`` or more form runs, and the smallest id of a run
   decides which strings repeat an earlier document.
4. Spans return to their documents; only documents that lose some of their bytes are shuffled with their text.

A bucket is a hash range of anchors and an anchor occurs at most once per task and text, so frequent passages do not
grow a bucket beyond tasks x passages. Equal texts within a task go out once.

Defined results: null and empty texts have 0 bytes and the digest of nothing; texts below ``LENGTH`` bytes stay whole;
a null id counts as larger than every id; rows with equal ids never remove from one another.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from fieldlens.llm.base import arrow_map, BIT_LOG, bit_table, hit, in_bits, mix, signed, stored, text_of

LENGTH = 50
GRAM = 24
REACH = LENGTH - GRAM + 1  # places of a gram in a string
LAST = (1 << 63) - 1
PIECE = 8 << 20  # bytes of text packed at a time
#: an odd factor to the powers 1, 2, 4 and 8, modulo 2^64
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, 1 << k, 1 << 64)) for k in range(4)]
EMPTY = hashlib.sha256(b"").hexdigest()


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first start, last start) of every anchor of a text, in order."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    one = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    powers = _POWERS
    two = one[:-1] * powers[0] + one[1:]
    four = two[:-2] * powers[1] + two[2:]
    eight = four[:-4] * powers[2] + four[4:]
    sixteen = eight[:-8] * powers[3] + eight[8:]
    grams = mix(sixteen[:-8] * powers[3] + eight[16:])
    places = np.arange(len(grams), dtype=np.uint64)
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | places
    for step in (1, 2, 4, 8):
        low = np.minimum(low[:-step], low[step:])
    low = np.minimum(low[: n], low[REACH - 16: REACH - 16 + n]) & np.uint64(0xFFFFFFFF)
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    # a minimum is small: mixed once more, keys fill hash ranges and bit tables evenly
    return mix(grams[low[first].astype(np.int64)]), first, np.concatenate([first[1:] - 1, [n - 1]])


def two_stage(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffix array of small non-negative numbers, right to ``depth`` symbols; the end counts as smaller than all."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    symbols = np.concatenate([text.astype(np.int64) + 1, [0]])
    # a suffix is smaller than its successor if the first unequal symbol after it is larger
    change = np.flatnonzero(symbols[:-1] != symbols[1:])
    nearest = change[np.searchsorted(change, np.arange(n))]
    small = symbols[nearest] < symbols[nearest + 1]
    # stage one: sort these directly, 6 symbols (of at most 9 bits) to a key, then ties only
    width = 6
    keys = np.zeros(n + depth + 2 * width, np.int64)
    padded = np.concatenate([symbols, np.zeros(depth + 2 * width, np.int64)])
    for k in range(width):
        keys[: n + 1] = keys[: n + 1] * 512 + padded[k: n + 1 + k]
    direct = np.flatnonzero(small)
    columns = [keys[direct + k] for k in range(0, depth + width, width)]
    order = np.argsort(columns[0], kind="stable")
    for level in range(1, len(columns)):
        prior = np.stack([c[order] for c in columns[:1]]) if level == 1 else prior
        tied = np.concatenate([[False], prior[0][1:] == prior[0][:-1]]) if level == 1 else tied
        group = np.cumsum(~tied)
        loose = tied | np.concatenate([tied[1:], [False]])
        if not loose.any():
            break
        at = np.flatnonzero(loose)
        own, g = columns[level][order[at]], group[at]
        sub = np.lexsort((own, g))
        order[at] = order[at][sub]
        own, g = own[sub], g[sub]
        tied = np.zeros(len(order), bool)
        tied[at[1:]] = (g[1:] == g[:-1]) & (own[1:] == own[:-1])
    direct = direct[order]
    # stage two: scan the buckets upwards, every entry sends its larger predecessor to the front of that one's bucket
    first_of = symbols[direct]
    lists: dict[int, list[np.ndarray]] = {}

    def send(entries: np.ndarray, here: int) -> np.ndarray:
        before = entries[entries > 0] - 1
        before = before[~small[before]]
        heads = symbols[before]
        up = heads > here
        out, where = before[up], heads[up]
        if len(out):
            by = np.argsort(where, kind="stable")
            cuts = np.flatnonzero(np.diff(where[by])) + 1
            for part in np.split(out[by], cuts):
                lists.setdefault(int(symbols[part[0]]), []).append(part)
        return before[~up & (heads == here)]

    send(np.array([n]), 0)
    result = []
    for c in range(1, int(symbols.max()) + 1):
        own = np.concatenate(lists.pop(c, []) or [np.zeros(0, np.int64)])
        parts = []
        while len(own):  # runs of one symbol: predecessors in the same bucket follow in order
            parts.append(own)
            before = own[own > 0] - 1
            own = before[(~small[before]) & (symbols[before] == c)]
        lo, hi = np.searchsorted(first_of, [c, c + 1])
        parts.append(direct[lo:hi])
        whole = np.concatenate(parts)
        send(whole, c)
        result.append(whole)
    return np.concatenate(result)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Symbols that each suffix shares with the one before it, up to ``depth``."""
    padded = np.concatenate([text.astype(np.int64), -np.arange(1, depth + 1)])
    out, left = np.zeros(len(order), np.int64), np.arange(1, len(order))
    for k in range(depth):
        left = left[padded[order[left] + k] == padded[order[left - 1] + k]]
        if not len(left):
            break
        out[left] = k + 1
    return out


def repeats_in(fragments: list[bytes], ids: list[int]) -> list[np.ndarray]:
    """Per fragment, the starts whose string also starts in a fragment with a smaller id."""
    sizes = np.array([len(f) for f in fragments])
    text = np.frombuffer(b"".join(fragments), np.uint8)
    owner = np.repeat(np.arange(len(fragments)), sizes)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    whole = np.arange(len(text)) - begin[owner] <= (sizes - LENGTH)[owner]
    order = two_stage(text)
    order = order[whole[order]]
    runs = np.flatnonzero(common_prefixes(text, order) < LENGTH)
    doc = np.array(ids, np.int64)[owner[order]]
    least = np.repeat(np.minimum.reduceat(doc, runs), np.diff(np.concatenate([runs, [len(order)]])))
    late = np.sort(order[least < doc])
    return np.split(late - begin[owner[late]], np.searchsorted(owner[late], np.arange(1, len(fragments))))


def _ids(col: pa.Array) -> list[int]:
    return [LAST if i is None else i for i in col.to_pylist()]


def _packed(buckets: int, meeting: np.ndarray | None):
    """Pass 1 (``meeting`` None): anchors; pass 2: fragments of the anchors on set bits."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, int]]:
        """Pieces of (id, bytes); a text equal to one the task has seen goes out again only for a smaller id."""
        seen: dict[bytes, int] = {}
        piece, size = [], 0
        for batch in batches:
            for doc, text in zip(_ids(batch.column(0)), text_of(batch.column(1)), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                if len(data) < LENGTH:
                    continue
                known = xxhash.xxh3_128_digest(data)
                if seen.get(known, LAST + 1) <= doc:
                    continue
                seen[known] = doc
                piece.append((doc, data))
                size += len(data)
                if size >= PIECE:
                    yield piece
                    piece, size = [], 0
        yield piece

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in texts(batches):
            if not piece:
                continue
            found = [anchors(d) for _, d in piece]
            keys = np.concatenate([f[0] for f in found])
            doc = np.repeat(np.array([i for i, _ in piece], np.int64), [len(f[0]) for f in found])
            if meeting is None:
                order = np.lexsort((doc, keys))
                keys, doc = keys[order], doc[order]
                edge = np.ones(len(keys) + 1, bool)
                edge[1:-1] = keys[1:] != keys[:-1]
                # every anchor once, and once more if the piece has it under two ids
                first, last = np.flatnonzero(edge[:-1]), np.flatnonzero(edge[1:])
                keys = keys[np.sort(np.concatenate([first, last[doc[last] != doc[first]]]))]
                cuts = np.searchsorted(keys, _edges(buckets))
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(buckets), pa.int32()), pa.array([_five(keys[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["bucket", "keys"])
            else:
                base = np.concatenate([[0], np.cumsum([len(d) for _, d in piece])[:-1]])
                text = b"".join(d for _, d in piece)
                of = np.repeat(np.arange(len(piece)), [len(f[0]) for f in found])
                first, last = np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])
                at = np.flatnonzero(in_bits(meeting, keys))
                at = at[np.argsort(keys[at], kind="stable")]
                cuts = np.searchsorted(keys[at], _edges(buckets))
                for b in range(buckets):
                    own = at[cuts[b]:cuts[b + 1]]
                    if len(own):
                        begin, end = base[of[own]] + first[own], base[of[own]] + last[own] + LENGTH
                        data = [text[s:e] for s, e in zip(begin.tolist(), end.tolist(), strict=True)]
                        # a fragment equal to the one before it is not repeated: size 0
                        again = np.array([False, *[x == y for x, y in zip(data[1:], data[:-1], strict=True)]]) & np.concatenate([[False], keys[own][1:] == keys[own][:-1]])
                        size = np.where(again, 0, end - begin).astype(np.uint8)
                        yield pa.RecordBatch.from_arrays([
                            pa.array([b], pa.int32()), *[pa.array([x], pa.binary()) for x in (_five(keys[own]), _narrow(doc[own]), _narrow(first[own]), size.tobytes())],
                            pa.array([zlib.compress(b"".join([d for d, r in zip(data, again.tolist(), strict=True) if not r]), 1)], pa.binary())], names=["bucket", "keys", "doc", "first", "size", "data"])

    return rows


def _edges(buckets: int) -> np.ndarray:
    """Lower ends of equal ranges of 64-bit keys, and one beyond."""
    return np.array([(b << 64) // buckets for b in range(buckets)] + [(1 << 64) - 1], np.uint64)


def _five(keys: np.ndarray) -> bytes:
    """Bits 16 to 55 of each key, the bucket tells those above; two anchors that differ only below meet for nothing."""
    return keys.view(np.uint8).reshape(-1, 8)[:, 2:7].tobytes()


def _narrow(numbers: np.ndarray) -> bytes:
    """Four bytes a number where all fit, eight otherwise."""
    return numbers.astype(np.uint32).tobytes() if len(numbers) and 0 <= numbers.min() and numbers.max() < 1 << 32 else numbers.astype(np.int64).tobytes()


def _keys(table: pa.Table, buckets: int) -> np.ndarray:
    parts = table.column("keys").to_pylist()
    five = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 5)
    out = np.zeros((len(five), 8), np.uint8)
    out[:, 2:7] = five
    top = np.array(table.column("bucket").to_pylist(), np.uint64) << np.uint64(65 - buckets.bit_length())
    return out.view(np.uint64).ravel() | np.repeat(top, [len(x) // 5 for x in parts])


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    parts = [np.frombuffer(x, np.uint32 if len(x) * 5 == 4 * len(k) else np.int64).astype(np.int64) for k, x in zip(table.column("keys").to_pylist(), table.column(name).to_pylist(), strict=True)]
    return np.concatenate([np.zeros(0, np.int64), *parts])


def _meeting(table: pa.Table, buckets: int) -> pa.Table:
    """Slots of the anchors that a bucket holds twice or more."""
    keys = np.sort(_keys(table, buckets))
    slot = np.unique(keys[1:][keys[1:] == keys[:-1]] >> np.uint64(64 - BIT_LOG))
    return pa.table({"slot": pa.array((slot << np.uint64(64 - BIT_LOG)).view(np.int64))})


def _late(table: pa.Table, buckets: int) -> pa.Table:
    """(doc, first, last) start ranges of strings that start in an earlier document too."""
    keys, docs, first = _keys(table, buckets), _numbers(table, "doc"), _numbers(table, "first")
    size = np.frombuffer(b"".join(table.column("size").to_pylist()), np.uint8).astype(np.int64)
    data = b"".join(map(zlib.decompress, table.column("data").to_pylist()))
    end = np.cumsum(size)
    pieces: list[bytes] = []
    for s, e in zip(size.tolist(), end.tolist(), strict=True):
        pieces.append(data[e - s:e] if s else pieces[-1])
    least: dict[tuple[int, bytes], int] = {}
    for key, doc, piece in zip(keys.tolist(), docs.tolist(), pieces, strict=True):
        if least.get((key, piece), LAST + 1) > doc:
            least[key, piece] = doc
    kinds: dict[int, list[bytes]] = {}
    for key, piece in least:
        kinds.setdefault(key, []).append(piece)
    mixed = [(key, piece) for key, own in kinds.items() if len(own) > 1 for piece in own]
    partly: dict[tuple[int, bytes], np.ndarray] = {}
    for start in _slices([len(p) for _, p in mixed], [k for k, _ in mixed]):
        part = mixed[start[0]:start[1]]
        for name, starts in zip(part, repeats_in([p for _, p in part], [least[x] for x in part]), strict=True):
            if len(starts):
                partly[name] = starts
    out_doc, out_first, out_last = [], [], []
    for key, doc, at, piece in zip(keys.tolist(), docs.tolist(), first.tolist(), pieces, strict=True):
        if doc > least[key, piece]:
            out_doc.append(doc)
            out_first.append(at)
            out_last.append(at + len(piece) - LENGTH)
        elif (key, piece) in partly:
            starts = partly[key, piece]
            cut = np.flatnonzero(np.diff(starts) > 1)
            for a, b in zip(starts[np.concatenate([[0], cut + 1])].tolist(), starts[np.concatenate([cut, [len(starts) - 1]])].tolist(), strict=True):
                out_doc.append(doc)
                out_first.append(at + a)
                out_last.append(at + b)
    return pa.table({"doc": pa.array(out_doc, pa.int64()), "first": pa.array(out_first, pa.int64()), "last": pa.array(out_last, pa.int64())})


def _slices(sizes: list[int], keys: list[int], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of about ``most`` bytes that keep the fragments of an anchor together."""
    start = total = 0
    for k in range(len(sizes)):
        if total > most and keys[k] != keys[k - 1]:
            yield start, k
            start, total = k, 0
        total += sizes[k]
    if sizes:
        yield start, len(sizes)


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, digest and text as bytes that take less room in a shuffle than its own compression gives."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [press.compress(t.encode("utf-8", "surrogatepass")) for t in text_of(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["doc", "digest", "packed"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for packed, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            data, kept, at, removed, n = zstandard.decompress(packed), [], 0, 0, 0
            for begin, end in _merged(sorted((s >> 32, (s & 0xFFFFFFFF) + LENGTH) for s in spans)):
                kept.append(data[at:begin])
                at, removed, n = end, removed + end - begin, n + 1
            kept.append(data[at:])
            rows.append((removed, n, hashlib.sha256(b"".join(kept)).hexdigest()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                          pa.array([r[2] for r in rows], pa.string())], names=["doc", "digest", "n_removed", "n_spans", "kept_sha256"])


def _merged(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    begin = end = None
    for s, e in spans:
        if end is None or s > end:
            if end is not None:
                yield begin, end
            begin, end = s, e
        else:
            end = max(end, e)
    if end is not None:
        yield begin, end


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """(doc, first, last): ranges of starts in the texts that went out, ``doc`` with the largest number for a null id.

    ``buckets``: hash ranges of anchors, a power of two between 256 and 16,384; by default about eight per input partition.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    buckets = min(16_384, max(256, 1 << ((buckets or 8 * docs.rdd.getNumPartitions()) - 1).bit_length()))
    packed = docs.transform(arrow_map, _packed(buckets, None), "bucket int, keys binary").where("length(keys) > 0")
    meeting = bit_table(packed.groupBy("bucket").applyInArrow(lambda t: _meeting(t, buckets), "slot long"), "slot")
    pieces = docs.transform(arrow_map, _packed(buckets, meeting), "bucket int, keys binary, doc binary, first binary, size binary, data binary")
    return pieces.groupBy("bucket").applyInArrow(lambda t: _late(t, buckets), "doc long, first long, last long")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = stored(own.select("doc_id", "doc", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")))
    first = known.groupBy("digest").agg(F.min("doc").alias("least"))
    # a text has fewer than 2^31 bytes: a range is one number
    spans = repeated_spans(docs, doc_id, text, buckets).groupBy("doc").agg(F.collect_list(F.expr("shiftleft(first, 32) + last")).alias("spans"))
    spans = stored(spans.withColumn("key", F.xxhash64("doc")))
    partly = own.where(hit(bit_table(spans, "key"), F.xxhash64("doc"))).select("doc", F.sha2("text", 256).alias("digest"), "text").transform(arrow_map, _compressed, "doc long, digest string, packed binary")
    cut = partly.join(spans.select("doc", "spans"), "doc").transform(arrow_map, _cut, "doc long, digest string, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["doc", "digest"])
    rows = known.join(first, "digest").join(cut, ["doc", "digest"], "left")
    whole = (F.col("doc") > F.col("least")) & (F.col("n_bytes") >= LENGTH)
    pick = lambda copied, name, kept: F.when(whole, copied).otherwise(F.coalesce(name, kept)).alias(name)
    return rows.select("doc_id", "n_bytes", pick(F.col("n_bytes"), "n_removed", F.lit(0).cast("long")), pick(F.lit(1).cast("long"), "n_spans", F.lit(0).cast("long")),
                       pick(F.lit(EMPTY), "kept_sha256", F.col("digest")))
