"""Cross-tokenizer alignment: which tokens of vocabulary B cover the bytes of a token of vocabulary A.

A is a byte-level BPE (JSON file), B a SentencePiece BPE with byte fallback. A encodes space+text, B the text, to which it adds the
space itself; special tokens' strings are plain text. Byte offsets where tokens of both end cut a document into groups. Tokens whose byte ranges
overlap are linked, and a pair of ids counts the documents that hold it linked.

Identity map: for every A id the B id of the same bytes. A link is regular if it joins an A id with this B id, as all of a group of one
token each do whose B id is the plain one; regular links are counted in vectors as long as the vocabulary, which fit anywhere. Only the pairs of the other
links are shuffled: distinct pairs of a chunk of documents (about 16 MB of text) with their number of documents, not pairs of documents.

Steps: (1) a map tokenizes every document once and stores one row a chunk, links packed; (2) regular links are summed by A id, irregular pairs by
(A id, B id); (3) the counts of a chunk's own pairs return to the chunk by a join on its number, and every document's links are looked up there.
Sent to the tasks: two vectors of A's vocabulary length. A pair that every chunk holds is one row a chunk on either side.

Words: no B piece continues past a blank that follows a visible character, and A's pattern ends there too (the first is checked
when the model is read, otherwise texts stay whole), so a text is cut there, and a piece of text that occurs again within a task is taken from a table of
bounded size. A's merges are taken from its JSON file and applied by rank, which is the same order.

Defined cases: null and empty texts, and texts whose joined A or B bytes differ from space+text, have no tokens (zeros and '' as digest); a null
id stays; repeated rows count as documents each; very long texts are cut between words only, so one word may be as long as it likes;
an A id without a B id of the same bytes has only irregular links; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from fieldlens.llm.base import arrow_map, stored

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Fixed value: how a byte-level BPE of this kind cuts a text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CUT = re.compile(r"(?<=\S)(?=[ \n])")  # \S here is visible under every definition of white space
CHUNK = 16_000_000  # characters of a chunk
STEP = 1_000_000  # characters worked on at once
KNOWN, KNOWN_CHARS = 150_000, 4_000_000  # words, and their characters, that a task remembers before it starts anew
SPACE = "▁"
COLUMNS = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _bytes_of_letters() -> dict[str, int]:
    """The printable stand-ins of a byte-level vocabulary: visible Latin-1 letters stand for themselves, the rest follows from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabularies:
    """Both tokenizers, the bytes of every id and the identity map; one a process."""

    _open: dict[tuple[str, str], Vocabularies] = {}

    @classmethod
    def get(cls, a_path: str, b_path: str) -> Vocabularies:
        if (a_path, b_path) not in cls._open:
            cls._open[a_path, b_path] = cls(a_path, b_path)
        return cls._open[a_path, b_path]

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)
        letters = _bytes_of_letters()
        special = {t["id"] for t in model["added_tokens"] if t["special"]}
        vocabulary = {i: bytes(letters[c] for c in t) for t, i in model["model"]["vocab"].items() if i not in special}
        merged = [model["model"]["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{a_path}: ids do not follow the order of merges")
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={b: i for i, b in vocabulary.items()}, special_tokens={})
        self.a_bytes = [vocabulary.get(i, b"") for i in range(max(vocabulary) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        if len(self.a_bytes) > 1 << 16 or len(self.b_bytes) > 1 << 16:
            raise ValueError("ids beyond 16 bits")
        self.blank = pieces.index(SPACE)
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in pieces)
        self.a_len, self.b_len = (np.array([len(t) for t in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        plain: dict[bytes, int] = {}
        for i, token in enumerate(self.b_bytes):
            if not self.b.is_control(i) and not self.b.is_unknown(i) and (token not in plain or self.b.is_byte(plain[token])):
                plain[token] = i
        self.same = np.array([plain.get(t, -1) if t else -1 for t in self.a_bytes], np.int64)

    def encode(self, words: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of either side; each word but those after a line break begins with the blank that B adds."""
        a = [self.a.encode_ordinary(w) for w in words]
        b = self.b.encode([w[1:] if w[:1] == " " else w for w in words], num_threads=1)
        # nothing is added to an empty text, and what is added before a line break is taken away again
        return a, [[self.blank] if w == " " else ids[1:] if w[:1] != " " and ids[:1] == [self.blank] else ids for w, ids in zip(words, b)]


class Words:
    """Pieces of text met so far: tokens, groups and links of each."""

    def __init__(self, v: Vocabularies):
        self.v = v
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str] = []
        self.facts = np.zeros((0, 5), np.int64)  # valid, n_a, n_b, n_groups, n_links
        self.starts = np.zeros(1, np.int64)
        self.pairs = np.zeros(0, np.int64)

    def learn(self, words: list[str]) -> None:
        if not words:
            return
        if len(self.number) > KNOWN or self.chars > KNOWN_CHARS:
            raise OverflowError
        v = self.v
        a, b = v.encode(words)
        good = np.array([
            b"".join(map(v.a_bytes.__getitem__, x)) == (t := w.encode()) and b"".join(map(v.b_bytes.__getitem__, y)) == t for w, x, y in zip(words, a, b)], bool)
        a, b = ([ids if ok else [] for ids, ok in zip(side, good)] for side in (a, b))
        n_a, n_b = (np.array([len(ids) for ids in side], np.int64) for side in (a, b))
        a_all, b_all = (np.fromiter(chain.from_iterable(side), np.int64, int(n.sum())) for side, n in ((a, n_a), (b, n_b)))
        a_end, b_end = v.a_len[a_all].cumsum(), v.b_len[b_all].cumsum()
        # every stretch between neighbouring ends lies in one token of each side: one link
        ends = np.union1d(a_end, b_end)
        left, right = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
        link_a, link_b = (side[at] if len(ends) else np.zeros(0, np.int64) for side, at in ((a_all, left), (b_all, right)))
        common = (a_end[left] == b_end[right]) if len(ends) else np.zeros(0, bool)
        word = np.repeat(np.arange(len(words)), n_a)[left] if len(ends) else np.zeros(0, np.int64)
        n_links, n_groups = np.bincount(word, minlength=len(words)), np.bincount(word, common, len(words)).astype(np.int64)
        facts = np.column_stack([good, n_a, n_b, n_groups, n_links]).astype(np.int64)
        self.groups += _written(a_all.tolist(), b_all.tolist(), left[common].tolist(), right[common].tolist(), n_groups.tolist())
        self.number.update(zip(words, range(len(self.facts), len(self.facts) + len(words))))
        self.chars += sum(map(len, words))
        self.facts = np.concatenate([self.facts, facts])
        self.starts = np.concatenate([self.starts, self.starts[-1] + n_links.cumsum()])
        self.pairs = np.concatenate([self.pairs, link_a << 16 | link_b])


def _written(a: list[int], b: list[int], a_last: list[int], b_last: list[int], n_groups: list[int]) -> list[str]:
    """Groups of every word as text; the last tokens of all groups are given."""
    groups, i, j = [], 0, 0
    for p, q in zip(a_last, b_last):
        groups.append(f"{a[p]}|{b[q]}" if i == p and j == q else f"{','.join(map(str, a[i:p + 1]))}|{','.join(map(str, b[j:q + 1]))}")
        i, j = p + 1, q + 1
    out, at = [], 0
    for n in n_groups:
        out.append(";".join(groups[at:at + n]))
        at += n
    return out


# ---- chunks of documents, packed


def _pack(values: np.ndarray) -> bytes:
    """A 32-bit array by planes of bytes, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class Chunk:
    """Documents of a task until they make a row."""

    NAMES = ["chunk", "ids", "n_a", "n_b", "n_groups", "n_links", "digests", "sizes", "pairs", "times"]

    def __init__(self) -> None:
        self.chars = 0
        self.ids: list = []
        self.facts: list[np.ndarray] = []
        self.digests: list[str] = []
        self.links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # distinct pairs a document, the pairs, how often each

    def row(self, number: int, kind: pa.DataType) -> pa.RecordBatch:
        facts = np.concatenate(self.facts)
        sizes, pairs, times = (np.concatenate(part) for part in zip(*self.links))
        columns = [pa.array([number], pa.int64()), pa.array([self.ids], pa.list_(kind)), *(pa.array([facts[:, k]], pa.list_(pa.int64())) for k in range(4)),
                   pa.array([self.digests], pa.list_(pa.string())), *(pa.array([_pack(x)], pa.binary()) for x in (sizes, pairs, times))]
        return pa.RecordBatch.from_arrays(columns, self.NAMES)


def _add(chunk: Chunk, words: Words, ids: list, texts: list[str]) -> None:
    v = words.v
    cut = [CUT.split(" " + t) if v.cuts else [" " + t] for t in texts]
    count = np.array([len(c) if t else 0 for c, t in zip(cut, texts)], np.int64)
    flat = list(chain.from_iterable(c for c, t in zip(cut, texts) if t))
    for _ in (0, 1):
        new = [w for w in dict.fromkeys(flat) if w not in words.number]
        try:
            words.learn(new)
            break
        except OverflowError:
            words.forget()
    at = np.fromiter(map(words.number.__getitem__, flat), np.int64, len(flat))
    doc = np.repeat(np.arange(len(texts)), count)
    whole = (count > 0) & (np.bincount(doc, 1 - words.facts[at, 0], len(texts)) == 0)
    facts = np.column_stack([np.bincount(doc, words.facts[at, k], len(texts)) for k in range(1, 5)]).astype(np.int64) * whole[:, None]
    start = np.concatenate([[0], count.cumsum()])
    for k, ok in enumerate(whole):
        chunk.digests.append(hashlib.sha256(";".join([words.groups[w] for w in at[start[k]:start[k + 1]]]).encode()).hexdigest() if ok else "")
    # words of a document, each with its pairs
    once, times = np.unique((doc << 32 | at)[whole[doc]], return_counts=True)
    doc, at = once >> 32, once & 0xFFFFFFFF
    n = words.starts[at + 1] - words.starts[at]
    place = np.repeat(words.starts[at] - (n.cumsum() - n), n) + np.arange(int(n.sum()))
    key, weight = np.repeat(doc, n) << 32 | words.pairs[place], np.repeat(times, n)
    order = np.argsort(key)
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    chunk.links.append((np.bincount(key[first] >> 32, minlength=len(texts)), key[first] & 0xFFFFFFFF, np.add.reduceat(weight, first) if len(first) else first))
    chunk.facts.append(facts)
    chunk.ids += ids
    chunk.chars += sum(map(len, texts))


def chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = FOLDER, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """Tokenized and linked documents, one stored row a chunk."""
    a_path, b_path = f"{folder}/{a_file}", f"{folder}/{b_file}"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, chunk, number = Words(Vocabularies.get(a_path, b_path)), Chunk(), TaskContext.get().partitionId() << 32
        for batch in batches:
            kind = batch.schema.field(0).type
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            size = np.fromiter(map(len, texts), np.int64, len(texts)).cumsum() // STEP
            for part in np.unique(size):
                lo, hi = np.searchsorted(size, [part, part + 1])
                _add(chunk, words, ids[lo:hi], texts[lo:hi])
                if chunk.chars >= CHUNK:
                    yield chunk.row(number, kind)
                    chunk, number = Chunk(), number + 1
        if chunk.ids:
            yield chunk.row(number, kind)

    kind = docs.schema[doc_id].dataType.simpleString()
    longs = ", ".join(f"{c} array<bigint>" for c in ("n_a", "n_b", "n_groups", "n_links"))
    return stored(arrow_map(docs.select(doc_id, text), rows, f"chunk long, ids array<{kind}>, {longs}, digests array<string>, sizes binary, pairs binary, times binary"))


def _counted(packed: DataFrame, same: np.ndarray, regular: bool) -> DataFrame:
    """(chunk, pair, docs): distinct pairs of every chunk with the number of its documents that hold them."""

    def rows(batches):
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pairs = _unpack(data)  # distinct within a document
                pairs, docs = np.unique(pairs[(same[pairs >> 16] == (pairs & 0xFFFF)) == regular], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), chunk)), pa.array(pairs), pa.array(docs)], ["chunk", "pair", "docs"])

    return arrow_map(packed.select("chunk", "pairs"), rows, "chunk long, pair long, docs long")


class Counts:
    """Documents of every linked pair: regular ones in a vector, the others in a table; and the highest of every A id."""

    def __init__(self, packed: DataFrame, v: Vocabularies):
        self.here = _counted(packed, v.same, False)
        self.irregular = stored(self.here.groupBy("pair").agg(F.sum("docs").alias("docs")))
        self.regular = _vector(_counted(packed, v.same, True).groupBy(F.shiftright("pair", 16).alias("a")).agg(F.sum("docs").alias("docs")), len(v.a_bytes))
        self.highest = np.maximum(self.regular, _vector(self.irregular.groupBy(F.shiftright("pair", 16).alias("a")).agg(F.max("docs").alias("docs")), len(v.a_bytes)))


def _vector(rows: DataFrame, size: int) -> np.ndarray:
    """One number an A id: at most the vocabulary's length."""
    out = np.zeros(size, np.int64)
    found = rows.toArrow()
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def pair_counts(docs: DataFrame, folder: str = FOLDER, a_file: str = A_FILE, b_file: str = B_FILE, **names: str) -> DataFrame:
    """(a_id, b_id, docs, best): every linked pair of ids, how many documents hold it, whether no pair of its A id has more."""
    v = Vocabularies.get(f"{folder}/{a_file}", f"{folder}/{b_file}")
    found = Counts(chunks(docs, folder=folder, a_file=a_file, b_file=b_file, **names), v)
    spark = docs.sparkSession
    regular = spark.createDataFrame(pa.table({"a": np.arange(len(v.same)), "b": v.same, "docs": found.regular})).where("docs > 0")
    highest = spark.createDataFrame(pa.table({"a": np.arange(len(v.same)), "most": found.highest}))
    pairs = regular.unionByName(found.irregular.select(F.shiftright("pair", 16).alias("a"), F.col("pair").bitwiseAND(0xFFFF).alias("b"), "docs"))
    return pairs.join(F.broadcast(highest), "a").select(  # a row an A id
        F.col("a").cast("int").alias("a_id"), F.col("b").cast("int").alias("b_id"), "docs", (F.col("docs") == F.col("most")).alias("best"))


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = FOLDER, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """Per document ``doc_id``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    v = Vocabularies.get(f"{folder}/{a_file}", f"{folder}/{b_file}")
    packed = chunks(docs, doc_id, text, folder, a_file, b_file)
    counts = Counts(packed, v)
    same, regular, highest = v.same, counts.regular, counts.highest
    names = [doc_id, *(c.split()[0] for c in COLUMNS.split(", "))]

    def rows(chunk: pa.Table, known: pa.Table) -> pa.Table:
        pair, docs_of = (known.column(c).to_numpy() for c in ("pair", "docs"))
        order = np.argsort(pair)
        pair, docs_of = pair[order], docs_of[order]
        out = []
        for r in chunk.to_batches():
            for k in range(len(r)):
                sizes, pairs, times = (_unpack(r.column(c)[k].as_py()) for c in ("sizes", "pairs", "times"))
                a = pairs >> 16
                plain = same[a] == (pairs & 0xFFFF)
                count = np.where(plain, regular[a], 0)
                count[~plain] = docs_of[np.searchsorted(pair, pairs[~plain])]
                doc = np.repeat(np.arange(len(sizes)), sizes)
                best, total = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
                np.add.at(best, doc, times * (count == highest[a]))
                np.add.at(total, doc, times * count)
                lists = [r.column(c)[k].values for c in ("ids", "n_a", "n_b", "n_groups", "n_links")]
                out.append(pa.table([*lists, pa.array(best), pa.array(total), r.column("digests")[k].values], names=names))
        return pa.concat_tables(out)

    # a group is one row of a chunk and the counts of its own pairs
    looked = counts.here.select("chunk", "pair").join(counts.irregular, "pair")
    kind = docs.schema[doc_id].dataType.simpleString()
    return packed.groupBy("chunk").cogroup(looked.groupBy("chunk")).applyInArrow(rows, f"`{doc_id}` {kind}, {COLUMNS}")
