"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its character n-grams (3 to 5, word ends marked), hashed into a table of
fixed size; a text is the mean of its words; a softmax layer on top gives the label. Embeddings and
softmax are trained together. A misspelling that was never seen shares most n-grams with its word, and its vector.

The model is fitted on a bounded sample of labelled rows (``per_class`` of each label, by the hash of the id; rows of
more than ``most_chars`` characters are not in the sample). Scoring reads whole texts and is a map: because all means
are linear, a bucket contributes one number.

Defined results: null and empty texts have no words and get the score of the bias alone; without two labels to learn
from every score is 0; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fieldlens.llm.base import arrow_map, id_part, text_of

BUCKETS = 1 << 17
DIMS = 8
GAIN = 24.0  # times the mean, so that a few words in a hundred can decide
THRESHOLD = 0.3
SIZES = (3, 4, 5)
#: blanks and punctuation part words
_PARTS = {c: " " for c in [*range(0, 33), *map(ord, ".,;:!?\"'()[]{}|")]}
_PRIME = np.uint32(0x9E3779B1)


def grams(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(bucket, weight) of every character n-gram inside a word, words marked at both ends, and the number of words.

    A word shares a weight of 1 among its n-grams, so the weighted sum of bucket values is the sum of word means.
    """
    words = text.lower().translate(_PARTS).split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), 0
    points = np.frombuffer(f"\x01{'\x02\x01'.join(words)}\x02".encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.cumsum(points == 1).astype(np.int32) - 1
    rolled, buckets, owners = points * _PRIME, [], []
    for n in range(2, SIZES[-1] + 1):
        rolled = (rolled[:-1] ^ (rolled[:-1] >> np.uint32(15))) * _PRIME + points[n - 1:]
        if n in SIZES:
            inside = word[: len(rolled)] == word[n - 1:]
            hashed = rolled[inside]
            buckets.append((hashed ^ (hashed >> np.uint32(15))) * _PRIME >> np.uint32(32 - 17))
            owners.append(word[: len(rolled)][inside])
    bucket, owner = np.concatenate(buckets), np.concatenate(owners)
    return bucket, (1.0 / np.maximum(np.bincount(owner, minlength=len(words)), 1))[owner].astype(np.float32), len(words)


class Model:
    """Embeddings (buckets x dims), softmax weights (dims x 2) and bias."""

    def __init__(self, emb: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> None:
        #: what a bucket adds to the difference of the two logits
        self.lift = (emb @ (weights[:, 1] - weights[:, 0])).astype(np.float32)
        self.bias = float(bias[1] - bias[0])

    def score(self, text: str) -> float:
        bucket, weight, n = grams(text)
        logit = self.bias + GAIN * float(self.lift[bucket] @ weight) / max(1, n)
        return float(1.0 / (1.0 + np.exp(-np.clip(logit, -60, 60))))


def fit(texts: list[str], labels: list[int], epochs: int = 7, batch: int = 64, rate: float = 0.15, seed: int = 7) -> Model:
    """Adagrad on the cross entropy of the sampled rows."""
    ids, shares = [], []
    for t in texts:
        bucket, weight, n = grams(t)
        own, at = np.unique(bucket.astype(np.int64), return_inverse=True)
        ids.append(own)
        shares.append((np.bincount(at, weight, len(own)) * (GAIN / max(1, n))).astype(np.float32))
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1 / DIMS, (BUCKETS, DIMS)).astype(np.float32)
    weights, bias = rng.normal(0, 0.5, (DIMS, 2)).astype(np.float32), np.zeros(2, np.float32)
    sums = [np.full(x.shape, 1e-6, np.float32) for x in (emb, weights, bias)]
    y = np.array(labels)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for start in range(0, len(order), batch):
            rows = order[start:start + batch]
            flat, share = np.concatenate([ids[r] for r in rows]), np.concatenate([shares[r] for r in rows])
            at = np.repeat(np.arange(len(rows)), [len(ids[r]) for r in rows])
            lifted = emb[flat] * share[:, None]
            text = np.stack([np.bincount(at, lifted[:, d], len(rows)) for d in range(DIMS)], 1).astype(np.float32)
            logits = text @ weights + bias
            g = np.exp(logits - logits.max(1, keepdims=True))
            g /= g.sum(1, keepdims=True)
            g[np.arange(len(rows)), y[rows]] -= 1
            g /= len(rows)
            g_text = g @ weights.T
            used, inv = np.unique(flat, return_inverse=True)
            g_emb = np.stack([np.bincount(inv, g_text[at, d] * share, len(used)) for d in range(DIMS)], 1).astype(np.float32)
            sums[0][used] += g_emb ** 2
            emb[used] -= rate * g_emb / np.sqrt(sums[0][used])
            for param, grad, s in ((weights, text.T @ g, sums[1]), (bias, g.sum(0), sums[2])):
                s += grad ** 2
                param -= rate * grad / np.sqrt(s)
    return Model(emb, weights, bias)


def sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, per_class: int, most_chars: int) -> tuple[list[str], list[int]]:
    """At most ``per_class`` texts of each label: ids are chosen from the labels alone, then their texts are fetched."""
    rows = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__y")).where("__id is not null and __y in (0, 1)")
    chosen = [rows.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(per_class).collect() for y in (0, 1)]
    chosen = [(r["__id"], r["__y"]) for rs in chosen for r in rs]
    if not chosen:
        return [], []
    picked = docs.sparkSession.createDataFrame(chosen, rows.schema)
    found = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__t")).where(F.length("__t") <= most_chars).join(F.broadcast(picked), "__id")
    got = sorted(((r["__id"], r["__y"], r["__t"]) for r in found.limit(4 * per_class).toLocalIterator()), key=lambda r: (r[0], r[1], r[2]))
    return [t for _, _, t in got], [y for _, y, _ in got]


def score_texts(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score of every row."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.score if model else lambda _: 0.0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([score(t) for t in text_of(batch.column(1))], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).transform(arrow_map, rows, f"doc_id {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
             per_class: int = 2500, most_chars: int = 20_000) -> DataFrame:
    """doc_id, score of every document; labels are learnt only from rows where ``learn`` (on the id) holds."""
    texts, y = sample(docs, labels.where(learn), doc_id, text, label, per_class, most_chars)
    return score_texts(docs, fit(texts, y) if len(set(y)) == 2 else None, doc_id, text)


def held_out(doc_id: str = "doc_id") -> Column:
    return id_part(doc_id, 4) == 2
