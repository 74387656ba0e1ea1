"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is bound from its letters, each vector rotated by the
letter's place and multiplied; a text is the bundle (sum) of its trigrams; a language is the bundle of its
training texts. A document gets the language whose prototype has the highest cosine with its own vector.

Prototypes are summed in Spark as whole numbers; what reaches the driver is languages x dimensions numbers.

Defined results: null text, empty text and texts without a letter are ``und`` with score 0, as is everything when
there is nothing to learn from; equal cosines go to the alphabetically first language; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from fieldlens.llm.base import arrow_map, id_part, text_of

DIMS = 1024
SEED = 20_011
GRAMS = 4096  # trigrams bound at a time
MAX_LANGUAGES = 2_000
UNKNOWN = "und"

_space = np.uint64(32)
_letters: np.ndarray | None = None
_known: dict[int, int] = {}
_vectors = np.zeros((0, DIMS), np.int8)


def _letter_table() -> np.ndarray:
    """Code point -> itself for letters, blank for all others."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((c if chr(c).isalpha() else 32 for c in range(0x110000)), np.uint32, 0x110000)
    return _letters


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of letters and single blanks between words, packed in 63 bits, and their counts."""
    points = _letter_table()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    points = np.concatenate([[32], points, [32]]).astype(np.uint64)
    points = points[~((points == _space) & (np.append(_space * 0, points[:-1]) == _space))]
    if len(points) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.unique((points[:-2] << np.uint64(42)) | (points[1:-1] << np.uint64(21)) | points[2:], return_counts=True)


def bound(grams: np.ndarray) -> np.ndarray:
    """Vectors of trigrams: rotate by place, multiply."""
    global _vectors
    parts = [((grams >> np.uint64(s)) & np.uint64(0x1FFFFF)).astype(np.int64) for s in (42, 21, 0)]
    new = [c for c in np.unique(np.concatenate(parts)).tolist() if c not in _known]
    if new:
        if len(_known) > 100_000:
            _known.clear()
            _vectors, new = _vectors[:0], np.unique(np.concatenate(parts)).tolist()
        _known.update({c: len(_known) + k for k, c in enumerate(new)})
        made = [np.random.Generator(np.random.PCG64([SEED, c])).integers(0, 2, DIMS, np.int8) * 2 - 1 for c in new]
        _vectors = np.concatenate([_vectors, np.array(made, np.int8)])
    first, second, third = (_vectors[[_known[c] for c in p.tolist()]] for p in parts)
    return (np.roll(first, 2, 1) * np.roll(second, 1, 1) * third).astype(np.float32)


def bundles(texts: list[str], groups: list[int], n: int) -> np.ndarray:
    """Sums of trigram vectors, one row per group."""
    found = [trigrams(t) for t in texts]
    keys = np.concatenate([np.zeros(0, np.uint64), *(g for g, _ in found)])
    counts = np.concatenate([np.zeros(0, np.int64), *(c for _, c in found)])
    rows = np.repeat(np.array(groups, np.int64), [len(g) for g, _ in found])
    grams, at = np.unique(keys, return_inverse=True)
    order = np.argsort(at, kind="stable")
    at, rows, counts = at[order], rows[order], counts[order]
    out = np.zeros((n, DIMS))
    for start in range(0, len(grams), GRAMS):
        lo, hi = np.searchsorted(at, [start, start + GRAMS])
        width = min(GRAMS, len(grams) - start)
        part = np.bincount(rows[lo:hi] * width + at[lo:hi] - start, counts[lo:hi], n * width).reshape(n, width).astype(np.float32)
        out += part @ bound(grams[start:start + GRAMS])
    return out


def _slices(batch: pa.RecordBatch, most: int = 400_000, rows: int = 256) -> Iterator[tuple[int, list[str]]]:
    texts, start, size = text_of(batch.column("text")), 0, 0
    for k, t in enumerate(texts):
        if k > start and (size + len(t) > most or k - start >= rows):
            yield start, texts[start:k]
            start, size = k, 0
        size += len(t)
    if texts:
        yield start, texts[start:]


def train(docs: DataFrame, text: str, lang: str) -> dict[str, np.ndarray]:
    """Prototype of every non-null language of ``docs``."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for start, texts in _slices(batch):
                names = sorted(set(own := langs[start:start + len(texts)]))
                made = bundles(texts, [names.index(x) for x in own], len(names))
                for k, name in enumerate(names):
                    total[name] = total.get(name, 0) + made[k]
        for name, vector in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * DIMS), pa.array(np.arange(DIMS, dtype=np.int32)), pa.array(np.rint(vector).astype(np.int64))], names=["lang", "dim", "v"])

    part = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    rows = part.transform(arrow_map, sums, "lang string, dim int, v long").groupBy("lang", "dim").agg(F.sum("v").alias("v"))
    rows = rows.limit(MAX_LANGUAGES * DIMS + 1).collect()
    if len(rows) > MAX_LANGUAGES * DIMS:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r["lang"], np.zeros(DIMS))[r["dim"]] = r["v"]
    return {k: v for k, v in sorted(out.items()) if v.any()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (cosine, cut to 0 to 1). A map; the prototypes travel with the task."""
    names = list(prototypes)
    unit = np.array([v / np.linalg.norm(v) for v in prototypes.values()]).reshape(len(names), DIMS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = [UNKNOWN] * len(batch), np.zeros(len(batch))
            for start, texts in _slices(batch.select([text]).rename_columns(["text"])) if names else ():
                made = bundles(texts, list(range(len(texts))), len(texts))
                size = np.linalg.norm(made, axis=1)
                cos = (made @ unit.T) / np.maximum(size, 1e-9)[:, None]
                for k in np.flatnonzero(size > 0).tolist():
                    best = int(np.argmax(cos[k]))
                    pred[start + k], score[start + k] = names[best], min(1.0, max(0.0, float(cos[k, best])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    kept = docs.drop("lang_pred", "score")
    return kept.transform(arrow_map, rows, StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def identify(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, lang_pred, score of every document; learns from the rows where ``learn`` holds."""
    prototypes = train(docs.where(learn), text, lang)
    return predict(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), prototypes).drop("text")


def held_out(doc_id: str = "doc_id") -> Column:
    return id_part(doc_id, 3) == 1
