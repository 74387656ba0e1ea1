"""Helpers of the operators: stored tables, fixed-size bit tables, word hashes, links to components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldlens.session import checkpoint

WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
BIT_LOG = 26  # size of a bit table: 2^26 bits, 8 MB, whatever the input
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
CACHE = 150_000  # entries of a task's word cache before it starts anew


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the folder in spark.checkpoint.dir; later readers start from there."""
    return checkpoint(df)


def id_part(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text modulo ``parts``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % parts).cast("int")


def text_of(col: pa.ChunkedArray | pa.Array) -> list[str]:
    return ["" if t is None else t for t in col.to_pylist()]


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8: ``bytes.split()`` parts at just these six characters."""
    return text.encode("utf-8", "surrogatepass").split()


class WordHash(dict):
    """64-bit hashes of words, remembered up to ``CACHE`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash per run of ``width`` word hashes; a shorter, non-empty text is one run."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    n = len(hashes) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out += hashes[k:k + n] * _ODD[k]
    return mix(out)


_ODD = mix(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


# ---- bit tables: a bounded stand-in for "the keys that matter"; false hits cost time, never rows


def bit_table(df: DataFrame, key: str) -> np.ndarray:
    """Bit table of the 64-bit ``key`` values: its size is fixed, so it may be sent to every executor.

    Bits are gathered in Spark into words of 64; at most 2^20 of them (16 MB) reach the driver.
    """
    slots = df.select(F.shiftrightunsigned(F.col(key), 64 - BIT_LOG).alias("slot")).where("slot is not null").distinct()
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    out = np.zeros(1 << (BIT_LOG - 6), np.int64)
    for batch in _arrow(words):
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out


def _arrow(df: DataFrame) -> list[pa.RecordBatch]:
    """Rows on the driver as Arrow; only for tables whose size does not depend on the input."""
    return df.toArrow().to_batches()


def hit(bits: np.ndarray, key: Column) -> Column:
    """Does the 64-bit ``key`` fall on a set bit?"""

    @F.pandas_udf("boolean")
    def test(keys: pd.Series) -> pd.Series:
        return pd.Series(in_bits(bits, keys.to_numpy(np.int64)))

    return test(key)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that no column of ``df`` has, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(df: DataFrame, bad: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose non-null 64-bit ``key`` is not in ``bad``: only rows that fall on a set bit are shuffled."""
    bits = bit_table(bad, key)
    mark = free_name(df, "hit")
    marked = df.withColumn(mark, hit(bits, F.col(key)))
    return marked.where(~F.col(mark)).unionByName(marked.where(F.col(mark)).join(bad.select(key).distinct(), key, "left_anti")).drop(mark)


def in_bits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys.astype(np.uint64) >> np.uint64(64 - BIT_LOG)
    word = bits[(slot >> np.uint64(6)).astype(np.int64)].view(np.uint64)
    return (word >> (slot & np.uint64(63))) & np.uint64(1) == 1


def signed(keys: np.ndarray) -> np.ndarray:
    return keys.astype(np.uint64, copy=False).view(np.int64)


# ---- components of a link table


def components(links: DataFrame, left: str, right: str, rounds: int = 50) -> DataFrame:
    """(node, root): the smallest node reachable from every linked node.

    Alternating large and small stars: every step is one grouped minimum and one join, its rows stay
    below twice the links, and the number of steps grows with the logarithm of the longest chain.
    """
    edges = stored(links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct())
    for _ in range(rounds):
        # large star: every larger neighbour moves to the smallest neighbour of the node
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the smaller neighbours and the node itself move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        new = stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        same = new.join(edges, ["u", "v"], "left_anti").limit(1).count() == 0 and new.count() == edges.count()
        edges = new
        if same:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"links did not settle in {rounds} rounds")


def arrow_map(df: DataFrame, rows, schema) -> DataFrame:
    """``df.mapInArrow`` for functions that hold texts: they get small batches, and idle workers give memory back.

    Spark's default of 10,000 rows a batch is lowered for the session, a setting of the user's own stays.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH, "10000") == "10000":
        conf.set(BATCH, "1000")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(batch.slice(k, 1000) for batch in batches for k in range(0, len(batch), 1000))
        _release()

    return df.mapInArrow(run, schema)


def _release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass
