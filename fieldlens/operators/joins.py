"""Joins against dimensions: broadcast after a check of its size, otherwise shuffled with the measured hot keys spread."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

DIM_ROWS = 50_000
DIM_BYTES = 32 << 20
SALTS = 32
HOT_ROWS = 1_000_000  # rows of a key that one task may well join
HOT_KEYS, TRACKED = 256, 10_000  # keys reported by the sketch and kept by it


def is_small(df: DataFrame, max_rows: int = DIM_ROWS) -> bool:
    """True when ``df`` holds at most ``max_rows`` rows; reads no more than that many."""
    return df.limit(max_rows + 1).count() <= max_rows


def fits_broadcast(df: DataFrame, max_rows: int = DIM_ROWS, max_bytes: int = DIM_BYTES) -> bool:
    """True when ``df`` is small in rows and, written as text, in bytes."""
    plain = [F.col(f"`{f.name}`").cast("string") if "variant" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema]
    text = F.to_json(F.struct(*[c.alias(f"c{k}") for k, c in enumerate(plain)])) if plain else F.lit("")
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(F.octet_length(text))).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def hot_keys(df: DataFrame, on: Sequence[str], hot_rows: int = HOT_ROWS) -> list[int]:
    """Hashes of the keys with more than ``hot_rows`` rows, by a mergeable heavy-hitters sketch: one row, at most ``HOT_KEYS`` entries.

    The sketch may overstate a count, which spreads a key in vain, and misses no key with more than about a hundredth of a hundredth of all rows.
    """
    top = df.select(F.xxhash64(*on).alias("h")).agg(F.expr(f"approx_top_k(h, {HOT_KEYS}, {TRACKED})").alias("top")).first()["top"]
    return sorted(r["item"] for r in top or () if r["item"] is not None and r["count"] > hot_rows)


def dim_join(facts: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "left",
             max_rows: int = DIM_ROWS, salts: int = SALTS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join facts with a dimension whose keys may be hot on the fact side.

    A dimension of checked size is broadcast. For a larger one the hot keys of the facts are measured: their facts are dealt over
    ``salts`` places and only their rows of the dimension are repeated; all other rows meet by key alone. ``how`` is inner,
    left, left_semi or left_anti.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"dim_join cannot keep the dimension side of a {how} join")
    on = list(on)
    if fits_broadcast(dim, max_rows):
        return facts.join(F.broadcast(dim), on, how)
    hot = hot_keys(facts, on, hot_rows)
    if not hot:
        return facts.join(dim, on, how)
    is_hot = F.xxhash64(*on).isin(hot)
    # maps and variants cannot be hashed; the other columns tell rows apart
    hashable = [f.name for f in facts.schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    dealt = facts.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(F.lit(7), *hashable), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    repeated = dim.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(repeated.hint("merge"), [*on, "__salt"], how).drop("__salt")
