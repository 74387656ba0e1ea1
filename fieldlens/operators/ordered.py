"""Order-dependent columns over groups that may be far larger than one task.

A plain window sorts each group inside a single task, so one hot tag or one long event log becomes the bottleneck. Here a group of more than
``width`` rows is cut into ranges of its order column that hold about equally many rows, whatever values the column has: a mergeable
quantile sketch gives the bounds. The window runs inside a range; what the ranges before it add is computed over one summary row a range,
of which a group has at most ``PLACES``, and joined back. Groups within ``width``, which are all of them on small data, need neither. The
data is shuffled once, by group and range. The first order column must be an integer, keys must not be null.

``number_sorted`` numbers rows by any sortable columns: one exchange by ranges, numbers within a range from the place of
the row in it, offsets from one summary row per group and range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fieldlens.operators import joins
from fieldlens.session import checkpoint

CHUNK_ROWS = 1_000_000
PLACES = 4096  # ranges of a group at most
FAN = 64  # bounds are looked up in two steps of this many
_CHUNK = "__chunk"
_LOCAL = "__local"
_CARRY = "__carry"


def _cut(df: DataFrame, keys: Sequence[str], order: Sequence[str], width: int) -> tuple[DataFrame, list[str]]:
    """``df`` with the range of every row, and the columns to shuffle by; just the keys where no group is large."""
    large = checkpoint(df.groupBy(*keys).count().filter(F.col("count") > width).withColumn("__need", F.least(F.ceil(F.col("count") / width), F.lit(PLACES)).cast("int")).drop("count"))
    most = large.agg(F.max("__need")).first()[0]
    if most is None:
        return df, list(keys)
    at = F.col(order[0]).cast("bigint")
    shares = [k / most for k in range(1, most)]
    inside = joins.dim_join(df, large.drop("__need"), keys, "left_semi") if keys else df
    sketch = inside.groupBy(*keys).agg(F.percentile_approx(at, shares, max(10_000, 4 * most)).alias("__all"))
    # a group takes as many of the bounds as it needs, in blocks of FAN
    own = f"transform(sequence(1, __need - 1), k -> __all[cast(k * {most} / __need as int) - 1])"
    blocks = f"transform(sequence(0, (__need - 2) div {FAN}), b -> slice(__own, b * {FAN} + 1, {FAN}))"
    bounds = (sketch.join(large, list(keys)) if keys else sketch.crossJoin(F.broadcast(large))).withColumn("__own", F.expr(own)).withColumn("__blocks", F.expr(blocks))
    bounds = bounds.select(*keys, "__blocks", F.expr("transform(__blocks, b -> b[size(b) - 1])").alias("__tops"))
    placed = joins.dim_join(df, bounds, keys) if keys else df.crossJoin(F.broadcast(bounds))  # one row
    mine = f"cast(`{order[0]}` as bigint)"
    block = f"size(filter(__tops, t -> t < {mine}))"
    inner = f"greatest(coalesce(size(filter(get(__blocks, __block), b -> b < {mine})), 0), 0)"
    return (placed.withColumn("__block", F.expr(block)).withColumn(_CHUNK, F.expr(f"if(__tops is null, 0, __block * {FAN} + {inner})"))
            .drop("__block", "__blocks", "__tops"), [*keys, _CHUNK])


def _earlier(keys: Sequence[str]):
    return W.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(W.unboundedPreceding, -1)


def _attach(df: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(carry, [*keys, _CHUNK], "left")


def number_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """1-based position of each row in its group, ordered by any sortable columns."""
    placed = checkpoint(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn(_LOCAL, F.monotonically_increasing_id())
                        .withColumn(_CHUNK, F.shiftright(_LOCAL, 33).cast("int")))
    before = _earlier(keys)
    # rows of a group are neighbours within a range; one row per group and range
    carry = placed.groupBy(*keys, _CHUNK).agg(F.min(_LOCAL).alias("__first"), F.count("*").alias("__n")).select(
        *keys, _CHUNK, (F.coalesce(F.sum("__n").over(before), F.lit(0)) + 1 - F.col("__first")).alias(_CARRY))
    return joins.dim_join(placed, carry, [*keys, _CHUNK], "inner").withColumn(name, F.col(_LOCAL) + F.col(_CARRY)).drop(_LOCAL, _CARRY, _CHUNK)


def row_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str,
               width: int = CHUNK_ROWS) -> DataFrame:
    """1-based position of each row in its group, ordered by ``order``."""
    cut, by = _cut(df, keys, order, width)
    local = cut.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("bigint"))
    if by == list(keys):
        return local
    carry = cut.groupBy(*by).agg(F.count("*").alias("__n")).select(*by, F.coalesce(F.sum("__n").over(_earlier(keys)), F.lit(0)).alias(_CARRY))
    return _attach(local, carry, keys).withColumn(name, F.col(name) + F.col(_CARRY)).drop(_CARRY, _CHUNK)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column] | None = None,
            lasts: dict[str, Column] | None = None, width: int = CHUNK_ROWS) -> DataFrame:
    """Cumulative sums and latest non-null values up to each row, all in one pass."""
    sums, lasts = sums or {}, lasts or {}
    chunked, by = _cut(df, keys, order, width)
    for name, value in {**sums, **lasts}.items():
        chunked = chunked.withColumn(f"__v_{name}", value)
    at = F.struct(*order)
    known = lambda name: F.col(f"__v_{name}").isNotNull()
    aggs = [F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums]
    aggs += [F.max_by(F.when(known(n), F.col(f"__v_{n}")), F.when(known(n), at)).alias(f"__t_{n}") for n in lasts]
    window = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = chunked.select("*", *[F.coalesce(F.sum(f"__v_{n}").over(window), F.lit(0)).alias(f"__l_{n}") for n in sums],
                           *[F.last(f"__v_{n}", ignorenulls=True).over(window).alias(f"__l_{n}") for n in lasts])
    if by == list(keys):
        return local.select(*df.columns, *[F.col(f"__l_{n}").cast("bigint").alias(n) for n in sums], *[F.col(f"__l_{n}").alias(n) for n in lasts])
    before = _earlier(keys)
    carry = chunked.groupBy(*keys, _CHUNK).agg(*aggs).select(
        *keys, _CHUNK, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__c_{n}") for n in sums],
        *[F.last(f"__t_{n}", ignorenulls=True).over(before).alias(f"__c_{n}") for n in lasts])
    joined = _attach(local, carry, keys)
    return joined.select(
        *df.columns, *[(F.col(f"__l_{n}") + F.col(f"__c_{n}")).cast("bigint").alias(n) for n in sums],
        *[F.coalesce(f"__l_{n}", f"__c_{n}").alias(n) for n in lasts])


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column,
                name: str, width: int = CHUNK_ROWS) -> DataFrame:
    """Cumulative sum of ``value`` up to and including each row."""
    return running(df, keys, order, sums={name: value.cast("bigint")}, width=width)


def last_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column,
               name: str, width: int = CHUNK_ROWS) -> DataFrame:
    """Latest non-null ``value`` at or before each row."""
    return running(df, keys, order, lasts={name: value}, width=width)


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column,
             name: str, width: int = CHUNK_ROWS) -> DataFrame:
    """``value`` of the row before each row (null on the first row of a group)."""
    cut, by = _cut(df, keys, order, width)
    chunked = cut.withColumn("__v", F.struct(value.alias("v")))
    local = chunked.withColumn(_LOCAL, F.lag("__v").over(W.partitionBy(*by).orderBy(*order)))
    if by == list(keys):
        return local.withColumn(name, F.col(_LOCAL)["v"]).drop(_LOCAL, "__v")
    chunks = W.partitionBy(*keys).orderBy(_CHUNK)
    carry = (
        chunked.groupBy(*keys, _CHUNK)
        .agg(F.max_by("__v", F.struct(*order)).alias("__last"))
        .withColumn(_CARRY, F.lag("__last").over(chunks))
        .drop("__last")
    )
    return (
        _attach(local, carry, keys)
        .withColumn(name, F.coalesce(_LOCAL, _CARRY)["v"])
        .drop(_LOCAL, _CARRY, _CHUNK, "__v")
    )
