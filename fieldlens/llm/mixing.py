"""Mixing sources to target weights by Pfair scheduling, in DataFrame expressions only.

Target weights become quotas of a period of ``period`` slots (largest remainders, one slot at least). Block k of a source
with quota q is released at slot floor((k - 1) * period / q) and due at ceil(k * period / q); every slot goes to the
released block with the earliest due time. The schedule keeps each source less than one block from its target at every
slot, and repeats with the period, so one period, computed by one fold over its slots, places every block of any table.

Documents get their number within a source without gathering a source: the order is a digest of the id, a source is cut
into ranges of that digest, numbers start from the summed counts of the ranges before.

Defined results: every row comes back. A source without a positive target (a null source is a source of its own) has no
slot; the blocks of other sources stay scheduled when one runs out, and ``in_mix`` tells the slots before that. Rows
with equal ids are adjacent and interchangeable; an empty table gives no rows.

``mix`` and its oracle hold rounded quotas to less than one block, so against the target weights drift adds up period by
period. ``mix_exact`` has no period: release and due times follow from the weights themselves, as integers in units of
1/2^``SCALE`` of their sum, and the fold runs chunk by chunk over the whole stream with the counts of the sources carried
on, until a source has no block left. The mix ends there; the blocks left of the others follow without gaps in the order
of their due times. Any number of sources; block numbers beyond 2^(63 - ``SCALE``) in a source are an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from fieldlens.llm.base import stored

PERIOD = 1000
BLOCK = 16
SCALE = 36
CHUNK = 1000  # slots of one inner fold
RANGE = 3  # hexadecimal digits of the digest: 4,096 ranges per source


def quotas(targets: DataFrame, period: int = PERIOD) -> DataFrame:
    """(source_key, quota) of (source_key, weight): whole slots of a period, together ``period``.

    Shares below one slot get one; the others divide the rest by largest remainders. At most half a period of sources.
    """
    share = targets.where("weight > 0 and source_key is not null").groupBy("source_key").agg(F.sum("weight").alias("weight"))
    share = share.withColumn("small", F.expr(f"weight * {period} < sum(weight) over ()"))
    share = share.withColumn("exact", F.expr(f"if(small, 1, weight / sum(if(small, 0, weight)) over () * ({period} - sum(cast(small as int)) over ()))"))
    share = share.withColumn("fl", F.greatest(F.lit(1), F.floor("exact"))).withColumn("short", F.expr(f"{period} - sum(fl) over ()"))
    share = share.withColumn("up", F.row_number().over(Window.orderBy(F.desc(F.col("exact") - F.col("fl")), "source_key"))).withColumn("down", F.row_number().over(Window.orderBy(F.desc("fl"), "source_key")))
    return share.select("source_key", F.expr("cast(fl + if(up <= short, 1, 0) - if(down <= -short, 1, 0) as int)").alias("quota"))


def schedule(quota: DataFrame, period: int = PERIOD) -> DataFrame:
    """(source_key, quota, turn, slot): the slot of each source's turn 0, 1, ... within one period."""
    fold = f"""
      aggregate(sequence(0, {period} - 1), struct(transform(q, x -> 0) as done, cast(array() as array<int>) as picks),
        (acc, t) -> transform(
          array(array_min(transform(filter(transform(q, (x, i) -> struct(i as i, x as x, acc.done[i] as d)), e -> (e.d * {period}) div e.x.quota <= t),
                                    e -> struct(((e.d + 1) * {period} + e.x.quota - 1) div e.x.quota as due, e.i as i))).i),
          p -> struct(transform(acc.done, (d, i) -> if(i = p, d + 1, d)) as done, array_append(acc.picks, p) as picks))[0],
        acc -> acc.picks)"""
    row = quota.agg(F.array_sort(F.collect_list(F.struct("source_key", "quota"))).alias("q")).where("size(q) > 0")
    slots = row.select("q", F.posexplode(F.expr(fold)).alias("slot", "pick")).select(F.expr("q[pick].source_key").alias("source_key"), F.expr("q[pick].quota").alias("quota"), "slot")
    return slots.withColumn("turn", F.row_number().over(Window.partitionBy("source_key").orderBy("slot")) - 1)


def source_key(source: str):
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null"))


def numbered(docs: DataFrame, doc_id: str, source: str, seed: int) -> DataFrame:
    """(doc_id, source, source_key, number): numbers 0, 1, ... within each source, in the order of a digest of the id."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), source_key(source).alias("source_key"),
                       F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))).alias("digest"))
    rows = rows.withColumn("part", F.substring("digest", 1, RANGE))
    counts = rows.groupBy("source_key", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("source_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    inside = F.row_number().over(Window.partitionBy("source_key", "part").orderBy("digest"))
    return rows.withColumn("inside", inside).join(before, ["source_key", "part"]).select(
        "doc_id", "source", "source_key", (F.coalesce("before", F.lit(0)) + F.col("inside") - 1).alias("number"))


def balanced(docs: DataFrame, source: str = "source", power: float = 0.5) -> DataFrame:
    """Targets from the table itself: sizes of the sources to a power below 1 lift small sources."""
    return docs.groupBy(source_key(source).alias("source_key")).agg(F.pow(F.count("*").cast("double"), F.lit(power)).alias("weight"))


def mix(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", source: str = "source", period: int = PERIOD, block: int = BLOCK, seed: int = 1) -> DataFrame:
    """doc_id, source, block (1, 2, ... within the source), slot, position, in_mix of every document.

    ``targets`` has (source_key, weight), keys made by ``source_key``. ``position`` orders the mixed stream.
    """
    turns = schedule(quotas(targets, period), period)
    rows = numbered(docs, doc_id, source, seed).withColumn("block", F.expr(f"number div {block}"))
    ends = rows.groupBy("source_key").agg(F.max("block").alias("last")).join(turns.select("source_key", "quota").distinct(), "source_key", "right")
    # the first slot for which a source has no block left
    stop = ends.withColumn("next", F.coalesce(F.col("last") + 1, F.lit(0))).withColumn("turn", F.expr("cast(next % quota as int)")).join(turns.select("source_key", "turn", "slot"), ["source_key", "turn"])
    stop = stop.agg(F.min(F.expr(f"next div quota * {period} + slot")).alias("stop"))
    known = turns.groupBy("source_key", "quota").agg(F.map_from_entries(F.collect_list(F.struct("turn", "slot"))).alias("slots"))
    placed = rows.join(known, "source_key", "left").withColumn("slot", F.expr(f"block div quota * {period} + element_at(slots, cast(block % quota as int))"))
    return placed.crossJoin(F.broadcast(stop)).select(
        "doc_id", "source", (F.col("block") + 1).alias("block"), "slot", (F.col("slot") * block + F.col("number") % block).alias("position"),
        F.coalesce(F.col("slot") < F.col("stop"), F.lit(False)).alias("in_mix"))


def _exact_turns(known: DataFrame) -> DataFrame:
    """(source_key, turn, slot) of one row ``q`` (key, weight as integer, number of blocks): slots up to the first one that finds its source empty."""
    step = """
      transform(
        array(array_min(transform(filter(transform(q, (x, i) -> struct(i as i, x as x, acc.done[i] as d)), e -> (e.d * total) div e.x.w <= t),
                                  e -> struct(((e.d + 1) * total + e.x.w - 1) div e.x.w as due, e.i as i))).i),
        p -> struct(transform(acc.done, (d, i) -> if(i = p, d + 1, d)) as done, array_append(acc.picks, p) as picks))[0]"""
    chunk = f"aggregate(sequence(c * {CHUNK}, least(c * {CHUNK} + {CHUNK}, length) - 1), struct(all.done as done, cast(array() as array<int>) as picks), (acc, t) -> {step})"
    fold = f"""
      aggregate(sequence(0L, (length - 1) div {CHUNK}), struct(transform(q, x -> 0L) as done, cast(array() as array<array<int>>) as picks),
        (all, c) -> transform(array({chunk}), s -> struct(s.done as done, array_append(all.picks, s.picks) as picks))[0], all -> all.picks)"""
    # by its due time the block after the last one of a source is asked for, and by then at the latest all blocks are used up
    row = known.withColumn("length", F.expr("least(array_min(transform(q, x -> ((x.n + 1) * total + x.w - 1) div x.w)), aggregate(q, 1L, (a, x) -> a + x.n))"))
    slots = row.select("q", F.posexplode(F.expr(fold)).alias("c", "picks")).select("q", "c", F.posexplode("picks").alias("at", "pick"))
    slots = slots.select(F.expr("q[pick].source_key").alias("source_key"), (F.col("c").cast("long") * CHUNK + F.col("at")).alias("slot"))
    return slots.withColumn("turn", F.row_number().over(Window.partitionBy("source_key").orderBy("slot")).cast("long") - 1)


def mix_exact(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", source: str = "source", block: int = BLOCK, seed: int = 1) -> DataFrame:
    """As ``mix``, without a period: each source stays less than one block from its target at every slot of the mix."""
    rows = numbered(docs, doc_id, source, seed).withColumn("block", F.expr(f"number div {block}"))
    blocks = rows.groupBy("source_key", "block").agg(F.lit(1).alias("one")).drop("one")
    share = targets.where("weight > 0 and source_key is not null").groupBy("source_key").agg(F.sum("weight").alias("weight"))
    share = share.withColumn("w", F.expr(f"greatest(1L, cast(round(weight / sum(weight) over () * {1 << SCALE}) as bigint))"))
    share = share.join(blocks.groupBy("source_key").agg(F.count("*").alias("n")), "source_key", "left").select("source_key", "w", F.coalesce("n", F.lit(0)).alias("n"))
    known = stored(share.agg(F.array_sort(F.collect_list(F.struct("source_key", "w", "n"))).alias("q"), F.sum("w").alias("total")).where("size(q) > 0"))
    turns = stored(_exact_turns(known))
    sizes = known.select(F.explode("q").alias("x")).select("x.*")
    stop = turns.join(sizes, "source_key").where("turn >= n").agg(F.min("slot").alias("stop"))
    inside = turns.crossJoin(F.broadcast(stop)).where("slot < stop")
    # the blocks left: how many others come before by (due time, source), counted without a sort
    done = sizes.join(inside.groupBy("source_key").agg(F.count("*").alias("done")), "source_key", "left").withColumn("done", F.coalesce("done", F.lit(0)))
    left = done.agg(F.array_sort(F.collect_list(F.struct("source_key", "w", "n", "done"))).alias("rest"))
    behind = F.expr("""stop + aggregate(rest, 0L, (a, x) -> a + greatest(0L, least(x.n,
        if(x.source_key < source_key, (block + 1) * x.w div w, ((block + 1) * x.w + w - 1) div w - 1)) - x.done))""")
    placed = blocks.join(inside.select("source_key", F.col("turn").alias("block"), "slot"), ["source_key", "block"], "left")
    placed = placed.join(sizes.select("source_key", "w"), "source_key", "left").crossJoin(F.broadcast(stop)).crossJoin(F.broadcast(left))
    placed = placed.select("source_key", "block", F.coalesce("slot", F.when(F.col("w").isNotNull(), behind)).alias("slot"), F.col("slot").isNotNull().alias("in_mix"))
    return rows.join(placed, ["source_key", "block"]).select(
        "doc_id", "source", (F.col("block") + 1).alias("block"), "slot", (F.col("slot") * block + F.col("number") % block).alias("position"), "in_mix")


def oracle(period: int = PERIOD, block: int = BLOCK, seed: int = 1, power: float = 0.5) -> str:
    """The same in SQL over ``documents``, with a recursive query for the schedule."""
    return f"""
with recursive d as (select doc_id, source, coalesce('=' || source, 'null') as k, md5('{seed}:' || coalesce(cast(doc_id as varchar), '')) as digest from documents),
numbered as (select doc_id, source, k, row_number() over (partition by k order by digest) - 1 as number from d),
w as (select k, pow(cast(count(*) as double), {power}) as weight from d group by k),
sm as (select *, weight * {period} < sum(weight) over () as small from w),
e as (select k, case when small then 1 else weight / sum(case when small then 0 else weight end) over () * ({period} - sum(cast(small as int)) over ()) end as exact from sm),
f as (select k, exact, greatest(1, floor(exact)) as fl from e),
g as (select k, fl, {period} - sum(fl) over () as short, row_number() over (order by exact - fl desc, k) as up, row_number() over (order by fl desc, k) as down from f),
q as (select k, cast(fl + case when up <= short then 1 else 0 end - case when down <= -short then 1 else 0 end as bigint) as quota from g),
qs as (select list(quota order by k) as qs, list(k order by k) as ks from q),
run(t, done, pick) as (
  select -1, list_transform(qs, lambda x: cast(0 as bigint)), cast(null as bigint) from qs
  union all
  select t + 1, list_transform(done, lambda x, i: x + case when i = p then 1 else 0 end), p
  from (select t, done, (select list_min(list_transform(list_filter(range(1, len(qs) + 1), lambda i: (done[i] * {period}) // qs[i] <= t + 1),
      lambda i: ((done[i] + 1) * {period} + qs[i] - 1) // qs[i] * 100000 + i)) % 100000 from qs) as p from run where t < {period} - 1) s),
turns as (select ks[pick] as k, qs[pick] as quota, t as slot, row_number() over (partition by pick order by t) - 1 as turn from run, qs where pick is not null),
placed as (select n.*, number // {block} as b, t.slot + (number // {block}) // t.quota * {period} as slot
  from numbered n join q on q.k = n.k join turns t on t.k = n.k and t.turn = (number // {block}) % q.quota),
ends as (select k, max(b) + 1 as nxt from placed group by k),
stop as (select min(nxt // t.quota * {period} + t.slot) as stop from ends join turns t on t.k = ends.k and t.turn = nxt % t.quota)
select doc_id, source, b + 1 as block, slot, slot * {block} + number % {block} as position, slot < stop as in_mix from placed, stop
"""
