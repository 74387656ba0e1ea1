"""Centroid clustering of integer vectors: nearest centroids through a vantage-point tree, exact centroids.

``cluster`` keeps vectors of exactly ``dims`` components, none null or non-finite, and turns each component x into the integer
floor(scale * x). Centroids start as the kept vectors with the smallest sha256 of ``seed:id``. Every round builds a vantage-point
tree over the centroids on the driver (k rows, whatever the input), sends it to the tasks, assigns every vector to its nearest
centroid and replaces every non-empty centroid by the componentwise floor of its mean. A last assignment follows.

Search: a vector opens the node with the smallest lower bound first. A node's vantage centroid and the centroids of a leaf are compared
by exact integer distances. A subtree is left out only if its bound exceeds the best distance (equal ones are opened, with room for
the rounding of the bounds), so ties always meet and the smaller number wins. The rows of a batch go through the tree together.

Bounds: tasks send sums per (cluster, component), digits in base 2^32, so nothing overflows and the driver gets at most
k * (dims + 1) * 34 rows a round. Only the tree (k centroids) is sent out. No vector is shuffled.

Defined cases: null or wrong-sized vectors are left out; repeated rows count each; a null id hashes as the empty text; equal hashes
are ordered by the vector; fewer than k vectors make fewer centroids, an empty table an empty result; components of
2^27 and more are compared in Python integers against all centroids; a distance or sum beyond a long is null. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fieldlens.llm.base import arrow_map, stored

LEAF = 3  # centroids compared at once in a leaf
SAFE = 1 << 27  # below this magnitude 64-bit squares and their sums over 256 components are exact
LONG = (1 << 63) - 1


@dataclass
class Node:
    """A vantage centroid with its inside and outside subtree, or the centroids of a leaf."""

    members: list[int]
    children: list[tuple[int, float, float]] = field(default_factory=list)  # node, least and largest distance from the vantage centroid


class Tree:
    """Vantage-point tree over integer centroids; ``nearest`` finds (number, squared distance) for the rows of a matrix."""

    def __init__(self, centroids: list[list[int]]):
        self.exact = centroids
        self.safe = all(abs(x) < SAFE for c in centroids for x in c) and all(len(c) <= 256 for c in centroids)
        self.points = np.array(centroids, np.int64) if self.safe else None
        self.nodes: list[Node] = []
        if self.safe and centroids:
            self._grow(list(range(len(centroids))))

    def _grow(self, numbers: list[int]) -> int:
        me = len(self.nodes)
        node = Node(numbers)
        self.nodes.append(node)
        if len(numbers) > LEAF:
            spread = np.sqrt(_squares(self.points[numbers], self.points[numbers]).astype(np.float64))
            at = int(spread.std(axis=1).argmax())  # the vantage centroid that tells the others apart best
            order = [k for k in np.argsort(spread[at], kind="stable") if k != at]
            node.members = [numbers[at]]
            for part in (order[:len(order) // 2], order[len(order) // 2:]):
                node.children.append((self._grow([numbers[k] for k in part]), float(spread[at, part].min()), float(spread[at, part].max())))
        return me

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(rows)
        best, number = np.full(n, LONG, np.int64), np.full(n, len(self.exact), np.int64)
        radius = np.full(n, np.inf)
        bound = np.full((n, len(self.nodes)), np.inf)
        bound[:, 0] = 0
        live = np.arange(n)
        while live.size:
            at = bound[live].argmin(axis=1)
            low = bound[live, at]
            # inclusive: a subtree that may hold an equal distance is opened
            open_ = (low < np.inf) & (low <= radius[live] * (1 + 1e-9) + 1e-6)
            live, at, low = live[open_], at[open_], low[open_]
            bound[live, at] = np.inf
            for k in np.unique(at):
                mine = live[at == k]
                node = self.nodes[k]
                found = _squares(rows[mine], self.points[node.members])
                for column, centroid in enumerate(node.members):
                    d = found[:, column]
                    better = (d < best[mine]) | ((d == best[mine]) & (centroid < number[mine]))
                    best[mine[better]], number[mine[better]] = d[better], centroid
                radius[mine] = np.sqrt(best[mine].astype(np.float64))
                if node.children:
                    away, floor = np.sqrt(found[:, 0].astype(np.float64)), low[at == k]
                    for child, least, most in node.children:
                        bound[mine, child] = np.maximum(floor, np.maximum(least - away, away - most))
        return number, best

    def nearest_exact(self, row: list[int]) -> tuple[int, int]:
        distance, number = min((sum((x - y) ** 2 for x, y in zip(row, c)), k) for k, c in enumerate(self.exact))
        return number, distance


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` to the few rows of ``b``."""
    out = np.empty((len(a), len(b)), np.int64)
    for k, row in enumerate(b):
        gap = a - row
        out[:, k] = np.einsum("ij,ij->i", gap, gap)
    return out


def _floor(x: float, scale: int) -> int:
    return math.floor(x * scale) if abs(x) < 1e15 else int(x) * scale


def _vectors(batch: pa.RecordBatch, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, list[int]]]]:
    """Kept rows of a batch: places and integers of ordinary ones, (place, integers) of those with huge components."""
    col = batch.column(1)
    width = col.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(width == dims)
    values = col.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)  # nulls become NaN
    whole = np.isfinite(values).all(axis=1)
    at, values = at[whole], values[whole]
    small = (np.abs(values) < SAFE / (2 * scale)).all(axis=1)
    huge = [(int(p), [_floor(float(x), scale) for x in v]) for p, v in zip(at[~small], values[~small])]
    return at[small], np.floor(values[small] * scale).astype(np.int64), huge


def _assigned(batches: Iterator[pa.RecordBatch], tree: Tree, dims: int, scale: int):
    """(batch, places, matrix, number, distance, [(place, row, number, distance)]) of every batch."""
    for batch in batches:
        at, rows, huge = _vectors(batch, dims, scale)
        if tree.safe:
            number, distance = tree.nearest(rows)
        else:
            huge += [(int(p), [int(x) for x in row]) for p, row in zip(at, rows)]
            at, rows = at[:0], rows[:0]
            number, distance = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield batch, at, rows, number, distance, [(p, row, *tree.nearest_exact(row)) for p, row in huge]


def _digits(value: int) -> Iterator[tuple[int, int]]:
    """Digits in base 2^32, the highest with the sign; their sums over many tasks stay within a long."""
    k = 0
    while not -(1 << 31) <= value < 1 << 31:
        yield k, value & 0xFFFFFFFF
        value >>= 32
        k += 1
    yield k, value


def _means(vectors: DataFrame, tree: Tree, dims: int, scale: int) -> list[list[int]]:
    """New centroids: exact floors of the means; a centroid without vectors stays."""

    def sums(batches):
        total = [[0] * (dims + 1) for _ in tree.exact]  # the last place counts
        for _, _, rows, number, _, huge in _assigned(batches, tree, dims, scale):
            for k in np.unique(number):
                mine = rows[number == k]
                total[k] = [t + int(s) for t, s in zip(total[k], [*mine.sum(axis=0), len(mine)])]
            for _, row, k, _ in huge:
                total[k] = [t + s for t, s in zip(total[k], [*row, 1])]
        found = [(k, place, digit, value) for k, row in enumerate(total) if row[-1] for place, t in enumerate(row) for digit, value in _digits(t)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["k", "place", "digit", "value"])

    parts = arrow_map(vectors, sums, "k long, place long, digit long, value long").groupBy("k", "place", "digit").agg(F.sum("value").alias("value"))
    total = [[0] * (dims + 1) for _ in tree.exact]
    for r in parts.toArrow().to_pylist():  # at most k * (dims + 1) * 34 rows
        total[r["k"]][r["place"]] += r["value"] << (32 * r["digit"])
    return [[t // row[-1] for t in row[:-1]] if row[-1] else old for row, old in zip(total, tree.exact)]


def _first(vectors: DataFrame, k: int, dims: int, scale: int, seed: str) -> list[list[int]]:
    """The k kept vectors with the smallest hashes."""
    component = F.col("embedding")
    kept = vectors.where((F.size(component) == dims) & F.forall(component, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = kept.select(key.alias("key"), F.col("embedding").cast("array<double>").alias("embedding")).orderBy("key", "embedding").limit(k).collect()
    return [[_floor(x, scale) for x in r["embedding"]] for r in rows]


def cluster(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1") -> DataFrame:
    """(``vec_id``, cluster, distance, cluster_inertia, inertia, centroid array<string>, centroid_sha256) of every kept vector."""
    vectors = df.select(F.col(vec_id).alias("id"), F.col(embedding).alias("embedding"))
    tree = Tree(_first(vectors, k, dims, scale, seed))
    if not tree.exact:
        return vectors.where("false").select(
            F.col("id").alias(vec_id), F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")],
            F.array(F.lit("")).alias("centroid"), F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        tree = Tree(_means(vectors, tree, dims, scale))

    def rows(batches):
        for batch, at, _, number, distance, huge in _assigned(batches, tree, dims, scale):
            ids = batch.column(0).take(pa.array([*at, *(h[0] for h in huge)], pa.int64()))
            yield pa.RecordBatch.from_arrays([
                ids, pa.array([*number, *(h[2] for h in huge)], pa.int32()),
                pa.array([*map(int, distance), *(h[3] if h[3] <= LONG else None for h in huge)], pa.int64())], ["id", "cluster", "distance"])

    found = stored(arrow_map(vectors, rows, f"id {vectors.schema['id'].dataType.simpleString()}, cluster int, distance long"))
    totals = {r["cluster"]: r["total"] for r in found.groupBy("cluster").agg(_total("distance").alias("total")).collect()}  # k rows
    everything = None if None in totals.values() else sum(totals.values())
    known = found.sparkSession.createDataFrame(
        [(c, _long(t), _long(everything), [str(x) for x in tree.exact[c]]) for c, t in totals.items()],
        "cluster int, cluster_inertia long, inertia long, centroid array<string>")
    # k rows: one a centroid
    return found.join(F.broadcast(known), "cluster").select(
        F.col("id").alias(vec_id), "cluster", "distance", "cluster_inertia", "inertia", "centroid", F.sha2(F.concat_ws(",", "centroid"), 256).alias("centroid_sha256"))


def _total(name: str) -> Column:
    """The exact sum, null if a part of it is beyond a long."""
    return F.when(F.count(name) == F.count(F.lit(1)), F.sum(F.col(name).cast("decimal(38,0)")))


def _long(value) -> int | None:
    return int(value) if value is not None and value <= LONG else None


def oracle(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> str:
    """The same by plain comparison of all vectors with all centroids, in DuckDB SQL."""
    square = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [f"""
        kept AS MATERIALIZED (
            SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::HUGEINT) AS x FROM embeddings
            WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
        c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x
            FROM (SELECT sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM kept ORDER BY h, x LIMIT {k}))"""]
    for r in range(rounds + 1):
        steps.append(f"""
        a{r} AS MATERIALIZED (
            SELECT rid, any_value(vec_id) AS vec_id, any_value(vx) AS x, min_by(c, d * {k} + c) AS c, min(d) AS d
            FROM (SELECT v.rid, v.vec_id, v.x AS vx, c.c, {square} AS d FROM kept v CROSS JOIN c{r} c) GROUP BY rid)""")
        if r < rounds:
            steps.append(f"""
        s{r} AS (SELECT c, i, sum(x[i]) AS s, count(*)::HUGEINT AS n FROM a{r}, range(1, {dims + 1}) AS t(i) GROUP BY c, i),
        m{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{r} GROUP BY c),
        c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.x, o.x) AS x FROM c{r} o LEFT JOIN m{r} m USING (c))""")
    return f"""
        WITH {",".join(steps)}
        SELECT a.vec_id, a.c::INTEGER AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
               (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(c.x, lambda e: e::VARCHAR), ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c USING (c)"""
