"""Path expansion without a depth limit: both plans against a plain walk, long chains, hot parents, cycles."""

import os
import random

import pytest
from pyspark.sql import functions as F

from fieldlens.operators import trees as tr, xsd


def walk(edges, roots, mode, key):
    """(root, path, node, depth, sort key, circular) of every path."""
    out, todo = [], [(r, label, node, 0, (pos,), (key(label, node),), False) for r, node, label, pos in roots]
    while todo:
        r, path, node, depth, order, seen, circular = todo.pop()
        out.append((r, path, node, depth, order, circular))
        if circular:
            continue
        for parent, child, label, pos in edges:
            if parent == node:
                again = key(label, child) in seen
                if not again or mode == "circular":
                    todo.append((r, f"{path}/{label}", child, depth + 1, (*order, pos), (*seen, key(label, child)), again))
    return sorted(out, key=str)


def found(spark, edges, roots, **options):
    e = spark.createDataFrame(edges, "parent string, child string, label string, pos int")
    r = spark.createDataFrame(roots, "root string, node string, label string, pos int")
    got = tr.expand_paths(e, r, carry=("root",), **options).select("root", "path", "node", "depth", "sort_key", "circular").collect()
    return sorted(((x[0], x[1], x[2], x[3], tuple(x[4]), x[5]) for x in got), key=str)


@pytest.mark.parametrize("most_edges", [0, 1000])
@pytest.mark.parametrize("repeat", ["step", "node"])
@pytest.mark.parametrize("mode", ["skip", "circular"])
def test_random_graphs(spark, mode, repeat, most_edges):
    rng = random.Random(4)
    nodes = "ABCDEF"
    edges = sorted({(rng.choice(nodes), rng.choice(nodes), rng.choice("xy"), k) for k in range(11)})
    roots = [("r1", "A", "a", 0), ("r2", "B", "b", 1), ("r3", "Z", "z", 2), ("r1", "C", "x", 5)]
    key = (lambda label, node: node) if repeat == "node" else (lambda label, node: (label, node))
    want = walk(edges, roots, mode, key)
    assert len(want) > 20 and found(spark, edges, roots, mode=mode, repeat=repeat, most_edges=most_edges) == want


# a chain of 500 takes a minute and is run with FIELDLENS_ALL=1
@pytest.mark.parametrize("steps,most_edges", [(41, 1000), (41, 0), *([(500, 1000)] if os.environ.get("FIELDLENS_ALL") else [])])
def test_chains_are_complete(spark, steps, most_edges):
    edges = [(f"n{k}", f"n{k + 1}", f"n{k + 1}", 0) for k in range(steps)]
    got = found(spark, edges, [("r", "n0", "n0", 0)], most_edges=most_edges)
    assert len(got) == steps + 1 and max(d for *_, d, _, _ in got) == steps


def test_a_hot_parent_is_dealt_over_places(spark, monkeypatch):
    monkeypatch.setattr(tr, "CHILDREN", 7)
    edges = [("A", f"c{k}", f"c{k}", k) for k in range(100)] + [(f"c{k}", "end", "end", 0) for k in range(100)] + [("end", "A", "A", 0)]
    roots = [("r", "A", "A", 0)]
    assert found(spark, edges, roots, most_edges=0) == found(spark, edges, roots) == walk(edges, roots, "skip", lambda label, node: (label, node))


@pytest.mark.parametrize("most_edges", [0, 1000])
def test_a_depth_asked_for_and_no_roots(spark, most_edges):
    edges = [(f"n{k}", f"n{k + 1}", f"n{k + 1}", 0) for k in range(9)]
    assert [len(found(spark, edges, [("r", "n0", "n0", 0)], max_depth=d, most_edges=most_edges)) for d in (0, 1, 5, 20)] == [1, 2, 6, 10]
    assert found(spark, edges, [], most_edges=most_edges) == []


def test_long_derivations(spark):
    """A type derived over 41 steps has all of its bases."""
    types = spark.createDataFrame([("s", f"T{k}", f"T{k + 1}" if k < 41 else "") for k in range(42)], "schema_id string, type_name string, base string")
    chain = xsd.inheritance_chain(types).filter("type_name = 'T0'")
    assert chain.agg(F.max("level")).first()[0] == 41 and chain.count() == 42
    assert xsd.chain_text(types).filter("type_name = 'T0'").first().chain.count(" → ") == 41
