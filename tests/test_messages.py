"""Whole-message plans against the node-table ones and against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from fieldlens.operators import flatten as fl, mapping as mp, message_diff as md


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def tree(rng, depth=0):
    tag = rng.choice("ABC") if depth else "R"
    attrs = "".join(f' {a}="{rng.randrange(2)}"' for a in rng.sample("xyz", rng.randrange(3)))
    text = rng.choice(["", "", "t", " t ", "u\n v"])
    kids = [tree(rng, depth + 1) for _ in range(rng.randrange(4) if depth < 4 else 0)]
    if rng.random() < 0.3:
        kids.insert(0, f"<Id>{rng.choice(['k1', 'k2', 'a/b'])}</Id>")
    return f"<{tag}{attrs}>{text}{''.join(kids)}</{tag}>"


def changed(rng, xml):
    """The text with one tag, value or element changed."""
    at = rng.randrange(3)
    return [xml.replace(">t<", ">w<", 1), xml.replace("<B>", "<B><New/>", 1), xml.replace('x="0"', 'x="1"', 1)][at]


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(11)
    left = [(k, tree(rng)) for k in range(150)]
    right = [(k, x if k % 3 == 0 else changed(rng, x) if k % 3 == 1 else tree(rng)) for k, x in left]
    left += [(900, "<R><A></R>"), (901, None), (902, "<R/>"), (903, "<R><A/></R>")]
    right += [(900, "<R/>"), (901, "<R/>"), (903, "<Q><A/></Q>"), (904, "<R/>")]
    frame = lambda data: spark.createDataFrame(data, "msg_id bigint, xml string").repartition(3)
    return frame(left), frame(right)


@pytest.mark.parametrize("ignore_order", [False, True])
@pytest.mark.parametrize("ignore_attributes", [False, True])
@pytest.mark.parametrize("ignore_whitespace", [False, True])
def test_texts_give_the_differences_of_node_tables(pairs, ignore_order, ignore_attributes, ignore_whitespace):
    options = dict(ignore_order=ignore_order, ignore_attributes=ignore_attributes, ignore_whitespace=ignore_whitespace)
    nodes = md.message_diff(*[fl.flatten_xml(p, pairing=True) for p in pairs], **options)
    found = rows(md.compare_messages(*pairs, **options))
    assert len(found) > 100 and found == rows(nodes.select("msg_id", "pos", "diff_type", "path", "element", "left_value", "right_value", "details"))


def test_equal_subtrees_are_not_opened(spark):
    """A changed leaf gives one place, however large the rest; equal messages and other orders of keyed children give none."""
    block = "".join(f"<Tx><Id>{k}</Id><V>{k}</V></Tx>" for k in range(300))
    other = "".join(f"<Tx><Id>{k}</Id><V>{k}</V></Tx>" for k in reversed(range(300)))
    data = [(1, f"<R>{block}</R>", f"<R>{block}</R>"), (2, f"<R>{block}</R>", f"<R>{block.replace('<V>7<', '<V>x<')}</R>"), (3, f"<R>{block}</R>", f"<R>{other}</R>")]
    df = spark.createDataFrame(data, "msg_id bigint, left string, right string")
    count = lambda ordered: {r["msg_id"]: r["count"] for r in fl.differing_nodes(df, ordered=ordered).groupBy("msg_id").count().collect()}
    assert count(True) == {2: 1, 3: 600} and count(False) == {2: 1}


def test_deep_documents(spark):
    deep = lambda v: "<a>" * 20000 + v + "</a>" * 20000
    one = lambda v: spark.createDataFrame([(1, deep(v))], "msg_id bigint, xml string")
    found = md.compare_messages(one("1"), one("2")).select("diff_type", "left_value", "right_value").collect()
    assert [tuple(r) for r in found] == [("changed", "1", "2")]


def test_exchanges_of_a_comparison(pairs):
    found = md.compare_messages(*pairs)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    # the two inputs are the only scans: nothing is stored in between
    assert final.count("Exchange hashpartitioning") <= 2 and final.count("Scan ExistingRDD[") == 2


# ---- migration -----------------------------------------------------------------------


def schema(rng, n):
    paths, out = ["D"], {"D": "1"}
    while len(out) < n:
        path = rng.choice(paths) + "/" + rng.choice("abcdef") + rng.choice("123")
        if path not in out:
            out[path] = rng.choice("01")
            paths.append(path)
    if rng.random() < 0.5:  # a part of the tree whose parent is not a field itself
        out["D/gone/x"] = "0"
        out["D/gone/x/y"] = "1"
    return out


@pytest.mark.parametrize("seed", range(3))
def test_one_map_gives_the_joined_migration(spark, seed):
    rng = random.Random(seed)
    fields = schema(rng, 40)
    target = spark.createDataFrame([(p, o, k) for k, (p, o) in enumerate(fields.items())], "path string, min_occurs string, seq int")
    names = [p for p in fields if p != "D"]
    mapping = [(f"S/{rng.choice('abc')}{rng.randrange(9)}", rng.choice(names)) for _ in range(30)] + [(p, p) for p in rng.sample(names, 8)] + [("S/a1", "not/there")]
    mapped = spark.createDataFrame(sorted(set(mapping)), "source_path string, target_path string")

    def message(k):
        parts = "".join(f"<{t}{rng.randrange(9)}>{rng.randrange(99)}</{t}{rng.randrange(9)}>" for t in ())
        inner = "".join(f"<{tag}>{rng.randrange(99)}</{tag}>" for tag in (f"{rng.choice('abc')}{rng.randrange(9)}" for _ in range(rng.randrange(12))))
        return f"<S q='{k}'>{parts}{inner}</S>"

    def own(k):
        """A message that uses the target's own paths."""
        out, text = {}, []
        for p in rng.sample(names, 10):
            tags = p.split("/")[1:]
            text.append("".join(f"<{x}>" for x in tags) + str(rng.randrange(99)) + "".join(f"</{x}>" for x in reversed(tags)))
        return f"<D>{''.join(text)}{out or ''}</D>"

    data = [(k, message(k) if k % 2 else own(k)) for k in range(60)] + [(90, "<S"), (91, None), (92, "<S/>")]
    messages = spark.createDataFrame(data, "msg_id bigint, xml string")
    values = fl.leaf_map(fl.flatten_xml(messages, columns=fl.LEAF_COLUMNS))
    tree = mp.target_tree(mapped, target)
    moved = mp.move(messages, tree)
    assert rows(mp.moved_values(moved)) == rows(mp.apply_mapping(values, mapped, target))
    migrated = mp.migrate(values, mapped, target)
    assert rows(mp.moved_rows(moved).select(*migrated.columns)) == rows(migrated)
    left = mp.unmapped_sources(values, mapped, target)
    assert rows(mp.moved_leftovers(moved)) == rows(left)
    assert rows(mp.moved_stats(moved)) == rows(mp.transform_stats(mp.actions(migrated, left)).select("msg_id", "total", "mapped", "defaults", "not_mapped"))
    back = fl.leaf_map(fl.flatten_xml(mp.moved_messages(moved), columns=fl.LEAF_COLUMNS))
    assert rows(back) == rows(migrated.filter("value is not null").select("msg_id", "path", "value"))
    assert "Exchange" not in moved._jdf.queryExecution().executedPlan().toString()
    # the fields above a field are those whose span holds it
    spans = {p: (k, leave) for k, (p, leave, *_) in enumerate(tree.fields)}
    for p, (k, _) in spans.items():
        assert {q for q, (a, z) in spans.items() if a <= k <= z} == {q for q in spans if p == q or p.startswith(q + "/")}


def test_migrated_attributes_and_escapes(spark):
    target = spark.createDataFrame([("D", "1", 0), ("D/A", "1", 1), ("D/A/@c", "0", 2), ("D/B/@only", "1", 3), ("D/E", "1", 4)], "path string, min_occurs string, seq int")
    mapping = spark.createDataFrame([("S/x", "D/A"), ("S/x/@k", "D/A/@c")], "source_path string, target_path string")
    messages = spark.createDataFrame([(1, "<S><x k='&quot;&lt;'>a &amp; b</x></S>"), (2, "<S><x>1</x></S>")], "msg_id bigint, xml string")
    moved = mp.move(messages, mp.target_tree(mapping, target, add_defaults=False))
    assert rows(mp.moved_messages(moved)) == [
        (1, '<D><A c="&quot;&lt;">a &amp; b</A><B only=""></B><E></E></D>'), (2, '<D><A>1</A><B only=""></B><E></E></D>')]


def test_a_schema_too_large_to_travel_is_refused(spark, monkeypatch):
    monkeypatch.setattr(mp, "MOST_FIELDS", 3)
    target = spark.createDataFrame([(f"D/{k}", "1") for k in range(5)], "path string, min_occurs string")
    with pytest.raises(ValueError, match="leaf_map and migrate"):
        mp.target_tree(spark.createDataFrame([], "source_path string, target_path string"), target)
