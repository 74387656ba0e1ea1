"""Messages rendered and moved a batch at a time: no expression is interpreted per field in the plan."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from fieldlens.operators import flatten as fl, mapping as mp, validate as vd

ROWS = [
    (1, 1, "D/@v", 'a"<&'), (1, 2, "D/A", "x < y & z"), (1, 3, "D/A/@k", "1"), (1, 4, "D/A/@l", None), (1, 5, "D/B[1]/C", None), (1, 6, "D/B[2]/C", "c"), (1, 7, "D/B[2]/C", "d"),
    (1, 8, "D/E/F/@q", "only"), (1, 9, "D/E/F", "new"), (2, 1, "D", ""), (3, 1, "R/x[12]y/z[3]", "w"),
]
TEXTS = {
    1: '<D v="a&quot;&lt;&amp;"><A k="1" l="">x &lt; y &amp; z</A><B><C></C></B><B><C>c</C><C>d</C></B><E><F q="only"></F><F>new</F></E></D>',
    2: "<D></D>", 3: "<R><x[12]y><z>w</z></x[12]y></R>",
}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rendered_texts_without_interpreted_lambdas(spark):
    rows = spark.createDataFrame(ROWS, "msg_id int, ord int, path string, value string")
    made = fl.rebuild_xml(rows)
    assert {r["msg_id"]: r["xml"] for r in made.collect()} == TEXTS
    assert "lambda" not in _plan(made)


def test_renderer_forgets_steps_beyond_its_limit(monkeypatch):
    monkeypatch.setattr(fl._Renderer, "MOST", 2)
    render = fl._Renderer()
    for i in range(10):
        assert render([f"D/A{i}", f"D/B{i}/C"], ["1", "2"]) == f"<D><A{i}>1</A{i}><B{i}><C>2</C></B{i}></D>"
    assert len(render._paths) <= 2 and len(render._steps) <= 2 and len(render._ends) <= 2


def test_messages_are_moved_in_batches(spark, monkeypatch):
    monkeypatch.setattr(mp, "MOST_CELLS", 1)  # a message at a time
    texts = [(1, "<D><A>x</A><B k='1'>y</B><Z>z</Z></D>"), (2, "<D><A>x"), (3, "<D/>"), (4, "<D><B>y</B></D>"), (None, "<D><A>n</A></D>"), (5, None)]
    messages = spark.createDataFrame(texts, "msg_id int, xml string")
    target = spark.createDataFrame([("D", "1", 1), ("D/A", "1", 2), ("D/O", "0", 3), ("D/O/B", "1", 4), ("D/ChrgBr", "1", 5)], "path string, min_occurs string, seq int")
    mapping = spark.createDataFrame([("D/A", "D/A"), ("D/B", "D/O")], "source_path string, target_path string")
    moved = mp.move(messages, mp.target_tree(mapping, target, now=datetime(2024, 1, 1)))
    assert "lambda" not in _plan(moved)
    got = {r["msg_id"]: ({f["path"]: (f["source_path"], f["value"], f["how"], f["present"]) for f in r["fields"]}, [tuple(u) for u in r["unmapped"]]) for r in moved.collect()}
    # texts that cannot be read and those without a value give no row
    assert set(got) == {1, 4, None}
    assert got[1] == ({"D": (None, None, "empty", False), "D/A": ("D/A", "x", "mapped", True), "D/O": ("D/B", "y", "mapped", True), "D/O/B": (None, None, "empty", True),
                       "D/ChrgBr": (None, "SLEV", "default", True)}, [("D/Z", "z")])
    assert got[4][0]["D/A"] == (None, None, "empty", True) and got[4][0]["D/O/B"][3]
    assert not got[None][0]["D/O/B"][3] and got[None][1] == []


def test_rules_get_the_elements_they_are_about(spark, monkeypatch):
    text = "<D><GrpHdr><MsgId>1</MsgId><MsgId>2</MsgId></GrpHdr><InstdAmt Ccy='eur'>-1</InstdAmt>" + "<Other>x</Other>" * 50 + "</D>"
    messages = spark.createDataFrame([(1, text), (2, "<D>")], "msg_id int, xml string")
    handed, whole = [], fl.flatten_xml
    monkeypatch.setattr(vd, "flatten_xml", lambda *a, **k: handed.append(whole(*a, **k)) or handed[-1])
    key = lambda rows: sorted((r["msg_id"], r["category"], r["path"]) for r in rows)
    found = [key(vd.validate(messages).collect()), key(vd.validate_by_tables(messages, vd.default_rules(spark)).collect())]
    every = key(vd.validate_nodes(whole(messages)).collect())
    assert found == [every, every] and len(every) >= 4
    assert all(nodes.filter(F.col("kind") != "parse_error").filter(F.col("tag") == "Other").count() == 0 for nodes in handed)
