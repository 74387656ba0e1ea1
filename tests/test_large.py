"""Inputs that outgrow a task or the driver: the same rows in bounded memory."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa
import pytest

from fieldlens.operators import flatten as fl, xsd

TEXTS = [
    "<a>x<!--c-->y<b k='1'/>tail<b>t<?pi x?>u<c xmlns:n='urn:q' n:k='2' k='3'>&lt;z&amp;</c></b> </a>", "<a><b></a>", "<a>&foo;</a>", "  <a/>", "", "<a/>x",
    "<x:a xmlns:x='u'><x:b x:k='1' k='2'>q</x:b></x:a>", "<!DOCTYPE a [<!ENTITY e 'v<b>w</b>'>]><a>s&e;t</a>", "<a>" + "<b n='1'>v</b>" * 9000 + "</a>", "<a>" + "<b n='1'>v</b>" * 9000,
]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("keep_ns", [False, True])
def test_events_give_the_rows_of_the_tree(text, keep_ns, monkeypatch):
    monkeypatch.setattr(fl, "READ_CHARS", 7 if len(text) < 1000 else 1 << 16)
    at = [i for i, (n, _) in enumerate(fl.NODE_FIELDS + fl.PAIR_FIELDS) if n in fl.EVENT_COLUMNS]
    plain = lambda rows: [[r[i] for i in at] for r in rows]
    whole = fl._node_rows(text, True, keep_ns)
    assert plain(r for piece in fl._event_rows(text, True, keep_ns) for r in piece) == plain(whole)
    assert plain(r for piece in fl._event_rows(text, True, keep_ns, False) for r in piece) == plain(r for r in whole if r[7] != "attribute")


def test_large_schema_is_read_in_bounded_memory(spark, monkeypatch):
    """The parse of F10 to F26: its memory must not grow with the tree of a document."""
    docs = spark.createDataFrame([("s", "<x/>")], "schema_id string, text string")
    taken = {}
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: taken.setdefault("run", run) and docs)
    try:
        xsd.schema_nodes(docs)
    except Exception:  # the stand-in has no node columns
        pass
    text = "<s>" + "".join(f"<element name='F{i}' type='P{i}'><annotation><documentation source='d'>t{i}</documentation></annotation></element>" for i in range(60_000)) + "</s>"
    batch = pa.RecordBatch.from_arrays([pa.array(["s"]), pa.array([text])], ["schema_id", "text"])
    tracemalloc.start()
    try:
        n = sum(b.num_rows for b in taken["run"](iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 1 + 3 * 60_000
    assert peak < 8 * len(text)


def test_large_schema_has_the_nodes_of_a_small_one(spark, monkeypatch):
    text = "<schema><element name='A' type='T'/><complexType name='T'><sequence><element name='B' type='x:P' minOccurs='0'/></sequence></complexType></schema>"
    docs = spark.createDataFrame([("s", text), ("bad", "<schema>"), (None, None)], "schema_id string, text string")
    rows = lambda: sorted(map(repr, xsd.schema_nodes(docs).collect()))
    small = rows()
    monkeypatch.setattr(fl, "LARGE_TEXT", 0)
    assert rows() == small
    assert len(small) == 5
