"""Properties and brute-force checks on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from fieldlens import fixed, fixtures as fx
from fieldlens.functions import lists, text as t
from fieldlens.operators import (flatten as fl, guides as gd, joins, mapping as mp, message_diff as md, ordered, pages as pg, records as rc,
                                 schema_diff as sd, trees as tr, validate as vd)
from fieldlens.queries.base import catalog


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(5)
    data = [(rng.choice(["hot"] * 6 + ["a", "b", "c"]), i, rng.choice([None, f"v{i}"])) for i in range(400)]
    return spark.createDataFrame(data, "k string, o int, v string"), data


@pytest.mark.parametrize("width", [1, 7, 64, 10_000])
def test_ordered_scans_agree_with_plain_loops(events, width):
    df, data = events
    expect, last, count, prev = [], {}, {}, {}
    for k, o, v in data:
        count[k] = count.get(k, 0) + 1
        before = prev.get(k)
        last[k] = v if v is not None else last.get(k)
        prev[k] = v
        expect.append((k, o, count[k], last[k], before))
    a = ordered.row_number(df, ["k"], ["o"], "n", width)
    a = ordered.last_known(a, ["k"], ["o"], F.col("v"), "last", width)
    a = ordered.previous(a, ["k"], ["o"], F.col("v"), "prev", width)
    assert rows(a.select("k", "o", "n", "last", "prev")) == sorted(expect, key=str)
    total = ordered.running_sum(df, [], ["o"], F.lit(1), "s", width)
    assert rows(total.select("o", "s")) == sorted([(o, o + 1) for _, o, _ in data], key=str)


@pytest.mark.parametrize("width", [5, 40, 1000])
def test_ordered_scans_over_sparse_values(spark, width):
    """Order values far apart: ranges hold equally many rows all the same."""
    rng = random.Random(8)
    data = [(rng.choice(["hot"] * 6 + ["a", "b"]), rng.randrange(-10 ** 15, 10 ** 15), rng.choice([None, i])) for i in range(700)]
    df = spark.createDataFrame(data, "k string, o long, v int")
    got = ordered.running(df, ["k"], ["o"], {"total": F.coalesce("v", F.lit(0))}, {"last": F.col("v")}, width)
    got = ordered.row_number(ordered.number_sorted(got, ["k"], ["o", "v"], "m"), ["k"], ["o"], "n", width)
    expect, total, last, count = [], {}, {}, {}
    for k, o, v in sorted(data, key=lambda r: r[:2]):
        total[k], last[k], count[k] = total.get(k, 0) + (v or 0), v if v is not None else last.get(k), count.get(k, 0) + 1
        expect.append((k, o, total[k], last[k], count[k], count[k]))
    assert rows(got.select("k", "o", "total", "last", "n", "m")) == sorted(expect, key=str)
    cut, by = ordered._cut(df, ["k"], ["o"], width)
    if width < 1000:
        sizes = [r["count"] for r in cut.filter("k = 'hot'").groupBy(*by).count().collect()]
        assert max(sizes) <= 2 * width
    else:
        assert by == ["k"]


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordered, "FAN", 3)
    df = spark.range(500).select((F.col("id") * 7919).alias("o"))
    got = ordered.running_sum(df, [], ["o"], F.lit(1), "s", 6)
    assert rows(got) == sorted([(k * 7919, k + 1) for k in range(500)], key=str)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_dim_join_salted_equals_broadcast(spark, how):
    facts = spark.range(200).select((F.col("id") % 7).alias("k"), F.col("id"))
    dim = spark.createDataFrame([(i, f"d{i}") for i in range(5)], "k bigint, d string")
    small, large = joins.dim_join(facts, dim, ["k"], how), joins.dim_join(facts, dim, ["k"], how, max_rows=2, salts=4)
    assert rows(small.select(sorted(small.columns))) == rows(large.select(sorted(large.columns)))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_dim_join_spreads_only_hot_keys(spark, how):
    facts = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 700).alias("k"), F.col("id"))
    dim = spark.createDataFrame([(i, f"d{i}") for i in range(0, 600, 2)] + [(1, "one"), (1, "again")], "k bigint, d string")
    plain = facts.join(dim, ["k"], how)
    assert joins.hot_keys(facts, ["k"], 500) == [facts.filter("k = 1").select(F.xxhash64("k")).first()[0]]
    spread = joins.dim_join(facts, dim, ["k"], how, max_rows=2, salts=4, hot_rows=500)
    assert rows(spread.select(sorted(spread.columns))) == rows(plain.select(sorted(plain.columns)))
    assert "sequence" in spread._jdf.queryExecution().analyzed().toString()
    cold = joins.dim_join(facts, dim, ["k"], how, max_rows=2, salts=4)
    assert rows(cold) == rows(plain) and "explode" not in cold._jdf.queryExecution().analyzed().toString()


def test_broadcast_is_judged_in_bytes(spark):
    wide = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    assert joins.fits_broadcast(wide) and not joins.fits_broadcast(wide, max_bytes=5000) and not joins.fits_broadcast(wide, max_rows=9)


@pytest.mark.parametrize("depth,threshold", [(20, 0.7), (30, 0.7), (6, 0.5), (9, 0.0), (3, 0.99)])
def test_similar_paths_of_any_depth(spark, depth, threshold):
    rng = random.Random(depth)
    stem = [f"p{k}" for k in range(depth - 1)]

    def path():
        parts = list(stem)
        for k in rng.sample(range(depth - 1), rng.randrange(min(depth - 1, depth // 2) + 1)):
            parts[k] = rng.choice("xyz")
        return "/".join([*parts, rng.choice("AB")])

    src, dst = sorted({path() for _ in range(60)}), sorted({path() for _ in range(60)})
    frame = lambda paths: spark.createDataFrame([(p,) for p in paths], "path string")
    expect = []
    for s in set(src) - set(dst):
        near = []
        for d in dst:
            if s.split("/")[-1] == d.split("/")[-1]:
                differ = sum(a != b for a, b in zip(s.split("/"), d.split("/")))
                if differ <= min(int(depth * (1 - threshold) + 1e-9), depth - 1):
                    near.append((differ, d))
        if near:
            expect.append((s, min(near)[1]))
    assert rows(mp.similar_path_map(frame(src), frame(dst), threshold).select("source_path", "target_path")) == sorted(expect, key=str)


def test_diff_properties(spark, sf_dir):
    a, b = catalog(spark, sf_dir, "cat_v1"), catalog(spark, sf_dir, "cat_v2")
    assert sd.schema_diff(a, a).count() == 0
    kind = lambda d, k: rows(d.filter(F.col("change_type") == k).select("path"))
    assert kind(sd.schema_diff(a, b), "ADDED") == kind(sd.schema_diff(b, a), "REMOVED")


def test_class_transitions(spark):
    data = [(a, b) for a in ("YELLOW", "WHITE", "NA", "RED") for b in ("YELLOW", "WHITE", "NA", "RED") if a != b]
    got = {(r[0], r[1]): (r[2], r[3]) for r in spark.createDataFrame(data, "a string, b string").select(
        "a", "b", sd.class_rule(F.col("a"), F.col("b"), 2), sd.class_rule(F.col("a"), F.col("b"), 3)).collect()}
    known = {(r[0], r[1]): (r[2], r[3]) for r in fixed.CLASS_TRANSITIONS}
    assert all(got[p] == known.get(p, fixed.CLASS_OTHER[:2]) for p in data)


def test_pairing_is_a_partition_of_both_sides(spark, sf_dir):
    cat = catalog(spark, sf_dir, "cat_v2")
    guide = fx.frame(spark, sf_dir, "guide_b").withColumn("pos", F.col("k"))
    x = gd.cross_reference(cat, guide, width=9)
    assert x.filter("x_path is not null").count() == cat.count()
    assert x.filter("g_path is not null").count() == guide.count()
    assert rows(x.select("tag", "x_path", "g_path")) == rows(gd.cross_reference(cat, guide).select("tag", "x_path", "g_path"))


def test_similar_paths_against_brute_force(spark):
    rng = random.Random(3)
    path = lambda: "/".join([rng.choice("ab") for _ in range(rng.choice([3, 6, 6, 7]))] + [rng.choice(["T", "U"])])
    src, dst = sorted({path() for _ in range(60)}), sorted({path() for _ in range(60)})
    expect = []
    for s in src:
        if s in dst:
            continue
        sp, best = s.split("/"), None
        for d in dst:
            dp = d.split("/")
            if len(dp) == len(sp) and dp[-1] == sp[-1]:
                same = sum(x == y for x, y in zip(sp, dp))
                if same >= 0.7 * len(sp) and (best is None or (-same, d) < best):
                    best = (-same, d)
        if best:
            expect.append((s, best[1]))
    frame = lambda p: spark.createDataFrame([(x,) for x in p], "path string")
    got = mp.similar_path_map(frame(src), frame(dst)).select("source_path", "target_path")
    assert rows(got) == sorted(expect, key=str) and expect


def test_flatten_details(spark):
    xml = '<a:R xmlns:a="urn:x" id="1"><X> t </X><X><Y k="&lt;"/>z</X><!-- c --><Z/></a:R>'
    df = spark.createDataFrame([(1, xml), (2, "<R><X></R>"), (3, None)], "msg_id bigint, xml string")
    got = fl.flatten_xml(df)
    assert rows(got.filter("msg_id = 1").select("node_id", "path", "occ_path", "kind", "value")) == sorted([
        (0, "R", "R[1]", "element", None), (1, "R/@id", "R[1]/@id", "attribute", "1"), (2, "R/X", "R[1]/X[1]", "element", "t"), (3, "R/X", "R[1]/X[2]", "element", None),
        (4, "R/X/Y", "R[1]/X[2]/Y[1]", "element", None), (5, "R/X/Y/@k", "R[1]/X[2]/Y[1]/@k", "attribute", "<"), (6, "R/Z", "R[1]/Z[1]", "element", None)], key=str)
    assert {r.msg_id for r in fl.parse_guard(got)[1].collect()} == {2, 3}
    back = fl.rebuild_xml(fl.leaves(got).filter("msg_id = 1").withColumn("ord", F.col("node_id")), path="occ_path").first().xml
    assert back == '<R id="1"><X>t</X><X><Y k="&lt;"></Y></X></R>'


def test_message_diff_stops_below_a_mismatch(spark):
    a = "<R><A><B>1</B><C>x</C></A><D i='1'>t</D></R>"
    b = "<R><A2><B>2</B></A2><D i='2' j='3'>t</D><E><F/></E></R>"
    df = lambda x: fl.flatten_xml(spark.createDataFrame([(1, x)], "msg_id bigint, xml string"), pairing=True)
    got = rows(md.message_diff(df(a), df(b)).select("diff_type", "path", "left_value", "right_value"))
    assert got == sorted([("changed", "R/A", "A", "A2"), ("changed", "R/D/@i", "1", "2"), ("added", "R/D/@j", None, "3"), ("added", "R/E[3]", None, "<E>[F]</E>")], key=str)
    assert md.message_diff(df(a), df(a)).count() == 0


def test_message_diff_by_key_ignores_order(spark):
    tx = lambda i, v: f"<Tx><Id>{i}</Id><V>{v}</V></Tx>"
    df = lambda x: fl.flatten_xml(spark.createDataFrame([(1, f"<R>{x}</R>")], "msg_id bigint, xml string"), pairing=True)
    got = md.message_diff(df(tx("a/1", 1) + tx("b", 2)), df(tx("b", 2) + tx("a/1", 3) + tx("c", 4)), ignore_order=True)
    assert rows(got.select("diff_type", "path", "left_value", "right_value")) == [
        ("added", "R/Tx[Id=c]", None, "<Tx>[Id, V]</Tx>"), ("changed", "R/Tx/V", "1", "3")]


def test_amount_rules(spark):
    cases = {"": "empty", "abc": "not a valid", "1_000": "not a valid", "nan": "not a valid", "-1": "negative", "1.234": "decimal places", "5": None}
    data = [(i, f'<R><Amt Ccy="EUR">{v}</Amt></R>') for i, v in enumerate(cases)]
    got = {r.msg_id: r.message for r in vd.validate(spark.createDataFrame(data, "msg_id bigint, xml string")).collect()}
    for i, expected in enumerate(cases.values()):
        assert (expected is None) == (i not in got) and (expected is None or expected in got[i])


def test_either_or_rules(spark):
    for parent, children, *_ in fixed.EITHER_OR:
        both = f"<R><{parent}><{children[0]}/><{children[1]}/></{parent}><{parent}><{children[0]}/></{parent}></R>"
        found = vd.validate(spark.createDataFrame([(1, both)], "msg_id bigint, xml string")).filter("category = 'Business Rule'").collect()
        assert len(found) == 1 and found[0].element == parent


def test_word_diff_is_complete_and_counts_occurrences(spark):
    pairs = spark.createDataFrame([(1, 1, "a b a c", "a a a d"), (2, 1, None, "x")], "pair_id int, page_no int, a_text string, b_text string")
    got = rows(pg.word_diff(pairs).select("pair_id", "item", "tag", "a_pos", "b_pos"))
    assert got == sorted([(1, "a", "eq", 0, 0), (1, "a", "eq", 2, 1), (1, "a", "ins", None, 2), (1, "b", "del", 1, None), (1, "c", "del", 3, None),
                          (1, "d", "ins", None, 3), (2, "x", "ins", None, 0)], key=str)


def test_line_diff_keeps_duplicates(spark):
    pairs = spark.createDataFrame([(1, "x\nx\ny", "x\nz\nz")], "pair_id int, a_raw string, b_raw string")
    assert rows(pg.line_diff(pairs).select("side", "pos", "line", "tag")) == sorted([
        ("a", 0, "x", "eq"), ("a", 1, "x", "eq"), ("a", 2, "y", "del"), ("b", 1, "z", "ins"), ("b", 2, "z", "ins")], key=str)


def test_depth_path(spark):
    path = lambda *lines: one(spark, rc.depth_path(F.array(*[F.lit(x) for x in lines])))
    assert path("Root", "+A", "++B", "wrapped", "+C") == "Root/C"
    assert path("Root", "+A", "++B", "wrapped") == "Root/A/B wrapped"
    assert path("", "+A") == "A"


def test_business_notes_and_datasets(spark):
    note = one(spark, rc.business_note(F.lit("TYPO"), F.lit("Remittance length is now optional")))
    assert note.startswith(fixed.LOG_PREFIX["TYPO"]) and note.count("  ") == 3
    assert one(spark, rc.infer_dataset(F.lit("ds-06 reply"))) == fixed.DATASETS[4][1]
    assert one(spark, rc.infer_dataset(F.lit("nothing"))) == ""


def test_ranges_and_jaccard(spark):
    parsed = one(spark, lists.parse_ranges(F.lit("1-5, 8,x,7-")))
    assert [(r.part, r.first, r.last) for r in parsed] == [("1-5", 1, 5), ("8", 8, 8), ("x", None, None), ("7-", None, None)]
    arr = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    assert one(spark, lists.jaccard_pct(arr("a", "b"), arr("b", "c"))) == 33.3
    assert one(spark, lists.jaccard_pct(arr(), arr())) == 100.0 and one(spark, lists.jaccard_pct(arr("a"), arr())) == 0.0


def test_text_helpers(spark):
    assert one(spark, t.strip_ns(F.lit("{urn:x}Tag"))) == "Tag" and one(spark, t.strip_ns(F.lit("xs:string"))) == "string"
    assert one(spark, t.pointer_unescape(F.lit("~01"))) == "~1"
    assert one(spark, t.mult_differs(F.lit("0..unbounded"), F.lit("0 .. n"))) is False
    assert one(spark, t.pct(F.lit(0), F.lit(0))) == "0%"


def test_expand_paths_cycles(spark):
    edges = spark.createDataFrame([("A", "B", 0), ("B", "A", 0), ("B", "C", 1)], "parent string, child string, pos int")
    roots = spark.createDataFrame([("A", 0)], "node string, pos int")
    assert rows(tr.expand_paths(edges, roots).select("path")) == [("A",), ("A/B",), ("A/B/C",)]
    assert rows(tr.expand_paths(edges, roots, mode="circular").select("path", "circular")) == [
        ("A", False), ("A/B", False), ("A/B/A", True), ("A/B/C", False)]


def test_json_nested_too_deep_and_odd_keys(spark):
    df = spark.createDataFrame([(1, "[" * 100_000 + "]" * 100_000), (2, "[" * 100_000), (3, '{"[0]": 1, "a": [1, 2], "[x]": 2}'), (4, "[" * 300 + "]" * 300)], "d int, j string")
    nodes = tr.flatten_json(df, "d", "j")
    assert rows(nodes.filter("d < 3").select("d", "type")) == [(1, "invalid"), (2, "invalid")]
    assert nodes.filter("d = 4").count() == 299
    assert rows(tr.top_keys(nodes.filter("d = 3"))) == [("[0]", 1), ("[x]", 1), ("a", 1)]


def test_json_types(spark):
    df = spark.createDataFrame([(1, '{"a": [1, 2.5, true, null, "x"], "b": {}}'), (2, "5"), (3, "{bad")], "d int, j string")
    got = rows(tr.flatten_json(df, "d", "j").select("d", "path", "type", "value", "extra"))
    assert got == sorted([(1, "a", "array", "", "5 items"), (1, "a[0]", "integer", "1", ""), (1, "a[1]", "number", "2.5", ""), (1, "a[2]", "boolean", "True", ""),
                          (1, "a[3]", "null", "None", ""), (1, "a[4]", "string", "x", ""), (1, "b", "object", "", "0 keys"), (2, "root", "integer", "5", ""),
                          (3, "", "invalid", None, "")], key=str)
    assert rows(tr.root_rows(df, "d", "j")) == [(1, "a", "array"), (1, "b", "object"), (2, "root", "integer"), (3, "root", "invalid")]


def test_results_do_not_depend_on_partitions(spark, sf_dir):
    a, b = catalog(spark, sf_dir, "cat_v1"), catalog(spark, sf_dir, "cat_v2")
    run = lambda: rows(sd.changes_by_type(sd.schema_diff(a, b)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        single = run()
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        assert run() == single
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_json_values_are_whole_and_keys_keep_their_brackets(spark):
    from fieldlens.operators import trees

    long_ref = "#/components/schemas/" + "n" * 130
    docs = spark.createDataFrame([(1, '{"[0]": {"$ref": "%s"}, "a/b": [1]}' % long_ref), (2, "not json")], "doc_id long, text string")
    nodes = {(r["doc_id"], r["pointer"]): r["value"] for r in trees.flatten_json(docs, "doc_id", "text").collect()}
    assert nodes[1, "/[0]/$ref"] == long_ref and (1, "/a~1b/0") in nodes
    got = {(r["doc_id"], r["key"], r["type"]) for r in trees.root_rows(docs, "doc_id", "text").collect()}
    assert (2, "root", "invalid") in got and (1, "[0]", "object") in got


def test_damaged_archives_give_a_row(spark, tmp_path):
    import zipfile

    from fieldlens.sources.messages import read_archived

    with zipfile.ZipFile(tmp_path / "good.zip", "w") as zf:
        zf.writestr("m.xml", "<a/>")
    (tmp_path / "bad.zip").write_bytes(b"PK no archive")
    got = {(r["archive"], r["member"], r["content"]) for r in read_archived(spark, str(tmp_path)).collect()}
    assert got == {("good.zip", "m.xml", "<a/>"), ("bad.zip", None, None)}


def test_unique_names_are_given_out_once(spark):
    from fieldlens.plans import reports

    names = ["abcdefgh1", "abcdefgh2", "abcdefgh1", "abcdefgh2", "abcde_2", "abcde_3", "abcdefgh1", "x", "x", "abcde_2", "x"]
    df = spark.createDataFrame(list(enumerate(names)), "o int, name0 string")
    got = {r["o"]: r["name"] for r in reports.unique_names(df, "name0", "o", 8).collect()}
    assert len(got) == len(names) == len(set(got.values())) and got[0] == "abcdefgh" and got[4] == "abcde_2" and got[7] == "x" and got[8] == "x_2"


def test_repeated_xpath_counts_once(spark):
    from fieldlens.plans import compare

    cols = [*gd.SIDE_COLUMNS]
    made = lambda mults: spark.createDataFrame([("m", "A/B", k, *[m if c == "mult" else "" for c in cols]) for k, m in enumerate(mults)], "message string, xpath string, pos int, " + ", ".join(f"{c} string" for c in cols))
    got = compare.compare_guides(made(["0..1", "1..1"]), made(["9..9", "1..1"]))["Differences"].collect()
    assert [r["change"] for r in got] == ["UNCHANGED"]


def test_xsd_patterns(spark):
    cases = [(r"[\i-[:]][\c-[:]]*", "ab-1", True), (r"[\i-[:]][\c-[:]]*", ":a", False), (r"[A-Z]{2,3}", "AB", True), (r"[A-Z]{2,3}", "ABCD", False), (r"\p{L}+", "é", True),
             (r"([0-9]{2}(-[0-9]{2})?|x)", "12-34", True), (r"[^\s]+", "a b", False), (r"[+-]?\d+(\.\d+)?", "-1.5", True), (r"[a-z-[aeiou]]+", "bcd", True), (r"[a-z-[aeiou]]+", "bad", False)]
    df = spark.createDataFrame(cases, "p string, v string, ok boolean").withColumn("rx", vd.xsd_regex("p"))
    assert all(r["got"] == r["ok"] for r in df.select("p", "v", "ok", F.rlike("v", "rx").alias("got")).collect())
    bad = spark.createDataFrame([("[a-z",), ("(a",), ("*a",), (r"\q",), ("",), (None,), ("a{2",)], "p string")
    assert bad.where(vd.xsd_regex("p").isNotNull()).count() == 0


def test_more_than_a_thousand_labels(spark):
    from fieldlens.operators import records

    label = "Usage Rule" if "Usage Rule" in records.fixed.REQUIREMENT_LABELS else records.fixed.REQUIREMENT_LABELS[0]
    block = " ".join(f"{label} v{k}" for k in range(1500))
    rows = records.with_label_values(spark.createDataFrame([(block,)], "b string"), "b", "m").selectExpr("map_values(m) as v").collect()
    assert "v1499" in " ".join(rows[0]["v"])
