"""Schema patterns: read for checking and for drawing texts, against the regular expressions of Python; rules as tables; retention."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fieldlens.operators import patterns as pt, validate as vd
from fieldlens.streaming import messages as sm

READ = ["[A-Z]{3}[0-9]{2}", "[0-9]{5}-[0-9]{3}", "[A-Z]{2}[0-9]{4}", r"\d{2,4}", "((((a))))", "(((ab)+c){2})?d", "a|bc|[x-z]{2}", r"[a-z-[aeiou]]{5}", r"[^a-zA-Z]{3}",
        r"\p{Lu}\p{Nd}{3}", r"\+[0-9]{1,3}-[0-9()+\-]{1,30}", "[A-Z]{6,6}[A-Z2-9][A-NP-Z0-9]([A-Z0-9]{3,3}){0,1}", "x*y+z?", r"[\w.]{4}", "", "   ", "(((((((((a{2}){2}))))))))b"]
UNREADABLE = ["(", ")", "a{", "[", "[]", "a{3,1}", "(?=a)", "*a", r"\q", "a**"]


@pytest.mark.parametrize("pattern", READ + UNREADABLE)
def test_translation(spark, pattern):
    made = vd.translate_pattern(pattern)
    assert (made is None) == (pattern in UNREADABLE or not pattern.strip())
    if made:  # the engine takes it
        spark.range(1).select(F.lit("a").rlike(f"^(?:{made})$")).collect()


def test_texts_match_their_patterns(spark):
    rows = [(k, p) for k, p in enumerate(READ + UNREADABLE)]
    catalog = spark.createDataFrame(rows, "k int, pattern string").withColumn("tokens", pt.pattern_tokens("pattern")).withColumn("regex", vd.xsd_regex("pattern"))
    catalog = catalog.cache()
    assert {r["pattern"] for r in catalog.filter("tokens is null").collect()} == {p for p in READ + UNREADABLE if p in UNREADABLE or not p.strip()}
    drawn = catalog.filter("tokens is not null").crossJoin(spark.range(40)).withColumn("v", pt.draw("tokens", "k, id", "null", "null"))
    assert drawn.filter(~F.rlike("v", "regex")).count() == 0
    found = {r["pattern"]: r["n"] for r in drawn.groupBy("pattern").agg(F.count_distinct("v").alias("n")).collect()}
    assert found["[0-9]{5}-[0-9]{3}"] > 30 and found["((((a))))"] == 1 and found["a|bc|[x-z]{2}"] > 3
    assert all(re.fullmatch("[A-Z]{3}[0-9]{2}", r["v"]) for r in drawn.filter("pattern = '[A-Z]{3}[0-9]{2}'").collect())
    short = spark.createDataFrame([("a{1,9}",)], "pattern string").withColumn("tokens", pt.pattern_tokens("pattern"))
    assert [len(short.select(pt.draw("tokens", "1", *o).alias("v")).first()["v"]) for o in (("null", "3"), ("7", "20"))] == [1, 9]


def test_unreadable_patterns_are_warnings(spark):
    nodes = spark.createDataFrame([(1, "R/A", "A", "element", "a", {}, [], 1, 1)], "msg_id int, path string, tag string, kind string, value string, attrs map<string,string>, child_tags array<string>, tag_occ int, tag_total int")
    none = F.lit(None).cast("string")
    cat = lambda p: spark.createDataFrame([("R/A", "A", "1", p)], "path string, tag string, min_occurs string, pattern string").select(
        "*", F.array().cast("array<string>").alias("enums"), *[none.alias(c) for c in ("min_length", "max_length", "min_value", "max_value", "total_digits", "fraction_digits")])
    found = lambda p: [(r["severity"], r["category"]) for r in vd.validate_catalog(nodes, cat(p)).collect()]
    assert found("((((a))))") == [] and found("((((b))))") == [("ERROR", "Pattern Mismatch")] and found("(?=a)") == [("WARNING", "Pattern Not Checked")]


def test_default_rule_tables_give_the_built_in_issues(spark):
    bad = ("<D><RmtInf><Ustrd>a</Ustrd><Strd/></RmtInf><Amt Ccy='eur'>1.234</Amt><Amt/><InstdAmt>-5</InstdAmt><IBAN>x</IBAN><MsgId>1</MsgId><MsgId>2</MsgId>"
           "<FinInstnId><BICFI>DEUTDEFF</BICFI><LEI>1</LEI></FinInstnId><Ctry>Germany</Ctry></D>")
    df = spark.createDataFrame([(1, bad), (2, "<D"), (3, "<D/>"), (4, None)], "msg_id long, xml string")
    key = lambda d: sorted(map(str, d.collect()))
    assert key(vd.validate_by_tables(df, vd.default_rules(spark))) == key(vd.validate(df))
    only = {"single": spark.createDataFrame([("MsgId",), (None,)], "tag string")}
    assert [r["category"] for r in vd.validate_by_tables(df.filter("msg_id = 1"), only).collect()] == ["Cardinality"]


def test_kept_rows_against_a_loop(spark):
    rng = random.Random(2)
    data = [(n, rng.choice(["a", "a", "b", None]), rng.choice([None] + list(range(300)))) for n in range(400)]
    df = spark.createDataFrame(data, "n int, k string, s int").select("n", "k", F.timestamp_seconds("s").alias("ts"))
    want, last = [], {}
    for n, k, s in sorted((r for r in data if r[2] is not None), key=lambda r: (r[2], r[0])):
        if k not in last or s >= last[k] + 20:
            want.append(n)
            last[k] = s
    assert sorted(r["n"] for r in sm.keep_first(df, ["k"], "ts", 20).collect()) == sorted(want)
    assert sorted(r["n"] for r in sm.dedupe_stream(df, ["k"], "ts", "20 seconds").collect()) == sorted(want)
    assert sm.keep_first(df.limit(0), ["k"], "ts", 20).count() == 0
