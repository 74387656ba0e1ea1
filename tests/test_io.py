"""Sources, sinks and streams on files."""

import json
import zipfile

from pyspark.sql import functions as F

from fieldlens.functions.register import with_counters
from fieldlens.operators import apispec as ap, trees as tr, xsd
from fieldlens.plans import batch, compare, reports
from fieldlens.queries.base import catalog
from fieldlens.sources import dimensions as dim, documents as docs, messages as src
from fieldlens.streaming import messages as sm


def test_messages_and_archives(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<R><MsgId>1</MsgId></R>")
    (tmp_path / "b.txt").write_text("no")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as zf:
        zf.writestr("x/c.xml", "<R/>")
        zf.writestr("__MACOSX/c.xml", "junk")
        zf.writestr("n.txt", "no")
    assert [tuple(r) for r in src.read_messages(spark, str(tmp_path)).collect()] == [("a.xml", "<R><MsgId>1</MsgId></R>")]
    assert [tuple(r) for r in src.read_archived(spark, str(tmp_path)).collect()] == [("z.zip", "x/c.xml", "<R/>")]


def test_json_and_yaml(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": [1]}')
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "b.yaml").write_text("k:\n  - 1\n  - x: y\n")
    got = {r.doc_id: r.ok for r in docs.read_json_docs(spark, str(tmp_path)).select("doc_id", F.col("doc").isNotNull().alias("ok")).collect()}
    assert got == {"a.json": True, "bad.json": False}
    yaml = docs.read_yaml_docs(spark, str(tmp_path))
    assert json.loads(yaml.first().json) == {"k": [1, {"x": "y"}]}
    assert tr.flatten_json(yaml, "doc_id", "json").count() == 4


def test_guides_inventory_and_schemas(spark, tmp_path):
    guide = spark.createDataFrame([("m", "1", "1..1", "A/B", "B", "B", "T", "", "", "", "", "", "", "yellow", 1), ("m", "2", "", " ", "", "", "", "", "", "", "", "", "", "", 2),
                                   ("Summary", "", "", "x", "", "", "", "", "", "", "", "", "", "", 3)], docs.GUIDE_SCHEMA)
    guide.write.parquet(str(tmp_path / "g"))
    guide.write.option("header", "true").csv(str(tmp_path / "c"))
    for fmt, folder in (("parquet", "g"), ("csv", "c")):
        assert [r.xpath for r in docs.read_guide(spark, str(tmp_path / folder), "A", fmt).collect()] == ["A/B"]
    lib = tmp_path / "lib" / "sub"
    lib.mkdir(parents=True)
    (lib / "s.xsd").write_text("<x/>" * 500)
    (lib / "README.md").write_text("no")
    (lib / ".hidden.xsd").write_text("no")
    inv = docs.file_inventory(spark, str(tmp_path / "lib")).collect()
    assert [(r.file, r.folder, r.ext, r.size_kb) for r in inv] == [("s.xsd", "sub", ".xsd", 2.0)]
    assert docs.read_schema_docs(spark, str(lib)).filter("schema_id = 's'").count() == 1


def test_dimensions(spark, tmp_path):
    path = tmp_path / "codes.json"
    path.write_text(json.dumps({"definitions": {"A1": {"enum": ["x", "y"]}, "B": {"type": "string"}}}))
    assert sorted(map(tuple, dim.read_code_sets(spark, str(path)).collect())) == [("A1", 0, "x"), ("A1", 1, "y")]
    assert dim.read_code_sets(spark, str(tmp_path / "missing.json")).count() == 0
    party = {"name": "N", "iban": "I", "bic": "B", "country": "DE", "address": {"street": "S", "city": "C", "postal_code": "P"}}
    prof = tmp_path / "p.json"
    prof.write_text(json.dumps({"profiles": {"one": {"description": "d", "debtor": party, "creditor": party, "amount": {"min": 1, "max": 2, "currency": "EUR"}, "charge_bearer": "SLEV"}}}))
    row = dim.read_profiles(spark, str(prof)).first()
    assert (row.name, row.debtor_city, row.amount_max, row.charge_bearer) == ("one", "C", 2.0, "SLEV")
    assert dim.read_profiles(spark).first().name == "domestic_sepa"
    assert dim.read_profiles(spark).columns == dim.read_profiles(spark, str(prof)).columns


def test_reports(spark, sf_dir, tmp_path):
    sheets = compare.compare_schemas(catalog(spark, sf_dir, "cat_v1"), catalog(spark, sf_dir, "cat_v2"))
    wanted = {k: sheets[k] for k in ("Summary", "Severity", "Side by Side")}
    placed = reports.write_report(wanted, str(tmp_path / "r"))
    assert spark.read.parquet(placed["Side by Side"]).count() == 211
    both = reports.write_report({"a/b": wanted["Summary"], "a?b": wanted["Severity"]}, str(tmp_path / "q"), fmt="csv")
    assert both["a/b"] != both["a?b"]
    msgs = spark.createDataFrame([("m1", "<R><Amt>x</Amt></R>"), ("m2", "<R/>")], "msg_id string, xml string")
    result = batch.validate_batch(msgs)
    report = reports.json_report(result["Results"], result["Issues"], "msg_id", "issues")
    reports.write_json_report(report, str(tmp_path / "j"))
    found = {json.loads(r.value)["msg_id"]: json.loads(r.value) for r in spark.read.text(str(tmp_path / "j")).collect()}
    assert len(found["m1"]["issues"]) == 2 and found["m2"]["valid"] is True and found["m2"]["issues"] == []
    reports.write_messages(msgs, str(tmp_path / "x"))
    assert spark.read.text(str(tmp_path / "x")).count() == 2
    reports.write_messages(spark.createDataFrame([("<?xml version='1.0'?>\n<R>a\n  b</R>",)], "xml string"), str(tmp_path / "y"))
    assert [r.value for r in spark.read.text(str(tmp_path / "y")).collect()] == ["<?xml version='1.0'?><R>a&#10;  b</R>"]


def test_documents_compare(spark):
    xs = 'xmlns:xs="http://www.w3.org/2001/XMLSchema"'
    doc = lambda t, n: f'<xs:schema {xs}><xs:element name="D" type="T"/><xs:complexType name="T"><xs:sequence><xs:element name="A" type="{t}"/>{n}</xs:sequence></xs:complexType><xs:simpleType name="S1"><xs:restriction base="xs:string"><xs:maxLength value="3"/></xs:restriction></xs:simpleType><xs:simpleType name="S2"><xs:restriction base="S1"><xs:maxLength value="4"/></xs:restriction></xs:simpleType></xs:schema>'
    df = spark.createDataFrame([("a", doc("S1", "")), ("b", doc("S2", '<xs:element name="N" type="T"/>'))], "schema_id string, text string")
    sheets = compare.compare_documents(df, "a", "b")
    kinds = {r.path: r.change_type for r in sheets["All Differences"].filter("change_type in ('ADDED', 'TYPE_CHANGED')").collect()}
    assert kinds["D/A"] == "TYPE_CHANGED" and kinds["D/N"] == "ADDED"
    assert sheets["Type Restrictions"].filter("restriction = 'maxLength'").first().new_value == "4"
    # the element of its own type is opened again once, then its path repeats
    cat = xsd.expand_catalog(xsd.schema_nodes(df.filter("schema_id = 'b'")), on_repeat="circular")
    assert cat.filter("circular").count() >= 1


def test_counters(spark):
    df, seen = with_counters(spark.range(10), "progress", even=F.col("id") % 2 == 0)
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 10, "even": 5}


def test_stream_of_files(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "a.xml").write_text('<R><Amt Ccy="EUR">x</Amt></R>')
    (landing / "b.xml").write_text("<R>")
    stream = sm.validate_stream(sm.message_stream(spark, str(landing)))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    sm.run_available(stream, out, state)
    (landing / "c.xml").write_text("<R><RmtInf><Ustrd/><Strd/></RmtInf></R>")
    sm.run_available(stream, out, state)
    got = sorted((r.msg_id, r.category) for r in spark.read.schema(stream.schema).parquet(out).collect())
    assert got == [("a.xml", "Amount Validation"), ("b.xml", "XML Parsing"), ("c.xml", "Business Rule")]


def test_api_properties_replaced_by_the_referrer(spark):
    text = json.dumps({"paths": {}, "components": {"schemas": {"A": {"$ref": "#/components/schemas/B", "properties": {"own": {"type": "string"}}}, "B": {"type": "object", "properties": {"theirs": {"type": "string"}}}}}})
    spec = ap.spec_nodes(tr.flatten_json(spark.createDataFrame([(1, text)], "doc_id int, json string"), "doc_id", "json", raw=True))
    root = spark.createDataFrame([(1, "/components/schemas/A")], "doc_id int, schema string")
    assert [r.full_path for r in ap.walk_schema(spec, root).collect()] == ["own"]
