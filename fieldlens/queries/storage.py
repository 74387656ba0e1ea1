"""Sources and sinks: written to the shared folder from the given tables, read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlens import fixtures as fx
from fieldlens.functions.register import with_counters
from fieldlens.operators import flatten as fl, trees as tr, xsd
from fieldlens.plans import reports
from fieldlens.registry import Group
from fieldlens.session import scratch_folder
from fieldlens.sources import dimensions as dim, documents as docs, messages as src

GROUP = Group()
TXT = "*.txt"


@GROUP.add("message_files", """
select 'S+' || s_suppkey || '/%' as msg_id, p as path, case p when 'Document/Id' then cast(s_suppkey as varchar) when 'Document/Nm' then concat(s_name, chr(10), 'line <2> & more') else 'EUR' end as value
from supplier cross join (select unnest(['Document/Id', 'Document/Nm', 'Document/Amt/@Ccy']) as p)""")
def message_files(spark, sf_dir):
    """A message per supplier as a file, read back by name; outer blanks (trimmed by the parser), line breaks and signs of file names included."""
    folder = scratch_folder(spark, "message_files")
    name = F.concat(F.lit("  "), "s_name", F.lit("\nline &lt;2&gt; &amp; more"))
    xml = F.concat(F.lit("<?xml version='1.0'?>\n<Document><Id>"), F.col("s_suppkey").cast("string"), F.lit("</Id><Nm>"), name, F.lit("</Nm><Amt Ccy=\"EUR\"/></Document>"))
    messages = fx.table(spark, sf_dir, "supplier").select(F.concat(F.lit("S+"), F.col("s_suppkey").cast("string"), F.lit("/%")).alias("msg_id"), xml.alias("xml"))
    reports.write_texts(messages, folder, "msg_id", "xml")
    nodes = fl.flatten_xml(src.read_messages(spark, folder, TXT, "msg_id"))
    return nodes.filter("kind = 'attribute' or tag in ('Id', 'Nm')").select("msg_id", "path", "value")


@GROUP.add("message_lines", "select s_suppkey as id, concat('a', chr(10), 'b ', s_name) as nm from supplier")
def message_lines(spark, sf_dir):
    """Rebuilt messages as one line each: line breaks of values come back from their character references."""
    folder = scratch_folder(spark, "message_lines")
    xml = F.concat(F.lit("<?xml version='1.0'?>\n<D><Id>"), F.col("s_suppkey").cast("string"), F.lit("</Id><Nm>a\nb "), F.col("s_name"), F.lit("</Nm></D>"))
    reports.write_messages(fx.table(spark, sf_dir, "supplier").select(xml.alias("xml")), folder)
    back = src.parse_known_shape(spark.read.text(folder).withColumnRenamed("value", "xml"), "Id bigint, Nm string", "D")
    return back.select(F.col("doc.Id").alias("id"), F.col("doc.Nm").alias("nm"))


@GROUP.add("schema_files", """
select p_brand as schema_id, concat('F', p_partkey) as element, concat('Max', p_size, 'Text') as type from part""")
def schema_files(spark, sf_dir):
    """A schema document per brand, its parts as elements."""
    folder = scratch_folder(spark, "schema_files")
    element = F.concat(F.lit('<xs:element name="F'), F.col("p_partkey").cast("string"), F.lit('" type="Max'), F.col("p_size").cast("string"), F.lit('Text"/>'))
    head, foot = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:complexType name="T"><xs:sequence>', "</xs:sequence></xs:complexType></xs:schema>"
    texts = fx.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.concat(F.lit(head), F.array_join(F.collect_list(element), "\n"), F.lit(foot)).alias("text"))
    reports.write_texts(texts, folder, "p_brand", "text")
    nodes = xsd.schema_nodes(docs.read_schema_docs(spark, folder, TXT, "p_brand"))
    return nodes.filter("tag = 'element'").select("schema_id", xsd.attr("name").alias("element"), xsd.attr("type").alias("type"))


@GROUP.add("guide_files", fx.oracle("guide_a", """
select fmt, 'SEPA' as scheme, message, xpath, mult, usage_rule, row_color from guide_a cross join (select unnest(['csv', 'parquet']) as fmt)"""))
def guide_files(spark, sf_dir):
    """Extracted guide sheets as CSV and Parquet; the summary and rows without an xpath are left out."""
    rows = fx.frame(spark, sf_dir, "guide_a")
    sheet = spark.createDataFrame([], docs.GUIDE_SCHEMA)
    own = rows.select(*[c for c in rows.columns if c in sheet.columns], F.col("k").cast("bigint").alias("pos"))
    noise = own.withColumn("xpath", F.lit(" ")).unionByName(own.withColumn("message", F.lit("Summary")))
    sheets = sheet.unionByName(own.unionByName(noise), allowMissingColumns=True)
    folder = scratch_folder(spark, "guide_files")
    back = []
    for fmt in ("csv", "parquet"):
        placed = reports.write_report({"Guide": sheets}, f"{folder}/{fmt}", fmt)["Guide"]
        back.append(docs.read_guide(spark, placed, "SEPA", fmt).withColumn("fmt", F.lit(fmt)))
    return back[0].unionByName(back[1]).select("fmt", "scheme", "message", "xpath", "mult", F.coalesce("usage_rule", F.lit("")).alias("usage_rule"), "row_color")


@GROUP.add("document_files", """
select fmt, cast(s_suppkey as varchar) as doc_id, p as path, case p when 'id' then cast(s_suppkey as varchar) when 'ok' then 'True' when 'tags[0]' then s_name else 'x: y' end as value
from supplier cross join (select unnest(['id', 'ok', 'tags[0]', 'tags[1]']) as p) cross join (select unnest(['json', 'yaml']) as fmt)
union all select 'bad', cast(s_suppkey as varchar), 'root', 'invalid' from supplier where s_suppkey % 10 = 0""")
def document_files(spark, sf_dir):
    """JSON and YAML documents as files, unreadable ones told apart."""
    folder, supplier = scratch_folder(spark, "document_files"), fx.table(spark, sf_dir, "supplier").withColumn("id", F.col("s_suppkey").cast("string"))
    json = F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.lit(True).alias("ok"), F.array("s_name", F.lit("x: y")).alias("tags")))
    yaml = F.concat(F.lit("# one\nid: "), "id", F.lit("\nok: yes\ntags:\n  - "), F.concat(F.lit('"'), "s_name", F.lit('"')), F.lit("\n  - 'x: y'\n"))
    reports.write_texts(supplier.select("id", json.alias("t")), f"{folder}/json", "id", "t")
    reports.write_texts(supplier.select("id", yaml.alias("t")), f"{folder}/yaml", "id", "t")
    reports.write_texts(supplier.filter("s_suppkey % 10 = 0").select("id", F.lit('{"a": [').alias("t")), f"{folder}/bad", "id", "t")
    read = docs.read_json_docs(spark, f"{folder}/json", TXT, "id").withColumn("fmt", F.lit("json")).unionByName(
        docs.read_yaml_docs(spark, f"{folder}/yaml", TXT, "id").withColumn("fmt", F.lit("yaml")))
    leaves = [tr.flatten_json(read.filter(F.col("fmt") == f), "doc_id", "json").filter("child_count = 0").select(F.lit(f).alias("fmt"), "doc_id", "path", "value") for f in ("json", "yaml")]
    bad = docs.read_json_docs(spark, f"{folder}/bad", TXT, "id").filter("doc is null")
    return leaves[0].unionByName(leaves[1]).unionByName(bad.select(F.lit("bad").alias("fmt"), "doc_id", F.lit("root").alias("path"), F.lit("invalid").alias("value")))


@GROUP.add("code_set_files", """
select p_brand as code_set, cast(row_number() over (partition by p_brand order by p_type) - 1 as int) as pos, p_type as code from (select distinct p_brand, p_type from part)""")
def code_set_files(spark, sf_dir):
    """Code sets as ``definitions`` of JSON files, one file per brand."""
    folder = scratch_folder(spark, "code_set_files")
    sets = fx.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("enum"))
    text = F.to_json(F.struct(F.map_from_arrays(F.array("p_brand", F.lit("plain")), F.array(F.struct("enum"), F.struct(F.lit(None).cast("array<string>").alias("enum")))).alias("definitions")))
    reports.write_texts(sets.select("p_brand", text.alias("text")), folder, "p_brand", "text")
    return dim.read_code_sets(spark, folder)


@GROUP.add("profile_files", """
select c_mktsegment as name, c_mktsegment || ' debtor' as debtor_name, 'DE' as debtor_country, min(c_acctbal)::double as amount_min, max(c_acctbal)::double as amount_max, 'SLEV' as charge_bearer from customer group by 1
union all select 'domestic_sepa', 'Test Debtor', 'DE', 10.0, 50000.0, 'SLEV'""")
def profile_files(spark, sf_dir):
    """Profiles of a JSON file, beside the one used when no file is given."""
    folder = scratch_folder(spark, "profile_files")
    seg = fx.table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.min("c_acctbal").cast("double").alias("min"), F.max("c_acctbal").cast("double").alias("max"))
    debtor = F.struct(F.concat("c_mktsegment", F.lit(" debtor")).alias("name"), F.lit("DE").alias("country"))
    profile = F.struct(debtor.alias("debtor"), F.struct("min", "max", F.lit("EUR").alias("currency")).alias("amount"), F.lit("SLEV").alias("charge_bearer"))
    # one file names all profiles, as many as there are market segments
    seg.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", profile))).alias("profiles"))).alias("value")).write.text(folder)
    columns = ("name", "debtor_name", "debtor_country", "amount_min", "amount_max", "charge_bearer")
    return dim.read_profiles(spark, folder).unionByName(dim.read_profiles(spark)).select(*columns)


@GROUP.add("report_files", """
select 'Cust/Sheet' as sheet, c_mktsegment as part, count(*) as n from customer group by 2
union all select 'Cust?Sheet', c_mktsegment, count(*) filter (c_acctbal < 0) from customer group by 2
union all select 'counters', 'rows', count(*) from customer union all select 'counters', 'negative', count(*) filter (c_acctbal < 0) from customer""")
def report_files(spark, sf_dir):
    """Two sheets whose names are made the same, partitioned, and the counters observed while the first is written."""
    folder, customer = scratch_folder(spark, "report_files"), fx.table(spark, sf_dir, "customer")
    counted, seen = with_counters(customer, "written", negative=F.col("c_acctbal") < 0)
    placed = reports.write_report({"Cust/Sheet": counted, "Cust?Sheet": customer.filter("c_acctbal < 0")}, folder, partition_by={"Cust/Sheet": ["c_mktsegment"]})
    parts = [spark.read.parquet(f).groupBy(F.col("c_mktsegment").alias("part")).agg(F.count("*").alias("n")).withColumn("sheet", F.lit(s)) for s, f in placed.items()]
    every = customer.select(F.col("c_mktsegment").alias("part")).distinct().withColumn("sheet", F.lit("Cust?Sheet"))
    second = every.join(parts[1], ["sheet", "part"], "left").fillna(0, ["n"])
    counters = spark.createDataFrame([("counters", k, v) for k, v in seen.get.items()], "sheet string, part string, n bigint")
    return parts[0].select("sheet", "part", "n").unionByName(second.select("sheet", "part", "n")).unionByName(counters)


@GROUP.add("json_report_files", """
select o_orderkey, o_orderstatus as status, count(l_orderkey) as n_lines, coalesce(sum(l_quantity), 0)::double as quantity from orders left join lineitem on l_orderkey = o_orderkey group by 1, 2""")
def json_report_files(spark, sf_dir):
    """A nested JSON document per order, read back; an order without lines keeps an empty list."""
    folder = scratch_folder(spark, "json_report_files")
    lines = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_quantity").cast("double").alias("quantity"))
    report = reports.json_report(fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), lines, "o_orderkey", "lines")
    reports.write_json_report(report, folder)
    back = spark.read.schema("o_orderkey bigint, o_orderstatus string, lines array<struct<l_linenumber: bigint, quantity: double>>").json(folder)
    total = F.aggregate("lines", F.lit(0.0), lambda acc, x: acc + x["quantity"])
    return back.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.size("lines").cast("bigint").alias("n_lines"), total.alias("quantity"))
