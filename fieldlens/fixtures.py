"""Test inputs as SQL over the given tables, written so that Spark and DuckDB run the same text.

``oracle(names, body)`` prefixes a query with the fixtures it needs; ``frame(spark, sf_dir, name)``
gives the fixture as a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# name -> (what it reads, SQL)
FIXTURES: dict[str, tuple[tuple[str, ...], str]] = {}


def define(name: str, needs: tuple[str, ...], sql: str) -> None:
    FIXTURES[name] = (needs, sql.strip())


define("cat_v1", ("part",), """
select 'v1' as schema_id, cast(p_partkey + 1 as int) as seq,
  concat('Document/', p_type, '/', replace(p_brand, '#', '_'), '/G', cast(p_partkey as string), '/F', cast(p_partkey % 50 as string)) as path,
  concat('F', cast(p_partkey % 50 as string)) as tag, 'element' as node_type,
  case when p_size % 3 = 0 then 'Max35Text' when p_size % 3 = 1 then 'Amount' else 'ISODate' end as type,
  cast(p_size % 2 as string) as min_occurs,
  case when p_partkey % 7 = 0 then 'unbounded' else '1' end as max_occurs,
  case when p_partkey % 11 = 0 then 'X' else '' end as fixed, '' as dflt,
  concat('maxLength: ', cast(p_size as string)) as restrictions,
  case when p_partkey % 3 = 0 then 'YELLOW' when p_partkey % 3 = 1 then 'WHITE' else 'NA' end as field_class,
  case when p_partkey % 4 = 0 then concat('AT-', cast(p_partkey % 40 as string)) else '' end as rulebook,
  case when p_partkey % 5 = 0 then p_name else '' end as usage_rules,
  case when p_size % 3 = 0 then 'CODA,CODB,CODC' else '' end as enums,
  p_partkey as k
from part
""")

define("cat_v2", ("cat_v1",), """
select 'v2' as schema_id, seq, path, tag, node_type,
  case when k % 13 = 0 then 'Max70Text' else type end as type,
  case when k % 9 = 0 then case when min_occurs = '0' then '1' else '0' end else min_occurs end as min_occurs,
  case when k % 14 = 0 then '5' else max_occurs end as max_occurs,
  case when k % 22 = 0 then 'Y' else fixed end as fixed,
  case when k % 23 = 0 then '1' else dflt end as dflt,
  case when k % 10 = 0 then concat(restrictions, '0') else restrictions end as restrictions,
  case when k % 8 <> 0 then field_class when field_class = 'YELLOW' then 'WHITE' when field_class = 'WHITE' then 'NA' else 'YELLOW' end as field_class,
  case when k % 12 = 0 then '' else rulebook end as rulebook,
  case when k % 15 = 0 then 'changed rule' else usage_rules end as usage_rules,
  case when k % 6 = 0 and enums <> '' then 'CODA,CODD' else enums end as enums, k
from cat_v1 where k % 17 <> 0
union all
select 'v2', cast(seq + 1000000 as int), concat(path, '/New'), 'New', node_type, type, '0', '1', '', '', '', 'NA', '', '', '', k
from cat_v1 where k % 19 = 0
""")

define("cat_v3", ("cat_v2",), """
select 'v3' as schema_id, seq, path, tag, node_type, type, min_occurs, max_occurs, fixed, dflt, restrictions,
  case when k % 16 = 0 then 'YELLOW' else field_class end as field_class, rulebook, usage_rules, enums, k
from cat_v2 where k % 29 <> 0
""")

define("cat_all", ("cat_v1", "cat_v2", "cat_v3"), """
select * from cat_v1 union all select * from cat_v2 union all select * from cat_v3
""")

# facets of the named types, one table per schema version
define("type_facets", ("part",), """
select 'v1' as schema_id, t as type_name, f as facet, v as value from (
  select distinct case when p_size % 3 = 0 then 'Max35Text' when p_size % 3 = 1 then 'Amount' else 'ISODate' end as t from part) x
join (
  select 'Max35Text' as tn, 'maxLength' as f, '35' as v union all select 'Max35Text', 'minLength', '1'
  union all select 'Amount', 'fractionDigits', '5' union all select 'Amount', 'totalDigits', '18'
  union all select 'Amount', 'minInclusive', '0' union all select 'ISODate', 'pattern', 'd4') y on t = tn
union all
select 'v2', t, f, v from (
  select distinct case when p_partkey % 13 = 0 then 'Max70Text' when p_size % 3 = 0 then 'Max35Text' when p_size % 3 = 1 then 'Amount' else 'ISODate' end as t from part) x
join (
  select 'Max70Text' as tn, 'maxLength' as f, '70' as v union all select 'Max70Text', 'minLength', '1'
  union all select 'Max35Text', 'maxLength', '35' union all select 'Max35Text', 'minLength', '1'
  union all select 'Amount', 'fractionDigits', '2' union all select 'Amount', 'totalDigits', '18'
  union all select 'ISODate', 'pattern', 'd4') y on t = tn
""")

define("guide_a", ("cat_v1",), """
select 'A' as scheme, concat('msg_', cast(k % 4 as string)) as message, concat('1.', cast(seq as string)) as idx,
  concat(min_occurs, '..', case when max_occurs = 'unbounded' then 'n' else max_occurs end) as mult,
  path as xpath, tag, type, restrictions as length, usage_rules as usage_rule, rulebook, '' as format_rule, enums as code_restrictions,
  case when field_class = 'YELLOW' then 'yellow' when k % 10 = 7 then 'red' else 'white' end as row_color, k
from cat_v1
""")

define("guide_b", ("guide_a",), """
select 'B' as scheme, message, idx, case when k % 9 = 0 then '0..n' else mult end as mult, xpath, tag, type,
  case when k % 10 = 0 then concat(length, '0') else length end as length,
  case when k % 15 = 0 then upper(concat('  ', usage_rule, ' ')) else usage_rule end as usage_rule,
  rulebook, case when k % 26 = 0 then 'digits only' else format_rule end as format_rule, code_restrictions,
  case when k % 8 = 0 then case when row_color = 'yellow' then 'white' else 'yellow' end else row_color end as row_color, k
from guide_a where k % 21 <> 0
union all
select 'B', message, idx, mult, concat(xpath, '/Extra'), 'Extra', type, length, usage_rule, rulebook, format_rule, code_restrictions, 'white', k
from guide_a where k % 18 = 0
""")

define("msg_leaf", ("orders", "customer"), """
select o_orderkey as msg_id, 1 as ord, 'Document/GrpHdr/MsgId' as path, concat('MSG', cast(o_orderkey as string)) as value from orders
union all select o_orderkey, 2, 'Document/GrpHdr/MsgId', concat('DUP', cast(o_orderkey as string)) from orders where o_orderkey % 53 = 0
union all select o_orderkey, 3, 'Document/GrpHdr/CreDtTm', concat(substring(cast(o_orderdate as string), 1, 10), case when o_orderkey % 41 = 0 then '' else 'T00:00:00' end) from orders
union all select o_orderkey, 4, 'Document/GrpHdr/NbOfTxs', '1' from orders
union all select o_orderkey, 5, 'Document/CdtTrfTxInf/IntrBkSttlmAmt',
  case when o_orderkey % 43 = 0 then 'n/a' when o_orderkey % 47 = 0 then concat('-', cast(cast(o_totalprice as decimal(18, 2)) as string))
       when o_orderkey % 59 = 0 then concat(cast(cast(o_totalprice as decimal(18, 2)) as string), '5') else cast(cast(o_totalprice as decimal(18, 2)) as string) end from orders
union all select o_orderkey, 6, 'Document/CdtTrfTxInf/IntrBkSttlmAmt/@Ccy', case when o_orderkey % 61 = 0 then 'euro' else 'EUR' end from orders where o_orderkey % 67 <> 0
union all select o_orderkey, 7, 'Document/CdtTrfTxInf/DbtrAgt/FinInstnId/BICFI', case when o_orderkey % 31 = 0 then 'BAD' else 'DEUTDEFF' end from orders
union all select o_orderkey, 8, 'Document/CdtTrfTxInf/DbtrAgt/FinInstnId/LEI', '529900T8BM49AURSDO55' from orders where o_orderkey % 37 = 0
union all select o.o_orderkey, 9, 'Document/CdtTrfTxInf/Dbtr/Nm', c.c_name from orders o join customer c on o.o_custkey = c.c_custkey
union all select o_orderkey, 10, 'Document/CdtTrfTxInf/DbtrAcct/Id/IBAN', case when o_orderkey % 29 = 0 then 'DE8' else 'DE89370400440532013000' end from orders
union all select o_orderkey, 11, 'Document/CdtTrfTxInf/RmtInf/Ustrd', o_orderpriority from orders
union all select o_orderkey, 12, 'Document/CdtTrfTxInf/RmtInf/Strd/Ref', o_orderstatus from orders where o_orderkey % 71 = 0
""")

# catalog of those messages, and a later version of it
define("msg_paths", ("msg_leaf",), """
with leaf as (select path, min(ord) as seq from msg_leaf where ord <> 6 group by path),
up1 as (select regexp_replace(path, '/[^/]*$', '') as path, seq from leaf), up2 as (select regexp_replace(path, '/[^/]*$', '') as path, seq from up1),
up3 as (select regexp_replace(path, '/[^/]*$', '') as path, seq from up2), up4 as (select regexp_replace(path, '/[^/]*$', '') as path, seq from up3)
select path, cast(min(seq) as int) as seq from (select * from leaf union all select * from up1 union all select * from up2 union all select * from up3 union all select * from up4) p group by path
""")

define("msg_target", ("msg_paths",), """
select path, seq * 10 + length(path) - length(replace(path, '/', '')) as seq, case when path like '%/LEI' or path like '%/Strd%' or path like '%/Dbtr/Nm' then '0' else '1' end as min_occurs
from msg_paths where path not like '%/BICFI' and path not like '%/Ustrd' and path not like '%/NbOfTxs'
union all select 'Document/CdtTrfTxInf/RmtInf/Txt', 118, '0' union all select 'Document/CdtTrfTxInf/ChrgBr', 97, '1'
union all select 'Document/CdtTrfTxInf/DbtrAgt/FinInstnId/BIC', 70, '0' union all select 'Document/GrpHdr/Nb', 45, '1' union all select 'Document/CdtTrfTxInf/Purp', 150, '0'
union all select 'Document/CdtTrfTxInf/Purp/Cd', 151, '1'
""")

# the same messages as a later system would send them: some fields changed, dropped or added
define("msg_leaf_b", ("msg_leaf",), """
select msg_id, ord, path, case when ord = 10 and msg_id % 5 = 0 then 'FR7630006000011234567890189'
    when ord = 11 and msg_id % 6 = 0 then concat('  ', value, ' ') when ord = 6 and msg_id % 7 = 0 then 'USD' else value end as value
from msg_leaf where not (ord = 3 and msg_id % 8 = 0) and not (ord = 6 and msg_id % 9 = 0)
union all select msg_id, 13, 'Document/CdtTrfTxInf/Purp/Cd', 'SALA' from msg_leaf where ord = 1 and msg_id % 10 = 0
""")

define("conv_rows", ("conversations",), """
select conv_id, cast(turn as int) as row_no, role = 'user' as is_start, role, text from conversations
""")

# order lines numbered 1, 2, 3 .. within their order
define("numbered_lines", ("lineitem",), """
select l_orderkey, l_partkey, l_suppkey, l_quantity, l_returnflag,
  cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as int) as l_linenumber
from lineitem
""")

# seven lines of an order make a record, further lines the next one (rec_key: order, then record of the order)
define("record_lines", ("numbered_lines",), """
select l_orderkey, l_partkey, l_suppkey, l_quantity, l_returnflag,
  cast(l_orderkey as bigint) * 10 + cast(floor((l_linenumber - 1) / 7) as bigint) as rec_key, cast((l_linenumber - 1) % 7 + 1 as int) as line
from numbered_lines
""")

# four-column guide rows of the records; 100 orders make a document
define("guide_cells", ("record_lines",), r"""
select l_orderkey - l_orderkey % 100 as doc_id, cast(rec_key % 1000 as int) * 10 + line as row_no, rec_key, line,
  case when line = 1 then concat('1.', cast(l_orderkey % 100 as string)) else '' end as c0, case when line in (1, 7) then '0..1' else '' end as c1,
  case line when 1 then 'Root Message' when 2 then '+Group Header' when 3 then '++Settlement' when 4 then 'Information' when 5 then '+Credit Transfer' when 6 then '++Amount' else '+++Code' end as c2,
  case line when 1 then concat('XML Tag T', cast(l_partkey % 10 as string), ' Type Max35Text') when 2 then concat('SEPA Length 1 .. ', cast(l_suppkey as string))
    when 3 then concat('SEPA Usage Rule(s) Mandatory for ', cast(l_suppkey as string)) when 4 then 'continued text' when 5 then concat('ISO Name Nm', cast(l_partkey % 7 as string))
    when 6 then 'NPC Rulebook AT-01' else 'xs:choice' end as c3,
  case l_returnflag when 'R' then 'red' when 'A' then 'yellow' else 'white' end as colour
from record_lines
""")

# change-log rows: the first line of a record is a numbered entry, the others continue it or name a dataset
define("log_rows", ("record_lines",), """
select l_orderkey - l_orderkey % 100 as doc_id, rec_key * 10 + line as row_no, rec_key, line, l_quantity > 25 as marks,
  case line when 1 then cast(l_orderkey % 100 + 1 as string) when 3 then case when l_quantity > 25 then 'DS-05 Recall' else 'N' end when 4 then 'more text' when 5 then 'No.' when 7 then 'Note' else '' end as c0,
  case line when 1 then concat('S', cast(l_suppkey as string)) when 5 then 'Section' else '' end as c1,
  case line when 1 then case when l_partkey % 4 = 0 then 'pacs.008' else 'El' end when 5 then 'Element' else '' end as c2,
  case line when 1 then concat('length rule ', l_returnflag, '  ', cast(l_partkey as string)) when 2 then 'and the uetr' when 5 then 'Description' else '' end as c3,
  case when line <> 1 then '' when l_orderkey % 200 < 100 then 'ACC' else case l_returnflag when 'A' then 'chan' when 'R' then 'CLAR' else 'odd' end end as c4,
  case when line <> 1 or l_orderkey % 200 >= 100 then '' else case l_returnflag when 'A' then 'chan' when 'R' then 'CLAR' else 'odd' end end as c5
from record_lines
""")

define("files", ("pages",), """
select concat('page_', cast(page_id as string), case when page_id % 7 = 0 then '.exe' when page_id % 5 = 0 then '.XSD' when page_id % 3 = 0 then '.xml' else '.json' end) as file,
  case when page_id % 4 = 0 then 'lib' when page_id % 4 = 1 then 'lib/a' when page_id % 4 = 2 then 'lib/a/b' else 'lib/c' end as folder,
  cast(case when page_id % 31 = 0 then 0 when page_id % 29 = 0 then 60000000 else length(html) end as bigint) as size,
  cast(page_id as bigint) as age_hours, page_id % 3 as batch
from pages
""")

define("code_dim", ("nation", "region"), """
select r_name as code_set, cast(n_nationkey as int) as pos, n_name as code from nation join region on n_regionkey = r_regionkey
""")

define("edges", ("region", "nation", "customer", "orders"), """
select concat('R', cast(n_regionkey as string)) as parent, concat('N', cast(n_nationkey as string)) as child, cast(n_nationkey as bigint) as pos from nation
union all select concat('N', cast(c_nationkey as string)), concat('C', cast(c_custkey as string)), c_custkey from customer
union all select concat('C', cast(o_custkey as string)), concat('O', cast(o_orderkey as string)), o_orderkey from orders
""")


def _closure(names: tuple[str, ...]) -> list[str]:
    seen: list[str] = []

    def visit(name: str) -> None:
        if name in seen:
            return
        for need in FIXTURES[name][0] if name in FIXTURES else ():
            visit(need)
        seen.append(name)

    for name in names:
        visit(name)
    return seen


def oracle(names: str | tuple[str, ...], body: str) -> str:
    """DuckDB text: the fixtures the body reads, then the body."""
    names = (names,) if isinstance(names, str) else names
    parts = [f"{n} as ({FIXTURES[n][1]})" for n in _closure(names) if n in FIXTURES]
    body = body.strip()
    if not parts:
        return body
    if body.lower().startswith("with "):
        return "with " + ",\n".join(parts) + ",\n" + body[5:]
    return "with " + ",\n".join(parts) + "\n" + body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture (or a stored table) as a DataFrame."""
    if name not in FIXTURES:
        return table(spark, sf_dir, name)
    parts = [
        f"{n} as ({FIXTURES[n][1]})" if n in FIXTURES
        else f"{n} as (select * from parquet.`{sf_dir}/{n}.parquet`)"
        for n in _closure((name,))
    ]
    return spark.sql("with " + ",\n".join(parts) + f"\nselect * from {name}")
