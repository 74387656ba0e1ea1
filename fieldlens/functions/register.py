"""SQL surface: the XML table function, scalar helpers as SQL functions, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.functions import udtf

from fieldlens.operators.flatten import NODE_FIELDS, _node_rows

_PLAIN = [(n, k) for n, k in NODE_FIELDS if n not in ("attrs", "child_tags", "head_tags")]
_INDEX = [i for i, (n, _) in enumerate(NODE_FIELDS) if n not in ("attrs", "child_tags", "head_tags")]


@udtf(returnType=", ".join(f"{n} {k}" for n, k in _PLAIN))
class FlattenXml:
    """``select * from messages, lateral fl_flatten_xml(xml)``"""

    def eval(self, xml: str):
        for row in _node_rows(xml, pairing=False, keep_ns=False):
            yield tuple(row[i] for i in _INDEX)


# name(arguments) -> SQL body; all of them run inside the JVM
SQL_FUNCTIONS = {
    "fl_collapse_ws(s string) returns string": r"trim(regexp_replace(coalesce(s, ''), '\\s+', ' '))",
    "fl_strip_ns(s string) returns string": r"regexp_replace(coalesce(s, ''), '^(\\{[^}]*\\}|[^:/{}]*:)', '')",
    "fl_last_segment(p string) returns string": "substring_index(p, '/', -1)",
    "fl_parent_path(p string) returns string": "regexp_replace(p, '/?[^/]*$', '')",
    "fl_depth(p string) returns int": "size(split(p, '/')) - 1",
    "fl_normalise_rule(s string) returns string": r"trim(regexp_replace(lower(coalesce(s, '')), '\\s+', ' '))",
    "fl_multiplicity(lo string, hi string) returns string": "concat(lo, '..', hi)",
    "fl_min_of(m string) returns string": "trim(split_part(trim(coalesce(m, '')), '..', 1))",
    "fl_pct(n bigint, total bigint) returns string": "case when total > 0 then format_string('%.1f%%', floor(n * 1000.0 / total + 0.5) / 10) else '0%' end",
    "fl_decimals(s string) returns int": "length(split_part(coalesce(s, ''), '.', 2))",
    "fl_path_similarity(p string, q string) returns double":
        "case when size(split(p, '/')) = size(split(q, '/')) then aggregate(zip_with(split(p, '/'), split(q, '/'), (x, y) -> if(x = y, 1, 0)), 0, (a, v) -> a + v) / size(split(p, '/')) else 0.0 end",
}


def register(spark: SparkSession) -> list[str]:
    """Register the table function and the SQL functions; returns their names."""
    spark.udtf.register("fl_flatten_xml", FlattenXml)
    names = ["fl_flatten_xml"]
    for signature, body in SQL_FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {signature} return {body}")
        names.append(signature.split("(", 1)[0])
    return names


def with_counters(df: DataFrame, name: str, **counters) -> tuple[DataFrame, Observation]:
    """Counts gathered while ``df`` runs: progress of a batch without an extra pass."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in counters.items()]), seen
