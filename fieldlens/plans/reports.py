"""Report sinks: several sheets, JSON reports, message files, stacked reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from fieldlens.functions.text import safe_name


def stack_reports(reports: dict[str, DataFrame], name: str = "report") -> DataFrame:
    """Rows of several reports on top of each other with the report they belong to."""
    parts = [df.withColumn(name, F.lit(label)) for label, df in reports.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_report(sheets: dict[str, DataFrame], path: str, fmt: str = "parquet", partition_by: dict[str, list[str]] | None = None,
                 mode: str = "error") -> dict[str, str]:
    """One folder per sheet; returns sheet -> folder. Sheet names are made safe and unique."""
    used: dict[str, str] = {}
    for sheet, df in sheets.items():
        base = "".join("_" if c in '\\/*?:[]"<>|' else c for c in sheet).strip()[:31] or "sheet"
        name, n = base, 2
        while name in used.values():
            name, n = f"{base[:28]}_{n}", n + 1
        used[sheet] = name
        writer = df.write.mode(mode)
        if partition_by and sheet in partition_by:
            writer = writer.partitionBy(*partition_by[sheet])
        if fmt == "csv":
            writer.option("header", "true").csv(f"{path}/{name}")
        else:
            writer.format(fmt).save(f"{path}/{name}")
    return {sheet: f"{path}/{name}" for sheet, name in used.items()}


def json_report(summary: DataFrame, rows: DataFrame, key: str, name: str = "rows") -> DataFrame:
    """One JSON text per key: the summary columns and the rows belonging to it.

    The rows of one key end up in one JSON document, so ``key`` should be fine-grained
    (a message, a file); wide reports are written with ``write_report``.
    """
    fields = [c for c in rows.columns if c != key]
    nested = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    joined = summary.join(nested, key, "left")
    empty = F.from_json(F.lit("[]"), nested.schema[name].dataType.json())
    return joined.select(key, F.to_json(F.struct(*summary.columns, F.coalesce(name, empty).alias(name))).alias("json"))


def write_json_report(report: DataFrame, path: str, mode: str = "error") -> None:
    report.select("json").write.mode(mode).text(path)


def write_messages(messages: DataFrame, path: str, xml: str = "xml", mode: str = "error") -> None:
    """Rebuilt messages as text, one message per line; line breaks inside values become character references."""
    line = F.regexp_replace(F.trim(F.regexp_replace(xml, r"\?>\s+", "?>")), "\n", "&#10;")
    messages.select(F.regexp_replace(line, "\r", "&#13;").alias("value")).write.mode(mode).text(path)


def write_texts(texts: DataFrame, path: str, key: str, text: str, mode: str = "error") -> None:
    """One file per key, in a folder ``key=value`` of its own; whole texts, line breaks kept.

    Meant for texts that other tools expect as files; many small texts are better kept as rows. Rows of a key meet in one task, so
    that no task opens more files than it has keys; ``read_messages`` and the other file sources read them back with ``key``.
    """
    # it is the files that take time, not their bytes: without a number, little data would be written by one task
    places = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts.select(key, F.col(text).alias("value")).repartition(places, key).write.mode(mode).partitionBy(key).text(path)


def unique_names(names: DataFrame, column: str, order: str, maxlen: int = 31) -> DataFrame:
    """Safe names, each given out once: the first of a name keeps it, the others are numbered from 2 in order of appearance.

    Numbers run over all names with the same cut beginning and pass over those that a kept name already spells.
    """
    from fieldlens.operators import ordered

    base = names.withColumn("base", safe_name(column, maxlen)).withColumn("cut", F.left("base", F.lit(maxlen - 3)))
    numbered = ordered.row_number(base, ["base"], [order], "n")
    first, others = numbered.where("n = 1"), numbered.where("n > 1")
    parts = F.regexp_extract("base", r"^(.*)_([1-9][0-9]{0,8})$", 1), F.regexp_extract("base", r"^(.*)_([1-9][0-9]{0,8})$", 2).try_cast("int")
    # numbers that kept names spell, and how many free ones lie below each
    taken = first.select(parts[0].alias("cut"), parts[1].alias("k")).where("k >= 2").distinct().join(others.select("cut").distinct(), "cut", "left_semi")
    taken = taken.groupBy("cut").agg(F.array_sort(F.collect_set("k")).alias("taken"))
    ranked = ordered.row_number(others, ["cut"], [order], "r").join(taken, "cut", "left")
    number = F.aggregate(F.coalesce("taken", F.array().cast("array<int>")), (F.col("r") + 1).cast("long"), lambda acc, k: F.when(k <= acc, acc + 1).otherwise(acc))
    given = ranked.select(*names.columns, F.concat("cut", F.lit("_"), number.cast("string")).alias("name"))
    return first.select(*names.columns, F.col("base").alias("name")).unionByName(given)
