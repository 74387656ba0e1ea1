"""Message sources: files, archives, the known-shape parser and the packaged schema."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F


TASK_BYTES = 64 << 20  # of files that one task reads


def whole_files(spark: SparkSession, path: str | Sequence[str], glob: str, key: str | None = None) -> DataFrame:
    """(name, value): one row per file of a folder, glob or list.

    ``name`` is the file name, or with ``key`` the text behind ``key=`` in the file's folder, as ``write_texts`` lays files out.
    """
    files = (spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
             .text(path if isinstance(path, str) else list(path), wholetext=True))
    name = F.col("_metadata.file_name")
    if key is not None:
        folder = F.regexp_extract("_metadata.file_path", rf"/{re.escape(key)}=([^/]*)/[^/]*$", 1)
        # the path is a URI of a folder name that was escaped before: a plus sign stands for itself
        plain = F.url_decode(F.regexp_replace(F.url_decode(F.regexp_replace(folder, r"\+", "%2B")), r"\+", "%2B"))
        name = F.when(plain != "__HIVE_DEFAULT_PARTITION__", plain)
    # a task takes a few files however small they are: not more tasks than a shuffle has, or than the bytes ask for
    size = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    places = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES)
    return files.select(name.alias("name"), "value").coalesce(places)


def read_messages(spark: SparkSession, path: str | Sequence[str], glob: str = "*.xml", key: str | None = None) -> DataFrame:
    """One row per XML file of a folder, glob or list: (msg_id, xml); the id as in ``whole_files``."""
    return whole_files(spark, path, glob, key).toDF("msg_id", "xml")


def read_archived(spark: SparkSession, path: str, suffix: str = ".xml", glob: str = "*.zip") -> DataFrame:
    """Members of ZIP archives with a suffix: (archive, member, content); ``__MACOSX`` is skipped.

    A damaged archive or member gives a row with a null content (and a null member where none could be listed).
    """
    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch["archive"], batch["content"]):
                row = lambda member, text, archive=archive: pd.DataFrame({"archive": [archive], "member": [member], "content": [text]})
                try:
                    zf = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    yield row(None, None)
                    continue
                with zf:
                    # one frame per member: an archive is never held unpacked as a whole
                    for name in zf.namelist():
                        if name.endswith(suffix) and not name.startswith("__MACOSX"):
                            try:
                                text = zf.read(name).decode("utf-8", "replace")
                            except (zipfile.BadZipFile, zlib.error):
                                text = None
                            yield row(name, text)

    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
             .select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content"))
    return files.mapInPandas(members, "archive string, member string, content string")


def parse_known_shape(messages: DataFrame, shape: str, row_tag: str, xml: str = "xml") -> DataFrame:
    """JVM-side parse of messages whose shape is known: ``doc`` struct and ``well_formed`` flag."""
    schema = f"{shape}, _corrupt string"
    parsed = F.from_xml(F.col(xml), schema, {"rowTag": row_tag, "columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    # the one-element explode keeps the parse from being repeated for every field read from it
    return messages.select("*", F.explode(F.array(parsed)).alias("doc")).withColumn("well_formed", F.col("doc._corrupt").isNull())


def packaged_schema(spark: SparkSession) -> str:
    """Path of the example payment schema, shipped to every executor."""
    local = Path(__file__).resolve().parents[1] / "resources" / "payment.xsd"
    if spark.sparkContext.master.startswith("local"):
        return str(local)
    spark.sparkContext.addFile(str(local))
    return local.name
