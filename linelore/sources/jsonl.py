"""JSON-lines files: histories, indexes, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linelore.schema import RECORD

MAX_LINE_BYTES = 1 << 20
MAX_COMMAND_BYTES = 8 << 10


def raw_lines(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False, modified_after: str | None = None) -> DataFrame:
    """``file_path, line``: every line of the files below a path."""
    r = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if glob:
        r = r.option("pathGlobFilter", glob)
    if modified_after:
        r = r.option("modifiedAfter", modified_after)
    return r.text(path).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("line"))


def decode(lines: DataFrame, schema: T.StructType = RECORD, max_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """Adds the record's fields and ``status``: ok, blank, oversized or corrupt. Bad lines are counted, never fatal."""
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    j = F.from_json("line", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    status = F.when(F.coalesce(F.trim("line"), F.lit("")) == "", "blank").when(F.octet_length("line") > max_bytes, "oversized").when(j["_bad"].isNotNull() | ~F.trim("line").startswith("{"), "corrupt").otherwise("ok")
    return lines.withColumn("j", j).select(*lines.columns, status.alias("status"), *[F.col(f"j.{f.name}").alias(f.name) for f in schema.fields])


def clip_bytes(c: Column, most: int) -> Column:
    """The longest beginning of a text that has at most so many bytes of UTF-8 and ends with a whole character."""
    b = c.cast("binary")
    part = lambda k: F.try_validate_utf8(F.substring(b, 1, most - k).cast("string"))
    return F.when(F.octet_length(c) > most, F.coalesce(*[part(k) for k in range(4)])).otherwise(c)


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The records of history files, and how many lines of each status there were.

    Commands above eight KiB are cut on reading too; such lines have the status ``repaired``. Lines above the limit of a line
    are read as well as any other, and counted as ``oversized``.
    """
    d = decode(raw_lines(spark, path))
    long = F.octet_length("command") > MAX_COMMAND_BYTES
    d = d.withColumn("status", F.when((F.col("status") == "ok") & long, "repaired").otherwise(F.col("status"))).withColumn("command", clip_bytes(F.col("command"), MAX_COMMAND_BYTES))
    return d.where("status in ('ok', 'oversized', 'repaired')").drop("line", "status"), d.groupBy("status").agg(F.count("*").alias("n"))


def append_records(records: DataFrame, path: str) -> None:
    """Appends records as JSON lines; commands are cut to eight KiB."""
    records.withColumn("command", clip_bytes(F.col("command"), MAX_COMMAND_BYTES)).write.mode("append").json(path)


def numbered_lines(files: DataFrame) -> DataFrame:
    """``file_path, line_no, line`` of whole files (``file_path, text``): the place within the file, from 1, whatever tasks read it."""
    return files.select("file_path", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("file_path", (F.col("p") + 1).cast("bigint").alias("line_no"), "line")


def transcripts(spark: SparkSession, root: str, modified_after: str | None = None) -> DataFrame:
    """``file_path, line_no, v``: the lines of agent transcripts below a root as VARIANT; unreadable ones are left out.

    A transcript (one session's file) is read whole by one task, so that its lines are numbered by their place in it.
    """
    r = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("wholetext", "true")
    if modified_after:
        r = r.option("modifiedAfter", modified_after)
    t = numbered_lines(r.text(root).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text")))
    return t.select("file_path", "line_no", F.try_parse_json("line").alias("v")).where("v is not null")


def tool_blocks(lines: DataFrame) -> DataFrame:
    """``file, seq, kind, id, payload``: the tool uses and results in transcripts, for pairing; ``seq`` is line and place in it."""
    spark = lines.sparkSession
    e = spark.sql(
        """SELECT file_path AS file, struct(line_no, b.pos AS pos) AS seq, try_variant_get(b.value, '$.type', 'string') AS type,
                  coalesce(try_variant_get(b.value, '$.id', 'string'), try_variant_get(b.value, '$.tool_use_id', 'string')) AS id,
                  coalesce(try_variant_get(b.value, '$.input.command', 'string'), try_variant_get(b.value, '$.content[0].text', 'string'), try_variant_get(b.value, '$.content', 'string')) AS payload
           FROM {lines} l, LATERAL variant_explode(try_variant_get(l.v, '$.message.content', 'variant')) b""",
        lines=lines,
    )
    return e.where("type in ('tool_use', 'tool_result') and id is not null").select("file", "seq", F.when(F.col("type") == "tool_use", "use").otherwise("result").alias("kind"), "id", "payload")
