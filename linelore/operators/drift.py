"""Schemas that drift between files: what each file of a stream holds, and what changed from file to file.

JSON-lines files carry no footer, so the footer is made first: for each file the paths of its records, with their JSON
type and how often they occur, counted in one aggregation over all lines. From this catalogue (its size is files times
fields, not rows) follow the lifespans of each shape of a field, the changes between neighbouring files, and the casts
that read every file into one table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linelore.session import cut_lineage

# Logical field -> spellings of its key in the files, as regular expressions over the path. Fixed values of the format.
ALIASES: dict[str, Sequence[str]] = {
    "session_scope": ("session_scope", "sessionScope", "session", "scope", "context\\.scope", "[a-z]+_session"),
    "empty_result": ("empty_result", "emptyResult", "empty_output", "is_empty", "no_output", "result\\.empty"),
    "delta_ref": ("delta_ref", "deltaRef", "delta_base", "baseline_ref", "diff_against", "refs\\.delta"),
}

MAX_PATHS = 10_000  # of the aliased fields; more means that the alias table is wrong


def logical_field(path: Column, aliases: dict[str, Sequence[str]]) -> Column:
    """The field that a path spells, null for none."""
    out = F.lit(None).cast("string")
    for field, spellings in reversed(list(aliases.items())):
        out = F.when(path.rlike("^(?:" + "|".join(spellings) + ")$"), F.lit(field)).otherwise(out)
    return out


def readable(raw: Column) -> Column:
    """The record of a line as VARIANT; null for a line that isn't one JSON object."""
    v = F.try_parse_json(raw)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def json_type(schema: Column) -> Column:
    """string, number, boolean, array or object from a VARIANT schema; null for a JSON null."""
    return (
        F.when(schema == "STRING", "string")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema.startswith("OBJECT"), "object")
        .when(schema != "VOID", "number")
    )


def footer_catalogue(lines: DataFrame) -> DataFrame:
    """``origin, file_no, file_name, path, type, n_records`` of every file; one row with null path says that the file exists.

    Nested objects give one path per inner key, two levels deep. JSON nulls, unreadable lines and lines that aren't
    objects add nothing. ``lines`` needs ``origin, file_no, file_name, raw_line``; other columns are ignored.
    """
    spark = lines.sparkSession
    src = lines.select("origin", "file_no", "file_name", readable(F.col("raw_line")).alias("v"))
    inner = "CASE WHEN startswith(schema_of_variant({0}), 'OBJECT') THEN {0} END"
    fields = spark.sql(
        f"""SELECT origin, file_no, file_name, concat_ws('.', a.key, b.key, c.key) AS path,
                   schema_of_variant(coalesce(c.value, b.value, a.value)) AS kind
            FROM {{src}} s, LATERAL variant_explode_outer(s.v) a,
                 LATERAL variant_explode_outer({inner.format('a.value')}) b,
                 LATERAL variant_explode_outer({inner.format('b.value')}) c""",
        src=src,
    )
    fields = fields.withColumn("type", json_type(F.col("kind")))
    fields = fields.withColumn("path", F.when(F.col("type").isNotNull() & (F.col("path") != ""), F.col("path")))
    return fields.groupBy("origin", "file_no", "file_name", "path", F.when(F.col("path").isNotNull(), F.col("type")).alias("type")).agg(F.count("*").alias("n_records"))


def file_shapes(catalogue: DataFrame, aliases: dict[str, Sequence[str]] = ALIASES) -> DataFrame:
    """The shape of each field in each file: the path and type that most of its records with a value have.

    Paths without alias are fields of their own. Between shapes that are equally frequent the smaller path, then the
    smaller type counts.
    """
    c = catalogue.where("path is not null").withColumn("field", F.coalesce(logical_field(F.col("path"), aliases), F.col("path")))
    best = F.min(F.struct((-F.col("n_records")).alias("n"), "path", "type")).alias("s")
    return c.groupBy("origin", "file_no", "file_name", "field").agg(best).select("origin", "file_no", "file_name", "field", "s.path", "s.type", (-F.col("s.n")).alias("n_records"))


def _files(catalogue: DataFrame) -> DataFrame:
    files = catalogue.select("origin", "file_no", "file_name").distinct()
    w = Window.partitionBy("origin").orderBy("file_no", "file_name")
    return files.withColumn("ord", F.row_number().over(w)).withColumn("n_files", F.count("*").over(Window.partitionBy("origin")))


def lifespans(catalogue: DataFrame, aliases: dict[str, Sequence[str]] = ALIASES) -> DataFrame:
    """Islands: ``origin, field, path, type, first_ord, last_ord, n_files`` – the files between which a field kept one shape."""
    s = file_shapes(catalogue, aliases).join(_files(catalogue), ["origin", "file_no", "file_name"])
    w = Window.partitionBy("origin", "field").orderBy("ord")
    same = (F.lag("path").over(w) == F.col("path")) & (F.lag("type").over(w) == F.col("type")) & (F.lag("ord").over(w) == F.col("ord") - 1)
    s = s.withColumn("starts", F.when(same, 0).otherwise(1)).withColumn("island", F.sum("starts").over(w))
    return s.groupBy("origin", "field", "island").agg(
        F.first("path").alias("path"), F.first("type").alias("type"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.first("n_files").alias("n_files")
    ).drop("island")


def schema_changes(lines: DataFrame, aliases: dict[str, Sequence[str]] = ALIASES, only: Sequence[str] | None = None) -> DataFrame:
    """``origin, file_name, field, change, before, after``: every change of a field between a file and the one before it.

    ``change`` is added, removed, renamed or retyped (two rows if key and type both change). The first file of an origin
    changes nothing. Blank, corrupt and doubled lines, JSON nulls and files without any readable record are allowed; a
    file in which no record has a field lacks it.
    """
    cat = cut_lineage(footer_catalogue(lines))  # small; what follows reads it several times
    files = _files(cat)
    life = lifespans(cat, aliases)
    if only is not None:
        life = life.where(F.col("field").isin(*only))
    w = Window.partitionBy("origin", "field").orderBy("first_ord")
    life = life.withColumns({f"prev_{c}": F.lag(c).over(w) for c in ("path", "type", "last_ord")}).withColumn("next_ord", F.lead("first_ord").over(w))
    shape = lambda p, t: F.concat_ws(":", p, t)
    touching = F.col("prev_last_ord") == F.col("first_ord") - 1
    log = F.array(
        F.when((F.col("first_ord") > 1) & ~F.coalesce(touching, F.lit(False)), F.struct(F.col("first_ord").alias("ord"), F.lit("added").alias("change"))),
        F.when(touching & (F.col("prev_path") != F.col("path")), F.struct(F.col("first_ord").alias("ord"), F.lit("renamed").alias("change"))),
        F.when(touching & (F.col("prev_type") != F.col("type")), F.struct(F.col("first_ord").alias("ord"), F.lit("retyped").alias("change"))),
        F.when(
            (F.col("last_ord") < F.col("n_files")) & ~F.coalesce(F.col("next_ord") == F.col("last_ord") + 1, F.lit(False)),
            F.struct((F.col("last_ord") + 1).alias("ord"), F.lit("removed").alias("change")),
        ),
    )
    now, was = shape(F.col("path"), F.col("type")), shape(F.col("prev_path"), F.col("prev_type"))
    rows = life.select("origin", "field", now.alias("now"), was.alias("was"), F.explode(F.array_compact(log)).alias("e"))
    rows = rows.select(
        "origin",
        F.col("e.ord").alias("ord"),
        "field",
        F.col("e.change").alias("change"),
        F.when(F.col("e.change") == "removed", F.col("now")).when(F.col("e.change") != "added", F.col("was")).alias("before"),
        F.when(F.col("e.change") != "removed", F.col("now")).alias("after"),
    )
    return rows.join(files.select("origin", "ord", "file_name"), ["origin", "ord"]).select("origin", "file_name", "field", "change", "before", "after")


def _cast(v: Column, path: str, target: str) -> Column:
    """The value at ``path`` in the type of the target field; of a list its first element counts."""
    p = "$." + path
    text = F.coalesce(F.try_variant_get(v, p + "[0]", "string"), F.try_variant_get(v, p, "string"))
    if target == "empty_result":
        return F.lower(text).isin("true", "1")
    if target == "delta_ref":  # a number holds the reference's twelve hexadecimal digits
        whole = F.try_variant_get(v, p, "bigint")
        return F.when(F.schema_of_variant(F.try_variant_get(v, p, "variant")) == "BIGINT", F.lower(F.lpad(F.hex(whole), 12, "0"))).otherwise(text)
    return text


def unified_records(lines: DataFrame, aliases: dict[str, Sequence[str]] = ALIASES) -> DataFrame:
    """One table of all readable records with the aliased fields in one type each, whatever the file calls them.

    ``line_id, origin, file_name, file_no, line_no, timestamp, command, profile, cwd, exit_code, raw_bytes,
    filtered_bytes`` and the fields of the alias table: strings, and ``empty_result`` as boolean. A record that doesn't
    state ``empty_result`` has it from ``filtered_bytes``. The casts are generated from the catalogue's paths and types
    of the aliased fields, which are few (more than MAX_PATHS is an error).
    """
    cat = footer_catalogue(lines).withColumn("field", logical_field(F.col("path"), aliases)).where("field is not null")
    found = cat.select("field", "path", "type").distinct().orderBy("field", "path", "type").limit(MAX_PATHS + 1).collect()
    if len(found) > MAX_PATHS:
        raise ValueError(f"more than {MAX_PATHS} spellings of the aliased fields")
    v = F.col("v")
    out = {}
    for field in aliases:
        casts = [_cast(v, path, field) for path in dict.fromkeys(r.path for r in found if r.field == field)]
        out[field] = F.coalesce(*casts) if casts else F.lit(None).cast("boolean" if field == "empty_result" else "string")
    if "empty_result" in out:
        out["empty_result"] = F.coalesce(out["empty_result"], F.try_variant_get(v, "$.filtered_bytes", "bigint") == 0)
    rows = lines.select("line_id", "origin", "file_name", "file_no", "line_no", readable(F.col("raw_line")).alias("v")).where("v is not null")
    plain = {"timestamp": "timestamp", "command": "string", "profile": "string", "cwd": "string", "exit_code": "int", "raw_bytes": "bigint", "filtered_bytes": "bigint"}
    return rows.select(
        "line_id", "origin", "file_name", "file_no", "line_no",
        *[F.try_variant_get(v, "$." + k, t).alias(k) for k, t in plain.items()],
        *[c.alias(k) for k, c in out.items()],
    )


LINES_SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (("line_id", T.LongType()), ("origin", T.StringType()), ("file_name", T.StringType()), ("file_no", T.IntegerType()), ("line_no", T.IntegerType()), ("raw_line", T.StringType()))]
)
