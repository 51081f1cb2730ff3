"""Directory spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def directory(c: Column) -> Column:
    """One spelling per directory: doubled slashes, ``.`` segments and trailing slashes removed.

    Null and empty give null. ``/`` stays ``/``. Only the oddly spelled rows pay for the rewrite.
    """
    odd = c.rlike(r"//|/\.(/|$)|^\./|./$")
    short = F.regexp_replace(F.regexp_replace(c, r"^(\./+)+", ""), r"(/\.?)+(?=/|$)", "")
    short = F.when((short == "") & c.startswith("/"), F.lit("/")).otherwise(short)
    out = F.when(odd, short).otherwise(c)
    return F.when(out != "", out)


DIRECTORY_SQL = """CASE WHEN {c} IS NULL OR {c} = '' THEN NULL ELSE
  CASE WHEN starts_with({c}, '/') THEN '/' ELSE '' END
  || array_to_string(list_filter(string_split({c}, '/'), lambda s: s <> '' AND s <> '.'), '/') END"""


def directory_sql(c: str) -> str:
    """The same rule for DuckDB."""
    return DIRECTORY_SQL.format(c=c)
