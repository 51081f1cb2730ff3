"""The reducers of tool output over DataFrames: one Arrow pass, no shuffle."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from linelore.operators import route
from linelore.reducers import structured as S
from linelore.reducers.tools import reduced


def reduce_texts(df: DataFrame, text: str, profile: str, exit_code: str, command: str | None = None, most: int = 12) -> DataFrame:
    """Adds ``reduced``: each text by the reducer of its profile; null and empty texts give an empty one."""

    @F.pandas_udf(Ty.StringType())
    def f(t: pd.Series, p: pd.Series, e: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([reduced(a, b, 0 if x is None or x != x else int(x), most, d or "") for a, b, x, d in zip(t, p, e, c)], dtype=object)

    return df.withColumn("reduced", f(F.col(text), F.col(profile), F.col(exit_code), F.col(command) if command else F.lit("")))


def reduce_by_content(df: DataFrame, text: str, hint: str | None = None, most: int = 12) -> DataFrame:
    """Adds ``reduced`` for texts that come without a command: by a named profile, or by what they look like."""
    return reduce_texts(df.withColumn("__p", F.lit(hint or "generic-summary")).withColumn("__e", F.lit(0)), text, "__p", "__e", None, most).drop("__p", "__e")


def reduce_commands(df: DataFrame, text: str, command: str, exit_code: str, most: int = 12) -> DataFrame:
    """Adds ``profile`` (by the command's words) and ``reduced``."""
    d = df.withColumn("profile", route.profile(route.shell_words(F.col(command))))
    return reduce_texts(d, text, "profile", exit_code, command, most)


def _json(f, most: int):
    @F.pandas_udf(Ty.StringType())
    def udf(t: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            v = S.parsed(x) if x else S._NONE
            return None if v is S._NONE else "\n".join(f(v, most))

        return pd.Series([one(x) for x in t], dtype=object)

    return udf


def json_structure(df: DataFrame, text: str, most: int = 40) -> DataFrame:
    """Adds ``structure``: keys and types of a JSON value, four levels deep; null for anything else."""
    return df.withColumn("structure", _json(S.structure, most)(F.col(text)))


def json_preview(df: DataFrame, text: str, most: int = 8) -> DataFrame:
    """Adds ``preview``: a JSON value as paths with values; null for anything else."""
    return df.withColumn("preview", _json(S.preview, most)(F.col(text)))


def json_table(df: DataFrame, text: str, most: int = 12) -> DataFrame:
    """Adds ``table``: a JSON array of like objects as a table, other values as a preview; null for anything else."""
    return df.withColumn("table", _json(S.json_value, most)(F.col(text)))
