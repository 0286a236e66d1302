"""One row of each group of near-duplicates, whatever the ids: a row is known by its place in its file."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import stored

PLACE = ("__file", "__row")


def placed(df: DataFrame) -> DataFrame:
    """``df`` with the columns PLACE. Rows that do not come from files are written first."""
    try:
        return df.withColumns({"__file": F.xxhash64("_metadata.file_path"), "__row": F.col("_metadata.row_index")})
    except AnalysisException:
        return placed(stored(df, "rows"))


def first_of(id_col: str) -> Column:
    """The aggregate (none, id, PLACE) of the row with the smallest id (null last), then by place."""
    return F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), *PLACE))


def firsts(docs: DataFrame, key: str, id_col: str) -> DataFrame:
    """``key``, ``none`` and ``first`` from ``docs``: of the rows with an id (or, ``none``, of those without) the
    one with the smallest id, then by place."""
    return docs.groupBy(key, F.col(id_col).isNull().alias("none")).agg(first_of(id_col).alias("first"))


def one_of_each(own: DataFrame, each: DataFrame, roots: DataFrame, key: str, null_apart: bool = False) -> DataFrame:
    """The rows of ``own`` (see :func:`placed`) that stay: one for each component of ``roots(node, root)`` and for
    each key of ``each`` (see :func:`firsts`) that has none. With ``null_apart`` rows without id are chosen from
    apart, so that a group can keep one such row beside the one with an id."""
    named = roots.select(F.col("node").alias(key), "root")
    grouped = each.join(named, key, "left").select(F.col("root").isNull().alias("alone"), F.coalesce("root", key).alias("root"), "none", "first")
    kept = grouped.groupBy("alone", "root", *(["none"] if null_apart else [])).agg(F.min("first").alias("first"))
    return own.join(kept.select(*(F.col(f"first.{c}") for c in PLACE)), list(PLACE), "left_semi").drop(*PLACE)
