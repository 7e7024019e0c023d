"""Texts that look the same but differ in characters (problem 3): confusables skeletons."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deedloom.llm.chars import FEW, confusables, skeleton


def skeleton_of(c: Column, table: dict[int, str]) -> Column:
    """The skeleton of a text; null stays null, empty and white-space-only text gives ''."""
    run = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else skeleton(x, table)), T.StringType())
    return run(c)


def reads_in(text: str | None, part: str | None, table: dict[int, str] = FEW) -> bool:
    """The part reads the same as some stretch of the text. Null reads nowhere, and neither does a blank part."""
    if text is None or part is None:
        return False
    whole, piece = skeleton(text, table), skeleton(part, table)
    at = whole.find(piece) if piece else -1
    while at >= 0:
        after = whole[at + len(piece) : at + len(piece) + 1]
        if not (after and unicodedata.combining(after)):  # an accent belongs to the letter before it
            return True
        at = whole.find(piece, at + 1)
    return False


def lookalike_passages(passages: DataFrame, texts: DataFrame, keys: list[str], passage: str, text: str) -> DataFrame:
    """Passages that aren't literally in the text with the same keys, but read the same as a part of it.

    One equality join; literal containment, which settles most pairs, is tested in the JVM, and only what remains goes
    to Python. Null keys, passages and texts match nothing. The result has the columns of ``passages`` but for the
    passage itself, each row once; extra columns of ``texts`` are dropped before the join, so names can't clash.
    """
    t = texts.select(*keys, F.col(text).alias("__text")).where("__text is not null")
    p = passages.where(F.col(passage).isNotNull())
    met = p.join(t, keys).where(~F.contains("__text", F.col(passage)))
    table = confusables(passages.sparkSession)
    same = F.pandas_udf(lambda a, b: pd.Series([reads_in(x, y, table) for x, y in zip(a, b)], dtype=bool), T.BooleanType())
    return met.where(same("__text", F.col(passage))).drop("__text", passage).distinct()


def skeleton_groups(df: DataFrame, column: str, by: tuple[str, ...] = (), once: tuple[str, ...] = ()) -> DataFrame:
    """(skeleton, form, n_rows, n_forms): every form of the values that share a skeleton with another form. With ``by``,
    the columns that tell where a form stands come first and rows are counted for each; groups reach over all of them.
    Rows with equal ``once`` and ``by`` and the same value count once. Nulls are left out.

    Skeletons are made once; digests find the forms that may have others (digests of skeletons that meet by chance do no
    harm), and only those values are grouped. The group itself is only counted, never collected.
    """
    from deedloom.session import cut_lineage

    rows = df.where(F.col(column).isNotNull()).select(*by, *once, F.col(column).alias("form"))
    table = confusables(df.sparkSession)
    pairs = rows.select(F.md5("form").alias("f"), F.xxhash64(skeleton_of(F.col("form"), table)).alias("h"))
    pairs = cut_lineage(pairs.distinct())
    several = pairs.groupBy("h").agg(F.min("f").alias("a"), F.max("f").alias("b")).where("a <> b")
    hits = pairs.join(several, "h", "left_semi").select("f")
    odd = cut_lineage(rows.withColumn("f", F.md5("form")).join(hits, "f", "left_semi").drop("f"))
    forms = (odd.distinct() if once else odd).groupBy(*by, "form").agg(F.count("*").alias("n_rows"))
    marked = forms.withColumn("skeleton", skeleton_of(F.col("form"), table))
    sizes = marked.groupBy("skeleton").agg(F.count_distinct("form").alias("n_forms")).where("n_forms > 1")
    return marked.join(sizes, "skeleton").select(*by, "skeleton", "form", "n_rows", "n_forms")
