"""Corpus-wide grounding: which passages stand in which texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deedloom.functions.unicode import evidence

#: A passage table up to so many rows is broadcast; larger ones go through a shuffled join.
BROADCAST_ROWS = 10_000


def grounded(texts: DataFrame, passages: DataFrame, n: int = 5) -> DataFrame:
    """(text_id, passage_id): folded containment of passages (passage_id, passage) in texts (text_id, text).

    Words inside a passage, all but its first and last, have to stand whole in the text; so the ``n`` words after the
    first one are an equality key. Texts emit their distinct word runs and meet the keys in a hash join; the containment
    is then tested for the few that meet. Passages with fewer than ``n`` + 2 words have no such key and are compared by
    their rarest way, a nested loop against the (checked, small) set of short passages. Null texts or passages match
    nothing; a passage that folds to nothing stands in every text.
    """
    p = passages.select("passage_id", evidence(F.col("passage")).alias("needle")).where("needle is not null")
    p = p.withColumn("w", F.split("needle", " "))
    long = p.where(F.size("w") >= n + 2).select("passage_id", "needle", F.hash(F.slice("w", 2, n)).alias("k"))
    short = p.where(F.size("w") < n + 2).select("passage_id", "needle")
    t = texts.select("text_id", evidence(F.col("text")).alias("folded")).where("folded is not null")
    words = F.col("w")  # a column of its own: within the function over positions the text would be split each time
    runs = F.when(
        F.size(words) >= n,
        F.array_distinct(
            F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.hash(F.slice(words, i, n)))
        ),
    )
    small = passages.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hint = (lambda x: F.broadcast(x)) if small else (lambda x: x)
    met = t.withColumn("w", F.split("folded", " ")).select("text_id", "folded", F.explode(runs).alias("k")).join(hint(long), "k").where(F.contains("folded", "needle"))
    rest = t.join(hint(short), F.contains("folded", "needle"))
    return met.select("text_id", "passage_id").unionByName(rest.select("text_id", "passage_id")).distinct()
