"""Which texts contain which others, as an equi-join on the rarest piece of what is looked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a piece; shorter texts are pieces themselves.
PIECE = 3


def pieces(text: Column, size: int) -> Column:
    """Distinct substrings of so many characters."""
    n = F.length(text) - size + 1
    every = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: text.substr(i, F.lit(size)))
    return F.when(n > 0, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def contains_join(texts: DataFrame, wanted: DataFrame, text: str, part: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows of texts beside the rows of wanted whose `part` their `text` contains, both of the same `by`; empty and null parts match nothing.

    Of a part's pieces the one counts that the fewest texts hold (of the same `by`), so a part costs as many pairs as its rarest piece has texts;
    a part with a piece that no text holds costs none. Column names of both sides differ but for `by`.
    """
    by = list(by)
    parts = wanted.where(F.length(part) > 0).withColumn("_size", F.least(F.length(part), F.lit(PIECE)))
    sizes = sorted(r["_size"] for r in parts.select("_size").distinct().collect())  # PIECE numbers at most
    if not sizes:
        return texts.withColumn("_none", F.lit(0)).join(wanted.where("false").withColumn("_none", F.lit(0)), [*by, "_none"]).drop("_none")
    held = texts.withColumn("_piece", F.explode(F.flatten(F.array(*[pieces(F.col(text), n) for n in sizes]))))
    counts = held.groupBy(*by, "_piece").agg(F.count("*").alias("_n"))
    own = F.coalesce(*[F.when(F.col("_size") == n, pieces(F.col(part), n)) for n in sizes])
    distinct = parts.select(*by, part, "_size").distinct().withColumn("_piece", F.explode(own)).join(counts, [*by, "_piece"], "left")
    rarest = distinct.groupBy(*by, part).agg(F.min_by("_piece", F.struct(F.coalesce("_n", F.lit(0)), "_piece")).alias("_piece"), F.min(F.coalesce("_n", F.lit(0))).alias("_n"))
    asked = rarest.where("_n > 0").drop("_n")
    pairs = held.join(asked, [*by, "_piece"]).where(F.col(text).contains(F.col(part))).drop("_piece")
    return pairs.join(wanted, [*by, part])
