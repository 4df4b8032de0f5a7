"""Evaluation metrics and leaderboards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall(expected: Column, found: Column) -> Column:
    """Share of the expected set that was found; 1 if nothing was expected."""
    want = F.array_distinct(expected)
    return F.when(F.size(want) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(want, found)) / F.size(want))


# Marks of markup that must not stand in a chunk.
MARKUP = ("xbrli:", "<link:", "schemaref", "<xbrl", "linkbase", "us-gaap:")


def success_rate(ok: Column) -> Column:
    """Share of true values; 1 without any."""
    return F.coalesce(F.avg(ok.cast("double")), F.lit(1.0))


def identity_accuracy(fields: list[tuple[Column, Column]]) -> Column:
    """Share of the expected fields, as (predicted, expected), that were met; 1 if nothing was expected."""
    want = sum((e.isNotNull().cast("int") for _, e in fields), F.lit(0))
    met = sum((F.coalesce(p == e, F.lit(False)).cast("int") for p, e in fields), F.lit(0))
    return F.when(want == 0, F.lit(1.0)).otherwise(met / want)


def numeric_match(answer: Column, values: Column) -> Column:
    """Share of the expected values that stand verbatim in the answer; 1 if nothing was expected."""
    return F.when(F.size(values) == 0, F.lit(1.0)).otherwise(F.size(F.filter(values, lambda v: answer.contains(v))) / F.size(values))


def markup_share(text: Column) -> Column:
    """Share of texts with marks of markup in them; 0 without any text."""
    low = F.lower(text)
    return F.coalesce(F.avg(reduce(lambda a, b: a | b, [low.contains(m) for m in MARKUP]).cast("double")), F.lit(0.0))


def summary(results: DataFrame, by: list[str]) -> DataFrame:
    """abstention over all cases; recall, citation and numeric over answerable ones; grounding over answerable ones that have it."""
    able = lambda c: F.avg(F.when(F.col("answerable"), c))
    return results.groupBy(*by).agg(
        F.avg((F.col("answerable") != F.col("answered")).cast("double") * -1 + 1).alias("abstention"),
        able(F.col("recall")).alias("recall"),
        able(F.col("numeric").cast("double")).alias("numeric"),
        able(F.col("grounding")).alias("grounding"),
    )


def leaderboard(scores: DataFrame, name: str, metric: str, descending: bool = True) -> DataFrame:
    """Rows with their place by a metric, missing scores 0, ties by name. Scores are few: one row per configuration."""
    from pyspark.sql import Window

    value = F.coalesce(metric, F.lit(0.0))
    w = Window.orderBy(value.desc() if descending else value.asc(), name)
    return scores.withColumn("place", F.row_number().over(w))
