"""Profiles of tables: missing values, duplicates, distributions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_profile(df: DataFrame) -> DataFrame:
    """column_name and null_pct of the columns with nulls, in one pass."""
    one = df.agg(*(F.round(F.avg(F.col(c).isNull().cast("double")) * 100, 2).alias(c) for c in df.columns))
    return one.unpivot([], df.columns, "column_name", "null_pct").where("null_pct > 0")


def duplicate_count(df: DataFrame, *keys: str) -> DataFrame:
    """Rows beyond the first of each key; nulls are one value."""
    return df.groupBy(*keys).count().agg((F.sum("count") - F.count("*")).alias("duplicates"))


def classify_duplicates(df: DataFrame, key: str, other: str, content: Column) -> DataFrame:
    """class and groups: repeated keys with several values of other, with identical content, with differing content."""
    per = df.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(other).alias("o"), F.count_distinct(content).alias("c")).where("n > 1")
    kind = F.when(F.col("o") > 1, "several_owners").when(F.col("c") <= 1, "identical").otherwise("differing")
    return per.groupBy(kind.alias("class")).agg(F.count("*").alias("groups"))


def quantiles(df: DataFrame, column: str, points: tuple[float, ...]) -> list[float | None]:
    """The exact quantiles of column at points, between neighbours in proportion; nulls don't count.

    Equal values are summed up first, so no value is hot. The distinct ones are counted by ranges, and only the
    ranges that hold a wanted rank are sorted: of them and of the rows at those ranks two a point at most.
    """
    spark = df.sparkSession
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n")).persist()
    placed = counts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "v").withColumn("p", F.spark_partition_id())
    # the ranges' ends tell them apart from here on, as dealing them out again may cut elsewhere
    ranges = placed.groupBy("p").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("n")).orderBy("low").collect()
    total = sum(r["n"] for r in ranges)
    places = [p * (total - 1) for p in points]
    wanted = sorted({k for x in places for k in (math.floor(x), math.ceil(x))}) if total else []
    ahead, some = 0, []
    for r in ranges:
        ranks = [k for k in wanted if ahead <= k < ahead + r["n"]]
        if ranks:
            some.append((r["low"], r["high"], ahead, ranks))
        ahead += r["n"]
    found: dict[int, float] = {}
    if some:
        at = F.coalesce(*(F.when(F.col("v").between(low, high), i) for i, (low, high, *_) in enumerate(some)))
        before = F.element_at(F.array(*(F.lit(a) for *_, a, _ in some)), at + 1)
        rows = counts.withColumn("r", at).where("r is not null").withColumn("b", before)
        upto = F.col("b") + F.sum("n").over(Window.partitionBy("r").orderBy("v"))
        rows = rows.withColumn("u", upto)
        hit = F.filter(F.array(*map(F.lit, wanted)), lambda k: (k >= F.col("u") - F.col("n")) & (k < F.col("u")))
        for r in rows.select("v", F.explode(hit).alias("k")).collect():
            found[r["k"]] = r["v"]
    counts.unpersist()
    between = lambda x: found[math.floor(x)] + (found[math.ceil(x)] - found[math.floor(x)]) * (x - math.floor(x))
    return [between(x) if total else None for x in places]


def describe(df: DataFrame, column: str, points: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """One row of count, mean, sample deviation, least, exact quantiles and largest."""
    c = F.col(column)
    named = [F.lit(v).cast("double").alias(f"p{round(p * 100):02d}") for p, v in zip(points, quantiles(df, column, points), strict=True)]
    return df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("least"), *named, F.max(c).alias("largest"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    return value_counts(df, column).orderBy(F.desc("n"), column).limit(n)


def reindexed_counts(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Counts in a fixed order of values, null for absent ones."""
    made = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(v).alias(column)) for i, v in enumerate(order)))
    fixed = df.sparkSession.range(1).select(F.explode(made).alias("x")).select("x.*")
    return fixed.join(value_counts(df, column), column, "left").select("ord", column, "n")


def histogram(df: DataFrame, column: str, bins: int, low: float, high: float) -> DataFrame:
    """bin and n over bins of equal width; values beyond an end count in the last bin there."""
    c = F.when(F.col(column).isNotNull(), F.greatest(F.least(F.col(column), F.lit(high)), F.lit(low)))
    at = F.least(F.floor((c - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def share(condition: Column) -> Column:
    """The share of rows that meet a condition; nulls do not."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))
