"""Reproducible choices: md5 of a seed, a purpose and key columns takes the place of a random generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_key(seed: int, salt: str, *keys: Column) -> Column:
    """A text that orders rows at random, the same on every run."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *(k.cast("string") for k in keys)))


def pick(n: Column | int, seed: int, salt: str, *keys: Column) -> Column:
    """A number from 0 to n - 1."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.conv(F.substring(hash_key(seed, salt, *keys), 1, 8), 16, 10).cast("bigint") % n.cast("bigint")


def choose(pool: list[str], seed: int, salt: str, *keys: Column) -> Column:
    """One of a pool of texts."""
    return F.element_at(F.array(*map(F.lit, pool)), (pick(len(pool), seed, salt, *keys) + 1).cast("int"))


def sample_per_group(df: DataFrame, group: list[str], n: int, seed: int, salt: str, *keys: str) -> DataFrame:
    """At most n rows of each group, uniform and without replacement. keys must tell rows apart."""
    order = hash_key(seed, salt, *(F.col(k) for k in [*group, *keys]))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(order, *keys))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def edge(df: DataFrame, column: str, k: int) -> str | None:
    """The k-th least value of a column of hash_key; None for k = 0 or no rows.

    Rows are counted by four digits first, at most 65,536 counts, so that only the rows of one such group are ordered.
    """
    start = F.substring(column, 1, 4)
    for row in df.groupBy(start.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        if k <= row["n"]:
            return df.where(start == row["p"]).orderBy(column).limit(k).agg(F.max(column)).first()[0] if k > 0 else None
        k -= row["n"]
    return df.agg(F.max(column)).first()[0]


def numbered(df: DataFrame, key: str, seed: int, name: str = "_i") -> DataFrame:
    """df with 0, 1, ... in the order of a hash of key. Groups of four digits of the hash are numbered apart; no task gets all rows."""
    marked = df.withColumn("_h", hash_key(seed, "place", F.col(key))).withColumn("_p", F.substring("_h", 1, 4))
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # over 65,536 counts at most
    counts = marked.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    at = F.row_number().over(Window.partitionBy("_p").orderBy("_h", key)) - 1
    return marked.withColumn("_at", at).join(F.broadcast(counts), "_p").withColumn(name, F.col("_ahead") + F.col("_at")).drop("_h", "_p", "_at", "_ahead")


def shuffled(df: DataFrame, seed: int, salt: str, *keys: str) -> DataFrame:
    return df.orderBy(hash_key(seed, salt, *(F.col(k) for k in keys)), *keys)


def sample(df: DataFrame, n: int, seed: int, salt: str, *keys: str) -> DataFrame:
    """n rows in random order; all if there are fewer."""
    return shuffled(df, seed, salt, *keys).limit(n)
