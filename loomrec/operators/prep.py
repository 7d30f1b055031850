"""Preparation of raw catalogs and user libraries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomrec.functions.text import strip, text_field

LONG_TAIL = 1000


def rename_id(df: DataFrame, column: str) -> DataFrame:
    """column, a number, as the text column id."""
    return df.withColumnRenamed(column, "id").withColumn("id", F.col("id").cast("bigint").cast("string"))


def drop_blank_names(df: DataFrame, column: str = "name") -> DataFrame:
    return df.where(strip(F.coalesce(F.col(column), F.lit(""))) != "")


def with_text_field(df: DataFrame) -> DataFrame:
    tags = F.col("tags") if "tags" in df.columns else F.lit(None).cast("string")
    return df.withColumn("text_for_embedding", text_field(F.col("name"), F.col("genres"), F.col("categories"), tags, F.col("about")))


def keep_largest(df: DataFrame, keys: list[str], value: str, *ties: str) -> DataFrame:
    """The row of each key with the largest value; ties by the columns named."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), *ties)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def drop_empty_profiles(users: DataFrame) -> DataFrame:
    return users.where("items_count > 0")


def ranked_library(items: Column) -> Column:
    """Item ids by playtime, largest first; a missing playtime counts as 0 and ties keep the library's order."""
    at = F.transform(items, lambda x, i: F.struct((-F.coalesce(x["playtime_forever"], F.lit(0))).alias("p"), i.alias("i"), x["item_id"].alias("id")))
    return F.transform(F.array_sort(at), lambda x: x["id"])


def user_sequences(inter: DataFrame, least: int = 2, long_tail: int = LONG_TAIL) -> DataFrame:
    """user_id, item_sequence, sequence_length and is_long_tail_user from (user_id, item_id, playtime); ties go by item_id."""
    per = inter.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct((-F.coalesce("playtime", F.lit(0.0))).alias("p"), F.col("item_id").alias("id")))).alias("s"))
    out = per.select("user_id", F.transform("s", lambda x: x["id"]).alias("item_sequence")).withColumn("sequence_length", F.size("item_sequence"))
    return out.where(F.col("sequence_length") >= least).withColumn("is_long_tail_user", F.col("sequence_length") > long_tail)


def missing(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Distinct keys of left that right lacks."""
    keys = right.select(F.col(right_key).alias(left_key)).distinct()
    return left.select(left_key).distinct().join(keys, left_key, "left_anti")


def missing_share(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """The share of left's rows whose key right lacks."""
    keys = right.select(F.col(right_key).alias(left_key)).distinct().withColumn("_there", F.lit(1))
    return left.join(keys, left_key, "left").agg(F.avg(F.col("_there").isNull().cast("double")).alias("share"))
