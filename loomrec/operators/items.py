"""The item table and lookups on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrec.functions.text import blurb, contains_fold, csv_set, item_description, sid_tokens, strip


def interacted(catalog: DataFrame, sequences: DataFrame) -> DataFrame:
    """catalog rows that some user has, long-tail users included."""
    ids = sequences.select(F.explode("item_sequence").alias("id")).distinct()
    return catalog.join(ids, "id", "left_semi")


def items(semantic_ids: DataFrame, catalog: DataFrame, sequences: DataFrame | None = None) -> DataFrame:
    """One row an item with all that tasks and lookups derive: tokens, descriptions, sets, blurb."""
    df = semantic_ids.select("id", "semantic_ids").join(catalog, "id")
    df = interacted(df, sequences) if sequences is not None else df
    return df.withColumns(
        {
            "sid": sid_tokens(F.col("semantic_ids")),
            "short_desc": item_description(F.col("name"), F.col("genres")),
            "long_desc": item_description(F.col("name"), F.col("genres"), F.col("about")),
            "genre_set": csv_set(F.col("genres")),
            "category_set": csv_set(F.col("categories")),
            "blurb": blurb(F.col("about")),
        }
    )


def name_lookup(df: DataFrame) -> DataFrame:
    """description and name, for short and long descriptions; of equal ones the last id wins."""
    forms = df.select("id", "name", F.explode(F.array_distinct(F.array("short_desc", "long_desc"))).alias("description"))
    return forms.groupBy("description").agg(F.max_by("name", "id").alias("name"))


def criteria_lookup(df: DataFrame) -> DataFrame:
    return df.groupBy("sid").agg(F.max_by("genre_set", "id").alias("genre_set"), F.max_by("category_set", "id").alias("category_set"))


def sid_for(df: DataFrame, name: Column | str) -> DataFrame:
    """The tokens of the item of a name in any case; of several the last id's."""
    return df.where(F.lower("name") == F.lower(F.lit(name))).agg(F.max_by("sid", "id").alias("sid"))


def name_for(df: DataFrame, sid: str) -> DataFrame:
    """The short description of the first item with these tokens."""
    return df.where(F.col("sid") == strip(F.lit(sid))).agg(F.min_by("short_desc", "id").alias("short_desc"))


def find_items(df: DataFrame, part: str, limit: int = 15) -> DataFrame:
    return df.where(contains_fold(F.col("name"), part)).orderBy("id").limit(limit)


def replaced(candidates: DataFrame, lookup: DataFrame, column: str, key: str, value: str) -> DataFrame:
    """column mapped through a lookup; what it lacks stays."""
    found = lookup.select(F.col(key).alias(column), F.col(value).alias("_new"))
    return candidates.join(found, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def first_values(keys: DataFrame, rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """keys with value as the first of its rows by order has it; null for keys without rows."""
    first = rows.join(keys.select(key), key, "left_semi").groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))
    return keys.join(first, key, "left")
