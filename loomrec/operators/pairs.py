"""Histories with targets, and co-occurrence, from (user_id, pos, item_id, n) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomrec.functions.determinism import hash_key, numbered


def _known(rows: DataFrame, known: DataFrame, parts: int | None) -> DataFrame:
    """rows of known items, dealt by user over parts tasks; over as many as Spark takes without parts."""
    ids = known.select(F.col("id").alias("item_id")).distinct()
    if parts is None:
        return rows.join(ids, "item_id", "left_semi")
    return rows.repartition(parts, "item_id").join(ids.repartition(parts, "item_id"), "item_id", "left_semi").repartition(parts, "user_id")


def history_target_pairs(seq: DataFrame, known: DataFrame, history: int = 10, per_user: int = 3, long_tail: int = 1000, seed: int = 0, parts: int | None = None) -> DataFrame:
    """user_id, pos, history (up to ``history`` item ids, oldest first) and target.

    Long-tail users go; unknown items go before positions are counted; repeats stay. Of each user's
    positions from the second on, per_user are drawn. parts is the number of tasks of each shuffle.
    """
    own = _known(seq.where(F.col("n") <= long_tail).select("user_id", "item_id", "pos"), known, parts)
    user = Window.partitionBy("user_id")
    own = own.withColumn("at", F.row_number().over(user.orderBy("pos")))
    own = own.withColumn("history", F.collect_list("item_id").over(user.orderBy("at").rowsBetween(-history, -1)))
    rank = F.row_number().over(user.orderBy(hash_key(seed, "position", F.col("user_id"), F.col("at")), "at"))
    drawn = own.where("at > 1").withColumn("_rank", rank).where(F.col("_rank") <= per_user)
    return drawn.select("user_id", F.col("at").alias("pos"), "history", F.col("item_id").alias("target"))


def _counted(own: DataFrame, least: int, parts: int | None) -> DataFrame:
    """a, b and n of the pairs a < b of the sorted arrays s. An item goes to its task with its array's rest, and pairs are made and counted there: they are not shuffled."""
    left = own.select("s", F.posexplode("s").alias("i", "a")).where(F.col("i") < F.size("s") - 1)
    left = left.select("a", F.slice("s", F.col("i") + 2, F.size("s") - F.col("i") - 1).alias("rest"))
    left = left.repartition("a") if parts is None else left.repartition(parts, "a")
    return left.select("a", F.explode("rest").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def cooccurrence(seq: DataFrame, known: DataFrame, window: int = 30, least: int = 2, long_tail: int = 1000, parts: int | None = None) -> DataFrame:
    """a, b and n, the users who have both a < b among their first ``window`` items.

    The window is cut before unknown items go; repeats count once.
    """
    top = _known(seq.where((F.col("n") <= long_tail) & (F.col("pos") <= window)).select("user_id", "item_id"), known, parts)
    own = top.groupBy("user_id").agg(F.array_sort(F.collect_set("item_id")).alias("s"))
    return _counted(own, least, parts and 2 * parts)  # a user's item has some seven partners


def whole_cooccurrence(inter: DataFrame, known: DataFrame, least: int = 2, parts: int | None = None) -> DataFrame:
    """a, b and n, the users who have both a < b, of all known items of all users of inter (user_id, item_id). Items go by numbers, four bytes a pair."""
    names = numbered(known.select("id").distinct(), "id", 0).select(F.col("id").alias("item_id"), F.col("_i").cast("int").alias("item"))
    rows = inter.select("user_id", "item_id")
    if parts is None:
        rows = rows.join(names, "item_id")
    else:
        rows = rows.repartition(parts, "item_id").join(names.repartition(parts, "item_id"), "item_id").repartition(parts, "user_id")
    own = rows.groupBy("user_id").agg(F.array_sort(F.collect_set("item")).alias("s"))
    often = _counted(own, least, parts and 4 * parts)  # a user's item has some twenty partners
    x, y = (names.select(F.col("item").alias(c), F.col("item_id").alias(to)) for c, to in (("a", "x"), ("b", "y")))
    return often.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "n")


def partners(pairs: DataFrame, most: int | None = 10) -> DataFrame:
    """item, partner, n and rank of each item's most frequent partners, both ways, or of all without most; ties by partner."""
    ways = (F.struct(F.col(x).alias("item"), F.col(y).alias("partner"), "n") for x, y in ("ab", "ba"))
    both = pairs.select(F.explode(F.array(*ways)).alias("x")).select("x.*")  # the pairs' plan is long: it is run once
    w = Window.partitionBy("item").orderBy(F.desc("n"), "partner")
    ranked = both.withColumn("rank", F.row_number().over(w))
    return ranked if most is None else ranked.where(F.col("rank") <= most)
