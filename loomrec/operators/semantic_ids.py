"""Semantic ids: codes with a disambiguating digit, and reports on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomrec.functions.metrics import jaccard


def add_digit(codes: DataFrame, size: int | None = None, key: str = "id") -> DataFrame:
    """key and semantic_ids: codes with 0, 1, ... in the order of key among equal ones. With a size, digits beyond it end the query."""
    digit = F.row_number().over(Window.partitionBy("codes").orderBy(key)) - 1
    if size is not None:
        digit = F.when(digit < size, digit).otherwise(F.raise_error(F.lit("more items share their codes than there are digits")).cast("int"))
    return codes.withColumn("_d", digit).select(key, F.concat("codes", F.array("_d")).alias("semantic_ids"))


def level_columns(ids: DataFrame, levels: int = 4) -> DataFrame:
    return ids.withColumns({f"semantic_id_{k}": F.col("semantic_ids")[k] for k in range(levels)})


def collisions(codes: DataFrame, column: str = "codes") -> DataFrame:
    """One row: items, groups, colliding_groups, colliding_items and unique_share (1 for no rows)."""
    per = codes.groupBy(column).agg(F.count("*").alias("n"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("items"),
        F.count("*").alias("groups"),
        F.count_if(F.col("n") > 1).alias("colliding_groups"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("colliding_items"),
        F.coalesce(F.count_if(F.col("n") == 1) / F.sum("n"), F.lit(1.0)).alias("unique_share"),
    )


def dense_usage(used: DataFrame, levels: int) -> DataFrame:
    """level, code and n for all codes up to the largest of any level, 0 for unused ones."""
    size = (used.agg(F.max("code")).first()[0] or 0) + 1
    spark = used.sparkSession
    grid = spark.range(levels * size).select(F.floor(F.col("id") / size).cast("int").alias("level"), (F.col("id") % size).cast("int").alias("code"))
    return grid.join(used, ["level", "code"], "left").select("level", "code", F.coalesce("n", F.lit(0)).alias("n"))


def health(dense: DataFrame) -> DataFrame:
    """Per level: codes_used, utilization, max_code_share and normalized_entropy."""
    all_ = F.sum("n").over(Window.partitionBy("level"))
    p = F.col("n") / F.col("t")
    rows = dense.withColumn("t", all_)
    return rows.groupBy("level").agg(
        F.count_if(F.col("n") > 0).alias("codes_used"),
        F.avg((F.col("n") > 0).cast("double")).alias("utilization"),
        F.coalesce(F.max(F.col("n") / F.col("t")), F.lit(0.0)).alias("max_code_share"),
        (F.sum(F.when(F.col("n") > 0, -p * F.ln(p)).otherwise(0.0)) / F.ln(F.count("*"))).alias("normalized_entropy"),
    )


def middle_group(ids: DataFrame, least: int = 5, group: str = "prefix") -> DataFrame:
    """The group in the middle by size among those of at least ``least`` rows; ties by its name."""
    per = ids.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    # distinct sizes are few: their sum is at most the number of rows
    sizes = per.groupBy("n").agg(F.count("*").alias("groups")).orderBy("n").collect()
    place = sum(r["groups"] for r in sizes) // 2
    for r in sizes:
        if place < r["groups"]:
            return per.where(F.col("n") == r["n"]).orderBy(group).offset(place).limit(1)
        place -= r["groups"]
    return per


def pairs_within(rows: DataFrame, group: str, cap: int, seed: int, key: str = "id") -> DataFrame:
    """a and b of each group: all pairs where they are at most cap, else cap distinct ones drawn by hash.

    A drawn pair is the hash of its number turned to places a < b, so that no group is multiplied out.
    """
    from loomrec.functions.determinism import pick

    w = Window.partitionBy(group)
    at = rows.withColumns({"_i": F.row_number().over(w.orderBy(key)), "_n": F.count("*").over(w)})
    sizes = at.select(group, "_n").distinct().where("_n > 1").withColumn("_all", (F.col("_n") * (F.col("_n") - 1) / 2).cast("long"))
    whole = sizes.where(F.col("_all") <= cap).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_all") - 1)))
    # distinct draws: a few more than are needed, the first cap of them kept
    drawn = sizes.where(F.col("_all") > cap).withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(4 * cap))))
    drawn = drawn.withColumn("_k", pick(F.col("_all"), seed, "pair", F.col(group).cast("string"), F.col("_t")))
    drawn = drawn.groupBy(group, "_n", "_all", "_k").agg(F.min("_t").alias("_t"))
    drawn = drawn.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy("_t"))).where(F.col("_r") <= cap)
    both = whole.select(group, "_k").unionByName(drawn.select(group, "_k"))
    # number k stands for places (i, j), i < j, counted by j
    j = F.floor((1 + F.sqrt(1 + 8 * F.col("_k").cast("double"))) / 2).cast("long")
    both = both.withColumn("_j", j).withColumn("_a", F.col("_k") - F.col("_j") * (F.col("_j") - 1) / 2)
    both = both.select(group, (F.col("_a") + 1).cast("int").alias("_x"), (F.col("_j") + 1).cast("int").alias("_y"))
    left = at.select(group, F.col("_i").alias("_x"), F.col(key).alias("a"))
    right = at.select(group, F.col("_i").alias("_y"), F.col(key).alias("b"))
    return both.join(left, [group, "_x"]).join(right, [group, "_y"]).select(group, "a", "b")


def random_pairs(rows: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """n ordered pairs of different rows, drawn with replacement."""
    from loomrec.functions.determinism import numbered, pick

    total = rows.count()
    spark = rows.sparkSession
    at = numbered(rows.select(key), key, seed)
    draws = spark.range(n).withColumn("_x", pick(total, seed, "left", F.col("id")))
    draws = draws.withColumn("_y", (F.col("_x") + 1 + pick(max(1, total - 1), seed, "right", F.col("id"))) % total).withColumnRenamed("id", "draw")
    left, right = (at.select(F.col("_i").alias(c), F.col(key).alias(name)) for c, name in (("_x", "a"), ("_y", "b")))
    return draws.join(left, "_x").join(right, "_y").where("_x <> _y").select("draw", "a", "b")


def coherence(pairs: DataFrame, sets: DataFrame, key: str = "id", column: str = "genre_set") -> DataFrame:
    """pairs, mean and median Jaccard similarity; pairs with two empty sets are left out."""
    a, b = (sets.select(F.col(key).alias(c), F.col(column).alias(f"_{c}")) for c in ("a", "b"))
    score = pairs.join(a, "a").join(b, "b").select(jaccard(F.col("_a"), F.col("_b")).alias("j")).where("j is not null")
    return score.agg(F.count("*").alias("pairs"), F.avg("j").alias("mean"), F.percentile("j", 0.5).alias("median"))


def lift(classes: dict[str, DataFrame], sets: DataFrame, base: str = "random", key: str = "id", column: str = "genre_set") -> DataFrame:
    """class, pairs, mean and median similarity of classes of pairs, and lift, the mean over that of the base class."""
    out = None
    for name, pairs in classes.items():
        one = coherence(pairs, sets, key, column).withColumn("class", F.lit(name))
        out = one if out is None else out.unionByName(one)
    # one row a class
    ground = F.max(F.when(F.col("class") == base, F.col("mean"))).over(Window.partitionBy(F.lit(0)))
    return out.withColumn("lift", F.col("mean") / ground).select("class", "pairs", "mean", "median", "lift")


def in_group(ids: DataFrame, *codes: int) -> DataFrame:
    """The rows whose first codes are these."""
    met = F.lit(True)
    for k, code in enumerate(codes):
        met = met & (F.col("semantic_ids")[k] == code)
    return ids.where(met)
