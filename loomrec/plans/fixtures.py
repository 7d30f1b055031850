"""The driver's tables as items, interactions and sequences, in Spark and in DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomrec.functions.determinism import pick
from loomrec.functions.vectors import subtract
from loomrec.operators import items as it
from loomrec.operators import semantic_ids
from loomrec.session import table

LONG_TAIL = 60
LEVELS, CODES = 3, 16
#: Interactions of one task of a shuffle.
TASK_ROWS = 250_000


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size") % 5
    kinds = F.when(size == 0, None).when(size.isin(1, 2), "Single-player").when(size == 3, "Single-player,Multi-player").otherwise("Co-op,PvP")
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("about"))
    part = table(spark, sf, "part")
    return part.join(docs, F.col("doc_id") == F.col("p_partkey"), "left").select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.concat("p_type", F.lit(","), "p_brand").alias("genres"), kinds.alias("categories"), "about", F.col("p_retailprice").alias("price")
    )


def tasks(df: DataFrame, rows: int) -> int:
    """How many tasks of so many rows df makes."""
    return max(1, math.ceil(df.count() / rows))


def parts(spark: SparkSession, sf: str) -> int:
    """Tasks for a shuffle of the interactions: as many as their rows ask for, so that a task's memory doesn't grow with the table."""
    return tasks(table(spark, sf, "lineitem"), TASK_ROWS)


def inter(spark: SparkSession, sf: str) -> DataFrame:
    """user_id, item_id and playtime, dealt by user: what goes on by user needs no further shuffle."""
    n = parts(spark, sf)
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").repartition(n, "l_orderkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey").repartition(n, "o_orderkey")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(F.col("o_custkey").cast("string").alias("user_id"), "l_partkey", "l_quantity").repartition(n, "user_id")
    return rows.groupBy("user_id", "l_partkey").agg(F.sum("l_quantity").alias("playtime")).select("user_id", F.col("l_partkey").cast("string").alias("item_id"), "playtime")


def seq(spark: SparkSession, sf: str) -> DataFrame:
    user = Window.partitionBy("user_id")
    return inter(spark, sf).withColumns({"pos": F.row_number().over(user.orderBy(F.desc("playtime"), "item_id")), "n": F.count("*").over(user)})


def codes(spark: SparkSession, sf: str) -> DataFrame:
    """Three codes an item, by hash: enough of them collide."""
    return table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id")).withColumn("codes", F.array(*(pick(CODES, 0, f"code{k}", F.col("id")).cast("int") for k in range(LEVELS))))


def ids(spark: SparkSession, sf: str) -> DataFrame:
    return semantic_ids.add_digit(codes(spark, sf))


def items(spark: SparkSession, sf: str) -> DataFrame:
    return it.items(ids(spark, sf), catalog(spark, sf))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))


def fixed_codebook(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors 0 to K - 1 for level 0; for each further level, what the next K leave over the first of the level before."""
    v = vectors(spark, sf)
    base = v.where(F.col("id") == 0).select(F.col("embedding").alias("z"))
    out = v.where(F.col("id") < CODES).select(F.lit(0).alias("level"), F.col("id").cast("int").alias("code"), F.col("embedding").alias("vector"))
    for k in range(1, LEVELS):
        own = v.where((F.col("id") >= k * CODES) & (F.col("id") < (k + 1) * CODES)).withColumn("one", F.lit(0)).join(base.withColumn("one", F.lit(0)), "one")
        out = out.unionByName(own.select(F.lit(k).alias("level"), (F.col("id") - k * CODES).cast("int").alias("code"), F.transform(subtract(F.col("embedding"), F.col("z")), lambda x: x / (2**k)).alias("vector")))
    return out


SID = "'<|sid_start|>' || '<|L0_' || c0 || '|>' || '<|L1_' || c1 || '|>' || '<|L2_' || c2 || '|>' || '<|L3_' || d || '|>' || '<|sid_end|>'"


def pick_sql(n: object, salt: str, *keys: str, seed: int = 0) -> str:
    return f"(cast('0x' || substr(md5(concat_ws('|', '{seed}', '{salt}', {', '.join(keys)})), 1, 8) as bigint) % {n})"


def hash_sql(salt: str, *keys: str, seed: int = 0) -> str:
    return f"md5(concat_ws('|', '{seed}', '{salt}', {', '.join(keys)}))"


def choose_sql(pool: list[str], salt: str, *keys: str) -> str:
    texts = ", ".join("'" + x.replace("'", "''") + "'" for x in pool)
    return f"[{texts}][{pick_sql(len(pool), salt, *keys)} + 1]"


STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def blurb_sql(c: str) -> str:
    t = STRIP.format(c)
    first = rf"coalesce(nullif(regexp_extract({t}, '^((?s:.*?)[.!?])[\s\p{{Z}}]', 1), ''), {t})"
    words = rf"regexp_split_to_array({STRIP.format(first)}, '[\s\p{{Z}}]+')"
    return f"case when {c} is null or {t} = '' then '' when len({words}) <= 30 then {first} else array_to_string(({words})[1:30], ' ') || '...' end"


CATALOG = """catalog as (
  select cast(p_partkey as varchar) as id, p_name as name, p_type || ',' || p_brand as genres,
         case when p_size % 5 = 0 then null when p_size % 5 in (1, 2) then 'Single-player'
              when p_size % 5 = 3 then 'Single-player,Multi-player' else 'Co-op,PvP' end as categories,
         d.text as about, p_retailprice as price
  from part left join documents d on d.doc_id = p_partkey)"""
INTER = """inter as (
  select cast(o_custkey as varchar) as user_id, cast(l_partkey as varchar) as item_id, sum(l_quantity) as playtime
  from lineitem join orders on l_orderkey = o_orderkey group by o_custkey, l_partkey)"""
SEQ = INTER + """, seq as (
  select *, row_number() over (partition by user_id order by playtime desc, item_id) as pos, count(*) over (partition by user_id) as n from inter)"""
IDS = f"""code as (
  select cast(p_partkey as varchar) as id, {pick_sql(CODES, 'code0', 'cast(p_partkey as varchar)')} as c0,
         {pick_sql(CODES, 'code1', 'cast(p_partkey as varchar)')} as c1, {pick_sql(CODES, 'code2', 'cast(p_partkey as varchar)')} as c2 from part),
ids as (select *, row_number() over (partition by c0, c1, c2 order by id) - 1 as d from code),
sids as (select id, {SID} as sid from ids)"""
ITEMS = CATALOG + ", " + IDS + f""", item as (
  select catalog.*, sid, name || ' — ' || replace(genres, ',', ', ') as short_desc, {blurb_sql('about')} as blurb
  from catalog join sids using (id)), items as (
  select *, case when blurb = '' then short_desc else short_desc || '. ' || blurb end as long_desc from item)"""
PAIRS = SEQ + f""", own as (
  select user_id, item_id, row_number() over (partition by user_id order by pos) as place from seq where n <= {LONG_TAIL}),
hist as (
  select user_id, item_id as target, place as pos, list(item_id) over (partition by user_id order by place rows between 10 preceding and 1 preceding) as history from own),
pairs as (
  select user_id, pos, target, history from (
    select *, row_number() over (partition by user_id order by {hash_sql('position', 'user_id', 'cast(pos as varchar)')}, pos) as r from hist where pos > 1) where r <= 3)"""
COOC = SEQ + f""", top30 as (select user_id, item_id from seq where n <= {LONG_TAIL} and pos <= 30),
cooc as (
  select x.item_id as a, y.item_id as b, count(*) as n from top30 x join top30 y on x.user_id = y.user_id and x.item_id < y.item_id
  group by all having count(*) >= 2),
partner as (
  select item, partner, n, rank from (
    select *, row_number() over (partition by item order by n desc, partner) as rank
    from (select a as item, b as partner, n from cooc union all select b, a, n from cooc)) where rank <= 10)"""
#: The same of all items of all users, and all partners.
WHOLE_COOC = INTER + """, cooc as (
  select x.item_id as a, y.item_id as b, count(*) as n from inter x join inter y on x.user_id = y.user_id and x.item_id < y.item_id
  group by all having count(*) >= 2),
partner as (
  select *, row_number() over (partition by item order by n desc, partner) as rank
  from (select a as item, b as partner, n from cooc union all select b, a, n from cooc))"""
