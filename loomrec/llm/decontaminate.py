"""Operator 4: benchmark decontamination, in DataFrame and SQL functions only.

A window of an item occurs in a document only if its rarest word does. So the words of
benchmark windows are ordered by how often the whole corpus holds them; only the first word
of that order, the prefix that containment needs, is joined to the words of documents.
Its place bounds where the window can lie; what lies inside is compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrec.llm.common import materialize

#: Runs of these characters stand between words.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Windows, and words, of a benchmark that are broadcast at once; further ones go in further blocks.
BROADCAST_WINDOWS = 100_000
BROADCAST_WORDS = 1_000_000
BROADCAST_IDS = 2_000_000


def split_words(text: Column) -> Column:
    """The words of text as they stand; the first and the last entry may be empty."""
    return F.split(F.coalesce(text, F.lit("")), BETWEEN)


def folded(words: Column) -> Column:
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.translate(w, UPPER, LOWER))


def _key(word: Column) -> Column:
    # full lower case only joins more words to one key; equality is tested on A-Z alone
    return F.xxhash64(F.lower(word))


def count_words(words: Column) -> Column:
    size = F.size(words)
    empty = (F.element_at(words, 1) == "").cast("int") + ((size > 1) & (F.element_at(words, -1) == "")).cast("int")
    return (size - empty).cast("long")


def windows(benchmark: DataFrame, width: int) -> DataFrame:
    """words and items (ids as strings) of the distinct windows of width words; an item of fewer is one window."""
    own = benchmark.select(F.col("item_id").cast("string").alias("item_id"), folded(split_words(F.col("text"))).alias("all"))
    own = own.where(F.col("item_id").isNotNull() & (F.size("all") > 0))
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - width + 1, F.lit(1)))
    rows = own.select("item_id", "all", F.explode(starts).alias("at")).select("item_id", F.slice("all", F.col("at"), F.lit(width)).alias("words"))
    return rows.groupBy("words").agg(F.collect_set("item_id").alias("items"))


def anchored(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """wins with key and offset of the word of each that is rarest in docs."""
    placed = wins.select("words", F.posexplode("words").alias("offset", "word")).select("words", "offset", _key(F.col("word")).alias("key"))
    keys = placed.select("key").distinct()
    if keys.count() <= BROADCAST_WORDS:
        keys = F.broadcast(keys)
    seen = docs.select(F.explode(split_words(F.col("text"))).alias("word")).select(_key(F.col("word")).alias("key"))
    often = seen.join(keys, "key", "left_semi").groupBy("key").agg(F.count("*").alias("often"))
    ranked = placed.join(often, "key", "left").select("words", "key", "offset", F.coalesce("often", F.lit(0)).alias("often"))
    first = ranked.groupBy("words").agg(F.min(F.struct("often", "offset", "key")).alias("first"))
    return wins.join(first, "words").select(F.array_join("words", " ").alias("joined"), "items", F.size("words").alias("len"), F.col("first.key").alias("key"), F.col("first.offset").alias("offset"))


def hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, tie: Column | None = None) -> DataFrame:
    """_row, doc_id, tie (null unless given), n_words and, of each occurrence of a window, span (start, len) and items; one row at least for each row of docs."""
    wins = materialize(anchored(docs, materialize(windows(benchmark, width), "windows")), "anchors")
    blocks = max(1, -(-wins.count() // BROADCAST_WINDOWS))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), (F.lit(None).cast("long") if tie is None else tie).alias("tie"), "text")
    rows = rows if blocks == 1 else materialize(rows, "numbered")  # row numbers hold for one reading only
    rows = rows.select("_row", "doc_id", "tie", split_words(F.col("text")).alias("own"))
    rows = rows.select("_row", "doc_id", "tie", "own", F.posexplode("own").alias("pos", "word")).withColumn("key", _key(F.col("word")))
    start = F.col("pos") - F.col("offset")
    # words hold no blanks, so texts joined by them are equal when the words are; without a
    # higher-order function, the comparison stays in the same generated code as the join, and
    # no row with the whole array is made for a word that isn't hit
    inside = F.translate(F.array_join(F.slice("own", F.greatest(start, F.lit(0)) + 1, F.col("len")), " "), UPPER, LOWER)
    bounded = F.col("len").isNotNull() & (start >= 0) & (start + F.col("len") <= F.size("own"))
    same = F.coalesce(F.when(bounded, inside == F.col("joined")), F.lit(False))
    out = None
    for k in range(blocks):
        block = wins if blocks == 1 else wins.where(F.pmod(F.xxhash64("joined"), F.lit(blocks)) == k)
        # a document's first word stands for it, so that documents without a hit stay
        found = rows.join(F.broadcast(block), "key", "left").withColumn("same", same).where("same or pos = 0")
        span = F.when(F.col("same"), F.struct(start.alias("start"), F.col("len").alias("len")))
        found = found.select("_row", "doc_id", "tie", count_words(F.col("own")).alias("n_words"), span.alias("span"), F.when(F.col("same"), F.col("items")).alias("items"))
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of docs.

    n_hit counts the words that lie in an occurrence of a window of an item, n_items the items
    with such windows. Null and empty texts have no words; items without words or id have no
    windows; items of equal text all count. Rows that share a doc_id are judged each for
    itself. Other columns are ignored; empty tables give no rows, or rows without hits.
    """
    found = hits(docs, benchmark, width)
    per = found.groupBy("_row", "doc_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_set("span")).alias("spans"), F.collect_set("items").alias("items"))

    def cover(at: Column, span: Column) -> Column:
        end = (span["start"] + span["len"]).cast("int")
        return F.struct(F.greatest(at["end"], end).alias("end"), (at["n"] + F.greatest(end - F.greatest(at["end"], span["start"]), F.lit(0)).cast("long")).alias("n"))

    n_hit = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), cover, lambda at: at["n"])
    items = F.array_sort(F.array_distinct(F.flatten("items")))
    per = per.select("doc_id", "n_words", n_hit.alias("n_hit"), items.alias("items"))
    return per.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """docs without the contaminated rows, each judged for itself, with or without a doc_id.

    Null and empty texts stay; an empty table gives an empty one; other columns pass as they are.
    """
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    found = hits(docs.select("doc_id", "text"), benchmark, width, tie).where("span is not null").select(F.col("doc_id").alias("_d"), F.col("tie").alias("_t"))
    found = materialize(found.distinct(), "contaminated")
    if found.count() <= BROADCAST_IDS:
        found = F.broadcast(found)
    at = F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (tie == F.col("_t"))
    return docs.join(found, at, "left_anti").select(*docs.columns)


ORACLE = r"""
with own as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
item as (
  select cast(item_id as varchar) as item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
win as (
  select distinct item_id, least(10, len(w)) as l, array_to_string(w[i:i + 9], ' ') as g
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from item where len(w) > 0)),
lens as (select distinct l from win),
gram as (
  select r, l, i, array_to_string(w[i:i + l - 1], ' ') as g
  from (select r, w, l, unnest(range(1, len(w) - l + 2)) as i from own, lens where len(w) >= l)),
hit as (select distinct gram.r, gram.i, gram.l, win.item_id from gram join win on gram.g = win.g and gram.l = win.l),
pos as (select r, count(distinct p) as n from (select r, unnest(range(i, i + l)) as p from hit) group by r),
its as (select r, count(*) as n, string_agg(item_id, ',' order by item_id) as s from (select distinct r, item_id from hit) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(pos.n, 0) as n_hit, coalesce(its.n, 0) as n_items,
       sha256(coalesce(its.s, '')) as items_sha256, coalesce(pos.n, 0) > 0 as contaminated
from own left join pos using (r) left join its using (r)
"""
