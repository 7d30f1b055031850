"""Operator 13: which filter removes what, in every order of five filters.

Exact copies are found by sorting: rows go to ranges of (fingerprint, doc_id), are sorted there
by fingerprint, full text and doc_id, and each is compared with its predecessor. The doc_id
within the range key cuts a large group of copies over many ranges; where a fingerprint goes on
from one range into the next, the least doc_ids of its texts are passed on. Each row's failures
become a mask of five bits. Masks are counted by part, and these counters, 32 a part at most,
add up to all that any order of the filters gives.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrec.llm.common import materialize, partitions_for, release, tidy

#: The filters; the k-th has the bit 2 ** k of a mask.
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 100, 80, 10
MARKS = "[#$%&*|]"
SPACES = r"[ \t-\r]+"
#: Bytes of a table's texts for each range of the sort.
RANGE_BYTES = 32 << 20
#: Texts that go on into a next range, up to which the table of them is broadcast (64 MB).
PASSED_ON = 1_000_000


def own_failures(text: Column) -> Column:
    """The mask of the filters A to D, which see a row by itself."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = (
        F.size(words) < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
        100 * capitals > CAPITALS_PERCENT * F.char_length(text),
        text.rlike(MARKS),
    )
    return sum(F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fails))


def fingerprint(text: Column) -> Column:
    """What rows are dealt by; texts that share one are still told apart."""
    return F.xxhash64(text)


SORTED = "part string, doc_id long, mask int, first long, fingerprint long, digest binary, passed boolean"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range, sorted, with the least doc_id of their text in the range so far.

    fingerprint and digest are given where the text's group may have begun in an earlier range:
    in rows of the range's first fingerprint. Rows that are passed on list the texts of the
    range's last fingerprint, with the least doc_id of each.
    """
    at = TaskContext.get().partitionId()
    opening = last_print = None  # the range's first fingerprint; that of the row before
    last_text, least = None, None  # the row before's text; the least doc_id of its group
    tails: dict[bytes, int] = {}  # of the last fingerprint's texts
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        prints, texts = batch.column("fingerprint").to_numpy(), batch.column("text")
        ids = batch.column("doc_id")
        opening = prints[0] if opening is None else opening
        same_print = np.concatenate([[last_print is not None and prints[0] == last_print], prints[1:] == prints[:-1]])
        same = same_print.copy()
        same[0] = same[0] and texts[0].as_py() == last_text
        near = np.flatnonzero(same_print[1:]) + 1
        if len(near):  # only predecessors of the same fingerprint are compared in full
            same[near] = pc.equal(texts.take(pa.array(near)), texts.take(pa.array(near - 1))).to_numpy(zero_copy_only=False)
        first = np.full(n, -1, np.int64)
        known = np.zeros(n, bool)
        cuts = np.flatnonzero(~same)
        numbers = ids.fill_null(0).to_numpy()
        has = ids.is_valid().to_numpy(zero_copy_only=False)
        # doc_ids rise within a text, nulls first: its least is the first that isn't null
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), n], strict=True):
            if a == b:
                continue
            if not same[a]:
                least = None
            k = a + int(has[a:b].argmax())
            if least is None and has[k]:
                least = int(numbers[k])
            if least is not None:
                first[a:b], known[a:b] = least, has[a:b]
            if prints[b - 1] == prints[-1]:
                if prints[b - 1] != (last_print if a == 0 else prints[a - 1]):
                    tails = {}
                if least is not None:
                    tails[_digest(texts[b - 1].as_py())] = least
        last_print, last_text = prints[-1], texts[-1].as_py()
        open_ = (prints == opening) & (at > 0)
        digest: list = [None] * n
        for i in np.flatnonzero(open_).tolist():
            digest[i] = digest[i - 1] if i and open_[i - 1] and same[i] else _digest(texts[i].as_py())
        columns = [batch.column("part"), ids, batch.column("mask"), pa.array(first, mask=~known), pa.array(prints, mask=~open_), pa.array(digest, pa.binary()), pa.array(np.zeros(n, bool))]
        yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)
    if tails:
        n = len(tails)
        columns = [pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(list(tails.values())), pa.array([last_print] * n), pa.array(list(tails), pa.binary()), pa.array([True] * n)]
        yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


_NAMES = [x.split()[0] for x in SORTED.split(", ")]
_TYPES = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]


def _digest(text: str) -> bytes:
    import hashlib

    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()


def failures(docs: DataFrame, part: str = "lang") -> tuple[DataFrame, list[DataFrame]]:
    """part, doc_id and mask of each row of docs, the mask with the bit of E where a smaller doc_id has the same text.

    Also the materialized tables that these rows are read from.
    """
    rows = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("fingerprint", fingerprint(F.col("text")))
    # the range key is short, as rows of it are sampled to the driver; equal texts are still next to each other
    ranges = partitions_for(docs, RANGE_BYTES)
    rows = rows.repartitionByRange(ranges, "fingerprint", "doc_id").sortWithinPartitions("fingerprint", "text", "doc_id")
    rows = rows.select("part", "doc_id", "text", "fingerprint", own_failures(F.col("text")).cast("int").alias("mask"))
    held = materialize(rows.mapInArrow(tidy(_compared), SORTED), "compared")
    # a text is passed on by each range that ends within its group: at most one a range, but for equal fingerprints of other texts
    earlier = held.where("passed").groupBy(F.col("fingerprint").alias("_f"), F.col("digest").alias("_d")).agg(F.min("first").alias("_least"))
    earlier = materialize(earlier, "passed")
    tables = [held, earlier]
    if earlier.count() <= PASSED_ON:
        earlier = F.broadcast(earlier)
    out = held.where("not passed").join(earlier, (F.col("fingerprint") == F.col("_f")) & (F.col("digest") == F.col("_d")), "left")
    copy = F.col("doc_id") > F.least("first", "_least")
    return out.select("part", "doc_id", F.col("mask").bitwiseOR(F.when(copy, 1 << FILTERS.index("E")).otherwise(0)).alias("mask")), tables


def counters(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good and toxic: rows of (part, doc_id, mask), and those whose doc_id some label calls good or toxic."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # rows that repeat a doc_id are summed up before they meet its labels
    per = flags.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n")).join(known, "doc_id", "left")
    some = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c)
    return per.groupBy("part", "mask").agg(F.sum("n").alias("n"), some("good"), some("toxic"))


def steps(masks: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, from the counters of the part's masks."""
    every = []
    for p in permutations(FILTERS):
        bits = [1 << FILTERS.index(x) for x in p]
        every += [F.struct(F.lit("".join(p)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(bits[k]).alias("own"), F.lit(sum(bits[:k])).alias("ahead")) for k in range(len(p))]
    rows = masks.withColumn("_s", F.explode(F.array(*every)))  # 600 steps
    own, ahead = F.col("_s.own"), F.col("_s.ahead")
    rows = rows.select("part", "_s.filter_order", "_s.step", "n", "good", "toxic", "mask", own.alias("_own"), (F.col("mask").bitwiseAND(own) != 0).alias("_fails"), (F.col("mask").bitwiseAND(ahead) != 0).alias("_gone"))
    gone, fails = F.col("_gone"), F.col("_fails")
    total = lambda when, name, what="n": F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long").alias(name)
    # of all orders, each failed filter is the first of its row's failures equally often
    shares = F.when(fails, F.col("n") * (F.lit(factorial(len(FILTERS))) / F.bit_count("mask")).cast("long")).otherwise(0)
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~gone & ~fails, "kept"),
        total(~gone & fails, "removed"),
        total(gone & fails, "redundant"),
        total(F.col("mask") == F.col("_own"), "unique_fails"),
        total(~gone & fails, "good_lost", "good"),
        total(~gone & fails, "toxic_lost", "toxic"),
        F.sum(shares).cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, filter_order, step and counts of five filters in all 120 orders.

    A text fails A with under 100 words, B with under 80 % of them distinct, C with over 10 % of
    its code points in A-Z, D with any of ``#$%&*|``, and E where a smaller doc_id has the same
    text, in whatever part, removed or not. kept: rows left after the step; removed: by it;
    redundant: failing its filter, removed before; unique_fails: failing its filter only;
    good_lost and toxic_lost: removed by it, labelled so; shapley: removed by its filter, summed
    over all orders.

    A null text is an empty one, a null part an empty string. Texts are read whole. A row
    without a doc_id neither fails E nor makes others fail it, and has no label. Rows that share doc_id and text
    are not copies of each other, but all of them are of a smaller one. A doc_id that is
    labelled twice is good, or toxic, if any of its labels says so. Other columns are ignored;
    an empty table gives an empty result.
    """
    flags, tables = failures(docs, part)
    masks = materialize(counters(flags, labels), "masks")
    release(*tables)
    return steps(masks)


def _sql() -> str:
    perms = ", ".join(f"('{''.join(p)}')" for p in permutations(FILTERS))
    flags = " + ".join(f"case when {c} then {1 << k} else 0 end" for k, c in enumerate(("n < 100", "100 * d < 80 * n", "100 * caps > 10 * length(text)", "regexp_matches(text, '[#$%&*|]')", "coalesce(doc_id > least_id, false)")))
    return f"""with t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
w as (select *, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') as ws, min(doc_id) over (partition by text) as least_id from t),
c as (select *, len(ws) as n, len(list_distinct(ws)) as d, length(regexp_replace(text, '[^A-Z]', '', 'g')) as caps from w),
k as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
m as (select part, {flags} as mask, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic from c left join k using (doc_id)),
o as (select o, s, 1 << (strpos('ABCDE', o[s]) - 1) as own, list_sum(list_transform(range(1, s), lambda i: 1 << (strpos('ABCDE', o[i]) - 1))) as ahead
  from (values {perms}) p(o), range(1, 6) q(s)),
g as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by all)
select part, o as filter_order, cast(s as integer) as step,
cast(sum(case when mask & own = 0 and mask & coalesce(ahead, 0) = 0 then n else 0 end) as bigint) as kept,
cast(sum(case when mask & own <> 0 and mask & coalesce(ahead, 0) = 0 then n else 0 end) as bigint) as removed,
cast(sum(case when mask & own <> 0 and mask & coalesce(ahead, 0) <> 0 then n else 0 end) as bigint) as redundant,
cast(sum(case when mask = own then n else 0 end) as bigint) as unique_fails,
cast(sum(case when mask & own <> 0 and mask & coalesce(ahead, 0) = 0 then good else 0 end) as bigint) as good_lost,
cast(sum(case when mask & own <> 0 and mask & coalesce(ahead, 0) = 0 then toxic else 0 end) as bigint) as toxic_lost,
cast(sum(case when mask & own <> 0 then n * (120 // bit_count(mask)) else 0 end) as bigint) as shapley
from g, o group by all"""


ORACLE = _sql()
