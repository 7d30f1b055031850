"""Operator 12: exact top-k search by inner product over integer vectors, in buckets of like length.

Vectors are sorted by length and cut into shelves, and a shelf into buckets, each with its
longest first. A query that already has k products, the least of them t, can find a better one
in a bucket only at a cosine of t over the two lengths. That local threshold decides: above 1
the bucket is passed over; where it is high, each of the query's largest coordinates bounds the
same coordinate of any vector that reaches it, and rows within all the bounds are candidates;
else all of the bucket that are long enough are. Candidates' products are verified as integers.
Shelves of the longest vectors come first, and give each query its threshold for the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomrec.llm.common import materialize, release, tidy

SCALE = 64
#: Vectors in a shelf and in a bucket of it; queries that visit a shelf together.
SHELF_ROWS, BUCKET_ROWS, QUERY_BLOCK = 4096, 512, 1024
#: Products in a task, about, beyond the session's number of partitions.
TASK_PRODUCTS = 1 << 23
#: A squared length of a vector of integers up to which its products with others like it fit a long.
LARGEST = float(1 << 62)
#: Products below this are exact in double precision.
EXACT = float(1 << 53)
#: Coordinates of a query that bound its candidates, and the share of a bucket that they must leave to be worth it.
FOCUS, LEFT = 3, 0.25
#: The least local cosine at which coordinates are looked at: below it their bounds leave nearly all.
COSINE = 0.3
#: What bounds of double precision are widened by.
EPS = 1e-9


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array<bigint>), dim and norm2, the squared length, of the rows that take part, one a vec_id."""
    e = F.col("embedding")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size(e) > 0) & ~F.exists(e, bad))
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    scaled = rows.withColumn("embedding", F.transform(e, lambda x: F.lit(float(scale)) * x))
    # floor of a double is a long, so what is too large goes before
    norm = F.aggregate(e, F.lit(0.0), lambda a, x: a + F.pow(F.abs(x) + 1, F.lit(2.0)))
    kept = scaled.where(norm <= LARGEST).withColumn("v", F.transform(e, lambda x: F.floor(x))).drop("embedding")
    return kept.withColumns({"dim": F.size("v"), "norm2": F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)})


SHELF = "shelf long, dim int, longest double, ids binary, vectors binary"


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def shelves(rows: DataFrame, shelf_rows: int = SHELF_ROWS) -> DataFrame:
    """One row a shelf: its width, the length of its longest vector, and ids and vectors, the longest first."""

    def packed(part: int, number: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        longest = float(np.sqrt((x[0].astype(np.float64) ** 2).sum()))
        data = [[part << 32 | number], [x.shape[1]], [longest], [ids.tobytes()], [x.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(d, t) for d, t in zip(data, (pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary()), strict=True)], names=["shelf", "dim", "longest", "ids", "vectors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held_ids, held = TaskContext.get().partitionId(), 0, None, None
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                own = batch.slice(a, b - a)
                ids, x = own.column("vec_id").to_numpy(), _rows(own.column("v"))
                if held is not None and held.shape[1] == x.shape[1]:
                    ids, x = np.concatenate([held_ids, ids]), np.concatenate([held, x])
                elif held is not None:
                    yield packed(part, number, held_ids, held)
                    number += 1
                while len(x) > shelf_rows:
                    yield packed(part, number, ids[:shelf_rows], x[:shelf_rows])
                    number, ids, x = number + 1, ids[shelf_rows:], x[shelf_rows:]
                held_ids, held = ids, x
        if held is not None:
            yield packed(part, number, held_ids, held)

    # a range of the sort holds about two shelves; equal lengths are dealt by vec_id
    ranges = max(1, min(100_000, -(-rows.count() // (2 * shelf_rows))))
    order = ("dim", F.desc("norm2"), "vec_id")
    placed = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("dim", "vec_id", "v")
    return placed.mapInArrow(tidy(run), SHELF)


class Best:
    """The k best (score, vec_id) of each of a block's queries so far."""

    def __init__(self, n: int, k: int, least: np.ndarray) -> None:
        self.k = k
        self.score = np.full((n, k), np.iinfo(np.int64).min, np.int64)
        self.ids = np.full((n, k), -1, np.int64)
        self.known = least  # what k products of each query are known to reach; -inf for fewer

    def least(self) -> np.ndarray:
        """The product that a further candidate must reach."""
        own = np.where(self.ids[:, -1] >= 0, self.score[:, -1].astype(np.float64), -np.inf)
        return np.maximum(self.known, own)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates of some rows: a matrix of scores, and of ids, -1 where there is none."""
        all_scores = np.concatenate([self.score[rows], np.where(ids >= 0, scores, np.iinfo(np.int64).min)], 1)
        all_ids = np.concatenate([self.ids[rows], ids], 1)
        # the lower id wins among equals; places without a candidate come last
        order = np.lexsort((np.where(all_ids >= 0, all_ids, np.iinfo(np.int64).max), np.where(all_ids >= 0, -all_scores, np.iinfo(np.int64).max)))[:, : self.k]
        self.score[rows] = np.take_along_axis(all_scores, order, 1)
        self.ids[rows] = np.take_along_axis(all_ids, order, 1)


class Bucket:
    """Vectors of like length, the longest first, with their directions' coordinates in order."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.x = ids, x
        self.real = x.astype(np.float64)
        self.length = np.sqrt((self.real**2).sum(1))
        self._sorted: tuple[np.ndarray, np.ndarray] | None = None

    def coordinates(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each coordinate: the order of the bucket's rows by it, and it in that order, of rows of length 1."""
        if self._sorted is None:
            self.unit = self.real / np.maximum(self.length, 1e-300)[:, None]
            order = np.argsort(self.unit, axis=0, kind="stable")
            self._sorted = order, np.take_along_axis(self.unit, order, 0)
        return self._sorted


def products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """The integer products of rows of a and b; bound: the largest possible one."""
    if bound < EXACT:  # all sums on the way are below it, too
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _bounds(bucket: Bucket, unit: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query: its FOCUS largest coordinates, and the least and largest value of them in a vector of that cosine to it."""
    focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, : min(FOCUS, unit.shape[1])]
    q = np.take_along_axis(unit, focus, 1)
    c = np.clip(cosine, 0, 1)[:, None]
    slack = np.sqrt(np.maximum(1 - q**2, 0) * (1 - c**2)) + EPS
    # a cosine of c and more: the angle to the query's axis differs from the query's own by its arc at most
    return focus, np.where(q * c - slack < -1, -1, np.where(-q >= c, -1 - EPS, q * c - slack)), np.where(q >= c, 1 + EPS, q * c + slack)


def visit(bucket: Bucket, asked: np.ndarray, q: np.ndarray, lengths: np.ndarray, best: Best) -> None:
    """Adds to best what the queries find in a bucket."""
    least = best.least()
    top = bucket.length[0]
    reach = lengths * top
    # a threshold of 0 or less prunes nothing; a product that equals it may still win by its id
    go = np.flatnonzero((least <= 0) | (reach * (1 + EPS) >= least))
    if not len(go):
        return
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(least[go] > 0, least[go] / np.maximum(reach[go], 1e-300), 0.0) * (1 - EPS)
    bound = float(lengths.max() * top) + 1
    by_length = np.ones(len(go), bool)
    high = np.flatnonzero(cosine >= COSINE)
    if len(high):
        rows = go[high]
        unit = q[rows] / np.maximum(lengths[rows], 1e-300)[:, None]
        order, values = bucket.coordinates()
        focus, low, up = _bounds(bucket, unit, cosine[high])
        n = len(bucket.ids)
        starts, ends = np.zeros(focus.shape, np.int64), np.zeros(focus.shape, np.int64)
        for j in range(focus.shape[1]):
            for f in np.unique(focus[:, j]):
                own = np.flatnonzero(focus[:, j] == f)
                starts[own, j] = np.searchsorted(values[:, f], low[own, j], side="left")
                ends[own, j] = np.searchsorted(values[:, f], up[own, j], side="right")
        width = ends - starts
        narrow = width.argmin(1)
        few = np.flatnonzero((width / n).prod(1) <= LEFT)  # as if coordinates were independent
        by_length[high[few]] = False
        for i in few.tolist():
            j = narrow[i]
            some = order[starts[i, j] : ends[i, j], focus[i, j]]
            row = rows[i]
            within = bucket.unit[some[:, None], focus[i]]
            some = some[((within >= low[i]) & (within <= up[i])).all(1)]
            some = some[(bucket.length[some] * lengths[row] * (1 + EPS) >= least[row]) & (bucket.ids[some] != asked[row])]
            if len(some):
                best.add(np.array([row]), products(q[row][None].astype(np.int64), bucket.x[some], bound), bucket.ids[some][None])
    rows = go[by_length]
    if len(rows):
        with np.errstate(divide="ignore"):
            needed = np.where(least[rows] > 0, least[rows] / np.maximum(lengths[rows], 1e-300), 0.0) * (1 - EPS)
        long_enough = int(np.searchsorted(-bucket.length, -needed.min(), side="right"))
        x, ids = bucket.x[:long_enough], bucket.ids[:long_enough]
        scores = products(q[rows].astype(np.int64), x, bound)
        found = np.where((ids[None] != asked[rows][:, None]) & (scores >= least[rows][:, None]), ids[None], -1)
        if found.shape[1] > best.k:  # the k best of each, and what equals the last of them
            masked = np.where(found >= 0, scores, np.iinfo(np.int64).min)
            edge = np.partition(masked, found.shape[1] - best.k, axis=1)[:, found.shape[1] - best.k]
            found = np.where(masked >= edge[:, None], found, -1)
            keep = (found >= 0).any(0)
            found, scores = found[:, keep], scores[:, keep]
        if found.shape[1]:
            best.add(rows, scores, found)


FOUND = "query_id long, vec_id long, score long"


def _searched(k: int):
    """Shelves, sorted by the block of queries that each is to be searched for, to what a block finds in all shelves of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, asked, q, lengths, best = None, None, None, None, None

        def found() -> pa.RecordBatch:
            at, place = np.nonzero(best.ids >= 0)
            columns = [pa.array(c) for c in (asked[at], best.ids[at, place], best.score[at, place])]
            return pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])

        for batch in batches:
            for row in range(len(batch)):
                get = lambda name: batch.column(name)[row].as_py()  # noqa: E731, B023
                dim = get("dim")
                if get("block") != block:
                    if best is not None:
                        yield found()
                    block, asked = get("block"), np.frombuffer(get("asked"), np.int64)
                    q = np.frombuffer(get("queries"), np.int64).reshape(-1, dim).astype(np.float64)
                    lengths = np.sqrt((q**2).sum(1))
                    best = Best(len(asked), k, np.frombuffer(get("least"), np.float64))
                ids = np.frombuffer(get("ids"), np.int64)
                x = np.frombuffer(get("vectors"), np.int64).reshape(-1, dim)
                for a in range(0, len(ids), BUCKET_ROWS):
                    visit(Bucket(ids[a : a + BUCKET_ROWS], x[a : a + BUCKET_ROWS]), asked, q, lengths, best)
        if best is not None:
            yield found()

    return run


BLOCK = "block long, dim int, asked binary, queries binary, least binary, easiest double"


def _blocks(asked: DataFrame, block_rows: int) -> DataFrame:
    """One row a block of queries (vec_id, dim, v, least): packed, with the least over length that any of them must reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = batch.take(pa.array(np.flatnonzero(dims == dim)))
                for a in range(0, len(own), block_rows):
                    some = own.slice(a, block_rows)
                    ids, q, least = some.column("vec_id").to_numpy(), _rows(some.column("v")), some.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
                    with np.errstate(divide="ignore"):
                        easiest = np.where(least > 0, least / np.maximum(np.sqrt((q.astype(np.float64) ** 2).sum(1)), 1e-300), 0.0).min()
                    data = [[part << 32 | number], [int(dim)], [ids.tobytes()], [q.tobytes()], [least.tobytes()], [float(easiest)]]
                    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(d, t) for d, t in zip(data, kinds, strict=True)], names=[x.split()[0] for x in BLOCK.split(", ")])
                    number += 1

    # like thresholds stand together, so that whole blocks pass over shelves
    ranges = max(1, min(100_000, -(-asked.count() // block_rows)))
    order = ("dim", F.col("least") / F.greatest(F.sqrt("norm2"), F.lit(0.5)), "vec_id")
    return asked.repartitionByRange(ranges, *order).select("vec_id", "dim", "v", "least").mapInArrow(tidy(run), BLOCK)


def _meet(asked: DataFrame, stock: DataFrame, k: int, block_rows: int) -> DataFrame:
    """What queries find in those shelves of stock that can hold it, as a materialized table.

    Blocks and shelves are long rows; only their numbers meet to tell which of them go together.
    """
    blocks = materialize(_blocks(asked, block_rows), "blocks")
    size = F.octet_length  # eight bytes an id
    pairs = blocks.select("block", "dim", "easiest", size("asked").alias("q")).join(stock.select("shelf", "dim", "longest", size("ids").alias("x")), "dim")
    pairs = materialize(pairs.where(F.col("longest") * (1 + EPS) >= F.col("easiest")).select("block", "shelf", (F.col("q") / 8.0 * F.col("x") / 8.0).alias("work")), "pairs")
    both = pairs.join(blocks, "block").join(stock.select("shelf", "longest", "ids", "vectors"), "shelf")
    work = pairs.agg(F.sum("work")).first()[0] or 0.0
    known = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(known, min(100_000, math.ceil(work / TASK_PRODUCTS)))
    # a block's shelves come to as many tasks as there are for each block, so that what it finds is merged before it is dealt again
    slots = max(1, math.ceil(tasks / max(1, blocks.count())))
    dealt = both.repartition(tasks, "block", F.pmod(F.xxhash64("shelf"), F.lit(slots))).sortWithinPartitions("block", F.desc("longest"), "shelf")
    found = materialize(dealt.select("block", "dim", "asked", "queries", "least", "ids", "vectors").mapInArrow(tidy(_searched(k)), FOUND), "found")
    release(blocks, pairs)
    return found


def top_products(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = SCALE, shelf_rows: int = SHELF_ROWS, block_rows: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the k largest inner products of each row whose vec_id is divisible by every.

    Vectors are those of floor(scale * x), components as doubles; scores are exact. Candidates
    are all rows but the query's own; ties go to the smaller vec_id; with fewer candidates there
    are fewer rows. Vectors that are null or empty, or hold a null or a number that isn't finite,
    take no part, nor do rows without a vec_id, nor vectors whose scaled components, each made
    longer by 1, have squares of a sum over 2 ** 62: their products may not fit a long. Rows that repeat a vec_id count as one, the least by
    components. A query meets vectors of its own width only. Other columns are ignored; an
    empty table gives an empty result.
    """
    rows = materialize(integers(vectors, scale), "integers")
    stock = materialize(shelves(rows, shelf_rows), "shelves")
    asked = rows.where(F.col("vec_id") % every == 0)
    # each width's shelf of the longest vectors first
    first = stock.groupBy("dim").agg(F.max_by("shelf", F.struct("longest", -F.col("shelf"))).alias("shelf"))
    first = materialize(first, "first")
    ahead = _meet(asked.withColumn("least", F.lit(float("-inf"))), stock.join(first, ["shelf", "dim"], "left_semi"), k, block_rows)
    reached = ahead.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k)
    asked = asked.join(reached.select(F.col("query_id").alias("vec_id"), F.col("least").cast("double").alias("least")), "vec_id", "left").fillna(float("-inf"), ["least"])
    found = _meet(asked, stock.join(first, ["shelf", "dim"], "left_anti"), k, block_rows)
    release(rows, stock, first)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = ahead.unionByName(found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


ORACLE = f"""with g as (select vec_id, min(embedding) as e from embeddings where vec_id is not null and embedding is not null and len(embedding) > 0
  and not list_contains(list_transform(embedding, lambda x: x is null or isnan(x) or isinf(x)), true) group by vec_id),
v as (select vec_id, list_transform(e, lambda x: floor({SCALE} * cast(x as double))) as e from g),
p as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score from v q join v c on len(q.e) = len(c.e) and q.vec_id <> c.vec_id where q.vec_id % 20 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from p qualify rank <= 20"""
