"""Residual vector quantization against a codebook table (level, code, vector)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrec.functions.determinism import hash_key
from loomrec.functions.vectors import add, dot, subtract

#: Codebook values, of all levels, up to which every task gets the whole codebook (64 MB).
CODEBOOK_VALUES = 8_000_000


def codebook_values(codebook: DataFrame) -> int:
    n, width = codebook.agg(F.count("*"), F.max(F.size("vector"))).first()
    return n * (width or 0)


def codebook_arrays(codebook: DataFrame) -> list[np.ndarray]:
    """One matrix a level. A codebook is a model: its size is checked, not assumed."""
    head = codebook.agg(F.count("*"), F.max(F.size("vector"))).first()
    if head[0] * (head[1] or 0) > CODEBOOK_VALUES:
        raise ValueError(f"the codebook has {head[0]} vectors of width {head[1]}; at most {CODEBOOK_VALUES} values are sent to tasks")
    rows = sorted((r["level"], r["code"], r["vector"]) for r in codebook.select("level", "code", "vector").collect())
    levels = sorted({r[0] for r in rows})
    return [np.array([v for at, _, v in rows if at == k], np.float64) for k in levels]


def nearest_rows(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The nearest code of each row, the lowest of equals."""
    out = np.empty(len(x), np.int64)
    norms = (codes**2).sum(1)
    step = max(1, 4_000_000 // max(1, len(codes)))
    for a in range(0, len(x), step):
        own = x[a : a + step]
        # distances from products are not exact: where several are all but least, differences decide
        d = norms - 2 * (own @ codes.T)
        slack = 1e-9 * (1 + (own**2).sum(1) + norms.max())
        near = d <= (d.min(1) + slack)[:, None]
        best = near.argmax(1)
        for i in np.flatnonzero(near.sum(1) > 1):
            some = np.flatnonzero(near[i])
            best[i] = some[((own[i] - codes[some]) ** 2).sum(1).argmin()]
        out[a : a + step] = best
    return out


def _lists(x: np.ndarray) -> pa.Array:
    """A list column of the rows of a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def _sent(codebook: DataFrame) -> DataFrame:
    """codebook, to be broadcast where its values, counted first, are at most CODEBOOK_VALUES: most rows may share a code."""
    head = codebook.agg(F.count("*"), F.max(F.size("vector"))).first()
    return F.broadcast(codebook) if head[0] * (head[1] or 0) <= CODEBOOK_VALUES else codebook


def encode(vectors: DataFrame, codebook: DataFrame, key: str = "id", column: str = "embedding", keep: tuple[str, ...] = (), errors: bool = False) -> DataFrame:
    """key, columns to keep, codes (one a level) and residual, what is left of the vector after the last level.

    With errors also the squared norms of what each level leaves. A codebook too large for every task meets the
    vectors in blocks, level by level.
    """
    if codebook_values(codebook) > CODEBOOK_VALUES:
        return _encode_in_blocks(vectors, codebook, key, column, keep, errors)
    books = vectors.sparkSession.sparkContext.broadcast(codebook_arrays(codebook))
    names = [key, *keep]
    kinds = "".join(f"{c} {vectors.schema[c].dataType.simpleString()}, " for c in names) + "codes array<int>, residual array<double>" + ", errors array<double>" * errors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
            codes, left = [], []
            for book in books.value:
                at = nearest_rows(x, book)
                x = x - book[at]
                codes.append(at)
                left.append((x**2).sum(1))
            made = [_lists(np.stack(codes, 1).astype(np.int32)), _lists(x), *([_lists(np.stack(left, 1))] if errors else [])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], names=[*names, "codes", "residual", "errors"][: len(names) + len(made)])

    return vectors.select(*dict.fromkeys([*names, column])).mapInArrow(run, kinds)


def _blocks_of(rows: DataFrame, key: str, block: int) -> DataFrame:
    """One row for each block of rows (key, r) of like length: number, least and largest length, keys, and the vectors' bytes."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a in range(0, len(batch), block):
                own = batch.slice(a, block)
                x = own.column("r").flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                order = np.argsort(np.array(own.column(key).to_pylist(), object), kind="stable")  # of equals the lowest comes first
                length = np.sqrt((x**2).sum(1))
                keys = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own.column(key).take(pa.array(order)))
                data = [pa.array([part << 32 | number]), pa.array([float(length.min())]), pa.array([float(length.max())]), keys, pa.array([x[order].tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(data, names=["block", "low", "high", "keys", "x"])
                number += 1

    ranges = max(1, min(100_000, -(-rows.count() // block)))
    length = F.sqrt(dot(F.col("r"), F.col("r")))
    placed = rows.select(key, "r").repartitionByRange(ranges, length, F.col(key)).sortWithinPartitions(length, key)
    return placed.mapInArrow(run, f"block long, low double, high double, keys array<{kind}>, x binary")


def nearest_in_blocks(rows: DataFrame, codes: DataFrame, key: str = "id", block: int = 4096) -> DataFrame:
    """key and code, the nearest of codes (code, r) to each of rows (key, r), the lowest of equals, whatever the number of codes.

    A block of rows first meets the block of codes of the most like lengths. The distances found there bound the
    difference in length that any nearer code can have, so that only such blocks of codes are met in a second pass.
    """
    kind = rows.schema[key].dataType.simpleString()
    own = _blocks_of(rows, key, block).persist()
    stock = _blocks_of(codes, "code", block).select(F.col("block").alias("book"), F.col("low").alias("b_low"), F.col("high").alias("b_high"), F.col("keys").alias("codes"), F.col("x").alias("book_x")).persist()
    gap = F.greatest(F.lit(0.0), F.col("b_low") - F.col("high"), F.col("low") - F.col("b_high"))
    # numbers and lengths of blocks only
    ends = own.select("block", "low", "high", F.lit(0).alias("_one")).join(stock.select("book", "b_low", "b_high", F.lit(0).alias("_one")), "_one").select("block", "book", gap.alias("gap"))
    first = ends.groupBy("block").agg(F.min_by("book", F.struct("gap", "book")).alias("book"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                keys, codes = batch.column("keys")[i].values, batch.column("codes")[i].values.to_numpy()
                x = np.frombuffer(batch.column("x")[i].as_py()).reshape(len(keys), -1)
                book = np.frombuffer(batch.column("book_x")[i].as_py()).reshape(len(codes), -1)
                at = nearest_rows(x, book)
                d = ((x - book[at]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), batch.column("block")[i].as_py())), keys, pa.array(d), pa.array(codes[at].astype(np.int32))], names=["block", key, "d", "code"])

    def met(pairs: DataFrame) -> DataFrame:
        both = pairs.join(own, "block").join(stock, "book").repartition("block", "book")
        return both.select("block", "keys", "x", "codes", "book_x").mapInArrow(run, f"block long, {key} {kind}, d double, code int")

    ahead = met(first).persist()
    reach = ahead.groupBy("block").agg(F.max(F.sqrt("d")).alias("reach"))
    rest = ends.join(first.select("block", F.col("book").alias("_first")), "block").where("book <> _first").join(reach, "block").where(F.col("gap") <= F.col("reach") * (1 + 1e-9)).select("block", "book")
    found = ahead.unionByName(met(rest)).groupBy(key).agg(F.min(F.struct("d", "code")).alias("m")).select(key, "m.code").persist()
    found.count()
    for held in (own, stock, ahead):
        held.unpersist()
    return found


def _encode_in_blocks(vectors: DataFrame, codebook: DataFrame, key: str, column: str, keep: tuple[str, ...], errors: bool) -> DataFrame:
    """encode by nearest_in_blocks; key tells rows apart. The codes found of each level stay persisted."""
    levels = [r["level"] for r in codebook.select("level").distinct().orderBy("level").collect()]
    out = vectors.select(key, *keep, F.transform(column, lambda v: v.cast("double")).alias("r"), F.array().cast("array<int>").alias("codes"), F.array().cast("array<double>").alias("errors"))
    for level in levels:
        book = codebook.where(F.col("level") == level).select("code", F.transform("vector", lambda v: v.cast("double")).alias("r"))
        found = nearest_in_blocks(out.select(key, "r"), book, key)
        left = subtract(F.col("r"), F.col("_v"))
        out = out.join(found, key).join(book.select("code", F.col("r").alias("_v")), "code").withColumn("r", left)
        out = out.select(key, *keep, "r", F.concat("codes", F.array("code")).alias("codes"), F.concat("errors", F.array(dot(F.col("r"), F.col("r")))).alias("errors"))
    return out.select(key, *keep, "codes", F.col("r").alias("residual"), *(["errors"] if errors else []))


def nearest_code(vectors: DataFrame, codebook: DataFrame, level: int = 0, key: str = "id", column: str = "embedding") -> DataFrame:
    one = codebook.where(F.col("level") == level).withColumn("level", F.lit(0))
    return encode(vectors, one, key, column).select(key, F.col("codes")[0].alias("code"))


def decode(codes: DataFrame, codebook: DataFrame, key: str = "id") -> DataFrame:
    """key and vector, the sum of its levels' codes."""
    long = codes.select(key, F.posexplode("codes").alias("level", "code"))
    found = long.join(_sent(codebook.select("level", "code", "vector")), ["level", "code"])
    per = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("level", "vector"))).alias("v"))
    total = F.aggregate(F.slice("v", 2, 1 << 30), F.col("v")[0]["vector"], lambda a, x: add(a, x["vector"]))
    return per.select(key, total.alias("vector"))


def level_losses(vectors: DataFrame, codes: DataFrame, codebook: DataFrame, beta: float = 0.1, key: str = "id", column: str = "embedding") -> DataFrame:
    """level, mse (over rows and components) and loss, codebook loss plus beta times commitment, of the residual at each level."""
    start = vectors.select(key, F.transform(column, lambda v: v.cast("double")).alias("r")).join(codes.select(key, "codes"), key)
    levels = codebook.select("level").distinct().count()
    codebook = _sent(codebook)
    out = None
    for k in range(levels):
        book = codebook.where(F.col("level") == k).select(F.col("code").alias("_c"), F.col("vector").alias("_v"))
        start = start.join(book, F.col("codes")[k] == F.col("_c")).withColumn("r", subtract(F.col("r"), F.col("_v"))).drop("_c", "_v")
        mse = F.avg(dot(F.col("r"), F.col("r")) / F.size("r"))
        row = start.agg(F.lit(k).alias("level"), mse.alias("mse"), (mse * (1 + beta)).alias("loss"))
        out = row if out is None else out.unionByName(row)
    return out


def largest_cosine(vectors: DataFrame, key: str = "id", column: str = "embedding", block: int = 2048) -> DataFrame:
    """One row: pairs of different rows and the largest cosine of one.

    The whole matrix is asked for, so each two blocks of rows meet in one group, as a product of
    matrices; a row goes to as many groups as there are blocks.
    """
    rows = vectors.select(F.col(column).alias("v"), F.xxhash64(key).alias("_h"))
    blocks = max(1, -(-rows.count() // block))
    own = rows.withColumn("_b", F.pmod("_h", F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    placed = own.withColumn("_o", other).select(F.least("_b", "_o").alias("i"), F.greatest("_b", "_o").alias("j"), (F.col("_b") > F.col("_o")).alias("right"), "v")

    def compared(table: pa.Table) -> pa.Table:
        x = table.column("v").combine_chunks()
        x = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(table), -1)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        right = np.array(table.column("right"), bool)
        if i == j:
            found = (x @ x.T)[np.triu_indices(len(x), 1)]
        else:
            found = (x[~right] @ x[right].T).ravel()
        return pa.table({"pairs": pa.array([found.size], pa.int64()), "largest": pa.array([found.max() if found.size else None], pa.float64())})

    per = placed.groupBy("i", "j").applyInArrow(compared, "pairs long, largest double")
    return per.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.max("largest").alias("largest"))


def usage(codes: DataFrame) -> DataFrame:
    """level, code and n."""
    return codes.select(F.posexplode("codes").alias("level", "code")).groupBy("level", "code").agg(F.count("*").alias("n"))


def reset_codes(codebook: DataFrame, used: DataFrame, donors: DataFrame, seed: int = 0, dominance: float | None = None) -> DataFrame:
    """codebook with unused codes, and those above the share ``dominance``, replaced by distinct donor vectors.

    donors: (level, id, vector). A level with fewer donors than codes to replace stays as it is. Without any usage nothing is replaced.
    """
    total = used.groupBy("level").agg(F.sum("n").alias("total"))
    state = codebook.join(used, ["level", "code"], "left").join(total, "level", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    over = F.lit(False) if dominance is None or dominance >= 1 else (F.col("n") / F.col("total") > dominance)
    bad = state.where(F.col("total").isNotNull() & ((F.col("n") == 0) | over)).select("level", "code")
    from pyspark.sql import Window

    bad = bad.withColumn("_k", F.row_number().over(Window.partitionBy("level").orderBy("code")))
    need = bad.groupBy("level").agg(F.count("*").alias("_need"))
    order = Window.partitionBy("level").orderBy(hash_key(seed, "donor", F.col("level"), F.col("id")), "id")
    have = donors.withColumn("_k", F.row_number().over(order)).join(donors.groupBy("level").agg(F.count("*").alias("_have")), "level")
    fresh = have.join(need, "level").where("_have >= _need").join(bad, ["level", "_k"]).select("level", "code", F.col("vector").alias("_new"))
    return codebook.join(fresh, ["level", "code"], "left").select("level", "code", F.coalesce("_new", "vector").alias("vector"))


def needs_reset(used: DataFrame, size: int, least_usage: float = 1.0, dominance: float = 0.5) -> bool:
    """Whether some level leaves codes unused or lets one code dominate."""
    per = used.groupBy("level").agg((F.count("*") / size).alias("u"), (F.max("n") / F.sum("n")).alias("m"))
    return not per.where((F.col("u") < least_usage) | (F.col("m") > dominance)).isEmpty()
