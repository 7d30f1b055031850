"""Training of a residual codebook: k-means on the residuals of the levels before, of several starts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrec.operators import quantize

#: Rows for each code that the first centres are drawn from; they come to the driver.
SEEDING = 30


def projected(vectors: DataFrame, components: int, column: str = "embedding", name: str = "z") -> DataFrame:
    """vectors with name, their first principal components."""
    data = vectors.withColumn("_features", array_to_vector(F.transform(column, lambda v: v.cast("double"))))
    model = PCA(k=components, inputCol="_features", outputCol="_pca").fit(data)
    return model.transform(data).withColumn(name, vector_to_array("_pca")).drop("_features", "_pca")


def _spread(sample: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """First centres: each next one is drawn in proportion to its squared distance to the nearest so far."""
    centres = [sample[rng.integers(len(sample))]]
    d = ((sample - centres[0]) ** 2).sum(1)
    for _ in range(size - 1):
        # where all rows are centres already, any of them again
        at = rng.choice(len(sample), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(sample))
        centres.append(sample[at])
        d = np.minimum(d, ((sample - sample[at]) ** 2).sum(1))
    return np.array(centres)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _round(rows: DataFrame, centres: dict[int, np.ndarray], column: str) -> dict[int, tuple[np.ndarray, np.ndarray, float, list[tuple[float, list[float]]]]]:
    """Of each start: sums and counts by centre, the squared error, and the rows farthest from their centres, one a task."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)
    kinds = "start int, sums array<double>, counts array<double>, error double, far array<struct<d:double,v:array<double>>>"
    far = pa.list_(pa.struct([("d", pa.float64()), ("v", pa.list_(pa.float64()))]))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), far)
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["start", "sums", "counts", "error", "far"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for given in batches:
            if not len(given):
                continue
            x = _matrix(given.column(column), len(given))
            for s, book in sent.value.items():
                at = quantize.nearest_rows(x, book)
                d = ((x - book[at]) ** 2).sum(1)
                sums = np.zeros_like(book)
                np.add.at(sums, at, x)
                own = [sums, np.bincount(at, minlength=len(book)).astype(float), float(d.sum()), (float(d.max()), x[d.argmax()].tolist())]
                held = total.get(s)
                total[s] = own if held is None else [held[0] + own[0], held[1] + own[1], held[2] + own[2], max(held[3], own[3])]
        yield batch([(s, v[0].ravel().tolist(), v[1].tolist(), v[2], [{"d": v[3][0], "v": v[3][1]}]) for s, v in total.items()])

    def add(table: pa.Table) -> pa.Table:
        n = len(table)
        sums, counts = (_matrix(table.column(c).combine_chunks(), n).sum(0).tolist() for c in ("sums", "counts"))
        found = [x for some in table.column("far").to_pylist() for x in some]
        found = sorted(found, key=lambda x: (-x["d"], x["v"]))[: len(counts)]
        return pa.Table.from_batches([batch([(table.column("start")[0].as_py(), sums, counts, sum(table.column("error").to_pylist()), found)])])

    out = rows.select(column).mapInArrow(run, kinds).groupBy("start").applyInArrow(add, kinds).collect()  # codebooks
    sent.unpersist()
    shape = next(iter(centres.values())).shape
    return {r["start"]: (np.array(r["sums"]).reshape(shape), np.array(r["counts"]), r["error"], [(x["d"], list(x["v"])) for x in r["far"]]) for r in out}


def kmeans(rows: DataFrame, size: int, starts: tuple[int, ...] = (0,), column: str = "z", iterations: int = 20, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """The centres of the start of the least squared error, and that error.

    Every round takes all starts on in one job, until they no longer move or the rounds are over. A centre without
    rows goes to the row farthest from its own centre, the next one to the next farthest.
    """
    order = F.xxhash64(F.col(column))
    sample = np.array([r[0] for r in rows.select(column).orderBy(order, F.col(column)).limit(SEEDING * size).collect()])
    if not len(sample):
        raise ValueError("there are no vectors to train on")
    centres = {s: _spread(sample, size, np.random.default_rng(s)) for s in starts}
    live, errors = dict(centres), {}
    for k in range(iterations + 1):
        for s, (sums, counts, error, far) in _round(rows, live, column).items():
            errors[s] = error
            if k == iterations:  # the last round tells the errors only
                continue
            fresh = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], live[s])
            for at, (d, v) in zip(np.flatnonzero(counts == 0).tolist(), far, strict=False):
                if d > 0:
                    fresh[at] = v
            moved = float(((fresh - live[s]) ** 2).sum())
            if moved <= tolerance * max(float((fresh**2).sum()), 1e-12):
                del live[s]
            else:
                centres[s] = live[s] = fresh
        if not live:
            break
    best = min(starts, key=lambda s: (errors[s], s))
    return centres[best], errors[best]


def train(vectors: DataFrame, levels: int = 3, size: int = 256, seeds: tuple[int, ...] = (0,), column: str = "embedding", components: int | None = None) -> DataFrame:
    """level, code and vector. Each level takes the best of several starts; with components, of the first principal ones."""
    spark = vectors.sparkSession
    source = projected(vectors, components, column) if components else vectors.select(F.transform(column, lambda v: v.cast("double")).alias("z"))
    left = source.select(F.monotonically_increasing_id().alias("id"), "z").persist()
    rows: list[tuple[int, int, list[float]]] = []
    kept = left
    for level in range(levels):
        centres, _ = kmeans(left, size, seeds)
        rows += [(level, i, c.tolist()) for i, c in enumerate(centres)]
        if level + 1 < levels:
            # what all levels so far leave, from the vectors themselves: one stage, whatever the level
            left = quantize.encode(kept, spark.createDataFrame(rows, "level int, code int, vector array<double>"), "id", "z").select("id", F.col("residual").alias("z"))
    kept.unpersist()
    return spark.createDataFrame(rows, "level int, code int, vector array<double>")


def errors(vectors: DataFrame, codebook: DataFrame, column: str = "embedding") -> DataFrame:
    """level and error: the mean squared length of what each level of codebook leaves of vectors."""
    rows = vectors.select(F.monotonically_increasing_id().alias("id"), F.transform(column, lambda v: v.cast("double")).alias("z"))
    out = quantize.encode(rows, codebook, "id", "z", errors=True)
    return out.select(F.posexplode("errors").alias("level", "e")).groupBy("level").agg(F.avg("e").alias("error"))
