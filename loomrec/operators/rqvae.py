"""Training of a residual quantizer between two layered networks, data-parallel.

A step is one job: tasks take their rows of the batch through the model, backwards, and sum up
gradients, losses and usage; the sums of all tasks meet in chunks of the parameters, so that no
task adds up a whole model of every other. Only these sums, of the model's size, come to the
driver, which moves the parameters and sends them out for the next step. An epoch's batches are
dealt once, to files of their own, so that a step reads its batch and not the whole table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrec.functions.determinism import hash_key, pick
from loomrec.functions.schedule import CodebookConfig, Position, Schedule
from loomrec.operators import codebook_train, quantize, rebalance
from loomrec.operators.semantic_ids import collisions
from loomrec.session import discard, scratch
from loomrec.sources.files import append_metrics, load_model, save_model

#: Parameters that are summed up together.
CHUNK = 1 << 14
#: Rows of a batch in a task.
TASK_ROWS = 1 << 13
EPS = 1e-6


@dataclass
class Model:
    """Layers (matrices, one row an output) of the encoder and decoder, and one codebook a level."""

    encoder: list[np.ndarray]
    decoder: list[np.ndarray]
    books: list[np.ndarray]
    normalize: bool = False

    def parts(self) -> list[tuple[str, np.ndarray]]:
        return [(f"{name}/{k}", m) for name in ("encoder", "decoder", "books") for k, m in enumerate(getattr(self, name))]

    def flat(self) -> np.ndarray:
        return np.concatenate([m.ravel() for _, m in self.parts()])

    def like(self, flat: np.ndarray) -> Model:
        """A model of this one's shapes."""
        cuts = np.cumsum([0, *(m.size for _, m in self.parts())])
        made = [flat[a:b].reshape(m.shape) for a, b, (_, m) in zip(cuts[:-1], cuts[1:], self.parts(), strict=True)]
        e, d = len(self.encoder), len(self.encoder) + len(self.decoder)
        return Model(made[:e], made[e:d], made[d:], self.normalize)


def initial(width: int, config: CodebookConfig) -> Model:
    """Uniform layers of a range by their inputs, and small uniform codes."""
    rng = np.random.default_rng(config.seed)
    dims = [width, *config.hidden, config.width]

    def layers(sizes: list[int]) -> list[np.ndarray]:
        return [rng.uniform(-1, 1, (b, a)) / np.sqrt(a) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]

    return Model(layers(dims), layers(dims[::-1]), [rng.uniform(-1, 1, (config.size, config.width)) / config.size for _ in range(config.levels)], config.normalize)


# one block of rows through the model


def through(x: np.ndarray, layers: list[np.ndarray], normalize: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """The layers' output, with rectifiers between them, and the input of each layer."""
    given = []
    for k, w in enumerate(layers):
        given.append(x)
        x = x @ w.T
        if k + 1 < len(layers):
            x = np.maximum(x, 0)
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if normalize else x), given


def back(g: np.ndarray, layers: list[np.ndarray], given: list[np.ndarray], normalize: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """The gradient at the input and those of the layers, from that at the output."""
    if normalize:
        y = given[-1] @ layers[-1].T
        n = np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
        y = y / n
        g = (g - y * (g * y).sum(1, keepdims=True)) / n
    grads: list[np.ndarray] = []
    for k in range(len(layers) - 1, -1, -1):
        grads.append(g.T @ given[k])
        g = g @ layers[k]
        if k:
            g = g * (given[k] > 0)
    return g, grads[::-1]


def turned(r: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """r turned and stretched onto q by a map that counts as constant backwards, and that map."""
    lengths = [np.maximum(np.linalg.norm(v, axis=1, keepdims=True), EPS) for v in (r, q)]
    u, v = r / lengths[0], q / lengths[1]
    w = u + v
    w = w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), EPS)
    s = np.linalg.norm(q, axis=1, keepdims=True) / lengths[0]
    out = s * (r - 2 * (r * w).sum(1, keepdims=True) * w + 2 * (r * u).sum(1, keepdims=True) * v)
    return out, (u, v, w, s)


def turned_back(g: np.ndarray, by: tuple[np.ndarray, ...]) -> np.ndarray:
    u, v, w, s = by
    return s * (g - 2 * (g * w).sum(1, keepdims=True) * w + 2 * (g * v).sum(1, keepdims=True) * u)


def sums(x: np.ndarray, model: Model, beta: float, training: bool = True) -> np.ndarray:
    """Gradients, usage of all codes, and losses, each summed over rows: divide by their number for means.

    In evaluation the codes go on as they are, there are no gradients, and no usage is counted.
    """
    z, given = through(x, model.encoder, model.normalize)
    r, out, ways, errors = z, np.zeros_like(z), [], []
    used = [np.zeros(len(b)) for b in model.books]
    for k, book in enumerate(model.books):
        at = quantize.nearest_rows(r, book)
        q = book[at]
        step, by = turned(r, q) if training else (q, ())
        out = out + step
        ways.append((at, r - q, by))
        errors.append(((r - q) ** 2).mean(1).sum())
        if training:
            used[k] = np.bincount(at, minlength=len(book)).astype(float)
        r = r - q
    y, seen = through(out, model.decoder)
    recon = ((y - x) ** 2).mean(1).sum()
    losses = np.array([recon, np.linalg.norm(r, axis=1).sum(), len(x), *errors])
    if not training:
        return losses
    g, decoder = back(2 * (y - x) / x.shape[1], model.decoder, seen)
    at_z, books = np.zeros_like(z), []
    for at, off, by in ways:
        pull = 2 * off / off.shape[1]
        at_z += beta * pull + turned_back(g, by)
        book = np.zeros_like(model.books[len(books)])
        np.add.at(book, at, -pull)
        books.append(book)
    _, encoder = back(at_z, model.encoder, given, model.normalize)
    return np.concatenate([*(m.ravel() for m in (*encoder, *decoder, *books)), *used, losses])


# steps as jobs


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def summed(rows: DataFrame, model: Broadcast, beta: float, training: bool = True) -> np.ndarray:
    """sums over all of rows (x): tasks add up their own, then chunks of the parameters are added up apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                own = sums(_matrix(batch.column("x"), len(batch)), model.value, beta, training)
                total = own if total is None else total + own
        if total is not None:
            cuts = range(0, len(total), CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array([total[a : a + CHUNK].tolist() for a in cuts], pa.list_(pa.float64()))], names=["chunk", "values"])

    def add(table: pa.Table) -> pa.Table:
        column = table.column("values").combine_chunks()
        total = _matrix(column, len(column)).sum(0)
        return pa.table({"chunk": table.column("chunk")[:1], "values": pa.array([total.tolist()], pa.list_(pa.float64()))})

    kinds = "chunk int, values array<double>"
    found = rows.select("x").mapInArrow(run, kinds).groupBy("chunk").applyInArrow(add, kinds).collect()  # of the model's size
    return np.concatenate([np.array(r["values"]) for r in sorted(found, key=lambda r: r["chunk"])]) if found else np.zeros(0)


def means(total: np.ndarray, levels: int, beta: float) -> dict[str, object]:
    """The losses at the end of sums as means."""
    losses = total[-levels - 3 :]
    n = losses[2]
    errors = (losses[3:] / n).tolist()
    recon, vq = float(losses[0] / n), float(sum(errors) * (1 + beta))
    return {"loss": recon + vq, "recon_loss": recon, "vq_loss": vq, "codebook_losses": errors, "commitment_losses": errors, "avg_residual_norm": float(losses[1] / n)}


class Optimizer:
    """Decoupled weight decay with bias-corrected moments."""

    def __init__(self, size: int, decay: float = 0.01, betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8) -> None:
        self.m, self.v, self.step = np.zeros(size), np.zeros(size), 0
        self.decay, self.betas, self.eps = decay, betas, eps

    def moved(self, flat: np.ndarray, grad: np.ndarray, rate: float) -> np.ndarray:
        self.step += 1
        a, b = self.betas
        self.m, self.v = a * self.m + (1 - a) * grad, b * self.v + (1 - b) * grad**2
        up, down = self.m / (1 - a**self.step), np.sqrt(self.v / (1 - b**self.step)) + self.eps
        return flat * (1 - rate * self.decay) - rate * up / down


def clipped(grad: np.ndarray, most: float | None) -> tuple[np.ndarray, float]:
    """grad, shortened to most, and its length before."""
    n = float(np.linalg.norm(grad))
    return (grad * min(1.0, most / (n + 1e-6)) if most else grad), n


class Trainer:
    """The state of a training, which save and resume keep whole: parameters, moments, place in the schedule, best loss, usage."""

    def __init__(self, model: Model, config: CodebookConfig, position: Position) -> None:
        self.model, self.config, self.position = model, config, position
        self.optimizer = Optimizer(len(model.flat()))
        self.used = np.zeros((config.levels, config.size))
        self.best = float("inf")

    @property
    def usage(self) -> tuple[list[float], list[float]]:
        """Of each level the share of codes used, and the largest share of one code, since the last reset."""
        total = np.maximum(self.used.sum(1), 1)
        return (self.used > 0).mean(1).tolist(), (self.used.max(1) / total).tolist()

    def step(self, rows: DataFrame, number: int) -> dict[str, object]:
        """One step over rows (id, x) of a batch; the metrics of it."""
        config, spark = self.config, rows.sparkSession
        sent = spark.sparkContext.broadcast(self.model)
        total = summed(rows, sent, config.beta)
        if not len(total):
            raise ValueError("a batch without rows")
        size, codes = len(self.model.flat()), self.used.size
        metrics = means(total, config.levels, config.beta)
        grad, metrics["grad_norm"] = clipped(total[:size] / total[-config.levels - 1], config.clip)
        self.used += total[size : size + codes].reshape(self.used.shape)
        metrics["lr"], before = self.position.rate, self.model
        self.model = before.like(self.optimizer.moved(before.flat(), grad, self.position.last))
        self.position.advance()
        metrics["codebook_usage"], metrics["codebook_max_share"] = self.usage
        if config.reset_every and (number + 1) % config.reset_every == 0:
            metrics["resets"] = float(self._reset(rows, before, sent, number))
        sent.unpersist()
        return metrics

    def _reset(self, rows: DataFrame, before: Model, sent: Broadcast, number: int) -> int:
        """Replaces codes that nothing uses or that most rows use by residuals of this batch; how many there were."""
        shares = self.used / np.maximum(self.used.sum(1, keepdims=True), 1)
        bad = (self.used == 0) | ((shares > self.config.dominance) & (self.config.dominance < 1))
        breached = [lv for lv in range(self.config.levels) if (self.used[lv] > 0).mean() < self.config.least_usage or shares[lv].max() > self.config.dominance]
        done, most = 0, int(bad[breached].sum(1).max(initial=0)) if breached else 0
        if most:
            # as many rows as codes of a level at most, drawn by hash; those of the batch that are fewer than needed reset nothing
            some = rows.orderBy(hash_key(self.config.seed + number, "donor", F.col("id")), "id").limit(most)
            given = residuals(some, sent)
            for lv in breached:
                at = np.flatnonzero(bad[lv])
                if len(at) and len(given) >= len(at):
                    self.model.books[lv][at] = given[: len(at), lv]
                    done += len(at)
                self.used[lv] = 0
        else:
            self.used[breached] = 0
        return done

    def save(self, spark, path: str) -> None:
        save_state(spark, path, self)


def residuals(rows: DataFrame, model: Broadcast) -> np.ndarray:
    """What each level is given of a few rows, in the order of id: (row, level, component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            m = model.value
            r, _ = through(_matrix(batch.column("x"), len(batch)), m.encoder, m.normalize)
            held = []
            for book in m.books:
                held.append(r)
                r = r - book[quantize.nearest_rows(r, book)]
            flat = np.stack(held, 1).reshape(len(batch), -1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(flat.tolist(), pa.list_(pa.float64()))], names=["id", "r"])

    kind = rows.schema["id"].dataType.simpleString()
    found = sorted(rows.select("id", "x").mapInArrow(run, f"id {kind}, r array<double>").collect(), key=lambda r: r["id"])
    books = len(model.value.books)
    return np.array([r["r"] for r in found]).reshape(len(found), books, -1)


def save_state(spark, path: str, trainer: Trainer) -> None:
    """The trainer as tables: weights (layer, row, values), the moments in the same form, codebook, and one row of state."""

    def table(model: Model) -> DataFrame:
        rows = [(name, i, row.tolist()) for name, m in model.parts() for i, row in enumerate(m)]
        return spark.createDataFrame(rows, "layer string, row int, values array<double>")

    model, opt = trainer.model, trainer.optimizer
    book = spark.createDataFrame([(k, i, v.tolist()) for k, b in enumerate(model.books) for i, v in enumerate(b)], "level int, code int, vector array<double>")
    moments = table(model.like(opt.m)).withColumn("moment", F.lit(1)).unionByName(table(model.like(opt.v)).withColumn("moment", F.lit(2)))
    state = {"step": opt.step, "best": trainer.best, "schedule": trainer.position.state(), "rate": trainer.position.last, "config": trainer.config.state(), "normalize": model.normalize, "used": trainer.used.tolist()}
    save_model(table(model), book, path, state, moments)


def restored(spark, path: str) -> Trainer:
    """The trainer that save_state wrote to path."""
    weights, _, state = load_model(spark, path)

    def model(df: DataFrame) -> Model:
        rows: dict[str, dict[int, list[float]]] = {}
        for r in df.collect():  # a model
            rows.setdefault(r["layer"], {})[r["row"]] = r["values"]
        by: dict[str, list[np.ndarray]] = {"encoder": [], "decoder": [], "books": []}
        for name in sorted(rows, key=lambda x: (x.split("/")[0], int(x.split("/")[1]))):
            by[name.split("/")[0]].append(np.array([rows[name][i] for i in sorted(rows[name])]))
        return Model(by["encoder"], by["decoder"], by["books"], state["normalize"])

    out = Trainer(model(weights), CodebookConfig.restored(state["config"]), Position.restored(state["schedule"]))
    out.position.last = state["rate"]  # that of the step before, as in a run that goes on
    moments = spark.read.parquet(f"{path}/moments")
    out.optimizer.m, out.optimizer.v = (model(moments.where(F.col("moment") == k)).flat() for k in (1, 2))
    out.optimizer.step, out.best, out.used = state["step"], state["best"], np.array(state["used"])
    return out


# a whole training


def evaluated(rows: DataFrame, model: Model, config: CodebookConfig) -> dict[str, object]:
    """Plain means over batches of rows (id, x) of their mean losses, and the share of unique ids of all of them."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            m, x, batch_of = sent.value, _matrix(batch.column("x"), len(batch)), batch.column("batch").to_numpy()
            r, _ = through(x, m.encoder, m.normalize)
            codes, errors, out = [], [], 0
            for book in m.books:
                at = quantize.nearest_rows(r, book)
                codes.append(at)
                out, r = out + book[at], r - book[at]
                errors.append((r**2).mean(1))
            y, _ = through(out, m.decoder)
            columns = [pa.array(batch_of), pa.array(np.stack(codes, 1).astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array(((y - x) ** 2).mean(1)), pa.array(sum(errors) * (1 + config.beta))]
            yield pa.RecordBatch.from_arrays(columns, names=["batch", "codes", "recon_loss", "vq_loss"])

    batches = max(1, -(-rows.count() // config.batch))
    placed = rows.withColumn("batch", pick(batches, config.seed, "validation", F.col("id")).cast("long"))
    out = placed.select("batch", "x").mapInArrow(run, "batch long, codes array<int>, recon_loss double, vq_loss double").persist()
    per = out.groupBy("batch").agg(F.avg("recon_loss").alias("r"), F.avg("vq_loss").alias("q")).agg(F.avg("r"), F.avg("q")).first()
    unique = collisions(out).first()["unique_share"]
    out.unpersist()
    sent.unpersist()
    return {"loss": per[0] + per[1], "recon_loss": per[0], "vq_loss": per[1], "unique_ids_proportion": unique}


def prepared(vectors: DataFrame, config: CodebookConfig, key: str = "id", column: str = "embedding") -> tuple[DataFrame, DataFrame, int]:
    """Training and validation rows (id, x), persisted, and the number of training rows; the shares go by hash of the key.

    Rows without a key or a vector are left out.
    """
    rows = vectors.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).alias("id"), F.transform(column, lambda v: v.cast("double")).alias("x"))
    marked = rebalance.split_rows(rows, config.val_share, config.seed, "id").persist()
    train, val = (marked.where(F.col("split") == s).select("id", "x") for s in ("train", "val"))
    return train, val, train.count()


def start(train: DataFrame, n: int, config: CodebookConfig) -> Trainer:
    """A trainer at step 0: random layers, and codebooks by k-means on what the first batch leaves at each level."""
    width = len(train.first()["x"])
    if not train.where(F.size("x") != width).isEmpty():
        raise ValueError(f"vectors must have width {width}")
    model = initial(width, config)
    if config.kmeans:
        first = batch_of(train, n, config, 0, 0).repartition(_tasks(n, config), "id")
        sent = train.sparkSession.sparkContext.broadcast(replace(model, books=[]))
        book = codebook_train.train(mapped(first, sent), config.levels, config.size, tuple(range(config.starts)), "z")
        for r in book.collect():  # a codebook
            model.books[r["level"]][r["code"]] = r["vector"]
    steps = _batches(n, config) * config.epochs
    return Trainer(model, config, Position(Schedule(steps, config.warmup, config.start, config.peak, config.least, config.schedule)))


def mapped(rows: DataFrame, model: Broadcast) -> DataFrame:
    """id and z, the encoder's output, a block of rows at a time: layers of any width are matrices in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                z, _ = through(_matrix(batch.column("x"), len(batch)), model.value.encoder, model.value.normalize)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(z.tolist(), pa.list_(pa.float64()))], names=["id", "z"])

    return rows.select("id", "x").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, z array<double>")


def _batches(n: int, config: CodebookConfig) -> int:
    return max(1, -(-n // config.batch))


def _tasks(n: int, config: CodebookConfig) -> int:
    """Tasks of one batch."""
    return max(1, -(-min(n, config.batch) // TASK_ROWS))


def _place(n: int, config: CodebookConfig, epoch: int) -> Column:
    """The batch that a row falls into: each epoch deals them anew, by hash."""
    return pick(_batches(n, config), config.seed, f"epoch{epoch}", F.col("id"))


def batch_of(train: DataFrame, n: int, config: CodebookConfig, epoch: int, number: int) -> DataFrame:
    """The rows of one batch of an epoch, found among all rows."""
    return train if _batches(n, config) == 1 else train.where(_place(n, config, epoch) == number)


@contextmanager
def dealt(train: DataFrame, n: int, config: CodebookConfig, epoch: int) -> Iterator[Callable[[int], DataFrame]]:
    """What gives the rows of a batch of an epoch by its number: the rows are dealt once, and a batch's read from a folder of its own."""
    if _batches(n, config) == 1:
        yield lambda number: train
        return
    spark, path = train.sparkSession, scratch(train.sparkSession, "epoch")
    placed = train.withColumns({"batch": _place(n, config, epoch), "_piece": pick(_tasks(n, config), config.seed, "piece", F.col("id"))})
    try:
        placed.repartition(_batches(n, config), "batch", "_piece").drop("_piece").write.partitionBy("batch").parquet(path)
        rows = spark.read.schema(placed.drop("_piece").schema).parquet(path)
        yield lambda number: rows.where(F.col("batch") == number).select("id", "x")
    finally:
        discard(spark, path)


def train(vectors: DataFrame, config: CodebookConfig, path: str | None = None, run: str = "rqvae", resume: bool = False, until: int | None = None, key: str = "id", column: str = "embedding") -> tuple[Trainer, list[dict[str, object]]]:
    """A trained quantizer, and the metrics of each step (prefix train) and each validated epoch (prefix val).

    With a path: metrics are appended there, the state of the least validation loss is kept as
    best, that of every config.save_every epochs as epoch_n, the last one as final. resume goes
    on from the highest epoch_n; until ends after so many epochs. Null vectors are left out.
    """
    spark = vectors.sparkSession
    rows, held_out, n = prepared(vectors, config, key, column)
    if not n:
        raise ValueError("there are no vectors to train on")
    batches = _batches(n, config)
    trainer, first = None, 0
    if resume and path:
        found = _last_epoch(spark, path)
        if found:
            trainer, first = restored(spark, f"{path}/epoch_{found}"), found
    trainer = trainer or start(rows, n, config)
    log: list[dict[str, object]] = []

    def note(prefix: str, step: int, metrics: dict[str, object]) -> None:
        log.append({"prefix": prefix, "step": step, **metrics})
        if path:
            append_metrics(spark, f"{path}/metrics", run, step, prefix, metrics)

    for epoch in range(first, min(config.epochs, until or config.epochs)):
        with dealt(rows, n, config, epoch) as batch:
            for number in range(batches):
                step = epoch * batches + number
                note("train", step + 1, trainer.step(batch(number), step))
        if (epoch + 1) % config.val_every == 0:
            metrics = evaluated(held_out, trainer.model, config)
            note("val", (epoch + 1) * batches, metrics)
            if metrics["loss"] < trainer.best:
                trainer.best = metrics["loss"]
                if path:
                    trainer.save(spark, f"{path}/best")
        if path and (epoch + 1) % config.save_every == 0:
            trainer.save(spark, f"{path}/epoch_{epoch + 1}")
    if path and not until:
        trainer.save(spark, f"{path}/final")
    return trainer, log


def _last_epoch(spark, path: str) -> int:
    """The highest epoch_n under path whose state was written to its end, 0 for none."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return 0
    names = [x.getPath().getName() for x in fs.listStatus(folder)]
    some = [int(x[6:]) for x in names if x.startswith("epoch_") and x[6:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{x}/state/_SUCCESS"))]
    return max(some, default=0)
