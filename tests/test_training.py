"""Training of quantizers: gradients, jobs against plain arrays, restarts, codebook starts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomrec.functions.schedule import CodebookConfig, Position, Schedule
from loomrec.operators import codebook_train, rqvae

CONFIG = CodebookConfig(levels=2, size=6, width=3, hidden=(7, 5), batch=100, epochs=4, warmup=1, peak=5e-3, starts=2, val_share=0.1, save_every=2, reset_every=2)


def data(n=300, d=8):
    rng = np.random.default_rng(1)
    return rng.normal(size=(5, d))[rng.integers(5, size=n)] + 0.3 * rng.normal(size=(n, d))


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data())] + [(999, None)], "id long, embedding array<double>").repartition(3).persist()


def frozen_loss(x, model, at, beta, base):
    """The loss that gradients are of: codes, turns and one side of each error are held at what base gives."""
    z, _ = rqvae.through(x, model.encoder, model.normalize)
    z0, _ = rqvae.through(x, base.encoder, base.normalize)
    r, r0, out, loss = z, z0, 0, 0.0
    for book, book0, a in zip(model.books, base.books, at, strict=True):
        q, q0 = book[a], book0[a]
        loss += ((q - r0) ** 2).mean(1).sum() + beta * ((q0 - r) ** 2).mean(1).sum()
        _, (u, v, w, s) = rqvae.turned(r0, q0)
        out = out + s * (r - 2 * (r * w).sum(1, keepdims=True) * w + 2 * (r * u).sum(1, keepdims=True) * v)
        r, r0 = r - q0, r0 - q0
    y, _ = rqvae.through(out, model.decoder)
    return loss + ((y - x) ** 2).mean(1).sum()


@pytest.mark.parametrize("normalize", [False, True])
def test_gradients_are_finite_differences(normalize):
    x = data(20)
    model = rqvae.initial(8, CodebookConfig(levels=2, size=6, width=3, hidden=(7, 5), normalize=normalize))
    model.books = [b * 6 for b in model.books]
    grad = rqvae.sums(x, model, 0.1)[: len(model.flat())]
    r, at = rqvae.through(x, model.encoder, normalize)[0], []
    for book in model.books:
        a = ((r[:, None] - book[None]) ** 2).sum(2).argmin(1)
        at.append(a)
        r = r - book[a]
    flat, h = model.flat(), 1e-6
    for i in np.random.default_rng(0).choice(len(flat), 80, replace=False):
        up, down = flat.copy(), flat.copy()
        up[i] += h
        down[i] -= h
        slope = (frozen_loss(x, model.like(up), at, 0.1, model) - frozen_loss(x, model.like(down), at, 0.1, model)) / (2 * h)
        assert math.isclose(slope, grad[i], rel_tol=1e-4, abs_tol=1e-5)


def test_turns_give_the_codes():
    rng = np.random.default_rng(2)
    r, q = rng.normal(size=(50, 4)), rng.normal(size=(50, 4))
    assert np.allclose(rqvae.turned(r, q)[0], q)
    out, by = rqvae.turned(np.zeros((1, 4)), q[:1])
    assert np.isfinite(out).all() and np.isfinite(rqvae.turned_back(q[:1], by)).all()


def test_optimizer_and_clipping():
    opt = rqvae.Optimizer(2)
    assert np.allclose(opt.moved(np.array([1.0, -1.0]), np.array([0.5, 0.0]), 0.1), [1 - 0.001 - 0.1, -1 + 0.001], atol=1e-6)
    grad, n = rqvae.clipped(np.array([3.0, 4.0]), 1.0)
    assert n == 5 and np.allclose(grad, [0.6, 0.8], atol=1e-6) and np.allclose(rqvae.clipped(np.array([3.0, 4.0]), None)[0], [3, 4])


def plain_training(rows, model, config, epochs):
    """The same steps over whole batches as arrays, without resets."""
    opt, position, out = rqvae.Optimizer(len(model.flat())), None, []
    x = np.array([r["x"] for r in rows])
    position = Position(Schedule(config.epochs, config.warmup, config.start, config.peak, config.least, config.schedule))
    for _ in range(epochs):
        total = rqvae.sums(x, model, config.beta)
        grad, _ = rqvae.clipped(total[: len(model.flat())] / len(x), config.clip)
        out.append(rqvae.means(total, config.levels, config.beta)["loss"])
        model = model.like(opt.moved(model.flat(), grad, position.last))
        position.advance()
    return model, out


def test_training_over_partitions_equals_arrays(vectors):
    config = CodebookConfig(levels=2, size=6, width=3, hidden=(7, 5), batch=1000, epochs=5, warmup=1, peak=5e-3, starts=2, reset_every=0)
    train, _, n = rqvae.prepared(vectors, config)
    first = rqvae.start(train, n, config).model
    want, losses = plain_training(train.collect(), first.like(first.flat().copy()), config, 5)
    trainer, log = rqvae.train(vectors, config)
    assert np.allclose([m["loss"] for m in log if m["prefix"] == "train"], losses)
    assert np.allclose(trainer.model.flat(), want.flat(), atol=1e-9)
    assert n == 285 and trainer.used.sum() == 2 * 5 * n


def test_loss_falls_and_a_stopped_run_restarts(spark, vectors, tmp_path):
    whole, log = rqvae.train(vectors, CONFIG, f"{tmp_path}/whole")
    own = [m["loss"] for m in log if m["prefix"] == "val"]
    assert own[-1] < own[0] and whole.best == min(own)
    assert all(m["codebook_usage"] and 0 <= m["codebook_max_share"][0] <= 1 for m in log if m["prefix"] == "train")
    rqvae.train(vectors, CONFIG, f"{tmp_path}/part", until=3)  # state of epoch 2 only
    again, rest = rqvae.train(vectors, CONFIG, f"{tmp_path}/part", resume=True)
    assert rest[0]["step"] == 7  # three batches an epoch
    assert np.allclose(again.model.flat(), whole.model.flat(), atol=1e-9) and again.position.step == whole.position.step
    back = rqvae.restored(spark, f"{tmp_path}/whole/final")
    assert np.array_equal(back.model.flat(), whole.model.flat()) and np.array_equal(back.used, whole.used)
    assert back.config == CONFIG and back.position.last == whole.position.last
    metrics = spark.read.parquet(f"{tmp_path}/whole/metrics")
    assert metrics.where("prefix = 'train' and metric = 'loss'").count() == 12 and metrics.where("prefix = 'val' and metric = 'loss'").count() == 4
    assert rqvae.restored(spark, f"{tmp_path}/whole/best").best == whole.best


def test_unused_codes_are_replaced(vectors, spark):
    config = CodebookConfig(levels=1, size=6, width=3, hidden=(4,), batch=1000, epochs=2, kmeans=False, val_share=0.1)
    train, _, n = rqvae.prepared(vectors, config)
    trainer = rqvae.start(train, n, config)
    trainer.model.books[0][:5] = 1e3  # never the nearest
    for number in range(2):
        metrics = trainer.step(train, number)
    assert metrics["resets"] >= 5 and trainer.used.sum() == 0 and np.abs(trainer.model.books[0]).max() < 100
    sent = spark.sparkContext.broadcast(trainer.model)
    before = trainer.model.flat().copy()
    rqvae.evaluated(train, trainer.model, config)
    assert np.array_equal(trainer.model.flat(), before) and trainer.used.sum() == 0  # usage counts in training only
    sent.unpersist()


def test_settings_and_empty_tables(spark, vectors):
    with pytest.raises(ValueError, match="impossible"):
        CodebookConfig(val_share=0.0)
    with pytest.raises(ValueError, match="no vectors"):
        rqvae.train(vectors.where("id < 0"), CONFIG)
    with pytest.raises(ValueError, match="width 8"):
        odd = vectors.where("id < 40").unionByName(spark.createDataFrame([(i, [1.0]) for i in range(2000, 2020)], "id long, embedding array<double>"))
        train, _, n = rqvae.prepared(odd.orderBy("id"), CONFIG)
        rqvae.start(train.orderBy("id"), n, CONFIG)


def test_wide_layers_in_blocks(spark):
    """1024-512-256-128-32 runs as matrices, and equals the column form on narrow layers."""
    from loomrec.functions.vectors import mlp

    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, rng.normal(size=1024).tolist()) for i in range(20)], "id long, x array<double>")
    wide = rqvae.initial(1024, CodebookConfig())
    got = {r.id: r.z for r in rqvae.mapped(rows, spark.sparkContext.broadcast(wide)).collect()}
    assert all(np.allclose(got[r.id], rqvae.through(np.array([r.x]), wide.encoder)[0][0]) for r in rows.collect()) and len(got[0]) == 32
    narrow = rqvae.initial(6, CodebookConfig(levels=1, size=2, width=2, hidden=(4,), normalize=True))
    cut = rows.select("id", F.slice("x", 1, 6).alias("x"))
    want = {r.id: r.z for r in cut.select("id", mlp(F.col("x"), [m.tolist() for m in narrow.encoder], True).alias("z")).collect()}
    assert all(np.allclose(r.z, want[r.id]) for r in rqvae.mapped(cut, spark.sparkContext.broadcast(narrow)).collect())


def test_kmeans_takes_the_best_start(spark, vectors):
    rows = vectors.where("embedding is not null").select(F.col("embedding").alias("z"))
    alone = [codebook_train.kmeans(rows, 5, (s,))[1] for s in range(4)]
    centres, error = codebook_train.kmeans(rows, 5, tuple(range(4)))
    assert math.isclose(error, min(alone), rel_tol=1e-9)
    x = np.array([r.z for r in rows.collect()])
    assert math.isclose(((x[:, None] - centres[None]) ** 2).sum(2).min(1).sum(), error, rel_tol=1e-9)


def test_kmeans_of_few_rows(spark):
    """More codes than rows: every row is a code; empty clusters move to the farthest rows."""
    rows = spark.createDataFrame([([float(i), 0.0],) for i in (0, 0, 1, 10)], "z array<double>")
    centres, error = codebook_train.kmeans(rows, 6)
    assert error == 0 and {tuple(c) for c in centres.tolist()} == {(0.0, 0.0), (1.0, 0.0), (10.0, 0.0)}
    with pytest.raises(ValueError, match="no vectors"):
        codebook_train.kmeans(rows.limit(0), 2)


def test_codebook_of_components(spark, vectors):
    rows = vectors.where("embedding is not null")
    z = codebook_train.projected(rows, 3).select("id", F.col("z").alias("embedding")).persist()
    got = [r.error for r in codebook_train.errors(z, codebook_train.train(z, 3, 5, (0, 1, 2))).orderBy("level").collect()]
    single = [[r.error for r in codebook_train.errors(z, codebook_train.train(z, 1, 5, (s,))).collect()][0] for s in range(3)]
    assert got[0] <= min(single) + 1e-9 and got[0] > got[1] > got[2]
    assert codebook_train.train(rows, 2, 5, (0,), components=3).select(F.max(F.size("vector"))).first()[0] == 3


def test_places_in_a_schedule():
    """A step's rate comes into force by it; the first step has the first rate, a restored place that of its own step."""
    rates = Schedule(100, warmup=10, start=0.0, peak=1.0, least=0.0)
    place = Position(rates)
    assert [place.advance() for _ in range(4)] == [0.0, 0.1, 0.2, pytest.approx(0.3)] and place.step == 4 and place.last == pytest.approx(0.3)
    again = Position.restored(place.state())
    assert again.step == 4 and again.last == again.rate == pytest.approx(0.4) and again.advance() == pytest.approx(0.4)
