"""Quantiles over ranges, resumable jobs, joint splits, examples in the order of files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomrec.operators import profile, rebalance, tokenize
from loomrec.sources import files


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(size=500).round(2), np.full(400, 0.25), [-1e300, 1e300]])
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(5)
    points = (0.0, 0.01, 0.25, 0.5, 0.5001, 0.9, 0.999, 1.0)
    assert np.allclose(profile.quantiles(rows, "v", points), np.quantile(values, points))
    assert profile.quantiles(rows.where("v is null"), "v", (0.5,)) == [None]
    assert profile.quantiles(rows.where("v = 0.25").limit(1), "v", (0.0, 0.7, 1.0)) == [0.25] * 3
    one = profile.describe(rows, "v", (0.5,)).first()
    assert one.n == len(values) and one.p50 == 0.25
    plan = profile.describe(rows, "v", (0.5,))._jdf.queryExecution().toString()
    assert "percentile" not in plan


def test_a_job_goes_on_where_it_was_killed(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "id long, t string")
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(len(batch))
            yield batch

    source = df.mapInArrow(counted, df.schema)
    plain = tokenize.hashing_encoder(8)

    def dying(texts):
        if "text 17" in texts:
            raise RuntimeError("killed")
        return plain(texts)

    path = f"{tmp_path}/job"
    with pytest.raises(Exception, match="killed"):
        tokenize.embed_job(source, "id", "t", dying, path, 4)
    begun = {(e["turn"], e["part"]) for e in files.Ledger(spark, f"{path}/ledger").entries()}
    assert (0, -1) in begun and 1 <= len(begun) < 5
    first = reads.value
    assert first == 80  # one count and one pass
    # half of a part's files lie there; what was entered isn't done again
    df.limit(3).select("id", F.array(F.lit(1.0).cast("float")).alias("embedding")).write.mode("overwrite").parquet(f"{path}/embeddings/turn=0/part={max(k for _, k in begun) + 1}")
    out = tokenize.embed_job(source, "id", "t", plain, path, 4)
    got = {r.id: r.embedding for r in out.collect()}
    assert len(got) == 40 and all(np.allclose(v, plain([f"text {i}"])[0]) for i, v in got.items())
    assert reads.value == first + 40  # counted, not read again
    whole = {(e["turn"], e["part"]): e for e in files.Ledger(spark, f"{path}/ledger").entries()}
    assert sum(e["rows"] for (_, k), e in whole.items() if k >= 0) == 40 and all(int(e["checksum"]) for (_, k), e in whole.items() if k >= 0)


def test_a_job_begun_with_other_rows_is_refused(spark, tmp_path):
    df = spark.createDataFrame([(i, "x") for i in range(10)], "id long, t string")

    def dying(texts):
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        tokenize.embed_job(df, "id", "t", dying, f"{tmp_path}/job", 2)
    with pytest.raises(ValueError, match="begun with 10 rows in 2 parts, not 9 in 2"):
        tokenize.embed_job(df.where("id > 0"), "id", "t", tokenize.hashing_encoder(8), f"{tmp_path}/job", 2)
    empty = tokenize.embed_job(df.limit(0), "id", "t", dying, f"{tmp_path}/none", 2)
    assert empty.count() == 0


def test_joint_split_keeps_what_hangs_together(spark):
    """Groups tied by a shared history, also over several steps, go to one side; nulls tie nothing."""
    rows = [(f"g{i}", f"h{i}", "a") for i in range(30)] + [("g1", "h2", "b"), ("g2", "h3", "b"), ("g4", "h4", "b"), ("g20", "h1", "b"), (None, "h5", "b"), ("g7", None, "b"), ("g8", None, "b")]
    df = spark.createDataFrame(rows, "target string, history string, task string")
    seen = {True: 0, False: 0}
    for seed in range(6):
        out = rebalance.split_joint(df, "target", 0.4, seed, "history").collect()
        assert len(out) == len(rows)
        by = {}
        for r in out:
            if r.target:
                by.setdefault(r.target, set()).add(r.split)
        assert all(len(v) == 1 for v in by.values())
        assert len(set().union(*(by[f"g{i}"] for i in (1, 2, 3, 20)))) == 1
        seen[by["g7"] == by["g8"]] += 1
        assert {r.split for r in out if r.target is None} == {"train"}
    assert seen[False]
    plain = {r.target: r.split for r in rebalance.split_joint(df, "target", 0.4, 0).collect()}
    want = {r.target: r.split for r in rebalance.split_by_group(df, "target", 0.4, 0).collect()}
    assert plain == want


def test_examples_by_task_in_the_order_of_files(spark, tmp_path):
    rows = [("i", str(k), "o", t, None, k) for t in ("a", "b", "c") for k in range(60)]
    df = spark.createDataFrame(rows, files.SFT + ", n long").repartition(7)
    files.write_by_task(df, f"{tmp_path}/out", "n", files=4)
    assert len(list((tmp_path / "out" / "task=a").glob("*.json"))) > 1
    back = files.read_tasks(spark, f"{tmp_path}/out", "a")
    assert [int(r.input) for r in back.orderBy("place").collect()] == list(range(60))
    scan = back.select("input").inputFiles()
    assert scan and back.count() == 60
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "task" in plan.split("PartitionFilters")[1].split("]")[0]
    # files of other tasks aren't read: what is not JSON there does no harm
    for f in (tmp_path / "out" / "task=b").glob("*.json"):
        f.unlink()
        (f.parent / f.name).write_text(json.dumps({"input": 5}) + "\n{")
    assert {r.task for r in files.read_tasks(spark, f"{tmp_path}/out", "a", "c").collect()} == {"a", "c"}
    assert files.read_tasks(spark, f"{tmp_path}/out").where("task = 'c'").count() == 60


def test_popularity_of_items_held_out(spark):
    """Counted in one pass as candidates by candidate, ties, items without targets and no targets at all included."""
    from loomrec.operators import evaluate

    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(f"i{min(int(x), 25)}", int(k) % 5 == 0) for k, x in enumerate(rng.geometric(0.12, 700))], "item_id string, held boolean")
    top = evaluate.popular_items(rows.where("not held"), 10)
    want = evaluate.metrics(evaluate.with_popular(rows.where("held").select(F.lit("t").alias("task"), F.col("item_id").alias("target")), top))
    key = lambda df: sorted((r.task, r.k, r.n, round(r.recall, 9), round(r.ndcg, 9)) for r in df.collect())
    assert key(evaluate.popularity_metrics(rows, "t", F.col("held"))) == key(want)
    assert evaluate.popularity_metrics(rows.where("not held"), "t", F.col("held")).count() == 0
    alone = evaluate.popularity_metrics(rows.where("held"), "t", F.col("held")).collect()
    assert [r.recall for r in alone] == [0, 0]
