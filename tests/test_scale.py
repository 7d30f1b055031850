"""Work and shuffles that must not grow faster than the input."""

import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomrec.functions import schedule
from loomrec.llm import components, neardup, token_output
from loomrec.llm.queries import tokenizer_file
from loomrec.operators import decode, pairs, rqvae, tasks
from loomrec.plans import queries as plans
from loomrec.session import default_dir


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_beams_that_cannot_win_are_not_scored(spark):
    paths = spark.range(4 * 3000).select(F.array(F.concat(F.lit("a"), (F.col("id") % 4).cast("string")), F.concat(F.lit("b"), F.col("id").cast("string"))).alias("tokens"))
    flat, own, scored = decode.tree(paths), decode.hash_scorer(), []

    def counted(queries, which, prefixes, tokens):
        scored.append(len(tokens))
        return own(queries, which, prefixes, tokens)

    every = decode.search(flat, ["p", "q"], counted, 4, 8)
    whole, counted.most = sum(scored), 0.0
    scored.clear()
    assert decode.search(flat, ["p", "q"], counted, 4, 8) == every
    assert whole > 2 * 12_000 and sum(scored) < whole / 2


def test_queries_of_a_small_file_are_spread(spark, monkeypatch):
    monkeypatch.setattr(plans, "BEAM_QUERIES", 20)
    assert plans.batched_beams(spark, default_dir()).select("query").distinct().count() == plans.table(spark, default_dir(), "customer").count()
    assert "REPARTITION_BY_NUM" in plan_of(plans.batched_beams(spark, default_dir()))


def test_a_tree_is_bounded_by_its_nodes(spark):
    paths = spark.range(50).select(F.concat(F.array_repeat(F.lit("same"), 20), F.array(F.col("id").cast("string"))).alias("tokens")).repartition(7)
    flat = decode.tree(paths, most=20 + 50 + 50)  # a shared beginning counts once
    assert len(flat.token) == 121 and np.diff(flat.first[:21]).min() > 0


def _rows(spark):
    seq = spark.range(4000).select((F.col("id") % 97).cast("string").alias("user_id"), ((F.col("id") * 7) % 31).cast("string").alias("item_id")).distinct()
    return seq.withColumns({"pos": F.col("item_id").cast("int") + 1, "n": F.lit(31)}), spark.range(30).select(F.col("id").cast("string").alias("id"))


def test_pairs_are_counted_where_they_are_made(spark):
    seq, known = _rows(spark)
    got = pairs.cooccurrence(seq, known, parts=3)
    assert sorted(got.collect()) == sorted(pairs.cooccurrence(seq, known).collect()) and got.count() > 100
    assert "hashpartitioning(a#" in plan_of(got) and not any("Exchange" in x and ", b#" in x for x in plan_of(got).splitlines())


def test_partners_run_the_pairs_once(spark):
    seq, known = _rows(spark)
    found = pairs.cooccurrence(seq, known)
    assert plan_of(pairs.partners(found)).count("Range (") == plan_of(found).count("Range (")


def test_interactions_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(plans.fx, "TASK_ROWS", 1000)
    plan = plan_of(plans.history_target_pairs(spark, default_dir()))
    n = plans.fx.parts(spark, default_dir())
    assert n > 1 and "hashpartitioning(user_id" in plan and plan.count(f", {n}), REPARTITION_BY_NUM") >= 4


def test_the_dataset_is_capped_and_split_by_its_keys(spark):
    plan = plan_of(plans.sft_dataset(spark, default_dir()))
    assert "_key" in plan and "instruction" not in plan and "history" not in plan


def test_a_sample_of_grounding_makes_no_pairs(spark):
    plan = plan_of(plans.training_sample(spark, default_dir()))
    assert "p_partkey" in plan and "l_orderkey" not in plan


def test_kept_pieces_are_bounded_and_the_first_stay(monkeypatch):
    monkeypatch.setattr(token_output, "_CACHE_ENTRIES", 100)
    encoder = token_output._Encoder(tokenizer_file("byte_bpe_50k.json"))
    for k in range(5):
        texts = ["the first words stay"] + [f"word{i} of {k}" for i in range(k * 60, k * 60 + 60)]
        ids, sizes = encoder.encode(pa.array(texts))
        assert [list(x) for x in np.split(ids, np.cumsum(sizes)[:-1])] == [list(x) for x in encoder.whole(texts)]
        assert b" words" in encoder.known and len(encoder.known) <= 100 + 130


@pytest.mark.parametrize("name", ["probes", "sequential_examples", "asy_examples", "rebalance_floor_ceiling", "exposure_cap"])
def test_what_reads_the_pairs_is_dealt_by_rows(spark, monkeypatch, name):
    monkeypatch.setattr(plans.fx, "TASK_ROWS", 1000)
    n = plans.fx.parts(spark, default_dir())
    assert n > 1 and plan_of(plans.QUERIES[name](spark, default_dir())).count(f", {n}), REPARTITION_BY_NUM") >= 4


@pytest.mark.parametrize("name", ["probes", "sequential_examples", "asy_examples"])
def test_items_of_histories_are_dealt_by_rows(spark, monkeypatch, name):
    want = sorted(plans.QUERIES[name](spark, default_dir()).collect())
    monkeypatch.setattr(plans.fx, "TASK_ROWS", 1000)
    n, got = plans.fx.parts(spark, default_dir()), plans.QUERIES[name](spark, default_dir())
    dealt = [x for x in plan_of(got).splitlines() if f", {n}), REPARTITION_BY_NUM" in x]
    assert n > 1 and any("hashpartitioning(id#" in x for x in dealt) and any("hashpartitioning(user_id#" in x and ", pos#" in x for x in dealt)
    assert sorted(got.collect()) == want


def test_a_step_reads_its_batch_only(spark, monkeypatch):
    vectors = spark.range(400).select("id", F.array(*(F.sin(F.col("id") * k) for k in range(1, 5))).alias("embedding")).persist()
    config = schedule.CodebookConfig(levels=1, size=4, width=2, hidden=(3,), batch=100, epochs=2, warmup=1, starts=1, reset_every=0, val_share=0.1)
    seen, summed, epoch = [], rqvae.summed, 4

    def watched(rows, *more):
        seen.append((plan_of(rows), sorted(r.id for r in rows.collect())))
        return summed(rows, *more)

    monkeypatch.setattr(rqvae, "summed", watched)
    train, _, n = rqvae.prepared(vectors, config)
    rqvae.train(vectors, config)
    assert n == 360 and len(seen) == 2 * epoch
    for k, (plan, ids) in enumerate(seen):
        assert "PartitionFilters" in plan and "InMemoryTableScan" not in plan and "md5" not in plan
        assert ids == sorted(r.id for r in rqvae.batch_of(train, n, config, k // epoch, k % epoch).collect())


def test_marks_are_not_joined_to_vectors(spark):
    vectors = spark.createDataFrame([(i, [float(i)]) for i in [*range(40), 7]], "id long, embedding array<double>")
    train, held_out, n = rqvae.prepared(vectors, schedule.CodebookConfig(val_share=0.1))
    assert n == train.count() and n + held_out.count() == 41  # a key that two rows share makes no further rows
    assert "Join" not in plan_of(train)


def test_cooccurrence_is_of_all_items_of_all_users(spark):
    """Neither long sequences nor what comes late in them, nor partners after the tenth, are left out."""
    users = {}
    for r in plans.fx.inter(spark, default_dir()).select("user_id", "item_id").collect():
        users.setdefault(r.user_id, set()).add(r.item_id)
    count = Counter(p for s in users.values() for p in itertools.combinations(sorted(s), 2))
    want = {(*p, n) for p, n in count.items() if n > 1}
    assert max(map(len, users.values())) > 60
    assert {(r.a, r.b, r.n) for r in plans.cooccurrence(spark, default_dir()).collect()} == want
    partners = Counter(x for a, b, _ in want for x in (a, b))
    found = plans.similar_partners(spark, default_dir()).collect()
    assert Counter(r["item"] for r in found) == partners and max(r["rank"] for r in found) == max(partners.values()) > 10


def test_visitors_are_compared_by_shingles(monkeypatch):
    """Long documents are compared fewer at a time, and a task gives out its forest when it is full; the links stay."""
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 250)
    monkeypatch.setattr(neardup, "NODES", 4)
    own, seen = neardup.link_matrix, []
    monkeypatch.setattr(neardup, "link_matrix", lambda sets, percent: seen.append(sum(map(len, sets))) or own(sets, percent))
    sets = [np.arange(k % 5 * 1000, k % 5 * 1000 + 100) for k in range(40)]
    away = [k >= 5 for k in range(40)]
    whole = pa.RecordBatch.from_arrays([pa.array([1] * 40), pa.array([0] * 40), pa.array(away), pa.array(range(40)), pa.array(range(40)), pa.array(sets)], names=["cluster", "block", "away", "rep", "comp", "hashes"])
    out = list(neardup._exact_edges(85)(iter([whole.slice(k, 8) for k in range(0, 40, 8)])))
    assert max(seen) <= 500 + 250 + 100 and len(out) > 2 and max(map(len, out)) < 20
    forest = components.Forest()
    for batch in out:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            forest.join(a, b)
    assert all(forest.find(k) == k % 5 for k in range(40))


def test_clusters_of_long_documents_have_more_blocks(spark, monkeypatch):
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join([f"own{k}", *words])) for k in range(30)] + [(100 + k, " ".join([f"few{k}", *words[:40]])) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 2000)
    placed, own = [], neardup.materialize
    monkeypatch.setattr(neardup, "materialize", lambda df, name: placed.append(df.agg(F.max("blocks")).first()[0]) or own(df, name) if name == "clusters" else own(df, name))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert placed[0] >= 6
    assert got == {k: 0 for k in range(30)} | {100 + k: 100 for k in range(3)}


def test_no_text_is_kept_for_the_dataset_of_keys(spark):
    """Neither texts of documents nor descriptions are read for it: a cached table of items held them all."""
    plan = plan_of(plans.sft_dataset(spark, default_dir()))
    assert "genre_set" in plan and not any(x in plan for x in ("long_desc", "blurb", "text:string"))


def test_histories_are_not_shuffled_by_target(spark):
    """The longest texts of the dataset meet the rows where they are made."""
    rows = spark.createDataFrame([("sequential", "b", "u:2", 0, "train", "u:2"), ("asy", "b", "u:2", 0, "val", "u:2")], "task string, _target string, _key string, copy int, split string, _source string")
    own = spark.createDataFrame([("u", 2, ["a", "b"])], "user_id string, pos int, history array<string>")
    items = spark.createDataFrame([(c, f"<{c}>", c, c * 2, c * 3) for c in "ab"], "id string, sid string, name string, short_desc string, long_desc string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = tasks.written(rows, own, items, only=("sequential", "asy"))
        assert sorted((r.task, r.input, r.output) for r in out.collect()) == [("asy", "<a> <b>", "bb"), ("sequential", "<a> <b>", "<b>")]
        lines = plan_of(tasks.written(rows, own, items, only=("sequential", "asy"))).splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    k = next(i for i, x in enumerate(lines) if "collect_list(struct(i" in x)
    above, at = [], depth(lines[k])
    for x in reversed(lines[:k]):
        if depth(x) < at:
            above.append(x)
            at = depth(x)
    assert above and not any("hashpartitioning(_target" in x for x in above)
