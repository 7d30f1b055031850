"""Drivers, exports and jobs on small inputs, against plain versions."""

import collections
import logging
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomrec.functions import schedule, text, vectors
from loomrec.functions.determinism import sample, shuffled
from loomrec.operators import drivers, evaluate, export, prep, semantic_ids, tasks, tokenize, trie
from loomrec.operators import items as it
from loomrec.sources import files


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [(f"{i}", f"Item {i}", "Action,Indie" if i % 2 else "Puzzle", "Co-op" if i % 3 else None, f"About {i}. More.", [i % 2, i % 3, 0, i]) for i in range(12)]
    df = spark.createDataFrame(rows, "id string, name string, genres string, categories string, about string, semantic_ids array<int>")
    return it.items(df.select("id", "semantic_ids"), df.drop("semantic_ids")).persist()


def examples(spark, catalog):
    made = tasks.grounding(catalog)
    wishes = tasks.nl_preference(catalog, min_genre=2, min_combo=2).withColumn("copy", F.lit(0))
    return made[0].unionByName(made[1]).unionByName(wishes)


def test_popularity_evaluation(spark, catalog):
    rows = examples(spark, catalog)
    sequences = spark.createDataFrame([(["3", "5"],), (["3", "99"],), (["5", "3", "7"],)], "item_sequence array<string>")
    found = {(r.task, r.k): r for r in drivers.popularity_evaluation(rows, sequences, catalog, 40).collect()}
    assert set(found) == {(t, k) for t in ("grounding_id2name", "grounding_name2id") for k in (5, 10)}
    assert all(r.n == 40 for r in found.values())
    some = drivers.drawn(rows.where("task = 'grounding_name2id'"), 40).collect()
    top = ["3", "5", "7"]
    gains = [1 / math.log2(top.index(r._target) + 2) if r._target in top else 0 for r in some]
    assert math.isclose(found["grounding_name2id", 5].ndcg, sum(gains) / 40, abs_tol=1e-12)
    # the target is the long description, the candidates are short ones
    assert found["grounding_id2name", 10].recall == 0


def test_model_evaluation(spark, catalog):
    """A model that knows the answers to all but wishes, which get the ids in the order of the tree."""
    rows = examples(spark, catalog)
    sid = catalog.select(F.split("sid", r"(?<=>)(?=<)").alias("tokens"))
    trees = {"sid": trie.edges(sid), "name": trie.name_trie(catalog)}
    asked = rows.withColumn("q", F.concat_ws("|", "task", "_key", F.col("copy").cast("string"), "instruction", "input"))
    answers = asked.where("task <> 'nl_preference'").select(F.col("q").alias("query"), F.regexp_replace("output", r"(?<=>)(?=<)", " ").alias("answer"))

    def knows(df):
        grown = F.concat_ws(" ", F.when(F.col("prefix") != "", F.col("prefix")), F.when(F.col("token") != trie.END, F.col("token")))
        right = F.when(F.col("token") == trie.END, F.col("prefix") == F.col("answer")).otherwise(F.startswith(F.concat("answer", F.lit(" ")), F.concat(grown, F.lit(" "))))
        return df.join(answers, "query", "left").withColumn("step", F.when(right, 0.0).otherwise(-5.0)).drop("answer")

    texts = {"sid": lambda d: d.select("query", "rank", F.replace("tokens", F.lit(" "), F.lit("")).alias("candidate")), "name": lambda d: d.select("query", "rank", F.col("tokens").alias("candidate"))}
    found = {(r.task, r.k): r for r in drivers.model_evaluation(rows, catalog, trees, dict.fromkeys(texts, knows), texts, 3).collect()}
    assert {t for t, _ in found} == {"grounding_id2name", "grounding_name2id", "nl_preference"}
    assert all(r.recall == 1 and r.ndcg == 1 for (t, _), r in found.items() if t != "nl_preference")
    assert found["nl_preference", 10].recall > 0 and all(r.n == 3 for r in found.values())
    lines = [r.line for r in evaluate.formatted(drivers.popularity_evaluation(rows, spark.createDataFrame([(["3"],)], "item_sequence array<string>"), catalog)).collect()]
    assert len(lines) == 4 and all("recall" in x for x in lines)
    with pytest.raises(ValueError, match="no examples"):
        drivers.model_evaluation(rows.where("false"), catalog, trees, dict.fromkeys(texts, knows), texts)


def test_sampled_and_greedy_paths(spark):
    tree = trie.edges(spark.createDataFrame([(["a", "b"],), (["a", "c"],), (["d"],)], "tokens array<string>"))
    share = F.when(F.col("token") == "a", 0.7).when(F.col("token") == "d", 0.3).when(F.col("token") == "b", 0.2).when(F.col("token") == "c", 0.8).otherwise(1.0)
    scores = lambda df: df.withColumn("step", F.ln(share))
    asked = spark.range(2000).select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("query"))
    assert [r.tokens for r in trie.greedy(asked.limit(1), tree, scores).collect()] == ["a c"]
    found = collections.Counter(r.tokens for r in trie.sampled(asked, tree, scores, 1.0).collect())
    for path, p in {"a c": 0.56, "a b": 0.14, "d": 0.3}.items():
        assert abs(found[path] / 2000 - p) < 0.04
    cold = collections.Counter(r.tokens for r in trie.sampled(asked, tree, scores, 0.05).collect())
    assert cold["a c"] == 2000


def test_name_trie(spark, catalog):
    tree = {(r.prefix, r.token) for r in trie.name_trie(catalog).collect()}
    for r in catalog.select("short_desc", "long_desc").collect():
        for d in r:
            assert (d, trie.END) in tree


@pytest.fixture(scope="module")
def vq(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 4))
    book = rng.normal(size=(2, 6, 3)) * [[[1.0]], [[0.3]]]
    encoder, decoder = rng.normal(size=(3, 4)), rng.normal(size=(4, 3))
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    codes = spark.createDataFrame([(k, i, v.tolist()) for k in range(2) for i, v in enumerate(book[k])], "level int, code int, vector array<double>")
    return x, book, encoder, decoder, data, codes


def test_forward_and_metrics(spark, vq):
    x, book, encoder, decoder, data, codes = vq
    left, total, found, errors = x @ encoder.T, 0, [], []
    for level in book:
        at = ((left[:, None] - level[None]) ** 2).sum(2).argmin(1)
        left, total = left - level[at], total + level[at]
        found.append(at)
        errors.append((left**2).mean(1))
    back = total @ decoder.T
    out = export.forward(data, codes, [encoder.tolist()], [decoder.tolist()]).persist()
    rows = sorted(out.collect(), key=lambda r: r.id)
    assert [r.codes for r in rows] == np.stack(found, 1).tolist()
    assert np.allclose([r.quantized for r in rows], total) and np.allclose([r.reconstruction for r in rows], back)
    got = {(r.metric, r.level): r.value for r in export.training_metrics(out, 2, 6, 0.25).collect()}
    recon, vq_loss = ((x - back) ** 2).mean(), 1.25 * (errors[0].mean() + errors[1].mean())
    assert np.allclose([got["loss", None], got["recon_loss", None], got["vq_loss", None]], [recon + vq_loss, recon, vq_loss])
    assert np.isclose(got["avg_residual_norm", None], np.linalg.norm(left, axis=1).mean())
    for k in range(2):
        n = np.bincount(found[k], minlength=6)
        assert np.allclose([got["codebook_usage", k], got["codebook_max_share", k], got["codebook_loss", k], got["commitment_loss", k]], [(n > 0).mean(), n.max() / 40, errors[k].mean(), errors[k].mean()])
    pairs = collections.Counter(zip(*(a.tolist() for a in found), strict=True))
    assert np.isclose(got["unique_ids_proportion", None], sum(n == 1 for n in pairs.values()) / 40)
    batch = np.minimum(np.arange(40) // 25, 1)  # batches of unlike sizes count alike
    own = {r.metric: r.value for r in export.validation_metrics(out.withColumn("b", F.least(F.floor(F.col("id") / 25), F.lit(1))), 2, "b", 0.25).collect()}
    assert np.isclose(own["recon_loss"], np.mean([((x - back) ** 2)[batch == b].mean() for b in (0, 1)]))
    with pytest.raises(Exception, match="width 4"):
        export.forward(data.withColumn("embedding", F.slice("embedding", 1, 3)), codes, [encoder.tolist()]).collect()


def test_export(spark, vq, tmp_path):
    *_, data, codes = vq
    short = data.withColumn("embedding", F.slice("embedding", 1, 3))
    before, after = export.export(short, codes, f"{tmp_path}/ids")
    assert before.first()["items"] == after.first()["items"] == 40 and after.first()["unique_share"] == 1.0
    rows = spark.read.parquet(f"{tmp_path}/ids").collect()
    assert len({tuple(r.semantic_ids) for r in rows}) == 40
    assert all([r.semantic_id_0, r.semantic_id_1, r.semantic_id_2] == r.semantic_ids for r in rows)
    ids = spark.read.parquet(f"{tmp_path}/ids")
    assert {r.id for r in semantic_ids.in_group(ids, 2).collect()} == {r.id for r in rows if r.semantic_ids[0] == 2}


def test_model_state(spark, vq, tmp_path):
    *_, codes = vq
    weights = spark.createDataFrame([(0, 0, [1.0, 2.0]), (0, 1, [3.0, 4.0])], "layer int, row int, values array<double>")
    with pytest.raises(FileNotFoundError):
        files.load_model(spark, f"{tmp_path}/none")
    rate = schedule.Position(schedule.Schedule(1000), 250)
    files.save_model(weights, codes, f"{tmp_path}/m", {"step": 250, "best": 0.5, "schedule": rate.state()})
    back, book, state = files.load_model(spark, f"{tmp_path}/m")
    assert files.parameter_count(back).first()["parameters"] == 4 and book.count() == 12 and state["best"] == 0.5
    again = schedule.Position.restored(state["schedule"])
    assert again.rate == rate.rate and again.advance() == rate.advance() and again.step == 251
    steps = spark.range(1002).select(schedule.Schedule(1000).rate(F.col("id")).alias("r")).collect()
    assert all(math.isclose(r.r, schedule.Position(schedule.Schedule(1000), i).rate, abs_tol=1e-15) for i, r in enumerate(steps))
    plain = schedule.Position(schedule.Schedule(10, kind="cosine"))
    assert plain.rate == 3e-4 and schedule.Position(schedule.Schedule(10, kind="cosine"), 10).rate == pytest.approx(1e-6)


def test_settings():
    for wrong in ({"schedule": "linear"}, {"levels": 0}, {"dominance": 0}):
        with pytest.raises(ValueError):
            schedule.CodebookConfig(**wrong)
    with pytest.raises(ValueError, match="save_steps"):
        schedule.WarmupConfig(four_bit=True)
    assert schedule.WarmupConfig(four_bit=True, save_steps=10).rows == 20_000


def test_embedding_pipeline(spark, tmp_path):
    rng = random.Random(1)
    texts = [None, "", "a b c", "x " * 900, *(" ".join(rng.choices("abcdef", k=rng.randrange(1, 700))) for _ in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    plain = tokenize.hashing_encoder(8)

    def small(rows):
        """A model that can't take more than 5,000 words at once."""
        if len(rows) > 1 and max(len(x.split()) for x in rows) * len(rows) > 5000:
            raise MemoryError
        return plain(rows)

    words = lambda rows: [[len(w) for w in x.split()] for x in rows]
    out = tokenize.embedding_pipeline(df, "id", "t", words, small, str(tmp_path), 20)
    want = plain([x or "" for x in texts]).astype(np.float32)
    assert np.allclose([r.embedding for r in sorted(out.collect(), key=lambda r: r.id)], want)
    matrix = {r.id: r for r in files.read_token_matrix(spark, f"{tmp_path}/tokens", 64).collect()}
    assert matrix[2].input_ids[:4] == [1, 1, 1, 0] and sum(matrix[3].attention_mask) == 20 and sum(matrix[0].attention_mask) == 0
    more = df.unionByName(spark.createDataFrame([(64, "new")], "id long, t string"))

    def only_new(rows):
        assert rows == ["new"]
        return plain(rows)

    assert tokenize.embed_job(more, "id", "t", only_new, f"{tmp_path}/embeddings").count() == 65
    with pytest.raises(ValueError, match="65 embeddings were written for 64 rows"):
        tokenize.embed_job(df, "id", "t", only_new, f"{tmp_path}/embeddings")


def test_batches_of_like_lengths():
    lengths = np.array([3, 1024, 5, 512, 2048, 7])
    parts = [x.tolist() for x in tokenize.like_lengths(lengths, 4, 512)]
    assert parts == [[4], [1], [3, 5, 2, 0]]


def test_dataset_files(spark, catalog, tmp_path):
    made = examples(spark, catalog).withColumn("split", F.when(F.col("copy") == 1, "val").otherwise("train")).persist()
    files.write_dataset(made, str(tmp_path))
    for split in ("train", "val"):
        rows = files.read_examples(spark, f"{tmp_path}/{split}").collect()
        want = [r.input for r in shuffled(made.where(F.col("split") == split), 0, f"order-{split}", "task", "_key", "copy").collect()]
        assert collections.Counter(r.input for r in rows) == collections.Counter(want) and want != sorted(want)
    both = files.read_splits(spark, train=f"{tmp_path}/train", val=f"{tmp_path}/val")
    assert both.count() == made.count()
    assert sample(made, 5, 1, "s", "task", "_key", "copy").count() == 5


def test_lift_and_first_values(spark):
    sets = spark.createDataFrame([("a", ["x"]), ("b", ["x"]), ("c", ["x", "y"])], "id string, genre_set array<string>")
    pair = lambda *p: spark.createDataFrame(p, "a string, b string")
    rows = {r["class"]: r for r in semantic_ids.lift({"random": pair(("a", "c")), "same": pair(("a", "b"))}, sets).collect()}
    assert rows["random"].lift == 1 and rows["same"].lift == 2
    keys = spark.createDataFrame([("a",), ("z",)], "k string")
    data = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 0, "other")], "k string, o int, v string")
    assert sorted(map(tuple, it.first_values(keys, data, "k", "v", "o").collect())) == [("a", "early"), ("z", None)]


def test_probes(spark, catalog):
    rows = examples(spark, catalog)
    assert [(r.probe, r.text) for r in tasks.probes(rows).collect()] == [("id", catalog.where("id = '0'").first()["sid"])]
    assert tasks.probes(rows.where("false")).count() == 0


def test_small_functions(spark, tmp_path):
    row = spark.range(1)
    assert row.select(vectors.safe_divide(F.lit(1.0), F.lit(0.0))).first()[0] == 1e6
    assert row.select(vectors.squared_distance(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(2.0)))).first()[0] == 4.0
    assert row.select(text.instruct("find", F.lit("x"))).first()[0] == "Instruct: find\nQuery: x"
    assert row.select(text.clean_completion(F.lit(" an answer</s></s>\n"), "</s>")).first()[0] == "an answer"
    assert [r.items_count for r in prep.drop_empty_profiles(spark.createDataFrame([(0,), (2,), (None,)], "items_count long")).collect()] == [2]
    files.write_parquet(spark.range(10).withColumn("v", -F.col("id")), f"{tmp_path}/t")
    assert [r.v for r in files.read_parquet(spark, f"{tmp_path}/t", ["v"], 3, "v").collect()] == [-9, -8, -7]
    assert files.read_parquet(spark, f"{tmp_path}/t").count() == 10
    log = files.logger("a", file=f"{tmp_path}/log")
    log.info("hello")
    files.logger("b", file=f"{tmp_path}/other").info("again")
    assert len(logging.getLogger("loomrec").handlers) == 2 and "again" in (tmp_path / "log").read_text()
