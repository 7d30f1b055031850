"""Functions and operators on small inputs worked out by hand."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomrec.functions import metrics, schedule, text, vectors
from loomrec.operators import evaluate, pairs, prep, profile, quantize, rebalance, semantic_ids, tasks, tokenize, trie
from loomrec.plans import fixtures as fx
from loomrec.plans.queries import QUERIES
from loomrec.sources import files
from loomrec.streaming import examples


def value(spark, column, **row):
    df = spark.range(1).select(*(v.alias(k) for k, v in row.items())) if row else spark.range(1)
    return df.select(column).first()[0]


def test_strip_knows_all_white_space(spark):
    assert value(spark, text.strip(F.lit("　 a b \n"))) == "a b"


def test_blurb(spark):
    words = [f"w{i}" for i in range(31)]
    for given, want in [(None, ""), ("  ", ""), ("One  two. Three", "One  two."), (" ".join(words[:30]) + ". More", " ".join(words[:30]) + "."), ("  ".join(words) + ". More", " ".join(words[:30]) + "..."), ("No end", "No end"), ("v1.2 is out! Yes", "v1.2 is out!")]:
        assert value(spark, text.blurb(F.lit(given).cast("string"))) == want


def test_descriptions(spark):
    name = F.lit("N")
    assert value(spark, text.item_description(name, F.lit("A,B"))) == "N — A, B"
    assert value(spark, text.item_description(name, F.lit(""))) == "N"
    assert value(spark, text.item_description(name, F.lit(None).cast("string"), F.lit("Hi. Ho"))) == "N. Hi."


def test_sets(spark):
    assert value(spark, text.csv_set(F.lit("A, B,,A"))) == ["A", "B", ""]
    assert value(spark, text.csv_set(F.lit(None).cast("string"))) == []
    assert value(spark, text.csv_raw_set(F.lit("A, B,A"))) == ["A", " B"]
    assert value(spark, text.csv_bag(F.lit("A, B,,A"))) == ["A", "B", "A"]


@pytest.mark.parametrize(("genre", "natural", "article"), [("Action", "action", "an"), ("RPG", "RPG", "an"), ("MMO Game", "MMO game", "an"), ("AI", "AI", "a"), ("UFO", "UFO", "a"), ("Racing", "racing", "a")])
def test_genres(spark, genre, natural, article):
    assert value(spark, text.natural_genre(F.lit(genre))) == natural
    assert value(spark, text.article(F.lit(natural))) == article


def test_semantic_id_text(spark):
    sid = text.sid_tokens(F.array(*map(F.lit, [12, 34, 56, 0])))
    assert value(spark, sid) == "<|sid_start|><|L0_12|><|L1_34|><|L2_56|><|L3_0|><|sid_end|>"
    assert value(spark, text.parse_sid(sid)) == [12, 34, 56, 0]
    assert value(spark, text.parse_sid(F.concat(F.lit("x<|L1_3|>"), sid))) is None
    assert value(spark, text.parse_sid(F.lit("<|L3_9|><|L0_1|><|L2_3|><|L1_2|>"))) == [1, 2, 3, 9]
    assert value(spark, text.parse_sid(F.lit("none"))) is None


def test_dates_and_owners(spark):
    got = [value(spark, text.mixed_date(F.lit(x)).cast("string")) for x in ("Oct 21, 2008", "Oct 2008", "2008-10-21", "soon")]
    assert got == ["2008-10-21", "2008-10-01", "2008-10-21", None]
    assert value(spark, text.owners_midpoint(F.lit("0 - 20000"))) == 10000.0
    assert value(spark, text.owners_midpoint(F.lit(None).cast("string"))) is None


def test_ranking_metrics(spark):
    c = F.array(*map(F.lit, ["a", "b", "t", "d", "t"]))
    assert value(spark, metrics.recall_at(c, F.lit("t"), 2)) == 0 and value(spark, metrics.recall_at(c, F.lit("t"), 3)) == 1
    assert value(spark, metrics.ndcg_at(c, F.lit("t"), 4)) == 0.5 and value(spark, metrics.ndcg_at(c, F.lit("x"), 4)) == 0
    none = F.array().cast("array<string>")
    assert value(spark, metrics.jaccard(none, none)) is None and value(spark, metrics.jaccard(c, none)) == 0


def test_vectors(spark):
    v = lambda *x: F.array(*(F.lit(float(i)) for i in x))
    assert value(spark, vectors.l2_normalize(v(3, 4))) == [0.6, 0.8] and value(spark, vectors.l2_normalize(v(0, 0))) == [0, 0]
    assert value(spark, vectors.last_token(F.array(v(1), v(2), v(3)), F.array(*map(F.lit, [1, 1, 0])), F.lit(False))) == [2.0]
    assert value(spark, vectors.last_token(F.array(v(1), v(2), v(3)), F.array(*map(F.lit, [0, 1, 1])), F.lit(True))) == [3.0]
    with pytest.raises(Exception, match="width"):
        value(spark, vectors.checked(v(1, 2), 3))


def test_schedule(spark):
    rates = [r[0] for r in spark.range(101).select(schedule.Schedule(100, 10, 0.0, 1.0, 0.0).rate(F.col("id"))).collect()]
    assert np.allclose(rates[:3], [0, 0.1, 0.2]) and rates[10] == 1 and abs(rates[55] - 0.5) < 1e-9 and abs(rates[100]) < 1e-12
    with pytest.raises(ValueError, match="unknown"):
        schedule.Schedule(10, kind="steps")
    sizes = [value(spark, schedule.adaptive_batch_size(F.lit(n))) for n in (1, 512, 1024, 100_000)]
    assert sizes == [64, 64, 16, 1]


def test_library_order(spark):
    rows = [("u", [("a", 1), ("b", None), ("c", 5), ("d", 1)])]
    df = spark.createDataFrame(rows, "user_id string, items array<struct<item_id:string,playtime_forever:long>>")
    assert df.select(prep.ranked_library(F.col("items"))).first()[0] == ["c", "a", "d", "b"]


def test_profiles(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (2, "x"), (3, None)], "a int, b string")
    assert [tuple(r) for r in profile.null_profile(df).collect()] == [("b", 50.0)]
    assert profile.duplicate_count(df, "b").first()[0] == 2
    assert profile.describe(df, "a").first()["p50"] == 2
    hist = {r.bin: r.n for r in profile.histogram(spark.createDataFrame([(0.0,), (5.0,), (10.0,), (99.0,), (None,)], "x double"), "x", 2, 0.0, 10.0).collect()}
    assert hist == {0: 1, 1: 3}


def seq_rows(spark, users):
    rows = [(u, k + 1, i, len(s)) for u, s in users.items() for k, i in enumerate(s)]
    return spark.createDataFrame(rows, "user_id string, pos int, item_id string, n long")


def test_pairs_and_cooccurrence(spark):
    seq = seq_rows(spark, {"u": list("xyzx"), "v": list("yx?"), "w": list("a"), "long": list("xyz") * 4})
    known = spark.createDataFrame([(c,) for c in "xyza"], "id string")
    got = pairs.history_target_pairs(seq, known, history=2, per_user=9, long_tail=10).collect()
    assert sorted((r.user_id, r.pos, r.history, r.target) for r in got) == [("u", 2, ["x"], "y"), ("u", 3, ["x", "y"], "z"), ("u", 4, ["y", "z"], "x"), ("v", 2, ["y"], "x")]
    co = pairs.cooccurrence(seq, known, window=3, least=1, long_tail=10)
    assert sorted(map(tuple, co.collect())) == [("x", "y", 2), ("x", "z", 1), ("y", "z", 1)]
    best = pairs.partners(co, 1)
    assert sorted((r["item"], r.partner) for r in best.collect()) == [("x", "y"), ("y", "x"), ("z", "x")]


def test_rebalance(spark):
    rows = [("popular", i) for i in range(30)] + [("rare", 0)]
    df = spark.createDataFrame(rows, "target string, k int")
    counts = {r.target: r["count"] for r in rebalance.rebalance(df, "target", 5, 10, 0, "k").groupBy("target").count().collect()}
    assert counts == {"popular": 10, "rare": 5}
    assert {r.target: r["count"] for r in rebalance.cap_exposure(df, "target", 7, 0, "k").groupBy("target").count().collect()} == {"popular": 7, "rare": 1}


def test_splits(spark):
    df = spark.createDataFrame([(t, i) for t in "abcd" for i in range(3)] + [("e", 0)], "target string, k int")
    by_group = rebalance.split_by_group(df, "target", 0.5, 0)
    sides = {(r.target, r.split) for r in by_group.collect()}
    assert len(sides) == 5 and sum(s == "val" for _, s in sides) == 2
    assert {r.split for r in rebalance.split_by_group(df.where("target = 'a'"), "target", 0.05, 0).collect()} == {"val"}
    within = rebalance.split_within_group(df, "target", 0.01, 0, "k").groupBy("target").agg(F.count_if(F.col("split") == "val").alias("v")).collect()
    assert {r.target: r.v for r in within} == {"a": 1, "b": 1, "c": 1, "d": 1, "e": 0}
    assert rebalance.split_rows(df, 0.05, 0, "target", "k").where("split = 'val'").count() == 1


def test_codebook(spark):
    book = spark.createDataFrame([(0, 0, [0.0, 0.0]), (0, 1, [10.0, 0.0]), (0, 2, [0.0, 10.0]), (1, 0, [-1.0, 1.0]), (1, 1, [0.0, 0.0])], "level int, code int, vector array<double>")
    x = spark.createDataFrame([(1, [9.0, 1.0]), (2, [0.5, -0.5]), (3, [1.0, 9.0]), (4, [5.0, 0.0])], "id long, embedding array<double>")
    got = {r.id: r for r in quantize.encode(x, book).collect()}
    assert [got[k].codes for k in (1, 2, 3, 4)] == [[1, 0], [0, 1], [2, 1], [0, 1]] and got[1].residual == [0, 0]
    back = {r.id: r.vector for r in quantize.decode(quantize.encode(x, book), book).collect()}
    assert back[1] == [9.0, 1.0] and back[3] == [0.0, 10.0]
    used = quantize.usage(quantize.encode(x, book))
    assert quantize.needs_reset(used, 3)
    donors = x.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("level"), "id", F.col("embedding").alias("vector"))
    few = used.where("level = 0 and code = 0")
    fresh = {(r.level, r.code): r.vector for r in quantize.reset_codes(book, few, donors).collect()}
    assert fresh[(0, 0)] == [0, 0] and fresh[(0, 1)] != [10, 0] and fresh[(0, 1)] != fresh[(0, 2)] and fresh[(1, 0)] == [-1, 1]


def test_ids_and_reports(spark):
    codes = spark.createDataFrame([(1, [1, 2, 3]), (2, [4, 5, 6]), (3, [1, 2, 3])], "id long, codes array<int>")
    assert {r.id: r.semantic_ids[3] for r in semantic_ids.add_digit(codes).collect()} == {1: 0, 2: 0, 3: 1}
    with pytest.raises(Exception, match="digits"):
        semantic_ids.add_digit(codes, 1).collect()
    one = semantic_ids.collisions(codes).first()
    assert (one["items"], one.groups, one.colliding_items) == (3, 2, 2) and abs(one.unique_share - 1 / 3) < 1e-12
    used = spark.createDataFrame([(0, 0, 9), (0, 1, 1)], "level int, code int, n long")
    h = semantic_ids.health(semantic_ids.dense_usage(used, 1)).first()
    assert h.codes_used == 2 and h.max_code_share == 0.9 and abs(h.normalized_entropy - (-(0.9 * math.log(0.9) + 0.1 * math.log(0.1)) / math.log(2))) < 1e-12


def test_pair_sampling(spark):
    rows = spark.range(40).select(F.col("id"), F.when(F.col("id") < 4, "small").otherwise("large").alias("g"))
    got = semantic_ids.pairs_within(rows, "g", 50, 0).collect()
    small = {(r.a, r.b) for r in got if r.g == "small"}
    large = [(r.a, r.b) for r in got if r.g == "large"]
    assert small == {(a, b) for b in range(4) for a in range(b)} and len(set(large)) == len(large) == 50 and all(4 <= a < b for a, b in large)
    assert semantic_ids.random_pairs(rows, 100, 0).count() == 100


def test_prefix_pairs_of_large_groups(spark, monkeypatch):
    """The query draws 300 pairs of a group of more, instead of leaving the group out."""
    groups = {(1, 1): range(4), (1, 2): range(10, 36), (2, 1): range(100, 160)}
    rows = [(str(i), [*codes, 0]) for codes, ids in groups.items() for i in ids]
    monkeypatch.setattr(fx, "codes", lambda spark, sf: spark.createDataFrame(rows, "id string, codes array<int>"))
    got = [(r.prefix, r.a, r.b) for r in QUERIES["prefix_pairs"](spark, "").collect()]
    for codes, ids in groups.items():
        every = set(itertools.combinations(sorted(map(str, ids)), 2))
        own = [(a, b) for prefix, a, b in got if prefix == f"{codes[0]}-{codes[1]}"]
        assert len(own) == len(set(own)) == min(300, len(every)) and set(own) <= every


def test_trie_and_search(spark):
    paths = spark.createDataFrame([([1],), ([1, 2],), ([1, 2, 3],)], "tokens array<int>")
    edges = trie.edges(paths)
    allowed = {r.prefix: r.allowed for r in trie.allowed(spark.createDataFrame([("",), ("1",), ("1 2 3",), ("9",)], "prefix string"), edges, "</s>").collect()}
    assert allowed == {"": ["1"], "1": ["2", "</s>"] if "2" < "</s>" else ["</s>", "2"], "1 2 3": ["</s>"], "9": ["</s>"]}
    logs = F.when(F.col("token") == trie.END, -1.0).otherwise(-0.25)
    out = trie.beam_search(spark.createDataFrame([("q",)], "query string"), edges, lambda df: df.withColumn("step", logs), 3, 4)
    assert [(r.tokens, r.logp) for r in out.orderBy("rank").collect()] == [("1", -1.25), ("1 2", -1.5), ("1 2 3", -1.75)]


def test_criteria(spark):
    lookup = spark.createDataFrame([("s1", ["a"], []), ("s2", ["a", "b"], ["c"])], "sid string, genre_set array<string>, category_set array<string>")
    candidates = spark.createDataFrame([("q", 1, "??"), ("q", 2, "s1"), ("q", 3, "s2"), ("r", 1, "s1")], "query string, rank int, candidate string")
    wishes = spark.createDataFrame([("q", ["b"], ["c"]), ("r", None, None), ("t", ["z"], [])], "query string, genres array<string>, categories array<string>")
    assert {r.query: r["rank"] for r in evaluate.first_match(candidates, wishes, lookup).collect()} == {"q": 3, "r": 1, "t": None}


def test_nl_preference(spark):
    rows = [(str(i), f"s{i}", ["Action"] if i < 3 else ["RPG"] if i < 5 else ["Action", "RPG"], ["Co-op"]) for i in range(7)]
    items = spark.createDataFrame(rows, "id string, sid string, genre_set array<string>, category_set array<string>")
    made = tasks.nl_preference(items, min_genre=3, min_combo=2, per_genre=3, per_combo=2)
    kinds = {k: sum(r._key.startswith(k) for r in made.collect()) for k in ("g:", "p:", "c:")}
    assert kinds == {"g:": 6, "p:": 2, "c:": 4}


def test_special_tokens(spark):
    got = [r.token for r in tasks.special_tokens(spark, 3, 8).orderBy("ord").collect()]
    assert len(got) == 34 and got[0] == text.SID_START and got[2] == "<|L0_0|>" and got[-1] == "<|L3_7|>"


def test_token_vectors(spark):
    book = spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [0.0, 3.0])], "level int, code int, vector array<double>")
    v = [np.array(r.vector) for r in tokenize.grounded_vectors(book, 5, 2.0).orderBy("code").collect()]
    assert abs(np.linalg.norm(v[0]) - 1) < 1e-9 and abs(np.linalg.norm(v[1]) - 3) < 1e-9 and abs(v[0] @ v[1]) < 1e-9


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("i", "ü/x", "o", "t", None), ("i", "x", "o", "t", {"genres": ["g"], "categories": []})], files.SFT)
    files.write_examples(rows, f"{tmp_path}/sft")
    text_ = "".join(p.read_text() for p in (tmp_path / "sft").glob("*.json"))
    assert "ü/x" in text_ and text_.count("criteria") == 1
    assert files.read_splits(spark, train=f"{tmp_path}/sft", val=f"{tmp_path}/sft").count() == 4
    tokens = tasks.special_tokens(spark, 1, 2)
    files.write_tokens(tokens, f"{tmp_path}/tokens")
    assert [r.token for r in files.read_tokens(spark, f"{tmp_path}/tokens").orderBy("ord").collect()] == [r.token for r in tokens.orderBy("ord").collect()]
    padded = tokenize.padded(tokenize.word_ids(spark.createDataFrame([(1, "a b c"), (2, "")], "id long, t string"), "t"), 2)
    assert sorted((r.id, r.attention_mask) for r in padded.collect()) == [(1, [1, 1]), (2, [0, 0])]
    files.write_token_matrix(padded, f"{tmp_path}/matrix")
    assert files.read_token_matrix(spark, f"{tmp_path}/matrix", 2).count() == 2
    with pytest.raises(ValueError, match="rows"):
        files.read_token_matrix(spark, f"{tmp_path}/matrix", 3)
    files.append_metrics(spark, f"{tmp_path}/metrics", "r", 1, "train", {"loss": 0.5, "usage": [1.0, 0.5]})
    assert spark.read.parquet(f"{tmp_path}/metrics").count() == 3
    (tmp_path / "users.json").write_text('[{"user_id": "u", "steam_id": "1", "items_count": 1, "items": [{"item_id": "9", "item_name": "n", "playtime_forever": 3, "playtime_2weeks": 0}]}]')
    assert files.read_user_items(spark, f"{tmp_path}/users.json").first()["items"][0].item_id == "9"
    (tmp_path / "c.csv").write_text('AppID,Name\n1,"a ""b""\nc"\n2,\n')
    assert sorted(tuple(r) for r in files.read_catalog_csv(spark, f"{tmp_path}/c.csv", "AppID long, Name string").collect()) == [(1, 'a "b"\nc'), (2, None)]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("i", f"x{k}", "o", "t", None) for k in range(20)], files.SFT)
    files.write_examples(rows, f"{tmp_path}/in")
    step = lambda df: df.select(text.alpaca_prompt(F.col("instruction"), F.col("input")).alias("prompt"))
    examples.run(examples.read(spark, f"{tmp_path}/in"), step, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, step(rows).collect()))


def test_embedding_job_resumes(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "c")], "id long, t string")
    done = tokenize.embed(df.where("id < 2"), "t", tokenize.hashing_encoder(8))
    rest = tokenize.embed(tokenize.left_to_do(df, done, "id"), "t", tokenize.hashing_encoder(8))
    whole = tokenize.embed(df, "t", tokenize.hashing_encoder(8))
    assert sorted(map(str, done.unionByName(rest).collect())) == sorted(map(str, whole.collect()))
