"""Operator 5: labels and repeats that clash, training in tasks, and plain versions of trees, calibration and features."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest

from loomrec.llm import toxicity
from loomrec.llm.common import ship
from tests.llm.test_operators import prose

BAD = ["zorgle", "blixt", "quaffed", "snurp"]


def made(n, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words, label = prose(seed * 1000 + i, int(rng.integers(20, 400))).split(), int(rng.random() < 0.4)
        if label:
            for w in rng.choice(BAD, 4):
                words[rng.integers(len(words))] = f"you {w}!"
        rows.append((i, " ".join(words), label))
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    ship(spark)
    return made(240)


def scores(spark, docs, labels, parts=3):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    out = toxicity.score_toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int").repartition(2)).collect()
    return {(r.doc_id, i): r.score for i, r in enumerate(sorted(out, key=lambda r: (r.doc_id is not None, r.doc_id, r.score)))}


def test_training_in_tasks_equals_training_at_hand(spark, rows):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    own = toxicity.train(docs, labels)
    from zlib import crc32

    some = [r for r in rows if crc32(str(r[0]).encode()) % 3 != 1]
    want = toxicity.fit([r[1] for r in some], np.array([r[2] for r in some]))
    assert own.lexicon == pytest.approx(want.lexicon) and {"zorgle", "blixt"} <= set(own.lexicon)
    assert np.allclose(own.knots, want.knots) and np.allclose(own.values, want.values)
    texts = pa.array([r[1] for r in rows] + ["", "you"])
    assert np.allclose(own.score(texts, toxicity.Odds(own.lexicon)), want.score(texts, toxicity.Odds(want.lexicon)))


def test_order_and_clashes_make_no_difference(spark, rows):
    """doc_ids with both labels, labels that repeat, doc_ids with several texts: the same scores in any order; clashing ones teach nothing."""
    docs = [r[:2] for r in rows] + [(i, "another text of it zorgle") for i in range(0, 60, 2)] + [(None, "you zorgle"), (3, None)]
    labels = [(i, y) for i, _, y in rows] + [(i, 1 - y) for i, _, y in rows[::3]] + [(i, y) for i, _, y in rows[::5]] + [(None, 1), (7, None), (9, 5)]
    first = scores(spark, docs, labels)
    assert first == scores(spark, docs[::-1], labels[::-1], 5)
    clean = [(i, y) for i, _, y in rows if i % 3]
    assert first == scores(spark, docs, clean)


def test_very_long_and_empty_texts(spark, rows):
    docs = [r[:2] for r in rows] + [(1000, "zorgle " * 400_000), (1001, ""), (1002, None), (1003, prose(1, 60_000))]
    got = {k[0]: v for k, v in scores(spark, docs, [(i, y) for i, _, y in rows]).items()}
    assert all(0 <= v <= 1 for v in got.values()) and got[1000] > 0.7 and got[1003] < 0.3 and got[1001] == got[1002]


def test_calibration_is_the_least_squares_step_function():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 40):
        raw, y = rng.normal(size=n).round(1), rng.integers(0, 2, n).astype(float)
        knots, values = toxicity.isotonic(raw, y)
        order = np.argsort(raw, kind="stable")
        v = y[order]
        want = [max(min(v[a : b + 1].mean() for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        alone = [i for i in range(n) if (raw == raw[order][i]).sum() == 1]
        assert np.allclose(np.interp(raw[order][alone], knots, values), np.array(want)[alone])


def plain_tree(cells, g, h, depth, least, rate, wide):
    """Splits of a tree level by level, each by trying every feature and cut in every node, and the leaves."""
    node, splits = np.zeros(len(g), int), []
    for level in range(depth):
        own = []
        for k in range(1 << level):
            rows, best = np.flatnonzero(node == k), (0.0, 0, wide)
            value = lambda some: g[some].sum() ** 2 / (h[some].sum() + least)  # noqa: E731, B023
            for j in range(cells.shape[1]):
                gains = [value(rows[cells[rows, j] <= c]) + value(rows[cells[rows, j] > c]) - value(rows) for c in range(wide)]
                c = int(np.argmax(np.round(gains, 12)))
                if gains[c] > best[0] + 1e-9:
                    best = (gains[c], j, c)
            own.append(best[1:])
        splits += own
        node = np.array([2 * k + (cells[i, own[k][0]] > own[k][1]) for i, k in enumerate(node)])
    return splits, np.array([rate * g[node == k].sum() / (h[node == k].sum() + least) for k in range(1 << depth)]), node


def test_trees_take_the_best_splits():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] > 0)).astype(float)
    model = toxicity.Boosted(rounds=3, depth=2, bins=6).fit(x, y)
    cells, raw = model.binned(x), np.full(90, math.log(y.mean() / (1 - y.mean())))
    for splits, leaves in model.trees:
        p = 1 / (1 + np.exp(-raw))
        want, values, node = plain_tree(cells, y - p, p * (1 - p), 2, 1.0, 0.15, 8)
        assert [(j, c) for j, c in splits] == [(j, c) for j, c in want] and np.allclose(leaves, values)
        raw += values[node]
    assert np.allclose(model.raw(x), raw)


def plain_features(text, lexicon):
    def worth(word):
        w = toxicity.fold(word)
        return max((lexicon.get(u, 0.0) for u in ([w, *(w[:n] + "*" for n in (4, 5, 6) if len(w) > n)] if len(w) > 2 else [])), default=0.0)

    words, data = text.split(), text.encode()
    n, size = max(1, len(words)), max(1, len(data))
    hits = [i for i, w in enumerate(words) if worth(w)]
    second = [i for i, w in enumerate(words) if w.lower().strip(".,!?;:") in toxicity.SECOND_PERSON]
    odds = sorted((worth(w) for w in {words[i] for i in hits}), reverse=True)
    near = sum(any(abs(i - j) <= 5 for j in second) for i in hits)
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    upper = [65 <= b <= 90 for b in data]
    inside = sum(chr(data[i]) in "0123456789@$*!|+" and letter(data[i - 1]) and letter(data[i + 1]) for i in range(1, len(data) - 1))
    four = sum(letter(data[i]) and data[i] < 128 and len(set(data[i - 3 : i + 1])) == 1 for i in range(3, len(data)))
    rates = [sum(upper), sum(a and b for a, b in zip(upper, upper[1:], strict=False)), sum(chr(b) in ".,;:!?\"'()[]{}-*#%$&|/" for b in data), data.count(b"!"), inside, four]
    head = [math.log1p(n), 100 * len(hits) / n, sum(odds[:50]), odds[0] if odds else 0.0, len(odds), near / len(hits) if hits else 0.0, (100 * len(second) / n) if hits else 0.0]
    return [*head, *(r / size for r in rates)]


def test_features_and_lexicon():
    rows = made(60, 2)
    labels = np.array([r[2] for r in rows])
    lexicon = toxicity.learn_lexicon([r[1] for r in rows], labels)
    held = lambda unit, label: sum(any(unit in toxicity.units(toxicity.fold(w)) for w in t.split()) for _, t, y in rows if y == label)
    every = {u for _, t, _ in rows for w in t.split() for u in toxicity.units(toxicity.fold(w))}
    want = {}
    for u in every:
        a, b = held(u, 1), held(u, 0)
        value = math.log((a + 0.5) / (labels.sum() + 1)) - math.log((b + 0.5) / (len(labels) - labels.sum() + 1))
        if a >= 3 and value >= 2.5:
            want[u] = value
    assert lexicon == pytest.approx(want)
    texts = [r[1] for r in rows[:20]] + ["", "YOU z0rgle!!! aaaa é!é", "A" * 50, "x", "tu   blixt", "You're qu@ffed; you zorgle", re.sub("a", "4", rows[0][1])]
    got = toxicity.features(pa.array(texts), toxicity.Odds(lexicon))
    assert np.allclose(got, [plain_features(t, lexicon) for t in texts])
