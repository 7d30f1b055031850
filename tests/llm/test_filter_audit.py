"""Operator 13 against a plain version."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomrec.llm import filter_audit
from loomrec.llm.common import ship
from tests.llm.test_operators import LONG, prose

SCHEMA = "doc_id long, text string, lang string, source string, mask int, part string, n long, fingerprint string"


def plain(rows, labels):
    import re

    words = lambda t: [w for w in re.split("[ \t\n\x0b\f\r]+", t) if w]
    ids = {}
    for i, t, _ in rows:
        if i is not None:
            ids.setdefault(t or "", []).append(i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    fails = []
    for i, t, lang in rows:
        t = t or ""
        w = words(t)
        own = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and min(ids[t]) < i}
        fails.append((lang or "", {k for k, v in own.items() if v}, i in good, i in toxic))
    out = []
    for part in {x[0] for x in fails}:
        some = [x for x in fails if x[0] == part]
        made = []
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = some
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                redundant = sum(f in x[1] and bool(x[1] & set(order[:k])) for x in some)
                made.append([part, "".join(order), k + 1, len(left), len(gone), redundant, sum(x[1] == {f} for x in some), sum(x[2] for x in gone), sum(x[3] for x in gone)])
        out += [(*m, total[m[1][m[2] - 1]]) for m in made]
    return sorted(out)


def got(df):
    return sorted((r.part, r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect())


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    ship(spark)
    rng = np.random.default_rng(4)
    texts = [None, "", "   ", LONG, LONG + " x", "A" * 10 + "b" * 90, "A" * 11 + "b" * 89, "x # y", "É" * 50 + "A" * 5]
    texts += [prose(i, 120) for i in range(6)] + [" ".join(f"w{i}" for i in range(n)) for n in (79, 99, 100, 101)]
    texts += [" ".join([f"w{i % k}" for i in range(100)]) for k in (79, 80, 81)] + ["a b " * 60, "a\x0bb\x1cc " * 60]
    rows = [(int(i), texts[rng.integers(len(texts))] if rng.random() < 0.7 else texts[9], str(rng.choice(["en", "de"])), "s") for i in rng.permutation(900)]
    rows += [(None, texts[9], "en", None), (None, "only here", None, None), (3, rows[0][1], "en", None), (3, rows[0][1], "en", None), (-5, texts[12], None, None)]
    labels = [(int(i), int(rng.integers(2)), int(rng.integers(2))) for i in rng.choice(900, 300)] + [(None, 1, 1), (3, None, 1)]
    folder = str(tmp_path_factory.mktemp("audit"))
    spark.createDataFrame([(*r, 1, "p", 2, "f") for r in rows], SCHEMA).repartition(5).write.parquet(f"{folder}/documents")
    docs = spark.read.parquet(f"{folder}/documents")
    return docs, spark.createDataFrame([(*x, "r") for x in labels], "doc_id long, quality int, toxic int, mask string"), plain([r[:3] for r in rows], labels)


def test_audit(tables):
    docs, labels, want = tables
    assert got(filter_audit.audit(docs, labels)) == want


def test_audit_over_many_ranges(tables, monkeypatch):
    """Groups of copies reach over several ranges, and ranges lie within one group."""
    docs, labels, want = tables
    monkeypatch.setattr(filter_audit, "partitions_for", lambda df, each: 14)
    monkeypatch.setattr(filter_audit, "PASSED_ON", 3)
    assert got(filter_audit.audit(docs, labels)) == want


def test_audit_where_fingerprints_are_equal(tables, monkeypatch):
    """Different texts of one fingerprint are no copies, within a range and over several."""
    docs, labels, want = tables
    monkeypatch.setattr(filter_audit, "partitions_for", lambda df, each: 6)
    monkeypatch.setattr(filter_audit, "fingerprint", lambda text: F.pmod(F.length(text), F.lit(2)).cast("long"))
    assert got(filter_audit.audit(docs, labels)) == want


def test_audit_of_nothing(spark, tables):
    docs, labels, _ = tables
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    none = got(filter_audit.audit(docs, labels.limit(0)))
    assert none and not any(r[7] or r[8] for r in none)
