"""Operator 11 against all pairs."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomrec.llm import names
from loomrec.llm.common import ship


def distance(a, b):
    """The unrestricted Damerau-Levenshtein distance by the whole table."""
    big, last = len(a) + len(b), {}
    d = [[big] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i in range(1, len(a) + 1):
        col = 0
        for j in range(1, len(b) + 1):
            r, c = last.get(b[j - 1], 0), col
            same = a[i - 1] == b[j - 1]
            col = j if same else col
            d[i + 1][j + 1] = min(d[i][j] + (not same), d[i + 1][j] + 1, d[i][j + 1] + 1, d[r][c] + (i - r - 1) + 1 + (j - c - 1))
        last[a[i - 1]] = i
    return d[-1][-1]


def test_distance_is_unrestricted():
    assert distance("ca", "abc") == 2 and distance("abcd", "badc") == 2 and distance("", "ab") == 2


text = st.text(alphabet="abc", max_size=8)


@settings(max_examples=400, deadline=None)
@given(st.lists(text, max_size=12, unique=True), text, st.integers(0, 4))
def test_trie_finds_what_all_pairs_do(some, visitor, most):
    want = sorted((x, d) for x in some if (d := distance(x, visitor)) <= most)
    assert sorted(names.Trie(some).within(visitor, most)) == want


@settings(max_examples=600, deadline=None)
@given(text, st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9), st.sampled_from("abcd")), max_size=4))
def test_edits_leave_a_piece(name, edits):
    """Whatever is done to a name, one of its pieces stands in the outcome where it is looked for."""
    other = name
    for kind, at, c in edits:
        at = at % (len(other) + 1)
        if kind == 0:
            other = other[:at] + c + other[at:]
        elif kind == 1:
            other = other[:at] + other[at + 1 :]
        elif kind == 2 and at < len(other):
            other = other[:at] + c + other[at + 1 :]
        elif kind == 3 and at + 1 < len(other):
            other = other[:at] + other[at + 1] + other[at] + other[at + 2 :]
    most = len(edits)
    parts = names.pieces(len(name), most)
    assert all(a >= e + 1 for (a, _), e in zip(parts[1:], [a + n for a, n in parts], strict=False) if len(name) > most)
    assert any(other[w : w + n] == name[a : a + n] for k, (a, n) in enumerate(parts) for w in names._windows(other, len(name), k, a, n, most))


def plain_form(name):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in name if c not in " \t\n\x0b\x0c\r")


def plain_join(clients, vendors, most):
    out = {}
    for v, name in vendors:
        if v is None or name is None:
            continue
        h, n = zlib.crc32(str(v).encode()), len(name)
        if h % 2 == 0 and n >= 2:
            p = h % (n - 1)
            name = name[:p] + name[p + 1] + name[p] + name[p + 2 :]
        for c, other in clients:
            if c is not None and other is not None and plain_form(other) and plain_form(name) and abs(len(plain_form(other)) - len(plain_form(name))) <= most and (d := distance(plain_form(other), plain_form(name))) <= most:
                x = out.setdefault((v, d), [0, c, 0])
                out[(v, d)] = [x[0] + 1, min(x[1], c), x[2] + zlib.crc32(str(c).encode())]
    return sorted((v, d, *x) for (v, d), x in out.items())


@pytest.mark.parametrize(("most", "block"), [(1, 4096), (1, 4), (2, 50)])
def test_join(spark, most, block):
    """Equal and like names, one of a third of all rows, names of one character, of other scripts, very long ones."""
    ship(spark)
    rng = np.random.default_rng(most)
    base = ["".join(rng.choice(list("abé"), n)) for n in (1, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 12) for _ in range(4)] + ["İstanbul Straße", "日本 太郎", "😀 Smith", "x" * 300, "xy" * 150]

    def edited(name):
        for _ in range(rng.integers(0, 4)):
            k = int(rng.integers(len(name) + 1))
            name = [name[:k] + "b" + name[k:], name[:k] + name[k + 1 :], name[:k] + name[k + 1 : k + 2] + name[k : k + 1] + name[k + 2 :], name.upper(), name[:k] + " " + name[k:]][rng.integers(5)]
        return name

    clients = [(int(i), edited(str(rng.choice(base)))) for i in range(260)] + [(1000 + i, "Hot Name") for i in range(90)]
    clients += [(None, "ab"), (5000, None), (5001, ""), (5002, " \t"), (7, "ab"), (7, "ab"), (-3, "hotname")]
    vendors = [(int(i), edited(str(rng.choice(base)))) for i in range(60)] + [(900 + i, "hot nmae") for i in range(5)] + [(50, "ab"), (50, "ab"), (None, "ab"), (60, None), (61, "  "), (62, "x" * 301)]
    c = spark.createDataFrame([(i, x, 1, 2, "v") for i, x in clients], "client_id long, name string, n int, distance int, visitor string").repartition(3)
    v = spark.createDataFrame([(i, x, "p", 3) for i, x in vendors], "vendor_id long, name string, part string, length int").repartition(2)
    got = sorted(map(tuple, names.join_names(c, v, most, block).collect()))
    assert got == plain_join(clients, vendors, most) and len(got) > 40
    if block == 4096:
        assert names.join_names(c.limit(0), v).count() == names.join_names(c, v.limit(0)).count() == 0


def test_misspelling(spark):
    rows = [(i, x) for i in range(40) for x in ("", "a", "ab", "aé😀d", "Ab Cd")]
    df = spark.createDataFrame(rows, "i long, name string").select("i", "name", names.misspelt(names.F.col("name"), names.F.col("i")).alias("x"))
    for r in df.collect():
        h, n, name = zlib.crc32(str(r.i).encode()), len(r.name), r.name
        if h % 2 == 0 and n >= 2:
            p = h % (n - 1)
            name = name[:p] + name[p + 1] + name[p] + name[p + 2 :]
        assert r.x == name
