"""Operator 3: where decoys come from, and which of them a class is held to."""

import re

import numpy as np

from loomrec.llm import secrets
from tests.llm.test_operators import prose


def plain_cut(text, at, encoding, n):
    """Letters of the text turned so that it begins at a place, word by word."""
    words = [*re.findall("[A-Za-z]+", text[at:]), *re.findall("[A-Za-z]+", text[:at])]
    letters = "".join(words)
    if encoding == "decimal":
        letters = "".join(str((ord(c) | 32) % 10) for c in letters)
    elif "a" not in secrets.INDEX[encoding]:
        letters = letters.upper()
    return "".join(c for c in letters if c in secrets.INDEX[encoding])[:n]


def test_decoys_come_from_the_whole_text():
    text = prose(1, 300)
    for encoding in secrets.NAMES:
        for at in (0, 7, len(text) // 2, len(text) - 1):
            assert secrets._cut(text, at, encoding, 30) == plain_cut(text, at, encoding, 30)
    late = "0 " * 20_000 + text  # prose behind 40,000 characters
    assert len(secrets.decoys(late)) == secrets.DECOYS
    assert secrets.decoys("") == secrets.decoys("0 1 2") == []
    assert len(secrets._cut("ab cd", 3, "lower", 9)) == 4


def test_a_class_of_few_decoys_borrows():
    """With LEAST_DECOYS decoys a class stands for itself; with one fewer the class' other encodings, then other classes, count."""
    lower, base62 = secrets.NAMES.index("lower"), secrets.NAMES.index("base62")
    runs = {(lower, 2, 150): 40}
    n = secrets.LEAST_DECOYS
    strict = {(lower, 2, 199): n, (base62, 2, 10): 5000}
    assert secrets.limits(runs, strict, 0.05) == {}  # its own decoys all score higher
    assert secrets.limits(runs, strict | {(lower, 2, 199): n - 1}, 0.05) == {(lower, 2): 11}
    far = {(lower, 2, 199): n - 1, (base62, 4, 10): 5000}
    assert secrets.limits(runs, far, 0.05) == {(lower, 2): 11}
    digits = {(secrets.DIGITS, 2, 150): 40}
    assert secrets.limits(digits, far, 0.05) == {}  # no decoys of its kind: p-values are 1


def test_runs_of_nineteen_are_not_tested():
    rng = np.random.default_rng(1)
    key = "".join(rng.choice(list(secrets.ALPHABETS["base62"]), 20))
    assert len(secrets.candidates(f"x {key} y", [])) == 1 and secrets.candidates(f"x {key[1:]} y", []) == []
    assert secrets.candidates(f"x {key} y", [(3, 0, 5)]) == []
