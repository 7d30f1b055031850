"""Operator 5: toxicity by gradient-boosted trees over dense features.

A lexicon of words and word beginnings with their log-odds is learnt from labelled rows.
Features are lexicon densities, second-person words near lexicon words, and the rates of
capitals, punctuation and obfuscated words; they are computed in tasks, as is the lexicon.
Histogram-based boosted trees are fitted on the driver to the features of a bounded sample of
labelled rows and calibrated by isotonic regression.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrec.llm.common import materialize, release, tidy, utf8_parts
from loomrec.llm.shingles import blocks

#: Labelled rows that the model is fitted to, at most; all rows are scored.
FIT_ROWS = 6_000
#: Parts of them: a row's features come from a lexicon of the other parts.
FOLDS = 3
#: Texts of label 1 that hold a unit of the lexicon, at least, and its log-odds, at least.
LEAST, ODDS = 3, 2.5
#: The largest log-odds of a text that count, so that length alone adds nothing.
STRONGEST = 50
PREFIXES = (4, 5, 6)
NEAR = 5
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted ustedes tú ti vosotros".split())
EDGE = re.compile(r"^[^\w]+|[^\w]+$")
LEET = str.maketrans("013457@$!|", "oieastasil")
FEATURES = ("words", "lexicon_density", "lexicon_odds", "lexicon_top", "lexicon_distinct", "near_second", "second_density", "capitals", "capital_pairs", "punctuation", "exclamation", "obfuscated", "repeated")


def fold(word: str) -> str:
    """word in lower case, without punctuation at its ends, look-alike characters undone."""
    word = EDGE.sub("", word.lower())
    return word.translate(LEET) if not word.isalpha() and any(c.isalpha() for c in word) else word


def units(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)] if len(word) > 2 else []


class _Units(dict):
    """The units of words as they stand in texts."""

    def __missing__(self, word: str) -> list[str]:
        self[word] = out = units(fold(word))
        return out


def learn_lexicon(texts: list[str], labels: np.ndarray, least: int = LEAST, odds: float = ODDS) -> dict[str, float]:
    """Log-odds of words and beginnings that mark label 1, by the number of texts that hold them."""
    of, toxic, clean = _Units(), Counter(), Counter()
    for text, label in zip(texts, labels, strict=True):
        (toxic if label else clean).update({u for w in set(text.split()) for u in of[w]})
    ones, zeros = int(labels.sum()), int(len(labels) - labels.sum())
    values = {unit: log_odds(n, clean[unit], ones, zeros) for unit, n in toxic.items() if n >= least}
    return {unit: v for unit, v in values.items() if v >= odds}


def log_odds(toxic: int, clean: int, ones: int, zeros: int) -> float:
    """Of a unit that so many texts of either label hold, out of so many."""
    return math.log((toxic + 0.5) / (max(1, ones) + 1)) - math.log((clean + 0.5) / (max(1, zeros) + 1))


def learn_lexicons(rows: DataFrame, labels: np.ndarray, fold_of: np.ndarray, least: int = LEAST, odds: float = ODDS) -> list[dict[str, float]]:
    """learn_lexicon without each fold, and of all: units are counted in tasks over rows (text, _toxic, _fold), those that qualify come back."""
    folds = int(fold_of.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, counts = _Units(), Counter()
        for batch in batches:
            for text, label, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "_toxic", "_fold")), strict=True):
                counts.update((u, label * folds + fold) for u in {u for w in set(text.split()) for u in of[w]})
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in keys], pa.string()), pa.array([k for _, k in keys], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["unit", "k", "n"])

    each = rows.select("text", "_toxic", "_fold").mapInArrow(tidy(run), "unit string, k int, n long").groupBy("unit").agg(*(F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(2 * folds)))
    out: list[dict[str, float]] = []
    wanted = None
    parts = []
    for left_out in [*range(folds), None]:
        keep = [k for k in range(folds) if k != left_out]
        ones, zeros = (int(((labels == v) & np.isin(fold_of, keep)).sum()) for v in (1, 0))
        toxic, clean = (sum(F.col(f"n{v * folds + k}") for k in keep) for v in (1, 0))
        # a little less than the limit, which the driver applies
        near = F.log((toxic + 0.5) / (max(1, ones) + 1)) - F.log((clean + 0.5) / (max(1, zeros) + 1)) >= odds - 1e-6
        some = (toxic >= least) & near
        wanted = some if wanted is None else wanted | some
        parts.append((keep, ones, zeros))
    found = each.where(wanted).collect()  # the lexicons
    for keep, ones, zeros in parts:
        sums = ((r["unit"], sum(r[f"n{folds + k}"] for k in keep), sum(r[f"n{k}"] for k in keep)) for r in found)
        values = {u: log_odds(t, c, ones, zeros) for u, t, c in sums if t >= least}
        out.append({u: v for u, v in values.items() if v >= odds})
    return out


class Odds(dict):
    """The largest log-odds among a word's units; at most ``room`` words are kept."""

    def __init__(self, lexicon: dict[str, float], room: int = 250_000):
        super().__init__()
        self.lexicon, self.room = lexicon, room
        self.heads = {u[:3] for u in lexicon}

    def __missing__(self, word: str) -> float:
        if len(self) >= self.room:
            self.clear()
        head = word[:3].lower()
        if head.isalpha() and len(head) == 3 and head not in self.heads:  # folding leaves such a beginning as it is
            self[word] = 0.0
            return 0.0
        self[word] = out = max((self.lexicon.get(u, 0.0) for u in units(fold(word))), default=0.0)
        return out


# classes of bytes; bytes of characters beyond ASCII count as letters
_UPPER, _LETTER, _PUNCT, _BANG, _SIGN = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_PUNCT[list(b".,;:!?\"'()[]{}-*#%$&|/")] = True
_BANG[33] = True
_SIGN[list(b"0123456789@$*!|+")] = True


def byte_rates(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text: the rates of capitals, pairs of them, punctuation, exclamation marks, signs within words and letters four times over."""
    n = len(data)
    upper, letter = _UPPER[data], _LETTER[data]
    pairs, inside, four = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
    if n > 3:
        pairs[1:] = upper[1:] & upper[:-1]
        inside[1:-1] = _SIGN[data[1:-1]] & letter[:-2] & letter[2:]
        same = data[1:] == data[:-1]
        four[3:] = same[2:] & same[1:-1] & same[:-2] & letter[3:] & (data[3:] < 128)
    sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[offsets]) for x in (upper, pairs, _PUNCT[data], _BANG[data], inside, four)]
    return np.stack(sums, 1) / np.maximum(1, np.diff(offsets))[:, None]


def word_features(text: str, odds_of: Odds) -> list[float]:
    words = text.split()
    n = max(1, len(words))
    hits = {w: v for w in set(words) if (v := odds_of[w])}
    if not hits:
        return [math.log1p(n), 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    at = [i for i, w in enumerate(words) if w in hits]
    second = np.array([i for i, w in enumerate(words) if w.lower().strip(".,!?;:") in SECOND_PERSON], int)
    near = 0
    if len(second):
        after = np.searchsorted(second, at)
        near = int(((np.abs(second[np.minimum(after, len(second) - 1)] - at) <= NEAR) | (np.abs(second[np.maximum(after - 1, 0)] - at) <= NEAR)).sum())
    odds = sorted(hits.values(), reverse=True)
    return [math.log1p(n), 100 * len(at) / n, sum(odds[:STRONGEST]), odds[0], len(odds), near / len(at), 100 * len(second) / n]


def features(texts: pa.Array, odds_of: Odds) -> np.ndarray:
    """One row of FEATURES a text; texts has no nulls."""
    words = np.array([word_features(x, odds_of) for x in texts.to_pylist()]).reshape(len(texts), 7)
    data, offsets = utf8_parts(texts)
    rates = [byte_rates(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in blocks(offsets)]
    return np.hstack([words, np.concatenate([np.zeros((0, 6)), *rates])])


@dataclass
class Boosted:
    """Trees of fixed depth over binned features, with logistic loss."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.15
    bins: int = 32
    least: float = 1.0
    edges: list[np.ndarray] = field(default_factory=list)
    start: float = 0.0
    trees: list[tuple[list[tuple[int, int]], np.ndarray]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        # a feature that is nearly always 0 still gets an edge just above
        self.edges = [np.unique(np.concatenate([e, [np.nextafter(0, 1)]])) for e in self.edges]
        cells = self.binned(x)
        rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start = math.log(rate / (1 - rate))
        raw = np.full(len(y), self.start)
        wide = self.bins + 2
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            node, splits = np.zeros(len(y), np.int64), []
            for level in range(self.depth):
                count = 1 << level
                best = [(0.0, 0, wide)] * count
                for j in range(x.shape[1]):
                    key = node * wide + cells[:, j]
                    sg = np.bincount(key, g, count * wide).reshape(count, wide).cumsum(1)
                    sh = np.bincount(key, h, count * wide).reshape(count, wide).cumsum(1)
                    tg, th = sg[:, -1:], sh[:, -1:]
                    gain = sg**2 / (sh + self.least) + (tg - sg) ** 2 / (th - sh + self.least) - tg**2 / (th + self.least)
                    cut = gain.argmax(1)
                    for k in range(count):
                        if gain[k, cut[k]] > best[k][0] + 1e-9:
                            best[k] = (gain[k, cut[k]], j, int(cut[k]))
                splits += [(j, c) for _, j, c in best]
                feature, cut = np.array([b[1] for b in best]), np.array([b[2] for b in best])
                node = 2 * node + (cells[np.arange(len(y)), feature[node]] > cut[node])
            leaves = self.rate * np.bincount(node, g, 1 << self.depth) / (np.bincount(node, h, 1 << self.depth) + self.least)
            self.trees.append((splits, leaves))
            raw += leaves[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        cells, out, rows = self.binned(x), np.full(len(x), self.start), np.arange(len(x))
        for splits, leaves in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                own = splits[(1 << level) - 1 : (2 << level) - 1]
                feature, cut = np.array([s[0] for s in own]), np.array([s[1] for s in own])
                node = 2 * node + (cells[rows, feature[node]] > cut[node])
            out += leaves[node]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function nearest to y, by pooling adjacent violators, each pool shrunk a little."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []  # sum, count, first, last
    for x, v in zip(raw[order], y[order], strict=True):
        pools.append([float(v), 1.0, float(x), float(x)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, _, last = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][3] = last
    knots, values = [], []
    for s, n, first, last in pools:
        value = (s + 0.5 * (s / n)) / (n + 0.5)
        for x in dict.fromkeys((first, last)):
            knots.append(x)
            values.append(min(1.0, max(0.0, value)))
    return np.array(knots), np.array(values)


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Boosted | None
    knots: np.ndarray
    values: np.ndarray

    def score(self, texts: pa.Array, odds_of: Odds) -> np.ndarray:
        if self.trees is None or not len(texts):
            return np.full(len(texts), float(self.values[0]))
        raw = self.trees.raw(features(texts, odds_of))
        # between knots a small rise keeps the order of the raw scores
        return np.clip(np.interp(raw, self.knots, self.values) * 0.999 + 0.001 / (1 + np.exp(-raw)), 0, 1)


def dealt(labels: np.ndarray, folds: int) -> np.ndarray | None:
    """The fold of each row, so that each fold gets its share of either label; None where there is nothing to tell apart."""
    if len(labels) < 2 * folds or labels.min() == labels.max():
        return None
    out = np.empty(len(labels), int)
    out[np.argsort(labels, kind="stable")] = np.arange(len(labels)) % folds
    return out


def constant(labels: np.ndarray) -> Model:
    """The model of rows with one label only, or too few: its share is every text's score."""
    return Model({}, None, np.zeros(1), np.array([labels.mean() if len(labels) else 0.0]))


def fitted(x: np.ndarray, labels: np.ndarray, fold_of: np.ndarray, lexicon: dict[str, float]) -> Model:
    """A model from features, each row's from a lexicon of the other folds; the raw scores for the calibration come from trees fitted to these."""
    raw = np.zeros(len(labels))
    for k in range(int(fold_of.max()) + 1):
        own, rest = fold_of == k, fold_of != k
        raw[own] = Boosted().fit(x[rest], labels[rest]).raw(x[own])
    knots, values = isotonic(raw, labels)
    return Model(lexicon, Boosted().fit(x, labels), knots, values)


def fit(texts: list[str], labels: np.ndarray, folds: int = FOLDS) -> Model:
    """A model from a few labelled texts at hand; train does the same over a table."""
    labels = np.asarray(labels, float)
    fold_of = dealt(labels, folds)
    if fold_of is None:
        return constant(labels)
    x = np.zeros((len(labels), len(FEATURES)))
    for k in range(folds):
        own, rest = np.flatnonzero(fold_of == k), np.flatnonzero(fold_of != k)
        x[own] = features(pa.array([texts[i] for i in own], pa.string()), Odds(learn_lexicon([texts[i] for i in rest], labels[rest])))
    return fitted(x, labels, fold_of, learn_lexicon(texts, labels))


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, folds: int = FOLDS) -> Model:
    """A model from at most fit_rows labelled rows of docs that are not held out.

    The rows with the least hashes of doc_id are taken, so that labels keep their shares. A
    doc_id with both labels is left out, as are null labels and texts; of several texts of a
    doc_id the one of the least hash is taken. Texts stay in tasks: units are counted and
    features computed there; a lexicon and 13 numbers a row come to the driver.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("_toxic")).where(F.col("doc_id").isNotNull() & F.col("_toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("_toxic").alias("_toxic"), F.max("_toxic").alias("_most")).where(F.col("_toxic") == F.col("_most")).drop("_most")
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit("toxicity")), "doc_id").limit(fit_rows)  # two integers a row
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    own = F.struct(F.xxhash64("text").alias("h"), "text")
    rows = materialize(rows.groupBy("doc_id", "_toxic").agg(F.min(own).alias("t")).select("doc_id", "_toxic", F.col("t.text").alias("text")), "labelled")
    ids = sorted((r["doc_id"], r["_toxic"]) for r in rows.select("doc_id", "_toxic").collect())
    y = np.array([v for _, v in ids], float)
    fold_of = dealt(y, folds)
    if fold_of is None:
        release(rows)
        return constant(y)
    spark = docs.sparkSession
    places = spark.createDataFrame([(i, k, int(f)) for k, ((i, _), f) in enumerate(zip(ids, fold_of, strict=True))], "doc_id long, _place int, _fold int")
    rows = rows.join(F.broadcast(places), "doc_id")
    *lexicons, lexicon = learn_lexicons(rows, y, fold_of)
    sent = spark.sparkContext.broadcast(lexicons)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds_of = [Odds(x) for x in sent.value]
        for batch in batches:
            fold, place, text = (batch.column(c) for c in ("_fold", "_place", "text"))
            for k in range(folds):
                at = pa.array(np.flatnonzero(fold.to_numpy() == k))
                if len(at):
                    x = features(text.take(at), odds_of[k])
                    yield pa.RecordBatch.from_arrays([place.take(at), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["place", "x"])

    x = np.zeros((len(y), len(FEATURES)))
    for r in rows.select("_fold", "_place", "text").mapInArrow(tidy(run), "place int, x array<double>").collect():
        x[r["place"]] = r["x"]
    sent.unpersist()
    return fitted(x, y, fold_of, lexicon)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs.

    A null text is scored as an empty one; a null doc_id is not held out. Texts are scored
    whole, however long. Rows that share a doc_id are scored each for itself. A doc_id that is
    labelled twice is learnt from once, or not at all if its labels differ; the order of rows
    and labels makes no difference (see train). Without labels every score is 0. Other columns, lang
    and source among them, are ignored; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, fit_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        odds_of = Odds(own.lexicon)
        for batch in (whole.slice(a, 500) for whole in batches for a in range(0, len(whole), 500)):
            scores = own.score(batch.column("text").fill_null(""), odds_of)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")
