"""Operator 3: secrets, by patterns and by a battery of randomness tests.

Three patterns give the base spans. Besides, every run of LEAST_RUN and more encoding characters
is tested: its encoding is inferred, and chi-squared uniformity over that alphabet, a runs test and a
lag-one serial correlation are combined to a score (high: nothing speaks against random).
Every document also gives a few decoys, its ordinary text cut to an alphabet and length, to
the same battery. Within each encoding and class of lengths, the share of decoys that score
as high gives p-values, and runs are reported up to the false-discovery rate ``fdr``, counted
over the whole corpus.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrec.llm.common import materialize, release, tidy

KINDS = ("assign", "access", "hex", "random")
# fixed values: the base patterns
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{32,}")
HINTS = ("password", "passwd", "secret", "token", "api")
#: Characters from which on a run is tested: shorter ones leave the battery too few symbols.
LEAST_RUN = 20
RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST_RUN},}}={{0,2}}")
WORDS = re.compile(r"[A-Za-z]+")
ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
INDEX = {k: {c: i for i, c in enumerate(v)} for k, v in ALPHABETS.items()}
LENGTHS = (24, 32, 48, 64, 96, 128)
BINS = 200
NAMES = tuple(ALPHABETS)
DIGITS = NAMES.index("decimal")
#: Decoys of each document, of as many pairs of an encoding and a length, by a hash of its text in turn.
DECOYS = 4
DECOY_LENGTHS = (20, 24, 32, 48, 64, 96, 128)
#: Decoys from which on an encoding and class of lengths stands for itself; with fewer, all encodings with letters of
#: the class count together, and then all classes. Digits alone are a kind apart: numbers look more random than words.
LEAST_DECOYS = 20


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern spans, in order."""
    out = []
    low = text.lower()
    if any(x in low for x in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # of a run under 32 characters nothing is reported, so only longer ones are looked for
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


def encoding_of(run: str) -> str:
    """The first alphabet that holds every character of run, padding aside."""
    have = set(run.rstrip("="))
    return next((k for k, v in INDEX.items() if have <= v.keys()), "base64url")


def _tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(symbols: list[int], size: int) -> tuple[float, float, float]:
    """p-values of uniformity, runs and serial correlation of symbols in range(size), under randomness.

    Uniformity is tested over as many cells of neighbouring symbols as leave five expected in each.
    """
    n = len(symbols)
    if n < 10:
        return 1.0, 1.0, 1.0
    cells = max(2, min(size, n // 5))
    counts, widths = [0] * cells, [0] * cells
    for x in range(size):
        widths[x * cells // size] += 1
    for x in symbols:
        counts[x * cells // size] += 1
    chi = sum(c * c * size / w for c, w in zip(counts, widths, strict=True)) / n - n
    df = cells - 1
    z = ((max(chi, 1e-12) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    uniform = 0.5 * math.erfc(z / math.sqrt(2))
    middle = size / 2
    high = [x >= middle for x in symbols]
    a = sum(high)
    b = n - a
    runs = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
    mean = 1 + 2 * a * b / n
    spread = (mean - 1) * (mean - 2) / (n - 1)
    # one side only never happens by chance in a long run
    run_p = _tail((runs - mean) / math.sqrt(spread)) if spread > 0 else 2.0 ** (1 - n)
    average = sum(symbols) / n
    variance = sum((x - average) ** 2 for x in symbols)
    serial = sum((x - average) * (y - average) for x, y in zip(symbols, symbols[1:], strict=False)) / variance if variance else 1.0
    return uniform, run_p, _tail(serial * math.sqrt(n))


def score(text: str, encoding: str) -> float:
    """Three times the least p-value, 1 at most: the Bonferroni combination of the battery."""
    index = INDEX[encoding]
    return min(1.0, 3 * min(battery([index[c] for c in text if c in index], len(index))))


def length_class(n: int) -> int:
    return sum(n >= x for x in LENGTHS)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(start, end, number of the encoding, length class, score bin) of every run of encoding characters that touches no base span."""
    out = []
    for m in RUN.finditer(text):
        a, b = m.span()
        if any(x < b and a < y for x, _, y in base):
            continue
        run = m[0].rstrip("=")
        encoding = encoding_of(run)
        out.append((a, b, NAMES.index(encoding), length_class(len(run)), int(score(run, encoding) * BINS)))
    return out


def decoys(text: str) -> list[tuple[int, int, int]]:
    """(number of the encoding, length class, score bin) of DECOYS pieces of ordinary text, from places of the whole text by hash.

    Words of letters stand for prose; for alphabets of capitals in capitals, for digits by their
    letters' places in the alphabet. A text with too little prose gives fewer.
    """
    first = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    out = []
    for k in range(DECOYS):
        kind, length = divmod((first + k * 17) % (len(NAMES) * len(DECOY_LENGTHS)), len(DECOY_LENGTHS))
        n = DECOY_LENGTHS[length]
        own = _cut(text, (first >> 3 ^ k * 0x9E3779B1) % max(1, len(text)), NAMES[kind], n)
        if len(own) == n:
            out.append((kind, length_class(n), int(score(own, NAMES[kind]) * BINS)))
    return out


def _cut(text: str, at: int, encoding: str, n: int) -> str:
    """The first n letters of prose from a place of text on, and from its start on behind its end, that an encoding has."""
    index, own = INDEX[encoding], ""
    for start, end in ((at, len(text)), (0, at)):
        for m in WORDS.finditer(text, start, end):
            word = m[0]
            if encoding == "decimal":
                word = "".join(str((ord(c) | 32) % 10) for c in word)
            elif "a" not in index:
                word = word.upper()
            own += "".join(c for c in word if c in index)
            if len(own) >= n:
                return own[:n]
    return own


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, the base spans, the candidates and the decoys of every row."""

    def structs(rows: list[list[tuple]], names: tuple[str, ...]) -> pa.Array:
        kind = pa.list_(pa.struct([(x, pa.int32()) for x in names]))
        return pa.array([[dict(zip(names, x, strict=True)) for x in row] for row in rows], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, found, false = [], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                bases.append(base_spans(text))
                found.append(candidates(text, bases[-1]))
                false.append(decoys(text))
            count = lambda k: pa.array([sum(x[1] == k for x in base) for base in bases], pa.int64())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    count(0),
                    count(1),
                    count(2),
                    pa.array([hashlib.sha256(_listed(base).encode()).hexdigest() for base in bases], pa.string()),
                    structs(bases, ("start", "kind", "end")),
                    structs(found, ("start", "end", "enc", "len", "bin")),
                    structs(false, ("enc", "len", "bin")),
                ],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "candidates", "decoys"],
            )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>"
    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema + ", candidates array<struct<start:int,end:int,enc:int,len:int,bin:int>>, decoys array<struct<enc:int,len:int,bin:int>>")


def limits(runs: dict[tuple[int, int, int], int], false: dict[tuple[int, int, int], int], fdr: float) -> dict[tuple[int, int], int]:
    """For (encoding, length class), the least score bin that is reported; runs and false count (encoding, class, bin).

    A run's p-value is the share of decoys with its score or more, itself counted in; the lowest
    bin is taken at which runs times p-value is at most fdr times the runs with that score or more.
    """
    out = {}
    for kind, length in {x[:2] for x in runs}:
        like = [x for x in false if (x[0] == DIGITS) == (kind == DIGITS)]
        pools = ([x for x in like if x[:2] == (kind, length)], [x for x in like if x[1] == length], like)
        pool = next((p for p in pools if sum(false[x] for x in p) >= LEAST_DECOYS), pools[-1])
        all_ = sum(false[x] for x in pool)
        own = {x[2]: n for x, n in runs.items() if x[:2] == (kind, length)}
        for least in range(BINS + 1):
            above = sum(n for x, n in own.items() if x >= least)
            p = (1 + sum(false[x] for x in pool if x[2] >= least)) / (1 + all_)
            if above and sum(own.values()) * p <= fdr * above:
                out[kind, length] = least
                break
    return out


def thresholds(scanned: DataFrame, fdr: float) -> dict[tuple[int, int], int]:
    """limits of the candidates and decoys of scanned, by counts of encoding, class and bin: some 14,000 rows at most, whatever the corpus."""

    def counts(column: str) -> dict[tuple[int, int, int], int]:
        rows = scanned.select(F.explode(column).alias("c")).groupBy("c.enc", "c.len", "c.bin").agg(F.count("*").alias("n"))
        return {(r["enc"], r["len"], r["bin"]): r["n"] for r in rows.collect()}

    return limits(counts("candidates"), counts("decoys"), fdr)


def find_secrets(docs: DataFrame, fdr: float = 0.05) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random of every row of docs.

    A null text counts as empty and has no spans; its digest is that of the empty string. Texts
    are searched whole, however long. Rows that share a doc_id are judged each for itself. A run
    that touches a base span adds nothing, nor does one of under LEAST_RUN characters. A run of
    under 25 symbols leaves uniformity four cells only, so that lower-case keys of that length
    read like prose and are found seldom. An encoding and class of lengths with under
    LEAST_DECOYS decoys is held to those of all encodings of the class, or of all classes. As a p-value is at least 1 / (1 + decoys), a corpus of
    so little prose that it gives under 1 / fdr decoys has no random spans. Other columns are
    ignored; an empty table gives an empty result.
    """
    scanned = materialize(scan(docs), "secrets")
    least = thresholds(scanned, fdr)
    at = lambda c: c["enc"] * 100 + c["len"]
    held = F.create_map(*(F.lit(x) for (kind, length), v in least.items() for x in (kind * 100 + length, v))) if least else F.lit(None).cast("map<int,int>")
    added = F.filter("candidates", lambda c: F.coalesce(c["bin"] >= F.try_element_at(held, at(c)), F.lit(False)))
    added = F.transform(added, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    spans = F.array_sort(F.concat("base", added))
    name = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    return scanned.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"), F.size(added).cast("long").alias("n_random"))


def redact_secrets(docs: DataFrame, fdr: float = 0.05, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of find_secrets replaced by mark and n_chars, if there, counted anew.

    Null texts stay null, empty ones empty, rows in their number; other columns pass as they are.
    Spans that overlap become one mark. An empty table gives an empty one.
    """
    scanned = materialize(scan(docs).select("candidates", "decoys"), "candidates")
    least = thresholds(scanned, fdr)
    release(scanned)
    schema = docs.schema

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        base = base_spans(text)
        spans = [(a, b) for a, _, b in base]
        if least:
            spans += [(a, b) for a, b, kind, length, s in candidates(text, base) if s >= least.get((kind, length), BINS + 1)]
        out, at = [], 0
        for a, b in sorted(spans):
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join(out) + text[at:] if spans else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {x: batch.column(x) for x in batch.schema.names}
            texts = [clean(x.as_py()) for x in columns["text"]]
            columns["text"] = pa.array(texts, columns["text"].type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(x) if x is not None else None for x in texts], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(tidy(run), schema)
