"""Operator 7: SentencePiece encoding and decoding, in numpy.

Words of equal length advance together: hashes of all their substrings probe the sorted keys
of the pieces, which gives a table of piece numbers and scores by start and length. For a
unigram model, vectorised maxima over that table fill in the Viterbi scores and backpointers,
one end position a step. A BPE model has no additive score: its segmentation is what merging
the best pair again and again leaves, so the same table then feeds vectorised maxima that
choose each word's next merge. Characters that no piece has become bytes.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrec.llm.common import list_column, tidy
from loomrec.llm.shingles import mix

BLANK = "▁"
#: Words longer than this are merged one by one, by a queue.
TOGETHER = 128
_CELLS = 1 << 19
_CACHE = 250_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = re.compile(f"\n|{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+")
_loaded: dict[tuple[str, str | None], PieceModel] = {}


@dataclass
class PieceModel:
    """Pieces with scores; kind is "bpe" or "unigram"."""

    pieces: list[str]
    scores: np.ndarray
    kind: str
    special: dict[str, int] = field(default_factory=dict)  # pieces that text never matches
    unknown: int = 0

    def __post_init__(self) -> None:
        self.numbers = {p: i for i, p in enumerate(self.pieces) if p not in self.special}
        self.widest = max(map(len, self.numbers), default=1)
        self.bytes_ = [self.special.get(f"<0x{b:02X}>", self.unknown) for b in range(256)]
        ids = np.array(list(self.numbers.values()), np.int64)
        keys = np.zeros(len(ids), np.uint64)
        by_length: dict[int, list[int]] = {}
        names = list(self.numbers)
        for i, p in enumerate(names):
            by_length.setdefault(len(p), []).append(i)
        for at in by_length.values():
            keys[at] = self._hash(np.array([list(map(ord, names[i])) for i in at], np.uint64))
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]
        if len(keys) > 1 and (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.own_bytes = [self._bytes_of(i, p) for i, p in enumerate(self.pieces)]
        self.known: dict[str, bytes] = {}
        self.most = _CACHE  # words kept
        # blanks only lead pieces, line ends are in none: words can be told apart there
        self.apart = not any(BLANK in p.lstrip(BLANK) or "\n" in p for p in self.numbers)

    @staticmethod
    def _hash(chars: np.ndarray) -> np.ndarray:
        out = np.zeros(len(chars), np.uint64)
        for k in range(chars.shape[1]):
            out = out * _BASE + mix(chars[:, k] + np.uint64(1))
        return mix(out + np.uint64(chars.shape[1]))

    def _bytes_of(self, number: int, piece: str) -> bytes:
        if piece in self.special:
            found = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
            return bytes([int(found[1], 16)]) if found else b""
        return piece.replace(BLANK, " ").encode()

    @classmethod
    def load(cls, path: str, kind: str | None = None) -> PieceModel:
        """A model file of the library; kind is read from it unless given."""
        if (path, kind) not in _loaded:
            from sentencepiece import SentencePieceProcessor

            p = SentencePieceProcessor(model_file=path)
            pieces = [p.id_to_piece(i) for i in range(p.get_piece_size())]
            special = {x: i for i, x in enumerate(pieces) if p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i)}
            scores = np.array([p.get_score(i) for i in range(len(pieces))])
            ordinary = scores[[i for i, x in enumerate(pieces) if x not in special]]
            whole = bool((ordinary == np.round(ordinary)).all())  # ranks, not logarithms
            _loaded[(path, kind)] = cls(pieces, scores, kind or ("bpe" if whole else "unigram"), special, p.unk_id())
        return _loaded[(path, kind)]

    def probe(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """numbers and scores [word, start, length - 1] of the pieces in words of one length; -1 and minus infinity for none."""
        n, size = chars.shape
        widest = min(self.widest, size)
        numbers = np.full((n, size, widest), -1, np.int32)
        own = mix(chars.astype(np.uint64) + np.uint64(1))
        run = np.zeros((n, size), np.uint64)
        for d in range(1, widest + 1):
            run = run[:, : size - d + 1] * _BASE + own[:, d - 1 :]
            keys = mix(run + np.uint64(d))
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            numbers[:, : size - d + 1, d - 1] = np.where(self.keys[at] == keys, self.ids[at], -1)
        return numbers, np.where(numbers >= 0, self.scores[numbers], -np.inf)

    def merge_ends(self, scores: np.ndarray) -> np.ndarray:
        """[word, start]: the end of the segment that begins there, 0 for none; the best pair merges first, the leftmost of equals."""
        n, size, widest = scores.shape
        if size == 1:
            return np.ones((n, 1), np.int64)
        ends = np.tile(np.arange(1, size + 1), (n, 1))
        live = np.arange(n)
        while len(live):
            own = ends[live]
            after = np.where((own > 0) & (own < size), np.take_along_axis(own, np.minimum(own, size - 1), 1), 0)
            d = after - np.arange(size)
            fits = (after > 0) & (d <= widest)
            value = np.where(fits, scores[live[:, None], np.arange(size), np.where(fits, d - 1, 0)], -np.inf)
            best = value.argmax(1)
            some = np.arange(len(live))
            go = value[some, best] > -np.inf
            live, best, own, after = live[go], best[go], own[go], after[go]
            some = np.arange(len(live))
            ends[live, own[some, best]] = 0
            ends[live, best] = after[some, best]
        return ends

    def viterbi_ends(self, numbers: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """As merge_ends, for the segmentation of the largest sum of scores; an unknown character scores less than all pieces."""
        n, size, widest = scores.shape
        least = float(self.scores.min()) - 10
        best, back = np.full((n, size + 1), -np.inf), np.zeros((n, size + 1), np.int64)
        best[:, 0] = 0
        for end in range(1, size + 1):
            lengths = np.arange(1, min(widest, end) + 1)
            value = best[:, end - lengths] + scores[:, end - lengths, lengths - 1]
            value[:, 0] = np.maximum(value[:, 0], np.where(numbers[:, end - 1, 0] < 0, best[:, end - 1] + least, -np.inf))
            pick = value.argmax(1)
            best[:, end], back[:, end] = value[np.arange(n), pick], end - lengths[pick]
        ends, at = np.zeros((n, size), np.int64), np.full(n, size)
        while (at > 0).any():
            go = np.flatnonzero(at > 0)
            start = back[go, at[go]]
            ends[go, start] = at[go]
            at[go] = start
        return ends

    def _long(self, word: str) -> list[int]:
        """The segments' starts of one long word, by a queue of merges."""
        size = len(word)
        ends, before = list(range(1, size + 1)), list(range(-1, size - 1))
        queue: list[tuple[float, int, int]] = []

        def offer(i: int) -> None:
            if 0 <= i and ends[i] < size:
                k = ends[ends[i]]
                number = self.numbers.get(word[i:k]) if k - i <= self.widest else None
                if number is not None:
                    heapq.heappush(queue, (-self.scores[number], i, k))

        for i in range(size):
            offer(i)
        while queue:
            _, i, k = heapq.heappop(queue)
            j = ends[i]
            if not j or j >= size or ends[j] != k:
                continue
            ends[j], ends[i] = 0, k
            if k < size:
                before[k] = i
            offer(i)
            offer(before[i])
        return [i for i in range(size) if ends[i]] + [size]

    def _ids(self, word: str, cuts: list[int]) -> bytes:
        out: list[int] = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            number = self.numbers.get(word[a:b])
            out += [number] if number is not None else [self.bytes_[x] for x in word[a:b].encode()]
        return np.array(out, "<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Keeps the ids of words."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            if w not in self.known:
                by_length.setdefault(len(w), []).append(w)
        for size, same in by_length.items():
            if size > TOGETHER and self.kind == "bpe":
                self.known.update((w, self._ids(w, self._long(w))) for w in same)
                continue
            step = max(1, _CELLS // (size * min(size, self.widest)))
            for a in range(0, len(same), step):
                some = same[a : a + step]
                chars = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(some), size)
                numbers, scores = self.probe(chars)
                ends = self.merge_ends(scores) if self.kind == "bpe" else self.viterbi_ends(numbers, scores)
                row, start = np.nonzero(ends)
                width = ends[row, start] - start
                found = numbers[row, start, np.minimum(width, numbers.shape[2]) - 1].astype("<u4")
                cuts = np.searchsorted(row, np.arange(len(some) + 1))
                odd = set(row[found == 0xFFFFFFFF].tolist())
                data, cuts4 = found.tobytes(), (4 * cuts).tolist()
                for i, w in enumerate(some):
                    if i in odd:
                        self.known[w] = self._ids(w, [*start[cuts[i] : cuts[i + 1]].tolist(), size])
                    else:
                        self.known[w] = data[cuts4[i] : cuts4[i + 1]]

    def forget(self, left: int) -> None:
        """Keeps left words, those met first."""
        self.known = dict(islice(self.known.items(), left))

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        text = BLANK + text.replace(" ", BLANK)
        return _CHUNK.findall(text) if self.apart else [text]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        split = [self.chunks(x) for x in texts]
        if len(self.known) > self.most:
            # frequent words come early: those stay
            self.forget(self.most // 2)
        self.learn(set().union(*split))
        of = self.known.__getitem__
        return [b"".join(map(of, x)) for x in split]

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.own_bytes.__getitem__, ids))
        return data.removeprefix(b" ").decode("utf-8", "replace")


def encode(docs: DataFrame, model_path: str, *keep: str) -> DataFrame:
    """doc_id, the columns named by keep, n_pieces and ids of every row of docs. Null and empty texts have no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel.load(model_path)
        for whole in batches:
            for a in range(0, len(whole), 1000):
                batch = whole.slice(a, 1000)
                coded = model.encode([x or "" for x in batch.column("text").to_pylist()])
                sizes = np.fromiter((len(x) // 4 for x in coded), np.int64, len(coded))
                ids = list_column(np.frombuffer(b"".join(coded), "<i4"), np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                names = ["doc_id", *keep]
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(sizes), ids], names=[*names, "n_pieces", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, "text")
    kinds = "".join(f", {x} {docs.schema[x].dataType.simpleString()}" for x in keep)
    return rows.mapInArrow(tidy(run), f"doc_id long{kinds}, n_pieces long, ids array<int>")


def decode(coded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, ids, ids_crc32 and the text of rows of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel.load(model_path)
        for batch in batches:
            ids = batch.column("ids")
            flat, cuts = ids.values.to_numpy(), ids.offsets.to_numpy()
            parts = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            sums = pa.array([zlib.crc32(x.astype("<i4", copy=False).tobytes()) for x in parts], pa.int64())
            texts = pa.array([model.decode(x.tolist()) for x in parts], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "n_pieces", "ids")), sums, texts], names=["doc_id", "n_pieces", "ids", "ids_crc32", "text"])

    return coded.select("doc_id", "n_pieces", "ids").mapInArrow(tidy(run), "doc_id long, n_pieces long, ids array<int>, ids_crc32 long, text string")


def coded(docs: DataFrame, model_path: str, words: int = _CACHE) -> DataFrame:
    """doc_id, n_pieces, ids, ids_crc32 and text_crc32 of every row of docs: encode and decode in one worker.

    The checksums are those of the ids as little-endian 32-bit integers and of the UTF-8 of the
    text decoded from them. Null and empty texts have no pieces and the checksums of nothing.
    Rows that share a doc_id are coded each for itself. The mark U+2581 in a text is read, and
    decoded, as a blank. Other columns are ignored; an empty table gives an empty result.

    words: how many words' ids a worker keeps; between tasks it keeps a fifth of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel.load(model_path)
        model.most = words
        for whole in batches:
            for a in range(0, len(whole), 500):
                batch = whole.slice(a, 500)
                data = model.encode([x or "" for x in batch.column("text").to_pylist()])
                sizes = np.fromiter((len(x) // 4 for x in data), np.int64, len(data))
                ids = list_column(np.frombuffer(b"".join(data), "<i4"), np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                texts = [zlib.crc32(model.decode(np.frombuffer(x, "<u4").tolist()).encode()) for x in data]
                columns = [batch.column("doc_id"), pa.array(sizes), ids, pa.array([zlib.crc32(x) for x in data], pa.int64()), pa.array(texts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_pieces", "ids", "ids_crc32", "text_crc32"])
        if words < _CACHE:
            model.forget(words // 5)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(tidy(run), "doc_id long, n_pieces long, ids array<int>, ids_crc32 long, text_crc32 long")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """The columns of ``coded`` but for the ids themselves."""
    return coded(docs, model_path).drop("ids")
