"""Operator 1: token ids in ORC files.

Documents are tokenized and written in ascending doc_id order to ORC files whose stripes
hold run-length encoded integers, a row index every ``row_stride`` rows and a Bloom filter
on doc_id. Stripes are read in parallel; a lookup by doc_id prunes stripes and row groups.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomrec.llm.common import list_column, partitions_for, scratch, tidy, utf8_parts

ROW_SCHEMA = "doc_id long, part int, first long, n_tokens long, ids array<int>"
#: Pieces a worker keeps; beyond them the half met first stays, which holds the frequent ones.
_CACHE_ENTRIES = 500_000
#: Pieces that go through the library as one text.
_JOINED = 512
_PLAIN, _LETTER, _STOP, _GAP, _LEAD2, _TAIL, _LEAD4 = (1 << i for i in range(7))
_KINDS = np.zeros(256, np.uint8)
_KINDS[33:127] |= _PLAIN
_KINDS[[*range(65, 91), *range(97, 123)]] |= _LETTER
_KINDS[list(b",.")] |= _STOP
_KINDS[[10, 32]] |= _GAP
_KINDS[0xC3:0xE0] |= _LEAD2
_KINDS[0x80:0xC0] |= _TAIL
_KINDS[0xE4:0xF5] |= _LEAD4
_loaded: dict[str, object] = {}


class _Encoder:
    """Ids of texts as little-endian 32-bit integers.

    With a byte-level pre-tokenizer, texts are cut at places where it surely cuts too: before a
    single blank, around a single line feed, and before a comma or full stop after a letter.
    Equal pieces are found by Arrow's dictionary encoding; those not met before go through the
    library, many in one call. Texts that hold an added token, and all texts under other
    pre-tokenizers, go through the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        before = kind["pre_tokenizer"] or {}
        self.cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not kind["normalizer"]
        self.added = [x["content"].encode() for x in kind["added_tokens"]]
        if self.cuts:
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            blank = next(k for k, v in vocabulary.items() if v == self._ids(" ")[0])
            self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # ids whose bytes begin with a blank
            self.opens[[v for k, v in vocabulary.items() if k.startswith(blank)]] = True
            self.feeds = np.zeros_like(self.opens)
            self.feeds[self._ids("\n")[:1]] = True
        self.known: dict[bytes, int] = {}
        self.ids, self.ends = np.zeros(1 << 20, "<u4"), np.zeros((1 << 18) + 1, np.int64)

    def _forget(self) -> None:
        # pieces are numbered as they were met, so that the numbers of those that stay still hold
        self.known = dict(islice(self.known.items(), _CACHE_ENTRIES // 2))

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, texts: list[str], opens: np.ndarray, drop: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and their counts of texts that were joined to one; each but the first begins with an id of opens, left out if drop."""
        ids = self.whole(["\n".join(texts) if drop else "".join(texts)])[0]
        at = np.flatnonzero(opens[ids])
        if len(at) != len(texts) - drop:
            return None  # not a vocabulary whose ids keep to the pieces
        if not drop:
            return ids, np.diff(np.append(at, len(ids)))
        return np.delete(ids, at), np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1

    def _keep(self, pieces: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, at = len(self.known), int(self.ends[len(self.known)])
        while n + len(pieces) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while at + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[at : at + len(ids)] = ids
        self.ends[n + 1 : n + 1 + len(pieces)] = at + np.cumsum(sizes)
        self.known.update(zip(pieces, range(n, n + len(pieces)), strict=True))

    def learn(self, pieces: list[bytes]) -> None:
        """Keeps the ids of pieces not met before."""
        texts = [x.decode() for x in pieces]
        led, bare, rest = [], [], []
        for i, x in enumerate(texts):
            inner = x.split()
            if len(inner) != 1 or "\n" in x:
                rest.append(i)
            elif inner[0] == x:
                bare.append(i)
            elif x[0] == " " and len(inner[0]) == len(x) - 1:
                led.append(i)
            else:
                rest.append(i)
        for group, opens, drop in ((led, self.opens, 0), (bare, self.feeds, 1)):
            for a in range(0, len(group), _JOINED):
                some = group[a : a + _JOINED]
                found = self._joined([texts[i] for i in some], opens, drop)
                if found:
                    self._keep([pieces[i] for i in some], *found)
                else:
                    rest += some
        for a in range(0, len(rest), _JOINED):
            some = rest[a : a + _JOINED]
            ids = self.whole([texts[i] for i in some])
            self._keep([pieces[i] for i in some], np.concatenate(ids), np.array([len(x) for x in ids]))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a column of texts without nulls, one after the other, and their counts."""
        data, offsets = utf8_parts(column)
        n = len(offsets) - 1
        raw = data.tobytes()
        aside = np.zeros(n, bool)
        if not self.cuts:
            aside[:] = True
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                aside[np.searchsorted(offsets, at, side="right") - 1] = True
                at = raw.find(token, at + 1)
        cut = certain_cuts(data)
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        if aside.any():
            cut &= ~np.repeat(aside, np.diff(offsets))
        starts = np.flatnonzero(cut)
        ahead = np.searchsorted(starts, offsets)  # pieces before each text
        sizes, ids = np.zeros(n, np.int64), np.zeros(0, "<u4")
        if len(starts):
            # a piece ends where the next begins, or its text does
            ends = np.append(starts[1:], len(data))
            if aside.any():
                ends = np.minimum(ends, np.repeat(offsets[1:], np.diff(ahead)))
            found = _binaries(data, starts, ends).dictionary_encode()
            if len(self.known) > _CACHE_ENTRIES:
                self._forget()
            pieces = found.dictionary.to_pylist()
            number = [*map(self.known.get, pieces)]
            if None in number:
                self.learn([x for x, k in zip(pieces, number, strict=True) if k is None])
                number = [*map(self.known.__getitem__, pieces)]
            number = np.array(number, np.int64)
            low = self.ends[number].astype(np.int32)
            count = self.ends[number + 1].astype(np.int32) - low
            at = found.indices.to_numpy()
            low, count = low[at], count[at]
            total = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
            gather = np.repeat(low - total[:-1].astype(np.int32), count)
            gather += np.arange(len(gather), dtype=np.int32)
            ids, sizes = self.ids[gather], np.diff(total[ahead])
        if aside.any():
            own = np.split(ids, np.cumsum(sizes)[:-1])
            for i, x in zip(np.flatnonzero(aside), self.whole([raw[offsets[i] : offsets[i + 1]].decode() for i in np.flatnonzero(aside)]), strict=True):
                own[i], sizes[i] = x, len(x)
            ids = np.concatenate(own)
        return ids, sizes


def _binaries(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte strings from starts to ends; nothing is copied when each begins where the last one ends."""
    if len(starts) > 1 and (starts[1:] != ends[:-1]).any():
        keep = np.zeros(len(data) + 1, np.int8)
        keep[starts] += 1
        np.subtract.at(keep, ends, 1)
        data, sizes = data[np.cumsum(keep[:-1]) > 0], ends - starts
        cuts = np.concatenate([[0], np.cumsum(sizes)])
    else:
        cuts = np.append(starts, ends[-1])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def certain_cuts(data: np.ndarray) -> np.ndarray:
    """Bytes before which a byte-level pre-tokenizer surely cuts, whatever else stands around.

    Beside a blank or line feed must stand a printable ASCII character or one that is surely no
    white space: of two bytes from U+00C0 on, or, after it, of a lead byte that white space lacks.
    """
    cut = np.zeros(len(data), bool)
    if len(data) < 3:
        return cut
    kind = _KINDS[data]
    before = (kind & _PLAIN) > 0
    before[1:] |= ((kind[1:] & _TAIL) > 0) & ((kind[:-1] & _LEAD2) > 0)
    after = (kind & (_PLAIN | _LEAD2 | _LEAD4)) > 0
    gap = np.zeros(len(data), bool)
    gap[1:-1] = ((kind[1:-1] & _GAP) > 0) & before[:-2] & after[2:]
    cut |= gap
    cut[1:] |= gap[:-1] & (data[:-1] == 10)
    cut[1:] |= ((kind[1:] & _STOP) > 0) & ((kind[:-1] & _LETTER) > 0)
    return cut


def _encoder(path: str) -> _Encoder:
    if path not in _loaded:
        _loaded[path] = _Encoder(path)
    return _loaded[path]


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """doc_id, part (the number of the row's partition), first (tokens of the rows before it there), n_tokens and ids, end_id last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before, part = _encoder(tokenizer_path), 0, TaskContext.get().partitionId()
        for batch in batches:
            ids, sizes = encoder.encode(batch.column("text").fill_null(""))
            ids = np.insert(ids, np.cumsum(sizes), np.uint32(end_id))
            sizes = sizes + 1
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(np.full(len(batch), part, np.int32)),
                    pa.array(before + ends - sizes),
                    pa.array(sizes),
                    list_column(ids.view(np.int32), np.concatenate([[0], ends]), pa.int32()),
                ],
                names=["doc_id", "part", "first", "n_tokens", "ids"],
            )
            before += int(ends[-1]) if len(ends) else 0

    return docs.select("doc_id", "text").mapInArrow(tidy(run), ROW_SCHEMA)


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, row_stride: int = 1000, stripe_bytes: int = 16 << 20
) -> None:
    """Writes the ids of docs to ORC files under path, in ascending doc_id order.

    Rows of one doc_id are ordered, and spread over files, by a hash of their text. A null
    doc_id sorts first; null texts count as empty; every row ends with end_id. A text is encoded
    whole, however long. Columns other than doc_id and text are ignored; an empty table gives
    files without rows.
    """
    parts = partitions_for(docs)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"))
    rows = rows.repartitionByRange(parts, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    (
        tokenize(rows, tokenizer_path, end_id)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(row_stride))
        .option("orc.stripe.size", str(stripe_bytes))
        .option("compression", "zstd")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of the files under path.

    start counts the ids of all documents before it. Rows hold their offsets within the range
    partition that wrote them, so that only one row a partition is summed up, from two pruned columns.
    """
    rows = spark.read.schema(ROW_SCHEMA).orc(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))
    joined = rows.join(F.broadcast(parts), F.col("part") == F.col("_part"))  # one row a range partition
    return joined.select("doc_id", (F.col("_base") + F.col("first")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of a few documents; their ids reach the scan, which skips by statistics and Bloom filter."""
    return spark.read.schema(ROW_SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat, cuts = ids.values.to_numpy().astype("<i4", copy=False), ids.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "start", "n_tokens")), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes docs as token files in the shared folder and returns the digests read back from them."""
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path)
    return digests(read_tokens(docs.sparkSession, path))
