"""Operator 2: a quality classifier by an interpolated modified Kneser-Ney model.

The model's symbols are bytes, all 256 of them, and its n-grams have ORDER of them, so that it
reads any script and grows with the corpus. Counts are taken over trusted documents; counts,
contexts and discounts are joined to the terms of each n-gram, and stay a table. Documents go
in blocks: a block's distinct n-grams are dealt to shards, where they meet the model's terms,
and their logarithms come back to the block, which sums them up for each document. A document
is kept when its perplexity lies between quantiles of trusted documents of its language and
class of lengths; the upper one is taken from such as the model has not seen.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrec.llm.common import materialize, partitions_for, release, tidy, utf8_parts
from loomrec.llm.shingles import blocks

ORDER = 5
#: What stands before a text: a byte that UTF-8 never holds.
START = 0xFF
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Terms of the model in a shard, about, and blocks whose n-grams meet a copy of it.
SHARD_TERMS, SLICE_BLOCKS = 250_000, 64
LEAST_SHARDS = 16
#: What is told of a row beside its perplexity; tie is a hash of its text.
CARRIED = ("doc_id", "lang", "tie")
#: Trusted documents, by id, up to which their table is broadcast (16 MB).
BROADCAST_IDS = 2_000_000
#: Bytes of a text from which on the next class of lengths begins.
LENGTHS = (400, 1000, 2500)
#: One in so many trusted documents is not learnt from; the limits come from these.
FOLDS = 5
#: The share of their distance by which the limits lie beyond the quantiles, which few documents tell inexactly.
SLACK = 0.1


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each byte, eight bits a symbol, the last one lowest."""
    key = data.astype(np.int64)
    ago = np.minimum(np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets)), ORDER)
    early = np.flatnonzero(ago < ORDER - 1)
    out = key.copy()
    for k in range(1, min(ORDER, len(key))):
        out[k:] |= key[: len(key) - k] << (8 * k)
    # the first symbols of a text see its start instead of the text before
    for k in range(1, ORDER):
        at = early[ago[early] < k]
        out[at] = (out[at] & ~(0xFF << (8 * k))) | (START << (8 * k))
    return out


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in rising order and how often each occurs."""
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, int)
    return values[first], np.diff(np.append(first, len(values)))


def distinct_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a block's texts in rising order and how often each occurs, a part of the block at a time."""
    found, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for a, b in blocks(offsets, 1 << 20):
        own, n = distinct(grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
        both, times = np.concatenate([found, own]), np.concatenate([counts, n])
        order = np.argsort(both, kind="stable")
        both, times = both[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, int)
        found, counts = both[first], np.add.reduceat(times, first) if len(first) else times
    return found, counts


def count_grams(docs: DataFrame) -> DataFrame:
    """gram and n over the texts of docs; each task sums up its own, a block at a time, before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, offsets, _ in _blocks(batches):
            found, n = distinct_grams(data, offsets)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["gram", "n"])

    return docs.select("text").mapInArrow(tidy(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def model_terms(counts: DataFrame) -> DataFrame:
    """kind, len, gram and value: of each n-gram its discounted share (kind 0), of each context the weight of the shorter one (kind 1).

    The longest n-grams count by occurrence, shorter ones by the distinct symbols before them. A
    context has 256 n-grams at most, so no group is large.
    """
    out, grams_of, held = None, counts, []
    for k in range(ORDER, 0, -1):
        grams_of = materialize(grams_of, "grams")
        held.append(grams_of)
        n1, n2, n3, n4 = grams_of.agg(*(F.count_if(F.col("n") == i) for i in (1, 2, 3, 4))).first()
        d = discounts(n1, n2, n3, n4)
        less = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        rows = grams_of.withColumn("context", F.shiftright("gram", 8))
        contexts = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum(less).alias("left"))
        terms = rows.join(contexts, "context").select(F.lit(0).alias("kind"), F.lit(k).alias("len"), "gram", ((F.col("n") - less) / F.col("total")).alias("value"))
        weights = contexts.select(F.lit(1).alias("kind"), F.lit(k).alias("len"), F.col("context").alias("gram"), (F.col("left") / F.col("total")).alias("value"))
        both = terms.unionByName(weights)
        out = both if out is None else out.unionByName(both)
        grams_of = grams_of.groupBy(F.col("gram").bitwiseAND((1 << (8 * (k - 1))) - 1).alias("gram")).agg(F.count("*").alias("n"))
    out = materialize(out, "terms")
    release(*held)
    return out


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """What is taken off counts of 1, 2 and more, from the numbers of n-grams with counts 1 to 4."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    # without the counts that the estimates need, a plain discount stands in
    d = [i - (i + 1) * y * b / a if a and b else 0.5 * min(i, 2) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return [min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1)]


def logarithms(keys: np.ndarray, kind: np.ndarray, length: np.ndarray, gram: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The natural logarithm of the probability of the last symbol of each n-gram of keys, by the model's terms, after the others."""

    def of(which: int, k: int, wanted: np.ndarray, missing: float) -> np.ndarray:
        at = np.flatnonzero((kind == which) & (length == k))
        if not len(at):
            return np.full(len(wanted), missing)
        at = at[np.argsort(gram[at])]
        place = np.minimum(np.searchsorted(gram[at], wanted), len(at) - 1)
        return np.where(gram[at][place] == wanted, value[at][place], missing)

    p = np.full(len(keys), 1 / 256)
    for k in range(1, ORDER + 1):
        own = keys & ((1 << (8 * k)) - 1)
        # an unseen context leaves all to the shorter one
        p = of(0, k, own, 0.0) + of(1, k, own >> 8, 1.0) * p
    return np.log(p).astype(np.float32)


def shard_of(gram, shards: int):
    """The shard of n-grams, by the two symbols before the last, which their contexts and shorter n-grams share; of a column or an array."""
    if isinstance(gram, np.ndarray):
        return ((((gram >> 8) & 0xFFFF) * 40503 & 0xFFFF) * shards) >> 16
    return F.shiftright((F.shiftright(gram, 8).bitwiseAND(0xFFFF) * 40503).bitwiseAND(0xFFFF) * shards, 16)


def sharded(terms: DataFrame, shards: int, slices: int) -> DataFrame:
    """terms with shard and slice: in one shard, or, up to two symbols, of which there are 66,000 at most, in all; in all slices."""
    as_gram = F.when(F.col("kind") == 0, F.col("gram")).otherwise(F.shiftleft("gram", 8))
    one = F.array(shard_of(as_gram, shards).cast("int"))
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    rows = terms.withColumn("shard", F.explode(F.when(F.col("len") > 2, one).otherwise(every)))
    return rows.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Table]]:
    """Bytes and offsets of about BLOCK_BYTES of texts, and their rows."""
    held: list[pa.RecordBatch] = []
    size = 0

    def whole() -> tuple[np.ndarray, np.ndarray, pa.Table]:
        table = pa.Table.from_batches(held).combine_chunks()
        return *utf8_parts(table.column("text")), table

    for batch in batches:
        batch = batch.set_column(batch.schema.get_field_index("text"), "text", batch.column("text").fill_null(""))
        _, offsets = utf8_parts(batch.column("text"))
        for a, b in blocks(offsets, BLOCK_BYTES):
            if held and size + int(offsets[b] - offsets[a]) > BLOCK_BYTES:
                yield whole()
                held, size = [], 0
            held.append(batch.slice(a, b - a))
            size += int(offsets[b] - offsets[a])
    if held:
        yield whole()


def _pack(parts: list[bytes]) -> bytes:
    return struct.pack(f"<{len(parts) + 1}q", len(parts), *map(len, parts)) + b"".join(parts)


def _unpack(data: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<q", data)
    sizes = struct.unpack_from(f"<{n}q", data, 8)
    ends = np.cumsum((8 * (n + 1), *sizes)).tolist()
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def packed(rows: DataFrame) -> DataFrame:
    """block and payload of rows (doc_id, lang, tie, text): compressed columns and bytes of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part = pa.Codec("zstd", compression_level=6), TaskContext.get().partitionId()
        for number, (data, offsets, table) in enumerate(_blocks(batches)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.select(list(CARRIED)).schema) as out:
                out.write_table(table.select(list(CARRIED)))
            raw = _pack([sink.getvalue().to_pybytes(), offsets.tobytes(), data.tobytes()])
            payload = struct.pack("<q", len(raw)) + codec.compress(raw, asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([part << 32 | number], pa.int64()), pa.array([payload], pa.binary())], names=["block", "payload"])

    return rows.select(*CARRIED, "text").mapInArrow(tidy(run), "block long, payload binary")


def _opened(payload: bytes) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    (size,) = struct.unpack_from("<q", payload)
    columns, offsets, data = _unpack(pa.Codec("zstd").decompress(payload[8:], size, asbytes=True))
    return pa.ipc.open_stream(columns).read_all(), np.frombuffer(data, np.uint8), np.frombuffer(offsets, np.int64)


def block_grams(packs: DataFrame, shards: int, slices: int) -> DataFrame:
    """shard, slice, block and keys: a block's distinct n-grams of a shard in rising order, their differences compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=3)
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                _, data, offsets = _opened(payload.as_py())
                keys, _ = distinct_grams(data, offsets)
                at = shard_of(keys, shards)
                order = np.argsort(at, kind="stable")
                keys, cuts = keys[order], np.searchsorted(at[order], np.arange(shards + 1))
                parts = [np.diff(keys[a:b], prepend=0) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                coded = [struct.pack("<q", len(x)) + codec.compress(_bytes_apart(x), asbytes=True) for x in parts]
                n = len(coded)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, block % slices, np.int32)), pa.array(np.full(n, block)), pa.array(coded, pa.binary())],
                    names=["shard", "slice", "block", "keys"],
                )

    return packs.mapInArrow(tidy(run), "shard int, slice int, block long, keys binary")


def _bytes_apart(x: np.ndarray) -> bytes:
    """Little-endian numbers, all first bytes before all second ones: small numbers compress well so."""
    return x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _keys(coded: bytes) -> np.ndarray:
    (n,) = struct.unpack_from("<q", coded)
    if not n:
        return np.zeros(0, np.int64)
    raw = pa.Codec("zstd").decompress(coded[8:], 8 * n, asbytes=True)
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view("<i8").ravel())


def shard_logarithms(keys: DataFrame, terms: DataFrame) -> DataFrame:
    """block, shard, keys as they are and logs, one of single precision for each; keys and terms meet by shard and slice."""

    def run(own: pa.Table, model: pa.Table) -> pa.Table:
        columns = [model.column(x).to_numpy() for x in ("kind", "len", "gram", "value")]
        coded = own.column("keys").to_pylist()
        wanted = [_keys(x) for x in coded]
        # equal n-grams of many blocks are looked up once
        some, _ = distinct(np.concatenate(wanted)) if wanted else (np.zeros(0, np.int64), None)
        logs = logarithms(some, *columns)
        out = [logs[np.searchsorted(some, x)].tobytes() for x in wanted]
        return pa.table({"block": own.column("block"), "shard": own.column("shard"), "keys": pa.array(coded, pa.binary()), "logs": pa.array(out, pa.binary())})

    return keys.groupBy("shard", "slice").cogroup(terms.groupBy("shard", "slice")).applyInArrow(run, "block long, shard int, keys binary, logs binary")


def log_perplexity(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Minus the mean logarithm a symbol of each text, by the logarithm of each n-gram of keys in rising order; not a number for empty ones."""
    out = np.full(len(offsets) - 1, np.nan)
    # most n-grams are found by one look into a table of slots; those whose slot another has taken by search
    bits = max(8, int(len(keys)).bit_length() + 3)
    slot = lambda x: ((x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
    held = np.zeros(1 << bits, np.int32)
    held[slot(keys)] = np.arange(len(keys), dtype=np.int32)
    for a, b in blocks(offsets, 1 << 20):
        cuts = offsets[a : b + 1] - offsets[a]
        at = grams(data[offsets[a] : offsets[b]], cuts)
        if len(at) and not len(keys):
            raise RuntimeError("a block lacks the logarithms of its n-grams")
        place = held[slot(at)] if len(at) else np.zeros(0, np.int32)
        other = np.flatnonzero(keys[place] != at)
        if len(other):
            place[other] = np.minimum(np.searchsorted(keys, at[other]), len(keys) - 1)
            if (keys[place[other]] != at[other]).any():
                raise RuntimeError("a block lacks the logarithms of some of its n-grams")
        sums = np.concatenate([[0.0], np.cumsum(logs[place], dtype=np.float64)])
        size = np.diff(cuts)
        out[a:b] = np.where(size > 0, -(sums[cuts[1:]] - sums[cuts[:-1]]) / np.maximum(size, 1), np.nan)
    return out


def perplexities(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, lang, tie, n_symbols and log_perplexity of rows (doc_id, lang, tie, text)."""
    parts = partitions_for(rows, 8 << 20)
    # one shuffle of the texts, compressed, which both readers share: the join below would add this filter to one of them
    # alone, and would change its partitions to those of the other side
    packs = packed(rows).where("block is not null").repartition(parts, "block")
    shards = max(LEAST_SHARDS, min(4096, -(-terms.count() // SHARD_TERMS)))
    slices = max(1, -(-parts // SLICE_BLOCKS))
    keys = block_grams(packs, shards, slices)
    found = shard_logarithms(keys, sharded(terms, shards, slices))
    per = found.repartition(parts, "block").groupBy("block").agg(F.collect_list(F.struct("keys", "logs")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                table, data, offsets = _opened(batch.column("payload")[k].as_py())
                both = batch.column("found")[k].values
                own = np.concatenate([np.zeros(0, np.int64), *(_keys(x.as_py()) for x in both.field("keys"))])
                logs = np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(x.as_py(), np.float32) for x in both.field("logs"))])
                order = np.argsort(own)
                value = log_perplexity(data, offsets, own[order], logs[order])
                table = table.combine_chunks()
                columns = [table.column(x).chunk(0) if len(table) else pa.array([], table.schema.field(x).type) for x in CARRIED]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(offsets)), pa.array(value, from_pandas=True)], names=[*CARRIED, "n_symbols", "log_perplexity"])

    return packs.join(per, "block").select("payload", "found").mapInArrow(tidy(run), "doc_id long, lang string, tie long, n_symbols long, log_perplexity double")


def trusted_ids(labels: DataFrame) -> tuple[DataFrame, bool]:
    """The distinct doc_ids of quality 1, and whether they are few enough to broadcast."""
    ids = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return ids, ids.count() <= BROADCAST_IDS


def _class(n: str):
    return sum((F.col(n) >= x).cast("int") for x in LENGTHS)


def _tie():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _apart():
    """Whether a trusted document is one that the model does not learn from."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("fold")), F.lit(FOLDS)) == 0


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, tie, n_symbols, log_perplexity, _trusted, _apart and _len of each row of docs, as materialized rows."""
    ids, few = trusted_ids(labels)
    ids = ids.withColumn("_trusted", F.lit(True))
    ids = F.broadcast(ids) if few else ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(["lang"] if "lang" in docs.columns else [F.lit(None).cast("string").alias("lang")]))
    rows = rows.withColumn("tie", _tie())
    terms = model_terms(count_grams(rows.where(~_apart()).join(ids, "doc_id", "left_semi")))
    out = perplexities(rows, terms).join(ids, "doc_id", "left").withColumn("_trusted", F.coalesce("_trusted", F.lit(False)))
    out = materialize(out.withColumn("_apart", F.col("_trusted") & _apart()).withColumn("_len", _class("n_symbols")), "perplexity")
    release(terms)
    return out


def limits(scored: DataFrame, low: float, high: float, least: int = 50) -> DataFrame:
    """lang, _len, low and high: quantiles of trusted rows.

    The upper one is that of rows which the model has not seen, or of all where these are fewer
    than least; what it has seen reads easier, so the lower one counts all. Where a class has
    fewer than least rows for the upper one, those of the language, then of all languages, stand in.
    """
    known = scored.where("_trusted and log_perplexity is not null")
    own = F.col("log_perplexity")
    if known.where("_apart").count() >= least:
        own = F.when(F.col("_apart"), own)
    q = F.array(F.percentile_approx("log_perplexity", low, 20_000), F.percentile_approx(own, high, 20_000))
    cube = known.groupingSets([["lang", "_len"], ["lang"], []], "lang", "_len").agg(F.grouping_id().alias("_g"), F.count(own).alias("n"), q.alias("q"))
    cube = materialize(cube, "quantiles")
    every = cube.where("_g = 3").first()  # quantiles over all languages
    rest = F.array(*map(F.lit, every["q"])) if every and every["q"] else F.lit(None).cast("array<double>")
    own = cube.where((F.col("_g") == 0) & (F.col("n") >= least)).select(F.col("lang").alias("l"), F.col("_len").alias("k"), F.col("q").alias("q0"))
    wide = cube.where((F.col("_g") == 1) & (F.col("n") >= least)).select(F.col("lang").alias("l"), F.col("q").alias("q1"))
    out = scored.select("lang", "_len").distinct().join(own, F.col("lang").eqNullSafe(F.col("l")) & (F.col("_len") == F.col("k")), "left").drop("l", "k")
    out = out.join(wide, F.col("lang").eqNullSafe(F.col("l")), "left").drop("l")
    q = F.coalesce("q0", "q1", rest)
    wider = SLACK * (q[1] - q[0])
    return out.select("lang", "_len", (q[0] - wider).alias("low"), (q[1] + wider).alias("high"))


def classify(docs: DataFrame, labels: DataFrame, low: float = 0.002, high: float = 0.998) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, low, high and keep of every row of docs.

    low and high are the perplexities at these quantiles of the trusted documents (labels of
    quality 1) of the row's language and class of lengths, and SLACK beyond; a row between them
    is kept. n_symbols counts bytes of UTF-8; texts are read whole, however long. A null or
    empty text has no perplexity and isn't kept. A null lang is a language of its own. Without
    trusted documents there are no limits and every text that isn't empty is kept. Rows that
    share a doc_id are judged each for itself. Other columns are ignored; an empty table gives
    an empty result.
    """
    return judged(docs, labels, low, high).drop("tie")


def judged(docs: DataFrame, labels: DataFrame, low: float = 0.002, high: float = 0.998) -> DataFrame:
    """The rows of classify with tie, a hash of the text."""
    scored = score(docs, labels)
    bounds = F.broadcast(limits(scored, low, high).withColumnsRenamed({"lang": "_l", "_len": "_k"}))  # a few rows a language
    out = scored.join(bounds, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("_len") == F.col("_k")), "left")
    p = F.col("log_perplexity")
    keep = p.isNotNull() & F.coalesce(p >= F.col("low"), F.lit(True)) & F.coalesce(p <= F.col("high"), F.lit(True))
    return out.select("doc_id", "lang", "tie", "n_symbols", F.exp(p).alias("perplexity"), F.exp("low").alias("low"), F.exp("high").alias("high"), keep.alias("keep"))


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that classify rejects, each judged for itself, with or without a doc_id.

    So null and empty texts go; an empty table gives an empty one; other columns pass as they are.
    """
    out = judged(docs, labels).where("not keep").select(F.col("doc_id").alias("_d"), F.col("lang").alias("_l"), F.col("tie").alias("_t"))
    out = materialize(out.distinct(), "rejected")
    if out.count() <= BROADCAST_IDS:
        out = F.broadcast(out)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    at = F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & lang.eqNullSafe(F.col("_l")) & (_tie() == F.col("_t"))
    return docs.join(out, at, "left_anti").select(*docs.columns)
