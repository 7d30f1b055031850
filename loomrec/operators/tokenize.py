"""Token matrices, embedding jobs and token vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomrec.functions.schedule import adaptive_batch_size
from loomrec.sources.files import Ledger, read_token_matrix, write_token_matrix


def word_ids(df: DataFrame, column: str, size: int = 30_000) -> DataFrame:
    """df with ids, the hashes of its words in range(1, size): a stand-in for an external tokenizer."""
    words = F.filter(F.split(F.lower(column), r"\s+"), lambda w: w != "")
    own = lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % (size - 1) + 1).cast("int")
    return df.withColumn("ids", F.transform(words, own))


def tokenized(df: DataFrame, column: str, tokenizer: Callable[[list[str]], list[list[int]]]) -> DataFrame:
    """df with ids by a tokenizer, which gets a batch's texts; null texts are empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = tokenizer([x or "" for x in batch.column(column).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, "ids"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def padded(df: DataFrame, width: int = 2000, pad: int = 0) -> DataFrame:
    """df with input_ids and attention_mask of one width, cut or padded at the end."""
    n = F.least(F.size("ids"), F.lit(width))
    fill = lambda v, k: F.array_repeat(F.lit(v), k.cast("int"))
    return df.withColumns({"input_ids": F.concat(F.slice("ids", 1, width), fill(pad, width - n)), "attention_mask": F.concat(fill(1, n), fill(0, width - n)), "length": n})


def batches_by_length(df: DataFrame, base: int = 64, reference: int = 512) -> DataFrame:
    """df with batch_size, sorted by length within ranges of it."""
    return df.withColumn("batch_size", adaptive_batch_size(F.col("length"), base, reference)).repartitionByRange("length").sortWithinPartitions("length")


def hashing_encoder(width: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Texts to unit vectors by hashed words: a stand-in for an external model."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), width))
        for i, text in enumerate(texts):
            for w in (text or "").lower().split():
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
                out[i, h % width] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def halving(encoder: Callable[[list[str]], np.ndarray], texts: list[str]) -> np.ndarray:
    """encoder(texts); where memory runs out, each half by itself, down to single texts."""
    try:
        return encoder(texts)
    except MemoryError:
        if len(texts) < 2:
            raise
    half = len(texts) // 2
    return np.concatenate([halving(encoder, texts[:half]), halving(encoder, texts[half:])])


def like_lengths(lengths: np.ndarray, base: int, reference: int) -> Iterator[np.ndarray]:
    """The rows in batches of like lengths, the longest first; a batch has as many as its longest row allows."""
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        longest = int(lengths[order[at]])
        size = base if longest <= reference else max(1, int(base * (reference / longest) ** 2))
        yield order[at : at + size]
        at += size


def embed(df: DataFrame, column: str, encoder: Callable[[list[str]], np.ndarray], base: int = 64, reference: int = 512) -> DataFrame:
    """df with embedding, in the order of df: the encoder gets batches of like lengths, in words, of what came to Python at once.

    Batches of long texts are smaller, by the square of the length, and halved where memory runs out.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(column).to_pylist()]
            rows: list = [None] * len(texts)
            for some in like_lengths(np.array([len(x.split()) for x in texts], np.int64), base, reference):
                for i, v in zip(some.tolist(), halving(encoder, [texts[i] for i in some]).astype(np.float32), strict=True):
                    rows[i] = v
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float32()))], names=[*batch.schema.names, "embedding"])

    return df.mapInArrow(run, schema)


def left_to_do(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that an interrupted job has not written yet."""
    return todo.join(done.select(key), key, "left_anti")


def embed_job(df: DataFrame, key: str, column: str, encoder: Callable[[list[str]], np.ndarray], path: str, parts: int = 16) -> DataFrame:
    """key and embedding of every row of df, read from path, where a job that was stopped goes on.

    df is read once: its rows are dealt to parts by a hash of key and written under path. A part's embeddings are
    written by themselves and then entered in the ledger, with their number and a checksum; parts that the ledger has
    are not done again, what else lies in their folders is written anew. While parts are left, another number of rows
    or parts is an error; once all are done, a table that has grown is dealt again, without the keys that are there.
    key tells rows apart. Embeddings too many or too few are an error.
    """
    spark = df.sparkSession
    book = Ledger(spark, f"{path}/ledger")
    kind = T.StructType([df.schema[key], T.StructField("embedding", T.ArrayType(T.FloatType()))])
    items = df.count()
    begun = book.entries()
    heads = sorted((e for e in begun if e["part"] < 0), key=lambda e: e["turn"])
    done = {(e["turn"], e["part"]) for e in begun if e["part"] >= 0}
    last = heads[-1] if heads else None
    whole = last is None or all((last["turn"], k) in done for k in range(last["parts"]))
    if not whole and (last["items"], last["parts"]) != (items, parts):
        raise ValueError(f"{path} was begun with {last['items']} rows in {last['parts']} parts, not {items} in {parts}")
    if whole and (last is None or items > last["items"]):
        turn = last["turn"] + 1 if last else 0
        todo = df.select(key, column)
        if last:
            todo = left_to_do(todo, spark.read.schema(kind).parquet(f"{path}/embeddings"), key)
        dealt = todo.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        dealt.repartition("_part").write.mode("overwrite").partitionBy("_part").parquet(f"{path}/input-{turn}")
        book.enter(f"turn-{turn}", turn=turn, part=-1, items=items, parts=parts)
        last = {"turn": turn}
    turn = last["turn"]
    given = T.StructType([df.schema[key], df.schema[column], T.StructField("_part", T.IntegerType())])
    for part in range(parts):
        if (turn, part) in done:
            continue
        todo = spark.read.schema(given).parquet(f"{path}/input-{turn}").where(F.col("_part") == part).select(key, column)
        todo = todo.sortWithinPartitions(F.desc(F.coalesce(F.length(column), F.lit(0))))  # what comes to the encoder at once is of like lengths
        folder = f"{path}/embeddings/turn={turn}/part={part}"
        embed(todo, column, encoder).select(key, "embedding").write.mode("overwrite").parquet(folder)
        rows, checksum = spark.read.schema(kind).parquet(folder).agg(F.count("*"), F.sum(F.xxhash64(key, "embedding").cast("decimal(38,0)"))).first()
        book.enter(f"part-{turn}-{part}", turn=turn, part=part, rows=rows, checksum=str(checksum or 0))
    if (n := sum(e["rows"] for e in book.entries() if e["part"] >= 0)) != items:
        raise ValueError(f"{n} embeddings were written for {items} rows")
    return spark.read.schema(kind).parquet(f"{path}/embeddings").select(key, "embedding")


def embedding_pipeline(df: DataFrame, key: str, column: str, tokenizer: Callable[[list[str]], list[list[int]]], encoder: Callable[[list[str]], np.ndarray], path: str, width: int = 2000) -> DataFrame:
    """The token matrix of df, written to path/tokens, then the embeddings, written to path/embeddings and returned."""
    tokens = padded(tokenized(df.select(F.col(key).alias("id"), column), column, tokenizer), width)
    write_token_matrix(tokens, f"{path}/tokens")
    read_token_matrix(df.sparkSession, f"{path}/tokens", df.count())
    return embed_job(df, key, column, encoder, f"{path}/embeddings")


def grounded_vectors(codebook: DataFrame, hidden: int, norm: float, seed: int = 0) -> DataFrame:
    """level, code and vector of width hidden: codes under one orthonormal projection, scaled so that each level's mean norm is ``norm``."""
    from loomrec.operators.quantize import codebook_arrays

    books = codebook_arrays(codebook)
    width = books[0].shape[1]
    if hidden < width:
        raise ValueError("the projection must not lose dimensions")
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(hidden, width)))
    rows = []
    for level, book in enumerate(books):
        scale = norm / max(float(np.linalg.norm(book, axis=1).mean()), 1e-12)
        rows += [(level, i, v) for i, v in enumerate((book @ q.T * scale).tolist())]
    return codebook.sparkSession.createDataFrame(rows, "level int, code int, vector array<double>")


def distinct_vectors(tokens: DataFrame, hidden: int, norm: float, seed: int = 0) -> DataFrame:
    """token and vector: a random direction of its own for every token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for token in batch.column("token").to_pylist():
                own = int.from_bytes(hashlib.md5(f"{seed}|{token}".encode()).digest()[:8], "big")
                v = np.random.default_rng(own).normal(size=hidden)
                out.append((v * norm / np.linalg.norm(v)).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("token"), pa.array(out, pa.list_(pa.float64()))], names=["token", "vector"])

    return tokens.select("token").mapInArrow(run, "token string, vector array<double>")
