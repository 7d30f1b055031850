"""Operator 9: nearest neighbours by a navigable small-world graph per shard.

Vectors are dealt to shards of about SHARD_ROWS by hash. A task builds a shard's
hierarchical graph: layers of geometrically fewer nodes, each node's links chosen among its
nearest so that none is nearer to an earlier choice than to the node itself, and kept as flat
arrays of neighbours. Blocks of queries walk down each shard's layers together; the results
of the shards are merged after an exact rescoring in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomrec.llm.common import materialize, tidy

SHARD_ROWS = 4096
QUERY_BLOCK = 2048
LINKS, POOL, BEAM, STEP = 32, 96, 144, 4
THIN = 16
TINY = np.float32(-3)


@dataclass
class Graph:
    """layers: from the top one down, (nodes, neighbours): numbers into vectors, -1 for none; the last has all nodes."""

    vectors: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray]]


def _links(x: np.ndarray) -> np.ndarray:
    """Neighbours of each row of x among its rows, by the selection rule, with links back."""
    n = len(x)
    sims = x @ x.T
    np.fill_diagonal(sims, TINY)
    pool = min(POOL, n - 1)
    if pool < 1:
        return np.full((n, 1), -1, np.int32)
    near = np.argpartition(-sims, pool - 1, axis=1)[:, :pool]
    rows = np.arange(n)
    order = np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable")
    near = np.take_along_axis(near, order, 1)
    kept, count = np.full((n, LINKS), -1, np.int64), np.zeros(n, np.int64)
    spare = np.full((n, pool), -1, np.int64)
    for r in range(pool):
        c = near[:, r]
        between = np.where(kept >= 0, sims[c[:, None], np.maximum(kept, 0)], TINY).max(1)
        good = (count < LINKS) & (sims[rows, c] > between)
        kept[rows[good], count[good]] = c[good]
        count += good
        spare[~good, r] = c[~good]
    # free places go to the nearest that the rule passed over
    for r in range(pool):
        c = spare[:, r]
        good = (count < LINKS // 2) & (c >= 0)
        kept[rows[good], count[good]] = c[good]
        count += good
    a, b = np.nonzero(kept >= 0)
    b = kept[a, b]
    both = np.unique(np.concatenate([a * n + b, b * n + a]))
    a, b = both // n, both % n
    order = np.lexsort((-sims[a, b], a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    room = place < 2 * LINKS
    out = np.full((n, int(place[room].max()) + 1), -1, np.int32)
    out[a[room], place[room]] = b[room]
    return out


def build(vectors: np.ndarray, seed: int = 7) -> Graph:
    """The graph of unit vectors of single precision."""
    n = len(vectors)
    height = (-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(THIN)).astype(int)
    layers = []
    for level in range(int(height.max(initial=0)), -1, -1):
        nodes = np.flatnonzero(height >= level)
        own = _links(vectors[nodes])
        layers.append((nodes, np.where(own >= 0, nodes[np.maximum(own, 0)], -1).astype(np.int32)))
    return Graph(vectors, layers)


def search(graph: Graph, queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Numbers of the nodes nearest to each of queries (unit vectors), nearest first, -1 for none."""
    q, n = len(queries), len(graph.vectors)
    at = np.repeat(graph.layers[0][0][:1], q)
    best = np.einsum("ij,ij->i", queries, graph.vectors[at])
    for nodes, links in graph.layers[:-1]:
        while True:
            near = links[np.searchsorted(nodes, at)]
            sims = np.where(near >= 0, np.einsum("id,ijd->ij", queries, graph.vectors[np.maximum(near, 0)]), TINY)
            top = sims.argmax(1)
            better = sims[np.arange(q), top] > best
            if not better.any():
                break
            at = np.where(better, near[np.arange(q), top], at)
            best = np.where(better, sims[np.arange(q), top], best)
    links = graph.layers[-1][1]
    beam = min(beam, n)
    ids, sims = np.full((q, beam), -1, np.int64), np.full((q, beam), TINY, np.float32)
    done = np.ones((q, beam), bool)
    ids[:, 0], sims[:, 0], done[:, 0] = at, best, False
    seen = np.zeros((q, n + 1), bool)
    seen[np.arange(q), at] = True
    live = np.arange(q)
    while len(live):
        # the STEP best nodes of each beam that haven't been opened
        score = np.where(done[live], TINY, sims[live])
        pick = np.argsort(-score, axis=1, kind="stable")[:, :STEP]
        opened = np.take_along_axis(score, pick, 1) > TINY
        go = opened[:, 0]
        live, pick, opened = live[go], pick[go], opened[go]
        if not len(live):
            break
        row = live[:, None]
        from_ = np.where(opened, ids[row, pick], -1)
        done[row, pick] = True
        near = np.where(from_[:, :, None] >= 0, links[np.maximum(from_, 0)], -1).reshape(len(live), -1)
        near = np.where(near < 0, n, near).astype(np.int64)
        near.sort(1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        fresh = (near < n) & ~seen[row, near]
        seen[row, near] = True
        i, j = np.nonzero(fresh)
        new = np.full(near.shape, TINY, np.float32)
        new[i, j] = np.einsum("ij,ij->i", queries[live[i]], graph.vectors[near[i, j]])
        all_sims = np.concatenate([sims[live], new], 1)
        all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], 1)
        all_done = np.concatenate([done[live], ~fresh], 1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        sims[live], ids[live], done[live] = (np.take_along_axis(x, top, 1) for x in (all_sims, all_ids, all_done))
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part, one a vec_id (the least embedding)."""
    e = F.col("embedding")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & e.isNotNull() & ~F.exists(e, bad) & F.exists(e, lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(1, keepdims=True)  # squares neither overflow nor vanish
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def _pack(rows: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    values = rows.values
    ids = values.field("vec_id").to_numpy(zero_copy_only=False).astype(np.int64)
    vectors = values.field("embedding")
    return ids, vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


GRAPH = "shard int, ids binary, vectors binary, members binary, starts binary, layers array<struct<nodes:binary,links:binary>>"


def index(rows: DataFrame, shard_rows: int = SHARD_ROWS, keep: int = 6) -> DataFrame:
    """One row a shard of rows (vec_id, embedding): its graph as flat arrays.

    Equal vectors share a node, which lists the ``keep`` least of their ids: with keep - 1
    neighbours asked for, no other can be among the result.
    """
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.size("embedding").alias("dim")).agg(F.collect_list(F.struct("vec_id", "embedding")).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, rows in zip(batch.column("shard").to_pylist(), batch.column("rows"), strict=True):
                ids, x = _pack(rows)
                order = np.argsort(ids, kind="stable")
                ids, x = ids[order], np.ascontiguousarray(x[order])
                _, first, node = np.unique(x.view(f"V{x.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
                order = np.argsort(node, kind="stable")  # ids stay in order within a node
                place = np.arange(len(ids)) - np.searchsorted(node[order], node[order])
                order = order[place < keep]
                starts = np.searchsorted(node[order], np.arange(len(first) + 1))
                graph = build(_unit(x[first]))
                layers = [{"nodes": a.astype(np.int32).tobytes(), "links": b.tobytes()} for a, b in graph.layers]
                kind = pa.list_(pa.struct([("nodes", pa.binary()), ("links", pa.binary())]))
                data = [[shard], [ids[first].tobytes()], [x[first].tobytes()], [ids[order].tobytes()], [starts.astype(np.int64).tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(data[0], pa.int32()), *(pa.array(v, pa.binary()) for v in data[1:]), pa.array([layers], kind)], names=["shard", "ids", "vectors", "members", "starts", "layers"])

    return dealt.select("shard", "rows").mapInArrow(tidy(run), GRAPH)


def _found(k: int, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                get = lambda name: batch.column(name)[row]  # noqa: E731, B023
                ids = np.frombuffer(get("ids").as_py(), np.int64)
                x = np.frombuffer(get("vectors").as_py()).reshape(len(ids), -1)
                members, starts = np.frombuffer(get("members").as_py(), np.int64), np.frombuffer(get("starts").as_py(), np.int64)
                layers = []
                for part in get("layers").as_py():
                    nodes = np.frombuffer(part["nodes"], np.int32)
                    layers.append((nodes, np.frombuffer(part["links"], np.int32).reshape(len(nodes), -1)))
                asked, q = _pack(get("rows"))
                if q.shape[1] != x.shape[1]:
                    continue  # vectors of another width have no angle to these
                best = search(Graph(_unit(x), layers), _unit(q), beam)[:, : 4 * k + 4]
                nq, nx = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
                out: list[tuple[int, int, float]] = []
                for i in range(len(asked)):
                    nodes = best[i][best[i] >= 0]
                    score = (x[nodes] @ q[i]) / (nx[nodes] * nq[i])
                    own = [(-s, m) for s, node in zip(score.tolist(), nodes.tolist(), strict=True) for m in members[starts[node] : starts[node + 1]].tolist() if m != asked[i]]
                    out += [(int(asked[i]), m, -s) for s, m in sorted(own)[:k]]
                yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, shard_rows: int = SHARD_ROWS, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each row whose vec_id is divisible by every.

    Nearness is the cosine in double precision; ties go to the smaller vec_id; a query isn't
    its own candidate, and has fewer rows if there are fewer candidates. Vectors that are
    null, empty or zero, or hold a null or a number that isn't finite, take no part, nor do
    rows without a vec_id. Rows that repeat a vec_id count as one, the least by components. A
    query meets vectors of its own width only. Other columns are ignored; an empty table gives an
    empty result.
    """
    rows = materialize(usable(vectors), "vectors")
    graphs = materialize(index(rows, shard_rows, k + 1), "graphs")
    asked = rows.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.groupBy(F.pmod(F.xxhash64("vec_id", F.lit("query")), F.lit(blocks)).cast("int").alias("block"), F.size("embedding").alias("dim")).agg(F.collect_list(F.struct("vec_id", "embedding")).alias("rows"))
    pairs = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(asked, "block")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = pairs.repartition(parts, F.xxhash64("shard", "block", "dim")).select("ids", "vectors", "members", "starts", "layers", "rows").mapInArrow(tidy(_found(k, beam)), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
