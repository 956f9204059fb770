"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, results merged.

Rows are dealt to shards of about SHARD_ROWS by a hash. A task builds its shard's graph by insertion: each node draws a level, is
linked at each level to diverse near nodes, and lists that overflow are thinned by the same rule. The graph is stored as flat
neighbour arrays, one row for each shard. For the largest inner product vectors get one more component that gives all of a shard
the same norm, so that the nearest by inner product are the nearest in space; a query has zero there. Equal vectors are one node with the
smallest ids of theirs that results can hold. Scores are computed anew from the original vectors in double precision.
"""

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from martloom.llm.common import release, stored
from martloom.llm.vectors import best, valid_vectors

SHARD_ROWS = 16_384
LINKS = 16
SLACK = 16
BUILD_WIDTH = 64
SEARCH_WIDTH = 128
PACKET = 256
QUERIES = 16_384


class Graph:
    """Flat neighbour arrays by level: at level 0 a row for each node, above only for the nodes that are there."""

    def __init__(self, vectors: np.ndarray, seed: int = 0):
        self.vectors = vectors
        n = len(vectors)
        draws = np.random.default_rng(seed).random(n)
        self.levels = np.minimum((-np.log(np.maximum(draws, 1e-12)) / np.log(LINKS)).astype(int), 8)
        self.near: list[np.ndarray] = []
        self.count: list[np.ndarray] = []
        self.slot: list[np.ndarray] = []
        for level in range(int(self.levels.max(initial=-1)) + 1):
            there = np.flatnonzero(self.levels >= level)
            slot = np.full(n, -1, np.int32)
            slot[there] = np.arange(len(there))
            self.near.append(np.full((len(there), self._most(level) + SLACK), -1, np.int32))
            self.count.append(np.zeros(len(there), np.int32))
            self.slot.append(slot)
        self.entry = -1
        for node in range(n):
            self._insert(node)

    @staticmethod
    def _most(level: int) -> int:
        return 2 * LINKS if level == 0 else LINKS

    def neighbours(self, node: int, level: int) -> np.ndarray:
        at = self.slot[level][node]
        return self.near[level][at, :self.count[level][at]]

    def _insert(self, node: int) -> None:
        level = int(self.levels[node])
        if self.entry < 0:
            self.entry = node
            return
        q, top = self.vectors[node], int(self.levels[self.entry])
        found = [(float(self.vectors[self.entry] @ q), self.entry)]
        for at in range(top, level, -1):
            found = self._search(q, found[:1], 1, at)
        for at in range(min(level, top), -1, -1):
            found = self._search(q, found, BUILD_WIDTH, at)
            chosen = self._diverse([x for _, x in found], [s for s, _ in found], LINKS)
            slot = self.slot[at][node]
            self.near[at][slot, :len(chosen)] = chosen
            self.count[at][slot] = len(chosen)
            for other in chosen:
                self._link(other, node, at)
        if level > top:
            self.entry = node

    def _link(self, node: int, other: int, level: int) -> None:
        slot = self.slot[level][node]
        n = self.count[level][slot]
        row = self.near[level][slot]
        row[n] = other
        n += 1
        if n == len(row):
            scores = self.vectors[row] @ self.vectors[node]
            order = np.argsort(-scores)
            chosen = self._diverse(row[order].tolist(), scores[order].tolist(), self._most(level))
            n = len(chosen)
            row[:n] = chosen
        self.count[level][slot] = n

    def _diverse(self, nodes: list[int], scores: list[float], most: int) -> list[int]:
        """Nodes, nearest first, that are nearer to the base than to any chosen before; then the nearest others."""
        if len(nodes) <= most:
            return nodes
        x = self.vectors[nodes]
        between = x @ x.T
        nearest = np.full(len(nodes), -np.inf, np.float32)
        chosen, passed = [], []
        for i, s in enumerate(scores):
            if s > nearest[i]:
                chosen.append(i)
                if len(chosen) == most:
                    break
                np.maximum(nearest, between[i], out=nearest)
            else:
                passed.append(i)
        return [nodes[i] for i in (chosen + passed)[:most]]

    def _search(self, q: np.ndarray, start: list[tuple[float, int]], width: int, level: int) -> list[tuple[float, int]]:
        """The ``width`` best nodes that a best-first search from ``start`` meets, best first."""
        seen = {x for _, x in start}
        todo = [(-s, x) for s, x in start]
        heapq.heapify(todo)
        kept = list(start)
        heapq.heapify(kept)
        while todo:
            s, node = heapq.heappop(todo)
            if len(kept) >= width and -s < kept[0][0]:
                break
            new = [x for x in self.neighbours(node, level).tolist() if x not in seen]
            if not new:
                continue
            seen.update(new)
            for score, x in zip((self.vectors[new] @ q).tolist(), new):
                if len(kept) < width:
                    heapq.heappush(kept, (score, x))
                    heapq.heappush(todo, (-score, x))
                elif score > kept[0][0]:
                    heapq.heapreplace(kept, (score, x))
                    heapq.heappush(todo, (-score, x))
        return sorted(kept, reverse=True)

    def search(self, q: np.ndarray, width: int) -> list[int]:
        if self.entry < 0:
            return []
        found = [(float(self.vectors[self.entry] @ q), self.entry)]
        for at in range(int(self.levels[self.entry]), 0, -1):
            found = self._search(q, found[:1], 1, at)
        return [x for _, x in self._search(q, found, width, 0)]

    def flat(self) -> dict:
        """Levels, entry and neighbour arrays as bytes."""
        return {"levels": self.levels.astype("<i4").tobytes(), "entry": self.entry, "near": [a.astype("<i4").tobytes() for a in self.near],
                "count": [c.astype("<i4").tobytes() for c in self.count]}

    @classmethod
    def of_flat(cls, vectors: np.ndarray, flat: dict) -> "Graph":
        self = cls.__new__(cls)
        self.vectors, self.entry = vectors, flat["entry"]
        self.levels = np.frombuffer(flat["levels"], "<i4")
        self.near = [np.frombuffer(a, "<i4").reshape(-1, cls._most(i) + SLACK) for i, a in enumerate(flat["near"])]
        self.count = [np.frombuffer(c, "<i4") for c in flat["count"]]
        self.slot = []
        for level in range(len(self.near)):
            slot = np.full(len(vectors), -1, np.int32)
            there = np.flatnonzero(self.levels >= level)
            slot[there] = np.arange(len(there))
            self.slot.append(slot)
        return self


def _unique(ids: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, list[list[int]]]:
    """Distinct vectors and up to ``most`` smallest ids of each; ids come in rising."""
    vectors, which = np.unique(x, axis=0, return_inverse=True)
    held: list[list[int]] = [[] for _ in range(len(vectors))]
    for i, w in zip(ids.tolist(), which.ravel().tolist()):
        if len(held[w]) < most:
            held[w].append(i)
    return vectors, held


def _augmented(x: np.ndarray) -> np.ndarray:
    squared = (x * x).sum(1)
    return np.concatenate([x, np.sqrt(np.maximum(squared.max(initial=0) - squared, 0))[:, None]], 1).astype(np.float32)


INDEX = "shard int, ids array<array<bigint>>, vectors binary, dimension int, levels binary, entry int, near array<binary>, count array<binary>"


def build_index(rows: DataFrame, k: int) -> DataFrame:
    """One row per shard of (vec_id, v): the distinct vectors, the ids they stand for, and the graph's flat arrays."""
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    # Each shard's rows come to a task of its own as they are, none of them in a row of the whole shard.
    dealt = rows.select(_dealt(shards).alias("shard"), "vec_id", "v").repartitionById(shards, "shard").sortWithinPartitions("shard")

    def indexed(shard: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, x = _vectors(parts)
        order = np.argsort(ids, kind="stable")
        vectors, held = _unique(ids[order], x[order], k + 1)
        order = np.random.default_rng(1).permutation(len(vectors))
        vectors, held = vectors[order], [held[i] for i in order]
        flat = Graph(_augmented(vectors)).flat()
        values = {"shard": shard, "ids": held, "vectors": vectors.astype("<f8").tobytes(), "dimension": vectors.shape[1], **flat}
        return pa.RecordBatch.from_pylist([values], schema=pa.schema([
            ("shard", pa.int32()), ("ids", pa.list_(pa.list_(pa.int64()))), ("vectors", pa.binary()), ("dimension", pa.int32()),
            ("levels", pa.binary()), ("entry", pa.int32()), ("near", pa.list_(pa.binary())), ("count", pa.list_(pa.binary()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts = None, []
        for shard, part in _runs(batches):
            if shard != last and parts:
                yield indexed(last, parts)
                parts = []
            last = shard
            parts.append(part)
        if parts:
            yield indexed(last, parts)
        release()

    return dealt.mapInArrow(run, INDEX)


def _dealt(parts: int):
    """The number of the part that a row belongs to by its id."""
    return F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches of rows that are ordered by their first column cut where its value changes, with the value."""
    for batch in batches:
        keys = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield int(keys[a]), batch.slice(a, b - a)


def _vectors(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of rows whose columns vec_id and v are set."""
    ids = np.concatenate([p.column("vec_id").to_numpy() for p in parts])
    return ids, np.concatenate([p.column("v").flatten().to_numpy() for p in parts]).reshape(len(ids), -1)


def search_index(index: DataFrame, queries: DataFrame, k: int, width: int = SEARCH_WIDTH) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found over all shards, for queries (vec_id, v).

    A task has one shard and about QUERIES queries; the shard's row comes first and once, and its queries follow as rows of their own.
    """
    parts = max(1, -(-queries.count() // QUERIES))
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    names = [c for c in index.columns if c != "shard"]
    wanted = index.withColumn("part", each(parts)).select((F.col("shard") * parts + F.col("part")).alias("task"), F.lit(0).alias("kind"), *names,
                                                          F.lit(None).cast("bigint").alias("vec_id"), F.lit(None).cast("array<double>").alias("v"))
    nothing = [F.lit(None).cast(index.schema[c].dataType).alias(c) for c in names]
    asked = queries.withColumn("part", _dealt(parts)).withColumn("shard", each(shards))
    asked = asked.select((F.col("shard") * parts + F.col("part")).alias("task"), F.lit(1).alias("kind"), *nothing, "vec_id", "v")
    joined = wanted.unionByName(asked).repartitionById(shards * parts, "task").sortWithinPartitions("task", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, exact, held = None, None, None
        for _, rows in _runs(batches):
            if rows.column("kind")[0].as_py() == 0:
                r = {name: rows.column(name)[0].as_py() for name in names}
                exact = np.frombuffer(r["vectors"], "<f8").reshape(-1, r["dimension"])
                graph = Graph.of_flat(_augmented(exact), {c: r[c] for c in ("levels", "entry", "near", "count")})
                held = r["ids"]
                rows = rows.slice(1)
            for start in range(0, rows.num_rows, PACKET):
                query_ids, q = _vectors([rows.slice(start, PACKET)])
                out = []
                for query, vector in zip(query_ids.tolist(), q):
                    found = graph.search(np.append(vector, 0).astype(np.float32), max(width, k + 1))
                    scores = exact[found] @ vector
                    near = [(-s, i) for s, x in zip(scores.tolist(), found) for i in held[x] if i != query]
                    out += [(query, i, -s) for s, i in heapq.nsmallest(k, near)]
                columns = list(zip(*out)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
                                                 ["query_id", "vec_id", "score"])
        release()

    return best(joined.mapInArrow(run, "query_id bigint, vec_id bigint, score double"), k)


def nearest(df: DataFrame, is_query, k: int, id_col: str = "vec_id", vector_col: str = "embedding", width: int = SEARCH_WIDTH) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found by inner product, nearest first, ties to the smaller vec_id.

    ``is_query`` is a condition on vec_id. Candidates are all rows of another vec_id. Vectors that ``valid_vectors`` leaves out and
    zero vectors take no part; an empty table gives no rows; fewer than k candidates give fewer rows. Every row is in the index.
    """
    rows = valid_vectors(df, id_col, vector_col).where(F.exists("v", lambda x: x != 0))
    rows = stored(rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "v"), "vectors")
    index = stored(build_index(rows, k), "index")
    return search_index(index, rows.where(is_query(F.col("vec_id"))), k, width)
