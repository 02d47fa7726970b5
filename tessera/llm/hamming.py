"""Exact top-k search in Hamming space by incremental multi-index hashing.

A vector's code is the signs of its values, 64 bits (other lengths are projected on 64 fixed random
directions first). Codes are cut in segments; an index block sorts its codes by each segment. A query
looks up its own segments' values first, then all values one bit away, then two, one segment after the
other. After radius r in the first j+1 segments and r-1 in the others every code within
(j+1)(r+1) + (m-j-1)r - 1 bits has been met, so the search ends once the kth verified distance is not
above that: the k nearest, ties by id, are then proven.

Scale: the index is dealt in blocks of BLOCK_ROWS by a hash of the id. A block is shipped and indexed once
(while there are fewer blocks than tasks, once for each of a few groups of queries), and all queries stream
past it in parts of QUERY_ROWS, 16 bytes a query; a query set of a fixed share of the rows against all rows,
in blocks. The k best of each block meet by query; a window keeps the k best of them.
Of equal codes in a block the k smallest ids are enough, so large groups of equal vectors cost
nothing. Recall against brute force is 1: the result is exact.

Defined cases: null vectors (or null values in them) have no code: they are neither found nor searched
for; null ids neither; fewer than k rows give all of them; repeated rows are rows of their own; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import shuffle_partitions, stored

BITS, K = 64, 10
BLOCK_ROWS, QUERY_ROWS = 1 << 20, 1 << 11
#: Lookups that are expanded at a time.
PROBES = 1 << 21
_U = np.uint64


def codes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the vectors, and which vectors have one."""
    out, valid = np.zeros(len(column), np.uint64), np.zeros(len(column), bool)
    sizes = np.array([-1 if v is None else v for v in column.value_lengths().to_pylist()], np.int64)
    for dims in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == dims)
        values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dims)
        good = ~np.isnan(values).any(axis=1)
        if dims != BITS:
            values = np.nan_to_num(values) @ np.random.default_rng(int(dims)).standard_normal((dims, BITS))
        out[rows] = np.packbits(values > 0, axis=1).view(">u8")[:, 0].astype(np.uint64)
        valid[rows[good]] = True
    return out, valid


def coded(vectors: DataFrame) -> DataFrame:
    """id and code of vectors (id, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, valid = codes_of(batch.column(1))
            ids = batch.column(0).filter(pa.array(valid))
            yield pa.RecordBatch.from_arrays([ids, pa.array(codes[valid].view(np.int64))], ["id", "code"])

    return vectors.filter("id is not null and embedding is not null").select(F.col("id").cast("long"), "embedding").mapInArrow(run, "id long, code long")


def packed(rows: DataFrame, block: Column) -> DataFrame:
    """block, ids, codes: a row for each block."""

    def pack(table: pa.Table) -> pa.Table:
        ids, codes = (table.column(c).to_numpy().astype("<i8").tobytes() for c in ("id", "code"))
        return pa.table({"block": table.column("block")[:1], "ids": pa.array([ids], pa.binary()), "codes": pa.array([codes], pa.binary())})

    return rows.select(block.cast("int").alias("block"), "id", "code").groupBy("block").applyInArrow(pack, "block int, ids binary, codes binary")


class Index:
    """The codes of one block, sorted by each of their segments."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, k: int) -> None:
        order = np.lexsort((ids, codes))
        ids, codes = ids[order], codes[order]
        new = np.concatenate(([True], codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, bool)
        place = np.arange(len(codes)) - np.maximum.accumulate(np.where(new, np.arange(len(codes)), 0))
        self.ids, self.codes, self.k = ids[place < k], codes[place < k], k
        width = min(16, max(4, int(np.log2(max(len(self.ids), 2)))))
        edges = np.linspace(0, BITS, -(-BITS // width) + 1).astype(int)
        self.segments = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            values = self.part(self.codes, a, b)
            begin = np.concatenate([[0], np.cumsum(np.bincount(values, minlength=1 << (b - a)))])
            self.segments.append((a, b, np.argsort(values, kind="stable"), begin))

    @staticmethod
    def part(codes: np.ndarray, a: int, b: int) -> np.ndarray:
        return ((codes >> _U(a)) & _U((1 << (b - a)) - 1)).astype(np.int64)

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, id and distance of the k nearest of each query."""
        n, k, m = len(self.ids), self.k, len(self.segments)
        best = (np.zeros(0, np.int64),) * 3  # query, distance, row
        open_, kth, radius = np.arange(len(queries)), np.full(len(queries), BITS + 1), 0
        while n and len(open_):
            for j, (a, b, order, begin) in enumerate(self.segments):
                flips = np.array([sum(1 << x for x in c) for c in combinations(range(b - a), radius)], np.int64)
                step = max(1, PROBES // max(1, len(flips)))
                for at in range(0, len(open_), step) if len(flips) else ():
                    part = open_[at : at + step]
                    values = (self.part(queries[part], a, b)[:, None] ^ flips).ravel()
                    best = self.merged(best, np.repeat(part, len(flips)), begin[values], begin[values + 1], order, queries, kth)
                covered = (j + 1) * (radius + 1) + (m - j - 1) * radius - 1
                met = np.bincount(best[0], minlength=len(queries))
                full = met >= min(k, n)
                last = np.maximum.reduceat(best[1], np.flatnonzero(np.diff(best[0], prepend=-1))) if len(best[0]) else np.zeros(0, np.int64)
                kth[np.unique(best[0])] = np.where(met[met > 0] >= k, last, BITS + 1)
                done = (full & (kth <= covered)) | (covered >= BITS)
                open_ = open_[~done[open_]]
                if not len(open_):
                    break
            radius += 1
        return best[0], self.ids[best[2]], best[1]

    def merged(self, best: tuple, query: np.ndarray, lo: np.ndarray, hi: np.ndarray, order: np.ndarray, queries: np.ndarray, kth: np.ndarray) -> tuple:
        """The best so far and the rows of new buckets, verified: the k nearest of each query."""
        size = hi - lo
        hit = np.flatnonzero(size)
        if not len(hit):
            return best
        size, lo, query = size[hit], lo[hit], query[hit]
        rows = order[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)]
        query = np.repeat(query, size)
        distance = np.bitwise_count(self.codes[rows] ^ queries[query]).astype(np.int64)
        near = distance <= kth[query]
        q, d, r = (np.concatenate(x) for x in zip(best, (query[near], distance[near], rows[near]), strict=True))
        by = np.lexsort((self.ids[r], d, q))
        q, d, r = q[by], d[by], r[by]
        new = np.concatenate(([True], (q[1:] != q[:-1]) | (r[1:] != r[:-1]))) if len(q) else np.zeros(0, bool)
        q, d, r = q[new], d[new], r[new]
        place = np.arange(len(q)) - np.maximum.accumulate(np.where(np.diff(q, prepend=-1) != 0, np.arange(len(q)), 0))
        return q[place < self.k], d[place < self.k], r[place < self.k]


def shipped(rows: DataFrame, asked: DataFrame, blocks: int, parts: int, groups: int) -> DataFrame:
    """block, team, part, ids, codes: every block of rows once a team (part NULL), and every part of asked
    once a block, in the team that the part belongs to. Sorted so that a block comes before its queries."""
    index = packed(rows, F.pmod(F.xxhash64("id"), F.lit(blocks)))
    index = index.select("block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("team"), F.lit(None).cast("int").alias("part"), "ids", "codes")
    wanted = packed(asked.select(F.monotonically_increasing_id().alias("serial"), "id", "code"), F.pmod(F.xxhash64("serial"), F.lit(parts)))
    wanted = wanted.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("to"), F.pmod("block", F.lit(groups)).alias("team"), F.col("block").alias("part"), "ids", "codes")
    every = index.unionByName(wanted.withColumnRenamed("to", "block"))
    return every.repartition(min(blocks * groups, 1 << 14), "block", "team").sortWithinPartitions("block", "team", F.asc_nulls_first("part"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, id, distance: the k rows of vectors (id, embedding) nearest to each row of queries."""
    rows, asked = stored(coded(vectors)), stored(coded(queries))
    blocks = -(-max(rows.count(), 1) // block_rows)
    parts = -(-max(asked.count(), 1) // query_rows)
    groups = max(1, min(parts, shuffle_partitions(vectors.sparkSession) // blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, built = None, None
        for batch in batches:
            for block, team, part, ids, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held, found = np.frombuffer(ids, "<i8"), np.frombuffer(codes, "<u8")
                if part is None:
                    last, built = (block, team), Index(held, found, k)
                elif last == (block, team):  # else nothing hashed to this block
                    query, near, distance = built.search(found)
                    serial = (np.int64(part) << 32) + query
                    yield pa.RecordBatch.from_arrays([pa.array(serial), pa.array(held[query]), pa.array(near), pa.array(distance.astype(np.int32))], ["serial", "query_id", "id", "distance"])

    found = shipped(rows, asked, blocks, parts, groups).mapInArrow(run, "serial long, query_id long, id long, distance int")
    rank = F.row_number().over(Window.partitionBy("serial").orderBy("distance", "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
