"""Exact top-k search by inner product over a bit-sliced index.

The quantised components of a block of rows are kept as bit slices: a bitmap over the rows for each bit of each
attribute. A query's scores are the sum of its weighted attributes, added with bitmap arithmetic only (carry-save
adders on whole stacks of slices). The best rows are selected from the most significant slice of the sum downward;
rows that tie at the boundary are resolved exactly, the smaller id first.

Queries are held against all rows in blocks: at most QUERY_BLOCK queries are broadcast at a time, each task keeps k rows
a query, and a last step ranks what the tasks kept.

Defined results: vectors that are null or empty, or hold a null or a non-finite component, and rows without an id take
no part. A query's own rows are those with its id. Repeated rows are candidates each; a query id with several different
vectors that take part asks with the smallest of them. Only vectors of equal length are compared. Ids are read as whole numbers (text that is none
raises an error). Only what 64 bits can't hold is refused with an error: a component beyond +-2^62 after quantisation, or a score to be returned
that is no long. Clashing column names don't matter: only the id and the vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowplan.llm.common import stored, table

SCALE = 256
BLOCK_ROWS = 1 << 15
QUERY_BLOCK = 20_000
LARGEST = 1 << 62


def quantised(ids: pa.Array, vectors: pa.Array, scale: int = SCALE) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the ids and whole-number vectors of the rows that take part."""
    wide = vectors.cast(pa.list_(pa.float64()))
    lengths = np.array([-1 if n is None else n for n in wide.value_lengths().to_pylist()], np.int64) if len(wide) else np.empty(0, np.int64)
    known = np.array(ids.is_valid().to_pylist(), bool)
    key = np.array(ids.fill_null(0).to_pylist(), np.int64)
    out = {}
    for n in np.unique(lengths[(lengths > 0) & known]).tolist():
        at = np.flatnonzero((lengths == n) & known)
        x = wide.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
        good = np.isfinite(x).all(1)
        x = np.floor(scale * x[good])
        if len(x) and np.abs(x).max() > LARGEST:
            raise ValueError("a quantised component is beyond +-2^62")
        out[n] = (key[at[good]], x.astype(np.int64))
    return out


class SlicedBlock:
    """Bit slices of one block of rows, in the order of their ids."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        n, dims = x.shape
        low = self.x.min(0)
        u = self.x.astype(np.uint64) - low.astype(np.uint64)  # differences of 63 bits at most
        self.bits = [int(m).bit_length() for m in u.max(0)]
        words = -(-n // 64)
        slices, self.dim, self.bit = [], [], []
        for d in range(dims):
            for j in range(self.bits[d]):
                packed = np.packbits(((u[:, d] >> np.uint64(j)) & np.uint64(1)).astype(np.uint8), bitorder="little")
                slices.append(np.pad(packed, (0, words * 8 - len(packed))).view(np.uint64))
                self.dim.append(d)
                self.bit.append(j)
        plain = np.array(slices, np.uint64).reshape(-1, words)
        self.slices = np.concatenate([plain, ~plain])
        self.dim, self.bit = np.array(self.dim, np.int64), np.array(self.bit, np.int64)
        every = np.packbits(np.ones(n, np.uint8), bitorder="little")
        self.rows = np.pad(every, (0, words * 8 - len(every))).view(np.uint64)

    def sums(self, q: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of every row's score plus a constant of the query."""
        size, negative = np.abs(q), q < 0
        picked, weight = [], []
        for i in range(int(size.max()).bit_length() if len(size) else 0):
            s = np.flatnonzero((size[self.dim] >> i) & 1)
            picked.append(s + negative[self.dim[s]] * len(self.dim))  # a negative weight adds the complement
            weight.append(self.bit[s] + i)
        if not picked:
            return []
        at, weights = np.concatenate(picked), np.concatenate(weight)
        stacks = {int(w): [self.slices[at[weights == w]]] for w in np.unique(weights)}
        out, w = [], 0
        while stacks:
            stack = np.concatenate(stacks.pop(w)) if w in stacks else np.zeros((0, len(self.rows)), np.uint64)
            carries = []
            while len(stack) > 1:
                if len(stack) == 2:
                    carries.append(stack[0:1] & stack[1:2])
                    stack = stack[0:1] ^ stack[1:2]
                    break
                k = len(stack) // 3
                a, b, c = stack[:k], stack[k : 2 * k], stack[2 * k : 3 * k]
                half = a ^ b
                carries.append((a & b) | (half & c))
                stack = np.concatenate([half ^ c, stack[3 * k :]])
            out.append(stack[0] if len(stack) else np.zeros(len(self.rows), np.uint64))
            if carries:
                stacks.setdefault(w + 1, []).extend(carries)
            w += 1
        return out

    def top(self, query: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows that aren't the query's own."""
        tied = self.rows.copy()
        for i in range(*np.searchsorted(self.ids, [query, query + 1])):
            tied[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        sure = np.zeros_like(tied)
        for s in reversed(self.sums(q)):
            with_bit = tied & s
            n = int(np.bitwise_count(sure | with_bit).sum())
            if n > k:
                tied = with_bit
            else:
                sure = sure | with_bit
                tied = tied & ~s
                if n == k:
                    tied = np.zeros_like(tied)
                    break
        got = _positions(sure, k)
        at = np.concatenate([got, _positions(tied, k - len(got))])
        return self.ids[at], _products(self.x[at], q)


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products."""
    most = len(q) * int(np.abs(x).max(initial=0)) * int(np.abs(q).max(initial=0))
    if most < 1 << 63:
        return x @ q
    wide = x.astype(object) @ q.astype(object)
    if any(not -(1 << 63) <= s < 1 << 63 for s in wide):
        raise OverflowError("a score is beyond 64 bits")
    return wide.astype(np.int64)


def _positions(bitmap: np.ndarray, most: int) -> np.ndarray:
    """The first `most` set positions."""
    if most <= 0:
        return np.empty(0, np.int64)
    full = np.flatnonzero(bitmap)[:most]
    bits = np.unpackbits(bitmap[full].view(np.uint8), bitorder="little").reshape(-1, 64)
    row, bit = np.nonzero(bits)
    return (full[row] * 64 + bit)[:most]


def _best(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    query, vec, score = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    first = np.searchsorted(query, query, side="left")
    keep = np.arange(len(query)) - first < k
    return query[keep], vec[keep], score[keep]


def search(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the k best of `rows` for each row of `queries`."""
    spark = rows.sparkSession
    asked = queries.select(F.col(key).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v")).where("q is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))").groupBy("q").agg(F.min("v").alias("v"))
    blocks = max(1, -(-asked.count() // query_block))
    results = []
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).toArrow().combine_chunks()
        by_length = quantised(part.column("q").combine_chunks(), part.column("v").combine_chunks()) if part.num_rows else {}
        shipped = spark.sparkContext.broadcast(by_length)  # about `query_block` vectors

        def scan(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            asks = shipped.value
            held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

            def flush(n: int) -> None:
                block = SlicedBlock(np.concatenate([i for i, _ in held[n]]), np.concatenate([x for _, x in held[n]]))
                held[n] = []
                for query, q in zip(*asks[n]):
                    vec, score = block.top(int(query), q, k)
                    found.append((np.full(len(vec), query), vec, score))
                found[:] = [_best(found, k)] if found else []

            for batch in batches:
                for n, (ids, x) in quantised(batch.column(0), batch.column(1)).items():
                    if n in asks and len(ids):
                        held.setdefault(n, []).append((ids, x))
                        if sum(len(i) for i, _ in held[n]) >= BLOCK_ROWS:
                            flush(n)
            for n in held:
                if held[n]:
                    flush(n)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found[0]], names=["query_id", "vec_id", "score"])

        near = rows.select(F.col(key).cast("long"), F.col(vector)).mapInArrow(scan, "query_id long, vec_id long, score long")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        results.append(stored(ranked, "topk") if blocks > 1 else ranked)
        if blocks > 1:
            shipped.destroy()
    out = results[0]
    for r in results[1:]:
        out = out.union(r)
    return out


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where(F.col("vec_id") % 50 == 0), k=5)


QUERIES = {"op5_topk_search": op5_topk_search}
SQL = {
    "op5_topk_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT vec_id, min(x) AS x FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
      FROM a q, v c WHERE c.vec_id <> q.vec_id AND len(c.x) = len(q.x)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
}
