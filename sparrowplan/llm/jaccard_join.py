"""N-gram Jaccard join and near-duplicate classes.

A document is its set of hashed runs of N words (white space divides words, A-Z lower-cased; a text of fewer words is one
run). Documents with equal sets collapse to one node first. MinHash signatures are cut into bands, with band and row counts chosen for a
target recall; nodes that agree on a band are candidates, and candidates are verified on their full sets.

Candidates aren't written out as pairs. Each band value names a leader, its smallest node, and all nodes that share a leader form a group, so
that any two candidates meet in a group; large groups are dealt out in blocks, each pair of blocks being one task's work, and what
leaves a task is a spanning forest and counts. A pair that meets in several groups is counted in one of them. Classes are the
connected components of the verified links, found by contracting stars over stored tables. Where a join's key may be hot (a band, a leader or a
root that very many nodes share), keys with many rows are broadcast, so that their rows stay where they are.

Defined results: documents without words have no set, link to nothing and are classes of their own. Repeated rows and documents with equal sets are
copies: in one class, with links to each other. Ids are read as whole numbers (text that is none raises an error). Null ids sort after all
others. The class id is the smallest id in the class, and null where none is known. `n_links` counts the other documents at or above the threshold. Clashing columns don't matter: only the
id and the text are read. Very long texts are whole sets. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowplan.llm.common import WORDS, byte_texts, document_tokens, join_counted, mixed, stepped, stored, table

N = 5
THRESHOLD = 0.8
RECALL = 0.999999
MAX_HASHES = 128
#: Stands for a null id, after all others.
NO_ID = (1 << 63) - 1
#: Nodes of a block; a task verifies the pairs of two blocks.
BLOCK = 160
#: Members (some 100 bytes each) up to which they are broadcast to find their texts.
BROADCAST_MEMBERS = 200_000


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """Bands and rows with the most rows (the fewest chance candidates) that reach the recall at the threshold within `most` hashes."""
    for rows in range(most, 0, -1):
        for bands in range(1, most // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                return bands, rows
    return most, 1


def shingle_sets(texts: list[bytes], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """The sorted set of hashed runs of n words of each text, one after another, and where each begins (one more at the end)."""
    h, starts = document_tokens(texts, WORDS)
    sizes = np.diff(starts)
    doc = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(starts[1:], sizes) - np.arange(len(h))  # words from here to the end of the text
    total = np.zeros(len(h), np.uint64)
    for k in range(n):
        part = np.zeros(len(h), np.uint64)
        if len(h) > k:
            part[: len(h) - k] = h[k:]
        part[left <= k] = 0
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + part + np.uint64(k))
    first = np.repeat(starts[:-1], sizes) == np.arange(len(h))
    keep = (left >= n) | (first & (np.repeat(sizes, sizes) < n))
    total, doc = total[keep], doc[keep]
    order = np.lexsort((total, doc))
    total, doc = total[order], doc[order]
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (doc[1:] != doc[:-1])
    return total[new], np.searchsorted(doc[new], np.arange(len(texts) + 1))


def signatures(sets: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash for each band of each text that has a set; equal texts and bands have equal hashes."""
    full = np.flatnonzero(np.diff(starts))
    out = np.zeros((len(full), bands), np.uint64)
    if not len(full):
        return out
    rng = np.random.default_rng(99)
    a = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    begin = starts[full]
    for k in range(bands * rows):
        low = np.minimum.reduceat(sets * a[k] + b[k], begin)
        out[:, k // rows] = mixed(out[:, k // rows] * np.uint64(0x9E3779B97F4A7C15) + low + np.uint64(k // rows))
    return out


def _fingerprints(sets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set; 0 for the empty one."""
    sums = []
    for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
        c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(sets ^ np.uint64(salt)), dtype=np.uint64)])
        sums.append(mixed(c[starts[1:]] - c[starts[:-1]] + np.diff(starts).astype(np.uint64)).view(np.int64))
    return sums[0], sums[1]


def _signed(docs: DataFrame, text: str, key: str, n: int, bands: int, rows: int) -> DataFrame:
    """k, t (a hash of the text), f1, f2 (of the set), size, bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stepped(batches, "_text"):
            sets, starts = shingle_sets(byte_texts(batch, "_text"), n)
            f1, f2 = _fingerprints(sets, starts)
            size = np.diff(starts)
            got = signatures(sets, starts, bands, rows).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(f1), pa.array(f2), pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(got.reshape(-1)))], names=["k", "t", "f1", "f2", "size", "bands"])

    return docs.select(F.col(key).cast("long").alias("k"), F.xxhash64(text).alias("t"), F.col(text).alias("_text")).mapInArrow(sign, "k long, t long, f1 long, f2 long, size int, bands array<long>")


def verified(sets: list[np.ndarray], weight: np.ndarray, leaders: list[tuple[int, ...]], leader: int, split: int | None, threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node to others of its group (copies counted), and the smallest index each is connected to.

    With `split`, only pairs of one node before that index and one from it on are looked at.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(m), size)
    value, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    number = np.cumsum(times > 1) - 1
    row, column = row[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((m, m), np.float32)
    width = 8192
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [a, a + width])
        x = np.zeros((m, min(width, int(column[hi - 1]) - a + 1)), np.float32)
        x[row[lo:hi], column[lo:hi] - a] = 1
        common += x @ x.T
    both = size[:, None] + size[None, :] - common
    near = threshold.denominator * common.astype(np.float64) >= threshold.numerator * both.astype(np.float64)
    np.fill_diagonal(near, False)
    if split is not None:
        near[:split, :split] = False
        near[split:, split:] = False
    kinds = {x: i for i, x in enumerate(dict.fromkeys(leaders))}
    kind = np.array([kinds[x] for x in leaders])
    names = [set(x) for x in kinds]
    here = np.array([[min(x & y) == leader for y in names] for x in names])  # a pair counts in its first group
    links = (near & here[kind[:, None], kind[None, :]]) @ weight
    label = np.arange(m)
    while True:
        best = np.where(near, label[None, :], m).min(1, initial=m)
        new = np.minimum(label, best)
        new = new[new]
        if (new == label).all():
            return links, label
        label = new


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node it is connected to) for every node of the edges (u, v). Stars are contracted until nothing changes."""

    def stars(e: DataFrame) -> tuple[DataFrame, tuple]:
        e = stored(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars", narrow=True)
        return e, tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now, state = stars(edges)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        least = stored(least, "least", narrow=True)
        large, (n, _) = stars(join_counted(both, least, ["u"], "n", 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least", narrow=True)
        small = join_counted(large, least, ["u"], "n", n)
        now, new = stars(small.select("v", "m").union(small.select("u", "m")).toDF("u", "v"))
        if new == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        state = new


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, broadcast_members: int = BROADCAST_MEMBERS) -> DataFrame:
    """k (the id), t (a hash of the text), class_id, n_links and root (the class by its nodes, null without a set) for each row of `docs`."""
    bands, rows = bands_and_rows(threshold, recall)
    exact = Fraction(str(threshold))
    signed = stored(_signed(docs, text, key, n, bands, rows), "signatures")
    known = F.coalesce("k", F.lit(NO_ID))
    groups = signed.where("size > 0").groupBy("f1", "f2").agg(F.count("*").alias("copies"), F.min(F.struct(known.alias("k"), "t")).alias("low"), F.first("bands").alias("bands"))
    nodes = stored(groups.select(F.monotonically_increasing_id().alias("node"), "f1", "f2", "copies", F.col("low.k").alias("low"), F.col("low.t").alias("low_t"), "bands"), "nodes")
    exploded = nodes.select("node", F.explode("bands").alias("band"))
    leads = stored(exploded.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1"), "leads", narrow=True)
    member = stored(join_counted(exploded, leads, ["band"], "n", bands * nodes.count()).select("node", "leader").distinct(), "leaders", narrow=True)
    # a leader that follows a smaller one hands its group over, so that one large class has few groups
    above = member.groupBy("node").agg(F.min("leader").alias("over")).withColumnRenamed("node", "leader")
    above = stored(above.join(member.groupBy("leader").agg(F.count("*").alias("n")), "leader"), "above", narrow=True)
    member = stored(join_counted(member, above, ["leader"], "n", member.count()).select("node", F.col("over").alias("leader")).distinct(), "groups", narrow=True)
    sizes = stored(member.groupBy("leader").agg(F.count("*").alias("m")), "sizes", narrow=True)
    mine = join_counted(member, sizes, ["leader"], "m", member.count()).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("leader", "m"))).alias("leads"))
    ids = stored(nodes.join(mine, "node").select(F.col("low").alias("_low"), F.col("low_t").alias("_t"), "node", F.col("f1").alias("_f1"), F.col("f2").alias("_f2"), "copies", "leads"), "members", narrow=True)
    few = ids.count() <= broadcast_members
    texts = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("_low"), F.xxhash64(text).alias("_t"), F.col(text).alias("_text"))

    def texts_of(some: DataFrame) -> DataFrame:
        return texts.join(F.broadcast(some) if few else some, ["_low", "_t"]).drop("_low", "_t")

    # of copies, rows may repeat the id and text of the node's row; one of them is enough
    source = texts_of(ids.where("copies = 1")).unionByName(texts_of(ids.where("copies > 1")).dropDuplicates(["node"]))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stepped(batches, "_text"):
            sets, starts = shingle_sets(byte_texts(batch, "_text"), n)
            f1, f2 = _fingerprints(sets, starts)
            # two texts of one id may share their hash; the set tells them apart
            same = (f1 == batch.column(batch.schema.get_field_index("_f1")).to_numpy()) & (f2 == batch.column(batch.schema.get_field_index("_f2")).to_numpy())
            raw = pa.array([sets[a:b].tobytes() for a, b in zip(starts, starts[1:])], pa.binary())
            out = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in ("node", "copies", "leads")] + [raw], names=["node", "copies", "leads", "set"])
            yield out.filter(pa.array(same))

    full = source.mapInArrow(sets_of, "node long, copies long, leads array<struct<leader:long,m:long>>, set binary")
    each = full.select("node", "copies", F.col("leads.leader").alias("leaders"), "set", F.explode("leads").alias("lead"))
    blocks = F.ceil(F.col("lead.m") / block).cast("int")
    each = each.select("node", "copies", "leaders", "set", F.col("lead.leader").alias("leader"), blocks.alias("nb"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("x"))
    dealt = each.select("leader", "node", "copies", "leaders", "set", "x", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("y")).select("leader", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "x", "node", "copies", "leaders", "set")

    def verify(t: pa.Table) -> pa.Table:
        rows_ = {r["node"]: r for r in t.to_pylist()}  # rows with one id and one set come once
        i, j, leader = (t.column(c)[0].as_py() for c in ("i", "j", "leader"))
        got = sorted(rows_.values(), key=lambda r: (r["x"] != i, r["node"]))
        cut = sum(r["x"] == i for r in got)
        links, label = verified([np.frombuffer(r["set"], np.uint64) for r in got], np.array([r["copies"] for r in got], np.float64), [tuple(r["leaders"]) for r in got], leader, None if i == j else cut, exact)
        node = np.array([r["node"] for r in got], np.int64)
        keep = (links > 0) | (label != np.arange(len(node)))
        return pa.table({"u": node[keep], "v": node[label[keep]], "links": links[keep].astype(np.int64)})

    found = stored(dealt.groupBy("leader", "i", "j").applyInArrow(verify, "u long, v long, links long"), "links")
    links = found.groupBy("u").agg(F.sum("links").alias("links")).withColumnRenamed("u", "node")
    roots = components(found.select("u", "v"))
    placed = nodes.select("node", "f1", "f2", "copies", "low").join(roots, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = stored(placed, "classes", narrow=True)
    lows = stored(placed.groupBy("root").agg(F.min("low").alias("class_id"), F.count("*").alias("n")), "lows", narrow=True)
    placed = join_counted(placed, lows, ["root"], "n", nodes.count()).select("f1", "f2", "root", "class_id", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    placed = stored(placed, "class-of", narrow=True)
    own = signed.select("k", "t", "f1", "f2", "size")
    of = F.when(F.col("class_id") == NO_ID, F.lit(None)).otherwise(F.col("class_id"))
    in_class = join_counted(own.where("size > 0"), placed, ["f1", "f2"], "copies", signed.count()).select("k", "t", of.alias("class_id"), "n_links", "root")
    return in_class.unionByName(own.where("size = 0").select("k", "t", F.col("k").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("root")))


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each class: that with the class's id, of several (ids repeated or all null) that with the smallest hash of the text.

    Of rows that repeat an id and text, one stays.
    """
    found = stored(near_duplicates(docs, text, key), "near-duplicates", narrow=True)
    # rows with the class's id: one a class unless ids are repeated or null
    best = found.where("root is not null and k <=> class_id").select("root", "k", "t").distinct()
    several = best.groupBy("root").agg(F.min("t").alias("least"), F.count("*").alias("n")).where("n > 1").select("root", "least")
    others = best.join(several, "root").where("t <> least").select("k", "t")
    gone = found.where("class_id is not null and not (k <=> class_id)").select("k", "t").union(others).toDF("_k", "_t").distinct()
    same = F.col(key).eqNullSafe(F.col("_k")) & (F.xxhash64(text) == F.col("_t"))
    kept = docs.join(gone, same, "left_anti")
    repeated = stored(found.groupBy("k", "t").count().where("count > 1").select(F.col("k").alias("_k"), F.col("t").alias("_t")), "repeated", narrow=True)
    if not repeated.limit(1).count():
        return kept
    return kept.join(repeated, same, "left_anti").unionByName(kept.join(repeated, same, "left_semi").dropDuplicates([key, text]))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(F.col("k").alias("doc_id"), "class_id", "n_links")


QUERIES = {"op8_jaccard_join": op8_jaccard_join}
SQL: dict[str, str] = {}
