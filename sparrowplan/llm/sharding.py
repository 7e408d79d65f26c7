"""Sharding by best-fit-decreasing bin packing.

Documents with equal texts form an indivisible group. Groups sorted by size, largest first, enter the bin with the
tightest remaining capacity that still holds them, found in a balanced tree. With a fixed capacity this minimises the
number of shards; with a fixed number of shards the smallest capacity that suffices is searched for, which makes the
shards' sizes near equal. A group larger than an even share gets a shard to itself, and the others share out the rest evenly.

Groups of one size are interchangeable, so the driver packs a histogram of sizes, many groups of a size at once; the outcome is that of packing the
groups one by one. The histogram has few rows: d different sizes add up to d * d / 2 at least, so that 100 TB can't have more than 14 million,
and real texts have far fewer. Each group then finds its bin by its size and its rank among the groups of that size. Texts are read
once and never shuffled, only their hashes and sizes.

Defined results: a null text has no bytes, checksum 0, and is a group apart from the empty text. Repeated rows and null
ids are rows like others. Slots number each shard's rows from 0 without gaps, in the order of a hash of the row, then
the row. An empty table gives no rows. Input columns stay (those of `keep`, if given); the operator's replace those of the same names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowplan.llm.common import join_counted, stored, table

SHARDS = 40
OVERHEAD = 16
#: Rows, about, that one task numbers.
SLOT_ROWS = 4096
#: Runs (some 50 bytes each) up to which they are broadcast.
BROADCAST_RUNS = 100_000


class CapacityTree:
    """Open bins in a height-balanced search tree, ordered by remaining capacity, then number."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root = None

    # a node is [key, left, right, height]
    @staticmethod
    def _height(node: list | None) -> int:
        return node[3] if node else 0

    def _fixed(self, node: list) -> list:
        node[3] = 1 + max(self._height(node[1]), self._height(node[2]))
        lean = self._height(node[1]) - self._height(node[2])
        if abs(lean) < 2:
            return node
        near, far = (1, 2) if lean > 0 else (2, 1)
        child = node[near]
        if self._height(child[far]) > self._height(child[near]):
            node[near] = child = self._turned(child, far, near)
        return self._turned(node, near, far)

    def _turned(self, node: list, near: int, far: int) -> list:
        child = node[near]
        node[near], child[far] = child[far], node
        node[3] = 1 + max(self._height(node[1]), self._height(node[2]))
        child[3] = 1 + max(self._height(child[1]), self._height(child[2]))
        return child

    def add(self, key: tuple[int, int]) -> None:
        def put(node: list | None) -> list:
            if node is None:
                return [key, None, None, 1]
            side = 1 if key < node[0] else 2
            node[side] = put(node[side])
            return self._fixed(node)

        self.root = put(self.root)

    def remove(self, key: tuple[int, int]) -> None:
        def cut(node: list, key: tuple[int, int]) -> list | None:
            if key != node[0]:
                side = 1 if key < node[0] else 2
                node[side] = cut(node[side], key)
                return self._fixed(node)
            if node[1] is None or node[2] is None:
                return node[1] or node[2]
            least = node[2]
            while least[1]:
                least = least[1]
            node[0] = least[0]
            node[2] = cut(node[2], least[0])
            return self._fixed(node)

        self.root = cut(self.root, key)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The bin with the least remaining capacity that is at least `size`."""
        node, best = self.root, None
        while node:
            if node[0] >= (size, -1):
                best, node = node[0], node[1]
            else:
                node = node[2]
        return best


@dataclass(frozen=True)
class Run:
    """Groups of one size in their order: the first is number `begin` of that size, and `each` of them go to a bin, from `bin` on."""

    size: int
    begin: int
    count: int
    bin: int
    each: int


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[Run] | None:
    """The bins of the items of a histogram of (size, how many), sizes falling; None if more than `most` bins are needed.

    As item by item: the tightest bin that holds an item stays the tightest for the next of that size, until it holds none any more.
    An item over the capacity has a bin alone.
    """
    tree, bins, out = CapacityTree(), 0, []
    least = sizes[-1][0] if sizes else 0  # bins with less room are full

    def put(room: int, at: int) -> None:
        if room >= least:
            tree.add((room, at))

    for size, n in sizes:
        begin = 0
        while begin < n:
            found = tree.tightest(size)
            if found:
                tree.remove(found)
                room, at = found
                k = min(n - begin, room // size)
                put(room - k * size, at)
                out.append(Run(size, begin, k, at, k))
                begin += k
                continue
            each = max(1, capacity // size)
            new = -(-(n - begin) // each)
            if most is not None and bins + new > most:
                return None
            out.append(Run(size, begin, n - begin, bins, each))
            for at in range(bins, bins + new):
                k = min(each, n - begin)
                put(max(capacity, size) - k * size, at)
                begin += k
            bins += new
    return out


def even_bins(sizes: list[tuple[int, int]], bins: int) -> list[Run]:
    """Bins of the items of a histogram: the smallest capacity, by galloping and halving, for which best fit decreasing needs no more than `bins`.

    Items above an even share of what is left get bins of their own first.
    """
    out: list[Run] = []
    rest = sum(size * n for size, n in sizes)
    left = list(sizes)
    alone = 0
    while left and alone < bins - 1 and left[0][0] * (bins - alone) >= rest:
        size, n = left[0]
        before = sum(r.count for r in out if r.size == size)
        out.append(Run(size, before, 1, alone, 1))
        alone, rest = alone + 1, rest - size
        left = ([(size, n - 1)] if n > 1 else []) + left[1:]
    if not left:
        return out
    taken = {r.size: r.begin + 1 for r in out}
    free = bins - alone
    below, step = max(left[0][0], -(-rest // free)) - 1, 1
    while (fitting := best_fit_decreasing(left, below + step, free)) is None:
        below, step = below + step, step * 2
    high = below + step
    while high - below > 1:
        mid = (below + high) // 2
        got = best_fit_decreasing(left, mid, free)
        if got is None:
            below = mid
        else:
            high, fitting = mid, got
    return out + [Run(r.size, r.begin + taken.get(r.size, 0), r.count, r.bin + alone, r.each) for r in fitting]


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", shards: int | None = SHARDS, capacity: int | None = None, keep: list[str] | None = None, broadcast_runs: int = BROADCAST_RUNS) -> DataFrame:
    """`docs` with size, text_crc32, shard and slot. Give `shards` for near-equal sizes, or `capacity` for the fewest shards.

    `keep`: the input columns that the result has (all by default); they are stored once, with the rows' sizes and hashes.
    """
    spark = docs.sparkSession
    own = {"size", "text_crc32", "shard", "slot"}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in own]
    new = {
        "size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD,
        "text_crc32": F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long"),
        "_g1": F.xxhash64(F.lit(1), text),
        "_g2": F.xxhash64(F.lit(2), text),
        "_none": F.col(text).isNull(),
        "_row": F.monotonically_increasing_id(),
        "_key": F.col(key),
    }
    rows = stored(docs.select(*kept, *[c.alias(n) for n, c in new.items()]), "shard-rows")
    group = ["_g1", "_g2", "_none"]
    groups = stored(rows.groupBy(*group).agg(F.sum("size").alias("_bytes"), F.count("*").alias("_n")), "shard-groups", narrow=True)
    # a row for each different size; see above
    sizes = [(r[0], r[1]) for r in groups.groupBy("_bytes").agg(F.count("*").alias("n")).orderBy(F.desc("_bytes")).toLocalIterator()]
    runs = even_bins(sizes, shards) if shards else best_fit_decreasing(sizes, capacity)
    assert runs is not None
    count = rows.count()
    ranked = stored(numbered(groups, "_bytes", group, "_rank", max(64, count // SLOT_ROWS)), "shard-ranks", narrow=True)
    parts = max(64, count // (SLOT_ROWS * (1 + max((r.bin for r in runs), default=0))))
    of_size = spark.createDataFrame([(r.size, r.begin, r.count, r.bin, r.each) for r in runs], "_bytes long, begin long, n long, bin int, per long")
    of_size = stored(of_size.groupBy("_bytes").agg(F.sort_array(F.collect_list(F.struct("begin", "n", "bin", "per"))).alias("_runs")), "shard-runs", narrow=True)
    if len(runs) <= broadcast_runs:
        placed = ranked.join(F.broadcast(of_size), "_bytes")
    else:
        share = groups.groupBy("_bytes").agg(F.count("*").alias("_of"))
        placed = join_counted(ranked, stored(of_size.join(share, "_bytes"), "shard-runs", narrow=True), ["_bytes"], "_of", ranked.count())
    mine = F.get(F.filter("_runs", lambda r: (r["begin"] <= F.col("_rank")) & (F.col("_rank") < r["begin"] + r["n"])), F.lit(0))
    placed = placed.withColumn("_run", mine).withColumn("shard", (F.col("_run.bin") + F.floor((F.col("_rank") - F.col("_run.begin")) / F.col("_run.per"))).cast("int"))
    placed = stored(placed.select(*group, "shard", "_n"), "shard-of", narrow=True)
    out = numbered(join_counted(rows, placed, group, "_n", count), "shard", ["_key", "size", "text_crc32", "_row"], "slot", parts)
    return out.select(*kept, "size", "text_crc32", "shard", "slot")


def numbered(rows: DataFrame, by: str, order: list[str], name: str, parts: int) -> DataFrame:
    """Adds the row's number among those of equal `by`, from 0. `order` tells all rows apart.

    Rows are numbered in parts by their hash, each a task's work, shifted by the parts before.
    """
    rows = rows.withColumn("_p", F.pmod(F.xxhash64(F.lit(3), *order), F.lit(parts)))
    before = Window.partitionBy(by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shift = rows.groupBy(by, "_p").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    inside = F.row_number().over(Window.partitionBy(by, "_p").orderBy(*order))
    return rows.withColumn("_i", inside).join(shift, [by, "_p"]).withColumn(name, (F.col("_i") - 1 + F.col("_before")).cast("long")).drop("_p", "_i", "_before")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op3_sharding": op3_sharding}
SQL: dict[str, str] = {}
