"""Line deduplication over a whole corpus.

Lines are exploded, normalised (white space stripped at both ends, A-Z lower-cased) and hashed to 128 bits; for every
hash the distinct documents are counted; lines whose key occurs in `least` documents or more are dropped everywhere,
and the rest are joined again by position.

The commonest keys, at most `broadcast_keys` of them (16 bytes each), are sent to all tasks, so that no hot line meets
in one task; rarer ones, if there are any left, come by a shuffled join on the hash. Both give the same result. In that case what was kept so far is
stored, and rows whose text very many rows share get their positions by a broadcast.

Defined results: a null or empty text is one empty line. Empty keys are never dropped. Every row counts as a document of
its own, repeated rows and null ids included. Input columns stay; `kept_text`, `n_lines` and `n_dropped` replace input
columns of these names. A text that loses all its lines becomes empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowplan.llm.common import SPACES, attach, byte_texts, extended, join_counted, stepped, stored, table

LEAST_DOCUMENTS = 10
#: Bound of what is broadcast: 16 MB.
BROADCAST_KEYS = 1_000_000


def line_keys(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text, and the 16-byte hash of each key; b'' for the empty key."""
    lines = text.split(b"\n")
    return lines, [xxhash.xxh3_128_digest(k) if (k := line.strip(SPACES).lower()) else b"" for line in lines]


def key_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """h1, h2 (the hash of a key) and n (the documents that have it)."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stepped(batches, text, 4 << 20):
            found = [k for t in byte_texts(batch, text) for k in set(line_keys(t)[1]) if k]
            both = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["h1", "h2"])

    return docs.select(text).mapInArrow(explode, "h1 long, h2 long").groupBy("h1", "h2").agg(F.count("*").alias("n"))


class Keys:
    """A set of 16-byte hashes, in the memory of their bytes."""

    def __init__(self, raw: bytes) -> None:
        """`raw`: rows of two numbers, sorted."""
        both = np.frombuffer(raw, "<i8").reshape(-1, 2)
        self.first, self.second = both[:, 0], both[:, 1]
        # rows that share their first number: one, but for chance
        self.most = int(np.unique(self.first, return_counts=True)[1].max()) if len(both) else 0

    def found(self, hashes: list[bytes]) -> list[bool]:
        """Whether each hash is in the set; b'' never is."""
        if not self.most:
            return [False] * len(hashes)
        asked = np.frombuffer(b"".join(h or bytes(16) for h in hashes), "<i8").reshape(-1, 2)
        at = np.searchsorted(self.first, asked[:, 0])
        hit = np.zeros(len(asked), bool)
        for k in range(self.most):
            row = np.minimum(at + k, len(self.first) - 1)
            hit |= (self.first[row] == asked[:, 0]) & (self.second[row] == asked[:, 1])
        return [x and bool(h) for x, h in zip(hit.tolist(), hashes)]


def _drop(docs: DataFrame, text: str, common: np.ndarray) -> DataFrame:
    """Drop the lines with the given hashes (bytes of 16, sorted); adds kept_text, n_lines, n_dropped."""
    schema = extended(docs, T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()))
    names_out = schema.names
    shipped = docs.sparkSession.sparkContext.broadcast(common.tobytes())  # at most BROADCAST_KEYS hashes

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = Keys(shipped.value)
        for batch in stepped(batches, text, 4 << 20):
            kept, total, dropped = [], [], []
            for t in byte_texts(batch, text):
                lines, hashes = line_keys(t)
                gone = keys.found(hashes)
                rest = [line for line, out in zip(lines, gone) if not out]
                kept.append(b"\n".join(rest))
                total.append(len(lines))
                dropped.append(len(lines) - len(rest))
            yield attach(batch, names_out, {"kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "n_lines": pa.array(total, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())})

    return docs.mapInArrow(drop, schema)


def _drop_rest(docs: DataFrame, text: str, rest: DataFrame) -> DataFrame:
    """Drop further lines, those whose hash is in `rest` (a table of any size), by a shuffled join on the hash.

    Rows meet their dropped positions by two hashes of what was kept so far: equal texts lose the same lines.
    """
    kept = stored(docs.withColumns({"_t1": F.xxhash64(F.lit(1), "kept_text"), "_t2": F.xxhash64(F.lit(2), "kept_text")}), "kept-lines")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stepped(batches, "kept_text", 4 << 20):
            columns: list[list] = [[], [], [], []]
            digests = []
            for a, b, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_texts(batch, "kept_text")):
                at = [(i, h) for i, h in enumerate(line_keys(t)[1]) if h]
                columns[0] += [a] * len(at)
                columns[1] += [b] * len(at)
                columns[2] += [i for i, _ in at]
                digests += [h for _, h in at]
            both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["_t1", "_t2", "pos", "h1", "h2"])

    lines = kept.select("_t1", "_t2", "kept_text").dropDuplicates(["_t1", "_t2"]).mapInArrow(explode, "_t1 long, _t2 long, pos long, h1 long, h2 long")
    found = lines.join(rest.select("h1", "h2"), ["h1", "h2"]).groupBy("_t1", "_t2").agg(F.collect_set("pos").alias("_gone"))
    texts = stored(kept.groupBy("_t1", "_t2").agg(F.count("*").alias("_n")).join(found, ["_t1", "_t2"], "left"), "further-lines")
    out = join_counted(kept, texts, ["_t1", "_t2"], "_n", kept.count())
    lines_of = F.split("kept_text", "\n")
    gone = F.coalesce("_gone", F.array().cast("array<bigint>"))
    again = F.when(F.size(gone) == 0, F.col("kept_text")).otherwise(F.array_join(F.filter(lines_of, lambda x, i: ~F.array_contains(gone, i.cast("long"))), "\n"))
    return out.withColumns({"kept_text": again, "n_dropped": F.col("n_dropped") + F.size(gone)}).select(*docs.columns)


def dedup_lines(docs: DataFrame, text: str = "text", least: int = LEAST_DOCUMENTS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """`docs` with kept_text, n_lines and n_dropped."""
    common = stored(key_counts(docs, text).where(F.col("n") >= least), "common-lines")
    n = common.count()
    if n <= broadcast_keys:
        top, rest = common, None
    else:
        # the boundary count is taken from a histogram, so that no sort meets in one task
        sizes = common.groupBy("n").count().orderBy(F.desc("n")).limit(broadcast_keys).toLocalIterator()
        room, floor = broadcast_keys, None
        for row in sizes:
            if row["count"] > room:
                break
            room, floor = room - row["count"], row["n"]
        top = common.where(F.col("n") >= floor) if floor is not None else common.limit(0)
        rest = common.where(F.col("n") < floor) if floor is not None else common
    keys = top.select("h1", "h2").toPandas().to_numpy("<i8").reshape(-1, 2)
    out = _drop(docs, text, np.ascontiguousarray(keys[np.lexsort((keys[:, 1], keys[:, 0]))]))
    return out if rest is None else _drop_rest(out, text, rest)


def without_common_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with its columns, the text without common lines; null texts stay null."""
    out = dedup_lines(docs, text)
    return out.select(*[F.when(F.col(text).isNotNull(), F.col("kept_text")).alias(text) if c == text else F.col(c) for c in docs.columns])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op2_line_dedup": op2_line_dedup}
SQL = {
    "op2_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
j AS (SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY r, doc_id
""",
}
