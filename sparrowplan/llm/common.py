"""Helpers that the corpus operators share: joins with hot keys, batches and token hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowplan.storage import stored  # noqa: F401

#: Text bytes that one vectorised step works on, so that its arrays stay a few tens of MB.
STEP_BYTES = 1 << 20

#: Keys that `join_counted` broadcasts, at most.
HOT_KEYS = 1000

#: The six white-space bytes `[\x20\x09-\x0D]`.
SPACES = b" \t\n\x0b\x0c\r"


def join_counted(rows: DataFrame, known: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """`rows` joined with `known`, which has each key once; its column `count` has the key's rows, out of `total`. Both should be stored.

    Keys with more than 1 / HOT_KEYS of all rows are fewer than HOT_KEYS; these are broadcast, so that no hot key meets in one task. The others
    are shuffled, and none of them has more rows than that share.
    """
    hot = F.col(count) > total // HOT_KEYS
    heavy = F.broadcast(known.where(hot))
    light = rows.join(F.broadcast(known.where(hot).select(*keys)), keys, "left_anti").join(known.where(~hot), keys)
    return rows.join(heavy, keys).unionByName(light)


def fixed(df: DataFrame, name: str) -> DataFrame:
    """`df`, stored unless it comes straight from its source: after a shuffle, a task that runs again may give rows in another order."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return stored(df, name) if "Exchange" in plan or "ExistingRDD" in plan else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: Column, by: int) -> Column:
    """crc32 of the key as text, modulo `by`; a null key counts as the empty string."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % by


def extended(df: DataFrame, *fields: T.StructField) -> T.StructType:
    """The input's columns, then the new ones; a new column replaces an input column of its name (in any case)."""
    new = {f.name.lower() for f in fields}
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in new] + list(fields))


def attach(batch: pa.RecordBatch, names: list[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    """`batch` with the arrays of `new`, its columns in the order of `names`."""
    return pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(batch.schema.get_field_index(n)) for n in names], names=names)


def stepped(batches: Iterable[pa.RecordBatch], text: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes of text at most, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([0 if n is None else n for n in pc.binary_length(batch.column(batch.schema.get_field_index(text))).to_pylist()])
        step = np.cumsum(sizes + 64) // limit
        cuts = np.flatnonzero(np.diff(step)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(int(a), int(b - a))


def byte_texts(batch: pa.RecordBatch, text: str) -> list[bytes]:
    """The texts as UTF-8; null as empty."""
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]


_POWERS = np.ones(1, np.uint64)
_RANDOM = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def byte_classes(separators: Iterable[int]) -> np.ndarray:
    """A value for each byte: 0 for separators, else a random odd number that A-Z share with a-z."""
    values = _RANDOM.copy()
    values[65:91] = values[97:123]
    values[list(separators)] = 0
    return values


WORDS = byte_classes(SPACES)
LETTERS = byte_classes(b for b in range(128) if not chr(b).isalpha())


def _hashed(buffer: bytes, values: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and start of every token of the buffer, then of the prefixes (in bytes) of the tokens that are longer."""
    global _POWERS
    if not buffer:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    v = values[np.frombuffer(buffer, np.uint8)]
    at = np.flatnonzero(v)
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    lengths = np.diff(first, append=len(at))
    longest = int(lengths.max())
    if longest > len(_POWERS):
        _POWERS = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * longest, 0x9E3779B97F4A7C15, np.uint64)]))
    within = np.arange(len(at)) - np.repeat(first, lengths)
    terms = v[at] * _POWERS[within]
    hashes, starts = [mixed(np.add.reduceat(terms, first))], [at[first]]
    for k in prefixes:
        longer = lengths > k
        part = mixed(np.add.reduceat(np.where(within < k, terms, np.uint64(0)), first)[longer] + np.uint64(k))
        hashes.append(part)
        starts.append(at[first][longer])
    return np.concatenate(hashes), np.concatenate(starts)


def hashed_tokens(texts: list[bytes], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens in order, and the index of each text's first token (one more at the end).

    Tokens are maximal runs of bytes that `values` doesn't class as separators, A-Z and a-z alike. A line
    feed must be a separator.
    """
    buffer = b"\n".join(texts)
    h, at = _hashed(buffer, values)
    ends = np.cumsum([0] + [len(t) + 1 for t in texts])
    return h, np.searchsorted(at, ends)


def pieces(text: bytes, limit: int = STEP_BYTES) -> list[bytes]:
    """A very long text cut at white space into pieces of about `limit` bytes; joined, they are the text."""
    out, begin = [], 0
    while len(text) - begin > limit:
        cut = max(text.rfind(bytes([s]), begin + limit // 2, begin + limit) for s in SPACES)
        if cut < 0:
            later = [c for s in SPACES if (c := text.find(bytes([s]), begin + limit)) >= 0]
            if not later:
                break
            cut = min(later)
        out.append(text[begin : cut + 1])
        begin = cut + 1
    out.append(text[begin:])
    return out


def document_terms(texts: list[bytes], values: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of all tokens and of the prefixes of longer tokens, in no order."""
    hashes, docs, held, of, size = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [], [], 0

    def flush() -> None:
        h, at = _hashed(b"\n".join(held), values, prefixes)
        hashes.append(h)
        docs.append(np.array(of, np.int64)[np.searchsorted(np.cumsum([len(x) + 1 for x in held]), at, side="right")])

    for i, text in enumerate(texts):
        for piece in pieces(text):
            held.append(piece)
            of.append(i)
            size += len(piece)
            if size > STEP_BYTES:
                flush()
                held, of, size = [], [], 0
    if held:
        flush()
    return np.concatenate(hashes), np.concatenate(docs)


def document_tokens(texts: list[bytes], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As hashed_tokens, with bounded working memory for very long texts."""
    if sum(map(len, texts)) <= 2 * STEP_BYTES:
        return hashed_tokens(texts, values)
    hashes, counts = [], []
    for text in texts:
        found = [hashed_tokens([p], values)[0] for p in pieces(text)]
        hashes += found
        counts.append(sum(map(len, found)))
    return np.concatenate(hashes), np.cumsum([0, *counts])
