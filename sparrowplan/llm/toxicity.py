"""Toxicity by a factorization machine over hashed terms.

A document is the set of its terms (runs of letters, A-Z lower-cased, and prefixes of them), each hashed into a table of 2^TERM_BITS rows of
parameters; terms that meet in a row share it. The score is the logistic function of a bias, a weight for each term, and the products of short
vectors for each pair of terms, so that the machine can learn that two terms together mean what neither does alone. No term is left out. It is
trained on a bounded, deterministic sample of labelled rows (TRAIN_ROWS, about; rows that repeat an id of it all teach, MOST_ROWS at most).

Defined results: null and empty texts get the score of the bias alone. Rows without a label, or with a null id or label, teach nothing; if a document
has several labels the highest holds. Without any label the score is 0. Repeated rows are scored alike. Input columns stay;
`score` and `predicted` replace input columns of these names. Very long texts are read piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowplan.llm.common import LETTERS, STEP_BYTES, attach, byte_texts, document_terms, extended, remainder, stepped, stored, table

TRAIN_ROWS = 20_000
#: Rows that share ids with the sample may be more; beyond this, rows are drawn from them by a hash of the text.
MOST_ROWS = 2 * TRAIN_ROWS
#: Rows of the table of parameters, as a power of two.
TERM_BITS = 20
FACTORS = 4
#: Prefixes, in bytes, that are terms too, so that inflected forms share what is learned.
PREFIXES = (4, 5, 6)
EPOCHS = 16
RATE = 0.1
#: Pull of weights and vectors to zero, against gradients averaged over a batch: terms that tell little get none, rare ones are not learned by heart.
L1, L1_VECTORS = 1.5e-3, 3e-4
BATCH = 256


def term_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of all texts, in order, and where each text's begin (one more at the end)."""
    h, doc = document_terms(texts, LETTERS, PREFIXES)
    key = np.unique((doc.astype(np.uint64) << np.uint64(TERM_BITS)) | (h >> np.uint64(64 - TERM_BITS)))
    return (key & np.uint64((1 << TERM_BITS) - 1)).astype(np.uint32), np.searchsorted((key >> np.uint64(TERM_BITS)).astype(np.int64), np.arange(len(texts) + 1))


@dataclass(frozen=True)
class Machine:
    bias: float
    weight: np.ndarray  # a number for each row of the table
    vectors: np.ndarray

    def margin(self, terms: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The score before the logistic function, for each text."""
        n = len(starts) - 1
        doc = np.repeat(np.arange(n), np.diff(starts))
        out = self.bias + np.bincount(doc, self.weight[terms], n)
        for f in range(self.vectors.shape[1]):
            v = self.vectors[terms, f].astype(np.float64)
            out += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
        return out


def fit(terms: np.ndarray, starts: np.ndarray, y: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """Adaptive gradient descent on the logistic loss, in batches; the same input gives the same machine. Terms that aren't met have no weight."""
    size = 1 << TERM_BITS
    if not len(y):
        return Machine(-np.inf, np.zeros(size, np.float32), np.zeros((size, factors), np.float32))
    rng = np.random.default_rng(seed)
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
    names = np.flatnonzero(np.bincount(terms, minlength=size))
    row_of = np.zeros(size, np.int32)
    row_of[names] = np.arange(len(names))
    at = row_of[terms]
    b, w, v = float(np.log(mean / (1 - mean))), np.zeros(len(names)), rng.normal(0, 0.01, (len(names), factors))
    gb, gw, gv = 1e-6, np.full(len(names), 1e-4), np.full(v.shape, 1e-4)
    met, place = np.zeros(len(names), bool), np.empty(len(names), np.int64)
    for _ in range(epochs):
        for part in np.array_split(order := rng.permutation(len(y)), max(1, len(order) // BATCH)):
            sizes = starts[part + 1] - starts[part]
            row = np.repeat(np.arange(len(part)), sizes)
            x = at[np.repeat(starts[part] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]
            vx = v[x]
            s = np.stack([np.bincount(row, vx[:, f], len(part)) for f in range(factors)], 1)
            q = np.stack([np.bincount(row, vx[:, f] ** 2, len(part)) for f in range(factors)], 1)
            m = b + np.bincount(row, w[x], len(part)) + 0.5 * (s * s - q).sum(1)
            g = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y[part]) / len(part)
            met[x] = True
            used = np.flatnonzero(met)
            met[used] = False
            place[used] = np.arange(len(used))
            inverse = place[x]
            g_b, g_w = g.sum(), np.bincount(inverse, g[row], len(used))
            g_v = np.stack([np.bincount(inverse, g[row] * (s[row, f] - vx[:, f]), len(used)) for f in range(factors)], 1)
            gb += g_b**2
            gw[used] += g_w**2
            gv[used] += g_v**2
            b -= RATE * g_b / np.sqrt(gb)
            step = RATE / np.sqrt(gw[used])
            moved = w[used] - step * g_w
            w[used] = np.sign(moved) * np.maximum(0, np.abs(moved) - step * L1)
            step = RATE / np.sqrt(gv[used])
            moved = v[used] - step * g_v
            v[used] = np.sign(moved) * np.maximum(0, np.abs(moved) - step * L1_VECTORS)
    weight, vectors = np.zeros(size, np.float32), np.zeros((size, factors), np.float32)
    weight[names], vectors[names] = w, v
    return Machine(b, weight, vectors)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", rows: int = TRAIN_ROWS) -> Machine:
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y is not null").groupBy("k").agg(F.max("y").alias("y"))
    n = known.count()
    sample = known.where(F.pmod(F.xxhash64(F.lit("sample"), "k"), F.lit(1 << 30)) / (1 << 30) < min(1.0, rows / max(n, 1)))
    joined = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(sample), "k")  # TRAIN_ROWS, about

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stepped(batches, "t"):
            h, starts = term_sets(byte_texts(batch, "t"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([h[a:b].tobytes() for a, b in zip(starts, starts[1:])], pa.binary())], names=["k", "y", "terms"])

    sets = stored(joined.select("k", "y", "t").mapInArrow(terms, T.StructType([known.schema["k"], T.StructField("y", T.IntegerType()), T.StructField("terms", T.BinaryType())])), "toxicity-sample")
    n = sets.count()
    sets = sets.where(F.pmod(F.xxhash64("terms"), F.lit(1 << 30)) / (1 << 30) < min(1.0, MOST_ROWS / max(n, 1)))
    got = sets.orderBy("k", "terms").select("y", "terms").toArrow()  # MOST_ROWS rows, about, 4 bytes a term
    y = (got.column("y").to_numpy() > 0).astype(float)
    found = [np.frombuffer(x.as_buffer(), np.uint32) for x in got.column("terms")]
    starts = np.cumsum([0] + [len(x) for x in found])
    entries = np.concatenate(found) if found else np.empty(0, np.uint32)
    del got, found
    return fit(entries, starts, y)


def score(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """`docs` with score and predicted."""
    schema = extended(docs, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()))
    names_out = schema.names
    shipped = docs.sparkSession.sparkContext.broadcast(machine)  # a table of fixed size, 20 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stepped(batches, text, STEP_BYTES):
            m = shipped.value.margin(*term_sets(byte_texts(batch, text)))
            p = 1 / (1 + np.exp(-np.clip(m, -700, 700)))
            yield attach(batch, names_out, {"score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32))})

    return docs.mapInArrow(run, schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    machine = train(docs, labels.where(remainder(F.col("doc_id"), 5) != 0))
    return score(docs, machine).select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


QUERIES = {"op9_toxicity": op9_toxicity}
SQL: dict[str, str] = {}
