"""Language identification as mixture inference.

A document is taken as a bag of character trigrams, each drawn from one of the languages it is written in.
Expectation-maximisation estimates the proportions of the languages; the set of languages is the one with the
highest log-likelihood less a penalty for each language beyond the first. Trigram likelihoods come from a
bounded, deterministic sample of labelled documents.

Defined results: null texts and texts without a letter are `und` with score 0 and no languages. Rows without a
label teach nothing. With no labelled text at all every document is `und`. Ties go to the language that sorts first.
Repeated rows are judged alike, as a prediction depends on the text alone. Input columns stay; `lang_pred`, `score`,
`languages` and `proportions` replace input columns of these names. Very long texts are counted piece by piece, no word
being divided. A label column of any type is read as text; more than MOST_LANGUAGES different labels are an error, none is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowplan.llm.common import attach, extended, mixed, remainder, stepped, table

#: Trigrams are hashed into so many buckets: 256 KB of model a language.
BUCKET_BITS = 16
#: All labels are learned. More of them than this (128 MB of model) aren't languages, or need another model: an error, as none may be left out.
MOST_LANGUAGES = 512
#: Documents sampled for each language, about.
TRAIN_DOCUMENTS = 4000
#: Penalty for a further language, in units of the logarithm of the number of trigrams.
PENALTY = 4.0
ITERATIONS = 12
PIECE = 1 << 20


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    log_p: np.ndarray  # buckets x languages


@cache
def _folds() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def cut(text: str, limit: int = PIECE) -> Iterator[str]:
    """Pieces of a text, of about `limit` characters, that end before a character that is no letter: no word is divided."""
    a = 0
    while a < len(text):
        b = min(a + limit, len(text))
        while b < len(text) and text[b].isalpha():
            b += 1
        yield text[a:b]
        a = b


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document index, bucket and count of the trigrams of padded words; sorted by document, then bucket."""
    keys, counts = [], []
    whole, docs = [], []
    size = 0

    def flush() -> None:
        nonlocal whole, docs, size
        if not whole:
            return
        points = np.concatenate([np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in whole])
        doc = np.repeat(np.array(docs, np.int64), [len(x) for x in whole])
        g = _folds()[points]
        keep = (g != 0) | (np.concatenate([[1], g[:-1]]) != 0)
        g, doc = np.concatenate([[0], g[keep], [0]]).astype(np.uint64), np.concatenate([[0], doc[keep], [0]])
        middle = np.flatnonzero(g[1:-1]) + 1
        h = mixed(g[middle - 1] * np.uint64(0x9E3779B97F4A7C15) + g[middle] * np.uint64(0xC2B2AE3D27D4EB4F) + g[middle + 1] * np.uint64(0x165667B19E3779F9))
        key, n = np.unique((doc[middle] << BUCKET_BITS) | (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), return_counts=True)
        keys.append(key)
        counts.append(n)
        whole, docs, size = [], [], 0

    for i, text in enumerate(texts):
        for piece in cut(text or ""):
            whole.append(piece + " ")
            docs.append(i)
            size += len(piece)
            if size >= PIECE:
                flush()
    flush()
    if not keys:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    if len(keys) == 1:
        key, n = keys[0], counts[0]
    else:
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)
    return key >> BUCKET_BITS, key & ((1 << BUCKET_BITS) - 1), n


def train(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", documents: int = TRAIN_DOCUMENTS) -> LanguageModel:
    """Trigram log-probabilities from about `documents` rows of each language, chosen by a hash of the key."""
    known = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).cast("string").alias("l")).where("l is not null and t is not null")
    sizes = {r["l"]: r["n"] for r in known.groupBy("l").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} different labels in {label}")
    names = sorted(sizes)
    codes = {name: i for i, name in enumerate(names)}
    if not names:
        return LanguageModel([], np.zeros((1 << BUCKET_BITS, 0), np.float32))
    share = F.create_map(*[x for name in names for x in (F.lit(name), F.lit(min(1.0, documents / sizes[name])))])
    sample = known.where((F.pmod(F.xxhash64(F.lit("sample"), "k"), F.lit(1 << 30)) / (1 << 30)) < share[F.col("l")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stepped(batches, "t", 4 * PIECE):
            doc, bucket, n = trigrams(batch.column(0).to_pylist())
            code = np.array([codes[x] for x in batch.column(1).to_pylist()], np.int64)
            cell, inverse = np.unique((code[doc] << BUCKET_BITS) | bucket, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.bincount(inverse, n).astype(np.int64) if len(cell) else cell)], names=["cell", "n"])

    # at most MOST_LANGUAGES x 2^BUCKET_BITS rows
    rows = sample.select("t", "l").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    cell, n = rows["cell"].to_numpy(np.int64), rows["n"].to_numpy()
    smooth = 0.2
    log_p = np.empty((1 << BUCKET_BITS, len(names)), np.float32)
    for i in range(len(names)):
        own = cell >> BUCKET_BITS == i
        counts = np.bincount(cell[own] & ((1 << BUCKET_BITS) - 1), n[own], 1 << BUCKET_BITS)
        log_p[:, i] = np.log((counts + smooth) / (counts.sum() + smooth * len(counts)))
    return LanguageModel(names, log_p)


def _expectation(r: np.ndarray, c: np.ndarray, starts: np.ndarray, of: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each document after ITERATIONS steps from `share`, and the log-likelihood above the base of r."""
    total = np.add.reduceat(c, starts)[:, None]
    for _ in range(ITERATIONS):
        w = r * share[of]
        w *= (c / w.sum(1))[:, None]
        share = np.add.reduceat(w, starts, axis=0) / total
    return share, np.add.reduceat(c * np.log((r * share[of]).sum(1)), starts)


def infer(doc: np.ndarray, bucket: np.ndarray, n: np.ndarray, log_p: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """The documents that have trigrams, and the proportions of the languages of each."""
    if not len(doc) or not log_p.shape[1]:
        return np.empty(0, np.int64), np.empty((0, log_p.shape[1]))
    ids, starts, of = np.unique(doc, return_index=True, return_inverse=True)
    lp = log_p[bucket]
    lp = lp - lp.max(1, keepdims=True)
    c = n.astype(np.float32)
    single = np.add.reduceat(c[:, None].astype(np.float64) * lp, starts, axis=0)
    best = single.argmax(1)
    score = single[np.arange(len(ids)), best]
    share = np.zeros_like(single)
    share[np.arange(len(ids)), best] = 1
    k_max = log_p.shape[1]
    if k_max == 1:
        return ids, share
    r = np.exp(lp)
    fee = penalty * np.log(1 + np.add.reduceat(n, starts))
    full, top = _expectation(r, c, starts, of, np.full(single.shape, 1 / k_max, np.float32))
    # no set does better than all languages together, so only these documents can have two languages or more
    may = np.flatnonzero(top - fee > score)
    order = np.argsort(-full, axis=1, kind="stable")
    for k in range(2, k_max + 1):
        if not len(may):
            break
        rows = np.isin(of, may)
        sub_of = np.searchsorted(may, of[rows])
        sub_starts = np.flatnonzero(np.diff(sub_of, prepend=-1))
        mask = np.zeros((len(may), k_max), np.float32)
        np.put_along_axis(mask, order[may, :k], 1 / k, axis=1)
        got, ll = _expectation(r[rows], c[rows], sub_starts, sub_of, mask)
        won = ll - (k - 1) * fee[may] > score[may]
        share[may[won]], score[may[won]] = got[won], (ll - (k - 1) * fee[may])[won]
        may = may[top[may] - k * fee[may] > score[may]]
    return ids, share


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """`docs` with lang_pred, score (the share of lang_pred), and the languages found with their proportions."""
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.ArrayType(T.StringType())), T.StructField("proportions", T.ArrayType(T.DoubleType()))]
    schema = extended(docs, *new)
    names_out = schema.names
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded: MOST_LANGUAGES x 2^BUCKET_BITS

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, log_p = shipped.value.languages, shipped.value.log_p
        # a step's arrays have a column for each language
        for batch in stepped(batches, text, 2 * PIECE * 4 // max(4, len(names))):
            ids, share = infer(*trigrams(batch.column(batch.schema.get_field_index(text)).to_pylist()), log_p)
            pred, score = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            langs: list[list[str]] = [[] for _ in pred]
            parts: list[list[float]] = [[] for _ in pred]
            if len(ids):
                best = share.argmax(1)
                for i, b, row in zip(ids.tolist(), best.tolist(), share.tolist()):
                    pred[i], score[i] = names[b], min(1.0, max(0.0, row[b]))
                    found = sorted((j for j, x in enumerate(row) if x > 0), key=lambda j: -row[j])
                    langs[i], parts[i] = [names[j] for j in found], [row[j] for j in found]
            yield attach(batch, names_out, {"lang_pred": pa.array(pred), "score": pa.array(score), "languages": pa.array(langs, pa.list_(pa.string())), "proportions": pa.array(parts, pa.list_(pa.float64()))})

    return docs.mapInArrow(predict, schema)


def trained_on_folds(docs: DataFrame) -> LanguageModel:
    return train(docs.where(remainder(F.col("doc_id"), 5) != 0))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = trained_on_folds(docs)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", F.size("languages").alias("n_languages"))


def keep_known_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The documents in learned languages, however many of them share a document; only `und` is rejected."""
    return identify(docs, model).where(F.col("lang_pred") != "und").select(*docs.columns)


QUERIES = {"op1_language_id": op1_language_id}
SQL: dict[str, str] = {}
