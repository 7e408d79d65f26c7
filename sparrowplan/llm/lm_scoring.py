"""Language-model scores by deleted interpolation of word n-grams.

A text is its words (A-Z lower-cased) and one end token. The probability of a token mixes the maximum-likelihood estimates of the bigram
and the unigram and a uniform floor. The mixture weights depend on the frequency bucket of the context; expectation-
maximisation learns them on counts held out of the training documents (the deleted part), the other training documents giving the estimates
meanwhile. Scores use the counts of all training documents.

Three passes over the texts. The first counts words: a table that grows with the corpus and stays distributed. The last sends each
token once, packed in byte blocks with its context and document, to the task that counts its n-gram, and gets back sums
for each document. Every context has its estimate. The counts of the most frequent words, FREQUENT about, are broadcast, and their tokens are
dealt out by word and context, so that no hot word meets in one task. A rarer word's tokens meet in one task, as do those of frequent words
after it, so its count is known there. Only where a rare word follows another that is counted elsewhere is the context's count looked up in the
table of words: the second pass asks for these.

Defined results: a null or empty text is the end token alone. Repeated rows and null ids are documents like others; a null id counts as the empty
string for the folds. Without training documents N and V are 0 and the scores are those of the floor. Only the id and the text are
read, so clashing columns don't matter. Very long texts are treated piece by piece.
Ids are read as whole numbers (text that is none raises an error). A lost task that runs again must see the same rows in the same order, as it does
with files; an input that comes out of a shuffle is stored first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowplan.llm.common import WORDS, byte_texts, document_tokens, fixed, remainder, stepped, stored, table

#: Words whose counts are broadcast, at most (and the end token): a table of 24 bytes each. It bounds no result.
FREQUENT = 1 << 17
CHUNK_TOKENS = 2_000_000
CHUNK_DOCUMENTS = 1 << 15
#: Tokens, about, that one task of the second pass counts.
TASK_TOKENS = 2_500_000
#: Of the training documents, one in so many is held out to learn the weights.
DELETED = 10
BUCKETS = 34  # by the logarithm of the context's count; then contexts never seen, which have no bigram estimate, and the start of a text
UNSEEN, START = 32, 33
#: Rows of looked-up counts that are packed together.
PACK_ROWS = 1 << 19
END = np.uint64(0x9D39247E33776D41)
#: Steps by which the logarithm of likelihood ratios is rounded for learning the weights.
STEP = 8
ITERATIONS = 60
#: Logarithms are summed in whole units of this size, so that sums come out alike in any order.
UNIT = 2.0**-32


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, folds, token hashes (each document closed by END) and the document of each token, for chunks of documents."""
    keys: list = []
    folds: list = []
    tokens: list[np.ndarray] = []
    docs: list[np.ndarray] = []
    size = 0
    for batch in stepped(batches, "t"):
        h, starts = document_tokens(byte_texts(batch, "t"), WORDS)
        n = np.diff(starts) + 1
        out = np.empty(int(n.sum()), np.uint64)
        ends = np.cumsum(n) - 1
        body = np.ones(len(out), bool)
        body[ends] = False
        out[body], out[ends] = h, END
        docs.append(np.repeat(np.arange(len(keys), len(keys) + len(n)), n))
        keys += batch.column(0).to_pylist()
        folds += batch.column(1).to_pylist()
        tokens.append(out)
        size += len(out)
        if size >= CHUNK_TOKENS or len(keys) >= CHUNK_DOCUMENTS:
            yield keys, np.array(folds, np.uint8), np.concatenate(tokens), np.concatenate(docs)
            keys, folds, tokens, docs, size = [], [], [], [], 0
    if keys:
        yield keys, np.array(folds, np.uint8), np.concatenate(tokens), np.concatenate(docs)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, folds, tokens, doc in _chunks(batches):
        fold = folds[doc]
        h, inverse = np.unique(tokens[fold > 0], return_inverse=True)
        c = np.bincount(inverse, minlength=len(h))
        r = np.bincount(inverse, fold[fold > 0] == 1, len(h)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c), pa.array(r)], names=["h", "c", "r"])


def _packed(array: np.ndarray) -> bytes:
    """Compressed, byte plane by byte plane."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array.view(np.uint8).reshape(len(array), -1).T).tobytes())


def _unpacked(raw: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


#: Blocks of tokens; the hashes `u` are those of the rare contexts. A row with chunk LOOKED_UP has context counts (w, v: all, d: kept).
_ROW = "p int, chunk long, n long, head binary, fold binary, w binary, v binary, d binary, u binary"
LOOKED_UP = -1


class _Scorer:
    """What the tasks of the later passes share: the frequent words' table and the corpus totals."""

    def __init__(self, h: np.ndarray, c: np.ndarray, r: np.ndarray, tokens: int, types: int, kept: int, parts: int) -> None:
        self.h, self.c, self.r, self.parts = h, c, r, parts
        self.tokens, self.types, self.kept = tokens, types, kept
        at = int(np.searchsorted(h, END))
        known = at < len(h) and h[at] == END
        # counts by context number: the table, rare contexts (each part numbers its own behind these), starts of texts (as many as ends)
        self.context = np.concatenate([c, [0, c[at] if known else 0]]).astype(np.float64)
        self.context_kept = np.concatenate([r, [0, r[at] if known else 0]]).astype(np.float64)

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The number of each word in the table; len(self.h) for rare ones."""
        if not len(self.h):
            return np.zeros(len(words), np.uint32)  # all rare
        at = np.minimum(np.searchsorted(self.h, words), len(self.h) - 1)
        return np.where(self.h[at] == words, at, len(self.h)).astype(np.uint32)

    def bucket(self, v: np.ndarray, counts: np.ndarray) -> np.ndarray:
        c = counts[v]
        b = np.minimum(31, np.log2(np.maximum(c, 1)).astype(np.int64))
        b[c == 0] = UNSEEN
        b[v == len(self.h) + 1] = START
        return b

    def part(self, spread: np.ndarray) -> np.ndarray:
        spread = spread ^ (spread >> np.uint64(31))
        return (spread * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)) % np.uint64(self.parts)

    def contexts(self, w: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token the number of its word, the context's number, and the context's hash."""
        words, inverse = np.unique(w, return_inverse=True)
        number = self.numbers(words)[inverse]
        v = np.concatenate([[0], number[:-1]]).astype(np.uint32)
        v[np.flatnonzero(np.diff(doc, prepend=-1))] = len(self.h) + 1
        return number, v, np.concatenate([np.zeros(1, np.uint64), w[:-1]])

    def ask(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rare contexts whose counts other parts need: those before rare words that are counted elsewhere."""
        for _, _, w, doc in _chunks(batches):
            number, v, u = self.contexts(w, doc)
            rare = (number == len(self.h)) & (v == len(self.h))
            w, u = w[rare], u[rare]
            p = self.part(w)
            away = p != self.part(u)
            found = np.unique(np.stack([u[away], p[away]], 1), axis=0) if away.any() else np.empty((0, 2), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, 0]).view(np.int64)), pa.array(found[:, 1].astype(np.int32))], names=["h", "p"])

    def deal(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        for i, (keys, folds, w, doc) in enumerate(_chunks(batches)):
            chunk = (context.partitionId() if context else 0) * (1 << 32) + i
            number, v, u = self.contexts(w, doc)
            # frequent words by word and context, or by the context if that is rare; rare words by word
            spread = np.where(number < len(self.h), np.where(v == len(self.h), u, w + v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), w)
            p = self.part(spread)
            del number, spread
            order = np.argsort((p << np.uint64(40)) | (w >> np.uint64(24)))
            p, w, v, u, d = p[order], w[order], v[order], u[order], doc[order].astype(np.uint16)
            cuts = np.searchsorted(p, np.arange(self.parts + 1, dtype=np.uint64))
            fold = _packed(folds)
            sizes = np.bincount(doc, minlength=len(keys))
            head = pa.serialize_pandas(pd.DataFrame({"k": pd.array(keys, "Int64"), "n": sizes, "f": folds})).to_pybytes()
            rows = [(chunk % self.parts, chunk, len(keys), head, None, None, None, None, None)]
            for part in np.flatnonzero(np.diff(cuts)):
                a, b = cuts[part], cuts[part + 1]
                rows.append((int(part), chunk, int(b - a), None, fold, _packed(np.diff(w[a:b], prepend=np.uint64(0))), _packed(v[a:b]), _packed(d[a:b]), _packed(x) if len(x := u[a:b][v[a:b] == len(self.h)]) else None))
                if len(rows) >= 64:
                    yield self._batch(rows)
                    rows = []
            if rows:
                yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _ROW.split(", ")])

    def gather(self, group: pa.Table) -> tuple[list[tuple[int, bytes]], list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of one part: heads, chunks, for each token its place in chunks, document, fold, word and context, and the rare contexts.

        Rare contexts are numbered behind the starts of texts; of each there are the hash and the looked-up counts (all and kept; 0 where
        none was asked for).
        """
        heads, chunks = [], []
        place, doc, fold, w, v, u, found = [], [], [], [], [], [], []
        for row in sorted(group.to_pylist(), key=lambda r: r["chunk"]):
            if row["head"] is not None:
                heads.append((row["chunk"], row["head"]))
                continue
            if row["chunk"] == LOOKED_UP:
                found.append((_unpacked(row["w"], np.uint64), _unpacked(row["v"], np.int64), _unpacked(row["d"], np.int64)))
                continue
            n = row["n"]
            d = _unpacked(row["d"], np.uint16)
            folds = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["fold"]), np.uint8)
            place.append(np.full(n, len(chunks), np.int32))
            chunks.append(row["chunk"])
            doc.append(d)
            fold.append(folds[d])
            w.append(np.cumsum(_unpacked(row["w"], np.uint64), dtype=np.uint64))
            v.append(_unpacked(row["v"], np.uint32))
            if row["u"] is not None:
                u.append(_unpacked(row["u"], np.uint64))
        join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        rare, inverse = np.unique(join(u, np.uint64), return_inverse=True)
        contexts = join(v, np.uint32)
        contexts[contexts == len(self.h)] = len(self.h) + 2 + inverse
        looked = [rare, np.zeros(len(rare)), np.zeros(len(rare))]
        for h, c, r in found:
            at = np.searchsorted(rare, h)
            looked[1][at], looked[2][at] = c, r
        return heads, chunks, join(place, np.int32), join(doc, np.uint16), join(fold, np.uint8), join(w, np.uint64), contexts, looked

    def counts(self, w: np.ndarray, v: np.ndarray, weight: np.ndarray, table: np.ndarray, rare: np.ndarray, looked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of each token's word and of its bigram, where `weight` says which tokens count, and counts by context number."""
        words, inverse = np.unique(w, return_inverse=True)
        number = self.numbers(words)
        own = np.bincount(inverse, weight, len(words))
        if len(self.h):
            frequent = number < len(self.h)
            own[frequent] = table[number[frequent]]
        # a rare context is counted here as a word, or was looked up, never both
        before = looked.copy()
        if len(rare) and len(words):
            at = np.minimum(np.searchsorted(words, rare), len(words) - 1)
            before += np.where(words[at] == rare, own[at], 0)
        pair = (inverse.astype(np.uint64) << np.uint64(32)) | v.astype(np.uint64)
        own = own[inverse]
        del words, inverse, number
        _, pairs = np.unique(pair, return_inverse=True)
        del pair
        both = np.bincount(pairs, weight)[pairs] if len(pairs) else np.empty(0)
        return own, both, np.concatenate([table, before])

    def evidence(self, group: pa.Table) -> pa.Table:
        """Counts of the deleted tokens by bucket and rounded ratios of the bigram and unigram estimates to the floor."""
        _, _, _, _, fold, w, v, (rare, _, looked) = self.gather(group)
        one, two, context = self.counts(w, v, fold == 1, self.context_kept, rare, looked)
        held = fold == 2
        one, two, v = one[held], two[held], v[held]
        floor = 1 / (self.types + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            f2 = np.where(two > 0, two / np.maximum(context[v], 1), 0)
            f1 = one / max(self.kept, 1)
            x = np.where(f2 > 0, np.round(STEP * np.log2(f2 / floor)), -32768).astype(np.int64)
            y = np.where(f1 > 0, np.round(STEP * np.log2(f1 / floor)), -32768).astype(np.int64)
        cell = (self.bucket(v, context) << 32) | ((x + 32768) << 16) | (y + 32768)
        cell, n = np.unique(cell, return_counts=True)
        return pa.table({"cell": pa.array(cell, pa.int64()), "n": pa.array(n, pa.int64())})

    def score(self, group: pa.Table) -> pa.Table:
        weights = np.frombuffer(group.column("weights")[0].as_py(), np.float64).reshape(BUCKETS, 3)
        heads, chunks, place, doc, fold, w, v, (rare, looked, _) = self.gather(group.drop_columns(["weights"]))
        one, two, context = self.counts(w, v, fold > 0, self.context, rare, looked)
        bucket = self.bucket(v, context).astype(np.uint8)
        two /= np.maximum(context[v], 1)
        two *= weights[bucket, 0]
        two += weights[bucket, 1] * one / max(self.tokens, 1)
        two += weights[bucket, 2] / (self.types + 1)
        p, known = two, one > 0
        one += 1
        one /= self.tokens + self.types + 1
        base = np.log10(one, out=one)
        p = np.log10(p, out=p)
        del w, v, fold, bucket
        # only documents that have tokens here are sent back
        at, inverse = np.unique(place.astype(np.int64) * (1 << 16) + doc, return_inverse=True)
        sums = [np.rint(np.bincount(inverse, x, len(at)) / unit).astype(np.uint64) for x, unit in ((p, -UNIT), (base, -UNIT), (known, 1))]
        cuts = np.searchsorted(at, np.arange(len(chunks) + 1, dtype=np.int64) << 16)
        rows = [(c, None, _packed(np.diff((at[a:b] & 0xFFFF).astype(np.uint16), prepend=np.uint16(0))), _packed(np.concatenate([x[a:b] for x in sums]))) for c, a, b in zip(chunks, cuts, cuts[1:])]
        rows += [(c, h, None, None) for c, h in heads]
        columns = zip(*rows) if rows else [[]] * 4
        return pa.table({n: pa.array(x, k) for n, x, k in zip(("chunk", "head", "docs", "sums"), columns, [pa.int64()] + [pa.binary()] * 3)})

    def total(self, group: pa.Table) -> pa.Table:
        """The documents of one chunk."""
        rows = group.to_pylist()
        head = pa.deserialize_pandas(next(r["head"] for r in rows if r["head"] is not None))
        total = np.zeros((3, len(head)), np.uint64)
        for r in rows:
            if r["docs"] is not None:
                at = np.cumsum(_unpacked(r["docs"], np.uint16), dtype=np.uint16)
                total[:, at] += _unpacked(r["sums"], np.uint64).reshape(3, -1)
        out = dict(zip(("score", "base", "known"), total))
        n = len(head)
        return pa.table({"key": pa.array(head["k"], pa.int64()), "held_out": pa.array((head["f"] == 0).to_numpy(bool)), "n_tokens": pa.array(head["n"].to_numpy(np.int64)), "n_known": pa.array(out["known"].astype(np.int64)), "train_tokens": pa.array(np.full(n, self.tokens, np.int64)), "base_score": pa.array(out["base"] * -UNIT), "score": pa.array(out["score"] * -UNIT)})


def _pack_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Looked-up counts (h, p, c, r) as rows of blocks, one for each part of so many rows."""
    held: list[pa.RecordBatch] = []

    def packed() -> pa.RecordBatch:
        h, p, c, r = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(4))
        order = np.argsort(p, kind="stable")
        h, p, c, r = h[order], p[order], c[order], r[order]
        cuts = [*np.flatnonzero(np.diff(p, prepend=-1)), len(p)]
        return _Scorer._batch([(int(p[a]), LOOKED_UP, int(b - a), None, None, _packed(h[a:b]), _packed(c[a:b]), _packed(r[a:b]), None) for a, b in zip(cuts, cuts[1:])])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= PACK_ROWS:
            yield packed()
            held = []
    if held:
        yield packed()


def learn_weights(cells: np.ndarray, n: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Mixture weights of bigram, unigram and floor for each bucket, by expectation-maximisation on held-out counts."""
    bucket, x, y = cells >> 32, ((cells >> 16) & 0xFFFF) - 32768, (cells & 0xFFFF) - 32768
    ratio = np.stack([np.where(x > -32768, np.exp2(np.maximum(x, -2000) / STEP), 0), np.where(y > -32768, np.exp2(np.maximum(y, -2000) / STEP), 0), np.ones(len(cells))], 1)
    weights = np.tile([0.4, 0.4, 0.2], (BUCKETS, 1))
    weights[UNSEEN] = [0, 0.8, 0.2]
    for _ in range(iterations):
        part = ratio * weights[bucket]
        part *= (n / part.sum(1))[:, None]
        # a count of one spread over what the bucket may use keeps every weight above 0
        new = np.stack([np.bincount(bucket, part[:, k], BUCKETS) for k in range(3)], 1) + (weights > 0) / 3
        weights = new / new.sum(1, keepdims=True)
    return weights


def score_documents(docs: DataFrame, fold: Column, text: str = "text", key: str = "doc_id", frequent: int = FREQUENT) -> DataFrame:
    """Scores of all rows. `fold`: 0 for held-out rows, 1 for training rows, 2 for training rows that also teach the weights."""
    spark = docs.sparkSession
    rows = fixed(docs.select(F.col(key).cast("long").alias("k"), fold.cast("byte").alias("f"), F.col(text).alias("t")), "lm-texts")
    words = stored(rows.where("f > 0").mapInArrow(_count_words, "h long, c long, r long").groupBy("h").agg(F.sum("c").alias("c"), F.sum("r").alias("r")), "lm-words")
    tokens, kept, types = (int(x or 0) for x in words.agg(F.sum("c"), F.sum("r"), F.count("*")).first())
    level = F.floor(F.log2("c") * 16)  # words by rounded frequency: a few hundred levels
    room, least = frequent, None
    for r in words.groupBy(level.alias("l")).count().orderBy(F.desc("l")).collect():
        if r["count"] > room:
            break
        room, least = room - r["count"], r["l"]
    hot = F.col("h") == int(END.view(np.int64))
    hot = hot if least is None else hot | (level >= least)
    top = words.where(hot).toPandas()
    h = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens // TASK_TOKENS)
    scorer = _Scorer(h[order], top["c"].to_numpy(np.int64)[order], top["r"].to_numpy(np.int64)[order], tokens, types, kept, parts)
    shipped = spark.sparkContext.broadcast(scorer)  # FREQUENT words and the end token at most

    asked = rows.mapInArrow(lambda batches: shipped.value.ask(batches), "h long, p int").repartition("h").distinct()
    found = asked.join(words.where(~hot), "h").select("h", "p", "c", "r").mapInArrow(_pack_counts, _ROW)
    dealt = rows.mapInArrow(lambda batches: shipped.value.deal(batches), _ROW).union(found).repartitionById(parts, F.col("p"))  # a part is a partition; hashing it again would put several in one task
    cells = dealt.groupBy("p").applyInArrow(lambda t: shipped.value.evidence(t), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))

    def learn(t: pa.Table) -> pa.Table:
        return pa.table({"weights": pa.array([learn_weights(t.column("cell").to_numpy(), t.column("n").to_numpy()).tobytes()], pa.binary())})

    # the cells are bounded by buckets and rounding; a dummy cell stands for a corpus without any
    none = spark.range(1).select(F.lit(UNSEEN << 32).cast("long").alias("cell"), F.lit(1).cast("long").alias("n"))
    weights = cells.union(none).withColumn("one", F.lit(1)).groupBy("one").applyInArrow(learn, "weights binary")
    # both uses of `dealt` share one shuffle
    scored = dealt.select("*", weights.scalar().alias("weights")).groupBy("p").applyInArrow(lambda t: shipped.value.score(t), "chunk long, head binary, docs binary, sums binary")
    return scored.groupBy("chunk").applyInArrow(lambda t: shipped.value.total(t), "key long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("key", key)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    fold = F.when(remainder(key, 7) == 2, 0).when(F.pmod(F.xxhash64(F.lit("deleted"), key), F.lit(DELETED)) == 0, 2).otherwise(1)
    return score_documents(table(spark, sf_dir, "documents"), fold)


QUERIES = {"op7_lm_scoring": op7_lm_scoring}
SQL: dict[str, str] = {}
