"""Benchmark decontamination by winnowing, with DataFrame functions only.

Texts become words; every run of K words is hashed, and of every W consecutive hashes the smallest is kept as a fingerprint.
As K + W - 1 is the length of a window, documents and benchmark items that share a window of words share a fingerprint
in it. Fingerprints of documents are first held against a bitmap of those of the benchmark (bounded size, no false
negatives), then joined with them; each hit is extended word by word to both sides, and where it reaches a
whole window its words are hit. Items shorter than a window are windows of their own length; such lengths (twelve at most) are looked up as
they are.

Only words around a hit are carried through the join, never whole texts, and no text is shuffled.

Defined results: null texts have no words; items without words never match. An item id may repeat; it counts once. Items with a null id
mark words as hit but are not counted or listed. Every row is judged for itself, repeated rows and null ids included. An empty benchmark hits nothing.
Very long texts are treated whole. Names of `keep` must differ from n_words, n_hit and items, the columns of the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowplan.llm.common import HOT_KEYS, stored, table

WINDOW = 13
K = 5
#: Bits of the bitmap: LEAST_BITS, or 16 for each fingerprint of the benchmark, up to MOST_BITS (16 MB); powers of two.
LEAST_BITS, MOST_BITS = 1 << 21, 1 << 27
#: Fingerprint rows of the benchmark (some 300 bytes each) up to which they are broadcast.
BROADCAST_ROWS = 100_000
#: All of ASCII that is no digit or letter separates words; A-Z are lower-cased.
SEPARATORS = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS))
    return F.array_remove(F.split(plain, " "), "")


def _upto(last: Column) -> Column:
    """1, 2, ... last; empty if last < 1."""
    return F.when(last < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), last))


def _hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def _runs(wh: Column, n: int) -> Column:
    """The hash of each run of n words, from the words' hashes."""
    return F.transform(_upto(F.size(wh) - (n - 1)), lambda i: F.xxhash64(F.lit(n), *[F.get(wh, i + (k - 1)) for k in range(n)]))


def _winnowed(h: Column, w: int) -> Column:
    """The smallest of every w consecutive hashes: minima of 2, 4, 8, ... by pairs, then of two that overlap."""

    def minima(a: Column, size: int) -> Column:
        step = min(size, w - size)
        if not step:
            return F.array_distinct(a)
        return let(F.transform(_upto(F.size(a) - step), lambda i: F.least(F.get(a, i - 1), F.get(a, i + (step - 1)))), lambda b: minima(b, size + step))

    return minima(h, 1)


def _around(w: Column, h: Column, kept: Column, n: int, reach: int) -> Column:
    """For each run whose hash is in `kept`: its place, hash, words, and the words before (nearest first) and after it."""
    places = F.filter(_upto(F.size(h)), lambda i: F.array_contains(kept, F.get(h, i - 1)))
    return F.transform(
        places,
        lambda i: F.struct(
            i.alias("at"),
            F.get(h, i - 1).alias("h"),
            F.slice(w, i, F.lit(n)).alias("mid"),
            F.reverse(F.slice(w, F.greatest(F.lit(1), i - reach), F.least(F.lit(reach), i - 1))).alias("left"),
            F.slice(w, i + n, F.lit(reach)).alias("right"),
        ),
    )


_NONE = "array<struct<at:int,h:bigint,mid:array<string>,left:array<string>,right:array<string>>>"


def _bit(bits: Column, h: Column, size: int) -> Column:
    at = h.bitwiseAND(F.lit(size - 1).cast("long"))  # `size` is a power of two
    return F.getbit(F.get(bits, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1


def fingerprints(items: DataFrame, text: str, key: str, window: int = WINDOW, k: int = K) -> DataFrame:
    """item, at, h, mid, left, right: the fingerprints of the items, and short items whole."""
    n = F.size("w")
    whole = items.select(F.col(key).cast("string").alias("item"), words(F.col(text)).alias("w"))
    rows = stored(whole.where(n > 0), "benchmark-words")
    long = rows.where(n >= window).select("item", F.explode(let(let(_hashes(F.col("w")), lambda wh: _runs(wh, k)), lambda h: _around(F.col("w"), h, _winnowed(h, window - k + 1), k, window - k))).alias("f"))
    empty = F.array().cast("array<string>")
    short = rows.where(n < window).select("item", F.struct(F.lit(1).alias("at"), F.xxhash64(n, _hashes(F.col("w"))).alias("h"), F.col("w").alias("mid"), empty.alias("left"), empty.alias("right")).alias("f"))
    return long.union(short).select("item", "f.*").distinct()


def bitmap_bits(fingerprints: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (16 * fingerprints).bit_length()))


def bitmap(prints: DataFrame, size: int = LEAST_BITS) -> DataFrame:
    """One row with the bits of all fingerprint hashes, as an array of size / 64 numbers; `size` is a power of two."""
    spark = prints.sparkSession
    at = F.pmod("h", F.lit(size))
    ones = prints.select(F.floor(at / 64).alias("id"), F.expr(f"shiftleft(1L, cast(pmod(pmod(h, {size}), 64) as int))").alias("b")).groupBy("id").agg(F.bit_or("b").alias("b"))
    full = spark.range(0, size // 64, 1, 4).join(ones, "id", "left").select("id", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    return full.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "b"))), lambda x: x["b"]).alias("bits"))


def _joined(near: DataFrame, known: DataFrame, n_known: int, broadcast_rows: int) -> DataFrame:
    """`near` and `known` by h. Of many fingerprints those are broadcast that more than 1 / HOT_KEYS of the hits in documents have."""
    if n_known <= broadcast_rows:
        return near.join(F.broadcast(known), "h")
    counts = stored(near.groupBy("h").agg(F.count("*").alias("n")), "fingerprint-hits", narrow=True)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(counts.where(F.col("n") > total // HOT_KEYS).select("h"))  # fewer than HOT_KEYS
    heavy = known.join(hot, "h", "left_semi")
    heavy = F.broadcast(heavy) if heavy.limit(broadcast_rows + 1).count() <= broadcast_rows else heavy
    return near.join(heavy, "h").unionByName(near.join(hot, "h", "left_anti").join(known.join(hot, "h", "left_anti"), "h"))


def _prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays of words."""
    same = F.zip_with(a, b, lambda x, y: x.isNotNull() & y.isNotNull() & (x == y))
    return let(same, lambda s: F.when(F.array_position(F.transform(s, lambda x: F.coalesce(x, F.lit(False))), False) == 0, F.size(s)).otherwise(F.array_position(F.transform(s, lambda x: F.coalesce(x, F.lit(False))), False).cast("int") - 1))


def find_hits(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id", keep: dict[str, Column] | None = None, window: int = WINDOW, k: int = K, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """For each row of `docs`: the columns of `keep` (by default none), n_words, n_hit and items (ids as sorted strings)."""
    keep = keep or {}
    prints = stored(fingerprints(items, item_text, item_key, window, k), "benchmark-fingerprints")
    lengths = sorted(r[0] for r in prints.where((F.size("mid") != k) | (F.size("left") + F.size("right") < window - k)).select(F.size("mid").alias("n")).distinct().where(F.col("n") < window).collect())
    shorts = [n for n in lengths if n != k] + ([k] if prints.where((F.size("mid") == k) & (F.size("left") == 0) & (F.size("right") == 0)).limit(1).count() else [])
    n_prints = prints.count()
    size = bitmap_bits(n_prints)
    bits = bitmap(prints, size).scalar()

    def candidates(w: Column, wh: Column, b: Column) -> Column:
        def lookups(h: Column) -> Column:
            found = F.filter(_winnowed(h, window - k + 1), lambda v: _bit(b, v, size))
            return let(found, lambda f: F.when(F.size(f) == 0, F.array().cast(_NONE)).otherwise(_around(w, h, f, k, window - k)))

        def short_lookups(n: int) -> Callable[[Column], Column]:
            def places(h: Column) -> Column:
                found = F.array_distinct(F.filter(h, lambda v: _bit(b, v, size)))
                return let(found, lambda f: F.when(F.size(f) == 0, F.array().cast(_NONE)).otherwise(_around(w, h, f, n, 0)))

            return places

        parts = [let(_runs(wh, k), lookups), *[let(_runs(wh, n), short_lookups(n)) for n in shorts]]
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    looked = let(F.col("_bits"), lambda b: let(words(F.col(text)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), let(_hashes(w), lambda wh: candidates(w, wh, b)).alias("found"))))
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(text), bits.alias("_bits")).select(*keep, F.monotonically_increasing_id().alias("_row"), looked.alias("_x"))
    rows = stored(rows, "document-candidates")
    near = rows.select("_row", F.explode("_x.found").alias("d")).select("_row", F.col("d.at").alias("at"), F.col("d.h").alias("h"), F.struct("d.mid", "d.left", "d.right").alias("d"))
    known = prints.select("h", "item", F.struct("mid", "left", "right").alias("i"))
    met = _joined(near, known, n_prints, broadcast_rows).where(F.col("d.mid") == F.col("i.mid"))
    met = met.select("_row", "item", "at", F.size("d.mid").alias("n"), F.size("i.left").alias("il"), F.size("i.right").alias("ir"), _prefix(F.col("d.left"), F.col("i.left")).alias("l"), _prefix(F.col("d.right"), F.col("i.right")).alias("r"))
    whole = (F.col("l") + F.col("r") + F.col("n") >= window) | ((F.col("il") == 0) & (F.col("ir") == 0))
    spans = met.where(whole).select("_row", "item", (F.col("at") - F.col("l")).alias("a"), (F.col("at") + F.col("n") + F.col("r")).alias("b"))
    by_row = spans.groupBy("_row").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("s"), F.sort_array(F.collect_set("item")).alias("items"))

    def cover(acc: Column, x: Column) -> Column:
        begin = F.greatest(acc["end"], x["a"])
        return F.struct((acc["n"] + F.greatest(F.lit(0), x["b"] - begin)).alias("n"), F.greatest(acc["end"], x["b"]).alias("end"))

    hits = by_row.select("_row", "items", F.aggregate("s", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), cover)["n"].cast("long").alias("n_hit"))
    out = rows.join(hits, "_row", "left")
    return out.select(*keep, F.col("_x.n_words").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of `docs` that are not contaminated. Rows are known again by their key and two hashes of the text."""
    mark = {"_k": F.col(key), "_t1": F.xxhash64(F.lit(1), text), "_t2": F.xxhash64(F.lit(2), text)}
    bad = find_hits(docs, items, text, keep=mark).where(is_contaminated()).select(*mark).distinct()
    bad = bad.select(*[F.col(c).alias(f"{c}b") for c in bad.columns])
    marked = docs.withColumns({c: v for c, v in mark.items()})
    same = marked["_k"].eqNullSafe(bad["_kb"]) & (marked["_t1"] == bad["_t1b"]) & (marked["_t2"] == bad["_t2b"])
    return marked.join(bad, same, "left_anti").select(*docs.columns)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep={"doc_id": F.col("doc_id")})
    ids = F.concat_ws(",", "items")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


QUERIES = {"op10_decontamination": op10_decontamination}
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = {
    "op10_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS g
       FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT r, n, s, array_to_string(w[s : s + n - 1], ' ') AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT dw.r, dw.s, dw.n, iw.item FROM dw JOIN iw USING (n, g)),
p AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS pos FROM (SELECT DISTINCT r, s, n FROM h)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)
""",
}
