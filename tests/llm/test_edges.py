"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowplan.llm import bpe, decontamination, jaccard_join, language_id, line_dedup, lm_scoring, sharding, token_counts, topk_search, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, n_lines int, kept_text string, ids string, node long"
random.seed(5)
LONG = " ".join("".join(random.choices("abcdefghij", k=5)) for _ in range(60_000))


def row(i, text, lang="en"):
    return (i, text, lang, "s", len(text or ""), "x", "y", 1, "k", "i", 7)


ROWS = [row(1, None), row(2, ""), row(3, "one two three four five six"), row(3, "one two three four five six"), row(None, "one two three four five six"), row(None, None, None), row(4, "!!! 123"), row(5, "le chat est la", "fr"), row(6, LONG), row(7, "\n\n"), row(8, "x" * 50_000), row(9, "ünïcode \U0001f600 <|endoftext|> text")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_language(docs, none):
    model = language_id.train(docs)
    got = language_id.identify(docs, model).collect()
    assert len(got) == len(ROWS)
    for r in got:
        letter = any(ch.isalpha() for ch in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letter) and 0 <= r["score"] <= 1
    assert next(r for r in got if r["doc_id"] == 5)["lang_pred"] == "fr"
    assert language_id.identify(none, model).count() == 0
    assert language_id.identify(docs, language_id.train(none)).where("lang_pred <> 'und'").count() == 0
    assert language_id.keep_known_language(docs, model).columns == docs.columns


def test_language_mixture(spark):
    en, fr = "the cat sat on the mat and then the dog", "le chien est dans la maison avec les enfants"
    train = spark.createDataFrame([(i, en if i % 2 else fr, "en" if i % 2 else "fr") for i in range(40)], "doc_id long, text string, lang string")
    both = spark.createDataFrame([(1, (en + " ") * 20 + (fr + " ") * 20)], "doc_id long, text string")
    r = language_id.identify(both, language_id.train(train)).first()
    assert sorted(r["languages"]) == ["en", "fr"] and min(r["proportions"]) > 0.3


def test_even_mixtures_are_kept(spark):
    """A document evenly in four learned languages is in known languages, though none makes up a third of it."""
    texts = ["the cat sat on the mat and then the dog", "le chien est dans la maison avec les enfants", "der hund schläft unter dem großen küchentisch", "zwykły kot śpi pod wysokim drzewem każdego dnia"]
    train = spark.createDataFrame([(i, texts[i % 4], str(i % 4)) for i in range(40)], "doc_id long, text string, lang string")
    model = language_id.train(train)
    docs = spark.createDataFrame([(1, " ".join((t + " ") * 20 for t in texts)), (2, texts[0]), (3, "123"), (4, None)], "doc_id long, text string")
    assert language_id.identify(docs, model).where("doc_id = 1").first()["score"] < 0.34
    assert sorted(r["doc_id"] for r in language_id.keep_known_language(docs, model).collect()) == [1, 2]


def test_pieces_divide_no_word():
    text = "".join(random.choices("abé 1,", k=3000))
    for limit in (1, 7, 100, 5000):
        parts = list(language_id.cut(text, limit))
        assert "".join(parts) == text and all(not (a[-1].isalpha() and b[0].isalpha()) for a, b in zip(parts, parts[1:]))


def brute_mixture(counts, log_p, penalty):
    """Expectation-maximisation and the choice of languages for one document, in plain Python."""
    k = len(log_p[0])

    def em(share):
        for _ in range(language_id.ITERATIONS):
            new = [0.0] * k
            for g, n in counts.items():
                p = [s * math.exp(log_p[g][j]) for j, s in enumerate(share)]
                for j in range(k):
                    new[j] += n * p[j] / sum(p)
            share = [x / sum(counts.values()) for x in new]
        return share, sum(n * math.log(sum(s * math.exp(log_p[g][j]) for j, s in enumerate(share))) for g, n in counts.items())

    single = [sum(n * log_p[g][j] for g, n in counts.items()) for j in range(k)]
    best, share = max(single), [float(j == single.index(max(single))) for j in range(k)]
    fee = penalty * math.log(1 + sum(counts.values()))
    order = sorted(range(k), key=lambda j: -em([1 / k] * k)[0][j])
    for size in range(2, k + 1):
        got, value = em([1 / size if j in order[:size] else 0.0 for j in range(k)])
        if value - (size - 1) * fee > best:
            best, share = value - (size - 1) * fee, got
    return share


def test_language_proportions_against_brute_force():
    import numpy as np

    rng = np.random.default_rng(8)
    p = rng.dirichlet([0.2] * 60, 4).T + 1e-4
    log_p = np.log(p / p.sum(0)).astype(np.float32)
    for mix in ([1, 0, 0, 0], [0.5, 0.5, 0, 0], [0.3, 0.3, 0.4, 0], [0.25] * 4, [0.9, 0.1, 0, 0]):
        counts = {int(g): int(n) for g, n in zip(*np.unique(rng.choice(60, 400, p=np.exp(log_p.astype(float)) @ mix / (np.exp(log_p.astype(float)) @ mix).sum()), return_counts=True))}
        _, share = language_id.infer(np.zeros(len(counts), np.int64), np.array(list(counts)), np.array(list(counts.values())), log_p)
        want = brute_mixture(counts, log_p.tolist(), language_id.PENALTY)
        assert [x > 0 for x in share[0]] == [x > 0 for x in want]
        assert share[0].tolist() == pytest.approx(want, abs=1e-3)


def test_all_languages_are_learned(spark):
    """Rare labels too, however many there are; too many are an error, never left out."""
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices([chr(0x4E00 + 40 * i + j) for j in range(40)], k=4)) for _ in range(20)) for i in range(70)]
    rows = [(100 * i + j, texts[i], f"l{i:02}") for i in range(70) for j in range(2 if i < 64 else 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert model.languages == [f"l{i:02}" for i in range(70)]
    assert language_id.identify(docs, model).where("lang_pred <> lang").count() == 0
    with pytest.raises(ValueError):
        language_id.train(spark.range(language_id.MOST_LANGUAGES + 1).selectExpr("id as doc_id", "'a text' as text", "string(id) as lang"))


def brute_lines(texts, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    lines = [(t or "").split("\n") for t in texts]
    count = {}
    for ls in lines:
        for k in {key(x) for x in ls}:
            count[k] = count.get(k, 0) + 1
    return ["\n".join(x for x in ls if not key(x) or count[key(x)] < least) for ls in lines]


@pytest.mark.parametrize("room", [0, 1, 10**6])
def test_lines(docs, none, spark, room):
    assert line_dedup.dedup_lines(none, broadcast_keys=room).count() == 0
    texts = ["A\n b \nc", "a\nB\nd", "a \n\nb", "\ta", None, "", "a\na\nb\nz", "É\na", "é\nA"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "a\nb")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df, least=4, broadcast_keys=room).collect()}
    want = brute_lines([*texts, "a\nb"], 4)
    assert [got[i]["kept_text"] for i in [*range(len(texts)), None]] == want
    assert got[6]["n_lines"] == 4 and got[6]["n_dropped"] == 3
    assert line_dedup.dedup_lines(docs, broadcast_keys=room).count() == len(ROWS)


def test_sharding(docs, none):
    got = sharding.pack(docs, shards=3).collect()
    assert len(got) == len(ROWS) and sharding.pack(none, shards=3).count() == 0
    by_text, slots = {}, {}
    for r in got:
        assert r["size"] == len((r["text"] or "").encode()) + 16
        by_text.setdefault(r["text"], set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def plain_best_fit(sizes, capacity):
    """Item by item, looking at all bins; the bin of each item."""
    room, out = [], []
    for s in sizes:
        fit = min(((r, i) for i, r in enumerate(room) if r >= s), default=None)
        if fit is None:
            room.append(max(capacity, s))
            fit = (0, len(room) - 1)
        room[fit[1]] -= s
        out.append(fit[1])
    return out


def spread(runs, sizes):
    """The bin of each item of a falling list, from runs."""
    first = {s: sizes.index(s) for s in set(sizes)}
    out = [None] * len(sizes)
    for r in runs:
        for i in range(r.count):
            out[first[r.size] + r.begin + i] = r.bin + i // r.each
    return out


def test_best_fit_against_scan():
    for n, top in ((1, 100), (7, 100), (60, 30), (300, 100), (300, 8), (200, 150)):
        sizes = sorted((random.randint(1, top) for _ in range(n)), reverse=True)
        histogram = sorted(collections.Counter(sizes).items(), reverse=True)
        want = plain_best_fit(sizes, 100)
        assert spread(sharding.best_fit_decreasing(histogram, 100), sizes) == want
        assert sharding.best_fit_decreasing(histogram, 100, max(want)) is None
        even = spread(sharding.even_bins(histogram, 5), sizes)
        assert None not in even and max(even) < 5
    assert sharding.best_fit_decreasing([], 100) == [] == sharding.even_bins([], 5)
    assert spread(sharding.even_bins([(90, 3), (2, 5)], 3), [90, 90, 90, 2, 2, 2, 2, 2])[:3] == [0, 1, 2]


@pytest.mark.parametrize("few", [0, 100_000])
def test_packing_equals_the_plain_list(spark, few):
    """All groups of the table, packed one by one on the driver, fill the shards with the same groups' sizes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = collections.Counter(r["text"] for r in docs.collect())
    sizes = sorted((n * (len((t or "").encode()) + 16) for t, n in texts.items()), reverse=True)
    for options in ({"shards": 40}, {"shards": None, "capacity": 300_000}):
        got = {}
        for r in sharding.pack(docs, keep=["text"], broadcast_runs=few, **options).collect():
            got.setdefault(r["text"], []).append(r["shard"])
        assert all(len(set(x)) == 1 and len(x) == texts[t] for t, x in got.items()) and len(got) == len(texts)
        packed = collections.Counter((x[0], len(x) * (len((t or "").encode()) + 16)) for t, x in got.items())
        if options["shards"]:
            histogram = sorted(collections.Counter(sizes).items(), reverse=True)
            want = spread(sharding.even_bins(histogram, 40), sizes)
            filled = collections.Counter()
            for (b, s), n in packed.items():
                filled[b] += n * s
            assert max(filled.values()) <= max(max(sizes), 1.01 * sum(sizes) / 40)
        else:
            want = plain_best_fit(sizes, 300_000)
        assert packed == collections.Counter(zip(want, sizes))


def test_sharding_of_equal_rows(spark):
    """Rows equal in all columns, ids null: one group, gapless slots."""
    docs = spark.createDataFrame([(None, "same")] * 50 + [(i, f"t{i}") for i in range(9)], "doc_id long, text string")
    got = sharding.pack(docs, shards=4).collect()
    assert len({r["shard"] for r in got if r["text"] == "same"}) == 1
    for b in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == b) == list(range(sum(r["shard"] == b for r in got)))


def brute_count(text, pieces):
    """Forward over all starts, in 32 bits; sums beyond 100,000 become 0 and are taken off those that stand; ties go to the earliest start."""
    f = np.float32
    text = "▁" + text.replace(" ", "▁")
    known, worst, longest = dict(pieces), f(f(min(s for _, s in pieces)) - f(10)), max(len(p) for p, _ in pieces)
    best = [(f(0), 0)] + [None] * len(text)
    for a in range(len(text)):
        score, n = best[a]
        if abs(score) > 100_000:
            best[a + 1 : a + longest + 1] = [x and (f(x[0] - score), x[1]) for x in best[a + 1 : a + longest + 1]]
            score = f(0)
        for b in range(a + 1, min(len(text), a + longest) + 1):
            part = text[a:b]
            if part in known:
                to = (f(score + f(known[part])), n + 1)
            elif b == a + 1:
                to = (f(score + worst), n + len(part.encode()))
            else:
                continue
            if best[b] is None or to[0] > best[b][0]:
                best[b] = to
    return best[-1][1]


TOKEN_TEXTS = ["the cat  sat", " lead", "   ", "▁x", "a <s> b</s>", "<0x41><unk>", "tab\tx\n\ny", "naïve ☃ 日本語 \U0001f600", "aaaaaaaaaaaaaaaaaaaaaa", "a\n b\n  c"]


def test_token_counts(docs, none, spark):
    import public_tokenizers

    pieces = token_counts.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    some = spark.createDataFrame(list(enumerate(TOKEN_TEXTS)), "doc_id long, text string")
    for rows in (docs.where("doc_id <> 6 or doc_id is null").select("text"), some.select("text")):
        for r in token_counts.count_tokens(rows, pieces).collect():
            assert r["n_tokens"] == (brute_count(r["text"], pieces) if r["text"] else 0), r["text"][:50]
    assert token_counts.count_tokens(none, pieces).count() == 0


def test_token_counts_against_library():
    """The library's plain encoding, with the vocabulary of the unchanged file taken for a unigram one."""
    import public_tokenizers
    import pyarrow.parquet as pq
    import sentencepiece

    pb2 = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    pieces = token_counts.read_pieces(path)
    own, plain = token_counts.Counter(pieces), token_counts.Counter(pieces)
    plain.forgets = False  # keeps words with the whole sum before them
    assert own.forgets and own.divide
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()]
    texts += [" ".join(random.choices("the cat sat on a mat \n 😀 naïve antidisestablishment".split(" "), k=5000))]
    texts += ["".join(random.choices(["the", "and", " ", "  ", "\n", "日本", "▁", "é"], k=200)) for _ in range(300)]
    for text in ["the", "within  two", "   ", "a <s> b", "<0x41>", "<unk>x", "the, and of", "rest and", "a\n\nb", *TOKEN_TEXTS, *texts]:
        assert own(text) == plain(text) == len(library.encode(text)), text[:80]


@pytest.mark.parametrize("low", [-99_000.0, -1e6, -3e8, -1e9])
def test_token_counts_small_vocabularies(low):
    """A mark alone of any score, and the same cache for all texts."""
    pieces = [("▁", low), ("▁t", -2.0), ("he", -6.0), ("▁the", -13.0), ("the", -40.0), ("t", -50.0), ("h", -51.0), ("e", -52.0), ("▁he", -31.0), ("▁▁", low - 3)]
    counter = token_counts.Counter(pieces)
    for _ in range(400):
        text = "".join(random.choices("the é\n", k=random.randint(1, 40)))
        assert counter(text) == brute_count(text, pieces), text


def test_token_counts_quick():
    """Ordinary words take the quick search, for a range of sums before them; it equals the full one for each of these."""
    import public_tokenizers

    rng = random.Random(5)
    pieces = token_counts.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    words = ["".join(rng.choices(["the", "ation", "con", "x", "é", "Q", "9", "$", ".", "日", "ñ", "re", "qz"], k=rng.randint(1, 5))) for _ in range(150)]
    counter = token_counts.Counter(pieces)
    assert counter.brief
    tried = 0
    for word in ["▁" + w for w in words] + ["▁"]:
        for start in (0.0, -31.0, -32.0, -33.0, *(float(-rng.randint(0, 99_999)) for _ in range(8))):
            by = start - token_counts.rounded(start + counter.alone)
            found = counter.quick(word, by)
            if found:
                low, high, *want = found
                assert low <= by <= high
                for other in range(-100, 1):
                    if low <= other - token_counts.rounded(other + counter.alone) <= high:
                        assert counter.viterbi(word, float(other)) == tuple(want), (word, start, other)
                        tried += 1
    assert tried > 1000
    full, viterbi = [], counter.viterbi
    counter.viterbi = lambda *x: full.append(x) or viterbi(*x)
    text = "A plain line of words,\nand one more: there is nothing rare in these (two) lines!"
    assert counter(text) == brute_count(text, pieces) and not full


def test_token_counts_ties():
    """Equal scores, pieces that join words, scores that are no whole numbers, and no pieces at all."""
    for gain in (-1.0, -0.3):
        pieces = [(p, gain * len(p)) for p in ["▁", "a", "b", "ab", "ba", "aba", "▁a", "b▁", "b▁a", "▁▁"]]
        counter = token_counts.Counter(pieces)
        for _ in range(300):
            text = "".join(random.choices("ab é\n", k=random.randint(1, 12)))
            assert counter(text) == brute_count(text, pieces), text
    assert token_counts.Counter([])("aé") == 6  # the mark has three bytes


def test_topk(spark):
    rows = [(i, [float((i * 7 + d * 3) % 11 - 5) / 4 for d in range(6)]) for i in range(40)] + [(100, None), (101, []), (102, [1.0, None]), (103, [float("nan")] * 6), (None, [1.0] * 6), (3, [0.5] * 6), (104, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ask = df.where("vec_id % 5 = 0")
    for block in (1, 1000):
        got = topk_search.search(df, ask, 4, query_block=block).collect()
        good = [(i, [int(256 * x // 1) for x in v]) for i, v in rows if i is not None and v and len(v) == 6 and all(x is not None and x == x for x in v)]
        want = []
        for q, v in [g for g in good if g[0] % 5 == 0]:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:4]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
        assert sorted(tuple(r) for r in got) == sorted(want)
    assert topk_search.search(df.limit(0), ask.limit(0), 4).count() == 0


def test_topk_of_wide_components(spark):
    """Components far beyond 32 bits, and queries of which one vector of several is void."""
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * 2.0 ** rng.choice([0, 10, 21]) for _ in range(4)]) for i in range(30)] + [(0, [None, 1.0, 1.0, 1.0]), (5, [float("inf")] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_search.search(df, df.where("vec_id % 5 = 0"), 3).collect()
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows[:30]]
    want = []
    for q, v in good[::5]:
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:3]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == want
    huge = spark.createDataFrame([(0, [2.0**40] * 2), (1, [2.0**40] * 2)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk_search.search(huge, huge.where("vec_id = 0"), 3).collect()


def test_bpe(docs, none):
    spec = bpe.read_spec()
    exact = bpe.ByteBpe(spec).library
    for leaf in (64, bpe.LEAF):
        for r in bpe.encode_decode(docs, spec, leaf=leaf).collect():
            want = exact.encode(r["text"] or "", add_special_tokens=False).ids
            assert r["ids"] == want and r["decoded"] == exact.decode(want, skip_special_tokens=False)
    assert bpe.encode_decode(none, spec).count() == 0


def test_bpe_trees():
    spec = bpe.read_spec()
    tree = bpe.ByteBpe(spec, leaf=48)
    spans = list(bpe.unsettled_spans("one two \U0001f600 three, four's\u0378 x"))
    assert [("one two \U0001f600 three, four's\u0378 x")[a:b] for a, b in spans] == [" \U0001f600 three", "'s\u0378 x"]
    kinds = ["\U0001f600\u0378 a,'", "a", "abcdefghijklmnopqrstuvwxyz", "0123456789", "#$%'!-=", "  \n", "thein'sre ", "éñßà", "漢字かな", "'s'll"]
    for _ in range(200):
        text = "".join("".join(random.choices(a, k=random.randint(1, 300))) for a in random.choices(kinds, k=3))
        assert tree.encode(text).tolist() == tree.library.encode(text, add_special_tokens=False).ids


def test_lm(docs, none, spark):
    fold = F.when(F.coalesce("doc_id", F.lit(1)) % 4 == 0, 0).when(F.coalesce("doc_id", F.lit(1)) % 4 == 1, 2).otherwise(1)
    got = lm_scoring.score_documents(docs, fold).collect()
    assert len(got) == len(ROWS)
    assert sorted(r["n_tokens"] for r in got) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) + 1 for r in ROWS)
    assert all(r["score"] < 0 and r["base_score"] < 0 for r in got)
    assert lm_scoring.score_documents(none, F.lit(1)).count() == 0
    assert lm_scoring.score_documents(docs, F.lit(0)).count() == len(ROWS)


def brute_lm(texts, folds):
    """Scores with an estimate for every context."""
    import numpy as np

    start, end = "\n", " "
    tokens = [[*t.lower().split(), end] for t in texts]
    count = lambda kept: (collections.Counter(w for t, f in zip(tokens, folds) if f in kept for w in t), collections.Counter(x for t, f in zip(tokens, folds) if f in kept for x in zip([start, *t], t)))

    def bucket(v, one):
        c = one[end] if v == start else one[v]
        return lm_scoring.START if v == start else int(math.log2(c)) if c else lm_scoring.UNSEEN, max(c, 1)

    (one, two), (kept_one, kept_two) = count({1, 2}), count({1})
    floor = 1 / (len(one) + 1)
    step = lambda f: round(lm_scoring.STEP * math.log2(f / floor)) if f > 0 else -32768
    cells = collections.Counter({lm_scoring.UNSEEN << 32: 1})
    for t, f in zip(tokens, folds):
        for v, w in zip([start, *t], t) if f == 2 else ():
            b, c = bucket(v, kept_one)
            cells[b << 32 | step(kept_two[v, w] / c) + 32768 << 16 | step(kept_one[w] / sum(kept_one.values())) + 32768] += 1
    weights = lm_scoring.learn_weights(np.array(list(cells)), np.array(list(cells.values())))
    score = lambda v, w, b, c: math.log10(weights[b] @ [two[v, w] / c, one[w] / sum(one.values()), floor])
    return [sum(score(v, w, *bucket(v, one)) for v, w in zip([start, *t], t)) for t in tokens]


def test_lm_estimates_every_context(spark):
    """Rare contexts are estimated as frequent ones are, whatever words' counts are broadcast."""
    rng = random.Random(3)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7)) % 200}" for _ in range(rng.randint(0, 40))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_lm(texts, [(0, 2, 1, 1)[i % 4] for i in range(len(texts))])
    fold = F.when(F.col("doc_id") % 4 == 0, 0).when(F.col("doc_id") % 4 == 1, 2).otherwise(1)
    train = collections.Counter(w for i, t in enumerate(texts) if i % 4 for w in [*t.split(), " "])
    total, types = sum(train.values()), len(train)
    base = [sum(math.log10((train[w] + 1) / (total + types + 1)) for w in [*t.split(), " "]) for t in texts]
    for frequent, rows in ((0, df), (5, df.repartition(5)), (10**5, df)):  # what comes out of a shuffle is stored first
        got = {r["doc_id"]: r for r in lm_scoring.score_documents(rows, fold, "text", "doc_id", frequent).collect()}
        assert [got[i]["score"] for i in range(len(texts))] == pytest.approx(want, abs=1e-6), frequent
        assert [got[i]["base_score"] for i in range(len(texts))] == pytest.approx(base, abs=1e-6)
        assert [got[i]["n_known"] for i in range(len(texts))] == [sum(train[w] > 0 for w in [*t.split(), " "]) for t in texts]
        assert all(r["n_tokens"] == len(texts[i].split()) + 1 and r["train_tokens"] == total and r["held_out"] == (i % 4 == 0) for i, r in got.items())


def test_jaccard(docs, none):
    got = jaccard_join.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    three = [r for r in got if r["class_id"] == 3]
    assert len(three) == 3 and all(r["n_links"] == 2 for r in three)
    assert jaccard_join.near_duplicates(none).count() == 0
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns and kept.where("text like 'one two%'").count() == 1


def test_one_of_each_with_null_and_repeated_ids(spark):
    """Near copies with different texts whose ids are all null, or all one and the same."""
    texts = [" ".join([*(f"{c}{i}" for i in range(60)), f"end{j}"]) for c in "nrm" for j in range(3)]
    ids = [None] * 3 + [5] * 3 + [None, 9, 9]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    kept = sorted((r["text"][0], r["doc_id"]) for r in jaccard_join.one_of_each(df).collect())
    assert kept == [("m", 9), ("n", None), ("r", 5)]


def test_jaccard_against_brute_force_in_blocks(spark):
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(90):
        w = list(base)
        for _ in range(i % 4):
            w[random.randrange(60)] = f"z{i}"
        texts.append(" ".join(w))
    texts += [" ".join(f"q{i}_{j}" for j in range(30)) for i in range(10)] + [None, "", "w0 w1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    links, classes = brute_jaccard(texts)
    for members in (0, 10**6):
        got = {r["k"]: r for r in jaccard_join.near_duplicates(df, block=16, broadcast_members=members).collect()}
        assert [got[i]["n_links"] for i in range(len(texts))] == links
        assert [got[i]["class_id"] for i in range(len(texts))] == classes


def brute_jaccard(texts):
    """Links of each text to others, and the smallest index it is connected to."""
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    near = [[i != j and bool(s) and 5 * len(s & o) >= 4 * len(s | o) for j, o in enumerate(sets)] for i, s in enumerate(sets)]
    label = list(range(len(texts)))
    while True:
        new = [min([label[i], *(label[j] for j, x in enumerate(row) if x)]) for i, row in enumerate(near)]
        if new == label:
            return [sum(row) for row in near], label
        label = new


def test_jaccard_of_null_and_repeated_ids(spark):
    """Many rows without an id, copies and near copies of one text among them."""
    near = [" ".join([*(f"n{i}" for i in range(60)), f"end{j}"]) for j in range(4)]
    rows = [(None, near[i % 4]) for i in range(40)] + [(7, near[0]), (7, near[0]), (7, "another text of a repeated id here"), (3, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    links, _ = brute_jaccard([t for _, t in rows])
    got = jaccard_join.near_duplicates(df).collect()
    assert sorted((r["k"] is None, r["n_links"], r["class_id"]) for r in got if r["root"] is not None) == sorted((k is None, n, 3 if k == 3 else 7) for (k, _), n in zip(rows, links))


def test_toxicity(docs, none, spark):
    labels = spark.createDataFrame([(3, 1), (5, 0), (None, 1), (6, None), (3, 0)], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels)
    got = toxicity.score(docs, machine).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(none, machine).count() == 0
    toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()


def test_toxicity_learns_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.random((4000, 12)) < 0.5
    y = (x[:, 0] & x[:, 1]).astype(float)
    sets = [np.flatnonzero(r).astype(np.uint32) for r in x]
    m = toxicity.fit(np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets]), y, epochs=40)
    p = m.margin(np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets])) > 0
    assert (p == (y > 0)).mean() > 0.97


def test_toxicity_trains_pairs_of_neutral_terms(spark):
    """Two terms that alone tell nothing: exactly one of them is toxic, both or none is not."""
    rng = random.Random(1)
    words = ["aa", "bb", *(f"{c}{c}" for c in "cdefgh")]
    sets = [[w for w in words if rng.random() < 0.5] for _ in range(4000)]
    toxic = [int(("aa" in s) != ("bb" in s)) for s in sets]
    df = spark.createDataFrame([(i, " ".join(s)) for i, s in enumerate(sets)], "doc_id long, text string")
    machine = toxicity.train(df, spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(df, machine).collect()}
    assert sum(got[i] == y for i, y in enumerate(toxic)) > 0.97 * len(sets)


def test_decontamination(docs, none, spark):
    w = [f"b{i}" for i in range(40)]
    items = spark.createDataFrame([(1, " ".join(w)), (2, "short item here"), (3, None), (4, "!!"), (None, "null id words"), (1, " ".join(w))], "item_id long, text string")
    texts = [" ".join(w[5:18]), "x " + " ".join(w[5:17]), "A Short, ITEM-here y", " ".join([*w, *w]), None, "", "null id words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (0, 10**6):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontamination.find_hits(df, items, keep={"doc_id": F.col("doc_id")}, broadcast_rows=most).collect()}
    assert decontamination.bitmap_bits(10) == 1 << 21 and decontamination.bitmap_bits(10**6) == 1 << 24 and decontamination.bitmap_bits(10**12) == 1 << 27
    assert got == {0: (13, 13, ["1"]), 1: (13, 0, []), 2: (5, 3, ["2"]), 3: (80, 80, ["1"]), 4: (0, 0, []), 5: (0, 0, []), 6: (3, 3, [])}
    assert decontamination.find_hits(docs, items).count() == len(ROWS)
    assert decontamination.find_hits(none, items).count() == 0 and decontamination.find_hits(df, items.limit(0)).where("n_hit > 0").count() == 0
    assert sorted(r[0] for r in decontamination.decontaminated(df, items).collect()) == [1, 4, 5]


def test_decontamination_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, n_words int, found string")
    items = spark.createDataFrame([(1, "c d")], "item_id long, text string")
    assert decontamination.decontaminated(df, items).collect() == df.collect()


def test_winnowing_against_brute_force(spark):
    rng = random.Random(6)
    rows = [([rng.randrange(-(2**62), 2**62) for _ in range(rng.choice([0, 1, 8, 9, 10, 40]))],) for _ in range(40)]
    for w in (1, 2, 3, 8, 9):
        for r in spark.createDataFrame(rows, "h array<long>").select("h", decontamination._winnowed(F.col("h"), w).alias("m")).collect():
            assert sorted(r["m"]) == sorted({min(r["h"][i : i + w]) for i in range(len(r["h"]) - w + 1)})


def test_digest_of_empty_text(spark):
    r = bpe.digests(bpe.encode_decode(spark.createDataFrame([(1, None)], "doc_id long, text string"), bpe.read_spec())).first()
    assert r["ids_sha256"] == r["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
