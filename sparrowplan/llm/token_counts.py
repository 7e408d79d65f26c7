"""Token counts of a unigram tokenizer, by Viterbi without keeping the segmentation.

An Aho-Corasick automaton lists all vocabulary pieces that end at each character; dynamic programming carries the best
score and its number of pieces. A character without a piece of its own costs ten less than the worst score and counts as
its UTF-8 bytes (byte fallback). Spaces become word marks, and one more is put in front of the text.

Ties are those of the model file's library, which come from its arithmetic: sums are kept in 32 bits, and where the sum at
a character is beyond 100,000 it becomes 0 there and is taken off all later sums that stand so far, each rounded anew. Of
equal sums the piece that starts earliest stays. With a score of -10^9 for the mark alone, as in files made from BPE
vocabularies, that rounds the sums of all pieces that begin with a mark to multiples of 64.

Where no piece goes on to a mark after another character, the text falls into words, each with all marks before it, and a
word's count depends on the text before it by the running sum alone. With such a file that sum goes to 0 at the mark, and ordinary words need a
plain search from there (`quick`); others take the full one (`viterbi`). Tasks keep the counts of words and sums they have seen
(a cache of bounded size, which never changes a result). Control, unknown and byte pieces are no text.

Defined results: null and empty texts have 0 tokens; with an empty vocabulary all text is counted as bytes. Input columns stay; `n_tokens` replaces a column of that name.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sparrowplan.llm.common import attach, extended, stepped, table

MARK = "▁"
WORD = re.compile("▁+[^▁]*")
PART = re.compile("▁+[^▁]*|[^▁]+")
CACHE_ENTRIES = 250_000
FARTHEST = 100_000.0  # sums beyond this become 0, and later ones are counted from there
WHOLE = float(1 << 24)  # whole numbers up to here are the same in 32 bits
STEP = 64.0  # between numbers of 32 bits from 2^29 to 2^30
TO_STEP = 1.5 * 2.0**58  # numbers of 64 bits of this size are as far apart: adding it rounds to multiples of 64, to even ones halfway
_single = struct.Struct("f")


def rounded(x: float) -> float:
    """The nearest number of 32 bits."""
    return _single.unpack(_single.pack(x))[0]


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, without those that stand for no text of their own."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    reserved = lambda i: m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not reserved(i)]


class Counter:
    """Counts the tokens of texts under a unigram vocabulary with byte fallback."""

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in dict(pieces).items():
            if piece:
                self.automaton.add_word(piece, (len(piece), rounded(score)))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()
        scores = {p: rounded(s) for p, s in pieces}
        self.unknown = rounded(min(scores.values(), default=0.0) - 10.0)
        self.exact = all(s.is_integer() for s in scores.values())
        self.words = not any(MARK in p.lstrip(MARK) for p in scores)
        far = 2 * FARTHEST + 1  # a single step of this size sets any sum to 0
        self.divide = self.words and self.unknown < -far and not any("\n" in p for p in scores)
        # After a mark alone of such a score, what came before tells only by how it rounds.
        self.alone = scores.get(MARK, self.unknown)
        self.after = {p: s for p, s in scores.items() if len(p) > 1 and p[0] == MARK and p[1] != MARK}
        self.forgets = self.exact and self.alone < -far and all(abs(s) < WHOLE / 2 for s in self.after.values())
        self.longest = max(map(len, self.after), default=0)
        self.brief = self.forgets and self.divide and (1 << 29) + WHOLE < -self.alone < (1 << 30) - WHOLE and all(abs(s) < WHOLE / 2 for p, s in scores.items() if len(p) == 1 and p != MARK)
        self.single = {p for p in scores if len(p) == 1 and p != MARK}
        self.reach: dict[str, int] = {}  # of three characters: the length of the longest piece that begins with them
        for p in self.after:
            self.reach[p[:3]] = max(self.reach.get(p[:3], 0), len(p))
        self.lean = self._lean(scores) if self.brief else None
        self.seen: dict[str, tuple[tuple[float, float, int, float], ...]] = {}  # range of sums before: tokens, sum at the end
        self.entries = 0

    def _lean(self, scores: dict[str, float]) -> ahocorasick.Automaton:
        """The pieces without marks, but for those that have less than the sum of other pieces that make them up: a search without resets never takes them."""
        lean = ahocorasick.Automaton()
        for piece, gain in scores.items():
            if not piece or MARK in piece:
                continue
            best = [0.0]
            for b in range(1, len(piece) + 1):
                best.append(max((best[a] + scores[piece[a:b]] for a in range(b) if piece[a:b] in scores and b - a < len(piece)), default=-math.inf))
            if len(piece) == 1 or gain >= best[-1]:
                lean.add_word(piece, (len(piece), gain))
        if len(lean):
            lean.make_automaton()
        return lean

    def viterbi(self, word: str, start: float = 0.0) -> tuple[int, float]:
        """Tokens of the best segmentation, and the sum at its end, from the sum before."""
        n, exact = len(word), self.exact
        score, count = [start] * (n + 1), [0] * (n + 1)
        shift: dict[int, float] = {}  # what was taken off all sums when a place was reached
        latest = 0  # the last such place
        at = 0  # all places up to here have their scores
        best: float | None = None  # of the pieces that end at at + 1, as of place `since`
        since, single = 0, False

        def moved(x: float, since: int, to: int) -> float:
            """A sum of `since` as it stands when place `to` is reached."""
            for k, amount in shift.items():
                if since < k <= to:
                    x = rounded(x - amount)
            return x

        matches = [] if self.empty else list(self.automaton.iter(word))
        matches.append((n, (0, 0.0)))
        for last, (length, gain) in matches:
            while at < last:
                if not single:  # an unknown character, unless longer pieces are better
                    if best is not None and since < latest:
                        best = moved(best, since, at)
                    total = rounded(score[at] + self.unknown)
                    if best is None or total > best:
                        best = total
                        count[at + 1] = count[at] + len(word[at].encode("utf-8", "surrogatepass"))
                at += 1
                if best > FARTHEST or best < -FARTHEST:
                    shift[at], latest, best = best, at, 0.0
                score[at], best, single = best, None, False
            if not length:
                break
            begin = last + 1 - length
            total = score[begin] + gain
            if not exact or not -WHOLE <= total <= WHOLE:
                total = rounded(total)
            if best is not None and since < latest:
                best = moved(best, since, begin)
            if best is None or total > best:  # longer pieces come first
                best = total
                count[last + 1] = count[begin] + 1
            since, single = begin, length == 1
        return count[n], score[n]

    def quick(self, word: str, by: float) -> tuple[float, float, int, float] | None:
        """A range of amounts around `by`, and tokens and sum for all of them; None if a sum becomes 0 other than at the word's begin.

        `by` is the sum before the word less that after its mark, some 10^9. The mark alone sets the sum to 0, then so does the piece of the mark
        and one character, whose sum is `by` larger. All that ended before it is 10^9 worse from there; what counts are pieces that go on
        from that place, and longer ones with the mark, by how much more they have, in multiples of 64. Where no piece has the mark and more, all goes
        on from the mark; a word without a mark begins at a sum of 0.
        """
        n = len(word)
        begin, low, high, more = 0, -math.inf, math.inf, None
        if word[0] == MARK:
            after = self.after
            begin, gain = 1, after.get(word[:2])
            reach = self.reach.get(word[:3], 0)
            if gain is not None:
                begin = 2
                base = (gain + by + TO_STEP) - TO_STEP
                least = most = gain + by - base
                if reach > 2:
                    more = [-math.inf] * (n + 2)
                    for k in range(3, min(reach, n) + 1):
                        gain = after.get(word[:k])
                        if gain is not None:
                            gain += by
                            near = (gain + TO_STEP) - TO_STEP
                            more[k] = near - base
                            gain -= near
                            if gain < least:
                                least = gain
                            elif gain > most:
                                most = gain
                low, high = by - STEP / 2 - least + 1, by + STEP / 2 - most - 1
                if not low <= by <= high:  # halfway
                    low = high = by
            elif reach:  # other pieces are nearest to the mark
                return None
        if not self.single.issuperset(word[begin:]):
            return None
        first = 1 if begin else 0
        score, count = [0.0] * (begin + 1), [first] * (begin + 1)
        best, tokens = -math.inf if more is None or begin == n else more[begin + 1], 1
        for last, (length, gain) in self.lean.iter(word, begin):
            at = last + 1 - length
            total = score[at] + gain
            if total > best:
                best, tokens = total, count[at] + 1
            if length == 1:  # the last one that ends here
                if not -FARTHEST <= best <= FARTHEST:
                    return None
                score.append(best)
                count.append(tokens)
                best, tokens = -math.inf if more is None else more[last + 2], 1
        return low, high, count[n], score[n]

    def _alike(self, word: str, by: float) -> tuple[float, float]:
        """Amounts around `by` that round to the same sums, added to the pieces that begin the word."""
        low, high = -math.inf, math.inf
        for k in range(2, min(self.longest, len(word)) + 1):
            gain = self.after.get(word[:k])
            if gain is not None:
                near = rounded(gain + by)
                gap = math.ldexp(1.0, math.frexp(near)[1] - 24)  # between numbers of 32 bits
                reach = gap / 2 if math.frexp(near)[0] not in (0.5, -0.5) else gap / 4
                low, high = max(low, near - reach - gain), min(high, near + reach - gain)
        low, high = low + 1, high - 1  # whole numbers, none halfway
        return (low, high) if low <= by <= high else (by, by)

    def _part(self, part: str, start: float) -> tuple[int, float]:
        forgets = self.forgets and part[0] == MARK and part[1:2] != MARK
        by = start - rounded(start + self.alone) if forgets else start
        known = self.seen.get(part, ())
        for low, high, n, end in known:
            if low <= by <= high:
                return n, end
        return self._unseen(part, start, by, forgets, known)

    def _unseen(self, part: str, start: float, by: float, forgets: bool, known: tuple) -> tuple[int, float]:
        if self.entries >= CACHE_ENTRIES:
            self.seen.clear()
            self.entries, known = 0, ()
        found = self.quick(part, by) if self.brief and self.forgets and (forgets or part[0] != MARK) else None  # no mark: the sum before is 0
        if found is None:
            n, end = self.viterbi(part, start)
            found = *(self._alike(part, by) if forgets and known else (by, by)), n, end  # most words are seen once
        self.seen[part] = (*known, found)
        self.entries += 1
        return found[2], found[3]

    def _word(self, word: str, start: float) -> tuple[int, float]:
        if not self.divide or "\n" not in word:
            return self._part(word, start)
        first, *rest = word.split("\n")  # an unknown character of one byte, after which the sum is 0
        n = self._part(first, start)[0] + len(rest)
        end = 0.0
        for part in rest:
            end = 0.0
            if part:
                more, end = self._part(part, 0.0)
                n += more
        return n, end

    def _lines(self, marked: str) -> int:
        """Tokens of a text by lines, each from a sum of 0, as in `_word`.

        The lookup of `_part` stands here once more, without a call. Sums before parts that don't forget them are far from 10^9, and fit no range here.
        """
        seen, alone, to_step = self.seen, self.alone, TO_STEP
        lines = marked.split("\n")
        n = len(lines) - 1
        for line in lines:
            at = 0.0
            for part in PART.findall(line):
                by = at - ((at + alone + to_step) - to_step)
                known = seen.get(part, ())
                for low, high, more, end in known:
                    if low <= by <= high:
                        n += more
                        at = end
                        break
                else:
                    forgets = part[0] == MARK and part[1:2] != MARK
                    more, at = self._unseen(part, at, by, True, known) if forgets else self._part(part, at)
                    n += more
        return n

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        if self.brief and self.forgets:
            return self._lines(marked)
        n, at = 0, 0.0
        for word in WORD.findall(marked) if self.words else [marked]:
            more, at = self._word(word, at)
            n += more
        return n


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]], text: str = "text") -> DataFrame:
    """`docs` with n_tokens."""
    schema = extended(docs, T.StructField("n_tokens", T.LongType()))
    names_out = schema.names
    shipped = docs.sparkSession.sparkContext.broadcast(pieces)  # a vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shipped.value)
        for batch in stepped(batches, text, 4 << 20):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            yield attach(batch, names_out, {"n_tokens": pa.array([counter(t) for t in texts], pa.int64())})

    return docs.mapInArrow(count, schema)


def op4_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    pieces = read_pieces(path or public_tokenizers.path("piece_bpe_32k.model"))
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces).select("doc_id", "n_tokens")


QUERIES = {"op4_token_counts": op4_token_counts}
SQL: dict[str, str] = {}
