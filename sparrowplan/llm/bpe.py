"""Byte-level BPE encoding and decoding of whole texts.

Long texts are encoded as a tree: a text is halved down to leaves, the leaves are encoded in parallel, and the halves are
joined upward. Where a half ends at a place at which the pre-tokenizer always begins a new piece, the sides are
simply joined. Where the cut lies inside a piece (a long run without a split), windows of tokens around the join are encoded
again and grown until the outermost tokens on both sides agree with what the halves had; a token sequence whose
neighbouring pairs are all valid is the encoding of the whole, so the join is exact.

The result equals that of the tokenizers library on the same file. The fast path encodes with the same vocabulary as
ranks; only spans around characters whose class may differ between Unicode versions, cut out at places where the
pre-tokenizer always begins a piece, go to the tokenizers library itself. Special tokens of the file are found in the text as the library finds them.

Defined results: null and empty texts have no tokens and decode to the empty text. Input columns stay; `ids` and `decoded`
replace input columns of these names.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from sparrowplan.llm.common import attach, extended, stepped, table

#: Characters of a leaf of the tree.
LEAF = 1 << 14
#: Threads that encode the leaves of one text.
THREADS = 2
#: Fixed value: the pre-tokenizer's pattern of this family of tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The byte each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _kind(ch: str) -> str:
    """L, N, S (white space) or O, as the pattern sees a character."""
    if ch in "\t\n\x0b\x0c\r\x85" or unicodedata.category(ch)[0] == "Z":
        return "S"
    c = unicodedata.category(ch)[0]
    return c if c in "LN" else "O"


@cache
def _unsettled() -> re.Pattern:
    """Matches a character whose class isn't the same in Unicode 3.2 and now, or that lies beyond the first plane."""
    ranges, begin = [], None
    for c in range(0x10001):
        old = unicodedata.ucd_3_2_0.category(chr(c)) if c < 0x10000 else "Cn"
        new = unicodedata.category(chr(c))
        settled = c < 0x10000 and old[0] == new[0] and old not in ("Cn", "Cs") and c not in (0x180E, 0x200B, 0xFEFF) and not 0x1C <= c <= 0x1F
        if settled and begin is None:
            begin = c
        if not settled and begin is not None:
            ranges.append(f"\\u{begin:04x}-\\u{c - 1:04x}")
            begin = None
    return re.compile(f"[^{''.join(ranges)}]")


@cache
def _settled_kind(ch: str) -> str:
    """The kind of a character, or nothing where it may differ between Unicode versions."""
    return "" if _unsettled().match(ch) else _kind(ch)


def _begins(text: str, i: int) -> bool:
    """Whether the pre-tokenizer begins a piece at this place, whatever the characters further off."""
    before, after = _settled_kind(text[i - 1]), _settled_kind(text[i])
    return before != "S" and before != after and before != "" != after and text[i - 1] != "'"


def unsettled_spans(text: str) -> Iterator[tuple[int, int]]:
    """Spans that hold all characters of unsettled kind; each begins and ends where a piece begins."""
    a = b = 0
    for m in _unsettled().finditer(text):
        if m.start() < b:
            continue
        low, high = m.start(), m.end()
        while low > b and not _begins(text, low):
            low -= 1
        while high < len(text) and not _begins(text, high):
            high += 1
        if low == b and b > a:  # goes on from the last span
            b = high
            continue
        if b > a:
            yield a, b
        a, b = low, high
    if b > a:
        yield a, b


class ByteBpe:
    """Encodes and decodes as the tokenizers library does with the given tokenizer file."""

    def __init__(self, spec: str, leaf: int = LEAF, threads: int = THREADS) -> None:
        self.leaf, self.threads = leaf, threads
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        model = json.loads(spec)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in self.special}
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["model"]["merges"]]
        in_order = [ranks[bytes(letters[c] for c in m.replace(" ", ""))] for m in merges]
        pre = model["pre_tokenizer"]
        plain = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in model["added_tokens"])
        if in_order != sorted(in_order) or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model["normalizer"] or not plain:
            raise ValueError("not a plain byte-level BPE file")
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.split = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        names = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in self.special.items()}
        self.lengths = np.array([len(names.get(i, b"")) for i in range(max(names) + 1)], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.flat = np.frombuffer(b"".join(names.get(i, b"") for i in range(max(names) + 1)), np.uint8)

    def encode(self, text: str) -> np.ndarray:
        if self.split is None or not self.split.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.special[m[0]]], np.uint32)]
            at = m.end()
        return np.concatenate([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> np.ndarray:
        """The tokens of a text without special ones."""
        out, at = [], 0
        for a, b in unsettled_spans(text):
            out += [self._section(text[at:a]), np.array(self.library.encode(text[a:b], add_special_tokens=False).ids, np.uint32)]
            at = b
        rest = self._section(text[at:])
        return np.concatenate([*out, rest]) if out else rest

    def decode(self, ids: np.ndarray) -> str:
        """The bytes of all tokens, special ones included; what isn't UTF-8 becomes the replacement character."""
        n = self.lengths[ids]
        at = np.repeat(self.starts[ids] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return self.flat[at].tobytes().decode("utf-8", "replace")

    def _section(self, text: str) -> np.ndarray:
        if len(text) <= self.leaf:
            return self.fast.encode_to_numpy(text, disallowed_special=()) if text else np.empty(0, np.uint32)
        return np.array(self.tree(text), np.uint32)

    def tree(self, text: str) -> list[int]:
        """Halve, encode the leaves in parallel, join upward."""
        cuts: dict[tuple[int, int], tuple[int, bool] | None] = {}
        leaves: list[tuple[int, int]] = []
        todo = [(0, len(text))]
        while todo:
            a, b = todo.pop()
            cut = self.cut(text, a, b) if b - a > self.leaf else None
            cuts[a, b] = cut
            if cut is None:
                leaves.append((a, b))
            else:
                todo += [(a, cut[0]), (cut[0], b)]
        encoded = dict(zip(leaves, self.fast.encode_ordinary_batch([text[a:b] for a, b in leaves], num_threads=self.threads)))

        def joined(a: int, b: int) -> list[int]:
            cut = cuts[a, b]
            if cut is None:
                return encoded.pop((a, b))
            left, right = joined(a, cut[0]), joined(cut[0], b)
            return left + right if cut[1] else self.join(text, a, cut[0], b, left, right)

        return joined(0, len(text))

    @staticmethod
    def cut(text: str, a: int, b: int) -> tuple[int, bool] | None:
        """A place near the middle, and whether the pre-tokenizer always begins a piece there; None if there is no fit place.

        A piece always begins where white space follows something else, and where the class changes between letters, digits
        and others, except after an apostrophe. Inside a run, four characters on both sides must be of its class.
        """
        middle = (a + b) // 2
        for reach in (64, 1024, (b - a) // 2 - 8):
            low, high = max(a + 8, middle - reach), min(b - 8, middle + reach)
            if high <= low:
                return None
            kinds = "".join(map(_kind, text[low - 4 : high + 4]))
            best = None
            for i in range(low, high):
                before, after = kinds[i - low + 3], kinds[i - low + 4]
                if before != "S" and after != before and text[i - 1] != "'":
                    if best is None or abs(i - middle) < abs(best - middle):
                        best = i
            if best is not None:
                return best, True
            for i in sorted(range(low, high), key=lambda i: abs(i - middle)):
                if len(set(kinds[i - low : i - low + 8])) == 1:
                    return i, False
        return None

    def join(self, text: str, a: int, at: int, b: int, left: list[int], right: list[int]) -> list[int]:
        """Join two encodings whose cut lies inside a piece."""
        kind = _kind(text[at])
        low, high = at, at
        width = 256
        # as much of the run as windows may need; grows with the window
        length = self.lengths
        k = 4
        while True:
            k_left, k_right = min(k, len(left)), min(k, len(right))
            window_left, window_right = left[len(left) - k_left :], right[:k_right]
            n_left, n_right = int(length[window_left].sum()), int(length[window_right].sum())
            width = max(n_left, n_right) + 8
            while low > max(a, at - width) and _kind(text[low - 1]) == kind:
                low -= 1
            while high < min(b, at + width) and _kind(text[high]) == kind:
                high += 1
            # three characters at the start can belong to a contraction, two at the end to the next piece
            if n_left > len(text[low + 3 : at].encode()) or n_right > len(text[at : max(at, high - 2)].encode()):
                return self.fast.encode_ordinary(text[a:b])
            raw = self._bytes(window_left + window_right)
            again = self.fast._encode_single_piece(raw)
            if len(again) >= 4 and again[:2] == window_left[:2] and again[-2:] == window_right[-2:] and k_left >= 2 and k_right >= 2:
                return left[: len(left) - k_left] + again + right[k_right:]
            k *= 2

    def _bytes(self, ids: list[int]) -> bytes:
        return b"".join(self.flat[self.starts[i] : self.starts[i] + self.lengths[i]].tobytes() for i in ids)


def encode_decode(docs: DataFrame, spec: str, text: str = "text", leaf: int = LEAF) -> DataFrame:
    """`docs` with ids (the tokens of the text) and decoded (the text they stand for). `spec`: content of a tokenizer file."""
    schema = extended(docs, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType()))
    names_out = schema.names
    shipped = docs.sparkSession.sparkContext.broadcast(spec)  # a tokenizer file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(shipped.value, leaf)
        for batch in stepped(batches, text, 2 << 20):
            ids = [bpe.encode(t or "") for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            offsets = pa.array(np.cumsum([0] + [len(x) for x in ids]), pa.int32())
            flat = pa.array(np.concatenate(ids).astype(np.int32), pa.int32())
            yield attach(batch, names_out, {"ids": pa.ListArray.from_arrays(offsets, flat), "decoded": pa.array([bpe.decode(x) for x in ids], pa.string())})

    return docs.mapInArrow(run, schema)


def read_spec(path: str | None = None) -> str:
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what encode_decode returns."""
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return digests(encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), read_spec(path)))


QUERIES = {"op6_bpe": op6_bpe}
SQL: dict[str, str] = {}
