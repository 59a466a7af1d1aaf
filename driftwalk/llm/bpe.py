"""Byte pair encoding with forced boundaries.

A pair of neighbouring bytes that no vocabulary token holds can never end up inside
one token, so every such pair is a certain cut. Words are cut there, the fragments
are merged independently and their ids are put together; fragments repeat far more
than words do. The work is done per Arrow batch, without a shuffle.

Expected is a tokenizer file as the tokenizers library writes it: NFC, white space
collapsed and lower case, words by a pattern, bytes as letters, merges with a mark
at the end of a word, and added tokens that are found in the raw text.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, functions as F
from tokenizers import Tokenizer

from driftwalk.llm.base import column, read, register, sha256, slices, text_or_empty

# Strings of a kind kept with their ids per Python worker, and the longest worth it.
KEPT_WORDS, KEPT_LENGTH = 300_000, 64

# Letters, marks and signs that NFC leaves alone and whose classes are the same in
# every engine, after lowering. Texts of these alone are split here; others are
# normalised and split by the tokenizer's own steps.
_LETTERS = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f"
_PLAIN = r"\x00-\x1b\x20-\x7f\xa0-\u012f\u0131-\u017f\u2010-\u2027\u20ac"
_NUMBERS = r"0-9\xb2\xb3\xb9\xbc-\xbe"


def _byte_letters() -> list[str]:
    """The letter standing for each byte: itself if printable, else from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = re.compile(f"[{_PLAIN}]*")
PLAIN_WORDS = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\t-\r \xa0\x85{_LETTERS}{_NUMBERS}]+"
)


class BytePairs:
    """Encoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(model["merges"])}
        added = {token["content"]: token["id"] for token in spec["added_tokens"]}
        self.added = {content: i.to_bytes(4, "little") for content, i in added.items()}
        by_length = sorted(map(re.escape, added), key=len, reverse=True)
        self.added_at = re.compile("|".join(by_length)) if added else None
        splits = next(
            step["pattern"]["Regex"]
            for step in spec["pre_tokenizer"]["pretokenizers"]
            if step["type"] == "Split"
        )
        if splits != PATTERN:
            raise ValueError(f"words are split by {PATTERN!r} here, not by {splits!r}")
        self.path = path
        self.letters = _byte_letters()
        self.codes = dict(enumerate(self.letters))
        self.packed = {token: i.to_bytes(4, "little") for token, i in self.vocab.items()}
        self.joined = self._pairs_inside_tokens()
        self.words = _Filled(self._word_ids)
        self.inner = _Filled(lambda part: self._merge(list(part)))
        self.last = _Filled(lambda part: self._merge([*part[:-1], part[-1] + self.end]))

    @functools.cached_property
    def library(self) -> Tokenizer:
        """The tokenizer's own normaliser and splitter, loaded where a text needs them."""
        return Tokenizer.from_file(self.path)

    def _pairs_inside_tokens(self) -> set[str]:
        """Neighbouring letters inside any token; all other pairs are forced cuts."""
        found = set()
        for token in self.vocab:
            letters = token.removesuffix(self.end) if self.end else token
            found.update(map("".join, zip(letters, letters[1:])))
        return found

    def fragments(self, letters: str) -> list[str]:
        """``letters`` cut at every pair that no token holds."""
        joined, start, parts = self.joined, 0, []
        for at in range(1, len(letters)):
            if letters[at - 1 : at + 1] not in joined:
                parts.append(letters[start:at])
                start = at
        parts.append(letters[start:])
        return parts

    def _merge(self, symbols: list[str]) -> bytes:
        """Packed ids after merging: the lowest rank first, the leftmost of equal ranks."""
        if len(symbols) > KEPT_LENGTH:
            symbols = self._merged_long(symbols)
        rank, none = self.ranks.get, len(self.ranks)
        ranks = [rank(pair, none) for pair in zip(symbols, symbols[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((symbols[i], symbols[i + 1]), none)
            if i:
                ranks[i - 1] = rank((symbols[i - 1], symbols[i]), none)
        return b"".join(map(self.packed.__getitem__, symbols))

    def _merged_long(self, symbols: list[str]) -> list[str]:
        """The same merges with a heap, whose time does not grow with the square."""
        ranks, n = self.ranks, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if symbols[i] is None or j >= n or ranks.get((symbols[i], symbols[j])) != rank:
                continue  # one of the two has been merged meanwhile
            symbols[i] += symbols[j]
            symbols[j] = None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n:
                    found = ranks.get((symbols[left], symbols[right]))
                    if found is not None:
                        heapq.heappush(heap, (found, left))
        return [s for s in symbols if s is not None]

    def _letters_ids(self, letters: str) -> bytes:
        """Packed ids of one word, given as byte letters, from its fragments."""
        if self.joined.issuperset(map("".join, zip(letters, letters[1:]))):
            return self._merge([*letters[:-1], letters[-1] + self.end])
        *inner, last = self.fragments(letters)
        return b"".join(map(self.inner.__getitem__, inner)) + self.last[last]

    def _word_ids(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():
            return self._letters_ids(word)  # bytes that are their own letters
        return self._letters_ids(word.encode().decode("latin-1").translate(self.codes))

    def _plain(self, text: str) -> bytes:
        """Packed ids of a text without added tokens."""
        if not PLAIN.fullmatch(text):
            text = self.library.normalizer.normalize_str(text)
            words = self.library.pre_tokenizer.pre_tokenize_str(text)
            return b"".join(self._letters_ids(letters) for letters, _ in words)
        return b"".join(map(self.words.__getitem__, PLAIN_WORDS.findall(text.lower())))

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit integers."""
        if self.added_at is None or self.added_at.search(text) is None:
            return self._plain(text)
        parts, start = [], 0
        for found in self.added_at.finditer(text):
            parts += self._plain(text[start : found.start()]), self.added[found.group()]
            start = found.end()
        return b"".join(parts) + self._plain(text[start:])


class Tokens:
    """The tokens of a tokenizer file by id, which is all that decoding needs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        tokens = {i: token for token, i in spec["model"]["vocab"].items()}
        tokens |= {token["id"]: token["content"] for token in spec["added_tokens"]}
        self.tokens = [tokens.get(i, "") for i in range(max(tokens) + 1)]

    def decode(self, packed: bytes) -> str:
        """Tokens of packed ids, joined as a tokenizer without a decoder joins them."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


class _Filled(dict):
    """A dict that computes missing values and starts anew when it is full."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[key] = value
        return value


@functools.lru_cache(maxsize=4)
def load(kind: type, path: str):
    """``kind`` of the file at ``path``, or at a name that ``SparkContext.addFile`` shipped."""
    try:
        return kind(path)
    except FileNotFoundError:
        return kind(SparkFiles.get(path))


def encoded(text: Column, path: str) -> Column:
    """Packed ids of a text column: little-endian unsigned 32-bit integers."""

    def batches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = load(BytePairs, path).encode
        for some in slices(texts):
            yield pa.array((encode(t.as_py()) for t in some), pa.binary())

    return F.arrow_udf(batches, "binary")(text)


def decoded(ids: Column, path: str) -> Column:
    """Text of packed ids."""

    def batches(packed: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decode = load(Tokens, path).decode
        for some in slices(packed):
            yield pa.array((decode(p.as_py()) for p in some), pa.string())

    return F.arrow_udf(batches, "string")(ids)


def encode_texts(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with packed token ids in ``ids`` and their number in ``n_tokens``.

    ``path`` is a file on every machine, or the name of a file shipped by
    ``SparkContext.addFile``. A null or empty text has no ids; texts of any length are
    encoded whole; rows are independent of each other. An empty table stays empty.
    """
    made = docs.withColumn(ids, encoded(text_or_empty(text), path))
    return made.withColumn("n_tokens", (F.octet_length(column(ids)) / 4).cast("long"))


def decode_ids(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text of packed ``ids``; null ids give an empty text."""
    return docs.withColumn(text, decoded(F.coalesce(column(ids), F.lit(b"")), path))


def vocabulary(name: str) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op4_bpe_round_trip")
def op4_bpe_round_trip(spark, sf_dir):
    path = vocabulary("word_bpe_49k.json")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    made = decode_ids(encode_texts(docs, path), path)
    return made.select(
        "doc_id",
        "n_tokens",
        sha256("ids").alias("ids_sha256"),
        sha256("decoded").alias("decoded_sha256"),
    )
