"""Token counts under a unigram vocabulary, by a trie of pre-tokens.

The best segmentation of a word is found by forward scores: the best score of every
prefix follows from shorter prefixes. Words that share a prefix share its scores, so
the distinct pre-tokens of a batch are visited in the order of a trie and only the
part past the shared prefix is computed. The count at the end of a word is stored.
"""

from __future__ import annotations

import base64
import functools
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, functions as F

from driftwalk.llm.base import read, register, slices, text_or_empty
from driftwalk.llm.bpe import vocabulary

# Pre-tokens kept with their counts per Python worker, and the longest worth keeping.
KEPT_WORDS, KEPT_LENGTH = 200_000, 64


class Unigrams:
    """A vocabulary of byte strings with log probabilities.

    ``path`` is a file of base64 tokens and ranks. Ranks say how frequent tokens are;
    by Zipf's law the token of rank r has a log probability of -log(r + 2) plus the
    same constant for all tokens. The best segmentation has the largest sum; of equal
    sums the fewest tokens, of these the longest last token.
    """

    def __init__(self, path: str, pattern: str):
        tokens = {}
        with open(path, "rb") as file:
            for line in file:
                token, rank = line.split()
                tokens[base64.b64decode(token)] = int(rank)
        norm = math.log(sum(1 / (r + 2) for r in tokens.values()))
        self.scores = {token: -math.log(r + 2) - norm for token, r in tokens.items()}
        self.longest = max(map(len, self.scores))
        self.suffixes = {token[i:] for token in tokens for i in range(len(token))}
        self.pattern = regex.compile(pattern)
        self.kept: dict[str, int] = {}

    def _extend(self, word: bytes, best: list[tuple[float, int]]) -> None:
        """Forward scores (score, -tokens) of the prefixes that ``best`` lacks."""
        scores, suffixes = self.scores, self.suffixes
        for end in range(len(best), len(word) + 1):
            found = None
            for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
                piece = word[start:end]
                if piece not in suffixes:
                    break  # no token ends in it, hence in nothing longer
                score = scores.get(piece)
                if score is not None:
                    before, tokens = best[start]
                    path = (before + score, tokens - 1)
                    if found is None or path >= found:
                        found = path
            best.append(found)

    def count_words(self, words: Iterable[str]) -> dict[str, int]:
        """Token counts of distinct words, in trie order: shared prefixes once."""
        counts, before, best = {}, b"", [(0.0, 0)]
        for word in sorted(w.encode() for w in words):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del best[shared + 1 :]
            self._extend(word, best)
            counts[word.decode()] = -best[-1][1]
            before = word
        return counts

    def count_texts(self, texts: list[str]) -> list[tuple[int, int]]:
        """(tokens, pre-tokens) of each text."""
        split = [self.pattern.findall(t) for t in texts]
        kept = self.kept
        new = set().union(*split).difference(kept)
        counts = kept
        if new:
            found = self.count_words(new)
            counts = {**kept, **found} if len(found) < len(kept) else {**found, **kept}
            short = {w: n for w, n in found.items() if len(w) <= KEPT_LENGTH}
            if len(kept) + len(short) > KEPT_WORDS:
                kept.clear()
            if len(short) <= KEPT_WORDS:
                kept.update(short)
        return [(sum(map(counts.__getitem__, words)), len(words)) for words in split]


@functools.lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Unigrams:
    try:
        return Unigrams(path, pattern)
    except FileNotFoundError:
        return Unigrams(SparkFiles.get(path), pattern)


# Texts counted together: enough to share prefixes, few enough to bound memory.
TOGETHER = 256


def token_count(text: Column, path: str, pattern: str) -> Column:
    """Struct of ``n_tokens`` and ``n_pretokens`` of a text column."""
    kind = pa.struct([("n_tokens", pa.int64()), ("n_pretokens", pa.int64())])

    def batches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        unigrams = load(path, pattern)
        for some in slices(texts, TOGETHER):
            found = unigrams.count_texts(some.to_pylist())
            yield pa.array(
                [{"n_tokens": n, "n_pretokens": words} for n, words in found], type=kind
            )

    return F.arrow_udf(batches, "n_tokens long, n_pretokens long")(text)


def count_tokens(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``n_pretokens`` and ``n_bytes`` of the whole text.

    A null or empty text has no tokens. Rows are independent of each other and equal
    texts have equal counts. An empty table stays empty.
    """
    counted = "__llm_counted"
    return (
        docs.withColumn(counted, token_count(text_or_empty(text), path, pattern))
        .withColumns(
            {
                "n_tokens": F.col(f"{counted}.n_tokens"),
                "n_pretokens": F.col(f"{counted}.n_pretokens"),
                "n_bytes": F.octet_length(text_or_empty(text)).cast("long"),
            }
        )
        .drop(counted)
    )


@register("op7_token_counts")
def op7_token_counts(spark, sf_dir):
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(
        docs, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return counted.select("doc_id", "n_tokens", "n_pretokens", "n_bytes")
