"""How the tokens of two tokenizers fall together, over all texts of a table.

Rows are shuffled by their full text, so that every distinct text is encoded and aligned
once, however often it is there. Places where tokens of both end cut a text into groups;
tokens of the two in one group are linked. How many documents hold a pair of ids linked
is counted over distinct texts, weighted by their copies. What a text has of its pairs
is measured once and joined to the ids of its documents.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftwalk.llm.base import column, read, register, sha256, text_or_empty
from driftwalk.staging import stage

# Pairs held by the most texts are broadcast, so many at most (24 bytes each).
BROADCAST_PAIRS = 500_000
# Words of a kind kept with their ids of A by a worker, and the longest worth it.
KEPT_WORDS, KEPT_LENGTH = 400_000, 64

# Characters whose classes are the same in every engine, and words of them as A cuts them.
_LETTER, _NUMBER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe"
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\u024f\u2010-\u2027\u20ac]*+")
WORDS = re.compile(
    rf"'(?:[stmd]|re|ve|ll)|\x20?[{_LETTER}]+|\x20?[{_NUMBER}]+"
    rf"|\x20?[^\t\n\r\x20{_LETTER}{_NUMBER}]+|[\t\n\r\x20]+(?![^\t\n\r\x20])|[\t\n\r\x20]+"
)
# Texts aligned before a batch of results is handed on, and linked ids formed at once.
TEXTS, LINKS = 64, 1 << 20
# Characters of texts whose words are looked up together, one text at least.
CHARACTERS = 1 << 20

ALIGNED = (
    "key binary, copies long, n_a long, n_b long, n_groups long, n_links long, "
    "groups_sha256 string, pairs array<long>, times array<long>"
)


class Tokenizers(NamedTuple):
    """Paths of a byte-level BPE file (A) and of a piece model with byte fallback (B)."""

    a: str
    b: str


def public(a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> Tokenizers:
    import public_tokenizers

    return Tokenizers(public_tokenizers.path(a), public_tokenizers.path(b))


def _lengths_a(vocabulary: dict[str, int]) -> list[bytes]:
    """Bytes of every id of A: an entry has a letter for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}
    made = [b""] * (max(vocabulary.values()) + 1)
    for entry, at in vocabulary.items():
        made[at] = (
            bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
        )
    return made


def _bytes_b(piece: str) -> bytes:
    if named := re.fullmatch("<0x([0-9A-F]{2})>", piece):
        return bytes([int(named[1], 16)])
    return piece.replace("▁", " ").encode()


class Aligner:
    """Both tokenizers of a worker, with the bytes of their tokens."""

    def __init__(self, paths: Tokenizers) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(paths.a, encoding="utf-8") as file:
            content = json.load(file)
        self.a = Tokenizer.from_file(paths.a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        entries = _lengths_a(content["model"]["vocab"])
        self.b = sentencepiece.SentencePieceProcessor(model_file=paths.b)
        pieces = [_bytes_b(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.bytes = entries, pieces
        self.sizes = tuple(np.array([len(x) for x in side], dtype=np.int64) for side in self.bytes)
        # Every id with a comma behind it, then with the sign that ends its side of a group.
        self.names = np.array(
            [
                f"{i}{sign}".encode()
                for side, end in zip(self.bytes, "|;")
                for sign in (",", end)
                for i in range(len(side))
            ]
        )
        self.span = len(pieces)
        # The bytes of B's pieces one after the other, and where each begins.
        self.flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.starts = np.cumsum(self.sizes[1]) - self.sizes[1]
        # Words met lately and those before, with their ids as bytes of 32-bit integers;
        # what is still in use moves over.
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode_a(self, text: str) -> list[int]:
        return self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def bytes_of(self, side: int, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes[side].__getitem__, ids))

    def ids_a(self, text: str) -> list[int] | None:
        """Ids of A of one text; None if they do not come back."""
        (found,) = self.all_ids_a([text])
        return None if found is None else found.tolist()

    def all_ids_a(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of A of each text, by way of words met before in plain texts.

        The encoder cuts a text into words and encodes each by itself. Of plain
        characters every engine's classes are the same, so words are cut here too.
        Words that do not come back stay unknown; their texts are encoded whole.
        """
        cut = [WORDS.findall(text) if PLAIN.fullmatch(text) else None for text in texts]
        known = self.words
        new = set().union(*filter(None, cut)).difference(known)
        self._learn(new)
        found = []
        for text, words in zip(texts, cut):
            try:
                ids = None if words is None else b"".join(map(known.__getitem__, words))
            except KeyError:
                ids = None
            if ids is not None:
                found.append(np.frombuffer(ids, dtype=np.uint32).astype(np.int64))
                continue
            whole = self.encode_a(text)
            back = self.bytes_of(0, whole) == text.encode()
            found.append(np.array(whole, dtype=np.int64) if back else None)
        for word in new:
            if len(word) > KEPT_LENGTH:
                known.pop(word, None)
        if len(known) > KEPT_WORDS:
            self.older, self.words = known, {}
        return found

    def _learn(self, new: set[str]) -> None:
        """Make words known, from those of before or encoded, if they come back.

        Words of letters are one text, those without a blank behind line ends: no token
        reaches over two of them, so the sizes of the tokens part them again.
        """
        older, known = self.older, self.words
        letters, rest = [], []
        for word in new:
            if word in older:
                known[word] = older[word]
            elif word.isalpha():
                letters.append("\n" + word)
            elif word[0] == " " and word[1:].isalpha():
                letters.append(word)
            else:
                rest.append(word)
        if letters:
            ids = np.array(self.encode_a("".join(letters)), dtype=np.uint32)
            whole = [word.encode() for word in letters]
            due, ends = np.cumsum([len(word) for word in whole]), np.cumsum(self.sizes[0][ids])
            stops = np.searchsorted(ends, due) + 1
            if self.bytes_of(0, ids.tolist()) == b"".join(whole) and (ends[stops - 1] == due).all():
                made, start = ids.tobytes(), 0
                for word, stop in zip(letters, (4 * stops).tolist()):
                    if word[0] == "\n":
                        known[word[1:]] = made[start + 4 : stop]
                    else:
                        known[word] = made[start:stop]
                    start = stop
            else:
                rest += [word.removeprefix("\n") for word in letters]
        for word in rest:
            ids = self.encode_a(word)
            if self.bytes_of(0, ids) == word.encode():
                known[word] = np.array(ids, dtype=np.uint32).tobytes()

    def _comes_back_b(self, ids: np.ndarray, body: bytes) -> bool:
        """The bytes of these ids of B are ``body``."""
        sizes = self.sizes[1][ids]
        if sizes.sum() != len(body):
            return False
        if len(body) > LINKS:
            return self.bytes_of(1, ids.tolist()) == body
        at = np.repeat(self.starts[ids] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(body))
        return bool((self.flat[at] == np.frombuffer(body, dtype=np.uint8)).all())

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and B; None where the bytes of either are not a blank and the text."""
        return next(self.all_tokens([text]))

    def all_tokens(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """``tokens`` of each text; words are looked up for some texts at a time."""
        start = 0
        while start < len(texts):
            stop, size = start + 1, len(texts[start])
            while stop < len(texts) and size + len(texts[stop]) <= CHARACTERS:
                size += len(texts[stop])
                stop += 1
            part = texts[start:stop]
            for text, a in zip(part, self.all_ids_a([" " + text for text in part])):
                if not text or a is None:
                    yield None
                    continue
                b = np.array(self.b.encode(text, num_threads=1), dtype=np.int64)
                yield (a, b) if self._comes_back_b(b, b" " + text.encode()) else None
            start = stop

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The group of every token: the number of common ends before its own end."""
        ends = [np.cumsum(size[ids]) for size, ids in zip(self.sizes, (a, b))]
        ended = [np.zeros(ends[0][-1] + 1, dtype=bool) for _ in ends]
        for marks, end in zip(ended, ends):
            marks[end] = True
        common = [marks[end] for marks, end in zip(reversed(ended), ends)]
        return tuple(np.cumsum(shared) - shared for shared in common)

    def written(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: the groups with the ids of A and B in order."""
        ends_a = np.append(np.flatnonzero(np.diff(in_a)), len(a) - 1)
        ends_b = np.append(np.flatnonzero(np.diff(in_b)), len(b) - 1)
        n_a, n_b = (len(side) for side in self.bytes)
        code_a, code_b = a.copy(), b + 2 * n_a
        code_a[ends_a] += n_a
        code_b[ends_b] += n_b
        # Before a token stand all of its side, and of the other those of earlier groups.
        codes = np.empty(len(a) + len(b), dtype=np.int64)
        codes[np.arange(len(a)) + np.append(0, ends_b + 1)[in_a]] = code_a
        codes[np.arange(len(b)) + (ends_a + 1)[in_b]] = code_b
        return self.names[codes].tobytes().translate(None, b"\0")[:-1]

    def links(
        self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Distinct linked pairs as ``a * span + b``, and how often each is linked.

        Tokens of B are repeated for every token of A in their group, ``LINKS`` links
        at a time; of a larger group, distinct ids are paired with their numbers.
        """
        n_groups = int(in_a[-1]) + 1
        count_a, count_b = (np.bincount(g, minlength=n_groups) for g in (in_a, in_b))
        made = count_a * count_b
        found = []
        for group in np.flatnonzero(made > LINKS).tolist():
            sides = [np.unique(ids[g == group], return_counts=True) for ids, g in ((a, in_a), (b, in_b))]
            (ids_a, times_a), (ids_b, times_b) = sides
            for i, n in zip(ids_a, times_a):
                found.append((i * self.span + ids_b, n * times_b))
        first_b = np.cumsum(count_b) - count_b
        normal = np.flatnonzero(made[in_a] <= LINKS)
        per_token = count_b[in_a[normal]]
        total = np.cumsum(per_token)
        start = 0
        while start < len(normal):
            stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + LINKS, "right")))
            n = per_token[start:stop]
            tokens = np.repeat(normal[start:stop], n)
            offset = np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n)
            pairs = a[tokens] * self.span + b[first_b[in_a[tokens]] + offset]
            found.append(np.unique(pairs, return_counts=True))
            start = stop
        if len(found) == 1:
            return found[0]
        pairs, at = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
        times = np.zeros(len(pairs), dtype=np.int64)
        np.add.at(times, at, np.concatenate([t for _, t in found]))
        return pairs, times


@functools.lru_cache(maxsize=2)
def _aligner(paths: Tokenizers) -> Aligner:
    return Aligner(paths)


def _shared(spark: SparkSession, paths: Tokenizers) -> Tokenizers:
    """Names of the files as every executor gets them from the driver."""
    names = []
    for path in paths:
        spark.sparkContext.addFile(path)
        names.append(os.path.basename(path))
    return Tokenizers(*names)


def align_texts(docs: DataFrame, paths: Tokenizers, text: str = "text") -> DataFrame:
    """A row per distinct text: key, copies, sizes, digest of groups, linked pairs.

    ``key`` is the text's SHA-256, ``copies`` the number of its rows. Texts without
    tokens are left out.
    """
    names = _shared(docs.sparkSession, paths)
    distinct = docs.groupBy(text_or_empty(text).alias("text")).agg(F.count("*").alias("copies"))
    fields = [field.split(" ")[0] for field in ALIGNED.split(", ")]
    kinds = [pa.binary(), *[pa.int64()] * 5, pa.string(), *[pa.list_(pa.int64())] * 2]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(Tokenizers(*map(SparkFiles.get, names)))
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                piece = batch.slice(start, TEXTS)
                rows = []
                bodies = piece.column(0).to_pylist()
                for body, copies, ids in zip(bodies, piece.column(1), aligner.all_tokens(bodies)):
                    if ids is None:
                        continue
                    groups = aligner.groups(*ids)
                    pairs, times = aligner.links(*ids, *groups)
                    digest = hashlib.sha256(aligner.written(*ids, *groups)).hexdigest()
                    rows.append(
                        (
                            hashlib.sha256(body.encode()).digest(), copies.as_py(), len(ids[0]), len(ids[1]),
                            int(groups[0][-1]) + 1, int(times.sum()), digest, pairs, times,
                        )
                    )
                columns = list(zip(*rows)) or [[]] * len(fields)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), kind) for c, kind in zip(columns, kinds)], fields
                )

    return distinct.select("text", "copies").mapInArrow(align, ALIGNED)


def pair_counts(aligned: DataFrame, span: int) -> DataFrame:
    """(pair, n, best): documents that hold a pair linked; if that is its A id's most."""
    counted = (
        aligned.select("copies", F.explode("pairs").alias("pair"))
        .groupBy("pair")
        .agg(F.sum("copies").alias("n"))
    )
    counted = stage(counted, "pairs")

    def a_id() -> Column:
        return F.floor(F.col("pair") / span)

    # As many rows as A has ids at most.
    most = counted.groupBy(a_id().alias("a")).agg(F.max("n").alias("most"))
    found = counted.join(F.broadcast(most), a_id() == F.col("a"))
    return found.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _measured(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, n_best, count_sum) of every text, from the counts of its pairs.

    Pairs that many documents hold are few: those above a count that leaves at most
    ``BROADCAST_PAIRS`` of them are broadcast. The rest is shuffled by pair, of which
    none is hot then; both kinds are summed per text before they meet.
    """
    counts = stage(counts, "counts")
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("size")).count().collect()
    bound, left = 63, BROADCAST_PAIRS
    for row in sorted(sizes, key=lambda r: -r["size"]):  # at most 63 rows
        left -= row["count"]
        if left < 0:
            break
        bound = row["size"]
    else:
        bound = 0
    links = aligned.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("l"))
    links = links.select("key", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    often = F.floor(F.log2("n")) >= bound
    sums = (
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    )
    hot = F.broadcast(counts.where(often))
    if bound == 0:
        return links.join(hot, "pair").groupBy("key").agg(*sums)
    met = links.join(hot, "pair", "left")
    common = met.where(F.col("n").isNotNull()).groupBy("key").agg(*sums)
    rare = met.where(F.col("n").isNull()).select("key", "pair", "times")
    rare = rare.join(counts.where(~often), "pair").groupBy("key").agg(*sums)
    both = common.unionByName(rare).groupBy("key")
    return both.agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def align_tokens(
    docs: DataFrame, paths: Tokenizers, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """doc_id, the number of tokens, groups and links, and what the corpus says of them.

    ``n_best`` are links whose pair is held by as many documents as any pair of its A
    id, ``count_sum`` sums the documents of each link's pair. Every row is a document,
    with its id or without; repeated rows count as often as they are there. Null and
    empty texts, and those that a tokenizer's bytes do not give back, have zeros and an
    empty ``groups_sha256``. An empty table gives an empty one. Texts of any length are
    taken whole; links of one are formed in pieces.
    """
    aligned = stage(align_texts(docs, paths, text), "aligned")
    span = _aligner(paths).span
    measures = _measured(aligned, pair_counts(aligned, span)).withColumnRenamed("key", "of")
    texts = aligned.drop("pairs", "times", "copies").join(measures, F.col("key") == F.col("of"))
    texts = stage(texts.drop("of"), "measures")
    rows = docs.select(
        column(doc_id).alias("id"), F.unhex(sha256(text_or_empty(text))).alias("of")
    )
    found = rows.join(texts, F.col("of") == F.col("key"), "left")
    return found.select(
        F.col("id").alias(doc_id),
        *(F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in MEASURES),
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"),
    )


@register("op11_token_alignment")
def op11_token_alignment(spark, sf_dir):
    return align_tokens(read(spark, sf_dir, "documents"), public())
