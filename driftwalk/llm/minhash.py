"""Near duplicates by MinHash with tensored banding, links confirmed on full sets.

Two collections of ``COLLECTIONS`` bands are computed per text. Every pair of a left
and a right band forms a table key, so 2 x 20 bands of 4 values give 400 tables for
160 hash values instead of 3200. Texts of similarity s share a table with probability
(1 - (1 - s^4)^20)^2: 0.99995 at 0.8, more above, 0.02 at 0.3. A band that only one
text has can meet nobody, so keys are formed from the bands that several texts have,
and tables with the same members count once.

Texts of equal shingle sets are one node from the start. The nodes of a left band are
first compared with one of them, a pivot, instead of with each other. That joins most
copies into components, and only pairs of different components are looked at after it.
Such pairs meet by left band and by the size class of their sets, with a right band in
common, which is a table of theirs; a pair is formed once, not once per table.

Before any text is fetched, a pair must look similar enough by all its hash values: four
bits of each are kept, laid out in planes, and the positions at which two texts differ
are counted by built-in bit functions. The number allowed lies ``DEVIATIONS`` standard
deviations above what a pair of just the wanted similarity differs by, which loses such
a pair with probability 2e-5. Pairs of different components are then held against a bound
that loses none: every shingle flips one bit of its set's parity, so two sets differ in at
least as many shingles as their parities in bits, and of too many differences no link is
made. In a group of copies that differ a little too much, few pairs are left for the texts.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from driftwalk.llm.base import HELPER, column, read, register, slices, text_or_empty
from driftwalk.llm.components import connected_components
from driftwalk.staging import stage

WORDS, PERCENT = 5, 80
COLLECTIONS, BAND = 20, 4
# Bits kept of every hash value, and how far above the mean a pair may differ.
BITS, DEVIATIONS = 4, 4.2
# Bits of a parity: at least so many, and so many for each shingle.
LEAST_BITS, BITS_EACH = 512, 2
# Size classes are wider than the sizes of a pair can differ, against rounding.
CLASS_SLACK = 1.001
# Word hashes kept per Python worker; shingles hashed together.
KEPT_WORDS, CHUNK = 400_000, 4096

_MIX = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = value
        return value


_hash_of = _WordHashes()


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``words`` words of a text.

    Words are runs without ASCII white space, A-Z lowered. Fewer words than that form
    one shingle; a text without words has none.
    """
    split = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(split)
    if not n:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_hash_of.__getitem__, split), np.uint64, n)
    k = min(n, words)
    rolled = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        rolled = rolled * _MIX[1] + hashes[j : n - k + 1 + j]
    return np.unique(_mixed(rolled))


@functools.lru_cache(maxsize=4)
def _families(count: int) -> tuple[np.ndarray, np.ndarray]:
    rolls = np.random.default_rng(20_240_229)
    masks = rolls.integers(0, 2**64, count, np.uint64)
    factors = rolls.integers(0, 2**64, count, np.uint64) | np.uint64(1)
    return masks, factors


def min_hashes(sets: np.ndarray, count: int) -> np.ndarray:
    """``count`` min-hash values of a non-empty set of hashes."""
    masks, factors = _families(count)
    least = None
    for start in range(0, len(sets), CHUNK):
        values = ((sets[start : start + CHUNK, None] ^ masks) * factors).min(axis=0)
        least = values if least is None else np.minimum(least, values)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """One hash per band: first all left bands, then all right ones."""
    grouped = least.reshape(-1, BAND)
    found = np.arange(len(grouped), dtype=np.uint64)
    for j in range(BAND):
        found = _mixed(found * _MIX[1] + grouped[:, j])
    return found


def planes(least: np.ndarray) -> np.ndarray:
    """The lowest ``BITS`` bits of each hash value, one run of 64-bit words per bit."""
    found = _mixed(least)
    padded = np.zeros((BITS, -(-len(found) // 64) * 64), np.uint8)
    for bit in range(BITS):
        padded[bit, : len(found)] = (found >> np.uint64(bit)) & np.uint64(1)
    return np.packbits(padded, axis=1, bitorder="little").view("<u8").ravel()


def parity(sets: np.ndarray) -> np.ndarray:
    """Bits that the members of a set flip one each, a power of two of them, as 64-bit words."""
    size = max(LEAST_BITS, 1 << (BITS_EACH * len(sets) - 1).bit_length())
    flipped = np.bincount((sets & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(flipped.astype(np.uint8), bitorder="little").view("<u8")


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)])
    values = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.LargeListArray.from_arrays(offsets, pa.array(values.view(np.int64))).cast(
        pa.list_(pa.int64())
    )


def sketch(text: Column, words: int) -> Column:
    """Struct of ``n`` shingles, 16-byte ``node`` of the set, ``left`` and ``right`` bands,
    the ``planes`` of the hash values and the ``parity`` of the set."""

    def batches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        none = np.empty(0, np.uint64)
        for batch in slices(texts):
            sizes, nodes, left, right, bits, flips = [], [], [], [], [], []
            for one in batch:
                found = shingles(one.as_py(), words)
                sizes.append(len(found))
                nodes.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                least = min_hashes(found, 2 * COLLECTIONS * BAND) if len(found) else none
                keys = bands(least) if len(found) else none
                left.append(keys[:COLLECTIONS])
                right.append(keys[COLLECTIONS:])
                bits.append(planes(least))
                flips.append(parity(found) if len(found) else none)
            yield pa.StructArray.from_arrays(
                [
                    pa.array(sizes, pa.int64()),
                    pa.array(nodes, pa.binary()),
                    _longs(left),
                    _longs(right),
                    _longs(bits),
                    _longs(flips),
                ],
                ["n", "node", "left", "right", "planes", "parity"],
            )

    kind = (
        "n long, node binary, left array<long>, right array<long>, planes array<long>, "
        "parity array<long>"
    )
    return F.arrow_udf(batches, kind)(text)


def common_shingles(left: Column, right: Column, words: int) -> Column:
    """Number of shingles that two texts share."""

    def batches(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known = functools.lru_cache(maxsize=64)(lambda text: shingles(text, words))
        for one, other in pairs:
            yield pa.array(
                (
                    len(np.intersect1d(known(a.as_py()), known(b.as_py()), assume_unique=True))
                    for a, b in zip(one, other)
                ),
                pa.int64(),
            )

    return F.arrow_udf(batches, "long")(left, right)


def _text_key(text: str) -> Column:
    return F.unhex(F.md5(text_or_empty(text)))


def row_key(doc_id: str, text: str) -> Column:
    """16 bytes equal for rows of equal id and text."""
    owner = F.when(column(doc_id).isNull(), F.lit("-")).otherwise(
        F.concat(F.lit("="), column(doc_id).cast("string"))
    )
    return F.unhex(F.md5(F.concat(owner, F.lit("\n"), text_or_empty(text))))


def _shared_bands(nodes: DataFrame, side: str) -> DataFrame:
    """(nid, side): the bands of each node that other nodes have too."""
    bands_of = nodes.select("nid", F.explode(side).alias("band"))
    several = bands_of.groupBy("band").agg(F.min("nid").alias("a"), F.max("nid").alias("b"))
    several = several.where("a < b").select("band")
    return bands_of.join(several, "band").groupBy("nid").agg(F.collect_list("band").alias(side))


def _candidates(nodes: DataFrame) -> DataFrame:
    """(nid, n, text_key, planes, parity, left, right, met) of the nodes that share bands on both sides.

    ``met`` counts the nodes in all its left bands: the text that others are copies of
    meets more of them than its copies do, so it is the better pivot.
    """
    shared = _shared_bands(nodes, "left").join(_shared_bands(nodes, "right"), "nid")
    bands_of = shared.select("nid", F.explode("left").alias("band"))
    sizes = bands_of.groupBy("band").agg(F.count("*").alias("size"))
    met = bands_of.join(sizes, "band").groupBy("nid").agg(F.sum("size").alias("met"))
    own = nodes.select("nid", "n", "text_key", "planes", "parity")
    return own.join(shared, "nid").join(met, "nid")


def _pivots(members: DataFrame) -> DataFrame:
    """(key, nid): of the members of each band, the one that meets most nodes."""
    best = members.groupBy("key").agg(F.max(F.struct("met", "nid")).alias("best"))
    return best.select("key", F.col("best.nid").alias("nid"))


def _pivot_pairs(candidates: DataFrame, percent: int) -> DataFrame:
    """(u, v): the nodes of each left band beside its pivot."""
    members = candidates.select("nid", "n", "met", "planes", F.explode("left").alias("key"))
    pivots = members.join(_pivots(members), ["key", "nid"])
    pivots = pivots.select("key", *(F.col(c).alias(f"{c}_p") for c in ("nid", "n", "planes")))
    met = members.join(pivots, "key").where(F.col("nid") != F.col("nid_p"))
    return met.where(_may_link("n", "n_p", percent) & _look_alike("planes", "planes_p", percent)).select(
        F.least("nid", "nid_p").alias("u"), F.greatest("nid", "nid_p").alias("v")
    )


def _pairs_between(candidates: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(u, v): nodes of different components that share a table and may be similar enough.

    A table's key combines a left and a right band. A pair shares one if it shares a left
    band, by which it is joined, and some right band; it is formed in the least left band
    that it shares. Sets that can be similar are of the
    same size class or of neighbouring ones: the smaller set of a pair looks in its own
    class and in the next. Bands of a single component leave before the join.
    """
    rooted = candidates.join(roots.withColumnRenamed("node", "nid"), "nid", "left")
    rooted = rooted.select(
        "nid", "n", "planes", "parity", "right", "left", F.coalesce("root", "nid").alias("root"),
        F.floor(F.log("n") / math.log(CLASS_SLACK * 100 / percent)).alias("class"),
    )
    held = rooted.select("nid", "root", F.explode("left").alias("key"))
    several = held.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"))
    several = several.where("a < b").select("key")
    members = held.select("nid", "key").join(several, "key").join(rooted, "nid")
    members = stage(members, "members")
    larger = members.select(*(F.col(c).alias(f"{c}_p") for c in members.columns))
    smaller = members.withColumn("looks_in", F.explode(F.array("class", F.col("class") + 1)))
    ordered = F.struct("n", "nid") < F.struct("n_p", "nid_p")
    met = smaller.join(
        larger,
        (F.col("key") == F.col("key_p"))
        & (F.col("looks_in") == F.col("class_p"))
        & (F.col("root") != F.col("root_p"))
        & ordered
        & _may_link("n", "n_p", percent)
        & _look_alike("planes", "planes_p", percent)
        & _differ_little("parity", "parity_p", "n", "n_p", percent)
        & F.arrays_overlap("right", "right_p")
        & (F.array_min(F.array_intersect("left", "left_p")) == F.col("key")),
    )
    return met.select(F.least("nid", "nid_p").alias("u"), F.greatest("nid", "nid_p").alias("v"))


def _may_link(n: str, other: str, percent: int) -> Column:
    """Sets of these sizes can be similar enough: the smaller is a large enough share."""
    return F.least(n, other) * 100 >= F.greatest(n, other) * percent


def allowed_differences(percent: int) -> int:
    """Hash values, by their kept bits, in which a pair of this similarity may differ."""
    count, share = 2 * COLLECTIONS * BAND, (1 - percent / 100) * (1 - 0.5**BITS)
    return math.ceil(count * share + DEVIATIONS * math.sqrt(count * share * (1 - share)))


def _look_alike(one: str, other: str, percent: int) -> Column:
    """The hash values of two nodes differ in few enough positions."""
    words = -(-2 * COLLECTIONS * BAND // 64)

    def differs(word: int) -> Column:
        planes_of = [bit * words + word for bit in range(BITS)]
        apart = [F.get(one, F.lit(i)).bitwiseXOR(F.get(other, F.lit(i))) for i in planes_of]
        return F.bit_count(functools.reduce(lambda a, b: a.bitwiseOR(b), apart))

    return sum(map(differs, range(words)), F.lit(0)) <= allowed_differences(percent)


def _differ_little(one: str, other: str, n: str, n_other: str, percent: int) -> Column:
    """Sets of these parities and sizes can be similar enough; true for all that are.

    Of n + m shingles a linked pair has at most (100 - percent) / (100 + percent) in one
    set only. The longer parity is folded to the length of the shorter; beyond twice
    its length the sizes alone decide.
    """
    words = F.least(F.size(one), F.size(other))

    def folded(bits: str) -> Column:
        halves = F.slice(bits, 1, words), F.slice(bits, words + 1, words)
        half = F.zip_with(*halves, lambda a, b: a.bitwiseXOR(b))
        return F.when(F.size(bits) == 2 * words, half).otherwise(F.col(bits))

    apart = F.zip_with(folded(one), folded(other), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    least = F.aggregate(apart, F.lit(0), lambda found, more: found + more)
    far = least * (100 + percent) > (F.col(n) + F.col(n_other)) * (100 - percent)
    return ~F.coalesce(far, F.lit(False))


def _texts(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """(nid, n, text) of every candidate, one of its documents' texts each."""
    return (
        docs.join(candidates.select("nid", "n", "text_key"), "text_key")
        .groupBy("nid")
        .agg(F.first("n").alias("n"), F.first("text").alias("text"))
    )


def _linked(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The distinct ``pairs`` (u, v) whose full sets are similar enough."""

    def side(name: str) -> DataFrame:
        return texts.select(
            F.col("nid").alias(name), F.col("n").alias(f"n_{name}"), F.col("text").alias(f"t_{name}")
        )

    met = pairs.distinct().join(side("u"), "u").join(side("v"), "v")
    met = met.withColumn("common", common_shingles(F.col("t_u"), F.col("t_v"), words))
    union = F.col("n_u") + F.col("n_v") - F.col("common")
    return met.where(F.col("common") * 100 >= union * percent).select("u", "v")


def links_between(nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(u, v): confirmed links, enough of them to connect every component."""
    candidates = stage(_candidates(nodes), "candidates")
    texts = stage(_texts(candidates, docs), "texts")
    links = stage(_linked(_pivot_pairs(candidates, percent), texts, words, percent), "confirmed")
    roots = connected_components(links)
    further = _pairs_between(candidates, roots, percent)
    return links.unionAll(_linked(further, texts, words, percent))


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    words: int = WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """Per row: ``row_key``, the id, ``n_shingles``, ``component_id`` and ``kept``.

    Texts are linked if their sets of shingles share ``percent`` of the union or more.
    ``component_id`` is the smallest id that links reach, ``kept`` marks its rows. A
    null or empty text has no shingles, is linked with nothing and kept. Null ids count
    as larger than all others: a component of null ids alone has a null id and all its
    rows are kept. Rows of equal id and text are one document and share ``row_key``;
    an empty table gives an empty table.
    """
    rows = docs.select(
        row_key(doc_id, text).alias("row_key"),
        column(doc_id).alias("owner"),
        _text_key(text).alias("text_key"),
        sketch(text_or_empty(text), words).alias("sketch"),
    )
    rows = stage(rows.select("row_key", "owner", "text_key", "sketch.*"), "sketches")
    nodes = (
        rows.where("n > 0")
        .groupBy("node")
        .agg(
            F.min("owner").alias("owner"),
            *(F.first(c).alias(c) for c in ("n", "text_key", "left", "right", "planes", "parity")),
        )
        .withColumn("nid", F.monotonically_increasing_id())
    )
    nodes = stage(nodes, "nodes")
    texts = docs.select(_text_key(text).alias("text_key"), text_or_empty(text).alias("text"))
    roots = connected_components(links_between(nodes, texts, words, percent))
    labelled = nodes.join(roots.withColumnRenamed("node", "nid"), "nid", "left").select(
        "node", "owner", F.coalesce("root", "nid").alias("root")
    )
    least = labelled.groupBy("root").agg(F.min("owner").alias("component_id"))
    classes = labelled.join(least, "root").select("node", "component_id")
    found = rows.join(classes, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("owner"))
    return found.select(
        "row_key",
        F.col("owner").alias(doc_id),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("owner").eqNullSafe(component).alias("kept"),
    )


def drop_near_duplicates(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    words: int = WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps: one document of each group."""
    found = near_duplicates(docs, text, doc_id, words, percent)
    key = f"{HELPER}row"
    kept = found.where("kept").select(F.col("row_key").alias(key)).distinct()
    return docs.withColumn(key, row_key(doc_id, text)).join(kept, key, "left_semi").drop(key)


def _near_duplicates_sql(source: str, words: int, result: str) -> str:
    """CTEs ending in ``result`` (doc_id, n_shingles, component_id), by comparing all."""
    white = r"[\x20\x09-\x0D]+"
    return f"""
worded AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{white}'),
           lambda w: w <> '') AS words
  FROM {source}
),
shingled AS (
  SELECT DISTINCT doc_id,
         array_to_string(words[i : i + {words - 1}], ' ') AS shingle
  FROM (SELECT doc_id, words,
               unnest(range(1, greatest(len(words) - {words - 2}, CASE WHEN len(words) > 0 THEN 2 ELSE 1 END))) AS i
        FROM worded)
),
sized AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
linked AS (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM shingled a JOIN shingled b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN sized x ON x.doc_id = a.doc_id JOIN sized y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n
  HAVING 100 * count(*) >= {PERCENT} * (x.n + y.n - count(*))
),
reached AS (
  SELECT doc_id, doc_id AS other FROM {source}
  UNION
  SELECT r.doc_id, l.v FROM reached r JOIN linked l ON l.u = r.other
),
{result} AS (
  SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.other) AS component_id
  FROM {source} d JOIN reached r ON r.doc_id = d.doc_id LEFT JOIN sized s ON s.doc_id = d.doc_id
  GROUP BY d.doc_id
)"""


@register(
    "op6_minhash_near_dedup",
    f"""
WITH RECURSIVE {_near_duplicates_sql("documents", 4, "classes")}
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM classes
""",
)
def op6_minhash_near_dedup(spark, sf_dir):
    found = near_duplicates(read(spark, sf_dir, "documents"), words=4)
    return found.select("doc_id", "n_shingles", "component_id", "kept")
