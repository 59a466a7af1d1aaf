"""Personal data, with labels made consistent within a document by a random field.

Four kinds are found by patterns: mail addresses, IP addresses, card numbers and phone
numbers. Mentions that miss a pattern (a phone number without its country code, a card
number with other separators, an address written with ``at``) are found from those that
do not: the mentions of a document are the nodes of a conditional random field, linked
to the mentions beside them (chain) and to the last mentions of the same value, however
far away (skip chain). Sums over all labellings are approximated by loopy message
passing; a mention that is more probably of one kind than of none is a finding.

The factors are learned from all documents, each by itself: a factor's table is made of
the log of smoothed shares, which are counted where patterns give the label.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from driftwalk.llm.base import column, read, register, slices, text_or_empty

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)  # the label of what is no personal data
LABELS = NONE + 1

# Rounds of message passing, the share of a message kept from the last round, the
# probability from which a mention is a finding, and the count added to every share.
ROUNDS, DAMPING, LEAST, SMOOTHING = 12, 0.3, 0.5, 1.0
# Digits from the end that make two numbers similar, and the digits of a mention.
TAIL, MIN_DIGITS, MAX_DIGITS = 8, 7, 19

# Every pattern goes over a text in linear time: runs are taken whole, without a way back.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile(r"\+?[0-9](?:[ ().-]{0,2}[0-9])++")
_MARKED = re.compile(
    r"(?<![A-Za-z0-9])(?:[A-Za-z0-9]++(?:[._%+-]++[A-Za-z0-9]++)++|[A-Za-z]++[0-9]++[A-Za-z0-9]*+)"
)
_DOT = r"[ ]?(?:\.|\(dot\)|\[dot\]|[ ]dot[ ])[ ]?"
_AT = re.compile(
    rf"[ ]?(?:@|\(at\)|\[at\]|[ ]at[ ])[ ]?([A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)+)"
)
_NO_DIGIT = re.compile(r"[^0-9]+")


class Mention(NamedTuple):
    start: int
    end: int
    label: int  # of a pattern, or NONE
    feature: int
    keys: tuple[str, ...]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, sign and domain, leftmost first, found from their signs."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1, start):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Each four parts of a dotted number, if none is over 255."""
    for run in _DOTTED.finditer(text):
        if run[0].count(".") < 3:
            continue
        parts, start = run[0].split("."), run.start()
        for first in range(0, len(parts) - 3, 4):
            four = parts[first : first + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in four):
                yield start, end
            start = end + 1


def _luhn(digits: str) -> bool:
    ahead, doubled = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, ahead)) + sum(sum(divmod(2 * int(d), 10)) for d in doubled)) % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for found in _CARD.finditer(text):
        digits = found[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            yield found.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for found in _PHONE.finditer(text):
            if 10 <= len(_NO_DIGIT.sub("", found[0])) <= 15:
                yield found.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the patterns find, in order; ends are exclusive.

    Matches are leftmost and do not overlap within a kind; those that fail a check of
    their digits or parts are dropped and not tried again at another place.
    """
    finders = (_emails, _ips, _cards, _phones)
    return sorted((s, kind, e) for kind, find in enumerate(finders) for s, e in find(text))


def _feature(text: str, start: int, end: int) -> int:
    """What a mention looks like, as far as no pattern decides: its digits and signs."""
    piece = text[start:end]
    digits = sum(c.isdigit() for c in piece)
    letters = any(c.isalpha() for c in piece)
    return min(digits, MAX_DIGITS + 1) * 2 + letters


FEATURES = (MAX_DIGITS + 2) * 2


def mentions(text: str, base: Sequence[tuple[int, int, int]]) -> list[Mention]:
    """What patterns find and what might be the same again, in order of their places.

    Candidates are numbers of ``MIN_DIGITS`` to ``MAX_DIGITS`` digits and words with
    signs or digits in them, also with ``at`` and ``dot`` in words. They overlap no match
    of a pattern. Only what shares a key with another mention can be found by the field.
    """
    found = []
    covered: list[tuple[int, int]] = []
    for start, kind, end in base:
        piece = text[start:end]
        if kind == 0:
            keys = ("m" + piece.lower(), "l" + piece[: piece.index("@")].lower())
        elif kind == 1:
            keys = ("i" + piece,)
        else:
            keys = ("d" + _NO_DIGIT.sub("", piece)[-TAIL:],)
        found.append(Mention(start, end, kind, _feature(text, start, end), keys))
        if covered and start < covered[-1][1]:
            covered[-1] = (covered[-1][0], max(covered[-1][1], end))
        else:
            covered.append((start, end))
    edges = [0, *(x for span in covered for x in span), len(text)]
    for left, right in zip(edges[::2], edges[1::2]):
        for m in _NUMBER.finditer(text, left, right):
            digits = _NO_DIGIT.sub("", m[0])
            if MIN_DIGITS <= len(digits) <= MAX_DIGITS:
                found.append(_candidate(text, m.start(), m.end(), ("d" + digits[-TAIL:],)))
        done = left
        for m in _MARKED.finditer(text, left, right):
            if m.start() < done:
                continue
            word, end = m[0].lower(), m.end()
            keys: tuple[str, ...] = ("l" + word,)
            if domain := _AT.match(text, end, right):
                end = domain.end()
                plain = re.sub(_DOT, ".", domain[1].lower())
                keys = (f"m{word}@{plain}", *keys)
            done = end
            found.append(_candidate(text, m.start(), end, keys))
    return sorted(found)


def _candidate(text: str, start: int, end: int, keys: tuple[str, ...]) -> Mention:
    return Mention(start, end, NONE, _feature(text, start, end), keys)


def _links(nodes: Sequence[Mention]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbours, and of mentions that share a key.

    Every mention is linked with the last one of its key and with the last one that a
    pattern found, so links grow with mentions, not with pairs of them.
    """
    chain = [(i, i + 1) for i in range(len(nodes) - 1)]
    last: dict[tuple[str, bool], int] = {}
    skip: dict[tuple[int, int], None] = {}
    for i, node in enumerate(nodes):
        for place in itertools.product(node.keys, (False, True)):
            if place in last:
                skip[last[place], i] = None
        for key in node.keys:
            last[key, False] = i
            if node.label != NONE:
                last[key, True] = i
    pairs = (np.array(list(p), dtype=np.int64).reshape(-1, 2) for p in (chain, skip))
    return tuple(pairs)


def _linked_to_base(nodes: list[Mention]) -> list[Mention]:
    """The pattern's mentions and the candidates that share a key with one, by any links."""
    known = {key for node in nodes if node.label != NONE for key in node.keys}
    while True:
        more = {k for n in nodes if not known.isdisjoint(n.keys) for k in n.keys} - known
        if not more:
            return [n for n in nodes if not known.isdisjoint(n.keys)]
        known |= more


class Field(NamedTuple):
    """Log factors: of a feature and a label, of neighbours' labels, of linked labels."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def learn(counts: DataFrame) -> Field:
    """The factors from a table (factor, a, b, n) of ``count_labels``.

    The table has at most as many rows as the factors have cells. Unary shares are of
    the labels of a feature; shares of pairs are held against those of the single labels,
    so that a factor says only what its pair adds. Patterns decide the labels counted,
    and a candidate that shares its value with a match has none, so it counts nowhere.
    """
    tables = {
        "unary": np.zeros((FEATURES, LABELS)),
        "chain": np.zeros((LABELS, LABELS)),
        "skip": np.zeros((LABELS, LABELS)),
    }
    for row in counts.collect():
        tables[row["factor"]][row["a"], row["b"]] += row["n"]
    unary = tables["unary"] + SMOOTHING
    unary = np.log(unary / unary.sum(1, keepdims=True))

    def beyond_chance(table: np.ndarray) -> np.ndarray:
        both = table + table.T + SMOOTHING
        both /= both.sum()
        single = both.sum(1)
        return np.log(both / np.outer(single, single))

    return Field(unary, beyond_chance(tables["chain"]), beyond_chance(tables["skip"]))


def marginals(field: Field, nodes: Sequence[Mention]) -> np.ndarray:
    """Probabilities (mention, label) after loopy message passing.

    Mentions of a pattern keep its label. All messages of a round are sent at once.
    """
    n = len(nodes)
    own = field.unary[[node.feature for node in nodes]].copy()
    for i, node in enumerate(nodes):
        if node.label != NONE:
            own[i] = -np.inf
            own[i, node.label] = 0.0
    chain, skip = _links(nodes)
    pairs = np.concatenate([chain, skip])
    factors = np.concatenate(
        [np.repeat(field.chain[None], len(chain), 0), np.repeat(field.skip[None], len(skip), 0)]
    )
    # Every link carries a message each way; the factors are symmetric.
    source, target = np.concatenate([pairs, pairs[:, ::-1]]).T
    factors = np.concatenate([factors, factors])
    back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
    sent = np.zeros((len(source), LABELS))
    for _ in range(ROUNDS if len(pairs) else 0):
        belief = own.copy()
        np.add.at(belief, target, sent)
        new = np.logaddexp.reduce((belief[source] - sent[back])[:, :, None] + factors, axis=1)
        new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
        sent = DAMPING * sent + (1 - DAMPING) * new
    belief = own.copy()
    np.add.at(belief, target, sent)
    return np.exp(belief - np.logaddexp.reduce(belief, axis=1, keepdims=True)) if n else belief


def all_spans(
    field: Field, text: str, base: Sequence[tuple[int, int, int]]
) -> list[tuple[int, int, int]]:
    """(start, kind, end) of patterns and field, in order."""
    if not base:
        return []
    nodes = _linked_to_base(mentions(text, base))
    added = []
    if len(nodes) > len(base):
        shares = marginals(field, nodes)
        for node, share in zip(nodes, shares):
            kind = int(share[:NONE].argmax())
            if node.label == NONE and share[kind] > LEAST:
                added.append((node.start, kind, node.end))
    return sorted([*base, *added])


def written(spans: Sequence[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def count_labels(docs: DataFrame, text: str = "text") -> DataFrame:
    """(factor, a, b, n): how often features meet labels and labels meet each other.

    Counted over all documents; a batch is counted before anything is shuffled. A
    candidate's label is NONE, unless it shares a value with a match of a pattern:
    then it is unknown and left out. Skip links are between two known labels.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[tuple[str, int, int]] = Counter()
        for texts in slices(batch.column(0) for batch in batches):
            for value in texts:
                body = value.as_py()
                nodes = mentions(body, base_spans(body))
                known = {key for node in nodes if node.label != NONE for key in node.keys}
                sure = [n.label != NONE or known.isdisjoint(n.keys) for n in nodes]
                found.update(("unary", n.feature, n.label) for n, s in zip(nodes, sure) if s)
                for factor, pairs in zip(("chain", "skip"), _links(nodes)):
                    for a, b in pairs.tolist():
                        if sure[a] and sure[b]:
                            found[factor, nodes[a].label, nodes[b].label] += 1
        rows = [(*cell, n) for cell, n in sorted(found.items())]
        names = ["factor", "a", "b", "n"]
        columns = zip(*rows) if rows else ([], [], [], [])
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    parts = docs.select(text_or_empty(text).alias("text")).mapInArrow(
        count, "factor string, a int, b int, n long"
    )
    return parts.groupBy("factor", "a", "b").agg(F.sum("n").alias("n"))


def find_personal(
    docs: DataFrame, field: Field, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """doc_id, the number of matches per kind, ``base`` and ``spans``.

    ``base`` has the matches of the patterns, ``spans`` these and the field's findings,
    both as ``kind:start:end`` by start, then kind, joined by commas; places are code
    points, ends exclusive. The field adds findings only to documents in which a pattern
    matches. Null and empty texts hold nothing; a row of the table is a row of the
    result, so repeated rows and null ids stay; an empty table gives an empty one.
    Links of a document grow with its mentions, however often one repeats.
    """
    names = ["id", *(f"n_{kind}" for kind in KINDS), "base", "spans"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                counts: list[list[int]] = [[] for _ in KINDS]
                base_texts, span_texts = [], []
                for value in piece.column(1):
                    body = value.as_py()
                    base = base_spans(body)
                    kinds = Counter(kind for _, kind, _ in base)
                    for kind in range(NONE):
                        counts[kind].append(kinds[kind])
                    base_texts.append(written(base))
                    span_texts.append(written(all_spans(field, body, base)))
                columns = [piece.column(0), *(pa.array(c, pa.int64()) for c in counts)]
                columns += [pa.array(base_texts, pa.string()), pa.array(span_texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(column(doc_id).alias("id"), text_or_empty(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    numbers = ", ".join(f"n_{kind} long" for kind in KINDS)
    found = rows.mapInArrow(find, f"id {kind}, {numbers}, base string, spans string")
    return found.withColumnRenamed("id", doc_id)


def tag(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``find_personal`` by factors learned from the same documents."""
    return find_personal(docs, learn(count_labels(docs, text)), text, doc_id)


@register("op12_personal_data")
def op12_personal_data(spark, sf_dir):
    found = tag(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *(f"n_{kind}" for kind in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans"
    )
