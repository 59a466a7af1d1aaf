import itertools
import random
import re
import time

import numpy as np
from hypothesis import given, settings, strategies as st

from driftwalk.llm import personal as pii

DOCS = "doc_id long, text string"


def brute_spans(text):
    """The patterns of the contract as they stand, with the checks of what they match."""

    def luhn(number):
        total = 0
        for i, c in enumerate(reversed(number)):
            d = int(c) * (1 + i % 2)
            total += d - 9 if d > 9 else d
        return total % 10 == 0

    def digits(piece):
        return re.sub("[^0-9]", "", piece)

    patterns = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda p: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda p: all(int(x) <= 255 for x in p.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda p: 14 <= len(digits(p)) <= 19 and luhn(digits(p))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda p: 10 <= len(digits(p)) <= 15),
    ]
    found = [
        (m.start(), kind, m.end())
        for kind, (pattern, good) in enumerate(patterns)
        for m in re.finditer(pattern, text)
        if good(m[0])
    ]
    return sorted(found)


PARTS = [
    "a.b@c.de", "x@", "@", "a@b@c.d", "1.2.3.4", "1.2.3.4.5.6.7.8.9", "256.1.1.1", "0001.002.3.4", ".",
    "4111 1111 1111 1111", "4111-1111-1111-1111", "+49 30 1234567", "+1 (555) 010-2030", "+", "-", " ",
    "12", "é", "👍", "9", "a", "%", "+1.2.3.4.5.6.7", "5500005555555559", "\n", ")", "_",
]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_patterns_equal_brute_force(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_patterns_take_linear_time():
    start = time.time()
    for piece in ("a", "1", "1.", "1 ", "a@", "+1", "a.", "(", "a1", "@a", ". ", "+1("):
        text = piece * 200_000
        pii.mentions(text, pii.base_spans(text))
    assert time.time() - start < 60


def made(seed, n):
    """Documents with numbers that repeat in other forms, and numbers that are no data."""
    rolls = random.Random(seed)
    texts = []
    for i in range(n):
        number = "".join(rolls.choices("0123456789", k=9))
        order = "".join(rolls.choices("0123456789", k=rolls.choice([8, 9, 10])))
        whole = f"+49 {number[:2]} {number[2:]}"
        parts = ["lorem", "ipsum", f"order {order}", f"see {order} again", "v2.10", "file_name"]
        if i % 3:
            parts += [f"call {whole}", f"or {whole}", f"mail jo.doe{i}@site.org to jo.doe{i}@site.org"]
        rolls.shuffle(parts)
        texts.append(" and ".join(parts))
    return texts


def test_field_finds_what_repeats(rows):
    late = "Call +49 30 1234567 now. " + "words in between " * 50
    docs = [*enumerate(made(4, 90))]
    docs += [
        (1000, late + "Later dial 030 1234567 or 030/99 88 77 66."),
        (1001, "Write jo.doe@site.org. " * 2 + "jo.doe (at) site (dot) org is me, jo.doe too, not jo.dot"),
        (1002, "Nothing here but 030 1234567 and jo.doe."),
        (1003, "pay 4111 1111 1111 1111 with 4111.1111.1111.1111 or 4111 1111 1111 1112"),
    ]
    got = {r.doc_id: r for r in pii.tag(rows(docs, DOCS)).collect()}
    texts = dict(docs)

    def added(d):
        base = set(got[d].base.split(","))
        spans = [s.split(":") for s in got[d].spans.split(",") if s and s not in base]
        return [(kind, texts[d][int(a) : int(b)]) for kind, a, b in spans]

    for d, text in docs:
        base = brute_spans(text)
        assert got[d].base == pii.written(base)
        assert set(pii.written(base).split(",")) <= set(got[d].spans.split(","))
        assert got[d].n_phone == sum(kind == 3 for _, kind, _ in base)
    assert added(1000) == [("phone", "030 1234567")]
    assert added(1001) == [("email", "jo.doe (at) site (dot) org"), ("email", "jo.doe")]
    assert got[1002].spans == ""
    assert added(1003) == [("card", "4111.1111.1111.1111")]
    assert all(not added(d) for d in range(90))


def test_messages_on_a_chain_are_exact():
    """Without cycles message passing gives the sums over all labellings."""
    rolls = np.random.default_rng(3)
    table = rolls.normal(size=(5, 5))
    field = pii.Field(rolls.normal(size=(pii.FEATURES, 5)), table + table.T, np.zeros((5, 5)))
    nodes = [pii.Mention(i, i + 1, label, 4 + i, (f"k{i}",)) for i, label in enumerate((4, 2, 4, 4))]
    total = np.zeros((4, 5))
    for labels in itertools.product(range(5), repeat=4):
        if labels[1] != 2:
            continue
        score = sum(field.unary[4 + i, x] for i, x in enumerate(labels) if i != 1)
        score += sum(field.chain[a, b] for a, b in itertools.pairwise(labels))
        total[range(4), labels] += np.exp(score)
    expected = total / total.sum(1, keepdims=True)
    assert np.abs(pii.marginals(field, nodes) - expected).max() < 1e-3


def test_counts_cover_all_documents(rows):
    """One table, however its rows are dealt out; known labels only."""
    texts = made(5, 40) + ["+49 30 1234567 then 030 1234567 then 99999999 99"]
    docs = rows(list(enumerate(texts)), DOCS)
    few = {tuple(r) for r in pii.count_labels(docs.coalesce(1)).collect()}
    assert {tuple(r) for r in pii.count_labels(docs.repartition(7)).collect()} == few
    expected = 0
    for text in texts:
        nodes = pii.mentions(text, pii.base_spans(text))
        keys = {k for n in nodes if n.label != pii.NONE for k in n.keys}
        expected += sum(n.label != pii.NONE or not keys & set(n.keys) for n in nodes)
    assert sum(n for factor, _, _, n in few if factor == "unary") == expected


def test_odd_rows(odd_docs, rows):
    got = pii.tag(odd_docs)
    assert got.count() == odd_docs.count()
    assert {r.spans for r in got.collect()} == {""}
    assert pii.tag(odd_docs.limit(0)).count() == 0
    twice = rows([(1, "a.b@c.de"), (1, "a.b@c.de"), (None, "+4930 1234567")], DOCS)
    clash = twice.selectExpr("*", "1 AS id", "2 AS base", "3 AS spans", "4 AS n_email")
    assert sorted(r.spans for r in pii.tag(clash).collect()) == ["email:0:8", "email:0:8", "phone:0:13"]
    many = ", ".join(["+49 30 1234567", "030 1234567"] * 3000)
    row = pii.tag(rows([(1, many)], DOCS)).first()
    assert row.n_phone == 3000 and row.spans.count(",") >= 3000
