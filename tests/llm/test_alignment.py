import hashlib
import json
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from driftwalk.llm import alignment as al
from made import sentences

DOCS = "doc_id long, text string"


def brute_groups(aligner, text):
    """Groups as lists of ids, by walking both tokens' ends."""
    ids = aligner.tokens(text)
    if ids is None:
        return []
    groups, at = [], [0, 0]
    done = [0, 0]
    while at[0] < len(ids[0]):
        own = ([], [])
        while True:
            side = 0 if done[0] <= done[1] and not (own[0] and done[0] == done[1]) else 1
            if own[0] and own[1] and done[0] == done[1]:
                break
            token = int(ids[side][at[side]])
            own[side].append(token)
            done[side] += len(aligner.bytes[side][token])
            at[side] += 1
        groups.append(own)
    assert at == [len(ids[0]), len(ids[1])]
    return groups


def brute(docs):
    aligner = al._aligner(al.public())
    groups = [brute_groups(aligner, t or "") for _, t in docs]
    links = [Counter((a, b) for own in g for a in own[0] for b in own[1]) for g in groups]
    held = Counter(pair for counter in links for pair in counter)
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    rows = []
    for (d, _), g, counter in zip(docs, groups, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        rows.append(
            (
                d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), counter.total(),
                sum(n for p, n in counter.items() if held[p] == most[p[0]]),
                sum(n * held[p] for p, n in counter.items()),
                hashlib.sha256(text.encode()).hexdigest() if g else "",
            )
        )
    return sorted(rows, key=str)


ODD = [
    None, "", " ", "\n\n\t x", "İstanbul ΣΑΣ 👍 naïve café 日本語のテキスト", "<|endoftext|> a <s> </s> <0x41>",
    "a▁b", "x" * 5000, "  two  blanks ", "\x00\x01 zero", "1234567890 12 345", "é" * 300, "﻿bom",
    "don't we'll I'VE", "ﬁ ligature   wide",
]


@pytest.mark.parametrize("broadcast", [500_000, 40, 0])
def test_equals_brute_force(rows, monkeypatch, broadcast):
    monkeypatch.setattr(al, "BROADCAST_PAIRS", broadcast)
    texts = sentences(8, 40) + ODD
    docs = [(i, t) for i, t in enumerate(texts * 2 + texts[:7])]
    docs += [(None, "no id"), (1, texts[0]), (1, texts[0])]
    got = al.align_tokens(rows(docs, DOCS), al.public())
    names = ["doc_id", *al.MEASURES, "groups_sha256"]
    assert sorted((tuple(r) for r in got.select(names).collect()), key=str) == brute(docs)


def test_links_in_pieces(monkeypatch):
    rolls = np.random.default_rng(1)
    aligner = al._aligner(al.public())
    a, b = rolls.integers(0, 9, 400), rolls.integers(0, 7, 500)
    in_a, in_b = (np.sort(np.append(rolls.integers(0, 12, n - 12), np.arange(12))) for n in (400, 500))
    whole = aligner.links(a, b, in_a, in_b)
    expected = Counter(
        int(x) * aligner.span + int(y) for x, g in zip(a, in_a) for y in b[in_b == g]
    )
    assert dict(zip(*map(np.ndarray.tolist, whole))) == expected
    for size in (1, 700, 1500, 2500):
        monkeypatch.setattr(al, "LINKS", size)
        parts = aligner.links(a, b, in_a, in_b)
        assert all((x == y).all() for x, y in zip(whole, parts))


def test_each_text_is_aligned_once(rows):
    docs = rows([(i, "the same text") for i in range(50)] + [(99, "another one")], DOCS)
    found = {r.copies: r for r in al.align_texts(docs, al.public()).collect()}
    assert set(found) == {50, 1}


def test_odd_tables(odd_docs, rows):
    got = al.align_tokens(odd_docs, al.public())
    assert got.count() == odd_docs.count() and len(got.columns) == 8
    assert al.align_tokens(odd_docs.limit(0), al.public()).count() == 0
    clash = rows([(1, "some words")], DOCS).selectExpr(
        "*", "1 AS id", "2 AS of", "3 AS key", "4 AS n_a", "5 AS pairs", "6 AS copies"
    )
    row = al.align_tokens(clash, al.public()).first()
    assert (row.doc_id, row.n_a, row.n_groups) == (1, 2, 2)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(
    [" ", "  ", "\n", "\t", "\r\n", "'s", "'ll", "'S", "don't", "A", "word", "É", "ʼ", "ß", "²", "½", "12", "_",
     "\n\n x", " \n", "\x7e", "ab\ncd ef", "…", "“", "€", "- ", "\xad", "¡", "´", "×", "ǅ", "ƻ", "~", "<|endoftext|>", "(", "x" * 70]
), max_size=12).map("".join))
def test_words_met_before_give_the_same_ids(text):
    aligner = al._aligner(al.public())
    whole = " " + text
    assert aligner.ids_a(whole) == aligner.encode_a(whole)
    assert aligner.bytes_of(0, aligner.encode_a(whole)) == whole.encode()


def test_words_kept_change_nothing(monkeypatch):
    monkeypatch.setattr(al, "KEPT_WORDS", 5)
    aligner = al.Aligner(al.public())
    for text in sentences(9, 30):
        assert aligner.ids_a(" " + text) == aligner.encode_a(" " + text)
        assert len(aligner.words) + len(aligner.older) < 300


def direct(aligner, text):
    """Ids of both by the libraries' own calls, None if their bytes are not the text."""
    ids = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    whole = (" " + text).encode()
    back = all(b"".join(aligner.bytes[i][x] for x in ids[i]) == whole for i in (0, 1))
    return ids if text and back else None


def listed(found):
    return [None if ids is None else tuple(side.tolist() for side in ids) for ids in found]


@pytest.mark.parametrize("kept, characters", [(400_000, 1 << 20), (50, 300), (5, 1)])
def test_texts_together_give_the_same_ids(monkeypatch, kept, characters):
    monkeypatch.setattr(al, "KEPT_WORDS", kept)
    monkeypatch.setattr(al, "CHARACTERS", characters)
    aligner = al.Aligner(al.public())
    texts = sentences(10, 60) + [t or "" for t in ODD] + ["s\nts\nve 's", "été\nÀb " + "y" * 80] * 2
    for again in range(2):
        assert listed(aligner.all_tokens(texts)) == [direct(aligner, t) for t in texts]
        assert not any(len(w) > al.KEPT_LENGTH for w in aligner.words)
    assert list(aligner.all_tokens([])) == []


def test_words_of_a_batch_are_encoded_in_one_call(monkeypatch):
    aligner = al.Aligner(al.public())
    texts = [f"Begin{'abcdefghij'[i % 10]} some\nWords{'klmnopqrst'[i // 10]} more" for i in range(60)]
    calls, encode = [], aligner.encode_a
    monkeypatch.setattr(aligner, "encode_a", lambda text: calls.append(text) or encode(text))
    assert None not in list(aligner.all_tokens(texts))
    assert len(calls) == 2  # the words of letters, and the line end


def test_words_that_do_not_come_back(tmp_path):
    """A lacks a letter: texts with it have no tokens, those beside them keep theirs."""
    paths = al.public()
    content = json.loads(Path(paths.a).read_text(encoding="utf-8"))
    model = content["model"]
    model["vocab"] = {entry: i for entry, i in model["vocab"].items() if "z" not in entry}
    model["merges"] = [m for m in model["merges"] if "z" not in "".join(m)]
    own = tmp_path / "lacking.json"
    own.write_text(json.dumps(content), encoding="utf-8")
    aligner = al.Aligner(al.Tokenizers(str(own), paths.b))
    texts = ["one two", "a zebra\nzoo two", "one\nmore", "", "日本 z", "two more"]
    got = listed(aligner.all_tokens(texts))
    assert got == [direct(aligner, t) for t in texts]
    assert [ids is None for ids in got] == [False, True, False, True, True, False]


def test_groups_written_as_text():
    aligner = al._aligner(al.public())
    for text in ["one", "don't we'll I'VE", "x" * 500, *sentences(12, 20)]:
        ids = aligner.tokens(text)
        groups = brute_groups(aligner, text)
        expected = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        assert aligner.written(*ids, *aligner.groups(*ids)) == expected.encode()
