import random
from collections import defaultdict

from driftwalk.llm import line_dedup

WHITE = " \t\n\x0b\x0c\r"


def brute(docs, min_chars=10, min_docs=2):
    lowered = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)
    split = [(d, (t or "").split("\n")) for d, t in docs]
    held = defaultdict(set)
    for d, lines in split:
        for line in lines:
            held[line.strip(WHITE).translate(lowered)].add(d)
    out = []
    for d, lines in split:
        kept = []
        for line in lines:
            key = line.strip(WHITE).translate(lowered)
            ids = held[key]
            first = min((i for i in ids if i is not None), default=None)
            if len(key) < min_chars or len(ids) < min_docs or d == first:
                kept.append(line)
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def found(docs, **options):
    kept = line_dedup.dedup_lines(docs, **options).collect()
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in kept), key=repr)


def test_equals_brute_force(rows):
    rolls = random.Random(3)
    pool = [f"line number {i}" for i in range(30)] + ["short", "", " Line Number 3 ", "É" * 10]
    docs = [(i, "\n".join(rolls.choices(pool, k=rolls.randint(0, 12)))) for i in range(60)]
    table = rows(docs, "doc_id long, text string")
    assert found(table) == brute(docs)
    assert found(table, min_docs=5) == brute(docs, min_docs=5)


def test_odd_rows(odd_docs):
    given = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert found(odd_docs) == brute(given)
    kept = line_dedup.dedup_lines(odd_docs)
    assert set(kept.columns) == {*odd_docs.columns, "n_dropped"}
    assert {r.gone for r in kept.collect()} == {1}


def test_every_line_dropped_and_empty_table(rows):
    same = rows([(1, "a line to drop"), (2, "A LINE TO DROP")], "doc_id long, text string")
    assert found(same) == [(1, 1, 0, "a line to drop"), (2, 1, 1, "")]
    assert found(same.limit(0)) == []


def test_many_dropped_lines_of_one_text(rows):
    text = "\n".join(f"numbered line {i}" for i in range(5000))
    both = rows([(1, text), (2, text + "\nlast one stays")], "doc_id long, text string")
    assert found(both)[1][1:] == (5001, 5000, "last one stays")
