import itertools
import re
from collections import defaultdict

from driftwalk.llm import filter_audit as fa
from made import sentences

DOCS, LABELS = "doc_id long, source string, text string", "doc_id long, quality int, toxic int"


def brute(docs, labels):
    """Every document goes through every order, one filter after the other."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    parts = defaultdict(list)
    for d, part, text in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failing = set()
        if len(words) < 200:
            failing.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            failing.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
            failing.add("C")
        if re.search("[#$%&*|]", text):
            failing.add("D")
        if d is not None and any(o is not None and o < d and (t or "") == text for o, _, t in docs):
            failing.add("E")
        parts[part or ""].append((failing, d in good, d in toxic))
    rows, shapley = {}, defaultdict(int)
    for part, members in parts.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            left = members
            for step, f in enumerate(order, 1):
                out = [m for m in left if f in m[0]]
                left = [m for m in left if f not in m[0]]
                shapley[part, f] += len(out)
                rows[part, order, step] = [
                    len(left), len(out), sum(f in m[0] for m in members) - len(out),
                    sum(m[0] == {f} for m in members), sum(m[1] for m in out), sum(m[2] for m in out),
                ]
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


def tuples(table):
    names = [field.split(" ")[0] for field in fa.RESULT.split(", ")]
    got = [tuple(r) for r in table.select(names).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_equals_brute_force(rows):
    texts = sentences(5, 60, 300)
    texts += [t + " #" for t in texts[:9]] + [t.upper() for t in texts[:20:3]] + texts[:25]
    texts += ["a " * 250, " ".join(f"w{i}" for i in range(250)), "a\x0bb\x1cc", "Ä É ÀÉ", None, "", None]
    docs = [(i * 7 % 131, f"s{i % 3}" if i % 11 else None, t) for i, t in enumerate(texts)]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 131, 2)]
    got = tuples(fa.audit(fa.contingency(rows(docs, DOCS), rows(labels, LABELS))))
    assert got == brute(docs, labels)
    assert len(got) == 600 * 4


def test_odd_rows(rows):
    """Nulls, repeated rows and ids, repeated labels, and columns that clash."""
    docs = [
        (None, "a", "same"), (1, "a", "same"), (1, "a", "same"), (None, None, None), (2, "", ""),
        (2, "b", "same"), (3, "b", "same"), (0, "c", None), (4, "c", "x " * 40_000),
    ]
    labels = [(1, 1, None), (1, 0, 1), (None, 1, 1), (2, None, None), (3, 1, 1)]
    table = rows(docs, DOCS).selectExpr("*", "1 AS part", "2 AS pattern", "3 AS docs", "4 AS good", "5 AS id")
    marks = rows(labels, LABELS).selectExpr("*", "1 AS of", "2 AS good")
    assert tuples(fa.audit(fa.contingency(table, marks))) == brute(docs, labels)


def test_empty_tables(rows):
    docs, labels = rows([(1, "a", "b c")], DOCS), rows([(1, 1, 1)], LABELS)
    assert fa.audit(fa.contingency(docs.limit(0), labels)).count() == 0
    assert tuples(fa.audit(fa.contingency(docs, labels.limit(0)))) == brute([(1, "a", "b c")], [])
