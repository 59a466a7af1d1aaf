import math
import random

import pytest

from driftwalk.llm import nearest

TABLE = "vec_id long, embedding array<double>"


def brute(vectors, k):
    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cosine(a, b):
        dot = lambda x, y: sum(p * q for p, q in zip(x, y))
        return dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b)))

    items = {i: v for i, v in vectors if i is not None and usable(v)}
    out = []
    for q, v in items.items():
        if q % 50 == 0:
            scored = [(-cosine(v, w), i) for i, w in items.items() if i != q and len(w) == len(v)]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def found(table, k):
    got = nearest.nearest_neighbours(table, table.where("vec_id % 50 = 0"), k).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)


def vectors(seed, n, dim=9):
    rolls = random.Random(seed)
    out = []
    for i in range(n):
        if out and rolls.random() < 0.4:
            out.append((i, list(rolls.choice(out)[1])))
        else:
            out.append((i, [rolls.gauss(0, 1) for _ in range(dim)]))
    return out


def same(got, expected):
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    assert [g[3] for g in got] == pytest.approx([e[3] for e in expected], abs=1e-14)


@pytest.mark.parametrize("blocks", [(1024, 4096), (3, 20)])
def test_equals_brute_force(rows, monkeypatch, blocks):
    monkeypatch.setattr(nearest, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(nearest, "CANDIDATE_BLOCK", blocks[1])
    made = vectors(1, 400)
    same(found(rows(made, TABLE), 5), brute(made, 5))


def test_odd_vectors(rows):
    made = [
        (0, [1.0, 2.0]), (1, [2.0, 4.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]),
        (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [1.0, 2.0, 3.0]),
        (None, [1.0, 2.0]), (50, [3.0, 2.0, 1.0]), (9, [-1.0, -2.0]), (100, [1e-200, 1e-200]),
        (10, [1e200, 1e200]),
    ]
    table = rows(made, TABLE)
    expected = brute([(i, [x * 1e200 for x in v] if i == 100 else
                       [x / 1e200 for x in v] if i == 10 else v) for i, v in made], 5)
    same(found(table, 5), expected)
    same(found(table.unionAll(table), 5), expected)
    assert found(table.limit(0), 5) == []


def test_group_of_equal_vectors(rows):
    made = [(i, [1.0, 0.5, 0.25]) for i in range(300)] + [(300 + i, [1.0, float(i), 0.0]) for i in range(20)]
    same(found(rows(made, TABLE), 5), brute(made, 5))
