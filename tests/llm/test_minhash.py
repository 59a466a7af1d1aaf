import random
from itertools import combinations

import numpy as np
import pytest

from driftwalk.llm import minhash
from driftwalk.llm.components import connected_components
from made import sentences


def classes(nodes, links):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def shingle_set(text, k):
    lowered = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for white in "\t\n\x0b\x0c\r":
        text = text.replace(white, " ")
    words = [w for w in text.translate(lowered).split(" ") if w]
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(docs, k, percent=80):
    sets = {d: shingle_set(t or "", k) for d, t in docs}
    links = [
        (a, b)
        for a, b in combinations(sets, 2)
        if sets[a] and sets[b]
        and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    found = classes(sets, links)
    return sorted((d, len(s), found[d], found[d] == d) for d, s in sets.items())


def found(docs, **options):
    made = minhash.near_duplicates(docs, **options).collect()
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in made)


@pytest.mark.parametrize("k", [4, 5])
def test_equals_brute_force(rows, k):
    docs = list(enumerate(sentences(11, 250)))
    assert found(rows(docs, "doc_id long, text string"), words=k) == brute(docs, k)


def test_group_without_a_centre(rows):
    """Copies of one text that are like their neighbours only."""
    rolls = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(40):
        docs.append((i, " ".join(words)))
        words[rolls.randrange(200)] = f"x{i}"
    table = rows(docs, "doc_id long, text string")
    assert found(table, words=4) == brute(docs, 4)


def test_odd_rows(odd_docs):
    made = minhash.near_duplicates(odd_docs)
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in made.collect()}
    assert made.count() == odd_docs.count()
    assert (3, 0, 3, True) in got and (4, 0, 4, True) in got and (5, 0, 5, True) in got
    assert (None, 0, None, True) in got and (6, 977, 6, True) in got
    kept = minhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert minhash.near_duplicates(odd_docs.limit(0)).count() == 0


def test_copies_and_null_ids(rows):
    text = "one two three four five six seven eight"
    docs = [(None, text), (9, text.upper()), (4, f"  {text}\n"), (5, "few words"), (6, "FEW words")]
    table = rows(docs, "doc_id long, text string")
    assert {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(table).collect()} == {
        (None, 4, False), (9, 4, False), (4, 4, True), (5, 5, True), (6, 5, False),
    }
    assert {r.doc_id for r in minhash.drop_near_duplicates(table).collect()} == {4, 5}


def test_bands_meet_as_often_as_said():
    rolls = np.random.default_rng(1)
    count, met = 2 * minhash.COLLECTIONS * minhash.BAND, 0
    for _ in range(400):
        base = rolls.integers(0, 2**63, 900).astype(np.uint64)
        one, other = np.unique(base[:800]), np.unique(np.append(base[100:800], base[800:]))
        a = minhash.bands(minhash.min_hashes(one, count))
        b = minhash.bands(minhash.min_hashes(other, count))
        same = a == b
        met += same[: minhash.COLLECTIONS].any() and same[minhash.COLLECTIONS :].any()
    assert met >= 398  # similarity 7 / 9


def test_components(rows):
    rolls = random.Random(4)
    links = [(rolls.randrange(150), rolls.randrange(150)) for _ in range(110)]
    links += [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)] + [(2000, 2000 + i) for i in range(50)]
    nodes = {n for a, b in links if a != b for n in (a, b)}
    got = connected_components(rows(links, "u long, v long")).collect()
    assert {r.node: r.root for r in got} == classes(nodes, [x for x in links if x[0] != x[1]])
    assert len(got) == len(nodes)
    assert connected_components(rows(links, "u long, v long").limit(0)).count() == 0


def test_common_passage_and_copies(rows):
    """Texts that share a passage meet in its bands without being links; copies are."""
    rolls = random.Random(8)
    passage, docs = [f"p{i}" for i in range(60)], []
    for i in range(120):
        words = passage + [f"w{rolls.randrange(5000)}" for _ in range(rolls.choice([20, 60, 140]))]
        docs.append((i, " ".join(words)))
        if i % 3 == 0:
            words[rolls.randrange(len(words))] = "changed"
            docs.append((1000 + i, " ".join(words)))
    assert found(rows(docs, "doc_id long, text string"), words=4) == brute(docs, 4)


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_differences_allowed_keep_links(percent):
    """Pairs of just the wanted similarity look alike by the kept bits of their values."""
    rolls = np.random.default_rng(percent)
    count, lost, far = 2 * minhash.COLLECTIONS * minhash.BAND, 0, 0

    def differ(one, other):
        a, b = (minhash.planes(minhash.min_hashes(np.unique(s), count)) for s in (one, other))
        apart = np.bitwise_or.reduce((a ^ b).reshape(minhash.BITS, -1))
        return int(np.unpackbits(apart.view(np.uint8)).sum())

    allowed = minhash.allowed_differences(percent)
    for _ in range(300):
        base = rolls.integers(0, 2**63, 1000).astype(np.uint64)
        alone = (1000 - 10 * percent) // 2
        lost += differ(base[: 1000 - alone], base[alone:]) > allowed
        far += differ(base[:600], base[500:]) > allowed  # similarity 0.1
    assert lost <= 1 and far >= 299


def test_parities_keep_links(rows):
    """Sets at the limit stay, of one length of parity or of two; those well below do not."""
    rolls = np.random.default_rng(5)
    made, linked, far = [], [], []
    for n in (5, 127, 128, 240, 256, 280, 300, 1100, 3000):
        for share in (0.6, 0.79, 0.8, 0.81, 1):
            base = rolls.integers(0, 2**63, 3 * n).astype(np.uint64)
            for size in (n, int(n * 0.9), int(n * 0.81)):
                one = base[:n]
                common = min(size, round(share * (n + size) / (1 + share)))
                other = np.concatenate([base[:common], base[n : n + size - common]])
                pair = [minhash.parity(x).view(np.int64).tolist() for x in (one, other)]
                made.append((len(made), *pair, n, size))
                linked.append(100 * common >= 80 * (n + size - common))
                far.append(100 * common < 65 * (n + size - common))
    table = rows(made, "id int, a array<long>, b array<long>, n long, m long")
    stay = {r.id for r in table.where(minhash._differ_little("a", "b", "n", "m", 80)).collect()}
    assert all(i in stay for i, link in enumerate(linked) if link)
    assert sum(far) > 20 and not any(i in stay for i, apart in enumerate(far) if apart)


def test_near_copies_below_the_limit_form_few_pairs(rows):
    """Copies of one text that are all a little too different to be linked."""
    rolls, docs = random.Random(6), []
    words = [f"w{i}" for i in range(150)]
    for i in range(200):
        places = set(rolls.sample(range(150), 4))
        changed = [f"x{i}-{j}" if j in places else w for j, w in enumerate(words)]
        docs.append((i, " ".join(changed)))
    table = rows(docs, "doc_id long, text string")
    nodes = table.select(
        minhash.F.col("doc_id").alias("nid"),
        minhash._text_key("text").alias("text_key"),
        minhash.sketch(minhash.F.col("text"), 4).alias("sketch"),
    ).select("nid", "text_key", "sketch.*")
    roots = rows([], "node long, root long")
    pairs = minhash._pairs_between(minhash._candidates(nodes), roots, 80).collect()
    sets = {d: shingle_set(t, 4) for d, t in docs}
    links = {
        (a, b) for a, b in combinations(sets, 2)
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    }
    assert links <= {(r.u, r.v) for r in pairs}
    assert len(pairs) <= len(links) + 200
