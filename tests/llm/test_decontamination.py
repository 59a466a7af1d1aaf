import re

import pytest

import corpus_pipeline
from driftwalk.llm import decontamination as dec
from made import sentences

ITEM = (
    "Last week Alice gave 12 apples to Bob and then bought 30 more apples for 5 dollars at the "
    "market near Paris. How many apples does Alice have if Bob returns 12 of them tomorrow?"
)
BENCH = "item_id long, text string"
DOCS = "doc_id long, text string"


def leaks(rows, docs, items, **options):
    found = dec.find_leaks(rows(docs, DOCS), rows(items, BENCH), **options)
    return {(r.doc_id, r.item_id, r.literal) for r in found.collect()}


def other(**values):
    text = ITEM
    for before, after in values.items():
        text = re.sub(rf"\b{before.lstrip('_')}\b", after, text)
    return text


def test_copies_and_other_values(rows):
    filler = " ".join(sentences(1, 5))
    docs = [
        (1, ITEM), (2, f"{filler}\n{ITEM.upper()} {filler}"), (3, filler),
        (4, f"{filler} " + other(Alice="Carol", Bob="Dave", _12="7", _30="41", Paris="Rome")),
        # The same pattern, but values do not stand for the same ones throughout.
        (5, other(Alice="Carol", Bob="Dave", _12="7", _30="41", dollars="euros")
            .replace("Carol", "Erin", 1).replace("7", "8", 1).replace("Dave", "Fred", 1)),
        (6, ITEM.replace(",", "").replace(".", " ;").replace(" ", "\n")),
    ]
    got = leaks(rows, docs, [(1, ITEM), (2, "Nothing of this stands in any text that is given here")])
    assert got == {(1, 1, True), (2, 1, True), (4, 1, False), (6, 1, True)}


def test_shuffled_side(rows, monkeypatch):
    changed = other(Alice="Carol", Bob="Dave", _12="7", _30="41", Paris="Rome")
    docs = [(1, ITEM), (4, changed)]
    few = leaks(rows, docs, [(1, ITEM)])
    monkeypatch.setattr(dec, "BROADCAST_BYTES", 0)
    assert leaks(rows, docs, [(1, ITEM)]) == few == {(1, 1, True), (4, 1, False)}


def words(text):
    return [w.lower() for w in re.findall(r"[^\W_]+", text or "")]


def test_literal_leaks_equal_brute_force(rows):
    """Texts of lower case and no numbers, where a template is the words themselves."""
    items = list(enumerate(sentences(21, 12, 40)))
    base = sentences(22, 40, 80)
    docs = []
    for i, text in enumerate(base):
        part = items[i % 12][1].split()
        docs.append((i, " ".join([text, *part[: len(part) * (i % 5) // 4], text])))
    expected = set()
    for d, text in docs:
        have = words(text)
        for k, item in items:
            w = words(item)
            size = min(dec.WINDOW, len(w))
            wins = [tuple(w[j : j + size]) for j in range(len(w) - size + 1)]
            if len(w) < dec.WINDOW:
                hit = len(have) < dec.WINDOW and have == w
                matched = int(hit)
            else:
                seen = {tuple(have[j : j + size]) for j in range(len(have) - size + 1)}
                matched = sum(x in seen for x in wins)
            if matched and (matched >= dec.MIN_WINDOWS or matched >= len(wins) * dec.MIN_SHARE):
                expected.add((d, k, True))
    assert leaks(rows, docs, items) == expected and expected


def test_odd_rows(rows, odd_docs):
    items = [(1, None), (2, ""), (3, "???"), (None, ITEM), (4, ITEM), (4, ITEM)]
    bench = rows(items, BENCH)
    assert dec.find_leaks(odd_docs, bench).count() == 0
    with_item = odd_docs.unionByName(odd_docs.limit(1).selectExpr("*").fillna("").replace(
        {"": "x"}, subset=["n_lines"]).withColumn("text", dec.F.lit(ITEM)))
    kept = dec.drop_leaking(with_item, bench)
    assert kept.columns == odd_docs.columns
    lost = {r.doc_id for r in dec.find_leaks(with_item, bench).collect()}
    assert len(lost) == 1
    assert dec.find_leaks(odd_docs.limit(0), bench).count() == 0
    assert dec.drop_leaking(odd_docs, bench.limit(0)).count() == odd_docs.count()


def test_null_ids_go_too(rows):
    docs = rows([(None, ITEM), (1, "clean text")], DOCS)
    kept = dec.drop_leaking(docs, rows([(1, ITEM)], BENCH)).collect()
    assert [r.doc_id for r in kept] == [1]


@pytest.mark.parametrize("n", [1, 3, 7])
def test_short_items_match_whole_texts_only(rows, n):
    item = " ".join(f"word{chr(97 + i)}" for i in range(n))
    docs = [(1, item), (2, f"{item} and much more text that goes on for a long while after it")]
    assert leaks(rows, docs, [(1, item)]) == {(1, 1, True)}


def test_short_items_inside_texts(spark, rows, tmp_path):
    item = "What is the capital of Australia?"
    before, after = "We were asked a thing today.", "Nobody in the room knew it."
    docs = [(1, item), (2, f"{before} {item} {after}"), (3, f"{before} {after}"), (4, f"So: {item}")]
    items = [(1, item), (2, "mc squared")]
    assert leaks(rows, docs, items, short_inside=True) == {(1, 1, True), (2, 1, True), (4, 1, True)}
    folder = str(tmp_path)
    rows(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    rows(items, BENCH).write.parquet(f"{folder}/benchmark.parquet")
    found = dec.op2_benchmark_decontamination(spark, folder)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 1), (2, 1), (4, 1)}
    kept = corpus_pipeline.keep_uncontaminated(spark, rows(docs, DOCS), folder)
    assert [r.doc_id for r in kept.collect()] == [3]


def test_equal_quantities_may_part(rows):
    item = (
        "A shop sells 12 red pens for 3 dollars and 12 blue pens for 5 dollars. How many pens "
        "must it sell until it earns 60 dollars on a rainy day?"
    )
    changed = item.replace("12 red", "14 red").replace("12 blue", "9 blue").replace(" 3 ", " 4 ")
    short = "Tom has 12 apples and Ann has 12 pears. How many fruits do they have together?"
    parted = short.replace("12 apples", "14 apples").replace("12 pears", "9 pears")
    docs = [(1, changed.replace(" 5 ", " 7 ").replace("60", "90")), (2, parted)]
    assert leaks(rows, docs, [(1, item), (2, short)]) == {(1, 1, False), (2, 2, False)}


def test_items_dense_in_values(rows):
    item = "Tom, Ann and Bob have 3, 4 and 5 coins. Tom gives Ann 2 coins."
    changed = "Mia, Eve and Joe have 6, 7 and 8 coins. Mia gives Eve 9 coins."
    docs = [(1, f"it was asked of us {changed}"), (2, "we have 3 and 4 coins and gives them 2 of 5")]
    assert leaks(rows, docs, [(1, item)]) == {(1, 1, False)}


def test_values_of_other_lengths(rows):
    item = "Tom has 12 apples and gives 5 to Ann. How many apples are left with Tom?"
    place = "He moved to Paris for a while and then came back to work in the old bakery."
    docs = [
        (1, item.replace("12", "1,400").replace("5", "6.5")),
        (2, item.replace("12", "14").replace("5", "-6").replace("Tom", "Mary Jane Smith")),
        (3, "We say: " + place.replace("Paris", "New York")),
        (4, "Tom has apples, and gives many to Ann. How are you with Tom?"),
    ]
    got = leaks(rows, docs, [(1, item), (2, place)])
    assert {(1, 1, False), (2, 1, False)} <= got and {d for d, _, _ in got} == {1, 2, 3}


def test_whole_values(rows):
    text = "At -1,400.5 km, New York's 3rd O'Neil Street: 3,4 or 1-2 iPhone x2.5é ÉCOLE d'Été"
    got = rows([(text,)], "text string").select(dec.values_of(dec.F.col("text"))).first()[0]
    assert got == [
        "At", "-1,400.5", "km", "New York", "s", "3rd", "O'Neil Street", "3", "4", "or", "1", "2",
        "iPhone", "x2", "5é", "ÉCOLE", "d", "Été",
    ]


def test_values_stand_for_each_other_one_to_one(rows):
    item = (
        "When Alice met Bob and Carol met Dave near the old mill, Alice gave Bob some bread while "
        "Carol gave Dave some milk, so who of Alice or Carol has more left than Dave or Bob in the end?"
    )
    one_for_all = re.sub("Alice|Bob|Carol|Dave", "Erin", item)
    others = item.replace("Alice", "Gina").replace("Bob", "Hugo").replace("Carol", "Ivy")
    docs = [(1, one_for_all), (2, others.replace("Dave", "Jack"))]
    assert leaks(rows, docs, [(1, item)]) == {(2, 1, False)}
    assert leaks(rows, docs, [(1, item)], max_conflicts=9) == {(1, 1, False), (2, 1, False)}


def test_names_of_any_length(rows):
    item = "He moved to Paris for a while and then came back to work in the old bakery."
    name = " ".join(f"Name{chr(97 + i)}" for i in range(11))
    got = rows([(item.replace("Paris", name),)], "text string")
    assert name in got.select(dec.values_of(dec.F.col("text"))).first()[0]
    docs = [(1, item.replace("Paris", name))]
    texts = rows([(1, docs[0][1])], 'key long, text string')
    whole = dec._occurrences(texts, 8).where('valued').count()
    assert whole == len(item.split()) - 7


def test_very_long_texts(rows):
    """Windows over the cuts between pieces, in a text of 200,000 words."""
    filler = [f"w{i % 977}x" for i in range(200_000)]
    item = " ".join(f"item{chr(97 + i)}" for i in range(13))
    docs = []
    for d, at in enumerate([0, dec.PIECE - 4, dec.PIECE * 7 - 12, dec.PIECE * 20, 199_987]):
        docs.append((d, " ".join([*filler[:at], *item.split(), *filler[at + 13 :]])))
    docs.append((9, " ".join(filler)))
    short = "itemd iteme itemf"
    got = leaks(rows, docs, [(1, item), (2, short)], short_inside=True)
    assert got == {(d, i, True) for d in range(5) for i in (1, 2)}


def test_sql_has_the_same_rules(spark, rows, tmp_path):
    """Short items inside texts, whole values, conflicts and shares, held against the SQL."""
    import duckdb

    swap = other(Alice="Carol", Bob="Dave", _12="1,407", _30="-4.5", Paris="New York City")
    items = [
        (1, ITEM), (2, "What is the capital of Australia?"), (3, "mc squared"),
        (4, "Tom, Ann and Bob have 3, 4 and 5 coins. Tom gives Ann 2 coins."),
        (5, "Tom has 12 apples and Ann has 12 pears. How many fruits do they have together?"),
        (6, " ".join(sentences(3, 1, 40))), (7, None),
    ]
    docs = [
        (1, ITEM), (2, swap), (3, f"we ask: what is the capital of australia? it is e=mc squared. {swap}"),
        (4, "Mia, Eve and Joe have 6, 7 and 8 coins. Mia gives Eve 9 coins."),
        (5, "Tom has 14 apples and Ann has 9 pears. How many fruits do they have together?"),
        (6, "Tom has 1,234,567 apples and Mary-Jane O'Neil has 3-4 pears. How many fruits do they have together?"),
        (7, re.sub("Alice|Bob|Paris", "Erin", ITEM)), (8, None), (9, ""),
        *((20 + i, t) for i, t in enumerate(sentences(3, 30, 40))),
    ]
    folder = str(tmp_path)
    rows(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    rows(items, BENCH).write.parquet(f"{folder}/benchmark.parquet")
    base = duckdb.connect()
    for table in ("documents", "benchmark"):
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    names = ["doc_id", "item_id", "matched", "windows", "literal"]
    sql = base.execute(f"SELECT {', '.join(names)} FROM ({dec.ORACLES['op2_benchmark_decontamination']})").fetchall()
    ours = dec.op2_benchmark_decontamination(spark, folder).select(names).collect()
    assert sorted(map(tuple, ours)) == sorted(sql)
    assert {1, 2, 3, 4, 5} <= {r.doc_id for r in ours}
