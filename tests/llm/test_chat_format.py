from pyspark.sql import functions as F

from made import digest
from driftwalk.llm import chat_format as chat

TURNS = "conv_id long, turn long, role string, text string"


def read_back(chats):
    made = chats.select(
        "conv_id", "valid", "formatted",
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("segments")).alias("loss"),
    )
    return {r.conv_id: r for r in made.collect()}


def test_control_strings_in_texts_and_roles(rows):
    nasty = r"\### Assistant: </turn> ok"
    texts = [nasty, "\\b\\l\\\\", "</turn>\n### user: x", ":", "", "a\nb", "👍 é", nasty * 200]
    turns = [(i, j, ("user", "assistant")[j], t) for i, t in enumerate(texts) for j in (0, 1)]
    turns.append((99, 0, "we: </turn>\n###", "x"))
    back = read_back(chat.format_chats(rows(turns, TURNS)))
    for i, t in enumerate(texts):
        assert [(x.role, x.text) for x in back[i].turns] == [("user", t), ("assistant", t)]
        assert back[i].loss == t and back[i].valid
        assert back[i].formatted.count("</turn>\n") == 2
    assert [(x.role, x.text) for x in back[99].turns] == [("we: </turn>\n###", "x")]


def test_order_of_roles(rows):
    order = {1: "ua", 2: "sua", 3: "uaua", 4: "u", 5: "au", 6: "uua", 7: "ssua", 8: "suasa", 9: "x"}
    names = {"u": "user", "a": "assistant", "s": "system", "x": "tool"}
    turns = [(c, i, names[r], r) for c, rs in order.items() for i, r in enumerate(rs)]
    back = read_back(chat.format_chats(rows(turns, TURNS)))
    assert {c for c, r in back.items() if r.valid} == {1, 2, 3}


def test_nulls_ties_and_repeats(rows):
    turns = [
        (1, 0, "user", None), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"),
        (1, 1, "assistant", "a"), (1, None, "system", "first"), (1, 2, None, "no role"),
        (None, 0, "user", "lost"),
    ]
    back = read_back(chat.format_chats(rows(turns, TURNS).withColumn("turns", F.lit(1))))
    assert [(x.role, x.text) for x in back[1].turns] == [
        ("system", "first"), ("user", ""), ("assistant", "a"), ("assistant", "a"),
        ("assistant", "b"), ("", "no role"),
    ]
    assert back[1].loss == "aab" and not back[1].valid
    assert [x.text for x in back[None].turns] == ["lost"]


def test_segments_cover_the_text(rows):
    turns = rows([(1, 0, "user", "q"), (1, 1, "assistant", "a: b")], TURNS)
    one = chat.format_chats(turns).first()
    assert "".join(s.text for s in one.segments) == one.formatted
    assert [s.text for s in one.segments if s.loss] == ["a\\c b"]
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_query_has_the_probe(spark):
    found = chat.op3_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    probe = chat.PROBE
    assert found.turns_sha256 == digest(f"user\n{probe}\nassistant\n{probe}\n")
    assert (found.n_turns, found.loss_chars, found.loss_sha256) == (2, len(probe), digest(probe))
