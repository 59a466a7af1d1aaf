import random

import numpy as np
from tokenizers import Tokenizer

from driftwalk.llm import bpe

PATH = bpe.vocabulary("word_bpe_49k.json")


def check(texts):
    library, ours, tokens = Tokenizer.from_file(PATH), bpe.BytePairs(PATH), bpe.Tokens(PATH)
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        packed = ours.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == ids, ascii(text)
        assert tokens.decode(packed) == library.decode(ids, skip_special_tokens=False)


def test_every_low_code_point():
    check(f"ab{chr(c)}x1' 's{chr(c) * 2}" for c in range(0x3400))


def test_random_texts():
    rolls = random.Random(5)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    pieces = "'s 're <|endoftext|> <|startoftext|> Σ İ ing É é é ﬁ \x1c \x85 \xa0".split(" ")
    texts = [
        "".join(
            rolls.choice(
                [chr(rolls.choice(points)), chr(rolls.randrange(128)), " ", "the", rolls.choice(pieces)]
            )
            for _ in range(rolls.randrange(12))
        )
        for _ in range(3000)
    ]
    check(texts)


def test_long_words_and_forced_cuts():
    check(["a" * 3000, "!" * 5000, "don't" * 500, "ß" * 2000, "qzxj" * 700, "", "  \n"])
    ours = bpe.BytePairs(PATH)
    assert len(ours.fragments("qzxjqqvv")) > 1
    assert "".join(ours.fragments("qzxjqqvv")) == "qzxjqqvv"


def test_kept_words_start_anew(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    check(["one two three four five six one two three"])


def test_table(odd_docs):
    made = bpe.decode_ids(bpe.encode_texts(odd_docs, PATH), PATH)
    library = Tokenizer.from_file(PATH)
    assert made.count() == odd_docs.count()
    for row in made.collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        assert np.frombuffer(row.ids, "<u4").tolist() == ids and row.n_tokens == len(ids)
        assert row.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode_texts(odd_docs.limit(0), PATH).count() == 0
