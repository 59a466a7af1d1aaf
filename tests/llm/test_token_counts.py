import public_tokenizers
import pytest

from driftwalk.llm import token_counts as tc
from driftwalk.llm.bpe import vocabulary
from made import sentences

PATH, PATTERN = vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def unigrams():
    return tc.Unigrams(PATH, PATTERN)


def brute(unigrams, word: bytes) -> int:
    """Best path over all cuts, word by word, from scores of whole prefixes."""
    best = {0: (0.0, 0)}
    for end in range(1, len(word) + 1):
        paths = [
            (best[s][0] + unigrams.scores[word[s:end]], best[s][1] - 1)
            for s in range(end)
            if word[s:end] in unigrams.scores
        ]
        best[end] = max(paths)
    return -best[len(word)][1]


def test_counts_equal_brute_force(unigrams):
    texts = sentences(8, 40) + ["Naïve café 👍👍 \x00\x01", "a" * 300, " " * 200 + "x", "don't 'll 12345", ""]
    for text, (tokens, words) in zip(texts, unigrams.count_texts(texts)):
        split = unigrams.pattern.findall(text)
        assert words == len(split) and "".join(split) == text
        assert tokens == sum(brute(unigrams, w.encode()) for w in split)


def test_shared_prefixes_are_scored_once(unigrams, monkeypatch):
    steps = []
    extend = tc.Unigrams._extend
    monkeypatch.setattr(
        tc.Unigrams, "_extend", lambda s, w, b: (steps.append(len(w) + 1 - len(b)), extend(s, w, b))[1]
    )
    unigrams.count_words(["walking", "walker", "walk", "walked"])
    assert sum(steps) == len("walk" "ed" "r" "ing")


def test_kept_words_stay_bounded(unigrams, monkeypatch):
    monkeypatch.setattr(tc, "KEPT_WORDS", 5)
    texts = sentences(9, 20)
    one_by_one = [unigrams.count_texts([t])[0] for t in texts]
    assert one_by_one == unigrams.count_texts(texts) and len(unigrams.kept) <= 5


def test_table(unigrams, odd_docs):
    made = tc.count_tokens(odd_docs, PATH, PATTERN)
    assert made.count() == odd_docs.count()
    for row in made.collect():
        (expected,) = unigrams.count_texts([row.text or ""])
        assert (row.n_tokens, row.n_pretokens) == expected
        assert row.n_bytes == len((row.text or "").encode())
    assert tc.count_tokens(odd_docs.limit(0), PATH, PATTERN).count() == 0
