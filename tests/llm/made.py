"""Helpers of these tests."""

import hashlib
import random


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def sentences(seed: int, n: int, words: int = 60) -> list[str]:
    """Invented texts with copies, near copies and parts in common."""
    rolls = random.Random(seed)
    vocabulary = ["".join(rolls.choices("abcdefghij", k=rolls.randint(2, 7))) for _ in range(400)]
    texts = []
    for _ in range(n):
        if texts and rolls.random() < 0.5:
            found = rolls.choice(texts).split(" ")
            for _ in range(rolls.randint(0, 4)):
                found[rolls.randrange(len(found))] = rolls.choice(vocabulary)
            texts.append(" ".join(found))
        else:
            texts.append(" ".join(rolls.choices(vocabulary, k=rolls.randint(1, words))))
    return texts
