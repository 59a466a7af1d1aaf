"""Every stage against a brute-force version of it, each on its predecessor's rows."""

import re

import pytest

import corpus_pipeline
from driftwalk.llm import decontamination, quality
from driftwalk.staging import stage
from test_bpe import PATH, Tokenizer
from test_line_dedup import brute as lines_brute
from test_minhash import brute as near_brute

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for _, apply in corpus_pipeline.STAGES:
        docs.append(stage(apply(spark, docs[-1], FOLDER)))
    return docs


def pairs(table):
    return [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination",
        "BPE encoding and decoding",
    ]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality(spark, stages):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scored = quality.classify_quality(stages[0], labels).collect()
    assert sorted(d for d, _ in pairs(stages[1])) == sorted(r.doc_id for r in scored if r.score >= 0.3)


def test_lines(stages):
    expected = {d: t for d, _, _, t in lines_brute(pairs(stages[1]))}
    assert dict(pairs(stages[2])) == expected
    assert all(r.n_chars == len(r.text or "") for r in stages[2].collect())


def test_near_copies(stages):
    expected = [d for d, _, _, kept in near_brute(pairs(stages[2]), 5) if kept]
    assert sorted(d for d, _ in pairs(stages[3])) == expected


def test_leaks(spark, stages):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()

    def words(text):
        return re.findall(r"[^\W_]+", (text or "").lower())

    width, gone = decontamination.WINDOW, set()
    for d, text in pairs(stages[3]):
        have = words(text)
        seen = {tuple(have[j : j + width]) for j in range(len(have) - width + 1)}
        for item in items:
            w = words(item.text)
            wins = [tuple(w[j : j + width]) for j in range(len(w) - width + 1)]
            if sum(x in seen for x in wins) >= min(decontamination.MIN_WINDOWS, len(wins) / 2):
                gone.add(d)
    assert {d for d, _ in pairs(stages[3])} - {d for d, _ in pairs(stages[4])} == gone


def test_ids(stages):
    library, texts = Tokenizer.from_file(PATH), dict(pairs(stages[4]))
    got = stages[5].collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, FOLDER)
    assert sorted(got.collect()) == sorted(stages[5].collect())
