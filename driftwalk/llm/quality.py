"""Quality by attention over passages.

Every text is cut into passages, each described by counts of what stands in it. A small
network encodes a passage; gated attention, learned from labels of whole documents,
weighs the passages; the weighted sum of their codes gives the score. Labels of
passages are not needed, and one bad part of a long text can decide.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from driftwalk.llm.base import HELPER, column, read, register, slices, text_or_empty

PASSAGE_WORDS = 64
# The model is fitted on at most this many labelled documents, those whose ids hash
# lowest. It has a few hundred weights, for which that is plenty.
FIT_DOCUMENTS = 2000
HIDDEN, ATTENTION = 16, 8
STEPS, RATE, DECAY = 200, 0.03, 1e-4
THRESHOLD = 0.3
FOLDS = 5  # documents whose id hashes to 0 modulo this are held out

_CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"abcdefghijklmnopqrstuvwxyz",
    b"0123456789",
    b".,;:",
    b"!?",
    b"\"'()-",
    b"#$%&*+=@^_~`",
    b"<>[]{}|\\/",
    bytes(range(0x80, 0x100)),
)
FEATURES = len(_CLASSES) + 8


def passages(text: str) -> np.ndarray:
    """A row of features per ``PASSAGE_WORDS`` words; one row for a text without words.

    A last passage of less than half that many words joins the one before.
    """
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    parts = max(1, (n + PASSAGE_WORDS // 2) // PASSAGE_WORDS)
    starts = [i * PASSAGE_WORDS for i in range(parts)] + [n]
    rows = np.zeros((parts, FEATURES), np.float32)
    for i in range(parts):
        some = words[starts[i] : starts[i + 1]]
        if not some:
            continue
        joined = b"".join(some)
        size, count = len(joined), len(some)
        lengths = np.fromiter(map(len, some), np.int32, count)
        distinct = len(set(some))
        rows[i, : len(_CLASSES)] = [
            (size - len(joined.translate(None, chars))) / size for chars in _CLASSES
        ]
        rows[i, len(_CLASSES) :] = (
            1.0,
            np.log1p(count),
            distinct / count,
            sum(map(operator.eq, some, some[1:])) / count,
            np.log1p(lengths.mean()),
            np.log1p(lengths.max()),
            lengths.std() / lengths.mean(),
            len(set(joined)) / size**0.5,
        )
    return rows


class Attention:
    """Gated attention over encoded passages, with its gradient."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights

    @classmethod
    def start(cls, features: np.ndarray, share: float) -> Attention:
        """Small random weights; features are scaled by what the sample shows."""
        rolls = np.random.default_rng(7)

        def small(*shape: int) -> np.ndarray:
            return rolls.normal(0, 1 / np.sqrt(shape[0]), shape)

        n = features.shape[1]
        return cls(
            {
                "mean": features.mean(axis=0),
                "spread": features.std(axis=0) + 1e-3,
                "encode": small(n, HIDDEN),
                "encode_bias": np.zeros(HIDDEN),
                "value": small(HIDDEN, ATTENTION),
                "gate": small(HIDDEN, ATTENTION),
                "attend": small(ATTENTION),
                "out": small(HIDDEN),
                "out_bias": np.full(1, np.log(share / (1 - share))),
            }
        )

    def forward(self, features: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """Scores of documents whose passages begin at ``starts``, and what led there."""
        w = self.weights
        x = (features - w["mean"]) / w["spread"]
        h = np.tanh(x @ w["encode"] + w["encode_bias"])
        v, g = np.tanh(h @ w["value"]), 1 / (1 + np.exp(-(h @ w["gate"])))
        e = (v * g) @ w["attend"]
        owner = np.repeat(np.arange(len(starts)), np.diff([*starts, len(features)]))
        a = np.exp(e - np.maximum.reduceat(e, starts)[owner])
        a /= np.add.reduceat(a, starts)[owner]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        score = 1 / (1 + np.exp(-(z @ w["out"] + w["out_bias"])))
        return {"x": x, "h": h, "v": v, "g": g, "a": a, "z": z, "owner": owner, "score": score}

    def gradient(
        self, features: np.ndarray, starts: np.ndarray, target: np.ndarray
    ) -> dict[str, np.ndarray]:
        """Gradient of the mean log loss over documents."""
        w, f = self.weights, self.forward(features, starts)
        h, v, g, a, owner = f["h"], f["v"], f["g"], f["a"], f["owner"]
        off = (f["score"] - target) / len(target)
        dz = off[:, None] * w["out"]
        dh = a[:, None] * dz[owner]
        da = (h * dz[owner]).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, starts)[owner])
        dv = de[:, None] * w["attend"] * g * (1 - v * v)
        dg = de[:, None] * w["attend"] * v * g * (1 - g)
        dh = (dh + dv @ w["value"].T + dg @ w["gate"].T) * (1 - h * h)
        return {
            "encode": f["x"].T @ dh,
            "encode_bias": dh.sum(axis=0),
            "value": h.T @ dv,
            "gate": h.T @ dg,
            "attend": (v * g).T @ de,
            "out": f["z"].T @ off,
            "out_bias": off.sum(keepdims=True),
        }

    def fit(self, features: np.ndarray, starts: np.ndarray, target: np.ndarray) -> Attention:
        """Fit in place by Adam on all given documents at once."""
        first = {k: 0.0 for k in self.weights}
        second = dict(first)
        for step in range(1, STEPS + 1):
            for k, d in self.gradient(features, starts, target).items():
                d = d + DECAY * self.weights[k] * (k != "out_bias")
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                move = (first[k] / (1 - 0.9**step)) / (
                    np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
                )
                self.weights[k] = self.weights[k] - RATE * move
        return self

    def score(self, text: str) -> float:
        return float(self.forward(passages(text), np.zeros(1, int))["score"][0])


def _features(text: Column) -> Column:
    """Packed features of a text's passages."""

    def batches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in slices(texts):
            yield pa.array((passages(t.as_py()).tobytes() for t in batch), pa.binary())

    return F.arrow_udf(batches, "binary")(text)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is never learned from. A null id is held out."""
    return F.coalesce(F.crc32(column(doc_id).cast("string")) % FOLDS == 0, F.lit(True))


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "quality",
    limit: int = FIT_DOCUMENTS,
) -> Attention | float:
    """A model of ``label`` from at most ``limit`` labelled documents not held out.

    Of repeated labels of a document the smallest counts, null labels do not. Of several
    texts of one id the one of smallest digest is taken. The
    sample's features come to the driver, their number bounded by ``limit``. Where the
    labels found are all equal the result is that share instead of a model, and 0.5
    where there are none.
    """
    chosen = (
        labels.select(column(doc_id).alias("id"), column(label).cast("int").alias("label"))
        .where(F.col("label").isNotNull() & ~held_out("id"))
        .groupBy("id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(limit)
    )
    texts = docs.select(column(doc_id).alias("id"), text_or_empty(text).alias("text"))
    rows = (
        texts.join(F.broadcast(chosen), "id")  # at most ``limit`` rows
        .groupBy("id", "label")
        .agg(F.min_by("text", F.sha2("text", 256)).alias("text"))
        .select("id", "label", _features(F.col("text")).alias("features"))
        .collect()
    )
    rows.sort(key=lambda r: (r["id"], bytes(r["features"])))
    if not rows:
        return 0.5
    target = np.array([r["label"] > 0 for r in rows], float)
    share = target.mean()
    if share in (0.0, 1.0):
        return float(share)
    parts = [np.frombuffer(r["features"], np.float32).reshape(-1, FEATURES) for r in rows]
    features = np.concatenate(parts)
    starts = np.cumsum([0, *map(len, parts[:-1])])
    return Attention.start(features, share).fit(features, starts, target)


def quality_score(model: Attention | float, text: Column) -> Column:
    """Score of a text column between 0 and 1; higher: label 1 is likelier."""
    if not isinstance(model, Attention):
        return F.lit(float(model))

    def batches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in slices(texts):
            yield pa.array((model.score(t.as_py()) for t in batch), pa.float64())

    return F.arrow_udf(batches, "double")(text)


def classify_quality(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "quality",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted`` (1 from ``threshold``).

    Scores depend on the text alone; equal texts have equal scores, whole texts are
    read, and null and empty ones are scored as one passage without words. An empty
    table stays empty.
    """
    model = fit_quality(docs, labels, text, doc_id, label)
    return docs.withColumn("score", quality_score(model, text_or_empty(text))).withColumns(
        {
            "held_out": held_out(doc_id),
            "predicted": (F.col("score") >= threshold).cast("int"),
        }
    )


def drop_low_quality(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "quality",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    model, score = fit_quality(docs, labels, text, doc_id, label), f"{HELPER}score"
    scored = docs.withColumn(score, quality_score(model, text_or_empty(text)))
    return scored.where(F.col(score) >= threshold).drop(score)


@register("op9_quality")
def op9_quality(spark, sf_dir):
    scored = classify_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")
