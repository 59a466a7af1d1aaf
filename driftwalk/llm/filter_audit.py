"""How quality filters overlap: what each removes in any order of them.

A document fails or passes each of five filters, so a part of the corpus is a table of
2 x 2 x 2 x 2 x 2 counts. These are all that the corpus is needed for. What a filter
removes at a place in an order of filters is a contraction of that tensor: pass along
the axes of earlier filters, fail along its own, all along the axes of later ones.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from driftwalk.llm.base import UPPER, column, read, register, sha256, text_or_empty
from driftwalk.staging import stage

FILTERS = "ABCDE"
SIGNS = "#$%&*|"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 200, 50, 2  # the last two in percent
MEASURES = ("docs", "good", "toxic")
# Parts contracted at once.
PARTS = 64

RESULT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def fails(text: Column) -> Column:
    """The filters A to D that a text fails, as bits 1, 2, 4 and 8 of a number."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    upper = F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))

    def bits(words: Column) -> Column:
        n = F.size(words)
        tests = (
            n < MIN_WORDS,
            F.size(F.array_distinct(words)) * 100 < n * MIN_DISTINCT,
            upper * 100 > F.char_length(text) * MAX_UPPER,
            F.char_length(F.translate(text, SIGNS, "")) < F.char_length(text),
        )
        return sum((t.cast("int") * 2**i for i, t in enumerate(tests)), F.lit(0))

    # The words are the one element of an array, so that they are made once.
    return F.transform(F.array(words), bits)[0]


def contingency(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    part: str = "source",
    quality: str = "quality",
    toxic: str = "toxic",
) -> DataFrame:
    """(part, pattern, docs, good, toxic): rows of each part by the filters they fail.

    Bit i of ``pattern`` stands for the i-th filter. E is failed by rows whose text a
    smaller id has too, anywhere in the table. Texts are compared by their SHA-256;
    equal texts fail the same of A to D, so rows are counted per text and part before
    the smallest id of a text is looked for, and no group of copies meets in a task.

    Null texts are empty ones, null parts the part ''. A null id is neither smaller nor
    larger than another: its row passes E and makes no other fail. Rows of equal id and
    text are copies of which none is smaller. An id counts as good or toxic if any of
    its label rows says 1. Empty tables give an empty table.
    """
    marked = labels.groupBy(column(doc_id).alias("of")).agg(
        F.max(F.when(column(quality) == 1, 1)).alias("good"),
        F.max(F.when(column(toxic) == 1, 1)).alias("toxic"),
    )
    rows = docs.select(
        column(doc_id).alias("id"),
        F.coalesce(column(part).cast("string"), F.lit("")).alias("part"),
        text_or_empty(text).alias("text"),
    ).select("id", "part", F.unhex(sha256("text")).alias("digest"), fails(F.col("text")).alias("bits"))
    rows = rows.join(marked, F.col("id") == F.col("of"), "left").drop("of")

    def total(measure: str) -> Column:
        return F.sum(F.coalesce(F.col(measure), F.lit(0)).cast("long"))

    per_id = rows.groupBy("digest", "part", "bits", "id").agg(
        F.count("*").alias("docs"), total("good").alias("good"), total("toxic").alias("toxic")
    )
    # Counts of a null id never fail E, so they stay with the first of the text.
    lone = [F.sum(F.when(F.col("id").isNull(), F.col(m))).alias(f"{m}_lone") for m in MEASURES]
    per_text = per_id.groupBy("digest", "part", "bits").agg(
        *(F.sum(m).alias(m) for m in MEASURES),
        *lone,
        F.min("id").alias("least"),
        F.min_by(F.struct(*MEASURES), "id").alias("first"),
    )
    # A text has a row per part by now. Written once, or every text would be cut twice.
    per_text = stage(per_text, "texts")
    firsts = per_text.groupBy("digest").agg(F.min("least").alias("smallest"))
    firsts = firsts.withColumnRenamed("digest", "of")
    found = per_text.join(firsts, F.col("digest") == F.col("of"))
    leads = F.col("least") == F.col("smallest")
    passing = {
        m: F.coalesce(F.col(f"{m}_lone"), F.lit(0)) + F.when(leads, F.col(f"first.{m}")).otherwise(0)
        for m in MEASURES
    }
    last = 2 ** (len(FILTERS) - 1)
    cells = F.array(
        F.struct(F.col("bits").alias("pattern"), *(v.alias(m) for m, v in passing.items())),
        F.struct(
            (F.col("bits") + last).alias("pattern"),
            *((F.col(m) - v).alias(m) for m, v in passing.items()),
        ),
    )
    return (
        found.select("part", F.inline(cells))
        .groupBy("part", "pattern")
        .agg(*(F.sum(m).alias(m) for m in MEASURES))
        .where(F.col("docs") > 0)
    )


def _selectors(orders: list[str]) -> dict[str, np.ndarray]:
    """Per kind of count and step of an order, pass, fail or all along each axis."""
    passes, fails_, all_ = (1, 0), (0, 1), (1, 1)
    made: dict[str, list] = {"kept": [], "removed": [], "failed": [], "unique_fails": []}
    for order in orders:
        for step, own in enumerate(order):
            before, after = order[:step], order[step + 1 :]
            made["kept"].append([all_ if f in after else passes for f in FILTERS])
            made["removed"].append(
                [fails_ if f == own else passes if f in before else all_ for f in FILTERS]
            )
            made["failed"].append([fails_ if f == own else all_ for f in FILTERS])
            made["unique_fails"].append([fails_ if f == own else passes for f in FILTERS])
    return {kind: np.array(rows, dtype=np.int64) for kind, rows in made.items()}


def contract(tensors: np.ndarray, orders: list[str]) -> dict[str, np.ndarray]:
    """Counts of every step of every order, from (part, measure, 2, 2, 2, 2, 2) counts."""
    selectors = _selectors(orders)

    def pick(measure: int, kind: str) -> np.ndarray:
        axes = [selectors[kind][:, i] for i in range(len(FILTERS))]
        return np.einsum("pabcde,sa,sb,sc,sd,se->ps", tensors[:, measure], *axes, optimize=True)

    counts = {kind: pick(0, kind) for kind in ("kept", "removed", "unique_fails")}
    counts["redundant"] = pick(0, "failed") - counts["removed"]
    counts["good_lost"], counts["toxic_lost"] = pick(1, "removed"), pick(2, "removed")
    own = np.array([FILTERS.index(f) for order in orders for f in order])
    sums = np.stack([counts["removed"][:, own == f].sum(1) for f in range(len(FILTERS))], 1)
    counts["shapley"] = sums[:, own]
    return counts


def audit(cells: DataFrame) -> DataFrame:
    """Every step of every order of the filters, per part of a ``contingency`` table.

    ``kept`` are left after the step, ``removed`` go in it, ``redundant`` fail its filter
    but were removed earlier, ``unique_fails`` fail no other filter; ``good_lost`` and
    ``toxic_lost`` are those of the removed; ``shapley`` sums what the filter removes
    over all orders. An empty table gives an empty table.
    """
    orders = ["".join(order) for order in itertools.permutations(FILTERS)]
    size = 2 ** len(FILTERS)
    # A cell has a row, so a part has at most 32 entries.
    rows = cells.groupBy("part").agg(F.collect_list(F.struct("pattern", *MEASURES)).alias("cells"))

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PARTS):
                piece = batch.slice(start, PARTS).to_pylist()
                tensors = np.zeros((len(piece), len(MEASURES), size), dtype=np.int64)
                for at, row in enumerate(piece):
                    for cell in row["cells"]:
                        tensors[at, :, cell["pattern"]] = [cell[m] for m in MEASURES]
                # The lowest bit is the first filter, so axes come in reverse order.
                shaped = tensors.reshape(-1, len(MEASURES), *(2,) * len(FILTERS))
                counts = contract(shaped.transpose(0, 1, *range(len(FILTERS) + 1, 1, -1)), orders)
                n, places = len(piece), len(orders) * len(FILTERS)
                columns = {
                    "part": np.repeat([row["part"] for row in piece], places),
                    "filter_order": np.tile(np.repeat(orders, len(FILTERS)), n),
                    "step": np.tile(np.arange(places, dtype=np.int32) % len(FILTERS) + 1, n),
                    **{kind: values.reshape(-1) for kind, values in counts.items()},
                }
                names = [field.split(" ")[0] for field in RESULT.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(columns[c]) for c in names], names)

    return rows.mapInArrow(steps, RESULT)


@register(
    "op13_filter_audit",
    rf"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
),
words AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS again FROM texts
),
marked AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
),
cells AS (
  SELECT part, concat(CASE WHEN len(words) < {MIN_WORDS} THEN 'A' END,
                      CASE WHEN 100 * len(list_distinct(words)) < {MIN_DISTINCT} * len(words) THEN 'B' END,
                      CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MAX_UPPER} * length(text) THEN 'C' END,
                      CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
                      CASE WHEN again THEN 'E' END) AS fails,
         count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM words LEFT JOIN marked USING (doc_id) GROUP BY ALL
),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letters a JOIN letters b ON b.f <> a.f JOIN letters c ON c.f NOT IN (a.f, b.f)
  JOIN letters d ON d.f NOT IN (a.f, b.f, c.f) JOIN letters e ON e.f NOT IN (a.f, b.f, c.f, d.f)
),
placed AS (
  SELECT cells.*, filter_order, coalesce(list_min([instr(filter_order, f) FOR f IN string_split(fails, '') IF f <> '']), 9) AS first
  FROM cells CROSS JOIN orders
),
steps AS (
  SELECT part, filter_order, step, filter_order[step] AS own,
         sum(CASE WHEN first > step THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN first = step THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN first < step AND contains(fails, filter_order[step]) THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = filter_order[step] THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN first = step THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN first = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM placed CROSS JOIN (SELECT unnest(range(1, 6)) AS step) GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM steps
""",
)
def op13_filter_audit(spark, sf_dir):
    return audit(contingency(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))
