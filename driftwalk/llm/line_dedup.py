"""Lines that several documents share are kept in one of them only.

Every text is split into lines and each line gets a normalised key. Keys found in
at least ``min_docs`` documents lose their lines everywhere but in the document
with the smallest id. Shuffled are hashes and positions of lines; a text moves
once, to meet the positions that go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from driftwalk.llm.base import (
    HELPER,
    LOWER,
    UPPER,
    WHITE,
    column,
    read,
    register,
    sha256,
    text_or_empty,
)
from driftwalk.staging import stage

MIN_CHARS, MIN_DOCS = 10, 2


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lowered."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def _row_key(doc_id: str, text: str) -> Column:
    """16 bytes equal for rows of equal id and text, whose lines share their fate."""
    owner = F.when(column(doc_id).isNull(), F.lit("-")).otherwise(
        F.concat(F.lit("="), column(doc_id).cast("string"))
    )
    return F.unhex(F.md5(F.concat(owner, F.lit("\n"), text_or_empty(text))))


def keyed_lines(docs: DataFrame, text: str, doc_id: str, min_chars: int) -> DataFrame:
    """One row per line whose key has at least ``min_chars`` code points."""
    lines = docs.select(
        column(doc_id).alias("owner"),
        _row_key(doc_id, text).alias("row_key"),
        F.posexplode(F.split(text_or_empty(text), "\n")).alias("pos", "line"),
    )
    keys = lines.select("owner", "row_key", "pos", line_key(F.col("line")).alias("key"))
    return keys.where(F.char_length("key") >= min_chars).select(
        "owner", "row_key", "pos", F.unhex(F.md5("key")).alias("hash")
    )


def dropped_positions(lines: DataFrame, min_docs: int) -> DataFrame:
    """Sorted positions of the lines that go, per row that loses any.

    Distinct documents are counted per (hash, document) first, so that a hash held
    by a third of all documents is summed before it moves; the join with the
    repeated hashes is one that adaptive execution can split.
    """
    repeated = (
        lines.groupBy("hash")
        .agg(
            F.count_distinct(F.struct("owner")).alias("n_docs"),
            F.min("owner").alias("holder"),
        )
        .where(F.col("n_docs") >= min_docs)
        .select("hash", "holder")
    )
    return (
        lines.join(repeated, "hash")
        .where(~F.col("owner").eqNullSafe(F.col("holder")))
        .groupBy("row_key")
        .agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    )


def dedup_lines(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """``docs`` with the kept lines as text, and ``n_lines``, ``n_dropped``.

    A null or empty text has one empty line and stays as it is. Rows of one id are
    one document; a null id is a document of its own that comes after all others.
    A document that loses every line is left with an empty text. An empty table
    gives an empty table.
    """
    gone, rows, lines = f"{HELPER}gone", f"{HELPER}row", f"{HELPER}lines"
    keyed = stage(keyed_lines(docs, text, doc_id, min_chars), "lines")  # read twice
    found = dropped_positions(keyed, min_docs)
    found = found.select(F.col("row_key").alias(rows), F.col("gone").alias(gone))
    joined = (
        docs.withColumn(rows, _row_key(doc_id, text))
        .join(found, rows, "left")
        .withColumn(lines, F.split(text_or_empty(text), "\n"))
    )
    # Runs of kept lines lie between the positions that go.
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda p: p + 1))
    ends = F.concat(F.col(gone), F.array(F.size(lines)))
    runs = F.zip_with(starts, ends, lambda s, e: F.slice(F.col(lines), s + 1, e - s))
    return joined.withColumns(
        {
            "n_lines": F.size(lines).cast("long"),
            "n_dropped": F.coalesce(F.size(gone), F.lit(0)).cast("long"),
            text: F.when(F.col(gone).isNull(), column(text)).otherwise(
                F.array_join(F.flatten(runs), "\n")
            ),
        }
    ).drop(gone, rows, lines)


def _lines_sql(source: str) -> str:
    """CTEs giving (doc_id, pos, line, gone) for every line of ``source``."""
    white = r"[\x20\x09-\x0D]"
    key = (
        f"translate(regexp_replace(regexp_replace(line, '^{white}+', ''), '{white}+$', ''),"
        f" '{UPPER}', '{LOWER}')"
    )
    return f"""
split_lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM {source}
),
line_keys AS (SELECT *, {key} AS key FROM split_lines),
holders AS (
  SELECT key, min(doc_id) AS holder FROM line_keys WHERE length(key) >= {MIN_CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
),
fated AS (
  SELECT l.doc_id, l.pos, l.line, h.holder IS NOT NULL AND l.doc_id <> h.holder AS gone
  FROM line_keys l LEFT JOIN holders h ON l.key = h.key
)"""


LINES_SQL = _lines_sql("documents")


@register(
    "op1_line_dedup",
    f"""
WITH {LINES_SQL}
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), ''))
         AS kept_sha256
FROM fated GROUP BY doc_id
""",
)
def op1_line_dedup(spark, sf_dir):
    kept = dedup_lines(read(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id", "n_lines", "n_dropped", sha256(text_or_empty("text")).alias("kept_sha256")
    )
