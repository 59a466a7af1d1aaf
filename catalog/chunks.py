"""Source, chunk and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    CHUNK,
    EV_SQL,
    OR_SQL,
    PREPARED_SQL,
    TRAIN,
    VALID,
    ev,
    r6,
    read,
    register,
    sql_r6,
)
from catalog.labels import indexed_orders, prepared_ev
from driftwalk.operators import splits
from driftwalk.operators.joins import attach
from driftwalk.operators.ordering import index_rows
from driftwalk.sources import chunks as chunk_files, files, tables
from driftwalk.staging import new_path

EVENT_COLUMNS = "event_id, user_id, event_type, value"


@register("load_parquet", f"SELECT {EVENT_COLUMNS} FROM events")
def load_parquet(spark, folder):
    table = tables.load_table(spark, f"{folder}/events.parquet")
    return table.select("event_id", "user_id", "event_type", "value")


@register("load_csv", f"SELECT {EVENT_COLUMNS} FROM events")
def load_csv(spark, folder):
    path = new_path(spark, "events") + ".csv"
    events = read(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    events.write.option("header", True).csv(path)
    return tables.load_table(spark, path, events.schema)


@register("write_processed", f"WITH {EV_SQL} SELECT event_id, f1, f2, f3 FROM ev")
def write_processed(spark, folder):
    path = new_path(spark, "processed") + ".parquet"
    tables.write_table(ev(spark, folder).select("event_id", "f1", "f2", "f3"), path)
    return tables.load_table(spark, path)


CHUNKED_SQL = f"""WITH {OR_SQL}
    SELECT CAST(row_idx AS BIGINT) AS row_idx, CAST(row_idx // {CHUNK} AS BIGINT) AS chunk_id,
           o_orderkey FROM ori"""


@register("write_chunks", CHUNKED_SQL)
def write_chunks(spark, folder):
    path = new_path(spark, "chunks")
    chunk_files.write_chunks(indexed_orders(spark, folder), path, CHUNK)
    return chunk_files.read_chunks(spark, path).select("row_idx", "chunk_id", "o_orderkey")


@register("read_chunk_range", CHUNKED_SQL + f" WHERE row_idx // {CHUNK} BETWEEN 3 AND 7")
def read_chunk_range(spark, folder):
    path = new_path(spark, "chunks")
    chunk_files.write_chunks(indexed_orders(spark, folder), path, CHUNK)
    return chunk_files.read_chunks(spark, path, 3, 7, ["row_idx", "chunk_id", "o_orderkey"])


@register(
    "read_files_checked",
    f"WITH {EV_SQL} SELECT event_id, f1, f2, value FROM ev",
)
def read_files_checked(spark, folder):
    """Two files read as one source after checking the columns of both."""
    rows = ev(spark, folder).select("event_id", "f1", "f2", "value", "f3")
    paths = [new_path(spark, f"half{k}") + ".parquet" for k in (0, 1)]
    for k, path in enumerate(paths):
        tables.write_table(rows.filter(F.col("event_id") % 2 == k), path)
    return tables.read_files(spark, paths, "value", ["f1", "f2"], ["event_id"])


INFO_SQL = f"""SELECT row_idx // {CHUNK} AS chunk_id, count(*) AS num_rows,
           min(row_idx) AS row_start, max(row_idx) AS row_end FROM ori GROUP BY 1"""


@register(
    "chunk_row_counts",
    f"""WITH {OR_SQL} SELECT CAST(chunk_id AS BIGINT) AS chunk_id, CAST(num_rows AS BIGINT) AS num_rows,
        CAST(row_start AS BIGINT) AS row_start, CAST(row_end AS BIGINT) AS row_end
        FROM ({INFO_SQL}) ORDER BY chunk_id""",
)
def chunk_row_counts(spark, folder):
    return splits.chunk_infos(indexed_orders(spark, folder), CHUNK).orderBy("chunk_id")


SPLIT_SQL = f"""infos AS ({INFO_SQL}),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY chunk_id) - 1 AS rank, count(*) OVER () AS n FROM infos
),
split_chunks AS (
  SELECT chunk_id, num_rows, row_start, row_end,
         CASE WHEN rank < floor(n * {TRAIN}) THEN 'train'
              WHEN rank < floor(n * {TRAIN}) + floor(n * {VALID}) THEN 'valid'
              ELSE 'test' END AS split
  FROM ranked
)"""


@register(
    "split_chunks",
    f"""WITH {OR_SQL}, {SPLIT_SQL}
        SELECT CAST(chunk_id AS BIGINT) AS chunk_id, CAST(num_rows AS BIGINT) AS num_rows, split
        FROM split_chunks""",
)
def split_chunks(spark, folder):
    infos = splits.chunk_infos(indexed_orders(spark, folder), CHUNK)
    return splits.split_chunks(infos, TRAIN, VALID).select("chunk_id", "num_rows", "split")


@register(
    "split_chunks_shuffled",
    f"""WITH {OR_SQL}, infos AS (SELECT row_idx // 100 AS chunk_id, count(*) AS num_rows FROM ori GROUP BY 1),
        ranked AS (
          SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', CAST(chunk_id AS BIGINT), 7)), chunk_id) - 1 AS rank,
                 count(*) OVER () AS n FROM infos
        )
        SELECT CAST(chunk_id AS BIGINT) AS chunk_id, CAST(num_rows AS BIGINT) AS num_rows,
               CASE WHEN rank < floor(n * {TRAIN}) THEN 'train'
                    WHEN rank < floor(n * {TRAIN}) + floor(n * {VALID}) THEN 'valid' ELSE 'test' END AS split
        FROM ranked""",
)
def split_chunks_shuffled(spark, folder):
    """Chunks of 100 rows split after a hashed shuffle."""
    infos = splits.chunk_infos(indexed_orders(spark, folder), 100)
    split = splits.split_chunks(infos, TRAIN, VALID, seed=7)
    return split.select("chunk_id", "num_rows", "split")


@register(
    "split_rows",
    f"""WITH {OR_SQL}, {SPLIT_SQL},
        firsts AS (SELECT split, min(row_start) AS split_start FROM split_chunks GROUP BY split)
        SELECT CAST(o.row_idx AS BIGINT) AS row_idx, CAST(c.chunk_id AS BIGINT) AS chunk_id, c.split,
               CAST(o.row_idx - f.split_start AS BIGINT) AS split_row
        FROM ori o JOIN split_chunks c ON c.chunk_id = o.row_idx // {CHUNK} JOIN firsts f USING (split)""",
)
def split_rows(spark, folder):
    rows = splits.with_chunks(indexed_orders(spark, folder), CHUNK)
    rows = splits.with_splits(rows, ratios=(TRAIN, VALID), chunk_rows=CHUNK)
    return rows.select("row_idx", "chunk_id", "split", "split_row")


@register(
    "locate_rows",
    f"""WITH {OR_SQL}, infos AS ({INFO_SQL})
        SELECT CAST(o.row_idx AS BIGINT) AS row_idx, CAST(i.chunk_id AS BIGINT) AS chunk_id,
               CAST(o.row_idx - i.row_start AS BIGINT) AS "offset"
        FROM (SELECT row_idx + 750 AS row_idx FROM ori) o
        JOIN infos i ON o.row_idx BETWEEN i.row_start AND i.row_end""",
)
def locate_rows(spark, folder):
    """Each row's index 750 ahead, looked up in the chunk table."""
    rows = indexed_orders(spark, folder)
    infos = splits.chunk_infos(rows, CHUNK)
    ahead = rows.select((F.col("row_idx") + 750).alias("row_idx"))
    return splits.locate_rows(ahead, infos, CHUNK)


@register(
    "concatenate_tables",
    """SELECT event_id, value, 'a' AS origin FROM events WHERE user_id % 2 = 0
       UNION ALL SELECT event_id, value, 'b' AS origin FROM events WHERE user_id % 2 = 1""",
)
def concatenate_tables(spark, folder):
    events = read(spark, folder, "events")
    even = events.filter("user_id % 2 = 0").select("event_id", "value", F.lit("a").alias("origin"))
    odd = events.filter("user_id % 2 = 1").select(F.lit("b").alias("origin"), "value", "event_id")
    return tables.concatenate([even, odd])


@register(
    "positional_attach",
    f"""WITH {EV_SQL}
        SELECT user_id, CAST(row_idx AS BIGINT) AS row_idx, f2, {sql_r6("value * 2")} AS doubled FROM evi""",
)
def positional_attach(spark, folder):
    """A column computed on a table of its own, put back by series and row."""
    from catalog.labels import indexed_ev

    rows = indexed_ev(spark, folder)
    other = rows.select("user_id", "row_idx", r6(F.col("value") * 2).alias("doubled"))
    kept = rows.select("user_id", "row_idx", "f2")
    return attach(kept, other, ["user_id", "row_idx"])


@register(
    "run_summary",
    f"""WITH RECURSIVE {PREPARED_SQL}
        SELECT 'prepare' AS run, 'label_spread' AS metric, {sql_r6("stddev_pop(label)")} AS value FROM prepared""",
)
def run_summary(spark, folder):
    """One run recorded with the mean label spread as its metric."""
    path = new_path(spark, "runs")
    spread = prepared_ev(spark, folder).agg(F.stddev_pop("label")).first()[0]
    tables.append_run(spark, path, "prepare", "label_spread", spread, {"table": "prepared"})
    return tables.read_runs(spark, path).select("run", "metric", r6("value").alias("value"))


@register(
    "feature_names",
    """SELECT CAST(row_number() OVER (ORDER BY p_name) - 1 AS INTEGER) AS position, p_name AS name
       FROM (SELECT DISTINCT p_name FROM part)""",
)
def feature_names(spark, folder):
    """The distinct part names as a feature list: written with quotes, commas and blanks
    around them, and a price among them; read back without either."""
    names = read(spark, folder, "part").select("p_name").distinct()
    decorated = names.select(F.concat(F.lit("  '"), F.col("p_name"), F.lit('" , ')).alias("value"))
    more = spark.createDataFrame([(" 'mid_price',",), ("  ",)], "value string")
    path = new_path(spark, "features")
    decorated.unionAll(more).write.text(path)
    lines = spark.read.text(path).where(F.trim("value") != "")
    cleaned = lines.select(tables.clean_feature_name(F.col("value")).alias("name"))
    kept = index_rows(cleaned.where(F.col("name") != "mid_price"), ["name"], index_col="position")
    return kept.select(F.col("position").cast("int").alias("position"), "name")


def stored_chunks(spark, folder, path):
    """Orders in a file per chunk, whose rows are in order and whose names are too."""
    rows = indexed_orders(spark, folder).withColumn(
        "chunk", F.lpad(F.expr(f"row_idx div {CHUNK}").cast("string"), 9, "0")
    )
    dealt = rows.repartition("chunk").sortWithinPartitions("chunk", "row_idx")
    dealt.write.partitionBy("chunk").parquet(path)


@register(
    "file_infos",
    f"""WITH {OR_SQL} SELECT CAST(row_idx // {CHUNK} AS BIGINT) AS chunk_id, count(*) AS length, CAST(1 AS INT) AS row_groups
        FROM ori GROUP BY 1""",
)
def file_infos(spark, folder):
    """Rows and row groups of files on storage, read from their footers."""
    path = new_path(spark, "files")
    stored_chunks(spark, folder, path)
    found = files.file_infos(spark, [path])
    chunk = F.regexp_extract("filename", "chunk=([0-9]+)/", 1).cast("bigint")
    return found.select(chunk.alias("chunk_id"), "length", "row_groups")


@register(
    "row_index_by_files",
    f"WITH {OR_SQL} SELECT o_orderkey, CAST(row_idx AS BIGINT) AS row_idx FROM ori",
)
def row_index_by_files(spark, folder):
    """The index of rows that carry no order but that of their files."""
    path = new_path(spark, "files")
    stored_chunks(spark, folder, path)
    return files.index_by_files(spark, [path], columns=["o_orderkey"])
