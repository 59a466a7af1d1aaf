"""Benchmark decontamination by templates, with built-in functions only.

Texts are canonicalised to templates: numbers, names and units become typed
placeholders, all other words are lowered. Windows of template words are hashed and
joined with those of the benchmark. Where they meet, what fills the placeholders must
agree along an alignment: values of the item and of the document stand for each other
one to one, but for a quarter of them at most, as two quantities of either may happen
to be equal. That finds questions asked again with other numbers or names, and leaves
alone texts that merely share a pattern. Windows of the words themselves, lowered, are
joined too, so that a copy in other case is found. All that is done for texts cut at
every sign, and once more for texts in which a number with its sign, separators and
decimals, or a run of words with capitals, is one value.

Texts are cut into pieces of ``PIECE`` words before windows are made, so that a row is
bounded however long its text is; a window carries its own placeholders' words only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from driftwalk.llm.base import HELPER, ORACLES, column, read, register, text_or_empty
from driftwalk.staging import stage

# Words in a window, words of a window that must not be placeholders, and what makes
# a leak: this many windows of an item (8 + 5 words in a row) or this share of them.
WINDOW, PLAIN_WORDS = 8, 4
MIN_WINDOWS, MIN_SHARE = 6, 0.5
# Share of an alignment's values that may break the one to one.
MAX_CONFLICTS = 0.25
# Words whose windows are one row before they are exploded.
PIECE = 4096
# Benchmark windows up to this many bytes are broadcast; more are shuffled.
BROADCAST_BYTES = 32 << 20

NUMBER, NAME, UNIT = "#", "@", "%"  # no word holds these

# Words in which a value is whole: numbers, runs of words with capitals, others.
_CAPITAL = r"(?=[\p{L}\p{N}]*\p{Lu})\p{L}[\p{L}\p{N}]*+"
VALUES = (
    r"(?:(?<![\p{L}\p{N}])[+-])?[0-9]++(?:,[0-9]{3}(?![0-9]))*(?:\.[0-9]++)?[\p{L}\p{N}]*"
    rf"|{_CAPITAL}(?:(?:\s{{1,3}}|[-'’]){_CAPITAL})*+"
    r"|[\p{L}\p{N}]++"
)

# Unit words that are hardly anything else.
UNITS = (
    "mm cm km kg mg lb lbs oz ft mph kmh ml meter meters metre metres kilometer kilometers "
    "kilometre kilometres centimeter centimeters inch inches feet mile miles yard yards gram "
    "grams kilogram kilograms pound pounds ounce ounces liter liters litre litres second "
    "seconds minute minutes hour hours day days week weeks month months year years dollar "
    "dollars cent cents euro euros percent degree degrees"
).split()


def words_of(text: Column) -> Column:
    """Runs of letters and digits."""
    return F.array_remove(F.split(text, r"[^\p{L}\p{N}]+"), "")


def values_of(text: Column) -> Column:
    """Words, where a number or a name of several words is one of them."""
    return F.regexp_extract_all(text, F.lit(VALUES), F.lit(0))


def template_word(word: Column, lowered: Column) -> Column:
    """A placeholder for numbers, units and words with a capital; else the word."""
    return (
        F.when(word < ":", F.lit(NUMBER))  # a digit or a sign comes first
        .when(lowered.isin(UNITS), F.lit(UNIT))
        .when(word != lowered, F.lit(NAME))
        .otherwise(word)
    )


def _pieces(rows: DataFrame, window: int) -> DataFrame:
    """(key, valued, start, n, lower, template): pieces of the words of (key, text).

    Every text is cut into words, and once more into words with whole values
    (``valued``). ``n`` is the number of words of the text. A piece has ``PIECE`` words
    from ``start`` on and those after it that its last windows need. Every array is a
    column of its own before it is used twice, so that none is computed again per use.
    """
    text = F.col("text")
    forms = ((False, words_of(text)), (True, values_of(text)))
    both = F.array(*(F.struct(F.lit(v).alias("valued"), ws.alias("words")) for v, ws in forms))
    made = rows.select("key", F.inline(both))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(PIECE))

    def piece(start: Column) -> Column:
        return F.struct(start.alias("start"), F.slice("words", start + 1, PIECE + window - 1).alias("words"))

    # Cut before they are exploded: a row of a piece never carries the whole text. The
    # outer kind has the optimiser put no filter on the array, which it would compute again.
    cut = F.inline_outer(F.transform(starts, piece))
    made = made.select("key", "valued", F.size("words").alias("n"), cut)
    place = ["key", "valued", "start", "n"]
    made = made.select(*place, "words", F.transform("words", F.lower).alias("lower"))
    return made.select(*place, "lower", F.zip_with("words", "lower", template_word).alias("template"))


def _occurrences(rows: DataFrame, window: int, short: Sequence[int] = ()) -> DataFrame:
    """(key, valued, width, pos, literal, hash, at, under): every window, by both its hashes.

    ``under`` has the words that placeholders stand for in the whole piece, where the
    window begins at ``at``; ``_slots`` cuts the window's own. That is done after a join,
    in the code that explodes windows, so that most windows are never made into rows and
    no row carries ``under``. Texts with whole values have template windows only. A text
    of fewer words than a window has one window of all its words; windows of the widths
    ``short`` come beside whole ones in longer texts.
    """
    made = _pieces(rows, window)
    place = ["key", "valued", "start", "n"]
    under = F.zip_with("lower", "template", lambda word, typed: F.when(word != typed, word))
    made = made.select(
        *place,
        under.alias("under"),
        F.transform("lower", lambda w: F.xxhash64(w)).alias("lower"),
        F.transform("template", lambda w: F.xxhash64(w)).alias("template"),
        F.explode(F.array(*map(F.lit, [*short, window]))).alias("width"),
    )
    whole, n = F.col("width") == window, F.col("n")
    made = made.where((n > 0) & (whole | (n > F.col("width"))))
    made = made.withColumn("width", F.least(n, F.col("width")))
    made = made.withColumn("count", F.least(n - F.col("start") - F.col("width") + 1, F.lit(PIECE)))
    made = made.where(F.col("count") > 0)
    # First the windows of words, then those of the template.
    kinds = F.when(F.col("valued"), 1).otherwise(2)
    made = made.select("*", F.explode_outer(F.sequence(F.lit(0), F.col("count") * kinds - 1)).alias("i"))
    made = made.withColumn("literal", ~F.col("valued") & (F.col("i") < F.col("count")))
    made = made.withColumn("at", F.col("i") % F.col("count") + 1)
    hash_ = F.xxhash64(
        F.when(F.col("literal"), F.slice("lower", F.col("at"), F.col("width"))).otherwise(
            F.slice("template", F.col("at"), F.col("width"))
        )
    )
    pos = F.col("start") + F.col("at") - 1
    return made.select(
        "key", "valued", "width", pos.alias("pos"), "literal", hash_.alias("hash"), "at", "under"
    )


def _slots() -> Column:
    """The words under a window, nulls for words that stand for themselves."""
    return F.when(~F.col("literal"), F.slice("under", F.col("at"), F.col("width")))


def _values(slots: str) -> Column:
    return F.filter(slots, lambda word: word.isNotNull())


def benchmark_windows(items: DataFrame, window: int, plain_words: int) -> DataFrame:
    """(hash, width, valued, item, i_pos, i_slots, windows, typed): what is looked for.

    Template windows with too few words beside placeholders are no evidence; their
    words themselves are. ``typed`` is the number of those with enough.
    """
    found = _occurrences(items, window).withColumn("slots", _slots()).drop("at", "under")
    found = found.withColumn("slots", _values("slots"))
    plain = F.col("width") - F.size("slots")
    known = found.where(F.col("literal") | (plain >= plain_words))
    known = known.select("key", "valued", "width", "pos", "hash", "slots").distinct()
    sizes = known.groupBy(F.col("key").alias("of"), F.col("valued").alias("form")).agg(
        F.count_distinct("pos").alias("windows"),
        F.count_distinct(F.when(F.col("slots").isNotNull(), F.col("pos"))).alias("typed"),
    )
    return (
        known.join(sizes, F.col("key").eqNullSafe(F.col("of")) & (F.col("valued") == F.col("form")))
        .select(
            "hash",
            "width",
            "valued",
            F.col("key").alias("item"),
            F.col("pos").alias("i_pos"),
            F.col("slots").alias("i_slots"),
            "windows",
            "typed",
        )
    )


def _bytes(known: DataFrame) -> int:
    """Size of the benchmark's windows as rows, words under placeholders included."""
    slots = F.coalesce(F.octet_length(F.array_join("i_slots", "")) + F.size("i_slots") * 24, F.lit(0))
    return known.agg(F.sum(F.lit(96) + slots)).first()[0] or 0


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
    window: int = WINDOW,
    min_windows: int = MIN_WINDOWS,
    min_share: float = MIN_SHARE,
    short_inside: bool = False,
    max_conflicts: float = MAX_CONFLICTS,
    plain_words: int = PLAIN_WORDS,
) -> DataFrame:
    """Leaked items: doc_id, item_id, matched, windows, literal.

    An item leaks into a document that holds ``min_windows`` of its windows, or
    ``min_share`` of them, or that share of its template windows with ``plain_words``
    words beside placeholders, which are all that other values leave of an item.
    Windows count once per item position. Template windows count if values of item and
    document stand for each other one to one along their alignment; for each that has
    more than one partner, every further partner is a conflict, of which there may be
    ``max_conflicts`` per value of the side with fewer. ``literal`` says that the words
    themselves reach a leak; else the item came with other values. Windows of words
    come first; where they make no leak, ``matched`` and ``windows`` are template
    windows of texts with whole values.
    An item of fewer words than a window is one window. With ``short_inside`` it is
    found anywhere in a document, else only in one that consists of it. ``window`` is a
    power of two.
    Null and empty texts hold nothing; rows of equal id and text are one row here; rows
    of one id and different texts are counted together; null ids are one document.
    Empty tables give an empty table. Texts of any length are cut into pieces.
    Documents are exploded to windows and joined with the benchmark's, which are
    broadcast if their bytes are few; no document text is shuffled.
    """
    rows = docs.select(column(doc_id).alias("key"), text_or_empty(text).alias("text"))
    items = benchmark.select(column(item_id).alias("key"), text_or_empty(item_text).alias("text"))
    known = stage(benchmark_windows(items.distinct(), window, plain_words), "benchmark")
    short = []
    if short_inside:  # at most ``window`` - 1 widths
        widths = known.select("width").where(F.col("width") < window).distinct()
        short = sorted(r["width"] for r in widths.collect())
    made = _occurrences(rows, window, short)
    few, on = _bytes(known) <= BROADCAST_BYTES, ["width", "valued", "hash"]
    if few:
        met = made.join(F.broadcast(known), on).withColumn("slots", _slots())
    else:  # windows move, so they leave their texts behind
        met = made.withColumn("slots", _slots()).drop("at", "under", "literal").join(known, on)
    met = met.select(
        "key",
        "item",
        "valued",
        "i_pos",
        "windows",
        "typed",
        (F.col("pos") - F.col("i_pos")).alias("shift"),
        "i_slots",
        "slots",
    )
    met = stage(met, "met").withColumn("slots", _values("slots"))
    # Equal words of which other ones are placeholders say nothing about values. A hash
    # of words and one of a template are the same only where the template has no value.
    alike = F.col("i_slots").isNull() | (
        F.size("i_slots") == F.coalesce(F.size("slots"), F.lit(0))
    )
    literal = F.col("i_slots").isNull()
    filled = F.when(~literal, F.arrays_zip("i_slots", "slots"))
    aligned = met.where(alike).select(
        *met.columns[:-2], literal.alias("literal"), filled.alias("filled")
    )
    by = ["key", "item", "valued", "windows", "typed"]
    consistent = _consistent(aligned.where(~F.col("literal")), by, max_conflicts)
    counted = (
        aligned.where("literal")
        .select(*by, "i_pos", "literal")
        .unionAll(consistent.select(*by, "i_pos", F.lit(False).alias("literal")))
        .groupBy(*by, "i_pos")
        .agg(F.max("literal").alias("literal"), F.min("literal").alias("no_template"))
        .groupBy(*by)
        .agg(
            F.count("*").alias("matched"),
            F.count_if("literal").alias("literal"),
            F.count_if(~F.col("no_template")).alias("alike"),
        )
    )

    def enough(n: Column) -> Column:
        return (n >= min_windows) | (n >= F.col("windows") * min_share)

    by_template = (F.col("alike") > 0) & (F.col("alike") >= F.col("typed") * min_share)
    leaking = counted.where(enough(F.col("matched")) | by_template)
    figures = F.struct("matched", "windows", enough(F.col("literal")).alias("literal"))
    return (
        leaking.groupBy("key", "item")
        .agg(F.min_by(figures, "valued").alias("of"))
        .select(F.col("key").alias(doc_id), F.col("item").alias(item_id), "of.*")
    )


def _consistent(aligned: DataFrame, by: list[str], max_conflicts: float) -> DataFrame:
    """Template windows whose alignment gives values one partner each, or nearly so.

    Values of an alignment are compared as distinct pairs, of which it has as many as
    the item has places for values at most. Every pair beyond the number of its item
    values, and beyond the number of its document values, is a conflict.
    """
    place = [*by, "shift"]
    pairs = aligned.select(*place, F.explode("filled").alias("f"))
    pairs = pairs.select(*place, "f.*").distinct()
    ours, theirs = (F.size(F.collect_set(side)) for side in ("i_slots", "slots"))
    broken = (
        pairs.groupBy(*place)
        .agg(F.count("*").alias("pairs"), ours.alias("ours"), theirs.alias("theirs"))
        .where(
            F.col("pairs") * 2 - F.col("ours") - F.col("theirs")
            > F.least("ours", "theirs") * max_conflicts
        )
        .select(*place)
    )
    conditions = [aligned[c].eqNullSafe(broken[c]) for c in place]
    return aligned.join(broken, conditions, "left_anti")


def drop_leaking(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", **options
) -> DataFrame:
    """The rows of ``docs`` into which no benchmark item leaks.

    Options and treatment of odd rows as in ``find_leaks``.
    """
    leaks = find_leaks(docs, benchmark, text, doc_id, **options)
    key = f"{HELPER}id"
    gone = leaks.select(column(doc_id).alias(key)).distinct()
    return docs.join(gone, column(doc_id).eqNullSafe(F.col(key)), "left_anti")


def _windows_sql(source: str, key: str, name: str, widths: str = "") -> str:
    """CTE ``name`` (key, valued, n, width, pos, kind, win, slots, plain): all windows of a table.

    ``widths`` is a query of widths that come beside the whole ones. Numbers and names
    are found after signs and commas that join nothing are marked, as the patterns of
    this engine see no neighbours.
    """
    units = ", ".join(f"'{unit}'" for unit in UNITS)
    low_letter, joint = r"\p{Ll}\p{Lt}\p{Lm}\p{Lo}", r"(?:[ \t\n\x0B\f\r]{1,3}|[-''’])"
    capital = rf"(?:\p{{Lu}}[\p{{L}}\p{{N}}]*|[{low_letter}][{low_letter}\p{{N}}]*\p{{Lu}}[\p{{L}}\p{{N}}]*)"
    whole = (
        r"[+-]?[0-9]+(?:\x02[0-9]{3})*(?:\.[0-9]+)?[\p{L}\p{N}]*"
        rf"|{capital}(?:{joint}{capital})*|[\p{{L}}\p{{N}}]+"
    )
    marked = "coalesce(text, '')"
    for _ in range(2):  # matches that touch are marked in the second turn
        marked = rf"regexp_replace({marked}, '([\p{{L}}\p{{N}}])([+-][0-9])', '\1' || chr(1) || '\2', 'g')"
        marked = rf"regexp_replace({marked}, '([0-9]),([0-9]{{3}})([^0-9]|$)', '\1' || chr(2) || '\2\3', 'g')"
    marked = rf"regexp_replace({marked}, '\x01[+-]', chr(1), 'g')"
    more = (
        f"UNION ALL SELECT w.*, width FROM {name}_words w, ({widths}) WHERE len(words) > width"
        if widths
        else ""
    )
    return rf"""
{name}_words AS (
  SELECT key, valued, words, list_transform(words, lambda w: lower(w)) AS low,
         list_transform(words, lambda w: CASE WHEN w < ':' THEN '{NUMBER}'
           WHEN lower(w) IN ({units}) THEN '{UNIT}' WHEN w <> lower(w) THEN '{NAME}' ELSE w END) AS typed
  FROM (SELECT {key} AS key, false AS valued, list_filter(string_split_regex(coalesce(text, ''), '[^\p{{L}}\p{{N}}]+'),
                                                          lambda w: w <> '') AS words FROM {source}
        UNION ALL
        SELECT {key}, true, list_transform(regexp_extract_all({marked}, '{whole}'),
                                           lambda w: replace(w, chr(2), ',')) FROM {source})
  WHERE len(words) > 0
),
{name}_wide AS (
  SELECT *, least(len(words), {WINDOW}) AS width FROM {name}_words
  {more}
),
{name}_cut AS (
  SELECT key, valued, width, pos, low[pos + 1 : pos + width] AS low, typed[pos + 1 : pos + width] AS typed
  FROM (SELECT *, unnest(range(len(words) - width + 1)) AS pos FROM {name}_wide)
),
{name} AS (
  SELECT DISTINCT * FROM (
    SELECT key, valued, width, pos, kind, array_to_string(CASE kind WHEN 'literal' THEN low ELSE typed END, ' ') AS win,
           list_transform(list_filter(range(1, len(low) + 1), lambda i: low[i] <> typed[i]), lambda i: low[i]) AS slots,
           len(list_filter(typed, lambda t: t NOT IN ('{NUMBER}', '{NAME}', '{UNIT}'))) AS plain
    FROM {name}_cut, (VALUES ('literal'), ('typed')) kinds(kind) WHERE kind = 'typed' OR NOT valued
  )
)"""


@register(
    "op2_benchmark_decontamination",
    f"""
WITH {_windows_sql("benchmark", "item_id", "item_all")},
item AS (SELECT * FROM item_all WHERE kind = 'literal' OR plain >= {PLAIN_WORDS}),
{_windows_sql("documents", "doc_id", "doc", f"SELECT DISTINCT width FROM item WHERE width < {WINDOW}")},
sizes AS (
  SELECT key, valued, count(DISTINCT pos) AS windows, count(DISTINCT pos) FILTER (WHERE kind = 'typed') AS typed
  FROM item GROUP BY key, valued
),
met AS (
  SELECT d.key, i.key AS item, valued, i.pos AS i_pos, d.pos - i.pos AS shift, i.kind = 'literal' AS literal,
         i.slots AS i_slots, d.slots
  FROM doc d JOIN item i USING (valued, width, kind, win)
  WHERE i.kind = 'literal' OR len(i.slots) = len(d.slots)
),
broken AS (
  SELECT key, item, valued, shift FROM (
    SELECT DISTINCT key, item, valued, shift, i_slots[n] AS ours, slots[n] AS theirs
    FROM (SELECT *, unnest(range(1, len(slots) + 1)) AS n FROM met WHERE NOT literal)
  ) GROUP BY key, item, valued, shift
  HAVING 2 * count(*) - count(DISTINCT ours) - count(DISTINCT theirs)
         > least(count(DISTINCT ours), count(DISTINCT theirs)) * {MAX_CONFLICTS}
),
found AS (
  SELECT key, item, valued, i_pos, bool_or(literal) AS literal, bool_or(NOT literal) AS alike FROM met
  WHERE literal OR NOT EXISTS (
    SELECT 1 FROM broken b WHERE b.key = met.key AND b.item = met.item
                             AND b.valued = met.valued AND b.shift = met.shift)
  GROUP BY key, item, valued, i_pos
),
counted AS (
  SELECT f.key, item, f.valued, any_value(windows) AS windows, any_value(typed) AS typed, count(*) AS matched,
         count(*) FILTER (WHERE literal) AS words, count(*) FILTER (WHERE alike) AS alike
  FROM found f JOIN sizes s ON s.key = f.item AND s.valued = f.valued GROUP BY f.key, item, f.valued
)
SELECT key AS doc_id, item AS item_id, matched, windows,
       words >= {MIN_WINDOWS} OR words >= windows * {MIN_SHARE} AS literal
FROM counted
WHERE matched >= {MIN_WINDOWS} OR matched >= windows * {MIN_SHARE} OR (alike > 0 AND alike >= typed * {MIN_SHARE})
QUALIFY row_number() OVER (PARTITION BY key, item ORDER BY valued) = 1
""",
)
def op2_benchmark_decontamination(spark, sf_dir):
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    found = find_leaks(docs, items, short_inside=True)
    return found.select("doc_id", "item_id", "matched", "windows", "literal")
