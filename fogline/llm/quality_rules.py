"""Quality rules: a table of thresholds compiled into one Spark projection.

All measures are built-in expressions over the words and lines of one row, so a document is judged where it is read: no user
function, no shuffle, no join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
REPEAT_WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30

#: Frequent function words of the four languages.
STOP_WORDS = (
    *("the of and to in is it that for was on are as with be by at from this have".split()),
    *("le la les de des du un une et est en que qui dans pour par sur pas au avec".split()),
    *("der die das und ist in den von zu mit sich auf für nicht ein eine im dem als auch".split()),
    *("el la los las de que y en un una por con para se es del al no su lo".split()),
)


@dataclass(frozen=True)
class Rule:
    """Keep a document only if ``least <= measure <= most``."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: Measures are SQL over the columns that ``measured`` makes.
RULES = (
    Rule("mean_word_length", "word_chars / n_words", 2.0, 15.0),
    Rule("symbols_per_word", "n_symbols / n_words", None, 0.25),
    Rule("stop_word_share", "n_stop_words / n_words", 0.02, None),
    Rule("letter_share", "n_letters / word_chars", 0.6, None),
    Rule("upper_letter_share", "n_upper / greatest(n_letters, 1)", None, 0.5),
    Rule("repeated_line_share", "n_dup_lines / greatest(n_lines, 1)", None, 0.5),
)


def _repeat_words(words: str, hashes: str, order: str, at: str) -> tuple[str, str, str, str]:
    """SQL of: hashes of all windows; the same with places, sorted; places of windows found twice; words they cover."""
    k = REPEAT_WINDOW
    return (
        f"if(size({words}) >= {k}, transform(sequence(1, greatest(size({words}) - {k - 1}, 1)), i -> xxhash64(slice({words}, i, {k}))), array())",
        f"if(size(array_distinct({hashes})) < size({hashes}), sort_array(transform({hashes}, (h, i) -> struct(h, i))), array())",
        f"sort_array(transform(filter(transform({order}, (x, i) -> struct(x.i as i, (i > 0 and {order}[greatest(i - 1, 0)].h = x.h) or (i < size({order}) - 1 and {order}[least(i + 1, size({order}) - 1)].h = x.h) as again)), x -> x.again), x -> x.i))",
        f"aggregate(transform({at}, (p, i) -> if(i < size({at}) - 1, least({k}, {at}[least(i + 1, size({at}) - 1)] - p), {k})), 0L, (a, x) -> a + x)",
    )


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` as one struct ``row``, and the measures of its text beside it."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    hashes, order, at, covered = _repeat_words("words", "window_hashes", "window_order", "window_places")
    stop = ", ".join(f"'{w}', '{w.capitalize()}'" for w in dict.fromkeys(STOP_WORDS))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"))
    rows = rows.select("row", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"), F.split("text", "\n", -1).alias("all_lines"))
    rows = rows.select("row", "text", "words", F.filter("all_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"), F.expr(hashes).alias("window_hashes"))
    rows = rows.withColumn("window_order", F.expr(order)).withColumn("window_places", F.expr(at))
    return rows.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOL, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        F.expr(f"size(filter(words, w -> w in ({stop})))").alias("n_stop_words"),
        F.length(F.regexp_replace("text", r"\P{L}+", "")).alias("n_letters"),
        F.length(F.regexp_replace("text", r"\P{Lu}+", "")).alias("n_upper"),
    )


def verdict(rules: tuple[Rule, ...]) -> Column:
    """True if every rule holds. Measures are divided only where there are words."""
    held = F.lit(True)
    for r in rules:
        value = F.expr(f"cast({r.measure} as double)")
        if r.least is not None:
            held = held & (value >= r.least)
        if r.most is not None:
            held = held & (value <= r.most)
    return held


def quality(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``row`` (all columns of ``docs``), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A null or empty text has no words, fails the base rules and is not kept. Equal texts get equal results. Extra columns
    stay inside ``row``, so no name clashes. An empty table gives an empty result.
    """
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = measured(docs, text_col).withColumn("base_failed", base_failed)
    return rows.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.when(F.col("base_failed"), False).otherwise(verdict(rules)).alias("kept"))


_STOP_SQL = ", ".join(f"'{w}', '{w.capitalize()}'" for w in dict.fromkeys(STOP_WORDS))


def _rules_sql(rules: tuple[Rule, ...]) -> str:
    tests = []
    for r in rules:
        measure = r.measure.replace("/", "::DOUBLE /")
        tests += [f"{measure} >= {r.least}"] * (r.least is not None) + [f"{measure} <= {r.most}"] * (r.most is not None)
    return " AND ".join(tests)


#: The same verdicts in DuckDB.
QUALITY_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
w AS (
  SELECT doc_id, i, array_to_string(words[i:i + {REPEAT_WINDOW - 1}], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {REPEAT_WINDOW - 2})) AS i FROM d WHERE len(words) >= {REPEAT_WINDOW})),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM w),
cover AS (
  SELECT doc_id, sum(least({REPEAT_WINDOW}, coalesce(lead_i - i, {REPEAT_WINDOW})))::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS lead_i FROM again WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '{SYMBOL}', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines,
         len(list_filter(words, lambda w: w IN ({_STOP_SQL}))) AS n_stop_words,
         length(regexp_replace(text, '\\P{{L}}+', '', 'g')) AS n_letters, length(regexp_replace(text, '\\P{{Lu}}+', '', 'g')) AS n_upper
  FROM d LEFT JOIN cover c USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       CASE WHEN base_failed THEN false ELSE {_rules_sql(RULES)} END AS kept
FROM b
"""
