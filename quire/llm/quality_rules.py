"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Each rule names a measure and the range in which a document passes. All
measures are column expressions over the whole text, so the scan, the measures
and the verdict run in the JVM in one narrow stage: nothing is shuffled and no
user function runs.

Defined results: a null or blank text has no words, measures of 0 and fails the
base; rows with equal ids or texts are judged alike and all kept as rows;
further columns of the input pass through untouched (a clashing name is replaced
by this operator's value, and names that begin with _rule_ are its own); a text of
any length is measured whole; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._spark import table

#: Frequent function words of the languages that the corpus is curated for.
STOP_WORDS = tuple(
    "the of and to in is that it for as with was on be by this are from or an at have not "
    "der die das und den von zu mit des ist im ein eine nicht auf für dem sich "
    "de la le les et des un une que est dans pour qui sur pas avec du en "
    "el los las y del se por con una su para es al lo como más".split()
)


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= measure <= high."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: measure -> SQL over the base columns; a ratio's divisor is at least 1.
MEASURES = {
    "n_words": "n_words",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_word_ratio": "n_repeat_words / greatest(n_words, 1)",
    "stop_word_ratio": "n_stop_words / greatest(n_words, 1)",
    "bullet_line_ratio": "n_bullet_lines / greatest(n_lines, 1)",
    "ellipsis_line_ratio": "n_ellipsis_lines / greatest(n_lines, 1)",
    "alpha_word_ratio": "n_alpha_words / greatest(n_words, 1)",
}

RULES = (
    Rule("length", "n_words", 50, None),
    Rule("word_length", "mean_word_chars", 2.0, 14.0),
    Rule("symbols", "symbols_per_word", None, 0.1),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.3),
    Rule("stop_words", "stop_word_ratio", 0.02, None),
    Rule("bullets", "bullet_line_ratio", None, 0.9),
    Rule("ellipses", "ellipsis_line_ratio", None, 0.3),
    Rule("alphabetic", "alpha_word_ratio", 0.6, None),
)

#: Every way to write a stop word: no other letters become theirs in lower case.
STOP_FORMS = tuple(sorted({"".join(x) for w in STOP_WORDS for x in product(*((c, c.upper()) for c in w))}))

def _bound(value: Column) -> Column:
    """The same value, but not deterministic in the optimiser's eyes.

    It would otherwise push filters on a verdict below the projections and write
    out each measure, with all arrays in it, once for every use.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)  # rand() >= 0 would be folded away


def _let(name: str, value: str, body: str) -> str:
    """SQL of body, in which name is value: computed once, and an array's elements are not copied into a row and out again."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _of_words() -> str:
    """SQL of the counts of _rule_t's words.

    Repeats of 3-word windows are found on 64-bit hashes of the windows: a text
    whose hashes are all distinct (the usual case) is done after one pass; in the
    others (hash, place) pairs are sorted, neighbours with equal hashes mark
    places, and the words that marked windows cover are counted from the gaps.
    """
    words = r"array_remove(split(_rule_t, r'[\x20\x09-\x0D]+'), '')"
    windows = "transform(slice(w, 1, greatest(size(w) - 2, 0)), (x, i) -> xxhash64(x, get(w, i + 1), get(w, i + 2)))"
    pairs = "sort_array(transform(h, (x, i) -> named_struct('h', x, 'i', i)))"
    marked = "sort_array(transform(filter(s, (x, k) -> (k > 0 AND x.h = s[greatest(k - 1, 0)].h) OR (k < size(s) - 1 AND x.h = s[least(k + 1, size(s) - 1)].h)), x -> x.i))"
    covered = "aggregate(transform(r, (x, k) -> CASE WHEN k = size(r) - 1 THEN 3 ELSE least(3, r[least(k + 1, size(r) - 1)] - x) END), 0L, (a, x) -> a + x)"
    repeats = f"CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE {_let('s', pairs, _let('r', marked, covered))} END"
    stops = ", ".join(f"'{x}'" for x in STOP_FORMS)
    counts = f"named_struct('n', size(w), 'chars', length(array_join(w, '')), 'repeats', {_let('h', windows, repeats)}, 'stops', size(filter(w, x -> x IN ({stops}))))"
    return _let("w", words, counts)


def _of_lines() -> str:
    """SQL of the counts of _rule_t's lines that have a word."""
    lines = r"filter(split(_rule_t, '\n'), x -> x RLIKE r'[^\x20\x09-\x0D]')"
    bullets = "size(filter(l, x -> substring(ltrim(x), 1, 1) IN ('-', '*', '•', '‣', '·')))"
    ellipses = "size(filter(l, x -> rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…'))"
    return _let("l", lines, f"named_struct('n', size(l), 'dups', size(l) - size(array_distinct(l)), 'bullets', {bullets}, 'ellipses', {ellipses})")


def _measured(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the counts that the rules are made of, of words and of lines in one projection each.

    Words and lines are only held as arrays while a row's counts are made; the
    heap of an executor grows with what is allocated for each word.
    """
    df = df.withColumn("_rule_t", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumns({"_rule_w": _bound(F.expr(_of_words())), "_rule_l": _bound(F.expr(_of_lines()))})
    symbols = F.regexp_count(F.col("_rule_t"), F.lit("[#*$%&|<>]"))
    no_letter = F.regexp_count(F.col("_rule_t"), F.lit(r"(?:^|[\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]++(?![^\x20\x09-\x0D])"))
    counts = {
        "n_words": F.col("_rule_w.n"),
        "n_repeat_words": F.col("_rule_w.repeats"),
        "word_chars": F.col("_rule_w.chars"),
        "n_symbols": symbols,
        "n_lines": F.col("_rule_l.n"),
        "n_dup_lines": F.col("_rule_l.dups"),
        "n_stop_words": F.col("_rule_w.stops"),
        "n_alpha_words": F.col("_rule_w.n") - no_letter,
        "n_bullet_lines": F.col("_rule_l.bullets"),
        "n_ellipsis_lines": F.col("_rule_l.ellipses"),
    }
    return df.withColumns({k: v.cast("long") for k, v in counts.items()}).drop("_rule_t", "_rule_w", "_rule_l")


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules as one boolean expression."""
    parts = [f"({MEASURES[r.measure]}) >= {r.low}D" for r in rules if r.low is not None] + [f"({MEASURES[r.measure]}) <= {r.high}D" for r in rules if r.high is not None]
    return F.expr(" AND ".join(parts) or "true")


def failed_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that a document fails, in the order of the table."""
    one = [F.when(~verdict((r,)), F.lit(r.name)) for r in rules]
    return F.filter(F.array(*one), lambda x: x.isNotNull())


def apply_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """df with measures, base_failed, kept and the names of failed rules."""
    base = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    return _measured(df, text).withColumn("base_failed", base).withColumn("kept", _bound(~F.col("base_failed") & verdict(rules))).withColumn("failed_rules", failed_rules(rules))


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*COLUMNS)


def filter_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, with their own columns only."""
    keep = docs.columns
    own = apply_rules(docs.select(F.struct(*docs.columns).alias("_row"), "text"))
    own = own.where("kept")
    return own.select(*[F.col("_row")[c].alias(c) for c in keep])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d
), m AS (
  SELECT doc_id, w, l, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         len(list_filter(w, lambda x: list_contains(STOPS, lower(x))))::BIGINT AS n_stop_words,
         len(list_filter(w, lambda x: regexp_matches(x, '\pL')))::BIGINT AS n_alpha_words,
         len(list_filter(l, lambda x: substr(ltrim(x), 1, 1) IN ('-', '*', '•', '‣', '·')))::BIGINT AS n_bullet_lines,
         len(list_filter(l, lambda x: rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…'))::BIGINT AS n_ellipsis_lines
  FROM w
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i+2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, n_words - 1)) AS i FROM m WHERE n_words >= 3)
), c AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g
), r AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM c WHERE n > 1) GROUP BY doc_id
), b AS (
  SELECT m.*, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN r USING (doc_id)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND RULES AS kept
FROM f
""".replace("STOPS", "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]").replace(
    "RULES",
    " AND ".join(
        [f"({MEASURES[r.measure].replace(' / ', ' * 1.0 / ')}) >= {r.low}" for r in RULES if r.low is not None]
        + [f"({MEASURES[r.measure].replace(' / ', ' * 1.0 / ')}) <= {r.high}" for r in RULES if r.high is not None]
    ),
)
