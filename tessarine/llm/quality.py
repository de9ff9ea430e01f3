"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "as", "with", "be", "by", "this", "are", "from", "at",
    "de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "est", "dans", "que", "qui", "pour", "par", "sur", "au", "pas", "avec",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch",
    "el", "los", "se", "del", "las", "con", "una", "su", "al", "es", "lo", "como", "más", "o", "pero", "sus", "para", "no", "y", "por",
)


@dataclass(frozen=True)
class Rule:
    """A document passes when ``low <= numerator / denominator <= high``; a zero denominator fails."""

    name: str
    numerator: str
    denominator: str
    low: float
    high: float


#: Thresholds in the manner of published web-corpus filters, over whole texts.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbol_ratio", "n_symbols", "n_words", 0.0, 0.2),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 0.02, 1.0),
    Rule("upper_ratio", "n_upper", "word_chars", 0.0, 0.4),
    Rule("shout_ratio", "n_shouts", "n_words", 0.0, 0.2),
    Rule("dup_line_ratio", "n_dup_lines", "n_lines", 0.0, 0.4),
    Rule("repeat_word_ratio", "n_repeat_words", "n_words", 0.0, 0.5),
)


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: as a lambda variable it is not repeated inside inner lambdas."""
    return F.transform(F.array(value), use)[0]


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def repeat_words(words: Column) -> Column:
    """Words inside any 3-word window that occurs at least twice. Windows are compared by 64-bit hash."""

    def of_windows(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(covered(windows))

    def covered(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = bind(placed, lambda s: F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])))
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        gaps = bind(starts, lambda p: F.transform(p, lambda at, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - at, F.lit(3)))))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    def hashed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(bind(words, lambda w: bind(hashed(w), of_windows))).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that rules refer to; a null text counts as one without words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stage = docs.select("doc_id", text.alias("_text"), word_array(text).alias("_words"), lines.alias("_lines"))
    bare = F.regexp_replace("_text", BLANKS, "")
    return stage.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        cut_of(bare, SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_words")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(*dict.fromkeys(STOP_WORDS)))).cast("long").alias("n_stop_words"),
        cut_of(bare, r"\p{Lu}+").alias("n_upper"),
        cut_of(bare, r"!+").alias("n_shouts"),
    )


def cut_of(text: Column, pattern: str) -> Column:
    """Characters of ``text`` that ``pattern`` matches."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def passes(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table compiled: one boolean of comparisons, without division."""
    verdict = F.lit(True)
    for r in rules:
        over = F.col(r.denominator)
        verdict = verdict & (over > 0) & (F.col(r.numerator) >= r.low * over) & (F.col(r.numerator) <= r.high * over)
    return verdict


def quality_verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the measures, base_failed, kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text; a null, empty or blank text has none, so base_failed is true.
    Null doc_ids and repeated rows are judged like any other row; other columns are ignored.
    """
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = measures(docs).withColumn("base_failed", base)
    return found.withColumn("kept", ~F.col("base_failed") & passes(rules))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows of ``docs`` whose text passes; every column stays."""
    names = docs.columns
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("doc_id"), "text")
    return quality_verdicts(whole, rules).filter("kept").select("doc_id.*")
