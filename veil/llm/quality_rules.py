"""Quality rules: a threshold table compiled into one Spark projection.

All ratios (length, symbols, stop words, lines, repetition) are built-in expressions over the text;
there is no user function and no shuffle, so a document is judged where it is read. ``THRESHOLDS``
is data: each row names a ratio, the fewest words at which it is judged, and its bounds.

Defined results: a null text has no words, empty texts likewise (both fail the base rule); very long
texts are judged whole; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.llm._common import WORD, documents

#: The commonest function words of the corpus languages.
STOP_WORDS = [
    "a", "al", "an", "and", "at", "auf", "au", "be", "but", "by", "das", "dans", "de", "del", "dem", "den", "der",
    "des", "die", "du", "ein", "eine", "el", "en", "es", "est", "et", "for", "from", "have", "he", "ich", "il", "in",
    "is", "ist", "it", "la", "las", "le", "les", "los", "mit", "nicht", "no", "not", "of", "on", "or", "para", "pas",
    "por", "pour", "que", "qui", "se", "sich", "sie", "son", "su", "that", "the", "this", "to", "un", "una", "und",
    "une", "von", "was", "with", "y", "zu",
]

#: ratio, judged from so many words, least, most (None: no bound).
THRESHOLDS = [
    ("mean_word_chars", 10, 1.5, 15.0),
    ("symbols_per_word", 1, None, 0.1),
    ("shouts_per_word", 10, None, 0.25),
    ("upper_share", 10, None, 0.4),
    ("dup_line_share", 1, None, 0.4),
    ("distinct_word_share", 20, 0.05, None),
    ("stop_word_share", 60, 0.02, None),
]


def _let(value: Column, body) -> Column:
    """``body`` over a name bound to ``value``, which is then computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words covered by 5-word windows that occur twice or more: sort the windows' 64-bit hashes within
    the document and look at neighbours."""
    n = F.size(words)
    grams = F.transform(
        F.sequence(F.lit(0), n - 5),
        lambda i: F.struct(F.xxhash64(*[F.get(words, i + j) for j in range(5)]).alias("g"), i.alias("i")))

    def found(s: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(s) - 1)
        same = F.filter(at, lambda k: (F.get(s, k).getField("g").eqNullSafe(F.get(s, k - 1).getField("g")))
                        | (F.get(s, k).getField("g").eqNullSafe(F.get(s, k + 1).getField("g"))))
        return F.array_sort(F.transform(same, lambda k: F.get(s, k).getField("i")))

    def covered(p: Column) -> Column:
        state = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-5).alias("last"))
        return F.aggregate(
            p, state,
            lambda a, i: F.struct((a.getField("sum") + F.least(F.lit(5), i - a.getField("last")).cast("long"))
                                  .alias("sum"), i.alias("last")),
            lambda a: a.getField("sum"))

    return F.when(n < 6, F.lit(0).cast("long")).otherwise(_let(_let(F.array_sort(grams), found), covered))


def _counts(text: Column, words: Column, lines: Column) -> Column:
    """Struct of every count that the rules use."""
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeat_words(words).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.length(F.regexp_replace(text, r"[^!]+", "")).cast("long").alias("n_shouts"),
        F.length(F.regexp_replace(text, r"[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.size(F.array_distinct(words)).cast("long").alias("n_distinct_words"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
    )


def measures(df: DataFrame) -> DataFrame:
    """doc_id and every count that the rules use.

    Words and lines are bound to names before any lambda sees them, and the counts come out of a generator,
    through which no condition is pushed: a filter on the result evaluates nothing a second time.
    """
    counts = _let(F.coalesce(F.col("text"), F.lit("")), lambda text: _let(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda words: _let(
            F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)), lambda lines: _counts(text, words, lines))))
    return documents(df).select("doc_id", F.inline(F.array(counts)))


def _ratios() -> dict[str, Column]:
    def per(count: str, of: str) -> Column:
        return F.col(count).cast("double") / F.greatest(F.col(of), F.lit(1))

    return {
        "mean_word_chars": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "shouts_per_word": per("n_shouts", "n_words"),
        "upper_share": per("n_upper", "word_chars"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "distinct_word_share": per("n_distinct_words", "n_words"),
        "stop_word_share": per("n_stop_words", "n_words"),
    }


def verdict(thresholds: list[tuple] = THRESHOLDS) -> Column:
    """True where every row of the table holds."""
    ratios, ok = _ratios(), F.lit(True)
    for name, from_words, least, most in thresholds:
        r = ratios[name]
        inside = F.lit(True)
        if least is not None:
            inside = inside & (r >= least)
        if most is not None:
            inside = inside & (r <= most)
        ok = ok & ((F.col("n_words") < from_words) | inside)
    return ok


def quality_rules(df: DataFrame, thresholds: list[tuple] = THRESHOLDS) -> DataFrame:
    """Every count, ``base_failed``, ``kept`` and the names of the rules that a document breaks."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    broken = F.filter(
        F.array(*[F.when(~verdict([row]), F.lit(row[0])) for row in thresholds]), lambda x: x.isNotNull())
    return (measures(df).withColumn("base_failed", base).withColumn("broken_rules", broken)
            .withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0)))


def threshold_sql(thresholds: list[tuple] = THRESHOLDS) -> str:
    """The same table as an SQL condition over the counts."""
    ratios = {
        "mean_word_chars": "word_chars / greatest(n_words, 1)",
        "symbols_per_word": "n_symbols / greatest(n_words, 1)",
        "shouts_per_word": "n_shouts / greatest(n_words, 1)",
        "upper_share": "n_upper / greatest(word_chars, 1)",
        "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
        "distinct_word_share": "n_distinct_words / greatest(n_words, 1)",
        "stop_word_share": "n_stop_words / greatest(n_words, 1)",
    }
    parts = []
    for name, from_words, least, most in thresholds:
        r = f"({ratios[name]})"
        inside = " AND ".join([f"{r} >= {least}"] * (least is not None) + [f"{r} <= {most}"] * (most is not None))
        parts.append(f"(n_words < {from_words} OR ({inside}))")
    return " AND ".join(parts)
