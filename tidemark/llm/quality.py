"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in expression over the whole text (no user function, no
shuffle): the query is a scan and a projection, whatever the size or skew of the input.

The query applies every threshold to every text, as its SQL does. The filtering stage doesn't
drop a text for two of them where they say nothing about quality: the upper bound of ``length``
(packing splits long texts), and ``stop_words`` where the list doesn't cover the text, because the column
``lang`` (if there is one) names another language or because fewer than half of its letters are Latin.

Defined results: a null text has no words (all counts 0, base_failed true); repeated
rows each get their own row; other columns of the input are ignored by ``op10_quality``
and kept by ``keep_good``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import table

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Languages of the stop words.
COVERED = ("en", "de", "fr", "es", "it")

#: Common function words of the languages served.
STOP_WORDS = (
    "a and are as at be by for from he in is it of on or that the this to was with "
    "an auf das dem den der die ein eine für im ist mit nicht sich und von zu "
    "au avec dans de des du elle en est et il la le les ou par pas pour que qui sur un une "
    "al como con del el es los las no para por se su una y"
).split()

#: (rule, measure, smallest, largest): a document keeps its place if every measure is in its range.
#: None: no bound on that side.
THRESHOLDS = [
    ("length", "n_words", MIN_WORDS, 1_000_000),
    ("word_length", "mean_word_chars", 2.0, 20.0),
    ("symbols", "symbol_ratio", None, 0.25),
    ("stop_words", "stop_ratio", 0.01, None),
    ("repeated_lines", "dup_line_ratio", None, 0.5),
    ("bullet_lines", "bullet_ratio", None, 0.9),
    ("ellipsis_lines", "ellipsis_ratio", None, 0.5),
]


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where lambdas refer to it often."""
    return F.transform(F.array(value), use)[0]


def _repeated(words: Column) -> Column:
    """Number of words inside 3-word windows that occur at least twice (64-bit hashes of windows).

    Plain hashes are sorted first; only where one repeats are the windows' places sorted with them.
    """
    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(w[i - 1], w[i], w[i + 1]))

    def again(h: Column) -> Column:
        ranked = F.sort_array(h)
        return _bind(ranked, lambda s: F.exists(F.sequence(F.lit(1), F.size(s) - 1), lambda k: F.get(s, k) == F.get(s, k - 1)))

    def twice(s: Column) -> Column:
        same = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"]))
                        | ((k < F.size(s) - 1) & (F.get(s, k + 1)["h"] == x["h"])))
        return F.size(F.array_distinct(F.flatten(F.transform(
            same, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def placed(h: Column) -> Column:
        return F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def count(h: Column) -> Column:
        return F.when(again(h), _bind(placed(h), twice)).otherwise(F.lit(0))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_bind(words, lambda w: _bind(hashes(w), count)))


def measure(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds the counts, the ratios and the verdicts as columns whose names begin with ``prefix``."""
    p = prefix
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({
        f"{p}words": F.array_remove(F.split(body, SPACE + "+"), ""),
        f"{p}lines": F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    })
    words, lines = F.col(f"{p}words"), F.col(f"{p}lines")
    df = df.withColumns({
        f"{p}n_words": F.size(words).cast("long"),
        f"{p}word_chars": (F.length(body) - F.regexp_count(body, F.lit(SPACE))).cast("long"),
        f"{p}n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
        f"{p}n_lines": F.size(lines).cast("long"),
        f"{p}n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        f"{p}n_repeat_words": _repeated(words).cast("long"),
        f"{p}n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
        f"{p}n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-*•]"))).cast("long"),
        f"{p}n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).cast("long"),
    }).drop(f"{p}words", f"{p}lines")
    n, k = F.col(f"{p}n_words"), F.col(f"{p}n_lines")

    def ratio(a: str, b: Column) -> Column:
        return F.when(b > 0, F.col(f"{p}{a}") / b).otherwise(F.lit(0.0))

    measures = {
        "n_words": n,
        "mean_word_chars": ratio("word_chars", n),
        "symbol_ratio": ratio("n_symbols", n),
        "stop_ratio": ratio("n_stop_words", n),
        "dup_line_ratio": ratio("n_dup_lines", k),
        "bullet_ratio": ratio("n_bullet_lines", k),
        "ellipsis_ratio": ratio("n_ellipsis_lines", k),
    }
    failed = []
    for rule, name, low, high in THRESHOLDS:
        bad = F.lit(False)
        if low is not None:
            bad = bad | (measures[name] < low)
        if high is not None:
            bad = bad | (measures[name] > high)
        failed.append(F.when(bad, F.lit(rule)))
    base = (n < MIN_WORDS) | (100 * F.col(f"{p}n_repeat_words") > MAX_REPEAT_PERCENT * n)
    return df.withColumns({
        f"{p}base_failed": base,
        f"{p}failed_rules": F.array_compact(F.array(*failed)),
    }).withColumn(f"{p}kept", ~F.col(f"{p}base_failed") & (F.size(f"{p}failed_rules") == 0))


def _uncovered(docs: DataFrame, body: Column) -> Column:
    """Whether the stop words don't cover a text's language, if it is given, or its script."""
    letters = F.regexp_count(body, F.lit(r"\p{L}"))
    by_script = 2 * F.regexp_count(body, F.lit(r"\p{IsLatin}")) < letters
    if "lang" not in docs.columns:
        return by_script
    lang = F.regexp_extract(F.lower(F.trim(docs["lang"].cast("string"))), "^[a-z]+", 0)
    return F.when(F.length(lang) > 0, ~lang.isin(*COVERED) | by_script).otherwise(by_script)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text passes every rule that applies to it, with the columns they came with.

    A row id beside the verdict holds the filter above the projection; pushed below it, the filter
    would spell out every measure as often as the rules refer to it.
    """
    failed = F.col("quality__failed_rules")
    excused = F.array_compact(F.array(
        F.when(F.array_contains(failed, "length") & (F.col("quality__n_words") >= MIN_WORDS), F.lit("length")),
        F.when(F.array_contains(failed, "stop_words") & _uncovered(docs, F.coalesce(docs[text], F.lit(""))), F.lit("stop_words"))))
    judged = measure(docs, text, "quality__") \
        .withColumn("quality__good", ~F.col("quality__base_failed") & (F.size(F.array_except(failed, excused)) == 0)) \
        .withColumn("quality__row", F.monotonically_increasing_id())
    return judged.where("quality__good and quality__row >= 0").select(*[docs[c] for c in docs.columns])


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document (contract columns first, then the failed rules)."""
    out = measure(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))
