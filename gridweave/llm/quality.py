"""Quality rules: a table of thresholds compiled into one Spark projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.mixing import WORD

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is was for that with as on by this are "
    "der die das und zu den mit von ist des ein eine nicht im "
    "le la les de des et un une que pour dans est au par "
    "el los las y en por con para del una se como"
).split()
#: (rule, measure, comparison that a document must meet, threshold).
RULES = [
    ("symbols", "symbol_ratio", "<=", 0.1),
    ("word_length_low", "mean_word_length", ">=", 2.0),
    ("word_length_high", "mean_word_length", "<=", 14.0),
    ("stop_words", "stop_ratio_if_long", ">=", 0.05),
    ("repeated_lines", "dup_line_ratio", "<=", 0.5),
]
#: Texts of fewer words may lack function words.
LONG = 30
WINDOW = 5


def with_repeated_words(df: DataFrame, windows: str, out: str, width: int = WINDOW) -> DataFrame:
    """Add ``out``: words covered by windows, given by their hashes in order, that occur twice or more.

    Each step is a projection of its own, since a lambda evaluates what it refers to at every
    element; only texts in which a hash repeats (others pass as null) are sorted.
    """
    df = df.withColumn(out, F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    at = F.col(out)
    twin = lambda x, k: ((k > 0) & (F.get(at, k - 1)["h"] == x["h"])) | F.coalesce(F.get(at, k + 1)["h"] == x["h"], F.lit(False))
    df = df.withColumn(out, F.array_sort(F.transform(F.filter(at, twin), lambda x: x["i"])))
    gaps = F.zip_with(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), at, lambda b, a: F.coalesce(F.least(b - a, F.lit(width)), F.lit(width)))
    return df.withColumn(out, F.coalesce(F.aggregate(gaps, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long"))


def stop_pattern(words=STOP_WORDS) -> str:
    """Matches each stop word that stands alone, in lower case or with a capital, by its first letter."""
    by_letter: dict[str, set[str]] = {}
    for w in words:
        by_letter.setdefault(w[0], set()).add(w[1:])
    own = "|".join(f"[{c.upper()}{c}](?:{'|'.join(sorted(rest))})" for c, rest in sorted(by_letter.items()))
    return rf"(?<![^\x20\x09-\x0D])(?:{own})(?![^\x20\x09-\x0D])"


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts and ratios that rules speak of, by projections without user functions."""
    text = F.coalesce(F.col("text"), F.lit(""))
    stop = F.lit(stop_pattern())
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = base.select(
        "doc_id",
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
        F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0).alias("lines"),
        F.regexp_count(text, stop).cast("long").alias("n_stop_words"),
    )
    window = F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(WINDOW)]))
    base = base.select(
        "doc_id", "word_chars", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_stop_words",
        F.when(F.size("words") >= WINDOW, window).alias("windows"),
    )
    base = with_repeated_words(base, "windows", "n_repeat_words").drop("windows")
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return base.withColumns({"stop_ratio_if_long": F.when(F.col("n_words") < LONG, F.lit(1.0)).otherwise(ratio("n_stop_words", "n_words")), "symbol_ratio": ratio("n_symbols", "n_words"), "mean_word_length": ratio("word_chars", "n_words"), "dup_line_ratio": ratio("n_dup_lines", "n_lines")})


def compile_rules(rules=RULES) -> Column:
    """One boolean column from a threshold table: true where every rule holds."""
    ops = {"<=": lambda c, x: c <= x, ">=": lambda c, x: c >= x, "<": lambda c, x: c < x, ">": lambda c, x: c > x}
    verdict = F.lit(True)
    for _, measure, op, threshold in rules:
        verdict = verdict & ops[op](F.col(measure), F.lit(threshold))
    return verdict


def quality(docs: DataFrame, rules=RULES, **columns) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` of each row of ``docs``.

    A null or empty text has no words, so it fails the base. Each row is by itself: repeated rows
    give repeated results, an empty table an empty one; other columns are not read.
    """
    m = measures(docs, **columns)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return m.withColumn("base_failed", failed).withColumn("kept", ~failed & compile_rules(rules))
