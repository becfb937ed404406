"""Line-first quality rules, in built-in DataFrame functions alone (no shuffle, no Python on executors).

Method: each line is judged first (punctuation, navigation, boilerplate), failing lines are taken
out, and a document that loses too much of its text is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words, symbols, line separators of menus.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•"
TERMINALS = (".", "!", "?", "…", ":", ";", '"', "”", "»", ")", "'", "。")
BOILERPLATE = ("cookie", "javascript", "all rights reserved", "terms of use", "privacy policy", "lorem ipsum", "subscribe to our", "sign in to")


@dataclass(frozen=True)
class LineRules:
    """max_lost_percent: a document goes if more of its line characters than this were in failing lines."""

    symbol_percent: int = 5
    separators: int = 3
    shouts: int = 3
    upper_percent: int = 50
    boilerplate_chars: int = 200
    max_lost_percent: int = 30


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def failing_line(line: Column, rules: LineRules = LineRules()) -> Column:
    """True for a line (one that has a word) that breaks a rule."""
    size = F.length(line)
    upper = _count(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    last = F.right(F.rtrim(line, F.lit(SPACES)), F.lit(1))
    shouts = (size - F.length(F.replace(line, F.lit("!!"), F.lit("")))) / 2
    no_end = ~last.isin(*TERMINALS)
    symbols = _count(line, SYMBOLS) * 100 >= size * rules.symbol_percent
    shouting = (shouts >= rules.shouts) | ((upper * 100 > size * rules.upper_percent) & (size >= 20))
    menu = _count(line, SEPARATORS) >= rules.separators
    low = F.lower(line)
    phrase = F.lit(False)
    for words in BOILERPLATE:
        phrase = phrase | F.contains(low, F.lit(words))
    return no_end | symbols | shouting | menu | (phrase & (size <= rules.boilerplate_chars))


def quality_rules(df: DataFrame, text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """All columns of df, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept
    (boolean), lost_percent (double) and clean_text (the lines that passed).

    A null or empty text has no words: base_failed, not kept, clean_text ''.  Rows are judged one by one, so repeated
    rows get equal verdicts and an empty table gives an empty one; texts of any length are judged whole (a row must fit a
    task), and a text that loses exactly the allowed share stays.  Columns of df with one of these names are replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_percent", "clean_text"]
    keep = [F.col(f"`{c}`") for c in df.columns if c not in made]
    t, w, n, h, p = (F.col(f"__qr_{x}") for x in "twnhp")
    rows = df.select(*keep, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__qr_t"))
    rows = rows.withColumn("__qr_w", F.array_remove(F.split(t, "[\\x20\\x09-\\x0D]+"), ""))
    rows = rows.withColumn("__qr_l", F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0))
    rows = rows.withColumn("__qr_n", F.size(w))
    grams = F.transform(F.slice(w, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, w[i + 1], w[i + 2]))
    rows = rows.withColumn("__qr_h", grams)
    # only a text with a repeated window has them sorted
    ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    none = F.array().cast("array<struct<x:bigint,i:int>>")
    rows = rows.withColumn("__qr_p", F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(ordered))
    last = F.size(p) - 1
    same = lambda s, i: ((i > 0) & (F.get(p, i - 1)["x"] == s["x"])) | ((i < last) & (F.get(p, i + 1)["x"] == s["x"]))
    starts = F.sort_array(F.transform(F.filter(p, same), lambda s: s["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("c"), F.lit(-3).alias("z")),
        lambda a, s: F.struct((a["c"] + F.least(F.lit(3), s - a["z"])).alias("c"), s.alias("z")),
        lambda a: a["c"],
    )
    lines = F.col("__qr_l")
    rows = rows.withColumn("__qr_g", F.filter(lines, lambda x: ~failing_line(x, rules)))
    chars = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    rows = rows.withColumn("__qr_c", covered).withColumn("__qr_a", chars(lines)).withColumn("__qr_k", chars(F.col("__qr_g")))
    # a filter on the verdict must not be pushed below this line: it would write the whole chain out again and again
    rows = rows.withColumn("__qr_m", F.monotonically_increasing_id())
    total, good, c = F.col("__qr_a"), F.col("__qr_k"), F.col("__qr_c") + F.col("__qr_m").bitwiseAND(F.lit(0))
    failed = (n < 50) | (100 * c > 50 * n)
    return rows.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        _count(t, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        c.cast("long").alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & ((total - good) * 100 <= total * rules.max_lost_percent)).alias("kept"),
        F.when(total > 0, (total - good) * 100.0 / total).otherwise(F.lit(0.0)).alias("lost_percent"),
        F.array_join(F.col("__qr_g"), "\n").alias("clean_text"),
    )
