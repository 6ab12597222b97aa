"""Quality rules, line first (DataFrame functions only).

Each line is judged on its own: punctuation, navigation, boilerplate and shouting. Failing lines are
removed; a document that loses too much of its text is rejected. Counts of repetition in the whole text
come first (``base_failed``).

Defined results: a null text counts as empty and fails for having too few words; repeated rows are
judged separately; an empty table gives an empty result; other columns pass through untouched, and
columns that clash with a result are replaced. Very long texts and lines are judged whole, in time in proportion to their length:
each pattern begins only where a stretch of its kind begins, and tries it once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: A line of prose ends like this; shorter lines that do not are headings, menu items or fragments.
ENDS = r"[.!?:;,…\"')\]»”“。][\x20\x09-\x0D]*$"
#: Words that carry a symbol at their end, one after the other, or a row of cells.
SYMBOL_ROW = r"([#*$%&<>]{2,}[\x20\x09]+[^\x20\x09-\x0D]+){3}"
MENU_ROW = r"([\x20\x09][|›»>•·][\x20\x09][^|›»>•·]*){3}"
SHOUTED = r"(\p{Lu}[\p{Lu}\p{P}]*[\x20\x09]+){4}\p{Lu}[\p{Lu}\p{P}]*"
BOILERPLATE = (
    r"(?i)all rights reserved|cookie|javascript|terms of (use|service)|privacy policy|lorem ipsum|click here|read more|"
    r"subscribe (now|to)|sign up|log ?in\b|share (this|on)|follow us|powered by|©")


#: The first and the third in a form for engines that backtrack.
SYMBOL_ROW_ONCE = r"[#*$%&<>]{2}[\x20\x09]++(?:[^\x20\x09-\x0D]++(?<=[^\x20\x09-\x0D][#*$%&<>]{2})[\x20\x09]++){2}[^\x20\x09-\x0D]"
SHOUTED_ONCE = r"(?<![\p{Lu}\p{P}])\p{P}*+(?:\p{Lu}[\p{Lu}\p{P}]*+[\x20\x09]++){4}\p{Lu}"


def bad_line(line: Column, min_words: int = 5) -> Column:
    """Whether a line (with a word in it) fails a rule."""
    few = ~line.rlike(rf"^[\x20\x09-\x0D]*+(?:{WORD}+[\x20\x09-\x0D]++){{{min_words - 1}}}{WORD}")
    return (
        (few & ~line.rlike(ENDS))
        | line.rlike(SYMBOL_ROW_ONCE)
        | line.rlike(MENU_ROW)
        | line.rlike(SHOUTED_ONCE)
        | line.rlike(BOILERPLATE))


def repeated_words(hashes: Column, order: Column) -> tuple[Column, Column]:
    """The two later steps of counting words in repeated windows: (sorted pairs, count from such pairs)."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda i, j: F.coalesce(F.get(order, j)["h"] == F.get(order, i)["h"], F.lit(False))
    twice = F.filter(order, lambda x, i: same(i, i + 1) | same(i, i - 1))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    start = F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n"))
    walk = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(5), p - acc["last"])).alias("n"))
    return pairs, F.aggregate(places, start, walk, lambda acc: acc["n"])


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10, max_repeat_pct: int = 20, max_lost: float = 0.5) -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, clean_text, base_failed, kept``.

    ``clean_text`` has the lines that pass. ``base_failed``: fewer than ``min_words`` words, or more than
    ``max_repeat_pct`` percent of them in repeated 5-word windows. ``kept`` is false then, or when the removed
    lines hold more than ``max_lost`` of the characters in words.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "clean_text", "base_failed", "kept"]
    rest = [c for c in docs.columns if c not in made]
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(*rest, F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)).alias("_words"))
    n = F.size("_words").cast("long")
    window = lambda i: F.xxhash64(*[F.get(F.col("_words"), i + k) for k in range(5)])
    d = d.select(
        *rest, n.alias("n_words"), F.length(F.concat_ws("", "_words")).cast("long").alias("word_chars"),
        F.when(n >= 5, F.transform(F.sequence(F.lit(0), F.size("_words") - 5), window)).alias("_h"))
    pairs, _ = repeated_words(F.col("_h"), F.col("_h"))
    # most texts repeat no window; only the others are sorted
    d = d.select(*rest, "n_words", "word_chars", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.col("_h")).alias("_h"))
    d = d.select(*rest, "n_words", "word_chars", F.when(F.col("_h").isNotNull(), pairs).alias("_pairs"))
    _, covered = repeated_words(F.col("_pairs"), F.col("_pairs"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    has_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    d = d.select(
        *rest, "n_words", "word_chars", F.when(F.col("_pairs").isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOL, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n", -1), has_word).alias("_lines"))
    d = d.withColumn("_good", F.filter("_lines", lambda x: ~bad_line(x)))
    d = d.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    d = d.withColumn("clean_text", F.concat_ws("\n", "_good"))
    left = F.length(F.regexp_replace("clean_text", r"[\x20\x09-\x0D]+", ""))
    d = d.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words")))
    d = d.withColumn("kept", ~F.col("base_failed") & (left >= (1 - max_lost) * F.col("word_chars")))
    return d.select(*rest, *made)
