"""Line-first quality rules, in DataFrame functions alone.

Each line is judged by punctuation, navigation and boilerplate rules; failing lines go; a
document goes if too much of its text went with them, or if it fails the counts over the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, let, words_of

#: Words of a window for repetition.
WINDOW = 5
SYMBOLS = r"[#*$%&|<>»›•]"
# Phrases whose short lines are boilerplate.
BOILERPLATE = r"(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings)|we use cookies|enable javascript|lorem ipsum|skip to (main )?content|back to top|sign (in|up)|log ?in|subscribe to)"


def repeated_words(words: Column) -> Column:
    """Words that stand in windows of five found twice or more in ``words``."""

    def covered(hashes: Column) -> Column:
        # Equal windows stand together after sorting; a place is kept if a neighbour has its hash.
        runs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        nothing = F.lit(None).cast("struct<h:bigint,i:int>")

        def places(r: Column) -> Column:
            same = F.zip_with(r, F.concat(F.array(nothing), r), lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False)))
            both = F.arrays_zip(r.alias("r"), same.alias("a"), F.concat(F.slice(same, 2, F.size(r)), F.array(F.lit(False))).alias("b"))
            return F.sort_array(F.transform(F.filter(both, lambda z: z["r"].isNotNull() & (z["a"] | z["b"])), lambda z: z["r"]["i"]))

        return F.aggregate(
            let(runs, places), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end")),
            lambda a: a["n"],
        )

    def counted(w: Column) -> Column:
        n = F.size(w)
        hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(*[F.get(w, i - 1 + k) for k in range(WINDOW)]))
        again = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
        return F.when(n > WINDOW, again).otherwise(0).cast("long")

    return let(words, counted)


def line_fails(line: Column) -> Column:
    """True for a line that is punctuation, navigation, repetition or boilerplate; false for one without a word."""

    def judged(words: Column) -> Column:
        punctuation = ~line.rlike(r"\p{L}") | (words >= 3) & line.rlike(r"[!?]{2}") & (F.regexp_count(line, F.lit(r"[!?]{2,}")) * 4 > words)
        navigation = line.rlike(SYMBOLS) & (F.regexp_count(line, F.lit(SYMBOLS)) >= 2) & (F.regexp_count(line, F.lit(SYMBOLS)) * 4 > words)
        repeated = (words >= 6) & line.rlike(r"(?:^|[\x20\x09-\x0D])([^\x20\x09-\x0D]+)(?:[\x20\x09-\x0D]+\1){5}(?:$|[\x20\x09-\x0D])")
        boilerplate = (words <= 12) & line.rlike(BOILERPLATE)
        return (words > 0) & (punctuation | navigation | boilerplate | repeated)

    return let(F.regexp_count(line, F.lit(WORD)), judged)


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_lost: float = 0.5, with_text: bool = False) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_chars) of each row.

    ``kept`` is false if the base counts fail or if lines with more than ``most_lost`` of the
    characters of all words fail their rules. With ``with_text``, ``clean_text`` has the lines
    that passed. Null and blank texts have no words and fail. Repeated rows each give a row;
    other columns are ignored.
    """
    text = F.col("_text")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    lines = F.split(text, "\n", -1)
    chars = lambda part: F.length(F.regexp_replace(part, SPACES, ""))
    out = rows.select(
        "_id", "_text", words_of(text).alias("_words"), F.filter(lines, lambda x: x.rlike(WORD)).alias("_lines"),
        F.filter(lines, line_fails).alias("_bad"), *([F.filter(lines, lambda x: ~line_fails(x)).alias("_good")] if with_text else []),
    ).select(
        "_id", "_bad", *(["_good"] if with_text else []), F.size("_words").cast("long").alias("n_words"),
        F.aggregate("_words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    lost = F.aggregate("_bad", F.lit(0).cast("long"), lambda n, x: n + chars(x))
    out = out.withColumn("base_failed", failed).withColumn("lost_chars", lost)
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= most_lost * F.col("word_chars")))
    more = [F.array_join("_good", "\n").alias("clean_text")] if with_text else []
    return out.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars", *more)
