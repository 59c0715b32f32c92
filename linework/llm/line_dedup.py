"""Substring dedup by hashing lines and the sentences in them.

Units are lines, cut after each sentence (or whole lines). A unit is normalised (lower case, its
words with one blank between two) and hashed; over all documents the earliest occurrence by
(rank, place) is kept and every later one repeats it. Short units repeat by chance, so what goes
are stretches of neighbouring repeated units that have ``least_words`` words in all. The places of
what goes are kept as offsets in the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, arrow_rows, pa_type, stored

#: Pieces into which the occurrences of one digest are dealt when its first place is joined back.
SALT = 8
#: Words of the shortest stretch that goes.
LEAST_WORDS = 30
_WORD = re.compile(WORD)
#: A sentence ends before a blank; the blank becomes the break, so offsets stay.
_SENTENCE = re.compile(r"([.!?])[\x20\t]")


def units(text: str, sentences: bool = True) -> list[np.ndarray]:
    """Place, start, end, number of words and 64 and 32 bits of the digest of each unit with a word."""
    made, start = [], 0
    for unit in (_SENTENCE.sub("\\1\n", text) if sentences else text).split("\n"):
        words = _WORD.findall(unit)
        if words:
            digest = xxhash.xxh3_128_intdigest(" ".join(words).lower().encode("utf-8", "surrogatepass"))
            made.append((start, start + len(unit), len(words), digest >> 64, digest & 0xFFFFFFFF))
        start += len(unit) + 1
    if not made:
        return []
    starts, ends, words, high, low = zip(*made)
    return [*[np.array(x, np.int32) for x in (range(len(made)), starts, ends, words)], np.array(high, np.uint64).view(np.int64), np.array(low, np.uint32).view(np.int32)]


def unit_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sentences: bool = True) -> DataFrame:
    """(doc, copy, place, start, end, words, h, g) of each unit; ``copy`` is a hash of the text. One pass, no shuffle."""
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("copy"), F.col(text_col).alias("text"))
    kinds = [pa_type(rows, "doc"), pa.int64()]
    names = ["doc", "copy", "place", "start", "end", "words", "h", "g"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for batch in batches:
                for doc, copy, text in zip(*batch.columns):
                    got = units(text.as_py(), sentences)
                    if got:
                        yield (doc.as_py(), copy.as_py()), got

        yield from arrow_rows(made(), names, kinds)

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, copy long, place int, start int, end int, words int, h long, g int")


def repeated_units(every: DataFrame) -> DataFrame:
    """(doc, copy, place, start, end, words, later) of each unit that stands elsewhere too.

    ``later`` is false for the earliest by (doc, copy, place). Only digests that occur again are
    joined back, and the places of a digest are dealt over ``SALT`` keys, so one very common unit
    does not meet in one task.
    """
    own = F.struct("doc", "copy", "place")
    again = (
        every.groupBy("h", "g").agg(F.min(own).alias("first"), F.max(own).alias("last")).filter(~F.col("first").eqNullSafe(F.col("last")))
        .select("h", "g", "first", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    )
    salted = every.withColumn("salt", F.pmod(F.xxhash64("doc", "copy", "place"), F.lit(SALT)).cast("int"))
    return salted.join(again, ["h", "g", "salt"]).select("doc", "copy", "place", "start", "end", "words", (~own.eqNullSafe(F.col("first"))).alias("later"))


def stretches(found: DataFrame, least_words: int) -> DataFrame:
    """(doc, copy, n_shared, spans) of the neighbouring units with ``least_words`` words in all.

    ``n_shared`` counts units of such stretches of repeated units, kept or not; ``spans`` are the
    (start, end) of the units of such stretches of later occurrences. The units of a text meet in
    one task, as its text does.
    """
    text = ["doc", "copy"]
    rows = found.repartition(*text).dropDuplicates([*text, "place"])
    # Neighbours have the same difference of place and rank.
    rows = rows.withColumn("all", F.col("place") - F.row_number().over(Window.partitionBy(*text).orderBy("place")))
    rows = rows.withColumn("own", F.col("place") - F.row_number().over(Window.partitionBy(*text, "later").orderBy("place")))
    rows = rows.withColumn("all", F.sum("words").over(Window.partitionBy(*text, "all")) >= least_words)
    rows = rows.withColumn("own", F.col("later") & (F.sum("words").over(Window.partitionBy(*text, "later", "own")) >= least_words))
    return rows.filter("all").groupBy(*text).agg(F.count(F.lit(1)).alias("n_shared"), F.array_sort(F.collect_list(F.when(F.col("own"), F.struct("start", "end")))).alias("spans"))


def without_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sentences: bool = True, least_words: int = LEAST_WORDS, with_text: bool = False
) -> DataFrame:
    """(id, n_removed, removed_chars, removed, n_shared): spans ``start:end`` in the original text, comma-joined.

    ``n_removed`` counts the units that go, ``n_shared`` those of all repeated stretches, also
    where this document has the first of them and keeps it. Every row gives a row; one without
    repeats has no spans. Null and empty texts have no units. Rows of one id and one text are one
    document; of one id and different texts, different ones, ranked by a hash of the text. Null
    ids come first. Other columns are ignored. With ``with_text``, ``clean_text`` has what stays.
    """
    every = stored(unit_table(docs, id_col=id_col, text_col=text_col, sentences=sentences))
    found = stretches(repeated_units(every), least_words).withColumnsRenamed({"doc": "_doc", "copy": "_copy"})
    base = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("copy"), *([F.col(text_col).alias("text")] if with_text else []))
    out = base.join(found, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("copy") == F.col("_copy")), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))
    columns = [
        F.col("doc").alias(id_col), F.size(spans).cast("long").alias("n_removed"),
        F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("removed_chars"),
        F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))).alias("removed"),
        F.coalesce("n_shared", F.lit(0)).alias("n_shared"),
    ]
    if with_text:
        columns.append(cut(F.col("text"), spans).alias("clean_text"))
    return out.select(*columns)


def cut(text: Column, spans: Column) -> Column:
    """The text without the spans and the break that follows each."""
    kept = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda a, s: F.struct((s["end"] + 1).alias("at"), F.concat(a["parts"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]))).alias("parts")),
        lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, a["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) == 0, text).otherwise(kept)
