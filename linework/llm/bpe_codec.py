"""BPE encoding and decoding, with tree concatenation for long unsplit text.

Text is normalised and split in words. A short word is merged directly and remembered. A long
one (no place to split it) is cut in halves down to leaves, each half is encoded on its own, and
a join is mended by encoding a window of symbols around it anew: the window grows, a token at a
time on both sides, until its first and last tokens are the ones that the halves had there. Then
every adjacent pair of tokens is one that merging would leave apart, and so the joined sequence
is exactly the encoding of the whole.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import give_back
from .token_counts import SPACE, Memo, byte_letters

#: The split pattern of the word tokenizer; only what it matches is kept.
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
#: Symbols in a leaf of the tree; words of up to so many are merged directly.
LEAF = 48
#: Words, and stretches between blanks, whose ids a worker remembers.
MEMO = 250_000
END = "</w>"


NONE = 1 << 60


def merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """All merges, always the leftmost of the lowest rank that is left; for short lists."""
    left = [ranks.get(pair, NONE) for pair in zip(symbols, symbols[1:])]
    while left:
        rank = min(left)
        if rank == NONE:
            break
        at = left.index(rank)
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        del left[at]
        if at < len(left):
            left[at] = ranks.get((symbols[at], symbols[at + 1]), NONE)
        if at:
            left[at - 1] = ranks.get((symbols[at - 1], symbols[at]), NONE)
    return symbols


class Codec:
    def __init__(self, path: str, memo: int = MEMO):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model = made["model"]
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(model["merges"])}
        self.ids = dict(model["vocab"]) | {t["content"]: t["id"] for t in made["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()}
        self.end = model["end_of_word_suffix"] or ""
        self.letters = byte_letters()
        self.special = re.compile("(" + "|".join(re.escape(t["content"]) for t in made["added_tokens"]) + ")")
        self.memo, self.words, self.parts = memo, Memo(self._word, memo), Memo(self._part, memo)
        self.leaves: dict[tuple[str, ...], tuple[str, ...]] = {}

    def tree(self, symbols: list[str]) -> list[str]:
        """Tokens of a word of any length; ``symbols`` are its letters, the last with the suffix."""
        parts = [self._leaf(symbols[i : i + LEAF]) for i in range(0, len(symbols), LEAF)]
        while len(parts) > 1:
            parts = [self.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def _leaf(self, symbols: list[str]) -> list[str]:
        key = tuple(symbols)
        if (known := self.leaves.get(key)) is None:
            if len(self.leaves) >= self.memo // 10:
                self.leaves.clear()
            known = self.leaves[key] = tuple(merged(symbols, self.ranks))
        return list(known)

    def _letters(self, token: str) -> list[str]:
        return [*token[: -len(self.end) - 1], token[-len(self.end) - 1 :]] if self.end and token.endswith(self.end) and len(token) > len(self.end) else [*token]

    def join(self, left: list[str], right: list[str]) -> list[str]:
        """The encoding of the concatenation of what ``left`` and ``right`` encode."""
        a = b = 1
        while True:
            window = [s for t in (*left[-a:], *right[:b]) for s in self._letters(t)]
            again = merged(window, self.ranks)
            fits_left, fits_right = a > len(left) or again[0] == left[-a], b > len(right) or again[-1] == right[b - 1]
            if fits_left and fits_right:
                return left[: max(0, len(left) - a)] + again + right[b:]
            a += not fits_left
            b += not fits_right

    def _word(self, word: str) -> tuple[int, ...]:
        symbols = [self.letters[b] for b in word.encode("utf-8")]
        symbols[-1] += self.end
        tokens = merged(symbols, self.ranks) if len(symbols) <= LEAF else self.tree(symbols)
        return tuple(map(self.ids.__getitem__, tokens))

    def _part(self, part: str) -> tuple[int, ...]:
        return tuple(i for w in WORDS.findall(normal(part)) for i in self.words[w])

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for k, piece in enumerate(self.special.split(text)):
            if k % 2:
                out.append(self.ids[piece])
            else:  # a blank always ends a word
                for ids in map(self.parts.__getitem__, piece.split(" ")):
                    out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """As the library does for a file without a decoder: tokens with a blank between two."""
        return " ".join(map(self.tokens.__getitem__, ids))

    def forget(self) -> None:
        self.words.clear()
        self.parts.clear()
        self.leaves.clear()
        give_back()


def normal(text: str) -> str:
    """Composed, and in lower case letter by letter (no final sigma). White space only separates words."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@functools.lru_cache(maxsize=1)
def codec(path: str, memo: int = MEMO) -> Codec:
    return Codec(path, memo)


def encode(docs: DataFrame, tokenizer: str, *, text_col: str = "text", ids_col: str = "ids", memo: int = MEMO) -> DataFrame:
    """All columns of ``docs`` and ``ids_col``, the whole text as token ids; one pass, no shuffle.

    A task remembers ``memo`` words at most and forgets them at its end.

    Null and empty texts give an empty array. A column that is already called ``ids_col`` is
    replaced. Repeated rows each give a row.
    """
    rows = docs.drop(ids_col)
    place = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer, memo)
        for part in pieces(batches):
            ids = [np.array(own.encode(t or ""), np.int32) for t in part.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], [*part.schema.names, ids_col])
        own.forget()

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(ids_col, ArrayType(IntegerType()))]))


def decode(encoded: DataFrame, tokenizer: str, *, ids_col: str = "ids", text_col: str = "text", memo: int = MEMO) -> DataFrame:
    """All columns and ``text_col``, decoded from ``ids_col``; a null array gives an empty text."""
    rows = encoded.drop(text_col)
    place = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer, memo)
        for part in pieces(batches):
            texts = [own.decode(a or []) for a in part.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, text_col])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(text_col, StringType())]))


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a few rows, so that a worker never holds the ids of many long texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def round_trip_digests(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each whole text, encoded and decoded in one pass.

    A null text counts as empty: no tokens, and the digests of the empty string. Repeated rows
    each give a row; other columns are ignored.
    """
    out = StructType([StructField("id", docs.schema[id_col].dataType), StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in batches:
            counts, sums, texts = [], [], []
            for text in batch.column(1).to_pylist():
                ids = own.encode(text)
                counts.append(len(ids))
                sums.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                texts.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(texts, pa.string())], out.names)

    return docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).mapInArrow(run, out).withColumnRenamed("id", id_col)
