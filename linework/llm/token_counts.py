"""Token counts by byte-pair merging with a heap over a linked list.

Only counts are needed, so no identifier is looked up: a word starts as one symbol for each
byte, the lowest-ranked adjacent pair is merged until none is left, and the count is the number
of initial symbols less the number of merges. Counts of words are kept in a bounded memo in each
Python worker, because natural text repeats its words.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Unicode white space, spelled out so that every regex engine means the same.
SPACE = r"\t-\r \x85\xa0  -     　"
#: The public byte-level pattern that splits text before the merges.
SPLIT = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: A place where a word surely begins: one blank between something visible and a letter.
SAFE = regex.compile(rf"(?<=[^{SPACE}]) (?=\p{{L}})")
#: Texts longer than this are split in pieces at safe places to bound the list of words.
PIECE = 1 << 20
#: Words remembered in a worker; then the memo starts anew.
MEMO = 600_000
#: White space before a blank.
RUNS = [chr(c) + " " for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Merges:
    """The merges of a tokenizer file over small integers: ``rank[a << 20 | b]`` of a pair, ``whole[rank]``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.added = [t["content"] for t in made["added_tokens"]]
        number = {letter: byte for byte, letter in enumerate(byte_letters())}
        self.rank: dict[int, int] = {}
        self.whole: list[int] = []
        for rank, (a, b) in enumerate(made["model"]["merges"]):
            self.rank[number[a] << 20 | number[b]] = rank
            self.whole.append(number.setdefault(a + b, len(number)))

    def count(self, word: bytes) -> int:
        """Symbols left of the bytes after all merges, the lowest rank first and, among equals, the leftmost."""
        symbols, rank, whole, n = list(word), self.rank, self.whole, len(word)
        heap = [r * n + i for i in range(n - 1) if (r := rank.get(symbols[i] << 20 | symbols[i + 1])) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        after, before, merges = [*range(1, n), -1], [*range(-1, n - 1)], 0
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            a, j = symbols[i], after[i]
            # Stale entries: the pair at i is no longer the one that was pushed.
            if a < 0 or j < 0 or rank.get(a << 20 | symbols[j]) != r:
                continue
            symbols[j] = -1
            symbols[i] = a = whole[r]
            merges += 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (s := rank.get(a << 20 | symbols[k])) is not None:
                    heapq.heappush(heap, s * n + i)
            h = before[i]
            if h >= 0 and (s := rank.get(symbols[h] << 20 | a)) is not None:
                heapq.heappush(heap, s * n + h)
        return n - merges


class Memo(dict):
    """Remembers what ``find`` gave for short keys; starts anew when full."""

    def __init__(self, find: Callable[[str], object], most: int = MEMO):
        super().__init__()
        self.find, self.most = find, most

    def __missing__(self, key: str):
        if len(self) >= self.most:
            self.clear()
        found = self.find(key)
        if len(key) <= 64:
            self[key] = found
        return found


@functools.lru_cache(maxsize=4)
def counter(path: str) -> Callable[[str], int]:
    merges = Merges(path)
    counts, added = Memo(lambda word: merges.count(word.encode())), merges.added
    special = regex.compile("|".join(regex.escape(x) for x in sorted(added, key=len, reverse=True))) if added else None

    def plain(text: str) -> int:
        total = at = 0
        while len(text) - at > PIECE:
            cut = SAFE.search(text, at + PIECE)
            if not cut:
                break
            total += sum(map(counts.__getitem__, SPLIT.findall(text, at, cut.start())))
            at = cut.start()
        return total + sum(map(counts.__getitem__, SPLIT.findall(text[at:] if at else text)))

    # A blank that follows something visible begins a word, so texts without other white space
    # before a blank fall apart at their blanks, and what stands between two of them is remembered.
    blanks = Memo(lambda part: plain(" " + part))

    def parts(text: str) -> int:
        if len(text) > 8 * PIECE or any(run in text for run in RUNS) or text[:1] == " ":
            return plain(text)
        first, *rest = text.split(" ")
        return plain(first) + sum(map(blanks.__getitem__, rest))

    def count(text: str) -> int:
        if special is None or not special.search(text):
            return parts(text)
        pieces = special.split(text)
        return len(pieces) - 1 + sum(map(parts, pieces))

    return count


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 1024,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row; one pass, no shuffle.

    ``tokenizer`` is the path of a byte-level BPE file that every executor can open. The strings
    of added tokens count as one token each wherever they stand in a text. Null and empty texts
    have no bytes and no tokens; repeated rows each give a row; other columns are ignored; an
    empty table gives an empty table.
    """
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(count, texts), pa.int64(), size=len(texts)), pa.array([len(t.encode()) for t in texts], pa.int64())], ["id", "n_tokens", "n_bytes"])

    out = StructType([StructField("id", kind), StructField("n_tokens", LongType()), StructField("n_bytes", LongType())])
    return rows.mapInArrow(run, out).select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
