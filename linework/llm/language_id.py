"""Language identification in two steps: the language family, then the language within it.

Features are hashed character trigrams of the whole text, letters only, in lower case. Families
are told apart, and languages within each family, by linear support vector machines, one for
each pair; the pairs vote, and a tie goes to the larger sum of margins. All machines are fitted
side by side, a task for each, on a sample of bounded size (``SAMPLE``, ``LANGUAGES``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

# Families of languages by ISO 639-1 code; a language that is not here is its own family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "indo-aryan": ("hi", "bn", "ur", "pa", "mr", "gu", "ne"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
    "semitic": ("ar", "he", "am", "mt"),
    "sinitic": ("zh", "yue"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

#: Hashed trigrams.
SIZE = 2048
#: Labelled rows that are learned from, for each language, in expectation.
SAMPLE = 1000
#: Languages that are learned, those with the most labelled rows.
LANGUAGES = 200
#: Characters and rows that are hashed at once.
CHUNK, ROWS = 1 << 18, 256
#: Weight of the squared norm, and steps, of a fit.
REGULAR, FIT_STEPS = 1e-4, 200
#: How steeply a margin becomes a score.
SLOPE = 2.0
UNKNOWN = "und"

_letters = np.zeros(0, bool)


def _is_letter() -> np.ndarray:
    global _letters
    if not len(_letters):
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(len(texts), SIZE) square roots of the shares of hashed trigrams, and whether there is a letter."""
    letter = _is_letter()
    out, some = np.zeros((len(texts), SIZE), np.float32), np.zeros(len(texts), bool)
    row, held, total = 0, [], 0

    def flush(first: int) -> None:
        sizes = np.array([len(t) for t in held])
        code = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
        known = letter[code]
        owner = np.repeat(np.arange(len(held)), sizes)
        some[first : first + len(held)] = np.bincount(owner, weights=known, minlength=len(held)) > 0
        code = np.where(known, code, np.uint32(32))
        h = code[:-2] * np.uint32(0x9E3779B1) ^ code[1:-1] * np.uint32(0x85EBCA77) ^ code[2:] * np.uint32(0xC2B2AE3D)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F)
        h >>= np.uint32(32 - SIZE.bit_length() + 1)
        inside = (owner[:-2] == owner[2:]) & (known[:-2] | known[1:-1] | known[2:])
        counts = np.bincount(owner[:-2][inside] * SIZE + h[inside], minlength=len(held) * SIZE).reshape(len(held), SIZE)
        out[first : first + len(held)] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))

    for t in texts:
        held.append(" " + t.lower() + " ")  # so that the shortest text has a trigram
        total += len(t)
        if total > CHUNK or len(held) == ROWS:
            flush(row)
            row, held, total = row + len(held), [], 0
    if held:
        flush(row)
    return out, some


@dataclass
class Pairs:
    """Linear machines for all pairs of ``names``; positive margins are for the first of a pair."""

    names: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((SIZE, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def choose(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner and its least margin against any other."""
        if len(self.names) == 1:
            return np.zeros(len(x), int), np.full(len(x), np.inf)
        margins = x @ self.weights + self.bias
        votes, total = np.zeros((len(x), len(self.names))), np.zeros((len(x), len(self.names)))
        least = np.full((len(x), len(self.names)), np.inf)
        for k, (i, j) in enumerate(self.pairs):
            m = margins[:, k]
            for at, own in ((i, m), (j, -m)):
                votes[:, at] += own > 0
                total[:, at] += own
                least[:, at] = np.minimum(least[:, at], own)
        best = np.argmax(votes + 0.5 * np.tanh(total / 1e3), axis=1)
        return best, least[np.arange(len(x)), best]


@dataclass
class Model:
    families: Pairs | None
    languages: list[Pairs] = field(default_factory=list)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text, a few rows at a time."""
        names, scores = [], [np.zeros(0)]
        for k in range(0, len(texts), ROWS):
            got, score = self._predict(texts[k : k + ROWS])
            names += got
            scores.append(score)
        return names, np.concatenate(scores)

    def _predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        x, some = features(texts)
        names, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        if self.families is not None:
            family, outer = self.families.choose(x)
            for k, own in enumerate(self.languages):
                rows = np.flatnonzero((family == k) & some)
                if len(rows):
                    best, inner = own.choose(x[rows])
                    names[rows] = np.array(own.names, object)[best]
                    score[rows] = 1 / (1 + np.exp(-SLOPE * np.clip(np.minimum(outer[rows], inner), -50, 50)))
        return names.tolist(), score


def sample(labelled: DataFrame, per_language: int, languages: int = LANGUAGES) -> tuple[DataFrame, list[str]]:
    """Rows of (id, text, lang) by a hash, about ``per_language`` of each language, or all; and the languages.

    Only the ``languages`` most frequent are learned, so a dirty column does not grow the model.
    """
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not counts:
        return labelled, []
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], int(min(1.0, per_language / r["n"]) * 2**62))])
    drawn = F.shiftrightunsigned(F.xxhash64("id", "text"), 2) < share[F.col("lang")]
    return labelled.filter(drawn), sorted(r["lang"] for r in counts)


def svm(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine for rows of norm 1 at most and y of 1 or -1.

    Least squared hinge loss by accelerated gradient steps; the two sides weigh the same.
    """
    side = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = ahead = np.zeros(x.shape[1] + 1, np.float32)
    momentum = 1.0
    for _ in range(FIT_STEPS):
        slack = np.maximum(0, 1 - y * (x @ ahead[:-1] + ahead[-1]))
        pull = -2 * side * y * slack
        grad = np.r_[x.T @ pull + REGULAR * ahead[:-1], pull.sum()]
        new = ahead - grad / np.float32(4 + REGULAR)  # the gradient changes by four times the step at most
        after = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        ahead = (new + np.float32((momentum - 1) / after) * (new - w)).astype(np.float32)
        w, momentum = new, after
    return w[:-1], float(w[-1])


def fit(labelled: DataFrame, per_language: int = SAMPLE) -> Model:
    """Learn from (id, text, lang) rows; ``per_language`` bounds the rows that are learned from."""
    rows, langs = sample(labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")), per_language)
    if not langs:
        return Model(None)
    family_of = {lang: FAMILY_OF.get(lang, lang) for lang in langs}
    families = sorted(set(family_of.values()))
    groups = [Pairs(families), *[Pairs([lang for lang in langs if family_of[lang] == name]) for name in families]]
    machines: list[tuple[int, int]] = []
    roles: dict[str, list[tuple[int, int]]] = {lang: [] for lang in langs}
    for g, own in enumerate(groups):
        own.pairs = list(combinations(range(len(own.names)), 2))
        own.weights, own.bias = np.zeros((SIZE, len(own.pairs)), np.float32), np.zeros(len(own.pairs), np.float32)
        for k, (i, j) in enumerate(own.pairs):
            for lang in langs:
                for at, sign in ((i, 1), (j, -1)):
                    if own.names[at] == (lang if g else family_of[lang]):
                        roles[lang].append((len(machines), sign))
            machines.append((g, k))
    if machines:
        for m, w, bias in _fitted(rows, roles):
            g, k = machines[m]
            groups[g].weights[:, k], groups[g].bias[k] = w, bias
    return Model(groups[0], groups[1:])


def _fitted(rows: DataFrame, roles: dict[str, list[tuple[int, int]]]) -> Iterator[tuple[int, np.ndarray, float]]:
    """Number, weights and bias of each machine; ``roles`` has the machines of a language and its side in each."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                x, _ = features(part.column(0).to_pylist())
                row, at = np.nonzero(x)
                edges = pa.array(np.searchsorted(row, np.arange(len(x) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(1), pa.ListArray.from_arrays(edges, pa.array(at.astype(np.int16))), pa.ListArray.from_arrays(edges, pa.array(x[row, at]))], ["lang", "at", "x"])

    def one(rows):
        import pandas as pd

        x = np.zeros((len(rows), SIZE), np.float32)
        for k, (at, values) in enumerate(zip(rows["at"], rows["x"])):
            x[k, at] = values
        w, bias = svm(x, rows["y"].to_numpy(np.float32))
        return pd.DataFrame({"m": [rows["m"].iloc[0]], "w": [w.tolist()], "bias": [bias]})

    literal = F.create_map(*[x for lang, own in roles.items() for x in (F.lit(lang), F.array(*[F.struct(F.lit(m).alias("m"), F.lit(y).alias("y")) for m, y in own]).cast("array<struct<m:int,y:int>>"))])
    dealt = rows.select("text", "lang").mapInArrow(vectors, "lang string, at array<short>, x array<float>").select(F.explode(literal[F.col("lang")]).alias("r"), "at", "x")
    for r in dealt.select("r.m", "r.y", "at", "x").groupBy("m").applyInPandas(one, "m int, w array<float>, bias double").collect():  # SIZE floats for each pair of names
        yield r["m"], np.array(r["w"], np.float32), r["bias"]


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "lang_score") -> DataFrame:
    """All columns of ``docs``, the language of the whole text, and a score from 0 to 1.

    ``und`` with score 0 for a null text, one without a letter, or where nothing was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def guess(texts):
        import pandas as pd

        names, scores = shared.value.predict(texts.tolist())
        return pd.DataFrame({"lang": pd.Series(names, dtype=object), "score": scores})

    held = "_guess" + "_" * max(map(len, docs.columns), default=0)  # longer than any name that is there
    guessed = docs.withColumn(held, guess(F.coalesce(F.col(text_col), F.lit(""))))
    return guessed.withColumns({lang_out: F.col(held)["lang"], score_out: F.col(held)["score"]}).drop(held)


def held_out(id_col: str, folds: int = 5):
    return fold(id_col, folds) == 0


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE) -> DataFrame:
    """(id, held_out, lang_pred, score) of each row.

    Learns from rows with a language whose id is not held out (crc32 of the id as text, mod 5,
    is 0). A null id is held out. Repeated rows each give a row; other columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = fit(own.filter(~held_out("id")), per_language)
    return predict(own.select("id", "text"), model, score_out="score").select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score")


