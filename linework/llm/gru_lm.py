"""A gated recurrent language model in numpy, trained and applied inside Spark tasks.

Words are counted over the whole corpus. The most frequent make the vocabulary, dealt by
frequency over classes; a word's probability is that of its class times that of the word within
it. The first class has the end and a place that all other words share; there their probability
is times their smoothed share of the counts of such words, so every text has a probability.

Each text is coded once, as places in the vocabulary, in the shared folder. Training is truncated
backpropagation over windows, with the state carried from one to the next; each partition trains
on its documents from the same start, and the weights are averaged by tokens, twice: first over a
part of the documents, then from there over the rest, so each is learned from once. Scoring
carries the state over windows to the end of a document. Documents stand one after another in
lanes of about one length, and the state is cleared where one begins.

What partitions learn depends on which documents they hold, so other partitions give slightly
other weights; counts and base scores don't depend on them.
"""

from __future__ import annotations

import ctypes
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fold, stored

#: Units of state; classes; words in each class but the first, which has the end and all words outside.
HIDDEN, CLASSES, PER = 16, 32, 64
EDGES = np.r_[0, 2 + PER * np.arange(CLASSES)]
VOCABULARY = int(EDGES[-1])
CLASS_OF = np.repeat(np.arange(CLASSES, dtype=np.int8), np.diff(EDGES))
#: Steps of a window; lanes of a batch.
STEPS, LANES = 16, 512
#: Tokens that a task gathers for a batch, in training and in scoring; places of a document in one lane in training.
TRAIN_TOKENS, SCORE_TOKENS, PIECE = 2_000_000, 6_000_000, 4096
RATE, CLIP = 0.15, 5.0
#: Most frequent words whose counts go to every task; the counts of the others are joined.
HOT = 200_000
#: Bytes of text that are split at once, to be counted and to be coded.
COUNT_BYTES, CODE_BYTES = 1 << 24, 1 << 22
#: The end of a document; no word is empty.
END = b""


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words in lower case (A-Z only) of texts without nulls, without the ends, and the text that each is in."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, owner = lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    some = pc.greater(pc.binary_length(words), 0)
    return words.filter(some), owner[some.to_numpy(zero_copy_only=False)]


def pieces(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have about ``most`` bytes; one text at least."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all rows of (text); each text has one end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 0, COUNT_BYTES):
                words, _ = tokens(part.column(0))
                counted = words.value_counts()
                yield pa.RecordBatch.from_arrays([
                    pa.concat_arrays([counted.field(0).cast(pa.binary()), pa.array([END], pa.binary())]), pa.concat_arrays([counted.field(1).cast(pa.int64()), pa.array([part.num_rows], pa.int64())]),
                ], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Words:
    """The hot words by falling frequency, what all counts sum to, and the vocabulary of the model."""

    hot: list[bytes]
    n: np.ndarray
    total: int
    distinct: int

    def __post_init__(self) -> None:
        """Place 0 is the end and place 1 all words outside; then the words by frequency."""
        self.place = np.ones(len(self.hot), np.int32)
        inside = [k for k, w in enumerate(self.hot) if w != END][: VOCABULARY - 2]
        self.place[inside] = np.arange(2, 2 + len(inside))
        self.weight = np.full(VOCABULARY, 1e-3)
        self.weight[2 : 2 + len(inside)] = self.n[inside]
        end = next((k for k, w in enumerate(self.hot) if w == END), None)
        ends = 0
        if end is not None:
            self.place[end], ends = 0, int(self.n[end])
        self.weight[0] = max(ends, 1)
        self.out_total = self.total - int(self.n[inside].sum()) - ends
        self.out_distinct = self.distinct - len(inside) - (end is not None)
        self.weight[1] = max(self.out_total, 1)
        self.log_count = np.log10(self.n + 1.0)


def gather_words(counts: DataFrame) -> Words:
    """The hot words: as many of the most frequent as fit in ``HOT``, and END (with a count for each document).

    The count from which a word is hot comes from a histogram of counts in steps of 1/16 octave,
    so no task and no driver ever sorts or gathers more words than ``HOT``.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    step = F.floor(F.log2("n") * 16).cast("int")
    hist = counts.groupBy(step.alias("step")).count().toPandas().sort_values("step", ascending=False)  # 16 * 64 rows at most
    fits = hist["step"][hist["count"].cumsum() <= HOT]
    least = int(fits.min()) if len(fits) else 1 << 20
    hot = counts.filter((step >= least) | (F.col("word") == F.lit(END))).toPandas()
    rows = sorted(((-int(n), bytes(w)) for w, n in zip(hot["word"], hot["n"])))
    return Words([w for _, w in rows], np.array([-n for n, _ in rows], np.float64), int(total[0]), int(total[1]))


def start(words: Words, seed: int = 7) -> dict[str, np.ndarray]:
    """Small random weights; the output begins at the frequencies of the words."""
    r = np.random.default_rng(seed)
    in_class = np.add.reduceat(words.weight, EDGES[:-1])
    small = lambda *shape: r.normal(0, 0.1, shape).astype(np.float32)
    return {
        **{f"embed_{gate}": small(VOCABULARY, HIDDEN) for gate in "zrn"}, **{f"recur_{gate}": small(HIDDEN, HIDDEN) for gate in "zrn"},
        "class_w": small(HIDDEN, CLASSES), "class_b": np.log(in_class / in_class.sum()).astype(np.float32),
        "word_w": small(HIDDEN, VOCABULARY), "word_b": np.log(words.weight / in_class[CLASS_OF]).astype(np.float32),
    }


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([x.ravel() for x in weights.values()])


def unflat(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    edges = np.cumsum([0, *[x.size for x in like.values()]])
    return {k: values[a:b].reshape(x.shape).astype(np.float32) for (k, x), a, b in zip(like.items(), edges, edges[1:])}


def _softmax(states: np.ndarray, w: np.ndarray, bias: np.ndarray, at: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Natural log of each target's probability, and what all probabilities are once divided by the sums."""
    x = states @ w
    x += bias  # in place: fresh large arrays cost more than the sums
    if x.max() > 60:  # else no exponential overflows
        x -= x.max(axis=1, keepdims=True)
    picked = x[at, target]
    np.exp(x, out=x)
    sums = x @ np.ones(x.shape[1], np.float32)
    return picked - np.log(sums), x, sums


def _error(e: np.ndarray, sums: np.ndarray, at: np.ndarray, target: np.ndarray) -> np.ndarray:
    e *= (1 / sums)[:, None]
    e[at, target] -= 1
    return e


def keep_memory() -> None:
    """Ask the C library to keep freed memory, up to 128 MB: else the arrays of each window come as fresh pages."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError):  # another C library
        return
    mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
    mallopt(-1, 128 << 20)  # M_TRIM_THRESHOLD


def squash(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x / sqrt(1 + x * x), in place, and its slope: from -1 to 1 like tanh, of a few vector operations."""
    c = x * x
    c += 1
    np.sqrt(c, out=c)
    np.reciprocal(c, out=c)
    x *= c
    return x, c * c * c


class Batch:
    """Documents as arrays of places, each ending with the end (place 0), one after another in lanes worked through in step."""

    def __init__(self, docs: list[np.ndarray], lanes: int | None = None):
        sizes = np.array([len(d) for d in docs])
        # The longest first, each to the shortest lane.
        heap = [(0, k) for k in range(min(lanes or LANES, len(docs)))]
        own: list[list[int]] = [[] for _ in heap]
        for k in np.argsort(-sizes, kind="stable").tolist():
            have, lane = heap[0]
            own[lane].append(k)
            heapq.heapreplace(heap, (have + len(docs[k]), lane))
        lane_sizes = np.array([sum(len(docs[k]) for k in x) for x in own])
        by_size = np.argsort(-lane_sizes, kind="stable")
        self.sizes = lane_sizes[by_size]
        self.order = [k for lane in by_size for k in own[lane]]
        self.text = np.concatenate([docs[k] for k in self.order])
        self.first = np.cumsum(self.sizes) - self.sizes
        self.starts = np.cumsum(sizes[self.order]) - sizes[self.order]

    def windows(self) -> Iterator[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """For each window and step: what goes in, what comes next and where that stands, for the lanes still going."""
        for t0 in range(0, int(self.sizes[0]), STEPS):
            steps = []
            for t in range(t0, min(t0 + STEPS, int(self.sizes[0]))):
                at = self.first[: int(np.searchsorted(-self.sizes, -t, side="left"))] + t
                steps.append((self.text[at - 1] if t else np.zeros(len(at), self.text.dtype), self.text[at], at))
            yield steps


def forward(w: dict[str, np.ndarray], state: np.ndarray, steps: list) -> tuple[np.ndarray, list]:
    """All states of a window, one below the other; ``state`` is carried on in place and cleared after an end."""
    kept, made, half = [], [], np.float32(0.5)
    for x, *_ in steps:
        n = len(x)
        going = (x != 0).astype(np.float32)[:, None]
        before = state[:n] * going
        q = {}
        for gate in "zr":
            a = before @ w[f"recur_{gate}"]
            a += w[f"embed_{gate}"].take(x, axis=0)
            a, slope = squash(a)
            a *= half
            a += half
            slope *= half
            q[gate] = (a, slope)
        (z, z_slope), (r, r_slope) = q["z"], q["r"]
        inner = before @ w["recur_n"]
        new = r * inner
        new += w["embed_n"].take(x, axis=0)
        new, n_slope = squash(new)
        after = before - new
        after *= z
        after += new
        state[:n] = after
        made.append(after)
        kept.append((x, going, before, z, z_slope, r, r_slope, new, n_slope, inner))
    return np.concatenate(made), kept


def outputs(w: dict[str, np.ndarray], states: np.ndarray, target: np.ndarray, grads: dict | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log of each target's probability; with ``grads``, also the gradient at the states."""
    # The words of a class together, so that each class is one product.
    owner = CLASS_OF.take(target)
    order = np.argsort(owner, kind="stable")
    owner, target, states = owner.take(order), target.take(order), states.take(order, axis=0)
    at = np.arange(len(target))
    out, e, sums = _softmax(states, w["class_w"], w["class_b"], at, owner)
    back = None
    if grads is not None:
        d = _error(e, sums, at, owner)
        grads["class_w"] += states.T @ d
        grads["class_b"] += np.ones(len(d), np.float32) @ d
        back = d @ w["class_w"].T
    edges = np.searchsorted(owner, np.arange(CLASSES + 1, dtype=owner.dtype))
    for c in range(CLASSES):
        a, b = edges[c], edges[c + 1]
        if a < b:
            i, j = EDGES[c], EDGES[c + 1]
            s, t = states[a:b], target[a:b] - i
            p, e, sums = _softmax(s, w["word_w"][:, i:j], w["word_b"][i:j], at[: b - a], t)
            out[a:b] += p
            if grads is not None:
                d = _error(e, sums, at[: b - a], t)
                grads["word_w"][:, i:j] += s.T @ d
                grads["word_b"][i:j] += np.ones(len(d), np.float32) @ d
                back[a:b] += d @ w["word_w"][:, i:j].T
    placed = np.empty_like(out)
    placed[order] = out
    if grads is not None:
        unsorted = np.empty_like(order)
        unsorted[order] = at
        back = back.take(unsorted, axis=0)
    return placed, back


def backward(w: dict[str, np.ndarray], kept: list, back: np.ndarray, grads: dict) -> None:
    """Through the steps of one window; nothing flows into the window or the document before."""
    end, carry = len(back), np.zeros((0, HIDDEN), np.float32)
    inputs, at_inputs = [], {gate: [] for gate in "zrn"}
    for x, going, before, z, z_slope, r, r_slope, new, n_slope, inner in reversed(kept):
        n = len(x)
        d = back[end - n : end]
        end -= n
        d[: len(carry)] += carry
        carry = d * z
        d_new = (d - carry) * n_slope
        d_z = before - new
        d_z *= d
        d_z *= z_slope
        d_r = d_new * inner
        d_r *= r_slope
        d_inner = d_new * r
        for gate, g in (("z", d_z), ("r", d_r), ("n", d_inner)):
            grads[f"recur_{gate}"] += before.T @ g
            carry += g @ w[f"recur_{gate}"].T
        carry *= going
        inputs.append(x)
        for gate, g in (("z", d_z), ("r", d_r), ("n", d_new)):
            at_inputs[gate].append(g)
    x = np.concatenate(inputs)
    order = np.argsort(x, kind="stable")
    places, firsts = np.unique(x.take(order), return_index=True)
    for gate, g in at_inputs.items():
        grads[f"embed_{gate}"][places] += np.add.reduceat(np.concatenate(g).take(order, axis=0), firsts, axis=0)


def train(w: dict[str, np.ndarray], docs: list[np.ndarray], seen: dict[str, np.ndarray]) -> int:
    """One pass over the documents, in place; ``seen`` has the squared gradients so far (Adagrad).

    The state is cleared every ``PIECE`` places of a longer document, so that no lane is long.
    """
    batch = Batch([d[k : k + PIECE] for d in docs for k in range(0, len(d), PIECE)])
    state = np.zeros((len(batch.sizes), HIDDEN), np.float32)
    for steps in batch.windows():
        grads = {k: np.zeros_like(x) for k, x in w.items()}
        states, kept = forward(w, state, steps)
        _, back = outputs(w, states, np.concatenate([y for _, y, _ in steps]), grads)
        backward(w, kept, back, grads)
        size = len(states)
        norm = math.sqrt(sum(float(np.vdot(g, g)) for g in grads.values())) / size
        scale = np.float32(min(1.0, CLIP / max(norm, 1e-9)) / size)
        for k, grad in grads.items():
            grad *= scale
            seen[k] += grad * grad
            w[k] -= np.float32(RATE) * grad / np.sqrt(seen[k])
    return len(batch.text)


def log_likelihood(w: dict[str, np.ndarray], docs: list[np.ndarray]) -> np.ndarray:
    """Natural log of the probability of each whole document."""
    if not docs:
        return np.zeros(0)
    batch = Batch(docs)
    state, each = np.zeros((len(batch.sizes), HIDDEN), np.float32), np.empty(len(batch.text), np.float32)
    for steps in batch.windows():
        states, _ = forward(w, state, steps)
        p, _ = outputs(w, states, np.concatenate([y for _, y, _ in steps]), None)
        each[np.concatenate([at for *_, at in steps])] = p
    out = np.empty(len(docs))
    out[batch.order] = np.add.reduceat(each, batch.starts, dtype=np.float64)
    return out


def gathered(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """First columns and arrays of places, of about ``most`` places at a time; at least one document."""
    keys, docs, have = [], [], 0
    for batch in batches:
        for key, places in zip(batch.column(0).to_pylist(), batch.column(column)):
            keys.append(key)
            docs.append(np.frombuffer(places.as_buffer(), np.int16).copy())
            have += len(docs[-1])
            if have >= most:
                yield keys, docs
                keys, docs, have = [], [], 0
    if docs:
        yield keys, docs


def averaged_training(coded: DataFrame, weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Each partition trains on its rows of (key, places); the mean of the weights by tokens."""
    shared = coded.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        w = {k: x.copy() for k, x in shared.value.items()}
        seen, done = {k: np.full_like(x, 1e-6) for k, x in w.items()}, 0
        for _, docs in gathered(batches, 1, TRAIN_TOKENS):
            done += train(w, docs, seen)
        values = flat(w)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values.astype(np.float64) * done), pa.array(np.full(len(values), done, np.int64))], ["at", "w", "n"])

    rows = coded.select("key", "places").mapInArrow(run, "at int, w double, n long").groupBy("at").agg((F.sum("w") / F.sum("n")).alias("w")).toPandas()
    if not len(rows):
        return weights
    return unflat(rows.sort_values("at")["w"].to_numpy(), weights)


def fit(coded: DataFrame, words: Words) -> dict[str, np.ndarray]:
    """The trained weights, from rows of (key, places)."""
    first = F.pmod(F.xxhash64("key"), F.lit(4)) == 0
    weights = start(words)
    for part in (coded.filter(first), coded.filter(~first)):
        weights = averaged_training(part, weights)
    return weights


def code(keyed: DataFrame, words) -> DataFrame:
    """The rows of (key, id, text) coded: (key, id, places, known, base, beyond, word).

    A row for each document, without ``word``, and one for each place of a word that is not hot.
    ``base`` and ``known`` are of the hot words, ``beyond`` is the log10 share of the hot words
    outside the vocabulary among all such.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Words = words.value
        hot = pa.array(own.hot, pa.binary())
        outside = math.log10(own.out_total + own.out_distinct + 1)
        # The last of each is for words that are not hot.
        place, log_count, is_hot = np.r_[own.place, 1].astype(np.int16), np.r_[own.log_count, 0.0], np.r_[np.ones(len(hot)), 0.0]
        beyond = np.where(place == 1, log_count - outside, 0.0)
        end = own.hot.index(END) if END in own.hot else -1
        for batch in batches:
            for part in pieces(batch, 2, CODE_BYTES):
                n = part.num_rows
                made, owner = tokens(part.column(2))
                ranks = pc.fill_null(pc.index_in(made.cast(pa.binary()), hot), -1).to_numpy(zero_copy_only=False)
                edges = np.searchsorted(owner, np.arange(n + 1)) + np.arange(n + 1)
                places = np.zeros(len(ranks) + n, np.int16)  # the ends stay
                places[np.arange(len(ranks)) + owner] = place[ranks]
                total = lambda of, owner=owner, ranks=ranks, n=n: np.bincount(owner, weights=of[ranks], minlength=n).astype(np.float64)
                rare = np.flatnonzero(ranks < 0)
                m, who = len(rare), pa.array(np.r_[np.arange(n), owner[rare]])
                both = lambda values, m=m: pa.concat_arrays([values, pa.nulls(m, values.type)])
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(who), both(part.column(1)),
                    both(pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((2 * edges).astype(np.int32)), pa.py_buffer(places)])),
                    both(pa.array((total(is_hot) + (end >= 0)).astype(np.int64))), both(pa.array(total(log_count) + log_count[end])), both(pa.array(total(beyond))),
                    pa.concat_arrays([pa.nulls(n, pa.binary()), made.take(pa.array(rare)).cast(pa.binary())]),
                ], ["key", "id", "places", "known", "base", "beyond", "word"])

    kind = keyed.schema["id"].dataType.simpleString()
    return keyed.select("key", "id", "text").mapInArrow(run, f"key long, id {kind}, places binary, known long, base double, beyond double, word binary")


def model_scores(coded: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """(key, model): natural log of the probability of the places of each document."""
    shared = coded.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        for keys, docs in gathered(batches, 1, SCORE_TOKENS):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(log_likelihood(shared.value, docs))], ["key", "model"])

    return coded.select("key", "places").mapInArrow(run, "key long, model double")


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    Learns from rows whose crc32 of the id as text, mod ``folds``, is not ``held`` (a null id is
    learned from). A null or empty text is one end. Where nothing can be learned from, counts are
    0 and the base score of any text is 0. Repeated rows each give a row; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    held_out = fold("id", folds) == held
    counts = checkpoint(word_counts(rows.filter(~held_out)))
    own = gather_words(counts)
    words = docs.sparkSession.sparkContext.broadcast(own)
    # Keys are given once, in what is stored.
    coded = stored(code(rows.withColumn("key", F.monotonically_increasing_id()), words))
    texts = coded.filter("places is not null")
    weights = fit(texts.filter(~held_out), own)
    rare = coded.filter("word is not null").select("key", "word").join(counts.withColumnRenamed("n", "c"), "word", "left")
    rare = rare.groupBy("key").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("rare"), F.count("c").alias("rare_known"))
    size, none = (F.octet_length("places") / 2).cast("long"), F.lit(0.0)
    norm = math.log10(own.total + own.distinct + 1)
    met = texts.join(model_scores(texts, weights), "key").join(rare, "key", "left")
    return met.select(
        F.col("id").alias(id_col), held_out.alias("held_out"), size.alias("n_tokens"), (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(own.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare", none) - size * F.lit(norm)).alias("base_score"), (F.col("model") / math.log(10) + F.col("beyond") + F.coalesce("rare", none)).alias("score"),
    )
