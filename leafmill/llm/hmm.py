"""A hidden Markov language model with distributed Baum-Welch.

Tokens are words with A-Z lower-cased, then one end of text. The model emits symbols: the
HEAD most frequent words stand for themselves, every other word for its class (a hash of
its last two bytes, CLASSES of them), the end for itself. A word of a class then has probability
(count + 0.5) / (class total + 0.5 * (class vocabulary + 1)), where the last 0.5 is
the share of all unseen words. So every text has an exact probability: the forward
recursion over its symbols, scaled per step, times the word probabilities in its classes.

Training sees all training texts. Word counts are summed over the whole corpus. The symbol
sequences are written once, divided by a hash of the row into folds of doubling size. An
iteration of Baum-Welch is one fold: tasks run forward and backward over their texts and
report expected counts, Spark sums them, the driver re-estimates. The first, smallest fold is
passed BURN_IN times to leave the random start; every fold counts, older statistics fade by
half. Per state and symbol there is one number, so the model does not grow with the corpus.

Counts of the most frequent words (KNOWN at most, found from a histogram of counts) are sent
to all tasks; the rest of the words is joined by hash. Words are identified by 64-bit hashes.

A null or empty text is its end alone. Rows with a null id are training rows and get a
row of their own, as do repeated rows. Without training rows every probability is that of
the smoothing. For training, texts are cut after PIECE tokens; scores are exact. Further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import Scratch, checkpointed, mix, slices, text_buffer, word_hashes

STATES = 8
HEAD, CLASSES = 8192, 512
KNOWN = 1 << 18
FOLDS, BURN_IN = 7, 8
PIECE = 1 << 16
BLOCK = 1 << 19  # tokens worked on at a time
PRIOR = 50.0  # pseudo-counts per state, spread like the symbols of the corpus


def word_class(ending: np.ndarray) -> np.ndarray:
    return (mix(ending.astype(np.uint64) + np.uint64(7)) % np.uint64(CLASSES)).astype(np.int32)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    classes: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        words, at, n = np.unique(np.concatenate(held), return_index=True, return_counts=True)
        cls = np.concatenate(classes)[at]
        held.clear()
        classes.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(words.view(np.int64)), pa.array(cls), pa.array(n)],
            names=["word", "cls", "n"],
        )

    for batch in batches:
        for part in slices(batch, "text"):
            endings: list[np.ndarray] = []
            found, _ = word_hashes(*text_buffer(part.column("text")), endings=endings)
            held.append(found)
            classes.append(word_class(np.concatenate([np.zeros(0, np.uint16), *endings])))
            if sum(map(len, held)) > 4 * BLOCK:
                yield flush()
    if held:
        yield flush()


class Vocabulary:
    """Frequent words with their counts, class totals, and the size of the corpus."""

    def __init__(self, counts: DataFrame, texts: int) -> None:
        level = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
        levels = counts.groupBy(level.alias("level")).agg(
            F.count("*").alias("words"), F.sum("n").alias("tokens"), F.min("n").alias("least")
        )
        levels = levels.orderBy(F.desc("level")).collect()
        least, sent = None, 0
        for row in levels:
            if sent + row["words"] > KNOWN:
                break
            sent, least = sent + row["words"], row["least"]
        top = counts.filter(F.col("n") >= (least or 1 << 62)).toPandas()
        top = top.sort_values(["n", "word"], ascending=[False, True])
        words = top["word"].to_numpy(np.int64).view(np.uint64)
        own = np.arange(len(words)) < HEAD
        total = np.zeros(CLASSES)
        size = np.zeros(CLASSES)
        for row in counts.groupBy("cls").agg(F.sum("n").alias("t"), F.count("*").alias("v")).collect():
            total[row["cls"]], size[row["cls"]] = row["t"], row["v"]
        cls, n = top["cls"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
        np.subtract.at(total, cls[own], n[own])
        np.subtract.at(size, cls[own], 1)
        self.class_total = total
        self.class_space = total + 0.5 * (size + 1)
        self.texts = texts
        self.tokens = int(sum(r["tokens"] for r in levels)) + texts
        self.space = self.tokens + 0.5 * (sum(r["words"] for r in levels) + (texts > 0) + 1)
        order = np.argsort(words)
        self.words, self.counts = words[order], n[order]
        # symbols: 0 the end, then the classes, then the head words
        symbol = 1 + cls
        symbol[own] = 1 + CLASSES + np.arange(int(own.sum()))
        self.symbol = symbol[order].astype(np.int32)
        self.symbols = 1 + CLASSES + int(own.sum())
        unigram = np.zeros(self.symbols)
        unigram[0] = texts
        unigram[1 : 1 + CLASSES] = total
        unigram[1 + CLASSES :] = n[own]
        self.unigram = (unigram + 0.5) / (unigram + 0.5).sum()

    def find(self, words: np.ndarray) -> np.ndarray:
        """Position among the frequent words, -1 for others."""
        if not len(self.words):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, -1)


def _symbols(vocabulary: Vocabulary):
    """Symbol sequence of each text, what is known of it here, and its other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary
        base = np.log10((v.counts + 0.5) / v.space)
        cls = np.clip(v.symbol - 1, 0, CLASSES - 1)
        inside = np.log10((v.counts + 0.5) / v.class_space[cls])
        inside[v.symbol > CLASSES] = 0.0
        end = np.log10((v.texts + 0.5) / v.space)
        for batch in batches:
            for part in slices(batch, "text"):
                endings: list[np.ndarray] = []
                words, counts = word_hashes(*text_buffer(part.column("text")), endings=endings)
                classes = word_class(np.concatenate([np.zeros(0, np.uint16), *endings]))
                row = np.repeat(np.arange(len(counts)), counts)
                at = v.find(words)
                known = at >= 0
                symbol = np.where(known, v.symbol[at] if len(v.symbol) else 0, 1 + classes)
                place = np.cumsum(counts)
                flat = np.insert(symbol, place, 0).astype("<u2")  # the end behind each text
                offsets = np.concatenate([[0], np.cumsum(2 * (counts + 1))]).astype(np.int32)
                seqs = pa.Array.from_buffers(
                    pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]
                )
                sums = {
                    "base": np.bincount(row[known], base[at[known]], len(counts)) + end,
                    "inside": np.bincount(row[known], inside[at[known]], len(counts)),
                    "known": np.bincount(row[known], minlength=len(counts)) + (v.texts > 0),
                }
                rest = np.bincount(row[~known], minlength=len(counts))
                cuts = np.concatenate([[0], np.cumsum(rest)]).astype(np.int32)
                other = pa.StructArray.from_arrays(
                    [pa.array(words[~known].view(np.int64)), pa.array(classes[~known])],
                    names=["word", "cls"],
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"),
                        part.column("doc_id"),
                        part.column("held_out"),
                        part.column("fold"),
                        pa.array(counts + 1),
                        pa.array(sums["base"].astype(np.float64)),
                        pa.array(sums["inside"].astype(np.float64)),
                        pa.array(sums["known"].astype(np.int64)),
                        seqs,
                        pa.ListArray.from_arrays(pa.array(cuts), other),
                    ],
                    names=[*_KEPT, "symbols", "other"],
                )

    return run


_KEPT = ["row", "doc_id", "held_out", "fold", "n_tokens", "base", "inside", "known"]
_SYMBOL_SCHEMA = (
    "row long, doc_id long, held_out boolean, fold int, n_tokens long, base double, "
    "inside double, known long, symbols binary, other array<struct<word: long, cls: int>>"
)


class Model:
    """Start, transition and emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = start, move, emit  # emit: symbol x state

    @classmethod
    def initial(cls, unigram: np.ndarray, states: int = STATES, seed: int = 3) -> Model:
        """States that differ by random factors, each likely to go on."""
        draw = np.random.default_rng(seed)
        emit = unigram[:, None] * draw.lognormal(0.0, 1.0, (len(unigram), states))
        move = np.full((states, states), 0.02 / max(1, states - 1))
        np.fill_diagonal(move, 0.98)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def _layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Active sequences per step (sequences sorted by falling length) and their offsets."""
    steps = np.bincount(lengths)
    active = len(lengths) - np.cumsum(steps)[:-1]
    return active, np.concatenate([[0], np.cumsum(active)])


def _by_time(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols ordered by step, then by sequence; the order of the sequences."""
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    active, offset = _layout(lengths)
    rank = np.repeat(np.arange(len(lengths)), lengths)
    step = np.arange(len(rank)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    symbols = np.empty(len(rank), np.int32)
    symbols[offset[step] + rank] = np.concatenate([sequences[i] for i in order])
    return symbols, active, offset, order


def log_likelihood(sequences: list[np.ndarray], model: Model) -> np.ndarray:
    """Natural log probability of each sequence of at least one symbol; scaled forward."""
    symbols, active, offset, order = _by_time(sequences)
    total = np.zeros(len(sequences))
    alpha = None
    for t, n in enumerate(active):
        emitted = model.emit[symbols[offset[t] : offset[t] + n]]
        alpha = (model.start if t == 0 else alpha[:n] @ model.move) * emitted
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        total[:n] += np.log(scale)
    out = np.empty(len(sequences))
    out[order] = total
    return out


def expected_counts(
    sequences: list[np.ndarray], model: Model
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, transitions and emissions under the model; forward and backward."""
    symbols, active, offset, _ = _by_time(sequences)
    size = len(symbols)
    emitted = model.emit.astype(np.float32)[symbols]
    move = model.move.astype(np.float32)
    alpha = np.empty_like(emitted)
    for t, n in enumerate(active):
        now = alpha[offset[t] : offset[t] + n]
        if t == 0:
            np.multiply(emitted[:n], model.start.astype(np.float32), out=now)
        else:
            before = alpha[offset[t - 1] : offset[t - 1] + n]
            np.multiply(before @ move, emitted[offset[t] : offset[t] + n], out=now)
        scale = now.sum(axis=1, keepdims=True)
        now /= scale
        emitted[offset[t] : offset[t] + n] /= scale
    beta = np.ones_like(emitted)
    back = np.ascontiguousarray(move.T)
    for t in range(len(active) - 2, -1, -1):
        n = active[t + 1]
        at = offset[t + 1]
        beta[offset[t] : offset[t] + n] = (emitted[at : at + n] * beta[at : at + n]) @ back
    later = np.arange(active[0], size)
    before = later - np.repeat(active[:-1], active[1:])
    moves = alpha[before].T @ (emitted[later] * beta[later])
    alpha *= beta
    emits = np.stack(
        [np.bincount(symbols, alpha[:, k], len(model.emit)) for k in range(alpha.shape[1])], axis=1
    )
    return alpha[: active[0]].sum(axis=0).astype(float), moves * model.move, emits


def _blocks(column: pa.Array, limit: int) -> Iterator[list[np.ndarray]]:
    held, size = [], 0
    for value in column:
        seq = np.frombuffer(value.as_buffer(), "<u2")
        for at in range(0, len(seq), limit):
            held.append(seq[at : at + limit])
            size += len(held[-1])
            if size >= BLOCK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _expectation(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for block in _blocks(batch.column("symbols"), PIECE):
                found = expected_counts(block, model)
                total = found if total is None else [a + b for a, b in zip(total, found, strict=True)]
        if total is None:
            return
        # starts, then transitions, then emissions, in one numbered list
        flat = np.concatenate([x.reshape(-1) for x in total])
        used = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(flat[used])], names=["at", "value"]
        )

    return run


def baum_welch(sequences: DataFrame, vocabulary: Vocabulary, states: int = STATES) -> Model:
    """Train on the ``symbols`` of all rows, fold after fold."""
    model = Model.initial(vocabulary.unigram, states)
    size = states + states * states + vocabulary.symbols * states
    kept = np.zeros(size)
    for fold in [0] * BURN_IN + list(range(FOLDS)):
        rows = (
            sequences.filter(F.col("fold") == fold)
            .select("symbols")
            .mapInArrow(_expectation(model), "at int, value double")
            .groupBy("at")
            .agg(F.sum("value").alias("value"))
            .toPandas()
        )
        found = np.zeros(size)
        found[rows["at"]] = rows["value"]
        kept = found if fold == 0 else 0.5 * kept + found
        if not kept.any():
            continue
        start, move, emit = np.split(kept, [states, states + states * states])
        start = start + 0.1
        move = move.reshape(states, states) + 0.1
        emit = emit.reshape(-1, states) + PRIOR * vocabulary.unigram[:, None]
        model = Model(
            start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)
        )
    return model


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # whole texts, as many at a time as BLOCK tokens hold, one at least
            size = np.cumsum(batch.column("n_tokens").to_numpy())
            at = 0
            while at < batch.num_rows:
                limit = (size[at - 1] if at else 0) + BLOCK
                end = max(at + 1, int(np.searchsorted(size, limit, side="right")))
                part = batch.slice(at, end - at)
                seqs = [np.frombuffer(x.as_buffer(), "<u2") for x in part.column("symbols")]
                value = log_likelihood(seqs, model) / np.log(10)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in _KEPT), pa.array(value)], names=[*_KEPT, "path"]
                )
                at = end

    return run


def score(docs: DataFrame, held_out: Column, states: int = STATES) -> DataFrame:
    """Train on the rows that are not held out and score all rows.

    (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), base and
    model scores as log10 probabilities of the text.
    """
    spark = docs.sparkSession
    # fold f holds 2**-(FOLDS - f) of the rows, fold 0 as much as fold 1
    bucket = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << (FOLDS - 1)))
    fold = F.when(bucket == 0, 0).otherwise(F.floor(F.log2(bucket.cast("double"))) + 1)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long"),
        F.col("text").cast("string"),
        held_out.alias("held_out"),
    ).withColumn("fold", F.when(F.col("held_out"), FOLDS).otherwise(fold).cast("int"))
    learned = rows.filter(~F.col("held_out"))
    counts = checkpointed(
        learned.select("text")
        .mapInArrow(_word_counts, "word long, cls int, n long")
        .groupBy("word", "cls")
        .agg(F.sum("n").alias("n"))
    )
    vocabulary = Vocabulary(counts, learned.count())
    with Scratch(spark) as scratch:
        sequences = scratch.table(
            rows.mapInArrow(_symbols(vocabulary), _SYMBOL_SCHEMA), "symbols", partition_by="fold"
        )
        model = baum_welch(sequences, vocabulary, states)
        kept = ", ".join(x for x in _SYMBOL_SCHEMA.split(", symbols")[0].split(", "))
        paths = sequences.select(*_KEPT, "symbols").mapInArrow(
            _scores(model), f"{kept}, path double"
        )
        spaces = spark.createDataFrame(
            [(i, float(x)) for i, x in enumerate(vocabulary.class_space)], "cls int, space double"
        )
        n = F.coalesce("n", F.lit(0))
        others = (
            sequences.select("row", F.explode("other").alias("o"))
            .select("row", "o.word", "o.cls")
            .join(counts.select("word", "n"), "word", "left")
            .join(F.broadcast(spaces), "cls")
            .groupBy("row")
            .agg(
                F.sum(F.log10((n + 0.5) / vocabulary.space)).alias("base_rest"),
                F.sum(F.log10((n + 0.5) / F.col("space"))).alias("inside_rest"),
                F.sum((n > 0).cast("long")).alias("known_rest"),
            )
        )

        def both(a: str, b: str) -> Column:
            return F.col(a) + F.coalesce(F.col(b), F.lit(0))

        return checkpointed(
            paths.join(others, "row", "left").select(
                "doc_id",
                "held_out",
                "n_tokens",
                both("known", "known_rest").alias("n_known"),
                F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
                both("base", "base_rest").alias("base_score"),
                (F.col("path") + both("inside", "inside_rest")).alias("score"),
            )
        )
