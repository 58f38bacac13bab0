"""Language identification with error-correcting output codes.

Every language gets a codeword of bits. One binary classifier per bit tells from hashed
letter n-grams on which side of the code the language of a text lies; the languages are not
told apart directly. With up to seven languages the code is exhaustive (all splits of the
languages), beyond that random bits are chosen so that codewords lie far apart.

* Counts of n-grams of one to three letters are summed over all labelled texts per language.
  A bit's classifier holds the log odds of each n-gram between the languages on the two
  sides; its margin on a text is the mean log odds over the text's n-grams.
* A second pass over the labelled texts counts how often each bit is right for each
  language. These accuracies weight the loss of the bit in decoding.
* Decoding adds up ``log(1 + exp(-SHARPNESS * sign * margin))`` over the bits with these
  weights and takes the codeword with the least loss. The score is the softmax of the
  negative losses; a text is flagged ambiguous if the runner-up is nearly as close.

The model has (buckets + 1) * bits numbers, whatever the size of the corpus. Text is
lower-cased and everything but letters becomes one blank. A null text or one without
letters is ``und`` with score 0. More than MAX_LANGUAGES languages raise an error. If no row is labelled, every text is ``und``. Ties go to the
alphabetically first language. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import slices, text_buffer

BUCKETS = 1 << 14
GRAM_WINDOW = 1 << 17  # bytes of text worked on at a time
SLICE = 1 << 20  # bytes of text whose rows are put together
ODDS_STEPS = 1 << 12
MAX_LANGUAGES = 1024
ORDERS = 3
SHARPNESS = 4.0
AMBIGUOUS = 0.6  # a score below this is flagged
LONG_CODE_FACTOR = 6  # bits per doubling of the number of languages, beyond seven
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Lower-case code point of every letter, blank for everything else."""
    if not _letters:
        table = np.full(0x110000, 0x20, np.uint32)
        for start, stop in ((0, 0xD800), (0xE000, 0x20000), (0x20000, 0x323B0)):
            for c in range(start, stop):
                char = chr(c)
                if char.isalpha():
                    low = char.lower()
                    table[c] = ord(low) if len(low) == 1 else c
        _letters.append(table)
    return _letters[0]


def codewords(languages: int, seed: int = 5) -> np.ndarray:
    """Matrix of -1 and 1, a row per language; no two rows are equal."""
    if languages <= 7:
        bits = max(1, (1 << (languages - 1)) - 1) if languages > 1 else 1
        # the first language is always 1, so that no split comes twice
        split = np.arange(bits)
        rows = [np.ones(bits, int)]
        rows += [np.where(split >> (languages - 2 - i) & 1, 1, -1) for i in range(languages - 1)]
        return np.array(rows[:languages])
    width = int(np.ceil(LONG_CODE_FACTOR * np.log2(languages)))
    draw = np.random.default_rng(seed)
    best, far = None, -1
    for _ in range(200):
        code = draw.choice([-1, 1], (languages, width))
        apart = (width - code @ code.T) // 2
        near = int(apart[~np.eye(languages, dtype=bool)].min())
        if near > far and (np.abs(code.sum(axis=0)) < languages).all():
            best, far = code, near
    return best


def _grams(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket of each n-gram, row of each n-gram), one order of a window at a time.

    The last characters of a window are carried into the next one, so the n-grams of a row do
    not depend on where the windows lie.
    """
    data, offsets = text_buffer(batch.column("text"))
    table = letter_table()
    held = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last_blank, last_row = True, -1
    # a character belongs to the row its first byte lies in
    at, n = 0, len(data)
    while at < n:
        end = min(at + GRAM_WINDOW, n)
        while end < n and data[end] & 0xC0 == 0x80:
            end += 1
        part = data[at:end]
        chars = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        where = np.flatnonzero((part & 0xC0) != 0x80)
        row = np.searchsorted(offsets, where + at, side="right") - 1
        chars = table[chars]
        blank = chars == 0x20
        after_word = np.empty(len(chars), bool)
        after_word[0] = not last_blank and row[0] == last_row
        after_word[1:] = ~blank[:-1] & (row[1:] == row[:-1])
        last_blank, last_row = bool(blank[-1]), int(row[-1])
        keep = ~blank | after_word  # one blank after each word
        first = len(held[0])
        chars = np.concatenate([held[0], chars[keep]])
        row = np.concatenate([held[1], row[keep]])
        hashed = np.zeros(len(chars), np.uint64)
        for order in range(min(ORDERS, len(chars))):
            hashed = hashed[: len(chars) - order]
            hashed = (hashed + chars[order:] + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
            # those that end in this window
            new = slice(max(first - order, 0), None)
            inside = np.flatnonzero(row[order:][new] == row[: len(row) - order][new])
            bucket = (hashed[new][inside] >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int32)
            if len(bucket):
                yield bucket, row[order:][new][inside]
        held = chars[1 - ORDERS :], row[1 - ORDERS :]
        at = end


def _count_by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            langs = part.column("lang").to_pylist()
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs])
            for name in names:
                counts.setdefault(name, np.zeros(BUCKETS, np.int64))
            for bucket, row in _grams(part):
                which = number[row]
                for i, name in enumerate(names):
                    counts[name] += np.bincount(bucket[which == i], minlength=BUCKETS)
    for name, c in counts.items():
        used = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(used)), pa.array(used.astype(np.int32)), pa.array(c[used])],
            names=["lang", "bucket", "n"],
        )


class Model:
    """Languages, code, log odds per bucket and bit, and the bits' weights per language."""

    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages = languages
        self.code = codewords(len(languages))
        share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
        odds = np.zeros((self.code.shape[1], BUCKETS))
        for b, signs in enumerate(self.code.T):
            # all languages of a side count alike, however much text they have
            plus = share[signs > 0].mean(axis=0)
            minus = share[signs < 0].mean(axis=0) if (signs < 0).any() else plus
            odds[b] = np.log(plus) - np.log(minus)
        # whole multiples of a power of two: their sums are exact in any order
        self.odds = np.round(odds * ODDS_STEPS) / ODDS_STEPS
        self.weights = np.ones(self.code.shape) / self.code.shape[1]

    def margins(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Mean log odds of each row and bit, and the number of n-grams of each row."""
        total = np.zeros((batch.num_rows, len(self.odds)))
        count = np.zeros(batch.num_rows, np.int64)
        for bucket, row in _grams(batch):
            # rows ascend
            cuts = np.flatnonzero(np.diff(row, prepend=-1))
            for bit, odds in enumerate(self.odds):
                total[row[cuts], bit] += np.add.reduceat(odds[bucket], cuts)
            count[row[cuts]] += np.diff(np.append(cuts, len(row)))
        return total / np.maximum(count, 1)[:, None], count

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest codeword and its score."""
        signed = margins[:, None, :] * self.code[None]
        loss = (self.weights[None] * np.logaddexp(0, -SHARPNESS * signed)).sum(axis=2)
        odds = np.exp((loss.min(axis=1, keepdims=True) - loss) * self.code.shape[1])
        return loss.argmin(axis=1), odds.max(axis=1) / odds.sum(axis=1)


def _bit_hits(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = np.zeros(model.code.shape, np.int64)
        seen = np.zeros(len(model.languages), np.int64)
        number = {name: i for i, name in enumerate(model.languages)}
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                margins, count = model.margins(part)
                for i, name in enumerate(part.column("lang").to_pylist()):
                    if count[i]:
                        k = number[name]
                        seen[k] += 1
                        right[k] += margins[i] * model.code[k] > 0
        at = np.indices(right.shape).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[0]), pa.array(at[1]), pa.array(right.reshape(-1)), pa.array(seen[at[0]])],
            names=["language", "bit", "hits", "seen"],
        )

    return run


def fit(labelled: DataFrame) -> Model | None:
    """Learn from all rows of ``labelled`` (text, lang) that have both."""
    rows = labelled.select(F.col("text").cast("string"), F.col("lang").cast("string")).filter(
        "text is not null and lang is not null"
    )
    if rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    sums = (
        rows.mapInArrow(_count_by_language, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    if sums.empty:
        return None
    languages = sorted(sums["lang"].unique())
    counts = np.zeros((len(languages), BUCKETS))
    counts[[languages.index(x) for x in sums["lang"]], sums["bucket"]] = sums["n"]
    model = Model(languages, counts)
    hits = (
        rows.mapInArrow(_bit_hits(model), "language int, bit int, hits long, seen long")
        .groupBy("language", "bit")
        .agg(F.sum("hits").alias("hits"), F.sum("seen").alias("seen"))
        .toPandas()
    )
    accuracy = np.zeros(model.code.shape)
    accuracy[hits["language"], hits["bit"]] = (hits["hits"] + 1) / (hits["seen"] + 2)
    model.weights = accuracy / accuracy.sum(axis=1, keepdims=True)
    return model


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous), a row per row of ``docs``."""
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("lang_pred", pa.string()),
            ("score", pa.float64()),
            ("ambiguous", pa.bool_()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                if model is None:
                    names, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                else:
                    margins, count = model.margins(part)
                    best, score = model.decode(margins)
                    score = np.where(count > 0, score, 0.0)
                    names = [
                        model.languages[k] if c else UNKNOWN
                        for k, c in zip(best, count, strict=True)
                    ]
                unsure = score < AMBIGUOUS
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names), pa.array(score), pa.array(unsure)],
                    schema=schema,
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, ambiguous boolean"
    )


def keep_identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """Rows of ``docs`` whose language is told without ambiguity, all columns unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                if model is not None:
                    margins, count = model.margins(part)
                    score = model.decode(margins)[1]
                    yield part.filter(pa.array((count > 0) & (score >= AMBIGUOUS)))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32(doc_id as text) mod folds = fold; a null id is not held out."""
    rest = F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))
    return F.coalesce(rest == fold, F.lit(False))
