"""Toxicity from a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, strips accents, maps homoglyphs (Cyrillic, Greek, full-width and
mathematical letters) to Latin letters, reads digits and signs used as letters (``1d10t``) and
turns everything else into blanks. Lexicon and text are folded alike.

The lexicon is learned from labelled rows: words, and stems of four and five letters of longer
words, that occur in toxic documents far more often than in clean ones. A term enters
if an excess like its own is to be expected less than ALPHA times among all terms by
chance (Chernoff bound); its weight is the log odds of its shares of toxic and clean
documents. Near copies would lend their words false support, so of documents that agree in the
smallest values of two hashes of COPY_WORDS consecutive words the one with the smallest id is
counted: one shared line seldom holds both. ``extra`` adds terms with given weights. What
is learned does not depend on how the rows lie in partitions.

An automaton finds all terms at once. Each word counts with its heaviest term; words inside
an exception phrase count nothing. A logistic curve over log(1 + weight) and, where
something was found, log(1 + words) normalises by length and turns it into a probability.

At most TOXIC_ROWS toxic and CLEAN_ROWS clean labelled rows (lowest hash of their id) are used
to learn; scores cover all rows and whole texts. Null and empty texts score like any text
without a match. Rows with a null id or label teach nothing. Without labelled rows of both
classes the score is the share of toxic labels (0 without labels). Further columns are
ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Mapping, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import mix, slices, word_hashes, written
from leafmill.llm.neardup import shingles

TOXIC_ROWS, CLEAN_ROWS = 3_000, 9_000
STEMS = (4, 5)
COPY_WORDS = 4
ALPHA = 0.05
LEAST_WEIGHT = 2.0
THRESHOLD = 0.7
_OTHER = np.uint64(0xD6E8FEB86659FD93)

# Letters of other scripts that look like Latin ones, and signs used for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d",
    "ɡ": "g", "ո": "n", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i",
    "ł": "l", "ø": "o", "đ": "d", "ß": "b",
}
SUBSTITUTES = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "€": "e", "|": "i",
}
# l, I and 1 stand for each other, so all of them are folded to i.
MERGED = {"l": "i"}
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "pond scum")

_table: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """Folded code point of every code point; blank for what is no letter."""
    if not _table:
        fold = np.full(0x110000, 0x20, np.uint32)
        for start, stop in ((0, 0xD800), (0xF900, 0x20000)):
            for c in range(start, stop):
                char = chr(c)
                if not char.isalpha() and char not in SUBSTITUTES:
                    continue
                plain = unicodedata.normalize("NFKD", char)[0].lower()[0]
                plain = HOMOGLYPHS.get(plain, SUBSTITUTES.get(plain, plain))
                fold[c] = ord(MERGED.get(plain, plain))
        fold[0x20000:0x323B0] = np.arange(0x20000, 0x323B0)
        _table.append(fold)
    return _table[0]


def folded(text: str | None) -> str:
    """Same length as ``text``, with a blank in front and behind."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
    return " " + fold_table()[codes].astype("<u4").tobytes().decode("utf-32-le") + " "


def terms_of(text: str | None) -> tuple[list[str], int, int]:
    """Words (`` word ``) and stems (`` ste``) of a text, and its smallest shingle hashes."""
    plain = folded(text)
    words = set(plain.split())
    found = {f" {w} " for w in words}
    for n in STEMS:
        found |= {f" {w[:n]}" for w in words if len(w) > n}
    if not words:
        return [], 0, 0
    raw = np.frombuffer(plain.encode(), np.uint8)
    hashes, _ = word_hashes(raw, np.array([0, len(raw)]))
    own = shingles(hashes, COPY_WORDS)
    other = mix(own ^ _OTHER).min()
    return sorted(found), int(own[0].view(np.int64)), int(other.view(np.int64))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            found = [terms_of(t) for t in part.column("text").to_pylist()]
            terms, low, other = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("toxic"),
                    pa.array(low, pa.int64()),
                    pa.array(other, pa.int64()),
                    pa.array(terms, pa.list_(pa.string())),
                ],
                names=["doc_id", "toxic", "low", "other", "terms"],
            )


def automaton(
    lexicon: Mapping[str, float], exceptions: Sequence[str]
) -> ahocorasick.Automaton | None:
    """Terms with their weights; exception phrases carry their length instead."""
    machine = ahocorasick.Automaton()
    for term, weight in lexicon.items():
        machine.add_word(term, (len(term), float(weight)))
    for phrase in exceptions:
        term = " " + " ".join(folded(phrase).split()) + " "
        machine.add_word(term, (len(term), None))
    if not len(machine):
        return None
    machine.make_automaton()
    return machine


def weight_of(text: str | None, machine: ahocorasick.Automaton | None) -> tuple[float, int]:
    """Total weight of the matched words, and the number of words."""
    plain = folded(text)
    words = len(plain.split())
    if machine is None:
        return 0.0, words
    best: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    for end, (length, weight) in machine.iter(plain):
        start = end - length + 1
        if weight is None:
            excused.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    if excused:
        best = {s: w for s, w in best.items() if not any(a <= s < b for a, b in excused)}
    return sum(best.values()), words


def _design(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    hit = weight > 0
    return np.stack([np.ones(len(weight)), np.log1p(weight), hit * np.log1p(words), hit], axis=1)


class Model:
    def __init__(
        self, lexicon: Mapping[str, float], exceptions: Sequence[str], curve: Sequence[float]
    ) -> None:
        self.lexicon, self.exceptions, self.curve = dict(lexicon), tuple(exceptions), list(curve)

    def scores(self, weight: np.ndarray, words: np.ndarray) -> np.ndarray:
        z = _design(weight, words) @ np.array(self.curve)
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _weights(lexicon: Mapping[str, float], exceptions: Sequence[str], carried: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(lexicon, exceptions)
        for batch in batches:
            for part in slices(batch, "text"):
                pairs = [weight_of(t, machine) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(carried),
                        pa.array([w for w, _ in pairs], pa.float64()),
                        pa.array([n for _, n in pairs], pa.int64()),
                    ],
                    names=[carried, "weight", "n_words"],
                )

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Ridge-penalised logistic regression by damped Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])

    def cost(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * w @ penalty @ w)

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -700, 700)))
        step = np.linalg.solve(
            x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (p - y) + penalty @ w
        )
        size = 1.0
        while size > 1e-6 and cost(w - size * step) > cost(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def fit(
    docs: DataFrame,
    labels: DataFrame,
    extra: Mapping[str, float] | None = None,
    exceptions: Sequence[str] = EXCEPTIONS,
    toxic_rows: int = TOXIC_ROWS,
    clean_rows: int = CLEAN_ROWS,
) -> Model:
    """Learn lexicon and curve from labelled rows (doc_id, toxic) of ``docs``."""
    given = {f" {' '.join(folded(t).split())} ": w for t, w in (extra or {}).items()}
    known = labels.select(
        F.col("doc_id").cast("long"), F.col("toxic").cast("int")
    ).filter("doc_id is not null and toxic in (0, 1)")
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_all = sum(totals.values())
    if len(totals) < 2:
        share = totals.get(1, 0) / n_all if n_all else 0.0
        odds = np.log((share + 1e-6) / (1 - share + 1e-6))
        return Model(given, exceptions, [odds, 0.0, 0.0, 0.0])
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = (
        known.filter("toxic = 1").orderBy(*order).limit(toxic_rows)
        .union(known.filter("toxic = 0").orderBy(*order).limit(clean_rows))
    )
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(
        F.broadcast(chosen), "doc_id"
    )

    single = written(
        rows.mapInArrow(
            _terms, "doc_id long, toxic int, low long, other long, terms array<string>"
        )
        .groupBy("low", "other", "toxic")
        .agg(F.min(F.struct("doc_id", "terms")).alias("first"))
        .select("toxic", "first.terms"),
        "terms",
    )
    counted = (
        single.select("toxic", F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
        .filter("n >= 3")
    )
    n_bad, n_single = single.agg(F.sum("toxic"), F.count("*")).first()
    many = counted.count()
    share = n_bad / n_single
    p, q = F.col("bad") / F.col("n"), 1 - F.col("bad") / F.col("n")
    divergence = p * F.log(p / share) + F.when(q > 0, q * F.log(q / (1 - share))).otherwise(0.0)
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1.0)) - F.log(
        (F.col("n") - F.col("bad") + 0.5) / (n_single - n_bad + 1.0)
    )
    learned = (
        counted.filter(F.col("bad") > 0)
        .filter((p > share) & (F.col("n") * divergence > float(np.log(max(many, 1) / ALPHA))))
        .select("term", odds.alias("weight"))
        .filter(F.col("weight") >= LEAST_WEIGHT)
        .orderBy(F.desc("weight"), "term")
        .limit(toxic_rows)
        .collect()
    )
    lexicon = {r["term"]: r["weight"] for r in learned} | given
    table = rows.mapInArrow(
        _weights(lexicon, exceptions, "toxic"), "toxic int, weight double, n_words long"
    ).toPandas()
    table = table.sort_values(["toxic", "weight", "n_words"])
    y = table["toxic"].to_numpy(float)
    curve = _logistic(_design(table["weight"].to_numpy(), table["n_words"].to_numpy()), y)
    # back from the shares of the sample to those of all labels
    used = min(totals[1], toxic_rows), min(totals[0], clean_rows)
    curve[0] += np.log(totals[1] / used[0]) - np.log(totals[0] / used[1])
    return Model(lexicon, exceptions, curve)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted, weight, n_words), a row per row of ``docs``."""
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("score", pa.float64()),
            ("predicted", pa.int32()),
            ("weight", pa.float64()),
            ("n_words", pa.int64()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _weights(model.lexicon, model.exceptions, "doc_id")(batches):
            weight, words = part.column("weight"), part.column("n_words")
            value = model.scores(weight.to_numpy(), words.to_numpy())
            hit = (value >= THRESHOLD).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(value), pa.array(hit), weight, words],
                schema=schema,
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, score double, predicted int, weight double, n_words long"
    )
