"""Quality rules: base rules and a learned decision list over text statistics.

Every text is described by a row of statistics. Labelled rows teach a decision list by
sequential covering: a rule starts empty and grows by the threshold condition with the
largest information gain on two thirds of the rows not yet covered, then its last conditions
are pruned as long as that does not lower (right - wrong) / covered on the other third.
A rule that is no better than the default on the held back third ends the search for its
class. Covered rows leave the table and the next rule is learned. Both classes get
rules in turn, the rarer first. The result is a list of readable conjunctions such as
``dup_share > 0.31 and n_words <= 80 -> reject``, emitted as one ordered Spark CASE
expression with the majority class of the uncovered rows as its default.

At most SAMPLE labelled rows (those with the lowest hash of their id) are used to learn; the
statistics and the verdict cover all rows.

A null text counts as empty: all statistics are 0 and the base rules fail. Rows whose
label or id is null teach nothing. Without labels the list is empty and only the base
rules decide. Repeated rows get equal results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import SPACE, mix, slices, text_buffer, word_hashes

SAMPLE = 20_000
REPEAT_WINDOW = 8
MAX_RULES, MAX_CONDITIONS, CUTS = 12, 4, 32
BLANKS = " \t\n\x0b\x0c\r"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?;:,"]] = True

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_digits", "n_upper", "n_stops", "n_distinct_words",
)


def _row_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.add.reduceat(np.append(flags, False), offsets[:-1], dtype=np.int64)
    return np.where(np.diff(offsets) > 0, total, 0)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = text_buffer(part.column("text"))
            hashes, n_words = word_hashes(data, offsets, lower=False)
            row = np.repeat(np.arange(len(n_words)), n_words)
            own = mix(row.astype(np.uint64) + np.uint64(1))

            repeated = np.zeros(len(hashes) + 1, np.int32)
            many = len(hashes) - REPEAT_WINDOW + 1
            if many > 0:
                start = np.flatnonzero(row[:many] == row[REPEAT_WINDOW - 1 :])
                window = own[start]
                for j in range(REPEAT_WINDOW):
                    window = mix(window * np.uint64(0x9E3779B97F4A7C15) + hashes[start + j])
                _, at, times = np.unique(window, return_inverse=True, return_counts=True)
                again = start[times[at] > 1]
                repeated[again] += 1
                repeated[again + REPEAT_WINDOW] -= 1
            covered = np.cumsum(repeated[:-1]) > 0
            first = np.unique(mix(own + hashes), return_index=True)[1]

            lines = np.zeros(len(n_words), np.int64)
            again_lines = np.zeros(len(n_words), np.int64)
            for i, text in enumerate(part.column("text").to_pylist()):
                if text:
                    split = text.split("\n")
                    full = [x for x in split if x.strip(BLANKS)]
                    lines[i] = len(full)
                    again_lines[i] = len(full) - len(set(full))
            in_word = ~SPACE[data] & ((data & 0xC0) != 0x80)
            values = {
                "n_words": n_words,
                "word_chars": _row_sums(in_word, offsets),
                "n_symbols": _row_sums(_SYMBOL[data], offsets),
                "n_dup_lines": again_lines,
                "n_repeat_words": np.bincount(row[covered], minlength=len(n_words)),
                "n_lines": lines,
                "n_digits": _row_sums(_DIGIT[data], offsets),
                "n_upper": _row_sums(_UPPER[data], offsets),
                "n_stops": _row_sums(_STOP[data], offsets),
                "n_distinct_words": np.bincount(row[first], minlength=len(n_words)),
            }
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(values[c].astype(np.int64)) for c in COUNTS)],
                names=["doc_id", *COUNTS],
            )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every whole text."""
    schema = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS)])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _statistics, schema
    )


def features() -> dict[str, Column]:
    """Named measures that conditions may use."""

    def per(n: str, of: str) -> Column:
        return F.col(n) / F.greatest(F.col(of), F.lit(1))

    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word_chars": per("word_chars", "n_words"),
        "symbol_share": per("n_symbols", "word_chars"),
        "digit_share": per("n_digits", "word_chars"),
        "upper_share": per("n_upper", "word_chars"),
        "stop_share": per("n_stops", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "distinct_share": per("n_distinct_words", "n_words"),
        "words_per_line": per("n_words", "n_lines"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, above, threshold) and the class it stands for."""

    conditions: tuple[tuple[str, bool, float], ...]
    keep: bool

    def covers(self, table: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(table.values())))
        hit = np.ones(n, bool)
        for name, above, cut in self.conditions:
            hit &= table[name] > cut if above else table[name] <= cut
        return hit

    def column(self) -> Column:
        measures = features()
        parts = [
            measures[name] > cut if above else measures[name] <= cut
            for name, above, cut in self.conditions
        ]
        return reduce(lambda a, b: a & b, parts)

    def __str__(self) -> str:
        text = " and ".join(f"{n} {'>' if a else '<='} {c:g}" for n, a, c in self.conditions)
        return f"{text} -> {'keep' if self.keep else 'reject'}"


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...]
    default: bool

    def column(self) -> Column:
        """Ordered CASE expression over the columns of ``statistics``."""
        out = F
        for rule in self.rules:
            out = out.when(rule.column(), F.lit(rule.keep))
        return F.lit(self.default) if out is F else out.otherwise(F.lit(self.default))


def _grow(table: dict[str, np.ndarray], good: np.ndarray) -> list[tuple[str, bool, float]]:
    """Conditions by FOIL gain, until no wrong row is left or nothing is gained."""
    inside = np.ones(len(good), bool)
    conditions: list[tuple[str, bool, float]] = []
    while len(conditions) < MAX_CONDITIONS and not good[inside].all():
        p0, n0 = good[inside].sum(), (~good[inside]).sum()
        before = np.log2(p0 / (p0 + n0))
        best = None
        for name, values in table.items():
            own = values[inside]
            cuts = np.unique(np.quantile(own, np.linspace(0, 1, CUTS + 1), method="lower"))
            for cut in cuts[:-1]:
                low = own <= cut
                for above, side in ((False, low), (True, ~low)):
                    p, n = good[inside][side].sum(), (~good[inside][side]).sum()
                    if p:
                        gain = p * (np.log2(p / (p + n)) - before)
                        if best is None or gain > best[0] + 1e-9:
                            best = (gain, name, above, float(cut))
        if best is None or best[0] <= 0:
            break
        _, name, above, cut = best
        conditions.append((name, above, cut))
        inside &= table[name] > cut if above else table[name] <= cut
    return conditions


def _worth(rule: Rule, table: dict[str, np.ndarray], good: np.ndarray) -> float:
    hit = rule.covers(table)
    return (2 * good[hit].sum() - hit.sum()) / max(1, hit.sum())


def learn(table: dict[str, np.ndarray], keep: np.ndarray, fold: np.ndarray) -> DecisionList:
    """Sequential covering. ``fold`` numbers rows; every third is held back for pruning."""
    rules: list[Rule] = []
    classes = sorted({bool(k) for k in keep}, key=lambda c: (keep == c).mean())
    open_classes = list(classes) if len(classes) > 1 else []
    while open_classes and len(rules) < MAX_RULES:
        for wanted in list(open_classes):
            good = keep == wanted
            part, held = fold % 3 != 0, fold % 3 == 0
            if good[part].sum() < 3 or good[held].sum() < 1 or good.all():
                open_classes.remove(wanted)
                continue
            rule = Rule(tuple(_grow({k: v[part] for k, v in table.items()}, good[part])), wanted)
            apart = {k: v[held] for k, v in table.items()}
            while len(rule.conditions) > 1:
                shorter = Rule(rule.conditions[:-1], wanted)
                if _worth(shorter, apart, good[held]) < _worth(rule, apart, good[held]):
                    break
                rule = shorter
            hit = rule.covers(table) if rule.conditions else np.zeros(len(keep), bool)
            # better than the default on the rows held back
            if not rule.conditions or not hit[held].any() or good[held & hit].mean() <= max(
                0.5, good[held].mean()
            ):
                open_classes.remove(wanted)
                continue
            rules.append(rule)
            table = {k: v[~hit] for k, v in table.items()}
            keep, fold = keep[~hit], fold[~hit]
            if not len(keep):
                open_classes = []
                break
    default = bool(keep.mean() >= 0.5) if len(keep) else True
    return DecisionList(tuple(rules), default)


def fit(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DecisionList:
    """Learn from labelled rows (doc_id, quality): 1 keep, 0 reject."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).filter(
        "doc_id is not null and quality is not null"
    )
    order = F.xxhash64("doc_id")
    chosen = known.orderBy(order, "doc_id").limit(sample)
    named = {name: column.alias(name) for name, column in features().items()}
    rows = (
        stats.join(F.broadcast(chosen), "doc_id")
        .filter(~base_failed())
        .select("doc_id", "quality", *(c.alias(f"f_{n}") for n, c in named.items()))
        .orderBy(order, "doc_id", *(f"f_{n}" for n in named))
        .limit(2 * sample)
        .toPandas()
    )
    if rows.empty:
        return DecisionList((), True)
    table = {n: rows[f"f_{n}"].to_numpy(float) for n in named}
    return learn(table, rows["quality"].to_numpy() == 1, np.arange(len(rows)))
