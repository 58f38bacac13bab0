"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation.

Vectors become sparse integer rows; a position of a vector is a term, its value the
term's weight. Inside a task the candidates at hand are turned into postings, for each term the
rows that hold it and their values. Query rows are worked off in small groups: term by term the
postings, times the weights of the queries, are scattered into a dense array of scores
(candidate x query). No candidate is skipped. What reaches the k-th best score of a query is
selected by partition; the selections are merged first in the task, then over all tasks.

Queries and candidates are dealt over a grid: queries into rows of about QUERY_ROWS, candidates
into columns of about CANDIDATE_ROWS, both by a hash of id and vector. A cell of the grid gets its
queries first and then streams its candidates in batches, so memory is bounded by one block
of queries, one batch and k results per query, whatever the table's size or a cell's share.
What is moved is (rows + columns of the grid) copies, what is computed the product.

Ties go to the smaller id. A candidate with the query's id is the query's own row and no result.
Repeated candidate rows are rows of their own; equal query rows are answered once, query rows
of one id with different vectors each. Vectors that are null or hold null or non-finite
components and rows without an id take no part. Where lengths differ, what the shorter vector
lacks is 0; an empty vector scores 0 with everything. Empty tables give an empty result.
Further columns are ignored. Scores beyond 64 bits raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUERY_ROWS = 2048
CANDIDATE_ROWS = 1 << 16
GROUP = 64  # queries that share a score array
BATCH = 4096  # candidates of a score array
MAX_PARTITIONS = 100_000


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    sound = F.forall(
        vector.cast("array<double>"),
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")),
    )
    return F.coalesce(sound, F.lit(False))


def quantised(vector: Column, scale: int = 256) -> Column:
    """Components as floor(scale * x), x as double."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * scale).cast("long"))


class Postings:
    """Rows of a list column by term: all entries sorted by term, zeros left out."""

    def __init__(self, lists: pa.ListArray) -> None:
        offsets = np.asarray(lists.offsets, np.int64)
        values = np.asarray(lists.values, np.int64)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        self.rows = len(lists)
        sizes = np.diff(offsets)
        row = np.repeat(np.arange(self.rows), sizes)
        term = np.arange(len(values)) - np.repeat(offsets[:-1], sizes)
        held = np.flatnonzero(values)
        held = held[np.argsort(term[held], kind="stable")]
        self.row, self.value = row[held], values[held]
        self.terms, at = np.unique(term[held], return_index=True)
        self.at = np.append(at, len(held))
        self.largest = int(np.abs(self.value).max(initial=0))

    def mass(self) -> int:
        """The largest sum of absolute values of a row."""
        if not len(self.row):
            return 0
        sums = np.bincount(self.row, np.abs(self.value).astype(np.float64), self.rows)
        return int(sums.max()) + 1


def _scores(queries: Postings, candidates: Postings, start: int, stop: int) -> np.ndarray:
    """Scores of all candidates (rows) with queries start to stop (columns)."""
    bound = queries.mass() * max(candidates.largest, 1)
    if bound >= 1 << 62:
        raise OverflowError("inner products do not fit into 64 bits")
    kind = np.int32 if bound < 1 << 30 else np.int64
    scores = np.zeros((candidates.rows, stop - start), kind)
    _, ours, theirs = np.intersect1d(
        queries.terms, candidates.terms, assume_unique=True, return_indices=True
    )
    for t, u in zip(ours, theirs, strict=True):
        a, b = queries.at[t], queries.at[t + 1]
        # rows of a posting ascend
        a, b = a + np.searchsorted(queries.row[a:b], [start, stop])
        if a == b:
            continue
        weights = np.zeros(stop - start, kind)
        weights[queries.row[a:b] - start] = queries.value[a:b]
        c, d = candidates.at[u], candidates.at[u + 1]
        values = candidates.value[c:d].astype(kind)
        if d - c == candidates.rows:
            scores += values[:, None] * weights
        elif b - a > GROUP // 4:
            scores[candidates.row[c:d]] += values[:, None] * weights
        else:
            some = queries.row[a:b] - start
            scores[np.ix_(candidates.row[c:d], some)] += values[:, None] * weights[some]
    return scores


def _best(found: list[np.ndarray], k: int) -> np.ndarray:
    """The k best of each query of rows (query, score, id)."""
    if not found:
        return np.zeros((0, 3), np.int64)
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
    first = np.searchsorted(rows[:, 0], rows[:, 0], side="left")
    return rows[np.arange(len(rows)) - first < k]


class Cell:
    """The queries of a cell, and the best candidates so far."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.batches: list[pa.RecordBatch] = []
        self.queries: Postings | None = None
        self.best = np.zeros((0, 3), np.int64)

    def add_queries(self, rows: pa.RecordBatch) -> None:
        self.batches.append(rows)

    def add_candidates(self, rows: pa.RecordBatch) -> None:
        if not self.batches:
            return
        if self.queries is None:
            table = pa.Table.from_batches(self.batches).combine_chunks()
            self.ids = table.column("id").to_numpy()
            self.copies = table.column("copy").to_numpy()
            self.queries = Postings(table.column("vec").chunk(0))
        for at in range(0, rows.num_rows, BATCH):
            part = rows.slice(at, BATCH)
            ids = part.column("id").to_numpy()
            postings = Postings(part.column("vec"))
            found = [self.best]
            for start in range(0, len(self.ids), GROUP):
                stop = min(start + GROUP, len(self.ids))
                scores = _scores(self.queries, postings, start, stop).T.copy()
                own = self.ids[start:stop, None] == ids
                lowest = np.iinfo(scores.dtype).min
                scores[own] = lowest
                cut = max(len(ids) - self.k, 0)
                line = np.partition(scores, cut, axis=1)[:, cut]
                q, c = np.nonzero((scores >= line[:, None]) & ~own)
                chosen = np.stack([q + start, scores[q, c].astype(np.int64), ids[c]], axis=1)
                found.append(_best([chosen], self.k))
            self.best = _best(found, self.k)

    def result(self) -> pa.RecordBatch | None:
        if not len(self.best):
            return None
        q, score, vec_id = self.best.T
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (self.ids[q], self.copies[q], vec_id, score)],
            names=["query_id", "copy", "vec_id", "score"],
        )


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cell = None, Cell(k)
        for batch in batches:
            numbers = batch.column("cell").to_numpy()
            sides = batch.column("side").to_numpy()
            cuts = np.flatnonzero(np.diff(numbers) | np.diff(sides)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if a == b:
                    continue
                if numbers[a] != at:
                    if (out := cell.result()) is not None:
                        yield out
                    at, cell = numbers[a], Cell(k)
                part = batch.slice(a, b - a)
                (cell.add_candidates if sides[a] else cell.add_queries)(part)
        if (out := cell.result()) is not None:
            yield out

    return run


def top_k(
    candidates: DataFrame,
    queries: DataFrame,
    k: int = 5,
    query_rows: int = QUERY_ROWS,
    candidate_rows: int = CANDIDATE_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query.

    Both frames hold ``vec_id`` and integer components ``vec``.
    """
    spark = candidates.sparkSession
    hashed = F.xxhash64("id", "vec")
    sides = [
        side.select(F.col("vec_id").cast("long").alias("id"), F.col("vec").cast("array<long>"))
        .filter("id is not null and vec is not null")
        .withColumn("copy", hashed)
        for side in (queries, candidates)
    ]
    asked, held = sides[0].dropDuplicates(["id", "copy"]), sides[1]
    n_asked, n_held = sides[0].count(), held.count()
    cores = spark.sparkContext.defaultParallelism
    rows = max(1, -(-n_asked // query_rows))
    columns = max(1, -(-n_held // candidate_rows), min(cores // rows, n_held // BATCH))
    row, column = F.pmod("copy", F.lit(rows)), F.pmod("copy", F.lit(columns))

    def spread(side: DataFrame, number: int, own: Column, others: int, cell) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(others - 1)).cast("array<long>"))
        return side.select("*", every.alias("other")).select(
            cell(own, F.col("other")).alias("cell"), F.lit(number).alias("side"), "id", "copy", "vec"
        )

    cells = spread(asked, 0, row, columns, lambda r, c: r * columns + c).unionAll(
        spread(held, 1, column, rows, lambda c, r: r * columns + c)
    )
    parts = min(rows * columns, MAX_PARTITIONS)
    found = (
        cells.repartitionById(parts, F.pmod("cell", F.lit(parts)).cast("int"))
        .sortWithinPartitions("cell", "side")
        .mapInArrow(_searched(k), "query_id long, copy long, vec_id long, score long")
    )
    order = W.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
