"""Minimum-cost-flow resharding.

Given rows that lie in old shards and the capacities of the new ones, a flow network
(old shards -> new shards, cost per byte 0 for staying and 1 for moving unless a cost
matrix is given) is solved on the shard sizes; with n old and m new shards it has n + m
nodes whatever the number of rows. The optimal flow says how many bytes of each old shard go
where, which moves the fewest bytes possible.

The flow is laid onto rows in blocks. Within an old shard rows are ordered by size class,
largest first, then by a hash; its first bytes stay, the following ones go to the
destinations in turn. So boundaries fall among small rows. A boundary is found from two
histograms: sums per (shard, size class), then, for the classes that hold a boundary, sums
per 1024 hash ranges. The result is a short list of key ranges per old shard; placing a row
is a comparison, not a join of rows.

``reshard`` rewrites the files: rows are shuffled once, into files of about FILE_BYTES that
each belong to one shard. ``read_shards`` reads them back and numbers the rows of each
shard from 0 by file and by row in the file.

A null text has no bytes. A null old shard counts as shard 0; a number below 0 or not below
``old_shards`` raises an error before anything is written. Ties in size and hash (repeated
rows) go to the same shard. An empty table gives empty shards. Further columns are carried
through whatever their names, but for ``shard`` and ``slot``, which are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.llm.common import written

ROW_BYTES = 16  # counted for each row on top of its text
CLASSES = 32  # size classes per doubling
RANGES = 1024  # hash ranges of a size class
FILE_BYTES = 256 << 20


def row_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def min_cost_flow(
    sizes: Sequence[int],
    capacities: Sequence[int],
    cost: Sequence[Sequence[int]] | None = None,
) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard with the least total cost.

    Successive cheapest augmenting paths with potentials. Costs must not be negative.
    """
    if sum(sizes) > sum(capacities):
        raise ValueError("the new capacities are smaller than the old shards together")
    n, m = len(sizes), len(capacities)
    if cost is None:
        cost = [[int(i != j) for j in range(m)] for i in range(n)]
    flow: dict[tuple[int, int], int] = {}
    left, room = list(sizes), list(capacities)
    potential = [0] * (n + m)
    while any(left):
        # cheapest distances from every old shard with bytes left; new shards are n + j
        far = [float("inf")] * (n + m)
        came: list[int | None] = [None] * (n + m)
        queue = []
        for i in range(n):
            if left[i]:
                far[i] = 0
                queue.append((0, i))
        heapq.heapify(queue)
        while queue:
            d, u = heapq.heappop(queue)
            if d > far[u]:
                continue
            if u < n:
                onward = [(n + j, cost[u][j]) for j in range(m)]
            else:
                onward = [(i, -cost[i][u - n]) for i in range(n) if flow.get((i, u - n))]
            for v, c in onward:
                reduced = d + c + potential[u] - potential[v]
                if reduced < far[v]:
                    far[v], came[v] = reduced, u
                    heapq.heappush(queue, (reduced, v))
        ends = [j for j in range(m) if room[j] and far[n + j] < float("inf")]
        end = min(ends, key=lambda j: (far[n + j] + potential[n + j], j))
        reach = far[n + end]
        for v in range(n + m):
            potential[v] += min(far[v], reach)
        path, v = [n + end], n + end
        while came[v] is not None:
            v = came[v]
            path.append(v)
        path.reverse()
        amount = min(left[path[0]], room[end])
        for u, v in zip(path, path[1:], strict=False):
            if u >= n:
                amount = min(amount, flow[v, u - n])
        for u, v in zip(path, path[1:], strict=False):
            key = (u, v - n) if u < n else (v, u - n)
            flow[key] = flow.get(key, 0) + (amount if u < n else -amount)
        left[path[0]] -= amount
        room[end] -= amount
    return {k: v for k, v in flow.items() if v}


def _without(names: Sequence[str], *replaced: str) -> list[str]:
    return [c for c in names if c.lower() not in replaced]


def _keyed(rows: DataFrame, old: Column, size: Column) -> DataFrame:
    """(row, old, size, key): the user's columns as one, so that no name can clash.

    The key is (size class, largest first), then a hash range.
    """
    cls = F.floor(F.log2(size.cast("double")) * CLASSES).cast("long")
    at = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(RANGES))
    return rows.select(
        F.struct(*_without(rows.columns, "shard", "slot")).alias("row"),
        F.coalesce(old.cast("int"), F.lit(0)).alias("old"),
        size.alias("size"),
        ((-cls) * RANGES + at).alias("key"),
    )


def block_transfers(
    keyed: DataFrame, old_shards: int, capacities: Sequence[int] | int
) -> tuple[list[tuple[int, int, int, int]], dict[tuple[int, int], int]]:
    """Key ranges (old, from, to, new) that realise the cheapest flow, and the flow.

    ``capacities`` may be a number of shards of equal size.
    """
    cls = F.floor(F.col("key") / RANGES).cast("long")
    sums = (
        keyed.groupBy("old", cls.alias("cls")).agg(F.sum("size").alias("bytes")).collect()
    )
    odd = sorted({r["old"] for r in sums if not 0 <= r["old"] < old_shards})
    if odd:
        raise ValueError(f"old shards must lie in 0 to {old_shards - 1}; found {odd[:5]}")
    by_shard: list[list[tuple[int, int]]] = [[] for _ in range(old_shards)]
    for row in sums:
        by_shard[row["old"]].append((row["cls"], row["bytes"]))
    sizes = [sum(b for _, b in s) for s in by_shard]
    if isinstance(capacities, int):
        capacities = equal_capacities(sum(sizes), capacities)
    flow = min_cost_flow(sizes, capacities)

    # Boundaries as byte positions in each old shard, and the class each falls into.
    turns: dict[int, list[tuple[int, int]]] = {}
    inside: dict[tuple[int, int], int] = {}
    for i in range(old_shards):
        targets = sorted((j for a, j in flow if a == i), key=lambda j: (j != i, j))
        at = 0
        turns[i] = []
        for j in targets:
            at += flow[i, j]
            turns[i].append((at, j))
        before = 0
        for c, held in sorted(by_shard[i]):
            if any(before < end < before + held for end, _ in turns[i][:-1]):
                inside[i, c] = before
            before += held
    ranges: dict[tuple[int, int], list[tuple[int, int]]] = {k: [] for k in inside}
    if inside:
        spark = keyed.sparkSession
        wanted = spark.createDataFrame(list(inside), "old int, cls long")
        # at most one class per boundary, so fewer rows than old and new shards together
        fine = (
            keyed.withColumn("cls", cls)
            .join(F.broadcast(wanted), ["old", "cls"])
            .groupBy("old", "cls", "key")
            .agg(F.sum("size").alias("bytes"))
            .collect()
        )
        for row in fine:
            ranges[row["old"], row["cls"]].append((row["key"], row["bytes"]))

    out = []
    for i in range(old_shards):
        # the keys at which a boundary may lie, with the bytes before each
        steps = []
        before = 0
        for c, held in sorted(by_shard[i]):
            steps.append((c * RANGES, before))
            part = before
            for key, b in sorted(ranges.get((i, c), [])):
                steps.append((key, part))
                part += b
            before += held
        start = _LOWEST
        for end, j in turns[i][:-1]:
            key = min(steps, key=lambda s: (abs(s[1] - end), s[0]))[0]
            key = max(key, start)
            out.append((i, start, key, j))
            start = key
        if turns[i]:
            out.append((i, start, _HIGHEST, turns[i][-1][1]))
    return [r for r in out if r[1] < r[2]], flow


_LOWEST, _HIGHEST = -(1 << 62), 1 << 62


def place(keyed: DataFrame, transfers: list[tuple[int, int, int, int]]) -> DataFrame:
    """Adds ``shard``. The transfers are fewer than old and new shards together."""
    ranges = keyed.sparkSession.createDataFrame(
        transfers, "old int, from long, to long, shard int"
    )
    return (
        keyed.join(F.broadcast(ranges), "old")
        .filter(F.col("key").between(F.col("from"), F.col("to") - 1))
        .drop("from", "to")
    )


def reshard(
    docs: DataFrame,
    old: Column,
    old_shards: int,
    capacities: Sequence[int] | int,
    path: str,
    old_path: str | None = None,
    file_bytes: int = FILE_BYTES,
) -> dict[tuple[int, int], int]:
    """Write the shards that the flow changes and return the flow.

    Files go to ``path`` in a folder per shard. If ``old_path`` names the old shards'
    folders, a shard that neither loses nor gains rows is not written: its old files stand.
    """
    keyed = _keyed(docs, old, row_size(F.col("text")))
    transfers, flow = block_transfers(keyed, old_shards, capacities)
    changed = {x for (i, j) in flow if i != j for x in (i, j)}
    size: dict[int, int] = {}
    for (_, j), b in flow.items():
        size[j] = size.get(j, 0) + b
    placed = place(keyed, transfers)
    if old_path is not None:
        placed = placed.filter(F.col("shard").isin(sorted(changed)))
    pieces = [max(1, -(-size.get(j, 0) // file_bytes)) for j in range(max(size, default=0) + 1)]
    counts = F.array(*[F.lit(p) for p in pieces])
    first = F.array(*[F.lit(sum(pieces[:j])) for j in range(len(pieces))])
    piece = F.pmod(F.xxhash64("key", "row.doc_id"), F.get(counts, F.col("shard")))
    # a file is a partition: pieces are numbered, not hashed, so no task gets two of them
    (
        placed.withColumn("piece", (F.get(first, F.col("shard")) + piece).cast("int"))
        .repartitionById(sum(pieces), F.col("piece"))
        .sortWithinPartitions("shard", "row.doc_id")
        .select("row.*", "shard")
        .write.partitionBy("shard")
        .parquet(path)
    )
    return flow


def read_shards(docs: DataFrame, path: str) -> DataFrame:
    """The rows of all shards with ``shard`` and ``slot``, numbered from 0 in each shard."""
    names = _without(docs.columns, "shard", "slot")
    schema = docs.select(names).schema.add("shard", "integer")
    rows = docs.sparkSession.read.schema(schema).parquet(path).select(
        F.struct(*names).alias("row"),
        "shard",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("at"),
    )
    files = rows.groupBy("shard", "file").agg(F.count("*").alias("rows"))
    earlier = W.partitionBy("shard").orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    # written with a known size, so that a short list of files is not a reason to move texts
    bases = written(
        files.select("file", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("base")),
        "shard-files",
    )
    return rows.join(bases, "file").select(
        "row.*", "shard", (F.col("base") + F.col("at")).alias("slot")
    )
