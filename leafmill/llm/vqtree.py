"""Product quantisation of vectors by Lloyd rounds over cover trees.

Components become integers, vectors are cut into equal consecutive parts, and every part
position has a codebook of its own. Tasks take their rows in blocks and build one cover tree
per block and part position, once; all rounds walk these trees.

* A node stands for the points within its radius of its centre. Its children cover them with
  at most half the radius, rounded to a power of two, and lie further apart than that from
  one another; the centre is a child itself. Points are kept in tree order, so a node is a range
  of them and its sum the difference of two cumulative sums. Nodes of up to LEAF points or of
  one point only, however often it occurs, are not split.
* If a node's centre is nearer to one entry than to any other by more than twice the radius,
  then by the triangle inequality so are all its points: the whole subtree is assigned and adds its
  sum and count. Other nodes pass the question on to their children, and the points of leaves
  that are still open are compared exactly.

Distances are squares of integers below 2**53 and thus exact in floating point; roots are
compared with a margin that only ever sends a node down. So assignments equal exhaustive
ones, ties included (lower index).

Rows whose vector is null or holds null or non-finite components are left out. The initial
codebooks are the parts of the smallest distinct ids (of repeated ids the smallest vector counts);
fewer rows than entries make smaller codebooks. A null id is never a codebook's start but is
encoded like any other. Repeated rows are encoded alike. Vectors must share one length that the parts
divide, and components must be below 2**22 after scaling; else an error is raised. Empty tables
give an empty result. Further columns are ignored.

Sums of a round are added up per task first; what comes to the driver is one codebook. Trees
are files of the shared folder with a random name per attempt, listed in a manifest, and go when
the codes are written.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import remove, shared_folder, written
from leafmill.llm.files import mapped, make_folder, opened
from leafmill.llm.topk import quantised, usable

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
BLOCK_ROWS = 1 << 14
LEAF = 8
MAX_COMPONENT = 1 << 22
LABEL_SALT = 64
_CHUNK = 8192  # nodes compared with a codebook at a time


# --- cover trees -----------------------------------------------------------------------


class Tree:
    """Cover trees of all part positions of a block.

    ``points`` in tree order, ``order`` the place of each in (part, row); per node its centre's
    place, range, first and last child, and radius (squared).
    """

    FIELDS = ("points", "order", "centre", "start", "end", "child", "last", "radius")

    def __init__(self, **arrays: np.ndarray) -> None:
        for name in self.FIELDS:
            setattr(self, name, arrays[name])

    def arrays(self) -> dict[str, np.ndarray]:
        return {name: getattr(self, name) for name in self.FIELDS}


def _far(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = points[a] - points[b]
    return np.einsum("ij,ij->i", gap, gap)


def build(points: np.ndarray) -> Tree:
    """Trees over ``points`` (part, row, component)."""
    parts, rows, width = points.shape
    flat = points.reshape(parts * rows, width).astype(np.int64)
    order = np.arange(parts * rows)
    centre = [np.arange(parts) * rows]
    start, end = [np.arange(parts) * rows], [np.arange(1, parts + 1) * rows]
    reach = _far(flat, order, np.repeat(centre[0], rows))
    radius = [np.maximum.reduceat(reach, start[0])]
    child, last = [], []
    made = parts
    while True:
        split = (end[-1] - start[-1] > LEAF) & (radius[-1] > 0)
        child.append(np.full(len(split), -1))
        last.append(np.full(len(split), -1))
        if not split.any():
            break
        a, b, middle = start[-1][split], end[-1][split], centre[-1][split]
        # half the radius, rounded up to a power of two and squared
        cover = 4.0 ** np.ceil(np.log2(radius[-1][split]) / 2 - 1)
        sizes = b - a
        cell = np.repeat(np.arange(len(a)), sizes)
        place = np.arange(len(cell)) + np.repeat(a - np.append(0, np.cumsum(sizes)[:-1]), sizes)
        at = np.zeros(len(cell), np.int64)
        near = np.zeros(len(cell), np.int64)
        chosen = np.empty(len(cell), np.int64)
        left, own, turn = np.arange(len(cell)), middle, 0
        while len(left):
            c = cell[left]
            mid = own[c]
            d = _far(flat, order[place[left]], mid)
            hit = d <= cover[c]
            took = left[hit]
            at[took], near[took], chosen[took] = turn, d[hit], mid[hit]
            left = left[~hit]
            own = own.copy()
            c = cell[left]
            first = np.flatnonzero(np.diff(c, prepend=-1))
            own[c[first]] = order[place[left[first]]]
            turn += 1
        sort = np.argsort(cell * turn + at, kind="stable")
        order[place] = order[place[sort]]
        cell, at, near, chosen = cell[sort], at[sort], near[sort], chosen[sort]
        first = np.flatnonzero((np.diff(cell, prepend=-1) != 0) | (np.diff(at, prepend=-1) != 0))
        nodes = cell[first]
        start.append(place[first])
        end.append(place[np.append(first[1:], len(cell)) - 1] + 1)
        centre.append(chosen[first])
        radius.append(np.maximum.reduceat(near, first))
        begins = np.flatnonzero(np.diff(nodes, prepend=-1))
        child[-1][split] = made + begins
        last[-1][split] = made + np.append(begins[1:], len(nodes))
        made += len(nodes)
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.arange(len(order))
    return Tree(
        points=flat[order].astype(np.int32),
        order=order.astype(np.int32),
        centre=inverse[np.concatenate(centre)].astype(np.int32),
        start=np.concatenate(start).astype(np.int32),
        end=np.concatenate(end).astype(np.int32),
        child=np.concatenate(child).astype(np.int32),
        last=np.concatenate(last).astype(np.int32),
        radius=np.concatenate(radius),
    )


def _nearest(
    points: np.ndarray, part: np.ndarray, books: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest entry, its squared distance and that of the next one."""
    best = np.empty(len(points), np.int64)
    near, second = np.empty(len(points)), np.empty(len(points))
    for p in np.unique(part):
        book = books[p].astype(np.float64)
        of = np.flatnonzero(part == p)
        for at in range(0, len(of), _CHUNK):
            some = of[at : at + _CHUNK]
            x = points[some].astype(np.float64)
            d = (x * x).sum(axis=1)[:, None] - 2.0 * (x @ book.T) + (book * book).sum(axis=1)
            k = d.argmin(axis=1)
            row = np.arange(len(some))
            best[some], near[some] = k, d[row, k]
            d[row, k] = np.inf
            second[some] = d.min(axis=1)
    return best, near, second


class Walk:
    """Assignment of all points of a block: ranges that share an entry, and single points."""

    def __init__(self, tree: Tree, books: np.ndarray) -> None:
        rows = len(tree.order) // len(books)
        ranges, entries, singles, single_entries = [], [], [], []
        self.exact = 0
        nodes = np.arange(len(books))
        while len(nodes):
            part = tree.start[nodes] // rows
            k, near, second = _nearest(tree.points[tree.centre[nodes]], part, books)
            gap = np.sqrt(second) - np.sqrt(near)
            reach = 2.0 * np.sqrt(tree.radius[nodes].astype(np.float64))
            settled = (tree.radius[nodes] == 0) | (gap > reach * (1 + 1e-9) + 1e-6)
            ranges.append(nodes[settled])
            entries.append(k[settled])
            open_ = nodes[~settled]
            leaf = tree.child[open_] < 0
            singles.append(_ranges(tree.start[open_[leaf]], tree.end[open_[leaf]]))
            nodes = _ranges(tree.child[open_[~leaf]], tree.last[open_[~leaf]])
        self.nodes, self.entry = np.concatenate(ranges), np.concatenate(entries)
        self.places = np.concatenate(singles)
        self.place_part = self.places // rows
        self.place_entry = _nearest(tree.points[self.places], self.place_part, books)[0]
        self.node_part = tree.start[self.nodes] // rows
        self.tree = tree

    def sums(self, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the points of each (part, entry), and their number."""
        tree = self.tree
        running = np.zeros((len(tree.points) + 1, shape[2]), np.int64)
        np.cumsum(tree.points, axis=0, out=running[1:])
        a, b = tree.start[self.nodes], tree.end[self.nodes]
        total, count = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
        np.add.at(total, (self.node_part, self.entry), running[b] - running[a])
        np.add.at(count, (self.node_part, self.entry), (b - a).astype(np.int64))
        np.add.at(total, (self.place_part, self.place_entry), tree.points[self.places])
        np.add.at(count, (self.place_part, self.place_entry), 1)
        return total, count

    def codes(self) -> np.ndarray:
        """Entry of every point in tree order."""
        tree = self.tree
        out = np.empty(len(tree.points), np.int64)
        a, b = tree.start[self.nodes], tree.end[self.nodes]
        out[_ranges(a, b)] = np.repeat(self.entry, b - a)
        out[self.places] = self.place_entry
        return out


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    sizes = (end - start).astype(np.int64)
    before = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(start - before, sizes)


# --- tasks -----------------------------------------------------------------------------


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    sizes = np.diff(np.asarray(column.offsets))
    if (sizes != width).any():
        raise ValueError(f"vectors must have {width} components; one has {sizes[sizes != width][0]}")
    values = np.asarray(column.values, np.int64)[column.offsets[0].as_py() :][: len(sizes) * width]
    if np.abs(values).max(initial=0) >= MAX_COMPONENT:
        raise ValueError(f"components must be below {MAX_COMPONENT} after scaling")
    return values.reshape(len(sizes), width)


def _planted(folder: str, width: int, parts: int, block_rows: int):
    """Build the trees of every block and write them down."""

    def file(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        rows = table.num_rows
        vectors = _matrix(table.column("vec").chunk(0), width)
        tree = build(vectors.reshape(rows, parts, width // parts).transpose(1, 0, 2))
        name = f"{uuid.uuid4().hex}.trees"
        held = io.BytesIO()
        ids, labels = table.column("vec_id"), table.column("label")
        kept = pa.ipc.new_stream(held, table.select(["vec_id", "label"]).schema)
        kept.write_table(pa.table([ids, labels], names=["vec_id", "label"]))
        kept.close()
        np.savez(out := io.BytesIO(), rows=np.frombuffer(held.getvalue(), np.uint8), **tree.arrays())
        system, place = opened(f"{folder}/{name}")
        with system.open_output_stream(place, compression=None) as target:
            target.write(out.getvalue())
        return pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([rows], pa.int64())], names=["name", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                if rows + part.num_rows > block_rows:
                    yield file(waiting)
                    waiting, rows = [], 0
                waiting.append(part)
                rows += part.num_rows
        if rows:
            yield file(waiting)

    return run


def _loaded(folder: str, name: str) -> tuple[pa.Table, Tree]:
    with mapped(f"{folder}/{name}") as raw:
        with np.load(io.BytesIO(bytes(raw))) as held:
            tree = Tree(**{f: held[f] for f in Tree.FIELDS})
            rows = pa.ipc.open_stream(held["rows"].tobytes()).read_all()
    return rows, tree


def _summed(folder: str, books: np.ndarray):
    """A task's sums and counts per part, entry and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(books.shape, np.int64)
        count = np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                _, tree = _loaded(folder, name)
                t, c = Walk(tree, books).sums(books.shape)
                total += t
                count += c
        part, entry = np.nonzero(count)
        lists = pa.array(list(total[part, entry]), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(entry), pa.array(count[part, entry]), lists],
            names=["part", "entry", "n", "total"],
        )

    return run


def _coded(folder: str, books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = len(books)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                held, tree = _loaded(folder, name)
                found = Walk(tree, books).codes()
                n = held.num_rows
                part = np.arange(len(found)) // n
                gap = tree.points - books[part, found]
                codes, errors = np.empty(len(found), np.uint8), np.empty(len(found), np.int64)
                codes[tree.order] = found
                errors[tree.order] = np.einsum("ij,ij->i", gap, gap)
                text = codes.reshape(parts, n).T.tobytes().hex()
                step = 2 * parts
                yield pa.RecordBatch.from_arrays(
                    [
                        held.column("vec_id").combine_chunks(),
                        held.column("label").combine_chunks(),
                        pa.array([text[i * step : (i + 1) * step] for i in range(n)], pa.string()),
                        pa.array(errors.reshape(parts, n).sum(axis=0)),
                    ],
                    names=["vec_id", "label", "code", "error"],
                )

    return run


def _smallest(entries: int):
    """The rows of a task with the smallest ids, one of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[int]] = {}
        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            line = max(best) if len(best) >= entries else None
            some = np.flatnonzero(ids <= line) if line is not None else np.arange(len(ids))
            some = some[np.isin(ids[some], np.unique(ids[some])[:entries])]
            for i, vec in zip(ids[some].tolist(), batch.column("vec").take(some).to_pylist(), strict=True):
                best[i] = min(best.get(i, vec), vec)
            best = dict(sorted(best.items())[:entries])
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(best), pa.int64()), pa.array(list(best.values()), pa.list_(pa.int64()))],
            names=["vec_id", "vec"],
        )

    return run


# --- jobs ------------------------------------------------------------------------------


def initial_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """Parts of the vectors with the smallest distinct ids (part, entry, component)."""
    first = (
        rows.filter("vec_id is not null").select("vec_id", "vec")
        .mapInArrow(_smallest(entries), "vec_id long, vec array<long>")
        .groupBy("vec_id").agg(F.min("vec").alias("vec"))
        .orderBy("vec_id").limit(entries).collect()
    )
    if not first:
        return None
    width = len(first[0]["vec"])
    if width == 0 or width % parts or any(len(r["vec"]) != width for r in first):
        raise ValueError(f"vectors must share one length that {parts} parts divide")
    vectors = np.array([r["vec"] for r in first], np.int64)
    return vectors.reshape(len(first), parts, width // parts).transpose(1, 0, 2).copy()


def moved_books(manifest: DataFrame, folder: str, books: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the floor of the mean of its points, unused ones stay."""
    sums = (
        manifest.select("name")
        .mapInArrow(_summed(folder, books), "part long, entry long, n long, total array<long>")
        .select("part", "entry", "n", F.posexplode("total").alias("at", "total"))
        .groupBy("part", "entry", "at")
        .agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        .collect()
    )
    out = books.copy()
    for r in sums:
        out[r["part"], r["entry"], r["at"]] = r["total"] // r["n"]
    return out


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(
    rows: DataFrame,
    vector: str = "embedding",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, code, error) of every usable row, and the final codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has room for 1 to 256 entries")
    spark = rows.sparkSession
    ready = rows.filter(usable(F.col(vector))).select(
        F.col("vec_id").cast("long"),
        quantised(F.col(vector), scale).alias("vec"),
        F.col("label").cast("string"),
    )
    schema = "vec_id long, label string, code string, error long"
    books = initial_books(ready, parts, entries)
    if books is None:
        if not ready.isEmpty():
            raise ValueError("no row has an id to start the codebooks with")
        return spark.createDataFrame([], schema), None
    folder = f"{shared_folder(spark)}/trees-{uuid.uuid4().hex}"
    make_folder(folder)
    width = books.shape[0] * books.shape[2]
    manifest = written(
        ready.mapInArrow(_planted(folder, width, parts, block_rows), "name string, n long"),
        "tree-manifest",
    )
    blocks = max(1, manifest.count())
    cores = spark.sparkContext.defaultParallelism
    manifest = manifest.repartition(min(blocks, max(cores, blocks // 4)))
    for _ in range(rounds):
        books = moved_books(manifest, folder, books)
    codes = written(manifest.select("name").mapInArrow(_coded(folder, books), schema), "codes")
    remove(spark, folder)
    return codes, books


def with_label_error(codes: DataFrame) -> DataFrame:
    """Adds ``label_error``, the error summed over equal labels; null labels are equal.

    A label may hold most rows: sums are combined before they are exchanged, and each stands in
    LABEL_SALT copies that the rows are dealt over.
    """
    known = codes.withColumns(
        {
            "_none": F.col("label").isNull(),
            "_label": F.coalesce("label", F.lit("")),
            "_salt": F.pmod(F.xxhash64("vec_id", "code"), F.lit(LABEL_SALT)),
        }
    )
    sums = known.groupBy("_none", "_label").agg(F.sum("error").alias("label_error"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(LABEL_SALT - 1)).cast("array<long>"))
    return known.join(
        sums.withColumn("_salt", salts), ["_none", "_label", "_salt"]
    ).drop("_none", "_label", "_salt")
