"""MinHash near-duplicates verified with odd sketches.

1. Every text becomes its set of distinct word shingles (64-bit hashes), a MinHash
   signature cut into bands, and an odd sketch: a bitmap in which each (position, MinHash)
   sample flips one bit. The XOR of two odd sketches is the odd sketch of the samples that
   differ, so its population count z estimates how many do, and with m bits and k samples
   the similarity is 1 + m / (4 k) * ln(1 - 2 z / m), as each differing position flips two
   bits. This is sharpest at high similarities.
2. Texts with equal sets are one class, represented by its smallest id.
3. Representatives that share a band are candidates. Within a bucket all pairs are never
   listed: a bucket's smallest id is compared with its members, links are contracted to
   components, and only buckets whose members still lie in different components go on.
   There, the members outside the bucket's largest component are compared with all members
   of other components. Both sides are cut into blocks of bounded size, a pair of blocks is
   one task's work, and only links that join two components leave it. Buckets with the
   same smallest id are taken together, since they share most of their members. So every
   pair of a bucket is compared or already connected.
4. A candidate pair is first judged by its odd sketches, with a margin of more than five
   standard errors, and then confirmed on the full sets.

With 32 bands of 4, a pair at the threshold of 0.8 shares no band with probability 5e-8.

Rows without words or text have an empty set and are linked with nothing. Rows that share
a ``doc_id`` count as one document. A null ``doc_id`` can name no component: such a row
gets a null component and is kept. Further input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import (
    Scratch,
    checkpointed,
    int64_lists,
    mix,
    slices,
    text_buffer,
    word_hashes,
    written,
)

SHINGLE = 5
BANDS, ROWS = 32, 4
SKETCH_BITS = 1024
# A pair goes on to its full sets if the sketches put it above threshold - SKETCH_MARGIN.
# One standard error is about 0.035 from sampling and 0.015 from the bitmap.
SKETCH_MARGIN = 0.22
# Shingles in a block of a bucket that is compared inside one task (8 bytes each).
BLOCK_SHINGLES = 400_000


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; a shorter text is one shingle."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(n, k)
    out = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : n - width + 1 + j])
    return np.unique(out)


_SEEDS = mix(np.arange(1, 1 + 2 * BANDS * ROWS, dtype=np.uint64))
_FACTOR = (_SEEDS[: BANDS * ROWS] | np.uint64(1)).astype(np.uint32)
_SHIFT = (_SEEDS[BANDS * ROWS :] >> np.uint64(32)).astype(np.uint32)


def minhash(found: np.ndarray) -> np.ndarray:
    """Minimum of each hash function over a set; worked through in short pieces."""
    short = (found >> np.uint64(32)).astype(np.uint32)
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 2048):
        part = short[None, at : at + 2048] * _FACTOR[:, None]
        part += _SHIFT[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return low


def odd_sketch(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmaps of rows of MinHash samples, as 64-bit words."""
    place = np.arange(samples.shape[1], dtype=np.uint64) << np.uint64(32)
    at = (mix(samples.astype(np.uint64) + place) % np.uint64(bits)).astype(np.int64)
    flat = at + np.arange(len(samples))[:, None] * bits
    flips = np.bincount(flat.reshape(-1), minlength=len(samples) * bits) & 1
    packed = np.packbits(flips.astype(np.uint8).reshape(len(samples), bits), axis=1)
    return packed.view(np.uint64)


def _signatures(k: int):
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_shingles", pa.int64()),
            ("set_a", pa.int64()),
            ("set_b", pa.int64()),
            ("bands", pa.list_(pa.int64())),
            ("sketch", pa.list_(pa.int64())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, counts = word_hashes(*text_buffer(part.column("text")))
                ends = np.cumsum(counts)
                n = np.zeros(len(counts), np.int64)
                key = np.zeros((2, len(counts)), np.uint64)
                low = np.zeros((len(counts), BANDS * ROWS), np.uint32)
                for i, (end, count) in enumerate(zip(ends, counts, strict=True)):
                    if count:
                        found = shingles(hashes[end - count : end], k)
                        n[i] = len(found)
                        key[0, i] = np.add.reduce(found)
                        key[1, i] = np.add.reduce(mix(found))
                        low[i] = minhash(found)
                band = np.tile(np.arange(BANDS, dtype=np.uint64), (len(counts), 1))
                for r in range(ROWS):
                    band = mix(band * np.uint64(0x9E3779B97F4A7C15) + low[:, r::ROWS])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        pa.array(n),
                        pa.array(key[0].view(np.int64)),
                        pa.array(key[1].view(np.int64)),
                        int64_lists(band, BANDS),
                        int64_lists(odd_sketch(low), SKETCH_BITS // 64),
                    ],
                    schema=schema,
                )

    return run


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, counts = word_hashes(*text_buffer(part.column("text")))
                ends = np.cumsum(counts)
                sets = [
                    shingles(hashes[e - c : e], k) for e, c in zip(ends, counts, strict=True)
                ]
                sizes = np.cumsum([0, *(len(s) for s in sets)]).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), lists], names=["doc_id", "members"]
                )

    return run


def sketch_similarity(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity from two odd sketches; 0 where they are saturated."""
    ones = F.aggregate(
        F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))),
        F.lit(0),
        lambda total, x: total + x,
    )
    free = F.lit(1.0) - 2.0 * ones / float(SKETCH_BITS)
    estimate = F.lit(1.0) + F.log(free) * (SKETCH_BITS / (4.0 * BANDS * ROWS))
    return F.when(free > 0, estimate).otherwise(0.0)


def _compared(similarity: tuple[int, int]):
    """Links between the asking rows of a block and the rows of other components."""
    need, base = similarity
    floor = need / base - SKETCH_MARGIN
    most_ones = SKETCH_BITS * (1 - np.exp((floor - 1) * 4 * BANDS * ROWS / SKETCH_BITS)) / 2

    def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
        flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return flat.view(np.uint64).reshape(-1, width)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_numpy()
        asks = table.column("asks").to_numpy()
        sketch = matrix(table.column("sketch"), SKETCH_BITS // 64)
        members = table.column("members").combine_chunks()
        flat = members.flatten().to_numpy()
        sizes = np.diff(members.offsets.to_numpy()).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        seen, code = np.unique(flat, return_inverse=True)
        _, root = np.unique(table.column("root").to_numpy(), return_inverse=True)
        marked = np.zeros(len(seen), bool)
        out: list[tuple[int, int]] = []
        for i in np.flatnonzero(asks):
            near = ~asks & (root != root[i])
            near &= base * np.minimum(sizes, sizes[i]) >= need * np.maximum(sizes, sizes[i])
            at = np.flatnonzero(near)
            ones = np.bitwise_count(sketch[at] ^ sketch[i]).sum(axis=1, dtype=np.int64)
            at = at[ones <= most_ones]
            if not len(at):
                continue
            own = code[starts[i] : starts[i] + sizes[i]]
            marked[own] = True
            theirs = np.concatenate([code[starts[j] : starts[j] + sizes[j]] for j in at])
            cuts = np.concatenate([[0], np.cumsum(sizes[at])[:-1]])
            both = np.add.reduceat(marked[theirs], cuts, dtype=np.int64)
            marked[own] = False
            for j in at[base * both >= need * (sizes[at] + sizes[i] - both)]:
                if root[j] != root[i]:
                    root[root == root[j]] = root[i]
                    out.append((int(ids[i]), int(ids[j])))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) with the smallest node of each component; alternating star contraction.

    Large stars hang every larger neighbour of a node on its smallest neighbour, small stars
    every smaller one. Each step works on edges grouped by node, and the number of steps
    grows with the logarithm of the component's size.
    """
    edges = checkpointed(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("u != v")
        .distinct()
    )

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()

    seen = state(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), "m")
        large = large.toDF("u", "v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u != v")
            .union(low.toDF("u", "v"))
            .distinct()
        )
        edges = checkpointed(small)
        now = state(edges)
        if now == seen:
            return edges.toDF("node", "root")
        seen = now


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    similarity: tuple[int, int] = (80, 100),
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row per row of ``docs``.

    Two documents are linked if ``similarity[1] * intersection >= similarity[0] * union``.
    The margins here are laid out for similarities of 0.8 or more.
    """
    if similarity[0] * 5 < similarity[1] * 4:
        raise ValueError("bands and margin are laid out for a similarity of 0.8 or more")
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    with Scratch(spark) as scratch:
        signed = scratch.table(
            texts.mapInArrow(
                _signatures(shingle),
                "doc_id long, n_shingles long, set_a long, set_b long, "
                "bands array<long>, sketch array<long>",
            ),
            "signatures",
        )
        named = signed.filter("doc_id is not null and n_shingles > 0")
        own = ["set_a", "set_b"]
        classes = checkpointed(named.groupBy(*own).agg(F.min("doc_id").alias("rep")))
        reps = named.join(
            classes.withColumnRenamed("rep", "doc_id"), [*own, "doc_id"], "left_semi"
        )
        sketches = reps.select("doc_id", "n_shingles", "sketch")

        keys = reps.select("doc_id", F.explode("bands").alias("band"))
        shared = (
            keys.groupBy("band")
            .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
            .filter("low != high")
            .drop("high")
        )
        # (a, b): b shares a band whose smallest id is a
        stars = checkpointed(
            keys.join(shared, "band")
            .filter("doc_id != low")
            .select(F.col("low").alias("a"), F.col("doc_id").alias("b"))
            .distinct()
        )
        wanted = stars.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        sets = scratch.table(
            texts.join(wanted, "doc_id", "left_semi").mapInArrow(
                _full_sets(shingle), "doc_id long, members array<long>"
            ),
            "sets",
        )

        def confirmed(pairs: DataFrame) -> DataFrame:
            """Pairs (a, b) that pass the odd sketches and then the full sets."""

            def side(table: DataFrame, end: str) -> DataFrame:
                return table.toDF(end, *(f"{c}_{end}" for c in table.columns[1:]))

            floor = similarity[0] / similarity[1] - SKETCH_MARGIN
            near = (
                pairs.join(side(sketches, "a"), "a")
                .join(side(sketches, "b"), "b")
                # a set much smaller than the other can't reach the threshold
                .filter(
                    similarity[1] * F.least("n_shingles_a", "n_shingles_b")
                    >= similarity[0] * F.greatest("n_shingles_a", "n_shingles_b")
                )
                .filter(sketch_similarity(F.col("sketch_a"), F.col("sketch_b")) >= floor)
                .select("a", "b")
                .distinct()
            )
            both = F.size(F.array_intersect("members_a", "members_b"))
            union = F.size("members_a") + F.size("members_b") - both
            return (
                near.join(side(sets, "a"), "a")
                .join(side(sets, "b"), "b")
                .filter(similarity[1] * both >= similarity[0] * union)
                .select("a", "b")
            )

        # Rows of one document may lie in several classes.
        member = named.join(classes, own).select("doc_id", "rep")
        several = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z"))
        links = member.join(several.filter("a != z"), "doc_id").select("a", F.col("rep").alias("b"))

        roots = components(confirmed(stars).union(links))
        # The smallest id of each bucket has been compared with all of it. Buckets with the
        # same smallest id are one group from here on, as they share most members. In groups
        # that still span several components, members outside the largest one ask all others.
        rest = stars.toDF("low", "doc_id")
        rest = rest.join(roots.toDF("doc_id", "root"), "doc_id", "left").select(
            "low", "doc_id", F.coalesce("root", "doc_id").alias("root")
        )
        inside = rest.groupBy("low", "root").agg(F.count("*").alias("n"))
        main = (
            inside.groupBy("low")
            .agg(F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("roots"))
            .filter("roots > 1")
            .select("low", F.col("m.root").alias("main"))
        )
        open_ = (
            rest.join(main, "low")
            .join(sketches, "doc_id")
            .withColumn("minor", F.col("root") != F.col("main"))
        )
        weight = (
            open_.groupBy("low")
            .agg(
                F.sum("n_shingles").alias("all_size"),
                F.sum(F.when(F.col("minor"), F.col("n_shingles"))).alias("minor_size"),
            )
            .select(
                "low",
                F.ceil(F.col("minor_size") / BLOCK_SHINGLES).cast("int").alias("minor_blocks"),
                F.ceil(F.col("all_size") / BLOCK_SHINGLES).cast("int").alias("blocks"),
            )
        )

        def block(n: str) -> Column:
            return F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")

        def every(n: str) -> Column:
            return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

        row = ["low", "doc_id", "root", "sketch"]
        open_ = open_.join(weight, "low")
        asking = open_.filter("minor").select(
            *row, F.lit(True).alias("asks"), block("minor_blocks").alias("p"), every("blocks")
        )
        asked = open_.select(
            *row, F.lit(False).alias("asks"), every("minor_blocks"), block("blocks").alias("q")
        )
        names = [*row, "asks", "p", "q"]
        found_links = (
            asking.toDF(*names)
            .union(asked.toDF(*names))
            .join(sets, "doc_id")
            .groupBy("low", "p", "q")
            .applyInArrow(_compared(similarity), "a long, b long")
        )
        roots = components(found_links.union(roots.toDF("a", "b")))

        final = classes.join(roots.toDF("rep", "root"), "rep", "left").select(
            *own, F.coalesce("root", "rep").alias("root")
        )
        narrow = signed.select("doc_id", "n_shingles", *own)
        found = narrow.filter("doc_id is not null and n_shingles > 0").join(final, own)
        alone = narrow.filter("doc_id is null or n_shingles = 0").withColumn(
            "root", F.col("doc_id")
        )
        return checkpointed(
            found.select("doc_id", "n_shingles", "root")
            .union(alone.select("doc_id", "n_shingles", "root"))
            .select(
                "doc_id",
                "n_shingles",
                F.col("root").alias("component_id"),
                F.coalesce(F.col("doc_id") == F.col("root"), F.lit(True)).alias("kept"),
            )
        )


def keep_one_of_each(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Rows of ``docs`` without those whose component has a smaller id."""
    gone = near_duplicates(docs, shingle).filter("not kept").select("doc_id").distinct()
    return docs.join(written(gone, "copies"), "doc_id", "left_anti").select(docs.columns)
