"""Benchmark decontamination with spaced seeds, in built-in expressions only.

Tokens are lower-cased runs of letters and digits. A mask such as ``111000111`` is laid
over every position of documents and items and keeps the tokens under its ones; their
hash is the seed, so a substitution under a zero changes nothing. The three default masks
keep two of four blocks of three tokens (all other choices are shifts of these), so any
twelve aligned tokens with at most two substitutions share at least one seed. More scattered
substitutions may leave none: over random places 97.5 % of 15 tokens with 3 substitutions and
99.8 % of 20 tokens with 4 were found.

A seed hit fixes a diagonal. On it the tokens of both sides are compared one by one over the
whole item. If any window of at least ``min_tokens`` pairs has ``min_share`` of them equal, the
longest such window (the first of equally long ones) is the overlap; unequal pairs at its ends are
left out as long as ``min_tokens`` remain. A run of hits on one diagonal is judged once. Of an
item with fewer tokens than ``min_tokens`` the whole is asked for in their place.

Seeds of the items are broadcast only if there are at most BROADCAST_SEEDS of them (about
100 MB), otherwise both sides are shuffled on the seed and the documents' tokens are fetched
for the hits alone. Documents are worked through in pieces of PIECE tokens.

Null and empty texts have no overlaps; items of fewer than six tokens are too short for
a seed and are not searched for. Repeated items and repeated rows of a document give the
same overlaps once. Rows with a null id cannot be named and are left out of the result;
``clean_documents`` leaves such documents in. Further columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import written

MASKS = ("111111", "111000111", "111000000111")
MIN_TOKENS, MIN_SHARE = 12, 0.8
REACH = 64
PIECE = 4096
BROADCAST_SEEDS = 1 << 20


def token_hashes(text: Column) -> Column:
    """Hash of every token; null counts as empty. Empty strings at the ends are no tokens."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_remove(F.transform(words, lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))


def _seeds(tokens: str, at: Column, masks: tuple[str, ...]) -> Column:
    """One seed per mask at a position; null where the mask sticks out."""
    out = []
    for number, mask in enumerate(masks):
        kept = [F.get(tokens, at + k) for k, bit in enumerate(mask) if bit == "1"]
        out.append(F.when(kept[-1].isNotNull(), F.xxhash64(F.lit(number), *kept)))
    return F.array(*out)


def _positions(
    rows: DataFrame, keys: list[str], masks: tuple[str, ...], context: int = REACH
) -> DataFrame:
    """keys, base, piece, at, seed: a row per position and mask of tokens cut into pieces.

    A piece carries ``context`` tokens or more on either side; ``at`` counts inside it.
    """
    step = max(PIECE, context)
    base = F.greatest(F.col("from") - context, F.lit(0))
    pieces = rows.select(
        *keys,
        "tokens",
        F.explode(F.sequence(F.lit(0), F.greatest(F.size("tokens") - 1, F.lit(0)), F.lit(step)))
        .alias("from"),
    ).select(
        *keys,
        base.alias("base"),
        F.col("from"),
        F.slice("tokens", base + 1, F.lit(step + 3 * context)).alias("piece"),
    )
    first = F.col("from") - F.col("base")
    last = F.least(first + step, F.size("piece")) - 1
    at = pieces.select(
        *keys, "base", "piece", F.explode(F.sequence(first, F.greatest(first, last))).alias("at")
    )
    return at.select(
        *keys, "base", "piece", "at", F.explode(_seeds("piece", F.col("at"), masks)).alias("seed")
    ).filter("seed is not null")


def _longest(flags: Column, min_share: float) -> Column:
    """Start and length of the longest window with ``min_share`` of its flags true.

    An equal pair adds ``gain`` and another takes ``loss`` from a running sum, so a window is
    good if the sum does not fall over it. The longest one starts behind an unequal pair or
    at the front, and ends before one or at the back; these places are gone through by
    rising sum with the earliest start so far.
    """
    share = Fraction(str(min_share))
    gain, loss = share.denominator - share.numerator, share.numerator

    def places(edges: Column, kind: int, shift: int) -> Column:
        return F.transform(
            edges,
            lambda p, k: F.struct(
                ((p + shift - k) * F.lit(gain).cast("long") - k * F.lit(loss).cast("long"))
                .alias("sum"),
                F.lit(kind).alias("end"),
                (p + shift).alias("at"),
            ),
        )

    unequal = F.filter(
        F.transform(flags, lambda f, i: F.when(~f, i)), lambda p: p.isNotNull()
    )
    starts = places(F.concat(F.array(F.lit(-1)), unequal), 0, 1)
    ends = places(F.concat(unequal, F.array(F.size(flags))), 1, 0)
    zero = F.struct(
        F.size(flags).alias("first"), F.lit(0).alias("start"), F.lit(0).alias("length")
    )

    def step(s: Column, place: Column) -> Column:
        length = place["at"] - s["first"]
        longer = (place["end"] == 1) & (
            (length > s["length"]) | ((length == s["length"]) & (s["first"] < s["start"]))
        )
        return F.struct(
            F.when(place["end"] == 1, s["first"])
            .otherwise(F.least(s["first"], place["at"])).alias("first"),
            F.when(longer, s["first"]).otherwise(s["start"]).alias("start"),
            F.when(longer, length).otherwise(s["length"]).alias("length"),
        )

    return F.aggregate(F.array_sort(F.concat(starts, ends)), zero, step)


def _judged(hits: DataFrame, min_tokens: int, min_share: float) -> DataFrame:
    """Compare along the diagonal of each hit. hits: doc_id, base, piece, at, item_id, item_at,
    item. Only overlaps come back."""
    back = F.least("at", "item_at")
    width = back + F.least(F.size("piece") - F.col("at"), F.size("item") - F.col("item_at"))
    flags = F.zip_with(
        F.slice("piece", F.col("at") - back + 1, width),
        F.slice("item", F.col("item_at") - back + 1, width),
        lambda x, y: x == y,
    )
    found = (
        hits.select(
            "doc_id",
            "item_id",
            (F.col("base") + F.col("at") - back).alias("doc_from"),
            (F.col("item_at") - back).alias("item_from"),
            flags.alias("flags"),
            F.least(F.lit(min_tokens), F.size("item")).alias("least"),
        )
        .withColumn("run", _longest(F.col("flags"), min_share))
        .filter(F.col("run.length") >= F.col("least"))
    )
    low, high = F.col("run.start"), F.col("run.start") + F.col("run.length")
    equal = F.filter(
        F.transform("flags", lambda f, i: F.when(f & (i >= low) & (i < high), i)),
        lambda p: p.isNotNull(),
    )
    # without unequal pairs at the ends, but not below the least length
    last = F.coalesce(F.get("equal", F.size("equal") - 1), low) + 1
    start = F.least(F.coalesce(F.get("equal", F.lit(0)), low), F.greatest(low, last - F.col("least")))
    return (
        found.withColumn("equal", equal)
        .withColumn("start", start)
        .withColumn("end", F.greatest(last, F.col("start") + F.col("least")))
        .select(
            "doc_id",
            "item_id",
            (F.col("doc_from") + F.col("start")).alias("doc_start"),
            (F.col("doc_from") + F.col("end")).alias("doc_end"),
            (F.col("item_from") + F.col("start")).alias("item_start"),
            (F.col("end") - F.col("start")).alias("n_tokens"),
            F.size("equal").alias("n_equal"),
        )
    )


def overlaps(
    docs: DataFrame,
    items: DataFrame,
    masks: tuple[str, ...] = MASKS,
    min_tokens: int = MIN_TOKENS,
    min_share: float = MIN_SHARE,
    broadcast_seeds: int = BROADCAST_SEEDS,
) -> DataFrame:
    """Best overlap of each (doc_id, item_id) pair that has one.

    Columns: doc_id, item_id, doc_start, doc_end, item_start (token positions), n_tokens,
    n_equal, and n_overlaps (distinct overlaps of the pair).
    """
    wanted = items.filter("item_id is not null").select(
        "item_id", token_hashes(F.col("text")).alias("tokens")
    ).distinct()
    longest = wanted.agg(F.max(F.size("tokens"))).first()[0] or 0
    seeds = (
        _positions(wanted, ["item_id"], masks)
        .select("seed", "item_id", (F.col("base") + F.col("at")).alias("item_at"))
        .distinct()
    )
    tokens = docs.filter("doc_id is not null").select(
        F.col("doc_id"), token_hashes(F.col("text")).alias("tokens")
    )
    found = _positions(tokens, ["doc_id"], masks, max(REACH, longest))
    whole = wanted.withColumnRenamed("tokens", "item")
    if seeds.limit(broadcast_seeds + 1).count() <= broadcast_seeds:
        hits = found.join(F.broadcast(seeds), "seed").join(F.broadcast(whole), "item_id")
    else:
        places = (
            found.select("doc_id", (F.col("base") + F.col("at")).alias("at"), "seed")
            .join(seeds, "seed")
            .select("doc_id", "item_id", "at", "item_at")
            .distinct()
        )
        hits = (
            places.join(whole, "item_id")
            .join(tokens.withColumnRenamed("tokens", "piece"), "doc_id")
            .withColumn("base", F.lit(0))
        )
    # A hit whose mask also fits one token earlier belongs to a run that is judged there.
    earlier = F.lit(False)
    for mask in masks:
        fits = (F.col("at") > 0) & (F.col("item_at") > 0)
        for k, bit in enumerate(mask):
            if bit == "1":
                fits = fits & F.coalesce(
                    F.get("piece", F.col("at") + (k - 1))
                    == F.get("item", F.col("item_at") + (k - 1)),
                    F.lit(False),
                )
        earlier = earlier | fits
    judged = _judged(hits.filter(~earlier), min_tokens, min_share)
    best = F.max(
        F.struct(
            "n_equal",
            (-F.col("n_tokens")).alias("shorter"),
            (-F.col("doc_start")).alias("sooner"),
            "item_start",
            "doc_end",
        )
    )
    return (
        judged.groupBy("doc_id", "item_id")
        .agg(
            best.alias("best"),
            F.count_distinct(F.col("doc_start") - F.col("item_start")).alias("n_overlaps"),
        )
        .select(
            "doc_id",
            "item_id",
            (-F.col("best.sooner")).alias("doc_start"),
            F.col("best.doc_end").alias("doc_end"),
            F.col("best.item_start").alias("item_start"),
            (-F.col("best.shorter")).alias("n_tokens"),
            F.col("best.n_equal").alias("n_equal"),
            "n_overlaps",
        )
    )


def clean_documents(docs: DataFrame, items: DataFrame, **options: object) -> DataFrame:
    """Documents without an overlap. Their ids are written down first, so that their size is
    known and a small list need not make the texts move."""
    found = overlaps(docs, items, **options).select("doc_id").distinct()
    return docs.join(written(found, "contaminated"), "doc_id", "left_anti").select(docs.columns)
