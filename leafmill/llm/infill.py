"""Fill-in-the-middle transformation with SWAR words.

A text is cut into units: a run of A-Z and a-z, or any other single code point. Two cuts fall
between units; what lies before, between and behind them is prefix, middle and suffix. The
forms are ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix, middle) and ``plain``, each part
behind its sentinel.

No unit is ever listed. The UTF-8 bytes of many rows are viewed as 64-bit words; a few additions
and shifts mark, in all eight bytes of a word at once, the bytes that end a unit: neither a
letter before a letter nor a byte before a continuation byte. ``bitwise_count`` gives the marks
per word and a running sum the marks before each word. The byte at which the k-th unit of
a row ends is found by binary search for its word, then inside the word: multiplying the marks
by 0x0101... sums them up byte by byte, and the bytes whose sum is below k are counted.

All decisions come from the first four 8-digit groups h1 to h4 of the hex sha256 of
``1:<doc_id>``: cuts after h1 and h2 modulo (n + 1) units, plain if h3 % 100 is not below
``percent``, spm if h4 % 100 is below ``spm_percent``.

A null text counts as empty. Empty texts and those that contain a sentinel stay plain, so every
output can be taken apart again (``restored``). A null id counts as an empty one. Repeated rows
give equal rows. An empty table gives an empty table. Further columns are ignored. A row longer
than PIECE is worked on alone; other rows share a piece, which changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import slices, text_buffer

PERCENT, SPM_PERCENT = 90, 20
PIECE = 4 << 20
_WORDS = 1 << 16  # words marked at a time

# The sentinels.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SENTINEL = "<[PSM]>"

_HIGH = np.uint64(0x8080808080808080)
_ONES = np.uint64(0x0101010101010101)
_SEVEN = np.uint64(0x7F7F7F7F7F7F7F7F)
_CASE = np.uint64(0x2020202020202020)
_FROM_A = np.uint64((0x80 - ord("a")) * 0x0101010101010101)
_AFTER_Z = np.uint64((0x80 - ord("z") - 1) * 0x0101010101010101)


def _letters(x: np.ndarray) -> np.ndarray:
    """High bit of every byte that is an ASCII letter."""
    low = (x | _CASE) & _SEVEN
    return (low + _FROM_A) & ~(low + _AFTER_Z) & ~x & _HIGH


def _continued(x: np.ndarray) -> np.ndarray:
    """High bit of every byte that goes on with a character."""
    return x & ~(x << np.uint64(1)) & _HIGH


def _next_byte(flags: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The flag of the byte behind each byte; ``after`` are the flags of the following words."""
    return (flags >> np.uint64(8)) | (after << np.uint64(56))


class Units:
    """Unit ends and character starts of the rows in one UTF-8 buffer."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        n = len(data)
        padded = np.zeros((n // 8 + 2) * 8, np.uint8)
        padded[:n] = data
        words = padded.view("<u8")
        self.ends = np.empty(len(words) - 1, np.uint64)
        self.starts = np.empty(len(words) - 1, np.uint64)
        for a in range(0, len(self.ends), _WORDS):
            x = words[a : min(a + _WORDS, len(self.ends)) + 1]
            letter, more = _letters(x), _continued(x)
            inside = letter[:-1] & _next_byte(letter[:-1], letter[1:])
            inside |= _next_byte(more[:-1], more[1:])
            self.ends[a : a + len(x) - 1] = ~inside & _HIGH
            self.starts[a : a + len(x) - 1] = ~more[:-1] & _HIGH
        # a row's last byte ends a unit, whatever the next row begins with
        last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        np.bitwise_or.at(self.ends, last >> 3, np.uint64(0x80) << ((last & 7) * 8).astype(np.uint64))
        self.before_ends = self._running(self.ends)
        self.before_starts = self._running(self.starts)

    @staticmethod
    def _running(marks: np.ndarray) -> np.ndarray:
        out = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(np.bitwise_count(marks), out=out[1:], dtype=np.int64)
        return out

    @staticmethod
    def _rank(marks: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Marks on the bytes before ``at``."""
        below = (np.uint64(1) << ((at & 7) * 8).astype(np.uint64)) - np.uint64(1)
        return before[at >> 3] + np.bitwise_count(marks[at >> 3] & below)

    def units_before(self, at: np.ndarray) -> np.ndarray:
        return self._rank(self.ends, self.before_ends, at)

    def chars_before(self, at: np.ndarray) -> np.ndarray:
        return self._rank(self.starts, self.before_starts, at)

    def end_of(self, nth: np.ndarray) -> np.ndarray:
        """Offset behind the ``nth`` unit of the buffer, counted from 1."""
        word = np.searchsorted(self.before_ends, nth, side="left") - 1
        wanted = (nth - self.before_ends[word]).astype(np.uint64)
        sums = (self.ends[word] >> np.uint64(7)) * _ONES
        reached = ((sums | _HIGH) - wanted * _ONES) & _HIGH
        return word * 8 + np.bitwise_count(~reached & _HIGH) + 1


def cuts(
    data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units of each row, the two cuts as offsets, and the characters of prefix and middle."""
    marks = Units(data, offsets)
    start, stop = offsets[:-1], offsets[1:]
    first = marks.units_before(start)
    n = marks.units_before(stop) - first
    a, b = h1 % (n + 1), h2 % (n + 1)
    ends = []
    for k in (np.minimum(a, b), np.maximum(a, b)):
        # nothing is looked up for a cut in front of the first unit
        end = marks.end_of(np.maximum(first + k, 1)) if len(data) else start
        ends.append(np.where(k > 0, end, start))
    one, two = ends
    chars = [marks.chars_before(x) for x in (start, one, two)]
    return n, one, two, chars[1] - chars[0], chars[2] - chars[1]


_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()),
        ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string()),
    ]
)


def _transformed(percent: int, spm_percent: int):
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                data, offsets = text_buffer(part.column("text"))
                h1, h2, h3, h4 = (part.column(f"h{i}").to_numpy() for i in range(1, 5))
                n, one, two, prefix_chars, middle_chars = cuts(data, offsets, h1, h2)
                held = pc.match_substring_regex(pc.fill_null(part.column("text"), ""), _SENTINEL)
                plain = (n == 0) | held.to_numpy(zero_copy_only=False) | (h3 % 100 >= percent)
                suffix_first = h4 % 100 < spm_percent
                raw = data.tobytes()
                out, forms = [], []
                for i in range(part.num_rows):
                    a, b, c, d = offsets[i], one[i], two[i], offsets[i + 1]
                    if plain[i]:
                        forms.append("plain")
                        out.append(raw[a:d])
                    elif suffix_first[i]:
                        forms.append("spm")
                        out.append(b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c])))
                    else:
                        forms.append("psm")
                        out.append(b"".join((p, raw[a:b], s, raw[c:d], m, raw[b:c])))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(n, pa.int64()),
                        pa.array(forms),
                        pa.array(prefix_chars, pa.int64(), mask=plain),
                        pa.array(middle_chars, pa.int64(), mask=plain),
                        pa.array(out, pa.binary()).cast(pa.string()),
                    ],
                    schema=_SCHEMA,
                )

    return run


def hash_groups(doc_id: Column) -> list[Column]:
    """h1 to h4 as long columns."""
    name = F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    digest = F.sha2(name, 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, percent: int = PERCENT, spm_percent: int = SPM_PERCENT
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), a row per row of ``docs``."""
    groups = [h.alias(f"h{i}") for i, h in enumerate(hash_groups(F.col("doc_id")), 1)]
    return docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), *groups
    ).mapInArrow(
        _transformed(percent, spm_percent),
        "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string",
    )


def restored(form: Column, output: Column) -> Column:
    """The text that ``output`` was made of."""
    parts = F.split(output, _SENTINEL, -1)
    return F.when(form == "plain", output).when(
        form == "psm", F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    ).otherwise(F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1))))
