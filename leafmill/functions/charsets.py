"""Double-byte charsets as table look-ups in built-in expressions.

Spark decodes a handful of charsets. Of the others the common ones on pages of East Asia
have one or two bytes a character. A body is cut into runs by a pattern, which finds broken pairs
as well: ASCII stays as it is, every other byte or pair becomes a placeholder character of its
value, and one translation of the text puts the characters in their place. So the work goes by
runs, not by bytes. The tables are built from Python's codecs; the plan holds one per charset.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import let

# --- fixed values: codec, lead bytes, trail bytes ---------------------------------------------
DOUBLE_BYTE = {
    "shift_jis": ("cp932", r"[\x81-\x9F\xE0-\xFC]", r"[\x40-\x7E\x80-\xFC]"),
    "gbk": ("gbk", r"[\x81-\xFE]", r"[\x40-\x7E\x80-\xFE]"),
    "big5": ("cp950", r"[\x81-\xFE]", r"[\x40-\x7E\xA1-\xFE]"),
    "euc-kr": ("cp949", r"[\x81-\xFE]", r"[\x41-\x5A\x61-\x7A\x81-\xFE]"),
}
# Names under which pages declare them, without signs.
DOUBLE_BYTE_NAMES = {
    "shift_jis": ("shiftjis", "sjis", "xsjis", "mskanji", "cp932", "windows31j", "ms932"),
    "gbk": ("gbk", "gb2312", "cp936", "ms936", "chinese", "euccn", "xgbk"),
    "big5": ("big5", "big5tw", "cp950", "cnbig5", "xxbig5"),
    "euc-kr": ("euckr", "ksc5601", "ksc56011987", "cp949", "uhc", "korean", "windows949"),
}
# Placeholders are this plus the value of a byte from 0x80 or of a pair. No charset here has characters there.
_PLACE = 0x10000
# Stands for no character; private-use ones are not decoded.
_NONE = "\ue000"
# ------------------------------------------------------------------------------


@functools.cache
def _table(charset: str) -> tuple[str, str]:
    """Placeholders of every byte from 0x80 and of every pair, and the characters in their place."""
    codec, lead, trail = DOUBLE_BYTE[charset]

    def char(raw: bytes) -> str:
        try:
            text = raw.decode(codec)
        except UnicodeDecodeError:
            return _NONE
        # a pair that reads as two single characters is none, private-use characters stand for nothing
        return text if len(text) == 1 and not 0xE000 <= ord(text) <= 0xF8FF else _NONE

    pairs = [bytes([a, b]) for a in range(0x80, 256) for b in range(256)]
    units = [bytes([b]) for b in range(0x80, 256)]
    units += [p for p in pairs if re.fullmatch(lead + trail, p.decode("latin-1"))]
    return "".join(chr(_PLACE + int.from_bytes(u)) for u in units), "".join(char(u) for u in units)


def _placed(run: Column, unit: str, zeros: str) -> Column:
    """Placeholders of the bytes or pairs of ``run``, as UTF-32 of 8 hex digits each."""
    digits = F.regexp_replace(F.hex(F.encode(run, "ISO-8859-1")), unit, f"{_PLACE >> 16:04X}{zeros}$0")
    return F.decode(F.unhex(digits), "UTF-32")


def decode_double_byte(body: Column, charset: str) -> Column:
    """Text of ``body``; null if a byte or pair stands for no character of the charset."""
    _, lead, trail = DOUBLE_BYTE[charset]
    pair = lead + trail
    runs = F.regexp_extract_all(
        F.decode(body, "ISO-8859-1"),
        F.lit(rf"[\x00-\x7F]++|(?:{pair})++|(?:(?!{pair})[\x80-\xFF])++"),
        F.lit(0),
    )
    placed = F.transform(
        runs,
        lambda r: F.when(r < "\x80", r)
        .when(r.rlike(rf"\A{pair}"), _placed(r, ".{4}", ""))
        .otherwise(_placed(r, ".{2}", "00")),
    )
    text = F.translate(F.array_join(placed, ""), *_table(charset))
    return let(text, lambda t: F.when(~F.contains(t, F.lit(_NONE)), t))
