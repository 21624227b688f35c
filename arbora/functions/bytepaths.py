"""File names are bytes; columns are text. One text for each name, and back.

Bytes that are no UTF-8 become characters U+EF80 .. U+EFFF, one each, as does every byte of such a character that really
occurs in a name. So different names never meet in one text, `/` and all of ASCII stay what they are, and the bytes can be had
again wherever a file is touched. Text of names that are UTF-8 is the name itself.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT, FIRST, LAST = 0xEF00, 0xEF80, 0xEFFF
_TO_TEXT = {0xDC00 + b: SHIFT + b for b in range(0x80, 0x100)} | {c: "".join(chr(SHIFT + b) for b in chr(c).encode()) for c in range(FIRST, LAST + 1)}
_TO_BYTES = {SHIFT + b: 0xDC00 + b for b in range(0x80, 0x100)}


def escape(name: bytes) -> str:
    """The text of a name or path."""
    return name.decode() if name.isascii() else name.decode("utf-8", "surrogateescape").translate(_TO_TEXT)


def unescape(text: str) -> bytes:
    """The bytes of a text that escape has made."""
    return text.encode() if text.isascii() else text.translate(_TO_BYTES).encode("utf-8", "surrogateescape")


def byte_order(path: Column) -> Column:
    """The path's bytes: sorts as the names themselves do, which their texts need not once bytes are escaped."""
    def byte(c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code.between(FIRST, LAST), F.unhex(F.hex(code - SHIFT))).otherwise(c.cast("binary"))

    chars = F.regexp_extract_all(path, F.lit("(?s)."), F.lit(0))
    escaped = F.aggregate(chars, F.lit(b""), lambda a, c: F.concat(a, byte(c)))
    return F.when(F.rlike(path, F.lit(f"[{chr(FIRST)}-{chr(LAST)}]")), escaped).otherwise(path.cast("binary"))
