"""Statement text and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TO_END = -1
UTF16 = "UTF-16LE"


def utf16_length(text: Column) -> Column:
    """Length of a text in bytes of UTF-16."""
    return F.octet_length(F.encode(text, UTF16))


def utf16_slice(text: Column, start: Column, end: Column) -> Column:
    """Statement between two byte offsets (UTF-16, end inclusive, -1 = up to the end).

    Offsets count code units, so characters outside the basic plane take two;
    ``substring`` on the text itself would count them once.
    """
    raw = F.encode(text, UTF16)
    last = F.when(end == TO_END, F.octet_length(raw)).otherwise(end)
    units = (last - start).cast("long")
    length = F.call_function("div", units, F.lit(2)) + F.lit(1)
    first = F.call_function("div", start, F.lit(2)) * 2 + 1
    return F.decode(_whole(F.substring(raw, first.cast("int"), (length * 2).cast("int"))), UTF16)


def _whole(raw: Column) -> Column:
    """Replace half a character at either edge of a UTF-16 slice by U+FFFD.

    An offset may fall between the two units of one character, and ``decode``
    rejects a lone unit.
    """
    def unit(lead: str) -> Column:
        return F.unhex(F.lit(lead))

    size = F.octet_length(raw)
    lone = unit("FDFF")
    tail_cut = F.substring(raw, size, 1).between(unit("D8"), unit("DB"))
    raw = F.when(tail_cut, F.concat(F.substring(raw, F.lit(1), size - 2), lone)).otherwise(raw)
    head_cut = F.substring(raw, 2, 1).between(unit("DC"), unit("DF"))
    return F.when(head_cut, F.concat(lone, F.substring(raw, F.lit(3), size))).otherwise(raw)


def fingerprint(*hashes: Column) -> Column:
    """Binary hashes joined end to end; NULL if any part is NULL."""
    return F.concat(*hashes)
