"""Column functions that bring dirty fields into the one form they are compared in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t"


def cleaned_hash(c: Column | str) -> Column:
    """Without surrounding blanks and tabs, in lower case, without a leading ``sha256:``; empty is null."""
    c = F.col(c) if isinstance(c, str) else c
    h = F.regexp_replace(F.lower(F.btrim(c, F.lit(BLANKS))), "^sha256:", "")
    return F.nullif(h, F.lit(""))


def cleaned(c: Column | str) -> Column:
    """Trimmed, in lower case."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.btrim(c, F.lit(" \t\r\n")))


def packed_key(c: Column) -> Column:
    """A text key as bytes: a tag, and 32 bytes of a 64-digit hex digest or the text of anything else, so that two
    different keys never meet."""
    return F.when(c.rlike("^[0-9a-f]{64}$"), F.unhex(F.concat(F.lit("01"), c))).otherwise(F.encode(F.concat(F.lit("\x02"), c), "utf-8"))


OFFSET_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$"


def instant(c: Column) -> Column:
    """ISO text to a timestamp; null unless it is date, ``T`` or blank, time and an offset."""
    return F.when(c.rlike(OFFSET_TIME), c.try_cast("timestamp"))
