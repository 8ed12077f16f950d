"""Machine ids in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: how operators write a machine id ("MCH-010", "mch 010", "MCH010",
# "mch 1000"): three digits or, in larger fleets, more.
MACHINE_ID_PATTERN = r"\bMCH[-\s]?(\d{3,})\b"


def machine_id_in(text: Column) -> Column:
    """First machine id mentioned in the text as ``MCH-nnn``, else null."""
    digits = F.regexp_extract(F.upper(text), MACHINE_ID_PATTERN, 1)
    return F.when(digits != "", F.concat(F.lit("MCH-"), digits))
