"""Names that are compared without regard to case and surrounding white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is trimmed: ASCII controls, no-break and wide spaces (fixed values).
WHITE = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def same_name(name: Column | str) -> Column:
    """The form in which equal names are equal; null stays null."""
    return F.lower(F.trim(F.col(name) if isinstance(name, str) else name, F.lit(WHITE)))


def sql_name(name: str) -> str:
    """The same in DuckDB SQL."""
    return f"lower(trim({name}, {' || '.join(f'chr({ord(c)})' for c in WHITE)}))"
