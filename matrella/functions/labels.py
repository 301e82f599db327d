"""Normal forms of dirty identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: a plain number: digits, a sign allowed, a fraction of zeros only ("03", "3.0", "3.")
PLAIN = r"^[+-]?[0-9]{1,18}(\.0*)?$"


def plain_integer(col: Column) -> Column:
    """The integer value of a trimmed label that is a plain number, else null.

    "03", " 3" and "3.0" are all 3; words, empty strings, fractions other than zero and null give null.
    """
    trimmed = F.regexp_replace(col, r"^\s+|\s+$", "")
    whole = F.regexp_replace(trimmed, r"\..*$", "")
    return F.when(trimmed.rlike(PLAIN), whole.try_cast("bigint"))
