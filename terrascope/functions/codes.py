"""Short codes as numbers that keep their order.

Spark aggregates numbers in place in a hash table, but sorts its input to take the maximum of a string. Commune
codes are at most five characters, so their maximum can be taken as a number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CODE_LENGTH = 7
_PAD = "\u0000"


def code_number(c: Column) -> Column:
    """Bytes of a code of up to seven bytes as one number. A longer text is no commune code: NULL, as where a code is
    looked up among the communes and not found."""
    number = F.conv(F.hex(F.rpad(c, CODE_LENGTH, _PAD)), 16, 10).cast("bigint")
    return F.when(F.octet_length(c) <= CODE_LENGTH, number)


def code_text(n: Column) -> Column:
    """The code behind a number."""
    return F.rtrim(F.decode(F.unhex(F.conv(n.cast("string"), 10, 16)), "UTF-8"), F.lit(_PAD))
