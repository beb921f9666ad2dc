"""What the pipeline needs besides the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One character in UTF-8, seen as Latin-1.
CHARACTER = "[\\x00-\\x7f]|[\\xc2-\\xdf][\\x80-\\xbf]|\\xe0[\\xa0-\\xbf][\\x80-\\xbf]|[\\xe1-\\xec\\xee\\xef][\\x80-\\xbf]{2}|\\xed[\\x80-\\x9f][\\x80-\\xbf]|\\xf0[\\x90-\\xbf][\\x80-\\xbf]{2}|[\\xf1-\\xf3][\\x80-\\xbf]{3}|\\xf4[\\x80-\\x8f][\\x80-\\xbf]{2}"


def readable(column: str) -> Column:
    """Text of UTF-8 bytes from which pieces were cut: bytes that are no whole character go."""
    latin = F.decode(F.col(column), "ISO-8859-1")
    whole = F.concat_ws("", F.regexp_extract_all(latin, F.lit(f"({CHARACTER})"), F.lit(0)))
    plain = F.col(column).cast("string")
    return F.when(plain.isNull() | F.is_valid_utf8(plain), plain).otherwise(F.decode(F.encode(whole, "ISO-8859-1"), "UTF-8"))
