"""Words of a text by its UTF-8 bytes: one table lower-cases and blanks, bytes.split does the rest."""
from pyspark.sql import Column
from pyspark.sql import functions as F


def _table() -> bytes:
    """ASCII letters in lower case, digits and all bytes beyond ASCII as they are, others blank."""
    return bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in bytes(range(256)).lower())


TABLE = _table()


def words(data: bytes | None) -> list:
    """Maximal runs without ASCII separators, A-Z lower-cased; a null text has none."""
    return data.translate(TABLE).split() if data else []


def utf8(column: str) -> Column:
    """A text column as its bytes, so that a worker need not decode it."""
    return F.col(f"`{column}`").cast("string").cast("binary")
