"""Text in the old one-byte encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _windows_bytes() -> tuple[str, str, str]:
    """Code points 80-9F that Windows Latin defines, what they mean there, and a class of those it does not define."""
    defined, meant, undefined = "", "", ""
    for byte in range(0x80, 0xA0):
        try:
            meant += bytes([byte]).decode("cp1252")
            defined += chr(byte)
        except UnicodeDecodeError:
            undefined += f"\\x{byte:02x}"
    return defined, meant, f"[{undefined}]"


def windows_undefined(latin: Column) -> Column:
    """Whether Latin-1 text holds a byte that Windows Latin does not define."""
    return latin.rlike(_windows_bytes()[2])


def windows_latin(latin: Column) -> Column:
    """Latin-1 text with the bytes 80-9F read as Windows Latin."""
    defined, meant, _ = _windows_bytes()
    return F.translate(latin, defined, meant)
