"""Data sizes and counts as texts."""

from __future__ import annotations

import re

_UNITS = "KMG"


def parse_size(text: str) -> int:
    """Bytes of a size like 4000, 64K, 8MB or 1,024g: units are powers of 1,024, B may follow one."""
    m = re.fullmatch(r"\+?([0-9][0-9,]*)(?:([KMG])B?)?", text.strip(), re.I)
    if not m:
        raise ValueError(f"{text}: not a data size")
    value = int(m[1].replace(",", "")) * 1024 ** (_UNITS.index(m[2].upper()) + 1 if m[2] else 0)
    if value >= 1 << 64:
        raise ValueError(f"{text}: too large")
    return value


def size_text(value: int, digits: int = 3) -> str:
    """A size with its first digits, rounded, and a decimal unit: 999, 1.23MB."""
    if value < 1000:
        return str(value)
    power = (len(str(value)) - 1) // 3
    shown = round(value / 1000**power, max(0, digits - len(str(value // 1000**power))))
    if shown >= 1000 and power < 6:
        power, shown = power + 1, round(shown / 1000, digits - 1)
    text = f"{shown:.{max(0, digits - len(str(int(shown))))}f}"
    return f"{text}{'KMGTPE'[power - 1]}B"


def with_separators(value: int) -> str:
    return f"{value:,}"
