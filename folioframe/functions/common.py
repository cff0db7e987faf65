"""Shared column helpers: Unicode-aware whitespace handling and let-bindings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as the corpus rules understand it (Unicode spaces plus the FS..US separators).
# The \x{..} escapes are read alike by Java regex and RE2.
_WS_CHARS = (
    r"\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WS = rf"[\t-\r{_WS_CHARS}]"            # any whitespace
HS = rf"[\t\x0b-\r{_WS_CHARS}]"        # whitespace inside a line (no \n)
NWS = rf"[^\t-\r{_WS_CHARS}]"          # anything else

# trailing whitespace; the look-behind lets a match begin only where a run begins, so that long inner
# runs stay linear, and comes second, so that other characters fail at once
TAIL = rf"{WS}(?<!{WS}{{2}}){WS}*+\z"


# the same symbols, one by one
WS_SYMBOLS = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def strip(c) -> Column:
    """Trim Unicode whitespace at both ends; only the ends are looked at, where a pattern would read the whole text."""
    return F.btrim(col(c), F.lit(WS_SYMBOLS))


def lstrip(c) -> Column:
    return F.regexp_replace(col(c), rf"\A{WS}+", "")


def rstrip(c) -> Column:
    return F.regexp_replace(col(c), TAIL, "")


def squash(c) -> Column:
    """Whitespace runs to one space, trimmed."""
    return F.trim(F.regexp_replace(col(c), rf"{WS}+", " "))


# letters whose full upper case is several symbols, and the one that upper-cases each of them alone; others of the kind have none and stay
_WIDE_UPPER = {"ß": "ẞ", "ᾳ": "ᾼ", "ῃ": "ῌ", "ῳ": "ῼ", **{chr(first + i): chr(first + i + 8) for first in (0x1F80, 0x1F90, 0x1FA0) for i in range(8)}}


def casefold(c) -> Column:
    """Lower case with the sharp s written out; a letter's form does not depend on the letters beside it."""
    plain = F.translate(F.replace(col(c), F.lit("ß"), F.lit("ss")), "Σİ", "σi")
    return F.lower(plain)


def upper_by_symbol(c) -> Column:
    """Upper case, symbol by symbol, so that the length stays."""
    one = lambda x: F.when(F.length(F.upper(x)) == 1, F.upper(x)).otherwise(F.translate(x, "".join(_WIDE_UPPER), "".join(_WIDE_UPPER.values())))
    return F.array_join(F.transform(chars(c), one), "")


def chars(c) -> Column:
    """Array of code points."""
    return F.regexp_extract_all(col(c), F.lit(r"(?s)(.)"), 1)


def left(c, n) -> Column:
    """First ``n`` code points."""
    return F.substring(col(c), 1, n) if isinstance(n, int) else F.substring(col(c), F.lit(1), n)


def right(c, n: int) -> Column:
    """Last ``n`` code points (the whole text when shorter)."""
    c = col(c)
    return F.substring(c, F.greatest(F.length(c) - F.lit(n) + 1, F.lit(1)), F.lit(n))


def blank_to_null(c) -> Column:
    return F.nullif(strip(c), F.lit(""))
