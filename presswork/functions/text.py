"""Text helpers as Columns: white space, lines, normal forms, size estimates.

White space is the 29 code points that Python's ``str.split`` knows, written out, since no two regex
engines agree on ``\\s``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inside a character class; the same spelling serves Java and RE2.
SPACES = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"[\p{L}\p{N}_]"
#: The same code points for Java's engine alone, which asks a property and a table and not one range after another (in either case, where letters match so).
JAVA_SPACES = r"\p{IsWhite_Space}\x1c\x1d\x1e\x1f"
_EACH = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def named(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of the value, which is made once however often ``f`` says it, in a lambda or out of it. A column's expression is not safe from that: Spark
    puts it in the place of its name where it is said once, though that be in a lambda that runs for every line."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(_EACH))


def squash(c: Column | str) -> Column:
    """White space runs to one blank, none at the ends; case stays."""
    # a blank alone, as most are, stays as it is
    return F.trim(F.regexp_replace(col(c), f"[{JAVA_SPACES}&&[^ ]][{JAVA_SPACES}]*| [{JAVA_SPACES}]+", " "))


def squash_lower(c: Column | str) -> Column:
    return F.lower(squash(c))


def filled(c: Column | str) -> Column:
    """Whether there is anything but white space."""
    return col(c).rlike(f"[^{JAVA_SPACES}]")


def lines(c: Column | str) -> Column:
    """Stripped lines that aren't blank, cut at line feeds."""
    return F.filter(F.transform(F.split(col(c), "\n"), strip), lambda x: x != "")


def all_lines(c: Column | str) -> Column:
    """Lines at any line end, none for what follows the last one."""
    parts = F.split(col(c), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    return named(parts, lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))


def tokens(c: Column | str) -> Column:
    """Estimated tokens of a message: a quarter of its characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(col(c)) / 4)).cast("long")


def json_chars(c: Column | str) -> Column:
    """Length of the text as an ASCII JSON string, without its quotes: marks and the usual control characters take two characters,
    other characters that aren't printable ASCII six, or twelve where they are two UTF-16 units."""
    count = lambda form: F.length(F.regexp_replace(col(c), form, ""))
    return (F.length(col(c)) + count(r'[^"\\\n\r\t\x08\x0c]') + 5 * count(r"[\x20-\x7e\n\r\t\x08\x0c\x{10000}-\x{10ffff}]") + 11 * count(r"[\x00-\x{ffff}]")).cast("long")


def head_hash(c: Column | str, digits: int) -> Column:
    return F.substring(F.sha1(col(c)), 1, digits)


# The same in DuckDB's SQL, for the oracles.
def q_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACES}]+|[{SPACES}]+$', '', 'g')"


def q_squash(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{SPACES}]+', ' ', 'g'))"


def q_filled(x: str) -> str:
    return f"regexp_matches({x}, '[^{SPACES}]')"


def q_lines(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {q_strip('l')}), lambda l: l <> '')"


def q_tokens(x: str) -> str:
    return f"greatest(1, length({x}) // 4)"


def q_json_chars(x: str) -> str:
    count = lambda form: f"length(regexp_replace({x}, '{form}', '', 'g'))"
    return "(length({}) + {} + 5 * {} + 11 * {})".format(
        x, count(r'[^"\\\n\r\t\x08\x0c]'), count(r"[\x20-\x7e\n\r\t\x08\x0c\x{10000}-\x{10ffff}]"), count(r"[\x00-\x{ffff}]")
    )
