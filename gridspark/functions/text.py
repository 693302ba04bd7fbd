"""Names, key=value text, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col


def strip_prefix(c: Column | str, prefix: str) -> Column:
    c = col(c)
    return F.when(c.startswith(prefix), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c)


def key_values(c: Column | str) -> Column:
    """Space-separated ``key=value`` pairs as a map; a repeated key keeps its last value."""
    keys = F.regexp_extract_all(col(c), F.lit(r"(?:^|\s)([^\s=]+)="), F.lit(1))
    values = F.regexp_extract_all(col(c), F.lit(r"(?:^|\s)[^\s=]+=(\S*)"), F.lit(1))
    once = F.array_distinct(keys)
    # Reversed, the first place of a key is its last one.
    back, back_values = F.reverse(keys), F.reverse(values)
    last = F.transform(once, lambda k: F.element_at(back_values, F.array_position(back, k).cast("int")))
    return F.when(F.size(once) == F.size(keys), F.map_from_arrays(keys, values)).otherwise(F.map_from_arrays(once, last))


def safe_name(c: Column | str, empty: str = "output") -> Column:
    """Anything but letters, digits, minus and underscore becomes an underscore."""
    clean = F.regexp_replace(col(c), "[^A-Za-z0-9_-]", "_")
    return F.when(clean == "", F.lit(empty)).otherwise(clean)


def confined(c: Column | str) -> Column:
    """True for a relative name that cannot leave its folder: no slash, no leading dot, not empty."""
    c = col(c)
    return (F.length(c) > 0) & ~c.contains("/") & ~c.startswith(".")


def element_checksum(line: Column | str) -> Column:
    """Sum of the digits of the first 68 characters, a minus counting one, modulo ten."""
    head = F.regexp_replace(F.translate(F.substring(col(line), 1, 68), "-", "1"), "[^0-9]", "0")
    total = F.aggregate(F.split(head, ""), F.lit(0), lambda s, c: s + F.coalesce(c.try_cast("int"), F.lit(0)))
    return F.pmod(total, F.lit(10))


def element_line_ok(line: Column | str) -> Column:
    line = col(line)
    return F.coalesce((F.length(line) == 69) & (F.substring(line, 69, 1) == element_checksum(line).cast("string")),
                      F.lit(False))


def fnv1a32(c: Column | str) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as BIGINT."""
    pairs = F.regexp_extract_all(F.hex(F.encode(col(c).cast("string"), "utf-8")), F.lit(".."), F.lit(0))

    def fold(h, pair):
        byte = F.conv(pair, 16, 10).cast("bigint")
        return (h.bitwiseXOR(byte) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))

    return F.aggregate(pairs, F.lit(2166136261).cast("bigint"), fold)
