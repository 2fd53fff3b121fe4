"""Small building blocks shared by the column functions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the characters that count as white space in a Unicode string.
WHITESPACE = "".join(map(chr, [
    *range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203),
    8232, 8233, 8239, 8287, 12288]))
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(key: Column, mapping: dict, default=None) -> Column:
    """Value of a key in a constant map; the key is computed once."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    found = F.try_element_at(table, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def strip(c) -> Column:
    return F.btrim(col(c), F.lit(WHITESPACE))


def squeeze(c) -> Column:
    return F.trim(F.regexp_replace(col(c), WHITESPACE_RUN, " "))


def filled(c) -> Column:
    """Null when empty, so that coalesce skips it."""
    return F.nullif(col(c), F.lit(""))


def left(c, n: int | None) -> Column:
    """The first ``n`` characters, or all; empty for null."""
    whole = F.coalesce(col(c), F.lit(""))
    return whole if n is None else F.substring(whole, 1, n)


def pad(c, n: int) -> Column:
    """Pad on the right to at least ``n`` characters; longer text stays whole."""
    c = col(c)
    return F.when(F.length(c) < n, F.rpad(c, n, " ")).otherwise(c)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it inside a lambda body."""
    return F.transform(F.array(value), body)[0]


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters may use.

    A filter on an ordinary column moves below it and computes it again; it
    does not move below a generator, here of exactly one row per row.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))
