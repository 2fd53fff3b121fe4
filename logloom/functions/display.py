"""Display lines and badges."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S
from .base import col, left, lookup, pad


def level_badge(level) -> Column:
    return lookup(col(level), S.LEVEL_BADGES, S.DEFAULT_BADGE)


def _truthy_number(c) -> Column:
    return F.when(col(c) != 0, col(c).cast("string")).otherwise("")


def table_columns(widths: dict[str, int] | None = None) -> list[Column]:
    """The seven columns of the log table, whole; ``widths`` clips some to so
    many characters, but never a pid."""
    def shown(name, value):
        width = (widths or {}).get(name)
        return (value if width is None else left(value, width)).alias(name)

    return [
        level_badge(F.coalesce(F.col("level"), F.lit("INFO"))).alias("badge"),
        *[shown(c, F.coalesce(F.col(c), F.lit(""))) for c in ("timestamp", "os_source", "source")],
        shown("level", F.coalesce(F.nullif(F.col("level"), F.lit("")), F.lit("INFO"))),
        _truthy_number("pid").alias("pid"),
        shown("message", F.coalesce(F.col("message"), F.lit(""))),
    ]


def record_line(indent: str = "  ", count="count", with_os_source: bool = True,
                with_count: bool = True, message_chars: int | None = None,
                time_chars: int | None = None) -> Column:
    """``xN [time] [level] [os_source] source: message`` of one record, whole
    unless numbers of characters are given."""
    n = col(count) if with_count else F.lit(1)
    prefix = F.when(n > 1, F.concat(F.lit("x"), pad(n.cast("string"), 4))).otherwise("     ")
    parts = [F.lit(indent)]
    if with_count:
        parts += [prefix, F.lit(" ")]
    parts += [F.lit("["), left("timestamp", time_chars), F.lit("] ["),
              F.coalesce(F.col("level"), F.lit("")), F.lit("] ")]
    if with_os_source:
        parts += [F.lit("["), F.coalesce(F.col("os_source"), F.lit("")), F.lit("] ")]
    parts += [F.coalesce(F.col("source"), F.lit("")), F.lit(": "), left("message", message_chars)]
    return F.concat(*parts)


def alert_line(message_chars: int | None = None) -> Column:
    """``[level] source | message``, whole unless a number of characters is given."""
    return F.concat(F.lit("["), F.coalesce(F.col("level"), F.lit("")), F.lit("] "),
                    F.coalesce(F.col("source"), F.lit("")), F.lit(" | "), left("message", message_chars))


def pattern_line(wide_label: bool) -> Column:
    """Headline of a pattern; the table form pads the label to 40."""
    kind = F.concat(F.lit("  ["), pad(F.upper("type"), 16), F.lit("] "))
    conf = F.format_string("%.2f", F.col("confidence"))
    n = F.col("count").cast("string")
    if wide_label:
        return F.concat(kind, pad("label", 40), F.lit(" count="), n, F.lit(" conf="), conf)
    return F.concat(kind, F.col("label"), F.lit(" (count="), n, F.lit(", conf="), conf, F.lit(")"))
