"""Normalisation of log records: text, levels, facilities, times."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S
from .base import col, filled, lookup, strip


def build_text(timestamp="timestamp", level="level", os_type="os_type",
               os_source="os_source", hostname="hostname", source="source", pid="pid",
               event_id="event_id", facility="facility", message="message") -> Column:
    """Embedding-ready summary; absent or falsy parts are left out."""
    def part(label, c):
        return F.when(col(c) != "", F.concat(F.lit(label), col(c)))

    def number(label, c):
        return F.when(col(c) != 0, F.concat(F.lit(label), col(c).cast("string")))

    def text(c, default=""):
        return F.coalesce(col(c), F.lit(default))

    return F.concat_ws(
        " ",
        F.concat(F.lit("["), text(timestamp), F.lit("]")),
        F.concat(F.lit("["), text(level, "INFO"), F.lit("]")),
        F.concat(F.lit("["), text(os_type), F.lit(":"), text(os_source), F.lit("]")),
        part("host=", hostname), part("source=", source),
        number("pid=", pid), number("event_id=", event_id),
        part("facility=", facility), text(message))


def fill_text(text="text", **columns) -> Column:
    """Keep a text that is there, build it otherwise."""
    return F.coalesce(filled(text), build_text(**columns))


def embedding_input_text(text="text", message="message") -> Column:
    return F.coalesce(filled(text), col(message), F.lit(""))


def infer_level(source, message) -> Column:
    said = F.lower(F.concat_ws(" ", F.coalesce(col(source), F.lit("")),
                               F.coalesce(col(message), F.lit(""))))

    def has(*words):
        out = said.contains(words[0])
        for w in words[1:]:
            out = out | said.contains(w)
        return out

    out = F.lit(S.LEVEL_WITHOUT_WORD)
    for level, words in reversed(S.LEVEL_WORDS.items()):
        out = F.when(has(*words), level).otherwise(out)
    return out


def infer_facility(source) -> Column:
    name = F.lower(col(source))
    return (F.when(name.isin("kernel", "kern"), "kern")
             .when(name.contains("ssh"), "auth")
             .when(name.isin("sudo", "su", "pam"), "auth")
             .when(name.contains("cron"), "cron")
             .when(name.contains("mail"), "mail")
             .when(name.isin("systemd", "init"), "daemon")
             .otherwise("user"))


def facility_name(number) -> Column:
    """Facility number, as text or number, to its keyword; null if unknown."""
    return lookup(strip(col(number).cast("string")).try_cast("int"), S.FACILITY_NAMES)


def priority_level(priority) -> Column:
    return lookup(col(priority).cast("string"), S.JOURNALD_LEVELS, "INFO")


def windows_level(event_type) -> Column:
    return lookup(col(event_type), S.WINDOWS_LEVELS, "UNKNOWN")


def windows_event_id(event_id) -> Column:
    """The low 16 bits carry the event number."""
    return col(event_id).cast("long").bitwiseAND(F.lit(0xFFFF).cast("long"))


def severity_rank(level) -> Column:
    return lookup(col(level), S.SEVERITY_RANK, S.UNRANKED)


def os_source_label(path) -> Column:
    """File path to a short label: base name without ``.log``."""
    path = col(path)
    name = F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)
    stem = F.replace(name, F.lit(".log"), F.lit(""))
    return F.when(path == "journald", "journald").otherwise(
        F.coalesce(filled(stem), path))


# The accepted time layouts.
_TIME = r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{1,2}:\d{1,2}"
_STRICT_TIME = (r"^\d{4}-\d{1,2}-\d{1,2}(T\d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?"
                r"| \d{1,2}:\d{1,2}:\d{1,2})$")
_OPEN_TIME = _TIME + r"(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})?$"


def parse_event_time(timestamp, compat: bool = False) -> Column:
    """Timestamp text to epoch microseconds; null when it cannot be read.

    By default an offset is honoured. ``compat=True`` looks only at the first
    26 characters, so a short time with an offset is unreadable and a long
    one has its offset ignored.
    """
    text = F.substring(col(timestamp), 1, 26) if compat else col(timestamp)
    layout = _STRICT_TIME if compat else _OPEN_TIME
    return F.when(text.rlike(layout), F.unix_micros(text.try_cast("timestamp")))


# Years 1 to 9999 as epoch microseconds.
_MIN_US, _MAX_US = -62_135_596_800_000_000, 253_402_300_800_000_000


def micros_to_iso(us) -> Column:
    """Epoch microseconds to ISO text; no fraction on whole seconds."""
    us = col(us)
    at = F.timestamp_micros(us)
    return (F.when(us.isNull() | (us < _MIN_US) | (us >= _MAX_US), "")
             .when(us % 1_000_000 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))
             .otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")))


def decode_byte_message(values) -> Column:
    """Array of byte values to text; bad UTF-8 becomes the replacement mark."""
    values = col(values)
    digits = F.array_join(F.transform(values, lambda b: F.lpad(F.hex(b), 2, "0")), "")
    listed = F.concat(F.lit("["), F.array_join(values.cast("array<string>"), ", "), F.lit("]"))
    return (F.when(F.exists(values, lambda b: (b < 0) | (b > 255)), listed)
             .otherwise(F.make_valid_utf8(F.unhex(digits).cast("string"))))


def windows_message(message, inserts) -> Column:
    """Rendered message, or the insert strings joined by a bar."""
    joined = F.array_join(F.coalesce(col(inserts), F.array().cast("array<string>")), " | ")
    return strip(F.coalesce(col(message), joined))


def insert_list_text(inserts) -> Column:
    """Insert strings as a quoted tuple, the layout used in ``raw``."""
    inserts = col(inserts)

    def quoted(s):
        s = F.replace(s, F.lit("\\"), F.lit("\\\\"))
        both = F.replace(s, F.lit("'"), F.lit("\\'"))
        return (F.when(s.contains("'") & ~s.contains('"'), F.concat(F.lit('"'), s, F.lit('"')))
                 .otherwise(F.concat(F.lit("'"), both, F.lit("'"))))

    items = F.array_join(F.transform(inserts, quoted), ", ")
    return (F.when(inserts.isNull(), "None")
             .when(F.size(inserts) == 1, F.concat(F.lit("("), items, F.lit(",)")))
             .otherwise(F.concat(F.lit("("), items, F.lit(")"))))


def record_id(path, seq, raw) -> Column:
    """Deterministic id: the same line at the same place keeps its id."""
    return F.sha2(F.concat_ws("\x1f", col(path), col(seq).cast("string"), col(raw)), 256)


def split_key(field) -> Column:
    """Any field as a sub-dataset name part."""
    return F.coalesce(F.replace(F.lower(col(field).cast("string")), F.lit(" "), F.lit("_")),
                      F.lit("unknown"))
