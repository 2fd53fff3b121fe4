"""Sources and sinks."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions.base import compute_once
from ..functions.records import (decode_byte_message, facility_name, infer_facility, infer_level,
                                 micros_to_iso, os_source_label, priority_level, windows_event_id,
                                 windows_level, windows_message)
from ..operators.summary import with_field_split, with_level_split
from ..operators.vectorize import vectorize
from ..session import scratch_path
from ..sources.files import first_lines_per_file, read_lines
from ..sources.journald import _get, filter_journald, ingest_journald, journald_entries, parse_journald
from ..sources.syslog import dedup_raw, ingest_syslog_files, parse_syslog, union_sources
from ..sources.tables import (load_jsonl, load_variant, save_records, save_variants, write_split)
from ..sources.windows import ingest_windows_events, newest_per_channel, parse_windows
from . import inputs as I
from .base import over, query

REC = ["timestamp", "os_source", "source", "level", "pid", "hostname", "facility", "message", "raw", "ts_us"]
RECS = ", ".join(REC)
_TEXT = """concat('[', timestamp, '] [', level, '] [Linux:', os_source, '] host=', hostname, ' source=', source,
 CASE WHEN pid <> 0 THEN concat(' pid=', pid) ELSE '' END,
 CASE WHEN facility IS NOT NULL THEN concat(' facility=', facility) ELSE '' END, ' ', message) AS text"""


def parsed_raw(spark, sf):
    return parse_syslog(I.t_raw(spark, sf), I.PARSE_YEAR)


@query("ingest_syslog_files", over(I.RAW, f"""SELECT row_number() OVER (ORDER BY place, event_id) - 1 AS seq, file, {RECS}
 FROM (SELECT *, seq AS event_id, os_source || '.log' AS file,
 CASE os_source WHEN 'auth' THEN 0 WHEN 'syslog' THEN 1 ELSE 2 END AS place FROM t_raw)"""))
def _(spark, sf):
    """One file per path, read with the default arguments; every column compared."""
    paths = I.text_files(I.t_raw(spark, sf), ["auth.log", "syslog.log", "messages.log"])
    read = ingest_syslog_files(spark, [paths[0], "/no/such/file.log", *paths[1:]], year=I.PARSE_YEAR)
    return read.select("seq", F.concat("os_source", F.lit(".log")).alias("file"), *REC)


@query("ingest_line_numbers", over(I.RAW, """SELECT raw AS value, row_number() OVER (ORDER BY place, event_id) - 1 AS seq,
 row_number() OVER (PARTITION BY place ORDER BY event_id) - 1 AS line_no FROM (SELECT *, seq AS event_id,
 CASE os_source WHEN 'auth' THEN 0 WHEN 'syslog' THEN 1 ELSE 2 END AS place FROM t_raw)"""))
def _(spark, sf):
    """Arrival and line number of every line."""
    paths = I.text_files(I.t_raw(spark, sf), ["auth.log", "syslog.log", "messages.log"])
    return read_lines(spark, paths).select("value", "seq", "line_no")


for _name, _kind in (("parse_syslog_iso", 1), ("parse_syslog_rfc3164", 0), ("parse_syslog_unmatched", 2)):
    def _make(kind):
        def run(spark, sf):
            """All lines are parsed; the layout that was recognised decides."""
            stamp = F.col("timestamp")
            layout = F.when(stamp == "", 2).when(stamp.rlike("[+-][0-9]{2}:[0-9]{2}$"), 1).otherwise(0)
            return compute_once(parsed_raw(spark, sf), "layout", layout).where(F.col("layout") == kind).select(
                "id", "seq", *REC, "text")
        return run
    query(_name, over(I.RAW, f"""SELECT sha256(concat(path, chr(31), seq, chr(31), raw)) AS id, seq, {RECS}, {_TEXT}
     FROM t_raw WHERE kind = {_kind}"""))(_make(_kind))


@query("ingest_journald_json", over(I.JRN, f"""SELECT seq, 'Linux' AS os_type, 'journald' AS os_source, timestamp,
 source, level, pid, hostname, facility, message, raw, ts_us, {_TEXT.replace('os_source', "'journald'")} FROM t_jrn"""))
def _(spark, sf):
    return ingest_journald(I.t_jrn(spark, sf)).select("seq", "os_type", *REC, "text")


@query("journald_since_unit", over(I.JRN, """SELECT seq, timestamp, source, message FROM t_jrn
 WHERE ts_us >= 1704844800000000 AND unit_no IN (1, 3)"""))
def _(spark, sf):
    kept = ingest_journald(I.t_jrn(spark, sf), since_us=1704844800000000,
                           units=["unit1.service", "unit3.service"])
    return kept.select("seq", "timestamp", "source", "message")


_WIN_COLS = "seq, 'Windows' AS os_type, os_source, timestamp, ts_us, source, level, event_id, hostname, message, raw"


@query("ingest_windows_events", over(I.WIN, f"SELECT {_WIN_COLS} FROM t_win"))
def _(spark, sf):
    return ingest_windows_events(I.t_win(spark, sf)).select(
        "seq", "os_type", "os_source", "timestamp", "ts_us", "source", "level", "event_id",
        "hostname", "message", "raw")


@query("parse_windows_events", over(I.WIN, f"SELECT {_WIN_COLS} FROM t_win"))
def _(spark, sf):
    return parse_windows(I.t_win(spark, sf)).select(
        "seq", "os_type", "os_source", "timestamp", "ts_us", "source", "level", "event_id",
        "hostname", "message", "raw")


@query("ingest_two_channels", over(I.WIN, f"""SELECT {_WIN_COLS} FROM (SELECT *, row_number() OVER (
 PARTITION BY os_source ORDER BY ts DESC, seq DESC) AS rn FROM t_win WHERE os_source IN ('System', 'Security'))
 WHERE rn <= 2000"""))
def _(spark, sf):
    """Two channels and a cap above the planner's rank limit."""
    return ingest_windows_events(I.t_win(spark, sf), ["System", "Security"], max_events=2000).select(
        "seq", "os_type", "os_source", "timestamp", "ts_us", "source", "level", "event_id",
        "hostname", "message", "raw")


@query("newest_per_channel", over(I.WIN, """SELECT seq, os_source AS channel, newest FROM (SELECT *, CAST(row_number() OVER (
 PARTITION BY os_source ORDER BY ts DESC, seq DESC) AS INTEGER) AS newest FROM t_win) WHERE newest <= 300"""))
def _(spark, sf):
    return newest_per_channel(I.t_win(spark, sf), 300).select("seq", "channel", "newest")


@query("events_newest_first", over(I.WIN, """SELECT seq, os_source AS channel, CAST(row_number() OVER (
 PARTITION BY os_source ORDER BY ts DESC, seq DESC) AS INTEGER) AS newest FROM t_win"""))
def _(spark, sf):
    """All events of every channel: no cap, and no channel in one task."""
    return newest_per_channel(I.t_win(spark, sf)).select("seq", "channel", "newest")


@query("first_lines_per_file", over(I.RAW, """SELECT seq, path, raw AS value, line_no FROM (SELECT *, row_number() OVER (
 PARTITION BY path ORDER BY seq) - 1 AS line_no FROM t_raw) WHERE line_no < 500"""))
def _(spark, sf):
    return first_lines_per_file(I.t_raw(spark, sf), 500)


@query("dedup_raw", over(I.RAW, f"SELECT seq, {RECS} FROM t_raw"))
def _(spark, sf):
    """Every line three times over, later copies numbered after the first."""
    lines = parsed_raw(spark, sf)
    copies = lines.withColumn("seq", F.explode(F.array(
        F.col("seq"), F.col("seq") + F.lit(1 << 50), F.col("seq") + F.lit(1 << 51))))
    return dedup_raw(copies).select("seq", *REC)


@query("union_sources", over({**I.RAW, **I.JRN}, f"""SELECT 0 AS rank, seq, {RECS} FROM t_raw UNION ALL
 SELECT 1, seq, timestamp, 'journald', source, level, pid, hostname, facility, message, raw, ts_us FROM t_jrn"""))
def _(spark, sf):
    files = parsed_raw(spark, sf)
    journal = ingest_journald(I.t_jrn(spark, sf))
    place = F.col("seq")
    return union_sources(files, journal, journal).select(
        F.shiftright(place, 56).cast("int").alias("rank"),
        place.bitwiseAND(F.lit((1 << 56) - 1)).alias("seq"), *REC)


# --- saving and loading -----------------------------------------------------
_ALL = ", ".join(f.name for f in S.LOG_RECORD.fields)
_NO_TEXT = ", ".join(f.name for f in S.LOG_RECORD.fields if f.name != "text")


@query("save_plain_jsonl", over(I.LOG, f"SELECT {_NO_TEXT} FROM t_log"))
def _(spark, sf):
    path = scratch_path(spark, "plain")
    save_records(I.t_log(spark, sf), path, with_text=False)
    return load_jsonl(spark, path).drop("text")


@query("save_text_jsonl", over(I.LOG, f"SELECT {_ALL} FROM t_log"))
def _(spark, sf):
    path = scratch_path(spark, "text")
    save_records(I.t_log(spark, sf), path, with_text=True)
    return load_jsonl(spark, path)


@query("load_jsonl", over(I.LOG, "SELECT dataset, level, count(*) AS n, CAST(sum(ts_us % 1000000) AS BIGINT) AS us FROM t_log GROUP BY ALL"))
def _(spark, sf):
    path = scratch_path(spark, "text")
    save_records(I.t_log(spark, sf), path, with_text=True)
    return load_jsonl(spark, path).groupBy("dataset", "level").agg(
        F.count("*").alias("n"), F.sum(F.col("ts_us") % 1_000_000).alias("us"))


@query("save_variants", over(I.LOG, """SELECT variant, dataset, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seqs FROM t_log,
 (VALUES ('original'), ('vectorized')) v(variant) GROUP BY ALL"""))
def _(spark, sf):
    path = scratch_path(spark, "variants")
    records = I.t_log_wide(spark, sf)
    names = save_variants({"original": records, "vectorized": vectorize(records),
                           "sample": records.limit(0).drop("embedding")}, path)
    out = None
    for name in names:
        part = load_variant(spark, path, name).select(F.lit(name).alias("variant"), "dataset", "seq")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("variant", "dataset").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


@query("load_vectorized", over(I.EMB, """SELECT seq, dim, round(x, 6) AS x FROM t_dim"""))
def _(spark, sf):
    path = scratch_path(spark, "vectors")
    vectors = I.t_emb(spark, sf).withColumn("dataset", F.lit("v"))
    save_variants({"vectorized": vectors}, path, "json")
    back = load_variant(spark, path, "vectorized", "json")
    return back.select("seq", F.posexplode("embedding").alias("dim", "x")).select(
        "seq", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


@query("write_split_partitions", over(I.LOG, f"""SELECT lower(level) AS split, {_ALL} FROM t_log"""))
def _(spark, sf):
    path = scratch_path(spark, "split")
    write_split(I.t_log(spark, sf), path, "level")
    back = spark.read.parquet(path)
    return back.select("split", *[f.name for f in S.LOG_RECORD.fields])


@query("write_split_by_os_source", over(I.LOG, """SELECT lower(os_source) AS split, count(*) AS n FROM t_log GROUP BY ALL"""))
def _(spark, sf):
    path = scratch_path(spark, "split")
    write_split(I.t_log(spark, sf), path, "os_source", "json")
    return spark.read.schema("split string, id string").json(path).groupBy("split").agg(F.count("*").alias("n"))


# --- source expressions -----------------------------------------------------
@query("infer_level", over(I.RAW, """SELECT seq, CASE WHEN kind = 2 THEN (CASE split_part(said, ':', 1) WHEN 'error' THEN 'ERROR'
 WHEN 'warning' THEN 'WARNING' WHEN 'notice' THEN 'NOTICE' WHEN 'debug' THEN 'DEBUG' ELSE 'INFO' END) ELSE level END AS level
 FROM t_raw JOIN (SELECT event_id AS seq, said FROM t_said) s USING (seq)"""))
def _(spark, sf):
    return parsed_raw(spark, sf).select("seq", infer_level("source", "message").alias("level"))


@query("infer_facility", over(I.RAW, """SELECT seq, source, coalesce(facility, 'user') AS facility FROM t_raw"""))
def _(spark, sf):
    return parsed_raw(spark, sf).select("seq", "source", infer_facility("source").alias("facility"))


@query("os_source_label", over(I.RAW, "SELECT seq, path, os_source FROM t_raw"))
def _(spark, sf):
    return I.t_raw(spark, sf).select("seq", "path", os_source_label("path").alias("os_source"))


def entries(spark, sf):
    return journald_entries(I.t_jrn(spark, sf))


@query("facility_name", over(I.JRN, "SELECT seq, facility FROM t_jrn"))
def _(spark, sf):
    return entries(spark, sf).select("seq", facility_name(_get("SYSLOG_FACILITY")).alias("facility"))


@query("priority_level", over(I.JRN, "SELECT seq, level FROM t_jrn"))
def _(spark, sf):
    return entries(spark, sf).select("seq", priority_level(_get("PRIORITY")).alias("level"))


@query("decode_byte_message", over(I.JRN, "SELECT seq, said AS message FROM t_jrn WHERE seq % 10 = 0 AND seq % 97 <> 0"))
def _(spark, sf):
    values = _get("MESSAGE", "array<int>")
    return entries(spark, sf).where(values.isNotNull()).select("seq", decode_byte_message(values).alias("message"))


@query("journald_fallbacks", over(I.JRN, "SELECT seq, source, pid, hostname FROM t_jrn"))
def _(spark, sf):
    return parse_journald(entries(spark, sf)).select("seq", "source", "pid", "hostname")


@query("micros_to_iso", """SELECT event_id AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS whole,
 CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS exact
 FROM events""")
def _(spark, sf):
    us = F.col("ts_us")
    return I.t_log(spark, sf).select("seq", micros_to_iso(us - us % 1_000_000).alias("whole"),
                                     micros_to_iso(us).alias("exact"))


@query("windows_level", over(I.WIN, "SELECT seq, level, event_id FROM t_win"))
def _(spark, sf):
    return I.t_win(spark, sf).select("seq", windows_level("event_type").alias("level"),
                                     windows_event_id("event_id").alias("event_id"))


@query("windows_message_fallback", over(I.WIN, "SELECT seq, message FROM t_win"))
def _(spark, sf):
    return I.t_win(spark, sf).select("seq", windows_message("message", "string_inserts").alias("message"))
