"""Projections and scalar expressions over records and messages."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions.display import level_badge, record_line
from ..functions.records import (build_text, embedding_input_text, fill_text, parse_event_time,
                                 severity_rank, split_key)
from ..functions.templates import mask_message, message_tokens
from ..operators.order import explode_once
from ..plans.reports import log_table_view
from ..sources.syslog import as_records
from . import inputs as I
from .base import over, query

_BLANKED = {**I.LOG, "t_blank": """SELECT *, CASE seq % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE text END AS given,
 CASE WHEN seq % 8 = 0 THEN NULL ELSE message END AS said FROM t_log"""}
_BADGES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.LEVEL_BADGES.items())
_RANKS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.SEVERITY_RANK.items())


def blanked(spark, sf):
    seq = F.col("seq")
    return (I.t_log(spark, sf)
            .withColumn("given", F.when(seq % 4 == 0, "").when(seq % 4 != 1, F.col("text")))
            .withColumn("said", F.when(seq % 8 != 0, F.col("message"))))


@query("normalise_record", over(I.LOG, """SELECT sha256(concat(os_source, chr(31), seq, chr(31), raw)) AS id, timestamp,
 os_type, os_source, source, level, event_id, pid, hostname, facility, message, raw, text, ts_us, seq, 'all' AS dataset
 FROM t_log"""))
def _(spark, sf):
    return as_records(I.t_log(spark, sf).drop("id", "text", "ts_us", "dataset"), "all")


@query("build_text", over(I.LOG, "SELECT seq, text FROM t_log"))
def _(spark, sf):
    return I.t_log(spark, sf).select("seq", build_text().alias("text"))


@query("fill_text", over(_BLANKED, "SELECT seq, text FROM t_blank"))
def _(spark, sf):
    return blanked(spark, sf).select("seq", fill_text("given").alias("text"))


@query("embedding_input_text", over(_BLANKED, """SELECT seq, coalesce(nullif(given, ''), said, '') AS text FROM t_blank"""))
def _(spark, sf):
    return blanked(spark, sf).select("seq", embedding_input_text("given", "said").alias("text"))


@query("parse_event_time", over(I.LOG, """SELECT seq, ts_us, ts_us - ts_us % 1000000 AS spaced_us,
 ts_us - 7200000000 AS offset_us, ts_us AS compat_us, CAST(NULL AS BIGINT) AS compat_short_us FROM t_log"""))
def _(spark, sf):
    ts = F.col("timestamp")
    short = F.concat(F.substring(ts, 1, 19), F.lit("+02:00"))
    return I.t_log(spark, sf).select(
        "seq", parse_event_time(ts).alias("ts_us"),
        parse_event_time(F.replace(F.substring(ts, 1, 19), F.lit("T"), F.lit(" "))).alias("spaced_us"),
        parse_event_time(F.concat(ts, F.lit("+02:00"))).alias("offset_us"),
        parse_event_time(F.concat(ts, F.lit("+02:00")), compat=True).alias("compat_us"),
        parse_event_time(short, compat=True).alias("compat_short_us"))


@query("mask_message", over(I.TAILED, f"SELECT seq, {I.mask_sql('message')} AS template FROM t_tail"))
def _(spark, sf):
    return I.with_variable_tail(I.t_msg(spark, sf)).select("seq", mask_message("message").alias("template"))


@query("level_badge", over(I.LOG, f"SELECT seq, CASE level {_BADGES} ELSE '[  ]' END AS badge FROM t_log"))
def _(spark, sf):
    return I.t_log(spark, sf).select("seq", level_badge("level").alias("badge"))


@query("log_table_view", over(I.LOG, f"""SELECT row_number() OVER (ORDER BY seq) - 1 AS ord,
 CASE level {_BADGES} ELSE '[  ]' END AS badge, timestamp, os_source, source, level,
 CASE WHEN pid <> 0 THEN CAST(pid AS VARCHAR) ELSE '' END AS pid, message, CAST(0 AS BIGINT) AS more FROM t_log"""))
def _(spark, sf):
    return log_table_view(I.t_log(spark, sf))


@query("format_record_line", over(I.LOG, """SELECT seq, concat('  ', CASE WHEN n > 1 THEN concat('x', rpad(CAST(n AS VARCHAR), 4, ' ')) ELSE '     ' END,
 ' [', timestamp, '] [', level, '] [', os_source, '] ', source, ': ', message) AS line,
 concat('  [', timestamp, '] [', level, '] [', os_source, '] ', source, ': ', message) AS live
 FROM (SELECT *, seq % 3 AS n FROM t_log)"""))
def _(spark, sf):
    counted = I.t_log(spark, sf).withColumn("count", F.col("seq") % 3)
    return counted.select("seq", record_line().alias("line"), record_line(with_count=False).alias("live"))


@query("split_key", over(I.LOG, """SELECT seq, replace(lower(os_source), ' ', '_') AS by_source,
 coalesce(replace(lower(CAST(pid AS VARCHAR)), ' ', '_'), 'unknown') AS by_pid,
 replace(lower(message), ' ', '_') AS by_message FROM t_log"""))
def _(spark, sf):
    return I.t_log(spark, sf).select("seq", split_key("os_source").alias("by_source"),
                                     split_key("pid").alias("by_pid"), split_key("message").alias("by_message"))


@query("severity_rank", over(I.LOG, f"SELECT seq, CASE level {_RANKS} ELSE -1 END AS rank FROM t_log"))
def _(spark, sf):
    return I.t_log(spark, sf).select("seq", severity_rank("level").alias("rank"))


TOKEN_FILTER = "length(token) > 2 AND token NOT IN (" + ", ".join(f"'{w}'" for w in S.STOPWORDS) + ")"
TOKENS = {**I.MSG, "t_word": f"""SELECT *, generate_subscripts(w, 1) AS pos, trim(unnest(w), '[]():,;.') AS token
 FROM (SELECT *, list_filter(regexp_split_to_array(lower(message), '{I.SPACE_SQL}+'), lambda x: x <> '') AS w FROM t_msg)""",
          "t_token": f"SELECT * FROM t_word WHERE {TOKEN_FILTER}"}


@query("message_tokens", over(TOKENS, """SELECT seq, pos, token FROM (SELECT seq, token,
 row_number() OVER (PARTITION BY seq ORDER BY pos) - 1 AS pos FROM t_token)"""))
def _(spark, sf):
    return explode_once(I.t_msg(spark, sf).select("seq", message_tokens("message").alias("token")), "token", "pos").select(
        "seq", F.col("pos").cast("long").alias("pos"), "token")
