"""Bursts, escalations and repeat offenders."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..operators import detect as D
from . import inputs as I
from .base import over, query
from .counts import CRIT

_RANK = "CASE level " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.SEVERITY_RANK.items()) + " ELSE -1 END"


def burst_sql(name: str, secs: int, threshold: int) -> dict[str, str]:
    us = secs * 1_000_000
    return {f"{name}_n": f"""SELECT *, count(*) OVER (PARTITION BY source ORDER BY ts_us
   RANGE BETWEEN CURRENT ROW AND {us} FOLLOWING) AS n FROM t_log""",
            name: f"""SELECT *, max(n) OVER (PARTITION BY source ORDER BY ts_us
   RANGE BETWEEN {us} PRECEDING AND CURRENT ROW) >= {threshold} AS is_burst FROM {name}_n"""}


ESCALATING = {"t_step": f"""SELECT source, {_RANK} - lag({_RANK}) OVER (PARTITION BY source ORDER BY ts_us, seq) AS step FROM t_log""",
              "t_esc": "SELECT DISTINCT source FROM t_step WHERE step >= 2"}
OFFENDING = {"t_off": f"""SELECT source, count(*) AS critical_count,
 count(*) FILTER (level IN ('ERROR', 'CRITICAL', 'AUDIT_FAILURE')) AS count
 FROM t_log WHERE level IN {CRIT} GROUP BY source HAVING count(*) >= 3"""}


@query("detect_bursts", over({**I.LOG, **burst_sql("t_burst", 3600, 3)}, "SELECT seq, source, is_burst FROM t_burst"))
def _(spark, sf):
    return D.detect_bursts(I.t_log(spark, sf), 3600, 3).select("seq", "source", "is_burst")


@query("detect_bursts_wide", over({**I.LOG, **burst_sql("t_burst", 21600, 4)}, "SELECT seq, source, is_burst FROM t_burst WHERE is_burst"))
def _(spark, sf):
    return D.detect_bursts(I.t_log(spark, sf), 21600, 4).where("is_burst").select("seq", "source", "is_burst")


@query("detect_bursts_hot", over(
    {"t_log": """SELECT event_id AS seq, CASE WHEN user_id % 3 = 0 THEN epoch_us(TIMESTAMP '2024-01-10') + event_id * 7919 % 1000000
  ELSE epoch_us(ts) END AS ts_us, CASE WHEN user_id % 3 = 0 THEN 'hot' ELSE concat('u', user_id) END AS source FROM events""",
     **burst_sql("t_burst", 600, 4)}, "SELECT seq, source, ts_us, is_burst FROM t_burst"))
def _(spark, sf):
    """One source with a third of the rows, all within one second."""
    is_hot = F.col("pid") % 3 == 0
    hot = F.when(is_hot, "hot").otherwise(F.substring_index("source", "@", 1))
    second = F.unix_micros(F.lit("2024-01-10").cast("timestamp")) + F.col("seq") * 7919 % 1_000_000
    at = F.when(is_hot, second).otherwise(F.col("ts_us"))
    return D.detect_bursts(I.t_log(spark, sf).select("seq", at.alias("ts_us"), hot.alias("source")), 600, 4).select(
        "seq", "source", "ts_us", "is_burst")


@query("detect_escalations", over({**I.LOG, **ESCALATING}, "SELECT source FROM t_esc"))
def _(spark, sf):
    return D.escalation_sources(I.t_log(spark, sf))


@query("repeat_offenders", over({**I.LOG, **OFFENDING}, "SELECT source, critical_count FROM t_off"))
def _(spark, sf):
    return D.repeat_offenders(I.t_log(spark, sf)).select("source", "critical_count")


@query("offender_counts", over(
    {"t_log": "SELECT *, CASE event_type WHEN 'view' THEN 'ALERT' WHEN 'error' THEN 'ERROR' ELSE 'INFO' END AS level, concat('u', user_id) AS source FROM events",
     **OFFENDING}, "SELECT source, critical_count, count FROM t_off"))
def _(spark, sf):
    """Alerts decide the threshold but do not enter the reported count."""
    level = F.when(F.col("level") == "DEBUG", "ALERT").when(F.col("level") == "ERROR", "ERROR").otherwise("INFO")
    return D.repeat_offenders(I.t_log(spark, sf).select(
        F.substring_index("source", "@", 1).alias("source"), level.alias("level")))


@query("escalation_summary_counts", over({**I.LOG, **ESCALATING}, """SELECT source, count(*) AS count, min(seq) AS first_seq
 FROM t_log WHERE source IN (SELECT source FROM t_esc) GROUP BY source"""))
def _(spark, sf):
    records = I.t_log(spark, sf)
    return D.rows_per_source(records, D.escalation_sources(records))
