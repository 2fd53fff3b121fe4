"""Streaming forms, run over the given table as a stream to its end."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.summary import with_field_split
from ..streaming import live as L
from ..streaming.cadence import batch_stats, rebuild_decisions
from ..streaming.run import land, read_stream
from . import inputs as I
from .base import over, query
from .counts import CONDENSED, CRIT
from .detection import ESCALATING, OFFENDING, burst_sql
from .sources import RECS


@query("stream_ingest_journald", over(I.JRN, "SELECT timestamp, source, level, pid, hostname, facility, message, raw, ts_us FROM t_jrn"))
def _(spark, sf):
    lines = read_stream(spark, I.text_folder(I.t_jrn(spark, sf), "journal"), None, "text")
    return land(L.journald_stream(lines)).select(
        "timestamp", "source", "level", "pid", "hostname", "facility", "message", "raw", "ts_us")


@query("stream_ingest_windows", over(I.WIN, """SELECT seq, os_source, timestamp, source, level, event_id, hostname, message, raw
 FROM t_win WHERE ts > TIMESTAMP '2024-01-10 12:00:00'"""))
def _(spark, sf):
    return land(L.windows_stream(I.t_win_stream(spark, sf), since="2024-01-10 12:00:00")).select(
        "seq", "os_source", "timestamp", "source", "level", "event_id", "hostname", "message", "raw")


@query("stream_critical_alerts", over(I.LOG, f"""SELECT id, level, concat('[', level, '] ', source, ' | ', message) AS line
 FROM t_log WHERE level IN {CRIT}"""))
def _(spark, sf):
    return land(L.critical_alerts(I.t_log_stream(spark, sf)))


@query("stream_running_totals", over(I.LOG, f"""SELECT count(*) AS total, count(*) FILTER (level IN {CRIT}) AS critical,
 count(*) // 50 AS status_lines FROM t_log"""))
def _(spark, sf):
    return L.running_totals(I.t_log_stream(spark, sf))


@query("stream_level_counts", over(I.LOG, "SELECT level, count(*) AS count FROM t_log GROUP BY level"))
def _(spark, sf):
    return L.running_counts(I.t_log_stream(spark, sf), "level")


@query("stream_os_source_counts", over(I.LOG, "SELECT os_source, count(*) AS count FROM t_log GROUP BY os_source"))
def _(spark, sf):
    return L.running_counts(I.t_log_stream(spark, sf), "os_source")


@query("stream_split_counts", over(I.LOG, "SELECT concat(dataset, '__', lower(os_source)) AS sub_dataset, count(*) AS count FROM t_log GROUP BY ALL"))
def _(spark, sf):
    return L.running_counts(with_field_split(I.t_log_stream(spark, sf)), "sub_dataset")


@query("stream_condense", over({**I.LOG, "t_mask": f"SELECT *, {I.mask_sql('message')} AS template FROM t_log"},
                               """SELECT source, level, template AS message, min(seq) AS seq, arg_min(id, seq) AS id, count(*) AS count
 FROM t_mask GROUP BY source, level, template"""))
def _(spark, sf):
    return L.running_condense(I.t_log_stream(spark, sf)).select("source", "level", "message", "seq", "id", "count")


@query("stream_repeat_offenders", over({**I.LOG, **OFFENDING}, "SELECT source, critical_count, count FROM t_off"))
def _(spark, sf):
    return L.running_offenders(I.t_log_stream(spark, sf))


@query("stream_bursts", over({**I.LOG, **burst_sql("t_burst", 3600, 3)}, "SELECT seq, id, source FROM t_burst WHERE is_burst"))
def _(spark, sf):
    return L.running_bursts(I.t_log_stream(spark, sf), 3600, 3).select("seq", "id", "source")


@query("stream_escalations", over({**I.LOG, **ESCALATING}, "SELECT source FROM t_esc"))
def _(spark, sf):
    return L.running_escalations(I.t_log_stream(spark, sf))


@query("rebuild_cadence", over({**I.LOG, "b": f"""SELECT CAST(ts_us // 600000000 AS BIGINT) AS batch, count(*) AS rows,
  count(*) FILTER (level IN {CRIT}) AS critical, max(ts_us) AS at_us FROM t_log GROUP BY 1""",
 "o": "SELECT *, row_number() OVER (ORDER BY batch) AS rn FROM b",
 "r": """SELECT rn, batch, rows, critical, at_us, rows AS new_rows,
   CASE WHEN critical > 0 THEN 'critical event' WHEN rows >= 8 THEN 'count threshold' END AS reason, at_us AS last FROM o WHERE rn = 1
  UNION ALL SELECT o.rn, o.batch, o.rows, o.critical, o.at_us, n.new_rows,
   CASE WHEN o.critical > 0 THEN 'critical event' WHEN n.new_rows >= 8 THEN 'count threshold'
        WHEN n.new_rows > 0 AND o.at_us - r.last >= 1800000000 THEN 'time interval' END,
   CASE WHEN o.critical > 0 OR n.new_rows >= 8 OR (n.new_rows > 0 AND o.at_us - r.last >= 1800000000) THEN o.at_us ELSE r.last END
  FROM r JOIN o ON o.rn = r.rn + 1, LATERAL (SELECT CASE WHEN r.reason IS NULL THEN r.new_rows ELSE 0 END + o.rows AS new_rows) n"""},
                                "SELECT batch, rows, critical, at_us, new_rows, reason FROM r"))
def _(spark, sf):
    """Batches of ten minutes landed from the stream."""
    landed = land(I.t_log_stream(spark, sf).select("ts_us", "level"))
    batch = F.floor(F.col("ts_us") / 600_000_000).cast("long")
    return rebuild_decisions(batch_stats(landed, batch), 8, 1800)


_RANK = "CASE level WHEN 'DEBUG' THEN 0 WHEN 'INFO' THEN 1 WHEN 'NOTICE' THEN 2 WHEN 'WARNING' THEN 3 WHEN 'ERROR' THEN 4 ELSE -1 END"


@query("review_digest_30min", over(I.LOG, f"""SELECT CAST(ts_us // 1800000000 * 1800000000 AS BIGINT) AS start_us, count(*) AS total,
 count(*) FILTER (level IN {CRIT}) AS critical, max({_RANK}) AS worst_rank, min(ts_us) AS first_us, max(ts_us) AS last_us
 FROM t_log GROUP BY 1"""))
def _(spark, sf):
    return L.review_digest(I.t_log_stream(spark, sf))


_WEEK = 7 * 86_400_000_000
_ESC_WEEK = f"""SELECT DISTINCT start_us, source FROM (SELECT start_us, source, {_RANK} - lag({_RANK}) OVER (
 PARTITION BY start_us, source ORDER BY ts_us, seq) AS step FROM t_over) WHERE step >= 2"""


@query("review_stream", over({**I.LOG, "t_week": f"SELECT *, CAST(ts_us // {_WEEK} * {_WEEK} AS BIGINT) AS start_us FROM t_log",
 "t_over": f"SELECT * FROM t_week WHERE start_us + {_WEEK} <= (SELECT max(ts_us) FROM t_log)", "t_esc": _ESC_WEEK},
 f"""SELECT start_us, 'critical' AS part, CAST(seq AS VARCHAR) AS item, CAST(1 AS BIGINT) AS count FROM t_over WHERE level IN {CRIT}
 UNION ALL SELECT start_us, 'cluster', '-', count(*) FROM t_over GROUP BY start_us, level, source
 UNION ALL SELECT start_us, 'escalation', source, count(*) FROM t_over JOIN t_esc USING (start_us, source) GROUP BY start_us, source
 UNION ALL SELECT start_us, 'repeat_offender', source, count(*) FILTER (level IN ('ERROR', 'CRITICAL', 'AUDIT_FAILURE')) FROM t_over
  WHERE level IN {CRIT} GROUP BY start_us, source HAVING count(*) >= 3
 UNION ALL SELECT start_us, 'sample', level || ' ' || source, least(count(*), 2) FROM t_over GROUP BY start_us, level, source"""))
def _(spark, sf):
    """Periods of a week; the one that is still open has no review yet."""
    found = L.review_stream(I.t_log_stream(spark, sf), "7 days")
    source = F.regexp_replace("id", "^(escalation|repeat)_", "")
    patterns = found["patterns"].where("type <> 'burst'").select(
        "start_us", F.col("type").alias("part"), F.when(F.col("type") == "cluster", "-").otherwise(source).alias("item"), "count")
    critical = found["critical"].select("start_us", F.lit("critical").alias("part"), F.col("seq").cast("string").alias("item"), F.lit(1).cast("long").alias("count"))
    sample = found["sample"].groupBy("start_us", F.concat_ws(" ", "level", "source").alias("item")).agg(F.count("*").alias("count")).select(
        "start_us", F.lit("sample").alias("part"), "item", "count")
    return critical.unionByName(patterns).unionByName(sample)
