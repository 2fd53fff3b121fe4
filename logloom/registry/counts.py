"""Filters, heads, condensation and counts."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..operators import filters as FL
from ..operators import summary as SU
from ..operators.condense import condense_exact, condense_template
from . import inputs as I
from .base import over, query

CRIT = "(" + ", ".join(f"'{v}'" for v in S.CRITICAL_LEVELS) + ")"
RECS = ["seq", "id", "source", "level", "message"]


@query("filter_level", over(I.LOG, "SELECT seq, level, message FROM t_log WHERE level = 'WARNING'"))
def _(spark, sf):
    return FL.filter_level(I.t_log(spark, sf), "warning").select("seq", "level", "message")


@query("filter_critical", over(I.LOG, f"SELECT seq, level, message FROM t_log WHERE level IN {CRIT}"))
def _(spark, sf):
    return FL.filter_critical(I.t_log(spark, sf)).select("seq", "level", "message")


@query("last_n_critical", over(I.LOG, f"SELECT seq, source, message FROM t_log WHERE level IN {CRIT} ORDER BY seq DESC LIMIT 20"))
def _(spark, sf):
    return FL.last_critical(I.t_log(spark, sf), 20).select("seq", "source", "message")


CONDENSED = {**I.TAILED, "t_mask": f"SELECT seq, source, level, dataset, {I.mask_sql('message')} AS template FROM t_tail",
             "t_cond": """SELECT source, level, template AS message, min(seq) AS seq, count(*) AS count
 FROM t_mask GROUP BY source, level, template"""}


def condensed(spark, sf):
    return condense_template(I.with_variable_tail(I.t_msg(spark, sf)))


@query("condense_exact", over(I.MSG, """SELECT source, level, message, min(seq) AS seq, arg_min(os_source, seq) AS os_source,
 count(*) AS count FROM t_msg GROUP BY source, level, message"""))
def _(spark, sf):
    return condense_exact(I.t_msg(spark, sf)).select("source", "level", "message", "seq", "os_source", "count")


@query("condense_template", over(CONDENSED, "SELECT *, true AS condensed FROM t_cond"))
def _(spark, sf):
    return condensed(spark, sf).select("source", "level", "message", "seq", "count", "condensed")


@query("condense_template_capped", over(CONDENSED, """SELECT source, level, message, seq, count FROM (SELECT *,
 row_number() OVER (PARTITION BY source, level ORDER BY count DESC, seq) AS rn FROM t_cond) WHERE rn <= 2"""))
def _(spark, sf):
    return condense_template(I.with_variable_tail(I.t_msg(spark, sf)), max_per_pair=2).select(
        "source", "level", "message", "seq", "count")


@query("top_templates", over(CONDENSED, "SELECT seq, message, count FROM t_cond ORDER BY count DESC, seq LIMIT 30"))
def _(spark, sf):
    return FL.top_templates(condensed(spark, sf), 30).select("seq", "message", "count")


@query("sort_by_count", over(CONDENSED, "SELECT seq, source, message, count FROM t_cond"))
def _(spark, sf):
    return FL.sort_by_count(condensed(spark, sf)).select("seq", "source", "message", "count")


@query("summary_by_level", over(I.LOG, "SELECT level, count(*) AS count FROM t_log GROUP BY level"))
def _(spark, sf):
    return SU.summary_by_level(I.t_log(spark, sf))


@query("summary_by_os_source", over(I.LOG, "SELECT os_source, count(*) AS count FROM t_log GROUP BY os_source"))
def _(spark, sf):
    return SU.summary_by_os_source(I.t_log(spark, sf))


@query("level_distribution", over(I.LOG, "SELECT dataset, level, count(*) AS count FROM t_log GROUP BY ALL"))
def _(spark, sf):
    return SU.level_distribution(I.t_log(spark, sf))


@query("split_by_level", over(I.LOG, """SELECT dataset, concat(dataset, '__', lower(level)) AS sub_dataset, count(*) AS count
 FROM t_log GROUP BY ALL"""))
def _(spark, sf):
    return SU.split_sizes(SU.with_level_split(I.t_log(spark, sf)))


@query("split_by_field", over(I.LOG, """SELECT dataset, concat(dataset, '__', coalesce(CAST(pid AS VARCHAR), 'unknown')) AS sub_dataset,
 count(*) AS count FROM t_log GROUP BY ALL"""))
def _(spark, sf):
    return SU.split_sizes(SU.with_field_split(I.t_log(spark, sf), "pid"))


@query("consultation_overview", over(I.LOG, f"""SELECT count(DISTINCT dataset) AS total_datasets, count(*) AS total_records,
 'Linux, Windows' AS os_types, count(*) FILTER (level IN {CRIT}) AS total_errors, CAST(0 AS BIGINT) AS patterns FROM t_log"""))
def _(spark, sf):
    return SU.consultation_overview(I.t_log(spark, sf))


@query("error_template_ratio", over(CONDENSED, f"""SELECT dataset, count(*) AS error_records,
 count(DISTINCT concat(source, chr(31), level, chr(31), template)) AS unique_templates FROM t_mask WHERE level IN {CRIT} GROUP BY dataset"""))
def _(spark, sf):
    return SU.error_template_ratio(I.with_variable_tail(I.t_msg(spark, sf)))
