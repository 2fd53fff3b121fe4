"""Report tables."""
from __future__ import annotations

from ..plans import reports as R
from . import inputs as I
from .base import over, query
from .clusters import FLAGS, found
from .counts import CRIT

_HEAD = "concat('  [', rpad(upper(type), 16, ' '), '] ', label, ' (count=', count, ', conf=1.00)')"
_LIVE = "concat('  [', timestamp, '] [', level, '] [', os_source, '] ', source, ': ', message)"
_BARE = "concat('  [', timestamp, '] [', level, '] ', source, ': ', message)"


@query("triage_report", over(FLAGS, f"""SELECT 'patterns' AS section, ord, part,
  CASE part WHEN 0 THEN {_HEAD} ELSE concat('    ', description) END AS line
  FROM (SELECT *, row_number() OVER (ORDER BY kind, first_seq) - 1 AS ord FROM t_sum), (VALUES (0), (1)) p(part) WHERE ord < 15
 UNION ALL SELECT 'samples', ord, 0, {_LIVE} FROM (SELECT *, row_number() OVER (ORDER BY cluster_id, rank) - 1 AS ord FROM t_sam) WHERE ord < 10
 UNION ALL SELECT 'critical', 19 - back, 0, {_BARE} FROM (SELECT *, row_number() OVER (ORDER BY seq DESC) - 1 AS back
  FROM t_log WHERE level IN {CRIT}) WHERE back < 20
 UNION ALL SELECT 'total', 0, 0, concat('Total logs collected: ', count(*)) FROM t_log"""))
def _(spark, sf):
    p = found(spark, sf)
    return R.triage_report(I.t_log(spark, sf), p.summary, p.sample, 15, 10, 20)


def _blocks(section: str, table: str, limit: int) -> str:
    return f"""SELECT '{section}', dataset, CAST(rn AS INTEGER), concat('    ', CASE WHEN n > 1 THEN concat('x', rpad(CAST(n AS VARCHAR), 4, ' ')) ELSE '     ' END,
  ' [', timestamp, '] [', level, '] [', os_source, '] ', source, ': ', message)
  FROM {table} WHERE rn <= {limit}
 UNION ALL SELECT '{section}', dataset, {limit + 1}, concat('    ... ', count(*) - {limit}, ' more (omitted)')
  FROM {table} GROUP BY dataset HAVING count(*) > {limit}"""


def _condensed(source: str, where: str = "true") -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY n DESC, seq) AS rn FROM (SELECT dataset, source, level,
 template AS message, count(*) AS n, min(seq) AS seq, arg_min(timestamp, seq) AS timestamp, arg_min(os_source, seq) AS os_source
 FROM (SELECT *, {I.mask_sql('message')} AS template FROM {source}) WHERE {where} GROUP BY dataset, source, level, template)"""


CONSULT = {**FLAGS, "c_err": _condensed("t_log", f"level IN {CRIT}"), "c_sam": _condensed("t_sam"),
           "t_over": f"""SELECT [concat('Total datasets  : ', count(DISTINCT dataset)), concat('Total records   : ', count(*)),
  'OS types        : Linux, Windows', concat('Total errors    : ', count(*) FILTER (level IN {CRIT})),
  concat('Patterns found  : ', (SELECT count(*) FROM t_sum))] AS l FROM t_log"""}


def _consult_sql(*limits: int) -> str:
    errors, samples = limits or (1 << 30, 1 << 30)
    return f"""SELECT 'overview' AS section, '' AS ord, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS part, unnest(l) AS line FROM t_over
 UNION ALL SELECT 'patterns', concat(kind, ':', lpad(CAST(first_seq AS VARCHAR), 19, '0')), part,
  CASE part WHEN 0 THEN {_HEAD} ELSE concat('    ', description) END FROM t_sum, (VALUES (0), (1)) p(part)
 UNION ALL SELECT 'errors', dataset, 0, concat('  Dataset: ', dataset, ' (', sum(n), ' error records -> ', count(*), ' unique templates)') FROM c_err GROUP BY dataset
 UNION ALL {_blocks('errors', 'c_err', errors)}
 UNION ALL SELECT DISTINCT 'samples', dataset, 0, concat('  Dataset: ', dataset) FROM t_sam
 UNION ALL {_blocks('samples', 'c_sam', samples)}
 UNION ALL SELECT 'levels', dataset, 0, concat('  ', rpad(dataset, 35, ' '), ' ', string_agg(concat(level, '=', n), '  ' ORDER BY n DESC, first))
  FROM (SELECT dataset, level, count(*) AS n, min(seq) AS first FROM t_log GROUP BY dataset, level) GROUP BY dataset"""


@query("consultation_report", over(CONSULT, _consult_sql(20, 10)))
def _(spark, sf):
    p = found(spark, sf)
    return R.consultation_report(I.t_log(spark, sf), p.summary, p.sample, 20, 10)


@query("consultation_report_whole", over(CONSULT, _consult_sql()))
def _(spark, sf):
    """At its defaults: every condensed error and sample of every dataset."""
    p = found(spark, sf)
    return R.consultation_report(I.t_log(spark, sf), p.summary, p.sample)
