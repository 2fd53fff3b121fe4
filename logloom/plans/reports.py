"""Reports as tables of lines: section, ord, part, line."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.base import pad
from ..functions.display import pattern_line, record_line, table_columns
from ..operators.condense import condense_template
from ..operators.filters import filter_critical, last_critical
from ..operators.order import numbered, ranked_in_group, top_in_group
from ..operators.summary import consultation_overview, error_template_ratio
from ..session import stage

# Columns of a record that a condensed line shows, or that place it.
SHOWN = ["seq", "timestamp", "os_source", "source", "level", "message", "dataset"]


def _ranked(df: DataFrame, n: int | None, *order: Column) -> DataFrame:
    """All rows, or the first ``n``, with ``ord`` from 0."""
    if n is None:
        return numbered(df, list(order), "ord")
    return df.orderBy(*order).limit(n).withColumn(
        "ord", F.row_number().over(Window.orderBy(*order)).cast("long") - 1)


def _lines(df: DataFrame, section: str, *lines: Column) -> DataFrame:
    parts = F.posexplode(F.array(*lines)).alias("part", "line")
    return df.select(F.lit(section).alias("section"), F.col("ord").cast("long").alias("ord"), parts)


def _or_none(lines: DataFrame, section: str, text: str) -> DataFrame:
    """A placeholder line where a section is empty."""
    empty = lines.limit(1).agg(F.count("*").alias("n")).where("n = 0")
    return lines.unionByName(empty.select(
        F.lit(section).alias("section"), F.lit(0).cast("long").alias("ord"),
        F.lit(0).alias("part"), F.lit(text).alias("line")))


def _described() -> Column:
    return F.concat(F.lit("    "), F.col("description"))


def log_table_view(records: DataFrame, limit: int | None = None,
                   widths: dict[str, int] | None = None) -> DataFrame:
    """All or the first ``limit`` records as display columns, with ``more``:
    how many records are not shown."""
    shown = _ranked(records, limit, F.col("seq")).select("ord", *table_columns(widths))
    if limit is None:
        return shown.withColumn("more", F.lit(0).cast("long"))
    total = records.agg(F.greatest(F.count("*") - limit, F.lit(0).cast("long")).alias("more"))
    return shown.withColumn("more", total.scalar())


def pattern_lines(summary: DataFrame) -> DataFrame:
    """Pattern table as display lines, all patterns."""
    numbered = summary.withColumn("ord", F.col("first_seq"))
    return numbered.select("kind", "ord", F.posexplode(
        F.array(pattern_line(True), _described())).alias("part", "line"))


def triage_report(records: DataFrame, summary: DataFrame, sample: DataFrame,
                  max_patterns: int | None = None, max_samples: int | None = None,
                  max_critical: int | None = None) -> DataFrame:
    """Patterns, samples, critical rows and the total; all of them, or as many
    of the first patterns and samples and the last critical rows as asked for."""
    patterns = _lines(_ranked(summary, max_patterns, F.col("kind"), F.col("first_seq")),
                      "patterns", pattern_line(False), _described())
    samples = _lines(_ranked(sample, max_samples, F.col("cluster_id"), F.col("rank")), "samples",
                     record_line(with_count=False))
    urgent = filter_critical(records) if max_critical is None else last_critical(records, max_critical)
    critical = _lines(_ranked(urgent, max_critical, F.col("seq")),
                      "critical", record_line(with_os_source=False, with_count=False))
    total = _lines(records.agg(F.count("*").alias("n")).withColumn("ord", F.lit(0)), "total",
                   F.concat(F.lit("Total logs collected: "), F.col("n").cast("string")))
    return (_or_none(patterns, "patterns", "  (none yet)")
            .unionByName(_or_none(samples, "samples", "  (none)"))
            .unionByName(_or_none(critical, "critical", "  (none)"))
            .unionByName(total))


def _blocks(condensed: DataFrame, section: str, heading: DataFrame, max_records: int | None) -> DataFrame:
    """Per dataset: a heading (part 0), its condensed rows (part 1 and up), all
    or the leading ones, and a closing line where more were left out."""
    dataset = F.col("dataset").alias("ord")
    order = [F.col("count").desc(), F.col("seq")]
    # ranks move the line and what orders it, no other column
    lines = condensed.select("dataset", "count", "seq", record_line("    ").alias("line"))
    if max_records is None:
        top = ranked_in_group(lines, ["dataset"], order)
    else:
        top = top_in_group(lines, ["dataset"], order, max_records)
    rows = top.select(F.lit(section).alias("section"), dataset, F.col("rank").alias("part"), "line")
    if max_records is None:
        return heading.unionByName(rows)
    sizes = condensed.groupBy("dataset").agg((F.count("*") - max_records).alias("more")).where("more > 0")
    closing = sizes.select(
        F.lit(section).alias("section"), dataset, F.lit(max_records + 1).alias("part"),
        F.concat(F.lit("    ... "), F.col("more").cast("string"), F.lit(" more (omitted)")).alias("line"))
    return heading.unionByName(rows).unionByName(closing)


def consultation_report(records: DataFrame, summary: DataFrame, sample: DataFrame,
                        max_errors: int | None = None, max_samples: int | None = None) -> DataFrame:
    """Overview, all patterns, condensed errors and samples per dataset, and
    the level distribution. ``ord`` is text: number, pattern place or dataset."""
    over = consultation_overview(records, summary)
    fields = [("Total datasets  : ", "total_datasets"), ("Total records   : ", "total_records"),
              ("OS types        : ", "os_types"), ("Total errors    : ", "total_errors"),
              ("Patterns found  : ", "patterns")]
    overview = over.select(
        F.lit("overview").alias("section"), F.lit("").alias("ord"),
        F.posexplode(F.array(*[F.concat(F.lit(t), F.col(c).cast("string")) for t, c in fields])).alias("part", "line"))

    place = F.concat_ws(":", F.col("kind").cast("string"), F.lpad(F.col("first_seq").cast("string"), 19, "0"))
    patterns = summary.select(
        F.lit("patterns").alias("section"), place.alias("ord"),
        F.posexplode(F.array(pattern_line(False), _described())).alias("part", "line"))

    errors = stage(condense_template(filter_critical(records).select(*SHOWN), ("dataset",)), "errors")
    error_heading = error_template_ratio(records, errors).select(
        F.lit("errors").alias("section"), F.col("dataset").alias("ord"), F.lit(0).alias("part"),
        F.concat(F.lit("  Dataset: "), F.col("dataset"), F.lit(" ("), F.col("error_records").cast("string"),
                 F.lit(" error records -> "), F.col("unique_templates").cast("string"),
                 F.lit(" unique templates)")).alias("line"))
    sample = stage(sample.select(*SHOWN), "sample")   # read three times
    samples = condense_template(sample, ("dataset",))
    sample_heading = sample.select("dataset").distinct().select(
        F.lit("samples").alias("section"), F.col("dataset").alias("ord"), F.lit(0).alias("part"),
        F.concat(F.lit("  Dataset: "), F.col("dataset")).alias("line"))

    counted = records.groupBy("dataset", "level").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    ordered = F.array_sort(F.collect_list(F.struct(
        (-F.col("n")).alias("o"), "first", F.concat_ws("=", "level", F.col("n").cast("string")).alias("t"))))
    levels = counted.groupBy("dataset").agg(ordered.alias("p")).select(
        F.lit("levels").alias("section"), F.col("dataset").alias("ord"), F.lit(0).alias("part"),
        F.concat(F.lit("  "), pad("dataset", 35), F.lit(" "), F.array_join(F.col("p.t"), "  ")).alias("line"))

    return (overview.unionByName(patterns)
            .unionByName(_blocks(errors, "errors", error_heading, max_errors))
            .unionByName(_blocks(samples, "samples", sample_heading, max_samples))
            .unionByName(levels))
