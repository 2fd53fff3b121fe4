"""The whole pattern analysis: clusters, flags, samples and summary."""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import cluster as C
from ..operators import detect as D
from ..session import broadcast_if_small, join_flag, stage, stage_all

# Columns that clusters and detectors look at.
ANALYSED = ["seq", "source", "level", "os_source", "ts_us", "message", "cluster_id", "embedding"]
# Order of the pattern kinds in a summary.
CLUSTER, BURST, ESCALATION, OFFENDER = range(4)


class Patterns:
    """What an analysis found; each table is planned when it is asked for.

    ``pattern`` annotated records, ``sample`` the nearest records of each
    cluster, ``summary`` one row per pattern with ``kind`` and ``first_seq`` for
    their order.
    """

    def __init__(self, assigned: DataFrame, clustered: DataFrame, centroids: DataFrame | None,
                 n_per_cluster: int, burst_window_secs: int, burst_threshold: int):
        self.assigned, self.clustered, self.centroids = assigned, clustered, centroids
        self.n_per_cluster = n_per_cluster
        self.burst_window_secs, self.burst_threshold = burst_window_secs, burst_threshold
        self.found = stage_all(
            meta=cluster_meta(clustered, centroids),
            ticks=D.burst_ticks(clustered, burst_window_secs, burst_threshold),
            sources=D.source_totals(clustered),
            escalating=D.escalation_sources(clustered))
        self.offenders = broadcast_if_small(
            self.found["sources"].where(F.col("critical_count") >= S.OFFENDER_THRESHOLD)
            .withColumn("count", F.col("offender_count")))

    def _annotated(self, rows: DataFrame) -> DataFrame:
        return annotate(rows, self.found["meta"], self.found["ticks"], self.found["escalating"],
                        self.offenders)

    @cached_property
    def pattern(self) -> DataFrame:
        return self._annotated(self.assigned)

    @cached_property
    def chosen(self) -> DataFrame:
        """``seq`` and ``rank`` of the sampled records."""
        return stage_all(chosen=C.sample_per_cluster(
            self.clustered, self.centroids, self.n_per_cluster).select("seq", "rank"))["chosen"]

    @cached_property
    def sample(self) -> DataFrame:
        """Only the chosen rows are annotated."""
        return self._annotated(self.assigned.drop("embedding").join(self.chosen, "seq"))

    def sample_of(self, pattern: DataFrame) -> DataFrame:
        """The same from the annotated records, once these are saved: they are
        joined with the chosen rows and not with labels and flags again."""
        return pattern.drop("embedding").join(self.chosen, "seq")

    @cached_property
    def summary(self) -> DataFrame:
        escalating = D.listed(self.found["sources"], self.found["escalating"])
        # ids are unique, so rows in bursts are distinct ids
        burst_count = self.found["ticks"].agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"))
        return pattern_summary(self.found["meta"], burst_count, escalating, self.offenders,
                               self.burst_window_secs, self.burst_threshold)


def cluster_meta(clustered: DataFrame, centroids: DataFrame | None) -> DataFrame:
    """Label, size, confidence and first row of every cluster."""
    meta = C.cluster_labels(clustered)
    if centroids is None:
        return meta.withColumn("confidence", F.lit(1.0))
    return meta.join(C.cluster_confidence(clustered, centroids), "cluster_id")


def annotate(clustered: DataFrame, meta: DataFrame, bursts: DataFrame, escalating: DataFrame,
             offenders: DataFrame) -> DataFrame:
    """Records with cluster label, confidence and the three flags. All but the
    records are staged and measured tables with unique keys."""
    labels = meta.select(
        "cluster_id", F.col("label").alias("pattern_label"),
        F.round("confidence", 4).alias("pattern_confidence"))
    out = clustered.join(labels, "cluster_id", "left")
    out = join_flag(out, bursts, ["source", "ts_us"], "is_burst", staged=True)
    out = join_flag(out, escalating, ["source"], "is_escalation_source", staged=True)
    return join_flag(out, offenders, ["source"], "is_repeat_offender", staged=True)


def _say(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def pattern_summary(meta: DataFrame, burst_count: DataFrame, escalating: DataFrame,
                    offenders: DataFrame, burst_window_secs: int = S.BURST_WINDOW_SECS,
                    burst_threshold: int = S.BURST_THRESHOLD) -> DataFrame:
    """One row per pattern. ``escalating`` and ``offenders`` carry ``source``,
    ``count`` and ``first_seq``; ``burst_count`` is one row."""
    n = F.col("count").cast("string")
    src = F.coalesce("source", F.lit("None"))
    cid = F.col("cluster_id").cast("string")

    def rows(df, kind, type_, id_, label, description, confidence=F.lit(1.0)):
        return df.select(
            F.lit(kind).alias("kind"), "first_seq", F.lit(type_).alias("type"), id_.alias("id"),
            label.alias("label"), F.col("count").cast("long").alias("count"),
            confidence.alias("confidence"), description.alias("description"))

    clusters = rows(
        meta, CLUSTER, "cluster", _say("cluster_", cid), F.col("label"),
        _say("Semantic cluster #", cid, ": ", n, " similar records. Label: ", F.col("label")),
        F.col("confidence"))
    bursts = rows(
        burst_count.where("count > 0").withColumn("first_seq", F.lit(0).cast("long")),
        BURST, "burst", F.lit("burst_0"), _say("Event burst (", n, " records)"),
        _say(n, " records were part of rapid-fire bursts "
                f"(≥{burst_threshold} events from same source within {burst_window_secs} s)."))
    escalations = rows(
        escalating, ESCALATION, "escalation", _say("escalation_", src),
        _say("Severity escalation: ", src),
        _say('Source "', src, '" showed a severity escalation (jumped ≥2 levels, e.g. INFO → ERROR).'))
    repeats = rows(
        offenders, OFFENDER, "repeat_offender", _say("repeat_", src), _say("Repeat offender: ", src),
        _say('Source "', src, '" generated ', n, " error-level events."))
    return clusters.unionByName(bursts).unionByName(escalations).unionByName(repeats)


def detect_patterns(records: DataFrame, clusters: str | None = None, k: int | None = None,
                    n_per_cluster: int = S.SAMPLES_PER_CLUSTER,
                    burst_window_secs: int = S.BURST_WINDOW_SECS,
                    burst_threshold: int = S.BURST_THRESHOLD, starts: int = 10) -> Patterns:
    """Cluster, flag, sample and summarise one dataset.

    ``clusters`` is ``kmeans`` on the embedding or ``group`` by level and
    source; by default whichever the columns allow. The few columns that the
    detectors need are staged once; the annotated records come straight from
    the input, so give it a table or landed records, not a costly parse.
    """
    if clusters is None:
        clusters = "kmeans" if "embedding" in records.columns else "group"
    if clusters == "kmeans":
        assigned, centroids = C.kmeans_clusters(records, k, starts)
    else:
        assigned, centroids = C.group_clusters(records), None
    clustered = stage(assigned.select(
        *[c for c in ANALYSED if c in assigned.columns and (centroids is not None or c != "embedding")]), "analysed")

    return Patterns(assigned, clustered, centroids, n_per_cluster, burst_window_secs, burst_threshold)
