"""Clusters, labels, samples and the pattern analysis."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import squared_distance
from ..operators import cluster as C
from ..operators.filters import head
from ..operators.summary import dataset_inventory
from ..operators.vectorize import vectorize
from ..plans.patterns import detect_patterns
from ..plans.rebuild import rebuild
from ..plans.reports import pattern_lines
from ..session import scratch_path, stage
from . import inputs as I
from .base import over, query
from .counts import CRIT
from .detection import ESCALATING, OFFENDING, burst_sql
from .expressions import TOKEN_FILTER, TOKENS

# clusters of level and source, numbered as first seen
GROUPED = {**I.LOG, "t_seen": "SELECT level, source, min(seq) AS first_seq FROM t_log GROUP BY level, source",
           "t_num": "SELECT level, source, row_number() OVER (ORDER BY first_seq) - 1 AS cluster_id FROM t_seen",
           "t_clu": "SELECT t_log.*, cluster_id FROM t_log JOIN t_num USING (level, source)"}


@query("auto_k", over(I.LOG, """SELECT count(*) AS n, CAST(least(count(*), greatest(2, least(10, floor(sqrt(count(*) / 2))))) AS BIGINT) AS k
 FROM t_log"""))
def _(spark, sf):
    return I.t_log(spark, sf).agg(F.count("*").alias("n")).select(
        "n", C.auto_k_column(F.col("n")).cast("long").alias("k"))


@query("group_clusters", over(GROUPED, "SELECT seq, level, source, cluster_id FROM t_clu"))
def _(spark, sf):
    return C.group_clusters(I.t_log(spark, sf)).select("seq", "level", "source", "cluster_id")


@query("cluster_sizes", over(I.EMB, "SELECT cluster_id, count(*) AS count FROM t_emb GROUP BY cluster_id"))
def _(spark, sf):
    return C.cluster_sizes(I.t_emb(spark, sf))


def host_clusters(df):
    return df.withColumn("cluster_id", F.substring("hostname", 5, 1).cast("long"))


def _mode(field):
    return f"""SELECT cluster_id, {field} FROM (SELECT cluster_id, {field}, row_number() OVER (PARTITION BY cluster_id
 ORDER BY count(*) DESC, min(seq)) AS rn FROM t_host GROUP BY cluster_id, {field}) WHERE rn = 1"""


HOST = {**I.LOG, "t_host": "SELECT *, CAST(substr(hostname, 5, 1) AS BIGINT) AS cluster_id FROM t_log",
        "m_level": _mode("level"), "m_source": _mode("source"), "m_os": _mode("os_source")}


@query("cluster_modes", over(HOST, """SELECT cluster_id, level, source, os_source FROM m_level
 JOIN m_source USING (cluster_id) JOIN m_os USING (cluster_id)"""))
def _(spark, sf):
    return C.cluster_modes(host_clusters(I.t_log(spark, sf))).select("cluster_id", "level", "source", "os_source")


KEYWORDS = {**TOKENS, "t_key": """SELECT * FROM (SELECT doc_id % 10 AS cluster_id, token, count(*) AS n,
 CAST(row_number() OVER (PARTITION BY doc_id % 10 ORDER BY count(*) DESC, min(CAST(seq AS HUGEINT) * 1000000 + pos)) AS INTEGER) AS rank
 FROM t_token GROUP BY doc_id % 10, token) WHERE rank <= 3"""}


@query("cluster_keywords", over(KEYWORDS, "SELECT cluster_id, rank, token, n FROM t_key"))
def _(spark, sf):
    return C.cluster_keywords(I.t_msg(spark, sf).withColumn("cluster_id", F.col("doc_id") % 10))


HOST_LABEL = {**HOST, "t_hw": """SELECT cluster_id, seq, generate_subscripts(w, 1) AS pos, trim(unnest(w), '[]():,;.') AS token
 FROM (SELECT *, regexp_split_to_array(lower(message), '\\s+') AS w FROM t_host)""",
              "t_hk": f"""SELECT cluster_id, string_agg(token, ', ' ORDER BY rn) AS words FROM (SELECT cluster_id, token,
 row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, min(seq * 1000 + pos)) AS rn FROM t_hw WHERE {TOKEN_FILTER}
 GROUP BY cluster_id, token) WHERE rn <= 3 GROUP BY cluster_id"""}


@query("cluster_labels", over(HOST_LABEL, """SELECT cluster_id, concat('[', level, '] ', source, ' (', os_source, ') | ', words) AS label
 FROM m_level JOIN m_source USING (cluster_id) JOIN m_os USING (cluster_id) JOIN t_hk USING (cluster_id)"""))
def _(spark, sf):
    return C.cluster_labels(host_clusters(I.t_log(spark, sf))).select("cluster_id", "label")


@query("centroids", over(I.EMB, "SELECT cluster_id, dim, round(c, 6) AS c FROM t_cen"))
def _(spark, sf):
    return C.centroids(I.t_emb(spark, sf)).select("cluster_id", F.posexplode("centroid").alias("dim", "c")).select(
        "cluster_id", F.col("dim").cast("long").alias("dim"), F.round("c", 6).alias("c"))


@query("cluster_confidence", over(I.EMB, """SELECT cluster_id, round(avg(CASE WHEN nc = 0 THEN 1.0 ELSE xc / (nx * nc + 1e-9) END), 6) AS confidence
 FROM t_cos GROUP BY cluster_id"""))
def _(spark, sf):
    emb = I.t_emb(spark, sf)
    return C.cluster_confidence(emb, C.centroids(emb)).select("cluster_id", F.round("confidence", 6).alias("confidence"))


_DIST = "CASE WHEN nx * nc > 0 THEN 1 - xc / (nx * nc) ELSE 0.0 END"


@query("member_centroid_distance", over(I.EMB, f"SELECT seq, cluster_id, round({_DIST}, 6) AS distance FROM t_cos"))
def _(spark, sf):
    emb = I.t_emb(spark, sf)
    return C.member_distances(emb, C.centroids(emb)).select("seq", "cluster_id", F.round("distance", 6).alias("distance"))


@query("sample_per_cluster", over(I.EMB, f"""SELECT seq, cluster_id, rank FROM (SELECT seq, cluster_id,
 CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY {_DIST}, seq) AS INTEGER) AS rank FROM t_cos) WHERE rank <= 2"""))
def _(spark, sf):
    emb = I.t_emb(spark, sf)
    return C.sample_per_cluster(emb, C.centroids(emb)).select("seq", "cluster_id", "rank")


@query("nearest_centroid", over({**I.EMB, "t_far": """SELECT seq, t_cen.cluster_id AS cid, sum((x - c) * (x - c)) AS d
 FROM t_dim JOIN t_cen USING (dim) GROUP BY ALL"""}, """SELECT seq, arg_min(cid, d) AS cluster_id, round(min(d), 6) AS squared_distance
 FROM t_far GROUP BY seq"""))
def _(spark, sf):
    emb = I.t_emb(spark, sf)
    return C.nearest_centroid(emb, C.centroids(emb)).select("seq", "cluster_id", F.round("squared_distance", 6).alias("squared_distance"))


_AUTO_K = "CAST(least(count(*), greatest(2, least(10, floor(sqrt(count(*) / 2))))) AS BIGINT)"


@query("kmeans_clusters", over(I.EMB, f"""SELECT 'row' AS part, seq AS key, true AS holds FROM t_emb
 UNION ALL SELECT 'cluster', unnest(range((SELECT {_AUTO_K} FROM t_emb))), true UNION ALL SELECT 'start', unnest(range(10)), true"""))
def _(spark, sf):
    """Starts are random, so what must hold is stated row by row, at the default
    parameters. Of a row: no centroid is nearer than its own. Of a cluster:
    its centroid is the mean of its members. Of a start: the centroids kept
    cost no more than those it settled at."""
    records = I.t_emb(spark, sf).drop("cluster_id")
    vectors = stage(records.select("embedding"), "vectors")
    fits = C.kmeans_starts(vectors, C.auto_k(vectors.count()), 10)
    centroids = C.cheapest(vectors, fits)
    assigned = stage(C.nearest_centroid(records, centroids).drop("squared_distance"), "assigned")
    own = squared_distance("embedding", "centroid")
    owned = stage(C.with_centroid(assigned, centroids).withColumn("own", own).drop("cluster_id"), "owned")
    nearest = C.nearest_centroid(owned, centroids)
    rows = nearest.select(F.lit("row").alias("part"), F.col("seq").alias("key"),
                          (F.col("own") <= F.col("squared_distance") + 1e-9).alias("holds"))
    means = C.centroids(assigned).withColumnRenamed("centroid", "mean")
    clusters = centroids.join(means, "cluster_id", "left").select(
        F.lit("cluster").alias("part"), F.col("cluster_id").alias("key"),
        F.coalesce(squared_distance("mean", "centroid") < 1e-6, F.lit(False)).alias("holds"))
    kept = owned.agg(F.sum("own")).first()[0]
    costs = [C.nearest_centroid(records, C.centroid_rows(spark, fit)).agg(F.sum("squared_distance")).first()[0] for fit in fits]
    starts = spark.createDataFrame([(i, bool(kept <= c * (1 + 1e-9) + 1e-9)) for i, c in enumerate(costs)], "key long, holds boolean")
    return rows.unionByName(clusters).unionByName(starts.select(F.lit("start").alias("part"), "key", "holds"))


# --- whole analysis ---------------------------------------------------------
BURST_SECS, BURST_N = 3600, 3
META = {**GROUPED,
        "t_cw": """SELECT cluster_id, seq, generate_subscripts(w, 1) AS pos, trim(unnest(w), '[]():,;.') AS token
 FROM (SELECT *, regexp_split_to_array(lower(message), '\\s+') AS w FROM t_clu)""",
        "t_ck": f"""SELECT cluster_id, string_agg(token, ', ' ORDER BY rn) AS words FROM (SELECT cluster_id, token,
 row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, min(seq * 1000 + pos)) AS rn FROM t_cw WHERE {TOKEN_FILTER}
 GROUP BY cluster_id, token) WHERE rn <= 3 GROUP BY cluster_id""",
        "t_co": """SELECT cluster_id, os_source FROM (SELECT cluster_id, os_source, row_number() OVER (PARTITION BY cluster_id
 ORDER BY count(*) DESC, min(seq)) AS rn FROM t_clu GROUP BY cluster_id, os_source) WHERE rn = 1""",
        "t_meta": """SELECT t_num.cluster_id, concat('[', level, '] ', source, ' (', os_source, ') | ', words) AS label, n AS count, first_seq
 FROM t_num JOIN t_co USING (cluster_id) JOIN t_ck USING (cluster_id)
 JOIN (SELECT cluster_id, count(*) AS n, min(seq) AS first_seq FROM t_clu GROUP BY cluster_id) USING (cluster_id)"""}
FLAGS = {**META, **burst_sql("t_burst", BURST_SECS, BURST_N), **ESCALATING, **OFFENDING,
         "t_pat": """SELECT t_clu.*, label AS pattern_label, 1.0::DOUBLE AS pattern_confidence, is_burst,
 source IN (SELECT source FROM t_esc) AS is_escalation_source, source IN (SELECT source FROM t_off) AS is_repeat_offender
 FROM t_clu JOIN t_meta USING (cluster_id) JOIN (SELECT seq, is_burst FROM t_burst) USING (seq)""",
         "t_sam": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY seq) AS rank FROM t_pat) WHERE rank <= 2",
         "t_sum": f"""SELECT 0 AS kind, first_seq, 'cluster' AS type, concat('cluster_', cluster_id) AS id, label, count,
  concat('Semantic cluster #', cluster_id, ': ', count, ' similar records. Label: ', label) AS description FROM t_meta
 UNION ALL SELECT 1, 0, 'burst', 'burst_0', concat('Event burst (', n, ' records)'), n,
  concat(n, ' records were part of rapid-fire bursts (≥{BURST_N} events from same source within {BURST_SECS} s).')
  FROM (SELECT count(DISTINCT id) AS n FROM t_burst WHERE is_burst) WHERE n > 0
 UNION ALL SELECT 2, min(seq), 'escalation', concat('escalation_', source), concat('Severity escalation: ', source), count(*),
  concat('Source "', source, '" showed a severity escalation (jumped ≥2 levels, e.g. INFO → ERROR).')
  FROM t_log WHERE source IN (SELECT source FROM t_esc) GROUP BY source
 UNION ALL SELECT 3, min(t_log.seq), 'repeat_offender', concat('repeat_', source), concat('Repeat offender: ', source), any_value(t_off.count),
  concat('Source "', source, '" generated ', any_value(t_off.count), ' error-level events.')
  FROM t_log JOIN t_off USING (source) GROUP BY source"""}


def found(spark, sf):
    return detect_patterns(I.t_log_wide(spark, sf), "group", burst_window_secs=BURST_SECS, burst_threshold=BURST_N)


_SUM = "type, id, label, count, 1.0::DOUBLE AS confidence, description"
ANNOTATED = ["seq", "source", "level", "cluster_id", "pattern_label", "pattern_confidence", "is_burst",
             "is_escalation_source", "is_repeat_offender"]


@query("annotate_patterns", over(FLAGS, f"SELECT {', '.join(ANNOTATED)} FROM t_pat"))
def _(spark, sf):
    return found(spark, sf).pattern.select(*ANNOTATED)


@query("pattern_summary", over(FLAGS, f"SELECT {_SUM} FROM t_sum"))
def _(spark, sf):
    return found(spark, sf).summary.drop("kind", "first_seq")


@query("pattern_detection", over(FLAGS, """SELECT 'pattern' AS part, CAST(seq AS VARCHAR) AS key, concat(pattern_label, '|', is_burst, '|',
  is_escalation_source, '|', is_repeat_offender) AS content FROM t_pat
 UNION ALL SELECT 'sample', CAST(seq AS VARCHAR), concat(cluster_id, '|', rank, '|', message) FROM t_sam
 UNION ALL SELECT 'summary', concat(type, id), concat(label, '|', count, '|', description) FROM t_sum"""))
def _(spark, sf):
    """Everything at once: annotated records, samples and summary."""
    p = found(spark, sf)

    def rows(df, part, key, *content):
        return df.select(F.lit(part).alias("part"), key.alias("key"),
                         F.concat_ws("|", *[F.col(c).cast("string") for c in content]).alias("content"))

    seq = F.col("seq").cast("string")
    return (rows(p.pattern, "pattern", seq, "pattern_label", "is_burst", "is_escalation_source", "is_repeat_offender")
            .unionByName(rows(p.sample, "sample", seq, "cluster_id", "rank", "message"))
            .unionByName(rows(p.summary, "summary", F.concat("type", "id"), "label", "count", "description")))


@query("pattern_detection_kmeans", over(FLAGS, f"""SELECT type, id, label, count, description FROM t_sum WHERE kind > 0
 UNION ALL SELECT 'cluster', concat('cluster_', k), 'a member is the first', 1, 'counts its members'
  FROM (SELECT unnest(range((SELECT {_AUTO_K} FROM t_log))) AS k)
 UNION ALL SELECT 'clusters', 'all', '', count(*), '' FROM t_log"""))
def _(spark, sf):
    """K-means on hashed texts at the default parameters. Which rows a cluster
    has depends on the starts: of each, its count, label and first row are
    compared with those of the annotated rows."""
    p = detect_patterns(vectorize(I.t_log_wide(spark, sf)), burst_window_secs=BURST_SECS, burst_threshold=BURST_N)
    members = p.pattern.groupBy("cluster_id").agg(
        F.count("*").alias("n"), F.min("seq").alias("first"), F.first("pattern_label").alias("named"))
    clusters = p.summary.where("type = 'cluster'").withColumn(
        "cluster_id", F.substring_index("id", "_", -1).cast("long")).join(members, "cluster_id", "left")
    said = F.concat(F.lit("Semantic cluster #"), F.col("cluster_id").cast("string"), F.lit(": "), F.col("n").cast("string"),
                    F.lit(" similar records. Label: "), F.col("named"))
    checked = clusters.select(
        "type", "id", F.when(F.col("first") == F.col("first_seq"), "a member is the first").alias("label"),
        F.lit(1).cast("long").alias("count"),
        F.when((F.col("n") == F.col("count")) & (said == F.col("description")), "counts its members").alias("description"))
    total = clusters.agg(F.sum("count").alias("count")).select(
        F.lit("clusters").alias("type"), F.lit("all").alias("id"), F.lit("").alias("label"), "count", F.lit("").alias("description"))
    rest = p.summary.where("type <> 'cluster'").select("type", "id", "label", "count", "description")
    return rest.unionByName(checked).unionByName(total)


@query("head_patterns", over(FLAGS, f"SELECT {_SUM} FROM t_sum ORDER BY kind, first_seq LIMIT 15"))
def _(spark, sf):
    return head(found(spark, sf).summary, 15, "kind", "first_seq").drop("kind", "first_seq")


@query("head_sample", over(I.EMB, f"""SELECT seq, cluster_id FROM (SELECT seq, cluster_id,
 row_number() OVER (PARTITION BY cluster_id ORDER BY {_DIST}, seq) AS rank FROM t_cos) WHERE rank <= 2 ORDER BY cluster_id, rank LIMIT 10"""))
def _(spark, sf):
    emb = I.t_emb(spark, sf)
    return head(C.sample_per_cluster(emb, C.centroids(emb)), 10, "cluster_id", "rank").select("seq", "cluster_id")


@query("dataset_inventory", over(FLAGS, """SELECT dataset, original, pattern, sample, true AS has_vectors FROM
 (SELECT dataset, count(*) AS original, count(*) AS pattern FROM t_log GROUP BY dataset)
 JOIN (SELECT dataset, count(*) AS sample FROM t_sam GROUP BY dataset) USING (dataset)"""))
def _(spark, sf):
    p = detect_patterns(vectorize(I.t_log_wide(spark, sf)), "group")
    return dataset_inventory(I.t_log(spark, sf), p.pattern, p.sample)


@query("rebuild_tables", over(FLAGS, """SELECT 'original' AS part, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seqs FROM t_log
 UNION ALL SELECT 'vectorized', count(*), CAST(sum(seq) AS BIGINT) FROM t_log
 UNION ALL SELECT 'pattern', count(*), CAST(sum(seq) AS BIGINT) FROM t_pat
 UNION ALL SELECT 'sample', count(*), CAST(sum(seq) AS BIGINT) FROM t_sam
 UNION ALL SELECT 'summary', count(*), CAST(sum(count) AS BIGINT) FROM t_sum
 UNION ALL SELECT 'by_level', count(*), CAST(sum(seq) AS BIGINT) FROM t_log
 UNION ALL SELECT 'by_os_source', count(*), CAST(sum(seq) AS BIGINT) FROM t_log"""))
def _(spark, sf):
    """Everything a rebuild saves, read back."""
    path = scratch_path(spark, "rebuild")
    rebuild(I.t_log_wide(spark, sf), path, clusters="group", burst_window_secs=BURST_SECS, burst_threshold=BURST_N)

    def part(name, value="seq"):
        return spark.read.parquet(f"{path}/{name}").agg(
            F.count("*").alias("n"), F.sum(value).alias("seqs")).select(F.lit(name).alias("part"), "n", "seqs")

    out = part("summary", "count")
    for name in ("original", "vectorized", "pattern", "sample", "by_level", "by_os_source"):
        out = out.unionByName(part(name))
    return out


@query("pattern_lines", over(FLAGS, """SELECT kind, first_seq AS ord, part, CASE part
 WHEN 0 THEN concat('  [', rpad(upper(type), 16, ' '), '] ', CASE WHEN length(label) < 40 THEN rpad(label, 40, ' ') ELSE label END,
  ' count=', count, ' conf=1.00') ELSE concat('    ', description) END AS line FROM t_sum, (VALUES (0), (1)) p(part)"""))
def _(spark, sf):
    return pattern_lines(found(spark, sf).summary)
