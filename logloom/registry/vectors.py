"""Text vectors."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.vectors import hash_embedding
from ..operators import vectorize as VZ
from ..operators.heavy import list_ends
from ..operators.order import explode_once
from ..session import stage
from . import inputs as I
from .base import over, query


def hash_sql(source: str, text: str) -> dict[str, str]:
    return {"t_slot": f"""SELECT seq, b & 127 AS dim, CASE WHEN b % 2 = 0 THEN 1 ELSE -1 END AS sign FROM (SELECT seq,
 CAST(concat('0x', right(md5(w), 2)) AS INTEGER) AS b FROM (SELECT seq,
 unnest(regexp_split_to_array(lower({text}), '{I.SPACE_SQL}+')) AS w FROM {source}) WHERE w <> '')""",
            "t_vec": "SELECT seq, dim, sum(sign) AS v FROM t_slot GROUP BY seq, dim",
            "t_hash": "SELECT seq, dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY seq)), 6) AS x FROM t_vec"}


def sparse(df):
    return explode_once(df.select("seq", F.col("embedding").alias("x")), "x", "dim").where("x <> 0").select(
        "seq", "dim", F.round("x", 6).alias("x"))


@query("hash_embedding", over({**I.MSG, **hash_sql("t_msg", "message")}, "SELECT seq, dim, x FROM t_hash"))
def _(spark, sf):
    return sparse(I.t_msg(spark, sf).withColumn("embedding", hash_embedding("message")))


@query("vectorize_dataset", over({**I.LOG, **hash_sql("t_log", "text")}, "SELECT seq, dim, x FROM t_hash"))
def _(spark, sf):
    return sparse(VZ.vectorize(I.t_log_wide(spark, sf), "hash"))


def tfidf_sql(split: str, n: int = 5000) -> dict[str, str]:
    return {"t_toks": f"SELECT seq, {split} AS split, regexp_extract_all(lower(message), '[{I.WORD_SQL}]{{2,}}') AS toks FROM t_msg",
            "t_term": """SELECT split, seq, unnest(toks) AS term FROM t_toks UNION ALL SELECT split, seq,
 unnest(list_transform(range(1, len(toks)), lambda i: concat(toks[i], ' ', toks[i + 1]))) FROM t_toks""",
            "t_tf": "SELECT split, seq, term, count(*) AS tf FROM t_term GROUP BY ALL",
            "t_voc": f"""SELECT split, term, df FROM (SELECT split, term, count(*) AS df, row_number() OVER (PARTITION BY split
 ORDER BY sum(tf) DESC, term) AS rn FROM t_tf GROUP BY split, term) WHERE rn <= {n}""",
            "t_n": "SELECT split, count(*) AS n FROM t_toks GROUP BY split",
            "t_w": """SELECT split, seq, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM t_tf
 JOIN t_voc USING (split, term) JOIN t_n USING (split)""",
            "t_idf": "SELECT split, seq, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY split, seq)), 6) AS weight FROM t_w"}


def long_form(rows):
    return rows.select("split", "seq", F.explode(F.arrays_zip("terms", "weights")).alias("e")).select(
        "split", "seq", F.col("e.terms").alias("term"), F.round("e.weights", 6).alias("weight"))


@query("tfidf", over({**I.MSG, **tfidf_sql("''")}, "SELECT seq, term, weight FROM t_idf"))
def _(spark, sf):
    return long_form(VZ.tfidf(I.t_msg(spark, sf), text=F.col("message"))).drop("split")


@query("tfidf_per_split", over({**I.MSG, **tfidf_sql("level")}, "SELECT split, seq, term, weight FROM t_idf"))
def _(spark, sf):
    return long_form(VZ.tfidf(I.t_msg(spark, sf), text=F.col("message"), split=F.col("level")))


def products(probes):
    """A vector's length ``n`` and its products with three probes, ``e0`` to
    ``e2``. A narrower vector meets the first numbers of each probe."""
    wide = len(probes)

    @F.arrow_udf("struct<n: double, e0: double, e1: double, e2: double>")
    def of(vectors: pa.Array) -> pa.Array:
        sizes, x = np.diff(list_ends(vectors)), vectors.flatten().to_numpy(zero_copy_only=False)
        if len(sizes) and wide >= sizes[0] == sizes.min() == sizes.max():
            x = x.reshape(len(sizes), sizes[0])
            sums = [np.sqrt(np.einsum("ij,ij->i", x, x)), *(x @ probes[:sizes[0]]).T]
        else:
            row = np.repeat(np.arange(len(vectors)), sizes)
            place = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            met = np.where((place < wide)[:, None], probes[np.minimum(place, wide - 1)], np.nan)
            sums = [np.sqrt(np.bincount(row, x * x, len(vectors))), *(np.bincount(row, x * m, len(vectors)) for m in met.T)]
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(v)) for v in sums], names=["n", "e0", "e1", "e2"], mask=vectors.is_null())
    return of


def lengths(vectors):
    """Lengths of a column of vectors."""
    @F.arrow_udf("double")
    def of(vectors: pa.Array) -> pa.Array:
        x = vectors.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(vectors)), np.diff(list_ends(vectors)))
        return pa.array(np.sqrt(np.bincount(row, x * x, len(vectors))), mask=vectors.is_null().to_numpy(zero_copy_only=False))
    return of(vectors)


def probed(spark, rows, bases, vectors):
    """(seq, holds): whether a text's vector, but for its length, is its TF-IDF
    row times the basis of its split, and has unit length or is zero. A vector
    is told from any other by its products with three random ones. ``rows``
    holds (split, seq, slots, weights), ``vectors`` (seq, embedding)."""
    wide = max(v.shape[1] for v in bases.values())
    probes = np.random.default_rng(1).standard_normal((wide, 3))
    sent = spark.sparkContext.broadcast({split: v @ probes[:v.shape[1]] for split, v in bases.items()})

    @F.arrow_udf("struct<s0: double, s1: double, s2: double>")
    def scores(splits: pa.Array, slots: pa.Array, weights: pa.Array) -> pa.Array:
        out = np.zeros((len(splits), 3))
        row = np.repeat(np.arange(len(splits)), np.diff(list_ends(slots)))
        slot, weight = slots.flatten().to_numpy().astype(np.int64), weights.flatten().to_numpy()
        named = splits.dictionary_encode("encode")
        group = named.indices.to_numpy()[row]
        for g, split in enumerate(named.dictionary.to_pylist()):
            if split not in sent.value:   # no basis, no score
                continue
            own = group == g
            for k in range(3):
                out[:, k] += np.bincount(row[own], weight[own] * sent.value[split][slot[own], k], len(splits))
        return pa.StructArray.from_arrays([pa.array(out[:, k]) for k in range(3)], names=["s0", "s1", "s2"])

    met = (rows.select("seq", scores("split", "slots", "weights").alias("s"))
           .groupBy("seq").agg(*[F.sum(f"s.s{k}").alias(f"s{k}") for k in range(3)]))
    # four numbers of a vector go on
    said = vectors.select("seq", products(probes)("embedding").alias("v")).select("seq", "v.*")
    e, s = [F.col(f"e{k}") for k in range(3)], [F.coalesce(f"s{k}", F.lit(0.0)) for k in range(3)]
    along = (F.abs(s[0] * e[1] - s[1] * e[0]) < 1e-6) & (F.abs(s[0] * e[2] - s[2] * e[0]) < 1e-6) & (s[0] * e[0] > -1e-6)
    length = F.abs(s[0]) + F.abs(s[1]) + F.abs(s[2])
    unit = (F.abs(F.col("n") - 1) < 1e-9) & (length > 1e-9)
    none = (F.col("n") == 0) & (length < 1e-6)
    return said.join(met, "seq", "left").select("seq", F.coalesce((unit & along) | none, F.lit(False)).alias("holds"))


@query("vectorize_per_split", over({**I.LOG, **hash_sql("t_log", "text")}, """SELECT 'hash' AS part, seq, CAST(dim AS BIGINT) AS dim, x FROM t_hash
 UNION ALL SELECT 'tfidf', seq, 64, 1.0::DOUBLE FROM t_log UNION ALL SELECT 'along', seq, 1, 1.0::DOUBLE FROM t_log"""))
def _(spark, sf):
    """Hash vectors number by number; of TF-IDF vectors, fitted per level, the
    width and the length, and whether each lies along its text's row times the
    basis of its level."""
    records = I.t_log_wide(spark, sf)
    hashes = sparse(VZ.vectorize_per_split(records, "level"))
    fit = VZ.fit_tfidf(records, split="level")
    fitted = stage(VZ.with_vectors(records, fit).select("seq", "embedding"), "fitted")
    rows = VZ.tfidf(records, split=F.col("level"), names=False)
    along = probed(spark, rows, fit.bases(), fitted)
    return hashes.select(F.lit("hash").alias("part"), "seq", F.col("dim").cast("long").alias("dim"), "x").unionByName(
        fitted.select(F.lit("tfidf").alias("part"), "seq", F.size("embedding").cast("long").alias("dim"),
                      F.round(lengths("embedding"), 6).alias("x"))).unionByName(
        along.select(F.lit("along").alias("part"), "seq", F.col("holds").cast("long").alias("dim"), F.lit(1.0).alias("x")))


@query("svd_embedding", over({**I.MSG, **tfidf_sql("''")}, """SELECT 'text' AS part, seq AS key, true AS holds
 FROM (SELECT DISTINCT seq FROM t_idf) UNION ALL SELECT 'basis', unnest(range(64)), true"""))
def _(spark, sf):
    """Sign and rotation are free, so what must hold is stated row by row.

    Of a text: its vector has unit length or is zero and, but for its length,
    is the text's TF-IDF row times the basis. Of a basis vector: it has unit
    length, is orthogonal to the others and an eigenvector of X'X but for a
    hundredth of the largest eigenvalue.
    """
    records = I.t_msg(spark, sf)
    rows = stage(VZ.tfidf(records, text=F.col("message"), names=False), "tfidf")
    sizes = records.groupBy(F.lit("").alias("split")).agg(F.count("*").alias("n"))
    vectors, basis = VZ.svd_of_rows(rows, sizes, "seq", 64)
    image = VZ.gram_times(rows, basis)[""]
    v = basis[""]
    values = (v * image).sum(axis=0)
    residual = np.linalg.norm(image - v * values, axis=0)
    good = (np.abs(v.T @ v - np.eye(v.shape[1])).max(axis=0) < 1e-9) & (residual < 0.01 * values.max())
    dims = spark.createDataFrame([(i, bool(g)) for i, g in enumerate(good)], "key long, holds boolean")
    texts = probed(spark, rows, basis, vectors).select(F.lit("text").alias("part"), F.col("seq").alias("key"), "holds")
    return texts.unionByName(dims.select(F.lit("basis").alias("part"), "key", "holds"))


@query("vectorize_tfidf", over(I.LOG, "SELECT seq, id, level, message, CAST(64 AS INTEGER) AS dims, 1.0::DOUBLE AS length, true AS holds FROM t_log"))
def _(spark, sf):
    """Every record keeps its row and gets a unit vector of one width, which
    lies along its text's row times the basis."""
    records = I.t_log_wide(spark, sf)
    fit = VZ.fit_tfidf(records)
    fitted = stage(VZ.with_vectors(records, fit).select("seq", "id", "level", "message", "embedding"), "fitted")
    along = probed(spark, VZ.tfidf(records, names=False), fit.bases(), fitted.select("seq", "embedding"))
    said = fitted.select("seq", "id", "level", "message", F.size("embedding").alias("dims"), F.round(lengths("embedding"), 6).alias("length"))
    return said.join(along, "seq").select("seq", "id", "level", "message", "dims", "length", "holds")
