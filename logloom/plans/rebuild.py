"""One full rebuild of the saved datasets from the landed records."""
from __future__ import annotations

from pyspark.sql import DataFrame

from .. import schema as S
from ..functions.records import fill_text
from ..operators.vectorize import vectorize, vectorize_per_split
from ..sources.tables import load_variant, save_records, save_variants, write_split
from .patterns import Patterns, detect_patterns


def rebuild(records: DataFrame, path: str, backend: str = "hash", clusters: str | None = None,
            k: int | None = None, starts: int = 10, burst_window_secs: int = S.BURST_WINDOW_SECS,
            burst_threshold: int = S.BURST_THRESHOLD, mode: str = "errorifexists") -> Patterns:
    """Fill texts, embed, detect patterns, and save everything under ``path``:
    the four variants, the level and os_source splits with vectors of their
    own, the summary, and the records as JSON lines with and without ``text``.

    The vectors are saved first and every later step reads them from there;
    the sample is taken from the saved pattern. JSON lines are gzipped.
    """
    spark = records.sparkSession
    filled = records.withColumn("text", fill_text())
    save_variants({"vectorized": vectorize(filled, backend)}, path, mode=mode)
    vectors = load_variant(spark, path, "vectorized")
    found = detect_patterns(vectors, clusters, k, burst_window_secs=burst_window_secs,
                            burst_threshold=burst_threshold, starts=starts)
    plain = vectors.drop("embedding")
    written = save_variants({"original": plain, "pattern": found.pattern}, path, mode=mode)
    # a mode that leaves or adds to earlier files says nothing about these rows
    fresh = "pattern" in written and mode in ("errorifexists", "error", "overwrite")
    save_variants({"sample": found.sample_of(load_variant(spark, path, "pattern")) if fresh else found.sample}, path, mode=mode)
    found.summary.write.mode(mode).parquet(f"{path}/summary")
    for field in ("level", "os_source"):
        # hash vectors are the same in every split; others are fitted inside it
        own = vectors if backend != "tfidf" else vectorize_per_split(plain, field, backend)
        write_split(own, f"{path}/by_{field}", field, mode=mode)
    save_records(plain, f"{path}/jsonl", with_text=False, mode=mode, compression="gzip")
    save_records(plain, f"{path}/jsonl_text", with_text=True, mode=mode, compression="gzip")
    return found
