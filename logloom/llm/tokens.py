"""Exact histogram of encoded document lengths, and what it answers for every context limit."""
from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The split pattern published with this vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters given to the encoder at once; a longer text is cut in front of a space between two letters.
ENCODE_CHARS = 1 << 18
# Lengths are summed in runs of this many, so that no task meets all of them.
RUN = 4096


def pieces(text: str, most: int = ENCODE_CHARS) -> Iterator[str]:
    """Cuts where the split pattern must cut too, so counts add up exactly."""
    while len(text) > most:
        k = most
        while k < len(text) and not (text[k] == " " and text[k - 1].isalpha() and text[k + 1:k + 2].isalpha()):
            k += 1
        yield text[:k]
        text = text[k:]
    yield text


def encoded_length(spark: SparkSession, text: Column, ranks: dict[bytes, int]) -> Column:
    """Tokens of each text; a null one has none. The vocabulary travels as a
    broadcast of fixed size, read once on the driver."""
    sent = spark.sparkContext.broadcast(ranks)

    @F.pandas_udf("long")
    def length(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken
        encoder = tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=sent.value, special_tokens={})
        for texts in batches:
            yield pd.Series([0 if t is None else sum(len(encoder.encode_ordinary(p)) for p in pieces(t))
                             for t in texts], dtype="int64")
    return length(text)


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY,
                     by: list[str] = ()) -> DataFrame:
    """Documents per encoded length (and per ``by``); counts combine before the shuffle."""
    lengths = docs.select(*by, encoded_length(docs.sparkSession, F.col(text), read_ranks(vocabulary)).alias("n_tokens"))
    return lengths.groupBy(*by, "n_tokens").agg(F.count("*").alias("documents"))


def context_table(histogram: DataFrame, by: list[str] = ()) -> DataFrame:
    """For every length that occurs, taken as a context limit.

    ``tokens``: of the documents with just that length. ``documents_within``,
    ``tokens_within``: of all up to it. ``documents_longer``: of more tokens.
    ``tokens_truncated``: what is left if every document is cut there.
    ``quantile``: share of documents up to it. A limit between two lengths has
    the row of the lower one, but for ``tokens_truncated``, which grows by
    ``documents_longer`` per token. Sums run over RUN lengths at a time and
    over one row per such run.
    """
    run = F.floor(F.col("n_tokens") / RUN)
    rows = histogram.withColumns({"run": run, "tokens": F.col("n_tokens") * F.col("documents")})
    runs = rows.groupBy(*by, "run").agg(F.sum("documents").alias("d"), F.sum("tokens").alias("t"))
    before = Window.partitionBy(*by).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    runs = runs.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("run").alias("__run"), F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d0"),
                       F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"),
                       F.sum("d").over(whole).alias("all_d"))
    inside = Window.partitionBy(*by, "run").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("run") == F.col("__run")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    summed = rows.withColumns({"d1": F.sum("documents").over(inside), "t1": F.sum("tokens").over(inside)}).join(runs, same)
    within, tokens = F.col("d0") + F.col("d1"), F.col("t0") + F.col("t1")
    longer = F.col("all_d") - within
    return summed.select(
        *by, "n_tokens", "documents", "tokens", within.alias("documents_within"), tokens.alias("tokens_within"),
        longer.alias("documents_longer"), (tokens + longer * F.col("n_tokens")).alias("tokens_truncated"),
        (within / F.col("all_d")).alias("quantile"))


def token_counts(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, by: list[str] = ()) -> DataFrame:
    """Encoded lengths of whole texts for every context limit.

    Null and empty texts have length 0 and are documents like others; repeated
    rows count each time; an empty table gives no row.
    """
    return context_table(stage(length_histogram(docs, text, vocabulary, by), "lengths"), by)
