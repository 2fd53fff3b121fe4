"""Message templates and tokens."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S
from .base import WHITESPACE_RUN, col, squeeze


def mask_message(message) -> Column:
    """Replace variable parts by placeholders, rule by rule, and squeeze spaces."""
    out = F.coalesce(col(message), F.lit(""))
    for pattern, placeholder in S.MASK_RULES:
        out = F.regexp_replace(out, "(?U)" + pattern, placeholder)
    return squeeze(out)


def words(text) -> Column:
    """Lower-cased white-space separated words; empty ones removed."""
    return F.filter(F.split(F.lower(F.coalesce(col(text), F.lit(""))), WHITESPACE_RUN),
                    lambda w: w != "")


def message_tokens(message) -> Column:
    """Words of a message worth naming a cluster after."""
    bare = F.transform(words(message), lambda w: F.btrim(w, F.lit(S.TOKEN_EDGE_CHARS)))
    return F.filter(bare, lambda w: (F.length(w) > 2) & ~w.isin(S.STOPWORDS))


# Fixed value: a term of one word.
WORD = r"(?U)(\b\w\w+\b)"


def ngram_terms(text) -> Column:
    """Lower-cased terms of two or more word characters, and their pairs."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit(WORD), F.lit(1))

    # neighbours are read from two shifted copies, so a pair costs constant time
    def with_pairs(ts):
        pairs = F.zip_with(F.slice(ts, F.lit(1), F.greatest(F.size(ts) - 1, F.lit(0))),
                           F.slice(ts, F.lit(2), F.size(ts)),
                           lambda a, b: F.concat_ws(" ", a, b))
        return F.concat(ts, pairs)

    return F.transform(F.array(found), with_pairs)[0]
