"""Plain versions that the operators are compared with."""
from __future__ import annotations

import zlib

WHITE = b" \t\n\r\x0b\x0c"


def words(text):
    return (text or "").encode().lower().split()


def crc(doc_id) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def classes(n: int, pairs) -> list[int]:
    """Smallest place that links reach, by union and find."""
    up = list(range(n))

    def top(v):
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v
    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(v) for v in range(n)]


def infix_distance(pattern: str, text: str) -> int:
    """Edits between a pattern and the part of a text that is nearest to it."""
    before = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        row = [i + 1]
        for j, x in enumerate(text):
            row.append(min(before[j] + (x != c), before[j + 1] + 1, row[j] + 1))
        before = row
    return min(before)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, source="a"):
    """A documents table of (id, text) or (id, text, source)."""
    rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else source, None if r[1] is None else len(r[1])) for r in texts]
    return spark.createDataFrame(rows, DOCUMENTS)
