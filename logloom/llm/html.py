"""Main text of web pages by tag-path ratios."""
from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|title|select|button|object|canvas|math)\b"
    r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)", re.S | re.I)
ATTR = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
TITLE = re.compile(r"/h1(?:[./]|$)")

BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre
section summary table tbody tfoot thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CELLS = frozenset(("td", "th", "br", "img", "wbr", "hr"))
# An opening tag that ends an open one of the same kind, and where the search for it stops.
SELF_ENDING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}
ENDS_P = BLOCKS - {"body", "html", "caption", "legend", "option", "tbody", "tfoot", "thead", "tr"}
FENCES = frozenset("article aside blockquote body details div fieldset footer form header main nav ol section "
                   "table td th ul dl html".split())
# Elements that can be the article as a whole.
CONTAINERS = frozenset("article blockquote body center div html main section table tbody td".split())
OUTSIDE = frozenset("aside dialog footer form head header menu nav".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note "
                  "search status toolbar".split())
LABELS = frozenset("""ad ads advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs
comment comments commentary commentlist consent cookie cookies disclaimer disqus footer form gdpr header login
menu modal nav navbar navigation newsletter notice notices notification outbrain paywall popup promo promoted
promotion recommended related replies reply search share sharing sidebar signup skip social sponsor sponsored
subscribe subscription taboola teaser toolbar widget widgets""".split())
PUNCTUATION = frozenset(".,;:!?…。，、；：！？¿¡")

# A path is content if its fused, smoothed ratio reaches this share of the page's mean plus deviation.
STRENGTH = 0.5
# A label puts no part outside that holds this share of the page's text.
HELD = 0.5
# Words before these say what a part has or lacks, not what it is.
MODIFIERS = frozenset(("has", "is", "no", "not", "with", "without"))


def _named(value: str) -> bool:
    """Whether a class or id names a part outside the article; what follows a modifier names nothing."""
    for name in value.split():
        words = [w.lower() for w in WORDS.findall(name)]
        if any(w in LABELS for w in words) and not MODIFIERS & set(words[:-1]):
            return True
    return False


def _labels(attrs: str) -> tuple[bool, bool, str]:
    """Whether attributes hide a part, whether they label it as outside the article, and the first class."""
    hidden, out, kind = False, False, ""
    for m in ATTR.finditer(attrs):
        name = m.group(1).lower()
        value = m.group(2) or m.group(3) or m.group(4) or ""
        if name in ("class", "id"):
            if name == "class":
                kind = value.split()[0] if value.split() else ""
            out = out or _named(value)
        elif name == "role":
            out = out or value.lower() in ROLES
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            hidden = True
        elif name == "style":
            hidden = hidden or "display:none" in value.replace(" ", "").lower()
    return hidden, out, kind


def blocks_of(page: str) -> list[tuple[str, list[tuple[int, str]], str, list[int] | None]]:
    """(text, containers around it, tag path, labelled parts around it) of every block of text in page order.

    Labelled parts are numbers of elements whose class, id or role puts them outside the article, None
    where a block is hidden or in an element that is no article by its name. A container is (number in page order, name). Tags that HTML lets end by themselves
    do so; closing tags without an opening one are passed over.
    """
    stack: list[tuple[str, int, str, list[int] | None]] = []  # name, number, path, labelled parts
    found, parts, number, at, owner = [], [], 0, 0, None

    def flush():
        nonlocal parts, owner
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                around = owner
                found.append((text, [(e[1], e[0]) for e in around if e[0] in CONTAINERS],
                              around[-1][2] if around else "",
                              around[-1][3] if around else []))
        parts, owner = [], None

    def put(text):
        nonlocal owner
        if owner is None and not text.isspace():
            owner = list(stack)
        parts.append(text)

    def pop_to(k):
        if any(e[0] in BLOCKS for e in stack[k:]):
            flush()
        del stack[k:]

    for m in PIECE.finditer(page):
        if m.start() > at:
            put(page[at:m.start()])
        at = m.end()
        name = m.group("name")
        if name is None:
            continue
        name = name.lower()
        if m.group("close"):
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if k is not None:
                pop_to(k)
            if name in BLOCKS:
                flush()
            elif name in CELLS:
                parts.append(" ")
            continue
        if name in CELLS:
            parts.append(" ")
        if name in BLOCKS:
            flush()
        ends = SELF_ENDING.get(name, set()) | ({"p"} if name in ENDS_P else set())
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    pop_to(k)
                    break
                if stack[k][0] in FENCES:
                    break
        if name in VOID or m.group("attrs").rstrip().endswith("/"):
            continue
        number += 1
        up = stack[-1] if stack else ("", 0, "", [])
        hidden, marked, kind = _labels(m.group("attrs")) if m.group("attrs").strip() else (False, False, "")
        inside = any(e[0] == "article" for e in stack)
        whole = name in ("html", "body")
        labelled = up[3]
        if (name in OUTSIDE and not (name == "header" and inside)) or (hidden and not whole):
            labelled = None
        elif marked and not whole and labelled is not None:
            labelled = [*labelled, number]
        stack.append((name, number, f"{up[2]}/{name}" + (f".{kind}" if kind else ""), labelled))
    if at < len(page):
        put(page[at:])
    flush()
    return found


def path_scores(blocks) -> dict[str, float]:
    """Fused, smoothed ratio of every tag path.

    Text and punctuation ratios are a path's characters and punctuation marks
    per block. Over the blocks in page order both are smoothed with their
    neighbours, and the two are multiplied; a path has the mean of its blocks.
    """
    chars, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for text, _, path, _ in blocks:
        chars[path] += len(text)
        marks[path] += sum(c in PUNCTUATION for c in text)
        count[path] += 1
    ratio = [chars[b[2]] / count[b[2]] for b in blocks]
    punct = [(1 + marks[b[2]]) / count[b[2]] for b in blocks]

    def smooth(x):
        n = len(x)
        return [(x[max(i - 1, 0)] + 2 * x[i] + x[min(i + 1, n - 1)]) / 4 for i in range(n)]

    fused = [math.sqrt(a) * math.log1p(b) for a, b in zip(smooth(ratio), smooth(punct))]
    total = defaultdict(float)
    for b, f in zip(blocks, fused):
        total[b[2]] += f
    return {p: total[p] / count[p] for p in total}


def main_blocks(page: str) -> list[str]:
    """The article's blocks in page order.

    Hidden blocks and those in elements that are menu, header, footer, form or
    the like by their name are out. So are parts that label themselves so,
    unless a part holds most of the text that is left. Of the other blocks, those on paths
    whose score reaches the threshold are content nodes. The lowest container
    that holds all content nodes is the article; all blocks in it that are not
    out belong to it, short ones too. Where article elements, or else main
    elements, hold most of the text of the content nodes, their blocks and the
    content nodes elsewhere are the article. If no h1 is in it, the nearest one
    before it is its heading.
    """
    blocks = [b for b in blocks_of(page) if b[3] is not None]
    size = defaultdict(int)
    for text, _, _, labelled in blocks:
        for number in labelled:
            size[number] += len(text)
    most = HELD * sum(len(b[0]) for b in blocks)
    blocks = [b for b in blocks if all(size[number] > most for number in b[3])]
    if not blocks:
        return []
    scores = path_scores(blocks)
    values = [scores[b[2]] for b in blocks]
    mean = sum(values) / len(values)
    spread = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    limit = STRENGTH * (mean + spread)
    content = [b for b in blocks if scores[b[2]] >= limit] or blocks
    taken = None
    for name in ("article", "main"):
        own = sum(len(b[0]) for b in content if any(e[1] == name for e in b[1]))
        if own > HELD * sum(len(b[0]) for b in content):
            taken = [i for i, b in enumerate(blocks) if any(e[1] == name for e in b[1]) or scores[b[2]] >= limit]
            break
    if taken is None:
        common = set(content[0][1]).intersection(*[b[1] for b in content])
        taken = [i for i, b in enumerate(blocks) if not common or max(common) in b[1]]
    titles = [i for i, b in enumerate(blocks) if TITLE.search(b[2])]
    before = [i for i in titles if i < taken[0]]
    if before and not set(titles) & set(taken):
        taken.insert(0, before[-1])
    return [blocks[i][0] for i in taken]


def main_text(page: str | None) -> str:
    return "\n\n".join(main_blocks(page)) if page else ""


def extract(html: Column) -> Column:
    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p) for p in pages], dtype="object")
    return texts(html)


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``, the code points of it.

    A null or empty page has an empty text. Pages are read whole, row by row,
    so repeated rows stay; input columns named like the results are replaced.
    """
    return (pages.withColumn("text", extract(F.col(html)))
            .withColumn("n_chars", F.char_length("text").cast("long")))
