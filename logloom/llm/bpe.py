"""Byte-pair encoding and decoding with a published word vocabulary, by merge rounds over many words at once."""
from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import ENCODE_CHARS

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
# Rank of a pair that no merge names.
NONE = np.int32(np.iinfo(np.int32).max)
# Words met so far are remembered with their ids up to this many ids; then memory starts anew.
KEPT_IDS = 200_000
# Words, or ids, that a step of a batch handles together, and texts that are read from Arrow at once.
STEP_WORDS = 1 << 15
STEP_TEXTS = 64
# Below this code point, letters, digits, lower case and composition are alike in all versions of Unicode in use.
STABLE = 0x530


class Vocabulary:
    """Tokens, merges and the front end of a vocabulary file.

    ``keys`` holds left * size + right of every pair that is ever merged, in
    order, ``rank`` its place in the list of merges. ``made[r]`` is the symbol
    that merge r makes. ``early[r]`` marks a merge whose new symbol may merge
    again before other places of the same merge come: of these only the first
    place is merged in a round.
    """

    def __init__(self, text: str):
        from tokenizers import Tokenizer
        told = json.loads(text)
        model = told["model"]
        if model["type"] != "BPE" or model.get("unk_token") or told.get("decoder") or model.get("byte_fallback"):
            raise ValueError("a byte-level BPE vocabulary without decoder is needed")
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.size = size = len(token_list(told))
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        pair = left * size + right
        order = np.argsort(pair, kind="stable")
        self.keys, self.rank = pair[order], order.astype(np.int32)
        used = np.full(size, len(merges), np.int64)
        np.minimum.at(used, left, np.arange(len(merges)))
        np.minimum.at(used, right, np.arange(len(merges)))
        self.early = used[self.made] <= np.arange(len(merges))
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int64)
        self.to_byte = {ord(c): b for b, c in enumerate(chars)}
        # the library's own front end, for texts beyond the stable code points
        front = Tokenizer.from_str(text)
        self.normalize, self.split = front.normalizer.normalize_str, front.pre_tokenizer.pre_tokenize_str
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.word = stable_words()
        self.stable = re.compile(f"[\\x00-{chr(STABLE - 1)}‐-‧‰-⁞₠-₿]*")

    def words(self, text: str) -> list[str]:
        """The words of a text in order; a special token is a word of its own."""
        if "<" not in text or not self.cut.search(text):
            return self._plain(text)
        found = []
        for i, part in enumerate(self.cut.split(text)):
            if i % 2:
                found.append(part)
            elif part:
                found += self._plain(part)
        return found

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.word.findall(text.lower())
        if self.stable.fullmatch(text):
            text = unicodedata.normalize("NFC", text)
            # a final sigma is lower-cased like any other
            return self.word.findall("".join(map(str.lower, text)) if "Σ" in text else text.lower())
        return [w.translate(self.to_byte).encode("latin-1").decode() for w, _ in self.split(self.normalize(text))]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, self.rank[place], NONE)


def token_list(told: dict) -> list[str | None]:
    """The token of every id, null where there is none."""
    named = {**told["model"]["vocab"], **{t["content"]: t["id"] for t in told["added_tokens"]}}
    tokens = [None] * (max(named.values()) + 1)
    for token, i in named.items():
        tokens[i] = token
    return tokens


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it is visible, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def stable_words() -> re.Pattern:
    """The published split pattern, with the letters and digits that texts below
    STABLE hold once composed and lower-cased spelled out."""
    kinds = {"L": "", "N": ""}
    for c in map(chr, range(0x3000)):
        if max(unicodedata.normalize("NFD", c)) < chr(STABLE):
            for x in {c, *c.lower()}:
                kind = unicodedata.category(x)[0]
                if kind in kinds:
                    kinds[kind] += x
    space = "\\t-\\r \\x85\\xa0\\u2028\\u2029\\u202f\\u205f"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{kinds['L']}]+|[{kinds['N']}]|[^{space}{kinds['L']}{kinds['N']}]+")


def merge_rounds(symbols: np.ndarray, lengths: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Merged symbols of words laid end to end, and how many each word has left.

    Every round finds the lowest rank in each word and merges all its places,
    from the left where they overlap. Live symbols are linked, so a round only
    looks up pairs beside a merge; finished words and merged symbols are left
    out once they are half of what is held.
    """
    words = np.repeat(np.arange(len(lengths)), lengths)
    final = symbols.copy()
    at = np.arange(len(symbols))
    while len(at):
        s, word = final[at], words[at]
        n = len(at)
        end = np.r_[word[1:] != word[:-1], True]
        after, before = np.arange(1, n + 1), np.arange(-1, n)
        rank = np.full(n, NONE)
        inner = np.flatnonzero(~end)
        rank[inner] = vocabulary.ranks(s[inner], s[inner + 1])
        starts = np.flatnonzero(np.r_[True, end[:-1]])
        wide = np.diff(np.r_[starts, n])
        live = n
        while True:
            low = np.minimum.reduceat(rank, starts)
            open_ = low < NONE
            left = wide[open_].sum()
            if left < n - left or live < n - live:
                break
            place = np.flatnonzero((rank == np.repeat(low, wide)) & (rank < NONE))
            early = vocabulary.early[rank[place]]
            if early.any():
                first = np.r_[True, word[place[1:]] != word[place[:-1]]]
                place = place[first | ~early]
            touching = after[place[:-1]] == place[1:]
            if touching.any():   # of a run of overlapping pairs every second one is merged
                number = np.arange(len(place))
                run = np.maximum.accumulate(np.where(np.r_[True, ~touching], number, 0))
                place = place[(number - run) % 2 == 0]
            gone = after[place]
            s[place] = vocabulary.made[rank[place]]
            s[gone] = -1
            rank[gone] = NONE
            end[place] = end[gone]
            after[place] = after[gone]
            before[after[gone]] = place
            live -= len(place)
            back = before[place]
            again = np.r_[place, back[back >= 0]]
            rank[again] = NONE
            again = again[~end[again]]
            rank[again] = vocabulary.ranks(s[again], s[after[again]])
        final[at] = s
        at = at[(s >= 0) & np.repeat(open_, wide)]
    kept = final >= 0
    return final[kept], np.bincount(words[kept], minlength=len(lengths))


class Encoder:
    """Ids of texts. Each new word is merged once, with all others that are new."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.place = {}
        self.ids = np.empty(0, np.int32)
        self.start = np.empty(0, np.int64)
        self.count = np.empty(0, np.int64)
        self._add(list(self.vocabulary.special), np.array(list(self.vocabulary.special.values())),
                  np.ones(len(self.vocabulary.special), np.int64))

    def _add(self, words: list[str], ids: np.ndarray, count: np.ndarray) -> None:
        self.place.update(zip(words, range(len(self.start), len(self.start) + len(words))))
        self.start = np.r_[self.start, len(self.ids) + np.cumsum(count) - count]
        self.ids = np.r_[self.ids, ids.astype(np.int32)]
        self.count = np.r_[self.count, count]

    def _learn(self, words: list[str]) -> None:
        coded = [w.encode() for w in words]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        raw = np.frombuffer(b"".join(coded), np.uint8)
        symbols = self.vocabulary.inner[raw]
        last = np.cumsum(lengths) - 1
        symbols[last] = self.vocabulary.last[raw[last]]
        self._add(words, *merge_rounds(symbols, lengths, self.vocabulary))

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row, and how many ids came before each word and in all."""
        if len(self.ids) > KEPT_IDS:
            self.forget()
        fresh = list(set(words).difference(self.place))
        if fresh:
            self._learn(fresh)
        row = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        count = self.count[row]
        total = np.r_[0, np.cumsum(count)]
        return self.ids[np.repeat(self.start[row] - total[:-1], count) + np.arange(total[-1])], total

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids end."""
        held, ends, parts, before, bounds = [], [], [], 0, []

        def close() -> None:
            nonlocal before
            ids, total = self._ids(held)
            parts.append(ids)
            bounds.append(before + total[np.array(ends, np.int64)])
            before += len(ids)
            held.clear()
            ends.clear()

        for text in texts:
            for piece in spaced_pieces(text or ""):
                held += self.vocabulary.words(piece)
                if len(held) > STEP_WORDS:
                    close()
            ends.append(len(held))
        close()
        return np.concatenate(parts), np.concatenate(bounds)


def spaced_pieces(text: str, most: int = ENCODE_CHARS) -> Iterator[str]:
    """A long text cut before spaces, where words end whatever follows."""
    start = 0
    while len(text) - start > most:
        k = text.find(" ", start + most)
        if k < 0:
            break
        yield text[start:k]
        start = k
    yield text[start:] if start else text


@lru_cache(maxsize=2)
def _read(text: str) -> Vocabulary:
    return Vocabulary(text)


def read_vocabulary(path: str = VOCABULARY) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(spark: SparkSession, text: Column, vocabulary: str) -> Column:
    """Ids (array<int>) of each text under a vocabulary file's content, which
    travels as a broadcast of fixed size. No special token is added; those
    written in a text are encoded as such. Null is like empty: no ids."""
    sent = spark.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(_read(sent.value))
        for texts in batches:
            found, ends = encoder.encode(t for k in range(0, len(texts), STEP_TEXTS) for t in texts.slice(k, STEP_TEXTS).to_pylist())
            yield pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(found, pa.int32()))
    return ids(text)


def decode(spark: SparkSession, ids: Column, vocabulary: str) -> Column:
    """Text of each array of ids: its tokens, special ones too, joined by one
    space, as a vocabulary without decoder says. Ids that are null or outside
    the vocabulary are left out; a null array is like an empty one."""
    sent = spark.sparkContext.broadcast(pa.array(token_list(json.loads(vocabulary)), pa.string()))

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arrays in batches:
            yield joined(arrays, sent.value)
    return text(ids)


def joined(arrays: pa.ListArray, tokens: pa.StringArray) -> pa.Array:
    """Tokens of each row, joined; a few rows at a time, and no more than
    STEP_WORDS ids but for a longer row."""
    ends = np.r_[0, np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(arrays), 0), np.int64))]
    out, first = [], 0
    while first < len(arrays):
        last = int(np.searchsorted(ends, ends[first] + STEP_WORDS, side="right")) - 1
        last = min(max(first + 1, last), first + STEP_TEXTS, len(arrays))
        out.append(_joined(arrays.slice(first, last - first), ends[first:last + 1] - ends[first], tokens))
        first = last
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def _joined(arrays: pa.ListArray, ends: np.ndarray, tokens: pa.StringArray) -> pa.Array:
    some = tokens.take(_inside(arrays.flatten(), len(tokens)))
    if some.null_count:   # ids that stand for nothing
        kept = np.asarray(some.is_valid())
        ends = np.r_[0, np.cumsum(kept)][ends]
        some = some.drop_null()
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), some), " ")


def _inside(ids: pa.Array, size: int) -> pa.Array:
    good = pc.and_(pc.greater_equal(ids, 0), pc.less(ids, size))
    return pc.if_else(good, ids, pa.scalar(None, ids.type))


def encode_texts(docs: DataFrame, text: str = "text", out: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """All rows and columns with the ids of their whole text.

    Null and empty texts have no ids. Repeated rows are encoded alike, an
    empty table stays empty, and a column called like ``out`` is replaced.
    """
    return docs.withColumn(out, encode(docs.sparkSession, F.col(text), read_vocabulary(vocabulary)))


def decode_ids(docs: DataFrame, ids: str = "ids", out: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """All rows and columns with the text that their ids stand for."""
    return docs.withColumn(out, decode(docs.sparkSession, F.col(ids), read_vocabulary(vocabulary)))


def bpe_digest(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per document: number of ids, and digests of its ids and of the text decoded from them."""
    coded = decode_ids(encode_texts(docs.select("doc_id", "text"), vocabulary=vocabulary), vocabulary=vocabulary)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
