"""Evaluation texts leaking into training text."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.session import settle, small_side

_INLINE = re.compile(r"</?(?:a|b|code|em|font|i|mark|s|small|span|strong|sub|sup|tt|u)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_MARK = re.compile("[̀-ͯ҃-҉֑-ׇؐ-ًؚ-ٟ᪰-᫿᷀-᷿⃐-⃿︠-︯]+")
_HAN = "㐀-䶿一-鿿豈-﫿"
_HAS_HAN = re.compile(f"[{_HAN}]")
#: What numbers the lines or points of a layout: `1)`, `(1)`, `[1]` or `a)` standing by itself, and numbers that begin successive lines.
_POINT = re.compile(r"(?<!\S)[(\[]?(?:\d{1,6}|[A-Za-z])[)\]](?=\s)")
_LINE_NUMBER = re.compile(r"^[ \t>|*+-]*(\d{1,6})([.:|–-]?)[ \t]+(?=\S)", re.M)
_HAS_LINE_NUMBER = re.compile(r"\n[ \t>|*+-]*\d")
_WORD = re.compile(r"[^\W_]+")
_WORD_HAN = re.compile(rf"[{_HAN}]|[^\W_{_HAN}]+")
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the filter of test fingerprints that every task gets: its size never depends on the data.
FILTER_BITS = 1 << 22
#: Candidate documents whose ids are broadcast, if counted to be no more, to fetch their texts.
MOST_KEYS = 500_000


def _without_point(m: re.Match) -> str:
    """Nothing for the mark of a point; a bracket that was opened by earlier words closes those, and stays."""
    text, at = m.string, m.start()
    opened = m.group()[0] in "([" or text.rfind("(", max(0, at - 200), at) <= text.rfind(")", max(0, at - 200), at)
    return "" if opened else m.group()


def _without_line_numbers(text: str) -> str:
    """Without numbers that count up from line to line; the first of them may stand within the line before, after a space."""
    found = list(_LINE_NUMBER.finditer(text))
    cuts: list[tuple[int, int]] = []
    for i, m in enumerate(found):
        n, mark = int(m[1]), m[2]
        after = i + 1 < len(found) and found[i + 1][2] == mark and int(found[i + 1][1]) == n + 1
        before = i > 0 and found[i - 1][2] == mark and int(found[i - 1][1]) == n - 1
        first = -1
        if not before and mark:
            line = text.rfind("\n", 0, max(0, m.start() - 1)) + 1
            first = text.rfind(f" {n - 1}{mark} ", line, m.start())
        if first >= 0:
            cuts.append((first, first + len(f" {n - 1}{mark}")))
        if after or before or first >= 0:
            cuts.append(m.span())
    out, at = [], 0
    for a, b in sorted(cuts):
        out.append(text[at:a])
        at = b
    return " ".join([*out, text[at:]]) if cuts else text


def words(text: str | None) -> list[str]:
    """A text's words, the same whatever the case, accents, punctuation, markup, invisible characters and line layout.

    An ideograph is a word; what numbers lines or points is none.
    """
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if ")" in text or "]" in text:
        text = _POINT.sub(_without_point, text)
    if _HAS_LINE_NUMBER.search(text):
        text = _without_line_numbers(text)
    if text.isascii():
        return _WORD.findall(text.lower())
    text = _MARK.sub("", unicodedata.normalize("NFKD", _INVISIBLE.sub("", text).casefold()))
    return (_WORD_HAN if _HAS_HAN.search(text) else _WORD).findall(text)


class _Hasher:
    """64-bit hashes of words, those met being kept up to a bound."""

    KEEP = 1_000_000

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def flat(self, texts: list[list[str]], gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The hashes of all words with gap places after each text, the text of each place, and which are words."""
        if len(self.known) > self.KEEP:
            self.known.clear()
        known, get = self.known, self.known.get
        out: list[int] = []
        sizes = []
        for t in texts:
            for w in t:
                h = get(w)
                if h is None:
                    h = known[w] = xxhash.xxh64_intdigest(w)
                out.append(h)
            out.extend([0] * gap)
            sizes.append(len(t))
        n = np.array(sizes, dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), n + gap)
        start = np.cumsum(n + gap) - (n + gap)
        is_word = np.arange(len(owner)) - start[owner] < n[owner]
        return np.array(out, dtype=np.uint64), owner, is_word


def grams(hashes: np.ndarray, is_word: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each place on; all ones where the text ends before."""
    n = len(hashes)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out[: n - i] = out[: n - i] * _BASE + hashes[i:]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    valid = np.zeros(n, dtype=bool)
    if n >= k:
        valid[: n - k + 1] = is_word[k - 1 :] if k > 1 else is_word
    valid &= is_word
    out[~valid] = _NONE
    return out


def winnowed(gram: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest gram of each window (the rightmost of equals)."""
    padded = np.concatenate([gram, np.full(window - 1, _NONE)]) if window > 1 else gram
    if not len(gram):
        return np.zeros(0, dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(padded[::-1], window)
    last = len(padded) - 1 - (np.arange(len(view)) + view.argmin(axis=1))
    places = np.unique(last)
    places = places[places < len(gram)]
    return places[gram[places] != _NONE]


def _batches(pdf: pd.DataFrame, texts: str, limit: int = 400_000) -> Iterator[tuple[pd.DataFrame, list[list[str]]]]:
    """Slices of a batch with about limit words each: long texts never pile up."""
    start, size, now = 0, 0, []
    for i, t in enumerate(pdf[texts].tolist()):
        now.append(words(t))
        size += len(now[-1])
        if size >= limit:
            yield pdf.iloc[start : i + 1], now
            start, size, now = i + 1, 0, []
    if now:
        yield pdf.iloc[start:], now


def fingerprints(texts: DataFrame, key: str, k: int, window: int, keep: np.ndarray | None = None) -> DataFrame:
    """(key, fp, pos) of the winnowed k-grams of whole texts, if keep is given only those whose bit is set in it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = _Hasher()
        for pdf in batches:
            for part, texts_ in _batches(pdf, "text"):
                h, owner, is_word = hasher.flat(texts_, k)
                g = grams(h, is_word, k)
                at = winnowed(g, window)
                if keep is not None:
                    bit = g[at] & np.uint64(len(keep) * 8 - 1)
                    at = at[(keep[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                first = np.searchsorted(owner, owner[at])
                yield pd.DataFrame({key: part[key].to_numpy()[owner[at]], "fp": g[at].view(np.int64), "pos": (at - first).astype(np.int32)})

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, "text").where(F.col("text").isNotNull() & F.col(key).isNotNull()).mapInPandas(run, f"{key} {kind}, fp long, pos int")


def _filter(fps: DataFrame) -> np.ndarray:
    """The filter's bits, set for each fingerprint; at most FILTER_BITS / 8 bytes reach the driver."""
    slots = fps.select(F.col("fp").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("slot"))
    bits = slots.selectExpr("cast(shiftright(slot, 3) as int) as byte", "shiftleft(1, cast(slot & 7 as int)) as bit").groupBy("byte").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    out[bits["byte"].to_numpy()] = bits["bits"].to_numpy().astype(np.uint8)
    return out


def least_hits(run: int, least: int, k: int, window: int) -> int:
    """How many fingerprints a text must share with an item at least, to share `least` words in runs of `run` or more."""
    best: dict[int, int] = {0: 0}
    for n in range(1, least + run):
        options = [best[n - r] + (r - k + 1) // window for r in range(run, n + 1) if n - r in best]
        if options:
            best[n] = min(options)
    return max(1, min(v for n, v in best.items() if n >= least))


def leaks(items: DataFrame, documents: DataFrame, *, run: int = 8, least_words: int = 20, share: float = 0.4, k: int = 7) -> DataFrame:
    """Which documents hold passages of which items.

    items: (item_id, text); documents: (doc_id, text). Result: (item_id, doc_id, words, of_words): passages
    of `run` or more successive words of the item that stand in the document cover `words` of the item's
    `of_words` words, which are at least least_words and at least the given share of them.
    Defined cases: null and empty texts and null ids hold nothing; texts without enough words never match;
    items with the same id are taken one by one and reported once with the best cover; so are repeated
    documents; equal k-grams in one window count once, the last; empty tables yield no rows. Other columns
    are not read.

    Method: winnowing. Of each window of run - k + 1 successive k-grams the one with the smallest hash is a
    fingerprint, so each shared run of `run` words shares at least one, at either end. Documents' fingerprints
    pass a filter of fixed size, then meet the items' in a join; pairs that share fewer fingerprints than
    any leak must are left out; the rest is extended word by word over the whole texts.
    Scale: texts are read twice; the second time those without a candidate pair are left out before the
    shuffle, by a broadcast of the candidates' ids where they are counted to be at most MOST_KEYS (beyond
    that the ids meet in a shuffled join, for which Spark builds a Bloom filter by itself on large inputs).
    The filter of fingerprints is 512 KB whatever the items' number; beyond what it can tell, the join does. Phrases common to many
    documents and items only make more pairs, which are counted before any text is fetched.
    """
    window = run - k + 1
    items = items.select("item_id", "text")
    item_fps = settle(fingerprints(items, "item_id", k, window).select("item_id", "fp", "pos").distinct())
    doc_fps = fingerprints(documents, "doc_id", k, window, _filter(item_fps)).select("doc_id", "fp").distinct()
    pairs = (
        doc_fps.join(item_fps, "fp")
        .groupBy("item_id", "doc_id")
        .agg(F.countDistinct("pos").alias("hits"))
        .where(F.col("hits") >= least_hits(run, least_words, k, window))
        .select("item_id", "doc_id")
    )
    pairs = settle(pairs)
    wanted = small_side(pairs.select("doc_id").distinct(), MOST_KEYS)
    held = documents.select("doc_id", F.col("text").alias("doc_text")).where("doc_text is not null").join(wanted, "doc_id", "left_semi")
    texts = held.join(pairs.join(items.where("text is not null"), "item_id"), "doc_id")

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = _Hasher()
        for pdf in batches:
            rows, last, have = [], None, None
            parsed: dict[str, np.ndarray] = {}
            for item_id, doc_id, text, doc_text in zip(pdf["item_id"].tolist(), pdf["doc_id"].tolist(), pdf["text"].tolist(), pdf["doc_text"].tolist()):
                if doc_text != last:
                    h, _, is_word = hasher.flat([words(doc_text)], 0)
                    have, last = np.unique(grams(h, is_word, run)), doc_text
                if text not in parsed:
                    h, _, is_word = hasher.flat([words(text)], 0)
                    parsed[text] = grams(h, is_word, run)
                g = parsed[text]
                n = len(g)
                hit = np.flatnonzero((g != _NONE) & np.isin(g, have))
                cover = np.zeros(n + 1, dtype=np.int64)
                np.add.at(cover, hit, 1)
                np.add.at(cover, np.minimum(hit + run, n), -1)
                covered = int((np.cumsum(cover[:n]) > 0).sum())
                if covered >= least_words and covered >= share * n:
                    rows.append((item_id, doc_id, covered, n))
            yield pd.DataFrame(rows, columns=["item_id", "doc_id", "words", "of_words"])

    kinds = [x.schema[c].dataType.simpleString() for x, c in ((items, "item_id"), (documents, "doc_id"))]
    found = texts.select("item_id", "doc_id", "text", "doc_text").mapInPandas(extend, f"item_id {kinds[0]}, doc_id {kinds[1]}, words long, of_words long")
    return found.groupBy("item_id", "doc_id").agg(F.max(F.struct("words", "of_words")).alias("m")).select("item_id", "doc_id", "m.words", "m.of_words")
