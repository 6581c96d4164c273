"""Passages of test items inside documents: winnowed fingerprints, joined and extended.

Of every WINDOW successive K-word grams the one with the least hash is kept, on
both sides, so any shared run of K + WINDOW - 1 words has a fingerprint in
common. Fingerprints are joined; every document and item that meet are then
aligned around their hits, and the passage counts if enough of the item's words
stand there in their order.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.runtime import written

K, WINDOW, SHARE, GAP, REACH = 3, 2, 0.5, 0.1, 2
FILTER_BITS = 1 << 24

_TAG = re.compile(r"<[^<>]*>")
_JOINED = re.compile(r"(?<=[^\W\d_])-\s*\n\s*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Words of a text without case, punctuation and markup; words broken at a line's end are joined."""
    if not text:
        return []
    text = _TAG.sub(" ", text) if "<" in text else text
    text = _JOINED.sub("", text) if "-" in text else text
    return _WORD.findall((html.unescape(text) if "&" in text else text).lower())


class _Hashes(dict):
    """Word to 64-bit hash, computed once a word (within a bound on memory)."""

    LIMIT = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def winnow_all(texts: list[list[str]], k: int = K, window: int = WINDOW, hashes: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, position) of the kept grams of many texts, in order; a text shorter than a gram has none.

    A text with fewer grams than a window keeps its least one.
    """
    hashes = _Hashes() if hashes is None else hashes
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    each = np.fromiter((hashes[w] for t in texts for w in t), np.uint64, int(sizes.sum()))
    n = len(each) - k + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    grams = np.zeros(n, np.uint64)
    for i in range(k):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + each[i : i + n]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    number = np.repeat(np.arange(len(texts)), sizes)
    of = np.where(number[:n] == number[k - 1 :], number[:n], -1)
    least, shift, inside = grams.copy(), np.zeros(n, np.int64), of >= 0
    for o in range(1, window):
        same = np.zeros(n, bool)
        same[: n - o] = of[: n - o] == of[o:]
        lower = np.zeros(n, bool)
        lower[: n - o] = same[: n - o] & (grams[o:] < least[: n - o])
        least[: n - o] = np.where(lower[: n - o], grams[o:], least[: n - o])
        shift[lower] = o
        inside &= same
    first = (of >= 0) & np.append(True, of[1:] != of[:-1])
    keep = np.unique((np.arange(n) + shift)[inside | first])
    starts = np.cumsum(sizes) - sizes
    return of[keep], grams[keep].view(np.int64), keep - starts[of[keep]]


def winnow(words: list[str], k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of one text."""
    return winnow_all([words], k, window)[1:]


def _printer(key: str, known: np.ndarray | None):
    def run(batches):
        hashes = _Hashes()
        for pdf in batches:
            texts = [words_of(t) for t in pdf["text"]]
            number, prints, at = winnow_all(texts, hashes=hashes)
            if known is not None:
                hit = np.ones(len(prints), bool)
                for shift in (0, 24):
                    bit = (prints.view(np.uint64) >> np.uint64(shift)) & np.uint64(FILTER_BITS - 1)
                    hit &= (known[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                number, prints, at = number[hit], prints[hit], at[hit]
            those, start = np.unique(number, return_index=True)
            end = np.append(start[1:], len(number))
            keys = pdf[key].to_list()
            out = [(keys[i], " ".join(texts[i]), prints[a:b].tolist(), at[a:b].tolist()) for i, a, b in zip(those, start, end)]
            yield pd.DataFrame(out, columns=[key, "words", "prints", "at"])

    return run


def print_filter(prints: DataFrame) -> np.ndarray:
    """Bloom filter of fingerprints (print): FILTER_BITS bits in 64-bit words, two bits a fingerprint.

    Its size is the same whatever the number of fingerprints. It never loses
    one; the fuller it is, the more others pass, which the join then drops.
    """
    bits = F.array(*[F.shiftrightunsigned("print", s).bitwiseAND(F.lit(FILTER_BITS - 1).cast("long")) for s in (0, 24)])
    words = prints.select(F.explode(bits).alias("bit")).select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("set"))
    rows = words.groupBy("word").agg(F.bit_or("set").alias("set")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[rows["word"].to_numpy(np.int64)] = rows["set"].to_numpy(np.int64).view(np.uint64)
    return out


def fingerprints(df: DataFrame, key: str, known: np.ndarray | None = None) -> DataFrame:
    """(key, words, prints, at) of each text with a fingerprint (that passes the filter ``known``, if given)."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "text").mapInPandas(_printer(key, known), f"{key} {kind}, words string, prints array<long>, at array<long>")


def matched_words(doc: list[str], item: list[str], hits: list[int], least: int = 1) -> int:
    """Most words of the item that one passage of the document has in their order.

    Hits closer than REACH item lengths are one passage, and it may reach as far
    beyond them. Matches are chained in order, each skipped word costing GAP, so
    chance matches far from the passage add nothing. Passages whose words, in
    any order, can't give ``least`` matches are left out; 0 if all are.
    """
    n, best = len(item), 0
    reach = REACH * n
    places: dict[str, list[int]] = {}
    for j, w in enumerate(item):
        places.setdefault(w, []).append(j)
    need = Counter(item)
    hits = sorted(hits)
    start = 0
    for i in range(1, len(hits) + 1):
        if i < len(hits) and hits[i] - hits[i - 1] <= reach:
            continue
        low, high = max(0, hits[start] - reach), min(len(doc), hits[i - 1] + reach)
        start = i
        passage = doc[low:high]
        have = Counter(w for w in passage if w in need)
        if sum(min(c, need[w]) for w, c in have.items()) < max(best + 1, least):
            continue
        x = np.array([p for p, w in enumerate(passage) for _ in places.get(w, ())])
        y = np.array([j for w in passage for j in places.get(w, ())])
        score, count = np.ones(len(x)), np.ones(len(x), dtype=int)
        for m in range(1, len(x)):
            before = (x[:m] < x[m]) & (y[:m] < y[m])
            if before.any():
                value = np.where(before, score[:m] - GAP * (x[m] - x[:m] + y[m] - y[:m] - 2), -1.0)
                b = int(value.argmax())
                if value[b] > 0:
                    score[m], count[m] = value[b] + 1, count[b] + 1
        best = max(best, int(count[score.argmax()]))
    return best


def _aligner(share: float):
    return lambda batches: _aligned(batches, share)


def _aligned(batches, share: float):
    for pdf in batches:
        found = []
        for doc_words, item_words, hits in zip(pdf["words"], pdf["item_words"], pdf["hits"]):
            doc, item = doc_words.split(" "), item_words.split(" ")
            need, have = Counter(item), Counter(doc)
            if sum(min(c, have[w]) for w, c in need.items()) < share * len(item):
                found.append(0)
            else:
                found.append(matched_words(doc, item, list(hits), math.ceil(share * len(item))))
        pdf = pdf.assign(matched=found, n_words=[w.count(" ") + 1 for w in pdf["item_words"]])
        yield pdf[["doc_key", "item_key", "matched", "n_words"]]


def leaks(documents: DataFrame, doc_key: str, items: DataFrame, item_key: str, share: float = SHARE) -> DataFrame:
    """(doc_key, item_key, matched, n_words) where a passage of the document holds ``share`` of the item's words.

    Null and empty texts hold nothing and leak nowhere; items of fewer than K
    words can't be found. Documents drop fingerprints that a filter of fixed size
    over the items' fingerprints excludes; documents without any other end in
    the first pass. A fingerprint that many documents share is cut into cells
    by document, and meets each item once.
    """
    of_items = written(fingerprints(items, item_key), "item-prints")
    bag = of_items.select(F.col(item_key).alias("item_key"), F.col("words").alias("item_words"), F.explode("prints").alias("print"))
    of_docs = fingerprints(documents, doc_key, print_filter(bag))
    of_docs = written(of_docs.select(F.col(doc_key).alias("doc_key"), "words", "prints", "at"), "doc-prints")
    spread = of_docs.select("doc_key", F.explode(F.arrays_zip("prints", "at")).alias("p")).select("doc_key", F.col("p.prints").alias("print"), F.col("p.at").alias("at"))
    cells = 16
    owned = bag.select("item_key", "print").distinct().withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    met = spread.withColumn("cell", F.pmod(F.xxhash64("doc_key"), F.lit(cells)).cast("int")).join(owned, ["print", "cell"])
    hits = met.groupBy("doc_key", "item_key").agg(F.collect_set("at").alias("hits"))
    pairs = hits.join(of_docs.select("doc_key", "words"), "doc_key").join(bag.select("item_key", "item_words").distinct(), "item_key")
    kinds = f"doc_key {documents.schema[doc_key].dataType.simpleString()}, item_key {items.schema[item_key].dataType.simpleString()}"
    found = pairs.select("doc_key", "item_key", "words", "item_words", "hits").mapInPandas(_aligner(share), f"{kinds}, matched int, n_words int")
    found = found.where(F.col("matched") >= share * F.col("n_words"))
    return found.select(F.col("doc_key").alias(doc_key), F.col("item_key").alias(item_key), "matched", "n_words")
