"""The best right row of each left row by day, amount and name, cell by cell.

A cell is a block of days and a band of amounts. Every left row belongs to one
cell; right rows are copied to the cells from which they can be reached. Within
a cell no left row is held against all right rows: in the order of (day,
amount) only the nearest amounts above and below can be the best among equal
names and among names that count nothing. Names that are merely alike are
looked for where a pair could still beat what was found, and upper bounds of
their ratio (common letters, then the longest common subsequence) decide
which are compared.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIRS, WORD, SYMBOLS, KNOWN = 1 << 18, 64, 32, 1 << 20
_known: dict[tuple[str, str], float] = {}


def _steps(sorted_keys: np.ndarray, groups: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First position of the next value at or above ``at`` in its group, and of the next one below; -1 for none. Keys are group * n + value."""
    if not len(sorted_keys):
        return np.full(len(at), -1), np.full(len(at), -1)
    above = np.searchsorted(sorted_keys, groups * n + at)
    key = sorted_keys[np.minimum(above, len(sorted_keys) - 1)]
    below = sorted_keys[np.maximum(above - 1, 0)]
    first = np.searchsorted(sorted_keys, below)
    return np.where((above < len(sorted_keys)) & (key // n == groups), above, -1), np.where((above > 0) & (below // n == groups), first, -1)


class _Names:
    """Upper bounds of the ratio of names, given by their numbers; names of more than ``WORD`` letters only have the bound by letters."""

    def __init__(self, names: list[str]):
        self.names = names
        self.size = np.fromiter(map(len, names), np.int64, len(names))
        symbols, letters, often = np.unique(np.frombuffer("".join(names).encode("utf-32-le"), np.uint32), return_inverse=True, return_counts=True)
        rank = np.empty(len(symbols), np.int64)
        rank[np.argsort(-often, kind="stable")] = np.arange(len(symbols))
        letters = np.minimum(rank[letters], SYMBOLS - 1)  # rare letters count as one: bounds stay upper bounds
        whose = np.repeat(np.arange(len(names)), self.size)
        place = np.arange(len(whose)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        counts = np.bincount(whose * SYMBOLS + letters, minlength=len(names) * SYMBOLS)
        self.counts = counts.reshape(-1, SYMBOLS).astype(np.uint8 if self.size.max(initial=0) < 256 else np.int32)
        inside = place < WORD
        self.text = np.full((len(names), WORD), SYMBOLS, np.uint8)
        self.text[whose[inside], place[inside]] = letters[inside]
        self.masks = np.zeros((len(names), SYMBOLS + 1), np.uint64)
        np.bitwise_or.at(self.masks, (whose[inside], letters[inside]), np.uint64(1) << place[inside].astype(np.uint64))

    def by_letters(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return 2.0 * np.minimum(self.counts[x], self.counts[y]).sum(1, dtype=np.int32) / (self.size[x] + self.size[y])

    def by_order(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.ones(len(x))
        short = np.flatnonzero((self.size[x] <= WORD) & (self.size[y] <= WORD))
        for part in np.array_split(short, len(short) // (PAIRS // 8) + 1):
            px, py = x[part], y[part]
            v = np.full(len(part), ~np.uint64(0))
            for i in range(int(self.size[py].max(initial=0))):
                u = v & self.masks[px, self.text[py, i]]
                v = (v + u) | (v - u)
            out[part] = 2.0 * np.bitwise_count(~v) / (self.size[px] + self.size[py])
        return out

    def ratios(self, x: np.ndarray, y: np.ndarray, ratio: Callable[[str, str], float]) -> np.ndarray:
        if len(_known) > KNOWN:
            _known.clear()
        pairs = [(self.names[a], self.names[b]) for a, b in zip(x, y)]
        return np.array([_known[k] if k in _known else _known.setdefault(k, ratio(*k)) for k in pairs], float)


def _unique_rows(*columns: np.ndarray) -> np.ndarray:
    """Positions, in the order of the columns, of the first row of each run of equal values; the last column only orders."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns[:-1]], axis=0)
    return order[new]


def _cell(left: pd.DataFrame, right: pd.DataFrame, days: int, tolerance: float, weights: tuple, ratio: Callable | None, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Per left row the position of its best right row (-1 for none) and the score."""
    best_of, score_of = np.full(len(left), -1), np.zeros(len(left))
    usable = np.flatnonzero(np.isfinite(left["left_amount"].to_numpy(float)))
    if not len(usable) or not len(right):
        return best_of, score_of
    left = left.iloc[usable]
    names, spelt = pd.factorize(pd.concat([left["left_name"], right["right_name"]], ignore_index=True))
    values, amounts = np.unique(np.concatenate([left["left_amount"].to_numpy(float), right["right_amount"].to_numpy(float)]), return_inverse=True)
    when = np.concatenate([left["left_day"].to_numpy(np.int64), right["right_day"].to_numpy(np.int64)])
    when -= when.min() - days
    ranks, n, m = pd.factorize(right["right_rank"], sort=True)[0], len(values), len(spelt) + 1
    k = len(left)
    # Equal left rows are asked once, of equal right rows only the first by rank can win.
    _, one, back = np.unique((when[:k] * n + amounts[:k]) * m + names[:k] + 1, return_index=True, return_inverse=True)
    ld, la, ln = when[one], amounts[one], names[one]
    kept = _unique_rows(when[k:], amounts[k:], names[k:], ranks)
    kept = kept[np.lexsort((ranks[kept], amounts[k:][kept], when[k:][kept]))]
    rd, ra, rn, rr = when[k:][kept], amounts[k:][kept], names[k:][kept], ranks[kept]
    best, score = np.full(len(one), -1), np.full(len(one), -np.inf)

    def base(i, j):
        near = weights[0] * np.maximum(0.0, 1 - np.abs(ld[i] - rd[j]) / float(days))
        return near + weights[1] * np.maximum(0.0, 1 - np.abs(values[la[i]] - values[ra[j]]) / tolerance)

    def offer(i, j, alike):
        """Right rows j, one for each of the left rows i, with the similarity of their names."""
        s = base(i, j) + weights[2] * alike
        wins = (s > score[i]) | ((s == score[i]) & (rr[j] < rr[best[i]]))
        wins &= np.abs(values[la[i]] - values[ra[j]]) < tolerance
        best[i[wins]], score[i[wins]] = j[wins], s[wins]

    empty = np.append(np.array([x == "" for x in spelt], bool) & (ratio is not None), True)  # the last stands for null, as -1
    apart = sorted(range(1 - days, days), key=abs)
    by_day = rd * n + ra
    named = np.flatnonzero(~empty[rn])
    named = named[np.lexsort((rr[named], ra[named], rn[named], rd[named]))]
    by_name = (rd[named] * m + rn[named]) * n + ra[named]
    for o in apart:
        for j in _steps(by_day, ld + o, la, n):
            i = np.flatnonzero(j >= 0)
            offer(i, j[i], ((ln[i] == rn[j[i]]) & ~empty[ln[i]]).astype(float))
        asked = np.flatnonzero(~empty[ln])
        for j in _steps(by_name, (ld[asked] + o) * m + ln[asked], la[asked], n):
            offer(asked[j >= 0], named[j[j >= 0]], 1.0)
    if ratio is not None:
        bounds = _Names([str(x) for x in spelt])
        asked = np.flatnonzero(~empty[ln])
        for o in apart:
            # Farther amounts can't win even if the names were equal.
            spare = weights[0] * max(0.0, 1 - abs(o) / days) + weights[1] + weights[2] + 1e-9 - score[asked]
            reach = np.where(spare < 0, -1.0, np.minimum(tolerance, tolerance * spare / weights[1]) if weights[1] > 0 else tolerance)
            i = asked[reach >= 0]
            amount, reach = values[la[i]], reach[reach >= 0] * (1 + 1e-9)
            low = np.searchsorted(by_day, (ld[i] + o) * n + np.searchsorted(values, amount - reach))
            many = np.maximum(np.searchsorted(by_day, (ld[i] + o) * n + np.searchsorted(values, amount + reach, "right")) - low, 0)
            ends = np.cumsum(many)
            cuts = np.searchsorted(ends, np.arange(PAIRS, ends[-1] if len(ends) else 0, PAIRS))
            for part in np.split(np.arange(len(i)), cuts):
                _alike(i[part], low[part], many[part], ln, rn, rr, empty, base, offer, best, score, weights[2], bounds, ratio, floor)
    found = best[back]
    best_of[usable] = np.where(found >= 0, kept[found], -1)
    score_of[usable] = np.where(found >= 0, score[back], 0.0)
    return best_of, score_of


def _alike(i, low, many, ln, rn, rr, empty, base, offer, best, score, weight, bounds, ratio, floor) -> None:
    """Offer the right rows from ``low`` on, ``many`` of them, to the left rows i, if their names are alike enough to win."""
    start = np.repeat(low - (np.cumsum(many) - many), many)
    i = np.repeat(i, many)
    for at in range(0, len(i), PAIRS):
        a = i[at : at + PAIRS]
        b = start[at : at + PAIRS] + np.arange(at, at + len(a))
        far = base(a, b)

        def hopeful(most, a, b, far):
            s = far + weight * most
            return (most >= floor) & ((s > score[a]) | ((s == score[a]) & (rr[b] < rr[best[a]])))

        x, y = bounds.size[ln[a]], bounds.size[rn[b]]
        ok = np.flatnonzero((ln[a] != rn[b]) & ~empty[rn[b]] & hopeful(2.0 * np.minimum(x, y) / np.maximum(x + y, 1), a, b, far))
        a, b, far = a[ok], b[ok], far[ok]
        ok = hopeful(bounds.by_letters(ln[a], rn[b]), a, b, far)
        a, b, far = a[ok], b[ok], far[ok]
        if not len(a):
            continue
        pairs, of = np.unique(ln[a].astype(np.int64) * len(empty) + rn[b], return_inverse=True)
        most = bounds.by_order(pairs // len(empty), pairs % len(empty))[of]
        while len(a):  # the most hopeful of each left row first
            ok = hopeful(most, a, b, far)
            a, b, far, most = a[ok], b[ok], far[ok], most[ok]
            order = np.lexsort((rr[b], -(far + weight * most), a))
            first = np.ones(len(order), bool)
            first[1:] = a[order][1:] != a[order][:-1]
            now = order[first]
            pairs, of = np.unique(ln[a[now]].astype(np.int64) * len(empty) + rn[b[now]], return_inverse=True)
            offer(a[now], b[now], bounds.ratios(pairs // len(empty), pairs % len(empty), ratio)[of])
            rest = np.ones(len(a), bool)
            rest[now] = False
            a, b, far, most = a[rest], b[rest], far[rest], most[rest]


def best_in_cells(left: DataFrame, right: DataFrame, ratio: Callable | None, floor: float, days: int, tolerance: float, weights: tuple, least: float) -> DataFrame:
    """(left_id, right_id, score) of every left row; see ``joins.best_match``.

    ``ratio`` compares two different names, both not empty, and gives 0 below
    ``floor``; a ratio of None counts equal names only.
    """
    finite = lambda c: c.isNotNull() & (F.abs(c) < float("inf"))
    span, band = max(1, 4 * (days - 1)), 8 * tolerance
    number = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    amount = F.col("amount").cast("double")
    usable = F.col("day").isNotNull() & finite(amount)
    a = left.select(F.col("id").alias("left_id"), F.when(usable, number("day")).otherwise(0).alias("left_day"), F.when(usable, amount).otherwise(float("nan")).alias("left_amount"), F.col("name").alias("left_name"))
    # Rows without a day or amount are spread over cells that no right row has.
    nowhere = -1_000_000_000 - F.pmod(F.xxhash64("left_id"), F.lit(1000))
    a = a.withColumn("block", F.when(F.isnan("left_amount"), nowhere).otherwise(F.floor(F.col("left_day") / span)))
    a = a.withColumn("band", F.when(F.isnan("left_amount"), 0).otherwise(F.floor(F.col("left_amount") / band)).cast("long"))
    b = right.where(usable).select(F.col("id").alias("right_id"), number("day").alias("right_day"), amount.alias("right_amount"), F.col("name").alias("right_name"), F.col("rank").alias("right_rank"))
    day, paid = F.col("right_day"), F.col("right_amount")
    b = b.withColumn("block", F.explode(F.sequence(F.floor((day - (days - 1)) / span), F.floor((day + (days - 1)) / span))))
    b = b.withColumn("band", F.explode(F.sequence(F.floor((paid - tolerance) / band), F.floor((paid + tolerance) / band))))
    kinds = {f.name: f.dataType.simpleString() for f in (*a.schema, *b.schema)}

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        best, score = _cell(x, y, days, tolerance, weights, ratio, floor)
        ids = np.full(len(x), None, object)
        wins = (best >= 0) & (score >= least)
        ids[wins] = y["right_id"].to_numpy(object)[best[wins]]
        return pd.DataFrame({"left_id": x["left_id"], "right_id": ids, "score": score})

    cells = a.groupBy("block", "band").cogroup(b.groupBy("block", "band"))
    return cells.applyInPandas(run, f"left_id {kinds['left_id']}, right_id {kinds['right_id']}, score double")
