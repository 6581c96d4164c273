"""Names that may name the same payee, found without holding all names against all.

``names.relation`` accepts two forms only if every token of the form with fewer
tokens has a partner in the other, and one of the partners is equal to it or a
typo apart and of five letters or more. Two steps follow from that. First the
tokens: a dictionary of all distinct tokens is searched once for tokens a typo
apart. Then the forms: a form looks for its rarest token, or a token a typo from
it, in the others; where that token may be abbreviated, for another token
together with the beginning of the rarest. Both steps miss nothing that
``relation`` accepts.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ledgerloom.llm.names import FULL_NAME, LONGEST, NICKNAMES, _legal_end, slip
from ledgerloom.runtime import Scratch, freed, spread, written

MIN_SUFFIX, COMMON, MANY_TOKENS, CELL = 4, 16, 8, 1024


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def shortened(token: str, edits: int = 1) -> set[str]:
    """The token and what is left of it without any ``edits`` letters: tokens a typo apart share one of these."""
    out = {token} | {token[:i] + token[i + 1 :] for i in range(len(token))}
    if edits > 1 and len(token) >= 6:
        out |= {token[:i] + token[i + 1 : j] + token[j + 1 :] for i, j in combinations(range(len(token)), 2)}
    return out


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter((v for x in lists for v in x), np.int64, sum(map(len, lists)))


def _shortened_rows(edits: int):
    def run(batches):
        for pdf in batches:
            keys = [[_key(v) for v in shortened(t, edits)] for t in pdf["t"]]
            yield pd.DataFrame({"key": _flat(keys), "t": np.repeat(pdf["t"].to_numpy(), [len(x) for x in keys])})

    return run


def _slip_udf(edits: int):
    @F.pandas_udf(BooleanType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([slip(a, b, edits) for a, b in zip(x, y)], dtype=bool)

    return run


def suffix_pairs(tokens: DataFrame, common: int = COMMON) -> DataFrame:
    """Pairs (t < y) of tokens that share a suffix block.

    All suffixes of ``MIN_SUFFIX`` letters or more are counted. A token is
    indexed under its shortest suffix that at most ``common`` tokens share. The
    longest suffix that more of them share is overly common: it is refined by
    the token's first letter and its length, one more or one less, and
    discarded only if the refined block is overly common too.
    """
    long = tokens.where(F.length("t") >= MIN_SUFFIX)
    lengths = F.sequence(F.lit(MIN_SUFFIX), F.length("t"))
    every = long.select("t", F.explode(F.transform(lengths, lambda k: F.right(F.col("t"), k))).alias("s"))
    often = every.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") > common).select("s")
    depth = every.join(often, "s").groupBy("t").agg(F.max(F.length("s")).alias("d"))
    level = long.join(depth, "t", "left").withColumn("d", F.coalesce("d", F.lit(0)))
    leaf = level.where(F.length("t") > F.col("d")).select("t", F.right("t", F.greatest(F.lit(MIN_SUFFIX), F.col("d") + 1)).alias("block"))
    sizes = F.explode(F.array(F.length("t"), F.length("t") + 1))
    fine = level.where("d > 0").select("t", "d", sizes.alias("k"))
    fine = fine.select("t", F.concat_ws("|", F.right("t", F.col("d")), F.left("t", F.lit(1)), F.col("k").cast("string")).alias("block"))
    blocks = leaf.unionByName(fine)
    kept = blocks.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n").between(2, common)).select("block")
    blocks = blocks.join(kept, "block")
    pairs = blocks.alias("p").join(blocks.alias("q"), "block").where("p.t < q.t")
    return pairs.select(F.col("p.t").alias("t"), F.col("q.t").alias("y")).distinct()


def token_links(tokens: DataFrame, edits: int = 1, whole: DataFrame | None = None) -> DataFrame:
    """(t, y), both ways round, of distinct tokens (t) that are a typo apart.

    Candidates share a suffix block (of the tokens in ``whole``, if given) or, complete for every
    typo, a form shortened by as many letters. A shortened form belongs to a
    number of tokens that the alphabet bounds, so no block grows with the data.
    """
    keyed = tokens.mapInPandas(_shortened_rows(edits), "key long, t string")
    pairs = keyed.alias("p").join(keyed.alias("q"), "key").where("p.t < q.t").select(F.col("p.t").alias("t"), F.col("q.t").alias("y"))
    if whole is not None:
        pairs = pairs.unionByName(suffix_pairs(whole))
    pairs = spread(pairs.distinct()).where(_slip_udf(edits)("t", "y"))
    return pairs.select("t", "y", F.explode(F.array(F.lit(True), F.lit(False))).alias("straight")).select(
        F.when(F.col("straight"), F.col("t")).otherwise(F.col("y")).alias("t"), F.when(F.col("straight"), F.col("y")).otherwise(F.col("t")).alias("y")
    )


@lru_cache(1 << 16)
def order_mask(token: str) -> int:
    """Which pairs of letters stand in which order, as 64 bits: all bits of a token are among those of a token it abbreviates."""
    mask = 0
    for x, y in {*combinations(token[:LONGEST], 2)}:
        mask |= 1 << ((ord(x) * 31 + ord(y)) * 2654435761 >> 11) % 64
    return mask


def _beginnings(o: str, small: bool, near: list[str], edits: int) -> list[tuple[str, int]]:
    """Keys that a token and its abbreviation, initial or short first name share, with the mask of the token.

    The first letter if one of them has six letters or fewer, otherwise the
    first seven (with ``edits`` 2, three), and the full first name. A mask of 0
    agrees with all others: first names need not share letters, and with
    ``edits`` 2 a short form may lack a letter of the other.
    """
    mask = order_mask(o) if edits == 1 and o not in FULL_NAME and len(o) <= LONGEST else 0
    keys = ["b" + o[: 7 if edits == 1 else 3]] if len(o) >= 7 else []
    keys += ["w" + o[0]] * (small or len(o) <= 6) + ["u" + o[0]] * (not small or len(o) <= 6)
    return [(k, mask) for k in keys] + [("n" + FULL_NAME.get(v, v), 0) for v in (o, *near) if v in FULL_NAME or v in NICKNAMES]


def block_keys(form: str, ranked: list[str], up: dict[str, list[str]], small: bool, edits: int = 1) -> set[str]:
    """Keys of a form as the one with fewer (``small``) or more tokens; forms that ``relation`` accepts share one."""
    return {k for k, _ in masked_keys(form, ranked, up, small, edits)}


def masked_keys(form: str, ranked: list[str], up: dict[str, list[str]], small: bool, edits: int = 1) -> set[tuple[str, int]]:
    """Keys of a form as the one with fewer (``small``) or more tokens, each with a mask.

    Forms that ``relation`` accepts share a key under which the bits of one mask
    are among those of the other; keys of whole tokens have the mask 0.
    ``ranked`` has its tokens, the rarest first, ``up`` the more frequent tokens a
    typo from each of them: of two tokens a typo apart the less frequent one
    stands under both. Forms of very many tokens need no second token beside the
    beginning of the rarest: their number of tokens is as telling.
    """
    ts, keys, masked = form.split(" "), set(), set()
    k = len(ts)
    as_ = lambda t: (t, *up.get(t, ()))
    if not small:
        keys |= {"t" + y for t in ts for y in as_(t)}
        if k > 1:
            joined = "".join(ts)
            keys |= {"j" + y for y in as_(joined) if len(y) <= LONGEST}
            keys |= {f"f{x}|{''.join(ts[i + 1 :] + ts[:i])[0]}" for i, x in enumerate(ts) if 5 <= len(x) <= LONGEST}
        if k <= MANY_TOKENS + 3:
            for o in set(ts):
                start = _beginnings(o, False, as_(o), edits)
                masked |= {(f"c{y}|{s}", mask) for x in set(ts) if len(x) >= 5 and (x != o or ts.count(x) > 1) for y in as_(x) for s, mask in start}
        if k > MANY_TOKENS:
            starts = {s for o in set(ts) for s in _beginnings(o, False, as_(o), edits)}
            masked |= {(f"l{n}|{s}", mask) for n in range(max(MANY_TOKENS + 1, k - 3), k + 1) for s, mask in starts}
        return masked | {(key, 0) for key in keys}
    r = ranked[0]
    keys |= {"t" + y for y in as_(r)}
    if k == 1:
        keys |= {"j" + y for y in as_(form) if len(y) <= LONGEST}
        keys |= {"j" + form[:i] for i in range(max(1, len(form) - 14), len(form)) if i <= LONGEST and _legal_end(form[i:])}
        for i in range(5, min(len(form) - 1, LONGEST + 1) if len(form) >= 10 else 0):
            rest = re.sub("^sons|and", "", form[i : i + 9])
            keys |= {f"f{form[:i]}|{rest[0]}"} if rest else {f"f{form[:i]}|{c}" for c in set(form[i:])}
    else:
        start = _beginnings(r, True, as_(r), edits)
        if k > MANY_TOKENS:
            masked |= {(f"l{k}|{s}", mask) for s, mask in start}
        else:
            anchors = {y for a in ts if len(a) >= 5 and (a != r or ts.count(a) > 1) for y in as_(a)}
            masked |= {(f"c{a}|{s}", mask) for a in anchors for s, mask in start}
    return masked | {(key, 0) for key in keys}


def _key_rows(batches, edits: int):
    for pdf in batches:
        keys, masks = [], []
        for g, form, toks, joined in zip(pdf["g"], pdf["form"], pdf["toks"], pdf["joined"]):
            ranked = [x["t"] for x in toks]
            up = {x["t"]: list(x["ys"]) for x in toks if x["ys"] is not None}
            if joined is not None:
                up[form.replace(" ", "")] = list(joined)
            for small in (True, False):
                made = list(masked_keys(form, ranked, up, small, edits))
                keys.append([_key(f"{g}|{v}") for v, _ in made])
                masks.append([m - (m >> 63 << 64) for _, m in made])
        size = np.array([len(x) for x in keys], np.int64)
        whose = np.repeat(np.repeat(np.arange(len(pdf)), 2), size)
        small = np.repeat(np.tile([True, False], len(pdf)), size)
        k = pdf["form"].str.count(" ").to_numpy(np.int32) + np.int32(1)
        yield pd.DataFrame({"fid": pdf["fid"].to_numpy()[whose], "k": k[whose], "small": small, "key": _flat(keys), "mask": _flat(masks)})


def block_pairs(keyed: DataFrame, cell: int = CELL) -> DataFrame:
    """Pairs (a < b) of forms that share a key (key, mask, fid, k, small), one as small, and of whose masks one holds the other.

    A key of many forms is cut into cells of about ``cell`` forms a side, and
    every pair of cells is a join key of its own, so no task holds a whole block.
    """
    keyed = keyed if "mask" in keyed.columns else keyed.withColumn("mask", F.lit(0).cast("long"))
    counts = keyed.groupBy("key").agg(F.count_if("small").alias("ns"), F.count_if(~F.col("small")).alias("nb"))
    hot = counts.where((F.col("ns") > cell) | (F.col("nb") > cell)).select("key", F.ceil(F.col("ns") / cell).alias("cs"), F.ceil(F.col("nb") / cell).alias("cb"))
    cut = keyed.join(hot, "key", "left").withColumns({"cs": F.greatest(F.coalesce("cs", F.lit(1)), F.lit(1)), "cb": F.greatest(F.coalesce("cb", F.lit(1)), F.lit(1))})
    mine = lambda n: F.pmod(F.xxhash64("fid"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    p = cut.where("small").select("key", "mask", "fid", "k", mine("cs").alias("i"), every("cb").alias("j")).alias("p")
    q = cut.where("not small").select("key", "mask", "fid", "k", mine("cb").alias("j"), every("cs").alias("i")).alias("q")
    met = p.join(q, ["key", "i", "j"]).where("p.fid <> q.fid and q.k >= p.k and (p.k = 1 or q.k <= p.k + 3) and (p.mask & q.mask = p.mask or p.mask & q.mask = q.mask)")
    return met.select(F.least("p.fid", "q.fid").alias("a"), F.greatest("p.fid", "q.fid").alias("b")).distinct()


def candidates(forms: DataFrame, edits: int = 1, suffixes: bool = False) -> DataFrame:
    """Pairs (a < b) of forms (g, fid, form) of one group g that may be alike; none that ``relation`` accepts is missing."""
    kind = forms.schema["fid"].dataType.simpleString()
    with Scratch(forms.sparkSession, "alike") as scratch:
        words = forms.select("g", "fid", F.explode(F.array_distinct(F.split("form", " "))).alias("t"))
        glued = forms.where(F.instr("form", " ") > 0).select("g", "fid", F.replace("form", F.lit(" "), F.lit("")).alias("t"))
        full = forms.sparkSession.createDataFrame([(n, 0) for n in NICKNAMES], "t string, df long")
        tokens = words.groupBy("t").agg(F.count("*").alias("df")).unionByName(glued.select("t", F.lit(0).cast("long").alias("df"))).unionByName(full)
        tokens = scratch.written(spread(tokens.groupBy("t").agg(F.max("df").alias("df"))), "tokens")
        freed(forms.sparkSession)
        some = tokens.where(F.length("t").between(4, LONGEST))
        links = token_links(some.select("t"), edits, some.where("df > 0").select("t") if suffixes else None)
        links = links.join(tokens, "t").join(tokens.select(F.col("t").alias("y"), F.col("df").alias("dy")), "y")
        up = links.where("struct(dy, y) > struct(df, t)").groupBy("t").agg(F.collect_set("y").alias("ys"), F.max("dy").alias("dy"))
        known = scratch.written(tokens.join(up, "t", "left").select("t", F.greatest("df", "dy").alias("df"), "ys"), "known")
        freed(forms.sparkSession)
        toks = words.join(known, "t").groupBy("g", "fid").agg(F.array_sort(F.collect_list(F.struct("df", "t", "ys"))).alias("toks"))
        joined = glued.join(known.where("ys is not null").select("t", "ys"), "t").select("g", "fid", F.col("ys").alias("joined"))
        keyed = forms.join(toks, ["g", "fid"]).join(joined, ["g", "fid"], "left").select("g", "fid", "form", "toks", "joined")
        keyed = spread(keyed).mapInPandas(lambda batches: _key_rows(batches, edits), f"fid {kind}, k int, small boolean, key long, mask long")
        keyed = scratch.written(keyed, "keys")
        freed(forms.sparkSession)
        pairs = written(block_pairs(keyed), "candidates")
    freed(forms.sparkSession)
    return pairs
