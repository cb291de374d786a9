"""Removal of repeated articles: equal URLs, then titles that are alike, in order of arrival.

A title is dropped if an earlier one of its language that was kept is alike. That is a fold over the arrivals; here it is
the fixed point of "kept if no kept earlier title is alike", reached by rounds over the table of alike pairs.
"""

from __future__ import annotations

import difflib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.operators.relational import first_per_key
from skyloom.session import cut

THRESHOLD = 0.72


def similarity(earlier: str, later: str) -> float:
    """Ratcliff-Obershelp similarity of lower-cased strings; the order of the two matters."""
    return difflib.SequenceMatcher(None, earlier, later).ratio()


def common_subsequences(earlier: list[str], later: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs of strings: bit-parallel over the characters of the first and
    array-parallel over the pairs, 63 bits a word."""
    titles, which = np.unique(np.array(earlier, object), return_inverse=True) if earlier else (np.empty(0, object), np.empty(0, np.int64))
    alphabet = {c: i for i, c in enumerate(sorted(set("".join(titles))))}
    words = max(1, -(-max(map(len, titles), default=1) // 63))
    masks = np.zeros((words, len(titles), len(alphabet) + 1), np.uint64)  # the last character is one that no title has
    for t, title in enumerate(titles):
        for i, c in enumerate(title):
            masks[i // 63, t, alphabet[c]] |= np.uint64(1 << i % 63)
    n = np.array([len(s) for s in later], np.int64)
    codes = np.full((len(later), int(n.max(initial=0))), len(alphabet), np.int64)
    for row, s in enumerate(later):
        codes[row, : len(s)] = [alphabet.get(c, len(alphabet)) for c in s]
    full = np.uint64((1 << 63) - 1)
    rows = [np.full(len(later), full) for _ in range(words)]
    for j in range(codes.shape[1]):
        carry = np.zeros(len(later), np.uint64)
        for w in range(words):
            hit = rows[w] & masks[w, which, codes[:, j]]
            total = rows[w] + hit + carry  # below 2**64, as both are below 2**63
            carry = total >> np.uint64(63)
            rows[w] = (total | (rows[w] - hit)) & full
    return sum(63 - np.bitwise_count(r).astype(np.int64) for r in rows)


BLOCK, BLOCKS, LARGEST_BLOCK = 2048, 64, 32768
"""Titles of a block; more where a band would have more than BLOCKS blocks, up to LARGEST_BLOCK."""
_WIDTH, _CELLS, _MASKS = 256, 1 << 15, 1 << 23
"""Titles of the one list in a tile, pairs of a tile and words of its masks, at most."""


def possible_pairs(one: list[str], other: list[str], threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs, one of each list, whose longest common subsequence leaves the similarity possible; of the pairs
    of a list with itself (other is one) each once.

    Bit-parallel over the characters of a title, 63 bits a word, and array-parallel over the pairs of a tile.
    """
    own, theirs = np.array([len(s) for s in one], np.int64), np.array([len(s) for s in other], np.int64)
    order, across = np.argsort(own, kind="stable"), np.argsort(theirs, kind="stable")  # titles of a tile are of like length
    nx, ny = own[order], theirs[across]
    x, y = _letters([one[i] for i in order]), _letters([other[i] for i in across])
    alphabet = np.unique(x[x >= 0])
    x, y = _codes(x, alphabet), _codes(y, alphabet)
    found, at = [(np.empty(0, np.int64), np.empty(0, np.int64))], 0
    while at < len(order):
        width = _WIDTH
        while width > 1 and -(-int(nx[at : at + width][-1]) // 63) * (len(alphabet) + 1) * width > _MASKS:
            width //= 2
        sizes = nx[at : at + width]
        words = max(1, -(-int(sizes[-1]) // 63))
        masks = np.zeros((words, len(alphabet) + 1, len(sizes)), np.uint64)  # the last character is one that no title of these has
        for i in range(int(sizes[-1])):
            masks[i // 63, x[at : at + width, i], np.arange(len(sizes))] |= np.uint64(1 << i % 63)
        masks[:, -1] = 0
        height = max(1, _CELLS // (len(sizes) * words))
        for down in range(at if other is one else 0, len(across), height):
            beside = ny[down : down + height]
            short, long_ = min(sizes[-1], beside[-1]), max(sizes[0], beside[0])
            if 2 * short < threshold * (short + long_) - 1e-9:  # too unlike in length
                continue
            common = _common(masks, np.ascontiguousarray(y[down : down + height, : beside[-1]].T, np.intp))
            r, c = np.nonzero(2 * common >= threshold * (beside[:, None] + sizes[None, :]) - 1e-9)
            if other is one:
                r, c = r[(once := down + r > at + c)], c[once]
            found.append((order[at + c], across[down + r]))
        at += width
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _letters(titles: list[str]) -> np.ndarray:
    """A row of code points for each title, -1 after its end."""
    width = max(map(len, titles), default=0)
    if not width:
        return np.empty((len(titles), 0), np.int32)
    out = np.array(titles, f"U{width}").view(np.int32).reshape(len(titles), width).copy()
    out[np.arange(width)[None, :] >= np.array([len(t) for t in titles])[:, None]] = -1
    return out


def _codes(letters: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """The letters' places in the alphabet, its length for others."""
    at = np.searchsorted(alphabet, letters).astype(np.int32)
    if len(alphabet):
        at[alphabet[np.minimum(at, len(alphabet) - 1)] != letters] = len(alphabet)
    return at


def _common(masks: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of the titles in masks with those in codes."""
    words, full = len(masks), np.uint64((1 << 63) - 1)
    shape = (codes.shape[1], masks.shape[2])
    rows, hit = [np.full(shape, full) for _ in range(words)], np.empty(shape, np.uint64)
    carry = np.zeros(shape, np.uint64)
    for code in codes:
        for w, row in enumerate(rows):
            np.take(masks[w], code, axis=0, out=hit, mode="clip")
            hit &= row
            row ^= hit
            hit += hit
            if w:
                hit += carry  # below 2**64 with the row, as both are below 2**63
            hit += row
            if w + 1 < words:
                np.right_shift(hit, np.uint64(63), out=carry)
            row |= hit
            if words > 1:
                row &= full
    return sum(63 - np.bitwise_count(r & full).astype(np.int64) for r in rows)


def alike_pairs(titles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(earlier, later): pairs of arrivals (seq) whose titles are alike. titles: seq, lang, title.

    2 * matches / (la + lb) >= t needs min / max >= t / (2 - t), so lengths are dealt to bands of that ratio and a title
    meets its own band and the next; matching characters form a common subsequence, so its greatest length bounds the
    matches. Both are exact. Bands are dealt to blocks, and a task compares two blocks: pairs are rows only once they are
    found alike.
    """
    ratio = threshold / (2 - threshold)
    low = titles.select("seq", F.coalesce("lang", F.lit("")).alias("lang"), F.lower(F.coalesce("title", F.lit(""))).alias("title"))
    n = F.char_length("title").cast("double")
    low = low.withColumn("band", F.when(n > 0, F.floor(F.log(n) / math.log(1 / ratio))).otherwise(-10))
    size = F.least(F.greatest(F.lit(BLOCK), F.ceil(F.col("n") / BLOCKS)), F.lit(LARGEST_BLOCK))
    counts = cut(low.groupBy("lang", "band").agg(F.count("*").alias("n")).select("lang", "band", F.ceil(F.col("n") / size).cast("int").alias("own")))  # one row a band
    beside = lambda step, name: counts.select("lang", (F.col("band") + step).alias("band"), F.col("own").alias(name))
    bands = counts.join(beside(-1, "longer"), ["lang", "band"], "left").join(beside(1, "shorter"), ["lang", "band"], "left")
    tasks = bands.agg(F.sum(F.col("own") * (F.col("own") + 1) / 2 + F.col("own") * F.coalesce("longer", F.lit(0)))).first()[0] or 1
    block = F.pmod(F.xxhash64("title", "seq"), F.col("own")).cast("int")
    upto = lambda c: F.when(c > 0, F.sequence(F.lit(0), c - 1)).otherwise(F.array().cast("array<int>"))
    meet = lambda a, i, b, j: F.struct(a.alias("a"), i.alias("i"), b.alias("b"), j.alias("j"))
    band, own = F.col("band"), F.col("block")
    tiles = F.concat(
        F.transform(upto(F.col("own")), lambda j: meet(band, F.least(own, j), band, F.greatest(own, j))),
        F.transform(upto(F.col("longer")), lambda j: meet(band, own, band + 1, j)),
        F.transform(upto(F.col("shorter")), lambda j: meet(band - 1, j, band, own)),
    )
    dealt = low.join(F.broadcast(bands), ["lang", "band"]).withColumn("block", block)
    dealt = dealt.select("seq", "lang", "title", "band", "block", F.explode(tiles).alias("tile"))
    dealt = dealt.repartition(int(min(tasks, 4096)), "lang", "tile")

    def alike(rows: pd.DataFrame) -> pd.DataFrame:
        tile = rows["tile"].iloc[0]
        first = (rows["band"] == tile["a"]) & (rows["block"] == tile["i"])
        one = rows[first]
        other = one if (tile["a"], tile["i"]) == (tile["b"], tile["j"]) else rows[~first]
        s, t = one["seq"].tolist(), one["title"].tolist()
        s2, t2 = (s, t) if other is one else (other["seq"].tolist(), other["title"].tolist())
        found = ((s[i], t[i], s2[j], t2[j]) for i, j in zip(*possible_pairs(t, t2, threshold)))
        ordered = sorted(((y, ty, x, tx) if x < y else (x, tx, y, ty) for x, tx, y, ty in found if x != y), key=lambda p: p[0])
        out, matcher, prepared = [], difflib.SequenceMatcher(None), None
        for y, later, x, earlier in ordered:
            if y != prepared:  # what the matcher knows of its second text is kept for those that follow
                matcher.set_seq2(later)
                prepared = y
            matcher.set_seq1(earlier)
            if matcher.ratio() >= threshold:
                out.append((x, y))
        return pd.DataFrame(out, columns=["earlier", "later"])

    kind = titles.schema["seq"].dataType.simpleString()
    return dealt.groupBy("lang", "tile").applyInPandas(alike, f"earlier {kind}, later {kind}")


def greedy_kept(rows: DataFrame, pairs: DataFrame, key: str = "seq") -> DataFrame:
    """The keys that a pass in order keeps: those without a kept earlier partner in pairs (earlier, later).

    In each round a row without undecided or kept earlier partners is kept, and one with a kept partner is dropped; there
    are as many rounds as the longest chain of decisions, each cut by a checkpoint.
    """
    open_pairs = cut(pairs)
    dropped = rows.select(F.col(key).alias("later")).limit(0)
    while True:
        # partners that never are "later" themselves are kept: what is alike to them goes
        sure = open_pairs.select("earlier").distinct().join(open_pairs.select(F.col("later").alias("earlier")).distinct(), "earlier", "left_anti")
        gone = cut(open_pairs.join(sure, "earlier", "left_semi").select("later").distinct())
        if gone.isEmpty():
            break
        dropped = dropped.unionAll(gone)
        rest = open_pairs.join(gone, "later", "left_anti").join(gone.withColumnRenamed("later", "earlier"), "earlier", "left_anti")
        open_pairs = cut(rest.select("earlier", "later"))
    return rows.select(key).join(dropped.withColumnRenamed("later", key), key, "left_anti")


def dedup_batch(articles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The articles that a batch keeps. articles: seq (arrival, unique), url_hash, lang, title and others.

    A URL counts as seen even if its first article was dropped for its title. Of equal titles only the first can be kept:
    it is alike to the others, and what drops it drops them. So only the first ones are compared.
    """
    first = first_per_key(articles, "url_hash", "seq")
    titles = first.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), F.lower(F.coalesce("title", F.lit(""))).alias("title")).agg(F.min("seq").alias("seq"))
    titles = cut(titles)
    kept = greedy_kept(titles, alike_pairs(titles, threshold))
    return first.join(kept, "seq", "left_semi")
