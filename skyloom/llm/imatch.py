"""I-Match document fingerprints, in DataFrame functions only.

A text's terms are its distinct lower-cased words, as 64-bit hashes. The lexicon keeps the terms whose inverse document
frequency lies in a band: frequent words go. Document frequencies are counted over all documents, by 2**BUCKET_BITS
hash buckets, so that the lexicon is a bitmap of fixed size (32 KB) at any size of the vocabulary; a rare term that
shares a bucket with a frequent one goes with it. The terms left are sorted, and several random subsets of the lexicon
(chosen by the terms' hash bits) are hashed: SUBSETS subsets in each of LEVELS sizes, a quarter of the lexicon's terms
each time. Two texts are alike as far as their subset hashes agree, in the smallest subsets that still hold terms of
them; small subsets survive edits of long texts, large ones tell short texts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyloom.llm import blocks as B

BUCKET_BITS = 18
IDF_BAND = (3.5, 9.0)
"""ln(documents / documents with the term): terms of 3 % of the documents and more tell little, those of 0.01 % and less are
often slips, which a near copy has others of. The upper edge acts from 8104 documents on."""
LEAST_TERMS = 4
"""A text with fewer terms in the lexicon is fingerprinted by all its terms: so few tell nothing, and none would make it like
an empty text."""
SUBSET_BITS = 5
SUBSETS = 1 << SUBSET_BITS
LEVELS = 6
CROWDED = 8
"""Subsets that would hold more terms of a text than this on average are left empty in its fingerprint: with so many,
any edit changes them all. Those of the last level never are, so that no text with terms has the fingerprint of an empty one."""
EMPTY = 42
"""What a subset without terms has; a hash of terms begins with it."""


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def terms(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text: str = "text", band: tuple[float, float] = IDF_BAND) -> Column:
    """A bitmap over hash buckets, as an array literal: whether the bucket's inverse document frequency is in the band."""
    n = docs.count()
    buckets = F.array_distinct(F.transform(terms(F.coalesce(F.col(text), F.lit(""))), lambda h: h.bitwiseAND((1 << BUCKET_BITS) - 1).cast("int")))
    counts = docs.select(F.explode(buckets).alias("bucket")).groupBy("bucket").count()
    idf = F.log(F.lit(float(max(n, 1))) / F.col("count"))
    kept = counts.where((idf >= band[0]) & (idf <= band[1]))
    bit = F.expr("shiftleft(1L, cast(bucket & 63 as int))")
    # at most 2**(BUCKET_BITS - 6) numbers come to the driver, whatever the corpus
    rows = kept.groupBy(F.shiftright("bucket", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).collect()
    bitmap = np.zeros(1 << (BUCKET_BITS - 6), np.int64)
    for r in rows:
        bitmap[r["at"]] = r["bits"]
    return F.lit(bitmap)


def subset_hashes(chosen: Column) -> Column:
    """SUBSETS integers: the hash of the terms of each subset, told by a term's highest bits; one pass over the sorted terms,
    in which the subsets follow one another."""
    number = lambda h: (F.shiftright(h, 64 - SUBSET_BITS) + SUBSETS // 2).cast("int")
    state = lambda done, at, hash_: F.struct(done.alias("done"), at.alias("at"), hash_.alias("hash"))
    closed = lambda a, upto: F.concat(a["done"], F.array(a["hash"]), F.array_repeat(F.lit(EMPTY), upto - a["at"] - 1))

    def add(a: Column, h: Column) -> Column:
        return F.when(number(h) == a["at"], state(a["done"], a["at"], F.hash(a["hash"], h))).otherwise(state(closed(a, number(h)), number(h), F.hash(F.lit(EMPTY), h)))

    return F.aggregate(chosen, state(F.array().cast("array<int>"), F.lit(0), F.lit(EMPTY)), add, lambda a: closed(a, F.lit(SUBSETS)))


def fingerprint(text: Column, lexicon_: Column) -> Column:
    """SUBSETS * LEVELS integers: the hashes of the sorted terms in each subset of the lexicon, the largest subsets first."""

    def listed(h: Column) -> Column:
        bucket = h.bitwiseAND((1 << BUCKET_BITS) - 1).cast("int")
        word = F.get(lexicon_, F.shiftright(bucket, 6))
        return F.call_function("shiftrightunsigned", word, bucket.bitwiseAND(63)).bitwiseAND(1) == 1

    def levels(chosen: Column, n: Column, i: int) -> Column:
        if i == LEVELS - 1:
            return subset_hashes(chosen)
        own = F.when(n <= CROWDED * SUBSETS * 4**i, subset_hashes(chosen)).otherwise(F.array_repeat(F.lit(EMPTY), SUBSETS))
        rest = F.filter(chosen, lambda h: F.shiftright(h, 20 + 2 * i).bitwiseAND(3) == 0)
        return F.concat(own, let(rest, lambda c: levels(c, n, i + 1)))

    own = let(terms(text), lambda t: let(F.filter(t, listed), lambda b: F.sort_array(F.when(F.size(b) >= LEAST_TERMS, b).otherwise(t))))
    return let(own, lambda o: levels(o, F.size(o), 0))


def likeness(a: Column, b: Column) -> Column:
    """How much of two texts is common, 0 to 1: from the share s of subset hashes that agree, among the subsets with terms
    of either text, at the smallest subsets of which at least half have such terms (else at the largest). For small
    subsets s is about the terms' Jaccard similarity, and 2 s / (1 + s) the common share. 1 for two texts without terms."""
    both = F.zip_with(a, b, lambda x, y: F.when((x == EMPTY) & (y == EMPTY), F.lit(None)).otherwise(x == y))

    def at(pairs: Column, i: int) -> tuple[Column, Column]:
        part = F.slice(pairs, i * SUBSETS + 1, SUBSETS)
        return F.size(F.filter(part, lambda v: v)).cast("double"), F.size(F.filter(part, lambda v: v.isNotNull()))

    def choose(pairs: Column) -> Column:
        same, used = at(pairs, 0)
        out = F.when(F.size(F.filter(pairs, lambda v: v.isNotNull())) == 0, F.lit(1.0)).otherwise(F.when(used > 0, same / used).otherwise(0.0))
        for i in range(1, LEVELS):
            same, used = at(pairs, i)
            out = F.when(used >= SUBSETS // 2, same / used).otherwise(out)
        return out

    return let(let(both, choose), lambda s: 2 * s / (1 + s))


def hexed(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def compare_with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """Fingerprints every text and its edited text (its last third replaced by the beginning of the next document in
    descending order of doc_id, the first after the last): doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    A null text counts as empty; texts without words share the fingerprint of no terms. Equal texts have equal
    fingerprints. Rows of one id are taken in descending order of their text, and a null id counts as the smallest. A
    single document is next to itself. Empty tables give empty results; other columns are not read. The next document
    is found in blocks of bounded size, each with the first document of the block after it.
    """
    base = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    lexicon_ = lexicon(base, "text", band)
    blocked, _, _ = B.with_block(base, "doc_id", "text")
    order = F.coalesce("doc_id", F.lit(-(1 << 63)))
    heads = sorted((r["block"], r["head"]) for r in blocked.groupBy("block").agg(F.max(order).alias("head")).collect())
    # the head of each block also closes the block above; that of the highest closes the lowest
    to = [(own, head, heads[(i + 1) % len(heads)][0]) for i, (own, head) in enumerate(heads)]
    closing = docs.sparkSession.createDataFrame(to, "own int, head long, closed int")
    rows = blocked.select("doc_id", "text", "block", F.lit(0).alias("closes"))
    ends = blocked.join(F.broadcast(closing), (order == F.col("head")) & (F.col("block") == F.col("own"))).select("doc_id", "text", F.col("closed").alias("block"), F.lit(1).alias("closes"))
    marked = rows.unionAll(ends).withColumn("fp", fingerprint(F.col("text"), lexicon_))
    w = Window.partitionBy("block").orderBy("closes", F.coalesce("doc_id", F.lit(-(1 << 63))).desc(), F.col("text").desc())
    placed = marked.withColumn("next", F.lead("text").over(w)).withColumn("next_fp", F.lead("fp").over(w)).where("closes = 0")
    third = F.floor(F.char_length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - third), F.substring(F.col("next"), F.lit(1), third))
    placed = placed.withColumn("edited", edited).withColumn("edited_fp", fingerprint(F.col("edited"), lexicon_))
    return placed.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        hexed(F.col("fp")).alias("fingerprint"),
        hexed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
