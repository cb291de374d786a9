"""Language identification by nearest centroid.

A text is a vector of hashed byte n-grams (lower case, everything but letters as one space), square roots of the counts
times inverse document frequencies, normalised. Each language has several centroids, found by spherical k-means among
its labelled texts, as one language's texts may be of several kinds. A text belongs to the centroid of the greatest
cosine; it is rejected if that cosine is well below those of texts of that language which were held back when the
centroids were fitted.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skyloom.llm.frames import give_back

DIMENSIONS = 1 << 13
GRAMS = (2, 3, 4)
CENTROIDS = 4
PER_LANGUAGE = 600
"""The classifier is fitted on about so many different labelled texts a language (each chosen by a hash of it and its id, whole)."""
HELD_BACK = 3
"""One in so many of them is no part of the centroids; the rejection is fitted on these."""
LOW, MARGIN, FLOOR = 0.01, 0.7, 0.3
"""A text is rejected if its nearness is below MARGIN times the LOW quantile of the held-back texts of its language, or FLOOR
times their median: outliers and wrong labels among them move neither much."""
LANGUAGES = 10_000
"""Up to so many different labels their counts are broadcast."""
SHORT = 300
"""A text of m n-grams can't come as near as a long one; its cosine counts times sqrt(1 + SHORT / m) for the rejection."""
CHUNK = 1 << 20

_OTHER = {c: " " for c in range(128) if not chr(c).isalpha()}


def grams(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a whole text, in chunks that overlap by the longest n-gram less one."""
    words = " ".join(text.translate(_OTHER).lower().split())
    total = np.zeros(DIMENSIONS, np.int64)
    raw = f" {words} ".encode() + b"\\0" * max(GRAMS)
    n, shift = len(raw) - max(GRAMS), np.uint32(32 - (DIMENSIONS - 1).bit_length())
    for a in range(0, n, CHUNK):
        size = min(CHUNK, n - a)
        v = np.ndarray((size,), "<u4", raw, a, (1,))
        for g in GRAMS:
            use = v[: max(0, min(size, n - g + 1 - a))]
            if g < 4:
                use = use & np.uint32((1 << 8 * g) - 1)
            total += np.bincount(((use + np.uint32(g)) * np.uint32(0x9E3779B1)) >> shift, minlength=DIMENSIONS)
    return total


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclasses.dataclass
class Model:
    languages: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray
    least: np.ndarray  # nearness below which a text is rejected, of each centroid

    def classify(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of each text; `und`, 0 and rejected for those without a letter."""
        told, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if not self.languages:
            return told, score, rejected
        own = [i for i, t in enumerate(texts) if has_letter(t)]
        for a in range(0, len(own), 256):
            part = own[a : a + 256]
            counts = np.stack([grams(texts[i]) for i in part])
            cosine = vectors(counts, self.idf) @ self.centroids.T
            best = cosine.argmax(axis=1)
            top = cosine[np.arange(len(part)), best]
            score[part], rejected[part] = np.clip(top, 0, 1), nearness(top, counts) < self.least[best]
            for i, k in zip(part, best.tolist(), strict=True):
                told[i] = self.languages[k]
        return told, score, rejected


def nearness(cosine: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return cosine * np.sqrt(1 + SHORT / np.maximum(1, counts.sum(axis=1)))


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts, dtype=np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def clustered(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from far-apart seeds; the same result for the same rows in the same order."""
    seeds = [0]
    near = x @ x[0]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        for i in range(len(c)):
            if (own == i).any():
                m = x[own == i].sum(axis=0)
                c[i] = m / max(np.linalg.norm(m), 1e-12)
    return c


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS) -> Model:
    """Fits the model on the labelled rows of docs: about per_language different ones of each language, chosen by a hash of id
    and text. Equal rows (of one id, or of none) are one row, so the sample is as small however often they occur."""
    h = F.xxhash64(docs[doc_id].cast("string"), docs[text].cast("string"))
    labelled = docs.select(h.alias("h"), docs[text].cast("string").alias("text"), docs[lang].cast("string").alias("lang")).where("lang is not null and text is not null")
    counts = labelled.groupBy("lang").count()
    counts = F.broadcast(counts) if counts.limit(LANGUAGES + 1).count() <= LANGUAGES else counts
    chosen = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < F.lit(float(per_language)) / F.col("count") * (1 << 30)
    sample = labelled.join(counts, "lang").where(chosen).select("h", "text", "lang")

    def of(batches):
        known: set[tuple[int, str]] = set()
        for batch in batches:
            out: dict[str, list] = {"h": [], "lang": [], "where": [], "count": []}
            for own, t, name in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if (own, name) in known or not has_letter(t):
                    continue
                known.add((own, name))
                g = grams(t)
                at = np.flatnonzero(g)
                for column, value in zip(out.values(), (own, name, at.astype("<u2").tobytes(), np.minimum(g[at], (1 << 32) - 1).astype("<u4").tobytes()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), (pa.int64(), pa.string(), pa.binary(), pa.binary()))], list(out))

    rows = sample.mapInArrow(of, "h long, lang string, where binary, count binary").dropDuplicates(["h", "lang"]).collect()
    rows.sort(key=lambda r: (r["lang"], r["h"]))
    if not rows:
        return Model([], np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0))
    seen = np.zeros(DIMENSIONS)
    for r in rows:
        seen[np.frombuffer(r["where"], "<u2")] += 1
    idf = (np.log((1 + len(rows)) / (1 + seen)) + 1).astype(np.float32)
    names, found, least = [], [], []
    for name in sorted({r["lang"] for r in rows}):
        own = [r for r in rows if r["lang"] == name]
        counted = np.zeros((len(own), DIMENSIONS), np.float32)
        for i, r in enumerate(own):
            counted[i, np.frombuffer(r["where"], "<u2")] = np.frombuffer(r["count"], "<u4")
        x = vectors(counted, idf)
        back = np.arange(len(own)) % HELD_BACK == HELD_BACK - 1
        if not back.any():  # too few to hold any back
            back[:] = True
            c = clustered(x, centroids)
        else:
            c = clustered(x[~back], centroids)
        near = nearness((x[back] @ c.T).max(axis=1), counted[back])
        names += [name] * len(c)
        found.append(c)
        least += [max(MARGIN * float(np.quantile(near, LOW)), FLOOR * float(np.median(near)))] * len(c)
    return Model(names, idf, np.concatenate(found), np.array(least))


def held_out(doc_id) -> F.Column:
    """Whether crc32(doc_id as text) mod 4 is 2; null ids aren't."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (cosine, 0 to 1) and rejected, from the whole text alone.

    `und`, score 0 and rejected for a null or empty text, one without a letter, and for all where nothing was learned.
    Repeated rows get the same answer, ties between centroids go to the first in the order of language names; empty
    tables give empty results; columns of these names in docs are replaced. Only the texts go to Python.
    """

    @F.arrow_udf(StructType().add("lang_pred", "string").add("score", "double").add("rejected", "boolean"))
    def told(texts: pa.Array) -> pa.Array:
        parts = [model.classify(texts[i : i + 256].to_pylist()) for i in range(0, len(texts), 256)]
        names, score, rejected = [n for p in parts for n in p[0]], np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        give_back()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], ["lang_pred", "score", "rejected"])

    name = next(n for n in (f"told_{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    found = docs.withColumn(name, told(F.col(text).cast("string")))
    return found.withColumns({c: F.col(f"{name}.{c}") for c in ("lang_pred", "score", "rejected")}).drop(name)


def fit_and_identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Fits on the rows that aren't held out and identifies all rows: doc_id, held_out, lang_pred, score, rejected."""
    model = fit(docs.where(docs[doc_id].isNotNull() & ~held_out(docs[doc_id])), doc_id, text, lang)
    ids = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return identify(ids, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
