"""SimHash fingerprints and their near-duplicate groups by Golay-code fuzzy hashing.

The binary Golay code (23, 12) is perfect: every 23-bit word is within 3 bits of exactly one of its 4096 codewords.
A word's *fuzzy indices* are the codewords that the word or one of its 23 one-bit neighbours decodes to (one or six of
them); two words that differ in at most two bits share one, as both reach what the word between them decodes to.

A 64-bit fingerprint is three segments (23, 23 and 18 bits). With at most four bits of difference in all, either

* one segment is equal and another differs in at most two bits: key (equal segment, fuzzy index of the other); or
* two segments differ in one bit each and the third in at most two: key (an index of each of the two, and one of three
  slices of the third, as two errors leave one slice untouched). One error needs fewer indices: the nearest codeword
  and those of the fuzzy indices that are smaller.

So every pair within four bits shares a key of 30 to 35 bits (about 120 keys a fingerprint), and the candidates in a
key are verified by the exact Hamming distance. Equal fingerprints are one node from the start, so copies cost nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm import blocks as B
from skyloom.llm.components import connected_components, stars
from skyloom.llm.frames import checkpointed, trimmed
from skyloom.llm.substring_dedup import word_hashes

MAX_DISTANCE = 4
"""What the keys guarantee."""

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42, lower: bool = True) -> int:
    """The 64-bit SimHash of a text's word shingles by XXH64; zero without words."""
    words = (text or b"").translate(_LOWER if lower else None).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    length = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(length + 1) - 1
    starts = (ends - length)[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    total = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), 1 << 16):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[i : i + (1 << 16)], ends[i : i + (1 << 16)])], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp) of every row; fp as a signed 64-bit number."""

    def of(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fp = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(of, "doc_id long, fp long")


# --- the code ------------------------------------------------------------------------------------------------------

_GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def _remainder(v: int) -> int:
    for i in range(22, 10, -1):
        if v >> i & 1:
            v ^= _GENERATOR << (i - 11)
    return v


def _code_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and of the high 11 bits; for each remainder up to six error patterns, its leader first
    (the same pattern again where there are fewer)."""
    low = np.array([_remainder(i) for i in range(1 << 12)], np.uint16)
    high = np.array([_remainder(i << 12) for i in range(1 << 11)], np.uint16)
    single = [(1 << i, _remainder(1 << i)) for i in range(23)]
    leader = {0: 0}
    for _ in range(3):
        for p, r in list(leader.items()):
            for bit, rest in single:
                leader.setdefault(p ^ rest, r ^ bit)
    patterns = np.zeros((1 << 11, 6), np.uint32)
    for r in range(1 << 11):
        found = [leader[r]]
        for bit, rest in single:
            if (x := bit ^ leader[r ^ rest]) not in found:
                found.append(x)
        patterns[r] = found + [found[0]] * (6 - len(found))
    return low, high, patterns


_TABLES: list = []


def fuzzy_indices(words: np.ndarray) -> np.ndarray:
    """(n, 6) codeword numbers (12 bits) of 23-bit words: the nearest first; rows with fewer repeat it."""
    if not _TABLES:
        _TABLES.extend(_code_tables())
    low, high, patterns = _TABLES
    r = low[words & 0xFFF] ^ high[words >> 12]
    return (words[:, None].astype(np.uint32) ^ patterns[r]) >> 11


SEGMENTS = ((0, 23), (23, 23), (46, 18))


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which fingerprint, key) rows, without repeats; keys of different kinds differ."""
    seg = [((fp >> np.uint64(o)) & np.uint64((1 << n) - 1)).astype(np.int64) for o, n in SEGMENTS]
    fuzzy = [fuzzy_indices(s).astype(np.uint64) for s in seg]
    which, keys = [], []
    row = np.arange(len(fp))

    def add(kind: int, *parts: tuple[np.ndarray, int]) -> None:
        key = np.full(len(parts[0][0]), kind, np.uint64)
        for value, bits in parts:
            key = (key << np.uint64(bits)) | value.astype(np.uint64)
        keys.append(key)

    distinct = [np.column_stack([np.ones(len(fp), bool), f[:, 1:] != f[:, :1]]) for f in fuzzy]
    fewer = [np.column_stack([np.ones(len(fp), bool), f[:, 1:] < f[:, :1]]) for f in fuzzy]
    for a in range(3):
        for b in range(3):
            if a != b:
                i, j = np.nonzero(distinct[b])
                add(1 + 3 * a + b, (seg[a][i], 23), (fuzzy[b][i, j], 12))
                which.append(row[i])
    for c in range(3):
        a, b = (x for x in range(3) if x != c)
        both = fewer[a][:, :, None] & fewer[b][:, None, :]
        i, j, k = np.nonzero(both)
        n = SEGMENTS[c][1]
        cut = [0, n // 3, 2 * n // 3, n]
        for s in range(3):
            part = (seg[c][i] >> cut[s]) & ((1 << (cut[s + 1] - cut[s])) - 1)
            add(10 + 3 * c + s, (fuzzy[a][i, j], 12), (fuzzy[b][i, k], 12), (part, 8))
            which.append(row[i])
    return np.concatenate(which), B.mix(np.concatenate(keys))


DENSE = 48


def links_in_keys(key: np.ndarray, fp: np.ndarray, distance: int) -> np.ndarray:
    """Pairs of fingerprints that share a key and lie within the distance: all of them in small groups, a spanning
    forest of them in large ones (a group is searched breadth first; a fingerprint that was reached isn't compared
    again, so a ball of near copies costs about as many comparisons as it has members)."""
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    out = []
    small = np.repeat(count <= DENSE, count) & np.repeat(count > 1, count)
    k, f = key[small], fp[small]
    step = 1
    while len(k) > step:
        same = np.flatnonzero(k[step:] == k[:-step])
        if not len(same):
            break
        near = same[np.bitwise_count(f[same] ^ f[same + step]) <= distance]
        out.append(np.column_stack([f[near], f[near + step]]))
        step += 1
    for i in np.flatnonzero(count > DENSE):
        left = np.unique(fp[first[i] : first[i] + count[i]])
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                x = queue.pop()
                near = np.bitwise_count(left ^ x) <= distance
                if near.any():
                    reached, left = left[near], left[~near]
                    out.append(np.column_stack([np.full(len(reached), x), reached]))
                    queue.extend(reached)
    return np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.uint64)


def fingerprint_links(distinct: DataFrame, n: int, distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b): links between different fingerprints that connect all that are within the distance. distinct: (fp long),
    each once; n is their number and only sets how many slices the keys are dealt to."""
    if distance > MAX_DISTANCE:
        raise ValueError(f"the keys guarantee pairs of up to {MAX_DISTANCE} bits")
    slices = max(8, math.ceil(n * 122 / B.SLICE_KEYS))

    def scatter(batches):
        for batch in batches:
            everything = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(everything), 8192):
                fp = everything[i : i + 8192]
                which, key = golay_keys(fp)
                order = np.argsort(key)
                which, key = which[order], key[order]
                t = B.fragments(0, slices, key, lambda a, b, key=key, fp=fp, which=which: int(b - a).to_bytes(4, "little") + fp[which[a:b]].tobytes() + B.pack_sorted(key[a:b]))
                yield from t.to_batches()

    def verify(table: pa.Table) -> pa.Table:
        keys, fps = [], []
        for p in table["payload"].to_pylist():
            m = int.from_bytes(p[:4], "little")
            fps.append(np.frombuffer(p, np.uint64, m, 4))
            keys.append(B.unpack_sorted(p[4 + 8 * m :]))
        links = stars(links_in_keys(np.concatenate(keys), np.concatenate(fps), distance).view(np.int64))
        return pa.table({"a": pa.array(links[:, 0]), "b": pa.array(links[:, 1])})

    return distinct.select("fp").mapInArrow(scatter, B.FRAGMENT).groupBy("slice").applyInArrow(verify, "a long, b long")


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: fingerprints link at `distance` or fewer differing bits, and
    component_id is the smallest doc_id that links reach, the row's own included.

    A-Z are lower-cased; words are [^\\x20\\x09-\\x0D]+; a text of fewer words than a shingle is one shingle. Null and
    empty texts and texts of white space have the fingerprint zero, which links like any other. Repeated rows are
    members of one group; null ids keep a row but are never the smallest. Empty tables give empty results; other
    columns are not read. Texts are hashed whole, whatever their length.
    """
    own = checkpointed(fingerprints(docs, doc_id, text, shingle))
    nodes = checkpointed(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = fingerprint_links(nodes, nodes.count(), distance)
    roots = connected_components(links)  # (node, root), fingerprints that have a link only
    linked = nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "least", "root")
    least = few(linked.groupBy("root").agg(F.min("least").alias("linked_id")), roots.where("node = root").count())
    label = nodes.join(linked.join(least, "root").select("fp", "linked_id"), "fp", "left").select("fp", F.coalesce("linked_id", "least").alias("component_id"))
    return own.join(label, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near duplicates by similarity ---

SIMILARITY = 0.8
SHINGLE = 5
ROWS = 3
"""MinHash values a band; texts that share a band are candidates."""
MISS = 1e-7
"""The chance that a pair of just the similarity shares no band, and again that its sketches refuse it."""
BAND_KEYS = 250_000
"""Band keys (about 90 bytes each) that one task reads."""
PART_SHINGLES = 2_000_000
"""Shingles of a component that one task compares with as many others at most."""
PIVOT_BYTES = 8 << 20
"""Up to so many bytes of shingles of the components' roots are broadcast."""
BROADCAST_IDS = 250_000
"""Up to so many ids are broadcast (16 bytes each); beyond that tables are joined by id."""


def few(df: DataFrame, n: int) -> DataFrame:
    """df of n rows of a few numbers, to be broadcast if n is small: then a key that many rows have is no hot key of a join."""
    return F.broadcast(df) if n <= BROADCAST_IDS else df


def _words(texts: list[bytes | None]) -> list[np.ndarray]:
    """64-bit hashes of the lower-cased words of each text; short texts are hashed together."""
    out, group, size = [], [], 0
    for i, t in enumerate(texts):
        group.append((t or b"").translate(_LOWER))
        size += len(group[-1]) + 1
        if size >= 1 << 20 or i + 1 == len(texts):
            hashed = word_hashes(b"\n".join(group))
            counts = [len(g.split()) for g in group] if len(group) > 1 else [len(hashed)]
            out += np.split(hashed, np.cumsum(counts)[:-1])
            group, size = [], 0
    return out


def shingle_set(words: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted different shingles; the whole sequence where there are fewer words."""
    n = max(1, len(words) - shingle + 1) if len(words) else 0
    at = np.arange(n)
    return np.unique(B.runs_hash(words, at, np.minimum(at + shingle, len(words)), B.BASE2))


def bands_for(similarity: float) -> int:
    """Bands with which a pair of this similarity is missed with a chance of at most MISS."""
    return max(1, math.ceil(math.log(MISS) / math.log1p(-min(similarity, 1 - 1e-9) ** ROWS)))


def least_equal(n: int, similarity: float) -> int:
    """How many of n MinHash values agree, but for a chance of MISS, in a pair of at least this similarity."""
    below = 0.0
    for c in range(n + 1):
        below += math.comb(n, c) * similarity**c * (1 - similarity) ** (n - c)
        if below > MISS:
            return c
    return n


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """(texts, n) MinHash values of sets of shingles."""
    salts = B.mix(np.arange(1, n + 1, dtype=np.uint64))
    out = np.full((len(sets), n), (1 << 64) - 1, np.uint64)
    for i, s in enumerate(sets):
        for a in range(0, len(s), 4096):
            np.minimum(out[i], B.mix(s[a : a + 4096, None] ^ salts).min(axis=0), out=out[i])
    return out


def links_in_bands(key: np.ndarray, node: np.ndarray, size: np.ndarray, sketch: np.ndarray, least: int, similarity: float) -> np.ndarray:
    """Pairs of nodes that share a key and may have the similarity by their sizes and sketches: all of them in small groups, a
    spanning forest of them in large ones (as in links_in_keys)."""
    order = np.lexsort((node, key))
    again = np.flatnonzero((key[order][1:] == key[order][:-1]) & (node[order][1:] == node[order][:-1])) + 1
    order = np.delete(order, again)
    key, node, size, sketch = key[order], node[order], size[order].astype(np.float64), sketch[order]

    def alike(i, j) -> np.ndarray:
        fits = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9
        return fits & ((sketch[i] == sketch[j]).sum(axis=1) >= least)

    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    out = []
    small = np.flatnonzero(np.repeat(count <= DENSE, count) & np.repeat(count > 1, count))
    k, step = key[small], 1
    while len(k) > step:
        same = np.flatnonzero(k[step:] == k[:-step])
        if not len(same):
            break
        i, j = small[same], small[same + step]
        near = alike(i, j)
        out.append(np.column_stack([node[i[near]], node[j[near]]]))
        step += 1
    for f in np.flatnonzero(count > DENSE):
        left = np.arange(first[f], first[f] + count[f])
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                x = queue.pop()
                near = alike(left, np.full(len(left), x))
                if near.any():
                    reached, left = left[near], left[~near]
                    out.append(np.column_stack([np.full(len(reached), node[x]), node[reached]]))
                    queue.extend(reached.tolist())
    return np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)


def majority(s: np.ndarray) -> int:
    """The SimHash of a set of 64-bit hashes."""
    total = np.zeros(64, np.int64)
    for a in range(0, len(s), 1 << 16):
        total += np.unpackbits(s[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(s), bitorder="little").view("<u8")[0])


def similar_to(own: np.ndarray, sets: list[np.ndarray], size: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the sets have the Jaccard similarity with `own`."""
    near = np.flatnonzero(np.minimum(size, len(own)) >= similarity * np.maximum(size, len(own)))
    if not len(near):
        return near
    if not len(own):
        return near  # sets without a shingle are alike
    common = np.add.reduceat(B.isin_sorted(np.concatenate([sets[i] for i in near]), own).astype(np.int64), np.concatenate([[0], np.cumsum(size[near])[:-1]]))
    return near[common >= similarity * (size[near] + len(own) - common) - 1e-12]


def near_duplicate_classes(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) of every different text that is linked with another: xxhash64 of the text (null as empty), and the smallest
    node that links reach. Texts link whose sets of `shingle`-word shingles have the Jaccard similarity.

    Candidates are texts whose SimHashes of these shingles the Golay keys link, and, as a similarity of 0.8 may be some ten bits,
    those that share a band of ROWS MinHash values and whose sketches (a byte of each value) don't tell that they differ: each
    of the two loses a pair of just the similarity with a chance of at most MISS, wherever the texts differ, and a more
    similar pair more rarely. Their components are verified by the exact similarity. Different texts share a node with a chance
    of 1e-5 at 15 million texts.
    """
    content = F.coalesce(docs[text].cast("string"), F.lit(""))
    base = docs.select(F.xxhash64(content).alias("node"), content.alias("text"))
    bands = bands_for(similarity)
    values = bands * ROWS
    least = least_equal(values, similarity)

    def sign(batches):
        for batch in batches:
            node, at = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_index=True)  # copies in a batch are one
            for a in range(0, len(node), 1024):
                sets = [shingle_set(w, shingle) for w in _words(batch.column(1).take(pa.array(at[a : a + 1024])).cast(pa.binary()).to_pylist())]
                fp = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
                found = signatures(sets, values)
                yield pa.RecordBatch.from_arrays([pa.array(node[a : a + 1024]), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp), pa.array([f.tobytes() for f in found], pa.binary())], ["node", "n", "fp", "signature"])

    signed = checkpointed(base.mapInArrow(sign, "node long, n long, fp long, signature binary"))
    slices = max(8, math.ceil(signed.count() * bands / BAND_KEYS))

    def scatter(batches):
        for batch in batches:
            node, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for a in range(0, len(node), 4096):
                found = np.frombuffer(b"".join(batch.column(2).slice(a, 4096).to_pylist()), np.uint64).reshape(-1, values)
                n, s, sketch = node[a : a + 4096], size[a : a + 4096].astype(np.uint32), found.astype(np.uint8)
                key = B.mix(B.mix(B.mix(found[:, ::3]) ^ found[:, 1::3]) ^ found[:, 2::3]) + np.arange(bands, dtype=np.uint64)
                key = B.mix(key).ravel()
                order = np.argsort(key)
                key, which = key[order], order // bands
                pack = lambda a, b, k=key, w=which, n=n, s=s, t=sketch: int(b - a).to_bytes(8, "little") + k[a:b].tobytes() + n[w[a:b]].tobytes() + s[w[a:b]].tobytes() + t[w[a:b]].tobytes()
                yield from B.fragments(0, slices, key, pack).to_batches()

    def candidates(table: pa.Table) -> pa.Table:
        parts = []
        for p in table["payload"].to_pylist():
            n = int.from_bytes(p[:8], "little")
            parts.append((np.frombuffer(p, np.uint64, n, 8), np.frombuffer(p, np.int64, n, 8 + 8 * n), np.frombuffer(p, np.uint32, n, 8 + 16 * n), np.frombuffer(p, np.uint8, n * values, 8 + 20 * n).reshape(n, values)))
        links = stars(links_in_bands(*[np.concatenate(x) for x in zip(*parts)], least, similarity))
        return pa.table({"a": pa.array(links[:, 0], pa.int64()), "b": pa.array(links[:, 1], pa.int64())})

    by_bands = signed.select("node", "n", "signature").mapInArrow(scatter, B.FRAGMENT).groupBy("slice").applyInArrow(trimmed(candidates), "a long, b long")
    fps = checkpointed(signed.groupBy("fp").agg(F.min("node").alias("first")))
    n_fps = fps.count()
    first = lambda name: fps.select(F.col("fp").alias(name), F.col("first").alias(f"first_{name}"))
    by_keys = fingerprint_links(fps, n_fps).join(first("a"), "a").join(first("b"), "b").select("first_a", "first_b")
    by_equal = signed.select("node", "fp").join(fps, "fp").where("node <> first").select("node", "first")
    coarse = checkpointed(connected_components(by_bands.unionAll(by_keys).unionAll(by_equal)))

    def sets(batches):
        for batch in batches:
            node, at = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_index=True)
            for a in range(0, len(node), 1024):
                part = batch.take(pa.array(at[a : a + 1024]))
                found = [shingle_set(w, shingle) for w in _words(part.column(2).cast(pa.binary()).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "root", "n", "shingles"])

    members = base.join(few(coarse, coarse.count()), "node").select("node", "root", "text")
    members = checkpointed(members.mapInArrow(sets, "node long, root long, n long, shingles binary").dropDuplicates(["node"]))
    roots = checkpointed(connected_components(verified_links(members, similarity)))
    return roots


def verified_links(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that connect all members (node, root, n, shingles) of a component whose similarity is enough.

    Each is compared with its component's root first; those alike are one group, so that of a group of near copies, however
    large, only the rest is compared further: in parts, of bounded size, with all members.
    """
    pivots = members.where("node = root").select("root", F.col("shingles").alias("pivot"))
    if (pivots.agg(F.sum(F.octet_length("pivot"))).first()[0] or 0) <= PIVOT_BYTES:
        pivots = F.broadcast(pivots)

    def to_pivot(batches):
        for batch in batches:
            near = []
            for s, p in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                near.append(len(similar_to(np.frombuffer(p, np.uint64), [np.frombuffer(s, np.uint64)], np.array([len(s) // 8]), similarity)) > 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(near, pa.bool_())], ["node", "root", "n", "near"])

    seen = checkpointed(members.join(pivots, "root").select("node", "root", "n", "shingles", "pivot").mapInArrow(to_pivot, "node long, root long, n long, near boolean"))
    rest = F.when(F.col("near"), 0).otherwise(F.col("n") + 1)
    totals = checkpointed(seen.groupBy("root").agg(F.sum(F.col("n") + 1).alias("total"), F.sum(rest).alias("rest")).where("rest > 0"))
    n_tasks = max(1, math.ceil((totals.agg(F.sum("total")).first()[0] or 0) / PART_SHINGLES))
    parts = lambda column: F.greatest(F.ceil(F.col(column) / PART_SHINGLES), F.lit(1)).cast("int")
    placed = seen.join(few(totals, totals.count()), "root").withColumns({"of": parts("total"), "by": parts("rest")})
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    columns = ("node", "root", "near", "of", "by", "asks", "lo", "hi")
    told = placed.withColumns({"asks": F.lit(False), "hi": place("of"), "lo": numbers("by")}).select(*columns)
    asking = placed.where("not near").withColumns({"asks": F.lit(True), "lo": place("by"), "hi": numbers("of")}).select(*columns)
    single = (F.col("of") == 1) & (F.col("by") == 1)
    dealt = told.unionAll(asking).withColumns({"single": single, "g": F.when(single, F.pmod(F.xxhash64("root"), F.lit(n_tasks))).otherwise(F.col("root"))})
    dealt = dealt.join(members.select("node", "shingles"), "node").select("node", "root", "near", "asks", "shingles", "g", "single", "lo", "hi")

    def verify(table: pa.Table) -> pa.Table:
        node, root, near, asks = (np.asarray(table[c]) for c in ("node", "root", "near", "asks"))
        packed = table["shingles"].to_pylist()
        links: list[tuple[int, int]] = []
        order = np.lexsort((node, root))
        for part in np.split(order, np.flatnonzero(np.diff(root[order])) + 1) if len(order) else []:
            told, asking = part[~asks[part]], part[asks[part]]
            own = [np.frombuffer(packed[i], np.uint64) for i in told]
            size = np.array([len(s) for s in own], np.int64)
            for i in asking:
                hit = told[similar_to(np.frombuffer(packed[i], np.uint64), own, size, similarity)]
                group = hit[near[hit]][:1]  # one link with the root's group is as good as many
                links += [(int(node[i]), int(node[j])) for j in (*group, *hit[~near[hit]]) if node[i] != node[j]]
        links_ = stars(np.array(links, np.int64).reshape(-1, 2))
        return pa.table({"a": pa.array(links_[:, 0], pa.int64()), "b": pa.array(links_[:, 1], pa.int64())})

    further = dealt.groupBy("g", "single", "lo", "hi").applyInArrow(trimmed(verify), "a long, b long")
    return seen.where("near and node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(further)


def near_duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id): component_id is the smallest doc_id that links of near_duplicate_classes reach.

    A-Z are lower-cased, words are those of simhash_groups. Equal texts are one group, and so are all texts without words, null
    and empty ones included. Rows of one id share its groups; rows without an id get none. Empty tables give empty results;
    other columns are not read.
    """
    roots = near_duplicate_classes(docs, text, shingle, similarity)
    own = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit(""))).alias("h")).where("doc_id is not null")
    own = own.join(roots, own["h"] == roots["node"], "left").select("doc_id", F.coalesce("root", "h").alias("root"))
    return own.join(own.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")
