"""Near-duplicate embeddings by cross-polytope hashing.

A hash rotates a vector by three rounds of random signs and the fast Hadamard transform and takes the axis of the
largest coordinate with its sign. A table's key is ROTATIONS such hashes; a vector is filed under its key and, as
multiprobe, under each key in which one hash is that of the second largest coordinate. With TABLES tables a pair of
cosine 0.95 shares a key with a chance of about 0.998, a pair of 0.97 or more nearly always.

Candidates are verified by their cosine in double precision. Equal vectors are one node from the start; a key's group
gives a spanning forest of its links, not all pairs. The links of a vector are then counted exactly inside its
component, by blocks, so the count doesn't depend on which tables found what.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm import blocks as B
from skyloom.llm.components import connected_components, stars
from skyloom.llm.frames import checkpointed

TABLES = 6
ROTATIONS = 3
COSINE = 0.95
BLOCK = 2048
"""Different vectors of a component that are compared with as many others in one task at most."""
SLICE_KEYS = 60_000
DENSE = 48


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row (a power of two long), scaled to keep lengths."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def keys_of(unit: np.ndarray, seed: int = 7) -> np.ndarray:
    """(n, TABLES * (1 + ROTATIONS)) keys of unit vectors."""
    n, d = unit.shape
    wide = 1 << max(1, (d - 1).bit_length())
    x = np.zeros((n, wide))
    x[:, :d] = unit
    rng, out = np.random.default_rng([seed, d]), []
    rows = np.arange(n)[:, None]
    for table in range(TABLES):
        best, second = [], []
        for _ in range(ROTATIONS):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], wide))
            top = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            swap = np.abs(y[rows, top])
            top = np.where(swap[:, :1] >= swap[:, 1:], top, top[:, ::-1])
            code = (top * 2 + (y[rows, top] < 0)).astype(np.uint64)
            best.append(code[:, 0])
            second.append(code[:, 1])
        for probe in range(-1, ROTATIONS):
            key = np.full(n, (d << 8) | table, np.uint64)
            for i in range(ROTATIONS):
                key = key * np.uint64(2 * wide + 1) + (second if i == probe else best)[i]
            out.append(B.mix(key))
    return np.stack(out, axis=1)


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """Rows of equally long packed vectors."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1).astype(dtype, copy=False)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # lengths beyond a double's range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(packed: list[bytes]) -> list[np.ndarray]:
    """Row numbers of the vectors of each length: vectors of different lengths link with nothing of each other."""
    size = np.fromiter(map(len, packed), np.int64, len(packed))
    return [np.flatnonzero(size == s) for s in np.unique(size)]


def forest(key: np.ndarray, row: np.ndarray, u: np.ndarray, cosine: float) -> np.ndarray:
    """Pairs of rows of u that share a key and have the cosine: all in small groups, a spanning forest in large ones."""
    order = np.lexsort((row, key))
    key, row = key[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    count, out = np.diff(np.append(first, len(key))), []
    small = np.repeat((count > 1) & (count <= DENSE), count)
    k, r, step = key[small], row[small], 1
    while len(k) > step:
        same = np.flatnonzero(k[step:] == k[:-step])
        if not len(same):
            break
        for a in range(0, len(same), 1 << 16):
            i, j = r[same[a : a + (1 << 16)]], r[same[a : a + (1 << 16)] + step]
            near = np.einsum("ij,ij->i", u[i], u[j]) >= cosine
            out.append(np.column_stack([i[near], j[near]]))
        step += 1
    for g in np.flatnonzero(count > DENSE):
        left = np.unique(row[first[g] : first[g] + count[g]])
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                x = queue.pop()
                near = u[left] @ u[x] >= cosine
                if near.any():
                    reached, left = left[near], left[~near]
                    out.append(np.column_stack([np.full(len(reached), x), reached]))
                    queue.extend(reached)
    return np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)


def near_links(classes: DataFrame, n: int, cosine: float = COSINE) -> DataFrame:
    """(a, b): links between different vectors that connect all that share a key and have the cosine. classes: (cid
    long, vec array<double>); n, their number, only sets how many slices the keys are dealt to."""
    slices = max(8, math.ceil(n * TABLES * (1 + ROTATIONS) / SLICE_KEYS))

    def scatter(batches):
        for batch in batches:
            cid = batch.column(0).to_numpy(zero_copy_only=False)
            packed = [np.asarray(v, "<f8").tobytes() for v in batch.column(1).to_pylist()]
            for same in _by_length(packed):
                for a in range(0, len(same), 2048):
                    part = same[a : a + 2048]
                    x = np.frombuffer(b"".join(packed[i] for i in part), "<f8").reshape(len(part), -1)
                    keys = keys_of(unit(x))
                    key, row = keys.ravel(), np.repeat(np.arange(len(part)), keys.shape[1])
                    order = np.argsort(key)
                    key, row = key[order], row[order]
                    ids = cid[part]
                    narrow = x.astype("<f4").astype("<f8").tobytes() == x.tobytes()  # floats go as floats

                    def pack(i, j, key=key, row=row, ids=ids, x=x, narrow=narrow):
                        used, at = np.unique(row[i:j], return_inverse=True)
                        body = x[used].astype("<f4" if narrow else "<f8").tobytes()
                        head = np.array([len(used), j - i, x.shape[1], narrow], "<i4").tobytes()
                        return head + at.astype("<i4").tobytes() + ids[used].astype("<i8").tobytes() + body + key[i:j].tobytes()

                    yield from B.fragments(0, slices, key, pack).to_batches()

    def verify(table: pa.Table) -> pa.Table:
        by_size: dict[int, list] = {}
        for p in table["payload"].to_pylist():
            n_used, n_keys, d, narrow = np.frombuffer(p, "<i4", 4).tolist()
            at, o = np.frombuffer(p, "<i4", n_keys, 16), 16 + 4 * n_keys
            ids = np.frombuffer(p, "<i8", n_used, o)
            o += 8 * n_used
            x = np.frombuffer(p, "<f4" if narrow else "<f8", n_used * d, o).reshape(n_used, d).astype(np.float64)
            o += (4 if narrow else 8) * n_used * d
            by_size.setdefault(d, []).append((at, ids, x, np.frombuffer(p[o:], np.uint64)))
        links = [np.empty((0, 2), np.int64)]
        for parts in by_size.values():
            shift = np.cumsum([0] + [len(p[1]) for p in parts])
            row = np.concatenate([p[0] + s for p, s in zip(parts, shift)])
            ids, u = np.concatenate([p[1] for p in parts]), unit(np.concatenate([p[2] for p in parts]))
            links.append(ids[forest(np.concatenate([p[3] for p in parts]), row, u, cosine)])
        out = stars(np.concatenate(links))
        return pa.table({"a": pa.array(out[:, 0]), "b": pa.array(out[:, 1])})

    return classes.select("cid", "vec").mapInArrow(scatter, B.FRAGMENT).groupBy("slice").applyInArrow(verify, "a long, b long")


def counted(members: DataFrame, cosine: float = COSINE) -> DataFrame:
    """members: (root, cid, copies, vec) of the components with several different vectors -> (cid, others): how many
    vectors, copies counted, each is linked with besides its own copies."""
    size = members.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    placed = members.join(size, "root").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # small components share groups of a bounded number; a large one has a group for each two of its blocks
    few = max(1, math.ceil(members.count() / BLOCK))
    placed = placed.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    placed = placed.withColumn("g", F.when(F.col("parts") == 1, F.pmod(F.xxhash64("root"), F.lit(few))).otherwise(F.col("root"))).withColumn("single", F.col("parts") == 1)

    def count(table: pa.Table) -> pa.Table:
        cid, copies = np.asarray(table["cid"]), np.asarray(table["copies"])
        root, own = np.asarray(table["root"]), np.asarray(table["own"])
        lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
        packed = [np.asarray(v, "<f8").tobytes() for v in table["vec"].to_pylist()]
        total = np.zeros(len(cid), np.int64)
        for same in _by_length(packed):
            u = unit(np.frombuffer(b"".join(packed[i] for i in same), "<f8").reshape(len(same), -1))
            order = np.argsort(root[same], kind="stable")
            r = root[same][order]
            cuts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1], [True]]))
            for a, b in zip(cuts[:-1], cuts[1:]):
                at = order[a:b]
                left, right = (at, at) if lo == hi else (at[own[same[at]] == lo], at[own[same[at]] == hi])
                for i in range(0, len(left), 512):
                    l = left[i : i + 512]
                    near = u[l] @ u[right].T >= cosine
                    if lo == hi:
                        near[np.arange(len(l)), np.arange(i, i + len(l))] = False
                    total[same[l]] += near @ copies[same[right]]
                    if lo != hi:
                        total[same[right]] += near.T @ copies[same[l]]
        return pa.table({"cid": pa.array(cid), "n": pa.array(total)})

    parts = placed.select("g", "single", "lo", "hi", "root", "own", "cid", "copies", "vec").groupBy("g", "single", "lo", "hi").applyInArrow(count, "cid long, n long")
    return parts.groupBy("cid").agg(F.sum("n").alias("others"))


def near_duplicate_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: other rows at the cosine or above, the smallest vec_id that
    links reach, and whether that is the row's own.

    Null and empty vectors, zero vectors and those with null or non-finite components link with nothing, and so do rows
    without an id (their component is null and they aren't kept). Vectors of different lengths don't link. Equal vectors
    and repeated rows link with each other. Empty tables give empty results; other columns, labels included, are not read.
    """
    v = F.col(embedding).cast("array<double>")
    rows = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), F.transform(v, lambda x: x + F.lit(0.0)).alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    ok = F.coalesce(fine & F.col("vec_id").isNotNull(), F.lit(False))
    marked = rows.withColumn("ok", ok)
    keyed = marked.withColumns({"h1": F.when(F.col("ok"), F.xxhash64("vec")), "h2": F.when(F.col("ok"), F.xxhash64(F.lit(1), F.col("vec")))})
    classes = checkpointed(keyed.where("ok").groupBy("h1", "h2").agg(F.min("vec_id").alias("cid"), F.count("*").alias("copies"), F.first("vec").alias("vec")))
    links = near_links(classes, classes.count(), cosine)
    roots = checkpointed(connected_components(links))
    members = classes.join(roots, classes["cid"] == roots["node"]).select("root", "cid", "copies", "vec")
    others = counted(members, cosine)
    label = classes.select("h1", "h2", "cid", "copies").join(roots.withColumnRenamed("node", "cid"), "cid", "left").join(others, "cid", "left")
    label = label.select("h1", "h2", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("root", "cid").alias("component"))
    out = keyed.select("vec_id", "h1", "h2").join(label, ["h1", "h2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
