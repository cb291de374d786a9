"""The block exchange: how a corpus-wide "who else has this key?" is answered without shipping every key as a row.

Documents are dealt once into *blocks* (consecutive ranges of doc_id of bounded size). A block is the unit of Python
work: it emits its keys as a few packed *fragments*, one per *slice* of the key space; a slice is merged in one bounded
task, and what the slice finds travels back to the blocks that hold the keys. The text crosses the network once (all
later uses of the blocked documents are the same exchange, which Spark reuses), fragments are 2-10 bytes a key, and no
driver, broadcast or single task ever holds more than one slice or one block.

A hot key costs each block one entry (blocks deduplicate their own keys), so copies can't make a slice large.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.frames import trimmed

BLOCK_BYTES = 3 << 20
"""Bytes of text a block aims at; one document larger than this makes a block of its own size."""

SLICE_KEYS = 1_000_000
"""Keys a slice aims at."""

GROWS_FROM = 64 << 30
"""Bytes of text from which blocks and slices grow."""

SAMPLES = 256
"""Keys per block that place the blocks' boundaries; fewer, 16 at least, as blocks grow."""

FRAGMENT = "block int, slice int, payload binary"


def text_stats(docs: DataFrame, text: str) -> tuple[int, int]:
    """(rows, bytes of text) of the whole table, by one map-side aggregate."""
    row = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
    return int(row["n"] or 0), int(row["b"] or 0)


def growth(size: int) -> float:
    """By how much blocks and slices are larger than usual over an input of so many bytes: beyond GROWS_FROM both grow with
    the square root of the input, so that a fragment keeps its size and there are as many fragments a byte as before."""
    return max(1.0, math.sqrt(size / GROWS_FROM))


def with_block(docs: DataFrame, key: str, text: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int, int]:
    """Adds `block`, a range of `key` (smaller keys, smaller blocks; null counts as the smallest). A key that has the rows of
    several blocks is dealt to as many by a hash of the text.

    Returns the frame, the number of blocks and the bytes of text. The driver holds one boundary per block (they come from
    some keys per block; where they lie changes no result), and the plan holds them as one literal.
    """
    n, size = text_stats(docs, text)
    blocks = max(1, min(n, math.ceil(size / (block_bytes * growth(size)))))
    if blocks == 1:
        return docs.withColumn("block", F.lit(0)), 1, size
    value = F.coalesce(docs[key].cast("long"), F.lit(-(1 << 63)))
    keys = docs.select(value.alias("k"))
    wanted = blocks * max(16, int(SAMPLES / growth(size)))
    if wanted < n:
        keys = keys.sample(wanted / n, 0)
    found = keys.agg(F.percentile_approx("k", F.lit(np.arange(1, blocks) / blocks), wanted)).first()[0]
    cuts = np.array(found or [0], np.int64)
    # two levels of at most sqrt(blocks) comparisons each, instead of one scan of all boundaries for each row
    step = max(1, math.isqrt(len(cuts)))
    coarse = cuts[step::step]
    at = F.size(F.filter(F.lit(coarse), lambda c: c < value)) if len(coarse) else F.lit(0)
    fine = F.size(F.filter(F.slice(F.lit(cuts), F.col("_at") * step + 1, F.lit(step)), lambda c: c < value))
    block = F.col("_at") * step + fine
    often, times = np.unique(cuts, return_counts=True)
    if (times > 1).any():
        nth = F.array_position(F.lit(often[times > 1]), value)
        parts = F.element_at(F.lit(times[times > 1].astype(np.int64)), F.greatest(nth, F.lit(1)).cast("int"))
        block = block + F.when(nth > 0, F.pmod(F.xxhash64(text), parts)).otherwise(0)
    return docs.withColumn("_at", at).withColumn("block", block.cast("int")).drop("_at"), blocks, size


def slices_for(keys: float, size: int = 0) -> int:
    """Slices of so many keys, of an input of so many bytes."""
    return max(8, math.ceil(keys / (SLICE_KEYS * growth(size))))


# --- packed arrays -------------------------------------------------------------------------------------------------


def pack_sorted(keys: np.ndarray) -> bytes:
    """A sorted uint64 array as byte planes of its differences: planes that are all zero are left out."""
    if not len(keys):
        return b""
    delta = np.empty(len(keys), np.uint64)
    delta[0] = keys[0]
    np.subtract(keys[1:], keys[:-1], out=delta[1:])
    first, delta[0] = int(delta[0]), 0
    planes = max(1, (int(delta.max()).bit_length() + 7) // 8)
    view = delta.view(np.uint8).reshape(-1, 8)
    return bytes([planes]) + first.to_bytes(8, "little") + np.ascontiguousarray(view[:, :planes].T).tobytes()


def unpack_sorted(payload: bytes) -> np.ndarray:
    if not payload:
        return np.empty(0, np.uint64)
    planes, raw = payload[0], np.frombuffer(payload, np.uint8, offset=9)
    n = len(raw) // planes
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :planes] = raw.reshape(planes, n).T
    delta = wide.reshape(-1).view(np.uint64)
    delta[0] = int.from_bytes(payload[1:9], "little")
    return np.cumsum(delta, dtype=np.uint64)


def pack_pairs(keys: np.ndarray, more: np.ndarray) -> bytes:
    """Sorted uint64 keys, each with a uint32 beside it."""
    return len(keys).to_bytes(4, "little") + more.astype("<u4").tobytes() + pack_sorted(keys)


def unpack_pairs(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(payload[:4], "little")
    return unpack_sorted(payload[4 + 4 * n :]), np.frombuffer(payload, "<u4", count=n, offset=4)


def slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    """The slice of each uint64 key, monotone in the key: high 32 bits scaled to the number of slices."""
    return ((keys >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)


def fragments(block: int, slices: int, keys: np.ndarray, packed) -> pa.Table:
    """One row per slice that has keys. `keys` are sorted; packed(i, j) packs the keys from i to j."""
    ends = np.searchsorted(slice_of(keys, slices), np.arange(slices + 1, dtype=np.uint64)) if len(keys) else np.zeros(slices + 1, np.int64)
    full = np.flatnonzero(np.diff(ends))
    return pa.table(
        {
            "block": pa.array(np.full(len(full), block, np.int32)),
            "slice": pa.array(full.astype(np.int32)),
            "payload": pa.array([packed(ends[s], ends[s + 1]) for s in full], pa.binary()),
        }
    )


def rows_of(table: pa.Table) -> list[tuple[int, int, bytes]]:
    return list(zip(table["block"].to_pylist(), table["slice"].to_pylist(), table["payload"].to_pylist(), strict=True))


# --- the two merges ------------------------------------------------------------------------------------------------


def merge_cells(fragments_: DataFrame) -> DataFrame:
    """Sketch cells of all blocks -> for each block those of its cells whose merged (saturating) count is two or more."""

    def merge(table: pa.Table) -> pa.Table:
        rows = rows_of(table)
        parts = [unpack_sorted(p) for _, _, p in rows]
        cells = np.sort(np.concatenate(parts))
        repeated = np.unique(cells[1:][cells[1:] == cells[:-1]])
        out = []
        for (block, slice_, _), own in zip(rows, parts, strict=True):
            own = np.unique(own)
            at = np.minimum(np.searchsorted(repeated, own), max(0, len(repeated) - 1))
            if len(repeated) and len(hit := own[repeated[at] == own]):
                out.append((block, slice_, pack_sorted(hit)))
        return _table(out)

    return fragments_.groupBy("slice").applyInArrow(trimmed(merge), FRAGMENT)


def merge_pairs(fragments_: DataFrame, rule: str) -> DataFrame:
    """Exact keys (96 bits) of all blocks -> for each block those of its keys that the rule marks.

    `later`: another block with a smaller number has the key, too. `shared`: the key occurs again, in another block or
    because its block sent it twice. `asked`: it occurs again, and one of the occurrences has the low bit of its second
    part set, which is no part of the key then.
    """

    def merge(table: pa.Table) -> pa.Table:
        rows = rows_of(table)
        parts = [unpack_pairs(p) for _, _, p in rows]
        owner = np.repeat(np.arange(len(rows)), [len(k) for k, _ in parts])
        blocks = np.array([b for b, _, _ in rows], np.int64)[owner]
        keys, more = np.concatenate([k for k, _ in parts]), np.concatenate([m for _, m in parts])
        order = np.lexsort((blocks, more, keys)) if rule == "later" else np.lexsort((more, keys))
        k, m = keys[order], more[order] >> np.uint32(rule == "asked")
        same = np.concatenate([[False], (k[1:] == k[:-1]) & (m[1:] == m[:-1])])
        if rule == "asked":  # by key: the sort has the low bit last
            group = np.cumsum(~same) - 1
            bits = np.bincount(group, weights=more[order] & np.uint32(1))
            same = (bits[group] > 0) & (np.bincount(group)[group] > 1)
        elif rule == "shared":
            same[:-1] |= same[1:]
        marked = np.zeros(len(keys), bool)
        marked[order] = same
        ends = np.cumsum([0] + [len(k) for k, _ in parts])
        out = []
        for i, (block, slice_, _) in enumerate(rows):
            hit = marked[ends[i] : ends[i + 1]]
            if hit.any():
                out.append((block, slice_, pack_pairs(parts[i][0][hit], parts[i][1][hit])))
        return _table(out)

    return fragments_.groupBy("slice").applyInArrow(trimmed(merge), FRAGMENT)


def _table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table(
        {
            "block": pa.array([r[0] for r in rows], pa.int32()),
            "slice": pa.array([r[1] for r in rows], pa.int32()),
            "payload": pa.array([r[2] for r in rows], pa.binary()),
        }
    )


def gathered(table: pa.Table) -> np.ndarray:
    """The cells that came back to a block, sorted (slices are monotone in the cell)."""
    parts = [unpack_sorted(p) for _, _, p in sorted(rows_of(table), key=lambda r: r[1])]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def gathered_pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    parts = [unpack_pairs(p) for _, _, p in sorted(rows_of(table), key=lambda r: r[1])]
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.uint32)
    return np.concatenate([k for k, _ in parts]), np.concatenate([m for _, m in parts])


def isin_sorted(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted table."""
    if not len(table) or not len(values):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def isin_pairs(keys: np.ndarray, more: np.ndarray, t_keys: np.ndarray, t_more: np.ndarray) -> np.ndarray:
    """Whether each (key, more) is among the table's; table keys are sorted and may repeat with other `more`."""
    out = np.zeros(len(keys), bool)
    if not len(t_keys) or not len(keys):
        return out
    at = np.searchsorted(t_keys, keys)
    while True:
        ok = at < len(t_keys)
        here = np.where(ok, at, 0)
        ok &= t_keys[here] == keys
        if not ok.any():
            return out
        out |= ok & (t_more[here] == more)
        at = np.where(ok, at + 1, len(t_keys))


# --- hashing -------------------------------------------------------------------------------------------------------

_RNG = np.random.default_rng(20240607)
BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE2 = np.uint64(0xD1342543DE82EF95 | 1)
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: np.uint64, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _POWERS.get((int(base), inverse))
    if have is None or len(have) < n:
        b = pow(int(base), -1, 1 << 64) if inverse else int(base)
        grown = np.full(max(n, 1 << 20), b, np.uint64)
        grown[0] = 1
        have = np.multiply.accumulate(grown)
        if n <= 1 << 23:
            _POWERS[int(base), inverse] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """A 64-bit hash of each values[start:end] (uint64 values), by prefix sums of a polynomial modulo 2**64."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(base, len(values) + 1, True)[starts] + (ends - starts).astype(np.uint64))
