"""Exact removal of repeated word windows, with a count-min prefilter.

Pass 1 gives every block of documents a sparse sketch of its windows (saturating counters, one cell per window and
hash row); sketches are merged slice by slice, and each block learns which of its cells have a merged count of two or
more. A count-min estimate is never too low, so a window that repeats is never lost. Pass 2 sends only the windows
whose every cell is estimated repeated, by a 96-bit key, and decides exactly which of them start earlier elsewhere.

The sketch has `WIDTH` cells per window at any corpus size. In the sparse form a cell costs log2(gap) bits, so doubling
the width costs one bit and adding a row doubles the size: one wide row is the best setting, and the default.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skyloom.llm import blocks as B
from skyloom.llm.frames import trimmed

WIDTH = 32
"""Sketch cells per expected window: a window that occurs once is estimated repeated with a chance of about 1/32."""

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
CHUNK = 1 << 20


def word_hashes(data: bytes) -> np.ndarray:
    """One 64-bit hash for each word ([^\\x20\\x09-\\x0D]+) of data, in order; long data go in chunks cut between words."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        while end < len(data) and not _SEPARATOR[data[end]]:
            end += 1
        raw = np.frombuffer(data, np.uint8, end - at, at)
        word = np.concatenate([[False], ~_SEPARATOR[raw], [False]])
        edges = np.flatnonzero(word[1:] != word[:-1])
        out.append(B.runs_hash(B.BYTE_CODE[raw], edges[0::2], edges[1::2]))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


class Windows:
    """The windows of a block: documents in order of (doc_id, text), windows in order of their start."""

    def __init__(self, table: pa.Table, window: int):
        ids, texts = table["doc_id"].to_pylist(), table["text"].cast(pa.binary()).to_pylist()
        # a null id sorts first; rows of one id go by text, so that repeated rows have a defined order
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i] or b""))
        self.ids, self.texts = [ids[i] for i in order], [texts[i] or b"" for i in order]
        parts, group, size = [], [], 0
        self.counts = np.zeros(len(order), np.int64)
        hashed: list[np.ndarray] = []
        for i, t in enumerate(self.texts):  # many short documents are hashed at once
            group.append(i)
            parts.append(t)
            size += len(t) + 1
            if size >= CHUNK or i + 1 == len(self.texts):
                joined = b"\n".join(parts)
                hashed.append(word_hashes(joined))
                for j, p in zip(group, parts, strict=True):
                    self.counts[j] = len(p.split()) if len(group) > 1 else len(hashed[-1])
                parts, group, size = [], [], 0
        words = np.concatenate(hashed) if hashed else np.empty(0, np.uint64)
        self.first_word = np.concatenate([[0], np.cumsum(self.counts)])
        n = max(0, len(words) - window + 1)
        start = np.arange(n)
        doc = np.repeat(np.arange(len(order)), self.counts)
        self.start = start[doc[: n] == doc[window - 1 : window - 1 + n]] if n else start
        self.key = B.runs_hash(words, self.start, self.start + window, B.BASE)
        self.more = (B.runs_hash(words, self.start, self.start + window, B.BASE2) >> np.uint64(32)).astype(np.uint32)


def remove_repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 20, width: int = WIDTH, rows: int = 1, with_text: bool = False) -> DataFrame:
    """Removes each word that a window covers whose word sequence also starts earlier (smaller id, or earlier in the
    same text). Returns doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    Null or empty texts have no words (n_words 0, the hash of the empty string). Rows with the same id are taken in
    order of their block, chosen by a hash of the text where one id has several, and then of their text; a null id counts as the smallest. Tables may be empty; other columns are not read. A text of
    fewer than `window` words keeps every word. Texts of any length are hashed in chunks of about a megabyte.
    """
    base = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    blocked, _, size = B.with_block(base, "doc_id", "text")
    expected = max(1.0, size / 6)
    bits, slices = max(20, int(expected * width).bit_length()), B.slices_for(expected, size)
    multipliers = [np.uint64(1)] + [np.uint64(2 * m + 1) for m in range(0x51ED270B, 0x51ED270B + rows - 1)]

    def cells(key: np.ndarray, row: int) -> np.ndarray:
        """The window's counter in this row, as a 64-bit number whose high bits choose the slice."""
        return ((key * multipliers[row]) >> np.uint64(64 - bits)) << np.uint64(64 - bits)

    # a slice must hold whole cells: cells are multiples of 2**(64-bits), and slices are ranges of far more of them
    def sketch(table: pa.Table) -> pa.Table:
        key, block = Windows(table, window).key, table["block"][0].as_py()
        out = []
        for row in range(rows):
            own = np.sort(cells(key, row)) >> np.uint64(64 - bits)
            keep = np.ones(len(own), bool)
            keep[2:] = own[2:] != own[:-2]  # counts saturate at two
            own = own[keep]
            if rows == 1:
                out.append(B.fragments(block, slices, own << np.uint64(64 - bits), lambda i, j, own=own: B.pack_sorted(own[i:j])))
            else:
                f = B.fragments(block, slices, own << np.uint64(64 - bits), lambda i, j, own=own: B.pack_sorted(own[i:j]))
                out.append(f.set_column(1, "slice", pa.array(np.asarray(f["slice"]) + np.int32(row * slices), pa.int32())))
        return pa.concat_tables(out)

    def estimated_repeated(w: Windows, back: pa.Table) -> np.ndarray:
        hit = np.ones(len(w.key), bool)
        for row in range(rows):
            part = back.filter(pa.array((np.asarray(back["slice"]) // slices) == row)) if back.num_rows else back
            hit &= B.isin_sorted(cells(w.key, row) >> np.uint64(64 - bits), B.gathered(part))
        return hit

    def candidates(table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows or not back.num_rows:
            return B.fragments(0, slices, np.empty(0, np.uint64), None)
        w = Windows(table, window)
        hit = estimated_repeated(w, back)
        key, more = w.key[hit], w.more[hit]
        order = np.lexsort((more, key))
        key, more = key[order], more[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (more[1:] != more[:-1])]) if len(key) else np.empty(0, bool)
        key, more = key[new], more[new]
        return B.fragments(table["block"][0].as_py(), slices, key, lambda i, j: B.pack_pairs(key[i:j], more[i:j]))

    def remove(table: pa.Table, back: pa.Table) -> pa.Table:
        w = Windows(table, window)
        earlier = B.isin_pairs(w.key, w.more, *B.gathered_pairs(back))
        # within the block: all but the first start of a key
        order = np.lexsort((w.start, w.more, w.key))
        k, m = w.key[order], w.more[order]
        earlier[order[1:]] |= (k[1:] == k[:-1]) & (m[1:] == m[:-1])
        total = int(w.first_word[-1])
        cover = np.zeros(total + 1, np.int32)
        np.add.at(cover, w.start[earlier], 1)
        np.add.at(cover, w.start[earlier] + window, -1)
        gone = np.cumsum(cover)[:total] > 0
        removed, digest, kept = [], [], []
        for i, t in enumerate(w.texts):
            g, words = gone[w.first_word[i] : w.first_word[i + 1]], t.split()
            removed.append(int(g.sum()))
            if removed[-1]:
                words = [x for x, away in zip(words, g.tolist(), strict=True) if not away]
            line = b" ".join(words)
            digest.append(hashlib.sha256(line).hexdigest())
            if with_text:
                kept.append(line.decode("utf-8", "replace"))
        out = {"doc_id": pa.array(w.ids, pa.int64()), "n_words": pa.array(w.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        return pa.table(out | ({"kept_text": pa.array(kept, pa.string())} if with_text else {}))

    by_block = blocked.groupBy("block")
    flagged = B.merge_cells(by_block.applyInArrow(trimmed(sketch), B.FRAGMENT))
    sent = by_block.cogroup(flagged.groupBy("block")).applyInArrow(trimmed(candidates), B.FRAGMENT)
    later = B.merge_pairs(sent, "later")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return by_block.cogroup(later.groupBy("block")).applyInArrow(trimmed(remove), schema)
