"""Removal of byte strings that occur more than once, by prefix-free parsing.

Every text is cut into *phrases* at trigger positions (where a hash of the next `TRIGGER` bytes has its top bits zero);
a phrase reaches from one trigger to the end of the next one, so phrases overlap by the trigger and no phrase is a
prefix of another. Equal strings are cut alike, wherever they stand. In prefix-free parsing a corpus suffix is ordered
by its offset in a dictionary phrase first and by the parse suffix that follows next; to find strings of `length` bytes
that repeat, that order is needed to depth `length` only, and only up to equality. So:

1. dictionary: phrases that occur once (by a merged sketch that never underestimates) can't be inside a repeated
   string; every start whose string would contain one is settled at once;
2. parse order: for each phrase, the parse suffix truncated to the phrases that cover `length` bytes from the phrase's
   last offset. If the truncated suffix occurs elsewhere, all the starts in the phrase repeat;
3. dictionary offsets: the few starts left (where a repeated stretch begins and ends) are compared one by one with
   the starts, settled or not, whose strings contain the same run of whole phrases at the same offset.

Each step is one block exchange (skyloom.llm.blocks): truncated suffixes are sorted and compared by 96-bit
fingerprints in slices; there is no corpus-wide array in one place.

With `keep_first` a string counts as repeated only where it also starts earlier, so its first occurrence stays: the same
steps, but that a key is marked in the blocks after the first that has it, and in a block from its second occurrence on.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skyloom.llm import blocks as B
from skyloom.llm.frames import trimmed

TRIGGER = 8
"""Bytes of a trigger."""
PHRASE_BITS = 5
"""A phrase is 2**PHRASE_BITS bytes long on average."""
WIDTH = 32
"""Sketch cells per expected phrase."""
PASSAGE = 128
"""Bytes of the shorter repeats that are counted, not removed."""
CHUNK = 1 << 20
_SHORT = np.uint64(0x5851F42D4C957F2D)
"""Tells keys of the shorter repeats from those of truncated suffixes."""
KIND = 1 << 24
"""Slices of the exchanges' answers are told apart by multiples of this."""

TRIGGER_MULTIPLIER = 0xA0761D6478BD642F


def range_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray, second: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """96-bit hashes (64 and 32 bits) of data[start:end]; starts ascend. Works through data in chunks."""
    key, more = np.empty(len(starts), np.uint64), np.zeros(len(starts), np.uint32)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = int(np.searchsorted(starts, a + CHUNK))
        raw = B.BYTE_CODE[np.frombuffer(data, np.uint8, int(ends[i:j].max()) - a, a)]
        s, e = starts[i:j] - a, ends[i:j] - a
        key[i:j] = B.runs_hash(raw, s, e, B.BASE)
        if second:
            more[i:j] = B.runs_hash(raw, s, e, B.BASE2) >> np.uint64(32)
        i = j
    return key, more


class Parse:
    """The documents of a block as one byte string, in order of (doc_id, text), with the triggers of each document."""

    def __init__(self, table: pa.Table, length: int):
        ids, texts = table["doc_id"].to_pylist(), [t or b"" for t in table["text"].cast(pa.binary()).to_pylist()]
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
        self.ids, texts = [ids[i] for i in self.order], [texts[i] for i in self.order]
        self.length, self.data = length, b"".join(texts)
        self.bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        n, found = len(self.data), []
        for a in range(0, max(0, n - TRIGGER + 1), CHUNK):
            size = min(CHUNK, n - TRIGGER + 1 - a)
            v = np.ndarray((size,), "<u8", self.data, a, (1,))
            found.append(a + np.flatnonzero((v * np.uint64(TRIGGER_MULTIPLIER)) >> np.uint64(64 - PHRASE_BITS) == 0))
        at = np.concatenate(found) if found else np.empty(0, np.int64)
        doc = np.searchsorted(self.bounds, at, "right") - 1
        inside = at + TRIGGER <= self.bounds[doc + 1]
        self.trigger, self.doc = at[inside], doc[inside]
        # phrase k: from trigger k to the end of trigger k + 1, where both are in one document
        linked = self.doc[1:] == self.doc[:-1]
        self.phrase = np.flatnonzero(linked)
        self.start, self.end = self.trigger[self.phrase], self.trigger[self.phrase + 1] + TRIGGER

    def contexts(self, need: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Which phrases have a truncated parse suffix, and where it ends: it covers `length` bytes from each start in
        [start, next trigger), or all bytes before `need`."""
        if need is None:
            need = self.trigger[self.phrase + 1] - 1 + self.length
        last = np.searchsorted(self.trigger, need - TRIGGER)
        ok = last < len(self.trigger)
        ok[ok] &= self.doc[last[ok]] == self.doc[self.phrase[ok]]
        which = np.flatnonzero(ok)
        return which, self.trigger[last[which]] + TRIGGER

    def runs(self, possible: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts grouped by the run of whole phrases in their strings: the starts, where each group begins among them,
        whether it has a run at all (two triggers or more aren't needed, one is), and the run's key."""
        at = np.flatnonzero(possible)
        before = np.zeros(len(self.data) + 1, np.int32)
        before[self.trigger + 1] = 1
        np.cumsum(before, out=before)
        a, z = before[at], before[at + self.length - TRIGGER + 1] - 1
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (z[1:] != z[:-1])])) if len(at) else np.empty(0, np.int64)
        a, z = a[first], z[first]
        full = a <= z
        key, more = np.zeros(len(first), np.uint64), np.zeros(len(first), np.uint32)
        key[full], more[full] = range_hashes(self.data, self.trigger[a[full]], self.trigger[z[full]] + TRIGGER)
        return at, first, full, key, more

    def marks(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Positions of the byte string that one of the ranges [lo, hi) covers."""
        steps = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(steps, lo, 1)
        np.add.at(steps, hi, -1)
        return np.cumsum(steps[:-1], dtype=np.int32) > 0


def repeats_of(key: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Which of the pairs, in order, were there before."""
    order = np.lexsort((more, key))  # stable: equal pairs stay in order
    k, m = key[order], more[order]
    out = np.zeros(len(key), bool)
    out[order[1:]] = (k[1:] == k[:-1]) & (m[1:] == m[:-1])
    return out


def _union(*answers: DataFrame) -> DataFrame:
    out = None
    for kind, df in enumerate(answers):
        df = df.withColumn("slice", F.col("slice") + F.lit(kind * KIND))
        out = df if out is None else out.unionAll(df)
    return out


def _kind(back: pa.Table, kind: int) -> pa.Table:
    return back.filter(pa.array(np.asarray(back["slice"]) // KIND == kind, pa.bool_())) if back.num_rows else back


RESULT = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "kept_text")


def remove_repeated_strings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400, with_text: bool = False, keep: list[str] | None = None, keep_first: bool = False, passage: int | None = None) -> DataFrame:
    """Removes each byte (UTF-8) that a `length`-byte string covers which also starts anywhere else, in the same text or
    in another; with keep_first, each that one covers which also starts earlier (smaller id, or earlier in the same text).
    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, n_repeated, kept_text (bytes of a
    character that was cut are left out of it) and the columns in `keep`, but those that are named like a result.

    n_repeated tells of shorter repeats, which are not removed: the bytes of runs of whole phrases, `passage` bytes long or
    more, that also occur elsewhere (a repeated string holds such a run but for some 30 bytes at each end).

    Null texts count as empty; texts shorter than `length` keep every byte. Repeated rows are separate texts, so long
    ones remove each other whole, or all but one with keep_first. Of rows with one id those of a smaller text come first
    within a block, blocks being chosen by a hash of the text; a null id counts as the smallest. Empty tables give empty
    results; other columns are not read. Trigger-free stretches of any length are settled by step 3, start by start.
    """
    if passage is not None and keep_first:
        raise ValueError("shorter repeats are counted whether they are the first or not")
    keep = [c for c in keep or [] if c not in (doc_id, text, *RESULT)]
    kept_as = {c: f"kept_{i}" for i, c in enumerate(keep)}  # names that clash with none of those used here
    base = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"), *[docs[c].alias(a) for c, a in kept_as.items()])
    blocked, _, size = B.with_block(base, "doc_id", "text")
    expected = max(1.0, size / 2**PHRASE_BITS)
    bits, slices = max(20, int(expected * WIDTH).bit_length()), B.slices_for(expected, size)
    low = np.uint64(64 - bits)

    def cells(p: Parse) -> np.ndarray:
        return range_hashes(p.data, p.start, p.end, second=False)[0] >> low

    def sketch(table: pa.Table) -> pa.Table:
        own = np.sort(cells(Parse(table, length)))
        keep = np.ones(len(own), bool)
        keep[2:] = own[2:] != own[:-2]
        own = own[keep]
        return B.fragments(table["block"][0].as_py(), slices, own << low, lambda i, j: B.pack_sorted(own[i:j]))

    def sent(block: int, key: np.ndarray, more: np.ndarray, times: int = 2) -> pa.Table:
        """Each key once, or twice where the block has it several times and that matters."""
        order = np.lexsort((more, key))
        key, more = key[order], more[order]
        keep = np.ones(len(key), bool)
        keep[times:] = (key[times:] != key[:-times]) | (more[times:] != more[:-times])
        key, more = key[keep], more[keep]
        return B.fragments(block, slices, key, lambda i, j: B.pack_pairs(key[i:j], more[i:j]))

    def marked(key: np.ndarray, more: np.ndarray, back: pa.Table, kind: int) -> np.ndarray:
        """Which keys of a block, in the order of their places, occur elsewhere (or earlier)."""
        out = B.isin_pairs(key, more, *B.gathered_pairs(_kind(back, kind)))
        return out | repeats_of(key, more) if keep_first else out

    def contexts_of(p: Parse, repeated: np.ndarray, need: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Phrases whose truncated suffix has only phrases that are estimated repeated, and where it ends."""
        which, end = p.contexts(need)
        bad = np.concatenate([[0], np.cumsum(~repeated)])
        inside = np.searchsorted(p.end, end, "right")
        ok = bad[inside] == bad[which]
        return which[ok], end[ok]

    def short_runs(p: Parse, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, key, more) of the runs of whole phrases that are the shorter repeats."""
        which, end = contexts_of(p, repeated, p.start + passage)
        key, more = range_hashes(p.data, p.start[which], end)
        return p.start[which], end, key ^ _SHORT, more

    def parse_order(table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows or not back.num_rows:
            return sent(0, np.empty(0, np.uint64), np.empty(0, np.uint32))
        p = Parse(table, length)
        repeated = B.isin_sorted(cells(p), B.gathered(_kind(back, 0)))
        which, end = contexts_of(p, repeated)
        return sent(table["block"][0].as_py(), *range_hashes(p.data, p.start[which], end), times)

    def settle(p: Parse, back: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """(starts that repeat by step 2, starts left for step 3), both as masks."""
        repeated = B.isin_sorted(cells(p), B.gathered(_kind(back, 0)))
        which, end = contexts_of(p, repeated)
        hit = which[marked(*range_hashes(p.data, p.start[which], end), back, 1)]
        settled = p.marks(p.start[hit], p.trigger[p.phrase[hit] + 1])
        lo, hi = p.bounds[:-1], p.bounds[1:] - length + 1
        left = p.marks(lo[hi > lo], hi[hi > lo]) & ~settled
        once_s, once_e = p.start[~repeated], p.end[~repeated]
        lo = np.maximum(once_e - length, p.bounds[p.doc[p.phrase[~repeated]]])
        fits = lo <= once_s
        left &= ~p.marks(lo[fits], once_s[fits] + 1)
        return settled, left

    def runs(table: pa.Table, back: pa.Table) -> pa.Table:
        """The runs of whole phrases in possible strings; the low bit of `more` says that a start is left to settle."""
        if not table.num_rows:
            return sent(0, np.empty(0, np.uint64), np.empty(0, np.uint32))
        p = Parse(table, length)
        settled, left = settle(p, back)
        at, first, full, key, more = p.runs(settled | left)
        open_ = np.logical_or.reduceat(left[at], first) if len(first) else np.empty(0, bool)
        return sent(table["block"][0].as_py(), key[full], ((more & ~np.uint32(1)) | open_)[full])

    def compared(p: Parse, back: pa.Table, possible: np.ndarray) -> np.ndarray:
        """The starts that step 3 compares: those whose run of whole phrases is that of a start that is left."""
        at, first, full, key, more = p.runs(possible)
        keys, flags = B.gathered_pairs(_kind(back, 2))
        asked = ~full | B.isin_pairs(key, more & ~np.uint32(1), keys, flags & ~np.uint32(1))
        return at[np.repeat(asked, np.diff(np.append(first, len(at))))]

    def offsets(table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows:
            return sent(0, np.empty(0, np.uint64), np.empty(0, np.uint32))
        p = Parse(table, length)
        settled, left = settle(p, back)
        at = compared(p, back, settled | left)
        key, more = range_hashes(p.data, at, at + length)
        if passage is not None:  # with the last keys, as only the last step asks for them
            _, _, k, m = short_runs(p, B.isin_sorted(cells(p), B.gathered(_kind(back, 0))))
            key, more = np.concatenate([key, k]), np.concatenate([more, m])
        return sent(table["block"][0].as_py(), key, more, times)

    def remove(table: pa.Table, back: pa.Table) -> pa.Table:
        p = Parse(table, length)
        settled, left = settle(p, back)
        # in a block the first occurrence may be a start that is settled
        at = compared(p, back, settled | left) if keep_first else np.flatnonzero(left)
        settled[at[marked(*range_hashes(p.data, at, at + length), back, 3)]] = True
        at = np.flatnonzero(settled)
        gone = p.marks(at, at + length)
        short = None
        if passage is not None:
            start, end, key, more = short_runs(p, B.isin_sorted(cells(p), B.gathered(_kind(back, 0))))
            hit = marked(key, more, back, 3)
            short = np.concatenate([[0], np.cumsum(p.marks(start[hit], end[hit]))])
        view = memoryview(p.data)
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []} | ({} if short is None else {"n_repeated": []})
        kept_text = []
        for a, b in zip(p.bounds[:-1].tolist(), p.bounds[1:].tolist(), strict=True):
            g = np.concatenate([[False], gone[a:b], [False]])
            edges = np.flatnonzero(g[1:] != g[:-1])
            cut = np.concatenate([[0], edges, [b - a]]) + a
            kept = b"".join(view[x:y] for x, y in zip(cut[0::2].tolist(), cut[1::2].tolist(), strict=True))
            out["n_bytes"].append(b - a)
            out["n_removed"].append(b - a - len(kept))
            out["n_spans"].append(len(edges) // 2)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if short is not None:
                out["n_repeated"].append(int(short[b] - short[a]))
            if with_text:
                kept_text.append(kept.decode("utf-8", "ignore"))
        cols = {"doc_id": pa.array(p.ids, pa.int64())} | {k: pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items()}
        return pa.table(cols | ({"kept_text": pa.array(kept_text, pa.string())} if with_text else {}) | {a: table[a].take(pa.array(p.order, pa.int64())) for a in kept_as.values()})

    times, rule = (1, "later") if keep_first else (2, "shared")

    by_block = blocked.groupBy("block")
    dictionary = B.merge_cells(by_block.applyInArrow(trimmed(sketch), B.FRAGMENT))
    ordered = B.merge_pairs(by_block.cogroup(_union(dictionary).groupBy("block")).applyInArrow(trimmed(parse_order), B.FRAGMENT), rule)
    asked = B.merge_pairs(by_block.cogroup(_union(dictionary, ordered).groupBy("block")).applyInArrow(trimmed(runs), B.FRAGMENT), "asked")
    single = B.merge_pairs(by_block.cogroup(_union(dictionary, ordered, asked).groupBy("block")).applyInArrow(trimmed(offsets), B.FRAGMENT), rule)
    answers = _union(dictionary, ordered, asked, single)
    schema = StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", n_repeated long" if passage is not None else "") + (", kept_text string" if with_text else ""))
    own = [*schema.names]
    for c, a in kept_as.items():
        schema = schema.add(a, base.schema[a].dataType)
    found = by_block.cogroup(answers.groupBy("block")).applyInArrow(trimmed(remove), schema)
    return found.select(*own, *[F.col(a).alias(c) for c, a in kept_as.items()])
