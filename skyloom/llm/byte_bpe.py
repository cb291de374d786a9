"""Byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token's symbols form a linked list. Each merge rank has a bucket with the list positions whose pair has that rank;
a two-level bitmap tells which buckets have entries, so the next rank to merge is found by two find-first-set steps
whatever the pre-token's length. Entries go stale when a neighbour merges; they are recognised and skipped when popped.
A pre-token of n bytes costs O(n) queue operations, so one of millions of bytes is no special case.

Short pre-tokens share one queue: all different new ones of a batch are laid out in one list with barriers between
them, and a rank's bucket is merged in all of them at once (`merge_many`). That is the order of each pre-token by
itself, as a bucket takes the leftmost position of each only and then asks the bitmap for the lowest rank again.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

CACHE = 250_000
"""Once a worker knows the ids of so many pre-tokens and space-delimited stretches, it starts a new generation and keeps
one older; a generation holds these and those of one group of texts more. The ids don't depend on it."""

LONG = 128
"""Bytes beyond which a pre-token has a queue of its own."""

GROUP_BYTES = 12 << 20
"""Bytes of text that a worker takes at once."""

WHITE = r"\t-\r \x85\xa0  -     　"
"""Unicode's white space, which \\s means in the pattern (Python's \\s also has the separators U+001C to U+001F)."""


def in_class(pattern: str) -> bool:
    """Whether \\s or \\S stands inside a character class."""
    depth, i = 0, 0
    while i < len(pattern):
        if pattern[i] == "\\":
            if depth and pattern[i + 1 : i + 2] in ("s", "S"):
                return True
            i += 1
        elif pattern[i] == "[":
            depth += 1
        elif pattern[i] == "]" and depth:
            depth -= 1
        i += 1
    return False


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if in_class(pattern.replace("[^\\s", "[^")):
            raise ValueError("\\s and \\S inside a character class are understood right after [^ only, and only \\s")
        pattern = pattern.replace("[^\\s", f"[^{WHITE}")
        self.pattern = regex.compile(pattern.replace("\\S", f"[^{WHITE}]").replace("\\s", f"[{WHITE}]"))
        # two white-space characters in a row of which one is a space, or any but space and newline: no shortcut
        self.tricky = ["  ", " \n", "\n ", *(c for c in map(chr, range(0x3001)) if c not in " \n" and regex.match(f"[{WHITE}]", c))]
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    self.pairs[a << 20 | b] = rank
        flat = sorted(self.pairs.items())
        self.pair_keys = np.array([k for k, _ in flat], np.int64)
        self.pair_ranks = np.array([r for _, r in flat], np.int32)
        self.single_array = np.array(self.single, np.int32)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token: always the lowest rank first, and the leftmost of its positions."""
        pairs, n = self.pairs, len(piece)
        single = self.single
        ids = [single[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        buckets: dict[int, list[int]] = {}
        words: dict[int, int] = {}
        top = 0
        for i in range(n - 1):
            if (r := pairs.get(ids[i] << 20 | ids[i + 1])) is not None:
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    words[r >> 8] = words.get(r >> 8, 0) | 1 << (r & 255)
                    top |= 1 << (r >> 8)
        while top:
            w = (top & -top).bit_length() - 1
            word = words[w]
            r = w << 8 | (word & -word).bit_length() - 1
            bucket = buckets[r]
            i = heappop(bucket)
            if not bucket:
                del buckets[r]
                word &= word - 1
                words[w] = word
                if not word:
                    top &= top - 1
            j = after[i]
            if j >= n or ids[i] < 0 or pairs.get(ids[i] << 20 | ids[j]) != r:
                continue  # stale
            ids[i], ids[j] = r, -1
            k = after[i] = after[j]
            p = before[i]
            if k < n:
                before[k] = i
                if (q := pairs.get(r << 20 | ids[k])) is not None:
                    if q in buckets:
                        heappush(buckets[q], i)
                    else:
                        buckets[q] = [i]
                        words[q >> 8] = words.get(q >> 8, 0) | 1 << (q & 255)
                        top |= 1 << (q >> 8)
            if p >= 0 and (q := pairs.get(ids[p] << 20 | r)) is not None:
                if q in buckets:
                    heappush(buckets[q], p)
                else:
                    buckets[q] = [p]
                    words[q >> 8] = words.get(q >> 8, 0) | 1 << (q & 255)
                    top |= 1 << (q >> 8)
        return [x for x in ids if x >= 0]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for none (and where a symbol is -1)."""
        key = (a.astype(np.int64) << 20) | b
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of each pre-token, by one queue for all of them."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        n = int(bounds[-1])
        sym = np.full(n + 1, -1, np.int32)  # position n stands for what is beyond a pre-token's ends
        sym[:n] = self.single_array[np.frombuffer(b"".join(pieces), np.uint8)]
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[bounds[1:] - 1] = n
        before[bounds[:-1]] = n
        owner = np.repeat(np.arange(len(pieces)), lengths)
        current = np.full(n + 1, -1, np.int32)  # the rank of the pair that begins here; an entry of another rank is stale
        current[:n] = self._ranks(sym[:n], sym[after[:n]])
        buckets: dict[int, list[np.ndarray]] = {}
        words: dict[int, int] = {}
        top = 0

        def push(positions: np.ndarray, ranks: np.ndarray) -> None:
            nonlocal top
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            begin = 0
            firsts = [int(ranks[0]), *ranks[cuts].tolist()]
            for r, end in zip(firsts, [*cuts.tolist(), len(ranks)]):
                if r in buckets:
                    buckets[r].append(positions[begin:end])
                else:
                    buckets[r] = [positions[begin:end]]
                    w = r >> 8
                    words[w] = words.get(w, 0) | 1 << (r & 255)
                    top |= 1 << w
                begin = end

        some = np.flatnonzero(current >= 0)
        if len(some):
            push(some, current[some])
        while top:
            w = (top & -top).bit_length() - 1
            word = words[w]
            r = w << 8 | (word & -word).bit_length() - 1
            entries = buckets.pop(r)
            word &= word - 1
            words[w] = word
            if not word:
                top &= top - 1
            at = entries[0] if len(entries) == 1 else np.unique(np.concatenate(entries))
            at = at[current[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                own = owner[at]
                again = np.flatnonzero(own[1:] == own[:-1]) + 1
                if len(again):  # the rest of a pre-token waits until its lower ranks are done
                    buckets[r] = [at[again]]
                    words[w] = words[w] | 1 << (r & 255)
                    top |= 1 << w
                    at = np.delete(at, again)
            j = after[at]
            k = after[j]
            sym[at] = r
            current[j] = -1
            sym[j] = -1
            after[at] = k
            before[k] = at
            p = before[at]
            left = self._ranks(sym[p], sym[at])
            right = self._ranks(sym[at], sym[k])
            current[at] = right
            current[p] = left
            sym[n] = current[n] = -1
            where, ranks = np.concatenate([at, p]), np.concatenate([right, left])
            fresh = ranks >= 0
            if fresh.any():
                push(where[fresh], ranks[fresh])
        left = sym[:n] >= 0
        ends = np.concatenate([[0], np.cumsum(left)])[bounds] * 4
        packed = sym[:n][left].astype("<u4").tobytes()
        ends = ends.tolist()
        return [packed[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def learn(self, texts: list[str]) -> None:
        """Makes known the stretches and pre-tokens of the texts."""
        if len(self.known) >= CACHE:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new: set[str] = set()
        for text in texts:
            new.update(self._stretches(text))
        split: dict[str, list[str]] = {}
        merge: dict[str, bytes] = {}
        for x in new.difference(known):
            if x in older:
                known[x] = older[x]
                continue
            split[x] = pieces = self.pattern.findall(x)
            for piece in pieces:
                if piece not in known and piece not in merge:
                    if piece in older:
                        known[piece] = older[piece]
                        continue
                    raw = piece.encode()
                    whole = self.ranks.get(raw)
                    if whole is not None:
                        known[piece] = whole.to_bytes(4, "little")
                    elif len(raw) > LONG:
                        ids = self.merge(raw)
                        known[piece] = struct.pack(f"<{len(ids)}I", *ids)
                    else:
                        merge[piece] = raw
        known.update(zip(merge, self.merge_many(list(merge.values()))))
        for x, pieces in split.items():
            if len(pieces) != 1:
                known[x] = b"".join([known[p] for p in pieces])

    def _stretches(self, text: str) -> list[str]:
        """A pre-token has white space at its start only or nothing else, and none looks back, so a text may be cut before
        each space between two visible characters. Texts with other white space are one stretch."""
        if any(x in text for x in self.tricky):
            return [text]
        first, *rest = text.split(" ")
        parts = [first, *[" " + x for x in rest]]
        if parts[-1] == " ":  # a space at the end belongs to nothing after it
            parts[-2:] = [parts[-2] + " "]
        if len(parts) > 1 and not first:
            parts[:1] = []
        return parts

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as packed little-endian unsigned 32-bit integers."""
        self.learn(texts)
        known = self.known
        return [b"".join([known[x] for x in self._stretches(text)]) for text in texts]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[tuple[str, str], ByteBPE] = {}


def loaded(path: str, pattern: str) -> ByteBPE:
    """A worker's own copy, kept between batches and tasks."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBPE.load(path, pattern)
    return _LOADED[path, pattern]


def encoded(bpe: ByteBPE, texts: pa.Array):
    """The ids of each text, taken in groups of bounded size (a longer text is a group of its own)."""
    sizes, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)), 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + GROUP_BYTES)))
        yield from bpe.encode_all([t or "" for t in texts[at:stop].to_pylist()])
        at = stop


def encode_decode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes every text and decodes its ids: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids.

    Null texts count as empty (no tokens). There is no shuffle and nothing depends on other rows, so repeated rows,
    null ids and empty tables need no rule; other columns are not read. Texts and pre-tokens may have any length.
    """

    def of(batches):
        bpe = loaded(path, pattern)
        for batch in batches:
            out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            tokens = []
            for ids in encoded(bpe, batch.column(1)):
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if with_ids:
                    tokens.append(np.frombuffer(ids, "<u4").astype(np.int64))
            cols = [batch.column(0), pa.array(out["n_tokens"], pa.int64()), pa.array(out["ids_sha256"], pa.string()), pa.array(out["decoded_sha256"], pa.string())]
            if with_ids:
                cols.append(pa.array(tokens, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *out, *(["ids"] if with_ids else [])])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>" if with_ids else "")
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(of, schema)
