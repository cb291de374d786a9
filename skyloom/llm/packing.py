"""Packing by concatenate and cut.

Pass 1 tokenizes every text once and writes the ids, each row with its offset among its partition's tokens; the
partitions' token totals, one number each, are summed up to global offsets. Pass 2 cuts the one long token sequence
into windows of `length`: a document that crosses a boundary becomes several records. Only the last window is short.
There is no shuffle; what the driver sums up and broadcasts is one row per input partition.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.frames import give_back, written

END = 2
LENGTH = 4096
GROUP_BYTES = 8 << 20
"""Bytes of text that a worker takes at once."""
CACHE_WORDS = 120_000
"""Once a worker knows the ids of so many words, it starts a new generation and keeps one older. The ids don't depend
on it."""


class WordIds:
    """The ids of words between ASCII white space, for a tokenizer that drops white space.

    A pre-tokenizer that keeps only what its pattern matches, none of it white space, never lets a token span two words,
    so each different word is encoded once. New words are encoded together in long strings by the tokenizer's model;
    words with control characters or with characters beyond Latin-1, whose normal forms are another matter, go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        kinds = [n["type"] for n in (config["normalizer"] or {}).get("normalizers", [])]
        pre = (config["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        suffix = config["model"].get("end_of_word_suffix")
        if kinds != ["NFC", "Replace", "Lowercase"] or [p.get("type") for p in pre] != ["Split", "ByteLevel"] or not pre[0]["invert"] or not suffix:
            raise ValueError("word by word, only a lower-casing tokenizer that drops white space and marks the ends of words can be used")
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # a text that contains the string of a special token is ordinary text
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.pieces = regex.compile(pre[0]["pattern"]["Regex"]).findall
        size = self.whole.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.zeros(size, bool)
        self.ends[[i for t, i in self.whole.get_vocab().items() if t.endswith(suffix)]] = True
        # byte-level alphabet: visible Latin-1 characters stand for themselves, the other bytes for U+0100 and up
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _encode(self, words: list[str]) -> None:
        """Makes new words known."""
        counts, strings, plain = [], [], []
        for w in words:
            if w.isascii() and w.isprintable():
                pieces = [w] if w.isalpha() else self.pieces(w)
                strings += pieces
            elif max(w) <= "\xff" and w.isprintable():
                pieces = self.pieces(w.lower())
                strings += [p if p.isascii() else p.encode().decode("latin-1").translate(self.letters) for p in pieces]
            else:
                self.known[w] = np.array(self.whole.encode(w, add_special_tokens=False).ids, self.dtype).tobytes()
                continue
            plain.append(w)
            counts.append(len(pieces))
        ids = [np.empty(0, np.int64)]
        for i in range(0, len(strings), 4000):
            ids.append(np.array(self.model.encode(" ".join(strings[i : i + 4000]), add_special_tokens=False).ids, np.int64))
        flat = np.concatenate(ids)
        after = np.concatenate([[0], np.flatnonzero(self.ends[flat]) + 1])
        if len(after) != len(strings) + 1:
            raise ValueError("the tokenizer's model doesn't mark the end of each word")
        bounds = (after[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])] * self.dtype.itemsize).tolist()
        packed = flat.astype(self.dtype).tobytes()
        self.known.update((w, packed[a:b]) for w, a, b in zip(plain, bounds[:-1], bounds[1:]))

    def encode(self, texts: pa.Array, end: int) -> list[bytes]:
        """The ids of each text, and then `end`, as packed little-endian integers."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) >= CACHE_WORDS:
            self.older, self.known = self.known, {"": b""}
        each = list(map(self.known.get, words))
        if missing := [i for i, ids in enumerate(each) if ids is None]:
            new = []
            for i in missing:
                if (ids := self.older.get(words[i])) is not None:
                    self.known[words[i]] = ids
                else:
                    new.append(words[i])
            self._encode(new)
            for i in missing:
                each[i] = self.known[words[i]]
        flat = np.frombuffer(b"".join(each), self.dtype)
        size = np.fromiter(map(len, each), np.int64, len(each)) // self.dtype.itemsize
        first = np.cumsum(size) - size
        word, offsets = coded.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        last, out, i = np.array([end], self.dtype).tobytes(), [], 0
        while i < len(texts):  # documents of about a million words at once
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (1 << 19), "right")) - 1)
            own = word[offsets[i] : offsets[j]]
            n = size[own]
            ends = np.concatenate([[0], np.cumsum(n)])
            ids = flat[np.repeat(first[own] - ends[:-1], n) + np.arange(ends[-1])]
            cut = ends[offsets[i : j + 1] - offsets[i]].tolist()
            out += [ids[a:b].tobytes() + last for a, b in zip(cut[:-1], cut[1:])]
            i = j
        return out


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """A worker's own copy, kept between batches and tasks."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def tokenized(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """(doc_id, part, before, n, ids): ids packed; `before` counts the tokens of the partition's rows before."""

    def of(batches):
        part, before, tokenizer = TaskContext.get().partitionId(), 0, word_ids(path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)), 0
            while at < len(texts):
                stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + GROUP_BYTES)))
                packed = tokenizer.encode(texts[at:stop], end)
                n = np.fromiter(map(len, packed), np.int64, len(packed)) // tokenizer.dtype.itemsize
                start = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays([ids[at:stop], pa.array(np.full(len(n), part, np.int32)), pa.array(start), pa.array(n), pa.array(packed, pa.binary())], ["doc_id", "part", "before", "n", "ids"])
                at = stop
                give_back()

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(of, "doc_id long, part int, before long, n long, ids binary")


def pack(docs: DataFrame, path: str, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", end: int = END, with_ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of `length` tokens: one row per piece with doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset and, if asked for, the ids.

    Null and empty texts are the single id `end`. Rows with the same id, null ids and repeated rows are documents of
    their own. Empty tables give no rows; other columns are not read. All sequences but the last are full.
    """
    stored = written(tokenized(docs, path, doc_id, text, end), "tokens")
    totals = stored.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("total"))
    # one number per partition of the input: the driver sums them up, and they go back as a small table
    rows = sorted((r["part"], r["total"]) for r in totals.collect())
    base, at = [], 0
    for part, total in rows:
        base.append((part, at))
        at += total
    bases = docs.sparkSession.createDataFrame(base, "part int, base long")

    def cut(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            pieces = []
            for doc, first, n, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                a = 0
                while a < n:
                    offset = (first + a) % length
                    b = min(n, a + length - offset)
                    own = ids[a:b]
                    for k, v in zip(out, (doc, a, b - a, zlib.crc32(own.tobytes()), n, (first + a) // length, offset), strict=True):
                        out[k].append(v)
                    if with_ids:
                        pieces.append(own)
                    a = b
            cols = [pa.array(v, pa.int64()) for v in out.values()]
            if with_ids:
                cols.append(pa.array(pieces, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, [*out, *(["ids"] if with_ids else [])])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<long>" if with_ids else "")
    placed = stored.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("before")).alias("first"), "n", "ids")
    return placed.mapInArrow(cut, schema)
