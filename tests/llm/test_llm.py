"""The operators against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

public_tokenizers = pytest.importorskip("public_tokenizers")
pytest.importorskip("skyloom.llm")

from skyloom.llm import blocks as B  # noqa: E402
from skyloom.llm import byte_bpe, embedding_dedup, html_text, imatch, language_id, licenses, packing, simhash, substring_dedup, suffix_dedup  # noqa: E402

WORDS = ["the", "and", "river", "stone", "light", "über", "café", "naïve", "x1", "—"]


def corpus(seed: int, n: int = 40) -> list[tuple[int, str | None]]:
    """Texts of all kinds: nulls, empty ones, copies, near copies, shared passages, a long one."""
    rng = random.Random(seed)
    passage = " ".join(f"w{rng.randrange(500)}" for _ in range(120))
    out: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "a\x0bb\x1cc　d")]
    for i in range(5, n):
        own = " ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice([5, 30, 90, 200])))
        kind = rng.randrange(5)
        if kind == 0 and i > 8:
            own = out[rng.randrange(5, i)][1] or own
        elif kind == 1:
            own = f"{own} {passage} tail"
        elif kind == 2 and i > 8:
            words = (out[rng.randrange(5, i)][1] or own).split()
            words[rng.randrange(len(words))] = "changed"
            own = "\n".join([" ".join(words[:7]), " ".join(words[7:])])
        out.append((i, own))
    out.append((n, "ä" * 1500 + " " + "ä" * 700))
    out.append((n + 1, " ".join(["loop"] * 900)))
    return out


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:  # names that operators use themselves
        for c in ("block", "slice", "payload", "fp", "score", "n", "next", "word"):
            df = df.withColumn(c, df.doc_id)
    return df.repartition(3)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(B, "SLICE_KEYS", 300)
    original = B.with_block
    for m in (substring_dedup, suffix_dedup, imatch):
        monkeypatch.setattr(m.B, "with_block", lambda d, k, t, b=4000: original(d, k, t, b))


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("sketch_rows", [1, 2])
def test_substring_dedup(spark, small_blocks, seed, sketch_rows):
    rows = corpus(seed)
    got = by_id(substring_dedup.remove_repeated_windows(frame(spark, rows), rows=sketch_rows, with_text=True))
    seen, gone, words = set(), {}, {}
    for i, t in rows:
        w = words[i] = (t or "").encode().split()
        gone[i] = [False] * len(w)
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                gone[i][s : s + 20] = [True] * 20
            seen.add(key)
    for i, _ in rows:
        kept = b" ".join(x for x, g in zip(words[i], gone[i]) if not g)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"], got[i]["kept_text"]) == (len(words[i]), sum(gone[i]), hashlib.sha256(kept).hexdigest(), kept.decode())
    assert any(sum(g) for g in gone.values())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_suffix_dedup(spark, small_blocks, seed):
    rows, length = corpus(seed), 100
    got = by_id(suffix_dedup.remove_repeated_strings(frame(spark, rows), length=length))
    count: dict[bytes, int] = {}
    for _, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            count[b[s : s + length]] = count.get(b[s : s + length], 0) + 1
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                gone[s : s + length] = True
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()), i


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_suffix_dedup_keeps_the_first(spark, small_blocks, seed):
    rows, length = corpus(seed), 100
    rows += [(i + 500, t) for i, t in rows[5:12]]  # whole copies, in other blocks
    rows += [(900, "first " + "x1 y2 z3 " * 60), (901, "x1 y2 z3 " * 70)]
    got = by_id(suffix_dedup.remove_repeated_strings(frame(spark, rows), length=length, keep_first=True, with_text=True))
    seen: set[bytes] = set()
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone[s : s + length] = True
            seen.add(b[s : s + length])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["kept_text"]) == (len(b), int(gone.sum()), kept.decode("utf-8", "ignore")), i


def test_shorter_repeats_are_counted(spark, small_blocks):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = " ".join(word() for _ in range(51))
    rows = [(i, " ".join([word() for _ in range(60)] + ([passage] if i % 3 == 0 else []) + [word() for _ in range(60)])) for i in range(30)]
    plain = by_id(suffix_dedup.remove_repeated_strings(frame(spark, rows), length=600))
    got = by_id(suffix_dedup.remove_repeated_strings(frame(spark, rows), length=600, passage=suffix_dedup.PASSAGE))
    for i, _ in rows:
        assert got[i]["n_removed"] == plain[i]["n_removed"] == 0 and got[i]["kept_sha256"] == plain[i]["kept_sha256"]
        assert got[i]["n_repeated"] == 0 if i % 3 else 150 < got[i]["n_repeated"] <= len(passage) + 2
    assert len({got[i]["n_repeated"] for i in range(0, 30, 3)}) == 1


def test_rows_of_one_id_are_several_blocks(spark):
    rng = random.Random(9)
    shared = " ".join(f"s{rng.randrange(900)}" for _ in range(80))
    rows = [(7 if i % 3 else None if i % 2 else i, " ".join(f"w{rng.randrange(900)}" for _ in range(150)) + (" " + shared if i % 4 == 0 else "")) for i in range(120)]
    blocked, n, _ = B.with_block(frame(spark, rows), "doc_id", "text", 4000)
    placed = blocked.select("doc_id", "block").collect()
    assert n > 10 and len({r["block"] for r in placed if r["doc_id"] == 7}) > 4
    last: dict = {}
    for r in placed:
        k = -1 if r["doc_id"] is None else r["doc_id"]
        a, b = last.get(k, (r["block"], r["block"]))
        last[k] = (min(a, r["block"]), max(b, r["block"]))
    ends = [last[k] for k in sorted(last)]
    assert all(b <= c for (_, b), (c, _) in zip(ends, ends[1:]))


def test_rows_of_one_id_lose_all_repeats_but_one(spark, small_blocks):
    rng = random.Random(9)
    shared = " ".join(f"s{rng.randrange(900)}" for _ in range(80))
    rows = [(7, " ".join(f"w{rng.randrange(900)}" for _ in range(150)) + " " + shared) for i in range(60)]
    got = suffix_dedup.remove_repeated_strings(frame(spark, rows), length=200, keep_first=True, with_text=True).collect()
    assert sum(shared in r["kept_text"] for r in got) == 1
    got = substring_dedup.remove_repeated_windows(frame(spark, rows), with_text=True).collect()
    assert sum(shared in r["kept_text"] for r in got) == 1


def test_kept_columns_may_clash(spark):
    rows = [(1, "abc " * 200, "a", "b", 5), (2, "xyz", "c", "d", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string, slice string, n_bytes long")
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeated_strings(df, keep=["block", "slice", "n_bytes"]).collect()}
    assert (got[1]["block"], got[1]["slice"], got[2]["block"], got[2]["n_bytes"]) == ("a", "b", "c", 3)


def test_repeated_rows_and_ids(spark):
    rows = [(1, "a b c " * 80), (1, "a b c " * 80), (None, "x y"), (2, "q")]
    got = substring_dedup.remove_repeated_windows(frame(spark, rows))
    assert sorted((r["doc_id"] or -1, r["n_words"]) for r in got.collect()) == [(-1, 2), (1, 240), (1, 240), (2, 1)]
    assert suffix_dedup.remove_repeated_strings(frame(spark, rows)).count() == 4


EMPTY_OPERATORS = [
    lambda d: substring_dedup.remove_repeated_windows(d), lambda d: suffix_dedup.remove_repeated_strings(d), lambda d: simhash.simhash_groups(d), lambda d: licenses.find_licenses(d),
    lambda d: packing.pack(d, public_tokenizers.path("word_bpe_49k.json")), lambda d: byte_bpe.encode_decode(d, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
    lambda d: language_id.fit_and_identify(d.withColumn("lang", d.text)), lambda d: imatch.compare_with_edits(d),
]


@pytest.mark.parametrize("operator", EMPTY_OPERATORS)
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_empty_vectors_and_pages(spark):
    assert embedding_dedup.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_fixed_packing_of_arrays():
    rng = np.random.default_rng(0)
    for keys in (np.array([], np.uint64), np.array([7], np.uint64), np.sort(rng.integers(0, 1 << 63, 1000, dtype=np.uint64)), np.array([5, 5, 9], np.uint64)):
        assert (B.unpack_sorted(B.pack_sorted(keys)) == keys).all()
        more = rng.integers(0, 1 << 32, len(keys), dtype=np.uint32)
        a, b = B.unpack_pairs(B.pack_pairs(keys, more))
        assert (a == keys).all() and (b == more).all()


# --- SimHash ---


def plain_fingerprint(text, n=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = low.encode().split()
    parts = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_golay_keys_miss_no_pair():
    rng = np.random.default_rng(5)
    for d in range(1, 5):
        a = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
        b = a.copy()
        for i in range(len(b)):
            for bit in rng.choice(64, d, replace=False):
                b[i] ^= np.uint64(1) << np.uint64(bit)
        own: list[set] = [set() for _ in a]
        for w, k in zip(*simhash.golay_keys(a)):
            own[w].add(int(k))
        met = set()
        for w, k in zip(*simhash.golay_keys(b)):
            if int(k) in own[w]:
                met.add(int(w))
        assert len(met) == len(a)


def test_large_key_groups_stay_connected():
    rng = np.random.default_rng(1)
    fp = np.unique(np.array([np.uint64(0)] + [np.uint64(1) << np.uint64(b) for b in range(64)] + [(np.uint64(1) << np.uint64(a)) | (np.uint64(1) << np.uint64(b)) for a, b in rng.integers(0, 64, (200, 2))]))
    links = simhash.links_in_keys(np.zeros(len(fp), np.uint64), fp, 4)
    assert len(links) == len(fp) - 1 and (np.bitwise_count(links[:, 0] ^ links[:, 1]) <= 4).all()


def test_simhash_groups(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(200)}" for _ in range(900)]
    rows = corpus(3)
    for i in range(30):
        w = list(base)
        for _ in range(i % 6):
            w[rng.randrange(len(w))] = f"v{rng.randrange(50)}"
        rows.append((100 + i, " ".join(w).upper() if i % 2 else " ".join(w)))
    got = by_id(simhash.simhash_groups(frame(spark, rows)))
    fps = {i: plain_fingerprint(t) for i, t in rows}
    comp = {i: i for i, _ in rows}
    while True:
        new = {i: min(comp[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 4) for i in fps}
        if new == comp:
            break
        comp = new
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{fps[i]:016x}", comp[i]) for i in fps}
    assert got[0]["component_id"] == got[2]["component_id"] == 0


# --- tokens ---


def texts_for_tokens():
    rng = random.Random(3)
    alphabet = " \n\tab'sré12.%　\x1c中文ßthéingÀÖ|_-<>\xa0\x85²µİΣ́👍K"
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    return [*out, "", " ", "  ", "a ", " a", "\n a", "a\n", "<|endoftext|>", "a" * 3000, "ab" * 1500, " " * 500, "é" * 300, "don't we'll x  y"]


def test_byte_bpe(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    bpe = byte_bpe.ByteBPE.load(path, public_tokenizers.PATTERN)
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    texts = texts_for_tokens()
    got = bpe.encode_all(texts)
    for t, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == want.encode_ordinary(t) and bpe.decode(ids) == t.encode()
    for piece in ("thing", "aaaa", "a" * 200, "xyzxyz"):  # one queue for many pre-tokens, and one of its own
        assert np.frombuffer(bpe.merge_many([piece.encode()])[0], "<u4").tolist() == bpe.merge(piece.encode())
    rows = [(1, None), (2, "the cat's 12"), (2, "the cat's 12")]
    r = byte_bpe.encode_decode(frame(spark, rows), path, public_tokenizers.PATTERN).collect()
    assert {(x["doc_id"], x["n_tokens"], x["decoded_sha256"]) for x in r} == {(1, 0, hashlib.sha256(b"").hexdigest()), (2, len(want.encode_ordinary("the cat's 12")), hashlib.sha256(b"the cat's 12").hexdigest())}


def test_word_ids_are_the_tokenizers():
    w = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    texts = texts_for_tokens()
    for t, ids in zip([*texts, None], w.encode(pa.array([*texts, None]), 2)):
        assert np.frombuffer(ids, w.dtype).tolist() == w.whole.encode(t or "", add_special_tokens=False).ids + [2], t


def test_packing(spark):
    path, rows = public_tokenizers.path("word_bpe_49k.json"), corpus(5) + [(None, "x"), (7, "again")]
    got = packing.pack(frame(spark, rows), path, length=64, with_ids=True).collect()
    whole = packing.WordIds(path).whole
    full = sorted((i is None, i or 0, whole.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows)
    pieces: dict = {}
    for r in got:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and r["length"] == len(r["ids"])
        pieces.setdefault(r["sequence_id"], []).append(r)
    stream = []
    for s in sorted(pieces):
        at = 0
        for r in sorted(pieces[s], key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
            stream.append(r)
        assert at == 64 or s == max(pieces)
    docs, own = [], []
    for r in stream:
        assert r["start"] == len(own)
        own += r["ids"]
        if len(own) == r["doc_tokens"]:
            docs.append((r["doc_id"] is None, r["doc_id"] or 0, own))
            own = []
    assert not own and sorted(docs) == full


# --- vectors ---


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(20, 16))
    rows, i = [], 0
    for c, v in enumerate(base):
        for _ in range(1 + 3 * (c % 4)):
            rows.append((i, [float(x) for x in v + rng.normal(size=16) * 0.08]))
            i += 1
    rows += [(i, rows[0][1]), (i + 1, rows[0][1]), (i + 2, None), (i + 3, [0.0] * 16), (i + 4, [float("nan")] * 16), (i + 5, []), (i + 6, [1.0, 2.0]), (i + 7, [2.0, 4.0]), (i + 8, [None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("copies", F_lit(1))
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicate_vectors(df).collect()}
    usable = {j: np.array(v) for j, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    near = {j: {k for k, w in usable.items() if k != j and len(w) == len(v) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.95} for j, v in usable.items()}
    comp = {j: j for j, _ in rows}
    while True:
        new = {j: min([comp[j], *(comp[k] for k in near.get(j, ()))]) for j in comp}
        if new == comp:
            break
        comp = new
    for j, _ in rows:
        assert (got[j]["n_links"], got[j]["component_id"], got[j]["kept"]) == (len(near.get(j, ())), comp[j], comp[j] == j), j


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


# --- pages, licences, languages, fingerprints ---


def test_html_zones():
    page = """<html><head><title>t</title></head><body><header>site</header><nav>menu</nav><div class="cookie-banner">x</div><main><article><h1>A &amp; B</h1>
    <p class=ad>buy</p><p>one<br>two <b>b</b>old<p>c &lt; 3 < 4<aside>side</aside><script>var x="</p>";</script><div id="userComments"><p>first!</div><form>f</form></article></main><footer>f</footer>"""
    assert [t for z, t in html_text.blocks(page) if z == html_text.MAIN] == ["A & B", "one two bold", "c < 3 < 4"]
    assert html_text.blocks("") == [] and html_text.blocks("plain <b") == [(html_text.OTHER, "plain")]


@pytest.mark.parametrize(
    "page",
    [
        "<article class='post category-search tag-social'><p>the text</p></article>",
        "<main class='with-sidebar'><p>the text</p></main>",
        "<div id='content' class='has-sidebar'><article><p>the text</p></article></div>",
        "<article class='comments-open'><p>the text</p></article>",
        "<article class='promo' id='banner'><p>the text</p></article>",
        "<div class='sidebar-layout'><div>x</div><div class='widget'><main><p>the text</p></main></div></div>",
        "<div class='related'><main><p>the text</p></main></div>",
        "<section class='page-header'><div itemprop='articleBody'>the text</div></section>",
        "<main><p>the text</p><div class='comments'><article>first!</article></div><div class=ad><div>buy</div></div></main>",
        "<article><p>the text</p></article><div id='comments' class='open'><article class='comment'>first!</article></div>",
    ],
)
def test_class_words_drop_no_article(page):
    assert [t for z, t in html_text.blocks(page) if z == html_text.MAIN] == ["the text"]


def test_host_boilerplate(spark):
    rng = random.Random(1)
    legal = "all rights reserved by the publisher of this fine paper and others"
    rows = []
    for i in range(30):
        own = " ".join(f"w{rng.randrange(900)}" for _ in range(25))
        rows.append((i, "https://h.com/x" if i % 2 else "https://H.com/y", f"<body><div>{legal}</div><div>{own}</div></body>"))
    rows += [(100, None, None), (101, "https://o.com", "<article><p>kept &copy;</p></article><p>not this</p>")]
    got = {r["page_id"]: r for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(legal not in got[i]["text"] and got[i]["n_chars"] > 20 for i in range(30))
    assert (got[100]["text"], got[101]["text"]) == ("", "kept ©")


def plain_boilerplate(pages, depth=html_text.DEPTH):
    """Which blocks of a host's different pages go, by counting the pages of every string."""
    strings = [[[tuple(line.split()[i : i + depth]) for i in range(len(line.split()))] for _, line in own] for own in pages]
    count: dict = {}
    for own in strings:
        for x in {x for block in own for x in block}:
            count[x] = count.get(x, 0) + 1
    out = []
    for own, blocks in zip(pages, strings):
        gone = []
        for (zone, _), block in zip(own, blocks):
            need = max(html_text.MAIN_PAGES, html_text.MAIN_SHARE * len(pages)) if zone == html_text.MAIN else max(html_text.OTHER_PAGES, html_text.OTHER_SHARE * len(pages))
            covered = {j for i, x in enumerate(block) if count[x] >= need for j in range(i, min(len(block), i + depth))}
            gone.append(len(covered) >= html_text.COVERED * len(block))
        out.append(gone)
    return out


@pytest.mark.parametrize("shard", [html_text.SHARD_BYTES, 2500])
def test_boilerplate_against_plain(spark, monkeypatch, shard):
    """Repeats of all shares and lengths, across pages, of several hosts, in one task and in shards; repeated rows."""
    rng = random.Random(shard)
    monkeypatch.setattr(html_text, "SHARD_BYTES", shard)
    words = lambda n: " ".join(f"w{rng.randrange(60)}" for _ in range(n))
    rows = []
    for host, n in (("a", 50), ("b", 9), ("c", 2), ("d", 25)):
        shared = [words(rng.choice([3, 7, 12, 30])) for _ in range(8)]
        for _ in range(n):
            own = [words(rng.randint(4, 40)) for _ in range(3)] + [x if rng.random() < 0.5 else f"{x} {words(2)}" for k, x in enumerate(shared) if rng.random() < k / 7]
            rng.shuffle(own)
            tag = rng.choice(["article", "section", "section"])
            rows.append((len(rows), f"http://{host}.net/{len(rows)}", f"<{tag}>{''.join(f'<p>{x}</p>' for x in own)}</{tag}>"))
    rows += [rows[3], rows[3], (len(rows), *rows[60][1:]), (None, None, "<p>no url</p>"), (None, None, "<p>no url</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("host", "zones", "lines", "shard", "text", "n_chars", "parts", "content", "counts", "whole"):
        df = df.withColumn(c, imatch.F.lit("clash"))
    got = sorted((r["page_id"] is None, r["page_id"] or 0, r["text"]) for r in html_text.extract_text(df.repartition(4)).collect())
    hosts: dict = {}
    for i, u, h in rows:
        hosts.setdefault((u or "")[:10], {}).setdefault(tuple(html_text.blocks(h)), []).append(i)
    want, away = [], 0
    for pages in hosts.values():
        for (own, ids), gone in zip(pages.items(), plain_boilerplate(list(pages))):
            main = any(z == html_text.MAIN for z, _ in own)
            away += sum(gone)
            want += [(i is None, i or 0, "\n".join(line for (z, line), g in zip(own, gone) if not g and (z == html_text.MAIN or not main))) for i in ids]
    assert got == sorted(want) and away > 40


def test_large_elements_are_told_like_small_ones():
    """What stands in an element of a boilerplate class stays if an article is in it, however far, and goes if none is."""
    many = "<p>one</p>" * 200 + "<script>var t='</div></section>'</script>"
    for outer in ("div", "section"):
        inside = f"<{outer} class='sidebar'>{many}<article>the text</article>{many}</{outer}>"
        beside = f"<{outer} class='sidebar'>{many}</{outer}><article>the text</article><{outer} class='sidebar'>{many}</{outer}>"
        assert [t for z, t in html_text.blocks(inside) if z == html_text.MAIN] == ["the text"]
        assert html_text.blocks(beside) == [(html_text.MAIN, "the text")]


def test_long_pages_take_linear_time():
    import time

    def seconds(n):
        pages = ["<b>" * n + "</i>" * n, "<b>" * n + "<hr>" * n, "<p><ul>" + "<div>" * n + "<td></td>" * n, "<div class=ad>" * n + "<article>" + "x " * n, "<p>" * n + "</div>" * n, "<li>" * n + "</ul>" * n]
        began = time.process_time()
        for p in pages:
            html_text.blocks(p)
        return time.process_time() - began

    seconds(500)
    assert seconds(16000) < 12 * max(seconds(4000), 0.05)
    assert html_text.blocks("<article>" + "<p>one two</p>" * 30000 + "</article>") == [(html_text.MAIN, "one two")] * 30000


def test_copies_of_an_article_are_one_page(spark):
    rng = random.Random(3)
    make = lambda: " ".join(f"w{rng.randrange(900)}" for _ in range(40))
    hot, menu = make(), "all rights reserved by the publisher of this fine paper and others"
    pages = [hot] * 40 + [make() for _ in range(6)]
    rows = [(i, "https://h.com/", f"<div>{menu}</div><article><p>{t}</p></article>") for i, t in enumerate(pages)]
    rows += [(100 + i, "https://o.com/", f"<div>{menu}</div><div>{t}</div>") for i, t in enumerate([hot] * 8 + pages[40:])]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(46)] == pages and [got[100 + i] for i in range(14)] == [hot] * 8 + pages[40:]


def test_size_of_a_host_changes_nothing(spark, monkeypatch):
    rng = random.Random(4)
    make = lambda n=40: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    notice, quoted, rare = make(), make(), make()
    rows = []
    for i in range(60):
        extra = f"<p>{notice}</p>" + (f"<p>{quoted}</p>" if i % 2 else "")
        rows.append((i, "https://h.com/", f"<main>{extra}<p>{make()}</p></main>" if i % 3 else f"<div>{rare if i % 4 else make()}</div><div>{make()}</div>"))
    rows += [(i, *rows[7][1:]) for i in range(60, 90)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    read = lambda: {r["page_id"]: r["text"] for r in html_text.extract_text(df).collect()}
    want = read()
    assert sum(notice in t for t in want.values()) == 0 and sum(quoted in t for t in want.values()) > 10
    monkeypatch.setattr(html_text, "SHARD_BYTES", 1500)
    assert read() == want


def test_suffix_groups_are_the_truncated_order():
    rng = np.random.default_rng(0)
    x = rng.integers(1, 4, 300)
    group = html_text.suffix_groups(x, 8)
    strings = [tuple([*x[i : i + 8], *[0] * 8][:8]) for i in range(len(x))]
    order = {s: i for i, s in enumerate(sorted(set(strings)))}
    assert group.tolist() == [order[s] for s in strings]


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"]
    changed = mit.replace("free of charge", "at no cost whatever")
    noise = " ".join(f"w{i}" for i in range(300))
    rows = [(1, f"{noise} {mit.upper()} {noise}"), (2, changed), (3, noise), (4, None), (5, "released under the mit license; Released under the MIT License."), (6, "the mit license")]
    got: dict = {}
    for r in licenses.find_licenses(frame(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append((r["license"], r["start_word"], r["n_words"], r["containment"]))
    assert set(got) == {1, 2, 5}
    assert got[1] == [("MIT", 300, len(licenses.fold(mit.encode()).split()), 1.0)] and got[2][0][0] == "MIT" and 0.8 <= got[2][0][3] < 1
    assert got[5] == [("MIT-notice", 0, 10, 1.0)]


def plain_licenses(text, known, containment=0.8):
    """The notices of a text, by comparing every window with every template."""
    s = licenses.shingles(licenses.word_hashes(licenses.fold((text or "").encode()))).tolist()
    spans: dict = {}
    for w, own in known.classes.items():
        for a in range(0, max(1, len(s)), w // 4):
            part = s[a : a + w - licenses.SHINGLE + 1]
            for i in own:
                mine = set(known.sets[i].tolist())
                inside = [j for j, x in enumerate(part) if x in mine]
                share = len({part[j] for j in inside}) / len(mine)
                if share >= containment and all(set(n.tolist()) & set(part) for n in known.needed[i]):
                    spans.setdefault(i, []).append([a + inside[0], a + inside[-1] + licenses.SHINGLE, share])
    out = []
    for i, found in spans.items():
        joined: list = []
        for a, b, share in sorted(found):
            if joined and a < joined[-1][1]:
                joined[-1][1:] = [max(b, joined[-1][1]), max(share, joined[-1][2])]
            else:
                joined.append([a, b, share])
        out += [(i, a, b, share) for a, b, share in joined]
    return {(known.names[i], a, b - a, share) for i, a, b, share in out if not any(c <= a and b <= d and d - c > b - a and known.family[i] == known.family[j] for j, c, d, _ in out)}


def test_licenses_against_all_windows(spark):
    rng = random.Random(15)
    known, rows = licenses.Templates(licenses.TEMPLATES, 0.8), []
    filler = lambda n: " ".join(rng.choice(["license", "software", "the", "version", "2", "a", "gnu", f"w{rng.randrange(99)}"]) for _ in range(n))
    names = sorted(licenses.TEMPLATES)
    for i in range(len(names)):
        words = licenses.TEMPLATES[names[i]].split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "changed"
        more = licenses.TEMPLATES[rng.choice(names)] if i % 3 == 0 else ""
        rows.append((i, f"{filler(rng.randrange(60))} {' '.join(words)} {filler(rng.randrange(9))} {more} {filler(20)}"))
    rows += [(500, None), (501, ""), (502, "mit"), (503, rows[0][1]), (503, rows[0][1])]
    rows += [(504, f"{filler(30000)} {licenses.TEMPLATES['MIT']} {filler(30000)}")]
    got: dict = {}
    for r in licenses.find_licenses(frame(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append((r["license"], r["start_word"], r["n_words"], r["containment"]))
    for i, t in rows:
        times = sum(j == i for j, _ in rows)
        assert sorted(got.get(i, [])) == sorted(list(plain_licenses(t, known)) * times), i
    assert len(got) >= 40 and any(m[0] == "MIT" for m in got[504])


def test_versions_of_licenses_are_told_apart():
    known = licenses.Templates(licenses.TEMPLATES, 0.8)

    def found(text):
        s = licenses.shingles(licenses.word_hashes(licenses.fold(text.encode())))
        return {m[0] for m in known.matches(s, np.flatnonzero(known.has(s)), 0.8)}

    for name, text in licenses.TEMPLATES.items():
        others = {known.family[known.names.index(m)] for m in found(f"x y z {text} and so on")} - {known.family[known.names.index(name)]}
        assert others <= {"MIT", "BSD", "BSD-2-Clause"} and name in found(text), (name, others)
    assert found("This work is licensed under the GNU General Public License, version 2.") == {"GPL-2.0-notice"}
    assert found("This work is licensed under the GNU General Public License, version 1.") == set()
    assert found(licenses.TEMPLATES["GPL-2.0"]) == {"GPL-2.0"} and found("SPDX-License-Identifier: GPL-3.0-or-later") == {"GPL-3.0-or-later-spdx"}


def test_license_windows_miss_nothing():
    """Every template, wherever it stands in a text, is retrieved by the bands."""
    known = licenses.Templates(licenses.TEMPLATES, 0.8)
    for name, text in licenses.TEMPLATES.items():
        for before in (0, 3, 17, 101):
            words = f"{' '.join(f'q{i}' for i in range(before))} {text} {' '.join(f'z{i}' for i in range(50))}"
            s = licenses.shingles(licenses.word_hashes(licenses.fold(words.encode())))
            assert name in {m[0] for m in known.matches(s, np.flatnonzero(known.has(s)), 0.8)}


def test_language_id(spark):
    rng = random.Random(0)
    parts = {"aa": ["ka", "ko", "ki", "ta"], "bb": ["schn", "ülb", "ung", "ein"], "cc": ["eau", "ère", "ois", "que"]}
    text = lambda k, n: " ".join("".join(rng.choices(parts[k], k=rng.randint(1, 3))) for _ in range(n))
    rows = [(i, text(k, rng.choice([3, 20, 200])), k) for i, k in enumerate(rng.choices(list(parts), k=300))]
    rows += [(1000, None, "aa"), (1001, "123 !!", "aa"), (1002, "", None), (1003, "中文字符" * 300, None), (None, text("aa", 30), "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: r for r in language_id.fit_and_identify(df).collect()}
    assert sum(got[i]["lang_pred"] == k for i, _, k in rows[:300]) >= 297
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(300)) and not got[None]["held_out"]
    assert [(got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) for i in (1000, 1001, 1002)] == [("und", 0.0, True)] * 3
    assert got[1003]["rejected"] and got[1003]["lang_pred"] in parts and sum(got[i]["rejected"] for i in range(300)) == 0
    again = {r["doc_id"]: r for r in language_id.fit_and_identify(df.repartition(7)).collect()}
    assert all(abs(again[i]["score"] - got[i]["score"]) < 1e-6 for i in got)


def test_language_rejection(spark):
    """Threshold from held-back texts: junk and other languages in the same script go, clean short and long texts stay."""
    rng = random.Random(8)
    parts = {"aa": ["ka", "ko", "ki", "ta", "mo"], "bb": ["schn", "ulb", "ung", "ein", "de"], "cc": ["eau", "ere", "ois", "que", "le"]}
    text = lambda k, n: " ".join("".join(rng.choices(parts[k], k=rng.randint(1, 3))) for _ in range(n))
    rows = [(i, text(k, rng.choice([20, 60, 200])), k) for i, k in enumerate(rng.choices(list(parts), k=600))]
    rows += [(600 + i, text("bb", 80), "aa") for i in range(3)]  # wrong labels
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    letters = "abcdefghijklmnopqrstuvwxyz"
    junk = [
        " ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(200)),
        "".join(rng.choices(letters + letters.upper() + "0123456789+/", k=900)),
        "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita. " * 5,
        "Kaikki ihmiset syntyvat vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. " * 5,
    ]
    assert model.classify(junk)[2].all()
    clean = [text(k, n) for k in parts for n in (4, 8, 30, 3000)]
    assert model.classify(clean)[2].sum() == 0 and model.classify(clean)[0] == [k for k in parts for _ in range(4)]


def test_language_sample_is_bounded(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdef", k=4))
    rows = [(None, " ".join(word() for _ in range(8)), "aa") for _ in range(3000)] + [(7, "the same row", "aa")] * 3000 + [(i, f"nine {word()}", "bb") for i in range(40)]
    seen = []
    original = language_id.clustered
    try:
        language_id.clustered = lambda x, k: seen.append(len(x)) or original(x, k)
        model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), per_language=300)
    finally:
        language_id.clustered = original
    assert set(model.languages) == {"aa", "bb"} and 20 < seen[0] < 300 and seen[1] == 27
    tie = language_id.Model(["x", "y"], model.idf, np.repeat(model.centroids[:1], 2, axis=0), np.zeros(2))
    assert tie.classify(["the same row"])[0] == ["x"]
    odd = spark.createDataFrame([(None, "the same row", 1, 2), (1, "the same row", 3, 4)], "doc_id long, text string, told_0 int, score int")
    got = language_id.identify(odd, model).collect()
    assert [r["told_0"] for r in got] == [1, 3] and got[0]["score"] == got[1]["score"] > 0


def test_imatch(spark, small_blocks):
    rows = corpus(9, 60)
    got = by_id(imatch.compare_with_edits(frame(spark, rows)))
    order = sorted(rows, key=lambda r: -r[0])
    for n, (i, t) in enumerate(order):
        t, following = t or "", order[(n + 1) % len(order)][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + following[:third]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest()), i
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
        if following == t:
            assert got[i]["near_next"] == 1
    same: dict = {}
    for i, t in rows:
        same.setdefault(t or "", set()).add(got[i]["fingerprint"])
    assert all(len(s) == 1 for s in same.values()) and len({min(s) for s in same.values()}) > 30
    one = imatch.compare_with_edits(spark.createDataFrame([(5, "just this one text here")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"just this one te" + b"just th").hexdigest()


def murmur(values, seed=42):
    """The hash of a subset's terms: each time Spark's hash of an integer, what was before, and a long."""
    m = 0xFFFFFFFF
    turn = lambda x, r: (x << r | x >> (32 - r)) & m
    h = seed
    for v in values:
        before, h = h, 42
        for words in ((before,), (v & m, v >> 32 & m)):
            for k in words:
                k = turn(k * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
                h = (turn(h ^ k, 13) * 5 + 0xE6546B64) & m
            h ^= 4 * len(words)
            for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
                h = (h ^ h >> shift) * factor & m
    return h


def plain_imatch(rows):
    """(fingerprints, edited fingerprints, near_edited, near_next) of all rows, term by term."""
    import regex

    n_buckets, subsets, levels = 1 << imatch.BUCKET_BITS, imatch.SUBSETS, imatch.LEVELS
    signed = lambda u: u - (1 << 64) if u >> 63 else u
    terms = lambda t: {signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w}
    seen: dict = {}
    for _, t in rows:
        for b in {h % n_buckets for h in terms(t or "")}:
            seen[b] = seen.get(b, 0) + 1
    low, high = imatch.IDF_BAND
    kept = {b for b, c in seen.items() if low <= np.log(len(rows) / c) <= high}

    def fingerprint(t):
        every = terms(t)
        own = [h for h in every if h % n_buckets in kept]
        own = sorted(own if len(own) >= imatch.LEAST_TERMS else every)
        out = []
        for level in range(levels):
            few = [h for h in own if (h >> 20) % 4**level == 0]
            if level < levels - 1 and len(own) > imatch.CROWDED * subsets * 4**level:
                few = []
            out += [murmur([h for h in few if (h >> 59) + subsets // 2 == s]) for s in range(subsets)]
        return out

    def like(x, y):
        share = None
        for level in range(levels):
            part = [(p, q) for p, q in zip(x[level * subsets : (level + 1) * subsets], y[level * subsets : (level + 1) * subsets]) if (p, q) != (42, 42)]
            if part and (len(part) >= subsets // 2 or level == 0):
                share = sum(p == q for p, q in part) / len(part)
        if share is None:
            share = float(all(v == 42 for v in (*x, *y)))
        return 2 * share / (1 + share)

    order = sorted(rows, key=lambda r: -r[0])
    fps = [fingerprint(t or "") for _, t in order]
    out = {}
    for n, (i, t) in enumerate(order):
        t, following = t or "", order[(n + 1) % len(order)][1] or ""
        third = len(t) // 3
        edited = fingerprint(t[: len(t) - third] + following[:third])
        out[i] = tuple("".join(f"{x:08x}" for x in f) for f in (fps[n], edited)) + (like(fps[n], edited), like(fps[n], fps[(n + 1) % len(order)]))
    return out


@pytest.mark.parametrize("band", [imatch.IDF_BAND, (0.5, 3.0)])
def test_imatch_against_plain(spark, small_blocks, monkeypatch, band):
    """Fingerprints and likenesses, with both edges of the band at work, of short, long and very long texts."""
    rng = random.Random(6)
    monkeypatch.setattr(imatch, "IDF_BAND", band)
    rows = corpus(12, 50)
    rows += [(200 + i, " ".join(f"x{rng.randrange(20000)}" for _ in range(n))) for i, n in enumerate((300, 900, 3000, 3000, 20000))]
    got = by_id(imatch.compare_with_edits(frame(spark, rows), band=band))
    for i, (fp, edited, near_edited, near_next) in plain_imatch(rows).items():
        r = got[i]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fp, edited), i
        assert (r["near_edited"], r["near_next"]) == (pytest.approx(near_edited), pytest.approx(near_next)), i


def test_imatch_of_very_long_texts(spark):
    n = imatch.CROWDED * imatch.SUBSETS * 4 ** (imatch.LEVELS - 1) + 2000
    rows = [(0, " ".join(f"a{i}" for i in range(n))), (1, " ".join(f"b{i}" for i in range(n))), (2, "")]
    every = imatch.F.array_repeat(imatch.F.lit(-1).cast("long"), 1 << (imatch.BUCKET_BITS - 6))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fps = {r["doc_id"]: r["fp"] for r in df.select("doc_id", imatch.fingerprint(df.text, every).alias("fp")).collect()}
    assert all(any(x != imatch.EMPTY for x in fps[i]) for i in (0, 1)) and fps[0] != fps[1]
    pairs = spark.createDataFrame([(fps[0], fps[1]), (fps[0], fps[2]), (fps[0], fps[0])], "a array<int>, b array<int>")
    assert [round(r[0], 3) for r in pairs.select(imatch.likeness(pairs.a, pairs.b)).collect()] == [0.0, 0.0, 1.0]


def test_near_duplicate_groups(spark):
    rng = random.Random(11)
    rows = corpus(4)
    for k in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([60, 300]))]
        for i in range(5):
            w = list(base)
            for _ in range(rng.randrange(1 + len(w) // 60)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(50)}"
            rows.append((100 + 10 * k + i, " ".join(w)))
    rows.append((None, "no id"))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(frame(spark, rows)).collect()}
    sets = {}
    for i, t in rows:
        if i is not None:
            w = (t or "").lower().encode().split()
            sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    texts = {i: t or "" for i, t in rows}
    near = lambda a, b: texts[a] == texts[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    comp = {i: i for i in sets}
    while True:
        new = {i: min(comp[j] for j in sets if near(i, j)) for i in sets}
        if new == comp:
            break
        comp = new
    linked = [(a, b) for a in sets for b in sets if a < b and near(a, b)]
    assert set(got) == set(sets) and sum(got[a] == got[b] for a, b in linked) >= 0.9 * len(linked) > 100
    assert all(comp[i] == comp[got[i]] and got[i] <= i for i in got)  # nothing else is merged


def test_near_duplicates_of_block_edits(spark):
    rng = random.Random(21)
    make = lambda n: [f"w{rng.randrange(40000)}" for _ in range(n)]
    rows, pairs = [], []
    for k in range(160):
        base = make(rng.choice([60, 200, 700]))
        n = len(base)
        edited = [base[: n - n // 7], base + make(n // 6), base[n // 7 :], base[: n // 2] + make(n // 6) + base[n // 2 :]][k % 4]
        a, b = ({tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (base, edited))
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(edited))]
        if len(a & b) >= 0.8 * len(a | b):
            pairs.append(2 * k)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(frame(spark, rows)).collect()}
    assert len(pairs) > 100 and {i for i in range(0, 320, 2) if got[i + 1] == got[i]} == set(pairs)


def test_bands_miss_nothing():
    rng = np.random.default_rng(5)
    n, least = 3 * simhash.bands_for(0.8), simhash.least_equal(3 * simhash.bands_for(0.8), 0.8)
    key = np.zeros(100, np.uint64)
    sketch = np.repeat(rng.integers(0, 256, (1, n), dtype=np.uint8), 100, axis=0)
    for m in (simhash.DENSE, 100):  # all in one key: small and large groups
        links = simhash.links_in_bands(key[:m], np.arange(m), np.full(m, 50), sketch[:m], least, 0.8)
        assert set(links.ravel().tolist()) == set(range(m))


def test_verified_links_connect(spark, monkeypatch):
    """Groups of near copies, chains and strangers in components, in one part and in many."""
    rng = random.Random(3)
    sets: dict[int, tuple[int, set]] = {}
    for root in range(1, 6):
        base = {rng.randrange(1 << 40) for _ in range(60)}
        for i in range(30):
            own = set(base)
            for x in rng.sample(sorted(own), rng.randrange(0, 24)):
                own.remove(x)
                own.add(rng.randrange(1 << 40))
            if i == 7:
                own = {rng.randrange(1 << 40) for _ in range(50)}
            sets[1000 * root + i] = (1000 * root, own)
    sets |= {9001: (9001, set()), 9002: (9001, set()), 9003: (9001, {1, 2})}
    rows = [(i, root, len(s), bytearray(np.sort(np.array(sorted(s), np.uint64)).tobytes())) for i, (root, s) in sets.items()]
    members = spark.createDataFrame(rows, "node long, root long, n long, shingles binary").repartition(3)
    near = lambda a, b: sets[a][0] == sets[b][0] and len(sets[a][1] & sets[b][1]) >= 0.8 * len(sets[a][1] | sets[b][1])

    def least(pairs):
        comp = {i: i for i in sets}
        while True:
            new = {i: min([comp[i], *(comp[b] for a, b in pairs if a == i), *(comp[a] for a, b in pairs if b == i)]) for i in sets}
            if new == comp:
                return comp
            comp = new

    want = least([(a, b) for a in sets for b in sets if a < b and near(a, b)])
    for part, pivots in ((simhash.PART_SHINGLES, simhash.PIVOT_BYTES), (300, 0)):
        monkeypatch.setattr(simhash, "PART_SHINGLES", part)
        monkeypatch.setattr(simhash, "PIVOT_BYTES", pivots)
        links = [(r["a"], r["b"]) for r in simhash.verified_links(members, 0.8).collect()]
        assert least(links) == want
    assert len(set(want.values())) > 7


def test_simhash_of_a_set():
    h = np.array([3, 1, 8 + (1 << 63)], np.uint64)
    assert simhash.majority(h) == 1 and simhash.majority(np.empty(0, np.uint64)) == 0


# --- edge cases of all operators ---


def test_empty_tables_of_near_duplicates(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicate_groups(empty).count() == 0 and simhash.near_duplicate_classes(empty).count() == 0
    assert language_id.fit(empty.withColumn("lang", empty.text)).languages == []


def test_repeated_rows(spark):
    """Every row has its result, and repeated rows equal ones."""
    text = "some text that is Released under the MIT License. " * 3 + "w1 w2 w3 w4 w5 w6"
    df = frame(spark, [(1, text), (1, text), (2, "another one here with words"), (None, None), (None, None)]).withColumn("lang", imatch.F.lit("en"))
    for got in (language_id.fit_and_identify(df), imatch.compare_with_edits(df), simhash.simhash_groups(df), byte_bpe.encode_decode(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)):
        rows = got.collect()
        assert sorted(r["doc_id"] or 0 for r in rows) == [0, 0, 1, 1, 2]
        one = [r for r in rows if r["doc_id"] == 1]
        same = [c for c in got.columns if c not in ("near_next", "near_edited", "edited_sha256", "edited_fingerprint")]
        assert [one[0][c] for c in same] == [one[1][c] for c in same]
    assert sorted(r["doc_id"] for r in licenses.find_licenses(df).collect()) == [1, 1]


def test_very_long_texts(spark):
    """Whole texts count, however long: what stands at the end of some megabytes is found."""
    rng = random.Random(2)
    body = " ".join(f"w{rng.randrange(5000)}" for _ in range(400_000))
    df = spark.createDataFrame([(1, f"{body} Licensed under the Apache License, Version 2.0."), (2, f"{body} tail")], "doc_id long, text string")
    assert [(r["doc_id"], r["license"], r["start_word"]) for r in licenses.find_licenses(df).collect()] == [(1, "Apache-2.0-notice", 400_000)]
    got = by_id(imatch.compare_with_edits(df, band=(0.0, 9.0)))
    assert got[1]["n_chars"] == len(body) + 48 and got[1]["near_next"] > 0.95 and got[1]["fingerprint"] != "0000002a" * imatch.SUBSETS * imatch.LEVELS
    pieces = packing.pack(df, public_tokenizers.path("word_bpe_49k.json")).collect()
    for i in (1, 2):
        own = sorted((r["start"], r["length"], r["doc_tokens"]) for r in pieces if r["doc_id"] == i)
        assert sum(n for _, n, _ in own) == own[0][2] > 400_000 and all(a + n == b for (a, n, _), (b, _, _) in zip(own, own[1:]))
    page = spark.createDataFrame([(1, "https://h.com", "<nav>x</nav><article>" + "".join(f"<p>{w}</p>" for w in body.split()[:100_000]) + "</article>")], "page_id long, url string, html string")
    assert html_text.extract_text(page).first()["text"].split("\n") == body.split()[:100_000]


def test_patterns_that_are_not_understood():
    ranks = {bytes([i]): i for i in range(256)}
    for bad in (r"[a\s]+|.", r"[\S]+", r"[^a\s]"):
        with pytest.raises(ValueError):
            byte_bpe.ByteBPE(ranks, bad)
    byte_bpe.ByteBPE(ranks, r"[^\s\p{L}]+|\s+(?!\S)|\[\s")


def test_registered_sql(spark, tmp_path):
    """The queries with SQL give what DuckDB gives, on a table small enough for both."""
    import duckdb

    from skyloom.llm import queries, sql

    rows = [(i, t, "en", "s", len(t or "")) for i, t in corpus(17, 50)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    rng = np.random.default_rng(1)
    base = rng.normal(size=(9, 8))
    vectors = [(i, [float(x) for x in base[i % 9] + rng.normal(size=8) * 0.1]) for i in range(60)] + [(60, None), (61, [0.0] * 8)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    duck = duckdb.connect()
    for name in ("documents", "embeddings"):
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name, text in sql.ORACLES.items():
        want, got = duck.sql(text), queries.queries()[name](spark, str(tmp_path))
        assert sorted(want.columns) == sorted(got.columns)
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall()), name


# --- the pipeline ---


def documents_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_stages_on_empty_tables(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    for _, stage in pipeline.STAGES:
        assert stage(spark, documents_of(spark, []), "").count() == 0


def test_language_stage_with_null_ids(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choices(["ka", "ko", "ki", "ta"], k=2)) for _ in range(40))
    rows = [(None, text(), "aa", "s", 1) for _ in range(300)] + [(1, text(), "aa", "s", 1)] * 2 + [(2, None, "aa", "s", 0), (3, "中文" * 200, None, "s", 400)]
    got = pipeline.language_id(spark, documents_of(spark, rows), "")
    assert got.columns == list(pipeline.COLUMNS) and sorted(r["doc_id"] or 0 for r in got.collect()) == [0] * 300 + [1, 1]


def test_pipeline_against_plain(spark):
    """The near-dedup and the suffix stage against brute force, with repeated rows, shared ids and null ids."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(31)
    make = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    passage = " ".join(make(60))
    texts = [" ".join(make(rng.choice([20, 80, 200]))) for _ in range(30)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    for i in range(0, 30, 3):  # near copies, at ids of their own and of others, and without ids
        w = texts[i].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((rng.choice([None, 100 + i, i + 1]), " ".join(w), "en", "t", 1))
    rows += [rows[2], rows[2], (None, texts[4], "en", "u", 1)]
    rows += [(200 + i, f"{' '.join(make(70))} {passage} {' '.join(make(70))}", "en", "s", 1) for i in range(5)]
    kept = pipeline.simhash_dedup(spark, documents_of(spark, rows), "")
    sets = []
    for r in rows:
        w = (r[1] or "").lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))})
    near = lambda a, b: rows[a][1] == rows[b][1] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    comp = list(range(len(rows)))
    while True:
        new = [min(comp[b] for b in range(len(rows)) if near(a, b)) for a in range(len(rows))]
        if new == comp:
            break
        comp = new
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = sorted((min((rows[i] for i in range(len(rows)) if comp[i] == c), key=order) for c in set(comp)), key=order)
    assert sorted(map(tuple, kept.collect()), key=order) == want and len(want) < len(rows) - 4
    cut = pipeline.suffix_dedup(spark, kept, "")
    assert cut.columns == list(pipeline.COLUMNS)
    seen: set[bytes] = set()
    expected = []
    for r in sorted(want, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        b = r[1].encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - pipeline.PASSAGE_BYTES + 1):
            if b[s : s + pipeline.PASSAGE_BYTES] in seen:
                gone[s : s + pipeline.PASSAGE_BYTES] = True
            seen.add(b[s : s + pipeline.PASSAGE_BYTES])
        expected.append((r[0], bytes(x for x, g in zip(b, gone) if not g).decode()))
    got = sorted(((r["doc_id"], r["text"]) for r in cut.collect()), key=lambda r: order((*r,)))
    assert got == sorted(expected, key=lambda r: order((*r,)))
    assert sum(passage in t for _, t in got) == 1
