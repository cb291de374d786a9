"""Text functions as column expressions; Python only where Spark has no such function (normal forms, entities)."""

from __future__ import annotations

import html
import html.entities
import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from skyloom.lexicon import ENTITIES, STOPWORDS

CJK = r"一-鿿"
_BLOCKS = (("kana", r"぀-ヿ"), ("cjk", CJK), ("hangul", r"가-힯"), ("cyrillic", r"Ѐ-ӿ"), ("arabic", r"؀-ۿ"))
_LANGUAGES = (("ja", "kana", 0.05), ("zh", "cjk", 0.15), ("ko", "hangul", 0.15), ("ru", "cyrillic", 0.15), ("ar", "arabic", 0.15))


def script_ratio(text: Column, ranges: str) -> Column:
    """Share of the text's characters in the ranges; 0 for null and empty texts."""
    t = F.coalesce(text, F.lit(""))
    return F.char_length(F.regexp_replace(t, f"[^{ranges}]+", "")) / F.greatest(F.char_length(t), F.lit(1))


def detect_lang(text: Column) -> Column:
    """Language by script: ja, zh, ko, ru, ar, or else en."""
    ranges, out = dict(_BLOCKS), F.lit("en")
    for language, block, least in reversed(_LANGUAGES):
        out = F.when(script_ratio(text, ranges[block]) > least, F.lit(language)).otherwise(out)
    return out


def tokenize(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Lower-case Latin words of two letters or more, single CJK characters and numbers, in order, without stopwords."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"([a-zA-Z]{{2,}}|[{CJK}]|[0-9]+)"), F.lit(1))
    lowered = F.transform(found, F.lower)
    return F.filter(lowered, lambda t: ~t.isin(*stopwords)) if stopwords else lowered


def token_set(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """The different tokens, and the pairs of CJK tokens that follow one another (whatever stands between them)."""

    def of(tokens: Column) -> Column:
        cjk = F.filter(tokens, lambda t: t.rlike(f"^[{CJK}]$"))
        pairs = F.zip_with(F.slice(cjk, 1, F.greatest(F.size(cjk) - 1, F.lit(0))), F.slice(cjk, 2, F.greatest(F.size(cjk) - 1, F.lit(0))), lambda a, b: F.concat(a, b))
        return F.array_distinct(F.concat(tokens, pairs))

    return F.element_at(F.transform(F.array(tokenize(text, stopwords)), of), 1)


_TOKEN, _STOP = re.compile(f"[a-zA-Z]{{2,}}|[{CJK}]|[0-9]+"), frozenset(STOPWORDS)


def token_words(s: str) -> set[str]:
    """token_set of one text, in Python."""
    found = [t for t in map(str.lower, _TOKEN.findall(s)) if t not in _STOP]
    cjk = [t for t in found if not t.isascii()]
    return {*found, *map(str.__add__, cjk, cjk[1:])}


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 if either is empty or null."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / either).otherwise(F.lit(0.0))


_SPACED = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))


def _occurs(alias: bytes, low: bytes, spaced: bytes) -> bool:
    """Whether an ASCII alias stands whole in a text; spaced: the text with spaces at its ends and for all but letters and digits."""
    if alias.isalnum():
        return b" " + alias + b" " in spaced
    at = low.find(alias)
    while at >= 0 and not (spaced[at] == spaced[at + len(alias) + 1] == 32):
        at = low.find(alias, at + 1)
    return at >= 0


def extract_entities(text: Column, limit: int = 20, entities: tuple[tuple[str, tuple[str, ...]], ...] = ENTITIES) -> Column:
    """Names of the entities of which an alias occurs, in the order of the table: ASCII aliases whole and whatever their
    case, others as they are. In Python, as a pattern that tries each place of a text takes many times as long."""
    whole = [(name, [a.lower().encode() for a in aliases if a.isascii()], [a.encode() for a in aliases if not a.isascii()]) for name, aliases in entities]

    def names(low: bytes, t: bytes) -> list[str]:
        spaced, out = b" " + low.translate(_SPACED) + b" ", []
        for name, ascii_, others in whole:
            if len(out) < limit and (any(_occurs(a, low, spaced) for a in ascii_) or any(a in t for a in others)):
                out.append(name)
        return out

    @F.arrow_udf(ArrayType(StringType()))
    def found(low: pa.Array, t: pa.Array) -> pa.Array:
        return _by_slices(low.cast(pa.binary()), names, pa.list_(pa.string()), t.cast(pa.binary()))

    t = F.coalesce(text, F.lit(""))
    return found(F.lower(t), t if any(others for _, _, others in whole) else F.lower(t))


def keyword_pattern(keyword: str) -> str:
    """A Java pattern: ASCII keywords whole, whatever their case, with the endings s, es, ed, ing; others as they are."""
    if keyword.isascii():
        return rf"(?i)(?<![\p{{L}}\p{{N}}\p{{M}}_]){re.escape(keyword)}(?:s|es|ed|ing)?(?![\p{{L}}\p{{N}}\p{{M}}_])"
    return re.escape(keyword)


def keyword_hits(text: Column, keywords: tuple[str, ...]) -> Column:
    """How many different keywords occur. A pattern is tried only on texts that have its keyword, whole or not."""
    keywords, text = [k.strip() for k in keywords if k.strip()], F.coalesce(text, F.lit(""))
    low = F.lower(text)
    counts = [((low.contains(k.lower()) & text.rlike(keyword_pattern(k))) if k.isascii() else text.contains(k)).cast("int") for k in keywords]
    return sum(counts[1:], counts[0]) if counts else F.lit(0)


def sentences(text: Column, n: int = 2, max_len: int = 220) -> Column:
    """The first n sentences (white space after .!?。！？ ends one), each cut to max_len characters."""
    parts = F.split(trimmed(F.coalesce(text, F.lit(""))), r"(?U)(?<=[.!?。！？])\s+")
    return F.transform(F.slice(F.filter(F.transform(parts, trimmed), lambda s: s != ""), 1, n), lambda s: F.left(s, F.lit(max_len)))


def trimmed(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    """Character references decoded."""
    return s.map(lambda x: None if x is None else html.unescape(x))


_ENDED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")


def _ended(reference: re.Match) -> str:
    whole = reference[0]
    return html.unescape(whole) if whole[1] == "#" or whole[1:] in html.entities.html5 else whole


@F.pandas_udf(StringType())
def unescape_ended(s: pd.Series) -> pd.Series:
    """Character references that a semicolon ends decoded."""
    return s.map(lambda x: None if x is None else _ENDED.sub(_ended, x))


def strip_html(text: Column, unended: bool = True) -> Column:
    """Tags become spaces, runs of white space one space; then character references are decoded and the ends trimmed.
    unended: also references without their semicolon, where HTML knows them so (&amp)."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", " "), r"(?U)\s+", " ")
    return trimmed(unescape(plain) if unended else unescape_ended(plain))


_PUNCTUATION = str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'", "–": "-", "—": "-", "…": "..."})


def normalized(s: str | None) -> str:
    """Compatibility normal form, plain quotes and dashes, single spaces, case folded."""
    return " ".join(unicodedata.normalize("NFKC", s or "").translate(_PUNCTUATION).split()).casefold().strip()


_SLICE = 256


def _by_slices(values: pa.Array, one, kind: pa.DataType, *more: pa.Array) -> pa.Array:
    """one of each value (and those of more arrays); few of them at a time are Python's strings, whatever the length of a batch's texts."""
    parts = [pa.array([one(*x) for x in zip(*[a.slice(i, _SLICE).to_pylist() for a in (values, *more)])], kind) for i in range(0, len(values), _SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


@F.arrow_udf(StringType())
def normalize_text(s: pa.Array) -> pa.Array:
    return _by_slices(s, normalized, pa.string())


@F.arrow_udf(ArrayType(StringType()))
def normalize_texts(s: pa.Array) -> pa.Array:
    """normalize_text of each text of an array; a null array is empty."""
    return _by_slices(s, lambda texts: [normalized(t) for t in texts or ()], pa.list_(pa.string()))


def span_in(span: Column, haystack: Column) -> Column:
    """Whether a normalized span occurs in a normalized snapshot; spans of under 12 characters (6 with CJK) don't count."""
    least = F.when(span.rlike(f"[{CJK}]"), 6).otherwise(12)
    return F.coalesce((F.char_length(span) >= least) & haystack.contains(span), F.lit(False))


def snapshot_text(title: Column, text: Column) -> Column:
    """The normalized snapshot in which spans are looked up; they may cross from the title into the text."""
    return normalize_text(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))))


def mapped(key: Column, labels: dict[str, str]) -> Column:
    """The key's label, or the key where it has none."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[key], key)


def mermaid_text(s: Column) -> Column:
    return F.left(F.translate(s, '"|', "'/"), F.lit(60))
