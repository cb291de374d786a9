from __future__ import annotations

import datetime as dt
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skyloom.functions import dates, json_repair, text, url


def values(spark, column, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_url_normalize(spark):
    cases = {
        "http://Example.com/a/?utm_source=rss&id=7&fbclid=x#top": "https://example.com/a?id=7",
        "http://user:pw@Host.org:8080/x//": "https://host.org/x",
        "https://h.com//": "https://h.com",
        "https://h.com": "https://h.com/",
        "http://h.com/p?b=2&a=1&c=&ref=x&B=%7E*%20z": "https://h.com/p?B=~%2A+z&a=1&b=2",
        "http://h.com/p?REF=1": "https://h.com/p?REF=1",
        "": "https:///",
    }
    assert values(spark, url.url_normalize, list(cases)) == list(cases.values())


def test_url_hash_ignores_campaigns(spark):
    a, b = values(spark, url.url_hash, ["https://a.com/x?utm_campaign=1", "https://a.com/x"])
    assert a == b


def test_detect_lang(spark):
    rows = ["中国外交部今天表示", "Trade talks resume", "Россия и Украина", "これはテストです", "한국어 문장입니다", "هذا نص عربي", "", None]
    assert values(spark, text.detect_lang, rows) == ["zh", "en", "ru", "ja", "ko", "ar", "en", "en"]


def test_tokens(spark):
    tokens = values(spark, text.token_set, ["Trade talks on trade", "the the the", "中美 talks 谈判", None])
    assert tokens[0] == ["trade", "talks"] and tokens[1] == [] and tokens[3] == []
    assert set(tokens[2]) == {"中", "美", "talks", "谈", "判", "中美", "美谈", "谈判"}


def test_entities(spark):
    rows = ["United States and China hold trade talks in Beijing", "俄罗斯对乌克兰发动导弹袭击", "un homme", "US alone", "Chinatown"]
    assert values(spark, text.extract_entities, rows) == [["美国", "中国"], ["俄罗斯", "乌克兰"], ["联合国"], [], []]


ODD = ["The U.S. and Us", "u.s.a", "xu.s. U.S.", "us", "\u212aeys keys", "a\u0130r", "\U0001d400us \U0001d400", "éus", "us_us", "东us京 KEYS", "", None, "9us us9", "u.s", "USES used using", "white  house", "White House's", "trade1 2talks the3 a"]


def test_token_words_are_the_token_set(spark):
    rows = ["中美 talks 谈判 the 3中 talks", *ODD]
    assert [set(t) for t in values(spark, text.token_set, rows)] == [text.token_words(r or "") for r in rows]


@pytest.mark.parametrize("limit", [1, 12])
def test_entities_are_those_of_the_patterns(spark, limit):
    table = (("us", ("US", "U.S.", "white house")), ("key", ("keys", "air", "i")), ("none", ("absent",)), ("east", ("东", "京", "used")))

    def plain(t):
        whole = lambda a: re.search(f"(?<![a-z0-9]){re.escape(a.lower())}(?![a-z0-9])", t.lower()) if a.isascii() else a in t
        return [name for name, aliases in table if any(whole(a) for a in aliases)][:limit]

    got = values(spark, lambda c: text.extract_entities(c, limit, table), ODD)
    assert got == [plain(t or "") for t in ODD] and any(got)


def test_entities_try_no_pattern(spark):
    plan = spark.range(1).select(text.extract_entities(F.col("id").cast("string")))._jdf.queryExecution().toString()
    assert "RLIKE" not in plan.upper()


def test_keyword_hits(spark):
    words = ("us", "key", "东", "und")
    rows = ["und Und", "under und", "KEYS us", "keyed und used", "usual", "东us", "东 us key und", "", None]
    assert values(spark, lambda c: text.keyword_hits(c, words), rows) == [1, 1, 2, 3, 0, 1, 4, 0, 0]


@pytest.mark.parametrize(("a", "b", "want"), [(["a", "b"], ["a", "b"], 1.0), ([], ["a"], 0.0), (["a", "b"], ["b", "c"], 1 / 3)])
def test_jaccard(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(text.jaccard(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


def test_strip_html(spark):
    assert values(spark, text.strip_html, ["<p>a &amp; b</p>", " x\n\t<br/>y ", None]) == ["a & b", "x y", ""]


def test_strip_html_leaves_references_without_an_end(spark):
    texts = ["a &amp;&amp;&amp</title> b", "&ampx; &copy; &#65; &#x42; &#67 &amp;lt; &none;"]
    assert values(spark, lambda c: text.strip_html(c, unended=False), texts) == ["a &&&amp b", "&ampx; © A B &#67 &lt; &none;"]
    assert values(spark, text.strip_html, texts[:1]) == ["a &&& b"]


def test_sentences(spark):
    got = values(spark, lambda c: text.sentences(c, 2), ["First one. Second! Third?", "第一句。第二句。", "", "x" * 500])
    assert got == [["First one.", "Second!"], ["第一句。第二句。"], [], ["x" * 220]]


def test_normal_forms_by_slices(spark):
    texts = pa.array(["Éa ", None, "ﬁ"] * 300)
    for some in (texts, texts.slice(1, 257), texts.slice(0, 0)):
        assert text._by_slices(some, text.normalized, pa.string()).to_pylist() == [text.normalized(t) for t in some.to_pylist()]
    some = ["", " A\tb\x1c\x1f\nC ", "STRASSE Straße", "“a” ‘b’ –", "ﬁne…", "e\u0301", "a\xa0b", "ΑΣ", "外交部　发言", None]
    assert values(spark, text.normalize_text, some) == [text.normalized(t) for t in some]
    df = spark.createDataFrame([(1, some), (2, None), (3, [])], "i int, x array<string>")
    assert [r[0] for r in df.orderBy("i").select(text.normalize_texts("x")).collect()] == [[text.normalized(t) for t in some], [], []]


def test_spans(spark):
    def found(span, title, body):
        df = spark.createDataFrame([(span, title, body)], "s string, t string, b string")
        return df.select(text.span_in(text.normalize_text(F.col("s")), text.snapshot_text(F.col("t"), F.col("b")))).first()[0]

    assert found("imposed new  sanctions", "T", "They imposed new\nsanctions today")
    assert found("Title ends body starts", "the title ends", "Body starts here")
    assert found("外交部发言人", "标题", "外交部发言人表示")
    assert not found("never said this thing", "T", "other text")
    assert not found("sanction", "T", "sanction")
    assert not found("制", "制", "制")


def test_parse_date(spark):
    now = dt.datetime(2026, 1, 2, 3, 4, 5)
    rows = ["Mon, 31 Aug 2026 10:00:00 GMT", "31 Aug 2026 18:00:00 +0800", "2026-08-31T10:00:00Z", "2026-08-31T12:00:00+02:00", "2026-08-31", "soon", None, "2026-08-31T10:00:00.5Z"]
    got = values(spark, lambda c: dates.parse_date(c, now).cast("string"), rows)
    assert got == ["2026-08-31 10:00:00"] * 4 + ["2026-08-31 00:00:00"] + ["2026-01-02 03:04:05"] * 3


def test_json_repair(spark):
    assert json_repair.extract_json('{"a": "He said "stop" loudly", "b": 1}', repair=True) == {"a": 'He said "stop" loudly', "b": 1}
    assert json_repair.extract_json('<think>{no}</think>```json\n{"a": 1}\n```') == {"a": 1}
    assert json_repair.extract_json('{"a": ["x "y", z", "ok"], "b": "" in front", "c": "the "x": y"}', repair=True) == {"a": ['x "y", z', "ok"], "b": '" in front', "c": 'the "x": y'}
    assert json_repair.extract_json('{"a": "already \\"fine\\" here"}', repair=True) == {"a": 'already "fine" here'}
    for broken in ("nothing", "}{", '{"a": 1', '{"a": "line\nbreak"}', '{"a": }', '{"a": "open}'):
        with pytest.raises(ValueError):
            json_repair.extract_json(broken, repair=True)
    with pytest.raises(ValueError):
        json_repair.extract_json('{"a": "b "c" d"}')
    assert values(spark, json_repair.json_object, ['x {"a": "b "c" d"} y', "no"]) == ['{"a": "b \\"c\\" d"}', None]
