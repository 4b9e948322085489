"""Text functions: goldens, and re-statements of the rules on random strings."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T


def column(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, s string").select("i", *columns)
    return [tuple(r)[1:] for r in sorted(df.collect())]


def test_numbers():
    got = lambda s: [t for _, _, t in T.number_spans(unicodedata.normalize("NFKC", s))]
    assert got("上限为１亿元，不是１万元，共十项，比例１０％，另有百分之十，误差千分之一点五。") == ["100000000元", "10000元", "10项", "0.1比例", "0.1比例", "0.0015比例"]
    assert got("一万亿元与一百万元") == ["1000000000000元", "1000000元"]
    assert got("$1,234.50 ¥007 共两千零三家 3.10倍 9万") == ["1234.5美元", "7元", "2003家", "3.1倍", "90000"]


def test_dates():
    got = lambda s: list(dict.fromkeys(t for _, _, t in T.date_spans(s)))
    assert got("2026年1月1日") == ["2026-01-01", "2026-01", "2026"]
    assert got("于二〇二六年十二月三十一日和2025/3/4") == ["2026-12-31", "2026-12", "2026", "2025-03-04"]
    assert got("a2026年") == ["2026"] or got("a2026年") == []
    assert got("x2026-01-02 2026-1-2x") == []


@pytest.mark.parametrize(("s", "n"), [("十", 10), ("二十三", 23), ("一百零五", 105), ("三万二千", 32000), ("一亿零一", 100000001), ("二〇二六", 2026), ("", None), ("百x", None), ("万", 10000)])
def test_numeral(s, n):
    assert T.numeral(s) == n


def test_skeleton_and_digest():
    assert T.claim_skeleton("银行应当于2026年1月1日前缴纳10万元，不得逾期3日") == "银行<MODAL:should>于<DATE:2026-01-01>前缴纳<AMOUNT:CNY:100000>,<MODAL:must_not>逾期<COUNT:日:3>".replace(",", "，")
    assert T.fnv1a64('"hello"') == "fnv1a64:dcdd4ba1ec7623eb"
    assert T.normalized_range("额度 为 １ 0万", "额度为1 0万") == (0, 9)
    assert T.normalized_range("abc", "x") is None
    assert T.first_json('so: ```json\n{"a": "}", "b": [1]}\n``` ok') == '{"a": "}", "b": [1]}'
    assert T.first_json('see [1, note] then {"kind":"a"}') == T.first_json('use { first, then {"kind":"a"}') == '{"kind":"a"}'
    assert T.first_json('a {x] } {"b":[1]} {"c":2}') == '{"b":[1]}' and T.first_json("```JSON\n[1,2]\n```") == "[1,2]"
    assert T.first_json('"whole"') == '"whole"' and T.first_json(' 5 {"a":{"b":1}') == '{"b":1}' and T.first_json("[NaN]") is None
    assert T.first_json("[" * 5000) is None and T.first_json("") is None and T.first_json('{"n":' + "9" * 5000 + "}")


def squeeze_brute(s):
    out, k = "", 0
    while k < len(s):
        if re.match(T.WS, s[k]):
            end = k
            while end < len(s) and re.match(T.WS, s[end]):
                end += 1
            near = f"[{T.KEEP_BETWEEN}]"
            if out and end < len(s) and re.match(near, s[k - 1]) and re.match(near, s[end]):
                out += " "
            k = end
        else:
            out += s[k]
            k += 1
    return out


def test_squeeze(spark):
    r = random.Random(1)
    values = ["".join(r.choice("aZ9一年 　\n. ") for _ in range(r.randint(0, 12))) for _ in range(500)]
    assert [x[0] for x in column(spark, values, T.squeeze(F.col("s")))] == [squeeze_brute(v) for v in values]
    assert [T.squeezed(v) for v in values] == [squeeze_brute(v) for v in values]


def test_native_functions(spark):
    values = ["第三条　内容不得违反，应当执行。相应、须知", "x　第一条", None, "", "sk-abcdefgh1"]
    cols = [T.article_of(F.col("s")), T.modal_terms(F.col("s")), T.single_modal_contexts(F.col("s")), T.has_credentials(F.col("s"))]
    rows = column(spark, values, *cols)
    assert rows[0] == ("第三条", ["不得", "应当"], ["应:第三条内容不得违反，<应>当执行", "应:相<应>、须知", "须:相应、<须>知"], False)
    assert rows[1][0] is None and rows[2][0] is None and rows[4][3] is True
    assert column(spark, ["2026-01-01T00:00:00Z", "2026-13-01T00:00:00Z", "2026-01-01", None], T.utc_timestamp_valid(F.col("s"))) == [(True,), (False,), (False,), (False,)]
    assert column(spark, ["a b", " x\t\ny "], T.collapse_ws(F.col("s")), T.trim_ws(F.col("s"))) == [("a b", "a b"), ("x y", "x\t\ny")]


def test_in_order(spark):
    rows = [(1, ["a", "b"], ["x", "a", "a", "b"]), (2, ["b", "a"], ["a", "b"]), (3, [], []), (4, ["a"], []), (5, ["a", "a"], ["a"]), (6, ["a", "a"], ["a", "a"])]
    df = spark.createDataFrame(rows, "i long, w array<string>, o array<string>")
    got = {r.i: r.ok for r in df.select("i", T.in_order(F.col("w"), F.col("o")).alias("ok")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: False, 6: True}


def test_arrow_functions(spark):
    (row,) = column(spark, ["２０２６年１月 共３项"], T.nfkc("s"), T.date_tokens(T.nfkc("s")), T.number_tokens(T.nfkc("s")), T.digest("s"), T.norm_range("s", F.lit("共3项")))
    assert row[0] == "2026年1月 共3项" and row[1] == ["2026-01", "2026"] and row[2] == ["2026年", "1月", "3项"]
    assert tuple(row[4]) == (8, 11)


def test_protected_tokens(spark):
    texts = ["于2026年1月1日前应当缴纳１亿元，不得少于百分之十。", "no claims", "5 and 2024-01-02, 1,000.50 元", None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")
    rows = T.with_tokens(df).collect()
    shown = [(r.kind, r.token) for r in rows if r.id == 0]
    assert shown == [("date", "2026-01-01"), ("date", "2026-01"), ("date", "2026"), ("number", "2026年"), ("number", "1月"), ("number", "1日"), ("number", "100000000元"), ("number", "0.1比例"), ("modal", "应当"), ("modal", "不得"), ("claim", "<DATE:2026-01-01> "), ("claim", "<MODAL:should> "), ("claim", "<AMOUNT:CNY:100000000> "), ("claim", "<MODAL:must_not> "), ("claim", "<RATIO:0.1> ")]
    assert not [r for r in rows if r.id in (1, 3, 4)]
    plain = [unicodedata.normalize("NFKC", t) for t in texts if t]
    for s in plain:
        for kind, start, end, token in T.protected_spans(s):
            assert kind != "modal" or s[start:end] == token
        assert [t for k, _, _, t in T.protected_spans(s) if k == "number"] == [t for _, _, t in T.number_spans(s)]
        assert [t for k, _, _, t in T.protected_spans(s) if k == "date"] == [t for _, _, t in T.date_spans(s)]
    T.register_protected_tokens(spark)
    df.createOrReplaceTempView("claimed")
    lateral = spark.sql("select id, kind, start, end, token from claimed, lateral protected_tokens(text) where id = 2").collect()
    assert [tuple(r) for r in lateral] == [(2, *t) for t in T.protected_spans(texts[2])]
    both = df.select(T.nfkc("text").alias("t")).select(T.date_tokens("t").alias("d"), T.number_tokens("t").alias("n"), T.skeleton("t").alias("s")).collect()
    assert both[0].d == ["2026-01-01", "2026-01", "2026"] and both[1].n == [] and both[3].s is None and both[1].s == "no claims"


def test_digests_of_many():
    r = random.Random(9)
    texts = ["", "hello", "é😀", "x" * 3000, *("".join(r.choice("abé😀 ") for _ in range(r.randint(0, 60))) for _ in range(300))]
    for alone in (0, 16, 10**6):
        assert T.fnv1a64_all(texts, alone) == [T.fnv1a64(t) for t in texts]
    assert T.fnv1a64_all([]) == [] and T.fnv1a64_all(['"hello"']) == ["fnv1a64:dcdd4ba1ec7623eb"]


def test_canonical_json(spark):
    one = '{"a":{"k":[1,{"p":"é","q":null}],"x":100},"b":-0.5}'
    same = [one, ' { "b" : -5e-1, "a": {"x": 1E2, "k":[1.0,{"q":null,"p":"\\u00e9"}]} } ', '{"b":-0.50,"b":-0.500,"a":{"x":100.000,"k":[1,{"q":null,"p":"é"}]}}']
    assert {T.canonical(s) for s in same} == {one}
    assert T.canonical("1e500") == "1E+500" and T.canonical("-0.0") == "0" and T.canonical("9" * 30 + ".10") == "9" * 30 + ".1"
    assert T.canonical("[NaN]") is T.canonical("{") is T.canonical("") is None and T.canonical("[" * 100_000) is None
    assert T.canonical('{"b":1,"a":{"d":[],"c":{}}}') == '{"a":{"c":{},"d":[]},"b":1}' and T.canonical('"x"') == '"x"'
    got = spark.createDataFrame([(s,) for s in [*same, None, "{"]], "s string").select(T.json_digest("s").alias("h"), T.digest("s").alias("f")).collect()
    assert len({r.h for r in got[:3]}) == 1 and got[0].h and got[3].h is got[3].f is got[4].h is None and got[4].f == T.fnv1a64("{")


def test_squeeze_looks_back_only_from_white_space(spark):
    """The expression gives what the plain function gives, and does not look behind at every character."""
    import random

    r = random.Random(3)
    texts = ["".join(r.choice("ab1条一。. \t\n\u3000\u00a0") for _ in range(r.randint(0, 30))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.squeeze(F.col("t")).alias("s"), T.strip_ws(F.col("t")).alias("n"))
    assert all(x.s == T.squeezed(x.t) and x.n == "".join(c for c in x.t if c not in T.WHITE) for x in df.collect())
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert ", (?<" not in plan


def test_normal_text_of_one_string():
    rng = random.Random(11)
    pieces = ["a", "Z", "9", "零", "条", "é", "ﬁ", "１", "´", ",", "。", " ", "  ", "\t", "\n", " ", "　", "﻿", "\x85", "\x1c", "\x1f", " "]
    for _ in range(3000):
        s = "".join(rng.choice(pieces[: rng.choice((3, 10, 18, len(pieces)))]) for _ in range(rng.randint(0, 12)))
        assert T.normal_text(s) == squeeze_brute(unicodedata.normalize("NFKC", s)), repr(s)
    assert T.normal_text(" a b , c\x0b\x0cd ") == "a b,c d" and T.normal_text("") == ""
