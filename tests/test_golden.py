"""Small cases with results that the rules give by hand, lookarounds among them."""

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import cleaning, jsonx, keywords

CLEANED = {
    cleaning.remove_time_expressions: [("8点半到", "半到"), ("12:30:45开会", "开会"), ("价格9.90元", "价格元"), ("我十分喜欢", "我喜欢"), ("一点也不贵", "也不贵"), ("紧接着来", "紧来"), ("199.99元", "199.99元"), ("早上8点到", "到"), ("8点11秒", ""), ("8点123x", "x"), ("1.2.3.4", ".4"), ("无", "无")],
    cleaning.remove_date_expressions: [("2024-11-10日买", "买"), ("199.99元", "1元"), ("大前天到", "大到"), ("星期一发", "星发"), ("上星期三发", "三发"), ("第三天坏", "坏"), ("去年今天", ""), ("好", "好")],
    cleaning.remove_dates: [("2024.11.10买的", "2024.买的"), ("昨天早上8点到", "到"), ("刚刚收到", "收到")],
    cleaning.preprocess_comment: [("昨天到了！！！\n很好  很好", "到了！很好 很好"), ("质量&amp;包装。。。", "质量&包装。"), ("https://x.y 好", "https:/x.y 好")],
    cleaning.preprocess_training: [("看 https://x.y/z 好😀吗", "看 好吗"), ("昨天买的！！很ok", "买的！！很"), ("电话13812345678号", "电话号")],
    jsonx.source_text: [("开头\n【待处理评论】\n很好用\n\n请严格输出", "很好用"), ("【待处理文本】\n质量\n不错\n\n请严格", "质量\n不错"), ("待处理文本：便宜\n\n其他", "便宜"), ("没有标记", "没有标记"), ("", "")],
}


@pytest.mark.parametrize("make", list(CLEANED), ids=lambda f: f.__name__)
def test_cleaned(spark, make):
    rows = spark.createDataFrame(CLEANED[make], "t string, want string").select("t", "want", make(F.col("t")).alias("got")).collect()
    assert [(r["t"], r["got"]) for r in rows] == CLEANED[make]


def test_time_and_date_keywords(spark):
    time = {"早上": True, "8点": True, "十分钟": True, "12:30": True, "稍后": True, "质量": False, "差评": False, "〇点": True, "9.90": True, "199.9": False}
    date = {"2024年": True, "三月": True, "星期一": True, "周末": True, "Q3": True, "上旬": True, "月底": True, "第3季度": True, "质量": False, "大前天": True, "3-4": True, "星期": False}
    for make, cases in ((keywords.is_time_keyword, time), (keywords.is_date_keyword, date)):
        rows = spark.createDataFrame([(w,) for w in cases], "w string").select("w", make(F.col("w")).alias("hit")).collect()
        assert {r["w"]: r["hit"] for r in rows} == cases


def test_least_spans(spark):
    cases = [("已经退货", "没退货", -1), ("衣服不怎么粘肉", "不粘肉", 5), ("聊个不停聊了一天", "聊天", 4), ("ab ab", "ab", 2), ("", "x", -1), ("好评", "好 评", 2), ("好差好评", "好评", 2)]
    df = spark.createDataFrame([c[:2] for c in cases], "t string, w string")
    got = df.selectExpr(f"{keywords.min_span('w', 't')} as span", f"coalesce({keywords.span_valid('w', 't')}, false) as ok").collect()
    assert [(r["span"], r["ok"]) for r in got] == [(s, 0 <= s <= 2 * len(w.replace(" ", ""))) for _, w, s in cases]


def test_keyword_keys(spark):
    cases = {'{"关键词": [["a", "好", 1]]}': 1, '{"keywords": [1, 2]}': 2, '{"关键词": [], "keywords": [1]}': 0, '{"x": 1}': 0}
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", F.size(jsonx.keyword_items(F.col("t"))).alias("n")).collect()
    assert {r["t"]: r["n"] for r in rows} == cases
