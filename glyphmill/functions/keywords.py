"""Keyword lists as Column functions over arrays of (reasoning, keyword, score, pos): no shuffle.

The relational forms of the same steps are in ``glyphmill.operators.keyword_rows``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cleaning import TIME_WORDS
from .jsonx import let
from .spans import near_words

# ---- fixed values ----

#: Chinese numerals in keyword predicates; 〇 counts here.
NUMERAL = "[零〇一二三四五六七八九十百千万亿壹贰叁肆伍陆柒捌玖拾佰仟萬億两]+"
ANY_NUMBER = rf"(?:{NUMERAL}|\d+)"
DAY_PARTS = "早上 上午 中午 下午 晚上 夜里 凌晨 深夜 早晨 傍晚 黄昏".split()
RELATIVE_DAYS = "今天 今日 今儿 昨天 昨日 昨儿 明天 明日 明儿 前天 前日 后天 后日 大前天 大后天".split()
STOPWORDS = (
    "啥 咋 嘛 呗 哈 哦 嗯 呃 额 觉得 感觉 好像 似乎 可能 也许 大概 应该 东西 东东 这个 那个 什么 怎么 哪个 如何 很 非常 特别 十分 极其 相当 比较 有点 "
    "时候 时间 现在 以前 之前 以后 后来 一会 方面 问题 情况 事情 地方 不是 等 到 月 半多 平时 超级 看着 得起 还 元 你们 他们 我们 买个 这说 又 没多 用时 深深"
).split()

_number = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_special = r"(?i)^\s*[+-]?(inf|infinity|nan)\s*$"

KEYWORD = "struct<reasoning:string,keyword:string,score:double,pos:int>"


def to_score(text: Column, default: float | None = 0.5) -> Column:
    cast = F.when(text.rlike(_number) | text.rlike(_special), F.trim(text).try_cast("double"))
    return F.coalesce(cast, F.lit(default)) if default is not None else cast


def normalize(items: Column, json_format: str = "new") -> Column:
    """Keyword structs from an array of variants. An item that isn't an array of a known shape is dropped; a score that is no number is 0.5."""

    def get(item: Column, at: int, kind: str = "string") -> Column:
        return F.try_variant_get(item, f"$[{at}]", kind)

    def is_text(item: Column, at: int) -> Column:
        return F.schema_of_variant(F.try_variant_get(item, f"$[{at}]", "variant")) == "STRING"

    def score(item: Column, at: int) -> Column:
        inner = F.schema_of_variant(F.try_variant_get(item, f"$[{at}]", "variant"))
        text = get(item, at)
        truth = F.when(text == "true", 1.0).otherwise(0.0)
        return F.when(inner == "BOOLEAN", truth).otherwise(to_score(text))

    def size(item: Column) -> Column:
        return F.coalesce(F.size(F.try_variant_get(item, "$", "array<variant>")), F.lit(-1))

    def one(item: Column, pos: Column) -> Column:
        text = lambda at: F.coalesce(get(item, at), F.lit(""))
        if json_format == "old":
            made = F.struct(text(2).alias("reasoning"), get(item, 0).alias("keyword"), score(item, 1).alias("score"), pos.alias("pos"))
            return F.when((size(item) >= 2) & is_text(item, 0), made)
        three = F.struct(text(0).alias("reasoning"), get(item, 1).alias("keyword"), score(item, 2).alias("score"), pos.alias("pos"))
        two = F.struct(F.lit("").alias("reasoning"), get(item, 0).alias("keyword"), score(item, 1).alias("score"), pos.alias("pos"))
        return F.when((size(item) == 3) & is_text(item, 1), three).when((size(item) == 2) & is_text(item, 0), two)

    return F.filter(F.transform(items, one), lambda k: k.isNotNull())


def drop_empty(kws: Column) -> Column:
    """Of a word only the first character that is no white space is looked for."""
    return F.filter(kws, lambda k: k["keyword"].rlike(r"(?U)[^\s\x1C-\x1F]"))


def sort_by_score(kws: Column) -> Column:
    """Highest first, stable; a null score counts as 0."""
    keyed = F.transform(kws, lambda k: F.struct((-F.coalesce(k["score"], F.lit(0.0))).alias("s"), k["pos"].alias("p"), k.alias("k")))
    return F.transform(F.array_sort(keyed), lambda x: x["k"])


def dedupe(kws: Column) -> Column:
    """The first of each keyword in the present order; by sorting, so long lists stay cheap."""
    keyed = F.array_sort(F.transform(kws, lambda k, i: F.struct(k["keyword"].alias("w"), i.alias("i"), k.alias("k"))))
    before = lambda xs: F.arrays_zip(xs.alias("x"), F.concat(F.array(F.lit(None)), xs).alias("y"))
    first = F.filter(let(keyed, before), lambda z: z["x"].isNotNull() & (z["y"].isNull() | (z["x"]["w"] != z["y"]["w"])))
    return F.transform(F.array_sort(F.transform(first, lambda z: F.struct(z["x"]["i"].alias("i"), z["x"]["k"].alias("k")))), lambda x: x["k"])


def min_score(kws: Column, least: float) -> Column:
    return F.filter(kws, lambda k: F.coalesce(k["score"] >= least, F.lit(False)))


def no_english(kws: Column) -> Column:
    return F.filter(kws, lambda k: ~k["keyword"].rlike("[a-zA-Z]"))


def no_stopwords(kws: Column, words: list[str], contains: bool = False) -> Column:
    """For long lists use the join forms in ``keyword_rows``."""
    if not words:
        return kws
    stop = F.array(*map(F.lit, words))
    if contains:
        return F.filter(kws, lambda k: ~F.exists(stop, lambda w: F.contains(k["keyword"], w)))
    return F.filter(kws, lambda k: ~F.array_contains(stop, k["keyword"]))


def is_time_keyword(word: Column) -> Column:
    x = ANY_NUMBER
    pattern = "|".join([
        r"\d{1,2}:\d{1,2}", r"(?<!\d)\d{1,2}\.\d{1,2}(\.\d{1,2})?(?!\d)", rf"{x}\s*[点时]", rf"{x}\s*分", rf"{x}\s*秒", *DAY_PARTS, *TIME_WORDS,
    ])
    return word.rlike("(?U)" + pattern)


def is_date_keyword(word: Column) -> Column:
    x = ANY_NUMBER
    pattern = "|".join([
        rf"{x}\s*年", rf"{x}\s*月", rf"{x}\s*[号日]", r"^[号日]$", r"\d{1,2}[\./-]\d{1,2}", "(周|星期|礼拜)[一二三四五六日天]", "工作日", "周末", "双休",
        *RELATIVE_DAYS, "月[初中末底]", rf"第?{x}\s*季度", r"[Qq]\d+",
    ])
    tenth = F.contains(word, F.lit("旬")) & word.rlike("[上中下]")
    return word.rlike("(?U)" + pattern) | tenth


def max_length(kws: Column, most: int) -> Column:
    return F.filter(kws, lambda k: F.length(k["keyword"]) <= most) if most > 0 else kws


def min_span(keyword: str, text: str) -> str:
    """SQL for the least span of text that holds the keyword's characters in order, matched greedily from each start; -1 if there is none."""
    k, t = f"replace({keyword}, ' ', '')", text
    starts = f"filter(sequence(1, length({t})), i -> substring({t}, i, 1) = substring({k}, 1, 1))"
    end = f"aggregate(slice(split({k}, ''), 2, length({k})), i, (a, c) -> case when a = 0 then 0 else locate(c, {t}, a + 1) end)"
    spans = f"transform(filter(transform({starts}, i -> struct(i as st, {end} as en)), x -> x.en > 0), x -> x.en - x.st + 1)"
    return f"case when length({t}) = 0 or length({k}) = 0 then -1 when contains({t}, {k}) then length({k}) else coalesce(array_min({spans}), -1) end"


def span_valid(keyword: str, text: str, ratio: float = 2.0) -> str:
    """SQL: all characters occur, and within ratio times the keyword's length."""
    k = f"replace({keyword}, ' ', '')"
    span = min_span(keyword, text)
    return f"(size(array_except(split({k}, ''), split({text}, ''))) = 0 and ({span}) between 0 and {ratio}D * length({k}))"


def in_original(kws: str, text: str, ratio: float = 2.0) -> str:
    """SQL for the keywords whose characters stand close together in the text; an empty text keeps all."""
    return f"case when length({text}) = 0 then {kws} else filter({kws}, w -> {span_valid('w.keyword', text, ratio)}) end"


def top_n(kws: Column, n: int | None) -> Column:
    return F.slice(kws, 1, n) if n and n > 0 else kws


def words_only(kws: Column) -> Column:
    return F.transform(kws, lambda k: k["keyword"])


def post_process(
    kws: str, text: str, *, least: float | None = None, english: bool = True, stopwords: list[str] | None = None, contains: bool = False, time: bool = True, date: bool = True,
    longest: int = 6, original: bool = True, ratio: float = 2.0, n: int | None = 8, dedupe_words: bool = True, backfill: bool = True,
) -> Column:
    """All steps in order, for columns named ``kws`` and ``text``; no row leaves its partition.

    ``backfill`` changes nothing: it would fill up from the list that has passed the filters, of which none is left out when fewer than n are chosen.
    """
    # the longest go first: filters may change places, and no other rule need be tried on them
    steps: list[Callable[[Column], Column]] = [lambda k: max_length(k, longest), drop_empty, sort_by_score]
    if dedupe_words:
        steps.append(dedupe)
    if least is not None:
        steps.append(lambda k: min_score(k, least))
    if not english:
        steps.append(no_english)
    if stopwords:
        steps.append(lambda k: no_stopwords(k, stopwords, contains))
    if time:
        steps.append(lambda k: F.filter(k, lambda x: ~is_time_keyword(x["keyword"])))
    if date:
        steps.append(lambda k: F.filter(k, lambda x: ~is_date_keyword(x["keyword"])))
    col = F.col(kws)
    if original:  # looked up first, outside of the lambdas, where a kernel may run; the steps are filters, so the order is free
        told = near_words(words_only(col), F.col(text), ratio, longest)
        col = F.zip_with(col, told, lambda k, t: F.struct(*(k[c].alias(c) for c in ("reasoning", "keyword", "score", "pos")), t.alias("near")))
    for step in steps:
        col = step(col)
    if original:
        col = F.transform(F.filter(col, lambda x: x["near"]), lambda x: x.dropFields("near"))
    return top_n(col, n)


def _span(keyword: Column, text: Column) -> Column:
    """min_span for columns and lambda variables."""
    k = F.replace(keyword, F.lit(" "), F.lit(""))
    n = F.length(text)

    def reach(i: Column) -> Column:
        rest = F.slice(F.split(k, ""), 2, F.greatest(F.length(k), F.lit(1)))
        return F.aggregate(rest, i, lambda a, c: F.when(a == 0, F.lit(0)).otherwise(F.call_function("locate", c, text, a + 1)))

    starts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(1)) == F.substring(k, F.lit(1), F.lit(1)))
    spans = F.filter(F.transform(starts, lambda i: F.struct(i.alias("st"), reach(i).alias("en"))), lambda x: x["en"] > 0)
    least = F.array_min(F.transform(spans, lambda x: x["en"] - x["st"] + 1))
    return F.when((n == 0) | (F.length(k) == 0), F.lit(-1)).when(F.contains(text, k), F.length(k)).otherwise(F.coalesce(least, F.lit(-1)))


def near_in_text(keyword: Column, text: Column, ratio: float = 2.0) -> Column:
    """span_valid for columns and lambda variables; a keyword that stands in the text as it is needs no search."""
    k = F.replace(keyword, F.lit(" "), F.lit(""))
    every = F.size(F.array_except(F.split(k, ""), F.split(text, ""))) == 0
    span = _span(keyword, text)
    near = every & (span >= 0) & (span <= ratio * F.length(k))
    return F.when(F.contains(text, k) & (k != ""), F.lit(ratio >= 1)).otherwise(near)
