"""A query for each operator over the whole test tables, and the same in DuckDB's SQL.

Inputs that the tables lack are made from them by expressions that both engines share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import jsonx as J
from ..functions import keywords as K
from ..functions import prompts as P
from ..functions import rewards as W
from ..functions.schema import KEYWORD_SCHEMA, SENTIMENT_SCHEMA, ExtractionTask, FieldSpec, Kind, TaskSchema
from ..functions.spans import min_span_udf
from ..operators import datasets, extraction, fallback, keyword_rows
from ..operators.clients import canned, canned_pairs
from ..sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Dealt to more tasks where the file is read by a few: a round-robin exchange of a small table."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if len(df.inputFiles()) < n else df


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---- cleaning over documents and pages ----


def cleaner(name: str, make: Callable[[Column], Column], sql: str, source: str = "documents", key: str = "doc_id", text: str = "text", tail: str = "") -> None:
    """Both engines clean the column with the same tail appended; the result is the text's length and MD5."""

    @query(name, f"select {key}, length(c) as n, md5(c) as h from (select {key}, {sql.replace('{t}', f'(coalesce({text}, ' + repr('') + f') || {quoted(tail)})')} as c from {source})")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = make(F.concat(F.coalesce(F.col(text), F.lit("")), F.lit(tail)))
        return spread(table(spark, sf_dir, source).select(key, text)).select(key, made.alias("c")).select(key, F.length("c").cast("long").alias("n"), F.md5(F.col("c").cast("binary")).alias("h"))


def rx(text: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({text}, {quoted(pattern)}, {quoted(to)}, 'g')"


def rx_all(text: str, *patterns: str) -> str:
    for p in patterns:
        text = rx(text, p)
    return text


def words_gone(text: str, words: list[str]) -> str:
    for w in words:
        text = f"replace({text}, {quoted(w)}, '')"
    return text


_marks = """!！?？。.，,、；;：:"'（）()【】[]《》<>…~～@#￥$%^&*_+-=｜|/\\"""


def collapsed(text: str) -> str:
    for m in dict.fromkeys(_marks):
        text = rx(text, ("\\" + m if m in "?.()[]$^*+|/\\-" else m) + "{2,}", "\\\\" if m == "\\" else m)
    return text


SPACES = r"[\s\x1C-\x1F\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_squeezed = lambda t: rx(rx(t, SPACES + "+", " "), "^ | $")
_no_urls = lambda t: rx_all(t, r"https?://\S+|ftp://\S+", r"www\.\S+")
_email = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
_garbled = lambda t: rx_all(words_gone(rx(t, f"[{C.ZERO_WIDTH}]"), C.GARBLED_WORDS), r"[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]", r"[\x{200E}\x{200F}\x{202A}-\x{202E}]", r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]")
_symbols = lambda t: f"translate({rx(t, f'[{C.SYMBOL_RANGES}]')}, {quoted(C.SYMBOLS)}, '')"
_numbers = lambda t: f"translate({t}, '０１２３４５６７８９', '0123456789')"
_emojis = lambda t: rx(t, f"[{C.EMOJI_RANGES}]+")

_odd = " 😀🚀 a​b 锟斤拷  →★™ １２３ mail x@y.org 13812345678 see www.a.b/c?d http://e.f/g ok"
cleaner("clean_ws_chars", C.remove_whitespace_chars, "translate({t}, chr(10) || chr(13) || chr(9) || chr(11) || chr(12), '')")
cleaner("clean_urls", C.remove_urls, _no_urls("{t}"), "pages", "page_id", "url", " and www.x.y/z text")
cleaner("clean_emails", C.remove_emails, rx("{t}", _email), tail=_odd)
cleaner("clean_phones", C.remove_phone_numbers, rx("{t}", r"1[3-9]\d{9}"), tail=_odd)
cleaner("clean_fullwidth", C.normalize_numbers, _numbers("{t}"), tail=_odd)
cleaner("clean_emojis", C.remove_emojis, _emojis("{t}"), tail=_odd)
cleaner("clean_garbled", C.remove_garbled_text, _garbled("{t}"), tail=_odd)
cleaner("clean_symbols", C.remove_special_symbols, _symbols("{t}"), tail=_odd)
cleaner("preprocess_advanced", C.advanced_preprocess, _numbers(_symbols(_emojis(rx(rx(_no_urls(_garbled("{t}")), _email), r"1[3-9]\d{9}")))), tail=_odd)
cleaner("clean_text", C.clean_text, _squeezed(collapsed(rx(rx("{t}", "[a-zA-Z]+"), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{E000}-\x{F8FF}]"))), tail=_odd)
_cjk = lambda t: f"translate({t}, 'etaoinshrdlu', '好快电池屏幕质量物流包装')"
cleaner("clean_keep_cjk", lambda t: C.keep_chinese_only(F.translate(t, "etaoinshrdlu", "好快电池屏幕质量物流包装")), rx(_cjk("{t}"), r"[^ \x{4E00}-\x{9FFF}" + C.CJK_MARKS + r"\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨]"))

#: Letters to digits, numerals, units, days and hours, so that whole documents hold the expressions that the rules take out.
_clock = ("etaoinsrhlducmpgbfyw", "8点分好1年月日三天昨今早上周第期号刚在")
_timed = lambda t: f"translate(replace(lower({t}), '.', '。'), {quoted(_clock[0])}, {quoted(_clock[1])})"
_timed_column = lambda t: F.translate(F.replace(F.lower(t), F.lit("."), F.lit("。")), *_clock)


def rule_sql(text: str, patterns: list[str]) -> str:
    """The patterns in order. DuckDB's expressions can't look around, so two are put otherwise: runs of digits are marked for the one; the other names what may follow."""
    for p in patterns:
        if p.startswith(r"(?<!\d)"):
            whole = rx(text, r"(\d+)", "\x01\\1\x02")
            text = f"translate({rx(whole, '\x01' + r'\d{1,2}' + '\x02' + r'\.' + '\x01' + r'\d{1,2}' + '\x02' + r'(\.' + '\x01' + r'\d{1,2}' + '\x02' + ')?')}, {quoted('\x01\x02')}, '')"
        elif p.endswith("(?![分秒])"):
            text = rx(text, rf"\d+{SPACES}*点{SPACES}*\d+(\d[分秒])|\d+{SPACES}*点{SPACES}*\d+([^分秒\d]|$)", r"\1\2")
        else:
            text = rx(text, p.replace(r"\s", SPACES))
    return text


_times_gone = lambda t: words_gone(rule_sql(t, C.TIME_PATTERNS), C.TIME_WORDS)
_days_gone = lambda t: rule_sql(words_gone(rule_sql(t, C.DATE_PATTERNS), C.DATE_WORDS), C.SPAN_PATTERNS)
_dates_gone = lambda t: _days_gone(_times_gone(t))
_ws_gone = lambda t: f"translate({t}, chr(10) || chr(13) || chr(9) || chr(11) || chr(12), '')"
_control_gone = lambda t: rx(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}\x{FEFF}\x{E000}-\x{F8FF}]")
_comment_sql = lambda t: _squeezed(collapsed(_control_gone(_dates_gone(_ws_gone(t)))))
_advanced_sql = lambda t: _symbols(_emojis(rx(rx(_no_urls(_garbled(t)), _email), r"1[3-9]\d{9}")))
_chinese_sql = lambda t: rx(t, r"[^ \x{4E00}-\x{9FFF}" + C.CJK_MARKS + r"\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨]")
_training_sql = lambda t: f"substr({_squeezed(_chinese_sql(_dates_gone(_ws_gone(_numbers(_advanced_sql(t))))))}, 1, 512)"
cleaner("clean_time", lambda t: C.remove_time_expressions(_timed_column(t)), _times_gone(_timed("{t}")), tail=" 12:30:45 x 9")
cleaner("clean_date", lambda t: C.remove_date_expressions(_timed_column(t)), _days_gone(_timed("{t}")), tail=" 2024-11-10 x 大前天 上星期三")
cleaner("clean_dates", lambda t: C.remove_dates(_timed_column(t)), _dates_gone(_timed("{t}")), tail=" 2024-11-10 早上8点")
cleaner("preprocess_comment", lambda t: C.preprocess_comment(_timed_column(t)), _comment_sql(_timed("{t}")), tail=_odd)
cleaner("preprocess_training", lambda t: C.preprocess_training(_timed_column(t)), _training_sql(_timed("{t}")), tail=_odd)
cleaner("preprocess_inference", C.preprocess_inference, f"substr({_advanced_sql(_comment_sql('{t}'))}, 1, 512)", tail=" on 9.90 and 199.99 at 8.30.15, " + _odd)


# ---- keyword rows and lists over the words of all conversation turns ----

_letters = r"[^\p{L}]+"
WORDS_SQL = f"""
    l as (select conv_id * 1000 + turn as id, text, list_filter(string_split(lower({rx("coalesce(text, '')", _letters, ' ')}), ' '), lambda w: w <> '') as ws from conversations),
    k as (select id, text, unnest(ws) as keyword, generate_subscripts(ws, 1) - 1 as pos from l),
    r as (select id, text, keyword, pos::int as pos, (length(keyword) % 10) / 10.0::double as score from k)
"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"))


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, text, kws: all words of a turn as keyword structs."""
    words = F.filter(F.split(F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), _letters, " ")), " "), lambda w: w != "")
    made = F.transform(words, lambda w, i: F.struct(F.lit("").alias("reasoning"), w.alias("keyword"), ((F.length(w) % 10) / F.lit(10.0)).alias("score"), i.alias("pos")))
    return _turns(spark, sf_dir).select("id", "text", made.alias("kws"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir).select("id", F.explode("kws").alias("k")).select("id", "k.keyword", "k.score", "k.pos")


def list_step(name: str, make: Callable[[Column], Column], where: str = "true", order: str = "pos", source: str = "r") -> None:
    """A list step: the words that stay, joined in order."""

    @query(name, f"with {WORDS_SQL}, s as (select * from {source} where {where}) select l.id, count(s.keyword) as n, md5(coalesce(string_agg(s.keyword, '|' order by {order}), '')) as h from l left join s on l.id = s.id group by l.id")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        kept = _lists(spark, sf_dir).select("id", K.words_only(make(F.col("kws"))).alias("w"))
        return kept.select("id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", "|").cast("binary")).alias("h"))


_first = "(select * from (select *, row_number() over (partition by id, keyword order by score desc, pos) as a from r) where a = 1)"
_top = lambda source, n: f"(select * from (select *, row_number() over (partition by id order by score desc, pos) as b from {source}) where b <= {n})"
STOP = ["the", "of", "and", "der", "die", "que"]
_stop_sql = "(" + ", ".join(map(quoted, STOP)) + ")"
_stop_part = " and ".join(f"not contains(keyword, {quoted(w)})" for w in STOP)
def _with_empty(kws: Column) -> Column:
    """The words with empty and blank ones before, between and behind them."""
    none = [F.struct(F.lit("").alias("reasoning"), F.lit(w).alias("keyword"), F.lit(0.5).alias("score"), F.lit(0).alias("pos")) for w in ("", " \t", "\u3000")]
    return F.concat(F.array(*none), F.flatten(F.transform(kws, lambda k: F.array(k, none[1]))))


list_step("kw_drop_empty", lambda k: K.drop_empty(_with_empty(k)))
list_step("kw_sort", K.sort_by_score, order="score desc, pos")
list_step("kw_dedupe", lambda k: K.dedupe(K.sort_by_score(k)), order="score desc, pos", source=_first)
list_step("kw_min_score", lambda k: K.min_score(k, 0.5), "score >= 0.5")
list_step("kw_no_english", K.no_english, "not regexp_matches(keyword, '[a-zA-Z]')")
list_step("kw_stop_list", lambda k: K.no_stopwords(k, STOP), f"keyword not in {_stop_sql}")
list_step("kw_max_len", lambda k: K.max_length(k, 6), "length(keyword) <= 6")
list_step("kw_topn", lambda k: K.top_n(K.sort_by_score(k), 8), order="score desc, pos", source=_top("r", 8))
list_step("kw_project", lambda k: k)
_kept = f"(select * from {_first} where keyword not in {_stop_sql} and length(keyword) <= 6)"
_time_sql = "not regexp_matches(keyword, '" + "|".join([r"[零〇一二三四五六七八九十百千万亿]+\s*[点时分秒]", *K.DAY_PARTS, *C.TIME_WORDS]) + "')"


#: Letters to ideographs, so that words hold days, hours, stopwords and, where a letter is left, Latin.
_ideographs = ("etaoinsrhldu", "好快电池年点昨天早屏质量")
_made_words = f"select id, low, translate(keyword, {quoted(_ideographs[0])}, {quoted(_ideographs[1])}) as keyword, pos, score from (select r.*, translate(lower(l.text), {quoted(_ideographs[0])}, {quoted(_ideographs[1])}) as low from r join l using (id))"
_number_sql = r"([零〇一二三四五六七八九十百千万亿壹贰叁肆伍陆柒捌玖拾佰仟萬億两]+|\d+)"
_hours = "|".join([rf"{_number_sql}\s*[点时分秒]", *K.DAY_PARTS, *C.TIME_WORDS])
_days = "|".join([rf"{_number_sql}\s*[年月号日]", "^[号日]$", "(周|星期|礼拜)[一二三四五六日天]", "工作日", "周末", "双休", *K.RELATIVE_DAYS, "月[初中末底]", rf"第?{_number_sql}\s*季度"])
_good = f"trim(keyword) <> '' and score >= 0.2 and not regexp_matches(keyword, '[a-zA-Z]') and not contains(keyword, '好好') and not regexp_matches(keyword, {quoted(_hours)}) and not regexp_matches(keyword, {quoted(_days)}) and length(keyword) <= 6 and contains(low, keyword)"


@query("kw_post_process", f"""
    with {WORDS_SQL}, m as ({_made_words} union all select l.id, '', '九点', 900, 0.9 from l union all select l.id, '', '昨天', 901, 0.8 from l union all select l.id, '', '', 902, 0.7 from l union all select l.id, '', '不在', 903, 0.6 from l),
    d as (select * from (select *, row_number() over (partition by id, keyword order by score desc, pos) as a from m) where a = 1 and {_good}),
    s as (select * from (select *, row_number() over (partition by id order by score desc, pos) as b from d) where b <= 8)
    select l.id, coalesce(string_agg(s.keyword, '|' order by score desc, pos), '') as keywords from l left join s on l.id = s.id where l.text <> '' group by l.id""")
def kw_post_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of a turn, as ideographs, and some odd ones, through all steps: empty, sorted, deduplicated, score, Latin, stopwords, time, date, length, original text, top n."""
    lists = _lists(spark, sf_dir).where("text <> ''").withColumn("low", F.translate(F.lower("text"), *_ideographs))
    made = F.transform("kws", lambda k: F.struct(k["reasoning"].alias("reasoning"), F.translate(k["keyword"], *_ideographs).alias("keyword"), k["score"].alias("score"), k["pos"].alias("pos")))
    odd = [F.struct(F.lit("").alias("reasoning"), F.lit(w).alias("keyword"), F.lit(x).alias("score"), F.lit(900 + i).alias("pos")) for i, (w, x) in enumerate([("九点", 0.9), ("昨天", 0.8), ("", 0.7), ("不在", 0.6)])]
    lists = lists.withColumn("kws", F.concat(made, F.array(*odd)))
    done = K.post_process("kws", "low", least=0.2, english=False, stopwords=["好好"], contains=True, n=8, ratio=1.0)
    return lists.select("id", F.array_join(K.words_only(done), "|").alias("keywords"))


def row_step(name: str, make: Callable[[DataFrame, DataFrame], DataFrame], sql: str) -> None:
    @query(name, f"with {WORDS_SQL} {sql}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(_rows(spark, sf_dir), spark.createDataFrame([(w,) for w in STOP], "word string")).select("id", "keyword", "score", "pos")


row_step("kw_stop_exact", keyword_rows.stop_exact, f"select id, keyword, score, pos from r where keyword not in {_stop_sql}")
row_step("kw_stop_contains", keyword_rows.stop_contains, f"select id, keyword, score, pos from r where {_stop_part}")
row_step("kw_dedupe_rows", lambda r, _: keyword_rows.keep_first(r), f"select id, keyword, score, pos from {_first}")
row_step("kw_topn_rows", lambda r, _: keyword_rows.top_n(r, 8), f"select id, keyword, score, pos from {_top('r', 8)}")

def predicate(name: str, make: Callable[[Column], Column], pattern: str, more: str = "false") -> None:
    """The words of all turns, letters turned to numerals, units and days, for which the predicate holds."""
    hit = f"(regexp_matches(k, {quoted(pattern)}) or {more})"

    @query(name, f"with {WORDS_SQL}, m as (select id, pos, translate(keyword, {quoted(_clock[0])}, {quoted(_clock[1])}) as k from r) select l.id, count(m.k) as n, md5(coalesce(string_agg(m.k, '|' order by m.pos), '')) as h from l left join m on m.id = l.id and {hit} group by l.id")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = F.transform("kws", lambda k: F.translate(k["keyword"], *_clock))
        kept = _lists(spark, sf_dir).select("id", F.filter(made, make).alias("w"))
        return kept.select("id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", "|").cast("binary")).alias("h"))


_all_numerals = r"([〇零一二三四五六七八九十百千万亿壹贰叁肆伍陆柒捌玖拾佰仟萬億两]+|\d+)"
predicate("kw_no_time", K.is_time_keyword, "|".join([rf"{_all_numerals}[点时分秒]", *K.DAY_PARTS, *C.TIME_WORDS]))
predicate(
    "kw_no_date", K.is_date_keyword, "|".join([rf"{_all_numerals}[年月号日]", "^[号日]$", "(周|星期|礼拜)[一二三四五六日天]", "工作日", "周末", "双休", *K.RELATIVE_DAYS, "月[初中末底]", rf"第?{_all_numerals}季度", r"[Qq]\d+"]),
    "(contains(k, '旬') and regexp_matches(k, '[上中下]'))",
)


@query(
    "kw_min_span",
    "with t as (select conv_id * 1000 + turn as id, coalesce(text, '') as t, case role when 'user' then 'an on' else 'in de' end as word from conversations), p as (select *, replace(word, ' ', '') as w from t), "
    "q as (select *, list_filter(range(1, length(t) + 1), lambda i: substr(t, i, 1) = substr(w, 1, 1)) as s from p), "
    "e as (select *, list_transform(s, lambda i: struct_pack(a := i, b := list_reduce(list_prepend(i, range(2, length(w) + 1)), lambda x, j: case when x = 0 then 0 when strpos(substr(t, x + 1), substr(w, j, 1)) = 0 then 0 else x + strpos(substr(t, x + 1), substr(w, j, 1)) end))) as z from q), "
    "m as (select id, length(w) as n, coalesce(list_min(list_transform(list_filter(z, lambda q: q.b > 0), lambda q: q.b - q.a + 1)), -1)::int as span from e) select id, span, span >= 0 and span <= 2 * n as ok from m",
)
def kw_min_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least span of a word with a blank in every turn, and whether it is near enough."""
    rows = spread(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.coalesce("text", F.lit("")).alias("t"), F.when(F.col("role") == "user", "an on").otherwise("in de").alias("w")))
    return rows.selectExpr("id", f"{K.min_span('w', 't')} as span", f"coalesce({K.span_valid('w', 't')}, false) as ok")


@query("kw_in_original", f"with {WORDS_SQL}, s as (select * from r where contains(lower(text), keyword)) select l.id, count(s.keyword) as n, md5(coalesce(string_agg(s.keyword, '|' order by pos), '')) as h from l left join s on l.id = s.id group by l.id")
def kw_in_original(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of a turn, and one whose letters stand nowhere together."""
    odd = F.array(F.struct(F.lit("").alias("reasoning"), F.lit("qxzj").alias("keyword"), F.lit(0.4).alias("score"), F.lit(1 << 30).alias("pos")))
    lists = _lists(spark, sf_dir).select("id", F.lower("text").alias("low"), F.concat("kws", odd).alias("kws"))
    kept = lists.select("id", K.words_only(F.filter("kws", lambda k: K.near_in_text(k["keyword"], F.col("low")))).alias("w"))
    return kept.select("id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", "|").cast("binary")).alias("h"))


_span_word = "case lang when 'en' then 'thing' when 'de' then 'deutsch' when 'fr' then 'monde' else 'mundo' end"


@query(
    "kw_span_valid",
    f"with t as (select doc_id, text as t, {_span_word} as w from documents), p as (select doc_id, w, t, list_filter(range(1, length(t) + 1), lambda i: substr(t, i, 1) = substr(w, 1, 1)) as s from t), "
    "e as (select doc_id, w, list_transform(s, lambda i: struct_pack(a := i, b := list_reduce(list_prepend(i, list_transform(range(2, length(w) + 1), lambda j: j)), lambda x, j: case when x = 0 then 0 when strpos(substr(t, x + 1), substr(w, j, 1)) = 0 then 0 else x + strpos(substr(t, x + 1), substr(w, j, 1)) end))) as z from p) "
    "select doc_id, coalesce(list_min(list_transform(list_filter(z, lambda q: q.b > 0), lambda q: q.b - q.a + 1)), -1)::int as span from e",
)
def kw_span_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least span in whole texts, by Arrow batches: the array form is quadratic in long texts."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(f"{_span_word}").alias("w")))
    return docs.select("doc_id", min_span_udf(F.col("w"), F.col("text")).alias("span"))


# ---- answers: JSON in free text, made from whole documents ----

ANSWER_SQL = """case doc_id % 7
    when 0 then concat('{"keywords": [["r", "', w, '", 0.9], ["s", "ab", "0.5"]], "category": "a"}')
    when 1 then concat('```json {"keywords": [["', w, '", 0.25], ["x", "y", "z", 1], "t"]} ```')
    when 2 then concat('<think>', w, '</think> so {"result": {"keywords": [["r", "cd", true]]}}')
    when 3 then concat(w, ' {"other": 1, "n": null} ', w)
    when 4 then concat('{"keywords": [["r", "', w)
    when 5 then concat('<think>short</think>{"keywords": [["a", "bc", 0.5], ["a", "bc", 1.5], ["a", "bcdef", 0.5]]}')
    else '' end"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.withColumn("w", F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-z ]+", "")).select("doc_id", "w", F.expr(ANSWER_SQL).alias("raw"))


ANSWERS = f"a as (select doc_id, w, {ANSWER_SQL} as raw from (select doc_id, regexp_replace(coalesce(text, ''), '[^a-z ]+', '', 'g') as w from documents))"
#: What stands between the outer braces, if it is an object.
OBJ = "o as (select *, case when json_valid(regexp_extract(raw, '(?s)\\{.*\\}')) then regexp_extract(raw, '(?s)\\{.*\\}') end as obj from a)"
_kw = "json_extract(obj, '$.keywords')"


def on_answers(name: str, make: Callable[[], dict[str, Column]], sql: str, whole: bool = False) -> None:
    """``make`` is called when the query runs: columns need a session. ``sql`` names its own source if it is ``whole``."""

    @query(name, f"with {ANSWERS}, {OBJ} select doc_id, {sql}" + ("" if whole else " from o"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return answers(spark, sf_dir).withColumn("obj", J.greedy_object(F.col("raw"))).select("doc_id", *(c.alias(k) for k, c in make().items()))


_text = lambda j, path: F.get_json_object(j, path)
_parsed = lambda: J.parse_response(F.col("raw"), ["keywords"])
_fenced = "case when starts_with(raw, '```json') then trim(replace(replace(raw, '```json', ''), '```', '')) else raw end"
_whole = f"case when json_valid(regexp_extract({_fenced}, '(?s)\\{{.*\\}}')) then regexp_extract({_fenced}, '(?s)\\{{.*\\}}')::json end"
_inner = "list_filter(list_transform(json_keys(j), lambda k: json_extract(j, '$.\"' || k || '\"')), lambda v: json_type(v) = 'OBJECT' and list_contains(json_keys(v), 'keywords'))"
on_answers(
    "parse_response",
    lambda: {"found": _parsed().isNotNull(), "first": F.md5(F.coalesce(_text(_parsed(), "$.keywords[0][1]"), F.lit("")).cast("binary"))},
    f"x is not null as found, md5(coalesce(x->'keywords'->0->>1, '')) as first from (select doc_id, case when list_contains(json_keys(j), 'keywords') then j else ({_inner})[1] end as x from (select doc_id, {_whole} as j from o))",
    whole=True,
)
on_answers("parse_required", lambda: {"has": J.has_required(F.col("obj"), ["keywords", "category"])}, "(obj is not null and coalesce(list_has_all(json_keys(obj), ['keywords', 'category']), false)) as has")
_brace = lambda: J.parse_first_last_brace(F.col("raw"))
on_answers("parse_first_last_brace", lambda: {"found": _brace().isNotNull(), "n": F.coalesce(F.length(_brace()), F.lit(0)).cast("long")}, "(case when raw <> '' and json_valid(raw) then raw else obj end) is not null as found, coalesce(length(case when raw <> '' and json_valid(raw) then raw else obj end), 0)::bigint as n")
_thinking = lambda: J.extract_thinking(F.col("raw"))
_stripped = rx("x", f"^{SPACES}+|{SPACES}+$")
on_answers("reward_extract_thinking", lambda: {"has": _thinking().isNotNull(), "h": F.md5(F.coalesce(_thinking(), F.lit("")).cast("binary"))}, "regexp_matches(raw, '<think>[\\s\\S]*?</think>') as has, md5(trim(regexp_extract(raw, '<think>([\\s\\S]*?)</think>', 1))) as h")
on_answers("reward_parse_json", lambda: {"valid": J.reward_json(F.col("raw"), _thinking()).isNotNull()}, "obj is not null as valid")


@query("parse_dpo_pair", "with a as (select doc_id, case when doc_id % 4 = 0 then concat('<chosen>{\"k\": 1} ', t, '</chosen><rejected> x ', t, '</rejected>') when doc_id % 4 = 1 then concat('<chosen>', t) when doc_id % 4 = 2 then concat(t, '<chosen> ', t, '</chosen>') else '' end as raw, t from (select doc_id, regexp_replace(coalesce(text, ''), '[^a-z ]+', '', 'g') as t from documents)) "
    "select doc_id, md5(coalesce(c, '')) as chosen, md5(coalesce(r, '')) as rejected, coalesce(json_valid(regexp_extract(c, '(?s)\\{.*\\}')), false) as parsed from (select doc_id, "
    "case when strpos(raw, '<chosen>') > 0 and strpos(raw, '</chosen>') > 0 then trim(substr(raw, strpos(raw, '<chosen>') + 8, greatest(0, strpos(raw, '</chosen>') - strpos(raw, '<chosen>') - 8))) end as c, "
    "case when strpos(raw, '<rejected>') > 0 and strpos(raw, '</rejected>') > 0 then trim(substr(raw, strpos(raw, '<rejected>') + 10, greatest(0, strpos(raw, '</rejected>') - strpos(raw, '<rejected>') - 10))) end as r from a)")
def parse_dpo_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-z ]+", "").alias("t"))
    raw = F.expr("case when doc_id % 4 = 0 then concat('<chosen>{\"k\": 1} ', t, '</chosen><rejected> x ', t, '</rejected>') when doc_id % 4 = 1 then concat('<chosen>', t) when doc_id % 4 = 2 then concat(t, '<chosen> ', t, '</chosen>') else '' end")
    p = spread(docs).select("doc_id", J.parse_dpo(raw).alias("p"))
    h = lambda c: F.md5(F.coalesce(F.col(f"p.{c}"), F.lit("")).cast("binary")).alias(c)
    return p.select("doc_id", h("chosen"), h("rejected"), F.col("p.chosen_json").isNotNull().alias("parsed"))


_prompt_sql = "case lang when 'en' then concat('开头', chr(10), '【待处理评论】', chr(10), t, chr(10), chr(10), '请严格输出') when 'de' then concat('【待处理文本】 ', chr(10), t) when 'fr' then concat('待处理文本： ', t, chr(10), chr(10), '其他') else t end"
_marked = lambda p: f"case when regexp_matches(p, {quoted(p)}) then {rx(f'regexp_extract(p, {quoted(p)}, 1)', f'^{SPACES}+|{SPACES}+$')} end"


@query("reward_source_text", f"select doc_id, length(c) as n, md5(c) as h from (select doc_id, coalesce({', '.join(_marked(p) for p in J.SOURCE_PATTERNS)}, p) as c from (select doc_id, {_prompt_sql} as p from (select *, coalesce(text, '') as t from documents)))")
def reward_source_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts around whole documents, by language with one of the marks or none."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("t")))
    mark = {"en": ("开头\n【待处理评论】\n", "\n\n请严格输出"), "de": ("【待处理文本】 \n", ""), "fr": ("待处理文本： ", "\n\n其他")}
    prompt = F.col("t")
    for lang, (before, after) in mark.items():
        prompt = F.when(F.col("lang") == lang, F.concat(F.lit(before), F.col("t"), F.lit(after))).otherwise(prompt)
    return docs.select("doc_id", J.source_text(prompt).alias("c")).select("doc_id", F.length("c").cast("long").alias("n"), F.md5(F.col("c").cast("binary")).alias("h"))


_key_sql = "case lang when 'en' then concat('{\"关键词\": ', w, '}') when 'de' then concat('{\"x\": 1, \"keywords\": ', w, '}') when 'fr' then concat('{\"keywords\": ', w, ', \"关键词\": [[]]}') else concat('{\"other\": ', w, '}') end"
_words_json = "'[\"' || replace(regexp_replace(coalesce(text, ''), '[^a-z ]+', ''{g}), ' ', '\",\"') || '\"]'"


@query("parse_keywords_key", f"select doc_id, coalesce(json_array_length(j), 0)::bigint as n, md5(coalesce(j->>0, '')) as first from (select doc_id, coalesce(json_extract(x, '$.\"关键词\"'), json_extract(x, '$.keywords')) as j from (select doc_id, ({_key_sql})::json as x from (select doc_id, lang, {_words_json.replace('{g}', ", 'g'")} as w from documents)))")
def parse_keywords_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with either key, both or none, whose items are all words of a document."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).selectExpr("doc_id", "lang", f"{_words_json.replace('{g}', '')} as w")
    items = docs.select("doc_id", J.keyword_items(F.expr(_key_sql)).alias("k"))
    return items.select("doc_id", F.size("k").cast("long").alias("n"), F.md5(F.coalesce(F.try_variant_get(F.get("k", F.lit(0)), "$", "string"), F.lit("")).cast("binary")).alias("first"))


def _normal(kind: str) -> Column:
    return K.normalize(J.keyword_items(J.greedy_object(F.col("raw")), ("keywords",)), kind)


_items_sql = "coalesce(json_extract(obj, '$.keywords[*]'), [])"
_score_sql = lambda x: f"coalesce(case when json_type({x}) = 'BOOLEAN' then case when {x}->>'$' = 'true' then 1.0 else 0.0 end when json_type({x}) in ('UBIGINT', 'BIGINT', 'DOUBLE', 'VARCHAR') then try_cast({x}->>'$' as double) end, 0.5)"


def item_sql(kind: str) -> str:
    """A normalised item by the rule of its kind, null if it isn't one."""
    made = lambda k, v: f"case when json_type({k}) = 'VARCHAR' then struct_pack(k := {k}->>'$', s := {_score_sql(v)}::double) end"
    if kind == "old":
        return f"case when json_type(i) = 'ARRAY' and json_array_length(i) >= 2 then {made('(i->0)', '(i->1)')} end"
    return f"case when json_type(i) = 'ARRAY' then case when json_array_length(i) = 3 then {made('(i->1)', '(i->2)')} when json_array_length(i) = 2 and json_type(i->0) = 'VARCHAR' and json_type(i->1) in ('UBIGINT', 'BIGINT', 'DOUBLE', 'VARCHAR') then {made('(i->0)', '(i->1)')} end end"


def normalised(kind: str) -> str:
    return f"list_filter(list_transform({_items_sql}, lambda i: {item_sql(kind)}), lambda x: x is not null)"


def normal_query(name: str, kind: str) -> None:
    @query(name, f"with {ANSWERS}, {OBJ} select doc_id, coalesce(array_to_string(list_transform({normalised(kind)}, lambda x: md5(x.k) || ':' || x.s::varchar), ' '), '') as kws from o")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        one = lambda k: F.concat(F.md5(k["keyword"].cast("binary")), F.lit(":"), k["score"].cast("string"))
        return answers(spark, sf_dir).select("doc_id", F.array_join(F.transform(_normal(kind), one), " ").alias("kws"))


normal_query("kw_normalize_new", "new")
normal_query("kw_normalize_old", "old")


@query("kw_post_process_result", f"""
    with {ANSWERS}, {OBJ}, n as (select doc_id, {normalised('new')} as ks from o),
    x as (select doc_id, unnest(ks) as q, generate_subscripts(ks, 1) as pos from n),
    f as (select doc_id, q.k as k, q.s as s, pos, row_number() over (partition by doc_id, q.k order by q.s desc, pos) as a from x where trim(q.k) <> ''),
    t as (select *, row_number() over (partition by doc_id order by s desc, pos) as b from f where a = 1 and length(k) <= 40)
    select n.doc_id, coalesce(string_agg(t.k, '|' order by s desc, pos), '') as keywords from n left join t on t.doc_id = n.doc_id and b <= 8 group by n.doc_id""")
def kw_post_process_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed answers to final keywords: normalised and processed. The text is empty, so none is left out for standing elsewhere."""
    rows = answers(spark, sf_dir).withColumn("kws", K.normalize(J.keyword_items(J.greedy_object(F.col("raw")), ("keywords",)))).withColumn("none", F.lit(""))
    return rows.select("doc_id", F.array_join(K.words_only(K.post_process("kws", "none", longest=40)), "|").alias("keywords"))


@query("kw_post_process_answers")
def kw_post_process_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every parsed answer to final keywords, mixed items too, with the time, date and in-original filters on."""
    rows = answers(spark, sf_dir).withColumn("kws", K.normalize(J.keyword_items(J.greedy_object(F.col("raw")), ("keywords",))))
    return rows.select("doc_id", F.array_join(K.words_only(K.post_process("kws", "w", longest=40)), "|").alias("keywords"))


# ---- rewards ----


def reward_query(name: str, columns: list[str], sql: dict[str, str], preset: str = "keyword") -> None:
    """Whole documents as completions; the solution is one fixed list, the prompt the document's text."""
    body = ", ".join(f"round(({sql[c]})::double, 9) as {c}" for c in columns)

    @query(name, f"with {ANSWERS}, {SCORED} select doc_id, {body} from sc")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        gold = F.lit('{"keywords": [["r", "bc", 1], ["r", "cd", 1]]}')
        parts = W.reward_struct(F.col("raw"), gold, F.concat(F.col("w"), F.lit(" bc")), W.PRESETS[preset])
        return answers(spark, sf_dir).select("doc_id", parts.alias("p")).select("doc_id", *(F.round(f"p.{c}", 9).alias(c) for c in columns))


_strip_sql = lambda t: rx(t, f"^{SPACES}+|{SPACES}+$")
_keywords_sql = "coalesce(json_extract(rj, '$.keywords[*]'), [])"
_words_of = lambda items: f"list_filter(list_transform({items}, lambda i: case when json_type(i) = 'ARRAY' and json_array_length(i) >= 2 then trim(coalesce(i->>1, 'None')) when json_type(i) = 'VARCHAR' then trim(i->>'$') end), lambda x: x is not null)"
#: Of each answer: its thinking, the object behind it, that object's items and words, and the words of the fixed solution.
SCORED = rf"""
    th as (select *, regexp_matches(raw, '<think>[\s\S]*?</think>') as has, {_strip_sql("regexp_extract(raw, '<think>([\\s\\S]*?)</think>', 1)".replace(chr(92) * 2, chr(92)))} as think,
        case when regexp_matches(raw, '<think>[\s\S]*?</think>') then regexp_extract(raw, '(?s)^.*</think>(.*)$', 1) else raw end as rest from a),
    rj as (select *, case when json_valid(regexp_extract(rest, '(?s)\{{.*\}}')) then regexp_extract(rest, '(?s)\{{.*\}}')::json end as rj from th),
    sc as (select *, {_keywords_sql} as items, {_words_of(_keywords_sql)} as words, ['bc', 'cd'] as gold, coalesce(len(json_keys(rj)), 0) as n_keys from rj)"""


def reward_sql(c: W.RewardConfig) -> dict[str, str]:
    """The parts by their rules, from SCORED."""
    t, f, q, a = c.thinking_weight, c.format_weight, c.quality_weight, c.accuracy_weight
    words = " or ".join(f"contains(think, {quoted(x)})" for x in c.analysis_words)
    present = " + ".join(f"(case when coalesce(json_type(json_extract(rj, '$.{r}')), 'NULL') <> 'NULL' then 1 else 0 end)" for r in c.required)
    valid = f"len(list_filter(items, lambda i: json_type(i) = 'ARRAY' and json_array_length(i) = 3 and length(trim(coalesce(i->>1, 'None'))) between 1 and {c.max_keyword} and coalesce(case when json_type(i->2) = 'BOOLEAN' then case when i->>2 = 'true' then 1.0 else 0.0 end else try_cast(i->>2 as double) end between 0 and 1, false)))"
    both = "len(list_intersect(list_distinct(words), gold))"
    precision, recall = f"({both} / greatest(len(list_distinct(words)), 1.0))", f"({both} / len(gold)::double)"
    out = {
        "thinking": f"case when has then (0.5 + case when length(think) between {c.min_thinking} and {c.max_thinking} then 0.3 else 0 end + case when {words} then 0.2 else 0 end) * {t} else 0 end",
        "format": f"case when rj is null then 0 when n_keys > 0 then {f} else 0.75 * {f} end",
        "quality": f"case when n_keys = 0 then 0 else ({present}) / {len(c.required)}.0 * {q} + case when len(items) > 0 then {valid} / len(items)::double * (0.5 * {q}) - case when len(items) > {c.max_items} then 0.1 else 0 end else 0 end end",
        "penalty": f"least({c.most_penalty}, {c.penalty} * len(list_filter(words, lambda x: not contains(w || ' bc', x))))" if c.check_source else "0",
        "f1": f"case when {both} > 0 then 2 * {precision} * {recall} / ({precision} + {recall}) else 0 end",
    }
    start = f"({out['thinking']} + {out['format']})"
    out["total"] = f"case when rj is null then {start} else greatest(0, least(1, {start} + {out['quality']} - {out['penalty']} + {a} * ({out['f1']}))) end"
    return out


_sql = reward_sql(W.PRESETS["keyword"])
for _name, _col in (("reward_thinking", "thinking"), ("reward_format", "format"), ("reward_quality", "quality"), ("reward_hallucination", "penalty"), ("reward_f1", "f1"), ("reward_total", "total")):
    reward_query(_name, [_col], _sql)
for _preset in ("keyword", "sentiment", "entity"):
    reward_query(f"reward_preset_{_preset}", ["thinking", "format", "quality", "penalty", "total"], reward_sql(W.PRESETS[_preset]), _preset)

_words = lambda: W.scored_keywords(J.greedy_object(F.col("raw")))
on_answers("reward_keywords", lambda: {"n": F.size(_words()).cast("long"), "h": F.md5(F.array_join(_words(), "|").cast("binary"))}, f"len({_words_of(_items_sql)})::bigint as n, md5(coalesce(array_to_string({_words_of(_items_sql)}, '|'), '')) as h")
_gold = lambda: W.parse_solution(F.col("raw"))
on_answers("reward_parse_solution", lambda: {"n": F.size(_gold()).cast("long"), "h": F.md5(F.array_join(_gold(), "|").cast("binary"))},
    """len(list_filter(list_transform(coalesce(json_extract(obj, '$.keywords[*]'), []), lambda i: case when json_type(i) = 'ARRAY' and json_array_length(i) >= 2 then trim(i->>1) when json_type(i) = 'VARCHAR' then trim(i->>'$') end), lambda x: x is not null))::bigint as n,
    md5(coalesce(array_to_string(list_filter(list_transform(coalesce(json_extract(obj, '$.keywords[*]'), []), lambda i: case when json_type(i) = 'ARRAY' and json_array_length(i) >= 2 then trim(i->>1) when json_type(i) = 'VARCHAR' then trim(i->>'$') end), lambda x: x is not null), '|'), '')) as h""")  # fmt: skip
_some_value = "len(list_filter(list_transform(json_keys(obj), lambda k: json_extract(obj, '$.\"' || k || '\"')), lambda v: not (v::varchar in ('null', '[]', '{}')))) > 0"
on_answers("reward_has_content", lambda: {"has": F.coalesce(W.has_content(F.col("obj")), F.lit(False))}, f"coalesce(case when list_contains(json_keys(obj), 'keywords') then len({_items_sql}) > 0 else {_some_value} end, false) as has")
_items = lambda: F.coalesce(F.try_variant_get(F.try_parse_json("obj"), "$.keywords", "array<variant>"), F.array().cast("array<variant>"))
_valid_sql = "json_type(i) = 'ARRAY' and json_array_length(i) = 3 and length(trim(coalesce(i->>1, 'None'))) between 1 and 4 and coalesce(case when json_type(i->2) = 'BOOLEAN' then case when i->>2 = 'true' then 1.0 else 0.0 end else try_cast(i->>2 as double) end between 0 and 1, false)"
on_answers("reward_item_valid", lambda: {"n": F.size(F.filter(_items(), lambda i: W.item_valid(i, W.PRESETS["keyword"]))).cast("long")}, f"len(list_filter({_items_sql}, lambda i: {_valid_sql}))::bigint as n")


# ---- schemas ----

_checks = {
    "validate_string_len": (FieldSpec("t", Kind.STRING, min_length=500, max_length=2000), "case when length(t) < 500 then 'Field ''t'' length must not be less than 500' when length(t) > 2000 then 'Field ''t'' length must not exceed 2000' end"),
    "validate_enum": (FieldSpec("l", Kind.STRING, enum=["en", "de"]), "case when l not in ('en', 'de') then 'Field ''l'' value must be one of [''en'', ''de'']' end"),
    "validate_int_range": (FieldSpec("n", Kind.INTEGER, min_value=400, max_value=3000), "case when n < 400 then 'Field ''n'' must not be less than 400' when n > 3000 then 'Field ''n'' must not be greater than 3000' end"),
    "validate_float_range": (FieldSpec("f", Kind.FLOAT, min_value=0.5), "case when n / 1000.0 < 0.5 then 'Field ''f'' must not be less than 0.5' end"),
    "validate_bool": (FieldSpec("b", Kind.BOOLEAN), "case when l = 'fr' then 'Field ''b'' should be boolean type' end"),
    "validate_array": (FieldSpec("a", Kind.ARRAY, min_length=1, max_length=8, item_kind=Kind.STRING), "case when k > 8 then 'Field ''a'' array length must not exceed 8' end"),
}


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    made = lambda b: F.to_json(F.struct(F.col("text").alias("t"), F.col("lang").alias("l"), F.col("n_chars").alias("n"), (F.col("n_chars") / F.lit(1000.0)).alias("f"), F.split("text", "\n").alias("a"), b.alias("b")))
    return docs.select("doc_id", F.try_parse_json(F.when(F.col("lang") == "fr", made(F.lit("true"))).otherwise(made(F.col("n_chars") > 700))).alias("v"))


_record_sql = "(select doc_id, text as t, lang as l, n_chars as n, len(string_split(text, chr(10))) as k from documents)"


def validation(name: str, spec: FieldSpec, sql: str) -> None:
    @query(name, f"select doc_id, {sql} as error from {_record_sql}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _records(spark, sf_dir).select("doc_id", spec.error(F.col("v")).alias("error"))


for _name, (_spec, _check) in _checks.items():
    validation(_name, _spec, _check)


@query("validate_schema", f"select doc_id, array_to_string(list_filter([{', '.join(f'({x})' for x in [c for _, c in _checks.values()])}], lambda e: e is not null), '; ') as errors, len(list_filter([{', '.join(f'({x})' for x in [c for _, c in _checks.values()])}], lambda e: e is not null)) = 0 as is_valid from {_record_sql}")
def validate_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = TaskSchema("all", [s for s, _ in _checks.values()])
    out = _records(spark, sf_dir).select("doc_id", schema.errors(F.col("v")).alias("errors"))
    return out.select("doc_id", F.array_join("errors", "; ").alias("errors"), (F.size("errors") == 0).alias("is_valid"))


# ---- prompts and request parameters ----


def prompt_query(name: str, make: Callable[[Column], P.Pair], system: str, user: str) -> None:
    @query(name, f"select doc_id, md5({system}) as system, md5({user}) as user_prompt from (select doc_id, coalesce(text, '') as t, length({rx('coalesce(text, ' + quoted('') + ')', '^' + SPACES + '+|' + SPACES + '+$')}) < 10 as brief from documents)")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pair = make(F.coalesce("text", F.lit("")))
        return table(spark, sf_dir, "documents").select("doc_id", *(F.md5(c.cast("binary")).alias(k) for c, k in zip(pair, ("system", "user_prompt"), strict=True)))


_frame = lambda mark: f"concat({quoted(mark + chr(10))}, t, {quoted(chr(10) * 2 + P.CLOSING)})"
prompt_query("prompt_keyword", P.keyword_prompt, quoted(P.KEYWORD_SYSTEM), _frame(P.COMMENT_MARK))
prompt_query("prompt_keyword_short", P.short_keyword_prompt, quoted(P.KEYWORD_SHORT_SYSTEM), _frame(P.COMMENT_MARK))
prompt_query("prompt_dpo", P.dpo_prompt, quoted(P.DPO_SYSTEM), _frame(P.COMMENT_MARK))
_schema_text = SENTIMENT_SCHEMA.text()
prompt_query("prompt_default", lambda t: P.default_prompt(t, SENTIMENT_SCHEMA),
    f"case when brief then {quoted('直接输出符合下面 Schema 的 JSON：' + chr(10) + _schema_text)} else {quoted('你负责从文本里提取结构化数据，只输出符合下面 JSON Schema 的 JSON：' + chr(10) + _schema_text)} end",
    f"case when brief then concat('提取：', t) else {_frame(P.TEXT_MARK)} end")
_task = ExtractionTask("sentiment", SENTIMENT_SCHEMA, rules=["只看评价"])
_task_user = f"concat({quoted('Schema:' + chr(10) + _schema_text + chr(10) * 2 + P.rules_text(SENTIMENT_SCHEMA, ['只看评价']) + chr(10) * 2 + P.TEXT_MARK + chr(10))}, t, {quoted(chr(10) * 2 + P.CLOSING)})"
prompt_query("prompt_from_task", lambda t: P.PromptBuilder(_task).build(t), f"case when brief then {quoted('只输出 JSON：' + chr(10) + _schema_text)} else '你负责从文本里提取结构化数据。' end", f"case when brief then concat('提取：', t) else {_task_user} end")
_bare = f"concat({quoted('Schema:' + chr(10) + '{}' + chr(10) * 2 + P.TEXT_MARK + chr(10))}, t, {quoted(chr(10) * 2 + P.CLOSING)})"
prompt_query("prompt_sentiment", lambda t: P.sentiment_builder().build(t), "'你判断文本的情感。'", _bare)
prompt_query("prompt_entity", lambda t: P.entity_builder().build(t), "'你找出文本里的实体。'", _bare)


@query("llm_request_params", "select doc_id, (doc_id % 4)::int as attempt, (42 + doc_id % 4)::int as seed, 1024 as max_tokens, 0.0::double as temperature, case when doc_id % 4 >= 2 then 0.3::double end as frequency_penalty, case when doc_id % 4 >= 2 then 1.1::double end as repetition_penalty from documents")
def llm_request_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 4).cast("int").alias("attempt"))
    return docs.select("doc_id", "attempt", extraction.request_params_column(extraction.Config(), F.col("attempt")).alias("p")).select("doc_id", "attempt", "p.*")


@query("extract_batch")
def extract_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    return extraction.extract(turns, KEYWORD_SCHEMA, canned, extraction.Config(filter_not_in_original=False, max_keyword_length=40))


# ---- extraction without a model ----

_tok = f"string_split(lower({rx(chr(99) + 'oalesce(text, ' + quoted('') + ')', _letters, ' ')}), ' ')"


@query("fb_tfidf", f"""
    with t as (select doc_id as id, unnest({_tok}) as keyword from documents), k as (select * from t where length(keyword) >= 3),
    c as (select id, keyword, count(*) as c from k group by all), d as (select keyword, count(*) as df from c group by all),
    n as (select count(distinct doc_id) as n from documents),
    s as (select id, keyword, round(c / sum(c) over (partition by id) * (ln((n + 1.0) / (df + 1.0)) + 1.0), 6) as w from c join d using (keyword), n)
    select id, keyword, least(2 * w, 1.0)::double as score, rank::int as rank from (select *, row_number() over (partition by id order by w desc, keyword) as rank from s) where rank <= 8""")
def fb_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fallback.tfidf(spread(table(spark, sf_dir, "documents").selectExpr("doc_id as id", "text")))


@query("fb_simple", f"""
    with t as (select doc_id as id, {_tok} as w from documents), k as (select id, unnest(w) as keyword, generate_subscripts(w, 1) as pos from t),
    f as (select id, keyword, min(pos) as pos from k where length(keyword) >= 2 group by all)
    select id, keyword, 0.5::double as score, rank::int as rank from (select *, row_number() over (partition by id order by pos) as rank from f) where rank <= 20""")
def fb_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fallback.simple(spread(table(spark, sf_dir, "documents").selectExpr("doc_id as id", "text")))


_edges = "select id, a, b, count(*)::double as w from (select x.id, x.w as a, y.w as b from k x join k y on x.id = y.id and y.pos between x.pos + 1 and x.pos + 4 where x.w <> y.w union all select x.id, y.w, x.w from k x join k y on x.id = y.id and y.pos between x.pos + 1 and x.pos + 4 where x.w <> y.w) group by all"


@query("fb_textrank", f"""
    with t as (select conv_id * 1000 + turn as id, list_filter({_tok}, lambda w: length(w) >= 3) as ws from conversations),
    k as (select id, unnest(ws) as w, generate_subscripts(ws, 1) as pos from t), e as ({_edges}),
    g as (select id, a, b, w / sum(w) over (partition by id, a) as share from e),
    r1 as (select id, b as v, 0.15 + 0.85 * sum(share) as r from g group by all),
    r2 as (select g.id, b as v, 0.15 + 0.85 * sum(share * r) as r from g join r1 on g.id = r1.id and g.a = r1.v group by all),
    s as (select id, v, round(r / max(r) over (partition by id), 6) as w from r2)
    select id, v as keyword, least(2 * w, 1.0)::double as score, rank::int as rank from (select *, row_number() over (partition by id order by w desc, v) as rank from s) where rank <= 8""")
def fb_textrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fallback.textrank(_turns(spark, sf_dir), rounds=2)


@query("fb_textrank_settled")
def fb_textrank_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the operator's own number of rounds, which SQL would have to unroll."""
    return fallback.textrank(_turns(spark, sf_dir))


@query("fb_cjk", f"""
    with t as (select doc_id as id, lower(translate(coalesce(text, ''), 'etaoinshrdlu', '好快电池屏幕质量物流包装')) as t from documents),
    r as (select id, regexp_extract_all(t, '[\\x{{4E00}}-\\x{{9FFF}}]+|[a-zà-öø-ÿœßŸ]+') as r from t),
    x as (select id, flatten(list_transform(r, lambda w: case when regexp_matches(w, '^[\\x{{4E00}}-\\x{{9FFF}}][\\x{{4E00}}-\\x{{9FFF}}]') then list_transform(range(1, length(w)), lambda i: substr(w, i, 2)) else [w] end)) as w from r),
    k as (select id, unnest(w) as keyword, generate_subscripts(w, 1) as pos from x),
    f as (select id, keyword, min(pos) as pos from k where length(keyword) >= 2 group by all)
    select id, keyword, 0.5::double as score, rank::int as rank from (select *, row_number() over (partition by id order by pos) as rank from f) where rank <= 20""")
def fb_cjk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of ideographs and Latin letters: pairs of neighbours and words."""
    text = F.translate("text", "etaoinshrdlu", "好快电池屏幕质量物流包装")
    return fallback.simple(spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.alias("text"))))


_heard = "case when doc_id % 3 = 0 then 'model' when regexp_matches(t, '\\p{L}{3}') then 'fallback' else 'error' end"


@query("fb_route", f"""
    with p as (select doc_id, coalesce(text, '') as t from documents)
    select doc_id::varchar as id, {_heard} as route, case when doc_id % 3 = 0 then 1 else 4 end::int as attempts, case when doc_id % 3 = 0 then 'b' end as first_keyword from p""")
def fb_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What extraction answers from: a model that knows every third document, else the fallback, else nothing."""

    def knowing():
        def client(system: str, user: str, params: dict) -> str | None:
            return '{"keywords": [["r", "b", 0.9]]}' if "是yes" in user else "no json"

        return client

    docs = spread(table(spark, sf_dir, "documents")).selectExpr("doc_id as id", "coalesce(text, '') as text", "doc_id % 3 = 0 as known")
    builder = P.PromptBuilder(ExtractionTask("route", KEYWORD_SCHEMA))
    config = extraction.Config(filter_not_in_original=False, enable_preprocess=False)
    marked = docs.select("id", F.concat(F.when(F.col("known"), "是yes ").otherwise("是 "), "text").alias("text"))
    found = extraction.extract(marked, KEYWORD_SCHEMA, knowing, config, builder)
    route = F.when(F.col("is_fallback"), "fallback").when(F.col("error").isNull(), "model").otherwise("error")
    return found.select("id", route.alias("route"), "attempts", F.when(~F.col("is_fallback"), F.col("keywords")[0]).alias("first_keyword"))


# ---- data sets, sources and sinks ----


@query("sft_to_grpo", """
    with r as (select conv_id, coalesce(arg_max(text, turn) filter (where role = 'system'), '') as s, coalesce(arg_max(text, turn) filter (where role = 'user'), '') as u, coalesce(arg_max(text, turn) filter (where role = 'assistant'), '') as a from conversations group by conv_id)
    select conv_id, md5(s) as system, md5(u) as user_text, md5(a) as original_response from r where u <> ''""")
def sft_to_grpo(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = datasets.sft_to_grpo(table(spark, sf_dir, "conversations"))
    h = lambda c: F.md5(c.cast("binary"))
    return rows.select("conv_id", h(F.col("messages")[0]["content"]).alias("system"), h(F.col("messages")[1]["content"]).alias("user_text"), h(F.col("original_response")).alias("original_response"))


@query("grpo_max_samples", "select conv_id from (select distinct conv_id from conversations) order by conv_id limit 50")
def grpo_max_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.first_n(table(spark, sf_dir, "conversations").select("conv_id").distinct(), "conv_id", 50)


@query("dpo_sample", "select doc_id from documents order by md5('42-' || doc_id), doc_id limit 100")
def dpo_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.seeded_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", datasets.sample_size("comments.csv"))


@query("gen_index", "select doc_id, source, (row_number() over (partition by source order by doc_id) - 1)::bigint as index from documents")
def gen_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.indexed(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", "source")


def envelope_query(name: str, count: str, record: Callable[..., Column], last: str, made: Callable[[], Column], sql: str) -> None:
    line = f"concat('{{\"index\":', doc_id, ',\"original_comment\":', to_json(lang), ',\"preprocessed_comment\":', to_json(source), ',\"raw_response\":null,\"{last}\":', {sql}, '}}', case when doc_id < m then ',' else '' end)"

    @query(name, f"""
        with e as (select source as category, count(*) as n, min(doc_id) as f, max(doc_id) as m from documents group by source),
        r as (select source as category, doc_id as at, {line} as line from documents join e on source = category)
        select * from r union all select category, f - 1, concat('{{"category":', to_json(category), ',"{count}":', n, ',"results":[') from e union all select category, m + 1, ']}}' from e""")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents")
        row = record(F.col("doc_id"), F.col("lang"), F.col("source"), F.lit(None).cast("string"), made())
        return datasets.envelope_lines(docs, "source", row, "doc_id", count)


envelope_query("sink_sft_envelope", "total_count", datasets.sft_record, "keywords", lambda: F.array("lang", "source"), "concat('[', to_json(lang), ',', to_json(source), ']')")
envelope_query("sink_dpo_envelope", "actual_processed", datasets.dpo_record, "parsed_result", lambda: F.struct(F.col("n_chars").alias("chosen"), F.lit(None).cast("string").alias("rejected")), "concat('{\"chosen\":', n_chars, ',\"rejected\":null}')")


@query("gen_records", f"select doc_id as index, md5(c) as clean, true as parsed from (select doc_id, {_training_sql(_cjk("coalesce(text, '')"))} as c from documents) where {_strip_sql('c')} <> ''")
def gen_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record chain over all documents, as Chinese comments, with a canned model: cleaned, asked, parsed."""
    made = F.translate("text", "etaoinshrdlu", "好快电池屏幕质量物流包装")
    rows = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("index"), made.alias("comment"))
    out = datasets.generated(rows, canned_pairs)
    return out.select("index", F.md5(F.col("record.preprocessed_comment").cast("binary")).alias("clean"), F.col("record.parsed_result.chosen_json").isNotNull().alias("parsed"))


@query("src_item_coalesce", "select coalesce(doc_id::varchar, 'unknown') as id, length(coalesce(nullif(case when doc_id % 3 = 0 then '' when doc_id % 3 = 1 then lang end, ''), text, '')) as n from documents")
def src_item_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    describe = F.expr("case when doc_id % 3 = 0 then '' when doc_id % 3 = 1 then lang end")
    return docs.select(readers.item_id(F.col("doc_id")).alias("id"), F.length(readers.item_text(describe, F.col("text"))).cast("long").alias("n"))


@query("src_category_name", "select page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '^(.+)\\.[^.]*$', '\\1') as category from pages")
def src_category_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", readers.category_name(F.col("url")).alias("category"))


@query("src_jsonl_skip_bad", f"with {ANSWERS} select count(*) as n, sum(length(raw))::bigint as chars from (select trim(raw) as raw from a) where raw <> '' and json_valid(raw)")
def src_jsonl_skip_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.json_lines(answers(spark, sf_dir).select(F.col("raw").alias("value"))).agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars"))


@query("src_comment_column", "select lang as comment, count(*) as n from documents where lang <> 'fr' group by lang")
def src_comment_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.when(F.col("lang") == "fr", "NA").otherwise(F.col("lang")).alias("comment"), F.col("text"))
    return readers.comment_column(docs).groupBy("comment").agg(F.count("*").alias("n"))


_line = _strip_sql("line")


@query("src_stopwords", f"select distinct word from (select {_line} as word from (select unnest(string_split(text, chr(10))) as line from documents)) where word <> '' and not starts_with(word, '#')")
def src_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all documents as a list of words."""
    return readers.stopwords(table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value")))


from . import corpus_queries  # noqa: E402, F401  (registers its queries)
