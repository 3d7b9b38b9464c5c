"""Text cleaning as Column functions: each a fixed sequence of deletions, so order is part of the meaning."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# ---- fixed values: patterns, words and ranges that results depend on ----

#: Chinese numerals in cleaning.
NUMERAL = "[零一二三四五六七八九十百千万亿壹贰叁肆伍陆柒捌玖拾佰仟萬億两]+"

TIME_PATTERNS = [
    r"\d{1,2}:\d{1,2}(:\d{1,2})?",
    r"(?<!\d)\d{1,2}\.\d{1,2}(\.\d{1,2})?(?!\d)",
    r"\d+\s*点\s*\d+\s*分\s*\d+\s*秒",
    r"\d+\s*点\s*\d+\s*分",
    r"\d+\s*点\s*\d+(?![分秒])",
    r"\d+\s*[点时]\s*(?:钟)?",
    r"\d+\s*分\s*(?:钟)?",
    r"\d+\s*秒\s*(?:钟)?",
    NUMERAL + r"\s*[点时]\s*(?:钟)?",
    NUMERAL + r"\s*分\s*(?:钟)?",
    NUMERAL + r"\s*秒\s*(?:钟)?",
    r"\d+\s*[点时]\s*[多半来钟]",
    r"\d+\s*[点时]\s*(?:左右|上下)",
    r"差\s*\d+\s*分\s*\d+\s*[点时]",
    r"差\s*一刻\s*\d+\s*[点时]",
    r"\d+\s*[点时]\s*[一二三]刻",
    r"[早上中下晚夜凌深][上午里晨间夜]",
    r"[早上中下晚夜凌深][上午里晨间夜]\s*\d+\s*[点时]",
]
TIME_WORDS = "刚才 刚刚 现在 此刻 当前 目前 马上 立刻 立即 立马 即刻 稍后 待会 一会儿 过会 等会 随后 之后 然后 接着 紧接着".split()

DATE_PATTERNS = [
    r"\d{4}[-/年.]\d{1,2}[-/月.]\d{1,2}[日号]?",
    r"\d{1,2}[-/月.]\d{1,2}[日号]?",
    r"\d+\s*[年]",
    r"\d+\s*[月]",
    r"\d+\s*[日号]",
    NUMERAL + r"\s*[年]",
    NUMERAL + r"\s*[月]",
    NUMERAL + r"\s*[日号]",
]
DATE_WORDS = "昨天 今天 明天 前天 后天 大前天 大后天 昨日 今日 明日 上周 本周 下周 这周 上星期 本星期 下星期 这星期 上月 本月 下月 这月 上个月 这个月 下个月 去年 今年 明年 前年 后年".split()
SPAN_PATTERNS = [
    "第" + NUMERAL + "[天周月年]",
    r"第\d+[天周月年]",
    NUMERAL + "[天周月年][前后]",
    r"\d+[天周月年][前后]",
    "[星期周][一二三四五六七日天]",
    "礼拜[一二三四五六七日天]",
]

REPEATED_MARKS = r"""([!！?？。.，,、；;：:""''（）()【】\[\]《》<>…~～@#￥$%^&*_+\-=｜|/\\])\1+"""
CJK_MARKS = '，。！？；："（）【】《》、…—·'
EMOJI_RANGES = r"\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}\x{1FA70}-\x{1FAFF}\x{1F000}-\x{1F02F}\x{1F0A0}-\x{1F0FF}"
ZERO_WIDTH = r"\x{200B}\x{200C}\x{200D}\x{FEFF}\x{2060}"
GARBLED_WORDS = ["锟斤拷", "烫烫烫", "屯屯屯", "�"]
SYMBOL_RANGES = r"\x{2190}-\x{21FF}\x{2200}-\x{22FF}\x{2300}-\x{23FF}\x{2500}-\x{257F}\x{2580}-\x{259F}\x{25A0}-\x{25FF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}\x{2B00}-\x{2BFF}\x{20A0}-\x{20CF}"
SYMBOLS = "™®©§¶†‡•◦‣"

#: Of these characters, from each string one, must stand in a text for the pattern to match.
_needs = dict(zip(TIME_PATTERNS, [":", ".", "点 分 秒", "点 分", "点", "点时", "分", "秒", "点时", "分", "秒", "点时 多半来钟", "点时 左上", "差 分 点时", "差 刻 点时", "点时 刻", "", "点时"], strict=True))
_needs |= dict(zip(DATE_PATTERNS, ["-/年. -/月.", "-/月.", "年", "月", "日号", "年", "月", "日号"], strict=True))
_needs |= dict(zip(SPAN_PATTERNS, ["第", "第", "前后", "前后", "", "礼"], strict=True))

# ---- helpers ----

#: A pattern or a plain word, what takes its place (a function for a few), and what must stand in the text.
Step = tuple[re.Pattern | str, "str | Callable", list[str]]
#: Characters that are Python objects at once.
HELD = 1 << 20


def _python(pattern: str) -> str:
    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern)


def _deletion(pattern: str) -> Step:
    """Runs of digits are tried from their first digit alone, and not given back; what may follow them is no digit."""
    fast = r"\d(?<!\d\d)\d*+\s*+" + pattern[6:] if pattern.startswith(r"\d+\s*") else pattern
    return re.compile(_python(fast)), "", _needs.get(pattern, "").split()


def _done(text: str, steps: list[Step]) -> str:
    for what, to, needs in steps:
        if isinstance(what, str):
            text = text.replace(what, to)
        elif all(any(c in text for c in need) for need in needs):
            text = what.sub(to, text)
    return text


def rewritten(text: Column, steps: list[Step]) -> Column:
    """The text after all steps in order, in one Arrow kernel: a chain of engine expressions takes the text through as many conversions, and its character classes test member by member."""

    @F.arrow_udf(StringType())
    def run(texts: pa.Array) -> pa.Array:
        out, held, size = [], [], 0
        for t in texts:
            t = t.as_py()
            held.append(None if t is None else _done(t, steps))
            size += len(t or "")
            if size > HELD:
                out.append(pa.array(held, pa.string()))
                held, size = [], 0
        return pa.concat_arrays([*out, pa.array(held, pa.string())])

    return run(F.make_valid_utf8(text))


def strip(text: Column) -> Column:
    r"""Without white space, in the Unicode sense and \x1C to \x1F, at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)[\s\x1C-\x1F]+", " "))


#: Runs of one punctuation mark become a single one.
_collapsed: Step = (re.compile(REPEATED_MARKS), r"\1", [])
_squeezed: list[Step] = [(re.compile(r"\s+"), " ", []), (re.compile(r"^ +| +\Z"), "", [])]
#: Characters that are neither of the usual blocks nor line ends or tabs are looked up.
_controls: Step = (re.compile(r"[^\n\r\t -~\u00A1-\u00AC\u00AE-\u0377\u3001-\u303D\u4E00-\u9FFF\uFF01-\uFF5E]"), lambda m: "" if unicodedata.category(m[0])[0] == "C" else m[0], [])
_entities: list[Step] = [("&nbsp;", " ", []), ("&quot;", '"', []), ("&amp;", "&", []), ("&lt;", "<", []), ("&gt;", ">", [])]
_any_entity: Step = (re.compile(r"(?s)\A.*\Z"), lambda m: html.unescape(m[0]), ["&"])


def unescape_html(text: Column, udf: bool = True) -> Column:
    """Entities decoded; then five common ones once more. Without udf, only a chain of common entities is decoded."""
    return rewritten(text, _unescaped(udf))


def _unescaped(udf: bool) -> list[Step]:
    return [_any_entity, *_entities] if udf else _entities


# ---- the operators ----


_times: list[Step] = [*map(_deletion, TIME_PATTERNS), *((w, "", []) for w in TIME_WORDS)]
_days: list[Step] = [*map(_deletion, DATE_PATTERNS), *((w, "", []) for w in DATE_WORDS), *map(_deletion, SPAN_PATTERNS)]
_line_ends: Step = (re.compile("[\n\r\t\x0b\x0c]+"), "", [])


def remove_time_expressions(text: Column) -> Column:
    return rewritten(text, _times)


def remove_date_expressions(text: Column) -> Column:
    return rewritten(text, _days)


def remove_dates(text: Column) -> Column:
    return rewritten(text, _times + _days)


def _kept(numbers: bool = True, marks: bool = True) -> Step:
    keep = " \u4e00-\u9fff" + (CJK_MARKS if marks else "")
    keep += r"\d²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽❶-❾➀-➈➊-➒" if numbers else ""
    return re.compile(f"[^{keep}]+"), "", []


def keep_chinese_only(text: Column, numbers: bool = True, marks: bool = True) -> Column:
    """CJK ideographs and spaces, with digits and Chinese punctuation if wanted."""
    return rewritten(text, [_kept(numbers, marks)])


def _cleaned(english: bool = True, marks: bool = True, entities: bool = True, spaces: bool = True, control: bool = True, udf: bool = True) -> list[Step]:
    wanted = ((entities, _unescaped(udf)), (english, [(re.compile("[a-zA-Z]+"), "", [])]), (control, [_controls]), (marks, [_collapsed]), (spaces, _squeezed))
    return [s for yes, steps in wanted if yes for s in steps]


def clean_text(text: Column, *, english: bool = True, marks: bool = True, entities: bool = True, spaces: bool = True, control: bool = True, udf: bool = True) -> Column:
    """Flags name what is removed or put right."""
    return rewritten(text, _cleaned(english, marks, entities, spaces, control, udf))


def remove_whitespace_chars(text: Column) -> Column:
    return F.translate(text, "\n\r\t\x0b\x0c", "")


_urls: list[Step] = [(re.compile(r"https?://\S+|ftp://\S+"), "", [":"]), (re.compile(r"www\.\S+"), "", [])]
#: Edges as in the SQL: a letter outside ASCII that touches an address, as after a line end that was taken out, is none of it.
_emails: list[Step] = [(re.compile(r"(?a)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"), "", ["@"])]
_phones: list[Step] = [(re.compile(r"1[3-9]\d{9}"), "", [])]
_numbers: list[Step] = [(chr(0xFF10 + i), str(i), []) for i in range(10)]
_emojis: list[Step] = [(re.compile(_python(f"[{EMOJI_RANGES}]+")), "", [])]
_garbled: list[Step] = [
    (re.compile(_python(f"[{ZERO_WIDTH}]+")), "", []),
    *((w, "", []) for w in GARBLED_WORDS),
    (re.compile(_python(r"[\x{FE00}-\x{FE0F}\x{200E}\x{200F}\x{202A}-\x{202E}\x{E000}-\x{F8FF}\x{E0100}-\x{E01EF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]+")), "", []),
]
_symbols: list[Step] = [(re.compile(_python(f"[{SYMBOL_RANGES}]+").replace("]+", f"{SYMBOLS}]+")), "", [])]


def remove_urls(text: Column) -> Column:
    return rewritten(text, _urls)


def remove_emails(text: Column) -> Column:
    return rewritten(text, _emails)


def remove_phone_numbers(text: Column) -> Column:
    return rewritten(text, _phones)


def normalize_numbers(text: Column) -> Column:
    return F.translate(text, "０１２３４５６７８９", "0123456789")


def remove_emojis(text: Column) -> Column:
    return rewritten(text, _emojis)


def remove_garbled_text(text: Column) -> Column:
    return rewritten(text, _garbled)


def remove_special_symbols(text: Column) -> Column:
    return rewritten(text, _symbols)


def _advanced(garbled: bool = True, urls: bool = True, emails: bool = True, phones: bool = True, emojis: bool = True, symbols: bool = True, numbers: bool = True) -> list[Step]:
    wanted = ((garbled, _garbled), (urls, _urls), (emails, _emails), (phones, _phones), (emojis, _emojis), (symbols, _symbols), (numbers, _numbers))
    return [s for yes, steps in wanted if yes for s in steps]


def advanced_preprocess(text: Column, *, garbled: bool = True, urls: bool = True, emails: bool = True, phones: bool = True, emojis: bool = True, symbols: bool = True, numbers: bool = True) -> Column:
    return rewritten(text, _advanced(garbled, urls, emails, phones, emojis, symbols, numbers))


def _comment(whitespace: bool = True, dates: bool = True, chinese_only: bool = False, english: bool = False, marks: bool = True, spaces: bool = True, fix_cjk_dedupe: bool = False, udf: bool = True) -> list[Step]:
    steps = [_line_ends] if whitespace else []
    if dates:
        steps += _times + _days
    if chinese_only:
        steps.append(_kept())
        if marks and fix_cjk_dedupe:
            steps.append((re.compile(f"([{CJK_MARKS}])\\1+"), r"\1", []))
    else:
        steps += _cleaned(english=english, marks=marks, spaces=spaces, udf=udf) + ([_collapsed] if marks else [])
    return steps + (_squeezed if spaces else [])


def preprocess_comment(
    text: Column, *, whitespace: bool = True, dates: bool = True, chinese_only: bool = False, english: bool = False, marks: bool = True, spaces: bool = True, max_length: int | None = None, fix_cjk_dedupe: bool = False, udf: bool = True
) -> Column:
    """The main cleaner. In Chinese-only mode repeated Chinese marks stay unless ``fix_cjk_dedupe``."""
    text = rewritten(text, _comment(whitespace, dates, chinese_only, english, marks, spaces, fix_cjk_dedupe, udf))
    return F.substring(text, 1, max_length) if max_length else text


def preprocess_inference(text: Column, enabled: bool = True, max_length: int = 512, udf: bool = True) -> Column:
    """What a text goes through before extraction. Marks are collapsed before URLs go, so ``//`` URLs survive."""
    text = F.coalesce(text, F.lit(""))
    if not enabled:
        return strip(text)
    return F.substring(rewritten(text, _comment(udf=udf) + _advanced(numbers=False)), 1, max_length)


def preprocess_training(text: Column, max_length: int = 512) -> Column:
    """What a comment goes through before training data are made: the other order, Chinese only."""
    return F.substring(rewritten(F.coalesce(text, F.lit("")), _advanced() + _comment(chinese_only=True)), 1, max_length)
