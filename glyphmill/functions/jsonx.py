"""Parsing of model answers as Column functions: JSON objects in free text, tags, source text."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .cleaning import HELD, strip

#: The marks that prompts put around the source text.
SOURCE_PATTERNS = [r"(?s)【待处理评论】\s*\n(.+?)(?:\n\n请严格|$)", r"(?s)【待处理文本】\s*\n(.+?)(?:\n\n请严格|$)", r"(?s)待处理文本[：:]\s*(.+?)(?:\n\n|$)"]


def let(value: Column, made: Callable[[Column], Column]) -> Column:
    """made(value) with the value computed once, however often it stands there: expressions within lambdas aren't shared otherwise."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def _array(names: list[str]) -> Column:
    return F.array(*map(F.lit, names)).cast("array<string>")


def plain_json(text: str | None) -> str | None:
    """JSON with one value for each key, the last one, and no number that isn't finite (those become texts); null if it isn't JSON even so."""

    def number(digits: str) -> float | str:
        return x if math.isfinite(x := float(digits)) else digits

    try:
        out = json.dumps(json.loads(text, parse_constant=str, parse_float=number), ensure_ascii=False) if text else None
    except (ValueError, RecursionError):
        return None
    return out and out.encode("utf-8", "replace").decode()


def plain_answer(answer: str | None) -> str | None:
    """An answer whose object, from the first to the last brace, is plain JSON."""
    found = re.search(r"\{.*\}", answer or "", re.S)
    mended = plain_json(found[0]) if found else None
    return answer[: found.start()] + mended + answer[found.end() :] if mended else answer


@F.arrow_udf(StringType())
def _plain(texts: pa.Array) -> pa.Array:
    """Few texts are Python objects at once, whatever the batch holds."""
    out, held, size = [], [], 0
    for t in texts:
        held.append(plain_json(t.as_py()))
        size += len(held[-1] or "")
        if size > HELD:
            out.append(pa.array(held, pa.string()))
            held, size = [], 0
    return pa.concat_arrays([*out, pa.array(held, pa.string())])


def mended(text: Column) -> Column:
    """The text; where no variant can be made of it (repeated keys, numbers like NaN), as plain JSON, null if it isn't any. Only such texts are sent to Python."""
    bad = F.try_parse_json(text).isNull()
    return F.when(bad, _plain(F.when(bad, text))).otherwise(text)


def has_required(obj: Column, required: list[str]) -> Column:
    """Whether a JSON object text has all keys; a null value counts."""
    if not required:
        return F.lit(True)
    return F.coalesce(F.size(F.array_except(_array(required), F.json_object_keys(obj))) == 0, F.lit(False))


def _object(text: Column) -> Column:
    """The text if it is a JSON object, else null."""
    return let(text, lambda t: F.when(F.json_object_keys(t).isNotNull() & F.try_parse_json(t).isNotNull(), t))


def greedy_object(text: Column) -> Column:
    """From the first to the last brace, if that is a JSON object."""
    return _object(F.regexp_extract(text, r"(?s)\{.*\}", 0))


def parse_response(raw: Column, required: list[str]) -> Column:
    """JSON text of the answer's object with all required keys: itself, or the first of its members; else null."""
    fenced = strip(F.replace(F.replace(raw, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))
    obj = greedy_object(F.when(F.startswith(raw, F.lit("```json")), fenced).otherwise(raw))
    members = F.transform(F.json_object_keys(obj), lambda k: F.to_json(F.try_variant_get(F.try_parse_json(obj), F.lit("$"), "map<string,variant>")[k]))
    inner = F.get(F.filter(members, lambda m: F.json_object_keys(m).isNotNull() & has_required(m, required)), F.lit(0))
    return F.when(has_required(obj, required), obj).otherwise(inner)


def parse_first_last_brace(raw: Column) -> Column:
    """The whole text if it is JSON of any type, else from the first to the last brace; null if neither is JSON."""
    cut = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(raw).isNotNull(), raw).when(F.try_parse_json(cut).isNotNull(), cut)


def between_tags(text: Column, tag: str) -> Column:
    """What stands between the first opening and the first closing tag, stripped; null without both in order."""
    a, b = F.instr(text, f"<{tag}>"), F.instr(text, f"</{tag}>")
    begin = a + len(tag) + 2
    return F.when((a > 0) & (b > 0), strip(F.substring(text, begin, F.greatest(b - begin, F.lit(0)))))


def parse_dpo(raw: Column) -> Column:
    """Struct of chosen and rejected texts and their JSON, null where it doesn't parse."""
    chosen, rejected = between_tags(raw, "chosen"), between_tags(raw, "rejected")
    return F.when(raw != "", F.struct(chosen.alias("chosen"), rejected.alias("rejected"), greedy_object(chosen).alias("chosen_json"), greedy_object(rejected).alias("rejected_json")))


def extract_thinking(completion: Column, tag: str = "think") -> Column:
    """The first tagged stretch, stripped; null if there is none."""
    hit = F.regexp_extract(completion, rf"<{tag}>([\s\S]*?)</{tag}>", 1)
    return F.when(completion.rlike(rf"<{tag}>[\s\S]*?</{tag}>"), strip(hit))


def reward_json(completion: Column, thinking: Column, tag: str = "think") -> Column:
    """The JSON object after the last closing tag if there is thinking, else in the whole completion."""
    return greedy_object(F.when(thinking.isNotNull(), F.substring_index(completion, f"</{tag}>", -1)).otherwise(completion))


def source_text(prompt: Column) -> Column:
    """The text that a prompt asks about: the first mark that is found, else the whole prompt."""
    hits = [F.when(prompt.rlike(p), strip(F.regexp_extract(prompt, p, 1))) for p in SOURCE_PATTERNS]
    return F.coalesce(*hits, prompt, F.lit(""))


def keyword_items(obj: Column, keys: tuple[str, ...] = ("关键词", "keywords")) -> Column:
    """The keyword array of a JSON object as variants: the first key that is present, else empty."""
    found = lambda var: [F.try_variant_get(var, f"$['{k}']", "array<variant>") for k in keys]
    return let(F.try_parse_json(obj), lambda var: F.coalesce(*found(var), F.array().cast("array<variant>")))
