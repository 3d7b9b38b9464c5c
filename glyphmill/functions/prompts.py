"""Prompts as Column functions: constant texts around the row's text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cleaning import strip
from .schema import ExtractionTask, FieldSpec, Kind, TaskSchema

Pair = tuple[Column, Column]

# ---- fixed values: the marks that the source-text patterns look for, labels of rules ----
COMMENT_MARK, TEXT_MARK, CLOSING = "【待处理评论】", "【待处理文本】", "请严格按要求只输出 JSON。"
KIND_LABEL = {Kind.STRING: "字符串", Kind.INTEGER: "整数", Kind.FLOAT: "数值", Kind.BOOLEAN: "布尔值", Kind.ARRAY: "数组", Kind.ARRAY_OF_OBJECTS: "对象数组", Kind.OBJECT: "对象"}
BASE_RULES = ["结果必须来自原文", "原文没有的字段填 null 或留空", "不得猜测或补充"]

KEYWORD_SYSTEM = '你从商品评论里找关键词。输出 {"keywords": [[理由, 关键词, 0到1的分数], ...]}，关键词不超过四个字，按分数从高到低。'
KEYWORD_SHORT_SYSTEM = '你从很短的评论里找关键词。输出 {"keywords": [[理由, 关键词, 分数], ...]}。'
DPO_SYSTEM = "你为同一条评论写一份好的和一份差的关键词结果。好的放在 <chosen></chosen> 里，差的放在 <rejected></rejected> 里，两份都是 JSON。"


def framed(mark: str, text: Column) -> Column:
    return F.concat(F.lit(f"{mark}\n"), F.coalesce(text, F.lit("")), F.lit(f"\n\n{CLOSING}"))


def keyword_prompt(text: Column) -> Pair:
    return F.lit(KEYWORD_SYSTEM), framed(COMMENT_MARK, text)


def short_keyword_prompt(text: Column) -> Pair:
    return F.lit(KEYWORD_SHORT_SYSTEM), framed(COMMENT_MARK, text)


def dpo_prompt(text: Column) -> Pair:
    return F.lit(DPO_SYSTEM), framed(COMMENT_MARK, text)


def field_rule(f: FieldSpec) -> str:
    out = f"- {f.name}" + (f": {f.description}" if f.description else "") + f" ({KIND_LABEL[f.kind]})"
    out += " [必需]" if f.required else ""
    out += f" 可选值: {f.enum}" if f.enum else ""
    if f.min_length is not None or f.max_length is not None:
        out += f" 长度: {f.min_length or 0}-{f.max_length or '∞'}"
    return out


def rules_text(schema: TaskSchema, custom: list[str] | None = None, template: list[str] | None = None) -> str:
    blocks = [("字段说明:", [field_rule(f) for f in schema.fields]), ("特殊规则:", [f"- {r}" for r in custom or []]), ("任务规则:", [f"- {r}" for r in template or []])]
    return "\n".join([*BASE_RULES, *(line for title, rows in blocks if rows for line in ("", title, *rows))])


@dataclass
class PromptTemplate:
    """Texts with the placeholders {schema_json}, {input_text} and {rules}."""

    system: str
    user: str
    short_system: str | None = None
    short_user: str = "提取：{input_text}"
    rules: list[str] = field(default_factory=list)


def fill(template: str, text: Column, **constants: str) -> Column:
    """Constants are put in on the driver, the row's text by concatenation."""
    for k, v in constants.items():
        template = template.replace("{" + k + "}", v)
    parts = template.split("{input_text}")
    return F.concat(*[x for k, p in enumerate(parts) for x in ([text] if k else []) + [F.lit(p)]])


def is_short(text: Column, threshold: int = 10) -> Column:
    return F.length(strip(text)) < threshold


def default_prompt(text: Column, schema: TaskSchema | None, threshold: int = 10) -> Pair:
    """Without a builder: a full prompt, and a brief one for short texts."""
    schema_json = schema.text() if schema else "{}"
    full = F.lit(f"你负责从文本里提取结构化数据，只输出符合下面 JSON Schema 的 JSON：\n{schema_json}"), framed(TEXT_MARK, text)
    brief = F.lit(f"直接输出符合下面 Schema 的 JSON：\n{schema_json}"), F.concat(F.lit("提取："), text)
    return tuple(F.when(is_short(text, threshold), b).otherwise(f) for f, b in zip(full, brief, strict=True))


@dataclass
class PromptBuilder:
    """A custom generator comes before a template, a template before the task's schema."""

    task: ExtractionTask | None = None
    template: PromptTemplate | None = None
    generator: Callable[[Column, ExtractionTask | None], Pair] | None = None

    def build(self, text: Column, short: bool = False, threshold: int = 10) -> Pair:
        if self.generator:
            return self.generator(text, self.task)
        schema = self.task.schema if self.task else None
        schema_json = schema.text() if schema else "{}"
        t = self.template
        if t:
            rules = rules_text(schema, self.task.rules, t.rules) if schema else ""
            if short and t.short_system:
                return F.lit(t.short_system.replace("{schema_json}", schema_json)), fill(t.short_user, text)
            return F.lit(t.system), fill(t.user, text, schema_json=schema_json, rules=rules)
        full = F.lit("你负责从文本里提取结构化数据。"), fill("Schema:\n{schema_json}\n\n{rules}\n\n" + TEXT_MARK + "\n{input_text}\n\n" + CLOSING, text, schema_json=schema_json, rules=rules_text(schema, self.task.rules) if schema else "")
        brief = F.lit(f"只输出 JSON：\n{schema_json}"), F.concat(F.lit("提取："), text)
        return brief if short else tuple(F.when(is_short(text, threshold), b).otherwise(f) for f, b in zip(full, brief, strict=True))


def sentiment_builder() -> PromptBuilder:
    return PromptBuilder(template=PromptTemplate("你判断文本的情感。", 'Schema:\n{schema_json}\n{rules}\n' + TEXT_MARK + "\n{input_text}\n\n" + CLOSING, rules=["sentiment 取 positive、negative 或 neutral"]))


def entity_builder() -> PromptBuilder:
    return PromptBuilder(template=PromptTemplate("你找出文本里的实体。", 'Schema:\n{schema_json}\n{rules}\n' + TEXT_MARK + "\n{input_text}\n\n" + CLOSING, rules=["每个实体给出 text、type、start、end"]))


def keyword_builder() -> PromptBuilder:
    return PromptBuilder(generator=lambda text, _: keyword_prompt(text))
