"""The composite reward of a completion, as Column functions: one projection, no shuffle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cleaning import strip
from .jsonx import _array, extract_thinking, let, reward_json, source_text
from .keywords import to_score


@dataclass(frozen=True)
class RewardConfig:
    """Weights and limits; the analysis words are fixed values."""

    format_weight: float = 0.2
    thinking_weight: float = 0.1
    quality_weight: float = 0.2
    accuracy_weight: float = 0.5
    thinking_tag: str = "think"
    min_thinking: int = 50
    max_thinking: int = 800
    max_keyword: int = 4
    max_items: int = 15
    penalty: float = 0.1
    most_penalty: float = 0.3
    check_source: bool = True
    required: tuple[str, ...] = ("keywords",)
    analysis_words: tuple[str, ...] = ("主体", "评价", "描述", "关键词", "原文")


PRESETS: dict[str, RewardConfig] = {"keyword": RewardConfig()}
PRESETS["sentiment"] = replace(PRESETS["keyword"], format_weight=0.3, quality_weight=0.3, accuracy_weight=0.3, check_source=False, required=("sentiment", "confidence"))
PRESETS["entity"] = replace(PRESETS["keyword"], format_weight=0.25, quality_weight=0.25, accuracy_weight=0.4, required=("entities",))


Words = Callable[[Column], Column]
PARTS = ["thinking", "format", "quality", "penalty", "f1", "total"]


@dataclass(frozen=True)
class Reward:
    """A configuration with the caller's hooks: ``words`` takes the keywords from an object's JSON text (the default takes scored ones); validators are kept for the caller by name."""

    config: RewardConfig
    words: Words | None = None
    validators: dict[str, Callable] = field(default_factory=dict)

    def parts(self, completion: Column, solution: Column, prompt: Column) -> dict[str, Column]:
        return reward_parts(completion, solution, prompt, self.config, self.words)


def register(name: str, config: RewardConfig) -> None:
    PRESETS[name] = config


def names() -> list[str]:
    return list(PRESETS)


def create(name: str = "default", config: RewardConfig | None = None, words: Words | None = None, validators: dict[str, Callable] | None = None) -> Reward:
    """A reward by a registered name; unknown names mean the given configuration, or the default one."""
    return Reward(config or PRESETS.get(name, RewardConfig()), words, validators or {})


def thinking_score(thinking: Column, c: RewardConfig) -> Column:
    n = F.length(thinking)
    some = F.lit(0.5) + F.when(n.between(c.min_thinking, c.max_thinking), 0.3).otherwise(0.0)
    some += F.when(F.exists(_array(list(c.analysis_words)), lambda w: F.contains(thinking, w)), 0.2).otherwise(0.0)
    return F.when(thinking.isNotNull(), some * c.thinking_weight).otherwise(0.0)


def format_score(obj: Column, c: RewardConfig) -> Column:
    full = F.when(F.size(F.json_object_keys(obj)) > 0, 1.0).otherwise(0.75)
    return F.when(obj.isNotNull(), full * c.format_weight).otherwise(0.0)


def _keywords(obj: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(obj), "$.keywords", "array<variant>")


def _part(item: Column, at: int) -> Column:
    return F.try_variant_get(item, f"$[{at}]", "string")


def _width(item: Column) -> Column:
    return F.coalesce(F.size(F.try_variant_get(item, "$", "array<variant>")), F.lit(-1))


def item_valid(item: Column, c: RewardConfig) -> Column:
    word = F.length(strip(F.coalesce(_part(item, 1), F.lit("None"))))
    truth = F.when(F.schema_of_variant(F.try_variant_get(item, "$[2]", "variant")) == "BOOLEAN", F.when(_part(item, 2) == "true", 1.0).otherwise(0.0))
    score = F.coalesce(truth, to_score(_part(item, 2), None))
    return F.coalesce((_width(item) == 3) & word.between(1, c.max_keyword) & (score >= 0) & (score <= 1), F.lit(False))


def quality_score(obj: Column, c: RewardConfig) -> Column:

    def more(items: Column) -> Column:
        valid = F.size(F.filter(items, lambda i: item_valid(i, c))) / F.size(items) * (0.5 * c.quality_weight)
        return F.when(F.size(items) > 0, valid - F.when(F.size(items) > c.max_items, 0.1).otherwise(0.0)).otherwise(0.0)

    def scored(var: Column) -> Column:
        value = lambda r: F.try_variant_get(var, f"$.{r}", "variant")
        present = [F.when(value(r).isNotNull() & ~F.is_variant_null(value(r)), 1.0).otherwise(0.0) for r in c.required]
        base = sum(present[1:], present[0]) / len(present) * c.quality_weight if present else F.lit(c.quality_weight)
        return base + let(F.try_variant_get(var, "$.keywords", "array<variant>"), more)

    return F.when(F.size(F.json_object_keys(obj)) > 0, let(F.try_parse_json(obj), scored)).otherwise(0.0)


def scored_keywords(obj: Column) -> Column:
    """The second entry of lists, and texts, stripped."""
    kind = lambda i: F.schema_of_variant(i)
    words = F.transform(_keywords(obj), lambda i: F.when(_width(i) >= 2, strip(F.coalesce(_part(i, 1), F.lit("None")))).when(kind(i) == "STRING", strip(F.try_variant_get(i, "$", "string"))))
    return F.coalesce(F.filter(words, lambda w: w.isNotNull()), F.array().cast("array<string>"))


def hallucination_penalty(words: Column, source: Column, c: RewardConfig) -> Column:
    strange = F.size(F.filter(words, lambda w: ~F.contains(source, w)))
    return F.when(source != "", F.least(strange * F.lit(c.penalty), F.lit(c.most_penalty))).otherwise(0.0)


def f1(words: Column, gold: Column) -> Column:
    a, b = F.array_distinct(words), F.array_distinct(gold)
    both = F.size(F.array_intersect(a, b))
    precision, recall = both / F.greatest(F.size(a), F.lit(1)), both / F.greatest(F.size(b), F.lit(1))
    return F.when(both > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def has_content(obj: Column) -> Column:
    """Keywords if the key is there, else any value that isn't null or empty."""
    var = F.try_parse_json(obj)
    own = F.coalesce(F.size(_keywords(obj)) > 0, F.lit(False))
    values = F.map_values(F.try_variant_get(var, "$", "map<string,variant>"))
    some = F.exists(values, lambda v: ~F.coalesce(F.to_json(v), F.lit("null")).isin("null", "[]", "{}"))
    return F.when(F.array_contains(F.json_object_keys(obj), "keywords"), own).otherwise(F.coalesce(some, F.lit(False)))


def parse_solution(solution: Column, words: Words | None = None) -> Column:
    """The keywords of a reference answer: those of the object between its outer braces, none if it doesn't parse."""
    return (words or scored_keywords)(reward_json(solution, F.lit(None).cast("string")))


def reward_parts(completion: Column, solution: Column, prompt: Column, c: RewardConfig = PRESETS["keyword"], words: Words | None = None) -> dict[str, Column]:
    """Each part and the total, by name."""
    made = reward_struct(completion, solution, prompt, c, words)
    return {k: made[k] for k in PARTS}


def reward_struct(completion: Column, solution: Column, prompt: Column, c: RewardConfig = PRESETS["keyword"], words: Words | None = None) -> Column:
    """All parts as one struct: thinking, object and words are found once for all of them."""

    def scored(found: Column) -> Column:
        thinking, obj, own, gold = (found[k] for k in ("thinking", "obj", "own", "gold"))
        penalty = hallucination_penalty(own, source_text(prompt), c) if c.check_source else F.lit(0.0)
        parts = {"thinking": thinking_score(thinking, c), "format": format_score(obj, c), "quality": quality_score(obj, c), "penalty": penalty, "f1": f1(own, gold)}
        return F.struct(*(F.coalesce(v, F.lit(0.0)).alias(k) for k, v in parts.items()), obj.alias("obj"))

    def summed(parts: Column) -> Column:
        start = parts["thinking"] + parts["format"]
        given = F.coalesce(solution, F.lit("")) != ""
        gain = F.when(given, parts["f1"] * c.accuracy_weight).when(has_content(parts["obj"]), 0.2).otherwise(0.0)
        total = F.least(F.lit(1.0), F.greatest(F.lit(0.0), start + parts["quality"] - parts["penalty"] + gain))
        return F.struct(*(parts[k].alias(k) for k in PARTS[:-1]), F.when(parts["obj"].isNull(), start).otherwise(total).alias("total"))

    gold = parse_solution(solution, words)
    taken = lambda x: F.struct(x["thinking"].alias("thinking"), x["obj"].alias("obj"), (words or scored_keywords)(x["obj"]).alias("own"), gold.alias("gold"))
    read = lambda thinking: F.struct(thinking.alias("thinking"), reward_json(completion, thinking, c.thinking_tag).alias("obj"))
    return let(let(let(let(extract_thinking(completion, c.thinking_tag), read), taken), scored), summed)


def reward_list(completions: Column, solutions: Column | None = None, prompts: Column | None = None, c: RewardConfig = PRESETS["keyword"], words: Words | None = None) -> Column:
    """The rewards of parallel arrays, in order, as many as the shortest has; no solutions, or an empty array of them, and no prompts stand for as many nulls as there are completions."""
    none = F.transform(completions, lambda _: F.lit(None).cast("string"))
    solutions = none if solutions is None else F.when(F.size(solutions) > 0, solutions).otherwise(none)
    prompts = none if prompts is None else prompts
    least = F.least(F.size(completions), F.size(solutions), F.size(prompts))
    rows = F.slice(F.arrays_zip(completions.alias("c"), solutions.alias("s"), prompts.alias("p")), F.lit(1), least)
    return F.transform(rows, lambda r: reward_struct(r["c"], r["s"], r["p"], c, words)["total"])
