"""Queries of whole-corpus operators: files in order, documents of categories, segmentation, typed data, lists of rewards, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions import rewards as W
from ..functions.schema import FieldSpec, Kind, TaskSchema
from ..operators import datasets, report, segment
from ..operators.tables import new_folder
from ..sources import documents, ordered
from .queries import ANSWERS, SCORED, _record_sql, _records, answers, query, reward_sql, rx, spread, table

# ---- files ----


@query("src_file_order", "select doc_id, (row_number() over (order by doc_id) - 1)::bigint as position from documents where lang <> 'fr'")
def src_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as JSON lines in several files, those in French as lines that are no JSON: good lines are numbered as they stand in the files."""
    docs = table(spark, sf_dir, "documents")
    line = F.when(F.col("lang") == "fr", F.concat(F.lit("{ "), F.col("lang"))).otherwise(F.to_json(F.struct("doc_id", "text")))
    path = new_folder(spark, "lines")
    docs.repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id").select(line.alias("value")).write.text(path)
    return ordered.read_samples(spark, path).select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), "position")


@query(
    "grpo_first_samples",
    "with s as (select conv_id, coalesce(arg_max(text, turn) filter (where role = 'system'), '') as s, coalesce(arg_max(text, turn) filter (where role = 'user'), '') as u, coalesce(arg_max(text, turn) filter (where role = 'assistant'), '') as a from conversations group by conv_id order by conv_id limit 200) "
    "select md5(s) as system, md5(u) as user_text, md5(a) as original_response, count(*) as n from s where u <> '' group by all",
)
def grpo_first_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 conversations of the files, before those without a user's text go."""
    message = F.struct(F.col("turn"), F.struct("role", F.col("text").alias("content")).alias("m"))
    convs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(message)), lambda x: x["m"]).alias("messages"))
    path = new_folder(spark, "samples")
    convs.repartitionByRange(4, "conv_id").sortWithinPartitions("conv_id").select(F.to_json(F.struct("messages")).alias("value")).write.text(path)
    made = datasets.sample_to_grpo(ordered.read_samples(spark, path, n=200), "value")
    h = lambda c: F.md5(c.cast("binary"))
    return made.groupBy(h(F.col("messages")[0]["content"]).alias("system"), h(F.col("messages")[1]["content"]).alias("user_text"), h(F.col("original_response")).alias("original_response")).agg(F.count("*").alias("n"))


@query("sink_category_documents", "select source as category, (count(*) over (partition by source))::bigint as total, (row_number() over (partition by source order by doc_id) - 1)::bigint as index, md5(text) as comment from documents")
def sink_category_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document for each source with all its texts, written and read back."""
    docs = datasets.indexed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id", "source")
    path = new_folder(spark, "documents")
    record = datasets.sft_record(F.col("index"), F.col("text"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    documents.write_documents(docs, path, category="source", index="index", record=record, suffix="_sft_results.json")
    back = documents.read_documents(spark, path)
    made = F.from_json("record", "index long, original_comment string")
    return back.select("category", F.col("count").alias("total"), made.alias("r")).select("category", "total", "r.index", F.md5(F.col("r.original_comment").cast("binary")).alias("comment"))


# ---- segmentation ----

_letters = ("etaoinsrhldu", "好快电池屏幕质量物流包装")
_made = "select doc_id, translate(lower(coalesce(text, '')), 'etaoinsrhldu', '好快电池屏幕质量物流包装') as text from documents"
_runs = f"select doc_id, unnest(regexp_extract_all(text, '[\\x{{4E00}}-\\x{{9FFF}}]+')) as run from ({_made})"
LEXICON_SQL = f"""
    runs as ({_runs}),
    placed as (select run, s.size, unnest(range(1, length(run) - s.size + 2)) as o from runs, range(1, 5) s(size) where s.size <= length(run)),
    g as (select substr(run, o, size) as gram, case when o > 1 then substr(run, o - 1, 1) else '' end as l, substr(run, o + size, 1) as r from placed),
    c as (select gram, count(*) as n from g group by gram),
    al as (select sum(n)::double as total from c where length(gram) = 1),
    co as (select c.gram, c.n, round(min(ln(c.n * total / (x.n::double * y.n))), 6) as cohesion
        from c, al, range(1, 4) k(k) join c x on x.gram = substr(c.gram, 1, k) join c y on y.gram = substr(c.gram, k + 1) where length(c.gram) > k and c.n >= 5 group by c.gram, c.n),
    hl as (select gram, ln(sum(m)) - sum(case when l = '' then 0 else m * ln(m) end) / sum(m) as h from (select gram, l, count(*) as m from g where length(gram) > 1 group by gram, l) group by gram),
    hr as (select gram, ln(sum(m)) - sum(case when r = '' then 0 else m * ln(m) end) / sum(m) as h from (select gram, r, count(*) as m from g where length(gram) > 1 group by gram, r) group by gram),
    lex as (
        select gram as word, n, 0.0::double as cohesion, 0.0::double as entropy from c where length(gram) = 1
        union all select co.gram, n, cohesion, round(least(hl.h, hr.h), 6) from co join hl using (gram) join hr using (gram) where cohesion >= 1 and round(least(hl.h, hr.h), 6) >= 0.5)"""


def _ideographs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", F.translate(F.lower(F.coalesce("text", F.lit(""))), *_letters).alias("text")))


@query("fb_lexicon", f"with {LEXICON_SQL} select word, n, cohesion, entropy from lex")
def fb_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the documents, as ideographs, give by frequency, cohesion and boundary entropy."""
    return segment.lexicon(_ideographs(spark, sf_dir))


@query("fb_segments", f"""
    with recursive {LEXICON_SQL},
    p as (select word, ln(n) - ln((select sum(n) from lex)) as w from lex),
    d as (select distinct run from runs),
    e as (select run, o, list(struct_pack(w := p.w, e := o + size)) as es from (select run, o, s.size from d, range(1, 5) s(size), lateral (select unnest(range(1, length(run) - s.size + 2)) as o) x) q join p on p.word = substr(run, o, size) group by run, o),
    -- from a run's end: the best sums and the next cuts of all places behind
    best(run, o, sums, cuts) as (
        select run, length(run) + 1, [0.0::double], [0::bigint] from d
        union all
        select run, o, [m.s] || sums, [m.e] || cuts from (
            select b.run, b.o - 1 as o, list_max(list_transform(e.es, lambda x: struct_pack(s := x.w + b.sums[x.e - b.o + 1], e := x.e))) as m, b.sums, b.cuts
            from best b join e on e.run = b.run and e.o = b.o - 1)),
    full_ as (select run, cuts from best where o = 1),
    walk(run, o, k, word) as (
        select run, cuts[1], 1, substr(run, 1, cuts[1] - 1) from full_
        union all select w.run, f.cuts[w.o], w.k + 1, substr(w.run, w.o, f.cuts[w.o] - w.o) from walk w join full_ f on f.run = w.run where w.o <= length(w.run)),
    words as (select run, list(word order by k) as ws from walk group by run),
    parts as (select doc_id, unnest(regexp_extract_all(text, '[\\x{{4E00}}-\\x{{9FFF}}]+|[^\\P{{L}}\\x{{4E00}}-\\x{{9FFF}}]+')) as part, generate_subscripts(regexp_extract_all(text, '[\\x{{4E00}}-\\x{{9FFF}}]+|[^\\P{{L}}\\x{{4E00}}-\\x{{9FFF}}]+'), 1) as pos from ({_made}))
    select doc_id, sum(len(coalesce(ws, [part])))::bigint as n, md5(string_agg(array_to_string(coalesce(ws, [part]), ' '), ' ' order by pos)) as h from parts left join words on words.run = parts.part group by doc_id""")
def fb_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each document by the best paths through the lattice of the corpus's own lexicon."""
    docs = _ideographs(spark, sf_dir)
    tokens = docs.select("doc_id", segment.segmenter(segment.lexicon(docs))(F.col("text")).alias("w"))
    return tokens.where(F.size("w") > 0).select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ").cast("binary")).alias("h"))


# ---- answers: typed data, repeated keys, lists of rewards ----

_schema = TaskSchema("record", [FieldSpec("t", Kind.STRING), FieldSpec("l", Kind.STRING), FieldSpec("n", Kind.INTEGER), FieldSpec("f", Kind.FLOAT), FieldSpec("a", Kind.ARRAY, item_kind=Kind.STRING), FieldSpec("b", Kind.BOOLEAN)])


@query("schema_typed", f"select doc_id, length(t)::bigint as chars, n + 1 as more, round(n / 1000.0::double * 2, 6) as twice, k::bigint as n_lines, case when l <> 'fr' then not (n > 700) end as small, case when l = 'fr' then 'b' else '' end as misfits from {_record_sql}")
def schema_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' objects as the declared struct; where a field holds another kind, it is null and named."""
    made = _records(spark, sf_dir).select("doc_id", _schema.typed(F.col("v")).alias("r"), _schema.misfits(F.col("v")).alias("m"))
    return made.select(
        "doc_id", F.length("r.t").cast("long").alias("chars"), (F.col("r.n") + 1).alias("more"), F.round(F.col("r.f") * 2, 6).alias("twice"), F.size("r.a").cast("long").alias("n_lines"), (~F.col("r.b")).alias("small"), F.array_join("m", ",").alias("misfits")
    )


_repeated = "concat('so {\"keywords\": [[\"r\", \"', a, '\", 1]], \"s\": {\"x\": 1, \"x\": NaN}, \"keywords\": [[\"r\", \"', b, '\", 0.5], [\"r\", \"', a, '\", -Infinity]]} end')"
_two_words = "regexp_replace(substr(coalesce(text, ''), 1, length(text) // 2), '[^a-z ]+', '', 'g') as a, regexp_replace(substr(coalesce(text, ''), length(text) // 2 + 1), '[^a-z ]+', '', 'g') as b"


@query("parse_repeated_keys", f"select doc_id, md5(coalesce(b, '')) as first, md5(coalesce(a, '')) as second, 'NaN' as x, '-Infinity' as score from (select doc_id, {_two_words} from documents)")
def parse_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that give keys twice and numbers that are none: the last value counts, and such numbers are texts."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    parts = docs.selectExpr("doc_id", *(f"regexp_replace({x}, '[^a-z ]+', '') as {c}" for c, x in (("a", "substr(text, 1, length(text) div 2)"), ("b", "substr(text, length(text) div 2 + 1)"))))
    obj = J.greedy_object(J.mended(F.regexp_extract(F.expr(_repeated), r"(?s)\{.*\}", 0)))
    at = lambda path: F.get_json_object("obj", path)
    h = lambda c: F.md5(F.coalesce(c, F.lit("")).cast("binary"))
    return parts.select("doc_id", obj.alias("obj")).select("doc_id", h(at("$.keywords[0][1]")).alias("first"), h(at("$.keywords[1][1]")).alias("second"), at("$.s.x").alias("x"), at("$.keywords[1][2]").alias("score"))


@query("reward_list", f"""
    with {ANSWERS}, {SCORED}, g as (select *, doc_id // 5 as g, row_number() over (partition by doc_id // 5 order by doc_id) as k, count(*) over (partition by doc_id // 5) as size from sc)
    select g, (k - 1)::int as at, round(({reward_sql(W.PRESETS['keyword'])['total']})::double, 9) as reward from g where k <= least(size, 1 + g % 5, greatest(size - 1, 1))""")
def reward_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five answers a row with fewer solutions and prompts: as many rewards as the shortest list has."""
    rows = answers(spark, sf_dir).withColumn("g", F.expr("doc_id div 5")).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("doc_id", "raw", "w"))).alias("x"))
    gold = F.array_repeat(F.lit('{"keywords": [["r", "bc", 1], ["r", "cd", 1]]}'), (F.col("g") % 5 + 1).cast("int"))
    prompts = F.slice(F.transform("x", lambda x: F.concat(x["w"], F.lit(" bc"))), F.lit(1), F.greatest(F.size("x") - 1, F.lit(1)))
    made = rows.select("g", W.reward_list(F.transform("x", lambda x: x["raw"]), gold, prompts).alias("r"))
    return made.select("g", F.posexplode("r").alias("at", "reward")).select("g", "at", F.round("reward", 9).alias("reward"))


# ---- reports ----


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    size: Column = F.length("text")
    lines = F.size(F.split("text", "\n"))
    return report.quality_report(
        docs, ["lang", "source"], flags={"empty": F.coalesce(size, F.lit(0)) == 0, "short": size < 200, "toxic": F.col("toxic") == 1}, measures={"chars": size, "lines": lines}, distinct={"texts": F.md5(F.col("text").cast("binary"))}
    )


@query(
    "quality_report",
    "select (grouping(lang) * 2 + grouping(source))::bigint as level, lang, source, count(*) as rows, count(*) filter (where coalesce(length(text), 0) = 0) as n_empty, count(*) filter (where length(text) < 200) as n_short, count(*) filter (where toxic = 1) as n_toxic, "
    "count(length(text)) as values_chars, sum(length(text))::bigint as sum_chars, min(length(text)) as least_chars, max(length(text)) as most_chars, count(text) as values_lines, sum(len(string_split(text, chr(10))))::bigint as sum_lines, min(len(string_split(text, chr(10)))) as least_lines, max(len(string_split(text, chr(10)))) as most_lines "
    "from documents left join labels using (doc_id) group by cube (lang, source)",
)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact columns of the report by language and source."""
    found = _report(spark, sf_dir)
    return found.select(*(c for c in found.columns if not c.startswith(("kll_", "hll_"))))


@query("quality_report_sketches")
def quality_report_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles and distinct counts of the same report, from its sketches."""
    found = report.read_off(_report(spark, sf_dir), [0.1, 0.5, 0.9, 0.99])
    return found.select("level", "lang", "source", "rows", "q_chars", "q_lines", "about_texts")
