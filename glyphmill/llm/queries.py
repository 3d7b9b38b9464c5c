"""The contract queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import with_tokens
from .chat import chat_windows, read_back
from .codes import books_sha256, vector_codes
from .common import stored, table
from .hilbert import hilbert_shards
from .jaccard import near_duplicates
from .lines import line_dedup
from .media import media_features
from .packing import pack
from .quality import fit_quality, quality, text_features
from .suffix import remove_repeats
from .topk import top_k
from .toxicity import fit_toxicity, toxicity
from .trie import borrowed, prefix_trie, turn_items

#: The fixed extra conversation, to be formatted beside the table's own.
EXTRA_TEXT = r"\### Assistant: </turn> ok"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-7, 0, "user", EXTRA_TEXT), (-7, 1, "assistant", EXTRA_TEXT)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(chat_windows(turns, budget=512, history_turns=2, history_tokens=192))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=5, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


#: A score from here on is taken for label 1.
TOXIC = 0.7


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    scored = docs.select("doc_id", toxicity(F.col("text"), fit_toxicity(docs, labels), spark).alias("t"))
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        F.col("t.score").alias("score"),
        (F.col("t.score") >= TOXIC).cast("int").alias("predicted"),
        F.col("t.example_ids").cast("array<long>").alias("neighbour_ids"),
        F.col("t.cosines").alias("cosines"),
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=100)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", F.octet_length("text").alias("n_bytes"))
    placed = hilbert_shards(docs, dims=["lang", "source", "n_bytes"], n_shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def word_bpe() -> str:
    """The vocabulary file's place; its package is asked for when a query runs."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = with_tokens(docs, word_bpe(), decoded_col="decoded").select("doc_id", "ids", "decoded")
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents").select("doc_id", "text"), word_bpe(), capacity=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = turn_items(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    conv = F.col("conv_id")
    heads = F.crc32(conv.cast("string").cast("binary")) % 9
    return prefix_trie(*borrowed(items, lender=conv - conv % 5, heads=heads, most=8))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = vector_codes(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), scale=4096.0, n_parts=8, entries=16, rounds=6)
    return found.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def tested(doc_id: Column) -> Column:
    """Rows that no quality model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


#: A score from here on is taken for label 1.
GOOD = 0.3


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(text_features(table(spark, sf_dir, "documents").select("doc_id", "text")), "quality-features")
    labels = table(spark, sf_dir, "labels").where(~tested(F.col("doc_id")))
    scored = quality(rows, fit_quality(rows, labels))
    return scored.select(
        "doc_id",
        F.coalesce(tested(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"),
        "against",
        "weight",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_exact_topk": op3_exact_topk,
    "op4_toxicity": op4_toxicity,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_hilbert_sharding": op7_hilbert_sharding,
    "op8_bpe": op8_bpe,
    "op9_media": op9_media,
    "op10_packing": op10_packing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_vector_codes": op12_vector_codes,
    "op13_quality": op13_quality,
}

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"



def _codes_sql(rounds: int = 6) -> str:
    """Each round assigns the parts to the books before it and takes means, rounded down."""
    far = "list_sum(list_transform(list_zip(p.part, b.entry), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
    out = """
        with v as (
            select vec_id, label, row_number() over () as row, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as v from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
        p as (select row, vec_id, p, v[p * len(v) // 8 + 1:(p + 1) * len(v) // 8] as part from v, range(8) t(p)),
        b0 as (select p, row_number() over (partition by p order by vec_id, part) - 1 as k, part as entry from p qualify k < 16)"""
    for r in range(rounds + 1):
        out += f""",
        a{r} as (select p.row, p.p, p.part, arg_min(b.k, ({far}, b.k)) as k, min({far}) as far from p join b{r} b on b.p = p.p group by p.row, p.p, p.part)"""
        if r < rounds:
            out += f""",
        s{r} as (select p, k, i, sum(part[i])::bigint as s, count(*) as n from a{r}, range(1, len(part) + 1) t(i) group by p, k, i),
        m{r} as (select p, k, list((s - (((s % n) + n) % n)) // n order by i) as entry from s{r} group by p, k),
        b{r + 1} as (select b.p, b.k, coalesce(m.entry, b.entry) as entry from b{r} b left join m{r} m on m.p = b.p and m.k = b.k)"""
    return out + f""",
        c as (select row, string_agg(printf('%02x', k), '' order by p) as code, sum(far)::bigint as error from a{rounds} group by row)
        select v.vec_id, c.code, c.error, (sum(c.error) over (partition by v.label))::bigint as label_error,
            (select sha256(string_agg(array_to_string(entry, ','), ',' order by p, k)) from b{rounds}) as codebooks_sha256
        from v join c using (row)"""


ORACLE_SQL: dict[str, str] = {
    "op12_vector_codes": _codes_sql(),
    "op11_prefix_trie": """
        with t as (
            select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first) as pos
            from conversations where conv_id is not null),
        own as (select conv_id, list({'role': role, 'text': text} order by pos) as own from t group by conv_id),
        -- the checksum, bit by bit: a byte comes in, then eight shifts
        crc as (
            select conv_id, xor(list_reduce([4294967295::bigint] || flatten(list_transform(string_split(conv_id::varchar, ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])),
                lambda a, v: case when v >= 0 then xor(a, v) when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end), 4294967295::bigint) % 9 as h
            from own),
        built as (
            select own.conv_id, coalesce(b.own, [])[1:h] || own.own[h + 1:] as turns
            from own join crc using (conv_id) left join own b on b.conv_id = own.conv_id - own.conv_id % 5),
        met as (select conv_id, len(turns) as size, unnest(range(0, len(turns) + 1)) as d, turns from built),
        keyed as (select conv_id, size, d, md5((turns[1:d])::varchar) || md5(to_json(turns[1:d])) as k, md5((turns[1:d - 1])::varchar) || md5(to_json(turns[1:d - 1])) as up, case when d > 0 then strlen(turns[d].text) else 0 end as n from met),
        node as (
            select k, any_value(d) as d, any_value(up) as up, min(conv_id) as conv_id, count(*) as n_convs, any_value(n) as n,
                sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where size = d), '')) as ends_sha256
            from keyed group by k),
        kids as (select up as k, count(*) as n_children from node where d > 0 group by up),
        below as (select distinct a.k, b.k as under from keyed a join keyed b on a.conv_id = b.conv_id and b.d >= a.d),
        sums as (
            select below.k, sum((u.n_convs - 1) * u.n)::bigint as saved_tokens, count(*) filter (where kids.k is null) as n_leaves
            from below join node u on u.k = below.under left join kids on kids.k = below.under group by below.k)
        select node.conv_id, node.d as depth, p.conv_id as parent_conv_id, node.n_convs, coalesce(n_children, 0) as n_children, n_leaves, saved_tokens, node.ends_sha256
        from node join sums using (k) left join kids using (k) left join node p on node.d > 0 and p.k = node.up
    """,
    "op2_jaccard_join": r"""
        with recursive words as (
            select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
            from documents),
        sets as (
            select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
                else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
            from words),
        one as (select doc_id, len(s) as n, unnest(s) as x from sets),
        links as (
            select a.doc_id as a, b.doc_id as b from one a join one b on a.x = b.x and a.doc_id <> b.doc_id
            group by a.doc_id, b.doc_id having 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
        reach(a, b) as (select doc_id, doc_id from sets union select r.a, l.b from reach r join links l on r.b = l.a)
        select doc_id, len(s)::bigint as n_shingles, (select min(b) from reach where a = doc_id) as component_id, (select count(*) from links where a = doc_id) as n_links from sets
    """,
    "op5_suffix_dedup": """
        with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, ''))::bigint as n from documents),
        w as (
            select doc_id, unnest(range(0, n - 99)) as s, unnest(list_transform(range(0, n - 99), lambda i: md5(substr(h, 2 * i + 1, 200)))) as m
            from d where n >= 100),
        again as (select doc_id, s from w qualify row_number() over (partition by m order by doc_id, s) > 1),
        parts as (select doc_id, s, case when s <= lag(s) over o + 100 then 0 else 1 end as fresh from again window o as (partition by doc_id order by s)),
        runs as (select doc_id, s, sum(fresh) over (partition by doc_id order by s) as k from parts),
        spans as (select doc_id, k, min(s) as a, max(s) + 100 as b from runs group by doc_id, k),
        gaps as (
            select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as a, a as b from spans
            union all select d.doc_id, coalesce(max(x.b), 0), any_value(d.n) from d left join spans x using (doc_id) group by d.doc_id),
        kept as (select g.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' order by a) as k from gaps g join d using (doc_id) group by g.doc_id)
        select d.doc_id, n as n_bytes, coalesce((select sum(b - a) from spans x where x.doc_id = d.doc_id), 0)::bigint as n_removed,
            (select count(*) from spans x where x.doc_id = d.doc_id) as n_spans, sha256(unhex(k)) as kept_sha256
        from d join kept using (doc_id)
    """,
    "op3_exact_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
        s as (
            select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
            from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
        select query_id, rank::int as rank, vec_id, score from r where rank <= 20
    """,
    "op6_line_dedup": f"""
        with d as (select *, row_number() over () as row from documents),
        lines as (
            select doc_id, row, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
            from d),
        keyed as (
            select *, translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
        often as (select k from keyed where length(k) >= 1 group by k having count(distinct row) >= 10)
        select doc_id, count(*) as n_lines, count(*) filter (where k in (select k from often)) as n_dropped,
            sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where k not in (select k from often)), '')) as kept_sha256
        from keyed group by doc_id, row
    """,
}
