"""Every registered query of the engine proper against DuckDB on the small tables."""

import duckdb
import pytest

from glyphmill.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(str).replace({"None": "", "nan": "", "<NA>": ""})
    return sorted(map(tuple, frame.to_numpy().tolist())), sorted(frame.columns)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name in queries.ORACLE_SQL:
        assert rows(got) == rows(duck.execute(queries.ORACLE_SQL[name]).df())
    else:
        assert len(got)


def brute_near(word, text):
    """The least span of text that holds the word's letters in order, greedily from each start, is at most twice the word."""
    k, spans = word.replace(" ", ""), []
    for i in [i for i, c in enumerate(text) if c == k[:1]]:
        at = i
        for c in k[1:]:
            at = text.find(c, at + 1)
            if at < 0:
                break
        else:
            spans.append(at - i + 1)
    return not text or k in text or bool(spans) and min(spans) <= 2 * len(k)


def test_post_process_answers(spark, tmp_path):
    """All seven kinds of answer, the mixed items of kind 1 among them."""
    texts = ["abc bcdef", "a lone word", "ab", "b c d", "bxcxdxexf", "zzz", "", "b cd ef", "x" * 60 + " ab", "acb"]
    docs = [(k, texts[(k // 7 + k) % len(texts)]) for k in range(70)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["keywords"] for r in queries.QUERIES["kw_post_process_answers"](spark, str(tmp_path)).collect()}
    items = {0: lambda w: [w, "ab"], 1: lambda w: [w], 5: lambda w: ["bc", "bcdef"]}
    for k, w in docs:
        kept = [x for x in items.get(k % 7, lambda w: [])(w) if x.strip() and len(x) <= 40 and brute_near(x, w)]
        assert got[k] == "|".join(dict.fromkeys(kept)), (k, w)
    assert any(got[k] for k, _ in docs if k % 7 == 1)


def brute_textrank(text, rounds):
    words = [w for w in text.split(" ") if len(w) >= 3]
    weight = {}
    for i, a in enumerate(words):
        for b in words[i + 1 : i + 5]:
            if a != b:
                weight[a, b] = weight.get((a, b), 0) + 1
                weight[b, a] = weight.get((b, a), 0) + 1
    out = {a: sum(w for (x, _), w in weight.items() if x == a) for a, _ in weight}
    rank = dict.fromkeys(out, 1.0)
    for _ in range(rounds):
        rank = {v: 0.15 + 0.85 * sum(rank[a] * w / out[a] for (a, b), w in weight.items() if b == v) for v in rank}
    best = sorted((-round(r / max(rank.values()), 6), v) for v, r in rank.items())[:8]
    return [(v, min(-2 * r, 1.0)) for r, v in best]


def test_textrank_settled(spark, tmp_path):
    texts = ["one two three four five six seven one three nine ten one eleven two", "alpha beta alpha gamma delta epsilon zeta eta beta theta iota kappa lambda alpha", "red green red blue"]
    rows = [(k, 0, "user", t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {}
    for r in sorted(queries.QUERIES["fb_textrank_settled"](spark, str(tmp_path)).collect(), key=lambda r: (r["id"], r["rank"])):
        got.setdefault(r["id"] // 1000, {})[r["keyword"]] = r["score"]
    for k, t in enumerate(texts):
        assert got[k] == pytest.approx(dict(brute_textrank(t, 10)), abs=5e-6), k
    assert any(got[k] != pytest.approx(dict(brute_textrank(t, 2)), abs=5e-6) for k, t in enumerate(texts))
