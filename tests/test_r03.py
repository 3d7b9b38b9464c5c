"""Cases of the findings of round 3."""

from pyspark.sql import functions as F

from glyphmill.functions import cleaning
from glyphmill.operators import clients, datasets


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def cleaned(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def test_rules_run_in_one_kernel(spark):
    """Separators count as white space, as in the SQL; no rule is an engine expression of its own."""
    assert cleaned(spark, cleaning.remove_dates, "在8\x1c点到，5\x1e月好") == "在到，好"
    made = spark.createDataFrame([("x",)], "t string").select(cleaning.preprocess_training(F.col("t")))
    assert "regexp_replace" not in plan(made) and plan(made).count("ArrowEvalPython") == 1


def test_comments_are_cleaned_once(spark):
    plans = []

    def store(df):
        plans.append(plan(df))
        return spark.createDataFrame(df.collect(), df.schema)

    rows = spark.createDataFrame([(1, "好看"), (2, "abc"), (3, None)], "index long, comment string")
    assert [r["index"] for r in datasets.generated(rows, clients.canned_pairs, store=store).collect()] == [1]
    assert plans[0].count("ArrowEvalPython") == 1 and "Filter" not in plans[0]


def test_addresses_that_touch_other_letters(spark):
    """A line end between an address and an accented letter is taken out before addresses are."""
    assert cleaned(spark, cleaning.preprocess_inference, "von ab.08@mail0.example.com\nÉtude") == "von Étude"
    assert cleaned(spark, cleaning.remove_emails, "éa@b.orgé a@b.org1") == "éé a@b.org1"


def test_string_cuts_come_from_all_values(spark):
    """More distinct strings than were looked at before, few of them with most of the rows."""
    from glyphmill.llm import hilbert

    values = [(f"w{i:05d}", 1 + (i * 7919) % 13 * (i % 50 == 0)) for i in range(25_000)]
    total, seen, want = sum(n for _, n in values), 0, []
    for v, n in values:
        if seen * 8 // total != (seen + n) * 8 // total and seen + n < total:
            want.append(v)
        seen += n
    rows = spark.createDataFrame(values, "s string, n int").selectExpr("s", "explode(sequence(1, n)) as k").select("s")
    assert hilbert._string_cuts(rows.union(spark.createDataFrame([(None,)], "s string")), "s", 3) == want
    assert hilbert._string_cuts(rows.where("false"), "s", 3) == []


def test_least_span_of_a_long_text():
    """Many starts, each far from its end: all starts at once, in a moment."""
    import time

    from glyphmill.functions import spans

    text, began = "b" * 200_000 + "c" + "b" * 200_000, time.time()
    assert spans.least_span("bxc", text) == -1 and spans.least_span("bcbb", "bbbcbxb" + "b" * 9) == 5
    assert spans.least_span("bdc", "b" * 150_000 + "d" + "e" * 150_000 + "c") == 150_003
    assert spans.least_span("b c", "bxcb😀c") == 3 and spans.least_span("cd", "dc") == -1
    assert time.time() - began < 5


def test_object_is_parsed_once_for_all_rewards(spark):
    from glyphmill.functions import rewards

    rows = spark.createDataFrame([('{"keywords": [["r", "bc", 1]]}', "bc")], "raw string, w string")
    made = rows.select(rewards.reward_struct(F.col("raw"), F.lit('{"keywords": [["r", "bc", 1]]}'), F.col("w")).alias("p"))
    assert plan(made).count("<think>") <= 2  # the pattern, and the test that it matches
    assert made.first()["p"].asDict() == {k: v[0] for k, v in rows.select(*(x.alias(k) for k, x in rewards.reward_parts(F.col("raw"), F.lit('{"keywords": [["r", "bc", 1]]}'), F.col("w")).items())).toPandas().items()}


def test_prompts_alone_become_objects(spark):
    """More rows than are taken at once keep their answers; other columns stay in Arrow."""
    from glyphmill.operators import extraction

    def echo():
        return lambda system, user, params: None if user.endswith("7") else '{"k": "%s"}' % user

    rows = spark.range(700).selectExpr("id", "'s' as system", "cast(id as string) as user").coalesce(1)
    made = extraction.ask(rows, echo, extraction.Config(max_retries=1), ["k"])
    assert "MapInArrow" in plan(made)
    got = {r["id"]: (r["raw"], r["attempts"]) for r in made.collect()}
    assert got == {i: (None, 2) if i % 10 == 7 else ('{"k": "%d"}' % i, 1) for i in range(700)}


def test_many_runs_are_cut_at_once(spark):
    """The paths of many runs on arrays are those of each run alone; words stay in Arrow, in pieces of bounded text."""
    import random

    import pyarrow as pa

    from glyphmill.operators import segment

    rng = random.Random(4)
    words = {"".join(rng.choices("一二三四五", k=rng.randint(1, 6))): float(rng.randint(1, 9)) for _ in range(60)}
    runs = ["".join(rng.choices("一二三四五六𠀀", k=rng.randint(1, 12))) for _ in range(300)] + ["abc", "一" * 500]
    lattice = segment.Lattice(words.items())
    found, n = lattice.cut(runs, pa.array(r == "abc" for r in runs).to_numpy(zero_copy_only=False))
    found, at = found.to_pylist(), 0
    for run, k in zip(runs, n.tolist(), strict=True):
        assert found[at : at + k] == (["abc"] if run == "abc" else lattice.path(run))
        at += k
    assert lattice.edges.nbytes + lattice.weight.nbytes < 10_000  # no object for each letter
    rows = spark.createDataFrame([(1, "一二abc三" * 60_000), (2, None), (3, "xyz"), (4, "三" + "一二," * 100_000)], "id long, text string").coalesce(1)
    told = spark.createDataFrame([("一二", 9, "n"), ("三", 3, "m")], "word string, n long, class string")
    for classes, want in ((None, {1: 180_000, 2: 0, 3: 1, 4: 100_001}), (["n"], {1: 60_000, 2: 0, 3: 0, 4: 100_000})):
        tokens = segment.segmenter(told, classes=classes)
        assert {r["id"]: r["n"] for r in rows.select("id", F.size(tokens(F.col("text"))).alias("n")).collect()} == want


def test_answers_are_mended_in_pieces():
    """An Arrow kernel, whose texts are Python objects a few at a time: more than it holds at once, nulls, texts that are no JSON."""
    import pyarrow as pa

    from glyphmill.functions import jsonx

    texts = ['{"a": 1, "a": NaN, "b": "%s"}' % ("x" * 700_000)] * 4 + [None, "", "{", '{"a": 1}']
    got = jsonx._plain.func(pa.array(texts)).to_pylist()
    assert got == ['{"a": "NaN", "b": "%s"}' % ("x" * 700_000)] * 4 + [None, None, None, '{"a": 1}']
    assert jsonx._plain.func(pa.array([], pa.string())).to_pylist() == []


def test_plain_texts_are_split_on_arrays():
    """The words of the pattern, many texts at once; capitals whose small letter lies beyond U+024F go by the file's own splitter."""
    import random

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from glyphmill.llm import bpe

    rng = random.Random(6)
    for _ in range(300):
        texts = ["".join(rng.choices("  \n''''strevlmdSTREx.,1²é\xad", k=rng.randint(0, 30))) for _ in range(rng.randint(0, 6))]
        words, n = bpe.plain_words(texts)
        assert [len(bpe._words.findall(t.lower())) for t in texts] == n.tolist()
        assert [w for t in texts for w in bpe._words.findall(t.lower())] == words.to_pylist()
    path = public_tokenizers.path("word_bpe_49k.json")
    library, encoder = Tokenizer.from_file(path), bpe.WordEncoder(path)
    texts = ["aȺbȾ İx Ɓa", None, "it's 'some ''s we've I'LL", "", "<|endoftext|> a", "é" * 3000, " \n", "日本 x"]
    for encoder.keep in (10_000, 1):  # the table is emptied between texts
        ids, shown = encoder.encode(texts)
        for t, i, s in zip(texts, ids, shown, strict=True):
            want = library.encode(t or "", add_special_tokens=False).ids
            assert np.frombuffer(i, "<u4").tolist() == want and s == library.decode(want, skip_special_tokens=False)


def test_words_are_counted_on_arrays():
    """Tallies and the words near the best of many rows, against Counter and row by row: no words, nulls, short words, ideographs, ties."""
    import random
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    from glyphmill.operators import fallback

    rng = random.Random(7)
    names = ["", "a", "ab", "abc", "abcd", "é", "éàü", "一二", "一", "一a", "zeta", "𠀀bc", "beta"]
    rows = [rng.choices(names, k=rng.randint(0, 40)) for _ in range(200)] + [None, [], [""]]
    words, times, total = fallback._tallied(pa.array(rows, pa.list_(pa.string())).slice(3), 3)
    for own, w, t, n in zip(rows[3:], words.to_pylist(), times.to_pylist(), total.to_pylist(), strict=True):
        want = Counter(x for x in own or [] if len(x) >= 3 or x in ("一二", "一a"))
        assert w == sorted(want) and t == [want[x] for x in w] and n == want.total()
    assert [x.to_pylist() for x in fallback._tallied(pa.array([], pa.list_(pa.string())), 3)] == [[], [], []]
    n = np.array([0, 1, 5, 6, 40, 0])
    low = np.array([rng.randint(1, 9) / 9 for _ in range(n.sum())])
    high = low + np.array([rng.choice([0, 0, 1e-6, 0.3]) for _ in low])
    for k in (1, 5, 8):
        found, at = fallback._near_bests(low, high, n, k), 0
        for size in n.tolist():
            assert np.flatnonzero(found[at : at + size]).tolist() == fallback._near_best(low[at : at + size], high[at : at + size], k).tolist()
            at += size
