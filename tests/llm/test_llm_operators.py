"""The ten operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import bz2
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import bpe, chat, common, hilbert, jaccard, lines, media, packing, suffix, topk, toxicity
from glyphmill.llm.common import mix, word_hashes
from glyphmill.llm.components import components
from glyphmill.llm.queries import word_bpe

CLASH = "n_lines long, n_dropped long, n long, shard int, slot long, doc long, id long, a long, b long, spans string, kept string, ids string, term string, score double, media string, curve long, size long"
SCHEMA = f"doc_id long, text string, lang string, source string, {CLASH}"


def docs(spark, texts, empty=False):
    """Rows with null metadata and extra columns."""
    rows = [(i, t, ["en", "de", None][i % 3], f"src{i % 4}") for i, t in enumerate(texts)]
    extra = tuple([None] * CLASH.count(",")) + (None,)
    return spark.createDataFrame([] if empty else [(*r, *extra) for r in rows], SCHEMA).repartition(3)


def corpus(seed=0):
    random.seed(seed)
    vocab = ["".join(random.choices("abcdeé", k=random.randint(2, 7))) for _ in range(300)]
    make = lambda n: " ".join(random.choices(vocab, k=n))
    base = [make(random.randint(1, 120)) for _ in range(40)]
    passage, out = make(40), list(base)
    for t in base[:20]:
        w = t.split()
        for _ in range(4):
            k = random.randrange(len(w))
            out.append(" ".join([*w[:k], random.choice(vocab), *w[k + 1 :]]))
    out += [make(20) + " " + passage + "\n" + make(9) for _ in range(10)] + [base[0], base[0], base[1].upper()]
    out += ["Shared line\n" + make(5) + "\n\t SHARED LINE \r\n\n" for _ in range(12)]
    return [*out, None, "", " \n\t", "one", "one", "two words", make(9000), "x" * 5000, "x" * 400]


def test_lines(spark):
    texts = corpus()
    got = {r["doc_id"]: r for r in lines.line_dedup(docs(spark, texts), min_docs=10).collect()}
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    split = [(t or "").split("\n") for t in texts]
    count = Counter(k for ls in split for k in {key(x) for x in ls})
    for i, ls in enumerate(split):
        kept = [x for x in ls if not key(x) or count[key(x)] < 10]
        assert (got[i]["text"], got[i]["n_lines"], got[i]["n_dropped"]) == ("\n".join(kept), len(ls), len(ls) - len(kept)), i
    assert any(r["n_dropped"] for r in got.values())
    assert lines.line_dedup(docs(spark, [], True)).count() == 0
    same = spark.createDataFrame([(None, "a\nb", 7, "x", "y")] * 11, "doc_id long, text string, __drop long, _k1 string, __lines string")
    assert [(r["text"], r["__drop"], r["_k1"], r["__lines"]) for r in lines.line_dedup(same).collect()] == [("", 7, "x", "y")] * 11


@pytest.mark.parametrize("dims", [2, 3])
def test_curve(spark, dims):
    n = 4
    cells = np.stack(np.meshgrid(*[np.arange(n)] * dims), -1).reshape(-1, dims).tolist()
    names = [f"c{i}" for i in range(dims)]
    rows = spark.createDataFrame(cells, ", ".join(f"{c} int" for c in names)).selectExpr("*", f"{hilbert.curve_index(names, 2)} as h").collect()
    at = np.array([[r[c] for c in names] for r in sorted(rows, key=lambda r: r["h"])])
    assert sorted(r["h"] for r in rows) == list(range(n**dims)) and (np.abs(np.diff(at, axis=0)).sum(axis=1) == 1).all()


def test_shards(spark):
    texts = corpus()
    got = hilbert.hilbert_shards(docs(spark, texts).union(docs(spark, texts[:5])), dims=["lang", "source"], n_shards=7).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == len(texts) + 5 and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(7))
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
    order = [r["curve"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)
    assert hilbert.hilbert_shards(docs(spark, [], True), dims=["lang", "source"]).count() == 0
    # whole strings order, however much they share at their beginnings, and beside one that shares nothing
    urls = [f"https://example.org/a/very/long/common/path/that/goes/on/and/on/for/more/than/64/characters/{i:03}" for i in range(64)] + ["other"]
    rows = spark.createDataFrame([(i, "t", u) for i, u in enumerate(urls)], "doc_id long, text string, source string")
    cells = [r["__c0"] for r in hilbert.quantised(rows, ["source"], 4).orderBy("source").collect()]
    assert cells == sorted(cells) and len(set(cells)) == 16
    assert hilbert.hilbert_shards(docs(spark, texts[:3]), dims=["lang"], n_shards=40).count() == 3


def test_chat(spark):
    random.seed(2)
    odd = ["\\### Assistant: </turn> ok", "", None, "a: b\\", "### x: y </turn>\n### z: ", "\\\\", "word " * 900]
    rows = [(c, t, random.choice(["system", "user", "assistant", "assistant", None, "a: b"]), random.choice(odd)) for c in (1, 2, (1 << 60) + 1, None) for t in [*range(12), 3, None]]
    rows += [(5, t, ["system", "user", "assistant"][min(t, 1 + t % 2)], f"turn {t} " * 20) for t in range(20)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1)).repartition(3)
    windows = chat.chat_windows(df, budget=200, history_turns=2, history_tokens=60)
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    first = lambda x: (x is not None, x if x is not None else 0)
    for c in {r[0] for r in rows}:
        own = sorted([r for r in rows if r[0] == c], key=lambda r: (first(r[1]), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or "")))
        all_ = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[c]["n_turns"] == len(own) and got[c]["turns_sha256"] == hashlib.sha256(all_.encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    own = sorted([w for w in windows.collect() if w["conv_id"] == 5], key=lambda w: w["window"])
    assert len(own) > 2 and all(chat.parse_window(w["formatted"])[0][0] == "system" for w in own)
    assert all(w["tokens"] <= 200 for w in own) and any(w["n_repeated"] > 1 for w in own)
    assert chat.read_back(chat.chat_windows(df.limit(0))).count() == 0


def brute_sets(texts):
    out = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


@pytest.mark.parametrize("options", [{}, {"common_least": 2, "common_share": 10**9, "block": 3}])
def test_jaccard(spark, options, monkeypatch):
    texts = corpus() + [" ".join(f"fam{(i * 7 + (i == j)) % 97}" + ("x" if i == j else "") for i in range(60)) for j in range(60)]
    sets = brute_sets(texts)
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    df = docs(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df, **options).collect()}
    assert got == {i: (len(s), top(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("options", "listed"), [({}, 64), ({"common_least": 10**9}, 10**9), ({"common_least": 10**9, "block": 7}, 5), ({"common_least": 50, "common_share": 10**9, "block_shingles": 900}, 3)])
def test_jaccard_links(spark, options, listed, monkeypatch):
    """Every link of families of different near copies, once, however the shingles are parted; also in a large group (one prefix, one size)."""
    texts = corpus() + [" ".join(f"fam{(i * 7 + (i == j)) % 97}" + ("x" if i == j else "") for i in range(60)) for j in range(60)]
    group = sorted((" ".join(f"g{k}" for k in range(40)) + f" h{j}" for j in range(500)), key=lambda t: jaccard._prefix(jaccard.shingles([t], 5)[0][0], 80, np.zeros(0, np.int64), None)[0].tolist())
    monkeypatch.setattr(jaccard, "LISTED", listed)
    texts += group[:80]
    sets = brute_sets(texts)
    near = {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if a and b and 100 * len(a & b) >= 80 * len(a | b)}
    degree = Counter(x for pair in near for x in pair)
    df = docs(spark, texts)
    rows, links, tree = jaccard.jaccard_links(df.select("doc_id", "text"), **options)
    got = {r["doc_id"]: r["n_links"] for r in rows.collect()}
    assert got == {i: degree[i] for i in range(len(texts))} and max(degree.values()) > 40
    first = {}
    for i, x in enumerate(sets):
        first.setdefault(frozenset(x), i)
    want = sorted((i, j) for i, j in near if sets[i] != sets[j] and first[frozenset(sets[i])] == i and first[frozenset(sets[j])] == j)
    name = {r["doc"]: r["first_id"] for r in rows.where("doc is not null").collect()}
    named = lambda df: sorted(tuple(sorted((name[r["a"]], name[r["b"]]))) for r in df.collect())
    assert named(links) == want
    assert set(named(tree)) <= set(want)


def test_jaccard_links_of_repeated_rows(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(None, base), (3, base), (3, base), (4, base), (5, base + " y"), (5, base + " y"), (6, ""), (None, "z")]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, -1 if r["n_links"] is None else r["n_links"]) for r in got) == [(0, -1), (0, -1), (3, 4), (3, 4), (4, 4), (5, 4), (5, 4), (6, 0)]


def test_jaccard_by_words(spark):
    """Words that a polynomial modulo 2**64 can't tell apart; and codes that clash within a tile."""
    thue = "a"
    while len(thue) < 1024:
        thue += thue.translate(str.maketrans("ab", "ba"))
    other = thue.translate(str.maketrans("ab", "ba"))
    rows = [(1, thue), (2, other), (3, thue + " " + "x y z q r"), (4, other + " " + "x y z q r")]
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 0), 2: (2, 0), 3: (3, 0), 4: (4, 0)}


def clashing_words():
    """Two words of 16 printable characters that the public 64-bit hash of words, eight bytes at a time, can't tell apart, found anew."""
    heads = np.random.default_rng().integers(97, 123, (200_000, 8), np.uint8)
    state = mix(np.uint64(16) * common.C ^ heads.view("<u8").ravel()) * common.P
    # equal after the second block if the states differ as the second blocks do: a difference in the low bits of each byte leaves both printable
    order = np.argsort(state & np.uint64(0xE0E0E0E0E0E0E0E0))
    for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
        d = np.array([state[a] ^ state[b]]).view(np.uint8)
        tail = d ^ 96
        if (d < 32).all() and (tail < 127).all() and state[a] != state[b]:
            return heads[a].tobytes().decode() + "`" * 8, (heads[b].tobytes() + tail.tobytes()).decode()
    raise AssertionError("no pair")


def test_jaccard_of_words_with_equal_hashes(spark):
    """Documents without a common word aren't linked, whatever a 64-bit hash says."""
    pairs = [("36.{cj<{pt?0r=qz", "mm80wo3m@bo@6w*_"), clashing_words()]
    for pair in pairs:
        assert pair[0] != pair[1] and len(set(word_hashes(" ".join((*pair, "")).encode())[1].tolist())) == 1
    rows = [(10 * k + i, " ".join([pair[i % 2]] * n)) for k, pair in enumerate(pairs) for i, n in enumerate((1, 1, 5, 5))]
    got = {r["doc_id"]: (r["component_id"], r["n_links"], r["n_shingles"]) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (i, 0, 1) for i, _ in rows}


def test_shingles_with_one_token():
    """Different words stay different shingles, and equal ones one, also where tokens clash."""
    runs = np.array([[5, 5, 7, 5, 5], [1, 2, 3, 1, 2]], np.uint64)
    tokens, digest = jaccard._set(runs, np.array([0, 1, 2, 0, 1]), 1)
    assert len(set(tokens.tolist())) == 3 and {5, 7} < set(tokens.tolist())
    assert digest == jaccard._set(runs[:, [1, 2, 0]], np.array([1, 2, 0]), 1)[1] != jaccard._set(runs[:, [1, 2]], np.array([1, 2]), 1)[1]


def test_word_hashes():
    """One hash for one word, whatever surrounds it; other words have others, also long ones and those that differ late."""
    random.seed(16)
    words = {bytes(random.choices(b"ab\x00\xc3", k=n)) for n in (1, 2, 7, 8, 9, 16, 17, 40, 511, 512, 513, 5000) for _ in range(60)}
    words = sorted(words) + [w + b"z" for w in words]
    seen = {}
    for _ in range(3):
        random.shuffle(words)
        raw = b"".join(w + bytes(random.choices(b" \t\n\x0b\x0c\r", k=random.randint(1, 3))) for w in words)
        for w, h in zip(words, word_hashes(raw)[1].tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_exact_sets(monkeypatch):
    texts = ["a b c d e f g", "b c d e f", "a", "A  B", "a b c d e a b c d e a b c d e", "é " * 9]
    for clash in (False, True):
        if clash:
            monkeypatch.setattr(jaccard, "mix", lambda x: x % np.uint64(2))
        row, number = jaccard.exact_sets([jaccard.packed(t) for t in texts], 5)
        sets = [set(number[row == k].tolist()) for k in range(len(texts))]
        want = brute_sets(texts)
        for i, a in enumerate(want):
            assert len(sets[i]) == len(a)
            for j, b in enumerate(want):
                assert len(sets[i] & sets[j]) == len(a & b)


def test_jaccard_of_repeated_ids(spark):
    """Rows that share an id and differ in their texts are documents of their own."""
    make = lambda seed: " ".join(random.Random(seed).choices([f"w{k}" for k in range(500)], k=60))
    x, y = make(21), make(22)
    rows = [(1, x), (2, x), (2, y), (7, y + " zz"), (9, make(23))]
    got = sorted((r["doc_id"], r["component_id"], r["n_links"]) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (2, 2, 1), (7, 2, 1), (9, 9, 0)]


def test_jaccard_edges(spark):
    assert jaccard.near_duplicates(docs(spark, [], True)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (None, None), (3, "a b c d e f"), (3, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in jaccard.near_duplicates(odd).collect()) == [("3", "3"), ("3", "3"), ("4", "3"), ("None", "3"), ("None", "None")]


def test_components(spark):
    random.seed(4)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)]
    up = {}

    def top(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for e in edges for x in e}


def test_topk(spark):
    random.seed(6)
    rows = [(i, [random.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(6)]) for i in range(120)]
    rows += [(120, None), (140, [float("nan")] + [0.0] * 5), (160, [None] + [0.0] * 5), (None, [1.0] * 6), (40, rows[40][1]), (40, rows[41][1]), (180, []), (200, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).repartition(3)
    vec = [(i, [int(np.floor(64 * x)) for x in v] + [0] * (6 - len(v))) for i, v in rows if i is not None and v is not None and all(x is not None and x == x for x in v)]
    want = []
    for a, (q, x) in enumerate(vec):
        if q % 20 == 0:
            scored = sorted((-sum(s * t for s, t in zip(x, y, strict=True)), i) for b, (i, y) in enumerate(vec) if a != b)[:20]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, shard_rows=16, block_rows=3).collect()]
    assert sorted(got) == sorted(want) and sum(q == 180 for q, *_ in got) == 20
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    huge = spark.createDataFrame([(0, [3e38, 1.0]), (1, [3e38, 2.0]), (2, [-3e38, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r)[2:] for r in topk.top_k(huge, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, (1 << 63) - 1), (2, 1 - (1 << 63))]


def test_topk_beyond_a_double(spark):
    """Components whose product with the scale no double holds are whole numbers; scores stand at the ends of a long only in the end."""
    rows = [(0, [1e307, -1e307, 0.5]), (1, [1e307, 1e307, 0.25]), (2, [-1.7e308, 0.0, 1.0]), (3, [0.0, 0.0, 3.0]), (4, [-1e307, -1e307, 2.0]), (5, [2.0**-70, 1e18, -0.1])]
    whole = {i: [math.floor(Fraction(x) * 64) for x in v] for i, v in rows}
    top, want = (1 << 63) - 1, []
    for q in (0, 3):
        best = sorted((-min(top, max(-top, sum(a * b for a, b in zip(whole[q], whole[c], strict=True)))), c) for c in whole if c != q)
        want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for shard_rows in (8192, 2):
        assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 3 == 0, shard_rows=shard_rows).collect())) == want
    assert topk.scaled(np.array([1.5, -1e-9]), 64.0).tolist() == [96, -1] and topk.scaled(np.array([1e308]), 64.0).dtype == object


@pytest.mark.parametrize("place", range(4))
def test_toxicity_of_one_very_long_text(spark, place):
    """A text above the bound takes no other's place, wherever the hash puts it; it is left out alone."""
    texts = [f"calm words here {k}" if k % 2 else f"zidiot words there {k}" for k in range(20)]
    order = [r["k"] for r in spark.range(20).select(F.col("id").alias("k")).orderBy(F.xxhash64("k"), "k").collect()]
    long = order[(0, 1, 10, 19)[place]]
    texts[long] = texts[long] * 100
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(20)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(df, labels, sample_chars=600)
    assert sorted(model.example_ids) == [k for k in range(20) if k != long]
    assert sorted(toxicity.fit_toxicity(df, labels).example_ids) == list(range(20))
    assert toxicity.fit_toxicity(df, labels, sample_chars=0).example_ids == []


def test_toxicity(spark):
    random.seed(7)
    calm = ["".join(random.choices("abcdefgh", k=5)) for _ in range(400)]
    rude = ["zidiot", "zmoron", "zscum", "zclown"]
    texts, truth = [], []
    for i in range(600):
        bad = i % 6 == 0
        w = random.choices(calm, k=40) + (random.choices(rude, k=5) if bad else [])
        random.shuffle(w)
        texts.append(" ".join(w))
        truth.append(int(bad))
    texts += [None, "", "  "]
    df = docs(spark, texts)
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(truth) if i % 3 != 1] + [(None, 1), (2, None), (10**6, 1), (0, 1)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(df, labels)
    got = {r["doc_id"]: r for r in df.select("doc_id", toxicity.toxicity(F.col("text"), model, spark).alias("t")).collect()}
    held = [i for i in range(600) if i % 3 == 1]
    assert np.mean([(got[i]["t"]["score"] >= 0.7) == truth[i] for i in held]) > 0.98
    assert all(0 <= r["t"]["score"] <= 1 for r in got.values()) and got[600]["t"]["score"] == got[601]["t"]["score"] < 0.3
    assert got[6]["t"]["example_ids"] and got[6]["t"]["cosines"][0] > 0
    assert got[601]["t"]["score"] == got[602]["t"]["score"]  # no term in common with any example
    same = docs(spark, texts[:200] + texts[:200])
    twice = same.select("text", toxicity.toxicity(F.col("text"), model, spark)["score"].alias("s")).groupBy("text").agg(F.count_distinct("s").alias("n")).where("n > 1").count()
    assert not twice
    loose = spark.createDataFrame([(None, texts[6]), (None, None)], "doc_id long, text string").withColumn("score", F.lit("x"))
    assert sorted(r["s"] for r in loose.select(toxicity.toxicity(F.col("text"), model, spark)["score"].alias("s")).collect()) == sorted([got[6]["t"]["score"], got[600]["t"]["score"]])
    assert toxicity.fit_toxicity(docs(spark, [], True), labels).index is None
    none = toxicity.fit_toxicity(df, labels.limit(0))
    assert {r["s"] for r in df.select(toxicity.toxicity(F.col("text"), none, spark)["score"].alias("s")).collect()} == {0.0}


def test_block_max_is_exact():
    random.seed(8)
    examples = []
    for _ in range(1500):
        terms = np.array(sorted(random.sample(range(60), random.randint(1, 6))), np.int64)
        examples.append((terms, toxicity.unit(np.ones(len(terms)), np.arange(1.0, 61.0)[terms])))
    order = toxicity.arranged(examples, 60)
    assert sorted(order) == list(range(1500))
    examples = [examples[i] for i in order]
    index = toxicity.BlockMaxIndex(examples, 60)
    for leave in (-1, 7):
        for _ in range(60):
            terms = np.array(sorted(random.sample(range(60), 4)), np.int64)
            weights = toxicity.unit(np.array([1, 2, 1, 5]), np.ones(4))
            ids, cosines = index.nearest(terms, weights, 15, leave)
            known = dict(zip(terms.tolist(), weights.tolist(), strict=True))
            every = np.array([sum(known.get(t, 0) * w for t, w in zip(*map(np.ndarray.tolist, e), strict=True)) for e in examples])
            if leave >= 0:
                every[leave] = -1
            assert np.allclose(cosines, -np.sort(-every)[:15]) and np.allclose(every[ids], cosines)


def test_toxicity_equals_brute_force(spark):
    """Terms, weights, neighbours and evidence over the labels of the small tables, all written out again."""
    import math

    from glyphmill.llm.queries import held_out

    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(~held_out(F.col("doc_id")))
    model = toxicity.fit_toxicity(table, labels)
    texts = {r["doc_id"]: r["text"] or "" for r in table.collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["doc_id"] in texts}
    tf = {i: Counter(re.findall(r"[^\W\d_]+", t.lower())) for i, t in texts.items()}
    n1 = sum(truth.values())
    n = {1: n1, 0: len(truth) - n1}

    def weight(w):
        hold = {c: sum(1 for i, y in truth.items() if y == c and w in tf[i]) for c in (0, 1)}
        g = 0.0
        for c in (0, 1):
            for a, q in ((hold[c], sum(hold.values()) / len(truth)), (n[c] - hold[c], 1 - sum(hold.values()) / len(truth))):
                g += a * math.log(a / (n[c] * q)) if a else 0.0
        idf = math.log((1 + len(texts)) / (1 + sum(w in t for t in tf.values()))) + 1
        return idf * (1 + 2 * max(g, 0))

    weights = {w: weight(w) for w in {w for i in truth for w in tf[i]}}
    assert set(model.ids) == set(weights)

    def vector(i):
        v = {w: (1 + math.log(c)) * weights[w] for w, c in tf[i].items() if w in weights}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()} if size else {}

    examples = {i: vector(i) for i in truth if tf[i]}
    got = table.select("doc_id", toxicity.toxicity(F.col("text"), model, spark).alias("t")).collect()
    lonely = 0
    for r in got:
        v = vector(r["doc_id"])
        cosine = {i: sum(x * e.get(w, 0.0) for w, x in v.items()) for i, e in examples.items()}
        best = sorted((c for c in cosine.values() if c > 0), reverse=True)[:15]
        assert np.allclose(r["t"]["cosines"], best)
        assert all(abs(cosine[int(i)] - c) < 1e-9 for i, c in zip(r["t"]["example_ids"], r["t"]["cosines"], strict=True))
        lonely += not best and bool(texts[r["doc_id"]])
    assert lonely < 0.05 * len(got)


def brute_repeats(texts, n=100):
    first, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - n + 1):
            if raw[s : s + n] in first:
                gone[s : s + n] = b"\1" * n
            first.add(raw[s : s + n])
        out.append((raw, bytes(gone)))
    return out


def test_suffix(spark):
    texts = corpus()
    got = {r["doc_id"]: r for r in suffix.remove_repeats(docs(spark, texts)).collect()}
    for i, (raw, gone) in enumerate(brute_repeats(texts)):
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for a, b in zip(b"\0" + gone, gone, strict=False) if b and not a)
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept"])) == (len(raw), sum(gone), spans, kept), i
    assert sum(r["n_removed"] for r in got.values()) > 1000
    assert suffix.remove_repeats(docs(spark, [], True)).count() == 0
    odd = spark.createDataFrame([(None, "q" * 300, 1, "s"), (1, "é" * 300, 2, "t"), (1, "é" * 300, 3, "u"), (2, "xé" + "é" * 80, 4, "v")], "doc_id long, text string, _doc long, __spans string")
    found = suffix.remove_repeats(odd)
    assert sorted((r["_doc"], r["__spans"]) for r in found.collect()) == [(1, "s"), (2, "t"), (3, "u"), (4, "v")]


@pytest.mark.parametrize("partitions", [1, 8])
def test_suffix_of_repeated_rows(spark, partitions):
    """Rows that repeat an id and a text count as one document: each keeps what the document alone would keep."""
    make = lambda seed, n: " ".join(random.Random(seed).choices([f"w{k}" for k in range(500)], k=n))
    passage = make(1, 60)
    texts = [passage, make(2, 50) + passage + make(3, 50), "é" * 300, make(4, 90), passage + make(5, 40)]
    rows = [(i, t) for i, t in enumerate(texts) for _ in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    got = suffix.remove_repeats(df).collect()
    want = [bytes(b for b, g in zip(raw, gone, strict=True) if not g) for raw, gone in brute_repeats(texts)]
    assert sorted((r["doc_id"], bytes(r["kept"])) for r in got) == sorted((i, want[i]) for i, _ in rows)
    assert want[0] == passage.encode() and want[3] == texts[3].encode()


def test_suffix_of_repeated_ids(spark):
    """Rows that share an id and differ in their texts are documents of their own: text found once stays."""
    make = lambda seed, n: " ".join(random.Random(seed).choices([f"w{k}" for k in range(500)], k=n))
    one, two, three = make(11, 70), make(12, 70), make(13, 30)
    df = spark.createDataFrame([(1, one), (2, one), (2, two), (5, three + two), (5, None), (5, "")], "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["n_bytes"]): bytes(r["kept"]) for r in suffix.remove_repeats(df).collect()}
    size = lambda t: len(t.encode())
    assert got == {(1, size(one)): one.encode(), (2, size(one)): b"", (2, size(two)): two.encode(), (5, size(three + two)): three.encode(), (5, 0): b""}


def test_suffix_with_crowded_minimisers(spark, monkeypatch):
    """Every choice of crowded minimisers gives the same rows, and none is left to one long list."""
    random.seed(14)
    header = " ".join(random.choices([f"h{k}" for k in range(900)], k=40))
    texts = [header + " " + " ".join(random.choices([f"w{k}" for k in range(900)], k=random.randint(5, 60))) for _ in range(120)]
    want = brute_repeats(texts)
    for crowd in (2, 10**9):
        monkeypatch.setattr(suffix, "LOOK", 1)
        monkeypatch.setattr(suffix, "CROWD", crowd)
        plain = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").withColumn("key", F.lit(0).cast("long"))
        assert (len(suffix._crowded(plain, 100, 32)) > 0) == (crowd == 2)
        got = {r["doc_id"]: bytes(r["kept"]) for r in suffix.remove_repeats(docs(spark, texts)).collect()}
        assert got == {i: bytes(b for b, g in zip(raw, gone, strict=True) if not g) for i, (raw, gone) in enumerate(want)}


@pytest.mark.parametrize("wide", [150, 5000, 1 << 22])
def test_suffix_with_wide_routes(spark, monkeypatch, wide):
    """One minimiser in very many different surroundings: no merge holds more than its bound, and the rows are the same."""
    random.seed(17)
    header = " ".join(random.choices([f"h{k}" for k in range(900)], k=40))
    make = lambda n: " ".join(random.choices([f"w{k}" for k in range(900)], k=n))
    texts = [make(30) + header[random.randint(0, 60) : random.randint(130, 200)] + make(30) for _ in range(150)] + ["é" * 200, "aé" * 120, None, ""]
    monkeypatch.setattr(suffix, "CROWD", 10**9)
    monkeypatch.setattr(suffix, "WIDE", wide)
    want = brute_repeats(texts)
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix.remove_repeats(docs(spark, texts)).collect()}
    assert got == {i: bytes(b for b, g in zip(raw, gone, strict=True) if not g) for i, (raw, gone) in enumerate(want)}
    assert sum(sum(gone) for _, gone in want) > 5000


def test_routes_follow_the_window():
    """A window gets one route whatever surrounds it, and however much of it a task reads at once."""
    random.seed(15)
    piece = bytes(random.choices(b"abcdefgh ", k=400))
    routes = []
    for pad in (b"", bytes(random.choices(b"xyz", k=1 << 17)), b"a" * 5000):
        _, first, last, route, _ = suffix.runs([pad + piece], 100, 32)
        at = {}
        for a, b, r in zip(first.tolist(), last.tolist(), route.tolist(), strict=True):
            at.update(dict.fromkeys(range(a - len(pad), b - len(pad) + 1), r))
        routes.append([at[k] for k in range(301)])
    assert routes[0] == routes[1] == routes[2]


def test_merged_transforms(monkeypatch):
    random.seed(3)
    monkeypatch.setattr(suffix, "SHARD", 200)
    for depth in (10, 12):
        base = [bytes(random.choices(b"ab\x00", k=40)) for _ in range(6)]
        strings = list({(random.choice(base)[random.randint(0, 4) :] + random.choice(base))[: random.randint(12, 80)] for _ in range(40)})
        position, block = suffix.common_blocks(strings, depth)
        begin = np.cumsum([0] + [len(s) + 1 for s in strings])
        seen = {}
        for p, b in zip(position.tolist(), block.tolist(), strict=True):
            k = int(np.searchsorted(begin, p, side="right")) - 1
            piece = strings[k][p - begin[k] : p - begin[k] + depth]
            if len(piece) == depth:
                seen.setdefault(piece, set()).add(b)
        assert all(len(v) == 1 for v in seen.values()) and len({min(v) for v in seen.values()}) == len(seen)


def test_whole_characters():
    raw = "aébécd".encode()
    assert suffix._whole_characters(raw, [(2, 5)]) == "aéécd"
    assert suffix._whole_characters(raw, [(0, len(raw))]) == ""


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_bpe())


ODD = ["<|endoftext|>a<|startoftext|> b", "it's 'stuff don't we'll I'd", "ΣΑΣ όλος Σ", "İstanbul ǅ ß ŉ", "日本語 123４５ ½²", "é á x​y", "\x00\x1c\x1f z\x85 q\xa0r", "🙂🙂👍🏽 hi", "___foo__bar..!!", "ﬁ ﬀ K Å", "ab" * 3000 + "c"]


def test_bpe(spark, library):
    random.seed(9)
    texts = corpus() + ODD + ["".join(random.choice("abcdefghinorst'éüß ñ12.,!\n-_<|>") for _ in range(50)) for _ in range(200)]
    got = bpe.with_tokens(docs(spark, texts), word_bpe(), decoded_col="decoded").collect()
    coder = bpe.encoder(word_bpe())
    for r in got:
        want = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == want and r["decoded"] == library.decode(want, skip_special_tokens=False) == coder.decode(ids)
    assert bpe.with_tokens(docs(spark, [], True), word_bpe()).count() == 0


def test_bpe_speculation():
    coder = bpe.WordEncoder(word_bpe())
    random.seed(10)
    words = {"".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=random.randint(1, 12))) for _ in range(3000)}
    kept = 0
    long = {w * 9 + "é" for w in list(words)[:50]} | {"a" * k for k in (1, 2, 3, 7, 8, 9, 12, 13, 20, 21, 63, 64, 65, 200)}
    some = sorted(words | long)
    assert coder.merged_many(some) == [coder.merged(coder.starts(w)) for w in some]
    word, token = coder.proposed([w.encode() for w in some])
    assert [token[word == k].tolist() for k in range(len(some))] == [coder.greedy(w) for w in some]
    for w in words:
        guess, exact = coder.greedy(w), coder.merged(coder.starts(w))
        pairs = np.array(list(zip(guess, guess[1:], strict=False)), np.int64).reshape(-1, 2)
        ok = all(map(coder.stands, guess)) and coder.compatible(pairs[:, 0], pairs[:, 1]).all()
        assert ok == (guess == exact)
        kept += ok
    assert kept > 300


def test_media(spark):
    texts = corpus()
    manifest, name = media.store_media(docs(spark, texts))
    stored = spark.table(name).collect()
    assert len(stored) == len({media.payload(t)[1] for t in texts})
    chunks = {}
    for r in stored:
        own = [i for i, o in enumerate(r["owned"]) if o]
        chunks |= zip([r["digests"][i] for i in own], media.parts(bz2.decompress(r["packed"]), [r["sizes"][i] for i in own]), strict=True)
    # what is stored is the whole container, header included
    assert {b"".join(chunks[d] for d in r["digests"]) for r in stored} == {media.wav(media.payload(t)[1]) for t in texts}
    owned = [d for r in stored for d, o in zip(r["digests"], r["owned"], strict=True) if o]
    assert len(owned) == len(set(owned)) and {d for r in stored for d in r["digests"]} == set(owned)
    spark.sql(f"drop table {name}")
    got = media.media_features(docs(spark, texts).union(docs(spark, texts[:2]))).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        n, p = media.payload(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        w = media.wav(p)
        assert r["media_bytes"] == len(w) and r["media_sha256"] == hashlib.sha256(w).hexdigest() and media.samples_of(w) == p
    assert media.media_features(docs(spark, [], True)).count() == 0


def test_media_with_frequent_chunks(spark, monkeypatch):
    """Chunks that many media share come from the tasks' own copies, others by digest; the media are the same."""
    random.seed(18)
    make = lambda n: "".join(random.choices("abcdefgh \n", k=n))
    common, some = make(30_000), make(20_000)
    texts = [make(200 * k) + common + make(100) + (some if k % 7 == 0 else "") for k in range(30)]
    monkeypatch.setattr(media, "FREQUENT", 6)
    got = media.media_features(docs(spark, texts)).collect()
    assert len(got) == 30
    for r in got:
        w = media.wav(media.payload(texts[r["doc_id"]])[1])
        assert r["media_sha256"] == hashlib.sha256(w).hexdigest() and r["media_bytes"] == len(w)


def test_chunks_follow_content():
    random.seed(11)
    data = bytes(random.choices(range(256), k=60_000))
    a, b = media.cuts([data, b"new" * 40 + data])
    one, two = set(media.parts(data, a)), set(media.parts(b"new" * 40 + data, b))
    assert len(one & two) >= len(one) - 2 and max(a) <= media.MOST and sum(a) == len(data)
    slow = [sum(int(media.GEAR[data[i - j]]) << j for j in range(32)) % 2**32 for i in range(40, 60)]
    assert media.gear_hash(np.frombuffer(data, np.uint8))[40:60].tolist() == slow


def test_packing(spark, library):
    texts = corpus() + ODD
    got = packing.pack(docs(spark, texts), word_bpe(), capacity=256, piece=64, block_windows=8).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    back, windows = {}, {}
    for r in sorted(got, key=lambda r: r["start"]):
        back.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
    assert back == ids
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(docs(spark, [], True), word_bpe()).count() == 0


def test_rows_without_id(spark, library):
    """Null ids beside others, in every operator that takes documents one by one."""
    rows = spark.createDataFrame([(None, "one two", "en"), (None, None, None), (3, "one two", "de"), (3, "", "en")], "doc_id long, text string, lang string")
    ids = library.encode("one two", add_special_tokens=False).ids
    coded = bpe.with_tokens(rows, word_bpe(), decoded_col="decoded").collect()
    assert sorted((str(r["doc_id"]), len(r["ids"]) // 4) for r in coded) == [("3", 0), ("3", len(ids)), ("None", 0), ("None", len(ids))]
    pieces = packing.pack(rows, word_bpe(), capacity=16).collect()
    assert sorted((str(r["doc_id"]), r["doc_tokens"]) for r in pieces) == [("3", 1), ("3", len(ids) + 1), ("None", 1), ("None", len(ids) + 1)]
    facts = media.media_features(rows).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"]) for r in facts) == [("3", 0, 64), ("3", 7, 64), ("None", 0, 64), ("None", 7, 64)]
    placed = hilbert.hilbert_shards(rows, dims=["lang"], n_shards=2).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in placed) == [("3", 16), ("3", 23), ("None", 16), ("None", 23)] and Counter(r["shard"] for r in placed) == {0: 2, 1: 2}


def test_differencing():
    random.seed(12)
    sizes = np.array([random.randint(1, 512) for _ in range(600)])
    groups = packing.windows(sizes, 2048)
    assert sorted(i for g in groups for i in g) == list(range(600))
    sums = [int(sizes[g].sum()) for g in groups]
    assert max(sums) <= 2048 and max(sums) - min(sums) < 60 and len(groups) <= sizes.sum() / 2048 * 1.02 + 1
    assert packing.windows(np.array([5]), 8) == [[0]] and packing.windows(np.zeros(0, np.int64), 8) == []


