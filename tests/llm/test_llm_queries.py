"""The contract queries and the pipeline on the small tables."""

import hashlib
import io
import math
import random
import re
import wave
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from glyphmill.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(queries.word_bpe())
    out.no_truncation()
    out.no_padding()
    return out


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_chat_query(spark):
    turns = {-7: [("user", queries.EXTRA_TEXT), ("assistant", queries.EXTRA_TEXT)]}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    assert queries.EXTRA_TEXT == chr(92) + "### Assistant: </turn> ok"
    got = {r["conv_id"]: r for r in queries.op1_chat_formatting(spark, SF).collect()}
    assert set(got) == set(turns)
    for c, own in turns.items():
        loss, r = "".join(t for role, t in own if role == "assistant"), got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(own), sha("".join(f"{a}\n{t}\n" for a, t in own)), len(loss), sha(loss))
        assert r["formatted_chars"] >= sum(len(a) + len(t) for a, t in own)


def test_toxicity_query(spark, texts):
    got = queries.op4_toxicity(spark, SF).collect()
    labels = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        assert r["held_out"] == is_held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert len(r["neighbour_ids"]) == len(r["cosines"]) <= 15 and all(i in labels and not is_held_out(i) for i in r["neighbour_ids"])


def pooled(x, y):
    """Isotonic regression by its definition: the greatest of the least means, then a point for each level."""
    order = np.argsort(x, kind="stable")
    x, y = np.array(x)[order], np.array(y)[order]
    total = np.concatenate([[0], np.cumsum(y)])
    mean = lambda a, b: (total[b + 1] - total[a]) / (b + 1 - a)
    n = len(x)
    level = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
    groups = {}
    for i, v in enumerate(level):
        groups.setdefault(round(v, 9), []).append(i)
    return [(x[g].mean(), (y[g].sum() + 0.05) / (len(g) + 0.1)) for g in groups.values()]


def test_toxicity_scores(spark, texts):
    """Every score of the query from its parts: exact neighbours by plain cosine, the weighted vote, and isotonic calibration on examples left out of their own votes."""
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["toxic"] is not None and not is_held_out(r["doc_id"])}
    tf = {i: Counter(re.findall(r"[^\W\d_]+", (t or "").lower())) for i, t in texts.items()}
    truth = {i: y for i, y in labels.items() if i in texts and tf[i]}
    df = Counter(w for t in tf.values() for w in t)
    n = Counter(truth.values())
    hold = {c: Counter(w for i, y in truth.items() if y == c for w in tf[i]) for c in (0, 1)}

    def weight(w):
        q, g = (hold[0][w] + hold[1][w]) / len(truth), 0.0
        for c in (0, 1):
            for a, e in ((hold[c][w], q), (n[c] - hold[c][w], 1 - q)):
                g += a * math.log(a / (n[c] * e)) if a else 0.0
        return (math.log((1 + len(texts)) / (1 + df[w])) + 1) * (1 + 2 * max(g, 0))

    known = {w: weight(w) for w in hold[0] | hold[1]}

    def vector(i):
        v = {w: (1 + math.log(c)) * known[w] for w, c in tf[i].items() if w in known}
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / size for w, x in v.items()}

    examples = {i: vector(i) for i in truth}

    def vote(v, without=None):
        found = sorted(((sum(x * e.get(w, 0.0) for w, x in v.items()), i) for i, e in examples.items() if i != without), reverse=True)[:15]
        found = [(1 / (1.1 - c), truth[i]) for c, i in found if c > 0]
        return sum(w * y for w, y in found) / sum(w for w, _ in found) if found else None

    votes = {i: vote(v, i) for i, v in examples.items()}
    steps = pooled([x for x in votes.values() if x is not None], [truth[i] for i, x in votes.items() if x is not None])
    empty = [labels[i] for i in labels if i in texts and not tf[i]]
    base = (sum(empty) + 0.05) / (len(empty) + 1)
    got = {r["doc_id"]: r["score"] for r in queries.op4_toxicity(spark, SF).collect()}
    for i in texts:
        v = vote(vector(i))
        want = base if v is None else float(np.interp(v, [a for a, _ in steps], [b for _, b in steps]))
        assert got[i] == pytest.approx(want, abs=1e-6), i


def test_lines_of_repeated_ids(spark, tmp_path):
    """Every row is a document: ten rows of one id count as ten, in the query as in its SQL."""
    rows = [(1, f"same\nown {k}") for k in range(9)] + [(2, "same\nother"), (3, "other"), (None, None), (None, "\n same ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = c.execute(queries.ORACLE_SQL["op6_line_dedup"]).fetchall()
    got = [tuple(r) for r in queries.op6_line_dedup(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == 13 and sum(r[2] for r in got) == 11


def test_sharding_query(spark, texts):
    got = queries.op7_hilbert_sharding(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts) and {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    shards = {}
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
        shards.setdefault(r["shard"], []).append((r["slot"], r["curve"]))
    assert set(shards) == set(range(40)) and {len(x) for x in shards.values()} <= {len(got) // 40, -(-len(got) // 40)}
    assert all([s for s, _ in sorted(x)] == list(range(len(x))) for x in shards.values())
    order = [c for k in sorted(shards) for _, c in sorted(shards[k])]
    assert order == sorted(order)


def test_bpe_query(spark, texts, library):
    got = queries.op8_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False)))


def test_media_query(spark, texts):
    got = queries.op9_media(spark, SF).collect()
    assert len(got) == len(texts)
    same = {}
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        full = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), sha(full), zlib.crc32(full[-64:]))
        held = io.BytesIO()
        with wave.open(held, "wb") as w:
            w.setparams((1, 1, 8000, 0, "NONE", ""))
            w.writeframes(full)
        assert (r["media_bytes"], r["media_sha256"]) == (len(held.getvalue()), sha(held.getvalue()))
        assert same.setdefault(raw, r["feature"]) == r["feature"] and f"peak={max(full)} sum={sum(full)} " in r["feature"]


def check_packing(rows, texts, library):
    pieces, windows = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for i, own in pieces.items():
        ids, at = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    return len(windows), sum(r["length"] for r in rows)


def test_packing_query(spark, texts, library):
    n, tokens = check_packing(queries.op10_packing(spark, SF).collect(), texts, library)
    assert n <= tokens / 2048 * 1.03 + 4  # a partition ends with a window of its own


def test_pipeline_by_brute_force(spark, texts, library):
    """Every stage written out again on what the one before it keeps; the model's scores are the query's, whose parts have tests of their own."""
    now = {r["doc_id"]: texts[r["doc_id"]] for r in queries.op4_toxicity(spark, SF).collect() if r["predicted"] == 0}
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    split = {i: (t or "").split("\n") for i, t in now.items()}
    often = Counter(k for ls in split.values() for k in {key(x) for x in ls})
    now = {i: "\n".join(x for x in ls if not key(x) or often[key(x)] < 10) for i, ls in split.items()}
    sets = {}
    for i, t in now.items():
        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in now}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    now = {i: t for i, t in now.items() if top(i) == i}
    seen, kept = set(), {}
    for i in sorted(now):
        raw = now[i].encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(raw[s : s + 100])
        out, at = [], 0
        for c in now[i]:  # a character goes only if all its bytes go
            size = len(c.encode())
            if not all(gone[at : at + size]):
                out.append(c)
            at += size
        kept[i] = "".join(out)
    check_packing(corpus_pipeline.run(spark, SF).collect(), kept, library)


def test_near_copies_with_repeated_ids(spark):
    """One row of each group stays, texts of one id are told apart, and nothing else goes."""
    make = lambda k: " ".join(random.Random(k).choices([f"w{n}" for n in range(500)], k=60))
    x, y = make(1), make(2)
    rows = [(1, x), (2, x), (2, y), (7, y + " zz"), (8, make(3)), (9, make(4)), (9, make(4)), (None, x), (10, None), (10, ""), (None, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.without_near_copies(spark, docs, SF).collect()
    want = [(1, x), (2, y), (8, make(3)), (9, make(4)), (None, x), (10, None), (10, ""), (None, None)]
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == sorted((str(a), str(b)) for a, b in want)
    kept = corpus_pipeline.without_repeats(spark, docs.where("doc_id in (1, 2)"), SF).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, x), (2, ""), (2, y)]


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == corpus_pipeline.COLUMNS, name
            out.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
            counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[0] >= counts[1] == counts[2] > counts[3] == counts[4]
    assert out.select("doc_id").distinct().count() == counts[4]
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == counts[4]


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, empty texts and an empty table go through every stage."""
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "a b", "en", "s", 3), (2, "", "en", "s", 0), (3, "x " * 400, "en", "s", 800), (3, "x " * 400, "en", "s", 800)], "doc_id long, text string, lang string, source string, n_chars long")
    for rows, least in ((docs, 3), (docs.limit(0), 0)):
        now = rows
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, SF)
            if k < 4:
                path = str(tmp_path / f"{least}-{name}")
                now.write.parquet(path)
                now = spark.read.parquet(path)
        assert now.count() >= least
