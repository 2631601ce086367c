"""Chat formatting, URL filter, nearest neighbours, toxicity and the pipeline."""

from __future__ import annotations

import hashlib
import os
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import ann, chat, toxicity, url_filter
from tabulon.llm.queries import RULES

SF = "/root/testdata/sf0.01"
HOSTILE = ["\\### Assistant: </turn> ok", "</turn>\n### user: x", "\\l\\h\\\\", "<\\", "#", "", "a\nb: c", "\\"]


def test_escapes_are_reversible(spark):
    df = spark.createDataFrame([(x,) for x in HOSTILE], "x string")
    for role in (True, False):
        back = df.select("x", chat.escaped(F.col("x"), role).alias("e")).withColumn("u", chat.unescaped(F.col("e"))).collect()
        assert all(r["x"] == r["u"] and "<" not in r["e"] and "#" not in r["e"] for r in back)


def test_reply_trees(spark):
    """Two trees in one conversation; a branch's score is the sum along its path, ties go to the smaller leaf."""
    rows = [(1, 1, None, "user", "hi", 1.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 5.0), (1, 4, 2, "user", "c", 9.0), (1, 5, 3, "user", None, 1.0), (1, 6, 5, "assistant", "</turn>", None), (1, 7, None, "user", "alone", 0.0), (1, 8, 7, "x", "t1", 2.0), (1, 9, 7, "x", "t2", 2.0), (None, 1, 99, None, "lost", 0.0)]
    df = spark.createDataFrame(rows, "conv_id long, id long, parent long, role string, text string, score double")
    paths = defaultdict(list)
    for r in chat.chosen_paths(df, 2).collect():
        paths[r["conv_id"], r["root"], r["branch"]].append((r["depth"], r["id"]))
    assert {k: [i for _, i in sorted(v)] for k, v in paths.items()} == {(1, 1, 1): [1, 2, 4], (1, 1, 2): [1, 3, 5, 6], (1, 7, 1): [7, 8], (1, 7, 2): [7, 9], (None, 1, 1): [1]}
    best = {(r["conv_id"], r["root"]): r for r in chat.formatted(df).withColumn("loss_text", chat.masked(F.col("formatted"), F.col("loss"))).withColumn("back", chat.parsed(F.col("formatted"))).collect()}
    assert [(t["role"], t["text"]) for t in best[1, 1]["back"]] == [("user", "hi"), ("assistant", "a"), ("user", "c")] and best[1, 1]["loss_text"] == "a"


def test_odd_reply_trees(spark):
    """Circles, messages that answer themselves, repeated ids, null texts and a long text."""
    long = "word # </turn> " * 20_000
    rows = [(1, 1, 1, "user", "self", 0.0), (1, 2, 1, "assistant", None, 0.0), (1, 3, 2, None, "c", 1.0)]
    rows += [(2, 1, 3, "user", "a", 1.0), (2, 2, 1, "assistant", "b", 1.0), (2, 3, 2, "user", "c", 1.0), (2, 4, 3, "assistant", long, 1.0), (2, 5, 2, "assistant", "e", 0.0)]
    rows += [(3, 7, None, "user", "b", 0.0), (3, 7, None, "user", "a", 0.0), (3, 7, None, "user", "a", 0.0), (3, 8, 7, "assistant", "x", 0.0), (3, 8, 7, "assistant", "x", 0.0), (3, None, 7, "assistant", "no id", 9.0)]
    df = spark.createDataFrame([(*r, "k", 5) for r in rows], "conv_id long, id long, parent long, role string, text string, score double, up string, c2 int")
    out = chat.formatted(df, 2).withColumn("back", chat.parsed(F.col("formatted")))
    got = sorted((r["conv_id"], r["root"], r["branch"], [(t["role"], t["text"]) for t in r["back"]]) for r in out.collect())
    circle = [("user", "a"), ("assistant", "b")]
    assert got == [
        (1, 1, 1, [("user", "self"), ("assistant", ""), ("", "c")]),
        (2, 1, 1, [*circle, ("user", "c"), ("assistant", long)]),
        (2, 1, 2, [*circle, ("assistant", "e")]),
        (3, 7, 1, [("user", "a"), ("assistant", "x")]),
    ]
    assert chat.formatted(df.limit(0)).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chat_digests(spark):
    rows = [(i, t, role, x) for i, t0 in enumerate(HOSTILE) for t, (role, x) in enumerate([("user", t0), ("assistant", t0), ("sys:tem<", None), ("assistant", "é漢" + t0)])]
    rows += [(50, 0, "user", "same"), (50, 0, "user", "same"), (51, 0, None, None), (None, 3, "assistant", "n"), *((60, t, "assistant" if t % 2 else "user", f"m{t}") for t in range(33))]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, id string, score int")
    by = defaultdict(list)
    for c, t, role, x in rows:
        by[c].append((t, role or "", x or ""))
    expected = {}
    for c, turns in by.items():
        turns.sort()
        learned = "".join(x for _, r, x in turns if r == "assistant")
        expected[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    out = chat.digests(chat.chains(df))
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in out.collect()} == expected
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert chat.digests(chat.chains(df.limit(0))).count() == 0


URLS = [("http://a.example.net/en/x?q#f", "example.net/en/", "allow"), ("https://EXAMPLE.NET/de/", "net/", "block"), ("http://x.net", None, "block"), ("ftp://b.org/fr/1", "org/fr/", "allow"), ("http://notexample.com/de/", None, "allow"), ("http://m.example.com/de/?x", "example.com/de/", "block"), ("http://example.com/den", None, "allow"), (None, None, "allow"), ("no scheme", None, "allow"), ("://", None, "allow"), ("http://h.com?x/fr/", None, "allow"), ("http://org/fr/", "org/fr/", "allow")]


def test_url_rules(spark):
    rows = [(i, u, None, "clash") for i, (u, _, _) in enumerate(URLS)]
    out = url_filter.judged(spark.createDataFrame(rows, "page_id long, url string, html string, rule string"), RULES)
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in out.collect()}
    assert got == {i: (rule, verdict) for i, (_, rule, verdict) in enumerate(URLS)}
    parts = {r["page_id"]: (r["host"], r["path"]) for r in out.collect()}
    assert parts[0] == ("a.example.net", "/en/x") and parts[10] == ("h.com", "") and parts[7] == ("", "") and parts[1] == ("example.net", "/de/")
    assert url_filter.judged(spark.createDataFrame([], "page_id long, url string, html string"), RULES).count() == 0


def test_links_carry_trust_and_distrust(spark):
    """friend.com is linked from a trusted host, spammy.com links to a blocked one, far.com to spammy.com."""
    link = lambda *hosts: "".join(f"<a class=x href='http://{h}/p'>x</a> <a href=\"/local\">l</a>" for h in hosts)
    pages = [(1, "http://good.org/fr/", link("friend.com")), (2, "http://friend.com/a", link("friend.com")), (3, "http://spammy.com/a", link("bad.net", "bad.net")), (4, "http://far.com/", link("SPAMMY.com")), (5, "http://bad.net/", ""), (6, "http://plain.com/", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judged(df, RULES).collect()} == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "allow"}


def test_propagation_matches_power_iteration(spark):
    r = np.random.default_rng(1)
    names = [f"h{i}" for i in range(8)]
    edges = [(names[a], names[b], int(r.integers(1, 5))) for a in range(7) for b in range(8) if a != b and r.random() < 0.4]
    w = np.zeros((8, 8))
    for a, b, n in edges:
        w[int(a[1]), int(b[1])] = n
    out = url_filter.propagated(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame([("trust", "h0"), ("trust", "h3"), ("distrust", "h5")], "way string, host string"), rounds=12, tolerance=0)
    got = {(x["way"], x["host"]): x["score"] for x in out.collect()}
    for way, m, seeds in (("trust", w, [0, 3]), ("distrust", w.T, [5])):
        s = np.zeros(8)
        s[seeds] = 1 / len(seeds)
        x, total = s.copy(), m.sum(1)
        for _ in range(12):
            flow = (x[:, None] * np.divide(m, total[:, None], where=total[:, None] > 0, out=np.zeros_like(m))).sum(0)
            x = 0.85 * flow + s * (0.15 + 0.85 * x[total == 0].sum())
        assert np.allclose([got.get((way, n), 0.0) for n in names], x)


def test_distrust_does_not_depend_on_the_number_of_seeds(spark):
    """A score of one in 1.2 million seeds is small, but hosts two links from a blocked one are reached all the same."""
    edges = spark.createDataFrame([("near.com", "s0.net", 1), ("far.com", "near.com", 1)], "src string, dst string, n long")
    seeds = spark.range(1_200_000).select(F.lit("distrust").alias("way"), F.concat(F.lit("s"), F.col("id"), F.lit(".net")).alias("host"))
    out = url_filter.propagated(edges, seeds).where("host like '%.com'").collect()
    assert sorted(r["host"] for r in out) == ["far.com", "near.com"] and all(r["score"] > 0 for r in out)


def test_distrust_reaches_any_distance(spark):
    pages = [(i, f"http://h{i}.com/", f"<a href='http://{f'h{i - 1}.com' if i else 'bad.net'}/'>x</a>") for i in range(22)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    assert {r["verdict"] for r in url_filter.judged(df, RULES).collect()} == {"block"}


def nearest(vectors, every, k):
    ids = [i for i, v in vectors]
    x = np.array([v for _, v in vectors], np.float64)
    out = {}
    for i, v in vectors:
        if i % every == 0:
            s = x @ np.array(v, np.float64)
            out[i] = [ids[j] for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
    return out


def test_nearest_neighbours(spark):
    r = np.random.default_rng(2)
    centers = r.normal(size=(12, 16))
    vectors = [(i, (centers[i % 12] * 0.8 + r.normal(size=16)).astype(np.float32).tolist()) for i in range(3000)]
    vectors += [(i, vectors[7][1]) for i in range(3000, 4200)]  # a hot vector
    bad = [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [1.0, None] * 8), (5080, [1.0] * 3), (None, [1.0] * 16), (20, vectors[20][1])]
    df = spark.createDataFrame([(i, v, 0, 1.0) for i, v in vectors + bad], "vec_id long, embedding array<float>, label int, score double")
    out = ann.search(df).collect()
    got = defaultdict(list)
    for x in sorted(out, key=lambda x: (x["query_id"], x["rank"])):
        got[x["query_id"]].append((x["vec_id"], x["score"]))
    want = nearest(vectors, 20, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & set(want[q])) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    at = dict(vectors)
    for q, found in got.items():
        assert all(abs(s - float(np.dot(np.array(at[q]), np.array(at[i])))) < 1e-9 for i, s in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("n", [0, 1, 2, 15])
def test_few_vectors(spark, n):
    vectors = [(20 * i, [float(i + 1), 1.0, -float(i)]) for i in range(n)]
    out = ann.search(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))
    got = defaultdict(list)
    for x in sorted(out.collect(), key=lambda x: (x["query_id"], x["rank"])):
        got[x["query_id"]].append(x["vec_id"])
    assert dict(got) == ({} if n < 2 else nearest(vectors, 20, 20))


def test_cells_of_large_tables_are_small():
    """The number of cells grows with the table, so that a query's work per row does not."""
    for n in (100_000, 1_000_000, 15_000_000, 75_000_000):
        cells = ann.Cells(n, 64, 1.0)
        shards = max(ann.LEAST_SHARDS, 2**cells.prefix)
        assert n / shards / 2 ** (cells.m - cells.prefix) <= 2 * ann.CELL and n / shards <= ann.SHARD


def test_nearest_neighbours_in_many_shards(spark, monkeypatch):
    """Shards by projections, one side much fuller than the others, large groups of copies, queries that are far from all else."""
    monkeypatch.setattr(ann, "SHARD", 500)
    monkeypatch.setattr(ann, "CELL", 16)
    r = np.random.default_rng(3)
    x = r.normal(size=(9000, 24)) * r.choice([0.5, 1, 2], (9000, 1))
    x[:3000] += 2
    x[3000:5000] = x[3000]
    x[8980:] = -x[:20] * 1e-3
    x = x.astype(np.float32)
    order = r.permutation(len(x)).tolist()
    vectors = [(i, x[at].tolist()) for i, at in enumerate(order)]
    assert ann.Cells(len(x), 24, 1.0).prefix > 3
    out = ann.search(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), k=10).collect()
    got = defaultdict(list)
    for y in sorted(out, key=lambda y: (y["query_id"], y["rank"])):
        got[y["query_id"]].append((y["vec_id"], y["score"]))
    want = nearest(vectors, 20, 10)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    at = {i: np.array(v) for i, v in vectors}
    for q, found in got.items():
        assert all(abs(s - float(at[q] @ at[i])) < 1e-9 for i, s in found) and found == sorted(found, key=lambda y: (-y[1], y[0]))
    near = lambda q, i, last: float(at[q] @ at[i]) >= last - 1e-9  # noqa: E731 - copies are as good
    hits = sum(near(q, i, float(at[q] @ at[want[q][-1]])) for q, found in got.items() for i, _ in found)
    assert hits >= 0.9 * 10 * len(want)


def test_gradients():
    """The network's gradients against differences, for every parameter."""
    r = np.random.default_rng(0)
    net = toxicity.Network()
    x = r.normal(size=(toxicity.WINDOW, 3, toxicity.INPUTS)).astype(np.float32)
    mask = (np.arange(toxicity.WINDOW)[:, None] < np.array([48, 5, 1])).astype(np.float32)[:, :, None]
    by = np.array([1.0, -0.7, 0.4], np.float32)
    tape = {}
    net.logits(x, mask, tape)
    found = net.gradients(tape, by)
    for k, g in found.items():
        way = r.normal(size=g.shape).astype(np.float32)
        keep, ends = net.p[k], []
        for sign in (1, -1):
            net.p[k] = keep + np.float32(sign * 2e-2) * way
            ends.append(float((by * net.logits(x, mask)).sum()))
        net.p[k] = keep
        assert abs((ends[0] - ends[1]) / 4e-2 - float((g * way).sum())) < 0.05 * max(0.2, abs(float((g * way).sum())))


def test_gradients_of_vectors():
    """Those of the words' and the n-grams' tables against differences; words without n-grams and repeated ones are among them."""
    r = np.random.default_rng(1)
    net = toxicity.Network()
    words = toxicity.words_of(["one thing and another thing or so", "x"])
    x = toxicity.Inputs.of(words, [toxicity.Signs(np.zeros(0, np.uint64), np.zeros(0))] * 3)
    assert len(x) == 8 and x.word[1] == x.word[4] and len(x.gram) == x.first[-1] == 2 + 4 + 2
    for k in ("words", "grams"):
        net.p[k] = r.normal(size=net.p[k].shape).astype(np.float32)
    places, mask = toxicity.placed(np.array([0, 7]), np.array([7, 1]))
    by, used = np.array([1.0, -0.7], np.float32), x.taken(places[mask])

    def logits(tape=None):
        rows = np.zeros((*mask.shape, toxicity.INPUTS), np.float32)
        rows[mask] = net.embedded(used)
        return net.logits(rows, mask.astype(np.float32)[:, :, None], tape)

    tape = {}
    logits(tape)
    net.gradients(tape, by)
    for k, g in net._table_gradients(used, tape["dx"][mask]).items():
        way = r.normal(size=g.shape).astype(np.float32)
        keep, ends = net.p[k], []
        for sign in (1, -1):
            net.p[k] = keep + np.float32(sign * 2e-2) * way
            ends.append(float((by * logits()).sum()))
        net.p[k] = keep
        assert np.abs(g).sum() > 0 and abs((ends[0] - ends[1]) / 4e-2 - float((g * way).sum())) < 0.05 * max(0.2, abs(float((g * way).sum())))


def test_windows_cover_all_words():
    first, size, count = toxicity.windows(np.cumsum([0, 1, 48, 49, 500]))
    assert count.tolist() == [1, 1, 1, 2, 20] and size[0] == 0
    covered = {i for a, n in zip(first[-20:], size[-20:]) for i in range(a, a + n)}
    assert covered == set(range(98, 598))


def _toxic_rows(n):
    r = np.random.default_rng(4)
    words = ["".join(r.choice(["ta", "ri", "no", "sel", "é"], 3)) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        w = list(r.choice(words, int(r.integers(20, 200))))
        if bad := i % 4 == 0:
            for at in r.choice(len(w), max(2, len(w) // 40), replace=False):
                w[at] = r.choice(["vilek", "GRUMBO"]) + r.choice(["", "ta", "no"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = _toxic_rows(900)
    edge = [(10_000, None), (10_001, ""), (None, "vilek"), (10_002, "é " * 30_000), (3, "a second text"), (10_003, " ".join(["ta"] * 9000 + ["vilek", "grumbo", "vilekta"]))]
    docs = spark.createDataFrame([(i, t, "toxic", 1) for i, t in rows + edge], "doc_id long, text string, lang string, score int")
    known = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), (77_777, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.scored(docs, known).collect()
    assert len(out) == len(rows) + len(edge) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out if r["doc_id"] is not None)
    held = [r for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900 and r["doc_id"] != 3]
    right = sum((r["doc_id"] % 4 == 0) == bool(r["predicted"]) for r in held)
    assert len(held) > 100 and right >= 0.97 * len(held)
    assert next(r["predicted"] for r in out if r["doc_id"] == 10_003) == 1  # a window at the very end counts
    kept = toxicity.without_toxic(docs, known)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in out)
    none = toxicity.scored(docs.limit(3), known.where("toxic = 0"))
    assert [r["score"] for r in none.collect()] == [0.0] * 3 and toxicity.scored(docs.limit(0), known).count() == 0


def test_toxicity_training_takes_little_memory(monkeypatch):
    """The driver trains: what it holds at once is a small multiple of the texts, and nothing of it stays but the model."""
    import random
    import tracemalloc

    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    monkeypatch.setattr(toxicity, "LEAST_STEPS", 1)
    r = random.Random(4)
    texts = [" ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 9))) for _ in range(700)) + " vilek" * (i % 3 == 0) for i in range(1200)]
    labels = np.array([i % 3 == 0 for i in range(1200)], np.int64)
    tracemalloc.start()
    try:
        model = toxicity.fitted(texts, labels)
        left, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    size = sum(len(x) for x in texts)
    assert model is not None and most < 15 * size and left < 3 * size


def test_pipeline(spark, tmp_path):
    """Each stage's decisions show in what the last one packs."""
    import corpus_pipeline

    rows, labels = _toxic_rows(300)
    clean = [t for i, t in rows if i % 4]
    passage = " ".join(f"w{i}q" for i in range(60))
    extra = [(1001, clean[0]), (1002, clean[1] + " more"), (1003, f"first words here {passage} " + " ".join(f"a{i}z" for i in range(60))), (1004, " ".join(f"b{i}z" for i in range(60)) + f" {passage} other end"), *((1005 + i, f"own {i} text\nA line that stands in three documents\n{i * 7919}") for i in range(3))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows + extra + [(2000, None), (2001, "")]], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        now.write.parquet(str(tmp_path / f"out-{name}"))
        now = spark.read.parquet(str(tmp_path / f"out-{name}"))
        seen[name] = {r["doc_id"]: r["text"] for r in now.collect()}
        assert all(r["n_chars"] == len(r["text"] or "") for r in now.collect())
    ids = set(seen["toxicity"])
    assert sum(i % 4 == 0 for i in ids if i < 300) <= 2 and sum(i % 4 != 0 for i in ids if i < 300) >= 222
    assert "stands in three" not in seen["line_dedup"][1005] and "stands in three" in seen["line_dedup"][1007]
    assert 1001 not in seen["jaccard_join"] and 1002 not in seen["jaccard_join"] and {1003, 1004, 2000, 2001} <= set(seen["jaccard_join"])
    assert passage in seen["suffix_dedup"][1003] and "w30q" not in seen["suffix_dedup"][1004] and "other end" in seen["suffix_dedup"][1004]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(seen["suffix_dedup"]) and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", ["op1_chat_formatting", "op3_line_dedup", "op6_jaccard_join"])
def test_queries_match_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    import duckdb

    from tabulon.llm import queries

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in cursor.fetchall())
