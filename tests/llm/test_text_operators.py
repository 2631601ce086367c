"""Line dedup, packing, the codec, media columns, the similarity join and suffix-array dedup against brute force."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulon.llm import audio, graph, jaccard, line_dedup, packing, suffix_dedup, tokens
from tabulon.llm.queries import vocabulary
from tabulon.llm.suffix import suffix_array

WORDS, BYTES, RANKS = "word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def order(doc_id):
    return -(2**63) if doc_id is None else doc_id


def test_line_dedup(docs, rows):
    held = defaultdict(set)
    key = lambda x: x.encode().strip(line_dedup.BLANKS).translate(line_dedup.LOWER).decode()
    for d, t in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(order(d))
    expected = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(key(x)) >= 20 and len(held[key(x)]) >= 3 and order(d) < max(held[key(x)]))]
        expected.append((d, len(lines), len(lines) - len(keep), sha("\n".join(keep).encode())))
    out = line_dedup.keep_bitmaps(docs)
    assert got(out, "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(expected, key=repr)
    assert any(x[2] for x in expected)
    kept = line_dedup.without_dropped(docs)
    assert kept.columns == docs.columns
    assert sorted(sha(r["text"].encode()) for r in kept.collect()) == sorted(x[3] for x in expected)


def test_streams_settle_keys_over_partitions():
    """One key over three partitions, cut anywhere, in batches of any size."""
    import pyarrow as pa

    docs = np.array([9, 9, 8, 7, 7, 5, 4], np.int64)
    for cuts in ((2, 4), (1, 6), (3, 3), (0, 7), (2, 3)):
        for size in (1, 2, 10):
            marks, open_, seen = [], [], set()
            for a, b in zip((0, *cuts), (*cuts, len(docs))):
                part = [(np.array([1]), docs[i : i + 1]) for i in range(a, b)]
                rows = [("x", 0, 0, d[0], 0, i) for i, (_, d) in enumerate(part, a)]
                batches = [pa.RecordBatch.from_arrays([pa.array([0] * len(c), pa.int64()), pa.array([0] * len(c), pa.int64()), pa.array([x[3] for x in c], pa.int64()), pa.array([0] * len(c), pa.int64()), pa.array([x[5] for x in c], pa.int32())], names=["a", "b", "doc_id", "mark", "pos"]) for c in (rows[i : i + size] for i in range(0, len(rows), size))]
                for out in line_dedup._settle(3)(iter(batches)):
                    for r in out.to_pylist():
                        (marks if r["kind"] == line_dedup.DROP else open_ if r["kind"] == line_dedup.OPEN else []).append(r["pos"])
                        if r["kind"] == line_dedup.SUMMARY:
                            seen.add(r["doc_id"])
            late = [p for p in open_ if len(seen) >= 3 and docs[p] < max(seen)]
            assert sorted(marks + late) == [2, 3, 4, 5, 6], (cuts, size)


def test_bitmaps_are_reversible():
    text = "a\nb\n\nc"
    assert line_dedup.apply_bitmap(text, line_dedup.bitmap(4, [1, 2])) == "a\nc"


def test_packing(docs, rows):
    t = tokens.tokenizer_of(vocabulary(BYTES))
    out = packing.pack(docs, vocabulary(BYTES), vocabulary(RANKS), 64).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
    for k, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or k == max(sequences)
    assert sorted(sequences) == list(range(len(sequences)))
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for start, length, crc in pieces[d, len(ids)]:
            if sum(1 for x in rows if x[0] == d) == 1:
                assert zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) == crc
    assert sum(r["length"] for r in out) == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in rows)
    assert packing.padded_length(512) == 512 and packing.padded_length(500) == 1024 and packing.padded_length(1024) == 1024


ALPHABET = st.lists(st.sampled_from(list("ab'sT .\n\t1²é漢  ́ßİſ\x1c-_<|") + ["ing", "<|endoftext|>", "<|startoftext|>", "  "]), max_size=40).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(ALPHABET, max_size=6))
def test_encoders_agree_with_the_library(texts):
    whole = tokens.tokenizer_of(vocabulary(BYTES))
    assert [x.tolist() for x in tokens.ByteEncoder.of(vocabulary(BYTES), vocabulary(RANKS)).encode_all(texts)] == [whole.encode(x, add_special_tokens=False).ids for x in texts]
    whole = tokens.tokenizer_of(vocabulary(WORDS))
    for x, (n, ids, decoded) in zip(texts, tokens.WordCodec.of(vocabulary(WORDS)).encode(texts)):
        e = whole.encode(x, add_special_tokens=False).ids
        assert (n, b" ".join(ids).decode(), b" ".join(decoded).decode()) == (len(e), " ".join(map(str, e)), whole.decode(e, skip_special_tokens=False))


def test_chunks_that_documents_share_are_encoded_once(spark):
    import random

    r = random.Random(8)
    word = lambda: "".join(r.choice(["ba", "ko", "mé", "İx", "漢", "don't", "42", "<|endoftext|>", ""]) for _ in range(r.randint(0, 4)))
    say = lambda k: "".join(word() + r.choice([" ", " ", "\n", "  "]) for _ in range(k))
    common = [say(900) for _ in range(3)]
    texts = [say(r.randint(0, 400)) + r.choice(common)[r.randint(0, 50) :] + say(r.randint(0, 400)) for _ in range(30)]
    texts += [texts[0], texts[0], common[1], say(3000), "x" * 5000, "x" * 5000, "a " * 9000, "a " * 9000, None, ""]
    t = tokens.tokenizer_of(vocabulary(WORDS))
    expected = []
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        expected.append((i, len(ids), " ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert got(tokens.codec(df, vocabulary(WORDS)), "doc_id", "n_tokens", "ids", "decoded") == sorted(expected, key=repr)
    # with every chunk known, only windows are encoded; a wrong neighbour is noticed and the whole text encoded
    words = tokens.WordCodec.of(vocabulary(WORDS))
    whole = [x for x in texts if x]
    data, plans = tokens.chunked(whole)
    made = {k: v for k, v in words.entries({key: data[a:b].decode() for plan in plans for key, a, b in plan}).items() if v}
    assert made and [x[0] for x in words.encode(whole, made)] == [e[1] for e in expected if e[1]]
    wrong = {k: ((n, b"9 " * (n - 1) + b"9", d), *rest) for k, ((n, _, d), *rest) in made.items()}
    assert [b" ".join(x[1]).decode() for x in words.encode(whole, wrong)] == [e[2] for e in expected if e[1]]


def test_codec(docs, rows):
    t = tokens.tokenizer_of(vocabulary(WORDS))
    expected = []
    for d, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        expected.append((d, len(ids), sha(" ".join(map(str, ids)).encode()), sha(t.decode(ids, skip_special_tokens=False).encode())))
    assert got(tokens.codec_digests(docs, vocabulary(WORDS)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected, key=repr)


def test_chunks_are_cut_by_content():
    r = np.random.default_rng(0)
    passage = r.integers(97, 123, 60_000).astype(np.uint8)
    a, b = np.concatenate([r.integers(97, 123, 999).astype(np.uint8), passage]), passage
    cuts = [tokens.chunk_ends(x, np.array([len(x)])) for x in (a, b)]
    inner = {int(x) - 999 for x in cuts[0] if x > 1100}
    assert len(inner) > 20 and inner == {int(x) for x in cuts[1] if x > 101}


def test_media(docs, rows):
    out = audio.media_digests(docs)
    expected = []
    for d, text in rows:
        raw = (text or "").encode()
        payload = audio.payload_of(raw)
        assert audio.read_back(audio.stored(payload)) == payload and len(payload) % 192 == 0 < len(payload)
        expected.append((d, len(raw), len(payload), sha(payload), zlib.crc32(payload[-16:])))
    assert got(out, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == sorted(expected, key=repr)
    same = defaultdict(set)
    for r in out.collect():
        same[r["payload_sha256"], r["n_bytes"]].add((r["media_sha256"], r["feature"]))
    assert all(len(x) == 1 for x in same.values())
    wide = audio.media_columns(docs).where("doc_id = 21").head()
    assert len(wide["tensors"]) == len(wide["starts"]) == len(wide["ends"]) and all(len(x) == 8 * 16 for x in wide["tensors"])
    assert all(a < b for a, b in zip(wide["starts"], wide["ends"]))


def test_media_digests_describe_the_media_columns(spark, docs, monkeypatch):
    """The digests are those of the operator's rows, and equal those of features made by themselves."""
    columns = audio.media_columns
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id in (3, 10, 21)").collect()}
    monkeypatch.setattr(audio, "media_columns", lambda *x: columns(*x).where("doc_id in (3, 10, 21)"))
    out = audio.media_digests(docs).collect()
    assert {r["doc_id"] for r in out} == set(texts) and len(out) == 3
    for r in out:
        media = audio.stored(audio.payload_of((texts[r["doc_id"]] or "").encode()))
        times, tensors = audio.features(media)
        digest = hashlib.sha256(np.round(np.array(times), 6).tobytes() + np.round(tensors, 3).tobytes()).hexdigest()
        assert r["media_sha256"] == sha(media) and r["feature"] == f"spans={len(times)} seconds={sum(b - a for a, b in times):.3f} frames=8x16 sha256={digest}"


def plain_features(samples):
    """Features by their definitions, one output sample, frame and band at a time."""
    x = [s / 128 - 1 for s in samples]
    n = audio.UP * audio.TAPS
    taps = [np.sinc((i - (n - 1) / 2) / max(audio.UP, audio.DOWN)) * (0.5 - 0.5 * np.cos(2 * np.pi * (i + 1) / (n + 1))) for i in range(n)]
    scale = audio.UP / sum(taps)
    y = []
    for k in range(len(x) * audio.UP // audio.DOWN):
        at, phase = divmod(k * audio.DOWN, audio.UP)
        y.append(scale * sum(taps[phase + audio.UP * j] * x[i] for j in range(audio.TAPS) if 0 <= (i := at + audio.TAPS - 1 - j - audio.TAPS // 2) < len(x)))
    y += [0.0] * (audio.FRAME - len(y))
    rate = audio.RATE * audio.UP / audio.DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (mel(rate / 2) * i / (audio.BANDS + 1) / 2595) - 1) for i in range(audio.BANDS + 2)]
    window = [0.5 - 0.5 * np.cos(2 * np.pi * i / (audio.FRAME - 1)) for i in range(audio.FRAME)]
    mels, energy = [], []
    for a in range(0, len(y) - audio.FRAME + 1, audio.HOP):
        frame = y[a : a + audio.FRAME]
        energy.append(sum(v * v for v in frame) / audio.FRAME)
        power = [abs(sum(v * w * np.exp(-2j * np.pi * k * i / audio.FRAME) for i, (v, w) in enumerate(zip(frame, window)))) ** 2 for k in range(audio.FRAME // 2 + 1)]
        line = lambda k: k * rate / audio.FRAME
        mels.append([np.log(1e-6 + sum(p * max(0, min((line(k) - lo) / (mid - lo), (hi - line(k)) / (hi - mid))) for k, p in enumerate(power))) for lo, mid, hi in zip(edges, edges[1:], edges[2:])])
    mean, on, runs = sum(energy) / len(energy), False, []
    for i, e in enumerate(energy):
        was, on = on, e > audio.HIGH * mean or on and not e < audio.LOW * mean
        if on and not was:
            runs.append([i, i])
        if on:
            runs[-1][1] = i + 1
    return np.array(mels), runs or [[0, len(energy)]]


def test_audio_features_by_definition():
    samples = np.frombuffer(audio.payload_of((("loud ~~~~ " * 30 + "    " * 60) * 2 + "\x01\x02 quiet " * 20).encode()), np.uint8)
    mels, energy = audio.log_mel(audio.resampled(samples))
    expected, runs = plain_features(samples.tolist())
    assert mels.shape == expected.shape and np.allclose(mels, expected, atol=2e-3)
    assert [list(x) for x in audio.spans(energy)] == runs and len(runs) > 1
    a, b = runs[0]
    parts = np.linspace(0, b - a, audio.SHAPE[0] + 1).astype(int)
    means = [expected[a:b][min(i, b - a - 1) : max(min(i, b - a - 1) + 1, j)].mean(0) for i, j in zip(parts, parts[1:])]
    assert np.allclose(audio.tensor(mels[a:b]), means, atol=2e-3)


def test_tensors_keep_their_shape(spark, docs, tmp_path):
    audio.media_columns(docs.where("doc_id in (3, 21)")).write.parquet(str(tmp_path / "media"))
    back = spark.read.parquet(str(tmp_path / "media"))
    field = back.schema["tensors"].metadata
    for batch in back.select("tensors", "starts").toArrow().to_batches():
        for t, s in zip(*batch.columns):
            shaped = audio.tensor_array(t.values, field)
            assert shaped.type == pa.fixed_shape_tensor(pa.float32(), audio.SHAPE) and shaped.to_numpy_ndarray().shape == (len(s), *audio.SHAPE)
    long = spark.createDataFrame([(1, "x" * 2_000_000)], "doc_id long, text string")
    assert audio.media_digests(long).head()["payload_bytes"] == 2_000_064


def test_audio_parts():
    tone = (np.sin(np.arange(4000) * 2 * np.pi * 300 / audio.RATE) * 100 + 128).astype(np.uint8)
    x = audio.resampled(tone)
    assert len(x) == 4000 * 2 // 3
    spectrum = np.abs(np.fft.rfft(x[100:2148] * np.hanning(2048)))
    assert abs(spectrum.argmax() * audio.RATE * 2 / 3 / 2048 - 300) < 5
    assert audio.spans(np.array([1, 1, 9, 9, 5, 9, 1, 1.0])) == [(2, 6)]


def sets_of(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def expected_components(rows):
    sets = [(d, sets_of(t)) for d, t in rows]
    up = {d: d for d, _ in rows if d is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[i + 1 :]:
            if a and b and None not in (d, e) and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((top(d), top(e)))
                up[y] = x
    return [(d, len(s), None if d is None else top(d)) for d, s in sets]


def test_similarity_join(docs, rows):
    assert got(jaccard.jaccard_components(docs), "doc_id", "n_shingles", "component_id") == sorted(expected_components(rows), key=repr)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [d for d, _, c in expected_components(rows) if d is None or d == c]
    once = [d for d in ids if d is None] + list({d for d in ids if d is not None})
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(once, key=repr)


def test_similarity_join_of_hot_groups(spark):
    """Chains of near copies, many near copies of one text, and a passage that different documents share."""
    import random

    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(90)]
    rows = [(0, " ".join(base))]
    chain = list(base)
    for i in range(1, 40):
        chain[r.randrange(90)] = word()
        rows.append((i, " ".join(chain)))
    for i in range(40, 120):
        x = list(base)
        x[r.randrange(90)] = word()
        rows.append((i, " ".join(x)))
    common = [word() for _ in range(30)]
    rows += [(i, " ".join(common + [word() for _ in range(40)])) for i in range(120, 160)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard.jaccard_components(df), "doc_id", "n_shingles", "component_id") == sorted(expected_components(rows), key=repr)


def test_similarity_join_of_groups_whose_least_member_is_no_class(spark):
    """Three similar texts share the signatures they keep; the smallest of them links to one only, and the other one has a
    copy with a smaller id, which comes later in its task."""
    w = [f"w{i}" for i in range(11)]
    first, middle, last = w, [*w[:10], "x"], ["y", *w[1:10], "x"]
    rows = [(100, first), (300, middle), (200, last), (50, last)]
    for i in range(20):  # make the ends of first and middle frequent, so that what all three share is kept
        rows.append((1000 + i, [*(first if i % 2 else middle)[6:], *(f"n{i}_{k}" for k in range(14))]))
    rows = [(i, " ".join(x)) for i, x in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    expected = expected_components(rows)
    assert {c for d, _, c in expected if d < 1000} == {50}
    assert got(jaccard.jaccard_components(df), "doc_id", "n_shingles", "component_id") == sorted(expected, key=repr)


@pytest.mark.parametrize("chain", [[0, *range(200, 1, -1)], list(range(150)), [0, *(x for i in range(1, 60) for x in (i, 100 + i))]])
def test_components_of_long_chains(spark, chain):
    """Each id is linked to the next only; in the first, a small id meets a region that has settled on another."""
    links = spark.createDataFrame(list(zip(chain, chain[1:])), "a long, b long").coalesce(1)
    assert {r["id"]: r["component"] for r in graph.components(links).collect()} == dict.fromkeys(chain, 0)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 700), st.integers(0, 10**6), st.floats(0, 0.4), st.floats(0, 1), st.floats(0, 1), st.sampled_from([60, 75, 90]))
def test_similar_sets_share_a_signature(m, seed, changed, own, hot, percent):
    """Whatever the counts of shingles: two sets that are similar share one whose limits allow their sizes, unless what
    they hold alone rules every partner out; and sizes and common shingles never rule such a pair out."""
    r = np.random.default_rng(seed)
    a = np.unique(r.integers(0, 2**63, m).astype(np.uint64))
    b = np.unique(np.concatenate([a[r.random(len(a)) > changed], r.integers(0, 2**63, int(m * changed / 3)).astype(np.uint64)]))
    both = np.intersect1d(a, b)
    if len(b) and 100 * len(both) >= percent * (len(a) + len(b) - len(both)):
        every = np.unique(np.concatenate([a, b]))
        counts = np.where(r.random(len(every)) < hot, r.integers(2, 1000, len(every)), 2)
        counts[~np.isin(every, both) & (r.random(len(every)) < own)] = 1
        found = []
        for x in (a, b):
            c = counts[np.searchsorted(every, x)]
            held = x[c > 1]
            found.append(({int(s): int(u) for s, u, _ in zip(*jaccard.signatures(held, c[c > 1], len(x), percent))}, len(held), len(x)))
        (s, ha, na), (t, hb, nb) = found
        assert any(nb <= s[k] and na <= t[k] for k in s.keys() & t.keys())
        assert min(ha, hb) * (100 + percent) >= (na + nb) * percent


def expected_removals(rows):
    raw = [(order(d), d, (t or "").encode()) for d, t in rows]
    first = {}
    for k, _, b in raw:
        for i in range(len(b) - 49):
            x = b[i : i + 50]
            first[x] = min(first.get(x, k), k)
    out = []
    for k, d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < k:
                gone[i : i + 50] = b"\1" * 50
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_suffix_dedup(docs, rows):
    expected = expected_removals(rows)
    assert any(0 < x[2] < x[1] for x in expected)
    assert got(suffix_dedup.removal_digests(docs), *COLUMNS) == sorted(expected, key=repr)
    kept = suffix_dedup.without_repeats(docs.where("doc_id is not null and doc_id <> 23"))
    assert kept.columns == docs.columns and kept.where("doc_id = 6").head()["text"] == ""


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_of_spliced_texts(spark, seed):
    """Passages around the window's width in different surroundings, with few symbols, so matches overlap and repeat."""
    r = np.random.default_rng(seed)
    pool = ["".join(r.choice(list("ab\0é"), 200)) for _ in range(3)]
    rows = []
    for i in range(60):
        text = ""
        for _ in range(r.integers(1, 5)):
            p = pool[r.integers(3)]
            a = int(r.integers(0, 140))
            text += p[a : a + int(r.integers(30, 70))] + "".join(r.choice(list("cde"), int(r.integers(0, 40))))
        rows.append((i, text))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(suffix_dedup.removal_digests(df), *COLUMNS) == sorted(expected_removals(rows), key=repr)


@pytest.mark.parametrize("hot", [None, 7])
def test_suffix_dedup_of_many_texts_of_one_id(spark, hot):
    """More than 256 texts of one id, each with its own part of a passage that another document has, too."""
    r = np.random.default_rng(3)
    passage = "".join(r.choice(list("abcdefgh"), 400))
    say = lambda n: "".join(r.choice(list("ijklmnop"), int(n)))
    rows = [(3, say(30) + passage)]
    for _ in range(330):
        a = int(r.integers(0, 300))
        rows.append((hot, say(r.integers(1, 60)) + passage[a : a + int(r.integers(45, 100))] + say(r.integers(1, 60))))
    rows.append((9, passage + say(40) + rows[-1][1]))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    assert got(suffix_dedup.removal_digests(df), *COLUMNS) == sorted(expected_removals(rows), key=repr)


def test_suffix_dedup_of_runs_of_nul(spark):
    """Runs of NUL bytes, alone, between other bytes and at the ends of texts; the same with another symbol."""
    texts = ["ab" * 9 + "\0" * 200 + "first", "second" + "\0" * 200 + "cd" * 9, "\0" * 120, "e" * 40 + "\0" * 60, "\0" * 49 + "f", "no zeros here, " * 5]
    rows = list(enumerate(texts + [x.replace("\0", "x") for x in texts]))
    assert expected_removals(rows)[1][2] == 200
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(suffix_dedup.removal_digests(df), *COLUMNS) == sorted(expected_removals(rows), key=repr)


def test_any_hash_makes_an_anchor(monkeypatch):
    """Every window has an anchor, also where its smallest hash is 0."""
    monkeypatch.setattr(suffix_dedup, "mix", lambda x: x & np.uint64(0xFFFFFFFF))
    text, place, *_ = suffix_dedup.anchors([b"abcdefghij" * 12])
    assert all(((place >= i) & (place <= i + suffix_dedup.SIDE)).any() for i in range(120 - 49))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60))
def test_suffix_array(x):
    assert suffix_array(np.array(x, np.int64)) == sorted(range(len(x)), key=lambda i: x[i:])


def test_empty_tables(no_docs):
    for df in (line_dedup.keep_bitmaps(no_docs), packing.pack(no_docs, vocabulary(BYTES), vocabulary(RANKS)), tokens.codec_digests(no_docs, vocabulary(WORDS)), audio.media_digests(no_docs), jaccard.jaccard_components(no_docs), suffix_dedup.removal_digests(no_docs), suffix_dedup.without_repeats(no_docs)):
        assert df.count() == 0
