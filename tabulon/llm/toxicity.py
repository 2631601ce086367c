"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy, over all overlapping windows.

A word enters as a learned vector of its own, the mean of learned vectors of its character n-grams, and how strongly it and
its n-grams go with the label in the labelled sample. The vectors are rows of two tables of fixed size, taken by hash and
trained with the rest; they begin at zero, so words that training hasn't seen add nothing. The network reads windows of words
in both directions, weighs their states by attention and gives one logit a window; a document's score is that of its highest
window. Training takes a bounded sample of labelled documents (SAMPLE with the label, OTHERS without
it, whole texts of at most SAMPLE_BYTES); inputs of a sampled document come from the other half of the sample, so the network
doesn't learn from words that only that document has. Scoring takes every window of every whole text.

Null or empty text: one window without words. Null doc_id stays null, and is held out as the text "" would be. Null labels
are no labels; with contradicting labels toxic wins. If the sample lacks one of the labels, all scores are 0. Repeated
rows give repeated results; an empty table gives none. Only doc_id and text are read.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator
from contextlib import suppress
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_back, mix, windows8, with_ids

WINDOW, STRIDE = 48, 24
GRAMS = (4, 5)
HIDDEN, ATTENTION = 6, 6
#: Rows and width of the tables of vectors; inputs of a word: its signs and length, and a vector from each table.
SLOTS, WIDTH = 4096, 4
SLOT = np.min_scalar_type(SLOTS - 1)
SIGNS = 5
INPUTS = SIGNS + 2 * WIDTH
#: How much more slowly the tables learn, and how far each step draws them back: they see few documents a row.
TABLE_RATE, DECAY = 0.1, 0.01
SAMPLE, OTHERS, SAMPLE_BYTES = 1200, 2400, 1 << 16
EPOCHS, LEAST_STEPS, BATCH, RATE = 14, 250, 128, 0.02
#: Windows of words without signs that training adds.
UNSIGNED = 60
#: Features with a smaller deviation than this say nothing.
LEAST = 2.5
SLOT_BITS = 18
#: Ranges of hashes that are counted one after the other.
RANGES = 8
FOLDS = 5


def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    inside = np.zeros(256, bool)
    inside[48:58] = inside[97:123] = inside[0x80:] = True
    return lower, inside


_LOWER, _INSIDE = _tables()


@dataclass
class Words:
    """The words of texts on end: hashes of words, and of n-grams with the word each belongs to; ends: words up to each text's end."""

    hashes: np.ndarray
    sizes: np.ndarray
    grams: list[tuple[np.ndarray, np.ndarray]]
    ends: np.ndarray


def words_of(texts: list[str]) -> Words:
    """Words are runs of letters and digits, in lower case. N-grams lie in one word; those at its start are told apart."""
    raw = [x.encode() for x in texts]
    data = _LOWER[np.frombuffer(b" ".join([*raw, b" "]), np.uint8)]
    c3 = np.flatnonzero(data[:-1] == 0xC3)
    upper = c3[(data[c3 + 1] >= 0x80) & (data[c3 + 1] <= 0x9E) & (data[c3 + 1] != 0x97)]
    data[upper + 1] += 0x20  # capital letters of Latin-1
    ends = np.cumsum([len(x) + 1 for x in raw])
    inside = _INSIDE[data].astype(np.int8)
    edges = np.flatnonzero(np.diff(inside, prepend=0, append=0))
    starts, stops = edges[::2], edges[1::2]
    sizes = stops - starts
    loaded = windows8(data, 40)
    h = mix(np.minimum(sizes, 255).astype(np.uint64) + np.uint64(77))
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for k in range(0, 32, 8):
        part = np.flatnonzero(sizes > k) if k else slice(None)
        left = np.minimum(sizes[part] - k, 8).astype(np.uint64)
        h[part] = mix(h[part] ^ (loaded[starts[part] + k] & (full >> ((np.uint64(8) - left) << np.uint64(3)))))
    grams = []
    for n in GRAMS:
        count = np.maximum(sizes - n + 1, 0)
        of = np.repeat(np.arange(len(sizes), dtype=np.int32), count)
        first = np.cumsum(count) - count
        at = np.arange(len(of)) - np.repeat(first - starts, count)
        g = loaded[at] & (full >> np.uint64(64 - 8 * n))
        g[first[count > 0]] |= np.uint64(1) << np.uint64(56)
        grams.append((mix(g + np.uint64(n) * np.uint64(1 << 60)), of))
    return Words(h, sizes, grams, np.searchsorted(starts, ends))


class Signs:
    """Deviations of features by their 64-bit hashes."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        order = np.argsort(np.abs(values), kind="stable")  # the strongest takes a slot that several want
        self.hashes, self.values = hashes[order], values[order].astype(np.float32)
        self.slot = np.full(1 << SLOT_BITS, -1, np.int32)
        self.slot[self.hashes >> np.uint64(64 - SLOT_BITS)] = np.arange(len(hashes), dtype=np.int32)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.float32)
        if len(self.hashes):
            found = self.slot[hashes >> np.uint64(64 - SLOT_BITS)]
            at = np.flatnonzero(found >= 0)
            at = at[self.hashes[found[at]] == hashes[at]]
            out[at] = self.values[found[at]]
        return out

    @classmethod
    def learned(cls, parts: list[np.ndarray], labels: np.ndarray) -> Signs:
        """parts: the distinct features of each document, in order. By how many deviations a feature goes with the label,
        squashed. Ranges of features are counted one after the other, so sorting takes a share of their size."""
        kept, p = [(np.zeros(0, np.uint64), np.zeros(0))], labels.mean() if len(labels) else 0
        for low in range(RANGES):
            edges = np.array([low, low + 1], np.uint64) << np.uint64(64 - RANGES.bit_length() + 1)
            cuts = [(np.searchsorted(x, edges[0]), np.searchsorted(x, edges[1]) if low + 1 < RANGES else len(x)) for x in parts]
            if not sum(z - a for a, z in cuts):
                continue
            hashes, back = np.unique(np.concatenate([x[a:z] for x, (a, z) in zip(parts, cuts)]), return_inverse=True)
            with_label = np.bincount(back, np.repeat(labels, [z - a for a, z in cuts]), len(hashes))
            every = np.bincount(back, minlength=len(hashes))
            z = (with_label - every * p) / np.sqrt(every * p * (1 - p) + 1)
            keep = np.abs(z) >= LEAST
            kept.append((hashes[keep], np.tanh(z[keep] / 8)))
        return cls(*(np.concatenate(x) for x in zip(*kept)))


def signed(words: Words, signs: list[Signs]) -> np.ndarray:
    """A row for each word: of the word, the highest and mean of its shorter n-grams, the highest of its longer, its length."""
    n = len(words.hashes)
    x = np.zeros((n, SIGNS), np.float32)
    x[:, 0] = signs[0].of(words.hashes)
    for k, (g, of) in enumerate(words.grams):
        if len(of):
            v = signs[1 + k].of(g)
            first = np.flatnonzero(np.diff(of, prepend=-1))
            x[of[first], 1 + k] = np.maximum.reduceat(v, first)
            if k == 0:
                x[of[first], 3] = np.add.reduceat(v, first) / np.diff(first, append=len(of))
    x[:, 4] = np.minimum(words.sizes, 20) / 20
    return x


@dataclass
class Inputs:
    """What enters of words on end: signs (a row each), the row of each word's vector, and those of its n-grams, from
    first[i] to first[i + 1]."""

    signs: np.ndarray
    word: np.ndarray
    gram: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, words: Words, signs: list[Signs]) -> Inputs:
        slot = lambda h: (h >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(SLOT)
        g, of = words.grams[0]
        return cls(signed(words, signs), slot(words.hashes), slot(g), np.searchsorted(of, np.arange(len(words.hashes) + 1)))

    @classmethod
    def joined(cls, parts: Iterable[Inputs], words: int, grams: int) -> Inputs:
        """Parts that have at most so many words and n-grams together, each copied as it comes."""
        out = cls(np.empty((words, SIGNS), np.float32), np.empty(words, SLOT), np.empty(grams, SLOT), np.zeros(words + 1, np.int32))
        w = g = 0
        for part in parts:
            w2, g2 = w + len(part), g + len(part.gram)
            out.signs[w:w2], out.word[w:w2], out.gram[g:g2], out.first[w + 1 : w2 + 1] = part.signs, part.word, part.gram, part.first[1:] + g
            w, g = w2, g2
        return cls(out.signs[:w], out.word[:w], out.gram[:g], out.first[: w + 1])

    def __len__(self) -> int:
        return len(self.word)

    def taken(self, at: np.ndarray) -> Inputs:
        """The words at some places."""
        many = self.first[at + 1] - self.first[at]
        first = np.concatenate([[0], np.cumsum(many)])
        return Inputs(self.signs[at], self.word[at], self.gram[np.arange(first[-1]) + np.repeat(self.first[at] - first[:-1], many)], first)

    def unsigned(self) -> Inputs:
        signs = self.signs.copy()
        signs[:, :-1] = 0
        return Inputs(signs, self.word, self.gram, self.first)


def windows(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and number of words of every window, and how many windows each text has; a text without words has one."""
    begins = np.concatenate([[0], ends[:-1]])
    size = ends - begins
    count = 1 + np.maximum(0, -(-(size - WINDOW) // STRIDE))
    of = np.repeat(np.arange(len(ends)), count)
    first = begins[of] + STRIDE * (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))
    return first, np.minimum(WINDOW, ends[of] - first), count


def placed(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words by step and window, and which steps have a word."""
    step = np.arange(WINDOW)[:, None]
    mask = step < size[None, :]
    return np.where(mask, first[None, :] + step, 0), mask


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Two gated recurrent layers, one a direction, attention over their states, and a logit."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        p = {}
        for d in "fb":
            p["w" + d] = r.normal(0, 0.5, (INPUTS, 3 * HIDDEN))
            p["u" + d] = r.normal(0, 0.3, (HIDDEN, 3 * HIDDEN))
            p["c" + d] = np.zeros(3 * HIDDEN)
        p["a"] = r.normal(0, 0.4, (2 * HIDDEN, ATTENTION))
        p["v"] = r.normal(0, 0.4, ATTENTION)
        p["o"] = r.normal(0, 0.4, 2 * HIDDEN)
        p["q"] = np.zeros(1)
        p["words"], p["grams"] = np.zeros((SLOTS, WIDTH)), np.zeros((SLOTS, WIDTH))
        self.p = {k: v.astype(np.float32) for k, v in p.items()}
        self.shift = 0.0

    def embedded(self, x: Inputs) -> np.ndarray:
        """A row for each word."""
        grams = np.zeros((len(x), WIDTH), np.float32)
        many = np.diff(x.first)
        some = np.flatnonzero(many)
        if len(some):
            grams[some] = np.add.reduceat(self.p["grams"][x.gram], x.first[some]) / many[some, None]
        return np.concatenate([x.signs, self.p["words"][x.word], grams], 1)

    def _table_gradients(self, x: Inputs, dx: np.ndarray) -> dict[str, np.ndarray]:
        many = np.diff(x.first)
        each = np.repeat(dx[:, SIGNS + WIDTH :] / np.maximum(many, 1)[:, None], many, axis=0)
        add = lambda slot, by: np.stack([np.bincount(slot, by[:, k], SLOTS) for k in range(WIDTH)], 1).astype(np.float32)
        return {"words": add(x.word, dx[:, SIGNS : SIGNS + WIDTH]), "grams": add(x.gram, each)}

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        w, u, c, n = self.p["w" + d], self.p["u" + d], self.p["c" + d], HIDDEN
        inner = x @ w + c
        h = np.zeros((x.shape[1], n), np.float32)
        out = np.empty((x.shape[0], x.shape[1], n), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            g = h @ u
            zr = _sigmoid(inner[t, :, : 2 * n] + g[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            m = np.tanh(inner[t, :, 2 * n :] + r * g[:, 2 * n :])
            new = h + mask[t] * (1 - z) * (m - h)
            if keep is not None:
                keep.append((t, h, z, r, m, g[:, 2 * n :]))
            h = out[t] = new
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray, tape: dict | None = None) -> np.ndarray:
        kf, kb = ([], []) if tape is not None else (None, None)
        h = np.concatenate([self._run("f", x, mask, kf), self._run("b", x, mask, kb)], 2)
        s = np.tanh(h @ self.p["a"])
        e = s @ self.p["v"] + (mask[:, :, 0] - 1) * 1e4
        e = np.exp(e - e.max(0))
        weight = e / e.sum(0)
        context = (weight[:, :, None] * h).sum(0)
        if tape is not None:
            tape.update(x=x, mask=mask, kf=kf, kb=kb, h=h, s=s, weight=weight, context=context)
        return context @ self.p["o"] + self.p["q"]

    def gradients(self, tape: dict, by: np.ndarray) -> dict[str, np.ndarray]:
        """Of sum(by * logits)."""
        p, n, h, s, weight, x, mask = self.p, HIDDEN, tape["h"], tape["s"], tape["weight"], tape["x"], tape["mask"]
        g = {"q": by.sum(keepdims=True), "o": by @ tape["context"]}
        dc = by[:, None] * p["o"]
        de = (h * dc).sum(2)
        de = weight * (de - (weight * de).sum(0))
        ds = de[:, :, None] * p["v"] * (1 - s * s)
        g["v"] = (de[:, :, None] * s).sum((0, 1))
        g["a"] = np.einsum("tbi,tbj->ij", h, ds, optimize=True)
        dh = weight[:, :, None] * dc + ds @ p["a"].T
        dx = tape["dx"] = np.zeros_like(x)
        for d, part, kept in (("f", dh[:, :, :n], tape["kf"]), ("b", dh[:, :, n:], tape["kb"])):
            u = p["u" + d]
            gw, gu, gc, back = np.zeros_like(p["w" + d]), np.zeros_like(u), np.zeros_like(p["c" + d]), 0
            for t, before, z, r, m, gm in reversed(kept):
                total = part[t] + back
                live = mask[t] * total
                dm = live * (1 - z) * (1 - m * m)
                dz = -live * (m - before) * z * (1 - z)
                dr = dm * gm * r * (1 - r)
                inner = np.concatenate([dz, dr, dm], 1)
                outer = np.concatenate([dz, dr, dm * r], 1)
                gw += x[t].T @ inner
                gu += before.T @ outer
                gc += inner.sum(0)
                dx[t] += inner @ p["w" + d].T
                back = total - mask[t] * (1 - z) * total + outer @ u.T
            g["w" + d], g["u" + d], g["c" + d] = gw, gu, gc
        return g

    def train(self, x: Inputs, first: np.ndarray, size: np.ndarray, count: np.ndarray, labels: np.ndarray, seed: int = 3) -> None:
        """Windows of documents; of a document with the label its highest window counts, of others all, chosen anew each epoch."""
        r = np.random.default_rng(seed)
        begin = np.cumsum(count) - count
        of = np.repeat(np.arange(len(labels)), count)
        level = np.array([x.signs[a : a + b, :3].max() if b else 0 for a, b in zip(first.tolist(), size.tolist())])
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step = 0
        clean = np.flatnonzero(labels[of] == 0)
        epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // (4 * int(labels.sum()))))
        for epoch in range(epochs):
            top = np.array([b + int(np.argmax(level[b : b + c])) for b, c, y in zip(begin.tolist(), count.tolist(), labels.tolist()) if y])
            hard = clean[np.argsort(-level[clean], kind="stable")[: len(top)]]
            chosen = np.concatenate([top, hard, r.choice(clean, min(len(clean), 2 * len(top)), replace=False)])
            y = (labels[of[chosen]] > 0).astype(np.float32)
            for at in np.array_split(r.permutation(len(chosen)), max(1, len(chosen) // BATCH)):
                tape: dict = {}
                places, mask = placed(first[chosen[at]], size[chosen[at]])
                used = x.taken(places[mask])
                rows = np.zeros((*mask.shape, INPUTS), np.float32)
                rows[mask] = self.embedded(used)
                z = self.logits(rows, mask.astype(np.float32)[:, :, None], tape)
                step += 1
                found = self.gradients(tape, ((_sigmoid(z) - y[at]) / len(at)).astype(np.float32))
                for k, v in (found | self._table_gradients(used, tape["dx"][mask])).items():
                    a, b = moment[k]
                    a += 0.1 * (v - a)
                    b += 0.01 * (v * v - b)
                    table = k in ("words", "grams")
                    rate = RATE * (TABLE_RATE if table else 1)
                    kept = self.p[k] * (1 - rate * DECAY) if table else self.p[k]
                    self.p[k] = (kept - rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            if epoch % 3 == 2 or epoch == epochs - 1:
                level = self.scores(x, first, size, 1024)
        best = np.maximum.reduceat(level, begin)
        self.shift = -_between(best, labels)

    def scores(self, x: Inputs, first: np.ndarray, size: np.ndarray, block: int = 4096) -> np.ndarray:
        """The logit of every window; of a block's words the vectors are looked up once."""
        out = []
        for a in range(0, len(first), block):
            places, mask = placed(first[a : a + block], size[a : a + block])
            rows = np.zeros((*mask.shape, INPUTS), np.float32)
            if mask.any():
                low, high = int(places[mask].min()), int(places[mask].max()) + 1
                rows[mask] = self.embedded(x.taken(np.arange(low, high)))[places[mask] - low]
            out.append(self.logits(rows, mask.astype(np.float32)[:, :, None]))
        return np.concatenate(out)


def _between(logits: np.ndarray, labels: np.ndarray) -> float:
    """The cut with the fewest errors, halfway to the next value; of several the middle."""
    order = np.argsort(logits, kind="stable")
    z, y = logits[order], labels[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    best = np.flatnonzero(errors == errors.min())
    k = int(best[len(best) // 2])
    return float(z[0] - 1 if k == 0 else z[-1] + 1 if k == len(z) else (z[k - 1] + z[k]) / 2)


@dataclass
class Model:
    signs: list[Signs]
    network: Network

    def score(self, texts: list[str]) -> np.ndarray:
        words = words_of(texts)
        first, size, count = windows(words.ends)
        z = self.network.scores(Inputs.of(words, self.signs), first, size)
        return _sigmoid(np.maximum.reduceat(z, np.cumsum(count) - count).astype(np.float64) + self.network.shift)


def _give_back() -> None:
    """Free memory goes back to the system: the C library would keep it for as long as the process lives."""
    gc.collect()
    with suppress(OSError, AttributeError):  # not every C library has this
        ctypes.CDLL(None).malloc_trim(0)


def fitted(texts: list[str], labels: np.ndarray) -> Model | None:
    """A model of labelled texts; None if one of the labels is missing. Memory of the driver is small: words are found anew
    for each kind of feature and for the inputs, and never kept for all texts."""
    labels = np.asarray(labels, np.float64)
    if not 0 < labels.sum() < len(labels):
        return None
    half = np.zeros(len(texts), bool)
    for y in (0, 1):
        half[np.flatnonzero(labels == y)[::2]] = True
    final, by_side = [], {True: [], False: []}
    for kind in (lambda w: w.hashes, *(lambda w, k=k: w.grams[k][0] for k in range(len(GRAMS)))):
        parts, sizes, grams = [], [], []
        for x in texts:
            words = words_of([x])
            parts.append(np.unique(kind(words)))
            sizes.append(len(words.hashes))
            grams.append(len(words.grams[0][0]))
        final.append(Signs.learned(parts, labels))
        for side, signs in by_side.items():
            rest = np.flatnonzero(half != side)
            signs.append(Signs.learned([parts[i] for i in rest], labels[rest]))
        del parts
        _give_back()
    # texts that say nothing: words without a sign, and no words at all, are clean
    said = min(sum(sizes), UNSIGNED * WINDOW)
    ahead = 1 + int(np.searchsorted(np.cumsum(sizes), said))  # so many texts have these words
    blank: list[Inputs] = []

    def parts_of() -> Iterator[Inputs]:
        for x, side in zip(texts, half.tolist()):
            yield Inputs.of(words_of([x]), by_side[side])
        few = Inputs.joined((Inputs.of(words_of([x]), final) for x in texts[:ahead]), sum(sizes[:ahead]), sum(grams[:ahead]))
        blank.extend(few.taken(at).unsigned() for at in np.array_split(np.arange(said), UNSIGNED))
        yield from blank

    every = Inputs.joined(parts_of(), sum(sizes) + said, sum(grams) + sum(grams[:ahead]))
    _give_back()
    ends = np.cumsum([*sizes, *(len(part) for part in blank), *[0] * 4])
    network = Network()
    network.train(every, *windows(ends), np.concatenate([labels, np.zeros(UNSIGNED + 4)]))
    return Model(final, network)


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def sampled(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most SAMPLE documents with the label and OTHERS without it, in the order of a hash of their ids, none held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("y"))
    texts = with_ids(docs).where(F.octet_length("text") <= SAMPLE_BYTES)
    present = known.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    ids = None
    for y in (0, 1):
        some = present.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE if y else OTHERS)
        ids = some if ids is None else ids.unionByName(some)
    chosen = ids.collect()  # at most SAMPLE + OTHERS
    spark = docs.sparkSession
    few = spark.createDataFrame([(r["doc_id"], r["y"]) for r in chosen], "doc_id long, y int")
    rows = texts.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], np.array([r["y"] for r in rows])


def trained(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fits a model on the driver."""
    model = fitted(*sampled(docs, labels))
    _give_back()
    return model


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    held = docs.sparkSession.sparkContext.broadcast(trained(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                texts = batch.column(1).slice(at, 64).to_pylist()
                score = model.score(texts) if model else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 64), pa.array(score)], names=["doc_id", "score"])

    out = with_ids(docs).mapInArrow(run, "doc_id long, score double").withColumn("doc_id", id_back())
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score below 0.5, as they are."""
    held = docs.sparkSession.sparkContext.broadcast(trained(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                if model:
                    keep = model.score([x or "" for x in part.column(at).to_pylist()]) < 0.5
                    part = part.filter(pa.array(keep))
                yield part

    return docs.mapInArrow(run, docs.schema)
