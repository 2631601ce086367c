"""Suffix-array dedup: removes the bytes of 50-byte strings that also start in a document with a smaller id.

1. Anchors: in every 50-byte window the 16-byte string with the smallest hash. Equal windows have an anchor at the same
   place, so equal strings always meet. An anchor's context, 34 bytes on either side, holds all windows with that anchor.
2. By anchor: where the whole context also stands in a smaller document, all of it is covered. Contexts that share the
   anchor and the nearer half of one side with others, but not all, are left open.
3. Open contexts are fetched from the texts and gathered by anchor and half side. A suffix array of each gathering, made
   by linear grouping (suffix.py), sets equal windows side by side; the smallest document of each run covers the others.
   Before, what a context shares with no other of its gathering is cut off its ends; too short a rest has no such window.
4. The covered spans of a document are joined and cut out.

Entries travel as packed arrays. What one task has several times it sends once (the smallest document); the rest is
settled there. Strings are compared by 64 bits of hash beside the anchor's in step 2, byte by byte in step 3.

Null or empty text, and texts shorter than a window: nothing goes. Null doc_id: smaller than every other. Rows with equal
ids never remove each other's bytes; however many different texts one id has, each has a key of its own. Empty table: no rows. Operators
read doc_id and text; other columns can't clash, and without_repeats gives them back as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import NO_ID, mix, staged, windows8
from .suffix import suffix_array

WIDTH, GRAM = 50, 16
SIDE = WIDTH - GRAM
NEAR_L, NEAR_R = SIDE // 2, SIDE - SIDE // 2 + 1
#: An open context on its left: all of its left side, the anchor and what windows with at least NEAR_L bytes before it reach.
CUT = SIDE + GRAM + SIDE - NEAR_L
ENTRIES, TEXT_BUCKET, FLUSH = 1_000_000, 16 << 20, 1 << 21
SA_CHARS = 200_000
MASK = 0xFFFFFFFFFFFFFFFF
_FULL = np.uint64(MASK)
SEED = np.uint64(0x9FB21C651E98DF25)
COVERED, OPEN = 0, 1
PACKED = "bucket int, kind int, least long, wide boolean, docs binary, pos binary, more binary"
_NAMES = [x.split()[0] for x in PACKED.split(", ")]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]


def _bucket_of(docs: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(docs.astype(np.int64).view(np.uint64)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _packed(bucket: np.ndarray, kind: int, docs: np.ndarray, pos: np.ndarray, more: np.ndarray | None) -> Iterator[tuple]:
    """A row for each bucket; more: a structured array."""
    order = np.argsort(bucket, kind="stable")
    bucket, docs, pos = bucket[order], docs[order], pos[order].astype(np.uint32)
    more = None if more is None else more[order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
    for a, b in zip(first, [*first[1:], len(bucket)]):
        d = docs[a:b]
        least = int(d.min())
        wide = int(d.max()) - least >= 1 << 32
        yield int(bucket[a]), kind, least, wide, (d if wide else (d - least).astype(np.uint32)).tobytes(), pos[a:b].tobytes(), b"" if more is None else more[a:b].tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * len(_TYPES), _TYPES)], names=_NAMES)


def _unpacked(table: pa.Table, dtype: np.dtype | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    docs, pos, more = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], []
    for least, wide, d, p, m in zip(*(table[c].to_pylist() for c in ("least", "wide", "docs", "pos", "more"))):
        docs.append(np.frombuffer(d, np.int64) if wide else np.frombuffer(d, np.uint32).astype(np.int64) + least)
        pos.append(np.frombuffer(p, np.uint32))
        if dtype is not None:
            more.append(np.frombuffer(m, dtype))
    return np.concatenate(docs), np.concatenate(pos).astype(np.int64), (np.concatenate(more) if more else np.zeros(0, dtype)) if dtype is not None else None


def _masked(loaded: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Eight bytes from each place, of which only the first left count."""
    n = np.clip(left, 0, 8).astype(np.uint64)
    keep = np.where(n > 0, _FULL >> ((np.uint64(8) - np.maximum(n, 1)) << np.uint64(3)), np.uint64(0))
    return loaded[np.minimum(at, len(loaded) - 1)] & keep


def anchors(raw: list[bytes]) -> tuple[np.ndarray, ...]:
    """Text, place, hash, hash of the context and 16 bits each of its near left and right (0: too short) of all anchors."""
    raw_len = np.array([len(x) for x in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    n = len(data)
    ends = np.cumsum(raw_len)
    begins = ends - raw_len
    loaded = windows8(data, 64)
    h = mix(loaded[:n] ^ mix(loaded[8 : n + 8] ^ SEED))  # mix keeps 0, which NUL bytes would have
    order = np.maximum((h >> np.uint64(32)).astype(np.uint32), 1)  # 0 is for places where no window starts
    low = order.copy()
    span = 1
    while span < SIDE + 1:  # low: the smallest of SIDE + 1 hashes from each place
        step = min(span, SIDE + 1 - span)
        low[:-step] = np.minimum(low[:-step], low[step:])
        span += step
    for e, size in zip(ends, raw_len):
        low[max(e - min(size, WIDTH - 1), 0) : e] = 0  # no window starts here
    span = 1
    while span < SIDE + 1:  # the largest of those minima that windows over a place have
        step = min(span, SIDE + 1 - span)
        low[step:] = np.maximum(low[step:], low[:-step].copy())
        span += step
    at = np.flatnonzero(low == order)
    text = np.searchsorted(ends, at, "right")
    keep = at + GRAM <= ends[text]
    at, text = at[keep], text[keep]
    left, right = np.minimum(at - begins[text], SIDE), np.minimum(ends[text] - at, WIDTH)
    start, size = at - left, left + right
    c = mix((left * 64 + right).astype(np.uint64))
    for k in range(0, SIDE + WIDTH, 8):
        c = mix(c * np.uint64(0x9FB21C651E98DF25) + _masked(loaded, start + k, size - k))

    def near(begin: np.ndarray, length: int, fits: np.ndarray) -> np.ndarray:
        x = np.zeros(len(begin), np.uint64)
        for k in range(0, length, 8):
            x = mix(x * np.uint64(0x9FB21C651E98DF25) + _masked(loaded, begin + k, np.full(len(begin), length - k)))
        return np.where(fits, x & np.uint64(0xFFFF) | np.uint64(1), np.uint64(0)).astype(np.uint16)

    lh = near(np.maximum(at - NEAR_L, 0), NEAR_L, left >= NEAR_L)
    rh = near(at + GRAM, NEAR_R, right >= GRAM + NEAR_R)
    return text, at - begins[text], h[at], c, lh, rh


ENTRY = np.dtype([("h", "<u4"), ("c", "<u4"), ("l", "<u2"), ("r", "<u2")])
FETCH = np.dtype([("g", "<u8"), ("l", "?"), ("r", "?")])
CONTEXT = np.dtype([("g", "<u8"), ("from", "u1"), ("size", "u1"), ("x", f"S{CUT}")])
SPAN = np.dtype([("n", "<u4")])


def _requests(buckets: int, text_buckets: int, shift: int):
    def flush(parts: list) -> Iterator[pa.RecordBatch]:
        docs, pos, h, c, lh, rh = (np.concatenate(x) for x in zip(*parts))
        key = mix(h ^ mix(c))
        order = np.lexsort((docs, key))
        docs, pos, h, c, lh, rh, key = (x[order] for x in (docs, pos, h, c, lh, rh, key))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        least = docs[np.flatnonzero(new)][np.cumsum(new) - 1]
        settled = (docs >> shift) > (least >> shift)
        # -1 and below: buckets of documents
        rows = list(_packed(-1 - _bucket_of(docs[settled], text_buckets), COVERED, docs[settled], pos[settled], None))
        ask = ~settled
        spread = mix(h[ask])
        more = np.zeros(int(ask.sum()), ENTRY)
        more["h"], more["c"], more["l"], more["r"] = spread.astype(np.uint32), c[ask].astype(np.uint32), lh[ask], rh[ask]
        rows += _packed(((spread >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64), OPEN, docs[ask], pos[ask], more)
        for k in range(0, len(rows), 64):
            yield _batch(rows[k : k + 64])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1)
            at = 0
            while at < batch.num_rows:
                raw, which, total = [], [], 0
                while at < batch.num_rows and total < 1 << 17:
                    x = texts[at].as_buffer().to_pybytes()
                    if len(x) >= WIDTH:
                        raw.append(x)
                        which.append(at)
                        total += len(x)
                    at += 1
                if raw:
                    text, *rest = anchors(raw)
                    held.append((ids[np.array(which)][text], *rest))
                    size += len(text)
                if size > FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _shared(g: np.ndarray, x: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether another context (other: its number) of the same group has the same x; 0 is never shared."""
    order = np.lexsort((other, x, g))
    g, x, other = g[order], x[order], other[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (x[1:] != x[:-1])])
    run = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    several = other[first] != other[np.append(first[1:], len(g)) - 1]
    out = np.zeros(len(g), bool)
    out[order] = several[run] & (x > 0)
    return out


def _compared(text_buckets: int, shift: int):
    """Of one bucket of anchors: what is covered, and what is open; buckets of documents pass."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        if bucket < 0:
            out = table.set_column(0, "bucket", pa.array(np.full(table.num_rows, -1 - bucket, np.int32)))
            return out.select(_NAMES)
        docs, pos, e = _unpacked(table, ENTRY)
        k1 = e["h"].astype(np.uint64) << np.uint64(32) | e["c"]
        k2 = e["l"].astype(np.uint32) << np.uint32(16) | e["r"]
        order = np.lexsort((docs, k2, k1))
        docs, pos, e, k1, k2 = docs[order], pos[order], e[order], k1[order], k2[order]
        new = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
        context = np.cumsum(new) - 1
        least = docs[np.flatnonzero(new)][context]
        covered = (docs >> shift) > (least >> shift)
        rows = list(_packed(_bucket_of(docs[covered], text_buckets), COVERED, docs[covered], pos[covered], None))
        group_new = np.concatenate([[True], e["h"][1:] != e["h"][:-1]])
        group = np.cumsum(group_new) - 1
        first = np.flatnonzero(group_new)
        several = (context[np.append(first[1:], len(docs)) - 1] > context[first]) & (np.minimum.reduceat(docs, first) >> shift < np.maximum.reduceat(docs, first) >> shift)
        rest = np.flatnonzero(several[group] & ~covered)
        if len(rest):
            flags = [_shared(group[rest], e[side][rest].astype(np.int64), context[rest]) for side in "lr"]
            some = flags[0] | flags[1]
            take = rest[some]
            more = np.zeros(len(take), FETCH)
            more["g"], more["l"], more["r"] = e["h"][take].astype(np.uint64) | np.uint64(bucket) << np.uint64(32), flags[0][some], flags[1][some]
            rows += _packed(_bucket_of(docs[take], text_buckets), OPEN, docs[take], pos[take], more)
        return pa.Table.from_batches([_batch(rows)])

    return run


def _by_doc(docs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(docs, kind="stable")
    d = docs[order]
    first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])) if len(d) else np.zeros(0, int)
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(d)]):
        yield int(d[a]), order[a:b]


def _fetched(buckets: int):
    """Of one bucket of documents: the open contexts' bytes, by what they have in common with others."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([_batch([])])
        texts = dict(zip(left["id"].to_pylist(), left["text"]))
        docs, pos, f = _unpacked(right, FETCH)
        out_docs, out_pos, out = [], [], []
        for doc, at in _by_doc(docs):
            raw = texts[doc].as_buffer().to_pybytes()
            for p, g, on_left, on_right in zip(pos[at].tolist(), f["g"][at].tolist(), f["l"][at].tolist(), f["r"][at].tolist()):
                if on_left:  # windows with at least NEAR_L bytes before the anchor
                    a = max(0, p - SIDE)
                    out.append((xxhash.xxh3_64_intdigest(raw[p - NEAR_L : p], 2 * g & MASK), p - a, raw[a : p + GRAM + SIDE - NEAR_L]))
                    out_docs.append(doc)
                    out_pos.append(p)
                if on_right:  # and those with fewer
                    a = max(0, p - NEAR_L + 1)
                    out.append((xxhash.xxh3_64_intdigest(raw[p + GRAM : p + GRAM + NEAR_R], 2 * g + 1 & MASK), p - a, raw[a : p + WIDTH]))
                    out_docs.append(doc)
                    out_pos.append(p)
        more = np.zeros(len(out), CONTEXT)
        if out:
            more["g"], more["from"], x = (list(v) for v in zip(*out))
            more["x"], more["size"] = x, [len(v) for v in x]
        d = np.array(out_docs, np.int64)
        place = ((mix(more["g"].copy()) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        return pa.Table.from_batches([_batch(list(_packed(place, OPEN, d, np.array(out_pos, np.int64), more)))])

    return run


def _runs(strings: list[bytes], least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String, place and smallest document of each window of strings on end, from their suffix array."""
    sizes = np.array([len(x) for x in strings])
    data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes + 1) - 1
    data[ends] = 0
    sa = np.asarray(suffix_array(data))
    of = np.searchsorted(ends, sa)
    fits = sa + WIDTH <= ends[of]
    sa, of = sa[fits], of[fits]
    new = np.zeros(len(sa), bool)
    new[:1] = True
    for k in range(WIDTH):
        x = data[sa + k]
        new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    smallest = np.minimum.reduceat(least[of], first)[np.cumsum(new) - 1] if len(sa) else np.zeros(0, np.int64)
    return of, sa - (ends[of] - sizes[of]), smallest


def _common(symbols: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """How many symbols each row begins with in common with any other of its group; rows have sizes symbols, then zeros."""
    n, width = symbols.shape
    words = np.zeros((n, -(-width // 4) * 4), ">u2")
    words[:, :width] = symbols
    order = np.lexsort((*words.view(">u8").T[::-1], group))
    x, size, g = symbols[order], sizes[order], group[order]
    shared = np.minimum(np.cumprod(x[1:] == x[:-1], axis=1).sum(1), np.minimum(size[1:], size[:-1]))
    shared = np.where(g[1:] == g[:-1], shared, 0)
    out = np.zeros(n, np.int64)
    out[order] = np.maximum(np.append(shared, 0), np.append(0, shared))
    return out


def _trimmed(strings: np.ndarray, before: np.ndarray, sizes: np.ndarray, group: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each string's part begins and ends that it can share: with others of its group, which agree on the anchor.

    What is before the part, or after, no other has there; strings of several documents stay whole."""
    data = np.ascontiguousarray(strings).view(np.uint8).reshape(len(strings), -1).astype(np.uint16) + 1
    k = np.arange(SIDE)
    left = np.where(k < before[:, None], np.take_along_axis(data, np.clip(before[:, None] - 1 - k, 0, CUT - 1), 1), 0)
    after = sizes - before - GRAM
    right = np.where(k < after[:, None], np.take_along_axis(data, np.clip(before[:, None] + GRAM + k, 0, CUT - 1), 1), 0)
    a, b = (np.where(several, n, _common(x.astype(np.uint16), n, group)) for x, n in ((left, before), (right, after)))
    return before - a, before + GRAM + b


def _ordered(text_buckets: int, shift: int):
    """Of one bucket of open contexts: the spans of windows that smaller documents have."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        docs, pos, e = _unpacked(table, CONTEXT)
        # in runs of one symbol equal strings may have their anchors at different places
        order = np.lexsort((docs, e["from"], e["size"], e["x"], e["g"]))
        docs, pos, e = docs[order], pos[order], e[order]
        new = np.concatenate([[True], e["g"][1:] != e["g"][:-1]])
        other = new | np.concatenate([[True], (e["x"][1:] != e["x"][:-1]) | (e["size"][1:] != e["size"][:-1]) | (e["from"][1:] != e["from"][:-1])])
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        mixed = np.minimum.reduceat(docs, first) >> shift < np.maximum.reduceat(docs, first) >> shift
        heads = np.flatnonzero(other & mixed[group])  # the first entry of each distinct string and place, with its smallest document
        stops = np.append(np.flatnonzero(other)[1:], len(docs))[mixed[group[other]]]
        if not len(heads):
            return pa.Table.from_batches([_batch([])])
        many = (docs[stops - 1] >> shift) > (docs[heads] >> shift)
        begin, end = _trimmed(e["x"][heads], e["from"][heads].astype(np.int64), e["size"][heads].astype(np.int64), group[heads], many)
        long = end - begin >= WIDTH
        heads, stops, begin, end = heads[long], stops[long], begin[long], end[long]
        # strings that are equal now are one
        parts: dict[tuple, list[int]] = {}
        for k, (i, x, y) in enumerate(zip(heads.tolist(), begin.tolist(), end.tolist())):
            parts.setdefault((int(group[i]), e["x"][i].ljust(CUT, b"\0")[x:y]), []).append(k)
        count: dict[int, int] = {}
        for g, _ in parts:
            count[g] = count.get(g, 0) + 1
        found_docs, found_pos, found_n = [], [], []

        def cover(k: int, start: np.ndarray, smallest: np.ndarray) -> None:
            """The spans of one string's entries: start, smallest: of its windows and of the documents that have them."""
            base = int(begin[k]) - int(e["from"][heads[k]])
            for i in range(heads[k], stops[k]):
                s = start[(smallest >> shift) < (docs[i] >> shift)]
                if len(s):
                    breaks = np.flatnonzero(np.diff(s) > 1)
                    for x, y in zip(s[np.concatenate([[0], breaks + 1])].tolist(), s[np.append(breaks, len(s) - 1)].tolist()):
                        found_docs.append(docs[i])
                        found_pos.append(pos[i] + base + x)
                        found_n.append(y - x + WIDTH)

        strings, held, size = [], [], 0
        todo = list(parts.items())
        for at, ((g, x), ks) in enumerate(todo):
            least = min(int(docs[heads[k]]) for k in ks)
            if count[g] == 1:  # equal strings need no order
                n = len(x) - WIDTH + 1
                for k in ks:
                    cover(k, np.arange(n), np.full(n, least))
            else:
                strings.append(x)
                held.append((ks, least))
                size += len(x) + 1
            last = at + 1 == len(todo)
            if strings and (last or size >= SA_CHARS and todo[at + 1][0][0] != g):
                of, start, smallest = _runs(strings, np.array([v for _, v in held], np.int64))
                by = np.lexsort((start, of))
                of, start, smallest = of[by], start[by], smallest[by]
                bounds = np.searchsorted(of, np.arange(len(strings) + 1))
                for j, (ks, _) in enumerate(held):
                    for k in ks:
                        cover(k, start[bounds[j] : bounds[j + 1]], smallest[bounds[j] : bounds[j + 1]])
                strings, held, size = [], [], 0
        d = np.array(found_docs, np.int64)
        more = np.zeros(len(d), SPAN)
        more["n"] = found_n
        return pa.Table.from_batches([_batch(list(_packed(_bucket_of(d, text_buckets), OPEN, d, np.array(found_pos, np.int64), more)))])

    return run


def kept(raw: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[bytes, int, int]:
    """What stays, how many bytes go, and in how many runs."""
    n = len(raw)
    depth = np.bincount(np.maximum(starts, 0), minlength=n + 1) - np.bincount(np.minimum(stops, n), minlength=n + 1)
    gone = np.cumsum(depth[: n + 1])[:n] > 0
    edges = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), edges


def _cut(make: Callable, plain: Callable):
    """Of one bucket of documents the results: make of those with spans, from text and what is kept, plain of others."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        spans: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        whole = right.filter(pc.equal(right["kind"], COVERED))
        some = right.filter(pc.equal(right["kind"], OPEN))
        docs, pos, _ = _unpacked(whole)
        d2, p2, n2 = _unpacked(some, SPAN)
        docs, start = np.concatenate([docs, d2]), np.concatenate([pos - SIDE, p2])
        stop = np.concatenate([pos + WIDTH, p2 + n2["n"].astype(np.int64)])
        for doc, at in _by_doc(docs):
            spans[doc] = start[at], stop[at]
        ids, texts = left["id"].to_pylist(), left["text"]
        return [make(*((raw := t.as_buffer().to_pybytes()), *kept(raw, *spans[i]))) if i in spans else plain(t.as_buffer().to_pybytes()) for i, t in zip(ids, texts)]

    return run


def _spans(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The rows with an id that orders documents and a bucket; the packed spans by bucket; the number of buckets."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumns({"id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "text": text})
    marks = rows.select("id", F.xxhash64("text").alias("mark")).distinct()
    twice = marks.groupBy("id").count().where("count > 1")
    shift = 0
    if (many := twice.agg(F.max("count")).head()[0]) is not None:
        shift = (many - 1).bit_length()
        number = F.row_number().over(Window.partitionBy("id").orderBy("mark")) - 1
        told = marks.join(twice.select("id"), "id", "left_semi").withColumn("number", number)
        # ids of any size become small numbers in the same order, with room for the texts of the id that has most
        every = marks.select("id").distinct().repartitionByRange("id").sortWithinPartitions("id")
        at = F.monotonically_increasing_id()  # the partition above 33 bits for the place in it
        small = staged(every.select("id", F.shiftright(at, 33).alias("part"), at.bitwiseAND((1 << 33) - 1).alias("place")), "ids")
        parts, places = (x.bit_length() for x in small.agg(F.max("part"), F.max("place")).head())
        if parts + places + shift > 63:
            raise ValueError("too many ids with too many texts for keys of 63 bits")
        small = small.select("id", F.shiftleft("part", places).bitwiseOR(F.col("place")).alias("small"))
        key = F.shiftleft(F.col("small"), shift) + F.coalesce("number", F.lit(0))
        rows = rows.withColumn("mark", F.xxhash64("text")).join(told, ["id", "mark"], "left").join(small, "id").withColumn("id", key).drop("mark", "number", "small")
    total = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    buckets, text_buckets = max(8, -(-total * 6 // (100 * ENTRIES))), max(8, -(-total // TEXT_BUCKET))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("bucket", pa.array(_bucket_of(batch.column("id").to_numpy(), text_buckets).astype(np.int32)))

    schema = StructType([*rows.schema.fields, StructField("bucket", IntegerType())])
    placed = rows.mapInArrow(numbered, schema)
    asked = rows.select("id", "text").mapInArrow(_requests(buckets, text_buckets, shift), PACKED)
    first = staged(asked.groupBy("bucket").applyInArrow(_compared(text_buckets, shift), PACKED), "anchors")
    open_ = first.where(F.col("kind") == OPEN)
    short = placed.select("id", "text", "bucket")
    contexts = short.groupBy("bucket").cogroup(open_.groupBy("bucket")).applyInArrow(_fetched(buckets), PACKED)
    second = staged(contexts.groupBy("bucket").applyInArrow(_ordered(text_buckets, shift), PACKED), "spans")
    return placed, first.where(F.col("kind") == COVERED).unionByName(second), text_buckets


def removal_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    placed, spans, _ = _spans(docs.select("doc_id", "text"))
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    cut = _cut(lambda raw, rest, n, runs: (len(raw), n, runs, hashlib.sha256(rest).hexdigest()), lambda raw: (len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = zip(*cut(left, right)) if left.num_rows else [()] * 4
        return pa.table([left["doc_id"], *(pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], names=["doc_id", *names])

    out = placed.select("id", "text", F.col("doc_id").cast("long").alias("doc_id"), "bucket").groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents without the covered bytes; what is left of a character that was cut goes, too."""
    columns = docs.columns
    inner = docs.select([F.col(c).alias(c if c in ("doc_id", "text") else f"other_{i}") for i, c in enumerate(columns)])
    placed, spans, _ = _spans(inner)
    cut = _cut(lambda raw, rest, n, runs: rest.decode("utf-8", "ignore"), lambda raw: raw.decode())
    names = inner.columns

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        text = pa.array(cut(left, right) if left.num_rows else [], pa.string())
        return left.select(names).set_column(names.index("text"), "text", text)

    out = placed.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(run, inner.schema)
    return out.toDF(*columns)
