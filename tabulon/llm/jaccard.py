"""N-gram Jaccard join by PartEnum signatures: the components that all links of the threshold or more make.

Only components come out: pairs that already lie in one component are not compared, so neither all links nor a document's
number of links can be had from here.

1. Shingles go to buckets by their hash, and the number of different sets that hold each is counted. A shingle of one set
   alone counts towards the distance of that set to any other, so it needs no signature; what comes back to a set is the rest
   of it, with counts. A set of m shingles, c of them its own, has no partner above M = (m - c)(100 + p)/p - m shingles, and
   differs from a partner in at most k = (100 - p)(m + M)/(100 + p) - c more; most sets are done here.
2. Size bands (each 100/p times the one before; a set takes part in its own and the next) divide the domain of shingles into
   partitions of CELLS cells. The content of each subset of CELLS - DIFFER cells is a signature, empty ones left out. To lose
   all signatures of a partition with f filled cells takes min(DIFFER + 1, f) differences, so once these sum up to more than
   k over the first partitions, every partner shares one of their signatures: either partner's sum is enough, as the other
   has at least as many partitions or as few as already suffice. Only shingles of at most RARE sets enter, so a signature has
   at most RARE members.
3. Sets whose sum is not enough, as what they hold is mostly common, share subsets of one: in the order by count, the first
   shingle that partners x and y have in common is at most the (m_x - p(m_x + m_y)/(100 + p))-th of x. Each carries the
   largest size of a partner that it can be the first for.
4. Sets that share signatures are compared with the least edited one of their group, one row for each set. Where a group
   then lies in several components, those outside its largest are compared with the rest, as far as sizes, counts and the
   bounds of 3 allow. Pairs are verified on the 64-bit hashes of the shingles. Sets that are equal count as one.

Null or empty text, and text without words: no shingles, no links, a component by itself. Null doc_id: such rows are left
as components of their own with a null component. Rows with equal doc_id are one document if their texts are equal,
else their links are joined. Empty table: no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, id_back, mix, staged, windows8, with_ids
from .graph import components

SHINGLE = 5
#: Cells of a partition, and how many of them may differ; shingles a partition on average in the largest sets of a band.
CELLS, DIFFER, LOAD = 3, 1, 4.0
#: Sets that a shingle of a partition may be in, at most.
RARE = 16
#: Shingles that more sets hold are grouped by Spark's joins, which split them; the rest in buckets.
HOT = 10_000
#: Shingles in a bucket, at least and at most, and buckets between these.
BUCKET, LARGEST, BUCKETS = 2_000_000, 8_000_000, 4096
#: Shingles and texts of a part of the input that are packed together.
NEXT, TEXTS = 1 << 21, 60_000
NO_LIMIT = 2**31 - 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_TURN = np.uint64(0x9FB21C651E98DF25)
_SUBSETS = list(combinations(range(CELLS), CELLS - DIFFER))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The distinct hashes of each text's shingles, sorted. With fewer words than a shingle: one of all words."""
    raw = [x.encode() for x in texts]
    data = _LOWER[np.frombuffer(b" ".join([*raw, b" "]), np.uint8)]
    ends = np.cumsum([len(x) + 1 for x in raw])
    edges = np.flatnonzero(np.diff(_WORD[data].astype(np.int8), prepend=0, append=0))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    loaded = windows8(data, 8)
    h = mix(sizes.astype(np.uint64) + np.uint64(5))
    part, k = np.arange(len(sizes)), 0
    while len(part):
        left = np.minimum(sizes[part] - k, 8).astype(np.uint64)
        h[part] = mix(h[part] ^ (loaded[starts[part] + k] & (_FULL >> ((np.uint64(8) - left) << np.uint64(3)))))
        k += 8
        part = part[sizes[part] > k]
    g = h.copy()
    for j in range(1, SHINGLE):
        g[:-j] = mix(g[:-j] * _TURN + h[j:])  # no xor: equal words would cancel out
    out, at = [], 0
    for end in np.searchsorted(starts, ends).tolist():
        if end - at >= SHINGLE:
            out.append(np.unique(g[at : end - SHINGLE + 1]))
        elif end > at:
            x = np.uint64(end - at)
            for w in h[at:end]:
                x = mix(np.array([x]) * _TURN + w)[0]
            out.append(np.array([x]))
        else:
            out.append(np.zeros(0, np.uint64))
        at = end
    return out


def bands(percent: int, most: int) -> np.ndarray:
    """Least sizes of the bands, up to one above most: partners lie in one band or in neighbouring ones."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, out[-1] * 100 // percent))
    return np.array([*out, max(out[-1] + 1, out[-1] * 100 // percent), 1 << 62])


def largest_partner(m: np.ndarray, held: np.ndarray, percent: int) -> np.ndarray:
    """The size of the largest set that one of m shingles, held of them in other sets too, can be similar to."""
    return np.minimum(100 * m // percent, (100 + percent) * held // percent - m)


def signatures(shingles: np.ndarray, counts: np.ndarray, m: int, percent: int = 75) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of a set of m shingles, given those that other sets hold too and how many sets hold them: the signatures,
    the largest size of a partner each is for, and for subsets of one the shingle's count, else 0."""
    own_only = m - len(shingles)
    most = int(largest_partner(np.int64(m), np.int64(len(shingles)), percent))
    none = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64)
    if 100 * most < percent * m:
        return none
    edges = bands(percent, 100 * m // percent)
    own = int(np.searchsorted(edges, m, side="right")) - 1
    rare = shingles[counts <= RARE]
    found, enough = [], True
    for band in (own, own + 1):
        if band > own and most < edges[band]:
            break
        k = (100 - percent) * (m + min(most, int(edges[band + 1]) - 1)) // (100 + percent) - own_only
        if k < 0:
            continue
        tag = mix(np.array([band + 1], np.uint64))[0]
        n = max(1, int(np.ceil((int(edges[band + 1]) - 1) / LOAD)))
        spread = mix(rare ^ tag)
        cell = ((spread >> np.uint64(32)) * np.uint64(n * CELLS) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        content = np.zeros(n * CELLS, np.uint64)
        filled = np.zeros(n * CELLS, bool)
        if len(first):
            content[cell[first]] = np.add.reduceat(mix(spread[order]), first)
            filled[cell[first]] = True
        content, filled = content.reshape(n, CELLS), filled.reshape(n, CELLS)
        lost = np.cumsum(np.minimum(DIFFER + 1, filled.sum(1)))
        used = min(n, int(np.searchsorted(lost, k, side="right")) + 1)
        enough = enough and bool(lost[-1] > k)
        place = np.arange(used, dtype=np.uint64) * np.uint64(64) + tag
        for i, subset in enumerate(_SUBSETS):
            some = filled[:used, list(subset)].any(1)
            x = place[some] + np.uint64(i)
            for c in subset:
                x = mix(x * _TURN + content[:used, c][some])
            found.append((x, np.full(len(x), NO_LIMIT, np.int32), np.zeros(len(x), np.int64)))
    if not enough:
        order = np.lexsort((mix(shingles), counts))
        limit = (100 * m - (100 + percent) * (own_only + np.arange(len(order)))) // percent
        order = order[100 * limit >= percent * m]
        found.append((mix(shingles[order] ^ _TURN), limit[: len(order)].astype(np.int32), counts[order]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else none  # type: ignore[return-value]


def _planes(x: np.ndarray) -> bytes:
    """Byte by byte, highest bytes together: sorted hashes are alike there and compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _of_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


#: Rows of documents (of each: id, size, key and check of its set) beside packed entries: hashes, local (places in keys)
#: and counts; and beside keys with their sizes, which are all dealt to one bucket a key.
PACKED = "bucket int, doc_id long, n long, key long, check long, hashes binary, local binary, counts binary, keys binary, sizes binary"
_PACKED = pa.schema([("bucket", pa.int32()), *((c, pa.int64()) for c in ("doc_id", "n", "key", "check")), *((c, pa.binary()) for c in ("hashes", "local", "counts", "keys", "sizes"))])


def _array(x, kind: pa.DataType) -> pa.Array:
    return x.cast(kind) if isinstance(x, pa.Array) else pa.array(x, kind)


def _rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch with some columns; the others are null."""
    k = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([_array(columns[f.name], f.type) if f.name in columns else pa.nulls(k, f.type) for f in schema], schema=schema)


def _dealt(schema: pa.Schema, bucket: np.ndarray, hashes: np.ndarray, node: np.ndarray, keys: np.ndarray, counts: np.ndarray | None = None, **more: np.ndarray) -> pa.RecordBatch:
    """Packs entries, sorted by bucket, with the keys that each bucket's refer to, and what else there is of each key."""
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    out: dict[str, list] = {c: [] for c in ("bucket", "hashes", "local", "counts", "keys", *more)}
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(bucket)]):
        used, local = np.unique(node[a:b], return_inverse=True)
        for c, x in (("bucket", int(bucket[a])), ("hashes", _planes(hashes[a:b])), ("local", local.astype(np.uint32 if len(used) > 1 << 16 else np.uint16).tobytes()), ("counts", None if counts is None else counts[a:b].astype(np.uint32).tobytes()), ("keys", keys[used].tobytes()), *((c, x[used].astype(np.int32).tobytes()) for c, x in more.items())):
            out[c].append(x)
    return _rows(schema, **out)


def _gathered(table: pa.Table, *more: str) -> list[np.ndarray]:
    """hashes, keys, counts (zeros, if there are none), and more of each key, of all packed entries."""
    out: list[list] = [[] for _ in range(3 + len(more))]
    for h, l, c, k, *rest in zip(*(table[x].to_pylist() for x in ("hashes", "local", "counts", "keys", *more))):
        x, keys = _of_planes(h), np.frombuffer(k, np.int64)
        local = np.frombuffer(l, np.uint32 if len(keys) > 1 << 16 else np.uint16)
        for to, y in zip(out, (x, keys[local], np.zeros(len(x), np.uint32) if c is None else np.frombuffer(c, np.uint32), *(np.frombuffer(r, np.int32)[local] for r in rest))):
            to.append(y)
    return [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.uint64, np.int64, np.uint32, *(np.int32 for _ in more)))]


def _split(buckets: int, seed: int):
    """The shingles of a part of the documents by bucket; of sets that are equal one, as far as they are remembered."""

    def packed(sets: list[np.ndarray], names: list[int]) -> Iterator[pa.RecordBatch]:
        keys, sizes = np.array(names, np.int64), np.array([len(x) for x in sets])
        to = _bucket(mix(keys.view(np.uint64)), buckets)
        parts = [np.flatnonzero(to == x) for x in np.unique(to)]
        yield _rows(_PACKED, bucket=[int(to[x[0]]) for x in parts], keys=[keys[x].tobytes() for x in parts], sizes=[sizes[x].astype(np.int32).tobytes() for x in parts])
        node = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
        hashes = np.concatenate(sets)
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        yield _dealt(_PACKED, _bucket(hashes, buckets), hashes, node[order], keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, keys, size, seen = [], [], 0, set()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                found = shingle_sets(part.column(1).to_pylist())
                key, check = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes(), seed=seed) for x in found), "<i8").reshape(-1, 2).T
                doc = part.column(0).to_numpy()
                to = _bucket(mix(doc.view(np.uint64)), buckets)
                yield _rows(_PACKED, bucket=to, doc_id=doc, n=[len(x) for x in found], key=key, check=check)
                for d, x, k in zip(doc.tolist(), found, key.tolist()):
                    if not len(x) or d == NO_ID or k in seen:
                        continue
                    if len(seen) < 200_000:
                        seen.add(k)
                    sets.append(x)
                    keys.append(k)
                    size += len(x)
                if size > NEXT or len(sets) > TEXTS:
                    yield from packed(sets, keys)
                    sets, keys, size = [], [], 0
        if sets:
            yield from packed(sets, keys)

    return run


def _counted(buckets: int):
    """Of one bucket of shingles those that several sets hold, with the number of sets, dealt by set."""

    def run(table: pa.Table) -> pa.Table:
        others = table.filter(pc.is_null(table["hashes"]))
        hashes, key, _ = _gathered(table.filter(pc.is_valid(table["hashes"])))
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        same = np.concatenate([[False], hashes[1:] == hashes[:-1], [False]])[: len(hashes) + 1]
        several = same[:-1] | same[1:] if len(hashes) else np.zeros(0, bool)
        hashes, key = hashes[several], key[order[several]]
        order = np.lexsort((key, hashes))
        hashes, key = hashes[order], key[order]
        if len(hashes):
            new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (key[1:] != key[:-1])])  # equal sets of other tasks
            hashes, key = hashes[new], key[new]
            first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            times = np.diff(first, append=len(hashes))
            counts = np.repeat(times, times)
            keep = counts > 1
            hashes, key, counts = hashes[keep], key[keep], counts[keep]
        if not len(hashes):
            return others
        keys, node = np.unique(key, return_inverse=True)
        to = _bucket(mix(key.view(np.uint64)), buckets)
        order = np.lexsort((hashes, to))
        out = _dealt(_PACKED, to[order], hashes[order], node[order], keys, counts[order])
        return pa.concat_tables([others, pa.Table.from_batches([out])])

    return run


#: Rows of documents; of sets (key, n, hashes); of hot signatures (g, key, n, held, limit); packed signatures.
KEYED = "kind int, bucket int, doc_id long, n long, key long, check long, g long, held int, limit int, hashes binary, local binary, counts binary, keys binary, sizes binary, helds binary"
_KEYED = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), *((c, pa.int64()) for c in ("doc_id", "n", "key", "check", "g")), ("held", pa.int32()), ("limit", pa.int32()), *((c, pa.binary()) for c in ("hashes", "local", "counts", "keys", "sizes", "helds"))])
DOC, SET, SIGNED, HOT_SIGNED = range(4)


def _signed(buckets: int, percent: int):
    """What other sets hold too of each set that can have a partner, and its signatures."""

    def run(table: pa.Table) -> pa.Table:
        docs = table.filter(pc.is_valid(table["doc_id"]))
        known = table.filter(pc.is_valid(table["sizes"]))
        names, at = np.unique(np.frombuffer(b"".join(known["keys"].to_pylist()), np.int64), return_index=True)
        size = np.frombuffer(b"".join(known["sizes"].to_pylist()), np.int32)[at].astype(np.int64)
        hashes, key, counts = _gathered(table.filter(pc.is_valid(table["hashes"])))
        out = [_rows(_KEYED, kind=np.full(len(docs), DOC), **{c: docs[c].combine_chunks() for c in ("doc_id", "n", "key", "check")})] if len(docs) else []
        order = np.lexsort((hashes, key))
        hashes, key, counts = hashes[order], key[order], counts[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        held = np.diff(first, append=len(key))
        sizes = size[np.searchsorted(names, key[first])]
        can = 100 * largest_partner(sizes, held, percent) >= percent * sizes
        first, held, sizes = first[can], held[can], sizes[can]
        keys = key[first]
        found = [signatures(hashes[a : a + h], counts[a : a + h], int(m), percent) for a, h, m in zip(first.tolist(), held.tolist(), sizes.tolist())]
        if found:
            out.append(_rows(_KEYED, kind=np.full(len(first), SET), key=keys, n=sizes, held=held, hashes=[hashes[a : a + h].tobytes() for a, h in zip(first.tolist(), held.tolist())]))
            sigs, limit, times = (np.concatenate(x) for x in zip(*found))
            node = np.repeat(np.arange(len(found)), [len(x) for x, _, _ in found])
            hot = times > HOT
            if hot.any():
                at = node[hot]
                out.append(_rows(_KEYED, kind=np.full(len(at), HOT_SIGNED), g=sigs[hot].view(np.int64), key=keys[at], n=sizes[at], held=held[at], limit=limit[hot]))
            sigs, limit, node = sigs[~hot], limit[~hot], node[~hot]
            order = np.argsort(sigs, kind="stable")
            sigs, limit, node = sigs[order], limit[order], node[order]
            if len(sigs):
                batch = _dealt(_KEYED, _bucket(sigs, buckets), sigs, node, keys, limit.view(np.uint32), sizes=sizes, helds=held)
                out.append(batch.set_column(0, _KEYED.field("kind"), pa.array(np.full(batch.num_rows, SIGNED), pa.int32())))
        return pa.Table.from_batches(out, _KEYED)

    return run


GROUPS = "g long, key long, n long, held int, limit int"


def _groups(table: pa.Table) -> pa.Table:
    """Of one bucket of signatures the distinct groups of sets that share one, without members that can have no partner there."""
    sigs, key, limit, size, helds = _gathered(table, "sizes", "helds")
    limit = limit.view(np.int32)
    while True:
        order = np.argsort(sigs, kind="stable")
        sigs, key, size, limit, helds = sigs[order], key[order], size[order], limit[order], helds[order]
        first = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]])) if len(sigs) else np.zeros(0, np.int64)
        times = np.diff(first, append=len(sigs))
        least = np.repeat(np.minimum.reduceat(size, first), times) if len(first) else size
        keep = (limit >= least) & (np.repeat(times, times) > 1)
        if keep.all():
            break
        sigs, key, size, limit, helds = sigs[keep], key[keep], size[keep], limit[keep], helds[keep]
    # one group for all signatures with the same members, or, beyond RARE, with the same least edited member: more is in
    # one group than shares a signature, never less, and limits still hold
    name = np.add.reduceat(mix(key.view(np.uint64)), first) if len(first) else sigs
    edits = size - helds
    order = np.lexsort((key, edits, np.repeat(np.arange(len(first)), times)))
    name = np.repeat(np.where(times > RARE, mix(key[order][first].view(np.uint64)), name), times) if len(first) else sigs
    order = np.lexsort((-limit.astype(np.int64), key, name))
    name, key, size, limit, helds = name[order], key[order], size[order], limit[order], helds[order]
    new = np.concatenate([[True], (name[1:] != name[:-1]) | (key[1:] != key[:-1])])[: len(name)]
    return pa.table([pa.array(name[new].view(np.int64)), pa.array(key[new]), pa.array(size[new].astype(np.int64)), pa.array(helds[new]), pa.array(limit[new])], names=["g", "key", "n", "held", "limit"])


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, s = [], None, np.zeros(0, np.uint64)
            for na, nb, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5)):
                if (raw := x.as_buffer().to_pybytes()) != last:
                    last, s = raw, np.frombuffer(raw, np.uint64)
                both = len(np.intersect1d(s, np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True))
                keep.append(100 * both >= percent * (na + nb - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; joins split hot sets."""
    side = lambda c: sets.select(F.col("key").alias(c), F.col("n").alias("n" + c), F.col("hashes").alias("s" + c))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_verify(percent), "a long, b long")


def _possible(x: str, y: str, percent: int) -> Column:
    """What sizes, common shingles and the limits of signatures allow."""
    c = lambda s, n: F.col(f"{s}.{n}")
    enough = F.least(c(x, "held"), c(y, "held")) * (100 + percent) >= (c(x, "n") + c(y, "n")) * percent
    return (c(x, "key") != c(y, "key")) & (c(x, "n") <= c(y, "limit")) & (c(y, "n") <= c(x, "limit")) & enough


def _pairs(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.select(F.least(f"{x}.key", f"{y}.key").alias("a"), F.greatest(f"{x}.key", f"{y}.key").alias("b")).distinct()


def _keyed(rows: DataFrame, percent: int) -> DataFrame:
    """The rows of KEYED. A key that two different sets have (of 64 bits; told by 64 more) means another seed."""
    size = rows.agg(F.sum(F.octet_length("text") + 1)).head()[0] or 0  # a word has two bytes at least, with what follows
    buckets = max(8, -(-size // 6 // min(LARGEST, max(BUCKET, size // 6 // BUCKETS))))
    for seed in count():
        packed = rows.mapInArrow(_split(buckets, seed), PACKED).groupBy("bucket").applyInArrow(_counted(buckets), PACKED)
        out = staged(packed.groupBy("bucket").applyInArrow(_signed(max(1, buckets // 4), percent), KEYED), "keyed")
        clash = out.where((F.col("kind") == DOC) & (F.col("n") > 0)).groupBy("key").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo <> hi")
        if clash.isEmpty():
            return out
    raise AssertionError


def linked(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id (NO_ID for null), n, component (the least doc_id that links reach; null without links to others) of each row."""
    if not 50 <= percent <= 100:
        raise ValueError("percent lies between 50 and 100")
    keyed = _keyed(with_ids(docs), percent)
    sets = keyed.where(F.col("kind") == SET).select("key", "n", "hashes")
    groups = keyed.where(F.col("kind") == SIGNED).select("bucket", "hashes", "local", "counts", "keys", "sizes", "helds").groupBy("bucket").applyInArrow(_groups, GROUPS)
    groups = groups.unionByName(keyed.where(F.col("kind") == HOT_SIGNED).select("g", "key", "n", "held", "limit"))
    members = staged(groups.groupBy("g", "key").agg(F.max("n").alias("n"), F.max("held").alias("held"), F.max("limit").alias("limit")), "members")
    # each set with one that is the least edited of a group it is in: the fewest shingles of its own
    this = F.struct((F.col("held") - F.col("n")).alias("slack"), "key", "n", "held", "limit")
    centers = members.groupBy("g").agg(F.max(this).alias("y"))
    stars = members.select("g", this.alias("x")).join(centers, "g").where(_possible("x", "y", percent))
    stars = stars.groupBy(F.col("x.key").alias("key")).agg(F.max_by("x", "y").alias("x"), F.max("y").alias("y"))
    met = staged(_pairs(stars, "x", "y"), "met")
    links = staged(_verified(met, sets, percent), "links")
    # groups that still lie in several components: those outside the largest with all others that are possible
    labels = components(links)
    named = members.join(labels.withColumnRenamed("id", "key"), "key", "left").select("g", this.alias("x"), F.coalesce("component", "key").alias("part"))
    parts = named.groupBy("g", "part").agg(F.count("*").alias("many")).groupBy("g").agg(F.max(F.struct("many", "part"))["part"].alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    open_ = staged(named.join(parts, "g"), "open")
    apart = open_.where("part <> main").select("g", "x", "part").join(open_.select("g", F.col("x").alias("y"), F.col("part").alias("other"), "main"), "g")
    apart = apart.where((F.col("part") != F.col("other")) & ((F.col("other") == F.col("main")) | (F.col("x.key") < F.col("y.key"))) & _possible("x", "y", percent))
    rest = staged(_pairs(apart, "x", "y").join(met, ["a", "b"], "left_anti"), "rest")
    links = links.unionByName(_verified(rest, sets, percent))
    # rows of one id whose sets differ are linked through it
    rows = keyed.where(F.col("kind") == DOC).select("doc_id", "n", "key")
    whole = rows.where((F.col("n") > 0) & (F.col("doc_id") != NO_ID)).select("doc_id", "key")
    several = whole.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a <> z").select("doc_id", "a")
    links = links.unionByName(whole.join(several, "doc_id").where("a <> key").select("a", F.col("key").alias("b")))
    labels = components(staged(links, "links"))
    in_ = F.when((F.col("n") > 0) & (F.col("doc_id") != NO_ID), F.coalesce("part", "key"))
    rows = rows.join(labels.select(F.col("id").alias("key"), F.col("component").alias("part")), "key", "left").select("doc_id", "n", in_.alias("part"))
    least = rows.where("part is not null").groupBy("part").agg(F.min("doc_id").alias("component"))
    return rows.join(least, "part", "left").select("doc_id", "n", "component")


def jaccard_components(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) of each row."""
    return linked(docs, percent).select(id_back(), F.col("n").alias("n_shingles"), F.when(F.col("doc_id") != NO_ID, F.coalesce("component", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row of each component, one with its smallest id; rows with null ids stay. Of several rows with one id, whether
    their texts are equal or not, one stays: the one with the least hash, then text."""
    found = staged(linked(docs, percent).where(F.col("doc_id") != NO_ID), "components")
    gone = found.where(F.col("component") != F.col("doc_id")).select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = found.groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = staged(again.join(gone, "doc_id", "left_anti"), "again")
    if again.isEmpty():
        return kept
    one = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    several = kept.join(again, "doc_id", "left_semi").select(*docs.columns).withColumn("_one", one).where("_one = 1").drop("_one")
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(several)
