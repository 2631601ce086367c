"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing with exact reranking.

Vectors get one more component, the root of the largest squared norm less their own, and queries, scaled to that norm, a zero
there: the largest inner product is then the smallest distance. A few random projections, made orthogonal, cut the vectors into
cells: each is so wide that a projection falls on one of two sides of its median. There are as many projections as leave about
CELL vectors a cell, so they grow in number with the table. A query visits the cells, its own and perturbed ones, where the
estimated chance of a neighbour is above a limit. Medians are fitted on SAMPLE vectors; how far neighbours' projections lie from
a query's, and the limit, on the true neighbours of PROBED queries, found among all rows: the limit is where TARGET of them are in
visited cells. The first projections and, where one side of them holds many vectors, a hash of the id deal the vectors out to
shards of about SHARD, so a hot cell isn't one task. Every row is in one cell, and no vector of a visited cell is passed over but
copies of one vector beyond those with the k + 1 smallest ids, which can't be found. Products in single precision tell which
vectors may be among the k best; these are ranked by products of the original vectors in double precision.

A query that found fewer vectors than it must return searches all rows, in blocks. Vectors null, zero, with null or
non-finite components, or of another length than most take no part. Ties: smaller vec_id first. Rows with equal vec_id are
one vector (the component-wise smallest). Null vec_id: takes no part. Empty table: no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_staged, mix, staged

CELL, SHARD, LEAST_SHARDS = 256, 1 << 19, 8
SAMPLE, PROBED, TARGET = 4096, 512, 0.915
BLOCK, ASKED, SEED = 8192, 1024, 11
#: Rows of arrays so large that their memory goes back to the system when they do.
ROOM = 1 << 17
#: What a product of vectors of length 1 in single precision may be off.
SLACK = 1e-5


def _binary(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as bytes."""
    offsets = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))])


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """The inverse, for rows of one length."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    if offsets[-1] == offsets[0]:
        return np.zeros((len(column), 0), kind)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(len(column), -1)


def _norms(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    top = np.abs(x).max(1)
    return top * np.sqrt(((x / top[:, None]) ** 2).sum(1))


def usable(vectors: DataFrame, kind: str) -> DataFrame:
    """vec_id long, v binary (components of that kind), n int, norm double: the vectors that take part, but for their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)  # null components become NaN
            starts = np.cumsum(sizes) - sizes
            for n in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero(sizes == n)
                x = flat.reshape(-1, n) if len(at) == len(sizes) else flat[starts[at][:, None] + np.arange(n)]
                fine = np.isfinite(x).all(1) & (x != 0).any(1)
                if fine.any():
                    x, at = x[fine], at[fine]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), _binary(x), pa.array(np.full(len(x), n, np.int32)), pa.array(_norms(x))], names=["vec_id", "v", "n", "norm"])

    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{'float' if kind == '<f4' else 'double'}>").alias("v")).mapInArrow(run, "vec_id long, v binary, n int, norm double")


def _single(rows: DataFrame, kind: str) -> DataFrame:
    """Rows with equal vec_id made one. Only ids are shuffled, and the rows whose id isn't alone."""
    many = staged(rows.groupBy("vec_id").count().where("count > 1").select("vec_id"), "repeated")
    if many.isEmpty():
        return rows

    def least(whole: pa.Table) -> pa.Table:
        x = _matrix(whole["v"].combine_chunks(), kind)
        best = x[np.lexsort(x.T[::-1])[:1]]
        return pa.table([whole["vec_id"][:1], pa.chunked_array([_binary(best)]), whole["n"][:1], pa.array(_norms(best))], names=whole.schema.names)

    merged = rows.join(many, "vec_id", "left_semi").groupBy("vec_id").applyInArrow(least, rows.schema)
    return rows.join(many, "vec_id", "left_anti").unionByName(merged)


class Cells:
    """The hash functions of an index. All lengths are in units of the largest norm."""

    def __init__(self, n: int, dim: int, scale: float):
        self.prefix = int(np.ceil(np.log2(n / SHARD))) if n > 4 * SHARD else 0
        inside = round(np.log2(max(4, n / max(LEAST_SHARDS, 2**self.prefix) / CELL)))
        self.m = min(self.prefix + inside, dim)
        self.prefix = min(self.prefix, self.m)
        r = np.random.default_rng(SEED)
        self.a = np.linalg.qr(r.normal(size=(dim + 1, self.m)))[0].astype(np.float32)
        self.scale, self.dim = scale, dim
        self.middle = self.mean = np.zeros(self.m, np.float32)
        self.slope, self.spread, self.limit, self.floor = 1.0, 1.0, -np.inf, -np.inf
        self.parts = np.ones(2**self.prefix, np.int64)

    def scaled(self, v: np.ndarray) -> np.ndarray:
        return ((v if 1e-30 < self.scale < 1e30 else v.astype(np.float64)) / self.scale).astype(np.float32, copy=False)

    def places(self, x: np.ndarray, rest: bool) -> np.ndarray:
        """Projections of scaled vectors; with the component more, if rest."""
        out = x @ self.a[: self.dim]
        return out + np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", x, x)))[:, None] * self.a[self.dim] if rest else out

    def sides(self, x: np.ndarray) -> np.ndarray:
        return self.places(x, True) >= self.middle

    def fit(self, sample: np.ndarray, n: int) -> None:
        """Medians, and the parts of a shard's vectors, from scaled vectors."""
        places = self.places(sample, True)
        self.middle, self.mean = np.median(places, 0).astype(np.float32), places.mean(0).astype(np.float32)
        found = np.bincount(self.number((places >= self.middle)[:, : self.prefix]), minlength=2**self.prefix)
        self.parts = np.maximum(1, -(-(found * n) // (len(sample) * SHARD)))
        if not self.prefix:
            self.parts[:] = max(LEAST_SHARDS, self.parts[0])

    def fit_chances(self, asked: np.ndarray, near: np.ndarray) -> None:
        """From the places of queries and, row by row, of their true neighbours; then the limit."""
        x, y = (asked - self.mean).ravel().astype(np.float64), (near - self.mean).ravel().astype(np.float64)
        self.slope = float((x * y).sum() / max((x * x).sum(), 1e-30))
        self.spread = float(max(np.sqrt(np.mean((y - self.slope * x) ** 2)), 1e-6))
        below, above = self.chances(asked)
        got = np.where(near >= self.middle, above, below).sum(1)
        self.limit = float(np.quantile(got, 1 - TARGET, method="lower")) - 1e-4

    def chances(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms of the chances that a neighbour's projections lie below and above the medians."""
        at = np.clip((self.mean + self.slope * (places - self.mean) - self.middle) / self.spread, -6, 6).astype(np.float64)
        at = np.round(at * 256).astype(np.int64) + 6 * 256
        return _LOG_PHI[::-1][at], _LOG_PHI[at]

    @staticmethod
    def number(sides: np.ndarray) -> np.ndarray:
        return (sides.astype(np.int64) << np.arange(sides.shape[1])).sum(1) if sides.shape[1] else np.zeros(len(sides), np.int64)

    @staticmethod
    def signs(numbers: np.ndarray, bits: int) -> np.ndarray:
        return ((numbers[:, None] >> np.arange(bits)) & 1).astype(np.float32)


def _log_phi() -> np.ndarray:
    from math import erfc

    return np.log([0.5 * erfc(-x / 256 / np.sqrt(2)) for x in range(-6 * 256, 6 * 256 + 1)])


_LOG_PHI = _log_phi()


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best, by query and rank."""
    order = np.lexsort((ids, -score, q))
    q = q[order]
    first = np.flatnonzero(np.diff(q, prepend=q[0] - 1)) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(first, append=len(q)))
    return order[rank < k]


class Found:
    """The k best of each of some queries among the vectors shown so far."""

    def __init__(self, cells: Cells, ids: np.ndarray, v: np.ndarray, k: int, floor: float | np.ndarray):
        self.ids, self.v, self.k = ids, v.astype(np.float64), k
        self.norms = _norms(v)
        self.x = (self.v / self.norms[:, None]).astype(np.float32)
        self.unit = cells.scale
        self.least = np.full(len(ids), floor - SLACK, np.float32)
        self.held: list[tuple] = []
        self.size = 0
        self.taken = np.empty_like(self.x)
        self.products, self.fits = np.empty(0, np.float32), np.empty(0, bool)

    def show(self, who: np.ndarray | None, ids: np.ndarray, x: np.ndarray, v: np.ndarray) -> None:
        """Vectors, scaled and as they were, to the queries who (None: all)."""
        mine, least = (self.x, self.least) if who is None else (np.take(self.x, who, 0, self.taken[: len(who)], "clip"), self.least[who])
        # whole arrays of their own would cost more than the products
        size = len(ids) * len(mine)
        if size > len(self.products):
            self.products, self.fits = np.empty(size, np.float32), np.empty(size, bool)
        products = np.matmul(x, mine.T, out=self.products[:size].reshape(len(ids), -1))
        at = np.flatnonzero(np.greater_equal(products, least, out=self.fits[:size].reshape(len(ids), -1)))
        if not len(at):
            return
        i, q = np.divmod(at, len(mine))
        q = q if who is None else who[q]
        other = self.ids[q] != ids[i]
        q, i = q[other], i[other]
        for a in range(0, len(q), 65536):
            qa, ia = q[a : a + 65536], i[a : a + 65536]
            self.held.append((qa, ids[ia], (self.v[qa] * v[ia]).sum(1)))
        self.size += len(q)
        if self.size > 1_000_000:
            self.shrink()

    def shrink(self) -> tuple:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, i, s = (np.concatenate(x) for x in zip(*self.held))
        best = _best(q, i, s, self.k)
        q, i, s = q[best], i[best], s[best]
        self.held, self.size = [(q, i, s)], len(q)
        n = np.bincount(q, minlength=len(self.ids))
        full = np.flatnonzero(n >= self.k)
        kth = s[(np.cumsum(n) - 1)[full]] / self.norms[full] / self.unit
        self.least[full] = np.maximum(self.least[full], (kth - SLACK).astype(np.float32))
        return q, i, s

    def batch(self) -> pa.RecordBatch:
        q, i, s = self.shrink()
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(i), pa.array(s)], names=["query_id", "vec_id", "score"])


FOUND = "query_id long, vec_id long, score double"


def _scan(rows: DataFrame, cells: Cells, kind: str, ids: np.ndarray, v: np.ndarray, sample: np.ndarray, k: int) -> DataFrame:
    """Of a few queries and all rows: the k best of each partition. The k-th best of the sample tells what need not be ranked."""
    x = (v.astype(np.float64) / _norms(v)[:, None]).astype(np.float32)
    floor = np.full(len(ids), -np.inf)
    if len(sample) > k:  # one of them may be the query itself
        floor = np.partition(x @ sample.T, -k - 1, axis=1)[:, -k - 1]
    held = rows.sparkSession.sparkContext.broadcast((cells, ids, v, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, ids, v, floor = held.value
        found = Found(cells, ids, v, k, floor)
        for batch in batches:
            y = _matrix(batch.column(1), kind)
            i = batch.column(0).to_numpy()
            for a in range(0, len(y), 1024):
                found.show(None, i[a : a + 1024], cells.scaled(y[a : a + 1024]), y[a : a + 1024])
        yield found.batch()

    return rows.select("vec_id", "v").mapInArrow(run, FOUND)


def _merged(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class _Shard:
    """One shard's vectors by cell."""

    def __init__(self, cells: Cells, prefix: int, held: list[tuple[np.ndarray, np.ndarray]], k: int):
        """Takes the vectors out of held, so that there is hardly more than one copy of them."""
        self.cells, self.prefix, self.k = cells, prefix, k
        ids = np.concatenate([x for x, _ in held])
        pieces = [v[a : a + BLOCK] for _, v in held for a in range(0, len(v), BLOCK)]
        inner = np.concatenate([cells.number(cells.sides(cells.scaled(v))[:, cells.prefix :]) for v in pieces])
        words = np.random.default_rng(SEED).integers(1, 2**63, cells.dim, dtype=np.uint64)
        # -0.0 and 0.0 needn't count as one
        same = np.concatenate([(v.view(f"<u{v.itemsize}") * words).sum(1) for v in pieces])
        del pieces
        order = np.lexsort((ids, same, inner))
        inner, same, ids = inner[order], same[order], ids[order]
        to = np.empty(len(order), np.int64)
        to[order] = np.arange(len(order))
        v = np.empty((len(order), cells.dim), held[0][1].dtype)
        end = len(order)
        while held:
            x = held.pop()[1]
            v[to[end - len(x) : end]] = x
            end -= len(x)
        first = np.flatnonzero(np.concatenate([[True], (inner[1:] != inner[:-1]) | (same[1:] != same[:-1])]))
        lead = np.repeat(first, np.diff(first, append=len(ids)))
        late = np.flatnonzero(np.arange(len(ids)) - lead > k)
        if len(late):
            keep = np.ones(len(ids), bool)
            for a in range(0, len(late), 65536):
                b = late[a : a + 65536]
                keep[b] = (v[b] != v[lead[b]]).any(1)
            inner, ids, v = inner[keep], ids[keep], v[keep]
        self.ids, self.v = ids, v
        self.starts = np.flatnonzero(np.concatenate([[True], inner[1:] != inner[:-1]]))
        self.stops = np.append(self.starts[1:], len(ids))
        self.signs = cells.signs(inner[self.starts], cells.m - cells.prefix)

    def visited(self, ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        cells, p = self.cells, self.cells.prefix
        found = Found(cells, ids, v, self.k, cells.floor)
        below, above = cells.chances(cells.places(found.x, False))
        outer = (self.prefix >> np.arange(p)) & 1 == 1
        base = np.where(outer, above[:, :p], below[:, :p]).sum(1) + below[:, p:].sum(1)
        more = np.ascontiguousarray((above - below)[:, p:].T.astype(np.float32))
        need = (cells.limit - base).astype(np.float32)
        for a0 in range(0, len(self.starts), 512):
            likely = self.signs[a0 : a0 + 512] @ more >= need
            for a, b, mine in zip(self.starts[a0 : a0 + 512].tolist(), self.stops[a0 : a0 + 512].tolist(), likely):
                who = np.flatnonzero(mine)
                if len(who):
                    for at in range(a, b, 512):
                        part = self.v[at : min(b, at + 512)]
                        found.show(who, self.ids[at : at + len(part)], cells.scaled(part), part)
        return found.batch()


def _visit(cells: Cells, kind: str, k: int):
    """Of rows by key (twice a shard's number: its vectors, then, one more: the queries that visit it) each query's k best in a shard."""
    prefixes = np.repeat(np.arange(len(cells.parts)), cells.parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, held, room, full = -1, None, [], None, 0

        def ended() -> Iterator[pa.RecordBatch]:
            nonlocal held, shard, room
            if held and now % 2 == 0:
                shard = room = None  # before the next is made
                shard = (now, _Shard(cells, int(prefixes[now // 2]), held, k))
            elif held and shard and shard[0] == now - 1:
                ids, v = (np.concatenate(x) for x in zip(*held))
                for a in range(0, len(ids), BLOCK):
                    yield shard[1].visited(ids[a : a + BLOCK], v[a : a + BLOCK])
            held = []

        for batch in batches:
            keys, ids, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), kind)
            at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist() if len(keys) else []
            for a, b in zip(at, [*at[1:], len(keys)]):
                if keys[a] != now or (now % 2 and sum(len(x) for x, _ in held) >= BLOCK):
                    yield from ended()
                    now = int(keys[a])
                if now % 2:
                    held.append((ids[a:b].copy(), v[a:b].copy()))
                    continue
                if not held or full + b - a > len(room[0]):
                    room, full = (np.empty(max(ROOM, b - a), np.int64), np.empty((max(ROOM, b - a), v.shape[1]), kind)), 0
                    held.append(())
                room[0][full : full + b - a], room[1][full : full + b - a] = ids[a:b], v[a:b]
                full += b - a
                held[-1] = (room[0][:full], room[1][:full])
        yield from ended()

    return run


def search(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by every its k nearest others found."""
    spark = vectors.sparkSession
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    all_rows = staged(usable(vectors, kind), "vectors")
    size = all_rows.groupBy("n").count().orderBy(F.desc("count"), "n").limit(1).collect()
    dim = size[0]["n"] if size else 0
    rows = _single(all_rows.where(F.col("n") == dim), kind).select("vec_id", "v", "norm")
    about = rows.agg(F.count("*").alias("n"), F.max("norm").alias("norm")).head()
    n = about["n"]
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0)

    def some(of: DataFrame, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        of = of.select("vec_id", "v")
        got = (of.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most) if most else of).collect()
        return np.array([r["vec_id"] for r in got], np.int64), np.frombuffer(b"".join(r["v"] for r in got), kind).reshape(len(got), -1 if got else 0)

    asked_ids, asked_v = some(queries, PROBED)
    if n < 2 or not len(asked_ids):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    cells = Cells(n, dim, about["norm"])
    sample = cells.scaled(some(rows, SAMPLE)[1])
    cells.fit(sample, n)

    # the true neighbours of a few queries, twice as many as asked for
    probed = staged(_merged(_scan(rows, cells, kind, asked_ids, asked_v, sample, 2 * k), 2 * k), "probed")
    near = rows.select("vec_id", "v").join(F.broadcast(probed), "vec_id").select("query_id", "rank", "score", "v").collect()
    places = cells.places((asked_v.astype(np.float64) / _norms(asked_v)[:, None]).astype(np.float32), False)
    where = {x: i for i, x in enumerate(asked_ids.tolist())}
    best = [r for r in near if r["rank"] <= k]
    theirs = cells.places(cells.scaled(np.frombuffer(b"".join(r["v"] for r in best), kind).reshape(len(best), -1)), True)
    cells.fit_chances(places[[where[r["query_id"]] for r in best]], theirs)
    if n > 2 * k:  # below the least of these scores few queries have one of their k best
        norms = _norms(asked_v)
        cells.floor = min(r["score"] / norms[where[r["query_id"]]] / cells.scale for r in near if r["rank"] == 2 * k)

    p, first, shards = cells.prefix, np.cumsum(cells.parts) - cells.parts, int(cells.parts.sum())
    dealt = "key int, vec_id long, v binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, ids = _matrix(batch.column(1), kind), batch.column(0).to_numpy()
            at = cells.number(cells.sides(cells.scaled(v))[:, :p])
            part = (mix(ids.astype(np.uint64)) % cells.parts[at].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((2 * (first[at] + part)).astype(np.int32)), *batch.columns], names=["key", "vec_id", "v"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outer = cells.signs(np.arange(2**p), p) == 1
        for batch in batches:
            v = _matrix(batch.column(1), kind)
            below, above = cells.chances(cells.places((v.astype(np.float64) / _norms(v)[:, None]).astype(np.float32), False))
            rest = np.maximum(below, above)[:, p:].sum(1)
            for prefix, sides in enumerate(outer):
                who = pa.array(np.flatnonzero(np.where(sides, above[:, :p], below[:, :p]).sum(1) + rest >= cells.limit - 1e-3))
                mine = batch.take(who) if len(who) else None
                for part in range(cells.parts[prefix] if mine else 0):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), 2 * (first[prefix] + part) + 1, np.int32)), *mine.columns], names=["key", "vec_id", "v"])

    whole = rows.select("vec_id", "v").mapInArrow(deal, dealt).unionByName(queries.select("vec_id", "v").mapInArrow(ask, dealt))
    by_shard = whole.repartition(3 * shards, F.expr("key div 2")).sortWithinPartitions("key")
    best = staged(_merged(by_shard.mapInArrow(_visit(cells, kind, k), FOUND), k), "nearest")
    enough = best.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, n - 1))
    short = staged(queries.join(enough.select("query_id"), queries["vec_id"] == enough["query_id"], "left_anti").select("vec_id", "v"), "short")
    left = short.count()
    if left:
        blocks, rest = -(-left // ASKED), []
        for block in range(blocks):
            ids, v = some(short.where(F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(blocks)) == block))
            if len(ids):
                rest.append(staged(_merged(_scan(rows, cells, kind, ids, v, sample, k), k), "rest"))
        best = best.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").select("query_id", "rank", "vec_id", "score")
        for found in rest:
            best = best.unionByName(found)
    for done in (all_rows, probed):
        drop_staged(done)
    return best
