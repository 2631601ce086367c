"""BPE encoding and decoding with public vocabularies, and reuse of what was encoded before.

Texts are cut into content-defined chunks. Those that occur twice or more often in the corpus are encoded once and joined to
the blocks of documents that hold them; other chunks are encoded where they stand. Which may be shared is told by a Bloom
filter of fixed size; where it errs, a chunk is sent for counting in vain, with the same result. A worker also keeps encoded
units (what stands between blanks) in a cache of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_back, mix, staged, windows8, with_ids

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The split pattern of the byte vocabulary.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of a worker's caches, and the longest text kept in them.
CACHED_UNITS, LONGEST_UNIT = 300_000, 48
#: Bits of the filter that tells which chunks may be shared, and characters of a block of documents with such chunks.
FILTER_BITS, BLOCK_CHARS = 1 << 26, 2 << 20
_held: dict = {}


def tokenizer_of(path: str):
    """A tokenizers.Tokenizer without truncation and padding; a worker loads each file once."""
    if path not in _held:
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        _held[path] = found
    return _held[path]


#: Classes of bytes for the split of the byte vocabulary. Bytes of odd characters send their text to the library.
_SPACE, _LETTER, _DIGIT, _OTHER, _END = range(5)


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """The class of each byte, and whether it may belong to a character outside of what these classes tell apart."""
    kinds, odd = np.full(256, _OTHER, np.uint8), np.zeros(256, bool)
    kinds[[9, 10, 11, 12, 13, 32]] = _SPACE
    kinds[48:58] = _DIGIT
    kinds[65:91] = kinds[97:123] = kinds[0x80:0x100] = _LETTER
    odd[0xC6:] = True  # beyond U+017F
    return kinds, odd


class ByteEncoder:
    """The ids of the tokenizers library for a byte-level vocabulary.

    Texts are split as the vocabulary's pattern does, on whole batches of bytes; each distinct piece is encoded once and
    kept in a table of bounded size by a 64-bit hash of its bytes and length. Texts with characters that the byte classes can't tell apart,
    with contractions or with long pieces go to the tiktoken library, texts with special tokens to the tokenizers library."""

    SLOTS = 20
    LONGEST = 32

    def __init__(self, tokenizer: str, ranks: str):
        import tiktoken

        with open(ranks, "rb") as f:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.path = tokenizer
        library = tiktoken.Encoding("plain", pat_str=BYTE_PATTERN, mergeable_ranks=known, special_tokens={})
        self.plain, self.piece, self.ranks = library.encode_ordinary, library._core_bpe.encode_single_piece, known
        with open(tokenizer, encoding="utf-8") as f:
            self.special = [x["content"] for x in json.load(f)["added_tokens"]]
        top = max(tokenizer_of(tokenizer).get_vocab_size(), len(known))
        self.dtype = np.dtype("<u2" if top <= 1 << 16 else "<u4")
        self.width = self.dtype.itemsize
        # what sends a text to a library: a contraction, \x1c-\x1f, no-break blanks and other odd characters of U+0080 to U+00FF
        self.odd = re.compile(rb"'[strvmld]|[\x1c-\x1f]|\xc2[\x85\xa0\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe]|\xc3[\x97\xb7]|[\xc6-\xff]").search
        self.kinds, _ = _byte_classes()
        self._clear()

    def _clear(self) -> None:
        self.keys, self.values = np.zeros(1 << self.SLOTS, np.uint64), np.zeros(1 << self.SLOTS, np.int32)
        self.entries: dict[int, int] = {}
        self.pool, self.used = np.zeros(1 << 20, self.dtype), 0
        self.at, self.n = np.zeros(CACHED_UNITS + 1, np.int64), np.zeros(CACHED_UNITS + 1, np.int64)

    @classmethod
    def of(cls, tokenizer: str, ranks: str) -> ByteEncoder:
        if (tokenizer, ranks) not in _held:
            _held[tokenizer, ranks] = cls(tokenizer, ranks)
        return _held[tokenizer, ranks]

    def _library(self, text: str) -> np.ndarray:
        if any(x in text for x in self.special):
            return np.array(tokenizer_of(self.path).encode(text, add_special_tokens=False).ids, self.dtype)
        return np.array(self.plain(text), self.dtype)

    def _starts(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where pieces start in texts on end, each followed by one byte that belongs to none; that byte starts one, too."""
        kind = self.kinds[data]
        # of the two-byte characters only those of U+0080 to U+00BF aren't letters
        at = np.flatnonzero(data == 0xC2)
        kind[at] = kind[at + 1] = _OTHER
        kind[ends] = _END
        blank = data == 32
        start = np.ones(len(data), bool)
        start[1:] = kind[1:] != kind[:-1]
        space = kind == _SPACE
        shown = ~space & (kind != _END)
        last = np.zeros(len(data), bool)
        last[:-1] = space[:-1] & shown[1:]  # the last of a run of white space before a visible character
        start |= last
        start[1:] &= ~(last[:-1] & blank[:-1])  # a blank belongs to what follows
        start[ends] = True
        return np.flatnonzero(start)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list = [None] * len(texts)
        raw, where = [], []
        for i, x in enumerate(texts):
            b = x.encode()
            if self.odd(b) or any(s in x for s in self.special):
                out[i] = self._library(x)
            else:
                raw.append(b)
                where.append(i)
        if not raw:
            return out
        joined = b"\0".join(raw) + b"\0"
        data = np.frombuffer(joined, np.uint8)
        ends = np.cumsum([len(x) + 1 for x in raw]) - 1
        starts = self._starts(data, ends)
        size = np.diff(starts, append=len(data))
        real = np.ones(len(starts), bool)
        real[np.searchsorted(starts, ends)] = False
        starts, size = starts[real], size[real]
        long = np.flatnonzero(size > self.LONGEST)
        words = windows8(data, self.LONGEST)
        h = mix(size.astype(np.uint64))
        for k in range(0, self.LONGEST, 8):
            part = np.flatnonzero(size > k) if k else slice(None)
            left = np.minimum(size[part] - k, 8).astype(np.uint64)
            x = words[starts[part] + k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((np.uint64(8) - left) << np.uint64(3)))
            h[part] = mix(h[part] ^ x)
        h[long] = 0
        slot = h >> np.uint64(64 - self.SLOTS)
        entry = self.values[slot]
        missed = np.flatnonzero((self.keys[slot] != h) & (size <= self.LONGEST))
        if len(missed):
            entry[missed] = self._missed(joined, starts[missed], size[missed], h[missed])
        n = self.n[entry]
        first = self.at[entry]
        extra = {}
        for i in long.tolist():
            extra[i] = np.array(self._piece(joined[starts[i] : starts[i] + size[i]]), self.dtype)
            n[i] = 0
        place = np.cumsum(n) - n
        ids = self.pool[np.repeat(first - place, n) + np.arange(int(n.sum()))]
        if extra:
            at = sorted(extra)
            ids = np.insert(ids, np.repeat(place[at], [len(extra[i]) for i in at]), np.concatenate([extra[i] for i in at]))
            for i in at:
                n[i] = len(extra[i])
        total = np.concatenate([[0], np.cumsum(n)])
        bounds = total[np.searchsorted(starts, ends)]
        for i, a, b in zip(where, np.concatenate([[0], bounds[:-1]]).tolist(), bounds.tolist()):
            out[i] = ids[a:b]
        return out

    def _piece(self, raw: bytes) -> list[int]:
        return [known] if (known := self.ranks.get(raw)) is not None else self.piece(raw)

    def _missed(self, joined: bytes, starts: np.ndarray, size: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Entries of pieces that their slots don't hold; they hold them then."""
        distinct, at, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.entries) + len(distinct) > CACHED_UNITS:
            self._clear()
        entries, found, lists, sizes = self.entries, [], [], []
        k = len(entries)
        for key, a, b in zip(distinct.tolist(), starts[at].tolist(), size[at].tolist()):
            if (e := entries.get(key)) is None:
                ids = self._piece(joined[a : a + b])
                lists += ids
                sizes.append(len(ids))
                e = k
                k += 1
                entries[key] = e
            found.append(e)
        if sizes:
            room = max(CACHED_UNITS + 1, k)
            if k > len(self.n):  # one batch may bring more
                self.at, self.n = np.resize(self.at, room), np.resize(self.n, room)
            while self.used + len(lists) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used : self.used + len(lists)] = lists
            lengths = np.array(sizes)
            self.n[k - len(sizes) : k] = lengths
            self.at[k - len(sizes) : k] = self.used + np.cumsum(lengths) - lengths
            self.used += len(lists)
        found = np.array(found, np.int32)
        slot = distinct >> np.uint64(64 - self.SLOTS)
        self.keys[slot], self.values[slot] = distinct, found
        return found[back]


def chunk_ends(data: np.ndarray, ends: np.ndarray, bits: int = 10, width: int = 16) -> np.ndarray:
    """Where chunks end: at each text's end, and after each width bytes whose rolling hash has that many leading zeros.

    data: the texts' bytes on end; ends: where each text ends. The polynomial hash is made by doubling its width. A cut
    depends on the bytes before it alone, so equal passages get equal chunks wherever they stand."""
    if len(data) < width:
        return ends
    h, factor = data.astype(np.uint32), np.uint32(0x01000193)
    for _ in range(width.bit_length() - 1):
        step = len(data) - len(h) + 1
        h = h[: len(h) - step] * factor + h[step:]
        factor = np.uint32((int(factor) ** 2) & 0xFFFFFFFF)
    h *= np.uint32(0x9E3779B1)
    at = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + width
    at = at[at < len(data)]
    starts = np.concatenate([[0], ends[:-1]])
    at = at[(at - starts[np.searchsorted(ends, at, "right")]) >= width]  # the window lies in one text
    at = at[(data[at] & 0xC0) != 0x80]  # not within a character
    return np.unique(np.concatenate([at, ends]))


def chunked(texts: list[str]) -> tuple[bytes, list[list[tuple[bytes, int, int]]]]:
    """The texts' bytes on end, and for each text its chunks: a 128-bit digest, start and end."""
    raw = [x.encode() for x in texts]
    ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
    data = b"".join(raw)
    cuts = chunk_ends(np.frombuffer(data, np.uint8), ends).tolist()
    out, at, k = [], 0, 0
    for end in ends.tolist():
        found = []
        while at < end:
            found.append((hashlib.blake2b(data[at : cuts[k]], digest_size=16).digest(), at, cuts[k]))
            at, k = cuts[k], k + 1
        out.append(found)
        while k < len(cuts) and cuts[k] <= end:
            k += 1
    return data, out


class WordCodec:
    """Encodes and decodes with a vocabulary that drops white space between words.

    A chunk is encoded once: its whole units, those between its first and its last blank or newline. A join of two chunks
    is encoded again as one window, from the last whole unit before it to the first one after it, and over chunks without
    a whole unit. The window's ids must begin and end with those that the chunks have for these two units; if they don't
    agree, the window grows to the whole text."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer_of(path)
        self.names = {v: k for k, v in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self._prepare(path)
        self.units: dict[str, tuple[int, bytes, bytes]] = {}

    @classmethod
    def of(cls, path: str) -> WordCodec:
        if ("words", path) not in _held:
            _held["words", path] = cls(path)
        return _held["words", path]

    def _entry(self, ids: list[int]) -> tuple[int, bytes, bytes]:
        """How many, the ids in decimal, and the decoded text: this vocabulary's decoder joins the tokens by blanks."""
        return len(ids), " ".join(map(str, ids)).encode(), " ".join([self.names[i] for i in ids]).encode()

    def _prepare(self, path: str) -> None:
        """The same merges for the tiktoken library, which merges a single word several times faster: the word's end is a
        byte of its own, which no text in UTF-8 has, and each token's id is its rank, as merges are numbered in order."""
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        vocabulary, self.special = described["model"]["vocab"], [x["content"] for x in described["added_tokens"]]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(shown))}
        suffix = described["model"]["end_of_word_suffix"]
        ranks = {}
        for token, i in vocabulary.items():
            if token in self.special:
                continue
            end = token.endswith(suffix) and len(token) > len(suffix)
            raw = bytes(letters[c] for c in (token[: -len(suffix)] if end else token))
            ranks[raw + b"\xff" * end] = i
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.ranks = ranks
        pattern = described["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern).findall

    def _ids(self, unit: str) -> list[int] | None:
        """The ids of a unit of plain Latin characters, which normal forms leave alone; None for others."""
        if not unit.isprintable() or max(unit) > "\u017f" or "\u0130" in unit or "\u0149" in unit or "<|" in unit:
            return None
        out: list[int] = []
        for word in self.words(unit.lower()):
            raw = word.encode() + b"\xff"
            if (known := self.ranks.get(raw)) is not None:
                out.append(known)
            else:
                out += self.merge(raw)
        return out

    def learn(self, units: set[str]) -> dict[str, tuple[int, bytes, bytes]]:
        """Entries of units that aren't in the cache, encoded in one call."""
        missing = [x for x in units if x not in self.units]
        if len(self.units) + len(missing) > CACHED_UNITS:
            self.units.clear()
            missing = list(units)
        found, other = {}, []
        for u in missing:
            if (ids := self._ids(u)) is None:
                other.append(u)
            else:
                found[u] = self._entry(ids)
        if other:
            found.update((u, self._entry(e.ids)) for u, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False)))
        self.units.update((u, e) for u, e in found.items() if len(u) <= LONGEST_UNIT)
        return found

    def entries(self, chunks: dict[bytes, str]) -> dict[bytes, tuple | None]:
        """For each chunk: what its whole units give, its head and tail up to a whole unit each, and how many ids these two units
        have. None for a chunk without a whole unit: it belongs to the joins on its sides."""
        split = {}
        for key, text in chunks.items():
            units = text.replace("\n", " ").split(" ")
            inner = units[1:-1]
            shown = [i for i, u in enumerate(inner) if u]
            if shown:
                a, b = shown[0], shown[-1]
                # all blanks before the first whole unit and after the last belong to the windows of the joins
                head = text[: len(units[0]) + a + 1 + len(inner[a])]
                tail = text[len(text) - len(units[-1]) - (len(inner) - b) - len(inner[b]) :]
                split[key] = ([inner[i] for i in shown], head, tail)
        extra = self.learn({u for units, *_ in split.values() for u in units})
        out: dict[bytes, tuple | None] = dict.fromkeys(chunks)
        for key, (units, head, tail) in split.items():
            found = [self.units.get(u) or extra[u] for u in units]
            full = [e for e in found if e[0]]
            inner = sum(e[0] for e in full), b" ".join([e[1] for e in full]), b" ".join([e[2] for e in full])
            out[key] = (inner, head, tail, found[0][0], found[-1][0])
        return out

    def encode(self, texts: list[str], known: dict[bytes, tuple] | None = None) -> Iterator[tuple[int, list[bytes], list[bytes]]]:
        """For each text: the number of ids, then pieces of the ids in decimal and of the decoded text, to be joined by blanks.

        known: entries of chunks that were encoded before, by their digests."""
        known = known or {}
        data, plans = chunked(texts)
        made = self.entries({key: data[a:b].decode() for plan in plans for key, a, b in plan if key not in known})
        windows: list[str] = []
        jobs = []
        for plan in plans:
            job, pending, left = [], "", []
            for key, a, b in plan:
                entry = known.get(key) or made[key]
                if entry is None:
                    pending += data[a:b].decode()
                    continue
                inner, head, tail, first, last = entry
                ids = inner[1].split(b" ", first)[:first]
                job.append((len(windows), left, [int(x) for x in ids], inner))
                windows.append(pending + head)
                pending, left = tail, [int(x) for x in inner[1].rsplit(b" ", last)[-last:]] if last else []
            job.append((len(windows), left, [], None))
            windows.append(pending)
            jobs.append(job)
        found = [x.ids for x in self.tokenizer.encode_batch_fast(windows, add_special_tokens=False)]
        for text, job in zip(texts, jobs):
            yield self._joined(job, found) or self._apart(self._entry(self.tokenizer.encode(text, add_special_tokens=False).ids))

    def _apart(self, entry: tuple[int, bytes, bytes]) -> tuple[int, list[bytes], list[bytes]]:
        return entry[0], [entry[1]] if entry[0] else [], [entry[2]] if entry[0] else []

    def _joined(self, job: list, found: list[list[int]]) -> tuple[int, list[bytes], list[bytes]] | None:
        """Chunks and repaired joins on end; None if a join's ids don't agree with those of the chunks on its sides."""
        n, ids, decoded = 0, [], []
        for at, left, right, inner in job:
            got = found[at]
            end = len(got) - len(right)
            if end < len(left) or got[: len(left)] != left or got[end:] != right:
                return None
            for e in (self._entry(got[len(left) : end]), inner):
                if e and e[0]:
                    n += e[0]
                    ids.append(e[1])
                    decoded.append(e[2])
        return n, ids, decoded


def codec(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by one blank) and decoded text of each document.

    Null text: empty, so no ids and an empty decoded text. Null doc_id stays null; repeated rows give repeated results;
    an empty table gives none. Only doc_id and text are read."""
    return _run(docs, tokenizer, "doc_id long, n_tokens long, ids string, decoded string", lambda n, ids, decoded: (n, b" ".join(ids).decode(), b" ".join(decoded).decode()))


def _digest(pieces: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(pieces)).hexdigest()


def codec_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """As codec, with SHA-256 digests of the ids and of the decoded text in place of them."""
    return _run(docs, tokenizer, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda n, ids, decoded: (n, _digest(ids), _digest(decoded)))


def _halves(keys: list[bytes]) -> np.ndarray:
    """Digests as two numbers each."""
    return np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)


def _slices(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _chunk_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        counts = Counter(key for plan in chunked(batch.column(1).to_pylist())[1] for key, *_ in plan)
        keys = _halves(list(counts))
        yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(list(counts.values()), pa.int64())], names=["a", "b", "n"])


def shared_filter(docs: DataFrame) -> np.ndarray:
    """A Bloom filter of FILTER_BITS bits, whatever the number of rows, over the chunks that occur twice or more often."""
    often = docs.mapInArrow(_chunk_counts, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 1")
    bits = often.select(F.explode(F.array(*(F.pmod(x, F.lit(FILTER_BITS)) for x in ("a", "b")))).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS >> 6, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out


def _may_be_shared(bits: np.ndarray, keys: list[bytes]) -> np.ndarray:
    at = _halves(keys) & (FILTER_BITS - 1)
    return ((bits[at >> 6] >> (at & 63)) & 1).all(1)


def _run(docs: DataFrame, tokenizer: str, schema: str, make) -> DataFrame:
    """Documents without a shared chunk are encoded where they stand. The others are written in blocks; their shared chunks are
    encoded once each and joined to the blocks that hold them, once a block."""
    import zstandard

    names = [x.split()[0] for x in schema.split(", ")]
    docs = with_ids(docs)
    held = docs.sparkSession.sparkContext.broadcast(shared_filter(docs))
    types = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), (names[2], pa.string()), (names[3], pa.string()), ("block", pa.int64()), ("packed", pa.binary()), ("keys", pa.binary())])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, press, block, size = WordCodec.of(tokenizer), zstandard.ZstdCompressor(), None, 0
        for batch in _slices(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out, alone = [], []
            plans = chunked(texts)[1]
            marks = _may_be_shared(held.value, [key for plan in plans for key, *_ in plan]).tolist()
            at = 0
            for doc_id, text, plan in zip(ids, texts, plans):
                wanted = {key for (key, *_), mark in zip(plan, marks[at : at + len(plan)]) if mark}
                at += len(plan)
                if not wanted:
                    alone.append((doc_id, text))
                    continue
                if block is None or size > BLOCK_CHARS:
                    block, size = uuid.uuid4().int >> 65, 0
                size += len(text)
                out.append((doc_id, None, None, None, block, press.compress(text.encode()), b"".join(wanted)))
            out += [(doc_id, *make(*x), None, None, None) for (doc_id, _), x in zip(alone, words.encode([t for _, t in alone]))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types.types)], schema=types)

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in _slices(batches):
            counts, found = Counter(), {}
            for packed, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                wanted = {keys[i : i + 16] for i in range(0, len(keys), 16)}
                data, (plan,) = chunked([unpress.decompress(packed).decode()])
                counts.update(key for key, *_ in plan if key in wanted)
                found.update((key, data[a:b]) for key, a, b in plan if key in wanted)
            keys = _halves(list(counts))
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(list(counts.values()), pa.int64()), pa.array([found[k].decode() for k in counts], pa.string())], names=["a", "b", "n", "text"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordCodec.of(tokenizer)
        for batch in _slices(batches):
            made = words.entries(dict(enumerate(batch.column(2).to_pylist())))
            rows = [(i, np.array(e[0][1].split(), np.int32).tobytes(), *e[1:]) for i, e in made.items() if e]
            if rows:
                at, *rest = zip(*rows)
                kinds = [pa.binary(), pa.string(), pa.string(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), *(pa.array(x, t) for x, t in zip(rest, kinds))], names=["a", "b", "ids", "head", "tail", "first", "last"])

    def references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            wanted = {(block, keys[i : i + 16]) for block, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i in range(0, len(keys), 16)}
            blocks, keys = zip(*wanted)
            keys = _halves(list(keys))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1])], names=["block", "a", "b"])

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        words, unpress, known = WordCodec.of(tokenizer), zstandard.ZstdDecompressor(), {}
        for r in left.to_pylist():
            ids = np.frombuffer(r["ids"], np.int32).tolist()
            known[np.array([r["a"], r["b"]], np.int64).tobytes()] = (words._entry(ids), r["head"], r["tail"], r["first"], r["last"])
        texts = [unpress.decompress(x).decode() for x in right["packed"].to_pylist()]
        rows = [make(*x) for at in range(0, len(texts), 64) for x in words.encode(texts[at : at + 64], known)]
        return pa.table([right["doc_id"], *(pa.array([r[i] for r in rows], types.types[i + 1]) for i in range(3))], names=names)

    done = staged(docs.mapInArrow(first, f"{schema}, block long, packed binary, keys binary"), "codec")
    blocks = done.where("block IS NOT NULL")
    texts = blocks.select("packed", "keys").mapInArrow(texts_of, "a long, b long, n long, text string")
    once = texts.groupBy("a", "b").agg(F.first("text").alias("text"), F.sum("n").alias("n")).where("n > 1").select("a", "b", "text")
    chunks = staged(once.mapInArrow(encoded, "a long, b long, ids binary, head string, tail string, first int, last int"), "chunks")
    wanted = blocks.select("block", "keys").mapInArrow(references, "block long, a long, b long").distinct()
    sent = wanted.join(chunks, ["a", "b"])
    rest = sent.groupBy("block").cogroup(blocks.select("doc_id", "block", "packed").groupBy("block")).applyInArrow(second, schema)
    return done.where("block IS NULL").select(*names).unionByName(rest).select(id_back(), *names[1:])
