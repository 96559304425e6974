"""Language-model scores from a log-frequency Bloom filter.

Tokens are the lower-cased (A-Z) words of a text and one end token; training
documents are those whose crc32 of the id mod 5 is not 1.

Counting. Words are summed exactly. The ``HEAD`` most frequent words are a
table of bounded size (hash, count) that tasks hold. Word pairs are counted in
a second pass: a task sorts the pairs of a slice of text and sends them as packed
runs by bucket of the pair, so that the shuffle has a few bytes per pair; a
bucket's task merges the runs. Every pair is kept, also one seen once. Buckets
grow in number with the tokens, not in size; a hot word's pairs are spread over
all of them.

Filter (after Talbot and Osborne, 2007). A count c is quantised to the level
1 + floor(log_BASE(c / least)), and an entry (n-gram, j) is put in for every j
up to it; a reader probes j = 1, 2, ... until a miss. An n-gram that was
not put in is taken for one with probability ``ERROR`` per probe. The pairs are dealt to
shards by their first word h (a word with very many followers to several, by the second word); a
shard also has the counts of its h and of the words behind them as far as they are not in the head, and
the number of followers of h; as all pairs of h are kept, r(h) = D * followers is left
to the unigram. So a shard answers for its histories alone. Pairs travel to their shard as
hashes in packed runs, a row per shard and task part. Shards have
bounded size; as many as fit ``ROUND_BYTES`` are broadcast at once and every
round adds the terms of its own histories: the broadcast does not grow with
the corpus, the number of rounds does. A round is one buffer; its keys are probed in the order
of the shards, level by level, in parts that fit a cache. The passes over texts take
Arrow batches of ``BATCH_ROWS`` texts, so that neither the JVM nor a worker holds many.

Model: absolute discounting, interpolated with the unigram p(w),
    p(w | h) = max(c(h, w) - D, 0) / c(h) + r(h) / c(h) * p(w),
h the word before (or the start), p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)).
Hence log p(w | h) = log p(w) + gain(h, w); the first sum is the base score.

Base score: exact counts. Words outside the head are joined to all counts by
word hash (rows: word, document, occurrences) and summed per document.

Defined cases
* null or empty text: one token, the end;
* null doc_id: a training row, held_out false; repeated ids and rows: one result
  row each, each counted;
* very long texts are counted and scored whole; words are compared by their 64-bit hash;
* no training rows: N = V = 0, p(w) = 1, all scores 0;
* empty table: empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import freeze, held, text_slices, word_codes

BASE = 1.5
ERROR = 1 / 256
PAIR_LEAST = 1
DISCOUNT = 0.7
HEAD = 1 << 20
BUCKET_PAIRS = 2_000_000
SHARD_PAIRS = 500_000
ROUND_BYTES = 128 << 20
#: Text whose tokens and pairs a task holds at once.
TEXT_BYTES = 4 << 20
#: Texts of an Arrow batch at most; keys that are probed at once, and pairs whose gains are computed at once.
BATCH_ROWS = 1000
PROBE_KEYS = 1 << 13
GAIN_PAIRS = 1 << 19

END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
# kinds of entries: count of a word, of a pair, number of followers of a word
WORD, PAIR, LEFT = 0, 1, 2
#: Smallest count of each kind, where its levels begin.
LEAST = np.array([1.0, float(PAIR_LEAST), 1.0])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_hash(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h * np.uint64(0x9E3779B97F4A7C15) + w)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of all tokens, offsets by text, hash of each code).

    The last two codes are the end token and the start; the start is only a history."""
    import xxhash
    codes, offs, distinct = word_codes(texts)
    distinct = distinct.cast(pa.large_string())
    _, edges, data = distinct.buffers()
    edges = np.frombuffer(edges, np.int64)[distinct.offset:distinct.offset + len(distinct) + 1].tolist() if len(distinct) else []
    data = memoryview(data) if data is not None else b""
    h = np.array([xxhash.xxh64_intdigest(data[a:b]) for a, b in zip(edges, edges[1:])] + [int(END), int(START)], np.uint64)
    n = len(texts)
    ends = offs[1:] + np.arange(n)
    out = np.full(len(codes) + n, len(h) - 2, np.int64)
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[is_word] = codes
    return out, np.concatenate([[0], ends + 1]), h


def pairs_of(codes: np.ndarray, offs: np.ndarray, n: int) -> np.ndarray:
    """history * n + token of each token; n - 1 is the start."""
    h = np.empty_like(codes)
    h[1:] = codes[:-1]
    h[offs[:-1]] = n - 1
    return h * n + codes


# ---- counting -----------------------------------------------------------------

def count_words(texts: DataFrame) -> DataFrame:
    """(w, n): training occurrences of each token, by hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 0, TEXT_BYTES):
                codes, _, h = tokens(part.column(0))
                n = np.bincount(codes, minlength=len(h))[:-1]
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(n[at])], names=["w", "n"])

    return texts.mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))


@dataclass
class Head:
    """The most frequent words by hash (sorted) with their counts."""

    key: np.ndarray
    n: np.ndarray
    tokens: int
    kinds: int

    def find(self, h: np.ndarray) -> np.ndarray:
        """Position of each hash, -1 if it is not in the head."""
        at = np.minimum(np.searchsorted(self.key, h), len(self.key) - 1)
        return np.where(self.key[at] == h, at, -1)


def read_head(counts: DataFrame, most: int) -> Head:
    """All words above the count that at most ``most`` words reach."""
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1.05))
    hist = sorted(counts.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s")).collect(),
                  key=lambda r: -r.band)  # one row per count band: a few hundred
    kinds, total, cut, got = sum(r.k for r in hist), sum(r.s for r in hist), math.inf, 0
    for r in hist:
        if got + r.k > most:
            break
        cut, got = r.band, got + r.k
    t = counts.where(band >= cut).toArrow() if got else None
    end = counts.where(F.col("w") == F.lit(int(END.view(np.int64)))).agg(F.sum("n")).first()[0] or 0
    key = np.asarray(t["w"].combine_chunks()).view(np.uint64) if t else np.zeros(0, np.uint64)
    n = np.asarray(t["n"].combine_chunks()) if t else np.zeros(0, np.int64)
    # as a history, the start occurs once per text
    key, n = np.append(key, START), np.append(n, end)
    o = np.argsort(key)
    return Head(key[o], n[o].astype(np.int64), total, kinds)


def pack(values: np.ndarray) -> bytes:
    """A run of unsigned integers, by byte planes (small numbers leave empty planes)."""
    import zstandard
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(data: bytes, n: int) -> np.ndarray:
    import zstandard
    raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=max(8 * n, 1))
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view("<u8").ravel()


def count_pairs(texts: DataFrame, head, buckets: int) -> DataFrame:
    """(h, w, n, ch, cw) of all pairs; the counts of the words are 0 where they
    are not in the head."""
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hd = head.value
        width = np.uint64(max(1, int(len(hd.key)).bit_length()))
        for batch in batches:
            for part in text_slices(batch, 0, TEXT_BYTES):
                codes, offs, h = tokens(part.column(0))
                key, n = np.unique(pairs_of(codes, offs, len(h)), return_counts=True)
                a, b = key // len(h), key % len(h)
                at = hd.find(h)
                both = (at[a] >= 0) & (at[b] >= 0)
                packed = np.zeros(len(key), np.uint64)
                packed[both] = (at[a[both]].astype(np.uint64) << width) | at[b[both]].astype(np.uint64)
                bucket = (pair_hash(h[a], h[b]) >> np.uint64(11)) % np.uint64(buckets)
                out = []
                for kind, sel in ((0, np.flatnonzero(both)), (1, np.flatnonzero(~both))):
                    if int(buckets).bit_length() + 2 * int(width) <= 64:  # one key of both
                        o = sel[np.argsort((bucket[sel] << (width + width)) | packed[sel])]
                    else:
                        o = sel[np.lexsort((packed[sel], bucket[sel]))]
                    edges = np.searchsorted(bucket[o], np.arange(buckets + 1))
                    for k in range(buckets):
                        x = o[edges[k]:edges[k + 1]]
                        if len(x) and kind == 0:
                            out.append((k, 0, len(x), pack(np.diff(packed[x], prepend=np.uint64(0))), b"", pack(n[x])))
                        elif len(x):
                            out.append((k, 1, len(x), h[a[x]].tobytes(), h[b[x]].tobytes(), pack(n[x])))
                types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)],
                                                 names=["bucket", "kind", "size", "a", "b", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hd, key, got = head.value, None, []
        width = np.uint64(max(1, int(len(hd.key)).bit_length()))

        def done() -> Iterator[pa.RecordBatch]:
            near = [r for r in got if r[0] == 0]
            if near:
                v = np.concatenate([r[1] for r in near])
                o = np.argsort(v, kind="stable")
                v, n = v[o], np.concatenate([r[3] for r in near])[o]
                first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
                n, v = np.add.reduceat(n, first), v[first]
                a, b = v >> width, v & ((np.uint64(1) << width) - np.uint64(1))
                yield rows(hd.key[a], hd.key[b], n, hd.n[a], hd.n[b])
            far = [r for r in got if r[0] == 1]
            if far:
                a, b, n = (np.concatenate([r[i] for r in far]) for i in (1, 2, 3))
                o = np.lexsort((b, a))
                a, b, n = a[o], b[o], n[o]
                first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
                n, a, b = np.add.reduceat(n, first), a[first], b[first]
                ia, ib = hd.find(a), hd.find(b)
                yield rows(a, b, n, np.where(ia >= 0, hd.n[ia], 0), np.where(ib >= 0, hd.n[ib], 0))

        def rows(a, b, n, ca, cb) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))
                                               for x in (a, b, n.astype(np.int64), ca, cb)], names=["h", "w", "n", "ch", "cw"])

        for batch in batches:
            for i in range(batch.num_rows):
                k, kind, size, a, b, n = (batch.column(c)[i].as_py() for c in range(6))
                if k != key:
                    if got:
                        yield from done()
                    key, got = k, []
                n = unpack(n, size).astype(np.int64)
                got.append((0, np.cumsum(unpack(a, size), dtype=np.uint64), None, n) if kind == 0 else
                           (1, np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), n))
        if got:
            yield from done()

    r = texts.mapInArrow(runs, "bucket int, kind int, size long, a binary, b binary, n binary")
    return (r.repartition(buckets, "bucket").sortWithinPartitions("bucket")
            .mapInArrow(merge, "h long, w long, n long, ch long, cw long"))


# ---- filter -------------------------------------------------------------------

def levels(count: np.ndarray, least: np.ndarray | float) -> np.ndarray:
    """Quantised counts: 1 + floor(log_BASE(count / least))."""
    return (1 + np.floor(np.log(np.maximum(count, least) / least) / math.log(BASE) + 1e-9)).astype(np.int64)


def worth(level: np.ndarray, kind: int) -> np.ndarray:
    """The count a level stands for (middle of the whole numbers in it, so counts up to 3 are exact); level 0: 0."""
    low = np.ceil(LEAST[kind] * BASE ** (level - 1.0) - 1e-9)
    high = np.ceil(LEAST[kind] * BASE ** (level * 1.0) - 1e-9) - 1
    return np.where(level > 0, np.sqrt(low * np.maximum(low, high)), 0.0)


def probe_count(error: float = ERROR) -> int:
    return max(1, round(-math.log2(error)))


def _slots(key: np.ndarray, kind: int, level: int, size: int, probes: int) -> Iterator[np.ndarray]:
    """Bit positions of the entry (key, kind, level) among ``size`` (below 2^32), by double hashing."""
    with np.errstate(over="ignore"):
        a = mix(key + np.uint64((level * 8 + kind + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1))
        b = mix(a) | np.uint64(1)
        for i in range(probes):
            yield _place(a + np.uint64(i) * b, size)


def _place(h: np.ndarray, size: int) -> np.ndarray:
    """The upper half of each hash, scaled to 0 .. size - 1."""
    return (h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)


def fill(groups: list[tuple[int, np.ndarray, np.ndarray]], probes: int) -> np.ndarray:
    """The packed bits of one shard from (kind, keys, counts)."""
    lev = [levels(n.astype(float), LEAST[kind]) for kind, _, n in groups]
    entries = sum(int(x.sum()) for x in lev)
    size = max(64, int(entries * -math.log(ERROR) / math.log(2) ** 2) // 8 * 8)
    bits = np.zeros(size, bool)
    for (kind, key, _), top in zip(groups, lev):
        for j in range(1, int(top.max(initial=0)) + 1):
            for s in _slots(key[top >= j], kind, j, size, probes):
                bits[s] = True
    return np.packbits(bits, bitorder="little")


def read_level(data: np.ndarray, key: np.ndarray, kind: int, probes: int, first: np.ndarray | None = None,
               size: np.ndarray | None = None) -> np.ndarray:
    """Level of each key: membership probes j = 1, 2, ... until a miss. A key's shard are the ``size``
    bits of ``data`` from bit ``first`` on (all of them, if not given)."""
    out, live, j = np.zeros(len(key), np.int64), np.arange(len(key)), 0
    first = np.zeros(len(key), np.uint64) if first is None else first
    size = np.full(len(key), len(data) * 8, np.uint64) if size is None else size
    while len(live):
        j += 1
        parts = (live[i:i + PROBE_KEYS] for i in range(0, len(live), PROBE_KEYS))
        live = np.concatenate([x[_has(data, key[x], kind, j, probes, first[x], size[x])] for x in parts])
        out[live] = j
    return out


def _has(data: np.ndarray, key: np.ndarray, kind: int, level: int, probes: int, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of the keys whose entry (key, kind, level) is in; see ``_slots``."""
    at = np.arange(len(key))
    with np.errstate(over="ignore"):
        a = mix(key + np.uint64((level * 8 + kind + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1))
        b = mix(a) | np.uint64(1)
        hit = np.ones(len(key), bool)
        for i in range(probes):
            s = a >> np.uint64(32)
            s *= size
            s >>= np.uint64(32)
            s += first
            bit = data[(s >> np.uint64(3)).view(np.int64)]
            bit >>= s.astype(np.uint8) & np.uint8(7)
            hit &= (bit & np.uint8(1)).view(bool)
            if i + 1 < probes and np.count_nonzero(hit) < 0.75 * len(hit):  # only keys that have passed so far go on
                at, a, b, first, size = (x[hit] for x in (at, a, b, first, size))
                hit = np.ones(len(at), bool)
            a += b
    return at[hit]


class Round:
    """The shards of one broadcast, in one buffer: {shard: bytes} and the (shard, bits) rows."""

    def __init__(self, sizes: dict[int, int], shards: Iterator[tuple[int, bytes]]):
        self.ids = np.array(sorted(sizes), np.int64)
        edges = np.concatenate([[0], np.cumsum([sizes[i] for i in self.ids.tolist()])]).astype(np.int64)
        self.first, self.size, self.data = edges[:-1], np.diff(edges), np.zeros(int(edges[-1]), np.uint8)
        for i, bits in shards:
            at = int(np.searchsorted(self.ids, i))
            self.data[edges[at]:edges[at + 1]] = np.frombuffer(bits, np.uint8)

    def find(self, shard: np.ndarray) -> np.ndarray:
        """Place of each shard in this round, -1 if it is not here."""
        if not len(self.ids):
            return np.full(len(shard), -1)
        if self.ids[-1] - self.ids[0] + 1 == len(self.ids):  # consecutive
            at = shard.astype(np.int64) - self.ids[0]
            return np.where((at >= 0) & (at < len(self.ids)), at, -1)
        at = np.minimum(np.searchsorted(self.ids, shard), len(self.ids) - 1)
        return np.where(self.ids[at] == shard, at, -1)

    def count(self, at: np.ndarray, key: np.ndarray, kind: int, probes: int) -> np.ndarray:
        """Counts of the keys, each in the shard at its place; in the order of the shards, so that the bits stay in cache."""
        order = np.argsort(at.astype(np.uint16) if len(self.ids) < 1 << 16 else at, kind="stable")
        first, size, at = (self.first * 8).astype(np.uint64), (self.size * 8).astype(np.uint64), at[order]
        level = np.zeros(len(key), np.int64)
        level[order] = read_level(self.data, key[order], kind, probes, first[at], size[at])
        return worth(np.arange(level.max(initial=0) + 1), kind)[level]


@dataclass
class Dealt:
    """Which shard answers for (h, w): by h, and by w too for words with very many followers."""

    shards: int
    split: dict[int, int] = field(default_factory=dict)

    def of(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        out = (mix(h) >> np.uint64(9)) % np.uint64(self.shards)
        if self.split:
            hot = np.array(sorted(self.split), np.uint64)
            parts = np.array([self.split[x] for x in hot.tolist()], np.uint64)
            i = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
            at = np.flatnonzero(hot[i] == h)
            out[at] = (out[at] + mix(w[at]) % parts[i[at]]) % np.uint64(self.shards)
        return out.astype(np.int32)

    def all_of(self, h: int) -> list[int]:
        """Every shard that answers for h."""
        return sorted(self.each_of(np.array([h], np.uint64))[1].tolist())

    def each_of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in h, shard) of every shard that answers for each h."""
        parts = np.array([self.split.get(x, 1) for x in h.tolist()] if self.split else np.ones(len(h)), np.int64)
        row = np.repeat(np.arange(len(h)), parts)
        part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        first = ((mix(h) >> np.uint64(9)) % np.uint64(self.shards)).astype(np.int64)
        return row, ((first[row] + part) % self.shards).astype(np.int32)


def _runs(kind: int, shard: np.ndarray, a: np.ndarray, n: np.ndarray, w: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    """A row per shard: its keys a with their counts n, and the words w whose count c is not in the head (c > 0)."""
    o = np.argsort(shard, kind="stable")
    shard, a, n, w, c = shard[o], a[o], n[o], w[o], c[o]
    edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else np.zeros(1, int)
    out = []
    for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
        far = x + np.flatnonzero(c[x:y] > 0)
        out.append((int(shard[x]), kind, y - x, a[x:y].tobytes(), pack(n[x:y]), w[far].tobytes(), c[far].tobytes()))
    types = (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)],
                                      names=["shard", "kind", "size", "a", "n", "w", "c"])


def build_filter(pairs: DataFrame, counts: DataFrame, shard_pairs: int) -> tuple[DataFrame, Dealt]:
    """Pairs -> (shard, bits) in the shared folder, and the rule that deals histories."""
    spark, probes = pairs.sparkSession, probe_count()
    # counts of the words that are not in the head; those of the head are in the tasks' table, so no entry is made for them (c = 0)
    known = pairs.where("cw > 0").withColumn("cw", F.lit(0).cast("long"))
    rare = pairs.where("cw = 0").drop("cw").join(counts.select("w", F.col("n").alias("cw")), "w").select(*pairs.columns)
    per_h = pairs.groupBy("h").agg(F.count(F.lit(1)).alias("followers"), F.max("ch").alias("ch"))
    more = per_h.where("ch = 0").drop("ch").join(counts.select(F.col("w").alias("h"), F.col("n").alias("ch")), "h")
    per_h = freeze(per_h.where("ch > 0").withColumn("ch", F.lit(0).cast("long")).unionByName(more.select(*per_h.columns)), "lm-histories")
    total = per_h.agg(F.sum("followers")).first()[0] or 0
    shards = max(1, -(-total // shard_pairs))
    hot = per_h.where(F.col("followers") > shard_pairs // 4).select("h", "followers").collect()  # 4 per shard at most
    deal = Dealt(shards, {r.h & (1 << 64) - 1: min(shards, 1 + 4 * r.followers // shard_pairs) for r in hot} if shards > 1 else {})

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dealt(got: list[list[np.ndarray]]) -> pa.RecordBatch:
            h, w, n, c = (np.concatenate(x) for x in zip(*got))
            h, w = h.view(np.uint64), w.view(np.uint64)
            return _runs(0, deal.of(h, w), pair_hash(h, w), n, w, c)

        got, size = [], 0
        for b in batches:
            got.append([b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4)])
            size += b.num_rows
            if size >= shard_pairs:
                yield dealt(got)
                got, size = [], 0
        if got:
            yield dealt(got)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, followers, ch = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            h = h.view(np.uint64)
            row, shard = deal.each_of(h)
            yield _runs(1, shard, h[row], followers[row], h[row], ch[row])

    schema = "shard int, kind int, size long, a binary, n binary, w binary, c binary"
    rows = (known.unionByName(rare).select("h", "w", "n", "ch", "cw").mapInArrow(assign, schema)
            .unionByName(per_h.select("h", "followers", "ch").mapInArrow(totals, schema)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, got = None, []

        def done() -> pa.RecordBatch:
            kind = np.repeat([r[0] for r in got], [len(r[1]) for r in got])
            a, n, w, c = (np.concatenate([r[i] for r in got]) for i in range(1, 5))
            u, first = np.unique(w, return_index=True)
            bits = fill([(PAIR, a[kind == 0], n[kind == 0]), (LEFT, a[kind == 1], n[kind == 1]), (WORD, u, c[first])], probes)
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["shard", "bits"])

        for batch in batches:
            for i in range(batch.num_rows):
                s, kind, size, a, n, w, c = (batch.column(x)[i].as_py() for x in range(7))
                if s != key:
                    if got:
                        yield done()
                    key, got = s, []
                got.append((kind, np.frombuffer(a, np.uint64), unpack(n, size), np.frombuffer(w, np.uint64), np.frombuffer(c, np.int64)))
        if got:
            yield done()

    dealt = rows.repartition(shards, "shard").sortWithinPartitions("shard")
    return freeze(dealt.mapInArrow(run, "shard int, bits binary"), "lm-filter"), deal


def gains(bits: Round, deal: Dealt, head: Head, hashes: np.ndarray, h: np.ndarray, w: np.ndarray, probes: int) -> np.ndarray:
    """log10 p(w | h) - log10 p(w) of the code pairs (h, w), 0 for those that
    other rounds answer for. Words of the head have their counts there; the
    counts of other words are probed."""
    out = np.zeros(len(h))
    place = bits.find(deal.of(hashes[h], hashes[w]))
    at = np.flatnonzero(place >= 0)
    if not len(at):
        return out
    n, place, h, w = len(hashes), place[at], h[at], w[at]
    in_head = head.find(hashes)
    count = np.where(in_head >= 0, head.n[in_head], 0).astype(float)

    def words_of(code: np.ndarray, where: np.ndarray) -> np.ndarray:
        c = count[code]
        rare = np.flatnonzero(c == 0)
        u, i = np.unique(where[rare] * n + code[rare], return_inverse=True)
        c[rare] = bits.count(u // n, hashes[u % n], WORD, probes)[i]
        return c

    # a history is probed once per run of equal ones in a shard
    run = np.concatenate([[True], (h[1:] != h[:-1]) | (place[1:] != place[:-1])])
    ih, uh = np.cumsum(run) - 1, np.flatnonzero(run)
    left = bits.count(place[uh], hashes[h[uh]], LEFT, probes)
    ok = np.flatnonzero(left[ih] > 0)
    at, place, h, w, left = at[ok], place[ok], h[ok], w[ok], left[ih[ok]]
    c, cw = words_of(h, place), words_of(w, place)
    live = np.flatnonzero(c > 0)
    at, place, h, w, c, cw, rest = at[live], place[live], h[live], w[live], c[live], cw[live], np.minimum(1.0, DISCOUNT * left[live] / c[live])
    pair = np.zeros(len(at))
    ask = np.flatnonzero(cw > 0)
    pair[ask] = bits.count(place[ask], pair_hash(hashes[h[ask]], hashes[w[ask]]), PAIR, probes)
    pair = np.minimum(pair, np.minimum(c, cw))
    uni = (cw + 0.5) / (head.tokens + 0.5 * (head.kinds + 1))
    out[at] = np.log10(np.maximum(pair - DISCOUNT, 0.0) / c / uni + rest)
    return out


# ---- scoring ------------------------------------------------------------------

def _sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0.0], np.cumsum(values)])
    return c[offs[1:]] - c[offs[:-1]]


def _base(docs: DataFrame, head, first, deal: Dealt) -> DataFrame:
    """One pass: rows (kind 0) of documents with the sums over head words and the
    first round's gains, and rows (kind 1) of their other words."""
    probes = probe_count()
    schema = ("kind int, rid long, rk long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, gain double, "
              "w long, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        hd, bits = head.value, first.value
        scale = hd.tokens + 0.5 * (hd.kinds + 1)
        nxt = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in text_slices(batch, 3, TEXT_BYTES):
                m = part.num_rows
                codes, offs, h = tokens(part.column(3))
                at = hd.find(h)
                c = np.where(at >= 0, hd.n[at], 0)
                logp = np.where(at >= 0, np.log10((c + 0.5) / scale), 0.0)
                rid = np.arange(nxt, nxt + m)
                nxt += m
                gain = _gain(bits, deal, hd, codes, offs, h, probes)
                known = _sums((at >= 0)[codes].astype(float), offs).astype(np.int64)
                none = pa.nulls(m, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(m, np.int32)), pa.array(rid), part.column(1), part.column(0), part.column(2), pa.array(np.diff(offs)),
                     pa.array(known), pa.array(_sums(logp[codes], offs)), pa.array(gain), none, none], names=_NAMES)
                doc = np.repeat(np.arange(m), np.diff(offs))
                rare = np.flatnonzero((at < 0)[codes])
                key, n = np.unique(doc[rare] * len(h) + codes[rare], return_counts=True)
                k = len(key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(k, np.int32)), pa.array(rid[key // len(h)]), *[pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.bool_(),
                     pa.int64(), pa.int64(), pa.float64(), pa.float64())], pa.array(h[key % len(h)].view(np.int64)), pa.array(n.astype(np.int64))], names=_NAMES)

    return docs.select("doc_id", "rk", "held_out", "text").mapInArrow(run, schema)


_NAMES = ["kind", "rid", "rk", "doc_id", "held_out", "n_tokens", "n_known", "base", "gain", "w", "n"]


def _gain(bits: Round, deal: Dealt, hd: Head, codes: np.ndarray, offs: np.ndarray, h: np.ndarray, probes: int) -> np.ndarray:
    """Summed gains of each text."""
    if not len(bits.ids):
        return np.zeros(len(offs) - 1)
    key, at = np.unique(pairs_of(codes, offs, len(h)), return_inverse=True)
    parts = [key[i:i + GAIN_PAIRS] for i in range(0, len(key), GAIN_PAIRS)]
    return _sums(np.concatenate([gains(bits, deal, hd, h, x // len(h), x % len(h), probes) for x in parts])[at], offs)


def _round(docs: DataFrame, head, bc, deal: Dealt) -> DataFrame:
    """(rk, gain) of one more round; equal rows have equal gains."""
    probes = probe_count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1, TEXT_BYTES):
                codes, offs, h = tokens(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_gain(bc.value, deal, head.value, codes, offs, h, probes))],
                                                 names=["rk", "gain"])

    return docs.select("rk", "text").mapInArrow(run, "rk long, gain double").groupBy("rk").agg(F.first("gain").alias("gain"))


@contextmanager
def _text_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of few texts: the buffers of a batch are held by the JVM and by the worker beside a slice's arrays."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(TEXT_BYTES)}
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def score(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", head: int = HEAD, bucket_pairs: int = BUCKET_PAIRS,
          shard_pairs: int = SHARD_PAIRS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), held(doc_id, 1).alias("held_out"))
    training = docs.where(~F.col("held_out")).select("text")
    with _text_batches(spark):
        counts = freeze(count_words(training), "lm-words")
    hd = read_head(counts, head)
    bc = spark.sparkContext.broadcast(hd)  # at most ``head`` words
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _text_batches(spark):
        pairs = freeze(count_pairs(training, bc, max(parts, -(-hd.tokens // bucket_pairs))), "lm-pairs")
    filt, deal = build_filter(pairs, counts, shard_pairs)
    docs = docs.withColumn("rk", F.xxhash64("doc_id", "text"))
    rounds, size = [{}], 0
    for r in filt.select("shard", F.octet_length("bits").alias("size")).orderBy("shard").collect():  # one row per shard
        if rounds[-1] and size + r.size > round_bytes:
            rounds.append({})
            size = 0
        rounds[-1][r.shard] = r.size
        size += r.size

    def sent(sizes: dict[int, int]):
        # one round's shards, ROUND_BYTES together, fetched shard by shard
        got = filt.where(F.col("shard").isin(list(sizes))).toLocalIterator()
        return spark.sparkContext.broadcast(Round(sizes, ((r.shard, r.bits) for r in got)))

    with _text_batches(spark):
        rows = freeze(_base(docs, bc, sent(rounds[0]), deal), "lm-rows")
    scale = hd.tokens + 0.5 * (hd.kinds + 1)
    c = F.coalesce(F.col("c"), F.lit(0))
    rare = (rows.where("kind = 1").select("rid", "w", "n").join(counts.select("w", F.col("n").alias("c")), "w", "left")
            .groupBy("rid").agg(F.sum(F.col("n") * F.log10((c + 0.5) / F.lit(scale))).alias("more"),
                                F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known")))
    out = rows.where("kind = 0").drop("kind", "w", "n").join(rare, "rid", "left")
    for ids in rounds[1:]:
        with _text_batches(spark):
            g = freeze(_round(docs, bc, sent(ids), deal), "lm-round")
        out = (out.join(g.withColumnRenamed("gain", "g2"), "rk", "left")
               .withColumn("gain", F.col("gain") + F.coalesce("g2", F.lit(0.0))).drop("g2"))
    base = F.col("base") + F.coalesce("more", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
                      F.lit(hd.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("gain")).alias("score"))
