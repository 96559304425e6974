"""Alignment of two tokenizers' tokens by diagonal run skipping.

Both tokenizers encode a text; their tokens' byte ends are two rising arrays
over the same bytes. Groups end where both have an end.

Method (``align``): at the current index shift the two arrays are compared in
blocks of 16, 64, 256, ... entries as long as they agree, and the first entry that differs is
found inside the last block, so a stretch of one-to-one tokens is jumped over in a few
comparisons. Where the arrays disagree, the irregular group is resolved
locally: the side that ends first moves on until both end at one place. The shift is updated
and skipping goes on. The texts of a slice are aligned as one, since both
sides end where a text ends.

Encoding: neither tokenizer joins a space to the character before it, so in front of a
single space both have an end. A task keeps the ids of the distinct chunks between
such cuts and puts a text's ids together from them; a text where this is not certain
(runs of spaces, a space between white space, literal U+2581) is encoded as one piece.

Links are the overlapping pairs of token occurrences. Their counts over the
corpus need one shuffle of pre-summed (A id, B id) pairs. Documents are
written once with their distinct pairs, packed, and read twice: to sum the counts and
to look them up. The most frequent pairs (``HEAD`` at most) are a table that
tasks hold; other pairs of a document are joined.

Defined cases
* null or empty text, or a side whose bytes are not space + text (a literal
  U+2581, say): no tokens; all numbers 0 and the digest '' (unhashed);
* strings of special tokens inside a text are plain text;
* very long texts are encoded and aligned whole;
* null and repeated ids and repeated rows: one result row each, every row's links count;
* an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import freeze, text_slices
from .lm import pack, unpack
from .spm import chunkable

#: Text aligned at once, pairs that a task sums before it sends them, pairs that tasks hold as a table.
TEXT_BYTES, SUM_PAIRS, HEAD = 2 << 20, 4_000_000, 2_000_000


# ---- the two sides -------------------------------------------------------------

def byte_letters() -> dict[str, int]:
    """The letters that a byte-level vocabulary writes for bytes: printable
    Latin-1 characters stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Side A: a byte-level BPE file of the ``tokenizers`` library, on space + text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are text
        letters = byte_letters()
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """Side B: a SentencePiece model, which puts the space in front itself."""

    def __init__(self, path: str):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in ((i, self.sp.id_to_piece(i)) for i in range(self.sp.get_piece_size()))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.sp.encode(texts, num_threads=1)


class Encoder:
    """Ids of texts on both sides, from a table of the distinct chunks that a task has met."""

    #: Ids that the table holds before it is emptied, and the longest chunk that is kept.
    LIMIT, LONG = 4_000_000, 4096
    #: Whatever may be white space to either library, and more.
    BLANK = r"[\x00-\x20\x7F\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}-\x{206F}\x{3000}\x{FEFF}]"
    ODD = f"^ |  |\u2581|{BLANK} ({BLANK}|$)"

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self.mark = b.sp.piece_to_id("\u2581")
        self.chunks = chunkable(b.sp)
        self.clear()

    def clear(self) -> None:
        """An empty table; entry 0 is a text without tokens."""
        self.known, self.tables, self.ok = {}, ((array("i"), [0, 0]), (array("i"), [0, 0])), [True]

    def add(self, texts: list[str]) -> list[int]:
        """Entries of new chunks (texts without the space in front)."""
        first, raw = len(self.ok), [b" " + t.encode() for t in texts]
        end = np.cumsum([len(x) for x in raw])
        ok = np.ones(len(texts), bool)
        for side, flat, ends, ids in ((self.a, *self.tables[0], self.a.encode(texts)),
                                      (self.b, *self.tables[1], [v or [self.mark] for v in self.b.encode(texts)])):
            one = list(chain.from_iterable(ids))
            last = np.cumsum([len(v) for v in ids])
            joined = list(map(side.bytes.__getitem__, one))
            size = np.cumsum([0, *map(len, joined)])[last]
            if not np.array_equal(size, end) or b"".join(joined) != b"".join(raw):
                ok &= [b"".join([side.bytes[i] for i in v]) == x for v, x in zip(ids, raw)]
            ends.extend((last + len(flat)).tolist())
            flat.extend(one)
        self.ok.extend(ok.tolist())
        return list(range(first, len(self.ok)))

    def lookup(self, chunks: list[str]) -> np.ndarray:
        got = list(map(self.known.get, chunks))
        at = [i for i, e in enumerate(got) if e is None]
        if at:
            new = [chunks[i] for i in at]
            entries = self.add(new)
            for i, e in zip(at, entries):
                got[i] = e
            self.known.update((c, e) for c, e in zip(new, entries) if len(c) <= self.LONG)
        return np.array(got, np.int64)

    def encode(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, offsets by text) of side A and of side B; no ids where a side's bytes are not the text."""
        if max(len(flat) for flat, _ in self.tables) > self.LIMIT:
            self.clear()
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.ODD) if self.chunks else pa.array(np.ones(len(texts), bool))
        lists = pc.split_pattern(pc.if_else(odd, pa.scalar(""), texts), " ")
        enc = lists.flatten().dictionary_encode()
        entries = self.lookup(enc.dictionary.to_pylist()) if len(enc) else np.zeros(0, np.int64)
        code = entries[np.asarray(enc.indices).astype(np.int64)]
        offs = np.asarray(lists.offsets).astype(np.int64)
        offs = offs - offs[0]
        empty = np.asarray(pc.equal(pc.binary_length(texts), 0))
        code[offs[:-1][empty]] = 0
        whole = np.flatnonzero(np.asarray(odd) & ~empty)
        if len(whole):
            code[offs[whole]] = self.add(texts.take(pa.array(whole)).to_pylist())
        good = np.logical_and.reduceat(np.array(self.ok)[code], offs[:-1]) if len(code) else np.zeros(0, bool)
        out = []
        for flat, ends in self.tables:
            flat, ends = np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32), np.array(ends)
            size = (ends[1:] - ends[:-1])[code] * np.repeat(good, np.diff(offs))
            before = np.concatenate([[0], np.cumsum(size)])
            out.append((flat[ranges(ends[code], size)].astype(np.int64), before[offs]))
        return out


# ---- alignment ------------------------------------------------------------------

@dataclass
class Alignment:
    """Groups as index ends in A and B, in order, and links as index pairs."""

    a_end: np.ndarray
    b_end: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def run_length(a: bytes, b: bytes, i: int, j: int) -> int:
    """Number of equal entries of the packed int32 arrays from (i, j) on; no entry is 0.

    Blocks grow fourfold while they agree; in the first that does not, the lowest
    bit in which both differ, read as whole numbers, gives the entry."""
    x, y, k, whole = 4 * i, 4 * j, 64, int.from_bytes
    while True:
        differ = whole(a[x:x + k], "little") ^ whole(b[y:y + k], "little")  # behind its end an array reads as 0
        if differ:
            return (x >> 2) - i + ((differ & -differ).bit_length() - 1 >> 5)
        x, y, k = x + k, y + k, 4 * k
        if x >= len(a):
            return (len(a) >> 2) - i


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> Alignment:
    """Align two rising arrays of ends with the same last value."""
    a, b = ends_a.astype(np.int32).tobytes(), ends_b.astype(np.int32).tobytes()
    va, vb = ends_a.tolist(), ends_b.tolist()
    na, i, j = len(va), 0, 0
    runs, odd = [], []
    while i < na:
        n = run_length(a, b, i, j)
        if n:
            runs += i, j, n
            i, j = i + n, j + n
            if i == na:
                break
        x, y, first_a, first_b = va[i], vb[j], i, j  # they differ: resolve the group
        while x != y:
            if x < y:
                i += 1
                x = va[i]
            else:
                j += 1
                y = vb[j]
        i, j = i + 1, j + 1
        odd += first_a, first_b, i, j
    r, o = np.array(runs, np.int64).reshape(-1, 3), np.array(odd, np.int64).reshape(-1, 4)
    run_a, run_b = ranges(r[:, 0], r[:, 2]), ranges(r[:, 1], r[:, 2])
    a_end, b_end = np.concatenate([run_a + 1, o[:, 2]]), np.concatenate([run_b + 1, o[:, 3]])
    order = np.argsort(a_end, kind="stable")
    # inside an irregular group every end, of A or of B, closes one overlap
    ends = np.sort(np.concatenate([ends_a[ranges(o[:, 0], o[:, 2] - o[:, 0])], ends_b[ranges(o[:, 1], o[:, 3] - o[:, 1])]]))
    ends = ends[np.diff(ends, prepend=-1) > 0]
    return Alignment(a_end[order], b_end[order], np.concatenate([run_a, np.searchsorted(ends_a, ends)]),
                     np.concatenate([run_b, np.searchsorted(ends_b, ends)]))


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one behind the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class GroupTexts:
    """Writes groups as ``a1,a2|b1;a3|b2,b3``: each token is its number and the sign behind it."""

    def __init__(self, ids: int):
        self.ids = ids
        self.names = np.array([f"{i}{sign}" for sign in ",|;" for i in range(ids)], object)

    def tokens(self, al: Alignment, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of the whole slice in order, number of pieces up to the end of each group)."""
        out = np.empty(len(a) + len(b), object)
        size_a, size_b = np.diff(al.a_end, prepend=0), np.diff(al.b_end, prepend=0)
        sign_a, sign_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        sign_a[al.a_end - 1], sign_b[al.b_end - 1] = 1, 2
        out[np.arange(len(a)) + np.repeat(al.b_end - size_b, size_a)] = self.names[a + sign_a * self.ids]
        out[np.arange(len(b)) + np.repeat(al.a_end, size_b)] = self.names[b + sign_b * self.ids]
        return out, al.a_end + al.b_end


class Aligner:
    """Both sides of a task."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.size_a, self.size_b = (np.array([len(x) for x in s.bytes], np.int64) for s in (a, b))
        self.encoder, self.writer = Encoder(a, b), GroupTexts(max(len(a.bytes), len(b.bytes)))

    def columns(self, texts: pa.Array, with_groups: bool) -> list[pa.Array]:
        """What ``align_documents`` returns of each text."""
        m, (fa, oa), (fb, ob) = len(texts), *self.encoder.encode(texts)
        al = align(np.cumsum(self.size_a[fa]), np.cumsum(self.size_b[fb]))
        pieces, ends = self.writer.tokens(al, fa, fb)
        cut = np.searchsorted(al.a_end, oa, side="right")
        cut[0] = 0
        at = np.concatenate([[0], ends])[cut].tolist()
        joined = ["".join(pieces[x:y].tolist())[:-1] for x, y in zip(at[:-1], at[1:])]
        # distinct pairs of each document, by pair
        doc = np.repeat(np.arange(m), np.diff(oa))[al.link_a]
        kinds = len(self.size_a) * len(self.size_b)
        key, links = np.unique(doc * kinds + fa[al.link_a] * len(self.size_b) + fb[al.link_b], return_counts=True)
        owner, pair = key // kinds, key % kinds
        at = np.searchsorted(owner, np.arange(m + 1))
        spans = list(zip(at[:-1].tolist(), at[1:].tolist()))
        return [*[pa.array(x.astype(np.int64)) for x in (np.diff(oa), np.diff(ob), np.diff(cut), np.bincount(doc, minlength=m))],
                pa.array([hashlib.sha256(s.encode()).hexdigest() if s else "" for s in joined], pa.string()),
                pa.array(np.diff(at).astype(np.int64)), pa.array([pack(np.diff(pair[x:y], prepend=0)) for x, y in spans], pa.binary()),
                pa.array([pack(links[x:y]) for x, y in spans], pa.binary())] + [pa.array(joined, pa.string())] * with_groups


# ---- Spark ------------------------------------------------------------------------

_DOC = ["n_a", "n_b", "n_groups", "n_links"]


def align_documents(docs: DataFrame, side_a: str, side_b: str, *, doc_id: str = "doc_id", text: str = "text",
                    with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the document's distinct id
    pairs (``pairs``, A id * size of B + B id) with their links (``links``), packed, ``kinds`` of them;
    on request ``groups``, the text that the digest is of."""
    key = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", key), *[T.StructField(n, T.LongType()) for n in _DOC], T.StructField("groups_sha256", T.StringType()),
                           T.StructField("kinds", T.LongType()), T.StructField("pairs", T.BinaryType()), T.StructField("links", T.BinaryType())]
                          + [T.StructField("groups", T.StringType())] * with_groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(ByteLevel(side_a), Pieces(side_b))
        for batch in batches:
            for part in text_slices(batch, 1, TEXT_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), *aligner.columns(part.column(1), with_groups)], names=schema.fieldNames())

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pair, links) of all documents of a batch with columns kinds, pairs, links."""
    kinds = batch.column("kinds").to_numpy()
    pairs = [np.cumsum(unpack(p, n), dtype=np.int64) for p, n in zip(batch.column("pairs").to_pylist(), kinds.tolist())]
    links = [unpack(c, n).astype(np.int64) for c, n in zip(batch.column("links").to_pylist(), kinds.tolist())]
    none = [np.zeros(0, np.int64)]
    return np.repeat(np.arange(len(kinds)), kinds), np.concatenate(pairs or none), np.concatenate(links or none)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): links of each id pair in the corpus; pre-summed in the tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, c = np.concatenate([key, *[h[0] for h in held]]), np.concatenate([n, *[h[1] for h in held]])
            o = np.argsort(k, kind="stable")
            k, c = k[o], c[o]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
            return k[first], np.add.reduceat(c, first) if len(first) else c

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                _, p, c = _unpacked(batch.slice(at, 1024))
                held.append((p, c))
                size += len(p)
                if size > SUM_PAIRS:
                    key, n = merged()
                    held, size = [], 0
                    if len(key) > SUM_PAIRS:
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["pair", "n"])
                        key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        key, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["pair", "n"])

    return aligned.select("kinds", "pairs", "links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _head(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, counts), by pair, of all pairs above the count that at most ``most`` pairs reach."""
    band = F.floor(F.log(F.col("n").cast("double")) * 20).alias("band")
    cut, got = None, 0
    for r in sorted(counts.groupBy(band).agg(F.count(F.lit(1)).alias("k")).collect(), key=lambda r: -r.band):  # a few hundred bands
        if got + r.k > most:
            break
        cut, got = r.band, got + r.k
    if cut is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    t = counts.where(band >= cut).toArrow()
    p, n = (np.asarray(t[c].combine_chunks()) for c in ("pair", "n"))
    o = np.argsort(p)
    return p[o], n[o]


def link_scores(aligned: DataFrame, counts: DataFrame, size_b: int, head: int = HEAD) -> DataFrame:
    """``aligned`` (a written table) with n_best and count_sum.

    A link is best if its pair's count is the highest of its B id."""
    spark = aligned.sparkSession
    top = counts.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("n").alias("n")).toArrow()  # one row per B id
    best = np.zeros(size_b, np.int64)
    best[np.asarray(top["b"].combine_chunks())] = np.asarray(top["n"].combine_chunks())
    table = spark.sparkContext.broadcast((*_head(counts, head), best))  # ``head`` pairs and one number per B id
    keep = ["doc_id", *_DOC, "groups_sha256"]
    schema = T.StructType([T.StructField("rid", T.LongType()), *[aligned.schema[c] for c in keep],
                           *[T.StructField(c, T.LongType()) for c in ("n_best", "count_sum", "pair", "k")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        pairs, n, most = table.value
        nxt = TaskContext.get().partitionId() << 36
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                m = part.num_rows
                row, p, k = _unpacked(part)
                i = np.minimum(np.searchsorted(pairs, p), max(len(pairs) - 1, 0))
                there = pairs[i] == p if len(pairs) else np.zeros(len(p), bool)
                r, c, kk = row[there], n[i[there]] if len(pairs) else p[:0], k[there]
                is_best = c == most[p[there] % size_b]
                sums = [np.bincount(r, weights=w, minlength=m).astype(np.int64) for w in (kk * is_best, )]
                total = np.zeros(m, np.int64)
                np.add.at(total, r, kk * c)  # whole numbers, beyond what a double holds
                rid = np.arange(nxt, nxt + m)
                nxt += m
                rest, none = np.flatnonzero(~there), pa.nulls(m, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(rid), *[part.column(x) for x in keep], pa.array(sums[0]), pa.array(total), none, none],
                                                 names=schema.fieldNames())
                if len(rest):
                    empty = [pa.nulls(len(rest), part.column(x).type) for x in keep] + [pa.nulls(len(rest), pa.int64())] * 2
                    yield pa.RecordBatch.from_arrays([pa.array(rid[row[rest]]), *empty, pa.array(p[rest]), pa.array(k[rest])], names=schema.fieldNames())

    rows = freeze(aligned.select("kinds", "pairs", "links", *keep).mapInArrow(run, schema), "align-rows")
    tops = spark.createDataFrame([(int(i), int(best[i])) for i in np.flatnonzero(best)], "b long, top long")  # one row per B id
    rest = (rows.where("pair is not null").select("rid", "pair", "k").join(counts, "pair")
            .join(F.broadcast(tops), F.col("pair") % size_b == F.col("b")).groupBy("rid")
            .agg(F.sum(F.when(F.col("n") == F.col("top"), F.col("k")).otherwise(0)).alias("b2"), F.sum(F.col("k") * F.col("n")).alias("s2")))
    return (rows.where("pair is null").drop("pair", "k").join(rest, "rid", "left")
            .select(*keep, (F.col("n_best") + F.coalesce("b2", F.lit(0))).alias("n_best"),
                    (F.col("count_sum") + F.coalesce("s2", F.lit(0))).alias("count_sum")))


def alignment(docs: DataFrame, side_a: str, side_b: str, *, head: int = HEAD, **columns) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 per document."""
    aligned = freeze(align_documents(docs, side_a, side_b, **columns), "align-documents")
    counts = freeze(pair_counts(aligned), "align-pairs")
    return link_scores(aligned, counts, len(Pieces(side_b).bytes), head).select(
        "doc_id", *_DOC, "n_best", "count_sum", "groups_sha256")
