"""Filter interaction audit on a sparse document-term matrix.

Method
1. Documents are split into words and encoded with a local dictionary per
   group of at most ``GROUP_BYTES`` of text: rows of word counts (CSR) with local codes.
2. The local dictionaries are dealt by word hash to buckets. A bucket's task
   gives each of its words one number, so that word numbers are global; it
   sends every group the numbers of its words, not the words themselves.
3. A group's shards are recoded with these numbers: CSR shards of at most
   ``SHARD_BYTES`` of text whose columns are global (``term_shards``).
4. Row sums (words) and non-zero counts (distinct words) of the shards decide
   filters A and B. Capitals, marks and copies (C, D, E) are attached.
5. Documents are counted by (part, set of failed filters, labels); every order
   and step follows from these counts, at most 128 for each part.

Copies (E) need no join on the text: documents of one text are counted as
copies, and the ones with the text's smallest id are taken out again, by
(digest, id). A text that a third of all documents share is thus never one group.

Defined cases
* null or empty text: no words (fails A, not B, C or D); texts are equal if their SHA-256 is;
* null doc_id: not a copy of any row and no row's original, never labelled;
  repeated ids: each row counts, equal rows of the smallest id are no copies;
* null source: the part '', as a source that is the empty string;
* labels: of several rows of an id, one with the value 1 is enough; null is not 1;
* very long texts are a shard of their own; an empty table gives an empty result;
* other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeze, text_slices

FILTERS = "ABCDE"
#: A: least words. B: least distinct words, C: most capitals, both in hundredths.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
MARKS = "[#$%&*|]"
#: Text of a CSR shard, of a group with one local dictionary, and words of a dictionary bucket (about).
SHARD_BYTES, GROUP_BYTES, BUCKET_WORDS = 4 << 20, 32 << 20, 1_000_000
#: A word's hash is dealt to FINE buckets, which are folded to the number in use; a dictionary is written in PIECES.
FINE, PIECES = 1 << 20, 64

_DOC = [("doc_id", "array<long>", pa.list_(pa.int64())), ("part", "array<string>", pa.list_(pa.string())),
        ("digest", "array<binary>", pa.list_(pa.binary())), ("capitals", "array<long>", pa.list_(pa.int64())),
        ("points", "array<long>", pa.list_(pa.int64())), ("marked", "array<boolean>", pa.list_(pa.bool_()))]
_CSR = [("indptr", "binary", pa.binary()), ("indices", "binary", pa.binary()), ("data", "binary", pa.binary())]
_WORDS = [("piece", "int", pa.int32()), ("size", "long", pa.int64()), ("codes", "binary", pa.binary()), ("words", "binary", pa.binary())]
_LOCAL = [("grp", "long", pa.int64()), ("shard", "int", pa.int32()), *_DOC, *_CSR, *_WORDS]


def _schema(fields: list) -> str:
    return ", ".join(f"{n} {t}" for n, t, _ in fields)


def _batch(fields: list, row: dict) -> pa.RecordBatch:
    """One row; Arrow arrays are its lists."""
    one = lambda v, t: (pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v.cast(t.value_type)) if isinstance(v, pa.Array)
                        else pa.array([v], t))
    return pa.RecordBatch.from_arrays([one(row.get(n), t) for n, _, t in fields], names=[n for n, _, _ in fields])


def _bytes(values: np.ndarray) -> bytes:
    import zstandard
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _numbers(data: bytes, kind) -> np.ndarray:
    import zstandard
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def csr(codes: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indptr, indices, data) of the counts of each row's codes; indices rise within a row."""
    n = len(offs) - 1
    key = np.repeat(np.arange(n), np.diff(offs)) * np.int64(max(width, 1)) + codes
    key, count = np.unique(key, return_counts=True)
    row = key // max(width, 1)
    return np.searchsorted(row, np.arange(n + 1)), key % max(width, 1), count


def _text_columns(texts: pa.Array) -> dict:
    """What C, D and E need of each text."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
    at = at - at[0]
    capitals = np.searchsorted(np.flatnonzero((raw - 65) < 26), at)  # unsigned: below 65 wraps around
    view = memoryview(raw)
    return {"capitals": pa.array(np.diff(capitals)), "points": pc.utf8_length(texts), "marked": pc.match_substring_regex(texts, MARKS),
            "digest": pa.array([hashlib.sha256(view[a:b]).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())}


def _encode(docs: DataFrame, shard_bytes: int, group_bytes: int) -> DataFrame:
    """Rows of local CSR shards (piece null) and of local dictionaries (shard null)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        grp, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for part in text_slices(batch, 2, shard_bytes):
                texts = pc.fill_null(part.column(2), "")
                lists = pc.ascii_split_whitespace(texts)
                enc = lists.flatten().dictionary_encode()
                held.append(({"doc_id": part.column(0), "part": part.column(1), **_text_columns(texts)}, np.asarray(enc.indices),
                             enc.dictionary, np.diff(np.asarray(lists.offsets).astype(np.int64))))
                size += texts.nbytes
                if size >= group_bytes:
                    yield from group(grp, held)
                    grp, held, size = grp + 1, [], 0
        if held:
            yield from group(grp, held)

    def group(grp: int, held: list) -> Iterator[pa.RecordBatch]:
        import xxhash
        enc = pa.concat_arrays([words for _, _, words, _ in held]).dictionary_encode()  # of the slices' dictionaries
        codes, names = np.asarray(enc.indices).astype(np.int64), enc.dictionary
        blank, at = pc.index(names, "").as_py(), 0  # white space at an end of a text splits off an empty string
        for shard, (columns, local, words, sizes) in enumerate(held):
            mine = codes[at:at + len(words)][local]
            at += len(words)
            word = mine != blank
            offs = np.concatenate([[0], np.cumsum(word)])[np.concatenate([[0], np.cumsum(sizes)])]
            ptr, idx, cnt = csr(mine[word], offs, len(names))
            yield _batch(_LOCAL, {"grp": grp, "shard": shard, **columns, "indptr": _bytes(ptr.astype(np.int32)),
                                  "indices": _bytes(idx.astype(np.int32)), "data": _bytes(cnt.astype(np.int32))})
        bucket = np.array([xxhash.xxh64_intdigest(w) % FINE for w in names.to_pylist()], np.int64)
        order = np.argsort(bucket, kind="stable")
        order = order[order != blank]
        edges = np.searchsorted(bucket[order] * PIECES // FINE, np.arange(PIECES + 1))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), names.take(pa.array(order))), " ")
        for k in range(PIECES):
            x = order[edges[k]:edges[k + 1]]
            if len(x):
                yield _batch(_LOCAL, {"grp": grp, "piece": k, "size": len(x), "codes": _bytes(x.astype(np.int32)),
                                      "words": _packed(joined[k].as_buffer())})

    return docs.mapInArrow(run, _schema(_LOCAL))


def _packed(joined) -> bytes:
    """Words hold no white space, so a space parts them."""
    import zstandard
    return zstandard.ZstdCompressor(level=1).compress(joined)


def _number_words(local: DataFrame, buckets: int) -> DataFrame:
    """(grp, bucket, codes, ids, size): numbers, within the bucket, of the group's
    words; ``size`` is the number of the bucket's words so far, largest in its last row."""
    def fan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard
        for b in batches:
            for grp, codes, names in zip(*(c.to_pylist() for c in b.columns)):
                names = zstandard.ZstdDecompressor().decompress(names).split(b" ")
                codes = _numbers(codes, np.int32)
                at = np.array([xxhash.xxh64_intdigest(w) % FINE for w in names], np.int64) * buckets // FINE
                order = np.argsort(at, kind="stable")
                cuts = np.flatnonzero(np.diff(at[order], prepend=-1))
                rows = [(grp, int(at[x[0]]), _bytes(codes[x]), _packed(b" ".join([names[i] for i in x.tolist()]))) for x in np.split(order, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in
                                                  enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["grp", "bucket", "codes", "words"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        key, known = None, {}
        for b in batches:
            out = []
            for grp, bucket, codes, names in zip(*(c.to_pylist() for c in b.columns)):
                if bucket != key:
                    key, known = bucket, {}
                ids = [known.setdefault(w, len(known)) for w in zstandard.ZstdDecompressor().decompress(names).split(b" ")]
                out.append((grp, bucket, codes, _bytes(np.array(ids, np.int64)), len(known)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in
                                              enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64()))],
                                             names=["grp", "bucket", "codes", "ids", "size"])

    dealt = local.where("shard is null").select("grp", "codes", "words").mapInArrow(fan, "grp long, bucket int, codes binary, words binary")
    return (dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket")
            .mapInArrow(number, "grp long, bucket int, codes binary, ids binary, size long"))


_SHARD = [("grp", "long", pa.int64()), ("shard", "int", pa.int32()), *_DOC, ("indptr", "array<int>", pa.list_(pa.int32())),
          ("indices", "array<long>", pa.list_(pa.int64())), ("data", "array<int>", pa.list_(pa.int32()))]


def term_shards(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "source", shard_bytes: int = SHARD_BYTES,
                group_bytes: int = GROUP_BYTES, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """The document-term matrix: one row per CSR shard.

    ``indptr``, ``indices`` (global word numbers, dense from 0) and ``data`` (counts)
    are the shard's matrix; ``doc_id``, ``part``, ``digest``, ``capitals``, ``points``
    and ``marked`` have one entry per matrix row."""
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                      F.col(text).alias("text"))
    local = freeze(_encode(src, shard_bytes, group_bytes), "terms-local")
    spark = docs.sparkSession
    total = local.agg(F.sum("size")).first()[0] or 0
    buckets = min(FINE, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_words)))
    numbered = freeze(_number_words(local, buckets), "terms-numbers")
    sizes = {r.bucket: r.n for r in numbered.groupBy("bucket").agg(F.max("size").alias("n")).collect()}  # one row per bucket
    first = np.concatenate([[0], np.cumsum([sizes.get(b, 0) for b in range(buckets)])])
    start = spark.sparkContext.broadcast(first)

    def recode(left: pa.Table, right: pa.Table) -> pa.Table:
        got = [(_numbers(c, np.int32), _numbers(i, np.int64) + start.value[b])
               for b, c, i in zip(right["bucket"].to_pylist(), right["codes"].to_pylist(), right["ids"].to_pylist())]
        table = np.zeros(max((int(c.max()) + 1 for c, _ in got), default=0), np.int64)
        for c, i in got:
            table[c] = i
        out: dict[str, list] = {"indptr": [], "indices": [], "data": []}
        for row in zip(*(left[n].to_pylist() for n in out)):
            ptr, idx, cnt = (_numbers(x, np.int32) for x in row)
            idx = table[idx]
            order = np.argsort(np.repeat(np.arange(len(ptr) - 1), np.diff(ptr)) * int(start.value[-1]) + idx)  # rows keep their places
            for n, v in zip(out, (ptr, idx[order], cnt[order])):
                out[n].append(v)
        cols = {n: pa.chunked_array([pa.array(out[n], t)]) if n in out else left[n] for n, _, t in _SHARD}
        return pa.table({n: cols[n].cast(t) for n, _, t in _SHARD})

    shards = local.where("shard is not null").select(*[n for n, _, _ in _SHARD])
    return (shards.groupBy("grp").cogroup(numbered.select("grp", "bucket", "codes", "ids").groupBy("grp"))
            .applyInArrow(recode, _schema(_SHARD)))


def text_flags(shards: DataFrame) -> DataFrame:
    """doc_id, part, digest, n_words, n_distinct, mask per document: bits 1, 2, 4, 8 for failing A to D."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                col = {n: b.column(i)[k].values for i, n in enumerate(b.schema.names)}
                ptr = np.asarray(col["indptr"]).astype(np.int64)
                sums = np.concatenate([[0], np.cumsum(np.asarray(col["data"]), dtype=np.int64)])
                n, nnz = sums[ptr[1:]] - sums[ptr[:-1]], np.diff(ptr)
                caps, points = np.asarray(col["capitals"]), np.asarray(col["points"])
                mask = ((n < LEAST_WORDS) * 1 + (100 * nnz < LEAST_DISTINCT * n) * 2 + (100 * caps > MOST_CAPITALS * points) * 4
                        + np.asarray(col["marked"].to_numpy(zero_copy_only=False), bool) * 8)
                yield pa.RecordBatch.from_arrays([col["doc_id"], col["part"], col["digest"], pa.array(n), pa.array(nnz), pa.array(mask.astype(np.int32))],
                                                 names=["doc_id", "part", "digest", "n_words", "n_distinct", "mask"])

    use = ["doc_id", "part", "digest", "indptr", "data", "capitals", "points", "marked"]
    return shards.select(*use).mapInArrow(run, "doc_id long, part string, digest binary, n_words long, n_distinct long, mask int")


def fail_counts(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents by their set of failed filters (16: copy) and labels."""
    rows = freeze(flags.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")), "audit-texts")
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c)
    lab = (labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
           .agg(is_one("quality"), is_one("toxic")))
    got = rows.where(F.col("doc_id").isNotNull()).join(lab, "doc_id", "left")
    bare = rows.where(F.col("doc_id").isNull()).withColumns({"quality": F.lit(0), "toxic": F.lit(0)})
    rows = freeze(got.select(*bare.columns).unionByName(bare)
                  .withColumns({"good": F.coalesce("quality", F.lit(0)), "toxic": F.coalesce("toxic", F.lit(0))}).drop("quality"), "audit-rows")
    known, bare = rows.where(F.col("doc_id").isNotNull()), rows.where(F.col("doc_id").isNull())
    low = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    firsts = known.join(low, ["digest", "doc_id"], "left_semi")
    cols = lambda df, mask, n: df.select("part", mask.cast("int").alias("mask"), "good", "toxic", n.alias("n"))
    m, n = F.col("mask"), F.col("n")
    every = (cols(known, m.bitwiseOR(16), n).unionByName(cols(firsts, m, n)).unionByName(cols(firsts, m.bitwiseOR(16), -n))
             .unionByName(cols(bare, m, n)))
    return every.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n <> 0")


def order_tables() -> tuple[list[str], list[int], dict[str, np.ndarray]]:
    """All (order, step) and, for each, which of the 32 masks are kept, removed,
    redundant or unique, and how many of the 120 orders remove the mask by the step's filter."""
    orders, steps, rows = [], [], {k: [] for k in ("kept", "removed", "redundant", "unique_fails", "shapley")}
    masks = np.arange(1 << len(FILTERS))
    bits = np.array([bin(m).count("1") for m in masks])
    total = len(list(itertools.permutations(FILTERS)))
    for order in itertools.permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            fails, earlier = masks & bit > 0, masks & before > 0
            orders.append("".join(order))
            steps.append(step)
            rows["kept"].append((masks & (before | bit)) == 0)
            rows["removed"].append(fails & ~earlier)
            rows["redundant"].append(fails & earlier)
            rows["unique_fails"].append(masks == bit)
            rows["shapley"].append(np.where(fails, total // np.maximum(bits, 1), 0))  # first of its failed filters
            before |= bit
    return orders, steps, {k: np.array(v).astype(np.int64) for k, v in rows.items()}


_OUT = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def order_effects(counts: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of every order's steps; 600 rows per part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, steps, t = order_tables()
        k = len(orders)
        for b in batches:
            for part, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = np.zeros((3, 1 << len(FILTERS)), np.int64)
                for c in cells:
                    n[0, c["mask"]] += c["n"]
                    n[1, c["mask"]] += c["n"] * c["good"]
                    n[2, c["mask"]] += c["n"] * c["toxic"]
                cols = {x: t[x] @ n[0] for x in ("kept", "removed", "redundant", "unique_fails", "shapley")}
                cols |= {"good_lost": t["removed"] @ n[1], "toxic_lost": t["removed"] @ n[2]}
                yield pa.RecordBatch.from_arrays([pa.array([part] * k), pa.array(orders), pa.array(steps, pa.int32()), *[pa.array(cols[x]) for x in _OUT]],
                                                 names=["part", "filter_order", "step", *_OUT])

    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("cells"))  # 128 per part at most
    return cells.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{x} long" for x in _OUT))


def audit(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """What each filter removes, in every order of the five, per part."""
    return order_effects(fail_counts(text_flags(term_shards(docs, **options)), labels))
