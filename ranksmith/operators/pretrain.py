"""Masked-next-token pre-training text preparation.

Rows keep a dense ``idx`` (file order) from the ordered index, so every
position-dependent step - percentage split, 1,000-row packing batches,
head(n) - is a filter or an equi-key on columns, never a window over the
whole table. Packing moves each row once, to its batch of 1,000 rows, and cuts
the batch's ids inside its group. Token ids, masks and scores of positions are
made by Arrow batches, so that no row per token exists.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.det import position_uniforms
from ..functions.text import strip
from ..functions.vectors import log_sum_exp
from .corpus import free_names, ordered_index

WS_SPLIT = r"[\s\p{Z}\x0B\x1C-\x1F\x85]+"
#: Positions whose masks are drawn at once.
POSITIONS = 1 << 18
PAD_ID, MASK_ID, N_SPECIAL, VOCAB = 0, 1, 10, 30000


def with_index(lines: DataFrame, order_cols: list[str]) -> DataFrame:
    return ordered_index(lines, order_cols, idx="idx")


def percent_split(indexed: DataFrame, percent: float) -> DataFrame:
    """First ``percent``% of rows (by idx) -> 'validation', the rest
    'train'; the cut is round-half-up of n * p / 100."""
    n = indexed.agg(F.count(F.lit(1)).alias("_n"))
    cut = F.floor(F.col("_n") * F.lit(percent) / 100 + F.lit(0.5))
    return (indexed.crossJoin(F.broadcast(n))  # one row
            .withColumn("split", F.when(F.col("idx") < cut, "validation").otherwise("train")).drop("_n"))


def drop_blank_lines(df: DataFrame, col: str = "line") -> DataFrame:
    """C11: remove empty and whitespace-only lines."""
    return df.where(F.length(F.col(col)) > 0).where(F.length(strip(F.col(col))) > 0)


def tokens(text) -> Column:
    """Whitespace tokens (a user tokenizer can replace this)."""
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(t, WS_SPLIT), lambda x: F.length(x) > 0)


def token_ids(toks: Column) -> Column:
    """Hashed token ids in [N_SPECIAL, N_SPECIAL + VOCAB)."""
    return F.transform(toks, lambda t: (F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"),
                                               F.lit(VOCAB)) + N_SPECIAL).cast("int"))


def with_token_ids(df: DataFrame, col: str = "line", batch_rows: int = 1024) -> DataFrame:
    """``ids`` = :func:`token_ids` of :func:`tokens` of a column, by Arrow batches: a batch's distinct tokens are hashed once."""
    kept = [c for c in df.columns if c != "ids"]
    schema = T.StructType([*df.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                words = pc.split_pattern_regex(part.column(len(kept)).cast(pa.large_string()), WS_SPLIT)
                code = words.flatten().dictionary_encode()
                names = code.dictionary.to_pylist()
                known = np.array([int.from_bytes(hashlib.md5(t.encode()).digest()[:4]) % VOCAB + N_SPECIAL for t in names], np.int32)
                codes = code.indices.to_numpy()
                full = np.array([t != "" for t in names], bool)[codes] if names else np.zeros(0, bool)
                ends = np.concatenate([[0], np.cumsum(words.value_lengths().fill_null(0).to_numpy())])
                ends = np.concatenate([[0], np.cumsum(full)])[ends].astype(np.int32)  # empty tokens are left out
                ids = pa.ListArray.from_arrays(ends, pa.array(known[codes[full]] if names else known), mask=words.is_null())
                yield pa.RecordBatch.from_arrays([*part.columns[:len(kept)], ids], names=[*kept, "ids"])

    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{col}`").alias(free_names(df, "_text")[0])).mapInArrow(run, schema)


def tokenize(df: DataFrame, make_tokenizer: Callable[[], Callable], col: str = "line", max_len: int | None = None,
             batch_rows: int = 1024) -> DataFrame:
    """J3 with a user tokenizer: adds ``ids`` ARRAY<INT> and ``special`` ARRAY<BOOLEAN>.

    ``make_tokenizer()`` runs once per Python worker task and returns
    ``encode(texts, max_len) -> (ids, special, lengths)`` for an Arrow array of
    texts: the ids of all texts in a row, a flag for each (true: never masked), and
    the number of ids of each text. The tokenizer truncates, since only it knows
    which special ids stay. A null text is an empty one. Columns called ids or
    special before are replaced; a wrong length of the result raises."""
    kept = [c for c in df.columns if c not in ("ids", "special")]
    schema = T.StructType([*df.select(*[F.col(f"`{c}`") for c in kept]).schema.fields,
                           T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("special", T.ArrayType(T.BooleanType()))])

    def run(batches):
        encode = make_tokenizer()
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                ids, special, lengths = encode(part.column(len(kept)), max_len)
                if len(lengths) != part.num_rows or len(ids) != len(special) or len(ids) != int(np.sum(lengths)):
                    raise RuntimeError(f"tokenizer returned {len(lengths)} texts, {len(ids)} ids and {len(special)} flags for {part.num_rows} texts")
                ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.asarray(ids, np.int32))),
                         pa.ListArray.from_arrays(ends, pa.array(np.asarray(special, bool)))]
                yield pa.RecordBatch.from_arrays([*part.columns[:len(kept)], *lists], names=[*kept, "ids", "special"])

    texts = df.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{col}`"), F.lit("")).alias(free_names(df, "_text")[0]))
    return texts.mapInArrow(run, schema)


def byte_tokenizer(begin: int = 256, end: int = 257):
    """A byte-level tokenizer for :func:`tokenize`: the UTF-8 bytes of a text between two special ids."""
    def make():
        def encode(texts, max_len):
            texts = texts.cast(pa.large_string())
            at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            size = np.diff(at)
            if max_len is not None:
                size = np.minimum(size, max(max_len - 2, 0))
            lengths = size + 2
            first = np.cumsum(lengths) - lengths
            special = np.zeros(int(lengths.sum()), bool)
            special[first] = special[first + lengths - 1] = True
            ids = np.empty(len(special), np.int32)
            ids[first], ids[first + lengths - 1] = begin, end
            ids[~special] = data[np.repeat(at[:-1] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
            return ids, special, lengths
        return encode
    return make


def line_mode(df: DataFrame, max_len: int, col: str = "line", make_tokenizer: Callable[[], Callable] | None = None) -> DataFrame:
    """Non-blank lines, tokenised, truncated to ``max_len``; by a user tokenizer if one is given."""
    if make_tokenizer is not None:
        return tokenize(drop_blank_lines(df, col), make_tokenizer, col, max_len)
    return drop_blank_lines(df, col).withColumn("ids", F.slice(token_ids(tokens(col)), 1, max_len))


def pack(df: DataFrame, block: int, batch_rows: int = 1000) -> DataFrame:
    """Concatenate the ids of each ``batch_rows`` consecutive rows (by
    idx), cut into blocks of ``block`` ids, drop each batch's remainder.
    Output: batch_no, block_no, ids ARRAY<INT> (length ``block``), and ``special``
    cut the same way if the rows have it."""
    lists = ["ids", *[c for c in ("special",) if c in df.columns]]
    d = df.select("idx", *lists, F.floor(F.col("idx") / batch_rows).cast("long").alias("batch_no"))
    schema = T.StructType([T.StructField("batch_no", T.LongType()), T.StructField("block_no", T.LongType()), *[d.schema[c] for c in lists]])

    def cut(rows: pa.Table) -> pa.Table:
        """Blocks of one batch: a group of at most ``batch_rows`` rows."""
        rows = rows.take(pc.sort_indices(rows["idx"]))
        flat = [pc.list_flatten(rows[c]).combine_chunks() for c in lists]
        n = len(flat[0]) // block
        ends = pa.array(np.arange(0, (n + 1) * block, block, dtype=np.int32))
        numbers = [pa.array([rows["batch_no"][0].as_py()] * n, pa.int64()), pa.array(np.arange(n))]
        return pa.Table.from_arrays([*numbers, *[pa.ListArray.from_arrays(ends, f.slice(0, n * block)) for f in flat]],
                                    names=["batch_no", "block_no", *lists])

    return d.groupBy("batch_no").applyInArrow(cut, schema)


def head(df: DataFrame, n: int | None, order_col: str = "idx") -> DataFrame:
    """First n rows in order (a filter on the dense index)."""
    return df if n is None else df.where(F.col(order_col) < n)


def _masked(blocks: DataFrame, p: float, seed: int, key_cols, changed) -> DataFrame:
    """Columns labels and inputs: where masked, the id and what ``changed`` (draws, ids) makes of it; else -100 and the id.

    A position is masked by its draw unless the ``special`` flags tell it or, if the blocks have none, its id is
    below N_SPECIAL. The draws are u01(seed, keys, kind, position); ``draws`` (kind, which masked positions) gives them."""
    kept = [c for c in blocks.columns if c not in ("labels", "inputs")]
    flagged = "special" in kept
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([*blocks.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, T.StructField("labels", ints), T.StructField("inputs", ints)])
    key = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key_cols])
    at_ids, at_special = kept.index("ids"), kept.index("special") if flagged else None

    def run(batches):
        for batch in batches:
            longest = max(1, pc.max(batch.column(at_ids).value_lengths()).as_py() or 1) if batch.num_rows else 1
            step = max(1, POSITIONS // longest)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                lists, keys = part.column(at_ids), part.column(len(kept))
                n = lists.value_lengths().fill_null(0).to_numpy()
                flat = lists.flatten()
                known = flat.is_valid().to_numpy(zero_copy_only=False)
                ids = flat.fill_null(0).to_numpy().astype(np.int32)
                row = np.repeat(np.arange(len(n)), n)
                pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                draws = lambda kind, which: position_uniforms(pc.binary_join_element_wise(keys, kind, ":"), row[which], pos[which])
                if flagged:
                    special = part.column(at_special).flatten().fill_null(True).to_numpy(zero_copy_only=False)
                    if len(special) != len(ids):
                        raise ValueError(f"{len(special)} flags for {len(ids)} ids")
                else:
                    special = ~known | (ids < N_SPECIAL)
                hit = np.flatnonzero(~special)
                hit = hit[draws("m", hit) < p]
                labels, inputs = np.full(len(ids), -100, np.int32), ids.copy()
                labels[hit] = ids[hit]
                no_label = np.zeros(len(ids), bool)
                no_label[hit] = ~known[hit]
                inputs[hit], same = changed(lambda kind, which: draws(kind, hit[which]), ids[hit])
                no_input = ~known
                no_input[hit[~same]] = False
                ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                out = [pa.ListArray.from_arrays(ends, pa.array(v, mask=none), mask=lists.is_null()) for v, none in ((labels, no_label), (inputs, no_input))]
                yield pa.RecordBatch.from_arrays([*part.columns[:len(kept)], *out], names=[*kept, "labels", "inputs"])

    return blocks.select(*[F.col(f"`{c}`") for c in kept], key.alias(free_names(blocks, "_key")[0])).mapInArrow(run, schema)


def mask_full(blocks: DataFrame, p: float, seed: int, key_cols=("batch_no", "block_no"), mask_id: int = MASK_ID) -> DataFrame:
    """Every non-special id masked with chance p; input = ``mask_id`` where
    masked; label = id where masked else -100."""
    return _masked(blocks, p, seed, key_cols, lambda draws, ids: (np.full(len(ids), mask_id, np.int32), np.zeros(len(ids), bool)))


def mask_default(blocks: DataFrame, p: float, seed: int, key_cols=("batch_no", "block_no"), mask_id: int = MASK_ID,
                 vocab: tuple[int, int] = (N_SPECIAL, VOCAB)) -> DataFrame:
    """Masked positions become ``mask_id`` 80%, a random id 10%, unchanged 10%.
    ``vocab``: first and number of the ids to draw from."""
    def changed(draws, ids):
        r = draws("r", slice(None))
        out = np.where(r < 0.8, np.int32(mask_id), ids).astype(np.int32)
        other = np.flatnonzero((r >= 0.8) & (r < 0.9))
        out[other] = np.floor(draws("v", other) * vocab[1]).astype(np.int32) + vocab[0]
        return out, r >= 0.9

    return _masked(blocks, p, seed, key_cols, changed)


# Scores come as a row per candidate (keys, pos, token, score) or as a row per sequence with ``logits``
# ARRAY<STRUCT<tokens ARRAY<INT>, scores ARRAY<DOUBLE>>>, the candidates of each position, beside its ``labels``
# ARRAY<INT>. In that form the label at i + 1 (G8) is in the row of position i and nothing is joined or shuffled.


def argmax_token(logits: DataFrame, keys=("seq", "pos")) -> DataFrame:
    """Best token per position from (keys, token, score), or ``preds`` ARRAY<INT> of sequences instead of ``logits``."""
    if "logits" in logits.columns:
        best = lambda c: F.get(c["tokens"], (F.array_position(c["scores"], F.array_max(c["scores"])) - 1).cast("int"))
        return logits.withColumn("preds", F.transform("logits", best)).drop("logits")
    return logits.groupBy(*keys).agg(F.max_by("token", "score").alias("pred"))


def masked_accuracy(pred: DataFrame, labels: DataFrame | None = None, keys=("seq",)) -> DataFrame:
    """Prediction at position i vs label at i + 1 where label != -100
    (the G8 shift join), averaged. Without ``labels``: of sequences (preds, labels)."""
    if labels is None:
        masked = lambda x, i: (x != -100) & (i > 0) & (i <= F.size("preds"))
        right = lambda x, i: masked(x, i) & (F.get("preds", i - 1) == x)
        s = pred.select(F.size(F.filter("labels", masked)).alias("n"), F.size(F.filter("labels", right)).alias("right"))
        return s.agg((F.sum("right") / F.sum("n")).alias("accuracy"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
    l = labels.where(F.col("label") != -100).withColumn("pos", F.col("pos") - 1)
    j = pred.join(l, [*keys, "pos"], "inner")
    return j.agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"),
                 F.count(F.lit(1)).alias("n"))


def masked_loss(logits: DataFrame, labels: DataFrame | None = None, keys=("seq",)) -> DataFrame:
    """Cross-entropy of every masked position (keys, pos, loss): log-sum-exp of the scores at
    position i minus the score of the label at i + 1 (G8), shifted by the largest score.

    Only positions with a label are scored. A label without a score at its position has an
    infinite loss. A position's scores are summed by partial aggregates, not gathered. Without ``labels``: of sequences
    (keys, logits, labels), whose losses are made inside the row."""
    if labels is None:
        def loss(label: Column, c: Column) -> Column:
            own = F.array_max(F.zip_with(c["tokens"], c["scores"], lambda t, s: F.when(t == label, s)))
            return F.coalesce(log_sum_exp(F.array_compact(c["scores"])) - own, F.lit(float("inf")))

        at = F.transform("labels", lambda x, i: F.when(
            (x != -100) & (i > 0) & (F.size(F.get("logits", i - 1)["scores"]) > 0),
            F.struct((i - 1).cast("long").alias("pos"), loss(x, F.get("logits", i - 1)).alias("loss"))))
        return logits.select(*keys, F.explode(F.array_compact(at)).alias("x")).select(*keys, "x.pos", "x.loss")
    l = labels.where(F.col("label") != -100).select(*keys, (F.col("pos") - 1).alias("pos"), "label")
    j = logits.join(l, [*keys, "pos"])
    top = j.groupBy(*keys, "pos", "label").agg(F.max("score").alias("top"))
    s = j.join(top, [*keys, "pos", "label"]).groupBy(*keys, "pos", "label").agg(
        F.first("top").alias("top"), F.sum(F.exp(F.col("score") - F.col("top"))).alias("z"),
        F.max(F.when(F.col("token") == F.col("label"), F.col("score"))).alias("own"))
    return s.select(*keys, "pos", F.coalesce(F.col("top") + F.log("z") - F.col("own"), F.lit(float("inf"))).alias("loss"))


def perplexity(losses: DataFrame, col: str = "loss", n: str | None = None) -> DataFrame:
    """exp(mean loss); infinity on overflow. ``n``: a column with the number of rows, from the same pass."""
    return losses.agg(F.exp(F.avg(col)).alias("perplexity"), *([F.count(F.lit(1)).alias(n)] if n else []))
