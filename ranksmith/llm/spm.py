"""SentencePiece encoding and decoding with a distinct-chunk table.

Method: the text is written with whitespace markers and cut in front of every
run of markers ("marked words": markers, then everything up to the next
marker). When no piece of the model has a marker behind another character, no
merge can cross such a cut, so the ids of a text are the ids of its chunks in
order. A task keeps a table of distinct chunks: each is segmented once by the
library, and the ids are joined back by position. ``chunkable`` checks the
model; a model whose pieces do cross markers, whose normaliser rewrites text
or that trims spaces is encoded text by text instead.

The table lives in the task and is emptied at a fixed size, since a
corpus-wide one would shuffle every token of every document; only rows leave
the task.

Defined cases
* null text: as the empty text, no ids, decoded to the empty text;
* texts of spaces only, literal U+2581, NUL, control and 4-byte characters: as the library;
* very long texts are cut into chunks as any other; a long chunk is one call;
* repeated rows are encoded row by row; an empty table gives an empty result;
* other columns are ignored by ``encode`` (two input columns are read).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

MARK = "\u2581"
_RUN = re.compile(" +")
#: Distinct chunks a task keeps before it starts a new table.
TABLE_CHUNKS = 600_000


def load(path: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


def chunkable(sp) -> bool:
    """True if chunks may be encoded one by one: no piece has a marker behind
    another character, and the model neither trims nor rewrites text, and puts one marker in front."""
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if MARK in piece.lstrip(MARK):
            return False
    probe = "  a  \ufb01\u3000\u212b e\u0301 "
    return sp.normalize(probe) == MARK + probe.replace(" ", MARK)


class ChunkTable:
    """Distinct marked word -> (number of ids, ids as decimal text, decoded text, ids).

    A chunk is keyed by its text behind the first marker, with the other
    markers as spaces: the library puts that first marker in front itself.
    The empty key is a lone marker. Decoding a chunk gives its text without
    the first space, so a document is its chunks' texts joined by one space.
    """

    def __init__(self, sp, limit: int = TABLE_CHUNKS, with_ids: bool = False):
        self.sp, self.limit, self.with_ids, self.known = sp, limit, with_ids, {}
        self.text = [str(i) for i in range(sp.get_piece_size())]

    def lookup(self, keys: list[str]) -> list[tuple]:
        """Entries of the (distinct) keys."""
        if len(self.known) + len(keys) > self.limit:
            self.known = {}
        known, text = self.known, self.text
        new = [k for k in keys if k not in known]
        if new:
            ids = self.sp.encode(new, num_threads=1)
            ids = [v if k else [self.sp.piece_to_id(MARK)] for k, v in zip(new, ids)]
            back = self.sp.decode(ids, num_threads=1)
            for k, v, d in zip(new, ids, back):
                known[k] = (len(v), ",".join([text[i] for i in v]), d, v if self.with_ids else None)
        return [known[k] for k in keys]


def encode_texts(sp, texts: pa.Array, table: ChunkTable | None) -> Iterator[tuple]:
    """(number of ids, ids as decimal text, decoded text, ids or None) of each text, in order."""
    texts = pc.fill_null(texts, "")
    if table is None:
        for t in texts.to_pylist():
            ids = sp.encode(t)
            yield len(ids), ",".join(map(str, ids)), sp.decode(ids) if ids else "", ids
        return
    # A cut at each single space. Runs of markers, a leading space or a literal marker
    # need the chunks of their own text.
    odd = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.starts_with(texts, " "), pc.match_substring(texts, MARK)))
    lists = pc.split_pattern(pc.if_else(odd, pa.scalar(""), texts), " ")
    enc = lists.flatten().dictionary_encode()
    entries = table.lookup(enc.dictionary.to_pylist())
    codes = np.asarray(enc.indices).tolist()
    offs = np.asarray(lists.offsets).astype(np.int64)
    offs = (offs - offs[0]).tolist()
    empty = np.asarray(pc.equal(pc.binary_length(texts), 0)).tolist()
    for i, is_odd in enumerate(np.asarray(odd).tolist()):
        if empty[i]:
            yield 0, "", "", []
            continue
        parts = table.lookup(_keys(texts[i].as_py())) if is_odd else [entries[c] for c in codes[offs[i]:offs[i + 1]]]
        ids = [x for p in parts for x in p[3]] if table.with_ids else None
        yield sum([p[0] for p in parts]), ",".join([p[1] for p in parts]), " ".join([p[2] for p in parts]), ids


def _keys(text: str) -> list[str]:
    """Chunk keys of a text, by position: cuts in front of each run of markers."""
    t = " " + text.replace(MARK, " ")
    starts = [0] + [m.start() for m in _RUN.finditer(t, 1) if t[m.start() - 1] != " "]
    return [t[a + 1:b] for a, b in zip(starts, starts[1:] + [len(t)])]


def encode(docs: DataFrame, model: str, *, doc_id: str = "doc_id", text: str = "text",
           with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and,
    on request, ``ids`` and the ``decoded`` text. ``model`` is a path that every worker can read."""
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                           T.StructField("decoded_sha256", T.StringType())]
                          + [T.StructField("ids", T.ArrayType(T.IntegerType())),
                             T.StructField("decoded", T.StringType())] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = load(model)
        table = ChunkTable(sp, with_ids=with_ids) if chunkable(sp) else None
        sha = hashlib.sha256
        for batch in batches:
            for part in text_slices(batch, 1):
                n, a, b, all_ids, texts = [], [], [], [], []
                for count, dec, back, ids in encode_texts(sp, part.column(1), table):
                    n.append(count)
                    a.append(sha(dec.encode()).hexdigest())
                    b.append(sha(back.encode()).hexdigest())
                    if with_ids:
                        all_ids.append(ids)
                        texts.append(back)
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
