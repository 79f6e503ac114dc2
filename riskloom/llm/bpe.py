"""BPE encoding and decoding with a transducer lexicon of frequent pieces.

The pieces of all texts are counted; the most frequent ones (a bounded number)
are compiled with their ids into a minimal acyclic transducer, which every
executor memory-maps.  Encoding looks the distinct pieces of a batch up in it
and merges the unseen ones exactly.  Decoding joins the bytes of the ids.

Defined results: null and empty texts have no ids and decode to the empty
text; repeated rows give the same ids each; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from riskloom.llm.lexicon import Lexicon, frequent, publish
from riskloom.llm.tokens import Encoder, text_chunks

LEXICON_SIZE = 65_536


@functools.lru_cache(maxsize=1)  # a worker that serves the next lexicon lets the last one go
def lexicon_encoder(path: str, lexicon: str) -> Encoder:
    return Encoder(path, Lexicon(SparkFiles.get(lexicon)), cache=400_000)


def encode(docs: DataFrame, path: str, size: int = LEXICON_SIZE) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, ids."""
    name = publish(docs.sparkSession, frequent(docs, path, size), path)

    def run(batches):
        enc = lexicon_encoder(path, name)
        for part, texts in text_chunks(batches):
            ids, off = enc.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids.astype("i4")))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (doc_id, ids) -> doc_id, ids, text."""

    def run(batches):
        table = Encoder(path).decode_table()
        for b in batches:
            texts = [b"".join(map(table.__getitem__, x or ())).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str, size: int = LEXICON_SIZE) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them,
    in one pass that keeps neither ids nor texts."""
    name = publish(docs.sparkSession, frequent(docs, path, size), path)

    def run(batches):
        enc = lexicon_encoder(path, name)
        table = enc.decode_table()
        decimal = [str(i) for i in range(len(table))]
        for part, texts in text_chunks(batches):
            ids, off = enc.encode(texts)
            off = off.tolist()
            ids = ids.tolist()
            rows = []
            for d, a, b in zip(part.column(0).to_pylist(), off[:-1], off[1:]):
                own = ids[a:b]
                text = b"".join(map(table.__getitem__, own)).decode("utf-8", "replace")
                rows.append((d, b - a, hashlib.sha256(",".join(map(decimal.__getitem__, own)).encode()).hexdigest(),
                             hashlib.sha256(text.encode()).hexdigest()))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()))],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
