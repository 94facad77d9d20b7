"""Byte-level BPE encoding through a table of distinct words, and decoding through a table of pieces.

Texts are split in tasks; a chunk of documents becomes its distinct words and, per document, the places of its
words in that list. Words of all chunks meet by hash bucket, where each distinct word is encoded once; the ids go
back to their chunks and are put in order by position. What is shuffled is words and places, packed and
compressed; texts stay where they are. Decoding looks ids up in the vocabulary's table of pieces.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import byte_pieces, pack, release_memory, releasing, table, text_slices, unpack, vocabulary_text

#: Text code points of a chunk and of the texts held at once, beyond one document.
CHUNK, SLICE = 16_000_000, 500_000
#: Buckets that distinct words are dealt to, at least; there are as many as input tasks.
BUCKETS = 48
# Fixed value: how byte-level BPE with its own splitting cuts a text into words.
SPLIT = (r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
         r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


class Splitter:
    """Cuts texts into words as the tokenizer in ``content`` (its JSON) does; special tokens are words of their own."""

    def __init__(self, content: str):
        spec = json.loads(content)
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space"):
            raise ValueError("only byte-level tokenizers with their own splitting, without normalizer and prefix space")
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.names = special
        self.word = regex.compile(SPLIT)

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.special is None or not any(s in text for s in self.names):
            return self.word.findall(text)
        out = []
        for i, part in enumerate(self.special.split(text)):
            out += [part] if i % 2 else self.word.findall(part)
        return out


@functools.lru_cache(maxsize=1)
def _tokenizer(content: str):
    """The library's tokenizer, built once per worker process, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(content)
    t.no_truncation()
    t.no_padding()
    return t


def planes(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit integers with their low bytes first, then the next ones: small numbers compress well."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _pack_words(words: list[bytes]) -> bytes:
    return pack(planes(np.array([len(w) for w in words], np.uint32)), b"".join(words))


def _unpack_words(data: bytes) -> list[bytes]:
    sizes, body = unpack(data)
    ends = np.cumsum(from_planes(sizes), dtype=np.int64)
    return [body[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())]


class _Places(dict):
    def __missing__(self, word: str) -> int:
        value = self[word] = len(self)
        return value


PACKED = "chunk long, bucket int, payload binary"
DOCS = -1


class _Chunk:
    """Documents on their way to a chunk's rows: only numbers of words are held, not texts."""

    def __init__(self, number: int):
        self.number, self.place, self.found, self.ids, self.size = number, _Places(), [], [], 0

    def add(self, ids: pa.Array, texts: list[str | None], splitter: Splitter) -> None:
        self.ids.append(ids)
        for t in texts:
            w = splitter.words(t)
            self.found.append(np.fromiter(map(self.place.__getitem__, w), np.uint32, len(w)))
            self.size += len(t or "")

    def rows(self, buckets: int) -> Iterator[pa.RecordBatch]:
        """One row with the documents' words as numbers, and one per bucket with its words.

        Words are numbered by how often they occur. The first row also has the bucket of every number; a bucket's
        words lie in order of their numbers, so this tells where each of them is.
        """
        lengths, flat = [len(f) for f in self.found], np.concatenate([np.zeros(0, np.uint32), *self.found])
        words, ids = list(self.place), pa.concat_arrays(self.ids)
        self.place, self.found, self.ids = None, None, None
        often = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
        number = np.empty(len(words), np.uint32)
        number[often] = np.arange(len(words))
        words = [words[i].encode("utf-8", "surrogatepass") for i in often]
        bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), np.uint32, len(words))
        sink = pa.BufferOutputStream()
        keys = pa.record_batch([ids, pa.array(lengths, pa.int64())], names=["doc_id", "words"])
        with pa.ipc.new_stream(sink, keys.schema) as out:
            out.write_batch(keys)
        yield self._row(DOCS, pack(sink.getvalue().to_pybytes(), planes(number[flat]), planes(bucket)))
        del flat, number
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in range(buckets):
            if cuts[b] < cuts[b + 1]:
                yield self._row(b, _pack_words([words[i] for i in order[cuts[b] : cuts[b + 1]]]))

    def _row(self, bucket: int, payload: bytes) -> pa.RecordBatch:
        return pa.record_batch([pa.array([self.number], pa.int64()), pa.array([bucket], pa.int32()), pa.array([payload], pa.binary())],
                               names=["chunk", "bucket", "payload"])


def _encode_bucket(content: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Each distinct word of the bucket is encoded once; every chunk gets the ids of its own words."""
        if pdf["bucket"].iloc[0] == DOCS:
            return pdf[["chunk", "bucket", "payload"]]
        lists = [_unpack_words(p) for p in pdf["payload"]]
        distinct = _Places()
        numbers = [np.fromiter(map(distinct.__getitem__, w), np.int64, len(w)) for w in lists]
        words = [w.decode("utf-8", "surrogatepass") for w in distinct]
        tokenizer, ids = _tokenizer(content), []
        for at in range(0, len(words), 10_000):
            ids += [e.ids for e in tokenizer.encode_batch(words[at : at + 10_000], add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))
        start = np.cumsum(sizes) - sizes
        out = [pack(planes(sizes[n]), planes(flat[spread(start[n], sizes[n])])) for n in numbers]
        del lists, numbers, distinct, words, ids, flat
        release_memory()
        return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "payload": out})

    return run


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of ``size`` elements each, one after another."""
    total = int(size.sum())
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(total)


def _assemble(piece: list[bytes] | None):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """A chunk's documents with their ids in order of position, and their texts if pieces are given."""
        pdf = pdf.sort_values("bucket")
        keys, numbers, bucket = unpack(pdf["payload"].iloc[0])
        keys = pa.ipc.open_stream(keys).read_all()
        sizes, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for payload in pdf["payload"].iloc[1:]:
            a, b = unpack(payload)
            sizes.append(from_planes(a).astype(np.int64))
            flat.append(from_planes(b))
        sizes, flat = np.concatenate(sizes), np.concatenate(flat)
        # sizes lie bucket after bucket; put them in order of the words' numbers
        start, order = np.cumsum(sizes) - sizes, np.argsort(from_planes(bucket), kind="stable")
        at_number, size_of = np.empty_like(start), np.empty_like(sizes)
        at_number[order], size_of[order] = start, sizes
        numbers, at, ids = from_planes(numbers), 0, []
        for n in keys.column("words").to_pylist():
            mine = numbers[at : at + n]
            at += n
            ids.append(flat[spread(at_number[mine], size_of[mine])].astype("<u4").tobytes())
        out = {"doc_id": pd.Series(keys.column("doc_id").to_pylist(), dtype=object), "ids": ids}
        if piece is not None:
            out["decoded"] = [text_of(x, piece) for x in ids]
        del numbers, sizes, flat, start, order, at_number, size_of
        release_memory()
        return pd.DataFrame(out)

    return run


def text_of(ids: bytes | None, piece: list[bytes]) -> str:
    known = [i for i in np.frombuffer(ids or b"", "<u4").tolist() if i < len(piece)]
    return b"".join(map(piece.__getitem__, known)).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, content: str, chunk: int = CHUNK, decode: bool = False) -> DataFrame:
    """(doc_id, ids) for every row of ``docs`` (doc_id, text); ids are little-endian unsigned 32-bit integers.

    ``content`` is the tokenizer's JSON. Null texts are empty and have no ids. Special tokens in a text become their
    id, as the library does; nothing is added, cut or padded. Rows that repeat are encoded each; an empty table
    gives an empty one; other columns are ignored. With ``decode`` the task that has the ids also looks up their
    pieces, which adds the column ``decoded`` of ``decode_documents``.
    """
    docs = docs.select("doc_id", "text")
    buckets = max(BUCKETS, docs.rdd.getNumPartitions())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, now = Splitter(content), _Chunk(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for part, texts in text_slices(batch, SLICE):
                now.add(part.column(0), texts, splitter)
                if now.size >= chunk:
                    yield from now.rows(buckets)
                    now = _Chunk(now.number + 1)
        if now.ids:
            yield from now.rows(buckets)

    # the documents' rows travel with the words' rows, each on its own, so that texts are split only once
    packed = docs.mapInArrow(releasing(run), PACKED)
    alone = F.when(F.col("bucket") == DOCS, -1 - F.col("chunk")).otherwise(F.col("bucket"))
    whole = packed.withColumn("key", alone).groupBy("key").applyInPandas(_encode_bucket(content), PACKED)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.BinaryType())])
    if decode:
        schema = schema.add("decoded", T.StringType())
    return whole.groupBy("chunk").applyInPandas(_assemble(byte_pieces(content) if decode else None), schema)


def decode_documents(encoded: DataFrame, content: str, out: str = "decoded") -> DataFrame:
    """Adds the text of ``ids`` as ``out``; special tokens are kept, bytes that are no UTF-8 become U+FFFD.

    Null ids are empty. Ids outside the vocabulary add nothing.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(byte_pieces(content))  # one entry per id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of(i, shared.value) for i in batch.column(batch.schema.get_field_index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(out, T.StringType())]))


def encode_and_decode(docs: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids, decoded) of every row; the vocabulary file at ``path`` is read by the driver only."""
    return encode_documents(docs, vocabulary_text(path), chunk, decode=True)


def digests(coded: DataFrame) -> DataFrame:
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2(F.col("ids"), 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(encode_and_decode(table(spark, sf_dir, "documents")))
