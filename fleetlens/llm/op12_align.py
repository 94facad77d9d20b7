"""Alignment of two tokenizers over the same bytes, and how often their tokens are linked.

Every text is encoded whole by both. Where tokens of both start with a space at the same byte, the tokens before
them end together: such anchors cut a text into windows, small pairs of id tuples. What a window's groups and links
are depends on its ids alone, so each distinct pair is aligned once and remembered. Counts of linked pairs are summed
over the corpus by chunks of documents: a chunk sends each of its distinct pairs once, gets their totals back, and
fills in its documents' figures; texts and tokens are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import byte_encoder, byte_pieces, pack, releasing, table, text_slices, unpack, vocabulary_path, vocabulary_text, written
from fleetlens.llm.op5_bpe import from_planes, planes

#: Text code points encoded at once, and of a chunk of documents, beyond one document each.
SLICE, CHUNK = 200_000, 4_000_000
#: Distinct windows that a task remembers.
REMEMBERED = 200_000
#: Marks ids of the second vocabulary in a window's key; no id is as large.
SECOND = 1 << 31
#: A linked pair of ids as one number: a * PAIR + b.
PAIR = 1 << 32
# Fixed value: how the second vocabulary writes a space.
SPACE_MARK = "▁"


class Vocabulary:
    """Bytes of every id, laid end to end. Each must have some, so that ids end at different places."""

    def __init__(self, of_id: list[bytes]):
        if not all(of_id):
            raise ValueError("an id without bytes")
        self.lengths = [len(p) for p in of_id]
        self.sizes = np.array(self.lengths, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(of_id), np.uint8)
        self.spaced = np.array([p[:1] == b" " for p in of_id], bool)

    def text(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
        return self.bytes[at].tobytes()


def piece_bytes(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """The bytes that each id of a sentencepiece model stands for."""
    of = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(SPACE_MARK, " ").encode()
    return [of(i) for i in range(model.get_piece_size())]


def marked(places: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, bool)
    out[places] = True
    return out


class Aligner:
    """Aligns texts given as ids of both vocabularies; remembers windows.

    A group is written as its first ids, a bar and its second ids, each id with the sign before it: none, comma or
    semicolon, bar or comma. ``signs`` holds all of these spellings, so writing a window is looking up its ids.
    """

    def __init__(self, first: Vocabulary, second: Vocabulary):
        self.a, self.b, self.known = first, second, {}
        n, m = len(first.lengths), len(second.lengths)
        self.signs = [f"{s}{i}" for s in ("", ",", ";") for i in range(n)] + [f"{s}{i}" for s in "|," for i in range(m)]
        self.sign = self.signs.__getitem__

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[str, np.ndarray]:
        """Groups and links of one text, window by window. Both sequences must stand for the same bytes."""
        n, all_ids = len(a), np.concatenate([a, b])
        a_end, b_end = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
        size = int(a_end[-1]) + 1
        # groups: how many shared ends lie before a token
        a_shared, b_shared = marked(b_end, size)[a_end], marked(a_end, size)[b_end]
        group = np.concatenate([np.cumsum(a_shared) - a_shared, np.cumsum(b_shared) - b_shared])
        links = a[a_shared] * PAIR + b[b_shared]
        # windows: groups before which both have a token that starts with a space
        last_a, last_b = np.flatnonzero(a_shared)[:-1] + 1, np.flatnonzero(b_shared)[:-1] + 1
        opens = np.r_[0, np.flatnonzero(self.a.spaced[a[last_a]] & self.b.spaced[b[last_b]]) + 1]
        window = (np.cumsum(marked(opens, len(links))) - 1)[group]
        # the ids of a window side by side, those of the second vocabulary marked: one slice is a window's key
        side = np.arange(len(all_ids)) >= n
        order = np.argsort(window, kind="stable")
        cuts = np.r_[0, np.flatnonzero(np.diff(window[order])) + 1, len(order)]
        raw = np.where(side, all_ids | SECOND, all_ids)[order].astype("<u4").tobytes()
        places, known = (4 * cuts).tolist(), self.known
        keys = [raw[i:j] for i, j in zip(places, places[1:])]
        found = list(map(known.get, keys))
        if None in found:
            self._learn(keys, found, cuts.tolist(), np.r_[opens, len(links)].tolist(), all_ids, side, group, opens, links)
        return ";".join([f[0] for f in found]), np.frombuffer(b"".join([f[1] for f in found]), np.int64)

    def _learn(self, keys, found, cuts, opens, ids, side, group, first_groups, links) -> None:
        """Aligns the windows that are not known: their ids in order of groups, with their signs, and their links."""
        order = np.argsort(2 * group + side, kind="stable")
        ids, side, group = ids[order], side[order], group[order]
        starts = np.r_[True, (group[1:] != group[:-1]) | (side[1:] != side[:-1])]
        n, m = len(self.a.lengths), len(self.b.lengths)
        kind = np.where(side, np.where(starts, 3 * n, 3 * n + m), np.where(starts, 2 * n, n))
        kind[starts & ~side & np.isin(group, first_groups)] = 0  # a window's first id
        codes, known = (ids + kind).tolist(), self.known
        for i, f in enumerate(found):
            if f is None:
                key = keys[i]
                if (f := known.get(key)) is None:
                    f = known[key] = "".join(map(self.sign, codes[cuts[i] : cuts[i + 1]])), links[opens[i] : opens[i + 1]].tobytes()
                found[i] = f
        if len(known) > REMEMBERED:
            known.clear()


NO_TOKENS = (0, 0, 0, "", np.zeros(0, np.int64))


def align_texts(texts: list[str | None], encode_first, encode_second, aligner: Aligner) -> list[tuple[int, int, int, str, np.ndarray]]:
    """Per text the numbers of ids of both and of groups, the digest of its groups, and its links in order."""
    out = [NO_TOKENS] * len(texts)
    full = [i for i, t in enumerate(texts) if t]
    firsts, seconds = encode_first([f" {texts[i]}" for i in full]), encode_second([texts[i] for i in full])
    for i, a, b in zip(full, firsts, seconds):
        a, b, want = np.asarray(a, np.int64), np.array(b, np.int64), f" {texts[i]}".encode()
        if aligner.a.text(a) != want or aligner.b.text(b) != want:
            continue
        groups, links = aligner.groups(a, b)
        out[i] = len(a), len(b), len(links), hashlib.sha256(groups.encode()).hexdigest(), links
    return out


FIGURES = ["n_a", "n_b", "n_groups", "n_links"]
PACKED = "chunk long, payload binary, pairs array<long>, times array<long>"


def _chunk_row(chunk: int, ids: list[pa.Array], rows: list[tuple]) -> pa.RecordBatch:
    """One row: the documents with their links as places in the list of the chunk's distinct pairs, and that list."""
    lengths = np.array([len(r[4]) for r in rows], np.int64)
    flat = np.concatenate([r[4] for r in rows])
    place, pairs = pd.factorize(flat)
    times = np.bincount(place, minlength=len(pairs))
    often = np.argsort(-times, kind="stable")
    number = np.empty(len(pairs), np.int64)
    number[often] = np.arange(len(pairs))
    docs = pa.record_batch([pa.concat_arrays(ids), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], pa.array(lengths),
                            pa.array([r[3] for r in rows], pa.string())], names=["doc_id", *FIGURES, "groups_sha256"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema) as out:
        out.write_batch(docs)
    payload = pack(sink.getvalue().to_pybytes(), planes(number[place]))
    values = lambda x: pa.array([x.tolist()], pa.list_(pa.int64()))
    return pa.record_batch([pa.array([chunk], pa.int64()), pa.array([payload], pa.binary()), values(pairs[often]), values(times[often])],
                           names=["chunk", "payload", "pairs", "times"])


def aligned_chunks(docs: DataFrame, content: str, model: bytes) -> DataFrame:
    """Documents (doc_id, text) in chunks, aligned; one row per chunk with the counts of its distinct linked pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        second = sentencepiece.SentencePieceProcessor(model_proto=model)
        aligner = Aligner(Vocabulary(byte_pieces(content)), Vocabulary(piece_bytes(second)))
        first_ids = byte_encoder(content)
        second_ids = lambda texts: [second.encode_as_ids(t) for t in texts]
        chunk, ids, rows, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for part, texts in text_slices(batch, SLICE):
                ids.append(part.column(0))
                rows += align_texts(texts, first_ids, second_ids, aligner)
                size += sum(len(t or "") for t in texts)
                if size >= CHUNK:
                    yield _chunk_row(chunk, ids, rows)
                    chunk, ids, rows, size = chunk + 1, [], [], 0
        if ids:
            yield _chunk_row(chunk, ids, rows)

    return docs.select("doc_id", "text").mapInArrow(releasing(run), PACKED)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, links, best) of every pair linked anywhere; best: no pair with the same second id has more links."""
    pairs = chunks.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("links"))
    second = F.pmod("pair", F.lit(PAIR)).alias("second")
    most = pairs.groupBy(second).agg(F.max("links").alias("most"))
    return pairs.join(most, F.pmod("pair", F.lit(PAIR)) == F.col("second")).select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def align_corpus(docs: DataFrame, content: str, model: bytes) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs`` (doc_id, text).

    ``content`` is the JSON of a byte-level tokenizer (A), ``model`` a sentencepiece model (B) that writes a space before
    a text. Null and empty texts, and texts that A or B change, have zeros and the empty digest. Rows that repeat
    are aligned and counted each; an empty table gives an empty one; other columns are not read.
    """
    chunks = written(aligned_chunks(docs, content, model), "aligned")
    spread = chunks.select("chunk", F.posexplode("pairs").alias("place", "pair"))
    back = spread.join(pair_counts(chunks), "pair").groupBy("chunk").agg(  # one row per distinct pair of a chunk
        F.array_sort(F.collect_list(F.struct("place", "links", "best"))).alias("known"))
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in (*FIGURES, "n_best", "count_sum")],
                           T.StructField("groups_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw, numbers = unpack(batch.column(0)[i].as_py())
                rows = pa.ipc.open_stream(raw).read_all().combine_chunks().to_batches()[0]
                known = batch.column(1)[i].values  # null without any link
                links = np.zeros(0, np.int64) if known is None else known.field("links").to_numpy()
                best = np.zeros(0, np.int64) if known is None else known.field("best").to_numpy(zero_copy_only=False).astype(np.int64)
                numbers = from_planes(numbers).astype(np.int64)
                ends = np.cumsum(rows.column(4).to_numpy())
                sums = [np.diff(np.r_[0, np.r_[0, np.cumsum(x[numbers])][ends]]) for x in (best, links)]
                yield pa.RecordBatch.from_arrays([*rows.columns[:5], *[pa.array(s.astype(np.int64)) for s in sums], rows.column(5)], names=schema.names)

    return chunks.select("chunk", "payload").join(back, "chunk", "left").select("payload", "known").mapInArrow(run, schema)


def op12_align(spark, sf_dir: str) -> DataFrame:
    with open(vocabulary_path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    return align_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_text(), model)
