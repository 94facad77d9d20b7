"""What several operators of this package share: reading tables, cutting lineage, ranks over hot groups."""

from __future__ import annotations

import ctypes
import functools
import gc
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from fleetlens.session import scratch_folder, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    ship_package(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later jobs survive lost executors."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizers' file of this name is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary_text(path: str | None = None) -> str:
    """The JSON of a tokenizer, read by the driver; tasks get it with their function."""
    with open(path or vocabulary_path(), encoding="utf-8") as f:
        return f.read()


@functools.lru_cache(maxsize=1)
def library_tokenizer(content: str):
    """The tokenizers library's tokenizer of this JSON on one thread, one per worker. Special tokens' strings in a text are text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(content)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = True
    return tokenizer


def byte_pieces(content: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary."""
    spec = json.loads(content)
    # byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    vocabulary = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
    plain = lambda t: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
    return [plain(vocabulary.get(i, "")) for i in range(max(vocabulary) + 1)]


@functools.lru_cache(maxsize=1)
def byte_encoder(content: str) -> Callable[[list[str]], list]:
    """Ids of texts under a byte-level tokenizer's JSON, strings of special tokens being text.

    Where ids follow the order of the merges, as they do when a vocabulary was made by merging, they are ranks, and a
    faster library gives the same ids; otherwise the tokenizers library encodes.
    """
    spec, of_id = json.loads(content), byte_pieces(content)
    vocabulary = spec["model"]["vocab"]
    made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    ranks = {of_id[i]: i for i in vocabulary.values() if i not in {t["id"] for t in spec.get("added_tokens", [])}}
    plain = not spec.get("normalizer") and not spec["pre_tokenizer"].get("add_prefix_space") and spec["pre_tokenizer"].get("use_regex", True)
    if spec["pre_tokenizer"].get("type") != "ByteLevel" or not plain or len(ranks) != 256 + len(made) or made != list(range(256, 256 + len(made))):
        tokenizer = library_tokenizer(content)
        return lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    import tiktoken
    from public_tokenizers import PATTERN

    encoding = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [encoding.encode_to_numpy(t, disallowed_special=()) for t in texts]


def release_memory() -> None:
    """Give freed memory back to the machine. Workers are reused, and what they keep adds up over stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a partition, with the memory that it used given back at the end."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        release_memory()

    return wrapped


def text_slices(batch: pa.RecordBatch, size: int, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """A batch cut into runs of rows with about ``size`` code points of text, beyond one text; only a run's texts are held."""
    texts, start, held, found = batch.column(batch.schema.get_field_index(column)), 0, 0, []
    for i in range(batch.num_rows):
        found.append(texts[i].as_py())
        held += len(found[-1] or "")
        if held >= size or i == batch.num_rows - 1:
            yield batch.slice(start, i + 1 - start), found
            start, held, found = i + 1, 0, []


def pack(*arrays: bytes) -> bytes:
    """Several byte strings as one, compressed."""
    sizes = np.array([len(a) for a in arrays], np.int64)
    return zstandard.ZstdCompressor(level=5).compress(np.int64(len(arrays)).tobytes() + sizes.tobytes() + b"".join(arrays))


def unpack(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ends = 8 * (n + 1) + np.cumsum(np.frombuffer(raw, np.int64, n, 8))
    return [raw[a:b] for a, b in zip(np.r_[8 * (n + 1), ends[:-1]], ends)]


def learnable(doc_id: Column) -> Column:
    """Rows that a model may learn from: crc32 of the id as text, modulo 3, is not 1. Null ids are never learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def hashed_sample(rows: DataFrame, key: str, group: str, per_group: int) -> Column:
    """Condition that holds for about ``per_group`` rows of each value of ``group``, or for all if there are fewer.

    The choice is by a hash of ``key`` and needs only the counts of the groups, one row each: no group is sorted.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    chosen = F.lit(False)
    for r in rows.groupBy(group).agg(F.count("*").alias("n")).collect():
        chosen = chosen | ((F.col(group) == r[group]) & (place < per_group / r["n"]))
    return chosen


def block_count(rows: int, per_block: int) -> int:
    return max(1, -(-rows // per_block))


def hash_block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def finite_vector(vec: Column) -> Column:
    """False for null vectors and for those that hold null or non-finite components; empty vectors are finite."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True))


def gapless_rank(df: DataFrame, group: list[str], order: list[str], out: str, per_bucket: int = 50_000) -> DataFrame:
    """Adds ``out``, the 0-based rank within ``group`` by ``order`` (numeric columns, nulls first).

    A group may hold a third of all rows, so it is never sorted in one task: it is cut into ranges of its last
    order column, ranges are counted, and a row's rank is the rows in earlier ranges plus its place in its own.
    Only one row per (group, leading order values, range) meets in a group's window. Rows equal in every order
    column share a range and get their ranks in any order.
    """
    keys, last = [*group, *order[:-1]], order[-1]
    spans = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(last).alias("_lo"), F.max(last).alias("_hi"))
    spans = spans.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_lo", "_hi",
                         F.ceil(F.col("_n") / per_bucket).alias("_nb"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    width = F.col("_hi").cast("double") - F.col("_lo").cast("double") + 1.0
    place = F.floor((F.col(last).cast("double") - F.col("_lo").cast("double")) / width * F.col("_nb"))
    cut = df.join(spans, same).withColumn("_b", F.coalesce(place, F.lit(-1))).drop(
        "_lo", "_hi", "_nb", *[f"_k{i}" for i in range(len(keys))])
    sizes = cut.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    ahead = W.partitionBy(*group).orderBy(*[F.col(c).asc_nulls_first() for c in order[:-1]], "_b").rowsBetween(
        W.unboundedPreceding, -1)
    sizes = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb"),
                         F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_ahead"))
    own = W.partitionBy(*keys, "_b").orderBy(F.col(last).asc_nulls_first())
    ranked = cut.withColumn("_own", F.row_number().over(own) - 1)
    return ranked.join(sizes, same & (F.col("_b") == F.col("_kb"))).withColumn(
        out, (F.col("_ahead") + F.col("_own")).cast("long")).drop(
        "_b", "_own", "_ahead", "_kb", *[f"_k{i}" for i in range(len(keys))])


def long_schema(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])
