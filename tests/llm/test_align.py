"""Alignment against a plain version over token ends, and the round trip of its parts."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pytest
import sentencepiece
from conftest import SMALL

from fleetlens.llm import op12_align as A
from fleetlens.llm.common import byte_encoder, byte_pieces, library_tokenizer, table, vocabulary_path, vocabulary_text

CONTENT = vocabulary_text()
with open(vocabulary_path("piece_bpe_32k.model"), "rb") as f:
    MODEL = f.read()
SECOND = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
A_BYTES, B_BYTES = byte_pieces(CONTENT), A.piece_bytes(SECOND)


def ends(ids, of_id):
    return np.cumsum([len(of_id[i]) for i in ids]).tolist()


def plain(rows):
    """Figures of every document, from the ends of all its tokens."""
    docs, count = [], Counter()
    for doc_id, text in rows:
        a = library_tokenizer(CONTENT).encode(f" {text}", add_special_tokens=False).ids if text else []
        b = SECOND.encode(text) if text else []
        if b"".join(A_BYTES[i] for i in a) != f" {text}".encode() or b"".join(B_BYTES[i] for i in b) != f" {text}".encode():
            a, b = [], []
        ea, eb = ends(a, A_BYTES), ends(b, B_BYTES)
        shared = sorted(set(ea) & set(eb))
        # the group of a token is the number of shared ends before its own end
        of = lambda ids, at: [[str(i) for i, _ in g] for _, g in groupby(zip(ids, at), lambda x: bisect_left(shared, x[1]))]  # noqa: E731, B023
        groups = [f"{','.join(x)}|{','.join(y)}" for x, y in zip(of(a, ea), of(b, eb))]
        at = defaultdict(list)
        for i, e in zip(b, eb):
            at[e].append(i)
        links = [(i, j) for i, e in zip(a, ea) for j in at[e]]
        count.update(links)
        docs.append((doc_id, a, b, groups, links))
    most = Counter()
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    sha = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return sorted(((d, len(a), len(b), len(g), len(x), sum(count[p] == most[p[1]] for p in x), sum(count[p] for p in x), sha(g)) for d, a, b, g, x in docs), key=repr)


TEXTS = [None, "", " ", "a", "hello world", "  two  spaces \n\n lines\t", "▁ a mark", "<s> <|endoftext|> </s>", "日本語のテキスト と English", "naïve café \U0001F600\U0001F468‍\U0001F469",
         "\x00\x1f control", "ﬁ ligature Ⅳ ½", "x" * 700, "don't can't I'll", "a" + " " * 300 + "b", "1234567890 3.14", "é combining", "﻿bom", "привет мир", "مرحبا"]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_plain_version(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, i, i, i]), rng.choice([rng.choice(TEXTS), " ".join(t or "" for t in rng.choices(TEXTS, k=5))])) for i in range(80)]
    rows += rows[:5]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, pairs string, n_a int").repartition(4)
    got = A.align_corpus(docs, CONTENT, MODEL)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_forgetful_aligner(monkeypatch):
    monkeypatch.setattr(A, "REMEMBERED", 3)
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(60)]
    aligner = A.Aligner(A.Vocabulary(A_BYTES), A.Vocabulary(B_BYTES))
    first = lambda texts: [library_tokenizer(CONTENT).encode(t, add_special_tokens=False).ids for t in texts]
    made = A.align_texts([t for _, t in rows], first, SECOND.encode, aligner)
    want = {d: r for d, *r in plain(rows)}
    assert [(*m[:3], m[3]) for m in made] == [(*want[i][:3], want[i][6]) for i, _ in rows] and len(aligner.known) <= 50


def test_groups_end_where_both_end():
    aligner = A.Aligner(A.Vocabulary([b" a", b"b", b"cd", b" "]), A.Vocabulary([b" ab", b"c", b"d", b" a"]))
    for _ in range(2):  # learned, then known
        groups, links = aligner.groups(np.array([0, 1, 2, 0]), np.array([0, 1, 2, 3]))
        assert groups == "0,1|0;2|1,2;0|3" and links.tolist() == [1 * A.PAIR, 2 * A.PAIR + 2, 3]
    with pytest.raises(ValueError):
        A.Vocabulary([b"a", b""])


def test_fast_encoding_equals_the_library():
    signs = [chr(c) for c in (*range(0x3000), *range(0xFE00, 0x10000, 7), *range(0x1F000, 0x1FA00, 5), 0xE0001, 0x10FFFF)]
    texts = [f" a{c}b 1{c} {c}{c}\n x" for c in signs] + [t for t in TEXTS if t]
    assert [list(x) for x in byte_encoder(CONTENT)(texts)] == [e.ids for e in library_tokenizer(CONTENT).encode_batch_fast(texts, add_special_tokens=False)]


def test_empty_table_and_table_without_tokens(spark):
    assert A.align_corpus(spark.createDataFrame([], "doc_id long, text string"), CONTENT, MODEL).count() == 0
    got = A.align_corpus(spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id long, text string"), CONTENT, MODEL)
    assert sorted(map(tuple, got.collect())) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]


def test_a_very_long_text(spark):
    rows = [(1, "word and wörd " * 40_000), (2, "and")]
    got = A.align_corpus(spark.createDataFrame(rows, "doc_id long, text string"), CONTENT, MODEL)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_query_equals_a_plain_version(spark):
    rows = [tuple(r) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    assert sorted(map(tuple, A.op12_align(spark, SMALL).collect()), key=repr) == plain(rows)
