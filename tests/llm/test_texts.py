"""Quality, language, encoding, HTML and personal data: accuracy, round trips, brute force and edge cases."""

import hashlib
import random
import re
import time

import numpy as np
import pandas as pd
import pytest
from conftest import MEDIUM, SMALL
from pyspark.sql import functions as F

from fleetlens.llm import op3_quality, op4_language, op5_bpe, op6_html, op7_pii
from fleetlens.llm.common import vocabulary_path

LONG = "long words follow each other " * 40_000


@pytest.fixture(scope="module")
def labels():
    return pd.read_parquet(f"{MEDIUM}/labels.parquet")


def test_quality_on_held_out_documents(spark, labels):
    got = op3_quality.op3_quality(spark, MEDIUM).toPandas()
    assert len(got) == spark.read.parquet(f"{MEDIUM}/documents.parquet").count()
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.5)).all()
    seen = got.merge(labels, on="doc_id")
    held = seen[seen["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.93


def test_quality_edges(spark):
    rows = [(1, None, 5), (2, "", 5), (3, LONG, 5), (4, "a b", 5), (4, "a b", 5), (None, "a b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long")
    none = spark.createDataFrame([], "doc_id long, label int")
    got = op3_quality.score_quality(docs, none).collect()
    assert len(got) == 6 and {r.score for r in got} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(5)] + [(None, 0), (4, None), (2, 7)], "doc_id long, label int")
    assert {r.predicted for r in op3_quality.score_quality(docs, one).collect()} == {1}
    assert op3_quality.score_quality(docs.filter("doc_id > 99"), one).count() == 0


def test_quality_ignores_labels_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    turned = labels.withColumn("label", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("label")).otherwise(F.col("label")))
    score = lambda x: sorted((r.doc_id, r.score) for r in op3_quality.score_quality(docs, x).collect())
    assert score(labels) == score(turned)


def test_language_on_held_out_documents(spark):
    got = op4_language.op4_language(spark, MEDIUM).toPandas()
    docs = pd.read_parquet(f"{MEDIUM}/documents.parquet", columns=["doc_id", "lang"])
    held = got.merge(docs, on="doc_id").query("held_out")
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()


def test_language_spans_scripts_and_edges(spark):
    teach = [(i, t, lang) for i, (t, lang) in enumerate([
        ("the cat and the dog run over the green field with their owner", "en"), ("der hund und die katze laufen mit dem mann über das feld", "de"),
        ("кошка и собака бегут по зелёному полю", "ru")] * 12)]
    model = op4_language.learn(spark.createDataFrame(teach, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en", "ru"]
    mixed = "the cat and the dog run over the green field der hund und die katze laufen mit dem mann"
    rows = [(1, mixed), (2, "собака"), (3, None), (4, ""), (5, "123 -- ½ ²"), (6, "漢字"), (7, LONG), (7, LONG), (None, "the dog")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in op4_language.identify(docs, model).collect()}
    assert [s.lang for s in got[1].spans] == ["en", "de"] and got[1].spans[0].last_word == 9
    assert got[2].lang_pred == "ru" and got[None].lang_pred == "en" and got[7].lang_pred == "en"
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].spans == [] for i in (3, 4, 5))
    assert got[6].lang_pred in model.languages
    nothing = op4_language.learn(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in op4_language.identify(docs, nothing).collect()} == {"und"}
    assert op4_language.identify(docs.filter("doc_id > 99"), model).count() == 0
    short = op4_language.identify(docs, model, spans=False)
    assert "spans" not in short.columns
    assert {(r.doc_id, r.lang_pred, r.score) for r in short.collect()} == {(r.doc_id, r.lang_pred, r.score) for r in got.values()}


def test_viterbi_equals_search_over_all_paths():
    rng = np.random.default_rng(2)
    for _ in range(30):
        scores = rng.normal(size=(5, 3)).astype(np.float32) * 3
        paths = np.array(np.meshgrid(*[range(3)] * 5)).reshape(5, -1).T
        value = [sum(scores[t, p[t]] for t in range(5)) - 2.0 * (np.diff(p) != 0).sum() for p in paths]
        got = op4_language.viterbi(scores, np.array([5]), 2.0)
        mine = sum(scores[t, got[t]] for t in range(5)) - 2.0 * (np.diff(got) != 0).sum()
        assert np.isclose(mine, max(value), atol=1e-4)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def test_encoding_equals_the_library_and_decodes_back(spark, tokenizer):
    rng = random.Random(1)
    signs = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "don't", "1", "é", "漢", " ", "\x1c", "\x85", "<|endoftext|>", "<|", "!", "😀", "́", "½"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(400)] + [None, "", LONG, "x" * 3000, LONG]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "no id", "clash"), (2**60 + 1, "large id", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    with open(vocabulary_path(), encoding="utf-8") as f:
        content = f.read()
    got = op5_bpe.decode_documents(op5_bpe.encode_documents(docs, content, chunk=2000), content)
    assert got.columns == ["doc_id", "ids", "decoded"]
    found = {r.doc_id: r for r in got.collect()}
    assert len(found) == len(rows)
    for i, text, _ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(found[i].ids, "<u4").tolist() == ids
        assert found[i].decoded == tokenizer.decode(ids, skip_special_tokens=False) == (text or "")
    assert op5_bpe.encode_documents(docs.filter("doc_id = -1"), content).count() == 0


def test_decoding_of_odd_ids(spark, tokenizer):
    ids = [[50256, 0, 220], [187], [250, 220, 160], [], [10**6]]
    rows = [(i, bytearray(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)] + [(9, None)]
    with open(vocabulary_path(), encoding="utf-8") as f:
        got = {r.doc_id: r.decoded for r in op5_bpe.decode_documents(spark.createDataFrame(rows, "doc_id long, ids binary"), f.read()).collect()}
    assert got == {i: tokenizer.decode([t for t in x if t < 50257], skip_special_tokens=False) for i, x in enumerate(ids)} | {9: ""}


def test_encoding_query_digests(spark, tokenizer):
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: r for r in op5_bpe.op5_bpe(spark, SMALL).collect()}
    for i, text in zip(docs["doc_id"], docs["text"]):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies on this site to make it work.</div>
<div class="ad">Buy this thing now, it is cheap and good.</div><article><header><h1>The title</h1></header><p><b>First &amp; best
  paragraph of it.<br><p>Short.</p><form><p>Your name and address please</p></form>
<div id="comments"><p>I do not agree with this article at all, says a reader.</p></div><p>Last &lt;one&gt; here.</p></article>
<aside>Other stories you may like to read today</aside><footer>&copy; nobody</footer></body></html>"""


@pytest.mark.parametrize("source,text", [
    (PAGE, "The title\nFirst & best paragraph of it.\nShort.\nLast <one> here."),
    (PAGE[: PAGE.index("Last &lt;one")] + "Last &lt;one", "The title\nFirst & best paragraph of it.\nShort.\nLast <one"),
    ("<article><p>Cut in a tag</p><p cla", "Cut in a tag"), ("<article><p>a<b>b</b>c</p><!-- no --><p>&nbsp; </p>", "abc"),
    (None, ""), ("", ""), ("<nav><a href=x>Only menus</a></nav>", ""), ("<article></article>", ""),
    ("<body><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul><div><p>A page that has no article still holds a long paragraph of plain text, "
     "and that is what a reader came for.</p><p>Its second paragraph is long enough as well, so both of them are kept as text.</p></div></body>",
     "A page that has no article still holds a long paragraph of plain text, and that is what a reader came for.\n"
     "Its second paragraph is long enough as well, so both of them are kept as text."),
])
def test_main_text(source, text):
    assert op6_html.main_text(source, op6_html.trained()) == text


TEXT = "This paragraph of the article is long enough to be kept as main text of the page."
WRAPPED = f"<article><p>{TEXT}</p></article>"


@pytest.mark.parametrize("source,text", [
    (f"<body><script>if(a<b){{c()}}</script>{WRAPPED}</body>", TEXT),
    (f"<body><script>x='<p>';y=\"it's</p>\"</SCRIPT >{WRAPPED}", TEXT), (f"<script src=/a/>var hidden</script>{WRAPPED}", TEXT),
    (f"<html><head><title>T</title><meta charset=x><body>{WRAPPED}</body></html>", TEXT),
    (f"<head><title>T</title><style>a<b</style>{WRAPPED}", TEXT), (f"<head><title>Not closed<body>{WRAPPED}", TEXT),
    (f"<head><noscript><img src=x></noscript><title>a <b</title></head>{WRAPPED}", TEXT),
    (f"<article><p>{TEXT} if x <y then</p><p>{TEXT}</p></article>", f"{TEXT} if x <y then\n{TEXT}"),
    (f"<article><p>{TEXT} x <y don't</p><p>{TEXT} it's</p></article>", f"{TEXT} x <y don't\n{TEXT} it's"),
    (f"<article><p title='a<b>c' data-x=5\">{TEXT}</p></article>", TEXT), (f"<article><!--><p>{TEXT}</p><!-- --></article>", TEXT),
    (f"<template><template>no</template></div>no</template>{WRAPPED}", TEXT), (f"<textarea><p>a</textarea>{WRAPPED}", TEXT),
    (f"<div><button>Share</div><p><select><option>a</p>{WRAPPED}", TEXT), (f"<svg><title>a</title><g>{WRAPPED}", TEXT),
    (f"<article><p>{TEXT} <button><p>no</p>no</button></p></article>", TEXT), (f"{WRAPPED}<script>no <p>no</p>", TEXT),
    (f'{WRAPPED}<a title="x < y', TEXT),
])
def test_main_text_is_not_cut_by_markup(source, text):
    assert op6_html.main_text(source, op6_html.trained()) == text


OTHER = "A reader says that this is wrong in every way that they can think of today."
REPLY = f"<article class=reply><p>{OTHER}</p></article>"


@pytest.mark.parametrize("source,text", [
    *((f'<body><div class="{c}">{WRAPPED}</div></body>', TEXT) for c in
      ("has-sidebar", "content-sidebar-wrap", "with-nav", "page search-results", "header no-ads")),
    (f'<div class="content-sidebar-wrap"><main><p>{TEXT}</p><div class="ad"><p>{OTHER}</p></div></main></div>', TEXT),
    (f'<div class="search-results">{WRAPPED}{WRAPPED}</div><div id=comments>{REPLY}{REPLY}</div>', f"{TEXT}\n{TEXT}"),
    (f'<div class="row sidebar-row">{WRAPPED}</div><div class="row sidebar-row">{WRAPPED}</div>', f"{TEXT}\n{TEXT}"),
    (f'<main><h1>Title</h1><div class="sidebar-left">{WRAPPED}<div id=comments>{REPLY}</div></div></main>', f"Title\n{TEXT}"),
    (f'<form id=page><nav>{REPLY}</nav>{WRAPPED}</form>', TEXT), (f'<div class=related>{REPLY}</div><div class=sidebar><main><p>{TEXT}</p></main>', TEXT),
    (f'<!-- <main> --><div class=page-header>{WRAPPED}</div>', TEXT), (f'<div class=my-menu>{WRAPPED}</div><main> </main>', TEXT),
    (f'<article><p>{TEXT}</p><section class=comments>{REPLY}</section></article>', TEXT), (f'<aside>{REPLY}</aside>{WRAPPED}', TEXT),
    (f'<div class="has-sidebar"><p>{TEXT}</p><p>{TEXT}</p></div>', f"{TEXT}\n{TEXT}"),
])
def test_main_text_in_wrappers(source, text):
    assert op6_html.main_text(source, op6_html.trained()) == text


def test_html_keeps_rows_and_columns(spark):
    long_page = "<article>" + "<p>One of very many paragraphs.</p>" * 20_000
    rows = [(1, PAGE, 7), (1, PAGE, 7), (2, None, None), (3, long_page, 1)]
    pages = spark.createDataFrame(rows, "page_id long, html string, n_chars long").withColumn("text", F.lit("clash"))
    got = op6_html.extract_text(pages)
    assert set(got.columns) == {"page_id", "html", "n_chars", "text"} and got.count() == 4
    by_id = {r.page_id: r for r in got.collect()}
    assert by_id[2].text == "" and by_id[1].text.startswith("The title") and by_id[3].text.count("\n") == 19_999
    assert op6_html.extract_text(pages.filter("page_id > 9")).count() == 0


def test_html_tree_learns_its_table():
    rows = op6_html.labelled()
    assert ((op6_html.trained().predict(rows[:, :-1]) >= 0.5) == (rows[:, -1] == 1)).all()
    assert op6_html.page_of("<p>+12 [3]</p><li>[2]</li>") == (f"<p>{'w ' * 9}<a>{'w ' * 3}</a></p><li><a>w w </a></li>", [True, False])


@pytest.mark.parametrize("inside,text", [
    ("<h2><a href=x>A linked heading</a></h2>", "A linked heading"), ("<p><a href=x>A paragraph that is one link</a></p>", "A paragraph that is one link"),
    ("<p>The sum is <math><mi>x</mi><mo>+</mo><mi>y</mi></math> here</p>", "The sum is x+y here"), ('<h2 class="section-header">Part two</h2>', "Part two"),
    (f'<p id="share">{TEXT}</p>', TEXT), (f'<div class="share price"><p>{TEXT}</p></div>', TEXT), ("<ul><li>One thing</li><li>Another</li></ul>", "One thing\nAnother"),
    ("<ul><li><a href=x>Other story</a></li><li><a href=y>One more story</a></li></ul>", None), ("<div class=share><a href=x>Tweet</a></div>", None),
    (f"<div class=ad><p>{TEXT}</p></div>", None), (f"<form><p>{TEXT}</p><button>Send</button></form>", None), (f"<div class=comments>{TEXT}</div>", None),
])
def test_main_text_inside_an_article(inside, text):
    want = "\n".join(["Title", TEXT, *([text] if text else []), TEXT])
    assert op6_html.main_text(f"<article><h1>Title</h1><p>{TEXT}</p>{inside}<p>{TEXT}</p></article>", op6_html.trained()) == want


@pytest.mark.parametrize("source,text", [
    ("<body><p>Hello world.</p></body>", "Hello world."), ("Only text", "Only text"), ("<ul><li><a>Home</a></ul><p>Hi.</p>", "Hi."),
    *((f'<div class="{c}"><h1>Some title</h1><p>{TEXT}</p><div class="sidebar"><p>{OTHER}</p></div><p>{TEXT}</p></div>', f"Some title\n{TEXT}\n{TEXT}")
      for c in ("content-sidebar-wrap", "page with search", "layout menu")),
    (f"<form id=aspnet><p>{TEXT}</p><div class=ad>{OTHER}</div><p>{TEXT}</p></form>", f"{TEXT}\n{TEXT}"),
    (f"<p>{TEXT}</p><div class=comments><p>{OTHER}</p><p>{OTHER}</p><p>{OTHER}</p></div>", TEXT),
])
def test_main_text_without_an_article(source, text):
    assert op6_html.main_text(source, op6_html.trained()) == text


@pytest.mark.parametrize("unit", ["<div><p>word <b>bold</b>", "<b><p>word</p>", "<article><div class=ad>", "<svg><p>word", "<svg><foreignobject><div>word", "<li><a>w", "</div></p>",
                                  "<div class=search><article>w", "<h1><form><main>w", "<p a=\"", "<template>", "<!--", "<a b='c"])
def test_unclosed_markup_takes_time_in_proportion(unit):
    def seconds(n):
        start = time.process_time()
        op6_html.main_text(unit * n, op6_html.trained())
        return time.process_time() - start

    seconds(100)
    assert seconds(40_000) < 8 * seconds(10_000) + 0.5


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k in BASE for m in re.finditer(BASE[k], text or "") if passes(k, m.group())]


def pii_texts():
    rng = random.Random(3)
    parts = ["a@b.c", "_d@e.f-g.h", "@", ".", "-", " ", "  ", "1", "22", "255", "256", "000", "4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004",
             "+", "+49 (30) 1234-5678", "1.2.3.4", "é", "😀", "x", "\n", "(", ")", "user.name+tag@mail.example.org", "+1 2", "0", "9" * 20]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(1500)]


def test_base_spans_equal_plain_patterns(spark):
    texts = pii_texts() + [None, "", LONG, "a" * 60_000, "1" * 60_000, "1 " * 30_000, "a@" * 20_000, "1." * 20_000, "+1" * 20_000,
                           "x@y.z " * 300, "4111111111111111 " * 300]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii string").repartition(8)
    got = {r.doc_id: r for r in op7_pii.find_pii(docs).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        mine = [(s.kind, s.start, s.end) for s in got[i].pii if s.kind in BASE]
        assert mine == base_spans(text), text and text[:200]


def test_more_kinds_context_and_redaction(spark):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00 is mine"), (2, "DE89 3704 0044 0532 0130 01"), (3, "her SSN: 123-45-6789."), (4, "part 123-45-6789."),
            (5, "write to a@b.cd now or call +49 30 1234567"), (6, None), (7, "clean")]
    docs = op7_pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in docs.collect()}
    kinds = {i: [s.kind for s in r.pii] for i, r in got.items()}
    assert kinds == {1: ["iban"], 2: [], 3: ["ssn"], 4: [], 5: ["email", "phone"], 6: [], 7: []}
    assert all(0 < s.score <= 1 for r in got.values() for s in r.pii)
    clean = {r.doc_id: r.text for r in op7_pii.redact(docs).collect()}
    assert clean[5] == "write to [EMAIL] now or call [PHONE]" and clean[1] == "IBAN [IBAN] is mine"
    assert clean[6] is None and clean[7] == "clean"
    assert op7_pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pii_query_runs_no_python(spark):
    plan = op7_pii.op7_pii(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
    got = {r.doc_id: r for r in op7_pii.op7_pii(spark, SMALL).collect()}
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    for i, text in zip(docs["doc_id"], docs["text"]):
        spans = base_spans(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert got[i].n_email == sum(s[0] == "email" for s in spans)
