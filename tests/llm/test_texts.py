"""Piece coding, token counts, quality rules and page extraction against libraries and direct versions."""

from __future__ import annotations

import time
import collections
import hashlib
import random
from pathlib import Path

import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from hydrolattice.llm import html_extract, piece_coding, quality_rules, site_quality, token_counts
from hydrolattice.llm.queries import QUERIES

from .common import documents, words

FOLDER = "/root/testdata/sf0.001"
LETTERS = " \n\t  ab'sthe<|endoftext|>09.,é漢　\xa0▁\x00#"
ODD = [None, "", " ", "  ", "▁", " a ", "a  ", "\n\n", "x" * 30_000, "<|endoftext|>", "a <|endoftext|> b", "same same", "same same", "word " * 5000]


def texts(n=400, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [*enumerate(ODD + texts()), (None, "no key"), (3, "key again")]
    return rows, documents(spark, rows).repartition(3)


def test_pieces_equal_the_library(odd):
    rows, docs = odd
    coder = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = collections.Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in piece_coding.encode_decode(docs, ["doc_id"], public_tokenizers.path("piece_bpe_32k.model")).collect())
    want = collections.Counter((i, tuple(coder.encode(t or "")), coder.decode(coder.encode(t or ""))) for i, t in rows)
    assert got == want


def test_piece_tables_may_be_dropped_between_batches(monkeypatch):
    monkeypatch.setattr(piece_coding, "MAX_CHUNKS", 3)
    table = piece_coding.ChunkTable(Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes())
    for text in texts(50):
        ids, decoded = piece_coding.code_texts(table, [text])
        assert ids.to_pylist() == [table.coder.encode(text)] and decoded == [table.coder.decode(ids.to_pylist()[0])]


def test_token_counts_equal_the_library(odd):
    rows, docs = odd
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = token_counts.token_counts(docs, ["doc_id"], public_tokenizers.path("byte_bpe_50k.json"))
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out.collect())
    counts = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    assert got == collections.Counter((i, len((t or "").encode()), n, n > 512) for (i, t), n in zip(rows, counts, strict=True))


def test_every_character_counts_like_the_library():
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counter = token_counts.MergeCounter(Path(public_tokenizers.path("byte_bpe_50k.json")).read_text())
    for c in map(chr, [*range(0x3100), *range(0xFE00, 0x10400)]):
        text = f"a{c}b {c} {c}{c}  c{c}"
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), hex(ord(c))


def test_empty_tables(spark):
    none = documents(spark, [])
    assert piece_coding.encode_decode(none, ["doc_id"], public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    assert token_counts.token_counts(none, ["doc_id"], public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert quality_rules.judge(none, ["doc_id"]).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.main_text(pages, ["page_id"], html_extract.learn(pages)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert site_quality.classify(none, labels).count() == 0


def facts(text):
    w = words(text)
    raw = [x for x in (text or "").split() if x]
    three = collections.Counter(zip(raw, raw[1:], raw[2:], strict=False))
    marked = {j for i in range(len(raw) - 2) if three[tuple(raw[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(marked)


def test_quality_facts_equal_a_direct_version(spark):
    rows = [(i, t) for i, t in enumerate(["a b c a b c", "one\none\n \n\ntwo # $$ <", None, "", "x y", "a a a a a", "A a A a A", "the end " * 40, "the end " * 40])]
    got = sorted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality_rules.judge(documents(spark, rows), ["doc_id"]).collect())
    want = []
    for i, t in rows:
        f = facts(t)
        want.append((i, *f, f[0] < 50 or 100 * f[4] > 50 * f[0]))
    assert got == want


def test_hosts_with_many_failures_are_held_to_the_strict_rules(spark):
    fine = " ".join(f"w{i}" for i in range(90))
    doubtful = " ".join([*(f"w{i}" for i in range(75)), *["a b c d e f g h"] * 3])  # a quarter of its words repeat
    rows = [(i, fine, "good") for i in range(60)] + [(100 + i, "short", "bad") for i in range(60)] + [(200, doubtful, "good"), (201, doubtful, "bad"), (202, fine, "bad"), (203, fine, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs, ["doc_id"]).collect()}
    assert all(kept[i] for i in range(60)) and not any(kept[100 + i] for i in range(60))
    assert kept[200] and not kept[201] and kept[202] and kept[203]


def test_sites_shrink_towards_all(spark):
    good, bad = " ".join(f"w{i}" for i in range(90)), "# $ % & " * 30
    rows = [(i, bad if i % 20 == 0 else good, f"h{i % 5}", "en") for i in range(400)] + [(1000 + i, bad, "spam", "en") for i in range(60)] + [(5000, good, "new", None), (5001, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 20 != 0)) for i in range(0, 400, 2)] + [(1000 + i, 0) for i in range(30)] + [(1000, 0), (None, 1)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in site_quality.classify(docs, labels).collect()}
    assert len(out) == len(rows)
    assert out[1]["kept"] and not out[20]["kept"] and not out[1055]["kept"] and out[5000]["kept"]
    assert out[1055]["host_rate"] < 0.1 < out[5000]["host_rate"] < out[1]["host_rate"]


PAGE = '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><a href="/">menu one</a></nav><div class="ad">buy now</div>' \
       '<article><h1>Head &amp; line</h1><p><b>First   one<br>more</b><p>Second &lt;two&gt;</p></article><footer>foot text</footer></body></html>'


def test_page_text(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", "<p>only words here</p>"), (5, "u", PAGE), (6, "u", "<div"), (7, "u", PAGE.replace("</article>", '<div class="comments"><p>reader says</p></div></article>'))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.main_text(pages, ["page_id"], html_extract.learn(pages)).collect()}
    text = "Head & line\n\nFirst one more\n\nSecond <two>"
    assert got[1] == got[5] == got[7] == (text, len(text))
    assert got[2] == got[3] == ("", 0) and got[4][0] == "only words here"


@pytest.mark.parametrize("names", ["layout-sidebar-right", "no-sidebar", "has-banner", "elementor-widget-text-editor"])
def test_wrappers_are_no_side_parts(names):
    words, weights = [f"w{i}" for i in range(120)], html_extract.Weights([], 0)
    body = f"<p>{' '.join(words)}</p>"
    side = '<div class="sidebar"><p>buy now</p></div>'
    apart = "".join(f'<div class="{names}"><p>{" ".join(words[i : i + 30])}</p></div>' for i in range(0, 120, 30))
    forms = [
        f'<body><div class="{names}">{side}{body}</div></body>', f'<body><div class="{names}">{side}<article>{body}</article></div></body>',
        f'<body><nav>{"menu " * 300}</nav><div id="{names}"><form>{body}</form></div></body>', f"<body><aside><main>{body}</main></aside></body>",
        f"<body>{apart}</body>", f"<body><article>{apart}</article></body>",
    ]
    for page in forms:
        assert html_extract.extract(page, weights).split() == words, page
    heavy = f'<body><article><p>one two three</p></article><div class="comments">{body}</div></body>'
    assert html_extract.extract(heavy, weights) == "one two three"


def test_best_region_is_the_maximum():
    rng = random.Random(3)
    for _ in range(200):
        scores = [rng.uniform(-3, 2) for _ in range(rng.randint(0, 12))]
        a, b = html_extract.best_region(scores)
        best = max([0.0] + [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)])
        assert sum(scores[a:b]) == pytest.approx(best)


def test_page_query_gives_the_articles(spark):
    import html as h
    import re

    got = {r["page_id"]: r["text"] for r in QUERIES["op9_html_extract"].run(spark, FOLDER).collect()}
    for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        inside = re.sub("<br>", " ", r["html"][r["html"].index("<article>") + 9 : r["html"].index("</article>")])
        blocks = [" ".join(h.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inside)]
        assert got[r["page_id"]] == "\n\n".join(b for b in blocks if b)


def test_text_queries_equal_the_libraries(spark):
    coder = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    pieces = QUERIES["op2_piece_coding"].run(spark, FOLDER).collect()
    counts = QUERIES["op10_token_counts"].run(spark, FOLDER).collect()
    assert len(pieces) == len(counts) == len(docs)
    for r in pieces:
        ids = coder.encode(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(coder.decode(ids).encode()).hexdigest()
    for r in counts:
        assert r["n_tokens"] == len(library.encode(docs[r["doc_id"]], add_special_tokens=False).ids)


def test_article_text_with_side_words_and_formulas_stays():
    weights = html_extract.Weights([], 0)
    words = " ".join(f"w{i}" for i in range(60))
    page = f'<body><article><p>{words}</p><div class="social-history"><p>kept one</p></div><p>sum <math><mi>x</mi><mo>+</mo><mi>y</mi></math> kept</p><div class="ad-slot"><p>buy now</p></div><p class="share-price">kept two</p></article></body>'
    page = page.replace("kept two", "kept two " + words)
    text = html_extract.extract(page, weights)
    assert all(part in text for part in ("kept one", "kept two", "x+y kept")) and "buy now" not in text


@pytest.mark.parametrize("page", [
    "<a '" * 100_000, '<div class="ad">x' * 30_000, "<!" * 200_000, "<svg>" * 80_000, "</x>" * 100_000, "<b>" * 50_000 + "</i>" * 50_000,
    "<a '" * 50_000 + '"' + "x" * 5000 + ">", '<a "' * 50_000 + "<a '" * 50_000 + ">", "<!--" * 100_000, "<p" * 100_000,
])
def test_hostile_pages_take_linear_time(page):
    started = time.process_time()
    html_extract.extract(page, html_extract.Weights([], 0))
    whole = time.process_time() - started
    started = time.process_time()
    html_extract.extract(page[: len(page) // 4], html_extract.Weights([], 0))
    assert whole < max(2.0, 12 * (time.process_time() - started))  # a quadratic scan takes 16 times as long


@pytest.mark.parametrize("build", [lambda n: "<p" * n, lambda n: "<p" * n + '"', lambda n: "<p" * n + '""', lambda n: "<p" * n + "'>", lambda n: "<" + "p" * n])
def test_tags_left_open_take_linear_time(build):
    times = []
    for n in (5_000, 40_000):
        started = time.process_time()
        html_extract.extract(build(n), html_extract.Weights([], 0))
        times.append(time.process_time() - started)
    assert times[1] < max(1.0, 24 * times[0])  # a quadratic scan takes 64 times as long


def test_tags_with_brackets_in_quotes_and_open_quotes():
    weights = html_extract.Weights([], 0)
    assert html_extract.extract('<body><article><p title="a > b < c">one two</p><p>three</p></article></body>', weights) == "one two\n\nthree"
    assert html_extract.extract("<article><p>a < b and c</p></article>", weights) == "a < b and c"
    assert "left" in html_extract.extract('<article><p>some text</p><a href="x>left open', weights)


def test_weights_come_from_labelled_pages_however_rare(spark):
    rows = [(i, "u", "<div><p>no label here</p></div>") for i in range(400)] + [(1000, "u", PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert html_extract.learn(pages, sample=3).tag == html_extract.learn(pages.where("page_id = 1000"), sample=3).tag != {}
