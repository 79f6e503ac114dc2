import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import html, language, packing
from riskloom.llm.common import read

SF_SMALL = "/root/testdata/sf0.001"

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header class="site-header"><h1>Site</h1></header><nav><a href=x>Home</a></nav>
<div id="cookie-notice">We use cookies, accept, please.</div><main><div class="breadcrumbs"><a>Home</a> &gt; News</div><article><header><h1>Big News</h1></header>
<p>First paragraph &amp; more text, with <a href=x>a link</a>. It goes on, and on.<p>Second   para
 graph &lt;b&gt; done.<ul><li>one item<li>two item</ul><aside>Related stuff, here.</aside><div class=ad>Buy now, cheap, good.</div>
<form><input name=q><button>Go</button></form><blockquote>Quoted words, yes.</blockquote><script>var a="<p>no</p>";</script></article>
<section class="comments"><h2>Comments</h2><p>A reader says a very long thing, indeed, with many, many, commas, and more text than the article.</p></section></main>
<div class="sidebar"><p>Popular, now: long sidebar text, with commas.</p></div><footer>&copy; 2020, all rights.</footer></body></html>"""


@pytest.mark.parametrize("page, text", [
    (PAGE, "Big News First paragraph & more text, with a link. It goes on, and on. Second para graph <b> done. one item two item Quoted words, yes."),
    (None, ""), ("", ""), ("plain text, only.", "plain text, only."), ("<p>a<p>b &lt;3 < 5", "a b <3 < 5"), ("<nav>x</nav>", ""),
    ("<div><p>Long enough, surely.<script>no", "Long enough, surely."), ("<!-- x", ""),
])
def test_main_text(page, text):
    assert html.main_text(page) == text


STORY = "<h1>News</h1><p>First paragraph, with more text. It goes on, and on.</p><p>Second one, at length, is here.</p>"
SAYS = "News First paragraph, with more text. It goes on, and on. Second one, at length, is here."


@pytest.mark.parametrize("page, text", [
    (f'<div class="layout has-sidebar"><article>{STORY}</article></div>', SAYS),
    (f'<div class="wrapper no-comments"><main>{STORY}</main></div>', SAYS),
    (f'<div id="content" class="with-ads nav-open">{STORY}</div>', SAYS),
    (f'<form id="aspnetForm"><div>{STORY}</div></form>', SAYS),
    (f'<p>Skip it, now.</p><div class="sidebar-layout"><main>{STORY}<div class="ad">Buy now, cheap, good.</div></main></div>', SAYS),
    (f'<article>{STORY}<section id="discussion"><p>What it means, in full, is said.</p></section><p class="notice">Mind this, too, please.</p></article>',
     SAYS + " What it means, in full, is said. Mind this, too, please."),
    (f'<article>{STORY}<div class="share"><a href=x>Share this, now</a></div></article><div class="comments"><p>{"Long, long words. " * 300}</p></div>', SAYS),
])
def test_marks_never_hide_the_content(page, text):
    assert html.main_text(page) == text


LONG = "It goes on, and on, at some length, as a story does. "


@pytest.mark.parametrize("page, text", [
    (f"<main><article><h2>One</h2><p>{LONG * 6}</p></article><article><h2>Two</h2><p>{LONG * 5}</p></article></main>", f"One {LONG * 6}Two {LONG * 5}"),
    (f"<div><section><p>{LONG}</p></section><div><p>{LONG * 5}</p><p>{LONG * 5}</p></div></div>", LONG * 11),
    (f"<div><a href=x>Home, first</a></div><article><p>{LONG * 5}</p></article><div><a href=x>Next, please</a></div>", LONG * 5),
])
def test_content_beside_the_article_stays(page, text):
    assert html.main_text(page) == text.strip()


def test_pages_keep_all_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, PAGE), (3, "v", "<p>" * 3000 + "deep, text.")]
    out = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r["n_chars"] for r in out) == sorted([0, 0, len(html.main_text(PAGE)), 11])
    real = html.extract(read(spark, SF_SMALL, "pages")).where("n_chars = 0").count()
    assert real == 0


def test_language_held_out_accuracy(spark):
    docs = read(spark, SF_SMALL, "documents")
    out = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_language_edges(docs_of):
    rows = [(1, "the thing of that"), (2, None), (3, "123 #!"), (4, ""), (None, "the of"), (1, "the thing of that")]
    out = language.identify(docs_of(rows + [(i, "the thing of that and") for i in range(10, 40)])).collect()
    assert len(out) == 36
    for r in out:
        und = r["doc_id"] in (2, 3, 4)
        assert (r["lang_pred"] == "und") == und and 0 <= r["score"] <= 1
    assert language.identify(docs_of([])).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs_of(rows).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_mixture_finds_both_languages(docs_of):
    en, de = "the thing of that was other ", "der und ist nicht eine über "
    train = [(i, en * 5) for i in range(40)] + [(100 + i, de * 5) for i in range(40)]
    docs = docs_of(train).withColumn("lang", F.when(F.col("doc_id") < 100, "en").otherwise("de"))
    learned = language.learn(docs)
    out = language.predict(docs_of([(1, en * 6 + de * 4), (2, en * 3), (3, de)]), *learned).collect()
    assert [(r["lang_pred"], r["languages"]) for r in sorted(out, key=lambda r: r["doc_id"])] == [("en", "de,en"), ("en", "en"), ("de", "de")]


def test_pipeline_stages(spark, docs_of, scratch):
    import corpus_pipeline

    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, None), (1, None), (2, ""), (3, text), (3, text), (4, text + " tail"), (5, " ".join(f"v{i} a{i}@b.cd" for i in range(60))), (None, "word " * 60)]
    for case, docs in (("some", docs_of(rows)), ("none", docs_of([]))):
        columns = docs.columns
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, SF_SMALL).write.parquet(f"{scratch}/{case}-{name}")
            docs = spark.read.parquet(f"{scratch}/{case}-{name}")
            assert docs.columns == columns or k == 4
            if k == 3 and docs.count():
                kept = {r["doc_id"]: r["text"] for r in docs.collect()}
                assert set(kept) == {3, 5} and "@" not in kept[5] and kept[3] == text


def test_pipeline_encodes_little_text_at_once(monkeypatch):
    """Packing's workers hold the arrays of half a million characters, however large the batch is."""
    sizes = []

    class Encoder:
        def encode(self, texts):
            sizes.append(sum(map(len, texts)))
            return np.zeros(len(texts), np.uint32), np.arange(len(texts) + 1)

    class Docs:
        def select(self, *names):
            return self

        def mapInArrow(self, fn, schema):
            texts = ["x" * 90_000] * 30 + [None, "", "y" * 700_000]
            return list(fn([pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])]))

    monkeypatch.setattr(packing, "encoder", lambda path: Encoder())
    out = packing.token_pieces(Docs(), "", 4096, 1)
    assert sum(sizes) == 3_400_000 and sorted(sizes)[-2] <= 500_000 and sum(b.num_rows for b in out)
