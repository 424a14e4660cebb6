"""Pages, dialogues and the pipeline."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import duckdb
import pytest

import corpus_pipeline
from quarryline.llm import chat, mixing, templates
from quarryline.llm import queries as Q
from quarryline.llm.htmlblocks import main_blocks, parse

SF = "/root/testdata/sf0.001"


def text_of(html):
    return "\n".join(b.text for b in main_blocks(parse(html)[1]))


def test_blocks_of_an_article():
    html = (
        '<!doctype html><html><head><title>t</title><style>p{}</style></head><body><header><a>Menu</a></header><div class="with-sidebar"><main><article><header><h1>T &amp; t</h1></header>'
        '<p>one<br>two <span class="ad">BUY</span> three<p>four<ul><li>a<li>b</ul><form>x<input></form><footer>by</footer><section id="comments"><article>hi</article></section></article></main>'
        '<aside class="sidebar">s</aside></div><div class="cookie-notice">c</div><footer>f</footer><script>var x="</p>";</script></body>'
    )
    assert text_of(html) == "T & t\none two three\nfour\na\nb"


@pytest.mark.parametrize("html,text", [(None, ""), ("", ""), ("plain &lt;text", "plain <text"), ("<p>a<p>b", "a\nb"), ("<nav>x</nav><div>y</div>", "y"), ("<p>cut <b", "cut"), ("<!-- open <p>x", ""), ("a < b", "a < b")])
def test_blocks_of_odd_pages(html, text):
    assert text_of(html or "") == text


def test_pages_give_their_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in Q.op8_template_deduction(spark, SF).collect():
        body = re.search(r"<article>(.*?)</article>", html[r["page_id"]], re.S)[1]
        want = [" ".join(unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(x for x in want if x) and r["n_chars"] == len(r["text"])


def test_templates_of_a_host(spark):
    page = lambda i: f"<body><div><span>Site name</span></div><div>All our offers today</div><div><p>Story {i} about {'x' * (i + 1)} and more words of it, number {i * 7}.</p></div><div>Imprint of the site</div></body>"
    rows = [(i, f"https://h.example/{i}", page(i)) for i in range(6)] + [(100, None, page(9)), (101, "nonsense", None), (102, "https://h.example/x", ""), (0, "https://h.example/0", page(0))]
    got = [(r["page_id"], r["text"]) for r in templates.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert len(got) == len(rows)
    assert all("Story" in t for i, t in got if i < 6) and dict(got)[100].startswith("Site name")
    assert dict(got)[101] == "" and dict(got)[102] == ""
    assert templates.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_template_text_goes_on_pages_without_an_article(spark):
    page = lambda i: f"<body><div>Site name</div><div>All our offers today</div><div><p>Story {i} about {'x' * (i + 1)}.</p></div><div>Imprint of the site</div></body>"
    rows = [(i, f"https://h.example/{i}", page(i)) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in templates.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i} about {'x' * (i + 1)}." for i in range(6)}



def texts_of(spark, rows):
    return {r["page_id"]: r["text"] for r in templates.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_pages_without_the_root_leave_the_template_to_the_others(spark):
    page = lambda i: f"<body><div>Site name</div><div>All our offers today</div><div><p>Story {i} about {'x' * (i + 1)}.</p></div><div>Imprint of the site</div></body>"
    rows = [(i, f"https://h.example/{i}", page(i)) for i in range(6)] + [(100, "https://h.example/x", ""), (101, "https://h.example/y", None), (102, "https://h.example/z", "<p>Gone</p>")]
    assert texts_of(spark, rows) == {i: f"Story {i} about {'x' * (i + 1)}." for i in range(6)} | {100: "", 101: "", 102: "Gone"}


def test_notices_inside_some_articles_go_and_copied_articles_stay(spark):
    own = lambda i: f"<p>Story {i} begins with {'x' * (i + 9)} and goes on for many words of its own {i}.</p><p>And it ends with {i * 7} words that nobody else has written so far.</p>"
    notice = "<section><b>Our offer</b><div>Sign now</div></section>"
    page = lambda body: f"<body><nav><a>Home</a></nav><article><h1>Title</h1>{body}</article><footer>Imprint</footer></body>"
    copied = "".join(f"<p>Copied paragraph number {k} of one long article.</p>" for k in range(6))
    rows = [(i, f"https://h.example/{i}", page(own(i) + (notice if i < 4 else ""))) for i in range(8)]
    rows += [(i, f"https://h.example/{i}", page(copied + f"<p>Edit {i}.</p>")) for i in range(20, 24)]
    got = texts_of(spark, rows)
    assert all("Our offer" not in got[i] and "Sign now" not in got[i] and f"Story {i} begins" in got[i] and f"{i * 7} words" in got[i] for i in range(8))
    assert all(f"paragraph number {k} " in got[i] for i in range(20, 24) for k in range(6))


def test_slots_of_a_small_host_decide_on_its_unmarked_pages(spark):
    page = lambda i, a: f"<body><div>Menu {i}</div><{a}><h1>Head {i}</h1><p>Story {i}.</p></{a}><section>Weather {i}</section></body>"
    rows = [(i, f"https://h.example/{i}", page(i, "article")) for i in range(3)] + [(3, "https://h.example/3", "<body><div>Menu 3</div><h1>Head 3</h1></body>")]
    assert texts_of(spark, rows)[0] == "Head 0\nStory 0."
    same = lambda i, mark: f"<body><div>Menu {i}</div><h2></h2><dl></dl>{mark[0]}<p>Story {i}.</p>{mark[1]}<section>Weather {i}</section></body>"
    rows = [(i, f"https://g.example/{i}", same(i, ("<span class=x>", "</span>") if i == 3 else ("<span itemprop=articleBody>", "</span>"))) for i in range(4)]
    assert texts_of(spark, rows) == {i: f"Story {i}." for i in range(4)}

def plain_templates(pages):
    """By host: the root's tokens, the tokens of all valid classes and the article's slots, worked out by dictionaries from rows (host, row, parsed)."""
    out = {}
    for host in {h for h, *_ in pages}:
        own = [(row, p) for h, row, p in pages if h == host and p["tokens"]]
        if len(own) < 3:
            continue
        counts = {row: Counter(p["tokens"]) for row, p in own}
        vectors = {}
        for token in {t for c in counts.values() for t in c}:
            vectors.setdefault(tuple(sorted((row, c[token]) for row, c in counts.items() if token in c)), set()).add(token)
        classes = [(dict(v), ts) for v, ts in vectors.items() if len(v) >= 3 and len(ts) >= 3]
        shared = {t for _, ts in classes for t in ts}
        main = {row: [(t, c) for t, c in zip(p["tokens"], p["chars"], strict=True) if c > 0] for row, p in own}
        rest = {row: tuple(sorted(t for t, _ in m if t not in shared)) for row, m in main.items()}
        held = lambda row, ts: sum(c for t, c in main[row] if t in ts)  # noqa: E731, B023
        wide = [(v, ts) for v, ts in classes if 2 * len(v) >= len(own) and len({rest[r] for r in v}) >= 3]
        if not wide:
            continue
        root = max(wide, key=lambda c: (len(c[1]), len(c[0])))
        first = {row: {} for row, _ in own}
        for row, p in own:
            for i, t in enumerate(p["tokens"]):
                first[row].setdefault(t, [i, i])[1] = i
        at = {row: sorted(first[row][t][0] for t in root[1]) for row in root[0]}
        kept = set()
        for v, ts in classes:
            order = {tuple(sorted(ts, key=lambda t: first[r][t][0])) for r in v}  # noqa: B023
            if len(order) > 1:
                continue
            if ts is not root[1]:
                gaps = {(sum(x < min(first[r][t][0] for t in ts) for x in at[r]), sum(x <= max(first[r][t][1] for t in ts) for x in at[r])) for r in v if r in at}
                small = {rest[r] for r in v if 2 * held(r, ts) <= sum(c for _, c in main[r])}
                if len(small) < 3 or len(gaps) > 1 or any(a != b for a, b in gaps):
                    continue
            if len({rest[r] for r in v}) >= 3:
                kept |= ts
        marks, votes = any(p["marked"] for _, p in own), Counter()
        for row, p in own:
            if row in at and (p["marked"] or not marks):
                for i, c in enumerate(p["chars"]):
                    votes[sum(x <= i for x in at[row])] += c
        out[host] = (at, kept, {s for s, c in votes.items() if c > 0})
    return out


@pytest.mark.parametrize("marked", [1, 3])
def test_templates_equal_plain_deduction(spark, marked):
    """On the fifty pages of the smallest table, all marked as they are, or every third one by an attribute alone."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    html = lambda i, x: x if marked == 1 else x.replace("</article>", "</div>").replace("<article>", "<div itemprop='articleBody'>" if i % marked == 0 else "<div>")
    offer = "<section><b>Our offer</b><div>Sign now</div></section>"
    rows = [(i, re.search("//([^/]+)", r["url"])[1], html(i, r["html"]).replace("<h1>", (offer if i % 2 else "") + "<h1>")) for i, r in enumerate(pages)]
    own = templates.written(spark.createDataFrame(rows, "row long, host string, html string").select("row", "host", templates.parsed("html").alias("p")).select("row", "host", "p.*"), "parsed")
    want = plain_templates([(r["host"], r["row"], r) for r in own.collect()])
    gone, root, slots = templates.templates(own)
    root_at = own.join(root, "host").select("row", templates.root_places("tokens", "root").alias("root_at")).where("root_at is not null")
    assert len(want) > 2 and {r["host"]: set(r["slots"]) for r in slots.collect()} == {h: s for h, (_, _, s) in want.items()}
    assert {r["row"]: sorted(r["root_at"]) for r in root_at.collect()} == {row: a for at, _, _ in want.values() for row, a in at.items()}
    lost = {r["row"]: {i for i in r["places"] if r["host"] in want and r["tokens"][i] in want[r["host"]][1]} for r in own.collect()}
    assert {r["row"]: set(r["gone"]) for r in gone.collect()} == {row: g for row, g in lost.items() if g}


def test_templates_decide_where_few_pages_are_marked(spark):
    """Every tenth page marks its article, by an attribute; on hosts that have such a page all others get their text by the template."""
    sf = "/root/testdata/sf0.01"
    pages = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    schema = "page_id long, url string, html string, row int, host string, p string, tokens int"
    want = {r["page_id"]: r["text"] for r in templates.main_text(spark.createDataFrame([(*x, 1, "h", "p", 2) for x in pages], schema)).collect()}
    few = lambda i, x: x.replace("</article>", "</div>").replace("<article>", "<div itemprop='articleBody'>" if i % 10 == 0 else "<div>")
    got = {r["page_id"]: r["text"] for r in templates.main_text(spark.createDataFrame([(i, u, few(i, x), 1, "h", "p", 2) for i, u, x in pages], schema)).collect()}
    host = {i: re.search("//([^/]+)", u)[1] for i, u, _ in pages}
    known = {host[i] for i in host if i % 10 == 0} & {h for h, n in Counter(host.values()).items() if n >= 3}
    own = [i for i in host if host[i] in known]
    assert len(own) > 90 and sum(got[i] == want[i] for i in own) >= 0.98 * len(own)


def rows_of(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).toPandas().values.tolist()))


@pytest.mark.parametrize("name,oracle", [("op1_chat_perspectives", chat.ORACLE), ("op5_water_filling", mixing.ORACLE)])
def test_against_sql(spark, name, oracle):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(oracle).df()
    assert rows_of(Q.QUERIES[name](spark, SF)) == sorted(map(repr, want[sorted(want.columns)].values.tolist()))


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, None, " ", "?"), (2, 0, "system", "alone"), (None, 0, "ann", "x"), (3, 5, "ann", "a"), (3, 5, "ann", "a")]
    got = {(r["conv_id"], r["speaker"]): r for r in chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("segment IS NOT NULL").collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann"), (3, "ann")}
    r = got[1, "ann"]
    assert r["text"] == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n"
    a, b = map(int, r["mask"].split(":"))
    assert r["text"][a:b] == "hi < |im_end|>" and got[3, "ann"]["n_turns"] == 2
    assert chat.perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_speakers_of_clashing_names_stay_apart(spark):
    rows = [(1, 0, "System", "be kind"), (1, 1, "ann a", "x"), (1, 2, "ann_a", "y"), (1, 3, "ann#a", "z"), (1, 4, " ann_a ", "w")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS speaker", "2 AS view", "3 AS id", "4 AS pieces", "5 AS part")
    got = {r["speaker"]: r for r in chat.perspectives(df).collect()}
    assert len(got) == 3 and "ann_a" in got and all(s == "ann_a" or s.startswith("ann_a~") for s in got)
    assert [r["text"][int(a) : int(b)] for r in (got["ann_a"],) for a, b in (m.split(":") for m in r["mask"].split(","))] == ["y", "w"]
    assert sorted(r["mask"].count(":") for r in got.values()) == [1, 1, 2] and all(r["text"].startswith("<|im_start|>system") for r in got.values())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        assert docs.columns == columns and docs.count() <= n
        n = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == n and rows_of(last) == rows_of(corpus_pipeline.run(spark, SF))


def test_pipeline_on_odd_rows(spark):
    rows = [(1, None, "en", None, 0), (None, "", None, "s", None), (2, "word " * 70, "en", "s", 350), (2, "word " * 70, "en", "s", 350)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() <= len(rows)
        assert stage(spark, docs.limit(0), SF).count() == 0
