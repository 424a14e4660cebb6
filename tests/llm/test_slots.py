"""The slots of a host's pages decide the text, whatever names the pages give to their parts."""

from __future__ import annotations

import random
import re
from collections import Counter
from html import unescape

import pytest

from quarryline.llm import templates


def renamed(html):
    """Without marks of the article and without names of classes."""
    return re.sub(r' (class|id|role)="[^"]*"', "", re.sub(r"<(/?)(article|main)>", r"<\1div>", html))


def neutral(html):
    """Besides, without names of elements that stand for parts of a page."""
    return re.sub(r"<(/?)(nav|aside|footer|header|form)(?=[\s>])", r"<\1div", renamed(html))


@pytest.mark.parametrize("change", [renamed, neutral])
def test_slots_give_the_articles_without_any_marks(spark, change):
    pages = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    schema = "page_id long, url string, html string"
    got = {r["page_id"]: r["text"] for r in templates.main_text(spark.createDataFrame([(i, u, change(x)) for i, u, x in pages], schema)).collect()}
    hosts = Counter(re.search("//([^/]+)", u)[1] for _, u, _ in pages)
    own = [(i, x) for i, u, x in pages if hosts[re.search("//([^/]+)", u)[1]] >= templates.PAGES]
    blocks = lambda x: [" ".join(unescape(re.sub(r"<[^>]+>", " ", y)).split()) for y in re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", x, re.S)[1])]
    assert len(own) > 200 and sum(got[i] == "\n".join(y for y in blocks(x) if y) for i, x in own) >= 0.98 * len(own)


def test_extents_equal_their_definition():
    rng = random.Random(5)
    for _ in range(200):
        depths, chars, now = [], [], 0
        for _ in range(rng.randrange(40)):
            now = rng.randrange(now + 2)
            is_block = rng.random() < 0.3
            depths.append(now + is_block)
            chars.append(-5 if is_block else 0)
        ends, around = templates._nested(depths, chars)
        for i, d in enumerate(depths):
            if not chars[i]:
                assert ends[i] == next((k for k in range(i + 1, len(depths)) if depths[k] <= d), len(depths))
            before = [k for k in range(i) if not chars[k] and all(depths[x] > depths[k] for x in range(k + 1, i + 1))]
            assert around[i] == (before[-1] if before and depths[before[-1]] == d - 1 else -1)


def texts_of(spark, rows):
    return {r["page_id"]: r["text"] for r in templates.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_the_article_is_widened_by_text_and_not_by_links(spark):
    body = lambda i: "".join(f"<p>Paragraph {k} of story {i} has words that no other page of this host has: {i * 31 + k}.</p>" for k in range(2 + i))
    links = lambda i: "".join(f"<li><a href=/{i}{k}>Go to the place {i}{k} of this site</a>" for k in range(9))
    page = lambda i: f"<body><div><ul>{links(i)}</ul><div><h2>Title {i}</h2><div><h3></h3>{body(i)}</div></div></div><div>Imprint {i}</div></body>"
    got = texts_of(spark, [(i, f"https://h.example/{i}", page(i)) for i in range(5)])
    assert all(got[i] == f"Title {i}\n" + "\n".join(re.findall("<p>(.*?)</p>", body(i))) for i in range(5))


def test_a_form_around_the_article_keeps_its_text(spark):
    page = lambda i: f"<body><nav><ul><li>Menu</ul></nav><form><h1>Title {i}</h1>{''.join(f'<p>Words of story {i}, part {k}.</p>' for k in range(2 + i))}</form><div>Weather {i}</div><footer>Imprint</footer></body>"
    got = texts_of(spark, [(i, f"https://h.example/{i}", page(i)) for i in range(5)])
    assert all(got[i].startswith(f"Title {i}\nWords of story {i}, part 0.") and "Menu" not in got[i] and "Weather" not in got[i] for i in range(5))
