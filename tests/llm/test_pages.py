"""Main text where structure alone does not decide."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from onefold.llm.html_text import BODY, MAIN, blocks_of, main_text


def extracted(spark, *pages):
    rows = spark.createDataFrame([(i, f"http://h{i}.org/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in main_text(rows).orderBy("page_id").collect()]


def test_any_number_of_open_elements(spark):
    deep = "<html><body>" + "<font>" * 2100 + "first<nav>menu</nav><p>second</p><footer>foot</footer>" + "</font>" * 5 + "third"
    divs = "<div>" * 5000 + "a<nav>n</nav>" + "</div>" * 5000 + "b"
    assert extracted(spark, deep, divs) == ["first\n\nsecond\n\nthird", "a\n\nb"]


def test_inline_adverts_end_where_they_end(spark):
    pages = ["<p>a <span class='ad'>x <span>y</span> z</span> b</p>", "<p><span>a <span class='ad'>x</span> b</p>", "<p><span>a</p><span class=ad>x</span> b"]
    assert extracted(spark, *pages) == ["a\n\nb", "a\n\nb", "a\n\nb"]


def test_an_article_is_all_of_the_text_only_if_it_dominates(spark):
    story = " ".join(f"word{i}" for i in range(80))
    teaser = f"<div><p>{story}</p></div><article class='teaser'>Read more</article>"
    plain = f"<div>Short line around</div><article><p>{story}</p></article>"
    assert extracted(spark, teaser, plain) == [f"{story}\n\nRead more", story]


def test_names_with_another_meaning_stay_inside_an_article(spark):
    inside = "<article><p>one</p><div class='related-work'>two</div><p class='search-result'>three</p><div class='share-bar'>x</div><div class='ad'>y</div></article>"
    assert extracted(spark, inside, "<div class='related-work'>two</div><p>one</p>") == ["one\n\ntwo\n\nthree", "one"]


def brute(pages, depth=8, least=5):
    """Windows of the text outside articles, looked up one by one over all pages of a host."""
    blocks, seen = {}, defaultdict(set)
    for i, (url, html) in pages.items():
        host = (re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", url or "") or [None, ""])[1].lower()
        blocks[i] = (host, blocks_of(html or ""))
        words = [w for zone, text in blocks[i][1] if zone != MAIN for w in text.split()]
        for k in range(len(words) - depth + 1):
            seen[host, tuple(words[k:k + depth])].add(i)
    out = {}
    for i, (host, found) in blocks.items():
        words = [w for zone, text in found if zone != MAIN for w in text.split()]
        gone = set()
        for k in range(len(words) - depth + 1):
            if len(seen[host, tuple(words[k:k + depth])]) >= least:
                gone.update(range(k, k + depth))
        kept, at = [], 0
        for zone, text in found:
            if zone == MAIN:
                kept.append((zone, text))
                continue
            own = text.split()
            if any(at + j in gone for j in range(len(own))):
                text = " ".join(w for j, w in enumerate(own) if at + j not in gone)
            at += len(own)
            if zone == BODY and text:
                kept.append((zone, text))
        inside, around = (sum(len(t) for z, t in kept if z == want) for want in (MAIN, BODY))
        alone = inside and 2 * inside >= around
        out[i] = "\n\n".join(t for z, t in kept if z == MAIN or not alone)
    return out


@pytest.mark.parametrize("shard_bytes", [4_000_000, 20_000])
def test_pages_without_an_article_match_a_plain_search(spark, sf_dir, shard_bytes):
    """The given pages, on few hosts, their articles and chrome turned into plain blocks: only repeats decide."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    bare = F.regexp_replace("html", r"<(/?)(?:article|footer|nav)\b[^>]*>", "<$1div>")
    notice = F.concat(F.lit("<p>This site uses small files to make every visit better for all of its readers.</p>"), F.lit("<p>A line that only "), "page_id",
                      F.lit(" has</p></body>"))
    made = pages.withColumn("url", F.concat(F.lit("http://host"), (F.col("page_id") % 3).cast("string"), F.lit(".org/"))).withColumn(
        "html", F.regexp_replace(F.regexp_replace(bare, ' class="ad"', ""), "</body>", "@@@"))
    made = made.withColumn("html", F.concat(F.regexp_replace("html", "(?s)@@@.*", ""), notice))
    want = brute({r["page_id"]: (r["url"], r["html"]) for r in made.collect()})
    got = {r["page_id"]: r["text"] for r in main_text(made, shard_bytes=shard_bytes).collect()}
    assert got == want
    assert not any("uses small files" in t for t in got.values()) and all(t.endswith(f"{i} has") for i, t in got.items())


def test_given_pages_keep_their_articles(spark, sf_dir):
    for r in entry.queries()["op5_html_extraction"](spark, sf_dir).collect():
        assert r["n_chars"] == len(r["text"]) > 0
