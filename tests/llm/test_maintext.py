"""Main text against a plain reading of pages that mark their article, decoding against all labellings, odd rows."""

import itertools
import math
import random
import re
from html import unescape

from pyspark.sql import functions as F

from evidentia.llm import maintext

SF = "/root/testdata/sf0.01"


def plain(html):
    """The one article of a table page: its headings and paragraphs."""
    body = re.search(r"<article[^>]*>(.*?)</article>", html, re.S).group(1)
    body = re.sub(r"(?i)</?(p|h1|h2|h3|ul|ol|li|div|blockquote|table|tr|td)\b[^>]*>", "\0", body)
    body = re.sub(r"<br[^>]*>", " ", body)
    parts = [" ".join(unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in body.split("\0")]
    return "\n\n".join(x for x in parts if x)


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    got = maintext.extract_text(pages).collect()
    assert len(got) == len(want)
    wrong = [r.page_id for r in got if r.text != want[r.page_id]]
    assert not wrong and all(r.n_chars == len(r.text) for r in got)


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<p"), (4, "w", "no tags at all"), (5, "x", "<article><p>a &amp; b&nbsp; c\n d</p></article>"), (5, "x", "<article><p>a &amp; b&nbsp; c\n d</p></article>"), (6, "y", "<div>" * 3000 + "deep"), (7, "z", "</p></div><td>" + "<b>" * 50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("clash"))
    got = maintext.extract_text(df).collect()
    assert sorted(str((r.page_id, r.url)) for r in got) == sorted(str(r[:2]) for r in rows)
    assert [r.text for r in got if r.page_id in (1, 2)] == ["", ""] and len({r.text for r in got if r.page_id == 5}) == 1
    assert maintext.extract_text(df.limit(0)).collect() == [] and maintext.extract_text(df.filter("page_id < 3")).agg(F.sum("n_chars")).first()[0] == 0


def test_long_page(spark):
    base = spark.read.parquet(f"{SF}/pages.parquet")
    one = "<html><body><nav><ul><li><a href=x>home</a></li></ul></nav><article><h1>t</h1>" + "".join(f"<p>paragraph {i} with some words, and more of them.</p>" for i in range(20_000)) + "</article><footer>end</footer></body></html>"
    extra = spark.createDataFrame([(-1, "long", one)], base.select("page_id", "url", "html").schema)
    got = maintext.extract_text(base.select("page_id", "url", "html").union(extra)).filter("page_id = -1").first()
    assert got.text == "t\n\n" + "\n\n".join(f"paragraph {i} with some words, and more of them." for i in range(20_000))


def test_decoding_is_the_best_of_all(spark):
    r = random.Random(5)

    class Tree:
        pass

    for _ in range(60):
        n = r.randint(1, 7)
        page = Tree()
        page.parent = [-1] + [r.randrange(i) for i in range(1, n)]
        # document order: a parent before its children
        chance = [r.random() for _ in range(n)]
        got = maintext.decode(page, chance)

        def value(inside):
            return sum(math.log(min(max(p if x else 1 - p, 1e-4), 1 - 1e-4)) for p, x in zip(chance, inside))

        def legal(inside, frame):
            for v in range(n):
                above = "frame" if v == 0 else ("in" if inside[page.parent[v]] else "frame" if frame[page.parent[v]] else "out")
                if above != "frame" and frame[v] or above == "out" and inside[v] or inside[v] and frame[v]:
                    return False
            return True

        best = max(value(i) for i in itertools.product([0, 1], repeat=n) for f in itertools.product([0, 1], repeat=n) if legal(i, f))
        assert abs(value(got) - best) < 1e-9
