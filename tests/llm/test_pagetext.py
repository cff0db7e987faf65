import html
import random
import re
import time

from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType

from folioframe.llm import pagetext
from folioframe.llm.queries import QUERIES

PAGES = StructType([StructField("page_id", LongType()), StructField("url", StringType()), StructField("html", StringType())])


def article_text(page):
    """Text of a plain article of h1, p, b and br elements."""
    body = re.search(r"<article>(.*)</article>", page, re.DOTALL)[1]
    blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(b for b in blocks if b)


def test_query_on_given_table(spark, sf_dir):
    rows = QUERIES["op12_html"](spark, sf_dir).collect()
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == article_text(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def made_page(rng, labelled=True):
    """(page, expected text): content between, before and around every kind of other element."""
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 8)))
    line = lambda n: " ".join(word() for _ in range(rng.randint(*n)))
    noise = ['<nav><ul><li><a href="/x">{0}</a></li></ul></nav>', "<header><h2>{0}</h2></header>", "<aside><p>{0}</p></aside>", '<div class="cookie-notice"><p>{0}</p></div>',
             "<form action=x><label>{0}</label><input name=q><textarea><p>{0}</p></textarea></form>", "<script>if (a < b) x = '<p>{0}</p>';</script>", "<style>p > b {{ {0} }}</style>",
             '<section id="comments"><h3>{0}</h3><div><p>{0}</p></div></section>', "<!-- <p>{0}</p> -->", '<div class="ad"><div><p>{0}<p>{0}</div></div>', "<div hidden><p>{0}</p></div>"]
    extra = lambda: "".join(rng.choice(noise).format(line((1, 30))) for _ in range(rng.randint(0, 3)))
    blocks = [line((2, 8))] + [line((5, 60)) for _ in range(rng.randint(1, 8))]
    body = f"<h1>{blocks[0]}</h1>" + extra()
    for b in blocks[1:]:
        parts = b.split(" ")
        parts[0] = f"<b class='x>y'>{parts[0]}</b>"
        body += f"<p>{rng.choice([' ', '  ', chr(10), '&#32;']).join(parts)}" + rng.choice(["</p>", ""]) + (extra() if rng.random() < 0.2 else "")
    top = f"<!DOCTYPE html><html><head><title>{blocks[0]}</title></head><body>" + extra()
    holder = ("<article>", "</article>") if labelled else ('<div id="c">', "</div>")
    return top + holder[0] + body + holder[1] + extra() + f"<footer>&copy; {line((1, 20))}</footer></body></html>", "\n".join(blocks)


def test_made_pages(spark):
    rng = random.Random(4)
    labelled = [made_page(rng) for _ in range(150)]
    bare = [made_page(rng, labelled=False) for _ in range(50)]
    df = spark.createDataFrame([(i, "u", p) for i, (p, _) in enumerate(labelled + bare)], PAGES).repartition(3)
    got = {r["page_id"]: r["text"] for r in pagetext.extract(df, ["page_id"]).collect()}
    right = [got[i] == t for i, (_, t) in enumerate(labelled + bare)]
    assert all(right[:150]) and sum(right[150:]) >= 45


def test_best_run_is_the_best():
    rng = random.Random(2)
    for _ in range(300):
        scores = [rng.choice([-3, -1, -0.25, 0, 1, 2, 5]) for _ in range(rng.randint(0, 12))]
        sums = {(a, b): sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)}
        lo, hi = pagetext.best_run(scores)
        best = max(sums.values(), default=0)
        if best <= 0:
            assert (lo, hi) == (0, 0)
        else:
            assert sums[lo, hi] == best
            assert not any(v == best and b - a > hi - lo and (a, b) != (lo, hi) and (a <= lo and b >= hi) for (a, b), v in sums.items())


def test_odd_pages(spark):
    weights = {"p": 0.25, "/p": 0.25}
    pages = [(1, None), (2, ""), (3, "   "), (4, "no markup at all &amp; fine &lt;p&gt;"), (5, "<p>open <b>never closed"), (6, "<<<>>< p> 1 < 2"), (7, "<script>never closed <p>text"),
             (8, "</p></div></nav>words after stray closes"), (9, "<div " + "a" * 100_000), (10, "<p>" * 20_000 + "deep"), (11, "<p title=\"unbalanced>text<p>two"), (11, "<p>same</p>"), (11, "<p>same</p>"),
             (12, "<P CLASS=Ad>x</P><P>Y</P>"), (13, "<p>caf&eacute; &#x4e2d;&#25991; &nosuch; &nbsp;x</p>"), (None, "<p>id null</p>")]
    odd = StructType([*PAGES.fields, *[StructField(n, DateType()) for n in ("text", "n_chars", "kind", "page")]])
    df = spark.createDataFrame([(i, None, p, None, None, None, None) for i, p in pages], odd)
    rows = pagetext.extract(df, ["page_id"], weights=weights).collect()
    got = {r["page_id"]: r["text"] for r in rows}
    assert len(rows) == len(pages)
    assert got[1] == got[2] == got[3] == got[7] == "" and got[4] == "no markup at all & fine <p>" and got[5] == "open never closed"
    assert got[8] == "words after stray closes" and got[10] == "deep" and got[12] == "Y" and got[13] == "café 中文 &nosuch; x" and got[None] == "id null"
    assert pagetext.fit(spark.createDataFrame([], PAGES)) == {} and pagetext.extract(spark.createDataFrame([], PAGES), ["page_id"]).count() == 0


def test_time_grows_with_length():
    for page in ("<p>a b c</p>" * 200_000, "<div>" * 100_000 + "x", "<a " * 200_000, "<b x='" * 100_000, "<script>" * 50_000, "<!--" * 100_000):
        start = time.time()
        found = pagetext.tokens(page)
        pagetext.text_of(found[slice(*pagetext.best_run(pagetext.score(found, {})))])
        assert time.time() - start < 20, page[:20]
