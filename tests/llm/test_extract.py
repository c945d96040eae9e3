"""Templates decide what the main text is: pages without an article element, optional parts, copies, long pages."""

import html
import os
import random
import re
import time

import pytest

from starling.llm import extract

MEDIUM = "/root/testdata/sf0.01"
SCHEMA = "page_id long, url string, html string, host string, texts string"


def texts(spark, rows):
    return {r.page_id: r.text for r in extract.main_texts(spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)).collect()}


@pytest.mark.skipif(not os.path.isdir(MEDIUM), reason="needs the test tables")
@pytest.mark.parametrize("name", ["", "div", "section", "div class=x7", "main"])
def test_the_article_element_does_not_decide(spark, name):
    pages = spark.read.parquet(f"{MEDIUM}/pages.parquet").collect()
    opening, closing = (f"<{name}>", f"</{name.split()[0]}>") if name else ("", "")
    got = texts(spark, [(r.page_id, r.url, r.html.replace("<article>", opening).replace("</article>", closing)) for r in pages])
    for r in pages:
        article = r.html.split("<article>")[1].split("</article>")[0]
        blocks = (" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def site(rng, n, host="http://a.test/"):
    """Pages of one template without any telling name: a box that never changes, a part on some pages, a short line that varies."""
    out, want = [], {}
    for i in range(n):
        body = [" ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) + str(rng.randint(0, 99)) for _ in range(30)) for _ in range(rng.randint(2, 5))]
        some = "<div class=q3><span>Follow the station</span></div>" if i % 3 == 0 else ""
        html = f"<div class=q1>Weather {i}</div><div class=q2><h2>Title {i % 4}</h2><div class=q5>All rights in this box</div>{some}{''.join(f'<p>{b}</p>' for b in body)}</div>"
        out.append((i, f"{host}{i}", f"<html><body>{html}</body></html>"))
        want[i] = "\n".join([f"Title {i % 4}", *body])
    return out, want


def test_template_and_optional_classes_are_left_out(spark, monkeypatch):
    rows, want = site(random.Random(1), 12)
    rows += [(90, "http://a.test/x", None), (91, "http://a.test/y", ""), (92, "http://a.test/z", "<p>gone</p>")]
    got = texts(spark, rows)
    assert got == want | {90: "", 91: "", 92: "gone"}
    # Without the templates both the box and the part on some pages would stay.
    whole = extract.templates
    monkeypatch.setattr(extract, "templates", lambda read, **o: whole(read, **o).selectExpr("host", "elements", "cast(array() as array<bigint>) AS template"))
    without = texts(spark, rows)
    assert all("All rights" in without[i] for i in want) and all(("Follow" in without[i]) == (i % 3 == 0) for i in want)


def test_copies_keep_their_text(spark):
    rows, want = site(random.Random(2), 8)
    copies = [(100 + i, f"http://b.test/{i}", rows[0][2]) for i in range(5)]  # a host of one page, over and over
    pairs = [(200 + i, f"http://a.test/c{i}", rows[1][2].replace("</h2>", "</h2><blockquote>Only here</blockquote>")) for i in range(3)]  # copies among others, with an element of their own
    got = texts(spark, rows + copies + pairs)
    assert all(got[i] == want[i] for i in want)
    assert {got[100 + i] for i in range(5)} == {"\n".join(["Title 0", "All rights in this box", "Follow the station", *want[0].split("\n")[1:]])}
    first, rest = want[1].split("\n", 1)
    assert {got[200 + i] for i in range(3)} == {f"{first}\nOnly here\n{rest}"}


def test_numbers_of_pages_in_classes_are_alike(spark):
    rows = [(i, f"http://a.test/{i}", f"<body><div class=teaser{i + 10}>Read also {'x' * i}</div><div class=post-{i + 4711}><h1>Name {i}</h1><p>{'long text ' * 20}{i}</p><p>more {i}</p></div></body>") for i in range(4)]
    assert texts(spark, rows) == {i: f"Name {i}\n{('long text ' * 20)}{i}\nmore {i}" for i in range(4)}


def test_headings_beside_the_main_slot_belong_to_it(spark):
    rows = [(i, f"http://a.test/{i}", f"<body><div class=top>Line {i}</div><section><h1>Name {i}</h1><div class=t><p>{'long text ' * 20}{i}</p><p>more {i}</p></div></section></body>") for i in range(4)]
    assert texts(spark, rows) == {i: f"Name {i}\n{('long text ' * 20)}{i}\nmore {i}" for i in range(4)}


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x", "<b>" * 50_000 + "<p>x" * 1000, "<div>" * 20_000 + "</span>" * 200_000 + "x", "<p>one two</p>" * 100_000, "<a b='" * 50_000, "<p><b>" * 50_000 + "x", "word " * 500_000])
def test_long_and_deep_pages_take_linear_time(page):
    began = time.perf_counter()
    extract.Page(page, extract.Names())
    assert time.perf_counter() - began < 10
