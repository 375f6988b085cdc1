"""What stands in the article stays; wide pages in linear time."""

import random
import time

import pytest

pytest.importorskip("motionlake.llm")

from motionlake.llm import html_text as H  # noqa: E402


def texts_of(spark, pages, parts):
    df = spark.createDataFrame([(i, f"https://h.example/{i}", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")
    return {r.page_id: r.text for r in H.main_texts(df.repartition(parts)).collect()}


@pytest.mark.parametrize("parts", [1, 2, 3, 5, 7])
def test_fixed_headings_of_an_article_stay(spark, parts):
    page = "<nav><a>Home</a></nav><article><h1>Title {0}</h1><h2>Ingredients</h2><p>body {0} flour</p><h2>Method</h2><p>do {0}</p></article><footer>(c)</footer>"
    pages = [page.format(k) for k in range(5)]
    want = {k: f"Title {k}\nIngredients\nbody {k} flour\nMethod\ndo {k}" for k in range(5)}
    assert texts_of(spark, pages, parts) == want
    roles = [p.replace("<article>", "<div role='main'>").replace("</article>", "</div>") for p in pages]
    assert texts_of(spark, roles, parts) == want


def test_without_a_root_template_goes_only_around(spark):
    page = "<div>The Site</div><div><h1>Title {0}</h1><h2>Ingredients</h2><p>body {0} flour</p><h2>Method</h2><p>do {0}</p></div><div>Imprint</div>"
    got = texts_of(spark, [page.format(k) for k in range(6)], 1)
    assert got == {k: f"Title {k}\nIngredients\nbody {k} flour\nMethod\ndo {k}" for k in range(6)}
    same = texts_of(spark, ["<p>only this</p>"] * 4 + ["<p>only this</p><!-- x -->"], 2)
    assert set(same.values()) == {"only this"}


def test_wide_pages_take_linear_time():
    def page(n, k):
        rng = random.Random(k)
        return "<article>" + "".join(f"<{t}>{rng.randrange(99)}</{t}>" for t in rng.choices(["p", "h2", "ul", "dl", "pre"], k=n)) + "</article>"

    began = time.time()
    wrapper = H.align(H.page_items(page(50_000, 1)), H.page_items(page(50_000, 2)))
    for k in (1, 2):
        assert H.main_text(page(50_000, k), H.content_paths(wrapper), H.constants(wrapper)).count("\n") == 49_999
    assert time.time() - began < 40


def test_opcodes_cover_both_sides():
    rng = random.Random(4)
    for _ in range(500):
        a, b = (rng.choices("abcdefghijk", k=rng.randrange(40)) for _ in range(2))
        i = j = 0
        for op, i1, i2, j1, j2 in H.opcodes(a, b):
            assert (i1, j1) == (i, j) and (op != "equal" or a[i1:i2] == b[j1:j2])
            i, j = i2, j2
        assert (i, j) == (len(a), len(b))
    x = list("hello world")
    assert [o[0] for o in H.opcodes(x, x)] == ["equal"] and H.opcodes([], []) == []
