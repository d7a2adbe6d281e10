"""Exact in → out behaviour of the HTML rewriter."""

import pytest

from doclake.operators import html as H

CASES = [
    ("<strong>loud</strong> and <em>soft</em>", "**loud** and *soft*"),
    ("<del>old</del><mark> new </mark>x<sup>3</sup>", "~~old~~==new==x^3^"),
    ("press <kbd>Alt</kbd> for <q>menu</q>", 'press `[Alt]` for "menu"'),
    ("<b>one <i>two <s>three</s></i> four</b>", "**one *two ~~three~~* four**"),
    ("<b> a <b> b </b> c </b>", "**a **b** c**"),
    ("<p><b>never closed<br><p>next</p>", "never closed\n\nnext"),
    ('<img src="a.png" width="40" height="7%">', "![IMG](a.png#40x7%)"),
    ('<img alt="pic" src=b.png height="12em;">', "![pic](b.png#x12em)"),
    ('<a href=" /p?x=1&amp;y=2 ">go <b>on</b></a>', "[go **on**](/p?x=1&y=2)"),
    ("<a name='t'>anchor</a>", "anchor"),
    ('<a href="u"><img src="i.gif" alt="k"></a>', "[![k](i.gif)](u)"),
    ('<a href="u">two<br>lines</a>', "two\nlines"),
    ('<a href="u"><table><tr><td>only</td></tr></table></a>', "| only |\n| --- |"),
    ("<h3> Third </h3>text", "### Third\n\ntext"),
    ("before<hr>after", "before\n\n---\n\nafter"),
    ("<div></div><p> </p>kept", "kept"),
    ("<blockquote>outer<blockquote>inner</blockquote></blockquote>", "> outer\n> \n> > inner"),
    ("<details><summary>More</summary>hidden text</details>", "> ▼ More\n> \n> hidden text"),
    ("<pre>  keep\n    this  \n</pre>", "```\n  keep\n    this\n```"),
    ("<ul><li>a</li><li>b<ol start='4'><li>x</li><li>y</li></ol></li></ul>", "- a\n- b\n\n    4. x\n    5. y"),
    ("<ul><li><p>p1</p><p>p2</p></li><li>q</li></ul>", "- p1\n\n    p2\n- q"),
    ("<ul><li>open<li>item</ul>tail", "- open\n- item\n\ntail"),
    ("<ol><li></li><li>second</li></ol>", "1. \n2. second"),
    ("<ul><li><blockquote>q1<p>q2</p></blockquote></li></ul>", "- > q1\n    > \n    > q2"),
    ("<table><tr><th align=center>A</th><th>B</th></tr><tr><td>x|y</td></tr></table>", "| A | B |\n| :---: | --- |\n| x\\|y |  |"),
    ("<table><tr><td>l1<br>l2</td></tr></table>", "| l1<br>l2 |\n| --- |"),
    ("<script>if (a < b) {'</p>'}</script>shown<!-- not -->", "shown"),
    ("1 < 2 &amp;&amp; 3 &gt; 2 &#9731;&#x41;", "1 < 2 && 3 > 2 ☃A"),
    ("<article><nav>plain</nav></article>", "plain"),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(CASES)], "id int, html string")
    got = {r["doc_id"]: r["markdown"] for r in H.html_to_markdown(df, "id", "html").collect()}
    assert {i: got.get(i) for i in range(len(CASES))} == {i: md for i, (_, md) in enumerate(CASES)}


def test_deep_lists_keep_every_level(spark):
    depth = 40
    html = "".join(f"<ul><li>n{i}" for i in range(depth)) + "</li></ul>" * depth
    out = H.html_to_markdown(spark.createDataFrame([(1, html)], "id int, html string"), "id", "html").first()["markdown"]
    assert out == "\n\n".join("    " * i + f"- n{i}" for i in range(depth))


@pytest.mark.parametrize("op", [H.html_to_markdown, H.html_nesting])
def test_one_exchange(spark, op):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = op(df, "page_id", "html")._jdf.queryExecution().executedPlan().toString()
    # pages are dealt out once; besides, whole texts meet the ids of all pages, so that none is lost
    assert plan.count("REPARTITION_BY_NUM") == 1
    assert plan.count("Exchange hashpartitioning") == (2 if op is H.html_to_markdown else 1)


@pytest.mark.parametrize("op", [H.html_text, H.html_links, H.html_headings, H.html_images])
def test_extractors_do_not_shuffle(spark, op):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert "Exchange" not in op(df, "page_id", "html")._jdf.queryExecution().executedPlan().toString()
