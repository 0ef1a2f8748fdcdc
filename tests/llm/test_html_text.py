import random
import re

from stormlake.llm.html_text import extract_text, render


def test_layout():
    page = (
        "<title>x</title><body><h1>Head</h1><p>One <b>two</b><p>three<br>four<ul><li>a<li>b<ol><li>c<li>d</ol></ul>"
        "<table><tr><td>k<td>value<tr><td>longer key<td>v<br>w</table><div hidden>no</div><pre> x\n  y</pre>tail &amp; end"
    )
    assert render(page) == (
        "Head\n\nOne two\n\nthree\nfour\n\n- a\n- b\n  1. c\n  2. d\n\nk           value\nlonger key  v\n            w\n\n x\n  y\n\ntail & end"
    )


def test_visibility_and_implied_tags():
    assert render("<head><meta charset=x>stray<p>text") == "stray\n\ntext"
    assert render("<p style='color:red; display: none'>a<b>b</b></p><p>c</p><span style=visibility:hidden>d</span>") == "c"
    assert render("<script>var t='</p>';</script><style>p{}</style><!-- no -->yes<template>no</template>") == "yes"
    assert render("<select><option>a<option>b</select><textarea>c</textarea>") == "a\nb\nc"
    assert render("<dl><dt>t<dd>d<dt>u</dl>") == "t\n  d\nu"
    assert render("<table><caption>cap<tr><th>a<th colspan=2>b<tr><td>1<td>2<td>3</table>").splitlines()[0] == "cap"
    assert render("<table><tr><td><table><tr><td>in<td>ner</table><td>x</table>") == "in  ner  x"


def test_broken_and_odd_pages():
    assert render("") == "" and render("plain") == "plain" and render("a < b > c") == "a < b > c"
    assert render('<a href="x">open') == "open" and render('<a href="x') == "" and render("</p></div>x") == "x"
    assert render("<td>cell outside") == "cell outside"
    assert render("<div>" * 20000 + "deep") == "deep"
    assert render("<li>" * 3000 + "x").endswith("x")
    assert render("<p " + 'a="' * 20000 + ">t").endswith("t")
    assert render("<table>" + "<tr><td>" + "w " * 100000 + "<tr><td>b<td>c" * 50).count("c") == 50


def test_all_visible_words_stay(spark):
    rng = random.Random(4)
    inline, block = ["b", "i", "span", "a"], ["p", "div", "h2", "section", "blockquote", "ul", "li", "table", "tr", "td", "pre"]
    rows, wanted = [], {}
    for key in range(200):
        html, words = [], []
        for i in range(rng.randint(0, 40)):
            kind = rng.randrange(4)
            if kind == 0:
                html.append(f"<{rng.choice(block + inline)}>")
            elif kind == 1:
                html.append(f"</{rng.choice(block + inline)}>")
            elif kind == 2:
                html.append(f"<script>hidden{i}</script><p hidden>gone{i}</p>")
            else:
                words.append(f"w{key}x{i}")
                html.append(f" {words[-1]} ")
        rows.append((key, "".join(html), 0))
        wanted[key] = sorted(words)
    found = extract_text(spark.createDataFrame(rows, "page_id long, html string, text int")).collect()
    assert {r["page_id"]: sorted(re.findall(r"w\d+x\d+", r["text"])) for r in found} == wanted
    assert not any("hidden" in r["text"] or "gone" in r["text"] for r in found)


def test_null_and_empty(spark):
    rows = spark.createDataFrame([(1, None), (None, "<p>a"), (2, ""), (2, "")], "page_id long, html string")
    assert sorted(map(tuple, extract_text(rows).collect()), key=str) == sorted([(1, None), (None, "a"), (2, ""), (2, "")], key=str)
    assert extract_text(spark.createDataFrame([], "page_id long, html string")).collect() == []
