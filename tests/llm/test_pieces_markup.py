"""Pieces by what pieces must satisfy; markup kinds and clean texts by cases."""

from __future__ import annotations

import random

import pytest

from velumine.llm import markup as M
from velumine.llm import pieces as P


def check(text, limit, overlap):
    raw, got = text.encode("utf-8", "surrogatepass"), P.split(text, limit, overlap)
    if len(raw) <= limit:
        assert got == []
        return got
    assert got[0].start == 0 and got[0].overlap == 0 and got[-1].end == len(raw)
    for p, q in zip(got, got[1:]):
        assert q.start + q.overlap == p.end and 0 <= q.overlap <= overlap and q.end > p.end
    for p in got:
        assert 0 < p.end - p.start <= limit
        assert raw[p.start : p.end].decode("utf-8", "surrogatepass") == p.text
    longest = max((len(w.encode("utf-8", "surrogatepass")) for w in text.split()), default=0)
    assert any(p.forced for p in got) == (longest > limit)
    return got


@pytest.mark.parametrize("seed", range(40))
def test_random_texts(seed):
    rnd = random.Random(seed)
    alphabet = rnd.choice(["ab .", "aé漢😀 \n", "ab\n\n.! ", "x", " \n\t\u00a0y", "ab,;: "])
    text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 900)))
    check(text, rnd.choice([12, 40, 100]), rnd.choice([0, 5, 8]))


def test_runs_about_the_limit():
    for n in (99, 100, 101, 102, 200, 201):
        for lead in ("", "a ", "word " * 30):
            check(lead + "x" * n + " tail", 100, 20)


def test_ideographic_sentences_in_a_long_run_are_forced():
    for mark in "。！？":
        got = check("漢字の文です" * 4 + mark + ("漢字の文です" * 3 + mark) * 20, 300, 20)
        assert all(p.boundary >= P.SENTENCE and p.forced for p in got)
        check(("漢字の文です" * 3 + mark + " ") * 20, 300, 20)
    got = check("word " * 100 + ("漢字の文です。" * 20) + " word" * 100, 300, 20)
    assert not got[0].forced and not got[-1].forced


def test_cuts_at_paragraphs_first():
    text = ("Sentence one is here. Sentence two is there.\n" * 4 + "\n") * 6
    got = check(text, 400, 40)
    assert all(p.boundary == P.PARAGRAPH for p in got)


def test_very_long_text():
    assert len(check("word and more. " * 200_000, 6000, 200)) > 500


def test_table(spark):
    docs = spark.createDataFrame([(1, "a b " * 2000, "x"), (1, "a b " * 2000, "x"), (2, None, "x"), (3, "", "x"), (4, "y" * 7000, None)], "doc_id long, text string, item_id string")
    chunks = spark.createDataFrame([("c", " Paragraph", "e f " * 400, 50, "z"), ("d", "document", "e f " * 400, 0, "z"), ("e", None, "e f " * 400, 0, "z"), ("f", "sentence", "g " * 700, None, "z")], "id string, level string, text string, start_offset long, overlap string")
    rows = P.pieces(docs, chunks).collect()
    assert {(r["table_name"], r["item_id"], r["level"]) for r in rows} == {("documents", "1", "document"), ("documents", "4", "document"), ("chunks", "c", "paragraph"), ("chunks", "f", "sentence")}
    assert {r["item_id"] for r in rows if r["forced"]} == {"4"}
    assert min(r["start_offset"] for r in rows if r["item_id"] == "c") == 50
    assert P.pieces(docs.limit(0), chunks.limit(0)).count() == 0


PLAIN = [
    "", "plain words only", "Keep a < 5 and b > 4 for x", "costs $ 4927 now; paid $5119 and $1790 before", r"sit in C:\data\tura\pastry since", "R&D calls run_all_tests and is_ok at 5%", "# 5 is a number", "#6890 (x)",
    "<|endoftext|>Text 1<|startoftext|>", "Arrows such as -> and <- mark {it}", "Note [7] says 5 * 120 * 2 is", "a_b_c and __init__ and 2*3*4", "x = ['a', 'b']", "~5 ~ 6", "a - b\nc – d", "it''s", "array[3][4] <- y",
]
KINDS = {
    "html": ["<p>x</p>", "a<br/>b", "<!-- c -->", "<!DOCTYPE html>", "A &amp; B", "&#8217;s", "&eacute;", "<a\n href=x>y</a>", "<pre>**a** [[b]]</pre>", "<script>var a = '**b**';</script>", "<IMG SRC='a > b'>"],
    "markdown": ["# Head", "Head\n====", "Head\n----", "**b** c", "*i* c", "__s t__", "_i t_", "~~s~~", "`c`", "```\n<p>\n```", "~~~py\n[[x]] \\section{a}\n~~~", "- item", "+ item", "1. item", "- [x] done", "|a|b|\n|---|---|", "> quoted", "[a](http://b)", "![a](b.png)", "[a][1]", "text[^1]", "[^1]: note", "<https://a.b>", "> ```\n> <b>\n> ```"],
    "wiki": ["''i''", "'''b'''", "[[a]]", "[[a|b]] c", "[https://a.b c]", "{{t|x}}", "{{Infobox a\n|b=c\n}}", "== Head ==", "{| class=\"x\"\n|-\n| a || b\n|}", "* [[a]] b", "# [[a]] b", "** [[a]] b"],
    "latex": [r"\section{a}", r"\begin{itemize}" + "\n" + r"\item a" + "\n" + r"\end{itemize}", "$x^2$", "$$a$$", r"\[ a \]", r"\( a \)", r"word\footnote{x}", r'o\"{o}o', r"\textbf{a}", r"\begin{verbatim}**a** <p>\end{verbatim}", r"{\em a}"],
}


@pytest.mark.parametrize("text", PLAIN)
def test_no_markup(text):
    assert M.analyse(text)[0] == set()


@pytest.mark.parametrize(("kind", "text"), [(k, t) for k, ts in KINDS.items() for t in ts])
def test_kind(kind, text):
    assert M.analyse(text)[0] == {kind}


def test_clean_text_keeps_structure():
    page = "<html><body><h2>Title</h2><p>One <b>two</b> &amp; three is a long enough line of text.</p><ul><li>a</li><li>b</li></ul><pre>x &lt; y</pre></body></html>"
    clean = M.analyse(page)[1]
    assert "## Title" in clean and "One two & three" in clean and "- a\n" in clean and "```\nx < y\n```" in clean
    assert M.analyse("\\section{A}\n\\begin{enumerate}\n\\item b\n\\item c\n\\end{enumerate}\n$x$")[1] == "## A\n\n1. b\n2. c\n\n$x$"
    assert M.analyse("== A ==\n* [[b|c]] d\n'''e''' {{t}}")[1] == "## A\n- c d\ne"
    assert M.analyse("# A\n\n**b** [c](d)\n\n```py\n*x*\n```")[1] == "# A\n\nb c\n\n```py\n*x*\n```"
    assert M.analyse(None) == (set(), "")


def test_head_without_an_end():
    body = "<h1>Guide</h1><p>All the body text.</p>"
    for lead in ("<!doctype html><html><head><title>X</title><body>", "<head><meta charset=utf-8><title>X</title>", "<head><title>X</title></head><body>", "<head><style>a {}</style><head><title>X</title></head>"):
        assert M.analyse(lead + body)[1].split("\n")[::2] == ["# Guide", "All the body text."], lead
    assert M.analyse("<head><link href=x>Bare text of a chunk")[1] == "Bare text of a chunk"
    assert M.analyse("<head><title>Text of a cut chunk")[1] == "Text of a cut chunk"
    assert M.analyse("<head><noscript><p>off</p></noscript><title>X</title></head><p>Body</p>")[1] == "Body"


def test_navigation_is_left_out():
    menu = "<div>" + "<a href=/x>m</a> " * 30 + "</div>"
    body = "".join(f"<p>{'This line of the page holds real content. ' * 4}</p>\n" for _ in range(6))
    clean = M.analyse(f"<html><body>\n{menu}\n\n\n\n\n{body}\n\n\n\n\n{menu}</body></html>")[1]
    assert "real content" in clean and "m m m" not in clean


def test_markup_table(spark):
    docs = spark.createDataFrame([(1, "**a**", "q"), (1, "**a**", "q"), (2, None, "q"), (3, "<p>" * 20_000, "q"), (4, "`" * 5000 + "*" * 5000 + "[" * 5000, "q")], "doc_id long, text string, kinds string")
    chunks = spark.createDataFrame([("c", "PARAGRAPH ", "[[x]]"), ("d", "sentence", "[[x]]"), ("e", "paragraph", "")], "id string, level string, text string")
    got = {tuple(r) for r in M.kinds_found(docs, chunks).collect()}
    assert {("documents", "1", "markdown"), ("documents", "3", "html"), ("chunks", "c", "wiki")} <= got and not any(r[1] in "2de" for r in got)
    assert M.kinds_found(docs.limit(0), chunks.limit(0)).count() == 0


ARTICLE = "<h1>Guide to things</h1><p>This is a long paragraph of the article, which says a lot about the things that matter.</p><p>Short note.</p><ul><li>red</li><li>blue</li></ul><p>Another paragraph that tells more about it, with a <a href='x'>link</a> in the middle.</p><pre>a &lt; b</pre>"
MENU = "<ul><li><a href='/'>Home</a></li><li><a href='/b'>About us</a></li><li><a href='/c'>Contact</a></li></ul>"
FOOTER = "<footer><a>Imprint</a> <a>Privacy</a></footer>"
CLEAN = "# Guide to things\n\nThis is a long paragraph of the article, which says a lot about the things that matter.\n\nShort note.\n\n- red\n- blue\n\nAnother paragraph that tells more about it, with a link in the middle.\n\n```\na < b\n```"


@pytest.mark.parametrize("front", ["", "<!-- " + "x" * 100_000 + " -->"])
@pytest.mark.parametrize("page", ["<!doctype html><html><head><title>T</title></head><body>{}{}{}</body></html>", "{}<body>{}{}"])
def test_pages_lose_menus_and_footers_only(front, page):
    assert M.analyse(front + page.format(MENU, ARTICLE, FOOTER)) == ({"html"}, CLEAN)


def test_a_list_of_links_in_a_fragment_stays():
    assert "- About us" in M.analyse(MENU)[1]


def test_what_is_no_element_is_text():
    for t in ("Vec<String> and a <b and c", "x < 3 <T> R&D </Foo> &nosuch; <! no>", "<a/b/c>"):
        assert M.analyse(t) == (set(), t)
    assert M.analyse("Map<String, Foo> is <b>bold</b>") == ({"html"}, "Map<String, Foo> is bold")
    assert M.analyse("AT&amp;T &#8211; R&D") == ({"html"}, "AT&T – R&D")


def test_templates_at_any_depth():
    deep = "{{a|" * 500 + "}}" * 500
    assert M.analyse(f"before {deep} after") == ({"wiki"}, "before  after")
    assert M.analyse("keep {one} and } two")[1] == "keep {one} and } two"


def test_tables_stay_whole():
    assert M.analyse("| a | b |\n|---|---|\n| 1 | 2 |")[1] == "| a | b |\n| 1 | 2 |"
