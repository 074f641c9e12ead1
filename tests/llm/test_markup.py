import pytest

from conftest import rows
from quire.llm import markup as M


@pytest.mark.parametrize(
    "text, want",
    [
        ("<p>a</p>", ["html"]), ("a<br/>b", ["html"]), ("x <!-- c --> y", ["html"]), ("&lt;p&gt;a&lt;/p&gt;", ["html"]), ("wait&#8230; now", ["html"]), ("a&nbsp;b", ["html"]),
        ("some **bold** text", ["markdown"]), ("~~a~~ __b__", ["markdown"]), ("[a](http://x)", ["markdown"]), ("![a](i.png) x", ["markdown"]), ("Run `x --all` first.", ["markdown"]), ("a\n```\nx = 1\n```", ["markdown"]), ("Head\n====\n\ntext", ["markdown"]), ("# Head\ntext", ["markdown"]), ("| a | b |\n|---|---:|\n| c | 1 |", ["markdown"]), ("- a\n- b", ["markdown"]), ("> said", ["markdown"]),
        ("'''bold''' x", ["wiki"]), ("''it'' x [[Category:y]]", ["wiki"]), ("{{Infobox|a=b}} x", ["wiki"]), ("== Head ==\ntext", ["wiki"]), ("{|\n! a\n|-\n| b\n|}", ["wiki"]), ("__NOTOC__\n=== h ===\n* a\n* b", ["wiki"]),
        ("\\emph{a} b", ["latex"]), ("$k^2 + 1 = \\frac{1}{2}$", ["latex"]), ("\\[ \\sum x \\]", ["latex"]), ("``quoted'' --- text \\cite{a}", ["latex"]), ("\\begin{itemize}\n\\item a\n\\end{itemize}", ["latex"]),
        ("<b>x</b> and **y**", ["html", "markdown"]),
        ("If a < b and b > c, then.", []), ("Readers <3 this.", []), ("AT&T and Q & A; price ~£4.", []), ("from $5 to $10", []), ("3 * 4 * 12 sheets, 5* rated", []), ("notes_old_copy in C:\\books\\new.", []), ("Chapters 1-3 {revised} [sic]", []), ("E = m c^2 in words", []), ("Ranked #1", []), ("- one line", []), ("", []),
    ],
)
def test_kinds(text, want):
    assert M.kinds(text) == want


def test_pages():
    page = "<html><head><title>**t**</title></head><body><h2>Head</h2><p>Text <b>b</b> &lt;i&gt;x&lt;/i&gt;</p><pre>**code**</pre><math><mi>x_1_</mi></math><ul><li>a<li>b</ul></body>"
    assert M.residue("html", page) == [("html", True)]
    clean = M.cleaned("html", page)
    assert "## Head" in clean and "```\n**code**\n```" in clean and "- a\n- b" in clean and "<i>" not in clean and "$x_1_$" in clean
    nav = "<div>" + "<a href='x'>link to somewhere</a> " * 30 + "</div><div><p>" + "The main text is long and dense with words. " * 40 + "</p></div>"
    assert "link to" not in M.cleaned("html", nav) and "main text" in M.cleaned("html", nav)
    assert M.rewrite("== A ==\n'''b''' [[c|d]]") == "## A\nb d" and M.rewrite("\\section*{A} caf\\'e $x^2$") == "## A\ncafé $x^2$"
    assert M.rewrite("<p>a</p><ul><li>b</ul>") == "a\n- b" and M.cleaned("html", "plain") == "plain" and M.cleaned("html", "</p></div><p") is not None


def test_text_beside_a_dense_list_is_kept():
    items = "".join(f"<li>{'a long item of a list that outweighs its body ' * 6}{i}" for i in range(12))
    links = "<div>" + "".join(f"<p><a href='x'>nav {i}</a></p>" for i in range(9)) + "<p>No link at all.</p><h3><a href='y'>Linked head</a></h3></div>"
    page = f"<html><body><h1>Chapter</h1><p><i>A</i> <b>short</b> <i>one</i>.</p><ol>{items}</ol><div><h2>Next</h2><p>End.</p></div>{links}</body></html>"
    clean = M.cleaned("html", page).split("\n")
    assert {"# Chapter", "A short one.", "## Next", "End.", "No link at all.", "### Linked head"} <= set(clean)
    assert sum(x.startswith("- a long item") for x in clean) == 12 and not any("nav" in x for x in clean)


def test_rows(spark, make):
    long = "<p>" + "word " * 60_000 + "**x**</p>"
    d = make(books=[{"book_id": 1, "description": "**a** b", "html": None}, {"book_id": 2, "description": " ", "html": long}, {"book_id": 3, "description": None, "html": ""}, {"book_id": 1, "description": "x", "html": "y"}])
    assert rows(M.p5_found(spark, d), "book_id", "field", "markup") == [(1, "description", "markdown"), (2, "html", "markdown")]
    assert M.p5_clean(spark, d).count() == 4 and M.p5_found(spark, make(books=[])).count() == 0


def test_long_and_nested_markup_is_found_and_cleaned():
    long = "word " * 400
    for text, kind in ((f"**{long}x**", "markdown"), (f"[{long}](http://x)", "markdown"), (f"{{{{Box|{long}|{{{{in|ner}}}}|{{a}}}}}} x", "wiki"), (f"''{long}x''", "wiki"), (f"[[{long}x]]", "wiki"), (f"$${long}$$", "latex"), (f"``{long}x'' y", "latex"), (f"\\[ a +\n {long} \\]", "latex"), (f"&lt;p title=\"{long}\"&gt;x", "html")):
        assert kind in M.kinds(text), text[:20]
    assert M.rewrite(f"{{{{Box|{long}|{{{{in|ner}}}}|{{a}}}}}} x") == "x" and M.rewrite("\\a{\\b{\\c{\\d{\\e{x}}}}} \\emph{y}") == "x y"
    for bad in ("[" * 20_000, "``" + "a" * 30_000, "$" + "a=" * 20_000, "''" * 3 + " a" * 20_000, "\\[" * 5000, "{{" * 10_000, "&lt;a " * 5000):
        M.kinds(bad)


def test_markup_outside_the_main_text_counts():
    nav = "<div>" + "<a href='x'>link **to** somewhere</a> " * 30 + "</div><div><p>" + "The main text is long and dense with words. " * 40 + "</p></div>"
    assert M.residue("html", nav) == [("markdown", False)] and M.residue("html", nav + "<p>''x''</p>") == [("markdown", False), ("wiki", True)]


def test_structure_of_planted_pages():
    import random

    r = random.Random(3)
    total = right = 0
    for _ in range(60):
        want, body = [], []
        for k in range(r.randrange(3, 9)):
            kind, text = r.choice(("h", "p", "li", "pre", "math")), " ".join(r.choice("the old mill keeper told a long story of rain".split()) for _ in range(r.randrange(3, 30))) + f" {k}"
            level = r.randrange(1, 5)
            body.append({"h": f"<h{level}>{text}</h{level}>", "p": f"<p>{text}</p>", "li": f"<ul><li>{text}</li></ul>", "pre": f"<pre>{text}</pre>", "math": f"<p><math><mi>{text}</mi></math></p>"}[kind])
            want.append({"h": "#" * level + " " + text, "p": text, "li": "- " + text, "pre": text, "math": f"${text}$"}[kind])
        links = "<div class='nav'>" + "".join(f"<a href='{i}'>go {i}</a> " for i in range(12)) + "</div>"
        clean = M.cleaned("html", f"<html><body>{links}{''.join(body)}{links}</body></html>")
        got = clean.split("\n")
        total += len(want)
        right += sum(w in got for w in want)
        assert "go 3" not in clean or sum(map(len, want)) < 150
    assert right >= 0.99 * total
