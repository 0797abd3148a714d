"""Main text of pages whose names say little: what the tree itself tells."""

import random

import pytest

from lexatlas.llm.main_text import main_text
from tests.llm.test_long_and_odd_inputs import prose


def paragraphs(r, n=2):
    return [prose(r, r.randint(30, 60)) for _ in range(n)]


def p(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def test_a_form_around_the_page_is_not_its_fields():
    r = random.Random(1)
    body, ad = paragraphs(r), prose(r, 25)
    for inner in (f"<h1>T</h1>{p(body)}", f"<div class='sidebar'><p>{ad}</p></div><div><h1>T</h1>{p(body)}</div>"):
        assert main_text(f"<body><form id=aspnetForm><input type=hidden>{inner}<select><option>x</select></form></body>") == "\n".join(["T", *body])
    assert main_text(f"<body><form id=aspnetForm><div>{p(body)}</div></form></body>") == "\n".join(body)
    # a form beside or in the article, and one on a page without an article, stay out
    sign = f"<form><p>{prose(r, 12)}</p><p>{prose(r, 8)}</p><input></form>"
    assert main_text(f"<body><div><h1>T</h1>{p(body)}{sign}</div>{sign}</body>") == "\n".join(["T", *body])
    assert main_text(f"<body><article><h1>T</h1>{sign}{p(body)}</article></body>") == "\n".join(["T", *body])
    assert main_text("<body><form><p>Your name, please</p><input></form></body>") == ""


@pytest.mark.parametrize("wrap", ["<div id=page>{}</div>", "<main>{}</main>", "<article>{}</article>", "<div><section class=x>{}</section></div>"])
def test_short_lines_around_the_prose_stay(wrap):
    r = random.Random(wrap)
    for _ in range(20):
        body = paragraphs(r, r.randint(2, 4))
        html = wrap.format(f"<h1>T</h1><p>Short dek here.</p><div class=by>By Ann</div><div class=body>{p(body)}</div><div><p>A short last line.</p></div>")
        menu = "<div class=top>" + "".join(f"<a href=/{k}>word{k}</a> " for k in range(9)) + "</div>"
        assert main_text(f"<body>{menu}{html}</body>") == "\n".join(["T", "Short dek here.", "By Ann", *body, "A short last line."])


def test_title_and_dek_in_the_body_element():
    r = random.Random(3)
    body = paragraphs(r)
    html = f"<body><div><a href=/>Home</a> <a href=/b>B</a></div><h1>T</h1><p>Short dek.</p><div class=body>{p(body)}</div><div><a href=/x>More</a></div></body>"
    assert main_text(html) == "\n".join(["T", "Short dek.", *body])


def test_columns_made_alike_stay():
    r = random.Random(4)
    body = paragraphs(r, 3)
    html = f"<body><div id=page><h1>T</h1><div class=col>{p(body)}</div><div class=col><p>A short one.</p></div></div></body>"
    assert main_text(html) == "\n".join(["T", *body, "A short one."])


@pytest.mark.parametrize("wrap", ["<div id=page>{}</div>{}", "<div id=page>{}{}</div>", "<main>{}{}</main>", "<article>{}{}</article>"])
@pytest.mark.parametrize("kind", ["ol", "div"])
def test_comments_are_known_by_their_structure(wrap, kind):
    r = random.Random(kind + wrap)
    for _ in range(20):
        body = paragraphs(r, r.randint(2, 4))
        one = "<li>{}</li>" if kind == "ol" else "<div class=note>{}</div>"
        notes = "".join(one.format(f"<div><a href=/u{k}>Ann {k}</a> <time>May {k}</time></div><p>{prose(r, r.randint(3, 50))}</p>") for k in range(r.randint(2, 9)))
        tag = "ol" if kind == "ol" else "section"
        html = wrap.format(f"<h1>T</h1><div class=body>{p(body)}</div>", f"<{tag} class='reader-notes'>{notes}</{tag}>")
        assert main_text(f"<body>{html}</body>") == "\n".join(["T", *body])


def test_plain_comments_beside_the_article():
    r = random.Random(6)
    body = paragraphs(r)
    notes = "<ol class='reader-notes'>" + "".join(f"<li>{prose(r, 30)}</li>" for _ in range(4)) + "</ol>"
    assert main_text(f"<body><div id=page><h1>T</h1><div class=body>{p(body)}</div>{notes}</div></body>") == "\n".join(["T", *body])
    assert main_text(f"<body><article><h1>T</h1>{p(body)}</article><h2>Notes</h2>{notes}</body>") == "\n".join(["T", *body])
    assert main_text(f"<body><article><h1>T</h1>{p(body)}</article><div role=dialog><p>{prose(r, 90)}</p></div></body>") == "\n".join(["T", *body])


def test_lists_of_the_article_stay():
    r = random.Random(7)
    body = paragraphs(r)
    items = [prose(r, 12) for _ in range(3)]
    ul = "<ul>" + "".join(f"<li>{t}</li>" for t in items) + "</ul>"
    for html in (f"<article><h1>T</h1>{p(body)}{ul}</article>", f"<main><h1>T</h1><div>{p(body)}</div>{ul}</main>", f"<div id=c><h1>T</h1>{p(body)}{ul}</div>"):
        assert main_text(f"<body>{html}</body>") == "\n".join(["T", *body, *items])
    talk = "".join(f"<div class=qa><p>Why {k}?</p><p>{body[k]}</p></div>" for k in range(2))
    assert main_text(f"<body><article><h1>T</h1><p>{items[0]}</p>{talk}</article></body>") == "\n".join(["T", items[0], "Why 0?", body[0], "Why 1?", body[1]])
    parts = "".join(f"<section class=s><h2>Part {k}</h2><p>{body[k]}</p></section>" for k in range(2))
    assert main_text(f"<body><div id=c><h1>T</h1><p>{items[0]}</p>{parts}</div></body>") == "\n".join(["T", items[0], "Part 0", body[0], "Part 1", body[1]])


@pytest.mark.parametrize("piece", ["<form>", "<ol><li>a b", "<div class=x><p>ab</p><div class=x>", "<li><div><p>word, word, and so on to the end", "<dialog><h1>x"])
def test_linear_time(piece):
    import time

    began = time.time()
    main_text(piece * (600_000 // len(piece)))
    assert time.time() - began < 20
