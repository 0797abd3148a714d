"""Queries that take whole texts."""

from __future__ import annotations

import re

from lexatlas.plans import QUERIES
from lexatlas.sources.workspace import table


def test_marks_of_whole_pages(spark, small):
    pages = {r["page_id"]: r["html"] for r in table(spark, small, "pages").collect()}
    got = {r["page_id"]: r["text"] for r in QUERIES["solo_marcas"](spark, small).collect()}
    assert max(map(len, pages.values())) > 3000
    for page_id, html in pages.items():
        want = re.sub(r"(?i)<mark\s[^>]*>", "<mark>", html + '<mark class="x">a</mark> <marker>b')
        assert got[page_id] == re.sub(r"(?i)<(?!/?mark>)[^>]*>", "", want)
