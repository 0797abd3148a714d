"""Repair of conversations against SQL on the table, and against a search of all edits on small ones."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from lexatlas.llm import structure_repair as sr
from lexatlas.llm.queries import ORACLE, QUERIES

NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, at string, n string, edit string, part string, code string"
WHITE = re.compile(r"[^\x20\x09-\x0D]")
FORM, OPEN_FORM = re.compile(r"(s?(ua)+)?"), re.compile(r"s?(ua)*u?")


def damaged(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def cheapest(rows: list[tuple]) -> tuple[int, str, list[str]]:
    """Cost, letters and messages, by a search in order of cost and letters. rows: (role, text, fault)."""
    heap, seen = [(0, "", 0, "", [])], set()
    while heap:
        cost, letters, i, roles, said = heapq.heappop(heap)
        if i == len(rows) and FORM.fullmatch(roles):
            return cost, letters, said
        key = (i, roles[-2:] if roles != "s" else "s")
        if key in seen or not OPEN_FORM.fullmatch(roles):
            continue
        seen.add(key)
        for r in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, letters + "I", i, roles + r[0], [*said, r + ":"]))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, letters + "D", i + 1, roles, said))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                heapq.heappush(heap, (cost + more, letters + "K", i + 1, roles + (role[:1] or "?"), [*said, f"{role}:{text}"]))
                for r in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 3 + more, letters + "R", i + 1, roles + r[0], [*said, f"{r}:{text}"]))
    raise AssertionError


def plain(rows: list[tuple]) -> list[tuple]:
    by_conv = defaultdict(list)
    for r in damaged(rows):
        by_conv[r[0]].append(r[1:])
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(by_conv[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            end = text.rstrip("".join(map(chr, (32, *range(9, 14)))))
            faults.append("blank" if not WHITE.search(text) else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, *_ in own if t is not None}
        cost, letters, said = cheapest([(r, t, f) for (_, r, t), f in zip(own, faults)])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=repr)


def made(df) -> list[tuple]:
    return sorted(map(tuple, df.select(*NAMES).collect()), key=repr)


def test_the_table(spark, small):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{small}/conversations.parquet')")
    rows = con.execute("select conv_id, turn, role, text from conversations").fetchall()
    want = sorted(con.execute(f"select {', '.join(NAMES)} from ({ORACLE['op11_structure_repair']})").fetchall(), key=repr)
    assert want == plain(rows)
    assert made(QUERIES["op11_structure_repair"](spark, small)) == want


def some_rows(seed: int, convs: int, most: int) -> list[tuple]:
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "users", "é"], ["Hi.", "Yes!", "no", " \t\n", "", None, "a? \n", "Ok.", "ok.\x1c", "\r\x0b\x0c", "e.\r\x0b\f", "…", "b.", "c.", "d."]
    rows = [(conv, rng.choice([None, *range(-2, 6)]), rng.choice(roles[:3] if rng.random() < 0.7 else roles), rng.choice(texts)) for conv in [None, *range(convs)] for _ in range(rng.randrange(1, most))]
    return rows + [(900 + n, n, "user", "x") for n in range(60)]  # some of these are dropped whole


@pytest.mark.parametrize("size", [1, 2, 3, sr.FRAGMENT])
def test_odd_rows(spark, size):
    rows = some_rows(5, 60, 12)
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA)
    assert made(sr.audit(docs, size)) == plain(rows)


def test_one_conversation_over_many_ranges(spark):
    rng = random.Random(1)
    rows = [(7, t // 3 * 2, rng.choice(["user", "assistant"]), rng.choice(["A.", "B.", f"{t}.", f"{t}", ""])) for t in range(3000)]
    docs = spark.createDataFrame([(*r, None, None, None, None, None) for r in rows], SCHEMA)
    assert made(sr.audit(docs, 64)) == plain(rows)


def test_letters_of_ties():
    """A walk by tight arcs gives what a search by cost and letters gives."""
    rng = random.Random(11)
    for _ in range(400):
        rows = [(rng.choice(["user", "assistant", "system", "x"]), "t", rng.choice(["", "", "", "truncated", "blank"])) for _ in range(rng.randrange(1, 9))]
        codes = bytes("suax".index(r[0]) + {"": 0, "truncated": sr.OPEN, "blank": sr.BLANK}[f] for r, _, f in rows)
        found, last, reached = sr.steps(codes, sr.START, sr.ENDING, 0)
        letters = "".join("I" * len(a) + b for a, b, _ in found) + "I" * len(sr.close(last, reached))
        assert letters == cheapest(rows)[1]


def test_nothing(spark):
    assert sr.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    messages, report = sr.repair(spark.createDataFrame([], SCHEMA))
    assert messages.count() == report.count() == 0


def test_long_text(spark):
    rows = [(1, 0, "user", "word " * 400_000 + "." + " " * 100_000), (1, 1, "assistant", "a" * 2_000_000)]
    messages, report = sr.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [r["edit"] for r in messages.orderBy("at", "n").collect()] == ["K", "K"]
    assert tuple(report.select("truncated", "cost").first()) == (1, 3)
