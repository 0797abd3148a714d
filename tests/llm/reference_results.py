"""Plain, slow versions of the operators, for comparison on small fixtures."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def crc32_ids(ids: list[int]) -> int:
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def line_dedup(docs: list[tuple], window: int = 3) -> dict:
    """doc_id -> (text, n_lines, n_removed) of (doc_id, text) with distinct doc_ids."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        lines = text.split("\n") if text is not None else []
        gone = set()
        for i in range(len(lines) - window + 1):
            own = tuple(lines[i : i + window])
            if any(WORDS.search(x) for x in own):
                if own in seen:
                    gone |= set(range(i, i + window))
                seen.add(own)
        kept = [x for i, x in enumerate(lines) if i not in gone]
        out[doc_id] = (None if text is None else "\n".join(kept) if gone else text, len(lines), len(gone))
    return out


def shingles(text: str | None, size: int) -> frozenset:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(low)
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def components(docs: list[tuple], size: int, percent: int) -> dict:
    """doc_id -> (set size, smallest doc_id reachable), by comparing all pairs that share a shingle."""
    sets = {d: shingles(t, size) for d, t in docs}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    shared = Counter()
    for own in holders.values():
        own.sort()
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORDS.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(grams)
    covered = set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered |= set(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)
