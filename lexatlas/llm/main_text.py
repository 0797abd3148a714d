"""Main text of web pages by tree scoring.

Each block of text passes points for its length and commas to its container and, halved at each level, to all further
ancestors. A container's score is discounted by its link density; the best one is kept, with those of its siblings that
score alike or are made alike, and what stands with them under the title. Elements that are never article text (menus,
footers, scripts, ...) are left out before scoring. Forms, dialogs and containers whose names speak of adverts, notices or
comments are left out too, unless they hold most of the page's prose, and the title or another sign of content. Lists of
entries after the prose that are all made alike, as readers' comments are, are found by that structure.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from lexatlas.sources.workspace import map_arrow

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements without article text: those that bound blocks, and those that stand within a line.
SKIPPED_BLOCKS = frozenset("head nav footer aside menu".split())
SKIPPED_INLINE = frozenset("script style noscript template iframe object svg canvas button select textarea input label title xmp noembed noframes option datalist audio video math".split())
BLOCKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary fieldset hr header hgroup center form dialog".split()) | SKIPPED_BLOCKS
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose start closes an open paragraph.
CLOSES_P = BLOCKS - frozenset("html body td th tr tbody thead tfoot caption head".split())
#: Parts of an article, which stand for the whole of it.
PARTS = frozenset("ul ol li dl dt dd table thead tbody tr td blockquote pre figure details center".split())
#: Words of a class, id or role that mark what isn't the article; those of readers' comments; names of what is.
_ASIDE = re.compile(r"(?:^|[^a-z])(?:ad|ads|advert\w*|adbox|adsense|banner|sponsor\w*|promo\w*|cookie\w*|consent|dialog|alertdialog|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|nav\w*|menu|breadcrumbs?|sidebar|footer|masthead|header|comments?|disqus|replies|respond|related|recommend\w*|share|sharing|social|widget|toolbar|pagination|pager|skip-link|complementary|contentinfo|navigation|search)(?:$|[^a-z])")
_COMMENT = re.compile(r"(?:^|[^a-z])(?:comments?|disqus|replies|respond)(?:$|[^a-z])")
#: A line that states rights in the page.
_RIGHTS = re.compile(r"\s*(?:©|\(c\)\s*(?:19|20)\d\d|copyright\b|all rights reserved)", re.I)
_CLASS = re.compile(r"""(?:^|\s)class\s*=\s*(?:"\s*([^"\s]*)|'\s*([^'\s]*)|([^\s>]+))""", re.I)
_CONTENT = frozenset("content article main post entry story".split())
_TAG = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"[^\s/>]+")
_VALUE_OR_END = re.compile(r"=\s*[\"']|>")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_SPACE = re.compile(r"\s+")


def tags(html: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, name, attributes) of each tag; an end tag's name begins with a slash; comments and declarations have
    none. Quotes hold a value only after an equals sign, and a tag that never ends takes the rest of the page, as in
    browsers: so each character is read once. After a tag's end, a position may be sent from which to go on."""
    at, n = 0, len(html)
    while m := _TAG.search(html, at):
        start, at = m.start(), m.end()
        name = attributes = ""
        if m[0] == "<!--":
            end = html.find("-->", max(start + 4, at - 2) if html.startswith("<!-->", start) else at)
            at = n if end < 0 else end + 3
        elif m[0][-1] in "!?":
            end = html.find(">", at)
            at = n if end < 0 else end + 1
        else:
            word = _NAME.match(html, at - 1)
            name, inner = m[0][1:-1] + word[0].lower(), word.end()
            at = inner
            while (found := _VALUE_OR_END.search(html, at)) and found[0] != ">":
                close = html.find(found[0][-1], found.end())
                at = n if close < 0 else close + 1
            at = found.end() if found else n
            attributes = html[inner : at - 1] if found else ""
            if not found:
                name = ""
        sent = yield start, at, name, attributes
        if sent is not None:
            at = sent
            yield start, at, "", ""


class Node:
    """A container: its own points and those of what it holds, halved at each level, its characters and those in links."""

    __slots__ = ("tag", "parent", "score", "chars", "link_chars", "named", "good", "kept", "made", "dated")

    def __init__(self, tag: str, parent: Node | None, named: int = 0, good: bool = False, attributes: str = ""):
        self.tag, self.parent, self.named, self.good = tag, parent, named, good
        self.score, self.chars, self.link_chars, self.kept = 0.0, 0, 0, False
        word = _CLASS.search(attributes) if attributes else None
        #: How it is made: tag and first class; elements made alike do the same work on a page.
        self.made = (tag, (word[1] or word[2] or word[3] or "").lower() if word else "")
        self.dated = False

    def value(self) -> float:
        return self.score * (1 - self.link_chars / self.chars) if self.chars else 0.0


#: How a name speaks against a container: not at all, in general, as comments of readers.
FINE, ASIDE, COMMENT = range(3)
#: Points of a form that holds the page, not fields: those of two paragraphs.
FORM_POINTS = 5
#: Code points of a line that may name the writer of an entry.
SHORT = 60
#: Containers whose likeness says nothing.
_NO_ENTRY = frozenset("html body main article ul ol dl dt dd table thead tbody tfoot tr td th caption pre blockquote figure figcaption header".split())


class Page:
    """The tree of a page's containers and its blocks of text in page order."""

    def __init__(self, html: str):
        self.root = Node("#root", None)
        self.nodes = [self.root]
        #: (container, kind: the heading's tag or "", text, characters in links)
        self.blocks: list[tuple[Node, str, str, int]] = []
        self.buffer: list[str] = []
        self.links, self.heading = 0, ""
        self.wide: Node | None = None
        self.dropped: set[int] = set()
        self.read(html)

    def flush(self, node: Node) -> None:
        if self.buffer:
            text = _SPACE.sub(" ", unescape("".join(self.buffer))).strip()
            self.buffer.clear()
            if text:
                self.blocks.append((node, self.heading, text, min(self.links, len(text))))
        self.links, self.heading = 0, ""

    def read(self, html: str) -> None:
        # tag, container, whether text is left out
        stack: list[tuple[str, Node, bool]] = [("#root", self.root, False)]
        open_: Counter = Counter()

        def pop() -> str:
            tag = stack.pop()[0]
            open_[tag] -= 1
            return tag

        in_link, before = False, 0
        reader = tags(html)
        for start, end, name, attributes in reader:
            if start > before and not stack[-1][2]:
                self.text(html[before:start], in_link)
            before = end
            if not name:
                continue
            node = stack[-1][1]
            if name[0] == "/":
                tag = name[1:]
                if tag == "a":
                    in_link = False
                if open_[tag]:
                    if tag in BLOCKS:
                        self.flush(node)
                    while pop() != tag:
                        pass
                elif tag == "p":
                    self.flush(node)
                continue
            tag = name
            if tag == "a":
                in_link = True
            if tag in VOID:
                if not stack[-1][2] and tag == "hr":
                    self.flush(node)
                elif not stack[-1][2] and tag == "br":
                    self.buffer.append(" ")
                continue
            if tag in CLOSES_P and (open_["p"] or (tag in ("li", "dt", "dd") and open_[tag])):
                # an open paragraph ends here, and with it inline elements left open in it; so do items of the same kind
                for k in range(len(stack) - 1, 0, -1):
                    above = stack[k][0]
                    if above == "p" or (above == tag and tag in ("li", "dt", "dd")):
                        self.flush(node)
                        while len(stack) > k:
                            pop()
                        break
                    if above in BLOCKS:
                        break
                node = stack[-1][1]
            named, good, hidden = self.judged(tag, attributes, open_)
            out = stack[-1][2] or tag in SKIPPED_BLOCKS or tag in SKIPPED_INLINE or hidden or (named and tag not in BLOCKS)
            if tag in BLOCKS:
                self.flush(node)
            if tag in RAW:
                close = _RAW_END[tag].search(html, end)
                before = close.start() if close else len(html)
                reader.send(before)
                continue
            if tag == "time":
                node.dated = True
            if tag in HEADINGS:
                self.heading = tag
            elif tag in BLOCKS and tag != "p":
                node = Node(tag, node, named, good, attributes)
                self.nodes.append(node)
            stack.append((tag, node, bool(out)))
            open_[tag] += 1
        if before < len(html) and not stack[-1][2]:
            self.text(html[before:], in_link)
        self.flush(stack[-1][1])

    def text(self, text: str, in_link: bool) -> None:
        self.buffer.append(text)
        if in_link:
            self.links += len(_SPACE.sub(" ", unescape(text)).strip())

    @staticmethod
    def judged(tag: str, attributes: str, open_: Counter) -> tuple[int, bool, bool]:
        """How an element's name speaks against it, whether it speaks for it, and whether the element is hidden."""
        named = ASIDE if tag in ("form", "dialog") or (tag == "header" and not (open_["article"] or open_["main"])) else FINE
        if not attributes or tag in ("html", "body"):
            return named, False, False
        hidden = bool(_HIDDEN.search(attributes))
        if tag in HEADINGS or tag in ("p", "main"):
            return FINE, False, hidden and tag == "p"
        words = " ".join(x for g in _NAMED.findall(attributes) for x in g if x).lower().replace("_", "-")
        good = tag == "article" or not _CONTENT.isdisjoint(words.split())
        if _COMMENT.search(words):
            named = COMMENT
        elif tag != "article" and _ASIDE.search(words):
            named = max(named, ASIDE)
        return named, good, hidden and tag != "article"

    def score(self) -> None:
        """Points, characters and links of all containers, from the innermost out. What is named aside passes nothing on,
        unless it is named as content, too, or holds the title, and has as many points as all that isn't named aside; a
        form may also have the points of some paragraphs. What is freed so counts as not aside for what lies in it or
        follows."""
        points: Counter = Counter()
        whole: Counter = Counter()
        free: Counter = Counter()
        for node, _, text, links in self.blocks:
            points[id(node)] += self.own(text) * (1 - links / len(text))
        heads = {id(node) for node, heading, _, _ in self.blocks if heading == "h1"} | {id(n) for n in self.nodes if n.tag in ("article", "main")}
        for node in reversed(self.nodes):
            whole[id(node)] += points[id(node)]
            free[id(node)] += points[id(node)]
            if node.parent is not None:
                whole[id(node.parent)] += whole[id(node)]
                if not node.named:
                    free[id(node.parent)] += free[id(node)]
                if id(node) in heads:
                    heads.add(id(node.parent))
        least, out = free[id(self.root)], set()
        for node in self.nodes:
            if node.parent is not None and id(node.parent) in out:
                out.add(id(node))
            elif node.named:
                content = node.good or (node.named == ASIDE and id(node) in heads) or (node.tag == "form" and whole[id(node)] >= FORM_POINTS)
                if content and whole[id(node)] >= least and node.tag != "header":
                    node.named = FINE
                    least += free[id(node)]
                else:
                    out.add(id(node))
        self.out = out
        self.add_up()
        whole_page = {id(node) for node in self.nodes}
        prose = [at for at, (n, h, t, k) in enumerate(self.blocks) if id(n) not in out and not h and len(t) >= 80 and 4 * k < len(t)]
        signed = self.within(self.entries(prose[0], whole_page, whole_page)) if prose else set()
        if signed:  # threads may hold more prose than the article before them
            plain = [at for at in prose if id(self.blocks[at][0]) not in signed]
            begin = next(at for at, (n, _, _, _) in enumerate(self.blocks) if id(n) in signed)
            if plain and plain[-1] < begin and sum(self.own(self.blocks[at][2]) for at in plain) >= FORM_POINTS:
                self.dropped |= signed
                out |= signed
                self.add_up()

    @staticmethod
    def own(text: str) -> float:
        return 1 + min(len(text) / 100, 3) + text.count(",") if len(text) >= 25 else 0.2

    def add_up(self) -> None:
        for node in self.nodes:
            node.score, node.chars, node.link_chars = 0.0, 0, 0
        for node, _, text, links in self.blocks:
            if id(node) not in self.out:
                node.score += self.own(text)
                node.chars += len(text)
                node.link_chars += links
        for node in reversed(self.nodes):
            up = node.parent
            if up is not None:
                up.score += 0.5 * node.score
                up.chars += node.chars
                up.link_chars += node.link_chars

    def within(self, found: set[int]) -> set[int]:
        """The containers in those found, themselves included."""
        all_ = set(found)
        for node in self.nodes:
            if node.parent is not None and id(node.parent) in all_:
                all_.add(id(node))
        return all_

    def entries(self, after: int, core: set[int], whole: set[int]) -> set[int]:
        """Containers, begun after the block numbered `after`, whose text is in two or more entries made alike, none of
        them with a heading: comments. Outside the article (whole) that is enough for list items; other entries, and those
        in it, need a mark: a short line beside the text, and in the best container (core) one with a link or a time."""
        made: dict[int, Counter] = {}
        for node in self.nodes:
            if node.parent is not None and node.chars and id(node) not in self.out and node.tag not in _NO_ENTRY:
                made.setdefault(id(node.parent), Counter())[node.made] += 1
        lists = {n: kind for n, c in made.items() for kind, k in c.items() if k >= 2 and 2 * k > c.total()}
        entry: dict[int, Node] = {}  # the outermost entry that a container lies in
        for node in self.nodes:
            up = node.parent
            if up is None:
                continue
            if id(up) in entry:
                entry[id(node)] = entry[id(up)]
            elif lists.get(id(up)) == node.made and node.chars and id(node) not in self.out:
                entry[id(node)] = node
        first: dict[int, int] = {}
        lines, short, signed, headed, chars = Counter(), Counter(), Counter(), set(), Counter()
        for at, (node, heading, text, links) in enumerate(self.blocks):
            one = entry.get(id(node))
            if one is None or id(node) in self.out:
                continue
            first.setdefault(id(one.parent), at)
            key = id(one)
            lines[key] += 1
            short[key] += len(text) <= SHORT
            signed[key] += len(text) <= SHORT and (links > 0 or node.dated)
            if heading:
                headed.add(id(one.parent))
            chars[id(one.parent)] += len(text)
        ones: dict[int, list[Node]] = {}
        for node in {id(e): e for e in entry.values()}.values():
            ones.setdefault(id(node.parent), []).append(node)
        found = set()
        for node in self.nodes:
            mine = ones.get(id(node), [])
            if not mine or id(node) in headed or first.get(id(node), -1) <= after or chars[id(node)] < 0.9 * node.chars:
                continue
            marks = signed if id(node) in core else short
            marked = all(marks[id(e)] and lines[id(e)] > 1 for e in mine)
            if marked or (id(node) not in whole and mine[0].tag == "li"):
                found.add(id(node))
        return found

    def best(self) -> list[str]:
        """Texts of the best container, of its siblings that belong with it, and of what stands with them."""
        self.score()
        out = self.out
        if len(self.nodes) == len(out) or not any(n.chars for n in self.nodes if id(n) not in out):
            return []
        top = max((n for n in self.nodes if n.chars and id(n) not in out), key=Node.value)  # the first of equals: the outer one
        while top.tag in PARTS and top.parent.parent is not None and top.parent.tag not in ("body", "html"):
            top = top.parent
        core, up = top, top.parent
        while up is not None:  # the article that it is part of, if that is prose
            if up.tag in ("article", "main") and up.link_chars < 0.3 * up.chars:
                top = up
                break
            up = up.parent
        top.kept = True
        least = max(0.2 * top.value(), 2.0)
        around = top.parent
        size = top.chars
        if around is not None:
            for node in self.nodes:
                if node.parent is around and node is not top and id(node) not in out and node.chars and node.link_chars < 0.3 * node.chars:
                    alike = node.made == top.made and node.made[1]
                    if alike or node.value() >= least:
                        node.kept = True
                        size += node.chars
        if top.tag not in ("article", "main"):
            self.widen(top, size)
        threads = self.threads(core, top)
        for node in self.nodes:
            node.kept = id(node) not in threads and id(node) not in out and (node.kept or (node.parent is not None and node.parent.kept))
        loose = around if around is not None and around.tag not in ("body", "html", "#root") else None
        keep = [id(n) not in out and (n.kept or (n is loose and len(t) >= 80 and k < 0.25 * len(t))) for n, _, t, k in self.blocks]
        if self.wide is not None:  # links and rights beside the prose aren't the article's
            within = self.within({id(top)})
            keep = [kept and (id(n) in within or (2 * k < len(t) and not _RIGHTS.match(t))) for kept, (n, _, t, k) in zip(keep, self.blocks)]
        for at in range(len(keep) - 1):  # a heading of what is left out
            n = self.blocks[at + 1][0]
            if keep[at] and self.blocks[at][1] and self.blocks[at][1] != "h1" and not keep[at + 1] and id(n) in self.dropped:
                keep[at] = False
        if True in keep:
            first = keep.index(True)
            if not any(k and h == "h1" for k, (_, h, _, _) in zip(keep, self.blocks)):  # the title may stand before it
                above = [k for k in range(first) if self.blocks[k][1] == "h1" and id(self.blocks[k][0]) not in out]
                if above:  # and with it what leads from it to the text
                    for at in range(above[-1], first):
                        n, _, t, links = self.blocks[at]
                        keep[at] = id(n) not in out and id(n) not in self.dropped and (at == above[-1] or 2 * links < len(t))
        return [text for kept, (_, _, text, _) in zip(keep, self.blocks) if kept]

    def widen(self, top: Node, size: int) -> None:
        """Keeps the innermost container around the best one that holds the title, too, if half of its text or more is
        what was found (size) and less than 30 % are links."""
        titled = {id(node) for node, heading, _, _ in self.blocks if heading == "h1" and id(node) not in self.out}
        for node in reversed(self.nodes):
            if node.parent is not None and id(node) in titled and id(node) not in self.out:
                titled.add(id(node.parent))
        up = top
        while up is not None and up.tag not in ("body", "html", "#root"):
            if id(up) in titled:
                if up is not top and 2 * size >= up.chars and up.link_chars < 0.3 * up.chars:
                    up.kept, self.wide = True, up
                return
            up = up.parent

    def threads(self, core: Node, top: Node) -> set[int]:
        """Comments known by their structure; what lies in them is self.dropped. They come after a text of the best
        container that isn't in them."""
        own = self.within({id(core)})
        prose = next((at for at, (n, h, _, _) in enumerate(self.blocks) if id(n) in own and not h), -1)
        found = self.entries(prose, own, self.within({id(top)}))
        before, self.dropped = self.dropped, self.dropped | self.within(found)
        last = max((at for at, (n, _, _, _) in enumerate(self.blocks) if id(n) in own and id(n) not in self.dropped), default=-1)
        begun = {}
        for at, (n, _, _, _) in enumerate(self.blocks):
            if id(n) in self.dropped and id(n) not in before:
                begun.setdefault(id(n), at)
        early = {n for n, at in begun.items() if at < last}  # prose goes on after them: part of it
        if early:
            for node in reversed(self.nodes):
                if id(node) in early and node.parent is not None and id(node) not in found:
                    early.add(id(node.parent))
            self.dropped = before | self.within(found - early)
        return self.dropped

    def main_text(self) -> str:
        return "\n".join(self.best()) if self.blocks else ""


def main_text(html: str) -> str:
    return Page(html).main_text()


def _extract(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            texts = [main_text(h) if h else "" for h in part.column("html").to_pylist()]
            columns = [*(part.column(c) for c in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (the main text, empty if none) and n_chars (its code points) of each page (page_id, url, html).

    Blocks are what block elements bound; white space inside one becomes one space, also a <br>; blocks are joined by
    one line end, in page order; nothing else is dropped or cut. An element that is left out within a line doesn't end
    the block. Of equal scores the outer or earlier container counts. A null html counts as empty. Rows are independent,
    so ids may be null, rows may repeat; other columns are ignored; an empty table gives no rows. One map over the scan;
    a page is read in time linear in its length.
    """
    own = pages.select("page_id", "url", "html")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema if f.name != "html")
    return map_arrow(own, lambda it: _extract(it, ["page_id", "url"]), f"{kinds}, text string, n_chars long")
