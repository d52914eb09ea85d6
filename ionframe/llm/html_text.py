"""Main text of web pages by consensus host paths.

Every page names its best container as a generalised path of tags and classes; the pages of a host vote;
each page is then read again at the winning path.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunks, only, stored

_MARKUP = re.compile(r"""<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*)/?>|<[a-zA-Z/!?][^<>]*(?:>|$)""", re.S)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe".split())
NEVER = frozenset("nav footer aside button select dialog menu head svg object audio video canvas annotation annotation-xml".split())
DRAWING, EMBEDDED = frozenset(("svg",)), frozenset(("foreignobject",))
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr img br center math mfrac mi mn mo mover mrow ms mspace msqrt mroot mstyle msub msubsup msup mtext munder munderover semantics".split())
CONTAINERS = frozenset("article main section div body td".split())
SEMANTIC = frozenset("article main".split())
STRUCTURE, WRAPPER = 1, 2  # what is boilerplate by its kind, and what may also wrap a whole page: forms and what is hidden
FREED = frozenset("article main section p h1 h2 h3 h4 h5 h6 blockquote table pre dl figure".split())  # no part of a menu, button or the like that wasn't closed
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
JUNK = frozenset(
    "ad ads adv advert adverts advertisement adsbygoogle banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall share sharing social related recommend recommended recommendations discussion sidebar widget menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar comment comments disqus respond reply replies pagination pager copyright legal toolbar skip hidden search".split()
)
# Names of what may be long beside a short main text: they give way only if they hold nearly all.
OTHERS = frozenset("ad ads adv advert adverts advertisement adsbygoogle sponsor sponsored promo promotion newsletter comment comments disqus respond reply replies related recommend recommended recommendations discussion cookie cookies consent gdpr".split())
CONTENT = frozenset("content article post story entry main body text".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
SIBLINGS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in SIBLINGS.items()}


def _step(path: int, part: str) -> int:
    return xxhash.xxh3_64_intdigest(part, seed=path)


class Page:
    """Nodes in page order (parent, tag, junk, path part, path hash) and blocks of text in page order.

    What is junk is judged when the page's text is known (_judge). Time grows with the page's length, whatever its nesting.
    """

    def __init__(self, source: str):
        self.parent, self.tag, self.hard, self.part, self.path = [-1], ["#root"], [0], [""], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self.named: dict[int, frozenset] = {}
        self.unclosed: set[int] = set()
        self._raw: list[tuple[int, list]] = []
        self._text, self._at = [], 0
        self.stack, self.open = [0], {}
        pos, n = 0, len(source)
        while pos < n:
            m = _MARKUP.search(source, pos)
            if m is None:
                self._add(source[pos:])
                break
            if m.start() > pos:
                self._add(source[pos : m.start()])
            pos = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(tag)
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, pos)
                if not m[0].endswith("/>"):
                    pos = end.end() if end else n
                continue
            self._open(tag, m[3] or "")
        self.unclosed.update(x for x in self.stack if self.hard[x] == STRUCTURE)
        self._flush()
        for left_out in ("nothing", "names", "names and wrappers"):
            self._judge(left_out)
            self._build()
            if self.blocks or not (self.named or WRAPPER in self.hard):
                break

    def _totals(self, skip: list[bool]) -> list[int]:
        """Each element's length of text without links, but for what lies in skipped elements."""
        total = [0] * len(self.tag)
        for _, pieces in self._raw:
            for node, text, linked in pieces:
                total[node] += 0 if linked or skip[node] else len(text.strip())
        for x in range(len(total) - 1, 0, -1):
            total[self.parent[x]] += total[x]
        return total

    def _judge(self, left_out: str) -> None:
        """self.junk of each element, handed down to what is in it.

        Kinds of boilerplate (menus, footers, dialogs) are junk, but not where they hold every <article> and <main>, and by these two fifths
        of the text, nor over the FREED elements in one that wasn't closed. Forms and hidden elements aren't junk if they hold the <article> or
        <main> with most text or eight (nine) tenths of the text. Names aren't junk over that <article> or <main>, nor where an
        element holds four fifths (19 of 20 for OTHERS) and no <article> or <main> stands beside it. left_out: rules that the page is read without.
        """
        n, parent, tag = len(self.tag), self.parent, self.tag
        last = list(range(n))  # the last element within each
        for x in range(n - 1, 0, -1):
            last[parent[x]] = max(last[parent[x]], last[x])
        junk = self.junk = [False] * n
        hard = any(self.hard)
        total = self._totals(junk)

        def semantic() -> tuple[list[int], list[int], int]:
            """How many of the page's <article> and <main> with text come before each place, are above each element, and the one that counts most
            (0: none has two fifths), one outside of comments and the like first."""
            own = [x for x in range(1, n) if tag[x] in SEMANTIC and not junk[x] and total[x]]
            before, above, aside = [0] * (n + 1), [0] * n, [False] * n
            for x in own:
                before[x + 1] = 1
            for x in range(n):
                before[x + 1] += before[x]
            for x in range(1, n):
                above[x] = above[parent[x]] + (before[parent[x] + 1] - before[parent[x]] if parent[x] else 0)
                aside[x] = aside[parent[x]] or bool(self.named.get(x, frozenset()) & OTHERS)
            plain = [x for x in own if not aside[x]]
            for some in ("article", "main"):
                for group, least in (([x for x in plain if tag[x] == some], 0.4 if len(plain) == len(own) else 0.1), ([x for x in own if tag[x] == some], 0.4)):
                    if group and total[top := max(group, key=lambda x: (total[x], -x))] >= least * total[0]:
                        return before, above, top
            return before, above, 0

        if hard:
            before, above, top = semantic()
            inside = lambda x: before[last[x] + 1] - before[x]
            for x in range(1, n):
                kept = self.hard[x] == STRUCTURE and top and x <= top <= last[x] and inside(x) == before[n]
                own = self.hard[x] == STRUCTURE and not kept
                junk[x] = own or junk[parent[x]] and not (tag[x] in FREED and parent[x] and self._freed(x))
            total = self._totals(junk)
            before, above, top = semantic()
            for x in range(1, n):
                if self.hard[x] >= WRAPPER and left_out != "names and wrappers":
                    most = total[x] >= (0.8 if tag[x] == "form" else 0.9) * total[0] > 0 and inside(x) + above[x] == before[n]
                    kept = most or top and x <= top <= last[x]
                    junk[x] = junk[x] or not kept
                junk[x] = junk[x] or junk[parent[x]] and not (tag[x] in FREED and self._freed(x))
        if self.named and left_out == "nothing":
            total = self._totals(junk)
            before, above, top = semantic()
            held = set(self.up(top))
            for x in range(1, n):
                if not junk[x]:
                    found = self.named.get(x)
                    most = found and total[x] > (0.95 if found <= OTHERS else 0.8) * total[0] and before[last[x] + 1] - before[x] + above[x] == before[n]
                    by_name = bool(found) and x not in held and not most
                    junk[x] = by_name or junk[parent[x]] and not (tag[x] in FREED and self._freed(x))

    def _freed(self, x: int) -> bool:
        """Whether an element lies in a menu or the like that wasn't closed, with only such junk above it."""
        if not self.unclosed:
            return False
        at = self.parent[x]
        while at > 0:
            if self.hard[at] or at in self.named:
                return at in self.unclosed
            at = self.parent[at]
        return False

    def _build(self) -> None:
        self.blocks = []
        for at, pieces in self._raw:
            kept = [(text, linked) for node, text, linked in pieces if not self.junk[node]]
            text = " ".join(entities.unescape("".join(t for t, _ in kept)).split())
            if text:
                self.blocks.append((at, text, sum(len(t) for t, linked in kept if linked)))

    def _add(self, text: str) -> None:
        self._text.append((self.stack[-1], text, bool(self.open.get("a"))))

    def _flush(self) -> None:
        if self._text:
            self._raw.append((self._at, self._text))
            self._text = []

    def _pop(self, depth: int, named: bool = False) -> None:
        """Close the elements above a depth of the stack; named: the last of them by its own end tag."""
        while len(self.stack) > depth:
            node = self.stack.pop()
            if self.hard[node] == STRUCTURE and not (named and len(self.stack) == depth):
                self.unclosed.add(node)
            self.open[self.tag[node]] -= 1
            if self.tag[node] not in INLINE:
                self._flush()
                self._at = self._block_of()

    def _block_of(self) -> int:
        return next((x for x in reversed(self.stack) if self.tag[x] not in INLINE), 0)

    def _find(self, tags: frozenset, until: frozenset) -> int:
        """The depth of the innermost open element of tags that is not beyond one of until; -1: none."""
        if not any(self.open.get(t) for t in tags):
            return -1
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.tag[self.stack[depth]]
            if tag in tags:
                return depth
            if tag in until:
                return -1
        return -1

    def _close(self, tag: str) -> None:
        if tag == "br":
            self._add(" ")
        depth = self._find(frozenset((tag,)), frozenset())
        if depth > 0:
            self._pop(depth, True)

    def _open(self, tag: str, attrs: str) -> None:
        if tag in CLOSES_P and (depth := self._find(DRAWING, EMBEDDED)) > 0:  # a drawing holds no blocks but embedded ones: it wasn't closed
            self._pop(depth)
        if tag in CLOSES_P and (depth := self._find(frozenset("p"), frozenset("table td th li div section article".split()))) > 0:
            self._pop(depth)
        if tag in SIBLINGS and (depth := self._find(*SIBLINGS[tag])) > 0:
            self._pop(depth)
        if tag in ("br", "hr", "img", "wbr", "input"):
            self._add(" " if tag == "br" else "")
            if tag == "hr":
                self._flush()
            return
        if tag in VOID:
            return
        if tag not in INLINE:
            self._flush()
        parent = self.stack[-1]
        got = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)} if attrs else {}
        names = re.sub(r"([a-z])([A-Z])", r"\1-\2", f"{got.get('class', '')} {got.get('id', '')}").lower()
        names = re.findall(r"[a-z]+", re.sub(r"(?<![a-z])(?:has|no|not|with|without)[-_]\S*", " ", names))  # has-sidebar is no sidebar
        self.parent.append(parent)
        self.tag.append(tag)
        free = tag in ("body", "html", "article", "main")
        self.hard.append(self._kind(tag, got, free))
        if not free and not self.hard[-1] and (found := self._named(tag, names)):
            self.named[len(self.tag) - 1] = found
        part = ""
        if tag not in INLINE:
            kinds = sorted({re.sub(r"\d+", "#", c) for c in got.get("class", "").lower().split()})
            part = ".".join([tag, *kinds])
        self.part.append(part)
        self.path.append(_step(self.path[parent], part) if part else self.path[parent])
        node = len(self.tag) - 1
        self.stack.append(node)
        self.open[tag] = self.open.get(tag, 0) + 1
        if tag not in INLINE:
            self._at = node

    def _kind(self, tag: str, got: dict, free: bool) -> int:
        """STRUCTURE, WRAPPER or 0, from an element's tag and attributes by name."""
        role = got.get("role", "").lower()
        if not free and (tag in NEVER or role in ROLES or tag == "header" and not any(self.open.get(t) for t in SEMANTIC)):
            return STRUCTURE
        hidden = got.get("aria-hidden", "").lower() == "true" or "hidden" in got or "display:none" in got.get("style", "").replace(" ", "").lower()
        return WRAPPER if tag == "form" or role == "form" or hidden else 0

    def _named(self, tag: str, names: list[str]) -> frozenset:
        """The words of junk in an element's names, to be judged when the page's text is known."""
        if tag == "header":
            return frozenset()
        found = JUNK.intersection(names) - ({"header"} if any(self.open.get(t) for t in SEMANTIC) else set())
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p") and CONTENT.intersection(names):  # a block with its own words goes by its wrapper's name, or by a plain one of its own
            return frozenset()
        return found

    def up(self, node: int):
        while node > 0:
            yield node
            node = self.parent[node]

    def names(self, node: int) -> str:
        return ">".join(self.part[x] for x in reversed(list(self.up(node))) if self.part[x])

    def best(self) -> int:
        """The container with the page's main text: the <article> or <main> with most text if that is
        two fifths of all, else the block parents' vote (length less links, half to the grandparent), widened
        to the outermost container that adds a twentieth at least."""
        n = len(self.tag)
        total, filled = [0.0] * n, [False] * n
        vote: dict[int, float] = {}
        for node, text, linked in self.blocks:
            worth = max(0.0, len(text) - 1.5 * linked)
            total[node] += worth
            filled[node] = True
            holder = node if self.tag[node] in CONTAINERS else self.parent[node]
            for share in (1.0, 0.5):
                if holder > 0:
                    vote[holder] = vote.get(holder, 0.0) + share * worth
                    holder = self.parent[holder]
        for x in range(n - 1, 0, -1):
            total[self.parent[x]] += total[x]
            filled[self.parent[x]] |= filled[x]
        for tag in ("article", "main"):
            own = [x for x in range(1, n) if self.tag[x] == tag and filled[x]]
            if own:
                top = max(own, key=lambda x: (total[x], -x))
                if total[top] >= 0.4 * total[0] or sum(total[x] for x in own if self.path[x] == self.path[top]) >= 0.4 * total[0] and self._story(top, own, total) != top:
                    return self._story(top, own, total)
        ranked = [x for x in vote if self.tag[x] in CONTAINERS]
        if not ranked:
            return next((i for i, t in enumerate(self.tag) if t == "body"), 0)
        top = max(ranked, key=lambda x: (vote[x], -x))
        for x in list(self.up(top))[1:]:
            if self.tag[x] in CONTAINERS and self.tag[x] != "body" and total[x] >= 1.05 * total[top]:
                top = x
        return top

    def _story(self, top: int, own: list[int], total: list[float]) -> int:
        """top, unless it is one of several alike (posts of a thread) after a single one with a heading of the first level and a tenth of the text."""
        alike = sum(self.path[x] == self.path[top] for x in own)
        if alike > 1:
            heads = [x for x, t in enumerate(self.tag) if t == "h1"]
            for x in own:
                if x < top and sum(self.path[y] == self.path[x] for y in own) == 1 and total[x] >= 0.1 * total[0] and any(x in self.up(h) for h in heads[:1]):
                    return x
        return top

    def text(self, roots: list[int]) -> str:
        inside = [False] * len(self.tag)
        for x in roots:
            inside[x] = True
        for i in range(1, len(self.tag)):
            inside[i] = inside[i] or inside[self.parent[i]]
        return "\n\n".join(text for node, text, _ in self.blocks if inside[node])

    def at(self, path: str | None) -> list[int]:
        """Elements at a generalised path."""
        if not path:
            return []
        h = 0
        for part in path.split(">"):
            h = _step(h, part)
        return [i for i in range(1, len(self.tag)) if self.path[i] == h and self.part[i] and not self.junk[i]]


def extract(source: str | None, path: str | None = None) -> tuple[str, str]:
    """(main text, path of the container that was read). The page's own best container is read
    if it has none at the path, or no text there."""
    if not source:
        return "", ""
    page = Page(source)
    if text := page.text(page.at(path)):
        return text, path or ""
    best = page.best()
    return page.text([best] if best else [0]), page.names(best)


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, path of every row of pages.

    A host is the URL's authority in lower case, without user and port; pages of a null or malformed URL
    have none and follow their own best container, as do pages without the winning path. Votes
    that tie go to the path with fewer steps, then by a hash of the path. Null or empty html has the empty text and no
    vote. Repeated rows vote and return each. Very long pages are read whole. Other columns are ignored. Empty
    input gives no rows. The winners (one row per host) are joined by broadcast only if their
    table is under the session's limit, otherwise by a sort-merge join, whose hot hosts the engine splits.
    """
    host = F.nullif(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    own = only(pages, page_id=id_col, url=url_col, html=html_col).withColumn("host", host)

    def vote(batches):
        for batch in batches:
            for part in chunks(batch, "html"):
                hosts, paths = [], []
                for h, source in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                    page = Page(source)
                    best = page.best()
                    if best and page.blocks:
                        hosts.append(h)
                        paths.append(page.names(best))
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string())], names=["host", "path"])

    votes = own.where("host is not null and html <> ''").select("host", "html").mapInArrow(vote, "host string, path string").groupBy("host", "path").agg(F.count("*").alias("n"))
    steps = F.size(F.split("path", ">"))
    best = F.max_by("path", F.struct("n", (-steps).alias("steps"), F.xxhash64("path").alias("h")))
    winners = stored(votes.groupBy("host").agg(best.alias("winner")), "paths")

    def read(batches):
        for batch in batches:
            for part in chunks(batch, "html"):
                got = [extract(s, w) for s, w in zip(part.column("html").to_pylist(), part.column("winner").to_pylist(), strict=True)]
                cols = [part.column("page_id"), part.column("url"), pa.array([t for t, _ in got], pa.string()), pa.array([len(t) for t, _ in got], pa.int64()), pa.array([p for _, p in got], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars", "path"])

    joined = own.join(winners, "host", "left").select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "winner")
    return joined.mapInArrow(read, "page_id long, url string, text string, n_chars long, path string")
