"""Main text of web pages by consensus paths of hosts.

1. Each page's containers are scored: a text block counts its length without link text for the container it stands in, and ``DECAY``
   times that for each one further outward (half for the body); articles and main elements, and classes that name content, count more.
2. A container's path is its chain of tags and classes with digits generalised, as a digest. Pages vote for paths with their shares of score, in whole
   millionths, and Spark sums the votes of a host; the best path wins (ties: the smallest digest), however pages are dealt.
3. Pages are read again: the text of all elements on the host's winning path, or, in a page without one, on the page's own best. The path
   is first climbed to the outermost article around it, or else to the outermost main element or class that names content
   whose other text in the page is mostly unlinked, so headings and sibling sections stay.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, hidden elements and comments of readers never count. They are known by tag and role, and by
class and id: a name is one of theirs if it has a word of theirs (``sidebar``, ``comments``) and otherwise only words of place and shape (``left-sidebar``, ``comment-list-2``), or if a strong word of theirs ends it after
unknown ones (``wp-block-comments``); words written as one are taken apart (``commentlist``). ``with-sidebar``, ``no-comments``, ``search-results`` or ``comment-on-policy`` are not. A form around the page's own text
is no form in this sense (an article or main element, or most of the text and a block of prose, is in it); asides that are quotes in an article, and buttons in a sentence, stay. Names are forgiven, those of layout first, where they would leave a page without its articles or without
any text. Of a header inside an article, its headings stay. Unclosed and misnested tags are closed as browsers close them.

Votes are summed before the exchange, so a hot host moves a row a task and path. The table of winners is written first;
Spark broadcasts it if its files are small enough, and otherwise joins by host.

Nulls: a null html is empty, a null url belongs to host ''. Rows are kept one for one, and repeated rows vote as often as they are there and get equal texts. Extra columns are dropped. An empty table gives
an empty result. Pages of any length are read whole, in time and memory in proportion to their length; a batch holds 64 MB of them, or one.
"""

from __future__ import annotations

import functools
import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import stage

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'<>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_DIGITS = re.compile(r"\d+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Elements whose content is not markup.
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
_RAW_END = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in _RAW}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_DROP = _RAW | set("head nav header footer aside menu template svg canvas object audio video button select option label dialog".split())
_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar note".split())
#: Words of layout, and of what is not the page's own text.
_LAYOUT = set("sidebar side menu nav navbar navigation header footer masthead toolbar topbar overlay modal widget pager skip hidden".split())
_WORDS = _LAYOUT | set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner breadcrumb breadcrumbs comment comments disqus respond reply replies cookie cookies consent gdpr "
    "notice notices newsletter subscribe subscription share sharing social related recommended recommendations popup pagination login signup search".split())
#: Words of place and shape that may stand beside them in a name.
_NEUTRAL = set(
    "article articles author area bar block blocks body bottom box btn button buttons col column container content count default desktop div entry form global group head heading icon id image inner item items "
    "js large left link links list lists main meta mobile module more my news outer page panel post posts primary right row secondary section single site slot small stories story text the thread title top unit "
    "view wrap wrapper zone".split())
#: Words that say so even after words that are not known, such as a vendor's (``wp-block-comments``), unless one of those turns the name round.
_STRONG = set(
    "ads advert adverts advertisement advertising sponsor sponsored breadcrumb breadcrumbs comments disqus respond replies cookie cookies consent gdpr newsletter subscribe subscription sharing related "
    "recommended recommendations popup pagination adsbygoogle adsense taboola outbrain".split())
_TURNS = set("no non not with without has have hide show is on of in to and or for from about before after under over law policy".split())
#: Words by which an aside says that it is part of the article.
_QUOTES = set("pullquote pull quote quotation callout note tip example".split())
#: Code points of unlinked text by which a block in a form is prose.
PROSE = 140
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
_BLOCKS = set(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul aside dialog caption".split())
_CONTAINERS = {"", "html", "body", "div", "section", "article", "main", "td", "center"}
#: A start tag closes the open elements listed with it, up to the nearest element of the second list.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
_ROOTS = ("", "html", "body")
#: What a container outward counts of the one inside it.
DECAY = 0.95
_GOOD = set("content article post entry story main text body".split())


def _parts(name: str) -> list[str]:
    """The words of a class or id; one that two known words make (``commentlist``) counts as both."""
    known, out = _WORDS | _NEUTRAL | _STRONG, []
    for p in _SPLIT.split(_HUMP.sub("-", name).lower()):
        if p and not p.isdigit():
            cut = 0 if p in known else next((i for i in range(2, len(p) - 1) if p[:i] in known and p[i:] in known and (p[:i] in _WORDS or p[i:] in _WORDS)), 0)
            out += [p[:cut], p[cut:]] if cut else [p]
    return out


@functools.lru_cache(1 << 16)
def _mark(name: str) -> int:
    """0 for a class or id that says nothing, 1 for one of layout, 2 for one of what is not the page's own text."""
    parts = _parts(name)
    hit, other = {p for p in parts if p in _WORDS or p in _STRONG}, {p for p in parts if p not in _WORDS and p not in _STRONG and p not in _NEUTRAL}
    if not hit or hit == {"header"} and not _GOOD.isdisjoint(parts):
        return 0
    if other:  # what follows the last unknown word has to say it
        tail = parts[max(i for i, p in enumerate(parts) if p in other) + 1 :]
        return 2 if not _STRONG.isdisjoint(tail) and other.isdisjoint(_TURNS) else 0
    return 1 if hit <= _LAYOUT else 2


@functools.lru_cache(1 << 16)
def _step(path: bytes, step: str) -> bytes:
    """The digest of a path that goes on by a step."""
    return hashlib.blake2b(path + step.encode("utf-8", "surrogatepass"), digest_size=12).digest()


class Page:
    """Elements (parent, tag, classes, path) and the text blocks that count (element, text, length of link text), in page order."""

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.names, self.path, self._bad, self._soft = [-1], [""], [""], [b""], [0], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self._stack, self._text, self._link = [0], [], 0
        self._depths: dict[str, list[int]] = {}  # of the open elements by tag
        self._open_blocks: list[int] = []  # depths of open blocks
        at, size = 0, len(source)
        while at < size:
            m = _TOKEN.search(source, at)
            self._add(source[at : m.start()] if m else source[at:])
            if not m:
                break
            at = m.end()
            if m["tag"]:
                tag = m["tag"].lower()
                if m["end"]:
                    self._close(tag)
                else:
                    self._open(tag, m["attrs"])
                    if tag in _RAW:
                        end = _RAW_END[tag].search(source, at)
                        at = end.start() if end else size
        self._flush()
        self._forms()
        self._settle()

    def _forms(self) -> None:
        """Drops the blocks of forms, but for a form around the page's own text: one with an article or main element, or with most of the unlinked text that there is and a block of prose."""
        near = [-1] * len(self.tag)  # the innermost form around an element
        for i, up in enumerate(self.parent):
            near[i] = i if self.tag[i] == "form" else near[up] if up >= 0 else -1
        outer = {i: near[self.parent[i]] for i, t in enumerate(self.tag) if t == "form"}  # in page order
        if not outer:
            return
        total, own, prose = 0, dict.fromkeys(outer, 0), set()
        keeps = {near[i] for i, t in enumerate(self.tag) if t in ("article", "main") and not self._bad[i]}
        for at, text, link in self.blocks:
            total += len(text) - link
            if near[at] >= 0:
                own[near[at]] += len(text) - link
                if len(text) - link >= PROSE:
                    prose.add(near[at])
        for f, up in reversed(outer.items()):
            if up >= 0:
                own[up] += own[f]
                if f in keeps:
                    keeps.add(up)
                if f in prose:
                    prose.add(up)
        keeps |= {f for f in prose if 2 * own[f] > total}
        lost: dict[int, bool] = {-1: False}
        for f, up in outer.items():
            lost[f] = f not in keeps or lost[up]
        self.blocks = [b for b in self.blocks if not lost[near[b[0]]]]

    def _settle(self) -> None:
        """Drops the blocks of elements that their names mark, unless that leaves no article of the page's own, or no text."""

        def below(marks: tuple[int, ...]) -> list[bool]:
            lost = [False] * len(self.tag)
            for i, up in enumerate(self.parent):
                lost[i] = self._soft[i] in marks or (up >= 0 and lost[up])
            return lost

        if any(self._soft):
            foreign = below((2,))
            mains = [i for i, t in enumerate(self.tag) if t in ("article", "main") and not self._bad[i] and not foreign[i]]
            for marks in ((1, 2), (2,), ()):
                lost = below(marks)
                some = any(not lost[b[0]] for b in self.blocks)
                if some and (marks != (1, 2) or not mains or not all(lost[i] for i in mains)):
                    break
            self.blocks = [b for b in self.blocks if not lost[b[0]]]

    def _add(self, raw: str) -> None:
        top = self._stack[-1]
        if raw and not self._bad[top]:
            text = html.unescape(raw) if "&" in raw else raw
            self._text.append(text)
            if any(self.tag[i] == "a" for i in self._stack[-4:]):
                self._link += len(text.strip())

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                own = self._stack[self._open_blocks[-1]] if self._open_blocks else 0
                self.blocks.append((own, text, min(self._link, len(text))))
            self._text, self._link = [], 0

    def _pop(self, depth: int) -> None:
        if self._open_blocks and self._open_blocks[-1] >= depth:
            self._flush()
        for i in self._stack[depth:]:
            self._depths[self.tag[i]].pop()
        while self._open_blocks and self._open_blocks[-1] >= depth:
            self._open_blocks.pop()
        del self._stack[depth:]

    def _nearest(self, tags: set[str]) -> int:
        """The depth of the innermost open element of ``tags``, 0 if there is none."""
        return max((self._depths[t][-1] for t in tags if self._depths.get(t)), default=0)

    def _close(self, tag: str) -> None:
        if tag == "br":
            self._text.append(" ")
        elif tag == "p" or tag in _BLOCKS:
            self._flush()
        d = self._nearest({tag})
        if d and (tag in _BLOCKS or not self._open_blocks or self._open_blocks[-1] < d):  # an inline tag does not end a block
            self._pop(d)

    def _open(self, tag: str, attrs: str) -> None:
        if tag in _VOID:
            if tag == "hr":
                self._flush()
            elif tag == "br":
                self._text.append(" ")
            return
        if tag in _BLOCKS:
            if self._open_blocks and self.tag[self._stack[self._open_blocks[-1]]] == "p":  # a block ends the paragraph that is open
                self._pop(self._open_blocks[-1])
            self._flush()
        if tag in _CLOSES:
            ends, within = _CLOSES[tag]
            while (d := self._nearest(ends)) > self._nearest(within):
                self._pop(d)
                if tag != "tr" and tag != "tbody":
                    break
        top = self._stack[-1]
        names, soft, bad = "", 0, self._bad[top]
        if bad == 2 and tag in _HEADINGS:
            bad = 0
        elif not bad and tag == "header" and self._depths.get("article"):
            bad = 2  # of an article's header its headings stay
        elif tag == "aside" and self._depths.get("article") and not _QUOTES.isdisjoint(_SPLIT.split(attrs.lower())):
            pass
        elif tag == "button" and self._text and "".join(self._text).strip() and not self._depths.get("form"):
            pass  # in a sentence
        elif tag in _DROP:
            bad = 1
        if attrs and not attrs.isspace():
            got = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
            css = got.get("class", "").split()
            if tag not in ("html", "body", "header"):
                soft = max([_mark(c) for c in (*css, *got.get("id", "").split())], default=0)
            if "hidden" in got or got.get("aria-hidden") == "true" or got.get("role", "").lower() in _ROLES or "display:none" in got.get("style", "").replace(" ", "").lower():
                bad = 1
            names = "".join(f".{c}" for c in sorted({_DIGITS.sub("#", c.lower()) for c in css}))
        self._depths.setdefault(tag, []).append(len(self._stack))
        if tag in _BLOCKS:
            self._open_blocks.append(len(self._stack))
        self._stack.append(len(self.tag))
        self.parent.append(top)
        self.tag.append(tag)
        self.names.append(names)
        self.path.append(_step(self.path[top], tag + names) if tag in _CONTAINERS else self.path[top])
        self._bad.append(bad)
        self._soft.append(soft)

    def votes(self) -> dict[bytes, int]:
        """Millionths of the page's score by path."""
        worth = [0.0] * len(self.tag)
        for own, text, link in self.blocks:
            worth[own] += len(text) - 3 * link
        score: dict[bytes, float] = {}
        for i in range(len(self.tag) - 1, -1, -1):  # children come after their parents
            tag, up = self.tag[i], self.parent[i]
            if tag in _CONTAINERS:
                if worth[i] > 0:
                    boost = 2.5 if tag == "article" else 2.0 if tag == "main" else 1.5 if self._named(i) else 1.0 if tag not in _ROOTS else 0.7
                    score[self.path[i]] = score.get(self.path[i], 0.0) + worth[i] * boost
                worth[i] *= 0.5 if up >= 0 and self.tag[up] in _ROOTS else DECAY
            if up >= 0:
                worth[up] += worth[i]
        total = sum(score.values())
        return {p: round(1e6 * s / total) for p, s in score.items()} if total else {}

    def _named(self, i: int) -> bool:
        """Whether an element's classes name content."""
        return bool(self.names[i]) and not _GOOD.isdisjoint(_SPLIT.split(self.names[i]))

    def _on(self, path: bytes) -> list[tuple[int, str, int]]:
        on = [False] * len(self.tag)
        for i, up in enumerate(self.parent):
            on[i] = (self.tag[i] in _CONTAINERS and self.path[i] == path) or (up >= 0 and on[up])
        return [b for b in self.blocks if on[b[0]]]

    def _climb(self, path: bytes) -> list[tuple[int, str, int]]:
        """The blocks on ``path``, or on what encloses it as one article."""
        inner = self._on(path)
        first = next((i for i, p in enumerate(self.path) if p == path and self.tag[i] in _CONTAINERS), -1)
        if not inner or first < 0:
            return inner
        outer, i = [], self.parent[first]
        while i >= 0:
            if self.tag[i] in _CONTAINERS:
                outer.append(i)
            i = self.parent[i]
        for i in reversed(outer):
            if self.tag[i] == "article":
                return self._on(self.path[i])
        if self.tag[first] != "article":
            for i in reversed(outer):
                if self.tag[i] == "main" or (self.tag[i] not in _ROOTS and self._named(i)):
                    more = self._on(self.path[i])
                    size, link = (sum(len(b[1]) for b in more) - sum(len(b[1]) for b in inner), sum(b[2] for b in more) - sum(b[2] for b in inner))
                    if 3 * link <= size:
                        return more
        return inner

    def text(self, path: bytes | None) -> str:
        """The text on ``path``, or on the page's own best path."""
        on = self._climb(bytes(path)) if path is not None else []
        if not on and self.blocks:
            own_votes = self.votes()
            on = self._climb(min(own_votes, key=lambda p: (-own_votes[p], p)) if own_votes else self.path[0])
        return " ".join(b[1] for b in on)


def host_of(url: Column) -> Column:
    """The lower-cased host of a URL, '' if it has none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: dict[tuple[str, bytes], int] = {}
        for host, source in zip(batch.column("host"), batch.column("html"), strict=True):
            host = host.as_py()
            for path, share in Page(source.as_py() or "").votes().items():
                if share:
                    total[host, path] = total.get((host, path), 0) + share
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.binary()), pa.array(list(total.values()), pa.int64())], ["host", "path", "votes"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [Page(source.as_py() or "").text(path) for path, source in zip(batch.column("path").to_pylist(), batch.column("html"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path with most votes of each host."""
    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_vote, "host string, path binary, votes long")
    votes = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return votes.groupBy("host").agg(F.min(F.struct(-F.col("votes"), "path"))["path"].alias("path"))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    best = stage(winning_paths(pages), "paths")
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(best, "host", "left")
    return rows.select("page_id", "url", "html", "path").mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
