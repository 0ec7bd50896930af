"""Main text of web pages by tag-path ratios.

A page is cut into text nodes with their root-to-leaf tag paths; tags of inline
text stay out of the paths. Text length and punctuation are summed for each path,
and both ratios (for each block of the path) are smoothed over the paths in page
order and fused by their geometric mean. What tags and names say is fused in as
weights: text in links counts little, text in forms and in elements named as
adverts, notices or comments less, text in <article> or <main> more; such a name
says nothing of an element that holds an article or most of the page's text. Text
inside menus and asides has weight zero. Paths whose fused ratio reaches a share
of the best path's are content, and headings beside or above them. If any lies in
<article> or <main>, those outside are left out. Blocks of content nodes give the
text.

A page costs time and memory in proportion to its length, however deep its tags
lie: a path is a number, told by its parent's and its last tag.

A null or empty page, and one without content, gives an empty text. Markup
that is cut off or never closed is read as far as it goes. Repeated rows give
repeated results; no other column than those named is carried.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

SHARE = 0.1
# Weights of text in <article> or <main>, of text in links only, and in elements named as beside the main text.
CONTENT_WEIGHT = 4
LINKED_WEIGHT = 0.02
NAMED_WEIGHT = 0.005
# A named element is the main text when it holds more of a page's text than this: without, with <article> or <main>.
MOST, MOST_BESIDE_CONTENT = 0.5, 0.8
SMOOTHING = (0.25, 0.5, 0.25)

_QUOTED = r"""[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*"""
_MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_QUOTED}>|[^>]*(?:>|\Z))", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[^a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title".split())
_HIDDEN = frozenset("script style textarea title head noscript template svg iframe select button option object canvas audio video map dialog".split())
_ASIDE = frozenset("nav footer aside menu".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CONTENT = frozenset("article main".split())
_LISTS = frozenset("ul ol dl".split())  # each has paths of its own, so that one of links is told from one of text
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_INNER = frozenset("a abbr b big cite code em font i kbd label mark q s samp small span strike strong sub sup time tt u var".split())
# Names that tell of something beside the main text.
_BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments "
    "commentlist consent cookie cookies disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation "
    "newsletter notice notices notification pagination popup promo promoted promotion related respond share sharing "
    "sidebar signup skyscraper social sponsor sponsored subscribe toolbar widget widgets complementary contentinfo".split()
)
# These tell it alone or with words of page furniture: others contain them (related-work, social-policy).
_UNCLEAR = frozenset("sidebar social related comment comments notice notices menu share sharing".split())
_CLEAR = _BESIDE - _UNCLEAR
_FURNITURE = frozenset(
    "area articles bar bars block body bottom box button buttons container count feed form group header holder icon icons inner "
    "item items left link links list lists main media mobile network networks new news outer page panel popular post posts primary "
    "reader readers recent reply replies right row secondary section sections site stories story tab tabs thread threads title "
    "toggle tools top user users visitor visitors wrap wrapper".split()
)
_NEGATED = frozenset("has have hide no not with without".split())
# What an opening tag closes by itself, up to the nearest of the second set.
_CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
}


def _is_beside(name: str) -> bool:
    words = [w for w in _WORD.split(_HUMP.sub("-", name).lower()) if w]
    if not words or words[0] in _NEGATED:
        return False
    if not _CLEAR.isdisjoint(words):
        return True
    return not _UNCLEAR.isdisjoint(words) and (_UNCLEAR | _FURNITURE).issuperset(words)


def _named(attributes: str) -> bool:
    """Whether a class, id or role names something beside the main text."""
    if "=" not in attributes:
        return False
    return any(_is_beside(name) for found in _NAMES.findall(attributes) for name in "".join(found).split())


class _Paths:
    """Root-to-leaf tag paths as numbers; 0 is the root's."""

    def __init__(self):
        self.parent, self.tag, self._known = [0], [""], {}

    def below(self, path: int, tag: str) -> int:
        found = self._known.setdefault((path, tag), len(self.parent))
        if found == len(self.parent):
            self.parent.append(path)
            self.tag.append(tag)
        return found

    def around(self, paths) -> set[int]:
        """All paths above those of ``paths``."""
        seen: set[int] = set()
        for path in paths:
            while path and self.parent[path] not in seen:
                path = self.parent[path]
                seen.add(path)
        return seen


class _Open:
    """The open elements: (tag, path, hidden, beside, in_content, linked, mark), outermost first."""

    OUTSIDE = ("", 0, False, False, False, False, 0)

    def __init__(self):
        self.stack, self._places, self._block, self._solid = [], {}, [-1], [-1]
        self.top = self.OUTSIDE

    def last(self, tag: str) -> int:
        places = self._places.get(tag)
        return places[-1] if places else -1

    def push(self, entry) -> None:
        tag, place = entry[0], len(self.stack)
        self.stack.append(entry)
        self._places.setdefault(tag, []).append(place)
        self._block.append(place if tag in _BLOCK else self._block[-1])
        self._solid.append(self._solid[-1] if tag in _INNER else place)
        self.top = entry

    def cut(self, place: int) -> None:
        """Closes the element at ``place`` and all in it."""
        while len(self.stack) > place:
            self._places[self.stack.pop()[0]].pop()
            self._block.pop()
            self._solid.pop()
        self.top = self.stack[-1] if self.stack else self.OUTSIDE

    def end(self, tag: str) -> None:
        place = self.last(tag)
        # An inline end tag closes nothing beyond its block.
        if place >= 0 and (tag not in _INNER or place > self._block[-1]):
            self.cut(place)

    def start_block(self, tag: str) -> None:
        """A block ends an open paragraph and what is in it, and what its tag closes by itself."""
        solid = self._solid[-1]
        if solid >= 0 and self.stack[solid][0] == "p":
            self.cut(solid)
        if tag in _CLOSES:
            closes, bound = (max(map(self.last, tags)) for tags in _CLOSES[tag])
            if closes > bound:
                self.cut(closes)


def text_nodes(page: str) -> tuple[list[tuple[tuple[int, bool], int, str, bool, bool, bool]], _Paths]:
    """``((path, named), block, text, beside, in_content, linked)`` of each run of text, in page order, and the paths.

    Tags of inline text are left out of paths. ``named``: in an element named as beside the text, which
    holds neither an article nor most of the text.
    """
    nodes, opened, paths, block, at, n = [], _Open(), _Paths(), 0, 0, len(page)
    around, cleared = [0], [True]  # of each mark, a named element: the one around it, and whether it is main text

    def text(upto):
        top = opened.top
        if upto > at and not top[2]:
            nodes.append((top[1], block, html.unescape(page[at:upto]), *top[3:]))

    while at < n:
        m = _MARKUP.search(page, at)
        if m is None:
            text(n)
            break
        text(m.start())
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            opened.end(tag)
            block += tag in _BLOCK
            continue
        attributes = m[3].rstrip(">")
        if tag == "br":
            top = opened.top
            nodes.append((top[1], block, " ", top[3] or top[2], *top[4:]))
            continue
        if tag in _BLOCK:
            block += 1
            opened.start_block(tag)
        if tag in _VOID or attributes.endswith("/") and tag not in _BLOCK:
            continue
        _, path, hidden, beside, in_content, linked, mark = opened.top
        if tag in _CONTENT and not in_content:
            inner = mark
            while not cleared[inner]:
                cleared[inner] = True
                inner = around[inner]
        own = mark
        if tag not in ("html", "body", "main") and (tag == "form" or _named(attributes)):
            own = len(around)
            around.append(mark)
            cleared.append(False)
        beside = beside or tag in _ASIDE or tag == "header" and not in_content
        if tag not in _INNER or own != mark:
            path = paths.below(path, f"{tag}{block if tag in _LISTS else ''}")
        opened.push((tag, path, hidden or tag in _HIDDEN, beside, in_content or tag in _CONTENT, linked or tag == "a", own))
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if end is None:
                break
            at = end.end()
            opened.cut(len(opened.stack) - 1)
    lengths, total = [0] * len(around), 0
    for node in nodes:
        if not node[3]:
            size = len(node[2].strip())
            total += size
            lengths[node[6]] += size
    most = total * (MOST_BESIDE_CONTENT if any(node[4] for node in nodes) else MOST)
    for mark in range(len(around) - 1, 0, -1):  # inner marks come after those around them
        lengths[around[mark]] += lengths[mark]
    named = [False]
    for mark in range(1, len(around)):
        named.append(named[around[mark]] or not (cleared[mark] or lengths[mark] > most))
    return [((path, named[mark]), *rest) for path, *rest, mark in nodes], paths


def _smoothed(values: list[float]) -> list[float]:
    before, own, after = SMOOTHING
    padded = [values[0], *values, values[-1]]
    return [before * padded[i] + own * padded[i + 1] + after * padded[i + 2] for i in range(len(values))]


def content_paths(nodes, tags: _Paths) -> set[tuple[int, bool]]:
    """Paths whose fused ratio of text and punctuation reaches a share of the best one's."""
    sums: dict[tuple[int, bool], list] = {}
    for path, block, run, beside, in_content, linked in nodes:
        found = sums.setdefault(path, [0, 0, 0, 0, in_content, -1])
        size = 0 if beside else len(run.strip())
        if size:
            found[0] += found[5] != block
            found[1] += size
            found[2] += len(_PUNCTUATION.findall(run))
            found[3] += size * linked
            found[5] = block
    if not sums:
        return set()
    length = _smoothed([s[1] / max(s[0], 1) for s in sums.values()])
    marks = _smoothed([s[2] / s[0] + 1 if s[0] else 0.0 for s in sums.values()])
    fused = {
        path: math.sqrt(a * b) * max(1 - s[3] / s[1], LINKED_WEIGHT) * (NAMED_WEIGHT if path[1] else 1)
        for path, a, b, s in zip(sums, length, marks, sums.values())
        if s[0]
    }
    if not fused:
        return set()
    best = max(fused.values())
    inside = {path: f for path, f in fused.items() if sums[path][4]}
    if inside and max(inside.values()) >= SHARE * best:  # the page says where its article is, and the ratios agree
        fused, best = inside, max(inside.values()) / CONTENT_WEIGHT
    paths = {path for path, f in fused.items() if f >= SHARE * best}
    return {path for path in paths if not _is_heading(path, tags)} or paths


def _is_heading(path: tuple[int, bool], tags: _Paths) -> bool:
    return not path[1] and tags.tag[path[0]] in _HEADING


def main_text(page: str | None) -> str:
    if not page:
        return ""
    nodes, tags = text_nodes(page)
    paths = content_paths(nodes, tags)
    # Headings go with the text that lies beside or below them.
    above = tags.around(path for path, _ in paths)

    def heads(path):
        return _is_heading(path, tags) and tags.parent[path[0]] in above

    inside = any(n[4] and n[0] in paths for n in nodes)
    kept = [
        n for n in nodes
        if not n[3] and n[4] >= inside and (n[0] in paths or heads(n[0]))
    ]
    blocks: dict[int, list[str]] = {}
    for n in kept:
        blocks.setdefault(n[1], []).append(n[2])
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages (page_id, url, html)``."""

    def texts(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                found = [main_text(page) for page in batch.column(2).to_pylist()]
                lengths = pa.array([len(t) for t in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(found, pa.string()), lengths],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return pages.select("page_id", "url", "html").mapInArrow(texts, "page_id long, url string, text string, n_chars long")


def op8_html_extraction(spark, sf_dir):
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
