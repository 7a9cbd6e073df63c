"""Main text of web pages from streaming parser events, by text-to-tag ratio, smoothing and threshold clustering.

Parser events give lines of text (one for each run between block tags) on a tree of open elements. A line's ratio is
its text outside links over its tags. Ratios are smoothed along the page and split in two clusters; the lines of the
upper one are dense. Names of elements and words of class, id and role are votes: a line inside furniture has ratio 0,
and is not smoothed with its neighbours, unless the furniture turns out to wrap the content. What the clustering then
finds dense decides which container or which article blocks are the content, and which marked parts of it stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, texts

#: Elements whose start and end also end a line of text (the block elements of HTML).
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never text of a page.
OUTSIDE = frozenset(
    "head title script style noscript template svg math iframe object embed applet canvas audio video button select "
    "textarea option optgroup datalist map".split()
)
#: Elements around an article by their meaning; a header inside an article is its own.
AROUND = frozenset("nav aside footer form dialog menu header".split())
#: Words of class, id or role that mark furniture around an article.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments comentarios "
    "cookie cookies consent disqus footer gdpr header login masthead menu menubar modal nav navbar navigation "
    "newsletter notice notices notification overlay pagination popup promo promoted related reply replies respond "
    "search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets "
    "complementary contentinfo alert alertdialog form".split()
)
#: Those that are ordinary words too: alone, they only count for a container whose text looks like furniture.
AMBIGUOUS = frozenset(
    "ad ads advertising alert banner comment consent cookie cookies footer form header login menu modal navigation notice "
    "notices notification overlay pagination popup promoted related replies reply respond search share sharing social "
    "sponsor subscribe subscription toolbar widget widgets".split()
)
#: Classes that are never slugs of a title, and roles that say what an element is.
PLAIN_MARKS = {"class": frozenset(("ad", "ads")), "role": frozenset("banner navigation menu menubar search".split())}
#: Words of what readers wrote: these also count on an article element, which then is a comment.
COMMENTS = frozenset("comment comments comentarios disqus replies reply respond".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | {"p", "pre", "hgroup", "blockquote"}
ARTICLES = frozenset(("article", "main"))
#: Only these can be the region of a page without an article; a paragraph, heading, list, table or inline element cannot.
CONTAINERS = frozenset("html body div section center td".split())
#: A marked element with this share of the dense text, or with the page's h1 or an article in it, wraps the content.
WRAPS = 0.8
LINK_SHARE = 0.5
CONTRAST = 2
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Their start ends an open paragraph.
_P_ENDS = BLOCKS - frozenset("html head body title option optgroup caption tbody thead tfoot tr td th".split())
#: Their start ends an open element of the same name, but for one outside the list or table that they are in.
_ITEMS = {"li": ("ul", "ol"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}
NONE, DOUBTFUL, CERTAIN, COMMENT = range(4)


class Tree(HTMLParser):
    """Collects lines and the elements they stand in; time and memory are linear in the page.

    Elements have numbers in the order of their starts, so a parent's is smaller than its children's; 0 is the page.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.mark, self.article = [0], [""], [NONE], [False]
        self.has_title = [False]  # an h1 or an article element stands in it
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.links: list[int] = []  # characters inside links
        self.at: list[int] = []  # the innermost open element
        self.heading: list[bool] = []
        self.open: list[int] = [0]
        self.where: dict[str, list[int]] = {}  # places in the stack of each name
        self.blocks: list[int] = []  # places in the stack of all block elements
        self.parts: list[str] = []
        self.n_tags = self.hidden = self.in_links = self.in_headings = self.in_articles = self.link_chars = 0
        self.hides: list[bool] = [False]

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.texts.append(text), self.tags.append(max(1, self.n_tags)), self.links.append(min(self.link_chars, len(text)))
            self.at.append(self.open[-1]), self.heading.append(self.in_headings > 0)
            self.n_tags = 0
        self.link_chars = 0
        self.parts.clear()

    def marks(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[int, bool]:
        """What the element's name and words say of it, and whether it is hidden.

        An article's headings and paragraphs are not marked by their ids, nor by being its header.
        """
        level = CERTAIN if tag in AROUND and not (tag == "header" and self.in_articles) else NONE
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return level, True
            if name == "style" and value and "display:none" in value.replace(" ", "").lower():
                return level, True
            if name not in ("class", "id", "role") or not value or tag in ("html", "body"):
                continue
            words = FURNITURE.intersection(SPLIT.split(CAMEL.sub(" ", value).lower()))
            if name == "id" and self.in_articles and tag in PARAGRAPHS:
                continue
            if tag in ARTICLES:
                words &= COMMENTS
            if self.in_articles:
                words -= {"header"}
            if words & COMMENTS and (name == "class" or words - AMBIGUOUS):
                level = COMMENT if words - AMBIGUOUS or tag in ARTICLES else max(level, DOUBTFUL)
            if words - AMBIGUOUS or len(words) > 1 and name != "id" or PLAIN_MARKS.get(name, frozenset()).intersection(value.lower().split()):
                level = max(level, CERTAIN)
            elif words and tag in BLOCKS and tag not in PARAGRAPHS:
                level = max(level, DOUBTFUL)
        return level, False

    def shut(self, place: int) -> None:
        """Close every element from a place of the stack on."""
        while len(self.open) > place:
            number = self.open.pop()
            tag = self.tag[number]
            self.where[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
            self.in_links -= tag == "a"
            self.in_headings -= tag in HEADINGS
            self.in_articles -= self.article[number]
            self.hidden -= self.hides.pop()

    def last(self, tag: str) -> int:
        places = self.where.get(tag)
        return places[-1] if places else -1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.n_tags += 1
        if tag == "br" or tag == "wbr":
            self.parts.append(" " if tag == "br" else "")
            return
        if tag in BLOCKS:
            self.end_line()
        if tag in VOID:
            return
        if tag in _P_ENDS and (place := self.last("p")) >= 0 and self.blocks[-1] == place:
            self.shut(place)  # a block ends an open paragraph, and what was left open in it
        elif tag in _ITEMS and (place := self.last(tag)) > max(map(self.last, _ITEMS[tag])):
            self.shut(place)
        level, hides = self.marks(tag, attrs)
        number, parent = len(self.parent), self.open[-1]
        article = level != COMMENT and (tag in ARTICLES or ("role", "main") in attrs or ("itemprop", "articleBody") in attrs)
        self.parent.append(parent), self.tag.append(tag), self.mark.append(level), self.article.append(article), self.has_title.append(article or tag == "h1")
        hides = hides or tag in OUTSIDE
        self.where.setdefault(tag, []).append(len(self.open))
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append(number), self.hides.append(hides)
        self.in_links += tag == "a"
        self.in_headings += tag in HEADINGS
        self.in_articles += article
        self.hidden += hides

    def handle_endtag(self, tag: str) -> None:
        self.n_tags += 1
        if tag in BLOCKS:
            self.end_line()
        place = self.last(tag)
        # an inline end tag does not reach out of the block that it stands in
        if place >= 0 and (tag in BLOCKS or tag in OUTSIDE or not self.blocks or self.blocks[-1] < place):
            self.shut(place)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        depth = len(self.open)
        self.handle_starttag(tag, attrs)
        if tag not in VOID and len(self.open) > depth and tag not in ("p", "div", "span", "b", "i", "a"):
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        self.parts.append(data)
        if self.in_links:
            self.link_chars += len(" ".join(data.split()))

    def close(self) -> None:
        super().close()
        self.end_line()

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each element, the sum over the lines inside it."""
        out = np.zeros(len(self.parent))
        np.add.at(out, np.array(self.at, np.int64), values)
        total, parent = out.tolist(), self.parent
        for number in range(len(total) - 1, 0, -1):
            total[parent[number]] += total[number]
        return np.array(total)

    def inside(self, chosen: list[bool]) -> list[bool]:
        """For each element, whether it or one around it is chosen."""
        out = chosen[:1]
        for number in range(1, len(chosen)):
            out.append(chosen[number] or out[self.parent[number]])
        return out


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing along the lines."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach:-reach]
    return np.convolve(ratios, kernel)[reach:-reach] / weight


def two_clusters(values: np.ndarray) -> float:
    """The threshold between the two clusters of smoothed ratios, by alternating means from the extremes.

    Without a contrast, the means being within a factor of CONTRAST, all lines are of one kind: the least value.
    """
    low, high = float(values.min()), float(values.max())
    for _ in range(30):
        cut = (low + high) / 2
        above = values >= cut
        if above.all():
            return float(values.min())
        new = float(values[~above].mean()), float(values[above].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2 if high > CONTRAST * low else float(values.min())


def dense_lines(ratios: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Which lines are in the upper cluster. Lines of furniture (kind CERTAIN) count as 0, and only neighbours of one
    kind are smoothed together."""
    values = np.where(kind >= CERTAIN, 0.0, ratios)
    cuts = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    parts = [smoothed(part) for part in np.split(values, cuts)]
    values = np.concatenate(parts)
    return values >= two_clusters(values)


def content_lines(ratios: np.ndarray, size: np.ndarray, kind: np.ndarray, container: np.ndarray) -> np.ndarray:
    """Which lines are content, where no element says so: the upper cluster of ratios smoothed within their container.

    Ratios count up to that which half of all text has at least, so a few very long lines cannot push the others down.
    """
    values = np.where(kind >= CERTAIN, 0.0, ratios)
    order = np.argsort(-values, kind="stable")
    most = values[order[np.searchsorted(np.cumsum(size[order]), size.sum() / 2)]]
    cuts = np.flatnonzero((kind[1:] != kind[:-1]) | (container[1:] != container[:-1])) + 1
    values = np.concatenate([smoothed(part) for part in np.split(np.minimum(values, most), cuts)])
    return values >= two_clusters(values)


def main_text(html: str) -> str:
    """The article of one page: its blocks in page order, joined by newlines; empty if there is none.

    1. Lines are clustered by smoothed ratio as they are; this shows which marked elements wrap the content.
    2. They are clustered again with the lines of all other marked elements at ratio 0, or, where only an ambiguous word
       marks them, smoothed apart from their neighbours.
    3. If there are article or main elements, those with dense lines are the region (all of them, if none has any). Else
       it is the container in which content outweighs other text most, the outermost of several.
    4. Every line of the region is kept, whatever its own ratio, but for marked elements that are not mostly dense. An
       element with only an ambiguous word is such if its text is sparse or mostly links; headings do not count there.
    """
    tree = Tree()
    tree.feed(html)
    tree.close()
    if not tree.texts:
        return ""
    size = np.array([len(t) for t in tree.texts])
    links, at, heading = np.array(tree.links), np.array(tree.at), np.array(tree.heading)
    ratios, mark = (size - links) / np.array(tree.tags), np.array(tree.mark)

    dense = dense_lines(ratios, np.zeros(len(size), int))
    titled = tree.has_title[:]
    for number in range(len(titled) - 1, 0, -1):
        titled[tree.parent[number]] |= titled[number]
    share = tree.sums(size * dense) / max(1, size[dense].sum())
    wraps = np.array(titled) | (share >= WRAPS) & (mark != COMMENT)
    wraps &= ~np.isin(np.array(tree.tag), ("nav", "aside", "footer", "menu"))
    if tree.sums(size * ~np.array(tree.inside(((mark >= CERTAIN) & ~wraps).tolist()))[at])[0] == 0:
        wraps[:] = True  # all of the page is marked: the marks say nothing
    certain = np.array(tree.inside(((mark >= CERTAIN) & ~wraps).tolist()))

    unsure = (mark == DOUBTFUL) & ~wraps
    kind = np.where(certain, CERTAIN, np.where(tree.inside(unsure.tolist()), DOUBTFUL, NONE))
    dense = dense_lines(ratios, kind[at])
    plain = ~heading
    chars, in_links, filled = tree.sums(size * plain), tree.sums(links * plain), tree.sums(size * (dense & plain))
    doubtful = unsure & (chars > 0) & ((in_links >= LINK_SHARE * chars) | (2 * filled < chars))
    gone = (certain | np.array(tree.inside(doubtful.tolist())))[at] & ~(dense & certain[at])

    blocks = [a and not inner for a, inner in zip(tree.article, [False, *(tree.inside(tree.article)[p] for p in tree.parent[1:])])] if any(tree.article) else []
    held = tree.sums(size * ~gone)
    blocks = [b and held[k] > 0 for k, b in enumerate(blocks)]
    if any(blocks):
        strong = tree.sums(size * (dense & ~gone)) > 0
        chosen = [b and bool(strong[k]) for k, b in enumerate(blocks)]
        region = tree.inside(chosen if any(chosen) else blocks)
    else:
        holder = [0] * len(tree.tag)  # the container around each element, itself included
        for number in range(1, len(holder)):
            holder[number] = number if tree.tag[number] in CONTAINERS else holder[tree.parent[number]]
        content = content_lines(ratios, size, kind[at], np.array(holder)[at])
        net = tree.sums(np.where(gone, 0, np.where(content, size, np.where(heading, 0, -size))))
        several = tree.sums(~gone * 1.0) > 1  # around a single line it is a paragraph by another name
        candidates = [k for k, tag in enumerate(tree.tag) if k == 0 or tag in CONTAINERS and several[k]]
        best = max(candidates, key=lambda k: (net[k], -k))
        region = tree.inside([k == best for k in range(len(net))])
    return "\n".join(t for t, a, g in zip(tree.texts, tree.at, gone.tolist()) if region[a] and not g)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    Null or empty html gives an empty text; broken markup never fails; null ids and repeated rows are kept as they
    are; an empty table gives an empty result; other columns are ignored. One narrow pass; memory is one batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(t.decode()) for t in texts(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), text_or_empty(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
