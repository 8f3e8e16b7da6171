"""Main text of web pages by text-to-tag ratios.

The events of the standard library's parser are read as a stream and give *lines*: one for each
block of the page, with its text, its number of inline tags, and the content container (article,
main) that it stands in. A line's text-to-tag ratio is its characters over its tags. The ratios in
page order are smoothed with a Gaussian; two-means clustering of the smoothed ratios gives the
threshold between content and the rest. Lines above it select regions: the content containers
that hold them, or, on pages without such containers, runs of lines with at most two others
between them. Short lines of a selected region belong to it, and so does a heading just before it.

Elements that never hold article text count as tags without text: navigation, page headers,
footers, asides, forms, scripts, styles, and blocks whose class, id or role says menu, advert,
notice, comment and the like. Within an article or main a name only says so if all its parts do
("share-buttons"); a line below a name of which just one part does ("search-for-truth") is left out only
if its ratio is not above the threshold or half of its characters are links. Names such as has-sidebar, no-comments or tag-advertising say nothing
of the kind. As layout wrappers and forms around a whole page bear such names too, an article or
main within one counts as a container again, an article only if it is as long as the page's main
text without such articles; but never one within comments, related items or adverts, or named so.

Defined cases: a null, empty or markup-free page without blocks of text gives "" or its text as
one block; unclosed and stray tags are tolerated; an unfinished tag at the end is dropped. Rows
that repeat a page and null ids or urls are returned as they are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
# Never article text. Within an article, a header holds its title.
SKIPPED = frozenset(
    "aside audio button canvas dialog fieldset footer form head iframe label menu nav noscript object option script select "
    "style svg template textarea title video".split()
)
CONTAINERS = frozenset(("article", "main"))
CLOSES = {  # an opening tag ends these if they are open in the same block
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promoted "
    "related replies reply respond responses share sharing sidebar social sponsor sponsored subscribe toolbar widget widgets "
    "complementary contentinfo search".split()
)
FOREIGN = frozenset(  # other texts than the page's own, also as articles
    "ad ads adv advert adverts advertisement advertising comment comments disqus promo promoted related replies reply respond "
    "response responses sponsor sponsored".split()
)
# Parts of a name that say nothing about what the element holds.
PLAIN = frozenset(
    "area bar block body bottom box button buttons card center col column container content form group head header icon icons "
    "inline inner item items label left link links list main message msg note outer panel policy post posts right row section "
    "sign signup slot small sticky text thread title top unit up wrap wrapper".split()
)
# A name that begins or ends like these tells what the page has or is about.
ABOUT = frozenset("no has have with without hide category cat tag topic type format status".split())
STATES = frozenset("open closed enabled disabled allowed off on free count".split())
LAYOUT, NEVER = 1, 2  # why an element is skipped; a container within the first may count
SIGMA = 1.0
GAP = 2
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BEFORE = 3  # lines before a region among which its heading is looked for
LINKED = 0.5  # share of a line's characters in links


def names_of(attrs: list[tuple[str, str | None]]) -> list[set[str]]:
    """The parts of each class, id and role that names the element itself."""
    out = []
    for name in " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower().split():
        parts = [w for w in re.split("[_-]+", name) if w]
        if parts and (len(parts) == 1 or (parts[0] not in ABOUT and parts[-1] not in STATES)):
            out.append(set(parts))
    return out


class Line(NamedTuple):
    text: str
    tags: int
    container: int  # -1 stands for none
    heading: bool = False
    doubtful: bool = False  # below an element of which part of the name says that it is no text
    linked: int = 0  # characters in links


class Lines(HTMLParser):
    """Collects the lines of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        # Tag, skipped from here on (0, LAYOUT, NEVER), container, doubtful.
        self.open: list[tuple[str, int, int, bool]] = []
        self.text: list[str] = []
        self.tags = self.linked = self.containers = 0
        self.wrapped: set[int] = set()  # containers that are articles in a skipped layout

    def _state(self) -> tuple[int, int, bool]:
        return self.open[-1][1:] if self.open else (0, -1, False)

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            _, container, doubtful = self._state()
            heading = any(entry[0] in HEADINGS for entry in self.open)
            self.lines.append(Line(text, self.tags, container, heading, doubtful, self.linked))
        elif self.tags:
            self.lines.append(Line("", self.tags, -1))
        self.text, self.tags, self.linked = [], 0, 0

    def _close(self, tag: str, within: frozenset[str] = frozenset()) -> bool:
        """Pop up to the last open ``tag`` unless one of ``within`` is met first."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return True
            if self.open[k][0] in within:
                return False
        return False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag in BLOCKS
        if block:
            self.flush()
            if tag not in ("html", "body"):
                self._close("p", BLOCKS - {"p"})
            for other in CLOSES.get(tag, ()):
                self._close(other, frozenset(("ul", "ol", "dl", "table", "select", "article", "main", "div", "section")))
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        skipped, container, doubtful = self._state()
        if skipped < NEVER and tag not in ("html", "body"):
            names = names_of(attrs)
            if container >= 0 and tag not in CONTAINERS:
                doubtful = doubtful or any(not HINTS.isdisjoint(name) and not name <= HINTS | PLAIN for name in names)
                names = [name for name in names if name <= HINTS | PLAIN]
            named = set().union(*names)
            if tag in CONTAINERS:
                if not FOREIGN.isdisjoint(named):
                    skipped = NEVER
                elif skipped or container < 0:
                    if skipped and tag == "article":
                        self.wrapped.add(self.containers)
                    skipped, container, self.containers = 0, self.containers, self.containers + 1
                    doubtful = False
            elif not FOREIGN.isdisjoint(named) or (tag in SKIPPED and tag != "form"):
                skipped = NEVER
            elif tag == "form" or (tag == "header" and container < 0) or not HINTS.isdisjoint(named):
                skipped = LAYOUT
        self.open.append((tag, skipped, container, doubtful))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # as browsers do: the slash means nothing, except in void elements

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        if tag not in VOID:
            self._close(tag, CONTAINERS if tag not in CONTAINERS and tag not in ("html", "body") else frozenset())

    def handle_data(self, data: str) -> None:
        if not self._state()[0]:
            self.text.append(data)
            if any(entry[0] == "a" for entry in self.open):
                self.linked += len(data)


def smoothed(ratios: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing; weights beyond the ends are left out."""
    reach = math.ceil(3 * sigma)
    weights = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for k in range(len(ratios)):
        lo, hi = max(0, k - reach), min(len(ratios), k + reach + 1)
        used = weights[lo - k + reach : hi - k + reach]
        out.append(sum(w * r for w, r in zip(used, ratios[lo:hi])) / sum(used))
    return out


def threshold(values: list[float]) -> float:
    """Midpoint between the two clusters' means (two-means on the line); below all if they are one cluster."""
    low, high = min(values), max(values)
    if high - low < 1e-9:
        return low - 1
    while True:
        cut = (low + high) / 2
        below, above = [v for v in values if v <= cut], [v for v in values if v > cut]
        new = sum(below) / len(below), sum(above) / len(above)
        if abs(new[0] - low) + abs(new[1] - high) < 1e-9:
            return cut
        low, high = new


def blocks(lines: list[Line], containers: bool) -> list[str]:
    """The texts of the selected lines."""
    if not any(line.text for line in lines):
        return []
    values = smoothed([len(line.text) / max(1, line.tags) for line in lines])
    cut = threshold(values)
    chosen = [k for k, line in enumerate(lines) if line.text and values[k] > cut]
    regions = {lines[k].container for k in chosen} - {-1}
    if containers:
        mass: dict[int, int] = {}
        for line in lines:
            if line.container >= 0:
                mass[line.container] = mass.get(line.container, 0) + len(line.text)
        if not regions and any(mass.values()):
            regions = {max(mass, key=lambda c: (mass[c], -c))}  # an article of short lines only
        if regions:
            return [
                line.text
                for line, value in zip(lines, values)
                if line.text and line.container in regions and not (line.doubtful and (value <= cut or line.linked > LINKED * len(line.text)))
            ]
    # No container: chosen lines, up to GAP others between two of them, and a heading before them.
    shown = [k for k, line in enumerate(lines) if line.text]
    place = {k: n for n, k in enumerate(shown)}
    kept = set(chosen)
    for a, b in zip([None, *chosen], chosen):
        if a is not None and place[b] - place[a] <= GAP + 1:
            kept.update(shown[place[a] : place[b]])
            continue
        first = 0 if a is None else place[a] + 1
        before = range(max(first, place[b] - BEFORE), place[b])
        start = next((n for n in before if lines[shown[n]].heading), place[b])
        kept.update(shown[start : place[b]])
    return [lines[k].text for k in sorted(kept)]


def main_text(html: str | None, separator: str = "\n") -> str:
    """The page's blocks of main text in page order, joined by ``separator``."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines = parser.lines
    if parser.wrapped:
        sizes: dict[int, int] = {}
        for line in lines:
            sizes[line.container] = sizes.get(line.container, 0) + len(line.text)
        others = [Line("", line.tags, -1) if line.container in parser.wrapped else line for line in lines]
        without = blocks(others, parser.containers > len(parser.wrapped))
        if max(sizes.get(c, 0) for c in parser.wrapped) < sum(map(len, without)):
            return separator.join(without)
    return separator.join(blocks(lines, parser.containers > 0))


def extract(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), separator: str = "\n") -> DataFrame:
    """The kept columns and the page's main text in ``text``, its blocks joined by ``separator``."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, separator) for h in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*keep, "text"])

    rows = df.select(*keep, F.col(html_col).alias("__html"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    return rows.mapInArrow(parse, f"{kinds}, text string")
