"""Main text of web pages by consensus host paths.

Each page becomes a tree of elements in one pass. Its containers are scored by the running text in
them; what is marked as boilerplate counts little. In Spark, the pages of a host vote on the
generalised tag-class path of their best container; then every page is extracted again from its
host's winning path, or from its own best container where it has none of them. Boilerplate is taken
out below the container only, so a wrapper's class name can't lose an article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.urls import host_of
from tessera.session import stage_table

# The HTML elements by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
NEVER = frozenset("head script style noscript template svg math iframe object canvas audio video button select textarea applet map noembed noframes xmp title".split())
ASIDE = frozenset("nav footer aside form dialog menu".split())
CONTAINERS = frozenset("body div section article main td center blockquote figure details header".split())
BLOCKS = CONTAINERS | frozenset("html p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr th thead tbody tfoot pre hr address hgroup nav footer aside form fieldset figcaption summary option caption search".split())
LISTS = frozenset("ul ol dl table".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of the key closes an open element of these, up to the next container or list.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Words in a class, id or role that mark what isn't the article.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion "
    "sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar "
    "comment comments commentlist reply replies respond disqus "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay disclaimer "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "widget pagination pager search searchbox copyright complementary contentinfo".split()
)
#: Of these, words that an article may be about: they say so only alone or beside words of layout.
AMBIGUOUS = frozenset("aside social related share sharing alert notice notices notification search menu banner widget promo promotion modal popup overlay copyright recommended recommendations complementary disclaimer login cookie cookies navigation reply replies respond".split())
#: Words of layout that may stand beside those above without changing what they say.
LAYOUT = frozenset(
    "area bar block body bottom box btn button buttons col column container content desktop divider elem element entry fixed form group header "
    "header heading holder icon icons id inline inner item items js left level link links list main mobile module outer page panel post posts primary right "
    "row secondary section site slot small sticky sub thread title top unit wrap wrapper x zone".split()
)
#: Words before one of those above by which a class says that its element only surrounds, or lacks, it.
AROUND = frozenset("has have no non not with without hide show close is can enable disable".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|</?([A-Za-z][^\s/>]*)([^>]*)>|</?[A-Za-z][^>]*\Z""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"[0-9]+")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

SEEN, WEAK, STRONG = 0, 1, 2
#: What a block counts for, by the marks around it.
WORTH = {SEEN: 1.0, WEAK: 0.5, STRONG: 0.1}


def mark_of(name: str) -> int:
    """How far one class name, id or role marks boilerplate: wholly, in part (other words stand beside), or not."""
    words = _WORDS.findall(_CAMEL.sub(" ", name).lower())
    hits = [w for i, w in enumerate(words) if w in BOILERPLATE and not (i and words[i - 1] in AROUND)]
    if not hits:
        return SEEN
    return WEAK if AMBIGUOUS.issuperset(hits) and not all(w in BOILERPLATE or w in LAYOUT for w in words) else STRONG


class Page:
    """Elements in the order of their start tags, and blocks of text.

    Of each element: its parent, its place, its mark, and if its text is never shown. A place is a
    generalised path: the steps (tag and classes) of the containers down to here; containers of one
    path are at one place. Of each block: its element, its text, the characters of it in links, and if
    it is a heading's.
    """

    def __init__(self, source: str):
        self.parent, self.place, self.mark, self.never = [-1], [0], [SEEN], [False]
        self.above, self.step = [-1], [""]  # of each place: the place around it and its last step
        self.places: dict[tuple[int, str], int] = {}
        self.roots: list[list[int]] = [[0]]  # the containers at each place
        self.blocks: list[tuple[int, str, int, bool]] = []
        self._parse(source)

    def _open(self, tag: str, attrs: str, parent: int, inside: bool) -> int:
        mark, never, classes = SEEN, self.never[parent] or tag in NEVER, []
        if tag in ASIDE or tag == "header" and not inside:
            mark = STRONG
        if attrs and not never:
            for m in _ATTRIBUTE.finditer(attrs):
                name = m[1].lower()
                value = next((x for x in m.group(2, 3, 4) if x is not None), "")
                if name == "hidden" and value.lower() != "until-found" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _HIDING.search(value):
                    never = True
                elif name in ("class", "id", "role") and tag not in ("body", "html"):
                    found = max((mark_of(x) for x in value.split()), default=SEEN)
                    if tag in ("article", "main") and found:
                        # an article is only something else if it says so by a word for readers' or other articles
                        found = STRONG if not {"comment", "comments", "reply", "related", "sponsored", "ad"}.isdisjoint(_WORDS.findall(value.lower())) else SEEN
                    mark = max(mark, found)
                if name == "class":
                    classes = sorted(_DIGITS.sub("#", x).replace(">", "_").lower() for x in value.split())
        number, place = len(self.parent), self.place[parent]
        if tag in CONTAINERS:
            around, step = place, ".".join([tag, *classes])
            place = self.places.setdefault((around, step), len(self.above))
            if place == len(self.above):
                self.above.append(around)
                self.step.append(step)
                self.roots.append([])
            self.roots[place].append(number)
        self.parent.append(parent)
        self.place.append(place)
        self.mark.append(mark)
        self.never.append(never)
        return number

    def _parse(self, source: str) -> None:
        # of each open element: tag, number, if in a link, if in an article or main, if in a heading
        stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
        scopes: list[dict[str, int]] = [{}]  # open elements by tag, up to the nearest container or list
        openers = [""]  # the tags of those
        everywhere: dict[str, int] = {}
        parts: list[str] = []
        linked = at = 0

        def flush() -> None:
            nonlocal linked
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.blocks.append((stack[-1][1], text, linked, stack[-1][4]))
                parts.clear()
            linked = 0

        def add(raw: str) -> None:
            nonlocal linked
            if raw and not self.never[stack[-1][1]]:
                text = html.unescape(raw) if "&" in raw else raw
                parts.append(text)
                if stack[-1][2]:
                    linked += len(text)

        def pop(closed: bool) -> None:
            tag, number, *_ = stack.pop()
            if tag in CONTAINERS or tag in LISTS:
                scopes.pop()
                openers.pop()
            scopes[-1][tag] -= 1
            everywhere[tag] -= 1
            if not closed and self.mark[number] == STRONG and tag in ASIDE:
                self.mark[number] = WEAK  # never closed by a tag of its own, so it may have swallowed what follows

        def pop_to(tags: tuple[str, ...]) -> None:
            while stack[-1][0] not in tags:
                pop(False)
            pop(True)

        for m in iter(lambda: _TOKEN.search(source, at), None):
            add(source[at : m.start()])
            at = m.end()
            tag = m[1] or m[3]
            if not tag:
                if m[0].startswith("<![CDATA["):
                    add(m[0][9:-3] if m[0].endswith("]]>") else m[0][9:])
                continue
            tag = tag.lower()
            if m[0][1] == "/":
                if tag in BLOCKS:
                    flush()
                elif tag == "br":
                    parts.append(" ")
                # an inline element's end tag doesn't reach out of its container
                if (everywhere if tag in BLOCKS else scopes[-1]).get(tag):
                    pop_to((tag,))
                continue
            if tag in BLOCKS:
                flush()
                if tag == "body":
                    while len(stack) > 1:
                        pop(False)
                for shut in (("p",), CLOSES.get(tag, ())):
                    while openers[-1] in shut or any(scopes[-1].get(x) for x in shut):
                        pop_to(shut)
            elif tag == "br":
                parts.append(" ")
            if tag in VOID:
                continue
            attrs = m[2] if m[1] else m[4]
            if attrs.endswith("/") and tag not in BLOCKS and tag not in RAW:
                continue
            _, parent, link, inside, heading = stack[-1]
            number = self._open(tag, attrs, parent, inside)
            stack.append((tag, number, link or tag == "a", inside or tag in ("article", "main"), tag in HEADINGS or heading and tag not in CONTAINERS))
            scopes[-1][tag] = scopes[-1].get(tag, 0) + 1
            everywhere[tag] = everywhere.get(tag, 0) + 1
            if tag in CONTAINERS or tag in LISTS:
                scopes.append({})
                openers.append(tag)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(source, at)
                at = end.start() if end else len(source)
        add(source[at:])
        flush()
        while len(stack) > 1:
            pop(False)

    def path(self, place: int) -> str:
        steps = []
        while place > 0:
            steps.append(self.step[place])
            place = self.above[place]
        return "".join(f">{x}" for x in reversed(steps))

    def best(self) -> tuple[int, float]:
        """The place whose containers hold most of the running text, and its score; ``(0, 0)`` without text.

        A block counts by its length and commas, less its share of links, and little where something
        around it is marked; in full for its container, and half as much for each container around it.
        The nearest article (else main) around the best stands for it.
        """
        n, places = len(self.parent), len(self.above)
        factor, score = [1.0] * n, [0.0] * places
        for i in range(1, n):
            factor[i] = max(factor[self.parent[i]] * WORTH[self.mark[i]], 1e-9)
        for element, text, linked, heading in self.blocks:
            worth = (1 + text.count(",") + min(len(text) / 100, 10)) * max(0.0, 1 - linked / len(text)) * factor[element]
            score[self.place[element]] += worth / 4 if heading else worth
        for i in range(places - 1, 0, -1):  # a place comes after the one around it
            score[self.above[i]] += score[i] / 2
        most = max(score[1:], default=0.0)
        if most <= 0:
            return 0, 0.0
        best = score.index(most, 1)  # of ties, the outermost and first
        for kind in ("article", "main"):
            i = best
            while i > 0 and self.step[i].partition(".")[0] != kind:
                i = self.above[i]
            if i > 0:
                return i, most
        return best, most

    def find(self, path: str) -> int | None:
        """The place of a path, if the page has it."""
        place = 0
        for step in path.split(">")[1:]:
            place = self.places.get((place, step), -1)
            if place < 0:
                return None
        return place

    def text(self, place: int) -> str:
        """The text in a place's containers without what is marked there. A mark in part counts where the element is mostly
        links, or short beside all of the text. If nothing is left, all of it."""
        n, roots = len(self.parent), set(self.roots[place])
        inside, chars, linked = [False] * n, [0] * n, [0] * n
        for i in range(n):
            inside[i] = i in roots or i > 0 and inside[self.parent[i]]
        mine = [b for b in self.blocks if inside[b[0]]]
        for element, text, links, _ in mine:
            chars[element] += len(text)
            linked[element] += links
        whole = sum(chars)
        for i in range(n - 1, 0, -1):
            chars[self.parent[i]] += chars[i]
            linked[self.parent[i]] += linked[i]
        out = [False] * n
        for i in range(1, n):
            weak = self.mark[i] == WEAK and (3 * linked[i] >= chars[i] or 20 * chars[i] < 3 * whole)
            out[i] = inside[i] and i not in roots and (self.mark[i] == STRONG or weak or out[self.parent[i]])
        return " ".join([b[1] for b in mine if not out[b[0]]] or [b[1] for b in mine])


def best_path(page: str) -> tuple[str, float]:
    """The generalised path of a page's best container, and its score; ``("", 0)`` without text."""
    parsed = Page(page)
    best, score = parsed.best()
    return parsed.path(best), score


def main_text(page: str | None, winners: list[str]) -> str:
    """The text in the first of the winning paths in which the page has any; else in its own best container; else
    all that is shown."""
    if not page:
        return ""
    parsed = Page(page)
    if not parsed.blocks:
        return ""
    for path in winners:
        place = parsed.find(path)
        if place is not None and (text := parsed.text(place)):
            return text
    return parsed.text(parsed.best()[0])


def vote(pages: DataFrame, least_share: float = 0.1) -> DataFrame:
    """``host``, ``paths``: the paths that won at least so large a share of the host's votes, best first.

    Votes are summed in Spark by host and path before anything is ranked, so what is gathered of a host is
    at most 1 / least_share paths. ``least_share`` is what winning means and no cut in the work: a page that has
    none of the winners is extracted from the container that it voted for itself.
    """
    schema = pa.schema([("host", pa.string()), ("path", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(host, *best_path(page.as_py())) for host, page in zip(batch.column(0).to_pylist(), batch.column(1))]
            rows = [x for x in rows if x[2] > 0]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    votes = pages.where("html is not null and html <> ''").select("host", "html").mapInArrow(run, "host string, path string, score double")
    # a page's weight grows slowly with its text, so that one very long page doesn't decide for its host
    sums = votes.groupBy("host", "path").agg(F.sum(F.log1p("score")).alias("votes"), F.count(F.lit(1)).alias("pages"))
    per_host = sums.groupBy("host").agg(F.sum("votes").alias("total"))
    ranked = sums.join(per_host, "host").where(F.col("votes") >= F.lit(least_share) * F.col("total"))
    return ranked.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("v"), "path"))), lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every page.

    Null and empty pages have an empty text, and so have pages that show none; elements may be nested to any
    depth, for the tree is built without recursion and in linear time; pages without a host vote together as one host; repeated
    rows give repeated results; an empty table gives an empty result; other columns are not read. The
    winners have one row per host: the planner broadcasts them under the session's threshold, and splits
    a hot host's pages in a shuffled join otherwise.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"), host_of(F.col(f"`{url_col}`").cast("string")).alias("host"))
    winners = stage_table(vote(rows), "paths").withColumnRenamed("host", "__host")
    joined = rows.join(winners, F.col("host") == F.col("__host"), "left").select("page_id", "url", "html", "paths")

    @F.pandas_udf("string")
    def text_of(html_pages, paths):
        import pandas as pd

        return pd.Series([main_text(p, [] if w is None else list(w)) for p, w in zip(html_pages, paths)], dtype=object)

    return joined.select("page_id", "url", text_of("html", "paths").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
