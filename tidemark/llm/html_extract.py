"""HTML extraction (operator 6): consensus host paths.

1. Each page is parsed once into a tree of containers, which are scored by the
   text of the blocks below them, less link text.  From the best one on, the
   outermost one below the body that adds text (within ``article`` or ``main``,
   if there is one around it) is taken; its path of tags and generalised classes
   (``html>body>div.post-#``) is the page's vote.
2. Spark adds up the votes by host and path and keeps each host's leading paths,
   those with at least ``share`` of its votes.
3. Every page is extracted again: with the leading path of its host that it
   has, or its own best where it has none of them (also where that is a path
   with less than ``share`` of the votes).

Votes are added with partial aggregates, so a host with a third of all pages is
a few rows for each task.  The leading paths of hosts with many pages, whose
number is bounded, are broadcast and these pages are extracted where they are
read; only pages of other hosts meet their paths by host.

Parsing takes time and memory in proportion to the page, however deep or broken
it is: containers know their parent, paths are numbers, and no search that found
nothing is made again.

Noise is left out, but not what a page is wrapped in: a form, or widgets, with
most of the page's text and no less than half of that in elements named as the
text (article, post); an ``article`` or ``main`` with most of the text; and
whatever classes call an element that has most of it and all titles and articles.

Defined results: a null or empty html gives an empty text; an element that is
left out whole (``video``, ``template``) and has no end tag holds nothing, a
``script`` or ``style`` holds the rest; a tag that the page's end cuts off is no
text; repeated rows stay repeated; a page without a url votes under an empty
host; among paths with equal votes the higher score leads, then the lesser path;
other columns are ignored.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch
from tidemark.llm.url_filter import host_path

#: Share of all votes from which on a host's pages are not dealt by host.
HOT = 0.002

#: Fixed values of HTML: elements without an end, with raw text, and those that end a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CODE = frozenset("script style".split())
RAW = frozenset("textarea title noscript iframe xmp noembed noframes".split())
#: Elements of other content than text, which may nest.
OTHER = frozenset("template svg math video audio canvas object".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul button".split())
#: An open element of the key ends where one of these begins.
CLOSES = {"p": BLOCKS - {"button", "option", "optgroup", "body", "html"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option", "optgroup"]), "head": frozenset(["body"])}
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6", "hgroup"])
#: Elements, roles and words of classes and ids that are never main text.
SKIP = frozenset("nav footer aside form select button dialog menu head".split())
ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promotions banner banners sidebar sidebars sidenav menu menus nav navbar navigation topnav breadcrumb breadcrumbs "
    "foot footer footnav header masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login social share sharing sharedaddy addtoany related relatedposts outbrain taboola recommended recommendations trending "
    "comment comments commentlist disqus respond reply replies discussion search pagination pager widget widgets toolbar skip hidden".split()
)
#: Words of what may as well be around a page's text (and forms may), and how sure noise is: opened where it has most of
#: the text, where it has all titles too, or never.
AROUND = frozenset("widget widgets".split())
SOFT, FIRM, HARD = 1, 2, 3
ARTICLE = frozenset("article main".split())
#: Elements that hold a block or the parts of a table, not a text.
OWN_BLOCKS = frozenset("p li dd dt td th tr tbody thead pre blockquote".split()) | HEADINGS
#: Words that name an element as the text, and make a header that of a text, not of a site.
OF_TEXT = frozenset("article entry hentry post story".split())

#: Text, or a tag without quotes.  No quantifier gives back what it took, so a failure costs no more than the way to it.
_TOKEN = re.compile(r"([^<]++)|<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: Where a tag may end, or a quoted value begins.
_STOP = re.compile(r">|=\s*+[\"']")
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
_PART = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"[0-9]+")
_SPACE = re.compile(r"\s+")
_TELLING = re.compile(r"\b(?:class|id|hidden|role|style|aria-hidden)\b", re.I)
#: What a wrapper says it has beside the text (has-sidebar, page--with-menu) or is filed under (tag-social); it is not that thing itself.
_BESIDE = re.compile(r"(?<![a-z])(?:(?:has|with|no|without)[-_]+[^\s]*|(?:category|tag|topic|term|taxonomy|keyword|format|status)[-_]+[^\s]*)", re.I)


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(raw)} if raw and not raw.isspace() else {}


def _named(attributes: dict[str, str]) -> list[str]:
    """Words of classes and ids."""
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    return _PART.split(_CAMEL.sub(" ", _BESIDE.sub(" ", names)).lower()) if len(names) > 1 else []


def _noise(tag: str, attributes: dict[str, str], in_article: bool, words: list[str]) -> int:
    """0, or how sure it is that an element is noise."""
    if tag in SKIP and tag != "form" or tag == "header" and not in_article:
        return HARD
    if tag in ("html", "body") or not attributes:
        return SOFT if tag == "form" else 0
    role = attributes.get("role", "").lower()
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or role in ROLES and role != "form":
        return HARD
    if "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return HARD
    of_text = in_article or not OF_TEXT.isdisjoint(words)
    found = {w for w in words if w in NOISE and not (of_text and (w in AROUND or w in ("header", "masthead")))}
    if found - AROUND and OF_TEXT.isdisjoint(attributes.get("class", "").lower().split()):
        return FIRM
    return SOFT if found or tag == "form" or role == "form" else 0


def _step(tag: str, attributes: dict[str, str]) -> str:
    """Tag and generalised classes: digits become one #, order does not count."""
    classes = attributes.get("class")
    return ".".join([tag, *sorted({_DIGITS.sub("#", c.replace(">", "")) for c in classes.lower().split()})]) if classes else tag


class _Skipped:
    """Finds the ends of elements that are left out whole; a search without success is not made again."""

    def __init__(self, html: str):
        self.html = html
        self.endless: set[str] = set()
        self.flat = set(CODE | RAW)

    def end(self, tag: str, at: int) -> int:
        if tag not in self.endless:
            depth, first = 1, -1
            for m in re.compile(rf"<(/?){tag}(?=[\s/>])", re.I).finditer(self.html, at):
                depth += -1 if m[1] else tag not in self.flat
                if m[1] and first < 0:
                    first = m.end()
                if not depth:
                    first = m.end()
                    break
            else:
                self.flat.add(tag)  # ends and beginnings don't match: the first end it is
            if first >= 0:
                return self.html.find(">", first) + 1 or len(self.html)
            self.endless.add(tag)
        return len(self.html) if tag in CODE else at


class Page:
    """The containers of a page, parents before children, and its blocks: (text, characters in links, container).

    Inline elements that may be noise are in the tree too, without a step of the path; 0 is the page.
    """

    def __init__(self, html: str | None):
        self.tags, self.up, self.path, self.inline, self.kinds = [""], [-1], [0], [False], [0]
        self.numbers: dict[tuple[int, str], int] = {}  # of paths, by the path around and the step
        self.steps: list[tuple[int, str]] = [(-1, "")]
        self._named, self._seen = [False], [0]
        noisy = self._noisy(found := self._parse(html or ""))
        self.blocks: list[tuple[str, int, int]] = []
        for at, pieces in found:
            if not noisy[at]:
                links = sum(len(text) for text, i, linked in pieces if linked and not noisy[i])
                own = _SPACE.sub(" ", unescape("".join([" " if noisy[i] else text for text, i, _ in pieces]))).strip()
                if own:
                    self.blocks.append((own, min(links, len(own)), at))

    def _parse(self, html: str) -> list[tuple[int, list[tuple[str, int, bool]]]]:
        """Fills in the tree; gives the blocks as container and pieces of (text, element, whether in a link)."""
        tags, up, path, inline, kinds, named, seen, numbers, steps = self.tags, self.up, self.path, self.inline, self.kinds, self._named, self._seen, self.numbers, self.steps
        stack, around = [0], [0]  # open elements, and the nearest block of each
        opened: dict[str, int] = {}  # blocks by tag
        tracked: dict[str, list[int]] = {}  # inline elements in the tree by tag
        inner: dict[int, int] = {}  # open elements of the same tag in one of those
        found: list[tuple[int, list]] = []
        pieces: list[tuple[str, int, bool]] = []
        link, skipped, quotes, comments = 0, _Skipped(html), True, True

        def flush():
            nonlocal pieces
            if pieces:
                found.append((around[-1], pieces))
                pieces = []

        def pop():
            nonlocal link
            i = stack.pop()
            around.pop()
            if inline[i]:
                tracked[tags[i]].pop()
            else:
                opened[tags[i]] -= 1
                link = 0

        def push(tag: str, kind: int, is_inline: bool, number: int, text: bool):
            tags.append(tag)
            up.append(stack[-1])
            path.append(number)
            inline.append(is_inline)
            kinds.append(kind)
            named.append(text)
            seen.append(0)
            stack.append(len(tags) - 1)
            around.append(around[-1] if is_inline else len(tags) - 1)

        at, end, last, match = 0, len(html), html.rfind(">"), _TOKEN.match
        while at < end:
            m = match(html, at)
            if m is not None:
                plain, closing, tag, raw = m.groups()
                at = m.end()
                if plain is not None:
                    i = stack[-1]
                    pieces.append((plain, i, link > 0))
                    if not link:
                        seen[i] += len(plain.strip())
                    continue
            else:
                m = _NAME.match(html, at)
                if at > last and (m is not None or html[at + 1 : at + 2] in ("/", "!", "?")):
                    break  # what the page's end cuts off
                if m is None:
                    if html.startswith("<!--", at) and comments:
                        stop = html.find("-->", at + 2)
                        comments = stop >= 0
                        at = stop + 3 if comments else html.find(">", at) + 1
                    elif html[at + 1 : at + 2] in ("/", "!", "?"):
                        at = html.find(">", at) + 1
                    else:
                        pieces.append(("<", stack[-1], link > 0))
                        at += 1
                    continue
                closing, tag = m.groups()
                stop, begin = -1, m.end()
                while quotes and (m := _STOP.search(html, begin if stop < 0 else stop)):
                    if m[0] == ">":
                        stop = m.start()
                        break
                    stop = html.find(m[0][-1], m.end()) + 1
                    if not stop:
                        m = None
                        break
                if m is None or not quotes:
                    quotes = False  # one is left open: from here on none counts
                    stop = html.find(">", begin)
                raw, at = html[begin:stop], stop + 1
            tag = tag.lower()
            if closing:
                if tag == "a":
                    link = max(0, link - 1)
                if tag == "br":
                    pieces.append((" ", stack[-1], False))
                elif opened.get(tag):
                    flush()
                    while tags[stack[-1]] != tag or inline[stack[-1]]:
                        pop()
                    pop()
                elif own := tracked.get(tag):
                    if inner.get(own[-1]):
                        inner[own[-1]] -= 1
                    else:
                        i = own[-1]
                        if around[-1] > i:
                            flush()
                        while stack[-1] != i:
                            pop()
                        pop()
                continue
            if tag in CODE or tag in RAW or tag in OTHER:
                if not (raw.endswith("/") and tag in OTHER):
                    at = skipped.end(tag, at)
                continue
            if tag == "a":
                link += 1
            elif tag in ("br", "img", "input"):
                pieces.append((" ", stack[-1], False))
            if tag not in BLOCKS or tag in VOID:
                if tag == "hr":
                    flush()
                elif tag not in VOID and not raw.endswith("/"):
                    kind = 0
                    if ("-" in tag or raw and _TELLING.search(raw)) and not opened.get("pre"):
                        # Adverts, notices and the like inside a block; in code, "comment" is a colour.
                        attributes = _attributes(raw)
                        if "-" in tag:
                            attributes["class"] = f"{tag} {attributes.get('class', '')}"
                        kind = _noise(tag, attributes, True, _named(attributes))
                    if kind:
                        push(tag, kind, True, path[around[-1]], False)
                        tracked.setdefault(tag, []).append(stack[-1])
                    elif tracked.get(tag):
                        inner[tracked[tag][-1]] = inner.get(tracked[tag][-1], 0) + 1
                continue
            flush()
            while tag in CLOSES.get(tags[around[-1]], ()):
                i = around[-1]
                while stack[-1] != i:
                    pop()
                pop()
            attributes = _attributes(raw)
            words, outer = _named(attributes), around[-1]
            # The site's own header is not in a post, whatever the page's body is called.
            in_text = named[outer] or tag in ARTICLE or tag not in ("html", "body") and not OF_TEXT.isdisjoint(words)
            kind = _noise(tag, attributes, named[outer], words)
            key = (path[outer], _step(tag, attributes))
            number = numbers.get(key)
            if number is None:
                number = numbers[key] = len(steps)
                steps.append(key)
            push(tag, kind, False, number, in_text and kind < FIRM)
            opened[tag] = opened.get(tag, 0) + 1
        flush()
        return found

    def _noisy(self, found) -> list[bool]:
        """For each element whether it is in noise."""
        tags, up, kinds, n = self.tags, self.up, self.kinds, len(self.tags)
        spared: set[int] = set()
        if any(0 < k < HARD for k in kinds):
            for most in (SOFT, FIRM):
                # Text, text in elements named as the text, and titles, of each element, without surer noise.
                size, told, titles = list(self._seen), [s if t else 0 for s, t in zip(self._seen, self._named, strict=True)], [not k and (t == "h1" or t in ARTICLE) for t, k in zip(tags, kinds, strict=True)]
                sure, widget = [False] * n, [0] * n  # widget: the outermost one around
                for i in range(n - 1, 0, -1):
                    if kinds[i] <= most:
                        size[up[i]] += size[i]
                        told[up[i]] += told[i]
                        titles[up[i]] += titles[i]
                for i in range(1, n):
                    sure[i] = sure[up[i]] or kinds[i] > most
                    widget[i] = widget[up[i]] or (i if 0 < kinds[i] <= most and tags[i] != "form" else 0)
                maybe = [i for i in range(1, n) if 0 < kinds[i] <= most and not sure[i]]
                holds = {i for i in maybe if 2 * size[i] > size[0] and 2 * told[i] >= told[0]}
                if most == SOFT:
                    spared |= holds
                    outer = [i for i in maybe if widget[i] == i]
                    if 2 * sum(size[i] for i in outer) > size[0] and 2 * sum(told[i] for i in outer) >= told[0]:
                        spared.update(i for i in maybe if widget[i])
                else:
                    spared |= {i for i in holds if tags[i] in ARTICLE or titles[i] and titles[i] == titles[0]}
        noisy = [False] * n
        for i in range(1, n):
            noisy[i] = noisy[up[i]] or bool(kinds[i]) and i not in spared
        return noisy

    def path_of(self, number: int) -> str:
        out = []
        while number > 0:
            number, step = self.steps[number]
            out.append(step)
        return ">".join(reversed(out))

    def number_of(self, path: str) -> int | None:
        number: int | None = 0
        for step in path.split(">"):
            number = self.numbers.get((number, step))
            if number is None:
                break
        return number

    def scores(self) -> dict[int, float]:
        """Of containers: a block's text, less its links, for its own container, less for those further out."""
        sums, holds = [0.0] * len(self.tags), [False] * len(self.tags)
        for text, links, at in self.blocks:
            sums[at] += len(text) - 2 * links
            holds[at] = True
        out: dict[int, float] = {}
        for i in range(len(self.tags) - 1, 0, -1):
            if holds[i]:
                tag, outer = self.tags[i], self.up[i]
                holds[outer] = True
                if tag in OWN_BLOCKS or self.inline[i]:
                    sums[outer] += sums[i]
                else:
                    sums[outer] += 0.75 * sums[i]
                    out[i] = sums[i] * (0.3 if tag in ("body", "html") else 1.5 if tag in ARTICLE else 1.0)
        return out

    def whole(self, core: int) -> int:
        """The outermost container around ``core`` that adds text which is not mostly links."""
        chain, i = [], core
        while i > 0:
            if not self.inline[i]:
                chain.append(i)
            i = self.up[i]
        chain.reverse()
        fit = [k for k, i in enumerate(chain) if self.tags[i] not in OWN_BLOCKS and self.tags[i] not in ("body", "html")]
        declared = [k for k in fit if self.tags[chain[k]] in ARTICLE]
        fit = [k for k in fit if not declared or k >= declared[0]]
        # For each place in the chain the nearest fit one at or above it, and for each container where it meets the chain.
        upto, near, wanted = [], None, set(fit)
        for k in range(len(chain)):
            near = k if k in wanted else near
            upto.append(near)
        meets, place = [-1] * len(self.tags), {i: k for k, i in enumerate(chain)}
        for i in range(1, len(self.tags)):
            meets[i] = place.get(i, meets[self.up[i]])
        out = len(chain) - 1
        for text, links, at in self.blocks:
            # A block that meets the chain in a part of a table is added by the table.
            if len(text) > 2 * links and meets[at] >= 0 and upto[meets[at]] is not None:
                out = min(out, upto[meets[at]])
        return chain[out]

    def best(self) -> tuple[str | None, float]:
        """Path of the whole of the best container (the outermost among equals) and the best one's score."""
        scores = self.scores()
        if not scores:
            return None, 0.0
        at = min(scores, key=lambda i: (-scores[i], i))
        return self.path_of(self.path[self.whole(at)]), scores[at]

    def text(self, path: str | None) -> str:
        """The blocks below the containers with this path; all blocks where it is None.

        Beside a container's best part, blocks that are mostly links are left out, but not within ``article`` or ``main``.
        """
        if path is None:
            return "\n".join(b[0] for b in self.blocks)
        number, n = self.number_of(path), len(self.tags)
        if number is None:
            return ""
        top = [0] * n  # the outermost container with the path around each
        for i in range(1, n):
            top[i] = top[self.up[i]] or (i if self.path[i] == number and not self.inline[i] else 0)
        own = [b for b in self.blocks if top[b[2]]]
        if any(len(text) <= 2 * links for text, links, _ in own):
            scores, core = self.scores(), {}
            for j, score in sorted(scores.items()):
                i = top[j]
                if i and (i not in core or score > scores[core[i]]):
                    core[i] = j
            cores, kept = set(core.values()), [False] * n
            for i in range(1, n):
                kept[i] = kept[self.up[i]] or i in cores or self.tags[i] in ARTICLE
            own = [b for b in own if len(b[0]) > 2 * b[1] or kept[b[2]] or top[b[2]] not in core]
        return "\n".join(b[0] for b in own)

    def extracted(self, winners: list[str]) -> str:
        for path in winners:
            if out := self.text(path):
                return out
        return self.text(self.best()[0])


def votes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host``, ``path``, ``n`` (pages) and ``score`` of the best containers."""

    def run(batches):
        for batch in batches:
            hosts, paths, scores = [], [], []
            for host, html in zip(batch.column(0), batch.column(1), strict=True):
                path, score = Page(html.as_py()).best()
                if path is not None:
                    hosts.append(host.as_py())
                    paths.append(path)
                    scores.append(score)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.float64())], ["host", "path", "score"])

    # A url without a host is null to host_path's text functions and an empty host here.
    host = F.coalesce(host_path(F.col(url_col))[0], F.lit(""))
    return pages.select(host.alias("host"), F.col(html_col).alias("html")).mapInArrow(run, "host string, path string, score double").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score"))


def leading_paths(found: DataFrame, share: float = 0.05) -> DataFrame:
    """``host`` and ``winners``: its paths with at least ``share`` of its votes, so 1 / share at most, the most voted first."""
    totals = found.groupBy("host").agg(F.sum("n").alias("total"))
    kept = found.join(totals, "host").filter(F.col("n") >= share * F.col("total"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), (-F.col("score")).alias("score"), "path")))
    return kept.groupBy("host").agg(F.transform(order, lambda x: x["path"]).alias("winners"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row: id, url, ``text`` (blocks joined by line feeds) and ``n_chars``."""
    kind, url_kind = pages.schema[id_col].dataType.simpleString(), pages.schema[url_col].dataType.simpleString()
    scratch = Scratch(pages.sparkSession)
    found = scratch.table(votes(pages, url_col, html_col))
    # Written, so that its size is known: Spark broadcasts it where it is small, and else deals the pages below by host.
    winners = scratch.table(leading_paths(found))
    # At most 1 / HOT hosts have HOT of all votes or more, with 1 / share paths each.
    total = found.agg(F.sum("n")).first()[0] or 0
    large = found.groupBy("host").agg(F.sum("n").alias("n")).filter(F.col("n") >= HOT * total)
    hot = F.broadcast(scratch.table(winners.join(large, "host", "left_semi")))
    host = F.coalesce(host_path(F.col(url_col))[0], F.lit(""))
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))

    def run(batches):
        for batch in batches:
            texts = [Page(html.as_py()).extracted(own.as_py() or []) for html, own in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    def extracted(own: DataFrame) -> DataFrame:
        out = own.select("id", "url", "html", "winners").mapInArrow(run, f"id {kind}, url {url_kind}, text string, n_chars long")
        return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")

    here = base.join(hot, "host")
    rest = base.join(hot.select("host"), "host", "left_anti").join(winners, "host", "left")
    return extracted(here).unionByName(extracted(rest))
