"""Main text of HTML pages by composite text density.

A page becomes a tree. Every node has a density: its characters per tag, adjusted for links by a logarithm whose base
grows with the share of link characters in the node and in the whole page, so that lists of links weigh little. The
node whose children's densities have the largest sum is the main one. The least density on the way from the body to it
is the threshold: any other node that reaches it is searched for its own largest sum and adds that subtree, if the sum
is no less than a tenth of the first. What is found is read within the article or main element that holds it, or else
within the least common ancestor of the parts.

Before that, subtrees that say what they are go: menus, headers, footers, asides, forms, dialogs, scripts, hidden parts
by element, role or attribute; adverts, notices, sidebars, sharing bars and reader comments by words of class and id.
A class or id alone removes no node that holds an article, nor, on pages without one, more than half of the text unless
it names comments. Headings in the header of an article belong to the article.

A page is one row and its tree stays in one call; nothing is shuffled, and memory follows the longest page of a batch.

Defined cases: a null or empty page, or one without text outside such parts, has the empty text; unclosed and stray
tags, comments, quotes and character references are read as browsers do; depth is not limited; very long pages are read
whole; repeated rows and further columns stay; columns with the names of the result are replaced; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.token_counts import runs
from foliospark.llm.words import whole_text

_ATTRIBUTE = r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+"""
ATTRIBUTE = re.compile(_ATTRIBUTE)
TAG = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*+>?|(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|" + _ATTRIBUTE + r"|=)*+)>?)", re.S)
GAPS = re.compile(r"[\x20\x09-\x0D]+")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section summary"
    " table tbody td tfoot th thead title tr ul".split()
)
ENDS_PARAGRAPH = BLOCKS - set("body caption dd dt html legend li optgroup option tbody td tfoot th thead title tr".split()) | {"li", "dd", "dt"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style", "title", "textarea", "noscript", "iframe", "noembed", "noframes", "xmp", "template", "svg")}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset(["article", "main"])
#: start tags that end an open element of these names, up to the container that bounds them
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dd": (("dd", "dt"), ("dl",)),
    "dt": (("dd", "dt"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
    "body": (("head",), ("html",)),
}
DROPPED = frozenset("head nav header footer aside form button select input label datalist dialog menu object canvas audio video map search frameset".split()) | set(RAW)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs consent cookie cookies copyright footer"
    " gdpr header login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo"
    " promotion recommended related share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
COMMENTS = frozenset("comment comments disqus replies respond responses".split())
#: least density sum of a further part, as a share of the largest
LEAST_PART = 0.1
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Tree:
    """Nodes in page order; node 0 is the root. ``texts`` holds (node, text) in page order, ``-1`` as text ends a block."""

    def __init__(self, html: str):
        self.names, self.parents, self.marks = ["html"], [-1], [0]
        self.texts: list[tuple[int, str | None]] = []
        self.body = 0
        self._read(html)

    def _read(self, html: str) -> None:
        names, parents, texts, stack, open_names, at = self.names, self.parents, self.texts, [0], {"html": 1}, 0

        def close(depth: int) -> None:
            for node in stack[depth:]:
                open_names[names[node]] -= 1
                if names[node] in BLOCKS:
                    texts.append((node, None))
            del stack[depth:]

        def find(targets: tuple[str, ...], bounds: frozenset | tuple) -> int:
            if not any(open_names.get(t) for t in targets):
                return 0
            for depth in range(len(stack) - 1, 0, -1):
                name = names[stack[depth]]
                if name in targets:
                    return depth
                if name in bounds:
                    break
            return 0

        end = len(html)
        while at < end:
            tag = TAG.search(html, at)
            text = html[at : tag.start() if tag else end]
            if text:
                texts.append((stack[-1], unescape(text) if "&" in text else text))
            if not tag:
                break
            at = tag.end()
            if tag[2] is None:
                continue
            name = tag[2].lower()
            if tag[1]:
                if name not in ("html", "body") and open_names.get(name):
                    # an inline element cannot end a block that began inside it
                    depth = find((name,), () if name in BLOCKS else BLOCKS)
                    if depth:
                        close(depth)
                continue
            if name == "html" or (name == "body" and self.body):
                continue
            if name in ENDS_PARAGRAPH:
                depth = find(("p",), ("button", "td", "th", "table", "object", "caption"))
                if depth:
                    close(depth)
            if name in CLOSES:
                depth = find(*CLOSES[name])
                if depth:
                    close(depth)
            elif name in HEADINGS and names[stack[-1]] in HEADINGS:
                close(len(stack) - 1)
            if name == "br":
                texts.append((stack[-1], " "))
                self._add(name, stack[-1], "")
                continue
            node = self._add(name, stack[-1], tag[3])
            if name == "body":
                self.body = node
            if name in BLOCKS:
                texts.append((node, None))
            if name in RAW:
                after = RAW[name].search(html, at)
                at = after.start() if after else end
                stop = html.find(">", at)
                at = end if stop < 0 else stop + 1
            elif name not in VOID:
                stack.append(node)
                open_names[name] = open_names.get(name, 0) + 1

    def _add(self, name: str, parent: int, attributes: str) -> int:
        self.names.append(name)
        self.parents.append(parent)
        self.marks.append(self._mark(name, parent, attributes))
        return len(self.names) - 1

    def _mark(self, name: str, parent: int, attributes: str) -> int:
        """1: removed, 2: removed as comments by name, 3: removed by name if no large part; 0: stays."""
        if name in DROPPED:
            return 1
        if not attributes or name in ("html", "body"):
            return 0
        said = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
        if said.get("role", "").lower() in ROLES or "hidden" in said or said.get("aria-hidden") == "true" or HIDDEN.search(said.get("style", "")):
            return 1
        words = {w.lower() for key in ("class", "id") for w in WORDS.findall(said.get(key, ""))}
        if words & COMMENTS:
            return 2
        return 3 if words & NAMES and name not in MAIN else 0

    def removed(self) -> list[bool]:
        """Per node whether it belongs to a part that is no text of the page's own."""
        names, parents, marks, n = self.names, self.parents, self.marks, len(self.names)
        chars = [0] * n
        holds = [name in MAIN and marks[i] == 0 for i, name in enumerate(names)]
        out = [mark == 1 for mark in marks]
        inside = [False] * n
        for i in range(1, n):
            p = parents[i]
            inside[i] = inside[p] or names[i] in MAIN
            if names[i] in HEADINGS and out[p] and names[p] == "header" and inside[p]:
                out[i] = False
            else:
                out[i] = out[i] or out[p]
        for node, text in self.texts:
            if text and not out[node]:
                chars[node] += len(text)
        for i in range(n - 1, 0, -1):
            chars[parents[i]] += chars[i]
            holds[parents[i]] = holds[parents[i]] or holds[i]
        for i in range(1, n):
            if out[parents[i]] and not out[i] and names[i] not in HEADINGS:
                out[i] = True
            elif marks[i] == 2 and not holds[i]:
                out[i] = True
            elif marks[i] == 3 and not holds[i] and (holds[0] or 2 * chars[i] <= chars[0]):
                out[i] = True
        return out

    def densities(self, out: list[bool]) -> list[float]:
        """Composite text density of every node that stays."""
        names, parents, n = self.names, self.parents, len(self.names)
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        linked = [False] * n
        for i in range(1, n):
            linked[i] = linked[parents[i]] or names[i] == "a"
        all_chars = all_links = 0
        for node, text in self.texts:
            if text:
                size = len(text)
                all_chars += size
                all_links += size if linked[node] else 0
                if not out[node]:
                    chars[node] += size
                    link_chars[node] += size if linked[node] else 0
        for i in range(n - 1, 0, -1):
            p = parents[i]
            if not out[i]:
                tags[p] += tags[i] + 1
                link_tags[p] += link_tags[i] + (names[i] == "a")
                chars[p] += chars[i]
                link_chars[p] += link_chars[i]
        share = all_links / max(all_chars, 1)
        density = [0.0] * n
        for i in range(n):
            c, links = chars[i], link_chars[i]
            if c:
                base = math.log(c / max(c - links, 1) * links + share * c + math.e)
                # a page almost without links would take its logarithms to a base near 1
                adjusted = math.log(max(c / max(links, 1) * max(tags[i], 1) / max(link_tags[i], 1), 1.0)) / max(math.log(base), 1.0)
                density[i] = c / max(tags[i], 1) * adjusted
        return density

    def kept(self) -> list[bool]:
        """Per node whether its own text belongs to the main text."""
        names, parents, n, out = self.names, self.parents, len(self.names), self.removed()
        density = self.densities(out)
        total, children = [0.0] * n, [0] * n
        for i in range(1, n):
            if not out[i] and density[i] > 0:
                total[parents[i]] += density[i]
                children[parents[i]] += 1
        for i in range(n):
            if not children[i]:
                total[i] = density[i]
        # the node of the largest sum in every subtree, of equals the outermost
        best = list(range(n))
        for i in range(n - 1, 0, -1):
            p = parents[i]
            if not out[i] and (total[best[i]], -best[i]) > (total[best[p]], -best[p]):
                best[p] = best[i]
        top = best[self.body]
        if not density[top]:
            return [False] * n
        threshold, node = density[top], top
        while node > self.body:
            node = parents[node]
            threshold = min(threshold, density[node])
        chosen = [False] * n
        for i in range(self.body, n):
            if not out[i] and density[i] >= threshold > 0 and total[best[i]] >= LEAST_PART * total[top]:
                chosen[best[i]] = True
        chosen[top] = True
        wide = [self._article(i) for i in range(n) if chosen[i]]
        roots = set(wide) if any(names[i] in MAIN for i in wide) else {self._ancestor(wide)}
        if roots == {self.body} or roots == {0}:
            roots = set(wide) | self._headings(wide, out)
        if any(names[i] in MAIN for i in roots):
            roots = {i for i in roots if names[i] in MAIN}
        keep = [False] * n
        for i in range(n):
            keep[i] = not out[i] and (i in roots or (i > 0 and keep[parents[i]]) or (i > 0 and out[parents[i]] and self._inside(i, roots)))
        return keep

    def _article(self, node: int) -> int:
        """The outermost article, or else main element, that holds a node; the node itself if there is none."""
        found, at = node, node
        for name in ("main", "article"):
            at = node
            while at > 0:
                found = at if self.names[at] == name else found
                at = self.parents[at]
        return found

    def _ancestor(self, nodes: list[int]) -> int:
        nodes = set(nodes)
        while len(nodes) > 1:
            last = max(nodes)
            nodes.remove(last)
            nodes.add(self.parents[last])
        return nodes.pop()

    def _headings(self, nodes: list[int], out: list[bool]) -> set[int]:
        """Headings outside removed parts that stand from the page's first h1 to the last chosen part."""
        firsts = [i for i, name in enumerate(self.names) if name == "h1" and not out[i]]
        low = min([min(nodes), *firsts[:1]])
        return {i for i in range(low, max(nodes)) if self.names[i] in HEADINGS and not out[i]}

    def _inside(self, node: int, roots: set[int]) -> bool:
        while node > 0:
            node = self.parents[node]
            if node in roots:
                return True
        return False

    def text(self) -> str:
        keep, blocks, run = self.kept(), [], []

        def flush() -> None:
            line = GAPS.sub(" ", "".join(run)).strip(" ")
            if line:
                blocks.append(line)
            run.clear()

        for node, text in self.texts:
            if text is None:
                flush()
            elif keep[node]:
                run.append(text)
        flush()
        return "\n".join(blocks)


def main_text(html: str | None) -> str:
    return Tree(html).text() if html else ""


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``text`` and ``n_chars``; the page source leaves the rows."""
    made = {"text", "n_chars"}
    pages = pages.select(F.col(html).alias("_html"), *[F.col(c) for c in pages.columns if c.lower() not in made | {html.lower()}])

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x) for run in runs(batch.tolist()) for x in run], dtype=object)

    rest = [c for c in pages.columns if c != "_html"]
    read = pages.select(*rest, texts(whole_text("_html")).alias("text"))
    return read.withColumn("n_chars", F.length("text").cast("long"))
