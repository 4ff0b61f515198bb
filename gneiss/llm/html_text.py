"""Main text of web pages: the best-scoring run of words and tags.

A page is a sequence of blocks of words and of tags.  Each word of a block has a score and each tag one by its name:
log odds of standing inside the article, learned from those pages that mark theirs.  A block's words are judged by the
element they stand in, by how many they are, by the share of links among them, and by the class and id names
of all elements round them.  Words of plain content score above zero and tags below.  One linear scan finds the run
with the largest sum, and the run is the main text; what nothing marks, such as an unnamed line of links before
the article, is left out by the scan alone.

Some elements are no article text wherever they stand: scripts, styles, menus, footers, asides, forms, hidden ones, and those whose
class or id is a customary name of such a part (``sidebar``, ``comment-list``; every part of the name has to be one, so
``has-sidebar`` or ``menu-open`` are mere evidence).  They are skipped inside the run, and cost it a little for each word.  An element that
holds the page's article, or most of its words where none is marked, is a wrapper, and its name says nothing.

Labels: pages with an ``article`` or ``main`` element say themselves where the article is.  The weights are fitted
on the ``fit_pages`` such pages with the smallest hash, all others use the same weights; features that those pages
show too seldom have fixed weights.

Cases: null html is empty and has no text; pages without any word have none; unclosed, stray and nested tags
are accepted as browsers do for blocks; very long pages take one linear pass, however deep their tags are and
however many of them are stray; ties go to the run that starts first and ends first; repeated rows have the same
text; an empty table gives an empty table; only the named columns are read, so others may clash.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.llm.work import tidied

FIT_PAGES = 2000
_OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>")
#: Tags with unbalanced quotes that are tried to the page's end; after as many, a tag ends at the next ``>``.
_PATIENCE = 8
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_TELLING = re.compile(r"class|id|hidden|role|style|itemprop", re.I)
_RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "noframes", "xmp", "title"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
#: Elements that hold no article text wherever they stand; of those in ``_MAY_WRAP`` only such as are no wrapper.
_OUTSIDE = {"nav", "aside", "footer", "button", "select", "option", "input", "menu", "dialog", "svg", "canvas", "object", "embed", "audio", "video", "map", "head", "datalist", "math"} | _RAW
_MAY_WRAP = {"form", "fieldset", "header"}
#: Customary names of what is no article text, and words that go with them in a name.
_NAMES = set("ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar header masthead topbar footer copyright cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus respond replies sharing social related recommended recommendations widget widgets toolbar pagination pager search".split())
_WITH = set("area bar block body bottom box container content first global google holder inner item items last left links list main outer page panel posts primary right secondary section site slot thread top unit wrap wrapper zone".split())
_ROLES = set("navigation banner contentinfo complementary search dialog alert menu menubar form alertdialog toolbar".split())
#: Words of elements that are left out cost the run so much each, outside and inside of a marked article.
_SKIPPED = (-0.1, 0.0)
#: Weights of features that the fitted pages show too seldom.
_PRIOR = {"in p": 2.0, "in h1": 1.0, "in h2": 1.0, "in h3": 1.0, "in blockquote": 1.5, "in pre": 1.0, "in li": 0.3, "in": 0.7, "links": -2.0, "words 1": -0.3, "words 2": 0.0, "words 3": 0.5}
_HINT = -0.5
#: Names of the elements round a block that the weights are learned from.
_NEAR = 32
#: Elements of prose, by which wrappers are told.
_PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "body"}
_SEEN = 50


def _customary(name: str) -> bool:
    parts = re.split(r"[-_]+", name)
    return any(x in _NAMES for x in parts) and all(x in _NAMES or x in _WITH or x.isdigit() for x in parts)


class Element:
    """An open or closed element: its names, and what it holds."""

    __slots__ = ("article", "hidden", "holds_article", "holds_title", "inside", "linked", "name", "names", "near", "parent", "prose", "role", "skip", "weight")

    def __init__(self, name: str, parent: Element | None, attributes: str):
        self.name, self.parent, self.prose, self.skip, self.weight = name, parent, 0, False, 0.0
        self.holds_article, self.holds_title = False, name == "h1"
        self.linked = name == "a" or (name in _INLINE and parent is not None and parent.linked)
        self.names, self.hidden, self.role, self.article = (), False, False, name in ("article", "main")
        for key, value in _ATTRIBUTE.findall(attributes) if _TELLING.search(attributes) else ():
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id"):
                self.names += tuple(value.split())
            elif key == "hidden" or (key == "aria-hidden" and value == "true"):
                self.hidden = True
            elif key == "role":
                self.role = value in _ROLES
                self.article = self.article or value in ("main", "article")
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                self.hidden = True
            elif key == "itemprop" and "articlebody" in value.split():
                self.article = True
        self.inside = parent is not None and (parent.inside or parent.article)
        self.near = () if parent is None else parent.near + self.names if len(parent.near) + len(self.names) <= _NEAR else (parent.near + self.names)[-_NEAR:]


class Page:
    """Tokens of a page in order: (tag's name, element) or (None, block), where a block is [element, text pieces, words]."""

    def __init__(self, source: str):
        self.tokens: list[tuple] = []
        self.elements: list[Element] = []
        self.block: list | None = None
        self._parse(source)
        self._judge()

    def _parse(self, source: str) -> None:
        root = Element("body", None, "")
        self.elements.append(root)
        # Elements that are open, and for each the place of the innermost that is not inline.
        stack, blocks = [root], [0]
        still = Counter()
        at, n, patience = 0, len(source), _PATIENCE
        while at < n:
            found = _OPEN.search(source, at)
            stop = found.start() if found else n
            if stop > at:
                self._text(source[at:stop], stack, blocks)
            if not found:
                break
            kind = found[0]
            if kind in ("<!--", "<![CDATA["):
                end = source.find("-->" if kind == "<!--" else "]]>", found.end())
                at = n if end < 0 else end + 3
                continue
            named = _NAME.match(source, stop)
            whole = _REST.match(source, named.end() if named else found.end()) if patience else None
            if whole is None:
                patience -= bool(patience)
                end = source.find(">", found.end())
                at = n if end < 0 else end + 1
            else:
                at = whole.end()
            if not named:
                continue
            name, attributes = named[2].lower(), source[named.end() : at].removesuffix(">")
            if named[1]:
                if still[name]:
                    i = len(stack) - 1
                    while stack[i].name != name:
                        i -= 1
                    self._tag(name, stack[i])
                    self._close(stack, blocks, still, i)
                else:
                    self._tag(name, stack[-1])
                continue
            for _ in iter(lambda name=name: name in _ENDS and blocks[-1] and stack[blocks[-1]].name in _ENDS[name], False):
                self._close(stack, blocks, still, blocks[-1])
            element = Element(name, stack[-1], attributes)
            self.elements.append(element)
            self._tag(name, element)
            if name in _RAW:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(source, at)
                at = end.end() if end else n
                continue
            if name in _VOID or attributes.endswith("/") and name in ("svg", "path", "use"):
                continue
            stack.append(element)
            blocks.append(blocks[-1] if name in _INLINE else len(stack) - 1)
            still[name] += 1
            if element.article:
                up = element.parent
                while up is not None and not up.holds_article:
                    up.holds_article = True
                    up = up.parent

    @staticmethod
    def _close(stack: list, blocks: list, still: Counter, i: int) -> None:
        for x in stack[i:]:
            still[x.name] -= 1
        del stack[i:], blocks[i:]

    def _text(self, text: str, stack: list, blocks: list) -> None:
        top, home = stack[-1], stack[blocks[-1]]
        if self.block is None:
            self.block = [home, [], 0]
            self.tokens.append((None, self.block))
        text = html.unescape(text)
        n = len(text.split())
        self.block[1].append((text, n, top.linked, top))
        self.block[2] += n
        if home.name in _PROSE:
            home.prose += n

    def _tag(self, name: str, element: Element) -> None:
        if name not in _INLINE:
            self.block = None
        self.tokens.append((name, element))

    def _judge(self) -> None:
        """Which elements are left out: those named or made so, but no wrapper."""
        for x in reversed(self.elements):
            if x.parent is not None:
                x.parent.prose += x.prose
                x.parent.holds_title |= x.holds_title
        root = self.elements[0]
        marked, titled = root.holds_article, root.holds_title
        for x in self.elements:
            if x.parent is None:
                continue
            wrapper = x.holds_article or x.article or x.name in ("html", "body") or (not marked and x.holds_title >= titled and x.prose * 2 > root.prose)
            out = x.name in _OUTSIDE or x.hidden or (not wrapper and (x.role or any(map(_customary, x.names)) or (x.name in _MAY_WRAP and not (x.name == "header" and x.inside))))
            x.skip = x.parent.skip or out
            if wrapper and not x.skip:
                x.names = ()

    def features(self, block: list) -> list[str]:
        home, pieces, n = block
        linked = sum(p[1] for p in pieces if p[2])
        found = [f"in {home.name}", f"words {1 if n < 5 else 2 if n < 20 else 3}"]
        if 2 * linked > n:
            found.append("links")
        return found + [f"name {x}" for x in set(home.near)]

    def main(self, weights: dict[str, float]) -> str:
        """Text of the best run."""
        self._weigh(weights)
        best, begin, end, total, start = 0.0, 0, 0, 0.0, 0
        for i, (name, x) in enumerate(self.tokens):
            if name is not None:
                score = 0.0 if x.skip and x.inside else weights.get("tag " + name, weights["tag"])
            else:
                score = self._score(x, weights)
            if total <= 0:
                total, start = 0.0, i
            total += score
            if total > best:
                best, begin, end = total, start, i + 1
        parts = []
        for name, x in self.tokens[begin:end]:
            if name is None:
                parts.extend(text for text, _, _, element in x[1] if not element.skip)
            elif name not in _INLINE:
                parts.append(" ")
        return " ".join("".join(parts).split())

    def _weigh(self, weights: dict[str, float]) -> None:
        """What the names of an element and of those round it say, each element's share clipped."""
        for x in self.elements:
            own = sum(weights.get("name " + n, _HINT if any(p in _NAMES for p in re.split(r"[-_]+", n)) else 0.0) for n in set(x.names))
            x.weight = max(-3.0, min(3.0, (x.parent.weight if x.parent is not None else 0.0) + max(-2.0, min(2.0, own))))

    def _score(self, block: list, weights: dict[str, float]) -> float:
        home, pieces, n = block
        if home.skip:
            return n * _SKIPPED[home.inside]
        kept = sum(k for _, k, _, element in pieces if not element.skip)
        linked = sum(k for _, k, a, element in pieces if a and not element.skip)
        each = weights.get(f"in {home.name}", _PRIOR.get(f"in {home.name}", _PRIOR["in"])) + weights.get(f"words {1 if kept < 5 else 2 if kept < 20 else 3}", 0.0) + home.weight
        if 2 * linked > kept:
            each += weights.get("links", _PRIOR["links"])
        if home.inside or home.article:
            each = max(each, 0.0) + 1.0
        return kept * max(-3.0, min(3.0, each))


def count(source: str, into: Counter) -> None:
    """Adds the words and tags inside and outside of a page's marked article."""
    page = Page(source)
    if not any(name is None and x[0].inside | x[0].article and not x[0].skip and x[2] for name, x in page.tokens):
        return
    for name, x in page.tokens:
        home = x[0] if name is None else x
        side = "1" if (home.inside or home.article) and not home.skip else "0"
        if name is not None:
            into[f"{side}tag {name}"] += 1
        elif x[2]:
            into[side] += x[2]
            for f in page.features(x):
                into[side + f] += x[2]


def fitted(counts: dict[str, int]) -> dict[str, float]:
    """Log odds, at most 4 up or down; tags cost between 0.01 and 1 each, 0.1 where nothing is known."""
    out = {k: v for k, v in _PRIOR.items() if not k.startswith("in")} | {"tag": -0.1}
    inside, outside = counts.get("1", 0) + 1, counts.get("0", 0) + 1
    tags = [sum(n for k, n in counts.items() if k.startswith(side + "tag ")) + 1 for side in "10"]
    for k in {k[1:] for k in counts if len(k) > 1}:
        a, b = counts.get("1" + k, 0), counts.get("0" + k, 0)
        if k.startswith("tag "):
            odds = math.log((a + 0.5) / tags[0]) - math.log((b + 0.5) / tags[1])
            out[k] = max(-1.0, min(-0.01, -0.1 + 0.05 * odds))
        elif a + b >= _SEEN:
            odds = math.log((a + 0.5) / inside) - math.log((b + 0.5) / outside)
            # How long a block is goes with what it stands in, so few words are little evidence beside that.
            out[k] = max(-0.6 if k.startswith("words") else -4.0, min(4.0, odds))
    return out


def fit(pages: DataFrame, *, html_col: str = "html", fit_pages: int = FIT_PAGES) -> dict[str, float]:
    """Weights from the ``fit_pages`` pages with a marked article that have the smallest hash of their html."""
    marked = pages.select(F.col(html_col).alias("html"), F.xxhash64(html_col).alias("h")).where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    # Hashes alone are sorted; the pages themselves stay where they are.
    last = marked.select("h").orderBy("h").limit(fit_pages).agg(F.max("h")).first()[0]
    some = marked.where(F.col("h") <= F.lit(last)).select("html") if last is not None else marked.select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into: Counter = Counter()
        for batch in batches:
            for source in batch.column("html").to_pylist():
                count(source, into)
        if into:
            yield pa.RecordBatch.from_arrays([pa.array(list(into)), pa.array(list(into.values()), pa.int64())], names=["name", "n"])

    rows = some.mapInArrow(tidied(run), "name string, n long").groupBy("name").agg(F.sum("n").alias("n")).orderBy(F.desc("n")).limit(10_000).collect()
    return fitted({r["name"]: r["n"] for r in rows})


def extracted(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", weights: dict[str, float] | None = None, fit_pages: int = FIT_PAGES) -> DataFrame:
    """One row for each page: ``id_col``, ``url`` where there is one, and its main ``text``."""
    learned = fit(pages, html_col=html_col, fit_pages=fit_pages) if weights is None else weights
    keep = [id_col, *(["url"] if "url" in pages.columns else [])]
    base = pages.select(*keep, F.col(html_col).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(x).main(learned) if x else "" for x in batch.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    return base.mapInArrow(tidied(run), T.StructType([*(base.schema[c] for c in keep), T.StructField("text", T.StringType())]))
