"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element is a binary variable, content or not.  Parent-child potentials tie each element to its parent, by its tag
and what its class and id say, and node potentials score these words, those of the elements around it, and the length, link share and punctuation of its text.
Sum-product messages go upward and then downward, which gives the exact marginal of every element; text of elements with a
marginal of one half or more is the main text.

The potentials are counted on labelled pages: a sample of at most TRAIN_PAGES pages, those whose mark-up names its article
(``article`` or ``main``), where the label of an element follows from the elements around it.  Each such page is counted
twice, the second time with the names of sectioning elements and their classes blanked, so that the model also learns to
tell content by its text alone.

Defined results: a null page is an empty one, with empty text; a page without text likewise; where no page is labelled,
nothing is content; very long pages are used whole; unclosed, stray and nested tags are mended as browsers mostly do;
repeated rows are treated row by row; an empty table gives an empty result; other columns do not take part.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 2000
#: Pages that may hold an element which names the article.
LABELLED = r"(?i)<(article|main)[\s/>]"

# Fixed values of HTML: elements without content, elements whose content is raw text, and elements that start a new block.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul head title option select button template noscript".split()
)
#: A start tag of the key's list ends an open element of the key.
ENDED_BY = {"p": BLOCK - {"td", "th", "tr", "option", "button", "head", "title"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: An end tag does not close elements beyond these.
BARRIER = {"td", "th", "table", "body", "html"}
SECTIONS = {"article", "main", "nav", "header", "footer", "aside", "section"}
#: Never content, whatever surrounds them.
SILENT = {"script", "style", "head", "title", "template", "noscript", "iframe", "button", "select", "option", "textarea", "input", "svg", "object", "noembed", "noframes"}
OUTSIDE_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog"} | SILENT
OUTSIDE_WORDS = set(
    "ad ads advert advertisement advertising banner sponsor sponsored promo promotion nav navigation navbar menu breadcrumb breadcrumbs sidebar side footer header masthead toolbar "
    "comment comments commentlist reply replies respond disqus discussion share sharing social related recommended popular newsletter subscribe signup login cookie cookies consent gdpr notice alert "
    "popup modal overlay widget form search pagination pager hidden tags copyright legal disclaimer".split()
)
INSIDE_WORDS = set("article content post entry story text main maintext body hentry".split())

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
SPECIAL = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none", re.I)
WORD = re.compile(r"[a-z]+")
PUNCTUATION = re.compile(r"[.,;:!?]")


class tokens:
    """The mark-up of a page, one call a token.  No place is looked at twice for the same reason, so hostile pages stay linear."""

    def __init__(self, html: str):
        self.html, self.failed = html, set()
        self.last = {c: html.rfind(c) for c in ">\"'"}

    def _end(self, at: int) -> int:
        """Place after the ``>`` that ends a tag, outside quotes; -1 if there is none."""
        passed = []
        while at <= max(self.last.values()):
            at = SPECIAL.search(self.html, at).start()
            if at in self.failed:
                break
            if self.html[at] == ">":
                return at + 1
            passed.append(at)
            if at >= self.last[self.html[at]]:
                break
            at = self.html.index(self.html[at], at + 1) + 1
        self.failed.update(passed)
        return -1

    def __call__(self, at: int) -> tuple[int, int, re.Match | None]:
        """The next token from ``at`` on: its start and end and, of a tag, its name; start -1 if there is none."""
        html = self.html
        while (start := html.find("<", at)) >= 0:
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(html), None
            if html.startswith(("<!", "<?"), start):
                if start < self.last[">"]:
                    return start, html.index(">", start) + 1, None
            elif (name := NAME.match(html, start + 1)) and (end := self._end(name.end())) >= 0:
                return start, end, name
            at = start + 1
        return -1, len(html), None


class opened:
    """The open elements, with the places of those that a search looks for."""

    def __init__(self):
        self.nodes, self.tags, self.at, self.blocks, self.barriers = [0], ["#"], {}, [], []

    def push(self, node: int, tag: str) -> None:
        place = len(self.nodes)
        self.nodes.append(node)
        self.tags.append(tag)
        self.at.setdefault(tag, []).append(place)
        if tag in BLOCK:
            self.blocks.append(place)
        if tag in BARRIER:
            self.barriers.append(place)

    def close(self, place: int) -> None:
        while len(self.nodes) > place:
            self.nodes.pop()
            self.at[self.tags.pop()].pop()
        for places in (self.blocks, self.barriers):
            while places and places[-1] >= place:
                places.pop()

    def end(self, tag: str) -> None:
        """An end tag closes the innermost element of its name, not beyond a barrier."""
        own = self.at.get(tag)
        free = tag in BARRIER or tag in ("tr", "tbody", "thead", "tfoot")
        if own and (free or not self.barriers or own[-1] >= self.barriers[-1]):
            self.close(own[-1])

    def start(self, tag: str) -> None:
        """A start tag ends what can't hold it; inline elements and paragraphs in between don't matter."""
        for place in reversed(self.blocks):
            if tag in ENDED_BY.get(self.tags[place], ()):
                return self.close(place)
            if self.tags[place] != "p":
                return None


class Page:
    """Elements in document order (parent before child) and pieces of text (element, block, text)."""

    def __init__(self, html: str):
        self.tags, self.parents, self.words = ["#"], [-1], [frozenset()]
        self.pieces: list[tuple[int, int, str]] = []
        stack, token, block, at = opened(), tokens(html), 0, 0
        while at < len(html):
            start, after, name = token(at)
            if start < 0:
                self._text(stack.nodes[-1], block, html[at:])
                break
            if start > at:
                self._text(stack.nodes[-1], block, html[at:start])
            at = after
            if name is None:
                continue
            tag, attributes = name[2].lower(), html[name.end() : after - 1]
            block += tag in BLOCK
            if name[1]:
                stack.end(tag)
                continue
            stack.start(tag)
            if tag == "br":
                self.pieces.append((stack.nodes[-1], block, " "))
            node = len(self.tags)
            self.tags.append(tag)
            self.parents.append(stack.nodes[-1])
            self.words.append(self._words(attributes) if attributes else frozenset())
            if tag in RAW:
                end = re.compile(f"</{tag}\\s*>", re.I).search(html, at)
                if tag == "textarea" or tag == "title":
                    self._text(node, block, html[at : end.start() if end else len(html)])
                at = end.end() if end else len(html)
                block += tag in BLOCK
            elif tag not in VOID and not attributes.rstrip().endswith("/") or tag in BLOCK and tag not in VOID:
                stack.push(node, tag)

    def _text(self, node: int, block: int, raw: str) -> None:
        self.pieces.append((node, block, unescape(raw) if "&" in raw else raw))

    @staticmethod
    def _words(attributes: str) -> frozenset:
        found = [w for m in ATTRIBUTE.finditer(attributes) for w in WORD.findall((m[2] or m[3] or m[4] or "").lower())]
        if HIDDEN.search(attributes):
            found.append("hidden")
        return frozenset(found)

    def labels(self) -> list[int]:
        """1: inside the named article and outside everything that is not part of it."""
        out, state = [0] * len(self.tags), [0] * len(self.tags)  # state: 0 outside, 1 article, 2 taken out
        for k in range(1, len(self.tags)):
            above = state[self.parents[k]]
            if above == 2 or self.tags[k] in OUTSIDE_TAGS or self.words[k] & OUTSIDE_WORDS and self.tags[k] not in ("article", "main"):
                state[k] = 2
            else:
                state[k] = 1 if above == 1 or self.tags[k] in ("article", "main") else 0
            out[k] = int(state[k] == 1)
        return out

    def features(self, blank: bool) -> list[tuple]:
        """Discrete features of every element; ``blank`` hides the names of sections."""
        n = len(self.tags)
        own, chars, linked, marks = [0] * n, [0] * n, [0] * n, [0] * n
        for node, _, text in self.pieces:
            size = len(text.strip())
            own[node] += size
            chars[node] += size
            marks[node] += len(PUNCTUATION.findall(text))
        for k in range(n - 1, 0, -1):
            p = self.parents[k]
            chars[p] += chars[k]
            marks[p] += marks[k]
            linked[p] += chars[k] if self.tags[k] == "a" else linked[k]
        out, hints = [], ["none"] * n
        for k in range(n):
            tag, words = self.tags[k], self.words[k]
            hint = "out" if words & OUTSIDE_WORDS else "in" if words & INSIDE_WORDS else "none"
            if blank and tag in SECTIONS:
                tag, hint = "div", "none"
            if not chars[k]:
                text = ("empty",)
            else:
                text = (min(chars[k].bit_length(), 11), min(int(4 * linked[k] / chars[k]), 3), min(int(60 * marks[k] / chars[k]), 3))
            above = hints[self.parents[k]] if k else "none"
            hints[k] = "out" if "out" in (hint, above) else hint if hint == "in" else above
            out.append((("tag", tag), ("hint", hint), ("above", above), ("text", *text), ("own", min(own[k].bit_length(), 9))))
        return out


def _kind(feature: tuple) -> str:
    """What the pair potential of an element with its parent depends on: its tag, and what its class and id say."""
    return f"{feature[0][1]} {feature[1][1]}"


def _count(batches):
    """Counts of parent-child pairs and of features by label, over the labelled pages of a task."""
    total: Counter = Counter()
    for b in batches:
        for html in b.column(0).to_pylist():
            page = Page(html)
            labels = page.labels()
            if 1 not in labels:
                continue
            for blank in (False, True):
                for k, found in enumerate(page.features(blank)):
                    if k:
                        total["pair", _kind(found), str(labels[page.parents[k]]), labels[k]] += 1
                    for name, *value in found:
                        total["node", name, repr(tuple(value)), labels[k]] += 1
    keys = list(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.string()), pa.array([k[3] for k in keys], pa.int32()), pa.array([total[k] for k in keys], pa.int64())],
        ["part", "name", "value", "label", "n"],
    )


class Model:
    """Log potentials.  Names of tags that no labelled page has fall back to even potentials."""

    def __init__(self, rows):
        pair, node, whole = Counter(), Counter(), Counter()
        for part, name, value, label, n in rows:
            if part == "pair":
                pair[name, int(value), label] += n
                pair[None, int(value), label] += n
            else:
                node[name, value, label] += n
                whole[name, label] += n
        self.trained = bool(whole)
        self.pair = {}
        for name in {k[0] for k in pair}:
            table = []
            for above in (0, 1):
                base = [pair[None, above, y] + 1 for y in (0, 1)]
                mass = [pair[name, above, y] + 2 * base[y] / sum(base) for y in (0, 1)]
                table.append([math.log(m / sum(mass)) for m in mass])
            self.pair[name] = table
        kinds = Counter(k[0] for k in {(n, v) for n, v, _ in node})
        self.node = {(n, v): [math.log((node[n, v, y] + 0.5) / (whole[n, y] + 0.5 * (kinds[n] + 1))) for y in (0, 1)] for n, v, _ in node}

    def marginals(self, page: Page) -> list[float]:
        """Probability of content of every element by sum-product."""
        n = len(page.tags)
        features = page.features(False)
        even = [0.0, 0.0]
        local = []
        for k, found in enumerate(features):
            a = b = 0.0
            for name, *value in found:
                x = self.node.get((name, repr(tuple(value))), even)
                a += x[0]
                b += x[1]
            local.append([a, b])
        local[0] = [0.0, -50.0]
        for k in range(1, n):
            if page.tags[k] in SILENT:
                local[k] = [0.0, -50.0]
        default = self.pair.get(None, [even, even])
        pairs = [self.pair.get(_kind(f), default) for f in features]
        gather, up = [x[:] for x in local], [even] * n
        for k in range(n - 1, 0, -1):
            g, t = gather[k], pairs[k]
            message = [_add(t[y][0] + g[0], t[y][1] + g[1]) for y in (0, 1)]
            up[k] = message
            above = gather[page.parents[k]]
            above[0] += message[0]
            above[1] += message[1]
        belief = [gather[0]] + [even] * (n - 1)
        for k in range(1, n):
            p, t = page.parents[k], pairs[k]
            rest = [belief[p][y] - up[k][y] for y in (0, 1)]
            belief[k] = [gather[k][y] + _add(t[0][y] + rest[0], t[1][y] + rest[1]) for y in (0, 1)]
        return [1 / (1 + math.exp(max(-700, min(700, b[0] - b[1])))) for b in belief]


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def extract(html: str, model: Model) -> str:
    page = Page(html)
    if not model.trained:
        return ""
    share = model.marginals(page)
    blocks: dict[int, list[str]] = {}
    for node, block, text in page.pieces:
        if share[node] >= 0.5:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
    return "\n".join(x for x in lines if x)


def train(pages: DataFrame, html: str = "html", most: int = TRAIN_PAGES) -> Model:
    """Potentials from the labelled pages, each distinct one once: the ``most`` of them with the smallest hashes, where there are more."""
    labelled = pages.where(F.col(html).rlike(LABELLED)).select(F.col(html).alias("html"), F.xxhash64(html).alias("h"))
    last = labelled.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    sample = labelled.where(F.col("h") <= F.lit(last).cast("long")).groupBy("h").agg(F.min("html").alias("html")).select("html")
    counted = sample.mapInArrow(_count, "part string, name string, value string, label int, n long").groupBy("part", "name", "value", "label").agg(F.sum("n").alias("n"))
    return Model([tuple(r) for r in counted.collect()])


def main_text(pages: DataFrame, model: Model, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: page_id, url, text."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([extract(x or "", model) for x in b.column(2).to_pylist()], pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(run, "page_id long, url string, text string")
