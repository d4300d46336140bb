"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded top-down without contradictions.

A page becomes a tree of its block elements with their text blocks. Each element has features of its subtree (text and link
density, punctuation, share of the page), its attribute tokens, depth, siblings and ancestors. Boosted trees give the log-odds
that an element holds main text. A dynamic programme over the tree then labels each element `main`, `other` or `mixed`: main and
other hold for the whole subtree, so no descendant can contradict an ancestor; a mixed element leaves the choice to its
children and its own text blocks. The labelling with the highest sum of log-odds wins.

The trees are trained once per process on pages made by a seeded generator (`training_page`), which labels its own text;
nothing is learned from the pages that are extracted.

Defined edge cases: null and empty pages, and pages without main text, give the empty text; markup that is never closed or
closed twice is repaired as browsers do for block elements; a page of any length is read whole; repeated rows get equal rows; an
empty table gives an empty result; extra columns pass by.
"""

from __future__ import annotations

import functools
import html
import random
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Kinds of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title iframe object svg math canvas audio video select textarea button option datalist".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output progress q ruby rb rp rt s samp "
    "small span strike strong sub sup time tt u var wbr input".split()
)
CLOSES = {  # a start tag that ends an open element of these, up to the nearest element of the third set
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table", "tbody", "thead", "tfoot"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
}
TAG_GROUPS = [
    frozenset(g.split())
    for g in (
        "p", "h1", "h2 h3 h4 h5 h6", "li dt dd", "ul ol dl menu", "div", "section", "article", "main", "nav", "header hgroup", "footer", "aside",
        "form fieldset legend", "table tbody thead tfoot tr td th", "figure figcaption", "blockquote pre", "details summary dialog", "body html", "address",
    )
]
# Names that pages give their parts, in English, German, French and Spanish, without accents.
TOKEN_GROUPS = [
    frozenset(g.split())
    for g in (
        "article post entry story content body text main maincontent prose artikel beitrag inhalt haupttext nachricht contenu texte articulo contenido cuerpo noticia",
        "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs links hauptmenu menue navegacion ariane migas",
        "ad ads advert advertisement adsense sponsor sponsored promo banner doubleclick dfp werbung anzeige publicite pub annonce anuncio publicidad",
        "footer foot copyright legal colophon fuss fusszeile impressum pied mentions pie",
        "header masthead topbar brand logo site kopf kopfzeile entete cabecera",
        "sidebar side aside related recommended more trending widget teaser rail seitenleiste randspalte verwandt laterale connexes lateral relacionados",
        "comment comments disqus reply replies respond discussion thread reader kommentar kommentare leserbriefe antworten commentaire commentaires reactions comentario comentarios respuestas opiniones",
        "cookie cookies consent notice gdpr alert popup modal overlay newsletter subscribe signup warning privacy hinweis einwilligung datenschutz consentement infolettre aviso consentimiento boletin",
        "share sharing social twitter facebook follow teilen partager compartir",
        "hidden sr skip print none",
        "form search login contact suche recherche buscar",
    )
]
_GROUP_OF = {t: i for i, g in enumerate(TAG_GROUPS) for t in g}
_TOKEN_OF = {t: i for i, g in enumerate(TOKEN_GROUPS) for t in g}

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
# What follows a tag's name, up to its end: a quote counts after an equals sign only. Nothing is ever given back.
_REST = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=|["'])*+>""")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*=?\s*("[^"]*"|'[^']*'|[^\s"'>]*)""", re.I)
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_MARKS = re.compile(r"[.,;:!?]")


class Page:
    """Block elements in document order (0 is the root), and text blocks as (element, text, characters in links)."""

    def __init__(self):
        self.tag, self.parent, self.depth, self.tokens, self.links, self.times, self.hidden = ["html"], [-1], [0], [0], [0], [0], [False]
        self.blocks: list[tuple[int, str, int]] = []

    def add(self, tag: str, parent: int, attributes: str) -> int:
        mask, hidden = 0, False
        if attributes:
            for name, value in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'")
                if name in ("hidden", "aria-hidden"):
                    hidden |= value.lower() != "false"
                elif name == "style":
                    hidden |= "display:none" in value.replace(" ", "").lower()
                else:
                    if not value.isascii():
                        value = "".join(c for c in unicodedata.normalize("NFD", value) if not unicodedata.combining(c))
                    for token in _TOKEN.findall(_CAMEL.sub(" ", value).lower()):
                        if (g := _TOKEN_OF.get(token)) is not None:
                            mask |= 1 << g
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.tokens.append(mask)
        self.links.append(0)
        self.times.append(0)
        self.hidden.append(hidden or self.hidden[parent])
        return len(self.tag) - 1


class _Tags:
    """The tags, comments and declarations of a page, found in time linear in its length whatever it holds.

    What looks like a tag but isn't ended by a `>` anywhere is text. Where quotes leave a tag open up to the page's end, it and all
    later ones end at their next `>`, in quotes or not.
    """

    def __init__(self, source: str):
        self.source, self.next_end, self.quotes = source, 0, True
        self.pairs: dict[str, dict[int, int]] = {}

    def end_after(self, at: int) -> int:
        """The place of the next `>`, or -1."""
        if 0 <= self.next_end < at or at == 0:
            self.next_end = self.source.find(">", at)
        return self.next_end

    def find(self, at: int) -> tuple[int, int, bool, str | None, str] | None:
        """Start, end, whether it closes, name in lower case (None if not a tag) and attributes of the next one from `at`."""
        source = self.source
        while (start := source.find("<", at)) >= 0:
            kind = source[start + 1 : start + 2]
            if kind in ("!", "?"):
                if source.startswith("<!--", start):
                    end = source.find("-->", start + 4)
                    return start, len(source) if end < 0 else end + 3, False, None, ""
                end = self.end_after(start)
                return start, len(source) if end < 0 else end + 1, False, None, ""
            if self.end_after(start) < 0:
                return None
            m = _NAME.match(source, start + 1)
            if m is None:
                at = start + 1
                continue
            rest = _REST.match(source, m.end()) if self.quotes else None
            self.quotes = rest is not None
            end = rest.end() if rest else source.find(">", m.end()) + 1
            return start, end, bool(m[1]), m[2].lower(), source[m.end() : end - 1]
        return None

    def close_of(self, start: int, name: str) -> int:
        """The end of the element of a silent kind that begins at `start`; -1 if it is never closed."""
        if name not in self.pairs:
            found, open_, at = {}, [], -1
            for m in _tags_of(name).finditer(self.source):
                at = self.source.find(">", m.end()) if at < m.end() else at
                if at < 0:
                    break
                if m[1]:
                    if open_:
                        found[open_.pop()] = at + 1
                elif self.source[at - 1] != "/":
                    open_.append(m.start())
            self.pairs[name] = found
        return self.pairs[name].get(start, -1)


@functools.cache
def _tags_of(name: str) -> re.Pattern:
    return re.compile(rf"<(/?){name}(?=[\s/>])", re.I)


class _Open:
    """The open elements, innermost last, and where in the stack those of each name are."""

    def __init__(self):
        self.ids, self.names, self.places = [0], ["html"], {}

    def push(self, element: int, name: str) -> None:
        self.places.setdefault(name, []).append(len(self.ids))
        self.ids.append(element)
        self.names.append(name)

    def nearest(self, names) -> int:
        """The place of the innermost open element of one of `names`, 0 if there is none."""
        return max([self.places[n][-1] for n in names if self.places.get(n)], default=0)

    def cut(self, place: int) -> None:
        while len(self.ids) > place:
            self.ids.pop()
            self.places[self.names.pop()].pop()


def parse(source: str) -> Page:
    """The page's block elements and text blocks. Inline elements only tell which text is a link."""
    page, open_, tags = Page(), _Open(), _Tags(source)
    run: list[str] = []
    link_chars = in_link = at = 0

    def flush() -> None:
        nonlocal link_chars
        if run:
            text = " ".join("".join(run).split())
            if text:
                page.blocks.append((open_.ids[-1], text, min(link_chars, len(text))))
            run.clear()
            link_chars = 0

    def feed(raw: str) -> None:
        nonlocal link_chars
        if raw:
            if "&" in raw:
                raw = html.unescape(raw)
            run.append(raw)
            if in_link:
                link_chars += len(raw)

    while (tag := tags.find(at)) is not None:
        start, end, closes, name, attributes = tag
        feed(source[at:start])
        at = end
        if name is None:
            continue
        if closes:
            if name == "a":
                in_link = 0
            elif name in INLINE or name in VOID:
                if name == "br":
                    run.append(" ")
            elif place := open_.nearest((name,)):
                flush()
                open_.cut(place)
                in_link = 0
        elif name == "a":
            in_link = 1
            page.links[open_.ids[-1]] += 1
        elif name in ("br", "wbr", "img", "input"):
            run.append(" ")
        elif name in INLINE:
            page.times[open_.ids[-1]] += name == "time"
        elif name in SILENT:
            if name in RAW:
                over = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                stop = source.find(">", over.end()) if over else -1
                at = len(source) if stop < 0 else stop + 1
            elif not attributes.rstrip().endswith("/"):
                # Never closed: only the tag itself is dropped.
                at = max(at, tags.close_of(start, name))
            run.append(" ")
        else:
            flush()
            in_link = 0
            if name == "hr":
                continue
            if name in CLOSES:
                ends, upto = CLOSES[name]
                if (place := open_.nearest(ends)) > open_.nearest(upto):
                    open_.cut(place)
            # A block ends an open paragraph.
            if open_.names[-1] == "p":
                open_.cut(len(open_.ids) - 1)
            if name in ("html", "body") and (name == "html" or "body" in open_.places):
                continue
            open_.push(page.add(name, open_.ids[-1], attributes), name)
    feed(source[at:])
    flush()
    return page


#: Features that are neither tags nor tokens.
PLAIN = 29
N_FEATURES = PLAIN + len(TAG_GROUPS) + 3 * len(TOKEN_GROUPS)


def features(page: Page) -> np.ndarray:
    """A row for each element."""
    n = len(page.tag)
    parent = np.array(page.parent)
    own = np.zeros((n, 8))  # characters, in links, words, marks, text blocks, links, times, copyright signs
    for node, text, linked in page.blocks:
        row = own[node]
        row[0] += len(text)
        row[1] += linked
        row[2] += text.count(" ") + 1
        row[3] += len(_MARKS.findall(text))
        row[4] += 1
        row[7] += "©" in text
    own[:, 5] = page.links
    own[:, 6] = page.times
    total, elements = own.copy(), np.ones(n)
    for i in range(n - 1, 0, -1):
        total[parent[i]] += total[i]
        elements[parent[i]] += elements[i]
    chars, linked, words, marks, blocks, links, times, signs = total.T
    everything = max(1.0, chars[0])
    groups = np.array([_GROUP_OF.get(t, -1) for t in page.tag])
    tokens = ((np.array(page.tokens)[:, None] >> np.arange(len(TOKEN_GROUPS))) & 1).astype(float)
    above_tokens = np.zeros_like(tokens)
    above_tags = np.zeros((n, 8))
    semantic = {i: k for k, names in enumerate(("article", "main", "nav", "header", "footer", "aside", "form", "table")) for i in range(len(TAG_GROUPS)) if names in TAG_GROUPS[i]}
    for i in range(1, n):
        p = parent[i]
        above_tokens[i] = np.maximum(above_tokens[p], tokens[p])
        above_tags[i] = above_tags[p]
        if (k := semantic.get(int(groups[p]))) is not None:
            above_tags[i, k] = 1
    up = np.maximum(parent, 0)
    siblings = np.bincount(up[1:], minlength=n)[up] if n > 1 else np.ones(n)
    siblings = np.maximum(siblings, 1)
    order = np.zeros(n)
    seen: dict[int, int] = {}
    for i in range(1, n):
        order[i] = seen.get(page.parent[i], 0)
        seen[page.parent[i]] = int(order[i]) + 1
    around = (np.bincount(up[1:], weights=chars[1:], minlength=n)[up] if n > 1 else chars) / siblings
    like = np.zeros(n)
    if n > 1:
        key = up * (len(TAG_GROUPS) + 2) + groups + 1
        _, inverse, count = np.unique(key[1:], return_inverse=True, return_counts=True)
        like[1:] = count[inverse] / siblings[1:]
    # Neighbours of the same tag and tokens, as of entries in a list of comments or teasers, and how many times they state.
    twins = np.ones(n)
    if n > 1:
        _, kind = np.unique(np.array(page.tag), return_inverse=True)
        _, inverse, count = np.unique(np.stack((up, kind, np.array(page.tokens)), 1)[1:], axis=0, return_inverse=True, return_counts=True)
        twins[1:] = count[inverse.ravel()]
    stated = times / np.maximum(blocks, 1)
    beneath = np.zeros((n, 3))  # paragraphs, headings, list items
    for k, g in enumerate((0, 1, 3)):
        beneath[:, k] = groups == g
    beneath[:, 1] += groups == 2
    for i in range(n - 1, 0, -1):
        beneath[parent[i]] += beneath[i]
    words_ = np.maximum(words, 1)
    out = np.zeros((n, N_FEATURES))
    columns = [
        np.log1p(chars), linked / np.maximum(chars, 1), np.log1p(words), words / np.maximum(blocks, 1), marks / words_, np.log1p(elements), links / words_,
        np.array(page.depth), chars / everything, siblings, order / siblings, like, np.log1p(around), chars / np.maximum(around, 1), np.array(page.hidden, float),
        beneath[:, 0], beneath[:, 1], beneath[:, 2] / elements, own[:, 4] > 0, chars / elements,
        above_tags[:, 0] + above_tags[:, 1], above_tags[:, 2] + above_tags[:, 4] + above_tags[:, 5], above_tags[:, 3], above_tags[:, 6] + above_tags[:, 7],
        stated, stated[up], np.log1p(twins), np.log1p(twins[up]), signs / np.maximum(blocks, 1),
    ]
    out[:, : len(columns)] = np.stack(columns, 1)
    at = PLAIN
    out[np.arange(n), at + np.maximum(groups, 0)] = groups >= 0
    at += len(TAG_GROUPS)
    k = len(TOKEN_GROUPS)
    out[:, at : at + k] = tokens
    out[:, at + k : at + 2 * k] = above_tokens
    # What a parent's only-child chain says also counts for the element itself.
    out[:, at + 2 * k :] = tokens[up] * (siblings == 1)[:, None]
    return out


class Boosted:
    """Gradient-boosted trees for the log-odds of a binary label: fixed depth, histogram splits, each tree on a share of the rows."""

    DEPTH, TREES, RATE, BINS, LEAST, SHRINK, SHARE = 5, 90, 0.2, 32, 8.0, 1.0, 0.35

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, f = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.BINS + 1)[1:-1])) for j in range(f)]
        bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1)
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        z, self.trees = np.full(n, self.bias), []
        inner = (1 << self.DEPTH) - 1
        flat, draw = bins + np.arange(f) * self.BINS, np.random.default_rng(1)
        for _ in range(self.TREES):
            some = draw.permutation(n)[: max(1, int(self.SHARE * n))] if n > 1_000 else np.arange(n)
            rows, rx, m = flat[some], x[some], len(some)
            p = 1 / (1 + np.exp(-z[some]))
            g, h = y[some] - p, p * (1 - p)
            column, limit, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(m, np.int64)
            for level in range(self.DEPTH):
                width, first = 1 << level, (1 << level) - 1
                at = ((node - first)[:, None] * (f * self.BINS) + rows).ravel()
                size = width * f * self.BINS
                hg = np.bincount(at, np.repeat(g, f), size).reshape(width, f, self.BINS).cumsum(2)
                hh = np.bincount(at, np.repeat(h, f), size).reshape(width, f, self.BINS).cumsum(2)
                tg, th = hg[:, :, -1:], hh[:, :, -1:]
                gain = hg**2 / (hh + self.SHRINK) + (tg - hg) ** 2 / (th - hh + self.SHRINK) - tg**2 / (th + self.SHRINK)
                gain[(hh < self.LEAST * 0.05) | (th - hh < self.LEAST * 0.05)] = 0
                best = gain.reshape(width, -1).argmax(1)
                for k in range(width):
                    j, b = divmod(int(best[k]), self.BINS)
                    if gain[k, j, b] > 1e-6 and b < len(self.edges[j]):
                        column[first + k], limit[first + k] = j, self.edges[j][b]
                node = 2 * node + 1 + (rx[np.arange(m), column[node]] > limit[node])
            leaf = node - inner
            value = np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.SHRINK) * self.RATE
            self.trees.append((column, limit, value))
            z += self._leaf_values(x, self.trees[-1])
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sum((self._leaf_values(x, tree) for tree in self.trees), np.full(len(x), self.bias))

    def _leaf_values(self, x: np.ndarray, tree: tuple) -> np.ndarray:
        column, limit, value = tree
        rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for _ in range(self.DEPTH):
            node = 2 * node + 1 + (x[rows, column[node]] > limit[node])
        return value[node - ((1 << self.DEPTH) - 1)]


def decode(page: Page, odds: np.ndarray) -> list[str]:
    """The main text blocks under the best consistent labelling."""
    n = len(page.tag)
    own = np.clip(odds, -4.0, 4.0)
    # Value of a subtree if all of it is main, if none is, and if its parts may differ. A page as such is neither.
    inner = np.array([t not in ("html", "body") for t in page.tag], float)
    main, other = own * inner, -own * inner
    mixed = np.zeros(n)
    text_value = np.zeros(n)
    for node, _, _ in page.blocks:
        text_value[node] += own[node]
    mixed += np.abs(text_value) - 0.5 * inner  # a mixed element's own text follows its own odds
    best = np.zeros(n)
    for i in range(n - 1, -1, -1):
        best[i] = max(main[i], other[i], mixed[i])
        if i:
            p = page.parent[i]
            main[p] += main[i]
            other[p] += other[i]
            mixed[p] += best[i]
    label = np.zeros(n, np.int8)  # 1 main, 0 other, by element, for its own text
    forced = np.full(n, -1, np.int8)
    for i in range(n):
        up = forced[page.parent[i]] if i else -1
        if up >= 0:
            forced[i] = label[i] = up
        elif main[i] >= best[i]:
            forced[i] = label[i] = 1
        elif other[i] >= best[i]:
            forced[i] = label[i] = 0
        else:
            label[i] = own[i] > 0
    return [text for node, text, _ in page.blocks if label[node]]


#: Stands in generated pages before every text block that is main.
_MARK = "\ue000"


def training_page(rng: random.Random) -> str:
    """A page of random words in one of many layouts, with its main text blocks marked."""

    def words(low: int, high: int) -> str:
        n, noise = rng.randint(low, high), rng.random() < 0.1
        out = ["".join(rng.choice(("an", "er", "the", "ion", "st", "le", "é", "ü", "que", "sch", "ción", "de", "in")) for _ in range(rng.randint(1, 4))) for _ in range(n)]
        out = [w + rng.choice(("%%%", "***", "!!", "")) for w in out] if noise else out
        for i in range(rng.randint(4, 14), n, rng.randint(5, 15)):
            out[i - 1] += rng.choice((".", ",", ".", "?"))
        return " ".join(out).capitalize() + rng.choice((".", ".", ""))

    def links(tag: str, n: int) -> str:
        return f"<{tag}>" + "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(n)) + f"</{tag}>"

    def box(tag: str, names: str, inside: str) -> str:
        name = rng.choice(names.split())
        how = rng.choice((f' class="{name}"', f' id="{name}"', f' class="box {name}-{rng.randint(1, 9)}"', f' role="{name}" class="{name}"'))
        return f"<{tag}{how}>{inside}</{tag}>"

    def plain(low: int = 3, high: int = 40) -> str:
        return rng.choice((words(low, high), f"<p>{words(low, high)}</p>", f"<p>{words(low, high)}</p><p>{words(low, high)}</p>"))

    ad = lambda: box("div", "ad ads advert sponsored promo banner werbung anzeige publicite anuncio", plain())
    menu = lambda: rng.choice((f"<nav>{links('ul', rng.randint(2, 9))}</nav>", box("div", "nav menu navbar breadcrumb hauptmenu navegacion", links("ul", rng.randint(2, 9)))))
    head = lambda: rng.choice((f"<header>{plain(1, 8)}{menu()}</header>", box("div", "header masthead topbar", f"<h2>{words(1, 4)}</h2>")))
    sign = lambda: rng.choice(("&copy; ", "&copy; ", ""))
    foot_names = "footer copyright impressum fusszeile pied-page pie"
    foot = lambda: rng.choice((f"<footer>{sign()}{plain(2, 30)}</footer>", box("div", foot_names, f"<p>{sign()}{words(2, 30)}</p>"), box("div", foot_names, words(1, 3))))
    side = lambda: rng.choice((f"<aside>{plain()}{links('ul', rng.randint(0, 6))}</aside>", box("div", "sidebar related widget trending seitenleiste laterale lateral", f"<h3>{words(1, 4)}</h3>{links('ul', rng.randint(2, 8))}")))
    note = lambda: box(rng.choice(("div", "section")), "cookie consent notice newsletter popup gdpr hinweis einwilligung infolettre aviso", plain(3, 30) + "<button>OK</button>")
    form = lambda: f"<form><label>{words(1, 3)}</label><input name=q><p>{words(1, 12)}</p><button>Go</button></form>"
    share = lambda: box("div", "share social", links("ul", 4))

    def comments() -> str:
        many = "".join(rng.choice((f"<p>{words(2, 60)}</p>", f'<div class="comment"><b>{words(1, 2)}</b><p>{words(2, 60)}</p></div>', f"<li>{words(2, 40)}</li>")) for _ in range(rng.randint(1, 6)))
        names = "comments comment disqus replies reader-comments kommentare leserkommentare commentaires comentarios reactions respuestas"
        return box(rng.choice(("div", "section", "ul")), names, f"<h3>{words(1, 3)}</h3>{many}")

    def stamped() -> str:
        """Comments of readers that are named by their form alone: a name and a time before each."""
        tag, name = rng.choice(("div", "li", "section")), rng.choice(("", ' class="item"', ' class="row"', ' class="x1"'))
        when = lambda: f"<time>{rng.randint(1, 28)}.{rng.randint(1, 12)}.</time>"
        entry = lambda: rng.choice((f"<p><b>{words(1, 2)}</b> {when()}</p><p>{words(2, 50)}</p>", f"<b>{words(1, 2)}</b> {when()}<p>{words(2, 50)}</p>"))
        return f"<div>{rng.choice(('', f'<h3>{words(1, 3)}</h3>'))}" + "".join(f"<{tag}{name}>{entry()}</{tag}>" for _ in range(rng.randint(2, 6))) + "</div>"

    def listing() -> str:
        """An article that is a list of linked items, longer than those of menus or with text of their own."""
        tag, more = rng.choice(("ol", "ol", "ul")), rng.random() < 0.5
        item = lambda: f'<li><a href="/x">{_MARK}{words(3, 12)}</a>{" " + words(2, 20) if more else ""}</li>'
        return f"<{tag}>" + "".join(item() for _ in range(rng.randint(4, 12))) + f"</{tag}>"

    def filed() -> str:
        """The footer of an article."""
        tags = "".join(f'<a href="/t">{words(1, 2)}</a> ' for _ in range(rng.randint(0, 3)))
        return rng.choice((f"<footer>{words(2, 6)}: {tags}{words(1, 3)}</footer>", f"<footer>{words(1, 4)}: {words(1, 2)}</footer>", f"<footer><p>{words(2, 12)} {tags}</p></footer>", f"<footer><ul><li>{words(1, 3)}</li><li>{words(1, 3)}</li></ul></footer>"))

    def entities() -> str:
        return " ".join(rng.choice(("&amp;", "&lt;b&gt;", "&#233;t&#233;", "&nbsp;", "&quot;" + words(1, 3) + "&quot;", "&hellip;", words(1, 4))) for _ in range(rng.randint(2, 25)))

    def table() -> str:
        wide = rng.randint(1, 4)
        row = lambda cell: "<tr>" + "".join(f"<{cell}>{_MARK}{words(1, rng.choice((2, 12)))}</{cell}>" for _ in range(wide)) + "</tr>"
        head = rng.choice(("", f"<caption>{_MARK}{words(2, 6)}</caption>"))
        return f"<table>{head}{rng.choice((row('th'), ''))}{''.join(row('td') for _ in range(rng.randint(1, 5)))}</table>"

    def rarer() -> str:
        kind = rng.choice(("table", "table", "pre", "figure", "dl", "entities", "details", "ol"))
        if kind == "table":
            return table()
        if kind == "pre":
            code = f"{words(1, 5)}\n  {words(1, 5)}"
            return rng.choice((f"<pre>{_MARK}{code}</pre>", f"<pre><code>{_MARK}{code}</code></pre>"))
        if kind == "figure":
            return f'<figure><img src="/a.png" alt="{words(1, 4)}"><figcaption>{_MARK}{words(2, 14)}</figcaption></figure>'
        if kind == "dl":
            return "<dl>" + "".join(f"<dt>{_MARK}{words(1, 3)}<dd>{_MARK}{words(2, 20)}" for _ in range(rng.randint(1, 4))) + "</dl>"
        if kind == "entities":
            return f"<p>{_MARK}{entities()}</p>"
        if kind == "details":
            return f"<details><summary>{_MARK}{words(1, 5)}</summary><p>{_MARK}{words(4, 40)}</p></details>"
        return "<ol>" + "".join(f"<li><p>{_MARK}{words(2, 30)}</p></li>" for _ in range(rng.randint(1, 4))) + "</ol>"

    def short() -> str:
        """A body that is little else than its text."""
        text = rng.choice((words(4, 30), words(4, 12) + ". " + words(4, 12) + ".", entities()))
        name = rng.choice(("", ' id="x"', ' class="page"', ' id="a1"', ' class="wrap"'))
        tag = rng.choice(("div", "div", "div", "p", "section", "article", "main", "td", "body"))
        if tag == "td":
            return f"<table{name}><tr><td>{_MARK}{text}</td></tr></table>"
        if tag == "body":
            return f"{_MARK}{text}"
        more = rng.choice(("", "", f"<p>{_MARK}{words(4, 30)}</p>", table()))
        return f"<{tag}{name}>{_MARK}{text}</{tag}>{more}" if tag == "p" else f"<{tag}{name}>{rng.choice(('', f'<h1>{_MARK}{words(1, 5)}</h1>'))}<p>{_MARK}{text}</p>{more}</{tag}>" if rng.random() < 0.5 else f"<{tag}{name}>{_MARK}{text}{more}</{tag}>"

    def article() -> str:
        if rng.random() < 0.22:
            return short()
        parts = [f"<h1>{_MARK}{words(2, 12)}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.choice((1, 2, 3, 4, 6, 9, 14))):
            r = rng.random()
            if rng.random() < 0.1:
                parts.append(rarer())
            elif r < 0.6:
                parts.append(f"<p>{_MARK}{words(1, rng.choice((3, 20, 60, 150)))}</p>")
            elif r < 0.75:
                parts.append(f"<p><b>{_MARK}{words(2, 40)}<br>")
            elif r < 0.82:
                parts.append(f"<h2>{_MARK}{words(1, 6)}</h2>")
            elif r < 0.88:
                parts.append("<ul>" + "".join(f"<li>{_MARK}{words(2, 20)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif r < 0.92:
                parts.append(f"<blockquote><p>{_MARK}{words(5, 40)}</p></blockquote>")
            elif r < 0.95:
                parts.append(f"<div>{_MARK}{words(5, 80)}</div>")
            else:
                parts.append(f'<p>{_MARK}{words(5, 30)} <a href="/x">{words(1, 3)}</a> {words(5, 30)}</p>')
            if rng.random() < 0.06:
                parts.append(rng.choice((ad, share, form, note, side))())
        if parts and parts[0].startswith("<h1>") and rng.random() < 0.08:
            parts[0] = f"<header>{parts[0]}</header>"
        if rng.random() < 0.08:
            parts.insert(rng.randint(min(1, len(parts)), len(parts)), listing())
            parts = parts[: rng.choice((2, 3, 20))] if len(parts[0]) < 200 and "<li>" in "".join(parts[:2]) else parts
        if rng.random() < 0.22:
            parts.append(rng.choice((comments, share, stamped))())
        if rng.random() < 0.25:
            parts.append(filed())
        inside = "".join(parts)
        tag = rng.choice(("article", "article", "article", "main", "content", "wrapped", "bare"))
        if tag in ("article", "main"):
            return f"<{tag}>{inside}</{tag}>"
        if tag == "bare":
            return f"<div>{inside}</div>"
        whole = box("div", "content post entry article-body main story", inside)
        return f"<main>{whole}</main>" if tag == "wrapped" else whole

    bare = rng.random() < 0.08  # a page without anything around its text
    before = [f() for f in (head, menu, ad, note, form, side) if rng.random() < 0.45 and not bare]
    after = [f() for f in (foot, side, ad, comments, stamped, share, note, menu) if rng.random() < 0.4 and not bare]
    rng.shuffle(before)
    if rng.random() < 0.8 and not bare:
        after.append(foot())
    if rng.random() < 0.1:
        # A page laid out as a table: parts in cells around the text's.
        cell = lambda inside: f"<td>{inside}</td>"
        bare_menu = lambda: "".join(f'<a href="/{i}">{words(1, 2)}</a>{rng.choice((" ", "<br>", " | "))}' for i in range(rng.randint(2, 8)))
        around = [cell(rng.choice((bare_menu, bare_menu, menu, side, ad))()) for _ in range(rng.randint(1, 2))]
        around.insert(rng.choice((1, len(around))), cell(article()))
        top = rng.choice(("", f"<tr><td colspan=3>{rng.choice((bare_menu, lambda: words(1, 5)))()}</td></tr>"))
        low = rng.choice(("", f"<tr><td colspan=3>&copy; {words(2, 8)}</td></tr>"))
        return f"<html><body><table>{top}<tr>{''.join(around)}</tr>{low}</table></body></html>"
    body = "".join(before) + article() + "".join(after)
    if rng.random() < 0.3:
        body = f'<div class="{rng.choice(("page", "wrap", "container", "site"))}">{body}</div>'
    return f"<!DOCTYPE html><html><head><title>x</title></head><body>{body}</body></html>"


TRAINING_PAGES, TRAINING_SEED = 2_500, 5
_trained: list[Boosted] = []


def trained() -> Boosted:
    """The trees, trained on generated pages once per process."""
    if not _trained:
        rng = random.Random(TRAINING_SEED)
        rows, labels = [], []
        for _ in range(TRAINING_PAGES):
            page = parse(training_page(rng))
            main, all_ = np.zeros(len(page.tag)), np.zeros(len(page.tag))
            for node, text, _ in page.blocks:
                main[node] += _MARK in text
                all_[node] += 1
            for i in range(len(page.tag) - 1, 0, -1):
                main[page.parent[i]] += main[i]
                all_[page.parent[i]] += all_[i]
            pure = (all_ > 0) & ((main == 0) | (main == all_))
            rows.append(features(page)[pure])
            labels.append((main > 0)[pure])
        _trained.append(Boosted().fit(np.concatenate(rows), np.concatenate(labels).astype(float)))
    return _trained[0]


def extract_all(sources: list[str | None], trees: Boosted) -> list[str]:
    """Main texts of pages: blocks in page order, joined by an empty line."""
    pages = [parse(s or "") for s in sources]
    made = [features(p) for p in pages]
    odds = np.split(trees(np.concatenate(made)), np.cumsum([len(m) for m in made])[:-1]) if made else []
    return ["\n\n".join(decode(p, o)) for p, o in zip(pages, odds, strict=True)]


def extract(pages: DataFrame) -> DataFrame:
    """`pages` (page_id, url, html) with their main text: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = extract_all(batch.column(2).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", "html")
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
