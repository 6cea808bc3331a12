"""Main text of web pages by scoring the element tree."""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame, functions as F, types as T

from .common import in_batches

_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer"
    " form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody"
    " td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup; it ends at their own end tag.
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_DEAD = frozenset(
    "head nav footer aside noscript template button select option label legend svg annotation annotation-xml canvas object audio"
    " video dialog menu".split()
)
#: What may stand in a head; any other start tag, or text, ends a head whose end tag was left out.
_IN_HEAD = frozenset("head base link meta noscript script style template title".split())
#: Plain English words in class, id or role for what surrounds an article.
_BAD = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie"
    " cookies copyright footer form gdpr header legal login masthead menu menubar modal nav navbar navigation newsletter"
    " notice notices overlay pagination paywall popup promo promoted recommended recommendations related replies reply"
    " respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar"
    " tooltip trending widget".split()
)
#: Those that inside an article may as well be said of its own parts; there, only lists of links go by them.
_OWN = frozenset("banner copyright footer form header legal notice notices overlay respond search skip tags toolbar tooltip trending widget".split())
#: Elements that are parts of a text, table or picture and never judged by their names.
_PLAIN = frozenset("h1 h2 h3 h4 h5 h6 tr th td thead tbody tfoot caption p pre blockquote figure figcaption dt dd hgroup".split())
#: Words that say no more of an element than that it is one.
_FILL = frozenset(
    "area articles bar block blocks body bottom box button buttons col column component container content entry form group"
    " icon icons inner item items left link links list lists module outer panel post posts right row section slot stories"
    " text top unit wrap wrapper zone".split()
)
_ALWAYS = frozenset("comment comments sidebar".split())
_BESIDE = frozenset("has with no without is not".split())
_GOOD = frozenset("article body column content entry main post story text".split())
_SAFE = frozenset("html body main article".split())
#: An open element that a start tag of the key ends.
_ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"), "option": ("option",),
}
_SCOPE = frozenset("ul ol dl table body html article section div main".split())
_LISTS = frozenset("ul ol dl table div section".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SHORT = 25


class _Tree:
    """Elements in page order, and the text of each block."""

    def __init__(self, page: str):
        self.tag, self.parent, self.dead, self.link, self.block = ["#"], [0], [False], [False], [0]
        self.article, self.weak, self.doubt = [False], [False], [False]
        self.depth, self.blocks, self._text, self._links = [0], [], [], 0
        self.forms: list[int] = []
        stack, at, low = [0], 0, None
        while m := _TAG.search(page, at):
            if self.tag[stack[-1]] == "head" and page[at : m.start()].strip():
                stack.pop()
            self._add(page[at : m.start()], stack[-1])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                self._close(name, stack)
                continue
            if name == "br":
                self._text.append(" ")
            if name in _BLOCK:
                self._flush(stack[-1])
            if name in _RAW:
                low = low or page.lower()
                # lower-casing may change lengths of rare letters; then search as it is
                end = low.find(f"</{name}", at) if len(low) == len(page) else page.find(f"</{name}", at)
                at = len(page) if end < 0 else (page.find(">", end) + 1 or len(page))
                continue
            if name in _VOID:
                continue
            self._open(name, m[3] if m[2] else m[6], stack)
        self._add(page[at:], stack[-1])
        self._flush(stack[-1])
        self._judge_forms()

    def _judge_forms(self) -> None:
        """Drop the text of forms, but of those around an article, main element or most of the page's text."""
        if not self.forms:
            return
        n, total = len(self.tag), sum(len(b[1]) for b in self.blocks)
        chars, holds = [0] * n, [t in ("article", "main") for t in self.tag]
        for node, text, _ in self.blocks:
            chars[node] += len(text)
        for node in range(n - 1, 0, -1):
            chars[self.parent[node]] += chars[node]
            holds[self.parent[node]] |= holds[node]
        out = [False] * n
        small = {f for f in self.forms if not holds[f] and 2 * chars[f] <= total}
        for node in range(1, n):
            out[node] = out[self.parent[node]] or node in small
        self.blocks = [b for b in self.blocks if not out[b[0]]]

    def _add(self, text: str, node: int) -> None:
        if text and not self.dead[node]:
            self._text.append(text)
            if self.link[node]:
                self._links += len(text)

    def _flush(self, node: int) -> None:
        if self._text:
            text = " ".join(html.unescape("".join(self._text)).split())
            if text:
                self.blocks.append((self.block[node], text, min(self._links, len(text))))
            self._text, self._links = [], 0

    def _open(self, name: str, attributes: str, stack: list[int]) -> None:
        if name in _BLOCK and any(self.tag[x] == "p" for x in stack[1:]):
            self._close("p", stack)
        if ends := _ENDS.get(name):
            for i in range(len(stack) - 1, 0, -1):
                if self.tag[stack[i]] in ends:
                    del stack[i:]
                elif self.tag[stack[i]] in _SCOPE:
                    break
        if name not in _IN_HEAD:
            for i in range(len(stack) - 1, 0, -1):
                if self.tag[stack[i]] == "head":
                    del stack[i:]
        above = stack[-1]
        article = self.article[above] or name in ("article", "main")
        dead = self.dead[above] or name in _DEAD or (name == "header" and not article)
        weak, doubt = self.weak[above] and name not in ("article", "main"), False
        if not dead and attributes and name not in _SAFE:
            dead, doubt = self._judged(name, attributes, article)
        # a hint alone counts outside of articles and for lists of links
        self.article.append(article)
        self.weak.append(weak or doubt and not article and name in _BLOCK)
        self.doubt.append(doubt)
        node = len(self.tag)
        if name == "form" and not dead:
            self.forms.append(node)
        self.tag.append(name)
        self.parent.append(above)
        self.dead.append(dead)
        self.link.append(self.link[above] or name == "a")
        self.block.append(node if name in _BLOCK else self.block[above])
        self.depth.append(self.depth[above] + 1)
        stack.append(node)

    def _judged(self, name: str, attributes: str, article: bool) -> tuple[bool, bool]:
        """Whether the attributes show that an element is no part of an article, and whether they hint at it.

        Hidden elements go, whatever they are. Names are looked at for blocks that can hold an aside alone.
        """
        strong, bad, good = False, False, False
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or "").strip("\"'")
            if key == "hidden" or key == "aria-hidden" and value.lower().startswith("true") or key == "style" and _NONE.search(value):
                return True, True
            # ids of headings and sections come from titles
            if key not in ("class", "id", "role") or name not in _BLOCK or name in _PLAIN or key == "id" and name == "section":
                continue
            for token in value.split():
                words = [w.lower() for w in _PART.findall(token)]
                # "with-sidebar" is said of what stands beside a sidebar
                if not words or words[0] in _BESIDE:
                    continue
                parts = set(words)
                good = good or bool(parts & _GOOD)
                always = words[0] in _ALWAYS and (key != "id" or parts <= _BAD | _FILL | _GOOD)
                if always:
                    return True, True
                if parts & _BAD:
                    bad = True
                    proof = _BAD - _OWN if article else _BAD
                    strong = strong or bool(parts & proof) and parts <= _BAD | _FILL or not article and key != "id" and words[-1] in _BAD
                bad = bad or words[0] in _ALWAYS
        return strong and not good, bad and not good

    def _close(self, name: str, stack: list[int]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if self.tag[stack[i]] == name:
                if name in _BLOCK:
                    self._flush(stack[-1])
                del stack[i:]
                return
            if name not in _BLOCK and self.tag[stack[i]] in _BLOCK:
                return  # an inline end tag never closes a block


def main_text(page: str | None) -> str:
    """The article of one page: blocks in page order, joined by empty lines.

    Every block of at least 25 characters gives one point, one per comma and up to three for length
    to its parent, half of that to the grandparent and ever smaller shares above; an element's points
    shrink by its share of link text. The best element is kept, widened to the article or main element
    around it. Without these, siblings of it that score well are kept, too, and all that stands between
    or beside them up to a list of links. Elements whose names only hint at something else than an article
    ("search-methods") count if they are in what is kept, unless they are lists of links. A list of links goes if it stands before the first heading
    or long text, outside of article and main. If no block is long enough, all blocks count. NULL,
    empty and text-free pages give an empty text.
    """
    tree = _Tree(page or "")
    if not tree.blocks:
        return ""
    n = len(tree.tag)
    sure = [b for b in tree.blocks if not tree.weak[b[0]]]
    if not sure:
        sure, tree.weak = tree.blocks, [False] * n
    chars, links, anchors = _sums(tree, sure)
    score = [0.0] * n
    long = [b for b in sure if len(b[1]) >= _SHORT] or sure
    for node, text, _ in long:
        points = 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)
        plain = tree.tag[node] in ("p", "pre", "td", "li", "dd", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6")
        above, share = (tree.parent[node] if plain else node), 1.0
        while above and share > 0.05:
            score[above] += points * share
            above, share = tree.parent[above], share / (2 if share == 1.0 else 1.5)
    score = [s * (1 - links[i] / chars[i]) if chars[i] else 0.0 for i, s in enumerate(score)]
    best = max(range(1, n), key=lambda i: (score[i], -tree.depth[i]), default=0)
    if not best or not score[best]:
        best = 0
    up = best
    while up:
        if tree.tag[up] in ("article", "main"):
            best = up
        up = tree.parent[up]
    kept, loose = {best}, set()
    whole = tree.tag[best] in ("article", "main")
    if best and not whole and tree.tag[best] not in ("body", "html"):
        _beside(tree, best, score, chars, links, anchors, kept, loose)
    chars, links, anchors = _sums(tree, tree.blocks)
    last = [-1] * n
    for at, (node, *_) in enumerate(tree.blocks):
        last[node] = at
    for node in range(n - 1, 0, -1):
        last[tree.parent[node]] = max(last[tree.parent[node]], last[node])
    gone: set[int] = set()
    state = [0 in kept] * n
    for node in range(1, n):  # parents come first
        state[node] = node in kept or state[tree.parent[node]]
    held = [at for at, (node, *_) in enumerate(tree.blocks) if at in loose or state[node]]
    if held:
        starts = (
            at for at in held
            if (b := tree.blocks[at])[2] <= 0.5 * len(b[1]) and (tree.tag[b[0]] in _HEADINGS or len(b[1]) >= _SHORT)
        )
        start = 0 if whole else next(starts, len(tree.blocks))
        for i in range(1, n):
            heavy = tree.tag[i] in _LISTS and anchors[i] > 2 and links[i] > 0.5 * chars[i]
            if tree.parent[i] in gone or i not in kept and heavy and (last[i] < start or tree.doubt[i]):
                gone.add(i)
        held = [at for at in held if tree.blocks[at][0] not in gone]
    return "\n\n".join(tree.blocks[at][1] for at in held)


def _sums(tree: _Tree, blocks: list) -> tuple[list, list, list]:
    """Characters, linked characters and links in each element."""
    n = len(tree.tag)
    chars, links, anchors = [0] * n, [0] * n, [0] * n
    for node, text, linked in blocks:
        chars[node] += len(text)
        links[node] += linked
    for node in range(n - 1, 0, -1):
        anchors[node] += tree.tag[node] == "a"
        for x in (chars, links, anchors):
            x[tree.parent[node]] += x[node]
    return chars, links, anchors


def _beside(tree: _Tree, best: int, score: list, chars: list, links: list, anchors: list, kept: set, loose: set) -> None:
    """Add siblings of the best element to `kept` and text that stands free among them to `loose`."""
    while tree.parent[best] and tree.tag[tree.parent[best]] not in ("body", "html") and chars[tree.parent[best]] == chars[best]:
        best = tree.parent[best]  # nothing else is in what wraps it
    kept.add(best)
    around, child, items = tree.parent[best], [0] * len(tree.tag), []
    for i in range(1, len(tree.tag)):
        child[i] = i if tree.parent[i] == around else child[tree.parent[i]]
    for at, (node, *_) in enumerate(tree.blocks):
        item = child[node] or (-1 - at if node == around else 0)
        if item and not tree.weak[node] and (not items or items[-1] != item):
            items.append(item)
    least = max(10.0, 0.2 * score[best])

    def good(i: int) -> bool:
        if i < 0 or i == best:
            return i == best
        return score[i] >= least or tree.tag[i] == "p" and chars[i] > 80 and links[i] < 0.25 * chars[i]

    chosen = [at for at, i in enumerate(items) if good(i)]
    low, high = chosen[0], chosen[-1]
    found = set(items[low : high + 1])
    for side in (items[:low][::-1], items[high + 1 :]):
        for i in side:
            size, linked = (chars[i], links[i]) if i > 0 else (len(tree.blocks[-1 - i][1]), tree.blocks[-1 - i][2])
            if i > 0 and anchors[i] > 2 and linked > 0.5 * size:
                break
            if linked < size:
                found.add(i)
    kept |= {i for i in found if i > 0}
    loose |= {-1 - i for i in found if i < 0}


def extract(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """`keep`, text and n_chars (code points) of every whole page; repeated rows are read alike.

    NULL pages give an empty text; other columns are ignored. Rows are independent: no shuffle.
    """

    def run(batches):
        import pyarrow as pa

        def one(batch):
            texts = [main_text(x) for x in batch.column("_html").to_pylist()]
            arrays = [batch.column(c) for c in keep]
            arrays += [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "text", "n_chars"])

        yield from in_batches(one)(batches)

    added = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    schema = T.StructType([*[pages.schema[c] for c in keep], *added])
    return pages.select(*keep, F.col(html_column).alias("_html")).mapInArrow(run, schema)
