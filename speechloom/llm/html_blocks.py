"""Main text of web pages: flat text blocks, their and their neighbours' word counts and link densities, a decision tree.

The page is read once, as a run of tags and texts; no document tree is built. A block is the text between two block-level
tags; a link counts for all blocks it reaches over. Besides the counts, a block has the elements around it (an article,
navigation, a form), whether a name around it is one of surroundings, and whether it is one that hardly anything else has; the
tree is trained on a labelled table in which such names are missing, or (but for the last) mislead, often enough that it goes
by the neighbours too.
"""

from __future__ import annotations

import html
import re
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechloom.llm.common import bound_batches, map_columns
from speechloom.llm.decision_tree import DecisionTree

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD_PART = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")

# Elements of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp template svg object canvas audio video select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math q s samp small span strike strong sub sup time tt u var br wbr img mi mn mo mrow msup msub mfrac msqrt mtext semantics".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog noscript button fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Outside an article any part of a name counts, inside one only whole names.
BOILERPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner billboard breadcrumb breadcrumbs byline comment comments complementary consent contentinfo cookie cookies"
    " copyright disclaimer disqus discussion footer footnav gdpr header hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices outbrain overlay pager"
    " pagination paywall popup popover promo promoted promotion recommended related reply replies respond search share sharing sidebar signup sitemap skip social"
    " sponsor sponsored subscribe subscription taboola toc toolbar topbar tracking widget widgets alert".split()
)
WHOLE_NAMES = frozenset("ad ads advert advertisement banner comments comment-list cookie-notice cookies footer hidden menu nav navbar navigation newsletter pagination popup promo related replies share sharing sidebar social sponsored toolbar".split())
#: Parts of names that tell surroundings wherever they stand.
SURE_NAMES = frozenset("ads advert adverts advertisement breadcrumb breadcrumbs comments consent cookie cookies disqus gdpr navbar newsletter outbrain paywall replies sidebar sponsored taboola".split())
PLAIN, NAMED, SURE = 0, 1, 2


class Block:
    __slots__ = ("apart", "heading", "inside", "item", "linked", "named", "text", "words")

    def __init__(self, text: str, linked: int, apart: bool, named: int, inside: bool, heading: bool, item: bool) -> None:
        self.text, self.words = text, text.count(" ") + 1
        self.linked = min(linked, self.words)
        self.apart, self.named, self.inside, self.heading, self.item = apart, named, inside, heading, item


def named_apart(attributes: str, inside: bool) -> int:
    """Whether a class, id or role is a name of surroundings, or surely one."""
    if "=" not in attributes:
        return PLAIN
    values = [(m[1] or m[2] or m[3] or "") for m in _ATTRIBUTE.finditer(attributes)]
    parts = [w.lower() for v in values for w in _WORD_PART.split(v)]
    if not SURE_NAMES.isdisjoint(parts):
        return SURE
    some = any(w.lower() in WHOLE_NAMES for v in values for w in v.split()) if inside else not BOILERPLATE_NAMES.isdisjoint(parts)
    return NAMED if some else PLAIN


def blocks(page: str) -> list[Block]:
    """The flat blocks of a page, in its order. An unclosed comment, script or tag reaches to the end of the page."""
    out: list[Block] = []
    parts: list[str] = []
    linked, in_link, block_tag = 0, False, ""
    #: Whether the open link has an end; one without ends with its block.
    ends, last_end = False, page.lower().rfind("</a")
    #: Open elements: (tag, in one of surroundings, how surely named so, in an article).
    stack: list[tuple[str, bool, int, bool]] = [("", False, PLAIN, False)]

    def close_block() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, linked, *stack[-1][1:], block_tag in HEADINGS, block_tag in ("li", "dd", "dt")))
        parts.clear()
        linked = 0

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            parts.append(text)
            if in_link:
                linked += len(text.split())
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(m[1])
        if tag in RAW and not closing:
            # What is in it is no text; the paragraph around it goes on.
            if not m[3].endswith("/") or tag in ("script", "style", "title", "textarea", "iframe", "select"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag == "a":
            in_link, ends = not closing, at <= last_end
            continue
        if tag in ("br", "wbr", "img", "input"):
            if tag == "br":
                parts.append(" ")
            continue
        _, apart, name, inside = stack[-1]
        named = PLAIN if closing or tag in ("body", "html") else named_apart(m[3], inside)
        if tag in INLINE and not named:
            if closing and any(t == tag for t, *_ in stack[-3:]):
                close_block()
                while stack.pop()[0] != tag:
                    pass
            continue
        close_block()
        block_tag = "" if closing else tag
        in_link = in_link and ends
        if tag in VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        own = tag in BOILERPLATE_TAGS or tag == "header" and not inside
        opens = tag in ("article", "main")
        if own or named or opens or tag in ("div", "section", "header", "ul", "ol", "table", "td", "body", "html", "blockquote"):
            stack.append((tag, apart or own, max(name, named), inside or opens))
    close_block()
    return out


#: What the numbers of a block are, in their order.
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "apart", "named", "surely", "inside", "page_has_article", "heading", "item")


def features(found: list[Block]) -> list[tuple[float, ...]]:
    """For each block: words and link density of itself, the one before and the one after; then its surroundings."""
    base = [(float(b.words), b.linked / b.words) for b in found]
    around = [(0.0, 0.0), *base, (0.0, 0.0)]
    article = float(any(b.inside for b in found))
    return [(*around[i + 1], *around[i], *around[i + 2], float(b.apart), float(b.named > PLAIN), float(b.named == SURE), float(b.inside), article, float(b.heading), float(b.item)) for i, b in enumerate(found)]


def labelled(pages: list[str]) -> tuple[list[tuple[float, ...]], list[int]]:
    """Features and labels of all blocks of pages whose blocks begin with + or -."""
    rows, labels = [], []
    for page in pages:
        found = blocks(page)
        rows += features(found)
        labels += [int(b.text.startswith("+")) for b in found]
    return rows, labels


@cache
def trained() -> DecisionTree:
    from speechloom.llm.labelled_pages import pages

    return DecisionTree(depth=10, least=8).fit(*labelled(pages()))


def main_text(page: str, tree: DecisionTree | None = None, threshold: float = 0.5) -> str:
    found = blocks(page)
    score = (tree or trained()).score
    return "\n\n".join([b.text for b, row in zip(found, features(found), strict=True) if score(row) >= threshold])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, the main text, and its code points. Null, empty and boilerplate-only pages give the empty text; a
    cut-off page gives what it holds; repeated rows are read each for itself; other columns are left out."""
    bound_batches(pages.sparkSession, 512)

    def make(batches):
        tree = trained()
        for b in batches:
            found = [main_text(page, tree) for page in b["html"]]
            yield {"page_id": b["page_id"], "url": b["url"], "text": found, "n_chars": [len(t) for t in found]}

    kept = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return map_columns(kept, "page_id long, url string, text string, n_chars long", make)
