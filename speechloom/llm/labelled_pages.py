"""The labelled table of op4: pages laid out by rules, so that each block's label is known. A block's first character tells it:
+ for main text, - for all else. Names of classes are left out, or mislead, as often as they help; long notices and comments,
which look like paragraphs, have sure names."""

from __future__ import annotations

import random

PAGES, SEED = 2000, 4
#: Names that surroundings often have, and names inside an article that say nothing against its text.
_NAMES = {
    "nav": ["menu", "main-nav", "navbar"],
    "header": ["masthead", "site-header", "topbar"],
    "ad": ["ad", "advert", "sponsored", "promo"],
    "notice": ["cookie-notice", "consent", "newsletter-signup", "alert"],
    "comments": ["comments", "comment-list", "discussion"],
    "side": ["sidebar", "widget", "related"],
    "footer": ["footer", "site-footer", "copyright"],
}
_SURE = {"notice": ["cookie-notice", "cookieBanner", "gdpr_consent", "newsletter-signup"], "comments": ["comments", "user-comments", "disqus_thread", "comments-area"]}
_HARMLESS = ["warning", "story-comment-policy", "note", "lead", "notice", "alert", "share-of-votes", "figure-caption", "skip-intro"]


class Layout:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def text(self, n: int, mark: str) -> str:
        return mark + " ".join(["word"] * max(1, n))

    def linked(self, n: int, mark: str, share: float) -> str:
        k = round(n * share)
        if k <= 0:
            return self.text(n, mark)
        if k >= n:
            return f"<a href='#'>{self.text(n, mark)}</a>"
        return f"{self.text(n - k, mark)} <a href='#'>{' '.join(['word'] * k)}</a>"

    def size(self) -> int:
        """Of a paragraph: some very short, most middling, some long."""
        return self.r.choice([self.r.randint(1, 8), self.r.randint(6, 30), self.r.randint(20, 70), self.r.randint(60, 220)])

    def box(self, kind: str, inner: str, tag: str) -> str:
        """In its element, in a division with a telling name, or in one without."""
        how = self.r.random()
        if how < 0.4:
            return f"<{tag}>{inner}</{tag}>"
        if how < 0.75:
            return f"<div class='{self.r.choice(_NAMES[kind])}'>{inner}</div>"
        return f"<div>{inner}</div>"

    def links(self, k: int, low: int, high: int) -> str:
        one = lambda: self.linked(self.r.randint(low, high), "-", 1)
        if self.r.random() < 0.6:
            return "<ul>" + "".join(f"<li>{one()}</li>" for _ in range(k)) + "</ul>"
        return "".join(f"<div>{one()}</div>" for _ in range(k))

    def article(self, marked: bool) -> str:
        """marked: in an element of its own, in which whole paragraphs may be links more often."""
        r, out = self.r, []
        linked_head = r.choice([0, 0, 0, 0, 1])
        if r.random() < 0.8:
            out.append(f"<h1>{self.linked(r.randint(1, 14), '+', linked_head)}</h1>")
        tag, brief, linky = r.choice(["p", "p", "p", "div"]), r.random() < 0.2, (r.choice([0.05, 0.05, 0.05, 0.4]) if marked else 0.02)
        for _ in range(r.randint(1, 12)):
            share = r.choice([0, 0, 0, 0, 0, 0.1, 0.3]) if r.random() >= linky else 1
            out.append(f"<{tag}>{self.linked(r.randint(1, 6) if brief else self.size() if share < 1 else r.randint(2, 9), '+', share)}</{tag}>")
            odd = r.random()
            if odd < 0.05:
                out.append(f"<h2>{self.linked(r.randint(1, 8), '+', linked_head)}</h2>")
            elif odd < 0.10:
                out.append("<ul>" + "".join(f"<li>{self.linked(r.randint(1, 15), '+', r.choice([0, 0, 0.3]))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif odd < 0.18:
                out.append(f"<div class='{r.choice(_HARMLESS)}'><p>{self.text(self.size(), '+')}</p></div>")
            elif odd < 0.21:
                out.append(f"<aside><h3>{self.text(2, '-')}</h3>{self.links(3, 3, 9)}</aside>")
            elif odd < 0.24:
                out.append(f"<div class='{r.choice(['ad', 'share', 'related', 'newsletter'])}'>{self.linked(r.randint(3, 25), '-', r.choice([0, 0, 0.5]))}</div>")
            elif odd < 0.27:
                out.append(self.sure(r.choice(["notice", "comments"])))
        return "".join(out)

    def comments(self, most: int = 60) -> str:
        one = lambda: f"<div>{self.linked(self.r.randint(1, 4), '-', 1)}</div><p>{self.text(self.r.randint(3, most), '-')}</p><div>{self.linked(1, '-', 1)}</div>"
        return "".join(one() for _ in range(self.r.randint(1, 5)))

    def sure(self, kind: str) -> str:
        """Long notices and comments."""
        inner = self.comments(220) if kind == "comments" and self.r.random() < 0.5 else "".join(f"<p>{self.text(self.size(), '-')}</p>" for _ in range(self.r.randint(1, 3)))
        return f"<{(tag := self.r.choice(['div', 'section']))} {self.r.choice(['class', 'id'])}='{self.r.choice(_SURE[kind])}'>{inner}</{tag}>"

    def cards(self) -> str:
        """Teasers: each a link around a block or two."""
        one = lambda: f"<a href='#'><div>{self.text(self.r.randint(2, 12), '-')}</div>" + (f"<p>{self.text(self.r.randint(5, 40), '-')}</p>" if self.r.random() < 0.5 else "") + "</a>"
        return "<div>" + "".join(one() for _ in range(self.r.randint(2, 8))) + "</div>"

    def page(self) -> str:
        r, out = self.r, []
        bare = r.choice([1.0, 1.0, 1.0, 1.0, 0.2, 0.0])
        some = lambda p: r.random() < p * bare
        if some(0.5):
            out.append(self.box("header", f"<div>{self.linked(r.randint(1, 5), '-', r.choice([0, 1]))}</div>", "header"))
        if some(0.8):
            out.append(self.box("nav", self.links(r.randint(3, 9), 1, 3), "nav"))
        whole = r.random() < 0.5
        named = lambda kind, inner, tag: self.box(kind, inner, tag) if whole else f"<div class='{r.choice(_NAMES[kind])}'>{inner}</div>"
        if some(0.4):
            out.append(named("ad", self.linked(r.randint(2, 30), "-", r.choice([0, 0, 0.3])), "aside"))
        if some(0.3):
            out.append(named("notice", f"<p>{self.text(r.randint(8, 45), '-')}</p>", "form"))
        if some(0.15):
            out.append(self.sure("notice"))
        if some(0.15):
            out.append(self.cards())
        inner = self.article(whole)
        out.append(f"<article>{inner}</article>" if whole and r.random() < 0.8 else f"<main>{inner}</main>" if whole else f"<div class='content'>{inner}</div>" if r.random() < 0.3 else f"<div>{inner}</div>")
        if some(0.4):
            out.append(self.box("comments", self.comments(), "section") if whole or r.random() < 0.5 else named("comments", self.comments(), "section"))
        if some(0.15):
            out.append(self.sure("comments"))
        if some(0.15):
            out.append(self.cards())
        if some(0.4):
            out.append(self.box("side", f"<h3>{self.text(r.randint(1, 4), '-')}</h3>" + self.links(r.randint(2, 6), 2, 10), "aside"))
        if some(0.2):
            out.append(f"<form><p>{self.text(r.randint(2, 20), '-')}</p></form>")
        if some(0.8):
            out.append(named("footer", self.linked(r.randint(2, 70), "-", r.choice([0, 0, 0.3, 1])), "footer"))
        return "".join(out)


def pages(n: int = PAGES, seed: int = SEED) -> list[str]:
    return [Layout(seed * 1_000_003 + i).page() for i in range(n)]
