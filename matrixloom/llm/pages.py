"""Labelled pages for training the HTML extraction: a seeded generator.

Pages are put together from the parts that sites have (bars, menus, notices,
adverts, articles, sidebars, forms, comments, footers), each in several ways of
marking it up: by HTML5 elements, by classes or by ids.  Each part's blocks are
labelled as main text or not.
"""

from __future__ import annotations

import random

#: Names that sites give to their parts' elements.
NAMES = {
    "article": ["article", "post", "entry", "entry-content", "post-content", "article-body", "story", "story-body", "content", "main-content", "post-body", "text", "page-content"],
    "wrapper": ["container", "wrapper", "page", "row", "col", "inner", "layout", "grid", "site", "wrap", ""],
    "menu": ["nav", "menu", "navbar", "navigation", "main-menu", "nav-links", "breadcrumb", "breadcrumbs", "tabs", "pagination"],
    "header": ["header", "site-header", "masthead", "topbar", "top-bar", "page-header", "branding", "logo"],
    "footer": ["footer", "site-footer", "page-footer", "bottom", "copyright", "colophon", "legal", "footer-links"],
    "advert": ["ad", "ads", "advert", "advertisement", "ad-slot", "banner-ad", "sponsored", "sponsor", "promo", "adsbygoogle", "promotion"],
    "sidebar": ["sidebar", "side-bar", "widget", "widget-area", "related", "related-posts", "rail", "recommended", "popular", "tags", "share", "social", "more-stories"],
    "notice": ["cookie", "cookie-banner", "consent", "cookie-notice", "gdpr", "notice", "alert", "notification", "banner", "popup", "modal", "paywall", "message"],
    "form": ["form", "newsletter", "subscribe", "search", "search-form", "login", "signup", "contact-form", "subscribe-box"],
    "comments": ["comments", "comment-list", "commentlist", "comment-thread", "disqus", "disqus_thread", "responses", "replies", "discussion", "reader-comments"],
    "comment": ["comment", "comment-body", "reply", "comment-content", "comment-text", "user-comment"],
}


class Page:
    def __init__(self, rng: random.Random):
        self.rng, self.out, self.labels = rng, [], []

    def words(self, low: int, high: int, dots: bool) -> str:
        rng = self.rng
        said = []
        for _ in range(rng.randint(low, high)):
            w = "".join(rng.choice(["th", "er", "on", "an", "re", "in", "ti", "es", "ou", "é", "ä", "ó", "ch", "la"]) for _ in range(rng.randint(1, 4)))
            said.append(w + (rng.choice([".", ",", ",", ";"]) if dots and rng.random() < 0.12 else ""))
        text = " ".join(said).capitalize()
        return text + "." if dots and rng.random() < 0.9 else text

    def block(self, tag: str, text: str, label: int, attrs: str = "") -> None:
        self.out.append(f"<{tag}{attrs}>{text}" + ("" if tag in ("p", "li") and self.rng.random() < 0.1 else f"</{tag}>"))
        self.labels.append(label)

    def attrs(self, kind: str, role: str = "") -> str:
        name = self.rng.choice(NAMES[kind])
        if not name:
            return ""
        if self.rng.random() < 0.3:
            name += " " + self.rng.choice(["clearfix", "full-width", "mt-4", "js-block", "x1", "large"])
        return f' {self.rng.choice(["class", "class", "id"])}="{name}"' + (f' role="{role}"' if role and self.rng.random() < 0.3 else "")

    def element(self, tag: str, kind: str, role: str = "") -> tuple[str, str]:
        """An element's tags: of HTML5 with or without a name, or a named div."""
        if tag and self.rng.random() < 0.5:
            attrs = self.attrs(kind, role) if self.rng.random() < 0.4 else ""
            return f"<{tag}{attrs}>", f"</{tag}>"
        plain = self.rng.choice(["div", "div", "section"])
        return f"<{plain}{self.attrs(kind, role)}>", f"</{plain}>"

    def within(self, ends: tuple[str, str], inside) -> None:
        self.out.append(ends[0])
        inside()
        self.out.append(ends[1])

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/x">{self.words(low, high, False)}</a>'

    def menu(self) -> None:
        def items():
            listed = self.rng.random() < 0.7
            for _ in range(self.rng.randint(2, 8)):
                self.block("li" if listed else "div", self.link(), 0)

        self.within(self.element("nav", "menu", "navigation"), lambda: self.within(("<ul>", "</ul>"), items))

    def header(self) -> None:
        def inside():
            self.block(self.rng.choice(["h1", "h2", "p", "div"]), self.words(1, 4, False), 0)
            if self.rng.random() < 0.4:
                self.block("p", self.words(3, 10, True), 0)
            if self.rng.random() < 0.4:
                self.menu()

        self.within(self.element("header", "header", "banner"), inside)

    def footer(self) -> None:
        def inside():
            self.block(self.rng.choice(["p", "div"]), "&copy; " + self.words(2, 25, True), 0)
            for _ in range(self.rng.randint(0, 4)):
                self.block(self.rng.choice(["li", "div"]), self.link(), 0)
            if self.rng.random() < 0.3:
                self.block("p", self.words(8, 40, True), 0)

        self.within(self.element("footer", "footer", "contentinfo"), inside)

    def advert(self) -> None:
        def inside():
            for _ in range(self.rng.randint(1, 2)):
                self.block(self.rng.choice(["p", "div"]), self.words(2, 30, True), 0)

        self.within(self.element("aside" if self.rng.random() < 0.2 else "", "advert"), inside)

    def sidebar(self) -> None:
        def inside():
            for _ in range(self.rng.randint(1, 3)):
                self.block(self.rng.choice(["h3", "h4"]), self.words(1, 4, False), 0)
                for _ in range(self.rng.randint(1, 5)):
                    self.block(self.rng.choice(["li", "p"]), self.link(2, 9) if self.rng.random() < 0.7 else self.words(5, 30, True), 0)

        self.within(self.element("aside", "sidebar", "complementary"), inside)

    def notice(self) -> None:
        def inside():
            self.block(self.rng.choice(["p", "div"]), self.words(5, 40, True), 0)
            if self.rng.random() < 0.5:
                self.block("button", self.words(1, 2, False), 0)

        self.within(self.element("", "notice", self.rng.choice(["alert", "dialog"])), inside)

    def form(self) -> None:
        def inside():
            self.block(self.rng.choice(["h3", "p", "legend"]), self.words(2, 20, True), 0)
            for _ in range(self.rng.randint(1, 3)):
                self.block("label", self.words(1, 3, False), 0)
                self.out.append('<input type="text">')
            self.block("button", self.words(1, 2, False), 0)

        if self.rng.random() < 0.7:
            self.within((f"<form{self.attrs('form') if self.rng.random() < 0.5 else ''}>", "</form>"), inside)
        else:
            self.within(self.element("", "form"), inside)

    def comments(self) -> None:
        def one():
            self.block(self.rng.choice(["h4", "div", "p"]), self.words(1, 3, False), 0)
            for _ in range(self.rng.randint(1, 2)):
                self.block("p", self.words(4, 80, True), 0)

        def inside():
            if self.rng.random() < 0.7:
                self.block("h3", self.words(1, 3, False), 0)
            for _ in range(self.rng.randint(1, 4)):
                tag = self.rng.choice(["article", "div", "li", "div"])
                self.within((f"<{tag}{self.attrs('comment')}>", f"</{tag}>"), one)

        self.within(self.element("", "comments"), inside)

    def article(self) -> None:
        def inside():
            if self.rng.random() < 0.85:
                self.block(self.rng.choice(["h1", "h1", "h2"]), self.words(1, 12, False), 1)
            for i in range(self.rng.randint(1, 14)):
                kind = self.rng.random()
                if kind < 0.72:
                    text = self.words(1, 120, True)
                    if self.rng.random() < 0.3:
                        text = f"<b>{text}</b>" if self.rng.random() < 0.5 else f"<b>{text}<br>"
                    if self.rng.random() < 0.2:
                        text += f" {self.link()} {self.words(1, 9, True)}"
                    self.block("p", text, 1)
                elif kind < 0.82:
                    self.block(self.rng.choice(["h2", "h3"]), self.words(1, 8, False), 1)
                elif kind < 0.88:
                    for _ in range(self.rng.randint(1, 4)):
                        self.block("li", self.words(2, 20, True), 1)
                elif kind < 0.92:
                    self.block(self.rng.choice(["blockquote", "pre", "figcaption", "td"]), self.words(3, 40, True), 1)
                elif kind < 0.95 and i:
                    self.advert()
                elif kind < 0.97 and i:
                    self.form()
                elif i:
                    self.sidebar()

        bare = self.rng.random() < 0.06
        self.within(("", "") if bare else self.element("article" if self.rng.random() < 0.8 else "main", "article", "main"), inside)

    def page(self) -> tuple[str, list[int]]:
        rng = self.rng
        if rng.random() < 0.7:
            self.out.append("<!DOCTYPE html><html><head><title>")
            self.out.append(self.words(1, 9, False) + "</title><style>p{}</style><script>var a='<p>';</script></head><body>")
            self.labels.append(0)
        more = rng.random() > 0.15  # other pages have nothing but their article
        for part, chance in ((self.notice, 0.3), (self.header, 0.6), (self.menu, 0.7), (self.advert, 0.5)):
            if more and rng.random() < chance:
                part()
        depth = rng.randint(0, 2)
        for _ in range(depth):
            self.out.append(f"<div{self.attrs('wrapper')}>")
        if more and rng.random() < 0.25:
            self.sidebar()
        self.article()
        for part, chance in ((self.advert, 0.3), (self.comments, 0.4), (self.sidebar, 0.4), (self.form, 0.3)):
            if more and rng.random() < chance:
                part()
        self.out.append("</div>" * depth)
        for part, chance in ((self.notice, 0.15), (self.footer, 0.85)):
            if more and rng.random() < chance:
                part()
        self.out.append("</body></html>" if rng.random() < 0.9 else "")
        return "".join(self.out), self.labels


def labelled(count: int, seed: int) -> list[tuple[str, list[int]]]:
    return [Page(random.Random(seed * 1_000_003 + i)).page() for i in range(count)]
