"""Labelled pages for training the extractor: drawn from a seed, in many layouts, every block marked as article or not."""

from __future__ import annotations

import random

_PARTS = "an be co de er fa go hi in ka le mo ne or pa ri se to un ve wa zu é ö ñ ch st ll ght tion ment keit ción eur".split()
_MAIN = [("article", ""), ("article", 'class="post"'), ("main", ""), ("main", 'id="main"'), ("div", 'class="content"'), ("div", 'id="content"'), ("div", 'class="article-body"'), ("div", 'class="post-content entry"'), ("section", 'class="story"'), ("div", 'class="text"'), ("td", 'class="body"'), ("div", 'itemprop="articleBody"'), ("div", 'role="main"')]
_NAV = [("nav", ""), ("nav", 'class="main-nav"'), ("div", 'class="menu"'), ("ul", 'class="menu"'), ("div", 'id="navigation"'), ("div", 'class="breadcrumbs"'), ("div", 'class="navbar"'), ("div", 'role="navigation"'), ("ol", 'class="breadcrumb"')]
_HEAD = [("header", ""), ("header", 'class="site-header"'), ("div", 'id="header"'), ("div", 'class="header"'), ("div", 'class="masthead"'), ("div", 'role="banner"'), ("div", 'class="topbar"')]
_FOOT = [("footer", ""), ("footer", 'class="site-footer"'), ("div", 'id="footer"'), ("div", 'class="footer"'), ("div", 'class="copyright"'), ("div", 'role="contentinfo"'), ("div", 'class="legal"')]
_SIDE = [("aside", ""), ("aside", 'class="sidebar"'), ("div", 'class="sidebar"'), ("div", 'id="sidebar"'), ("div", 'class="widget"'), ("div", 'class="related"'), ("section", 'class="related-posts"'), ("div", 'class="popular"'), ("div", 'class="recommended"'), ("div", 'role="complementary"'), ("div", 'class="toc"')]
_AD = [("div", 'class="ad"'), ("div", 'class="ads"'), ("div", 'class="advert"'), ("div", 'class="advertisement"'), ("div", 'id="ad-top"'), ("div", 'class="sponsored"'), ("div", 'class="promo"'), ("aside", 'class="ad-box"'), ("section", 'class="sponsor"'), ("p", 'class="ad"'), ("div", 'class="banner-ad"')]
_NOTE = [("div", 'class="cookie-notice"'), ("div", 'id="cookie-banner"'), ("div", 'class="consent"'), ("div", 'class="notice"'), ("div", 'class="gdpr"'), ("div", 'role="alert"'), ("div", 'class="alert"'), ("section", 'class="cookies"'), ("div", 'class="popup modal"'), ("div", 'role="dialog"'), ("div", 'class="overlay"'), ("p", 'class="notice"')]
_TALK = [("section", 'class="comments"'), ("div", 'id="comments"'), ("div", 'class="comment-list"'), ("ol", 'class="commentlist"'), ("div", 'class="discussion"'), ("section", 'id="disqus_thread"'), ("div", 'class="replies"'), ("ul", 'class="reader-comments"'), ("div", 'class="comment"')]
_FORM = [("form", ""), ("form", 'class="newsletter"'), ("div", 'class="subscribe"'), ("form", 'class="search"'), ("div", 'class="login"'), ("form", 'id="contact"'), ("div", 'class="signup"')]
_SHARE = [("div", 'class="share"'), ("ul", 'class="social"'), ("div", 'class="tags"'), ("p", 'class="byline meta"'), ("div", 'class="author-bio"'), ("div", 'class="pagination"')]


class Page:
    """Builds one page; ``blocks`` are (label, text) in page order."""

    def __init__(self, seed: int):
        self.rng, self.out, self.blocks = random.Random(seed), [], []

    def words(self, low: int, high: int) -> str:
        r = self.rng
        words = ["".join(r.choice(_PARTS) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        for i in range(len(words)):
            if r.random() < 0.1 and i + 1 < len(words):
                words[i] += r.choice([",", ".", ",", ";"])
        return " ".join(words).capitalize()

    def sentence(self, low: int, high: int) -> str:
        return self.words(low, high) + self.rng.choice([".", ".", ".", ".", "", "!", "?"])

    def block(self, tag: str, label: int, text: str, attrs: str = "", link: bool = False) -> None:
        r = self.rng
        inner = f'<a href="/{r.randint(1, 99)}">{text}</a>' if link else text
        if not link and r.random() < 0.15 and " " in text:
            a, b = text.split(" ", 1)
            inner = f"<{(t := r.choice(['b', 'em', 'i', 'strong', 'span', 'a href=#']))}>{a}</{t.split()[0]}> {b}"
        if not link and tag == "p" and r.random() < 0.05:
            inner = "<b>" + inner + "<br>"
        close = "" if tag in ("p", "li") and r.random() < 0.15 else f"</{tag}>"
        self.out.append(f"<{tag}{' ' + attrs if attrs else ''}>{inner}{close}")
        self.blocks.append((label, text))

    def box(self, kinds, fill) -> None:
        tag, attrs = self.rng.choice(kinds)
        self.out.append(f"<{tag}{' ' + attrs if attrs else ''}>")
        fill(tag)
        self.out.append(f"</{tag}>")

    def bare(self, text: str, label: int = 0) -> None:
        self.out.append(text)
        self.blocks.append((label, text))

    def links(self, tag: str) -> None:
        r = self.rng
        inner = tag in ("ul", "ol") or r.random() < 0.7
        if inner and tag not in ("ul", "ol"):
            self.out.append("<ul>")
        for _ in range(r.randint(2, 8)):
            self.block("li" if inner else "p", 0, self.words(1, 4), link=r.random() < 0.9)
        if inner and tag not in ("ul", "ol"):
            self.out.append("</ul>")

    def prose(self, tag: str) -> None:
        r = self.rng
        if tag in ("ul", "ol"):
            for _ in range(r.randint(1, 5)):
                self.block("li", 0, self.sentence(2, 40))
        elif tag == "p" or r.random() < 0.35:
            self.bare(self.sentence(2, 25))
        else:
            if r.random() < 0.4:
                self.block(r.choice(["h2", "h3", "h4"]), 0, self.words(1, 4))
            for _ in range(r.randint(1, 4)):
                self.block(r.choice(["p", "p", "div"]), 0, self.sentence(2, 45))

    def asks(self, tag: str) -> None:
        r = self.rng
        self.block(r.choice(["p", "h3", "label"]), 0, self.words(1, 6))
        if r.random() < 0.6:
            self.out.append('<input type="text"><button>')
            self.bare(self.words(1, 2))
            self.out.append("</button>")

    def article(self, tag: str) -> None:
        r = self.rng
        if r.random() < 0.85:
            if r.random() < 0.15:
                self.out.append("<header>")
                self.block("h1", 1, self.words(2, 14))
                self.out.append("</header>")
            else:
                self.block(r.choice(["h1", "h1", "h2"]), 1, self.words(1, 14) + r.choice(["", "."]))
        if r.random() < 0.15:
            self.box(_SHARE, lambda t: self.bare(self.words(1, 6)) if t not in ("ul",) else self.links(t))
        for _ in range(r.choice([1, 2, 3, 5, 8, 13])):
            kind = r.random()
            if kind < 0.78:
                self.block("p", 1, self.sentence(*r.choice([(1, 3), (3, 12), (10, 40), (30, 120)])))
            elif kind < 0.86:
                self.block(r.choice(["h2", "h3"]), 1, self.words(1, 8))
            elif kind < 0.90:
                self.out.append("<ul>")
                for _ in range(r.randint(1, 5)):
                    self.block("li", 1, self.sentence(2, 20))
                self.out.append("</ul>")
            elif kind < 0.94:
                self.block(r.choice(["blockquote", "pre", "div"]), 1, self.sentence(4, 50))
            elif kind < 0.97:
                self.box(_AD, self.prose)
            elif kind < 0.985:
                self.box(_SIDE, self.prose)
            else:
                self.box(_FORM, self.asks)
        if r.random() < 0.12:
            self.box(_TALK, self.prose)
        if r.random() < 0.1:
            self.box(_SHARE, self.links)

    def build(self) -> str:
        r = self.rng
        self.out.append(f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style></head><body>")
        if r.random() < 0.3:
            self.box(_NOTE, self.prose)
        if r.random() < 0.5:
            self.box(_HEAD, lambda t: (self.block(r.choice(["h1", "p", "div", "h2"]), 0, self.words(1, 5)), self.box(_NAV, self.links) if r.random() < 0.5 else None))
        for _ in range(r.randint(0, 2)):
            self.box(_NAV, self.links)
        for kinds, fill, p in ((_AD, self.prose, 0.5), (_SIDE, self.prose, 0.2), (_FORM, self.asks, 0.2), (_NOTE, self.prose, 0.1)):
            if r.random() < p:
                self.box(kinds, fill)
        wrap = r.random() < 0.3
        if wrap:
            self.out.append(f"<div {r.choice(['class=wrapper', 'id=page', 'class=container', 'class=row'])}>")
        self.box(_MAIN, self.article)
        if wrap:
            self.out.append("</div>")
        for kinds, fill, p in ((_TALK, self.prose, 0.4), (_SIDE, self.prose, 0.3), (_SIDE, self.links, 0.3), (_AD, self.prose, 0.3), (_FORM, self.asks, 0.3), (_NOTE, self.prose, 0.2), (_SHARE, self.links, 0.2)):
            if r.random() < p:
                self.box(kinds, fill)
        if r.random() < 0.8:
            self.box(_FOOT, lambda t: self.prose("p") if r.random() < 0.6 else (self.links(t) if r.random() < 0.5 else self.prose(t)))
        if r.random() < 0.85:
            self.out.append("</body></html>")
        return "".join(self.out)


def labelled_pages(count: int, seed: int = 1) -> list[tuple[str, list[tuple[int, str]]]]:
    """``count`` pages as (html, [(label, text)])."""
    pages = []
    for i in range(count):
        page = Page(seed * 1_000_003 + i)
        pages.append((page.build(), page.blocks))
    return pages
