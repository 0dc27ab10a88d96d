"""Labelled pages for training the extractor, made from a seed.

The corpus has no labels for its pages, so these stand in: pages of many layouts whose
blocks carry `data-y="1"` (main text) or `data-y="0"` (anything else). The extractor's
features never look at that attribute.
"""

from __future__ import annotations

import random

SYLLABLES = "an ar be con de el en er es in la le lo ma mi no or pa ra re ri sa se ta te ti to un ver".split()


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choices(SYLLABLES, k=self.r.choice((1, 1, 2, 2, 3, 4))))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(a, b)))

    def sentence(self, a: int = 5, b: int = 18) -> str:
        return self.words(a, b).capitalize() + self.r.choice((".", ".", ".", "!", "?"))

    def prose(self, a: int = 1, b: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(a, b)))

    def link(self, a: int = 1, b: int = 3) -> str:
        return f'<a href="/{self.word()}">{self.words(a, b)}</a>'

    def tag(self, name: str, body: str, attr: str = "", y: int | None = None) -> str:
        mark = "" if y is None else f' data-y="{y}"'
        return f"<{name}{' ' + attr if attr else ''}{mark}>{body}</{name}>"

    def named(self, *names: str) -> str:
        """A class or id of one of the names, alone, joined with another word, or among others."""
        n = self.r.choice(names)
        n = self.r.choice((n, n, n, f"{n}-{self.word()}", f"{self.word()}_{n}", f"{n} {self.word()}"))
        return f'{self.r.choice(("class", "class", "id"))}="{n}"'

    # --- main text

    def paragraph(self) -> str:
        text = self.prose()
        k = self.r.random()
        if k < 0.15:
            return f'<p data-y="1"><b>{self.sentence()}<br>'  # tags left open
        if k < 0.3:
            text = text.replace(" ", f" {self.link()} ", 1)
        elif k < 0.4:
            text = f"<em>{self.words(1, 3)}</em> {text}"
        return self.tag("p", text, y=1)

    def main_block(self) -> str:
        k = self.r.random()
        if k < 0.74:
            return self.paragraph()
        if k < 0.8:
            return self.tag("ul", "".join(self.tag("li", self.sentence(3, 12), y=1) for _ in range(self.r.randint(2, 6))))
        if k < 0.86:
            return self.tag(self.r.choice(("h2", "h3")), self.words(2, 6), y=1)
        if k < 0.9:
            return self.tag("blockquote", self.tag("p", self.prose(1, 3), y=1))
        if k < 0.93:
            return self.tag("table", "".join(self.tag("tr", "".join(self.tag("td", self.words(1, 4), y=1) for _ in range(3))) for _ in range(3)))
        if k < 0.96:
            return self.tag("pre", self.prose(1, 2), y=1)
        return self.tag("div", self.prose(1, 3), y=1)

    def noise_inside(self) -> str:
        kind = self.r.choice(("ad", "aside", "share", "related", "form", "toc"))
        if kind == "ad":
            return self.ad()
        if kind == "aside":
            return self.tag("aside", self.tag("p", self.prose(1, 2), y=0), self.r.choice(("", self.named("related", "widget", "promo"))))
        if kind == "share":
            return self.tag("div", " ".join(self.link() for _ in range(3)), self.named("share", "social", "follow"), y=0)
        if kind == "related":
            return self.tag("div", self.tag("ul", "".join(self.tag("li", self.link(2, 7), y=0) for _ in range(4))), self.named("related", "recommended", "more", "trending"))
        if kind == "toc":
            return self.tag("nav", self.tag("ol", "".join(self.tag("li", self.link(1, 4), y=0) for _ in range(3))))
        return self.form()

    def main(self) -> str:
        r = self.r
        blocks = [self.tag(r.choice(("h1", "h1", "h2")), self.words(2, 9), y=1)] if r.random() < 0.85 else []
        for _ in range(r.choice((1, 1, 2, 4, 8, 15, 25))):
            blocks.append(self.main_block())
            if r.random() < 0.06:
                blocks.append(self.noise_inside())
        body = "".join(blocks)
        if r.random() < 0.2:
            body = self.tag("header", self.tag("p", self.words(2, 6), y=1)) + body if r.random() < 0.3 else body
        k = r.random()
        if k < 0.5:
            body = self.tag("article", body, r.choice(("", "", self.named("post", "article", "entry"))))
        elif k < 0.65:
            body = self.tag("main", body, r.choice(("", 'role="main"')))
        elif k < 0.9:
            body = self.tag("div", body, self.named("content", "post", "article", "entry", "story", "body", "main"))
        else:
            body = self.tag(r.choice(("div", "section")), body)
        for _ in range(r.choice((0, 0, 1, 2))):
            body = self.tag(r.choice(("div", "section", "main")), body, r.choice(("", self.named("wrapper", "container", "page", "content"))))
        return body

    # --- the rest

    def ad(self) -> str:
        return self.tag(self.r.choice(("div", "div", "aside", "section")), self.r.choice((self.prose(1, 3), self.tag("p", self.prose(1, 3), y=0), self.link(2, 6))), self.named("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner"), y=0)

    def form(self) -> str:
        return self.tag("form", self.tag("label", self.words(1, 4), y=0) + '<input name="q">' + self.tag("p", self.sentence(3, 10), y=0) + self.tag("button", self.word(), y=0), self.r.choice(("", self.named("search", "login", "newsletter", "subscribe"))))

    def nav(self) -> str:
        items = "".join(self.tag("li", self.link(), y=0) for _ in range(self.r.randint(3, 9)))
        k = self.r.random()
        if k < 0.5:
            return self.tag("nav", self.tag("ul", items))
        if k < 0.8:
            return self.tag(self.r.choice(("div", "ul")), items, self.named("nav", "menu", "navbar", "navigation", "breadcrumb"))
        return self.tag("div", " | ".join(self.link() for _ in range(5)), self.named("menu", "nav", "topbar"), y=0)

    def header(self) -> str:
        body = self.tag(self.r.choice(("h1", "p", "div", "h2")), self.words(1, 5), y=0) + (self.tag("p", self.sentence(), y=0) if self.r.random() < 0.5 else "")
        return self.tag("header", body) if self.r.random() < 0.6 else self.tag("div", body, self.named("header", "masthead", "site-header", "top", "brand"))

    def footer(self) -> str:
        body = self.r.choice((f"&copy; {self.word()}.example.com &middot; {self.sentence()}", self.tag("p", f"&copy; {self.prose(1, 3)}", y=0), self.tag("ul", "".join(self.tag("li", self.link(), y=0) for _ in range(4)))))
        return self.tag("footer", body, y=0) if self.r.random() < 0.65 else self.tag("div", body, self.named("footer", "copyright", "legal", "bottom"), y=0)

    def sidebar(self) -> str:
        parts = [self.tag("h3", self.words(1, 3), y=0), self.tag("p", self.prose(1, 4), y=0), self.tag("ul", "".join(self.tag("li", self.link(1, 6), y=0) for _ in range(4)))]
        body = "".join(self.r.sample(parts, self.r.randint(1, 3)))
        return self.tag("aside", body, self.r.choice(("", self.named("sidebar")))) if self.r.random() < 0.5 else self.tag("div", body, self.named("sidebar", "side", "rail", "widget", "related"))

    def notice(self) -> str:
        body = self.r.choice((self.prose(1, 3), self.tag("p", self.prose(1, 3), y=0) + self.tag("button", "ok", y=0)))
        return self.tag(self.r.choice(("div", "div", "section", "aside")), body, self.named("cookie", "notice", "consent", "alert", "popup", "modal", "gdpr", "cookie-banner"), y=0)

    def comments(self) -> str:
        one = lambda: self.tag(self.r.choice(("div", "li", "article")), self.tag("p", self.prose(1, 5), y=0), self.r.choice(("", self.named("comment", "reply"))))
        body = self.tag("h3", self.words(1, 3), y=0) + "".join(one() for _ in range(self.r.randint(1, 5)))
        return self.tag(self.r.choice(("section", "div", "ol")), body, self.named("comments", "comment-list", "discussion", "responses", "replies", "disqus"))

    def page(self) -> str:
        r = self.r
        before = [f() for f, p in ((self.header, 0.5), (self.nav, 0.8), (self.notice, 0.35), (self.ad, 0.5), (self.form, 0.15), (self.sidebar, 0.2)) if r.random() < p]
        after = [f() for f, p in ((self.comments, 0.45), (self.sidebar, 0.35), (self.ad, 0.35), (self.form, 0.25), (self.nav, 0.15), (self.notice, 0.25), (self.footer, 0.85)) if r.random() < p]
        r.shuffle(before)
        r.shuffle(after[:-1])
        body = "".join((*before, self.main(), *after))
        if r.random() < 0.2:
            body = self.tag("div", body, self.named("page", "wrapper", "site"))
        return f'<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><script>var a = "<p>";</script></head><body>{body}</body></html>'


def sample_pages(n: int, seed: int = 11) -> list[str]:
    return [_Page(seed * 1_000_003 + k).page() for k in range(n)]
