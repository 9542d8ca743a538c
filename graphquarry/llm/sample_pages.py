"""Pages with known main text, made from a seed: layouts of many kinds, for fitting and testing the page classifier.

An element with data-main="1" holds main text, one with data-main="0" within it doesn't; other elements inherit. Words are
made from syllables, so that a classifier can learn nothing from the language.
"""

from __future__ import annotations

import random

#: Attribute values by what an element is for.
NAMES = {
    "menu": ["nav", "main-nav", "menu", "navbar", "site-nav", "topmenu", "breadcrumbs", "navigation", "primary-menu", "pagination"],
    "header": ["header", "site-header", "masthead", "top", "page-header", "banner", "topbar"],
    "footer": ["footer", "site-footer", "foot", "page-footer", "bottom", "colophon", "legal"],
    "aside": ["sidebar", "aside", "widget", "widget-area", "secondary", "rail", "right-column", "sidebar-right"],
    "notice": ["cookie-notice", "cookie-banner", "consent", "notice", "alert", "gdpr", "popup", "modal", "cookie-bar", "privacy-notice"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "adBox", "sponsor-block", "promotion"],
    "form": ["search", "newsletter", "subscribe", "signup", "login-form", "contact-form", "search-form"],
    "comment": ["comments", "comment-list", "commentlist", "disqus_thread", "responses", "comment-section", "reader-comments", "discussion"],
    "related": ["related", "share", "social", "related-posts", "recommended", "more-stories", "tags", "share-buttons", "popular"],
    "content": ["content", "article", "post", "entry-content", "article-body", "story", "post-body", "main-content", "text", "page-content"],
    "wrap": ["wrapper", "container", "page", "layout", "row", "grid", "inner", "site"],
}
TAGS = {"menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "content": "article"}
ENTITIES = ["&amp;", "&eacute;", "&#8217;", "&mdash;", "&nbsp;", "&lt;", "&copy;"]


class Pages:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        chars = self.r.choice(["aeiou", "aeiouäöü", "aeiouéèà", "áéíóú", "あいうえお"])
        self.syllables = [a + b for a in "bdfgklmnprstvz" for b in chars]

    def some(self, p: float) -> bool:
        return self.r.random() < p

    def word(self) -> str:
        return "".join(self.r.choice(self.syllables) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def name(self, low: int, high: int) -> str:
        """A few words that may look like a sentence."""
        words = self.words(low, high)
        return self.r.choice([words, words, words.capitalize(), words.capitalize(), words + self.r.choice(".:!,"), self.sentence(low, high)])

    def sentence(self, low: int = 4, high: int = 22) -> str:
        words = self.words(low, high).split(" ")
        if self.some(0.1):
            words[self.r.randrange(len(words))] = self.r.choice(ENTITIES)
        if self.some(0.4):
            words[self.r.randrange(len(words))] += ","
        return " ".join(words).capitalize() + self.r.choice(".....!?")

    def prose(self, low: int, high: int) -> str:
        text = " ".join(self.sentence(self.r.choice([1, 4, 8])) for _ in range(self.r.randint(low, high)))
        return text[:-1] if self.some(0.06) else text

    def rich(self, text: str) -> str:
        """Inline markup at random places."""
        words = text.split(" ")
        for _ in range(self.r.choice([0, 0, 1, 2])):
            k = self.r.randrange(len(words))
            tag = self.r.choice(["b", "i", "em", "strong", 'a href="/x"', "span", "code", 'span class="hl"'])
            words[k] = f"<{tag}>{words[k]}</{tag.split(' ')[0]}>"
        if self.some(0.05):
            words[self.r.randrange(len(words))] += "<br>"
        return " ".join(words)

    def element(self, role: str, inner: str, main: int | None = None, named: float = 0.75, tagged: float = 0.5) -> str:
        tag = TAGS.get(role, "div") if self.some(tagged) else self.r.choice(["div", "div", "section"])
        attrs = ""
        if self.some(named if tag in ("div", "section") else 0.4):
            attrs = f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(NAMES[role])}{self.r.choice(["", "", " x1", " c-" + self.word()])}"'
        elif self.some(0.3):
            attrs = f' class="css-{self.word()}"'
        if main is not None:
            attrs += f' data-main="{main}"'
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.word()}">{self.name(low, high)}</a>'

    def links(self, low: int, high: int, long: bool = False) -> str:
        items = [self.link(3, 9) if long else self.link() for _ in range(self.r.randint(low, high))]
        if self.some(0.7):
            end = "" if self.some(0.1) else "</li>"
            return "<ul>" + "".join(f"<li>{x}{end}" for x in items) + "</ul>"
        return self.r.choice([" ", " | ", " &middot; "]).join(items)

    def advert(self) -> str:
        inner = self.r.choice([self.sentence(3, 12), self.sentence(3, 9) + self.link(), f'<img src="x.png"> {self.words(2, 5)}', f"<p>{self.prose(1, 2)}</p>", self.link(2, 6)])
        return self.r.choice(["", "<!-- ad -->"]) + self.element("advert", inner, 0, named=0.95)

    def form(self) -> str:
        inner = f'<label>{self.words(1, 3)}</label><input type="text" placeholder="{self.word()}"><button>{self.words(1, 2)}</button>'
        return self.element("form", (f"<p>{self.sentence()}</p>" if self.some(0.5) else "") + inner, 0, tagged=0.8)

    def notice(self) -> str:
        return self.element("notice", self.r.choice([f"<p>{self.prose(1, 3)}</p>", self.prose(1, 2) + " "]) + self.r.choice(["<button>Ok</button>", self.link(), ""]), 0, named=0.97)

    def related(self) -> str:
        head = f"<h3>{self.name(1, 3)}</h3>" if self.some(0.6) else ""
        return self.element("related", head + self.links(2, 6, self.some(0.6)), 0, named=0.9)

    def comments(self) -> str:
        def one() -> str:
            text = self.prose(1, 4)
            who = self.r.choice([f'<span class="author">{self.word()}</span> ', f"<b>{self.word()}</b>: ", f'<div class="comment-meta">{self.words(1, 3)}</div>', ""])
            body = f"<p>{text}</p>" if self.some(0.7) else text
            return self.r.choice([f"<li>{who}{body}</li>", f'<div class="comment">{who}{body}</div>', f'<article class="comment">{who}{body}</article>', f"<div>{who}{body}</div>"])

        head = f"<h3>{self.name(1, 2)}</h3>" if self.some(0.7) else ""
        return self.element("comment", head + "".join(one() for _ in range(self.r.randint(1, 8))) + (self.form() if self.some(0.4) else ""), 0, named=0.97)

    def block(self) -> str:
        """A piece of an article."""
        kind = self.r.random()
        if kind < 0.68:
            return f"<p>{self.rich(self.prose(1, 6))}" + ("" if self.some(0.05) else "</p>")
        if kind < 0.76:
            level = self.r.choice([2, 2, 3])
            return f"<h{level}>{self.name(1, 7)}</h{level}>"
        if kind < 0.83:
            tag = self.r.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{self.rich(self.sentence(2, 14))}</li>" for _ in range(self.r.randint(2, 6))) + f"</{tag}>"
        if kind < 0.87:
            return f"<blockquote>{self.r.choice(['<p>', ''])}{self.prose(1, 2)}</blockquote>"
        if kind < 0.90:
            rows = "".join("<tr>" + "".join(f"<td>{self.words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(self.r.randint(2, 5)))
            return f"<table>{rows}</table>"
        if kind < 0.93:
            return f"<pre>{self.words(2, 4)}\n  {self.words(2, 6)}</pre>"
        if kind < 0.96:
            return f'<figure><img src="a.jpg"><figcaption>{self.sentence(2, 9)}</figcaption></figure>'
        return f"<div>{self.rich(self.prose(1, 4))}</div>"

    def article(self) -> str:
        size = self.r.choice([1, 1, 2, 3, 5, 8, 14, 30])
        title = f"<h1>{self.name(2, 12)}</h1>"
        by = self.r.choice(["", "", f'<p class="byline">{self.words(1, 3)}</p>', f"<time>{self.r.randint(1, 28)}. 4. 2021</time>", f'<div class="meta">{self.words(2, 4)}</div>'])
        head = self.r.choice([title + by, f"<header>{title}{by}</header>", by, ""]) if size < 30 else title
        if self.some(0.08):  # lines without paragraphs
            blocks = [self.prose(1, 4) + self.r.choice(["<br>", "<br><br>\n"]) for _ in range(size)]
        else:
            blocks = [self.block() for _ in range(size)]
        if not head and not any("." in b for b in blocks):
            blocks.append(f"<p>{self.prose(1, 3)}</p>")
        for make, p in ((self.advert, 0.2), (self.related, 0.12), (self.form, 0.06)):
            if size > 1 and self.some(p):
                blocks.insert(self.r.randint(1, len(blocks)), make())
        tail = self.related() if self.some(0.15) else ""
        inner = head + "".join(blocks)
        if self.some(0.15):  # the text in a box of its own
            inner = head + self.element("content", "".join(blocks), tagged=0.1)
        return self.element("content", inner + tail, 1, named=0.7, tagged=0.55)

    def sidebar(self) -> str:
        def widget() -> str:
            body = self.r.choice([self.links(2, 8, self.some(0.5)), f"<p>{self.prose(1, 3)}</p>", self.form(), self.advert()])
            tag, level = self.r.choice(["div", 'div class="widget"', "section"]), self.r.choice([2, 3, 4])
            return f"<{tag}><h{level}>{self.name(1, 3)}</h{level}>{body}</{tag.split(' ')[0]}>"

        return self.element("aside", "".join(widget() for _ in range(self.r.randint(1, 4))), 0, named=0.92)

    def page(self) -> str:
        r = self.r
        site = r.choice([f'<div class="logo">{self.words(1, 2)}</div>', f"<h1>{self.words(1, 2)}</h1>", f"<a href='/'>{self.words(1, 2)}</a>", f"<p>{self.words(2, 6)}</p>"])
        menu = lambda: self.element("menu", self.links(3, 9), 0, tagged=0.6, named=0.85)
        top = "" if self.some(0.2) else r.choice([menu(), self.element("header", site + menu(), 0), self.element("header", site, 0) + menu(), menu() + self.advert()])
        foot = "" if self.some(0.12) else self.element("footer", r.choice(["&copy; ", "© 2024 ", ""]) + r.choice([self.words(1, 4), self.sentence(), f"{self.word()}.example.com &middot; {self.sentence()}", self.links(2, 8), f"<p>{self.prose(1, 2)}</p>{self.links(2, 5)}"]), 0, tagged=0.6, named=0.92)
        body = self.article() + (self.comments() if self.some(0.3) else "") + (self.related() if self.some(0.2) else "")
        if self.some(0.12) and not foot:
            top = ""
        side = self.sidebar() if self.some(0.4) else ""
        middle = r.choice([body + side, side + body, self.element("wrap", body + side), f"<main>{body}</main>{side}", self.element("wrap", f"<div>{body}</div>{side}")])
        adverts = [self.advert() if self.some(0.4) else "", self.advert() if self.some(0.2) else ""]
        notice = [self.notice() if self.some(0.15) else "", self.notice() if self.some(0.12) else ""]
        inside = notice[0] + top + adverts[0] + middle + adverts[1] + foot + notice[1]
        if self.some(0.3):
            inside = self.element("wrap", inside)
        if self.some(0.04):  # nothing but the text
            inside = f'<div data-main="1">{self.prose(1, 8)}</div>' if self.some(0.5) else f'<div data-main="1"><p>{self.prose(1, 3)}</p><p>{self.prose(1, 3)}</p></div>'
        if self.some(0.4):
            inside = inside.replace("><", ">\n <")
        ends = "" if self.some(0.1) else "</body></html>"
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 5)}</title><style>p{{margin:0}}</style></head><body>{inside}<script>var a='</p>';</script>{ends}"


def sample(n: int, seed: int = 0) -> list[str]:
    return [Pages(seed * 1_000_003 + k).page() for k in range(n)]
