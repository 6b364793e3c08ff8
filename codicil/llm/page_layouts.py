"""Labelled pages to learn from: sampled texts put into layouts drawn by rule.

Each page has an article among menus, headers, notices, adverts, sidebars, forms, comments and a footer, with the
sloppy markup of real pages. Runs of main text begin with MARK. The same seed gives the same pages.
"""

from __future__ import annotations

import html
import random

MARK = ""

# Names that pages commonly give to their parts.
CONTENT = "article content post entry story main body text page-content post-body entry-content article-body main-content story-text blog-post articleBody".split()
WRAPPERS = "wrapper container page site layout row col inner outer wrap grid".split()
NAVIGATION = "nav menu navbar navigation top-menu main-nav breadcrumb breadcrumbs tabs pagination pager links toc site-nav".split()
HEADER = "header masthead top topbar banner logo site-header branding".split()
FOOTER = "footer bottom colophon site-footer copyright legal foot credits".split()
SIDE = "sidebar aside widget related recommended popular trending side rail secondary tags more-stories see-also promo-box".split()
NOTICE = "cookie notice consent alert gdpr message popup modal overlay privacy-notice cookie-banner warning subscribe-wall".split()
ADVERT = "ad ads advert advertisement sponsor sponsored promo adsbygoogle banner-ad ad-slot partner commercial".split()
COMMENTS = "comments comment discussion replies reply responses thread disqus comment-list user-comments feedback reviews".split()
FORMS = "search newsletter subscribe signup login form contact-form search-form register".split()
SHARE = "share social sharing share-buttons follow byline-share".split()


def _names(r: random.Random, bare: bool, pool: list[str]) -> str:
    """An attribute that names an element, from the pool or, in bare pages, from nothing."""
    if bare:
        return "" if r.random() < 0.5 else f' class="{"".join(r.choices("bcdfghjkmnpqrtvwxz", k=r.randrange(2, 5)))}"'
    picked = r.sample(pool, 1 if r.random() < 0.8 else 2)
    if r.random() < 0.2:
        picked.append(r.choice(WRAPPERS))
    value = " ".join(picked)
    form = r.random()
    if form < 0.6:
        return f' class="{value}"'
    if form < 0.8:
        return f' id="{picked[0]}"'
    if form < 0.9:
        return f" class={picked[0]}"
    return f" id='{picked[0]}' class='{value}'"


class _Page:
    def __init__(self, r: random.Random, paragraphs: list[str]):
        self.r, self.paragraphs = r, paragraphs
        self.bare = r.random() < 0.12
        self.semantic = r.random() < 0.6

    def words(self, low: int, high: int) -> str:
        w = self.r.choice(self.paragraphs).split()
        n = self.r.randint(low, high)
        while len(w) < n:
            w += self.r.choice(self.paragraphs).split() or ["a"]
        k = self.r.randrange(len(w) - n + 1)
        return html.escape(" ".join(w[k : k + n]))

    def box(self, tag: str, pool: list[str], inner: str) -> str:
        """An element of the kind: by its own tag, or a div, that is named."""
        if tag and self.semantic and self.r.random() < 0.8:
            named = _names(self.r, self.bare, pool) if self.r.random() < 0.4 else ""
            return f"<{tag}{named}>{inner}</{tag}>"
        other = self.r.choice(["div", "div", "section", "div"])
        return f"<{other}{_names(self.r, self.bare, pool)}>{inner}</{other}>"

    def anchors(self, low: int, high: int) -> str:
        links = [f'<a href="/{i}">{self.words(1, 4)}</a>' for i in range(self.r.randint(low, high))]
        form = self.r.random()
        if form < 0.6:
            return "<ul>" + "".join(f"<li>{a}" + ("</li>" if self.r.random() < 0.8 else "") for a in links) + "</ul>"
        return self.r.choice([" | ", " ", "<br>"]).join(links)

    def navigation(self) -> str:
        return self.box("nav", NAVIGATION, self.anchors(3, 12))

    def header(self) -> str:
        inner = f'<a href="/">{self.words(1, 3)}</a>' + (f"<p>{self.words(2, 8)}</p>" if self.r.random() < 0.5 else "") + (self.navigation() if self.r.random() < 0.4 else "")
        return self.box("header", HEADER, inner)

    def footer(self) -> str:
        said = self.r.choice(["&copy; ", "&#169; 2021 ", "Copyright ", ""]) + self.words(2, 20) + self.r.choice([" &middot; ", " | ", ". "]) + self.words(2, 15)
        return self.box("footer", FOOTER, (self.anchors(2, 6) if self.r.random() < 0.5 else "") + (f"<p>{said}</p>" if self.r.random() < 0.5 else said))

    def notice(self) -> str:
        said = self.words(5, 40)
        return self.box("", NOTICE, (f"<p>{said}</p>" if self.r.random() < 0.6 else said) + ("<button>OK</button>" if self.r.random() < 0.5 else f'<a href="#">{self.words(1, 2)}</a>' if self.r.random() < 0.5 else ""))

    def advert(self) -> str:
        said = self.words(3, 30)
        return self.box("", ADVERT, self.r.choice([said, f"<p>{said}</p>", f'<a href="http://x">{said}</a>', f'<img src="a.png"><span>{said}</span>', f"<h4>{self.words(2, 5)}</h4><p>{said}</p>"]))

    def form(self) -> str:
        inner = f"<label>{self.words(1, 4)}</label><input type=text><button>{self.words(1, 2)}</button>"
        said = f"<p>{self.words(4, 25)}</p>" if self.r.random() < 0.6 else ""
        return f"<form action='/go'{_names(self.r, self.bare, FORMS) if self.r.random() < 0.5 else ''}>{said}{inner}</form>" if self.r.random() < 0.7 else self.box("", FORMS, said + f"<form>{inner}</form>")

    def side(self) -> str:
        parts = [f"<h3>{self.words(1, 4)}</h3>" + self.r.choice([self.anchors(2, 8), f"<p>{self.words(5, 40)}</p>", f"<p>{self.words(5, 25)} <a href='/m'>{self.words(1, 3)}</a></p>"]) for _ in range(self.r.randint(1, 3))]
        return self.box("aside", SIDE, "".join(parts))

    def comments(self) -> str:
        one = self.r.choice(["div", "li", "article", "div"])
        out = []
        for _ in range(self.r.randint(1, 6)):
            said = "".join(f"<p>{self.words(3, 60)}</p>" for _ in range(self.r.randint(1, 2))) if self.r.random() < 0.7 else self.words(3, 50)
            who = self.r.choice([f"<b>{self.words(1, 2)}</b>", f'<span class="author">{self.words(1, 2)}</span>', f"<div class='meta'>{self.words(1, 4)}</div>", ""])
            out.append(f"<{one}{_names(self.r, False, COMMENTS)}>{who}{said}</{one}>")
        inner = "".join(out) if one != "li" else f"<{self.r.choice(['ul', 'ol'])}>{''.join(out)}</ul>"
        kind = self.r.choice(["div", "section", "section", "div", "aside"])
        return f"<{kind}{_names(self.r, False, COMMENTS)}>" + (f"<h3>{self.words(1, 3)}</h3>" if self.r.random() < 0.7 else "") + inner + f"</{kind}>"

    def share(self) -> str:
        return self.box("", SHARE, self.anchors(2, 5))

    def paragraph(self) -> str:
        short = self.r.random() < 0.2
        said = self.words(1, 8) if short else self.words(8, 140)
        if not short and self.r.random() < 0.25:
            w = said.split()
            k = self.r.randrange(len(w))
            w[k] = self.r.choice(["<a href='/x'>{}</a>", "<b>{}</b>", "<em>{}</em>", "{}<br>", "<span>{}</span>"]).format(w[k])
            said = " ".join(w)
        form = self.r.random()
        if form < 0.1:
            return f"<p><b>{MARK}{said}<br>"
        return f"<p>{MARK}{said}" + ("</p>" if form < 0.85 else "")

    def part(self) -> str:
        form = self.r.random()
        if form < 0.72:
            return self.paragraph()
        if form < 0.8:
            return f"<h{(k := self.r.randint(2, 4))}>{MARK}{self.words(1, 9)}</h{k}>"
        if form < 0.86:
            items = "".join(f"<li>{MARK}{self.words(2, 25)}" + ("</li>" if self.r.random() < 0.8 else "") for _ in range(self.r.randint(2, 6)))
            return f"<ul>{items}</ul>"
        if form < 0.89:
            return f"<blockquote>{MARK}{self.words(5, 40)}</blockquote>"
        if form < 0.91:
            return f"<table><tr><th>{MARK}{self.words(1, 2)}<th>{MARK}{self.words(1, 2)}<tr><td>{MARK}{self.words(1, 5)}<td>{MARK}{self.words(1, 5)}</table>"
        if form < 0.93:
            return f"<figure><img src='a.jpg'><figcaption>{MARK}{self.words(3, 15)}</figcaption></figure>"
        if form < 0.94:
            return f"<pre>{MARK}{self.words(5, 30)}</pre>"
        return self.r.choice([self.advert, self.share, self.side, self.form, self.notice, self.advert])()

    def article(self) -> str:
        n = self.r.choice([0, 0, 1, 2, 3, 5, 8, 12, 20, 40])
        loose = self.r.random() < 0.08  # text with breaks instead of paragraphs
        parts = "<br><br>".join(f"{MARK}{self.words(10, 90)}" for _ in range(n + 1)) if loose else "".join(self.part() for _ in range(n)) + self.paragraph()
        title = f"<h1>{MARK}{self.words(2, 14)}</h1>" if self.r.random() < 0.75 else ""
        if title and self.r.random() < 0.15:
            title = f"<header>{title}</header>"
        inner = title + parts + (self.comments() if not self.bare and self.r.random() < 0.15 else "")
        if self.r.random() < 0.2:
            inner = f"<div{_names(self.r, self.bare, CONTENT)}>{inner}</div>"
        whole = self.box("article", CONTENT, inner) if self.r.random() < 0.85 else self.box("main", CONTENT, inner)
        for _ in range(self.r.choice([0, 0, 0, 1, 2])):
            whole = f"<{(t := self.r.choice(['div', 'main', 'section']))}{_names(self.r, self.bare, WRAPPERS + CONTENT) if self.r.random() < 0.7 else ''}>{whole}</{t}>"
        return whole

    def build(self) -> str:
        r = self.r
        before = [f() for f in (self.header, self.navigation, self.notice, self.advert, self.form, self.side, self.share) if r.random() < 0.4]
        after = [f() for f in (self.advert, self.share, self.side, self.form, self.notice, self.navigation) if r.random() < 0.3]
        if not self.bare and r.random() < 0.45:
            after.append(self.comments())
        if r.random() < 0.12:
            before, after = [], []
        r.shuffle(before)
        r.shuffle(after)
        noise = lambda: r.choice(["", "", "<!-- part -->", "<script>var t='</p>';</script>", "\n", "<style>p{margin:0}</style>"])
        middle = noise().join([*before, self.article(), *after])
        for _ in range(r.choice([0, 0, 1, 2])):
            middle = f"<div{_names(r, self.bare, WRAPPERS)}>{middle}</div>"
        tail = self.footer() if r.random() < 0.85 else ""
        if r.random() < 0.08:
            return middle + tail
        return f'<!DOCTYPE html><html lang="en"><head><title>{self.words(2, 10)}</title></head><body>{middle}{tail}' + ("</body></html>" if r.random() < 0.9 else "")


def invented(r: random.Random, n: int) -> list[str]:
    """Paragraphs of invented words, for tables without usable texts."""
    syllables = [a + b for a in "bdfgklmnprstv" for b in ("a", "e", "i", "o", "u", "an", "er", "is")]
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))
    return [" ".join(word() + ("." if r.random() < 0.1 else "," if r.random() < 0.05 else "") for _ in range(r.randint(5, 80))).capitalize() + "." for _ in range(n)]


def pages(paragraphs: list[str], n: int, seed: int) -> list[str]:
    """n labelled pages."""
    r = random.Random(seed)
    texts = [p.replace(MARK, "") for p in paragraphs if p.split()]
    texts += invented(r, max(50, 200 - len(texts)))
    return [_Page(r, texts).build() for _ in range(n)]
