"""Pages made up for training: many layouts, with the class of every block known.

Words are random syllables, so that only structure, tag paths, class names and
the small vocabulary of page furniture can tell an article from what surrounds it.
"""

from __future__ import annotations

import html
import random

SYLLABLES = "an en ti on re ha ou st ver che un ga la mo ri ue ción ung eau ß ё но ра ко 文 章 内".split()
MENU = "Home About Contact Login Register News Sport Search Archive Topics Help Jobs Shop Blog Forum Events Start Menu Inicio Accueil Startseite Kontakt".split()
NOTICE = "We use cookies to improve your experience|Accept all cookies|This site uses cookies|Subscribe to our newsletter|Sign up for free|Please enable JavaScript|Read our privacy policy|Your session will expire".split("|")
FOOT = "© 2023 All rights reserved|Terms of use|Privacy policy|Imprint|Copyright|Contact us|Powered by|Legal notice|Follow us|© example.com ·".split("|")
ASIDE = "Related articles|Most read|Popular posts|Tags|Share this|You may also like|Recent comments|Advertisement|Sponsored|Trending now|Categories|More from us".split("|")
REPLY = "Reply|Posted by|says:|Log in to comment|3 comments|Leave a comment|Report|likes".split("|")

#: Class and id names of furniture, by kind.
NAMES = {
    "nav": "nav navbar menu main-menu navigation topnav breadcrumbs breadcrumb site-nav links pagination pager tabs toc".split(),
    "header": "header site-header masthead top banner logo branding hero-top page-header".split(),
    "footer": "footer site-footer bottom copyright colophon legal footer-links page-footer".split(),
    "aside": "sidebar side widget related aside recommended promo social share trending right-col left-col secondary tags".split(),
    "ad": "ad ads advert advertisement sponsored banner-ad adsbygoogle promo-box ad-slot dfp".split(),
    "notice": "cookie cookie-banner notice alert consent gdpr popup modal overlay newsletter subscribe message".split(),
    "form": "form search-form login signup newsletter-form contact-form".split(),
    "comments": "comments comment-list comment reply disqus responses discussion user-comments comment-body".split(),
    "main": "content article post entry main story text body article-body post-content entry-content main-content page-content".split(),
}


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.labels: dict[str, int] = {}

    def word(self) -> str:
        return "".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        out = [self.word() for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.04:
            out = [w for w in out[: 1 + len(out) // 8] for _ in range(8)]
        out[0] = out[0].capitalize()
        return " ".join(w + self.r.choice(["", "", "", "", ",", "."]) for w in out)

    def text(self, label: int, low: int, high: int, lead: str = "") -> str:
        made = (lead + " " if lead else "") + self.words(low, high)
        made = " ".join(made.split())
        if self.r.random() < 0.1:
            made += " & " + self.word()
        self.labels[made] = label
        return html.escape(made)

    def named(self, kind: str, tag: str = "div") -> str:
        if self.r.random() < 0.12:
            return f"<{tag}>"
        key = self.r.choice(["class", "class", "class", "id"])
        name = self.r.choice(NAMES[kind])
        if self.r.random() < 0.3:
            name += " " + self.r.choice([self.word(), "clearfix", "container", "row", "col-md-4", "box"])
        return f'<{tag} {key}="{name}">' if self.r.random() < 0.9 else f"<{tag} {key}={name.split()[0]}>"

    def inline(self, label: int, low: int, high: int) -> str:
        made = self.text(label, low, high)
        if self.r.random() < 0.3 and "&" not in made:
            words = made.split(" ")
            i = self.r.randrange(len(words))
            tag = self.r.choice(["b", "i", "em", "strong", "span", "a href='/x'", "code"])
            words[i] = f"<{tag}>{words[i]}</{tag.split()[0]}>"
            made = " ".join(words)
        return made

    def links(self, low: int, high: int, leads: list[str]) -> str:
        n = self.r.randint(low, high)
        item = lambda: f'<a href="/{self.r.randint(1, 999)}">{self.text(0, 1, 3, self.r.choice(leads) if self.r.random() < 0.5 else "")}</a>'
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>"
        if self.r.random() < 0.2:
            return "<table><tr>" + "".join(f"<td>{item()}</td>" for _ in range(n)) + "</tr></table>"
        return "".join(f"<div>{item()}</div>" if self.r.random() < 0.5 else f"<p>{item()}</p>" for _ in range(n))

    def wrap(self, kind: str, tags: list[str], inner: str) -> str:
        tag = self.r.choice(tags)
        return f"{self.named(kind, tag)}{inner}</{tag}>"

    def nav(self) -> str:
        return self.wrap("nav", ["nav", "nav", "div", "ul"], self.links(3, 9, MENU))

    def header(self) -> str:
        inner = f"<{(t := self.r.choice(['h1', 'div', 'p', 'span']))}>{self.text(0, 1, 4)}</{t}>"
        return self.wrap("header", ["header", "div"], inner + (self.nav() if self.r.random() < 0.5 else ""))

    def footer(self) -> str:
        inner = f"<p>{self.text(0, 1, 12, self.r.choice(FOOT))}</p>" if self.r.random() < 0.6 else self.text(0, 1, 12, self.r.choice(FOOT))
        return self.wrap("footer", ["footer", "footer", "div"], inner + (self.links(2, 6, FOOT) if self.r.random() < 0.4 else ""))

    def aside(self) -> str:
        body = self.links(2, 7, ASIDE) if self.r.random() < 0.6 else "".join(f"<p>{self.text(0, 4, 40)}</p>" for _ in range(self.r.randint(1, 3)))
        return self.wrap("aside", ["aside", "aside", "div", "section"], f"<h3>{self.text(0, 0 + 1, 3, self.r.choice(ASIDE))}</h3>" + body)

    def ad(self) -> str:
        inner = self.text(0, 2, 40) if self.r.random() < 0.6 else f"<p>{self.text(0, 3, 40, self.r.choice(['Buy now', 'Sponsored', 'Advertisement', 'Only today']))}</p>"
        return ("<!-- ad -->" if self.r.random() < 0.4 else "") + self.wrap("ad", ["div", "div", "aside", "section", "ins"], inner)

    def notice(self) -> str:
        return self.wrap("notice", ["div", "section", "dialog"], f"<p>{self.text(0, 1, 12, self.r.choice(NOTICE))}</p><button>{self.word()}</button>")

    def form(self) -> str:
        return self.wrap("form", ["form"], f"<label>{self.text(0, 1, 4)}</label><input name=q><p>{self.text(0, 1, 8, self.r.choice(NOTICE))}</p><button>Go</button>")

    def comments(self) -> str:
        out = f"<h3>{self.text(0, 1, 2, self.r.choice(REPLY))}</h3>"
        for _ in range(self.r.randint(1, 5)):
            item = f"<p>{self.text(0, 1, 3, self.r.choice(REPLY))}</p>" if self.r.random() < 0.6 else f"<span>{self.text(0, 1, 2)}</span>"
            out += self.wrap("comments", ["div", "li", "article"], item + f"<p>{self.text(0, 3, 40)}</p>")
        return self.wrap("comments", ["section", "div", "ol"], out)

    def article(self) -> str:
        r = self.r
        para = "p" if r.random() < 0.85 else "div"  # old pages have no paragraphs
        out = f"<h{(top := r.choice([1, 1, 1, 2]))}>{self.text(1, 1, 12)}</h{top}>" if r.random() < 0.85 else ""
        for i in range(r.choice([1, 1, 2, 3, 5, 8, 12, 20])):
            k = r.random()
            if k < 0.74:
                p = self.inline(1, 1, r.choice([4, 12, 40, 120]))
                if para == "p" and r.random() < 0.15:
                    out += f"<p><b>{p}<br>" if r.random() < 0.5 else f"<p>{p}"
                else:
                    out += f"<{para}>{p}</{para}>"
            elif k < 0.82:
                out += f"<h{(n := r.choice([2, 2, 3]))}>{self.text(1, 1, 7)}</h{n}>"
            elif k < 0.9:
                t = r.choice(["ul", "ol"])
                out += f"<{t}>" + "".join(f"<li>{self.inline(1, 1, 15)}</li>" for _ in range(r.randint(2, 5))) + f"</{t}>"
            elif k < 0.94:
                out += f"<blockquote>{self.inline(1, 4, 30)}</blockquote>"
            elif k < 0.97:
                out += "<table>" + "".join("<tr>" + "".join(f"<td>{self.text(1, 1, 4)}</td>" for _ in range(2)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>"
            else:
                out += f"<div>{self.inline(1, 4, 40)}</div>" if r.random() < 0.5 else f"<pre>{self.text(1, 2, 20)}</pre>"
            if r.random() < 0.05:
                out += r.choice([self.ad, self.notice, self.aside])()
        style = r.random()
        if style < 0.45:
            return f"<article>{out}</article>" if r.random() < 0.6 else self.wrap("main", ["article"], out)
        if style < 0.6:
            return f"<main>{out}</main>" if r.random() < 0.5 else f"<main>{self.wrap('main', ['div', 'article', 'section'], out)}</main>"
        return self.wrap("main", ["div", "section", "div"], out) if style < 0.95 else f"<div>{out}</div>"

    def page(self) -> str:
        r, out = self.r, []
        for part, chance in ((self.notice, 0.2), (self.header, 0.45), (self.nav, 0.75), (self.ad, 0.45), (self.aside, 0.15)):
            if r.random() < chance:
                out.append(part())
        middle = [self.article()]
        for part, chance in ((self.comments, 0.35), (self.aside, 0.3), (self.ad, 0.25), (self.form, 0.2)):
            if r.random() < chance:
                middle.append(part())
        body = "".join(middle)
        if r.random() < 0.3:
            body = r.choice(["<div class=container>", "<div id=wrapper>", '<div class="page row">']) + body + "</div>"
        out.append(body)
        for part, chance in ((self.nav, 0.1), (self.footer, 0.85), (self.notice, 0.1)):
            if r.random() < chance:
                out.append(part())
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 6)}</title><style>p{{}}</style><script>var t='<p>x</p>';</script></head><body>{''.join(out)}" + ("</body></html>" if r.random() < 0.95 else "")
