"""Labelled pages for training the extractor: invented layouts whose elements say in ``data-main`` whether they belong to the article.

Words are random letters, so that nothing but markup, shape and a few universal notices can be learnt.
"""

from __future__ import annotations

import random

LETTERS = "etaoinshrdlucmfwypvbgkäöüéèñß"
NAMES = {
    "menu": ("nav", "menu", "navbar", "main-menu", "breadcrumb", "breadcrumbs", "topnav", "site-nav"),
    "header": ("header", "site-header", "masthead", "top", "page-header", "branding"),
    "footer": ("footer", "site-footer", "bottom", "colophon", "legal", "copyright"),
    "side": ("sidebar", "side", "aside", "widget", "related", "rail", "recommended", "popular", "tags"),
    "ad": ("ad", "ads", "advert", "advertisement", "banner", "sponsor", "sponsored", "promo", "ad-slot"),
    "notice": ("notice", "cookie", "cookie-notice", "consent", "alert", "gdpr", "modal", "popup", "newsletter", "subscribe", "paywall"),
    "form": ("form", "search", "login", "signup", "contact-form"),
    "comments": ("comments", "comment", "comment-list", "discussion", "replies", "responses", "disqus"),
    "share": ("share", "social", "share-buttons", "toolbar", "byline-share"),
    "main": ("article", "content", "post", "entry", "entry-content", "post-body", "story", "main", "article-body", "text"),
}
PHRASES = {
    "footer": ("{}", "{}", "All rights reserved.", "Privacy policy", "Terms of use", "Contact", "About {}"),
    "notice": ("We use cookies. {}", "Accept", "Subscribe to our newsletter", "{}", "This site uses cookies {}"),
    "ad": ("Advertisement", "Sponsored", "{}", "{}", "Buy now {}"),
    "comments": ("{} says:", "Reply", "{}", "{}", "Posted by {}", "3 comments"),
    "share": ("Share", "Tweet", "Print", "Share on {}"),
    "form": ("Name", "Email", "Send", "Search", "Password", "{}"),
}


class Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.style = self.r.choice(["plain"] * 6 + ["caps", "symbols", "table", "repeat"])
        self.words = ["".join(self.r.choice(LETTERS) for _ in range(self.r.choice((1, 2, 3, 3, 4, 5, 6, 7, 9, 12)))) for _ in range(200)]

    def text(self, n: int, style: str = "plain") -> str:
        ws = [self.r.choice(self.words) for _ in range(max(1, n))]
        if style == "repeat":
            ws = [w for w in ws for _ in range(8)][:n]
        if style == "caps":
            return " ".join(w.upper() + "!!" for w in ws)
        if style == "symbols":
            return " ".join(w + self.r.choice(("&amp;&amp;&amp;", "***", "###", "%%%", "$$$")) for w in ws)
        if style == "table":
            return " | ".join(ws)
        for i in range(0, len(ws), self.r.randint(4, 15)):
            ws[i] = ws[i].capitalize()
            if i:
                ws[i - 1] += self.r.choice((".", ".", ",", "?"))
        return " ".join(ws) + self.r.choice((".", ".", ".", ""))

    def name(self, kind: str) -> str:
        n = self.r.choice(NAMES[kind])
        return self.r.choice((f' class="{n}"', f' class="{n}"', f' id="{n}"', f' class="{self.r.choice(self.words)} {n}"', f' class="{n}-{self.r.randint(1, 9)}"'))

    def link(self, n: int) -> str:
        return f'<a href="/{self.r.choice(self.words)}">{self.text(n)}</a>'

    def says(self, kind: str) -> str:
        return self.r.choice(PHRASES.get(kind, ("{}",))).replace("{}", self.text(self.r.randint(1, 14)))

    def wrap(self, kind: str, body: str, tag: str | None = None) -> str:
        tag = tag or self.r.choice(({"menu": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div", "footer"), "side": ("aside", "div", "section"), "form": ("form", "div"), "comments": ("div", "section", "ol")}).get(kind, ("div", "section", "div")))
        named = tag in ("div", "section", "ul", "ol") or self.r.random() < 0.4
        return f'<{tag}{self.name(kind) if named else ""} data-main="0">{body}</{tag}>'

    def noise(self, kind: str) -> str:
        r = self.r
        if kind == "menu":
            items = "".join(f"<li>{self.link(r.randint(1, 3))}" + "</li>" * (r.random() < 0.9) for _ in range(r.randint(2, 9)))
            return self.wrap(kind, r.choice((f"<ul>{items}</ul>", f"<ul>{items}</ul>", " ".join(self.link(1) for _ in range(5)))))
        if kind == "header":
            return self.wrap(kind, r.choice((f"<h1>{self.link(2)}</h1>", f"<div>{self.text(3)}</div><p>{self.text(6)}</p>", self.link(2))) + (self.noise("menu") if r.random() < 0.4 else ""))
        if kind == "side":
            return self.wrap(kind, f"<h3>{self.text(2)}</h3>" + r.choice(("<ul>" + "".join(f"<li>{self.link(r.randint(2, 8))}</li>" for _ in range(r.randint(2, 6))) + "</ul>", f"<p>{self.text(r.randint(5, 40))}</p>", f"<p>{self.link(6)}</p>" * 3)))
        if kind == "form":
            return f'<form action="/x" data-main="0"><label>{self.says(kind)}</label><input name="a"><p>{self.text(4)}</p><textarea>{self.text(3)}</textarea><select><option>{self.text(1)}</option></select><button>{self.says(kind)}</button></form>'
        if kind == "comments":
            one = lambda: r.choice(("<li>{}</li>", "<div class=\"comment\">{}</div>", "<article class=\"comment\">{}</article>", "<p>{}</p>")).format(f"<b>{self.text(1)}</b> {self.says(kind)}<p>{self.text(r.randint(2, 60))}</p>")
            return self.wrap(kind, f"<h3>{self.says(kind)}</h3>" * (r.random() < 0.7) + "".join(one() for _ in range(r.randint(1, 5))))
        if kind == "footer":
            return self.wrap(kind, r.choice(("{}", "<p>{}</p>", "<p>{}</p><p>{}</p>")).replace("{}", self.says(kind) + r.choice(("", " &middot; " + self.text(r.randint(2, 25)), " " + self.link(2)))))
        return self.wrap(kind, r.choice(("{}", "<p>{}</p>", "<div>{}</div>", "{}<button>OK</button>")).format(self.says(kind) + r.choice(("", " " + self.text(r.randint(1, 25)), " " + self.link(2)))))

    def block(self) -> str:
        r, n = self.r, self.r.choice((1, 2, 5, 12, 30, 60, 120))
        body = self.text(n, self.style)
        if r.random() < 0.15:
            body += " " + self.link(2) + " " + self.text(6)
        kind = r.random()
        if kind < 0.7:
            return r.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><em>{}</em></p>", "<p><span>{}</span>", "<div>{}</div>")).format(body)
        if kind < 0.8:
            return f"<h{(k := r.randint(2, 4))}>{self.text(r.randint(1, 8))}</h{k}>"
        if kind < 0.9:
            return "<ul>" + "".join(f"<li>{self.text(r.randint(1, 20))}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        return r.choice((f"<blockquote>{body}</blockquote>", f"<pre>{body}</pre>", f"<table><tr><td>{self.text(2)}</td><td>{self.text(3)}</td></tr></table>", f"<figure><img src=\"a.png\"><figcaption>{self.text(8)}</figcaption></figure>"))

    def page(self) -> str:
        r = self.r
        body = "".join(self.block() for _ in range(r.randint(1, 12)))
        if r.random() < 0.35:
            at = body.find("<p>", len(body) // 2)
            if at > 0:
                body = body[:at] + self.noise(r.choice(("ad", "share", "notice", "form", "side"))) + body[at:]
        title = f"<h1>{self.text(r.randint(1, 10), self.style)}</h1>"
        shape = r.random()
        if shape < 0.55:
            main = f'<article{self.name("main") if r.random() < 0.3 else ""} data-main="1">{title}{body}</article>'
        elif shape < 0.75:
            main = f'<{(t := r.choice(("main", "div", "section")))}{self.name("main")} data-main="1">{title}{body}</{t}>'
        elif shape < 0.85:
            main = f'<main><article data-main="1"><header>{title}</header><div class="entry-content">{body}</div></article></main>'
        else:
            main = f'<div data-main="1">{title * (r.random() < 0.5)}{body}</div>'
        if shape >= 0.95:
            return f'<html><body data-main="1">{body}</body></html>' if r.random() < 0.7 else f'<div data-main="1">{self.text(60, self.style)}</div>'
        before = [k for k, p in (("header", 0.4), ("menu", 0.8), ("notice", 0.3), ("ad", 0.5), ("form", 0.1)) if r.random() < p]
        after = [k for k, p in (("share", 0.2), ("comments", 0.45), ("side", 0.5), ("form", 0.2), ("ad", 0.25), ("footer", 0.85), ("notice", 0.2)) if r.random() < p]
        if r.random() < 0.3:
            before, after = before + ["side"], [k for k in after if k != "side"]
        return "<html><head><title>x</title></head><body>" + "".join(map(self.noise, before)) + main + "".join(map(self.noise, after)) + "</body></html>" * (r.random() < 0.9)


def labelled_pages(n: int = 500, seed: int = 11) -> list[str]:
    return [Writer(seed * 1_000_003 + i).page() for i in range(n)]
