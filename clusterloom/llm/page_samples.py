"""Made-up pages with known article blocks, to train the block labeller on.

A page is drawn from the parts that pages have: an article in one of several containers, and around
and inside it menus, headers, footers, sidebars, notices, adverts, forms and comments.  Words are made
up too, mostly alike in both kinds of block, so that the labeller learns to go by structure and by the
few words that do tell (such as those of cookie notices).
"""

from __future__ import annotations

import random

_PARTS = "an be cor da el fi gra hu in jo ka lo mi nu or pa qui re so ta un ve wi xa yo zu ber sch tion eau ll ng st th".split()
_TELLING = {
    "notice": "we use cookies accept privacy policy consent settings subscribe newsletter sign up offer alert".split(),
    "footer": "copyright all rights reserved terms privacy contact imprint powered by sitemap".split(),
    "nav": "home about contact news sports login search menu archive blog next previous".split(),
    "ad": "advertisement sponsored buy now sale discount shop offer deal click here".split(),
    "comment": "reply says posted by likes ago comment report thanks great".split(),
    "form": "name email submit search password send your message enter".split(),
    "side": "related recent popular posts tags categories more read most also".split(),
    "share": "share tweet facebook email print save follow".split(),
}
_CLASSES = {
    "notice": ["notice", "cookie-notice", "cookie-banner", "alert", "gdpr-consent", "newsletter-signup", "popup", "modal", "announcement", "paywall", "banner", "message"],
    "footer": ["footer", "site-footer", "page-footer", "colophon", "copyright", "legal", "bottom-bar", "credits"],
    "header": ["header", "site-header", "masthead", "topbar", "branding", "logo", "page-header", "top"],
    "nav": ["nav", "menu", "navbar", "main-menu", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "links", "tabs", "toc", "skip-link"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "ad-slot", "sponsor", "adsbox", "promotion", "commercial"],
    "comment": ["comments", "comment-list", "responses", "replies", "discussion", "user-comments", "comment", "disqus-thread", "reviews", "reader-comments"],
    "form": ["form", "search-form", "contact-form", "login", "subscribe-form", "feedback"],
    "side": ["sidebar", "widget", "related", "recommended", "aside", "side", "more-stories", "trending", "tag-cloud", "author-box", "secondary", "rail"],
    "share": ["share", "social", "share-buttons", "toolbar", "social-links", "tools"],
}
_MAIN = ["content", "main", "main-content", "post", "entry", "entry-content", "article", "article-body", "story", "story-body", "post-content", "text", "body", "page-content", "blog-post", "single", "primary"]
_WRAP = ["wrapper", "container", "page", "site", "row", "col", "inner", "layout", "app", "root", "grid", "wrap", "section"]

#: marks the blocks that belong to the article; the maker of samples takes it out again
MARK = ""


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.words = ["".join(self.r.choice(_PARTS) for _ in range(self.r.randint(1, 4))) for _ in range(400)]
        self.noisy = self.r.random() < 0.2

    def prose(self, low: int, high: int, kind: str | None = None) -> str:
        out, length = [], 0
        n = self.r.randint(low, high)
        for k in range(n):
            told = kind and self.r.random() < 0.25
            w = self.r.choice(_TELLING[kind]) if told else self.r.choice(self.words)
            if length == 0:
                w = w.capitalize()
            length += 1
            if k == n - 1 or self.r.random() < 0.1:
                w += self.r.choice([".", ".", ".", "!", "?"])
                length = 0
            elif self.r.random() < 0.08:
                w += ","
            if self.noisy and self.r.random() < 0.6:
                w += self.r.choice(["%%%", "###", "***", "&amp;&amp;", "!!", " |"])
            out.append(w)
        text = " ".join(out)
        return text[:-1] if self.r.random() < 0.15 and text[-1:] in ".!?" else text

    def linked(self, text: str) -> str:
        return f'<a href="/{self.r.choice(self.words)}">{text}</a>'

    def box(self, inner: str, tags: list[str], classes: list[str], bare: float = 0.15) -> str:
        tag = self.r.choice(tags)
        if tag not in ("div", "section", "ul", "ol", "p", "span") and self.r.random() < 0.5 or self.r.random() < bare and tag not in ("div", "section", "ul", "ol", "p"):
            return f"<{tag}>{inner}</{tag}>"
        name = self.r.choice(classes)
        key = self.r.choice(["class", "class", "class", "id"])
        extra = f" {self.r.choice(_WRAP)}" if key == "class" and self.r.random() < 0.2 else ""
        return f'<{tag} {key}="{name}{extra}">{inner}</{tag}>'

    def menu(self) -> str:
        items = [self.linked(self.prose(1, 3, "nav").rstrip(".!?")) for _ in range(self.r.randint(2, 9))]
        inner = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.r.random() < 0.7 else " ".join(items)
        return self.box(inner, ["nav", "nav", "div", "ul"], _CLASSES["nav"])

    def paragraphs(self, low: int, high: int, kind: str, words: tuple[int, int]) -> str:
        made = []
        for _ in range(self.r.randint(low, high)):
            text = self.prose(*words, self.r.choice([kind, None]))
            if self.r.random() < 0.2:
                text = self.linked(text)
            made.append(self.r.choice([f"<p>{text}</p>", f"<p>{text}</p>", text, f"<div>{text}</div>", f"<span>{text}</span>"]))
        return "".join(made)

    def junk(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            return self.menu()
        if kind == "form":
            inner = f"<label>{self.prose(1, 4, 'form')}</label><input><p>{self.prose(2, 10, 'form')}</p><button>{self.prose(1, 2, 'form')}</button>"
            return self.box(inner, ["form", "form", "div"], _CLASSES["form"])
        if kind == "comment":
            each = [
                self.box(f"<{t}>{self.prose(1, 3, 'comment')}</{t}><p>{self.prose(3, 60, r.choice(['comment', None]))}</p>", ["li", "div", "article"], ["comment", "comment-body", "reply"])
                for t in (r.choice(["b", "h4", "span", "cite", "header", "div"]) for _ in range(r.randint(1, 5)))
            ]
            head = f"<h{r.choice('234')}>{self.prose(1, 3, 'comment')}</h3>" if r.random() < 0.6 else ""
            return self.box(head + "".join(each), ["section", "div", "ol", "aside"], _CLASSES["comment"])
        if kind == "side":
            head = f"<h{r.choice('234')}>{self.prose(1, 4, 'side')}</h4>" if r.random() < 0.7 else ""
            body = "<ul>" + "".join(f"<li>{self.linked(self.prose(2, 9, 'side'))}</li>" for _ in range(r.randint(1, 6))) + "</ul>" if r.random() < 0.5 else self.paragraphs(1, 3, "side", (3, 50))
            return self.box(head + body, ["aside", "aside", "div"], _CLASSES["side"])
        if kind == "header":
            inner = f"<{(t := r.choice(['h1', 'p', 'div', 'span', 'h2']))}>{self.prose(1, 8)}</{t}>" + (self.menu() if r.random() < 0.4 else "")
            return self.box(inner, ["header", "header", "div"], _CLASSES["header"])
        tags = {"footer": ["footer", "footer", "div"], "ad": ["div", "div", "aside", "section"], "notice": ["div", "div", "section", "p"], "share": ["div", "ul", "p"]}[kind]
        words = {"footer": (1, 25), "ad": (2, 40), "notice": (3, 50), "share": (1, 4)}[kind]
        inner = self.paragraphs(1, 3, kind, words) if tags[0] != "p" else self.prose(*words, kind)
        return self.box("&copy; " * (kind == "footer" and r.random() < 0.5) + inner, tags, _CLASSES[kind], 0.0)

    def article(self) -> str:
        r = self.r
        marked = lambda low, high: MARK + self.prose(low, high)
        out = [f"<h1>{marked(2, 12)}</h1>"] if r.random() < 0.85 else []
        messy = r.random() < 0.35
        tiny = r.random() < 0.2
        for _ in range(r.randint(1, 9) if r.random() < 0.85 else r.randint(9, 45)):
            kind = r.random()
            if messy and kind < 0.2:
                out.append(f"<p><b>{marked(1, 3 if tiny else 40)}<br>")
            elif kind < 0.72:
                text = marked(1, r.choice([2, 4, 12])) if tiny or r.random() < 0.35 else marked(8, 120)
                if r.random() < 0.03:
                    text = MARK + f"{self.prose(1, 2, r.choice(list(_TELLING)))} " * r.randint(1, 15)
                if r.random() < 0.15:
                    text += " " + self.linked(self.prose(1, 4)) + " " + self.prose(1, 10)
                out.append(f"<p>{text}" + ("</p>" if not messy or r.random() < 0.7 else ""))
            elif kind < 0.82:
                out.append(f"<h{(h := r.choice('234'))}>{marked(1, 8)}</h{h}>")
            elif kind < 0.88:
                out.append(f"<{(t := r.choice(['ul', 'ol']))}>" + "".join(f"<li>{marked(2, 25)}</li>" for _ in range(r.randint(2, 6))) + f"</{t}>")
            elif kind < 0.92:
                out.append(f"<blockquote><p>{marked(5, 50)}</p></blockquote>")
            elif kind < 0.95:
                out.append(f"<pre><code>{marked(3, 20)}</code></pre>")
            elif kind < 0.98:
                out.append(f"<figure><img><figcaption>{marked(2, 15)}</figcaption></figure>")
            else:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{marked(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>")
        if r.random() < 0.08:  # a short line that comes again and again
            same = f"<p>{marked(1, 4)}</p>"
            for _ in range(r.randint(2, 12)):
                out.insert(r.randint(0, len(out)), same)
        for kind in ("ad", "share", "side", "notice", "form", "comment", "nav"):
            if r.random() < 0.1:
                out.insert(r.randint(0, len(out)), ("</p>" if messy else "") + self.junk(kind))
        inner = "".join(out)
        style = r.random()
        if style < 0.45:
            inner = f"<article>{inner}</article>"
        elif style < 0.6:
            inner = f"<main>{inner}</main>"
        elif style < 0.92:
            inner = self.box(inner, ["div", "div", "section", "article", "main"], _MAIN, 0.0)
        if r.random() < 0.3:
            inner = self.box(inner, ["div", "section", "main"], _MAIN + _WRAP, 0.0)
        return inner

    def page(self) -> str:
        r = self.r
        before = [self.junk(k) for k, p in (("notice", 0.25), ("header", 0.55), ("nav", 0.7), ("ad", 0.45), ("side", 0.2), ("form", 0.15), ("share", 0.1)) if r.random() < p]
        after = [self.junk(k) for k, p in (("share", 0.15), ("ad", 0.3), ("comment", 0.4), ("side", 0.35), ("form", 0.25), ("notice", 0.2), ("nav", 0.2), ("footer", 0.85)) if r.random() < p]
        r.shuffle(before)
        if r.random() < 0.5:
            r.shuffle(after)
        body = "".join(before) + self.article() + "".join(after)
        if r.random() < 0.4:
            body = self.box(body, ["div"], _WRAP, 0.0)
        return f"<html><head><title>x</title></head><body>{body}</body></html>"


def sample(seed: int) -> str:
    """A page whose article blocks begin with MARK."""
    return _Maker(seed).page()
