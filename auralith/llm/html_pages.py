"""Made web pages with known main text, from which the block labeller learns.

Layouts vary: semantic tags or named containers, parts in different places, adverts and forms inside the
article, comments after it, unclosed tags. Words are made up, so that the model leans on structure.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

SYLLABLES = "ba ce di fo gu ha li mo nu pra sen ti ur ve wo xa ye zi ton der ing est ion er ach que ment os as en de la".split()
MAIN_NAMES = "content post entry article story body text main entry-content post-body article-body main-text page-content prose markdown".split()
SIDE_NAMES = {
    "nav": "nav menu navbar navigation main-menu breadcrumb breadcrumbs pagination tabs toc skip".split(),
    "header": "header masthead banner top site-header topbar branding logo".split(),
    "footer": "footer bottom site-footer colophon copyright legal imprint".split(),
    "aside": "sidebar aside widget related recommended rail secondary tags trending popular more-stories".split(),
    "ad": "ad ads advert advertisement sponsored promo promotion banner-ad adsense sponsor partner".split(),
    "notice": "notice cookie cookies cookie-notice consent alert gdpr popup modal overlay paywall".split(),
    "form": "newsletter subscribe signup search search-form login contact share social sharing".split(),
    "comments": "comments comment comment-list responses discussion replies reader-comments disqus".split(),
}
SIDE_TAGS = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}


def made_pages(n: int, seed: int = 5) -> Iterator[tuple[str, set[str]]]:
    """(page, texts of the blocks of its main text)."""
    for k in range(n):
        yield _Page(random.Random(f"{seed}-{k}")).made()


class _Page:
    def __init__(self, rng: random.Random):
        self.rng, self.main = rng, set()
        style = rng.random()
        self.dress = (lambda w: w) if style < 0.75 else str.upper if style < 0.85 else (lambda w: w + rng.choice(["!!", "***", "###", "%%%"]))

    def word(self) -> str:
        return "".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        n = self.rng.randint(low, high)
        out = [self.word() for _ in range(n)]
        out[0] = out[0].capitalize()
        for i in range(8, n, 9):
            out[i] += self.rng.choice([",", ".", ".", ";"])
        return " ".join(out)

    def said(self, low: int, high: int) -> str:
        """A text of the main part; it is noted there."""
        text = " ".join(map(self.dress, self.words(low, high).split())) + self.rng.choice(["", ".", ".", "!", "?"])
        text = " ".join(text.split())
        self.main.add(text)
        return text

    def named(self, kind: str) -> tuple[str, str]:
        rng = self.rng
        name = rng.choice(SIDE_NAMES[kind])
        attr = rng.choice(["class", "class", "id"])
        tag = SIDE_TAGS.get(kind, "div")
        if kind in SIDE_TAGS and rng.random() < 0.5:
            return (f"<{tag}>" if rng.random() < 0.6 else f'<{tag} {attr}="{name}">'), f"</{tag}>"
        tag = rng.choice(["div", "div", "section", "ul" if kind == "nav" else "div"])
        return f'<{tag} {attr}="{name}">', f"</{tag}>"

    def side(self, kind: str) -> str:
        rng = self.rng
        start, end = self.named(kind)
        if kind in ("nav", "header") or kind == "aside" and rng.random() < 0.5:
            inner = "".join(f'<li><a href="/{self.word()}">{self.words(1, 4)}</a></li>' for _ in range(rng.randint(2, 9)))
            inner = f"<ul>{inner}</ul>" if rng.random() < 0.8 else inner.replace("li>", "span>")
            if kind == "header":
                inner = f"<h2>{self.words(1, 4)}</h2>" + (inner if rng.random() < 0.5 else "")
        elif kind == "form":
            inner = f"<label>{self.words(1, 5)}</label><input type=text><button>{self.words(1, 2)}</button>"
            inner += f"<p>{self.words(3, 15)}</p>" if rng.random() < 0.4 else ""
        elif kind == "comments":
            inner = f"<h3>{self.words(1, 3)}</h3>" + "".join(rng.choice(["<div class=comment><p>{}</p></div>", "<li><b>x</b> {}</li>", "<p>{}</p>"]).format(self.words(3, 40)) for _ in range(rng.randint(1, 6)))
        elif kind == "footer":
            inner = f"&copy; {self.words(1, 4)} &middot; {self.words(2, 14)}." if rng.random() < 0.7 else f"<p>{self.words(3, 12)}</p><ul><li><a href=#>{self.words(1, 3)}</a></li></ul>"
        else:
            inner = rng.choice(["{}", "<p>{}</p>", "<p>{}</p><a href=#>x</a>", "<h4>{}</h4>"]).format(self.words(2, 25))
        return start + inner + end

    def article(self) -> str:
        rng = self.rng
        parts = [f"<h1>{self.said(2, 10)}</h1>"] if rng.random() < 0.85 else []
        loose = rng.random() < 0.3  # unclosed tags
        for _ in range(rng.choice([1, 1, 2, 4, 8, 14])):
            kind = rng.random()
            if kind < 0.7:
                text = self.said(1, rng.choice([6, 40, 120]))
                if loose and rng.random() < 0.5:
                    parts.append(f"<p><b>{text}<br>")
                elif rng.random() < 0.2:
                    cut = text.split()
                    parts.append("<p>" + " ".join([*cut[:-1], f"<a href='/x'>{cut[-1]}</a>"]) + "</p>")
                else:
                    parts.append(f"<p>{text}</p>")
            elif kind < 0.76:
                parts.append(f"<h{rng.randint(2, 4)}>{self.said(1, 7)}</h2>")
            elif kind < 0.84:
                tag = rng.choice(["ul", "ol"])
                parts.append(f"<{tag}>" + "".join(f"<li>{self.said(1, 14)}</li>" for _ in range(rng.randint(1, 5))) + f"</{tag}>")
            elif kind < 0.88:
                parts.append(rng.choice(["<blockquote>{}</blockquote>", "<blockquote><p>{}</p></blockquote>", "<pre>{}</pre>", "<figure><figcaption>{}</figcaption></figure>"]).format(self.said(3, 20)))
            elif kind < 0.91:
                parts.append("<table>" + "".join(f"<tr><td>{self.said(1, 4)}</td><td>{self.said(1, 4)}</td></tr>" for _ in range(rng.randint(1, 3))) + "</table>")
            else:
                parts.append(self.side(rng.choice(["ad", "form", "aside", "notice", "nav"])))
        inner = "".join(parts)
        kind = rng.random()
        if kind < 0.45:
            return f"<article>{inner}</article>"
        name = rng.choice(MAIN_NAMES)
        if kind < 0.6:
            return f'<main><div class="{name}">{inner}</div></main>'
        if kind < 0.75:
            return f'<article class="{name}">{inner}</article>'
        return f'<div {rng.choice(["class", "id"])}="{name}">{inner}</div>'

    def made(self) -> tuple[str, set[str]]:
        rng = self.rng
        before = [k for k, p in (("notice", 0.25), ("header", 0.35), ("nav", 0.75), ("ad", 0.5), ("form", 0.15), ("aside", 0.15)) if rng.random() < p]
        after = [k for k, p in (("comments", 0.35), ("aside", 0.35), ("ad", 0.25), ("form", 0.2), ("notice", 0.15), ("footer", 0.8)) if rng.random() < p]
        if rng.random() < 0.2:
            rng.shuffle(before)
        body = "".join(map(self.side, before)) + (self.article() if rng.random() < 0.97 else "") + "".join(map(self.side, after))
        if rng.random() < 0.2:
            body = f'<div {rng.choice(["class", "id"])}="{rng.choice(["page", "wrapper", "container", "site", "root", "app"])}">{body}</div>'
        title = self.words(1, 8)
        page = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>{body}</body></html>'
        return page[: page.index("</body>")] if rng.random() < 0.1 else page, self.main
