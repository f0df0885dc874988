"""Made-up pages of many layouts, every block of which is known to be main text or not: what the block labeller learns from."""

from __future__ import annotations

import random

#: Marks before each text of a made-up page: other text, main text. They lie in a private area of Unicode.
MARKS = "\ue000\ue001"

#: Class and id names of the parts of a page, by part.
NAMES = {
    "menu": "menu nav navbar navigation topnav main-menu breadcrumb breadcrumbs tabs links menu-bar nav-list pager pagination toc-links skip-links".split(),
    "header": "header site-header masthead page-header top-bar topbar logo branding site-title head-banner".split(),
    "footer": "footer site-footer page-footer bottom copyright legal credits colophon footer-links foot".split(),
    "side": "sidebar side side-bar widget widgets right-column left-column related related-posts popular recent recommended trending more-stories teaser rail tag-cloud".split(),
    "notice": "cookie cookie-notice cookies consent cookie-banner notice gdpr alert popup modal overlay disclaimer paywall privacy-notice announcement message warning-bar".split(),
    "ad": "ad ads advert adverts advertisement ad-slot ad-box sponsor sponsored promo promotion adsbox banner-ad commercial".split(),
    "form": "newsletter search search-box login subscribe signup contact-form form sign-up register search-form".split(),
    "share": "share social sharing follow share-buttons social-links toolbar tools".split(),
    "comments": "comments comment-list responses discussion replies comment-section reviews respond feedback reader-comments user-comments disqus".split(),
    "main": "content main article post entry story text article-body post-content entry-content main-content story-body article-text body-text post-body page-content article-content".split(),
}
#: Phrases that such parts tend to hold.
PHRASES = {
    "menu": "Home|About|About us|Contact|News|Blog|Products|Services|Login|Archive|FAQ|Help|Startseite|Kontakt|Impressum|Über uns|Accueil|À propos|Inicio|Acerca de|Contacto|Skip to content|Next|Previous|Sitemap".split("|"),
    "footer": "All rights reserved.|Privacy policy|Terms of use|Imprint|Alle Rechte vorbehalten.|Datenschutz|Tous droits réservés.|Mentions légales|Todos los derechos reservados.|Aviso legal|Powered by".split("|"),
    "side": "Related articles|Popular posts|Recent posts|Read more|You may also like|Trending now|Most read|Tags|Categories|Mehr zum Thema|Meistgelesen|À lire aussi|Les plus lus|Lo más leído|Artículos relacionados".split("|"),
    "notice": "We use cookies to improve your experience.|This site uses cookies.|Accept all cookies|Please enable JavaScript.|Your privacy matters to us.|Subscribe to continue reading.|Wir verwenden Cookies.|Nous utilisons des cookies.|Utilizamos cookies.|By using this website you agree to the use of cookies.".split("|"),
    "ad": "Advertisement|Sponsored|Buy now|Anzeige|Publicité|Publicidad|Special offer|Shop now".split("|"),
    "form": "Search|Email address|Subscribe|Sign up for our newsletter|Log in|Password|Your name|Send|Suche|Anmelden|Rechercher|S'inscrire|Buscar|Enviar|Submit".split("|"),
    "share": "Share|Tweet|Facebook|Print|Email this|Follow us|Teilen|Partager|Compartir|Like".split("|"),
    "comments": "Comments|Leave a comment|Reply|Responses|Join the discussion|Kommentare|Antworten|Commentaires|Répondre|Comentarios|Responder|Leave a reply".split("|"),
}
_SYLLABLES = "ba be bi bo da de di do ka ke ki la le li lo ma me mi na ne no ra re ri sa se si ta te ti to ur en an er in on es".split()


class Layouts:
    """Pages drawn from a seed. pool: sentences or paragraphs to draw texts from; without any, words are made of syllables."""

    def __init__(self, seed: int, pool: list[str]):
        self.rng = random.Random(seed)
        self.pool = [p.split() for p in pool if p.strip()]

    def words(self, n: int) -> str:
        rng, out = self.rng, []
        while len(out) < n:
            if self.pool and rng.random() < 0.8:
                source = rng.choice(self.pool)
                i = rng.randrange(len(source))
                out += source[i : i + n - len(out)]
            else:
                out.append("".join(rng.choice(_SYLLABLES) for _ in range(rng.randrange(1, 5))))
        return " ".join(out).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")

    def sentence(self, low: int = 4, high: int = 25) -> str:
        text = self.words(self.rng.randrange(low, high)).rstrip(".,")
        return text[:1].upper() + text[1:] + self.rng.choice("....?!")

    def paragraph(self) -> str:
        rng, out = self.rng, []
        if rng.random() < 0.2:
            return self.sentence(1, 7)
        for _ in range(rng.choice((1, 1, 2, 3, 4, 6, 10))):
            s = self.sentence()
            if rng.random() < 0.12:
                s = f"<{(t := rng.choice(['b', 'em', 'i', 'strong', 'span', 'code']))}>{s}</{t}>"
            elif rng.random() < 0.08:
                s = f'{self.sentence()} <a href="/{rng.randrange(99)}">{self.words(2)}</a> {s}'
            out.append(s)
        return rng.choice((" ", " ", "\n", "<br>")).join(out)

    def one(self, label: int, tag: str, text: str, end: float = 0.95) -> str:
        return f"<{tag}>{MARKS[label]}{text}" + (f"</{tag}>" if tag not in ("p", "li", "td") or self.rng.random() < end else "")

    def named(self, part: str, inner: str, *tags: str) -> str:
        """inner in an element of one of the tags or a div, which mostly bears a name of the part."""
        rng = self.rng
        tag = rng.choice([*tags, *tags, "div", "div", "section"]) if tags else rng.choice(["div", "div", "div", "section"])
        if tag in tags and rng.random() < 0.4:
            return f"<{tag}>{inner}</{tag}>"
        name = rng.choice(NAMES[part])
        extra = f" c{rng.randrange(50)}" if rng.random() < 0.2 else ""
        return f'<{tag} {rng.choice(["class", "class", "class", "id"])}="{name}{extra}">{inner}</{tag}>'

    def phrase(self, part: str, low: int = 2, high: int = 12) -> str:
        return self.rng.choice(PHRASES[part]) if part in PHRASES and self.rng.random() < 0.5 else self.sentence(low, high)

    def link(self, text: str) -> str:
        return f'<a href="/{self.rng.randrange(999)}">{text}</a>'

    def list_of_links(self, part: str, most: int = 12) -> str:
        rng = self.rng
        items = [self.link(rng.choice(PHRASES[part]) if part in PHRASES and rng.random() < 0.4 else self.words(rng.randrange(1, 4))) for _ in range(rng.randrange(2, most))]
        if rng.random() < 0.75:
            end = "</li>" if rng.random() < 0.9 else ""
            return "<ul>" + "".join(f"<li>{MARKS[0]}{i}{end}" for i in items) + "</ul>"
        return MARKS[0] + rng.choice((" | ", " ", " · ", " &raquo; ")).join(items)

    def menu(self) -> str:
        return self.named("menu", self.list_of_links("menu"), "nav")

    def header(self) -> str:
        rng = self.rng
        inner = self.one(0, rng.choice(["h1", "p", "div", "h2"]), self.words(rng.randrange(1, 5))) + (self.one(0, "p", self.sentence(2, 9)) if rng.random() < 0.5 else "")
        return self.named("header", inner + (self.menu() if rng.random() < 0.4 else ""), "header")

    def footer(self) -> str:
        rng = self.rng
        line = f"{rng.choice(['&copy;', '©', 'Copyright', ''])} {self.words(rng.randrange(1, 3))} {rng.choice(['&middot;', '-', '|', ''])} {self.phrase('footer', 2, 14)}"
        inner = MARKS[0] + line if rng.random() < 0.5 else self.one(0, "p", line)
        return self.named("footer", inner + (self.list_of_links("footer", 6) if rng.random() < 0.4 else ""), "footer")

    def side(self) -> str:
        rng = self.rng
        head = self.one(0, rng.choice(["h3", "h4", "h2", "p"]), self.phrase("side", 1, 4)) if rng.random() < 0.8 else ""
        inner = self.list_of_links("side") if rng.random() < 0.6 else "".join(self.one(0, "p", self.sentence()) for _ in range(rng.randrange(1, 5)))
        return self.named("side", head + inner, "aside")

    def small(self, part: str, *tags: str) -> str:
        rng = self.rng
        text = " ".join(self.phrase(part) for _ in range(rng.randrange(1, 4)))
        inner = MARKS[0] + text if rng.random() < 0.5 else self.one(0, "p", text)
        if rng.random() < 0.3:
            inner += self.one(0, "button", self.phrase(part, 1, 3))
        return self.named(part, inner, *tags)

    def form(self) -> str:
        rng = self.rng
        inner = self.one(0, rng.choice(["p", "label", "h3", "div"]), self.phrase("form", 2, 10))
        inner += '<input type="text" name="q">' + (self.one(0, "button", self.phrase("form", 1, 3)) if rng.random() < 0.7 else "")
        if rng.random() < 0.3:
            inner += "<select>" + "".join(self.one(0, "option", self.words(1)) for _ in range(3)) + "</select>"
        return self.named("form", inner, "form", "form")

    def comments(self) -> str:
        rng = self.rng
        out = self.one(0, rng.choice(["h2", "h3", "h4", "p"]), rng.choice(PHRASES["comments"]))
        for _ in range(rng.randrange(1, 7)):
            name = self.one(0, rng.choice(["b", "span", "div", "h4", "p"]), self.words(rng.randrange(1, 3)) + (" says:" if rng.random() < 0.3 else ""))
            body = self.one(0, "p", self.paragraph()) if rng.random() < 0.7 else MARKS[0] + self.paragraph()
            tag = rng.choice(["div", "div", "li", "article", "section"])
            out += f'<{tag} class="{rng.choice(["comment", "comment", "reply", "response", "comment-body", "user-comment", "review"])}">{name}{"" if name.startswith(("<b", "<span")) and body[0] == MARKS[0] and rng.random() < 0.5 else "<hr>"}{body}</{tag}>'
        return self.named("comments", out)

    def body(self, parts: float = 0.03) -> str:
        """Main text, with other parts in between where rng falls below parts; phrases of other parts occur in it as well."""
        rng, out = self.rng, []
        if rng.random() < 0.75:
            title = self.one(1, rng.choice(["h1", "h1", "h2"]), self.words(rng.randrange(2, 12)))
            out.append(f"<header>{title}</header>" if rng.random() < 0.1 else title)
        for _ in range(rng.choice((1, 2, 3, 5, 8, 12, 20))):
            kind = rng.random()
            if kind < 0.02:
                out.append(self.one(1, "p", self.phrase(rng.choice(["footer", "side", "notice", "form", "comments", "ad"]), 1, 5)))
            elif kind < 0.7:
                out.append(self.one(1, "p", self.paragraph(), 0.85))
            elif kind < 0.76:
                out.append(f"<p><b>{MARKS[1]}{self.paragraph()}<br>")
            elif kind < 0.81:
                out.append(self.one(1, rng.choice(["h2", "h3", "h4"]), self.words(rng.randrange(1, 8))))
            elif kind < 0.86:
                tag = rng.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(self.one(1, "li", self.sentence(1, 15), 0.8) for _ in range(rng.randrange(2, 7))) + f"</{tag}>")
            elif kind < 0.89:
                out.append(f"<blockquote>{self.one(1, 'p', self.paragraph())}</blockquote>")
            elif kind < 0.91:
                out.append(self.one(1, "pre", self.sentence()))
            elif kind < 0.93:
                out.append("<table>" + "".join("<tr>" + "".join(self.one(1, "td", self.words(rng.randrange(1, 5))) for _ in range(3)) + "</tr>" for _ in range(rng.randrange(2, 4))) + "</table>")
            elif kind < 0.95:
                out.append(f"<figure><img src=x>{self.one(1, 'figcaption', self.sentence())}</figure>")
            else:
                out.append(self.one(1, "div", self.paragraph()))
            if rng.random() < parts:
                out.append(rng.choice([lambda: self.small("ad", "ins"), self.side, lambda: self.named("share", self.list_of_links("share", 6)), self.form])())
        return "".join(out)

    def page(self) -> str:
        rng = self.rng
        plain = rng.random() < 0.3  # one landmark around nothing but the main text
        main = self.body(0 if plain else 0.05) if rng.random() < 0.96 else ""
        comments = self.comments() if rng.random() < 0.3 else ""
        inside = comments if not plain and rng.random() < 0.4 else ""
        for _ in range(1 if plain else rng.randrange(1, 3)):
            kind = rng.random() * (0.5 if plain else 1)
            if kind < 0.35:
                main = f"<article>{main}{inside}</article>"
            elif kind < 0.5:
                main = f"<main>{main}{inside}</main>"
            elif kind < 0.9:
                main = self.named("main", main + inside, *(["article"] if rng.random() < 0.5 else []))
            else:
                main = f"<div>{main}{inside}</div>"
            inside = ""
        before = [p() for p, share in ((lambda: self.small("notice"), 0.2), (self.header, 0.5), (self.menu, 0.7), (lambda: self.small("ad", "ins"), 0.5), (self.form, 0.15), (self.side, 0.15)) if rng.random() < share]
        rng.shuffle(before)
        after = [p() for p, share in ((lambda: self.named("share", self.list_of_links("share", 6)), 0.2), (self.side, 0.35), (self.form, 0.15), (lambda: self.small("ad", "ins"), 0.2)) if rng.random() < share]
        rng.shuffle(after)
        if comments and comments not in main:
            after.insert(0, comments)
        if rng.random() < 0.7:
            after.append(self.footer())
        if rng.random() < 0.15:
            after.append(self.small("notice"))
        if rng.random() < 0.1:
            body = f"<table><tr><td>{''.join(before)}</td><td>{main}</td></tr></table>{''.join(after)}"
        elif rng.random() < 0.3:
            body = f"{''.join(before)}<div class=\"{rng.choice(['wrapper', 'container', 'page', 'row', 'site', 'layout'])}\">{main}{''.join(after)}</div>"
        else:
            body = "".join(before) + main + "".join(after)
        head = f"<head><meta charset=utf-8><title>{self.words(5)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        return f"<!DOCTYPE html><html lang=en>{head}<body>{body}" + ("</body></html>" if rng.random() < 0.9 else "")
