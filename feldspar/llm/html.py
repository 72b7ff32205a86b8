"""Main text of web pages by a tree-structured graphical model.

The block elements of a page form a tree.  Text is content or not, an element is content if some text in it is; its tag, its class and
id words, its size and its links give it a potential, and every parent and child share another.  Sum-product messages go up and then down the
tree and leave each element's marginal; text whose element is content with probability 1/2 or more is kept.
The potentials are fitted by likelihood to labelled pages.  As no labelled pages are given, labelled_pages()
writes them: pages of many layouts whose content is known because it was put there.

Rules: null or empty html gives an empty text.  Scripts, styles, heads, templates, drawings and form controls never count.  A header,
footer or aside is no content inside an article either.  Pages of any length are read whole.
Unclosed and misnested tags are repaired as browsers do it for blocks; a tag cut off by the end of the page is dropped.
<br> is white space.  Equal pages give equal texts.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kind, pick, ship, spread

BLOCKS = set("""html body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
HIDDEN = set("head script style noscript template svg iframe object canvas select textarea button option datalist audio video title".split())
RAW = {"script", "style", "textarea", "title", "iframe", "noscript"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the second kind ends where one of the first begins.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
#: What may stand in a head.
HEAD = set("base basefont bgsound link meta noframes noscript script style template title".split())
_COMMENT_END = re.compile(r"--!?>")
_CUT = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+|[A-Z]+[a-z]*")
THRESHOLD = 0.5
#: Labelled pages that a class or id word needs to count; other words say nothing.
NAMED = 4
#: Elements deeper than this stand beside each other, as in browsers.
DEEPEST = 512


class Page:
    """parent, tag, names of the blocks, and the texts in page order as (block, text, characters in links)."""

    def __init__(self, html: str | None):
        self.parent, self.tag, self.names = [-1], ["html"], [()]
        self.texts: list[tuple[int, str, int]] = []
        self._stack, self._links, self._parts, self._linked = [0], 0, [], 0
        self._body = False
        self._read(html or "")

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                self._in_body()
                block = self._stack[-1]
                if self.tag[block] not in _GROUP:  # text straight in a container is a paragraph without tags
                    self.parent.append(block)
                    self.tag.append("p")
                    self.names.append(())
                    block = len(self.tag) - 1
                self.texts.append((block, text, self._linked))
            self._parts, self._linked = [], 0

    def _in_body(self) -> None:
        """A page whose body has no tag has a body all the same."""
        if not self._body:
            self._body = True
            self.parent.append(0)
            self.tag.append("body")
            self.names.append(())
            self._stack.append(len(self.tag) - 1)

    def _text(self, raw: str) -> None:
        if raw:
            t = entities.unescape(raw) if "&" in raw else raw
            self._parts.append(t)
            if self._links:
                self._linked += len(t.strip())

    def _open(self, tag: str, attributes: str) -> None:
        self._flush()
        if tag in ("html", "body") and tag in (self.tag[i] for i in self._stack):
            return
        if tag == "body":
            self._body = True
        elif tag != "html":
            self._in_body()
        stack = self._stack
        ends = CLOSES.get(tag)
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                if self.tag[stack[k]] in ends:
                    del stack[k:]
                    break
                if self.tag[stack[k]] in ("ul", "ol", "dl", "table", "menu", "dir"):
                    break
        elif self.tag[stack[-1]] == "p":
            stack.pop()
        if len(stack) >= DEEPEST:
            stack.pop()
        if tag == "body":  # its names tell of the page, not of the element
            attributes = ""
        names = tuple(w.lower() for m in _NAMES.finditer(attributes) for w in _WORD.findall(m[1] or m[2] or m[3] or "")) if attributes else ()
        self.parent.append(stack[-1])
        self.tag.append(tag)
        self.names.append(names)
        if tag != "hr":
            stack.append(len(self.tag) - 1)

    def _close(self, tag: str) -> None:
        self._flush()
        for k in range(len(self._stack) - 1, 0, -1):
            if self.tag[self._stack[k]] == tag:
                del self._stack[k:]
                self._links = 0
                return

    def _read(self, s: str) -> None:
        at, n = 0, len(s)
        while at < n:
            lt = s.find("<", at)
            if lt < 0:
                self._text(s[at:])
                break
            self._text(s[at:lt])
            if self._declared(s, lt):
                at = self._past(s, lt)
                continue
            m = _TAG.match(s, lt)
            if m is None:
                if not re.compile(r"</?[a-zA-Z]").match(s, lt):
                    self._text("<")
                    at = lt + 1
                    continue
                m = _CUT.match(s, lt)  # a quote that never ends
                if m is None:
                    break
            at, closing, tag = m.end(), bool(m[1]), m[2].lower()
            if tag in HIDDEN:
                if not closing:
                    at = self._skip(s, at, tag)
            elif tag in BLOCKS:
                self._close(tag) if closing else self._open(tag, m[3])
            elif tag == "a":
                self._links = 0 if closing else 1
            elif tag == "br":
                self._parts.append(" ")
        self._flush()

    @staticmethod
    def _declared(s: str, at: int) -> bool:
        """Whether a comment, a declaration or an end tag without a name begins there."""
        return s.startswith(("<!", "<?"), at) or s.startswith("</", at) and at + 2 < len(s) and not (s[at + 2].isascii() and s[at + 2].isalpha())

    @staticmethod
    def _past(s: str, at: int) -> int:
        """Past a comment, as browsers end it, or past a declaration."""
        if not s.startswith("<!--", at):
            end = s.find(">", at)
            return end + 1 if end >= 0 else len(s)
        for empty in ("<!-->", "<!--->"):
            if s.startswith(empty, at):
                return at + len(empty)
        m = _COMMENT_END.search(s, at + 4)
        return m.end() if m else len(s)

    @staticmethod
    def _skip(s: str, at: int, tag: str) -> int:
        """Past the end of an element that never counts."""
        if tag == "head":
            return Page._skip_head(s, at)
        m = re.compile(rf"</{tag}(?:[\s/][^>]*)?>", re.IGNORECASE).search(s, at)
        if m is None and tag not in RAW:
            return at
        return m.end() if m else len(s)

    @staticmethod
    def _skip_head(s: str, at: int) -> int:
        """Past </head>, or before the first text or tag that can't stand in a head."""
        while at < len(s):
            if s[at].isspace():
                at += 1
            elif Page._declared(s, at):
                at = Page._past(s, at)
            else:
                m = _TAG.match(s, at)
                if m is None:
                    return at
                closing, tag = bool(m[1]), m[2].lower()
                if tag not in HEAD | {"head"} if not closing else tag in ("body", "html", "br"):
                    return at
                at = m.end()
                if closing and tag == "head":
                    return at
                if not closing and tag in HIDDEN and tag != "head":
                    at = Page._skip(s, at, tag)
        return at


# ---- potentials ---------------------------------------------------------------------------------

_TAGS = {t: i for i, t in enumerate(sorted(BLOCKS))}
_SIZES = np.array([1, 4, 11, 26, 61, 200])
_BASE = 1 + len(_TAGS)  # bias, tags
_LAYOUT = [7, 5, 5]  # words below a container, own links, links below
FIXED = _BASE + sum(_LAYOUT)  # then one for each class or id word that the model knows
#: Kinds of children: text, list part, and all others containers.  A text with a known name counts as a container: a notice may stand anywhere.
_GROUP = {t: 0 for t in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "dd", "dt", "figcaption")} | {t: 2 for t in ("li", "ul", "ol", "dl")}


class Forest:
    """The blocks of several pages with their features, by depth; names: the known class and id words, numbered."""

    def __init__(self, pages: list[Page], names: dict[str, int]):
        self.offsets = np.cumsum([0, *(len(p.tag) for p in pages)])
        n = int(self.offsets[-1])
        self.parent = np.concatenate([np.array(p.parent) + np.where(np.array(p.parent) >= 0, o, 0) for p, o in zip(pages, self.offsets)] or [np.zeros(0, int)])
        words, links, chars = (np.zeros(n) for _ in range(3))
        for p, o in zip(pages, self.offsets):
            for block, text, linked in p.texts:
                words[o + block] += text.count(" ") + 1
                chars[o + block] += len(text)
                links[o + block] += min(linked, len(text))
        depth = np.zeros(n, int)
        for i in range(n):  # parents come before their children
            if self.parent[i] >= 0:
                depth[i] = depth[self.parent[i]] + 1
        self.levels = [np.flatnonzero(depth == d) for d in range(depth.max() + 1 if n else 0)]
        below = np.stack([words, links, chars], 1)
        for level in self.levels[:0:-1]:
            np.add.at(below, self.parent[level], below[level])
        tags = [t for p in pages for t in p.tag]
        tag = np.array([_TAGS[t] for t in tags], int)
        self.group = np.array([_GROUP.get(t, 1) for t in tags], int)

        def share(a, b):
            r = np.divide(a, b, out=np.zeros(n), where=b > 0)
            return np.where(b > 0, 1 + np.searchsorted([0.01, 0.3, 0.7], r, "right"), 0)

        # a paragraph's or item's length says nothing, and dozens of them would say it loudly
        columns = [np.where(self.group == 1, np.searchsorted(_SIZES, below[:, 0], "right"), 0), share(links, chars), share(below[:, 1], below[:, 2])]
        starts = _BASE + np.cumsum([0, *_LAYOUT[:-1]])
        fixed = np.stack([np.zeros(n, int), 1 + tag, *[s + c for s, c in zip(starts, columns)]], 1)
        named = [(i, FIXED + names[w]) for i, ws in enumerate(w for p in pages for w in p.names) for w in sorted(set(ws)) if w in names]
        if named:
            self.group[[i for i, _ in named]] = 1
        self.row = np.concatenate([np.repeat(np.arange(n), fixed.shape[1]), np.array([i for i, _ in named], int)])
        self.column = np.concatenate([fixed.ravel(), np.array([c for _, c in named], int)])
        self.n = n


class Model:
    """unary: a weight for each feature; pair[g]: log potential of parent state and child state, by the child's group."""

    def __init__(self, names: dict[str, int] | None = None):
        self.names = names or {}
        self.unary, self.pair = np.zeros(FIXED + len(self.names)), np.zeros((3, 2, 2))

    def infer(self, f: Forest) -> tuple[np.ndarray, np.ndarray]:
        """Each block's marginal, and its joint distribution with its parent."""
        own = np.zeros((f.n, 2))
        own[:, 1] = np.bincount(f.row, self.unary[f.column], f.n)
        up = own.copy()  # potential and all messages from below
        message = np.zeros((f.n, 2))
        pair = self.pair[f.group]
        for level in f.levels[:0:-1]:
            message[level] = np.logaddexp.reduce(pair[level] + up[level][:, None, :], axis=2)
            message[level] -= message[level].max(1, keepdims=True)
            np.add.at(up, f.parent[level], message[level])
        belief = up.copy()
        joint = np.zeros((f.n, 2, 2))
        for level in f.levels[1:]:
            rest = belief[f.parent[level]] - message[level]  # what the parent knows without this child
            j = rest[:, :, None] + pair[level] + up[level][:, None, :]
            j -= np.logaddexp.reduce(j.reshape(-1, 4), axis=1)[:, None, None]
            joint[level] = np.exp(j)
            belief[level] = np.logaddexp(j[:, 0], j[:, 1])
        return np.exp(belief[:, 1] - np.logaddexp(belief[:, 0], belief[:, 1])), joint

    def fit(self, pages: list[Page], truth: list[np.ndarray], rounds: int = 150, pull: float = 1e-3) -> Model:
        """Gradient ascent (Adam) on the likelihood of the labels, with a weak pull to zero."""
        count = Counter(w for p in pages for w in {w for ws in p.names for w in ws})
        self.__init__({w: k for k, w in enumerate(sorted(w for w in count if count[w] >= NAMED))})
        f = Forest(pages, self.names)
        y = np.concatenate(truth).astype(int)
        child = f.parent >= 0
        seen_pair = np.zeros((3, 2, 2))
        np.add.at(seen_pair, (f.group[child], y[f.parent[child]], y[child]), 1)
        moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (self.unary, self.pair)]
        for t in range(1, rounds + 1):
            p, joint = self.infer(f)
            unary = np.bincount(f.column, (y - p)[f.row], len(self.unary)) / len(pages) - pull * self.unary
            pair = seen_pair.copy()
            np.subtract.at(pair, f.group[child], joint[child])
            for x, g, m in zip((self.unary, self.pair), (unary, pair / len(pages) - pull * self.pair), moments):
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.99 * m[1] + 0.01 * g * g
                x += 0.1 * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.99**t)) + 1e-8)
        return self

    def texts(self, pages: list[Page]) -> list[str]:
        p, _ = self.infer(Forest(pages, self.names)) if pages else (None, None)
        out, o = [], 0
        for page in pages:
            out.append("\n".join(t for block, t, _ in page.texts if p[o + block] >= THRESHOLD))
            o += len(page.tag)
        return out


# ---- labelled pages -----------------------------------------------------------------------------


def labelled_pages(n: int = 600, seed: int = 7) -> list[tuple[str, list[str]]]:
    """Pages of random layouts and the texts in them that are content, each text unlike any other."""
    r = random.Random(seed)
    spoken = ["".join(r.choices("aeioulnrstdmk", k=r.randint(2, 9))) for _ in range(4000)]
    out = []
    for _ in range(n):
        count = [0]
        good: list[str] = []

        def words(k: int, stop: str = "") -> str:
            count[0] += 1
            return f"{' '.join([*r.choices(spoken, k=k), f'{count[0]}x'])}{stop}"

        style = r.choice(["plain", "plain", "plain", "bare", "bars", "marks", "terse", "terse"])

        def sentence(lo: int = 3, hi: int = 18) -> str:
            t = words(r.randint(lo, hi), r.choice([".", ".", ".", "!", "?", ""])).capitalize()
            if style == "plain":
                return t
            if style == "terse":
                return words(r.randint(0, 3), ".")
            t = t.strip(".!?")
            return t if style == "bare" else " | ".join(t.split()) + " |" if style == "bars" else " ".join(w + r.choice(["***", "###", "%%%", "!!"]) for w in t.split())

        def links(k: int) -> str:
            return "".join(f"<li><a href='/{i}'>{words(r.randint(1, 3))}</a></li>" for i in range(k))

        def menu() -> str:
            if r.random() < 0.7:
                return f"<ul>{links(r.randint(2, 9))}</ul>"
            return r.choice([" ", " | ", " &middot; ", "<br>"]).join(f"<a href='/{i}'>{words(r.randint(1, 3))}</a>" for i in range(r.randint(1, 8)))

        def short() -> str:
            return r.choice([lambda: sentence(1, 6), lambda: running(), lambda: running()])()

        def running() -> str:
            return " ".join(sentence(1, 18) for _ in range(r.choice([1, 1, 1, 2, 3, 5, 8, 14])))

        def clutter(where: str) -> str:
            kinds = {
                "nav": lambda: f"<{(t := r.choice(['nav', 'nav', 'div role=navigation']))}{r.choice(['', ' class=menu', ' id=nav'])}>{menu()}</{t.split()[0]}>",
                "menu": lambda: f"<div class='{r.choice(['menu', 'navigation', 'nav-bar', 'breadcrumbs', 'breadcrumb', 'navbar', 'top-menu', 'pagination', 'pager', 'toolbar', 'tabs'])}'>{menu()}</div>",
                "header": lambda: f"<header{r.choice(['', ' class=site-header', ' id=header'])}>{r.choice(['<h1>{0}</h1>', '<p>{0}</p>', '{0}', '<div class=logo>{0}</div>']).format(short())}</header>",
                "headdiv": lambda: f"<div {r.choice(['class', 'id', 'role'])}='{r.choice(['header', 'masthead', 'banner', 'banner', 'top', 'topbar', 'site-header', 'branding'])}'><p>{short()}</p></div>",
                "ad": lambda: f"<{(t := r.choice(['div', 'aside', 'section', 'p']))} {r.choice(['class', 'id'])}='{r.choice(['ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'promotion', 'ad-slot', 'adbox', 'adsense', 'banner-ad', 'sponsor', 'commercial', 'partner', 'leaderboard'])}'>{r.choice(['<p>{0}</p>', '{0}', '<a href=x>{0}</a>']).format(short()) if t != 'p' else short()}</{t}>",
                "aside": lambda: f"<aside{r.choice(['', ' class=sidebar', ' id=sidebar', ' class=related'])}><h3>{short()}</h3>{r.choice(['<p>{0}</p>', '<ul>{1}</ul>']).format(short(), links(r.randint(1, 6)))}</aside>",
                "side": lambda: f"<div class='{r.choice(['sidebar', 'sidebar', 'sidebar', 'col-md-4 sidebar', 'side', 'widget', 'related', 'related-posts', 'recommended', 'recommendations', 'more-stories', 'trending', 'popular', 'share', 'sharing', 'social', 'follow', 'tags', 'side-column', 'rail'])}'><h4>{short()}</h4><p>{short()}</p><ul>{links(r.randint(0, 5))}</ul></div>",
                "notice": lambda: f"<{(t := r.choice(['div', 'div', 'div', 'section', 'dialog', 'p']))} {r.choice(['class', 'id'])}='{r.choice(['cookie', 'cookie-notice', 'cookie-banner', 'notice', 'consent', 'gdpr', 'alert', 'popup', 'modal', 'newsletter', 'subscribe', 'paywall', 'disclaimer', 'warning', 'message', 'privacy', 'cookies', 'overlay', 'toast', 'signup', 'banner'])}'>{r.choice(['<p>{0}</p>', '{0}', '<p>{0}</p><button>ok</button>']).format(short()) if t != 'p' else short()}</{t}>",
                "form": lambda: f"<form{r.choice(['', ' class=search', ' id=login', ' class=newsletter'])}><p>{short()}</p><label>{words(2)}</label><input name=q><button>{words(1)}</button></form>",
                "comments": lambda: f"<{(t := r.choice(['section', 'div']))} {r.choice(['class', 'id'])}='{r.choice(['comments', 'comment-list', 'responses', 'discussion', 'replies', 'disqus', 'reader-comments', 'user-comments', 'comment-section', 'feedback', 'reviews'])}'><h3>{words(2)}</h3>"
                + "".join(r.choice(["<div class='comment'><p>{0}</p></div>", "<p>{0}</p>", "<article class=comment><p>{0}</p></article>", "<ul><li class=comment>{0}</li></ul>"]).format(running()) for _ in range(r.randint(1, 5)))
                + f"</{t}>",
                "footer": lambda: f"<footer{r.choice(['', ' class=site-footer', ' id=footer'])}>{r.choice(['&copy; {0}', '<p>{0}</p>', '<ul>{1}</ul>', '&copy; {0} &middot; {2}']).format(short(), links(3), short())}</footer>",
                "footdiv": lambda: f"<div {r.choice(['class', 'id', 'role'])}='{r.choice(['footer', 'contentinfo', 'bottom', 'copyright', 'site-footer', 'legal', 'colophon', 'foot', 'credits'])}'><p>{short()}</p></div>",
                "script": lambda: "<script>var a='<p>no</p>';</script><style>p{x:y}</style><!-- <p>no</p> -->",
            }
            names = {"top": ["nav", "menu", "header", "headdiv", "ad", "notice", "script", "form"], "in": ["ad", "aside", "notice", "form", "script", "side"], "end": ["side", "aside", "comments", "comments", "footer", "footdiv", "nav", "notice", "form", "ad", "script"]}[where]
            return kinds[r.choice(names)]()

        def keep(t: str) -> str:
            good.append(t)
            return t

        plain = r.random() < 0.4  # paragraphs alone

        def piece() -> str:
            k = 0.0 if plain else r.random()
            if k < 0.62:
                t = running()
                form = r.choice(["<p>{0}</p>"] * 5 + ["<p><b>{0}<br>", "<p>{0}", "<p class=lead>{0}</p>", "<div>{0}</div>", "<div class=paragraph>{0}</div>"])
                return form.format(keep(t))
            if k < 0.76:
                return f"<h{(h := r.randint(2, 4))}>{keep(sentence(1, 7))}</h{h}>"
            if k < 0.84:
                return "<ul>" + "".join(f"<li>{keep(sentence(2, 12))}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
            if k < 0.89:
                return f"<blockquote><p>{keep(sentence(5, 25))}</p></blockquote>"
            if k < 0.92:
                return f"<pre>{keep(words(6))}</pre>"
            if k < 0.95:
                return f"<figure><img src=x><figcaption>{keep(sentence(3, 10))}</figcaption></figure>"
            if k < 0.97:
                return "<table>" + "".join(f"<tr><td>{keep(words(2))}</td><td>{keep(words(3))}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
            return f"<section>{piece()}{piece()}</section>"

        def neutral(inside: str = "{0}") -> str:
            """Elements around it that say nothing: without names, or with names of the layout, or made-up ones."""
            for _ in range(r.choice([1, 1, 1, 2, 2, 3, 5])):
                made = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 7)))
                said = f"{r.choice(['has', 'with', 'no', 'sticky', 'show'])}-{r.choice(['sidebar', 'menu', 'header', 'footer', 'ads', 'comments', 'banner', 'nav'])}"  # of the page, not of the element
                name = r.choice([made, made, said, *"wrapper wrap container col row inner outer page site layout grid box block root app center left middle column cell col-md-8 holder group panel view flex body".split()])
                t = r.choice(["div"] * 8 + ["section", "center", "td"])
                mark = r.choice(["", "", f" class={name}", f" id={name}", f" class='{name} {made}'"])
                inside = f"<table{mark}><tr><td>{inside}</td></tr></table>" if t == "td" else f"<{t}{mark}>{inside}</{t}>"
            return inside

        wrap = r.choice(
            ["<article>{0}</article>"] * 6
            + ["<main>{0}</main>", "<main><article>{0}</article></main>", "<div class=content>{0}</div>", "<div id=main-content><div class=post-body>{0}</div></div>", "<article class=post><div class=entry-content>{0}</div></article>", "<section class=article-body>{0}</section>", "<div class='story article-text'>{0}</div>", "<section>{0}</section>"]
            + [neutral()] * 6
            + [neutral("<article>{0}</article>"), f"<article>{neutral()}</article>", f"<main>{neutral()}</main>"]
            + ["{0}"] * 4
        )
        loose = wrap == "{0}" and r.random() < 0.4  # text without elements, straight in the body

        def stretch() -> str:
            lines = [running() for _ in range(r.randint(1, 4))]
            keep(" ".join(lines))
            return r.choice(["<br>", "<br><br>"]).join(lines) + "<hr>"

        alone = r.random() < 0.25  # nothing around the content
        top = "" if alone else "".join(clutter("top") for _ in range(r.randint(0, 4)))
        body = f"<h1>{keep(sentence(1, 9))}</h1>" if r.random() < 0.6 else ""
        if "<article" in wrap and r.random() < 0.15:
            body = f"<header>{r.choice(['<h1>{0}</h1>', '<h1>{0}</h1><p>{1}</p>', '<p>{1}</p>']).format(sentence(1, 9), short())}</header>" + body
        for _ in range(r.choice([1, 1, 1, 2, 3, 5, 8, 14, 30] if not body else [0, 1, 2, 4, 8, 14, 30, 60])):
            body += stretch() if loose else piece()
            if r.random() < 0.12:
                body += clutter("in")
        inside = clutter("end") if r.random() < 0.15 and not alone else ""
        body = wrap.replace("{0}", body + inside)
        end = "" if alone else "".join(clutter("end") for _ in range(r.randint(0, 5)))
        frame = "{0}{1}{2}" if wrap == "{0}" else r.choice(["{0}{1}{2}"] * 4 + [neutral("{0}{1}{2}"), neutral("{0}{1}{2}"), neutral("{0}") + "{1}{2}", "{0}" + neutral("{1}") + "{2}", neutral("{0}" + neutral("{1}") + "{2}"), "{0}" + neutral("{1}{2}"), f"<table{r.choice(['', ' width=100%'])}><tr><td{r.choice(['', ' class=menu', ' class=side'])}>{{0}}</td><td>{{1}}</td></tr></table>{{2}}"])
        page = frame.replace("{0}", top).replace("{2}", end).replace("{1}", body)
        page = f"<!DOCTYPE html><html lang=en><head><title>{words(3)}</title>{r.choice(['</head><body>', '</head><body>', '</head><body>', '</head>', '<body>'])}{page}</body></html>"
        if r.random() < 0.1:
            page = page[: r.randint(len(page) * 3 // 4, len(page))]
        out.append((page, good))
    return out


def truth_of(page: Page, good: list[str]) -> np.ndarray:
    """A block with text of its own is content if all of that is; a block without if some block in it is."""
    wanted = {" ".join(g.split()) for g in good}
    own: dict[int, list[bool]] = {}
    for block, t, _ in page.texts:
        own.setdefault(block, []).append(t in wanted or any(w.startswith(t) for w in wanted))
    n = len(page.tag)
    y = np.zeros(n, int)
    children: list[list[int]] = [[] for _ in range(n)]
    for i, p in enumerate(page.parent):
        if p >= 0:
            children[p].append(i)
    for i in range(n - 1, -1, -1):
        votes = own.get(i)
        y[i] = all(votes) if votes else any(y[c] for c in children[i])
    return y


_fitted: list[Model] = []


def fitted() -> Model:
    """The model of the labelled pages (fitted once in each process that asks)."""
    if not _fitted:
        pages = [(Page(h), good) for h, good in labelled_pages()]
        _fitted.append(Model().fit([p for p, _ in pages], [truth_of(p, g) for p, g in pages]))
    return _fitted[0]


def extract(df: DataFrame, model: Model | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    import pyarrow as pa

    ship(df.sparkSession)
    model = model or fitted()
    df = pick(df, page_id, url, html)
    schema = f"`{page_id}` {kind(df, page_id)}, `{url}` string, text string, n_chars long"

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = model.texts([Page(h.as_py()) for h in part.column(2)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [page_id, url, "text", "n_chars"])

    return df.mapInArrow(run, schema)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spread(spark.read.parquet(f"{sf_dir}/pages.parquet")))


QUERIES = {"op6_html": op6_html}
ORACLE_SQL: dict[str, str] = {}
