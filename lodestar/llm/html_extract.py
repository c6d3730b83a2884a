"""Main text of web pages by a recurrent block labeller.

A page is read into blocks: stretches of text between block-level tags or line breaks. A block is seen as a
vector of its tag path (hashed tag names, class and id words, fading with distance), of its hashed words,
and of a few shares (links, punctuation, place on the page). A bidirectional LSTM in numpy reads the blocks
of the whole page in both directions and labels each as main text or not. Scripts, styles, templates, titles,
text areas, frames and comments are no blocks; what stands in other elements is read.

The labeller is trained on TRAIN_PAGES labelled pages, a fixed number whatever the input, that
:func:`labelled_page` makes from a seed: articles of invented words between menus, headers, footers,
sidebars, notices, adverts, forms and reader comments in many markups, with and without telling names. The
weights (a fixed size, under a megabyte) are broadcast.

Nulls: a null page is empty and gives an empty text; a null page_id or url stays null. Repeated rows give
equal rows. Broken markup is read as far as it goes: unclosed elements end where their parent does, a "<"
that opens no tag is text. Text without any markup is one page of blocks like any other. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.textcore import buffers, hash_spans, spans

PATH, WORDS, SHARES, HIDDEN = 256, 256, 9, 24
TRAIN_PAGES, EPOCHS, SEED = 2400, 7, 20240229
#: Cells (pages times longest page) that are labelled at once; a longer page is labelled alone.
CELLS = 8192
FADE = 0.85
_TEXT = "page_id long, url string, text string, n_chars long"

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style template title textarea iframe xmp".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr ruby rb rt rp input label math mrow mi mo mn msup msub msubsup mfrac msqrt mtext semantics".split())
_CLOSES = {"li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "thead": "tr td th", "tbody": "tr td th thead"}
_CLOSES = {k: frozenset(v.split()) for k, v in _CLOSES.items()}
_SCOPE = frozenset("ul ol dl table select div section article main aside nav body".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+>|[^>]*>)""", re.S)
_NAMES = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_BETWEEN = np.zeros(256, bool)
_BETWEEN[[b for b in range(128) if not chr(b).isalnum()]] = True
#: Marks main text in labelled pages; taken out before anything reads the words.
_MARK = "\ue000"


def _closed(source: str) -> tuple[str, str]:
    """The page up to its last tag's end, and the text behind it, where no tag and only a comment can begin."""
    last = source.rfind(">") + 1
    main, tail = source[:last], source[last:]
    for begin, end in (("<!--", "-->"), ("<![CDATA[", "]]>")):
        at = main.rfind(begin)
        tail = "" if at >= 0 and main.find(end, at) < 0 else tail.split(begin, 1)[0]
    return main, tail


@functools.lru_cache(1 << 14)
def _names(attributes: str) -> tuple[str, ...]:
    """Words of the class, id, role and itemprop of a tag."""
    out = []
    for m in _NAMES.finditer(attributes):
        out += [p.lower() for p in _PART.findall(m[2] or m[3] or m[4] or "")]
    return tuple(dict.fromkeys(out))


def _slots(token: str) -> tuple[int, int]:
    h = zlib.crc32(token.encode())
    return h % PATH, (h >> 16) * 31 % PATH


class Page:
    """Blocks of a page: texts, shares of link characters, number of the path of each; vectors of the paths."""

    def __init__(self, source: str):
        self.texts: list[str] = []
        self.links: list[float] = []
        self.paths: list[int] = []
        self.vectors: list[np.ndarray] = [np.zeros(PATH, np.float32)]
        self._known: dict[tuple[int, str, tuple[str, ...]], int] = {}
        self._parts: list[tuple[str, bool]] = []
        self._path = 0
        self._read(source)

    def _under(self, parent: int, tag: str, attributes: str) -> int:
        names = _names(attributes) if "=" in attributes else ()
        key = (parent, tag, names)
        at = self._known.get(key)
        if at is None:
            v = self.vectors[parent] * np.float32(FADE)
            for token in (f"<{tag}>", *(f".{x}" for x in names)):
                v[list(_slots(token))] = 1
            at = self._known[key] = len(self.vectors)
            self.vectors.append(v)
        return at

    def _flush(self) -> None:
        if not self._parts:
            return
        whole = "".join(t for t, _ in self._parts)
        text = " ".join((html.unescape(whole) if "&" in whole else whole).split())
        if text:
            linked = sum(len(t) for t, link in self._parts if link)
            self.texts.append(text)
            self.links.append(linked / len(whole))
            self.paths.append(self._path)
        self._parts = []

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]
        open_: dict[str, int] = {}
        at, links = 0, 0

        def pop_to(depth: int) -> None:
            nonlocal links
            while len(stack) > depth:
                tag, _ = stack.pop()
                open_[tag] -= 1
                links -= tag == "a"

        def say(text: str) -> None:
            if text and (self._parts or not text.isspace()):
                if not self._parts:
                    self._path = stack[-1][1]
                self._parts.append((text, links > 0))

        source, tail = _closed(source)
        find = _TAG.search
        while m := find(source, at):
            say(source[at : m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag, closing, rest = tag.lower(), m[1], m[3]
            if tag not in _INLINE:
                self._flush()
            if closing:
                if open_.get(tag):
                    depth = len(stack) - 1
                    while stack[depth][0] != tag:
                        depth -= 1
                    pop_to(depth)
                continue
            if tag in _RAW:
                end = re.compile(f"</{tag}\\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else len(source)
                tail = tail if end else ""
                continue
            if tag in _VOID or rest.endswith("/>") and tag not in _INLINE and tag not in _SCOPE and tag != "p":
                continue
            if tag not in _INLINE and open_.get("p"):
                depth = len(stack) - 1
                while stack[depth][0] != "p":
                    depth -= 1
                pop_to(depth)
            if closes := _CLOSES.get(tag):
                depth, found = len(stack) - 1, 0
                while depth and stack[depth][0] not in _SCOPE:
                    if stack[depth][0] in closes:
                        found = depth
                    depth -= 1
                if found:
                    pop_to(found)
            stack.append((tag, self._under(stack[-1][1], tag, rest)))
            open_[tag] = open_.get(tag, 0) + 1
            links += tag == "a"
        say(source[at:])
        say(tail)
        self._flush()


def features(pages: list[Page]) -> np.ndarray:
    """One row per block, the pages' blocks in order."""
    texts = [t for p in pages for t in p.texts]
    n = len(texts)
    out = np.zeros((n, PATH + WORDS + SHARES), np.float32)
    if not n:
        return out
    data, offs = buffers(pa.array(texts, pa.large_string()))
    start, end = spans(data, offs, _BETWEEN)
    w = np.searchsorted(start, offs)
    n_words = np.diff(w)
    own = np.repeat(np.arange(n), n_words)
    slot = (hash_spans(data, start, end, True) % np.uint64(WORDS)).astype(np.int64)
    bag = np.bincount(own * WORDS + slot, minlength=n * WORDS).reshape(n, WORDS)
    out[:, PATH : PATH + WORDS] = np.minimum(bag / np.sqrt(np.maximum(n_words, 1))[:, None], 1)
    per = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offs]) / np.maximum(np.diff(offs), 1)
    blocks = np.concatenate([np.full(len(p.texts), len(p.texts)) for p in pages])
    place = np.concatenate([np.arange(len(p.texts)) for p in pages])
    links = np.array([x for p in pages for x in p.links])
    shares = (np.log1p(n_words) / 4, n_words == 0, links, place / np.maximum(blocks, 1), np.log1p(blocks) / 6, per((data == 46) | (data == 44)) * 10, per((data >= 48) & (data < 58)) * 5, per((data >= 65) & (data < 91)) * 5, np.isin(data[np.maximum(offs[1:] - 1, 0)], [46, 33, 63]))
    for k, x in enumerate(shares):
        out[:, PATH + WORDS + k] = x
    at = 0
    for p in pages:
        if p.texts:
            out[at : at + len(p.texts), :PATH] = np.stack(p.vectors)[p.paths]
            at += len(p.texts)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(z: np.ndarray, wh: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states (time, pages, HIDDEN) of an LSTM over its projected input, and what the way back needs."""
    steps, batch, _ = z.shape
    h = c = np.zeros((batch, HIDDEN), z.dtype)
    out, kept = np.empty((steps, batch, HIDDEN), z.dtype), []
    for t in range(steps):
        a = z[t] + h @ wh
        gates = _sigmoid(a[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(a[:, 3 * HIDDEN :])
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        kept.append((i, f, o, g, before, tc, h))
        h = o * tc
        out[t] = h
    return out, kept


def _backward(dh_out: np.ndarray, wh: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected input and of the recurrent weights."""
    steps, batch, _ = dh_out.shape
    dz, dwh = np.empty((steps, batch, 4 * HIDDEN), dh_out.dtype), np.zeros_like(wh)
    dh = dc = np.zeros((batch, HIDDEN), dh_out.dtype)
    for t in reversed(range(steps)):
        i, f, o, g, before, tc, h = kept[t]
        dh = dh + dh_out[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz[t] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dwh += h.T @ dz[t]
        dh, dc = dz[t] @ wh.T, dc * f
    return dz, dwh


class Labeller:
    """Bidirectional LSTM with a logistic output for every block."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, seed: int = SEED) -> Labeller:
        rng, size = np.random.Generator(np.random.PCG64(seed)), PATH + WORDS + SHARES
        w = {}
        for way in "fb":
            w[f"x{way}"] = rng.normal(0, 0.08, (size, 4 * HIDDEN))
            w[f"h{way}"] = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN))
            w[f"c{way}"] = np.zeros(4 * HIDDEN)
            w[f"c{way}"][HIDDEN : 2 * HIDDEN] = 1
        w["o"], w["d"], w["s"] = rng.normal(0, 0.2, 2 * HIDDEN), np.zeros(size), np.zeros(1)
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    @staticmethod
    def _places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(block, step, page) of every block, pages one after another; and its step when read backwards."""
        page = np.repeat(np.arange(len(sizes)), sizes)
        step = np.arange(len(page)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes)
        return page, step, sizes[page] - 1 - step

    def _run(self, x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, dict]:
        w, (page, ahead, back) = self.w, self._places(sizes)
        states, held = [], {}
        for way, step in (("f", ahead), ("b", back)):
            z = np.zeros((int(sizes.max()), len(sizes), 4 * HIDDEN), np.float32)
            z[step, page] = x @ w[f"x{way}"] + w[f"c{way}"]
            h, kept = _forward(z, w[f"h{way}"])
            states.append(h[step, page])
            held[way] = (step, kept)
        both = np.concatenate(states, axis=1)
        return both @ w["o"] + x @ w["d"] + w["s"][0], {"page": page, "both": both, "ways": held}

    def label(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether each block is main text; ``sizes`` has the number of blocks of each page."""
        out, edge = np.zeros(len(x), bool), np.concatenate([[0], np.cumsum(sizes)])
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi + 1 - lo) * sizes[order[hi]] <= CELLS:
                hi += 1
            own = order[lo:hi]
            at = np.concatenate([np.arange(edge[k], edge[k + 1]) for k in own])
            out[at] = self._run(x[at], sizes[own])[0] > 0
            lo = hi
        return out

    def gradients(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        logit, held = self._run(x, sizes)
        p = _sigmoid(logit)
        d = ((p - y) / len(y)).astype(np.float32)
        g = {"o": held["both"].T @ d, "d": x.T @ d, "s": d.sum(keepdims=True)}
        back = np.outer(d, self.w["o"])
        for k, way in enumerate("fb"):
            step, kept = held["ways"][way]
            dh = np.zeros((int(sizes.max()), len(sizes), HIDDEN), np.float32)
            dh[step, held["page"]] = back[:, k * HIDDEN : (k + 1) * HIDDEN]
            dz, g[f"h{way}"] = _backward(dh, self.w[f"h{way}"], kept)
            own = dz[step, held["page"]]
            g[f"x{way}"], g[f"c{way}"] = x.T @ own, own.sum(axis=0)
        return float(-np.mean(np.log(np.where(y > 0, p, 1 - p) + 1e-9))), g


def fit(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED, batch: int = 25) -> Labeller:
    """Adam over generated pages; the same seed gives the same weights."""
    rng = random.Random(seed)
    parsed, labels = [], []
    for _ in range(pages):
        p = Page(labelled_page(rng))
        if p.texts:
            labels.append(np.array([_MARK in t for t in p.texts], np.float32))
            p.texts = [t.replace(_MARK, "") or "-" for t in p.texts]
            parsed.append(p)
    x = [features([p]) for p in parsed]
    model, steps = Labeller.fresh(seed), 0
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    total = epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = list(range(len(x)))
        rng.shuffle(order)
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            _, g = model.gradients(np.concatenate([x[k] for k in own]), np.array([len(x[k]) for k in own]), np.concatenate([labels[k] for k in own]))
            steps += 1
            rate = 0.01 * (1 - 0.9 * steps / total)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            for k, v in g.items():
                v = v * min(1.0, 1 / (norm + 1e-9)) + 1e-5 * model.w[k]
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                model.w[k] -= (rate * (first[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.999**steps)) + 1e-8)).astype(np.float32)
    return model


@functools.lru_cache(1)
def labeller() -> Labeller:
    return fit()


# Words and names of page furniture.
_SAID = {
    "nav": "Home|About|About us|Contact|News|Sports|Archive|Products|Services|Blog|Login|Sign in|Sign up|Menu|Search|Help|FAQ|Startseite|Über uns|Kontakt|Accueil|Contacto|Inicio|Shop|Events|Careers|Skip to content".split("|"),
    "head": "Daily News|The Weekly|Welcome to our site|Breaking news|Today|Subscribe now|My account|Log in".split("|"),
    "foot": "© 2024 All rights reserved.|Copyright 2023|Privacy policy|Terms of use|Imprint|Impressum|Datenschutz|Powered by|Follow us|Mentions légales|Aviso legal|Site map|Contact us|Cookie settings".split("|"),
    "side": "Related articles|Most read|Popular posts|Recent posts|You may also like|Trending|Categories|Tags|Read more|More stories|See also|Ähnliche Artikel|À lire aussi|Archives".split("|"),
    "note": "We use cookies to improve your experience.|This site uses cookies.|Accept all|Accept cookies|By continuing you agree to our privacy policy.|Your browser is out of date.|Please enable JavaScript.|Sign up to continue reading.|Subscribe to read more.|Nous utilisons des cookies.|Wir verwenden Cookies.|Usamos cookies.|Notice:|Reject|Manage preferences".split("|"),
    "ad": "Advertisement|Sponsored|Anzeige|Publicité|Buy now|Special offer|Ad|Promoted|Shop now and save 50%|Click here|Limited time only".split("|"),
    "form": "Search|Your name|E-mail address|Submit|Send|Subscribe|Newsletter|Enter your e-mail|Password|Message|Join our mailing list|Sign up for our newsletter".split("|"),
    "talk": "Comments|Leave a comment|Reply|Add a comment|3 comments|says:|Report|Like|Log in to comment|Kommentare|Commentaires|Share|posted on|Great article, thanks!|I disagree|Anonymous".split("|"),
}
_CALLED = {
    "nav": "nav navbar menu navigation main-menu top-menu breadcrumb breadcrumbs site-nav links".split(),
    "head": "header site-header masthead top banner page-header logo topbar branding".split(),
    "foot": "footer site-footer bottom copyright colophon foot legal".split(),
    "side": "sidebar side aside widget related related-posts recommended widget-area right-column left-column popular".split(),
    "note": "cookie-notice cookie-banner notice alert consent gdpr popup modal overlay message paywall warning".split(),
    "ad": "ad ads advert advertisement sponsored promo banner-ad ad-slot adsbox sponsor commercial".split(),
    "form": "form search newsletter signup subscribe contact-form login search-box".split(),
    "talk": "comments comment comment-list discussion responses reader-comments replies disqus feedback".split(),
    "main": "content main article post entry entry-content post-content article-body story text body-content main-content page-content prose".split(),
}
_ELEMENTS = {"nav": "nav div ul", "head": "header div", "foot": "footer div", "side": "aside div section", "note": "div section p aside dialog", "ad": "div aside section p ins", "form": "form div", "talk": "section div ol"}
_SYLLABLES = "an ar ba be bo ca ce co da de di do el en er es fa fi fo ga ge go ha he ho in ing ion is ka la le li lo ma me mo na ne no on or pa pe po ra re ro sa se sh so st ta te th ti to tra un ur va ve vo wa we wi ä é ü ñ ou eau tion keit ung ción ment".split()
_SMALL = "the of and to in a is that for it with as was on be by at from this der die und das nicht le la les et des que de el los en no un une".split()


def _words(rng: random.Random, n: int) -> str:
    out = []
    for k in range(n):
        w = rng.choice(_SMALL) if rng.random() < 0.35 else "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4)))
        if k == 0 or out[-1].endswith("."):
            w = w.capitalize()
        out.append(w + ("," if rng.random() < 0.06 else "." if rng.random() < 0.08 else ""))
    text = " ".join(out)
    roll = rng.random()
    if roll < 0.05:
        return " ".join(w + rng.choice(["###", "***", "%%%", "$$$", "&amp;"]) for w in out)
    if roll < 0.08:
        return " ".join(out[:1] * n)
    if roll < 0.1:
        return " | ".join(out)
    if roll < 0.14:
        return " ".join(rng.choice([w, w, str(rng.randrange(10**rng.randint(1, 12))), f"{w}@example.com", "+1 (555) 010-0199", f"http://{w}.example.org/"]) for w in out)
    return text if roll < 0.4 else text + "." if not text.endswith((".", ",")) else text


def _attributes(rng: random.Random, kind: str, plain: float) -> str:
    if rng.random() < plain:
        return rng.choice(["", "", f' class="c{rng.randrange(999)}"', f' class="{"".join(rng.choice("abcdefghijkmnpqrstuvwxyz") for _ in range(5))}"'])
    name = rng.choice(_CALLED[kind])
    if rng.random() < 0.3:
        name = rng.choice([f"{name}-{rng.choice(['wrapper', 'box', 'block', 'area', 'container', 'inner'])}", f"{name}{rng.randrange(20)}", f"site-{name}"])
    return f' {rng.choice(["class", "class", "id"])}="{name}"'


def _furniture(rng: random.Random, kind: str) -> str:
    """A region that is not main text."""
    element = rng.choice(_ELEMENTS[kind].split())
    telling = element not in ("div", "section", "p", "ul", "ol")
    tag = f"<{element}{_attributes(rng, kind, 0.5 if telling else 0.12)}>"
    said = lambda: rng.choice(_SAID[kind]) if rng.random() < 0.6 else _words(rng, rng.randint(1, 5))
    link = lambda t: f'<a href="/{rng.randrange(9999)}">{t}</a>'
    if kind == "nav" or kind in ("foot", "side", "head") and rng.random() < 0.45:
        item = lambda: f"<li>{link(said() if rng.random() < 0.5 else _words(rng, rng.randint(1, 6)))}</li>"
        items = "".join(item() for _ in range(rng.randint(2, 9)))
        body = items if element in ("ul", "ol") else f"<ul>{items}</ul>" if rng.random() < 0.7 else " | ".join(link(said()) for _ in range(rng.randint(2, 6)))
        if kind == "side" and rng.random() < 0.7:
            body = f"<h3>{said()}</h3>{body}"
        if kind == "foot" and rng.random() < 0.6:
            body += f"<p>{rng.choice(_SAID['foot'])} {_words(rng, rng.randint(2, 15))}</p>"
    elif kind == "form":
        body = "".join(rng.choice([f"<label>{said()}</label><input type='text'>", f"<button>{said()}</button>", f"<p>{said()}</p>", f"<select><option>{said()}<option>{said()}</select>"]) for _ in range(rng.randint(1, 4)))
    elif kind == "talk":
        say = lambda: f"<{rng.choice(['div', 'li', 'article'])}{_attributes(rng, 'talk', 0.3)}><b>{_words(rng, 1)}</b> {rng.choice(_SAID['talk'])}<p>{_words(rng, rng.randint(3, 60))}</p>"
        body = f"<h3>{rng.choice(_SAID['talk'])}</h3>" * (rng.random() < 0.8) + "".join(x + f"</{re.match('<([a-z]+)', x)[1]}>" for x in (say() for _ in range(rng.randint(1, 5))))
    elif kind == "ad":
        body = rng.choice([said(), _words(rng, rng.randint(3, 25)), link(said()), f"<p>{_words(rng, rng.randint(3, 40))}</p>", f"<span>{said()}</span><p>{link(_words(rng, rng.randint(2, 10)))}</p>"])
    elif kind == "side":
        body = f"<h4>{said()}</h4>" * (rng.random() < 0.6) + "".join(f"<p>{_words(rng, rng.randint(3, 30))}</p>" for _ in range(rng.randint(1, 3)))
    elif kind == "foot":
        body = f"{rng.choice(['&copy; ', '', 'Copyright '])}{rng.choice([said(), _words(rng, 1).lower() + '.example.com'])} {rng.choice(['&middot;', '|', '-', ''])} {_words(rng, rng.randint(2, 25))}"
    else:
        body = rng.choice([said(), f"<p>{said()} {_words(rng, rng.randint(0, 12)) if rng.random() < 0.5 else ''}</p>", f"<h1>{said()}</h1>" if kind == "head" else f"{said()} <button>{rng.choice(_SAID['note'])}</button>", f"<span>{said()}</span> {link(said())}", _words(rng, rng.randint(2, 14))])
    return f"{tag}{body}</{element}>"


def _main(rng: random.Random, title: str) -> str:
    """An article, each block of it marked, with furniture strewn in."""
    mark = lambda t: _MARK + t
    parts = [f"<h1>{mark(title)}</h1>"] * (rng.random() < 0.8)
    if parts and rng.random() < 0.2:
        parts = [f"<header>{parts[0]}</header>"]
    if rng.random() < 0.25:
        parts.append(f'<p class="{rng.choice(["byline", "meta", "author", "date", "dateline"])}">{mark("By " + _words(rng, 2))}</p>')
    for _ in range(rng.choice([0, 1, 1, 1, 2, 3, 4, 6, 8, 12, 18])):
        roll, n = rng.random(), rng.choice([1, 2, 5, 10, 20, 40, 80, 150])
        text = mark(_words(rng, n))
        if rng.random() < 0.15:
            text += f' <a href="/x">{_words(rng, rng.randint(1, 6))}</a> {_words(rng, rng.randint(1, 10))}'
        if roll < 0.62:
            parts.append(f"<p>{text}</p>" if rng.random() < 0.75 else f"<p><b>{text}<br>" if rng.random() < 0.5 else f"<p>{text}")
        elif roll < 0.7:
            parts.append(f"<h{(k := rng.randint(2, 4))}>{mark(_words(rng, rng.randint(1, 8)))}</h{k}>")
        elif roll < 0.77:
            parts.append("<ul>" + "".join(f"<li>{mark(_words(rng, rng.randint(1, 20)))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
        elif roll < 0.82:
            parts.append(f"<blockquote>{text}</blockquote>")
        elif roll < 0.86:
            parts.append("<table>" + "".join(f"<tr><td>{mark(_words(rng, 2))}</td><td>{mark(_words(rng, 1))}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
        elif roll < 0.9:
            parts.append(f"<figure><img src='x.png'><figcaption>{text}</figcaption></figure>")
        elif roll < 0.95:
            parts.append(f"<div>{text}</div>")
        else:
            parts.append(f"<pre>{text}</pre>" if rng.random() < 0.5 else f"{text}<br>{mark(_words(rng, 5))}<br>")
        if rng.random() < 0.07:
            parts.append(_furniture(rng, rng.choice(["ad", "side", "form", "note"])))
    inner = "".join(parts)
    element = rng.choice(["article", "article", "main", "div", "section", "div"])
    inner = f"<{element}{_attributes(rng, 'main', 0.7 if element in ('article', 'main') else 0.15)}>{inner}</{element}>"
    if rng.random() < 0.35:
        outer = rng.choice(["main", "div", "section", "div"])
        inner = f"<{outer}{_attributes(rng, 'main', 0.5)}>{inner}</{outer}>"
    return inner


def labelled_page(rng: random.Random) -> str:
    """A page whose main-text blocks hold a mark."""
    title = _words(rng, rng.randint(2, 10))
    some = lambda kind, p: [_furniture(rng, kind)] if rng.random() < p else []
    if rng.random() < 0.05:
        before, after, body = [], [], "".join(f"<p>{_MARK}{_words(rng, rng.choice([3, 10, 40]))}</p>" for _ in range(rng.randint(1, 5)))
    else:
        before = some("note", 0.25) + some("head", 0.5) + some("nav", 0.75) + some("form", 0.15) + some("ad", 0.4) + some("side", 0.15) + some("nav", 0.1)
        after = some("ad", 0.25) + some("talk", 0.35) + some("side", 0.4) + some("form", 0.25) + some("ad", 0.15) + some("foot", 0.85) + some("note", 0.25)
        body = _main(rng, title)
    if rng.random() < 0.2:
        rng.shuffle(after)
    if rng.random() < 0.2:
        before = ["<!-- ad -->" * (rng.random() < 0.5), *before]
    wrap = rng.choice(["", "", f'<div id="{rng.choice(["page", "wrapper", "container", "root", "app", "content"])}">'])
    return f'<!DOCTYPE html><html lang="{rng.choice(["en", "de", "fr", "es"])}"><head><title>{title}</title><script>var x=1;</script></head><body>{wrap}{"".join(before)}{body}{"".join(after)}{"</div>" if wrap else ""}</body></html>'


def main_texts(model: Labeller, sources: list[str | None]) -> list[str]:
    pages = [Page(s or "") for s in sources]
    keep = model.label(features(pages), np.array([len(p.texts) for p in pages], np.int64)) if pages else np.zeros(0, bool)
    out, at = [], 0
    for p in pages:
        own = keep[at : at + len(p.texts)].tolist()
        out.append("\n".join(t for t, k in zip(p.texts, own) if k))
        at += len(p.texts)
    return out


def _extract(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labeller(held.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, 128):
                batch = whole.slice(lo, 128)
                texts = main_texts(model, batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """Main text of every page and its length in code points."""
    held = pages.sparkSession.sparkContext.broadcast((model or labeller()).w)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_extract(held), _TEXT)
