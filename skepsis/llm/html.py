"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into blocks: runs of text between block-level tags.  Each block is described by its ancestors' tags and
class, id and role words and by its text (length, share of links, punctuation), and labelled main or not by Viterbi
decoding over the page.  The model is trained here on labelled pages: layouts put together from site parts (articles,
menus, sidebars, notices, adverts, forms, comments, ...) around real texts, and a bounded sample of the corpus' own pages
whose mark-up names an article, labelled by it.
"""
from __future__ import annotations

import html as entities
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import extend, hash_sample

SAMPLE_PAGES = 200
SAMPLE_CHARS = 32_000
LAYOUTS = 1200
FEATURE_BITS = 15
EPOCHS = 6

# HTML's elements without content, of raw text, and of block level; those that end an open paragraph are the last.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe noembed noframes xmp textarea select title".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul""".split())
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)""", re.S)
_ATTRIBUTE = re.compile(r""">|=\s*(["'])""")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|itemprop|aria-label|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[a-z]+")
MOST_DEEP = 128


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def _names(attributes: str) -> tuple[str, ...]:
    """Words of class, id, role and the like."""
    if "=" not in attributes and "hidden" not in attributes.lower():
        return ()
    out = []
    for name, value in _NAMES.findall(attributes):
        out += ["hidden"] if name.lower() == "hidden" else _PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
    return tuple(dict.fromkeys(out))


def _tag_end(page: str, at: int) -> tuple[int, int]:
    """(end of the attributes that start at `at`, start of what follows the tag).

    A quote opens a value after an equals sign only; one that nothing closes is part of a name.  A tag that doesn't end takes the rest of the page.
    """
    while m := _ATTRIBUTE.search(page, at):
        if not m[1]:
            return m.start(), m.end()
        stop = page.find(m[1], m.end())
        at = stop + 1 if stop >= 0 else m.end()
    return len(page), len(page)


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order: character references decoded, white space folded to one blank and trimmed.

    Comments, declarations and the content of scripts, styles and other raw elements belong to no block; text inside formulas, drawings
    and embedded objects is text like any other.  A head has no end of its own: what else stands in it is read as part of the page.  Unclosed
    tags end where HTML ends them; an end tag without a start is ignored; a null or empty page has no block.  Elements nested
    deeper than `MOST_DEEP` are read as siblings at that depth, their text stays.
    """
    out, stack, held, linked, link_depth, at, n = [], [], [], 0, 0, 0, len(page or "")

    def flush():
        nonlocal linked
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append(Block(tuple(x for x in stack if x[0] in BLOCK or x[1]), text, min(linked, len(text))))
            held.clear()
            linked = 0

    def close(names, stop=frozenset()):
        """Pop up to and with the nearest of `names`, unless one of `stop` stands before it."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in stop:
                return
    while at < n:
        m = _TOKEN.search(page, at)
        text = page[at:m.start() if m else n]
        if text:
            held.append(text)
            if link_depth:
                linked += len(text.strip())
        if not m:
            break
        at, name = m.end(), m[2]
        if not name:
            continue
        name, start = name.lower(), at
        stop, at = _tag_end(page, at)
        attributes = page[start:stop]
        closed = attributes.rstrip().endswith("/")
        block = name in BLOCK
        if block:
            flush()
        elif name == "br":
            held.append(" ")
        if m[1]:
            if name == "a":
                link_depth = 0
            close((name,), BLOCK - {name} if not block else frozenset())
            continue
        if name in RAW and not closed:
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else n
            if name not in ("script", "style", "title", "template"):
                held.append(" ")
            continue
        if name == "head":
            continue
        if block:
            close(("p",), frozenset(("td", "th", "li", "button", "body", "article", "div", "section")))
            if name in CLOSES:
                close(*CLOSES[name])
        if name == "a":
            link_depth = 1
        if name not in VOID and not closed:
            del stack[MOST_DEEP - 1:]
            stack.append((name, _names(attributes)))
    flush()
    return out


# -- features ----------------------------------------------------------------------------------------------------------------

_HASHED: dict[str, int] = {}


def _slot(name: str) -> int:
    s = _HASHED.get(name)
    if s is None:
        s = zlib.crc32(name.encode()) >> (32 - FEATURE_BITS)
        if len(_HASHED) < 200_000:
            _HASHED[name] = s
    return s


def _path_features(path: tuple) -> list[int]:
    tags = [t for t, _ in path if t not in ("html", "body")]
    f = ["t=" + t for t in set(tags)] + ["w=" + w for _, ws in path for w in ws]
    f += ["p=" + "/".join(tags[-2:]), "p1=" + (tags[-1] if tags else "-"), "top=" + (tags[0] if tags else "-")]
    if "header" in tags or "footer" in tags:
        f.append("%s in article=%s" % ("header" if "header" in tags else "footer", "article" in tags or "main" in tags))
    for scope in ("article", "main"):
        if scope in tags:
            inner = path[next(i for i, x in enumerate(path) if x[0] == scope) + 1:]
            f += [scope + ">" + t for t, _ in inner] + [scope + ">w=" + w for _, ws in inner for w in ws] + [scope + ">>" + (tags[-1])]
    return [_slot(x) for x in dict.fromkeys(f)]


def features(page: list[Block]) -> list[list[int]]:
    """Hashed features of every block."""
    out, known, seen_title = [], {}, False
    for b in page:
        f = known.get(b.path)
        if f is None:
            f = known[b.path] = _path_features(b.path)
        n, words = len(b.text), b.text.count(" ") + 1
        tag = b.path[-1][0] if b.path else "-"
        seen_title |= tag == "h1"
        own = ["bias", "n=%d" % min(9, n.bit_length()), "link=%d" % (4 * b.linked // n), "end=%s" % (b.text[-1] in ".!?…\"”"), "words=%d" % min(6, words.bit_length()),
               "c=%s" % (b.text[0] in "©|»›•"), "after h1=%s" % seen_title]
        out.append(f + [_slot(x) for x in own])
    return out


# -- the chain ----------------------------------------------------------------------------------------------------------------

class Model:
    """Weights of both labels' features and of label pairs."""

    def __init__(self):
        self.w = np.zeros((2, 1 << FEATURE_BITS), np.float32)
        self.pair = np.zeros((2, 2))
        self.first = np.zeros(2)

    def scores(self, fs: list[list[int]]) -> np.ndarray:
        n = [len(f) for f in fs]
        flat = np.concatenate([np.asarray(f, np.int64) for f in fs])
        return np.add.reduceat(self.w[:, flat], np.cumsum(n) - n, axis=1).T.astype(float)

    def decode(self, fs: list[list[int]]) -> list[int]:
        """The labels of highest score (Viterbi); ties go to 0."""
        if not fs:
            return []
        s, (a, b), (c, d) = self.scores(fs).tolist(), self.pair[0].tolist(), self.pair[1].tolist()
        x, y, back = s[0][0] + self.first[0], s[0][1] + self.first[1], []
        for p, q in s[1:]:
            from0, from1 = x + b > y + d, x + a >= y + c
            back.append((0 if from1 else 1, 0 if from0 else 1))
            x, y = (x + a if from1 else y + c) + p, (x + b if from0 else y + d) + q
        k = 1 if y > x else 0
        out = [k]
        for step in reversed(back):
            k = step[k]
            out.append(k)
        return out[::-1]

    def gradient(self, fs, labels):
        """Expected minus observed: label shares per block, label pairs and first label (forward-backward)."""
        s = self.scores(fs)
        n = len(s)
        f, g = np.zeros((n, 2)), np.zeros((n, 2))
        f[0] = s[0] + self.first
        for i in range(1, n):
            f[i] = np.logaddexp(f[i - 1, 0] + self.pair[0], f[i - 1, 1] + self.pair[1]) + s[i]
        for i in range(n - 2, -1, -1):
            x = self.pair + (s[i + 1] + g[i + 1])
            g[i] = np.logaddexp(x[:, 0], x[:, 1])
        z = np.logaddexp(*f[-1])
        share = np.exp(f + g - z)
        pairs = np.zeros((2, 2))
        if n > 1:
            pairs = np.exp(f[:-1, :, None] + self.pair + (s[1:] + g[1:])[:, None, :] - z).sum(0)
            np.add.at(pairs, (labels[:-1], labels[1:]), -1)
        share[np.arange(n), labels] -= 1
        return share, pairs


def train(pages: list[tuple[list[list[int]], np.ndarray]], epochs: int = EPOCHS, rate: float = 0.3, seed: int = 5) -> Model:
    """Maximum likelihood by AdaGrad, one page at a time."""
    m, rng = Model(), np.random.default_rng(seed)
    pages = [p for p in pages if p[0]]
    g_w, g_pair, g_first = np.full(m.w.shape, 1e-2, np.float32), np.full((2, 2), 1e-2), np.full(2, 1e-2)
    for _ in range(epochs):
        for i in rng.permutation(len(pages)):
            fs, y = pages[i]
            share, pairs = m.gradient(fs, y)
            flat = np.concatenate([np.asarray(f, np.int64) for f in fs])
            at, where = np.unique(flat, return_inverse=True)
            d = np.zeros((2, len(at)))
            rows = np.repeat(np.arange(len(fs)), [len(f) for f in fs])
            for k in (0, 1):
                d[k] = np.bincount(where, share[rows, k], minlength=len(at))
            g_w[:, at] += d ** 2
            m.w[:, at] -= rate * d / np.sqrt(g_w[:, at])
            g_pair += pairs ** 2
            m.pair -= rate * pairs / np.sqrt(g_pair)
            g_first += share[0] ** 2
            m.first -= rate * share[0] / np.sqrt(g_first)
    return m


# -- labelled pages ------------------------------------------------------------------------------------------------------------

# Words by which sites mark their parts; the layouts draw from them.
MAIN_NAMES = "article content post entry story main body text articlebody page single prose markdown".split()
PARTS = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs pagination pager toc topbar links categories tags skip".split(),
    "header": "header masthead logo site brand branding banner top hero tagline".split(),
    "footer": "footer copyright legal colophon bottom imprint disclaimer".split(),
    "sidebar": "sidebar aside widget related recommended popular trending more rail secondary complementary teaser promo".split(),
    "notice": "notice cookie cookies consent gdpr alert banner popup modal overlay message toast paywall subscribe dialog hidden".split(),
    "ad": "ad ads advert advertisement advertising sponsored sponsor promo promoted banner adsbygoogle adbox commercial".split(),
    "form": "form search newsletter login signup register subscribe contact input field".split(),
    "comments": "comment comments reply replies discussion disqus respond responses commentlist reader thread".split(),
    "share": "share social sharing follow buttons tools".split(),
}
TAGS = {"menu": ["nav", "nav", "ul", "div"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"], "sidebar": ["aside", "aside", "div", "section"],
        "notice": ["div", "div", "section", "dialog"], "ad": ["div", "div", "aside", "section", "p"], "form": ["form", "form", "form", "div"],
        "comments": ["section", "div", "ol", "div"], "share": ["div", "ul", "div"]}


def layout(rng: np.random.Generator, texts: list[str]) -> tuple[str, str]:
    """A labelled page: (html, one digit per block)."""
    out, labels = [], []
    pick = lambda xs: xs[int(rng.integers(len(xs)))]

    def words(a, b):
        w = pick(texts).split()
        i = int(rng.integers(max(1, len(w) - b)))
        return entities.escape(" ".join(w[i:i + int(rng.integers(a, b + 1))]), quote=False) or "text"

    def leaf(tag, text, main):
        out.append(f"<{tag}>{text}</{tag}>")
        labels.append("1" if main else "0")

    def opening(tag, name):
        form = rng.random()
        if not name or form < 0.12:
            return f"<{tag}>"
        extra = pick(["", "", "-box", "-wrapper", "-inner", "-1", "-section", " block", "s", "-area", "-list", "-container", "-text"])
        return f"<{tag} {'id' if form < 0.3 else 'class'}=\"{name}{extra}\">"

    def part(kind, inside=False):
        tag = pick(TAGS[kind])
        semantic = tag in ("nav", "header", "footer", "aside", "form", "dialog")
        start = opening(tag, pick(PARTS[kind]))
        if not semantic and start == f"<{tag}>":            # a part must be told by its tag or its name
            start = f"<{tag} class=\"{pick(PARTS[kind])}\">"
        out.append(start)
        if tag == "p":
            out.append(words(3, 25))
            labels.append("0")
        elif tag in ("ul", "ol"):
            for _ in range(int(rng.integers(2, 6))):
                leaf("li", f'<a href="#">{words(1, 4)}</a>' if kind != "comments" else words(5, 40), False)
        elif kind in ("menu", "share"):
            out.append("<ul>")
            for _ in range(int(rng.integers(2, 7))):
                leaf("li", f'<a href="#">{words(1, 4)}</a>', False)
            out.append("</ul>")
        elif kind == "form":
            leaf(pick(["p", "div", "h3"]), words(2, 20), False)
            out.append("<input name=q>")
            leaf("div", f"<button>{words(1, 3)}</button>", False)
        elif kind == "comments":
            leaf(pick(["h2", "h3", "p"]), words(1, 4), False)
            for _ in range(int(rng.integers(1, 5))):
                inner = pick(["div", "li", "article", "p"])
                if inner == "p":
                    leaf("p", words(4, 60), False)
                else:
                    out.append(f'<{inner} class="{pick(PARTS["comments"])}">')
                    leaf("p", words(4, 60), False)
                    if rng.random() < 0.5:
                        leaf(pick(["p", "div"]), words(1, 12), False)
                    out.append(f"</{inner}>")
        else:
            for _ in range(int(rng.integers(1, 4))):
                leaf(pick(["p", "div", "h3", "p"]), words(2, pick([8, 40, 60])) if rng.random() < 0.7 else f'<a href="#">{words(2, 9)}</a>', False)
            if rng.random() < 0.25:
                out.append(words(2, 12))
                labels.append("0")
        out.append(f"</{tag}>")

    def article():
        two = pick(MAIN_NAMES) + pick(["", "", "-" + pick(MAIN_NAMES), " " + pick(MAIN_NAMES), "_" + pick(MAIN_NAMES)])
        tag, name = pick([("article", ""), ("article", two), ("main", ""), ("main", two), ("div", two), ("div", two), ("div", two), ("section", two)])
        out.append(opening(tag, name) if tag in ("article", "main") else f'<{tag} {pick(["class", "id"])}="{name}">')
        nested = rng.random() < 0.35
        if nested:
            out.append(opening("div", pick(MAIN_NAMES)))
        if rng.random() < 0.9:
            head = rng.random() < 0.2
            out.append("<header>" if head else "")
            leaf(pick(["h1", "h1", "h1", "h2"]), words(1, 14), True)
            out.append("</header>" if head else "")
        for _ in range(int(rng.integers(1, 10))):
            r = rng.random()
            if r < 0.7:
                leaf("p", f"<b>{words(1, 5)}</b> {words(5, 120)}" if rng.random() < 0.2 else f'{words(3, 60)} <a href="#">{words(1, 4)}</a> {words(2, 30)}' if rng.random() < 0.25 else words(3, 120), True)
            elif r < 0.8:
                leaf(pick(["h2", "h3"]), words(1, 9), True)
            elif r < 0.88:
                kind = pick(["ul", "ol"])
                out.append(f"<{kind}>")
                for _ in range(int(rng.integers(2, 5))):
                    leaf("li", words(2, 25), True)
                out.append(f"</{kind}>")
            elif r < 0.93:
                out.append("<blockquote>")
                leaf("p", words(5, 50), True)
                out.append("</blockquote>")
            elif r < 0.95:
                out.append("<table><tr>")
                leaf("td", words(1, 6), True)
                leaf("td", words(1, 6), True)
                out.append("</tr></table>")
            elif r < 0.96:
                leaf("pre", words(3, 30), True)
            else:                                   # text without an element of its own
                out.append("<hr>" + words(2, 60) + "<hr>")
                labels.append("1")
            if rng.random() < 0.1:
                part(pick(["ad", "sidebar", "share", "form", "notice"]), True)
        if rng.random() < 0.3:
            part(pick(["comments", "share", "sidebar", "comments"]), True)
        if rng.random() < 0.15:
            out.append("<footer>")
            leaf("p", words(2, 15), False)
            out.append("</footer>")
        out.append("</div>" if nested else "")
        out.append(f"</{tag}>")

    wrap = rng.random() < 0.5
    for kind, share in (("notice", 0.3), ("header", 0.7), ("menu", 0.7), ("form", 0.2), ("ad", 0.4)):
        if rng.random() < share:
            part(kind)
    if wrap:
        out.append(opening("div", pick(["container", "wrapper", "page", "site", "layout", "row", "grid"])))
    for kind in ("sidebar", "menu"):
        if rng.random() < 0.3:
            part(kind)
    article()
    for kind, share in (("ad", 0.3), ("sidebar", 0.4), ("comments", 0.4), ("form", 0.25), ("share", 0.2)):
        if rng.random() < share:
            part(kind)
    out.append("</div>" if wrap else "")
    for kind, share in (("footer", 0.8), ("notice", 0.2)):
        if rng.random() < share:
            part(kind)
    return "<html><body>" + "".join(out) + "</body></html>", "".join(labels)


def fit(pages: list[str], layouts: int = LAYOUTS, seed: int = 7) -> Model:
    """Train on layouts filled with the pages' texts and on those pages with one article element, labelled by it."""
    rng, held = np.random.default_rng(seed), [blocks(p) for p in pages]
    texts = [b.text for p in held for b in p if len(b.text) > 60] or ["Some words of a plain text that stands for the text of a page, as there is none to draw from."]
    data = []
    for p in held:
        if sum(1 for x, y in zip([None, *p], p) if "article" in [t for t, _ in y.path] and not (x and "article" in [t for t, _ in x.path])) == 1:
            y = [int("article" in (tags := [t for t, _ in b.path]) and not {"aside", "nav", "footer", "form"} & set(tags)) for b in p]
            data.append((features(p), np.array(y)))
    for _ in range(layouts):
        page, labels = layout(rng, texts)
        b = blocks(page)
        if len(b) == len(labels):
            data.append((features(b), np.array([int(c) for c in labels])))
    return train(data)


def sample(pages: DataFrame, most: int = SAMPLE_PAGES, most_chars: int = SAMPLE_CHARS) -> list[str]:
    """At most `most` pages of up to `most_chars` characters, drawn by hash."""
    rows = hash_sample(pages.select("page_id", "html").filter(F.length("html") <= most_chars), most, "page_id", "html").collect()
    return list(dict.fromkeys(r["html"] for r in rows))


ADDED = StructType([StructField("text", StringType())])


def extract(pages: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """`text`: the main blocks of every whole page in page order, joined by line breaks, beside the columns `carry` (all, if not given).

    A null, empty or textless page gives an empty text; repeated rows are all extracted; a column named `text` gives way.
    """
    def add(held):
        out = []
        for page in held:
            b = blocks(page)
            out.append("\n".join(x.text for x, k in zip(b, model.decode(features(b))) if k) if b else "")
        return [out]
    return extend(pages, pages.columns if carry is None else carry, "html", add, ADDED)
