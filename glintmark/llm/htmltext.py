"""Main text of HTML pages by tag-path ratios.

A page becomes blocks of text in page order, each with its root-to-leaf path of block tags. Per path the characters,
punctuation marks and linked characters are summed and divided by the path's blocks. Both ratios are smoothed along the
page with a Gaussian window, fused (geometric mean of length and of one plus punctuation) and averaged again per path,
less the path's share of linked text. Paths that reach a share of the page's spread are content: all their blocks are
kept, so a short paragraph of an article stays. Blocks of an article, main or labelled element take the best score of its
paths, less their own path's link share (half of it within an article or main element where blocks of the path have punctuation), so short lists, references, tables and code of a kept article stay too.

What tags and names say is a factor on top, never a verdict: as the threshold is relative, a factor that holds for the
whole page (a wrapper called `has-sidebar`, one form around everything) changes nothing. An article or main element counts
INSIDE, an element labelled as main LABELLED, one labelled as boilerplate (`comments`, `ad`, ...) DOUBT; an article or main
inside such a wrapper starts anew from the wrapper's factor. HTML's own elements for what isn't the article (nav, footer, aside,
header outside of an article, ...) count ASIDE, and so do the places beside a form's controls; places for reader comments (by a whole name, so a wrapper called
`has-comments` isn't one) count REMARKS. The rest of a form counts ASIDE, too, unless it is most of the page's text: then the form is a wrapper. A page whose best path stays below LEAST has no main text.

Everything is linear in the page's size and depth. White space is what str.split takes for it, so U+00A0 and U+001C to U+001F
become single spaces, too. Null or empty html gives an empty text. Broken markup is read as browsers do: unclosed paragraphs and
items end where the next begins (only elements of BLOCKS end a paragraph; those within skipped ones, such as drawings and players, change nothing), an unclosed comment, script or tag runs to the end. Rows that repeat are kept as rows.
Further columns are kept; html goes, and a column with the text's name is replaced.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Elements whose content is never text of the page.
SKIPPED = frozenset("script style noscript template iframe object svg math canvas audio video select textarea button title head".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements that are blocks of their own and end an open paragraph; all others, unknown ones too, are within a line.
BLOCKS = frozenset(
    "html body address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li listing main menu "
    "nav ol optgroup option p plaintext pre search section summary table caption colgroup tbody td tfoot th thead tr ul xmp".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a start tag ends: open elements of these names, not beyond the bounds.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
BOILERPLATE_TAGS = frozenset("nav footer aside dialog menu address".split())
MAIN_TAGS = frozenset(("article", "main"))
#: What makes a form a form.
CONTROLS = frozenset("input select textarea button".split())
FORMS = frozenset(("form", "fieldset"))
#: Words of class, id and role attributes.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer "
    "form gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup promo promoted promotion "
    "recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription tags toc toolbar "
    "widget widgets alert".split()
)
#: A whole name of a class, id or role by which a place for reader comments goes.
COMMENTS = re.compile(r"comments?([-_]?(\d+|list|section|area|thread|wrap|wrapper|container|body|text|content|form|block|box|item))?|(post|article|user|reader)[-_]?comments?|commentlist|disqus(_thread)?|responses?|repl(y|ies)|respond|discussion")
MAIN = frozenset("article articlebody body content entry main post story text".split())
#: Factors of the module's text.
INSIDE, LABELLED, DOUBT, REMARKS, ASIDE = 2.0, 1.5, 0.2, 0.01, 1e-6
#: How much of a link share counts against a block of a kept article that nothing speaks against, a list of references for one.
LINKS_INSIDE = 0.5
#: Gaussian width in blocks; share of the spread (mean and deviation of the paths' scores) that content reaches; least best score.
WIDTH, SHARE, LEAST = 1.0, 0.35, 1e-3
PUNCTUATION = re.compile(r"[.,;:!?。，、；：！？…]")

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
LABELS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"\btype\s*=\s*[\"']?hidden\b", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Element:
    """An open element: its path's number, its factor, the innermost form and the main elements around it."""

    __slots__ = ("name", "path", "controls", "factor", "form", "contents", "doubted", "main", "article", "block")

    def __init__(self, name: str, path: int, up: Element | None) -> None:
        self.name, self.path, self.controls, self.block = name, path, 0, self
        self.factor, self.form, self.contents, self.doubted, self.main, self.article = (up.factor, up.form, up.contents, up.doubted, up.main, up.article) if up else (1.0, None, None, 0, False, False)


class Form:
    __slots__ = ("chars",)

    def __init__(self) -> None:
        self.chars = 0


class Content:
    """A main element that may be inside another; best is the best score of the paths in it."""

    __slots__ = ("up", "best")

    def __init__(self, up: Content | None) -> None:
        self.up, self.best = up, 0.0


class Block:
    __slots__ = ("path", "parts", "text", "linked", "parent", "factor")

    def __init__(self, parent: Element) -> None:
        self.path, self.parts, self.text, self.linked, self.parent, self.factor = parent.path, [], "", 0, parent, parent.factor


def _open(attributes: str) -> tuple[str, frozenset[str], bool]:
    """The words of class, id and role: as they go into a path, and as a set; whether a name says that reader comments are here."""
    names = [x for m in LABELS.finditer(attributes) for x in m.groups()[1:] if x]
    words = frozenset(w.lower() for x in names for w in WORD.findall(x))
    return "".join(sorted({f".{w}" for w in words})), words, any(COMMENTS.fullmatch(t) for x in names for t in x.lower().split())


def _judge(x: Element, words: frozenset[str], comments: bool) -> None:
    """What the element's tag and names say."""
    name = x.name
    doubtful = bool(words & BOILERPLATE) and name not in ("html", "body")
    if name in FORMS:
        x.form, doubtful = Form(), bool(words & BOILERPLATE - {"form"})
    if name in BOILERPLATE_TAGS and not (name == "address" and x.main) or (name == "header" and not x.article):
        x.factor, x.contents, x.doubted = ASIDE, None, 2
    elif comments and name not in ("html", "body"):
        x.factor, x.contents, x.doubted = x.factor * (1.0 if x.doubted >= 2 else REMARKS), None, 2
    elif name in MAIN_TAGS and not doubtful:
        anew = not (x.article or x.main and name == "main")
        if anew:
            x.factor *= 1.0 if x.main else INSIDE
            x.doubted, x.form = 0, None
        x.main, x.article = True, x.article or name == "article"
        if anew or not x.doubted:
            x.contents = Content(x.contents)
    elif doubtful:
        x.factor *= DOUBT if x.doubted < 2 else 1.0  # once for a wrapper, once for what is in it
        x.contents, x.doubted = None, x.doubted + 1
    elif words & MAIN and name not in ("html", "body") and not x.contents:
        x.factor *= LABELLED
        x.contents = Content(None)


def blocks(page: str) -> list[Block]:
    """Text blocks in page order; those inside skipped elements are left out, and so are blank ones."""
    out: list[Block] = []
    top = Element("", 0, None)
    stack: list[Element] = [top]
    open_at: dict[str, list[int]] = {}  # by name, the places in the stack of open elements
    paths: dict[tuple[int, str], int] = {}
    skipped = links = 0
    block: Block | None = None
    at, n = 0, len(page)

    def close(x: Element) -> None:
        nonlocal skipped, links
        open_at[x.name].pop()
        skipped -= x.name in SKIPPED
        links -= x.name == "a"

    def pop(k: int) -> None:
        while len(stack) > k:
            x = stack.pop()
            if x.name:
                close(x)

    def last(names) -> int:
        return max((open_at[x][-1] for x in names if open_at.get(x)), default=0)

    def add(text: str) -> None:
        nonlocal block
        if skipped or not text:
            return
        if block is None:
            if not text.strip():
                return
            block = Block(stack[-1].block)
            out.append(block)
        text = entities.unescape(text)
        block.parts.append(text)
        if links:
            block.linked += len(text.strip())

    while at < n:
        m = TAG.search(page, at)
        add(page[at : m.start() if m else n])
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name or (m[5] and not page.endswith(">", 0, at)):
            continue
        if name == "br":
            add(" ")
            continue
        if m[1] or m[4]:
            k = last((name,))
            within = skipped > 0
            if k and name not in BLOCKS and name not in SKIPPED and stack[-1].block is not stack[k].block:  # such an end tag doesn't close blocks
                close(stack[k])
                stack[k].name = ""
            else:
                if k:
                    pop(k)
                if name in BLOCKS and not (within and skipped):
                    block = None
            continue
        attributes = m[3] if m[2] else m[6]
        if name in BLOCKS and (k := last(("head",))):
            pop(k)
        if name in CONTROLS and not HIDDEN.search(attributes) or name == "label":
            stack[-1].block.controls += 1
        own = name in BLOCKS and not skipped  # what is within a skipped element changes nothing outside
        if own:
            block = None
            if k := last(("p",)):
                pop(k)
            closes, bounds = ENDS.get(name, ((), ()))
            if closes and (k := last(closes)) > last(bounds):
                pop(k)
        if name in VOID or attributes.endswith("/") and name in ("svg", "math", "path"):
            continue
        up = stack[-1]
        if own:
            label, words, comments = _open(attributes) if attributes else ("", frozenset(), False)
            x = Element(name, paths.setdefault((up.path, name + label), len(paths) + 1), up)
            _judge(x, words, comments)
        else:
            x = Element(name, up.path, up)
            x.block = up.block
        open_at.setdefault(name, []).append(len(stack))
        stack.append(x)
        skipped += name in SKIPPED
        links += name == "a"
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            pop(len(stack) - 1)
            at = end.end() if end else n
    whole = 0
    for b in out:
        b.text = " ".join("".join(b.parts).split())
        form = b.parent.form
        if form and b.parent.controls:
            b.factor *= ASIDE
        elif b.factor > ASIDE:
            whole += len(b.text)
            if form:
                form.chars += len(b.text)
    for b in out:
        form = b.parent.form
        if form and not b.parent.controls and 2 * form.chars <= whole:
            b.factor *= ASIDE
    return [b for b in out if b.text]


def _smooth(values: list[float]) -> list[float]:
    reach = max(1, math.ceil(2 * WIDTH))
    kernel = [math.exp(-0.5 * (k / WIDTH) ** 2) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        part = [(kernel[k + reach], values[i + k]) for k in range(-reach, reach + 1) if 0 <= i + k < len(values)]
        out.append(sum(w * v for w, v in part) / sum(w for w, _ in part))
    return out


def chosen(found: list[Block]) -> list[Block]:
    """The blocks of content paths."""
    sums: dict[int, list[float]] = {}
    for b in found:
        x = sums.setdefault(b.path, [0, 0, 0, 0])
        for k, v in enumerate((1, len(b.text), len(PUNCTUATION.findall(b.text)), min(b.linked, len(b.text)))):
            x[k] += v
    plain = {path: 1 - linked / chars for path, (_, chars, _, linked) in sums.items()}
    length = _smooth([sums[b.path][1] / sums[b.path][0] for b in found])
    marks = _smooth([sums[b.path][2] / sums[b.path][0] for b in found])
    fused: dict[int, list[float]] = {}
    for b, a, p in zip(found, length, marks):
        fused.setdefault(b.path, []).append(math.sqrt(a * (1 + p)) * b.factor * plain[b.path])
    score = {path: sum(x) / len(x) for path, x in fused.items()}
    if not score or max(score.values()) < LEAST:
        return []
    mean = sum(score.values()) / len(score)
    least = SHARE * (mean + math.sqrt(sum((x - mean) ** 2 for x in score.values()) / len(score)))
    for b in found:
        if b.parent.contents and b.factor == b.parent.factor:
            b.parent.contents.best = max(b.parent.contents.best, score[b.path])
    # An element's best counts for those inside it, too: outer ones come first in the page.
    seen = set()
    for b in found:
        own, x = [], b.parent.contents
        while x and id(x) not in seen:
            own.append(x)
            seen.add(id(x))
            x = x.up
        for x in reversed(own):
            x.best = max(x.best, x.up.best if x.up else 0.0)

    def reaches(b: Block) -> bool:
        listed = b.parent.main and not b.parent.doubted and sums[b.path][2] >= sums[b.path][0]
        held = plain[b.path] if not listed else 1 - LINKS_INSIDE * (1 - plain[b.path])
        given = b.parent.contents.best * held if b.parent.contents and b.factor == b.parent.factor else 0.0
        return max(score[b.path], given) >= max(least, 1e-9)

    return [b for b in found if reaches(b)]


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in chosen(blocks(page or "")))


def extract(pages: DataFrame, html_col: str = "html", name: str = "text") -> DataFrame:
    """pages without html_col and with the main text in one more column."""

    def found(pages: pa.Array) -> list[pa.Array]:
        return [pa.array([main_text(x) for x in pages.to_pylist()], pa.string())]

    return shared.with_columns(pages, html_col, f"{name} string", found, 16 << 20, drop=[html_col])


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract(shared.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.withColumn("n_chars", F.char_length("text").cast("long"))
