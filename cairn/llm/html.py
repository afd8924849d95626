"""Main text of HTML pages by two-pass block rules (operator 6)."""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^"'<>]|"[^"]*"|'[^']*')*)>""", re.S)
_HINTS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW = frozenset("script style noscript template iframe object svg math textarea select canvas audio video title head noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
_OUTER = frozenset("nav footer aside form menu dialog fieldset button label search".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_BOX = frozenset("article main".split())
_CLOSES_P = _BLOCK - {"li", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "body", "html", "legend", "summary"} | {"p"}
_NAME = re.compile(
    r"(?:(?:js|site|page|top|bottom|left|right|global|primary|secondary|user|reader|post|article|blog|main|web|the|cookie|gdpr|google|banner|social|email|news)[-_]*)*"
    r"(?:ads?|adv|advert\w*|adsense|adbox|adslot|ad-?(?:banner|unit|container|slot|wrapper)|banner|promo\w*|sponsor\w*|menu\w*|nav|navbar|navigation|breadcrumbs?|crumbs|sidebar\w*|side-?bar|rail|footer\w*|header|masthead|cookies?|notices?|alert|consent|gdpr|privacy|disclaimer|newsletter|subscri\w+|signup|sign-up|popup|pop-up|modal|overlay|toast|comments?|comment-?list|commentlist|replies|reply|respond|responses|disqus\w*|discussion|related\w*|recommend\w*|more-?(?:links|stories)|share|sharing|social|widgets?|copyright|legal|toolbar|pag(?:ination|er|ing)|login|search|searchbox|tags?|taglist|skip-?link|contentinfo|complementary|noprint|hidden|tracking)"
    r"(?:[-_]*(?:list|box|bar|area|block|section|container|wrapper|inner|top|bottom|left|right|main|primary|form|item|items|links?|banner|text|body|content|\d+))*",
    re.I,
)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w+")
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
STOP_WORDS = frozenset(
    """the of and to in a is that for it as was with be by on not he i this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no she about up out them some its than then into only other
    le la les de des du un une et est en que qui dans pour pas sur au aux par il elle ce cette ces son sa ses ne se ou mais avec plus sont comme nous vous leur
    der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein
    el los las del y que en un una es se no por con para su al lo como más o pero sus le ya este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante
    il lo gli dei delle che di è per non con una sono della nel alla ma ha si come più anche o da os as um uma não do da dos em ao mais foi het een van ik te dat die niet zijn op aan met""".split()
)
SHORT, MEDIUM, STOP_HIGH, STOP_LOW, LINKS, MENU = 10, 25, 0.10, 0.05, 0.4, 3


@dataclass
class Block:
    text: str
    words: int
    linked: int
    heading: bool
    outer: bool
    box: int  # number of the article or main element it lies in, 0 for none


def _hinted(tag: str, attrs: str, inside: bool) -> bool:
    """Whether an element is named as something beside the article."""
    if tag in _OUTER:
        return True
    if tag == "header":
        return not inside
    if tag in ("html", "body", "main", "article") or tag in _HEADING or not attrs:
        return False
    if "hidden" in attrs and re.search(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", attrs, re.I):
        return True
    for m in _HINTS.finditer(attrs):
        value = next(filter(None, m.groups()), "")
        if any(_NAME.fullmatch(name) for name in value.split()):
            return True
    return False


def _words(text: str) -> int:
    """Words between white space; of scripts without spaces two characters count as one."""
    return len(text.split()) + (len(_UNSPACED.findall(text)) // 2 if not text.isascii() else 0)


def blocks_of(page: str) -> list[Block]:
    """Text blocks of a page in order. A broken page (unclosed or stray tags, cut-off comments) is read as far as it makes sense."""
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, int]] = []
    heading, links, outer, box, boxes = 0, 0, 0, 0, 0
    opened: Counter[str] = Counter()  # how many elements of a name are open
    at, size = 0, len(page)

    def close() -> None:
        if not parts:
            return
        text = _SPACE.sub(" ", "".join(t for t, _ in parts)).strip()
        if text:
            linked = sum(_words(t) for t, a in parts if a)
            out.append(Block(text, _words(text), linked, heading > 0, outer > 0, box))
        parts.clear()

    def pop() -> None:
        nonlocal heading, links, outer, box
        tag, bad, was = stack.pop()
        opened[tag] -= 1
        heading -= tag in _HEADING
        links -= tag == "a"
        outer -= bad
        box = was

    while at < size:
        m = _TAG.search(page, at)
        chunk = page[at : m.start() if m else size]
        if chunk:
            parts.append((_html.unescape(chunk), links > 0))
        if m is None:
            break
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if tag == "br" or tag == "img":
            parts.append((" ", False))
            continue
        if tag in _BLOCK:
            close()
        if m.group(1):
            if opened[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in _VOID:
            continue
        if tag in _RAW:
            if not m.group(3).rstrip().endswith("/") or tag in ("script", "style", "textarea", "title"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if end is None and tag == "head":
                    end = re.compile(r"(?=<body\b)", re.I).search(page, at)
                if end is not None:
                    at = end.end()
                elif tag not in ("head", "object", "noscript", "svg", "math", "audio", "video", "canvas"):
                    at = size
            continue
        if tag in _BOX:
            while stack and outer and not any(opened[t] for t in _BOX):
                pop()  # a box beside the article that was left open doesn't swallow it
        if tag in _CLOSES_P:
            while opened["p"]:
                pop()
        elif tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
            same = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
            if stack and stack[-1][0] in same:
                pop()
        bad = _hinted(tag, m.group(3), box > 0)
        stack.append((tag, bad, box))
        opened[tag] += 1
        heading += tag in _HEADING
        links += tag == "a"
        outer += bad
        if tag in _BOX:
            boxes += 1
            box = boxes
    close()
    return out


def _first_pass(b: Block, stop_words: frozenset) -> str:
    """good, bad, near (looks like text, not surely), short, or links (mostly linked, within an article)."""
    if b.outer:
        return "bad"
    if b.linked > LINKS * b.words:
        if not b.box:
            return "bad"
        if b.linked > 2:
            return "links"
    if "©" in b.text and b.words < MEDIUM and (not b.box or b.text.startswith("©")):
        return "bad"
    if b.heading or b.words < SHORT:
        return "short"
    found = [w.lower() for w in _WORD.findall(b.text)]
    density = sum(w in stop_words for w in found) / max(1, len(found))
    if density >= STOP_HIGH:
        return "good" if b.words >= MEDIUM else "near"
    if density >= STOP_LOW:
        return "near"
    return "short" if b.words < MEDIUM or b.box else "strange"


def _decide_links(first: list[str], blocks: list[Block]) -> None:
    """Three or more blocks of links in a row are a menu; fewer are ambiguous, like short ones."""
    k = 0
    while k < len(first):
        end = k
        while end < len(first) and first[end] == "links" and blocks[end].box == blocks[k].box:
            end += 1
        if end > k:
            first[k:end] = ["bad" if end - k >= MENU else "near"] * (end - k)
        k = max(end, k + 1)


def main_text(page: str | None, stop_words: frozenset = STOP_WORDS) -> str:
    """Blocks of the article, joined by an empty line.

    First pass: elements named as something else, link density, length and stop-word density
    decide what they can. Second pass: a near or short block takes the label of the nearest decided
    neighbours within its article (or within the page, outside any): good if both sides agree, and
    where they differ the nearer by words wins, near blocks lean to good and headings look ahead.
    Blocks of an article without any decided block are good; elsewhere short ones are then bad.
    Within an article, links alone don't decide unless three or more blocks of them follow each other.
    A page without an article in which no block has the density of a known language is judged by length
    and links alone.
    """
    blocks = blocks_of(page or "")
    first = [_first_pass(b, stop_words) for b in blocks]
    _decide_links(first, blocks)
    unknown = "good" if not any(f == "good" or b.box and f != "bad" for f, b in zip(first, blocks)) else "bad"
    first = [unknown if f == "strange" else f for f in first]
    if any(f != "bad" and b.box for f, b in zip(first, blocks)):  # a page with an article has its text there
        first = ["bad" if not b.box else f for f, b in zip(first, blocks)]
    keep = []
    n = len(blocks)
    before: list[tuple[str, int] | None] = [None] * n
    after: list[tuple[str, int] | None] = [None] * n
    for order, side in ((range(n), before), (range(n - 1, -1, -1), after)):
        open_at: dict[int, tuple[str, int]] = {}
        for i in order:
            b = blocks[i]
            if b.box and first[i] == "bad":
                continue
            side[i] = open_at.get(b.box)
            if first[i] in ("good", "bad"):
                open_at[b.box] = (first[i], 0)
            elif b.box in open_at:
                label, far = open_at[b.box]
                open_at[b.box] = (label, far + b.words)
    for i, b in enumerate(blocks):
        label = first[i]
        if label in ("near", "short"):
            x, y = before[i], after[i]
            if x is None and y is None:
                label = "good" if b.box or label == "near" else "bad"
            elif x is None or y is None:
                only = (x or y)[0]
                label = "good" if only == "good" or label == "near" and b.box else only
            elif x[0] == y[0]:
                label = x[0]
            elif b.heading:
                label = y[0]
            elif label == "near":
                label = "good"
            else:
                label = x[0] if x[1] <= y[1] else y[0]
        if label == "good":
            keep.append(b.text)
    return "\n\n".join(keep)


def extract(pages: DataFrame, *, html_col: str = "html", stop_words: frozenset = STOP_WORDS) -> DataFrame:
    """``pages`` without ``html_col``, with text (the main text) and n_chars (its code points).

    Null, empty or textless pages give an empty text. Every row is handled by itself, so ties,
    repeated rows and empty tables need no rule; columns named text or n_chars are replaced.
    """
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    base = pages.select(*kept, F.col(html_col).cast("string").alias("__html"))
    out = T.StructType([*base.schema.fields[:-1], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array((main_text(x.as_py(), stop_words) for x in b.column("__html")), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], names=out.names)

    return base.mapInArrow(run, out).withColumn("n_chars", F.length("text").cast("long"))
