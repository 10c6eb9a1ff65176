"""Main text of web pages by two-pass block rules.

A page is cut at block-level tags.  First pass: link density, length and
stop-word density class each block as good, bad, or undecided.

- Links: more than ``MAX_LINK_DENSITY`` of its characters are bad; more than
  ``LINKED`` leave a block undecided, whatever its words.
- Length: a block under ``MIN_LENGTH`` characters is undecided; it is bad where
  it opens with a copyright sign.
- Stop words: a longer block with ``HIGH_STOPS`` of them is good; with fewer it
  is undecided, for the lists do not cover every language.  Where a page has no
  good block at all, its longer blocks are good.

Second pass: an undecided block takes the label of its nearest decided
neighbours, one on either side; where these differ, or none is decided, it is
good, as nothing but what speaks against a block may drop it.

Containers only remove: a block inside a menu, page header, footer, sidebar,
notice, advert, form or comment section, as its tag, role or name says, is out
and has no say about others.  An ``article`` or ``main`` changes no rule; it
shows that a ``header`` or form around it is not the page's own.

Pages are independent and cost time in proportion to their length, however
damaged; a null or empty page has an empty text, and repeated rows give repeated
results.  Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import free_caches, prepare

MIN_LENGTH = 70
#: Shares of a block's characters inside links.
MAX_LINK_DENSITY, LINKED = 0.8, 0.4
HIGH_STOPS = 0.25

STOP_WORDS = {
    "en": "the of and to a in is it that for on with as was at by be this are from or an not have has had but they his her its you we i which will would there their been were if more when who can all one what so".split(),
    "de": "der die das und in zu den von mit ist des im für auf ein eine dem nicht als auch es an er sie sich so dass bei aus wird hat nach wie war sind noch um am oder aber einer einem über".split(),
    "fr": "le la les de des du et un une en dans que qui est pour pas sur au par avec ce il elle se ne plus sont aux ou mais son sa ses cette nous vous on été".split(),
    "es": "el la los las de del y en un una que es por con para no se su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta".split(),
    "it": "il lo la i gli le di del della dei delle e è in un una che per con non si da dal al alla come più ma sono nel nella ha su questo anche o se ci".split(),
    "pt": "o a os as de do da dos das e em no na nos nas um uma que é por com para não se ao mais como mas foi pelo pela ou seu sua são também já".split(),
    "nl": "de het een en van in is dat op te met voor zijn niet aan er die als ook om maar door bij uit naar wordt was hij ze heeft nog of over dan".split(),
    "pl": "w i z na do nie się to że jest o od po jak za przez ale dla są co był była oraz tym tego ze czy już lub być który która które może".split(),
    "ru": "и в не на что с по как это к из у за от о для он она они но а же бы был была было все его её или так также при до если".split(),
}
STOPS = [frozenset(x) for x in STOP_WORDS.values()]

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements kept on the stack; paragraphs, headings and list items close by themselves.
CONTAINERS = BLOCK_TAGS - frozenset("p h1 h2 h3 h4 h5 h6 hr li dd dt td th tr".split())
OUT_TAGS = frozenset("nav footer aside menu dialog".split())
FORM_TAGS = frozenset("form fieldset".split())
#: Their content is never text of the page.
HIDDEN_TAGS = frozenset("script style noscript template svg math iframe object audio video canvas textarea select title button datalist".split())
OUT_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations newsletter subscribe subscription signup login search widget widgets toolbar pagination pager skip copyright legal disclaimer".split()
)
#: Parts at the end of a name that only say what holds the content.
HOLDERS = frozenset("area bar block box bottom col column container content group holder inner item items left link links list outer panel right row section slot top unit wrap wrapper".split())
#: A name that begins so is out, whatever it goes on to name.
OUT_FIRST = frozenset("related recommended sponsored promoted advertisement".split())
HEADER_NAMES = frozenset("header masthead topbar".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())

#: A tag ends at its ``>``; a quote opens a string only after ``=``; a ``<``
#: outside of strings shows that the one before was no tag.
_token = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>|<[!?][^<>]*+>", re.S)
_attribute = re.compile(r"([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
_ends = {t: re.compile(f"</{t}", re.I | re.A) for t in HIDDEN_TAGS}
_name_part = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_word = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    """``out``: inside a container that is no main text; ``by``: what gave the label."""

    text: str
    link_chars: int
    out: bool
    label: str = ""
    by: str = ""


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in _attribute.finditer(raw)}


def _names(attrs: dict[str, str]) -> set[str]:
    """What the class names and the id name: of each its last part that is no
    holder, and its first if that decides."""
    out = set()
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        parts = [x.lower() for x in _name_part.findall(name)]
        if parts and parts[0] in OUT_FIRST:
            out.add(parts[0])
        while len(parts) > 1 and parts[-1] in HOLDERS:
            if parts[-1] == "content" and len(parts) > 2:
                break  # ad-free-content names what it holds
            parts.pop()
        out.update(parts[-1:])
    return out


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, white space collapsed, without empty ones."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, out, out unless an article follows, inside an article
    opened: Counter[str] = Counter()  # tags of the stack
    now_out = now_soft = leaf_out = in_link = in_article = False
    breaks = 0
    parts: list[str] = []
    links: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, len(" ".join(html.unescape(" ".join(links)).split())), now_out or now_soft or leaf_out))
            parts.clear()
            links.clear()

    at, unclosed = 0, set()
    while at < len(page):
        m = _token.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            parts.append(piece)
            if in_link:
                links.append(piece)
            if breaks and not piece.isspace():
                breaks = 0
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in HIDDEN_TAGS:
            if not closing and not m[3].endswith("/"):
                end = None if tag in unclosed else _ends[tag].search(page, at)
                if end:
                    at = end.start()
                elif tag in ("script", "style"):
                    at = len(page)
                else:
                    unclosed.add(tag)
            continue
        if tag == "a":
            in_link = not closing
        elif tag == "br":
            breaks += 1
            parts.append(" ")
            if breaks > 1:
                flush()
        elif tag == "head":
            continue
        elif tag in BLOCK_TAGS:
            flush()
            breaks = 0
            leaf_out = False
            if closing:
                if opened[tag]:
                    while True:
                        top = stack.pop()[0]
                        opened[top] -= 1
                        if top == tag:
                            break
                    _, now_out, now_soft, in_article = stack[-1] if stack else ("", False, False, False)
                continue
            attrs = _attributes(m[3]) if m[3] else {}
            names = _names(attrs) if attrs else set()
            role = attrs.get("role", "").lower()
            hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
            if tag in ("html", "body"):
                names, role = set(), ""
            if tag in ("article", "main") or role == "main":
                now_soft = False
                bad = hidden or bool(names & {"comment", "comments", "reply"})
                in_article = in_article or not (now_out or bad)
                now_out = now_out or bad
            elif tag in CONTAINERS:
                bad = hidden or tag in OUT_TAGS or bool(names & OUT_NAMES) or role in OUT_ROLES
                bad = bad or not in_article and (tag == "header" or bool(names & HEADER_NAMES))
                now_out = now_out or bad
                now_soft = now_soft or tag in FORM_TAGS
            else:
                leaf_out = hidden or bool(names & OUT_NAMES) or role in OUT_ROLES
            if tag in CONTAINERS:
                stack.append((tag, now_out, now_soft, in_article))
                opened[tag] += 1
    flush()
    return out


def stop_density(words: list[str]) -> float:
    """Share of stop words, of the language that has most of them."""
    return max(sum(w in s for w in words) for s in STOPS) / len(words) if words else 0.0


def decide(b: Block) -> tuple[str, str]:
    """First pass: good, bad or undecided, and by which rule."""
    if b.link_chars > MAX_LINK_DENSITY * len(b.text):
        return "bad", "links"
    if len(b.text) < MIN_LENGTH:
        return ("bad", "length") if b.text[:1] == "©" else ("undecided", "")
    if b.link_chars > LINKED * len(b.text):
        return "undecided", ""
    return ("good", "stops") if stop_density(_word.findall(b.text.lower())) >= HIGH_STOPS else ("undecided", "")


def label(found: list[Block]) -> None:
    """Both passes over a page's blocks."""
    for b in found:
        b.label, b.by = decide(b)
    own = [b for b in found if not b.out]
    if not any(b.label == "good" for b in own):  # in a language without a list
        for b in own:
            if b.label == "undecided" and len(b.text) >= MIN_LENGTH and b.link_chars <= LINKED * len(b.text):
                b.label, b.by = "good", "length"
    first = [b.label for b in own]
    n = len(own)
    before, after, last = [""] * n, [""] * n, ""
    for i in range(n):
        before[i] = last
        last = last if first[i] == "undecided" else first[i]
    last = ""
    for i in range(n - 1, -1, -1):
        after[i] = last
        last = last if first[i] == "undecided" else first[i]
    for b, f, *sides in zip(own, first, before, after):
        if f == "undecided":
            b.label = "bad" if "bad" in sides and "good" not in sides else "good"
            b.by = "neighbours" if any(sides) else "alone"
    for b in found:
        if b.out and b.label != "bad":
            b.label, b.by = "bad", "container"


def extract(page: str | None) -> tuple[str, int, int]:
    """Main text, number of blocks, number of blocks kept."""
    found = blocks(page or "")
    label(found)
    kept = [b.text for b in found if b.label == "good"]
    return "\n".join(kept), len(found), len(kept)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_kept of every row."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        for b in batches:
            got = [extract(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x[0] for x in got], pa.string()), *(pa.array(v, pa.int64()) for v in ([len(x[0]) for x in got], [x[1] for x in got], [x[2] for x in got]))],
                names=["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"],
            )

    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return src.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")
