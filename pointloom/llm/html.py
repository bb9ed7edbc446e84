"""Main text of web pages by two passes over blocks: stop-word density, length and link density decide what they can; short
blocks that they can't decide take the label of the nearest decided neighbours."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import batches

#: Elements whose content is no text of the page; elements that hold something other than the article; elements
#: that begin and end a block.
DROPPED = frozenset("script style noscript template head title svg math iframe object embed canvas audio video map select textarea datalist".split())
OUTSIDE = frozenset("nav footer aside form button menu dialog fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption legend button optgroup option".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening tag of the same kind, or the end of what holds them, closes.
CLOSED_BY_NEXT = frozenset("p li dt dd tr td th option".split())
HOLDS_ARTICLE = frozenset("article main".split())
BARRIERS = frozenset("article main body".split())
#: Words in class, id or role that name what isn't the article. They match whole words of the attribute.
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside widget footer foot copyright masthead topbar toolbar cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended "
    "comment comments commentlist disqus respond reply replies discussion reactions pagination pager paging skip hidden legal disclaimer "
    "complementary contentinfo dialog form outbrain taboola teaser tags taglist".split()
)
HEADER_NAMES = frozenset("header banner masthead".split())
#: Of these names, those that a part of an article itself may bear.
ALSO_INSIDE = frozenset("legal discussion disclaimer form reply replies reactions foot search tags banner skip dialog".split())
#: Stop words of the languages that the rules know.
STOP = frozenset(
    "the of and to in a is that it for was on are as with be by this from at or an have not which you but he she they his her their we were been "
    "has had will would there what so if no can all one when who more said do up out about than into them some could its only over also "
    "der die das und ist von zu den mit sich des auf für im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am "
    "sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn ich "
    "le la les et de des un une du en est que qui dans pour par sur pas au plus ne se ce il elle avec sont ou aux mais son sa ses cette leur y "
    "nous vous ont été être fait comme tout on si même "
    "el los las y del que en un una es por con para no se lo al como más su sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta "
    "hay donde quien desde todo nos durante".split()
)

#: A block of this many characters is long; below the other it is short. Shares of stop words that decide, and of linked text.
LONG, SHORT = 200, 70
STOP_LOW, STOP_HIGH, LINKS = 0.10, 0.20, 0.35
#: Below this share of stop words in all of a page's unlinked long blocks, its language isn't one that the rules know.
FOREIGN = 0.05
#: Characters from here on are those of scripts that say in one what letters say in three.
DENSE, DENSE_WEIGHT = "\u2e80", 3

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)(?:>|\Z)|(?P<text>[^<]+|<)", re.S
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
HREF = re.compile(r"\bhref\s*=", re.I)
#: Elements of which the end tag alone ends the content, even if that is the end of the page.
RAW = frozenset("script style textarea title noscript template iframe svg select".split())
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WORDS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    linked: int = 0
    outside: bool = False
    inside: bool = False
    heading: bool = False
    label: str = ""


def _named(tag: str, attrs: str, in_article: bool) -> bool:
    """Whether an element's attributes say that it isn't the article's."""
    if tag in ("html", "body", "main", "article"):
        return False
    for name, *values in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), values[0] or values[1] or values[2]
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none", value, re.I):
                return True
            continue
        words = {w.lower() for w in NAME.findall(value)}
        if in_article:
            words -= ALSO_INSIDE
        if words & {"has", "with", "without", "no"}:  # as in has-sidebar, of what stands beside one
            continue
        if words & NAMED or (not in_article and words & HEADER_NAMES):
            return True
    return False


class Page:
    """The open elements of a page while it is read, and the blocks so far.

    Each open element knows whether it is outside the article, and whether inside an article element. Where the open elements of
    each kind are is kept, so that a tag costs what it opens and closes, however deep it is."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = self.links = 0
        self.open: list[tuple[str, bool, bool, bool]] = []  # tag, outside, inside, whether a link
        self.places: dict[str, list[int]] = {}
        self.open_blocks: list[int] = []
        self.barriers: list[int] = []  # elements that an end tag of an inline element doesn't close

    def flush(self) -> None:
        """Ends the block at hand."""
        text = " ".join(entities.unescape("".join(self.parts)).split())
        if text:
            _, outside, inside, _ = self.open[-1] if self.open else ("", False, False, False)
            heading = any(t[0] == "h" and t[1:].isdigit() for t, *_ in self.open[-3:])
            self.blocks.append(Block(text, self.linked, outside, inside, heading))
        self.parts.clear()
        self.linked = 0

    def text(self, text: str) -> None:
        self.parts.append(text)
        if self.links:
            self.linked += len(text)

    def begin(self, tag: str, attrs: str) -> None:
        if tag in BLOCKS:
            self.flush()
            above = self.open[self.open_blocks[-1]][0] if self.open_blocks else ""
            if above and (above == "p" or (above == tag and tag in CLOSED_BY_NEXT)):
                self.drop(self.open_blocks[-1])
        elif tag == "br":
            self.parts.append(" ")
        elif tag == "a" and self.places.get("a"):  # links don't nest
            self.end("a")
        if tag in VOID:
            return
        _, outside, inside, _ = self.open[-1] if self.open else ("", False, False, False)
        inside = inside or tag in HOLDS_ARTICLE
        outside = outside or tag in OUTSIDE or (tag == "header" and not inside) or _named(tag, attrs, inside)
        link = tag == "a" and HREF.search(attrs) is not None
        at = len(self.open)
        self.open.append((tag, outside, inside, link))
        self.places.setdefault(tag, []).append(at)
        self.links += link
        if tag in BLOCKS:
            self.open_blocks.append(at)
        if tag in BARRIERS:
            self.barriers.append(at)

    def end(self, tag: str) -> None:
        places = self.places.get(tag)
        if not places or (tag not in BLOCKS and self.barriers and self.barriers[-1] > places[-1]):
            return
        if self.open_blocks and self.open_blocks[-1] >= places[-1]:
            self.flush()
        self.drop(places[-1])

    def drop(self, place: int) -> None:
        """Closes the open elements from a place on."""
        for at in range(len(self.open) - 1, place - 1, -1):
            tag, _, _, link = self.open.pop()
            self.places[tag].pop()
            self.links -= link
            for kept in (self.open_blocks, self.barriers):
                if kept and kept[-1] == at:
                    kept.pop()


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order, each with what the markup around says."""
    read, ends = Page(), {}
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        if (text := m["text"]) is not None:
            read.text(text)
        elif (tag := m["tag"]) is None:
            continue
        elif m["close"]:
            read.end(tag.lower())
        elif (tag := tag.lower()) in DROPPED:
            if ends.get(tag, (0, 0))[0] < at:  # the next end tag from here on; that there is none is remembered too
                found = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                ends[tag] = (n + 1, n) if found is None else (found.start(), found.end())
            start, end = ends[tag]
            if tag in RAW or start <= n:
                at = end
            read.parts.append(" ")
        else:
            read.begin(tag, m["attrs"])
    read.flush()
    return read.blocks


def weight(text: str) -> int:
    """Characters, those of dense scripts for several."""
    return len(text) if text.isascii() else len(text) + (DENSE_WEIGHT - 1) * sum(c >= DENSE for c in text)


def classify(found: list[Block]) -> None:
    """First pass: each block is good, bad or undecided. Second: undecided ones take the label of the nearest decided neighbours.

    Where the page's language isn't one whose stop words are known, their density says nothing, and length and links alone decide.
    A long block without links that has no decided neighbour is good."""
    articles = any(b.inside for b in found)
    seen = []
    for b in found:
        words = WORDS.findall(b.text.lower())
        stop = sum(w in STOP for w in words)
        seen.append((weight(b.text), stop / max(1, len(words)), b.linked / max(1, len(b.text)), stop, len(words)))
    plain = [(x[3], x[4]) for b, x in zip(found, seen) if x[0] >= LONG and x[2] <= LINKS and not b.outside and (b.inside or not articles)]
    foreign = sum(s for s, _ in plain) < FOREIGN * sum(w for _, w in plain)
    for b, (size, stop, links, _, _) in zip(found, seen):
        if b.outside or links > LINKS or (articles and not b.inside):
            b.label = "bad"
        elif b.text.startswith(("©", "Copyright")) and size < LONG:
            b.label = "bad"
        elif size >= LONG and (stop >= STOP_LOW or b.inside or foreign) or size >= SHORT and stop >= STOP_HIGH:
            b.label = "good"
        elif size >= LONG and stop < STOP_LOW / 2 and links > 0:
            b.label = "bad"
        else:
            b.label = "short"
    # neighbours within the same kind of container say more: what the markup sets outside the article is passed over
    looks: list[list[str]] = [[] for _ in found]
    for span in (range(len(found)), range(len(found) - 1, -1, -1)):
        last = {True: "", False: ""}
        for i in span:
            b = found[i]
            looks[i].append(last[b.inside])
            if b.label != "short" and not b.outside:
                last[b.inside] = b.label
    for b, look, (size, _, links, _, _) in zip(found, looks, seen, strict=True):
        if b.label != "short":
            continue
        if b.inside:  # an article element vouches for what it holds
            b.label = "good" if "good" in look or "bad" not in look else "bad"
        elif look == ["", ""]:
            b.label = "good" if size >= LONG and links == 0 else "bad"
        else:
            b.label = "good" if look[0] == look[1] == "good" or ("good" in look and ("" in look or b.heading)) else "bad"


def main_text(page: str) -> str:
    found = blocks(page)
    classify(found)
    return "\n\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per input row.

    A page takes time in proportion to its length. A null or empty page, one without text, and one that is all menus have an empty text. Broken markup doesn't fail: tags that
    aren't closed end with the page or what holds them. Character references are decoded once, after the markup is parsed.
    Repeated rows give a row each; null ids and urls stay null; other columns are left out; no pages give no rows."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, column="html"):
            texts = [main_text(h or "") for h in batch.column("html").to_pylist()]
            cols = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
