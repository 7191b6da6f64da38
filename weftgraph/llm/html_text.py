"""Main text of web pages by removing site templates.

A page is read into elements.  What is never main text by its kind (scripts, forms, menus, page
headers and footers, sidebars, notices, adverts, reader comments) is left out; of pages that mark
their article only that is read.  Every other element subtree is hashed, and Spark counts per host on
how many different pages a subtree stands; subtrees that recur across many pages of their host are
its template and go.  Inside a marked article only elements that carry a class, id or role are
template candidates: plain paragraphs there are the text, however often a site repeats them.

Pages of one host with the same candidates and text count as one page, so copies of an article do
not make it a template.

Defined results: null or empty html gives an empty text; a page without candidates skips the count;
a null or odd url is the empty host; repeated rows give equal rows; broken markup never fails (open
elements end with their parent, stray end tags are ignored, a cut tag at the end is dropped); extra
columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, stage

#: A template stands on at least so many different pages, and on this share of the host's pages.
LEAST_PAGES, LEAST_SHARE = 5, 0.25

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p "
    "pre section summary table tbody td tfoot th thead tr ul".split()) - {"br"}
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: An opening tag ends an open element of its set, unless one of the limits stands between.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}),
            "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
            "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
            "option": ({"option"}, {"select"})}
# What is never main text, by element, role, and word of a class or id.
DROP_TAGS = frozenset(
    "script style noscript template head nav aside footer form iframe object svg canvas button select "
    "textarea input menu dialog noembed noframes map audio video datalist".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert "
                       "alertdialog menu menubar toolbar".split())
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement adsbygoogle banner sponsor sponsored promo promotion nav "
    "navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar comments "
    "comment reviews replies disqus cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe signup login share sharing social related recommended pagination "
    "pager toolbar widget widgets skip-link".split())
MAIN_ROLES = frozenset({"main", "article"})

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>?|<\?[^>]*>?|"
                    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|$)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[^\w-]+|(?<=[a-z])(?=[A-Z])")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


class Element:
    """An open element: how its text counts, and a running hash of its subtree."""

    __slots__ = ("tag", "drop", "main", "marked", "digest", "number", "aside")

    def __init__(self, tag: str, drop: bool, main: bool, marked: bool, number: int):
        self.tag, self.drop, self.main, self.marked, self.number = tag, drop, main, marked, number
        self.digest = blake2b(tag.encode(), digest_size=8)
        self.aside: list[str] | None = None  # text of the block that an inline part interrupts


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)}


def _kind(tag: str, attrs: dict[str, str]) -> tuple[bool, bool]:
    """(never main text, marks the main part)."""
    role = attrs.get("role", "").lower()
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    words = {w.lower() for w in _WORD.split(names)} | set(names.lower().split()) \
        | {p for w in names.lower().split() for p in re.split("[-_]+", w)}
    drop = (tag in DROP_TAGS or role in DROP_ROLES or "hidden" in attrs
            or bool(words & DROP_WORDS) and tag not in ("body", "html", "main"))
    return drop, tag in ("article", "main") or role in MAIN_ROLES


def read(page: str | None) -> list[tuple[str, list[int]]]:
    """Blocks of candidate main text in page order: (text, hashes of the template candidates that
    hold it, outermost first)."""
    source = page or ""
    open_: list[Element] = [Element("#page", False, False, False, -1)]
    blocks: list[tuple[str, list[int], str]] = []  # text, numbers of enclosing candidates, zone
    parts: list[str] = []
    hashes: dict[int, int] = {}
    numbers = 0

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if not text or any(e.drop for e in open_):
            return
        zone, inside = "", False
        for e in open_:
            if e.main:
                zone, inside = ("article" if e.tag == "article" or zone == "article" else "main"), True
        first_main = next((i for i, e in enumerate(open_) if e.main), None)
        chain = [e.number for i, e in enumerate(open_)
                 if e.number >= 0 and e.tag not in ("html", "body", "#page") and not e.main
                 and (not inside or i > first_main and e.marked)]
        blocks.append((text, chain, zone))

    def close(upto: int) -> None:
        """Ends all elements from index ``upto`` on."""
        while len(open_) > upto:
            e = open_[-1]
            if e.aside is not None:
                parts[:] = e.aside
            elif e.tag in BLOCK:
                flush()
            open_.pop()
            value = e.digest.digest()
            open_[-1].digest.update(b"(" + value + b")")
            hashes[e.number] = int.from_bytes(value, "little", signed=True)

    def say(text: str) -> None:
        if text:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            words = " ".join(text.split())
            if words:
                open_[-1].digest.update(b"t" + words.encode("utf-8", "surrogatepass"))

    at, end = 0, len(source)
    while at < end:
        found = _TOKEN.search(source, at)
        if not found:
            say(source[at:])
            break
        say(source[at:found.start()])
        at = found.end()
        if found[2] is None:  # comment, doctype, instruction
            continue
        tag = found[2].lower()
        if not found[4]:  # the page ends inside this tag
            break
        if found[1]:
            if tag in ("body", "html"):
                continue
            i = len(open_) - 1
            while i > 0 and open_[i].tag != tag and not (
                    open_[i].tag in ("td", "th", "table") and tag not in BLOCK):
                i -= 1
            if i > 0 and open_[i].tag == tag:
                close(i)
            elif tag == "p":
                flush()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        attrs = _attributes(found[3]) if found[3].strip("/ \t\n\r\f") else {}
        if tag in ENDS_P:
            i = len(open_) - 1
            while i > 0 and open_[i].tag != "p" and open_[i].tag not in BLOCK:
                i -= 1
            if open_[i].tag == "p":
                close(i)
        if tag in SIBLINGS:
            ends, limits = SIBLINGS[tag]
            i, last = len(open_) - 1, None
            while i > 0 and open_[i].tag not in limits:
                if open_[i].tag in ends:
                    last = i
                    if tag not in ("tr",):
                        break
                i -= 1
            if last is not None:
                close(last)
        drop, main = _kind(tag, attrs)
        if tag in BLOCK:
            flush()
        if tag in RAW:
            close_tag = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            body = source[at:close_tag.start() if close_tag else end]
            at = close_tag.end() if close_tag else end
            open_[-1].digest.update(tag.encode() + blake2b(
                body.encode("utf-8", "surrogatepass"), digest_size=8).digest())
            continue
        if tag in VOID or found[3].rstrip().endswith("/") and tag not in BLOCK:
            open_[-1].digest.update(b"<" + tag.encode())
            continue
        marked = any(k in attrs for k in ("class", "id", "role"))
        e = Element(tag, drop, main, marked, numbers)
        numbers += 1
        for k in sorted(attrs):
            e.digest.update(f" {k}={attrs[k]}".encode("utf-8", "surrogatepass"))
        if drop and tag not in BLOCK:
            e.aside = parts[:]
            parts.clear()
        open_.append(e)
    close(1)
    flush()
    # The narrowest marked zone that has text is the page's main part.
    zones = {z for *_, z in blocks}
    keep = {"article"} if "article" in zones else {"main"} if "main" in zones else {""}
    return [(t, [hashes[n] for n in chain]) for t, chain, z in blocks if z in keep]


STEP = ("page_key string, page_id long, url string, host string, signature long, "
        "blocks array<struct<text: string, chain: array<bigint>>>, candidates array<bigint>")


def parse(pages: DataFrame) -> DataFrame:
    """Blocks, candidates and a signature of every page, written once."""
    bounded(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.list_(pa.struct([("text", pa.string()), ("chain", pa.list_(pa.int64()))]))
        schema = pa.schema([("page_key", pa.string()), ("page_id", pa.int64()),
                            ("url", pa.string()), ("host", pa.string()),
                            ("signature", pa.int64()), ("blocks", block),
                            ("candidates", pa.list_(pa.int64()))])
        prefix, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for page, url, source in zip(*(batch.column(c).to_pylist()
                                           for c in ("page_id", "url", "html"))):
                blocks = read(source)
                candidates = sorted({h for _, chain in blocks for h in chain})
                same = blake2b(repr(blocks).encode("utf-8", "surrogatepass"), digest_size=8)
                row = (f"{prefix}-{number}", page, url, host(url),
                       int.from_bytes(same.digest(), "little", signed=True),
                       [{"text": t, "chain": c} for t, c in blocks], candidates)
                number += 1
                for column, value in zip(out, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return stage(pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, STEP),
                 "pages")


def templates(parsed: DataFrame, least_pages: int = LEAST_PAGES,
              least_share: float = LEAST_SHARE) -> DataFrame:
    """host, hash of the subtrees that recur on many different pages of their host."""
    # Copies of a page fold into one before anything is counted; sums combine before the shuffle.
    pages = parsed.groupBy("host", "signature").agg(F.first("candidates").alias("candidates"))
    total = pages.groupBy("host").agg(F.count("*").alias("pages"))
    counts = pages.select("host", F.explode("candidates").alias("hash")).groupBy(
        "host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    return counts.join(total, "host").where(F.col("n") >= least_share * F.col("pages")).select(
        "host", "hash")


def main_text(pages: DataFrame, least_pages: int = LEAST_PAGES,
              least_share: float = LEAST_SHARE) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    parsed = parse(pages)
    found = templates(parsed, least_pages, least_share)
    # Only small rows travel: (page, candidate) against the host's templates.
    hits = (parsed.where(F.size("candidates") > 0)
            .select("page_key", "host", F.explode("candidates").alias("hash"))
            .join(found, ["host", "hash"]).groupBy("page_key")
            .agg(F.collect_set("hash").alias("gone")))
    plain = parsed.where(F.size("candidates") == 0).withColumn(
        "gone", F.lit(None).cast("array<bigint>"))
    rest = parsed.where(F.size("candidates") > 0).join(hits, "page_key", "left")
    gone = F.coalesce("gone", F.expr("cast(array() as array<bigint>)"))
    kept = F.filter("blocks", lambda b: ~F.arrays_overlap(b["chain"], gone))
    both = plain.unionByName(rest).withColumn(
        "text", F.array_join(F.transform(kept, lambda b: b["text"]), "\n"))
    return both.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
