"""Main text of pages: site templates found by counting element subtrees per host, then the article's blocks.

First pass: every page's element subtrees are hashed; Spark counts, per host, the different page contents that hold
each hash. Subtrees that recur are templates. Second pass: templates and what a page itself marks as boilerplate are
deleted, and the text blocks of the article (of the body, if it has none) are joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import join_groups, pieces
from tidelog.llm.markup import END, START, TEXT, attributes, events
from tidelog.storage import cut

#: Distinct page contents of a host, and their share, from which a subtree is a template.
LEAST, SHARE = 10, 0.05
#: Templates (rows of host and hash) that executors get by broadcast, some 100 bytes each; more are joined.
BROADCAST = 200_000

ROOTS = frozenset(("article", "main"))
DROP = frozenset("head nav footer aside form script style noscript template svg math canvas iframe object button select input textarea dialog menu audio video title meta link".split())
#: Landmark and widget roles that hold no article text.
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of class and id that mark boilerplate wherever they stand; a name is marked if it is one of them, or joins them with NEUTRAL words.
MARKS = frozenset("ad ads advert adverts advertisement advertising adsense breadcrumb breadcrumbs comment comments consent cookie cookies disqus gdpr navbar newsletter pagination share sharing sidebar sponsored".split())
#: More of them for what is outside an article; as names inside one they may well be about its text.
OUTER = MARKS | frozenset("alert aside banner complementary contentinfo dialog footer form login masthead menu modal nav navigation notice overlay pager popup promo recommended related respond search signup social sponsor subscribe subscription widget".split())
NEUTRAL = frozenset("area banner bar block box bottom container form inner left list main notice outer popup right section side signup site slot thread top unit widget wrap wrapper".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
HASHED = BLOCKS - {"html", "body", "hr"} | {"head", "span", "script"}
_WORDS = re.compile(r"[a-z0-9]+")
_MARK = re.compile(r"\b(?:class|id|role)\b", re.I)


def host_of(url: str | None) -> str:
    """The host of a url in lower case; '' if there is none."""
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def subtrees(page: list[tuple]) -> dict[int, int]:
    """Position of a start event -> hash of its subtree (tags and text with white space folded), where it may be a template.

    Left out: an article or main element, what holds one, and all that is inside one: its list items, cells and boxes are
    content even where they recur, unless the page marks them as boilerplate.
    """
    out: dict[int, int] = {}
    parts: list[list[bytes]] = [[]]
    frames: list[list] = []  # position, tag, holds a root
    inside = 0
    for k, (kind, what, _) in enumerate(page):
        if kind == TEXT:
            if t := " ".join(what.split()):
                parts[-1].append(t.encode("utf-8", "surrogatepass"))
        elif kind == START:
            frames.append([k, what, False])
            parts.append([what.encode("utf-8", "surrogatepass")])
            inside += what in ROOTS
        else:
            at, tag, holds = frames.pop()
            own = parts.pop()
            root = tag in ROOTS
            inside -= root
            if root or holds:
                if frames:
                    frames[-1][2] = True
            elif not inside:
                h = xxhash.xxh3_64_intdigest(b"\0".join(own))
                parts[-1].append(b"\1" + h.to_bytes(8, "big"))
                if tag in HASHED:
                    out[at] = h - (1 << 64) if h >> 63 else h
    return out


def _boilerplate(tag: str, raw: str, inside: int) -> bool:
    if tag in DROP or (tag == "header" and not inside):
        return True
    if not raw or tag in ("html", "body") or not _MARK.search(raw):
        return False
    a = attributes(raw)
    if any(r in ROLES for r in a.get("role", "").lower().split()):
        return True
    marks = MARKS if inside else OUTER
    names = (_WORDS.findall(x) for k in ("class", "id") for x in a.get(k, "").lower().split())
    return any(not marks.isdisjoint(n) and all(w in marks or w in NEUTRAL for w in n) for n in names)


def main_text(html: str | None, templates: set[int] | frozenset[int] = frozenset()) -> str:
    """The article's blocks in page order, white space folded, joined by one newline; '' if there is none."""
    page = events(html or "")
    hashes = subtrees(page) if templates else {}
    blocks: list[tuple[bool, str]] = []
    run: list[str] = []
    depth, skip, inside, rooted = 0, 0, 0, False

    def flush() -> None:
        if run:
            if t := " ".join("".join(run).split()):
                blocks.append((inside > 0, t))
            run.clear()

    for k, (kind, what, raw) in enumerate(page):
        if kind == TEXT:
            if not skip:
                run.append(what)
        elif kind == START:
            depth += 1
            if skip:
                continue
            if what in BLOCKS:
                flush()
            if _boilerplate(what, raw, inside) or hashes.get(k) in templates:
                skip = depth
                continue
            if what in ROOTS:
                inside += 1
                rooted = True
            elif what == "br":
                run.append(" ")
        else:
            if skip:
                if skip == depth:
                    skip = 0
            else:
                if what in BLOCKS:
                    flush()
                inside -= what in ROOTS
            depth -= 1
    flush()
    return "\n".join(t for root, t in blocks if root or not rooted)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (x for y in batches for x in pieces(y, 1)):
        hosts, pages, hashes = [], [], []
        for url, html in zip(b.column(0), b.column(1)):
            html = html.as_py() or ""
            name = host_of(url.as_py())
            page = xxhash.xxh3_64_intdigest(html.encode("utf-8", "surrogatepass")) >> 1
            found = {*subtrees(events(html)).values(), None}  # None: the page itself
            hosts += [name] * len(found)
            pages += [page] * len(found)
            hashes += found
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(pages, pa.int64())], names=["host", "hash", "page"])


def templates(pages: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(host, hash) of subtrees in at least `least` different page contents of a host and in that share of them.

    Copies of a page count once, so a page that is copied is no template. Counts are partial before each shuffle and
    keyed by host and hash, so a host of any size is spread over all tasks.
    """
    seen = pages.select("url", "html").mapInArrow(_counted, "host string, hash long, page long").distinct()
    counts = cut(seen.groupBy("host", "hash").agg(F.count("*").alias("n")).where((F.col("n") >= least) | F.col("hash").isNull()), "extract-counts")
    totals = counts.where("hash is null").select("host", F.col("n").alias("total"))
    return counts.where(F.col("hash").isNotNull()).join(totals, "host").where(F.col("n") >= F.greatest(F.lit(float(least)), share * F.col("total"))).select("host", "hash")


def _own_subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, key) of every page's different subtrees; the key is a template's hash and host."""
    for b in (x for y in batches for x in pieces(y, 2)):
        rows, keys = [], []
        for row, url, html in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            name = host_of(url.as_py())
            found = set(subtrees(events(html.as_py() or "")).values())
            rows += [row] * len(found)
            keys += [f"{h}|{name}" for h in found]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(keys, pa.string())], names=["ex_row", "ex_key"])


def _extracted(of_host):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = of_host()
        for b in (x for y in batches for x in pieces(y, 2)):
            own = b.column(3) if b.num_columns > 3 else None
            texts = []
            for k, (url, html) in enumerate(zip(b.column(1), b.column(2))):
                found = frozenset(own[k].as_py() or ()) if own is not None else known.get(host_of(url.as_py()), frozenset())
                texts.append(main_text(html.as_py(), found).encode("utf-8", "replace").decode())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return of


def extract(pages: DataFrame, least: int = LEAST, share: float = SHARE, broadcast: int = BROADCAST) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html).

    Null and empty html: empty text, n_chars 0. A null or unreadable url is of host ''. Repeated rows give repeated
    results. An empty table gives none. Broken markup is read as browsers do, roughly.
    """
    found = cut(templates(pages, least, share), "extract-templates")
    schema = "page_id long, url string, text string, n_chars long"
    rows = pages.select("page_id", "url", "html")
    few = found.limit(broadcast + 1).count() <= broadcast
    if few:
        by_host: dict[str, list[int]] = {}
        for r in found.toLocalIterator():
            by_host.setdefault(r["host"], []).append(r["hash"])
        sent = pages.sparkSession.sparkContext.broadcast({h: frozenset(v) for h, v in by_host.items()})
        return rows.mapInArrow(_extracted(lambda: sent.value), schema)
    # each page meets the templates by host and hash, however many pages its host has, and carries only those it holds
    numbered = cut(rows.select(F.monotonically_increasing_id().alias("ex_row"), "page_id", "url", "html"), "extract-rows")
    own = numbered.select("ex_row", "url", "html").mapInArrow(_own_subtrees, "ex_row long, ex_key string")
    keyed = cut(found.select(F.concat(F.col("hash").cast("string"), F.lit("|"), "host").alias("ex_key"), "hash"), "extract-keys")
    hits = join_groups(own, keyed, "ex_key").groupBy("ex_row").agg(F.collect_set("hash").alias("ex_hashes"))
    return numbered.join(hits, "ex_row", "left").select("page_id", "url", "html", "ex_hashes").mapInArrow(_extracted(dict), schema)
