"""Main text of web pages: marked-up articles, and a table of hashed word runs per host for the rest.

A page is parted into blocks. Markup decides most of them: blocks inside a
marked main part (article, main) are the text, blocks inside menus, footers,
adverts, forms and the like are not, nor is an article whose class or id says
that it is a comment, an advert and so on. What is left open, on a page built of
bare divisions or beside a marked part, is decided by repetition: the words
outside the main parts of a page form one token stream, and a run of ``MIN_WORDS``
words that stands on different pages of a host is boilerplate. The open words that such
runs cover are removed and the unique runs kept, in page order with the
marked text.

No suffix array is built: nothing is ordered and no common prefixes are measured. A
table of the hashed first ``MIN_WORDS`` words of each suffix stands in for it; for a
fixed least length it covers the same words. The table has an entry for every word outside the main parts, those of known
boilerplate being further evidence. It is shuffled by host and first words after a
map-side reduction to the least and greatest page, so a menu on a third of all pages
is one small row per task. It is not stored: where suffixes cover open words is made
again for the pages that have some and found by a join that Spark may split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowtriage.sources.workspace import durable

#: Words of a substring that counts as long.
MIN_WORDS = 10

#: Fixed lists: elements whose content is no text, elements that are no main text, elements that
#: part blocks, and words in class, id or role that say the same of any element.
RAW = ("script", "style", "noscript", "template", "iframe", "object", "svg", "math", "textarea", "title", "select", "canvas")
OUTSIDE = ("nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "head")
MAIN = ("article", "main")
BLOCKS = (
    "address", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "li", "ol", "p", "pre", "section", "summary", "table",
    "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
)
OUTSIDE_WORDS = (
    "ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
    "complementary", "contentinfo", "cookie", "cookies", "disqus", "footer", "header", "menu", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "popup", "promo", "related", "search", "share", "sharing", "sidebar", "social",
    "sponsor", "sponsored", "subscribe", "toolbar", "widget",
)
MAIN_WORDS = ("article", "articlebody", "main")
VOID = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
)

#: Fixed: elements without an end tag of their own before one of their kind.
_ENDED_BY = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"),
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.DOTALL | re.IGNORECASE,
)
_HINT = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_WORD = re.compile(r"[A-Za-z0-9]+")
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.IGNORECASE)
_NAMED = {**dict.fromkeys(OUTSIDE, -1), **dict.fromkeys(MAIN, 1)}
_PARTS = {*BLOCKS, *OUTSIDE, *MAIN}

#: Kinds of blocks.
NO_TEXT, OPEN, TEXT = -1, 0, 1


def _kind(name: str, rest: str) -> int:
    """What an element says of its content: no text, nothing, or main text."""
    kind = _NAMED.get(name, 0)
    if rest and kind >= 0 and name not in ("html", "body"):
        for attribute, *values in _HINT.findall(rest):
            value = "".join(values).lower()
            # Only a whole name overrules a main part: has-sidebar or tag-search say something else of it.
            words = set(value.split() if name in MAIN else _WORD.findall(value))
            if words & set(OUTSIDE_WORDS):
                return -1
            if name in ("div", "section") and words & set(MAIN_WORDS):
                kind = 1
    return kind


def blocks(html: str) -> list[tuple[int, str]]:
    """(kind, text) of the non-empty blocks in page order; unclosed and crossed tags are allowed.

    An element outside the text stays so whatever it holds; the main part of a
    page may lie at any depth. Line breaks and inline tags are part of a block:
    the former are white space, the latter nothing.
    """
    found: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    parts: list[str] = []
    now, at = OPEN, 0

    def close() -> None:
        text = " ".join(unescape("".join(parts)).split())
        if text:
            found.append((now, text))
        parts.clear()

    for token in _TOKEN.finditer(html):
        if token.start() > at:
            parts.append(html[at : token.start()])
        at = token.end()
        name = (token["name"] or "").lower()
        if not name:
            continue
        if name == "br":
            parts.append("\n")
            continue
        ends = bool(token["end"])
        kind = 0 if ends else _kind(name, token["rest"])
        if name in _PARTS or kind:
            close()
        # A new block ends an open paragraph, a new list item or cell the one before it.
        if not ends and stack and name in _PARTS and stack[-1][0] in ("p", *_ENDED_BY.get(name, ())):
            stack.pop()
            now = stack[-1][1] if stack else OPEN
        if ends:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
            if place >= 0:
                close()
                del stack[place:]
                now = stack[-1][1] if stack else OPEN
        elif (kind or name in ("li", "div", "section", "span", "td", "ul", "ol", "table")) and name not in VOID:
            if not token["rest"].endswith("/"):
                inherited = NO_TEXT if now == NO_TEXT or kind < 0 else TEXT if kind > 0 else now
                stack.append((name, inherited))
                now = inherited
    if at < len(html):
        parts.append(html[at:])
    close()
    return found


def host(url: str | None) -> str:
    match = _HOST.match(url or "")
    return match[1].lower() if match else ""


#: Kinds of all blocks of a page; ``main`` has the texts of its TEXT blocks, ``texts`` those of the others.
_PARSED = "uid binary, host string, main array<string>, kinds array<tinyint>, texts array<string>"
_SUFFIX = "host string, prefix binary, uid binary, place int"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest

    for batch in batches:
        rows = []
        for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = blocks(html)
            main = [t for k, t in found if k == TEXT]
            rest = [t for k, t in found if k != TEXT]
            uid = xxh3_128_digest(f"{url}\0{html}".encode())
            rows.append((uid, host(url), main, [k for k, _ in found], rest))
        columns = list(zip(*rows)) if rows else [[]] * 5
        kinds = [pa.binary(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int8()), pa.list_(pa.string())]
        made = [pa.array(c, type=k) for c, k in zip(columns, kinds)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[2:], *made], names=[*batch.schema.names[2:], "uid", "host", "main", "kinds", "texts"]
        )


def _suffixes(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries of the suffix table: every word outside the main parts; -1 as the place of those that cover no open word."""
        from xxhash import xxh3_128_digest

        for batch in batches:
            hosts, prefixes, uids, places = [], [], [], []
            for uid, name, kinds, texts in zip(*(c.to_pylist() for c in batch.columns)):
                words, latest = [], []
                last_open = -1
                for kind, text in zip((k for k in kinds if k != TEXT), texts):
                    new = text.lower().split()
                    words += new
                    if kind == OPEN:
                        last_open = len(words) - 1
                        latest += range(len(words) - len(new), len(words))
                    else:
                        latest += [last_open] * len(new)
                for place in range(len(words) - min_words + 1):
                    hosts.append(name)
                    prefixes.append(xxh3_128_digest(" ".join(words[place : place + min_words]).encode()))
                    uids.append(uid)
                    places.append(place if latest[place + min_words - 1] >= place else -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(prefixes, pa.binary()), pa.array(uids, pa.binary()), pa.array(places, pa.int32())],
                names=["host", "prefix", "uid", "place"],
            )

    return run


def _unique_runs(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, covered_words = [], []
            for main, kinds, texts, places in zip(*(c.to_pylist() for c in batch.columns[-4:])):
                covered: set[int] = set()
                for place in places or ():
                    covered.update(range(place, place + min_words))
                out, at, removed = [], 0, 0
                marked, others = iter(main), iter(texts)
                for kind in kinds:
                    if kind == TEXT:
                        out.append(next(marked))
                        continue
                    words = next(others).split()
                    if kind == OPEN:
                        rest = [w for i, w in enumerate(words, at) if i not in covered]
                        removed += len(words) - len(rest)
                        if rest:
                            out.append(" ".join(rest))
                    at += len(words)
                kept.append("\n".join(out))
                covered_words.append(removed)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-4], pa.array(kept, pa.string()), pa.array(covered_words, pa.int64())],
                names=[*batch.schema.names[:-4], "text", "n_repeated"],
            )

    return run


def main_text(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_words: int = MIN_WORDS
) -> DataFrame:
    """key, url, text and n_repeated (open words removed as repeated) of every row.

    A null or empty html has an empty text, a null url belongs to the host ''.
    Rows equal in url and html count as one page, so a page repeated as a whole
    is not boilerplate of itself; each row still gives a row. A page without a
    main part whose open words are all covered has an empty text. Other columns
    of the input do not matter, whatever their names.
    """
    rows = pages.select(
        F.col(url).alias("_url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("_html"),
        F.col(key).alias("key"), F.col(url).alias("address"),
    )
    kinds = dict(rows.dtypes)
    head = f"key {kinds['key']}, address {kinds['address']}, "
    parsed = durable(rows.mapInArrow(_parse, head + _PARSED), "page-blocks")
    open_ = F.array_contains("kinds", F.lit(OPEN).cast("tinyint"))
    words = parsed.select("uid", "host", "kinds", "texts")
    repeated = (
        words.mapInArrow(_suffixes(min_words), _SUFFIX).groupBy("host", "prefix").agg(F.min("uid").alias("a"), F.max("uid").alias("b")).where("a <> b")
    ).select("host", "prefix")
    covered = (
        words.where(open_).mapInArrow(_suffixes(min_words), _SUFFIX).where("place >= 0").join(repeated, ["host", "prefix"], "left_semi")
        .groupBy("uid").agg(F.collect_set("place").alias("places"))
    )
    marked = parsed.where(~open_).select("key", "address", F.array_join("main", "\n").alias("text"), F.lit(0).cast("long").alias("n_repeated"))
    unmarked = parsed.where(open_).join(covered, "uid", "left").select("key", "address", "main", "kinds", "texts", "places")
    unmarked = unmarked.mapInArrow(_unique_runs(min_words), head + "text string, n_repeated long")
    return marked.unionByName(unmarked).select(F.col("key").alias(key), F.col("address").alias(url), "text", "n_repeated")
