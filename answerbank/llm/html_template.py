"""Main text of web pages by equivalence-class template deduction (operator 1).

Tokens of a page are its tags (told apart by their path from the root) and its text runs.  A
token's occurrence vector says how often it occurs on each page of the host.  Tokens that
share a vector form an equivalence class; a class is large if it has
``CLASS_SIZE`` tokens and frequent if it covers ``SUPPORT`` pages and half of the host's pages.  As a
tag token holds its whole path, the tags of a class are nested by construction; a class is valid
if tags are among its tokens.  The valid classes of a host nest into its template: tags, and
text that stands once in the same place of every page.  What the template leaves open are slots.
The main slot is the article: by its tag or role where the page has one, else the deepest template element
that holds most of the host's free text, else the whole body.  Menus, adverts and the like are told
by fixed names of tags, roles and classes.  Text in an article or in the main slot stays, however often it repeats: pages share passages,
and hosts hold near copies.  Template text goes from pages that have neither.

Vectors are unbounded, so they are compared by a fingerprint: two sums of a hash of (page, count)
over the pages, which Spark adds up before the shuffle.  A template has at most twice as many tokens
as the host's mean page, since each of its tokens is on half of the pages.

Defined cases: a null or empty html gives an empty text; a page without a host in its
url is extracted without a template; an html that breaks off is read to its end, an unfinished tag at
the end is dropped; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import html as html_entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerbank.llm.common import checkpointed, table

CLASS_SIZE, SUPPORT = 3, 5
#: A template element is the main slot if it holds this share of the host's free text.
MAIN_SHARE = 0.6

# Names of HTML elements by what they mean, and usual names of page parts.
RAW = {"script", "style", "textarea", "title", "xmp", "noembed"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup"
    " time tt u var wbr".split()
)
SKIPPED = set(
    "head script style noscript template textarea title xmp noembed svg math iframe object canvas audio video map select option"
    " datalist button form fieldset nav footer aside menu dialog noframes frameset".split()
)
MAIN_TAGS = {"article", "main"}
#: Opening the key closes an open element of these names that has no other element open inside.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SKIPPED_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
SKIPPED_NAMES = set(
    "ad ads adbox adsense advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu"
    " breadcrumb breadcrumbs header masthead topbar footer sidebar aside cookie cookies consent gdpr notice notices alert popup"
    " modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations"
    " pagination pager toolbar widget comment comments commentlist respond replies disqus copyright legal skip".split()
)

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/\"'>]+)")
MASK = (1 << 64) - 1


def part_names(value: str) -> bool:
    """Whether a class or id names a page part that is no article (``with-sidebar`` does not)."""
    for name in value.lower().split():
        parts = re.split(r"[^a-z0-9]+", name)
        if parts[0] not in ("with", "has", "no", "without") and (name in SKIPPED_NAMES or parts[0] in SKIPPED_NAMES or parts[-1] in SKIPPED_NAMES):
            return True
    return False


def classify(name: str, attributes: str) -> tuple[int, bool, bool, bool]:
    """Signature of a tag, whether its content is skipped, whether only outside articles, whether it is an article."""
    skipped, outside, main, marks = name in SKIPPED, name == "header", name in MAIN_TAGS, [name]
    if attributes.strip(" /"):
        found = {m[1] or m[5]: m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        found = {k.lower(): html_entities.unescape(v) for k, v in found.items()}
        role = found.get("role", "").strip().lower()
        main |= role in ("main", "article")
        skipped |= role in SKIPPED_ROLES or "hidden" in found or found.get("aria-hidden", "") == "true"
        skipped |= "display:none" in found.get("style", "").replace(" ", "").lower()
        if name not in ("html", "body", "main") and (name != "article" or part_names(found.get("class", "")) and "comment" in found["class"]):
            skipped |= part_names(found.get("class", "")) or part_names(found.get("id", ""))
        marks += [re.sub(r"\d+", "0", found.get(k, "")) for k in ("class", "id", "role")]
    return xxhash.xxh64_intdigest(" ".join(marks)), skipped, outside, main


def squeeze(text: str) -> str:
    return " ".join(html_entities.unescape(text).split()) if "&" in text else " ".join(text.split())


def text_token(path: int, text: str) -> int:
    return xxhash.xxh64_intdigest(text, seed=path) | 1


def read_page(html: str, known: dict) -> tuple[list[int], list[tuple]]:
    """Tag tokens of a page (in order) and its blocks ``(text, path, paths above, in an article, skipped)``.

    ``known`` caches :func:`classify` by tag text.
    """
    tags: list[int] = []
    blocks: list[tuple] = []
    stack: list[tuple] = []  # (name, path, skipped, in an article)
    pieces: list[str] = []
    done = 0

    def flush() -> None:
        if pieces:
            text = squeeze("".join(pieces))
            pieces.clear()
            if text:
                _, path, skipped, main = stack[-1] if stack else ("", 0, False, False)
                blocks.append((text, path, tuple(x[1] for x in stack), main, skipped))

    while m := MARKUP.search(html, done):
        if m.start() > done:
            pieces.append(html[done : m.start()])
        done = m.end()
        name = m[2]
        if name is None:  # a comment, declaration or broken tag
            continue
        name = name.lower()
        if m[1]:
            if name == "br" or name == "p" and not any(x[0] == "p" for x in stack):
                pieces.append(" ") if name == "br" else flush()
                continue
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is not None:
                flush()
                tags.append(stack[depth][1] & ~1 ^ 2)
                del stack[depth:]
            continue
        key = (name, m[3])
        if key not in known:
            if len(known) > 20_000:
                known.clear()
            known[key] = classify(name, m[3])
        mark, skipped, outside, main = known[key]
        if name == "br":
            pieces.append(" ")
            continue
        inside = stack[-1] if stack else ("", 0, False, False)
        if name in INLINE and not skipped:
            continue
        if name not in INLINE:
            flush()
            if inside[0] == "p":
                stack.pop()
            while stack and stack[-1][0] in CLOSED_BY.get(name, ()):
                stack.pop()
            inside = stack[-1] if stack else ("", 0, False, False)
        elif skipped:
            pieces.append(" ")
        path = ((inside[1] + mark) * 0x9E3779B97F4A7C15 ^ inside[1] >> 29) & MASK & ~3
        tags.append(path)
        if name in VOID or m[3].endswith("/") and name not in RAW:
            continue
        if name in INLINE:  # skipped: its text must not join the block before
            flush()
        stack.append((name, path, inside[2] or skipped or outside and not inside[3], inside[3] or main))
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, done)
            done = end.start() if end else len(html)
    pieces.append(html[done:])
    flush()
    return tags, blocks


def host_of(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(found != "", found)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def occurrences(pages: DataFrame) -> DataFrame:
    """Per host and token: pages, occurrences, the vector's fingerprint, free text inside (tags only).

    Token 0 stands for the page itself; its fingerprint columns hold a sketch of nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            sums: dict[tuple, list] = {}
            for host, page, html in zip(*(batch.column(k) for k in range(3))):
                host, html = host.as_py(), html.as_py() or ""
                tags, blocks = read_page(html, known)
                counts: dict[int, int] = {}
                free: dict[int, int] = {}
                for tag in tags:
                    counts[tag] = counts.get(tag, 0) + 1
                for text, path, above, _, skipped in blocks:
                    token = text_token(path, text)
                    counts[token] = counts.get(token, 0) + 1
                    if not skipped:
                        for x in above:
                            free[x] = free.get(x, 0) + len(text)
                counts[0] = 1
                free[0] = sum(len(b[0]) for b in blocks if not b[4])
                page = page.as_py() & MASK
                for token, n in counts.items():
                    h = xxhash.xxh64_intdigest(page.to_bytes(8, "little") + n.to_bytes(4, "little"))
                    x = sums.setdefault((host, token), [0, 0, 0, 0, 0])
                    x[0] += 1
                    x[1] += n
                    x[2] += h & 0x7FFFFFFF
                    x[3] += h >> 33
                    x[4] += free.get(token, 0)
            keys = list(sums)
            columns = [[k[0] for k in keys], [signed(k[1]) for k in keys], *map(list, zip(*sums.values()))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64() if k else pa.string()) for k, c in enumerate(columns)], ["host", "token", "pages", "n", "va", "vb", "free"]
            )

    named = pages.filter(F.col("host").isNotNull()).select("host", F.xxhash64("page_id", "url", "html").alias("page"), "html")
    parts = named.mapInArrow(run, "host string, token long, pages long, n long, va long, vb long, free long")
    return parts.groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in ("pages", "n", "va", "vb", "free")))


def templates(pages: DataFrame) -> DataFrame:
    """Per host: the template's text tokens and the main slot's path (null if none stands out)."""
    tokens = checkpointed(occurrences(pages).filter(F.col("pages") >= SUPPORT))
    differing = pages.filter(F.col("host").isNotNull()).groupBy("host").agg(F.approx_count_distinct(F.xxhash64("html")).alias("distinct"))
    whole = tokens.filter(F.col("token") == 0).select("host", F.col("pages").alias("all"), F.col("free").alias("all_free"))
    whole = whole.join(differing.filter(F.col("distinct") >= SUPPORT), "host").drop("distinct")
    often = tokens.filter(F.col("token") != 0).join(whole, "host").filter(2 * F.col("pages") >= F.col("all"))
    is_text = F.col("token").bitwiseAND(F.lit(1)) == 1
    is_open = ~is_text & (F.col("token").bitwiseAND(F.lit(2)) == 0)
    holds = is_open & (F.col("n") == F.col("pages")) & (F.col("free") >= MAIN_SHARE * F.col("all_free")) & (F.col("all_free") > 0)
    classes = often.groupBy("host", "pages", "n", "va", "vb").agg(
        F.count("*").alias("size"),
        F.count_if(~is_text).alias("tags"),
        F.collect_list(F.when(is_text, F.col("token"))).alias("texts"),
        # Of two elements that hold as much, the inner one has the smaller share of all text or comes later.
        F.min(F.when(holds, F.struct("free", "token"))).alias("main"),
    )
    valid = classes.filter((F.col("size") >= CLASS_SIZE) & (F.col("tags") >= 2))
    return valid.groupBy("host").agg(F.flatten(F.collect_list("texts")).alias("texts"), F.min("main")["token"].alias("main"))


def main_text(html: str, texts: set[int], slot: int | None, known: dict) -> str:
    """The article's blocks joined by a blank line."""
    blocks = [b for b in read_page(html, known)[1] if not b[4]]
    if any(b[3] for b in blocks):
        blocks = [b for b in blocks if b[3]]
    elif slot is not None and any(slot in map(signed, b[2]) for b in blocks):
        blocks = [b for b in blocks if slot in map(signed, b[2])]
    else:
        blocks = [b for b in blocks if signed(text_token(b[1], b[0])) not in texts]
    return "\n\n".join(b[0] for b in blocks)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (page_id, url, html)."""
    pages = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            out = []
            for html, texts, slot in zip(batch.column(2), batch.column(3), batch.column(4)):
                out.append(main_text(html.as_py() or "", set(texts.as_py() or ()), slot.as_py(), known))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    # From a written table both sides of the join are shuffled, so Spark can split a host's pages over tasks;
    # the templates are hashed, so pages need no sorting.
    joined = pages.join(checkpointed(templates(pages)).hint("shuffle_hash"), "host", "left").select("page_id", "url", "html", "texts", "main")
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def extracted_pages(spark, sf_dir: str) -> DataFrame:
    """Query op1: the main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
