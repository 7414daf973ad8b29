"""HTML extraction with a host suffix array.

Pages are read into blocks of text. The token streams of a host's pages (outside the article's own prose) are concatenated and their suffixes
sorted by prefix doubling; neighbours of two distinct pages that share a long enough prefix mark repeated runs. Blocks that such runs cover, or
that stand word for word on another page of the host, are boilerplate; unique runs stay. Markup that says what it is (menus, forms, adverts)
goes even where it is unique.

A host of any size is dealt out in groups of a few hundred pages, each with an array of its own. What one array saw on a single page is pooled
over the host by hashes of all windows and blocks, so how a host is dealt does not show in the result.

The prose of a marked article is never taken out, however often it repeats: copied articles and quoted passages are content. On pages that
mark no article, repetition decides about paragraphs too, unless half of a page's paragraphs repeat, which is a copied article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import BASE, mix, stage
from tessera.llm.urls import split_url

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)/?>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
ROLE_MAIN = re.compile(r"""\brole\s*=\s*["']?main\b""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their contents are no markup, and no text of the page.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol option p pre section select summary table tbody td template tfoot th thead tr ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th figcaption caption".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are no part of an article.
NOISE = frozenset("nav header footer aside form button select option menu template noscript dialog svg canvas object head fieldset".split())
#: Names in class, id or role that say the same.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus reply replies respond share sharing social related recommended widget login signup search pagination pager toolbar skip alert complementary contentinfo".split()
)
#: What may follow such a name in a compound: parts of a page. (`ad-slot` is an advert, `ad-free` and `social-history` are not.)
PARTS = frozenset("area bar block body bottom box button buttons column container content copy cell form frame group holder inner item items left link links list main module outer panel placeholder right row section slot space text title top unit wrap wrapper zone".split())


def hints_of(attributes: str) -> set[str]:
    """The names by which a tag's class, id or role says that it is no part of an article.

    A name counts as a whole (`sidebar`), as the last word of a compound (`main-menu`) or as the first before words for parts of a page.
    """
    found = set()
    for _, value in ATTRIBUTE.findall(attributes):
        for name in value.strip("\"'").split():
            words = [w for w in re.split(r"[-_:]+|(?<=[a-z])(?=[A-Z])|[0-9]+", name) if w]
            words = [w.lower() for w in words]
            if words and words[-1] in HINTS:
                found.add(words[-1])
            elif words and words[0] in HINTS and PARTS.issuperset(words[1:]):
                found.add(words[0])
    return found


#: What a block is: noise by its markup; the article's prose; loose text inside the article; text outside it; paragraphs and the like outside it.
NOISE_BLOCK, PROSE_BLOCK, LOOSE_BLOCK, OUTER_BLOCK, OUTER_PROSE_BLOCK = 0, 1, 2, 3, 4


def read_blocks(page: str | None) -> tuple[list[tuple[str, int]], bool]:
    """(text, kind) of each block in page order, character references decoded and white space made one blank; and whether the page marks its article.

    Tags may be unclosed or out of place: an end tag closes what was opened inside its element, and a block closes an open paragraph.
    """
    blocks: list[tuple[str, int]] = []
    if not page:
        return blocks, False
    stack: list[tuple[str, bool, bool]] = []  # name, noise, inside the article
    text: list[str] = []
    kind, marked = OUTER_BLOCK, False

    def flush() -> None:
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                blocks.append((joined, kind))
            text.clear()

    def current() -> int:
        names = [name for name, _, _ in stack]
        inside = any(a for _, _, a in stack)
        noise = {name for name, n, _ in stack if n}
        # an article's own header holds its title
        if noise and not (inside and noise <= {"header"} and HEADING.intersection(names)):
            return NOISE_BLOCK
        if not inside:
            return OUTER_PROSE_BLOCK if PROSE.intersection(names) else OUTER_BLOCK
        return PROSE_BLOCK if PROSE.intersection(names) else LOOSE_BLOCK

    at = 0
    while m := TAG.search(page, at):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, rest = m[1] or m[4], m[3] if m[2] else m[6]
        if name in BLOCK:
            flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
        elif name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif name not in VOID:
            if name in BLOCK:
                # a paragraph, item or cell ends where the next of its kind, or a block, begins
                ends = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tr": ("tr", "td", "th", "p"), "option": ("option",)}.get(name, ("p",))
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ends:
                        del stack[i:]
                        break
                    if stack[i][0] in ("ul", "ol", "dl", "table", "article", "main", "body", "div", "section", "nav", "aside", "form", "blockquote"):
                        break
            hints = hints_of(rest) if rest and "=" in rest else set()
            article = name in ("article", "main") or bool(rest) and ROLE_MAIN.search(rest) is not None
            hinted = bool(hints) and name not in HEADING and name not in ("html", "body", "main")
            if article and not hinted:
                marked = True
            stack.append((name if not (hinted and hints <= {"header", "masthead"}) else "header", name in NOISE or hinted, article))
        if name in BLOCK or not text:
            kind = current()
    if at < len(page):
        text.append(page[at:])
    flush()
    return blocks, marked


class _Hashes(dict):
    """Hash of each word, kept while there are not too many."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        self[word] = h = hash_word(word)
        return h


_HASHES = _Hashes()


def token_ids(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.int64, len(words))


def hash_word(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63)


def window_keys(ids: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of `length` tokens."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h, x = np.zeros(n, np.uint64), ids.view(np.uint64)
    for i in range(length):
        h = h * BASE + x[i : i + n]
    return mix(h).view(np.int64)


def covered_tokens(hit: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which of n tokens lie in a marked window."""
    step = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(hit)
    step[at] += 1
    step[at + length] -= 1
    return np.cumsum(step)[:-1] > 0


def suffix_ranks(stream: np.ndarray, length: int) -> np.ndarray:
    """Rank of every suffix by its first `length` tokens (a power of two), by prefix doubling: equal ranks, equal prefixes."""
    rank = np.unique(stream, return_inverse=True)[1].astype(np.int64)
    k = 1
    while k < length:
        after = np.concatenate([rank[k:] + 1, np.zeros(min(k, len(rank)), np.int64)])[: len(rank)]
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1].astype(np.int64)
        k *= 2
    return rank


def repeated_windows(streams: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each page's stream, which of its runs of `length` tokens another stream has too.

    The streams are concatenated with a token of its own after each; suffixes sorted by rank stand next to those that share their prefix.
    """
    size = np.array([len(s) for s in streams])
    if not size.sum():
        return [np.zeros(0, bool) for _ in streams]
    inverse = np.unique(np.concatenate(streams), return_inverse=True)[1]
    ends = np.cumsum(size)
    whole = np.insert(inverse + len(streams), ends, np.arange(len(streams)))
    page = np.repeat(np.arange(len(streams)), size + 1)
    rank = suffix_ranks(whole, length)
    order = np.lexsort((page, rank))
    r, p = rank[order], page[order]
    first = np.concatenate([[True], np.diff(r) != 0])
    group = np.cumsum(first) - 1
    least, most = p[first], p[np.append(np.flatnonzero(first)[1:] - 1, len(p) - 1)]
    hit = np.zeros(len(whole), bool)
    hit[order] = (least != most)[group]
    start = np.cumsum(size + 1) - size - 1
    # a run may not go over the end of its page
    return [hit[a : a + max(0, n - length + 1)] for a, n in zip(start, size, strict=True)]


def repeated_positions(streams: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each page's stream, which tokens lie in a run of `length` or more that another stream has too."""
    return [covered_tokens(hit, len(s), length) for s, hit in zip(streams, repeated_windows(streams, length), strict=True)]


def read_streams(page: str | None) -> tuple[list[tuple[str, int]], bool, list[int]]:
    """Blocks, whether the article is marked, and the places of the blocks outside its prose, about which repetition decides."""
    blocks, marked = read_blocks(page)
    return blocks, marked, [i for i, (_, kind) in enumerate(blocks) if kind != PROSE_BLOCK]


def stream_keys(texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token counts of the blocks, the hashes of the windows of their stream, and those of the blocks."""
    words = [t.split() for t in texts]
    ids = token_ids([w for ws in words for w in ws])
    return np.array([len(w) for w in words], np.int64), window_keys(ids, length), np.array([hash_word(t) for t in texts], np.int64)


def known_blocks(texts: list[str], keys: np.ndarray, length: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Token count of each block, and whether its hash is among the keys or windows among them cover `share` of it."""
    sizes, windows, prints = stream_keys(texts, length)
    seen = covered_tokens(np.isin(windows, keys), int(sizes.sum()), length)
    ends = np.cumsum(sizes)
    part = np.array([seen[e - n : e].mean() if n else 0.0 for e, n in zip(ends, sizes, strict=True)])
    return sizes, np.isin(prints, keys) | (part >= share)


def page_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, html) to (host, page), the hashes and the tokens of its blocks outside the article's prose."""
    for batch in batches:
        prints, tokens = [], []
        for text in batch.column(2).to_pylist():
            blocks, _, outer = read_streams(text)
            prints.append([hash_word(blocks[i][0]) for i in outer])
            tokens.append(token_ids([w for i in outer for w in blocks[i][0].split()]).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.list_(pa.int64())), pa.array(tokens, pa.binary())], names=["host", "page", "prints", "tokens"])


def repeated_keys(streams: DataFrame, length: int, group: int) -> DataFrame:
    """(page, known, pooled): hashes of the windows and blocks of a page, outside its prose, that another page of the host has too.

    Known are those that the page's own array saw twice, pooled those that only other arrays saw.
    """
    counts = streams.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    dealt = streams.join(counts, "host").withColumn("salt", F.pmod(F.xxhash64("page"), F.ceil(F.col("host_pages") / group)))

    def array(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("page")
        tokens = [np.frombuffer(t, np.int64) for t in part["tokens"]]
        prints = [np.unique(np.array(p, np.int64)) for p in part["prints"]]
        block, times = np.unique(np.concatenate(prints), return_counts=True)
        twice = block[times > 1]
        out, named = [], set()
        for host, page, ids, own, hit in zip(part["host"], part["page"], tokens, prints, repeated_windows(tokens, length), strict=True):
            keys = window_keys(ids, length)
            again = np.isin(own, twice)
            known = np.unique(np.concatenate([keys[hit], own[again]]))
            # a class of equal windows is named once an array, whatever the number of its pages
            new = [k for k in known.tolist() if k not in named]
            named.update(new)
            out.append((host, page, known, np.unique(np.concatenate([keys[~hit], own[~again]])), new))
        return pd.DataFrame(out, columns=["host", "page", "known", "open", "named"])

    runs = stage(dealt.groupBy("host", "salt").applyInPandas(array, "host string, page long, known array<long>, open array<long>, named array<long>"), "runs")
    left = runs.select(F.xxhash64("host").alias("host"), "page", F.explode("open").alias("key"))
    named = runs.select(F.xxhash64("host").alias("host"), F.explode("named").alias("key")).withColumns({"a": F.lit(0).cast("long"), "b": F.lit(1).cast("long")})
    found = left.select("host", "key", F.col("page").alias("a"), F.col("page").alias("b")).unionByName(named).groupBy("host", "key").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a <> b").select("host", "key")
    pooled = left.join(stage(found, "found"), ["host", "key"], "left_semi").groupBy("page").agg(F.collect_list("key").alias("pooled"))
    return runs.select("page", "known").join(pooled, "page", "left")


def removed_blocks(blocks: list[tuple[str, int]], outer: list[int], repeated: np.ndarray, length: int, share: float) -> set[int]:
    """The places of a page's blocks that repetition takes out."""
    if not len(repeated):
        return set()
    _, known = known_blocks([blocks[i][0] for i in outer], repeated, length, share)
    removed = {i for i, k in zip(outer, known, strict=True) if k}
    # paragraphs of a page without a marked article: where half of them repeats, an article was copied and stays
    own = [i for i in outer if blocks[i][1] == OUTER_PROSE_BLOCK]
    sizes = {i: len(blocks[i][0].split()) for i in own}
    if 2 * sum(n for i, n in sizes.items() if i in removed) >= sum(sizes.values()):
        removed -= set(own)
    return removed


def main_text(page: str | None, removed: set[int]) -> tuple[str, int, int]:
    """The article's text, and how many blocks repetition and markup took out."""
    return text_of(*read_blocks(page), removed)


def text_of(blocks: list[tuple[str, int]], marked: bool, removed: set[int]) -> tuple[str, int, int]:
    kept, repeated, noise = [], 0, 0
    for i, (text, kind) in enumerate(blocks):
        if i in removed:
            repeated += 1
        elif kind == NOISE_BLOCK or kind in (OUTER_BLOCK, OUTER_PROSE_BLOCK) and marked:
            noise += 1
        else:
            kept.append(text)
    return " ".join(kept), repeated, noise


def extract(pages: DataFrame, length: int = 8, share: float = 0.8, group: int = 256) -> DataFrame:
    """(page_id, url, text, n_chars, n_repeated, n_noise) of every page.

    A null or empty page has an empty text. A null url is a host of its own (the empty one). Rows repeated word for word count as one page in
    the search for repeats and each get their text; a page of any length is read whole; other columns are not read; an empty table gives
    no rows. `length` is a power of two; `group` deals out the work and does not change the result.
    """
    host, _ = split_url(F.col("url"))
    pages = pages.select("page_id", "url", "html", F.coalesce(host, F.lit("")).alias("host"), F.xxhash64("page_id", "url", "html").alias("page"))
    streams = stage(pages.select("host", "page", "html").mapInArrow(page_streams, "host string, page long, prints array<long>, tokens binary"), "streams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        values = lambda x: x.values.to_numpy() if x.is_valid else none
        for batch in batches:
            rows = []
            for page, known, pooled in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                blocks, marked, outer = read_streams(page)
                rows.append(text_of(blocks, marked, removed_blocks(blocks, outer, np.concatenate([values(known), values(pooled)]), length, share)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.string()), pa.array([len(r[0]) for r in rows], pa.int64()), *[pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2)]], names=["page_id", "url", "text", "n_chars", "n_repeated", "n_noise"])

    joined = pages.join(repeated_keys(streams, length, group), "page", "left").select("page_id", "url", "html", "known", "pooled")
    return joined.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long, n_repeated long, n_noise long")


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page; edge cases as extract() states them."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
