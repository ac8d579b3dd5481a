"""HTML extraction: a page's blocks by its markup, and a host suffix array that removes what repeats across pages.

A scanner that follows the states of HTML's tokenizer (text, tags with quoted and bare attributes, comments, and the raw
text of scripts, styles and the like up to their own end tag) cuts a page into blocks.  Markup says of each block whether it
is furniture (menus, headers, footers, sidebars, notices, adverts, forms, reader comments: by element, role, or a class or
id that is made of nothing but names of furniture), main (inside an article or main element), or loose.  Where less than
half of a page's text that is not furniture is main, marks of articles decide nothing (a teaser card is no story), and all
of it is loose.

The host suffix array: the token streams of a host's pages, of all text that is not main, are concatenated, a suffix array
sorted to depth `RUN` finds the token runs that lie on several distinct pages, and runs on `PAGES` pages or more of the
host are boilerplate.  Hosts are dealt into shards of about `SHARD` pages with an array each; the runs' page counts are added
up over the shards, so the result does not depend on the dealing.  Covered tokens go from loose text.  From main text
they go only if the run also lies in the main text of `PAGES` distinct pages: the title of an article that other pages
link to stays, a line that stands below each article goes.  Runs that repeat in main text alone are copies of articles and
stay.  Equal pages count as one page throughout.

Nulls and ties: a null or empty page has empty text; a null url counts as the host ''; rows that repeat an id are pages of
their own; very long pages are scanned whole; other columns are ignored, also those with the names of results; no pages
give no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dupscan.llm.shared import FEW, U, among, batch, bitmap, combine, cut, ngrams, signed, small_batches

RUN, PAGES, SHARD = 6, 3, 400
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|$)|'([^']*)(?:'|$)|([^\s>]*)))?")
PARTS = re.compile(r"[a-z]+")
HOST = re.compile(r"[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")

#: Elements whose content is raw text up to their own end tag; none of it is shown.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
#: Elements whose content is not text.
HIDDEN = frozenset("template svg math object audio video canvas datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What may stand in a head; anything else ends it.
HEAD = frozenset("head base link meta title style script noscript template".split())
FURNITURE = frozenset("nav aside footer form menu dialog button select fieldset".split())
MAIN = frozenset(["article", "main"])
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody tfoot thead tr ul caption".split())
#: Elements that end an open one of the same kind.
ALIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Elements that shut an open one out of the reach of implied end tags.
WALLS = frozenset("ul ol dl table select article section div body html td th main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: A class or id names furniture if it is made of these words ...
NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus share sharing social related recommended pagination pager toolbar masthead topbar".split())
#: ... and of these, which say nothing by themselves.
PLAIN = frozenset("list box bar block area section container wrapper wrap inner outer item items link links widget slot unit panel group left right top bottom main site page post posts primary secondary global mobile desktop icon icons button buttons js the and for".split())


def names_furniture(value: str) -> bool:
    """Whether one class or id is made of names of furniture and of plain words, digits aside."""
    parts = PARTS.findall(value)
    return not NAMES.isdisjoint(parts) and all(p in NAMES or p in PLAIN for p in parts)


def _attributes(page: str, at: int) -> tuple[dict[str, str], int, bool]:
    """Attributes from `at` on, where the tag ends, whether it closes itself; quotes end only a value that they began."""
    found: dict[str, str] = {}
    closed = False
    while at < len(page):
        c = page[at]
        if c == ">":
            return found, at + 1, closed
        closed = c == "/"
        if closed or c.isspace():
            at += 1
            continue
        m = ATTRIBUTE.match(page, at)
        if not m:
            at += 1
            continue
        found.setdefault(m[1].lower(), next((v for v in m.groups()[1:] if v is not None), ""))
        at = m.end()
    return found, at, closed


def scan(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """('text', text, {}), ('open', name, attributes) and ('end', name, {}) in order; raw text is passed over."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], {}
            return
        c = page[lt + 1 : lt + 2]
        if c == "!" and page.startswith("<!--", lt):
            if lt > at:
                yield "text", page[at:lt], {}
            end = page.find("-->", lt + 2 if page.startswith("<!-->", lt) else lt + 4)
            at = n if end < 0 else end + 3
        elif c == "!" and page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt)
            yield "text", page[at:lt], {}
            yield "plain", page[lt + 9 : n if end < 0 else end], {}
            at = n if end < 0 else end + 3
        elif c in ("!", "?"):
            if lt > at:
                yield "text", page[at:lt], {}
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
        elif m := NAME.match(page, lt + (2 if c == "/" else 1)):
            if lt > at:
                yield "text", page[at:lt], {}
            name = m[0].lower()
            attributes, at, closed = _attributes(page, m.end())
            if c == "/":
                yield "end", name, {}
            else:
                yield "open", name, attributes
                if name in RAW:
                    end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                    at = n if not end else _attributes(page, end.end())[1]
                    yield "end", name, {}
                elif closed and name in HIDDEN:
                    yield "end", name, {}
        elif c == "/":  # no name: passed over up to the next >
            if lt > at:
                yield "text", page[at:lt], {}
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
        else:  # a bare < is text
            yield "text", page[at : lt + 1], {}
            at = lt + 1


def _is_furniture(tag: str, attributes: dict[str, str], main: bool) -> bool:
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").lower().replace(" ", ""):
        return True
    if tag in FURNITURE or tag == "header" and not main:
        return True
    if tag in ("html", "body") or tag in MAIN:
        return False
    if not ROLES.isdisjoint(attributes.get("role", "").lower().split()):
        return True
    names = attributes.get("class", "").lower().split()
    if tag not in ("a", "span") and not re.fullmatch("h[1-6]", tag):  # there an id is a place to jump to
        names += attributes.get("id", "").lower().split()
    return any(names_furniture(x) or x == "header" and not main for x in names)


FURNISHED, LOOSE, CORE = 0, 1, 2


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, kind) of each block in order, FURNISHED, LOOSE or CORE; text has references decoded and single spaces."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    # open elements: name, kind of what is inside, whether that is text at all
    stack: list[tuple[str, int, bool]] = [("", LOOSE, True)]
    head = False

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                out.append((text, stack[-1][1]))

    def close(names: set[str] | frozenset[str], walls: frozenset[str] = frozenset()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                if stack[i][1:] != stack[i - 1][1:]:
                    flush()
                del stack[i:]
                return
            if stack[i][0] in walls:
                return

    for what, value, attributes in scan(page):
        if what in ("text", "plain"):
            if head and not value.isspace():
                head = False
            if not head and stack[-1][2]:
                parts.append(html.unescape(value) if what == "text" else value)
            continue
        if what == "end":
            if value == "head":
                head = False
            elif value in BLOCKS:
                flush()
                if value != "p":
                    close({value})
                else:
                    close({"p"}, WALLS)
            elif value in ("td", "th"):
                parts.append(" ")
                close({value}, frozenset(["table"]))
            elif value not in RAW:
                close({value}, BLOCKS)
            continue
        if value == "head":
            head = True
            continue
        if head and value not in HEAD:
            head = False
        if value in RAW or value in VOID:
            if value in BLOCKS:  # hr
                flush()
            elif value == "br":
                parts.append(" ")
            continue
        if value in ("td", "th"):
            parts.append(" ")
        if value in BLOCKS:
            flush()
            close({"p"}, WALLS)
        if value in ALIKE:
            close(ALIKE[value], WALLS - ALIKE[value])
        if value in ("html", "body") and len(stack) > 1:
            continue
        _, kind, shown = stack[-1]
        main = kind == CORE
        if kind != FURNISHED:
            if _is_furniture(value, attributes, main):
                kind = FURNISHED
            elif value in MAIN or "main" in attributes.get("role", "").lower().split():
                kind = CORE
        if kind != stack[-1][1]:
            flush()
        stack.append((value, kind, shown and value not in HIDDEN))
    flush()
    sizes = [sum(len(t) for t, k in out if k == kind) for kind in (LOOSE, CORE)]
    return [(t, LOOSE if k == CORE else k) for t, k in out] if sizes[1] < sizes[0] else out


def _tokens(found: list[str]) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for b in found for t in b.split()]


def _ids(found: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(t) for t in _tokens(found)], U)


def suffix_runs(streams: list[np.ndarray], run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the runs of `run` tokens in the concatenated streams: for each distinct one a place where it begins in the
    concatenation, on how many streams it lies; and for each place the number of its run, -1 where none begins.

    A suffix array by prefix doubling up to the run's length: suffixes of one rank share that run."""
    lens = np.array([len(s) for s in streams], np.int64)
    n = int(lens.sum()) + len(streams)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    ends = np.cumsum(lens + 1)
    owner = np.repeat(np.arange(len(streams)), lens + 1)
    solid = np.ones(n, bool)
    solid[ends - 1] = False
    rank = np.empty(n, np.int64)
    ids = np.unique(np.concatenate([s.astype(U) for s in streams]), return_inverse=True)[1]
    rank[solid] = ids + len(streams)
    rank[~solid] = np.arange(len(streams))  # a separator that equals nothing
    width = 1
    while width < run:
        step = min(width, run - width)
        after = np.concatenate([rank[step:] + 1, np.zeros(min(step, n), np.int64)])[:n]
        rank = np.unique(rank * (int(rank.max()) + 2) + after, return_inverse=True)[1].astype(np.int64)
        width += step
    inside = np.arange(n) + run < ends[owner]  # the run ends before the separator
    array = np.lexsort((owner, rank))
    array = array[inside[array]]
    new = np.ones(len(array), bool)
    new[1:] = rank[array][1:] != rank[array][:-1]
    fresh = new.copy()
    fresh[1:] |= owner[array][1:] != owner[array][:-1]
    number = np.cumsum(new) - 1
    at = np.full(n, -1, np.int64)
    at[array] = number
    return array[new], np.bincount(number[fresh], minlength=int(new.sum())), at


def covered(starts: np.ndarray, n: int, run: int = RUN) -> np.ndarray:
    """Which of n tokens lie in runs that begin at `starts`."""
    edge = np.zeros(n + run + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + run, -1)
    return np.cumsum(edge)[:n] > 0


def repeated(streams: list[list[str]], run: int = RUN, pages: int = PAGES) -> list[np.ndarray]:
    """For each token stream which tokens lie in runs that `pages` or more distinct streams hold."""
    ids: dict[str, int] = {}
    coded = [np.array([ids.setdefault(t, len(ids)) for t in s], U) for s in streams]
    distinct = list(dict.fromkeys(tuple(c.tolist()) for c in coded))
    _, count, at = suffix_runs([np.array(d, U) for d in distinct], run)
    begin = dict(zip(distinct, np.cumsum([0, *(len(d) + 1 for d in distinct)])[:-1].tolist(), strict=True))
    out = []
    for c in coded:
        own = at[begin[tuple(c.tolist())] :][: len(c)]
        out.append(covered(np.flatnonzero((own >= 0) & (np.append(count, 0)[own] >= pages)), len(c), run))
    return out


def _runs(ids: np.ndarray, host: int) -> np.ndarray:
    """One number for each run of RUN tokens on a host, by position."""
    g = ngrams(ids, RUN)
    return combine(np.full(len(g), host, U), g)


def _host(url: str | None) -> int:
    m = HOST.match(url or "")
    return xxhash.xxh3_64_intdigest((m[1].lower() if m else "").encode("utf-8", "surrogatepass"))


def _page(host: int, whole: int) -> int:
    return int(signed(combine(np.array([host], U), np.array([whole], U)))[0])


def _parsed(it: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(id, url, host, hash of the page's blocks, blocks) of some pages at a time."""
    for rb in it:
        for at in range(0, len(rb), 256):
            out = []
            for key, url, page in zip(*(c.to_pylist() for c in rb.slice(at, 256).columns), strict=True):
                found = blocks(page or "")
                whole = xxhash.xxh3_64_intdigest("\n".join(f"{k}{t}" for t, k in found).encode("utf-8", "surrogatepass"))
                out.append((key, url, _host(url), whole, found))
            yield out


def boilerplate(rows: DataFrame) -> DataFrame:
    """(run): numbers of the runs that lie outside of main text on PAGES distinct pages of their host or more."""
    schema = pa.schema([("host", pa.int64()), ("whole", pa.int64()), ("tokens", pa.binary())])
    counts = pa.schema([("run", pa.int64()), ("n", pa.int64())])

    def streams(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pages in _parsed(it):
            out = []
            for _, _, host, whole, found in pages:
                ids = _ids([t for t, k in found if k != CORE])
                if len(ids) >= RUN:
                    out.append((host, whole, ids.tobytes()))
            if out:
                host, whole, tokens = map(list, zip(*out, strict=True))
                yield batch(schema, signed(np.array(host, U)), signed(np.array(whole, U)), tokens)

    def arrays(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A suffix array of each shard; rows come sorted by host and shard."""
        held: list[np.ndarray] = []
        last = None

        def solve() -> Iterator[pa.RecordBatch]:
            if held:
                place, count, _ = suffix_runs(held)
                flat = np.concatenate([np.append(s, U(0)) for s in held])
                g = _runs(flat, last[0])[place]
                yield batch(counts, signed(g), count)

        for rb in it:
            for host, shard, tokens in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), rb.column(2), strict=True):
                if (host & (2**64 - 1), shard) != last:
                    yield from solve()
                    held, last = [], (host & (2**64 - 1), shard)
                held.append(np.frombuffer(tokens.as_buffer(), U))
        yield from solve()

    distinct = rows.mapInArrow(streams, "host long, whole long, tokens binary").dropDuplicates(["host", "whole"])
    distinct = cut(distinct)
    sizes = distinct.groupBy("host").agg(F.count("*").alias("n"))
    dealt = distinct.join(sizes, "host").withColumn("shard", F.pmod(F.xxhash64("whole"), F.ceil(F.col("n") / SHARD)).cast("int")).select("host", "shard", "tokens")
    each = dealt.repartition("host", "shard").sortWithinPartitions("host", "shard").mapInArrow(arrays, "run long, n long")
    return cut(each.groupBy("run").agg(F.sum("n").alias("n")).where(F.col("n") >= PAGES).select("run"), distinct)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) for each row of pages."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("page"))
    pair = pa.schema([("whole", pa.int64()), ("core", pa.bool_()), ("run", pa.int64())])
    often = boilerplate(rows)
    seen = pages.sparkSession.sparkContext.broadcast(bitmap(often, often.count(), 128))

    def kept(found: list[tuple[str, int]]) -> tuple[bool, list[str]]:
        """Blocks that are not furniture, of one kind: main ones where there are any."""
        core = any(k == CORE for _, k in found)
        return core, [t for t, k in found if k == (CORE if core else LOOSE)]

    def candidates(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each page, known by host and blocks, the runs that may be boilerplate."""
        for some in _parsed(it):
            for _, _, host, whole, found in some:
                core, texts = kept(found)
                runs = _runs(_ids(texts), host)
                runs = np.unique(runs[among(seen.value, runs)])
                if len(runs):
                    yield batch(pair, np.full(len(runs), _page(host, whole)), np.full(len(runs), core), signed(runs))

    asked = rows.mapInArrow(candidates, "whole long, core boolean, run long")
    hits = cut(asked.join(often, "run").distinct(), often)
    # of main text a run goes if it lies in that of PAGES distinct pages
    inside = hits.where("core").groupBy("run").agg(F.count("*").alias("n")).where(F.col("n") >= PAGES).select("run")
    gone = cut(hits.where("not core").select("whole", "run").union(hits.where("core").join(inside, "run").select("whole", "run")), hits)
    small = F.broadcast if gone.count() <= FEW else (lambda df: df)
    gone = gone.groupBy("whole").agg(F.collect_list("run").alias("gone"))  # no more than a page has runs
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("whole", pa.int64()), ("texts", pa.list_(pa.string()))])

    def cleaned(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _parsed(it):
            out = [(key, url, _page(host, whole), kept(found)[1]) for key, url, host, whole, found in some]
            yield batch(schema, *map(list, zip(*out, strict=True)))

    last = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def finish(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for at in range(0, len(rb), 256):
                out = []
                for key, url, texts, known in zip(*(c.to_pylist() for c in rb.slice(at, 256).columns), strict=True):
                    if known:
                        runs = signed(_runs(_ids(texts), _host(url)))
                        split = [t.split() for t in texts]
                        flags, i, texts = covered(np.flatnonzero(np.isin(runs, known)), sum(map(len, split))), 0, []
                        for words in split:
                            own = " ".join(t for t, g in zip(words, flags[i : i + len(words)], strict=True) if not g)
                            i += len(words)
                            if own:
                                texts.append(own)
                    text = "\n".join(texts)
                    out.append((key, url, text, len(text)))
                if out:
                    yield batch(last, *map(list, zip(*out, strict=True)))

    done = rows.mapInArrow(cleaned, "id long, url string, whole long, texts array<string>").join(small(gone), "whole", "left").select("id", "url", "texts", "gone").mapInArrow(finish, "id long, url string, text string, n_chars long")
    return done.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
