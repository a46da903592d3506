"""Main text of pages by nearest-URL page differencing.

A page becomes lines: one a block, character references decoded, white space turned into single spaces.
Pages are ordered by host and URL path, so a page's nearest URLs are its neighbours; its lines are aligned
with those of the nearest page before and after of another text, where these are of the same host, by longest
common subsequence, and shared lines are deleted as template, on every page. Three things bound the deletion:
lines in elements that are no article by name (menus, forms, adverts and so on) go in any case, shared or
not; lines inside an explicit article go only if both neighbours share them, and only at its edges, before the first and
after the last line of its own; and a neighbour that shares most
of the explicit article (of all text where there is none) is a near copy, not a template, so that alignment
is not used alone, and what both share is kept if it is most of the article, or nearly all text.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsieve.llm.common import columns, cut_lineage, shuffle_width
from litsieve.llm.neighbours import AFTER, BEFORE, OWN, Ranges, ranges_of
from litsieve.llm.warc import url_key

NOISE, FREE, ARTICLE = 0, 1, 2
COPY_SHARE = 0.5
TEMPLATE_SHARE = 0.9       # of a page without an explicit article, at most so much is template even if both neighbours share it

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*(?:>|\Z)|"
                   r"</?[a-zA-Z](?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*>|</?[a-zA-Z][^<>]*(?:>|\Z|(?=<))|[^<]+|<", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
#: Element names of the HTML standard and common class words.
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp plaintext svg math canvas object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = RAW | frozenset("head nav footer aside form button select option dialog menu audio video map label fieldset header".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot
th thead tr ul""".split())
NOISE_WORDS = frozenset("""ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie
cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription paywall sidebar aside menu menus nav navbar
navigation breadcrumb breadcrumbs masthead header footer comment comments commentlist disqus reply replies respond share sharing social
related recommended recommendations teaser widget widgets toolbar pagination pager copyright login signin signup skip hidden""".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Noise words that, said first, name a token's part of a page whatever kind of box it is (``comment-list``, ``ad-slot``).
HEAD_WORDS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr newsletter
subscribe subscription comment comments disqus reply replies share sharing social related recommended breadcrumb breadcrumbs popup modal
pagination sidebar navbar menu nav footer""".split())
PART_WORDS = frozenset("""article articles bar bars box boxes banner bottom button buttons card cards content feed form grid heading holder
icon icons inline item items label left link links list lists message meta notice overlay panel place placement policy popup post posts rail
right row slot stack stories story strip text thread title top unit units zone""".split())
#: Noise words that, said last after an owner, do the same (``post-comments``, ``site-footer``; not ``has-sidebar``).
TAIL_WORDS = frozenset("comments replies footer nav navigation navbar menu sidebar share sharing related breadcrumbs ads adverts".split())
OWNER_WORDS = frozenset("article blog bottom entry global left main page post primary reader readers right secondary site story top user".split())
#: Parts of a class or id token that name a box and not what is in it.
BOX_WORDS = frozenset("area block body box container inner outer section wrap wrapper".split())
MOST_TEXT = 0.75           # a part named as noise that holds more of the page's text is no noise
ENDS_P = BLOCKS - frozenset("html body".split())
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


NO, NAMED, SURE = 0, 1, 2
COMMENT_WORDS = frozenset("comment comments reply teaser related ad ads advert".split())


def _named(found: dict[str, str], words: frozenset[str]) -> bool:
    """Whether a class or id token says one of the words, alone, first or last: ``ad-box``, ``comment-list`` and
    ``post-comments`` do, ``has-sidebar`` and ``entry-header`` do not."""
    for token in f"{found.get('class', '')} {found.get('id', '')}".split():
        said = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower()) if w and w not in BOX_WORDS]
        if said and (words.issuperset(said)
                     or said[0] in HEAD_WORDS & words and (PART_WORDS | words).issuperset(said[1:])
                     or said[-1] in TAIL_WORDS & words and OWNER_WORDS.issuperset(said[:-1])):
            return True
    return False


def _is_noise(name: str, tag: str, in_article: bool) -> int:
    """SURE by element, role or hiding; NAMED by a class or id token only, which may be mistaken."""
    if name in ("html", "body", "main"):
        return NO
    if name in DROPPED:
        return NO if name == "header" and in_article else SURE
    if "=" not in tag and "hidden" not in tag:
        return NO
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(tag)}
    if found.get("role", "").lower() in NOISE_ROLES or found.get("aria-hidden", "").lower() == "true":
        return SURE
    if re.search(r"\shidden(?=[\s>/=])", ATTRIBUTE.sub("", tag)) or re.search(r"display\s*:\s*none", found.get("style", "")):
        return SURE
    role = found.get("role", "").lower()
    if role == "main":
        return NO
    return NAMED if _named(found, COMMENT_WORDS if "article" in (name, role) else NOISE_WORDS) else NO


def lines_of(page: str | None) -> list[tuple[str, int]]:
    """(line, kind) of a page in order; kind: NOISE by element, ARTICLE inside an explicit article, FREE.

    A part that only its class or id names as noise is none if it holds an article, or most of the text of a page
    (or of the explicit article that it lies in) with no explicit article elsewhere."""
    out: list[tuple[str, bool, bool, tuple[int, ...]]] = []
    open_tags: list[tuple[str, bool, bool, tuple[int, ...]]] = []   # name, noise, article, named parts: each with its parents'
    named, held = 0, set()                            # parts named as noise so far; those that hold an article
    parts: list[str] = []
    raw_until = None

    def state() -> tuple[bool, bool, tuple[int, ...]]:
        return open_tags[-1][1:] if open_tags else (False, False, ())

    def flush() -> None:
        if parts:
            line = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if line:
                out.append((line, *state()))

    for m in TOKEN.finditer(page or ""):
        token = m.group()
        if token[0] != "<" or len(token) == 1:
            if raw_until is None:
                parts.append(token)
            continue
        if raw_until is not None:
            if token[:2] == "</" and (n := NAME.match(token)) and n.group(1).lower() == raw_until:
                raw_until = None
            continue
        if token.startswith("<![CDATA["):
            parts.append(html.escape(token[9:-3], quote=False))
            continue
        n = NAME.match(token)
        if n is None:
            continue
        name = n.group(1).lower()
        if token[1] == "/":
            at = next((k for k in range(len(open_tags) - 1, -1, -1) if open_tags[k][0] == name), None)
            if name in BLOCKS:
                flush()
            if at is not None:
                if any(t[0] in BLOCKS for t in open_tags[at:]) or open_tags[at][1::2] != (open_tags[at - 1][1::2] if at else (False, ())):
                    flush()
                del open_tags[at:]
            continue
        if name in RAW:
            if not token.endswith("/>"):
                raw_until = name
            continue
        if name in ("br", "wbr"):
            if name == "br":
                parts.append(" ")
            continue
        if name in BLOCKS:
            flush()
        if name in VOID:
            continue
        if name == "body":
            open_tags[:] = [t for t in open_tags if t[0] == "html"]
        if name in ENDS_P and (at := next((k for k in range(len(open_tags) - 1, -1, -1) if open_tags[k][0] == "p"), None)) is not None \
                and not any(t[0] in BLOCKS for t in open_tags[at + 1:]):
            del open_tags[at:]
        if name in SAME_ENDS:
            at = next((k for k in range(len(open_tags) - 1, -1, -1) if open_tags[k][0] in SAME_ENDS[name] | {"ul", "ol", "dl", "table"}), None)
            if at is not None and open_tags[at][0] in SAME_ENDS[name]:
                del open_tags[at:]
        if token.endswith("/>") and name not in BLOCKS:
            continue
        noise, article, within = state()
        kind = NO if noise else _is_noise(name, token, article)
        if kind != NO:
            flush()
        if kind == NAMED:
            within, named = (*within, named), named + 1
        noise = noise or kind == SURE
        own_article = not noise and kind == NO and (name in ("article", "main") or bool(re.search(r"\brole\s*=\s*[\"']?(?:main|article)\b", token)))
        if own_article:
            held.update(within)
        open_tags.append((name, noise, article or own_article, within))
    flush()
    size, total, inside, articles = [0] * named, 0, [False] * named, False
    for line, noise, article, within in out:
        if not noise:
            total += len(line)
            articles = articles or article
            for k in within:
                size[k] += len(line)
                inside[k] = inside[k] or article
    gone = {k for k in range(named) if k not in held and (size[k] <= MOST_TEXT * total or articles and not inside[k])}
    return [(line, NOISE if noise or not gone.isdisjoint(within) else ARTICLE if article else FREE) for line, noise, article, within in out]


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of one longest common subsequence of two lists of line hashes."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    where: dict[int, list[int]] = {}
    for j in range(len(b) - tail - 1, head - 1, -1):
        where.setdefault(b[j], []).append(j)
    tops: list[int] = []                              # smallest end of a common subsequence of each length
    links: list[tuple[int, tuple | None]] = []
    for i in range(head, len(a) - tail):
        for j in where.get(a[i], ()):
            k = bisect_left(tops, j)
            link = (i, links[k - 1] if k else None)
            if k == len(tops):
                tops.append(j)
                links.append(link)
            else:
                tops[k], links[k] = j, link
    middle, at = [], links[-1] if links else None
    while at:
        middle.append(at[0])
        at = at[1]
    return [*range(head), *reversed(middle), *range(len(a) - tail, len(a))]


def edges(places: list[int], shared: set[int]) -> set[int]:
    """The shared places before the first and after the last one that is not shared."""
    own = [i for i, place in enumerate(places) if place not in shared]
    return set(places[:own[0]] + places[own[-1] + 1:]) if own else set(places)


def article_of(own: tuple, neighbours: list[tuple]) -> str:
    """own: (hashes, kinds, texts of the lines that are not noise); neighbours: (hashes, kinds, ...) of the same
    host, of which those of the same text are passed over."""
    hashes, kinds, texts = own
    kept = [i for i, kind in enumerate(kinds) if kind != NOISE]
    lines, text_at = [hashes[i] for i in kept], dict(enumerate(texts))
    free = {j for j, i in enumerate(kept) if kinds[i] == FREE}
    guard = set(text_at) - free or free
    weigh = lambda some: sum(len(text_at[j]) for j in some)
    most, all_shared, gone = weigh(guard), [], set()
    for other in neighbours:
        text_lines = [h for h, kind in zip(other[0], other[1]) if kind != NOISE]
        if text_lines == lines:
            continue
        shared = set(shared_lines(lines, text_lines))     # a menu's line that an article repeats stays in the article
        all_shared.append(shared)
        if free and weigh(shared & guard) <= COPY_SHARE * most:
            gone |= free.intersection(shared_lines(lines, other[0]))
    if len(all_shared) > 1:
        shared = set.intersection(*all_shared)
        if weigh(shared & guard) <= (TEMPLATE_SHARE if guard == free else COPY_SHARE) * most:
            gone |= shared if guard == free else (shared & free) | edges(sorted(guard), shared)
    return "\n".join(text for j, text in text_at.items() if j not in gone)


def sort_key(page_id: int | None, url: str | None) -> str:
    """Host and path in URL-key order, then page_id (none first)."""
    host, _, path = url_key(url).partition(")")
    return f"{host}\0{path}\0" + ("" if page_id is None else f"{page_id + (1 << 63):020d}")


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _print_of(key: str, lines: list[tuple[str, int]]) -> int:
    """Equal for pages of one host and one text."""
    return _hash("\n".join([key.split("\0", 1)[0], *(line for line, kind in lines if kind != NOISE)]))


def _prints(batches: Iterator[pa.RecordBatch], bounds: list) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for page_id, url, page in zip(*(c.to_pylist() for c in batch.columns)):
            key = sort_key(page_id, url)
            rows.append((bisect_right(bounds, key), key, _print_of(key, lines_of(page))))
        kinds = (pa.int32(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 3, kinds)], names=["range", "key", "print"])


def guests(pages: DataFrame, bounds: list) -> Ranges:
    """Ranges whose guests are the nearest page before the first and after the last own page of another text (or
    host): a run of equal texts, which may fill many ranges, is passed over. Four keys a range come to the driver."""
    seen = pages.mapInArrow(lambda it: _prints(it, bounds), "range int, key string, print long")
    seen = cut_lineage(seen.groupBy("range", "print").agg(F.min("key").alias("first"), F.max("key").alias("last")))

    def ends(rows: DataFrame) -> dict[int, tuple]:
        return {r[0]: (tuple(r[1]), tuple(r[2])) for r in rows.groupBy("range").agg(F.min(F.struct("first", "print")), F.max(F.struct("last", "print"))).collect()}

    outer = ends(seen)
    if not outer:
        return Ranges(bounds, {})
    edge = seen.sparkSession.createDataFrame([(r, a[1], z[1]) for r, (a, z) in outer.items()], "range int, a long, z long")
    rest = seen.join(F.broadcast(edge), "range")                      # one row a range
    after_a, before_z = ends(rest.where("print <> a")), ends(rest.where("print <> z"))
    order, seats = sorted(outer), {}
    for i, r in enumerate(order):
        for seat, end, inner, way in ((BEFORE, 1, before_z, reversed(order[:i])), (AFTER, 0, after_a, order[i + 1:])):
            own = outer[r][1 - end][1]
            for other in way:
                near = outer[other][end] if outer[other][end][1] != own else inner[other][end] if other in inner else None
                if near:
                    seats.setdefault(near[0], []).append((r, seat))
                    break
    return Ranges(bounds, seats)


def _parse(batches: Iterator[pa.RecordBatch], ranges: Ranges) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for page_id, url, page in zip(*(c.to_pylist() for c in batch.columns)):
            lines, key = lines_of(page), sort_key(page_id, url)
            hashes, own = [_hash(line) for line, _ in lines], _print_of(key, lines)
            kinds, texts = [k for _, k in lines], [line for line, k in lines if k != NOISE]
            for r, seat in ranges.places(key):
                rows.append((r, key, seat, page_id, url, hashes, bytes(kinds), texts if seat == OWN else [], own))
        kinds = (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string()), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 9, kinds)],
                                         names=["range", "key", "seat", "page_id", "url", "hashes", "kinds", "texts", "print"])


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (range, key, seat, print): each run of own pages of one text is settled once the row after it is known."""
    before, last, run, forms, done = None, None, [], {}, []

    def out() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done) if done else [[]] * 4, kinds)], names=["page_id", "url", "text", "n_chars"])
        done.clear()
        return batch

    def settle(after) -> Iterator[pa.RecordBatch]:
        host = last[1].split("\0", 1)[0]
        near = [x[5:8] for x in (before, after) if x is not None and x[0] == last[0] and x[1].split("\0", 1)[0] == host]
        text_of = {kinds: article_of((row[5], list(row[6]), row[7]), near) for kinds, row in forms.items()}
        for page_id, url, kinds in run:
            done.append((page_id, url, text_of[kinds], len(text_of[kinds])))
            if len(done) >= 1_000:
                yield out()
        run.clear()
        forms.clear()

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if last is not None and (row[0], row[8]) != (last[0], last[8]):
                yield from settle(row)
                before = last
            last = row
            if row[2] == OWN:
                kinds = row[6].replace(bytes([NOISE]), b"")      # equal texts can stand in unequal elements
                forms.setdefault(kinds, row)
                run.append((row[3], row[4], kinds))
    if last is not None:
        yield from settle(None)
    yield out()


def main_text(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars: one row per input row, whole pages.

    A null or empty html gives an empty text; a null url is a URL of no host, and pages without host are
    neighbours like any; rows without page_id come first among equal URLs; repeated rows, and pages of equal
    text, are passed over when a page's neighbours are looked for; an empty table gives no rows. Markup that
    is cut off or unclosed ends with its parent element or with the page.
    """
    pages = columns(pages, page_id="long", url="string", html="string")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(map(sort_key, *(c.to_pylist() for c in batch.columns)), pa.string())], names=["key"])

    ranges = guests(pages, ranges_of(pages.select("page_id", "url").mapInArrow(keys, "key string"), F.col("key")).bounds)
    parsed = pages.mapInArrow(lambda it: _parse(it, ranges), "range int, key string, seat int, page_id long, url string, "
                              "hashes array<long>, kinds binary, texts array<string>, print long")
    placed = parsed.repartition(shuffle_width(pages), "range").sortWithinPartitions("range", "key", "seat", "print")
    return placed.mapInArrow(_difference, "page_id long, url string, text string, n_chars long")
