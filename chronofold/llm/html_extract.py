"""Main text of HTML pages: nearest-URL page differencing, with structure to protect articles.

A page is cut into lines, the text of its blocks, each with the zone it stands in:

- ``main``: inside an article or main element;
- ``chrome``: inside navigation, header, footer, sidebar, form or dialogue elements, or an element whose
  class, id or role names nothing but a menu, advert, notice, share bar or reader comments (inside an article
  too); chrome is no text;
- ``open``: anything else in the body.

Scripts, styles, markup and comments in the source are no lines. Every page with open lines is differenced: within
each host, pages are put in order of their URL paths, a page is paired with the neighbour whose path shares the
longer beginning (the earlier one on a tie), the pair's open lines are aligned by a longest common subsequence, and
shared lines are deleted. Pages that equal their neighbour line by line are copies, not a frame around two texts;
they keep their lines. Main lines are protected: pages of one site repeat whole passages of their articles, so a line
shared with a neighbour says nothing there. The main lines are the text if they are at least as long as the open
ones that are left; else (a teaser in an article element beside a story in plain blocks) both are, in page order.

Pairing is by a sort of (host, path, page), not by groups of a host, so that a host with a third of the
pages is spread over many tasks; the first and last row of each sorted part (one row per part, on the
driver) join the parts. What moves is the lines' hashes of pages that have open ones, then one join
with their marks. The alignment takes memory in proportion to the lines.

Defined results: null html has the text ''. A null URL is its own host ''. Rows that repeat a page are
reported one by one; a page is not differenced against its own repetition. Character references are
decoded (unknown ones stay), white space inside a line becomes one space. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import stored

#: Elements of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe svg object textarea select title canvas audio video annotation annotation-xml".split())
#: Of these the ones whose content is text up to their first end tag; others end where their nested ones are closed.
PLAIN = frozenset("script style iframe textarea title".split())
MAIN = frozenset(("article", "main"))
CHROME = frozenset("nav header footer aside form dialog menu button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math semantics mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mspace".split())
#: Elements that a further one of the same kind closes where no end tag stands.
CLOSED_BY_NEXT = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "option": frozenset(("option",))}
#: Words that name page furniture in class, id or role, words that stand beside them in such names, and words that deny them.
FURNITURE = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies disqus menu modal nav navbar navigation newsletter notice notification pagination popup promo promoted related reply respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
BESIDE = frozenset("app area articles bar block blog body bottom box btn button buttons center col column container content dialog footer form global group header icon icons inner item items left level link links list main media mobile nest overlay page panel placeholder post posts primary region right row secondary section site slot small stories sub text thread to toggle top trail unit wrap wrapper".split())
DENIES = frozenset("has hide hidden is layout no non not with without".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"\shidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


def _names_furniture(name: str) -> bool:
    """Whether a class, id or role says nothing but furniture: sidebar-left does; has-sidebar and related-work do not."""
    # numbers and sizes (ad-300x250) say nothing
    words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w.isalpha()]
    return any(w in FURNITURE for w in words) and all(w in FURNITURE or w in BESIDE for w in words) and not DENIES.intersection(words)


def _furniture(attributes: str) -> bool:
    if not attributes or attributes.isspace():
        return False
    for m in NAMED.finditer(attributes):
        if any(_names_furniture(name) for name in (m[1] or m[2] or m[3] or "").split()):
            return True
    return bool(HIDDEN.search(attributes))


def _skipped(page: str, at: int, name: str) -> int:
    """Where the element ends whose start tag ends here: at its end tag, after those of the like elements in it."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])[^>]*>", re.I).finditer(page, at):
        if m[1]:
            depth -= 1
        elif name not in PLAIN and not m[0].endswith("/>"):
            depth += 1
        if not depth or name in PLAIN and m[1]:
            return m.end()
    return len(page)


def lines(page: str | None) -> list[tuple[str, str]]:
    """(zone, text) of each block of the page, in order."""
    page = page or ""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # (element, zone inside it)
    text: list[str] = []

    def flush() -> None:
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            if line:
                out.append((stack[-1][1] if stack else "open", line))
            text.clear()

    def close(to: int) -> None:
        if any(name not in INLINE for name, _ in stack[to:]) or any(zone != (stack[to - 1][1] if to else "open") for _, zone in stack[to:]):
            flush()
        del stack[to:]

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
                if stack[i][0] in MAIN | CHROME and name not in MAIN | CHROME | {"body", "html"}:
                    break  # a stray end tag does not close what stands around
            continue
        if name in VOID:
            text.append(" ")
            continue
        if name in RAW:
            if not m[0].endswith("/>"):
                at = _skipped(page, at, name)
            continue
        for i in range(len(stack) - 1, -1, -1):
            if name in CLOSED_BY_NEXT.get(stack[i][0], ()):
                close(i)
                break
            if stack[i][0] not in INLINE:
                break
        if name not in INLINE:
            flush()
        zone = stack[-1][1] if stack else "open"
        furniture = name not in ("html", "body") and (name in CHROME and not (name == "header" and zone == "main") or _furniture(m[3]))
        inside = "chrome" if zone == "chrome" or furniture else "main" if name in MAIN else zone
        if inside != zone:
            flush()
        if not m[0].endswith("/>"):
            stack.append((name, inside))
    flush()
    return out


#: Cells of an alignment's table; longer pages are halved until their parts fit.
CELLS = 1 << 20


def _reached(x: list[int], y: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of x and each beginning of y, by one bit for each place of y."""
    places: dict[int, list[int]] = {}
    for j, c in enumerate(y):
        places.setdefault(c, []).append(j)
    masks: dict[int, int] = {}
    whole = (1 << len(y)) - 1
    steps = whole
    for c in x:
        if c not in places:
            continue
        mask = masks.get(c)
        if mask is None:
            mask = sum(1 << j for j in places[c]) if len(places[c]) < 64 else int.from_bytes(np.packbits(np.isin(np.arange(len(y)), places[c]), bitorder="little").tobytes(), "little")
            if len(places[c]) >= 64:  # few lines are that common: what is kept stays in proportion to the lines
                masks[c] = mask
        both = steps & mask
        steps = (steps + both | steps - both) & whole
    bits = np.unpackbits(np.frombuffer(steps.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _aligned(x: np.ndarray, y: np.ndarray, at: int = 0) -> list[int]:
    """Places (from at) of x's lines in a longest common subsequence with y."""
    if not len(x) or not len(y):
        return []
    if (len(x) + 1) * (len(y) + 1) > CELLS and len(x) > 1:
        half = len(x) // 2
        head, tail = _reached(x[:half].tolist(), y.tolist()), _reached(x[half:][::-1].tolist(), y[::-1].tolist())
        cut = int(np.argmax(head + tail[::-1]))
        return _aligned(x[:half], y[:cut], at) + _aligned(x[half:], y[cut:], at + half)
    if len(x) == 1:
        return [at] if (y == x[0]).any() else []
    table = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i in range(len(x) - 1, -1, -1):
        hit = np.where(y == x[i], table[i + 1, 1:] + 1, 0)
        table[i, :-1] = np.maximum.accumulate(np.maximum(table[i + 1, :-1], hit)[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j] and table[i, j] == table[i + 1, j + 1] + 1:
            out.append(at + i)
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def differenced(own: np.ndarray, other: np.ndarray) -> list[int]:
    """Places of own's lines in a longest common subsequence with other's, empty for two equal pages."""
    n, m = len(own), len(other)
    if n == m and (own == other).all():
        return []
    # equal beginnings and ends are part of a longest one, and lines that only one page has of none
    a = 0
    while a < min(n, m) and own[a] == other[a]:
        a += 1
    b = 0
    while b < min(n, m) - a and own[n - 1 - b] == other[m - 1 - b]:
        b += 1
    x, y = own[a : n - b], other[a : m - b]
    keep = np.isin(x, y)
    places, x = np.flatnonzero(keep) + a, x[keep]
    y = y[np.isin(y, x)]
    return [*range(a), *(int(places[i]) for i in _aligned(x, y)), *range(n - b, n)]


def split_url(url: str | None) -> tuple[str, str]:
    """Host in lower case and path (without query and fragment)."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)", url or "")
    return (m[1].lower(), m[2]) if m else ("", (url or "").split("#")[0].split("?")[0])


EXTRACTED = "uid long, page_id long, url string, host string, path string, lines array<string>, main array<boolean>, places array<int>, hashes array<long>"


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """uid, page_id, url, html -> the lines that are no chrome, which of them are main, and places and hashes of the others."""
    schema = pa.schema([("host", pa.string()), ("path", pa.string()), ("lines", pa.list_(pa.string())), ("main", pa.list_(pa.bool_())), ("places", pa.list_(pa.int32())), ("hashes", pa.list_(pa.int64()))])
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            rows = []
            for url, page in zip(part.column(2), part.column(3)):
                host, path = split_url(url.as_py())
                found = [(z == "main", t) for z, t in lines(page.as_py()) if z != "chrome"]
                places = [k for k, (main, _) in enumerate(found) if not main]
                rows.append({"host": host, "path": path, "lines": [t for _, t in found], "main": [main for main, _ in found], "places": places, "hashes": [xxhash.xxh64_intdigest(found[k][1]) - (1 << 63) for k in places]})
            own = pa.RecordBatch.from_pylist(rows, schema=schema)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *own.columns], names=["uid", "page_id", "url", *schema.names])


def _paired(before: dict[int, dict], after: dict[int, dict]):
    """Rows in order of (part, host, path) -> uid and the uid of the neighbour with the nearer path."""

    def nearest(previous: dict | None, row: dict, following: dict | None) -> int | None:
        near = [r for r in (previous, following) if r and r["host"] == row["host"] and r["uid"] != row["uid"]]
        return max(near, key=lambda r: len(commonprefix([r["path"], row["path"]])))["uid"] if near else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous, now = None, None

        def step(row: dict | None) -> tuple[int, int] | None:
            """Pair the row held, whose neighbours are known with the next one."""
            nonlocal previous, now
            done = None
            if now is not None:
                following = row if row and row["part"] == now["part"] else after.get(now["part"])
                other = nearest(previous, now, following)
                done = (now["uid"], other) if other is not None else None
            if row is not None:
                previous = now if now is not None and now["part"] == row["part"] else before.get(row["part"])
            now = row
            return done

        def out(found: list) -> pa.RecordBatch:
            found = [f for f in found if f]
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["uid", "other"])

        for batch in batches:
            yield out([step(row) for row in batch.to_pylist()])
        yield out([step(None)])

    return run


def pairs(rows: DataFrame) -> DataFrame:
    """(uid, other): each page of rows (host, path, page_id, uid) with its nearest neighbour on the host."""
    key = ["host", "path", "page_id", "uid"]
    ordered = rows.select(*key).distinct().repartitionByRange(*key).sortWithinPartitions(*key)
    ordered = stored(ordered.withColumn("part", F.spark_partition_id()), "urls")
    # one row for each sorted part reaches the driver
    ends = ordered.groupBy("part").agg(F.min(F.struct(*key)).alias("low"), F.max(F.struct(*key)).alias("high")).orderBy("part").collect()
    before = {b["part"]: a["high"].asDict() for a, b in zip(ends, ends[1:])}
    after = {a["part"]: b["low"].asDict() for a, b in zip(ends, ends[1:])}
    return ordered.repartition("part").sortWithinPartitions("part", *key).mapInArrow(_paired(before, after), "uid long, other long")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row (see the module)."""
    rows = pages.select(F.xxhash64("page_id", "url", "html").alias("uid"), F.col("page_id").cast("long").alias("page_id"), "url", "html")
    found = stored(rows.mapInArrow(_extracted, EXTRACTED), "lines")
    has_open = F.size("places") > 0
    loose = found.where(has_open)
    paired = pairs(loose).join(loose.select("uid", "hashes", "places", F.size("lines").alias("n")).dropDuplicates(["uid"]), "uid")
    paired = paired.join(loose.select(F.col("uid").alias("other"), F.col("hashes").alias("theirs")).dropDuplicates(["other"]), "other")
    marks = paired.select("uid", "hashes", "theirs", "places", "n").mapInArrow(_marked, "uid long, shared array<boolean>")
    joined = loose.select("uid", "page_id", "url", "lines", "main").join(marks.where(F.size("shared") > 0), "uid", "left")
    none = F.transform("lines", lambda _: F.lit(False))
    kept = F.filter(F.arrays_zip("lines", "main", F.coalesce("shared", none).alias("shared")), lambda x: ~x["shared"])
    text = lambda c: F.array_join(F.transform(c, lambda x: x["lines"]), " ")
    main, open_ = text(F.filter("kept", lambda x: x["main"])), text(F.filter("kept", lambda x: ~x["main"]))
    open_pages = joined.withColumn("kept", kept).select("page_id", "url", F.when((main != "") & (F.length(main) >= F.length(open_)), main).otherwise(text(F.col("kept"))).alias("text"))
    # pages without open lines are as they will be: they meet no marks and do not move
    settled = found.where(~has_open).select("page_id", "url", F.array_join("lines", " ").alias("text"))
    return settled.unionByName(open_pages).withColumn("n_chars", F.length("text").cast("long"))


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """uid, hashes of the open lines, the neighbour's, their places, lines of the page -> which of the lines are shared."""
    for batch in batches:
        out = []
        for own, theirs, places, n in zip(*(batch.column(i) for i in range(1, 5))):
            found = differenced(own.values.to_numpy(), theirs.values.to_numpy())
            shared = np.zeros(n.as_py() if found else 0, bool)
            shared[places.values.to_numpy()[found] if found else []] = True
            out.append(shared)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.bool_()))], names=["uid", "shared"])
