"""HTML extraction by wrappers: union-free regular expressions that the pages of a host share.

A page is a stream of tags and text. Words of classes and texts that many pages of a host share are found first; the rest
of classes is dropped from the stream, so that a wrapper grows with the longest page and not with their number. Runs of the
same piece fold into repeated groups. Forms of a host are then aligned one after the other: what only one side has becomes
optional, a piece that the other side repeats joins the repeated group, and text stays template text only while all forms
agree on it, else it is a slot. Parts of a host are aligned first and their wrappers after that, in rounds, so no task
gathers a host. In the wrapper every slot gets a role, content or something else, from what the host's pages have in
common: template text, lists of nothing but links, and elements that HTML or their classes name as menus, notices and the
like aren't content. Each page is read by aligning it with its host's wrapper; only that decides what is its text.
"""

from __future__ import annotations

import functools
import html
import json
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampliref.llm.common import map_arrow, materialize

# Elements of HTML by what they hold.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp plaintext".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul video audio".split())
SKIPPED = frozenset("head nav header footer aside form button input select option label textarea fieldset script style noscript template iframe svg math canvas object applet menu dialog title".split())
# Words of a class, id or role that name something else than the article, and words that may stand beside them.
NOTICE = frozenset("ad ads advert adverts advertising advertisement advertisements adsense adsbygoogle banner sponsor sponsored sponsors promo promos promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars complementary masthead footer contentinfo cookie cookies consent gdpr notice notices popup modal overlay dialog alert newsletter subscribe subscription signup signin login search share sharing sharebar social related recommended recommendations comment comments reply replies respond disqus discussion pagination pager copyright widget widgets toolbar skip".split())
BESIDE = frozenset("site page main top bottom left right global primary secondary box bar slot unit list area section sections wrapper wrap container block inner outer form link links button buttons icon icons item header head body text title content post posts article articles story stories user users reader readers the wp js us me follow buttons".split())
#: Elements that a class names the head of the page, not of the article.
HEADERS = frozenset({"header", "site-header", "page-header", "main-header", "top-header", "global-header"})
CLOSES = {"p": BLOCK - {"br", "hr"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "tbody"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "option": frozenset({"option"})}
#: Elements whose end an unclosed inline or paragraph element doesn't outlive.
SECTION = BLOCK - {"p", "br", "hr"}

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+|[^\sA-Za-z0-9_-]+")

#: Share of a host's different pages, and least number of them, from which a class word or a text is common to the host.
SHARE, LEAST_PAGES = 0.2, 3
#: Forms of a host that one task aligns, and wrappers of its parts that one task aligns after that.
PART_FORMS, PART_WRAPPERS = 500, 16
#: Tokens that a piece of a repeated group has at most when pages are folded.
PIECE = 8
#: Characters of all hosts' wrappers up to which they are broadcast.
BROADCAST_CHARS = 32 << 20


def tokens(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(kind, name, value, class): "open" with the element's class, id and role and the class alone, "close", or "text" with undecoded text. Raw elements' contents are left out."""
    at = 0
    end = len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            yield "text", "", page[at:], ""
            return
        if m.start() > at:
            yield "text", "", page[at : m.start()], ""
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                yield "text", "", m[0][9:].removesuffix("]]>"), ""
            continue
        name = m[2].lower()
        if m[1]:
            yield "close", name, "", ""
            continue
        attrs = [(k.lower(), a or b or c) for k, a, b, c in _ATTR.findall(m[3])] if m[3] else []
        hidden = " hidden" if any(k == "hidden" for k, _ in attrs) else ""
        yield "open", name, " ".join(v for k, v in attrs if k != "hidden") + hidden, " ".join(v for k, v in attrs if k == "class")
        if name in RAW and not m[3].endswith("/"):
            close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|$)", re.I).search(page, at)
            yield "close", name, "", ""
            at = close.end() if close else end


@functools.lru_cache(10_000)
def notice(words: str) -> bool:
    """Whether one of the words, whole, names a menu, notice, advert, comment or the like; "side-effects" doesn't."""
    for word in words.split():
        parts = [p.lower() for p in _WORD.findall(word)]
        if word.lower() in HEADERS or (any(p in NOTICE for p in parts) and all(p in NOTICE or p in BESIDE or p.isdigit() or len(p) == 1 for p in parts)):
            return True
    return False


def _mark(kind: str, value: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest((kind + value).encode("utf-8", "surrogatepass")) - (1 << 63)


def label(name: str, words: str, classes: str, common: frozenset[int]) -> str:
    """An element in a path: its name, "!" if it isn't part of an article, and those of its class words that the host's pages share."""
    if name in SKIPPED or words.endswith(" hidden") or (words and name not in ("html", "body") and notice(words)):
        return name + "!"
    if not classes:
        return name
    return ".".join([name, *sorted(w.translate(_PLAIN) for w in set(classes.split()) if _mark("c", w) in common)])


#: Characters with a meaning in tokens.
_PLAIN = str.maketrans(" ()#?+/.!", "_________")


def walk(page: str, common: frozenset[int]) -> Iterator[tuple[str, str, str]]:
    """(token, path, text): the token stream, with the labels of open elements, joined; token is "#" for text."""
    stack: list[tuple[str, str]] = []  # name, path inside it
    for kind, name, value, classes in tokens(page):
        if kind == "text":
            yield "#", stack[-1][1] if stack else "", value
        elif kind == "open":
            while stack and (name in CLOSES.get(stack[-1][0], ()) or (name in SECTION and stack[-1][0] not in BLOCK)):
                yield "/" + stack.pop()[0], "", ""
            # a block also ends a paragraph in which inline elements were left open
            if name in BLOCK and name != "br" and stack and stack[-1][0] not in SECTION:
                names = [n for n, _ in stack]
                inner = next((i for i in range(len(names) - 1, -1, -1) if names[i] == "p" or names[i] in SECTION), 0)
                if names[inner] == "p":
                    while len(stack) > inner:
                        yield "/" + stack.pop()[0], "", ""
            own = label(name, value, classes, common)
            yield own, "", ""
            if name not in VOID and name not in RAW:
                above = stack[-1][1] if stack else ""
                # an element right inside its like adds nothing to a path
                stack.append((name, above if above.rsplit(" ", 1)[-1] == own else f"{above} {own}".lstrip()))
        elif any(n == name for n, _ in stack):
            while stack:
                n, _ = stack.pop()
                yield "/" + n, "", ""
                if n == name:
                    break


class Node:
    """A piece of a form or wrapper: its token, whether it may be missing, and for each text slot in it the mark of its
    template text (0: none) and, in a page, the numbers of its texts."""

    __slots__ = ("token", "optional", "fixed", "texts")

    def __init__(self, token: str, optional: bool = False, fixed: list[int] | None = None, texts: list[list[int]] | None = None) -> None:
        self.token, self.optional, self.fixed, self.texts = token, optional, fixed or [], texts or []


@functools.lru_cache(50_000)
def body(token: str) -> tuple[str, ...]:
    """The pieces of a repeated group "(a b)+"."""
    out, depth, start, inner = [], 0, 0, token[1:-2] + " "
    for i, c in enumerate(inner):
        depth += (c == "(") - (c == ")")
        if c == " " and not depth:
            out.append(inner[start:i])
            start = i + 1
    return tuple(out)


def group(nodes: list[Node]) -> Node:
    """A repeated group of nodes; template text isn't known in one."""
    slots = [t for n in nodes for t in n.texts]
    return Node(f"({' '.join(n.token for n in nodes)})+", all(n.optional for n in nodes), [0 for n in nodes for _ in n.fixed], slots)


def _join(into: Node, nodes: list[Node]) -> None:
    for have, more in zip(into.texts, (t for n in nodes for t in n.texts)):
        have += more
    into.optional &= all(n.optional for n in nodes)


def fold(stream: list[Node]) -> list[Node]:
    """Repeated pieces of up to PIECE nodes become one group "(a b)+"; groups may hold groups."""
    out: list[Node] = []
    names: list[str] = []
    for node in stream:
        out.append(node)
        names.append(node.token)
        for n in range(1, min(PIECE, len(out) - 1) + 1):
            before = names[-n - 1]
            if before[0] == "(" and body(before) == tuple(names[-n:]):
                _join(out[-n - 1], out[-n:])
                del out[-n:], names[-n:]
                break
            if before == node.token and n * 2 <= len(out) and names[-2 * n : -n] == names[-n:] and (n > 1 or node.token[0] != "("):
                whole = group(out[-2 * n : -n])
                _join(whole, out[-n:])
                out[-2 * n :] = [whole]
                names[-2 * n :] = [whole.token]
                break
    return out


def place(path: str) -> str:
    return f"{_mark('p', path) & 0xFFFFFFFFFF:010x}"


def form(page: str, common: frozenset[int]) -> tuple[list[Node], dict[str, str], list[tuple[int, str]]]:
    """A page's folded token stream, the paths of its slots by place, and its items: texts (number, text) and ends of blocks (-1, "")."""
    stream: list[Node] = []
    paths: dict[str, str] = {}
    items: list[tuple[int, str]] = []
    n = 0
    for token, path, text in walk(page, common):
        if token != "#":
            stream.append(Node(token))
            if token.lstrip("/").split(".")[0].rstrip("!") in BLOCK:
                items.append((-1, ""))
            continue
        if not text.strip():
            items.append((-2, text))
            continue
        at = place(path)
        paths[at] = path
        items.append((n, text))
        if stream and stream[-1].token == "#" + at:
            stream[-1].texts[0].append(n)
            stream[-1].fixed[0] = 0
        else:
            mark = _mark("t", text.strip())
            stream.append(Node("#" + at, False, [mark if mark in common else 0], [[n]]))
        n += 1
    return fold(stream), paths, items


def _groups(nodes: list[Node]) -> dict[str, list[tuple[str, ...]]]:
    """Bodies of all repeated groups, also those within groups, by their first token; inner ones come first."""
    found: dict[str, None] = {}

    def visit(token: str) -> None:
        if token[0] == "(" and token not in found:
            for inner in body(token):
                visit(inner)
            found[token] = None

    for n in nodes:
        visit(n.token)
    out: dict[str, list[tuple[str, ...]]] = defaultdict(list)
    for token in found:
        out[body(token)[0]].append(body(token))
    return out


def absorb(nodes: list[Node], groups: dict[str, list[tuple[str, ...]]]) -> list[Node]:
    """Nodes in which pieces that stand once are written as the groups that repeat them elsewhere."""
    if not groups:
        return nodes
    names, changed = [n.token for n in nodes], True
    while changed:
        changed, i, out = False, 0, []
        while i < len(nodes):
            for piece in groups.get(names[i], ()):
                part = nodes[i : i + len(piece)]
                if tuple(names[i : i + len(piece)]) == piece and len({n.optional for n in part}) == 1:
                    out.append(group(part))
                    i += len(piece)
                    changed = True
                    break
            else:
                out.append(nodes[i])
                i += 1
        nodes = fold(out) if changed else nodes
        names = [n.token for n in nodes]
    return nodes


def matched(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places with equal tokens, in order. At a mismatch the side whose token comes again sooner on the other one skips less."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-tail - 1] == b[-tail - 1]:
        tail += 1
    out = [(k, k) for k in range(head)]
    stop_a, stop_b = len(a) - tail, len(b) - tail
    where: tuple[dict, dict] = (defaultdict(list), defaultdict(list))
    for side, seq, stop in ((0, a, stop_a), (1, b, stop_b)):
        for k in range(head, stop):
            where[side][seq[k]].append(k)
    i = j = head
    while i < stop_a and j < stop_b:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
            continue
        in_b, in_a = where[1].get(a[i], ()), where[0].get(b[j], ())
        nb, na = bisect_left(in_b, j), bisect_left(in_a, i)
        skip_b = in_b[nb] - j if nb < len(in_b) else None
        skip_a = in_a[na] - i if na < len(in_a) else None
        if skip_b is None and skip_a is None:
            i, j = i + 1, j + 1
        elif skip_a is None or (skip_b is not None and skip_b <= skip_a):
            j += skip_b
        else:
            i += skip_a
    return out + [(stop_a + k, stop_b + k) for k in range(tail)]


def align(wrapper: list[Node], other: list[Node]) -> list[Node]:
    """One wrapper for both: equal tokens stay, with template text that both have; nodes of one side become optional."""
    wrapper, other = absorb(wrapper, _groups(other)), absorb(other, _groups(wrapper))
    out: list[Node] = []

    def add(node: Node) -> None:
        if out and node.token[0] == "(" and out[-1].token == node.token:
            out[-1].optional &= node.optional  # a group of as many more
        else:
            out.append(node)

    i = j = 0
    for a, b in [*matched([n.token for n in wrapper], [n.token for n in other]), (len(wrapper), len(other))]:
        for n in wrapper[i:a] + other[j:b]:
            add(Node(n.token, True, n.fixed, n.texts))
        if a < len(wrapper):
            x, y = wrapper[a], other[b]
            add(Node(x.token, x.optional or y.optional, [p if p == q else 0 for p, q in zip(x.fixed, y.fixed)], x.texts))
        i, j = a + 1, b + 1
    return out


def dump(nodes: list[Node], paths: dict[str, str]) -> str:
    return json.dumps([[[n.token, int(n.optional), n.fixed] for n in nodes], paths], separators=(",", ":"), sort_keys=True)


def load(form_: str) -> tuple[list[Node], dict[str, str]]:
    nodes, paths = json.loads(form_)
    return [Node(t, bool(o), f, [[] for _ in f]) for t, o, f in nodes], paths


_SLOT = re.compile("#([0-9a-f]{10})")


def roles(wrapper: list[Node], paths: dict[str, str]) -> list[list[bool]]:
    """For each node, for each text slot in it: content or not.

    Not content: what an element's name or class says; template text, that is the same in all pages which have the node;
    blocks outside of articles whose slots are all links. Where a wrapper has articles or a main part, content stands in
    them. A host whose pages have nothing left so is read without the rule of links, then without that of template text.
    """
    slots = [(i, k, paths[at]) for i, n in enumerate(wrapper) for k, at in enumerate(_SLOT.findall(n.token))]
    clean = [(i, k, p) for i, k, p in slots if "!" not in p]
    named = lambda p: [x.split(".")[0] for x in p.split(" ")]
    for part in ("article", "main"):
        inside = [s for s in clean if part in named(s[2])]
        if inside:
            clean = inside
            break
    else:
        part = ""
    chosen = clean
    texts = [(i, k, p) for i, k, p in clean if not wrapper[i].fixed[k]]
    if not part:
        # the innermost block around a slot
        around = lambda p: " ".join(p.split(" ")[: max((d + 1 for d, x in enumerate(named(p)) if x in BLOCK), default=0)])
        plain = Counter(around(p) for i, k, p in texts if "a" not in named(p)[len(around(p).split(" ")) if around(p) else 0 :])
        chosen = [s for s in texts if plain[around(s[2])]]
    else:
        chosen = texts
    chosen = set((i, k) for i, k, _ in (chosen or texts or clean))
    return [[(i, k) in chosen for k in range(len(n.fixed))] for i, n in enumerate(wrapper)]


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def commons(pages: DataFrame) -> DataFrame:
    """(_host, common): marks of the class words and texts that at least SHARE of a host's different pages have, sorted.

    So their number is at most the mean number of marks of a page over SHARE, whatever the host's size.
    """

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, digests, found = [], [], []
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {0}  # stands for the page
                for kind, _, value, classes in tokens(page or ""):
                    if kind == "text" and value.strip():
                        own.add(_mark("t", value.strip()))
                    elif classes:
                        own.update(_mark("c", w) for w in classes.split())
                hosts += [name] * len(own)
                digests += [_mark("d", page or "")] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(digests, pa.int64()), pa.array(found, pa.int64())], names=["host", "digest", "mark"])

    found = map_arrow(pages.select("host", F.col("html").alias("text")), marks, "host string, digest long, mark long")
    counts = materialize(found.groupBy("host", "mark").agg(F.count_distinct("digest").alias("n")).where(F.col("n") >= LEAST_PAGES), "wrapper-marks")
    whole = counts.where("mark = 0").select(F.col("host").alias("_host"), F.col("n").alias("pages"))
    often = counts.where("mark != 0").join(whole, F.col("host") == F.col("_host")).where(F.col("n") >= SHARE * F.col("pages"))
    return often.groupBy("_host").agg(F.array_sort(F.collect_list("mark")).alias("common"))


def _with(rows: DataFrame, known: DataFrame, chars: Column) -> DataFrame:
    """rows with their host's row of known, which is broadcast if its measured size allows."""
    total = known.agg(F.sum(chars)).first()[0] or 0
    return rows.join(F.broadcast(known) if total <= BROADCAST_CHARS else known, F.col("host") == F.col("_host"), "left").drop("_host")


def infer(pages: DataFrame) -> DataFrame:
    """(_host, wrapper): from (host, html, common) a wrapper for each host, as JSON."""

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for name, page, common in zip(*(c.to_pylist() for c in batch.columns)):
                nodes, paths, _ = form(page or "", frozenset(common or ()))
                seen[name, dump(nodes, paths)] += 1
            rows = list(seen.items())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["host", "form", "pages"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by host and part: aligns each part's forms in order."""
        key, wrapper, paths, pages = None, [], {}, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([dump(wrapper, paths)], pa.string()), pa.array([pages], pa.int64())], names=["host", "form", "pages"])

        for batch in batches:
            for name, part, form_, n in zip(*(c.to_pylist() for c in batch.columns)):
                mine, own = load(form_)
                if (name, part) != key:
                    if key is not None:
                        yield out()
                    key, wrapper, paths, pages = (name, part), mine, own, n
                    continue
                wrapper = align(wrapper, mine)
                paths.update(own)
                pages += n
        if key is not None:
            yield out()

    schema = "host string, form string, pages long"
    made = map_arrow(pages.select("host", F.col("html").alias("text"), "common"), forms, schema)
    made = materialize(made.groupBy("host", "form").agg(F.sum("pages").alias("pages")), "wrapper-forms")
    size = PART_FORMS
    while True:
        # a host has as many parts as its forms need; rounds go on until it has one
        parts = made.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts")).select(F.col("host").alias("_host"), "parts")
        dealt = _with(made, parts, F.length("_host") + 8).withColumn("part", F.pmod(F.xxhash64("form"), F.col("parts")).cast("int"))
        dealt = dealt.select("host", "part", "form", "pages").repartition("host", "part").sortWithinPartitions("host", "part", F.col("pages").desc(), "form")
        made = materialize(dealt.mapInArrow(merged, schema), "wrapper-parts")
        size = PART_WRAPPERS
        if parts.where("parts > 1").isEmpty():
            return made.select(F.col("host").alias("_host"), F.col("form").alias("wrapper"))


def clean(text: str) -> str:
    return " ".join(html.unescape(text).split())


class Reader:
    """Reads pages of a host by its wrapper. Equal forms are aligned once."""

    def __init__(self, wrapper: str | None) -> None:
        self.nodes, paths = load(wrapper) if wrapper else ([], {})
        self.names = [n.token for n in self.nodes]
        self.groups = _groups(self.nodes)
        self.roles = roles(self.nodes, paths)
        self.places: dict[str, bool] = {}
        for node, own in zip(self.nodes, self.roles):
            for at, content in zip(_SLOT.findall(node.token), own):
                self.places[at] = self.places.get(at, False) or content
        self.seen: dict[tuple[str, ...], list[int]] = {}

    def read(self, page: str, common: frozenset[int]) -> str:
        """The text of content slots in page order: blocks trimmed, white space single, joined by one space."""
        nodes, _, items = form(page, common)
        nodes = absorb(nodes, self.groups)
        names = tuple(n.token for n in nodes)
        if names not in self.seen:
            if len(self.seen) >= 500:
                self.seen.clear()
            at = [-1] * len(names)
            for a, b in matched(self.names, list(names)):
                at[b] = a
            self.seen[names] = at
        kept: set[int] = set()
        for node, at in zip(nodes, self.seen[names]):
            # a node that alignment leaves over goes by the slots of its places
            own = self.roles[at] if at >= 0 else [self.places.get(p, False) for p in _SLOT.findall(node.token)] if node.texts else []
            for texts, content in zip(node.texts, own):
                if content:
                    kept.update(texts)
        blocks: list[str] = []
        run: list[str] = []
        for n, text in items:
            if n == -1:
                blocks.append("".join(run))
                run = []
            elif n in kept or (n == -2 and run):
                run.append(text)
        blocks.append("".join(run))
        return " ".join(b for b in map(clean, blocks) if b)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points), host.

    Null or empty html gives ''. Pages without a host share the empty one. Repeated rows give equal results and count once
    in what a host's pages share; ties between forms are broken by their order. Other columns are ignored; an empty table
    gives no rows. Wrappers are broadcast where their measured size is at most BROADCAST_CHARS, else joined by host.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(F.col(url_col)).alias("host"))
    common = materialize(commons(rows), "wrapper-common")
    wrappers = infer(_with(rows.select("host", "html"), common, F.size("common") * 8))
    known = materialize(wrappers.join(common.withColumnRenamed("_host", "host_"), F.col("_host") == F.col("host_"), "left").drop("host_"), "wrappers")
    with_wrappers = _with(rows, known, F.length("wrapper") + F.coalesce(F.size("common"), F.lit(0)) * 8)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers: dict[str, tuple[Reader, frozenset[int]]] = {}
        for batch in batches:
            texts = []
            for page, name, wrapper, marks in zip(*(batch.column(c).to_pylist() for c in ("text", "host", "wrapper", "common"))):
                if name not in readers:
                    if len(readers) >= 200:
                        readers.clear()
                    readers[name] = Reader(wrapper), frozenset(marks or ())
                texts.append(readers[name][0].read(page or "", readers[name][1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), batch.column(3)], names=["page_id", "url", "text", "n_chars", "host"])

    rows = with_wrappers.select("page_id", "url", F.col("html").alias("text"), "host", "wrapper", "common")
    return map_arrow(rows, kernel, "page_id long, url string, text string, n_chars long, host string")
