"""Main text of HTML pages by wrappers: union-free regular expressions inferred from pages of the same host.

A page becomes a token stream of block elements and text; inline elements belong to the text they stand in. A wrapper is a union-free
expression over such streams: each element holds an ordered sequence of parts, and a part is an element, a group of elements
in a row, optional (?), repeated (+), a text that is the same on all pages, or a text slot (#).

A host's pages are aligned with its wrapper one after another. Sequences are aligned in order: elements of one key (tag, class, id
and role; names with digits are one slot) match; at a mismatch the nearer of the two next matches decides which parts one of the
streams lacks, and these become optional; elements or rows of elements that follow themselves fold into a repeated part or
group; texts that differ become slots. Aligning two wrappers gives a wrapper, so tasks align the pages that they hold, and the
tasks' wrappers are aligned in rounds of at most FAN_IN; a host's pages never meet in one task. A sequence of over WIDTH
parts generalises to one optional repeated part for each key, then for each tag, so a wrapper stays as small as its template.

The wrapper tells what a page's text is. The main part is the article or main element (or one so named) if it holds enough of the host's
words, else the part in whose slots most of the host's varying words stand; text that stands the same on the host's pages is
boilerplate outside of article and main elements. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments are
told by their tags, roles and by names that say nothing else (related-posts). Inside the main part a name that says so only in part (share-price)
drops an element only if its text is the same on the host's pages.

Edge cases: null or empty html gives an empty text; a null or hostless URL is a host of its
own; unclosed, misnested and cut-off markup closes where HTML closes it; elements may nest to any depth; a page that fits its host's
wrapper nowhere is read by a wrapper of its own, and without a main part by its body without boilerplate; a line break (br) is
white space of its block; on a host with fewer than three pages, or whose pages are all alike, no text counts as boilerplate
for being the same; equal rows give their own rows; an empty table gives no rows; pages are read
whole; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from . import common

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+))")
SPACE = re.compile(r"[ \t\n\r\f\v]+")

RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "svg", "math", "object", "canvas", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var".split())
#: Block tags whose start closes an open paragraph, and tags that end others of their kind.
CLOSES_P = set("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}}

BOILER_TAGS = set("nav footer aside form button select menu dialog head fieldset".split()) | RAW
BOILER_NAMES = set("nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget widgets ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription comment comments commentlist disqus reply replies respond form login search share sharing social related recommended pagination pager toolbar skip".split())
#: Name parts that say nothing about what an element holds, and headers, which inside the main part are the article's.
PLAIN_NAMES = set("post posts entry entries article articles page pages site blog main content body text wrap wrapper container inner outer box block area section list lists item items link links button buttons bar panel slot unit row col column group left right top bottom first last primary secondary global local title heading label count icon icons inline fixed sticky theme module component signup".split())
HEADERS = {"header", "masthead", "head"}
MAIN_TAGS, MAIN_NAMES = {"article", "main"}, {"article", "articlebody", "content", "main", "post", "entry", "story", "maincontent", "postcontent", "entrycontent"}
BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
#: A raw element ends at its end tag only, whatever stands before it.
END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in RAW}
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
PART, DIGIT = re.compile(r"[^\W_]+"), re.compile("[0-9]")


def general(names: str) -> set[str]:
    """The words of class and id tokens; parts with digits, which name single pages or places, are all one slot (#).

    Words that tell boilerplate or main text stay beside the slot.
    """
    found = set()
    for part in PART.findall(names):
        kept = {x.lower() for x in NAME.findall(part)}
        if DIGIT.search(part):
            kept = (kept & (BOILER_NAMES | MAIN_NAMES)) | {"#"}
        found |= kept
    return found


class Node:
    """A page's element: key, parts (elements, text runs and None for a line break) in order; part: its place in the page's or host's wrapper."""

    __slots__ = ("tag", "key", "tokens", "role", "parts", "part")

    def __init__(self, tag: str, attributes: dict[str, str]):
        names = f"{attributes.get('class', '')} {attributes.get('id', '')} {attributes.get('itemprop', '')}"
        self.tag, self.role, self.part = tag, attributes.get("role", "").lower(), None
        self.tokens = [{x.lower() for x in NAME.findall(t) if not x.isdigit()} for t in names.split()] if names.strip() else ()
        self.key = " ".join([tag, *sorted(general(names)), self.role]).strip() if self.tokens or self.role else tag
        self.parts: list = []

    def boiler(self, inside_main: bool) -> int:
        """2: boilerplate by its tag, role or a name that says nothing else; 1: by part of a name; 0: not."""
        if self.tag == "header":
            return 0 if inside_main else 2
        if self.tag in BOILER_TAGS or self.role in BOILER_ROLES or any("hidden" in t for t in self.tokens):
            return 2
        if self.tag in MAIN_TAGS or self.tag in ("body", "html"):
            return 0
        telling = BOILER_NAMES - HEADERS if inside_main else BOILER_NAMES
        found = [t for t in self.tokens if t & telling]
        return 2 if any(t <= telling | PLAIN_NAMES | HEADERS for t in found) else int(bool(found))

    def main(self) -> bool:
        return self.tag in MAIN_TAGS or self.role in MAIN_TAGS or any(t & MAIN_NAMES for t in self.tokens)


def behind(page: str, tag: str, at: int) -> int:
    """The place behind the end tag of a raw element whose content starts at a place; its content isn't markup."""
    end = END[tag].search(page, at)
    return len(page) if end is None else end.end()


def parse(page: str | None) -> Node:
    """The tree of block elements; text runs are (text, is a link)."""
    root = Node("#page", {})
    stack, links = [root], 0
    page, at = page or "", 0
    while m := TOKEN.match(page, at):
        at = m.end()
        close, tag, rest = m.groups()
        if tag is None:
            text = m[0]
            if text[:2] not in ("<!", "<?"):
                stack[-1].parts.append((text, links > 0))
            elif text.startswith("<![CDATA["):
                stack[-1].parts.append((entities.escape(text[9:].removesuffix("]]>")), links > 0))
            continue
        tag = tag.lower()
        if close:
            if tag == "a":
                links = max(0, links - 1)
            elif tag == "br":
                stack[-1].parts.append(None)
            elif tag not in INLINE:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
                links = 0 if tag not in VOID else links
            continue
        if tag in INLINE:
            links += tag == "a"
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                stack[-1].parts.append(None)
            continue
        if tag in RAW:
            if not rest.rstrip().endswith("/"):
                at = behind(page, tag, at)
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in ("td", "th", "table", "button", "article", "body"):
                    break
        if tag in ENDS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in STOPS[tag]:
                    break
                if stack[k].tag in ENDS[tag]:
                    del stack[k:]
                    break
        attributes = {n.lower(): a or b or c for n, a, b, c in ATTRIBUTE.findall(rest)} if rest and "=" in rest else {}
        if tag in ("html", "body") and (had := next((n for n in stack if n.tag == tag), None)) is not None:
            continue
        node = Node(tag, attributes)
        stack[-1].parts.append(node)
        stack.append(node)
    return root


VARIES = -1


class Part:
    """An element, or group of elements in a row, of a wrapper.

    text: a hash of its whole text where that is the same on all pages that have it, else VARIES; words and linked: words of its own
    slot and those of them in links, over all pages; seen: pages; nodes: the elements of a page that stand here.
    """

    __slots__ = ("key", "optional", "repeated", "main", "boiler", "words", "linked", "seen", "text", "parts", "nodes")

    def __init__(self, key: str):
        self.key, self.text, self.seen, self.words, self.linked = key, 0, 1, 0, 0
        self.optional = self.repeated = self.main = self.boiler = False
        self.parts: list[Part] = []
        self.nodes: list[Node] = []

    def fits(self, other: Part) -> bool:
        a, b = self.key, other.key
        return a == b or (a[-2:] == " *" and b.startswith(a[:-2]) and b[len(a) - 2 : len(a) - 1] in ("", " ")) or (b[-2:] == " *" and a.startswith(b[:-2]) and a[len(b) - 2 : len(b) - 1] in ("", " "))


def aligned(left: list[Part], right: list[Part]) -> list[tuple[Part | None, Part | None]]:
    """Two sequences as one, in order: what matches, and what only one of them has."""
    out, i, j = [], 0, 0
    while i < len(left) and j < len(right):
        if left[i].fits(right[j]):
            out.append((left[i], right[j]))
            i, j = i + 1, j + 1
            continue
        ahead = next((k - j for k in range(j + 1, len(right)) if right[k].fits(left[i])), None)
        behind = next((k - i for k in range(i + 1, len(left)) if left[k].fits(right[j])), None)
        if ahead is not None and (behind is None or ahead <= behind):
            out += [(None, x) for x in right[j : j + ahead]]
            j += ahead
        elif behind is not None:
            out += [(x, None) for x in left[i : i + behind]]
            i += behind
        else:
            out += [(left[i], None), (None, right[j])]
            i, j = i + 1, j + 1
    return out + [(x, None) for x in left[i:]] + [(None, x) for x in right[j:]]


def grouped(parts: list[Part], other: list[Part]) -> list[Part]:
    """parts with the rows of them that are a group of other's put into such groups."""
    for group in other:
        if group.key[0] == "(" and any(group.fits(x) for x in parts) is False:
            n, at, out = len(group.parts), 0, []
            while at < len(parts):
                row = parts[at : at + n]
                if len(row) == n and all(x.fits(y) for x, y in zip(row, group.parts)):
                    out.append(_group(row))
                    at += n
                else:
                    out.append(parts[at])
                    at += 1
            parts = out
    return parts


def _group(row: list[Part]) -> Part:
    made = Part("(" + ", ".join(x.key for x in row) + ")")
    made.parts, made.seen = row, max(x.seen for x in row)
    made.text = VARIES if any(x.text == VARIES for x in row) else zlib.crc32(repr([x.text for x in row]).encode()) + 1
    return made


def merge(left: Part, right: Part, one_page: bool = False) -> None:
    """left, generalised so that it also matches what right matches. one_page: right follows left on the same page."""
    open_ = [(left, right)]
    while open_:
        a, b = open_.pop()
        a.optional |= b.optional
        a.repeated |= b.repeated | one_page * (a is left)
        a.main |= b.main
        a.boiler &= b.boiler
        a.words += b.words
        a.linked += b.linked
        a.nodes += b.nodes
        if one_page:
            a.text = zlib.crc32(repr((a.text, b.text)).encode()) + 1
        else:
            a.seen += b.seen
            a.text = a.text if a.text == b.text else VARIES
        parts: list[Part] = []
        for x, y in aligned(grouped(a.parts, b.parts), grouped(b.parts, a.parts)):
            if x is not None and y is not None:
                open_.append((x, y))
            else:
                (x or y).optional = True
            parts.append(x or y)
        if len(parts) > WIDTH:
            kinds = {p.key for p in parts}
            bag: dict[str, Part] = {}
            for p in parts:
                key = p.key if len(kinds) <= WIDTH or p.key[0] == "(" else p.key.split(" ")[0] + " *"
                if key in bag and bag[key] is not p:
                    open_.append((bag[key], p))
                bag.setdefault(key, p).key = key
            for p in bag.values():
                p.optional = p.repeated = True
            parts = list(bag.values())
        a.parts = parts


def folded(parts: list[Part], longest: int = 4) -> list[Part]:
    """A page's sequence with rows of 1 to longest parts that follow themselves as repeated parts and groups."""
    for n in range(1, longest + 1):
        out, at = [], 0
        while at < len(parts):
            row, times = parts[at : at + n], 1
            while len(again := parts[at + n * times : at + n * (times + 1)]) == n and all(x.key == y.key for x, y in zip(row, again)):
                times += 1
            if times == 1:
                out.append(parts[at])
                at += 1
                continue
            first = row[0] if n == 1 else _group(row)
            for k in range(1, times):
                again = parts[at + n * k : at + n * (k + 1)]
                merge(first, again[0] if n == 1 else _group(again), one_page=True)
            out.append(first)
            at += n * times
        parts = out
    return parts


def wrapper_of(root: Node) -> Part:
    """The wrapper of one page."""
    top = Part(root.key)
    order = [(root, top, False)]
    for node, part, inside in order:
        part.main, part.boiler, part.nodes = node.main(), node.boiler(inside) == 2, [node]
        inside = inside or (part.main and not part.boiler)
        own = []
        for x in node.parts:
            if isinstance(x, Node):
                part.parts.append(Part(x.key))
                order.append((x, part.parts[-1], inside))
            elif x is not None and not x[0].isspace():
                own.append(x[0])
                n = x[0].count(" ") + 1
                part.words += n
                part.linked += n * x[1]
        part.text = zlib.crc32("\x00".join(own).encode("utf-8", "surrogatepass")) + 1 if own else 0
    for _, part, _ in reversed(order):
        if part.parts:
            part.text = zlib.crc32(repr([part.text, *[x.text for x in part.parts]]).encode()) + 1
            part.parts = folded(part.parts)
    return top


def expression(part: Part) -> str:
    """As text, for people and tests: <key> ... </>, groups in brackets, + and ?; # is a text slot."""
    out, open_ = [], [part]
    while open_:
        x = open_.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        group = x.key[0] == "("
        out.append("(" if group else f"<{x.key}>" + "#" * (x.words > 0))
        open_.append((")" if group else "</>") + "+" * x.repeated + "?" * x.optional)
        open_ += x.parts[::-1]
    return "".join(out)


def packed(top: Part) -> str:
    """A wrapper as one flat list of its parts, parents first."""
    out, open_ = [], [top]
    while open_:
        x = open_.pop()
        flags = x.optional | x.repeated << 1 | x.main << 2 | x.boiler << 3
        out.append([x.key, flags, x.words, x.linked, x.seen, x.text, len(x.parts)])
        open_ += x.parts[::-1]
    return json.dumps(out)


def unpacked(text: str) -> Part:
    made: list[tuple[Part, int]] = []
    top = None
    for key, flags, words, linked, seen, hash_, n in json.loads(text):
        part = Part(key)
        part.optional, part.repeated, part.main, part.boiler = (bool(flags >> k & 1) for k in range(4))
        part.words, part.linked, part.seen, part.text = words, linked, seen, hash_
        while made and len(made[-1][0].parts) == made[-1][1]:
            made.pop()
        if made:
            made[-1][0].parts.append(part)
        top = top or part
        made.append((part, n))
    return top


def same_everywhere(part: Part, top: Part) -> bool:
    """The part's text is part of the template: the same on three pages and half of the host's."""
    return top.text == VARIES and part.text not in (0, VARIES) and part.seen >= 3 and 2 * part.seen >= top.seen


def main_parts(top: Part) -> tuple[list[Part], bool]:
    """The main part of a wrapper (all outermost ones of the best kind), and whether its tags say so."""
    order: list[tuple[Part, int]] = [(top, -1)]
    for at, (part, _) in enumerate(order):
        if not part.boiler:
            order += [(x, at) for x in part.parts]
    total = [0 if p.boiler or same_everywhere(p, top) else p.words - p.linked for p, _ in order]
    for at in range(len(order) - 1, 0, -1):
        total[order[at][1]] += total[at]
    kind = lambda p: ({"article": 0, "main": 1}.get(p.key.split(" ")[0], 2)) if p.main and not p.boiler else -1
    # an article that holds at least a third of the words outside of boilerplate, else main, else one so named
    for k in range(3):
        inside, outer = [False] * len(order), []
        for at, (part, up) in enumerate(order):
            inside[at] = up >= 0 and inside[up]
            if not inside[at] and kind(part) == k and total[at]:
                inside[at] = True
                outer.append(at)
        if outer and 3 * sum(total[at] for at in outer) >= total[0]:
            return [order[at][0] for at in outer], k < 2
    # else down to the part that holds nearly all of them
    at, below = 0, {}
    for k, (_, up) in enumerate(order):
        below.setdefault(up, []).append(k)
    while total[0]:
        best = max(below.get(at, ()), key=total.__getitem__, default=None)
        if best is None or 10 * total[best] < 8 * total[0] or not order[best][0].parts or order[best][0].key[0] == "(":
            break
        at = best
    return ([order[at][0]] if at else []), False


def placed(page: Part, wrapper: Part) -> None:
    """Each of the page's elements gets the part of the wrapper with which it aligns."""
    open_ = [(page, wrapper)]
    while open_:
        a, b = open_.pop()
        for node in a.nodes:
            node.part = b
        open_ += [(x, y) for x, y in aligned(grouped(a.parts, b.parts), grouped(b.parts, a.parts)) if x is not None and y is not None]


def blocks_of(top: Node, wrapper: Part | None, inside: bool, told: bool) -> list[str]:
    """The texts of an element's blocks. inside: it is the main part; told: by its tags."""
    blocks: list[str] = []
    run: list[str] = []

    def end() -> None:
        if text := SPACE.sub(" ", SPACE.sub(" ", entities.unescape("".join(run))).replace("\xa0", " ")).strip():
            blocks.append(text)
        run.clear()

    def dropped(node: Node, inside: bool) -> bool:
        same = wrapper is not None and node.part is not None and same_everywhere(node.part, wrapper)
        if inside and node.tag == "header" and not told:
            return same
        by_name = node.boiler(inside)
        return by_name == 2 or (by_name == 1 and (same or not inside)) or (same and not told)

    open_ = [(iter(top.parts), inside)]
    while open_:
        parts, inside = open_[-1]
        for x in parts:
            if x is None:
                run.append(" ")
            elif isinstance(x, Node):
                end()
                if not dropped(x, inside):
                    open_.append((iter(x.parts), inside or x.main()))
                    break
            else:
                run.append(x[0])
        else:
            end()
            open_.pop()
    return blocks


def text_of(page: str | None, wrapper: Part | None = None, main: tuple[list[Part], bool] | None = None) -> str:
    """The main part's text by the host's wrapper (and its main_parts), or by the page alone: blocks in page order, one to a line."""
    root = parse(page)
    own = wrapper_of(root)
    found, told = ([], False) if wrapper is None else main or main_parts(wrapper)
    blocks: list[str] = []
    if found:
        placed(own, wrapper)
        chosen, order = {id(x) for x in found}, [root]
        while order:  # in page order
            node = order.pop()
            if id(node.part) in chosen:
                blocks += blocks_of(node, wrapper, True, told)
            else:
                order += [x for x in node.parts[::-1] if isinstance(x, Node)]
    if not blocks:
        found, told = main_parts(own)
        nodes = {id(n): n for x in found for n in x.nodes}
        for node in nodes.values():
            blocks += blocks_of(node, None, True, told)
    return "\n".join(blocks or blocks_of(root, None, False, False))


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)), F.lit(""))


#: Hosts that a task holds before it hands on what it has; wrappers that one task aligns in a round; parts of a sequence; bytes of wrappers that are broadcast.
HELD, FAN_IN, WIDTH, BROADCAST = 2000, 64, 64, 32 << 20


def wrappers(pages: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """host, n (its pages), wrapper (JSON): one row for each host, stored."""
    schema = "host string, salt long, n long, wrapper string"

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Part] = {}
        salt = TaskContext.get().partitionId()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"host": list(held), "salt": [salt] * len(held), "n": [w.seen for w in held.values()], "wrapper": [packed(w) for w in held.values()]}, pa.schema([("host", pa.string()), ("salt", pa.int64()), ("n", pa.int64()), ("wrapper", pa.string())]))

        for batch in batches:
            for name, page in zip(batch.column("host").to_pylist(), batch.column("html")):
                new = wrapper_of(parse(page.as_py()))
                if name in held:
                    merge(held[name], new)
                else:
                    held[name] = new
                held[name].nodes.clear()
                if len(held) > HELD:
                    yield out()
                    held = {}
        if held:
            yield out()

    def align(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        first, *rest = map(unpacked, sorted(table.column("wrapper").to_pylist()))
        for other in rest:
            merge(first, other)
        return pa.table({"host": [key[0].as_py()], "salt": [key[1].as_py()], "n": [first.seen], "wrapper": [packed(first)]}, pa.schema([("host", pa.string()), ("salt", pa.int64()), ("n", pa.int64()), ("wrapper", pa.string())]))

    now = common.stored(pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(infer, schema), "wrappers")
    while (now.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        now = common.stored(now.withColumn("salt", F.expr(f"salt div {fan_in}")).groupBy("host", "salt").applyInArrow(align, schema), "wrappers")
    return now.select("host", "n", "wrapper")


def extracted(pages: DataFrame, most: int = BROADCAST) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    kind = pages.schema["page_id"].dataType.simpleString()
    found = wrappers(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[Part, tuple[list[Part], bool]]] = {}
        for whole in batches:
            for low in range(0, whole.num_rows, 500):
                batch, texts = whole.slice(low, 500), []
                for page, raw in zip(batch.column("html"), batch.column("wrapper").to_pylist()):
                    if raw is not None and raw not in known:
                        if len(known) >= HELD:
                            known.clear()
                        known[raw] = ((top := unpacked(raw)), main_parts(top))
                    texts.append(text_of(page.as_py(), *(known[raw] if raw is not None else ())))
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    size = found.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    if size <= most:  # pages stay where they are
        rows = rows.join(F.broadcast(found.drop("n")), "host", "left")
    else:
        rows = common.salted(rows, found, ["host"], F.xxhash64("page_id", "html"), found.agg(F.sum("n")).first()[0] or 0)
    return rows.select("page_id", "url", "html", "wrapper").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
