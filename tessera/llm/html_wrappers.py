"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page's token stream is read as a sequence of elements and text slots. Repeats next to each other are folded into
repeated groups, which gives the page's own expression. The expressions of a host are then aligned one after another:
what only one side has becomes optional, what differs in number becomes repeated, texts that differ become slots.

The wrapper so formed says for each text slot what it is on this host:

* a text that stands in the same slot on most pages belongs to the template, wherever it stands;
* a slot most of whose characters are links is navigation;
* the article is the region that holds most running text: from the root, the wrapper is followed downward as long as
  one child holds nearly all of what is left.

Names of elements, and words of class, id and role, only take away from that region what the wrapper cannot know, such
as comments, and tip the scale where regions are close or where a host has no more than one page.

Pages are parsed once, in parallel, and staged as text slots. Distinct expressions are aligned in parts, and the parts'
wrappers are aligned again until a host has one, so a host with a third of all pages costs no more than its distinct
expressions, and its size changes nothing in the method. Texts are counted by slot in Spark.
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, salted_lookup, stage, table

#: Elements that do not end a block; a line break is white space.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
#: Elements that never hold main text.
NOISE_TAGS = frozenset(
    "head script style noscript template nav footer aside form button select textarea iframe svg object dialog menu "
    "title math canvas audio video".split()
)
#: Words of class, id and role that mark what is not main text.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar "
    "aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead toolbar share sharing social related "
    "recommended recommendations comment comments disqus reply replies respond pagination pager widget widgets "
    "complementary contentinfo search".split()
)
#: Words that _noisy looks at: where labels are merged these have to be the same.
JUDGED_WORDS = NOISE_WORDS | {"header", "hidden"}
#: An open element is ended by these.
ENDED_BY = {
    "p": frozenset(
        "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
        "header hr main menu nav ol p pre section table ul".split()
    ),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option", "optgroup"]),
    "head": frozenset(["body"]),
}
MAIN = frozenset(["article", "main"])
#: Elements of running text: the article's region is not sought inside them.
TEXT_LEVEL = frozenset("p li h1 h2 h3 h4 h5 h6 ul ol dl dt dd blockquote pre figure figcaption".split())
#: Expressions, or wrappers of parts, that a task aligns at a time, on average.
PART = 256
#: A text is template text in a slot if it stands there on more than half of the slot's pages, and on so many at least.
LEAST_PAGES = 3
#: The wrapper is followed into a child that holds this share of its parent's running text.
NEARLY_ALL = 0.75
#: Cells of the table of an alignment; a larger one is halved first.
CELLS = 1 << 22

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|</([a-zA-Z][^\s>/]*)[^>]*(?:>|$)|<([a-zA-Z][^\s>/]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)


class Slot:
    """A text slot; slots that folding or alignment puts together point to one."""

    __slots__ = ("number", "to")

    def __init__(self) -> None:
        self.to: Slot | None = None
        self.number = -1

    def find(self) -> Slot:
        own = self
        while own.to is not None:
            if own.to.to is not None:
                own.to = own.to.to
            own = own.to
        return own


class Node:
    """An element, a group of siblings (label "") or, with a slot, a text; optional or repeated.

    `name` is what alignment compares: "#" for a text, the label of an element, the names inside a group.
    """

    __slots__ = ("children", "label", "name", "optional", "repeated", "slot")

    def __init__(self, label: str, slot: Slot | None = None, children: list[Node] | None = None) -> None:
        self.label, self.slot, self.children = label, slot, children or []
        self.name = "#" if slot else label or "(" + ",".join([c.name for c in self.children]) + ")"
        self.optional = self.repeated = False


def _label(tag: str, attributes: str) -> str:
    """The tag and all words of class, id and role, without digits, each once."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return tag
    words: list[str] = []
    for name, value in _ATTRIBUTE.findall(attributes):
        if name.lower() == "hidden" and not value:
            words.append("hidden")
        words += re.findall(r"[a-z]+", value.lower())
    return " ".join([tag, *dict.fromkeys(words)])


def parse(page: str) -> tuple[Node, list[tuple[Slot, str, int]]]:
    """The tree of block elements, and the blocks in page order: slot, text, characters inside links."""
    root = Node("")
    stack: list[tuple[str, Node]] = [("", root)]
    opened: Counter[str] = Counter()
    blocks: list[tuple[Slot, str, int]] = []
    pieces: list[str] = []
    linked, links = 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split()) if pieces else ""
        if text:
            node = Node("", Slot())
            stack[-1][1].children.append(node)
            blocks.append((node.slot, text, min(linked, len(text))))
        pieces.clear()
        linked = 0

    def end() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    at = 0
    while at < len(page):
        found = _TOKEN.search(page, at)
        upto = found.start() if found else len(page)
        if upto > at:
            text = entities.unescape(page[at:upto])
            pieces.append(text)
            if links:
                linked += len(text)
        if not found:
            break
        at = found.end()
        closing, opening, attributes = found.group(1), found.group(2), found.group(3)
        if opening:
            tag = opening.lower()
            if tag in INLINE:
                if tag == "br":
                    pieces.append(" ")
                links += tag == "a"
                continue
            flush()
            links = 0
            while stack[-1][0] in ENDED_BY and tag in ENDED_BY[stack[-1][0]]:
                end()
            if tag in RAW:
                closed = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|$)", re.I).search(page, at)
                at = closed.end() if closed else len(page)
            elif tag not in VOID and not attributes.rstrip().endswith("/"):
                if tag == "body":
                    while opened["head"]:
                        end()
                node = Node(_label(tag, attributes))
                stack[-1][1].children.append(node)
                stack.append((tag, node))
                opened[tag] += 1
        elif closing:
            tag = closing.lower()
            if tag in INLINE:
                links = max(0, links - (tag == "a"))
                continue
            flush()
            if opened[tag]:
                while end() != tag:
                    pass
    flush()
    return root, blocks


def _numbered(*sequences: list[str]) -> list[np.ndarray]:
    """Sequences of names as sequences of numbers, equal names having one number."""
    numbers: dict[str, int] = {}
    return [np.array([numbers.setdefault(x, len(numbers)) for x in s], np.int64) for s in sequences]


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each beginning of b, the length of the longest common subsequence with the whole of a."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return row


def common(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Places (in a, in b) of a longest common subsequence. The memory is bounded; the time is the product of lengths."""
    shared = min(len(a), len(b))
    differs = np.flatnonzero(a[:shared] != b[:shared])
    head = int(differs[0]) if len(differs) else shared
    differs = np.flatnonzero(a[::-1][: shared - head] != b[::-1][: shared - head])
    tail = int(differs[0]) if len(differs) else shared - head
    out = [(i, i) for i in range(head)]
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(x) and len(y):
        if len(x) > 1 and len(x) * len(y) > CELLS:  # halve x; cut y where both halves have most in common
            half = len(x) // 2
            cut = int((_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]).argmax())
            inner = common(x[:half], y[:cut]) + [(i + half, j + cut) for i, j in common(x[half:], y[cut:])]
        else:
            rows = np.zeros((len(x) + 1, len(y) + 1), np.int32)
            for i, value in enumerate(x):
                rows[i + 1, 1:] = np.maximum.accumulate(np.maximum(rows[i, 1:], rows[i, :-1] + (y == value)))
            inner, i, j = [], len(x), len(y)
            while i and j:
                if x[i - 1] == y[j - 1]:
                    i, j = i - 1, j - 1
                    inner.append((i, j))
                elif rows[i - 1, j] >= rows[i, j - 1]:
                    i -= 1
                else:
                    j -= 1
            inner.reverse()
        out += [(i + head, j + head) for i, j in inner]
    return out + [(len(a) - t, len(b) - t) for t in range(tail, 0, -1)]


def _merge(a: Node, b: Node) -> Node:
    """Two expressions, of equal name or akin, as one."""
    if a.slot:
        one, two = a.slot.find(), b.slot.find()
        if one is not two:
            two.to = one
    else:
        if a.label != b.label:
            words = set(b.label.split(" "))
            a.label = a.name = " ".join([w for w in a.label.split(" ") if w in words])
        a.children = align(a.children, b.children)
    a.optional |= b.optional
    a.repeated |= b.repeated
    return a


def _kin(node: Node) -> str:
    """What elements of unlike labels have to share to be one: the tag and all words that say what an element is."""
    tag, *words = node.label.split(" ")
    return " ".join([tag, *sorted(JUDGED_WORDS.intersection(words))]) if words else node.name


def _akin(a: Node, b: Node) -> bool:
    """Elements of one kin that share a word of their labels too."""
    return bool(a.label and b.label) and len(set(a.label.split(" ")) & set(b.label.split(" "))) > 1


def _aligned(a: list[Node], b: list[Node]) -> list[Node]:
    """Without equal names on both sides: akin elements are merged, all others are optional."""
    out, at_a, at_b = [], 0, 0
    pairs = common(*_numbered([_kin(x) for x in a], [_kin(x) for x in b])) if a and b else []
    for i, j in [*[(i, j) for i, j in pairs if _akin(a[i], b[j])], (len(a), len(b))]:
        for x in (*a[at_a:i], *b[at_b:j]):
            x.optional = True
            out.append(x)
        if i < len(a):
            out.append(_merge(a[i], b[j]))
        at_a, at_b = i + 1, j + 1
    return out


def align(a: list[Node], b: list[Node]) -> list[Node]:
    """Two sequences as one: what both have is merged in order, what one has is optional."""
    left, right = [x.name for x in a], [x.name for x in b]
    if left == right:
        return [_merge(x, y) for x, y in zip(a, b)]
    out: list[Node] = []
    at_a = at_b = 0
    for i, j in [*common(*_numbered(left, right)), (len(a), len(b))]:
        out += _aligned(a[at_a:i], b[at_b:j])
        if i < len(a):
            out.append(_merge(a[i], b[j]))
        at_a, at_b = i + 1, j + 1
    return fold_siblings(out)


def _next_period(numbers: np.ndarray, after: int, text: int) -> int | None:
    """The shortest distance over `after` at which a name comes again (`text`: not next to itself)."""
    order = np.argsort(numbers, kind="stable")
    gaps = np.diff(order)[numbers[order[1:]] == numbers[order[:-1]]]
    names = numbers[order[1:]][numbers[order[1:]] == numbers[order[:-1]]]
    gaps = gaps[(gaps > after) & ~((gaps == 1) & (names == text))]
    return int(gaps.min()) if len(gaps) else None


def fold_siblings(nodes: list[Node]) -> list[Node]:
    """Sequences of equal names next to each other become repeated groups, the shortest period first."""
    period = 0
    while len(nodes) > 1:
        (numbers,) = _numbered([x.name for x in nodes])
        text = next((int(numbers[i]) for i, x in enumerate(nodes) if x.slot), -1)
        period = _next_period(numbers, period, text)
        if period is None or 2 * period > len(nodes):
            break
        same = numbers[period:] == numbers[:-period]
        out, at = [], 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
        for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist()):
            start = max(start, at)
            times = (stop - start) // period + 1
            if times < 2 or (numbers[start : start + period] == text).all():
                continue
            out += nodes[at:start]
            group = nodes[start : start + period]
            for t in range(1, times):
                group = [_merge(x, y) for x, y in zip(group, nodes[start + t * period : start + (t + 1) * period])]
            folded = group[0] if period == 1 else Node("", children=group)
            folded.repeated = True
            out.append(folded)
            at = start + times * period
        nodes = out + nodes[at:]
    return nodes


def fold(root: Node) -> Node:
    """Fold the children of each element, from the innermost out."""
    order, pending = [], [root]
    while pending:
        node = pending.pop()
        order.append(node)
        pending += [c for c in node.children if not c.slot]
    for node in reversed(order):
        node.children = fold_siblings(node.children)
    return root


def _written(root: Node) -> list:
    """The expression as a flat list: flags and label where an element begins, None where it ends, slots by number.

    Slots are numbered in the order in which they come.
    """
    out: list = []
    pending: list = [c for c in reversed(root.children)]
    numbers = 0
    while pending:
        node = pending.pop()
        if node is None:
            out.append(None)
        elif node.slot:
            own = node.slot.find()
            if own.number < 0:
                own.number = numbers
                numbers += 1
            out.append(own.number)
        else:
            out.append(f"{int(node.optional)}{int(node.repeated)}{node.label}")
            pending.append(None)
            pending += reversed(node.children)
    return out


def _read(written: list) -> tuple[Node, dict[int, Slot]]:
    slots: dict[int, Slot] = defaultdict(Slot)
    root = Node("")
    stack = [root]
    for token in written:
        if token is None:
            done = stack.pop()
            done.name = done.label or "(" + ",".join([c.name for c in done.children]) + ")"
        elif isinstance(token, int):
            stack[-1].children.append(Node("", slots[token]))
        else:
            node = Node(token[2:])
            node.optional, node.repeated = token[0] == "1", token[1] == "1"
            stack[-1].children.append(node)
            stack.append(node)
    return root, slots


def expression(page: str) -> tuple[str, list[tuple[int, str, int]]]:
    """A page's own expression as text, and its blocks as (slot, text, characters inside links)."""
    sys.setrecursionlimit(1 << 20)  # elements may lie in each other to any depth
    root, blocks = parse(page)
    written = _written(fold(root))
    return json.dumps(written, separators=(",", ":")), [(s.find().number, t, n) for s, t, n in blocks]


def merged(expressions: list[str]) -> tuple[str, list[list[int]]]:
    """One wrapper for all of `expressions`, and for each of them the wrapper's slot for each of its own slots."""
    sys.setrecursionlimit(1 << 20)
    wrapper, mapped = None, []
    for text in expressions:
        root, slots = _read(json.loads(text))
        mapped.append(slots)
        if wrapper is None:
            wrapper = root
        else:
            wrapper.children = align(wrapper.children, root.children)
    written = _written(wrapper)
    return json.dumps(written, separators=(",", ":")), [[s[n].find().number for n in range(len(s))] for s in mapped]


def _noisy(label: str, inside: bool) -> bool:
    """Whether an element's names say that it is no main text; headers inside an article do not."""
    tag, *words = label.split(" ")
    if tag in NOISE_TAGS or "hidden" in words:
        return True
    told = NOISE_WORDS.intersection(words)
    if tag == "article":  # the class of an article may name what else is on the page
        told &= {"comment", "comments", "reply"}
    if told and tag not in ("html", "body", "main"):
        return True
    return (tag == "header" or "header" in words) and not inside and tag not in ("html", "body", *MAIN)


def decide(wrapper: str, slots: dict[int, tuple[int, int, int]], pages: int) -> list[bool]:
    """For each slot of a host's wrapper, whether it holds main text.

    `slots`: characters, of them in links, of them in template texts; `pages`: distinct pages of the host.
    """
    labels, parents, ends = [""], [-1], [0]
    around: list[tuple[int, bool, bool]] = [(0, False, False)]  # element, in noise, in a main element
    where: dict[int, tuple[int, bool]] = {}
    for token in json.loads(wrapper):
        if token is None:
            ends[around.pop()[0]] = len(labels)
        elif isinstance(token, int):
            where.setdefault(token, around[-1][:2])
        else:
            parent, noise, inside = around[-1]
            around.append((len(labels), noise or bool(token[2:]) and _noisy(token[2:], inside), inside or token[2:].split(" ")[0] in MAIN))
            labels.append(token[2:])
            parents.append(parent)
            ends.append(0)
    ends[0] = len(labels)
    tags = [x.split(" ")[0] for x in labels]
    plain = {n for n, (_, noise) in where.items() if not noise and n in slots and 2 * slots[n][1] <= slots[n][0]}
    volume = [0] * len(labels)
    for n in plain:
        volume[where[n][0]] += max(0, slots[n][0] - slots[n][2])
    for node in range(len(labels) - 1, 0, -1):
        volume[parents[node]] += volume[node]
    children = defaultdict(list)
    for node in range(1, len(labels)):
        children[parents[node]].append(node)
    region = 0
    if pages == 1 and any(t in MAIN and volume[i] for i, t in enumerate(tags)):  # nothing to compare with: go by the name
        region = max((i for i, t in enumerate(tags) if t in MAIN), key=lambda i: (volume[i], -i))
    while tags[region] not in MAIN:
        weight = {c: volume[c] * (2 if tags[c] in MAIN else 1) for c in children[region] if tags[c] and tags[c] not in TEXT_LEVEL}
        best = max(weight, key=lambda c: (weight[c], -c), default=None)
        all_of_it = volume[region] + (volume[best] if best and tags[best] in MAIN else 0) if best else 0
        if not best or not weight[best] or weight[best] < NEARLY_ALL * all_of_it:
            break
        region = best
    keep = {n for n in plain if region <= where[n][0] < ends[region]}
    keep |= {n for n in plain if tags[where[n][0]] == "h1"}
    return [n in keep or not keep and n in plain for n in range(max(where, default=-1) + 1)]


BLOCKS = "page_id long, url string, host string, written string, blocks array<struct<slot:int,text:string,links:int>>"


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, and the expression and blocks of each page, from the whole html (null: empty)."""
    bounded_batches(pages.sparkSession)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, url, page in zip(batch["page_id"], batch["url"], batch["html"]):
                written, blocks = expression(page or "")
                host = re.sub(r"^[a-z][a-z0-9+.-]*://|[/?#].*$", "", (url or "").lower(), flags=re.S)
                rows.append((page_id, url, host, written, [{"slot": s, "text": t, "links": n} for s, t, n in blocks]))
            out = pd.DataFrame(rows, columns=["page_id", "url", "host", "written", "blocks"])
            out["page_id"] = out["page_id"].astype("Int64")
            yield out

    return pages.select("page_id", "url", "html").mapInPandas(read, BLOCKS)


def _merged_parts(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["pages", "written"], ascending=[False, True])
    wrapper, slots = merged(list(rows["written"]))
    none = [None] * (len(rows) - 1)
    out = {"host": rows["host"].values, "id": rows["id"].values, "part": rows["part"].values, "slots": slots}
    return pd.DataFrame({**out, "written": [wrapper, *none], "pages": [rows["pages"].sum(), *none]})


def wrappers(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, written): the wrapper of each host; (host, expr, slots): its slot for each slot of an expression.

    `read` is the staged result of parsed(), with expr.
    """
    found = read.groupBy("host", "expr").agg(F.count(F.lit(1)).alias("pages"), F.min("written").alias("written"))
    level = stage(found.select("host", F.col("expr").alias("id"), "pages", "written"))
    maps = None
    while True:
        several = level.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
        dealt = level.join(several, "host").select("host", "id", F.pmod("id", "parts").alias("part"), "pages", "written")
        schema = "host string, id long, part long, slots array<int>, written string, pages long"
        done = stage(dealt.groupBy("host", "part").applyInPandas(_merged_parts, schema))
        if maps is None:
            maps = done.select("host", F.col("id").alias("expr"), F.col("part").alias("id"), "slots")
        else:
            own = done.select("host", "id", "part", F.col("slots").alias("_next"))
            passed = F.transform("slots", lambda s: F.get(F.col("_next"), s))
            maps = stage(maps.join(own, ["host", "id"]).select("host", "expr", F.col("part").alias("id"), passed.alias("slots")))
        level = done.where("written IS NOT NULL").select("host", F.col("part").alias("id"), "pages", "written")
        if level.groupBy("host").count().where("count > 1").isEmpty():
            return level.select("host", "written"), maps.select("host", "expr", "slots")


def _decided(rows: pd.DataFrame) -> pd.DataFrame:
    keep = [
        decide(written, {s["slot"]: (s["chars"], s["links"], s["template"]) for s in slots}, pages)
        for written, slots, pages in zip(rows["written"], rows["slots"], rows["pages"])
    ]
    return pd.DataFrame({"host": rows["host"].values, "keep": keep})


def _decisions(read: DataFrame) -> DataFrame:
    """(host, expr, slots, keep, templates): keep for each slot of the host's wrapper, template texts by their hash."""
    wrapper, maps = wrappers(read)
    outline = F.transform("blocks", lambda b: F.struct(b["slot"].alias("slot"), F.xxhash64(b["text"]).alias("text"), F.length(b["text"]).alias("chars"), b["links"].alias("links")))
    # Copies of a page say nothing about the template: distinct pages count.
    pages = stage(read.select("host", "expr", F.xxhash64("written", "blocks").alias("page"), outline.alias("outline")).dropDuplicates(["host", "page"]))
    on_slots = F.transform("outline", lambda b: b.withField("slot", F.get(F.col("slots"), b["slot"])))
    of_pages = salted_lookup(pages, maps, ["host", "expr"], F.col("page")).select("host", F.array_distinct(on_slots).alias("o"))
    each = of_pages.select("host", F.explode("o").alias("b")).select("host", "b.*")
    texts = stage(each.groupBy("host", "slot", "text").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.sum("links").alias("links")))
    slots_of_page = F.array_distinct(F.transform("o", lambda b: b["slot"]))
    seen = stage(of_pages.select("host", F.explode(slots_of_page).alias("slot")).groupBy("host", "slot").agg(F.count(F.lit(1)).alias("pages")))
    often = stage(texts.where(F.col("n") >= LEAST_PAGES).join(seen, ["host", "slot"]).where("2 * n > pages").select("host", "slot", "text", "chars"))
    template = often.groupBy("host", "slot").agg(F.sum("chars").alias("template"))
    slots = texts.groupBy("host", "slot").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links")).join(template, ["host", "slot"], "left")
    slots = slots.groupBy("host").agg(F.collect_list(F.struct("slot", "chars", "links", F.coalesce("template", F.lit(0)).alias("template"))).alias("slots"))
    distinct = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    every = wrapper.join(distinct, "host").join(slots, "host", "left")
    every = every.withColumn("slots", F.coalesce("slots", F.expr("cast(array() AS array<struct<slot:int,chars:bigint,links:bigint,template:bigint>>)")))
    keep = every.groupBy("host").applyInPandas(_decided, "host string, keep array<boolean>")
    hashes = often.groupBy("host").agg(F.collect_list(F.xxhash64("slot", "text")).alias("templates"))
    of_host = stage(keep.join(hashes, "host", "left"))
    return stage(maps.join(of_host, "host"))


def _characters(blocks: Column) -> Column:
    return F.aggregate(blocks, F.lit(0).cast("long"), lambda n, b: n + F.length(b["text"]))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of `pages` (page_id, url, html).

    Blocks are joined in page order by one line break; white space in a block is one space, at its ends none. Null or
    empty html, and pages without main text, give an empty text; an empty table gives no rows. Pages of any length,
    depth and number of siblings are read whole. A null url has a host of its own. Repeated rows stay; other columns
    are not read. A page more than half of whose main text would be template text is a copy of others: it keeps it.
    """
    read = stage(parsed(pages).withColumn("expr", F.xxhash64("written")))
    joined = salted_lookup(read, _decisions(read), ["host", "expr"], F.coalesce("page_id", F.lit(0)))
    placed = F.transform("blocks", lambda b: b.withField("slot", F.get(F.col("slots"), b["slot"])))
    kept = joined.withColumn("_placed", placed).withColumn("_kept", F.expr("filter(_placed, b -> get(keep, b.slot))"))
    own = F.expr("if(templates IS NULL, _kept, filter(_kept, b -> NOT array_contains(templates, xxhash64(b.slot, xxhash64(b.text)))))")
    own = kept.withColumn("_own", own)
    chosen = F.when(2 * _characters(F.col("_own")) < _characters(F.col("_kept")), F.col("_kept")).otherwise(F.col("_own"))
    text = F.coalesce(F.array_join(F.transform(chosen, lambda b: b["text"]), "\n"), F.lit(""))
    return own.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
