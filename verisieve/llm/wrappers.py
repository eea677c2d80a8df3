"""Main text of web pages by wrappers inferred for each host.

A page is read as a tree of block elements.  Its child sequences are folded:
equal neighbours, and groups that follow themselves, become repeated.  Pages of
one host are aligned one after another, child sequence by child sequence: what
only one side has becomes optional, what repeats becomes a repeated group, and
text becomes a slot, constant or varying.  The result is a union-free regular
expression over tags, the host's wrapper.  The element that carries most of the
host's varying text, outside menus, adverts and the like, is its main part.
Each page is then matched against the expression, and what stands where the
main part does is its text, whole.

A wrapper depends on the different pages of its host, not on how often each
occurs: masses are the largest of any page, and a slot varies when two pages
differ there.  Where next to nothing varies, as with one page, every slot counts.

Alignment is done where the pages are; a task sends one partial wrapper for a
host, and those are merged in rounds of ``FAN`` at a time, so no host's pages
meet in one task.  A wrapper's size is bounded by its template's: a sequence of
more than ``LONG`` items becomes one repeated group of optional members, and
one with very many of those tells them by their tags alone; nothing is left
out.  Wrappers are broadcast only while they take ``BROADCAST_BYTES`` together
at most, and are joined to the pages by host otherwise.

Defined results: a null or empty html has an empty text; a null url, or one
without a host, is judged by its own page, and so is a page that its host's
wrapper does not fit; markup that is never closed, or cut off, is read as far
as it goes; repeated rows are extracted each; an empty table gives an empty
result; further columns, also ones named like the results, do not matter.
``br`` is white space, not the end of a block.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import sys
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, with_arrow_columns
from .url_filter import with_parts

#: Fixed names: elements that form blocks, that have no content, and whose content is no text.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template svg canvas object math audio video".split())
#: Elements that are never part of an article, and those whose id may tell what they are for.
APART = frozenset("nav footer aside form head button select textarea iframe noscript dialog menu legend optgroup option".split())
CONTAINERS = frozenset("div section ul ol dl center header figure address details dir hgroup main".split())
#: Words in a class, id or role of an element that stands apart, outside articles.
ROLES = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menubar|banner|footer|foot|colophon|contentinfo|sidebar|aside|complementary|ad|ads|adv|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|"
    r"notice|notices|cookie|cookies|consent|gdpr|popup|modal|overlay|alert|comment|comments|commentlist|respond|reply|replies|discussion|disqus|share|sharing|social|related|recommended|breadcrumb|breadcrumbs|"
    r"pagination|pager|subscribe|subscription|newsletter|signup|login|search|widget|toolbar|skip)(?:$|[\s_-])"
)
#: Whole words of a container within an article that is no part of it.
INSERTS = re.compile(
    r"(?:^|\s)(?:nav|navigation|sidebar|aside|complementary|banner|ads?|adv|adverts?|advertisement|advertising|ad[_-]?(?:box|slot|unit|container|wrapper|banner|block|break|\d+)|sponsor|sponsored|promo|notices?|cookie[_-]?(?:notice|banner|bar|consent)s?|"
    r"comments?|comments?[_-]?(?:list|section|area|form|thread|box|\d+)|respond|replies|discussion|disqus(?:_thread)?|share|sharing|share[_-]?(?:buttons?|bar|links?)|social|social[_-]?(?:share|links?|buttons?|media)|"
    r"related|related[_-]?(?:posts?|articles?|links?|content|stories)|recommended|breadcrumbs?|pagination|pager|subscribe|newsletter|newsletter[_-]?(?:signup|form|box)|signup|login|widget|toolbar)(?:$|\s)"
)
#: Words of a page's own header; an article's own is part of it.
HEADERS = re.compile(r"(?:^|[\s_-])(?<!article[_-])(?<!post[_-])(?<!entry[_-])(?<!story[_-])(?<!content[_-])(?:header|masthead)(?:$|[\s_-])")
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup")}
SCOPES = frozenset("ul ol dl table select article section div body html td th".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>"'<]++|"[^"<]*+"|'[^'<]*+')*+)>|[^<]++|<""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Items of a sequence, and members of a long one, before they are generalised.
LONG, MEMBERS = 64, 256
#: Share of a host's text from which the varying slots alone tell the main part.
LEAST_VARYING = 0.1
#: Bound of all wrappers together for a broadcast; hosts that a task holds at once; partial wrappers merged at once.
BROADCAST_BYTES, HOSTS, FAN = 16_000_000, 2000, 16


class Node:
    """A block element: its signature, whether it is apart from articles, and its texts and elements in order."""

    __slots__ = ("tag", "sig", "apart", "items", "parent")

    def __init__(self, tag: str, sig: str, apart: bool, parent: Node | None):
        self.tag, self.sig, self.apart, self.items, self.parent = tag, sig, apart, [], parent


def _signature(tag: str, attributes: str, within: bool) -> tuple[str, bool]:
    """An element's tag and classes, and whether it is apart: by its tag, or by words in its attributes.

    Only containers are judged by their ids and roles; within an article only
    containers are judged, and by whole words.
    """
    found = {a[0].lower(): (a[1] or a[2] or a[3]).lower() for a in reversed(ATTRIBUTE.findall(attributes))} if attributes else {}
    classes = found.get("class", "")
    sig = tag + "".join("." + re.sub(r"\d+", "0", w) for w in sorted(set(classes.split())))
    if tag == "header":
        return sig, not within
    if tag in APART:
        return sig, True
    if tag in ("html", "body", "article", "main") or not found:
        return sig, False
    if within:
        return sig, tag in CONTAINERS and bool(INSERTS.search(" ".join(found.values())))
    named = " ".join(found.values()) if tag in CONTAINERS else classes
    return sig, bool(ROLES.search(named) or HEADERS.search(named))


def parse(page: str) -> Node:
    """The tree of block elements; inline markup is dropped, and unclosed elements end where a browser ends them."""
    root = here = Node("", "", False, None)
    opened: Counter = Counter()
    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                here.items.append(text)
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCKS and opened[tag]:
                while here.tag != tag:
                    opened[here.tag] -= 1
                    here = here.parent
                opened[tag] -= 1
                here = here.parent
            elif tag == "br":
                here.items.append(" ")
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                at = TOKEN.match(page, close.start()).end() if close else end
            continue
        if tag == "br":
            here.items.append(" ")
        if tag not in BLOCKS:
            continue
        if here.tag == "p" or here.tag[:1] == "h" and here.tag[1:].isdigit() and tag[:1] == "h" and tag[1:].isdigit():
            opened[here.tag] -= 1
            here = here.parent
        for other in CLOSES.get(tag, ()):
            if opened[other]:
                up = here
                while up is not None and up.tag != other and (up.tag not in SCOPES or up.tag == other):
                    up = up.parent
                if up is not None and up.tag == other:
                    while here is not up:
                        opened[here.tag] -= 1
                        here = here.parent
                    opened[other] -= 1
                    here = up.parent
        sig, apart = _signature(tag, m[3], bool(opened["article"]))
        node = Node(tag, sig, apart, here)
        here.items.append(node)
        if tag not in VOID:
            opened[tag] += 1
            here = node
    return root


def squeezed(parts: list[str]) -> str:
    return " ".join(entities.unescape("".join(parts)).split())


def blocks(node: Node) -> list[str]:
    """The blocks of text below ``node`` in page order, without parts that are apart."""
    out: list[str] = []
    stack: list = [(iter(node.items), [])]
    while stack:
        items, buffer = stack[-1]
        for item in items:
            if isinstance(item, str):
                buffer.append(item)
                continue
            if text := squeezed(buffer):
                out.append(text)
            buffer.clear()
            if not item.apart:
                stack.append((iter(item.items), []))
                break
        else:
            if text := squeezed(buffer):
                out.append(text)
            stack.pop()
    return out


def elements(node: Node) -> list[Node]:
    """The elements in ``node`` that are not apart; of elements that only hold another of their kind the innermost."""
    out = []
    for x in node.items:
        if not isinstance(x, str) and not x.apart:
            while len(x.items) == 1 and not isinstance(x.items[0], str) and x.items[0].sig == x.sig and not x.items[0].apart:
                x = x.items[0]
            out.append(x)
    return out


# -- wrappers: [sig, optional, repeated, mass, constant, children]; a group's sig begins with "("

SIG, OPTIONAL, REPEATED, MASS, CONSTANT, CHILDREN = range(6)
BAG, VARIES = "(*)", "*"


def digest(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "replace")).hexdigest()[:12]


def folded(root: Node) -> list:
    """The wrapper of one page's element."""
    made: dict[int, list] = {}
    stack: list[tuple[Node, list[Node] | None]] = [(root, None)]
    while stack:
        node, below = stack.pop()
        if below is None:
            below = elements(node)
            stack.append((node, below))
            stack += [(x, None) for x in below]
        else:
            own = squeezed([x for x in node.items if isinstance(x, str)])
            made[id(node)] = [node.sig, False, False, len(own), digest(own) if own else "", fold_sequence([made.pop(id(x)) for x in below])]
    return made[id(root)]


def fold_sequence(items: list[list]) -> list[list]:
    """Equal neighbours, then groups of up to four that follow themselves, as repeated ones."""
    out: list[list] = []
    for x in items:
        if out and out[-1][SIG] == x[SIG]:
            out[-1] = merged(out[-1], x, same_page=True)
            out[-1][REPEATED] = True
        else:
            out.append(x)
    for period in (2, 3, 4):
        i, folds = 0, []
        while i < len(out):
            group = [x[SIG] for x in out[i : i + period]]
            n = 1
            while len(group) == period and [x[SIG] for x in out[i + n * period : i + (n + 1) * period]] == group:
                n += 1
            if n > 1:
                members = out[i : i + period]
                for k in range(1, n):
                    members = [merged(a, b, same_page=True) for a, b in zip(members, out[i + k * period : i + (k + 1) * period])]
                folds.append(["(" + " ".join(group) + ")", False, True, 0, "", members])
                i += n * period
            else:
                folds.append(out[i])
                i += 1
        out = folds
    return out if len(out) <= LONG else [bag(out)]


def members_of(items: list[list]) -> Iterator[list]:
    """The elements of a sequence, those of its groups among them."""
    stack = list(reversed(items))
    while stack:
        x = stack.pop()
        if x[SIG].startswith("("):
            stack += reversed(x[CHILDREN])
        else:
            yield x


def bag(items: list[list], others: list[list] = ()) -> list:
    """One repeated group of optional members, for a sequence that is too long to keep; ``others`` are of other pages."""
    members: dict[str, list] = {}
    by_tag = {x[SIG] for part in (items, others) for x in members_of(part) if x[SIG].endswith(".*")}

    def name(x: list) -> str:
        return general if (general := x[SIG].split(".")[0] + ".*") in by_tag else x[SIG]

    def taken(part: list[list]) -> dict[str, list]:
        out: dict[str, list] = {}
        for x in members_of(part):
            x = [name(x), True, True, *x[MASS:]]
            out[x[SIG]] = merged(out[x[SIG]], x, same_page=True) if x[SIG] in out else x
        return out

    members = taken(items)
    for sig, x in taken(others).items():
        members[sig] = merged(members[sig], x) if sig in members else x
    if len(members) > MEMBERS and any(not sig.endswith(".*") for sig in members):
        return bag([[x[SIG].split(".")[0] + ".*", *x[OPTIONAL:]] for x in members.values()])
    return [BAG, False, True, 0, "", [members[sig] for sig in sorted(members)]]


def merged(a: list, b: list, same_page: bool = False) -> list:
    """The wrapper that matches what either of two wrappers of one signature matches.

    Parts of one page add up; of two pages the greater mass counts.
    """
    if a[SIG] == BAG:
        return bag(a[CHILDREN] + b[CHILDREN]) if same_page else bag(a[CHILDREN], b[CHILDREN])
    if VARIES in (a[CONSTANT], b[CONSTANT]):
        constant = VARIES
    elif same_page:
        constant = digest(a[CONSTANT] + " " + b[CONSTANT]) if a[CONSTANT] and b[CONSTANT] else a[CONSTANT] or b[CONSTANT]
    else:
        constant = a[CONSTANT] if a[CONSTANT] == b[CONSTANT] else VARIES
    mass = a[MASS] + b[MASS] if same_page else max(a[MASS], b[MASS])
    return [a[SIG], a[OPTIONAL] or b[OPTIONAL], a[REPEATED] or b[REPEATED], mass, constant, aligned(a[CHILDREN], b[CHILDREN], same_page)]


def aligned(a: list[list], b: list[list], same_page: bool = False) -> list[list]:
    """Two sequences aligned along their longest common subsequence; what one side lacks is optional."""
    if len(a) == len(b) and all(x[SIG] == y[SIG] for x, y in zip(a, b)):
        return [merged(x, y, same_page) for x, y in zip(a, b)]
    if any(x[SIG] == BAG for x in (*a, *b)):
        return [bag(a + b) if same_page else bag(a, b)]
    length = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            length[i][j] = length[i + 1][j + 1] + 1 if a[i][SIG] == b[j][SIG] else max(length[i + 1][j], length[i][j + 1])
    out: list[list] = []
    i = j = 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i][SIG] == b[j][SIG]:
            out.append(merged(a[i], b[j], same_page))
            i, j = i + 1, j + 1
            continue
        if j == len(b) or i < len(a) and length[i + 1][j] >= length[i][j + 1]:
            one, i = a[i], i + 1
        else:
            one, j = b[j], j + 1
        out.append([one[SIG], True, *one[REPEATED:]])
    return out if len(out) <= LONG else [bag(out)]


def expression(w: list) -> str:
    """The wrapper as a union-free regular expression over tags; ``#`` is a varying and ``=`` a constant slot."""
    inner = " ".join(map(expression, w[CHILDREN]))
    text = "" if not w[CONSTANT] else "#" if w[CONSTANT] == VARIES else "="
    body = f"({inner})" if w[SIG].startswith("(") else f"<{w[SIG]}>{text}{inner}</>"
    return body + ("+" if w[REPEATED] else "") + ("?" if w[OPTIONAL] else "")


def packed(w: list) -> str:
    """A wrapper as JSON, element by element in the order of the expression, so that depth does not matter."""
    out, stack = [], [w]
    while stack:
        x = stack.pop()
        out.append([*x[:CHILDREN], len(x[CHILDREN])])
        stack += reversed(x[CHILDREN])
    return json.dumps(out)


def restored(text: str) -> list:
    rows = json.loads(text)
    stack: list[list] = []
    for row in reversed(rows):
        n = row.pop()
        row.append([stack.pop() for _ in range(n)])
        stack.append(row)
    return stack[0]


class Wrapper:
    """A wrapper ready for matching: its main part, and for each element on the way there the places of its members."""

    def __init__(self, w: list):
        order, stack = [], [(w, -1)]
        while stack:
            x, parent = stack.pop()
            at = len(order)
            order.append((x, parent))
            stack += [(y, at) for y in reversed(x[CHILDREN])]
        every = [x[MASS] for x, _ in order]
        varying = [x[MASS] if x[CONSTANT] == VARIES else 0 for x, _ in order]
        # of one page, of copies, and of pages that differ in a date or a counter alone every slot counts
        measures = [varying, every] if sum(varying) >= LEAST_VARYING * max(1, sum(every)) else [every, varying]
        for total in measures:
            for i in range(len(order) - 1, 0, -1):
                total[order[i][1]] += total[i]
        self.root, self.targets = w, set()
        main = self._main([x for x, _ in order], [p for _, p in order], measures)
        self.targets.add(id(order[main][0]))
        last = len(order)
        for i in range(main + 1, len(order)):
            if order[i][1] < main:
                last = i
                break
        heads = [i for i, (x, _) in enumerate(order) if x[SIG].split(".")[0] == "h1"]
        if not any(main <= i < last for i in heads) and any(i < main for i in heads):
            self.targets.add(id(order[max(i for i in heads if i < main)][0]))  # the title right before the main part
        self.leads: set[int] = set()
        for i, (x, _) in enumerate(order):
            if id(x) in self.targets:
                while i >= 0 and id(order[i][0]) not in self.leads:
                    self.leads.add(id(order[i][0]))
                    i = order[i][1]
        self.places: dict[int, tuple] = {}

    @staticmethod
    def _main(nodes: list[list], parent: list[int], measures: list[list[int]]) -> int:
        """The heaviest article or main element, else as far down as most of the text stays together."""
        tag = [x[SIG].split(".")[0] for x in nodes]
        for name in ("article", "main"):
            for total in measures:
                named = [(total[i], -i) for i in range(len(nodes)) if tag[i] == name and total[i] > 0]
                if named and max(named)[0] >= 0.25 * total[0]:
                    return -max(named)[1]
        total = measures[0]
        below: dict[int, list[int]] = {}
        for i in range(1, len(nodes)):
            below.setdefault(parent[i], []).append(i)
        here = 0
        while True:
            inside, todo = [], list(below.get(here, ()))
            while todo:  # members of groups stand where the group does
                i = todo.pop()
                if nodes[i][SIG].startswith("("):
                    todo += below.get(i, ())
                elif tag[i] in ("div", "section", "body", "html", "table", "tbody", "tr", "td", "main", "center"):
                    inside.append((total[i], -i))
            if not inside or max(inside)[0] < 0.6 * total[here] or not max(inside)[0]:
                return here
            here = -max(inside)[1]

    def _places(self, w: list) -> tuple:
        """Of an element's sequence: its members, the group of each as (first, end), and the places of each signature."""
        found = self.places.get(id(w))
        if found is None:
            members, groups, by_sig = [], [], {}
            for x in w[CHILDREN]:
                own = list(members_of([x]))
                for y in own:
                    by_sig.setdefault(y[SIG], []).append(len(members))
                    groups.append((len(members) - own.index(y), len(members) - own.index(y) + len(own), x[REPEATED]))
                    members.append(y)
            found = self.places[id(w)] = (members, groups, by_sig)
        return found

    def matched(self, root: Node) -> list[Node]:
        """The page's elements that stand where the main part does, in page order.

        Along each sequence of the page the expression is followed from place to
        place: on, or back to the beginning of a repeated group.
        """
        out: list[Node] = []
        stack = [(root, self.root)]
        while stack:
            node, w = stack.pop()
            if id(w) in self.targets:
                out.append(node)
                continue
            members, groups, by_sig = self._places(w)
            at, following = 0, []
            for x in elements(node):
                places = by_sig.get(x.sig) or by_sig.get(x.tag + ".*")
                if not places:
                    continue
                k = bisect_left(places, at)
                within = groups[min(at, len(groups) - 1)]
                again = [p for p in places[:k] if within[2] and within[0] <= p < within[1]] if k else []
                if k < len(places) and (places[k] < within[1] or not again):
                    place = places[k]
                else:
                    place = again[0] if again else places[-1]
                at = place if groups[place][2] else place + 1
                if id(members[place]) in self.leads:
                    following.append((x, members[place]))
            stack += reversed(following)
        return out


def extract(page: str | None, known: Wrapper | None) -> str:
    """The main text of one page, by its host's wrapper where that fits, else by its own."""
    if not page:
        return ""
    root = parse(page)
    for wrapper in (known, None):
        if wrapper is None:
            wrapper = Wrapper(folded(root))
        found = [b for n in wrapper.matched(root) for b in blocks(n)]
        if found:
            return "\n".join(found)
    return ""


PARTIAL = "host string, salt long, wrapper string"


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """Rows host, wrapper (JSON): one wrapper for each host of ``pages`` (url, html)."""

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.setrecursionlimit(1_000_000)  # of Python's own frames, which are no stack of the machine
        held: dict[str, list] = {}
        salt = 0

        def sent() -> pd.DataFrame:
            return pd.DataFrame({"host": list(held), "salt": [salt] * len(held), "wrapper": [packed(w) for w in held.values()]})

        for rows in parts:
            for host, page, number in zip(rows["host"], rows["html"], rows["part"], strict=True):
                salt = int(number)
                w = folded(parse(page))
                held[host] = merged(held[host], w) if host in held else w
                if len(held) >= HOSTS:
                    yield sent()
                    held.clear()
        if held:
            yield sent()

    def joined(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.setrecursionlimit(1_000_000)
        w = None
        for rows in parts:
            for text in rows["wrapper"]:
                w = restored(text) if w is None else merged(w, restored(text))
        yield pd.DataFrame({"host": [key[0]], "salt": [key[1]], "wrapper": [packed(w)]})

    have = with_parts(pages.select("url", "html").where("html is not null and html <> ''"), "url").where("host <> ''").select("host", "html", F.spark_partition_id().cast("long").alias("part"))
    now, path = materialize(have.mapInPandas(partial, PARTIAL), "wrappers")
    most = now.agg(F.max("salt")).first()[0] or 0
    while True:
        most //= FAN
        grouped = now.withColumn("salt", F.floor(F.col("salt") / FAN).cast("long")).groupBy("host", "salt").applyInPandas(joined, PARTIAL)
        merged_now, new_path = materialize(grouped, "wrappers")
        discard(pages.sparkSession, path)
        now, path = merged_now, new_path
        if most == 0:
            return now.select("host", "wrapper")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """The query's columns: page_id, url, text, n_chars."""
    wrappers = infer_wrappers(pages)
    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    asked = with_parts(pages.select("page_id", "url", F.col("html").alias("_html")), "url").drop("path", "node")
    if (wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0) <= BROADCAST_BYTES:
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: r["wrapper"] for r in wrappers.toLocalIterator()})
        asked = asked.withColumn("_page", F.struct("host", "_html", F.lit(None).cast("string").alias("wrapper")))
    else:
        shared = None
        asked = asked.join(wrappers, "host", "left").withColumn("_page", F.struct("host", "_html", "wrapper"))

    def make() -> Callable[[list], list[pa.Array]]:
        memory: dict[str, Wrapper | None] = {}

        def known(host: str, wrapper: str | None) -> Wrapper | None:
            if host not in memory:
                if len(memory) >= HOSTS:
                    memory.clear()
                wrapper = shared.value.get(host) if shared is not None else wrapper
                memory[host] = Wrapper(restored(wrapper)) if wrapper else None
            return memory[host]

        def texts(rows: list) -> list[pa.Array]:
            sys.setrecursionlimit(1_000_000)
            out = [extract(r["_html"], known(r["host"], r["wrapper"])) for r in rows]
            return [pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())]

        return texts

    return with_arrow_columns(asked, "_page", fields, make, keep=["page_id", "url"])
