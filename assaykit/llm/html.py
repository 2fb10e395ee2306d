"""Main text of HTML pages by composite text density.

For each node of the page's tree, C counts the characters of text below it, T the tags, LC and LT those inside
links. Its composite density is C / T x log_b(C x T / (LC x LT)) with base b = ln(C x LC / NLC + lc x C / c + e),
where NLC = C - LC and lc, c are those of the body: characters per tag, lowered where links hold much of the text.
The density sum of a node adds its children's densities. The node with the greatest sum holds the main text; the
least density on its path to the body is the threshold. article and main elements are evidence for density: where
together they hold a quarter or more of the body's unlinked text, the node is one in or on one of them.

What lies beside the path to the node is main text if links hold less than half of it, no class word speaks against
it, and it is a plain block (heading, paragraph, table, ...), lies in the innermost article on the path, is another
article beside that one, or some node in it reaches the threshold. Inside the node all text stays but bars of short
links to different places, and elements of which a class word says that they are something else and whose text
doesn't reach the threshold.

Elements that are never main text (scripts, menus, ...) are left out before, by their tag, and reader comments by the
words of their heading. Forms, and elements whose role or whole class or id names something else, go as well, but
for one: where no article or main element outside of them has text, the marked element with most unlinked text of
its own stays, with the marked elements around it, if that is more than all unlinked text outside of marked elements.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from assaykit.llm.common import map_batches

#: Elements by what they mean in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
DROPPED = set("head script style noscript noembed noframes template iframe nav header footer aside button select option optgroup datalist textarea input dialog menu".split())
BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a slash at the end of their start tag doesn't close; others (drawings, unknown ones) it does.
OPENED = BLOCKS | RAW | set("a abbr b bdi bdo button canvas cite code del dfn em font i ins kbd label map mark q s samp select small span strike strong sub sup template tt u var video audio".split())
#: An open element of the first kind is ended by a start tag of the second.
CLOSES = {
    "p": set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()),
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "optgroup": {"optgroup"},
    "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
    "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"},
}
#: Elements that are treated as marked, whatever their class.
ASKING = {"form", "fieldset"}
ROLES = set("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog toolbar".split())
#: Words of classes and ids for what isn't the article.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored promo nav navbar navigation menu menubar breadcrumb breadcrumbs masthead footer sidebar sidebars cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login sharing comment comments commentlist disqus pagination pager toolbar".split()
)
#: Those that mark any element of that name; the others mark containers only.
SIGNS = set("ad ads adv advert adverts advertisement advertising adbox adsense sponsored comment comments".split())
#: Words that mark a container outside of articles if all of its name are of these, of FRAMES or of GROUPS.
WEAK = set("header banner aside widget widgets related recommended notice notices overlay share social reply replies respond feedback skip copyright disclaimer promotion form search".split())
FRAMES, GROUPS = set("site page global top bottom main".split()), set("area bar block box buttons links list panel posts section wrapper".split())
#: Words that may stand beside one of MARKS in the name of what it marks.
BESIDE = WEAK | FRAMES | GROUPS | set("article body container content footer inner item left outer post primary right secondary slot text thread unit user wrap".split())
#: Words of a heading over reader comments, with any numbers.
REMARKS = set("comment comments reply replies response responses kommentar kommentare commentaire commentaires comentario comentarios réponses respuestas antworten".split())
ABOUT = REMARKS | set("a all add and der des die deja e el en et from join laisser leave les los of our post readers reader reader's show sur the to un und una user view viewer votre write your".split())
CONTAINERS = set("div section ul ol dl table form center td".split())
#: Elements that hold the page's article as a whole; a mark in their class is no reason to drop them.
KEPT = {"html", "body", "main", "article"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PLAIN = HEADINGS | set("p blockquote pre table figure figcaption hgroup address hr br".split())
LISTS = {"ul", "ol", "dl"}
#: A bar of links has so many, to different places, with less text than this in each on average.
BARS = LISTS | set("div section center".split())
BAR_LINKS, BAR_CHARS = 2, 25
#: What the node with the greatest sum may be; from others the way goes up.
HOLDERS = set("html body main article section div td center details".split())

#: A start tag as HTML reads it: attributes after white space or slashes, a quote opens a value only after `=`.
TOKEN = re.compile(
    r"""([^<]++)
    |<([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+)(?:>|\Z)
    |</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)
    |<!---?>|<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?/][^>]*+(?:>|\Z)
    |(<)""",
    re.S | re.X,
)
ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
SCRIPT = re.compile(r"<!--|-->|<(/?)script(?=[\s/>])", re.I)
BLANK = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "block", "items", "dropped", "marked", "suspect", "place", "chars", "tags", "link_chars", "link_tags", "density", "total", "peak")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, marked: bool = False, suspect: bool = False, place: str | None = None):
        self.tag, self.parent, self.dropped, self.marked, self.suspect, self.place = tag, parent, dropped, marked, suspect, place
        #: the innermost block that is open in this node, itself included
        self.block: Node = self if tag in BLOCKS or parent is None else parent.block
        self.items: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = self.peak = 0.0


def _mark(tag: str, names: str, article: bool) -> tuple[bool, bool]:
    """Whether a class or id says that an element isn't part of the article, and whether a word in it might say so."""
    suspect = False
    for name in names.lower().split():
        words = set(re.split(r"[^a-z0-9]+", name)) - {""}
        if words & MARKS:
            if words <= MARKS | BESIDE and (tag in CONTAINERS or words & SIGNS):
                return True, False
            suspect = True
        elif tag in CONTAINERS and words & WEAK and words <= WEAK | FRAMES | GROUPS:
            if not article:
                return True, False
            suspect = True
    return False, suspect


def _unwanted(tag: str, attributes: str, article: bool) -> tuple[bool, bool, bool, str | None]:
    """Whether an element is dropped, whether that is only for a mark, whether a word speaks against it, and where it
    links to."""
    if tag in DROPPED:
        return True, False, False, None
    marked, suspect, place = tag in ASKING, False, None
    if attributes and not attributes.isspace():
        for name, *values in ATTRIBUTE.findall(attributes):
            name = name.lower()
            if name not in ("role", "class", "id", "href") or name == "href" and tag != "a":
                continue
            value = html.unescape(values[0] or values[1] or values[2])
            if name == "href":
                place = place or value.strip()
            elif not marked and tag not in KEPT:
                if name == "role":
                    marked = value.strip().lower() in ROLES
                else:
                    marked, word = _mark(tag, value, article)
                    suspect = suspect or word
    return marked, marked, suspect, place


def _raw_end(page: str, tag: str, at: int) -> tuple[int, int]:
    """Where the raw text of an element ends, and where its end tag does. A script inside a comment inside a script has
    an end tag of its own."""
    if tag == "script":
        comment = nested = False
        for m in SCRIPT.finditer(page, at):
            if m[0] == "<!--":
                comment = True
            elif m[0] == "-->":
                comment = nested = False
            elif not m[1]:
                nested = comment
            elif nested:
                nested = False
            else:
                break
        else:  # never closed: a comment that doesn't end in it is taken as none
            m = re.compile("</script(?=[\\s/>])", re.I).search(page, at)
    else:
        m = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
    if not m:
        return len(page), len(page)
    close = page.find(">", m.end())
    return m.start(), len(page) if close < 0 else close + 1


def parse(page: str) -> Node:
    """A tree of the page; end tags that are missing or misplaced are put up with as browsers do it in the main."""
    root = node = Node("html", None)
    opened: Counter[str] = Counter()
    at, match = 0, TOKEN.match
    while at < len(page):
        m = match(page, at)
        at = m.end()
        text, tag, attributes, ended, data, sign = m.groups()
        if tag:
            tag = tag.lower()
            if tag == "html" or tag == "body" and opened["body"]:
                continue
            near = node.block  # what the start of this element ends, also through open inline elements
            while (ends := CLOSES.get(near.tag)) and tag in ends:
                while node is not near.parent:
                    opened[node.tag] -= 1
                    node = node.parent
                near = node.block
            child = Node(tag, node, *_unwanted(tag, attributes, opened["article"] + opened["main"] > 0))
            node.items.append(child)
            if tag in RAW:
                end, after = _raw_end(page, tag, at)
                if tag == "xmp":
                    child.items.append(page[at:end])
                at = after
            elif tag not in VOID and not (attributes.endswith("/") and tag not in OPENED):
                opened[tag] += 1
                node = child
        elif ended:
            ended = ended.lower()
            if ended in ("html", "body"):
                continue  # what follows belongs to the body still
            if opened[ended]:
                while node.tag != ended:
                    opened[node.tag] -= 1
                    node = node.parent
                opened[ended] -= 1
                node = node.parent
            elif ended == "p" or ended == "br":
                node.items.append(Node(ended, node))
        elif text:
            node.items.append(html.unescape(text))
        elif data or sign:
            node.items.append(data or sign)
    return root


def _path(node: Node | None) -> list[Node]:
    out = []
    while node is not None:
        out.append(node)
        node = node.parent
    return out


def _outermost(order: list[Node]) -> list[Node]:
    """The article and main elements that lie in no other; order has parents first."""
    within: set[Node | None] = set()
    out = []
    for x in order:
        if x.parent in within:
            within.add(x)
        elif x.tag in ("article", "main"):
            within.add(x)
            out.append(x)
    return out


def _size(text: str) -> int:
    return len("".join(text.split()))


def _spare(root: Node) -> None:
    """Take back the drop of the marked element that holds the main text, and of those around it."""
    own: dict[Node | None, int] = {None: 0}
    todo: list[tuple[Node, Node | None, bool, bool]] = [(root, None, False, False)]
    while todo:
        x, mark, linked, article = todo.pop()
        mark = x if x.marked else mark
        linked, article = linked or x.tag == "a", mark is None and (article or x.tag in ("article", "main"))
        n = 0 if linked else sum(_size(c) for c in x.items if isinstance(c, str))
        if n and article:
            return
        own[mark] = own.get(mark, 0) + n
        todo += [(c, mark, linked, article) for c in x.items if isinstance(c, Node) and (c.marked or not c.dropped)]
    outside = own.pop(None)
    best = max(own, key=own.get, default=None)
    if best is not None and own[best] > outside:
        for x in _path(best):
            if x.marked:
                x.dropped = x.marked = False


def _words(heading: Node) -> str:
    """The text of a heading, or nothing if it is longer than one over comments would be."""
    out, todo, seen, length = [], [heading], 0, 0
    while todo:
        x = todo.pop()
        seen += 1
        if isinstance(x, str):
            length += len(x)
            out.append(x)
        else:
            todo += reversed(x.items)
        if length > 100 or seen > 50:
            return ""
    return "".join(out)


def _is_remarks(heading: Node) -> bool:
    words = re.findall(r"[^\W\d_]+", _words(heading).lower())
    return not REMARKS.isdisjoint(words) and ABOUT.issuperset(words)


def _drop_remarks(order: list[Node]) -> None:
    """Drop reader comments: from their heading up to the next one of its rank, or the whole container that it heads."""
    for h in order:
        if h.tag in HEADINGS and not h.dropped and _is_remarks(h):
            first = h
            while first.parent is not None and first.parent.tag not in KEPT and next((c for c in first.parent.items if not isinstance(c, str) or c.strip()), None) is first:
                first = first.parent
            first.dropped = True
            if first is h and h.parent is not None:
                items = h.parent.items
                for c in items[next(k for k, c in enumerate(items) if c is h) + 1 :]:
                    if isinstance(c, Node):
                        if c.tag in HEADINGS and c.tag <= h.tag:
                            break
                        c.dropped = True


def _in_order(root: Node) -> list[Node]:
    """Nodes that aren't dropped, parents first; no recursion, as pages nest deeply."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        if not x.dropped:
            order.append(x)
            todo += [c for c in x.items if isinstance(c, Node)]
    return order


def densities(root: Node) -> list[Node]:
    """Fill in counts, densities and sums; returns the nodes."""
    order = _in_order(root)
    for x in reversed(order):
        for c in x.items:
            if isinstance(c, str):
                x.chars += _size(c)
            elif not c.dropped:
                x.chars += c.chars
                x.tags += c.tags + 1
                x.link_chars += c.link_chars
                x.link_tags += c.link_tags + (c.tag == "a")
        if x.tag == "a":
            x.link_chars = x.chars
    body = next((x for x in order if x.tag == "body"), root)
    share = body.link_chars / max(1, body.chars)
    for x in order:
        if x.chars:
            c, t, lc, lt = x.chars, max(1, x.tags), max(1, x.link_chars), max(1, x.link_tags)
            base = math.log(c * lc / max(1, c - x.link_chars) + share * c + math.e)
            x.density = c / t * math.log(c * t / (lc * lt) + 1e-9) / math.log(base) if base > 1 else c / t
            x.density = max(0.0, x.density)
    for x in reversed(order):
        children = [c for c in x.items if isinstance(c, Node) and not c.dropped]
        x.total = sum(c.density for c in children)
        x.peak = max([x.density, *(c.peak for c in children)])
    return order


def _beside(parent: Node, path: set[Node], threshold: float, article: bool) -> set[Node]:
    """The children of a node on the path that aren't main text; article tells whether it is (in) the innermost article."""
    children = [c for c in parent.items if isinstance(c, Node) and not c.dropped and (c.chars or c in path)]
    beside_article = any(c in path and c.tag == "article" for c in children)
    out = set()
    for c in children:
        if c not in path:
            plain = article or c.tag in PLAIN or c.tag not in BLOCKS or beside_article and c.tag == "article"
            doubtful = not plain or c.suspect and (not article or c.tag in CONTAINERS)
            if c.link_chars * 2 >= c.chars or doubtful and c.peak < threshold:
                out.add(c)
    for c, after in reversed(list(zip(children, [*children[1:], None]))):
        if c.tag in HEADINGS and after in out:  # the heading of what goes, goes with it
            out.add(c)
    return out


def _inside(top: Node, path: set[Node], threshold: float) -> set[Node]:
    """Nodes within the chosen one that aren't main text after all: bars of links, and what a word and density speak against."""
    out: set[Node] = set()
    places: dict[Node, set] = {}
    for x in reversed(_in_order(top)):
        own = places.pop(x, set())
        if x.tag == "a" and x.chars:
            own.add(x.place if x.place and x.place != "#" else x)
        if x is top or x in path:
            continue
        up = places.setdefault(x.parent, set())
        for place in own:
            if len(up) < BAR_LINKS:  # more are not asked for
                up.add(place)
        bar = x.tag in BARS and len(own) >= BAR_LINKS and x.link_chars * 4 >= x.chars * 3 and x.link_chars < BAR_CHARS * x.link_tags
        if bar or x.suspect and x.tag in CONTAINERS and (x.link_chars * 2 >= x.chars or x.peak < threshold):
            out.add(x)
    for x in list({c.parent: c for c in out}):
        children = [c for c in x.items if isinstance(c, Node) and not c.dropped and c.chars]
        out |= {c for c, after in zip(children, children[1:]) if c.tag in HEADINGS and after in out}
    return out


def _blocks(root: Node, left_out: set[Node]) -> list[str]:
    """Texts of the blocks below a node, in page order."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = BLANK.sub(" ", "".join(run)).strip()
        if text:
            out.append(text)
        run.clear()

    todo: list = [root]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag in BLOCKS:
            end()
            if not (x.dropped or x in left_out):
                todo.append(None)
                todo.extend(reversed(x.items))
        elif not (x.dropped or x in left_out):
            todo.extend(reversed(x.items))
    end()
    return out


def main_text(page: str | None) -> str:
    """The article's text: its blocks, one in a line. A page without text gives the empty text."""
    root = parse(page or "")
    _spare(root)
    _drop_remarks(_in_order(root))
    order = densities(root)
    body = next((x for x in order if x.tag == "body"), root)
    if not body.chars:
        body = root
    inside = [x for x in _in_order(body) if x.chars]
    if not inside:
        return ""
    outer = _outermost(inside)
    enough = sum(x.chars - x.link_chars for x in outer) * 4 >= body.chars - body.link_chars
    held = [y for x in outer for y in _in_order(x) if y.chars] if enough else []
    best = max(held or inside, key=lambda x: x.total)
    while best is not body and best.tag not in HOLDERS:
        best = best.parent  # a paragraph or list isn't an article by itself
    way = _path(best)
    way = way[: way.index(body) + 1]
    threshold = min(x.density for x in way)
    path = set(way)
    last = next((k for k, x in enumerate(way) if x.tag == "article"), -1)  # up to here the way is in an article
    left_out = _inside(best, path, threshold)
    for k, x in enumerate(way[1:], 1):
        left_out |= _beside(x, path, threshold, k <= last)
    if best is body:  # nothing around it to tell menus by: lists and boxes of links go, linked paragraphs stay
        left_out |= {c for c in _beside(body, path, 0.0, False) if c.tag not in ("p", "a")}
    return "\n".join(_blocks(body, left_out))


def extract(pages: DataFrame, page: str = "html") -> DataFrame:
    """(page_id, url, text) of each row; a null or empty page has the empty text, and an empty table gives no rows.

    Repeated rows stay; other columns don't matter. Long, deep and broken pages take time and memory in proportion to
    their length; nothing of them is cut off.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pa.array([main_text(p) for p in batch.column(2).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["page_id", "url", "text"])

    return map_batches(pages.select("page_id", "url", page), run, "page_id bigint, url string, text string")
