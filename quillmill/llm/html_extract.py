"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text blocks below them. The best one is widened to the article around it: its
nearest `article` or `main`, else ancestors that are named like content or hold the heading, as long as what they add is not
mostly links. The page votes for the generalised tag-class path of the result; Spark adds the votes up for each host, and
every page is extracted again from the elements on its host's winning path. A page without such elements, or where they hold
less than half of what its own best container holds, falls back on that; pages without a host do not vote and do the same.

Scripts, navigation, footers and controls go whatever they hold. A class or id with a word such as `sidebar`, or a form, only
suggests that an element is not the article: it stays if it holds the `main` or h1 and a fifth of the page's text outside
links. A form also stays if it holds half of that text, and so does an element with such a word, unless it speaks of reader
comments, on a page with neither `main` nor h1. Words of a layout, such as `has-sidebar`, suggest nothing.

No step recurses and none is more than linear in the page, however deep it is nested.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, map_rows

# Element names of HTML and the words by which sites name what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select xmp".split())
DROPPED = frozenset("nav footer aside button dialog menu header head".split()) | RAW
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article body center div main section table tbody td tr".split())
CLOSED_BY = {"p": frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}
SCOPES = frozenset("article aside body div dl form header footer html main nav ol section table td ul".split())
UNWANTED = re.compile(r"(?:^|[-_ ])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|side-?bar\w*|menu\w*|nav|navbar|navigation|breadcrumbs?|pagination|pager|masthead|site-?header|page-?header|footer\w*|cookies?\w*|consent|gdpr|notice\w*|alert\w*|popup\w*|modal\w*|overlay|newsletter\w*|subscri\w*|sign-?up|login|share|sharing|social\w*|related\w*|recommend\w*|widget\w*|skip-?link|toolbar|tags?-?list|author-?box)(?:$|[-_ ])", re.I)
COMMENTS = re.compile(r"(?:^|[-_ ])(?:comments?|comment-?list|respond|disqus\w*)(?:$|[-_ ])", re.I)
LAYOUT = re.compile(r"(?<!\S)(?:(?:has|with|without|no|hide|show|is)[-_]\S*|\S*[-_](?:enabled|disabled|open|closed|active|visible|hidden|left|right|layout|page))(?!\S)", re.I)
WANTED = re.compile(r"article|content|entry|main|post|story|text|body", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Hosts up to which the winning paths are sent to every executor (some 10 MB); beyond, the join is salted.
BROADCAST_HOSTS, SALTS = 100_000, 64
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


@dataclass(slots=True)
class Node:
    tag: str
    names: str
    step: str  # its part of the path; empty where it has none
    parent: Node | None
    up: Node | None  # nearest container above
    key: int  # hash of the path
    dropped: bool
    unlikely: int  # what suggests that it is not the article: 1 its tag, 2 its names, 3 names of comments
    article: bool  # is or stands in an article or main
    score: float = 0.0
    own: int = 0  # characters of text directly in it
    size: int = 0  # characters of its block: of its own and of what is no block below
    linked: int = 0
    total: int = 0  # characters below it that are not dropped, and those of them in links
    total_linked: int = 0
    mass: int = 0  # characters below it outside links and of what is dropped by its tag
    holds: bool = False  # whether a main or h1 stands below
    blocks: bool = False  # whether a block stands below
    heading: bool = False  # whether an h1 stands below
    parts: list = field(default_factory=list)  # strings and Nodes in page order


_CLOSES = {tag: [c for c, by in CLOSED_BY.items() if tag in by] for tag in frozenset().union(*CLOSED_BY.values())}
_INLINE = frozenset("p li b i a span em strong".split())


class _Open:
    """The open elements: a stack that knows where each tag and each scope was opened last."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append(node)

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in SCOPES:
                self.scopes.pop()

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else 0

    def scope(self) -> int:
        return self.scopes[-1] if self.scopes else 0


def parse(source: str) -> list[Node]:
    """The nodes of the page in page order, the first being the page itself; tags that are never closed end where HTML ends them."""
    root = Node("", "", "", None, None, 0, False, 0, False)
    nodes, at, opened = [root], 0, _Open(root)
    while True:
        m = _TOKEN.search(source, at)
        text = source[at : m.start()] if m else source[at:]
        if text:
            text = html.unescape(text) if "&" in text else text
            top = opened.stack[-1]
            top.parts.append(text)
            top.own += len(text.strip())
        if not m:
            _drop(nodes)
            return nodes
        at = m.end()
        closing, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if (place := opened.last(tag)) and not (tag in _INLINE and opened.scope() > place):
                opened.cut(place)
            continue
        if tag in _CLOSES and (place := max(map(opened.last, _CLOSES[tag]))) and place >= opened.scope():
            opened.cut(place)
        names = " ".join(a or b or c for _, a, b, c in _NAMES.findall(rest)) if rest else ""
        parent = opened.stack[-1]
        step = ""
        if tag in CONTAINERS or tag in SCOPES:
            kind = re.sub(r"\d+", "#", re.sub(r"[^\w-]", "_", _first_class(rest))) if rest else ""
            step = f"{tag}.{kind}" if kind else tag
        own = tag in ("article", "main")
        dropped = tag in DROPPED and not (tag == "header" and parent.article)
        unlikely = int(tag == "form")
        if names and not own and tag not in ("body", "html") and (said := LAYOUT.sub("", names)):
            unlikely = 3 if COMMENTS.search(said) else 2 if UNWANTED.search(said) else unlikely
        node = Node(tag, names, step, parent, parent if parent.tag in CONTAINERS else parent.up, hash((parent.key, step)) if step else parent.key, dropped, unlikely, parent.article or own)
        parent.parts.append(node)
        nodes.append(node)
        if tag in VOID or rest.rstrip().endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        opened.push(node)


def _drop(nodes: list[Node]) -> None:
    """Settle what is dropped, once it is known what each element holds; all below goes with it."""
    for node in reversed(nodes):
        if (above := node.parent) is not None and not node.dropped:
            if node.tag != "a":
                above.mass += node.mass + node.own
            above.holds |= node.holds or node.tag in ("main", "h1")
    page = nodes[0].mass + nodes[0].own
    for node in nodes[1:]:
        mass = node.mass + node.own
        wrapper = 5 * mass >= page and node.holds or 2 * mass >= page and (node.unlikely == 1 or node.unlikely == 2 and not nodes[0].holds)
        node.dropped |= node.parent.dropped or bool(node.unlikely) and not (mass and wrapper)


def _first_class(rest: str) -> str:
    for name, a, b, c in _NAMES.findall(rest):
        if name.lower() == "class":
            return ((a or b or c).split() or [""])[0]
    return ""


def path_of(node: Node | None) -> str:
    steps = []
    while node is not None:
        if node.step:
            steps.append(node.step)
        node = node.parent
    return ">".join(reversed(steps))


def _key_of(path: str) -> int:
    key = 0
    for step in path.split(">"):
        key = hash((key, step))
    return key


def score(nodes: list[Node]) -> list[Node]:
    """Containers with text below them, scored: a block counts for its own container in full and for the next one by half."""
    found: dict[int, Node] = {}
    for node in reversed(nodes):  # what stands below a node comes after it
        if node.dropped:
            if node.parent is not None:
                node.parent.blocks = True
            continue
        node.size += node.own
        node.total += node.own
        block = node.tag in BLOCKS
        if block and node.size:
            worth = (1 + min(node.size / 100, 5)) * (1 - node.linked / node.size)
            owner = node if node.tag in CONTAINERS and node.blocks else node.up
            for share in (1.0, 0.5):
                if owner is not None:
                    owner.score += share * worth
                    found[id(owner)] = owner
                    owner = owner.up
        if (above := node.parent) is not None:
            link = node.tag == "a"
            if not (block or node.blocks):
                above.size += node.size
                above.linked += node.size if link else node.linked
            above.blocks |= block or node.blocks
            above.total += node.total
            above.total_linked += node.total if link else node.total_linked
            above.heading |= node.heading or node.tag == "h1"
    for node in found.values():
        node.score *= (1.5 if node.tag in ("article", "main") else 1.0) * (1.2 if node.names and WANTED.search(node.names) else 1.0)
    return list(found.values())


def widened(best: Node) -> Node:
    """The article around the best container: see above."""
    node = best
    while node is not None and node.tag not in ("article", "main"):
        node = node.up
    if node is not None:
        return node
    node = best
    while (above := node.up) is not None and above.tag != "body":
        more, links = above.total - node.total, above.total_linked - node.total_linked
        wanted = above.names and WANTED.search(above.names) or above.heading and not node.heading
        if more and not (wanted and links <= 0.3 * more):
            break
        node = above
    return best if node.total == best.total else node


def text_of(node: Node) -> str:
    """Blocks in page order: white space made one blank, trimmed, joined by one blank."""
    out: list[str] = []
    walks = [iter(node.parts)]
    edges = [False]
    while walks:
        for part in walks[-1]:
            if isinstance(part, str):
                out.append(part)
            elif not part.dropped:
                edge = part.tag in BLOCKS
                if edge:
                    out.append("\n")
                walks.append(iter(part.parts))
                edges.append(edge)
                break
        else:
            walks.pop()
            if edges.pop():
                out.append("\n")
    return " ".join("".join(out).split())


def own_container(nodes: list[Node]) -> Node:
    """The page's best container, widened; the page itself where it has none."""
    best = max(score(nodes), key=lambda n: n.score, default=None)
    return nodes[0] if best is None else widened(best)


def vote(source: str) -> tuple[str, float]:
    """Path and score of the page's own container; empty for a page without text."""
    node = own_container(parse(source))
    return (path_of(node), node.score) if node.parent is not None else ("", 0.0)


def extract(source: str, path: str | None) -> tuple[str, str]:
    """The text below the host's winning path, or below the page's own container, and the path used."""
    nodes = parse(source)
    best = own_container(nodes)
    if path:
        key, texts, size = _key_of(path), [], 0
        for node in nodes:  # in page order; elements on one path never stand in each other
            if node.key == key and node.step and node.tag in CONTAINERS and not node.dropped and path_of(node) == path:
                texts.append(text_of(node))
                size += node.total
        if 2 * size >= best.total and (text := " ".join(filter(None, texts))):
            return text, path
    return text_of(best), path_of(best)


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path) that wins each host's vote: most pages, then the higher sum of scores, then the smaller path; none for no host."""

    def each(batch: pa.RecordBatch):
        votes: dict[tuple, list] = {}
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            path, worth = vote(source or "") if host else ("", 0.0)
            if path:
                own = votes.setdefault((host, path), [0, 0.0])
                own[0] += 1
                own[1] += worth
        keys = list(votes)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([votes[k][0] for k in keys], pa.int64()), pa.array([votes[k][1] for k in keys], pa.float64())], ["host", "path", "n", "score"])

    votes = map_rows(pages.select(host_of(url_col).alias("host"), html_col), each, "host string, path string, n long, score double")
    totals = votes.groupBy("host", "path").agg(F.sum("n").alias("n"), F.round(F.sum("score"), 3).alias("score"))
    return totals.groupBy("host").agg(F.min(F.struct(-F.col("n"), -F.col("score"), "path")).alias("best")).select("host", F.col("best.path").alias("path"))


def host_of(url_col: str):
    """The host in lower case; empty where the address is null or has none."""
    return F.lower(F.coalesce(F.regexp_extract(url_col, _HOST, 1), F.lit("")))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars, path) of each page. A null page has an empty text; rows that repeat each keep their own.

    Of attributes given twice the first class names the path; a quote that is never closed ends with its tag.
    """
    winners = cut_lineage(host_paths(pages, url_col, html_col)).select(F.col("host").alias("__host"), F.col("path").alias("__path"))
    keyed = pages.select(F.col(id_col), F.col(url_col), F.col(html_col), host_of(url_col).alias("__key"))
    at_host = F.col("__key") == F.col("__host")
    if winners.count() <= BROADCAST_HOSTS:
        joined = keyed.join(F.broadcast(winners), at_host, "left")
    else:  # one host may have a third of all pages: its pages are dealt out by salt, its one row is copied
        salted = winners.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("__salt", F.pmod(F.xxhash64(id_col, url_col), F.lit(SALTS)).cast("int")).join(salted, at_host & (F.col("__salt") == F.col("__copy")), "left")
    rows = joined.select(id_col, url_col, html_col, "__path")

    def each(batch: pa.RecordBatch):
        found = [extract(source or "", path) for source, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        texts, paths = ([f[k] for f in found] for k in (0, 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), pa.array(paths, pa.string())], [id_col, url_col, "text", "n_chars", "path"])

    kind = rows.schema[id_col].dataType.simpleString()
    return map_rows(rows, each, f"{id_col} {kind}, {url_col} string, text string, n_chars long, path string")
