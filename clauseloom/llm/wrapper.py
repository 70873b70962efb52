"""HTML main-text extraction by wrapper induction.

Pages of one host are aligned with the host's reference page (that of the smallest id; one page a host), of which only the
skeleton is kept. DOM trees are reduced to labels (tag and class, numbers masked), with runs of equally labelled siblings
folded, and aligned by simple tree matching: the largest set of matched nodes that keeps order and ancestry. A node that
is matched is a slot of the reference; a node that is not (of another layout) is a slot of its own, named by its path.
Every different page then says which texts stand in which slot; members of a run speak one by one. A text that stands in
a slot on at least ``MIN_SAME`` of the pages that have the slot, and on ``MIN_PAGES`` or more, is constant: it is template,
on all pages of the host alike. What varies is content, as far as it lies in the page's main part.

Which part that is follows from the markup: article or main elements if there are any, else the body. Alignment cannot
tell what varies from page to page and still is no content (adverts, reader comments, related links); this is told by
tag, role, class and id.

Exact copies of a page vote once. Votes are counted per slot and text, partially by each task, so a host with a third of
all pages is no hot group. Each page is read in a streaming pass; trees and alignments live only as long as their page, an
alignment of equal skeletons is remembered (bounded).

Defined edge cases: a null or empty html gives an empty text; a null or odd url belongs to the host ''; a null page_id is
an id like any other; broken markup (unclosed or crossed elements, stray ends, cut-off tags) is parsed leniently; repeated
rows each keep a row; pages whose host has fewer than ``MIN_PAGES`` different pages lose nothing to templates; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import by_value, cut

MIN_PAGES = 4
MIN_SAME = 0.8
#: Bytes of reference skeletons, and of template texts' hashes, that are sent to all workers; beyond it they are joined by host.
MAX_BROADCAST = 64 << 20
#: More runs of siblings than this are folded by label, wherever they stand.
MAX_RUNS = 200

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object select".split())
NEVER = frozenset("head nav header footer aside form script style noscript template button select textarea title svg iframe object dialog menu label input".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
BAD_NAME = re.compile(r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|sponsor\w*|promo\w*|banner\w*|nav\w*|menu\w*|header|masthead|topbar|footer|sidebar\w*|side|aside|widget\w*|cookie\w*|consent|gdpr|notice\w*|popup|modal|newsletter|subscribe\w*|signup|login|form|search\w*|comment\w*|disqus|respon[ds]e?s?|replies|reviews?|share\w*|social\w*|related|recommend\w*|breadcrumb\w*|pagination|pager|skip\w*)(?=$|[\s_-])", re.I)
BAD_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(/?)>|<(?=[a-zA-Z/!?])[^<]*$", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
BLANK = re.compile(r"\s+")
NUMBER = re.compile(r"[0-9]+")


class Node:
    __slots__ = ("tag", "label", "bad", "template", "children", "parent")

    def __init__(self, tag: str, label: str, bad: bool, parent: Node | None):
        self.tag, self.label, self.bad, self.template, self.parent = tag, label, bad, False, parent
        self.children: list = []  # nodes and strings


def parse(page: str) -> Node:
    """A lenient tree: raw elements swallow text up to their end, <p> and <li> end where HTML says so."""
    root = here = Node("#", "#", False, None)
    at, lower = 0, None
    find = TOKEN.search
    while True:
        m = find(page, at)
        if m is None:
            if at < len(page):
                here.children.append(page[at:])
            return root
        if m.start() > at:
            here.children.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            node = here
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                # a stray end of an inline element does not close the blocks around it
                inner, crosses = here, False
                while inner is not node:
                    crosses = crosses or (tag in INLINE and inner.tag not in INLINE)
                    inner = inner.parent
                if not crosses:
                    here = node.parent
            continue
        if tag in CLOSES_P:
            node = here
            while node.tag in INLINE:
                node = node.parent
            if node.tag == "p":
                here = node.parent
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            node = here
            while node.tag in INLINE or node.tag == "p":
                node = node.parent
            if node.tag == tag or {node.tag, tag} in ({"dt", "dd"}, {"td", "th"}):
                here = node.parent
        name, style, bad = "", "", tag in NEVER
        if m[3]:
            given = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(m[3])}
            name, style = f"{given.get('class', '')} {given.get('id', '')}".strip(), NUMBER.sub("#", given.get("class", "").strip())
            bad = bad or bool(name and BAD_NAME.search(name)) or given.get("role", "").lower() in BAD_ROLE or "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
        if tag == "header" and any(x.tag == "article" for x in _up(here)):
            bad = bool(name and BAD_NAME.search(name))  # an article's own heading
        node = Node(tag, f"{tag}.{style}" if style else tag, bad, here)
        here.children.append(node)
        if tag in RAW:
            lower = page.lower() if lower is None else lower
            end = lower.find(f"</{tag}", at)
            if end < 0:
                return root
            at = page.find(">", end) + 1 or len(page)
        elif tag not in VOID and not m[4]:
            here = node


def _up(node: Node) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def text_of(parts: list[str]) -> str:
    return BLANK.sub(" ", entities.unescape("".join(parts))).strip()


def blocks(node: Node) -> list[str]:
    """Texts of the blocks under ``node`` in page order, without its bad parts; inline elements stay in their block."""
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        if held:
            t = text_of(held)
            if t:
                out.append(t)
            held.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            held.append(x)
        elif x is None:
            close()
        elif not x.bad or x is node:
            if x.tag not in INLINE:
                close()
                stack.append(None)
            # of a template, only the blocks inside stay
            stack += reversed(list(block_children(x)) if x.template else x.children)
    close()
    return out


def block_children(node: Node) -> Iterator[Node]:
    """The blocks right under ``node``, or under its inline elements."""
    stack = list(reversed(node.children))
    while stack:
        x = stack.pop()
        if not isinstance(x, str):
            if x.tag in INLINE:
                stack += reversed(x.children)
            else:
                yield x


def main_parts(root: Node) -> list[Node]:
    """The outermost good article elements, else main elements, else the body or the whole page."""
    for wanted in (("article",), ("main",), ("body",)):
        found, stack = [], [root]
        while stack:
            x = stack.pop()
            if x.bad:
                continue
            if x.tag in wanted:
                found.append(x)
            else:
                stack += reversed([c for c in x.children if not isinstance(c, str)])
        if found:
            return found
    return [root]


class Folded:
    """A tree of labels in which runs of equally labelled siblings are one node: ids in page order, children, members."""

    def __init__(self, page: str):
        self.root = parse(page)
        self.labels, self.kids, self.members = ["#"], [[]], [[self.root]]
        todo = [0]  # iterative, as broken pages nest deeply
        while todo:
            k = todo.pop()
            runs: list[list[Node]] = []
            for node in self.members[k]:
                for c in block_children(node):
                    if c.tag in RAW:
                        continue
                    if runs and runs[-1][0].label == c.label:
                        runs[-1].append(c)
                    else:
                        runs.append([c])
            if len(runs) > MAX_RUNS or len(self.members[k]) > 1:
                by_label: dict[str, list[Node]] = {}
                for r in runs:
                    by_label.setdefault(r[0].label, []).extend(r)
                runs = list(by_label.values())
            for r in runs:
                self.labels.append(r[0].label)
                self.kids.append([])
                self.members.append(r)
                self.kids[k].append(len(self.labels) - 1)
                todo.append(len(self.labels) - 1)

    def skeleton(self) -> str:
        return json.dumps([self.labels, self.kids], separators=(",", ":"))


def own_text(node: Node) -> int:
    """Hash of the text right under the node, without that of nested blocks; 0 if there is none."""
    import xxhash

    out, stack = [], list(reversed(node.children))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag in INLINE:
            stack += reversed(x.children)
    t = text_of(out)
    return xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1 if t else 0


def heaviest(pairs: list[tuple[int, int, int]], n: int) -> list[tuple[int, int]]:
    """Of (i, j, weight), those of the largest weight in sum whose i and j both rise; every j is below ``n``."""
    best = [(0, -1)] * (n + 1)  # by j, as a tree of maxima over prefixes
    kept: list[tuple[int, int, int, int]] = []
    for i, j, w in sorted(pairs, key=lambda p: (p[0], -p[1])):
        at, found = j, (0, -1)
        while at > 0:
            found = max(found, best[at])
            at -= at & -at
        kept.append((i, j, found[0] + w, found[1]))
        at = j + 1
        while at <= n:
            best[at] = max(best[at], (found[0] + w, len(kept) - 1))
            at += at & -at
    out, k = [], max(range(len(kept)), key=lambda k: kept[k][2], default=-1)
    while k >= 0:
        out.append(kept[k][:2])
        k = kept[k][3]
    return out


def matched(a_labels: list[str], a_kids: list[list[int]], b_labels: list[str], b_kids: list[list[int]]) -> list[tuple[int, int]]:
    """Simple tree matching of two trees from their roots: pairs of matched nodes.

    Only children of one label can match, so the best choice of a pair's children is the heaviest of rising pairs.
    """
    children: dict[tuple[int, int], list[tuple[int, int]]] = {}
    order = [(0, 0)]
    for x, y in order:  # pairs that could match, parents first
        place: dict[str, list[int]] = {}
        for j, v in enumerate(b_kids[y]):
            place.setdefault(b_labels[v], []).append(j)
        children[x, y] = [(i, j) for i, u in enumerate(a_kids[x]) for j in place.get(a_labels[u], ())]
        order += [(a_kids[x][i], b_kids[y][j]) for i, j in children[x, y]]
    size: dict[tuple[int, int], int] = {}
    for x, y in reversed(order):
        m, n = a_kids[x], b_kids[y]
        children[x, y] = heaviest([(i, j, size[m[i], n[j]]) for i, j in children[x, y]], len(n))
        size[x, y] = 1 + sum(size[m[i], n[j]] for i, j in children[x, y])
    pairs, stack = [], [(0, 0)]
    while stack:
        x, y = stack.pop()
        pairs.append((x, y))
        stack += [(a_kids[x][i], b_kids[y][j]) for i, j in children[x, y]]
    return pairs


class Aligner:
    """Names the slots of a page's nodes, remembering those of equal skeletons."""

    def __init__(self):
        self.slots: dict[tuple[str, str, str], list[int]] = {}

    def of(self, host: str, tree: Folded, reference: str) -> list[int]:
        import xxhash

        key = (host, tree.skeleton(), reference)
        if key not in self.slots:
            if len(self.slots) > 20_000:
                self.slots.clear()
            labels, kids = json.loads(reference)
            ref = dict(matched(tree.labels, tree.kids, labels, kids))
            names = [f"r{ref[0]}" if 0 in ref else "#"] + [""] * (len(tree.labels) - 1)
            for k, below in enumerate(tree.kids):  # parents come before their children
                for c in below:
                    names[c] = f"r{ref[c]}" if c in ref else f"{xxhash.xxh64_hexdigest(names[k].encode())}/{tree.labels[c]}"
            self.slots[key] = [xxhash.xxh64_intdigest(f"{host}\0{n}".encode("utf-8", "surrogatepass")) >> 1 for n in names]
        return self.slots[key]


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)", 1)), F.lit(""))


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) -> (host, reference)."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([Folded(page or "").skeleton() for page in batch.column(1).to_pylist()], pa.string())], ["host", "reference"])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html, reference) -> (host, slot, text, page): each page's different texts by slot, as hashes."""
    import xxhash

    aligner = Aligner()
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part, rows = batch.slice(at, 200), []
            for host, page, ref in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if page:
                    tree, name = Folded(page), xxhash.xxh64_intdigest(page.encode("utf-8", "surrogatepass")) >> 1
                    said = {(slot, own_text(node)) for slot, members in zip(aligner.of(host, tree, ref), tree.members, strict=True) for node in members}
                    rows += [(host, slot, text, name) for slot, text in said if text]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *[pa.array(c, pa.int64()) for c in columns[1:]]], ["host", "slot", "text", "page"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, host, html, reference, template: slots and texts in turn) -> (page_id, url, text, n_template)."""
    aligner, known = Aligner(), {}
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part, texts, counts = batch.slice(at, 200), [], []
            for host, page, ref, template in zip(*(c.to_pylist() for c in part.columns[2:]), strict=True):
                if not page:
                    texts.append("")
                    counts.append(0)
                    continue
                tree, n = Folded(page), 0
                if template:
                    if host not in known:
                        if len(known) > 2000:
                            known.clear()
                        known[host] = set(zip(template[::2], template[1::2], strict=True))
                    for slot, members in zip(aligner.of(host, tree, ref), tree.members, strict=True):
                        for node in members:
                            if (slot, own_text(node)) in known[host]:
                                node.template = True
                                n += 1
                texts.append(" ".join(t for p in main_parts(tree.root) for t in blocks(p)))
                counts.append(n)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], ["page_id", "url", "text", "n_template"])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, min_same: float = MIN_SAME, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """page_id, url, text, n_chars, n_template (blocks that alignment found to be template): one row per row of ``pages``."""
    read = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    # the smallest id (null ids last), of equal ids the smallest hash
    first = F.min(F.struct(F.isnull("page_id").alias("none"), "page_id", F.xxhash64("html").alias("tie")))
    chosen = read.filter(F.length("html") > 0).groupBy("host").agg(first.alias("f"))
    heads = read.select(F.col("host").alias("h2"), "page_id", F.xxhash64("html").alias("tie"), "html")
    few = chosen.count() * 4096 <= max_broadcast
    own = heads.join(F.broadcast(chosen) if few else chosen, (F.col("h2") == F.col("host")) & F.struct(F.isnull("page_id").alias("none"), "page_id", "tie").eqNullSafe(F.col("f")), "left_semi")
    refs = own.select(F.col("h2").alias("host"), "html").mapInArrow(_skeletons, "host string, reference string").groupBy(F.col("host").alias("h2")).agg(F.min("reference").alias("reference"))
    refs = cut(refs)
    small = (refs.agg(F.sum(F.octet_length("reference") + F.octet_length("h2") + 32)).first()[0] or 0) <= max_broadcast
    paired = read.join(F.broadcast(refs) if small else refs, F.col("host") == F.col("h2"), "left")
    votes = paired.filter(F.col("reference").isNotNull()).select("host", "html", "reference").mapInArrow(_votes, "host string, slot bigint, text bigint, page bigint").distinct()
    said = votes.groupBy("host", "slot", "text").agg(F.count("*").alias("same")).filter(F.col("same") >= min_pages)
    having = votes.select("slot", "page").distinct().groupBy(F.col("slot").alias("of")).agg(F.count("*").alias("pages"))
    template = said.join(having, F.col("slot") == F.col("of")).filter(F.col("same") >= min_same * F.col("pages"))
    # a slot has at most 1 / min_same texts that are constant, a run at most its members
    nodes = cut(template.groupBy(F.col("host").alias("h3")).agg(F.flatten(F.sort_array(F.collect_list(F.array("slot", "text")))).alias("template")))
    small = (nodes.agg(F.sum(8 * F.size("template") + F.octet_length("h3") + 32)).first()[0] or 0) <= max_broadcast
    both = paired.join(F.broadcast(nodes) if small else nodes, F.col("host") == F.col("h3"), "left").select("page_id", "url", "host", "html", "reference", "template")
    kind = pages.select(page_id).dtypes[0][1]
    done = both.mapInArrow(_texts, f"page_id {kind}, url string, text string, n_template bigint")
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template")


def op4_wrapper_induction(pages: DataFrame) -> DataFrame:
    return extract(pages)


by_value(__name__)
