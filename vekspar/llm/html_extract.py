"""Main text of web pages by template deduction over equivalence classes.

1. Tokens of a page are its block tags, each with its path in the document (siblings of one
   name are numbered), and its blocks of text with theirs. For each token of a host, all pages
   of the host give its occurrence vector: on how many pages it stands, how often, and the
   exclusive or of a hash of (page, number) over the pages, which tells vectors apart. These
   are sums, combined before the shuffle, so a host may hold any share of all pages.
2. Tokens with one vector form an equivalence class. Classes of `size` tokens or more that
   stand on `support` pages or more, and on a share of the host's pages, are valid. The class
   that stands once on most pages is the root; others belong to the template if they nest, by
   the mean places of their tokens, in the span of a class before them. Each host has one
   template; its size is bounded by the shares.
3. The template says where the content is: the deepest tag that stands once on a page and
   holds most running text of all pages of the host (an article or main part needs less). The
   root's tokens cut a page into slots; on each page those count that keep the template's
   order. Text in the slots between the content tag's tokens is the page's text, less blocks
   that belong to the template.

Names of tags and classes only break ties: tags that are never text (nav, form and the like)
go, and a container inside the content whose name alone says that it is no text goes only if
its links or the template say so too. Pages of hosts with too few pages, and pages without
their host's content tag, are judged by their own containers. Template text goes only where
it is at most half of a page's text, so copies of an article keep theirs.

Defined results: a null or empty page has an empty text and is no page of its host; a null url
is a host of its own; repeated rows stay; text outside every block counts as a block; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mapped, pick, slices

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=[A-Za-z/])[^<>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "noframes", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Containers that are never main text.
_ASIDE = {"nav", "aside", "footer", "form", "menu", "dialog", "button", "select", "option", "label", "head", "object", "canvas", "audio", "video", "fieldset"}
_ASIDE_WORD = re.compile(
    r"(?:^|\s)(?:ads?|advert|adverts|advertisement|advertisements|advertising|adsense|ad[_-](?:box|slot|unit|banner|container|wrapper)|sponsor|sponsors|sponsored|promo|promos|banner|banners|cookies?|cookie[_-](?:notice|banner|bar|consent)|consent|gdpr|nav|navbar|navigation|(?:site|main|top|page|post)[_-]nav(?:igation)?|menus?|(?:site|main|top)[_-]menu|breadcrumbs?|side-?bar|footer|(?:site|page)[_-]footer|mast-?head|(?:site|page)[_-]header|header|top-?bar|comments?|comment[_-](?:list|form)|disqus(?:_thread)?|share|sharing|(?:share|social)[_-](?:buttons?|links?|icons?|bar|media)|related|related[_-](?:posts?|articles?|links?)|newsletter|subscribe|signup|login|popup|modal|overlay|widgets?|toolbar|pagination|pager|tagcloud|byline|copyright|skip-?link|search[_-](?:form|box|bar)|contentinfo|complementary)(?=$|\s)",
    re.I,
)
#: What a name alone says of a container inside an article holds only with at least so much of its text in links.
_LINKED = 0.5
_MAIN_WORD = re.compile(r"(?:^|[\s_-])(?:articlebody|article-?(?:body|content|text)|post-?(?:body|content|text)|entry-?(?:content|text)|story-?(?:body|content|text)|main-?(?:content|text))(?=$|[\s_-])", re.I)
#: Blocks that are text rather than containers.
_TEXT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "blockquote", "pre", "dt", "dd", "dl", "td", "th", "tr", "tbody", "table", "figcaption", "summary", "address"}
#: What an opening tag closes: a new paragraph or item ends an open one up to these containers.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


@dataclass
class Block:
    text: str
    path: str
    aside: bool
    article: bool
    linked: int
    at: int  # place of its token
    inside: tuple[int, ...]  # places of the tags around it
    named: int = 0  # number of the container inside an article whose name alone says that it is no text; 0: none


@dataclass
class Page:
    tokens: list[str] = field(default_factory=list)  # block tags and texts with their paths, in order
    main: set[int] = field(default_factory=set)  # places of tags that call their content the main part
    blocks: list[Block] = field(default_factory=list)


def parse(source: str) -> Page:
    """Tokens and blocks of text of a page, however broken its markup."""
    page, stack = Page(), []  # of (tag, path, place of its token, names of its children so far, aside, article, link, named)
    text: list[str] = []
    state = (False, False, False, 0)
    top: dict[str, int] = {}
    linked = 0

    def flush() -> None:
        nonlocal linked
        joined = " ".join("".join(text).split())
        if joined:
            path = stack[-1][1] if stack else ""
            page.blocks.append(Block(joined, path, state[0], state[1], linked, len(page.tokens), tuple(s[2] for s in stack if s[0] in _BLOCK), state[3]))
            page.tokens.append(f"{path}\0{joined}")
        text.clear()
        linked = 0

    def put(raw: str) -> None:
        nonlocal linked
        decoded = html.unescape(raw)
        text.append(decoded)
        if state[2]:
            linked += len(decoded.strip())

    def close(count: int) -> None:
        nonlocal state
        if any(s[0] in _BLOCK for s in stack[-count:]):
            flush()
        del stack[-count:]
        state = stack[-1][4:] if stack else (False, False, False, 0)

    at, end = 0, len(source)
    while at < end:
        m = _TOKEN.search(source, at)
        if m is None:
            put(source[at:])
            break
        if m.start() > at:
            put(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                put(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            depth = next((i for i, s in enumerate(reversed(stack)) if s[0] == tag), -1)
            if depth >= 0 and (tag in _BLOCK or not any(s[0] in _BLOCK for s in stack[len(stack) - depth :])):
                path = stack[len(stack) - depth - 1][1]
                close(depth + 1)
                if tag in _BLOCK:
                    page.tokens.append(f"/{path}")
            elif tag in _BLOCK:
                flush()
            continue
        if tag == "br":
            text.append("\n")
            continue
        if tag in _BLOCK:
            flush()
            if tag in _CLOSES:
                inner, limits = _CLOSES[tag]
                for i, s in enumerate(reversed(stack)):
                    if s[0] in limits:
                        break
                    if s[0] in inner:
                        close(i + 1)
                        break
            else:
                for i, s in enumerate(reversed(stack)):  # an open paragraph holds no other block
                    if s[0] == "p":
                        close(i + 1)
                    elif s[0] in _BLOCK:
                        break
                    else:
                        continue
                    break
        if tag in _RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            at = stop.end() if stop else end
            continue
        if tag in _VOID or m[3].rstrip().endswith("/"):
            continue
        names = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in _ATTRIBUTE.finditer(m[3])} if m[3] else {}
        words = " ".join(names.get(k, "") for k in ("class", "id", "role", "itemprop")).strip()
        main = tag in ("article", "main") or names.get("role") == "main" or bool(words and _MAIN_WORD.search(words))
        inside = state[1] or main
        aside = state[0] or tag in _ASIDE or "hidden" in names or names.get("aria-hidden") == "true"
        if tag == "header" and not state[1]:
            aside = True
        named = state[3]
        if not aside and words and not main and tag not in ("html", "body") and _ASIDE_WORD.search(words):
            if inside:
                named = named or len(page.tokens) + 1
            else:
                aside = True
        path = stack[-1][1] if stack else ""
        place = len(page.tokens)
        if tag in _BLOCK:
            label = f"/{tag}.{words}" if words else f"/{tag}"
            if tag not in _TEXT:
                around = next((s[3] for s in reversed(stack) if s[0] in _BLOCK), top)
                around[label] = around.get(label, 0) + 1
                label = f"{label}~{around[label]}" if around[label] > 1 else label
            path += label
            page.tokens.append(path)
            if main:
                page.main.add(place)
        stack.append((tag, path, place, {}, aside, inside, state[2] or tag == "a", named))
        state = stack[-1][4:]
    flush()
    return page


# --- Templates ---------------------------------------------------------------------------

STAT = "host string, token long, pages long, total long, vector long, place double, running long, depth int, kind int"
#: Kinds of tokens.
OTHER, TAG, MAIN, TEXT = range(4)
_MASK = (1 << 64) - 1


def token_id(token: str) -> int:
    """A token as a signed number; 0 stands for the page itself."""
    x = xxhash.xxh3_64_intdigest(token)
    return x - (1 << 64) if x >> 63 else x


def _spread(row: int, n: int) -> int:
    x = (row * 0x9E3779B97F4A7C15 + n * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9) & _MASK
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & _MASK
    x ^= x >> 31
    return x - (1 << 64) if x >> 63 else x


def _running(b: Block) -> int:
    """Characters of running text: links don't count."""
    return 0 if b.aside or b.linked * 2 > len(b.text) else len(b.text)


class Occurrences:
    """What the pages of hosts say of their tokens; pages of one host may be counted in several places."""

    def __init__(self) -> None:
        self.found: dict[tuple[str, int], list] = {}

    def add(self, host: str, row: int, page: Page) -> None:
        """row tells pages apart. A page without tokens doesn't count."""
        if not page.tokens:
            return
        first: dict[str, int] = {}
        many: Counter = Counter(page.tokens)
        for i, t in enumerate(page.tokens):
            first.setdefault(t, i)
        running: Counter = Counter()
        total, texts = 0, set()
        for b in page.blocks:
            n = _running(b)
            texts.add(b.at)
            total += n
            for i in b.inside:
                running[page.tokens[i]] += n
        vectors = {n: _spread(row, n) for n in set(many.values())}
        self._put(host, 0, (1, 1, vectors.get(1) or _spread(row, 1), 0.0, total, 0, OTHER))
        for t, n in many.items():
            i = first[t]
            kind = TEXT if i in texts else OTHER if t.startswith("//") else MAIN if i in page.main else TAG
            self._put(host, token_id(t), (1, n, vectors[n], float(i), running[t], t.count("/"), kind))

    def _put(self, host: str, token: int, of: tuple) -> None:
        held = self.found.get((host, token))
        if held is None:
            self.found[host, token] = list(of)
        else:
            held[0] += 1
            held[1] += of[1]
            held[2] ^= of[2]
            held[3] += of[3]
            held[4] += of[4]

    def rows(self) -> pa.RecordBatch:
        columns = list(zip(*((*k, *v) for k, v in self.found.items()), strict=True)) or [[]] * 9
        kinds = [pa.string(), *[pa.int64()] * 4, pa.float64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in STAT.split(", ")])


@dataclass
class EquivalenceClass:
    tokens: list[int]  # in the order of their places
    pages: int
    once: bool  # once on each of its pages
    span: tuple[float, float]
    parent: int = -1


@dataclass
class Template:
    classes: list[EquivalenceClass] = field(default_factory=list)  # valid and nested; classes[0] is the root
    texts: frozenset[int] = frozenset()  # blocks of text that belong to it
    content: int = 0  # the content's tag; 0: none

    @property
    def root(self) -> list[int]:
        return self.classes[0].tokens if self.classes else []


def deduce(stats: pa.Table, support: int = 3, size: int = 2, share: float = 0.1, texts_share: float = 0.6, most: float = 0.7, least: float = 0.3) -> Template:
    """The template of one host from the sums over all of its pages."""
    s = {c: stats.column(c).to_pylist() for c in ("token", "pages", "total", "vector", "place", "running", "depth", "kind")}
    if 0 not in s["token"]:
        return Template()
    own = s["token"].index(0)
    n, running = s["pages"][own], s["running"][own]
    groups: dict[tuple[int, int, int], list[int]] = defaultdict(list)
    for i, t in enumerate(s["token"]):
        if t and s["pages"][i] >= max(support, share * n):
            groups[s["vector"][i], s["pages"][i], s["total"][i]].append(i)
    mean, classes = [p / c for p, c in zip(s["place"], s["pages"], strict=True)], []
    for (_, pages, total), members in groups.items():
        if len(members) >= size:
            members.sort(key=lambda i: (mean[i], s["token"][i]))
            classes.append((EquivalenceClass([s["token"][i] for i in members], pages, pages == total, (mean[members[0]], mean[members[-1]])), members))
    classes.sort(key=lambda c: (not c[0].once, -c[0].pages, -len(c[0].tokens), c[0].tokens[0]))
    if not classes or not classes[0][0].once:
        return Template()
    kept: list[EquivalenceClass] = []
    members_of: list[list[int]] = []
    for c, members in classes:
        c.parent = next((p for p in range(len(kept) - 1, -1, -1) if kept[p].span[0] <= c.span[0] and c.span[1] <= kept[p].span[1]), -1)
        if not kept or c.parent >= 0:
            kept.append(c)
            members_of.append(members)
    texts = frozenset(s["token"][i] for m in members_of for i in m if s["kind"][i] == TEXT and s["pages"][i] >= texts_share * n)
    tags = [i for c, m in zip(kept, members_of, strict=True) if c.once and 2 * c.pages > n for i in m if s["kind"][i] in (TAG, MAIN)]
    held = [i for i in tags if s["kind"][i] == MAIN and s["running"][i] >= least * running and running]
    if held:
        best = max(s["running"][i] for i in held)
        held = [i for i in held if s["running"][i] >= most * best]
    else:
        held = [i for i in tags if s["running"][i] >= most * running and running]
    if not held:
        return Template(kept, texts)
    content = max(held, key=lambda i: (s["depth"][i], s["running"][i], s["token"][i]))
    return Template(kept, texts, s["token"][content])


def slots(tokens: list[int], template: Template) -> list[int]:
    """For each token of a page the number of the root's tokens up to it, of those that keep the template's order."""
    order = {t: i for i, t in enumerate(template.root)}
    found = [(order[t], at) for at, t in enumerate(tokens) if t in order]
    places = [i for i, _ in found]
    if any(a >= b for a, b in zip(places, places[1:])):
        found = [found[i] for i in _longest(places)]
    out, k = [], 0
    for at in range(len(tokens)):
        if k < len(found) and found[k][1] == at:
            k += 1
        out.append(found[k - 1][0] + 1 if k else 0)
    return out


def _longest(places: list[int]) -> list[int]:
    """Indices of a longest increasing run of places."""
    tails: list[int] = []
    before: list[int] = []
    for i, p in enumerate(places):
        low, high = 0, len(tails)
        while low < high:
            mid = (low + high) // 2
            if places[tails[mid]] < p:
                low = mid + 1
            else:
                high = mid
        before.append(tails[low - 1] if low else -1)
        tails[low : low + 1] = [i]
    out, i = [], tails[-1] if tails else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


# --- Extraction --------------------------------------------------------------------------


def _container(blocks: list[Block], most: float = 0.7) -> str:
    """The deepest path, with a slash at its end, whose blocks hold most of the running text."""
    weight: Counter = Counter()
    for b in blocks:
        parts = b.path.split("/")[1:]
        if parts and parts[-1].partition(".")[0] in _TEXT:
            parts.pop()
        for n in range(len(parts) + 1):
            weight["".join(f"/{p}" for p in parts[:n]) + "/"] += _running(b)
    full = [path for path, w in weight.items() if w >= most * weight["/"] and w]
    return max(full, key=lambda path: (path.count("/"), path), default="/")


def _confirm(page: Page, ids: list[int], template: Template) -> None:
    """Containers inside the content that only their names call no text: they are none if links or the template say so too."""
    held: dict[int, list[Block]] = defaultdict(list)
    for b in page.blocks:
        if b.named and not b.aside:
            held[b.named].append(b)
    for blocks in held.values():
        if sum(b.linked for b in blocks) >= _LINKED * sum(len(b.text) for b in blocks) or all(ids[b.at] in template.texts for b in blocks):
            for b in blocks:
                b.aside = True


def content(page: Page, template: Template, most: float = 0.5) -> str:
    """The main text of a page by its host's template."""
    ids = [token_id(t) for t in page.tokens] if template.classes else [0] * len(page.tokens)
    _confirm(page, ids, template)
    tag = ids.index(template.content) if template.content and template.content in ids else -1
    if tag >= 0:
        # The slots from the content's tag up to its end, as far as the template has them.
        end = token_id(f"/{page.tokens[tag]}")
        inside = [tag in b.inside for b in page.blocks]
        if end in template.root and template.content in template.root:
            slot, first, last = slots(ids, template), template.root.index(template.content) + 1, template.root.index(end) + 1
            if slot[tag] == first and end in ids:
                inside = [first <= slot[b.at] < last for b in page.blocks]
        blocks = [b for b, i in zip(page.blocks, inside, strict=True) if i and not b.aside]
    else:
        blocks = [b for b in page.blocks if b.article and not b.aside]
        if not blocks:
            own = [b for b in page.blocks if not b.aside and ids[b.at] not in template.texts]
            place = _container(own)
            blocks = [b for b in own if f"{b.path}/".startswith(place) and _running(b)]
    rest = [b for b in blocks if ids[b.at] not in template.texts]
    gone = sum(len(b.text) for b in blocks) - sum(len(b.text) for b in rest)
    if gone <= most * sum(len(b.text) for b in blocks):
        blocks = rest
    return "\n\n".join(b.text for b in blocks)


def extract(sources: list[str | None], support: int = 3, template: Template | None = None) -> list[str]:
    """Main text of pages of one host."""
    pages = [parse(s or "") for s in sources]
    if template is None:
        seen = Occurrences()
        for i, p in enumerate(pages):
            seen.add("", i, p)
        template = deduce(pa.Table.from_batches([seen.rows()]), support)
    return [content(p, template) for p in pages]


def occurrences(pages: DataFrame) -> DataFrame:
    """Sums over the pages (columns host, html) of each host's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "html")):
            seen = Occurrences()
            for row, host, source in zip(*(batch.column(c).to_pylist() for c in ("row", "host", "html")), strict=True):
                if source:
                    seen.add(host, row, parse(source))
            yield seen.rows()

    each = mapped(pages.select(F.monotonically_increasing_id().alias("row"), "host", "html"), run, STAT)
    return each.groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.sum("total").alias("total"), F.bit_xor("vector").alias("vector"), F.sum("place").alias("place"), F.sum("running").alias("running"), F.max("depth").alias("depth"), F.max("kind").alias("kind"))


def templates(pages: DataFrame, scratch: Scratch, support: int = 3, share: float = 0.1) -> DataFrame:
    """Columns host, root, texts, content: the template of each host that has one."""
    frequent = scratch.save(occurrences(pages).where(F.col("pages") >= support), "frequent")
    sizes = frequent.where("token = 0").select("host", F.col("pages").alias("n"))
    # What is left of a host is bounded: tokens on a share of its pages.
    own = frequent.join(sizes, "host").where((F.col("pages") >= share * F.col("n")) | (F.col("token") == 0)).drop("n")

    def run(table: pa.Table) -> pa.Table:
        t = deduce(table, support, share=share)
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (t.root, sorted(t.texts))]
        return pa.table([table.column("host")[:1], *lists, pa.array([t.content], pa.int64())], ["host", "root", "texts", "content"])

    found = own.groupBy("host").applyInArrow(run, "host string, root array<long>, texts array<long>, content long")
    return scratch.save(found.where(F.size("root") > 0), "templates")


def _template(root: list[int], texts: list[int], tag: int) -> Template:
    return Template([EquivalenceClass(root, 0, True, (0.0, 0.0))], frozenset(texts), tag)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", support: int = 3, broadcast_tokens: int = 2_000_000) -> DataFrame:
    """Columns page_id, url, text, n_chars; one row for each row of pages.

    Templates of up to broadcast_tokens tokens (16 MB) go to every task; more of them are joined by host.
    """
    p = pick(pages, page_id=id_col, url=url_col, html=html_col)
    p = p.withColumn("host", F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit("")))
    scratch = Scratch(pages.sparkSession)
    found = templates(p, scratch, support)
    tokens = found.agg(F.sum(F.size("root") + F.size("texts"))).first()[0] or 0
    small = tokens <= broadcast_tokens
    shared = pages.sparkSession.sparkContext.broadcast({r.host: (r.root, r.texts, r.content) for r in found.collect()} if small else {})
    none = Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, Template] = {}
        for batch in (part for whole in batches for part in slices(whole, "html")):
            hosts = batch.column("host").to_pylist()
            joined = zip(*(batch.column(c).to_pylist() for c in ("root", "texts", "content")), strict=True) if not small else ()
            for host, of in zip(hosts, joined if not small else (shared.value.get(h) for h in hosts), strict=True):
                if host not in made:
                    made[host] = _template(*of) if of and of[0] else none
            texts = [content(parse(s), made[h]) if s else "" for s, h in zip(batch.column("html").to_pylist(), hosts, strict=True)]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
            if len(made) > 2000:
                made.clear()

    whole = p if small else p.join(found, "host", "left")
    return mapped(whole, run, f"page_id {p.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
