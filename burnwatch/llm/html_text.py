"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each at the end of a path of block-level tags from the root. Text length and punctuation are added up per path and per
beginning of a path. The ratio of length to the number of blocks is smoothed with those of the beginnings, nearer ones more, fused with the punctuation
ratio and weighted by what tags and names say of the path (`article` or class="entry-content" more, paths beside such ones less, menus and forms nothing). Paths that
reach the threshold are content, and all their blocks are kept in page order. Time grows with the page, whatever its number of paths and their depth.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

# HTML's tags by role.
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "template", "svg", "object", "xmp", "annotation", "annotation-xml"}
RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr br img picture source "
    # formulas are text
    "math semantics mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mstyle mpadded mphantom menclose munder mover munderover "
    "mmultiscripts mprescripts mtable mtr mtd merror".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
AWAY = set("nav footer header aside form menu button select dialog head fieldset".split())
HOME = {"article", "main"}
#: Tags that end an open `p`, and those that end an open tag of their own kind.
SELF_CLOSING = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}

# Words of class, id and role attributes that tell boilerplate from content. A name counts if all its parts are such words or neutral ones:
# page-header does; no-sidebar, header-fixed and entry-title do not.
AWAY_WORD = re.compile(
    r"ads?|advert\w*|banner\w*|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice\w*|alert\w*|popup\w*|modal\w*|overlay|"
    r"newsletter|subscri\w+|signup|login|sidebar\w*|widget\w*|related|recommend\w*|share\w*|sharing|social\w*|breadcrumbs?|paginat\w+|pager|"
    r"nav\w*|menu\w*|footer|header|masthead|toolbar|comments?\w*|commentlist|repl(?:y|ies)|respond|disqus|disclaimer|toc|tags?|"
    r"contentinfo|complementary|navigation|search|form"
)
HOME_WORD = re.compile(r"article\w*|main|content|story|post|entry|bodytext")
NEUTRAL = set(
    "site page wrap wrapper inner outer container box block area section region bar list item items link links button buttons icon icons group "
    "panel row col posts body text primary secondary global local top bottom left right".split()
)
TOKEN = re.compile(
    r"<!--(?s:.*?)(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)"
)
ATTRIBUTE = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
QUOTED = re.compile(r"\"[^\"]*+\"|'[^']*+'")
HIDDEN = re.compile(r"(?:\A|\s)hidden(?=[\s=/]|\Z)", re.I)
HIDDEN_VALUE = re.compile(
    r"(?:\A|\s)(?:style\s*=\s*(?:\"[^\"]*?|'[^']*?|[^\s\"']*?)display\s*:\s*none|aria-hidden\s*=\s*[\"']?true)", re.I
)
HEADING = re.compile(r"h[1-6](?:\.|\Z)")
PARAGRAPH = re.compile(r"p(?:\.|\Z)")
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：¿¡]")
#: Share of the mean fused ratio of a page's text that a path must reach.
THRESHOLD = 0.075
#: How much of the smoothed ratio of a beginning comes from further out.
OUTER = 0.75
#: What a name of content, and standing beside such content, multiply the fused ratio by.
NAMED, BESIDE = 4.0, 0.05
# Roles of blocks besides 0 and 1: in an article inside such a form or name; in a form; in something named as boilerplate; in hidden tags and
# those of boilerplate.
AGAIN, IN_FORM, FOUND_AWAY, GONE = 2, -1, -2, -3


@lru_cache(maxsize=10_000)
def name_role(name: str) -> int:
    """1 for a name of content, FOUND_AWAY for one of boilerplate, 0 for others."""
    parts = [x for x in re.split(r"[^a-z]+", name) if x]
    away, home = ([bool(words.fullmatch(x)) for x in parts] for words in (AWAY_WORD, HOME_WORD))
    if not all(a or h or x in NEUTRAL for x, a, h in zip(parts, away, home, strict=True)):
        return 0
    return FOUND_AWAY if any(away) else int(any(home))


def is_hidden(attributes: str) -> bool:
    return bool(HIDDEN_VALUE.search(attributes) or HIDDEN.search(QUOTED.sub('""', attributes)))


class Paths:
    """Paths as nodes of a tree; a node's parent comes before it."""

    def __init__(self) -> None:
        self.parents, self.names, self.numbers = [-1], [""], {}

    def below(self, parent: int, name: str) -> int:
        key = parent, name
        if key not in self.numbers:
            self.numbers[key] = len(self.parents)
            self.parents.append(parent)
            self.names.append(name)
        return self.numbers[key]


def blocks(page: str) -> tuple[Paths, list[tuple[int, int, str, int]]]:
    """The paths, and (path, role, text, characters in links) of each block with text; role is 1 inside named content, negative inside boilerplate."""
    found = []
    paths = Paths()
    stack: list[tuple[str, int, int]] = []  # tag, path, role
    open_tags: Counter = Counter()
    text: list[str] = []
    linked, in_link, at = 0, 0, 0

    def end_block() -> None:
        nonlocal linked
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                found.append((stack[-1][1] if stack else 0, stack[-1][2] if stack else 0, whole, min(linked, len(whole))))
            text.clear()
        linked = 0

    def add(chunk: str) -> None:
        nonlocal linked
        if chunk:
            text.append(chunk)
            if in_link:
                linked += len(chunk)

    def close(tag: str, stop: set[str] = frozenset()) -> None:
        if not open_tags[tag]:
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                for gone in stack[i:]:
                    open_tags[gone[0]] -= 1
                del stack[i:]
                return
            if stack[i][0] in stop:
                return

    while token := TOKEN.search(page, at):
        add(page[at : token.start()])
        at = token.end()
        tag = (token[2] or token[5] or "").lower()
        if not tag:
            continue
        ends, attributes = token[1] or token[4], token[3] or token[6] or ""
        if tag in RAW:
            # What stands inside goes; the text around it goes on.
            if ends or (attributes.endswith("/") and tag == "svg"):
                continue
            # Lowering the page would move its places: some letters become two.
            stop = RAW_END[tag].search(page, at)
            at = stop.start() if stop else len(page)
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if ends else 1
            elif tag in ("br", "img"):
                text.append(" ")
            continue
        end_block()
        in_link = 0
        if ends:
            close(tag)
            continue
        if tag in VOID:
            continue
        if stack and stack[-1][0] == "p":
            close("p")
        if tag in SELF_CLOSING:
            close(tag, SELF_CLOSING[tag])
        role = stack[-1][2] if stack else 0
        name = tag
        if tag not in ("html", "body"):
            words = " ".join(a or b or c for a, b, c in ATTRIBUTE.findall(attributes)).lower() if attributes else ""
            name = f"{tag}.{words}" if words else tag
            roles = {name_role(word) for word in words.split()}
            if (tag in AWAY and tag != "form") or (attributes and is_hidden(attributes)):
                role = GONE
            elif tag in HOME:
                if role == 0:
                    role = 1
                elif role in (IN_FORM, FOUND_AWAY) and FOUND_AWAY not in roles and not any(open_tags[x] for x in HOME):
                    role = AGAIN
            elif FOUND_AWAY in roles:
                role = min(role, FOUND_AWAY)
            elif tag == "form":
                role = min(role, IN_FORM)
            elif role == 0 and 1 in roles and not HEADING.match(tag):
                role = 1
        stack.append((tag, paths.below(stack[-1][1] if stack else 0, name), role))
        open_tags[tag] += 1
    add(page[at:])
    end_block()
    return paths, found


def content_paths(paths: Paths, page: list[tuple[int, int, str, int]]) -> set[tuple[int, int]]:
    """The (path, role) pairs that hold content."""
    sums: dict[tuple[int, int], list[float]] = {}
    for path, role, text, linked in page:
        s = sums.setdefault((path, role), [0, 0, 0, 0])
        for i, x in enumerate((1, len(text), linked, len(PUNCTUATION.findall(text)))):
            s[i] += x
    weights = role_weights(sums)
    candidates = {k: s for k, s in sums.items() if weights.get(k[1], 0) > 0}
    # Ratio of text outside links to blocks, of each path and of all that begins like it; a list of links has next to none.
    n_blocks, length = [0.0] * len(paths.parents), [0.0] * len(paths.parents)
    own = {}
    for k, (count, n, linked, _) in candidates.items():
        own[k] = max(0.0, n - 2 * linked) / count
        n_blocks[k[0]] += count
        length[k[0]] += max(0.0, n - 2 * linked)
    for i in range(len(paths.parents) - 1, 0, -1):
        n_blocks[paths.parents[i]] += n_blocks[i]
        length[paths.parents[i]] += length[i]
    around = [length[0] / (n_blocks[0] or 1)]
    for i in range(1, len(paths.parents)):
        around.append((1 - OUTER) * (length[i] / n_blocks[i] if n_blocks[i] else 0.0) + OUTER * around[paths.parents[i]])
    fused = {}
    for k, (_, n, _, marks) in candidates.items():
        smooth = 0.5 * own[k] + 0.5 * around[max(0, paths.parents[k[0]])]
        fused[k] = weights[k[1]] * smooth * (1 + min(1.0, math.log1p(20 * marks / (n + 1))))
    bar = THRESHOLD * sum(fused[k] * s[1] for k, s in candidates.items()) / (sum(s[1] for s in candidates.values()) or 1)
    kept = {k for k, s in candidates.items() if fused[k] >= bar and not mostly_links(paths, k[0], s)}
    homes = {paths.parents[path] for path, _ in kept}
    # A heading belongs to the text it stands beside.
    return kept | {k for k in candidates if HEADING.match(paths.names[k[0]]) and paths.parents[k[0]] in homes and weights[k[1]] >= 1}


def role_weights(sums: dict[tuple[int, int], list[float]]) -> dict[int, float]:
    """What a role is worth on this page: named content most, what stands beside it little; an article inside boilerplate counts where there is no other, and a form where most of the page is in it."""
    size = {wanted: sum(s[1] for (_, role), s in sums.items() if role == wanted) for wanted in (0, 1, AGAIN, IN_FORM)}
    if size[1]:
        return {1: NAMED, 0: BESIDE}
    if size[AGAIN]:
        return {AGAIN: NAMED, 0: BESIDE}
    return {0: 1.0, IN_FORM: 1.0} if size[IN_FORM] > size[0] else {0: 1.0}


def mostly_links(paths: Paths, path: int, s: list[float]) -> bool:
    """More than half in links, and neither paragraphs nor long blocks."""
    return s[1] <= 2 * s[2] and s[0] * 200 > s[1] and not PARAGRAPH.match(paths.names[path])


def main_text(page: str | None) -> str:
    """The blocks on content paths, joined by an empty line."""
    paths, found = blocks(page or "")
    keep = content_paths(paths, found)
    return "\n\n".join(text for path, role, text, _ in found if (path, role) in keep)


def extract(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in `keep` and `text`, the main text of each page's whole html.

    Null and empty html, and pages without content, have an empty text. Character references are decoded, white space inside a block is one
    space, blocks are joined by two line ends; nothing else is dropped or cut. Repeated rows stay; broken or cut-off markup is read as far as it
    goes. No rows are moved between partitions.
    """
    schema = pages.select(*keep).schema.add("text", "string", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            texts = pa.array([main_text(column[i].as_py()) for i in range(len(column))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*batch.schema.names[:-1], "text"])

    return pages.select(*keep, pages[html_column].alias("_html")).mapInArrow(run, schema)
