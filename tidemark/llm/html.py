"""Main text of HTML pages by tree scoring.

A page becomes a tree of elements and a list of text runs, one for each stretch of text between
block boundaries. Each run gives points for its length and commas to its ancestors, in full to
the nearest container and less with each level, and a container's points are discounted by the
share of its text that lies in links. The best container is kept, with siblings that score well
enough and headings and paragraphs beside it. Elements that are menus, page headers and footers,
sidebars, notices, adverts, forms, code or comments by tag, role, class or id take no part, but a
form or one with such a class or id does if it holds most of the page or little is left without.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .words import small_batches

# Elements by what they mean for text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg object".split())
SKIPPED = frozenset("head nav footer aside form menu button select dialog canvas audio video".split()) | RAW
#: Skipped elements that stand inside a line: what is around them stays one block.
INLINE = frozenset("script style noscript template iframe svg object button select canvas audio video textarea".split())
PARAGRAPHS = frozenset("p pre blockquote li dd dt td th h1 h2 h3 h4 h5 h6 figcaption summary caption".split())
CONTAINERS = frozenset("html body main article section div ul ol dl table thead tbody tfoot tr header center details fieldset figure hgroup address".split())
BLOCKS = PARAGRAPHS | CONTAINERS | (SKIPPED - INLINE) | {"hr"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag that ends an open element, up to the nearest of the elements that hold it.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
#: A class or id counts as a whole name: each of its parts is one of these words or a word that only says where or what shape, so has-sidebar and overflow-hidden don't count.
_REMARKS = r"comments?|commentlist|disqus|remarks?|replies|responses|shoutbox"
_UNLIKELY = r"ads?|advert\w*|banner|breadcrumbs?|consent|cookies?|footer|gdpr|hidden|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|pager|pagination|popup|promo\w*|related|rss|share|sharing|sidebar|signup|siteheader|skyscraper|social|sponsor\w*|subscribe|tags|toolbar|topbar|widgets?"
_NEUTRAL = r"\d+|site|main|page|post|posts|entry|article|blog|top|bottom|left|right|primary|secondary|global|header|list|items?|bar|box|wrap|wrapper|container|inner|outer|area|section|block|body|text|title|count|holder|panel|overlay|slot|unit|form|buttons?|links?|icons?"
UNLIKELY = re.compile(rf"(?:(?:{_NEUTRAL})[_-]+)*(?:{_UNLIKELY}|{_REMARKS}|site-header)(?:[_-]+(?:{_NEUTRAL}|{_UNLIKELY}|{_REMARKS}))*", re.I)
REMARKS = re.compile(rf"(?:^|[_-])(?:{_REMARKS})(?:$|[_-])", re.I)
#: What an element's own sign says: nothing; a name or a form, which may still be the article; remarks of readers; no part of it.
ALIVE, DOUBTFUL, REMARK, DEAD = range(4)
#: Doubtful elements compete if one holds more of a page's points than this, or all others together hold less than that share; and some paragraphs' worth, where other text is left.
MOST, LITTLE, LEAST_POINTS = 0.5, 0.25, 8
#: Points: a run's share goes to ancestors by level; runs shorter than this give none.
LEVELS = (1.0, 0.5, 1 / 6, 1 / 9, 1 / 12)
LEAST_RUN = 25
SIBLING_SHARE = 0.2
#: Beside the best container, what holds text and few links is kept too where both stand in one of these, or are sections of one parent.
WHOLE = frozenset("article main".split())
FEW_LINKS = 0.25
#: A list or table in the kept part goes if it holds so many links and they are most of its text.
MENU_LINKS, MENU_DENSITY = 3, 0.5

#: A quote opens a value only after '='; a value reaches to its closing quote whatever its length, and without one the tag ends at the next '>'.
#: One that meets another '<' first ends there, as a tag if it holds a quoted value and else as text, so every match goes on from the end of the last.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/<>]*+)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^<>])*+)(>?)""", re.S)
#: The tags that may end a skipped element; the first do so at the nearest end tag, the others count those of their own name inside them.
_ENDS = {name: re.compile(rf"<(/?){name}(?![^\s/>])[^>]*>?", re.I | re.A) for name in RAW}
NESTING = frozenset("template svg object".split())
_QUOTED = re.compile(r"""=\s*+(?:"[^"]*+"|'[^']*+')""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")


def _sign(attributes: str) -> int:
    """What role, class, id and hidden of an element say, by name and value; of attributes with the same name the first counts."""
    own: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        own.setdefault(name.lower(), a or b or c)
    role = own.get("role", "").strip().lower()
    if "hidden" in own and own["hidden"].lower() != "until-found" or own.get("aria-hidden", "").lower() == "true" or role in ROLES and role != "form":
        return DEAD
    names = [n for n in (own.get("class", "") + " " + own.get("id", "")).split() if UNLIKELY.fullmatch(n)]
    return REMARK if any(REMARKS.search(n) for n in names) else DOUBTFUL if names or role == "form" else ALIVE


def _points(text: str, link: int) -> float:
    return (1 + text.count(",") + len(text) / 100) * (1 - link / len(text))


def _after(html: str, name: str, at: int) -> int:
    """The position after the end tag of a skipped element whose content begins at `at`; the page's end if there is none."""
    depth = 1
    for m in _ENDS[name].finditer(html, at):
        if m[1]:
            depth -= 1
        elif name in NESTING and not m[0].endswith("/>"):
            depth += 1
        if not depth:
            return m.end()
    return len(html)


def main_text(html: str) -> str:
    """The main text: blocks in page order joined by a line feed, white space in a block made one space.

    Broken markup is read as it stands: tags that are never closed end with their parent, and a
    '<' that opens no tag is text. A page without any text run gives an empty string. If doubtful
    elements hold most of the page, or little is left without them, it is read again with them.
    """
    text, spared = _read(html, frozenset())
    return _read(html, spared)[0] if spared else text


def _read(html: str, spared: frozenset[int]) -> tuple[str, frozenset[int]]:
    """(main text, elements to be spared), where the signs of the elements in `spared` don't count."""
    tag, parent, dead, sign = ["#root"], [-1], [ALIVE], [ALIVE]
    size, linked, links = [0], [0], [0]
    runs: list[tuple[int, str, int]] = []
    lost: list[tuple[int, str, int]] = []
    stack, buffer, in_link, link_chars = [0], [], 0, 0
    # What is open by name, in all and in each open container, and the open blocks: no tag makes the stack be searched in vain.
    opened, scopes, blocks = Counter(), [Counter()], [0]
    gone: list[str] = []
    gone_node, gone_links = 0, 0

    def owner() -> int:
        return blocks[-1]

    def push(node: int) -> None:
        name = tag[node]
        stack.append(node)
        opened[name] += 1
        scopes[-1][name] += 1
        if name in BLOCKS:
            blocks.append(node)
        if name in CONTAINERS:
            scopes.append(Counter())

    def cut(k: int) -> None:
        while len(stack) > k:
            name = tag[stack.pop()]
            if name in CONTAINERS:
                scopes.pop()
            if name in BLOCKS:
                blocks.pop()
            opened[name] -= 1
            scopes[-1][name] -= 1

    def flush() -> None:
        nonlocal link_chars, gone_links
        if buffer:
            text = "".join(buffer)
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                runs.append((owner(), text, min(link_chars, len(text))))
            buffer.clear()
        link_chars = 0
        if gone:
            text = " ".join("".join(gone).split())
            if text:
                node = owner()
                lost.append((node if dead[node] else gone_node, text, min(gone_links, len(text))))
            gone.clear()
        gone_links = 0

    def add(text: str) -> None:
        nonlocal link_chars, gone_node, gone_links
        if not text:
            return
        state = dead[stack[-1]]
        if not state:
            buffer.append(text)
            if in_link:
                link_chars += len(text)
        elif state != DEAD and not spared:
            if not gone:
                gone_node = stack[-1]
            gone.append(text)
            if in_link:
                gone_links += len(text)

    at = 0
    # From `at` each time: what looks like a tag in a skipped script opens none.
    while m := _TOKEN.search(html, at):
        add(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        if not m[4] and not _QUOTED.search(m[3]):
            add(m[0])
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                in_link = max(0, in_link - 1)
            if name in BLOCKS:
                flush()
            # An inline element is closed inside its container alone.
            if opened[name] if name in BLOCKS else scopes[-1][name]:
                cut(next(k for k in range(len(stack) - 1, 0, -1) if tag[stack[k]] == name))
            continue
        if name == "br":
            add(" ")
            continue
        if name in BLOCKS:
            flush()
            if name in CLOSES:
                ends, within = CLOSES[name]
                if any(opened[e] for e in ends):
                    # Containers and paragraphs are blocks, so the blocks tell which comes first.
                    node = next((n for n in reversed(blocks) if tag[n] in within or tag[n] in ends), None)
                    if node is not None and tag[node] in ends:
                        cut(stack.index(node))
            # A block ends an open paragraph, and what is open inside it.
            if scopes[-1]["p"]:
                cut(next(k for k in range(len(stack) - 1, 0, -1) if tag[stack[k]] == "p"))
                in_link = 0
        if name in VOID:
            continue
        if name in RAW:
            if not (name == "svg" and m[3].endswith("/")):
                at = _after(html, name, at)
            continue
        node = len(tag)
        up = stack[-1]
        inside = name == "header" and not any(tag[n] in ("article", "main") for n in stack)
        tag.append(name)
        parent.append(up)
        own = DEAD if name in SKIPPED and name != "form" or inside else _sign(m[3]) if m[3] and name not in ("html", "body", "article", "main", "p", "a") else ALIVE
        if name == "form":
            own = max(own, DOUBTFUL)
        sign.append(own)
        dead.append(max(dead[up], ALIVE if node in spared else own))
        size.append(0), linked.append(0), links.append(0)
        if name == "a":
            in_link += 1
            links[node] = 1
        if not m[3].endswith("/") or name in BLOCKS:
            push(node)
    add(html[at:])
    flush()
    if lost and (found := _doubted(parent, sign, dead, runs, lost)):
        return "", found
    if not runs:
        return "", frozenset()

    # The nearest container of each element, itself included.
    box = [0] * len(tag)
    for node in range(1, len(tag)):
        box[node] = node if tag[node] in CONTAINERS else box[parent[node]]
    score = [0.0] * len(tag)
    for least in (LEAST_RUN, 1):
        for node, text, link in runs:
            if len(text) >= least:
                points = _points(text, link)
                up = parent[node] if tag[node] not in CONTAINERS and node else node
                for share in LEVELS:
                    up = box[max(up, 0)]
                    if up <= 0:
                        break
                    score[up] += points * share
                    up = parent[up]
        if any(score):
            break
    titles = [0] * len(tag)
    for node, text, link in runs:
        size[node] += len(text)
        linked[node] += link
        titles[node] += len(text) * (tag[node] in HEADINGS)
    for node in range(len(tag) - 1, 0, -1):
        up = parent[node]
        size[up] += size[node]
        titles[up] += titles[node]
        linked[up] += linked[node]
        links[up] += links[node]
    density = [b / a if a else 0.0 for a, b in zip(size, linked, strict=True)]
    final = [s * (1 - d) for s, d in zip(score, density, strict=True)]
    best = max(range(len(tag)), key=lambda n: (final[n], n))
    if final[best] <= 0:
        best = 0
    kept = [False] * len(tag)
    kept[best] = True
    for node in range(1, len(tag)):
        up = parent[node]
        if best and up == parent[best] and not dead[node]:
            together = tag[up] in WHOLE or tag[node] == tag[best] == "section"
            kept[node] |= together and size[node] > 0 and density[node] < FEW_LINKS
            kept[node] |= final[node] >= SIBLING_SHARE * final[best] or node < best and (tag[node] in HEADINGS or 0 < size[node] == titles[node] and density[node] < 0.5) or tag[node] == "p" and size[node] > 0 and density[node] < 0.25
        if kept[up] and not (tag[node] in ("ul", "ol", "table", "div", "dl") and links[node] >= MENU_LINKS and density[node] > MENU_DENSITY):
            kept[node] = True
    return "\n".join(text for node, text, _ in runs if kept[node]), frozenset()


def _doubted(parent: list[int], sign: list[int], dead: list[int], runs: list[tuple[int, str, int]], lost: list[tuple[int, str, int]]) -> frozenset[int]:
    """The elements whose own sign is to be spared: of doubtful ones those that hold most points of the page, or all where the rest holds little; of remarks only where nothing else has points."""
    left = sum(_points(text, link) for _, text, link in runs if len(text) >= LEAST_RUN)
    for kind in (DOUBTFUL, REMARK):
        held = [0.0] * len(parent)
        for node, text, link in lost:
            if dead[node] == kind and len(text) >= LEAST_RUN:
                held[node] += _points(text, link)
        for node in range(len(parent) - 1, 0, -1):
            held[parent[node]] += held[node]
        total = left + held[0]
        marked = [n for n in range(1, len(parent)) if ALIVE < sign[n] <= kind and held[n] > 0]
        least = LEAST_POINTS if runs else 0
        most = [n for n in marked if held[n] > MOST * total and held[n] >= least]
        if kind == REMARK:
            return frozenset(marked if not left else ())
        if most or held[0] and held[0] >= least and left < LITTLE * total:
            return frozenset(most or marked)
    return frozenset()


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id, url, text, n_chars (code points). Null and empty pages give an empty text; other columns are not read."""
    small_batches(pages, 200)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html) if html else "" for html in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    rows = pages.select(id_col, url_col, html_col)
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, `{url_col}` string, text string, n_chars long")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages; see extract for null and empty pages."""
    return extract(table(spark, sf_dir, "pages"))
