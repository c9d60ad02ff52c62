"""The main text of web pages by tree scoring.

A page becomes a tree of elements. Every text block gives points for its length and its commas to its parent, half of
them to its grandparent and a third to the next one. A container's points are discounted by its link density. The
container with the most points is kept, together with those siblings that score alike or are plain text paragraphs, and what stands between them and is not links.

Elements that are never part of an article (scripts, menus, forms, adverts, comments, hidden parts) are left out before
scoring, by their name, role or class. A class or id alone does not take out what holds an <article> or <main>, or more than
half of the page's text (if not beside an article), unless it names comments; nor a header inside the article. Null and empty pages have no text. Broken markup (open elements at the end, end
tags without a start, cut tags) never fails: what is open is closed. Repeated rows get equal texts.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame

from .common import per_batch

# Element names and attribute words.
SKIPPED = frozenset(
    "aside button canvas dialog embed footer form head iframe input label map menu nav noscript object option select "
    "script style svg template textarea title video audio".split()
)
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hr "
    "html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article blockquote body center dd details div dl fieldset html li main ol section table td ul".split())
ENDS_P = BLOCKS - {"body", "html"}
_WORD = (
    "ads?|advert(?:s|isement|ising)?|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|header|masthead|menu|modal|"
    "nav(?:bar|igation)?|newsletter|notice|popup|promo|related|replies|respond|share|sharing|sidebar|social|sponsor(?:ed)?|subscribe|toolbar|widget"
)
_PLACE = "site|page|global|main|primary|secondary|top|bottom|left|right|area|bar|block|box|container|inner|items?|links?|list|posts|section|wrap(?:per)?|buttons?|icons?|[0-9]+"
#: Whole names of a class or id: words of the list, alone or with others that only say where or how.
NOISE = re.compile(rf"(?:^|\s)(?:(?:{_PLACE})[_-]+)*(?:{_WORD})(?:[_-]+(?:{_WORD}|{_PLACE}))*(?=\s|$)", re.I)
#: What readers wrote is not the article, however long.
REPLIES = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|replies|respond)(?=$|[\s_-])", re.I)
NOISE_ROLES = frozenset("alert banner complementary contentinfo dialog form menu navigation search".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("name", "parent", "parts", "points", "skipped", "doubtful")

    def __init__(self, name: str, parent: Node | None, skipped: bool = False) -> None:
        self.name, self.parent, self.skipped = name, parent, skipped
        self.parts: list[Node | str] = []
        self.points = 0.0
        self.doubtful = False


def is_noise(name: str, attributes: str) -> bool:
    if name in SKIPPED:
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key == "role" and value.lower() in NOISE_ROLES or key in ("class", "id") and REPLIES.search(value) and NOISE.search(value):
            return True
    return False


def is_doubtful(name: str, attributes: str) -> bool:
    """Noise by a class or id, unless the content speaks against it."""
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    return any(m[1].lower() in ("class", "id") and NOISE.search(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes))


def settle(root: Node) -> None:
    """Skip the doubtful elements, with all that is in them, but not those that hold an article, nor those that hold more than
    half of the text and do not stand beside an article."""
    order = [root]
    for node in order:
        order += [p for p in node.parts if isinstance(p, Node) and not p.skipped]
    chars: dict[int, int] = {}
    articles: set[int] = set()
    for node in reversed(order):
        chars[id(node)] = sum(len(p.strip()) if isinstance(p, str) else chars.get(id(p), 0) for p in node.parts)
        if node.name in ("article", "main") or any(id(p) in articles for p in node.parts):
            articles.add(id(node))
    for node in order:
        if node.parent is not None and node.parent.skipped:
            node.skipped = True
        elif node.doubtful and id(node) not in articles:
            beside = id(root) in articles and not _in_article(node)
            node.skipped = beside or 2 * chars[id(node)] <= chars[id(root)]


def parse(page: str) -> Node:
    """The tree of a page. A page header outside the article is noise; inside an article it is kept."""
    root = at = Node("html", None)
    pos, end = 0, len(page)
    while pos < end:
        m = _TOKEN.search(page, pos)
        text = page[pos : m.start() if m else end]
        if text:
            at.parts.append(html.unescape(text))
        if not m:
            break
        pos = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if closing:
            node = at
            while node is not None and node.name != name:
                node = node.parent
            if node is not None and node.parent is not None:
                at = node.parent
            continue
        if name in ENDS_P:
            node = at
            while node is not None and node.name != "p" and (node.name not in BLOCKS):
                node = node.parent
            if node is not None and node.name == "p" and node.parent is not None:
                at = node.parent
        if name in ("li", "dd", "dt", "td", "th", "tr", "option") and at.name == name and at.parent is not None:
            at = at.parent
        node = Node(name, at, at.skipped or is_noise(name, attributes or "") or name == "header" and not _in_article(at))
        node.doubtful = not node.skipped and is_doubtful(name, attributes or "") and not (_in_article(at) and re.search("header", attributes, re.I))
        at.parts.append(node)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>?", re.I).search(page, pos)
            pos = close.end() if close else end
        elif name not in VOID and not (attributes or "").rstrip().endswith("/"):
            at = node
    settle(root)
    return root


def _in_article(node: Node | None) -> bool:
    while node is not None:
        if node.name in ("article", "main"):
            return True
        node = node.parent
    return False


def blocks(node: Node) -> list[tuple[Node, str, int]]:
    """(container, text, characters of it inside links) of each block of text below `node`, in page order."""
    out: list[tuple[Node, str, int]] = []
    run: list[str] = []
    linked = 0

    def flush(owner: Node) -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(run)).strip()
        if text:
            out.append((owner, text, min(linked, len(text))))
        run.clear()
        linked = 0

    # An explicit stack: (node, next part, block that owns its text, inside a link).
    stack: list[list] = [[node, 0, node, False]]
    while stack:
        top = stack[-1]
        here, i, owner, link = top
        if i == len(here.parts):
            stack.pop()
            if here is owner:
                flush(owner)
            continue
        top[1] += 1
        part = here.parts[i]
        if isinstance(part, str):
            run.append(part)
            linked += len(part.strip()) if link else 0
        elif not part.skipped:
            if part.name in ("br", "hr"):
                if part.name == "hr":
                    flush(owner)
                else:
                    run.append(" ")
            elif part.name in BLOCKS:
                flush(owner)
                stack.append([part, 0, part, link])
            else:
                stack.append([part, 0, owner, link or part.name == "a"])
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(parse(page))
    if not found:
        return ""
    scored: dict[int, Node] = {}
    chars: dict[int, list[int]] = {}
    for owner, text, linked in found:
        box = owner
        while box.name not in CONTAINERS and box.parent is not None:
            box = box.parent
        points = (1 + text.count(",") + min(len(text) / 100, 3.0)) if len(text) >= 25 else 0.2
        share, node = 1.0, box
        for level in range(3):
            if node is None:
                break
            node.points += points * (1 - linked / len(text)) * share
            scored[id(node)] = node
            share, node = (0.5 if level == 0 else 1 / 3), node.parent
        node = owner
        while node is not None:
            total = chars.setdefault(id(node), [0, 0])
            total[0] += len(text)
            total[1] += linked
            node = node.parent

    def worth(node: Node) -> float:
        total, linked = chars.get(id(node), (0, 0))
        bonus = 1.25 if node.name in ("article", "main") else 1.0
        return node.points * bonus * (1 - linked / total) if total else 0.0

    best = max(scored.values(), key=lambda n: (worth(n), -n.points))
    # A container inside an article is widened to it: an article's own parts belong together.
    node = best
    while node is not None:
        if node.name in ("article", "main"):
            best = node
        node = node.parent
    least = max(10.0, worth(best) * 0.2)
    kept = {id(best)}
    for part in best.parent.parts if best.parent is not None and best.name not in ("body", "html") else ():
        if isinstance(part, Node) and not part.skipped and part is not best:
            total, linked = chars.get(id(part), (0, 0))
            plain = part.name == "p" and total >= 80 and linked < 0.25 * total
            heading = part.name == "h1" and total > 0 and linked == 0 and best.name not in ("article", "main")
            if plain or heading or part.name in CONTAINERS and worth(part) >= least and linked < 0.5 * total:
                kept.add(id(part))
    # Headings, short paragraphs, lists and the like between two kept siblings belong to the text.
    beside = [p for p in best.parent.parts if isinstance(p, Node)] if len(kept) > 1 else []
    places = [i for i, p in enumerate(beside) if id(p) in kept]
    for part in beside[places[0] : places[-1]] if places else ():
        total, linked = chars.get(id(part), (0, 0))
        if not part.skipped and total and 2 * linked < total:
            kept.add(id(part))
    lines = []
    for owner, text, _ in found:
        node = owner
        while node is not None and id(node) not in kept:
            node = node.parent
        if node is not None:
            lines.append(text)
    return "\n".join(lines)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of `pages` (page_id, url, html)."""

    def make():
        def work(batch):
            texts = [main_text(p) for p in batch["html"]]
            yield {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]}

        return work

    return per_batch(pages, ["page_id", "url", "html"], "page_id long, url string, text string, n_chars long", make)
