"""HTML extraction by union-free regular-expression inference (operator 10).

The tag stream of every page becomes a tree of block elements with text slots; inline markup vanishes. A host's wrapper is a
union-free regular expression over such streams: sequences, optional items (?) and repeated groups (+), no alternatives.
A page is folded first (tandem repeats of up to PERIOD items become groups), then wrappers are aligned two by two: equal items
merge, an item that only one side has becomes optional, and repeats on one side become groups. A slot of the wrapper is
constant while all pages that have it hold the same text (of a repeated item: the same texts in order), else it varies. Every
element of the wrapper sums what its slots held: pages, words, words in links. The wrapper then names the host's main element:
article or main if the host's pages have one outside boilerplate (that with most text, then the shorter path, then the later
name), else the lowest element that holds all texts in varying slots that are neither boilerplate nor mostly links.

Boilerplate is what its tag or role says, or a class or id made of such words alone (share-buttons, not share-price): text that
varies from page to page as an article does (adverts, reader comments) has no other mark.

Every page takes part. A first pass counts on how many of a host's pages each element with its classes stands: classes that fewer
than one page in SHARED (or one page alone) has are left out of the wrapper's names, so that classes made for one page neither let
wrappers grow nor keep equal texts apart. Wrappers are first merged inside each task, so that a host with most of the pages sends one small
row a task; they are merged again by host and a salt, then by host, one row at a time. Work on a page is linear in its length
but for sorting; elements nested deeper than DEPTH stand in the wrapper beside the one at that depth. Words with a digit in
classes and ids are alike. Extraction matches each whole page with its host's wrapper and gives the blocks of the main element in page order,
without boilerplate inside it and without slots that are constant over at least CONSTANT_PAGES different pages and are no part of
the article's own flow: those of a box (an element that isn't a heading, paragraph, list or table, all of whose slots are constant and not headings
alone), those in links, and those before the first or after the last varying slot, but for headings. So an Introduction or a set
phrase between an article's paragraphs stays. On fewer pages, or if a page would keep nothing, equal text is no evidence and stays.

Defined results: null or empty html gives the empty text; a null url is the host ''; pages without the host's main element
give their own best element; unclosed and stray tags close as browsers close them, and a head without its end tag ends at
the body, at text or at the first element that can't stand in it (only script, style and textarea run to the end of a page);
from a tag on whose quote is never closed, quotes hide no >; a < without any > after it is text; character references are
decoded within a text, never across markup; repeated rows give repeated results; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.common import cut, lean, small_side, table

#: Different pages that must hold the same text in a slot before it counts as part of the template.
CONSTANT_PAGES = 8
#: Characters of wrappers up to which they are broadcast.
BROADCAST_CHARS = 16_000_000

#: A class counts in the wrapper's names if at least one page in so many of its host has it.
SHARED = 20
#: Items of a repeated group at most, and depth of the wrapper.
PERIOD, DEPTH = 16, 200
#: Groups of a host's wrappers that are merged before the host's are.
SALTS = 64

_QUOTED, _PLAIN = r"""(?:"[^"]*+"|'[^']*+'|[^>"']++)*+""", "[^>]*+"
TOKEN, TOKEN_PLAIN = (
    re.compile(
        rf"""<!--.*?(?:-->|\Z)|<(script|style|textarea)\b{x}>.*?(?:</\1\s*>|\Z)|<title\b{x}>[^<]*+(?:</title\s*>)?|<iframe\b{x}>(?:(?!<iframe\b).)*?</iframe\s*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({x})>|<[!?][^>]*+>|[^<]++|<""",
        re.S | re.I,
    )
    for x in (_QUOTED, _PLAIN)
)
_BEGINS = re.compile("<(?:[!?]|/?[a-zA-Z])")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog button fieldset head noscript template iframe svg select object".split())
#: Elements that stand in head; any other one, or text, ends it. Elements that end an open svg or select.
HEAD_TAGS = frozenset("base link meta noscript template head".split())
LEAVES_SVG = frozenset("article aside blockquote body center dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul".split())
#: Words that mark boilerplate in a class, id or role, and words that may stand beside them there.
BOILERPLATE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment commentlist comments complementary consent contentinfo cookie cookies disqus footer
    header login masthead menu menubar modal nav navbar navigation newsletter notice notices popup promo related replies search share sharing side sidebar signup social sponsor sponsored subscribe
    toolbar""".split()
)
NEUTRAL_WORDS = frozenset(
    """0 area bar block body bottom box btn button buttons container content dialog fixed form global google group holder icons inner items left link links list main mobile module overlay page
    panel posts primary reader readers right secondary site slot sticky text thread top unit user widget wrap wrapper""".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of an article's own flow; others are boxes.
FLOW = HEADINGS | frozenset("p ul ol li dl dt dd blockquote pre table caption colgroup thead tbody tfoot tr td th figure figcaption article main body html".split())
#: Elements that an opening tag of the given kind closes first.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
STOPS = frozenset("ul ol dl table tbody thead body article section main div".split())


@lru_cache(4096)
def _marked(names: str) -> bool:
    """Whether a class, id or role says boilerplate."""
    for name in names.split():
        words = [w.lower() for w in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", re.sub(r"\d+", "0", name)) if w]
        if any(w in BOILERPLATE_WORDS for w in words) and all(w in BOILERPLATE_WORDS or w in NEUTRAL_WORDS for w in words):
            return True
    return False


@lru_cache(16384)
def _label(attributes: str) -> tuple[str, str]:
    """Class, id and role of a tag, and how they stand in a wrapper's names."""
    names = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
    label = " ".join(x for x in (names.get("class", ""), names.get("id", ""), names.get("role", "")) if x)
    return label, re.sub(r"\w*\d\w*", "0", label.lower()).replace("/", " ")


def tokens(page: str) -> Iterator[re.Match | str]:
    """Matches of TOKEN, and the rest of the page as a text if it has no tag any more."""
    at, pattern = 0, TOKEN
    while at is not None:
        found, at = pattern.finditer(page, at), None
        for m in found:
            if m.group(0) == "<" and _BEGINS.match(page, m.start()):
                if page.find(">", m.start()) < 0:
                    yield page[m.start() :]
                    return
                if pattern is TOKEN:  # a quote that is never closed
                    at, pattern = m.start(), TOKEN_PLAIN
                    break
            yield m


def parse(page: str, shared: frozenset[str] | None = None) -> Iterator[tuple[str, str, bool]]:
    """Events of a page: (open, key, boilerplate), (close, "", False), (text, text, in a link). Of the keys with classes only shared ones
    are given, if any are named."""
    open_tags: list[str] = []
    held: Counter = Counter()  # of the open tags
    links = 0

    def close() -> str:
        tag = open_tags.pop()
        held[tag] -= 1
        return tag

    for m in tokens(page):
        token = m if isinstance(m, str) else m.group(0)
        if token[0] != "<" or token == "<" or m is token:
            if open_tags and open_tags[-1] == "head" and token.strip():
                close()
                yield "close", "", False
            yield "text", entities.unescape(token) if "&" in token else token, links > 0
            continue
        if not m.group(3):
            continue  # comments, scripts, styles and other elements whose content isn't text
        tag, closing = m.group(3).lower(), m.group(2)
        if not closing and open_tags:
            if held["svg"] and tag in LEAVES_SVG:
                while True:
                    yield "close", "", False
                    if close() == "svg":
                        break
            elif open_tags[-1] == "iframe" or open_tags[-1] == "head" and tag not in HEAD_TAGS or open_tags[-1] in ("select", "option", "optgroup") and tag in LEAVES_SVG - {"hr"}:
                while open_tags and open_tags[-1] in ("iframe", "head", "select", "option", "optgroup"):
                    close()
                    yield "close", "", False
            elif held["head"] and tag == "body":
                while True:
                    yield "close", "", False
                    if close() == "head":
                        break
        if tag in INLINE or tag in VOID:
            if tag == "a":
                links = max(0, links - 1) if closing else 1
            if tag in ("br", "hr", "wbr"):
                yield "text", " ", links > 0
            continue
        links = 0
        if closing:
            if held[tag] > 0:
                while True:
                    yield "close", "", False
                    if close() == tag:
                        break
            else:
                yield "text", "", False
                yield "open", tag, False  # a stray end still parts two blocks
                yield "close", "", False
            continue
        closes = CLOSES.get(tag, {"p"})
        while open_tags and (open_tags[-1] in closes):
            close()
            yield "close", "", False
        label, written = _label(m.group(4)) if m.group(4) else ("", "")
        key = f"{tag}.{written}" if label else tag
        if shared is not None and label and key not in shared:
            key = tag
        bad = tag in BOILERPLATE_TAGS or bool(label and tag not in ("html", "body", "article", "main") and _marked(label)) or tag == "header" and not (held["article"] > 0 or held["main"] > 0)
        open_tags.append(tag)
        held[tag] += 1
        yield "open", key, bad
        if m.group(4) and m.group(4).rstrip().endswith("/") and tag not in ("p", "div"):
            close()
            yield "close", "", False


# --- wrappers: an item is [key, items, least, most]; key "" is a group; least 0 means optional, most 2 means repeated ----
# A slot (key #) has a fifth field: in a page its [numbers, texts, words less twice those in links] in page order; in a host's
# wrapper [digest of the texts, up to CONSTANT_PAGES digests of pages, whether it is mostly links], or None if it varies.


def _digest(texts: list[str]) -> str:
    return hashlib.blake2b("\0".join(texts).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def _within(x: list, y: list) -> list:
    """Slots of one page that fall together."""
    return [x[0] + y[0], x[1] + y[1], x[2] + y[2]]


def _across(x: list | None, y: list | None) -> list | None:
    """Slots of different pages that fall together."""
    return [x[0], sorted({*x[1], *y[1]})[:CONSTANT_PAGES], x[2] and y[2]] if x and y and x[0] == y[0] else None


def _name(item: list) -> str:
    return item[0] or "(" + " ".join(_name(x) for x in item[1]) + ")"


def fold(items: list[list]) -> list[list]:
    """Tandem repeats become one repeated item or group, shortest period first."""
    changed = True
    while changed:
        changed = False
        known: dict[str, int] = {}
        codes = [known.setdefault(_name(x), len(known)) for x in items]
        if len(known) == len(items):
            break
        code = np.array(codes)
        for period in range(1, min(PERIOD, len(items) // 2) + 1):
            same = np.concatenate([[False], code[:-period] == code[period:], [False]])
            edge = np.flatnonzero(same[1:] != same[:-1])
            out: list[list] = []
            at = 0
            for begin, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
                begin = max(begin, at)
                if end - begin < period:
                    continue
                out += items[at:begin]
                at = begin + ((end - begin) // period + 1) * period
                units = [items[i : i + period] for i in range(begin, at, period)]
                while len(units) > 1:  # two by two, so that many repeats cost little more than few
                    units = [align(*units[i : i + 2], _within) if i + 1 < len(units) else units[i] for i in range(0, len(units), 2)]
                if period == 1:
                    units[0][0][3] = 2
                    out.append(units[0][0])
                else:
                    out.append(["", units[0], 1, 2])
                changed = True
            if changed:
                items = out + items[at:]
                break
    return items


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a common subsequence: equal ends, and between them the longest ascending row of equal occurrences (the k-th with the k-th)."""
    if a == b:
        return [(i, i) for i in range(len(a))]
    head, tail, least = 0, 0, min(len(a), len(b))
    while head < least and a[head] == b[head]:
        head += 1
    while tail < least - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    seen: Counter = Counter()
    where = {}
    for j in range(head, len(b) - tail):
        where[b[j], seen[b[j]]] = j
        seen[b[j]] += 1
    seen.clear()
    ends: list[int] = []  # the least last place in b of an ascending row of each length
    last: list[int] = []  # its last pair
    pairs: list[tuple[int, int, int]] = []  # (place in a, place in b, pair before)
    for i in range(head, len(a) - tail):
        j = where.get((a[i], seen[a[i]]))
        seen[a[i]] += 1
        if j is not None:
            k = bisect_left(ends, j)
            pairs.append((i, j, last[k - 1] if k else -1))
            ends[k : k + 1], last[k : k + 1] = [j], [len(pairs) - 1]
    row = []
    at = last[-1] if last else -1
    while at >= 0:
        row.append(pairs[at][:2])
        at = pairs[at][2]
    return [(i, i) for i in range(head)] + row[::-1] + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def align(a: list[list], b: list[list], join=_across) -> list[list]:
    """One sequence that both match: equal items merged, the others optional."""
    an, bn = [_name(x) for x in a], [_name(x) for x in b]
    out: list[list] = []
    known: dict[str, int] = {}
    at, bt = 0, 0
    for i, j in [*_common(an, bn), (len(a), len(b))]:
        for n, x in [*zip(an[at:i], a[at:i]), *zip(bn[bt:j], b[bt:j])]:
            if n in known:  # the other side, or another place, has it: it may repeat there
                y = out[known[n]]
                y[1], y[3], y[4:] = align(y[1], x[1], join), 2, [join(y[4], x[4])] if n == "#" else []
            else:
                known[n] = len(out)
                out.append([x[0], x[1], 0, *x[3:]])
        if i < len(a):
            x, y = a[i], b[j]
            known[an[i]] = len(out)
            out.append([x[0], align(x[1], y[1], join), min(x[2], y[2]), max(x[3], y[3]), *([join(x[4], y[4])] if x[0] == "#" else [])])
        at, bt = i + 1, j + 1
    return out


def slots(items: list[list], path: str = "") -> Iterator[tuple[str, list]]:
    """All slots, each with the path of its element."""
    for x in items:
        if x[0] == "#":
            yield path, x
        else:
            yield from slots(x[1], f"{path}/{x[0]}".lstrip("/") if x[0] else path)


def is_constant(slot: list) -> bool:
    return slot[4] is not None and len(slot[4][1]) >= CONSTANT_PAGES


def keep_boilerplate(items: list[list], path: str | None) -> bool:
    """Leaves those constant slots of a host's wrapper marked that aren't part of the article at path; whether there are any."""
    inside: list[tuple[list, bool]] = []  # slots of the main element in order, and whether they stand in a heading
    boxed: set[int] = set()

    def visit(items: list[list], here: str, within: bool, heading: bool) -> list[tuple[list, bool]]:
        mine = []
        for x in items:
            if x[0] == "#":
                mine.append((x, heading))
                if within:
                    inside.append((x, heading))
                continue
            at, tag = f"{here}/{x[0]}".lstrip("/") if x[0] else here, x[0].partition(".")[0]
            got = visit(x[1], at, within or at == path, heading or tag in HEADINGS)
            if within and x[0] and tag not in FLOW and all(is_constant(y) for y, _ in got) and not all(h for _, h in got):
                boxed.update(id(y) for y, _ in got)
            mine += got
        return mine

    every = visit(items, "", path == "", False)
    varying = [k for k, (x, _) in enumerate(inside) if not is_constant(x)]
    drop = {id(x) for k, (x, heading) in enumerate(inside) if varying and is_constant(x) and (id(x) in boxed or not heading and (x[4][2] or not varying[0] < k < varying[-1]))}
    for x, _ in every:
        if id(x) not in drop:
            x[4] = None
    return bool(drop)


def match(wrapper: list[list], page: list[list]) -> Iterator[int]:
    """Numbers of the page's texts that stand in constant slots of the wrapper; items fall together as in align."""
    wn, pn = [_name(x) for x in wrapper], [_name(x) for x in page]
    known = dict(zip(wn, wrapper))
    paired = {j: wrapper[i] for i, j in _common(wn, pn)}
    for j, y in enumerate(page):
        x = paired.get(j) or known.get(pn[j])
        if x is None:
            continue
        if x[0] != "#":
            yield from match(x[1], y[1])
        elif is_constant(x) and x[4][0] == _digest(y[4][1]):
            yield from y[4][0]


def expression(items: list[list]) -> str:
    """The wrapper as a regular expression over tags and text slots (#)."""
    def one(key: str, inner: list, least: int, most: int) -> str:
        body = "#" if key == "#" else f"({expression(inner)})" if not key else f"<{key}>{expression(inner)}</>" if inner else f"<{key}/>"
        return body + ("*" if least == 0 and most == 2 else "?" if least == 0 else "+" if most == 2 else "")

    return " ".join(one(*x[:4]) for x in items)


def page_tree(events: Iterable[tuple[str, str, bool]]) -> dict:
    """The wrapper of one page, with the page's texts in its slots: items, and of each path [pages, text, linked text, boilerplate] of its own slots."""
    stack: list[list[list]] = [[]]
    path: list[str] = []
    bad = [False]
    stats: dict[str, list] = {}
    number, deeper = 0, 0
    slot: list | None = None  # the one that texts go to
    pieces: list[str] = []

    def end() -> None:
        nonlocal slot
        if slot:
            slot[1][-1] = " ".join(pieces)
            pieces.clear()
            slot = None

    for kind, value, flag in events:
        if kind != "text" and (kind == "open") + len(path) + deeper <= DEPTH:
            end()
        if kind == "open":
            bad.append(bad[-1] or flag)
            if len(path) == DEPTH:
                deeper += 1
                continue
            item = [value, [], 1, 1]
            stack[-1].append(item)
            stack.append(item[1])
            path.append(value)
        elif kind == "close" and len(bad) > 1:
            bad.pop()
            if deeper:
                deeper -= 1
                continue
            stack[-1][:] = fold(stack[-1])
            stack.pop()
            path.pop()
        elif kind == "text" and (n := len(words := value.split())):
            if slot is None:
                slot = [[number], [""], 0]
                stack[-1].append(["#", [], 1, 1, slot])
                number += 1
            pieces += words
            slot[2] += n - 2 * n * flag
            s = stats.setdefault("/".join(path), [1, 0, 0, bad[-1]])
            s[1] += n
            s[2] += n if flag else 0
    end()
    while len(stack) > 1:
        stack[-1][:] = fold(stack[-1])
        stack.pop()
    return {"items": fold(stack[0]), "stats": stats}


def page_wrapper(page: str, shared: frozenset[str] | None = None) -> dict:
    """The wrapper of one page: as page_tree, with digests in place of the texts."""
    one = page_tree(parse(page, shared))
    held = [x for _, x in slots(one["items"])]
    whole = _digest([t for x in held for t in x[4][1]])
    for x in held:
        x[4] = [_digest(x[4][1]), [whole], x[4][2] < 0]
    return one


def merge(a: dict, b: dict) -> dict:
    """One wrapper for the pages of both."""
    stats = {k: list(v) for k, v in a["stats"].items()}
    for k, v in b["stats"].items():
        s = stats.setdefault(k, [0, 0, 0, v[3]])
        s[0], s[1], s[2] = s[0] + v[0], s[1] + v[1], s[2] + v[2]
    return {"items": align(a["items"], b["items"]), "stats": stats}


def main_path(stats: dict[str, list], constant: frozenset[str] = frozenset()) -> str | None:
    """Path of the main element: the article or main element with most text, else the lowest one over all unlinked text but that
    of the constant paths; empty if only the whole page is over it, None without such text."""
    text: dict[str, float] = {}
    own: list[str] = []
    for path, (_, n, linked, bad) in stats.items():
        if not bad:
            parts = path.split("/") if path else []
            for i in range(1, len(parts) + 1):
                key = "/".join(parts[:i])
                text[key] = text.get(key, 0) + n - 2 * linked
            if n > 2 * linked and path not in constant:
                own.append(path)
    named = [p for p in text if re.match(r"(article|main)(\.|$)", p.rpartition("/")[2])]
    if named:
        top = [p for p in named if not any(p.startswith(q + "/") for q in named)]
        inner = [p for p in named if re.match(r"article(\.|$)", p.rpartition("/")[2]) and text[p] >= 0.7 * max(text[t] for t in top)]
        return max(inner or top, key=lambda p: (text[p], -len(p), p))
    if not own:
        return main_path(stats) if constant else None
    return "/".join(commonprefix([p.split("/") if p else [] for p in own]))


def extract(page: str | None, path: str | None, wrapper: str | None = None, shared: frozenset[str] | None = None) -> str:
    """Blocks of the main element at path, in page order, without texts in constant slots of the host's wrapper (its items as JSON)."""
    if not page:
        return ""
    events = list(parse(page, shared))
    fixed = set(match(_items(wrapper), page_tree(events)["items"])) if wrapper else set()

    def read(target: str | None, without: set[int]) -> tuple[bool, list[str]]:
        parts = target.split("/") if target else []
        depth, met = 0, 0  # of the open elements, and how many of them the target begins with
        inside, bad, seen = int(target == ""), 0, target == ""
        marks: list[tuple[bool, bool]] = []
        blocks: list[str] = []
        words: list[str] = []
        number, within = -1, False  # of the text, as in page_tree

        def flush() -> None:
            if words:
                if block := " ".join("".join(words).split()):
                    blocks.append(block)
                words.clear()

        for kind, value, flag in events:
            if kind == "text":
                if not within and value.strip():
                    number, within = number + 1, True
                if (inside or target is None) and not bad and not (within and number in without):
                    words.append(value)
                continue
            flush()
            if depth + (kind == "open") <= DEPTH:
                within = False
            if kind == "open":
                hit = False
                if met == depth < len(parts) and value == parts[depth]:
                    met += 1
                    hit = met == len(parts)
                depth += 1
                inside, bad, seen = inside + hit, bad + flag, seen or hit
                marks.append((hit, flag))
            elif depth:
                depth -= 1
                met = min(met, depth)
                hit, was = marks.pop()
                inside, bad = inside - hit, bad - was
        flush()
        return seen, blocks

    for without in (fixed, set()) if fixed else (set(),):  # a page of nothing but constant text keeps it
        seen, blocks = read(path, without) if path is not None else (False, [])
        if not seen:
            blocks = read(main_path(page_tree(events)["stats"]), without)[1]
        if blocks:
            break
    return "\n".join(blocks)


@lru_cache(64)
def _items(wrapper: str) -> list[list]:
    return json.loads(wrapper)


WRAPPER = "host string, wrapper string"
KEYS = "host string, key string, n long"


def _count_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host, key, pages) of elements with classes; the empty key counts the pages."""
    held: Counter = Counter()

    def out() -> pd.DataFrame:
        return pd.DataFrame([(*k, n) for k, n in held.items()], columns=["host", "key", "n"])

    for pdf in batches:
        for host, page in zip(pdf["page_host"], pdf["html"]):
            if page:
                found = {""}
                for m in tokens(page):
                    if not isinstance(m, str) and m.group(4) and not m.group(2) and (tag := m.group(3).lower()) not in INLINE and tag not in VOID and (written := _label(m.group(4)))[0]:
                        found.add(f"{tag}.{written[1]}")
                held.update((host, k) for k in found)
        if len(held) > 200_000:
            yield out()
            held.clear()
    if held:
        yield out()


def shared_keys(pages: DataFrame) -> DataFrame:
    """(host, keys): elements with classes that one page in SHARED of the host has, and two at least; at most SHARED times as many as a page has."""
    counts = pages.select("page_host", "html").mapInPandas(_count_keys, KEYS).groupBy("host", "key").agg(F.sum("n").alias("n"))
    counts = cut(counts.filter("key = '' or n > 1"))
    total = counts.filter("key = ''").select(F.col("host").alias("_host"), F.col("n").alias("_pages"))
    often = counts.filter("key != ''").join(total, F.col("host") == F.col("_host")).filter(F.col("n") * SHARED >= F.col("_pages"))
    return often.groupBy("host").agg(F.collect_list("key").alias("keys"))


def _keys_of(keys: object) -> frozenset[str]:
    return frozenset(keys) if keys is not None else frozenset()


def _infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, dict] = {}
    shared: dict[str, frozenset[str]] = {}
    for pdf in batches:
        for host, page, keys in zip(pdf["page_host"], pdf["html"], pdf["keys"]):
            if page:
                if host not in shared:
                    shared[host] = _keys_of(keys)
                one = page_wrapper(page, shared[host])
                held[host] = merge(held[host], one) if host in held else one
        if len(held) > 5000:
            yield pd.DataFrame({"host": list(held), "wrapper": [json.dumps(w) for w in held.values()]})
            held, shared = {}, {}
    if held:
        yield pd.DataFrame({"host": list(held), "wrapper": [json.dumps(w) for w in held.values()]})


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, dict]]:
    """One wrapper for each stretch of rows of a host."""
    host, whole = None, None
    for pdf in batches:
        for h, w in zip(pdf["host"], pdf["wrapper"]):
            if whole is not None and h != host:
                yield host, whole
                whole = None
            host, whole = h, json.loads(w) if whole is None else merge(whole, json.loads(w))
    if whole is not None:
        yield host, whole


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for host, whole in _merged(batches):
        yield pd.DataFrame({"host": [host], "wrapper": [json.dumps(whole)]})


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for host, whole in _merged(batches):
        held = list(slots(whole["items"]))
        constant = frozenset(p for p, x in held if is_constant(x)) - {p for p, x in held if not is_constant(x)}
        path = main_path(whole["stats"], constant)
        text = expression(whole["items"])
        items = json.dumps(whole["items"]) if keep_boilerplate(whole["items"], path) else None
        yield pd.DataFrame({"host": [host], "path": [path], "expression": [text], "items": [items]}, dtype=object)


def with_host(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, page_host) of pages."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#]*@)?([^/?#]*)", 1))
    return lean(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("page_host", host))


def _joined(pages: DataFrame, hosts: DataFrame, broadcast_rows: int, chars: str) -> DataFrame:
    """pages with their host's row; hosts are broadcast if they are few and small."""
    rows, size = hosts.agg(F.count("*"), F.sum(F.expr(chars).cast("long"))).first()
    return pages.join(small_side(hosts, rows if (size or 0) <= BROADCAST_CHARS else None, broadcast_rows), F.col("page_host") == F.col("host"), "left").drop("host")


def infer_wrappers(pages: DataFrame, keys: DataFrame, broadcast_rows: int = 50_000) -> DataFrame:
    """(host, path, expression, items): the wrapper of every host of with_host(pages), the path of its main element, and the wrapper's items if
    any of its slots are to be dropped; keys as from shared_keys()."""
    with_keys = _joined(pages, keys, broadcast_rows, "aggregate(keys, 0L, (n, k) -> n + length(k))")
    parts = with_keys.select("page_host", "html", "keys").mapInPandas(_infer, WRAPPER)
    parts = parts.repartition("host", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS))).sortWithinPartitions("host", "wrapper").mapInPandas(_combine, WRAPPER)
    return parts.repartition("host").sortWithinPartitions("host", "wrapper").mapInPandas(_finish, "host string, path string, expression string, items string")


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shared: dict[str, frozenset[str]] = {}
    for pdf in batches:
        text = []
        for host, page, w, i, keys in zip(pdf["page_host"], pdf["html"], pdf["path"], pdf["items"], pdf["keys"]):
            if host not in shared:
                if len(shared) > 5000:
                    shared.clear()
                shared[host] = _keys_of(keys)
            text.append(extract(page, w if isinstance(w, str) else None, i if isinstance(i, str) else None, shared[host]))
        yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})


def extract_pages(pages: DataFrame, broadcast_rows: int = 50_000) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages(page_id, url, html)."""
    pages = with_host(pages)
    keys = cut(shared_keys(pages))
    found = cut(infer_wrappers(pages, keys, broadcast_rows).select("host", "path", "items").join(keys.withColumnRenamed("host", "_host"), F.col("host") == F.col("_host"), "left").drop("_host"))
    joined = _joined(pages, found, broadcast_rows, "coalesce(length(items), 0) + coalesce(aggregate(keys, 0L, (n, k) -> n + length(k)), 0)")
    return joined.select("page_id", "url", "html", "page_host", "path", "items", "keys").mapInPandas(_extract, "page_id long, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages."""
    return extract_pages(table(spark, sf_dir, "pages"))


QUERIES = {"op10_html_extraction": op10_html_extraction}
ORACLE_SQL: dict[str, str] = {}
