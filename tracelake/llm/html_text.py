"""Main text by wrappers inferred for each host.

A page is a stream of tokens: start and end tags of elements, and texts. Well-formed as it is, it is kept as a tree, in which equal neighbours fold into
repeated groups. The streams of a host are aligned a few at a time, round after round, until one expression is left, the host's wrapper.
A mismatch of tags is resolved as a repeat, where the surplus tokens repeat those before them, and else as an optional; a mismatch of
texts makes a text slot. Texts are matched over all pages of a host at once, by counting: a text that stands on nearly all different pages that have
its place is a constant of the wrapper, all others fill a slot.

What the wrapper says decides on every page: its content root is the innermost element that all pages have once and that holds the text of its slots, so
optional and repeated groups lie inside the root or beside it; a page's main text is all that stands under that root. Names of elements and classes are
hints: on the way to an element called article or main half of the slots' text is enough, and elements called menu, advert, comments and the like
don't count. No hint switches off an element around the root.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, short_batches, written
from .ragged import row_by_row

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
#: Elements whose content is no text of the page: scripts, styles, form controls, and what stands in for embedded objects.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "object", "video", "audio", "canvas", "head", "select", "button"}
#: Elements that are menus, footers, sidebars or forms by their names.
DROPPED = {"nav", "footer", "aside", "form", "dialog", "menu", "fieldset"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img picture source br input math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover semantics".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of class, id and role that name what is not the article, and words that may go with them in one name.
NOT_TEXT = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert warning sidebar side menu "
    "nav navbar navigation breadcrumb breadcrumbs comment comments reply replies discussion disqus share sharing social related recommended newsletter subscribe "
    "subscription popup modal overlay footer header masthead topbar login signup search pagination pager widget toolbar skip".split()
)
WITH_THEM = frozenset("area bar block bottom box button buttons container content global inner item items left link links list main outer page panel right section site slot text thread top unit widget wrap wrapper".split())
ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-hidden|hidden)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
FAN_IN = 16
#: How sure it is that an element holds no article: not at all, by its class, by its name.
ON, HINTED, OFF = 0, 1, 2
#: Elements within one another that an expression tells apart.
DEEP = 40


def host_of(url: str | None) -> str:
    found = HOST.match(url or "")
    return found[1].lower() if found else ""


def _hinted(name: str) -> bool:
    """Whether a class, id or role names what is not the article: words for that, and nothing but words that go with them."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]
    return any(w in NOT_TEXT for w in words) and all(w in NOT_TEXT or w in WITH_THEM for w in words)


def _marks(attributes: str) -> tuple[str, int]:
    """What names the element in a path, and what its attributes say of it."""
    if not attributes.strip():
        return "", ON
    names, off = [], ON
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("hidden", "aria-hidden"):
            off = OFF if name == "hidden" or value.lower() == "true" else off
            continue
        names += [w.lower() for w in value.split() if not re.search("[0-9]", w)] if name == "class" else []
        off = max(off, HINTED if any(map(_hinted, value.split())) else ON)
        if (name == "role" and value.lower() == "main") or (name == "id" and value.lower() in ("main", "content", "main-content", "article")):
            names.insert(0, "main")
    return "".join(f".{w}" for w in names[:2]), off


def tokens(page: str) -> list[tuple]:
    """The page's stream: ("<", label, off) and (">",) of block elements, and ("#", text)."""
    out: list[tuple] = []
    stack: list[tuple[str, int]] = [("", ON)]  # name, off
    parts: list[str] = []
    articles = 0
    at, n = 0, len(page)

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append(("#", text))

    def pop(to: int) -> None:
        nonlocal articles
        while len(stack) > to:
            articles -= stack.pop()[0] == "article"
            out.append((">",))

    for token in iter(lambda: TOKEN.search(page, at), None):
        if token.start() > at:
            parts.append(page[at : token.start()])
        at = token.end()
        name = token[2]
        if name is None:
            if page.startswith("<![CDATA[", token.start()):
                parts.append(page[token.start() + 9 : at].removesuffix("]]>"))
            continue
        name = name.lower()
        if name in RAW:
            if not token[1] and not token[3].endswith("/"):
                end = re.compile(rf"</{name}\s*[^>]*>|\Z", re.I).search(page, at) if name != "head" else re.compile(r"</head\s*>|<body\b|\Z", re.I).search(page, at)
                at = end.start() if end[0][:5].lower() == "<body" else end.end()
                if name in ("button", "select"):
                    parts.append(" ")
                else:
                    flush()
            continue
        if name in INLINE:
            if name in ("br", "img"):
                parts.append(" ")
            continue
        flush()
        if token[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    pop(k)
                    break
            continue
        if name in VOID or name in ("html", "body"):
            continue
        while len(stack) > 1 and (stack[-1][0] == "p" or stack[-1][0] in CLOSED_BY_ITSELF.get(name, ()) or (re.fullmatch("h[1-6]", stack[-1][0]) and re.fullmatch("h[1-6]", name))):
            pop(len(stack) - 1)
        label, off = _marks(token[3])
        if name in DROPPED or (name == "header" and not articles):
            off = OFF
        articles += name == "article"
        stack.append((name, max(off, stack[-1][1])))
        out.append(("<", name + label, stack[-1][1]))
    if at < n:
        parts.append(page[at:])
    flush()
    pop(1)
    return out


def blocks(stream: list[tuple]) -> list[tuple[str, int, str]]:
    """Path, off and text of each block, in order."""
    out, stack = [], [("", ON)]
    for token in stream:
        if token[0] == "<":
            stack.append((f"{stack[-1][0]}/{token[1]}", token[2]))
        elif token[0] == ">":
            stack.pop()
        else:
            out.append((*stack[-1], token[1]))
    return out


# An expression is a list of items [label, body, repeated, optional]. The label is an element's, "#" of a text, or "()" of a group of items.


def expression(stream: list[tuple]) -> list:
    """The page's own expression: elements that hold text, with adjacent repeats folded. What lies deeper than DEEP elements stands beside its elements' path."""
    levels: list[list] = [[]]
    labels: list[str] = []
    for token in stream:
        if token[0] == "<":
            labels.append(token[1])
            if len(labels) <= DEEP:
                levels.append([])
        elif token[0] == ">":
            label = labels.pop()
            if len(labels) < DEEP:
                body = levels.pop()
                if body:
                    levels[-1].append([label, folded(body), False, False])
        else:
            text = ["#", None, False, False]
            levels[-1].append(["/".join(labels[DEEP:]), [text], False, False] if len(labels) > DEEP else text)
    return folded(levels[0])


def _keys(items: list) -> list[str]:
    return ["(" + " ".join(_keys(x[1])) + ")" if x[0] == "()" else x[0] for x in items]


def _joined(a: list, b: list) -> list:
    """Two lists of items with equal keys."""
    return [[x[0], aligned(x[1], y[1]) if x[1] is not None else None, x[2] or y[2], x[3] or y[3]] for x, y in zip(a, b, strict=True)]


def folded(items: list) -> list:
    """Adjacent repeats of up to four items become one repeated item or group."""
    for size in (1, 2, 3, 4):
        out: list = []
        for item in items:
            out.append(item)
            _repeat(out, size)
        items = out
    return items


def _repeat(out: list, size: int) -> bool:
    """Whether the last `size` items repeat what is before them; then they go into it."""
    last = out[-size:]
    if len(last) < size:
        return False
    if size > 1 and len(out) > size and out[-1 - size][0] == "()" and _keys(out[-1 - size][1]) == _keys(last):
        out[-1 - size][1] = _joined(out[-1 - size][1], last)
        del out[-size:]
        return True
    if len(out) >= 2 * size and _keys(out[-2 * size : -size]) == _keys(last):
        body = _joined(out[-2 * size : -size], last)
        del out[-2 * size :]
        out += [[*body[0][:2], True, body[0][3]]] if size == 1 else [["()", body, True, False]]
        return True
    return False


def aligned(a: list, b: list) -> list:
    """The expression that takes what either takes. Surplus items that repeat those before them make these a repeated group; others become optional."""
    out: list = []
    for what, i, j, k, m in SequenceMatcher(None, _keys(a), _keys(b), autojunk=False).get_opcodes():
        if what == "equal":
            out += _joined(a[i:j], b[k:m])
            continue
        for part in (a[i:j], b[k:m]):
            size = next((n for n in (1, 2, 3, 4) if len(part) % n == 0 and _repeats(out, part, n)), 0)
            for at in range(0, len(part), size or len(part) or 1):
                out += part[at : at + size] if size else [[x[0], x[1], x[2], True] for x in part]
                if size:
                    _repeat(out, size)
    return out


def _repeats(out: list, part: list, size: int) -> bool:
    """Whether all of `part` is copies of the last items of `out`, or of the group they are."""
    if not part:
        return False
    before = out[-1][1] if out and out[-1][0] == "()" and size > 1 else out[-size:]
    keys = _keys(before)
    return len(keys) == size and all(_keys(part[at : at + size]) == keys for at in range(0, len(part), size))


def _text_hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def observed(pages: DataFrame) -> DataFrame:
    """host, expression and slots (path, off, hash and length of each block that may be text) of every page."""

    def run(batches):
        for batch in batches:
            rows = []
            for url, page in zip(batch["url"], batch["html"], strict=True):
                stream = tokens(page or "")
                slots = [{"path": p, "off": off, "hash": _text_hash(t), "chars": len(t)} for p, off, t in blocks(stream) if off < OFF]
                rows.append((host_of(url), json.dumps(expression(stream)), slots))
            yield pd.DataFrame(rows, columns=["host", "expression", "slots"])

    return pages.mapInPandas(run, "host string, expression string, slots array<struct<path:string,off:int,hash:bigint,chars:int>>")


def wrappers(seen: DataFrame) -> DataFrame:
    """host, expression: aligned FAN_IN at a time within each host, equal ones counted once, until each host has one."""
    now = written(seen.groupBy("host", "expression").agg(F.count(F.lit(1)).alias("pages")))
    schema = "host string, expression string, pages long"

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["pages", "expression"], ascending=[False, True])
        whole = json.loads(group["expression"].iloc[0])
        for other in group["expression"].iloc[1:]:
            whole = aligned(whole, json.loads(other))
        return pd.DataFrame([(group["host"].iloc[0], json.dumps(whole), group["pages"].sum())], columns=["host", "expression", "pages"])

    while True:
        most = now.groupBy("host").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return now
        # Groups are dealt by hash, so that no task ever sorts the expressions of a host.
        parts = F.when(F.col("n") <= FAN_IN, 0).otherwise(F.pmod(F.xxhash64("expression"), F.ceil(F.col("n") / FAN_IN)))
        sizes = now.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        dealt = now.join(sizes, "host").withColumn("part", parts)
        before, now = now, written(dealt.groupBy("host", "part").applyInPandas(fold, schema).groupBy("host", "expression").agg(F.sum("pages").alias("pages")))
        freed(before)


HEADING = re.compile(r"h[1-3]($|\.)")
NAMED = re.compile(r"(article|main)($|\.)|[^.]+\.main($|\.)")


def nodes(items: list, path: str = "") -> Iterator[tuple[str, bool, bool]]:
    """path, many, open of each element of an expression, parents first: whether it stands in a repeated or an optional group of its parent. Its slots have an empty label.

    Siblings of one label that stand apart are one path; it is there more than once, and open only if all of them are.
    """
    merged: dict[str, list] = {}
    for label, body, repeated, optional in _ungrouped(items):
        if label == "#":
            yield f"{path}/#", repeated, optional
            continue
        before = merged.get(label)
        merged[label] = [label, body if before is None else before[1] + body, repeated or before is not None, optional and (before is None or before[3])]
    for label, body, repeated, optional in merged.values():
        yield f"{path}/{label}", repeated, optional
        yield from nodes(body, f"{path}/{label}")


def _ungrouped(items: list) -> list:
    """The items with those of groups in place of the groups, which hand on their flags."""
    out = []
    for label, body, repeated, optional in items:
        out += [[x[0], x[1], x[2] or repeated, x[3] or optional] for x in _ungrouped(body)] if label == "()" else [[label, body, repeated, optional]]
    return out


def weights(found: list[tuple[str, bool, bool]], chars: dict[str, int]) -> dict[str, int]:
    """Characters in the slots of each element of an expression, by path."""
    out: dict[str, int] = {}
    for place in {p[:-2] for p, _, _ in found if p.endswith("/#")}:
        up = place if place in chars else ""
        while up:
            out[up] = out.get(up, 0) + chars[place]
            up = up.rpartition("/")[0]
    return out


def root_of(expression_: list, chars: dict[str, int]) -> str:
    """The path of the content root of a wrapper, from the characters that fill its slots and the groups that these stand in.

    From the top it goes down to the element that holds nearly all (for one on the way to an article or main element, half) of the slots' text. It doesn't go
    into what the wrapper has as optional or repeated, as the root is one element that the host's pages have, and what differs between them is in it. An optional
    article is still the root, for pages that have it; of repeated ones, the element around them is.
    """
    found = list(nodes(expression_))
    weight = weights(found, chars)
    label = lambda p: p.rpartition("/")[2]
    flags: dict[str, tuple[bool, bool]] = {p: (many, open_) for p, many, open_ in found if not p.endswith("/#")}
    below: dict[str, list[str]] = {}
    for p in flags:
        if weight.get(p):
            below.setdefault(p.rpartition("/")[0], []).append(p)
    named = {p for p, w in weight.items() if NAMED.match(label(p)) and w}
    ways = {p[:k] for p in named for k in range(1, len(p) + 1) if k == len(p) or p[k] == "/"}
    root = ""
    while True:
        inner = below.get(root, [])
        best = max(inner, key=lambda p: (weight[p], p), default=None)
        if best is None:
            return root
        many, open_ = flags[best]
        whole = chars.get(root, 0) + sum(weight[p] for p in inner)
        if best in ways and 2 * weight[best] >= whole and not many:
            root = best
            continue
        if root in named or many or open_ or 10 * weight[best] < 9 * whole:
            return root
        heading = any(HEADING.match(label(p)) and p.startswith(root + "/") and p != best and not p.startswith(f"{best}/") for p, w in weight.items() if w)
        if heading or best not in below:
            return root
        root = best


def content(seen: DataFrame, found: DataFrame) -> DataFrame:
    """host, root and hints of each wrapper: whether its hints are to be followed.

    Equal pages of a host count once. A text is a constant if it stands in its place on nearly all different pages that have the place; constants fill no
    slot, and so don't draw the root to themselves, but they are text as any other of a page once the root is chosen.
    """
    pages = seen.select("host", F.xxhash64("slots").alias("page"), F.array_distinct("slots").alias("slots")).dropDuplicates(["host", "page"])
    single = pages.select("host", "page", F.explode("slots").alias("s")).select("host", "page", "s.*")
    by_page = single.groupBy("host", "page", "path").agg(F.max("off").alias("off"), F.sum("chars").alias("chars"))
    places = by_page.groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages"), F.min("off").alias("off"), F.sum("chars").alias("chars"))
    often = single.groupBy("host", "path", "hash").agg(F.count(F.lit(1)).alias("n"), F.first("chars").alias("size")).where("n > 1")
    fixed = often.join(places.select("host", "path", "pages"), ["host", "path"]).where("n * 10 >= pages * 9")
    fixed = fixed.groupBy("host", "path").agg(F.sum(F.col("n") * F.col("size")).alias("less"))
    slots = places.join(fixed, ["host", "path"], "left").select("host", F.struct("path", "off", (F.col("chars") - F.coalesce("less", F.lit(0))).alias("chars")).alias("slot"))
    rows = slots.groupBy("host").agg(F.collect_list("slot").alias("slots"))  # at most the places of the wrapper

    def choose(batches):
        for batch in batches:
            out = []
            for host, expression_, slots in zip(batch["host"], batch["expression"], batch["slots"], strict=True):
                slots = list(slots) if slots is not None else []
                hints = any(s["off"] == ON and s["chars"] > 0 for s in slots)
                chars = {s["path"]: int(s["chars"]) for s in slots if s["chars"] > 0 and (s["off"] == ON or not hints)}
                out.append((host, root_of(json.loads(expression_), chars), hints))
            yield pd.DataFrame(out, columns=["host", "root", "hints"])

    return found.join(rows, "host", "left").mapInPandas(choose, "host string, root string, hints boolean")


def _tags(path: str) -> str:
    return re.sub(r"\.[^/]*", "", path)


def main_text(page: str, root: str, hints: bool) -> str:
    """All text under the root. A page that has no such element is asked for one of the same tags, and else for all that may be text."""
    found = [(p, t) for p, off, t in blocks(tokens(page)) if off == ON or (off == HINTED and not hints)]
    inside = [(p, t) for p, t in found if not root or p == root or p.startswith(root + "/")]
    if not inside and root:
        tags = _tags(root)
        inside = [(p, t) for p, t in found if (q := _tags(p)) == tags or q.startswith(tags + "/")]
    return "\n\n".join(t for _, t in inside or found)


def extracted(pages: DataFrame) -> DataFrame:
    """A row for each page: page_id, url, text, n_chars.

    Null and empty pages have empty texts, and so has a page whose text is all menus, notices and the like. The content of the elements in RAW is no text.
    Under the wrapper's root nothing is left out, whether the host repeats it or not. A null or strange url belongs to the host without a name. Repeated rows each return, a null page_id is carried along, other columns are ignored, an empty table gives no rows.
    """
    pages = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    seen = written(observed(pages))
    found = written(content(seen, wrappers(seen)))
    freed(seen)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST.pattern, 1))

    def extract(rows: pd.DataFrame) -> pd.DataFrame:
        out = [main_text(page, root or "", bool(hints)) for page, root, hints in zip(rows["text"], rows["root"], rows["hints"], strict=True)]
        return pd.DataFrame({"text": out, "n_chars": [len(t) for t in out]})

    joined = pages.withColumn("host", host).join(found, "host", "left")
    return row_by_row(joined.select("page_id", "url", F.col("html").alias("text"), "root", "hints"), ["page_id", "url"], lambda: extract, "text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
