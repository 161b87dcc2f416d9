"""Main text of pages by union-free wrappers of their hosts.

A page is a stream of tags and texts, nested by its blocks.  Among the children
of a block, stretches that occur two or more times in a row become a repeated
group.  The streams of a host's pages are then aligned one after the other, from
the root down: what only some pages have becomes optional, what one of them
repeats becomes repeated, and texts that differ become slots, while texts that
all pages share stay constants of the template.  The result is a union-free
regular expression over tags and slots, the host's wrapper; each of its parts
counts the pages, characters, links and linked characters that it covered.

A page is read by aligning it with its host's wrapper.  Its article is found
from the root down: the block whose slots hold nearly all text that is not
linked, as long as no heading or paragraph slot stands beside it (a block that
is tagged as the article goes first).  The text is that of the slots in there,
without constants, without parts that are links nearly throughout, and without
parts tagged or named as menus, notices, comments and the like.

Wrappers are made of all pages, by partial aggregation: every task aligns the
pages of each host that it reads, and wrappers are aligned in the same way.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, written
from .op9_urls import parse

#: Pages from which on a text that all share is a constant; share of links that makes a menu, and links of one at least;
#: share of the article's text from which on a block beside it belongs to it.
SHARED, LINKED, LINKS, BESIDE = 5, 0.7, 3, 0.1
#: Levels of blocks that are told apart; deeper blocks only end texts. Parts of a wrapper: beyond, its rarest optional ones go, and
#: pages are read there by their own.
DEPTH, PARTS = 60, 4000
#: Hosts that a task aligns at a time; bytes of all wrappers that are broadcast at most; parts of a host's pages in the join beyond.
HOSTS, BROADCAST, SALTS = 2000, 32_000_000, 32

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "svg", "math", "iframe", "select", "option")}
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")

#: Tags and words of names (fixed values).
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br".split())
CELLS = {"td", "th"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}}
WALLS = {"article", "main", "body", "html"}
BLOCKS = set("html body div section main article center td".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
LEFT_OUT = set("head nav footer aside form button menu dialog object".split())
LEFT_OUT_WORDS = set("nav navbar navigation menu footer sidebar aside ad ads advert advertisement adverts banner sponsor sponsored promo cookie cookies consent notice notices alert popup modal newsletter subscribe signup login breadcrumb breadcrumbs pagination pager share sharing social related recommended widget toolbar masthead copyright search".split())
COMMENT_WORDS = set("comment comments disqus reply replies respond".split())
LAYOUT_WORDS = set("area bar block body box bottom col column container content footer global group header holder inner item items left link links list main outer page panel primary region right row secondary section site slot top unit wrap wrapper".split())
ARTICLE = {"article", "main"}


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, tag or text, names): open, close, void or text; raw elements are passed over."""
    at = 0
    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            yield "text", text, ""
        if not m:
            return
        at = m.end()
        tag = (m.group(2) or m.group(5) or "").lower()
        if not tag:
            continue
        if m.group(1) or m.group(4):
            yield "close", tag, ""
            continue
        attrs = m.group(3) if m.group(2) else m.group(6)
        if tag in _RAW and not (attrs or "").endswith("/"):
            end = _RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        names = ""
        if attrs:
            got = {k.lower(): v.strip("\"'").lower() for k, v in _ATTR.findall(attrs)}
            names = " ".join(x for x in (got.get("class") or got.get("id", ""), got.get("role", "")) if x)
        yield ("void" if tag in VOID else "open"), tag, names


class Part:
    """A part of a wrapper: a block, a slot ("#") or a group ("()") with its
    children, whether it repeats or is optional, and what it covered: pages,
    times, characters, linked ones, links; of a slot (and, as a digest, of a
    page) the text if there was only one; leaves are places in the page's texts (in the wrapper of one page)."""

    __slots__ = ("key", "repeats", "optional", "pages", "times", "chars", "linked", "links", "text", "kids", "leaves", "tag", "left_out", "mass")

    def __init__(self, key, repeats=False, optional=False, pages=1, times=1, chars=0, linked=0, links=0, text=None, kids=(), leaves=()):
        self.key, self.repeats, self.optional, self.pages, self.times, self.chars, self.linked, self.links, self.text = key, repeats, optional, pages, times, chars, linked, links, text
        self.kids, self.leaves = list(kids), list(leaves)
        self.tag = key.split(".", 1)[0]
        self.left_out, self.mass = False, 0.0

    def listed(self) -> list:
        return [self.key, self.repeats, self.optional, self.pages, self.times, self.chars, self.linked, self.links, self.text, [k.listed() for k in self.kids]]

    @staticmethod
    def of(listed: list) -> Part:
        return Part(*listed[:9], kids=[Part.of(k) for k in listed[9]])

    def count(self) -> int:
        return 1 + sum(k.count() for k in self.kids)

    def expression(self) -> str:
        """The part as a union-free regular expression over tags and slots."""
        inner = "".join(k.expression() for k in self.kids)
        whole = "#" if self.key == "#" else inner if self.key == "()" else f"<{self.key}>{inner}</{self.tag}>"
        mark = ("*" if self.optional else "+") if self.repeats else "?" if self.optional else ""
        return f"({whole}){mark}" if mark else whole


def _alike(a: Part, b: Part) -> bool:
    """Whether two parts may be one: blocks that only their tag names must have children in common."""
    if a.key != b.key:
        return False
    if a.tag not in BLOCKS or "." in a.key or a.tag in WALLS or not a.kids or not b.kids:
        return True
    x, y = _shape(a), _shape(b)
    return 2 * len(x & y) >= min(len(x), len(y))


def _shape(a: Part) -> set[str]:
    out = set()
    for k in a.kids:
        out |= _shape(k) if k.key == "()" else {k.key}
    return out


def _join(a: Part, b: Part, same_page: bool = False) -> Part:
    """a, widened by b."""
    a.pages = max(a.pages, b.pages) if same_page else a.pages + b.pages
    a.times, a.chars, a.linked, a.links = a.times + b.times, a.chars + b.chars, a.linked + b.linked, a.links + b.links
    a.repeats, a.optional = a.repeats or b.repeats, a.optional or b.optional
    if a.text != b.text:
        a.text = None
    a.leaves += b.leaves
    if a.kids or b.kids:
        a.kids = _joined(a.kids, b.kids, same_page)
    return a


def _pairs(a: list[Part], b: list[Part]) -> list[tuple[Part | None, Part | None]]:
    """The two lists aligned, in order."""
    if len(a) == len(b) and all(map(_alike, a, b)):
        return list(zip(a, b))
    out: list[tuple[Part | None, Part | None]] = []
    for op, i, j, k, m in SequenceMatcher(None, [_sign(x) for x in a], [_sign(x) for x in b], autojunk=False).get_opcodes():
        if op == "equal":
            out += zip(a[i:j], b[k:m])
            continue
        at = k
        for x in a[i:j]:  # in what is left, the next one that may be the same
            found = next((n for n in range(at, m) if _alike(x, b[n])), None)
            if found is None:
                out.append((x, None))
                continue
            out += [(None, y) for y in b[at:found]]
            out.append((x, b[found]))
            at = found + 1
        out += [(None, y) for y in b[at:m]]
    return out


def _sign(a: Part) -> str:
    return a.key + " " + " ".join(sorted(_shape(a)))


def _joined(a: list[Part], b: list[Part], same_page: bool) -> list[Part]:
    out = []
    for x, y in _pairs(a, b):
        if x is None or y is None:
            one = x or y
            one.optional = True
            out.append(one)
        else:
            out.append(_join(x, y, same_page))
    return out


def _folded(parts: list[Part]) -> list[Part]:
    """parts with stretches that follow each other two or more times as one repeated part."""
    out: list[Part] = []
    for x in parts:
        out.append(x)
        while _shortened(out):
            pass
    return out


def _shortened(out: list[Part]) -> bool:
    n = len(out)
    if n < 2:
        return False
    if _alike(out[-2], out[-1]) and out[-1].key != "()":
        last = out.pop()
        _join(out[-1], last, True).repeats = True
        return True
    for at in range(n - 2, -1, -1):
        here, size = out[at], n - 1 - at
        if here.key == "()" and len(here.kids) == size and all(map(_alike, here.kids, out[at + 1 :])):
            again = Part("()", kids=out[at + 1 :])
            del out[at + 1 :]
            _join(here, again, True)
            return True
        if size > 1 and 2 * size <= n and here.key == out[-1].key and all(_alike(out[i - size], out[i]) for i in range(n - 1, n - 1 - size, -1)):
            first, again = Part("()", kids=out[n - 2 * size : n - size]), Part("()", kids=out[n - size :])
            del out[n - 2 * size :]
            _join(first, again, True).repeats = True
            out.append(first)
            return True
    return False


def wrapped(page: str) -> tuple[Part, list[str]]:
    """The wrapper of one page, and its texts in order."""
    texts: list[str] = []
    root = Part("page")
    stack = [root]
    raw: list[str] = []
    state = {"a": 0, "linked": 0, "links": 0, "deep": 0}

    def end_text():
        if raw:
            text = _SPACE.sub(" ", entities.unescape("".join(raw))).strip()
            if text:
                shown = text if len(text) <= 200 else "\0" + hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()
                stack[-1].kids.append(Part("#", chars=len(text), linked=min(state["linked"], len(text)), links=state["links"], text=shown, leaves=[len(texts)]))
                texts.append(text)
            raw.clear()
        state["linked"] = state["links"] = 0

    def close(n: int):
        for part in stack[n:]:
            part.kids = _folded(part.kids)
        del stack[n:]

    for kind, what, names in tokens(page):
        if kind == "text":
            raw.append(what)
            if state["a"]:
                state["linked"] += len(what.strip())
        elif what in INLINE:
            if what == "br":
                raw.append(" ")
            elif what == "a":
                state["a"] = int(kind == "open")
                state["links"] += state["a"]
        elif what in CELLS:
            raw.append(" ")
        elif kind == "void":
            if what == "hr":
                end_text()
        elif kind == "open":
            end_text()
            state["a"] = 0
            if stack[-1].tag == "p" or stack[-1].tag in ENDS.get(what, ()):
                close(len(stack) - 1)
                if stack[-1].tag in ENDS.get(what, ()):  # a paragraph in an item
                    close(len(stack) - 1)
            if len(stack) <= DEPTH:
                part = Part(f"{what}.{_DIGITS.sub('0', '.'.join(names.split()))}" if names else what)
                stack[-1].kids.append(part)
                stack.append(part)
            else:
                state["deep"] += 1
        else:
            end_text()
            state["a"] = 0
            if state["deep"]:
                state["deep"] -= 1
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == what:
                    close(i)
                    break
                if stack[i].tag in WALLS and what not in WALLS:
                    break
    end_text()
    close(0)
    root.text = hashlib.md5("\n".join(texts).encode("utf-8", "surrogatepass")).hexdigest()
    return root, texts


def bounded(wrapper: Part) -> Part:
    """The wrapper without its rarest optional parts if it has more than PARTS."""
    least = 2
    while wrapper.count() > PARTS and least <= wrapper.pages:
        todo = [wrapper]
        while todo:
            part = todo.pop()
            part.kids = [k for k in part.kids if not (k.optional and k.pages < least)]
            todo += part.kids
        least *= 2
    return wrapper


def aligned(a: Part | None, b: Part) -> Part:
    """One wrapper for the pages of both."""
    return b if a is None else bounded(_join(a, b))


def infer(pages: list[str]) -> Part:
    """The wrapper of pages."""
    out = None
    for page in pages:
        out = aligned(out, wrapped(page)[0])
    return judged(out or Part("page"))


def _named(key: str, words: set[str]) -> bool:
    """Whether a name of the key is made of such words, with words of layout at most."""
    for name in key.split(".")[1:]:
        parts = _NAME.findall(name)
        if any(p in words for p in parts) and all(p in words or p in LAYOUT_WORDS for p in parts):
            return True
    return False


def judged(root: Part) -> Part:
    """The wrapper with what each part's slots hold (mass: characters a page) and what is left out."""
    sums: dict[int, tuple[int, int, int]] = {}
    order: list[Part] = [root]
    for part in order:
        order += part.kids
    for part in reversed(order):
        below = [sums[id(k)] for k in part.kids]
        sums[id(part)] = tuple(x + sum(b[i] for b in below) for i, x in enumerate((part.chars, part.linked, part.links)))
    own = lambda p: sums[id(p)][0] - sums[id(p)][1]
    for part in order:
        chars, linked, links = sums[id(part)]
        part.left_out = part.tag in LEFT_OUT or _named(part.key, COMMENT_WORDS)
        if not part.left_out and part.tag not in WALLS:
            part.left_out = (_named(part.key, LEFT_OUT_WORDS) and 2 * own(part) < own(root)) or (part.key not in ("#", "()", "page", "p") and chars > 0 and linked >= LINKED * chars and links >= LINKS * part.times)
    for constants in (root.text is None, False):  # where pages are equal throughout, nothing is a constant
        for part in reversed(order):
            held = part.chars - part.linked if part.key == "#" else sum(k.mass * k.pages for k in part.kids)
            if part.key == "#":
                constant = constants and part.text is not None and part.pages >= SHARED
                part.left_out = constant
            part.mass = 0.0 if part.left_out else held / max(part.pages, 1)
        if root.mass:
            break
    return root


def _flat(pairs) -> Iterator[tuple[Part, Part]]:
    """Pairs of a page's parts and the wrapper's (else the page's own), groups opened."""
    for mine, theirs in pairs:
        if mine is None:
            continue
        if mine.key == "()":
            yield from _flat(_pairs(mine.kids, theirs.kids if theirs is not None else mine.kids))
        else:
            yield mine, theirs if theirs is not None else mine


def _children(mine: Part, theirs: Part) -> list[tuple[Part, Part]]:
    return list(_flat(_pairs(mine.kids, theirs.kids) if mine is not theirs else zip(mine.kids, mine.kids)))


def _article(mine: Part, theirs: Part) -> tuple[Part, Part]:
    """The page's part, and the wrapper's, that is the article."""
    while mine.tag not in ARTICLE:
        pairs = [(m, t) for m, t in _children(mine, theirs) if not t.left_out]
        blocks = [(m, t) for m, t in pairs if m.tag in BLOCKS and m.times == 1 and t.mass > 0]
        if not blocks:
            break
        tagged = [x for x in blocks if x[1].tag in ARTICLE]
        best = max(tagged or blocks, key=lambda x: x[1].mass)
        beside = [t for m, t in pairs if m is not best[0] and t.mass > 0]
        if not tagged and (any(t.tag not in BLOCKS for t in beside) or sum(t.mass for t in beside) >= BESIDE * best[1].mass):
            break
        mine, theirs = best
    return mine, theirs


def _slots(mine: Part, theirs: Part, out: list[int]) -> None:
    for m, t in _children(mine, theirs):
        if not t.left_out:
            if m.key == "#":
                out += m.leaves
            else:
                _slots(m, t, out)


def extract(page: str | None, wrapper: Part | None = None) -> str:
    """The main text of a page by a judged wrapper (None: its own): blocks joined by an empty line."""
    if not page:
        return ""
    mine, texts = wrapped(page)
    leaves: list[int] = []
    judged(mine)
    _slots(*_article(mine, mine if wrapper is None else wrapper), leaves)
    return "\n\n".join(texts[i] for i in sorted(leaves))


def _merged(rows: DataFrame, sort: bool) -> DataFrame:
    """host, wrapper: those of each host in a partition aligned (all of them if the rows are sorted)."""
    schema = "host string, wrapper string"

    def run(batches):
        host, now = None, None
        for batch in batches:
            for h, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if h != host and now is not None:
                    yield pa.RecordBatch.from_pydict({"host": [host], "wrapper": [json.dumps(now.listed())]})
                    now = None
                host, now = h, aligned(now, Part.of(json.loads(w)))
        if now is not None:
            yield pa.RecordBatch.from_pydict({"host": [host], "wrapper": [json.dumps(now.listed())]})

    return (rows.sortWithinPartitions("host", "wrapper") if sort else rows).select("host", "wrapper").mapInArrow(run, schema)


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON) of each host of pages(host, html), of all its pages.

    Wrappers of a task's pages are aligned in two steps, so that no task gets all
    of a large host.
    """

    def run(batches):
        now: dict[str, Part] = {}

        def out():
            got = pa.RecordBatch.from_pydict({"host": list(now), "wrapper": [json.dumps(w.listed()) for w in now.values()]})
            now.clear()
            return got

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                now[host] = aligned(now.get(host), _light(wrapped(page)[0]))
                if len(now) >= HOSTS:
                    yield out()
        if now:
            yield out()

    some = pages.where("html is not null and html != ''").select("host", "html").mapInArrow(run, "host string, wrapper string")
    first = some.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS))).repartition("host", "salt")
    return _merged(_merged(first, True).repartition("host"), True)


def _light(part: Part) -> Part:
    """The part without the places of its texts."""
    todo = [part]
    for p in todo:
        p.leaves = []
        todo += p.kids
    return part


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages(page_id, url, html, ...).

    Null and empty pages have an empty text; urls that are null or have no host
    share one host; repeated rows stay; other columns are ignored; an empty
    table gives an empty result.  Whole pages are read, however long.
    """
    base = pages.select("page_id", "url", "html", parse(F.col("url"))[0].alias("host"))
    plans = written(wrappers(base), "wrappers")
    size = plans.agg(F.coalesce(F.sum(F.length("wrapper") + F.length("host")), F.lit(0))).first()[0]
    spark, few = pages.sparkSession, size <= BROADCAST
    if few:  # a page brings its host's name, not its wrapper
        joined = base.select("page_id", "url", "html", F.col("host").alias("plan"))
        held = spark.sparkContext.broadcast({r.host: r.wrapper for r in plans.collect()})
    else:  # a host's pages are dealt to several tasks, each of which gets the wrapper
        salts = plans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = base.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int")).join(salts, ["host", "salt"], "left")
        joined, held = joined.select("page_id", "url", "html", F.col("wrapper").alias("plan")), None

    def each(got, seen):
        text = []
        for page, plan in zip(got["html"], got["plan"]):
            if plan is not None and plan not in seen:
                if len(seen) >= 200:
                    seen.clear()
                found = held.value.get(plan) if few else plan
                seen[plan] = None if found is None else judged(Part.of(json.loads(found)))
            text.append(extract(page, seen.get(plan)))
        return {"page_id": got["page_id"], "url": got["url"], "text": text, "n_chars": [len(t) for t in text]}

    return by_batch(joined, each, "page_id bigint, url string, text string, n_chars bigint", dict)


def query(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = None
