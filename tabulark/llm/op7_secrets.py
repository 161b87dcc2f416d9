"""Secret scan: base patterns and an assignment-aware lexer.

Base spans come from three patterns (assignments to sensitive words, access key
ids, long hex runs).  The lexer reads source and configuration syntax into
name-literal pairs: assignments and mappings (name = "literal", name: literal,
"name": literal, name => literal, typed names, subscripts), strings over several
lines, literals in parts and in parentheses, lists, block scalars, elements and
attributes of markup, arguments of setters, command-line flags and credentials
in urls.  Comment signs only separate, so that assignments in comments are read
too; strings that hold pairs are read in their turn.  Names of no meaning, like
value, take that of the block, mapping or element around them.  A name in place
of a literal stands for its assignment in the nearest enclosing scope.  Every
assignment's value, its own literals and those of the names in it, is scored by
the weight of its name and by how random it looks; the literals of values over
the threshold that no base span covers are added as spans of kind lex.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_batch, slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
HEX = re.compile("[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "lex")

#: Words of a target name and their weight; two-word names weigh together.
WEIGHTS = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.6, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "authorization": 0.8, "bearer": 0.8}
PAIRS = {("api", "key"): 1.0, ("access", "key"): 1.0, ("private", "key"): 1.0, ("secret", "key"): 1.0, ("client", "key"): 0.8, ("encryption", "key"): 0.9, ("signing", "key"): 0.9, ("auth", "key"): 0.9}
_WORDS = set(WEIGHTS) | {second for _, second in PAIRS}
#: Stems that the lexer's quick test looks for: every weighted name holds one.
STEMS = tuple(sorted(w for w in _WORDS if not any(o != w and o in w for o in _WORDS)))
PLACEHOLDER = re.compile(r"(?i)^(?:true|false|null|none|nil|undefined|changeme|example|dummy|placeholder|x+|\*+|\$\{.*|\{\{.*|<.*>|%\(.*|os\.|process\.env|getenv.*)$")
THRESHOLD = 0.45

#: Names that take the meaning of what is around them, calls whose argument is the value, words before a credential (fixed values).
NEUTRAL = set("value val text default data content string key name id raw plain literal".split())
PASSING = set("b decode b64decode base64 bytes str string text encode unhexlify fromhex buffer from secretstr quote trim strip concat join format".split())
SCHEMES = set("bearer basic token digest apikey".split())
#: Strings in strings that are read.
NESTED = 3

_STRING = r"""(?:[rRbBuUfF]{0,2}(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|\'\'\'(?:[^\\]|\\.)*?\'\'\'|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+')|`[^`]*+`)"""
_ATTRIBUTE = r"""[\w:.\-]++(?:\s*=\s*(?:"[^"<>]*+"|'[^'<>]*+'))?"""
ENTRY = re.compile(
    rf"""(?P<url>(?<![\w+.\-])[A-Za-z][\w+.\-]*+://[^\s:@/"'<>]*+:(?P<password>[^\s@/"'<>]++)@)
|<(?P<tag>[A-Za-z_][\w:.\-]*+)(?P<attributes>(?:\s++{_ATTRIBUTE})*+)\s*+(?P<empty>/?)>
|(?P<closed></[A-Za-z_][\w:.\-]*+\s*+>)
|(?<![\w$.\-])(?P<quote>\\?["']?)(?P<name>[A-Za-z_$][\w$.\-]*+)(?P=quote)(?:[ \t]*+\])?[ \t]*+(?::[ \t]*+(?P<kind>[A-Za-z_][\w.<>\[\]]*+)(?=[ \t]*+=[^=]))?[ \t]*+(?P<op>=>|:=|(?<![!<>])=(?![=>])|:(?![:/=]))
|(?<![\w$.])(?P<call>[A-Za-z_$][\w$.]*+)\([ \t]*+(?=["'`])
|(?<!\S)--?(?P<flag>[A-Za-z][\w\-]*+)[ \t]++(?=[^\s\-])
|(?<![\w\\])(?P<string>{_STRING})
|(?P<brace>[{{}}])""",
    re.X | re.S,
)
_TEXT = re.compile(_STRING, re.S)
_ESCAPED = re.compile(r"""\\(["'])((?:[^"'\\\n]|\\\\.)*+)\\\1""")
_BARE = re.compile(r"""[^\s;,"'`(){}\[\]&|<>]++""")
_BLOCK = re.compile(r"[|>][+\-]?\d*[ \t]*\n")
_JOIN = re.compile(r"[ \t]*(?:\+|\.(?=[ \t\"'`])|\.\.|&|\|\|)[ \t]*(?:\\?\n[ \t]*)?")
_GAP, _WIDE = re.compile(r"[ \t]*+(?:\\\n[ \t]*+)*+"), re.compile(r"(?:\s|//[^\n]*+|\#[^\n]*+)*+")
_PAIR = re.compile(r"""([\w:.\-]++)\s*=\s*("[^"<>]*+"|'[^'<>]*+')""")
_NAMED = re.compile(r"[A-Za-z_$][\w$.]*+")
_IDENTIFIER = re.compile(r"[A-Za-z_$][A-Za-z_$.\-]*+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def base_spans(text: str, lower: str | None = None) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the base patterns, by start and kind."""
    lower = text.lower() if lower is None else lower
    out = []
    if any(w in lower for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def name_weight(name: str) -> float:
    words = [w if (w := x.lower()) in _WORDS or not w.endswith("s") else w[:-1] for x in _PARTS.findall(name)]
    one = max((WEIGHTS.get(w, 0.0) for w in words), default=0.0)
    return max([one, *(PAIRS.get(p, 0.0) for p in zip(words, words[1:]))])


@dataclass
class Value:
    """What scoring needs of a value, however long: its characters counted, its first ones."""

    counts: Counter = field(default_factory=Counter)
    size: int = 0
    head: str = ""

    def add(self, other: Value) -> None:
        self.counts.update(other.counts)
        self.size += other.size
        if len(self.head) < 64:
            self.head = (self.head + other.head)[:64]

    def score(self) -> float:
        """0 to 1: length, entropy and mixture."""
        if self.size < 6 or " " in self.counts or (self.size <= 64 and PLACEHOLDER.match(self.head)):
            return 0.0
        entropy = -sum(c / self.size * math.log2(c / self.size) for c in self.counts.values())
        kinds = sum(any(f(c) for c in self.counts) for f in (str.islower, str.isupper, str.isdigit)) + (not all(c.isalnum() for c in self.counts))
        return min(1.0, entropy / 4) * (0.5 + 0.5 * min(1.0, self.size / 16)) * (1.0 if kinds >= 2 else 0.6)


def value_of(text: str) -> Value:
    return Value(Counter(text), len(text), text[:64])


def literal_score(text: str) -> float:
    return value_of(text).score()


@dataclass
class Pair:
    """An assignment: its name, the weight of the name, its scope, and terms
    (kind, text, start, end) of kind literal or name."""

    name: str
    weight: float
    scope: int
    terms: list[tuple[str, str, int, int]]


class Lexer:
    """Reads a text into pairs; offsets are those of the whole text."""

    def __init__(self, text: str):
        self.text = text
        self.pairs: list[Pair] = []
        self.outer = [-1]  # of each scope the one around it
        self._read(0, len(text), 0, 0)

    def _read(self, start: int, end: int, scope: int, nested: int) -> None:
        text = self.text
        # what is open: (kind, indent or scope, name)
        open_: list[tuple[str, int, str]] = []
        waiting: str | None = None  # a name whose block begins
        at = start
        while m := ENTRY.search(text, at, end):
            at = m.end()
            if m["name"] is not None:
                line = text.rfind("\n", start, m.start()) + 1
                indent = m.start() - max(line, start)
                ahead = text[max(line, start) : m.start()]
                if not ahead.strip(" \t-"):
                    while open_ and open_[-1][0] == "indent" and open_[-1][1] >= indent:
                        open_.pop()
                name = m["name"]
                got, at, kind = self._value(at, end, m["op"])
                if kind == "block":
                    waiting = name
                    if m["op"] == ":":
                        open_.append(("indent", indent, name))
                elif got:
                    weight = max(self._weight(name, open_), name_weight(m["kind"] or ""))
                    for terms in got:
                        self.pairs.append(Pair(name, weight, scope, terms))
                        self._inside(terms, scope, nested)
                    if any("://" in t[1] and "@" in t[1] for terms in got for t in terms if t[0] == "name"):
                        at = got[0][0][2]  # a url, which may hold credentials
            elif m["string"] is not None:
                cut = _quotes(m["string"])
                self._inside([("literal", "", m.start() + cut[0], m.end() - cut[1])], scope, nested)
            elif m["brace"] == "{":
                self.outer.append(scope)
                scope = len(self.outer) - 1
                open_.append(("brace", scope, waiting or ""))
                waiting = None
            elif m["brace"] == "}":
                while open_ and open_.pop()[0] != "brace":
                    pass
                scope = max(self.outer[scope], 0) if scope else 0
            elif m["tag"] is not None:
                named = m["tag"]
                found = [(a.group(1), a.start(2) + 1, a.end(2) - 1) for a in _PAIR.finditer(text, m.start("attributes"), m.end("attributes"))]
                label = next((text[i:j] for n, i, j in found if n.lower() in ("name", "key", "id")), "")
                for n, i, j in found:
                    if i < j:
                        by = label if n.lower() in ("value", "content") and label else n
                        self.pairs.append(Pair(by, self._weight(by, open_), scope, [("literal", text[i:j], i, j)]))
                        self._inside([("literal", "", i, j)], scope, nested)
                if not m["empty"]:
                    by = label if name_weight(label) > name_weight(named) else named
                    stop = text.find("<", at, end)
                    inner = text[at:stop] if stop > 0 and text.startswith("</", stop) else ""
                    if inner.strip():
                        i = at + len(inner) - len(inner.lstrip())
                        self.pairs.append(Pair(by, self._weight(by, open_), scope, [("literal", inner.strip(), i, i + len(inner.strip()))]))
                    open_.append(("tag", 0, by))
            elif m["closed"] is not None:
                if any(o[0] == "tag" for o in open_[-64:]):
                    while open_ and open_.pop()[0] != "tag":
                        pass
            elif m["url"] is not None:
                self.pairs.append(Pair("password", 1.0, scope, [("literal", m["password"], m.start("password"), m.end("password"))]))
            elif m["call"] is not None:
                weight = name_weight(m["call"])
                if weight > 0 and not m["call"].lower().split(".")[-1].startswith(("get", "read", "load", "is", "has", "env", "find")):
                    got, at, _ = self._value(at, end, "(")
                    for terms in got[:1]:
                        self.pairs.append(Pair(m["call"], weight, scope, terms))
            elif m["flag"] is not None and name_weight(m["flag"]) > 0:
                got, at, _ = self._value(at, end, "=")
                for terms in got[:1]:
                    self.pairs.append(Pair(m["flag"], name_weight(m["flag"]), scope, terms))

    def _inside(self, terms, scope: int, nested: int) -> None:
        """The pairs in strings."""
        if nested < NESTED:
            for kind, _, i, j in terms:
                if kind == "literal" and (self.text.find("=", i, j) >= 0 or self.text.find(":", i, j) >= 0):
                    self._read(i, j, scope, nested + 1)

    def _weight(self, name: str, open_: list[tuple[str, int, str]]) -> float:
        """The weight of a name; a neutral one has that of the nearest other name around it."""
        if all(w.lower() in NEUTRAL for w in _PARTS.findall(name)):
            for _, _, around in reversed(open_):
                if around and not all(w.lower() in NEUTRAL for w in _PARTS.findall(around)):
                    return name_weight(around)
        return name_weight(name)

    def _value(self, at: int, end: int, op: str):
        """The values that begin here, each as its terms, where they end, and "block" if a block follows instead."""
        text = self.text
        at = _GAP.match(text, at, end).end()
        if op == ":" and (m := _BLOCK.match(text, at, end)):
            return self._block_scalar(m.end(), end)
        if at < end and text[at] == "\n":
            if op == ":":
                return [], at, "block"
            at = _WIDE.match(text, at, end).end()
        if at >= end:
            return [], at, ""
        if text[at] == "{":
            return [], at, "block"
        if text[at] == "[":
            out = []
            at += 1
            while at < end:
                at = _WIDE.match(text, at, end).end()
                terms, after = self._terms(at, end, False)
                if not terms or after == at:
                    break
                out.append(terms)
                at = _WIDE.match(text, after, end).end()
                if at >= end or text[at] != ",":
                    break
                at += 1
            return out, at, ""
        wide = text[at] == "("
        if wide:
            at = _WIDE.match(text, at + 1, end).end()
        terms, at = self._terms(at, end, wide)
        return ([terms] if terms else []), at, ""

    def _block_scalar(self, at: int, end: int):
        text, first, deep, last = self.text, at, None, at
        while at < end:
            stop = text.find("\n", at, end)
            stop = end if stop < 0 else stop
            line = text[at:stop]
            if line.strip():
                indent = len(line) - len(line.lstrip(" \t"))
                if deep is None:
                    before = text.rfind("\n", 0, first - 1) + 1
                    deep = indent if indent > len(text[before:first]) - len(text[before:first].lstrip(" \t")) else 10**9
                if indent < deep:
                    break
                last = stop
            at = stop + 1
        body = text[first:last].strip()
        if not body:
            return [], last, ""
        i = text.index(body, first)
        return [[("literal", "".join(body.split()), i, i + len(body))]], last, ""

    def _terms(self, at: int, end: int, wide: bool):
        """The terms of one value and where it ends."""
        text, out = self.text, []
        while at < end:
            if m := _TEXT.match(text, at, end):
                i, j = _quotes(m[0])
                body = text[m.start() + i : m.end() - j]
                if body:
                    out.append(("literal", body, m.start() + i, m.end() - j))
                at = m.end()
            elif m := _ESCAPED.match(text, at, end):
                if m[2]:
                    out.append(("literal", m[2], m.start(2), m.end(2)))
                at = m.end()
            elif m := _BARE.match(text, at, end):
                word = m[0]
                if m.end() < end and text[m.end()] == "(":
                    if word.lower().split(".")[-1] not in PASSING:
                        return out, m.end()
                    at = _WIDE.match(text, m.end() + 1, end).end()
                    wide = True
                    continue
                if word.lower() in SCHEMES and (n := _BARE.match(text, _GAP.match(text, m.end(), end).end(), end)):
                    m, word = n, n[0]
                kept = word.rstrip(".:") or word
                parts = kept.split("+")
                if len(parts) > 1 and all(_NAMED.fullmatch(p) for p in parts):  # names joined without spaces
                    i = m.start()
                    for p in parts:
                        out.append(("name", p, i, i + len(p)))
                        i += len(p) + 1
                else:
                    kind = "name" if _NAMED.match(kept) else "literal"
                    out.append((kind, kept, m.start(), m.start() + len(kept)))
                at = m.end()
            else:
                break
            gap = (_WIDE if wide else _GAP).match(text, at, end).end()
            if m := _JOIN.match(text, gap, end):
                at = (_WIDE if wide else _GAP).match(text, m.end(), end).end()
            elif out and out[-1][0] == "literal" and gap < end and text[gap] in "\"'`" and text[at - 1] in "\"'`":
                at = gap
            else:
                break
        return out, at


def _quotes(string: str) -> tuple[int, int]:
    """Characters before and after a string's content."""
    start = len(string) - len(string.lstrip("rRbBuUfF"))
    n = 3 if string[start : start + 3] in ('"""', "\'\'\'") and len(string) >= start + 6 else 1
    return start + n, n


def lexed_spans(text: str) -> list[tuple[int, int]]:
    """Spans of the literals of sensitive values.

    A name stands for its nearest assignment before in the same scope or one
    around it, else for its first; names that reach themselves add nothing.
    The literals of a name's other assignments go with it.
    """
    lexer = Lexer(text)
    pairs = lexer.pairs
    first: dict[str, int] = {}
    every: dict[str, list[int]] = {}
    last: dict[tuple[str, int], int] = {}
    for i, p in enumerate(pairs):
        first.setdefault(p.name, i)
        every.setdefault(p.name, []).append(i)
    links: list[list[int]] = []
    for i, p in enumerate(pairs):
        mine = []
        for kind, term, _, _ in p.terms:
            j = -1
            if kind == "name" and term in first:
                scope = p.scope
                while scope >= 0 and j < 0:
                    j = last.get((term, scope), -1)
                    scope = lexer.outer[scope]
                j = first[term] if j < 0 else j
            mine.append(j)
        links.append(mine)
        last[(p.name, p.scope)] = i

    def literal(i: int, k: int) -> bool:
        """Whether a term counts as a literal: a word that no assignment explains must hold a digit."""
        kind, term, _, _ = pairs[i].terms[k]
        return links[i][k] < 0 and (kind == "literal" or not _IDENTIFIER.fullmatch(term))

    values: list[Value | None] = [None] * len(pairs)
    state = bytearray(len(pairs))
    for root in range(len(pairs)):
        todo = [root]
        while todo:
            i = todo[-1]
            if state[i] == 2:
                todo.pop()
                continue
            more = [j for j in links[i] if j >= 0 and state[j] == 0] if state[i] == 0 else []
            state[i] = 1
            if more:
                todo += more
                continue
            v = Value()
            for k, j in enumerate(links[i]):
                if literal(i, k):
                    v.add(value_of(pairs[i].terms[k][1]))
                elif j >= 0 and state[j] == 2:  # else a circle
                    v.add(values[j])
            values[i], state[i] = v, 2
            todo.pop()
    found: set[tuple[int, int]] = set()
    todo = [i for i, p in enumerate(pairs) if p.weight > 0 and p.weight * values[i].score() >= THRESHOLD]
    seen = set(todo)
    while todo:
        i = todo.pop()
        for k, j in enumerate(links[i]):
            if literal(i, k):
                found.add(pairs[i].terms[k][2:])
            elif j >= 0:
                for n in every[pairs[j].name]:
                    if n not in seen and (n == j or pairs[n].scope == pairs[j].scope and (" " not in values[n].counts and not PLACEHOLDER.match(values[n].head))):
                        seen.add(n)
                        todo.append(n)
    return sorted(found)


def scan(text: str | None) -> list[tuple[int, int, int, int]]:
    """All spans of a text as (start, kind, end, start of the value)."""
    if not text:
        return []
    lower = text.lower()
    base = base_spans(text, lower)
    if (("=" in text or ":" in text or "<" in text or "(" in text or "--" in text) and any(s in lower for s in STEMS)) or ("://" in text and "@" in text):
        extra = [(s, 3, e, s) for s, e in lexed_spans(text) if not any(b[0] <= s and e <= b[2] for b in base)]
        return sorted(base + extra)
    return base


def _line(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_lex of each row
    of docs(doc_id, text, ...).  Null and empty texts have no spans (the digest
    of nothing); repeated rows stay; other columns are ignored; an empty table
    gives an empty result.  Offsets are code points, ends are exclusive."""

    def each(got, _):
        spans = [scan(t) for t in got["text"]]
        base = [[x for x in s if x[1] < 3] for s in spans]
        count = lambda k, rows: [sum(x[1] == k for x in s) for s in rows]
        return {"doc_id": got["doc_id"], "n_assign": count(0, base), "n_access": count(1, base), "n_hex": count(2, base), "base_sha256": [hashlib.sha256(_line(s).encode()).hexdigest() for s in base], "spans": [_line(s) for s in spans], "n_lex": count(3, spans)}

    return by_batch(docs.select("doc_id", "text"), each, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_lex bigint")


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """text with the value of every span replaced; overlapping spans as one."""
    spans = sorted((v, e) for _, _, e, v in scan(text))
    if not spans:
        return text
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame) -> DataFrame:
    """All rows and columns, secrets in text replaced; n_chars, if there, follows."""
    names = [c.lower() for c in docs.columns]
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            old = batch.column(at).to_pylist()
            new = [redact(t) for t in old]
            if new != old:
                batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
                if size is not None:
                    n = [k if a is b or a == b else len(b) for k, a, b in zip(batch.column(size).to_pylist(), old, new)]
                    batch = batch.set_column(size, batch.schema.field(size), pa.array(n, batch.schema.field(size).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = None
