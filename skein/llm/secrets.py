"""Secret scans by assignment-aware lexing: name-literal pairs of source and configuration syntax, constants propagated to
where they are used, and scores of literals by the sensitive names that they reach."""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm.common import rows_by_bytes, tidy, with_texts

KINDS = ("assign", "access", "hex", "literal")
_MARKS = (b"=", b":", b"</", b"--", b"#")
_KEYWORDS = (b"passw", b"secret", b"token", b"api")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: The runs are maximal, so the least length can stand in the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_HEX_BYTES = re.compile(rb"[0-9a-f]{24}")
#: Pieces of source and configuration syntax. Repeats are possessive, so they need no bound to stay linear.
_NAME = r"[A-Za-z0-9_$][A-Za-z0-9_$.-]*+"
_STRING = r"""(?:"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+'|`(?:[^`\\\n]++|\\.)*+`)"""
_TRIPLE = r"""(?:\"{3}(?:[^"\\]++|\\.|"(?!""))*+\"{3}|'{3}(?:[^'\\]++|\\.|'(?!''))*+'{3})"""
_MARK = r"(?::=|=>|=(?![=>])|:(?![:/=]))"
_BLANKS, _MAY_BREAK = r"[ \t]*+", r"[ \t]*+(?:\\?\r?\n[ \t]*+)?"
#: Words that nothing is assigned to, in one piece.
_PROSE = re.compile(r"(?:[A-Za-z0-9]++[ \n,]++(?![=:\[(]))++")
_OTHER = re.compile(r"[^A-Za-z0-9_$\"'`<#-]++")
_WORD = re.compile(_NAME, re.ASCII)
_QUOTED = re.compile(f"{_TRIPLE}|{_STRING}", re.DOTALL)
#: What may follow a target name or a quoted key: subscripts, then a mark, also with a declared type before it.
_SUBSCRIPTS = rf"((?:\[{_BLANKS}(?:{_STRING}|{_NAME}){_BLANKS}\])*+)"
_TARGET = re.compile(rf"({_NAME}){_SUBSCRIPTS}{_BLANKS}(?::{_BLANKS}[A-Za-z_][A-Za-z0-9_.<>|?]*+(?:\[\])?{_BLANKS}=(?![=>])|({_MARK})){_BLANKS}", re.ASCII)
_AFTER_KEY = re.compile(rf"{_BLANKS}{_MARK}{_BLANKS}")
_DEFINE = re.compile(rf"#{_BLANKS}define[ \t]++({_NAME})[ \t]++(?=[\"'])", re.ASCII)
_OPTION = re.compile(r"(?<![A-Za-z0-9-])--?([A-Za-z][A-Za-z0-9_-]*+)[ \t]++(?=[^ \t\n-])", re.ASCII)
_ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:-]*+)(?:[ \t][^<>\n]*+)?>[ \t\n]*+([^<>]*?)[ \t\n]*+</\1>", re.ASCII)
_BLOCK = re.compile(r"[|>][+-]?[0-9]?[+-]?[ \t]*+\r?\n")
_LINE = re.compile(r"([ \t]*+)([^\n]*+)\n?")
_PREFIX = re.compile(r"(?:[rRbBuUfF]{1,2}|[@$]{1,2})(?=[\"'`])")
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>|&\\:=]++={0,2}")
_SCHEME = re.compile(r"(?:bearer|basic|token)[ \t]++(?=[^\s\"'`,;(){}\[\]<>|&\\:=])", re.IGNORECASE)
_CALL = re.compile(rf"({_NAME})\(([^()\n]*+)\)", re.ASCII)
_JOIN = re.compile(rf"{_MAY_BREAK}(?:\+|\.\.?|&|\|\|)(?![+=&|]){_MAY_BREAK}")
_NEXT_TO = re.compile(rf"{_MAY_BREAK}(?=[\"'`])")
_ENDS_KEY = re.compile(rf"(?:{_STRING}){_BLANKS}{_MARK}")
_SUM = re.compile(rf"[A-Za-z_$][A-Za-z0-9_$.]*+(?:\+[A-Za-z_$][A-Za-z0-9_$.]*+)*+", re.ASCII)
_OPENS = re.compile(r"\(\s*+(?=[rRbBuUfF]{0,2}[\"'`])")
_IN_URL = re.compile(r"://[^/\s:@\"'`<>]*+:([^/\s@\"'`<>]++)@")
_KEY_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]*+)-----")
_ENVIRONMENT = re.compile(r"env|config|secret_?manager|vault|input|prompt|lookup|get_?pass", re.IGNORECASE)
#: Parts of sensitive names and their weights, and words that mark a stand-in.
_SENSITIVE = {"password": 3.0, "passwd": 3.0, "passphrase": 3.0, "pwd": 2.5, "secret": 2.5, "token": 2.0, "apikey": 2.5, "credential": 2.0, "credentials": 2.0, "auth": 1.5, "authorization": 2.0, "bearer": 2.0, "private": 1.5, "key": 1.0, "access": 1.0, "signing": 1.0, "encryption": 1.0, "salt": 1.0, "client": 0.3, "api": 0.7}
_HARMLESS = {"public": -2.0, "id": -1.0, "name": -1.0, "type": -1.5, "url": -1.5, "path": -1.5, "file": -1.0, "length": -2.0, "count": -2.0, "max": -1.5, "tokens": -2.0, "expiry": -1.5, "hint": -1.0, "field": -1.0, "header": -1.0}
_STANDIN_PART = re.compile(r"\$\{|\{\{|<[a-z]|change.?me|example|placeholder|your[_-]|dummy|os\.|getenv|environ|process\.", re.IGNORECASE | re.ASCII)
_STANDIN_WHOLE = re.compile(r"(?:x+|\*+|\.+|true|false|null|none|undefined|self|this|string|str|int)", re.IGNORECASE | re.ASCII)
#: Characters kept of a joined value's ends: more than any stand-in is long, those of one repeated character aside.
_EDGE = 16
LEAST_SCORE = 3.5


def name_parts(name: str) -> list[str]:
    """Words of a dotted, snake- or camel-case name, lower-cased."""
    return [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", name)]


def name_score(name: str) -> float:
    parts = name_parts(name)
    both = [*parts, *(a + b for a, b in zip(parts, parts[1:]))]  # noqa: B905
    return sum(_SENSITIVE.get(p, 0.0) + _HARMLESS.get(p, 0.0) for p in set(both))


@dataclass(slots=True)
class Stats:
    """What the score of a joined text needs of it; a join adds its parts' stats and looks at the seam."""

    n: int = 0
    spaces: int = 0
    standin: bool = False
    head: str = ""
    tail: str = ""
    counts: dict[str, float] = field(default_factory=dict)

    def add(self, other: Stats) -> None:
        self.standin = self.standin or other.standin or _STANDIN_PART.search(self.tail + other.head) is not None
        self.head, self.tail = (self.head + other.head)[:_EDGE], (self.tail + other.tail)[-_EDGE:]
        # beyond these bounds the score stays the same; shares of characters are kept when constants double on and on
        self.n, self.spaces = min(self.n + other.n, 1 << 60), min(self.spaces + other.spaces, 1 << 20)
        for c, k in other.counts.items():
            self.counts[c] = self.counts.get(c, 0.0) + k
        if (total := sum(self.counts.values())) > 1e200:
            self.counts = {c: k / total for c, k in self.counts.items()}

    def score(self) -> float:
        """Length, variety of characters and entropy speak for a secret; stand-ins, prose and plain words against."""
        alike = self.counts.keys() <= {"x", "X"} or len(self.counts) == 1 and self.head[0] in "*."
        if self.n < 6 or self.standin or alike or (self.n <= _EDGE and _STANDIN_WHOLE.fullmatch(self.head)):
            return -9.0
        total, seen = sum(self.counts.values()), "".join(self.counts)
        shares = [k / total for k in self.counts.values()]
        entropy = -sum(p * math.log2(p) for p in shares if p > 0)
        kinds = sum(bool(re.search(p, seen)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9\s]"))
        return min(2.0, self.n / 16) + max(-1.0, min(2.0, entropy - 2.5)) + 0.5 * (kinds - 2) - 1.5 * self.spaces


def text_stats(text: str) -> Stats:
    return Stats(len(text), text.count(" "), _STANDIN_PART.search(text) is not None, text[:_EDGE], text[-_EDGE:], dict(Counter(text)))


#: A literal: where it stands and its text.
Literal = tuple[int, int, str]


@dataclass(slots=True, eq=False)
class Use:
    """A bare word, or several with plus signs between: values of names if all of them have one, else a literal."""

    names: list[str]
    literal: Literal


@dataclass(slots=True, eq=False)
class Value:
    """A right-hand side: its parts are literals or the values that names hold; shared, never unfolded. A part that leads
    back to the value itself counts for nothing."""

    parts: list[Literal | Use | Value]
    stats: Stats | None = None
    open: bool = False

    def measured(self) -> Stats:
        stack = [self]
        while stack:
            top = stack[-1]
            if top.stats is None:
                if not top.open:
                    top.open = True
                    if missing := [p for p in top.parts if isinstance(p, Value) and p.stats is None and not p.open]:
                        stack += missing
                        continue
                top.stats = Stats()
                for p in top.parts:
                    if not isinstance(p, Value):
                        top.stats.add(text_stats(p[2]))
                    elif p.stats is not None:
                        top.stats.add(p.stats)
            stack.pop()
        return self.stats

    def take_spans(self, found: set[tuple[int, int]]) -> None:
        """Adds the spans of all literals below; a value gives its parts up, so each is walked once."""
        stack = [self]
        while stack:
            top = stack.pop()
            parts, top.parts = top.parts, []
            for p in parts:
                if isinstance(p, Value):
                    stack.append(p)
                elif p[0] < p[1]:
                    found.add(p[:2])


def _inside(m: re.Match) -> tuple[int, int]:
    """The ends of a quoted text without its quotes."""
    n = 3 if m[0][:3] in ('"""', "'''") and len(m[0]) >= 6 else 1
    return m.start() + n, m.end() - n


class Lexer:
    """Name-literal pairs of a text: ``pairs`` holds (place, name, parts) of every assignment, in source code, JSON, YAML with
    block texts, INI and properties, XML elements and key-value attributes, command options, definitions, URLs and PEM keys.

    Quoted texts that hold assignments themselves, as connection strings do, are lexed inside as well. Marks of comments end
    nothing: what a comment assigns is a pair like any other.
    """

    def __init__(self, text: str):
        self.text, self.pairs = text, []
        todo = [(0, len(text))]
        while todo:
            todo += self._region(*todo.pop())
        if "://" in text:
            self.pairs += [(m.start(1), "url.password", [(*m.span(1), m[1])]) for m in _IN_URL.finditer(text)]
        if "-----BEGIN " in text:
            self._pem()
        self.pairs.sort(key=lambda p: p[0])

    def _region(self, at: int, end: int):
        """Lexes from at to end and gives the quoted regions to lex next."""
        text, last = self.text, None  # last: (where it ends, name, literal) of the pair before, for key and value attributes
        while at < end:
            c = text[at]
            if m := _PROSE.match(text, at, end):
                at = m.end()
            elif c in "\"'`":
                m = _QUOTED.match(text, at, end)
                if not m:
                    at += 1
                    continue
                a, b = _inside(m)
                if (after := _AFTER_KEY.match(text, m.end(), end)) and _WORD.fullmatch(text, a, b):
                    self._pair(m.start(), text[a:b], after.end(), end)
                if a > at + 1 or any(x in text[a:b] for x in "=:"):
                    yield a, b
                at = m.end()
            elif m := _TARGET.match(text, at, end):
                name = m[1] + "".join(f".{x}" for x in _WORD.findall(m[2])) if m[2] else m[1]
                parts = self._pair(at, name, m.end(), end)
                if last and name.lower() == "value" and last[1].lower() in ("key", "name") and not re.search(r"[>\n;]", text[last[0] : at]):
                    self.pairs.append((at, last[2], parts))
                single = parts[0] if len(parts) == 1 and isinstance(parts[0], tuple) else None
                last = (m.end(), name, single[2]) if single else None
                at = m.end()
            elif c == "<":
                if m := _ELEMENT.match(text, at, end):
                    if m[2]:
                        self.pairs.append((at, m[1], [(*m.span(2), m[2])]))
                    at = m.start(2)
                else:
                    at += 1
            elif c == "#":
                m = _DEFINE.match(text, at, end)
                if m:
                    self._pair(at, m[1], m.end(), end)
                at = m.end() if m else at + 1
            elif c == "-":
                m = _OPTION.match(text, at, end)
                if m:
                    self._pair(at, m[1], m.end(), end)
                at = m.end() if m else at + 1
            elif m := _WORD.match(text, at, end):
                at = m.end()
            else:
                at = m.end() if (m := _OTHER.match(text, at, end)) else at + 1

    def _pair(self, place: int, name: str, at: int, end: int) -> list:
        parts = self._value(place, at, end)
        if parts:
            self.pairs.append((place, name, parts))
        return parts

    def _value(self, place: int, at: int, end: int) -> list:
        text = self.text
        if m := _BLOCK.match(text, at, end):
            return self._block(place, m.end(), end)
        if m := _OPENS.match(text, at, end):
            at = m.end()
        parts: list = []
        while True:
            got = self._operand(at, end)
            if got is None:
                return parts
            more, at, was_quoted = got
            parts += more
            if j := _JOIN.match(text, at, end):
                at = j.end()
            elif was_quoted and (j := _NEXT_TO.match(text, at, end)) and not _ENDS_KEY.match(text, j.end(), end):
                at = j.end()
            else:
                return parts

    def _operand(self, at: int, end: int):
        """(parts, end, whether it is quoted) of one operand, or None."""
        text = self.text
        if m := _PREFIX.match(text, at, end):
            at = m.end()
        if m := _QUOTED.match(text, at, end):
            a, b = _inside(m)
            return [(a, b, text[a:b])] if a < b else [], m.end(), True
        if m := _CALL.match(text, at, end):
            if _ENVIRONMENT.search(m[1]):
                return [], m.end(), False
            inner = [_inside(x) for x in _QUOTED.finditer(text, m.start(2), m.end(2))]
            return [(a, b, text[a:b]) for a, b in inner if a < b], m.end(), False
        if m := _SCHEME.match(text, at, end):
            at = m.end()
        if not (m := _BARE.match(text, at, end)):
            return None
        word = m[0].rstrip(".!?:")
        if not word:
            return None
        literal = (at, at + len(word), word)
        return [Use(word.split("+"), literal)] if _SUM.fullmatch(word) else [literal], at + len(word), False

    def _block(self, place: int, at: int, end: int) -> list:
        """The lines of a YAML block text: those indented deeper than the key's line."""
        text, parts = self.text, []
        begin = text.rfind("\n", 0, place) + 1
        indent = len(_LINE.match(text, begin)[1])
        while at < end and (m := _LINE.match(text, at, end)):
            if m[2].strip() and len(m[1]) <= indent:
                break
            if m[2].strip():
                parts.append((*m.span(2), m[2]))
            at = m.end()
        return parts

    def _pem(self) -> None:
        """Keys between their BEGIN and END lines: the label is the name, the lines are the literal."""
        text, done, without = self.text, 0, set()
        for m in _KEY_BEGIN.finditer(text):
            if m.start() < done or m[1] in without:
                continue
            end = text.find(f"-----END {m[1]}-----", m.end())
            if end < 0:
                without.add(m[1])
                continue
            done = end
            lines = [x for x in re.finditer(r"[A-Za-z0-9+/=]{8,}", text[m.end() : end])]
            if lines:
                self.pairs.append((m.start(), m[1].lower().replace(" ", "_"), [(m.end() + x.start(), m.end() + x.end(), x[0]) for x in lines]))


def lexed_literals(text: str) -> list[tuple[int, int]]:
    """Spans of literals whose name, or a name that they reach through other names, is sensitive enough.

    A use of a name means its last definition before, or else its first one after: names may be defined below their use.
    """
    pairs = [(place, name, Value(parts)) for place, name, parts in Lexer(text).pairs]
    held: dict[str, tuple[list[int], list[Value]]] = {}
    for place, name, value in pairs:
        places, values = held.setdefault(name, ([], []))
        places.append(place)
        values.append(value)
    for place, _, value in pairs:
        resolved: list = []
        for p in value.parts:
            if not isinstance(p, Use):
                resolved.append(p)
            elif all(n in held for n in p.names):
                for n in p.names:
                    places, values = held[n]
                    i = bisect.bisect_left(places, place)
                    if (found := values[i - 1] if i else values[0]) is not value:
                        resolved.append(found)
            elif not re.fullmatch(r"[A-Za-z_$.]*", p.literal[2]):
                resolved.append(p.literal)
        value.parts = resolved
    sensitive = [value for _, name, value in pairs if value.parts and (score := name_score(name)) > 0 and score + value.measured().score() >= LEAST_SCORE]
    spans: set[tuple[int, int]] = set()
    for value in sensitive:
        value.take_spans(spans)
    return sorted(spans)


def scan(raw: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points of a whole text, by start and then kind."""
    lower = raw.lower()
    named = any(k in lower for k in _KEYWORDS)
    marks = any(k in raw for k in _MARKS)  # every pair has one; names may be joined of parts, so they can't be looked up
    access, hexes = b"AKIA" in raw, _HEX_BYTES.search(raw) is not None
    if not (marks or access or hexes):
        return []
    text, found = raw.decode(), []
    if named:
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if access:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    if hexes:
        found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    if marks:
        found += [("literal", a, b) for a, b in lexed_literals(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_OUT = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` of every document: the kinds assign, access and hex by their patterns, literal by lexing.

    Offsets are code points, the end exclusive. Null and empty texts have no span; repeated rows are scanned each; a null
    doc_id stays null; other columns are not read. A text is scanned whole, in time that grows with its length.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("spans", span)])

    def run(batches):
        for batch in rows_by_bytes(batches):
            got = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(got, span)], schema=schema)

    return with_texts(docs, "doc_id").mapInArrow(tidy(run), _OUT)


def span_digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Counts and digest of the base kinds, and all spans as one string."""
    from pyspark.sql import functions as F

    text = lambda of: F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(F.encode(text(base), "UTF-8"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``."""
    return span_digest(find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")), KINDS[:3])


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
