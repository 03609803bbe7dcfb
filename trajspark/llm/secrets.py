"""Secret scans by assignment-aware lexing.

Base spans are matches of fixed patterns. The lexer adds spans of kind `pair`. It cuts a text into tokens of source and
configuration syntax: strings with escapes, triple-quoted and back-quoted ones, comments, names, operators, brackets and line
ends with their indentation. From these it reads name-literal pairs:

* `name = "literal"`, `name := `, `name => `, `name: type = `, `export NAME=value`, `"name": "value"`, `cfg["name"] = `;
* values on the next, deeper line (`name:` in YAML, also with `|` and `>`), behind a line that goes on (`\\` or an open
  bracket), and literals joined by `+`, `.` or standing side by side;
* tags: attributes, `<name>value</name>`, and a name and a value that stand in two attributes, elements or entries
  (`<add key="name" value="..."/>`, `name: X` above `value: ...`, `<key>name</key><string>value</string>`).

What comments hold is read as well, apart from the text around them. Constants are propagated: a name whose value is
another assigned name, or literals joined with one, takes that name's literal, in order of the text. A literal is scored by
its target name and its own shape; if the score reaches the threshold, it is a span at the place where it stands (from its
first piece to its last, where it is joined). Base spans are always kept; a pair span inside a base span of its own text is
not repeated. Texts without any part of a sensitive name can have no such span and aren't cut into tokens.

Defined results: a null text is empty; every row gives one result row, so repeated ids repeat, and an empty table gives
an empty result. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship

# Base patterns, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
LEAST = {"assign": 6, "access": 20, "hex": 24}

# Name parts and the weight each adds to a literal's score.
NAME_WEIGHTS = {
    "password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 3, "apikey": 3, "api_key": 3,
    "private_key": 3, "access_key": 3, "credential": 3, "credentials": 3, "auth": 2, "bearer": 2, "session": 1,
    "signature": 1, "salt": 1, "key": 1, "pass": 2, "cert": 1, "webhook": 1, "connection_string": 2, "dsn": 2,
}
PLACEHOLDERS = {"changeme", "example", "placeholder", "none", "null", "true", "false", "undefined", "xxxxxx", "your_key"}

NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.\-]*\Z")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
THRESHOLD = 4.0
SENSITIVE = re.compile("(?ai:" + "|".join(sorted({n.split("_")[0] for n in NAME_WEIGHTS})) + ")")

TOKEN = re.compile(
    r"""(?P<triple>[rRbBuUfF]{0,2}(?P<q>\"\"\"|''')(?P<body3>(?:\\.|(?!(?P=q))[^\\])*+)(?P=q))
    |(?P<string>[rRbBuUfF]{0,2}(?:"(?P<dq>(?:[^"\\\n]|\\.)*+)"|'(?P<sq>(?:[^'\\\n]|\\.)*+)'|`(?P<bq>[^`\n]*+)`))
    |(?P<comment><!--(?P<c1>.*?)-->|/\*(?P<c2>.*?)\*/|(?:(?<=\s)|^)\#(?P<c3>[^\n]*+)|(?<![:\w])//(?P<c4>[^\n]*+))
    |(?P<goes>\\\r?\n[ \t]*+)
    |(?P<line>\r?\n[ \t]*+)
    |(?P<space>[ \t\r\x0b\x0c]++)
    |(?P<prose>(?:[A-Za-z][a-z]*+[,.;]?[ ]++(?=[A-Za-z])){3,}+)
    |(?P<name>[A-Za-z_$@][A-Za-z0-9_$\-]*+(?:\.[A-Za-z_$][A-Za-z0-9_$\-]*+)*+)
    |(?P<op>:=|=>|==+|!=|<=|>=|\+=|\?=|::|[=:+,;.()\[\]{}<>/|])
    |(?P<other>[^\x00-\x7f]++|.)""",
    re.X | re.S | re.M,
)
BARE = re.compile(r"[^\s\"',;#(){}\[\]<>`]++")
TAG = re.compile(r"""<(?P<tag>[A-Za-z][\w:.\-]*+)(?P<attributes>(?:\s++[\w:.\-]++\s*+=\s*+(?:"[^"]*+"|'[^']*+'))*+)\s*+(?P<alone>/?)>(?P<text>[^<]*+)""")
ATTRIBUTE = re.compile(r"""([\w:.\-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)')""")
#: fixed values: names under which another name, and its value, are written
NAMING, VALUED = {"name", "key", "id", "var", "variable"}, {"value", "string", "content", "val", "default"}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def entropy(literal: str) -> float:
    """Bits for each character, from the literal's own character counts."""
    n = len(literal)
    return -sum(c / n * math.log2(c / n) for c in Counter(literal).values()) if n else 0.0


def name_score(name: str) -> int:
    plain = CAMEL.sub("_", name).lower().replace("-", "_").replace(".", "_").strip("_$")
    parts = set(plain.split("_"))
    pairs = {f"{a}_{b}" for a, b in zip(plain.split("_"), plain.split("_")[1:], strict=False)}
    return max((w for part, w in NAME_WEIGHTS.items() if part in parts or part in pairs), default=0)


def literal_score(literal: str) -> float:
    if len(literal) < 6 or literal.lower() in PLACEHOLDERS or literal[:1] in "$<%" or "{{" in literal:
        return -10.0
    classes = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9\s]"))
    return (entropy(literal) >= 3.0) + (classes >= 2) + (len(literal) >= 12) - 2.0 * bool(re.search(r"\s", literal))


Pair = tuple[str, str, int, int]  # name, literal, and the span where it stands


class Lexer:
    """Name-literal pairs of a text, in order; constants are those of the whole text so far."""

    def __init__(self, known: dict[str, tuple[str, int, int]]):
        self.known = known
        self.found: list[Pair] = []

    def read(self, text: str, begin: int = 0, end: int | None = None) -> None:
        end = len(text) if end is None else end
        tokens: list[tuple[str, str, int, int]] = []  # kind, what it says, span of that
        comments = []
        for m in TOKEN.finditer(text, begin, end):
            kind = m.lastgroup if m.lastgroup in ("line", "goes", "space", "name", "op", "other", "prose") else None
            if kind in ("space", "goes"):
                continue
            if kind is None:
                if m["comment"] is not None:
                    part = next(c for c in ("c1", "c2", "c3", "c4") if m[c] is not None)
                    comments.append(m.span(part))
                    continue
                part = next(c for c in ("body3", "dq", "sq", "bq") if m[c] is not None)
                tokens.append(("text", m[part], *m.span(part)))
            else:
                tokens.append((kind, m[0], m.start(), m.end()))
        self.text, self.tokens, self.end = text, tokens, end
        for i, (kind, said, *_) in enumerate(tokens):
            if kind == "op" and said in ("=", ":", ":=", "=>", "?=", "+="):
                self._assignment(i, said)
        for start, stop in comments:
            inner = Lexer(self.known)
            inner.read(text, start, stop)
            self.found += inner.found

    def _targets(self, i: int, op: str) -> list[str]:
        """The names that are left of the operator at token i: two in `name: type = value`, which may also be `note: name = value`."""
        at = i - 1
        if at < 0:
            return []
        kind, said, *_ = self.tokens[at]
        if kind == "op" and said == "]" and at >= 2 and self.tokens[at - 2][1] == "[" and self.tokens[at - 1][0] in ("text", "name"):
            out = [self.tokens[at - 1][1]]
        elif kind == "text":
            return [said] if NAME.match(said) else []
        else:
            out = [said] if kind == "name" else []
        if op == "=":
            back = at
            while back >= 1 and (self.tokens[back][0] == "name" or self.tokens[back][0] == "op" and self.tokens[back][1] in "[].,|<>"):
                back -= 1
            if 1 <= back < at and self.tokens[back][1] == ":" and self.tokens[back - 1][0] == "name":
                out.append(self.tokens[back - 1][1])
        return out

    def _is_type(self, at: int) -> bool:
        """Whether what stands from token `at` on is the type in `name: type = value`."""
        while at < len(self.tokens) and (self.tokens[at][0] == "name" or self.tokens[at][0] == "op" and self.tokens[at][1] in "[].,|<>"):
            at += 1
        return at < len(self.tokens) and self.tokens[at][1] == "="

    def _indent(self, i: int) -> int:
        """Spaces before the first token of the line of token i."""
        start = self.text.rfind("\n", 0, self.tokens[i][2]) + 1
        return _blanks(self.text, start)

    def _assignment(self, i: int, op: str) -> None:
        for name in self._targets(i, op):
            self._right(name, i, op)

    def _right(self, name: str, i: int, op: str) -> None:
        at, brackets = i + 1, 0
        if op == ":" and self._is_type(at):
            return
        while at < len(self.tokens):
            kind, said, start, _ = self.tokens[at]
            if kind == "op" and said == "(":
                brackets += 1
            elif kind == "op" and said in "|>" and op == ":" and at == i + 1:
                self._block(name, i, at)
                return
            elif kind == "line" and (brackets or (op == ":" and at + 1 < len(self.tokens) and self._indent(at + 1) > self._indent(i))):
                pass
            else:
                break
            at += 1
        if at < len(self.tokens) and self.tokens[at][0] != "line":
            self._value(name, at, brackets)

    def _block(self, name: str, i: int, at: int) -> None:
        """A YAML block: the deeper lines behind the name."""
        start = self.text.find("\n", self.tokens[at][2], self.end)
        stop, last, least = start, start, _blanks(self.text, self.text.rfind("\n", 0, self.tokens[i][2]) + 1)
        while stop >= 0:
            line_end = self.text.find("\n", stop + 1, self.end)
            line_end = self.end if line_end < 0 else line_end
            line = self.text[stop + 1 : line_end]
            if line.strip() and _blanks(self.text, stop + 1) <= least or line_end <= stop:
                break
            stop = line_end if line_end < self.end else -1
            last = line_end
        body = self.text[start + 1 : last] if start >= 0 and stop != start else ""
        if body.strip():
            first = start + 1 + len(body) - len(body.lstrip())
            self._add(name, body.strip(), first, first + len(body.strip()))

    def _value(self, name: str, at: int, brackets: int) -> None:
        """A literal, a known name, or several of them joined."""
        pieces: list[tuple[str, int, int]] = []
        own = False  # whether a literal of this place is among them
        while at < len(self.tokens):
            kind, said, start, stop = self.tokens[at]
            after = self.tokens[at + 1] if at + 1 < len(self.tokens) else ("line", "", stop, stop)
            if kind == "text":
                pieces.append((said, start, stop))
                own = True
            elif kind == "name" and said in self.known and after[1] not in ("(", "["):
                pieces.append(self.known[said])
            elif not pieces and kind in ("name", "other", "op", "prose") and (m := BARE.match(self.text, start, self.end)):
                if after[1] == "(" and m.end() == stop:
                    return  # a call
                pieces.append((m[0], start, m.end()))
                break
            else:
                return
            at += 1
            while at < len(self.tokens) and brackets and self.tokens[at][0] == "line":
                at += 1
            if at < len(self.tokens) and self.tokens[at][1] in ("+", "."):
                at += 1
                while at < len(self.tokens) and self.tokens[at][0] == "line":
                    at += 1
            elif not (at < len(self.tokens) and self.tokens[at][0] == "text" and kind == "text"):
                break
        if not pieces:
            return
        if len(pieces) == 1:
            self._add(name, *pieces[0])
        else:
            here = [p for p in pieces if own and p not in self.known.values()] or pieces
            self._add(name, "".join(p[0] for p in pieces), min(p[1] for p in here), max(p[2] for p in here))

    def _add(self, name: str, literal: str, start: int, stop: int) -> None:
        self.known[name] = (literal, start, stop)
        self.found.append((name, literal, start, stop))


def _blanks(text: str, at: int) -> int:
    n = 0
    while at + n < len(text) and text[at + n] in " \t-":
        n += 1
    return n


def tagged(text: str) -> Iterator[Pair]:
    """Pairs of tags: an element's own text, and names and values that stand apart."""
    named: tuple[str, int] | None = None
    for m in TAG.finditer(text):
        tag, own = m["tag"].rpartition(":")[2], {}
        for a in ATTRIBUTE.finditer(text, *m.span("attributes")):
            part = 2 if a[2] is not None else 3
            own[a[1].lower()] = (a[part], *a.span(part))
        name = next((own[k][0] for k in own if k in NAMING), None)
        value = next((own[k] for k in own if k in VALUED), None)
        inner = m["text"].strip()
        at = m.start("text") + len(m["text"]) - len(m["text"].lstrip())
        if name and value:
            yield name, *value
        elif inner and not m["alone"]:
            if named and tag.lower() in VALUED:
                yield named[0], inner, at, at + len(inner)
            yield name or tag, inner, at, at + len(inner)
            named = (inner, at) if tag.lower() in NAMING and NAME.match(inner) else None


def entries(found: list[Pair]) -> Iterator[Pair]:
    """Pairs of a name and a value that are two entries one after the other."""
    for (a, named, *_), (b, literal, start, stop) in zip(found, found[1:], strict=False):
        if a.lower().lstrip("-") in NAMING and b.lower() in VALUED and NAME.match(named):
            yield named, literal, start, stop


def pairs(text: str) -> list[Pair]:
    """Name-literal pairs of a text, in order of the text within each way of writing them."""
    lexer = Lexer({})
    lexer.read(text)
    tags = list(tagged(text)) if "<" in text else []
    return [*lexer.found, *entries(lexer.found), *tags]


def pair_spans(text: str) -> list[tuple[str, int, int]]:
    """Literals that end, directly or through other names, in a sensitive target."""
    if not any(c in text for c in "=:<") or not SENSITIVE.search(text):
        return []
    found = set()
    for name, literal, start, end in pairs(text):
        weight = name_score(name)
        if name.lower() in NAMING and NAME.match(literal) and name_score(literal):
            continue  # a name, whose value stands elsewhere
        if weight and weight + literal_score(literal) >= THRESHOLD:
            found.add(("pair", start, end))
    return sorted(found, key=lambda s: s[1:])


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans)."""
    text = text or ""
    base = base_spans(text)
    extra = [s for s in pair_spans(text) if not any(b[1] <= s[1] and s[2] <= b[2] for b in base)]
    order = (*KINDS, "pair")
    return base, sorted(base + extra, key=lambda s: (s[1], order.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array of (kind, start, end, value), base_count) for every row of docs."""
    ship(docs.sparkSession)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])

    def scanned(stream):
        for batch in stream:
            base_n, spans = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                base, every = scan(text)
                base_n.append(len(base))
                spans.append([{"kind": k, "start": s, "end": e, "value": text[s:e]} for k, s, e in every])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, pa.list_(span)), pa.array(base_n, pa.int64())],
                [id_col, "spans", "n_base"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        scanned, f"`{id_col}` {kind}, spans array<struct<kind string,start long,end long,value string>>, n_base long"
    )


def base_digest(text_spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(text_spans).encode()).hexdigest()
