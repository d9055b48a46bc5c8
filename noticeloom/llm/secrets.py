r"""Secret scans with assignment-aware lexing.

Three base patterns find assignments of well-known names, access keys and long hexadecimal runs.
Beside them, lines that hold ``=`` or ``:`` are lexed as source or configuration: names (quoted, dotted,
subscripted, chained, with types), operators (``=``, ``:``, ``:=``, ``=>``), strings with escapes, triple and
joined ones, bare values, blocks and values on the next line, and mappings, lists and calls that belong to
a name. Each literal is paired with its name; names that are given other names hand on how sensitive they
are (constants are propagated within the document, whatever the order), as do the names of mappings,
lists and calls to what stands inside. A literal is scored by the words of the names it reaches and by
its own form; with a high enough score it is a span of kind ``named`` (one for each part of a joined
text), unless a base span of kind ``assign`` already covers it. No length is limited.

Some forms name their literal elsewhere than before an operator and are read beside the lines: elements and records of a name and a value
(``<password>x</password>``, ``name="password" value="x"``, in either order), calls that set something (``define("PASSWORD", "x")``,
``setPassword("x")``), defaults of shell variables (``${PASSWORD:-x}``), headers of bearers, and blocks of private keys, which need no name.

Offsets are code points, ends exclusive. The scan is one pass over each row, so hot sources and
groups of copies cost no more than other rows.

Defined results: null and empty texts have no spans; repeated rows are scanned each; an empty
table gives an empty result; extra columns are carried by ``redact`` and dropped by ``scan``.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from noticeloom.llm.common import mapped, slices

#: Fixed base patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "named")

# The syntax, in parts. Every repetition is possessive, so no run of characters is read twice for one token.
_NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*+"
_ASSIGNS = r"(?::=|=>|=(?![=>])|:(?!//))"
_QUOTED = r'"""(?:[^"\\]++|\\.|"(?!""))*+"""' + r"|'''(?:[^'\\]++|\\.|'(?!''))*+'''" + r'|"(?:[^"\\\n]++|\\.)*+"' + r"|'(?:[^'\\\n]++|\\.)*+'|`(?:[^`\\\n]++|\\.)*+`"
#: A name (perhaps quoted, dotted or subscripted) and an operator; a name begins where its run of characters does.
_HEAD = rf"(?<![A-Za-z0-9_.\-])[0-9.\-]*+(?P<name>{_NAME})[\"'`]?\]?[ \t]*+(?P<op>{_ASSIGNS})"
STRING = re.compile(rf"(?s)(?<![A-Za-z0-9_])[A-Za-z]{{0,2}}(?:{_QUOTED})")
#: A name between a word that declares it and its type.
_DECLARED = rf"(?<![A-Za-z0-9_.\-])(?:const|var)[ \t]++(?P<declared_name>{_NAME})[ \t]++[\[\]*]*+[A-Za-z_][A-Za-z0-9_.\[\]]*+[ \t]*+=(?![=>])"
TOKEN = re.compile(rf"(?s)(?P<line>\n)|(?P<declared>{_DECLARED})|(?P<head>{_HEAD})|(?P<string>(?<![A-Za-z0-9_])[A-Za-z]{{0,2}}(?:{_QUOTED}))|(?P<open>[(\[{{])|(?P<close>[)\]}}])")
SPACES = re.compile(r"[ \t]*+")
#: After a string: what makes it a name.
KEYED = re.compile(rf"(?P<bracket>\]?)[ \t]*+(?P<op>{_ASSIGNS})")
#: After ``name:``, a type and the operator.
TYPE = re.compile(r"""(?:&(?:'[a-z_]++[ \t]++)?(?:mut[ \t]++)?|\*(?:const[ \t]++|mut[ \t]++)?|\[\])*+[A-Za-z_][A-Za-z0-9_.]*+(?:[ \t]*+[\[|<?][^=:\n"']*+)?[ \t]*+(?:(?<=[ \t])=(?![=>])|=(?=[ \t]*+[A-Za-z]{0,2}["']))[ \t]*+""")
#: A name that is itself assigned to (``a = b = ...``).
CHAINED = re.compile(rf"(?P<name>{_NAME})[ \t]*+=(?![=>])[ \t]*+")
CALL = re.compile(r"(?:new[ \t]++|await[ \t]++)?(?:\[[0-9]*+\])?&?[A-Za-z_][A-Za-z0-9_.:]*+(?=\()")
#: A list or mapping with its type before it.
LISTED = re.compile(r"(?:\[[0-9]*+\]|map\[[A-Za-z0-9_.]++\]|&)[A-Za-z_][A-Za-z0-9_.]*+(?=\{)")
INDEXED = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*+(?=\[)")
#: What a mapping holds under a text.
MEMBER = re.compile(r"""(?P<of>[A-Za-z_][A-Za-z0-9_.]*+)\[[ \t]*+(["'])(?P<key>[^"'\\\n]++)\2[ \t]*+\]""")
BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>#&|]++""")
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")
#: What joins parts of a text: a plus sign, a line that goes on, and within brackets nothing but space.
PLUS, BESIDE = re.compile(r"[ \t]*+(?:\+|\\(?=\n))\s*+"), re.compile(r"\s*+")
BLOCK = re.compile(r"[|>][+\-0-9]*+[ \t]*+(?=\n)")
ITEM = re.compile(r"-[ \t]++")
#: Arguments that name a variable of the environment.
VARIABLE = re.compile(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\Z")
NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
OPERATOR_LINE = re.compile(r"[^\n]*[=:][^\n]*")
CLOSING = {"(": ")", "[": "]", "{": "}"}

# Forms that name their literal elsewhere than before an operator.
_SHORT = r"""[^\s"'`,;(){}\[\]<>#&|]++"""
_GIVEN = rf"(?:(?P<quoted>{_QUOTED})|(?P<bare>{_SHORT}))"
_IS = r"[\"']?[ \t]*+[:=][ \t]*+"
_LABEL, _HELD = r"(?<![A-Za-z0-9_])[\"']?(?i:name|key|id|variable|property)", r"(?<![A-Za-z0-9_])[\"']?(?i:value|val|default)"
RECORD = re.compile(rf"(?s){_LABEL}{_IS}[\"']?(?P<name>{_NAME})[\"']?[ \t]*+,?\s*+{_HELD}{_IS}{_GIVEN}")
REVERSED = re.compile(rf"(?s){_HELD}{_IS}{_GIVEN}[ \t]*+,?\s*+{_LABEL}{_IS}[\"']?(?P<name>{_NAME})")
ELEMENT = re.compile(rf"<(?P<tag>{_NAME})(?P<more>\s[^<>]*+)?>\s*+(?P<body>[^<>]++)</(?P=tag)>")
ATTRIBUTE = re.compile(rf"(?i:name|key|id)=[\"'](?P<name>{_NAME})[\"']")
PAIRED = re.compile(rf"(?s)(?<![A-Za-z0-9_])(?:define|set|setdefault|put|add|setenv|setProperty|set_property|setHeader|addHeader|header)\(\s*+[\"'](?P<name>{_NAME})[\"']\s*+,\s*+(?P<quoted>{_QUOTED})")
SETTER = re.compile(rf"(?s)(?<![A-Za-z0-9_])(?:set|put|with|add|use)(?P<name>[A-Z_][A-Za-z0-9_]*+)\(\s*+(?P<quoted>{_QUOTED})\s*+\)")
DEFAULT = re.compile(r"""(?:(?P<outer>[A-Za-z_][A-Za-z0-9_]*+)[ \t]*+[:=][ \t]*+["']?)?\$\{(?P<name>[A-Za-z_][A-Za-z0-9_]*+):?[-=](?P<bare>[^{}\s"']++)\}""")
BEARER = re.compile(rf"(?i)(?<![a-z0-9_-])authorization{_IS}[\"']?(?P<name>bearer|basic|token)[ \t]++(?P<bare>[a-z0-9+/_.=~-]++)")
PRIVATE = re.compile(r"-----BEGIN [A-Z0-9 ]*?PRIVATE KEY-----\s*+(?P<body>[^-]++)-----END")

#: Words of names and what they say about the value, from 0 to 1.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 0.9, "token": 0.8, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "private": 0.5, "access": 0.3, "auth": 0.5, "bearer": 0.7, "basic": 0.5, "key": 0.4, "api": 0.4, "signing": 0.5, "encryption": 0.5,
}
#: Last words of names whose values tell about a secret instead of being one.
ABOUT = frozenset("hint prompt label path file filename dir directory url uri endpoint type length size count policy expiry expires field title description help".split())
#: Literals that stand for a secret instead of being one.
PLACEHOLDER = re.compile(r"(?i)\A(?:x+|\*+|\.+|changeme|example|your[_-].*|none|null|true|false|todo|<.*|\$\{?.*|%.*%)\Z")
THRESHOLD = 1.2


@lru_cache(20_000)
def name_score(name: str) -> float:
    """How sensitive a name is: the sum of its words' weights, at most 1; 0 if its last word says that it only tells about a secret, and for ``private`` alone."""
    words = [w.lower() for w in NAME_WORD.findall(name)]
    return 0.0 if words == ["private"] or words and words[-1] in ABOUT else min(1.0, sum(SENSITIVE.get(w, 0.0) for w in words))


def literal_score(value: str, phrase: bool = False) -> float:
    """How much a literal looks like a key: length, mixture of characters and entropy, from 0 to 1.

    White space speaks against it, but for quoted texts of names that stand for pass phrases (phrase)."""
    n = len(value)
    if n < 6 or PLACEHOLDER.match(value) or (not phrase or value[-1] in ".?!:") and any(c.isspace() for c in value):
        return 0.0
    bits = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    kinds = sum(bool(re.search(p, value)) for p in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9]"))
    return min(1.0, 0.25 * min(1.0, n / 16) + 0.45 * min(1.0, bits / 3.5) + 0.15 * (kinds - 1))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


class Found(NamedTuple):
    """A literal or a name that is given to a name (None: to what stands around it)."""

    name: str | None
    around: float  # how sensitive the names of the mappings, lists and calls around it are
    spans: tuple[tuple[int, int], ...]
    value: str
    quoted: bool
    argument: bool = False


def quoted_span(m: re.Match) -> tuple[int, int]:
    """Where the text of a string lies, without prefix and quotes."""
    raw = m[0]
    prefix = min(raw.index(q) for q in "\"'`" if q in raw)
    width = 3 if len(raw) - prefix >= 6 and raw[prefix : prefix + 3] in ('"""', "'''") else 1
    return m.start() + prefix + width, m.end() - width


class Lexer:
    """Reads assignments from a place on to the end of its line, and further while a mapping, list, call or
    indented block that belongs to a sensitive name is open."""

    def __init__(self, text: str, at: int):
        self.text, self.at = text, at
        self.stack: list[tuple[str | int, float, str | None]] = []  # closing bracket or indentation, how sensitive the names around are, whose mapping it is
        self.found: list[Found] = []

    def around(self) -> float:
        return self.stack[-1][1] if self.stack else 0.0

    def run(self) -> int:
        """The place where reading ended."""
        while (m := TOKEN.search(self.text, self.at)) is not None:
            self.at = m.end()
            kind = m.lastgroup
            if kind == "line":
                if not self.next_line():
                    return self.at
            elif kind == "head":
                self.value(m["name"], m["op"])
            elif kind == "declared":
                self.value(m["declared_name"], "=")
            elif kind == "string":
                self.string(m)
            elif kind == "open":
                self.stack.append((CLOSING[m[0]], self.around(), None))
            elif self.stack and self.stack[-1][0] == m[0]:
                self.stack.pop()
        return len(self.text)

    def next_line(self) -> bool:
        """Whether anything is open that goes on in the line that begins here."""
        start = SPACES.match(self.text, self.at).end()
        blank = start == len(self.text) or self.text[start] == "\n"
        while not blank and self.stack and isinstance(self.stack[-1][0], int) and start - self.at <= self.stack[-1][0]:
            self.stack.pop()
        if not self.around() or (blank and self.stack[-1][0] == ")"):
            return False
        self.at = start
        if isinstance(self.stack[-1][0], int) and (item := ITEM.match(self.text, start)):
            self.at = item.end()
            if not TOKEN.match(self.text, self.at) and (bare := BARE.match(self.text, self.at)):
                self.found.append(Found(None, self.around(), (bare.span(),), bare[0], False))
                self.at = bare.end()
        return True

    def string(self, m: re.Match) -> None:
        """A string that stands alone: a name if an operator follows, else a member of what is open."""
        keyed = KEYED.match(self.text, self.at)
        if keyed:
            if keyed["bracket"] and self.stack and self.stack[-1][0] == "]":
                self.stack.pop()
            self.at = keyed.end()
            s, e = quoted_span(m)
            self.value(self.text[s:e], keyed["op"])
        elif self.around():
            self.literal(m, [None])

    def literal(self, m: re.Match, names: list[str | None]) -> None:
        """A string, with the strings and names that are joined to it."""
        spans, others = [quoted_span(m)], []
        self.at = m.end()
        within = bool(self.stack) and self.stack[-1][0] == ")"
        while True:
            joint = PLUS.match(self.text, self.at) or (BESIDE.match(self.text, self.at) if within else None)
            more = STRING.match(self.text, joint.end()) if joint else None
            if more:
                spans.append(quoted_span(more))
                self.at = more.end()
            elif joint and "+" in joint[0] and (bare := BARE.match(self.text, joint.end())) and NAME.match(bare[0]):
                others.append(bare)
                self.at = bare.end()
            else:
                break
        value = "".join(self.text[s:e] for s, e in spans)
        for name in names:
            self.found.append(Found(name, self.around(), tuple(spans), value, True, within))
            self.found += [Found(name, self.around(), (b.span(),), b[0], False) for b in others]

    def value(self, name: str, op: str) -> None:
        """What a name is given, from here on; within a named mapping it is given to the mapping's member too."""
        of, first = self.stack[-1][2] if self.stack else None, len(self.found)
        self.given(name, op)
        if of is not None:
            self.found += [f._replace(name=f'{of}["{name}"]') for f in self.found[first:] if f.name == name]

    def given(self, name: str, op: str) -> None:
        text = self.text
        self.at = SPACES.match(text, self.at).end()
        if op == ":" and (kind := TYPE.match(text, self.at)):
            self.at = kind.end()
        names: list[tuple[str, int]] = [(name, self.at)]
        while chained := CHAINED.match(text, self.at):
            self.at = chained.end()
            names.append((chained["name"], self.at))
        if m := STRING.match(text, self.at):
            self.literal(m, [x for x, _ in names])
            return
        inner = max(self.around(), *(name_score(x) for x, _ in names)) if len(names) > 1 else max(self.around(), name_score(name))
        if self.at == len(text) or text[self.at] == "\n" or (op == ":" and BLOCK.match(text, self.at)):
            self.below([x for x, _ in names], inner)
        elif call := CALL.match(text, self.at) or LISTED.match(text, self.at):
            self.stack.append((CLOSING[text[call.end()]], inner, None))
            self.at = call.end() + 1
        elif text[self.at] in CLOSING:
            self.stack.append((CLOSING[text[self.at]], inner, name if text[self.at] == "{" else None))
            self.at += 1
        elif member := MEMBER.match(text, self.at):
            self.found += [Found(x, self.around(), (), f'{member["of"]}["{member["key"]}"]', False) for x, _ in names]
            self.at = member.end()
        elif indexed := INDEXED.match(text, self.at):
            self.stack.append(("]", 0.0, None))  # what stands in the brackets is a key
            self.at = indexed.end() + 1
        else:
            covered, found = 0, []
            for x, start in names:  # each of several names has what stands after it, up to its end
                if start >= covered and (m := BARE.match(text, start)):
                    found.append(Found(x, self.around(), (m.span(),), m[0], False))
                    covered = m.end()
            self.found += reversed(found)
            self.at = max(self.at, covered)

    def below(self, names: list[str], inner: float) -> None:
        """A value that stands below its name, further in: a text, a block of text, or a mapping."""
        text = self.text
        block = BLOCK.match(text, self.at)
        end = block.end() if block else self.at
        if end == len(text) or not inner:
            return
        line = text.rfind("\n", 0, self.at) + 1
        own = SPACES.match(text, line).end() - line
        start = SPACES.match(text, end + 1).end()
        if start - end - 1 <= own:
            return
        if block:
            first = last = start
            at = end + 1
            while at < len(text):
                begin = SPACES.match(text, at).end()
                stop = text.find("\n", begin)
                stop = len(text) if stop < 0 else stop
                if begin < stop:
                    if begin - at <= own:
                        break
                    last = stop
                at = stop + 1
            self.found += [Found(x, self.around(), ((first, last),), "".join(text[first:last].split()), True) for x in names]
            self.at = last
        elif (m := STRING.match(text, start)) and not KEYED.match(text, m.end()):
            self.literal(m, list(names))
        else:
            self.stack.append((own, inner, None))


def assignments(text: str) -> Iterator[Found]:
    """What the lines of a text that hold an operator, and what belongs to them, give to names."""
    done = 0
    for line in OPERATOR_LINE.finditer(text):
        if line.start() >= done:
            lexer = Lexer(text, line.start())
            done = lexer.run()
            yield from lexer.found


def forms(text: str) -> Iterator[Found]:
    """What is given to names in forms without an operator between them, and private keys (of a name of their own)."""

    def literal(name: str, m: re.Match) -> Found:
        if m["bare"] if "bare" in m.re.groupindex else None:
            return Found(name, 0.0, (m.span("bare"),), m["bare"], False)
        s, e = m.span("quoted")
        width = 3 if e - s >= 6 and text[s : s + 3] in ('"""', "'''") else 1
        return Found(name, 0.0, ((s + width, e - width),), text[s + width : e - width], True)

    low = text.lower()
    if "val" in low or "default" in low:
        for pattern in (RECORD, REVERSED):
            yield from (literal(m["name"], m) for m in pattern.finditer(text))
    if "</" in text:
        for m in ELEMENT.finditer(text):
            body = m["body"].rstrip()
            attribute = ATTRIBUTE.search(m["more"] or "")
            for name in (m["tag"], attribute and attribute["name"]):
                if name:
                    yield Found(name, 0.0, ((m.start("body"), m.start("body") + len(body)),), body, True)
    if "(" in text:
        for pattern in (PAIRED, SETTER):
            yield from (literal(m["name"], m) for m in pattern.finditer(text))
    if "${" in text:
        for m in DEFAULT.finditer(text):
            yield from (literal(m[x], m) for x in ("outer", "name") if m[x])
    if "authorization" in low:
        yield from (literal(f"{m['name']}_auth", m) for m in BEARER.finditer(text))
    if "PRIVATE KEY-----" in text:
        for m in PRIVATE.finditer(text):
            body = m["body"].rstrip()
            yield Found("private_key", 0.0, ((m.start("body"), m.start("body") + len(body)),), "".join(body.split()), True)


def named_spans(text: str) -> list[tuple[int, int, str]]:
    """Literals whose names, their own, those around them or those that they are handed on to, make them secrets.

    Names hand on in whatever order a text has its lines: a name is as sensitive as any that is given its value."""
    found = [*(assignments(text) if "=" in text or ":" in text else ()), *forms(text)]
    if not found:
        return []
    known = {f.name for f in found if f.name is not None}
    given: dict[str, list[str]] = {}  # what names are given other names
    score: dict[str, float] = {}
    literals = []
    for f in found:
        if f.name is not None:
            score[f.name] = max(score.get(f.name) or name_score(f.name), f.around)
        if not f.quoted and f.value in known and (not f.spans or NAME.match(f.value)):
            if f.name is not None:
                given.setdefault(f.name, []).append(f.value)
            else:
                score[f.value] = max(score.get(f.value) or name_score(f.value), f.around)
        else:
            literals.append(f)
    done: set[str] = set()
    for first in sorted(score, key=lambda x: -score[x]) if given else ():
        todo = [first]
        while todo:
            x = todo.pop()
            if x not in done:
                done.add(x)
                score[x] = max(score.get(x, 0.0), score[first])
                todo += given.get(x, ())
    out: dict[tuple[int, int], None] = {}
    for f in literals:
        of = f.around if f.name is None else score[f.name]
        if of >= 0.5 and not (f.argument and VARIABLE.match(f.value)) and of + literal_score(f.value, f.quoted and of >= 0.9) >= THRESHOLD:
            out |= dict.fromkeys(x for x in f.spans if x[0] < x[1])
    return [(s, e, "named") for s, e in out]


def secret_spans(text: str | None) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) of a text, by start, then kind as listed."""
    if not text:
        return []
    base = base_spans(text)
    starts, ends = [s for s, _, k in base if k == "assign"], [e for _, e, k in base if k == "assign"]  # in order, not overlapping
    inside = lambda s, e: (i := bisect_right(starts, s)) > 0 and e <= ends[i - 1]
    more = [x for x in named_spans(text) if not inside(x[0], x[1])]
    return sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def merged(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e, _ in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def redacted(text: str | None, mask: str = "[secret]") -> str | None:
    """The text with every secret replaced by the mask."""
    spans = merged(secret_spans(text))
    if not spans:
        return text
    at, out = 0, []
    for s, e in spans:
        out += [text[at:s], mask]
        at = e
    return "".join([*out, text[at:]])


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


SCAN = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_named", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [secret_spans(t) for t in batch.column("text").to_pylist()]
        count = lambda kind: [sum(k == kind for _, _, k in r) for r in rows]
        base = [hashlib.sha256(joined([x for x in r if x[2] != "named"]).encode()).hexdigest() for r in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(count(k), pa.int64()) for k in KINDS), pa.array(base), pa.array([joined(r) for r in rows])],
            schema=pa.schema([SCAN.field(0).with_type(batch.column("doc_id").type), *list(SCAN)[1:]]))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): counts by kind, digest of the base spans, all spans."""
    kind = dict(docs.dtypes)["doc_id"]
    return mapped(docs.select("doc_id", "text"), _scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_named long, base_sha256 string, spans string")


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """docs with every secret in text replaced by the mask; all rows and columns stay."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = pa.array([redacted(t, mask) for t in batch.column(place).to_pylist()], batch.column(place).type)
            yield pa.RecordBatch.from_arrays([texts if i == place else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return mapped(docs, run, docs.schema)
