"""Secret scans by assignment-aware lexing.

A text is read as source or configuration, from front to back: every assignment operator yields a (name, expression)
pair; an expression is a concatenation of literals, interpolated strings and names; names assigned earlier are
replaced by their literals (constant propagation, also through chains). A name that is assigned something else loses its
literals, and what a function assigns, by indentation, ends with it. Keys of objects, lists, indented keys and block scalars
are read too: a value under a generic key (``value``, ``data``, ...) or in a list takes the name of what holds it. A literal that flows into
a target whose name sounds sensitive is scored by that name and by its own look, and reported
when the product reaches ``threshold``. Three fixed patterns are reported besides. Nothing has an upper length, and time is in proportion to a text's.

Spans are half-open and count code points. Null text is an empty text; an empty text has no
spans; a null id stays null; repeated rows are judged each for itself; an empty table gives no rows. Only the two named columns
are read, so other columns never clash.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import tidy

#: The base patterns and least lengths of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_MIN = 12
KINDS = ("assign", "access", "hex", "named")
#: What any match of ASSIGN holds, in lower case: most texts hold none, and the pattern is slow.
HINTS = ("passw", "secret", "token", "apikey", "api_key")

#: Parts of a target's name that speak for a secret, and that speak against one.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "passcode": 0.9, "pass": 0.7, "secret": 1.0, "secrets": 1.0,
    "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "authorization": 0.8, "bearer": 0.8,
    "jwt": 0.9, "private": 0.5, "key": 0.5, "access": 0.4, "signing": 0.5, "encryption": 0.5, "api": 0.3, "client": 0.2,
    "salt": 0.6, "pin": 0.5, "dsn": 0.6, "session": 0.4, "cookie": 0.5, "webhook": 0.5,
}
HARMLESS = {"url", "uri", "path", "file", "name", "id", "count", "length", "len", "type", "expires", "expiry", "ttl", "public", "hint", "label", "policy", "field", "min", "max", "size", "limit", "help", "prompt", "regex", "pattern", "header"}
PLACEHOLDER = re.compile(r"(?i)(?:x+|\*+|\.+|<.*>|\$[{(].*|%.*%|\{\{.*|change_?me|example|null|none|nil|true|false|undefined|todo|your[-_ ].*|test|dummy|redacted|secret|password|token)\Z")

#: Keys that say nothing of their value but that it is one.
GENERIC = {"value", "val", "data", "default", "current", "raw", "plain", "plaintext", "content", "string", "literal", "v"}

_EVENT = re.compile(r"[:={}\[\]\n]")
# what stands left of an operator, read backwards
_WORD = r"[\w$]*[A-Za-z_$](?:(?:\.|>?-|::)[\w$]*[A-Za-z_$])*"
_LEFT = re.compile(rf"""[?+|]?[ \t]*["'`]?(?:\]"(?P<key>[^"\n\[\]]+)"\[|\]'(?P<key2>[^'\n\[\]]+)'\[)?(?P<name>{_WORD})""", re.A)
_TYPED = re.compile(rf"""[ \t]*\??(?:\][^\[\]\n=]*\[|>[^<>\n=]*<)?[\w.|?&*]*[A-Za-z_&*][ \t]*:[ \t]*(?P<name>{_WORD})""", re.A)
_STRING = re.compile(r"""[bfruBFRU]{0,2}(?:(\"\"\"|\'\'\')(?P<long>(?:\\.|(?!\1).)*?)\1|(["'`])(?P<short>(?:\\.|(?!\3)[^\\\n])*)\3)""", re.S)
_BARE = re.compile(r"""(?:[^\s"'`,;(){}\[\]<>&=]|&(?!\w+=))+(?:=+(?:[^\s"'`,;(){}\[\]<>&=]|&(?!\w+=))*)?""")
_NAME = re.compile(r"[A-Za-z_$][\w$.]*", re.A)
_HOLE = re.compile(r"\$?\{[ \t]*([A-Za-z_$][\w$.]*)[ \t]*\}|\$([A-Za-z_]\w*)", re.A)
_JOIN = re.compile(r"""[ \t]*(?:\\\r?\n[ \t]*)?(?:\+(?![+=])|\.\.|\|\||(?<=[ \t])&(?=[ \t])|(?<=[ \t])\.(?=[ \t]*["'$]))[ \t]*(?:\\?\r?\n[ \t]*)?""")
_JOIN_IN_PARENS = re.compile(r"""\s*(?:\+(?![+=])|\.\.|\|\||(?<=\s)&(?=\s)|(?<=\s)\.(?=\s*["'$]))\s*""")
_NEXT = re.compile(r"""[ \t]*(?:\\\r?\n[ \t]*)?(?=[bfruBFRU]{0,2}["'`])""")
_NEXT_IN_PARENS = re.compile(r"""\s*(?=[bfruBFRU]{0,2}["'`])""")
_TAG = re.compile(r"<([A-Za-z_][\w.\-]*)(?:\s[^<>]*)?>([^<>]{6,})</\1>", re.A)
_BLOCK = re.compile(r"[|>][+\-0-9]*[ \t]*\r?\n")
_INDENT = re.compile(r"[ \t]*")
_ASSIGNED = re.compile(r"[ \t]*=")
_ITEM = re.compile(r"-[ \t]+")
_LIST_PART = re.compile(r"[\s,]*")
_FUNCTION = re.compile(r"(?:(?:async|export|default|public|private|protected|static|pub)[ \t]+)*(?:def|class|function|func|fn|sub)\b")
_HAS_FUNCTION = re.compile(r"\b(?:def|class|function|func|fn|sub)\b")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> float:
    """0 to 1: how sensitive an assignment's target sounds."""
    parts = [p.lower() for p in _PART.findall(name)]
    miss = 1.0
    for p in parts:
        miss *= 1 - SENSITIVE.get(p, SENSITIVE.get(p.removesuffix("s"), 0.0))
    score = 1 - miss
    return score * 0.2 if parts and parts[-1] in HARMLESS else score


def literal_score(value: str, quoted: bool) -> float:
    """0 to 1: how much a literal looks like a secret value rather than a word or a placeholder."""
    n = len(value)
    if n < 6 or PLACEHOLDER.match(value):
        return 0.0
    mixed = bool(re.search(r"\d", value)) + bool(re.search(r"[a-z]", value)) + bool(re.search(r"[A-Z]", value)) + bool(re.search(r"[^A-Za-z0-9\s]", value))
    if not quoted and not re.search(r"\d", value):
        return 0.0
    if mixed < 2 and n < 16:
        return 0.0
    bits = -sum(c * math.log2(c / n) for c in Counter(value).values())
    return min(1.0, bits / 30) * (0.5 if 12 * len(re.findall(r"\s+", value)) > n else 1.0)


def _pieces(text: str, a: int, b: int, known: dict[str, list]) -> list:
    """A string's own parts and, where it names constants, theirs."""
    parts, at = [], a
    for m in _HOLE.finditer(text, a, b):
        own = known.get(m[1] or m[2])
        if own is not None:
            if m.start() > at:
                parts.append((at, m.start(), True))
            parts.append(own)
            at = m.end()
    if at < b or not parts:
        parts.append((at, b, True))
    return parts


def _expression(text: str, at: int, known: dict[str, list]) -> list:
    """The literals (start, end, quoted) that make up the value which starts at ``at``; a known name stands as its own list."""
    found: list = []
    join, following = _JOIN, _NEXT
    if text[at] == "(":
        join, following = _JOIN_IN_PARENS, _NEXT_IN_PARENS
        at = _LIST_PART.match(text, at + 1).end()
    while True:
        string = False
        if m := _STRING.match(text, at):
            found += _pieces(text, *(m.span("long") if m["long"] is not None else m.span("short")), known)
            string = True
        elif (m := _HOLE.match(text, at)) and (own := known.get(m[1] or m[2])) is not None:
            found.append(own)
        elif m := _BARE.match(text, at):
            name = _NAME.match(text, at)
            after = text[name.end() : name.end() + 1] if name else ""
            if name and name[0] in known and (name.end() == m.end() or after in "+|&."):
                found.append(known[name[0]])
                m = name
            elif m[0] in ("Bearer", "Basic", "new", "await", "export"):
                at = m.end() + 1
                continue
            elif text[m.end() : m.end() + 1] == "(":  # a call: what it gives is not known
                break
            else:
                found.append((m.start(), m.end(), False))
        else:
            break
        at = m.end()
        if joint := join.match(text, at):
            at = joint.end()
        elif string and (joint := following.match(text, at)):
            at = joint.end()
        else:
            break
    return found


def flat(value: list, most: int) -> list[tuple[int, int, bool]]:
    """All literals of a value in order. Names doubled over and over grow without end, so beyond ``most`` characters no part is repeated."""
    found: list[tuple[int, int, bool]] = []
    size, seen, todo = 0, set(), [iter(value)]
    while todo:
        for x in todo[-1]:
            if size > most and id(x) in seen:
                continue
            seen.add(id(x))
            if isinstance(x, list):
                todo.append(iter(x))
                break
            found.append(x)
            size += x[1] - x[0] + 1
        else:
            todo.pop()
    return found


class _Known(dict):
    """Names and their literals. Inside functions it remembers what to restore."""

    def __init__(self):
        self.scopes: list[tuple[int, list]] = []

    def bind(self, name: str, value: list) -> None:
        if self.scopes:
            self.scopes[-1][1].append((name, self.get(name)))
        if value:
            self[name] = value
        else:
            self.pop(name, None)

    def leave(self, indent: int) -> None:
        """End the functions that begin at this indent or deeper."""
        while self.scopes and indent <= self.scopes[-1][0]:
            for name, old in reversed(self.scopes.pop()[1]):
                if old is None:
                    self.pop(name, None)
                else:
                    self[name] = old


def _block(text: str, at: int, indent: int) -> tuple[int, int]:
    """The span of a block scalar whose lines begin at ``at`` and are deeper than indent."""
    first, last = at, at
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        begin = _INDENT.match(text, at).end()
        if begin < end and text[begin] != "\r":
            if begin - at <= indent:
                break
            if last == first:
                first = begin
            last = end
        at = end + 1
    return first, max(first, last)


def pairs(text: str) -> Iterator[tuple[str, list]]:
    """(target name, value that flows into it, for flat()) for every assignment, in order of appearance."""
    known = _Known()
    functions = _HAS_FUNCTION.search(text) is not None
    held: list[str | None] = []  # the names of open brackets
    keys: list[tuple[int, str]] = []  # indents and names of keys that indented lines follow
    opened, skip, line, column = (-1, ""), 0, 0, 0  # opened: where a named bracket will come
    before, since = 0, 0  # where the last two operators of this line end: no left side reaches further

    def named(name: str) -> str:
        """The holder's name, if the own one is generic."""
        if name.lower() not in GENERIC:
            return name
        return (held[-1] if held else keys[-1][1] if keys and keys[-1][0] < column else None) or name

    for m in _start_and(_EVENT.finditer(text)):
        c, i = (m[0], m.start()) if m else ("\n", -1)
        if c == "\n":
            line = before = since = i + 1
            at = _INDENT.match(text, line).end()
            first = text[at : at + 1]
            if not first or first in "\r\n#":
                continue
            column = at - line
            item = _ITEM.match(text, at) if first == "-" else None
            while keys and (column < keys[-1][0] if item else column <= keys[-1][0]):
                keys.pop()
            if functions and first not in "{)":
                known.leave(column)
                if _FUNCTION.match(text, at):
                    known.scopes.append((column, []))
            if item and keys and item.end() < len(text):
                value = _expression(text, item.end(), known)
                if value and not (isinstance(value[-1], tuple) and text[value[-1][1] - 1 : value[-1][1] + 2].rstrip("\"'` ").endswith(":")):
                    yield keys[-1][1], value
        elif c in "{[":
            held.append(opened[1] if opened[0] == i else None)
        elif c in "}]":
            if held:
                held.pop()
        elif i >= skip and not (c == ":" and (text[i + 1 : i + 2] == ":" or text[i - 1 : i] == ":")):
            at = i + 1
            while at < len(text) and text[at] in " \t=>~":
                at += 1
            if "=" in text[i + 1 : at]:
                skip = at
            left, typed = _LEFT.match(text[since:i][::-1]), None
            if c == "=" and text[since - 1 : since] == ":" and (typed := _TYPED.match(text[before:i][::-1])) and left and name_score(left["name"][::-1]) > name_score(typed["name"][::-1]):
                typed = None  # "note: password = ..." is no type
            before, since = since, i + 1
            if not (typed or left) or at >= len(text) or text[at] == "/" and c == ":":
                continue
            if typed:
                name = typed["name"][::-1]
            else:
                key = left["key"] or left["key2"]
                name = (f"{key}.{left['name']}" if key else left["name"])[::-1]
            full = named(name)
            if text[at] in "\r\n":
                if c == ":":
                    keys.append((column, full))
                continue
            if c == ":" and (block := _BLOCK.match(text, at)):
                a, b = _block(text, block.end(), column)
                value = [(a, b, True)] if b > a else []
            elif text[at] in "{[":
                opened, value = (at, full), []
                if text[at] == "[":
                    yield from ((full, x) for x in _items(text, at + 1, known))
            else:
                value = _expression(text, at, known)
            if c == ":" and len(value) == 1 and isinstance(value[0], tuple) and not value[0][2] and _ASSIGNED.match(text, value[0][1]):
                continue  # a type; the value comes behind the next operator
            if c == "=" and text[i - 1 : i] == "+" and name in known:
                value = [known[name], *value]
            if not (c == "=" and text[i + 1 : i + 2] == "="):  # a comparison binds nothing
                known.bind(name, value)
            if value:
                yield full, value
    if "</" in text:
        for m in _TAG.finditer(text):
            yield m[1], [(m.start(2), m.end(2), True)]


def _start_and(events: Iterator) -> Iterator:
    yield None
    yield from events


def _items(text: str, at: int, known: dict[str, list]) -> Iterator[list]:
    """The strings of a list that begins at ``at``, up to the first element that is none."""
    while m := _STRING.match(text, at := _LIST_PART.match(text, at).end()):
        yield _pieces(text, *(m.span("long") if m["long"] is not None else m.span("short")), known)
        at = m.end()


def scan(text: str, threshold: float = 0.5) -> list[tuple[int, int, int]]:
    """All spans (start, kind's index, end) of a text, in order."""
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "=" in text or ":" in text or "</" in text:
        named, judged, held = set(), {}, []
        for name, value in pairs(text):
            sensitive = name_score(name)
            if sensitive >= threshold:
                key = tuple(map(id, value))
                if key not in judged:  # a constant that goes to many names is read once
                    literals = flat(value, len(text))
                    judged[key] = literals, literal_score("".join(text[a:b] for a, b, _ in literals), any(q for _, _, q in literals))
                    held.append(value)  # keeps the ids
                literals, look = judged[key]
                if literals and sensitive * look >= threshold:
                    named |= {(a, 3, b) for a, b, _ in literals if b > a}
                    if look * threshold >= threshold:  # every sensitive name reports it: once is enough
                        judged[key] = [], look
        base = sorted(found)
        starts, upto = [a for a, _, _ in base], []
        for _, _, b in base:
            upto.append(max(b, upto[-1] if upto else 0))
        inside = lambda a, b: (k := bisect_right(starts, a)) > 0 and upto[k - 1] >= b
        found += [x for x in named if not inside(x[0], x[2])]
    return sorted(found)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each run of touching spans replaced by the mark."""
    out, done = [], 0
    for a, _, b in spans:
        if a >= done:
            if a > done or not out:
                out += [text[done:a], mark]
            done = b
        else:
            done = max(done, b)
    return "".join([*out, text[done:]])


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, spans ARRAY<STRUCT<start, kind, end>>, redacted STRING: one row per input row."""
    schema = "doc_id long, spans array<struct<start: int, kind: string, `end`: int>>, redacted string"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))

    @tidy()
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            spans = [scan(t, threshold) for t in texts]
            rows = [[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in x] for x in spans]
            clean = [redact(t, x) if x else t for t, x in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind), pa.array(clean, pa.string())], ["doc_id", "spans", "redacted"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(work, schema)


def redact_secrets(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", threshold: float = 0.5) -> DataFrame:
    """docs, all columns, with every found span replaced by a mark; n_chars, where it exists, follows. Null texts stay null, empty ones empty; repeated rows are judged each for itself; an empty table stays empty."""
    at = docs.columns.index(text)
    size = docs.columns.index(n_chars) if n_chars in docs.columns else None

    @tidy()
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t and redact(t, scan(t, threshold)) for t in b.column(at).to_pylist()]
            cols = list(b.columns)
            cols[at] = pa.array(texts, b.schema.field(at).type)
            if size is not None:
                sizes = [old if t is None else len(t) for t, old in zip(texts, cols[size].to_pylist())]
                cols[size] = pa.array(sizes, b.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(work, docs.schema)


def secret_summary(found: DataFrame) -> DataFrame:
    """The digest columns of find_secrets(), a row for each of its rows: a text without spans has counts of 0, the digest of the empty string and empty spans."""
    base = F.filter("spans", lambda s: s["kind"] != "named")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
