"""Secret scans: base patterns and assignment-aware lexing.

Besides three fixed patterns, a lexer reads source and configuration syntax
(name = "x", name: x, "name": "x", name := x, name => x, <name>x</name>,
scheme://user:x@host) into pairs of a name and a literal or another name.
Sensitivity flows from a name to the names it is assigned from, so a literal in
`KEY = "..."` counts when `password = KEY` follows; literals are then scored by
the most sensitive name that they reach and by their own shape.

Constants propagate by name over the whole text; order and scope are ignored.

One pass over the rows, no shuffle; work grows with a text's length, whatever
it holds. Positions are code points, end exclusive.

Defined results: a null or empty text has no spans; very long texts are read
whole, names and literals of any length; repeated rows each give a row; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopia.llm.common import slices, table

#: The base patterns of the contract, each with the least length that counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "literal")

OPERATOR = re.compile(r":=|=>|[:=]")
#: A bare value ends at the next operator, but for trailing equals signs. Possessive: a long literal keeps no state a character.
VALUE = re.compile(r"""[ \t]*(?:"([^"\\\n]*+(?:\\.[^"\\\n]*+)*+)"|'([^'\\\n]*+(?:\\.[^'\\\n]*+)*+)'|([^\s"',;(){}\[\]<>:=]+=*))""")
NAME_START = re.compile("[A-Za-z_$]")
MARKUP = re.compile(r"<([A-Za-z_][A-Za-z0-9_.-]*)>([^<\n]+)</\1>")
URL = re.compile(r"://[^\s:/@]+:([^\s:/@]+)@")
JOIN = re.compile(r"[ \t]*[+.][ \t]*(?=[\"'A-Za-z_$])")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.$-")
#: How sensitive the words of a name are.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "passcode": 0.9, "secret": 1.0, "secrets": 0.9, "token": 0.9,
    "credential": 0.9, "credentials": 0.9, "apikey": 1.0, "privatekey": 1.0, "bearer": 0.8, "auth": 0.7, "authorization": 0.8, "pass": 0.7, "signature": 0.6,
}
#: Words that make a following "key" sensitive, and literals that stand for a value.
KEYED = {"api", "access", "private", "secret", "signing", "encryption", "master", "service", "account", "shared"}
PLACEHOLDER = re.compile(r"(?i)^(?:\$\{.*|\{\{.*|%\(.*|<.*|x+|\*+|\.+|none|null|nil|true|false|changeme|change_me|placeholder|redacted|example|todo|string|your[_-].*|process\.env.*|os\.environ.*|env\..*)$")
LEAST_SCORE = 0.75


def sensitivity(name: str) -> float:
    words = [w.lower() for w in WORDS.findall(name)]
    best = max([SENSITIVE.get(w, 0.0) for w in words], default=0.0)
    for a, b in zip(words, words[1:], strict=False):
        best = max(best, 0.9 if b in ("key", "keys") and a in KEYED else SENSITIVE.get(a + b, 0.0))
    return best


def shape(literal: str) -> float:
    """0 to 1: how much a literal looks like a secret."""
    n = len(literal)
    if n < 6 or PLACEHOLDER.match(literal) or any(c.isspace() for c in literal):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    classes = sum(any(f(c) for c in literal) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in literal)
    return min(1.0, 0.25 * min(entropy, 3.0) / 3 + 0.25 * min(n, 12) / 12 + 0.25 * min(classes, 3) - 0.0)


def name_before(text: str, end: int, least: int) -> str | None:
    """The name, bare or quoted, that ends before `end` (blanks aside) and starts at `least` or later."""
    while end > least and text[end - 1] in " \t":
        end -= 1
    if end > least and text[end - 1] in "\"'":
        start = text.rfind(text[end - 1], least, end - 1)
        inner = text[start + 1 : end - 1] if start >= 0 else ""
        return inner if inner and "\n" not in inner else None
    start = end
    while start > least and text[start - 1] in NAME_CHARS:
        start -= 1
    first = NAME_START.search(text, start, end)
    return text[first.start() : end] if first else None


def pairs(text: str) -> list[tuple[str, list[tuple[int, int, bool]]]]:
    """(name, parts) of every assignment; a part is the span of a literal (True) or of a name (False)."""
    out, last = [], 0
    for op in OPERATOR.finditer(text):
        name, last = name_before(text, op.start(), last), op.end()
        if name is None:
            continue
        parts, at = [], op.end()
        while value := VALUE.match(text, at):
            k = value.lastindex
            parts.append((*value.span(k), k < 3)) if k else None
            at = value.end()
            if not (more := JOIN.match(text, at)):
                break
            at = more.end()
        if parts:
            out.append((name, parts))
    if "</" in text:
        out += [(m[1], [(*m.span(2), True)]) for m in MARKUP.finditer(text)]
    if "://" in text:
        out += [("password", [(*m.span(1), True)]) for m in URL.finditer(text)]
    return out


def literals(text: str, least: float = LEAST_SCORE) -> list[tuple[int, int, float]]:
    """Spans and scores of the literals that sensitive names hold, directly or through constants."""
    found = pairs(text)
    if not found:
        return []
    names = {name for name, _ in found}
    level = {name: sensitivity(name) for name in names}
    feeds: dict[str, list[str]] = {}
    for name, parts in found:
        for start, end, quoted in parts:
            if not quoted and text[start:end] in names:
                feeds.setdefault(name, []).append(text[start:end])
    waiting = [n for n in names if level[n] > 0 and n in feeds]
    while waiting:  # each step raises a level to one of a few values
        name = waiting.pop()
        for source in feeds.get(name, ()):
            if level[source] < level[name]:
                level[source] = level[name]
                waiting.append(source)
    out = []
    for name, parts in found:
        if not level[name]:
            continue
        whole = "".join(text[s:e] for s, e, quoted in parts if quoted)
        for start, end, quoted in parts:
            own = text[start:end]
            if quoted:
                looks = shape(whole)
            else:  # a bare value is a literal only if it is no name and mixes letters and digits
                looks = shape(own) if own not in names and re.search("[0-9]", own) and re.search("[A-Za-z]", own) else 0.0
            if end > start and looks > 0 and (score := 0.5 * level[name] + 0.5 * looks) >= least:
                out.append((start, end, score))
    return out


def spans(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and those that lexing adds, as (start, end, kind) in order."""
    text = text or ""
    base = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    base += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    base += [(*m.span(), "hex") for m in HEX.finditer(text)]
    base.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    starts, reach = [x[0] for x in base], list(accumulate((x[1] for x in base), max))

    def inside(start: int, end: int) -> bool:
        k = bisect_right(starts, start)
        return k > 0 and reach[k - 1] >= end

    return base, sorted({(s, e, "literal") for s, e, _ in literals(text) if not inside(s, e)})


def listed(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans), a row per row of docs; base and spans list kind:start:end."""

    def one(text):
        base, added = spans(text)
        every = sorted([*base, *added], key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
        return [*(sum(k == kind for _, _, k in base) for kind in KINDS[:3]), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)]

    def run(batches):
        for batch in batches:
            for start, texts in slices(batch, 1):
                rows = [one(t) for t in texts]
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate([pa.int64()] * 3 + [pa.string()] * 2)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), *columns], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: secrets of every document."""
    return scan(table(spark, sf_dir, "documents"))
