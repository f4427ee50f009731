"""Secret scans by a trigram index.

Each rule's regex is parsed and turned into a Boolean query over trigrams, as in indexed code search: literals give the
AND of their trigrams, alternatives an OR, and what may be absent nothing.  Documents are indexed in blocks: one pass over the bytes
of a block's texts, A-Z in lower case, gives for each trigram that some query names its posting list, the sorted places of the texts that hold
it.  A query's postings are intersected and united; only the candidates are searched with the regex.  A rule whose regex forces no
trigram scans each document.  Lower case is that of A-Z alone, so a posting can only hold too many, never too few.

Null and empty texts hold no secrets; texts of any length are searched whole, in time in proportion to their length.  Equal rows get equal
spans, each for itself; doc_id isn't looked at, and an empty table gives no rows.  A column named like the result is replaced, others stay.
Offsets are code points, the end exclusive; matches of a rule don't overlap, those of different rules may, and come by start, then
in the rules' order.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from re import _constants as sre
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep_fields, slices


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 0
    base: bool = False
    find: Callable[[str], Iterator[tuple[int, int]]] | None = None  # the pattern's matches, where the regex engine takes too long


def either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Between the lines of a key: white space, or line ends as they are written in quoted strings.
GAP = r"""(?:[\x20\t\r\n>"']|\\+[nr])+"""
#: A private key from its first line to its END line; where that is missing, to the end of the base64 lines.
PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
    r"(?:[^-]*(?:-[^-]+)*-----END [A-Z ]{0,40}PRIVATE KEY-----"
    rf"|(?:{GAP}(?:Proc-Type|DEK-Info):\x20?[A-Za-z0-9,-]+)*(?:{GAP}[A-Za-z0-9+/=]{{16,}})+(?:{GAP}[A-Za-z0-9+/=]+)?|)"
)

DOTTED = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*")


def web_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Three parts between dots, the first two in base64 of an opening brace.  Parts are looked at once; a regex would try a long
    part again from each place where it could begin."""
    for m in DOTTED.finditer(text):
        parts, at, k = m[0].split("."), m.start(), 0
        while k + 2 < len(parts):
            begin = parts[k].find("eyJ")
            if 0 <= begin <= len(parts[k]) - 11 and parts[k + 1][:3] == "eyJ" and len(parts[k + 1]) >= 11 and len(parts[k + 2]) >= 8:
                yield at + begin, (at := at + sum(map(len, parts[k : k + 3])) + 2)
                at, k = at + 1, k + 3
            else:
                at, k = at + len(parts[k]) + 1, k + 1


#: The contract's rules in their order, then further ones: fixed formats of public services.
RULES = (
    Rule("assign", rf"""({'|'.join(map(either, ('password', 'passwd', 'secret', 'token')))}|{either('api')}_?{either('key')})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
    Rule("private_key", PRIVATE_KEY),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", find=web_tokens),
)

# ---- trigram queries: True, ("and", [...]), ("or", [...]) or a trigram, three bytes of UTF-8 --------------------------


def both(a, b):
    if a is True or a == b:
        return b
    return a if b is True else ("and", [a, b])


def one_of(parts: list):
    return True if any(p is True for p in parts) else parts[0] if len(parts) == 1 else ("or", parts)


def of_text(text: str):
    query, raw = True, text.encode()
    for k in range(len(raw) - 2):
        query = both(query, raw[k : k + 3])
    return query


@dataclass
class Part:
    """What a piece of regex matches: the exact set of texts while small, else what its matches must hold."""

    exact: set[str] | None = None
    query: object = field(default=True)

    def must(self):
        return both(self.query, one_of([of_text(x) for x in sorted(self.exact)])) if self.exact else self.query


EXACT_MOST = 24


def chars(items) -> set[str] | None:
    """The characters of a class, folded, if they are few."""
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(chr(arg))
        elif op is sre.RANGE and arg[1] - arg[0] < 8:
            out |= {chr(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    out = {fold(c) for c in out}
    return out if len(out) <= 4 else None


def then(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= EXACT_MOST:
        return Part({x + y for x in a.exact for y in b.exact}, both(a.query, b.query))
    return Part(None, both(a.must(), b.must()))


def derive(tree) -> Part:
    out = Part({""})
    for op, arg in tree:
        if op is sre.LITERAL:
            part = Part({fold(chr(arg))})
        elif op is sre.IN:
            part = Part(chars(arg))
        elif op is sre.SUBPATTERN:
            part = derive(arg[-1])
        elif op is sre.BRANCH:
            ways = [derive(w) for w in arg[1]]
            union = set().union(*(w.exact or set() for w in ways))
            if all(w.exact is not None for w in ways) and len(union) <= EXACT_MOST:
                part = Part(union, True)
            else:
                part = Part(None, one_of([w.must() for w in ways]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, inner = arg[0], arg[1], derive(arg[2])
            if (low, high) == (0, 1) and inner.exact is not None and inner.query is True:
                part = Part(inner.exact | {""})
            elif low == high == 1:
                part = inner
            else:
                part = Part(None, inner.must() if low else True)
        elif op is sre.AT:
            part = Part({""})
        else:
            part = Part(None, True)
        out = then(out, part)
    return out


def fold(text: str) -> str:
    return text.lower() if text.isascii() else text


def trigram_query(pattern: str):
    return derive(parser.parse(pattern)).must()


def named(query) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(named, query[1]))


class Trigrams:
    """Inverted indexes of blocks of texts, over the trigrams that queries name."""

    PART = 1 << 22  # bytes that are looked at together

    def __init__(self, trigrams: set[bytes]):
        self.names = sorted(trigrams)
        self.number = np.zeros(1 << 24, np.uint16)  # of each trigram; 0 for those that no query names
        for k, t in enumerate(self.names, 1):
            self.number[t[0] << 16 | t[1] << 8 | t[2]] = k

    def postings(self, texts: list[bytes]) -> dict[bytes, np.ndarray]:
        """For each trigram the places of the texts that hold it, ascending."""
        end = np.cumsum([len(t) for t in texts])
        raw = np.frombuffer(b"".join(texts), np.uint8)
        found = [np.empty(0, np.int64)]
        for at in range(0, max(0, len(raw) - 2), self.PART):
            b = raw[at : at + self.PART + 2].astype(np.int32)
            number = self.number[b[:-2] << 16 | b[1:-1] << 8 | b[2:]]
            place = np.flatnonzero(number)
            text = np.searchsorted(end, place + at, "right")
            inside = place + at + 2 < end[text]  # a trigram of two texts is none
            found.append(np.unique(number[place[inside]].astype(np.int64) * len(texts) + text[inside]))
        every = np.unique(np.concatenate(found))
        cut = np.searchsorted(every, np.arange(1, len(self.names) + 2) * len(texts))
        return {t: every[a:b] % max(1, len(texts)) for t, a, b in zip(self.names, cut[:-1], cut[1:], strict=True)}


def candidates(query, index: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    """The places of the texts that can match, ascending."""
    if query is True:
        return np.arange(n)
    if isinstance(query, bytes):
        return index[query]
    parts = sorted((candidates(q, index, n) for q in query[1]), key=len)
    return reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), parts) if query[0] == "and" else np.unique(np.concatenate(parts))


LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = [(r, self.search_form(r), trigram_query(r.pattern)) for r in rules]
        self.trigrams = Trigrams(set().union(*(named(q) for *_, q in self.rules)))

    @staticmethod
    def search_form(rule: Rule) -> re.Pattern:
        """A lone class repeated at least once has the same matches of the least length and over when asked for that length."""
        alone = re.fullmatch(r"(\[[^\]\\]+\])\+", rule.pattern)
        return re.compile(f"{alone[1]}{{{rule.least},}}" if alone and rule.least and not rule.group else rule.pattern)

    def block(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, rule, end), by start, then rule."""
        texts = [t or "" for t in texts]
        index = self.trigrams.postings([t.encode().translate(LOWER) for t in texts])
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, pattern, query) in enumerate(self.rules):
            for at in candidates(query, index, len(texts)).tolist():
                if rule.find:
                    found[at] += ((a, k, b) for a, b in rule.find(texts[at]))
                    continue
                for m in pattern.finditer(texts[at]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[at].append((m.start(), k, m.end()))
        for spans in found:
            spans.sort()
        return found


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]), False)


def scan(df: DataFrame, text: str = "text", spans: str = "secrets", rules: tuple[Rule, ...] = RULES, block: int = 512) -> DataFrame:
    """Adds the spans of secrets, by start and then the rules' order; a column of that name is replaced."""
    keep = [f for f in keep_fields(df.schema, (spans,))]
    names = [f.name for f in keep]
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for part in slices(batches, block):
            found = scanner.block(part.column(text).to_pylist())
            rows = [[{"kind": rules[k].kind, "start": a, "end": b, "base": rules[k].base} for a, k, b in spans] for spans in found]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(rows, arrow)], names=[*names, spans])

    return df.mapInArrow(run, T.StructType([*keep, T.StructField(spans, SPAN)]))


MARK = "[REDACTED]"


def redact(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, block: int = 512) -> DataFrame:
    """The texts with each secret, or run of overlapping ones, replaced by MARK; all other texts and columns as they are."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for part in slices(batches, block):
            texts = part.column(text).to_pylist()
            for i, spans in enumerate(scanner.block(texts)):
                if not spans:
                    continue
                out, end = [], 0
                for a, _, b in spans:
                    if a >= end:
                        out += [texts[i][end:a], MARK]
                    end = max(end, b)
                texts[i] = "".join(out) + texts[i][end:]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == text else part.column(n) for n in names], names=names)

    return df.mapInArrow(run, df.schema)


def digests(df: DataFrame) -> DataFrame:
    """op10: counts and digests of the spans."""
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("secrets", lambda s: s["base"])
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return df.select(
        "doc_id",
        *(count(k) for k in ("assign", "access", "hex")),
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("secrets")).alias("spans"),
    )
