"""Header cards: 80 bytes each, a name, often a value, often a comment."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from ..errors import InvalidCard, InvalidFormat, MissingKeyword, WrongType

CARD, BLOCK = 80, 2880
_INT = re.compile(r"[+-]?\d+\Z")
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity|nan)\Z", re.I)


class Undefined:
    """The value of a card that has a value field with nothing in it."""

    def __repr__(self) -> str:
        return "UNDEFINED"


UNDEFINED = Undefined()


@dataclass
class Card:
    """value: None for commentary, else UNDEFINED, bool, int, float, str or a pair of numbers (complex)."""

    name: str
    value: object = None
    comment: str | None = None
    raw: str = ""
    more: bool = False  # a string that a CONTINUE card may go on with

    @property
    def value_type(self) -> str | None:
        v = self.value
        if v is None:
            return None
        if isinstance(v, tuple):
            return "complex_int" if all(isinstance(x, int) for x in v) else "complex_float"
        return {Undefined: "undefined", bool: "logical", int: "int", float: "float", str: "string"}[type(v)]


def fortran_exponent(text: str) -> str:
    return text.replace("D", "E").replace("d", "e")


def number(text: str) -> int | float | None:
    if _INT.match(text) and -(1 << 63) <= int(text) < 1 << 63:
        return int(text)
    text = fortran_exponent(text)
    return float(text) if _NUMBER.match(text) else None


def _quoted(field: str) -> tuple[str, str]:
    """The text of a field that starts with a quote, and what follows it."""
    out, k = [], 1
    while True:
        end = field.find("'", k)
        if end < 0:
            raise InvalidCard(f"a string without its closing quote: {field!r}")
        out.append(field[k:end])
        if field[end + 1 : end + 2] != "'":
            return "'".join(out), field[end + 1 :]
        k = end + 2


def _after(rest: str) -> str | None:
    at = rest.find("/")
    return rest[at + 1 :].strip() if at >= 0 else None


def parse_value(field: str) -> tuple[object, str | None, bool]:
    """Value, comment and whether a string ends with the mark of continuation."""
    field = field.strip()
    if not field:
        return UNDEFINED, None, False
    if field[0] == "'":
        text, rest = _quoted(field)
        text = text.rstrip()
        more = text.endswith("&")
        return text[:-1] if more else text, _after(rest), more
    if field[0] == "(":
        end = field.find(")")
        parts = field[1:end].split(",") if end > 0 else []
        pair = [number(p.strip()) for p in parts]
        if len(pair) != 2 or None in pair:
            raise InvalidCard(f"no complex number: {field!r}")
        if not all(isinstance(x, int) for x in pair):
            pair = [float(x) for x in pair]
        return tuple(pair), _after(field[end + 1 :]), False
    text, slash, comment = field.partition("/")
    text = text.strip()
    note = comment.strip() if slash else None
    if not text:
        return UNDEFINED, note, False
    if text in ("T", "F"):
        return text == "T", note, False
    value = number(text)
    return UNDEFINED if value is None else value, note, False


def parse_card(raw: bytes) -> Card:
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError as e:
        raise InvalidCard(f"a card isn't UTF-8: {raw!r}") from e
    name = raw[:8].decode("utf-8", "replace").rstrip()
    if raw[8:10] == b"= ":
        value, comment, more = parse_value(raw[10:].decode("utf-8", "replace"))
        return Card(name, value, comment, text, more)
    return Card(name, None, raw[8:].decode("utf-8", "replace").rstrip() or None, text)


def format_float(x: float) -> str:
    """Fifteen decimals and an exponent without sign or zeros in front, if it is positive."""
    if x != x or x in (float("inf"), float("-inf")):
        return {"nan": "NaN", "inf": "inf", "-inf": "-inf"}[str(x)]
    mantissa, exponent = f"{x:.15E}".split("E")
    return f"{mantissa}E{int(exponent)}"


def format_value(v: object) -> str:
    if isinstance(v, bool):
        return "T" if v else "F"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return format_float(v)
    if isinstance(v, tuple):
        return f"({format_value(v[0])}, {format_value(v[1])})"
    return ""


def _fill(text: str) -> bytes:
    """Up to 80 bytes, not cut inside a character."""
    return text.encode()[:CARD].decode("utf-8", "ignore").encode().ljust(CARD)


def _pieces(text: str, most: int) -> list[str]:
    """Of a text with doubled quotes: cut neither in a pair of quotes nor in a character."""
    out, now, size = [], [], 0
    for unit in re.findall(r"''|.", text, re.S):
        n = len(unit.encode())
        if size + n > most:
            out.append("".join(now))
            now, size = [], 0
        now.append(unit)
        size += n
    return [*out, "".join(now)]


def format_card(card: Card) -> list[bytes]:
    """One card, or more for a long string: pieces that end with & and go on in CONTINUE cards."""
    name, v, comment = card.name.upper(), card.value, card.comment
    if v is None:
        body = comment or ""
        pieces = [body[k : k + 72] for k in range(0, len(body), 72)] or [""]
        return [_fill(f"{name:<8}{p}") for p in pieces]
    if not isinstance(v, str):
        text = format_value(v)
        line = f"{name:<8}= {text:>20}" if len(text) <= 20 else f"{name:<8}= {text}"
        return [_fill(f"{line} / {comment}" if comment else line)]
    escaped = v.replace("'", "''")
    room = 68
    if len(escaped.encode()) <= room - (3 + len(comment.encode()) if comment else 0) or len(escaped.encode()) <= room and not comment and not v.endswith("&"):
        if not v.endswith("&"):
            line = f"{name:<8}= '{escaped:<8}'"
            return [_fill(f"{line} / {comment}" if comment else line)]
    pieces = _pieces(escaped, 67)
    if pieces[-1].endswith("&") or comment and len(pieces[-1].encode()) + 3 + len(comment.encode()) > 67:
        pieces.append("")
    lines = [f"{name:<8}= '{pieces[0]}&'", *(f"CONTINUE  '{p}&'" for p in pieces[1:-1])]
    if len(pieces) > 1:
        lines.append(f"CONTINUE  '{pieces[-1]}'" + (f" / {comment}" if comment else ""))
    else:
        lines = [f"{name:<8}= '{pieces[0]}&'", "CONTINUE  ''" + (f" / {comment}" if comment else "")]
    return [_fill(x) for x in lines]


class Header:
    """Cards in order; lookups give the first of a name, whatever its case."""

    def __init__(self, cards: Iterable[Card] = ()):
        self.cards = list(cards)

    def __iter__(self) -> Iterator[Card]:
        return iter(self.cards)

    def __len__(self) -> int:
        return len(self.cards)

    def find(self, name: str) -> Card | None:
        name = name.upper()
        return next((c for c in self.cards if c.name.upper() == name), None)

    def _typed(self, name: str, kinds: tuple, convert):
        card = self.find(name)
        if card is None or isinstance(card.value, bool) and bool not in kinds or not isinstance(card.value, kinds):
            return None
        return convert(card.value)

    def get_int(self, name: str, default: int | None = None) -> int | None:
        v = self._typed(name, (int,), int)
        return default if v is None else v

    def get_float(self, name: str, default: float | None = None) -> float | None:
        v = self._typed(name, (int, float), float)
        return default if v is None else v

    def get_string(self, name: str, default: str | None = None) -> str | None:
        v = self._typed(name, (str,), str)
        return default if v is None else v

    def get_bool(self, name: str, default: bool | None = None) -> bool | None:
        v = self._typed(name, (bool,), bool)
        return default if v is None else v

    def require_int(self, name: str) -> int:
        card = self.find(name)
        if card is None:
            raise MissingKeyword(name)
        if isinstance(card.value, bool) or not isinstance(card.value, int):
            raise WrongType(f"{name} is no integer: {card.value!r}")
        return card.value

    def set(self, name: str, value: object, comment: str | None = None) -> None:
        """Replaces the first card of the name, whose comment stays if none is given, or adds one."""
        card = self.find(name)
        if card is None:
            self.push(Card(name.upper(), value, comment))
        else:
            card.value, card.comment = value, card.comment if comment is None else comment

    def push(self, card: Card) -> None:
        self.cards.append(card)

    def remove(self, name: str) -> None:
        self.cards = [c for c in self.cards if c.name.upper() != name.upper()]

    def to_bytes(self) -> bytes:
        lines = [line for c in self.cards for line in format_card(c)] + [b"END".ljust(CARD)]
        raw = b"".join(lines)
        return raw.ljust(-(-len(raw) // BLOCK) * BLOCK)


def parse_header(blocks: Iterable[bytes]) -> tuple[Header, int]:
    """Cards up to END, CONTINUE cards joined to the string before them; and the bytes read."""
    cards: list[Card] = []
    n = 0
    for block in blocks:
        if len(block) < BLOCK:
            break
        n += BLOCK
        for at in range(0, BLOCK, CARD):
            raw = block[at : at + CARD]
            if raw.rstrip() == b"END":
                return Header(cards), n
            if raw[:10] == b"CONTINUE  " and cards and cards[-1].more:
                text, comment, more = parse_value(raw[10:].decode("utf-8", "replace"))
                if isinstance(text, str):
                    last = cards[-1]
                    last.value, last.more = last.value + text, more
                    last.comment = comment or last.comment
                    continue
            if not raw.strip():
                continue
            cards.append(parse_card(raw))
    raise InvalidFormat("the header has no END card")
