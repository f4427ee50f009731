import pytest

from hduframe.errors import InvalidCard, InvalidFormat, InvalidTable, MissingKeyword, UnsupportedBitpix, WrongType
from hduframe.sources import tform
from hduframe.sources.cards import UNDEFINED, Card, Header, format_card, format_float, parse_card, parse_header


def card(text):
    return parse_card(text.ljust(80).encode())


def blocks(raw):
    return (raw[k : k + 2880] for k in range(0, len(raw), 2880))


@pytest.mark.parametrize(
    ("text", "value", "comment"),
    [
        ("NAXIS   =                    2 / axes", 2, "axes"),
        ("SIMPLE  =                    T", True, None),
        ("A       =              1.5D3 / x", 1500.0, "x"),
        ("A       = -.5e-2", -0.005, None),
        ("A       = 'it''s / here  ' / note", "it's / here", "note"),
        ("A       = ''", "", None),
        ("A       = (1, -2) / c", (1, -2), "c"),
        ("A       = (1.0, 2)", (1.0, 2.0), None),
        ("A       = 99999999999999999999", 1e20, None),
        ("A       = nan", None, None),
    ],
)
def test_values(text, value, comment):
    c = card(text)
    if text.endswith("nan"):
        assert c.value != c.value
    else:
        assert c.value == value and type(c.value) is type(value)
    assert c.comment == comment


def test_undefined_and_commentary():
    assert card("A       =").value is UNDEFINED
    assert card("A       = / only a note").comment == "only a note"
    assert card("A       = 12x").value is UNDEFINED
    c = card("COMMENT   a = b")
    assert c.value is None and c.comment == "  a = b" and c.value_type is None
    assert card("HIERARCH ESO DET = 1").value is None


def test_bad_cards():
    with pytest.raises(InvalidCard):
        card("A       = 'open")
    with pytest.raises(InvalidCard):
        card("A       = (1)")
    with pytest.raises(InvalidCard):
        parse_card(b"A       = '" + b"\xff" * 69)


@pytest.mark.parametrize("value", [0, -7, 1 << 62, True, False, 1.0, 123.456, -1e-300, "", "short", "it's", "a" * 66, "a" * 68, "&", "x&" * 60, "'" * 90, "é" * 100, "ends with &", (1, 2), (1.5, -2.5), UNDEFINED])
@pytest.mark.parametrize("comment", [None, "note", "n" * 50])
def test_round_trip(value, comment):
    h = Header([Card("KEY", value, comment), Card("END2", 1)])
    raw = h.to_bytes()
    assert len(raw) % 2880 == 0
    back, n = parse_header(blocks(raw))
    assert n == len(raw) and len(back) == 2
    assert back.find("key").value == value or value is UNDEFINED and back.find("key").value is UNDEFINED
    if comment == "note":
        assert back.find("KEY").comment == comment


def test_long_strings_use_continue():
    lines = format_card(Card("LONG", "x" * 200, "c"))
    assert all(len(x) == 80 for x in lines) and lines[1].startswith(b"CONTINUE  '")


def test_float_text():
    assert format_float(123.456) == "1.234560000000000E2" and format_float(-0.001) == "-1.000000000000000E-3" and format_float(0.0) == "0.000000000000000E0"


def test_header_lookups():
    h = Header([Card("A", 1), Card("a", 2), Card("F", 2.5), Card("S", "x"), Card("B", True)])
    assert h.get_int("a") == 1 and h.get_float("A") == 1.0 and h.get_int("F") is None and h.get_bool("B") is True and h.get_int("B") is None
    h.set("f", 3.0)
    h.set("new", 4, "c")
    assert h.get_float("F") == 3.0 and h.find("NEW").comment == "c" and h.cards[-1].name == "NEW"
    with pytest.raises(MissingKeyword):
        h.require_int("Z")
    with pytest.raises(WrongType):
        h.require_int("S")


def test_header_without_end():
    with pytest.raises(InvalidFormat):
        parse_header(blocks(b" " * 2880))


def test_tforms():
    sizes = {"1L": 1, "9X": 2, "4B": 4, "J": 4, "3K": 24, "8A": 8, "0E": 0, "M": 16, "1PJ(5)": 8, "QD": 16}
    assert {f: tform.parse_binary(f).size for f in sizes} == sizes
    assert str(tform.parse_binary("PB(7)")) == "1PB(7)" and str(tform.parse_binary("E")) == "1E"
    assert (tform.parse_ascii("F14.2").width, tform.parse_ascii("I5").code) == (14, "I")
    for bad in ("", "3Z", "PP"):
        with pytest.raises(InvalidTable):
            tform.parse_binary(bad)
    for bad in ("A", "F10", "I"):
        with pytest.raises(InvalidTable):
            tform.parse_ascii(bad)
    with pytest.raises(UnsupportedBitpix):
        tform.bitpix(12)
    assert tform.unique_names(["a", "", "A", "a"]) == ["a", "col_2", "A_2", "a_3"]
