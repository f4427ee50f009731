"""Header cards as column expressions: parsing a column of 80-character cards, formatting values to cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([EeDd][+-]?\d+)?$"


def fortran_exponent(text: Column) -> Column:
    return F.translate(text, "Dd", "Ee")


def parse_cards(df: DataFrame, card: str = "card") -> DataFrame:
    """Adds name, value_type, v_bool, v_int, v_float, v_str, v_re, v_im and comment.  Long strings' CONTINUE cards are rows of their own."""
    c = F.col(card)
    has = F.substring(c, 9, 2) == "= "
    field = F.trim(F.substring(c, 11, 70))
    quoted = F.regexp_extract(field, r"^'((?:[^']|'')*)'", 1)
    text = F.regexp_replace(F.regexp_replace(F.rtrim(F.replace(quoted, F.lit("''"), F.lit("'"))), r"&$", ""), r"\s+$", "")
    is_text, is_complex = field.startswith("'"), field.startswith("(")
    plain = F.trim(F.substring_index(field, "/", 1))
    re, im = (F.trim(F.regexp_extract(field, r"^\(([^,]*),([^)]*)\)", k)) for k in (1, 2))
    whole = plain.rlike(r"^[+-]?\d+$")
    as_int = F.when(whole, plain.try_cast("long"))
    as_float = F.when(plain.rlike(_NUMBER), fortran_exponent(plain).try_cast("double"))
    kind = (
        F.when(~has, F.lit(None).cast("string"))
        .when(field == "", "undefined")
        .when(is_text, "string")
        .when(is_complex & re.rlike(r"^[+-]?\d+$") & im.rlike(r"^[+-]?\d+$"), "complex_int")
        .when(is_complex, "complex_float")
        .when(plain.isin("T", "F"), "logical")
        .when(as_int.isNotNull(), "int")
        .when(as_float.isNotNull(), "float")
        .otherwise("undefined")
    )
    rest = F.when(is_text, F.regexp_replace(field, r"^'(?:[^']|'')*'", "")).when(is_complex, F.regexp_replace(field, r"^\([^)]*\)", "")).otherwise(field)
    note = F.when(F.locate("/", rest) > 0, F.trim(F.expr("substring(_rest, locate('/', _rest) + 1)")))
    out = df.withColumn("name", F.rtrim(F.substring(c, 1, 8))).withColumn("value_type", kind).withColumn("_rest", F.when(has, rest))
    of = lambda k, v: F.when(F.col("value_type") == k, v)
    out = out.withColumns(
        {
            "v_bool": of("logical", plain == "T"), "v_int": of("int", as_int), "v_float": of("float", as_float), "v_str": of("string", text),
            "v_re": F.when(F.col("value_type").startswith("complex"), fortran_exponent(re).try_cast("double")), "v_im": F.when(F.col("value_type").startswith("complex"), fortran_exponent(im).try_cast("double")),
            "comment": F.when(has, note).otherwise(F.nullif(F.rtrim(F.substring(c, 9, 72)), F.lit(""))),
        }
    )
    return out.drop("_rest")


def card_of(name: str | Column, value: Column, comment: Column | None = None) -> Column:
    """A card of a value already written as text: right-justified to column 30 if it is short."""
    n = F.col(name) if isinstance(name, str) else name
    line = F.concat(F.rpad(F.upper(n), 8, " "), F.lit("= "), F.when(F.length(value) <= 20, F.lpad(value, 20, " ")).otherwise(value))
    if comment is not None:
        line = F.concat(line, F.coalesce(F.concat(F.lit(" / "), comment), F.lit("")))
    return F.rpad(line, 80, " ")


def string_card(name: Column, text: Column) -> Column:
    """A card of a text that fits one card: quotes doubled, at least eight characters."""
    quoted = F.replace(text, F.lit("'"), F.lit("''"))
    padded = F.when(F.length(quoted) < 8, F.rpad(quoted, 8, " ")).otherwise(quoted)
    return F.rpad(F.concat(F.rpad(F.upper(name), 8, " "), F.lit("= '"), padded, F.lit("'")), 80, " ")


def commentary_card(name: Column, text: Column) -> Column:
    return F.rpad(F.concat(F.rpad(F.upper(name), 8, " "), text), 80, " ")


def logical_text(value: Column) -> Column:
    return F.when(value, "T").otherwise("F")


def complex_text(re: Column, im: Column) -> Column:
    return F.concat(F.lit("("), re.cast("string"), F.lit(", "), im.cast("string"), F.lit(")"))


def padded_size(n: Column) -> Column:
    """Bytes of whole blocks."""
    return F.ceil(n / 2880).cast("long") * 2880


def typed_value(name: str, kind: str) -> Column:
    """An aggregate over cards: the first card of a name, if it has the type (float takes integers too)."""
    value = {"int": F.col("v_int"), "float": F.coalesce("v_float", F.col("v_int").cast("double")), "string": F.col("v_str"), "logical": F.col("v_bool")}[kind]
    return F.min_by(F.when(F.upper("name") == name.upper(), value), F.when(F.upper("name") == name.upper(), F.col("card_index")))
