"""Text expressions: Column in, Column out, all inside Catalyst but for canonical JSON of numbers with fractions."""

from __future__ import annotations

import hashlib
import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

#: Words that are no query terms.
STOP_WORDS = (
    "a an and are as at be but by do for from how i if in into is it my of on or our the to with you your"
).split()
#: Words that refer back to an earlier turn.
REFERENTIAL_WORDS = "it that this those they them".split()
LEAST_TERM_LENGTH = 3
ELLIPSIS = "…"


def squeeze(text: Column) -> Column:
    """Runs of Unicode white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def strip(text: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def plain(text: Column) -> Column:
    """Lower-case letters a-z and digits, all else one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def distinct_in_order(values: Column) -> Column:
    return F.array_distinct(values)


def terms(text: Column) -> Column:
    """Distinct query terms in order: no stop words, no numbers, nothing short."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9']+)"), F.lit(1))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    useful = F.filter(
        tokens,
        lambda t: (F.length(t) >= LEAST_TERM_LENGTH) & ~F.array_contains(stop, t) & ~t.rlike("^[0-9]+$"),
    )
    return distinct_in_order(F.coalesce(useful, F.array().cast("array<string>")))


def reference_key(text: Column) -> Column:
    """The key by which notes are looked up."""
    return F.lower(F.translate(squeeze(text), "_", " "))


def without_md(text: Column) -> Column:
    return F.rtrim(F.regexp_replace(text, r"(?i)\.md$", ""))


def section_label(text: Column) -> Column:
    """White space squeezed, one colon at the end dropped."""
    return F.rtrim(F.regexp_replace(squeeze(text), ":$", ""))


def unquoted(text: Column) -> Column:
    """Without one pair of equal quotes around it."""
    return F.regexp_replace(text, r"""^(?s)(["'])(.*)\1$""", "$2")


def snippet(text: Column, limit: int = 120) -> Column:
    clean = squeeze(text)
    cut = F.concat(F.rtrim(F.substring(clean, 1, limit - 1)), F.lit(ELLIPSIS))
    return F.when(F.length(clean) <= limit, clean).otherwise(cut)


def is_referential(text: Column) -> Column:
    """Whether a referring word stands between spaces; one with punctuation does not count."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    out = F.lit(False)
    for word in REFERENTIAL_WORDS:
        out = out | F.contains(padded, F.lit(f" {word} "))
    return out


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def _escaped(text: Column) -> Column:
    """The inside of a JSON string: ASCII only, other characters as UTF-16 code units."""
    out = text
    for plain_form, form in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(plain_form), F.lit(form))

    def unit(value: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(value.cast("long"))), 4, "0"))

    def written(part: Column) -> Column:
        code = F.ascii(part)
        high, low = F.shiftright(code - 0x10000, 10) + 0xD800, (code - 0x10000).bitwiseAND(F.lit(0x3FF)) + 0xDC00
        return F.when(code.between(32, 126), part).when(code < 0x10000, unit(code)).otherwise(F.concat(unit(high), unit(low)))

    parts = F.regexp_extract_all(out, F.lit("(?s)[ -~]+|[^ -~]"), F.lit(0))
    return F.when(out.rlike(r"^[ -~]*\z"), out).otherwise(F.array_join(F.transform(parts, written), ""))


def _has_fractions(kind: DataType) -> bool:
    return any(name in kind.simpleString() for name in ("double", "float", "decimal"))


def _json(value: Column, kind: DataType) -> Column:
    """JSON of a value of a known type, `null` for null: fields and keys sorted, no spaces."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(F.lit(json.dumps(f.name) + ":"), _json(value.getField(f.name), f.dataType)) for f in fields]
        out = F.when(value.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))
    elif isinstance(kind, ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: _json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, MapType):
        keys = F.array_sort(F.map_keys(value))
        entry = lambda k: F.concat(F.lit('"'), _escaped(k), F.lit('":'), _json(F.element_at(value, k), kind.valueType))
        out = F.concat(F.lit("{"), F.array_join(F.transform(keys, entry), ","), F.lit("}"))
    elif isinstance(kind, StringType):
        out = F.concat(F.lit('"'), _escaped(value), F.lit('"'))
    else:
        out = value.cast("string")
    return F.coalesce(out, F.lit("null"))


def _dumped(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def value_hash(value: Any) -> str:
    """The hash of a value's canonical JSON, in Python."""
    return hashlib.sha256(_dumped(value).encode()).hexdigest()


@F.pandas_udf(StringType())
def _canonical(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else _dumped(json.loads(v)))


@F.pandas_udf(StringType())
def _hashed(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else value_hash(json.loads(v)))


def _without_type(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def canonical_json(value: Column, kind: DataType | None = None) -> Column:
    """JSON with sorted keys, no spaces and ASCII escapes; nulls are kept, but a value that is null itself gives null.

    With its type it is made by expressions. Without, or where the type has fractions, whose shortest form no
    expression gives, it is made in Python.
    """
    if kind is None or _has_fractions(kind):
        return _canonical(_without_type(value))
    return F.when(value.isNotNull(), _json(value, kind))


def json_hash(value: Column, kind: DataType | None = None) -> Column:
    if kind is None or _has_fractions(kind):  # only the hash comes back from Python
        return _hashed(_without_type(value))
    return F.sha2(canonical_json(value, kind), 256)


def type_of(rows: DataFrame, column: str) -> DataType:
    return rows.schema[column].dataType
