"""Strictly typed access to JSON lines: a field of a wrong type rejects its whole record.

A field may be missing. Null counts as missing for optional fields and rejects others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The shape of an RFC 3339 time with a zone, in upper case.
RFC3339 = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def parse(line: Column) -> Column:
    """The line as a VARIANT; null unless it is one JSON object with nothing after it."""
    whole = F.try_parse_json(F.concat(F.lit("["), line, F.lit("]")))
    first = F.try_variant_get(whole, "$[0]", "variant")
    fine = kind(first).startswith("OBJECT<") & F.try_variant_get(whole, "$[1]", "variant").isNull()
    return F.when(fine, first)


def once(value: Column, keep: Column | None = None) -> Column:
    """For select(): the value's rows that are not null, and those that `keep` is true of. A generator keeps the
    optimizer from copying a costly value into every expression and filter that names it."""
    found = F.array_compact(F.array(value))
    return F.explode(found if keep is None else F.when(keep, F.array(value)).otherwise(found))


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def field(record: Column, path: str) -> Column:
    return F.try_variant_get(record, path, "variant")


def _is(record: Column, path: str, test, optional: bool) -> Column:
    k = kind(field(record, path))
    fine = test(k)
    if optional:
        fine = fine | (k == "VOID")
    return k.isNull() | fine


def is_string(record: Column, path: str, optional: bool = True) -> Column:
    return _is(record, path, lambda k: k == "STRING", optional)


def is_bool(record: Column, path: str, optional: bool = False) -> Column:
    return _is(record, path, lambda k: k == "BOOLEAN", optional)


def is_long(record: Column, path: str, optional: bool = True) -> Column:
    return _is(record, path, lambda k: k == "BIGINT", optional)


def is_object(record: Column, path: str, optional: bool = True) -> Column:
    return _is(record, path, lambda k: k.startswith("OBJECT<"), optional)


def is_content(record: Column, path: str) -> Column:
    """Text, or an array of blocks {type: string, text: string or null}."""
    v = field(record, path)
    blocks = F.try_variant_get(v, "$", "array<variant>")

    def block(b: Column) -> Column:
        return kind(b).startswith("OBJECT<") & is_string(b, "$.type", optional=False) & is_string(b, "$.text")

    array = kind(v).startswith("ARRAY<") & F.coalesce(F.forall(blocks, block), F.lit(True))
    return kind(v).isNull() | kind(v).isin("STRING", "VOID") | array


def all_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a & b, tests)


def string(record: Column, path: str) -> Column:
    return F.try_variant_get(record, path, "string")


def is_text(record: Column, path: str) -> Column:
    return F.coalesce(kind(field(record, path)) == "STRING", F.lit(False))


def blocks_text(record: Column, path: str) -> Column:
    """The text blocks of an array, joined by newlines."""
    blocks = F.try_variant_get(record, path, "array<variant>")
    texts = F.transform(F.filter(blocks, lambda b: (string(b, "$.type") == "text") & string(b, "$.text").isNotNull()), lambda b: string(b, "$.text"))
    return F.array_join(texts, "\n")


def rfc3339_ms(text: Column) -> Column:
    """Epoch milliseconds of an RFC 3339 time with a zone; null for any other text."""
    upper = F.upper(text)
    shaped = upper.rlike(RFC3339)
    return F.when(shaped, F.unix_millis(upper.try_cast("timestamp")))
