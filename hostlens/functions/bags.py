"""Values out of a bag of raw properties (VARIANT), whatever their type. Nothing raises: what is absent or can't be read takes its default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as v


def _value(bag: Column, name: str) -> Column:
    return F.try_variant_get(bag, f"$.{name}", "variant")


def _kind(bag: Column, name: str) -> Column:
    """BIGINT, DECIMAL(p,s), DOUBLE, BOOLEAN, STRING, ARRAY<...>, OBJECT<...>, VOID, or null where the property is absent."""
    return F.schema_of_variant(_value(bag, name))


def _get(bag: Column, name: str, kind: str) -> Column:
    """The value as that type. It is cast where it is needed: a scan reads each property once, not once a type."""
    return F.try_variant_get(_value(bag, name), "$", kind)


def _joined(parts: Column) -> Column:
    """Parts by a comma and a space, null is empty. The lambda keeps what reads bags out of whole-stage code: one method with all columns of a class is too long (8,000 bytes) for the JVM to compile."""
    return F.array_join(F.transform(parts, lambda part: F.coalesce(part, F.lit(""))), ", ")


def text(bag: Column, name: str) -> Column:
    """Text of any value: arrays joined by a comma and a space, their parts as they are; truth values as True and False; others without white space at their ends. Absent: empty."""
    plain = F.try_variant_get(bag, f"$.{name}", "string")  # few texts look like an array or a truth value: the type of the others isn't asked for
    return (
        F.when(plain.startswith("[") & _kind(bag, name).startswith("ARRAY"), _joined(_get(bag, name, "array<string>")))
        .when(plain.isin("true", "false") & (_kind(bag, name) == "BOOLEAN"), F.initcap(plain))
        .otherwise(v.text(plain))
    )


def integer(bag: Column, name: str, default: int | None = None) -> Column:
    """A whole number: fractions round half to even, texts count only without a fraction, true is 1. Absent, too large or unreadable: the default."""
    kind = _kind(bag, name)
    found = (
        F.when(kind == "BIGINT", _get(bag, name, "bigint").try_cast("int"))
        .when(kind == "STRING", F.trim(_get(bag, name, "string")).try_cast("int"))
        .when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), F.bround(_get(bag, name, "double"), 0).try_cast("int"))
        .when(kind == "BOOLEAN", _get(bag, name, "boolean").cast("int"))
    )
    return F.coalesce(found, F.lit(default).cast("int"))


def unsigned(bag: Column, name: str) -> Column:
    """A whole number from 0 on, as integer() reads it but wider; negative, absent or unreadable: 0."""
    kind = _kind(bag, name)
    found = (
        F.when(kind == "BIGINT", _get(bag, name, "bigint"))
        .when(kind == "STRING", F.trim(_get(bag, name, "string")).try_cast("bigint"))
        .when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), F.bround(_get(bag, name, "double"), 0).try_cast("bigint"))
        .when(kind == "BOOLEAN", _get(bag, name, "boolean").cast("bigint"))
    )
    return F.greatest(F.coalesce(found, F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))


def truth(bag: Column, name: str) -> Column:
    """A truth value; of numbers 0 is false; null where there is none."""
    kind = _kind(bag, name)
    return F.when(kind == "BOOLEAN", _get(bag, name, "boolean")).when(kind == "BIGINT", _get(bag, name, "bigint") != 0).when(kind == "STRING", F.trim(_get(bag, name, "string")).try_cast("boolean"))
