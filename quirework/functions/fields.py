"""Form field flags, types and values."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Field flag bits.
READ_ONLY, REQUIRED, MULTILINE, RADIO, COMBO = 1, 2, 4096, 32768, 131072


def strip_slash(value) -> Column:
    return F.regexp_replace(value, "^/", "")


def strip_parens(value) -> Column:
    """Content of a parenthesised literal."""
    whole = value.startswith("(") & value.endswith(")") & (F.length(value) >= 2)
    return F.when(whole, F.regexp_replace(F.regexp_replace(value, r"^\(", ""), r"\)$", "")).otherwise(value)


def field_type(ft, ff, name) -> Column:
    kind = strip_slash(ft)
    flags = F.coalesce(ff, F.lit(0))
    return (
        F.when((kind == "Tx") & F.coalesce(name.startswith("date_"), F.lit(False)), "date")
        .when((kind == "Btn") & (flags.bitwiseAND(RADIO) != 0), "radio")
        .when(kind == "Btn", "checkbox")
        .when(kind == "Ch", "dropdown")
        .otherwise("text")
    )


def decode_field_flags(ft, ff) -> Column:
    kind, flags = strip_slash(ft), F.coalesce(ff, F.lit(0))
    known = F.coalesce(kind.isin("Tx", "Btn", "Ch"), F.lit(False))
    on = lambda bit: flags.bitwiseAND(bit) != 0
    return F.struct(
        ((kind == "Tx") & on(MULTILINE)).alias("multiline"),
        (known & on(READ_ONLY)).alias("read_only"),
        (known & on(REQUIRED)).alias("required"),
        ((kind == "Btn") & on(RADIO)).alias("radio"),
    )


def encode_field_flags(kind, multiline, read_only, required) -> Column:
    bit = lambda cond, value: F.when(cond, F.lit(value)).otherwise(F.lit(0))
    return (
        bit(((kind == "text") & multiline) | (kind == "date"), MULTILINE)
        .bitwiseOR(bit(kind == "radio", RADIO))
        .bitwiseOR(bit(kind == "dropdown", COMBO))
        .bitwiseOR(bit(read_only, READ_ONLY))
        .bitwiseOR(bit(required, REQUIRED))
    )


def update_field_flags(flags, read_only, required) -> Column:
    """Set or clear the two editable bits, keep the others."""
    kept = F.coalesce(flags, F.lit(0)).bitwiseAND(F.lit(~(READ_ONLY | REQUIRED)))
    return kept.bitwiseOR(F.when(read_only, READ_ONLY).otherwise(0)).bitwiseOR(F.when(required, REQUIRED).otherwise(0))


def field_bool(value, appearance) -> Column:
    """Truth of a checkbox or radio button; the appearance state stands in for a missing value."""
    return F.coalesce(strip_slash(F.coalesce(value, appearance)).isin("Yes", "On"), F.lit(False))


def missing_required(kind, required, value) -> Column:
    return required & kind.isin("text", "date", "dropdown") & (F.coalesce(value, F.lit("")) == "")
