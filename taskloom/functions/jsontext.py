"""Strict JSON tests and extraction on text columns, on top of the variant functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A backslash-u escape the strict reader refuses: the NUL character (an odd run of backslashes starts a real escape).
_NUL_ESCAPE = r"(?<!\\)(?:\\\\)*\\u0000"
# Escapes of the two halves of a surrogate pair, and of a half on its own once pairs are taken out.
_PAIR = r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}"
_HALF = r"\\u[dD][89a-fA-F]"


def _wrapped(text: Column) -> tuple[Column, Column]:
    """The text as the value of `v` in an object that ends with a key nobody can write into the text itself."""
    end = F.concat(F.lit("end"), F.md5(text))
    return F.concat(F.lit('{"v":'), text, F.lit(',"'), end, F.lit('":1}')), end


def _lone_surrogate(text: Column) -> Column:
    """Whether an escape stands for half a surrogate pair. Escaped backslashes go first, so that what is left starts an escape."""
    return F.regexp_replace(F.replace(text, F.lit("\\\\"), F.lit("")), _PAIR, "").rlike(_HALF)


def is_json(text: Column) -> Column:
    """True when the text is exactly one JSON value. Never null. Values nested more than a thousand deep, a limit of the engine's
    reader, count as invalid.

    `try_parse_json` alone accepts trailing garbage; inside the wrapper such garbage swallows the closing key.
    """
    wrapped, end = _wrapped(text)
    whole = F.json_object_keys(wrapped) == F.array(F.lit("v"), end)
    return F.coalesce(whole & F.try_parse_json(wrapped).isNotNull() & ~text.rlike(_NUL_ESCAPE) & ~_lone_surrogate(text), F.lit(False))


def parsed(text: Column) -> Column:
    """The text as a variant, or null when it is not valid JSON."""
    return F.when(is_json(text), F.try_parse_json(text))


def text_of(variant: Column, key: str) -> Column:
    """Text of a member; null when the member is absent or JSON null, or the value is no object."""
    return F.try_variant_get(variant, f"$.{key}", "string")


def json_of(variant: Column, key: str) -> Column:
    """JSON text of a member; null only when the member is absent."""
    return F.to_json(F.try_variant_get(variant, f"$.{key}", "variant"))


def json_object(**members: Column) -> Column:
    """JSON text of an object that keeps members whose value is null."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in members.items()]), {"ignoreNullFields": "false"})
