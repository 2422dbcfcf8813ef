"""Text style structs: merge, override tests, uniform style."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Style fields.
PLAIN_FIELDS = ("font_family", "font_size", "bold", "italic", "underline", "strikethrough", "dir")
STYLE_FIELDS = (*PLAIN_FIELDS, "color")
STYLE_TYPE = (
    "struct<font_family:string,font_size:double,bold:boolean,italic:boolean,"
    "underline:boolean,strikethrough:boolean,dir:string,color:array<double>>"
)


def merge_style(base: Column, override: Column) -> Column:
    """Field by field: a set override wins, and false is set."""
    return F.struct(*[F.coalesce(override[f], base[f]).alias(f) for f in STYLE_FIELDS])


def has_style(style: Column) -> Column:
    return F.coalesce(*[F.when(style[f].isNotNull(), True) for f in STYLE_FIELDS], F.lit(False))


def _differs(style: Column, base: Column, field: str) -> Column:
    return style[field].isNotNull() & ~style[field].eqNullSafe(base[field])


def style_overrides_default(style: Column, default: Column) -> Column:
    """Editor rule: any set field that differs; a set colour always counts; direction never."""
    fields = [f for f in PLAIN_FIELDS if f != "dir"]
    found = style["color"].isNotNull()
    for f in fields:
        found = found | _differs(style, default, f)
    return F.coalesce(found, F.lit(False))


def style_overrides_fallback(style: Column, fallback: Column) -> Column:
    """Drawing rule: set underline, strikethrough or colour always count, the rest when different."""
    found = style["underline"].isNotNull() | style["strikethrough"].isNotNull() | style["color"].isNotNull()
    for f in ("font_family", "font_size", "bold", "italic", "dir"):
        found = found | _differs(style, fallback, f)
    return F.coalesce(found, F.lit(False))
