"""String scalars for layout text: fonts, tokens, widths, indents."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageframe.functions.geometry import js_round
from pageframe.functions.script import (
    SPACE_CLASS,
    default_font_for_script,
    is_rtl_block_text,
    wide_trim,
)

# Font name rules.
BOLD_NAME = r"(^|[-_\s,])bold(\b|$)|black|heavy"
ITALIC_NAME = r"italic|oblique"
SUBSET_PREFIX = r"\A[A-Za-z]{6}\+"
STYLE_SUFFIX = r"(?i)-(regular|bold|italic|oblique)\z"
NAME_NOISE = r"[-_,+\s]"
LATIN_KEYWORDS = (
    (r"(?i)timesnewroman|times-?roman", "Times New Roman"),
    (r"(?i)courier", "Courier New"),
    (r"(?i)helvetica|arial|liberation\s*sans|nimbus\s*sans|vogue|calibri", "Arial"),
)
ITALIC_FLAG, BOLD_FLAG, BOLD_WEIGHT = 0x40, 0x40000, 600
DRAW_TOKEN = rf"[{SPACE_CLASS}]+|[0-9]+(?:[./:-][0-9]+)+|[0-9]+|\p{{P}}+|[^{SPACE_CLASS}0-9\p{{P}}]+"
WRAP_TOKEN = rf"[{SPACE_CLASS}]+|[^{SPACE_CLASS}]+"
# The same tokens as WRAP_TOKEN: all of Zs is in the class of spaces, but with a property in it the negated class is several times faster.
WRAP_PATTERN = rf"[{SPACE_CLASS}]+|[^{SPACE_CLASS}\p{{Zs}}]+"
SPACE_EM, CHAR_EM = 0.25, 0.5

# A small registry of (family, aliases, script), in order of preference.
# Callers with a larger font collection pass their own.
DEFAULT_REGISTRY = (
    ("Faruma", ("Faruma",), "thaana"),
    ("MV Boli", ("MV Boli",), "thaana"),
    ("A Waheed", ("A Waheed",), "thaana"),
    ("Arial", ("Arial",), "latin"),
    ("Times New Roman", ("Times New Roman",), "latin"),
    ("Courier New", ("Courier New",), "latin"),
)


def normal_font_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), NAME_NOISE, "")


def _plain(name: str) -> str:
    return "".join(c for c in name.lower() if c not in "-_,+" and not c.isspace())


def canonical_font(name: Column, registry: Sequence = DEFAULT_REGISTRY) -> Column:
    """Registered family whose normalised name equals this one, else the name itself."""
    wanted = normal_font_name(name)
    hits = [F.when(wanted.isin([_plain(a) for a in (family, *aliases)]), family) for family, aliases, _ in registry]
    return F.coalesce(*hits, name)


def resolve_font(hint: Column, text: Column, registry: Sequence = DEFAULT_REGISTRY) -> Column:
    """Family for a font name found in a file: registry, then Latin keyword, then script default.

    The registry is a bounded list, so the ordered lookup is one expression, not a join.
    """
    stripped = F.regexp_replace(F.regexp_replace(hint, SUBSET_PREFIX, ""), STYLE_SUFFIX, "")
    wanted = normal_font_name(stripped)
    tiers = []
    for family, aliases, _ in registry:
        found = F.lit(False)
        for alias in {_plain(a): None for a in (family, *aliases)}:
            found = found | wanted.contains(alias)
        tiers.append(F.when(found, family))
    tiers += [F.when(stripped.rlike(pattern), family) for pattern, family in LATIN_KEYWORDS]
    fallback = default_font_for_script(text)
    return F.when(F.coalesce(hint, F.lit("")) == "", fallback).otherwise(F.coalesce(*tiers, fallback))


def detect_bold_italic(flags, weight, base_font, render_mode) -> Column:
    name = F.lower(base_font)
    bold = (
        (F.coalesce(flags.bitwiseAND(BOLD_FLAG), F.lit(0)) != 0)
        | (F.coalesce(weight, F.lit(0)) >= BOLD_WEIGHT)
        | F.coalesce(name.rlike(BOLD_NAME), F.lit(False))
        | (F.coalesce(render_mode, F.lit(0)) == 2)
    )
    italic = (F.coalesce(flags.bitwiseAND(ITALIC_FLAG), F.lit(0)) != 0) | F.coalesce(
        name.rlike(ITALIC_NAME), F.lit(False)
    )
    return F.struct(bold.alias("bold"), italic.alias("italic"))


def form_da_font_size(da: Column) -> Column:
    """Number before Tf; null when missing or not positive."""
    size = F.nullif(F.regexp_extract(da, r"([0-9]+(?:\.[0-9]+)?)\s+Tf", 1), F.lit("")).cast("double")
    return F.when(size > 0, size)


def annotation_da_font_size(da: Column) -> Column:
    """Number before a free-standing Tf; 12 when missing."""
    found = F.regexp_extract(da, r"(?:\A|\s)([0-9]+(?:\.[0-9]+)?)\s+Tf(?:\s|\z)", 1)
    return F.coalesce(F.nullif(found, F.lit("")).cast("double"), F.lit(12.0))


def rewrite_da_font(da: Column, alias: str, fallback_size: int = 10) -> Column:
    """Swap the font name of a default appearance string, keep size and colour."""
    fresh = F.lit(f"/{alias} {fallback_size} Tf 0 0 0 rg")
    pattern = r"\A([\s\S]*?)/[^\s]+\s+([0-9]+(?:\.[0-9]+)?)\s+Tf"
    swapped = F.regexp_replace(da, pattern, f"$1/{alias} $2 Tf")
    return F.when(F.coalesce(da.rlike(pattern), F.lit(False)), swapped).otherwise(fresh)


def soft_unwrap(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), wide_trim)
    return F.array_join(F.filter(lines, lambda line: line != ""), " ")


def tokenise(text: Column) -> Column:
    """Draw tokens: white space, joined digit groups, digits, punctuation, the rest."""
    return F.regexp_extract_all(text, F.lit(DRAW_TOKEN), 0)


def wrap_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WRAP_PATTERN), 0)


def space_count_for_gap(gap: Column, em: Column) -> Column:
    return F.greatest(F.lit(1), js_round(gap / (em * SPACE_EM))).cast("int")


def indent_count(gap: Column, em: Column) -> Column:
    return F.when(gap > 0, F.greatest(F.lit(0), js_round(gap / (em * SPACE_EM)))).otherwise(0).cast("int")


def text_width_estimate(text: Column, em: Column) -> Column:
    return F.length(text) * em * CHAR_EM


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and hand it to `body`, so that long expressions are not repeated."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def justify_rtl_line(text: Column, width: Column, height: Column) -> Column:
    """Spread the missing width over the gaps of a line as extra spaces, first gaps first."""
    gap_pattern = rf"[{SPACE_CLASS}]+"

    def measure(trimmed: Column) -> Column:
        missing = width - text_width_estimate(trimmed, height)
        return F.struct(
            trimmed.alias("text"),
            F.regexp_extract_all(trimmed, F.lit(gap_pattern), 0).alias("gaps"),
            missing.alias("missing"),
            F.greatest(F.lit(0), js_round(missing / (height * SPACE_EM))).cast("int").alias("extra"),
        )

    def spread(m: Column) -> Column:
        count = F.size(m["gaps"])
        wide_gaps = F.transform(
            m["gaps"],
            lambda gap, i: F.concat(
                gap,
                F.repeat(
                    F.lit(" "),
                    F.floor(m["extra"] / count).cast("int") + F.when(i < m["extra"] % count, 1).otherwise(0),
                ),
            ),
        )
        words = F.split(m["text"], gap_pattern)
        joined = F.array_join(F.zip_with(words, wide_gaps, lambda w, g: F.concat(w, F.coalesce(g, F.lit("")))), "")
        as_is = (count == 0) | (m["missing"] <= height * SPACE_EM) | (m["extra"] == 0)
        return F.when(as_is, m["text"]).otherwise(joined)

    return let(let(wide_trim(text), measure), spread)


def indent_lines(lines: Column, rtl: Column | None = None) -> Column:
    """Joined text of a block.

    `lines` is an array of struct(text, left, width, height, justify) in order.
    Left-to-right blocks pad later lines by their start offset; right-to-left
    blocks justify the marked lines. `rtl` is the direction of the block where it
    is known; otherwise the script of its first line, which may be only digits, decides.
    """
    first = lines[0]
    padded = F.transform(
        lines,
        lambda line, i: F.when(i == 0, line["text"]).otherwise(
            F.concat(F.repeat(F.lit(" "), indent_count(line["left"] - first["left"], line["height"])), line["text"])
        ),
    )
    justified = F.transform(
        lines,
        lambda line: F.when(line["justify"], justify_rtl_line(line["text"], line["width"], line["height"])).otherwise(
            line["text"]
        ),
    )
    turned = is_rtl_block_text(first["text"]) if rtl is None else rtl
    return F.array_join(F.when(turned, justified).otherwise(padded), "\n")


def indent_lines_for_editor(lines: Column) -> Column:
    """Right-to-left editing text: pad each line by its gap to the right-most edge."""
    base = F.array_max(F.transform(lines, lambda line: line["left"] + line["width"]))
    padded = F.transform(
        lines,
        lambda line: F.concat(
            F.repeat(F.lit(" "), indent_count(base - (line["left"] + line["width"]), line["height"])), line["text"]
        ),
    )
    return F.array_join(padded, "\n")


def annotation_id(source_key: Column, page_index: Column, index: Column, name: Column, kind: Column) -> Column:
    named = F.regexp_replace(name, rf"[{SPACE_CLASS}]+", "-")
    numbered = F.concat_ws("-", kind, index)
    suffix = F.when(F.coalesce(name, F.lit("")) != "", named).otherwise(numbered)
    return F.concat_ws(":", source_key, F.lit("source-annot"), page_index, index, suffix)
