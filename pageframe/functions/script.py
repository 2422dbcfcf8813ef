"""Script tests and right-to-left text rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code point classes. The right-to-left sets differ on purpose,
# each belongs to one rule. Patterns use \x{...} so that Java and RE2 read them alike.
RTL_RUN_CLASS = r"\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFE}\x{10800}-\x{10FFF}"
RTL_BLOCK_CLASS = r"\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFE}"
RTL_SCRIPT_CLASS = r"\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}\x{10800}-\x{10FFF}"
RTL_DISPLAY_CLASS = r"\x{0590}-\x{05FF}\x{0600}-\x{06FF}\x{0780}-\x{07BF}"
RTL_EDITOR_CLASS = r"\x{0590}-\x{08FF}"
RTL_DECODE_CLASS = r"\x{0590}-\x{08FF}\x{10800}-\x{10FFF}"
THAANA_CLASS = r"\x{0780}-\x{07BF}"
LTR_LETTER_CLASS = r"A-Za-z\x{00C0}-\x{02AF}\x{0370}-\x{03FF}\x{0400}-\x{04FF}"
MARK_CLASS = r"\x{07A6}-\x{07B0}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}"
SPACE_CLASS = (
    r"\t\n\x{000B}\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
CLOSING_PUNCT_CLASS = r"\p{Pc}\p{Pd}\p{Pe}\p{Pf}\p{Po}"
OPENING_PUNCT_CLASS = r"\p{Ps}\p{Pi}"

# Patterns.
LIST_MARKER = r"\A[0-9.()\[\]/-]+\z"
LIST_MARKER_BESIDE_LETTER = (
    rf"\A[{SPACE_CLASS}0-9.()\[\]/-]+[A-Za-z{THAANA_CLASS}]|[A-Za-z{THAANA_CLASS}][{SPACE_CLASS}0-9.()\[\]/-]+\z"
)
NUMBER_GROUP = r"[0-9]+(?:[/:][0-9]+)+"
TRIM_PATTERN = rf"\A[{SPACE_CLASS}]+|[{SPACE_CLASS}]+\z"
TRAILING_DOT = rf"\A([{SPACE_CLASS}]*)([0-9]+)([{SPACE_CLASS}]+)([\s\S]*?)([{SPACE_CLASS}]*)\.\z"
SECTION_MARKER = rf"\A([{SPACE_CLASS}]*)\.([0-9])([0-9])([{SPACE_CLASS}]+)"

# Default families.
DEFAULT_RTL_FONT = "Faruma"
DEFAULT_LATIN_FONT = "Arial"

# Latin key to Thaana character, brackets mirrored.
KEYS = "qwertyuiopasdfghjklzxcvbnmQWERTYUIOPASDFGHJKLZXCVBNM,;?<>[](){}"
THAANA = (
    "ްއެރތޔުިޮޕ"
    "ަސދފގހޖކލ"
    "ޒ×ޗވބނމ"
    "ޤޢޭޜޓޠޫީޯ÷"
    "ާށޑﷲޣޙޛޚޅ"
    "ޡޘޝޥޞޏޟ"
    "،؛؟><][)(}{"
)
BIDI_CONTROLS = "⁦⁧⁨⁩"


def has_class(text: Column, char_class: str) -> Column:
    return F.coalesce(text.rlike(f"[{char_class}]"), F.lit(False))


def _beyond_ascii(text: Column) -> Column:
    """Whether any character takes several bytes, which two lengths tell without a pattern."""
    return F.octet_length(text) != F.length(text)


def script_of(text: Column) -> Column:
    """rtl when any right-to-left character occurs, else ltr for any printable ASCII, else unknown."""
    starts_ltr = (text >= "\x21") & (text < "\x7f")
    return (
        F.when(_beyond_ascii(text) & has_class(text, RTL_SCRIPT_CLASS), "rtl")
        .when(starts_ltr | has_class(text, r"\x{0021}-\x{007E}"), "ltr")
        .otherwise("unknown")
    )


def is_rtl_script(text: Column) -> Column:
    return has_class(text, RTL_SCRIPT_CLASS)


def default_font_for_script(text: Column) -> Column:
    return F.when(is_rtl_script(text), DEFAULT_RTL_FONT).otherwise(DEFAULT_LATIN_FONT)


def is_mixed_script(text: Column) -> Column:
    """A right-to-left character together with a Latin, Greek or Cyrillic letter."""
    return has_class(text, RTL_SCRIPT_CLASS) & has_class(text, LTR_LETTER_CLASS)


def has_rtl_text(text: Column) -> Column:
    return has_class(text, RTL_EDITOR_CLASS)


def is_thaana_text(text: Column) -> Column:
    return has_class(text, THAANA_CLASS)


def is_rtl_run_text(text: Column) -> Column:
    return F.coalesce(_beyond_ascii(text), F.lit(False)) & has_class(text, RTL_RUN_CLASS)


def is_rtl_block_text(text: Column) -> Column:
    return has_class(text, RTL_BLOCK_CLASS)


def wide_trim(text: Column) -> Column:
    """Trim every kind of white space, not just U+0020."""
    return F.regexp_replace(text, TRIM_PATTERN, "")


def strip_bidi_controls(text: Column) -> Column:
    return F.translate(text, BIDI_CONTROLS, "")


def latin_to_thaana(text: Column) -> Column:
    return F.translate(text, KEYS, THAANA)


def is_list_marker(text: Column) -> Column:
    """Texts that begin with a Latin or Thaana letter are none, which is told without a pattern."""
    letter = ((text >= "A") & (text < "[")) | ((text >= "a") & (text < "{")) | ((text >= "\u0780") & (text < "\u07c0"))
    return F.coalesce(F.when(letter, F.lit(False)).otherwise(wide_trim(text).rlike(LIST_MARKER)), F.lit(False))


def has_list_marker(text: Column) -> Column:
    return F.coalesce(text.rlike(LIST_MARKER_BESIDE_LETTER), F.lit(False))


def drop_space_before_mark(text: Column) -> Column:
    return F.regexp_replace(text, rf"[{SPACE_CLASS}]+(?=[{MARK_CLASS}])", "")


def _reverse_group(group: Column) -> Column:
    """14/1/2026 for 2026/1/14; groups that mix both separators stay."""

    def flip(sep: str) -> Column:
        return F.array_join(F.reverse(F.split(group, sep)), sep)

    slash, colon = group.contains("/"), group.contains(":")
    return F.when(slash & colon, group).when(slash, flip("/")).otherwise(flip(":"))


def _tighten_numbers(line: Column) -> Column:
    return F.regexp_replace(line, rf"([/:])[{SPACE_CLASS}]+(?=[0-9])", "$1")


def _flip_numbers(line: Column) -> Column:
    groups = F.transform(F.regexp_extract_all(line, F.lit(NUMBER_GROUP), 0), _reverse_group)
    between = F.split(line, NUMBER_GROUP)
    return F.array_join(
        F.zip_with(between, groups, lambda gap, group: F.concat(gap, F.coalesce(group, F.lit("")))), ""
    )


def _tighten_punctuation(line: Column) -> Column:
    lead = rf"[0-9{RTL_DISPLAY_CLASS}]"
    opened = F.regexp_replace(line, rf"([{OPENING_PUNCT_CLASS}])[{SPACE_CLASS}]+(?={lead})", "$1")
    closed = F.regexp_replace(opened, rf"({lead})[{SPACE_CLASS}]+([{CLOSING_PUNCT_CLASS}])", "$1$2")
    return F.regexp_replace(closed, SECTION_MARKER, "$1$3-$2$4")


def _lead_with_dot(line: Column) -> Column:
    moved = F.regexp_replace(line, TRAILING_DOT, "$1.$2$3$4$5")
    return F.when(line.rlike(f"[{RTL_DISPLAY_CLASS}]"), moved).otherwise(line)


def normalise_rtl_line(text: Column, rtl: Column) -> Column:
    """Put number groups, punctuation gaps and list dots of right-to-left lines in reading order."""
    lines = F.split(text, "\n")
    for step in (_tighten_numbers, _flip_numbers, _tighten_punctuation, _lead_with_dot):
        lines = F.transform(lines, step)
    return F.when(rtl, F.array_join(lines, "\n")).otherwise(text)
