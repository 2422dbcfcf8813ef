"""Form fields: flattening, values, options, filling, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe.functions.script import is_rtl_script
from pageframe.operators.graph import inherit, scrub_tree, terminal_fields, top_ancestor
from pageframe.operators.grid import overlap_join

# Field flag bits, counted from 1, and the off state.
BITS = {"read_only": 1, "required": 2, "multiline": 13, "password": 14, "radio": 16, "push": 17, "combo": 18, "file_select": 21,
        "multi_select": 22}
OFF, DEFAULT_ON = "Off", "Yes"
FILL_TYPE = {"text": "Tx", "checkbox": "Btn", "radio": "Btn", "choice": "Ch"}


def flag(flags: Column, name: str) -> Column:
    return F.coalesce(flags, F.lit(0)).bitwiseAND(1 << (BITS[name] - 1)) != 0


def flatten_fields(nodes: DataFrame) -> DataFrame:
    """One row per fillable or signature field with kind, flags and inherited type and value."""
    keys = ["source_key", "node_id"]
    inherited = inherit(nodes, ["ft", "ff", "v"]).select(*keys, "ft", "ff", "v")
    fields = terminal_fields(nodes).select(*keys, "full_name").join(inherited, keys)
    ff = F.col("ff")
    kind = (
        F.when(F.col("ft") == "Tx", "text")
        .when((F.col("ft") == "Btn") & flag(ff, "push"), None)
        .when((F.col("ft") == "Btn") & flag(ff, "radio"), "radio")
        .when(F.col("ft") == "Btn", "checkbox")
        .when(F.col("ft") == "Ch", "choice")
        .when(F.col("ft") == "Sig", "signature")
    )
    typed = fields.withColumn("kind", kind).where(F.col("kind").isNotNull())
    return typed.select(
        *keys, "full_name", "kind", "v", flag(ff, "read_only").alias("read_only"), flag(ff, "required").alias("required"),
        *[F.when(F.col("kind") == k, flag(ff, n)).alias(n) for k, n in (
            ("text", "multiline"), ("text", "password"), ("text", "file_select"), ("choice", "combo"), ("choice", "multi_select"))],
    )


def field_values(kind: Column, v: Column, many: Column | None = None) -> Column:
    """Value by kind: text, checked (anything but Off), chosen radio state, chosen choices."""
    chosen = F.when(v.isNotNull(), F.array(v)).otherwise(F.array().cast("array<string>"))
    chosen = chosen if many is None else F.coalesce(many, chosen)
    state = F.coalesce(v, F.lit(OFF))
    return F.struct(
        F.when(kind == "text", F.coalesce(v, F.lit(""))).alias("text"),
        F.when(kind == "checkbox", state != OFF).alias("checked"),
        F.when((kind == "radio") & (state != OFF), v).alias("radio"),
        F.when(kind == "choice", chosen).alias("chosen"),
    )


def choice_options(rows: DataFrame, keys: list[str], options: str = "options") -> DataFrame:
    """Options of choice fields: arrays of one text (value and label) or of value and label."""
    pos = rows.select(*keys, F.posexplode(options).alias("position", "entry"))
    value = F.get("entry", F.lit(0))
    label = F.when(F.size("entry") == 1, value).otherwise(F.coalesce(F.nullif(F.get("entry", F.lit(1)), F.lit("")), value))
    return pos.where(F.size("entry") >= 1).select(*keys, "position", value.alias("value"), label.alias("label"))


def on_state(states: Column) -> Column:
    """First appearance state that is set and not Off."""
    return F.get(F.filter(states, lambda s: (s != "") & (s != OFF)), F.lit(0))


def radio_options(widgets: DataFrame) -> DataFrame:
    """Widgets of a radio group that have an on-state."""
    return widgets.withColumn("on_state", on_state(F.col("states"))).where(F.col("on_state").isNotNull())


def checkbox_on_state(states: Column) -> Column:
    return F.coalesce(on_state(states), F.lit(DEFAULT_ON))


def widget_pages(widgets: DataFrame, page_annots: DataFrame) -> DataFrame:
    """Page of each widget by the annotation lists of the pages, -1 when no page lists it."""
    keys = ["source_key", "node_id"]
    listed = page_annots.groupBy(*keys).agg(F.max("page_index").alias("page_index"))
    return widgets.drop("page_index").join(listed, keys, "left").withColumn("page_index", F.coalesce("page_index", F.lit(-1)))


def match_form_fills(fills: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fills joined to fields of that name and a fitting type, and the fills that fit nowhere."""
    wanted = F.create_map(*[F.lit(x) for pair in FILL_TYPE.items() for x in pair])
    typed = fills.withColumn("_ft", wanted[F.col("kind")])
    targets = fields.select("source_key", "full_name", "node_id", F.col("ft").alias("_ft"))
    keys = ["source_key", "full_name", "_ft"]
    return typed.join(targets, keys).drop("_ft"), typed.join(targets, keys, "left_anti").drop("_ft")


def apply_fills(fills: DataFrame) -> DataFrame:
    """New field entries for matched fills.

    Fills carry kind, text, checked, chosen, on_state, options (choice values).
    Text: value and quadding 2 for right-to-left; checkbox and radio: state name;
    choice: null, one or many values and the indices of chosen options.
    """
    kind, chosen = F.col("kind"), F.col("chosen")
    state = F.when(F.col("checked"), F.coalesce("on_state", F.lit(DEFAULT_ON))).otherwise(OFF)
    radio = F.coalesce(F.get(chosen, F.lit(0)), F.lit(OFF))
    v = F.when(kind == "text", F.col("text")).when(kind == "checkbox", state).when(kind == "radio", radio).when(
        (kind == "choice") & (F.size(chosen) > 0), F.array_join(chosen, "\n"))
    positions = F.when(F.size("options") > 0, F.sequence(F.lit(0), F.size("options") - 1)).otherwise(F.array().cast("array<int>"))
    indices = F.filter(positions, lambda i: F.array_contains(chosen, F.get("options", i)))
    return fills.withColumn("v", v).withColumn("q", F.when(kind == "text", F.when(is_rtl_script(F.col("text")), 2).otherwise(0))).withColumn(
        "indices", F.when((kind == "choice") & (F.size(indices) > 0), indices)).withColumn("drop_appearance", kind == "choice")


def widget_states(widgets: DataFrame, filled: DataFrame) -> DataFrame:
    """Appearance state of each widget of a filled button: radio lights only the widget that is chosen."""
    joined = widgets.join(filled.select("source_key", F.col("node_id").alias("field_id"), "kind", "v"), ["source_key", "field_id"])
    shown = F.when(F.col("kind") == "checkbox", F.col("v")).when(on_state(F.col("states")) == F.col("v"), F.col("v")).otherwise(OFF)
    return joined.where(F.col("kind").isin("checkbox", "radio")).withColumn("as", shown)


def redact_fields(nodes: DataFrame, rects: DataFrame, rect_col: str = "red") -> DataFrame:
    """Form nodes after redaction: one touched widget removes its whole top field.

    Nodes carry rect for widgets. Comes back with removed (widgets and top nodes
    that go) and scrubbed (values cleared) flags.
    """
    widgets = nodes.where(F.col("is_widget") & F.col("rect").isNotNull())
    hit = overlap_join(widgets.select("source_key", "page_index", "node_id", "rect"), rects.select("source_key", "page_index", rect_col),
                       "rect", rect_col).select("source_key", "node_id").distinct()
    keys = ["source_key", "node_id"]
    tops = top_ancestor(nodes)
    gone = tops.join(hit, keys, "left_semi").select("source_key", F.col("top").alias("node_id")).distinct()
    cleared = scrub_tree(nodes, gone)
    is_top = gone.withColumn("_top", F.lit(True))
    flagged = cleared.join(is_top, keys, "left")
    return flagged.withColumn("removed", F.col("scrubbed") & (F.col("is_widget") | F.coalesce("_top", F.lit(False)))).drop("_top")
