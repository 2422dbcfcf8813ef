"""Text runs to paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageframe.functions.script import has_list_marker, is_rtl_block_text
from pageframe.functions.text import indent_lines, let

PAGE = ["source_key", "page_index"]

# Paragraph thresholds as shares of line height.
SAME_SIZE, SAME_ROW, DISTINCT_SHARE = 0.2, 0.35, 0.8
STEP_RANGE, INDENT, LIST_INDENT = (0.65, 1.8), 1.25, 8.0
JUSTIFY_SLACK = 0.75
ROW_UNIT = 1.000001


def _with_cells(runs: DataFrame) -> DataFrame:
    """Runs with `_cell`: another run stands beside them in their row (table cells).

    A window over the baselines of a page, in units of a little more than the page's tallest reach, holds all a run can
    share its row with; the exact test follows.
    """
    page = Window.partitionBy(*PAGE)
    tall = F.greatest(F.col("box_height"), F.col("height"))
    kept = runs.columns
    placed = runs.withColumn("_tall", tall).withColumn("_unit", F.col("baseline_y") / (F.max("_tall").over(page) * (SAME_ROW * ROW_UNIT)))
    slim = F.struct("run_id", "left", "width", "baseline_y", "_tall")
    near = F.collect_list(slim).over(page.orderBy("_unit").rangeBetween(-1, 1))

    def beside(o: Column) -> Column:
        shared = F.least(F.col("left") + F.col("width"), o["left"] + o["width"]) - F.greatest(F.col("left"), o["left"])
        return (
            (F.col("run_id") != o["run_id"])
            & (F.abs(F.col("baseline_y") - o["baseline_y"]) <= F.greatest(F.col("_tall"), o["_tall"]) * SAME_ROW)
            & (shared < F.least(F.col("width"), o["width"]) * DISTINCT_SHARE)
        )

    found = placed.withColumn("_near", near)
    return found.select(*kept, F.coalesce(F.exists("_near", beside), F.lit(False)).alias("_cell"))


def same_row_neighbours(runs: DataFrame) -> DataFrame:
    """Runs that share their row with another run beside them (table cells)."""
    slim = runs.select(*PAGE, "run_id", "left", "width", "baseline_y", "box_height", "height")
    return _with_cells(slim).where("_cell").select(*PAGE, "run_id")


def _edge(line: Column, rtl: Column) -> Column:
    return F.when(rtl, line["left"] + line["width"]).otherwise(line["left"])


def group_paragraphs(runs: DataFrame) -> DataFrame:
    """Add block_no to runs; `run_no` is their order on the page.

    Tests against the previous line cut a page into chains; inside a chain a
    fold carries the first line of the open block for the tests that need it.
    All of it are windows and groups of a page, so the runs are dealt out once at
    most, made once and joined with nothing.
    """
    page = Window.partitionBy(*PAGE).orderBy("run_no")
    rows = _with_cells(runs).withColumn("_rtl", is_rtl_block_text(F.col("text"))).withColumn("_list", has_list_marker(F.col("text")))

    def style_differs(a: dict, b: dict) -> Column:
        tall = F.greatest(a["height"], b["height"])
        return (
            ~a["font_family"].eqNullSafe(b["font_family"]) | (a["bold"] != b["bold"]) | (a["italic"] != b["italic"])
            | (F.abs(a["height"] - b["height"]) > tall * SAME_SIZE)
        )

    names = ["font_family", "bold", "italic", "height"]
    now = {n: F.col(n) for n in names}
    was = {n: F.col(f"_p_{n}") for n in names}
    step = F.abs(F.col("baseline_y") - F.col("_p_base"))
    # The nominal height also counts the first line, so only its lower bound can be tested here.
    too_close = step < F.greatest("box_height", "_p_box") * STEP_RANGE[0]
    breaks = style_differs(was, now) | F.col("_cell") | F.col("_p_cell") | (F.col("_rtl") != F.col("_p_rtl")) | too_close
    previous = {f"_p_{n}": n for n in names} | {
        "_p_cell": "_cell", "_p_rtl": "_rtl", "_p_base": "baseline_y", "_p_box": "box_height"}
    near = F.lag(F.struct(*[F.col(old).alias(new) for new, old in previous.items()])).over(page)
    linked = rows.withColumn("_near", near).select("*", *[F.col("_near")[new].alias(new) for new in previous])
    opens = F.col("_near").isNull() | F.coalesce(breaks, F.lit(True))
    chained = linked.withColumn("_chain", F.sum(opens.cast("int")).over(page.rowsBetween(Window.unboundedPreceding, 0)))
    line = F.struct("run_no", "run_id", "left", "width", "box_height", "height", "baseline_y", F.col("_rtl").alias("rtl"),
                    F.col("_list").alias("is_list"), "font_family", "bold", "italic")
    others = [c for c in runs.columns if c not in PAGE]
    pair = F.struct("run_no", line.alias("line"), F.struct(*others).alias("run"))
    chains = chained.groupBy(*PAGE, "_chain").agg(F.sort_array(F.collect_list(pair)).alias("_pairs"))
    chains = chains.select(*PAGE, "_pairs", F.transform("_pairs", lambda x: x["line"]).alias("lines"))

    def fold(state: Column, next_line: Column) -> Column:
        first, prev = state["first"], state["prev"]
        gap = F.abs(next_line["baseline_y"] - prev["baseline_y"])
        nominal = F.greatest(first["box_height"], prev["box_height"], next_line["box_height"])
        indent = F.abs(_edge(next_line, first["rtl"]) - _edge(first, first["rtl"]))
        limit = nominal * F.when(first["is_list"], LIST_INDENT).otherwise(INDENT)
        joins = (
            ~style_differs({n: first[n] for n in names}, {n: next_line[n] for n in names})
            & (gap >= nominal * STEP_RANGE[0]) & (gap <= nominal * STEP_RANGE[1]) & (indent <= limit)
            & (first["rtl"] == next_line["rtl"])
        )
        head = F.when(joins, first).otherwise(next_line)
        return F.struct(head.alias("first"), next_line.alias("prev"), F.concat(state["heads"], F.array(head["run_no"])).alias("heads"))

    lines = F.col("lines")
    start = F.struct(F.get(lines, F.lit(0)).alias("first"), F.get(lines, F.lit(0)).alias("prev"),
                     F.array(F.get(lines, F.lit(0))["run_no"]).alias("heads"))
    heads = F.aggregate(F.slice(lines, 2, F.size(lines)), start, fold, lambda s: s["heads"])
    placed = F.arrays_zip(F.transform("_pairs", lambda x: x["run"]).alias("run"), heads.alias("block_head"))
    return chains.select(*PAGE, F.inline(placed)).select(*PAGE, *[F.col("run")[c].alias(c) for c in others], "block_head")


def median_step(baselines: Column) -> Column:
    """Upper median of the distances between neighbouring baselines, null under two lines."""
    count = F.size(baselines) - 1
    steps = F.transform(F.slice(baselines, 2, F.size(baselines)), lambda b, i: F.abs(b - F.get(baselines, i)))
    return F.when(count >= 1, F.get(F.array_sort(steps), F.floor(count / 2).cast("int")))


def justified_flags(lines: Column) -> Column:
    """Per line of a block whether it is set justified.

    `lines` is an array of struct(text, left, width, height) in order.
    """
    n = F.size(lines)
    first = F.get(lines, F.lit(0))

    def measure(skip: Column) -> Column:
        body = F.slice(lines, skip + 1, F.greatest(n - 1 - skip, F.lit(0)))
        return let(body, lambda b: F.struct(
            skip.alias("skip"), b.alias("body"), F.array_min(F.transform(b, lambda x: x["left"])).alias("left"),
            F.array_max(F.transform(b, lambda x: x["left"] + x["width"])).alias("right"),
            (F.array_max(F.transform(b, lambda x: x["height"])) * JUSTIFY_SLACK).alias("slack")))

    def judge(m: Column) -> Column:
        even = F.forall(m["body"], lambda x: (F.abs(x["left"] - m["left"]) <= m["slack"]) & (F.abs(x["left"] + x["width"] - m["right"]) <= m["slack"]))
        return F.struct(m["skip"].alias("skip"), ((F.size(m["body"]) >= 2) & even).alias("ltr"), is_rtl_block_text(first["text"]).alias("rtl"), n.alias("n"))

    # Each value is taken once for the block, not once for a line.
    flags = lambda j: F.transform(
        lines, lambda _, i: (j["n"] >= 3) & (i < j["n"] - 1) & F.when(j["rtl"], True).otherwise(j["ltr"] & (i >= j["skip"])))
    skip = F.when(has_list_marker(first["text"]) & (n - 1 > 2), 1).otherwise(0)
    return let(let(let(skip, measure), judge), flags)


def make_blocks(grouped: DataFrame) -> DataFrame:
    """Block rows from runs with block_head: union box, text, ids, decorations, layouts, style, alignment, step.

    The text of a paragraph is its lines joined by newlines: later lines of a left-to-right one are padded by their
    indent, justified ones of a right-to-left one are spread. A layout is the place of a line inside the box. Style
    (font_family, bold, italic, size) is that of the first line.
    """
    line = F.struct("run_no", "run_id", "text", "left", "width", "height", "top", "box_height", "baseline_y", "op_indices",
                    "underline", "strikethrough", "font_family", "bold", "italic")
    blocks = grouped.groupBy(*PAGE, "block_head").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    blocks = blocks.withColumn("justify", justified_flags(F.col("lines")))
    pick = lambda name: F.transform("lines", lambda x: x[name])
    right = F.array_max(F.transform("lines", lambda x: x["left"] + x["width"]))
    bottom = F.array_max(F.transform("lines", lambda x: x["top"] + x["box_height"]))
    left, top = F.array_min(pick("left")), F.array_min(pick("top"))
    many = F.size("lines") > 1
    first = F.get("lines", F.lit(0))
    placed = F.transform("lines", lambda x, i: F.struct(x["text"], x["left"], x["width"], x["height"], F.get("justify", i).alias("justify")))
    layout = lambda x, i: F.struct((x["left"] - left).alias("left"), (x["top"] - top).alias("top"), x["width"].alias("width"), F.get("justify", i).alias("justify"))
    number = F.col("block_no") - 1
    blocks = blocks.withColumn("block_no", F.row_number().over(Window.partitionBy(*PAGE).orderBy("block_head")))
    return blocks.select(
        *PAGE, "block_head",
        F.when(many, F.concat(F.lit("p"), F.col("page_index") + 1, F.lit("-b"), number)).otherwise(F.get("lines", F.lit(0))["run_id"]).alias("block_id"),
        many.alias("is_paragraph"), pick("run_id").alias("run_ids"), left.alias("left"), top.alias("top"),
        F.when(many, F.greatest(right - left, F.lit(4.0))).otherwise(right - left).alias("width"),
        (bottom - top).alias("height"), F.get("lines", F.lit(0))["baseline_y"].alias("baseline_y"),
        F.forall(pick("underline"), lambda u: F.coalesce(u, F.lit(False))).alias("underline"),
        F.forall(pick("strikethrough"), lambda u: F.coalesce(u, F.lit(False))).alias("strikethrough"),
        F.array_sort(F.array_distinct(F.flatten(pick("op_indices")))).alias("op_indices"),
        F.when(F.exists("justify", lambda j: j), "justify").otherwise("start").alias("text_align"),
        median_step(pick("baseline_y")).alias("line_step"), F.when(many, indent_lines(placed)).otherwise(first["text"]).alias("text"),
        F.when(many, F.transform("lines", layout)).alias("line_layouts"), first["font_family"].alias("font_family"), first["bold"].alias("bold"),
        first["italic"].alias("italic"), first["height"].alias("size"), "lines", "justify",
    )
