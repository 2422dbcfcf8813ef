"""Geometry as Column expressions.

A rect is a struct (x, y, w, h) in PDF points, y up, (x, y) the lower left corner.
A box is a struct (llx, lly, urx, ury). A matrix is a struct (a, b, c, d, e, f)
with row vectors: P' = P x M. A quad is a struct (x1, y1 ... x4, y4).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EPS = 1e-6
SINGULAR = 1e-9
CONTAIN_SLACK = 0.001
INK_PAD = 1.0
HIGHLIGHT_EXTENT = (0.9, 0.4)
REDACTION_EXTENT = (1.0, 0.5)


class Parts(dict):
    """Named Columns of a struct that is not built yet.

    Chained steps pass Parts along, so an expression holds each component once;
    extracting fields from nested struct expressions would multiply its size.
    """

    def struct(self) -> Column:
        return F.struct(*[column.alias(name) for name, column in self.items()])


def _num(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def rect_parts(x, y, w, h) -> Parts:
    return Parts(x=_num(x), y=_num(y), w=_num(w), h=_num(h))


def box_parts(llx, lly, urx, ury) -> Parts:
    return Parts(llx=_num(llx), lly=_num(lly), urx=_num(urx), ury=_num(ury))


def matrix_parts(a, b, c, d, e, f) -> Parts:
    return Parts(zip("abcdef", map(_num, (a, b, c, d, e, f))))


def rect(x, y, w, h) -> Column:
    return rect_parts(x, y, w, h).struct()


def box(llx, lly, urx, ury) -> Column:
    return box_parts(llx, lly, urx, ury).struct()


def matrix(a, b, c, d, e, f) -> Column:
    return matrix_parts(a, b, c, d, e, f).struct()


def _box_rect(b) -> Parts:
    return rect_parts(b["llx"], b["lly"], b["urx"] - b["llx"], b["ury"] - b["lly"])


def _rect_box(r) -> Parts:
    return box_parts(r["x"], r["y"], r["x"] + r["w"], r["y"] + r["h"])


def box_rect(b: Column) -> Column:
    return _box_rect(b).struct()


def rect_box(r: Column) -> Column:
    return _rect_box(r).struct()


def js_round(value: Column) -> Column:
    """Round half up toward positive infinity, as JavaScript does."""
    return F.floor(value + 0.5)


def pdf_to_viewport(r: Column, scale: Column, view_h: Column) -> Column:
    """Place a y-up rect on a y-down pixel page."""
    return F.struct(
        (r["x"] * scale).alias("left"),
        (view_h - (r["y"] + r["h"]) * scale).alias("top"),
        (r["w"] * scale).alias("width"),
        (r["h"] * scale).alias("height"),
    )


def rect_array_to_viewport(arr: Column, scale: Column, view_h: Column) -> Column:
    """Same for a four number corner array."""
    return pdf_to_viewport(rect(arr[0], arr[1], arr[2] - arr[0], arr[3] - arr[1]), scale, view_h)


def _mat_mul(m, n) -> Parts:
    return matrix_parts(
        m["a"] * n["a"] + m["b"] * n["c"],
        m["a"] * n["b"] + m["b"] * n["d"],
        m["c"] * n["a"] + m["d"] * n["c"],
        m["c"] * n["b"] + m["d"] * n["d"],
        m["e"] * n["a"] + m["f"] * n["c"] + n["e"],
        m["e"] * n["b"] + m["f"] * n["d"] + n["f"],
    )


def _mat_apply(m, x: Column, y: Column) -> Parts:
    return Parts(x=m["a"] * x + m["c"] * y + m["e"], y=m["b"] * x + m["d"] * y + m["f"])


def _mat_inverse(m) -> tuple[Parts, Column]:
    """Parts of the inverse and whether it exists; parts are null where it does not."""
    raw = m["a"] * m["d"] - m["b"] * m["c"]
    regular = F.abs(raw) >= SINGULAR
    det = F.when(regular, raw)
    inverse = matrix_parts(
        m["d"] / det,
        -m["b"] / det,
        -m["c"] / det,
        m["a"] / det,
        (m["c"] * m["f"] - m["d"] * m["e"]) / det,
        (m["b"] * m["e"] - m["a"] * m["f"]) / det,
    )
    return inverse, F.coalesce(regular, F.lit(False))


def mat_mul(m: Column, n: Column) -> Column:
    """M x N: apply m first, then n."""
    return _mat_mul(m, n).struct()


def mat_apply(m: Column, x: Column, y: Column) -> Column:
    return _mat_apply(m, x, y).struct()


def mat_inverse(m: Column) -> Column:
    """Inverse matrix, null when the determinant is within 1e-9 of zero."""
    inverse, regular = _mat_inverse(m)
    return F.when(regular, inverse.struct())


def item_bounds(tx: Column, ty: Column, scale_y: Column, width: Column) -> Column:
    height = F.abs(scale_y)
    return F.struct(
        tx.alias("left"), (ty - height).alias("top"), width.alias("width"), height.alias("height")
    )


def _hull(points) -> Parts:
    xs, ys = [p["x"] for p in points], [p["y"] for p in points]
    return box_parts(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def transformed_aabb(bbox: Column, m: Column, ctm: Column) -> Column:
    """Page rect of a placed object; null when nothing would be visible.

    A null bbox is the unit square, a null matrix the identity.
    """
    unit = dict(llx=0.0, lly=0.0, urx=1.0, ury=1.0)
    identity = dict(a=1.0, b=0.0, c=0.0, d=1.0, e=0.0, f=0.0)
    b = {name: F.coalesce(bbox[name], F.lit(value)) for name, value in unit.items()}
    own = {name: F.coalesce(m[name], F.lit(value)) for name, value in identity.items()}
    chain = _mat_mul(own, ctm)
    corners = [_mat_apply(chain, b[x], b[y]) for x in ("llx", "urx") for y in ("lly", "ury")]
    placed = _box_rect(_hull(corners))
    hidden = (F.abs(ctm["a"]) < EPS) & (F.abs(ctm["d"]) < EPS)
    return F.when(~hidden & (placed["w"] >= EPS) & (placed["h"] >= EPS), placed.struct())


def glyph_aabb(tm: Column, x0: Column, x1: Column, font_size: Column) -> Column:
    """Rect of one glyph: advance wide, font size high, under the text matrix."""
    corners = [_mat_apply(tm, x, y) for x in (x0, x1) for y in (F.lit(0.0), font_size)]
    return _box_rect(_hull(corners)).struct()


def _ordered(arr: Column, lenient: bool) -> Parts:
    at = lambda i: F.get(arr, F.lit(i))
    pick = (lambda i: F.coalesce(at(i), F.lit(0.0))) if lenient else at
    return box_parts(
        F.least(pick(0), pick(2)), F.least(pick(1), pick(3)), F.greatest(pick(0), pick(2)), F.greatest(pick(1), pick(3))
    )


def normalise_box(arr: Column, lenient: bool = False) -> Column:
    """Four numbers in any corner order to a box; fewer than four give null.

    `lenient` reads a missing number inside the first four as 0.
    """
    return F.when(F.size(arr) >= 4, _ordered(arr, lenient).struct())


def normalise_rect(arr: Column, min_side: float = 0.0, lenient: bool = False) -> Column:
    """As normalise_box, then null unless both sides are longer than min_side."""
    r = _box_rect(_ordered(arr, lenient))
    return F.when((F.size(arr) >= 4) & (r["w"] > min_side) & (r["h"] > min_side), r.struct())


def expand_rect(r: Column, pad: Column) -> Column:
    grown = rect(r["x"] - pad, r["y"] - pad, r["w"] + pad * 2, r["h"] + pad * 2)
    return F.when(pad > EPS, grown).otherwise(r)


def rect_to_quad(r: Column) -> Column:
    """Corner order top left, top right, bottom left, bottom right."""
    left, right, low, high = r["x"], r["x"] + r["w"], r["y"], r["y"] + r["h"]
    corners = ((left, high), (right, high), (left, low), (right, low))
    fields = []
    for i, (x, y) in enumerate(corners, start=1):
        fields += [x.alias(f"x{i}"), y.alias(f"y{i}")]
    return F.struct(*fields)


def _quad_box(q) -> Parts:
    xs, ys = [q[f"x{i}"] for i in range(1, 5)], [q[f"y{i}"] for i in range(1, 5)]
    return box_parts(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def quad_box(q: Column) -> Column:
    return _quad_box(q).struct()


def quad_rect(q: Column) -> Column:
    r = _box_rect(_quad_box(q))
    return F.when((r["w"] > EPS) & (r["h"] > EPS), r.struct())


def box_of_rects(rects: Column) -> Column:
    """Union box of an array of rects, null when the array is empty."""
    union = box(
        F.array_min(F.transform(rects, lambda r: r["x"])),
        F.array_min(F.transform(rects, lambda r: r["y"])),
        F.array_max(F.transform(rects, lambda r: r["x"] + r["w"])),
        F.array_max(F.transform(rects, lambda r: r["y"] + r["h"])),
    )
    return F.when(F.size(rects) > 0, union)


def box_of_strokes(strokes: Column, pad: Column) -> Column:
    """Padded box of an array of point arrays, null when there is no point."""
    points = F.flatten(strokes)
    xs = F.transform(points, lambda p: p["x"])
    ys = F.transform(points, lambda p: p["y"])
    union = box(F.array_min(xs) - pad, F.array_min(ys) - pad, F.array_max(xs) + pad, F.array_max(ys) + pad)
    return F.when(F.size(points) > 0, union)


def rects_overlap(r: Column, s: Column) -> Column:
    """Strict: rects that only share an edge do not overlap."""
    return (
        (r["x"] < s["x"] + s["w"])
        & (r["x"] + r["w"] > s["x"])
        & (r["y"] < s["y"] + s["h"])
        & (r["y"] + r["h"] > s["y"])
    )


def rect_contains(outer: Column, inner: Column, slack: float = CONTAIN_SLACK) -> Column:
    return (
        (outer["x"] <= inner["x"] + slack)
        & (outer["y"] <= inner["y"] + slack)
        & (outer["x"] + outer["w"] >= inner["x"] + inner["w"] - slack)
        & (outer["y"] + outer["h"] >= inner["y"] + inner["h"] - slack)
    )


def line_markup_box(left, width, baseline_y, height, scale, view_h, extent) -> Column:
    """Markup box over one text line, measured from its baseline."""
    above, below = extent
    return box(
        left / scale,
        (view_h - (baseline_y + height * below)) / scale,
        (left + width) / scale,
        (view_h - (baseline_y - height * above)) / scale,
    )


def annotation_bbox(kind: Column, quads: Column, r: Column, strokes: Column) -> Column:
    """Box of a highlight, comment or ink annotation; ink without points is all zero."""
    boxes = F.transform(quads, quad_box)
    union = box(
        F.array_min(F.transform(boxes, lambda b: b["llx"])),
        F.array_min(F.transform(boxes, lambda b: b["lly"])),
        F.array_max(F.transform(boxes, lambda b: b["urx"])),
        F.array_max(F.transform(boxes, lambda b: b["ury"])),
    )
    ink = F.coalesce(box_of_strokes(strokes, F.lit(INK_PAD)), box(0, 0, 0, 0))
    return F.when(kind == "highlight", union).when(kind == "comment", rect_box(r)).otherwise(ink)


def redaction_pixel_bounds(r: Column, ctm: Column, width: Column, height: Column) -> Column:
    """Pixel window of an image under a redaction rect, null when they do not meet."""
    inverse, regular = _mat_inverse(ctm)
    x2, y2 = r["x"] + r["w"], r["y"] + r["h"]
    hull = _hull([_mat_apply(inverse, x, y) for x in (r["x"], x2) for y in (r["y"], y2)])

    def clamp(v: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))

    u0, u1, v0, v1 = clamp(hull["llx"]), clamp(hull["urx"]), clamp(hull["lly"]), clamp(hull["ury"])
    window = F.struct(
        F.greatest(F.lit(0), F.floor(u0 * width).cast("int")).alias("x0"),
        F.greatest(F.lit(0), F.floor((1 - v1) * height).cast("int")).alias("y0"),
        F.least(width.cast("int"), F.ceil(u1 * width).cast("int")).alias("x1"),
        F.least(height.cast("int"), F.ceil((1 - v0) * height).cast("int")).alias("y1"),
    )
    return F.when(regular & (u1 > u0) & (v1 > v0), window)


def image_move_matrix(r: Column, dx, dy, dw, dh, scale) -> Column:
    """Matrix that moves and resizes a placed image by pixel deltas."""
    dx, dy, dw, dh = (F.coalesce(v, F.lit(0.0)) for v in (dx, dy, dw, dh))
    sx = F.when(r["w"] > EPS, (r["w"] + dw / scale) / r["w"]).otherwise(F.lit(1.0))
    sy = F.when(r["h"] > EPS, (r["h"] + dh / scale) / r["h"]).otherwise(F.lit(1.0))
    return matrix(sx, 0, 0, sy, r["x"] + dx / scale - r["x"] * sx, r["y"] - dy / scale - r["y"] * sy)
