"""Explicit types of the layout tables. Coordinates are PDF points, y up, unless a column says view."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


RECT = _struct(x=D, y=D, w=D, h=D)
BOX = _struct(llx=D, lly=D, urx=D, ury=D)
MATRIX = _struct(a=D, b=D, c=D, d=D, e=D, f=D)
POINT = _struct(x=D, y=D)
QUAD = _struct(**{f"{axis}{i}": D for i in range(1, 5) for axis in "xy"})
SPAN = _struct(gid=I, x0=D, x1=D)
CARET = _struct(offset=I, x=D)
STYLE = _struct(
    font_family=S, font_size=D, bold=B, italic=B, underline=B, strikethrough=B, dir=S, color=T.ArrayType(D)
)
RICH_SPAN = _struct(text=S, style=STYLE)

TABLES: dict[str, T.StructType] = {
    "pages": _struct(
        source_key=S, page_index=I, scale=D, pdf_width=D, pdf_height=D, view_width=D, view_height=D
    ),
    "items": _struct(
        source_key=S,
        page_index=I,
        index=I,
        str=S,
        x=D,
        y=D,
        width=D,
        height=D,
        gap_left=D,
        gap_right=D,
        op_indices=T.ArrayType(I),
    ),
    "runs": _struct(
        source_key=S,
        page_index=I,
        run_id=S,
        text=S,
        item_ids=T.ArrayType(I),
        op_indices=T.ArrayType(I),
        carets=T.ArrayType(CARET),
        left=D,
        top=D,
        width=D,
        box_height=D,
        height=D,
        baseline_y=D,
        font_family=S,
        base_font=S,
        bold=B,
        italic=B,
        underline=B,
        strikethrough=B,
    ),
    "shows": _struct(
        source_key=S,
        page_index=I,
        op_index=I,
        x=D,
        y=D,
        base_font=S,
        bold=B,
        italic=B,
        font_resource=S,
        bytes=T.BinaryType(),
        spans=T.ArrayType(SPAN),
    ),
    "cmap": _struct(source_key=S, page_index=I, font=S, cid=I, cp=I, encoding=S),
    "font_widths": _struct(source_key=S, font=S, gid=I, width=D, default_width=D, bytes_per_glyph=I),
    "ops": _struct(
        source_key=S,
        page_index=I,
        op_index=L,
        op=S,
        nums=T.ArrayType(D),
        name=S,
        segments=T.ArrayType(_struct(bytes=T.BinaryType(), spacer=D)),
    ),
    "images": _struct(
        source_key=S,
        page_index=I,
        image_id=S,
        name=S,
        subtype=S,
        do_index=L,
        q_index=L,
        cm_index=L,
        ctm=MATRIX,
        rect=RECT,
    ),
    "shapes": _struct(source_key=S, page_index=I, shape_id=S, q_index=L, end_index=L, rect=RECT),
    "annotations": _struct(
        source_key=S,
        page_index=I,
        id=S,
        kind=S,
        quads=T.ArrayType(QUAD),
        strokes=T.ArrayType(T.ArrayType(POINT)),
        rect=RECT,
        color=T.ArrayType(D),
        text=S,
        font_size=D,
        thickness=D,
    ),
    "redactions": _struct(id=S, source_key=S, page_index=I, rect=RECT),
    "fields": _struct(
        source_key=S,
        node_id=S,
        full_name=S,
        kind=S,
        value=S,
        checked=B,
        chosen=T.ArrayType(S),
        read_only=B,
        required=B,
    ),
    "widgets": _struct(source_key=S, field_id=S, node_id=S, page_index=I, rect=RECT),
    "slots": _struct(doc=S, slot_id=S, pos=L, kind=S, source_key=S, source_page_index=I, w=D, h=D),
    "edit_log": _struct(doc=S, seq=L, ts=T.TimestampType(), action=S, slot_id=S, id=S, payload=S),
}
