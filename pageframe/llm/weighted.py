"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A term of weight w gets, for each sample, r and c from Gamma(2, 1) and b from [0, 1):
with t = floor(ln w / r + b) its value is ln c - r (t + 1 - b), and the term with the
least value is the sample. Two documents share a sample with a probability equal to
the generalised Jaccard similarity of their weights. The least value itself names
the sample, as values of different terms, weights or samples do not meet.

Terms are words, known by their 64-bit hash; r, c and b come from that hash by native expressions, so no two
words share them and no table of words is kept. Samples are computed LANES at a time, a row for each such group.
Texts are shuffled once, by blocks of document ids; their words and weights stay there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageframe.llm.store import written

SAMPLES = 64
LANES = 8
BLOCK = 64
NO_ID = -(1 << 63)


def _uniform(bits: Column, width: int) -> Column:
    """In (0, 1), from a number of `width` bits."""
    return (bits.cast("double") + 0.5) * (2.0**-width)


def _exponents(hashed: Column) -> Column:
    """A Gamma(2, 1) value: minus the log of two uniforms, from the halves of a hash."""
    return -F.log(_uniform(F.shiftrightunsigned(hashed, 32), 32) * _uniform(hashed.bitwiseAND(F.lit(0xFFFFFFFF)), 32))


def _value(lane: int) -> Column:
    """The value of a term of log weight `_lnw` for sample `lane` of the group `_group`."""
    r, c = (_exponents(F.xxhash64("_term", "_group", F.lit(3 * lane + i))) for i in (0, 1))
    b = _uniform(F.shiftrightunsigned(F.xxhash64("_term", "_group", F.lit(3 * lane + 2)), 11), 53)
    return F.log(c) - r * (F.floor(F.col("_lnw") / r + b) + 1.0 - b)


def with_next(rows: DataFrame, source: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Add `value` of the next row along `order` within `_block`, of the first row of the next block at its end, of the very first after the last.

    `rows` are clustered by `_block`; `source` holds the same rows before their shuffle, so that the first of each block
    are taken where they lie. Only these cross blocks. Blocks meet in super-blocks of 4096, and one row for each of those
    in the last step.
    """
    inner = Window.partitionBy("_block").orderBy(*order)
    marked = rows.withColumn("_there", F.lead(F.struct(value)).over(inner))
    firsts = source.groupBy("_block").agg(F.min_by(F.struct(value), F.struct(*order)).alias("_first"))
    blocks = firsts.select("_block", F.floor(F.col("_block") / 4096).alias("_super"))
    near = blocks.withColumn("_after", F.lead("_block").over(Window.partitionBy("_super").orderBy("_block")))
    heads = blocks.groupBy("_super").agg(F.min("_block").alias("_head"))
    heads = heads.select("_super", F.lead("_head").over(Window.orderBy("_super")).alias("_far"), F.min("_head").over(Window.partitionBy()).alias("_top"))
    after = near.join(heads, "_super").select(F.coalesce("_after", "_far", "_top").alias("_next"), F.col("_block"))
    carried = after.join(firsts.select(F.col("_block").alias("_next"), "_first"), "_next").select("_block", "_first")
    joined = marked.join(written(carried, "heads"), "_block", "left")
    return joined.select(*rows.columns, F.coalesce("_there", "_first")[value].alias(name))


def _words(text: Column) -> Column:
    return F.split(F.lower(text), r"\s+")


def fingerprints(docs: DataFrame, text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), as the query of the operator has it.

    The edited text is the text with its last half replaced by as many first characters of the next document along
    doc_id, or all of them; the last document takes the first. A null text counts as empty. Texts without words share
    one fingerprint, of which the likeness to another is 1, and to any other 0. Repeated rows follow each other in the
    order of their texts; rows without doc_id come first (the least long stands for none). Very long texts count whole. Other columns are ignored, and an
    empty table stays empty.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_key"), content.alias("_text"))
    rows = rows.withColumn("_block", F.floor(F.col("_key") / BLOCK)).withColumn("_tag", F.xxhash64("_text"))
    spread = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["_key", "_tag"]
    placed = with_next(rows.repartition(spread, "_block"), rows, order, "_text", "_follow")
    placed = placed.withColumn("_turn", F.row_number().over(Window.partitionBy("_block").orderBy(*order)))
    half = "cast(floor(length(_text) / 2) AS int)"
    edited = F.concat(F.expr(f"substring(_text, 1, length(_text) - {half})"), F.expr(f"substring(_follow, 1, {half})"))
    placed = placed.withColumn("_edited", edited)
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("_text").alias("body")), F.struct(F.lit(1).alias("side"), F.col("_edited").alias("body")))
    bodies = placed.select("_block", "_turn", F.explode(sides).alias("_s"))
    bodies = bodies.select("_block", (F.col("_turn").cast("long") * 2 + F.col("_s.side")).alias("_at"), F.explode(_words(F.col("_s.body"))).alias("_word"))
    terms = bodies.where("_word <> ''").select("_block", "_at", F.xxhash64("_word").alias("_term"))
    weights = terms.groupBy("_block", "_at", "_term").agg(F.log(F.count(F.lit(1)).cast("double")).alias("_lnw"))
    groups = F.array(*[F.lit(g) for g in range(-(-samples // LANES))])
    valued = weights.select("_block", "_at", "_term", "_lnw", F.explode(groups).alias("_group"))
    least = valued.groupBy("_block", "_at", "_group").agg(*[F.min(_value(k)).alias(f"m{k}") for k in range(LANES)])
    digits = [F.lpad(F.lower(F.hex(F.shiftrightunsigned(F.xxhash64(f"m{k}"), 48))), 4, "0") for k in range(LANES)]
    pieces = F.array_sort(F.collect_list(F.struct("_group", F.concat(*digits).alias("digits"))))
    whole = least.groupBy("_block", "_at").agg(F.substring(F.array_join(pieces["digits"], ""), 1, 4 * samples).alias("_print"))
    prints = whole.select("_block", F.expr("_at div 2").cast("int").alias("_turn"), F.pmod("_at", F.lit(2)).alias("_side"), "_print")
    texts = placed.select("_block", "_turn", "_key", F.length("_text").cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"))
    parts = written(prints.unionByName(texts, allowMissingColumns=True), "prints")  # both read the one shuffle of the texts

    def side(which: int, name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("_side") == which, F.col("_print"))), F.lit("0" * 4 * samples)).alias(name)

    pairs = parts.repartition("_block").groupBy("_block", "_turn").agg(
        F.max("_key").alias("_key"),
        F.max("n_chars").alias("n_chars"),
        F.max("edited_sha256").alias("edited_sha256"),
        side(0, "fingerprint"),
        side(1, "edited_fingerprint"),
    )
    both = written(pairs, "signatures")
    linked = with_next(both.repartition("_block"), both, ["_turn"], "fingerprint", "_next_print")

    def likeness(a: str, b: str) -> Column:
        places = F.array(*[F.lit(4 * k + 1) for k in range(samples)])
        same = F.filter(places, lambda at: F.col(a).substr(at, F.lit(4)) == F.col(b).substr(at, F.lit(4)))
        return F.size(same) / F.lit(float(samples))

    return linked.select(
        F.nullif("_key", F.lit(NO_ID)).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "_next_print").alias("near_next"),
    )
