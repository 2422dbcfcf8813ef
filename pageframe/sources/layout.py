"""Layout sources and sinks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageframe.functions.geometry import js_round
from pageframe.schema import TABLES

# Admission limits, key prefixes, magic bytes.
MAX_FILE_BYTES = 150 * 1024 * 1024
MAX_PAGES = 250
PRIMARY_KEY = "primary"
BLANK_PREFIX = "__blank__:"
PNG_MAGIC, JPEG_MAGIC = "89504E47", "FFD8FF"
FILE_REASON = "{name} is {size}; this browser build currently supports PDFs up to {limit}."
PAGE_REASON = "{name} has {count} pages; this browser build currently supports up to {limit} pages at a time."
LONG_LINE = 1 << 20
PIECE_CHARS, BLOCK_CHARS = 1 << 10, 64


def read_layout(spark: SparkSession, path: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """Every layout table found under `path`, each with its declared schema."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    present = {status.getPath().getName() for status in files.listStatus(hadoop)}
    return {
        name: spark.read.schema(schema).format(fmt).load(f"{path}/{name}")
        for name, schema in TABLES.items()
        if name in present
    }


def write_result(tables: Mapping[str, DataFrame], path: str, partition: Column | None = None, buckets: int = 64) -> None:
    """Write each table under `path`, in folders of a bounded hash of source_key.

    One folder per source would mean one file per document; a fixed number of
    hash buckets keeps the file count bounded and still prunes by source. Token
    tables are many times larger than their text, so they are written with zstd.
    """
    for name, df in tables.items():
        bucket = partition if partition is not None else F.pmod(F.xxhash64("source_key"), F.lit(buckets))
        df.withColumn("source_bucket", bucket).write.mode("overwrite").option("compression", "zstd").partitionBy("source_bucket").parquet(
            f"{path}/{name}"
        )


def result_name(filename: Column) -> Column:
    return F.concat(F.regexp_replace(filename, r"(?i)\.pdf\z", ""), F.lit(".edited.pdf"))


def text_lines(df: DataFrame, text_col: str, lines_per_page: int = 50) -> DataFrame:
    """One row per line of text with its page; the other columns are kept."""
    kept = [c for c in df.columns if c != text_col]
    return df.select(*kept, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line")).withColumn(
        "page_index", F.floor(F.col("line_no") / lines_per_page).cast("int")
    )


def _cut(text: str, size: int) -> Column:
    """Pieces of about `size` characters that end after a space; text up to that size is one piece.

    The dot is a single test of a character, which a class like [\\s\\S] is not.
    """
    cut = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{size}}}[^ ]*+ ?"), 0)
    return F.when(F.length(text) <= size, F.array(text)).otherwise(cut)


def _starts(sizes: Column) -> Column:
    """Where each part begins, from the sizes of the parts."""
    zero = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("at"))
    step = lambda acc, n: F.struct(F.concat(acc["starts"], F.array(acc["at"])).alias("starts"), (acc["at"] + n).alias("at"))
    return F.aggregate(sizes, zero, step, lambda acc: acc["starts"])


def _token_offsets(lines: DataFrame, long_line: int) -> DataFrame:
    """Explode lines into tokens with their number and character offset.

    A line is cut into stretches of about `long_line` characters, these into pieces of PIECE_CHARS, these into blocks
    of BLOCK_CHARS and these into tokens. Each level knows what lies before a part from the sizes of its neighbours,
    in lists that stay short however long the line is, and a token looks back over its block alone. So lines are read
    once and nothing leaves its partition.
    """
    others = [F.col(c) for c in lines.columns if c != "line"]
    spaces = lambda b: F.length(b) - F.length(F.replace(b, F.lit(" "), F.lit("")))
    parts, chars, toks, part = lines, F.lit(0), F.lit(0), "line"
    for size in (long_line, PIECE_CHARS, BLOCK_CHARS):
        cut = parts.select(*others, chars.alias("_c"), toks.alias("_t"), _cut(part, size).alias("_parts"))
        some = lambda of: F.when(F.size("_parts") > 1, _starts(F.transform("_parts", of)))
        cut = cut.select("*", some(F.length).alias("_n"), some(spaces).alias("_s"))
        # An outer one is not asked beforehand whether it has rows, which would cut the text once more.
        parts = cut.select(*others, "_c", "_t", "_n", "_s", F.posexplode_outer("_parts").alias("_b", "_part"))
        before = lambda starts: F.when(F.col("_b") == 0, 0).otherwise(F.get(starts, F.col("_b")))
        chars, toks, part = F.col("_c") + before(F.col("_n")), F.col("_t") + before(F.col("_s")), "_part"
    blocks = parts.select(*others, chars.alias("_chars"), toks.alias("_toks"), "_part")
    tokens = blocks.select(*others, "_chars", "_toks", "_part", F.posexplode(F.split("_part", " ")).alias("_i", "str"))
    head = F.call_function("substring_index", F.col("_part"), F.lit(" "), F.col("_i"))
    inner = F.when(F.col("_i") == 0, 0).otherwise(F.length(head) + 1)
    return tokens.select(*others, (F.col("_toks") + F.col("_i")).alias("tok_no"), "str", (F.col("_chars") + inner).alias("offset"))


def line_items(
    lines: DataFrame, *, char_w=6, line_h=14, left=50, top=800, height=12, lines_per_page: int = 50,
    long_line: int = LONG_LINE,
) -> DataFrame:
    """Item rows from line rows (see text_layout)."""
    tokens = _token_offsets(lines, long_line).where(F.col("str") != "")
    row = F.col("line_no") % lines_per_page
    return tokens.select(
        "*",
        (row * 1_000_000 + F.col("tok_no")).cast("int").alias("index"),
        (F.lit(float(left)) + F.col("offset") * float(char_w)).alias("x"),
        (F.lit(float(top)) - row * float(line_h)).alias("y"),
        (F.length("str") * float(char_w)).alias("width"),
        F.lit(float(height)).alias("height"),
    )


def text_layout(df: DataFrame, text_col: str, **geometry) -> DataFrame:
    """Monospace item rows from plain text: one row per token that is not empty."""
    per_page = geometry.get("lines_per_page", 50)
    return line_items(text_lines(df, text_col, per_page), **geometry)


def format_megabytes(size: Column) -> Column:
    mib = size / (1024 * 1024)
    short = F.format_string("%.1f MB", mib)
    return (
        F.when(size.isNull() | (size <= 0), "0 MB")
        .when(mib < 10, short)
        .otherwise(F.concat(js_round(mib).cast("string"), F.lit(" MB")))
    )


def admit(
    files: DataFrame, max_bytes: int = MAX_FILE_BYTES, max_pages: int = MAX_PAGES
) -> tuple[DataFrame, DataFrame]:
    """Split files (name, length, page_count) into accepted and rejected with a reason."""
    name = F.when(F.coalesce(F.col("name"), F.lit("")) == "", "PDF").otherwise(F.col("name"))
    limit = format_megabytes(F.lit(max_bytes))

    def fill(template: str, **parts: Column) -> Column:
        pieces, rest = [], template
        while "{" in rest:
            head, _, rest = rest.partition("{")
            key, _, rest = rest.partition("}")
            pieces += [F.lit(head), parts[key].cast("string")]
        return F.concat(*pieces, F.lit(rest))

    reason = F.when(
        F.col("length") > max_bytes, fill(FILE_REASON, name=name, size=format_megabytes(F.col("length")), limit=limit)
    ).when(
        F.col("page_count") > max_pages,
        fill(PAGE_REASON, name=name, count=F.col("page_count"), limit=F.lit(max_pages)),
    )
    judged = files.withColumn("reason", reason)
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull())


def file_table(spark: SparkSession, path: str) -> DataFrame:
    """File names and sizes below a folder, without reading any content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length", "modificationTime")


def assign_source_key(files: DataFrame, session: str, order: str) -> DataFrame:
    """First file of a session is primary, later ones carry name, size and a base 36 counter.

    `order` counts the files of a session from 0 without gaps.
    """
    nonce = F.lower(F.conv(F.col(order).cast("string"), 10, 36))
    external = F.concat_ws(":", F.lit("ext"), F.col("name"), F.col("size"), nonce)
    return files.withColumn("source_key", F.when(F.col(order) == 0, PRIMARY_KEY).otherwise(external))


def sniff_image(content: Column) -> Column:
    """png or jpeg by magic bytes, null for anything else or under four bytes."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(F.length(content) < 4, None).when(head == PNG_MAGIC, "png").when(head.startswith(JPEG_MAGIC), "jpeg")


def sniff_stream(content: Column, filter_name: Column) -> Column:
    """Stream variant: a DCTDecode filter says jpeg whatever the bytes are."""
    return F.when(filter_name == "DCTDecode", "jpeg").otherwise(sniff_image(content))


def slots_from_source(pages: DataFrame, counter: Column | None = None) -> DataFrame:
    """One page slot per source page; slots of the primary source have stable ids."""
    number = counter if counter is not None else F.col("page_index") + 1
    external = F.concat_ws("-", F.lit("slot-page"), F.col("source_key"), F.col("page_index"), number)
    stable = F.concat(F.lit("slot-page-primary-"), F.col("page_index"))
    return pages.withColumn("slot_id", F.when(F.col("source_key") == PRIMARY_KEY, stable).otherwise(external)).withColumn(
        "kind", F.lit("page")
    )


def blank_source_key(slot_id: Column) -> Column:
    return F.concat(F.lit(BLANK_PREFIX), slot_id)


def is_blank_source_key(source_key: Column) -> Column:
    return source_key.startswith(BLANK_PREFIX)


def blank_slot_id(source_key: Column) -> Column:
    return F.substring(source_key, len(BLANK_PREFIX) + 1, 1 << 30)


def blank_slots(df: DataFrame, stamp: Column, counter: Column) -> DataFrame:
    """Blank slots with their size columns w and h and a synthetic source key."""
    slot_id = F.concat_ws("-", F.lit("slot-blank"), F.lower(F.conv(stamp.cast("string"), 10, 36)), counter)
    return df.withColumn("slot_id", slot_id).withColumn("kind", F.lit("blank")).withColumn(
        "source_key", blank_source_key(F.col("slot_id"))
    )
