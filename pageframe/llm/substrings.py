"""Removal of byte strings that start at more than one place, by a sorted array of suffixes.

Sorting every suffix of a corpus moves many times its size, so the array holds only
the suffixes that can have a partner. The steps:

1. Anchors. Every window of `length` bytes picks the smallest of its `gram`-byte
   grams by hash (leftmost on ties). Equal windows pick the same gram, so a window
   can repeat only if its gram does. Neighbouring windows mostly share their gram:
   a stretch is a run of windows that picked the same gram.
2. Stretches whose gram occurs once go. Stretches with equal bytes are whole
   repeats; one of them stays as partner for other stretches with that gram.
3. What remains are suffixes that start with a shared gram. Sampled splitters
   range-partition them by these leading bytes. A bucket sorts the windows of its
   suffixes locally by multikey quicksort, one word of the key after the other, and
   compares neighbours. If a gram leads more than `hot` suffixes, its windows are
   range-partitioned one by one instead: by gram, place of the gram, digest and
   origin, so that even one string that fills the table spreads over buckets;
   strings at the two ends of a bucket are compared across boundaries.
4. Repeats go back to their documents, which drop the bytes they cover.

Windows are equal when the hash of their gram, its place in them and two 64-bit
digests of all their bytes are equal.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe.llm.store import sliced, written

LENGTH = 200
GRAM = 32
TILE = 1 << 18
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and their inverses."""
    if base not in _powers or len(_powers[base][0]) < size:
        inverse = pow(base, -1, 1 << 64)
        tables = []
        for factor in (base, inverse):
            line = np.full(size, factor, np.uint64)
            line[0] = 1
            tables.append(np.multiply.accumulate(line))
        _powers[base] = (tables[0], tables[1])
    return _powers[base]


def _prefix(data: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of a polynomial, one longer than the bytes."""
    power, _ = _tables(base, TILE + 4096)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=out[1:])
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def _digest(prefix: np.ndarray, base: int, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Hash of the bytes [start, start + size)."""
    _, inverse = _tables(base, TILE + 4096)
    return _mix((prefix[start + size] - prefix[start]) * inverse[start])


def _minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every `width` neighbours, by doubling."""
    reach = 1
    while reach * 2 <= width:
        keys = np.minimum(keys[:-reach], keys[reach:])
        reach *= 2
    return np.minimum(keys[: len(keys) - (width - reach)], keys[width - reach :]) if width > reach else keys


def tiles(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of at most `TILE` bytes: bytes, then for each part of a text its row, its place in the text and its place in the tile.

    Parts of one text overlap by length - 1 bytes, so each window lies in one part.
    """
    parts: list[tuple[int, int, bytes]] = []
    held = 0

    def out():
        data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
        at = np.cumsum([0, *(len(p) for _, _, p in parts)])
        return data, np.array([r for r, _, _ in parts]), np.array([o for _, o, _ in parts]), at

    for row, text in enumerate(texts):
        for begin in range(0, max(1, len(text) - length + 1), TILE - length):
            part = text[begin : begin + TILE - 1]
            if len(part) < length:
                continue
            if held + len(part) > TILE:
                yield out()
                parts, held = [], 0
            parts.append((row, begin, part))
            held += len(part)
    if parts:
        yield out()


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Stretches of windows with one gram: row, first window, windows, gram's place after it, hashes of gram and of all bytes."""
    found = []
    for data, row, begin, at in tiles(texts, length):
        first, second = _prefix(data, BASES[0]), _prefix(data, BASES[1])
        grams = _digest(second, BASES[1], np.arange(len(data) - gram + 1), gram)
        low = np.uint64((1 << 24) - 1)
        picked = (_minima((grams & ~low) | np.arange(len(grams), dtype=np.uint64), length - gram + 1) & low).astype(np.int64)
        part = np.repeat(np.arange(len(row)), np.diff(at))[: len(picked)]
        valid = np.arange(len(picked)) + length <= at[part + 1]
        place = np.flatnonzero(valid)
        starts = np.flatnonzero(np.r_[True, (np.diff(picked[place]) != 0) | (np.diff(part[place]) != 0)])
        begins = place[starts]
        count = np.diff(np.r_[starts, len(place)])
        owner = part[begins]
        found.append(
            (
                row[owner],
                begins - at[owner] + begin[owner],
                count,
                picked[begins] - begins,
                grams[picked[begins]].view(np.int64),
                (_digest(first, BASES[0], begins, count + length - 1) + count.astype(np.uint64)).view(np.int64),
            )
        )
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(x) for x in zip(*found))


def _pack(start: np.ndarray, count: np.ndarray, cut: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Place of a stretch in one long: first window, windows, gram's place, tag of the text."""
    return start << 32 | count << 24 | cut << 16 | tag


TAG = 0xFFFF


def _encoded(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _stretches(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, texts = batch.column(0).to_numpy(), _encoded(batch.column(1))
            row, start, count, cut, gram_hash, whole = anchors(texts, length, gram)
            tags = np.array([zlib.crc32(t) & TAG for t in texts], np.int64)
            columns = [ids[row], _pack(start, count, cut, tags[row]), gram_hash, whole]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "place", "gram", "whole"])

    return run


def _suffixes(length: int, gram: int):
    """Rows to sort: a stretch with its bytes under its gram, or each window of a hot gram under its whole key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out: tuple[list, list, list, list] = ([], [], [], [])
            for id_, text, parts in zip(batch.column(0).to_pylist(), _encoded(batch.column(1)), batch.column(2).to_pylist()):
                for part in parts:
                    place = part["place"]
                    start, count, cut = place >> 32, place >> 24 & 255, place >> 16 & 255
                    body = text[start : start + count + length - 1]
                    lead = body[cut : cut + gram]
                    if not part["hot"]:
                        rows = [(lead, place, body)]
                    else:
                        rows = []
                        for i in range(count):
                            digest = hashlib.blake2b(body[i : i + length], digest_size=16).digest()
                            at = (start + i).to_bytes(8, "big") + (id_ & (1 << 64) - 1).to_bytes(8, "big")
                            rows.append((lead + bytes([cut - i]) + digest + at, (start + i) << 32 | 1 << 24 | place & TAG, None))
                    for key, where, content in rows:
                        out[0].append(key), out[1].append(id_), out[2].append(where), out[3].append(content)
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary()]
            whole = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["lead", "id", "place", "body"])
            for i in range(0, whole.num_rows, 20_000):
                yield whole.slice(i, 20_000)

    return run


def multikey_order(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort: sort by the first word, then only the ties by the next. The order, and which rows equal the row before."""
    order = np.argsort(words[0])
    same = np.zeros(len(order), bool)
    if not len(order):
        return order, same
    same[1:] = np.diff(words[0][order]) == 0
    for word in words[1:]:
        tied = np.flatnonzero(same | np.r_[same[1:], False])
        if not len(tied):
            break
        group = np.cumsum(~same)[tied]
        rows = order[tied]
        order[tied] = rows[np.lexsort((word[rows], group))]
        same[1:] &= np.diff(word[order]) == 0
    return order, same


def _repeats(words: list[np.ndarray]) -> np.ndarray:
    order, same = multikey_order(words)
    found = np.zeros(len(order), bool)
    found[order] = same | np.r_[same[1:], False]
    return found


def _cold(lead: list[bytes], place: np.ndarray, body: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated windows of whole gram groups as (row, first window, windows)."""
    names = {x: i for i, x in enumerate(dict.fromkeys(lead))}
    group = np.array([names[x] for x in lead], np.int64)
    count, cut = place >> 24 & 255, place >> 16 & 255
    row = np.repeat(np.arange(len(place)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    digests: list[list[np.ndarray]] = [[], []]
    for data, part_row, _, at in tiles(body, length):
        in_tile = (row >= part_row[0]) & (row <= part_row[-1])
        begins = np.repeat(at[:-1], count[part_row]) + step[in_tile]
        for i in (0, 1):
            digests[i].append(_digest(_prefix(data, BASES[i]), BASES[i], begins, length))
    hit = np.flatnonzero(_repeats([group[row] << 8 | (cut[row] - step), *(np.concatenate(d) for d in digests)]))
    if not len(hit):
        return hit, hit, hit
    first = np.flatnonzero(np.r_[True, (np.diff(hit) != 1) | (np.diff(row[hit]) != 0)])
    begin = hit[first]
    return row[begin], (place >> 32)[row[begin]] + step[begin], np.diff(np.r_[first, len(hit)])


NAMES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
FOUND = "id long, start long, count long, tag int, edge binary"


def _bucket(length: int, gram: int):
    size = gram + 17

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([b for b in batches if b.num_rows], BUCKET)
        if not table.num_rows:
            return
        ids, place = table.column("id").to_numpy(), table.column("place").to_numpy()
        lead, body = table.column("lead").to_pylist(), table.column("body").to_pylist()
        hot = np.array([b is None for b in body])
        pieces = []
        cold = np.flatnonzero(~hot)
        if len(cold):
            row, start, count = _cold([lead[i] for i in cold], place[cold], [body[i] for i in cold], length)
            pieces.append((ids[cold[row]], start, count, place[cold[row]] & TAG, np.full(len(row), None)))
        warm = np.flatnonzero(hot)
        if len(warm):
            keys = np.frombuffer(b"".join(lead[i][:size].ljust(-(-size // 8) * 8, b"\0") for i in warm), ">u8").reshape(len(warm), -1)
            order, same = multikey_order([keys[:, i].astype(np.uint64) for i in range(keys.shape[1])])
            twice = warm[order[same | np.r_[same[1:], False]]]
            pieces.append((ids[twice], place[twice] >> 32, np.ones(len(twice), np.int64), place[twice] & TAG, np.full(len(twice), None)))
            ends = warm[order[[0, -1]]] if not same[1:].all() else warm[order[:1]]
            edges = np.array([lead[i][:size] for i in ends], object)
            pieces.append((ids[ends], place[ends] >> 32, np.ones(len(ends), np.int64), place[ends] & TAG, edges))
        columns = [np.concatenate(x) for x in zip(*pieces)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "start", "count", "tag", "edge"])

    return run


BUCKET = pa.schema([("lead", pa.binary()), ("id", pa.int64()), ("place", pa.int64()), ("body", pa.binary())])


def _row_id(content: Column) -> Column:
    """64 bits of doc_id and text, so that rows without doc_id, or that repeat one, are told apart by more than their tag."""
    return F.xxhash64(F.col("doc_id").cast("long"), content)


def _tagged(docs: DataFrame, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    content = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        _row_id(content).alias("id"),
        F.crc32(F.encode(content, "utf-8")).bitwiseAND(F.lit(TAG)).cast("int").alias("tag"),
        content.alias("_text"),
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.col(c).alias(f"_carry_{c}") for c in carry],
    )


def repeated_runs(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = 4096) -> DataFrame:
    """Runs of window starts that repeat: (id, tag, start, count), not merged. `tag` tells rows with one id apart."""
    source = docs.select(_row_id(F.coalesce(F.col(text), F.lit(""))), F.col(text))
    found = source.mapInArrow(_stretches(length, gram), "id long, place long, gram long, whole long")
    shared = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    candidates = written(found.join(shared, "gram"), "stretches")
    kinds = candidates.groupBy("gram", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "place")).alias("first"))
    kinds = written(kinds, "kinds")
    repeated = candidates.join(kinds.where("n > 1").select("gram", "whole"), ["gram", "whole"]).select("id", "place")
    sizes = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    meeting = kinds.join(sizes, "gram").select("first.id", "first.place", (F.col("kinds") > hot).alias("hot"))
    per_gram = F.when(F.col("hot"), F.shiftright("place", 24).bitwiseAND(F.lit(255)) / 40).otherwise(1)
    load = meeting.agg(F.coalesce(F.sum(per_gram), F.lit(0))).first()[0]
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(load) // 20_000 + 1)
    per_text = meeting.withColumn("tag", F.col("place").bitwiseAND(F.lit(TAG)).cast("int"))
    per_text = per_text.groupBy("id", "tag").agg(F.collect_list(F.struct("place", "hot")).alias("parts"))
    bodies = _tagged(docs, text).join(per_text, ["id", "tag"]).select("id", "_text", "parts")
    suffixes = bodies.mapInArrow(_suffixes(length, gram), "lead binary, id long, place long, body binary")
    sorted_out = suffixes.repartitionByRange(buckets, "lead").mapInArrow(_bucket(length, gram), FOUND)
    sorted_out = written(sorted_out, "repeats")
    edges = sorted_out.where("edge IS NOT NULL")
    across = edges.join(edges.groupBy("edge").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("edge"), "edge")
    whole = repeated.select(
        "id",
        F.col("place").bitwiseAND(F.lit(TAG)).cast("int").alias("tag"),
        F.shiftright("place", 32).alias("start"),
        F.shiftright("place", 24).bitwiseAND(F.lit(255)).alias("count"),
    )
    columns = ["id", "tag", "start", "count"]
    return whole.unionByName(sorted_out.where("edge IS NULL").select(*columns)).unionByName(across.select(*columns))


def covered(runs: list, length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by runs (start, count) of windows."""
    spans: list[list[int]] = []
    for start, count in sorted(runs):
        end = start + count - 1 + length
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    return [(a, b) for a, b in spans]


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans, shrunk so that no UTF-8 character is cut."""
    fit = []
    for start, end in spans:
        while start < end and text[start] & 0xC0 == 0x80:
            start += 1
        while end > start and end < len(text) and text[end] & 0xC0 == 0x80:
            end -= 1
        if end > start:
            fit.append((start, end))
    return fit


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, keep_text: bool = False, gram: int = GRAM, hot: int = 4096, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with `keep_text` the kept text, cut at whole characters, as `kept`.

    A null text counts as empty; texts shorter than `length` bytes keep everything, very long ones are cut into
    overlapping tiles, so nothing is missed. Repeated rows repeat each other and lose every byte from `length` on.
    A row without doc_id counts like any other. Other columns are ignored but for those named in `carry`; an empty table stays empty.
    """
    runs = repeated_runs(docs, text, length, gram, hot)
    per_text = runs.groupBy("id", "tag").agg(F.collect_list(F.struct("start", "count")).alias("runs"))
    keyed = _tagged(docs, text, carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out: list[list] = [[], [], [], [], []]
            for content, runs_ in zip(_encoded(batch.column(1)), batch.column(2).to_pylist()):
                spans = covered([(r["start"], r["count"]) for r in runs_ or []], length)
                if keep_text:
                    spans = whole_characters(content, spans)
                at, kept = 0, []
                for start, end in spans:
                    kept.append(content[at:start])
                    at = end
                rest = b"".join([*kept, content[at:]])
                values = len(content), len(content) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "replace") if keep_text else None
                for column, value in zip(out, values):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            arrays = [batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds)), *batch.columns[3:]]
            yield pa.RecordBatch.from_arrays(arrays, [*NAMES, *carry])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    carried = [f"_carry_{c}" for c in carry]
    found = keyed.join(per_text, ["id", "tag"], "left").select("doc_id", "_text", "runs", *carried).mapInArrow(run, schema)
    return found if keep_text else found.drop("kept")
