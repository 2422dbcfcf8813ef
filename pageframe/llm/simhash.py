"""SimHash fingerprints and near-duplicate classes found by a pigeonring filter.

A 64-bit fingerprint is cut into `segments` pieces on a ring. If two differ in at
most `bits` places, then from some segment on, every chain of consecutive
segments of length l differs in at most floor(l * bits / segments) places. So at
most so many segments of each chain prefix are unequal, and the others agree: the
agreeing segments of every largest allowed pattern form a join key. Rows that
share a key are compared chain by chain, and those that stay within the budgets
get the full Hamming check. More segments mean longer keys and fewer chance
meetings: 7 segments give 35 keys of about 27 bits, 8 give 70 of 32 bits.

Equal fingerprints are one row before any join. Keys with more than `block`
fingerprints are cut into blocks that meet pairwise, so a task holds two blocks
at most; what a group returns is a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe.llm.components import LINK, connected_components, contract
from pageframe.llm.phrases import bit_array, has
from pageframe.llm.store import over_batches, sliced, written

SEED = 42
LANES = np.uint64(0x0101010101010101)
SMALL = 64


def shingle_hashes(text: str | None, width: int = 4) -> np.ndarray:
    """XXH64 of every run of `width` words, repeats included; all words if there are fewer, nothing if none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    reach = min(width, len(words)) - 1
    digest = xxhash.xxh64_digest
    parts = [digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), (ends[reach:] - 1).tolist())]
    return np.frombuffer(b"".join(parts), ">u8").astype(np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes, as an unsigned number; eight counters share a word while they add up."""
    n = len(hashes)
    if not n:
        return 0
    cuts = np.arange(0, n, 255)
    value = 0
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & LANES, cuts)
        counts = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in np.flatnonzero(2 * counts > n):
            value |= 1 << (8 * int(byte) + bit)
    return value


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def with_fingerprints(docs: DataFrame, text: str = "text", width: int = 4, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and `fp`, the SimHash of the whole text as a long. A null or wordless text has 0."""
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", fp long"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [signed(majority(shingle_hashes(t, width))) for t in batch.column(len(keep)).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.int64())], [*keep, "fp"])

    return over_batches(docs.select(*keep, F.col(text).alias("_text")), run, schema)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def segment_masks(segments: int) -> list[int]:
    """Bit masks of the ring's segments, as equal as 64 bits allow."""
    cuts = [round(64 * i / segments) for i in range(segments + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:])]


def key_patterns(segments: int, bits: int) -> list[tuple[int, int]]:
    """(first segment of the chain, mask of the segments that agree) for every largest pattern of unequal segments."""
    budget = [length * bits // segments for length in range(segments + 1)]
    allowed = [
        set(c)
        for size in range(bits + 1)
        for c in combinations(range(segments), size)
        if all(sum(x < length for x in c) <= budget[length] for length in range(1, segments + 1))
    ]
    largest = [c for c in allowed if not any(c < d for d in allowed)]
    masks = segment_masks(segments)
    return [
        (start, sum(masks[(start + i) % segments] for i in range(segments) if i not in unequal))
        for start in range(segments)
        for unequal in largest
    ]


def within_chain(difference: np.ndarray, start: np.ndarray, segments: int, bits: int) -> np.ndarray:
    """Which differences keep every chain prefix from `start` on within its share of the budget."""
    masks = np.array(segment_masks(segments), np.uint64)
    spent = np.zeros(len(difference), np.int64)
    good = np.ones(len(difference), bool)
    for length in range(1, segments):
        spent += np.bitwise_count(difference & masks[(start + length - 1) % segments])
        good &= spent <= length * bits // segments
    good[good] = np.bitwise_count(difference[good]) <= bits
    return good


def reach_all(fp: np.ndarray, node: np.ndarray, bits: int, check: np.ndarray, check_bits: int) -> tuple[list[int], list[int]]:
    """Spanning forest of the links within one large group: a search whose pool of unreached rows only shrinks."""
    a, b = [], []
    rest = np.arange(len(fp))
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            here = front.pop()
            near = np.bitwise_count(fp[rest] ^ fp[here]) <= bits
            near &= np.bitwise_count(check[rest] ^ check[here]) <= check_bits
            hit = rest[near]
            if len(hit):
                a += [int(node[here])] * len(hit)
                b += node[hit].tolist()
                front += hit.tolist()
                rest = rest[~near]
    return a, b


def _links(segments: int, bits: int, check_bits: int):
    starts = np.array([s for s, _ in key_patterns(segments, bits)])

    def links(kind: np.ndarray, group: np.ndarray, fp: np.ndarray, node: np.ndarray, check: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if len(group) else np.array([0])
        sizes = np.diff(edges)
        per_row = np.repeat(sizes, sizes)
        a, b = [], []
        small = np.flatnonzero((per_row > 1) & (per_row <= SMALL))
        kind_s, group_s, fp_s, node_s, check_s, size_s = (x[small] for x in (kind % len(starts), group, fp, node, check, per_row))
        for step in range(1, SMALL):
            wide = size_s > step
            if not wide.any():
                break
            kind_s, group_s, fp_s, node_s, check_s, size_s = (x[wide] for x in (kind_s, group_s, fp_s, node_s, check_s, size_s))
            pair = np.flatnonzero(group_s[:-step] == group_s[step:])
            good = within_chain(fp_s[pair] ^ fp_s[pair + step], starts[kind_s[pair]], segments, bits)
            good &= np.bitwise_count(check_s[pair] ^ check_s[pair + step]) <= check_bits
            a.append(node_s[pair[good]])
            b.append(node_s[pair[good] + step])
        for i in np.flatnonzero(sizes > SMALL):
            rows = slice(edges[i], edges[i + 1])
            more_a, more_b = reach_all(fp[rows], node[rows], bits, check[rows], check_bits)
            a.append(np.array(more_a, np.int64))
            b.append(np.array(more_b, np.int64))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy() for c in batch.columns]
            cols = [np.concatenate(x) for x in zip(left, cols)] if left else cols
            same = np.ones(len(cols[0]), bool)
            for c in cols[:4]:
                same &= c == c[-1]
            last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            yield from part([c[:last] for c in cols])
            left = [c[last:] for c in cols]
        if left:
            yield from part(left)

    def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return contract(run(batches))

    def part(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not len(cols[0]):
            return
        changed = np.zeros(len(cols[0]), bool)
        for c in cols[:4]:
            changed[1:] |= c[1:] != c[:-1]
        yield from links(cols[0], np.cumsum(changed), cols[4].view(np.uint64), cols[5], cols[6].view(np.uint64))

    return contracted


def near_links(
    nodes: DataFrame,
    bits: int = 4,
    segments: int = 7,
    block: int = 4096,
    prints: tuple[str, ...] = ("fp",),
    check: str = "fp",
    check_bits: int = 64,
) -> DataFrame:
    """Links (a, b) that connect whatever nodes have a print in which they differ in at most `bits` places.

    `nodes` holds distinct prints and a node each. The column `check` may differ in at most `check_bits` places too.
    Every such pair is joined by a path of returned links, which are the stars that `contract` leaves of a partition.
    """
    patterns = key_patterns(segments, bits)
    kinds = [
        F.struct(F.lit(j * len(patterns) + i).alias("kind"), F.col(p).bitwiseAND(F.lit(signed(mask))).alias("part"), F.col(p).alias("fp"))
        for j, p in enumerate(prints)
        for i, (_, mask) in enumerate(patterns)
    ]
    keyed = nodes.select("node", F.col(check).alias("check"), F.explode(F.array(*kinds)).alias("k"))
    keyed = keyed.select("k.kind", "k.part", "k.fp", "node", "check")
    # counted by bucket first, some `block` / 8 rows each, so that a task holds a number a bucket and not one for each of its keys
    bucket = F.pmod(F.xxhash64("kind", "part"), F.lit(nodes.count() * len(kinds) * 8 // block + 1))
    crowded = keyed.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    crowded = written(crowded.select("bucket"), "crowded")
    many = keyed.withColumn("bucket", bucket).join(crowded, "bucket", "left_semi")
    many = many.groupBy("kind", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    # written, so that its size is known: Spark broadcasts it below its own threshold and joins by shuffle above
    many = written(many.select("kind", "part", F.ceil(F.col("n") / block).cast("int").alias("n_blocks")), "many")
    sized = keyed.join(many, ["kind", "part"], "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp", "node"), F.col("n_blocks")).cast("int")
    met = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    placed = met.select("kind", "part", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "fp", "node", "check")
    group = ["kind", "part", "p", "q"]
    return placed.repartition(*group).sortWithinPartitions(*group).mapInArrow(_links(segments, bits, check_bits), LINK)


def near_duplicate_classes(docs: DataFrame, text: str = "text", bits: int = 4, width: int = 4, segments: int = 7) -> DataFrame:
    """(doc_id, fp, component_id): `component_id` is the smallest doc_id that links reach, the row's own included.

    A null, empty or blank text has fingerprint 0 and links like any other; very long texts count whole. Rows
    that repeat a doc_id keep their own fingerprints and share a class. A row without doc_id takes the class of
    the rows with its fingerprint, null if none has an id. Other columns are ignored; an empty table stays empty.
    """
    marked = written(with_fingerprints(docs, text, width), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").cast("long").alias("node")), "nodes")
    links = near_links(nodes.where("node IS NOT NULL"), bits, segments)
    centres = connected_components(links, contracted=True)
    classes = nodes.join(centres, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


def _word_prints(text: str | None, prints: int, width: int) -> list[int]:
    """Fingerprints of the set of words under `prints` hash functions, then the one of shingles of `width` words."""
    words = set((text or "").encode("utf-8", "surrogatepass").lower().split())
    hashes = np.frombuffer(b"".join([xxhash.xxh64_digest(w, SEED) for w in words]), ">u8").astype(np.uint64)
    out = []
    for turn in range(prints):
        mixed = (hashes ^ np.uint64(turn)) * np.uint64(0xFF51AFD7ED558CCD)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
        out.append(signed(majority(mixed ^ (mixed >> np.uint64(29)))))
    return [*out, signed(majority(shingle_hashes(text, width)))]


def text_classes(docs: DataFrame, text: str = "text", width: int = 5, bits: int = 4, prints: int = 3, similar_bits: int = 12) -> DataFrame:
    """(doc_id, tag, class, component_id) of near copies by SimHash: shingles of `width` words about 0.8 alike, and what they link.

    One edited word changes `width` shingles, so texts of similarity 0.8 differ in some ten bits of a shingle
    fingerprint, too many for long keys. Candidates are found in `prints` fingerprints of the set of words instead,
    where such texts differ in about four bits: within `bits` places in one of them by the pigeonring filter. They
    link if their shingle fingerprints differ in at most `similar_bits` places: 64 acos(2s / (1 + s)) / pi is 9.7 for
    s = 0.8, and two more for the spread. No such link is missed. Texts with equal fingerprints are one node, `class`
    names a class of nodes, `component_id` is its smallest doc_id, and `tag` tells apart the texts of one doc_id. Nulls
    and empty texts link like any other; other columns are ignored; an empty table stays empty.
    """
    names = [*(f"w{i}" for i in range(prints)), "shingles"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([_word_prints(t, prints, width) for t in batch.column(2).to_pylist()], np.int64).reshape(-1, len(names))
        columns = [batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(c)) for c in found.T)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "tag", *names])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_tag(text).alias("tag"), F.col(text).alias("_text"))
    marked = written(over_batches(source, run, "doc_id long, tag long, " + ", ".join(f"{n} long" for n in names)), "prints")
    nodes = marked.groupBy(*names).agg(F.min("doc_id").alias("least"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    centres = connected_components(near_links(nodes, bits, prints=tuple(names[:-1]), check="shingles", check_bits=similar_bits), contracted=True)
    classes = written(nodes.join(centres, "node", "left").select(*names, "least", F.coalesce("component", "node").alias("class")), "classes")
    least = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    return marked.join(classes.join(least, "class").drop("least"), names).select("doc_id", "tag", "class", "component_id")


def _set_of(text: str | None, width: int) -> tuple[np.ndarray, bytes]:
    """The set of shingles in rising order, and a digest that names it."""
    members = np.unique(shingle_hashes(text, width))
    return members, hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def _common_shingles(source: DataFrame, width: int, every: int = 16, least: int = 4, limit: int = 1 << 16) -> np.ndarray:
    """Shingles that many texts of a sample share, the commonest last. They only set an order, so any sample gives the same links."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [_set_of(t, width)[0] for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())], ["part"])

    sample = source.where(F.pmod(F.xxhash64("_text"), F.lit(every)) == 0)
    counts = over_batches(sample, run, "part long").groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return np.array([r.part for r in counts.orderBy(F.desc("n"), "part").limit(limit).collect()][::-1], np.int64).view(np.uint64)


def _verified(pairs: DataFrame, nodes: DataFrame, source: DataFrame, width: int, num: int, den: int, block: int) -> DataFrame:
    """Links (a, b) of the pairs (x, y) of sets whose exact similarity is num / den or more, all by `at`. Sets are made again, of paired texts only."""
    pairs = written(pairs.distinct(), "pairs")
    ends = pairs.select(F.col("x").alias("at")).unionByName(pairs.select(F.col("y").alias("at"))).distinct()
    wanted = written(nodes.join(ends, "at", "left_semi").select("at", "node", "digest"), "wanted")

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [_set_of(t, width) for t in batch.column(3).to_pylist()]
        same = np.array([m[1] == d for m, d in zip(made, batch.column(2).to_pylist())], bool)
        sets = pa.array([m[0].tobytes() for m in made], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sets], ["at", "node", "members"]).filter(pa.array(same))

    texts = source.join(wanted, source["doc_id"] == wanted["node"]).select("at", "node", "digest", "_text")
    sets = written(over_batches(texts, make, "at long, node long, members binary"), "sets")
    slots = pairs.groupBy("x").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n_slots"))
    heads = slots.join(sets, slots["x"] == sets["at"]).select("x", F.explode(F.sequence(F.lit(0), F.col("n_slots") - 1)).alias("slot"), F.lit(0).alias("kind"), "at", "members")
    placed = pairs.join(slots, "x").select("x", "y", F.pmod(F.xxhash64("y"), F.col("n_slots")).cast("int").alias("slot"))
    tails = placed.join(sets, placed["y"] == sets["at"]).select("x", "slot", F.lit(1).alias("kind"), "at", "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, name = np.empty(0, np.uint64), 0
        for batch in sliced(batches):
            a, b = [], []
            for kind, node, members in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                other = np.frombuffer(members, np.uint64)
                if not kind:
                    head, name = other, node
                    continue
                both = len(np.intersect1d(head, other, assume_unique=True))
                if both * (num + den) >= num * (len(head) + len(other)):
                    a.append(name), b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    met = heads.unionByName(tails).repartition("x", "slot").sortWithinPartitions("x", "slot", "kind")
    return written(met.mapInArrow(run, LINK), "verified")


def text_tag(text: str = "text") -> Column:
    """A number by which the texts of one doc_id are told apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def near_copy_classes(docs: DataFrame, text: str = "text", width: int = 5, similarity: float = 0.8, block: int = 1024, bits: int = 1 << 26) -> DataFrame:
    """(doc_id, tag, class, component_id) of near copies: texts whose sets of `width`-word shingles have a Jaccard similarity of `similarity` or more, and what they link.

    Of two such sets, the first n - ceil(similarity * n) + 1 shingles of each, in any one order of all shingles, have one
    in common. So texts meet in these prefixes, in an order that puts common shingles last; pairs whose sizes or places
    rule the similarity out are dropped, and all others are compared by their whole sets. Equal sets are one row before
    any join, and a shingle that one prefix alone has leaves before any row is made of it, by an array of `bits` bits of
    those seen twice (a stray bit keeps a shingle too many). First every set is compared with the smallest of each group it is in; then, in groups that this leaves in
    several classes, all pairs of unlike classes are, large groups block by block. So no pair is missed, and a group of
    copies takes one comparison a text. `class` names a class, `component_id` is its smallest doc_id, and `tag` tells apart the
    texts of one doc_id: such rows are in one class only if their texts are. A null or empty text has an empty set. A text
    that only rows without doc_id have is a class of its own. Other columns are ignored; an empty table stays empty.
    """
    part = Fraction(str(similarity))
    num, den = part.numerator, part.denominator
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("_text"), text_tag(text).alias("tag"))
    common = _common_shingles(source, width)
    by_value = np.argsort(common)
    ranked = common[by_value]

    def prefix(members: np.ndarray) -> np.ndarray:
        n = len(members)
        place = np.minimum(np.searchsorted(ranked, members), max(len(ranked) - 1, 0))
        hot = ranked[place] == members if len(ranked) else np.zeros(n, bool)
        ordered = np.concatenate([members[~hot], members[hot][np.argsort(by_value[place[hot]])]])
        return ordered[: n - (num * n + den - 1) // den + 1] if n else ordered

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [_set_of(t, width) for t in batch.column(1).to_pylist()]
        firsts = [prefix(m).view(np.int64) for m, _ in made]
        cuts = np.cumsum([0, *map(len, firsts)], dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(firsts) if firsts else [], pa.int64()))
        columns = [batch.column(0), batch.column(2), pa.array([d for _, d in made], pa.binary()), pa.array([len(m) for m, _ in made], pa.int64()), lists]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "tag", "digest", "n", "prefix"])

    marked = written(over_batches(source, run, "doc_id long, tag long, digest binary, n long, prefix array<long>"), "prefixes")
    nodes = marked.groupBy("digest").agg(F.min("doc_id").alias("node"), F.any_value("n").alias("n"), F.any_value("prefix").alias("prefix"))
    nodes = written(nodes.withColumn("at", F.monotonically_increasing_id()), "nodes")
    named = nodes.where("node IS NOT NULL").select("at", "node", "n", "prefix")
    twice = named.select(F.explode("prefix").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    sent = docs.sparkSession.sparkContext.broadcast(bit_array(twice, bits))

    def met_again(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(3)
        offsets = lists.offsets.to_numpy()
        part = lists.values.to_numpy()[offsets[0] : offsets[-1]]
        sizes = np.diff(offsets)
        keep = np.flatnonzero(has(sent.value, part.view(np.uint64)))
        row = np.repeat(np.arange(len(sizes)), sizes)[keep]
        pos = keep - (offsets[:-1] - offsets[0])[row]
        columns = [batch.column(i).take(pa.array(row)) for i in range(3)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(pos.astype(np.int32)), pa.array(part[keep])], ["at", "node", "n", "pos", "part"])

    rows = written(over_batches(named, met_again, "at long, node long, n long, pos int, part long"), "rows")
    least = F.min(F.struct("n", "at", "node", "pos")).alias("first")
    shared = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), least).where("n_rows > 1").select("part", "first")
    met = written(rows.join(written(shared, "shared"), "part"), "met")

    def may_link(n: str, pos: str, other_n: str, other_pos: str) -> Column:
        """Whether sets of these sizes whose first common shingle is here can be so alike."""
        return F.expr(f"least({n} - {pos}, {other_n} - {other_pos}) * {num + den} >= {num} * ({n} + {other_n})")

    stars = met.where("at <> first.at").where(may_link("n", "pos", "first.n", "first.pos")).select(F.col("first.at").alias("x"), F.col("at").alias("y"))
    linked = connected_components(_verified(stars, nodes, source, width, num, den, block))
    labelled = met.select("part", "at", "n", "pos").join(linked.withColumnRenamed("node", "at"), "at", "left").withColumn("label", F.coalesce("component", "at")).drop("component")
    mixed = labelled.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n_blocks"), F.min("label").alias("low"), F.max("label").alias("high"))
    left = written(labelled.join(mixed.where("low <> high").select("part", "n_blocks"), "part"), "mixed")
    own = left.withColumn("slot", F.pmod(F.xxhash64("at"), F.col("n_blocks")).cast("int")).alias("l")
    other = left.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).alias("r")
    across = own.join(other, F.expr("l.part = r.part AND l.slot = r.slot AND l.at < r.at AND l.label <> r.label") & may_link("l.n", "l.pos", "r.n", "r.pos"))
    rest = _verified(across.select(F.col("l.at").alias("x"), F.col("r.at").alias("y")), nodes, source, width, num, den, block)
    centres = connected_components(rest.unionByName(linked.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    classes = written(nodes.join(centres.withColumnRenamed("node", "at"), "at", "left").select("digest", "node", F.coalesce("component", "at").alias("class")), "classes")
    least = classes.groupBy("class").agg(F.min("node").alias("component_id"))
    return marked.join(classes.join(least, "class").select("digest", "class", "component_id"), "digest").select("doc_id", "tag", "class", "component_id")
