"""Merkle manifest of a document table by sibling-shift self-joins.

A level is a table of nodes (group, idx, n). It is joined with itself on computed
indices: for binary trees the sibling of idx is idx XOR 1; for wider ones a copy of the
table is shifted by each slot offset. Rows in slot zero then have their whole run and
emit the parent. Every join is an equi-join of unique keys, and a level has half the
nodes of the one below (or fewer), so all levels together cost twice the lowest.

Proofs go the other way: from the root down, each level takes the proof of its parent
by an equi-join and puts its own siblings before it. Every level is written, so a lost
executor costs one level at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe.llm.ranks import numbered
from pageframe.llm.store import written

#: Group of the tree over the roots of all groups.
TOP = "+"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    """Hex SHA-256 of the values, each with its length in bytes before it; a null is a dash."""
    return F.sha2(F.concat(*[_field(v) for v in values]), 256)


def _slot(arity: int) -> Column:
    return F.pmod(F.col("idx"), F.lit(arity)).cast("int")


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes (g, idx, n, h, ...) with `step` and, in slot zero, the parent's hash `up`.

    `step` is what a proof needs of this level, in a fixed width of 2 + 32 * (arity - 1) bytes: own slot, number of
    siblings, and the siblings from left to right, filled up with zeros.
    """
    slot, found = _slot(arity), nodes
    for offset in range(1, arity):
        # a node of idx i hands its hash to the sibling that is `offset` slots before it, around the run
        back = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("idx") - slot + F.pmod(slot - offset, F.lit(arity))
        shifted = nodes.select("g", back.cast("long").alias("idx"), F.col("h").alias(f"_s{offset}"))
        found = found.join(shifted, ["g", "idx"], "left")
    # the sibling in slot t stands at offset (t - slot) mod arity
    by_offset = F.array(F.lit(None).cast("string"), *[F.col(f"_s{o}") for o in range(1, arity)])
    run = F.transform(F.sequence(F.lit(0), F.lit(arity - 1)), lambda t: F.get(by_offset, F.pmod(t - slot, F.lit(arity))))
    others = F.array_join(F.filter(run, lambda h: h.isNotNull()), "")
    count = (F.length(others) / 64).cast("int")
    step = F.unhex(F.rpad(F.concat(F.lpad(F.hex(slot), 2, "0"), F.lpad(F.hex(count), 2, "0"), others), 4 + 64 * (arity - 1), "0"))
    up = F.when(slot == 0, F.sha2(F.concat("h", others), 256))
    return found.select(*nodes.columns, step.alias("step"), up.alias("up"))


def _climb(nodes: DataFrame, most: int, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels below the roots, lowest first, and (g, level, h) of the roots; a lone node is its own root."""
    levels, roots = [], []
    while True:
        roots.append(nodes.where("n = 1").select("g", F.lit(len(levels)).alias("level"), "h"))
        if most <= 1:
            break
        level = written(with_siblings(nodes.where("n > 1"), arity), "nodes")
        levels.append(level)
        above = level.where(_slot(arity) == 0)
        up = lambda c: F.floor((F.col(c) + (arity - 1 if c == "n" else 0)) / arity).cast("long").alias(c)
        nodes = above.select("g", up("idx"), up("n"), F.col("up").alias("h"))
        most = -(-most // arity)
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return levels, written(found, "roots")


def _proofs(levels: list[DataFrame], roots: DataFrame, arity: int, keep: list[str]) -> DataFrame:
    """(g, idx, path, *keep) of every node of the lowest level; `roots` is (g, level, path)."""
    at = lambda k: roots.where(F.col("level") == k).select("g", F.lit(0).cast("long").alias("idx"), "path")
    above = at(len(levels))
    for k in range(len(levels) - 1, -1, -1):
        extra = keep if k == 0 else []
        level = levels[k].select("g", "idx", "step", F.floor(F.col("idx") / arity).cast("long").alias("_up"), *extra)
        joined = level.join(above.select("g", F.col("idx").alias("_up"), "path"), ["g", "_up"])
        found = joined.select("g", "idx", F.concat("step", "path").alias("path"), *extra)
        if k:
            above = written(found, "proofs").unionByName(at(k))
    return found


def _fold(start: Column, path: str, arity: int) -> Column:
    """The root that a leaf hash and a hex path lead to."""
    width = 4 + 64 * (arity - 1)

    def climb(h: Column, i: Column) -> Column:
        at = i * width + 1
        slot, count = (F.conv(F.substring(F.col(path), at + o, F.lit(2)), 16, 10).cast("int") for o in (0, 2))
        others = F.substring(F.col(path), at + 4, count * 64)
        return F.sha2(F.concat(F.substring(others, F.lit(1), slot * 64), h, F.substring(others, slot * 64 + 1, F.lit(64 * arity))), 256)

    steps = (F.length(path) / width).cast("int")
    return F.when(steps == 0, start).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(steps - 1, F.lit(0))), start, climb))


def _siblings(path: str, arity: int) -> Column:
    """All siblings of a hex path, in order, as one string."""
    width = 4 + 64 * (arity - 1)
    steps = (F.length(path) / width).cast("int")
    at = lambda i: i * width + 1
    count = lambda i: F.conv(F.substring(F.col(path), at(i) + 2, F.lit(2)), 16, 10).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.greatest(steps - 1, F.lit(0))), lambda i: F.substring(F.col(path), at(i) + 4, count(i) * 64))
    return F.when(steps == 0, F.lit("")).otherwise(F.array_join(each, ""))


def manifest(docs: DataFrame, arity: int = 2, suspect: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per row of `docs`.

    Leaves ascend by doc_id in each lang (rows without doc_id first, ties by leaf hash), every `arity` consecutive nodes
    become one, and so do the roots of the langs (null first, then by bytes). `folded_root` is made again from the siblings
    and a leaf read anew, in which n_chars is one more where `suspect` holds; a null n_chars stays. Equal rows are leaves of
    their own. Empty and very long texts count whole, other columns are ignored, an empty table gives no row.
    """
    if not 2 <= arity <= 128:
        raise ValueError("arity must be from 2 to 128")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    leaf = leaf_hash(*fields)
    again = leaf if suspect is None else F.when(suspect, leaf_hash(*fields[:3], F.col("n_chars").cast("long") + 1, fields[4])).otherwise(leaf)
    group = F.coalesce(F.concat(F.lit(TOP), F.col("lang")), F.lit(""))
    leaves = docs.select("doc_id", group.alias("g"), leaf.alias("h"), again.alias("again"))
    nodes = written(numbered(leaves, "g", ["doc_id", "h"]), "leaves")
    most = nodes.agg(F.max("n")).first()[0]
    if most is None:
        return nodes.select("doc_id", *[F.col("h").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], F.lit(True).alias("verified"))
    levels, roots = _climb(nodes, most, arity)
    langs = written(numbered(roots.select(F.lit(TOP).alias("all"), "g", "h", "level"), "all", ["g"]), "langs")
    top_nodes = langs.select(F.col("all").alias("g"), "idx", "n", "h", F.col("g").alias("lang"), "level")
    tops, top = _climb(top_nodes, top_nodes.agg(F.max("n")).first()[0], arity)
    root = top.first()["h"]
    empty = F.unhex(F.lit(""))
    keep = ["lang", "level", "h"]
    if tops:
        rooted = _proofs(tops, top.select("g", "level", empty.alias("path")), arity, keep)
    else:
        rooted = top_nodes.select("g", "idx", empty.alias("path"), *keep)
    subroots = written(rooted.select(F.col("lang").alias("g"), "level", "path", F.col("h").alias("subroot")), "subroots")
    held = ["doc_id", "h", "again"]
    lone = nodes.where("n = 1").join(subroots.select("g", "path"), "g").select("g", "idx", "path", *held)
    found = _proofs(levels, subroots.select("g", "level", "path"), arity, held).unionByName(lone) if levels else lone
    proven = found.select("g", "doc_id", F.col("h").alias("leaf"), "again", F.lower(F.hex("path")).alias("_path"))
    judged = proven.select("g", "doc_id", "leaf", F.sha2(_siblings("_path", arity), 256).alias("proof_sha256"), _fold(F.col("again"), "_path", arity).alias("folded_root"))
    known = subroots.select("g", "subroot", F.lit(root).alias("root"))
    return judged.join(known, "g").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: DuckDB twin of the query: arity 2, suspects by the CRC-32 of doc_id.
SQL = """
WITH RECURSIVE bytes AS (SELECT doc_id, source, lang, n_chars, text,
    list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda c, b:
        list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda d, i: xor(d >> 1, (d & 1) * 3988292384), xor(c, b)), 4294967295::BIGINT) AS c
    FROM documents),
docs AS (SELECT *, coalesce(xor(c, 4294967295) % 7 = 0, false) AS bad FROM bytes),
fields AS (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail FROM docs),
leaves AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen((n_chars + bad::INT)::VARCHAR) || ':' || (n_chars + bad::INT)::VARCHAR, '-') || tail) AS again FROM fields),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves),
levels AS (SELECT lang, 0 AS lvl, list(leaf ORDER BY idx) AS h FROM placed GROUP BY lang
    UNION ALL SELECT lang, lvl + 1, list_transform(range(0, len(h), 2), lambda i: sha256(h[i + 1] || coalesce(h[i + 2], ''))) FROM levels WHERE len(h) > 1),
subroots AS (SELECT lang, h[1] AS subroot, lvl AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx FROM levels WHERE len(h) = 1),
tops AS (SELECT 0 AS lvl, (SELECT list(subroot ORDER BY idx) FROM subroots) AS h
    UNION ALL SELECT lvl + 1, list_transform(range(0, len(h), 2), lambda i: sha256(h[i + 1] || coalesce(h[i + 2], ''))) FROM tops WHERE len(h) > 1),
steps AS (SELECT p.doc_id, p.leaf, p.again, s.subroot, l.lvl AS step, p.idx >> l.lvl AS place, l.h[xor(p.idx >> l.lvl, 1) + 1] AS sibling
    FROM placed p JOIN levels l ON p.lang IS NOT DISTINCT FROM l.lang AND len(l.h) > 1 JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang
    UNION ALL SELECT p.doc_id, p.leaf, p.again, s.subroot, s.height + t.lvl, s.idx >> t.lvl, t.h[xor(s.idx >> t.lvl, 1) + 1]
    FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang JOIN tops t ON len(t.h) > 1),
paths AS (SELECT doc_id, leaf, again, subroot, list(struct_pack(o := place & 1, s := coalesce(sibling, '')) ORDER BY step) AS path FROM steps GROUP BY ALL),
known AS (SELECT p.doc_id, p.leaf, p.again, s.subroot, coalesce(q.path, []) AS path FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang
    LEFT JOIN paths q ON p.doc_id = q.doc_id AND p.leaf = q.leaf),
folded AS (SELECT doc_id, leaf, subroot, 0 AS step, path, again AS h FROM known
    UNION ALL SELECT doc_id, leaf, subroot, step + 1, path, sha256(CASE WHEN path[step + 1].o = 1 THEN path[step + 1].s || h ELSE h || path[step + 1].s END) FROM folded WHERE step < len(path)),
root AS (SELECT h[1] AS root FROM tops WHERE len(h) = 1)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x.s), '')) AS proof_sha256, h AS folded_root, h = root AS verified
FROM folded, root WHERE step = len(path)
"""
