"""Phrase collocations by dynamic itemset counting.

The documents are dealt to `shards`, which are scanned in a cycle. One scan of a shard
counts phrases of all lengths that are active: a word from the first scan on, a longer
phrase from the scan after both its parts without the last and without the first word
have reached the threshold in what was counted of them so far. Every phrase is counted
for one full cycle. The cycle goes on while some phrase has a scan left.

In a task words and phrases are 64-bit keys, added up before they are shuffled. Which keys
have reached the threshold is a bit array of a fixed size, two bits for each key: a
stray bit only has more phrases counted, never fewer, and the bits do not decide
anything else. Those that reached the threshold are then counted once more by their words
as text, so no clash of keys is in a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageframe.llm.store import sliced, written
from pageframe.session import fresh_path

CHUNK = 1 << 20
HELD = 1 << 21
LENGTH_BITS = 3
WORD, BLANK, BREAK = 0, 1, 2
BREAKS = b".,;:!?\n\x0b\x0c\r"

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = BLANK
_KIND[list(BREAKS)] = BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Hash:
    """Keys of words and phrases: a random value a byte times a power for its place, summed up and mixed."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.bytes = rng.integers(0, 1 << 64, 256, np.uint64)
        self.base, self.step = (rng.integers(0, 1 << 63, 2, np.uint64) * np.uint64(2) + np.uint64(1)).tolist()
        self.powers = np.ones(1, np.uint64)

    def words(self, letters: np.ndarray, place: np.ndarray, first: np.ndarray, lang: np.ndarray) -> np.ndarray:
        longest = int(place.max()) + 1
        if longest > len(self.powers):
            factors = np.full(2 * longest, self.base, np.uint64)
            factors[0] = 1
            self.powers = np.cumprod(factors, dtype=np.uint64)
        return mixed(np.add.reduceat(self.bytes[letters] * self.powers[place], first) ^ lang)

    def longer(self, key: np.ndarray, word: np.ndarray) -> np.ndarray:
        return mixed(key * np.uint64(self.step) + word)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a stretch of bytes: where they begin and end, their piece and their document."""

    def __init__(self, raw: np.ndarray, at: int, document_ends: np.ndarray):
        kind = _KIND[raw]
        is_word = kind == WORD
        edge = np.diff(np.concatenate([[0], is_word.view(np.int8), [0]]))
        self.begin, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.lower = _LOWER[raw]
        self.letters = self.lower[is_word]
        size = self.end - self.begin
        self.first = np.cumsum(size) - size
        self.place = np.arange(len(self.letters)) - np.repeat(self.first, size)
        self.piece = np.cumsum(kind == BREAK)[self.begin]
        self.document = np.searchsorted(document_ends, self.begin + at, side="right")

    def keys(self, by: Hash, langs: np.ndarray, longest: int) -> Iterator[np.ndarray]:
        """Keys of the phrases of 1, 2, ... words by the word they begin with, and whether one begins there.

        The lowest `LENGTH_BITS` bits of a key are the number of words less one.
        """
        word = by.words(self.letters, self.place, self.first, langs[self.document])
        low = np.uint64((1 << LENGTH_BITS) - 1)
        key = word
        yield key & ~low, np.ones(len(key), bool)
        for n in range(2, longest + 1):
            key = by.longer(key[:-1], word[n - 1 :]) if len(key) else key
            yield key & ~low | np.uint64(n - 1), self.piece[: len(key)] == self.piece[n - 1 :] if len(key) else np.ones(0, bool)

    def phrase(self, i: int, n: int) -> str:
        return b" ".join(self.lower[a:b].tobytes() for a, b in zip(self.begin[i : i + n].tolist(), self.end[i : i + n].tolist())).decode("utf-8", "replace")


def stretches(texts: list[bytes]) -> Iterator[Words]:
    """The words of the texts in stretches of about `CHUNK` bytes, cut where a piece ends."""
    raw = np.frombuffer(b"\n".join(texts), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    begin = 0
    while begin < len(raw):
        stop = begin + CHUNK
        while stop < len(raw):
            cut = np.flatnonzero(_KIND[raw[stop : stop + CHUNK]] == BREAK)
            if len(cut):
                stop += int(cut[0])
                break
            stop += CHUNK
        words = Words(raw[begin:stop], begin, ends)
        if len(words.begin):
            yield words
        begin = stop


def _read(batch: pa.RecordBatch) -> tuple[list[bytes], list[str], np.ndarray]:
    texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
    langs = batch.column("lang").to_pylist()
    keys = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(langs)}
    return texts, langs, np.array([keys[x] for x in langs], np.uint64)


#: Shifts that give a key its two places in a bit array of up to 2^29 bits.
PROBES = (LENGTH_BITS, 35)


def has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    def probe(keys: np.ndarray, shift: int) -> np.ndarray:
        at = (keys >> np.uint64(shift)) & np.uint64(len(bits) * 64 - 1)
        return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1

    found = probe(keys, PROBES[0])
    first = np.flatnonzero(found)
    found[first] = probe(keys[first], PROBES[1])
    return found


def bit_array(keys: DataFrame, bits: int) -> np.ndarray:
    """`bits` bits (a power of two), of which each key `k` sets two. They are gathered as words of 64, so the driver gets bits / 4 bytes at most."""
    at = keys.select(F.explode(F.array(*[F.shiftright("k", s).bitwiseAND(F.lit(bits - 1).cast("long")) for s in PROBES])).alias("at"))
    word = F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("bits")
    found = at.groupBy(F.shiftright("at", 6).alias("word")).agg(word).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def grouped(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal (key, check) together, and where each group begins in it."""
    order = np.argsort(key)
    ahead = key[order]
    new = np.concatenate([[True], ahead[1:] != ahead[:-1]])
    second = check[order]
    if (second[1:] != second[:-1])[~new[1:]].any():
        order = np.lexsort((check, key))
        new = np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(check[order]) != 0)])
    return order, np.flatnonzero(new)


def _counted(texts: DataFrame, words: bool, sent: Broadcast, longest: int) -> DataFrame:
    """(k, c): active phrases of the texts. A longer one is active if both parts are known and one of them is fresh."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, fresh = sent.value
        by, held, size = Hash(1), [], 0

        def out() -> pa.RecordBatch:
            k, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], ["k", "c"])

        for batch in sliced(batches):
            documents, _, langs = _read(batch)
            for stretch in stretches(documents):
                before = None
                for n, (key, whole) in enumerate(stretch.keys(by, langs, longest)):
                    if n == 0:
                        active = whole if words else np.zeros(len(key), bool)
                    elif not len(key):
                        break
                    else:
                        is_known, is_fresh = before
                        active = whole & is_known[:-1] & is_known[1:] & (is_fresh[:-1] | is_fresh[1:])
                    if active.any():
                        held.append(key[active])
                        size += len(held[-1])
                    if n + 1 < longest:
                        before = has(known, key) & whole, has(fresh, key) & whole
                if size > HELD:
                    yield out()
                    size = 0
        if held:
            yield out()

    return texts.select("text", "lang").mapInArrow(run, "k long, c long").groupBy("k").agg(F.sum("c").alias("c"))


def _hopeful(tables: list[DataFrame], sent: Broadcast) -> DataFrame:
    """(k, c) of phrases in the bit array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(has(sent.value, batch.column("k").to_numpy().view(np.uint64))))

    return reduce(DataFrame.unionByName, tables).mapInArrow(run, "k long, c long")


def reached_keys(texts: DataFrame, least: int, longest: int, shards: int, bits: int) -> DataFrame:
    """(k): keys of all phrases with `least` occurrences or more; `texts` has text, lang and shard.

    The driver holds one bit array for each of the last `shards` scans and two more. A phrase that reaches the threshold has
    its share of it in some shard; only the counts of such phrases are added up.
    """
    send = texts.sparkSession.sparkContext.broadcast
    known = np.zeros(bits // 64, np.uint64)
    news: list[np.ndarray] = []
    tables: list[DataFrame] = []
    reached: list[DataFrame] = []
    while True:
        step = len(tables)
        fresh = reduce(np.bitwise_or, news[-shards:], np.zeros_like(known))
        if step >= shards and not fresh.any():
            return reduce(DataFrame.unionByName, reached)
        sent = send((known, fresh))
        tables.append(written(_counted(texts.where(F.col("shard") == step % shards), step < shards, sent, longest), "counts"))
        sent.destroy()
        recent = tables[-shards:]
        share = -(-least // len(recent))
        sent = send(bit_array(reduce(DataFrame.unionByName, recent).where(F.col("c") >= share), bits))
        sums = _hopeful(recent, sent).groupBy("k").agg(F.sum("c").alias("c")).where(F.col("c") >= least).select("k")
        if reached:
            sums = sums.join(reduce(DataFrame.unionByName, reached), "k", "left_anti")
        reached.append(written(sums, "reached"))
        sent.destroy()
        growing = reached[-1].where(F.col("k").bitwiseAND(F.lit((1 << LENGTH_BITS) - 1).cast("long")) < longest - 1)
        news.append(bit_array(growing, bits))
        news[:-shards] = []
        known = known | news[-1]


def exact_counts(texts: DataFrame, reached: DataFrame, longest: int, bits: int) -> DataFrame:
    """(lang, words, phrase, a): occurrences of what `reached` names, by text; with words = 0 all words of a lang."""
    sent = texts.sparkSession.sparkContext.broadcast(bit_array(reached, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, by, other = sent.value, Hash(1), Hash(2)
        found: dict[bytes, list] = {}
        totals: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            rows = [*found.values(), *([lang, 0, "", c] for lang, c in totals.items())]
            found.clear(), totals.clear()
            columns = zip(*rows) if rows else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()))], ["lang", "words", "phrase", "a"])

        for batch in sliced(batches):
            documents, names, langs = _read(batch)
            for s in stretches(documents):
                for i, c in zip(*(x.tolist() for x in np.unique(s.document, return_counts=True))):
                    totals[names[i]] = totals.get(names[i], 0) + c
                second, _ = next(s.keys(other, langs, 1))
                for n, (key, whole) in enumerate(s.keys(by, langs, longest), 1):
                    at = np.flatnonzero(whole & has(wanted, key)) if len(key) else np.empty(0, np.int64)
                    if not len(at):
                        continue
                    key, check = key[at], second[at]
                    for i in range(1, n):
                        check = other.longer(check, second[at + i])
                    order, first = grouped(key, check)
                    counts = np.diff(np.concatenate([first, [len(at)]]))
                    pairs = np.stack([key[order[first]], check[order[first]]], axis=1)
                    for name, i, c in zip(pairs.view("V16").ravel().tolist(), at[order[first]].tolist(), counts.tolist()):
                        entry = found.get(name)
                        if entry is None:
                            found[name] = [names[s.document[i]], n, s.phrase(i, n), c]
                        else:
                            entry[3] += c
                if len(found) > 1 << 19:
                    yield out()
        yield out()

    return texts.select("text", "lang").mapInArrow(run, "lang string, words int, phrase string, a long").groupBy("lang", "words", "phrase").agg(F.sum("a").alias("a"))


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, per_lang: int = 2000, covered: int = 80, shards: int = 3, bits: int = 1 << 26) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `per_lang` phrases of 2 to `longest` words of each lang.

    A-Z is lower-cased; pieces end at a mark or a line break, words at blanks and tabs. `a` counts all occurrences, `n` all
    words of the lang (null: `und`). Of the cuts after k words the one with the lowest floor(2,000,000 a / (l + r)) counts,
    then the smallest k. A phrase goes if a longer one that holds it has `covered` percent of its occurrences or more. Order:
    score, then a, both falling, then phrase by bytes. A null or empty text has no words, very long texts count whole, equal
    rows count each, other columns are ignored; an empty table gives no row.

    Text and lang are written once, by shard, so that a scan reads its shard alone. `bits` is the size of the bit arrays.
    """
    if not 2 <= longest <= 1 << LENGTH_BITS:
        raise ValueError("longest is out of range")
    shard = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(shards))
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"), shard.cast("int").alias("shard"))
    path = fresh_path(docs.sparkSession, "shards")
    texts.write.partitionBy("shard").parquet(path)
    texts = docs.sparkSession.read.schema(texts.schema).parquet(path)
    reached = reached_keys(texts, least, longest, shards, bits)
    counted = written(exact_counts(texts, reached, longest, bits).where((F.col("words") == 0) | (F.col("a") >= least)), "phrases")
    words = counted.where("words > 0").select("lang", "phrase", "a")
    long = counted.where("words > 1").withColumn("w", F.split("phrase", " "))
    part = lambda begin, size: F.array_join(F.slice("w", begin, size), " ")
    cut = long.select("lang", "phrase", "a", "words", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    side = lambda name, count: words.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    scored = cut.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    score = F.expr("(CAST(2000000 AS decimal(7,0)) * CAST(a AS decimal(20,0))) div (CAST(l AS decimal(20,0)) + CAST(r AS decimal(20,0)))")
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    inner = [(n, b, s) for n in range(3, longest + 1) for s in range(2, n) for b in range(1, n - s + 2)]
    held = F.array_distinct(F.filter(F.array(F.lit(None).cast("string"), *[F.when(F.col("words") == n, part(F.lit(b), F.lit(s))) for n, b, s in inner]), lambda x: x.isNotNull()))
    inside = long.select("lang", F.explode(held).alias("phrase"), F.col("a").alias("most")).groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    gone = F.expr(f"coalesce(CAST(100 AS decimal(3,0)) * CAST(most AS decimal(20,0)) >= CAST({covered} AS decimal(3,0)) * CAST(a AS decimal(20,0)), false)")
    stay = best.join(inside, ["lang", "phrase"], "left").where(~gone).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    top = stay.withColumn("rank", rank).where(F.col("rank") <= per_lang)
    total = counted.where("words = 0").select("lang", F.col("a").alias("n"))
    return top.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: DuckDB twin: every phrase is counted.
SQL = """
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM docs),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words WHERE len(w) > 0),
counts AS (SELECT lang, s AS words, array_to_string(w[i:i + s - 1], ' ') AS phrase, count(*) AS a FROM starts, (SELECT unnest([1, 2, 3, 4]) AS s)
    WHERE i + s - 1 <= len(w) GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM counts WHERE words = 1 GROUP BY lang),
long AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE words > 1 AND a >= 30),
cuts AS (SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, ((2000000::HUGEINT * c.a) // (l.a::HUGEINT + r.a))::BIGINT AS score
    FROM (SELECT *, unnest(range(1, words)) AS k FROM long) c
    JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ') JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(w[b:b + s - 1], ' ') AS phrase, max(a) AS most FROM long, (SELECT unnest([1, 2, 3]) AS b), (SELECT unnest([2, 3]) AS s)
    WHERE s < words AND b + s - 1 <= words GROUP BY ALL),
stay AS (SELECT b.* FROM best b LEFT JOIN inside i ON b.lang = i.lang AND b.phrase = i.phrase WHERE coalesce(100::HUGEINT * i.most < 80::HUGEINT * b.a, true)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM stay)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN totals t ON r.lang = t.lang WHERE rank <= 2000
"""
