"""Best-fit packing of token sequences by length patterns and non-negative least squares.

Tokenised documents become pieces of at most `size` tokens. Only the histogram of
piece lengths reaches the driver, `size` numbers whatever the input. There, patterns
of few lengths that fill a sequence are enumerated over coarse length steps, repeat
counts are fitted to the histogram by non-negative least squares and rounded down,
and the residual lengths go, longest first, where they fit best: into gaps the
patterns left or into new sequences. The plan is a list of slots, each for a run of
pieces of one length; a piece finds its slot by its rank among equals.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageframe.llm.store import sliced, written

SIZE = 4096
END_ID = 1
CACHED = 300_000
BATCH = 400
WORD_END = "</w>"
_encoders: dict[str, "WordIds"] = {}


class Recent(dict):
    """A cache of two generations of at most `most` entries each; what is asked for again moves to the young one."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.old = most, {}

    def recall(self, wanted: set) -> set:
        """Take over what the old generation knows; those of `wanted` that neither knows."""
        missing = wanted.difference(self)
        known = missing & self.old.keys()
        self.update((w, self.old[w]) for w in known)
        return missing - known

    def learn(self, found: dict, wanted: set) -> None:
        """Add `found`; if that is too much, the young generation becomes the old one, but for what `wanted` needs."""
        if len(self) + len(found) > self.most:
            kept = {w: self[w] for w in wanted if w in self}
            self.old = dict(self)
            self.clear()
            self.update(kept)
        self.update(found)


class WordIds:
    """Ids of white-space words, four bytes each. The tokenizer drops white space, so words are independent.

    A batch looks up its distinct words at once. A Latin word in any case, with one mark at its end, is found by its
    lower-case letters, as the tokenizer lower-cases and splits letters from marks; such a core is one piece to the
    tokenizer, so many new ones are encoded as one text and parted at the tokens that end a word. About `CACHED`
    words and as many cores stay from batch to batch, those used last.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.words: Recent = Recent(CACHED // 2)
        self.cores: Recent = Recent(CACHED // 2)

    def encoded(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(f.ids, "<u4").tobytes() for f in found]

    def encoded_cores(self, cores: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(cores), 1000):
            part = cores[at : at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(cuts) == len(part):
                data, cuts = ids.tobytes(), cuts.tolist()
                out += [data[s:e] for s, e in zip([0, *cuts], cuts)]
            else:
                out += self.encoded(part)
        return out

    def __call__(self, wanted: set[bytes]) -> Callable[[bytes], bytes]:
        """A lookup that knows the words `wanted`."""
        latin, others = [], []
        for word in self.words.recall(wanted):
            text = word.decode("utf-8", "replace")
            body, mark = (text[:-1], text[-1]) if text[-1] in ".,;:!?" else (text, "")
            if body.isalpha() and max(body) <= "\xff":
                latin.append((word, body.lower(), mark))
            else:
                others.append((word, text))
        cores = {core for _, core, _ in latin}
        if new := list(self.cores.recall(cores)):
            self.cores.learn(dict(zip(new, self.encoded_cores(new))), cores)
        marks = dict(zip(".,;:!?", self.encoded([*".,;:!?"]))) | {"": b""} if latin else {}
        found = {word: self.cores[core] + marks[mark] for word, core, mark in latin}
        found.update(zip([w for w, _ in others], self.encoded([t for _, t in others])))
        self.words.learn(found, wanted)
        return self.words.__getitem__


def encoder(path: str) -> WordIds:
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, vocabulary: str, text: str = "text", size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and the end id, cut after each `size` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in sliced(batches, BATCH):
            row, piece, length, crc = [], [], [], []
            split = [(content or "").encode("utf-8", "surrogatepass").split() for content in batch.column(1).to_pylist()]
            known = words(set(chain.from_iterable(split)))
            for i, text_words in enumerate(split):
                data = b"".join(map(known, text_words)) + end
                for at in range(0, len(data), 4 * size):
                    part = data[at : at + 4 * size]
                    row.append(i), piece.append(at // (4 * size)), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            ids = batch.column(0).take(pa.array(row, pa.int64()))
            number = pa.array(piece, pa.int32())
            start = pa.array(np.array(piece, np.int64) * size)
            columns = [ids, number, start, pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("_text"))
    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(units: int, most: int) -> np.ndarray:
    """Every multiset of 2 to `most` steps with sum `units`, as rows filled up with zeros, largest first."""
    found: list[tuple[int, ...]] = []

    def grow(chosen: tuple[int, ...], left: int) -> None:
        room = most - len(chosen)
        top = min(left, chosen[-1] if chosen else units - 1)
        if room == 1:
            if left <= top:
                found.append((*chosen, left))
            return
        for step in range(top, (left - 1) // room, -1):
            if step == left:
                found.append((*chosen, step, *[0] * (room - 1)))
            else:
                grow((*chosen, step), left - step)

    grow((), units)
    return np.array(found, np.int64).reshape(-1, most)


def fit_counts(uses: np.ndarray, target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that brings uses @ x close to target: the active-set method of Lawson and Hanson."""
    x = np.zeros(uses.shape[1])
    active = np.zeros(len(x), bool)
    slack = 1e-9 * max(1.0, float(target.max(initial=0)))
    for _ in range(rounds):
        pull = uses.T @ (target - uses @ x)
        pull[active] = -np.inf
        best = int(np.argmax(pull))
        if pull[best] <= slack:
            break
        active[best] = True
        while True:
            chosen = np.flatnonzero(active)
            solved = np.linalg.lstsq(uses[:, chosen], target, rcond=None)[0]
            if solved.min() > 0:
                x[:] = 0
                x[chosen] = solved
                break
            low = solved <= 0
            step = np.min(x[chosen][low] / np.maximum(x[chosen][low] - solved[low], 1e-300))
            x[chosen] += step * (solved - x[chosen])
            x[chosen[low & (x[chosen] <= slack)]] = 0
            active &= x > 0
            if not active.any():
                break
    return x


class Plan:
    """Slots (length, count, first sequence, offset) and the gaps of sequences that are still open."""

    def __init__(self, histogram: np.ndarray, size: int) -> None:
        self.left, self.size = histogram.copy(), size
        self.slots: list[tuple[int, int, int, int]] = []
        self.gaps: dict[int, list[tuple[int, int]]] = {}
        self.used = 0

    def place(self, length: int, count: int, first: int, gap: int) -> None:
        self.slots.append((length, count, first, self.size - gap))
        self.left[length] -= count
        if gap > length:
            self.gaps.setdefault(gap - length, []).append((first, count))

    def open(self, count: int) -> int:
        self.used += count
        return self.used - count

    def follow(self, steps: np.ndarray, counts: np.ndarray, width: int) -> None:
        """Patterns with whole repeat counts: each step takes the longest lengths of its bin that are left."""
        for row, wanted in zip(steps, counts):
            parts = [int(s) for s in row if s]
            while wanted:
                lengths = []
                taken = self.left.copy()
                for part in parts:
                    inside = np.flatnonzero(taken[(part - 1) * width + 1 : part * width + 1])
                    if not len(inside):
                        break
                    lengths.append((part - 1) * width + 1 + int(inside[-1]))
                    taken[lengths[-1]] -= 1
                if len(lengths) < len(parts):
                    break
                run = int(min([wanted, *(self.left[x] // lengths.count(x) for x in lengths)]))
                first, gap = self.open(run), self.size
                for x in lengths:
                    self.slots.append((x, run, first, self.size - gap))
                    self.left[x] -= run
                    gap -= x
                if gap:
                    self.gaps.setdefault(gap, []).append((first, run))
                wanted -= run

    def best_fit(self) -> None:
        """Residual lengths, longest first, each into the tightest gap that holds it."""
        for length in range(self.size, 0, -1):
            while self.left[length]:
                wanted = int(self.left[length])
                gap = min((g for g in self.gaps if g >= length), default=None)
                if gap is None:
                    fit = self.size // length
                    run = wanted // fit or 1
                    first, per = self.open(run), min(fit, wanted)
                    for i in range(per):
                        self.slots.append((length, run, first, i * length))
                        self.left[length] -= run
                    if self.size > per * length:
                        self.gaps.setdefault(self.size - per * length, []).append((first, run))
                    continue
                first, count = self.gaps[gap].pop()
                run = min(count, wanted)
                if run < count:
                    self.gaps[gap].append((first + run, count - run))
                elif not self.gaps[gap]:
                    del self.gaps[gap]
                self.place(length, run, first, gap)


def plan_slots(histogram: np.ndarray, size: int = SIZE, units: int = 64, most: int = 4) -> Plan:
    """Slots for every piece; histogram[length] is how many pieces have that length."""
    width = size // units
    plan = Plan(histogram.astype(np.int64), size)
    if histogram.sum():
        steps = patterns(units, most)
        bins = np.array([histogram[(i - 1) * width + 1 : i * width + 1].sum() for i in range(1, units + 1)], float)
        uses = np.zeros((units, len(steps)))
        for column in steps.T:
            np.add.at(uses, (column[column > 0] - 1, np.flatnonzero(column)), 1)
        counts = np.floor(fit_counts(uses, bins) + 1e-6).astype(np.int64)
        keep = np.flatnonzero(counts)
        # the smallest length of a pattern stays open, so that the gap is filled by an exact length
        heads = steps[keep].copy()
        heads[np.arange(len(keep)), (heads > 0).sum(axis=1) - 1] = 0
        plan.follow(heads, counts[keep], width)
    plan.best_fit()
    return plan


def packed(docs: DataFrame, vocabulary: str, text: str = "text", size: int = SIZE, block: int = 20_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row for each piece.

    A null or empty text is one piece with the end id alone; very long texts give many pieces; equal rows each get a
    place of their own; a null doc_id stays null. Other columns are ignored and an empty table stays empty.
    """
    pieces = written(token_pieces(docs, vocabulary, text, size), "pieces")
    counted = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `size` rows
    histogram = np.zeros(size + 1, np.int64)
    for row in counted:
        histogram[row["length"]] = row["n"]
    plan = plan_slots(histogram, size)
    blocks = int(histogram.sum()) // block + 1
    order = ["doc_id", "piece", "ids_crc32"]
    cut = pieces.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    group = ["length", "_block"]
    sizes = cut.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    ranked = cut.withColumn("_inside", inside).join(sizes, group).withColumn("_rank", F.col("_inside") + F.col("_before"))

    slots = sorted(plan.slots)
    lengths = np.array([s[0] for s in slots], np.int64)
    counts = np.array([s[1] for s in slots], np.int64)
    ends = np.cumsum(counts)
    base = np.concatenate([[0], np.cumsum(histogram)])  # pieces that are shorter
    firsts, offsets = np.array([s[2] for s in slots], np.int64), np.array([s[3] for s in slots], np.int64)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = base[batch.column(3).to_numpy()] + batch.column(5).to_numpy()
            slot = np.searchsorted(ends, place, side="right")
            sequence = firsts[slot] + place - (ends[slot] - counts[slot])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offsets[slot])], [*columns, "sequence_id", "offset"])

    assert np.array_equal(np.bincount(lengths, counts, size + 1).astype(np.int64), histogram) if len(slots) else True
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select(*columns, F.col("_rank").cast("long")).mapInArrow(run, schema)
