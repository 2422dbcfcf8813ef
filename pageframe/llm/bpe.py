"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

The transducer reads a piece byte by byte. For each prefix of the piece there is one
last token that its encoding can end with: the one that is compatible with the last
token of what comes before it. A state holds the last emitted token and, for each
prefix that some token of the vocabulary still continues, the tokens and bytes since.
Tokens that all these share are emitted, so the lookahead is bounded by the longest
token, and pieces that leave the same behind meet in one state. States and steps are
made when first met. Two tokens are compatible if the merges of their joined bytes
give just these two.

Decoding follows UTF-8 by a state machine over bytes, its steps composed per token:
text comes out as soon as its last byte is in, whatever tokens it was cut into.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageframe.llm.store import no_collection, over_batches

CACHED = 400_000
STATES = 100_000
PAIRS = 200_000
NONE = -1
_coders: dict[tuple[str, str], "Coder"] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file) if a}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Merge the adjacent pair of the lowest rank, leftmost first, until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


class State:
    """What a piece has been read to, up to the tokens emitted so far. Tokens are ids; 0 bytes of a token are node 0 of the trie.

    `open` lists (tokens since the last emitted one, trie node of the bytes after them) for the prefixes that may still
    matter: those that some token of the vocabulary continues, the longest rest first, and at the end the whole prefix.
    Pieces that leave the same of it share the state. `steps` holds per byte the state after it and the ids it emits.
    """

    __slots__ = ("last", "open", "steps")

    def __init__(self, last: int, open_: tuple[tuple[tuple[int, ...], int], ...]) -> None:
        self.last, self.open = last, open_
        self.steps: dict[int, tuple[State, tuple[int, ...]]] = {}


class Transducer:
    """Token ids of one piece. States and steps are determinised when first met and start anew at `STATES`."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.names = {i: token for token, i in ranks.items()}
        self.kids: dict[int, int] = {}  # node * 256 + byte: node
        self.tokens: list[int] = [NONE]
        self.inner: list[bool] = [True]
        for token, i in ranks.items():
            node = 0
            for byte in token:
                self.inner[node] = True
                edge = node << 8 | byte
                if edge not in self.kids:
                    self.kids[edge] = len(self.tokens)
                    self.tokens.append(NONE)
                    self.inner.append(False)
                node = self.kids[edge]
            self.tokens[node] = i
        self.pairs: dict[int, bool] = {}
        self.chains: dict[tuple[bytes, int], list[tuple[bytes, int]]] = {}
        self.states: dict[tuple, State] = {}
        self.start = State(NONE, (((), 0),))

    def parts(self, token: bytes) -> tuple[bytes, bytes]:
        """The two tokens whose merge makes this one."""
        left = [token[i : i + 1] for i in range(len(token))]
        while len(left) > 2:
            ranks = [self.ranks.get(a + b, 1 << 60) for a, b in zip(left, left[1:])]
            best = ranks.index(min(ranks))
            left[best : best + 2] = [left[best] + left[best + 1]]
        return left[0], left[1]

    def chain(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """What lies at the right (1) or left (0) end of the token while it is merged, from a byte up, each with the rank that ends it."""
        found = self.chains.get((token, side))
        if found is None:
            if len(token) == 1:
                found = [(token, 1 << 60)]
            else:
                inner = self.chain(self.parts(token)[side], side)
                found = [*inner[:-1], (inner[-1][0], self.ranks[token]), (token, 1 << 60)]
            self.chains[token, side] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """No pair across the border is merged before its sides are; at equal rank the merge further left comes first."""
        if left == NONE:
            return True
        pair = left << 32 | right
        found = self.pairs.get(pair)
        if found is None:
            ends, starts = self.chain(self.names[left], 1), self.chain(self.names[right], 0)
            i = j = 0
            found = True
            while True:
                (x, x_until), (y, y_until) = ends[i], starts[j]
                rank = self.ranks.get(x + y, 1 << 61)
                if rank < x_until and rank <= y_until:
                    found = False
                    break
                if i == len(ends) - 1 and j == len(starts) - 1:
                    break
                if x_until <= y_until:
                    i += 1
                else:
                    j += 1
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            self.pairs[pair] = found
        return found

    def step(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        """The state after `byte`, and the ids of the tokens that from there on all open prefixes share."""
        kids, tokens, inner, pairs = self.kids, self.tokens, self.inner, self.pairs
        last, whole, done, grown = state.last, None, (), []
        for path, node in state.open:  # longest rest first; only one token fits
            node = kids.get(node << 8 | byte)
            if node is None:
                continue
            if whole is None and (token := tokens[node]) != NONE:
                left = path[-1] if path else last
                fits = pairs.get(left << 32 | token) if left != NONE else True
                if self.compatible(left, token) if fits is None else fits:
                    whole = (*path, token)
            if inner[node]:
                grown.append((path, node))
        if whole is not None:
            grown.append((whole, 0))
        if grown and (first := grown[0][0]):
            shared = len(first)
            for path, _ in grown[1:]:
                while first[:shared] != path[:shared]:
                    shared -= 1
                if not shared:
                    break
            else:
                done = first[:shared]
                last = done[-1]
                grown = [(path[shared:], rest) for path, rest in grown]
        opened = tuple(grown)
        key = (last, opened)
        after = self.states.get(key)
        if after is None:
            if len(self.states) >= STATES:
                for old in self.states.values():  # states refer to each other in rings
                    old.steps.clear()
                self.states.clear()
                self.start.steps.clear()
            after = self.states[key] = State(last, opened)
        found = after, done
        state.steps[byte] = found
        return found

    def __call__(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        out: list[int] = []
        state = self.start
        for byte in piece:
            found = state.steps.get(byte)
            state, ids = self.step(state, byte) if found is None else found
            if ids:
                out += ids
        if not state.open or state.open[-1][1]:  # a vocabulary with tokens that merges don't reach
            return [ranks[t] for t in merged(piece, ranks)]
        out += state.open[-1][0]
        return out


class Pieces(dict):
    """Ids of the commonest pieces, at most `CACHED`."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.encode = Transducer(ranks)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = tuple(self.encode(piece.encode("utf-8", "surrogatepass")))
        if len(self) < CACHED:
            self[piece] = found
        return found


def _next_state(state: tuple[int, int, int], byte: int) -> tuple[int, int, int] | None:
    """UTF-8 by its ranges: (bytes still due, least and greatest next byte); None if the byte cannot follow."""
    due, low, high = state
    if due:
        return (due - 1, 0x80, 0xBF) if low <= byte <= high else None
    if byte < 0x80:
        return state
    if 0xC2 <= byte <= 0xDF:
        return (1, 0x80, 0xBF)
    if 0xE0 <= byte <= 0xEF:
        return (2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF)
    if 0xF0 <= byte <= 0xF4:
        return (3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF)
    return None


START = (0, 0x80, 0xBF)


class Decoder:
    """Incremental text of token ids; ill-formed bytes come out as U+FFFD, as the standard's maximal-subpart rule has it."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.tokens = {i: token for token, i in ranks.items()}
        self.whole = {i: t.decode() for i, t in self.tokens.items() if self._clean(t)}
        self.steps: dict[tuple[bytes, int], tuple[str, bytes]] = {}

    @staticmethod
    def _clean(token: bytes) -> bool:
        state: tuple[int, int, int] | None = START
        for byte in token:
            state = _next_state(state, byte)
            if state is None:
                return False
        return state[0] == 0

    def step(self, held: bytes, token: int) -> tuple[str, bytes]:
        """Text that is complete after `token`, and the bytes that wait for more."""
        found = self.steps.get((held, token))
        if found is not None:
            return found
        data, out, begin, state = held + self.tokens[token], [], 0, START
        i = 0
        while i < len(data):
            after = _next_state(state, data[i])
            if after is None:
                if i == begin:
                    i += 1
                out.append("�")
                begin, state = i, START
                continue
            i, state = i + 1, after
            if state[0] == 0:
                out.append(data[begin:i].decode())
                begin, state = i, START
        if len(self.steps) > STATES:
            self.steps.clear()
        self.steps[held, token] = "".join(out), data[begin:]
        return self.steps[held, token]

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        held = b""
        whole = self.whole
        for token in ids:
            if not held and token in whole:
                yield whole[token]
            else:
                text, held = self.step(held, token)
                yield text
        if held:
            yield "�"


class Coder:
    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = read_ranks(path)
        self.split = regex.compile(pattern).findall
        self.pieces = Pieces(self.ranks)
        self.decoder = Decoder(self.ranks)
        self.digits = {i: str(i) for i in self.ranks.values()}

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def decode(self, ids: Sequence[int]) -> str:
        whole = self.decoder.whole
        try:
            return "".join([whole[i] for i in ids])  # every token ends a character
        except KeyError:
            return "".join(self.decoder.stream(ids))


def coder(path: str, pattern: str) -> Coder:
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    return _coders[path, pattern]


def encoded(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids array<int>) of whole texts. A null text counts as empty and has no tokens."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        code = coder(vocabulary, pattern)
        with no_collection():
            ids = [code.encode(t or "") for t in batch.column(1).to_pylist()]
        columns = [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids"])

    return over_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("_text")), run, "doc_id long, n_tokens long, ids array<int>")


def decoded(ids: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        code = coder(vocabulary, pattern)
        texts = [code.decode(x or []) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return over_batches(ids.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the encoding and of what it decodes to, in one pass.

    A null text counts as empty: no tokens, digests of nothing. Very long texts are encoded whole; repeated rows give equal
    rows; a null doc_id stays null. Other columns are ignored, and an empty table stays empty.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        code = coder(vocabulary, pattern)
        counts, ids_hash, text_hash = [], [], []
        with no_collection():
            for content in batch.column(1).to_pylist():
                ids = code.encode(content or "")
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(",".join(map(code.digits.__getitem__, ids)).encode()).hexdigest())
                digest = hashlib.sha256()
                digest.update(code.decode(ids).encode())
                text_hash.append(digest.hexdigest())
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("_text"))
    return over_batches(source, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
