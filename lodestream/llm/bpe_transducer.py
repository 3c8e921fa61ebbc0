"""Byte-level BPE by a finite-state transducer that is determinised as texts need it, and its streaming inverse.

A sequence of tokens is what the merges make of its bytes exactly if that holds for each token alone and each pair of neighbours, and every prefix of a text has one such sequence.
So the nondeterministic machine may begin a token at each byte, and end one where it fits the token before it. A state of the determinised machine is the set of
all tokens begun so far, which the longest of their beginnings names: there are no more states than beginnings of tokens, and each is built, with its transitions, when a text first reaches it.
Of the tokens that end at a byte, the one that fits what precedes it is the last of the prefix's sequence. A token is certain, and emitted, once the sequences
up to all bytes at which a begun token starts agree on it; no token is longer than the longest, which bounds the lookahead.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Bounds of what a worker keeps besides states: verdicts on pairs, and outputs of short pieces. Each is emptied when full, which changes no result.
PAIRS, PIECES, PIECE_CHARS = 1 << 19, 1 << 20, 64
#: After so many bytes of one piece the certain tokens are emitted.
WINDOW = 4096
#: Characters of a text above which its pieces are not listed at once.
LONG = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and their ids, a line each: base64, a space, the id. Ids are ranks: of two merges the lower id comes first."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


def merged(piece: bytes, ranks: dict[bytes, int], least: int = 1) -> list[bytes]:
    """What merging leaves of a short string: again and again the leftmost of the neighbours whose union has the lowest rank, as long as more than least parts are there."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > least:
        rank, i = min((ranks.get(a + b, len(ranks) + 256), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if parts[i] + parts[i + 1] not in ranks:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class State(dict):
    """Transitions: byte -> state, worked out at first use. node: of the longest beginning; depth: its length; ends: (length, token, verdicts on what precedes it) of the tokens that end here, longest first."""

    __slots__ = ("machine", "node", "depth", "ends", "shorter")

    def __init__(self, machine: Transducer, node: int, depth: int, shorter: State | None):
        self.machine, self.node, self.depth, self.shorter = machine, node, depth, shorter
        token = machine.token_at[node]
        here = ((depth, token, machine.pairs[token]),) if token >= 0 and machine.made_of(machine.bytes_of[token]) else ()
        self.ends = here + (shorter.ends if shorter is not None else ())

    def __missing__(self, byte: int) -> State:
        node = self.machine.child.get(self.node << 8 | byte)
        if node is None:
            found = self.shorter[byte]  # the root has a child for every byte
        elif (found := self.machine.states.get(node)) is None:
            found = self.machine.states[node] = State(self.machine, node, self.depth + 1, self.shorter[byte] if self.shorter is not None else self.machine.start)
        self[byte] = found
        return found


class Run:
    """One piece of text on its way through the machine: the last token of each prefix since the last emission."""

    def __init__(self, machine: Transducer):
        self.machine, self.state, self.last = machine, machine.start, [-1]

    def push(self, data: bytes) -> list[int]:
        """Takes more bytes and returns the tokens that are certain by now."""
        out: list[int] = []
        for lo in range(0, len(data), WINDOW):
            self.take(data[lo : lo + WINDOW])
            out += self.settle()
        return out

    def take(self, data: bytes) -> None:
        self.state = self.machine.walk(self.state, self.last, data)

    def settle(self) -> list[int]:
        """Emits what the sequences up to all starts of begun tokens share."""
        end = len(self.last) - 1
        at = set(range(max(0, end - self.state.depth), end + 1))
        while len(at) > 1:
            top = max(at)
            at.remove(top)
            at.add(top - self.machine.length[self.last[top]])
        cut = at.pop()
        out = self.machine.back(self.last, cut)
        del self.last[:cut]
        return out

    def finish(self) -> list[int]:
        return self.machine.back(self.last, len(self.last) - 1)


class Transducer:
    """Ids of pieces of text by ranks; every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.length = {rank: len(token) for token, rank in ranks.items()}
        if not all(bytes([b]) in ranks for b in range(256)):
            raise ValueError("each of the 256 bytes must be a token")
        # a trie of the tokens: (node << 8 | byte) -> node, 0 at the root; token_at: a node's token or -1
        self.child: dict[int, int] = {}
        self.token_at = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                if (node := self.child.get(key, 0)) == 0:
                    node = self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
            self.token_at[node] = rank
        self.halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.pairs: dict[int, dict[int, bool]] = {rank: {} for rank in self.bytes_of}  # by the second token
        self.n_pairs = 0
        self.states: dict[int, State] = {}
        self.start = self.states[0] = State(self, 0, 0, None)

    def made_of(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts whose merge is the last that makes the token; for a single byte itself and nothing; None where merging its bytes doesn't lead to it."""
        if (found := self.halves.get(token, b"")) == b"":
            parts = merged(token, self.ranks, 2)
            found = (token, b"") if len(token) == 1 else tuple(parts) if len(parts) == 2 and self.ranks.get(token) is not None else None
            self.halves[token] = found
        return found

    def walk(self, state: State, last: list[int], data: bytes) -> State:
        """Appends the last token of each longer prefix to last, and returns the state after data."""
        i, follows = len(last), self.may_follow
        for byte in data:
            state = state[byte]
            for n, token, verdicts in state.ends:
                if (fits := verdicts.get(last[i - n])) or fits is None and follows(last[i - n], token):
                    last.append(token)
                    break
            i += 1
        return state

    def back(self, last: list[int], i: int) -> list[int]:
        """The tokens up to prefix i."""
        out, length = [], self.length
        while i:
            token = last[i]
            out.append(token)
            i -= length[token]
        out.reverse()
        return out

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging leaves the pair of tokens alone; at the start, where a is -1, any token may stand.

        Merges on both sides of the border are undone, the latest first. The pair falls if at some time the two parts at the border could merge sooner than the merge undone last.
        """
        self.n_pairs += 1
        if self.n_pairs > PAIRS:
            for verdicts in self.pairs.values():
                verdicts.clear()
            self.n_pairs = 1
        x, y, ranks, found = self.bytes_of.get(a, b""), self.bytes_of[b], self.ranks, True
        before, left = len(ranks) + 256, False  # the time of the merge undone last, and whether it was on the left
        while x:
            rank = ranks.get(x + y)
            # of equal ranks the leftmost merge comes first, so one on the left precedes one at the border, which precedes one on the right
            if rank is not None and (rank < before or rank == before and not left):
                found = False
                break
            if len(x) == 1 and len(y) == 1:
                break
            left = len(y) == 1 or len(x) > 1 and ranks[x] > ranks[y]
            if left:
                before, x = ranks[x], self.made_of(x)[1]
            else:
                before, y = ranks[y], self.made_of(y)[0]
        self.pairs[b][a] = found
        return found

    def feed(self, parts: Iterable[bytes]) -> Iterator[list[int]]:
        """Tokens of one piece that comes in parts, each as soon as it is certain."""
        run = Run(self)
        for part in parts:
            run.take(part)
            yield run.settle()
        yield run.finish()

    def __call__(self, piece: bytes) -> list[int]:
        """Tokens of a whole piece: itself where it is a token, else the machine's output."""
        token = self.ranks.get(piece)
        if token is not None:
            return [token]
        if len(piece) > WINDOW:
            run = Run(self)
            return run.push(piece) + run.finish()
        last = [-1]
        self.walk(self.start, last, piece)
        return self.back(last, len(piece))


class Pieces(dict):
    """piece -> ids, which the machine works out; those of short pieces are kept for a while."""

    def __init__(self, machine: Transducer):
        self.machine = machine

    def __missing__(self, piece: str) -> tuple[int, ...]:
        out = tuple(self.machine(piece.encode()))
        if len(piece) <= PIECE_CHARS:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = out
        return out


class Utf8:
    """Incremental decoding. The state is what a character lacks: how many bytes, and between which bounds the next one must be; ill-formed parts become U+FFFD, one each."""

    def __init__(self) -> None:
        self.held, self.lacks, self.low, self.high = bytearray(), 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        """The characters that data completes."""
        if not self.lacks and data.isascii():
            return data.decode("ascii")
        out: list[str] = []
        for b in data:
            if self.lacks:
                if self.low <= b <= self.high:
                    self.held.append(b)
                    self.lacks, self.low, self.high = self.lacks - 1, 0x80, 0xBF
                    if not self.lacks:
                        out.append(self.held.decode())
                        self.held.clear()
                    continue
                self.reset(out)
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xF4:
                self.held.append(b)
                self.lacks = 1 if b < 0xE0 else 2 if b < 0xF0 else 3
                # no overlong forms, no surrogates, nothing beyond U+10FFFF
                self.low, self.high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(b, (0x80, 0xBF))
            else:
                out.append("�")
        return "".join(out)

    def reset(self, out: list[str]) -> None:
        out.append("�")
        self.held.clear()
        self.lacks, self.low, self.high = 0, 0x80, 0xBF

    def end(self) -> str:
        """What is left of a character that never ended."""
        out: list[str] = []
        if self.lacks:
            self.reset(out)
        return "".join(out)


class Whole(dict):
    """id -> the characters of its token; None where it begins or ends inside a character."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of

    def __missing__(self, i: int) -> str | None:
        machine = Utf8()
        text = machine.feed(self.bytes_of[i])
        self[i] = text = None if machine.lacks or "�" in text else text
        return text


class Decoder:
    """Text of ids as they come. Tokens of whole characters that meet no held bytes are looked up; all others go through the byte machine."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of, self.machine, self.whole = bytes_of, Utf8(), Whole(bytes_of)

    def feed(self, ids: Iterable[int]) -> str:
        out: list[str] = []
        whole, machine = self.whole, self.machine
        for i in ids:
            text = whole[i]
            if text is None or machine.lacks:
                text = machine.feed(self.bytes_of[i])
            out.append(text)
        return "".join(out)

    def feed_all(self, ids: list[int]) -> str:
        """The same for many ids, some at a time: where all are of whole characters, they are joined at once."""
        out = []
        for lo in range(0, len(ids), 256):
            some = ids[lo : lo + 256]
            texts = [] if self.machine.lacks else list(map(self.whole.__getitem__, some))
            out.append(self.feed(some) if not texts or None in texts else "".join(texts))
        return "".join(out)

    def end(self) -> str:
        return self.machine.end()


class Codec:
    """Both directions for one file of ranks and one splitting pattern."""

    def __init__(self, ranks: str, pattern: str):
        self.transducer, self.split = Transducer(read_ranks(ranks)), regex.compile(pattern)
        self.pieces, self.decoder = Pieces(self.transducer), Decoder(self.transducer.bytes_of)

    def encode(self, text: str) -> array:
        """The whole text's ids. The pieces of a very long text are taken one by one, so that it needs little more than its ids."""
        found = self.split.findall(text) if len(text) <= LONG else (m[0] for m in self.split.finditer(text))
        return array("i", chain.from_iterable(map(self.pieces.__getitem__, found)))

    def decode(self, ids: list[int]) -> str:
        return self.decoder.feed_all(ids) + self.decoder.end()


@lru_cache(2)
def codec(ranks: str, pattern: str) -> Codec:
    """A worker's machine, with what it has determinised so far; later tasks of the worker go on with it."""
    return Codec(ranks, pattern)


def _lists(found: list[array]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)])
    values = np.concatenate([np.empty(0, np.int32), *(np.frombuffer(x, np.int32) for x in found if x)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def encode_texts(docs: DataFrame, *, ranks: str, pattern: str, with_decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids[, decoded]): a row for each document, in which ids are those of the tiktoken library for the file ranks, and decoded is what the streaming decoder makes of them.

    ranks is a path that every executor can open. A text is split by pattern first, and each match encoded separately; what no match covers is left out, as in
    that library. Strings of special tokens are ordinary text. Null counts as empty, and an empty text has no ids. Rows are taken as they come, so repeated rows and
    repeated or null ids give rows of their own; no other columns are kept, so none can clash. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = codec(ranks, pattern)
        for b in batches:
            ids = [machine.encode(text or "") for text in b.column("_text").to_pylist()]
            columns = [b.column("_id"), _lists(ids)] + ([pa.array([machine.decode(x.tolist()) for x in ids], pa.string())] if with_decoded else [])
            yield pa.RecordBatch.from_arrays(columns, ["_id", "ids", "decoded"][: len(columns)])

    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, ids array<int>" + ", decoded string" * with_decoded)
    return out.withColumnRenamed("_id", id_col)


def decode_ids(encoded: DataFrame, *, ranks: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """encoded with a column decoded (an existing one is replaced): the text of the ids. Null ids give null, none an empty text; bytes that are no UTF-8 become U+FFFD. An id that the file lacks raises KeyError."""
    small_batches(encoded.sparkSession)
    kept = [c for c in encoded.columns if c.lower() != "decoded"]
    schema = encoded.select(*kept).schema.add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = codec(ranks, pattern)
        for b in batches:
            texts = pa.array([None if x is None else machine.decode(x) for x in b.column(ids_col).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], [*b.schema.names, "decoded"])

    return encoded.select(*kept).mapInArrow(run, schema)
