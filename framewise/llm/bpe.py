"""Byte-level BPE as a finite-state transducer, determinised as it is used.

A token sequence is the BPE encoding of its bytes just if every token and every pair of neighbours
encodes to itself. So each prefix of a piece has one last token, found from the last tokens of
shorter prefixes, and the encoding so far is a path in a tree of prefixes. A state holds the last
emitted token and the bytes behind it that later bytes may still regroup; reading a byte extends the
path, and what all possible starts of the next token have in common is emitted. The lookahead is
bounded by the longest token. Transitions are computed at first use and kept; the tables start anew
when they have grown to a set size, as lazy automata do. A piece that is a token as a whole, or that
was met before, needs no run of the machine: its tokens are known.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from framewise.llm.common import mapped

#: States kept before the tables start anew; half as many pieces and pairs of tokens. A state takes
#: about half a kilobyte, a piece a fifth.
MOST_STATES = 650_000


class Transducer:
    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES) -> None:
        self.ranks, self.most = ranks, most_states
        self.tokens = {i: b for b, i in ranks.items()}
        self.sizes = {i: len(b) for b, i in ranks.items()}
        #: Ids are packed into two bytes, or four for large vocabularies.
        self.kind = np.dtype("<u2" if max(ranks.values(), default=0) < 1 << 16 else "<u4")
        self.packed = {i: np.array([i], self.kind).tobytes() for i in self.tokens}
        self.starts = {b[:n] for b in ranks for n in range(1, len(b) + 1)}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        """Forget all states; 0 is the start of a piece.

        A state: the bytes held back; for each of their prefixes the last token (for the empty one
        the last token emitted, -1 at the start of a piece); the possible starts of the next token.
        """
        self.states: list[tuple[bytes, tuple[int, ...], tuple[int, ...]]] = [(b"", (-1,), (0,))]
        self.index: dict[bytes, int] = {self.name(-1, b""): 0}
        #: By state << 8 | byte: the next state; its complement, where something is emitted.
        self.steps: dict[int, int] = {}
        self.out: dict[int, bytes] = {}
        self.ends: dict[int, bytes] = {}

    @staticmethod
    def name(done: int, held: bytes) -> bytes:
        return done.to_bytes(4, "little", signed=True) + held

    def merged(self, piece: bytes) -> list[bytes]:
        """Plain merging to the last step but the one that gives the whole piece: lowest rank first, leftmost among equals."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 2:
            found = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merging gives this one; None for single bytes and tokens that no merging gives."""
        if token not in self.halves:
            parts = self.merged(self.tokens[token])
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def agrees(self, a: int, b: int) -> bool:
        """Whether tokens a and b (a -1: nothing) next to each other encode to themselves.

        They do not if, while both are being built, the right edge of the one and the left edge of
        the other form a token before either of them is merged further. So both are taken apart at
        the common border, the later merge first, and each pair of edges is looked at.
        """
        if self.sizes[b] > 1 and self.split(b) is None:
            return False
        if a < 0:
            return True
        tokens, most = self.tokens, len(self.tokens)
        while True:
            both = self.ranks.get(tokens[a] + tokens[b])
            if both is not None and both < most:
                return False
            # A merge of equal rank is done first where it stands further left.
            left, right = self.sizes[a] > 1, self.sizes[b] > 1
            if left and (a > b or not right):
                most, a = a, self.split(a)[1]
            elif right:
                most, b = b + 1, self.split(b)[0]
            else:
                return True

    def path(self, last: tuple[int, ...], to: int) -> bytes:
        """The tokens of the first `to` bytes held, packed."""
        out = []
        while to:
            out.append(self.packed[last[to]])
            to -= self.sizes[last[to]]
        return b"".join(out[::-1])

    def step(self, state: int, byte: int) -> tuple[int, bytes]:
        """The next state and what is emitted."""
        held, last, live = self.states[state]
        held += bytes((byte,))
        n, sizes, pairs, starts = len(held), self.sizes, self.pairs, self.starts
        token = -1
        more = []
        for j in live:
            tail = held[j:]
            if tail in starts:
                more.append(j)
            elif token >= 0:
                continue
            if token < 0 and (t := self.ranks.get(tail)) is not None:
                key = last[j], t
                ok = pairs.get(key)
                if ok is None:
                    if len(pairs) > self.most // 2:
                        pairs.clear()
                    ok = pairs[key] = self.agrees(*key)
                if ok:
                    token = t
        last = (*last, token)
        at = {*more, n}
        while len(at) > 1:  # back along the paths of all possible starts, to where they meet
            j = max(at)
            at.remove(j)
            at.add(j - sizes[last[j]])
        m = at.pop()
        out = b""
        if m:
            out = self.path(last, m)
            held, last, more = held[m:], last[m:], [j - m for j in more]
        live = (*more, n - m)
        name = self.name(last[0], held)
        to = self.index.get(name)
        if to is None:
            to = self.index[name] = len(self.states)
            self.states.append((held, last, live))
        if out:
            self.out[state << 8 | byte] = out
        self.steps[state << 8 | byte] = ~to if out else to
        return to, out

    def piece(self, piece: bytes) -> bytes:
        """The tokens of one piece, packed. A piece that is a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return self.packed[whole]
        if len(self.states) > self.most:
            self.reset()
        state, out, steps = 0, bytearray(), self.steps
        for byte in piece:
            at = state << 8 | byte
            to = steps.get(at)
            if to is None:
                state, emitted = self.step(state, byte)
                out += emitted
                if len(self.states) > 2 * self.most:  # within one very long piece: keep the present state only
                    kept = self.states[state]
                    self.reset()
                    steps = self.steps
                    self.states.append(kept)
                    self.index[self.name(kept[1][0], kept[0])] = state = 1
            elif to < 0:
                out += self.out[at]
                state = ~to
            else:
                state = to
        end = self.ends.get(state)
        if end is None:
            held, last, _ = self.states[state]
            end = self.ends[state] = self.path(last, len(held))
        return bytes(out) + end if out else end


class Codec:
    """Encodes texts, each match of pattern by itself, and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_states: int = MOST_STATES) -> None:
        self.machine = Transducer(ranks, most_states)
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        ids = sorted(self.machine.tokens)
        sizes = np.zeros(ids[-1] + 2, np.int64)
        sizes[np.array(ids) + 1] = [self.machine.sizes[i] for i in ids]
        #: The bytes of all tokens, and where each begins.
        self.begin = np.cumsum(sizes)
        self.bytes = np.frombuffer(b"".join(self.machine.tokens[i] for i in ids), np.uint8)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        out: list[bytes] = []
        known, add = self.known, out.append
        for piece in self.find(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.machine.piece(piece.encode())
                if len(piece) <= 48:
                    if len(known) >= self.machine.most // 2:
                        known.clear()
                    known[piece] = ids
            add(ids)
        return np.frombuffer(b"".join(out), self.machine.kind)

    def release(self) -> None:
        """Give the tables' memory back; a worker that is kept for other tasks should not hold it."""
        self.machine.reset()
        self.machine.pairs.clear()
        self.known.clear()

    def decode(self, ids: np.ndarray, at_once: int = 65_536) -> Iterator[str]:
        """The text in parts, from runs of ids; see Utf8."""
        utf8 = Utf8()
        for a in range(0, len(ids), at_once):
            part = ids[a : a + at_once].astype(np.int64)
            begin, size = self.begin[part], self.begin[part + 1] - self.begin[part]
            ends = np.cumsum(size)
            at = np.arange(ends[-1]) + np.repeat(begin - ends + size, size)
            yield utf8.feed(self.bytes[at].tobytes())
        yield utf8.close()


class Utf8:
    """UTF-8 bytes to text in parts. The state is the start of a character that is not complete yet.

    Bytes that are no UTF-8 become U+FFFD.
    """

    def __init__(self) -> None:
        self.rest = b""

    def feed(self, more: bytes) -> str:
        data = self.rest + more
        keep = 0
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b >= 0xC0:
                keep = back if back < (2 if b < 0xE0 else 3 if b < 0xF0 else 4) else 0
                break
            if b < 0x80:
                break
        self.rest = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.rest = self.rest, b""
        return rest.decode("utf-8", "replace")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def codec(path: str, pattern: str, most_states: int = MOST_STATES) -> Codec:
    """One for each vocabulary and Python worker; the file must be there on every executor."""
    return Codec(read_ranks(path), pattern, most_states)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encoded(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", most_states: int = MOST_STATES, keep_tables: bool = True
) -> DataFrame:
    """id_col, ids and n_tokens of every row's whole text; one pass, no shuffle.

    With keep_tables a worker that gets other tasks keeps what it has learnt, and the memory.

    Null texts count as empty and have no ids; null row ids stay null; repeated rows are rows of their
    own; very long texts are encoded whole; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern, most_states)
        for batch in batches:
            for part in slices(batch):
                found = [own.encode(t.as_py() or "").astype(np.int32) for t in part.column(1)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), ids, pa.array(np.diff(ends).astype(np.int64))], names=[id_col, "ids", "n_tokens"]
                )
        if not keep_tables:
            own.release()

    rows = docs.select(id_col, text_col)
    return mapped(rows, run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, ids array<int>, n_tokens long")


def decoded(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """id_col and text of every row of ids.

    Null ids count as none and give the empty text; null row ids stay null; repeated rows are rows of
    their own; very long lists are decoded in parts; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part in slices(batch, 500):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(["".join(own.decode(np.array(x.as_py() or (), np.int64))) for x in part.column(1)], pa.string())],
                    names=[id_col, "text"],
                )

    rows = tokens.select(id_col, "ids")
    return mapped(rows, run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, text string")


def slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def round_trip(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", most_states: int = MOST_STATES, keep_tables: bool = True
) -> DataFrame:
    """Encode every whole text, decode the ids, and give digests of both; one pass, no shuffle.

    ids_sha256 is over the ids as little-endian unsigned 32-bit integers, decoded_sha256 over the
    decoded text's UTF-8 bytes. Null texts count as empty; null row ids stay null; repeated rows are rows
    of their own; very long texts are encoded whole; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern, most_states)
        for batch in batches:
            for part in slices(batch):
                n, ids_sha, text_sha = [], [], []
                for text in part.column(1):
                    ids = own.encode(text.as_py() or "")
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    out = hashlib.sha256()
                    for x in own.decode(ids):
                        out.update(x.encode())
                    text_sha.append(out.hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        if not keep_tables:
            own.release()

    rows = docs.select(id_col, text_col)
    return mapped(
        rows,
        run,
        f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
