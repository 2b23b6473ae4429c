"""Token counts by a compiled finite-state tokenizer.

Two automata read each text. The splitter works on character classes: the places where pieces begin depend on the
class of a character, on its neighbours' and on the run of white space it stands in, so the maps of all chunks of a
batch compose in a few array scans. The counter is a deterministic transducer over the bytes of a piece. Its state
keeps, for every start from which a vocabulary entry may still grow, the place in the vocabulary's trie and the token
that ends there; each transition is annotated with the change of the number of tokens that the prefix encodes to
(which may fall below zero when a merge joins tokens). States and transitions are compiled when a text first needs
them, checked against the tokenizer's merge model, and kept for the worker's life. Pieces reset the transducer, so
every piece is a chunk whose map has one value; all pieces of a batch advance together and their counts are summed
by text.

An entry grows a prefix only when it and the token before it encode to just these two tokens; for byte-pair merges
exactly one entry does. A transition where that fails sends the piece to the merge model itself.

Defined results: a null or empty text has no bytes and no tokens; the special token's string counts one token and splits
the text, as the library does by default; equal rows get equal counts; no rows give no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, ship

VOCABULARY = "byte_bpe_50k.json"
CHUNK_CHARS = 2_000_000
#: Compiled states kept by a worker (a table of about 130 MB). Pieces that would need more go to the merge model itself.
MAX_STATES = 130_000
LETTER, NUMBER, OTHER, SPACE, END, UNKNOWN = 0, 1, 2, 3, 4, 255
SCALAR_LANES = 24
#: Bytes of a chunk of a long piece; rounds in which chunks' maps are worked out for every state that may stand before them.
CHUNK, SPECULATE = 64, 8


def _byte_names() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary file."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    names, extra = [], 0
    for b in range(256):
        if b in plain:
            names.append(chr(b))
        else:
            names.append(chr(256 + extra))
            extra += 1
    return names


class Counter:
    """Counts the tokens of texts for one byte-level vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model, self.names = self.tok.model, _byte_names()
        back = {c: b for b, c in enumerate(self.names)}
        self.special = [a.content for a in self.tok.get_added_tokens_decoder().values()]
        self.tokens: dict[int, bytes] = {}
        self.trie: list[dict[int, int]] = [{}]
        self.entry: list[int] = [-1]
        for word, i in self.tok.get_vocab(with_added_tokens=False).items():
            raw = bytes(back[c] for c in word)
            self.tokens[i] = raw
            at = 0
            for b in raw:
                if b not in self.trie[at]:
                    self.trie.append({})
                    self.entry.append(-1)
                    self.trie[at][b] = len(self.trie) - 1
                at = self.trie[at][b]
            self.entry[at] = i
        self.pairs: dict[tuple[int, int], bool] = {}
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self.ids: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.column, self.columns, self.width = np.full(256, -1, np.int64), 0, 128
        self.next = np.full((1024, self.width), -1, np.int32)
        self.gain = np.zeros((1024, self.width), np.int8)
        self.dead = self._id(("dead",))
        self.next[self.dead] = self.dead
        self.first = self._id(((0, -1, 0),))

    def _id(self, key: tuple) -> int:
        i = self.ids.get(key)
        if i is None:
            i = self.ids[key] = len(self.keys)
            self.keys.append(key)
            if i >= len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.gain = np.concatenate([self.gain, np.zeros_like(self.gain)])
        return i

    def _columns(self, raw: np.ndarray) -> np.ndarray:
        """The table's column of each byte; bytes get columns as they first appear."""
        new = np.flatnonzero((np.bincount(raw, minlength=256) > 0) & (self.column < 0))
        self.column[new] = self.columns + np.arange(len(new))
        self.columns += len(new)
        if self.columns > self.width:
            more = ((0, 0), (0, 256 - self.width))
            self.next, self.gain, self.width = np.pad(self.next, more, constant_values=-1), np.pad(self.gain, more), 256
            self.next[self.dead] = self.dead
        self.bytes = np.argsort(np.where(self.column < 0, 999, self.column))[: self.columns].tolist()
        return self.column[raw]

    def encode(self, raw: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize("".join(self.names[b] for b in raw))]

    def _fits(self, before: int, t: int) -> bool:
        ok = self.pairs.get((before, t))
        if ok is None:
            want = [t] if before < 0 else [before, t]
            ok = self.pairs[before, t] = self.encode(b"".join(self.tokens[x] for x in want)) == want
        return ok

    def compile(self, state: int, column: int) -> None:
        kept, found, byte = [], [], self.bytes[column]
        for node, before, n in self.keys[state]:
            child = self.trie[node].get(byte)
            if child is None:
                continue
            t = self.entry[child]
            if t >= 0 and self._fits(before, t):
                found.append((t, n + 1))
            if self.trie[child]:
                kept.append((child, before, n))
        t, n = found[0] if found else (-1, 0)
        key = (*((c, b, k - n) for c, b, k in kept), (0, t, 0))
        if len(found) != 1 or not -128 < n < 128 or len(self.keys) >= MAX_STATES and key not in self.ids:
            self.next[state, column] = self.dead
            return
        to = self._id(key)
        self.next[state, column], self.gain[state, column] = to, n

    def _one(self, raw: list[int], state: int, n: int) -> tuple[int, int]:
        nxt, gain = self.next, self.gain
        for b in raw:
            if nxt[state, b] < 0:
                self.compile(state, b)
                nxt, gain = self.next, self.gain
            n += int(gain[state, b])
            state = int(nxt[state, b])
        return state, n

    def _run(self, cols: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, change of the count) after cols[start : start + size] from each state; all runs advance together."""
        order = np.argsort(-size, kind="stable")
        at, left = start[order], size[order]
        state, count = state[order].astype(np.int32), np.zeros(len(at), np.int64)
        live, j = len(at), 0
        more = -left
        while live:
            live = int(np.searchsorted(more, -j, side="left"))
            if live <= SCALAR_LANES:
                for k in range(live):
                    state[k], count[k] = self._one(cols[at[k] + j : at[k] + left[k]].tolist(), int(state[k]), int(count[k]))
                break
            cell = state[:live].astype(np.int64) * self.width + cols[at[:live] + j]
            to = self.next.ravel().take(cell)
            lost = np.flatnonzero(to < 0)
            if len(lost):
                for c in np.unique(cell[lost]).tolist():
                    self.compile(c // self.width, c % self.width)
                to[lost] = self.next.ravel().take(cell[lost])
            count[:live] += self.gain.ravel().take(cell)
            state[:live] = to
            j += 1
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], count[back]

    def _composed(self, cols: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, count) after each long piece, whose chunks are run at the same time.

        A chunk's map takes the state before it to the state after it and the change of the count. It is worked out for the
        states that may stand before the chunk: at first the one at the beginning of a piece, then those that the maps
        of the chunk before lead to, until nothing is missing (after SPECULATE rounds only what the pieces themselves
        reach). Maps are then composed by pointer jumping, a parallel prefix scan over the chunks.
        """
        n = -(-size // CHUNK)
        first = np.cumsum(n) - n
        inside = np.arange(int(n.sum())) - np.repeat(first, n)
        lo = np.repeat(start, n) + inside * CHUNK
        length = np.minimum(CHUNK, np.repeat(start + size, n) - lo)
        ends = np.zeros(len(lo), bool)
        ends[first + n - 1] = True
        keys = exits = gains = np.zeros(0, np.int64)  # of the maps' entries: chunk and state before, sorted; state after; change
        need = (np.arange(len(lo)) << 32) | self.first
        turn = 0
        while len(need):
            chunk = need >> 32
            state, gain = self._run(cols, lo[chunk], length[chunk], need & 0xFFFFFFFF)
            keys, exits, gains = np.concatenate([keys, need]), np.concatenate([exits, state]), np.concatenate([gains, gain])
            order = np.argsort(keys)
            keys, exits, gains = keys[order], exits[order], gains[order]
            chunk = keys >> 32
            follows = np.where(ends[chunk], -1, ((chunk + 1) << 32) | exits)
            place = np.minimum(np.searchsorted(keys, follows), len(keys) - 1)
            there = (follows >= 0) & (keys[place] == follows)
            missing = (follows >= 0) & ~there
            turn += 1
            if turn >= SPECULATE and missing.any():  # from here on only the pieces' own ways
                at = np.searchsorted(keys, (first << 32) | self.first)
                while there[at].any():
                    at = np.where(there[at], place[at], at)
                missing = np.zeros(len(keys), bool)
                missing[at] = (follows[at] >= 0) & ~there[at]
            need = np.unique(follows[missing])
        jump = np.where(there, place, np.arange(len(keys)))
        total = np.where(there, gains, 0)  # of all but the last map of a way
        while (jump[jump] != jump).any():
            total, jump = total + total[jump], jump[jump]
        own = np.searchsorted(keys, (first << 32) | self.first)
        return exits[jump[own]], total[own] + gains[jump[own]]

    def pieces(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of each piece raw[start : start + size]."""
        cols = self._columns(raw)
        state, count = np.empty(len(start), np.int64), np.empty(len(start), np.int64)
        long = size > 2 * CHUNK
        for which, run in ((~long, lambda a, b: self._run(cols, a, b, np.full(len(a), self.first))), (long, lambda a, b: self._composed(cols, a, b))):
            if which.any():
                state[which], count[which] = run(start[which], size[which])
        for k in np.flatnonzero(state == self.dead).tolist():
            count[k] = len(self.encode(raw[start[k] : start[k] + size[k]].tobytes()))
        return count

    def _learn(self, points: np.ndarray) -> None:
        """Asks the tokenizer's own splitter for the class of characters not met before."""
        split = self.tok.pre_tokenizer.pre_tokenize_str
        for p in points.tolist():
            c = chr(p)
            self.kinds[p] = next((k for k, a in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(split(a + c)) == 1), SPACE)

    def count(self, texts: list[str]) -> np.ndarray:
        n = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, t in enumerate(texts):
            if any(s in t for s in self.special):
                for s in self.special:
                    n[i] += t.count(s)
                    t = t.replace(s, "\0cut\0") if len(self.special) > 1 else t
                for x in t.split("\0cut\0" if len(self.special) > 1 else self.special[0]):
                    parts.append(x)
                    owner.append(i)
            else:
                parts.append(t)
                owner.append(i)
        if not parts:
            return n
        joined = "\n".join(parts) + "\n"
        cp = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        raw = np.frombuffer(joined.encode("utf-8"), np.uint8)
        ends = np.cumsum(np.fromiter((len(x) + 1 for x in parts), np.int64, len(parts))) - 1
        kind = self.kinds[cp]
        if (new := kind == UNKNOWN).any():
            self._learn(np.unique(cp[new]))
            kind = self.kinds[cp]
        kind[ends] = END
        start = np.ones(len(cp), bool)
        start[1:] = kind[1:] != kind[:-1]
        start[ends] = True
        # the last of a run of white space leaves the run when something follows; a blank joins what follows
        i = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != END)) + 1
        start[i - 1] = True
        start[i] = cp[i - 1] != 32
        # 's 't 'm 'd 're 've 'll where a piece begins
        i = np.flatnonzero((cp == 39) & start & (kind != END))
        if len(i):
            one = cp[np.minimum(i + 1, len(cp) - 1)]
            two = cp[np.minimum(i + 2, len(cp) - 1)]
            real = kind[np.minimum(i + 1, len(cp) - 1)] == LETTER
            short = real & np.isin(one, [115, 116, 109, 100])
            long = real & ((one == 114) & (two == 101) | (one == 118) & (two == 101) | (one == 108) & (two == 108))
            start[i[short | long] + 1] = False
            start[i[short] + 2] = True
            start[i[long] + 3] = True
        width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        offset = np.cumsum(width) - width
        at = np.flatnonzero(start)
        size = np.diff(np.append(offset[at], len(raw)))
        real = kind[at] != END
        at, size = at[real], size[real]
        got = self.pieces(raw, offset[at], size)
        np.add.at(n, np.asarray(owner)[np.searchsorted(ends, at)], got)
        return n


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def chunks(texts: list[str], most: int):
    """(from, to) of runs of texts of about ``most`` characters."""
    lo, n = 0, 0
    for i, t in enumerate(texts):
        if n and n + len(t) > most:
            yield lo, i
            lo, n = i, 0
        n += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row; ``vocabulary`` is a file name known to public_tokenizers or a path."""
    ship(docs.sparkSession)

    def run(batches):
        import public_tokenizers

        own = counter(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
        for batch in batches:
            for off in range(0, batch.num_rows, 512):
                part = batch.slice(off, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                got = np.zeros(len(texts), np.int64)
                for lo, hi in chunks(texts, CHUNK_CHARS):
                    got[lo:hi] = own.count(texts[lo:hi])
                size = pa.array([len(t.encode()) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(got, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark, sf_dir):
    return count_tokens(read(spark, sf_dir, "documents"))
