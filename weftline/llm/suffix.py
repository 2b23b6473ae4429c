"""Removal of repeated byte strings by suffix sorting in shards.

A byte goes when a string of LENGTH bytes that covers it also starts earlier (smaller id, or same text and earlier
start). Equal strings are brought together first, then suffix-sorted:

1. Of the GRAM-byte grams inside each window of LENGTH bytes, the one with the smallest hash is its anchor; equal windows have
   equal anchors at equal places, so a window can only repeat under the hash of its anchor. An occurrence of an anchor
   stands for the run of windows it anchors; its context is the bytes they cover. Occurrences (hash, fingerprint of
   the context, id, start) are the only thing of all texts that is shuffled, and those that meet no other end there.
2. Occurrences with the same hash and context repeat the first one entirely. Anchors with different contexts send
   these contexts to a shard each.
3. A shard induces the order of its suffixes: LMS substrings are sorted by induction, named, the string of names is
   ordered by doubling ranks, and L- and S-type suffixes follow from it, bucket by bucket, in queues of arrays. Neighbours
   with a common prefix of LENGTH or more are one string; all but its first occurrence are hits. A shard is worked on in
   blocks of BLOCK bytes; an anchor with more context than that writes each block's sorted tuples (string, id, start)
   to disk and merges them with a priority queue over the runs, carrying whether the common prefix reaches LENGTH.
4. Hits become runs of each text; whole copies of a text (equal bytes, larger id) go at once and never enter 1.

Step 2 trusts 128 bits of hash; everything after compares bytes.

Defined results: a null text is empty; texts below LENGTH bytes lose nothing; equal rows (same id and text) count as
one, so neither is earlier; rows with a null id lose nothing and take nothing from others; no rows give no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, read, ship
from .hashing import mix, powers, prefix

LENGTH, GRAM = 100, 24
CHUNK = 1_500_000
BLOCK = 4_000_000
#: Rows (ids, or spans of a text) broadcast at most; above it texts meet them by a shuffle.
BROADCAST_ROWS = 1_000_000


# ---- anchors


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    got = 1
    while got * 2 <= width:
        v = np.minimum(v[:-got], v[got:])
        got *= 2
    return np.minimum(v[: len(v) - (width - got)], v[width - got :]) if width > got else v


def anchors(raw: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(hash, fingerprint, text number, start in the text, windows) of every anchor of the texts that end at ``ends``."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, none, none
    sums = prefix(raw)
    _, down = powers(len(raw) + 1)
    g = mix((sums[gram:] - sums[:-gram]) * down[: len(raw) - gram + 1])
    low = np.uint64(0xFFFFFFFF)
    place = sliding_min((g & ~low) | np.arange(len(g), dtype=np.uint64), length - gram + 1) & low
    start = np.arange(len(place))
    owner = np.searchsorted(ends, start, side="right")
    ok = start + length <= ends[owner]
    start, place, owner = start[ok], place[ok].astype(np.int64), owner[ok]
    if not len(start):
        return none, none, none, none, none
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(start)))
    lo, own = start[at], owner[at]
    stop = lo + n - 1 + length
    mark = mix((sums[stop] - sums[lo]) * down[lo] + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    begin = np.concatenate([[0], ends[:-1]])
    return g[place[at]].view(np.int64), mark.view(np.int64), own, lo - begin[own], n


def _first_of_each(h, f, ids, at):
    """(kind, h, f, id, at): of equal contexts the first (kind 0), and the others, which are hits whatever else there is (kind 1).
    This map-side combine keeps a passage that very many texts share from meeting in one task."""
    by = np.lexsort((at, ids, f, h))
    h, f, ids, at = h[by], f[by], ids[by], at[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (f[1:] != f[:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    keep = new | (ids != ids[lead]) | (at != at[lead])  # a repeated row is neither earlier nor later
    cols = [(~new).astype(np.int32), h, f, ids.astype(np.int64), at]
    return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], names=["kind", "h", "f", "id", "at"])


def _anchors(batches):
    for batch in batches:
        for off in range(0, batch.num_rows, 512):
            part = batch.slice(off, 512)
            ids, texts = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_pylist()
            lo, size = 0, 0
            sizes = [len(t) for t in texts]
            for i in range(len(texts)):
                size += sizes[i]
                if size >= CHUNK or i == len(texts) - 1:
                    raws = [t.encode() for t in texts[lo : i + 1]]
                    ends = np.cumsum([len(r) for r in raws])
                    h, f, own, at, n = anchors(np.frombuffer(b"".join(raws), np.uint8), ends)
                    if len(h):
                        yield _first_of_each(h, f, ids[lo : i + 1][own], at << 7 | n)
                    lo, size = i + 1, 0


def _repeats(batches):
    """Sorted (kind, h, f, id, at) to hits (kind 1: an earlier equal context) and occurrences to compare (kind 2). Rows of kind 1
    are hits already."""
    last = None  # the last first-of-its-context row and whether it was given out
    prev = None  # the first row of the last context
    for batch in batches:
        known, h, f, i, at = (c.to_numpy() for c in batch.columns)
        if (known == 1).any():
            sure = known == 1
            yield pa.RecordBatch.from_arrays([pa.array(x[sure]) for x in (known, h, i, at)], names=["kind", "h", "id", "at"])
            h, f, i, at = h[~sure], f[~sure], i[~sure], at[~sure]
        if not len(h):
            continue
        new_h, new_f = np.ones(len(h), bool), np.ones(len(h), bool)
        new_h[1:] = h[1:] != h[:-1]
        new_f[1:] = new_h[1:] | (f[1:] != f[:-1])
        if prev is not None:
            new_h[0] = h[0] != prev[0]
            new_f[0] = new_h[0] or f[0] != prev[1]
        rep = np.flatnonzero(new_f)
        lead = np.maximum.accumulate(np.where(new_f, np.arange(len(h)), -1))
        first_i, first_at = i[lead], at[lead]
        if prev is not None:
            first_i[lead < 0], first_at[lead < 0] = prev[2], prev[3]
        prev = (h[-1], f[-1], first_i[-1], first_at[-1])
        hit = np.flatnonzero(~new_f & ((i != first_i) | (at != first_at)))
        give = np.zeros(len(h), bool)
        give[rep] = ~new_h[rep]
        if len(rep) > 1:
            give[rep[:-1]] |= ~new_h[rep[1:]]
        out = [np.concatenate([x[hit], x[give]]) for x in (h, i, at)]
        kind = np.concatenate([np.ones(len(hit), np.int32), np.full(int(give.sum()), 2, np.int32)])
        if last is not None and len(rep) and not last[1] and h[rep[0]] == last[0][0]:
            out = [np.append(x, y) for x, y in zip(out, last[0], strict=True)]
            kind = np.append(kind, np.int32(2))
        if len(rep):
            r = rep[-1]
            last = ((h[r], i[r], at[r]), bool(give[r]))
        if len(kind):
            yield pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(x, pa.int64()) for x in out)], names=["kind", "h", "id", "at"])


def _contexts(batches):
    for batch in batches:
        for i, text, hs, ats in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = text.encode()
            at = np.array(ats, np.int64)
            lo, n = at >> 7, at & 127
            ctx = [raw[a : a + k - 1 + LENGTH] for a, k in zip(lo.tolist(), n.tolist(), strict=True)]
            for s in range(0, len(ctx), 4096):
                e = slice(s, s + 4096)
                yield pa.RecordBatch.from_arrays([pa.array(hs[e], pa.int64()), pa.array([i] * len(ctx[e]), pa.int64()), pa.array(lo[e]), pa.array(ctx[e], pa.binary())], names=["h", "id", "lo", "ctx"])


# ---- induced sorting


def words8(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, first byte most significant; zeros past the end."""
    x = np.concatenate([raw, np.zeros(8, np.uint8)])
    out = np.zeros(len(raw) + 1, np.uint64)
    for k in range(8):
        out[: len(raw)] |= x[k : k + len(raw)].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def _spread(pending: list, places: np.ndarray, chars: np.ndarray) -> None:
    if len(places):
        order = np.argsort(chars, kind="stable")
        places, chars = places[order], chars[order]
        cut = np.flatnonzero(np.diff(chars)) + 1
        for part, c in zip(np.split(places, cut), chars[np.concatenate([[0], cut])].tolist(), strict=True):
            pending[c].append(part)


def induce(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the LMS suffixes ``lms`` in order (or, by their first bytes alone, all LMS substrings)."""
    none = np.zeros(0, np.int64)
    own: list = [[] for _ in range(256)]
    _spread(own, lms, t[lms])
    up: list = [[] for _ in range(256)]
    up[t[-1]].append(np.array([len(t) - 1]))  # what the end of the text induces
    left: list = []
    for c in range(256):
        got, front = [], np.concatenate(up[c]) if up[c] else none
        for pushed in (True, False):
            if not pushed:
                front = np.concatenate(own[c]) if own[c] else none
            while len(front):
                if pushed:
                    got.append(front)
                j = front[front > 0] - 1
                j = j[~s_type[j]]
                ch = t[j]
                same = ch == c
                _spread(up, j[~same], ch[~same])
                front = j[same] if pushed else none
        left.append(np.concatenate(got) if got else none)
    down: list = [[] for _ in range(256)]
    out: list = []
    for c in range(255, -1, -1):
        got, front = [], np.concatenate(down[c]) if down[c] else none
        for pushed in (True, False):
            if not pushed:
                front = left[c][::-1]
            while len(front):
                if pushed:
                    got.append(front)
                j = front[front > 0] - 1
                j = j[s_type[j]]
                ch = t[j]
                same = ch == c
                _spread(down, j[~same], ch[~same])
                front = j[same] if pushed else none
        out.append(np.concatenate([left[c], *(x[::-1] for x in got[::-1])]))
    return np.concatenate(out[::-1])


def suffix_order(t: np.ndarray) -> np.ndarray:
    """The suffix array of bytes (a suffix that is a prefix of another comes first)."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    d = np.sign(np.diff(t.astype(np.int16)))
    d = np.append(d, -1)
    at = np.where(d != 0, np.arange(n), n)
    s_type = d[np.minimum.accumulate(at[::-1])[::-1]] > 0
    is_lms = np.zeros(n, bool)
    is_lms[1:] = s_type[1:] & ~s_type[:-1]
    lms = np.flatnonzero(is_lms)
    if len(lms) < 2:
        return induce(t, s_type, lms)
    order = induce(t, s_type, lms)
    order = order[is_lms[order]]
    # equal LMS substrings (up to and with the next LMS place) get equal names
    nxt = np.empty(n + 1, np.int64)
    nxt[lms] = np.append(lms[1:] + 1, n + 1)
    size = nxt[order] - order
    w = words8(t)
    differ = np.ones(len(order), bool)
    differ[1:] = size[1:] != size[:-1]
    open_, k = np.flatnonzero(~differ), 0
    while len(open_):
        a, b = order[open_] + k, order[open_ - 1] + k
        left = np.minimum(8, size[open_] - k)
        shift = ((8 - left) * 8).astype(np.uint64)
        bad = (w[np.minimum(a, n)] >> shift) != (w[np.minimum(b, n)] >> shift)
        differ[open_[bad]] = True
        k += 8
        open_ = open_[~bad & (size[open_] > k)]
    name = np.cumsum(differ) - 1
    rank = np.empty(n, np.int64)
    rank[order] = name
    rank = rank[lms]
    h, m = 1, len(lms)
    while rank.max() < m - 1:  # recursion on the names, by doubling
        ahead = np.zeros(m, np.int64)
        ahead[:-h] = rank[h:] + 1 if h < m else 0
        _, rank = np.unique(rank * (m + 1) + ahead, return_inverse=True)
        h *= 2
    by_rank = np.empty(m, np.int64)
    by_rank[rank] = lms
    return induce(t, s_type, by_rank)


def equal_neighbours(raw: np.ndarray, at: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each window start but the first of a sorted list: whether the common prefix with the one before reaches ``length``."""
    w = words8(raw)
    same = np.ones(max(0, len(at) - 1), bool)
    for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        x = w[at + k]
        same &= x[1:] == x[:-1]
    return same


def block_classes(ids: np.ndarray, los: np.ndarray, ctx: list[bytes], length: int = LENGTH):
    """Windows of all contexts in suffix order: (raw, place, id, start in the text, class)."""
    raw = np.frombuffer(b"".join(ctx), np.uint8)
    sizes = np.array([len(c) for c in ctx])
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(ctx)), sizes)
    inside = np.arange(len(raw)) - begin[owner]
    window = inside <= sizes[owner] - length
    order = suffix_order(raw)
    order = order[window[order]]
    own = owner[order]
    cls = np.concatenate([[0], np.cumsum(~equal_neighbours(raw, order, length))]) if len(order) else order
    return raw, order, ids[own], los[own] + inside[order], cls


def later(cls: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Whether each row of a class is not its first by (id, place)."""
    by = np.lexsort((pos, ids, cls))
    first = np.ones(len(by), bool)
    first[1:] = cls[by][1:] != cls[by][:-1]
    lead_id, lead_pos = ids[by][first], pos[by][first]
    k = np.cumsum(first) - 1
    out = np.zeros(len(by), bool)
    out[by] = (ids[by] != lead_id[k]) | (pos[by] != lead_pos[k])
    return out


def merged(ids: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """Maximal runs of touching or overlapping spans."""
    by = np.lexsort((start, ids))
    ids, start, stop = ids[by], start[by], stop[by]
    if not len(ids):
        return ids, start, stop
    new = np.ones(len(ids), bool)
    shift = np.cumsum(np.concatenate([[0], ids[1:] != ids[:-1]])) * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + shift)
    new[1:] = (ids[1:] != ids[:-1]) | (start[1:] + shift[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return ids[at], start[at], np.maximum.reduceat(stop, at)


class Runs:
    """Sorted tuples on disk, merged by a priority queue; the folder goes when the merge ends."""

    def __init__(self):
        self.dir = tempfile.TemporaryDirectory()
        self.names: list[str] = []

    def add(self, raw: np.ndarray, place: np.ndarray, ids: np.ndarray, pos: np.ndarray, cls: np.ndarray) -> None:
        name = os.path.join(self.dir.name, str(len(self.names)))
        with open(name, "wb") as f:
            for s in range(0, len(place), 4096):
                e = slice(s, s + 4096)
                keys = [raw[p : p + LENGTH].tobytes() for p in place[e].tolist()]
                pickle.dump(list(zip(keys, ids[e].tolist(), pos[e].tolist(), strict=True)), f)
        self.names.append(name)

    def _read(self, name: str):
        with open(name, "rb") as f:
            while True:
                try:
                    rows = pickle.load(f)
                except EOFError:
                    return
                yield from rows

    def hits(self):
        """(id, place) of all rows but the first of each string."""
        with self.dir:
            for again in (False, True):  # the first pass finds each string's first place, in order; the second gives the rest
                leads = self._leads() if not again else None
                if not again:
                    path = os.path.join(self.dir.name, "leads")
                    with open(path, "wb") as f:
                        for lead in leads:
                            pickle.dump(lead, f)
                    continue
                with open(path, "rb") as f:
                    key = lead = None
                    for k, i, p in heapq.merge(*map(self._read, self.names), key=lambda r: r[0]):
                        if k != key:
                            key, lead = k, pickle.load(f)
                        if (i, p) != lead:
                            yield i, p

    def _leads(self):
        key = lead = None
        for k, i, p in heapq.merge(*map(self._read, self.names), key=lambda r: r[0]):
            if k != key:
                if key is not None:
                    yield lead
                key, lead = k, (i, p)
            elif (i, p) < lead:
                lead = (i, p)
        if key is not None:
            yield lead


def _spans_batch(ids, start, stop):
    ids, start, stop = merged(ids, start, stop)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(start, pa.int64()), pa.array(stop, pa.int64())], names=["id", "start", "stop"])


def _sort_shard(batches, block: int = BLOCK):
    """Contexts sorted by anchor to spans of hits."""
    held: list = []
    size, runs = 0, None

    def blocks(rows):
        return block_classes(np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), [r[3] for r in rows])

    def solve(rows):
        _, _, ids, pos, cls = blocks(rows)
        bad = later(cls, ids, pos)
        if bad.any():
            yield _spans_batch(ids[bad], pos[bad], pos[bad] + LENGTH)

    def drain(runs):
        got = []
        for r in runs.hits():
            got.append(r)
            if len(got) == 100_000:
                x = np.array(got, np.int64)
                yield _spans_batch(x[:, 0], x[:, 1], x[:, 1] + LENGTH)
                got = []
        if got:
            x = np.array(got, np.int64)
            yield _spans_batch(x[:, 0], x[:, 1], x[:, 1] + LENGTH)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= block and held:
                if row[0] != held[-1][0]:  # the block ends with its anchor
                    if runs:
                        runs.add(*blocks(held))
                        yield from drain(runs)
                        runs = None
                    else:
                        yield from solve(held)
                    held, size = [], 0
                elif held[0][0] == row[0]:  # one anchor fills the block: out to disk
                    runs = runs or Runs()
                    runs.add(*blocks(held))
                    held, size = [], 0
                else:  # give out what came before this anchor
                    cut = next(i for i, r in enumerate(held) if r[0] == row[0])
                    yield from solve(held[:cut])
                    held = held[cut:]
                    size = sum(len(r[3]) for r in held)
            elif runs and held and row[0] != held[-1][0] or runs and not held and row[0] != key:
                if held:
                    runs.add(*blocks(held))
                yield from drain(runs)
                runs, held, size = None, [], 0
            key = row[0]
            held.append(row)
            size += len(row[3])
    if runs:
        if held:
            runs.add(*blocks(held))
        yield from drain(runs)
    elif held:
        yield from solve(held)


# ---- the operator


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def repeated_spans(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """From (id, text): ids and hashes of whole copies (ci, cg), and (id, spans) of the other texts' hits."""
    named = docs.where("id is not null and text is not null").where(F.octet_length("text") >= LENGTH)
    sums = scratch.save(named.select("id", F.md5(F.col("text").cast("binary")).alias("g")))
    first = sums.groupBy("g").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    copies = scratch.save(sums.join(first, "g").where("id > first").select(F.col("id").alias("ci"), F.col("g").alias("cg")).distinct())
    whole = named.join(_small(copies), (named["id"] == copies["ci"]) & (F.md5(named["text"].cast("binary")) == copies["cg"]), "left_anti")
    rows = whole.mapInArrow(_anchors, "kind int, h long, f long, id long, at long")
    rows = rows.repartition(F.when(F.col("kind") == 1, F.xxhash64("id", "at")).otherwise(F.col("h"))).sortWithinPartitions("h", "f", "id", "at")
    met = scratch.save(rows.mapInArrow(_repeats, "kind int, h long, id long, at long"))
    ask = met.where("kind = 2").distinct().groupBy("id").agg(F.collect_list("h").alias("hs"), F.collect_list("at").alias("ats"))  # at most a text's own anchors
    cut = whole.join(ask, "id").select("id", "text", "hs", "ats").mapInArrow(_contexts, "h long, id long, lo long, ctx binary")
    cut = cut.repartition("h").sortWithinPartitions("h", "id", "lo")
    found = cut.mapInArrow(_sort_shard, "id long, start long, stop long")
    whole_hits = met.where("kind = 1").select("id", F.shiftright("at", 7).alias("start"), (F.shiftright("at", 7) + F.col("at").bitwiseAND(127) - 1 + LENGTH).alias("stop"))
    spans = whole_hits.unionByName(found).groupBy("id").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))  # at most a text's own anchors
    return copies, scratch.save(spans)


def _strip(batches):
    for batch in batches:
        for off in range(0, batch.num_rows, 512):
            part = batch.slice(off, 512)
            rows = []
            for i, text, gone, spans in zip(*(c.to_pylist() for c in part.columns), strict=True):
                raw = (text or "").encode()
                runs = []
                if gone:
                    runs = [(0, len(raw))]
                elif spans:
                    x = np.array([(s["start"], s["stop"]) for s in spans], np.int64)
                    _, a, b = merged(np.zeros(len(x), np.int64), x[:, 0], x[:, 1])
                    runs = list(zip(a.tolist(), b.tolist(), strict=True))
                kept, at = [], 0
                for a, b in runs:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                kept = b"".join(kept)
                rows.append((i, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "stop": b} for a, b in runs]))
            cols = list(zip(*rows, strict=True))
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), span]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept, spans) for each row; ``kept`` holds the remaining bytes."""
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "repeats")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    copies, spans = repeated_spans(docs, scratch)
    out = docs.join(_small(copies), (docs["id"] == copies["ci"]) & (F.md5(docs["text"].cast("binary")) == copies["cg"]), "left")
    spans = spans.withColumnRenamed("id", "si")
    near = F.broadcast(spans) if spans.select(F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0] <= BROADCAST_ROWS else spans
    out = out.join(near, out["id"] == near["si"], "left").select("id", "text", F.col("ci").isNotNull().alias("gone"), "spans")
    out = out.mapInArrow(_strip, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:long,stop:long>>")
    return out.withColumnRenamed("id", id_col)


def op10_repeats(spark, sf_dir):
    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
