"""Document log-likelihood by a gated recurrent language model with a class-factored softmax.

Counts cover the whole corpus: every training text's words are counted by hash, the counts of all words stay a
distributed table, and the HEAD most frequent words (a fixed bound) are also sent to the workers. A word's
probability is P(class | state) * P(word | class, state). Classes are few: clusters of frequent words that share
documents, split by frequency, one class for all words outside the head, and the end of a text. Within a class each word
has the weight (c + 1) * exp(v . state), with c its count over the corpus and v learnt for the INNER most frequent words,
zero for the others: a softmax whose starting point is the corpus, and in which the words without a vector are one sum. Words
outside the head get their c by a join on the hash, and nothing is dropped.

The clusters come from sums over all training texts: each text adds its signs (SIGNS bits of a hash of id and text) to
its words, so words that share texts get like vectors; the sums meet in a shuffle by word.

The recurrent net (numpy, float32) reads the previous word, or its class when the word is not among the INPUTS most
frequent. All training texts train it, whole, in ROUNDS rounds: every task goes by truncated backpropagation over
its part of the round's texts (those with the round's remainders of a hash of the id), and the weights of all tasks are
averaged by their tokens. A worker packs texts into LANES streams. In scoring, the state is carried from window to window
through a whole text and cleared where the next begins; in training it is also cleared after each STRETCH tokens.

Defined results: a null or empty text is one end token; equal rows get equal counts and base scores; with an empty
training part counts are 0 and the classes' shares stay as initialised; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import copy
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, read, ship
from .hashing import mix, runs, words
from .learn import remainder

HEAD = 1 << 18
INPUTS = 2048
CLUSTERS = 24
INNER = 512
SIGNS = 48
HIDDEN = 24
WINDOW = 24
#: Head words seen less often share the class of the words outside the head, so that class is learnt in small corpora too.
LEAST = 2
LANES, SCORE_LANES = 256, 192
#: Small training parts are passed over up to PASSES times, until this many tokens are read; larger ones once.
TRAIN_TOKENS, PASSES = 1_600_000, 8
ROUNDS = 4
#: Tokens that a task trains on at least, and gathers clusters from at least, where partitions are smaller; tokens held
#: at a time in training, and the longest piece of a text in one stream.
TASK_TOKENS, GATHER_TOKENS, BLOCK, STRETCH = 1_600_000, 8_000_000, 400_000, 1024
FLUSH = 1_500_000
#: Tokens that a task takes up at a time in scoring, and steps whose classes and words are looked up together.
SCORE_TOKENS, AT_ONCE = 1_000_000, 128
#: Bits of a hash by which the head is entered; the largest sum that has room beside two others in a float.
LEADING, LIMB = 19, (1 << 17) - 1


# ---- counts


def _counts(batches):
    seen, count, own_n = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0

    def batch_of():
        return pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(count)], names=["w", "c"])

    held: list = []
    n = 0
    for batch in batches:
        for off in range(0, batch.num_rows, 512):
            texts = [t or "" for t in batch.slice(off, 512).column(0).to_pylist()]
            for lo, hi in runs(texts):
                h, _ = words(texts[lo:hi])
                held.append(h)
                n += len(h)
            if n >= FLUSH:
                seen, count = _merge(seen, count, held)
                held, n = [], 0
                if len(seen) > FLUSH:
                    yield batch_of()
                    seen, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    seen, count = _merge(seen, count, held)
    if len(seen):
        yield batch_of()


def _merge(seen, count, held):
    h, c = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
    if not len(seen):
        return h, c.astype(np.int64)
    both, back = np.unique(np.concatenate([seen, h]), return_inverse=True)
    return both, np.bincount(back, weights=np.concatenate([count, c])).astype(np.int64)


# ---- the net


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def sums_by(keys: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    """Of each key below ``n`` the sum of its columns, a row for each key."""
    return np.stack([np.bincount(keys, x, n) for x in columns], 1).astype(columns.dtype)


class Inside:
    """The softmax within each class: a member u of the class has the weight (count + 1) * exp(v_u . state), where v_u is learnt
    for the INNER most frequent words and zero for others, whose counts are summed up in ``rest``."""

    def __init__(self, z: np.ndarray, cls: np.ndarray, weight: np.ndarray):
        """Of all classes the sums of count + 1; the class and the count + 1 of each frequent word."""
        self.order = np.argsort(cls, kind="stable")
        self.cuts = np.searchsorted(cls[self.order], np.arange(len(z) + 1))
        self.log = np.log(np.maximum(weight[self.order], 1.0))
        own = np.bincount(cls, weight, len(z)) if len(cls) else np.zeros(len(z))
        self.rest, self.z = np.maximum(0.0, z - own), np.log(z)

    def __call__(self, v: np.ndarray, hs: np.ndarray, y: np.ndarray, row: np.ndarray, slopes: bool = False):
        """ln of exp(v_w . state) / Z(class, state) of each token, given its state (a column of ``hs``), its class ``y`` and its place
        ``row`` among the frequent words (-1 for others); with ``slopes`` also the slopes of the sum for v and for the states."""
        out = -self.z[y]
        dv, dh = np.zeros_like(v), np.zeros_like(hs) if slopes else None
        by = np.argsort(y.astype(np.int16), kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(y, minlength=len(self.z)))])
        for c in np.flatnonzero((np.diff(self.cuts) > 0) & (np.diff(cuts) > 0)).tolist():
            lo, hi, at = self.cuts[c], self.cuts[c + 1], by[cuts[c] : cuts[c + 1]]
            own, state = v[lo:hi], hs[:, at]
            a = own @ state
            r = row[at] - lo
            there = np.flatnonzero(r >= 0)
            mine = np.zeros(len(at), a.dtype)
            mine[there] = a[r[there], there]
            a += self.log[lo:hi, None].astype(a.dtype)
            top = np.maximum(a.max(axis=0), np.log(max(self.rest[c], 1e-30)).astype(a.dtype))
            a -= top
            np.exp(a, out=a)
            total = a.sum(axis=0) + (self.rest[c] * np.exp(-top)).astype(a.dtype)
            out[at] = mine - top - np.log(total)
            if slopes:
                a /= -total
                a[r[there], there] += 1
                dv[lo:hi] = a @ state.T
                dh[:, at] = own.T @ a
        return (out, dv, dh) if slopes else out


class Net:
    """A gated recurrent net over input ids, with a softmax over classes and one within each class. States are columns, a lane
    each, so that all work on them runs along memory."""

    def __init__(self, inputs: int, classes: int, hidden: int = HIDDEN, seed: int = 7, inside: Inside | None = None, dtype=np.float32):
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) * 0.5 / math.sqrt(s[0])).astype(dtype)
        inside = inside or Inside(np.ones(classes), np.zeros(0, int), np.zeros(0))
        self.h, self.past, self.inside = hidden, None, inside
        self.p = {
            "e": (r.standard_normal((inputs, hidden)) * 0.3).astype(dtype), "w": f(hidden, 3 * hidden), "u": f(hidden, 3 * hidden), "b": np.zeros(3 * hidden, dtype),
            "o": f(hidden, classes), "ob": np.zeros(classes, dtype), "v": np.zeros((len(inside.order), hidden), dtype),
        }

    def step(self, h: np.ndarray, x: np.ndarray):
        """(state, update gate, reset gate, candidate, recurrent part) after inputs ``x`` already times w plus b."""
        k = self.h
        hu = self.p["u"].T @ h
        zr = x[: 2 * k] + hu[: 2 * k]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        z, r, hu = zr[:k], zr[k:], hu[2 * k :]
        n = r * hu
        n += x[2 * k :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, z, r, n, hu

    def logs(self, h: np.ndarray) -> np.ndarray:
        """ln P(class | state), a column for each state."""
        a = self.p["o"].T @ h
        a += self.p["ob"][:, None]
        a -= a.max(axis=0)
        a -= np.log(np.exp(a).sum(axis=0))
        return a

    def log_of(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """ln P(class | state) of one class for each state."""
        a = self.p["o"].T @ h
        a += self.p["ob"][:, None]
        top = a.max(axis=0)
        own = a[y, np.arange(len(y))] - top
        a -= top
        return own - np.log(np.exp(a, out=a).sum(axis=0))

    def slopes(self, x: np.ndarray, y: np.ndarray, row: np.ndarray, fresh: np.ndarray, h: np.ndarray):
        """(loss, tokens, slopes of the mean loss, state) of a window of (time, lane) arrays that begins with state ``h``."""
        p, k = self.p, self.h
        e = p["e"][x]
        xw = np.matmul(p["w"].T, e.transpose(0, 2, 1)) + p["b"][:, None]
        past, cache = [], []
        for t in range(len(x)):
            if fresh[t].any():
                h = np.where(fresh[t], h.dtype.type(0), h)
            past.append(h)
            h, *c = self.step(h, xw[t])
            cache.append((h, *c))
        hs = np.concatenate([c[0] for c in cache], axis=1)
        yy = y.reshape(-1)
        ok = np.flatnonzero(yy >= 0)
        n, live, seen = max(1, len(ok)), yy[ok], hs if len(ok) == len(yy) else hs[:, ok]
        lp = self.logs(seen)
        own, dv, dh = self.inside(p["v"], seen, live, row.reshape(-1)[ok], True)
        loss = -float(lp[live, np.arange(len(ok))].sum(dtype=float) + own.sum(dtype=float))
        d = np.exp(lp, out=lp)
        d[live, np.arange(len(ok))] -= 1
        d /= n
        g = {"o": seen @ d.T, "ob": d.sum(1), "u": np.zeros_like(p["u"]), "w": np.zeros_like(p["w"]), "v": dv / -n}
        out = p["o"] @ d
        dh /= n
        out -= dh
        if len(ok) != len(yy):
            full = np.zeros_like(hs)
            full[:, ok] = out
            out = full
        lanes_n = x.shape[1]
        dx, dh = np.empty_like(xw), np.zeros_like(h)
        du = np.empty((3 * k, lanes_n), h.dtype)
        for t in range(len(x) - 1, -1, -1):
            _, z, r, c, hu = cache[t]
            dh += out[:, t * lanes_n : (t + 1) * lanes_n]
            da, dz, dr = dx[t, 2 * k :], dx[t, :k], dx[t, k : 2 * k]
            np.subtract(past[t], c, out=dz)
            dz *= dh
            dz *= z
            np.subtract(1, z, out=da)
            dz *= da
            da *= dh
            c *= c
            np.subtract(1, c, out=c)
            da *= c
            np.multiply(da, hu, out=dr)
            dr *= r
            np.multiply(da, r, out=du[2 * k :])
            np.subtract(1, r, out=r)
            dr *= r
            du[: 2 * k] = dx[t, : 2 * k]
            g["u"] += past[t] @ du.T
            g["w"] += e[t].T @ dx[t].T
            dh *= z
            dh += p["u"] @ du
            if fresh[t].any():
                dh[:, fresh[t]] = 0
        g["b"] = dx.sum((0, 2))
        g["e"] = sums_by(x.reshape(-1), np.matmul(p["w"], dx).transpose(1, 0, 2).reshape(k, -1), len(p["e"]))
        return loss, len(ok), g, h

    def train(self, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, epochs: int = 2, window: int = WINDOW, rate: float = 0.004, rows: np.ndarray | None = None) -> list[float]:
        """Truncated backpropagation through windows of (time, lane) arrays; target -1 is padding."""
        p = self.p
        rows = np.full_like(targets, -1) if rows is None else rows
        if self.past is None:
            self.past = {n: np.zeros_like(x) for n, x in p.items()}, {n: np.zeros_like(x) for n, x in p.items()}, 0
        m, v, at = self.past
        losses = []
        for _ in range(epochs):
            h, total, seen = np.zeros((self.h, inputs.shape[1]), p["u"].dtype), 0.0, 0
            for s in range(0, len(inputs), window):
                part = slice(s, s + window)
                loss, n, g, h = self.slopes(inputs[part], targets[part], rows[part], fresh[part], h)
                total += loss
                seen += n
                norm = math.sqrt(sum(float(np.vdot(q, q)) for q in g.values()))
                at += 1
                for name, q in g.items():
                    q *= min(1.0, 1.0 / (norm + 1e-9))
                    m[name] *= 0.9
                    m[name] += 0.1 * q
                    q *= q
                    v[name] *= 0.999
                    v[name] += 0.001 * q
                    p[name] -= (rate * math.sqrt(1 - 0.999**at) / (1 - 0.9**at)) * m[name] / (np.sqrt(v[name]) + 1e-7)
            losses.append(total / max(1, seen))
        self.past = m, v, at
        return losses


def lanes(sizes: np.ndarray, n: int) -> list[list[int]]:
    """Texts dealt to ``n`` streams of about equal length."""
    n = max(1, min(n, len(sizes)))
    out: list[list[int]] = [[] for _ in range(n)]
    order = np.argsort(-sizes, kind="stable").tolist()
    import heapq

    heap = [(0, k) for k in range(n)]
    for i in order:
        load, k = heap[0]
        out[k].append(i)
        heapq.heapreplace(heap, (load + int(sizes[i]), k))
    return out


class Model:
    """Head words (sorted hashes), their counts, classes and input ids, the classes' sums, and the net."""

    def __init__(self, head: np.ndarray, count: np.ndarray, n_all: int, v_all: int, ends: int):
        order = np.argsort(head)
        self.head, self.count = head[order], count[order]
        self.starts = np.minimum(np.searchsorted(self.head, np.arange(1 << LEADING, dtype=np.uint64) << np.uint64(64 - LEADING)), max(0, len(head) - 1))
        self.cls = np.zeros(len(head), np.int32)
        self.row = np.full(len(head), -1, np.int32)
        self.rare, self.end = 0, 1
        self.outside = n_all - ends - int(count.sum())
        self.rare_z = n_all - ends - int(count.sum()) + max(0, v_all - 1 - len(head)) + 1
        self.ends = ends
        self.z = np.array([max(1, self.rare_z), ends + 1], float)
        self.input = np.zeros(len(head), np.int32)
        self.net = None

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places in the head, -1 elsewhere: from the first word with the hash's leading bits on, up to the hash."""
        if not len(self.head):
            return np.full(len(h), -1)
        at = self.starts[h >> np.uint64(64 - LEADING)]
        last = len(self.head) - 1
        left = np.flatnonzero((self.head[at] < h) & (at < last))
        while len(left):
            at[left] += 1
            left = left[(self.head[at[left]] < h[left]) & (at[left] < last)]
        return np.where(self.head[at] == h, at, -1)

    def fit(self, vectors: np.ndarray) -> None:
        """Classes from the words' sums of signs, and a net that knows the classes' shares."""
        self._classes(vectors)
        share = np.bincount(self.cls, weights=self.count, minlength=len(self.z)) + 1.0
        share[self.rare] += self.outside
        share[self.end] += self.ends
        often = np.argsort(-self.count, kind="stable")[:INNER]
        often = often[self.count[often] >= LEAST]
        inside = Inside(self.z, self.cls[often], self.count[often] + 1.0)
        self.row[often[inside.order]] = np.arange(len(often))
        self.net = Net(INPUTS + len(self.z) + 1, len(self.z), inside=inside)
        self.net.p["ob"] = np.log(share / share.sum()).astype(np.float32)

    def learn(self, net: Net, parts: list[tuple[np.ndarray, np.ndarray]], epochs: int, rate: float) -> None:
        """Trains ``net`` on the words of some texts, as ``words`` gives them."""
        n = np.concatenate([b for _, b in parts])
        stream, target, row = self._streams(self.find(np.concatenate([a for a, _ in parts])), n)
        pieces = -(-(n + 1) // STRETCH)
        upto = np.cumsum(pieces) - pieces
        inside = np.arange(int(pieces.sum())) - np.repeat(upto, pieces)
        begin = np.repeat(np.cumsum(n + 1) - n - 1, pieces) + inside * STRETCH
        sizes = np.minimum(STRETCH, np.repeat(n + 1, pieces) - inside * STRETCH)
        deal = lanes(sizes, LANES)
        length = max(int(sizes[d].sum()) for d in deal)
        x, y, q = np.zeros((length, len(deal)), np.int64), np.full((length, len(deal)), -1), np.full((length, len(deal)), -1)
        fresh = np.zeros((length, len(deal)), bool)
        for k, own in enumerate(deal):
            t = 0
            for i in own:
                s = slice(begin[i], begin[i] + sizes[i])
                x[t : t + sizes[i], k], y[t : t + sizes[i], k], q[t : t + sizes[i], k] = stream[s], target[s], row[s]
                fresh[t, k] = True
                t += int(sizes[i])
        net.train(x, y, fresh, epochs, rate=rate, rows=q)

    def _classes(self, v: np.ndarray) -> None:
        top = np.argsort(-self.count, kind="stable")
        often = np.flatnonzero(self.count >= 3)
        label = np.full(len(self.count), -1)
        if len(often) > 4 * CLUSTERS:
            x = v if len(often) == len(v) else v[often]
            x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] + np.float32(1e-9)
            centre = x[np.argsort(-self.count[often], kind="stable")[: 4 * CLUSTERS : 4]]
            for _ in range(12):
                own = np.argmax(x @ centre.T, axis=1)
                mid = np.stack([np.bincount(own, weights=x[:, k], minlength=len(centre)) for k in range(x.shape[1])], 1)
                used = np.bincount(own, minlength=len(centre)) > 0
                centre[used] = (mid / (np.sqrt((mid * mid).sum(1, keepdims=True)) + 1e-9))[used]
            label[often] = own
        else:
            label[often] = 0
        # classes: 0 outside the head, 1 end, four bands of head words without a cluster, then two bands a cluster
        place = np.empty(len(top), np.int64)
        place[top] = np.arange(len(top))
        self.cls = (2 + np.minimum(3, np.log2(place / 4096 + 1).astype(int))).astype(np.int32)
        self.cls[often] = 6 + 2 * label[often] + (place[often] >= 512)
        self.cls[self.count < LEAST] = self.rare
        self.z = np.zeros(6 + 2 * CLUSTERS)
        np.add.at(self.z, self.cls, self.count + 1.0)
        self.z = np.maximum(1.0, self.z)
        self.z[0], self.z[1] = self.z[0] + max(0, self.rare_z), self.ends + 1
        self.input = np.where(place < INPUTS, place, INPUTS + self.cls).astype(np.int32)

    def _streams(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(input ids, target classes, places among the frequent words) of all texts, one end token each."""
        total = len(at) + len(n)
        stop = np.cumsum(n + 1) - 1
        real = np.ones(total, bool)
        real[stop] = False
        target = np.full(total, self.end)
        own, row = np.full(total, INPUTS + self.end), np.full(total, -1)
        if len(self.head):
            row[real] = np.where(at >= 0, self.row[at], -1)
            target[real] = np.where(at >= 0, self.cls[at], self.rare)
            own[real] = np.where(at >= 0, self.input[at], INPUTS + self.rare)
        else:
            target[real], own[real] = self.rare, INPUTS + self.rare
        x = np.empty(total, np.int64)
        x[1:] = own[:-1]
        x[stop - n] = INPUTS + len(self.z)
        return x, target, row

    def classes_score(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of each text: the sum over its tokens of log10 P(class | state) and of log10 of exp(v . state) / Z(class, state), so
        that with log10 of the words' counts + 1 it is the text's log10 probability."""
        run = Lanes(self)
        run.add(at, n)
        done, sums = run.advance(True)
        return sums[np.argsort(done)]


class Lanes:
    """Texts read side by side, each with its own state from its first token to its last.

    Texts are dealt to SCORE_LANES streams. When few streams are left, the texts that are not through go on, with their
    states, beside the next block of texts, so a very long text never runs alone until the end of the input.
    """

    def __init__(self, model: Model):
        self.m, k = model, model.net.h
        self.table = np.ascontiguousarray((model.net.p["e"] @ model.net.p["w"] + model.net.p["b"]).T)
        self.x, self.y, self.row = (np.zeros(0, np.int64) for _ in range(3))
        self.size, self.sums, self.state = np.zeros(0, np.int64), np.zeros(0), np.zeros((0, k), np.float32)

    def add(self, at: np.ndarray, n: np.ndarray) -> None:
        for name, new in zip(("x", "y", "row"), self.m._streams(at, n), strict=True):
            setattr(self, name, np.concatenate([getattr(self, name), new]))
        self.size = np.concatenate([self.size, n + 1])
        self.sums = np.concatenate([self.sums, np.zeros(len(n))])
        self.state = np.concatenate([self.state, np.zeros((len(n), self.state.shape[1]), np.float32)])

    def advance(self, last: bool) -> tuple[np.ndarray, np.ndarray]:
        """(places of the texts that are through, by the order in which they were held; their sums)."""
        net, size = self.m.net, self.size
        begin = np.cumsum(size) - size
        if not len(size):
            return np.zeros(0, np.int64), np.zeros(0)
        deal = lanes(size, SCORE_LANES)
        deal = [sorted(d, key=lambda i: not self.state[i].any()) for d in deal]  # a text that goes on comes first
        length = np.array([int(size[d].sum()) for d in deal])
        order = np.argsort(-length, kind="stable")
        deal, length = [deal[k] for k in order], length[order]
        steps = int(length[0]) if last else int(length[min(len(deal) - 1, SCORE_LANES // 8)])
        grid = np.full((steps, len(deal)), -1)
        for k, d in enumerate(deal):
            index = np.concatenate([np.arange(begin[i], begin[i] + size[i]) for i in d])[:steps]
            grid[: len(index), k] = index
        first = np.full(len(self.x), -1)
        first[begin] = np.arange(len(size))
        live = (grid >= 0).sum(1)
        h, got = np.zeros((net.h, len(deal)), np.float32), np.zeros(len(self.x))
        end = {}
        for s in range(0, steps, AT_ONCE):
            upto = min(steps, s + AT_ONCE)
            xw = np.take(self.table, self.x[np.maximum(grid[s:upto, : live[s]], 0)], axis=1)
            states, places = [], []
            for t in range(s, upto):
                g = grid[t, : live[t]]
                h = h[:, : live[t]]
                text = first[g]
                new = np.flatnonzero(text >= 0)
                if len(new):
                    h = h.copy()
                    h[:, new] = self.state[text[new]].T
                h = net.step(h, xw[:, t - s, : live[t]])[0]
                states.append(h)
                places.append(g)
            p = np.concatenate(places)
            hs, y = np.concatenate(states, axis=1), self.y[p]
            got[p] = net.log_of(hs, y) + net.inside(net.p["v"], hs, y, self.row[p])
        # what was read of each text, and the state at its last token read
        read = np.zeros(len(size), np.int64)
        for k, d in enumerate(deal):
            left = min(steps, int(length[k]))
            for i in d:
                read[i] = min(left, int(size[i]))
                left -= int(read[i])
                if 0 < read[i] < size[i]:
                    end[i] = k
        upto = np.concatenate([[0.0], np.cumsum(got)])
        sums = self.sums + (upto[begin + read] - upto[begin]) / math.log(10)
        for i, k in end.items():
            self.state[i] = h[:, k]
        done = np.flatnonzero(read == size)
        rest = np.flatnonzero(read < size)
        keep = np.concatenate([np.arange(begin[i] + read[i], begin[i] + size[i]) for i in rest] + [np.zeros(0, np.int64)])
        self.x, self.y, self.row = self.x[keep], self.y[keep], self.row[keep]
        self.size, self.sums, self.state = (size - read)[rest], sums[rest], self.state[rest]
        return done, sums[done]


def _texts(batches, column: int):
    """(batch, words, number of words of each text) of runs of texts."""
    for batch in batches:
        for off in range(0, batch.num_rows, 512):
            part = batch.slice(off, 512)
            texts = [t or "" for t in part.column(column).to_pylist()]
            for lo, hi in runs(texts):
                yield (part.slice(lo, hi - lo), *words(texts[lo:hi]))


def _together(shared):
    """(w, v0, ...): for places in the head, the sums of the signs of the texts they stand in, once for each time."""

    def run(batches):
        m = shared.value
        sums = np.zeros((SIGNS, len(m.head)), np.int64)

        def count(at, doc, keys):
            own = np.bincount(at, minlength=len(m.head))
            if len(at) and own.max() > LIMB:  # a word so frequent that its sums would run into each other
                for s in range(0, len(at), LIMB):
                    count(at[s : s + LIMB], doc[s : s + LIMB], keys)
                return
            for k in range(0, SIGNS, 3):  # three sums at a time, as limbs of one exact float
                three = [((keys >> np.uint64(k + j)) & np.uint64(1)).astype(np.int64) << (17 * j) for j in range(min(3, SIGNS - k))]
                got = np.bincount(at, weights=sum(three).astype(float)[doc], minlength=len(m.head)).astype(np.int64)
                for j in range(len(three)):
                    sums[k + j] += 2 * ((got >> (17 * j)) & LIMB) - own

        def add(held):
            at, n = np.concatenate([a for a, _, _ in held]), np.concatenate([b for _, b, _ in held])
            keys = mix(np.concatenate([c for _, _, c in held]))
            known = at >= 0
            count(at[known], np.repeat(np.arange(len(n)), n)[known], keys)

        held, n = [], 0
        for part, h, own in _texts(batches, 1):
            held.append((m.find(h), own, part.column(0).to_numpy().astype(np.int64).view(np.uint64)))
            n += len(h) + len(own)
            if n >= FLUSH:
                add(held)
                held, n = [], 0
        if held:
            add(held)
        some = np.flatnonzero(sums.any(0))
        for s in range(0, len(some), 16384):
            w = some[s : s + 16384]
            yield pa.RecordBatch.from_arrays([pa.array(w), *(pa.array(sums[k, w]) for k in range(SIGNS))], names=["w", *(f"v{k}" for k in range(SIGNS))])

    return run


def _train(shared, net: Net, epochs: int, rate: float):
    """(task, tokens, weights) of the net after the task's texts; nothing where there are none."""

    def run(batches):
        from pyspark import TaskContext

        m, own = shared.value, copy.deepcopy(net)
        held, n, tokens = [], 0, 0
        for _, h, k in _texts(batches, 0):
            held.append((h, k))
            n += len(h) + len(k)
            if n >= BLOCK:
                m.learn(own, held, epochs, rate)
                tokens += n
                held, n = [], 0
        if n:
            m.learn(own, held, epochs, rate)
            tokens += n
        if tokens:
            flat = np.concatenate([own.p[x].ravel() for x in sorted(own.p)]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([tokens]), pa.array([flat.tobytes()], pa.binary())], names=["k", "n", "p"])

    return run


def _fit(scratch: Scratch, model: Model, train: DataFrame, id_col: str, text_col: str, n_all: int) -> None:
    """Clusters and net from all rows of ``train``."""
    spark = train.sparkSession
    vectors = np.zeros((len(model.head), SIGNS), np.float32)
    shared = spark.sparkContext.broadcast(model)
    if len(model.head):
        names = [f"v{k}" for k in range(SIGNS)]
        rows = train.select(F.xxhash64(id_col, text_col).alias("h"), text_col).coalesce(max(1, n_all // GATHER_TOKENS))
        rows = rows.mapInArrow(_together(shared), "w long, " + ", ".join(f"{x} long" for x in names))
        sums = scratch.save(rows.groupBy("w").agg(*[F.sum(x).cast("float").alias(x) for x in names]))
        for s in range(0, len(vectors), 1 << 15):  # eight slices at most, as all at once crowd the driver
            got = sums.where(F.col("w").between(s, s + (1 << 15) - 1)).toPandas()
            vectors[got["w"].to_numpy()] = got[names].to_numpy(np.float32)
        scratch.drop(sums)
    model.fit(vectors)
    shared.unpersist()
    if not n_all:
        return
    shared = spark.sparkContext.broadcast(model)
    passes = max(1, min(PASSES, round(TRAIN_TOKENS / n_all)))
    share, epochs = min(passes, ROUNDS), max(1, round(passes / ROUNDS))
    turn = F.pmod(F.xxhash64(id_col), F.lit(ROUNDS))
    for r in range(ROUNDS):
        rows = train.where(turn.isin([(r * share + k) % ROUNDS for k in range(share)])).select(text_col).coalesce(max(1, n_all * share // ROUNDS // TASK_TOKENS))
        nets = scratch.save(rows.mapInArrow(_train(shared, model.net, epochs, 0.004 * (1 - r / ROUNDS)), "k long, n long, p binary"))
        total, mean = 0, 0.0
        for x in nets.orderBy("k").toLocalIterator():
            total, mean = total + x.n, mean + x.n * np.frombuffer(x.p, np.float32).astype(float)
        scratch.drop(nets)
        at = 0
        for name in sorted(model.net.p) if total else ():
            p = model.net.p[name]
            model.net.p[name] = (mean[at : at + p.size] / total).reshape(p.shape).astype(np.float32)
            at += p.size
    shared.unpersist()


def _score(shared):
    def run(batches):
        m = shared.value
        logc = np.log10(m.count + 1.0)
        reading, held, tokens = Lanes(m), [], 0

        def through(last):
            nonlocal held, tokens
            tokens = 0
            if not held:
                return
            rows = pa.Table.from_batches(held).combine_chunks()
            done, sums = reading.advance(last)
            rest = np.setdiff1d(np.arange(rows.num_rows), done)
            held = rows.take(pa.array(rest)).combine_chunks().to_batches() if len(rest) else []
            yield from rows.take(pa.array(done)).append_column("lm", pa.array(sums)).combine_chunks().to_batches()

        for part, h, n in _texts(batches, 2):
            at = m.find(h)
            stop = np.cumsum(n)
            known = at >= 0
            upto = np.concatenate([[0], np.cumsum(known)])
            sums = np.concatenate([[0.0], np.cumsum(np.where(known, logc[at], 0.0) if len(logc) else np.zeros(len(at)))])
            rare_at = np.flatnonzero(~known)
            cut = np.searchsorted(rare_at, np.concatenate([[0], stop])).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(cut), pa.array(h[rare_at].view(np.int64)))
            held.append(pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n + 1), pa.array(upto[stop] - upto[stop - n]), pa.array(sums[stop] - sums[stop - n]), rare], names=["rid", "id", "n", "known", "logc", "rare"]))
            reading.add(at, n)
            tokens += len(h) + len(n)
            if tokens >= SCORE_TOKENS:
                yield from through(False)
        yield from through(True)

    return run


def score_texts(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for each row; ``training`` is a condition on the rows."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "lm")
    train = docs.where(training)
    counts = scratch.save(train.select(text_col).mapInArrow(_counts, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")))
    in_words, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = train.count()
    n_all, v_all = in_words + ends, v + (1 if ends else 0)
    # the head: all words from a frequency step on, as low as HEAD words allow
    step = F.floor(F.log2("c") * 16).cast("int")
    total, least = 0, None
    for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).orderBy(F.desc("s")).collect():  # some hundred steps
        total += r.n
        if total > HEAD:
            break
        least = r.s
    top = counts.where(step >= least if least is not None else F.lit(False)).orderBy("w").toPandas()
    model = Model(top["w"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64), n_all, v_all, ends)
    _fit(scratch, model, train, id_col, text_col, n_all)

    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), text_col)
    scored = scratch.save(rows.mapInArrow(_score(shared), f"rid long, id {kind}, n long, known long, logc double, rare array<bigint>, lm double"))
    rare = scored.select("rid", F.explode("rare").alias("w")).groupBy("w", "rid").agg(F.count("*").alias("k"))
    rare = rare.join(counts, "w").groupBy("rid").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("add"))
    out = scored.drop("rare").join(rare, "rid", "left")
    logc = F.col("logc") + F.coalesce("add", F.lit(0.0)) + F.lit(math.log10(ends + 1))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more", F.lit(0)) + F.lit(1 if ends else 0)).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"), (logc - F.col("n") * F.lit(math.log10(n_all + v_all + 1))).alias("base_score"), (F.col("lm") + logc).alias("score"),
    )


def op9_language_model(spark, sf_dir, modulus: int = 7, held: int = 2):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rem = remainder(F.col("doc_id"), modulus)
    out = score_texts(docs, rem != held)
    return out.select("doc_id", (rem == held).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
