"""Log-likelihood of whole documents under a gated recurrent language model.

The output softmax is factored by class: p(word | state) = p(class | state) *
p(member | class, state), each class having ``IN_CLASS`` members. The most frequent words are members of
their own; those of the last class are the other words by their endings. Words of one ending are told apart
by their corpus counts, one share of each ending being kept for words never
seen. Word counts, the vocabulary, the classes and their totals come from all training texts.

The network is fitted by truncated backpropagation through time, in numpy: first on
the driver on a bounded sample, as all tasks need one starting point; then each task
of a pass over all training texts goes on from there with every token of its texts, and the tasks' weights
are averaged by the tokens they saw. In training and in scoring, a text's state is carried from window to window
from its first token to its last. Words beyond the broadcast head are looked up in the count table by a join of 96-bit hashes.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter, deque
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.llm.common import materialise
from loamwork.llm.word_crf import held_out

#: The token after a text's last word; no word has a space.
END = " "
IN_CLASS, TOP_CLASSES = 64, 32
CLASSES, ENDINGS, TOP = TOP_CLASSES + 1, IN_CLASS, IN_CLASS * TOP_CLASSES
HIDDEN, WINDOW, SLOTS = 32, 32, 1024
#: Words whose counts every task holds, and how long such a word may be in bytes.
HEAD, HEAD_BYTES = 100_000, 40
SMOOTH = 0.1
#: Windows that are cut from the lanes at once, and tokens that a class softmax takes at once.
AHEAD, ROWS = 8, 512
#: Characters of a text that the driver's sample takes at most.
START_CHARS = 100_000
#: Of the words too long for the head, so many of the most frequent are told to every task.
OFTEN = 10_000
#: Texts that train side by side on the driver, and in a task.
START_LANES, LANES = 32, 256


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


def _ending(word: Column) -> Column:
    data = F.encode(word, "UTF-8")
    return (F.crc32(F.substring(data, -2, 2)) % ENDINGS).cast("int")


Params = dict[str, np.ndarray]


def new_params(seed: int = 3) -> Params:
    """x and u: of the update gate, the reset gate and the new state; wc and bc: of the classes; ww and bw: of the members of each."""
    rng = np.random.default_rng(seed)
    shape = {
        "x": (3, TOP + ENDINGS, HIDDEN),
        "u": (3, HIDDEN, HIDDEN),
        "wc": (HIDDEN, CLASSES),
        "bc": (CLASSES,),
        "ww": (CLASSES, HIDDEN, IN_CLASS),
        "bw": (CLASSES, IN_CLASS),
    }
    out = {k: rng.normal(0, 0.1, s).astype(np.float32) for k, s in shape.items()}
    out["bc"][:] = 0
    out["bw"][:] = 0
    return out


def _advance(x: np.ndarray, hu: np.ndarray, old: np.ndarray, out: np.ndarray) -> None:
    """Writes the next states into ``out``. x: the inputs' thirds, which become the two gates and the new state; hu: the old states'."""
    gates, new = x[:2], x[2]
    gates += hu[:2]
    np.negative(gates, out=gates)
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    new += gates[1] * hu[2]
    np.tanh(new, out=new)
    np.subtract(old, new, out=out)
    out *= gates[0]
    out += new


def _by_class(goal: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """An order of tokens by class, their classes in it, and where each class begins and the last one ends."""
    classes = (goal // IN_CLASS).astype(np.int16)
    order = np.argsort(classes, kind="stable")
    classes = classes[order]
    return order, classes, np.searchsorted(classes, np.arange(CLASSES + 1)).tolist()


def _cuts(ends: list[int]) -> Iterator[tuple[int, int, int]]:
    """(class, from, to) of up to ``ROWS`` tokens each."""
    for c, (a, b) in enumerate(pairwise(ends)):
        for k in range(a, b, ROWS):
            yield c, k, min(b, k + ROWS)


def _wide(w: np.ndarray, b: np.ndarray) -> bool:
    """Whether exponentials could run over: states lie within -1 and 1, so most often they can't."""
    return float((np.abs(w).sum(axis=-2) + np.abs(b)).max()) > 60


def _picked(logits: np.ndarray, at: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-probabilities of one place a row, the sums of the exponentials that overwrite ``logits``, and the places along all rows."""
    if wide:
        logits -= logits.max(axis=1, keepdims=True)
    places = np.arange(0, logits.size, logits.shape[1])
    places += at
    picked = logits.ravel().take(places)
    np.exp(logits, out=logits)
    sums = logits @ np.ones(logits.shape[1], logits.dtype)
    return picked - np.log(sums), sums, places


class Room:
    """Arrays that are used again: fresh ones of this size would cost a fault a page."""

    def __init__(self, kind: np.dtype):
        self.kind, self.held = kind, {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.held or self.held[name].size < size:
            self.held[name] = np.empty(size, self.kind)
        return self.held[name][:size].reshape(shape)


def log_probs(p: Params, h: np.ndarray, ids: np.ndarray, room: Room | None = None) -> np.ndarray:
    """Natural log of p(class) * p(member | class)."""
    room = room or Room(h.dtype)
    order, classes, ends = _by_class(ids)
    states, places, found = room("some", *h.shape), ids[order] % IN_CLASS, np.empty(len(ids), h.dtype)
    np.take(h, order, axis=0, out=states, mode="clip")
    wide = _wide(p["wc"], p["bc"])
    for a in range(0, len(ids), ROWS):
        part = states[a : a + ROWS]
        logits = np.matmul(part, p["wc"], out=room("logits", len(part), CLASSES))
        logits += p["bc"]
        found[a : a + ROWS] = _picked(logits, classes[a : a + ROWS], wide)[0]
    wide = _wide(p["ww"], p["bw"])
    for c, a, b in _cuts(ends):
        logits = np.matmul(states[a:b], p["ww"][c], out=room("logits", b - a, IN_CLASS))
        logits += p["bw"][c]
        found[a:b] += _picked(logits, places[a:b], wide)[0]
    out = np.empty_like(found)
    out[order] = found
    return out


def _slopes(states: np.ndarray, w: np.ndarray, b: np.ndarray, wide: bool, at: np.ndarray, total: int, logits: np.ndarray) -> float:
    """Writes one softmax's slopes at its logits into ``logits``; returns its loss."""
    np.matmul(states, w, out=logits)
    logits += b
    logs, sums, places = _picked(logits, at, wide)
    logits *= (1 / (total * sums))[:, None]
    logits.ravel()[places] -= 1 / total
    return -float(logs.sum())


def _sum_by_id(ids: np.ndarray, rows: np.ndarray, out: np.ndarray, room: np.ndarray, many: int = 12) -> None:
    """Sums of the rows (3, n, HIDDEN) of each id into ``out``; ``room``: as large as the rows."""
    order = np.argsort(ids.astype(np.int16), kind="stable")
    ids = ids[order]
    np.take(rows, order, axis=1, out=room, mode="clip")
    firsts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    sizes = np.diff(firsts, append=len(ids))
    often = sizes >= many
    ones = np.ones(int(sizes.max()), rows.dtype)
    for i, a, n in zip(ids[firsts[often]].tolist(), firsts[often].tolist(), sizes[often].tolist(), strict=True):
        out[:, i] = ones[:n] @ room[:, a : a + n]
    # of the others, all first rows, all second ones, and so on
    firsts, sizes = firsts[~often], sizes[~often]
    for k in range(many - 1):
        firsts, sizes = firsts[sizes > k], sizes[sizes > k]
        out[:, ids[firsts]] += room[:, firsts + k]


def gradients(
    p: Params, ids: np.ndarray, targets: np.ndarray, real: np.ndarray, h: np.ndarray, fresh: np.ndarray | None = None, room: Room | None = None
) -> tuple[Params, np.ndarray, float]:
    """Of the mean negative log-likelihood of a window; ids, targets, real, fresh: (steps, lanes). Also the last states and the loss.

    ``fresh`` marks texts' first tokens: the state before them is zero, and nothing goes back past them. What is
    returned lives in ``room`` until its next use.
    """
    steps, n = ids.shape
    room, u, flat = room or Room(p["x"].dtype), p["u"], ids.ravel()
    x = room("x", 3, steps * n, HIDDEN)
    np.take(p["x"], flat, axis=1, out=x, mode="clip")
    x = x.reshape(3, steps, n, HIDDEN)
    before, states, hu = room("before", steps, n, HIDDEN), room("states", steps, n, HIDDEN), room("hu", steps, 3, n, HIDDEN)
    begins = np.zeros(steps, bool) if fresh is None else fresh.any(axis=1)
    for t in range(steps):
        before[t] = h
        if begins[t]:
            before[t][fresh[t]] = 0
        h = states[t]
        np.matmul(before[t], u, out=hu[t])
        _advance(x[:, t], hu[t], before[t], h)
    g = {k: room("g" + k, *v.shape) for k, v in p.items()}
    for v in g.values():
        v.fill(0)

    # the output layers, tokens in order of their classes
    at = np.flatnonzero(real.ravel())
    goal, total = targets.ravel()[at], max(1, len(at))
    order, classes, ends = _by_class(goal)
    at, places = at[order], goal[order] % IN_CLASS
    some, down, loss = room("some", len(at), HIDDEN), room("down", len(at), HIDDEN), 0.0
    np.take(states.reshape(-1, HIDDEN), at, axis=0, out=some, mode="clip")
    wide = _wide(p["wc"], p["bc"])
    for a in range(0, len(at), ROWS):
        part = some[a : a + ROWS]
        d = room("logits", len(part), CLASSES)
        loss += _slopes(part, p["wc"], p["bc"], wide, classes[a : a + ROWS], total, d)
        g["wc"] += part.T @ d
        g["bc"] += np.ones(len(d), d.dtype) @ d
        np.matmul(d, p["wc"].T, out=down[a : a + ROWS])
    wide = _wide(p["ww"], p["bw"])
    for c, a, b in _cuts(ends):
        part, d = some[a:b], room("logits", b - a, IN_CLASS)
        loss += _slopes(part, p["ww"][c], p["bw"][c], wide, places[a:b], total, d)
        g["ww"][c] += part.T @ d
        g["bw"][c] += np.ones(len(d), d.dtype) @ d
        down[a:b] += d @ p["ww"][c].T
    from_out = room("from_out", steps * n, HIDDEN)
    from_out.fill(0)
    from_out[at] = down
    from_out = from_out.reshape(steps, n, HIDDEN)

    # back through time
    du, dnew = room("du", 3, steps, n, HIDDEN), room("dnew", steps, n, HIDDEN)
    dh, back, stay, turned = np.zeros((n, HIDDEN), u.dtype), room("back", 3, n, HIDDEN), room("stay", n, HIDDEN), np.ascontiguousarray(u.transpose(0, 2, 1))
    for t in range(steps - 1, -1, -1):
        (z, r, new), (dz, dr, dhn), dn = x[:, t], du[:, t], dnew[t]
        dh += from_out[t]
        np.subtract(1, z, out=stay)
        np.multiply(new, new, out=dn)
        np.subtract(1, dn, out=dn)
        dn *= stay
        dn *= dh
        np.subtract(before[t], new, out=dz)
        dz *= z
        dz *= stay
        dz *= dh
        np.subtract(1, r, out=dr)
        dr *= r
        dr *= hu[t, 2]
        dr *= dn
        np.multiply(dn, r, out=dhn)
        np.matmul(du[:, t], turned, out=back)
        dh *= z
        for part in back:
            dh += part
        if begins[t]:
            dh[fresh[t]] = 0
    np.matmul(before.reshape(-1, HIDDEN).T, du.reshape(3, -1, HIDDEN), out=g["u"])
    du[2] = dnew
    _sum_by_id(flat, du.reshape(3, -1, HIDDEN), g["x"], x.reshape(3, -1, HIDDEN))
    return g, h, loss / total


class Lanes:
    """Texts side by side, each lane one after the other. Blocks of steps are cut from all lanes, so texts are never padded to one length."""

    def __init__(self, n: int, start: int):
        self.start, self.done = start, 0
        self.queues: list[deque] = [deque() for _ in range(n)]
        self.loads = [(0, k) for k in range(n)]
        self.last = np.zeros(n, np.int32)

    def add(self, ids: np.ndarray, owner: int = 0) -> None:
        """Into the lane that has been given the least so far."""
        load, k = self.loads[0]
        heapq.heapreplace(self.loads, (load + len(ids), k))
        self.queues[k].append((ids, owner))

    def ready(self) -> int:
        """Steps that every lane can go."""
        return self.loads[0][0] - self.done

    def sort(self) -> np.ndarray:
        """Puts the lanes with the most left first; returns their order."""
        by = sorted(range(len(self.queues)), key=lambda k: -sum(len(ids) for ids, _ in self.queues[k]))
        place = {k: at for at, k in enumerate(by)}
        self.queues, self.last = [self.queues[k] for k in by], self.last[by]
        self.loads = [(load, place[k]) for load, k in self.loads]
        return np.array(by)

    def block(self, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Goals, what stands before them, texts' first tokens, tokens of each lane, and (owner, lane, step) where each piece of a text begins.

        Arrays are (steps, lanes), without lanes that are empty if the lanes are sorted.
        """
        n = len(self.queues)
        goal, fresh, held = np.zeros((n, steps), np.int32), np.zeros((n, steps), bool), np.zeros(n, np.int64)
        pieces = []
        for k, queue in enumerate(self.queues):
            at = 0
            while queue and at < steps:
                ids, owner = queue.popleft()
                part = ids[: steps - at]
                goal[k, at : at + len(part)] = part
                # what is left of a text has a negative owner
                fresh[k, at] = owner >= 0
                pieces.append((owner if owner >= 0 else ~owner, k, at))
                at += len(part)
                if len(part) < len(ids):
                    queue.appendleft((ids[len(part) :], owner if owner < 0 else ~owner))
            held[k] = at
        given = np.empty_like(goal)
        given[:, 0], given[:, 1:] = self.last, goal[:, :-1]
        given[fresh] = self.start
        self.last = goal[:, -1].copy()
        self.done += steps
        live = int((held > 0).sum())
        return *(np.ascontiguousarray(m[:live].T) for m in (goal, given, fresh)), held[:live], pieces


class Trainer:
    """Adagrad over windows of whole texts; a text's state goes on from each window to its next."""

    def __init__(self, params: Params, rate: float, start: int, lanes: int):
        self.p, self.rate = {k: v.copy() for k, v in params.items()}, rate
        self.seen = {k: np.full_like(v, 1e-6) for k, v in params.items()}
        self.lanes, self.state, self.tokens = Lanes(lanes, start), np.zeros((lanes, HIDDEN), np.float32), 0
        self.room = Room(np.float32)

    def add(self, ids: np.ndarray) -> None:
        self.lanes.add(ids)
        if self.lanes.ready() >= AHEAD * WINDOW:
            self.learn()

    def finish(self) -> None:
        """Learns what is left of the texts, lanes dropping out as they end."""
        order = self.lanes.sort()
        self.state = self.state[order]
        while any(self.lanes.queues):
            self.learn()

    def learn(self) -> None:
        goal, given, fresh, held, _ = self.lanes.block(AHEAD * WINDOW)
        for at in range(0, len(goal), WINDOW):
            n = int((held > at).sum())
            if not n:
                break
            cut = slice(at, at + WINDOW)
            real = np.arange(at, at + WINDOW)[:, None] < held[None, :n]
            g, self.state[:n], _ = gradients(self.p, given[cut, :n], goal[cut, :n], real, self.state[:n], fresh[cut, :n], self.room)
            norm = math.sqrt(sum(float(np.vdot(x, x)) for x in g.values()))
            for k, x in g.items():
                x *= min(1.0, 1.0 / (norm + 1e-9))
                square = np.multiply(x, x, out=self.room("square", *x.shape))
                self.seen[k] += square
                x *= self.rate
                x /= np.sqrt(self.seen[k], out=square)
                self.p[k] -= x
            self.tokens += int(real.sum())


def portions(batches: Iterator[pa.RecordBatch], text: int, most: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts, in column ``text``, have about ``most`` bytes together, or that are one row which has more."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(sizes[at - 1]) if at else 0
            end = max(at + (not held), int(np.searchsorted(sizes, before + most - size, "right")))
            if end > at:
                held.append(batch.slice(at, end - at))
                size += int(sizes[end - 1]) - before
            if end < batch.num_rows:
                yield pa.concat_batches(held)
                held, size = [], 0
            at = end
    if held:
        yield pa.concat_batches(held)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words of all texts, null ones having none, and where each text's begin and the last ones end. Arrow's white space is just that of ``WS``."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    found, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    # white space at an end leaves an empty word there
    real = pc.binary_length(found).to_numpy(zero_copy_only=False) > 0
    return found.filter(pa.array(real)), np.r_[0, np.cumsum(real)][ends]


_ENDS = np.array([zlib.crc32(bytes((a, b))) % ENDINGS for a in range(256) for b in range(256)], np.int32)
_END = np.array([zlib.crc32(bytes((a,))) % ENDINGS for a in range(256)], np.int32)


def endings(words: pa.Array) -> np.ndarray:
    """``ending`` of each word of a fresh Arrow array; no word is empty."""
    if not len(words):
        return np.zeros(0, np.int32)
    ends, data = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1], np.frombuffer(words.buffers()[2], np.uint8)
    last, size = ends[1:] - 1, np.diff(ends)
    return np.where(size > 1, _ENDS[data[np.maximum(last - 1, 0)].astype(np.int32) * 256 + data[last]], _END[data[last]])


class Tokens:
    """The tokens of some texts, one after the other, each text's end included.

    ids: network ids; places: in the head, -1 for words beyond it; starts: of each text; beyond: the words beyond the
    head, and ``of``, the texts they are in.
    """

    def __init__(self, ids: np.ndarray, places: np.ndarray, starts: np.ndarray, beyond: pa.Array, of: np.ndarray):
        self.ids, self.places, self.starts, self.beyond, self.of = ids, places, starts, beyond, of

    def texts(self) -> list[np.ndarray]:
        return np.split(self.ids, self.starts[1:])


class Head:
    """What every task knows of the vocabulary. words: by falling count, END among them."""

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, distinct: int, rest: np.ndarray):
        self.words, self.counts, self.end = pa.array(words, pa.binary()).cast(pa.string()), counts, words.index(END.encode())
        #: log10 of the sum over an ending's words of count + SMOOTH, words never seen counting as one
        self.log_rest = np.log10(rest + SMOOTH)
        self.log_base = math.log10(total + SMOOTH * (distinct + 1))
        self.log_counts = np.log10(counts + SMOOTH)
        self.ids = np.array([k if k < TOP else TOP + ending(w) for k, w in enumerate(words)], np.int32)

    def encode(self, texts: pa.Array) -> Tokens:
        found, ends = split_words(texts)
        known = pc.fill_null(pc.index_in(found, value_set=self.words), -1).to_numpy(zero_copy_only=False)
        n = len(texts)
        of = np.repeat(np.arange(n), np.diff(ends))
        places = np.full(len(known) + n, self.end, np.int32)
        # each text's end makes those after it start one later
        at = np.arange(len(known)) + of
        places[at] = known
        missing = known < 0
        beyond = found.filter(pa.array(missing))
        ids = self.ids[places]
        ids[at[missing]] = TOP + endings(beyond)
        return Tokens(ids, places, ends[:-1] + np.arange(n), beyond, of[missing])

    def counted(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text, without the counts of words beyond the head: base score, score within the endings, and known words."""
        inside, rest = t.places >= 0, t.ids >= TOP
        logs = np.where(inside, self.log_counts[t.places], 0.0)
        sizes = np.diff(t.starts, append=len(t.ids))
        within = np.where(rest, logs - self.log_rest[np.where(rest, t.ids - TOP, 0)], 0.0)
        known = inside & (self.counts[t.places] > 0)
        over = lambda x: np.add.reduceat(x, t.starts) if len(t.starts) else x
        return over(logs) - sizes * self.log_base, over(within), over(known.astype(np.int64))


def score_many(p: Params, texts: list[np.ndarray], start: int, lanes: int = SLOTS) -> np.ndarray:
    """Natural log-likelihood of each text's ids under the network (rest words: of their class); states are carried from first to last token."""
    out = np.zeros(len(texts))
    held = Lanes(min(lanes, len(texts)) or 1, start)
    for k in sorted(range(len(texts)), key=lambda k: -len(texts[k])):
        held.add(texts[k], k)
    held.sort()
    h, room = np.zeros((len(held.queues), HIDDEN), np.float32), Room(np.float32)
    while any(held.queues):
        goal, given, fresh, sizes, pieces = held.block(AHEAD * WINDOW)
        used = np.arange(len(goal))[:, None] < sizes
        counts, begins = used.sum(axis=1).tolist(), fresh.any(axis=1).tolist()
        logs = np.zeros(goal.shape[::-1])
        for at in range(0, len(goal), WINDOW):
            h = h.copy()  # it is a part of the last window's states
            states, done, cut = room("states", sum(counts[at : at + WINDOW]), HIDDEN), 0, slice(at, at + WINDOW)
            for t, n in enumerate(counts[cut], at):
                h, x, hu = h[:n], room("x", 3, n, HIDDEN), room("hu", 3, n, HIDDEN)
                if begins[t]:
                    h = h.copy()
                    h[fresh[t, :n]] = 0
                np.take(p["x"], given[t, :n], axis=1, out=x, mode="clip")
                np.matmul(h, p["u"], out=hu)
                after = states[done : done + n]
                _advance(x, hu, h, after)
                h = after
                done += n
            if done:
                logs[:, cut].T[used[cut]] = log_probs(p, states, goal[cut][used[cut]], room)
        # pieces lie one after the other within each lane
        sums = np.add.reduceat(logs.ravel(), [k * len(goal) + at for _, k, at in pieces])
        out += np.bincount([owner for owner, _, _ in pieces], sums, len(texts))
    return out


def _count_words(held: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def out(counts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        if counts:
            whole = pa.concat_tables(counts)
            whole = whole.group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"]) if len(counts) > 1 else whole
            yield from whole.combine_chunks().to_batches(max_chunksize=50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, texts = [], 0
        for part in portions(batches, 0):
            found = split_words(part.column(0))[0].value_counts()
            counts.append(pa.table({"word": found.field(0), "n": found.field(1)}))
            texts += len(part)
            if sum(map(len, counts)) >= held:
                yield from out(counts)
                counts = []
        if texts:
            counts.append(pa.table({"word": [END], "n": pa.array([texts], pa.int64())}))
        yield from out(counts)

    return run


def word_counts(docs: DataFrame, text_col: str = "text", held: int = 400_000) -> DataFrame:
    """(word, n) over all texts; the end of each text counts as the word ``END``."""
    counted = docs.select(text_col).mapInArrow(_count_words(held), "word string, n long")
    # a task has counted its words already: another tally before the shuffle would find nothing to add up
    return counted.repartition("word").groupBy("word").agg(F.sum("n").alias("n"))


#: Steps of a doubling in which counts are tallied.
STEPS = 12


def _level(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double")) * STEPS)


def tallied(counts: DataFrame) -> list:
    """Rows (level, ending, short, words, n) over all words: a few thousand at most, whatever the table's size."""
    short = F.octet_length("word") <= HEAD_BYTES
    by = [_level(F.col("n")).alias("level"), _ending(F.col("word")).alias("ending"), short.alias("short")]
    return counts.groupBy(*by).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).collect()


def frequent_words(counts: DataFrame, tally: list, most: int) -> tuple[list[bytes], np.ndarray]:
    """Up to ``most`` words by falling count, and their counts.

    Counts are tallied in steps of a twelfth of a doubling, and the words of the largest whole steps that fit are
    collected, so the driver gets no more than it keeps. If these are fewer than the network's words, the first of all come instead.
    """
    counts = counts.where(F.octet_length("word") <= HEAD_BYTES)
    words: Counter = Counter()
    for r in tally:
        words[r.level] += r.words * r.short
    levels = sorted(words, reverse=True)
    upto = np.cumsum([words[k] for k in levels])
    fit = int((upto <= most).sum())
    some = counts.where(_level(F.col("n")) >= levels[fit - 1]) if fit else counts.limit(0)
    if fit < len(levels) and (not fit or upto[fit - 1] < TOP):
        some = counts.orderBy(F.desc("n"), "word").limit(min(most, TOP))
    rows = sorted(((-r.n, r.word.encode()) for r in some.collect()))
    return [w for _, w in rows], np.array([-n for n, _ in rows], np.int64)


def _refine(shared, rate: float, lanes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row a parameter: its number, its weights times this task's tokens, and those tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params, head, start = shared.value
        trainer = Trainer(params, rate, start, lanes)
        for part in portions(batches, 0):
            for ids in head.encode(part.column(0)).texts():
                trainer.add(ids)
        trainer.finish()
        if trainer.tokens:
            part = TaskContext.get().partitionId()
            rows = [(k, part, (v.astype(np.float64) * trainer.tokens).tobytes(), trainer.tokens) for k, v in trainer.p.items()]
            yield _weights(rows)

    return run


def _weights(rows: list[tuple[str, int, bytes, int]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["name", "part", "blob", "tokens"])


def _sum_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    tokens: Counter = Counter()
    for batch in batches:
        for name, _, blob, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            value = np.frombuffer(blob)
            total[name] = total[name] + value if name in total else value
            tokens[name] += n
    if total:
        yield _weights([(k, TaskContext.get().partitionId(), v.tobytes(), tokens[k]) for k, v in total.items()])


def averaged(weights: DataFrame, params: Params, fan_in: int = 16) -> Params:
    """Mean of the tasks' weights by their tokens, added up in levels of ``fan_in`` so no task gathers them all."""
    n = weights.select("part").distinct().count()
    while n > fan_in:
        n = -(-n // fan_in)
        weights = weights.repartition(n, "part").mapInArrow(_sum_weights, weights.schema)
    total: dict[str, np.ndarray] = {}
    tokens: Counter = Counter()
    for r in weights.toLocalIterator():
        value = np.frombuffer(bytes(r.blob))
        total[r.name] = total[r.name] + value if r.name in total else value
        tokens[r.name] += r.tokens
    return {k: (total[k] / tokens[k]).astype(np.float32).reshape(v.shape) if k in total else v for k, v in params.items()}


def word_hash(word: bytes) -> tuple[int, int]:
    """96 bits: what tells words apart where they are looked up by a join."""
    return xxhash.xxh64_intdigest(word, 42), zlib.crc32(word)


def _word_hash(word: Column) -> tuple[Column, Column]:
    return F.xxhash64(word), F.crc32(F.encode(word, "UTF-8"))


def _tails(t: Tokens, n: int) -> tuple[pa.Array, np.ndarray]:
    """Of ``n`` texts: lists of (hash, rest of the hash, times) of the words beyond the head, and how many of these tokens there are."""
    coded = t.beyond.dictionary_encode()
    words = coded.dictionary
    hashes = np.array([word_hash(w) for w in words.cast(pa.binary()).to_pylist()], np.uint64).reshape(-1, 2).view(np.int64)
    each, times = np.unique(t.of * max(1, len(words)) + coded.indices.to_numpy(), return_counts=True)
    text, word = np.divmod(each, max(1, len(words)))
    rows = pa.StructArray.from_arrays([pa.array(hashes[word, 0]), pa.array(hashes[word, 1]), pa.array(times)], ["a", "b", "times"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)), pa.int32()), rows), np.bincount(t.of, minlength=n)


def _score(shared, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params, head, start = shared.value
        row = TaskContext.get().partitionId() << 40
        for part in portions(batches, 2, size):
            n, t = len(part), head.encode(part.column(2))
            net = score_many(params, t.texts(), start) / math.log(10)
            base, within, known = head.counted(t)
            tails, beyond = _tails(t, n)
            cols = [pa.array(np.arange(row, row + n)), part.column(0), part.column(1), pa.array(np.diff(t.starts, append=len(t.ids)))]
            cols += [pa.array(known), pa.array(base), pa.array(net + within), pa.array(beyond), tails]
            row += n
            yield pa.RecordBatch.from_arrays(cols, ["row", "id", "held_out", "n_tokens", "known", "base", "net", "beyond", "tail"])

    return run


def lm_scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    start_tokens: int = 300_000,
    epochs: int = 2,
    head_words: int = HEAD,
    bytes_at_once: int = 16_000_000,
) -> DataFrame:
    """Scores every text; learns from rows whose CRC32 of the id as text mod 10 is not 0.

    Returns ``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score`` (both log10). Null texts count as empty: one end token. A null
    id is in the held-out part. Repeated rows are scored as often; an empty table gives no rows. Without training
    rows all counts are 0 and the network stays as drawn. Other columns are not read.

    ``start_tokens`` bounds the sample that the driver starts the network on, ``START_CHARS`` what it takes of a text; the pass
    over all training texts then learns from every token of each.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), held_out(id_col, 10, 0).alias("held_out"), F.col(text_col).alias("text"))
    training = source.where(~F.col("held_out")).select("text")
    counts = materialise(word_counts(training, "text"), "lm-counts")
    tally = tallied(counts)
    total, distinct = sum(r.n for r in tally), sum(r.words for r in tally)
    words, own = frequent_words(counts, tally, head_words)
    if END.encode() not in words:
        words, own = [END.encode(), *words], np.r_[counts.where(F.col("word") == END).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], own].astype(np.int64)
    elif words.index(END.encode()) >= TOP:
        # the end token needs an input of its own
        k = words.index(END.encode())
        words = [words[k], *words[:k], *words[k + 1 :]]
        own = np.r_[own[k], np.delete(own, k)]
    rest = np.zeros(ENDINGS)
    for r in tally:
        rest[r.ending] += r.n + SMOOTH * r.words
    for w, n in zip(words[:TOP], own[:TOP].tolist(), strict=True):
        rest[ending(w)] -= n + SMOOTH if n else 0
    head = Head(words, own, int(total), int(distinct), np.maximum(rest, 0))
    start = head.end

    params = new_params()
    if total:
        mass = np.r_[own[:TOP], np.zeros(TOP - len(own[:TOP])), np.maximum(rest, 0)].reshape(CLASSES, IN_CLASS) + 1
        params["bc"] += np.log(mass.sum(axis=1) / mass.sum()).astype(np.float32)
        params["bw"] += np.log(mass).astype(np.float32)
        draw = F.shiftrightunsigned(F.xxhash64("text", F.lit(5)), 11) / float(1 << 53)
        share = min(1.0, 1.2 * start_tokens / int(total))
        used, sample = 0, []
        # of a longer text a stretch, wherever its hash says
        room = F.greatest(F.char_length("text") - START_CHARS, F.lit(0)) + 1
        stretch = F.col("text").substr(F.pmod(F.xxhash64("text", F.lit(9)), room).cast("int") + 1, F.lit(START_CHARS))
        for r in training.where(F.col("text").isNotNull() & (draw < share)).select(stretch.alias("text")).distinct().toLocalIterator():
            sample.append(head.encode(pa.array([r.text])).ids)
            used += len(sample[-1])
            if used >= start_tokens:
                break
        rng = np.random.default_rng(1)
        trainer = Trainer(params, 0.1, start, START_LANES)
        for k in np.concatenate([rng.permutation(len(sample)) for _ in range(epochs)]):
            trainer.add(sample[k])
        trainer.finish()
        params = trainer.p
        shared = spark.sparkContext.broadcast((params, head, start))
        schema = "name string, part long, blob binary, tokens long"
        refined = materialise(training.mapInArrow(_refine(shared, 0.03, LANES), schema), "lm-weights")
        params = averaged(refined, params)
    shared = spark.sparkContext.broadcast((params, head, start))
    schema = docs.select(F.col(id_col).alias("id"), held_out(id_col, 10, 0).alias("held_out")).schema
    kind = schema["id"].dataType.simpleString()
    scored = materialise(
        source.mapInArrow(
            _score(shared, bytes_at_once),
            f"row long, id {kind}, held_out boolean, n_tokens long, known long, base double, net double, beyond long, tail array<struct<a: long, b: long, times: long>>",
        ),
        "lm-scored",
    )
    a, b = _word_hash(F.col("word"))
    known = counts.select(a.alias("a"), b.alias("known_b"), F.log10(F.col("n") + SMOOTH).alias("log"))
    # one key to sort by; the other half of the hash is compared where the first is equal
    same = F.col("b").bitwiseXOR(F.col("known_b")) == 0
    # a word too long for the head may be as frequent as any: the first of these are told, so no key of the join is hot
    often = materialise(counts.where(F.octet_length("word") > HEAD_BYTES).orderBy(F.desc("n"), "word").limit(OFTEN).select("word", "n"), "lm-often")
    hot = often.select(a.alias("a"), b.alias("b"), F.log10(F.col("n") + SMOOTH).alias("log"))
    tails = scored.select("row", F.inline("tail")).join(F.broadcast(hot), ["a", "b"], "left")
    rest = tails.where("log is null").drop("log").join(known.withColumnRenamed("a", "known_a"), (F.col("a") == F.col("known_a")) & same)
    found = (
        tails.where("log is not null").select("row", "times", "log").unionByName(rest.select("row", "times", "log"))
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.col("log")).alias("logs"), F.sum("times").alias("more"))
    )
    more = F.coalesce("more", F.lit(0))
    logs = F.coalesce("logs", F.lit(0.0)) + (F.col("beyond") - more) * math.log10(SMOOTH)
    return scored.drop("tail").join(found, "row", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + more).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"),
        (F.col("net") + logs).alias("score"),
    )
