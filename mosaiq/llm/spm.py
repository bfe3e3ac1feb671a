"""SentencePiece encoding with distinct sampled segmentations, and decoding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import mix

U = np.uint64
MARK = "▁"
#: Text characters whose lattices are built together.
CHUNK = 1 << 21
_STEP = U(0xD1B54A32D192ED03)


@dataclass
class Vocabulary:
    """Pieces with log-probabilities and their ids, and the ids and log-probabilities of the 256 bytes."""

    pieces: list[str]
    ids: np.ndarray
    logp: np.ndarray
    byte_ids: np.ndarray
    byte_logp: float
    lookup: tuple = field(default=(), repr=False)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a SentencePiece model file. Scores that are ranks, as a BPE model's are, become a Zipf law over the ranks."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        bytes_ = {sp.id_to_piece(i): i for i in range(n) if sp.is_byte(i)}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        scores = np.array([sp.get_score(i) for i in plain])
        if len(scores) and scores.min() < -1000:
            scores = -np.log(10.0 - scores)
        low = scores.min() - 2 if len(scores) else 0.0
        total = np.log(np.exp(scores).sum() + 256 * np.exp(low))
        return cls([sp.id_to_piece(i) for i in plain], np.array(plain), scores - total, np.array([bytes_[f"<0x{b:02X}>"] for b in range(256)]), float(low - total))

    def prepare(self) -> None:
        """Tables of the hashes of all pieces and of all their beginnings."""
        if self.lookup:
            return
        longest = max(map(len, self.pieces))
        starts = {p[:k] for p in self.pieces for k in range(1, len(p) + 1)}
        of = {p: i for i, p in enumerate(self.pieces)}
        h = _hashes(sorted(starts, key=lambda s: (len(s), s)))
        names = sorted(starts, key=lambda s: (len(s), s))
        order = np.argsort(h)
        joined = {c for p in self.pieces if len(p) > 1 for c in p}
        inside = "".join(re.escape(c) for c in sorted(joined - {MARK}))
        # Pieces never reach across a unit's end: marks begin a unit, and other characters stand alone.
        units = re.compile(f"{MARK}*[{inside}]+|{MARK}+|[^{MARK}{inside}]" if inside else f"{MARK}+|.", re.S)
        h = h[order]
        # Hashes by their first 20 bits: where those that begin so start, and the most that do.
        head = np.searchsorted(h, np.arange((1 << 20) + 1).astype(U) << U(44)) if len(h) else np.zeros((1 << 20) + 1, np.int64)
        head[-1] = len(h)
        self.lookup = (np.append(h, ~U(0)), np.array([*(of.get(names[i], -1) for i in order), -1]), longest, units, head[:-1].astype(np.int32), int(np.diff(head).max()))


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data = "".join(texts)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(data.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U), size


def _hashes(texts: list[str]) -> np.ndarray:
    points, size = _points(texts)
    out, first = np.zeros(len(texts), U), np.cumsum(size) - size
    for k in range(int(size.max(initial=0))):
        live = size > k
        out[live] = mix(out[live] + points[first[live] + k])
    return out


@dataclass
class Lattice:
    """Arcs of many units' lattices by their node; nodes of a unit stand one after another, its end last."""

    first_node: np.ndarray
    arc_at: np.ndarray
    target: np.ndarray
    piece: np.ndarray
    logp: np.ndarray
    cond: np.ndarray
    upto: np.ndarray
    total: np.ndarray


def lattice(units: list[str], v: Vocabulary) -> Lattice:
    """All segmentations of each unit: arcs, and the probability of each at its node among whole segmentations.

    A character that is no piece is one arc of its UTF-8 bytes. ``piece`` is a piece's number, or the
    number of pieces plus the code point. Sums run from the ends of the units backward, all units at once.
    """
    known, which, longest, _, head, most = v.lookup
    points, size = _points(units)
    n = len(points)
    end = np.repeat(np.cumsum(size), size)
    live, h = np.arange(n), np.zeros(n, U)
    source, target, piece = [], [], []
    single = np.zeros(n, bool)
    for k in range(1, longest + 1):
        inside = live + k <= end[live]
        live, h = live[inside], h[inside]
        if not len(live):
            break
        h = mix(h + points[live + k - 1])
        at = head[h >> U(44)]
        for _ in range(most - 1):
            at = at + (known[at] < h)
        hit = known[at] == h
        live, h, at = live[hit], h[hit], at[hit]
        is_piece = which[at] >= 0
        source.append(live[is_piece])
        target.append(live[is_piece] + k)
        piece.append(which[at[is_piece]])
        if k == 1:
            single[live[is_piece]] = True
    raw = np.flatnonzero(~single)
    width = 1 + (points[raw] > 0x7F).astype(int) + (points[raw] > 0x7FF) + (points[raw] > 0xFFFF)
    source, target = np.concatenate([*source, raw]), np.concatenate([*target, raw + 1])
    piece = np.concatenate([*piece, len(v.pieces) + points[raw].astype(np.int64)])
    logp = np.concatenate([v.logp[piece[: len(piece) - len(raw)]], width * v.byte_logp])
    # Nodes get a place for each unit's end, so that units don't run into one another.
    unit = np.repeat(np.arange(len(units)), size)
    source_node, target_node = source + unit[source], target + unit[source]
    nodes = n + len(units)
    by = np.argsort(source_node, kind="stable")  # nearly free: each length's arcs are in order
    source_node, target_node, logp = source_node[by], target_node[by], logp[by]
    count = np.bincount(source_node, minlength=nodes)
    arc_at = np.concatenate([[0], np.cumsum(count)])
    # Nodes by what is left of their unit; those of a step have arcs to earlier steps' only.
    left = end - np.arange(n)
    step = np.argsort(left if int(size.max(initial=0)) >= 1 << 15 else left.astype(np.int16), kind="stable")
    node = step + unit[step]
    many = count[node]
    ends = np.concatenate([[0], np.cumsum(many)])
    arc = np.repeat(arc_at[node] - ends[:-1], many) + np.arange(ends[-1])
    value, goal = logp[arc], target_node[arc]
    beta = np.zeros(nodes)
    at_left = np.concatenate([[0], np.cumsum(np.bincount(left, minlength=1)[1:])]).tolist()
    for lo, hi in zip(at_left[:-1], at_left[1:], strict=True):
        if lo == hi:
            continue
        a, z = int(ends[lo]), int(ends[hi])
        new = ends[lo:hi] - a
        each = value[a:z] + beta[goal[a:z]]
        top = np.maximum.reduceat(each, new)
        beta[node[lo:hi]] = top + np.log(np.add.reduceat(np.exp(each - np.repeat(top, many[lo:hi])), new))
    turned = np.repeat(arc_at[:-1] + arc_at[1:] - 1, count) - np.arange(len(by))  # longer pieces first: they are likelier
    target_node, piece, logp = target_node[turned], piece[by[turned]], logp[turned]
    cond = np.minimum(0.0, logp + beta[target_node] - np.repeat(beta, count))
    share = np.cumsum(np.exp(cond))
    base = np.concatenate([[0.0], share])[arc_at[:-1]]
    upto = source_node + np.minimum(share - np.repeat(base, count), 1.0)
    some = np.flatnonzero(count)
    upto[arc_at[1:][some] - 1] = some + 1.0
    first_node = np.cumsum(size + 1) - (size + 1)
    return Lattice(first_node, arc_at, target_node, piece, logp, cond, upto, beta[first_node])


def _salted(seed: np.ndarray, *salts) -> np.ndarray:
    h = seed
    for s in salts:
        h = mix(h ^ (np.asarray(s).astype(U) * _STEP + U(0x1234567)))
    return h


def _uniform(seed: np.ndarray, *salts) -> np.ndarray:
    h = _salted(seed, *salts)
    return ((h >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def _walk(lat: Lattice, node: np.ndarray, last: np.ndarray, seed: np.ndarray, salt: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Arcs from each node to its unit's end, drawn by their probabilities: counts by row, and arcs row by row."""
    rounds = []
    salted = _salted(seed, salt, place)
    who = np.flatnonzero(node < last)
    node = node.copy()
    k = 0
    while len(who):
        at = node[who]
        u = at + _uniform(salted[who], k)
        arc, final = lat.arc_at[at], lat.arc_at[at + 1] - 1
        on = np.flatnonzero((lat.upto[arc] <= u) & (arc < final))
        while len(on):
            arc[on] += 1
            on = on[(lat.upto[arc[on]] <= u[on]) & (arc[on] < final[on])]
        rounds.append((who, arc))
        node[who] = lat.target[arc]
        who = who[node[who] < last[who]]
        k += 1
    count = np.zeros(len(node), np.int64)
    for w, _ in rounds:
        count[w] += 1
    at = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.int64)
    for k, (w, arc) in enumerate(rounds):
        out[at[w] + k] = arc
    return count, out


@dataclass
class Sample:
    text: int
    arcs: np.ndarray
    logp: float
    perturbed: float


def sample_texts(lat: Lattice, unit: np.ndarray, per: np.ndarray, seed: np.ndarray, k: int) -> list[tuple[list[Sample], float]]:
    """The k segmentations with the largest perturbed log-probabilities of each text, without replacement, and the next largest.

    A* over the tree of partial segmentations, from left to right: a node stands for all segmentations
    that begin as it does, and its value is the largest perturbed log-probability below it. The root's is
    Gumbel(0). The best child of a node has the node's value, and each rest, all others at a step, a
    Gumbel at the log of its probability, cut off at the node's value. The first segmentation follows
    best children; then the rest with the largest value is opened, its first step drawn from what it
    holds, and followed in the same way, until k are out. The value of the best rest that remains is the
    threshold of the inclusion scores. Texts are independent, and draws depend on seeds and places only.
    """
    n = len(per)
    first_unit = np.cumsum(per) - per
    text_of = np.repeat(np.arange(n), per)
    place = np.arange(len(unit)) - np.repeat(first_unit, per)
    start = lat.first_node[unit]
    last = (np.append(lat.first_node[1:], len(lat.arc_at) - 1) - 1)[unit]
    count, now = _walk(lat, start, last, seed[text_of], 0, place)
    size = np.bincount(text_of, weights=count, minlength=n).astype(np.int64)
    begins = np.concatenate([[0], np.cumsum(count)])
    low = np.concatenate([[0], np.cumsum(size)])
    starts = [begins[a : a + m] - b for a, m, b in zip(first_unit.tolist(), per.tolist(), low.tolist(), strict=False)]
    live = np.arange(n)
    bound, since = -np.log(-np.log(_uniform(seed, 1, 0))), np.zeros(n, np.int64)
    gone: list[tuple] = [()] * n
    done: list[list[Sample]] = [[] for _ in range(n)]
    open_: list[list[tuple]] = [[] for _ in range(n)]
    for turn in range(k):
        _rests(lat, now, size, live, bound, since, gone, seed, turn, k - turn, done, open_, starts)
        if turn == k - 1:
            break
        live = np.array([t for t in live.tolist() if open_[t]], np.int64)
        if not len(live):
            break
        chosen = [open_[t].pop(0) for t in live.tolist()]
        bound, since = np.array([c[0] for c in chosen]), np.array([c[1] for c in chosen])
        draw = _uniform(seed[live], 3, turn, since).tolist()
        picks, heads, gone, inside = [], [], [], []
        for (_, i, parent, barred, begun), u in zip(chosen, draw, strict=True):
            arc = int(parent[i])
            barred = (*barred, arc)
            node = int(np.searchsorted(lat.arc_at, arc, "right")) - 1
            others = [a for a in range(lat.arc_at[node], lat.arc_at[node + 1]) if a not in barred]
            mass = np.cumsum(np.exp(lat.cond[others]))
            picks.append(others[min(int(np.searchsorted(mass, u * mass[-1], "right")), len(others) - 1)])
            heads.append(parent[:i])
            gone.append(barred)
            inside.append(int(np.searchsorted(begun, i, "right")) - 1)
        inside = np.array(inside)
        m = per[live] - inside
        rows = np.repeat(first_unit[live] + inside - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        begin = start[rows]
        begin[np.cumsum(m) - m] = lat.target[picks]
        count, tail = _walk(lat, begin, last[rows], seed[text_of[rows]], 4 + turn, place[rows])
        ends = np.concatenate([[0], np.cumsum(count)])
        now_parts, starts = [], []
        for head, pick, a, q, c in zip(heads, picks, (np.cumsum(m) - m).tolist(), m.tolist(), chosen, strict=True):
            now_parts += [head, [pick], tail[ends[a] : ends[a + q]]]
            begun = c[4]
            w = len(begun) - q
            starts.append(np.concatenate([begun[: w + 1], len(head) + 1 + ends[a + 1 : a + q] - ends[a]]))
        size = np.array([len(h) for h in heads]) + 1 + np.array([ends[a + q] - ends[a] for a, q in zip(np.cumsum(m) - m, m, strict=True)])
        now = np.concatenate(now_parts).astype(np.int64)
    return [(d, o[0][0] if o else -np.inf) for d, o in zip(done, open_, strict=True)]


def _rests(lat: Lattice, now: np.ndarray, size: np.ndarray, live: np.ndarray, bound: np.ndarray, since: np.ndarray, gone: list[tuple], seed: np.ndarray, turn: int, most: int, done: list, open_: list, starts: list) -> None:
    """Adds the live texts' new segmentations to ``done`` and the best of their rests to ``open_``, ``most`` there at most."""
    cond = lat.cond[now]
    high = np.cumsum(size)
    low = high - size
    sums = np.concatenate([[0.0], np.cumsum(cond)])
    of = np.repeat(np.arange(len(live)), size)
    step = np.arange(len(now)) - low[of]
    total = sums[high] - sums[low]
    with np.errstate(divide="ignore", over="ignore"):
        free = np.maximum(0.0, -np.expm1(cond))
        for j, g in enumerate(gone):
            if g:
                left = free[low[j] + since[j]] - float(np.exp(lat.cond[list(g)]).sum())
                free[low[j] + since[j]] = left if left > 1e-12 else 0.0
        mass = sums[:-1] - sums[low[of]] + np.log(free)
        value = mass - np.log(-np.log(_uniform(_salted(seed[live], 2, turn)[of], step)))
        value = bound[of] - np.log1p(np.exp(np.minimum(bound[of] - value, 700.0)))
    value[(step < since[of]) | (free <= 0)] = -np.inf
    full = np.flatnonzero(size)
    for j in range(len(live)):
        a, b = low[j], high[j]
        done[live[j]].append(Sample(int(live[j]), now[a:b], float(total[j]), float(bound[j])))
    for _ in range(most):
        if not len(full):
            break
        top = np.full(len(live), -np.inf)
        top[full] = np.maximum.reduceat(value, low[full])
        at = np.flatnonzero((value == top[of]) & (value > -np.inf))
        for i in at.tolist():
            j = int(of[i])
            open_[live[j]].append((float(value[i]), int(step[i]), now[low[j] : high[j]], gone[j] if step[i] == since[j] else (), starts[j]))
        value[at] = -np.inf
    for t in live.tolist():
        open_[t].sort(key=lambda x: -x[0])
        del open_[t][most:]


def expand(pieces: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces, and how many each has; a code point that is no piece has the ids of its UTF-8 bytes."""
    raw = pieces >= len(v.pieces)
    point = pieces[raw] - len(v.pieces)
    count = np.ones(len(pieces), np.int64)
    count[raw] = 1 + (point > 0x7F).astype(int) + (point > 0x7FF) + (point > 0xFFFF)
    out = np.repeat(np.where(raw, 0, v.ids[np.where(raw, 0, pieces)]), count)
    if len(point):
        text = np.frombuffer("".join(map(chr, point.tolist())).encode("utf-8", "surrogatepass"), np.uint8)
        out[np.repeat(raw, count)] = v.byte_ids[text]
    return out, count


@dataclass
class Decoder:
    """The bytes of every id, one after another, with marks as spaces."""

    data: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, v: Vocabulary) -> Decoder:
        table = {int(i): p.encode().replace(MARK.encode(), b" ") for i, p in zip(v.ids, v.pieces, strict=True)} | {int(i): bytes([b]) for b, i in enumerate(v.byte_ids)}
        each = [table.get(i, b"") for i in range(max(table) + 1)]
        return cls(np.frombuffer(b"".join(each), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in each])]))

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids' bytes in a row, and the bytes before each id and behind the last."""
        size = self.at[ids + 1] - self.at[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.data[np.repeat(self.at[ids] - ends[:-1], size) + np.arange(ends[-1])], ends

    def text(self, ids: np.ndarray) -> bytes:
        """The text of all the ids of one text, without the space that encoding puts first."""
        return self.decode(np.asarray(ids, np.int64))[0].tobytes().removeprefix(b" ")


class Numbers(dict):
    """Numbers new keys in the order in which they are asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Units:
    """Numbers of units and their lattices, kept from one share of the texts to the next until they are too many."""

    def __init__(self, v: Vocabulary, most: int = 3_000_000):
        self.v, self.most = v, most
        self.clear()

    def clear(self) -> None:
        self.number = Numbers()
        self.lat: Lattice | None = None
        self.uses = np.zeros(0, np.int64)

    def forget(self) -> None:
        """Lets go what was met once; more, where the rest is over half of ``most``."""
        size = np.diff(self.lat.arc_at[np.append(self.lat.first_node, len(self.lat.arc_at) - 1)])
        few = 1
        while size[self.uses > few].sum() > self.most // 2:
            few *= 2
        left, names = np.flatnonzero(self.uses > few), list(self.number)
        lat, uses = self.lat, self.uses[left]
        self.clear()
        if len(left):
            self.lat, self.uses = _some(lat, left), uses
            for k in left.tolist():
                self.number[names[k]]

    def add(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the texts' units, and units in each text; ``lat`` then has all of them."""
        if self.lat is not None and len(self.lat.piece) > self.most:
            self.forget()
        find, number, old = self.v.lookup[3].findall, self.number, len(self.number)
        own = [find(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        per = np.array([len(row) for row in own], np.int64)
        unit = np.fromiter(map(number.__getitem__, chain.from_iterable(own)), np.int64, int(per.sum()))
        new = list(islice(number, old, None)) or ([MARK] if self.lat is None else [])
        if new:
            more = lattice(new, self.v)
            self.lat = more if self.lat is None else _joined(self.lat, more)
            if not number:
                number[MARK]
        uses = np.bincount(unit, minlength=len(number))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        return unit, per


def _some(x: Lattice, units: np.ndarray) -> Lattice:
    """The lattices of these units only."""
    nodes = np.append(x.first_node, len(x.arc_at) - 1)
    first, many = nodes[units], np.diff(nodes)[units]
    node = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    low, arcs = x.arc_at[first], x.arc_at[nodes[units + 1]] - x.arc_at[first]
    arc = np.repeat(low - (np.cumsum(arcs) - arcs), arcs) + np.arange(int(arcs.sum()))
    moved = np.repeat(np.cumsum(many) - many - first, arcs)
    return Lattice(np.cumsum(many) - many, np.concatenate([[0], np.cumsum(np.diff(x.arc_at)[node])]), x.target[arc] + moved, x.piece[arc], x.logp[arc], x.cond[arc], x.upto[arc] + moved, x.total[units])


def _joined(x: Lattice, y: Lattice) -> Lattice:
    nodes, arcs = len(x.arc_at) - 1, len(x.piece)
    pairs = ((x.first_node, y.first_node + nodes), (x.arc_at, y.arc_at[1:] + arcs), (x.target, y.target + nodes), (x.piece, y.piece), (x.logp, y.logp), (x.cond, y.cond), (x.upto, y.upto + nodes), (x.total, y.total))
    return Lattice(*(np.concatenate(p) for p in pairs))


ENCODED = "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, ids_sha256 string, restored boolean"


def sampled_segmentations(docs: DataFrame, vocabulary: Vocabulary, k: int = 2, ids: bool = False) -> DataFrame:
    """One row for each of up to k distinct segmentations of each text of ``docs(doc_id, text)``.

    ``log_prob`` is the segmentation's log-probability among all of its text, ``perturbed`` its Gumbel
    value, by which ``sample`` numbers it from 1, and ``inclusion`` the probability that a segmentation of
    its probability is above the threshold, 1 where no other is left. ``restored`` tells whether decoding
    the ids gives back the text; only texts with the mark U+2581 itself may not. Draws are seeded by
    ``doc_id`` (null: 0) and the text's length: equal rows give equal samples. A null or empty text has
    one segmentation without pieces. With ``ids`` the ids are a column too. No shuffle.
    """
    vocabulary.lookup = ()
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        v.prepare()
        units, decoder = Units(v), Decoder.of(v)
        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            low = 0
            while low < len(texts):
                high, size = low, 0
                while high < len(texts) and (high == low or size + len(texts[high]) <= CHUNK):
                    size += len(texts[high])
                    high += 1
                yield encoded(keys[low:high], texts[low:high], units, decoder, k, ids)
                low = high

    return docs.select("doc_id", "text").mapInArrow(run, ENCODED + (", ids array<int>" if ids else ""))


def encoded(keys: list, texts: list[str], units: Units, decoder: Decoder, k: int, with_ids: bool) -> pa.RecordBatch:
    unit, per = units.add(texts)
    seed = mix(np.array([x or 0 for x in keys], np.int64).view(U) ^ mix(np.array([len(t) for t in texts], U)))
    got = [(i, j, s, threshold) for i, (samples, threshold) in enumerate(sample_texts(units.lat, unit, per, seed, k)) for j, s in enumerate(samples)]
    steps = np.array([len(s.arcs) for _, _, s, _ in got], np.int64)
    ids, count = expand(units.lat.piece[np.concatenate([s.arcs for _, _, s, _ in got])], units.v)
    at = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(steps)])]
    text, before = decoder.decode(ids)
    ids = ids.astype("<i4")
    logp, threshold = np.array([s.logp for _, _, s, _ in got]), np.array([t for *_, t in got])
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    digests, same = [], []
    for n, (i, *_) in enumerate(got):
        a, b = at[n], at[n + 1]
        digests.append(hashlib.sha256(ids[a:b]).hexdigest())
        same.append(text[before[a] + (b > a) : before[b]].tobytes() == raw[i])
    cols = [pa.array([keys[i] for i, *_ in got], pa.int64()), pa.array([j + 1 for _, j, *_ in got], pa.int32()), pa.array(np.diff(at)), pa.array(logp), pa.array([s.perturbed for _, _, s, _ in got]), pa.array(-np.expm1(-np.exp(np.minimum(logp - threshold, 700.0)))), pa.array(digests, pa.string()), pa.array(same, pa.bool_())]
    names = [f.split()[0] for f in ENCODED.split(", ")]
    if with_ids:
        cols.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))))
        names.append("ids")
    return pa.RecordBatch.from_arrays(cols, names=names)


def restored_texts(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """``rows`` with ``text`` decoded from its array of ids; a null array gives null."""
    if "text" in rows.columns:
        raise ValueError("column text is made here; rename it")
    held = rows.sparkSession.sparkContext.broadcast(Decoder.of(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [None if x.as_py() is None else held.value.text(x.values.to_numpy()).decode("utf-8", "replace") for x in batch.column(ids)]
            yield batch.append_column("text", pa.array(text, pa.string()))

    return rows.mapInArrow(run, rows.select("*", F.lit(None).cast("string").alias("text")).schema)
