"""Ranked lexical search: documents in the order of a recursive graph bisection, searched cluster by cluster with exact stopping."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .perfecthash import PerfectHash
from .scratch import keep
from .sums import PART, PARTS, parts_of, tree_sum, unpacked
from .textbytes import PUNCTUATION, chunks, slices, trim, word_hashes, words

#: Documents of a cluster and of a block, and bytes of a block's postings; documents that the upper bisections are fitted on, and most of these levels.
CLUSTER, BLOCK, BLOCK_BYTES = 256, 4096, 8 << 20
SAMPLE, LEVELS = 8192, 8
#: Items that are searched for together; most of their terms' bytes.
ITEMS, TERM_BYTES = 1024, 16 << 20
#: Exchanges between the halves of a set, at most.
ROUNDS = 8


class Terms(NamedTuple):
    """The terms asked for, at the slots of their perfect hash."""

    perfect: PerfectHash
    bytes: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, terms: list[str]) -> Terms:
        raw = [t.encode() for t in terms]
        data = np.frombuffer(b"".join(raw), np.uint8)
        end = np.cumsum([len(x) for x in raw]).astype(np.int64)
        start = end - [len(x) for x in raw]
        perfect = PerfectHash(word_hashes(data, start, end))
        order = np.argsort(perfect.slots(word_hashes(data, start, end)))
        raw = [raw[k] for k in order]
        return cls(perfect, np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))

    def list(self) -> list[str]:
        held = self.bytes.tobytes()
        return [held[a:b].decode() for a, b in zip(self.at[:-1], self.at[1:], strict=True)]

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Each word's slot, after its bytes were compared with the term stored there; -1 if it isn't asked for."""
        slot = self.perfect.slots(word_hashes(data, start, end))
        size = np.diff(self.at)
        live = np.flatnonzero(slot >= 0)
        live = live[size[slot[live]] == (end - start)[live]]
        n = (end - start)[live]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        byte = data[np.repeat(start[live], n) + step]
        byte = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
        same = byte == self.bytes[np.repeat(self.at[slot[live]], n) + step]
        ok = np.add.reduceat(~same, np.cumsum(n) - n) == 0 if len(n) else np.zeros(0, bool)
        out = np.full(len(start), -1, np.int64)
        out[live[ok]] = slot[live[ok]]
        return out


def item_terms(items: DataFrame) -> DataFrame:
    """``q, item_id, term, times``: the terms of each item's text; each row of ``items`` is an item with a number ``q`` of its own."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, at, data in chunks(batches):
            start, end, per = words(at, data, PUNCTUATION)
            row = pa.array(np.repeat(np.arange(len(per)), per))
            yield pa.RecordBatch.from_arrays([part.column("q").take(row), part.column("item_id").take(row), slices(data, start, end)], names=["q", "item_id", "term"])

    rows = keep(items.select(F.monotonically_increasing_id().alias("q"), "item_id", "text"), "items")
    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(split, f"q long, item_id {kind}, term string").groupBy("q", "item_id", "term").agg(F.count("*").alias("times"))


def postings(docs: DataFrame, terms: Terms) -> DataFrame:
    """``doc_id, n, ids, tfs`` of each document that has a term: its terms with repeats, and the slots and counts of those asked for."""
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        wide = max(1, known.perfect.size)
        for part, at, data in chunks(batches, limit=4 << 20):
            start, end, per = words(at, data, PUNCTUATION)
            slot = known.find(data, start, end)
            hit = np.flatnonzero(slot >= 0)
            pair, tf = np.unique(np.repeat(np.arange(len(per)), per)[hit] * wide + slot[hit], return_counts=True)
            text = pair // wide
            cut = np.searchsorted(text, np.arange(len(per) + 1))
            ids, tf = (pair - text * wide).astype(np.uint16 if wide <= 1 << 16 else np.uint32), tf.astype(np.uint32)
            some = np.flatnonzero(per)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(some)), pa.array(per[some], pa.int64()), *(pa.array([x[cut[k] : cut[k + 1]].tobytes() for k in some], pa.binary()) for x in (ids, tf))], names=["doc_id", "n", "ids", "tfs"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(found, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, ids binary, tfs binary")


def _csr(ids: list[bytes], wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and slot of each posting."""
    kind = np.uint16 if wide <= 1 << 16 else np.uint32
    term = np.frombuffer(b"".join(ids), kind).astype(np.int64)
    return np.repeat(np.arange(len(ids)), [len(x) // kind().itemsize for x in ids]), term


def document_counts(rows: DataFrame, wide: int) -> np.ndarray:
    """How many documents hold each slot's term: arrays of the tasks, summed as a tree; 8 bytes a term come to the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(wide, np.int64)
        for batch in batches:
            df += np.bincount(_csr(batch.column("ids").to_pylist(), wide)[1], minlength=wide)
        yield from parts_of({0: df})

    out = np.zeros(wide, np.int64)
    for row in tree_sum(rows.select("ids").mapInArrow(counted, PARTS)).collect():
        n = unpacked(row.counts)
        out[row.part * PART : row.part * PART + len(n)] = n
    return out


# --- recursive graph bisection


def _cost(d: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bits of the gaps between ``d`` documents of ``n`` that hold a term."""
    d = np.maximum(d, 0)
    return d * np.log2(np.maximum(n, 1) / (d + 1.0))


def bisected(doc: np.ndarray, term: np.ndarray, n: int, levels: int) -> np.ndarray:
    """Leaf of each of ``n`` documents after ``levels`` bisections, all sets of a level at once.

    ``doc, term`` are the edges of the graph. A set is first halved as its documents come. Then each
    document's gain is the bits that its terms' gaps save in the other half; both halves are sorted by gain,
    and pairs are exchanged as long as both together gain, for at most ``ROUNDS`` rounds.
    """
    node = np.zeros(n, np.int64)
    if not n:
        return node
    found, term = np.unique(term, return_inverse=True)
    wide = max(1, len(found))
    for level in range(levels):
        sets = 1 << level
        order = np.argsort(node, kind="stable")
        size = np.bincount(node, minlength=sets)
        first = np.cumsum(size) - size
        side = np.zeros(n, np.int64)
        side[order] = np.arange(n) - first[node[order]] >= (size[node[order]] + 1) // 2
        for _ in range(ROUNDS):
            degree = np.bincount((node * 2 + side)[doc] * wide + term, minlength=sets * 2 * wide).reshape(sets, 2, wide).astype(np.float64)
            many = np.bincount(node * 2 + side, minlength=sets * 2).reshape(sets, 2, 1)
            now = _cost(degree[:, 0], many[:, 0]) + _cost(degree[:, 1], many[:, 1])
            gain = np.empty_like(degree)
            for s in (0, 1):
                gain[:, s] = now - _cost(degree[:, s] - 1, many[:, s]) - _cost(degree[:, 1 - s] + 1, many[:, 1 - s])
            own = np.bincount(doc, gain.reshape(-1)[(node * 2 + side)[doc] * wide + term], minlength=n)
            order = np.lexsort((-own, side, node))
            left = np.minimum(many[:, 0, 0], many[:, 1, 0])
            of = np.repeat(np.arange(sets), left)
            place = np.arange(len(of)) - np.repeat(np.cumsum(left) - left, left)
            a, b = order[first[of] + place], order[first[of] + many[of, 0, 0] + place]
            better = own[a] + own[b] > 1e-9
            if not better.any():
                break
            side[a[better]], side[b[better]] = 1, 0
        node = node * 2 + side
    return node


@dataclass
class Upper:
    """The upper bisections: for each set a weight of each term and the sum above which a document goes left."""

    weight: list[np.ndarray]
    above: list[np.ndarray]

    @classmethod
    def fitted(cls, doc: np.ndarray, term: np.ndarray, n: int, wide: int, levels: int) -> Upper:
        """From the bisections of a sample; the sums are cut where the sample's halves have their middle."""
        leaf, model = bisected(doc, term, n, levels), cls([], [])
        where = np.zeros(n, np.int64)
        for level in range(levels):
            side = (leaf >> (levels - 1 - level)) & 1
            node = (leaf >> (levels - level)) * 2 + side
            degree = np.bincount(node[doc] * wide + term, minlength=(2 << level) * wide).reshape(1 << level, 2, wide)
            many = np.maximum(np.bincount(node, minlength=2 << level), 1).reshape(1 << level, 2, 1)
            share = np.log2((degree + 0.5) / many)
            model.weight.append((share[:, 0] - share[:, 1]).astype(np.float32))
            total = model._sums(doc, term, where, level)
            model.above.append(np.array([np.median(total[where == s]) if (where == s).any() else 0.0 for s in range(1 << level)]))
            where = where * 2 + (total <= model.above[level][where])
        return model

    def _sums(self, doc: np.ndarray, term: np.ndarray, where: np.ndarray, level: int) -> np.ndarray:
        return np.bincount(doc, self.weight[level][where[doc], term].astype(np.float64), minlength=len(where))

    def leaf(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        where = np.zeros(n, np.int64)
        for level in range(len(self.weight)):
            where = where * 2 + (self._sums(doc, term, where, level) <= self.above[level][where])
        return where


def _upper(rows: DataFrame, wide: int, count: int) -> Upper:
    """Fitted in one task on ``SAMPLE`` documents, the same ones on every run; only weights come to the driver."""
    levels = min(LEVELS, max(0, math.ceil(math.log2(max(1, count / BLOCK)))), max(0, int(math.log2(max(1, (16 << 20) / (4 * wide))))))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = sorted(x for batch in batches for x in batch.column("ids").to_pylist())
        doc, term = _csr(ids, wide)
        model = Upper.fitted(doc, term, len(ids), wide, levels)
        for weight, above in zip(model.weight, model.above, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([len(above)], pa.int64()), pa.array([weight.tobytes()], pa.binary()), pa.array([above.tobytes()], pa.binary())], names=["sets", "weight", "above"])

    chosen = rows.select("ids").orderBy(F.xxhash64("doc_id", "n", "ids", F.lit(7)), "ids").limit(SAMPLE).repartition(1)
    found = sorted(chosen.mapInArrow(fit, "sets long, weight binary, above binary").collect()) if levels else []
    return Upper([np.frombuffer(r.weight, np.float32).reshape(r.sets, wide) for r in found], [np.frombuffer(r.above) for r in found])


INDEX = "block long, cluster int, n array<long>, terms binary, most binary, ends binary, slots binary, parts binary"


def clustered(rows: DataFrame, wide: int, count: int, total: int) -> DataFrame:
    """``block, cluster, doc_id`` and postings: every document in the cluster that the bisections give it.

    The upper levels are learned from a bounded sample and applied to every document. Their leaves are
    dealt to blocks of about ``BLOCK`` documents by a hash, so that a leaf of many alike documents
    is no single task, and each block is bisected further by itself, down to clusters of about ``CLUSTER``.
    A posting's ``part`` is what a term adds to a score before its weight; ``most`` is a term's highest one in the cluster.
    """
    upper = rows.sparkSession.sparkContext.broadcast(_upper(rows, wide, count))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            doc, term = _csr(ids, wide)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upper.value.leaf(doc, term, len(ids))), pa.array(np.arange(row, row + len(ids)))], names=[*batch.schema.names, "leaf", "row"])
            row += len(ids)

    kind = rows.schema["doc_id"].dataType.simpleString()
    dealt = rows.mapInArrow(leaves, f"doc_id {kind}, n long, ids binary, tfs binary, leaf long, row long")
    sizes = dealt.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.octet_length("ids") + F.octet_length("tfs")).alias("bytes")).collect()  # at most 2 ** LEVELS rows
    blocks, first = [], 0
    for row in sorted(sizes):
        many = math.ceil(max(row.n / (1.25 * BLOCK), row.bytes / BLOCK_BYTES))
        blocks += [F.lit(row.leaf), F.struct(F.lit(first).cast("long").alias("first"), F.lit(many).cast("long").alias("many"))]
        first += many
    at = F.create_map(*blocks)[F.col("leaf")]
    dealt = dealt.withColumn("block", at["first"] + F.pmod(F.xxhash64("doc_id", "ids", "row"), at["many"]))

    def built(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        block, ids, n = table.column("block")[0].as_py(), table.column("ids").to_pylist(), table.column("n").to_numpy()
        tf = np.frombuffer(b"".join(table.column("tfs").to_pylist()), np.uint32).astype(np.int64)
        doc, term = _csr(ids, wide)
        part = (1_000_000_000 * tf) // (1000 * tf + 12 * (75 + 25 * n * count // total)[doc])
        leaf = bisected(doc, term, len(ids), max(0, math.ceil(math.log2(len(ids) / CLUSTER))))
        out = []
        for c in np.unique(leaf):
            own = np.flatnonzero(leaf == c)
            number = np.full(len(ids), -1)
            number[own] = np.arange(len(own))
            mine = np.flatnonzero(number[doc] >= 0)
            mine = mine[np.argsort(term[mine], kind="stable")]
            terms, begin = np.unique(term[mine], return_index=True)
            most = np.maximum.reduceat(part[mine], begin) if len(mine) else np.zeros(0, np.int64)
            out.append((block, int(c), n[own], terms.astype(np.uint32), most.astype(np.uint32), np.append(begin[1:], len(mine)).astype(np.uint32)[: len(terms)], number[doc[mine]].astype(np.uint16), part[mine].astype(np.uint32), table.column("doc_id").take(pa.array(own)).to_pylist()))
        columns = [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.list_(pa.int64())), *(pa.array([r[k].tobytes() for r in out], pa.binary()) for k in range(3, 8)), pa.array([r[8] for r in out], pa.list_(table.schema.field("doc_id").type))]
        return pa.table(columns, names=["block", "cluster", "n", "terms", "most", "ends", "slots", "parts", "doc_id"])

    return dealt.drop("leaf", "row").groupBy("block").applyInArrow(built, f"{INDEX}, doc_id array<{kind}>")


# --- search


@dataclass
class Wanted:
    """The items of a block: for each, its terms' slots and weights times repeats, one item after another."""

    q: list[int]
    slot: np.ndarray
    weight: np.ndarray
    at: np.ndarray
    wide: int

    def bounds(self, terms: np.ndarray, most: np.ndarray) -> np.ndarray:
        """For each item, a score that no document of the cluster passes."""
        dense = np.zeros(self.wide, np.int64)
        dense[terms] = most
        return np.add.reduceat(dense[self.slot] * self.weight, self.at[:-1]) if len(self.q) else np.zeros(0, np.int64)


class _Cluster:
    def __init__(self, batch: pa.RecordBatch, row: int):
        read = lambda name, kind: np.frombuffer(batch.column(name)[row].as_py(), kind)
        self.terms, self.ends, self.slots, self.parts = read("terms", np.uint32), read("ends", np.uint32).astype(np.int64), read("slots", np.uint16), read("parts", np.uint32)
        self.doc_id = batch.column("doc_id")[row].as_py()

    def scores(self, slot: np.ndarray, weight: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.terms, slot)
        ok = place < len(self.terms)
        ok[ok] = self.terms[place[ok]] == slot[ok]
        place, weight = place[ok], weight[ok]
        end = self.ends[place]
        begin = np.where(place > 0, self.ends[place - 1], 0)
        size = end - begin
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        out = np.zeros(len(self.doc_id), np.int64)
        np.add.at(out, self.slots[at], self.parts[at].astype(np.int64) * np.repeat(weight, size))
        return out


def _last_null(doc_id) -> tuple:
    return (doc_id is None, doc_id)


class Best:
    """The ``top`` best documents of one item so far, and the least score that still counts."""

    def __init__(self, top: int, floor: int):
        self.top, self.floor, self.rows = top, floor, []

    def add(self, scores: np.ndarray, doc_id: list) -> None:
        some = np.flatnonzero(scores >= self.floor)
        if len(some):
            self.rows += [(int(scores[k]), doc_id[k]) for k in some]
            self.rows.sort(key=lambda r: (-r[0], _last_null(r[1])))
            del self.rows[self.top :]
            if len(self.rows) == self.top:
                self.floor = max(self.floor, self.rows[-1][0])


def _searched(index: DataFrame, wanted, floors: list[int], top: int) -> DataFrame:
    """``q, score, doc_id`` of the best documents, and ``visits``, of each task.

    For each item the clusters are visited by falling bound, until no bound reaches the least score that still
    counts. A cluster whose bound equals it is visited: it may hold a smaller id.
    """
    kind = index.schema["doc_id"].dataType.elementType.simpleString()

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = wanted.value
        best, visits = [Best(top, max(1, x)) for x in floors], np.zeros(len(items.q), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            bound = np.array([items.bounds(np.frombuffer(t, np.uint32), np.frombuffer(m, np.uint32)) for t, m in zip(batch.column("terms").to_pylist(), batch.column("most").to_pylist(), strict=True)])
            known: dict[int, _Cluster] = {}
            for k in range(len(items.q)):
                own = slice(items.at[k], items.at[k + 1])
                for c in np.argsort(-bound[:, k], kind="stable"):
                    if bound[c, k] < best[k].floor:
                        break
                    if c not in known:
                        known[c] = _Cluster(batch, int(c))
                    best[k].add(known[c].scores(items.slot[own], items.weight[own]), known[c].doc_id)
                    visits[k] += 1
        for k, q in enumerate(items.q):
            if visits[k]:
                rows = best[k].rows or [(None, None)]
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(rows), pa.int64()), pa.array([s for s, _ in rows], pa.int64()), pa.array([d for _, d in rows], index_type), pa.array([int(visits[k])] + [0] * (len(rows) - 1), pa.int64())], names=["q", "score", "doc_id", "visits"])
        trim()

    index_type = to_arrow_type(index.schema["doc_id"].dataType.elementType)
    return index.select("doc_id", "terms", "most", "ends", "slots", "parts").mapInArrow(visited, f"q long, score long, doc_id {kind}, visits long")


def _seeds(index: DataFrame, wanted) -> DataFrame:
    """For each item the block and cluster with the highest bound; only bounds are read."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = wanted.value
        top, where = np.zeros(len(items.q), np.int64), [(0, 0)] * len(items.q)
        for batch in batches:
            for block, cluster, terms, most in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                bound = items.bounds(np.frombuffer(terms, np.uint32), np.frombuffer(most, np.uint32))
                for k in np.flatnonzero(bound > top):
                    top[k], where[k] = bound[k], (block, cluster)
        some = np.flatnonzero(top)
        yield pa.RecordBatch.from_arrays([pa.array([items.q[k] for k in some], pa.int64()), pa.array(top[some]), pa.array([where[k][0] for k in some], pa.int64()), pa.array([where[k][1] for k in some], pa.int32())], names=["q", "bound", "block", "cluster"])

    each = index.select("block", "cluster", "terms", "most").mapInArrow(best, "q long, bound long, block long, cluster int")
    return each.groupBy("q").agg(F.max(F.struct("bound", "block", "cluster")).alias("s")).select("s.block", "s.cluster").distinct()


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.filter("score is not null").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _search_block(spark: SparkSession, docs: DataFrame, listed: DataFrame, top: int) -> tuple[DataFrame, DataFrame] | None:
    """Results and visits for some items' ``q, term, times``, which this brings to the driver."""
    rows = sorted(listed.select("q", "term", "times").collect())
    if not rows:
        return None
    terms = Terms.of(sorted({r.term for r in rows}))
    wide, slot = terms.perfect.size, {t: k for k, t in enumerate(terms.list())}
    held = keep(postings(docs, terms), "postings")
    count, total = held.agg(F.count("*"), F.sum("n")).first()
    if not count:
        return None
    df = document_counts(held, wide)
    index = keep(clustered(held, wide, count, total), "index")
    qs = sorted({r.q for r in rows})
    at = np.searchsorted([r.q for r in rows], [*qs, np.iinfo(np.int64).max])
    weight = [r.times * math.floor(1000 * math.log((2 * count + 2) / (2 * int(df[slot[r.term]]) + 1))) for r in rows]
    wanted = spark.sparkContext.broadcast(Wanted(qs, np.array([slot[r.term] for r in rows]), np.array(weight, np.int64), at, wide))
    first = index.join(F.broadcast(keep(_seeds(index, wanted), "seeds")), ["block", "cluster"], "left_semi")  # a row for each item at most
    floors = {r.q: r.score for r in _ranked(_searched(first, wanted, [0] * len(qs), top), top).filter(F.col("rank") == top).select("q", "score").collect()}
    found = keep(_searched(index, wanted, [floors.get(q, 0) for q in qs], top), "found")
    return _ranked(found, top), found.agg(F.sum("visits").alias("visits"))


def search(docs: DataFrame, items: DataFrame, top: int = 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents with the highest scores above 0 for each of ``items``.

    Terms are runs of ASCII letters and digits and of anything beyond ASCII, with A-Z lower-cased. With N
    documents that have a term, L terms in all of them, n in one, df documents that hold a term and tf
    occurrences in one, the term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))), a document's m is
    75 + (25 n N div L), and its score sums, over the item's terms with repeats, weight times
    (10**9 tf) div (1000 tf + 12 m). Equal scores come by ascending ``doc_id``, null last.

    Items are taken about ``ITEMS`` at a time, all documents for each. The index holds the postings of the terms
    that they ask for (no other can score), in clusters of about ``CLUSTER`` documents by recursive
    graph bisection, with each term's highest part in a cluster. First each item visits the cluster with its
    highest bound; the score of its ``top``-th document there is the least that counts. Then each task
    visits its clusters by falling bound until none can reach what counts: what isn't visited can't be in
    the result, so clusters decide the work and never the rows.

    Null and empty texts have no terms and aren't counted in N. Each row of ``docs`` is a document, rows
    with a null or repeated id too; each row of ``items`` is an item, so repeated ones give their rows as
    often, ranked apart. Items without terms, or without a match, give no rows. Other columns aren't read.
    """
    spark = docs.sparkSession
    listed = keep(item_terms(items), "item_terms")
    many, size = listed.agg(F.count_distinct("q"), F.sum(F.octet_length("term"))).first()
    blocks = 1 << max(0, math.ceil(max(many / ITEMS, (size or 0) / TERM_BYTES)) - 1).bit_length()
    kind, item = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    out = None
    for b in range(blocks):
        own: Column = F.xxhash64("q").bitwiseAND(blocks - 1) == b
        found = _search_block(spark, docs, listed.filter(own), top)
        if found:
            rows = keep(found[0].drop("visits"), "ranked")
            out = out.unionByName(rows) if out else rows
    if out is None:
        return spark.createDataFrame([], f"item_id {item}, rank int, doc_id {kind}, score long")
    return out.join(listed.select("q", "item_id").distinct(), "q").select("item_id", "rank", "doc_id", "score")
