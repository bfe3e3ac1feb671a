"""N-gram Jaccard join: a grouped prefix join that finds every linked pair's component exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .scratch import attach, discard, keep, release
from .textbytes import as_list, chunks, mix, sets, shingles

#: Words of 64 bits in a set's parity bitmap.
BITMAP = 16
#: The most common shingles, which come last in a set's order. Their number bounds the broadcast (16 bytes each); it changes the candidates only.
COMMON = 200_000
#: Sets that a task remembers, so as to describe copies once.
SEEN = 1 << 20
#: Orders by which the first group of a list, its hub, is chosen.
ORDERS = 4
#: Members of a list that meet in a turn, about, and turns.
MEET, TURNS = 8, 2
#: One pair for so many members at most is verified at once; of more, the closest between each two components first.
FEW = 8
#: An entry of a prefix as bytes, how many a task sends at once, about, and shares of the elements for each partition.
ENTRY, SENT, DEALT = np.dtype([("token", "<i8"), ("g", "<i8"), ("n", "<i4"), ("pos", "<i4")]), 1 << 20, 16
_PRIME, _OTHER = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


@dataclass(frozen=True)
class Rule:
    """Shingles of ``size`` words; sets link when 100 * intersection >= percent * union."""

    size: int = 4
    percent: int = 85

    def links(self, both, a, b):
        return 100 * both >= self.percent * (a + b - both)

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """So many first elements that linked sets share one of them; none for sets that link with equal sets only."""
        return np.where(n >= self.least, n - -(-n * self.percent // 100) + 1, 0)

    @property
    def least(self) -> int:
        """The smallest size at which one element more or less doesn't part sets."""
        return next(n for n in range(1, 1000) if self.links(n, n, n + 1) or self.links(n - 1, n, n))

    def overlap(self, a, b):
        """Linked sets of these sizes share so many elements at least."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def possible(self, a, i, b, j):
        """Whether sets of sizes a and b may link if their first common element is at places i and j."""
        return np.minimum(a - i, b - j) >= self.overlap(a, b)

    def overlap_sql(self, a: str, b: str) -> str:
        return f"(({self.percent} * ({a} + {b}) + {99 + self.percent}) div {100 + self.percent})"

    def apart_sql(self, a: str, b: str) -> str:
        """The largest symmetric difference of linked sets of these sizes."""
        return f"({a} + {b} - 2 * {self.overlap_sql(a, b)})"

    def bucket(self, n: Column) -> Column:
        """Numbers of sizes such that linked sets are in one or in neighbouring buckets."""
        return F.floor(F.ln(n.cast("double")) * (0.999 / math.log(100 / self.percent))).cast("int")


def common_shingles(docs: DataFrame, rule: Rule, most: int = COMMON) -> np.ndarray:
    """The hashes of the most common shingles, the most common last.

    Every text is counted. A task counts a few million shingles at a time and passes on those that it
    met at least three times; the sums order what comes last in a prefix, so that a lower count costs
    time but never a link. Few more than ``most`` hashes reach the driver, however many partitions there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[c > 2].view(np.int64)), pa.array(c[c > 2])], names=["h", "c"])

        for _, at, data in chunks(batches):
            _, h = sets(*shingles(at, data, rule.size), len(at) - 1)
            held.append(h)
            n += len(h)
            if n > 3_000_000:
                yield counted()
                held, n = [], 0
        if held:
            yield counted()

    counts = docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    # Dealt by range, so that the driver takes the first ranges only; of orderBy().limit() it gets ``most`` rows from every partition.
    ranges = counts.repartitionByRange(F.desc("c"), "h").sortWithinPartitions(F.desc("c"), "h")
    top = ranges.limit(most).toPandas()
    return top["h"].to_numpy(np.int64)[::-1].view(np.uint64)


class Order:
    """The order of a set's elements: by hash, and after these the common ones, the most common last."""

    def __init__(self, common: np.ndarray):
        by = np.argsort(common)
        self.known, self.place = common[by], by + 1
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(common >> np.uint64(42)).astype(np.int64)] = True

    def rank(self, h: np.ndarray) -> np.ndarray:
        """0 for elements that aren't common."""
        rank = np.zeros(len(h), np.int64)
        spot = np.flatnonzero(self.maybe[(h >> np.uint64(42)).astype(np.int64)])
        if len(spot):
            at = np.minimum(np.searchsorted(self.known, h[spot]), len(self.known) - 1)
            rank[spot] = np.where(self.known[at] == h[spot], self.place[at], 0)
        return rank

    def places(self, n: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Each element's place in its set, from 0; ``h`` has set after set by hash, ``n`` their sizes."""
        text = np.repeat(np.arange(len(n)), n)
        rank = self.rank(h)
        plain = rank == 0
        upto = np.concatenate([[0], np.cumsum(plain)])
        first = np.cumsum(n) - n
        place = upto[:-1] - np.repeat(upto[first], n)
        late = np.flatnonzero(~plain)
        late = late[np.lexsort((rank[late], text[late]))]
        many = np.bincount(text[late], minlength=len(n))
        nth = np.arange(len(late)) - np.repeat(np.cumsum(many) - many, many)
        place[late] = (n - many)[text[late]] + nth
        return place


SETS = "n long, s1 long, s2 long, g long, prefix array<long>, bitmap array<long>"


def shingle_sets(docs: DataFrame, rule: Rule, common: np.ndarray) -> DataFrame:
    """For each document its set's size, a 128-bit signature, the key of its group (size and prefix), its prefix and a parity bitmap.

    Prefix and bitmap are null where the task has described an equal set already, and where ``doc_id`` is null.
    """
    held = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = Order(held.value), set()
        for batch, at, data in chunks(batches):
            count = len(at) - 1
            n, h = sets(*shingles(at, data, rule.size), count)
            text, first = np.repeat(np.arange(count), n), np.cumsum(n) - n
            s1, s2, g = np.zeros(count, np.uint64), np.zeros(count, np.uint64), np.zeros(count, np.uint64)
            p = np.where(n > 0, rule.prefix(n), 0)
            start = np.cumsum(p) - p
            prefix = np.zeros(int(p.sum()), np.uint64)
            if len(h):
                full = np.flatnonzero(n)
                s1[full] = np.add.reduceat(mix(h), first[full])
                s2[full] = np.add.reduceat(mix(h * _PRIME), first[full])
                place = order.places(n, h)
                early = np.flatnonzero(place < np.repeat(p, n))
                prefix[start[text[early]] + place[early]] = h[early]
                some = np.flatnonzero(p)
                if len(some):
                    g[some] = np.add.reduceat(mix(prefix * _OTHER), start[some])
                g = mix(g + n.astype(np.uint64))
            if len(seen) > SEEN:
                seen.clear()
            new = np.zeros(count, bool)
            for i, known in enumerate(zip(s1.tolist(), s2.tolist(), batch.column("doc_id").is_valid().to_pylist(), strict=True)):
                if known[2] and n[i] and known not in seen:
                    seen.add(known)
                    new[i] = True
            odd = text[np.repeat(new, n)] * (BITMAP * 64) + (h[np.repeat(new, n)] >> np.uint64(54)).astype(np.int64)
            bits = (np.bincount(odd, minlength=count * BITMAP * 64) & 1).astype(np.uint8).reshape(count, -1)[new]
            prefixes = as_list(p[new], prefix[np.repeat(new, p)].view(np.int64))
            bitmaps = as_list(np.full(int(new.sum()), BITMAP), np.packbits(bits, axis=1).view(np.int64).ravel())
            at_row = pa.array(np.where(new, np.cumsum(new) - 1, 0), mask=~new)
            cols = [batch.column("doc_id"), pa.array(n), *(pa.array(x.view(np.int64)) for x in (s1, s2, g))]
            cols += [x.take(at_row) for x in (prefixes, bitmaps)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "s1", "s2", "g", "prefix", "bitmap"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {SETS}")


def _entries(described: DataFrame) -> DataFrame:
    """``token, g, n, pos``: the prefix elements that at least two sets have; all entries of an element are in one partition.

    Most elements are in one set only. So entries are shuffled in shares, as bytes, and become rows only
    where their element comes again; a task holds one share of the elements at a time.
    """
    shares = DEALT * int(described.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = np.min_scalar_type(shares)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prefix")
            at = lists.offsets.to_numpy().astype(np.int64)
            every, g, n = lists.values.to_numpy(zero_copy_only=False), batch.column("g").to_numpy(), batch.column("n").to_numpy()
            low = 0
            while low < len(lists):
                high = max(low + 1, int(np.searchsorted(at, at[low] + SENT, "right")) - 1)
                many = np.diff(at[low : high + 1])
                rows = np.empty(int(at[high] - at[low]), ENTRY)
                rows["token"], rows["g"], rows["n"] = every[at[low] : at[high]], np.repeat(g[low:high], many), np.repeat(n[low:high], many)
                rows["pos"] = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)
                share = (rows["token"].view(np.uint64) % np.uint64(shares)).astype(kind)
                size = np.bincount(share, minlength=shares)
                rows = rows[np.argsort(share, kind="stable")]
                some = np.flatnonzero(size)
                ends = np.concatenate([[0], np.cumsum(size[some]) * ENTRY.itemsize]).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends), pa.py_buffer(rows)])
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), data], names=["share", "entries"])
                low = high

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def met() -> pa.RecordBatch:
            rows = np.frombuffer(b"".join(held), ENTRY)
            by = np.argsort(rows["token"])
            token = rows["token"][by]
            same = token[1:] == token[:-1]
            rows = rows[by[np.append(same, False) | np.append(False, same)]]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[c])) for c in ENTRY.names], names=ENTRY.names)

        for batch in batches:
            for share, entries in zip(batch.column("share").to_pylist(), batch.column("entries"), strict=True):
                if share != now and held:
                    yield met()
                    held.clear()
                now = share
                held.append(entries.as_buffer())
        if held:
            yield met()

    sets = described.filter("prefix IS NOT NULL").select("prefix", "g", F.col("n").cast("int").alias("n"))
    shared = sets.mapInArrow(dealt, "share int, entries binary").repartition("share").sortWithinPartitions("share")
    return shared.mapInArrow(again, "token long, g long, n int, pos int")


def shared_lists(described: DataFrame, rule: Rule) -> DataFrame:
    """``token, g, n, pos, hub, back, mate``: lists of groups that have a prefix element in common and may link by size.

    The groups of an element are sorted by size bucket and parted wherever a bucket is missing, since
    linked sets are in one or in neighbouring buckets; each part that has several groups is a list, and
    ``token`` is its own, made of the element and the part's first bucket. The first group of a bucket is
    its hub. ``hub`` is the bucket's hub and ``back`` that of the bucket before, where the sizes and places
    let the two link. Where a list is seen to have two groups only, ``mate`` is the other one: these two
    are a hub and its pair, or too far apart to link. The rows of an element pass one by one with three
    rows held, whatever a list's length.
    """
    # One number to sort by, which Spark does by radix: an element's first 36 bits, the size bucket, and a hash of the group.
    # Elements that meet in their first bits share a list, which adds candidates and loses none.
    bucket = F.shiftleft(F.least(rule.bucket(F.col("n")), F.lit(4095)).cast("long"), 16)
    by = F.col("token").bitwiseAND(F.lit(-1 << 28)).bitwiseOR(bucket).bitwiseOR(F.shiftrightunsigned(F.xxhash64("g", F.pmod("token", F.lit(ORDERS))), 48))
    entries = _entries(described).select("token", by.alias("by"), "g", "n", "pos").sortWithinPartitions("by")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int32, np.int32, bool, np.int64)]
        for batch in batches:
            if not batch.num_rows:
                continue
            token, by, g, n, pos = (np.concatenate([k, batch.column(i).to_numpy()]) for i, k in enumerate(kept[:5]))
            done = np.concatenate([kept[5], np.zeros(batch.num_rows, bool)])
            own = np.concatenate([kept[6], np.zeros(batch.num_rows, np.int64)])
            # Elements of one group only leave; the last row may go on in the next batch.
            again = by[1:] >> 28 == by[:-1] >> 28
            held = np.append(again, True) | np.append(False, again)
            old = int(held[: len(kept[6])].sum())
            token, by, g, n, pos, done, own = (x[held] for x in (token, by, g, n, pos, done, own))
            tied = np.append(by[1:] == by[:-1], False)
            tied[1:] |= tied[:-1]
            tied[:old] = False
            if len(spot := np.flatnonzero(tied)):
                move = spot[np.lexsort((g[spot], token[spot], by[spot]))]
                token[spot], g[spot], n[spot], pos[spot] = token[move], g[move], n[move], pos[move]
            own[old:] = mix(token[old:].view(np.uint64) + (by[old:] >> 16 & 4095).astype(np.uint64) * _PRIME).view(np.int64)
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (g[1:] != g[:-1])
            token, by, g, n, pos, done, own = (x[new] for x in (token, by, g, n, pos, done, own))
            b, token, whole, n, pos = by >> 16 & 4095, by >> 28, token, n.astype(np.int64), pos.astype(np.int64)
            first, opens = np.ones(len(token), bool), np.ones(len(token), bool)
            first[1:] = (token[1:] != token[:-1]) | (b[1:] > b[:-1] + 1)
            opens[1:] = first[1:] | (b[1:] != b[:-1])
            begins = np.flatnonzero(opens)
            nth = np.cumsum(opens) - 1
            hub = begins[nth]
            # The hub of the bucket before, if it is a neighbour in the same list; else the row itself.
            ahead = begins[np.maximum(np.arange(len(begins)) - 1, 0)]
            ahead = np.where((token[ahead] == token[begins]) & (b[ahead] == b[begins] - 1), ahead, begins)
            back = np.where(ahead[nth] == hub, np.arange(len(token)), ahead[nth])
            of = np.cumsum(first) - 1
            own = own[first][of]
            many = np.bincount(of)
            several = many[of] > 1
            out = several & ~done
            two = (many[of] == 2) & (of < of[-1]) & (np.bincount(of, weights=done)[of] == 0)
            mate = np.arange(len(token)) + np.where(first, 1, -1)
            mates = pa.array(g[np.where(two, mate, 0)], mask=~two).filter(pa.array(out))
            ends = [pa.array(g[x], mask=(x == np.arange(len(token))) | ~rule.possible(n, pos, n[x], pos[x])).filter(pa.array(out)) for x in (hub, back)]
            yield pa.RecordBatch.from_arrays([pa.array(own[out]), pa.array(g[out]), pa.array(n[out]), pa.array(pos[out].astype(np.int32)), *ends, mates], names=["token", "g", "n", "pos", "hub", "back", "mate"])
            last = len(token) - 1
            before = begins[nth[last] - 1] if nth[last] and of[begins[nth[last] - 1]] == of[last] else last
            hold = sorted({int(before), int(hub[last]), last})
            kept = [whole[hold], by[hold], g[hold], n[hold].astype(np.int32), pos[hold].astype(np.int32), (several | done)[hold], own[hold]]

    return entries.mapInArrow(run, "token long, g long, n long, pos int, hub long, back long, mate long")


def _full_sets(docs: DataFrame, ids: DataFrame, many: int, rule: Rule) -> DataFrame:
    """``rid, members`` for the wanted documents: their sorted shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, data in chunks(batches):
            n, h = sets(*shingles(at, data, rule.size), len(at) - 1)
            end = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([h[e - k : e].tobytes() for e, k in zip(end, n, strict=True)], pa.binary())], names=["rid", "members"])

    wanted = attach(docs.select("doc_id", "text"), ids.withColumnRenamed("rid", "doc_id"), "doc_id", "left_semi", 16.0 * many)
    return wanted.mapInArrow(run, "rid long, members binary")


def _verified(docs: DataFrame, pairs: DataFrame, described: DataFrame, rule: Rule) -> DataFrame:
    """Those of the candidate ``pairs(a, b)`` that link, by their whole sets.

    Sizes and parity bitmaps first drop, without loss, pairs that can't link; then the number of common
    elements in the prefixes, which are longer than the bitmaps and are sent only for the pairs that are
    left. Linked sets share so many elements that, without those behind the longer rest of the two, some
    are left that both prefixes must have in common.
    """
    traits = described.filter("prefix IS NOT NULL").select("doc_id", "n", "prefix", "bitmap")
    pairs = keep(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    ids = keep(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    traits = keep(attach(traits, ids, "doc_id", "left_semi", 16.0 * ids.count()), "traits")
    sides = lambda of, c: [of.select(F.col("doc_id").alias(x), F.col("n").alias("n" + x), F.col(c).alias(c + x)) for x in "ab"]
    a, b = sides(traits, "bitmap")
    alike = pairs.join(a, "a").join(b, "b").filter(f"100 * least(na, nb) >= {rule.percent} * greatest(na, nb)").filter(_unlike("bitmapa", "bitmapb") <= F.expr(rule.apart_sql("na", "nb")))
    alike = keep(alike.select("a", "b"), "alike")
    some = keep(alike.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "some")
    a, b = sides(attach(traits, some, "doc_id", "left_semi", 16.0 * some.count()), "prefix")
    common = f"size(array_intersect(prefixa, prefixb)) >= {rule.overlap_sql('na', 'nb')} - greatest(na - size(prefixa), nb - size(prefixb))"
    near = keep(alike.join(a, "a").join(b, "b").filter(common).select("a", "b"), "near")
    wanted = keep(near.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), "wanted")
    many = wanted.count()
    if not many:
        return near
    full = keep(_full_sets(docs, wanted, many, rule), "sets")
    discard(pairs, ids, traits, alike, some)
    release(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                good.append(rule.links(both, len(x), len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = near.join(full.select(F.col("rid").alias("a"), F.col("members").alias("x")), "a")
    two = one.join(full.select(F.col("rid").alias("b"), F.col("members").alias("y")), "b")
    links = keep(two.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")
    discard(near, wanted, full)
    release(docs.sparkSession)
    return links


def _unlike(a: str, b: str, words: int = BITMAP) -> Column:
    """The bits in which two parity bitmaps differ; the sets differ in as many elements at least."""
    return F.expr(" + ".join(f"bit_count({a}[{k}] ^ {b}[{k}])" for k in range(words)))


def _rows_left(lists: DataFrame, members: DataFrame, labels: DataFrame, described: DataFrame) -> DataFrame:
    """``token, rid, n, pos, comp, k, bitmap``: the members of lists that are of several components, and how many a list has.

    Lists and groups whose members are of one component are left out, and so are lists of two groups with
    one member each, whose pair has been tested. The others' groups are expanded into their members.
    """
    m = members.join(labels, members.rid == labels.node, "left").select("g", "rid", "n", F.coalesce("label", "rid").alias("comp"))
    of_group = m.groupBy("g").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("rid").alias("rid"), F.count("*").alias("m"))
    of_token = Window.partitionBy("token")
    multi = keep(of_group.filter("m > 1").select("g"), "multi")
    size = 16.0 * multi.count()
    pairs, row = lists.filter("mate IS NOT NULL"), ("token", "g", "n", "pos")
    again = attach(pairs, multi, "g", "left_semi", size).select(*row).union(attach(pairs, multi.withColumnRenamed("g", "mate"), "mate", "left_semi", size).select(*row)).distinct()
    listed = lists.filter("mate IS NULL").select(*row).union(again).join(of_group, "g").select("*", *(f.over(of_token).alias(x) for x, f in (("from", F.min("low")), ("to", F.max("high")), ("groups", F.count("*")), ("most", F.max("m")), ("k", F.sum("m")))))
    listed = keep(listed.filter("from < to AND (groups > 2 OR most > 1)").select("token", "g", "m", "rid", "n", "pos", F.col("low").alias("comp"), "k"), "listed")
    several = listed.filter("m > 1").select("token", "g", "pos", "k").union(of_group.filter("low < high AND m > 2").select(F.col("g").alias("token"), "g", F.lit(0).alias("pos"), F.col("m").alias("k")))
    rows = listed.filter("m = 1").select("token", "rid", "n", "pos", "comp", "k").union(several.join(m, "g").select("token", "rid", "n", "pos", "comp", "k"))
    half = BITMAP // 2  # a bitmap whose halves are laid on each other is a parity bitmap too
    bitmaps = described.filter("prefix IS NOT NULL").select(F.col("doc_id").alias("rid"), F.expr(f"zip_with(slice(bitmap, 1, {half}), slice(bitmap, {half + 1}, {half}), (x, y) -> x ^ y)").alias("bitmap"))
    rows = keep(rows.join(bitmaps, "rid").select("token", "rid", "n", "pos", "comp", "k", "bitmap"), "mixed")
    discard(listed, multi)
    release(lists.sparkSession)
    return rows


def _still_left(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of lists that are of several components yet, after a turn; ``rows`` is deleted.

    Lists of one slot are done: all their members have met. Lists that became one are few where most share
    elements by chance, so that their tokens are sent, not the rows.
    """
    now = rows.filter(f"k >= {2 * MEET}").join(labels, rows.rid == labels.node, "left").select("token", "rid", "n", "pos", F.coalesce("label", "rid").alias("comp"), "k", "bitmap")
    joined = keep(now.groupBy("token").agg(F.min("comp").alias("from"), F.max("comp").alias("to")).filter("from = to").select("token"), "joined")
    left = keep(attach(now, joined, "token", "left_anti", 16.0 * joined.count()), "mixed")
    discard(rows, joined)
    release(left.sparkSession)
    return left


def _sides(rows: DataFrame, *more: str) -> list[DataFrame]:
    return [rows.select(F.col("token").alias("t" + k), *(F.col(c).alias(c + k) for c in ("rid", "n", "pos", "comp", "bitmap", *more))) for k in "xy"]


def _may_link(rule: Rule) -> tuple[Column, Column]:
    """Whether rows x and y of a list may link by component, place and bitmap, and the bits in which they differ."""
    d = _unlike("bitmapx", "bitmapy", BITMAP // 2)
    may = F.expr(f"compx <> compy AND least(nx - posx, ny - posy) >= {rule.overlap_sql('nx', 'ny')}")
    return may & (d <= F.expr(rule.apart_sql("nx", "ny"))), d


def _ordered(near: DataFrame, d: Column) -> DataFrame:
    low = F.col("ridx") < F.col("ridy")
    comps = [F.when(low, F.col(p)).otherwise(F.col(q)).alias(c) for c, p, q in (("ca", "compx", "compy"), ("cb", "compy", "compx"))]
    return near.select(F.least("ridx", "ridy").alias("a"), F.greatest("ridx", "ridy").alias("b"), *comps, d.alias("d"))


def _closest(pairs: DataFrame) -> DataFrame:
    """``a, b``: of the pairs between each two components the one with the fewest different bits."""
    return pairs.groupBy(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).agg(F.min(F.struct("d", "a", "b")).alias("p")).select("p.a", "p.b")


def _met(rows: DataFrame, turn: int, rule: Rule) -> DataFrame:
    """``a, b, ca, cb, d``: the pairs of different components that may link, of the members that meet in this turn.

    Each list's members are dealt by chance to slots of about ``MEET``, and those of a slot meet: pairs
    that grow with the lists. Where many of a list's members link, most have met one of them then. Lists
    of fewer than twice ``MEET`` members are one slot.
    """
    dealt = rows.withColumn("slot", F.pmod(F.xxhash64("rid", "token", F.lit(turn)), F.expr(f"greatest(1, k div {MEET})")))
    x, y = _sides(dealt, "slot")
    may, d = _may_link(rule)
    near = x.join(y, (F.col("tx") == F.col("ty")) & (F.col("slotx") == F.col("sloty")) & F.expr("ridx < ridy") & may)
    return _ordered(near, d).distinct()


def _pairs_left(rows: DataFrame, rule: Rule) -> DataFrame:
    """``a, b, ca, cb, d``: every pair of different components ca and cb that may link, and the bits d in which they differ.

    Members outside a list's largest component meet the rest of the list; only pairs that pass by size,
    place and bitmap leave the join. ``rows`` is deleted.
    """
    largest = rows.groupBy("token", "comp").agg(F.count("*").alias("k")).groupBy("token").agg(F.max(F.struct("k", "comp")).getField("comp").alias("largest"))
    x, y = _sides(rows.join(largest, "token").withColumn("outer", F.col("comp") != F.col("largest")), "outer")
    may, d = _may_link(rule)
    near = x.filter("outerx").join(y, (F.col("tx") == F.col("ty")) & F.expr("ridx < ridy OR NOT outery") & may)
    near = keep(_ordered(near, d).distinct(), "left")
    discard(rows)
    release(near.sparkSession)
    return near


def jaccard_components(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs(doc_id, text)``.

    Documents of equal sets share a class; classes of equal size and prefix are one group. A prefix has a
    set's rarest shingles, so that groups that share none can't hold linked documents. In the list of
    groups that share one, each is paired with the first group of its size bucket and of the bucket
    before, and within a group each class with the first one: pairs that grow with the lists, not with
    their squares. They are filtered by size, by the places of the shared element, by bitmaps and by
    common elements of the prefixes, expanded and verified by whole sets. Then only pairs of different
    components are left. In a turn or two a list's members meet a few others of it by chance, in short lists all
    others, so that large groups of near copies join. All pairs of different components that are left
    after these are tested. Few pairs are verified at once; of many, the closest of each two components
    first, and what remains after.

    A document without words has no shingles, links with nothing and is its own component. Rows that
    share a ``doc_id`` are one node. A null ``doc_id`` never stands for a class that has another one.
    """
    docs = docs.select("doc_id", "text")
    every = keep(shingle_sets(docs, rule, common_shingles(docs, rule)), "shingled")
    carrier = F.when(F.col("prefix").isNotNull(), F.col("doc_id"))
    classes = keep(every.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min(carrier).alias("rid"), F.min("doc_id").alias("low"), F.first("g").alias("g")), "classes")
    members = classes.filter(F.col("rid").isNotNull() & (F.col("n") >= rule.least)).select("g", "rid", "n")
    lists = keep(shared_lists(every, rule), "lists")
    release(docs.sparkSession)

    heads = keep(members.groupBy("g").agg(F.min("rid").alias("head"), F.count("*").alias("m")), "heads")
    spokes = lists.select("g", F.explode(F.array("hub", "back")).alias("h")).filter("h IS NOT NULL").select(F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h")).distinct()
    between = spokes.join(heads.select("g", F.col("head").alias("a")), "g").join(heads.select(F.col("g").alias("h"), F.col("head").alias("b")), "h").select("a", "b")
    within = members.join(heads.filter("m > 1"), "g").filter("rid <> head").select(F.col("head").alias("a"), F.col("rid").alias("b"))
    tested = keep(between.union(within).filter("a <> b"), "tested")
    edges = _verified(docs, tested, every, rule)
    labels = components(edges)
    rows = _rows_left(lists, members, labels, every)
    discard(lists, heads)
    done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    many, later = members.count(), []
    for turn in range(TURNS):
        met = keep(_met(rows, turn, rule).join(done, ["a", "b"], "left_anti"), "met")
        at_once = met.count() * FEW <= many
        first = met.select("a", "b") if at_once else keep(_closest(met), "first")
        links = _verified(docs, first, every, rule)
        done = done.union(first)
        if not at_once:
            later.append(met)
        if not links.isEmpty():
            edges = edges.union(links)
            labels = components(edges)
        rows = _still_left(rows, labels)
        if at_once:  # where few that met may link, so do few of the others
            break
    if rows.isEmpty():
        discard(rows)
    else:
        later.append(_pairs_left(rows, rule))
    if later:
        of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias("l" + c))
        apart = lambda pairs: pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("la", "a") != F.coalesce("lb", "b"))
        left = reduce(DataFrame.union, later).select("a", "b", "d").distinct().join(done, ["a", "b"], "left_anti")
        left = keep(apart(left).select("a", "b", F.coalesce("la", "a").alias("ca"), F.coalesce("lb", "b").alias("cb"), "d"), "untested")
        at_once = left.count() * FEW <= many
        first = left.select("a", "b") if at_once else keep(_closest(left), "first")
        more = _verified(docs, first, every, rule)
        if not more.isEmpty():
            edges = edges.union(more)
            labels = components(edges)
        if not at_once:
            rest = _verified(docs, apart(left.select("a", "b").join(first, ["a", "b"], "left_anti")).select("a", "b"), every, rule)
            if not rest.isEmpty():
                labels = components(edges.union(rest))
    discard(tested)
    found = classes.join(labels, classes.rid == labels.node, "left").select("s1", "s2", "n", "low", F.coalesce("label", "rid").alias("comp"))
    lowest = found.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("low").alias("lowest"))
    answer = keep(found.join(lowest, "comp", "left").select("s1", "s2", "n", F.coalesce("lowest", "low").alias("component_id")), "answer")
    return every.select("doc_id", "n", "s1", "s2").join(answer, ["s1", "s2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and a column that tells its rows apart: ``doc_id`` where no id is null or repeated, else ``__row``, a number."""
    if docs.groupBy("doc_id").agg(F.count("*").alias("m")).filter("m > 1 OR doc_id IS NULL").isEmpty():
        return docs, "doc_id"
    # Written, so that a row has the same number wherever it is read.
    return keep(docs.withColumn("__row", F.monotonically_increasing_id()), "rows"), "__row"
