"""Suffix-array dedup: bytes under any 200-byte string that starts more than once in the corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, keep
from .textbytes import Substrings, as_list, chunks, mix, trim

#: Bytes of the strings, and of the anchors that they are dealt by.
WINDOW, GRAM = 200, 32
#: Bytes of contexts that a suffix array is built over, some 70 bytes of memory for each, and the most that one anchor gives it.
SHARD_BYTES, ANCHOR_BYTES = 1 << 20, 8 << 20
#: Bytes of texts whose anchors are found at once, some 130 bytes of memory for each.
ANCHOR_CHUNK = 1 << 19


def _eights(text: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes from each place on as a big-endian word, zeros beyond the end, and ``depth`` places more."""
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    word = np.ndarray((len(text) + depth,), ">u8", padded, strides=(1,))
    return word.astype(np.uint64)


def two_stage(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """The suffix array of ``text``, in which suffixes with the same first ``depth`` bytes come in any order.

    With ``wanted``, it holds those suffixes and the ones that they are induced by only: behind a wanted
    suffix of type A, its successors up to the first one of type B.

    Two stages: suffixes smaller than their successors (type B) are sorted directly, by eight bytes at
    a time within groups that are still equal. The others (type A) are induced by one scan of the
    buckets of first bytes, in order: an A suffix stands among its bucket's A suffixes as its
    successor stands in the array, and before the bucket's B suffixes.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int32)
    # i is of type B if its next different byte is larger; the end of the text is smaller than any byte.
    step = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    rises = np.append(text[step[:-1]] < text[step[1:]], False)
    b = np.repeat(rises, np.diff(step, prepend=-1))
    if wanted is None:
        held = np.ones(n, bool)
    else:
        place_of = np.arange(n, dtype=np.int32)
        last_b = np.maximum.accumulate(np.where(b, place_of, np.int32(-1)))
        held = np.maximum.accumulate(np.where(wanted, place_of, np.int32(-1)))
        held = np.concatenate([held[:1] > -1, held[1:] > last_b[:-1]])
        del place_of, last_b
    word = _eights(text, depth)
    order = np.flatnonzero(b & held).astype(np.int32)
    order = order[np.argsort(word[order])]
    same = np.zeros(len(order), bool)
    same[1:] = word[order[1:]] == word[order[:-1]]
    for k in range(8, depth, 8):
        tied = same.copy()
        tied[:-1] |= same[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(~same)[at]
        key = word[order[at] + k]
        if (key[1:][group[1:] == group[:-1]] != key[:-1][group[1:] == group[:-1]]).any():
            by = np.lexsort((key, group))
            order[at] = order[at[by]]
            key = key[by]
        equal = np.zeros(len(at), bool)
        equal[1:] = (group[1:] == group[:-1]) & (key[1:] == key[:-1])
        same[at] = equal
    del word, same
    sizes = np.bincount(text[held], minlength=256)
    of_b = np.bincount(text[order], minlength=256)
    start = np.cumsum(sizes) - sizes
    out = np.full(int(sizes.sum()), -1, np.int32)
    low = start + sizes - of_b
    b_at = np.concatenate([[0], np.cumsum(of_b)])
    for c in range(256):
        out[low[c] : low[c] + of_b[c]] = order[b_at[c] : b_at[c + 1]]
    del order, b
    head = start.copy()

    def place(at: np.ndarray, c: int) -> None:
        out[head[c] : head[c] + len(at)] = at
        head[c] += len(at)

    if held[n - 1]:
        place(np.array([n - 1]), int(text[n - 1]))
    for c in range(256):
        if not sizes[c]:
            continue
        done = start[c]
        while done < low[c]:  # A suffixes that begin with a run of c are induced by shorter runs of it
            new = out[done : head[c]]
            if not len(new):
                raise AssertionError("a bucket isn't filled")
            done = head[c]
            before = new[new > 0] - 1
            place(before[(text[before] == c) & held[before]], c)
        every = out[start[c] : start[c] + sizes[c]]
        before = every[every > 0] - 1
        before = before[(text[before] > c) & held[before]]
        first = text[before]
        by = np.argsort(first, kind="stable")
        for d, k, m in zip(*_groups(first[by]), strict=True):
            place(before[by[k : k + m]], int(d))
    return out


def _groups(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    value, at, count = np.unique(ordered, return_index=True, return_counts=True)
    return value, at, count


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix, ``depth`` at most, of each suffix with the one before it in ``order``; 0 for the first."""
    n = len(text)
    room = np.minimum(n - order, depth).astype(np.int32)
    out = np.zeros(len(order), np.int32)
    if len(order) < 2:
        return out
    room[1:] = np.minimum(room[1:], np.minimum(n - order[:-1], depth))
    whole = _eights(text, depth)
    live = np.arange(1, len(order), dtype=np.int32)
    for k in range(0, depth, 8):
        x, y = whole[order[live] + k], whole[order[live - 1] + k]
        differ = x != y
        ended = live[differ]
        if len(ended):
            zeros = 64 - np.frexp((x ^ y)[differ].astype(np.float64))[1]
            out[ended] = k + np.minimum(7, zeros // 8)
        live = live[~differ]
        if not len(live):
            break
        out[live] = k + 8
    return np.minimum(out, room)


def repeated_starts(text: np.ndarray, may_start: np.ndarray, weight: np.ndarray, depth: int) -> np.ndarray:
    """Which of the allowed places start a string of ``depth`` bytes that starts at least twice, by weight."""
    order = two_stage(text, depth, may_start)
    order = order[may_start[order]]
    block = np.cumsum(common_prefixes(text, order, depth) < depth, dtype=np.int32) - 1
    n = np.bincount(block, weights=weight[order], minlength=1)
    out = np.zeros(len(text), bool)
    out[order] = n[block] > 1
    return out


def anchors(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of window starts with the same anchor: text, first start, length, anchor hash, content hash.

    A window's anchor is the leftmost of its 32-byte grams with the smallest hash, which depends on the
    window's bytes only: equal windows have equal anchors. Each window is in exactly one run.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    size = np.diff(at)
    if not (size >= WINDOW).any():
        return none
    n = len(data)
    sub = Substrings(data)
    place = np.arange(n - GRAM + 1)
    gram = sub.of(place, place + GRAM)
    span = WINDOW - GRAM + 1
    bits = np.uint64(max(1, int(n).bit_length()))
    key = gram >> bits << bits | place.astype(np.uint64)
    full = np.full(-(-len(key) // span) * span, ~np.uint64(0))
    full[: len(key)] = key
    tiles = full.reshape(-1, span)
    ahead = np.minimum.accumulate(tiles, axis=1).ravel()
    behind = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - WINDOW + 1
    best = np.minimum(behind[:starts], ahead[span - 1 : span - 1 + starts])
    anchor = (best & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = np.repeat(np.arange(len(size)), np.where(size > 0, size, 0))[:starts]
    valid = np.arange(starts) + WINDOW <= at[text + 1]
    new = np.ones(starts, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new & valid)
    ends = np.flatnonzero(np.append(new[1:] | ~valid[1:], True) & valid)
    length = ends - first + 1
    content = sub.of(first, first + length - 1 + WINDOW)
    return text[first], first - at[text[first]], length, gram[anchor[first]].view(np.int64), content.view(np.int64)


def _union(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted spans merged where they touch."""
    by = np.argsort(begin, kind="stable")
    begin, end = begin[by], np.maximum.accumulate(end[by])
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(begin) - 1)
    return begin[new], end[last]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, at, data in chunks(batches, limit=ANCHOR_CHUNK):
        text, start, length, anchor, content = anchors(at, data)
        key = batch.column("key").take(pa.array(text))
        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(content), key, pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32))], names=["anchor", "content", "key", "start", "len"])


def _anchor_rows(docs: DataFrame) -> DataFrame:
    return docs.select("key", "text").mapInArrow(_runs, "anchor long, content long, key binary, start int, len int")


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``anchor, content, copies, bytes`` of the wanted runs, each once, cut out of one text that holds it; equal texts become one before they are dealt."""
    per_text = wanted.groupBy("key").agg(F.collect_list(F.struct("anchor", "content", "copies", "start", "len")).alias("runs"))
    texts = docs.groupBy("key").agg(F.first("text").alias("text")).join(per_text, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, runs in zip(batch.column("text"), batch.column("runs"), strict=True):
                data, v = (text.as_py() or "").encode(), runs.values
                start, length = v.field(3).to_numpy(), v.field(4).to_numpy()
                yield pa.RecordBatch.from_arrays([v.field(0), v.field(1), v.field(2), pa.array([data[s : s + k - 1 + WINDOW] for s, k in zip(start.tolist(), length.tolist(), strict=True)], pa.binary())], names=["anchor", "content", "copies", "bytes"])

    return texts.select("text", "runs").mapInArrow(run, "anchor long, content long, copies long, bytes binary")


MARKS = "anchor long, content long, begin array<int>, end array<int>"


def _marks(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated spans of each context in a task's share, by suffix arrays over whole anchors of about ``SHARD_BYTES``."""
    held: list[tuple] = []
    group: list[tuple] = []
    size = more = 0

    def solved() -> pa.RecordBatch:
        length = np.array([len(r[3]) for r in held])
        text = np.frombuffer(b"".join(r[3] for r in held), np.uint8)
        end = np.cumsum(length)
        row = np.repeat(np.arange(len(held), dtype=np.int32), length)
        # Contexts hold a window at least.
        allowed = np.ones(len(text), bool)
        for k in range(1, WINDOW):
            allowed[end - k] = False
        hit = np.flatnonzero(repeated_starts(text, allowed, np.minimum([r[2] for r in held], 2).astype(np.uint8)[row], WINDOW))
        of, local = row[hit], hit - (end - length)[row[hit]]
        new = np.ones(len(hit), bool)
        new[1:] = (of[1:] != of[:-1]) | (local[1:] != local[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:] - 1, len(hit) - 1) if len(hit) else first
        n = np.bincount(of[first], minlength=len(held))
        some = n > 0
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r, s in zip(held, some, strict=True) if s], pa.int64()), pa.array([r[1] for r, s in zip(held, some, strict=True) if s], pa.int64()), as_list(n[some], local[first].astype(np.int32)), as_list(n[some], (local[last] + WINDOW).astype(np.int32))], names=["anchor", "content", "begin", "end"])

    for batch in groups:
        for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if group and row[0] != group[-1][0]:
                held, group, size, more = held + group, [], size + more, 0
            # An anchor that doesn't fit in beside others has a suffix array of its own.
            if held and size + more + len(row[3]) > SHARD_BYTES:
                yield solved()
                held, size = [], 0
            group.append(row)
            more += len(row[3])
    held += group
    if held:
        yield solved()
    held = group = []
    trim()


def _hot_marks(contexts: DataFrame) -> DataFrame:
    """The spans of contexts whose anchor has too many of them for one task: each window is counted by itself."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, content, copies, data in zip(*(batch.column(k) for k in range(4)), strict=True):
                d = np.frombuffer(data.as_py(), np.uint8)
                s, p = Substrings(d), np.arange(len(d) - WINDOW + 1)
                h = s.of(p, p + WINDOW)
                yield pa.RecordBatch.from_arrays([pa.array([anchor.as_py()] * len(p), pa.int64()), pa.array([content.as_py()] * len(p), pa.int64()), pa.array([copies.as_py()] * len(p), pa.int64()), pa.array(p.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(mix(h ^ s.of(p, p + WINDOW // 2)).view(np.int64))], names=["anchor", "content", "copies", "p", "w", "v"])

    each = keep(contexts.select("anchor", "content", "copies", "bytes").mapInArrow(windows, "anchor long, content long, copies long, p int, w long, v long"), "windows")
    twice = each.groupBy("w", "v").agg(F.sum("copies").alias("m")).filter("m > 1").select("w", "v")
    hit = each.join(twice, ["w", "v"], "left_semi")
    return hit.groupBy("anchor", "content").agg(F.sort_array(F.collect_list("p")).alias("begin")).select("anchor", "content", "begin", F.transform("begin", lambda p: p + WINDOW).alias("end"))


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``key, begin, end``: for each text with repeated 200-byte strings the spans under them, as sorted byte offsets.

    ``docs`` has ``key``, a 128-bit hash of the text, and ``text``. Windows are dealt by their anchors. Runs of
    windows with equal bytes collapse into one context with a count; an anchor that occurs once can't
    have a repeated window. The contexts of whole anchors are sorted together, some megabytes at a time,
    by ``two_stage``, and equal adjacent prefixes of 200 bytes mark what repeats. Contexts of an anchor
    with more than ``ANCHOR_BYTES`` of them are resolved window by window instead.
    """
    # Equal texts give equal rows, which become one with a count before anything is joined by text.
    rows = keep(_anchor_rows(docs).groupBy("anchor", "content", "key", "start", "len").agg(F.count("*").alias("n")), "rows")
    # Written, so that both sides of the join are plain shuffles, which the planner can split where an anchor is hot.
    often = keep(rows.groupBy("anchor").agg(F.sum("n").alias("m")).filter("m > 1").select("anchor"), "often")
    runs = keep(rows.join(often, "anchor", "left_semi"), "runs")
    discard(rows, often)
    distinct = keep(runs.groupBy("anchor", "content").agg(F.sum("n").alias("copies"), F.min(F.struct("key", "start", "len")).alias("one")).select("anchor", "content", "copies", "one.*"), "contexts")
    of_anchor = distinct.groupBy("anchor").agg(F.sum(F.col("len") + WINDOW - 1).alias("bytes"))
    hot = keep(of_anchor.filter(F.col("bytes") > ANCHOR_BYTES).select("anchor"), "hot")
    has_hot = not hot.isEmpty()
    total = distinct.agg(F.sum(F.col("len") + WINDOW - 1).alias("b")).first()
    shards = max(docs.sparkSession.sparkContext.defaultParallelism, int((total["b"] or 0) // (4 * SHARD_BYTES)) + 1)
    contexts = _contexts(docs, distinct)
    if has_hot:
        contexts = keep(contexts, "cut")
    plain = (contexts.join(hot, "anchor", "left_anti") if has_hot else contexts).repartition(shards, "anchor").sortWithinPartitions("anchor", "content")
    marks = plain.mapInArrow(_marks, MARKS)
    if has_hot:
        marks = marks.union(_hot_marks(contexts.join(hot, "anchor", "left_semi")))
    marks = keep(marks, "marks")
    discard(distinct, hot, *([contexts] if has_hot else []))
    spans = runs.join(marks, ["anchor", "content"]).select("key", F.transform("begin", lambda x: x + F.col("start")).alias("begin"), F.transform("end", lambda x: x + F.col("start")).alias("end"))
    return spans.groupBy("key").agg(F.flatten(F.collect_list("begin")).alias("begin"), F.flatten(F.collect_list("end")).alias("end"))


def _with_spans(docs: DataFrame) -> DataFrame:
    keyed = docs.withColumn("__key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    spans = keep(repeated_spans(keyed.select(F.col("__key").alias("key"), "text")), "spans").select(F.col("key").alias("__key"), "begin", "end")
    return keyed.join(spans, "__key", "left").drop("__key")


def dedup_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row of ``docs(doc_id, text)``.

    A byte goes if a 200-byte string over it also starts elsewhere, in this text or any other; that is
    judged on the input. A null text is empty; a text of fewer than 200 bytes keeps all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, begin, end in zip(batch.column("text"), batch.column("begin"), batch.column("end"), strict=True):
                data = (text.as_py() or "").encode()
                parts, gone, n = _kept(data, begin, end)
                rows.append((len(data), gone, n, hashlib.sha256(b"".join(parts)).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, [pa.int64()] * 3 + [pa.string()], strict=True))], names=[f.split()[0] for f in KEPT.split(", ")])

    return _with_spans(docs.select("doc_id", "text")).select("doc_id", "text", "begin", "end").mapInArrow(run, KEPT)


def _kept(data: bytes, begin: pa.ListScalar, end: pa.ListScalar) -> tuple[list[bytes], int, int]:
    if begin.as_py() is None or not len(begin):
        return [data], 0, 0
    b, e = _union(begin.values.to_numpy(), end.values.to_numpy())
    at = [0, *np.stack([b, e], 1).ravel().tolist(), len(data)]
    return [data[i:j] for i, j in zip(at[::2], at[1::2], strict=True)], int((e - b).sum()), len(b)


def without_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the repeated spans cut out of ``text``; bytes of a broken character go with its span.

    Rows and other columns stay as they are. A null text stays null.
    """
    rest = [c for c in docs.columns if c != text]
    clash = {"begin", "end", "__key"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are made here; rename them")
    names, schema = docs.columns, docs.schema
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if t.as_py() is None else b"".join(_kept(t.as_py().encode(), b, e)[0]).decode(errors="ignore") for t, b, e in zip(batch.column("text"), batch.column("begin"), batch.column("end"), strict=True)]
            cols = [batch.column(c) for c in rest]
            cols.insert(at, pa.array(out, pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    spans = _with_spans(docs.withColumnRenamed(text, "text"))
    return spans.select(*rest, "text", "begin", "end").mapInArrow(run, schema)
