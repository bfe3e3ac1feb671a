"""Phrase collocation mining: exact counts of phrases by perfect hashing of the candidates that counting can't rule out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .perfecthash import PerfectHash
from .scratch import keep
from .sums import PART, PARTS, parts_of, tree_sum, unpacked
from .textbytes import chunks, mix, slices, trim, word_hashes, words

U = np.uint64
#: Words of the longest phrase; buckets of a sieve, as a power of two: the least, and the most (a byte of a task's memory each).
LONGEST, SIEVE, WIDEST = 4, 24, 27
#: Words of the texts for each share of the candidates; text bytes that are taken at a time.
KEYS, TEXT = 1 << 20, 2 << 20
#: Shares of a language that are ranked apart before the last ranking.
SHARES = 64

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
GAP = np.zeros(256, bool)
GAP[[9, 32]] = True


@dataclass(frozen=True)
class Rule:
    """Occurrences that a phrase needs; the share in percent of them within a longer phrase that drops it; rows of a language; seed of the hashes."""

    support: int = 30
    inside: int = 80
    most: int = 2000
    seed: int = 0


def _combined(g: np.ndarray, h: np.ndarray, k: int) -> np.ndarray:
    return mix(g * U(0x9FB21C651E98DF25) + mix(h + U(k)))


def _lang_key(lang: str) -> U:
    return U(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _keyed(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For some megabytes of whole texts at a time: languages, bytes, and each word's text, start, end, key and whether the next word is in the same piece."""
    for part, at, data in chunks(batches, limit=TEXT):
        start, end, per = words(at, data, GAP | BREAK)
        text = np.repeat(np.arange(len(per)), per)
        lang = part.column("lang").cast(pa.string()).fill_null("und")
        known = lang.dictionary_encode()
        of = np.array([_lang_key(x) for x in known.dictionary.to_pylist()], U)[known.indices.to_numpy(zero_copy_only=False)] if len(lang) else np.zeros(0, U)
        key = mix(word_hashes(data, start, end, seed) + of[text])
        broken = np.concatenate([[0], np.cumsum(BREAK[data], dtype=np.int32)])
        joined = np.zeros(len(start), bool)
        joined[:-1] = (text[1:] == text[:-1]) & (broken[start[1:]] == broken[end[:-1]])
        yield lang, data, text, start, end, key, joined


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """``h, lang, word, f``: occurrences of each word of a language, and its 64-bit key."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data, text, start, end, key, _ in _keyed(batches, seed):
            h, first, n = np.unique(key, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), lang.take(pa.array(text[first])), slices(data, start[first], end[first]), pa.array(n)], names=["h", "lang", "word", "n"])

    each = docs.select("text", "lang").mapInArrow(counted, "h long, lang string, word string, n long")
    return each.groupBy("h", "lang", "word").agg(F.sum("n").alias("f"))


# --- sieves


@dataclass
class Sieve:
    """A bit for each bucket of hashes that met the support together; a hash whose bit isn't set can't be frequent by itself."""

    bits: np.ndarray

    def has(self, g: np.ndarray) -> np.ndarray:
        at = g >> U(64 - (8 * len(self.bits) - 1).bit_length())
        return (self.bits[at >> U(3)] >> (at & U(7)).astype(np.uint8) & 1).astype(bool)


def width(words: int, support: int) -> int:
    """Buckets, as a power of two, of which each has half the support or less where so many runs fall evenly; ``WIDEST`` at most."""
    return min(WIDEST, max(SIEVE, (2 * words // support).bit_length()))


def _sifted(parts: DataFrame, most: int, wide: int) -> dict[int, Sieve]:
    """The sieves of bucket counts; of each part, bits alone come to the driver: 2 to 16 MB for each of at most three lengths."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.packbits(unpacked(x.as_py()) >= most, bitorder="little").tobytes() for x in batch.column("counts")]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("part"), pa.array(found, pa.binary())], names=["k", "part", "bits"])

    out: dict[int, Sieve] = {}
    size = _part(wide) >> 3
    for row in tree_sum(parts, most).mapInArrow(bits, "k int, part int, bits binary").collect():
        held = out.setdefault(row.k, Sieve(np.zeros(1 << wide >> 3, np.uint8))).bits
        held[row.part * size : (row.part + 1) * size] = np.frombuffer(row.bits, np.uint8)
    return out


def _part(wide: int) -> int:
    """Buckets that are summed together: a sieve has equally many parts however wide it is."""
    return PART << (wide - SIEVE)


def _added(buckets: np.ndarray, g: np.ndarray, most: int) -> None:
    at, n = np.unique(g >> U(64 - (len(buckets) - 1).bit_length()), return_counts=True)
    buckets[at] = np.minimum(buckets[at] + np.minimum(n, most), most)


def word_sieve(frequent: DataFrame) -> dict[int, Sieve]:
    """The buckets of the keys ``h`` of frequent words, under length 1."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = np.zeros(1 << SIEVE, np.uint8)
        for batch in batches:
            _added(buckets, batch.column("h").to_numpy().view(U), 1)
        yield from parts_of({1: buckets})

    return _sifted(frequent.select("h").mapInArrow(marked, PARTS), 1, SIEVE)


def _runs(key: np.ndarray, joined: np.ndarray, sieves: dict[int, Sieve], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Starts and hashes of the runs of 2 to ``longest`` words of a piece, whose shorter runs all pass the sieves there are (words first)."""
    n = len(key)
    passes = sieves[1].has(key) if 1 in sieves and n else np.zeros(n, bool)
    at = np.flatnonzero(passes[:-1] & passes[1:] & joined[:-1])
    g = _combined(key[at], key[at + 1], 2)
    yield 2, at, g
    for k in range(3, longest + 1):
        if k - 1 in sieves:
            ok = sieves[k - 1].has(g)
            at, g = at[ok], g[ok]
        mark, full = np.zeros(n + 1, bool), np.zeros(n, U)
        mark[at], full[at] = True, g
        at = at[mark[at + 1]]
        g = _combined(full[at], key[at + k - 1], k)
        yield k, at, g


def run_sieves(docs: DataFrame, sieves: dict[int, Sieve], lengths: range, rule: Rule, wide: int = SIEVE) -> dict[int, Sieve]:
    """Buckets of the runs of ``lengths`` words that may be frequent as far as ``sieves`` say; a missing sieve lets nothing through."""
    most = min(rule.support, 255)
    held = docs.sparkSession.sparkContext.broadcast(sieves)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = {k: np.zeros(1 << wide, np.uint8) for k in lengths}
        for *_, key, joined in _keyed(batches, rule.seed):
            for k, _, g in _runs(key, joined, held.value, max(lengths)):
                if k in buckets:
                    _added(buckets[k], g, most)
        yield from parts_of(buckets, _part(wide))

    found = _sifted(docs.select("text", "lang").mapInArrow(counted, PARTS), most, wide)
    held.unpersist()
    return {k: found.get(k, Sieve(np.zeros(1 << wide >> 3, np.uint8))) for k in lengths}


CANDIDATES = "k int, h1 long, h2 long, h3 long, h4 long, n long"
WORDS = [f"h{j + 1}" for j in range(LONGEST)]


def candidates(docs: DataFrame, sieves, rule: Rule) -> DataFrame:
    """``k, h1 to h4, n``: each run of 2 to 4 words that passes its sieve, as do all runs within it, with its occurrences in some megabytes of text; words that it hasn't are 0."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, key, joined in _keyed(batches, rule.seed):
            for k, at, g in _runs(key, joined, sieves.value, LONGEST):
                ok = np.flatnonzero(sieves.value[k].has(g))
                _, first, n = np.unique(g[ok], return_index=True, return_counts=True)
                at = at[ok[first]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32))] + [pa.array(key[at + j].view(np.int64) if j < k else np.zeros(len(at), np.int64)) for j in range(LONGEST)] + [pa.array(n)], names=["k", *WORDS, "n"])

    return docs.select("text", "lang").mapInArrow(found, CANDIDATES)


# --- counting by slot


@dataclass
class Slots:
    """Stored keys of some candidates at the slots of their perfect hash, and their counts."""

    perfect: PerfectHash
    k: np.ndarray
    h: np.ndarray
    f: np.ndarray

    @classmethod
    def of(cls, k: np.ndarray, h: np.ndarray, n: np.ndarray) -> Slots | None:
        """From candidates that may come several times, with occurrences to be summed; None where two have the same hash."""
        g = h[0]
        for j in range(1, LONGEST):
            g = np.where(k > j, _combined(g, h[j], j + 1), g)
        perfect = PerfectHash(np.unique(g))
        slot = perfect.slots(g)
        one = np.zeros(perfect.size, np.int64)
        one[slot] = np.arange(len(slot))
        out = cls(perfect, k[one], h[:, one], np.zeros(perfect.size, np.int64))
        if (out.k[slot] != k).any() or (out.h[:, slot] != h).any():
            return None
        np.add.at(out.f, slot, n)
        return out


PHRASES = "k int, h1 long, h2 long, h3 long, h4 long, a long"


def counted(found: DataFrame, shares: int, rule: Rule) -> DataFrame:
    """The candidates that met the support, with their counts: each task numbers and counts a share of them; a row of length 0 says that two had the same hash."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema)
        if table.num_rows:
            k, *h, n = (table.column(c).to_numpy() for c in ("k", *WORDS, "n"))
            held = Slots.of(k, np.array([x.view(U) for x in h]), n)
            if held is None:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32())] + [pa.array([0], pa.int64())] * (LONGEST + 1), names=["k", *WORDS, "a"])
            else:
                at = np.flatnonzero(held.f >= rule.support)
                yield pa.RecordBatch.from_arrays([pa.array(held.k[at])] + [pa.array(x[at].view(np.int64)) for x in held.h] + [pa.array(held.f[at])], names=["k", *WORDS, "a"])
        trim()

    schema = pa.schema([("k", pa.int32()), *((h, pa.int64()) for h in WORDS), ("n", pa.int64())])
    return found.repartition(shares, "k", *WORDS).mapInArrow(summed, PHRASES)


def frequent_phrases(docs: DataFrame, frequent: DataFrame, rule: Rule, words: int = 0) -> DataFrame | None:
    """``k, h1 to h4, a``: every phrase of 2 to 4 words that meets the support, with its count.

    None where two candidates of a share have the same hash. ``frequent`` has the keys ``h`` and counts
    ``f`` of the words that meet the support; ``words`` is the number of all words of the texts. The
    texts are read once for each sieve and once for the candidates, however many these are.
    """
    spark: SparkSession = docs.sparkSession
    wide = width(words, rule.support)
    sieves = word_sieve(frequent)
    sieves |= run_sieves(docs, sieves, range(2, 3), rule, wide)
    sieves |= run_sieves(docs, sieves, range(3, LONGEST + 1), rule, wide)
    held = spark.sparkContext.broadcast(sieves)
    shares = max(spark.sparkContext.defaultParallelism, words // KEYS)
    phrases = keep(counted(candidates(docs, held, rule), shares, rule), "phrases")
    held.unpersist()
    return None if phrases.filter("k = 0").limit(1).count() else phrases


def with_cuts(some: DataFrame, phrases: DataFrame, frequent: DataFrame) -> DataFrame:
    """Adds to ``some`` of the phrases the counts of the parts of each cut, ``l`` and ``r``, an element for each cut; every part is a frequent phrase or word."""
    zero = F.lit(0).cast("long")
    h = [F.col(x) for x in WORDS]

    def part(cut: int, side: str, size: int, low: int, high: int) -> Column:
        return F.struct(F.lit(cut).alias("cut"), F.lit(side).alias("side"), F.lit(high - low).alias("pk"), *((h[low + j] if low + j < high else zero).alias(f"p{j + 1}") for j in range(LONGEST - 1)))

    of_size = [F.array(*(part(cut, side, size, *((0, cut) if side == "l" else (cut, size))) for cut in range(1, size) for side in "lr")) for size in range(2, LONGEST + 1)]
    parts = F.when(F.col("k") == 2, of_size[0]).when(F.col("k") == 3, of_size[1]).otherwise(of_size[2])
    each = some.select("k", *WORDS, "a", F.explode(parts).alias("p")).select("k", *WORDS, "a", "p.*")
    known = phrases.filter(F.col("k") < LONGEST).select(F.col("k").alias("pk"), *(h[j].alias(f"p{j + 1}") for j in range(LONGEST - 1)), F.col("a").alias("f"))
    known = known.unionByName(frequent.select(F.lit(1).alias("pk"), F.col("h").alias("p1"), zero.alias("p2"), zero.alias("p3"), "f"))
    joined = each.join(known, ["pk", *(f"p{j + 1}" for j in range(LONGEST - 1))])
    got = {f"{side}{cut}": F.coalesce(F.max(F.when((F.col("side") == side) & (F.col("cut") == cut), F.col("f"))), zero) for side in "lr" for cut in range(1, LONGEST)}
    summed = joined.groupBy("k", *WORDS, "a").agg(*(c.alias(name) for name, c in got.items()))
    return summed.select("k", *WORDS, "a", *(F.array(*(f"{side}{cut}" for cut in range(1, LONGEST))).alias(side) for side in "lr"))


def _without_parts_of_longer(phrases: DataFrame, rule: Rule) -> DataFrame:
    """Without the phrases that are mostly the inside of a longer one; of the longer ones those with one word more are enough, since none that holds them occurs more often."""
    zero = F.lit(0).cast("long")
    h = [F.col(f"h{j + 1}") for j in range(LONGEST)]
    front = [F.when(F.col("k") > j + 1, h[j]).otherwise(zero) for j in range(LONGEST)]
    back = [*h[1:], zero]
    longer = phrases.filter(F.col("k") > 2)
    inner = reduce(DataFrame.unionByName, (longer.select((F.col("k") - 1).alias("k"), *(x.alias(f"h{j + 1}") for j, x in enumerate(part)), F.col("a").alias("longer")) for part in (front, back)))
    most = inner.groupBy("k", "h1", "h2", "h3", "h4").agg(F.max("longer").alias("longer"))
    return phrases.join(most, ["k", "h1", "h2", "h3", "h4"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < rule.inside * F.col("a")))


def _lowest_cut() -> Column:
    """``score, k, l, r`` of the cut with the lowest score, in integers of 38 digits."""
    wide = lambda x: x.cast("decimal(19,0)")
    cuts = F.arrays_zip("l", "r", F.sequence(F.lit(1), F.lit(LONGEST - 1)).alias("cut"))
    scored = F.transform(F.filter(cuts, lambda x: x["cut"] < F.col("k")), lambda x: F.struct(F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * wide(F.col("a")), wide(x["l"]) + wide(x["r"])).alias("score"), x["cut"].alias("cut"), x["l"].alias("l"), x["r"].alias("r")))
    return F.array_min(scored)


def collocations(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's phrases of 2 to 4 words that occur most often for what their parts do.

    Texts are lower-cased in A-Z and split into pieces at ``. , ; : ! ?`` and line ends, and those into words at
    spaces and tabs. ``n`` counts a language's words, ``a`` a phrase's occurrences within pieces. Of the
    phrases with ``rule.support`` occurrences, each is scored by the cut that scores lowest,
    floor(2000000 a / (l + r)). A phrase of which ``rule.inside`` percent lie within one longer phrase goes.
    The ``rule.most`` first of each language stay, by score, count and phrase.

    A phrase can't be frequent unless all phrases within it are, nor unless all that share its bucket of a
    sieve are together; what passes these tests are the candidates. Sieves grow with the words up to
    2^``WIDEST`` buckets. One reading of the texts deals the candidates, with their counts in some megabytes of
    text, to tasks by hash. Each task numbers its share by a minimal perfect hash and counts in an array by
    number, after comparing the words' keys with those stored; the counts of a phrase's parts are joined to
    it. That words' hashes, and those of the phrases of a share, are all distinct is tested; where they aren't,
    everything is done again with another seed.

    Null texts are empty; a null language is ``und``, the same as a language of that name. Ids aren't read:
    repeated rows count each time. No documents, or no phrase with enough occurrences, give no rows.
    Other columns than ``text`` and ``lang`` aren't read.
    """
    docs = docs.select("text", "lang")
    for seed in range(rule.seed, rule.seed + 4):
        tried = Rule(rule.support, rule.inside, rule.most, seed)
        every = keep(word_counts(docs, seed), "words")
        if every.groupBy("h").count().filter("count > 1").limit(1).count():
            continue
        frequent = keep(every.filter(F.col("f") >= rule.support), "frequent_words")
        total = every.agg(F.sum("f")).first()[0] or 0
        phrases = frequent_phrases(docs, frequent.select("h", "f"), tried, total)
        if phrases is not None:
            break
    else:
        raise ValueError("hashes met under every seed")
    left = _without_parts_of_longer(phrases, rule)
    best = with_cuts(left, phrases, frequent.select("h", "f")).withColumn("cut", _lowest_cut()).select("h1", "h2", "h3", "h4", "a", "cut.score", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"))
    for j in range(LONGEST):
        named = frequent.select(F.col("h").alias(f"h{j + 1}"), F.col("word").alias(f"w{j + 1}"), *(["lang"] if not j else []))
        best = best.join(named, f"h{j + 1}", "left" if j > 1 else "inner")
    listed = best.select("lang", F.concat_ws(" ", "w1", "w2", "w3", "w4").alias("phrase"), "a", "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A share of a language keeps no more than the language does, so that no task ranks all its phrases.
    some = listed.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= rule.most)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= rule.most)
    total = every.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
