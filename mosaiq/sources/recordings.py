"""Motion, speech and sound recordings as tables, and their writers."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pairing import small

MARKER = "tx ty tz qx qy qz qw".split()


def read_motion(spark: SparkSession, arrays: str, meta: str) -> DataFrame:
    """``record_id, t, marker, tx..qw, labels`` from a meta JSON (records with ``data_id`` and ``labels``, ``marker_names``) and npz arrays (T x markers x 7)."""
    m = spark.read.json(meta, multiLine=True)
    names = m.select(F.posexplode("marker_names").alias("m", "marker"))
    labels = m.select(F.posexplode("records").alias("record_id", "r")).select("record_id", F.col("r.data_id").alias("data_id"), F.col("r.labels").alias("labels"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for blob in b["content"]:
                with np.load(io.BytesIO(blob)) as found:
                    for key in found.files:
                        x = found[key]
                        t, k = np.indices(x.shape[:2]).reshape(2, -1)
                        yield pd.DataFrame({"data_id": key, "t": t, "m": k} | {c: x[..., i].ravel() for i, c in enumerate(MARKER)})

    raw = spark.read.format("binaryFile").load(arrays).select("content").mapInPandas(run, "data_id string, t int, m int, " + ", ".join(f"{c} double" for c in MARKER))
    return raw.join(small(names), "m").join(labels, "data_id").select("record_id", "t", "marker", *MARKER, "labels")


def read_sounds(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records ``speaker_id, speaker, pos, audio, tags, transcription, style`` and the tag table ``id, name`` of a sound JSON."""
    j = spark.read.json(path, multiLine=True)
    tags = j.select(F.posexplode("tags").alias("id", "name"))
    s = j.select(F.posexplode("speakers").alias("speaker_id", "s"))
    r = s.select("speaker_id", F.col("s.name").alias("speaker"), F.posexplode("s.records").alias("pos", "r"))
    has = set(r.schema["r"].dataType.names)
    opt = lambda c: F.col(f"r.{c}") if c in has else F.lit(None).cast("string")
    return r.select("speaker_id", "speaker", "pos", F.col("r.audio_file").alias("audio"), F.col("r.tags").alias("tags"), opt("transcription").alias("transcription"), opt("style").alias("style")), tags


def write_sounds(records: DataFrame, path: str) -> None:
    """Records nested under their speakers, one JSON object a speaker; an existing path is an error."""
    nested(records, ("speaker_id", "speaker"), "pos", "audio", "tags", "transcription", "style").withColumnRenamed("speaker", "name").write.mode("errorifexists").json(path)


def without(records: DataFrame, blacklist: DataFrame, on: tuple[str, ...] = ("speaker_id", "pos")) -> DataFrame:
    """Records but for those whose key is in ``blacklist``."""
    return records.join(blacklist.select(*on), list(on), "left_anti")


def nested(records: DataFrame, by: tuple[str, ...], order: str, *fields: str) -> DataFrame:
    """``by..., records``: each key's records as one array in order."""
    each = F.struct(order, F.struct(*fields).alias("r"))
    return records.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["r"]).alias("records"))


def unnested(groups: DataFrame, *by: str) -> DataFrame:
    """``by..., pos`` and the fields of each of the ``records``, numbered as they come; the inverse of ``nested``."""
    return groups.select(*by, F.posexplode("records").alias("pos", "r")).select(*by, "pos", "r.*")


def of_either(a: DataFrame, b: DataFrame, *on: str) -> DataFrame:
    """Records that ``a`` or ``b`` has, with null where one is missing."""
    return a.join(b, list(on), "full")


def first_tags(records: DataFrame, tags: DataFrame, speaker: int | None = None) -> DataFrame:
    """Adds ``label``, the name of a record's first tag; of one speaker's records, if given. The tag names are joined by Spark's own choice."""
    mine = records if speaker is None else records.filter(F.col("speaker_id") == speaker)
    return mine.withColumn("id", F.get("tags", F.lit(0))).join(tags.select("id", F.col("name").alias("label")), "id", "left").drop("id")


def in_all(records: DataFrame) -> DataFrame:
    """Records of ``read_speech`` that have both a sound and a text."""
    return records.filter("audio IS NOT NULL AND transcription IS NOT NULL")


def read_utterances(spark: SparkSession, path: str, tag: str = "vistag") -> DataFrame:
    """The first utterance of each XML file: ``path, audio, transcription, tags``."""
    x = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    first = lambda q: F.xpath_string("value", F.lit(f"(//utterance)[1]{q}"))
    return x.select("path", first("/audio").alias("audio"), first("/trans/*[3]").alias("transcription"), F.xpath("value", F.lit(f"(//utterance)[1]//{tag}/text()")).alias("tags"))


def speaker_info(spark: SparkSession, path: str) -> DataFrame:
    """``id, age, gender, accent, region`` of lines parted by white space; the region is the rest of the line."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter("trim(value) <> ''").select(p[0].alias("id"), p[1].try_cast("int").alias("age"), p[2].alias("gender"), p[3].alias("accent"), F.array_join(F.slice(p, 5, 1000), " ").alias("region"))


def read_speech(spark: SparkSession, wavs: str, texts: str) -> DataFrame:
    """``speaker, name, audio, transcription, style`` of all names that have a sound or a text, null where one is missing."""
    stem = F.regexp_extract("path", r"([^/]+)/([^/]+)\.\w+$", 2)
    who = F.regexp_extract("path", r"([^/]+)/([^/]+)\.\w+$", 1)
    a = spark.read.format("binaryFile").load(wavs).select("path").select(who.alias("speaker"), stem.alias("name"), F.col("path").alias("audio"))
    b = spark.read.text(texts, wholetext=True).select(F.input_file_name().alias("path"), F.trim("value").alias("transcription")).select(who.alias("speaker"), stem.alias("name"), "transcription")
    return of_either(a, b, "speaker", "name").withColumn("style", F.lit("ADS"))


def read_wavs(spark: SparkSession, path: str) -> DataFrame:
    """``path, rate, samples`` of 16-bit mono sound files, one file's samples in memory at a time; ``formats`` reads long files in stretches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, blob in zip(b["path"], b["content"], strict=True):
                with wave.open(io.BytesIO(blob)) as w:
                    x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.int32)
                yield pd.DataFrame([(p, w.getframerate(), x)], columns=["path", "rate", "samples"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, rate int, samples array<int>")


def codebooks(wavs: DataFrame, sizes: tuple[int, int, int], mode: str = "iterative", seed: int = 0) -> list[np.ndarray]:
    """Codebooks of all frames' cepstra, their differences and second differences, from ``wavs(rate, samples)``.

    Frames become rows of three arrays in one pass; every codebook is learned from all of them.
    """
    from ..functions import sound
    from ..operators.quantize import build_codebook

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for rate, samples in zip(b["rate"], b["samples"], strict=True):
                c = sound.mfcc(samples, int(rate))
                d = sound.delta(c)
                yield pd.DataFrame({name: list(x.T) for name, x in zip("cde", (c, d, sound.delta(d)), strict=True)})

    frames = wavs.select("rate", "samples").mapInPandas(run, "c array<double>, d array<double>, e array<double>")
    books = [build_codebook(frames.select(F.col(name).alias("v")), k, mode, seed) for name, k in zip("cde", sizes, strict=True)]
    return [np.array([r["centroid"] for r in book.orderBy("code").collect()]) for book in books]


def joined(wavs: DataFrame, order: str) -> tuple[int, np.ndarray]:
    """The rate and all samples of a few sounds behind one another in the given order, on the driver; rates must agree.

    For lists of files that make one sound; a corpus stays a table of ``read_wavs``.
    """
    parts = wavs.orderBy(order).select("rate", "samples").collect()
    if len({r["rate"] for r in parts}) != 1:
        raise ValueError("sounds of different rates, or none")
    return parts[0]["rate"], np.concatenate([np.array(r["samples"], np.int32) for r in parts])


def cropped(rate: int, samples: np.ndarray, start: float, end: float, offset: float = 0.0) -> tuple[int, np.ndarray]:
    """The samples between two times of a sound that begins at ``offset``; times outside of it are an error."""
    low, high = (start - offset) * rate, (end - offset) * rate
    if low < -1e-3 or high > len(samples) + 1e-3 or high < low:
        raise ValueError(f"{start} to {end} is out of {offset} to {offset + len(samples) / rate}")
    return rate, samples[round(low) : round(high)]


def save_wav(path: str, rate: int, samples: np.ndarray) -> None:
    with open(path, "xb") as f:
        f.write(wav_bytes(rate, samples))


def wav_bytes(rate: int, samples: np.ndarray) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.asarray(samples, "<i2").tobytes())
    return out.getvalue()


def export(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes a table as parquet, json or csv; an existing path is an error."""
    df.write.mode("errorifexists").format(kind).save(path)
