"""Token counts of whole texts: vocabulary strings proved to be one token are counted as they stand, the rest is merged."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import chunks

MARK = "▁"
#: Characters of a text that are split at a time, other units than whole tokens that a worker remembers, and units that are merged in one call.
SPAN, REMEMBERED, MERGED = 1 << 20, 200_000, 4096


class Counter:
    """Counts as the SentencePiece model's own encoder does, without begin and end tokens.

    What is proved when the model is loaded, from the vocabulary alone:

    * The model merges, and only what gives a piece. A space counts as the mark, and one mark stands before each text.
    * No piece has a mark behind another character, so nothing is merged across the start of a run of marks.
    * A character that is in no piece of several characters is never merged; it is a unit of its own.
    * A line feed is in no piece at all: it parts units that stand in one text, and gives the token of its byte.

    So a text's tokens are those of its units. A vocabulary string that the encoder, asked for each one,
    gives as a single token is a whole token: such a unit counts one without being merged.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        pieces = [sp.id_to_piece(i) for i in plain]
        joined = {c for p in pieces if len(p) > 1 for c in p}
        self.feed = sp.encode("\n")[-1]
        probe = " \t a  ﬁ\r\n "
        if sp.normalize(probe) != MARK + probe.replace(" ", MARK) or any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces) or any(sp.is_unused(i) for i in plain) or not sp.is_byte(self.feed):
            raise ValueError("units of this model's texts can't be proved to be apart")
        inside = "".join(re.escape(c) for c in sorted(joined - {MARK}))
        marks = f"[ {MARK}]"
        self.units = re.compile(f"{marks}*[{inside}]+|{marks}+|[^ {MARK}{inside}]" if inside else f"{marks}+|[^ {MARK}]", re.S)
        self.edge = re.compile(f"(?<=[^ {MARK}]){marks}|[^ {MARK}{inside}]", re.S)
        self.whole = {p.replace(MARK, " "): 1 for p, n in zip(pieces, self.merged([p.replace(MARK, " ") for p in pieces]), strict=True) if n == 1}
        self.whole["\n"] = 1  # the token of its byte
        self.known = dict(self.whole)

    def merged(self, units: list[str]) -> list[int]:
        """Tokens of each unit, none of which has a line feed, by the model's encoder."""
        out: list[int] = []
        for k in range(0, len(units), MERGED):
            ids = np.array(self.sp.encode("\n" + "\n".join(units[k : k + MERGED]) + "\n"))
            out += (np.diff(np.flatnonzero(ids == self.feed)) - 1).tolist()
        return out

    def spans(self, text: str) -> Iterator[str]:
        """The text with the mark before it, in spans that begin where units do."""
        text, low = " " + text, 0
        while len(text) - low > SPAN and (edge := self.edge.search(text, low + SPAN)):
            yield text[low : edge.start()]
            low = edge.start()
        yield text[low:] if low else text

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; an empty text has none."""
        out = []
        for text in texts:
            n = 0
            for span in self.spans(text) if text else ():
                units = self.units.findall(span)
                new = [*set(units).difference(self.known)]
                if len(self.known) - len(self.whole) + len(new) > REMEMBERED:
                    self.known = dict(self.whole)
                    new = [*set(units).difference(self.known)]
                self.known.update(zip(new, self.merged(new), strict=True))
                n += sum(map(self.known.__getitem__, units))
            out.append(n)
        return out


@lru_cache(maxsize=2)
def _counter(model: bytes) -> Counter:
    return Counter(model)


def token_counts(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text of ``docs``.

    ``path`` names a SentencePiece model file that the driver can read; its bytes travel with the tasks.
    The counts are those of the model's encoder without added tokens; strings of special tokens in a text
    are ordinary text. Null and empty texts have no bytes and no tokens. Every row is counted by itself:
    rows with a null or repeated id stay, other columns than ``doc_id`` and ``text`` aren't read, and an
    empty table gives an empty result. Nothing is shuffled. A long text is split a million characters at
    a time; only what has no edge of a unit at all (no space, digit, line feed or the like) is merged in one
    piece, for which the encoder needs some hundred bytes a character.
    """
    with open(path, "rb") as f:
        model = f.read()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model)
        for part, at, _ in chunks(batches):
            n = counter.count([text or "" for text in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", "text")
    found = rows.mapInArrow(counted, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
