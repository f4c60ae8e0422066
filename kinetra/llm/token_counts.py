"""Token counts of whole texts; huge ones are counted by overlapping chunks and resynchronisation.

A text of more than ``chunk`` characters is encoded in chunks that overlap.  Two neighbours are spliced at a
place that is a token boundary in both and *proven* stable: a space behind a character that is no space (and
before an ordinary letter or digit, for byte-level files), where the tokenizer's own rules never join the two
sides.  If an overlap has no such place, it is widened, at last to the whole rest of the text.

Null text counts as empty and has no tokens; repeated rows give repeated rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.llm.common import require, text_slices


class PieceCounter:
    """Counts and token starts by ``sentencepiece``."""

    _STABLE = re.compile(r"(?<=[^ ▁]) ")

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.sp.id_to_piece, range(self.sp.get_piece_size()))
        self.splits = not any("▁" in p.lstrip("▁") for p in pieces) and self.sp.normalize("ﬁ  a") == "▁ﬁ▁▁a"

    def counts(self, texts: list[str]) -> list[int]:
        return [len(i) for i in self.sp.encode(texts, num_threads=1)] if texts else []

    def starts(self, text: str) -> list[int]:
        """Character offset of each token; several pieces of one character share it."""
        begins = np.array([p.begin for p in self.sp.encode(text, return_type="proto").pieces], dtype=np.int64)
        if text.isascii():
            return begins.tolist()
        heads = (np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80  # the library counts bytes
        return np.concatenate(([0], np.cumsum(heads)))[begins].tolist()

    def stable(self, text: str, lo: int, hi: int) -> Iterator[int]:
        return (m.start() for m in self._STABLE.finditer(text, lo, hi))


class FileCounter:
    """Counts and token starts by a ``tokenizers`` file."""

    _STABLE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.splits = True

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def starts(self, text: str) -> list[int]:
        return [a for a, _ in self.lib.encode(text, add_special_tokens=False).offsets]

    def stable(self, text: str, lo: int, hi: int) -> Iterator[int]:
        return (m.start() for m in self._STABLE.finditer(text, lo, hi))


@lru_cache(maxsize=4)
def counter(path: str) -> PieceCounter | FileCounter:
    return PieceCounter(path) if path.endswith(".model") else FileCounter(path)


def _boundary(starts: list[int], shift: int) -> set[int]:
    return {s + shift for s in starts}


def count_long(text: str, by, chunk: int, overlap: int) -> int:
    """Tokens of one text, from chunks of ``chunk`` characters that overlap by ``overlap`` at least."""
    if len(text) <= chunk or not by.splits:
        return by.counts([text])[0]
    total, at = 0, 0  # everything before ``at``, a proven boundary, is counted
    while True:
        end = min(len(text), at + chunk)
        left = by.starts(text[at:end])
        if end == len(text):
            return total + len(left)
        wide, splice = overlap, None
        while splice is None and wide < end - at:
            lo = end - wide
            right = _boundary(by.starts(text[lo : min(len(text), end + overlap)]), lo)
            own = _boundary(left, at)
            middle = end - wide // 2
            common = [p for p in by.stable(text, lo + 1, end - 1) if p in own and p in right]
            splice = min(common, key=lambda p: abs(p - middle), default=None)
            wide *= 4
        if splice is None:  # no proven place in all of the chunk: take more text at once
            chunk *= 4
            if at + chunk >= len(text):
                return total + by.counts([text[at:]])[0]
            continue
        total += sum(1 for s in left if s + at < splice)
        at = splice + (1 if isinstance(by, PieceCounter) else 0)  # the library writes this space itself


def token_counts(docs: DataFrame, path: str, keep: list[str], text_col: str = "text", out: str = "n_tokens", *, chunk: int = 16384, overlap: int = 512) -> DataFrame:
    """``keep`` columns with the number of tokens, without begin, end or added special tokens."""
    require(docs, text_col, *keep)
    slim = docs.select(*keep, F.col(text_col).alias("__text"))
    types = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    ddl = ", ".join([*(f"`{c}` {types[c]}" for c in keep), f"`{out}` long"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = counter(path)
        for part, texts in text_slices(batches, "__text"):
            found = [0] * len(texts)
            short = [i for i, x in enumerate(texts) if x and len(x) <= chunk]
            for i, n in zip(short, by.counts([texts[i] for i in short])):
                found[i] = n
            for i, x in enumerate(texts):
                if x and len(x) > chunk:
                    found[i] = count_long(x, by, chunk, overlap)
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), pa.array(found, pa.int64())], names=[*keep, out])

    return slim.mapInArrow(run, ddl)
