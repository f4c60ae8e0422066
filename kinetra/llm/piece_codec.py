"""SentencePiece encoding and decoding of whole texts by distinct-chunk tables (see ``chunks``).

Null text counts as empty and gives begin and end ids only; repeated rows give repeated rows; other columns
than the kept ones are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.llm.chunks import piece_codec
from kinetra.llm.common import require, text_slices


def encode_decode(docs: DataFrame, model_path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns with ``ids`` (begin, pieces, end as little-endian uint32) and ``decoded`` text."""
    require(docs, text_col, *keep)
    slim = docs.select(*keep, F.col(text_col).alias("__text"))
    types = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    ddl = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "ids binary, decoded string"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = piece_codec(model_path)
        for part, texts in text_slices(batches, "__text"):
            ids, decoded = zip(*codec.encode_decode(texts)) if texts else ((), ())
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=[*keep, "ids", "decoded"])

    return slim.mapInArrow(run, ddl)
