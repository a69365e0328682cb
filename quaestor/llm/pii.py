"""Personal information inside free text: finds and typed placeholders.

Method: a character BiLSTM with CRF transitions (`lstm_crf`), trained in numpy
from labelled spans (`pii_train`), runs over overlapping windows whose labels are
reconciled over the whole text (`pii_model`).  The windows cover every character.

Defined results: a null text gives no finds and stays null; an empty text stays
empty; rows are independent, so ties and repeated rows give equal results; an
empty table gives an empty table; further columns pass through unless they carry
the name of an output column, which then replaces them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaestor.operators.skew import spread

_FOUND = T.StructType([
    T.StructField("masked", T.StringType()),
    T.StructField("finds", T.ArrayType(T.StructType([
        T.StructField("kind", T.StringType()),
        T.StructField("pii_value", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
    ]))),
])
#: Characters handed to the tagger at once: bounds a worker's memory whatever the batch holds.
CHUNK_CHARS = 400_000


def _spans(texts: list) -> list[list[tuple[int, int, int]]]:
    """Finds of each text as (start, end, kind)."""
    from quaestor.llm.pii_model import find, tagger

    model = tagger()
    out: list = [[] for _ in texts]
    chunk: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        if text is not None:
            chunk.append(i)
            size += len(text)
        if chunk and (size >= CHUNK_CHARS or i == len(texts) - 1):
            for k, spans in zip(chunk, find([texts[k] for k in chunk], model)):
                out[k] = spans
            chunk, size = [], 0
    return out


def _scan(texts: list, with_text: bool) -> list:
    from quaestor.llm.pii_model import KINDS, value

    out: list = []
    for text, found in zip(texts, _spans(texts)):
        masked = None
        if with_text and text is not None:
            parts, at = [], 0
            for a, b, kind in found:
                parts += [text[at:a], f"[{KINDS[kind].upper()}]"]
                at = b
            masked = "".join(parts) + text[at:]
        out.append({"masked": masked, "finds": [{"kind": KINDS[k], "pii_value": value(text[a:b], k), "start": a, "end": b} for a, b, k in found]})
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to a row for each different find of a text."""
    from quaestor.llm.pii_model import KINDS, value

    for batch in batches:
        texts = batch.column(1).to_pylist()
        found = [(i, *x) for i, spans in enumerate(_spans(texts)) for x in dict.fromkeys((k, value(texts[i][a:b], k)) for a, b, k in spans)]
        at = pa.array([i for i, _, _ in found], pa.int64())
        kinds = pa.array([KINDS[k] for _, k, _ in found], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), kinds, pa.array([x for _, _, x in found], pa.string())], ["key", "kind", "pii_value"])


def _scanner(with_text: bool):
    @F.pandas_udf(_FOUND)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(_scan([None if x is None or x is pd.NA else x for x in batch], with_text), columns=["masked", "finds"])

    return scan


def find_pii(docs: DataFrame, text: str = "text", masked: bool = True) -> DataFrame:
    """Adds `masked` (the text with placeholders such as [EMAIL]) and `finds`."""
    rest = [c for c in docs.columns if c not in ("masked", "finds")]
    return spread(docs.select(*rest)).select(*rest, _scanner(masked)(F.col(text)).alias("_pii")).select(*rest, "_pii.masked", "_pii.finds")


def pii_finds(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct (key, kind, pii_value)."""
    # Only finds leave Python and are shuffled, each once a document.
    own = spread(docs.select(key, text).where(F.length(text) > 0))
    out = T.StructType([T.StructField("key", own.schema[0].dataType), T.StructField("kind", T.StringType()), T.StructField("pii_value", T.StringType())])
    return own.mapInArrow(_rows, out).withColumnRenamed("key", key).distinct()
