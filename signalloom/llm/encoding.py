"""Problem 6: the whole corpus as ids of a public byte-level BPE vocabulary, and back."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import TOKENIZER_DIR, per_batch, slices
from .bpe import Encoder

VOCABULARY = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
BATCH_BYTES = 4 << 20


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) for each row; ids is empty for a null or empty text and never null.

    Rows are independent, so there is no shuffle: scan, merge, write.  White space is encoded like any other
    text, spellings of special tokens are ordinary text, repeated rows and null ids stay as they are, an
    empty table gives an empty result, and other columns are neither read nor passed on."""

    def make():
        encoder = Encoder(vocabulary)

        def handle(batch: pa.RecordBatch):
            for part in slices(batch, "text", BATCH_BYTES):
                ids, ends = array("i"), [0]
                for text in part.column("text").to_pylist():
                    if text:
                        ids.extend(encoder.ids(text))
                    ends.append(len(ids))
                encoder.trim()
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32) if ids else [], pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists], ["doc_id", "ids"])

        return handle

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return per_batch(narrow, make, "doc_id long, ids array<int>")


def decode_corpus(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) by joining the spellings of the ids; null ids give null, an empty list an empty text."""

    def make():
        spellings = Encoder(vocabulary).spellings

        def handle(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [None if x is None else b"".join(map(spellings.__getitem__, x)).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

        return handle

    return per_batch(encoded.select("doc_id", "ids"), make, "doc_id long, text string")
