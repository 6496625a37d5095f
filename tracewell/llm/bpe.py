"""BPE encoding and decoding of whole documents with content-defined chunk reuse."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import map_batches, resident, text_slices
from tracewell.llm.tokens import ByteDecoder, ChunkEncoder, public_path

def coder(path: str) -> tuple[ChunkEncoder, ByteDecoder]:
    """One encoder and decoder per Python worker, which Spark uses for many tasks: their caches last."""
    return resident(("chunks", path), lambda: (ChunkEncoder(path), ByteDecoder(path)))


def bpe_encode(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", decode: bool = True, keep_ids: bool = True, text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids (array<int>), ids_sha256, decoded (text) and decoded_sha256.

    ids and decoded are left out with keep_ids=False. Defined results: a null text is read as an empty one, with no ids;
    null and repeated doc_ids are carried on; other columns are not read.
    """
    source = docs.select("doc_id", F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = coder(public_path(vocabulary))
        decimal = [str(i).encode() for i in range(len(decoder.table))]
        for batch in text_slices(batches, "__text", 2 << 20):
            counts, shas, decoded_shas, all_ids, decoded = [], [], [], [], []
            for ids in encoder.encode_batch(batch.column("__text").to_pylist()):
                listed = ids.tolist()
                counts.append(len(listed))
                shas.append(hashlib.sha256(b",".join(map(decimal.__getitem__, listed))).hexdigest())
                if decode:
                    whole = decoder.decode(listed)
                    decoded_shas.append(hashlib.sha256(whole.encode("utf-8")).hexdigest())
                else:
                    whole = None
                    decoded_shas.append(None)
                if keep_ids:
                    all_ids.append(listed)
                    decoded.append(whole)
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(shas, pa.string()), "decoded_sha256": pa.array(decoded_shas, pa.string())}
            if keep_ids:
                columns |= {"ids": pa.array(all_ids, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return map_batches(source, run, schema)


def bpe_decode(encoded: DataFrame, vocabulary: str = "byte_bpe_50k.json", ids: str = "ids") -> DataFrame:
    """doc_id and the text that the ids decode to; null ids give a null text, none an empty one."""
    source = encoded.select("doc_id", F.col(f"`{ids}`").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = coder(public_path(vocabulary))
        for batch in batches:
            texts = [None if x is None else decoder.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return map_batches(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text string")
