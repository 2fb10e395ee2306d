"""Token ids as flat unsigned integers with 64-bit document offsets.

A token table is a folder of shards in ascending document order. A shard has three files of one name:

* name.ids: the ids of its documents, one after another, little-endian, 2 bytes each if the vocabulary allows, else 4;
* name.off: n + 1 unsigned 64-bit offsets, counted in ids from the shard's start; document i has off[i] to off[i + 1];
* name.doc: n signed 64-bit document ids (NULL_ID stands for null).

A shard is written by one task under a name that no other attempt has. The row of counts that the driver gets of it
names the attempt and is the record that commits it: files of attempts that were lost or came second are never read, so
the three files of a shard always belong together. The number of ids before a shard is the prefix sum of the counts.
Readers map the files into memory and touch only the documents they are asked for.

Shards are ranges of document id, text hash and row, so that rows of one id (or none) are split like any others.
"""

from __future__ import annotations

import uuid
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm.bpe import encoder

NULL_ID = -(2**63)
#: Bytes of text a shard is meant to hold.
SHARD_BYTES = 32 << 20
#: Documents that are encoded and written at a time.
ROWS = 500
COUNTS = "shard int, docs bigint, ids bigint, name string"


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _map(store: fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """The file as an array: mapped if it is local, read if the store is remote. Empty files can't be mapped."""
    if store.get_file_info(path).size == 0:
        return np.zeros(0, kind)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def write(docs: DataFrame, folder: str, path: str, end_id: int, text: str = "text", word_ends: bool = True, width: int = 2, shards: int | None = None) -> list[tuple[int, int, int, str]]:
    """Write the ids of each row's whole text, end_id after them, in ascending doc_id order (nulls first, equal ids by
    the hash of their text). Returns (shard, docs, ids, name) of each shard in order. A null or empty text has end_id
    alone; repeated rows stay; other columns don't matter. An empty table gives empty shards. Long texts are written
    whole."""
    rows = docs.select("doc_id", text)
    if shards is None:
        size = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
        shards = max(1, -(-size // SHARD_BYTES), min(docs.sparkSession.sparkContext.defaultParallelism, -(-size // (1 << 20))))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64(text).asc()]
    ordered = rows.repartitionByRange(shards, *order, F.monotonically_increasing_id().asc()).sortWithinPartitions(*order)
    kind = {2: "<u2", 4: "<u4"}[width]

    def run(batches):
        from pyspark import TaskContext

        shard, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        store, base = _open(folder)
        codec, end = encoder(path, word_ends), np.array([end_id], "<u4").tobytes()
        lengths, doc_ids = [0], []
        with store.open_output_stream(f"{base}/{name}.ids") as out:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    ids = [found + end for found in codec.encode_all(batch.column(1).slice(at, ROWS).to_pylist())]
                    lengths += [len(x) // 4 for x in ids]
                    out.write(np.frombuffer(b"".join(ids), "<u4").astype(kind).tobytes())
                doc_ids += [NULL_ID if d is None else d for d in batch.column(0).to_pylist()]
        offsets = np.cumsum(np.array(lengths, "<u8"), dtype="<u8")
        for ending, values in (("off", offsets), ("doc", np.array(doc_ids, "<i8"))):
            with store.open_output_stream(f"{base}/{name}.{ending}") as out:
                out.write(values.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(doc_ids)]), pa.array([int(offsets[-1])]), pa.array([name])], ["shard", "docs", "ids", "name"])

    store, base = _open(folder)
    store.create_dir(base, recursive=True)
    return sorted((r["shard"], r["docs"], r["ids"], r["name"]) for r in ordered.mapInArrow(run, COUNTS).collect())


def shard_starts(counts: list[tuple[int, int, int, str]]) -> list[tuple[str, int]]:
    """(name, ids before it) of each shard."""
    return list(zip([c[3] for c in counts], accumulate([0, *(c[2] for c in counts)])))


def document(folder: str, shard: str, at: int, width: int = 2) -> np.ndarray:
    """The ids of one document of a shard, given its name."""
    store, base = _open(folder)
    offsets = _map(store, f"{base}/{shard}.off", "<u8")
    return _map(store, f"{base}/{shard}.ids", {2: "<u2", 4: "<u4"}[width])[int(offsets[at]) : int(offsets[at + 1])]


def read(spark: SparkSession, folder: str, counts: list[tuple[int, int, int, str]], width: int = 2, batch: int = 4096) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files: start counts the ids of all documents
    before it, and ids_crc32 is of the ids as unsigned 32-bit integers."""
    kind = {2: "<u2", 4: "<u4"}[width]

    def run(batches):
        store, base = _open(folder)
        for shard, before in ((s, b) for x in batches for s, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist())):
            ids = _map(store, f"{base}/{shard}.ids", kind)
            offsets = _map(store, f"{base}/{shard}.off", "<u8").astype(np.int64)
            doc_ids = _map(store, f"{base}/{shard}.doc", "<i8")
            for at in range(0, len(doc_ids), batch):
                d, o = doc_ids[at : at + batch], offsets[at : at + batch + 1]
                wide = memoryview(ids[o[0] : o[-1]].astype("<u4")).cast("B")
                cuts = ((o - o[0]) * 4).tolist()
                crcs = [crc32(wide[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d, mask=d == NULL_ID), pa.array(o[:-1] + before), pa.array(np.diff(o)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    starts = spark.createDataFrame([(s, b) for (s, b), c in zip(shard_starts(counts), counts) if c[1]], "shard string, before bigint")
    return starts.repartition(max(1, len(counts)), "shard").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
