"""Token-id output: ids in fixed-width bit fields, in files that read back at random.

A file holds the documents of one ``doc_id`` range.  Ids are cut into blocks of
``BLOCK_IDS``; a block stores every id in the fewest bits its vocabulary needs,
in 64-bit words, so a whole block packs and unpacks with a few numpy shifts.

File layout, all integers little-endian::

    blocks          one after another, each of whole 64-bit words
    footer          doc ids int64, null flags uint8, first id of each document
                    int64 (one more than documents), block offsets int64 (one
                    more than blocks)
    trailer         bits, documents, ids, blocks int64; 8 bytes of MAGIC

Defined results: a null or empty text is the end id alone; rows with equal ids
are all written, ordered by a hash of their text; a null ``doc_id`` comes first
and stays null; an empty table writes no file; other columns are not read.
"""

from __future__ import annotations

import io
import os
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from triagelake.llm.ordered_texts import in_order
from triagelake.llm.word_tokens import default_path, encoder
from triagelake.llm.workers import prepare
from triagelake.session import scratch_path

MAGIC = b"TLBITS01"
BLOCK_IDS = 4096
VOCABULARY = 49_408
READ_SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> np.ndarray:
    """Ids in ``bits`` bits each, as 64-bit words; 64 ids fill ``bits`` words exactly."""
    lanes = -(-len(ids) // 64)
    padded = np.zeros(lanes * 64, np.uint64)
    padded[: len(ids)] = ids
    table = padded.reshape(lanes, 64)
    out = np.zeros((lanes, bits), np.uint64)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        out[:, word] |= table[:, k] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= table[:, k] >> np.uint64(64 - shift)
    return out.reshape(-1)


def unpack_bits(words: np.ndarray, bits: int, count: int) -> np.ndarray:
    """The first ``count`` ids of words made by ``pack_bits``."""
    table = words.reshape(-1, bits)
    out = np.empty((len(table), 64), np.uint64)
    mask = np.uint64((1 << bits) - 1)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        value = table[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value |= table[:, word + 1] << np.uint64(64 - shift)
        out[:, k] = value & mask
    return out.reshape(-1)[:count].astype(np.uint32)


class TokenWriter:
    """Writes one file, block by block; holds one block and the document index."""

    def __init__(self, out: BinaryIO, vocabulary: int = VOCABULARY):
        self.out, self.bits, self.limit = out, bits_for(vocabulary), vocabulary
        self.doc_ids: list[int | None] = []
        self.starts, self.offsets = [0], [0]
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >= self.limit:
            raise ValueError(f"token id {int(ids.max())} is outside the vocabulary")
        self.doc_ids.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= 64 * BLOCK_IDS:
            self._flush(self.held // BLOCK_IDS * BLOCK_IDS)

    def _flush(self, count: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        self.waiting, self.held = [ids[count:]], len(ids) - count
        if count:
            words = pack_bits(ids[:count], self.bits).astype("<u8")
            self.out.write(words.tobytes())
            per_block = BLOCK_IDS // 64 * self.bits * 8
            end = self.offsets[-1] + words.nbytes
            self.offsets += [*range(self.offsets[-1] + per_block, end, per_block), end]

    def close(self) -> int:
        """Write what is left and the footer; the number of ids."""
        self._flush(self.held)
        null = np.array([d is None for d in self.doc_ids], np.uint8)
        ids = np.array([d or 0 for d in self.doc_ids], "<i8")
        for part in (ids, null, np.array(self.starts, "<i8"), np.array(self.offsets, "<i8")):
            self.out.write(part.tobytes())
        counts = [self.bits, len(ids), self.starts[-1], len(self.offsets) - 1]
        self.out.write(np.array(counts, "<i8").tobytes() + MAGIC)
        return self.starts[-1]


class TokenReader:
    """Reads a file of ``TokenWriter``: the index at once, ids where they are asked for."""

    def __init__(self, source: BinaryIO):
        self.source = source
        size = source.seek(0, io.SEEK_END)
        source.seek(size - 40)
        trailer = source.read(40)
        if trailer[32:] != MAGIC:
            raise ValueError("not a token file")
        self.bits, docs, self.n_ids, blocks = (int(x) for x in np.frombuffer(trailer[:32], "<i8"))
        footer = 17 * docs + 8 + 8 * (blocks + 1)
        source.seek(size - 40 - footer)
        raw = source.read(footer)
        self.doc_ids = np.frombuffer(raw, "<i8", docs)
        self.null = np.frombuffer(raw, np.uint8, docs, 8 * docs).astype(bool)
        self.starts = np.frombuffer(raw, "<i8", docs + 1, 9 * docs)
        self.offsets = np.frombuffer(raw, "<i8", blocks + 1, 17 * docs + 8)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids ``first`` to ``last - 1`` of the file; reads only the blocks that hold them."""
        if last <= first:
            return np.zeros(0, np.uint32)
        block, end = first // BLOCK_IDS, (last - 1) // BLOCK_IDS + 1
        self.source.seek(int(self.offsets[block]))
        raw = self.source.read(int(self.offsets[end] - self.offsets[block]))
        base = block * BLOCK_IDS
        return unpack_bits(np.frombuffer(raw, "<u8"), self.bits, last - base)[first - base :]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str | None = None
) -> list[tuple[str, int]]:
    """Write all texts as token files into ``folder``; (path, ids) per file, in order.

    ``folder`` is a path or URI that all executors share.  A task writes under a
    name of its own and then moves the file into place, so a repeated task
    leaves one whole file.  The list has one entry per range, not per document.
    """
    path = tokenizer_path or default_path()
    prepare(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press, encode = zstandard.ZstdDecompressor(), encoder(path).encode
        system, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith(
            "file:"
        ) else (fs.LocalFileSystem(), folder)
        system.create_dir(root, recursive=True)
        part, writer, stream, draft = None, None, None, ""
        done: list[tuple[int, str, int]] = []

        def finish() -> None:
            if writer is None:
                return
            count = writer.close()
            stream.close()
            name = f"{root}/part-{part:07d}.bits"
            system.move(draft, name)
            done.append((part, name, count))

        for batch in batches:
            parts, ids, packed = (batch.column(k) for k in (0, 2, 4))
            first = 0
            parts, ids = parts.to_pylist(), ids.to_pylist()
            while first < len(parts):
                texts, size, last = [], 0, first
                while last < len(parts) and size < 1 << 20:
                    raw = packed[last].as_py()
                    texts.append(b"" if raw is None else press.decompress(raw))
                    size += len(texts[-1])
                    last += 1
                for k, ids_of in enumerate(encode(texts), first):
                    if parts[k] != part:
                        finish()
                        part, draft = parts[k], f"{root}/.draft-{uuid.uuid4().hex}"
                        stream = system.open_output_stream(draft)
                        writer = TokenWriter(stream)
                    writer.add(ids[k], np.frombuffer(ids_of, "<u4"))
                first = last
        finish()
        yield pa.record_batch(
            [pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done], pa.string()),
             pa.array([d[2] for d in done], pa.int64())],
            names=["part", "path", "ids"],
        )

    rows = in_order(docs).mapInArrow(write, "part int, path string, ids bigint").collect()
    scheme = folder.split("://")[0] + "://" if "://" in folder else ""
    rows = sorted(rows, key=lambda r: r["part"])
    return [(scheme + r["path"] if scheme else r["path"], r["ids"]) for r in rows]


def read_token_files(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    """Per document of the files: id, start among all ids, count and CRC-32 of its ids."""
    prepare(spark)
    base, entries = 0, []
    for path, count in files:
        entries.append((path, base))
        base += count
    listed = spark.createDataFrame(entries, "path string, base bigint")
    listed = listed.repartition(max(1, len(entries)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, name = (
                    fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                )
                with system.open_input_file(name) as source:
                    yield _digest(TokenReader(source), base)

    return listed.mapInArrow(read, READ_SCHEMA)


def _digest(reader: TokenReader, base: int) -> pa.RecordBatch:
    crc, step = [], 256
    for k in range(0, len(reader.doc_ids), step):
        starts = reader.starts[k : k + step + 1]
        raw = reader.ids(int(starts[0]), int(starts[-1])).astype("<u4").tobytes()
        edges = 4 * (starts - starts[0])
        crc += [
            zlib.crc32(raw[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)
        ]
    return pa.record_batch(
        [
            pa.array(reader.doc_ids, pa.int64(), mask=reader.null),
            pa.array(reader.starts[:-1] + base, pa.int64()),
            pa.array(np.diff(reader.starts), pa.int64()),
            pa.array(crc, pa.int64()),
        ],
        names=["doc_id", "start", "n_tokens", "ids_crc32"],
    )


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files in the shared folder and read back."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    return read_token_files(spark, write_token_files(docs, scratch_path(spark, "token-files")))
