"""Token-id files in patched frame-of-reference blocks.

A file: magic; blocks of 256 ids; footer; footer's length (u64); magic. A block: minimum (u32), width (u8), number of
exceptions (u16), the low `width` bits of id - minimum, then the exceptions' places (u8 each) and high bits (u32 each). The
width is what 90 % of the block's ids need. The footer: number of ids, of blocks and of documents (u64 each), the block
starts (u64), the documents' ids (i64), whether each has one (u8), and their lengths (u64). All little-endian.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, load, partitions, portions
from siltstone.llm.tokens import encode_ended, encoder, word_bpe_path

MAGIC, BLOCK, SHARE = b"SILTPFR1", 256, 0.9
#: Ids of a file, about: some 100 MB.
FILE_IDS = 1 << 26
HEAD = np.dtype([("least", "<u4"), ("width", "u1"), ("patches", "<u2")])


def pack_blocks(ids: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(the blocks, how many bytes each has) of ids, whose number is a multiple of BLOCK."""
    m = ids.reshape(-1, BLOCK).astype(np.uint32)
    least = m.min(axis=1)
    over = m - least[:, None]
    bits = np.frexp(over.astype(np.float64))[1].astype(np.uint8)
    k = int(np.ceil(SHARE * BLOCK)) - 1
    width = np.partition(bits, k, axis=1)[:, k]
    patch = bits > width[:, None]
    head = np.zeros(len(m), HEAD)
    head["least"], head["width"], head["patches"] = least, width, patch.sum(axis=1)
    row, place = np.nonzero(patch)
    high = (over[row, place] >> width[row]).astype("<u4")
    place, cut = place.astype(np.uint8), np.concatenate([[0], np.cumsum(head["patches"], dtype=np.int64)])
    body: list[bytes] = [b""] * len(m)
    for w in np.unique(width):
        mine = np.flatnonzero(width == w)
        low = np.packbits(((over[mine][:, :, None] >> np.arange(w, dtype=np.uint32)) & 1).astype(np.uint8).reshape(len(mine), -1), axis=1, bitorder="little")
        for j, i in enumerate(mine.tolist()):
            body[i] = low[j].tobytes()
    blocks = [head[i].tobytes() + body[i] + place[cut[i] : cut[i + 1]].tobytes() + high[cut[i] : cut[i + 1]].tobytes() for i in range(len(m))]
    return blocks, np.fromiter(map(len, blocks), np.int64, len(blocks))


def unpack_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of blocks that begin at starts in data."""
    raw = np.frombuffer(data, np.uint8)
    head = raw[starts[:, None] + np.arange(HEAD.itemsize)].reshape(-1).view(HEAD)
    out = np.empty((len(starts), BLOCK), np.uint32)
    width, begin = head["width"].astype(np.int64), starts + HEAD.itemsize
    for w in np.unique(width):
        mine = np.flatnonzero(width == w)
        bits = np.unpackbits(raw[begin[mine][:, None] + np.arange(w * BLOCK // 8)], axis=1, bitorder="little").reshape(len(mine), BLOCK, int(w))
        out[mine] = sum((bits[:, :, b].astype(np.uint32) << np.uint32(b) for b in range(w)), np.zeros((len(mine), BLOCK), np.uint32))
    n = head["patches"].astype(np.int64)
    row, first = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    j = np.arange(len(row)) - first[row]
    at = begin + width * BLOCK // 8
    high = raw[(at + n)[row][:, None] + 4 * j[:, None] + np.arange(4)].reshape(-1).view("<u4")
    out[row, raw[at[row] + j]] |= high << width[row].astype(np.uint32)
    return (out + head["least"][:, None]).ravel()


class Writer:
    """Streams documents into one file; only ids of an unfinished group of blocks are held."""

    GROUP = 1024 * BLOCK

    def __init__(self, out):
        self.out, self.held, self.n, self.at = out, [], 0, len(MAGIC)
        self.starts, self.docs, self.ids = [], [], 0
        out.write(MAGIC)

    def add(self, ids: np.ndarray, doc_ids: list, lengths: np.ndarray) -> None:
        self.docs.append((np.array([x or 0 for x in doc_ids], "<i8"), np.array([x is not None for x in doc_ids], "u1"), lengths.astype("<u8")))
        self.held.append(ids)
        self.n += len(ids)
        self.ids += len(ids)
        if self.n >= self.GROUP:
            whole = np.concatenate(self.held)
            keep = len(whole) // BLOCK * BLOCK
            for k in range(0, keep, self.GROUP):
                self._flush(whole[k : min(k + self.GROUP, keep)])
            self.held, self.n = [whole[keep:]], len(whole) - keep

    def _flush(self, ids: np.ndarray) -> None:
        blocks, size = pack_blocks(ids)
        self.starts.append(self.at + np.cumsum(size) - size)
        self.at += int(size.sum())
        self.out.write(b"".join(blocks))

    def close(self) -> None:
        rest = np.concatenate([*self.held, np.zeros(0, np.uint32)]).astype(np.uint32)
        if len(rest):
            self._flush(np.pad(rest, (0, -len(rest) % BLOCK), mode="edge"))
        starts = np.concatenate([*self.starts, np.zeros(0)]).astype("<u8")
        parts = [np.concatenate([*(d[i] for d in self.docs), np.zeros(0, t)]).astype(t) for i, t in enumerate(("<i8", "u1", "<u8"))]
        foot = np.array([self.ids, len(starts), len(parts[0])], "<u8").tobytes() + starts.tobytes() + b"".join(p.tobytes() for p in parts)
        self.out.write(foot + np.array([len(foot)], "<u8").tobytes() + MAGIC)


class Reader:
    """doc_ids, lengths, and ids of any place by the index of block starts."""

    def __init__(self, file):
        self.file, size = file, file.size()
        file.seek(size - 16)
        tail = file.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a file of token ids")
        n = int(np.frombuffer(tail[:8], "<u8")[0])
        file.seek(size - 16 - n)
        foot = file.read(n)
        self.n_ids, blocks, docs = (int(x) for x in np.frombuffer(foot[:24], "<u8"))
        cut = np.cumsum([24, 8 * blocks, 8 * docs, docs, 8 * docs])
        self.starts = np.append(np.frombuffer(foot[cut[0] : cut[1]], "<u8").astype(np.int64), size - 16 - n)
        has = np.frombuffer(foot[cut[2] : cut[3]], "u1")
        self.doc_ids = pa.array(np.frombuffer(foot[cut[1] : cut[2]], "<i8"), mask=has == 0)
        self.lengths = np.frombuffer(foot[cut[3] : cut[4]], "<u8").astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = start // BLOCK, -(-stop // BLOCK)
        self.file.seek(int(self.starts[a]))
        data = self.file.read(int(self.starts[b] - self.starts[a]))
        return unpack_blocks(data, self.starts[a:b] - self.starts[a])[start - a * BLOCK : stop - a * BLOCK]


def write_token_files(df: DataFrame, scratch: Scratch, *, id_col: str, text_col: str, end_id: int, tokenizer: str, file_ids: int = FILE_IDS) -> DataFrame:
    """(part, no, path, n_docs, n_ids) of the files written to the shared folder, in ascending order of id, nulls first.

    One shuffle, by ranges of ids; a task encodes its range and writes it to files of about file_ids ids, each ended by the first
    document that passes them; so what a writer or reader holds is bounded. A task that is run again writes files of
    other names, only those that its successful attempt reports are read, and the others are removed at the end.
    """
    folder = f"{scratch.path}/files"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, store, path = TaskContext.get().partitionId(), *fs.FileSystem.from_uri(folder)
        store.create_dir(path)
        rows, no, docs, out, writer, name = (x for b in batches for x in portions(b)), 0, 0, None, None, None

        def done() -> pa.RecordBatch:
            writer.close()
            out.close()
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "no": pa.array([no], pa.int32()), "path": [name], "n_docs": pa.array([docs], pa.int64()), "n_ids": pa.array([writer.ids], pa.int64())})

        for b in rows:
            ids, n = encode_ended(tokenizer, b.column(1), end_id)
            ends, at = np.cumsum(n), 0
            while at < len(n):
                if writer is None:
                    name, docs = f"{path}/{part:06d}-{no:04d}-{uuid.uuid4().hex[:8]}.pfor", 0
                    out = store.open_output_stream(name)
                    writer = Writer(out)
                before = int(ends[at] - n[at])
                upto = min(len(n), int(np.searchsorted(ends, before + max(1, file_ids - writer.ids), "left")) + 1)
                writer.add(ids[before : ends[upto - 1]], b.column(0).slice(at, upto - at).to_pylist(), n[at:upto])
                docs, at = docs + upto - at, upto
                if writer.ids >= file_ids:
                    yield done()
                    writer, no = None, no + 1
        if writer is not None:
            yield done()
        encoder(tokenizer).forget()

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spread = rows.repartitionByRange(partitions(df.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = scratch.keep(spread.mapInArrow(write, "part int, no int, path string, n_docs long, n_ids long"), "manifest")
    named = {os.path.basename(r.path) for r in manifest.select("path").toLocalIterator()}
    scratch.drop(*(f"files/{x}" for x in scratch.names("files") if x not in named))
    return manifest


def read_token_files(manifest: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files, read back by index of block starts."""
    folder = f"{scratch.path}/files"
    files = manifest.orderBy("part", "no").collect()  # one row per file
    base, rows = 0, []
    for f in files:
        rows.append((f.path, base))
        base += f.n_ids
    step = 4096 * BLOCK

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_file(name) as file:
                    r = Reader(file)
                    ends = np.cumsum(r.lengths)
                    at = 0
                    while at < len(ends):
                        begin = int(ends[at] - r.lengths[at])
                        upto = max(at + 1, int(np.searchsorted(ends, begin + step, "right")))
                        ids = r.ids(begin, int(ends[upto - 1])).astype("<u4")
                        cut = (ends[at:upto] - begin).tolist()
                        crc = [zlib.crc32(ids[a:c]) for a, c in zip([0, *cut[:-1]], cut, strict=True)]
                        yield pa.RecordBatch.from_arrays([r.doc_ids.slice(at, upto - at), pa.array(first + ends[at:upto] - r.lengths[at:upto]), pa.array(r.lengths[at:upto]), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        at = upto

    spark = manifest.sparkSession
    paths = spark.createDataFrame(rows, "path string, first long")
    return paths.repartition(max(1, len(rows))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, tokenizer: str | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of whole texts, end_id behind each, to files in ascending order of id, and returns what the files hold.

    Null or empty texts have the end id only. Rows of equal id stand in order of their text; rows of null id come first.
    An empty table gives no file and no row. Extra columns are ignored. Ids of documents are integers.
    """
    scratch = Scratch(df.sparkSession, "tokens")
    manifest = write_token_files(df, scratch, id_col=id_col, text_col=text_col, end_id=end_id, tokenizer=tokenizer or word_bpe_path(), file_ids=file_ids)
    return read_token_files(manifest, scratch)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(load(spark, sf_dir, "documents"))
