"""Token ids in bit-plane files.

File (little-endian)::

    magic "QWBP1\\0" | u8 plane kind (0 bit, 1 byte) | u8 bytes per id | u32 ids per block
    chunks: the blocks' planes, one zstandard frame each
    documents: i64 doc_id, u8 null flag, u64 first id, u32 ids - columns one after another, zstandard
    index: for each block u32 ids, then for each plane u64 offset, u32 length - zstandard
    tail: u64 ids, u64 documents, u64 place of documents, u64 place of index, magic

A block holds ``block`` ids (the last fewer).  Its planes are what one gets by writing the ids as rows of
bits (bytes) and reading columns: equal high bits make long runs, which zstandard all but removes.  The
index gives any block's place, so a reader can fetch a range of ids without the rest.

Writing: texts are encoded where they lie; (doc_id, ids) goes by range of doc_id to as many files as there
are shuffle partitions; each file is written under a name of its own attempt and renamed when it is whole,
so a task that is run again, or twice at once, leaves one whole file.  Only the files' sizes come back.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, common

MAGIC = b"QWBP1\0"
TAIL = struct.Struct("<QQQQ6s")


def to_planes(ids: np.ndarray, width: int, kind: str) -> list[bytes]:
    """Planes of one block; ``width`` bytes per id."""
    raw = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :width]
    if kind == "byte":
        return [np.ascontiguousarray(raw[:, i]).tobytes() for i in range(width)]
    return [np.packbits((raw[:, i] >> b) & 1).tobytes() for i in range(width) for b in range(8)]


def from_planes(planes: list[bytes], n: int, width: int, kind: str) -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    if kind == "byte":
        for i in range(width):
            raw[:, i] = np.frombuffer(planes[i], np.uint8)
    else:
        for k, p in enumerate(planes):
            raw[:, k // 8] |= np.unpackbits(np.frombuffer(p, np.uint8), count=n) << (k % 8)
    return raw.view("<u4").reshape(-1)


class Writer:
    """Streams documents into one file; holds one block of ids and the documents' numbers."""

    def __init__(self, out, width: int, block: int = 1 << 16, kind: str = "byte", level: int = 3):
        import zstandard

        self.out, self.width, self.block, self.kind = out, width, block, kind
        self.z = zstandard.ZstdCompressor(level=level)
        self.pending: list[np.ndarray] = []
        self.waiting, self.ids, self.at = 0, 0, 0
        self.index: list[tuple] = []
        self.docs: list[tuple] = []
        self._put(MAGIC + struct.pack("<BBI", kind == "byte", width, block))

    def _put(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        place, self.at = self.at, self.at + len(data)
        return place, len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, self.ids, len(ids)))
        self.ids += len(ids)
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            self._blocks(False)

    def _blocks(self, last: bool) -> None:
        rest = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        whole = len(rest) if last else len(rest) - len(rest) % self.block
        for a in range(0, whole, self.block):
            b = rest[a : min(a + self.block, whole)]
            self.index.append((len(b), [self._put(self.z.compress(p)) for p in to_planes(b, self.width, self.kind)]))
        self.pending, self.waiting = ([rest[whole:]], len(rest) - whole) if whole < len(rest) else ([], 0)

    def close(self) -> None:
        self._blocks(True)
        cols = list(zip(*self.docs, strict=True)) or [(), (), (), ()]
        docs = b"".join(np.array(c, t).tobytes() for c, t in zip(cols, ("<i8", "u1", "<u8", "<u4"), strict=True))
        d, _ = self._put(self.z.compress(docs))
        i, _ = self._put(self.z.compress(b"".join(struct.pack("<I", n) + b"".join(struct.pack("<QI", *p) for p in ps) for n, ps in self.index)))
        self._put(TAIL.pack(self.ids, len(self.docs), d, i, MAGIC))


class Reader:
    """Random access to one file through ``source`` (seek and read)."""

    def __init__(self, source, size: int):
        import zstandard

        self.source, self.z = source, zstandard.ZstdDecompressor()
        if self._get(0, 6) != MAGIC:
            raise ValueError("no bit-plane file")
        kind, self.width, self.block = struct.unpack("<BBI", self._get(6, 6))
        self.kind = "byte" if kind else "bit"
        self.n_ids, self.n_docs, d, i, magic = TAIL.unpack(self._get(size - TAIL.size, TAIL.size))
        if magic != MAGIC:
            raise ValueError("the file is not whole")
        raw, n = self.z.decompress(self._get(d, i - d)), self.n_docs
        self.doc_ids, self.nulls = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "u1", n, 8 * n)
        self.starts, self.sizes = np.frombuffer(raw, "<u8", n, 9 * n), np.frombuffer(raw, "<u4", n, 17 * n)
        raw, planes = self.z.decompress(self._get(i, size - TAIL.size - i)), self.width * (1 if kind else 8)
        step = 4 + 12 * planes
        self.index = [(struct.unpack_from("<I", raw, a)[0], [struct.unpack_from("<QI", raw, a + 4 + 12 * k) for k in range(planes)]) for a in range(0, len(raw), step)]

    def _get(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def read_block(self, k: int) -> np.ndarray:
        n, places = self.index[k]
        return from_planes([self.z.decompress(self._get(*p)) for p in places], n, self.width, self.kind)

    def read(self, start: int, n: int) -> np.ndarray:
        """Ids start to start + n, from the blocks that hold them."""
        if not n:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (start + n - 1) // self.block
        got = np.concatenate([self.read_block(k) for k in range(first, last + 1)])
        return got[start - first * self.block : start - first * self.block + n]

    def documents(self):
        """(doc_id or None, first id, ids) of each document in order, one block in memory at a time."""
        have, base, k = np.zeros(0, "<u4"), 0, 0
        for d, null, s, n in zip(self.doc_ids.tolist(), self.nulls.tolist(), self.starts.tolist(), self.sizes.tolist(), strict=True):
            parts = [have[s - base :]]
            got = len(parts[0])
            while got < n:
                parts.append(self.read_block(k))
                got += len(parts[-1])
                k += 1
            have, base = np.concatenate(parts) if len(parts) > 1 else parts[0], s
            yield None if null else d, s, have[:n]


def encoded(docs: DataFrame, tokenizer: str, end_id: int | None) -> DataFrame:
    """(doc_id, ids binary) of every whole text; null texts have the end id alone.  ids: u16, or u32 for large vocabularies."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        enc = bytebpe.encoder(tokenizer)
        end = b"" if end_id is None else enc.raw([end_id])
        for b in batches:
            rows = [x + end for x in enc.encode_all(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are below ``value`` (null: 0), by binary search."""
    if not bounds:
        return F.lit(0)
    array = F.lit(bounds).cast("array<bigint>")
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def halve(at: Column, _: Column) -> Column:
        mid = F.shiftright(at["lo"] + at["hi"], 1)
        below = (at["lo"] < at["hi"]) & F.coalesce(F.get(array, mid) < value, F.lit(False))
        return F.struct(F.when(below, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(below | (at["lo"] >= at["hi"]), at["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), start, halve, lambda at: at["lo"])


def range_bounds(docs: DataFrame, parts: int, fine: int = 8, most: int = 20_000) -> list[int]:
    """At most ``parts`` - 1 bounds of doc_id that part the summed text bytes, not the rows, evenly.

    From doc_id and the texts' lengths alone: repartitionByRange would encode every text a second time for its
    sample.  First ``fine`` ranges a part of near equal rows (the parts themselves if there would be more than
    ``most``), then each range's bytes, then neighbours joined.  The driver sees one number a range.
    """
    n = max(parts, min(fine * parts, most))
    found = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 20 * n)).first()[0] or []
    cuts = sorted(set(found))
    weights = docs.groupBy(range_of(F.col("doc_id"), cuts).alias("r")).agg(F.sum(common.text_bytes() + 1).alias("b")).collect()
    by = {r.r: r.b for r in weights}
    goal, total, out = sum(by.values()) / parts, 0, []
    for i, c in enumerate(cuts):
        total += by.get(i, 0)
        if total >= goal * (len(out) + 1) and len(out) < parts - 1:
            out.append(c)
    return out


def write_ids(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int | None = 0, block: int = 1 << 16, kind: str = "byte", level: int = 3) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write bit-plane files in ascending doc_id (null first) to ``path``.

    Returns the files' manifest (file, first id over all files, ids, documents, bytes), which is stored as
    ``path/manifest``.  Rows with equal doc_id stay beside each other, in order of their ids' bytes.
    An empty table writes no file.  Files hold what one shuffle partition gets, so give large inputs
    enough shuffle partitions.
    """
    spark = docs.sparkSession
    src = encoded(docs, tokenizer, end_id)
    width, kind_of_id = (lambda e: (e.width, e.kind))(bytebpe.encoder(tokenizer))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = range_bounds(docs, parts)
    ordered = src.repartitionById(parts, range_of(F.col("doc_id"), bounds)).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root)
        name = f"ids-{TaskContext.get().partitionId():06d}.qwbp"
        tmp = f"{root}/.{name}.{uuid.uuid4().hex}"
        writer = None
        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if writer is None:
                    out = store.open_output_stream(tmp)
                    writer, first = Writer(out, width, block, kind, level), d
                writer.add(d, np.frombuffer(x.as_buffer(), kind_of_id))
                last = d
        if writer is not None:
            writer.close()
            out.close()
            store.move(tmp, f"{root}/{name}")
            yield pa.RecordBatch.from_pylist([{"file": name, "part": int(name[4:10]), "ids": writer.ids, "documents": len(writer.docs), "bytes": writer.at, "first_doc": first, "last_doc": last}], schema=pa.schema([("file", pa.string()), ("part", pa.int32()), ("ids", pa.int64()), ("documents", pa.int64()), ("bytes", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64())]))

    ordered.mapInArrow(run, "file string, part int, ids long, documents long, bytes long, first_doc long, last_doc long").write.mode("overwrite").parquet(f"{path}/manifest")
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Files of ``path`` with the number of ids before each.  There is one row a file, so one window over all is small."""
    from pyspark.sql import Window

    m = spark.read.parquet(f"{path}/manifest")
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return m.withColumn("start", F.coalesce(before, F.lit(0)).cast("long"))


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Rows (doc_id, start, n_tokens, and ids array<long> or, with ``digest``, ids_crc32) read from the files alone."""
    files = manifest(spark, path).select("file", "bytes", "start")
    # one file a task: tasks take few files each, whatever their number
    dealt = files.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file")
    kind = ("ids_crc32", pa.int64()) if digest else ("ids", pa.list_(pa.int64()))

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        for b in batches:
            for row in b.to_pylist():
                with store.open_input_file(f"{root}/{row['file']}") as f:
                    rows: list[tuple] = []
                    for d, s, ids in Reader(f, row["bytes"]).documents():
                        rows.append((d, row["start"] + s, len(ids), zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.tolist()))
                        if len(rows) >= (4096 if digest else 256):
                            yield _batch(rows, kind)
                            rows = []
                    if rows:
                        yield _batch(rows, kind)

    return dealt.mapInArrow(run, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids array<long>'}")


def _batch(rows: list[tuple], kind: tuple) -> pa.RecordBatch:
    d, s, n, x = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(x, kind[1])], names=["doc_id", "start", "n_tokens", kind[0]])


def file_bytes(ids: np.ndarray, kind: str) -> int:
    """Size of a file with one document (for comparing plane kinds)."""
    out = io.BytesIO()
    w = Writer(out, 2 if ids.max(initial=0) < 1 << 16 else 4, kind=kind)
    w.add(0, ids)
    w.close()
    return w.at


def op10_bitplane(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.fresh_path(spark, "op10")
    write_ids(common.documents(spark, sf_dir), path)
    return read_ids(spark, path, digest=True)
