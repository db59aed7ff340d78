"""Sorted-string-table shards of token ids (operator 10).

A table is a set of shard files in ascending key order plus a manifest. One file:

    block*   each zstd-compressed: entries with prefix-compressed keys
    index    per block: its last key, place, sizes and number of entries
    bloom    bits over the keys
    footer   fixed size: places of index and bloom, counts, checksum, magic

A key is nine bytes (a null flag, then the identifier with its sign bit flipped, big-endian),
so that keys sort as identifiers do, null first. An entry is
``varint shared, varint unshared, varint n_ids, varint bytes, key suffix, ids``; ids are
little-endian, two bytes wide if the vocabulary allows it and else four.

A lookup reads the manifest, the footer, the Bloom filter and the index of one
shard, searches the index by bisection and unpacks one block.

Texts are encoded where they are read; only ids move. Shards hold ranges of (identifier, hash of the text, salt), about
equally many rows each. One pass over the texts writes these columns and the texts' sizes; the bounds of the ranges and their number come from
that. The salt is a hash of the row's number, so that rows which agree in identifier and text, however many, spread evenly
over shards, whichever way they are numbered when they are encoded. A table that is read in few parts is encoded by as many tasks: set
``spark.sql.files.maxPartitionBytes`` for more.

Writing survives lost executors: each task attempt writes a file with a name of its own,
and only the files that the written manifest names belong to the table.
Files are reached through ``pyarrow.fs``, so the folder may be any shared store that it knows.

Defined results: a null text is an empty text; repeated identifiers keep all their rows, next to each other, in the order of
a 64-bit hash of their texts, so that places don't depend on how rows come in; an empty table gives an empty manifest.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from formloom.llm.tokens import piece_encoder, portions, text_of
from formloom.session import load, scratch, shared_dir, written

MAGIC = b"IDSST001"
#: index place and size, bloom place and size, entries, ids, id width, checksum of index and bloom, magic
FOOTER = struct.Struct("<QQQQQQHI8s")
BLOCK_BYTES = 64 << 10
BITS_PER_KEY, HASHES = 10, 7
KEY_BYTES = 9
#: Bytes of text for a shard. Smaller tables have as many shards as there are partitions, but none for less than the least.
SHARD_BYTES, SHARD_LEAST = 128 << 20, 2 << 20
#: Pieces of text whose ids a writer keeps: encoding is nearly all of its work.
PIECES = 600_000

MANIFEST = "shard int, path string, first_key binary, last_key binary, n_docs long, n_ids long"


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & ((1 << 64) - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(HASHES)]


class ShardWriter:
    """Writes one shard; keys must come in ascending order."""

    def __init__(self, stream, width: int):
        import zstandard

        self.stream, self.width, self.at = stream, width, 0
        self.zstd = zstandard.ZstdCompressor(level=1)
        self.index: list[bytes] = []
        self.keys, self.n_keys = bytearray(), 0
        self.block, self.entries, self.last = bytearray(), 0, b""
        self.n_ids = 0

    @property
    def last_key(self) -> bytes:
        return bytes(self.keys[-KEY_BYTES:])

    def add(self, key: bytes, ids: bytes) -> None:
        """``ids``: already as wide as the file's ids."""
        if self.keys and key < self.last_key:
            raise ValueError("keys must ascend")
        shared = 0
        if self.entries:
            while shared < len(key) and shared < len(self.last) and key[shared] == self.last[shared]:
                shared += 1
        n = len(ids) // self.width
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(n) + key[shared:]
        self.block += ids
        self.last, self.entries, self.n_ids = key, self.entries + 1, self.n_ids + n
        self.keys += key
        self.n_keys += 1
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if not self.entries:
            return
        packed = self.zstd.compress(bytes(self.block))
        self.stream.write(packed)
        self.index.append(struct.pack("<H", len(self.last)) + self.last + struct.pack("<QIII", self.at, len(packed), self.entries, zlib.crc32(packed)))
        self.at += len(packed)
        self.block, self.entries, self.last = bytearray(), 0, b""

    def close(self) -> None:
        self.flush()
        index = struct.pack("<I", len(self.index)) + b"".join(self.index)
        bits = max(64, BITS_PER_KEY * self.n_keys)
        bloom = bytearray((bits + 7) // 8)
        for at in range(0, len(self.keys), KEY_BYTES):
            for p in _bloom_places(bytes(self.keys[at : at + KEY_BYTES]), bits):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom = struct.pack("<Q", bits) + bytes(bloom)
        self.stream.write(index + bloom + FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.n_keys, self.n_ids, self.width, zlib.crc32(index + bloom), MAGIC))


class ShardReader:
    """Reads one shard: all entries in order, or those of a key."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - FOOTER.size)
        index_at, index_size, bloom_at, bloom_size, self.n_docs, self.n_ids, self.width, crc, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard file")
        file.seek(index_at)
        tail = file.read(index_size + bloom_size)
        if zlib.crc32(tail) != crc:
            raise ValueError("index or filter is damaged")
        index, bloom = tail[:index_size], tail[index_size:]
        self.bits, self.bloom = struct.unpack_from("<Q", bloom)[0], bloom[8:]
        (n,), at = struct.unpack_from("<I", index), 4
        self.last_keys, self.blocks = [], []
        for _ in range(n):
            (k,) = struct.unpack_from("<H", index, at)
            self.last_keys.append(index[at + 2 : at + 2 + k])
            self.blocks.append(struct.unpack_from("<QIII", index, at + 2 + k))
            at += 2 + k + 20

    def entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        import zstandard

        at, size, n, crc = self.blocks[block]
        self.file.seek(at)
        packed = self.file.read(size)
        if zlib.crc32(packed) != crc:
            raise ValueError("a block is damaged")
        data, p, key = zstandard.ZstdDecompressor().decompress(packed), 0, b""
        for _ in range(n):
            shared, p = _read_varint(data, p)
            rest, p = _read_varint(data, p)
            n_ids, p = _read_varint(data, p)
            key = key[:shared] + data[p : p + rest]
            p += rest
            yield key, data[p : p + n_ids * self.width]
            p += n_ids * self.width

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for b in range(len(self.blocks)):
            yield from self.entries(b)

    def get(self, key: bytes) -> list[bytes]:
        """The ids of every row with this key."""
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, self.bits)):
            return []
        found = []
        for b in range(bisect_left(self.last_keys, key), len(self.blocks)):
            found += [ids for k, ids in self.entries(b) if k == key]
            if self.last_keys[b] > key:
                break
        return found


def _store(path: str):
    """The file system and the place in it of a path, with a scheme or without."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _sorted_by() -> list[Column]:
    """Of a row (k, v): whether it has an identifier, that, a hash of its text, and a salt that parts rows which agree in these."""
    return [F.col("k").isNotNull().cast("int").alias("has"), F.coalesce("k", F.lit(0)).alias("k"), F.xxhash64("v").alias("h"), F.xxhash64(F.monotonically_increasing_id()).alias("r")]


def _bounds(places: DataFrame, shards: int) -> list[tuple]:
    """The first place of each shard but the first, in order; one row for each shard comes to the driver."""
    if shards == 1:
        return []
    ranged = places.select("has", "k", "h", "r").repartitionByRange(shards, "has", "k", "h", "r")
    least = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("has", "k", "h", "r")).alias("least"))
    return sorted(tuple(r.least) for r in least.collect())[1:]


def _number_of_shards(rows: DataFrame, bytes_of: str = "octet_length(v)") -> int:
    size = rows.agg(F.sum(F.expr(bytes_of))).first()[0] or 0
    wanted = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-size // SHARD_BYTES), min(wanted, -(-size // SHARD_LEAST)))


def write_table(df: DataFrame, path: str, tokenizer: str, end_id: int | None, words: bool = False, vocabulary: int = 1 << 32, text: str = "text", doc_id: str = "doc_id", shards: int | None = None) -> DataFrame:
    """Encodes every text and writes shards under ``path``, in ascending order of ``doc_id``; returns the manifest.

    ``tokenizer`` is a JSON file of the tokenizers library; ``end_id`` (if given) closes each document;
    ``vocabulary`` bounds the ids, so that two bytes can hold them below 65,536.
    The manifest, ``path``/manifest, is written last and makes the table.
    """
    width = 2 if vocabulary <= 1 << 16 else 4
    rows = df.select(F.col(doc_id).cast("long").alias("k"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("v"))
    with scratch():
        places = written(rows.select(*_sorted_by(), F.octet_length("v").alias("size")), "places")
        bounds = _bounds(places, shards or _number_of_shards(places, "size"))
    n = len(bounds) + 1

    def encode(batches):
        encoder = piece_encoder(tokenizer, words, PIECES, width)
        end = b"" if end_id is None else struct.pack("<H" if width == 2 else "<I", end_id)
        for batch in batches:
            places = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            for at, some in portions(x.as_py() for x in batch.column(4)):
                texts = list(dict.fromkeys(some))
                known = {value: packed + end for value, packed in zip(texts, encoder.encode_many([text_of(x) for x in texts]), strict=True)}
                shard = pa.array([bisect_right(bounds, p) for p in places[at : at + len(some)]], type=pa.int32())
                yield pa.RecordBatch.from_arrays([shard, *(batch.column(i).slice(at, len(some)) for i in range(3)), pa.array([known[x] for x in some], type=pa.binary())], names=["shard", "has", "k", "h", "ids"])

    def run(batches):
        store, folder = _store(path)
        store.create_dir(folder, recursive=True)
        writer = stream = name = first = shard = None

        def done():
            writer.close()
            stream.close()
            row = [[shard], [name if folder == path else f"{path}/{name.rsplit('/', 1)[1]}"], [first], [writer.last_key], [writer.n_keys], [writer.n_ids]]
            return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(row, (pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["shard", "path", "first_key", "last_key", "n_docs", "n_ids"])

        for batch in batches:
            for own, has, k, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                key = key_of(k if has else None)
                if own != shard:
                    if writer:
                        yield done()
                    shard, first = own, key
                    name = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.sst"
                    stream = store.open_output_stream(name)
                    writer = ShardWriter(stream, width)
                writer.add(key, ids.as_py())
        if writer:
            yield done()

    encoded = rows.select(*_sorted_by(), "v").mapInArrow(encode, "shard int, has int, k long, h long, ids binary")
    dealt = encoded.repartitionById(n, "shard").sortWithinPartitions("shard", "has", "k", "h")
    dealt.select("shard", "has", "k", "ids").mapInArrow(run, MANIFEST).write.parquet(f"{path}/manifest")
    return read_manifest(df.sparkSession, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a table: doc_id, start (ids of all documents before it), n_ids and its packed 32-bit ids.

    Starts come from the manifest's counts, of which there is one for each shard.
    """
    manifest = read_manifest(spark, path)
    starts = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))

    def run(batches):
        import numpy as np

        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, place = _store(file)
                with store.open_input_file(place) as f:
                    reader, rows, held, at = ShardReader(f), [], 0, base
                    for key, ids in reader:
                        n = len(ids) // reader.width
                        wide = ids if reader.width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                        rows.append((id_of(key), at, n, wide))
                        at, held = at + n, held + len(wide)
                        if held >= 8 << 20:
                            yield _rows(rows)
                            rows, held = [], 0
                    if rows:
                        yield _rows(rows)

    # one row for each shard: one task for each, however few bytes the rows have
    return starts.select("path", "base").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(run, "doc_id long, start long, n_ids long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "start", "n_ids", "ids"])


def lookup(spark: SparkSession, path: str, doc_id: int | None) -> list[list[int]]:
    """The ids of each row with this identifier, found by bisection; reads one block of each shard that may hold it."""
    key, found = key_of(doc_id), []
    for row in read_manifest(spark, path).where((F.col("first_key") <= F.lit(bytearray(key))) & (F.col("last_key") >= F.lit(bytearray(key)))).orderBy("shard").toLocalIterator():
        store, place = _store(row.path)
        with store.open_input_file(place) as f:
            reader = ShardReader(f)
            found += [memoryview(x).cast("H" if reader.width == 2 else "I").tolist() for x in reader.get(key)]
    return found


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum, read back from the shards it was written to."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    path = f"{shared_dir(spark)}/ids"
    write_table(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, vocabulary=50_257)
    return read_table(spark, path).select("doc_id", "start", F.col("n_ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
