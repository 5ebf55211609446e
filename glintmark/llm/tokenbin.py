"""Token-ID files: one zstandard frame a document, a trailing seek table with checksums, and an index of documents.

File layout (zstandard's seekable format, so any zstandard reader can stream it):
  frame * documents   ids of one document, little-endian, 16 or 32 bits wide
  skippable frame     magic 0x184D2A5C: the index, zstandard-compressed: width, then doc_id and token count arrays
  skippable frame     magic 0x184D2A5E: per frame compressed size, decompressed size, low 32 bits of XXH64; footer
A reader takes the footer, the seek table and the index, then seeks to and decompresses only the frames it wants.

Writing: documents are dealt by ranges of doc_id and a hash of the text, so rows that share an id (or have none) are
split up, and sorted inside a task, so shards in order hold ascending ids; a task writes files of about SHARD bytes or
SHARD_DOCS documents and returns one manifest row a file. The manifest gives each file's first token place.

Null texts count as empty and get the end id alone. Rows with a null doc_id come first, rows with equal doc_ids in
order of their texts' hashes, then texts; all are kept. An empty table makes no file. Further columns are ignored.
"""

from __future__ import annotations

import io
import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A5C, 0x184D2A5E, 0x8F92EAB1
LEVEL = 3
#: Uncompressed bytes, and documents, after which a task begins another file.
SHARD, SHARD_DOCS = 256 << 20, 1 << 18
#: Remembered words, and their characters, in one task's process; all are forgotten when there are more.
REMEMBER, REMEMBER_CHARS = 500_000, 16_000_000
#: Bytes of texts whose distinct words are found together.
BATCH = 12 << 20


# The steps of a tokenizers file that `Words` takes apart. Files with other steps are encoded text by text.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Letters, then symbols: two pre-tokens in every case, as no apostrophe, special token or combining mark is among them or
#: comes out of lower case (as it does for U+0130).
TWO = "^(?P<a>[a-z\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{12F}\\x{131}-\\x{24F}]*)(?P<b>[!-&(-/:;=-@\\[-`{-~]*)$"


class Words:
    """Ids of texts by a tokenizers file that drops white space, by way of distinct words.

    With STEPS nothing looks across white space, so a text's ids are its words' ids in turn. A batch is cut at white
    space and its distinct words are found in Arrow; only those that aren't remembered meet the library, many in a line.
    Their ids are dealt out to all places in Arrow again. A file whose steps aren't STEPS gets whole texts encoded.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocab = self.library.get_vocab(with_added_tokens=True)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = all(spec[k] == v for k, v in STEPS.items()) and spec["model"]["type"] == "BPE" and spec["model"]["end_of_word_suffix"] == "</w>" and all("<" in t["content"] for t in spec["added_tokens"])
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.kind = np.dtype("<u2" if len(self.ends) <= 1 << 16 else "<u4")
        self.width = self.kind.itemsize
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.values, self.bounds = [np.zeros(0, self.kind)], [np.zeros(1, np.int64)]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.kind) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _lines(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids and lengths of words that are one pre-token each: many in a line, cut where a token ends a word."""
        lines = [words[k : k + 256] for k in range(0, len(words), 256)]
        values, lengths = [], []
        for line, ids in zip(lines, self._encode([" ".join(x) for x in lines])):
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(line):  # a letter that isn't one after normalising
                own = self._encode(line)
                ids, cuts = np.concatenate(own), np.cumsum([len(x) for x in own])
            values.append(ids)
            lengths.append(np.diff(cuts, prepend=0))
        return np.concatenate(values), np.concatenate(lengths)

    def _slots(self, words: list[str], lines: bool) -> np.ndarray:
        """Where the ids of words are remembered; those that aren't are encoded first."""
        known = self.known
        fresh = [w for w in words if w not in known]
        if fresh:
            if lines:
                values, lengths = self._lines(fresh)
            else:
                own = self._encode(fresh)
                values, lengths = np.concatenate(own), np.array([len(x) for x in own], np.int64)
            self.chars += sum(map(len, fresh))
            known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
            self.values.append(values)
            self.bounds.append(np.cumsum(lengths) + self.bounds[-1][-1])
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and where each text's begin, the end included. Null texts have none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_word:
            own = self._encode(texts.to_pylist())
            return np.concatenate([np.zeros(0, self.kind), *own]), np.concatenate([[0], np.cumsum([len(x) for x in own], dtype=np.int64)])
        if len(self.known) > REMEMBER or self.chars > REMEMBER_CHARS:
            self._forget()
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary
        two = pc.extract_regex(pc.ascii_lower(distinct), TWO)
        other = distinct.filter(two.is_null())
        # The empty word has no ids; slot 0 is its.
        slots = self._slots([""], False)[0]
        first, second = np.full(len(distinct), slots), np.full(len(distinct), slots)
        taken = np.asarray(two.is_valid())
        for part, into in (("a", first), ("b", second)):
            x = two.field(part).filter(two.is_valid()).dictionary_encode()
            into[taken] = self._slots(x.dictionary.to_pylist(), part == "a")[np.asarray(x.indices)]
        first[~taken] = self._slots(other.to_pylist(), False)
        values = np.concatenate(self.values)
        bounds = np.concatenate(self.bounds)
        self.values, self.bounds = [values], [bounds]
        pieces = pa.LargeListArray.from_arrays(bounds, values)
        both = pieces.take(pa.array(np.stack([first, second], 1).ravel()))
        words = pa.LargeListArray.from_arrays(pa.array(np.asarray(both.offsets)[::2]), both.values)
        every = words.take(coded.indices)
        ends = np.asarray(every.offsets)
        return np.asarray(every.values)[ends[0] : ends[-1]], ends[np.asarray(lists.offsets)] - ends[0]


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


class Writer:
    def __init__(self, width: int, level: int = LEVEL) -> None:
        self.width, self.press = width, zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.body, self.table, self.docs, self.counts, self.nulls, self.size = io.BytesIO(), [], [], [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.press.compress(ids)
        self.body.write(frame)
        self.table.append((len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.counts.append(len(ids) // self.width)
        self.size += len(ids)

    def finish(self, out) -> None:
        index = self.press.compress(
            struct.pack("<BQ", self.width, len(self.docs)) + np.array(self.docs, "<i8").tobytes() + np.array(self.counts, "<i8").tobytes() + np.array(self.nulls, np.uint8).tobytes()
        )
        out.write(self.body.getbuffer())
        out.write(struct.pack("<II", INDEX_MAGIC, len(index)))
        out.write(index)
        table = b"".join(struct.pack("<III", *x) for x in self.table)
        out.write(struct.pack("<II", SEEK_MAGIC, len(table) + 9))
        out.write(table)
        out.write(struct.pack("<IBI", len(self.table), 0x80, FOOTER_MAGIC))


class Reader:
    """Random access to one file. source: an open file with seek and read."""

    def __init__(self, source) -> None:
        self.source, self.press = source, zstandard.ZstdDecompressor()
        source.seek(0, 2)
        end = source.tell()
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != FOOTER_MAGIC or flags != 0x80:
            raise ValueError("no seek table with checksums")
        start = end - 9 - 12 * n - 8
        if struct.unpack("<II", self._at(start, 8)) != (SEEK_MAGIC, 12 * n + 9):
            raise ValueError("the seek table is damaged")
        self.table = np.frombuffer(self._at(start + 8, 12 * n), "<u4").reshape(n, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        magic, size = struct.unpack("<II", self._at(int(self.offsets[-1]), 8))
        if magic != INDEX_MAGIC:
            raise ValueError("the index is missing")
        index = self.press.decompress(self._at(int(self.offsets[-1]) + 8, size))
        self.width, m = struct.unpack_from("<BQ", index)
        self.doc_ids, self.counts = np.frombuffer(index, "<i8", m, 9), np.frombuffer(index, "<i8", m, 9 + 8 * m)
        self.nulls = np.frombuffer(index, np.uint8, m, 9 + 16 * m).astype(bool)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def __len__(self) -> int:
        return len(self.counts)

    def ids(self, k: int) -> np.ndarray:
        """Ids of the k-th document; only its frame is read, and its checksum is compared."""
        data = self.press.decompress(self._at(int(self.offsets[k]), int(self.table[k, 0])), max_output_size=int(self.table[k, 1]))
        if len(data) != self.table[k, 1] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(data, f"<u{self.width}")

    def find(self, doc_id: int) -> list[int]:
        return np.flatnonzero((self.doc_ids == doc_id) & ~self.nulls).tolist()


def write(docs: DataFrame, at: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 2, level: int = LEVEL, shard: int = SHARD) -> DataFrame:
    """Writes docs below the folder `at` and returns the manifest: file, n_docs, n_tokens, first_token, in order."""
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = TaskContext.get().partitionId(), []
        coder = words(path)
        end, writer = end_id.to_bytes(coder.width, "little"), Writer(coder.width, level)

        def flush() -> None:
            uri = f"{at}/ids-{part:06d}-{len(rows):05d}.zst"
            shared.publish(uri, writer.finish)
            rows.append({"part": part, "piece": len(rows), "file": uri, "n_docs": len(writer.docs), "n_tokens": sum(writer.counts)})

        for b in shared.cut(batches, BATCH):
            ids, places = coder.ids(b.column(1))
            data, places = memoryview(np.ascontiguousarray(ids)).cast("B"), (places * coder.width).tolist()
            for doc, start, stop in zip(b.column(0).to_pylist(), places, places[1:]):
                writer.add(doc, bytes(data[start:stop]) + end)
                if writer.size >= shard or len(writer.docs) >= SHARD_DOCS:
                    flush()
                    writer = Writer(coder.width, level)
        if writer.docs:
            flush()
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int32()), ("piece", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    files = shared.stored(ordered.mapInArrow(run, "part int, piece int, file string, n_docs long, n_tokens long"), "tokenbin-manifest")
    # One row a file here, never a document's.
    before = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("file", "n_docs", "n_tokens", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first_token"))


def read(manifest: DataFrame, row, schema: str) -> DataFrame:
    """row(reader, k, start) of every document k of every file in the manifest, as rows of schema."""
    names = [x.split()[0] for x in schema.split(", ")]
    spark = manifest.sparkSession
    empty = spark.createDataFrame([], schema)
    kinds = pa.schema([(f.name, pa.int64()) for f in empty.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, path = shared.filesystem(uri)
                with fs.open_input_file(path) as f:
                    reader = Reader(f)
                    for at in range(0, len(reader), 4096):
                        rows = [row(reader, k, first + int(reader.starts[k])) for k in range(at, min(at + 4096, len(reader)))]
                        yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows)], names=names) if rows else pa.RecordBatch.from_pylist([], schema=kinds)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file", "first_token").repartition(tasks).mapInArrow(run, schema)


def digest(reader: Reader, k: int, start: int) -> tuple:
    ids = reader.ids(k)
    return (None if reader.nulls[k] else int(reader.doc_ids[k]), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))


def op6_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    manifest = write(docs, shared.scratch(spark, "tokenbin"))
    return read(manifest, digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
