"""Token ids as sorted-string-table shards, and their reading and lookup.

A shard is one file, written for one range of identifiers in ascending order:

    data blocks   entries of (shared key bytes, own key bytes, value bytes) as varints, then the rest
                  of the key and the value; a block starts with a whole key; blocks are zstd frames
    index         for each block its last key, place, stored size and entries
    Bloom filter  BLOOM_BITS bits for each document, BLOOM_HASHES of them set
    footer        FOOTER: places and sizes of index and filter, entries, ids, bytes of an id, magic

A key is a null mark, the identifier as 8 big-endian bytes with the sign flipped, and the number of
the row among those with its identifier in the shard, so byte order is identifier order. A value is
the document's ids in 2 bytes each where the vocabulary allows, else in 4.
"""

from __future__ import annotations

import json
import struct
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .bpe import IDS_AT_ONCE, as_binary, lists, piece_table, slices, tokenizer
from .common import shared_folder

BLOCK_BYTES = 65_536
BLOOM_BITS = 10
BLOOM_HASHES = 7
FOOTER = struct.Struct("<QQQQQQI4s")
MAGIC = b"WMS1"
#: Word forms that a worker remembers the ids of (others are encoded again), and forms in one string.
REMEMBERED, FORMS_AT_ONCE = 600_000, 100
#: Bytes of text that are encoded at once.
TEXT_AT_ONCE = 8_000_000
#: Fixed value: a space before white space, where words that start with a space can't be told apart.
LOOSE_SPACE = r" [\s\x0b\x1c-\x1f\x{85}\pZ]"
#: Stands for a single line end while texts are cut.
MARK = "\x01"


def _key(identifier: int | None, row: int) -> bytes:
    if identifier is None:
        return b"\x00" + struct.pack(">QI", 0, row)
    return b"\x01" + struct.pack(">QI", identifier + (1 << 63), row)


def _identifier(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:9])[0] - (1 << 63) if key[0] else None


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at += 1
        if byte < 128:
            return value, at
        shift += 7


def _bloom_places(key: bytes, size: int) -> list[int]:
    first = xxh64_intdigest(key, 0)
    step = first >> 32 | 1
    return [(first + i * step) % size for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Writes one shard to an open stream; keys must come in ascending order."""

    def __init__(self, stream, id_bytes: int) -> None:
        self.stream, self.id_bytes = stream, id_bytes
        self.at = self.entries = self.ids = 0
        self.block, self.last, self.in_block = bytearray(), b"", 0
        self.index: list[tuple[bytes, int, int, int]] = []
        self.hashed: list[bytes] = []

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.in_block:
            while shared < len(key) and shared < len(self.last) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.in_block += 1
        self.entries += 1
        self.ids += len(value) // self.id_bytes
        if key.endswith(b"\x00\x00\x00\x00"):  # the first row of an identifier
            self.hashed.append(key[:9])
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        place = self.at, len(data)
        self.stream.write(data)
        self.at += len(data)
        return place

    def flush(self) -> None:
        if self.in_block:
            self.index.append((self.last, *self._put(zstandard.ZstdCompressor(level=1).compress(bytes(self.block))), self.in_block))
            self.block, self.in_block = bytearray(), 0

    def close(self) -> None:
        self.flush()
        index = self._put(b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) + _varint(m) for k, at, n, m in self.index))
        size = max(64, BLOOM_BITS * len(self.hashed))
        bits = np.zeros(size, dtype=np.uint8)
        for key in self.hashed:
            bits[_bloom_places(key, size)] = 1
        bloom = self._put(struct.pack("<Q", size) + np.packbits(bits, bitorder="little").tobytes())
        self.stream.write(FOOTER.pack(*index, *bloom, self.entries, self.ids, self.id_bytes, MAGIC))


class ShardReader:
    """Reads one shard: every entry in order, or one identifier by binary search."""

    def __init__(self, stream) -> None:
        self.stream = stream
        stream.seek(stream.size() - FOOTER.size)
        index_at, index_size, bloom_at, bloom_size, self.entries, self.ids, self.id_bytes, magic = FOOTER.unpack(stream.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("this file is not a shard")
        data, at = self._at(index_at, index_size), 0
        self.last_keys: list[bytes] = []
        self.blocks: list[tuple[int, int, int]] = []
        while at < len(data):
            n, at = _read_varint(data, at)
            self.last_keys.append(data[at : at + n])
            at += n
            place, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            count, at = _read_varint(data, at)
            self.blocks.append((place, size, count))
        bloom = self._at(bloom_at, bloom_size)
        self.bloom_size = struct.unpack("<Q", bloom[:8])[0]
        self.bloom = bloom[8:]

    def _at(self, place: int, size: int) -> bytes:
        self.stream.seek(place)
        return self.stream.read(size)

    def _block(self, number: int) -> Iterator[tuple[bytes, np.ndarray]]:
        place, size, count = self.blocks[number]
        data, at, key = zstandard.ZstdDecompressor().decompress(self._at(place, size)), 0, b""
        for _ in range(count):
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, np.frombuffer(data, f"<u{self.id_bytes}", length // self.id_bytes, at)
            at += length

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for number in range(len(self.blocks)):
            for key, ids in self._block(number):
                yield _identifier(key), ids

    def lookup(self, identifier: int | None) -> list[np.ndarray]:
        """The ids of every row with this identifier; none if the filter or the index rules it out."""
        start = _key(identifier, 0)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(start[:9], self.bloom_size)):
            return []
        out = []
        for number in range(bisect_left(self.last_keys, start), len(self.blocks)):
            for key, ids in self._block(number):
                if key[:9] == start[:9]:
                    out.append(ids)
                elif key > start:
                    return out
        return out


class Forms:
    """What a worker knows of one tokenizer file: forms met so far and their ids, to a bound, held as arrays."""

    def __init__(self, file_text: str) -> None:
        self.coder = tokenizer(file_text)
        self.cut = cuts_at_spaces(file_text)
        self.size_of = np.array([len(p) for p in piece_table(file_text)[0]]) if self.cut else None
        self.forms = pa.array([], pa.string())
        self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, "<u4")

    def alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each) of texts encoded on their own."""
        found = [e.ids for at in range(0, len(texts), 5000) for e in self.coder.encode_batch_fast(texts[at : at + 5000], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), "<u4", int(sizes.sum())), sizes

    def strung(self, forms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each) of forms that start with a space or line end, encoded many in a string.

        The tokenizer cuts where a form starts, and ids give back every byte, so the bytes that ids stand
        for tell which form they are of.
        """
        words = forms.to_pylist()
        ids, _ = self.alone(["".join(words[at : at + FORMS_AT_ONCE]) for at in range(0, len(words), FORMS_AT_ONCE)])
        edges = np.cumsum(pc.binary_length(forms).to_numpy(zero_copy_only=False).astype(np.int64))
        reached = np.cumsum(self.size_of[ids])
        last = np.searchsorted(reached, edges)
        if len(edges) and not np.array_equal(reached[last], edges):
            return self.alone(words)
        return ids, np.diff(last, prepend=-1)

    def coded(self, forms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each) of distinct forms; only those not known yet are encoded."""
        place = pc.index_in(forms, self.forms)
        new = forms.filter(pc.is_null(place))
        ids, sizes = self.strung(new)
        where = place.to_numpy(zero_copy_only=False)
        fresh = np.isnan(where) if where.dtype.kind == "f" else np.zeros(len(where), bool)
        where = np.where(fresh, len(self.forms) + np.cumsum(fresh) - 1, where).astype(np.int64)
        sizes, ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])
        kept = min(len(new), max(0, REMEMBERED - len(self.forms)))
        out = taken(ids, sizes, where)
        if kept:
            self.forms = pa.concat_arrays([self.forms, new.slice(0, kept)])
            self.sizes = sizes[: len(self.forms)]
            self.ids = ids[: self.sizes.sum()]
        return out


def taken(values: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes) of the runs at these places."""
    return lists(pa.array(values), sizes).take(pa.array(places)).flatten().to_numpy(), sizes[places]


def cuts_at_spaces(file_text: str) -> bool:
    """Whether a file's tokenizer always cuts before a space, or a single line end, that non-blank text follows.

    So do byte-level files with the usual split, without a normalizer and without added tokens that hold
    blanks or take them in. Texts are encoded whole for any other file.
    """
    file = json.loads(file_text)
    split, model = file.get("pre_tokenizer") or {}, file["model"]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex") is True and split.get("add_prefix_space") is False
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and not any(c.isspace() for c in t["content"]) for t in file["added_tokens"])
    return bool(plain and added and file.get("normalizer") is None and (file.get("decoder") or {}).get("type") == "ByteLevel" and model["type"] == "BPE" and not model.get("dropout"))


_forms: dict[int, Forms] = {}


def encode_texts(texts: pa.Array, file_text: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, ids of each); null texts are empty, end is put after each.

    Where the file allows (cuts_at_spaces), texts are cut before spaces and single line ends, and equal
    forms of a batch are encoded once; a full stop or comma after an ASCII letter is a form of its own.
    Texts with a space before other white space, or with the mark that stands for a line end meanwhile, are
    encoded whole, as are all texts of other files.
    """
    key = hash(file_text)
    if key not in _forms:
        _forms[key] = Forms(file_text)
    known = _forms[key]
    texts = pc.fill_null(texts, "")
    if not known.cut:
        ids, sizes = known.alone(texts.to_pylist())
        return np.insert(ids, np.cumsum(sizes), end), sizes + 1
    loose = pc.or_(pc.match_substring_regex(texts, LOOSE_SPACE), pc.match_substring(texts, MARK))
    marked = pc.replace_substring_regex(pc.if_else(loose, "", texts), r"(\S)\n(\S)", rf"\1 {MARK}\2")
    split = pc.split_pattern(marked, " ")
    words = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = split.flatten()
    firsts = np.cumsum(words) - words
    coded = flat.dictionary_encode()
    place, pieces = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    forms = pc.if_else(pc.starts_with(pieces, MARK), pc.replace_substring(pieces, MARK, "\n", max_replacements=1), pc.binary_join_element_wise(" ", pieces, ""))
    stopped = pc.match_substring_regex(pieces, "[A-Za-z][.,]$")
    bare = pc.if_else(stopped, pc.utf8_slice_codeunits(forms, 0, -1), forms).dictionary_encode()
    ids, sizes = taken(*known.coded(bare.dictionary), bare.indices.to_numpy().astype(np.int64))
    stops = np.flatnonzero(stopped.to_numpy(zero_copy_only=False))
    marks = pc.ends_with(pieces.take(pa.array(stops)), ",").to_numpy(zero_copy_only=False)
    dot, comma = known.alone([".", ","])[0] if len(stops) else (0, 0)
    ids = np.insert(ids, np.cumsum(sizes)[stops], np.where(marks, comma, dot))
    sizes[stops] += 1
    # texts' first pieces have no space before them, and some texts are whole
    heads = flat.take(pa.array(firsts)).dictionary_encode()
    whole = np.flatnonzero(loose.to_numpy(zero_copy_only=False))
    place[firsts] = len(sizes) + heads.indices.to_numpy()
    place[firsts[whole]] = len(sizes) + len(heads.dictionary) + np.arange(len(whole))
    more_ids, more_sizes = known.alone(heads.dictionary.to_pylist() + texts.take(pa.array(whole)).to_pylist())
    ids, sizes = np.concatenate([ids, more_ids, [end]]), np.concatenate([sizes, more_sizes, [1]])
    place = np.insert(place, np.cumsum(words), len(sizes) - 1)
    got, each = taken(ids.astype("<u4"), sizes, place)
    return got, np.add.reduceat(each, np.cumsum(words + 1) - words - 1)


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{Path(folder).absolute()}")


@dataclass(frozen=True)
class Shard:
    """A written shard: its file, documents, ids, and the identifiers of its first and last document."""

    name: str
    entries: int
    ids: int
    first: int | None
    last: int | None

    def may_hold(self, identifier: int | None) -> bool:
        """Null comes before every number."""
        if identifier is None:
            return self.first is None
        return self.last is not None and (self.first is None or self.first <= identifier) and identifier <= self.last


def write_shards(docs: DataFrame, file: str, folder: str, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> list[Shard]:
    """Writes every row of docs, encoded and closed by the id end, as shards, and names them in order.

    Rows are dealt by ranges of (id, hash of the text), so that one id with a third of all rows still
    spreads, and sorted; null ids come first. A shard is written under a name of its own and then
    moved, so a task that runs again replaces what it wrote. Only one line per shard comes back.
    """
    file_text = Path(file).read_text(encoding="utf-8")
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(file_text)  # one vocabulary file
    id_bytes = 2 if tokenizer(file_text).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        name = f"part-{TaskContext.get().partitionId():06d}.sst"
        draft = f"{root}/_{name}.{uuid.uuid4().hex}"
        writer, stream, before, row, first = None, None, (), 0, None
        for batch in batches:
            for part in slices(batch, TEXT_AT_ONCE):
                if writer is None:
                    system.create_dir(root, recursive=True)
                    stream = system.open_output_stream(draft)
                    writer, first = ShardWriter(stream, id_bytes), part.column(0)[0].as_py()
                ids, sizes = encode_texts(part.column(1), sent.value, end)
                data, ends = ids.astype(f"<u{id_bytes}").tobytes(), np.cumsum(sizes) * id_bytes
                for identifier, stop, size in zip(part.column(0).to_pylist(), ends.tolist(), (sizes * id_bytes).tolist(), strict=True):
                    row = row + 1 if before == (identifier,) else 0
                    before = (identifier,)
                    writer.add(_key(identifier, row), data[stop - size : stop])
        if writer is not None:
            writer.close()
            stream.close()
            system.move(draft, f"{root}/{name}")
            ends = {"first": pa.array([first], pa.int64()), "last": pa.array(before, pa.int64())}
            yield pa.RecordBatch.from_pydict({"name": [name], "entries": [writer.entries], "ids": [writer.ids], **ends})

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t"))
    dealt = rows.repartitionByRange("id", F.xxhash64("t")).sortWithinPartitions("id", F.xxhash64("t"))
    done = dealt.mapInArrow(run, "name string, entries bigint, ids bigint, first bigint, last bigint").collect()
    return sorted((Shard(*r) for r in done), key=lambda shard: shard.name)


def read_shards(spark, folder: str, shards: list[Shard], id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, ids) of every document in the shards: start counts the ids of all documents before it."""
    starts = accumulate((shard.ids for shard in shards), initial=0)
    places = [(shard.name, start) for shard, start in zip(shards, starts, strict=False)]
    table = spark.createDataFrame(places, "name string, base bigint").repartition(max(1, len(places)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        for batch in batches:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_file(f"{root}/{name}") as stream:
                    names, starts, found, size = [], [], [], 0
                    for identifier, ids in ShardReader(stream):
                        names.append(identifier)
                        starts.append(at)
                        found.append(ids.astype("<u4"))
                        at += len(ids)
                        size += len(ids)
                        if size >= IDS_AT_ONCE:
                            yield _rows(names, starts, found)
                            names, starts, found, size = [], [], [], 0
                    if names:
                        yield _rows(names, starts, found)

    out = table.mapInArrow(run, "id bigint, start bigint, ids binary")
    return out.withColumnRenamed("id", id_col)


def _rows(names: list, starts: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(starts, pa.int64()), as_binary(np.concatenate(found), sizes)], names=["id", "start", "ids"])


def lookup(folder: str, shards: list[Shard], identifier: int | None) -> list[np.ndarray]:
    """The ids of every row with this identifier: only shards whose range holds it are opened, found by binary search."""
    system, root = _open(folder)
    out: list[np.ndarray] = []
    rank = [(s.last is not None, s.last or 0) for s in shards]
    for shard in shards[bisect_left(rank, (identifier is not None, identifier or 0)) :]:
        if not shard.may_hold(identifier):
            break
        with system.open_input_file(f"{root}/{shard.name}") as stream:
            out += ShardReader(stream).lookup(identifier)
    return out


def digests(docs: DataFrame, file: str, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of every row of docs, from shards written to the shared folder and read back.

    Null texts count as empty and hold the closing id alone. Repeated rows and ids are entries each;
    among equal ids the order is that of their texts' hashes. Very long texts are encoded and stored whole.
    Other columns of docs are not read.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    shards = write_shards(docs, file, folder, end, id_col, text_col)
    out = read_shards(spark, folder, shards, id_col)
    return out.select(id_col, "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
