"""BPE encoding through a distinct-word table, and decoding through an id-to-piece table.

1. split: documents become chunks; a chunk holds its documents' words as places in the chunk's own
   list of distinct words, dealt into buckets by the word's hash.
2. encode: the lists meet by bucket, so every occurrence of a word in the corpus meets in one task
   (once for each chunk, however often the chunk has it) and each distinct word is encoded once.
3. join back: a chunk's encoded lists return to it by chunk and place, and documents get their ids.

The table (chunk, place, word, ids) that this joins by is kept as packed lists, one row for each chunk
and bucket: a row for each word would shuffle the corpus's words twice over.

A word is what stands between ASCII white space. For this to be exact the file's tokenizer must drop
white space and join nothing across it; drops_blanks() reads that from the file. Texts are encoded
whole, each distinct one of a batch once, for any other file.
"""

from __future__ import annotations

import json
import uuid
from array import array
from collections.abc import Iterator
from itertools import chain
from pathlib import Path
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder

#: Characters of text in a chunk; a longer document is a chunk of its own.
CHUNK_CHARACTERS = 8_000_000
#: Words that a task remembers the ids of before it starts anew.
REMEMBERED = 1_000_000
#: Normalizers that leave ASCII white space where it is.
KEEP_BLANKS = ("NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents")
#: Token ids in one batch that goes back to Spark.
IDS_AT_ONCE = 500_000
#: Characters of text that are encoded whole at once.
WHOLE_AT_ONCE = 2_000_000
_tokenizers: dict[int, object] = {}


def tokenizer(text: str):
    """The tokenizer described by a file's text, without truncation and padding, kept for a worker's life."""
    key = hash(text)
    if key not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_str(text)
        found.no_truncation()
        found.no_padding()
        _tokenizers[key] = found
    return _tokenizers[key]


def _parts(described: dict | None, name: str) -> list[dict]:
    """The parts of a sequence of normalizers or pre-tokenizers, or the one there is."""
    return [] if described is None else described.get(name, [described])


def drops_blanks(file_text: str) -> bool:
    """Whether a file's tokenizer drops white space and has no token across it, so that words can be encoded one by one."""
    file = json.loads(file_text)
    first = (_parts(file.get("pre_tokenizer"), "pretokenizers") or [{"type": ""}])[0]
    if first["type"] == "Split" and "Regex" in first["pattern"]:
        pattern = regex.compile(first["pattern"]["Regex"])
        probe = "a b\tc\n1 .\r'x\v!\f's  z "
        splits = first["behavior"] == "Removed" and first["invert"] and not any(c.isspace() for found in pattern.findall(probe) for c in found)
    else:
        splits = first["type"] in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer")
    spaced = any(p.get("add_prefix_space") for p in _parts(file.get("pre_tokenizer"), "pretokenizers"))
    normal = all(
        n["type"] in KEEP_BLANKS or n["type"] == "Replace" and n["content"] == " " and n["pattern"].get("Regex") in (r"\s", r"\s+")
        for n in _parts(file.get("normalizer"), "normalizers")
    )
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not any(c.isspace() for c in t["content"]) for t in file["added_tokens"])
    return bool(splits and normal and added and not spaced and not file["model"].get("dropout"))


def lowers(file_text: str) -> bool:
    """Whether a file's tokenizer lower-cases texts itself and tells added tokens before that, by marks that hold "<|"."""
    file = json.loads(file_text)
    return any(n["type"] == "Lowercase" for n in _parts(file.get("normalizer"), "normalizers")) and all("<|" in t["content"] for t in file["added_tokens"])


def lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    """Consecutive runs of values as a list array."""
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def as_binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive runs of values, each as its little-endian bytes."""
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes * values.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def squeeze(places: np.ndarray) -> bytes:
    """Places as four planes of bytes, compressed."""
    planes = places.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def slices(batch: pa.RecordBatch, characters: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose second column has at most so many bytes of text, or one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(sizes):
        base = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, base + characters, side="right")))
        yield batch.slice(at, end - at)
        at = end


def gathered(batches: Iterator[pa.RecordBatch], characters: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches of any size, in order, as batches whose second column has at most so many bytes of text, or one row."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in slices(batch, characters):
            own = pc.sum(pc.binary_length(part.column(1))).as_py() or 0
            if held and size + own > characters:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held.append(part)
            size += own
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def by_rank(sizes: np.ndarray) -> np.ndarray:
    """Where the words stand in lists of so many words, one list after the other, if all first words come first, then all second ones, and so on."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.lexsort((owner, rank))


def _split(docs: DataFrame, buckets: int, lower: bool) -> DataFrame:
    """(chunk, ids, sizes, places, words): one row per chunk, as the module says.

    lower: A-Z may be lower-cased first, as the tokenizer would, for fewer distinct words. A bucket's words stand
    from the most frequent on, and places are numbered as by_rank() does, so that frequent words have low numbers, which
    compress better.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for part in gathered(batches, CHUNK_CHARACTERS):
            text = part.column(1)
            if lower and not pc.any(pc.match_substring(text, "<|")).as_py():
                text = pc.ascii_lower(text)
            split = pc.ascii_split_whitespace(text)
            sizes = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False)
            coded = split.flatten().dictionary_encode()
            words = [w.encode() or b"\n" for w in coded.dictionary.to_pylist()]  # an empty one as white space, which has no ids
            bucket = np.fromiter(map(crc32, words), dtype=np.int64, count=len(words)) % buckets
            places = coded.indices.to_numpy()
            order = np.lexsort((-np.bincount(places, minlength=len(words)), bucket))
            in_bucket = np.bincount(bucket, minlength=buckets)
            place = np.empty(len(order), dtype=np.int64)
            place[order[by_rank(in_bucket)]] = np.arange(len(order))
            ends = np.cumsum(in_bucket).tolist()
            order = order.tolist()
            pack = zstandard.ZstdCompressor(level=3).compress
            in_buckets = [pack(b" ".join([words[i] for i in order[a:b]])) if b > a else b"" for a, b in zip([0, *ends], ends, strict=False)]
            del words, order
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk]),
                    lists(part.column(0), [len(part)]),
                    pa.array([sizes.astype("<i4").tobytes()]),
                    pa.array([squeeze(place[places])]),
                    pa.array([in_buckets], pa.list_(pa.binary())),
                ],
                names=["chunk", "ids", "sizes", "places", "words"],
            )
            chunk += 1

    return docs.mapInArrow(run, f"chunk bigint, ids array<{kind}>, sizes binary, places binary, words array<binary>")


def _encode(parts: DataFrame, file_text: str) -> DataFrame:
    """(chunk, bucket, sizes, tokens) of (chunk, bucket, words): each distinct word is encoded once, in its bucket's task.

    A task that has met REMEMBERED words forgets them, and encodes again those that it meets again.
    """
    sent = parts.sparkSession.sparkContext.broadcast(file_text)  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for chunk, bucket, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = unpack(blob).split(b" ")
                new = [w for w in words if w not in known]
                coded = tokenizer(sent.value).encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
                known.update((w, array("I", e.ids).tobytes()) for w, e in zip(new, coded, strict=True))
                found = [known[w] for w in words]
                if len(known) > REMEMBERED:
                    known.clear()
                sizes = squeeze(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4)
                row = {"chunk": [chunk], "bucket": pa.array([bucket], pa.int32()), "sizes": [sizes], "tokens": [squeeze(np.frombuffer(b"".join(found), "<u4"))]}
                yield pa.RecordBatch.from_pydict(row)

    return parts.mapInArrow(run, "chunk bigint, bucket int, sizes binary, tokens binary")


def _whole(docs: DataFrame, file_text: str, with_text: bool) -> DataFrame:
    """What encode() gives, by encoding whole texts: for files whose words can't be encoded one by one."""
    sent = docs.sparkSession.sparkContext.broadcast(file_text)  # one vocabulary file
    pieces = docs.sparkSession.sparkContext.broadcast(piece_table(file_text) if with_text else None)
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(pieces.value[0], pa.binary()) if with_text else None
        for batch in batches:
            for part in slices(batch, WHOLE_AT_ONCE):
                texts = pc.fill_null(part.column(1), "").dictionary_encode()
                found = [e.ids for e in tokenizer(sent.value).encode_batch_fast(texts.dictionary.to_pylist(), add_special_tokens=False)]
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                table = lists(pa.array(np.fromiter(chain.from_iterable(found), "<u4", int(sizes.sum()))), sizes)
                got, sizes = table.take(texts.indices).flatten().to_numpy(), sizes[texts.indices.to_numpy()]
                out = [part.column(0), as_binary(got, sizes)]
                if with_text:
                    out.append(decoded(got, sizes, known, pieces.value[1]))
                yield pa.RecordBatch.from_arrays(out, names=["id", "ids", "decoded"][: len(out)])

    return docs.mapInArrow(run, f"id {kind}, ids binary" + ", decoded string" * with_text)


def encode(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(id_col, ids) for every row of docs: ids are little-endian unsigned 32-bit integers in a binary.

    file names any tokenizer file of the tokenizers library. Null texts count as empty and have no ids.
    Very long texts are encoded whole, each a chunk of its own. Repeated rows and ids come out as often as
    they came in; other columns of docs are not read. with_text adds decoded, the text that the ids give,
    in the same pass.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    file_text = Path(file).read_text(encoding="utf-8")
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    if not drops_blanks(file_text):
        return _whole(own, file_text, with_text).withColumnRenamed("id", id_col)
    split = _split(own, buckets, lowers(file_text))
    # bucketed by chunk, so that the chunks themselves are never shuffled
    name = f"bpe_chunks_{uuid.uuid4().hex}"
    split.write.bucketBy(buckets, "chunk").sortBy("chunk").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    split = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: its name goes, its files stay for the plan that reads them
    parts = split.select("chunk", F.posexplode("words").alias("bucket", "words")).where(F.octet_length("words") > 0)
    coded = _encode(parts.repartition(buckets, "bucket"), file_text)
    table = coded.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "sizes", "tokens"))).alias("table"))
    joined = split.select("chunk", "ids", "sizes", "places").join(table.hint("merge"), "chunk", "left")
    sent = spark.sparkContext.broadcast(piece_table(file_text) if with_text else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value[0], pa.binary()) if with_text else None
        for batch in batches:
            for row in range(len(batch)):
                names = batch.column("ids")[row].values
                counts = np.frombuffer(batch.column("sizes")[row].as_py(), "<i4").astype(np.int64)
                places = unsqueeze(batch.column("places")[row].as_py()).astype(np.int64)
                own = batch.column("table")[row].as_py() or []
                parts = [unsqueeze(p["sizes"]).astype(np.int64) for p in own]
                sizes = np.concatenate([np.zeros(0, np.int64), *parts])
                places = by_rank(np.array([len(p) for p in parts], dtype=np.int64))[places]
                tokens = lists(pa.array(np.concatenate([np.zeros(0, "<u4"), *(unsqueeze(p["tokens"]) for p in own)])), sizes)
                del own
                ends = np.cumsum(counts)
                running = np.concatenate([[0], np.cumsum(sizes[places])])
                lengths = running[ends] - running[ends - counts]
                at = 0
                while at < len(counts):
                    base = running[ends[at] - counts[at]]
                    end = max(at + 1, int(np.searchsorted(running[ends], base + IDS_AT_ONCE, side="right")))
                    got = tokens.take(pa.array(places[ends[at] - counts[at] : ends[end - 1]])).flatten().to_numpy()
                    out = [names.slice(at, end - at), as_binary(got, lengths[at:end])]
                    if with_text:
                        out.append(decoded(got, lengths[at:end], known, sent.value[1]))
                    yield pa.RecordBatch.from_arrays(out, names=["id", "ids", "decoded"][: len(out)])
                    at = end

    return joined.mapInArrow(run, f"id {kind}, ids binary" + ", decoded string" * with_text).withColumnRenamed("id", id_col)


def piece_table(file_text: str) -> tuple[list[bytes], str]:
    """The piece of every id, as bytes, and what stands between pieces when a text is decoded.

    It has one row for each id of the vocabulary, a size that no input changes.
    """
    described = json.loads(file_text)
    vocabulary = tokenizer(file_text).get_vocab(with_added_tokens=True)
    by_id = [""] * (max(vocabulary.values()) + 1)
    for piece, at in vocabulary.items():
        by_id[at] = piece
    if described.get("decoder") is None:
        return [p.encode() for p in by_id], " "
    if described["decoder"]["type"] != "ByteLevel":
        raise ValueError("only files without a decoder or with a byte-level one are known here")
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
    special = {t["content"] for t in described["added_tokens"]}
    return [p.encode() if p in special else bytes(byte_of[c] for c in p) for p in by_id], ""


def decoded(ids: np.ndarray, sizes: np.ndarray, known: pa.Array, between: str) -> pa.Array:
    """Texts of runs of ids: each id joined with its piece, the pieces put together."""
    joined = pc.binary_join(lists(known.take(pa.array(ids)), sizes), between.encode())
    return pa.array([x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.string())


def decode(coded: DataFrame, file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, ids_col, decoded) for every row: ids joined with the table of pieces, as decode() of the library.

    Null ids decode to an empty text.
    """
    sent = coded.sparkSession.sparkContext.broadcast(piece_table(Path(file).read_text(encoding="utf-8")))
    kind = coded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value[0], pa.binary())
        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                data = batch.column(1)
                sizes = pc.fill_null(pc.binary_length(data), 0).to_numpy(zero_copy_only=False) // 4
                ids = np.frombuffer(b"".join(x for x in data.to_pylist() if x), dtype="<u4")
                yield pa.RecordBatch.from_arrays([batch.column(0), data, decoded(ids, sizes, known, sent.value[1])], names=["id", "ids", "decoded"])

    out = coded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, ids binary, decoded string")
    return out.select(F.col("id").alias(id_col), F.col("ids").alias(ids_col), "decoded")


def digests(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): a check of encode() and decode() for every row."""
    out = encode(docs, file, id_col, text_col, with_text=True)
    return out.select(
        id_col,
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
