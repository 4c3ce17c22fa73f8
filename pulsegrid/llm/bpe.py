"""Byte-level BPE over a corpus: each distinct word is encoded once.

Encoding splits each stretch of documents into pre-tokens and gives every distinct one of the stretch a slot. The slots, a word
each, are shuffled by buckets of words, of which there are more the larger the scan is, so each distinct word of the corpus meets its
equals in one bucket and is encoded once; the ids go back to their stretch by a second shuffle and are put at the positions of
their slots. The positions themselves, a slot number for each pre-token, are by far the most of it; they wait in the shared folder and
aren't shuffled. A row for each word instead of each stretch and bucket was tried: it shuffles three times as much.
Decoding joins ids with the token-byte table, which has as many rows as the vocabulary, whatever the corpus: a broadcast join.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, blocks, get_bytes, picked, put_bytes, scratch, starts_of, trim
from .token_codes import coded, ragged, splitter

#: Bytes of text in a stretch, and pre-tokens that are put together at a time.
BLOCK_BYTES, STEP = 8 << 20, 400_000
#: Distinct words that a worker keeps the ids of, at most.
KNOWN = 400_000
#: Entries of the token-byte table at most: it is broadcast.
VOCABULARY = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """The token bytes and ranks of a .tiktoken file, read on the driver."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if len(ranks) > VOCABULARY:
        raise ValueError(f"more than {VOCABULARY} tokens")
    return ranks


_encoders: dict[int, object] = {}


def piece_encoder(shared, pattern: str):
    """tiktoken's encoding of a single piece; one per worker and broadcast."""
    if shared.value is not None and id(shared.value) not in _encoders:
        import tiktoken

        _encoders.clear()
        _encoders[id(shared.value)] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
    return _encoders[id(shared.value)]._encode_single_piece


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, byte plane by byte plane, compressed."""
    out = []
    for a in arrays:
        raw = np.ascontiguousarray(np.asarray(a, "<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
        small = pa.compress(raw, codec="zstd", asbytes=True)
        out += [struct.pack("<QQ", len(raw), len(small)), small]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        size, small = struct.unpack_from("<QQ", data, at)
        raw = pa.decompress(data[at + 16 : at + 16 + small], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel())
        at += 16 + small
    return out


def _name(folder: str, stretch: int) -> str:
    return f"{folder}/{stretch >> 32:06d}-{stretch & 0xFFFFFFFF:05d}"


def pack_words(words: list[bytes], slots: np.ndarray) -> bytes:
    """Some words and their slots."""
    body = b"".join(words)
    small = pa.compress(body, codec="zstd", asbytes=True)
    return struct.pack("<QQ", len(body), len(small)) + small + pack(np.fromiter(map(len, words), np.int64, len(words)), slots)


def unpack_words(data: bytes) -> tuple[list[bytes], np.ndarray]:
    size, small = struct.unpack_from("<QQ", data, 0)
    body = pa.decompress(data[16 : 16 + small], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    lengths, slots = unpack(data[16 + small :])
    ends = starts_of(lengths.astype(np.int64)).tolist()
    return [body[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], slots


def _stretches(folder: str, pattern: str, size: int, buckets: int):
    """Stage 1: positions to the shared folder, and a row for each stretch and bucket of its distinct words. A repeated task writes the same bytes."""

    def run(batches: Iterator[pa.RecordBatch]):
        split, part = splitter(pattern), TaskContext.get().partitionId()
        for seq, block in enumerate(blocks(batches, 1, size)):
            words, codes, lengths = coded(block.column(1).to_pylist(), split)
            order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
            slot = np.empty(len(words), np.int64)
            slot[order] = np.arange(len(words))
            stretch, sink = (part << 32) + seq, pa.BufferOutputStream()
            docs = pa.table({"id": block.column(0), "key": block.column(2), "n": pa.array(lengths)})
            with pa.ipc.new_stream(sink, docs.schema) as out:
                out.write_table(docs.combine_chunks())
            head = sink.getvalue().to_pybytes()
            put_bytes(_name(folder, stretch), struct.pack("<Q", len(head)) + head + pack(slot[codes]))
            del codes, block, docs
            raw = words.cast(pa.binary()).to_pylist()
            bucket = np.fromiter((crc32(w) % buckets for w in raw), np.int64, len(raw))
            by = np.argsort(bucket, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(bucket[by])) + 1).tolist(), len(raw)]  # without words one empty row, for the documents
            packed, places = [], []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = sorted(by[a:b].tolist(), key=raw.__getitem__)
                packed.append(pack_words([raw[k] for k in own], slot[own]))
                places.append(int(bucket[own[0]]) if own else 0)
            yield pa.record_batch([pa.array(places, pa.int32()), pa.array([stretch] * len(packed), pa.int64()), pa.array(packed, pa.binary())], names=["bucket", "stretch", "words"])
            del words, raw, packed, slot, order
            trim()

    return run


def _encoded(shared, pattern: str, most: int):
    """Stage 2: rows come sorted by bucket, and a bucket's words are encoded once each.

    What is kept is one bucket's words; should it have more than ``most`` distinct ones, they are forgotten and the count begins anew,
    so memory is bounded whatever the corpus, and a few words are encoded again.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        one, known, now = piece_encoder(shared, pattern), {}, None
        for batch in batches:
            for bucket, stretch, packed in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if bucket != now or len(known) > most:
                    known, now = {}, bucket
                words, slots = unpack_words(packed)
                for w in words:
                    if w not in known:
                        known[w] = np.asarray(one(w), "<u4").tobytes()
                ids = [known[w] for w in words]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                yield pa.record_batch([pa.array([stretch]), pa.array([pack(slots, sizes, np.frombuffer(b"".join(ids), "<u4"))], pa.binary())], names=["stretch", "ids"])
        del known
        trim()

    return run


def _assembled(folder: str, stretch: int, packed: list[bytes], step: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, row key, ids) of a stretch: the ids of its words at the words' positions."""
    data = get_bytes(_name(folder, stretch))
    size = struct.unpack_from("<Q", data)[0]
    docs = pa.ipc.open_stream(data[8 : 8 + size]).read_all()
    codes = unpack(data[8 + size :])[0]
    del data
    slots, sizes, flat = (np.concatenate(x) for x in zip(*map(unpack, packed), strict=True))
    order = np.argsort(slots)
    if len(order) and (slots[order] != np.arange(len(order))).any() or len(codes) and int(codes.max()) >= len(order):
        raise ValueError(f"stretch {stretch} lacks some of its words")
    flat, sizes = ragged(flat.astype(np.int32), starts_of(sizes.astype(np.int64)), order)
    bounds = starts_of(sizes)
    ends, first = starts_of(docs.column("n").to_numpy()), 0
    while first < docs.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + step, side="right")) - 1)
        own, per_piece = ragged(flat, bounds, codes[ends[first] : ends[last]].astype(np.int64))
        cuts = starts_of(per_piece)[ends[first : last + 1] - ends[first]]
        part = docs.slice(first, last - first).combine_chunks()
        lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(own))
        yield pa.record_batch([part.column(0).combine_chunks(), part.column(1).combine_chunks(), lists], names=["doc_id", KEY, "ids"])
        first = last


def _by_stretch(folder: str, finish, step: int):
    """Stage 3: the rows of a stretch stand side by side; ``finish`` takes each batch of its documents, about ``step`` pre-tokens."""

    def run(batches: Iterator[pa.RecordBatch]):
        now, packed = None, []
        for batch in batches:
            for stretch, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now is not None and stretch != now:
                    yield from map(finish, _assembled(folder, now, packed, step))
                    packed = []
                    trim()
                now = stretch
                packed.append(words)
        if now is not None:
            yield from map(finish, _assembled(folder, now, packed, step))
        del packed
        trim()

    return run


def _encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str, text_col: str, finish, schema: str) -> DataFrame:
    spark = docs.sparkSession
    shared, folder = spark.sparkContext.broadcast(ranks), scratch(spark, "stretches")
    rows = picked(docs, id_col, text_col)
    buckets = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * rows.rdd.getNumPartitions())
    words = rows.mapInArrow(_stretches(folder, pattern, BLOCK_BYTES, buckets), "bucket int, stretch long, words binary")
    ids = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_encoded(shared, pattern, KNOWN), "stretch long, ids binary")
    return ids.repartition("stretch").sortWithinPartitions("stretch").mapInArrow(_by_stretch(folder, finish, STEP), schema)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the row key and ids, the tokens of each match of ``pattern``.

    A null or empty text has no ids. Ids may be null or repeat; each row is encoded by itself. An empty table gives no rows. Other
    columns are ignored. A text has to fit into a worker's memory. A word that is in all stretches is one row in each.
    """
    return _encode(docs, ranks, pattern, id_col, text_col, lambda batch: batch, f"doc_id long, {KEY} long, ids array<int>")


def token_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    """The token-byte table: the bytes of each id, empty where there is none."""
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for word, rank in ranks.items():
        table[rank] = word
    return table


def joined_bytes(lists: pa.Array, known: pa.Array) -> tuple[pa.Buffer, np.ndarray]:
    """What ``known`` has for each id, end to end, and where each list's part starts. An id that ``known`` lacks is an error."""
    flat = lists.flatten()
    if len(flat) and (flat.null_count or pc.min(flat).as_py() < 0):
        raise ValueError("an id below 0 or null")
    pieces = known.take(flat)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(pieces):
        return pa.py_buffer(b""), np.zeros(len(lists) + 1, np.int32)
    # what was taken lies end to end already; only the lists' bounds are new
    _, bounds, body = pieces.buffers()
    return body or pa.py_buffer(b""), np.frombuffer(bounds, np.int32, len(pieces) + 1)[starts_of(lengths)]


def decode(tokens: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids") -> DataFrame:
    """``tokens`` with ``decoded``, the bytes of its ids: each id is joined with the token-byte table by its number.

    The table is the small side of a broadcast join, at most ``VOCABULARY`` rows. The bytes may end inside a character. Null or empty
    ids decode to no bytes. An id that the table lacks raises an error. A column ``decoded`` of ``tokens`` is replaced, others stay.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(token_bytes(ranks))
    name = "__pg_ids" if ids_col != "__pg_ids" else "__pg_ids2"

    def run(batches: Iterator[pa.RecordBatch]):
        known = pa.array(shared.value, pa.binary())
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                body, cuts = joined_bytes(part.column(part.num_columns - 1), known)
                out = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(np.ascontiguousarray(cuts)), body])
                yield pa.record_batch([*part.columns[:-1], out], names=[*part.schema.names[:-1], "decoded"])
                del out, body
            trim()

    from pyspark.sql import types as T

    kept = [c for c in tokens.columns if c != "decoded"]
    schema = T.StructType([*(tokens.schema[c] for c in kept), T.StructField("decoded", T.BinaryType())])
    return tokens.select(*kept, F.col(f"`{ids_col}`").alias(name)).mapInArrow(run, schema)


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): hex digests of the decimal ids, joined by one space, and of the decoded bytes."""
    text = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``digests`` of the decoded encoding of each document, for the same tables as ``encode``.

    Assembling, decoding and both digests of a stretch are done by one worker, so ids and bytes never pass through the JVM.
    """
    shared = docs.sparkSession.sparkContext.broadcast(token_bytes(ranks))
    tables: dict[str, pa.Array] = {}

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not tables:
            tables["bytes"] = pa.array(shared.value, pa.binary())
            tables["decimal"] = pa.array([b"%d " % k for k in range(len(shared.value))], pa.binary())
        lists, sums = batch.column(2), {}
        for name, cut in (("decimal", 1), ("bytes", 0)):  # the blank after a document's last id doesn't count
            body, cuts = joined_bytes(lists, tables[name])
            view = memoryview(body)
            sums[name] = [hashlib.sha256(view[a : max(a, b - cut)]).hexdigest() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        n = pc.list_value_length(lists).cast(pa.int64())
        return pa.record_batch([batch.column(0), n, pa.array(sums["decimal"]), pa.array(sums["bytes"])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _encode(docs, ranks, pattern, id_col, text_col, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
