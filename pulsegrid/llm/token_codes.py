"""Token files of directly addressable codes, and the pre-tokens of a byte-level BPE vocabulary.

An id is split into chunks of eight bits. Level 0 holds the low chunk of every id; a continuation bitmap says which ids go on,
and level 1 holds the next chunk of those only, and so on. A rank directory over each bitmap gives an id's place on the next
level, so any token is read with one lookup per level and no block is decoded.

File: magic, then the counts (documents, tokens, levels), document ids, a flag for each id that is null, token offsets of the
documents, and for each level its length, chunks, bitmap words, rank of each 512-bit superblock and of each word in it. All
numbers are little-endian.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import OWN, blocks, get_bytes, picked, put_bytes, scratch, starts_of, trim, written

MAGIC = b"PGDAC001"
#: Tokens after which a new file begins.
TOKENS_PER_FILE = 8 << 20
#: Bytes of text that are tokenized together.
BLOCK_BYTES = 8 << 20
#: Words that a worker remembers the ids of, at most; about 60 MB.
REMEMBERED = 300_000

#: Letters, other numbers and white space below U+0250, for the quick form of the pattern. Fixed values of Unicode.
_L, _N, _S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
_BEYOND = re.compile("[ɐ-\U0010ffff]")


def splitter(pattern: str):
    """A function from a text to its pre-tokens, the matches of ``pattern``; texts below U+0250 take the same classes written out."""
    full = regex.compile(pattern)
    quick = re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_S}{_L}{_N}]").replace(r"\p{L}", f"[{_L}]").replace(r"\p{N}", f"[{_N}]").replace(r"\S", f"[^{_S}]").replace(r"\s", f"[{_S}]"))
    return lambda text: (full if _BEYOND.search(text) else quick).findall(text)


def coded(texts: list[str], split) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct pre-tokens of some texts, each pre-token's place among them, and the number of pre-tokens per text."""
    parts, held, n, lengths = [], [], 0, np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = split(text)
        lengths[k] = len(words)
        held += words
        if len(held) > 200_000:
            parts.append(pa.array(held, pa.string()))
            held = []
    parts.append(pa.array(held, pa.string()))
    found = pa.chunked_array(parts).combine_chunks().dictionary_encode()
    return found.dictionary, found.indices.to_numpy(), lengths


def ragged(values: np.ndarray, bounds: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``picks`` of ``values`` one after another, and each one's length."""
    lengths = (bounds[1:] - bounds[:-1])[picks]
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(bounds[:-1][picks] - (ends - lengths), lengths)
    return values[at], lengths


def _byte_letters() -> dict[int, int]:
    """The printable letter that byte-level vocabularies write for each byte: itself if visible, else the next one from U+0100."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: b for b in seen} | {b: 256 + k for k, b in enumerate(sorted({*range(256)} - {*seen}))}


class WordEncoder:
    """The ids of texts as a tokenizers file gives them without its post-processor; each distinct word of a block goes to the model once.

    The file's added tokens are found in the text first, as the library does, and have ids of their own. A text that has an added
    token with flags (normalized, single_word, lstrip or rstrip) goes to the library as a whole.
    """

    def __init__(self, vocabulary: str, pattern: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.model, self.letters, self.split, self.known = self.tokenizer.model, _byte_letters(), splitter(pattern), {}
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: k for k, t in added.items()}
        self.flagged = [t.content for t in added.values() if t.normalized or t.single_word or t.lstrip or t.rstrip]
        longest = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None

    def ids(self, word: str) -> bytes:
        """A pre-token's ids, 32 bits each."""
        held = self.known.get(word)
        if held is None:
            held = array("I", [t.id for t in self.model.tokenize(word.encode("utf-8").decode("latin-1").translate(self.letters))]).tobytes()
            if len(self.known) < REMEMBERED:
                self.known[word] = held
        return held

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        if not any(a in t for t in texts for a in self.added):
            return self._plain(texts)
        parts = [[t] if any(f in t for f in self.flagged) else self.cut.split(t) for t in texts]
        plain = [p for t in parts for p in t[::2] if not any(f in p for f in self.flagged)]
        flat, sizes = self._plain(plain)
        found = iter(np.split(flat, np.cumsum(sizes)[:-1]) if plain else ())
        out = [
            [np.array(self.tokenizer.encode(t[0], add_special_tokens=False).ids, np.uint32)] if any(f in t[0] for f in self.flagged) else [np.array([self.added[p]], np.uint32) if k % 2 else next(found) for k, p in enumerate(t)]
            for t in parts
        ]
        return np.concatenate([x for t in out for x in t]), np.array([sum(map(len, t)) for t in out], np.int64)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words, codes, lengths = coded(texts, self.split)
        taken = pa.array(map(self.ids, words.to_pylist()), pa.large_binary()).take(pa.array(codes))
        ends, data = taken.buffers()[1:]
        bounds = np.frombuffer(ends, np.int64, len(taken) + 1) // 4 if len(taken) else np.zeros(1, np.int64)
        ids = np.frombuffer(data, np.uint32, bounds[-1]) if bounds[-1] else np.zeros(0, np.uint32)
        return ids, np.diff(bounds[starts_of(lengths)])


_encoders: dict[tuple[str, str], WordEncoder] = {}


def encoder(vocabulary: str, pattern: str) -> WordEncoder:
    if (vocabulary, pattern) not in _encoders:
        _encoders.clear()
        _encoders[vocabulary, pattern] = WordEncoder(vocabulary, pattern)
    return _encoders[vocabulary, pattern]


class Codes:
    """The levels of some ids; ``Codes.of`` builds them, ``dump`` and ``load`` move them to and from bytes."""

    def __init__(self, n: int, levels: list[tuple[np.ndarray, ...]]):
        self.n, self.levels = n, levels

    @classmethod
    def of(cls, ids: np.ndarray) -> Codes:
        rest, levels = np.asarray(ids, np.uint32), []
        while True:
            more = rest > 255
            words = np.zeros(-(-len(rest) // 512) * 8 + 8, np.uint64)
            packed = np.packbits(more, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            counts = np.bitwise_count(words).astype(np.uint64)
            before = np.cumsum(counts) - counts
            levels.append(((rest & 255).astype(np.uint8), words, before[::8].copy(), (before - np.repeat(before[::8], 8)).astype(np.uint16)))
            rest = rest[more] >> 8
            if not len(rest):
                return cls(len(ids), levels)

    @staticmethod
    def rank(level: tuple[np.ndarray, ...], at: np.ndarray) -> np.ndarray:
        """How many ids before each place of ``at`` go on to the next level."""
        _, words, supers, subs = level
        at = np.asarray(at, np.uint64)
        word = at >> np.uint64(6)
        below = words[word] & ((np.uint64(1) << (at & np.uint64(63))) - np.uint64(1))
        return (supers[word >> np.uint64(3)] + subs[word] + np.bitwise_count(below)).astype(np.int64)

    def get(self, at) -> np.ndarray:
        """The ids at any places."""
        at = np.asarray(at, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError("a place beyond the tokens")
        out, rows = np.zeros(len(at), np.uint32), np.arange(len(at))
        for k, level in enumerate(self.levels):
            out[rows] |= level[0][at].astype(np.uint32) << np.uint32(8 * k)
            on = (level[1][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            if not on.any():
                break
            rows, at = rows[on], self.rank(level, at[on])
        return out

    def slice(self, start: int, end: int) -> np.ndarray:
        """The ids from ``start`` up to ``end``: a run on each level, found by two ranks."""
        out, rows = np.zeros(end - start, np.uint32), None
        for k, level in enumerate(self.levels):
            if start >= end:
                break
            part = level[0][start:end].astype(np.uint32) << np.uint32(8 * k)
            out = part if rows is None else out
            if rows is not None:
                out[rows] |= part
            first, last = start >> 6, ((end - 1) >> 6) + 1
            on = np.flatnonzero(np.unpackbits(level[1][first:last].view(np.uint8), bitorder="little")[start - 64 * first : end - 64 * first])
            start, end = self.rank(level, np.array([start, end]))
            rows = on if rows is None else rows[on]
        return out

    def dump(self) -> list[bytes]:
        out = [np.array([self.n, len(self.levels)], "<u8").tobytes()]
        for chunks, words, supers, subs in self.levels:
            out += [np.array([len(chunks), len(words)], "<u8").tobytes(), chunks.tobytes(), words.astype("<u8").tobytes(), supers.astype("<u8").tobytes(), subs.astype("<u2").tobytes()]
        return out

    @classmethod
    def load(cls, data: bytes, at: int = 0) -> Codes:
        n, count = np.frombuffer(data, "<u8", 2, at).tolist()
        at, levels = at + 16, []
        for _ in range(count):
            length, words = np.frombuffer(data, "<u8", 2, at).tolist()
            at += 16
            level = []
            for kind, size in (("<u1", length), ("<u8", words), ("<u8", words // 8), ("<u2", words)):
                level.append(np.frombuffer(data, kind, size, at))
                at += level[-1].nbytes
            levels.append(tuple(level))
        return cls(n, levels)


def dump_file(doc_ids: list[int | None], bounds: np.ndarray, ids: np.ndarray) -> bytes:
    head = [MAGIC, np.array([len(doc_ids)], "<u8").tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "<u1").tobytes(), np.asarray(bounds, "<u8").tobytes()]
    return b"".join([*head, *Codes.of(ids).dump()])


def load_file(data: bytes) -> tuple[list[int | None], np.ndarray, Codes]:
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    n = int(np.frombuffer(data, "<u8", 1, 8)[0])
    ids, null = np.frombuffer(data, "<i8", n, 16).tolist(), np.frombuffer(data, "<u1", n, 16 + 8 * n).tolist()
    bounds = np.frombuffer(data, "<u8", n + 1, 16 + 9 * n).astype(np.int64)
    return [None if z else i for i, z in zip(ids, null, strict=True)], bounds, Codes.load(data, 24 + 17 * n)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, per_file: int = TOKENS_PER_FILE) -> DataFrame:
    """Writes the documents' ids, in ascending order of doc_id, to files in ``path``; the stored manifest (part, seq, file, n_docs, n_tokens, base).

    ``base`` is the number of ids in all files before. A null text counts as empty and has the end id only. Null doc_ids come first;
    rows that repeat a doc_id stand side by side. An empty table gives no file. Other columns are ignored. A text has to fit into
    a worker's memory. A repeated task writes its files anew under the same names. ``vocabulary`` is the path of a tokenizers file,
    which the driver reads and broadcasts.
    """
    with open(vocabulary, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]):
        part, seq, doc_ids, lengths, held = TaskContext.get().partitionId(), 0, [], [], []

        def flush():
            nonlocal seq
            file = f"{path}/tokens-{part:06d}-{seq:05d}.dac"
            bounds = starts_of(np.concatenate(lengths))
            put_bytes(file, dump_file(doc_ids, bounds, np.concatenate(held)))
            row = pa.record_batch([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([file]), pa.array([len(doc_ids)], pa.int64()), pa.array([int(bounds[-1])], pa.int64())], names=["part", "seq", "file", "n_docs", "n_tokens"])
            seq += 1
            for x in (doc_ids, lengths, held):
                x.clear()
            trim()
            return row

        for block in blocks(batches, 1, BLOCK_BYTES):
            ids, sizes = encoder(shared.value, pattern).encode(block.column(1).to_pylist())
            held.append(np.insert(ids, np.cumsum(sizes), end_id))
            lengths.append(sizes + 1)
            doc_ids += block.column(0).to_pylist()
            if sum(map(len, held)) >= per_file:
                yield flush()
        if doc_ids:
            yield flush()

    rows = picked(docs, id_col, text_col).select(OWN + "id", OWN + "text").repartitionByRange(OWN + "id").sortWithinPartitions(OWN + "id")
    files = written(rows.mapInArrow(run, "part int, seq int, file string, n_docs long, n_tokens long"), "token-manifest")
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    parts = parts.select("part", F.coalesce(F.sum("all").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base0"))
    inside = F.coalesce(F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return files.join(parts, "part").select(*files.columns, (F.col("base0") + inside).alias("base"))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files that ``manifest`` lists."""
    import zlib

    def run(batches):
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, bounds, codes = load_file(get_bytes(file))
                sums = []
                for first in range(0, len(ids), 1000):
                    last = min(first + 1000, len(ids))
                    raw, cut = codes.slice(int(bounds[first]), int(bounds[last])).astype("<u4"), bounds[first : last + 1] - bounds[first]
                    sums += [zlib.crc32(raw[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(bounds[:-1] + base), pa.array(np.diff(bounds)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("file", "base").repartition(max(1, manifest.count()), "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocabulary: str, pattern: str, **columns) -> DataFrame:
    """Writes the documents' token files to the shared folder and reads them back."""
    return read_tokens(write_tokens(docs, scratch(docs.sparkSession, "tokens"), vocabulary, pattern, **columns))
