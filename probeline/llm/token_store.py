"""Token ids in files of directly addressable codes."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from probeline.functions.ordering import running_sum
from probeline.llm.common import batch, lean, slices, stored, utf8
from probeline.llm.files import read_files, write_file
from probeline.session import parallelism

MAGIC = b"DACTOK01"
CHUNK_BITS = 8
#: Bits of a continuation bitmap for each entry of its rank directory.
RANK_BITS = 512
#: Tokens after which a file is closed.
FILE_TOKENS = 2_000_000
#: Distinct pieces of text whose ids a worker remembers.
REMEMBERED = 500_000
#: Bytes of text encoded at once.
ENCODED_BYTES = 4 << 20
_UNUSUAL = re.compile(r"\s\s|[^\S \n]|\x00")
_BLANK = np.zeros(256, bool)
_BLANK[[0x0A, 0x20]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_OTHER = ~_LETTER
_OTHER[128:] = False
#: Control bytes other than a line break, and lead bytes of characters among which some are white space.
_DOUBTFUL = np.zeros(256, bool)
_DOUBTFUL[[*range(0x0A), *range(0x0B, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True


def doubtful(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that may hold white space other than single blanks; all that do are among them."""
    blank = _BLANK[data]
    marks = _DOUBTFUL[data]
    marks[1:] |= blank[1:] & blank[:-1]
    before = np.concatenate(([0], np.cumsum(marks)))
    return before[offsets[1:]] > before[offsets[:-1]]


class Codes:
    """Ids split into chunks of 8 bits, lowest first. At each level a bit says whether the id goes on at the next
    one, and the rank directory counts those bits before each block, so any id is read without the others."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.levels = levels

    @classmethod
    def of(cls, ids: np.ndarray) -> Codes:
        levels, rest = [], ids.astype(np.uint32)
        while len(rest) or not levels:
            more = (rest >> CHUNK_BITS) > 0
            bitmap = np.packbits(more, bitorder="little")
            bitmap = np.concatenate((bitmap, np.zeros(-len(bitmap) % (RANK_BITS // 8), np.uint8)))
            ones = np.bitwise_count(bitmap).reshape(-1, RANK_BITS // 8).sum(axis=1)
            rank = np.zeros(len(ones) + 1, np.uint32)
            np.cumsum(ones, out=rank[1:])
            levels.append(((rest & 0xFF).astype(np.uint8), bitmap, rank))
            rest = rest[more] >> CHUNK_BITS
        return cls(levels)

    def take(self, positions: np.ndarray) -> np.ndarray:
        """The ids at ``positions``, by one rank query a level."""
        out = np.zeros(len(positions), np.uint32)
        slot, at = np.arange(len(positions)), np.asarray(positions, np.int64)
        for level, (chunks, bitmap, rank) in enumerate(self.levels):
            out[slot] |= chunks[at].astype(np.uint32) << np.uint32(level * CHUNK_BITS)
            more = (bitmap[at >> 3] >> (at & 7) & 1).astype(bool)
            slot, at = slot[more], at[more]
            if not len(slot):
                break
            words, block = bitmap.view("<u8"), at // RANK_BITS
            ones = rank[block].astype(np.int64)
            for k in range(RANK_BITS // 64):  # whole words of the block before the bit, then part of its own
                word = block * (RANK_BITS // 64) + k
                left = np.clip(at - word * 64, 0, 64)
                mask = np.where(left == 64, ~np.uint64(0), (np.uint64(1) << (left % 64).astype(np.uint64)) - np.uint64(1))
                ones += np.bitwise_count(words[word] & mask)
            at = ones
        return out

    def all(self) -> np.ndarray:
        ids = np.zeros(0, np.uint32)
        for chunks, bitmap, _ in reversed(self.levels):
            more = np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)
            here = chunks.astype(np.uint32)
            here[more] |= ids << np.uint32(CHUNK_BITS)
            ids = here
        return ids


def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The bytes of one file: header, document ids, token starts, then each level."""
    codes = Codes.of(ids)
    starts = np.zeros(len(lengths) + 1, "<i8")
    np.cumsum(lengths, out=starts[1:])
    arrays = [
        np.array([0 if d is None else d for d in doc_ids], "<i8"),
        np.array([d is None for d in doc_ids], np.uint8),
        starts,
    ]
    for chunks, bitmap, rank in codes.levels:
        arrays += [chunks, bitmap, rank.astype("<u4")]
    header = json.dumps([[a.dtype.str, len(a)] for a in arrays]).encode()
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), header, *[a.tobytes() for a in arrays]])


def unpack(payload: bytes) -> tuple[list[int | None], np.ndarray, Codes]:
    """Document ids, token starts and codes of a file."""
    if payload[:8] != MAGIC:
        raise ValueError("not a token file")
    at = 12 + int.from_bytes(payload[8:12], "little")
    arrays = []
    for kind, n in json.loads(payload[12:at]):
        arrays.append(np.frombuffer(payload, kind, n, at))
        at += arrays[-1].nbytes
    if at != len(payload):
        raise ValueError("token file of a wrong length")
    own, missing, starts, *rest = arrays
    ids = [None if gone else int(d) for d, gone in zip(own, missing)]
    return ids, starts, Codes([tuple(rest[k : k + 3]) for k in range(0, len(rest), 3)])


class Encoder:
    """Texts to 32-bit ids with a byte-level BPE tokenizer.

    A pre-token never spans the place before a single blank, nor that between a letter and what is none, so such a
    text is cut before blanks and after runs of ASCII letters, on its bytes, and each distinct piece is encoded once; a
    text's ids are gathered from the table of known pieces. Texts with other white space are encoded whole.

    With ``added_tokens`` the content of an added token, such as an end of text, becomes that token wherever a text
    holds it, as is the library's default; such texts are encoded whole, too. Else it is read as plain text.
    """

    def __init__(self, path: str, added_tokens: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        contents = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = contents if added_tokens else []
        self.widths = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, at in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.widths[at] = len(token)  # one character per byte
        self._forget()

    def _forget(self) -> None:
        """Known pieces by their place in the table: piece k has the ids from ``starts[k]`` to ``starts[k + 1]``."""
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def _encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        for low in range(0, len(texts), 10_000):
            for found in self.tokenizer.encode_batch_fast(texts[low : low + 10_000], add_special_tokens=False):
                yield np.array(found.ids, np.uint32)

    def _learn(self, pieces: list[bytes]) -> None:
        """Pieces that begin with a blank are encoded in one go and told apart by the bytes their tokens stand for."""
        if not pieces:
            return
        joined = [p for p in pieces if len(p) > 1 and p[0] in b" \n"]
        others = [p for p in pieces if not (len(p) > 1 and p[0] in b" \n")]
        streams = list(self._encode([p.decode() for p in others]))
        lengths = [np.array([len(ids) for ids in streams], np.int64)]
        for low in range(0, len(joined), 20_000):
            own = joined[low : low + 20_000]
            (ids,) = self._encode([b"".join(own).decode()])
            ends = np.cumsum([len(p) for p in own])
            cuts = np.searchsorted(np.cumsum(self.widths[ids]), ends) + 1
            streams.append(ids)
            lengths.append(np.diff(cuts, prepend=0))
        for piece in others + joined:
            self.known[piece] = len(self.known)
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(np.concatenate(lengths))))
        self.ids = np.concatenate((self.ids, *streams))

    def _whole(self, texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts that can't be cut."""
        whole = np.zeros(len(texts), bool)
        for k in np.flatnonzero(doubtful(data, offsets)):
            whole[k] = _UNUSUAL.search(texts[k].as_py() or "") is not None
        for content in self.added:
            held = pc.fill_null(pc.match_substring(texts, content), False)
            whole |= held.to_numpy(zero_copy_only=False)
        return whole

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        data, offsets = utf8(texts)
        n = len(texts)
        whole = self._whole(texts, data, offsets)
        cut = _BLANK[data]
        cut[1:] |= _OTHER[data[1:]] & _LETTER[data[:-1]]
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        if whole.any():
            cut[np.repeat(whole, np.diff(offsets))] = False
        starts = np.flatnonzero(cut)
        row = np.searchsorted(offsets, starts, "right") - 1
        if whole.any():  # a piece reaches to the next one, or to the end of its row
            ends = np.minimum(np.append(starts[1:], len(data)), offsets[row + 1])
            kept = data[np.repeat(~whole, np.diff(offsets))]
        else:
            ends, kept = np.append(starts[1:], len(data)), data
        at = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(ends - starts, out=at[1:])
        coded = pa.Array.from_buffers(
            pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(kept))]
        ).dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        if len(self.known) + len(pieces) > REMEMBERED:
            self._forget()
        self._learn([p for p in pieces if p not in self.known])
        places = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        places = places[coded.indices.to_numpy(zero_copy_only=False)]
        low, size = self.starts[places], self.starts[places + 1] - self.starts[places]
        ids = self.ids[_ranges(low, size)]
        lengths = np.bincount(row, weights=size, minlength=n).astype(np.int64)
        if whole.any():
            own = dict(zip(np.flatnonzero(whole).tolist(), self._encode(texts.filter(pa.array(whole)).to_pylist())))
            parts = np.split(ids, np.cumsum(lengths)[:-1])
            parts = [own.get(k, part) for k, part in enumerate(parts)]
            ids, lengths = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, lengths


def _ranges(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``low, low + 1, ...`` for ``size`` steps, one row after another."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(low - (ends - size), size)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, added_tokens: bool = False) -> Encoder:
    if (path, added_tokens) not in _ENCODERS:
        _ENCODERS[path, added_tokens] = Encoder(path, added_tokens)
    return _ENCODERS[path, added_tokens]


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, added_tokens: bool = False
) -> DataFrame:
    """Encode all documents in ascending ``doc_id`` into files of ``folder``; one row per file:
    ``part, seq, name, n_docs, n_tokens, start`` (ids in all files before it).

    Rows are ranged by id and, among equal ids, by text; nulls come first. A null or empty text gives the end id
    alone. ``added_tokens`` says whether texts may hold such. A task holds one slice of texts and one open file. Other
    columns are ignored.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    keys = ["doc_id", "h"]
    ordered = keyed.repartitionByRange(parallelism(docs.sparkSession), *keys).sortWithinPartitions(*keys)
    schema = pa.schema(
        [("part", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, end = TaskContext.get().partitionId(), 0, np.uint32(end_id)
        own: list[int | None] = []
        lengths: list[int] = []
        streams: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal seq
            name = f"tokens-{part:06d}-{seq:06d}.dac"
            write_file(folder, name, pack(own, lengths, np.concatenate(streams)))
            row = {"part": [part], "seq": [seq], "name": [name], "n_docs": [len(own)], "n_tokens": [sum(lengths)]}
            seq += 1
            for kept in (own, lengths, streams):
                kept.clear()
            return batch(row, schema)

        for rows in batches:
            _, offsets = utf8(rows.column("text"))
            for low, high in slices(offsets, ENCODED_BYTES):
                cut = rows.slice(low, high - low)
                ids, sizes = encoder(tokenizer, added_tokens).encode(cut.column("text"))
                ends = np.cumsum(sizes)
                ids = np.insert(ids, ends, end)  # the end id behind each document's own
                sizes, ends = sizes + 1, ends + np.arange(1, len(ends) + 1)
                docs_of = cut.column("doc_id").to_pylist()
                first, done = 0, 0
                while first < len(docs_of):  # documents up to the one that fills the open file
                    last = min(int(np.searchsorted(ends, done + FILE_TOKENS - held)), len(docs_of) - 1) + 1
                    own += docs_of[first:last]
                    lengths += sizes[first:last].tolist()
                    streams.append(ids[done : ends[last - 1]])
                    held += int(ends[last - 1]) - done
                    first, done = last, int(ends[last - 1])
                    if held >= FILE_TOKENS:
                        yield close()
                        held = 0
        if own:
            yield close()

    files = stored(
        ordered.mapInArrow(lean(write), "part int, seq int, name string, n_docs bigint, n_tokens bigint"), "token_files"
    )
    ends = running_sum(files, [], ["part", "seq"], "part", "n_tokens", "end")
    return ends.select("part", "seq", "name", "n_docs", "n_tokens", (F.col("end") - F.col("n_tokens")).alias("start"))


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document in the files: ``name, doc_id, offset, n_tokens, ids_crc32`` and, if asked, ``ids``."""
    fields = [("name", pa.string()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * with_ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for name, content in zip(rows.column("name"), rows.column("content")):
                own, starts, codes = unpack(content.as_py())
                ids = codes.all().astype("<u4")
                cuts = [ids[a:b] for a, b in zip(starts[:-1], starts[1:])]
                columns = {
                    "name": [name.as_py()] * len(own),
                    "doc_id": own,
                    "offset": starts[:-1],
                    "n_tokens": np.diff(starts),
                    "ids_crc32": [zlib.crc32(c) for c in cuts],
                }
                if with_ids:
                    columns["ids"] = [c.astype(np.int64) for c in cuts]
                yield batch(columns, schema)

    ddl = "name string, doc_id bigint, offset bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    return read_files(spark, folder).mapInArrow(lean(read), ddl)
