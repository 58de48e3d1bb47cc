"""Groups of spelling variants: words one inserted, deleted or replaced letter apart.

The edits of every word are generated and looked up in blocked Bloom filters, one per word length, which tasks hold
in turns of at most ``TURN_BYTES``. Only edits that a filter knows are shuffled, to an exact join with the
vocabulary. Each pair is generated once: from the longer word by deletion, else from the word with the smaller letter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from probeline.llm.common import mixed, parts_for, slices, stored, utf8
from probeline.session import parallelism

LEAST_LETTERS = 7
LEAST_COUNT = 2
#: One distinct (document, word) in so many loses a letter, by the checksum of both.
DAMAGE = 31
#: A form's count is at least so many times the word's.
FORM_TIMES = 10
#: Filters: bits per word, bytes of one stored part, and bytes that tasks hold at once.
BITS_PER_WORD = 16
PART_BYTES = 1 << 20
TURN_BYTES = 64 << 20
#: Words of this length and more share filters by their length modulo this number.
LENGTHS = 64
#: Edits looked up at once.
PROBES = 1 << 20

_BLOCK = 8  # words of 64 bits
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)
_COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64())])
_EDITS = pa.schema([("edit", pa.string()), ("word", pa.string()), ("n", pa.int64())])
_KEYS = pa.schema([("part", pa.int64()), ("h", pa.int64())])
_PARTS = pa.schema([("part", pa.int64()), ("bits", pa.binary())])


def letter_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` with A-Z in lower case: a code per run, the distinct runs, the row of each."""
    lead = data == 0xC3
    word = _LETTER[data] | lead
    word[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word & (edge[:-1] | np.concatenate(([True], ~word[:-1]))))
    ends = np.flatnonzero(word & (edge[1:] | np.concatenate((~word[1:], [True])))) + 1
    at = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=at[1:])
    array = pa.Array.from_buffers(
        pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(_LOWER[data[word]]))]
    ).dictionary_encode()
    return array.indices.to_numpy(zero_copy_only=False), array.dictionary, np.searchsorted(offsets, starts, "right") - 1


def _checksums(states: np.ndarray, data: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Checksum of each string of ``data`` carried on from ``states``."""
    order = np.argsort(-sizes, kind="stable")
    crc, at, sizes = ~states[order], begin[order], sizes[order]
    n = len(order)
    for k in range(int(sizes[0]) if n else 0):
        while n and sizes[n - 1] <= k:
            n = int(np.searchsorted(-sizes, -k))
        crc[:n] = _CRC[(crc[:n] ^ data[at[:n] + k]) & 255] ^ (crc[:n] >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = ~crc
    return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        data, offsets = utf8(rows.column(1))
        ids = rows.column(0).to_pylist()
        for low, high in slices(offsets):
            at = offsets[low : high + 1] - offsets[low]
            codes, words, of = letter_words(data[offsets[low] : offsets[high]], at)
            if not len(codes):
                continue
            n = len(words)
            pairs, times = np.unique(of * n + codes, return_counts=True)
            row, code = pairs // n, pairs % n
            letters, begins = utf8(words.cast(pa.binary()))
            sizes = np.diff(begins)
            length = sizes - np.add.reduceat(np.append(letters == 0xC3, False), begins[:-1])
            prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids[low:high]], np.uint32)
            crc = _checksums(prefix[row], letters, begins[code], sizes[code])
            hit = crc % DAMAGE == 0
            counts = np.bincount(code[~hit], times[~hit], n).astype(np.int64)
            keep = np.flatnonzero((counts > 0) & (length >= LEAST_LETTERS))
            out, out_n = words.take(pa.array(keep)).cast(pa.string()).to_pylist(), counts[keep].tolist()
            hit &= length[code] > LEAST_LETTERS
            cut = (crc[hit] % length[code[hit]]).tolist()
            for word, k, times_ in zip(words.take(pa.array(code[hit])).cast(pa.string()).to_pylist(), cut, times[hit].tolist()):
                out.append(word[:k] + word[k + 1 :])
                out_n.append(times_)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(out_n, pa.int64())], schema=_COUNTED)


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n`` of the words of at least ``LEAST_LETTERS`` letters that occur ``LEAST_COUNT`` times, after the damage."""
    rows = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    counted = rows.mapInArrow(_count_words, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _values(low: int, high: int) -> np.ndarray:
    """A random number for each letter at each of the places."""
    return mixed(np.arange(low * 256, high * 256, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)).reshape(-1, 256)


def word_hashes(letters: np.ndarray) -> np.ndarray:
    """Hash of each row of a matrix of letters: an XOR over its places, so an edit changes it in few steps."""
    out = np.zeros(len(letters), np.uint64)
    for k in range(0, letters.shape[1], 256):
        values = _values(k, min(k + 256, letters.shape[1]))
        for j in range(len(values)):
            out ^= values[j][letters[:, k + j]]
    return out


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of letters) for each length, in parts that keep the number of edits small."""
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        most = max(1, PROBES // size)
        for low in range(0, len(rows), most):
            part = rows[low : low + most]
            text = "".join(words[k] for k in part).encode("latin-1")
            yield part, np.frombuffer(text, np.uint8).reshape(-1, size)


class Filters:
    """Blocked Bloom filters, one after another in one row of parts. A word sets one bit in each of the eight 64-bit
    words of its block."""

    def __init__(self, counts: dict[int, int]):
        self.first, self.blocks, at = {}, {}, 0
        for shard in sorted(counts):
            self.first[shard] = at
            self.blocks[shard] = max(1, -(-counts[shard] * BITS_PER_WORD // (64 * _BLOCK)))
            at += self.blocks[shard]
        self.total = at

    @staticmethod
    def shard(length: int) -> int:
        return length if length < LENGTHS else LENGTHS + length % LENGTHS

    def places(self, length: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block of each hash, and the rest of the hash. Words of an unknown length have none."""
        shard, h = self.shard(length), mixed(hashes ^ np.uint64(length))
        n = np.uint64(self.blocks[shard])
        return (((h >> np.uint64(32)) * n) >> np.uint64(32)).astype(np.int64) + self.first[shard], mixed(h)


_PART_BLOCKS = PART_BYTES // (8 * _BLOCK)


def _filter_keys(filters: Filters):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for _, letters in _by_length(rows.column(0).to_pylist()):
                block, rest = filters.places(letters.shape[1], word_hashes(letters))
                # a block's number within its part fits 14 bits, beside 48 bits that pick the block's bits
                h = (block % _PART_BLOCKS << 48) | (rest & np.uint64((1 << 48) - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(block // _PART_BLOCKS), pa.array(h)], schema=_KEYS)

    return keys


def _fill_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, bits = None, None
    for rows in batches:
        parts, h = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        cuts = np.flatnonzero(parts[1:] != parts[:-1]) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(parts)]):
            if low == high:
                continue
            if parts[low] != part:
                if part is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([bits.tobytes()], pa.binary())], schema=_PARTS)
                part, bits = int(parts[low]), np.zeros(PART_BYTES // 8, np.uint64)
            block = h[low:high] >> 48
            for j in range(_BLOCK):
                bit = np.uint64(1) << ((h[low:high] >> 6 * j) & 63).astype(np.uint64)
                np.bitwise_or.at(bits, block * _BLOCK + j, bit)
    if part is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([bits.tobytes()], pa.binary())], schema=_PARTS)


def _known(bits: np.ndarray, low: int, high: int, block: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Which of the hashes the filters of the blocks ``[low, high)`` know."""
    at = np.flatnonzero((block >= low) & (block < high))
    for j in range(_BLOCK):
        word = bits[(block[at] - low) * _BLOCK + j]
        at = at[(word >> ((rest[at] >> np.uint64(6 * j)) & np.uint64(63))) & np.uint64(1) == 1]
    return at


def _edits_of(letters: np.ndarray, alphabet: list[int], filters: Filters, known) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(row, place, letter) of known edits of words of one length; letter -1 deletes."""
    size = letters.shape[1]
    own = word_hashes(letters)
    step = max(1, PROBES // len(letters))
    if filters.shard(size) in filters.blocks:
        for low in range(0, size, step):
            values = _values(low, min(size, low + step))
            part = letters[:, low : low + step]
            without = own[:, None] ^ values[np.arange(part.shape[1]), part]
            for letter in alphabet:
                row, place = np.nonzero(part < letter)
                at = known(*filters.places(size, without[row, place] ^ values[place, letter]))
                yield row[at], place[at] + low, letter
    if size > LEAST_LETTERS and filters.shard(size - 1) in filters.blocks:
        head, tail = np.zeros(len(letters), np.uint64), np.zeros(len(letters), np.uint64)
        for k in range(0, size, 256):  # all later letters, each one place to the left
            values = _values(max(k - 1, 0), min(size, k + 256) - 1) if k else _values(0, min(size, 256) - 1)
            for j in range(max(k, 1), min(size, k + 256)):
                tail ^= values[j - 1 - max(k - 1, 0)][letters[:, j]]
        for k in range(0, size, 256):
            values = _values(max(k - 1, 0), min(size, k + 256))
            base = max(k - 1, 0)
            for j in range(k, min(size, k + 256)):
                if j:
                    tail ^= values[j - 1 - base][letters[:, j]]
                    head ^= values[j - 1 - base][letters[:, j - 1]]
                # of a run of one letter only the last place
                row = np.flatnonzero(letters[:, j] != letters[:, j + 1]) if j + 1 < size else np.arange(len(letters))
                at = known(*filters.places(size - 1, head[row] ^ tail[row]))
                yield row[at], np.full(len(at), j), -1


def _known_edits(filters: Filters, alphabet: list[int], bits, first: int):
    """Edits of words that the filters from block ``first`` on know."""

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits.value, np.uint64)
        last = first + len(table) // _BLOCK
        for rows in batches:
            words, counts = rows.column(0).to_pylist(), rows.column(1).to_pylist()
            for part, letters in _by_length(words):
                out, source = [], []
                for row, place, letter in _edits_of(letters, alphabet, filters, lambda b, r: _known(table, first, last, b, r)):
                    for r, k in zip(part[row].tolist(), place.tolist()):
                        word = words[r]
                        out.append(word[:k] + (chr(letter) if letter >= 0 else "") + word[k + 1 :])
                        source.append(r)
                    if len(out) > 50_000:
                        yield _edit_rows(out, source, words, counts)
                        out, source = [], []
                yield _edit_rows(out, source, words, counts)

    return edits


def _edit_rows(out: list[str], source: list[int], words: list[str], counts: list[int]) -> pa.RecordBatch:
    columns = [out, [words[r] for r in source], [counts[r] for r in source]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _EDITS)], schema=_EDITS)


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n`` for every ordered pair of near words of ``words`` (``word, n``, each word once)."""
    spark = words.sparkSession
    length = F.char_length("word")
    shard = F.when(length < LENGTHS, length).otherwise(LENGTHS + length % LENGTHS)
    counts = {r[0]: r[1] for r in words.groupBy(shard.alias("s")).count().collect()}  # at most 2 * LENGTHS rows
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct()
    alphabet = sorted(ord(r[0]) for r in letters.collect() if r[0])  # at most 90 letters
    filters = Filters(counts)
    keyed = words.select("word").mapInArrow(_filter_keys(filters), "part long, h long")
    n_parts = -(-filters.total // _PART_BLOCKS)
    # parts get their own partitions by range: hashing few numbers would leave some partitions with several
    filled = keyed.repartitionByRange(parts_for(n_parts, 4, 1), "part").sortWithinPartitions("part")
    parts = stored(filled.mapInArrow(_fill_parts, "part long, bits binary"), "filter_parts")
    pairs, each = None, max(1, TURN_BYTES // PART_BYTES)
    for low in range(0, n_parts, each):
        high = min(n_parts, low + each)
        held = {r["part"]: r["bits"] for r in parts.where(F.col("part").between(low, high - 1)).collect()}  # TURN_BYTES at most
        bits = spark.sparkContext.broadcast(b"".join(bytes(held.get(k, bytes(PART_BYTES))) for k in range(low, high)))
        spread = words.repartition(parallelism(spark))
        edits = spread.mapInArrow(_known_edits(filters, alphabet, bits, low * _PART_BLOCKS), "edit string, word string, n long")
        vocabulary = words.selectExpr("word AS edit", "n AS edit_n")
        turn = stored(edits.join(vocabulary, "edit"), "near_words")
        bits.unpersist()
        pairs = turn if pairs is None else pairs.union(turn)
    if pairs is None:
        return words.selectExpr("word", "n", "word AS near", "n AS near_n").limit(0)
    return pairs.selectExpr("word", "n", "edit AS near", "edit_n AS near_n").union(pairs.select("edit", "edit_n", "word", "n"))


def _roots(links: DataFrame) -> DataFrame:
    """``word, root``: where the forms from each word end. A form is at least ``FORM_TIMES`` as frequent as its word, so
    a path is short and never returns; each round doubles its length."""
    roots = links.selectExpr("word", "form AS root")
    while True:
        further = roots.selectExpr("word AS root", "root AS next")
        step = stored(roots.join(further, "root", "left").selectExpr("word", "coalesce(next, root) AS root", "next IS NOT NULL AS moved"), "roots")
        roots = step.select("word", "root")
        if step.where("moved").isEmpty():
            return roots


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the vocabulary of ``docs`` (``doc_id``, ``text``).

    A word's form is its most frequent near word (of equals the smallest) if that is ``FORM_TIMES`` as frequent; the
    root is where forms end. A null text has no words; a null ``doc_id`` counts as an empty one in the damage rule;
    repeated rows count again; an empty table gives none; other columns are not read. Words of any length are compared.
    """
    words = stored(count_words(docs), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    judged = words.join(near, "word", "left").selectExpr(
        "word", "n", "coalesce(n_near, 0L) AS n_near",
        f"CASE WHEN -best.less >= {FORM_TIMES} * n THEN best.near END AS form",
        f"CASE WHEN -best.less >= {FORM_TIMES} * n THEN -best.less END AS form_n",
    )
    judged = stored(judged, "forms")
    roots = _roots(judged.where("form IS NOT NULL").select("word", "form"))
    return judged.join(roots, "word", "left").selectExpr("word", "form", "coalesce(root, word) AS root", "n", "n_near", "form_n")
