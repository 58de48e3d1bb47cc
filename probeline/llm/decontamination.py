"""Benchmark passages in training texts, found with an FM-index per shard of texts."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from probeline.llm.common import DOCUMENT_COLUMNS, batch, lean, slices, utf8
from probeline.llm.fm_index import FmIndex

WINDOW = 10
#: Benchmark text of one pass; more is searched in further passes, so what tasks receive stays bounded.
BLOCK_BYTES = 16 << 20
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A-Z in lower case; bytes outside words become blanks. Bytes from 0x80 are word bytes, as all their characters are.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class Windows:
    """The distinct windows of some benchmark items, as word codes from 1, and the items each stands in."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int) -> None:
        self.code: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            words = [self.code.setdefault(w, len(self.code) + 1) for w in item_words(text)]
            for at in range(max(1, len(words) - window + 1) if words else 0):
                found.setdefault(tuple(words[at : at + window]), set()).add(item)
        self.items = [list(own) for own in found.values()]
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.patterns = np.zeros((len(found), max(window, 1)), np.int64)
        for row, own in zip(self.patterns, found):
            row[: len(own)] = own


def benchmark_blocks(benchmark: DataFrame, window: int) -> Iterator[Windows]:
    """The windows, in blocks of about ``BLOCK_BYTES`` of item text. A null or wordless item has none."""
    rows = benchmark.select("item_id", "text").where("text IS NOT NULL")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    for k in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield Windows([tuple(r) for r in block.collect()], window)


class Shard:
    """Texts whose words stand in one index; words the benchmark lacks are separators, a run of them only one."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, windows: Windows) -> None:
        folded = data.tobytes().translate(_FOLD)
        code = windows.code
        counts, parts = [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            words = folded[a:b].split()
            counts.append(len(words))
            parts += [code.get(w, 0) for w in words]
            parts.append(0)
        self.counts = np.array(counts, np.int64)
        symbols = np.array(parts, np.int32)
        doc = np.repeat(np.arange(len(counts)), self.counts + 1)
        keep = (symbols > 0) | np.concatenate(([False], symbols[:-1] > 0))
        self.at = np.flatnonzero(keep)  # of the index's symbols among all words and text ends
        self.symbols, self.doc, self.total = symbols[keep], doc, len(symbols)

    def hits(self, windows: Windows) -> tuple[np.ndarray, list[set[int]]]:
        """Words of each text inside an occurrence, as flags over all words, and the items found in each text."""
        cover = np.zeros(self.total + 1, np.int64)
        items: list[set[int]] = [set() for _ in self.counts]
        if len(self.symbols) and len(windows.items):
            index = FmIndex(self.symbols, len(windows.code))
            low, high = index.search(windows.patterns, windows.lengths)
            found = np.flatnonzero(high > low)
            for a in range(0, len(found), 4096):  # occurrences of a few patterns at a time
                own = found[a : a + 4096]
                size = high[own] - low[own]
                pattern = np.repeat(own, size)
                rows = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low[own], size)
                for b in range(0, len(rows), 1 << 20):
                    which = pattern[b : b + (1 << 20)]
                    start = self.at[index.locate(rows[b : b + (1 << 20)])]
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + windows.lengths[which], -1)
                    pairs = np.unique(self.doc[start] * len(windows.items) + which)
                    for doc, p in zip((pairs // len(windows.items)).tolist(), (pairs % len(windows.items)).tolist()):
                        items[doc].update(windows.items[p])
        return np.cumsum(cover)[:-1] > 0, items


def removal_spans(text: bytes, flags: np.ndarray) -> list[tuple[int, int]]:
    """Code points ``[start, end)`` of the merged runs of flagged words. The text must be in lower case already."""
    runs: list[list[int]] = []
    last = -2
    for k, word in enumerate(_WORD.finditer(text)):
        if flags[k]:
            if last == k - 1:
                runs[-1][1] = word.end()
            else:
                runs.append([word.start(), word.end()])
            last = k
    return [(len(text[:a].decode()), len(text[:b].decode())) for a, b in runs]


def _searched(rows: pa.RecordBatch, windows: Windows) -> Iterator[tuple[bytes, np.ndarray, set]]:
    """Each text in lower case, the hit flags of its words and the items found in it."""
    data, offsets = utf8(rows.column("text"))
    for low, high in slices(offsets):
        own = offsets[low : high + 1]
        piece, cuts = data[own[0] : own[-1]], own - own[0]
        shard = Shard(piece, cuts, windows)
        flags, items = shard.hits(windows)
        begin = np.concatenate(([0], np.cumsum(shard.counts + 1)))
        for k in range(high - low):
            yield piece[cuts[k] : cuts[k + 1]].tobytes().lower(), flags[begin[k] : begin[k + 1] - 1], items[k]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, item_ids`` (sorted as strings) and ``spans`` of each document.

    A window is ``window`` consecutive words of an item, or all words of a shorter one. Items without an id hit words
    but are not listed. Spans are the merged runs
    of hit words in code points. A null or empty text has no words; repeated rows are judged one by one; without
    items nothing is hit; other columns are ignored. Each slice of texts is a shard with an index of its own.
    """
    held = {"doc_id": "bigint", "text": "string", "flags": "binary", "item_ids": "array<string>"}
    made = {
        "doc_id": "bigint",
        "n_words": "bigint",
        "n_hit": "bigint",
        "item_ids": "array<string>",
        "spans": "array<struct<start:int,end:int>>",
    }
    spark = docs.sparkSession

    def one_pass(rows_in: DataFrame, windows: Windows, last: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(windows)  # at most a block of the benchmark

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                out: dict[str, list] = {name: [] for name in (made if last else held)}
                before = zip(rows.column("flags").to_pylist(), rows.column("item_ids").to_pylist())
                for (text, flags, items), (seen, known) in zip(_searched(rows, shared.value), before):
                    flags = flags | (np.frombuffer(seen, bool) if seen else False)
                    out["item_ids"].append(sorted({str(i) for i in items if i is not None} | set(known)))
                    if last:
                        out["n_words"].append(len(flags))
                        out["n_hit"].append(int(flags.sum()))
                        spans = removal_spans(text, flags) if flags.any() else []
                        out["spans"].append([{"start": a, "end": b} for a, b in spans])
                    else:
                        out["flags"].append(flags.tobytes())
                given = {name: rows.column(name) for name in ("doc_id", "text") if name in out}
                yield batch(out | given, schema)

        ddl = ", ".join(f"{name} {kind}" for name, kind in (made if last else held).items())
        schema = to_arrow_schema(spark.createDataFrame([], ddl).schema)
        return rows_in.mapInArrow(lean(search), ddl)

    rows = docs.select("doc_id", "text", F.lit(None).cast("binary").alias("flags"), F.array().cast("array<string>").alias("item_ids"))
    blocks = benchmark_blocks(benchmark, window)
    windows = next(blocks)
    for following in blocks:
        rows, windows = one_pass(rows, windows, False), following
    return one_pass(rows, windows, True)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The columns of documents with all benchmark passages cut out, ``n_chars`` counted anew.

    A cut leaves a line break. A document of which no word is left is dropped; documents without hits, null and
    empty ones included, stay as they are. Passes repeat until the joined edges of a cut hold no window either.
    """
    chosen = docs.select(*DOCUMENT_COLUMNS)

    def one_pass(rows_in: DataFrame, windows: Windows) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(windows)  # at most a block of the benchmark

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                texts, counts = rows.column("text").to_pylist(), rows.column("n_chars").to_pylist()
                todo, keep = np.arange(len(texts)), np.ones(len(texts), bool)
                while len(todo):
                    part = pa.RecordBatch.from_arrays([pa.array([texts[i] for i in todo], pa.string())], names=["text"])
                    again = []
                    for i, (text, flags, _) in zip(todo.tolist(), _searched(part, shared.value)):
                        if not flags.any():
                            continue
                        pieces, at = [], 0
                        for a, b in removal_spans(text, flags):
                            pieces.append(texts[i][at:a])
                            at = b
                        texts[i] = "\n".join([*pieces, texts[i][at:]])
                        counts[i] = len(texts[i])
                        keep[i] = not flags.all()
                        again.append(i)
                    todo = np.array(again, np.int64)
                new = {"text": pa.array(texts, rows.schema.field("text").type), "n_chars": pa.array(counts, pa.int64())}
                made = pa.RecordBatch.from_arrays(
                    [new.get(f.name, rows.column(f.name)) for f in rows.schema], names=rows.schema.names
                )
                yield made.filter(pa.array(keep))

        return rows_in.mapInArrow(lean(cut), chosen.schema)

    return reduce(one_pass, benchmark_blocks(benchmark, window), chosen)
