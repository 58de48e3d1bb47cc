"""N-best segmentation of texts into the pieces of a SentencePiece vocabulary, and back."""

from __future__ import annotations

import heapq
import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from probeline.llm.common import batch, lean, slices, utf8

BLANK = "▁"
#: No piece goes beyond these: a run of blanks begins one, a line break stands alone.
_UNIT = re.compile(f"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n")
#: Below the score of every piece, as for an unknown one.
BYTE_PENALTY = 10.0
#: Scores are whole multiples of one over this, so sums are exact and equal paths tie however they add up.
SCALE = 10**9
_NEVER = -(1 << 80)
#: Distinct units a worker remembers, and the longest that it does.
REMEMBERED = 800_000
REMEMBERED_LENGTH = 48


class Pieces:
    """Vocabulary with log scores. The file ranks pieces; a piece of rank r has probability proportional to
    1 / (r + 1), so scores add up like log probabilities whatever the file was trained as."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.edges: dict[str, tuple[int, int] | None] = {}  # None: only a beginning of pieces
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        ranked = []
        for at in range(size):
            text = model.id_to_piece(at)
            self.bytes_of.append(b"")
            if model.is_byte(at):
                value = int(text[3:5], 16)
                self.byte_ids[value] = at
                self.bytes_of[at] = bytes([value])
            elif not (model.is_control(at) or model.is_unknown(at) or model.is_unused(at)):
                self.bytes_of[at] = text.replace(BLANK, " ").encode()
                if not _UNIT.fullmatch(text):
                    raise ValueError(f"piece {text!r} has a blank or a line break behind other characters")
                ranked.append((-model.get_score(at), at, text))
        total = math.log(sum(1 / (k + 1) for k in range(len(ranked))))
        for rank, (_, at, text) in enumerate(sorted(ranked)):
            self.edges[text] = (at, round((-math.log(rank + 1) - total) * SCALE))
        for text in list(self.edges):
            for end in range(1, len(text)):
                self.edges.setdefault(text[:end])
        self.byte_score = round((-math.log(len(ranked)) - total - BYTE_PENALTY) * SCALE)
        self.known: dict[str, tuple[bytes, int, float]] = {}

    def lattice(self, unit: str) -> tuple[list[int], list[list[tuple[int, int, tuple[int, ...]]]]]:
        """Forward Viterbi score of each position, and the edges that end there. A character that is no piece
        becomes its bytes."""
        n, get = len(unit), self.edges.get
        best = [_NEVER] * (n + 1)
        best[0] = 0
        into: list[list[tuple[int, int, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        for start in range(n):
            here, single = best[start], False
            for end in range(start + 1, n + 1):
                found = get(unit[start:end], 0)
                if found == 0:
                    break
                if found is not None:
                    at, score = found
                    into[end].append((start, score, (at,)))
                    if here + score > best[end]:
                        best[end] = here + score
                    single = single or end == start + 1
            if not single:
                ids = tuple(self.byte_ids[b] for b in unit[start].encode())
                score = self.byte_score * len(ids)
                into[start + 1].append((start, score, ids))
                if here + score > best[start + 1]:
                    best[start + 1] = here + score
        return best, into

    def n_best(self, unit: str, n: int) -> list[tuple[int, list[int]]]:
        """The ``n`` best segmentations (all, if there are fewer), best first, as score and ids.

        A-star from the end backwards: a partial path is ranked by its own score plus the forward Viterbi score of
        where it stands, which is exactly the best it can become, so paths come out in order of score. Of equal
        ones that nearer to the beginning goes first, so ties don't widen the search.
        """
        best, into = self.lattice(unit)
        heap: list[tuple[int, int, int, int, tuple | None]] = [(-best[-1], len(unit), 0, 0, None)]
        out, count = [], 0
        while heap and len(out) < n:
            _, at, _, score, path = heapq.heappop(heap)
            if at == 0:
                ids: list[int] = []
                while path is not None:
                    own, path = path
                    ids += own
                out.append((score, ids))
                continue
            for start, own, piece in into[at]:
                count += 1
                heapq.heappush(heap, (-(best[start] + score + own), start, count, score + own, (piece, path)))
        return out

    def first(self, unit: str) -> tuple[bytes, int, float]:
        """Ids (little-endian 32-bit) and score of the best segmentation, and what the second best loses.

        This is the search of ``n_best`` up to its second result without the queue: after the best path has come
        out, the queue holds the other edges into its positions, each ranked by the forward score at its start. So
        the forward pass keeps the two best arrivals at each position.
        """
        found = self.known.get(unit)
        if found is not None:
            return found
        n, get, never = len(unit), self.edges.get, _NEVER
        best, second, back = [never] * (n + 1), [never] * (n + 1), [(0, ())] * (n + 1)
        best[0] = 0
        for start in range(n):
            here, single = best[start], False
            for end in range(start + 1, n + 1):
                edge = get(unit[start:end], 0)
                if edge is None:
                    continue
                if edge == 0:
                    break
                if end == start + 1:
                    single = True
                score = here + edge[1]
                if score > best[end]:
                    second[end] = best[end]
                    best[end] = score
                    back[end] = (start, edge[0])
                elif score > second[end]:
                    second[end] = score
            if not single:
                ids = tuple([self.byte_ids[b] for b in unit[start].encode()])
                score, end = here + self.byte_score * len(ids), start + 1
                if score > best[end]:
                    second[end] = best[end]
                    best[end] = score
                    back[end] = (start, ids)
                elif score > second[end]:
                    second[end] = score
        at, ids, gap = n, [], math.inf
        while at:
            if second[at] > never and best[at] - second[at] < gap:
                gap = best[at] - second[at]
            at, own = back[at]
            if type(own) is int:
                ids.append(own)
            else:
                ids.extend(reversed(own))
        ids.reverse()
        found = (struct.pack(f"<{len(ids)}I", *ids), best[n], gap)
        if n <= REMEMBERED_LENGTH:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[unit] = found
        return found

    def encode(self, text: str, n: int) -> list[tuple[float, bytes]]:
        """The ``n`` best segmentations of a whole text, best first, as score and ids. An empty text has none.

        Units are independent, so only the ``n - 1`` places where a second choice costs least can differ from the
        best segmentation; their n-best lists are merged.
        """
        if not text:
            return []
        units = _UNIT.findall(BLANK + text.replace(" ", BLANK))
        first = self.first
        known = self.known
        held = [known.get(u) or first(u) for u in units]
        total = sum([h[1] for h in held])
        gaps = [h[2] for h in held]
        places = heapq.nsmallest(n - 1, range(len(gaps)), key=gaps.__getitem__)
        choices: list[tuple[int, dict[int, list[int]]]] = [(0, {})]
        for place in sorted(p for p in places if gaps[p] < math.inf):
            listed = self.n_best(units[place], n)
            top = listed[0][0]
            merged = [(cost + score - top, {**own, place: ids}) for cost, own in choices for score, ids in listed]
            choices = heapq.nlargest(n, merged, key=lambda c: c[0])
        out = []
        for cost, own in choices:
            parts = [h[0] for h in held]
            for place, ids in own.items():
                parts[place] = np.array(ids, "<u4").tobytes()
            out.append(((total + cost) / SCALE, b"".join(parts)))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the blank that encoding puts in front is taken off. Bytes that are no text are replaced."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode(errors="replace").removeprefix(" ")


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def encode_pieces(
    docs: DataFrame, model: str, n_best: int = 3, with_ids: bool = True, with_n_best_ids: bool = False
) -> DataFrame:
    """``doc_id, n_pieces, ids_crc32, score, scores, crc32s, round_trip`` of each document and, if asked, its best
    ``ids`` and the ``n_best_ids`` of all segmentations.

    ``model`` is the vocabulary's path on all machines. ``scores`` and ``crc32s`` (of little-endian 32-bit ids) are
    those of the ``n_best`` segmentations of the whole text, best first, ``round_trip`` whether decoding gives the text back (with U+2581 read as a blank). A null or empty
    text has no pieces, a null score and round trip true. Repeated rows are encoded one by one; other columns are
    ignored.
    """
    fields = [
        ("doc_id", pa.int64()),
        ("n_pieces", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("score", pa.float64()),
        ("scores", pa.list_(pa.float64())),
        ("crc32s", pa.list_(pa.int64())),
        ("round_trip", pa.bool_()),
    ]
    fields += [("ids", pa.list_(pa.int32()))] * with_ids + [("n_best_ids", pa.list_(pa.list_(pa.int32())))] * with_n_best_ids
    schema = pa.schema(fields)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model)
        for rows in batches:
            _, offsets = utf8(rows.column("text"))
            for low, high in slices(offsets):
                made: dict[str, list] = {name: [] for name in schema.names[1:]}
                for text in rows.column("text")[low:high].to_pylist():
                    text = text or ""
                    found = vocabulary.encode(text, n_best)
                    stream = found[0][1] if found else b""
                    ids = np.frombuffer(stream, "<u4")
                    made["n_pieces"].append(len(ids))
                    made["ids_crc32"].append(zlib.crc32(stream))
                    made["score"].append(found[0][0] if found else None)
                    made["scores"].append([s for s, _ in found])
                    made["crc32s"].append([zlib.crc32(own) for _, own in found])
                    made["round_trip"].append(vocabulary.decode(ids) == text.replace(BLANK, " "))
                    if with_ids:
                        made["ids"].append(ids.astype(np.int32))
                    if with_n_best_ids:
                        made["n_best_ids"].append([np.frombuffer(own, "<i4") for _, own in found])
                yield batch(made | {"doc_id": rows.column("doc_id")[low:high]}, schema)

    ddl = "doc_id bigint, n_pieces bigint, ids_crc32 bigint, score double, scores array<double>, crc32s array<bigint>, round_trip boolean"
    ddl += ", ids array<int>" * with_ids + ", n_best_ids array<array<int>>" * with_n_best_ids
    return docs.select("doc_id", "text").mapInArrow(lean(encode), ddl)


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null or empty ids give an empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model)
        for rows in batches:
            texts = [vocabulary.decode(np.array(ids.as_py() or [], np.int64)) for ids in rows.column("ids")]
            yield batch({"doc_id": rows.column("doc_id"), "text": texts}, schema)

    return encoded.select("doc_id", "ids").mapInArrow(lean(decode), "doc_id bigint, text string")
