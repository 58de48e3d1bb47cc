"""Repair of conversations: the cheapest edits that give turns of the form ``(system? (user assistant)+)?``.

The form is a grammar in Chomsky normal form with one nonterminal per pair of its states (start, after system, after
user, after assistant). A cell of a span of rows holds, for each nonterminal, the least (cost, audit) of its edits,
closed under insertions before and after. Cells of one row are combined bottom-up by span length (1, 2, 4, ...): each
of these nonterminals derives a span through every cut of it, so one cut a span is enough. Spans are bounded by blocks of
``BLOCK`` rows in a global order; a conversation of several blocks is finished by a fold over their cells.

Audits of one span and cost are never the beginning of one another (a longer one has the same letters and more
insertions, so another cost), which makes the least audit of a span the join of least audits of its parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from probeline.llm.common import stored
from probeline.session import parallelism

#: Costs of the edits, and of leaving a row truncated.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of one block as a power of two.
BLOCK_BITS = 12
#: Spans of at most this many rows are remembered.
KNOWN_ROWS = 64

_INITIALS = {"s": 0, "u": 1, "a": 2}
#: The state after a role's initial, by state: start, after system, after user, after assistant.
_NEXT = [{0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2}]
_FINAL = (0, 3)
_ROLES = {1: "user", 2: "assistant"}
_LEGAL = {(0, 1), (1, 2), (2, 1)}

_PIECE = pa.schema(
    [("ck", pa.string()), ("seq", pa.int64())]
    + [(name, pa.int64()) for name in ("first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal")]
    + [(name, pa.int32()) for name in ("first_initial", "last_initial")]
    + [("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
)
_REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_CHOSEN = pa.schema(
    [("ck", pa.string()), ("seq", pa.int64()), ("piece", pa.string()), ("state", pa.int32()), ("audit", pa.string())]
    + [(name, pa.int64()) for name in _REPORT]
)
_ROW = pa.schema([(name, pa.string()) for name in ("ck", "role", "text", "edit")])

Cell = list  # of 16 (cost, audit) or None, by 4 * state before + state after


def _product(a: Cell, b: Cell) -> Cell:
    out: Cell = [None] * 16
    for p in range(0, 16, 4):
        for r in range(4):
            left = a[p + r]
            if left is None:
                continue
            for q in range(4):
                right = b[4 * r + q]
                if right is not None:
                    found = (left[0] + right[0], left[1] + right[1])
                    if out[p + q] is None or found < out[p + q]:
                        out[p + q] = found
    return out


def _insertions() -> Cell:
    """Cell of an empty span: insertions of users and assistants from state to state."""
    out: Cell = [(0, "") if p == q else None for p in range(4) for q in range(4)]
    step: Cell = list(out)
    for p, moves in enumerate(_NEXT):
        for initial, q in moves.items():
            if initial in _ROLES:
                step[4 * p + q] = (INSERT, "I")
    for _ in range(4):
        out = _product(out, step)
    return out


_INSERTED = _insertions()
_DELETED, _KEPT = 0, 1


def _row_cell(code: int) -> Cell:
    """Closed cell of one row: 0 where it must go, else 1 + 2 * initial + truncated (initial 3: any other)."""
    out: Cell = [None] * 16
    for p in range(4):
        options = [(p, (DELETE, "D"))]
        if code:
            initial, extra = (code - 1) // 2, TRUNCATED * ((code - 1) % 2)
            if initial in _NEXT[p]:
                options.append((_NEXT[p][initial], (extra, "K")))
            options += [(q, (REROLE + extra, "R")) for k, q in _NEXT[p].items() if k in _ROLES]
        for q, found in options:
            if out[4 * p + q] is None or found < out[4 * p + q]:
                out[4 * p + q] = found
    return _product(_product(_INSERTED, out), _INSERTED)


class Spans:
    """Cells of sequences of rows; those of short spans are remembered by their two halves."""

    def __init__(self) -> None:
        self._rows = [_row_cell(code) for code in range(9)]
        self._forget()

    def _forget(self) -> None:
        self.cells, self.pairs = list(self._rows), {}

    def cell(self, codes: list[int]) -> Cell:
        if len(self.cells) > 30_000:
            self._forget()
        level, length = list(codes), 1
        while len(level) > 1 and length < KNOWN_ROWS:
            up = []
            for k in range(0, len(level) - 1, 2):
                pair = (level[k], level[k + 1])
                found = self.pairs.get(pair)
                if found is None:
                    found = self.pairs[pair] = len(self.cells)
                    self.cells.append(_product(self.cells[pair[0]], self.cells[pair[1]]))
                up.append(found)
            level, length = up + level[len(level) & ~1 :], 2 * length
        spans = [self.cells[k] for k in level]
        while len(spans) > 1:
            spans = [_product(a, b) for a, b in zip(spans[::2], spans[1::2])] + spans[len(spans) & ~1 :]
        return spans[0]


def _key(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("\0"))


def damaged_rows(conversations: DataFrame) -> DataFrame:
    """``ck, turn, role, text, copy`` after the damage that the checksum of ``conv_id:turn`` names."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        _key(F.col("conv_id")).alias("ck"),
        F.col("turn").cast("bigint").alias("turn"),
        space("role").alias("role"),
        space("text").alias("text"),
        (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("damage"),
    ).where("damage <> 0")
    return rows.select(
        "ck",
        "turn",
        F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def ordered_rows(rows: DataFrame) -> DataFrame:
    """Rows in the order of conversation, turn (nulls first), role, text; ``seq`` rises in that order. Stored, so that
    all later steps see the same numbers. Equal rows are told apart by their number in the input, so that even many equal
    ones are cut into ranges."""
    numbered = rows.withColumn("salt", F.monotonically_increasing_id())
    order = [F.col("ck"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy"), F.col("salt")]
    ranged = numbered.repartitionByRange(parallelism(rows.sparkSession), *order).sortWithinPartitions(*order)
    end = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    initial = F.substring("role", 1, 1)
    return stored(
        ranged.select(
            "ck",
            "turn",
            "role",
            "text",
            F.monotonically_increasing_id().alias("seq"),
            F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("digest"),
            F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("initial"),
            (end == "").alias("blank"),
            (~end.isin(".", "!", "?")).alias("truncated"),
        ),
        "ordered_rows",
    )


def _pieces(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Cell and counts of each run of rows of one conversation inside one block; rows come by ``seq``."""
    spans, out, key, codes, facts = Spans(), [], None, [], {}

    def close() -> None:
        if codes:
            cell = spans.cell(codes)
            facts["costs"] = [None if x is None else x[0] for x in cell]
            facts["audits"] = [None if x is None else x[1] for x in cell]
            out.append(facts)

    for rows in batches:
        for seq, ck, turn, initial, blank, truncated, first in zip(*(c.to_pylist() for c in rows.columns)):
            if (ck, seq >> bits) != key:
                close()
                key, codes = (ck, seq >> bits), []
                facts = {"ck": ck, "seq": seq, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
                facts |= {"first_turn": turn, "last_turn": None, "first_initial": initial}
            elif (facts["last_initial"], initial) not in _LEGAL:
                facts["illegal"] += 1
            if turn is not None:
                if facts["last_turn"] != turn:
                    facts["turns"] += 1
                if facts["first_turn"] is None:
                    facts["first_turn"] = turn
                facts["last_turn"] = turn
            facts["last_initial"] = initial
            again = first is not None and seq > first
            fault = "blank" if blank else "duplicate" if again else "truncated" if truncated else None
            if fault:
                facts[fault] += 1
            codes.append(0 if fault in ("blank", "duplicate") else 1 + 2 * initial + (fault == "truncated"))
        if len(out) >= 500:
            yield pa.RecordBatch.from_pylist(out, schema=_PIECE)
            out = []
    close()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_PIECE)


def _before(a: tuple | None, b: tuple | None) -> bool:
    """Whether the audit of path ``a`` is smaller than that of ``b``; paths are (path before, piece, state)."""
    left, right = [], []
    while a is not b:
        left.append(a[1])
        right.append(b[1])
        a, b = a[0], b[0]
    return "".join(reversed(left)) < "".join(reversed(right))


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation its report and audit, and per block the piece of the audit that belongs to it. Cells come by
    conversation and ``seq``; of each state only the best path is held."""
    out, now = [], None

    def close() -> Iterator[dict]:
        cost, path = now["paths"][_FINAL[0]] if now["paths"][_FINAL[0]] is not None else (None, None)
        other = now["paths"][_FINAL[1]]
        if cost is None or other is not None and (other[0] < cost or other[0] == cost and _before(other[1], path)):
            cost, path = other
        pieces = []
        while path is not None:
            pieces.append((path[1], path[2]))
            path = path[0]
        pieces.reverse()
        gaps = now["last"] - now["first"] + 1 - now["turns"] if now["last"] is not None else 0
        report = {name: now[name] for name in ("blank", "duplicate", "truncated", "illegal")} | {"gaps": gaps, "cost": cost}
        yield {"ck": now["ck"], "seq": None, "audit": "".join(p for p, _ in pieces)} | report
        for seq, (piece, state) in zip(now["seqs"], pieces):
            yield {"ck": now["ck"], "seq": seq, "piece": piece, "state": state}

    for rows in batches:
        for row in rows.to_pylist():
            if now is None or row["ck"] != now["ck"]:
                if now:
                    out += close()
                now = {"ck": row["ck"], "seqs": [], "first": None, "last": None, "turns": 0, "initial": None}
                now |= {name: 0 for name in ("blank", "duplicate", "truncated", "illegal")}
                now["paths"] = [(0, None), None, None, None]
            for name in ("blank", "duplicate", "truncated", "illegal"):
                now[name] += row[name]
            if now["initial"] is not None and (now["initial"], row["first_initial"]) not in _LEGAL:
                now["illegal"] += 1
            now["initial"] = row["last_initial"]
            now["turns"] += row["turns"] - (row["turns"] > 0 and now["last"] == row["first_turn"])
            if row["last_turn"] is not None:
                now["first"] = row["first_turn"] if now["first"] is None else now["first"]
                now["last"] = row["last_turn"]
            now["seqs"].append(row["seq"])
            paths: list = [None] * 4
            for q in range(4):
                for p, before in enumerate(now["paths"]):
                    step = row["costs"][4 * p + q]
                    if before is None or step is None:
                        continue
                    found = (before[0] + step, (before[1], row["audits"][4 * p + q], p))
                    best = paths[q]
                    if best is None or found[0] < best[0] or found[0] == best[0] and _before(found[1], best[1]):
                        paths[q] = found
            now["paths"] = paths
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, schema=_CHOSEN)
            out = []
    if now:
        out += close()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_CHOSEN)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the repaired conversations; each block's piece of the audit comes before the block's rows."""
    piece, at, state, out = "", 0, 0, []

    def made() -> Iterator[tuple]:
        """Rows inserted here."""
        nonlocal at, state
        while at < len(piece) and piece[at] == "I":
            initial = next(k for k in _NEXT[state] if k in _ROLES)
            at, state = at + 1, _NEXT[state][initial]
            yield _ROLES[initial], "", "I"

    for rows in batches:
        for ck, given, start, role, text in zip(*(c.to_pylist() for c in rows.columns)):
            if given is not None:
                piece, at, state = given, 0, start
                out += [(ck, *row) for row in made()]
                continue
            letter = piece[at]
            at += 1
            if letter == "R":
                initial = next(k for k in _NEXT[state] if k in _ROLES)
                role, state = _ROLES[initial], _NEXT[state][initial]
            elif letter == "K":
                state = _NEXT[state][_INITIALS[role[0]]]
            if letter != "D":
                out.append((ck, role, text, letter))
            out += [(ck, *row) for row in made()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], schema=_ROW)
            out = []


def repair_conversations(rows: DataFrame, block_bits: int = BLOCK_BITS) -> tuple[DataFrame, DataFrame]:
    """Repaired rows and a report of conversations given as ``ck, turn, role, text, copy`` (see ``damaged_rows``).

    The rows (``ck, role, text, edit``) come with each conversation whole in one partition and in order. The report
    has ``ck``, the counts, the cost and the audit. A conversation whose repair deletes all rows has no repaired rows.
    The task that finishes a conversation holds its audit, some bytes a row; texts are only streamed there.
    """
    spark = rows.sparkSession
    ordered = ordered_rows(rows)
    first = ordered.groupBy("ck", "digest").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    judged = ordered.select("ck", "digest", "seq", "turn", "initial", "blank", "truncated").join(first, ["ck", "digest"], "left")
    judged = judged.select("seq", "ck", "turn", "initial", "blank", "truncated", "first")
    blocks = judged.repartition(parallelism(spark), F.shiftright("seq", block_bits)).sortWithinPartitions("seq")
    pieces = blocks.mapInArrow(lambda batches: _pieces(batches, block_bits), from_arrow_schema(_PIECE))
    chosen = stored(pieces.repartition("ck").sortWithinPartitions("ck", "seq").mapInArrow(_chosen, from_arrow_schema(_CHOSEN)), "audits")
    marks = chosen.where("seq IS NOT NULL").selectExpr("ck", "seq", "0 AS kind", "piece", "state", "CAST(NULL AS string) AS role", "CAST(NULL AS string) AS text")
    texts = ordered.selectExpr("ck", "seq", "1 AS kind", "CAST(NULL AS string) AS piece", "CAST(NULL AS int) AS state", "role", "text")
    together = marks.union(texts).repartition("ck").sortWithinPartitions("ck", "seq", "kind").select("ck", "piece", "state", "role", "text")
    report = chosen.where("seq IS NULL").select("ck", *_REPORT, "audit")
    return together.mapInArrow(_edited, from_arrow_schema(_ROW)), report


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, digest = None, None
    schema = pa.schema([("ck", pa.string()), ("repaired_sha256", pa.string())])
    for rows in batches:
        out = []
        for ck, role, text in zip(*(rows.column(k).to_pylist() for k in range(3))):
            if ck != now:
                if now is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = ck, hashlib.sha256(f"{role}:{text}".encode())
            else:
                digest.update(f"\n{role}:{text}".encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=schema)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], schema=schema)


def repair_report(conversations: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """One row per ``conv_id`` of ``conversations``: ``gaps, blank, duplicate, truncated, illegal, cost, audit`` of its damaged
    rows and ``repaired_sha256`` of the repaired ones.

    Null roles and texts are one space; null turns come first and count in no gap; null ids are one conversation; rows
    of one turn are ordered by role and text. A conversation that loses all its rows to the damage has zeros, an empty
    audit and the digest of nothing. An empty table gives none; other columns are not read.
    """
    repaired, report = repair_conversations(damaged_rows(conversations), block_bits)
    digests = repaired.mapInArrow(_digests, "ck string, repaired_sha256 string")
    ids = conversations.select(_key(F.col("conv_id")).alias("ck"), "conv_id").groupBy("ck").agg(F.min("conv_id").alias("conv_id"))
    out = ids.join(report, "ck", "left").join(digests, "ck", "left")
    return out.select(
        "conv_id",
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in _REPORT],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
