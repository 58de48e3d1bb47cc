"""A class-based bigram language model: words belong to classes found by exchange clustering.

P(word | history) = P(class | class before) * P(word | class). Counts are Spark aggregates over all training texts.
Exchange clustering starts on a table of bounded size: the most frequent words are units of their own, all others share
units by their ending. Then every other word chooses a class of its own: its counts beside its neighbours' classes meet
in one task, which takes the class of the highest likelihood under the table of classes. Both the final table and the
scores use these own classes; those of rare words come by a join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from probeline.llm.common import batch, blank_words, lean, mixed, slices, stored, utf8, word_hashes

#: Units of the start: the end of a text, the most frequent words, and endings of the others.
FREQUENT_WORDS = 1791
ENDINGS = 256
CLASSES = 64
#: Rounds of exchange among the units, and of choice among all other words.
ROUNDS = 6
CHOICES = 1
#: Words whose counts and classes each task gets; those of rarer ones come by a join.
KNOWN_WORDS = 100_000
ADDED = 0.1
#: Distinct keys a task counts before it passes them on.
HELD_WORDS = 1_000_000
#: Low bits of a word's hash, kept free: hash + slot is the key of a word beside a class (64 before it, 64 behind it).
SLOTS = 128


def held_out(doc_id: Column) -> Column:
    """A tenth of the documents by checksum of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


#: What one byte does to a CRC-32.
_CRC = np.array([zlib.crc32(bytes([k ^ 255])) for k in range(256)], np.uint32) ^ np.uint32(0xFF000000)


def _endings(words: pa.Array) -> np.ndarray:
    """CRC-32 of each word's last three bytes, modulo ``ENDINGS``; of all words side by side."""
    if not len(words):
        return np.zeros(0, np.int64)
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1]
    data, size = np.frombuffer(data, np.uint8), np.diff(at)
    crc = np.full(len(words), 0xFFFFFFFF, np.uint32)
    for k in (3, 2, 1):
        step = _CRC[(crc ^ data[np.maximum(at[1:] - k, 0)]) & 255] ^ (crc >> 8)
        crc = np.where(size >= k, step, crc)
    return ((crc ^ np.uint32(0xFFFFFFFF)) % ENDINGS).astype(np.int64)


def _hashes(words: pa.Array) -> np.ndarray:
    return word_hashes(words) & np.int64(-SLOTS)


def _pieces(rows: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, pa.Array, np.ndarray]]:
    data, offsets = utf8(rows.column("text"))
    for low, high in slices(offsets):
        own = offsets[low : high + 1]
        yield low, *blank_words(data[own[0] : own[-1]], own - own[0])


class _Sums:
    """Sums of counts by key, handed on when a task holds too many distinct ones."""

    def __init__(self, name: str) -> None:
        self.schema = pa.schema([(name, pa.int64()), ("n", pa.int64())])
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def _fold(self) -> None:
        keys = np.concatenate(self.keys)
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[: len(keys)]
        self.keys, self.counts = [keys[first]], [np.add.reduceat(np.concatenate(self.counts)[order], first)]

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        self.counts.append(counts)
        if sum(map(len, self.keys)) > 2 * HELD_WORDS:
            self._fold()
            if len(self.keys[0]) > HELD_WORDS:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.keys:
            self._fold()
            keys, counts = self.keys[0], self.counts[0]
            self.keys, self.counts = [], []
            for a in range(0, len(keys), 100_000):
                own = slice(a, a + 100_000)
                yield batch({self.schema.names[0]: keys[own], "n": counts[own]}, self.schema)


def word_counts(texts: DataFrame) -> DataFrame:
    """``word`` (hash) and ``n`` over all texts; tasks count first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums("word")
        for rows in batches:
            for _, codes, words, _ in _pieces(rows):
                yield from sums.add(_hashes(words), np.bincount(codes, minlength=len(words)))
        yield from sums.rest()

    counted = texts.select("text").mapInArrow(lean(count), "word bigint, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


class Known:
    """What tasks know: counts, units and classes of the most frequent words, and the class of each ending."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, frequent: int) -> None:
        rank = np.arange(len(words))
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.unit = np.where(rank < frequent, rank + 1, 0)[order]  # 0: by ending
        self.units, self.frequent = 1 + frequent + ENDINGS, frequent
        self.classes = np.zeros(len(words), np.int64)
        self.spare = np.zeros(ENDINGS, np.int64)

    def find(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash and place of each distinct word, and whether it is known."""
        hashes = _hashes(words)
        if not len(self.words):
            return hashes, np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return hashes, at, self.words[at] == hashes

    def _of(self, values: np.ndarray, at: np.ndarray, here: np.ndarray, other: np.ndarray | int) -> np.ndarray:
        return np.where(here, values[at], other) if len(values) else np.broadcast_to(other, at.shape)

    def units_of(self, words: pa.Array) -> np.ndarray:
        _, at, here = self.find(words)
        unit = self._of(self.unit, at, here, 0)
        return np.where(unit > 0, unit, 1 + self.frequent + _endings(words))

    def start(self, classes: np.ndarray) -> None:
        """Take the classes of units; a word that is none gets that of its ending for the time being, if it has one."""
        self.classes = np.where(self.unit > 0, classes[self.unit], -1)
        self.spare = classes[1 + self.frequent :]

    def choose(self, words: np.ndarray, classes: np.ndarray) -> None:
        self.classes[np.searchsorted(self.words, words)] = classes


@dataclass
class _Line:
    """Words of a slice of texts: each token's class, a text's tokens standing between ends."""

    low: int
    codes: np.ndarray
    hashes: np.ndarray
    before: np.ndarray  # tokens before each text
    counts: np.ndarray  # of distinct words, -1: not known here
    spare: np.ndarray  # class of each distinct word's ending
    frequent: np.ndarray  # distinct words that are units
    place: np.ndarray  # of each token on the line
    classes: np.ndarray  # on the line
    known: np.ndarray  # on the line: whether the class is the word's own


def _lines(rows: pa.RecordBatch, known: Known) -> Iterator[_Line]:
    for low, codes, words, before in _pieces(rows):
        hashes, at, here = known.find(words)
        own, spare = known._of(known.classes, at, here, -1), known.spare[_endings(words)]
        line = _with_ends(np.where(own >= 0, own, spare)[codes], before)
        sure = _with_ends((own < 0)[codes], before) == 0
        place = np.arange(len(codes)) + 1 + np.repeat(np.arange(len(before) - 1), np.diff(before))
        counts, unit = known._of(known.counts, at, here, -1), known._of(known.unit, at, here, 0)
        yield _Line(low, codes, hashes, before, counts, spare, unit > 0, place, line, sure)


def _with_ends(units: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Units of all texts, each text followed by the end unit 0, with one more end in front."""
    out = np.zeros(len(units) + len(before), np.int64)
    doc = np.repeat(np.arange(len(before) - 1), np.diff(before))
    out[1 + np.arange(len(units)) + doc] = units
    return out


def unit_bigrams(texts: DataFrame, known: Known) -> DataFrame:
    """``pair`` (unit * units + following unit) and ``n``; tasks count first."""
    schema = pa.schema([("pair", pa.int32()), ("n", pa.int64())])
    size = known.units

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for rows in batches:
            for _, codes, words, before in _pieces(rows):
                line = _with_ends(known.units_of(words)[codes], before)
                total += np.bincount(line[:-1] * size + line[1:], minlength=size * size)
        found = np.flatnonzero(total)
        for low in range(0, len(found), 100_000):
            own = found[low : low + 100_000]
            yield batch({"pair": own.astype(np.int32), "n": total[own]}, schema)

    counted = texts.select("text").mapInArrow(lean(count), "pair int, n bigint")
    return counted.groupBy("pair").agg(F.sum("n").alias("n"))


def _weight(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange_classes(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each unit. Each unit in turn goes to the class with the largest class-bigram likelihood, given all
    others, until a round moves none. Class 0 holds the end of text alone. Ties go to the first class."""
    n = bigrams.astype(np.float64)
    size = len(n)
    order = np.argsort(-n.sum(axis=0)[1:], kind="stable") + 1
    of = np.zeros(size, np.int64)
    of[order] = 1 + np.arange(size - 1) % (classes - 1)
    member = np.zeros((size, classes))
    member[np.arange(size), of] = 1
    after, before = n @ member, n.T @ member  # of each unit: counts of classes that follow it, that precede it
    table = member.T @ after
    diagonal = np.arange(classes)
    for _ in range(rounds):
        moved = 0
        for u in order:
            a, own = of[u], n[u, u]
            right, left = after[u].copy(), before[u].copy()
            if right.sum() + left.sum() == 0:
                continue
            right[a] -= own
            left[a] -= own
            table[a, :] -= right
            table[:, a] -= left
            table[a, a] -= own
            rows, columns = _weight(table + right) - _weight(table), _weight(table.T + left) - _weight(table.T)
            held = table[diagonal, diagonal]
            gain = rows.sum(axis=1) - rows[diagonal, diagonal] + columns.sum(axis=1) - columns[diagonal, diagonal]
            gain += _weight(held + right + left + own) - _weight(held)
            # wherever it goes, its neighbours' classes get these counts back
            out, into = table.sum(axis=1) + left, table.sum(axis=0) + right
            gain -= _weight(out + right.sum() + own) - _weight(out) + _weight(into + left.sum() + own) - _weight(into)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-6:
                b = a
            table[b, :] += right
            table[:, b] += left
            table[b, b] += own
            if b != a:
                moved += 1
                of[u] = b
                after[:, a] -= n[:, u]
                after[:, b] += n[:, u]
                before[:, a] -= n[u]
                before[:, b] += n[u]
        if not moved:
            break
    return of


def transitions(table: np.ndarray) -> np.ndarray:
    """log10 P(class | class before) of counts of class pairs, drawn towards the share of the class."""
    classes = len(table)
    share = (table.sum(axis=0) + 1) / (table.sum() + classes)
    return np.log10((table + classes * share) / (table.sum(axis=1, keepdims=True) + classes))


def neighbour_counts(texts: DataFrame, known: Known) -> DataFrame:
    """``key`` (word + slot of a class before or behind it) and ``n`` of all words that are no units. Tasks count first,
    so a word has at most ``SLOTS`` rows a task, however often it occurs. A key may come from several tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums("key")
        for rows in batches:
            for line in _lines(rows, known):
                mine = ~line.frequent[line.codes]
                at, codes = line.place[mine], line.codes[mine].astype(np.int64) * SLOTS
                sides = (codes + line.classes[at - 1], codes + SLOTS // 2 + line.classes[at + 1])
                pairs, n = np.unique(np.concatenate(sides), return_counts=True)
                yield from sums.add(line.hashes[pairs // SLOTS] + pairs % SLOTS, n)
        yield from sums.rest()

    return texts.select("text").mapInArrow(lean(count), "key bigint, n bigint")


def choose_classes(counts: DataFrame, step: np.ndarray, weight: np.ndarray) -> DataFrame:
    """``word, class, n``: the class under which a word's neighbours are likeliest, given log10 transitions and the
    log10 weight of each class; ties go to the first, class 0 is the end's alone."""
    schema = pa.schema([("word", pa.int64()), ("class", pa.int32()), ("n", pa.int64())])
    classes = len(step)
    gains = np.zeros((SLOTS, classes))
    gains[:classes] = step - weight  # every token has one word before it
    gains[SLOTS // 2 : SLOTS // 2 + classes] = step.T

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_n = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of the last word, which may go on

        def chosen(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            slot = keys & np.int64(SLOTS - 1)
            words = keys - slot
            first = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
            gain = np.add.reduceat(n[:, None] * gains[slot], first)
            seen = np.add.reduceat(np.where(slot < SLOTS // 2, n, 0), first)
            best = 1 + np.argmax(gain[:, 1:], axis=1)
            return batch({"word": words[first], "class": best.astype(np.int32), "n": seen}, schema)

        for rows in batches:
            if not rows.num_rows:
                continue
            keys = np.concatenate((held, rows.column("key").to_numpy()))
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            n = np.add.reduceat(np.concatenate((held_n, rows.column("n").to_numpy())), first)
            keys = keys[first]
            begin = int(np.searchsorted(keys, keys[-1] & np.int64(-SLOTS)))
            if begin:
                yield chosen(keys[:begin], n[:begin])
            held, held_n = keys[begin:], n[begin:]
        if len(held):
            yield chosen(held, held_n)

    by_word = counts.repartition(F.shiftright("key", 7)).sortWithinPartitions("key")
    return by_word.mapInArrow(lean(choose), "word bigint, class int, n bigint")


#: A token that is not known to the task: its text's row, its place among all texts of the task, the class before and behind it (-1: another
#: such token's), and the class of its ending.
_RARE = "row bigint, at bigint, word bigint, left int, right int, spare int"
_RARE_FIELDS = [("row", pa.int64()), ("at", pa.int64()), ("word", pa.int64())]
_RARE_FIELDS += [("left", pa.int32()), ("right", pa.int32()), ("spare", pa.int32())]


def _rare_tokens(line: _Line, first_row: int, first_place: int, more: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """Those tokens of a line, with nulls in the fields of ``more``."""
    schema = pa.schema(_RARE_FIELDS + more)
    rare = np.flatnonzero(~line.known[line.place])
    doc = np.searchsorted(line.before, rare, "right") - 1
    for a in range(0, len(rare), 100_000):
        own, row = rare[a : a + 100_000], first_row + doc[a : a + 100_000]
        at, codes = line.place[own], line.codes[own]
        side = lambda k: np.where(line.known[k], line.classes[k], -1).astype(np.int32)
        values = (row, first_place + at, line.hashes[codes], side(at - 1), side(at + 1), line.spare[codes].astype(np.int32))
        made = [pa.array(v, kind) for v, (_, kind) in zip(values, _RARE_FIELDS)]
        yield pa.RecordBatch.from_arrays(made + [pa.nulls(len(own), kind) for _, kind in more], schema=schema)


def _with_own_classes(tokens: DataFrame, words: DataFrame, *more: str) -> DataFrame:
    """Rare tokens with ``own``, their class, and ``seen``, their count; texts stay whole and in order. A word without
    training tokens takes the class of its ending."""
    joined = tokens.join(words.select("word", "class", F.col("n").alias("seen")), "word", "left")
    own = F.coalesce("class", "spare").alias("own")
    return joined.select("row", "at", "left", "right", own, "seen", *more).repartition("row").sortWithinPartitions("at")


def _sides(rows: pa.RecordBatch, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class before, own class and class behind of each row (-1: none, or another rare token's behind)."""
    left, right, own = (
        rows.column(c).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("left", "right", "own")
    )
    return np.where(left >= 0, left, np.concatenate(([last], own[:-1]))), own, right


def class_bigrams(texts: DataFrame, known: Known, words: DataFrame, classes: int) -> np.ndarray:
    """Counts of class pairs, every word having its own class."""
    more = [("n", pa.int64())]
    schema = pa.schema(_RARE_FIELDS + more)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        following = place = TaskContext.get().partitionId() << 40
        total = np.zeros(classes * classes, np.int64)
        for rows in batches:
            for line in _lines(rows, known):
                both = line.known[:-1] & line.known[1:]
                pairs = (line.classes[:-1] * classes + line.classes[1:])[both]
                total += np.bincount(pairs, minlength=classes * classes)
                yield from _rare_tokens(line, following, place, more)
                following += len(line.before) - 1
                place += len(line.classes)
        found = np.flatnonzero(total)
        row = following + np.arange(len(found))
        yield batch(
            {
                "row": row,
                "at": place + np.arange(len(found)),
                "word": mixed(row.astype(np.uint64)).view(np.int64) | 1,  # no word's hash
                "left": (found // classes).astype(np.int32),
                "right": (found % classes).astype(np.int32),
                "spare": pa.nulls(len(found), pa.int32()),
                "n": total[found],
            },
            schema,
        )

    pair_schema = pa.schema([("pair", pa.int32()), ("n", pa.int64())])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, last = np.zeros(classes * classes, np.int64), -1
        for rows in batches:
            if not rows.num_rows:
                continue
            before, own, right = _sides(rows, last)
            rare, last = own >= 0, int(own[-1])
            n = rows.column("n").fill_null(0).to_numpy(zero_copy_only=False)
            np.add.at(total, (before * classes + right)[~rare], n[~rare])  # counted by tasks already
            behind = rare & (right >= 0)
            for found in ((before * classes + own)[rare], (own * classes + right)[behind]):
                total += np.bincount(found, minlength=classes * classes)
        found = np.flatnonzero(total)
        yield batch({"pair": found.astype(np.int32), "n": total[found]}, pair_schema)

    tokens = texts.select("text").mapInArrow(lean(count), f"{_RARE}, n bigint")
    rows = _with_own_classes(tokens, words, "n").mapInArrow(lean(pairs), "pair int, n bigint")
    table = np.zeros(classes * classes, np.int64)
    for row in rows.groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most classes squared
        table[row["pair"]] = row["n"]
    return table.reshape(classes, classes)


@dataclass
class ClassModel:
    """What scoring needs: bounded arrays, and the table of all words that are no units (``word, class, n``)."""

    known: Known
    step: np.ndarray  # log10 P(class | class before)
    emitted: np.ndarray  # log10 of the emission denominator of each class
    tokens: int
    types: int
    ends: int
    words: DataFrame


def train_class_model(
    texts: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS, choices: int = CHOICES
) -> ClassModel:
    """Counts, classes and probabilities from all rows of ``texts`` (a null text is empty and still has its end).

    ``rounds`` of exchange among the units, then ``choices`` rounds in which every other word picks its class; in the
    first, words that are no units stand for their ending as neighbours, later the known ones for their own class.
    """
    if not 2 <= classes <= SLOTS // 2:
        raise ValueError(f"classes must be from 2 to {SLOTS // 2}")
    if choices < 1:
        raise ValueError("words need one round of choice at least")
    counts = stored(word_counts(texts), "word_counts")
    ends = texts.count()
    types, tokens = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    top = counts.orderBy(F.desc("n"), "word").limit(KNOWN_WORDS).toArrow()
    known = Known(top.column("word").to_numpy(), top.column("n").to_numpy(), FREQUENT_WORDS)
    size = known.units
    pairs = unit_bigrams(texts, known).toArrow()  # at most units squared
    bigrams = np.zeros(size * size, np.int64)
    bigrams[pairs.column("pair").to_numpy()] = pairs.column("n").to_numpy()
    bigrams = bigrams.reshape(size, size)
    of_unit = exchange_classes(bigrams, classes, rounds)
    known.start(of_unit)
    member = np.zeros((size, classes))
    member[np.arange(size), of_unit] = 1
    step, weight = transitions(member.T @ bigrams @ member), np.log10(member.T @ bigrams.sum(axis=0) + 1)
    for k in range(choices):
        words = stored(choose_classes(neighbour_counts(texts, known), step, weight), "word_classes")
        rest = words.orderBy(F.desc("n"), "word").limit(max(0, KNOWN_WORDS - FREQUENT_WORDS)).toArrow()
        known.choose(rest.column("word").to_numpy(), rest.column("class").to_numpy())
        step = transitions(table := class_bigrams(texts, known, words, classes))
        weight = np.log10(table.sum(axis=0) + 1)
    of_class = np.bincount(known.classes[known.unit > 0], minlength=classes).astype(np.int64)
    for row in words.groupBy("class").agg(F.count(F.lit(1)).alias("types")).collect():
        of_class[row["class"]] += row["types"]
    emitted = np.log10(table.sum(axis=0) + ADDED * (of_class + 1))  # one more for words not seen
    emitted[0] = np.log10(ends + ADDED)  # the end is the only word of its class
    return ClassModel(known, step, emitted, tokens + ends, types + (ends > 0), ends, words)


def score_documents(docs: DataFrame, model: ClassModel) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Scores are log10 probabilities of the whole text and its end: ``base_score`` by add-0.1 unigrams, ``score`` by
    the class model. A null or empty text has only its end. Repeated rows are scored one by one; other columns are
    ignored. Rare words meet their counts and classes in a join, one row each.
    """
    known, step, emitted, ends = model.known, model.step, model.emitted, model.ends
    more = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64())]
    more += [("log_counts", pa.float64()), ("rest", pa.float64())]
    schema = pa.schema(_RARE_FIELDS + more)

    def sums(values: np.ndarray, before: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(values)))
        return total[before[1:]] - total[before[:-1]]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        following = place = TaskContext.get().partitionId() << 40
        for rows in batches:
            for line in _lines(rows, known):
                n, low, before = len(line.before) - 1, line.low, line.before
                here, sure = line.counts[line.codes], line.known
                counted = sure[line.place]
                size = np.diff(before)
                inside = before + np.arange(n + 1)  # of the line, with its ends
                own = np.arange(n) + following
                end = np.log10(ends + ADDED)
                logs = np.where(sure[:-1] & sure[1:], step[line.classes[:-1], line.classes[1:]], 0.0)
                logs -= np.where(sure[1:], emitted[line.classes[1:]], 0.0)
                yield batch(
                    {
                        "row": own,
                        "at": place + inside[:-1],  # where the end before the text stands
                        "word": mixed(own.astype(np.uint64)).view(np.int64) | 1,  # no word's hash
                        **{name: pa.nulls(n, pa.int32()) for name in ("left", "right", "spare")},
                        "doc_id": rows.column("doc_id")[low : low + n],
                        "held_out": rows.column("held_out")[low : low + n],
                        "n_tokens": size + 1,
                        "known": sums(counted, before).astype(np.int64) + (ends > 0),
                        "log_counts": sums(np.where(counted, np.log10(np.maximum(here, 0) + ADDED), 0.0), before) + end,
                        "rest": sums(logs, inside),
                    },
                    schema,
                )
                yield from _rare_tokens(line, following, place, more)
                following += n
                place += len(line.classes)

    ddl = f"{_RARE}, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, log_counts double, rest double"
    parts = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(lean(split), ddl)
    summed_schema = pa.schema([("row", pa.int64()), *more])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = -1
        for rows in batches:
            if not rows.num_rows:
                continue
            before, own, right = _sides(rows, last)
            rare, last = own >= 0, int(own[-1])
            seen = rows.column("seen").fill_null(0).to_numpy(zero_copy_only=False)
            given = lambda c: rows.column(c).fill_null(0).to_numpy(zero_copy_only=False)
            rest = step[before, own] + np.where(right >= 0, step[own, right], 0.0) - emitted[own]
            row = rows.column("row").to_numpy()
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            out = {name: rows.column(name).take(pa.array(first)) for name in ("row", "doc_id", "held_out", "n_tokens")}
            out["known"] = np.add.reduceat(np.where(rare, seen > 0, given("known")), first)
            out["log_counts"] = np.add.reduceat(np.where(rare, np.log10(seen + ADDED), given("log_counts")), first)
            out["rest"] = np.add.reduceat(np.where(rare, rest, given("rest")), first)
            yield batch(out, summed_schema)

    names = [name for name, _ in more]
    ddl = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, log_counts double, rest double"
    summed = _with_own_classes(parts, model.words, *names).mapInArrow(lean(add_up), ddl).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum("known").alias("n_known"),
        F.sum("log_counts").alias("s"),
        F.sum("rest").alias("rest"),
    )
    base = F.log10(F.lit(model.tokens + ADDED * (model.types + 1)))
    return summed.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("s") - F.col("n_tokens") * base).alias("base_score"),
        (F.col("s") + F.col("rest")).alias("score"),
    )
