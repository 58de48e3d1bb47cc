"""Regular expressions as one deterministic automaton over bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from re import _constants as sre, _parser as sre_parser

import numpy as np

#: Docs that are stepped side by side; fewer are finished one by one.
LEAST_LANES = 48


class Nfa:
    """Thompson construction of parsed patterns; ``backward`` builds the language read from right to left."""

    def __init__(self, backward: bool = False) -> None:
        self.backward = backward
        self.moves: list[list[tuple[int, int]]] = []  # (byte set, target)
        self.jumps: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.jumps.append([])
        return len(self.moves) - 1

    def add(self, pattern: str) -> tuple[int, int]:
        return self._sequence(list(sre_parser.parse(pattern)), False)

    def _sequence(self, items: list, fold: bool) -> tuple[int, int]:
        first = last = self.state()
        for item in reversed(items) if self.backward else items:
            start, end = self._item(item, fold)
            self.jumps[last].append(start)
            last = end
        return first, last

    def _bytes(self, members: int) -> tuple[int, int]:
        start, end = self.state(), self.state()
        self.moves[start].append((members, end))
        return start, end

    def _item(self, item: tuple, fold: bool) -> tuple[int, int]:
        op, value = item
        if op in (sre.LITERAL, sre.IN):
            return self._bytes(_members([item] if op is sre.LITERAL else value, fold))
        if op is sre.SUBPATTERN:
            return self._sequence(list(value[3]), fold or bool(value[1] & re.IGNORECASE))
        if op is sre.BRANCH:
            start, end = self.state(), self.state()
            for branch in value[1]:
                low, high = self._sequence(list(branch), fold)
                self.jumps[start].append(low)
                self.jumps[high].append(end)
            return start, end
        if op is sre.MAX_REPEAT:
            least, most, body = value
            start = last = self.state()
            for _ in range(least):
                low, high = self._sequence(list(body), fold)
                self.jumps[last].append(low)
                last = high
            end = self.state()
            self.jumps[last].append(end)
            if most is sre.MAXREPEAT:
                low, high = self._sequence(list(body), fold)
                self.jumps[last].append(low)
                self.jumps[high] += [low, end]
            else:
                for _ in range(most - least):
                    low, last = self._join(last, body, fold)
                    self.jumps[last].append(end)
            return start, end
        raise ValueError(f"a rule may not use {op}")

    def _join(self, last: int, body: Sequence, fold: bool) -> tuple[int, int]:
        low, high = self._sequence(list(body), fold)
        self.jumps[last].append(low)
        return low, high

    def closure(self, states: set[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for target in self.jumps[todo.pop()]:
                if target not in seen:
                    seen.add(target)
                    todo.append(target)
        return frozenset(seen)


def _members(items: Sequence, fold: bool) -> int:
    """Bytes of a character class as the bits of an integer. Only ASCII characters are rules' business."""
    bits, negate = 0, False
    for op, value in items:
        if op is sre.NEGATE:
            negate = True
            continue
        low, high = value if op is sre.RANGE else (value, value)
        if op not in (sre.LITERAL, sre.RANGE) or high > 127:
            raise ValueError("classes hold ASCII characters and ranges of them")
        for byte in range(low, high + 1):
            bits |= 1 << byte
            if fold and chr(byte).isalpha():
                bits |= 1 << ord(chr(byte).swapcase())
    return ~bits & ((1 << 256) - 1) if negate else bits


class Automaton:
    """``step[state, class_of[byte]]`` is the next state; bit k of ``labels[state]`` says that rule k ends here."""

    def __init__(self, patterns: Sequence[str], search: bool = True, backward: bool = False) -> None:
        nfa = Nfa(backward)
        ends = [nfa.add(p) for p in patterns]
        sets = sorted({members for moves in nfa.moves for members, _ in moves})
        keys = [tuple(members >> byte & 1 for members in sets) for byte in range(256)]
        classes = {key: i for i, key in enumerate(dict.fromkeys(keys))}
        self.class_of = np.array([classes[k] for k in keys], np.uint8)
        sample = {i: keys.index(k) for k, i in classes.items()}
        begin = {start for start, _ in ends}
        first = nfa.closure(begin)
        found, todo, rows = {first: 0}, [first], []
        moved: dict[tuple[int, int], frozenset[int]] = {}
        while len(rows) < len(todo):
            source, row = todo[len(rows)], []
            by_class: list[set[int]] = [set(first) if search else set() for _ in classes]
            for state in source:
                for members, target in nfa.moves[state]:
                    for i, byte in sample.items():
                        if members >> byte & 1:
                            if (state, target) not in moved:
                                moved[state, target] = nfa.closure({target})
                            by_class[i] |= moved[state, target]
            for reached in map(frozenset, by_class):
                if reached not in found:
                    found[reached] = len(todo)
                    todo.append(reached)
                row.append(found[reached])
            rows.append(row)
        labels = np.array([sum(1 << k for k, (_, end) in enumerate(ends) if end in s) for s in todo], np.int64)
        self.step, self.labels = _minimal(np.array(rows, np.int32), labels)

    def prepare(self) -> None:
        """Plain lists for the byte-by-byte walk; made once per worker."""
        if not hasattr(self, "rows"):
            self.rows = self.step.tolist()
            self.marks = self.labels.tolist()
            self.folded = bytes(self.class_of.tolist())

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k in ("class_of", "step", "labels")}

    def ends(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """``(row, end, rules)`` wherever rules stop matching, for all rows in one pass over the bytes.

        Rows are stepped side by side, longest first; the last few go byte by byte.
        """
        self.prepare()
        width = self.step.shape[1]
        step, labels = (self.step * width).ravel(), np.repeat(self.labels, width)  # states are row offsets
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        begin, left = offsets[:-1][order], lengths[order]
        classes = self.class_of[data]
        state = np.zeros(len(order), np.int64)
        before = np.zeros(len(order), np.int64)
        active, i = int(np.searchsorted(-left, 0)), 0
        out: list[tuple[int, int, int]] = []
        while active >= LEAST_LANES:
            now = step[state[:active] + classes[begin[:active] + i]]
            state[:active] = now
            mark = labels[now]
            fell = before[:active] & ~mark
            if fell.any():
                out += [(int(order[k]), i, int(fell[k])) for k in np.flatnonzero(fell)]
            before[:active] = mark
            i += 1
            while active and left[active - 1] <= i:
                active -= 1
        for k in np.flatnonzero(before[active:]) + active:
            out.append((int(order[k]), int(left[k]), int(before[k])))
        rows, marks = self.rows, self.marks
        for k in range(active):
            row, last, at = int(state[k]) // width, int(before[k]), i
            doc = int(order[k])
            for c in classes[begin[k] + i : begin[k] + left[k]].tobytes():
                row = rows[row][c]
                mark = marks[row]
                if mark != last:
                    if last & ~mark:
                        out.append((doc, at, last & ~mark))
                    last = mark
                at += 1
            if last:
                out.append((doc, at, last))
        return iter(sorted(out))

    def first_start(self, data: bytes, end: int, least: int) -> int:
        """For a backward automaton: the smallest start from ``least`` of a match that ends at ``end``; else -1."""
        self.prepare()
        row, best = 0, -1
        for at in range(end - 1, least - 1, -1):
            row = self.rows[row][self.folded[data[at]]]
            if self.marks[row]:
                best = at
            elif row == self.dead:
                break
        return best

    @property
    def dead(self) -> int:
        """The state that only leads to itself and ends nothing; -1 if there is none."""
        if not hasattr(self, "_dead"):
            own = (self.step == np.arange(len(self.step))[:, None]).all(axis=1) & (self.labels == 0)
            self._dead = int(np.flatnonzero(own)[0]) if own.any() else -1
        return self._dead


def _minimal(step: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge equivalent states: refine the partition by labels until no transition tells two states apart."""
    _, part = np.unique(labels, return_inverse=True)
    while True:
        signature = np.column_stack((part, part[step])).astype(np.int32)
        rows = np.ascontiguousarray(signature).view(f"V{signature.shape[1] * 4}").ravel()
        _, first, finer = np.unique(rows, return_index=True, return_inverse=True)
        if finer.max() == part.max():
            break
        part = finer
    name = np.full(finer.max() + 1, -1)
    name[finer[0]] = 0  # the start stays state 0
    name[name < 0] = np.arange(1, len(name))
    keep = np.zeros(len(name), np.int64)
    keep[name] = first
    return name[finer[step[keep]]].astype(np.int32), labels[keep]
