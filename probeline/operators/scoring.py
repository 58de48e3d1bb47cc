"""Exhaustive scoring of two vector sets on a grid of bounded cells.

Every row is hashed by id to a block; a cell holds one block of each side. Rows are copied once per
block of the other side and shuffled to their cells, so a task never sees more than a block of either
side whatever the labels look like. Only a second side whose size was counted and fits one block is sent
to the tasks instead; the first side is then scanned without a shuffle. Inside a cell the scores are a
NumPy array, summed in index order so they equal ``functions.columns.similarity`` bit for bit. The pairs of one set come from
blocks that are stored once (``operators/blocks.py``).

Readings that want few scores (``quick``) take a matrix product in single precision first. Vectors prepared for a dot
product have length 1 at most, so its error is bounded: it decides in which bin of a grid a score lies to within half a
bin, and only the scores of bins that matter are then summed in index order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from probeline.functions.columns import prepared
from probeline.operators import blocks as stored_blocks
from probeline.session import parallelism

#: Rows of one side in a cell; 8192 x 64 doubles are 4 MB.
BLOCK_ROWS = 8192
SMALL_BLOCK_ROWS = 256
MOST_TASKS = 100_000
#: Outputs that leave a cell score by score use smaller blocks: 2048 x 2048 scores at a time.
SCORE_BLOCK_ROWS = 2048
SCORE_OUTPUTS = ("pairs", "histogram", "exact")
#: Blocks and tiles of ``quick`` readings, whose cells hold a tile of scores at a time.
QUICK_BLOCK_ROWS = 32768
QUICK_TILE = (512, 1024)
#: Range of the bounded similarities with room for rounding, and the bins of the grid on it.
BOUNDED = (-1.000001, 1.000001)
QUICK_BINS = 16384
#: A label with more rows than this is not kept whole in a cell.
WHOLE_ROWS = 1024
#: A counted second side up to these limits is sent along with the task.
SENT_ROWS, SENT_VALUES = 8192, 4_000_000


#: Segments (low, high, number of bins) that do not overlap, from low to high, or one alone, or a threshold.
Edges = Sequence[tuple[float, float, int]] | tuple[float, float, int] | float | None


#: A grid (low, high, number of bins) and the runs (first, last) of its bins whose scores are needed; the other bins
#: are counted in the gaps between runs.
Runs = tuple[tuple[float, float, int], Sequence[tuple[int, int]]]


def _block_rows(output: str, quick: bool = False) -> int:
    if quick:
        return QUICK_BLOCK_ROWS
    return min(BLOCK_ROWS, SCORE_BLOCK_ROWS) if output in SCORE_OUTPUTS else BLOCK_ROWS


def _block_counts(left_rows: int, right_rows: int, slots: int, largest: int) -> tuple[int, int]:
    """Blocks per side: of at most ``largest`` rows, and enough cells to keep all slots busy."""
    left = max(1, math.ceil(left_rows / largest))
    right = max(1, math.ceil(right_rows / largest))
    while left * right < slots:
        grow_left = left_rows / left >= right_rows / right
        rows, blocks = (left_rows, left) if grow_left else (right_rows, right)
        if rows / blocks <= SMALL_BLOCK_ROWS:
            break
        if grow_left:
            left += 1
        else:
            right += 1
    return left, right


def _block(column: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")


def _packed(df: DataFrame) -> bytes:
    """A counted, small table as Arrow bytes."""
    import pyarrow as pa

    rows = df.toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def _run_sizes(df: DataFrame, by: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest run, and how many runs of that size hold as many rows as all."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    largest, rows = sizes.agg(F.max("n"), F.sum("n")).first()
    return largest or 0, math.ceil((rows or 0) / (largest or 1)) or 1


_BIN_VALUES = ("sum_genuine", "sum_impostor", "sq_genuine", "sq_impostor", "lowest", "highest", "ref")


def _cell_function(
    kind: str,
    output: str,
    unordered: bool,
    by: Sequence[str] = (),
    edges: Edges = None,
    wanted: Sequence[tuple[float, float]] = (),
    sent: bytes | None = None,
    whole: bool = False,
    finite: bool = True,
    quick: bool = False,
    runs_in: Runs | None = None,
):
    """Arrow function for one cell, or for batches of the first side when the second one is ``sent``. Self-contained, so executors need nothing but NumPy and Arrow."""
    by = list(by)
    most = SCORE_BLOCK_ROWS**2 if output in SCORE_OUTPUTS else BLOCK_ROWS**2

    once = {}

    def segments():
        """Ends, numbers of bins and first bin of all segments, as arrays made once."""
        import numpy as np

        if "segments" not in once:
            lows, highs, counts = (np.array(x) for x in zip(*edges))
            once["segments"] = lows, highs, counts, np.cumsum(counts) - counts
        return once["segments"]

    def interval_of(scores, lows, highs):
        """Number of the closed interval that holds each score, or -1."""
        import numpy as np

        k = np.maximum(np.searchsorted(lows, scores, "right") - 1, 0)
        return np.where((scores >= lows[k]) & (scores <= highs[k]), k, -1)

    def bin_of(scores):
        """Bin of each score over all segments, or -1; or the side of a threshold."""
        import numpy as np

        if not isinstance(edges, list):
            return (scores >= edges).astype(np.int64)
        lows, highs, counts, firsts = segments()
        k = interval_of(scores, lows, highs)
        low, count = lows[k], counts[k]
        width = np.where(highs[k] > low, highs[k] - low, 1.0)
        step = np.clip(np.floor((scores - low) * (count / width)), 0, count - 1)
        return np.where(k >= 0, firsts[k] + step, -1).astype(np.int64)

    def bin_starts():
        """Lower end of each bin: sums are taken from there, so that close scores keep their digits."""
        import numpy as np

        if not isinstance(edges, list):
            return np.zeros(2)
        lows, highs, counts, firsts = segments()
        spread = lambda x: np.repeat(x, counts)
        return spread(lows) + spread((highs - lows) / counts) * (np.arange(counts.sum()) - spread(firsts))

    def runs_of(column):
        """Order that puts equal labels together, the first place of each, and the labels in that order."""
        import numpy as np

        encoded = column.combine_chunks().dictionary_encode()
        codes = encoded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], codes[order][1:] != codes[order][:-1])))
        return order, starts, encoded.dictionary.take(encoded.indices.take(order[starts]))

    def count_identities(left, right):
        """Per left row the right labels of which some row scores at least the bar."""
        import numpy as np
        import pyarrow as pa

        a, b, bar = matrix(left, "vec"), matrix(right, "vec"), left.column("bar").to_numpy()
        order, starts, _ = runs_of(right.column("label"))
        b, found = b[order], np.empty(len(a), np.int64)
        step = max(1, 262_144 // len(b))
        for i in range(0, len(a), step):
            passed = tile_scores(a[i : i + step], b) >= bar[i : i + step, None]
            found[i : i + step] = np.logical_or.reduceat(passed, starts, axis=1).sum(axis=1)
        return pa.table({"id": left.column("id"), "n_at_least": found})

    def fuse(left, right):
        """Sums of scores over each left label: with ``fused`` their means' best right row per right label."""
        import numpy as np
        import pyarrow as pa

        order, starts, groups = runs_of(left.column("label"))
        a, b = matrix(left, "vec")[order], matrix(right, "vec")
        ends = np.append(starts[1:], len(a))
        if output == "fused":
            by_label, firsts, identities = runs_of(right.column("label"))
            b = b[by_label]
        parts, low, most_rows = [], 0, max(1, 1_048_576 // len(b))
        while low < len(starts):  # whole groups at a time
            high = max(low + 1, int(np.searchsorted(ends, starts[low] + most_rows, "right")))
            sums = np.zeros((high - low, len(b)))
            for i in range(starts[low], ends[high - 1], most_rows):  # a longer group in steps
                j = min(i + most_rows, ends[high - 1])
                own = np.maximum(starts[low:high], i)
                inside = (own < j) & (ends[low:high] > i)
                sums[inside] += np.add.reduceat(tile_scores(a[i:j], b), own[inside] - i, axis=0)
            rows = (ends - starts)[low:high]
            if output == "fused":
                sums = np.maximum.reduceat(sums / rows[:, None], firsts, axis=1)
            p, q = (x.ravel() for x in np.indices(sums.shape))
            columns = {"group": groups.take(pa.array(p + low))}
            if output == "fused":
                columns |= {"identity": identities.take(pa.array(q)), "score": sums.ravel()}
            else:
                columns |= {
                    "identity": right.column("label").combine_chunks().take(pa.array(q)),
                    "template": right.column("id").combine_chunks().take(pa.array(q)),
                    "total": sums.ravel(),
                    "n": rows[p].astype(np.int64),
                }
            parts.append(pa.table(columns))
            low = high
        return pa.concat_tables(parts)

    def matrix(table, name):
        column = table.column(name).combine_chunks()
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(table.num_rows, -1)

    def tile_scores(a, b):
        import numpy as np

        out = np.zeros((len(a), len(b)))
        for k in range(a.shape[1]):
            x, y = a[:, k, None], b[None, :, k]
            if kind == "dot":
                out += x * y
            elif kind == "l2":
                gap = x - y
                out += gap * gap
            else:
                out += np.abs(x - y)
        if finite and output != "problems" and not np.isfinite(out).all():
            raise ValueError("scores must be finite; a constant vector has no correlation, a zero one no cosine")
        if kind == "l2":
            return -np.sqrt(out)
        return out if kind == "dot" else -out

    def quick_scores(left, right, same_block, codes, grid, needed, counted, taken):
        """By scores in single precision: counts of all and of genuine pairs per bin of the grid (if ``counted``), with a bin
        more at each end for rounding. ``taken`` gets the exact scores and classes of the pairs in ``needed`` bins, tile by tile."""
        import numpy as np

        low, high, size = grid
        order = [np.lexsort((t.column("id").to_numpy(), c)) for t, c in zip((left, right), codes)]
        a, b = (matrix(t, "vec")[o] for t, o in zip((left, right), order))
        a_codes, b_codes = (c[o] for c, o in zip(codes, order))
        if same_block:  # a pair of equal ids is none
            ids = left.column("id").to_numpy()[order[0]]
            repeated = len(np.unique(ids)) < len(ids)
        if not (np.isfinite(a).all() and np.isfinite(b).all()):
            raise ValueError("scores must be finite; a constant vector has no correlation, a zero one no cosine")
        # the error of a sum of d products of vectors of length 1, in bins, must stay below half a bin
        width = a.shape[1]
        single = (width + 8) * 2.0**-24 * size / (high - low) + size * 2.0**-22 < 0.25
        number = np.float32 if single else np.float64
        x, y = a.astype(number), np.ascontiguousarray(b.T, number)
        scale = number(size / (high - low))
        shift = number(1 - low * size / (high - low))
        marked = np.zeros(size + 2, bool)
        marked[1:-1] = needed
        marked[0], marked[-1] = marked[1], marked[-2]
        looked, tally = marked.any(), np.zeros((2, size + 2), np.int64)
        n_rows, n_cols = QUICK_TILE
        for i in range(0, len(a), n_rows):
            own = a_codes[i : i + n_rows]
            for j in range(0, len(b), n_cols):
                other = b_codes[j : j + n_cols]
                if same_block and j + len(other) <= i + 1:
                    continue  # each pair stands once above the diagonal
                scores = x[i : i + n_rows] @ y[:, j : j + n_cols]
                scores *= scale
                scores += shift
                spots = scores.astype(np.int64)
                upper = same_block and (repeated or j < i + len(own))
                if upper:
                    above = np.arange(j, j + len(other))[None, :] > np.arange(i, i + len(own))[:, None]
                    above &= ids[i : i + len(own), None] != ids[None, j : j + len(other)]
                if counted:
                    tally[0] += np.bincount(spots[above] if upper else spots.ravel(), minlength=size + 2)
                    # rows are in order of labels: genuine pairs are rectangles
                    if own[0] <= other[-1] and other[0] <= own[-1]:
                        alike = []
                        for code in np.intersect1d(own, other):
                            if code >= 0:
                                r = slice(*np.searchsorted(own, (code, code + 1)))
                                c = slice(*np.searchsorted(other, (code, code + 1)))
                                alike.append(spots[r, c][above[r, c]] if upper else spots[r, c].ravel())
                        if alike:
                            tally[1] += np.bincount(np.concatenate(alike), minlength=size + 2)
                if looked:
                    found = np.take(marked, spots, mode="clip")
                    if upper:
                        found &= above
                    at = np.flatnonzero(found)
                    if len(at):
                        p, q = at // len(other) + i, at % len(other) + j
                        total, products = np.zeros(len(at)), np.ascontiguousarray((a[p] * b[q]).T)
                        for product in products:  # in index order
                            total += product
                        taken(total, (a_codes[p] == b_codes[q]) & (a_codes[p] >= 0))
        tally[:, 1] += tally[:, 0]
        tally[:, -2] += tally[:, -1]
        return tally[:, 1:-1]

    def near(low, high, intervals):
        """Bins of the usual grid that may hold scores of closed intervals."""
        import numpy as np

        size, marks = QUICK_BINS, np.zeros(QUICK_BINS + 1, np.int64)
        scaled = (np.array(intervals, float).reshape(-1, 2) - low) * (size / (high - low))
        np.add.at(marks, np.clip(np.floor(scaled[:, 0] - 0.5), 0, size - 1).astype(np.int64), 1)
        np.add.at(marks, np.clip(np.floor(scaled[:, 1] + 0.5), 0, size - 1).astype(np.int64) + 1, -1)
        return np.cumsum(marks)[:-1] > 0

    def quick_cell(key, left, right):
        """``bins`` and ``exact`` from few exact scores."""
        import numpy as np
        import pyarrow as pa

        coded = pa.chunked_array([*left.column("label").chunks, *right.column("label").chunks])
        codes = coded.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        codes = codes[: left.num_rows], codes[left.num_rows :]
        same_block = unordered and key[0].as_py() == key[1].as_py()
        score = lambda *how: quick_scores(left, right, same_block, codes, *how)
        usual = (*BOUNDED, QUICK_BINS)
        if output == "exact":
            lows, highs = (np.array(x) for x in zip(*wanted))
            add, made = exact_tally(lows, highs)
            score(usual, near(*BOUNDED, wanted), False, add)
            return made()
        if not isinstance(edges, list):
            needed = near(*BOUNDED, [(edges, edges)])
            counts = np.zeros((2, 2), np.int64)

            def decide(values, genuine):
                for side in (0, 1):
                    passed = (values >= edges) == bool(side)
                    counts[:, side] += passed.sum(), (passed & genuine).sum()

            tally = score(usual, needed, True, decide)
            at = np.searchsorted(np.flatnonzero(needed), np.arange(QUICK_BINS), "left") > 0
            for side in (0, 1):
                counts[:, side] += tally[:, ~needed & (at == bool(side))].sum(axis=1)
            return bin_counts(np.arange(2), counts[1], counts[0] - counts[1], np.zeros(2), np.zeros(2))
        if runs_in is None:
            add, made = bin_tally()
            score(usual, near(*BOUNDED, [e[:2] for e in edges]), False, add)
            return made()
        grid, runs = runs_in
        low, high, size = grid
        borders = low + (high - low) / size * np.arange(size + 1)
        needed = np.zeros(size, bool)
        for first, last in runs:
            needed[first : last + 1] = True
        add, made = bin_tally()
        tally = score(grid, needed, True, add)
        if not runs:
            used = np.flatnonzero(tally[0])
            return bin_counts(used, tally[1, used], (tally[0] - tally[1])[used], borders[used], borders[used + 1])
        gap = np.zeros(size, np.int64)
        for first, last in runs:
            gap[last + 1 :] += 1
        starts = np.array([0, *[last + 1 for _, last in runs]])
        ends = np.array([*[first for first, _ in runs], size])
        totals = [np.bincount(gap[~needed], weights=t[~needed], minlength=len(starts)).astype(np.int64) for t in tally]
        used = np.flatnonzero(totals[0])
        centre = ((borders[starts] + borders[ends]) / 2)[used]
        first_gap = sum(e[2] for e in edges)
        gaps = bin_counts(used + first_gap, totals[1][used], (totals[0] - totals[1])[used], centre, centre)
        return pa.concat_tables([made(), gaps])

    def bin_counts(bins, genuine, impostor, lowest, highest):
        import numpy as np
        import pyarrow as pa

        none = np.zeros(len(bins))
        columns = {"bin": np.asarray(bins, np.int64), "n_genuine": genuine, "n_impostor": impostor}
        columns |= {name: none for name in _BIN_VALUES} | {"lowest": lowest, "highest": highest}
        return pa.table(columns)

    def bin_tally():
        """Counts, sums, lowest and highest score per bin: a function that adds scores and their classes, and one that
        gives the table."""
        import numpy as np
        import pyarrow as pa

        refs = bin_starts()
        size = len(refs)
        tally = np.zeros((6, size))
        lowest, highest = np.full(size, np.inf), np.full(size, -np.inf)

        def add(values, genuine):
            place = bin_of(values)
            if (place < 0).any():
                kept = place >= 0
                place, values, genuine = place[kept], values[kept], genuine[kept]
            np.minimum.at(lowest, place, values)
            np.maximum.at(highest, place, values)
            values = values - refs[place]
            for row, side in enumerate((genuine, ~genuine)):
                spots, own = place[side], values[side]
                tally[row] += np.bincount(spots, minlength=size)
                tally[2 + row] += np.bincount(spots, weights=own, minlength=size)
                tally[4 + row] += np.bincount(spots, weights=own * own, minlength=size)

        def made():
            used = np.flatnonzero(np.isfinite(lowest))
            columns = dict(zip(("n_genuine", "n_impostor", *_BIN_VALUES[:4]), tally[:, used]))
            columns |= {"lowest": lowest[used], "highest": highest[used], "ref": refs[used]}
            counts = {name: columns[name].astype(np.int64) for name in ("n_genuine", "n_impostor")}
            return pa.table({"bin": used.astype(np.int64)} | columns | counts)

        return add, made

    def exact_tally(lows, highs):
        """Distinct scores in intervals: a function that adds scores and their classes, and one that gives the table."""
        import numpy as np
        import pyarrow as pa

        parts, held = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))], [0, 1 << 22]

        def merge():
            values, own, other = (np.concatenate(x) for x in zip(*parts))
            scores, inverse = np.unique(values, return_inverse=True)
            sums = [np.bincount(inverse, weights=n, minlength=len(scores)).astype(np.int64) for n in (own, other)]
            parts[:] = [(scores, *sums)]
            held[:] = len(scores), max(1 << 22, 2 * len(scores))

        def add(values, genuine):
            kept = interval_of(values, lows, highs) >= 0
            own = genuine[kept].astype(np.int64)
            parts.append((values[kept], own, 1 - own))
            held[0] += len(own)
            if held[0] > held[1]:
                merge()

        def made():
            merge()
            scores, own, other = parts[0]
            return pa.table({"bin": interval_of(scores, lows, highs), "score": scores, "n_genuine": own, "n_impostor": other})

        return add, made

    def exact_table(place, values, genuine):
        import numpy as np
        import pyarrow as pa

        scores, first, inverse = np.unique(values, return_index=True, return_inverse=True)
        own = np.bincount(inverse, weights=genuine, minlength=len(scores)).astype(np.int64)
        total = np.bincount(inverse, minlength=len(scores)).astype(np.int64)
        return pa.table({"bin": place[first], "score": scores, "n_genuine": own, "n_impostor": total - own})

    def run_batches(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        whole = pa.ipc.open_stream(sent).read_all()
        for batch in batches:
            left = pa.Table.from_batches([batch])
            runs = left.group_by(by).aggregate([]).to_pylist() if by else [{}]
            for values in runs:
                a, b = left, whole
                for name, value in values.items():
                    a, b = a.filter(pc.equal(a.column(name), value)), b.filter(pc.equal(b.column(name), value))
                # at most a block of scores at a time
                step = max(1, most // max(1, b.num_rows))
                for start in range(0, a.num_rows, step):
                    key = (0, 1, *[pa.scalar(values[name]) for name in by])
                    yield from run(key, a.slice(start, step), b).to_batches()

    def run(key, left, right):
        import pyarrow as pa

        cell = score_cell(key, left, right)
        for place, name in enumerate(by):
            column = pa.array([key[2 + place].as_py()] * cell.num_rows, left.schema.field(name).type)
            cell = cell.add_column(place, name, column)
        return cell

    def score_cell(key, left, right):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if left.num_rows == 0 or right.num_rows == 0:
            return pa.table({f.name: pa.array([], f.type) for f in empty_schema(left, right, pa)})
        if output in ("fused", "partial"):
            return fuse(left, right)
        if output == "count" and whole:
            return count_identities(left, right)
        if quick:
            return quick_cell(key, left, right)
        a, b = matrix(left, "vec"), matrix(right, "vec")
        left_ids = left.column("id").to_numpy()
        right_ids = right.column("id").to_numpy()
        codes = pa.chunked_array(
            [*left.column("label").chunks, *right.column("label").chunks]
        ).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        left_codes, right_codes = codes[: len(a)], codes[len(a):]
        same_block = unordered and key[0].as_py() == key[1].as_py()
        bar = left.column("bar").to_numpy() if output in ("count", "hits") else None
        if output == "best":
            # right rows in label order: the first maximum is the smallest label among ties
            order = np.argsort(right.column("label").to_numpy(), kind="stable")
            b = b[order]
        pieces = []
        if output == "bins":
            add, made = bin_tally()
        if output in ("range", "problems"):
            least, greatest, counts = np.inf, -np.inf, np.zeros(3, np.int64)
        if output == "exact":
            if "wanted" not in once:
                once["wanted"] = tuple(np.array(x) for x in zip(*wanted))
            lows, highs = once["wanted"]
        for i in range(0, len(a), 256):
            for j in range(0, len(b), 1024):
                rows, cols = slice(i, i + 256), slice(j, j + 1024)
                scores = tile_scores(a[rows], b[cols])
                if output == "count":
                    passed = (scores >= bar[rows, None]).sum(axis=1)
                    pieces.append((left_ids[rows], passed))
                    continue
                if output == "best":
                    top = scores.argmax(axis=1)
                    pieces.append((left_ids[rows], scores[np.arange(len(top)), top], order[top + j]))
                    continue
                if output == "hits":
                    p, q = np.nonzero(scores >= bar[rows, None])
                    pieces.append((p + i, q + j))
                    continue
                if same_block:
                    p, q = np.nonzero(left_ids[rows, None] < right_ids[None, cols])
                else:
                    p, q = (x.ravel() for x in np.indices(scores.shape))
                values = scores[p, q]
                if output == "range":
                    if len(values):
                        least, greatest = min(least, values.min()), max(greatest, values.max())
                    continue
                if output in ("histogram", "bins", "exact", "problems"):
                    genuine = left_codes[p + i] == right_codes[q + j]
                    if output == "problems":
                        counts += ((~np.isfinite(values)).sum(), genuine.sum(), (~genuine).sum())
                        continue
                    if output == "histogram":
                        pieces.append((values, genuine))
                        continue
                    if output == "exact":
                        place = interval_of(values, lows, highs)
                        kept = place >= 0
                        pieces.append((place[kept], values[kept], genuine[kept]))
                        continue
                    add(values, genuine)
                else:
                    pieces.append((p + i, q + j, values))
        if output == "bins":
            return made()
        if output == "range":
            return pa.table({"low": [least], "high": [greatest]}) if least <= greatest else pa.table(
                {f.name: pa.array([], f.type) for f in empty_schema(left, right, pa)}
            )
        if output == "problems":
            return pa.table({name: [int(c)] for name, c in zip(("n_not_finite", "n_genuine", "n_impostor"), counts)})
        joined = [np.concatenate(part) for part in zip(*pieces)]
        if output == "count":
            ids, inverse = np.unique(joined[0], return_inverse=True)
            counts = np.bincount(inverse, weights=joined[1]).astype(np.int64)
            return pa.table({"id": ids, "n_at_least": counts})
        if output == "best":
            taken = pc.take(right.column("label").combine_chunks(), pa.array(joined[2]))
            return pa.table({"id": joined[0], "score": joined[1], "label": taken})
        if output == "hits":
            hit = pa.table(
                {
                    "id": left_ids[joined[0]],
                    "label": pc.take(right.column("label").combine_chunks(), pa.array(joined[1])),
                }
            )
            return hit.group_by(["id", "label"]).aggregate([])
        if output == "exact":
            return exact_table(*joined)
        if output == "histogram":
            scores, inverse = np.unique(joined[0], return_inverse=True)
            genuine = np.bincount(inverse, weights=joined[1], minlength=len(scores)).astype(np.int64)
            total = np.bincount(inverse, minlength=len(scores)).astype(np.int64)
            return pa.table({"score": scores, "n_genuine": genuine, "n_impostor": total - genuine})
        p, q, values = joined
        first_ids, second_ids = left_ids[p], right_ids[q]
        first = pc.take(left.column("label").combine_chunks(), pa.array(p))
        second = pc.take(right.column("label").combine_chunks(), pa.array(q))
        if unordered:
            swap = first_ids > second_ids
            flags = pa.array(swap)
            first, second = pc.if_else(flags, second, first), pc.if_else(flags, first, second)
            first_ids, second_ids = np.where(swap, second_ids, first_ids), np.where(swap, first_ids, second_ids)
        return pa.table(
            {"a_id": first_ids, "b_id": second_ids, "a_label": first, "b_label": second, "score": values}
        )

    def empty_schema(left, right, pa):
        ids, labels = left.schema.field("id").type, right.schema.field("label").type
        groups = left.schema.field("label").type
        longs = lambda *names: [(n, pa.int64()) for n in names]
        doubles = lambda *names: [(n, pa.float64()) for n in names]
        shapes = {
            "count": [("id", ids), *longs("n_at_least")],
            "hits": [("id", ids), ("label", labels)],
            "best": [("id", ids), *doubles("score"), ("label", labels)],
            "histogram": [*doubles("score"), *longs("n_genuine", "n_impostor")],
            "exact": [*longs("bin"), *doubles("score"), *longs("n_genuine", "n_impostor")],
            "range": doubles("low", "high"),
            "problems": longs("n_not_finite", "n_genuine", "n_impostor"),
            "bins": longs("bin", "n_genuine", "n_impostor") + doubles(*_BIN_VALUES),
            "fused": [("group", groups), ("identity", labels), *doubles("score")],
            "partial": [("group", groups), ("identity", labels), ("template", right.schema.field("id").type)]
            + [*doubles("total"), *longs("n")],
            "pairs": [("a_id", ids), ("b_id", right.schema.field("id").type), ("a_label", labels), ("b_label", labels)]
            + doubles("score"),
        }
        return pa.schema(shapes[output])

    return run if sent is None else run_batches


_KINDS = {"cosine": "dot", "pearson": "dot", "euclidean": "l2", "manhattan": "l1"}


def grid_scores(
    left: DataFrame,
    right: DataFrame | None,
    method: str = "cosine",
    output: str = "pairs",
    is_prepared: bool = False,
    by: Sequence[str] = (),
    edges: Edges = None,
    wanted: Sequence[tuple[float, float]] = (),
    whole: bool = False,
    finite: bool = True,
    quick: bool = False,
    runs: Runs | None = None,
) -> DataFrame:
    """Score every pair of ``left`` and ``right`` (columns ``id, label, vec``).

    ``right=None`` scores each unordered pair of ``left`` once, smaller id first. ``output``:
    ``pairs`` one row per pair; ``histogram`` distinct scores with genuine and impostor counts per cell
    (sum them per score); ``count`` per left id the right rows scoring at least ``left.bar``; ``hits``
    the right labels doing so; ``best`` the best right rows per piece of the right side; ``bins`` counts, sums from the bin's
    start, lowest and highest score per bin of ``edges``; ``exact`` the histogram inside the ``wanted`` closed intervals;
    ``range`` the lowest and highest score; ``problems`` counts of scores that are not finite and of both classes. Only
    rows that agree on ``by`` (a run or seed) are compared.

    ``whole`` keeps the right rows of one label in one cell, so that ``count`` counts labels; with ``fused`` the left ones
    too, and cells give the mean over the rows of a left label (``group``) of the best right row per right label
    (``identity``); no label may have more rows than fit a cell. ``partial`` gives sums per left label and right row.
    Scores must be ``finite``, unless that is false.

    ``quick`` makes ``bins`` and ``exact`` of a bounded dot product from exact scores of few pairs; bins of segments and
    wanted intervals equal those without it. With ``runs`` the other bins of their grid are counted by rounded scores, in a
    row per gap between runs with its centre as ``lowest``; ``edges`` must hold the scores of the runs. Without any run each bin
    of the grid is such a row, with its own ends.
    """
    by = list(by)
    if not is_prepared:
        left = left.withColumn("vec", prepared(F.col("vec"), method))
        right = None if right is None else right.withColumn("vec", prepared(F.col("vec"), method))
    unordered = right is None
    ids, labels = left.schema["id"].dataType, left.schema["label"].dataType
    other_ids = ids if unordered else right.schema["id"].dataType
    other_labels = labels if unordered else right.schema["label"].dataType
    longs = lambda *names: [(n, T.LongType()) for n in names]
    doubles = lambda *names: [(n, T.DoubleType()) for n in names]
    shapes = {
        "pairs": [("a_id", ids), ("b_id", other_ids), ("a_label", labels), ("b_label", labels), *doubles("score")],
        "histogram": [*doubles("score"), *longs("n_genuine", "n_impostor")],
        "exact": [*longs("bin"), *doubles("score"), *longs("n_genuine", "n_impostor")],
        "range": doubles("low", "high"),
        "problems": longs("n_not_finite", "n_genuine", "n_impostor"),
        "bins": longs("bin", "n_genuine", "n_impostor") + doubles(*_BIN_VALUES),
        "count": [("id", ids), *longs("n_at_least")],
        "hits": [("id", ids), ("label", other_labels)],
        "best": [("id", ids), *doubles("score"), ("label", other_labels)],
        "fused": [("group", labels), ("identity", other_labels), *doubles("score")],
        "partial": [("group", labels), ("identity", other_labels), ("template", other_ids), *doubles("total"), *longs("n")],
    }
    keyed = [T.StructField(c, left.schema[c].dataType) for c in by]
    schema = T.StructType([*keyed, *[T.StructField(n, t) for n, t in shapes[output]]])
    if unordered and output == "pairs" and not by:
        stored = stored_blocks.store(left.select("id", "label", "vec"))
        return stored_blocks.pairs(stored, left.sparkSession, schema, _KINDS[method], finite)
    if isinstance(edges, Sequence):  # one segment may stand alone
        segments = [edges] if edges and isinstance(edges[0], float) else list(edges)
    else:
        segments = edges
    cell = lambda sent=None: _cell_function(
        _KINDS[method], output, unordered, by, segments, list(wanted), sent, whole, finite, quick, runs
    )
    extra = ["bar"] if output in ("count", "hits") else []
    if not unordered and output != "fused":
        size = right.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
        if size["n"] <= SENT_ROWS and size["n"] * (size["d"] or 0) <= SENT_VALUES:
            sent = _packed(right.select(*by, "id", "label", "vec"))
            return left.select(*by, "id", "label", "vec", *extra).mapInArrow(cell(sent), schema)
    slots = parallelism(left.sparkSession)
    left_rows, n_runs = _run_sizes(left, by)
    if unordered:
        # b blocks make b(b+1)/2 cells
        blocks = max(
            1,
            math.ceil(left_rows / _block_rows(output, quick)),
            min(math.ceil(math.sqrt(2 * slots)), left_rows // SMALL_BLOCK_ROWS),
        )
        cell_count = blocks * (blocks + 1) // 2
        own = left.withColumn("__own", _block(F.col("id"), blocks))
        lefts = own.withColumn("__r", F.explode(F.sequence(F.col("__own"), F.lit(blocks - 1))))
        lefts = lefts.withColumnRenamed("__own", "__l")
        rights = own.withColumn("__l", F.explode(F.sequence(F.lit(0), F.col("__own"))))
        rights = rights.withColumnRenamed("__own", "__r")
    else:
        left_blocks, right_blocks = _block_counts(left_rows, _run_sizes(right, by)[0], slots, _block_rows(output, quick))
        cell_count = left_blocks * right_blocks
        left_key, right_key = "label" if output == "fused" else "id", "label" if whole else "id"
        lefts = left.withColumn("__l", _block(F.col(left_key), left_blocks)).withColumn(
            "__r", F.explode(F.sequence(F.lit(0), F.lit(right_blocks - 1)))
        )
        rights = right.withColumn("__r", _block(F.col(right_key), right_blocks)).withColumn(
            "__l", F.explode(F.sequence(F.lit(0), F.lit(left_blocks - 1)))
        )
    kept = ["__l", "__r", *by, "id", "label", "vec"]
    lefts = lefts.select(*kept, *extra)
    # New attribute ids: the two sides may come from the same table.
    fresh = rights.select(*[F.col(c).alias(c) for c in kept])
    # A stated number of partitions: cells are few bytes and much work, so they must not be merged.
    place = ["__l", "__r", *by]
    tasks = max(slots, min(2 * cell_count * n_runs, MOST_TASKS))
    cells = lefts.repartition(tasks, *place).groupBy(*place).cogroup(fresh.repartition(tasks, *place).groupBy(*place))
    return cells.applyInArrow(cell(), schema)


def label_scores(df: DataFrame, method: str = "cosine") -> DataFrame:
    """``pairs`` of rows with the same label; scores need not be finite."""
    ready = df.select("id", "label", prepared(F.col("vec"), method).alias("vec"))
    ids, labels = (df.schema[c].dataType for c in ("id", "label"))
    names = [("a_id", ids), ("b_id", ids), ("a_label", labels), ("b_label", labels), ("score", T.DoubleType())]
    schema = T.StructType([T.StructField(n, t) for n, t in names])
    return stored_blocks.pairs(stored_blocks.store_by_label(ready), df.sparkSession, schema, _KINDS[method], False)


def score_histogram(
    left: DataFrame, right: DataFrame | None, method: str = "cosine", by: Sequence[str] = ()
) -> DataFrame:
    """Distinct scores of all pairs with ``n_genuine`` and ``n_impostor``."""
    cells = grid_scores(left, right, method, output="histogram", by=by)
    return cells.groupBy(*by, "score").agg(
        F.sum("n_genuine").alias("n_genuine"), F.sum("n_impostor").alias("n_impostor")
    )
