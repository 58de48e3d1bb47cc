"""Exact similarity join of documents on word n-grams (Jaccard), and its groups.

Equal sets form a class first. Two similar sets share a shingle among their rarest few (prefix rule), so classes
meet by those shingles only. Where many classes meet, each is compared with two of them; what that leaves in
different groups is compared in size-banded tiles, where bit counts of hashed bitmaps bound the overlap from above.
Every surviving pair is decided by intersecting the sorted sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from probeline.llm.common import DOCUMENT_COLUMNS, batch, blank_words, lean, mixed, slices, stored, utf8, word_hashes
from probeline.llm.graph import components

#: Shingles in this many sets of one slice of texts are counted over all slices; the most frequent ones go last in
#: the order of each set. This only orders: any order gives the same pairs.
LOCAL_FREQUENT = 2
FREQUENT = 65_536
#: Rows of a frequent shingle that one task should hold, and members of a meeting compared all with all.
SPLIT_ROWS = 50_000
SMALL = 4
#: Members of a tile.
TILE = 2048


@dataclass(frozen=True)
class Measure:
    """Shingles of ``words`` words; sets link when ``whole * intersection >= share * union``."""

    words: int = 5
    share: int = 80
    whole: int = 100

    def prefix(self, n: int) -> int:
        return n - -(-self.share * n // self.whole) + 1

    def linked(self, inter: int, a: int, b: int) -> bool:
        return self.whole * inter >= self.share * (a + b - inter)

    def sizes_fit(self, a: Column, b: Column) -> Column:
        return F.least(a, b) * self.whole >= F.greatest(a, b) * self.share


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (unsigned 64-bit)."""
    codes, distinct, before = blank_words(data, offsets)
    hashes = word_hashes(distinct).view(np.uint64)[codes] if len(codes) else np.zeros(0, np.uint64)
    n = max(0, len(hashes) - words + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(words):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n + k]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            one = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for h in hashes[a:b]:
                    one = one * np.uint64(0x9E3779B97F4A7C15) + h
                out.append(mixed(np.array([one ^ np.uint64(0x5851F42D4C957F2D)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(own: np.ndarray) -> int | None:
    """Signed 64-bit digest of a set; null for an empty one."""
    if not len(own):
        return None
    digest = xxhash.xxh3_64_intdigest(own.tobytes())
    return digest - (1 << 64) if digest >> 63 else digest


def bitmap(own: np.ndarray) -> np.ndarray:
    """Parity bitmap of at least two bits per element; folding its halves together gives that of half the width."""
    width = max(64, 1 << max(0, 2 * len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def _sets(rows: pa.RecordBatch, words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    data, offsets = utf8(rows.column("text"))
    for low, high in slices(offsets):
        own = offsets[low : high + 1]
        yield low, shingle_sets(data[own[0] : own[-1]], own - own[0], words)


def set_table(docs: DataFrame, measure: Measure) -> DataFrame:
    """Per document ``doc_id, text_hash, n, class, bits``; ``frequent`` of a slice's rows
    together has the slice's frequent shingles."""
    found = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())]))
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("text_hash", pa.int64()),
            ("n", pa.int64()),
            ("class", pa.int64()),
            ("bits", pa.binary()),
            ("frequent", found),
        ]
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for low, sets in _sets(rows, measure.words):
                every = np.sort(np.concatenate(sets))
                edge = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1], [True])))[: len(every) + 1]
                counts = np.diff(edge)
                often = np.flatnonzero(counts >= LOCAL_FREQUENT)
                hot = [{"h": int(h), "n": int(n)} for h, n in zip(every[edge[often]].view(np.int64), counts[often])]
                yield batch(
                    {
                        "doc_id": rows.column("doc_id")[low : low + len(sets)],
                        "text_hash": rows.column("text_hash")[low : low + len(sets)],
                        "n": [len(s) for s in sets],
                        "class": [class_of(s) for s in sets],
                        "bits": [bitmap(s).tobytes() if len(s) else None for s in sets],
                        "frequent": [hot[k :: len(sets)] for k in range(len(sets))],
                    },
                    schema,
                )

    ddl = "doc_id bigint, text_hash bigint, n bigint, class bigint, bits binary, frequent array<struct<h:bigint,n:bigint>>"
    return docs.mapInArrow(lean(build), ddl)


def frequent_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most ``FREQUENT`` hashes in order, and their counts."""
    listed = sets.select(F.explode("frequent").alias("f")).groupBy("f.h").agg(F.sum("f.n").alias("n"))
    top = listed.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    hashes = top.column("h").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], top.column("n").to_numpy()[order]


def prefix_rows(docs: DataFrame, measure: Measure, hashes: np.ndarray, counts: np.ndarray) -> DataFrame:
    """``token, salt, class, n``: the rarest shingles of each set, enough that linked sets share one."""
    schema = pa.schema([("token", pa.int64()), ("salt", pa.int32()), ("class", pa.int64()), ("n", pa.int32())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for _, sets in _sets(rows, measure.words):
                tokens, salts, classes, sizes, seen = [], [], [], [], set()
                for own in sets:
                    name = class_of(own)
                    if name is None or name in seen:
                        continue
                    seen.add(name)
                    at = np.searchsorted(hashes, own)
                    known = np.zeros(len(own), bool)
                    inside = at < len(hashes)
                    known[inside] = hashes[at[inside]] == own[inside]
                    take = measure.prefix(len(own))
                    weight = np.zeros(len(own), np.int64)
                    weight[known] = counts[at[known]]
                    order = np.argsort(weight, kind="stable")[:take] if known.any() else np.arange(take)
                    split = weight[order] // SPLIT_ROWS + 1
                    tokens.append(own[order])
                    salts.append(np.where(split > 1, name % split + 1, 0).astype(np.int32))  # 0: not split
                    classes.append(np.full(len(order), name))
                    sizes.append(np.full(len(order), len(own), np.int32))
                if tokens:
                    yield batch(
                        {
                            "token": np.concatenate(tokens).view(np.int64),
                            "salt": np.concatenate(salts),
                            "class": np.concatenate(classes),
                            "n": np.concatenate(sizes),
                        },
                        schema,
                    )

    return docs.select("text").mapInArrow(lean(emit), "token bigint, salt int, class bigint, n int")


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token, salt and class to ``kind, a, na, b, nb, token``: pairs to compare (0) and members of
    meetings with more than a few classes (1, or 2 where other tasks hold members too). A long meeting is passed in pieces with its first two members kept."""
    schema = pa.schema(
        [("kind", pa.int32()), ("a", pa.int64()), ("na", pa.int32()), ("b", pa.int64()), ("nb", pa.int32()), ("token", pa.int64())]
    )
    held: list[np.ndarray] | None = None  # rows of the last, perhaps unfinished meeting
    pivots: list[np.ndarray] | None = None  # set while a long meeting is passed in pieces

    def star(token, salt, name, n, first: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        """Members of each meeting against its first and last one."""
        member = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
        low, high = np.repeat(first, size), np.repeat(first + size - 1, size)
        a, b = np.concatenate((low, high)), np.concatenate((member, member))
        own = name[a] != name[b]
        return rows(name[a[own]], n[a[own]], name[b[own]], n[b[own]], token[member], name[member], n[member], salt[member])

    def rows(a, na, b, nb, token, member, n, salt) -> pa.RecordBatch:
        swap = a > b
        pair = {"a": np.where(swap, b, a), "na": np.where(swap, nb, na), "b": np.where(swap, a, b), "nb": np.where(swap, na, nb)}
        pad = np.zeros(len(token), np.int64)
        return batch(
            {
                "kind": np.concatenate((np.zeros(len(a), np.int32), np.where(salt > 0, 2, 1).astype(np.int32))),
                "a": np.concatenate((pair["a"], member)),
                "na": np.concatenate((pair["na"], n)),
                "b": np.concatenate((pair["b"], pad)),
                "nb": np.concatenate((pair["nb"], pad)),
                "token": np.concatenate((np.zeros(len(a), np.int64), token)),
            },
            schema,
        )

    def finished(token: np.ndarray, salt: np.ndarray, name: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.concatenate(([True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])))
        fresh = new | np.concatenate(([True], name[1:] != name[:-1]))
        token, salt, name, n, new = token[fresh], salt[fresh], name[fresh], n[fresh], new[fresh]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(token)))
        none = np.zeros(0, np.int64)
        for g in range(2, SMALL + 1):
            own = first[(size == g) & (salt[first] == 0)]
            if len(own):
                x, y = np.triu_indices(g, 1)
                a, b = (own[:, None] + x).ravel(), (own[:, None] + y).ravel()
                yield rows(name[a], n[a], name[b], n[b], none, none, none, none)
        large = (size > SMALL) | (salt[first] > 0)
        if large.any():
            yield star(token, salt, name, n, first[large], size[large])

    for piece in batches:
        now = [piece.column(c).to_numpy() for c in ("token", "salt", "class", "n")]
        if held is not None:
            now = [np.concatenate((h, x)) for h, x in zip(held, now)]
            held = None
        if not len(now[0]):
            continue
        token, salt = now[0], now[1]
        cut = int(np.flatnonzero((token != token[-1]) | (salt != salt[-1]))[-1]) + 1 if (token[0], salt[0]) != (token[-1], salt[-1]) else 0
        if cut:
            yield from finished(*[x[:cut] for x in now])
        held = [x[cut:] for x in now]
        if len(held[0]) > 4 * SPLIT_ROWS:  # pass on what is there; its first two members stand for it
            yield from finished(*held)
            _, first = np.unique(held[2], return_index=True)
            held = [x[np.sort(first)[:2]] for x in held]
    if held is not None and len(held[0]):
        yield from finished(*held)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


def may_link(pairs: DataFrame, classes: DataFrame, measure: Measure) -> DataFrame:
    """``a, b`` of the pairs whose bitmaps allow a link: differing bits each come from an element of one set alone."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            n, keep = rows.column("n").to_numpy(), []
            for x, y, both in zip(rows.column("x"), rows.column("y"), n.tolist()):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                words = min(len(x), len(y))
                differ = int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())
                bound = (both - differ) // 2
                keep.append(bound * measure.whole >= (both - bound) * measure.share)
            chosen = rows.filter(pa.array(keep, pa.bool_()))
            yield batch({"a": chosen.column("a"), "b": chosen.column("b")}, schema)

    bits = classes.select("class", "bits")
    joined = pairs.join(bits.selectExpr("class AS a", "bits AS x"), "a").join(bits.selectExpr("class AS b", "bits AS y"), "b")
    return joined.selectExpr("a", "b", "na + nb AS n", "x", "y").mapInArrow(lean(compare), "a bigint, b bigint")


def _tile_pairs(measure: Measure, sparing: bool):
    """Reads tiles, rows sorted by token, tile and size, to pairs of different groups whose bitmaps allow a link.

    Members are in order of size, so those that can link to one are a band next to it. With ``sparing``, pairs that
    are almost surely links (``likely``) join their groups for the rest of the tile; what that spares is right if
    they all prove to be links.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("likely", pa.bool_())])

    def pairs(name: np.ndarray, n: np.ndarray, comp: np.ndarray, slot: np.ndarray, raw: list) -> list[tuple[int, int, bool]]:
        if (comp == comp[0]).all():
            return []
        across = (slot != slot[0]).any()  # a tile of two slots compares one with the other only
        bits = [np.frombuffer(r, "<u8") for r in raw]
        width = np.array([len(x) for x in bits])
        sheets = {}
        for w in np.unique(width).tolist():
            near = np.flatnonzero((width == w) | (width == 2 * w))
            sheet = np.zeros((len(bits), w), np.uint64)
            sheet[near] = [folded(bits[k], w) for k in near]
            sheets[w] = sheet
        last = np.searchsorted(n, n * measure.whole // measure.share, "right")
        group, out, unsure = np.unique(comp, return_inverse=True)[1], [], []
        for k in range(len(n)):
            other = np.arange(k + 1, last[k])
            other = other[(group[other] != group[k]) & ((slot[other] != slot[k]) | (not across))]
            if not len(other):
                continue
            w = int(width[k])
            differ = np.bitwise_count(sheets[w][other] ^ sheets[w][k]).sum(axis=1, dtype=np.int64)
            both = n[k] + n[other]
            bound = (both - differ) // 2
            fit = bound * measure.whole >= (both - bound) * measure.share
            other, differ, both = other[fit], differ[fit], both[fit]
            if not sparing:
                out += [(k, j, False) for j in other.tolist()]
                continue
            true = np.log1p(-np.minimum(2 * differ / (64 * w), 0.999)) / math.log1p(-2 / (64 * w))  # likely difference
            most = true * (1 + 4 * math.sqrt(2 / (64 * w))) + 2  # four deviations of colliding bits above
            likely = (both - most) / (both + most) >= measure.share / measure.whole
            unsure += [(k, j) for j in other[~likely].tolist()]
            for j in other[likely].tolist():
                if group[j] != group[k]:
                    out.append((k, j, True))
                    group[group == group[j]] = group[k]
        return out + [(k, j, False) for k, j in unsure if group[k] != group[j]]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def tiles(rows: pa.Table, finish: bool) -> tuple[pa.RecordBatch, pa.Table]:
            keys = np.column_stack([rows.column(c).to_numpy() for c in ("token", "low", "high")])
            edge = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            cuts = [0, *edge.tolist()] + [rows.num_rows] * finish
            name, n, comp, slot = (rows.column(c).to_numpy() for c in ("class", "n", "comp", "slot"))
            raw = rows.column("bits").to_pylist()
            found: list[tuple[int, int, bool]] = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                found += [
                    (min(x, y), max(x, y), likely)
                    for i, j, likely in pairs(name[a:b], n[a:b].astype(np.int64), comp[a:b], slot[a:b], raw[a:b])
                    for x, y in [(int(name[a + i]), int(name[a + j]))]
                    if x != y
                ]
            made = {c: [pair[k] for pair in found] for k, c in enumerate(schema.names)}
            return batch(made, schema), rows.slice(cuts[-1])

        for piece in batches:
            rows = pa.Table.from_batches([piece])
            if held is not None:
                rows = pa.concat_tables([held, rows]).combine_chunks()
            if rows.num_rows:
                made, held = tiles(rows, False)
                yield made
        if held is not None and held.num_rows:
            yield tiles(held, True)[0]

    return compare


def remaining_pairs(members: DataFrame, groups: DataFrame, classes: DataFrame, measure: Measure, sparing: bool) -> DataFrame:
    """Pairs of classes that share a token but no group, as the bitmaps allow; ``members`` is ``token, class, n``."""
    grouped = members.join(groups.withColumnRenamed("node", "class"), "class", "left").withColumn(
        "comp", F.coalesce("comp", "class")
    )
    mixed_up = (
        grouped.groupBy("token")
        .agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count(F.lit(1)).alias("members"))
        .where("least <> most")
        .select("token", F.ceil(F.col("members") / TILE).cast("int").alias("slots"))
    )
    rows = (
        grouped.join(mixed_up, "token")
        .join(classes.select("class", "bits"), "class")
        .withColumn("slot", F.pmod(F.hash("class"), F.col("slots")))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    )
    tile = [F.least("slot", "with").alias("low"), F.greatest("slot", "with").alias("high")]
    placed = rows.select("token", *tile, "n", "class", "comp", "slot", "bits")
    dealt = placed.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high", "n", "class")
    return dealt.mapInArrow(lean(_tile_pairs(measure, sparing)), "a bigint, b bigint, likely boolean").distinct()


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, measure: Measure) -> DataFrame:
    """Links ``a, b`` among the pairs, by exact intersection of the sorted sets of one document of each class."""
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    needed = classes.join(wanted, "class").select(F.col("first.doc_id").alias("d"), F.col("first.text_hash").alias("t"))
    texts = docs.join(needed, docs["doc_id"].eqNullSafe(F.col("d")) & docs["text_hash"].eqNullSafe(F.col("t")), "left_semi")
    one = pa.schema([("class", pa.int64()), ("shingles", pa.binary())])

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for rows in batches:
            for _, sets in _sets(rows, measure.words):
                names = [class_of(s) for s in sets]
                keep = [k for k, name in enumerate(names) if name not in seen and not seen.add(name)]
                yield batch({"class": [names[k] for k in keep], "shingles": [sets[k].tobytes() for k in keep]}, one)

    sets = texts.select("text").mapInArrow(lean(arrays), "class bigint, shingles binary").dropDuplicates(["class"])
    sets = stored(sets, "sets")
    link = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keep = []
            for x, y in zip(rows.column("x"), rows.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((x, y)))
                keep.append(measure.linked(int((both[1:] == both[:-1]).sum()), len(x), len(y)))
            chosen = rows.filter(pa.array(keep, pa.bool_()))
            yield batch({"a": chosen.column("a"), "b": chosen.column("b")}, link)

    joined = pairs.join(sets.selectExpr("class AS b", "shingles AS y"), "b").join(sets.selectExpr("class AS a", "shingles AS x"), "a")
    return joined.select("a", "b", "x", "y").mapInArrow(lean(decide), "a bigint, b bigint")


def similar_groups(docs: DataFrame, measure: Measure = Measure()) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id`` of each document.

    ``component_id`` is the smallest ``doc_id`` reachable by links, the document itself included. A null, empty
    or wordless text has an empty set and is alone. Equal and repeated rows share a group; ids that are null are
    passed over unless a group has no other. Other columns are ignored.
    """
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    sets = stored(set_table(texts, measure), "set_table")
    worded = sets.where("class IS NOT NULL")
    classes = stored(
        worded.groupBy("class").agg(
            F.min(F.struct("doc_id", "text_hash")).alias("first"),
            F.min("doc_id").alias("least_id"),
            F.max("n").cast("int").alias("n"),
            F.first("bits").alias("bits"),
        ),
        "classes",
    )
    ordered = prefix_rows(texts, measure, *frequent_shingles(sets)).repartition("token", "salt")
    meetings = stored(
        ordered.sortWithinPartitions("token", "salt", "class").mapInArrow(
            _meetings, "kind int, a bigint, na int, b bigint, nb int, token bigint"
        ),
        "meetings",
    )
    members = meetings.where("kind > 0").select("kind", "token", F.col("a").alias("class"), F.col("na").alias("n")).distinct()
    # the parts of a split meeting are joined by its smallest member
    split = members.where("kind = 2")
    heads = split.groupBy("token").agg(F.min(F.struct("class", "n")).alias("h"))
    across = split.join(heads, "token").where("class <> h.class").selectExpr("h.class AS a", "h.n AS na", "class AS b", "n AS nb")
    pairs = meetings.where("kind = 0").select("a", "na", "b", "nb").union(across)
    pairs = pairs.where(measure.sizes_fit(F.col("na"), F.col("nb"))).distinct()
    known = stored(may_link(pairs, classes, measure), "pairs")
    links = stored(verified(known, texts, classes, measure), "links")
    members = members.drop("kind")
    for sparing in (True, False):
        found = stored(remaining_pairs(members, components(links), classes, measure, sparing), "tile_pairs")
        rest = stored(found.select("a", "b").join(known, ["a", "b"], "left_anti"), "rest")
        if not rest.isEmpty():
            links = stored(links.union(verified(rest, texts, classes, measure)), "links")
            known = known.union(rest)
        # where a likely link proved to be none, the meeting is compared again without sparing
        wrong = stored(found.where("likely").join(links, ["a", "b"], "left_anti").select(F.col("a").alias("class")), "wrong")
        if wrong.isEmpty():
            break
        members = members.join(members.join(wrong, "class", "left_semi").select("token").distinct(), "token", "left_semi")
    groups = classes.join(components(links).withColumnRenamed("node", "class"), "class", "left").select(
        "class", "least_id", F.coalesce("comp", "class").alias("comp")
    )
    least = groups.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    named = groups.join(least, "comp").select("class", "component_id")
    found = sets.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "class").join(named, "class", "left")
    own = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "text_hash", "n_shingles", own.alias("component_id"))


def without_near_duplicates(docs: DataFrame, measure: Measure = Measure()) -> DataFrame:
    """The columns of documents; of each group of linked documents the one with the smallest id stays.

    Wordless texts are in no group and stay. Of rows equal in id and text one stays; where a group has no id at all
    one row per distinct text stays.
    """
    chosen = docs.select(*DOCUMENT_COLUMNS, F.xxhash64("text").alias("text_hash"))
    groups = similar_groups(docs, measure)
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = kept.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).distinct()
    rows = chosen.join(kept, chosen["doc_id"].eqNullSafe(F.col("d")) & (chosen["text_hash"] == F.col("t")), "left_semi")
    return rows.dropDuplicates(["doc_id", "text_hash"]).drop("text_hash")
