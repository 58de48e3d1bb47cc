"""A quality classifier: perplexity under a trigram model of trusted text, with two cutoffs per language.

The model is an interpolated modified Kneser-Ney model of words, from all trusted text. Its counts, continuation counts,
discounts and back-off weights come from joins of count tables that Spark shards by n-gram. Scores come from a join too:
a token's log probability is a sum of one value each of its word, bigram and trigram and of their contexts, 0 where the
model lacks one. So the n-grams of a text meet their values in any order. They do so slice by slice of the middle words
of trigrams, and one model after the other, in blocks of sorted keys; tables and shuffle files of a slice go with it.

Texts are dealt into folds by hash, each fold has a model of its own trusted texts, and a text is scored by the model
of the other fold. So no text is scored by a model that has seen it, and every trusted document can set cutoffs.

The upper cutoff is on log perplexity. Repetition needs a lower one: a word said over and over is likely under the
model, but near copies of training text are likelier still, so no cutoff on the perplexity itself tells them apart.
The lower cutoff is on the share of a text's trigrams that are distinct, that is those that add to what it says.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from probeline.llm.common import batch, blank_words, forget, lean, mixed, parts_for, slices, stored, utf8, word_hashes

FOLDS = 2
#: Words of a model whose values each task gets; those of all others, and of longer n-grams, come by a join.
KNOWN_GRAMS = 500_000
#: Slices of n-grams, by middle word, that are trained and scored in turn: each takes its share of the disk.
SLICES = 3
#: Bytes of text a shard of n-grams stands for, and rows of a model packed at once.
SHARD_BYTES = 32 << 20
PACKED_ROWS = 200_000
#: Bytes of text handled at once: some 20 arrays of 8 bytes a word stand beside it.
GRAM_BYTES = 2 << 20
#: Shares of a language's trusted documents that may lie beyond each of its two cutoffs, from which labels choose;
#: without documents labelled bad it is ``TAIL``. Then the fewest trusted documents that set cutoffs.
TAILS = (0.001, 0.002, 0.005, 0.01)
TAIL = 0.002
LEAST_HOLDOUT = 20
SCORES = ("n_tokens", "log_perplexity", "distinct_share")
_START, _END = np.uint64(0x9E6C63D0876A9A47), np.uint64(0xC2B2AE3D27D4EB4F)
_STEP = np.uint64(0x9FB21C651E98DF25)
#: Sets keys of bigrams as contexts apart from those of the bigrams themselves.
_CONTEXT = np.uint64(0xD6E8FEB86659FD93)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of good documents without toxic text."""
    return labels.where("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()


def fold_of(text: str) -> Column:
    """The fold of a text; equal texts share one."""
    return F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int")


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, fold`` of all rows of trusted documents."""
    return docs.select("doc_id", "text").join(trusted_ids(labels), "doc_id").select("text", fold_of("text").alias("fold"))


def _keys(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> dict[str, np.ndarray]:
    uv = mixed(u * _STEP + v)
    return {"vw": mixed(v * _STEP + w), "uv": uv ^ _CONTEXT, "uvw": mixed(uv * _STEP + w)}


def _grams(rows: pa.RecordBatch) -> Iterator[tuple[int, dict[str, np.ndarray], np.ndarray]]:
    """Hashes for each predicted word (ends included): the words ``w``, ``v`` before it, ``u`` before that, and of runs."""
    data, offsets = utf8(rows.column("text"))
    for low, high in slices(offsets, GRAM_BYTES):
        own = offsets[low : high + 1]
        codes, words, before = blank_words(data[own[0] : own[-1]], own - own[0])
        n = high - low
        line = np.full(len(codes) + 3 * n, _START)  # two starts, the words, an end
        doc = np.repeat(np.arange(n), np.diff(before))
        line[np.arange(len(codes)) + 3 * doc + 2] = word_hashes(words).view(np.uint64)[codes] if len(codes) else 0
        ends = before[1:] + 3 * np.arange(1, n + 1) - 1
        line[ends] = _END
        size = np.diff(before) + 1
        at = np.arange(len(codes) + n) + 2 * np.repeat(np.arange(n), size) + 2
        u, v, w = line[at - 2], line[at - 1], line[at]
        grams = {"w": w, "v": v, "u": u, **_keys(u, v, w)}
        yield low, {k: x.view(np.int64) for k, x in grams.items()}, size


def discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and more, from the numbers of n-grams seen 1 to 4 times."""
    seen = {r["n"]: r["k"] for r in counts.where("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}
    n = [seen.get(k, 0) for k in (1, 2, 3, 4)]
    if not all(n[:3]):
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    # never quite 0, so that every back-off weight leaves something for unseen words
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), float(k)) for k in (1, 2, 3)]


def _discount(d: list[float]) -> Column:
    n = F.col("n")
    return F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def _weights(counts: DataFrame, context: list[str], d: list[float]) -> DataFrame:
    """Total and back-off weight of each context."""
    return counts.groupBy(*context).agg(F.sum("n").alias("total"), (F.sum(_discount(d)) / F.sum("n")).alias("weight"))


@dataclass
class TrigramModel:
    """Counts of n-grams, by slices of the middle words of trigrams, and what words and discounts come to.

    A token's log10 probability is a sum of one value each of its n-grams. A word adds the log of its probability over
    ``unknown`` and of its back-off weight; a bigram that of its probability over what backing off gives, and as a context
    that of its weight; a trigram that of its probability over what backing off gives. Over a token's n-grams these sums
    leave the longest one seen and the weights due. ``words`` has ``key, value, n`` of words, by hash; ``values`` makes the others
    a slice at a time, as all of them at once would take more room than the text."""

    three: list[DataFrame]
    two: list[DataFrame]
    one: DataFrame
    back_two: DataFrame
    words: DataFrame
    discounts: tuple[list[float], list[float]]
    unknown: float
    types: int

    def values(self, k: int) -> tuple[list[tuple[DataFrame, str]], list[DataFrame]]:
        """Rows of words and ``value``, with the kind of key, of n-grams whose middle word ``v`` is in slice ``k``: bigrams
        ``vw``, contexts ``uv`` and trigrams; and what to forget behind them."""
        d2, d3 = self.discounts
        log = lambda x: F.log10(x).alias("value")
        seen = lambda d: (F.col("n") - _discount(d)) / F.col("total")
        lower = F.col("weight") * F.col("p")
        p2 = self.two[k].join(self.back_two, "v").join(self.one.select("w", "p"), "w")
        p2 = stored(p2.select("v", "w", (seen(d2) + lower).alias("p"), log((seen(d2) + lower) / lower)), "p2")
        back_three = _weights(self.three[k], ["u", "v"], d3)
        p3 = self.three[k].join(back_three, ["u", "v"]).join(p2.select("v", "w", "p"), ["v", "w"])
        return [
            (p2.select("v", "w", "value"), "vw"),
            (back_three.select("u", "v", log(F.col("weight"))), "uv"),
            (p3.select("u", "v", "w", log((seen(d3) + lower) / lower)), "uvw"),
        ], [p2]

    def forget(self) -> None:
        forget(*self.three, *self.two, self.one, self.back_two, self.words)


def _in_slice(v: np.ndarray, k: int, n_slices: int) -> np.ndarray:
    """Where the middle word is in slice ``k``."""
    return np.flatnonzero(mixed(v.view(np.uint64)) % np.uint64(n_slices) == k)


def train_trigrams(texts: DataFrame, n_slices: int = SLICES) -> TrigramModel:
    """The model of all rows of ``texts``. Without text every word is equally unknown."""
    schema = pa.schema([(k, pa.int64()) for k in ("u", "v", "w", "n")])

    def trigrams(k: int) -> DataFrame:
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                for _, grams, _ in _grams(rows):
                    own = _in_slice(grams["v"], k, n_slices)
                    _, first, n = np.unique(grams["uvw"][own], return_index=True, return_counts=True)
                    yield batch({"n": n, **{c: grams[c][own[first]] for c in ("u", "v", "w")}}, schema)

        rows = texts.select("text").mapInArrow(lean(emit), "u bigint, v bigint, w bigint, n bigint")
        return stored(rows.groupBy("u", "v", "w").agg(F.sum("n").alias("n")), "trigrams")

    three = [trigrams(k) for k in range(n_slices)]
    # lower orders count in how many different contexts an n-gram follows
    two = [stored(x.groupBy("v", "w").agg(F.count(F.lit(1)).alias("n")), "bigrams") for x in three]
    bigrams = reduce(DataFrame.union, two)
    one = stored(bigrams.groupBy("w").agg(F.count(F.lit(1)).alias("n")), "unigrams")
    d1, d2, d3 = discounts(one), discounts(bigrams), discounts(reduce(DataFrame.union, three))
    types, total, taken = one.agg(
        F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(1)), F.coalesce(F.sum(_discount(d1)), F.lit(1.0))
    ).first()
    unknown = taken / total / (types + 1)
    one = one.withColumn("p", (F.col("n") - _discount(d1)) / total + unknown)
    back_two = stored(_weights(bigrams, ["v"], d2), "weights")
    words = one.select(F.col("w").alias("key"), F.log10(F.col("p") / unknown).alias("value"), "n")
    words = words.union(back_two.select("v", F.log10("weight"), "total"))
    words = stored(words.groupBy("key").agg(F.sum("value").alias("value"), F.max("n").alias("n")), "words")
    return TrigramModel(three, two, one, back_two, words, (d2, d3), unknown, types)


def _frequent(entries: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The entries seen at least so often that they are ``most`` or fewer, and all others."""
    size = F.floor(F.log2("n")).cast("int")
    of_size = {r["size"]: r["k"] for r in entries.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("k")).collect()}
    least, held = 64, 0
    for k in sorted(of_size, reverse=True):
        held += of_size[k]
        if held > most:
            break
        least = k
    return entries.where(size >= least), entries.where(size < least)


def distinct(grams: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many different ones each text has."""
    doc = np.repeat(np.arange(len(size)), size)
    own = mixed(grams.view(np.uint64) + doc.astype(np.uint64) * _STEP)
    order = np.argsort(own)
    first = np.concatenate(([True], own[order[1:]] != own[order[:-1]]))
    return np.bincount(doc[order[first]], minlength=len(size))


_BLOCKS = pa.schema(
    [("shard", pa.int32()), ("kind", pa.int8()), *[(k, pa.binary()) for k in ("keys", "value", "at", "digest", "size", "share")]]
)
_BLOCKS_SQL = "shard int, kind tinyint, keys binary, value binary, at binary, digest binary, size binary, share binary"
_MODEL, _REQUEST, _KNOWN = 0, 1, 2


def _blocks(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_BLOCKS)


def _dealt(keys: np.ndarray, shards: int) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Shard, its keys in order, and where they stood. Bytes of a rank stand together: the first ones of keys in order
    are alike, which shuffles smaller."""
    keys = keys.view(np.uint64)
    order = np.argsort(keys)
    keys = keys[order]
    shard = ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    cuts = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
    for k in np.flatnonzero(np.diff(cuts)):
        own = slice(cuts[k], cuts[k + 1])
        yield int(k), _planes(keys[own]), order[own]


def _planes(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _numbers(block: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(block, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _model_blocks(rows: DataFrame, kind: str, shards: int) -> DataFrame:
    """Blocks of keys and values from rows of the words of ``kind``, or of ``key``, and ``value``."""
    columns = ("key",) if kind == "key" else tuple(kind)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            own = dict(zip((*columns, "value"), (np.concatenate(x) for x in zip(*kept))))
            value = own.pop("value")
            key = own["key"] if kind == "key" else _keys(*[own.get(c, own["v"]) for c in "uvw"])[kind]
            return _blocks(
                [{"shard": k, "kind": _MODEL, "keys": b, "value": value[at].tobytes()} for k, b, at in _dealt(key, shards)]
            )

        kept, n = [], 0
        for rows in batches:
            kept.append([*[rows.column(c).to_numpy().view(np.uint64) for c in columns], rows.column("value").to_numpy()])
            n += rows.num_rows
            if n >= PACKED_ROWS:
                yield out()
                kept, n = [], 0
        if n:
            yield out()

    return rows.select(*columns, "value").mapInArrow(lean(pack), _BLOCKS_SQL)


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the values asked for, per text of a block. Blocks of the model come first."""
    schema = pa.schema([("digest", pa.binary()), ("logs", pa.float64()), ("size", pa.int64()), ("share", pa.float64())])
    keys, values, model = [], [], None
    for rows in batches:
        for block in rows.to_pylist():
            if block["kind"] == _MODEL:
                keys.append(_numbers(block["keys"], np.uint64))
                values.append(np.frombuffer(block["value"]))
                continue
            n = len(block["digest"]) // 16
            digest = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), n, [None, pa.py_buffer(block["digest"])]).cast(pa.binary())
            if block["kind"] == _KNOWN:
                logs, size, share = (np.frombuffer(block[k], t) for k, t in (("value", float), ("size", np.int64), ("share", float)))
                yield batch({"digest": digest, "logs": logs, "size": size, "share": share}, schema)
                continue
            if model is None:
                have = np.concatenate(keys or [np.zeros(0, np.uint64)])
                order = np.argsort(have)
                model = have[order], np.concatenate(values or [np.zeros(0)])[order]
                keys, values = [], []
            have, value = model
            if not len(have):
                continue
            asked = _numbers(block["keys"], np.uint64)
            at = np.minimum(np.searchsorted(have, asked), len(have) - 1)
            here = have[at] == asked
            doc = _numbers(block["at"], np.int32)[here]
            logs, found = np.bincount(doc, value[at[here]], n), np.flatnonzero(np.bincount(doc, minlength=n))
            none = np.zeros(len(found))
            yield batch({"digest": digest.take(pa.array(found)), "logs": logs[found], "size": none.astype(np.int64), "share": none}, schema)


def text_scores(docs: DataFrame, model: TrigramModel, known: int = KNOWN_GRAMS) -> DataFrame:
    """``digest, n_tokens, log_perplexity, distinct_share`` of the distinct ``text`` of ``docs``. Equal texts have
    equal sums, so the quotient of the sums over all of them is that of each. Every slice of the model reads the
    texts again, meets their n-grams in shards and leaves a sum a text. Tasks hold the values of at most ``known`` words."""
    frequent, others = _frequent(model.words, known)
    held = frequent.select("key", "value").toArrow()  # bounded
    order = np.argsort(keys := held.column("key").to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast((keys[order], held.column("value").to_numpy()[order]))
    unknown, n_slices = np.log10(model.unknown), len(model.three)
    texts = docs.select(_digest("text").alias("digest"), "text")
    read = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = parts_for(read, SHARD_BYTES, docs.sparkSession.sparkContext.defaultParallelism * 2)

    def places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        have, _ = shared.value
        if not len(have):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        return at, have[at] == keys

    def requests(k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                for low, grams, size in _grams(rows):
                    n = len(size)
                    digest = b"".join(rows.column("digest").slice(low, n).to_pylist())
                    doc, first = np.repeat(np.arange(n, dtype=np.int32), size), np.cumsum(size) - size
                    own = _in_slice(grams["v"], k, n_slices)
                    parts, docs = [grams[c][own] for c in ("vw", "uv", "uvw")], [doc[own]] * 3
                    out = []
                    if k == 0:  # each word is a context of the next token, so only the one before the first is added
                        words = np.concatenate([grams["w"], grams["v"][first]])
                        of = np.concatenate([doc, np.arange(n, dtype=np.int32)])
                        at, here = places(words)
                        logs = np.bincount(of[here], shared.value[1][at[here]], n) + unknown * size
                        share = distinct(grams["uvw"], size) / size
                        sums = {"value": logs.tobytes(), "size": size.astype(np.int64).tobytes(), "share": share.tobytes()}
                        out = [{"shard": low % shards, "kind": _KNOWN, "digest": digest, **sums}]
                        parts, docs = [*parts, words[~here]], [*docs, of[~here]]
                    of = np.concatenate(docs)
                    for shard, keys, at in _dealt(np.concatenate(parts), shards):
                        out.append({"shard": shard, "kind": _REQUEST, "keys": keys, "at": _planes(of[at]), "digest": digest})
                    yield _blocks(out)

        return run

    sums = []
    for k in range(n_slices):
        values, spent = model.values(k)
        values += [(others, "key")] * (k == 0)
        packed = stored(reduce(DataFrame.union, [_model_blocks(*x, shards) for x in values]), "model")
        forget(*spent)
        blocks = packed.union(texts.mapInArrow(lean(requests(k)), _BLOCKS_SQL))
        met = blocks.repartition(shards, "shard").sortWithinPartitions("kind")
        met = met.mapInArrow(lean(_matched), "digest binary, logs double, size bigint, share double")
        met = met.groupBy("digest").agg(
            F.sum("logs").alias("logs"), F.sum("size").alias("sizes"), F.max("size").alias("size"), F.max("share").alias("share")
        )
        sums.append(stored(met, "sums"))
        forget(packed)
    whole = reduce(DataFrame.union, sums).groupBy("digest").agg(
        F.max("size").alias("n_tokens"),
        (-F.sum("logs") / F.sum("sizes")).alias("log_perplexity"),
        F.max("share").alias("distinct_share"),
    )
    whole = stored(whole, "scores")
    forget(*sums)
    return whole


def _digest(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _with_scores(docs: DataFrame, scores: DataFrame) -> DataFrame:
    columns = [c for c in docs.columns if c not in SCORES]
    scores = scores.withColumnRenamed("digest", "_digest")
    return docs.select(*columns, _digest("text").alias("_digest")).join(scores, "_digest", "left").select(*columns, *SCORES)


def with_perplexity(docs: DataFrame, *models: TrigramModel, known: int = KNOWN_GRAMS) -> DataFrame:
    """All columns of ``docs`` (which must include ``text``) and ``n_tokens, log_perplexity`` (log10 per token,
    the end included) and ``distinct_share`` of its trigrams. A null or empty text has the end alone. Of several
    models a text's fold takes the next one's. Tasks hold the values of at most ``known`` words."""
    scores = [text_scores(_judged_by(docs, k, len(models)), m, known) for k, m in enumerate(models)]
    return _with_scores(docs, reduce(DataFrame.union, scores))


def _judged_by(docs: DataFrame, k: int, judges: int) -> DataFrame:
    """Rows whose text has the fold before ``k``; a null text counts as an empty one."""
    fold = F.lit(0) if judges == 1 else F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(judges))
    return docs.where((fold + 1) % judges == k)


def language_cutoffs(scored: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """``stratum, cutoff, low_cutoff`` of languages with ``LEAST_HOLDOUT`` trusted documents or more, from these alone,
    and the tail they take. With fewer than 1 / tail documents the cutoffs are their extremes.

    Of ``TAILS`` the one is taken that rejects the largest share of documents labelled bad less the share of trusted
    ones; the smaller if two do. All are held out from the models that scored them.
    """
    columns = ["doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), "log_perplexity", "distinct_share"]
    bad = labels.where("quality = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    judged = trusted_ids(labels).withColumn("good", F.lit(True)).union(bad.withColumn("good", F.lit(False)))
    held = stored(scored.select(*columns).join(judged, "doc_id"), "held_out")
    at = lambda column, tails: F.percentile_approx(column, list(tails), 10_000)
    tails = held.where("good").groupBy("stratum").agg(
        at("log_perplexity", [1 - t for t in TAILS]).alias("high"), at("distinct_share", TAILS).alias("low"),
        F.count(F.lit(1)).alias("n"),
    ).where(F.col("n") >= LEAST_HOLDOUT)
    tails = stored(tails, "tails")
    gone = [(F.col("log_perplexity") > F.col("high")[k]) | (F.col("distinct_share") < F.col("low")[k]) for k in range(len(TAILS))]
    shares = held.join(tails, "stratum").groupBy("good").agg(*[F.avg(g.cast("double")).alias(f"t{k}") for k, g in enumerate(gone)])
    found = {r["good"]: [r[f"t{k}"] for k in range(len(TAILS))] for r in shares.collect()}
    best = TAILS.index(TAIL)
    if len(found) == 2:
        best = max(range(len(TAILS)), key=lambda k: found[False][k] - found[True][k])
    return tails.select("stratum", F.col("high")[best].alias("cutoff"), F.col("low")[best].alias("low_cutoff")), TAILS[best]


ADDED = (*SCORES, "cutoff", "low_cutoff", "kept")


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All columns of ``docs`` and those of ``ADDED``; columns of these names are replaced.

    A document is rejected if its log perplexity lies above its language's ``cutoff`` or its share of distinct
    trigrams below the ``low_cutoff``. Null and empty texts are scored by their end alone; a null language is one of
    its own; repeated rows are judged one by one. A language with fewer than ``LEAST_HOLDOUT`` trusted documents has
    no cutoffs and all its documents are kept, as the models know nothing of it; so are all documents if a fold has
    no trusted text.
    """
    docs = docs.select(*[c for c in docs.columns if c not in ADDED])
    trusted = stored(trusted_texts(docs, labels), "trusted_texts")
    scores, known = [], True
    for k in range(FOLDS):
        model = train_trigrams(trusted.where(F.col("fold") == k))
        scores.append(text_scores(_judged_by(docs, k, FOLDS), model))
        known = known and model.types > 0
        model.forget()  # one model at a time takes room
    forget(trusted)
    scored = _with_scores(docs, reduce(DataFrame.union, scores))
    cutoffs, _ = language_cutoffs(scored, labels if known else labels.limit(0))
    own = cutoffs.select(*[F.col(c).alias(f"own_{c}") for c in cutoffs.columns])
    joined = scored.join(own, F.coalesce("lang", F.lit("")) == F.col("own_stratum"), "left")
    within = (F.col("log_perplexity") <= F.col("own_cutoff")) & (F.col("distinct_share") >= F.col("own_low_cutoff"))
    return joined.select(
        *docs.columns,
        "n_tokens",
        "log_perplexity",
        "distinct_share",
        F.col("own_cutoff").alias("cutoff"),
        F.col("own_low_cutoff").alias("low_cutoff"),
        F.coalesce(within, F.lit(True)).alias("kept"),
    )
