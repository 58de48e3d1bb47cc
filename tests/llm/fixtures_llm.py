"""Small tables with every awkward row: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = (
    "spans string, class string, n string, bits string, token string, row string, word string, h string, shard string, "
    "kept string, cutoff string, n_tokens string, bytes string, name string, digest string, text_hash string, depth string"
)


def words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}x" for _ in range(n)]


def corpus():
    """Families of near copies, exact copies, a passage that many share, and the awkward rows."""
    texts = []
    for family in range(6):
        base = words(family, 120)
        for copy in range(12):
            rng = random.Random(family * 100 + copy)
            own = list(base)
            for _ in range(rng.randrange(0, 8)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    shared = " ".join(words("passage", 60))
    texts += [shared + " " + " ".join(words(f"own{k}", 50)) for k in range(20)]
    texts += [texts[0], texts[0], texts[0].upper(), shared]
    texts += ["", "   \n\t ", "one", "one two three", "one two three", "ONE two three", "é ñ 日本 語", "a  b\n\nc\x0bd"]
    texts += [" ".join(words("long", 30_000, 50_000)), "x" * 50_000]
    rows = [(k, t, ["en", "de", None][k % 3], "src0", len(t)) for k, t in enumerate(texts)]
    rows += [(1000, None, None, None, None), (None, "a row without an id", "en", "src1", 19), (None, None, "en", "src1", None)]
    rows += [rows[5], rows[5]]
    return rows


def with_clashes(df):
    from pyspark.sql import functions as F

    for column in CLASHING.split(", "):
        df = df.withColumn(column.split()[0], F.lit("clash"))
    return df


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
