"""Spelling variants, suffix-array deduplication and conversation repair against brute force."""

import collections
import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from probeline.llm import conversation_repair, induced_sort, queries, spelling, suffix_dedup
from probeline.session import scratch_path
from tests.llm.fixtures_llm import DOCS, corpus, with_clashes


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# suffix order


def brute_suffixes(data):
    tails = [data[k:].tolist() for k in range(len(data))]
    order = sorted(range(len(data)), key=lambda k: tails[k])

    def shared(a, b):
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        return min(k, induced_sort.CAP)

    return order, [shared(tails[a], tails[b]) for a, b in zip(order, order[1:])]


def induced(data, folder, budget):
    parts = list(induced_sort.suffixes_downwards(data, str(folder), budget))
    positions = np.concatenate([p for p, _ in parts])[::-1]
    return positions.tolist(), np.concatenate([x for _, x in parts])[:0:-1].tolist()


@pytest.mark.parametrize("budget, base", [(1, 0), (7, 20), (100, 0), (1 << 20, 1 << 18)])
def test_induced_sorting(tmp_path, monkeypatch, budget, base):
    monkeypatch.setattr(induced_sort, "BASE", base)
    rng = np.random.default_rng(budget)
    for n in (1, 2, 3, 9, 60, 400):
        for letters in (1, 2, 3, 200):
            data = rng.integers(1, letters + 1, n).astype(np.uint16)
            assert induced(data, tmp_path, budget) == brute_suffixes(data)
    base = rng.integers(1, 5, 500)
    copies = [np.append(np.where(rng.random(500) < 0.004, 9, base), 30) for _ in range(3)]
    data = np.concatenate([*copies, np.ones(600, int), [2], np.ones(300, int)]).astype(np.uint16)
    assert induced(data, tmp_path, budget) == brute_suffixes(data)
    assert not list(tmp_path.iterdir())  # run files are removed


def test_queue_uses_files(tmp_path, monkeypatch):
    monkeypatch.setattr(induced_sort, "BASE", 0)
    data = np.random.default_rng(3).integers(1, 40, 5000).astype(np.uint16)
    written = []
    original = induced_sort.RunFiles.write
    induced_sort.RunFiles.write = lambda self, arrays: written.append(1) or original(self, arrays)
    try:
        found = induced(data, tmp_path, 200)
    finally:
        induced_sort.RunFiles.write = original
    assert len(written) > 20 and found == brute_suffixes(data)


def test_pieces_that_end_with_a_key(tmp_path):
    """A piece of exactly one key's symbols is larger than those that go on after them."""
    runs = [(100, 1), (99, 4), (100, 4), (99, 1), (100, 1), (99, 4), (100, 4), (99, 1), (2, 1), (100, 1), (99, 4), (100, 4), (99, 1)]
    data = np.repeat(*np.array(runs).T).astype(np.uint16)
    assert induced(data, tmp_path, 1 << 20) == brute_suffixes(data)


# repeated bytes


def brute_repeats(texts, span):
    counts = collections.Counter(t[k : k + span] for t in texts for k in range(len(t) - span + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - span + 1):
            if counts[t[k : k + span]] > 1:
                gone[k : k + span] = b"\1" * span
        runs = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((len(t), runs, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def repeat_rows():
    rows = [r for r in corpus() if len(r[1] or "") < 60_000]
    rng = random.Random(4)
    phrase = "".join(chr(rng.randrange(97, 123)) for _ in range(260))
    for k in range(40):  # one passage in many contexts, as bytes that no other text has
        own = lambda n: "".join(chr(rng.randrange(97, 123)) for _ in range(n))
        rows.append((2000 + k, own(150 + k) + phrase + own(90), "en", "s", 1))
    rows += [(2100, "ab" * 300, "en", "s", 1), (2101, "é" * 350, None, "s", 1), (2102, "xyz " * 60 + "end" * 2, "en", "s", 1)]
    rows += [(2103, phrase[:199], "en", "s", 1), (2104, phrase[10:210], "en", "s", 1), (2105, phrase[:199] + "#", "en", "s", 1)]
    return rows


def found_repeats(df):
    got = [(r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in df.collect()]
    return sorted(got, key=repr)


def test_repeats(spark, none):
    rows = repeat_rows()
    table = spark.createDataFrame(rows, DOCS).repartition(4)
    wanted = brute_repeats([(r[1] or "").encode() for r in rows], suffix_dedup.SPAN)
    wanted = sorted(((r[0], *w) for r, w in zip(rows, wanted)), key=repr)
    found = suffix_dedup.find_repeats(with_clashes(table))
    assert found_repeats(found) == wanted
    assert "digest" in found.columns and "text" not in found.columns
    assert sum(bool(spans) for _, _, spans, _ in wanted) > 60
    assert suffix_dedup.find_repeats(none).count() == 0


def test_repeats_of_large_groups(spark, monkeypatch):
    rows = repeat_rows()
    table = spark.createDataFrame(rows, DOCS).repartition(4)
    whole = found_repeats(suffix_dedup.find_repeats(table))
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 3000)
    assert found_repeats(suffix_dedup.find_repeats(table)) == whole


def test_segments_of_pieces(monkeypatch):
    """Windows of a text read in parts are those of the text read whole, each once."""
    import pyarrow as pa

    text = " ".join(f"w{k * k % 977}" for k in range(3000))
    rows = pa.RecordBatch.from_arrays([pa.array([text, None, "short", text[:230]])], names=["text"])

    def windows():
        out = collections.Counter()
        for part in suffix_dedup._cut_texts(iter([rows])):
            for r in part.to_pylist():
                out.update((r["k1"], r["start"] + k, r["h"]) for k in range(r["n"]))
        return out

    whole = windows()
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 900)
    assert windows() == whole
    assert set(whole.values()) == {1} and len(whole) == len(text) - 199 + 31


# spelling variants


def brute_variants(rows, alphabet):
    counts = collections.Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}

    def near(w):
        out = {w[:k] + w[k + 1 :] for k in range(len(w))}
        out |= {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in alphabet}
        out |= {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in alphabet}
        return sorted((out - {w}) & words.keys(), key=lambda x: (-words[x], x))

    nears = {w: near(w) for w in words}
    form = {w: x[0] for w, x in nears.items() if x and words[x[0]] >= 10 * words[w]}
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(nears[w]), words.get(form.get(w))))
    return out


def spelling_rows():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(6, 10))) for _ in range(150)]
    words += ["façades", "facades", "Façades", "x×÷ÿÀbcd", "aaaaaaa", "aaaaaaaa", "b" * 70, "b" * 69, "b" * 34 + "c" + "b" * 35, "q" * 300, "q" * 301]
    rows = []
    for k in range(120):
        text = " ".join(rng.choice(words) if rng.random() < 0.7 else rng.choice(words[:3]) for _ in range(60))
        rows.append((k, text, "en", "s", 1))
    chain = ["abcdefgh"] * 3 + ["abcdefgx"] * 60 + ["abcdexgx"] * 900  # forms of forms
    rows += [(1000 + k, w, "en", "s", 1) for k, w in enumerate(chain)]
    return rows + [(None, "facades façades facades", None, None, None), (5000, None, "en", "s", 1), (5001, "", "en", "s", 1), rows[0]]


def variant_rows(df):
    columns = ("word", "form", "root", "n", "n_near", "form_n")
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_spelling_variants(spark, none):
    rows = spelling_rows()
    wanted = brute_variants(rows, "abcdefghxéçqsÿ×÷àÀ")
    table = spark.createDataFrame(rows, DOCS).repartition(3)
    assert variant_rows(spelling.spelling_variants(with_clashes(table))) == wanted
    assert any(form and root != form for _, form, root, *_ in wanted)
    assert spelling.spelling_variants(none).count() == 0


def test_filters_in_turns(spark, monkeypatch):
    rows = spelling_rows()
    table = spark.createDataFrame(rows, DOCS).repartition(3)
    whole = variant_rows(spelling.spelling_variants(table))
    monkeypatch.setattr(spelling, "TURN_BYTES", 1)
    monkeypatch.setattr(spelling, "BITS_PER_WORD", 1 << 16)  # several parts of a filter
    assert variant_rows(spelling.spelling_variants(table)) == whole


def test_hash_of_edits():
    """The hash reached by an edit is that of the edited word, past the block of 256 places too."""
    rng = np.random.default_rng(1)
    for size in (8, 257, 600):
        letters = rng.integers(97, 100, (3, size)).astype(np.uint8)
        seen = []

        class Every:
            blocks = {spelling.Filters.shard(size): 1, spelling.Filters.shard(size - 1): 1}
            shard = staticmethod(spelling.Filters.shard)

            def places(self, length, hashes):
                return np.zeros(len(hashes), np.int64), hashes

        def known(block, rest):
            seen.extend(rest.tolist())
            return np.arange(len(rest))

        at = 0
        for row, place, letter in spelling._edits_of(letters, [97, 98, 99], Every(), known):
            for r, k in zip(row.tolist(), place.tolist()):
                word = letters[r].tolist()
                word[k : k + 1] = [letter] if letter >= 0 else []
                assert spelling.word_hashes(np.array([word], np.uint8))[0] == np.uint64(seen[at])
                at += 1
        assert at == len(seen) > 0


# conversation repair

TALK = "conv_id bigint, turn bigint, role string, text string"


def brute_repair(conv, rows):
    out = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [r[0] for r in out if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, role, text in out:
        words = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("b" if not words else "d" if (role, text) in seen else "t" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(out, out[1:]))
    after = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
    name = {"u": "user", "a": "assistant"}
    heap, done = [((0, ""), 0, 0, ())], set()
    while True:
        (cost, audit), at, state, lines = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(out) and state in (0, 3):
            break
        new = [(3, "I", at, after[state][c], f"{name[c]}:") for c in "ua" if c in after[state]]
        if at < len(out):
            _, role, text = out[at]
            new.append((4, "D", at + 1, state, None))
            if faults[at] not in ("b", "d"):
                extra = 3 if faults[at] == "t" else 0
                if role[:1] in after[state]:
                    new.append((extra, "K", at + 1, after[state][role[:1]], f"{role}:{text}"))
                new += [(3 + extra, "R", at + 1, after[state][c], f"{name[c]}:{text}") for c in "ua" if c in after[state]]
        for step, letter, k, s, line in new:
            heapq.heappush(heap, ((cost + step, audit + letter), k, s, lines if line is None else (*lines, line)))
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    count = faults.count
    return gaps, count("b"), count("d"), count("t"), illegal, cost, audit, digest


def talk_rows():
    rng = random.Random(6)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "superuser"]
    texts = ["Yes.", "No!", "Why?", "so", "", " \n", None, "é. ", "x" * 3000 + ".", "Well?\x0b", "a.b"]
    rows = []
    for conv in [*range(60), None]:
        for k in range(rng.randrange(1, 14)):
            text = f"{conv} {k}." if rng.random() < 0.5 else rng.choice(texts)
            role = ["user", "assistant"][k % 2] if rng.random() < 0.6 else rng.choice(roles)
            turn = None if rng.random() < 0.05 else k + (3 if rng.random() < 0.1 else 0)
            rows.append((conv, turn, role, text))
    rows += [(500, k % 90, rng.choice(roles), rng.choice([f"{k}.", *texts])) for k in range(300)]  # a large one, with ties
    rows += [(600, None, "user", "Hi.")] * 5 + [(601, 1, None, None)]
    return rows


def repair_rows(df):
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r["conv_id"]: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("bits", [0, 2, conversation_repair.BLOCK_BITS])
def test_repair(spark, bits):
    rows = talk_rows()
    groups = collections.defaultdict(list)
    for conv, *rest in rows:
        groups[conv].append(rest)
    table = with_clashes(spark.createDataFrame(rows, TALK).repartition(4)).drop("kept")
    found = repair_rows(conversation_repair.repair_report(table, bits))
    assert found == {conv: brute_repair(conv, rest) for conv, rest in groups.items()}
    assert conversation_repair.repair_report(spark.createDataFrame([], TALK)).count() == 0


def test_repaired_rows_have_the_form(spark):
    table = spark.createDataFrame(talk_rows(), TALK)
    repaired, report = conversation_repair.repair_conversations(conversation_repair.damaged_rows(table))
    roles, edits = collections.defaultdict(str), collections.defaultdict(str)
    for part in repaired.select("ck", "role", "edit").collect():
        roles[part["ck"]] += part["role"][0]
        edits[part["ck"]] += part["edit"]
    assert all(re.fullmatch("s?(ua)+", r) for r in roles.values())
    audits = {r["ck"]: r["audit"] for r in report.collect()}
    assert all(audits[ck].replace("D", "") == letters for ck, letters in edits.items())


def test_cells_do_not_depend_on_the_cut():
    spans = conversation_repair.Spans()
    rng = random.Random(8)
    for _ in range(50):
        codes = [rng.randrange(9) for _ in range(rng.randrange(2, 90))]
        whole = spans.cell(codes)
        for cut in (1, len(codes) // 2, len(codes) - 1):
            assert conversation_repair._product(spans.cell(codes[:cut]), spans.cell(codes[cut:])) == whole


def test_new_queries_are_registered():
    assert {"op11_spelling_variants", "op12_suffix_dedup", "op13_conversation_repair"} <= queries.QUERIES.keys()
