"""Near copies, repeated passages, chats and components against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from farspark.llm import chats, jaccard, substrings
from farspark.llm.components import components


def grouped(links, nodes):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        up[root(a)] = root(b)
    return {n: min(m for m in nodes if root(m) == root(n)) for n in nodes}


def test_components_of_chains_stars_and_cliques(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (200, 202), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for link in links for n in link}
    want = grouped(links, nodes)
    assert set(got) == nodes
    assert all((got[a] == got[b]) == (want[a] == want[b]) for a in nodes for b in nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def word_sets(texts, width=5):
    out = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    return out


def near_copies(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts, base = [], [rng.choice(words) for _ in range(120)]
    for i in range(60):  # variants of one text, each with up to three changed words
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(120)] = rng.choice(words)
        texts.append(" ".join(own))
    drift = [rng.choice(words) for _ in range(80)]
    for i in range(12):  # a chain: neighbours are alike, the ends are not
        texts.append(" ".join(drift))
        for k in range(2):
            drift[(i * 5 + k) % 80] = rng.choice(words)
    passage = " ".join(rng.choice(words) for _ in range(50))
    for i in range(30):  # a common passage in different texts
        texts.append(" ".join(rng.choice(words) for _ in range(30)) + " " + passage + " " + " ".join(rng.choice(words) for _ in range(rng.randint(0, 20))))
    texts += [None, "", " \t", "one", "One", "one two", "A b c d e", "a B c d\x0be", "x " * 300, "x " * 5000, "é ü ß ñ ç", "é ü ß ñ ç"]
    return list(enumerate(texts))


def test_near_duplicates_equal_brute_force(spark):
    texts = near_copies()
    sets = word_sets(texts)
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = grouped(links, list(sets))
    df = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, component_id int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}

    names = {r.doc: r.set_key for r in jaccard.shingle_sets(df, "doc_id", "text").collect()}
    pairs = {(r.a, r.b): r.common for r in jaccard.similar_sets(df).collect()}
    different = {tuple(sorted((names[a], names[b]))): len(sets[a] & sets[b]) for a, b in links if names[a] != names[b]}
    assert pairs == different


def test_shingles_of_the_same_holders_are_one_list():
    holders = np.array([2, 3, 40, 41, 5_000_000], np.int64)
    names = jaccard.list_names(holders, np.arange(5, dtype=np.uint64))
    assert list(names) == sorted(names) and len(set(names)) == 5
    assert jaccard.list_lengths(names) == pytest.approx(holders, rel=1 / 2000)
    assert len(set(jaccard.list_names(np.array([7, 7]), np.array([1, 2], np.uint64)))) == 2
    same, each = np.zeros(20), np.ones(20)
    same[0] = 1
    twos = np.full(20, 2.0)
    assert jaccard.choose_level(twos, same, 20, 75, 20) == 15  # nothing more to read, so all that can be asked for
    assert jaccard.choose_level(twos, same, 20, 75) == jaccard.LEVELS
    assert jaccard.choose_level(twos, each, 20, 75, 20) == 14  # 2 (5 + l) (1 + 40 / l) is least there


def test_sketches_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(3)
    for size, swapped in ((5, 1), (200, 20), (3000, 300)):
        a = rng.integers(0, 1 << 62, size).astype(np.uint64)
        b = np.concatenate([a[swapped:], rng.integers(0, 1 << 62, swapped // 2).astype(np.uint64)])
        bits = int(np.bitwise_count(jaccard.sketch(a) ^ jaccard.sketch(b)).sum())
        assert len(jaccard.sketch(a)) * 64 == jaccard.SKETCH and bits <= len(np.setxor1d(a, b)) and bits % 2 == len(np.setxor1d(a, b)) % 2
    assert not jaccard.sketch(np.zeros(0, np.uint64)).any()


def test_a_large_group_of_near_copies_meets_few_pairs(spark, monkeypatch):
    """Variants that are too far apart to link share most of their lists; they may not all meet each other."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    base, texts = [rng.choice(words) for _ in range(150)], []
    for i in range(150):
        own = list(base)
        for at in rng.sample(range(150), rng.randint(1, 5)):
            own[at] = f"new{i}-{at}"
        texts.append(" ".join(own))
    rows, met, checked = list(enumerate(texts)), [], []
    candidates, verified = jaccard._candidates, jaccard.verified
    monkeypatch.setattr(jaccard, "_candidates", lambda rows: met.append(rows.count()) or candidates(rows))
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *rest: checked.append(pairs.count()) or verified(pairs, *rest))
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = word_sets(rows)
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert got == grouped(links, list(sets)) and len(set(got.values())) > 1
    assert sum(checked) < 4 * len(rows) and max(met[1:], default=0) < 20 * len(rows)


def test_near_duplicates_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard.near_duplicates(df).collect())
    assert got == [(-1, 0, -1), (-1, 2, 5), (5, 2, 5), (5, 2, 5)]
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


def covered(texts, length):
    from collections import Counter

    seen = Counter(t[i:i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = {}
    for key, t in texts:
        mask = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                mask[i:i + length] = [True] * length
        spans, at = [], 0
        while at < len(t):
            if mask[at]:
                end = at
                while end < len(t) and mask[end]:
                    end += 1
                spans.append((at, end))
                at = end
            at += 1
        out[key] = (bytes(b for b, m in zip(t, mask) if not m), spans)
    return out


@pytest.mark.parametrize("length", [128, 200, 400])
def test_repeats_equal_brute_force(spark, length):
    rng = random.Random(length)
    noise = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    shared, other = noise(900), noise(length + 1)
    texts = [noise(700) + shared + noise(500), shared[100:], noise(300) + shared[:650], noise(50) + other, other[:-1] + noise(80), other[1:],
             b"a" * 1500, b"ab" * 700, noise(length - 1), b"", noise(200) + noise(90) * 12, shared, shared, "üß€".encode() * 300]
    texts += [noise(40) + shared[200:200 + length + k] + noise(60) for k in range(-2, 6)]
    rows = [(i, bytearray(t), "x") for i, t in enumerate(texts)] + [(len(texts), None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, raw binary, kept string").withColumn("text", F.col("raw").cast("string"))
    got = {r.doc_id: (bytes(r.kept), [(s.start, s.stop) for s in r.removed]) for r in substrings.remove_repeats(df, length=length).collect()}
    assert got.pop(len(texts)) == (b"", [])
    assert got == covered(list(enumerate(texts)), length)


def test_long_texts_are_cut_without_losing_repeats(spark, monkeypatch):
    rng = random.Random(4)
    noise = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    monkeypatch.setattr(substrings, "HELD_BYTES", 1000)
    shared = noise(1700)
    texts = [(0, noise(2500) + shared + noise(1200)), (1, shared), (2, noise(990) + shared[300:900])]
    df = spark.createDataFrame([(i, t.decode()) for i, t in texts], "doc_id long, text string")
    got = {r.doc_id: (bytes(r.kept), [(s.start, s.stop) for s in r.removed]) for r in substrings.remove_repeats(df).collect()}
    assert got == covered(texts, 400)


def test_repeats_of_repeated_rows_and_null_keys(spark):
    text = "".join(random.Random(2).choice("abcdef ") for _ in range(600))
    df = spark.createDataFrame([(1, text), (1, text), (None, text[:450] + "zz"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, bytes(r.kept)) for r in substrings.remove_repeats(df).collect())
    assert got == [(-1, b""), (-1, b"zz"), (1, b""), (1, b"")]
    assert substrings.remove_repeats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        substrings.repeats(df, length=100)


def test_runs_are_found_in_bounded_memory():
    import tracemalloc

    text = np.random.default_rng(3).integers(97, 123, 1 << 21).astype(np.uint8).tobytes()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text], pa.binary())], ["d1", "d2", "_text"])
    find = substrings._runs(128, ["anchor"])
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in find([batch])) > 1 << 14
        assert tracemalloc.get_traced_memory()[1] < 16 << 20
    finally:
        tracemalloc.stop()


def test_a_worker_hands_back_what_a_task_has_freed(monkeypatch):
    from farspark.llm import workers

    freed = []
    monkeypatch.setattr(workers, "release", lambda: freed.append(1))
    task = workers.releasing(lambda batches: (b + 1 for b in batches))([1, 2])
    assert next(task) == 2 and not freed
    assert list(task) == [3] and len(freed) == 1
    assert workers.releasing_group(lambda table: table * 2)(4) == 8 and len(freed) == 2


def test_only_cut_characters_are_decoded_in_python(spark):
    kept = [b"", "üß€ 😀".encode(), "ü".encode()[1:] + b"ab", "a€".encode()[:-1] + b"b", b"\xed\xa0\x80x", b"\xc0\xafy", b"\x00z", None]
    df = spark.createDataFrame([(i, k if k is None else bytearray(k)) for i, k in enumerate(kept)], "id long, kept binary").repartition(1)
    got = {r.id: r.text for r in df.select("id", substrings.as_text()("kept").alias("text")).collect()}
    assert got == {i: None if k is None else k.decode("utf-8", "ignore") for i, k in enumerate(kept)}
    plan = df.select(substrings.as_text()("kept").alias("text"))._jdf.queryExecution().optimizedPlan().toString()
    assert "isValid" in next(line for line in plan.splitlines() if "ArrowEvalPython" in line)


def test_tables_of_a_step_go_when_it_ends(spark, monkeypatch):
    import pathlib

    from farspark.operators import settle as settled

    rng, own, held, where = random.Random(9), settled.settle, [], pathlib.Path(settled.folder(spark).removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in where.rglob("*.parquet")) if where.exists() else 0
    before = size()

    def watched(*args, **kwargs):
        out = own(*args, **kwargs)
        held.append(size() - before)
        return out

    monkeypatch.setattr(substrings, "settle", watched)
    alone = ["".join(rng.choices("abcdefgh ", k=5000)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(alone)), "doc_id long, text string")
    assert substrings.remove_repeats(df, length=128).filter(F.size("removed") > 0).count() == 0
    assert max(held) < 0.2 * 200 * 5000  # no table of all runs: that would outgrow the texts
    held.clear()
    twice = [(i, t[1:] if i >= 200 else t) for i, t in enumerate(alone + alone)]
    got = substrings.remove_repeats(spark.createDataFrame(twice, "doc_id long, text string"), length=128)
    assert got.filter(F.octet_length("kept") <= 1).count() == 400
    assert max(held) < 2 * 400 * 5000, max(held)  # runs of repeats, their kinds and stretches at most


def test_chats_keep_maximal_conversations(spark):
    talks = {1: ["hi", "hello"], 2: ["hi", "hello", "bye"], 3: ["hi", "hello", "bye"], 4: ["hi", "other"], 5: ["hi"], 6: ["bye", "hi"], 7: [None], 8: [""]}
    rows = [(k, i, "user" if i % 2 == 0 else "assistant", t, 1) for k, v in talks.items() for i, t in enumerate(v)]
    rows += [(9, 0, None, "x", 1), (9, None, "user", "first", 1), (None, 0, "user", "hi", 1), (None, 1, "assistant", "hello", 1), (None, 2, "user", "bye", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int").repartition(4)
    got = {r.conv_id: r for r in chats.format_chats(df).collect()}
    assert sorted(got) == [2, 4, 6, 7, 9]
    assert got[2].n_copies == 3 and got[7].n_copies == 2 and got[2].n_turns == 3
    assert got[2].text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nbye<|im_end|>\n"
    assert got[9].text == "<|im_start|>user\nfirst<|im_end|>\n<|im_start|>user\nx<|im_end|>\n"
    assert chats.format_chats(df.limit(0)).count() == 0
