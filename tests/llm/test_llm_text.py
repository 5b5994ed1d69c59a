"""Token counts, packing, mixing and license scans against plain Python."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from farspark.llm import licenses, mixing, packing, token_counts as tc
from farspark.llm.queries_text import BYTES, PIECES
from farspark.llm.tables import vocabulary

TEXTS = [None, "", " ", "a", "Hello  world ", "▁x ▁ y", "<s> </s> <unk>", "tab\tnew\nline", "naïve café 你好 🙂", "x " * 400, "word" * 300,
         "the the the", "<|endoftext|> and <|endoftext|>", "Hello  world "]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES))
    got = {r.doc_id: r for r in tc.token_counts(frame(spark, TEXTS), PIECES, limit=100).collect()}
    for i, t in enumerate(TEXTS):
        n = len(model.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 100)
    assert tc.token_counts(frame(spark, TEXTS).limit(0), PIECES).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab  ▁\n.é")), max_size=60), st.integers(1, 9))
def test_cut_texts_have_the_tokens_of_the_whole(text, size):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES))
    assert sum(len(model.encode(p)) for p in tc.parts(text, size)) == len(model.encode(text))


def test_a_vocabulary_that_crosses_words_is_refused():
    with pytest.raises(ValueError):
        tc.check_pieces(["▁a", "b▁c"])


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=12))
def test_a_plan_places_every_piece_and_is_near_the_bound(counts):
    plan = packing.plan(counts, 32)
    used = Counter()
    for lengths, times in plan:
        assert sum(lengths) <= 32
        for n in lengths:
            used[n] += times
    assert used == Counter(counts)
    total, bins = sum(n * c for n, c in counts.items()), sum(t for _, t in plan)
    assert -(-total // 32) <= bins <= max(1, 2 * total // 32 + 1)


def test_exact_complements_are_found():
    assert sum(t for _, t in packing.plan({600: 5, 424: 5, 500: 3, 300: 3, 200: 3, 24: 3}, 1024)) == 8
    with pytest.raises(ValueError):
        packing.plan({1025: 1})


def test_pieces_carry_the_reference_ids(spark):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(vocabulary(BYTES))
    want = {i: reference.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(TEXTS)}
    rows = packing.token_pieces(frame(spark, TEXTS), BYTES, capacity=64).orderBy("doc_id", "piece").collect()
    got = {i: [] for i in want}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length <= 64 and r.start == len(got[r.doc_id]) and (r.piece == 0 or r.length == 64)
        got[r.doc_id] += ids
    assert got == want


def test_packing_has_no_gaps_and_keeps_columns(spark):
    sizes = [64, 64, 63, 1, 1, 1, 30, 34, 20, 40, 4, 17, None, 0] + [2] * 40
    df = spark.createDataFrame([(i, 0, n, "x") for i, n in enumerate(sizes)], "doc_id long, piece int, length long, offset string")
    rows = packing.pack(df, ["doc_id", "piece"], capacity=64).collect()
    assert len(rows) == len(sizes)
    by_sequence = {}
    for r in rows:
        if r.length:
            by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        else:
            assert r.sequence_id is None and r.offset is None
    for places in by_sequence.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64
    assert len(by_sequence) == -(-sum(n or 0 for n in sizes) // 64)
    assert packing.pack(df.limit(0), ["doc_id"]).count() == 0


def test_sequences_join_the_pieces(spark):
    pieces = packing.token_pieces(frame(spark, TEXTS).drop("n_tokens"), BYTES, capacity=64)
    packed = packing.pack(pieces, ["doc_id", "piece"], capacity=64)
    joined = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in joined) == 4 * packed.agg(F.sum("length")).first()[0]
    assert all(len(r.ids) == 4 * r.length for r in joined)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.integers(0, 50), st.sampled_from([5, 2, 1])), min_size=1))
def test_quotas_share_by_weight_below_the_caps(parts):
    total = sum(n for n, _ in parts.values())
    got = mixing.quotas({s: 3 * n for s, (n, _) in parts.items()}, {s: w for s, (_, w) in parts.items()}, total)
    assert sum(got.values()) == total and all(got[s] <= 3 * n for s, (n, _) in parts.items())
    open_ = {got[s] / w for s, (n, w) in parts.items() if got[s] < 3 * n}
    assert len(open_) <= 1


def test_flow_prefers_first_copies_and_uses_overlap():
    offers = [(("a",), 10), (("a", "b"), 10), (("b",), 2)]
    given_ = mixing.flow(offers, {"a": 10, "b": 12})
    assert sum(g.get("a", 0) for g in given_) == 10 and sum(g.get("b", 0) for g in given_) == 12
    assert [sum(g.values()) for g in given_] == [10, 10, 2]
    starved = mixing.flow([(("a",), 2)], {"a": 100})
    assert starved[0]["a"] == 6


def test_mix_meets_targets_and_repeats_itself(spark):
    rows = [(i, 1 + i * 37 % 50, s) for i in range(900) for s in [[["x"], ["y"], [None]][i % 3]]] + [(900, None, ["x"]), (901, 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, size long, members array<string>")
    mixed = mixing.mix(docs, ["doc_id"])
    first, again = ({r.doc_id: r for r in mixing.mix(docs.repartition(n), ["doc_id"]).collect()} for n in (1, 5))
    assert {i: r.copies for i, r in first.items()} == {i: r.copies for i, r in again.items()} and len(first) == 902
    totals = mixed.groupBy("members", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).collect()
    for r in totals:
        if r.members is not None:
            assert abs(r.taken - r.target) <= 3
    everything = sum(n or 0 for _, n, _ in rows)
    assert {r.members[0]: round(r.target) for r in totals if r.members} == {
        k: round(everything * w / 8) for k, w in (("x", 5), ("y", 2), (None, 1))}
    assert mixing.mix(docs.limit(0), ["doc_id"]).count() == 0


def test_mix_meets_the_flow_beside_a_very_long_document(spark):
    rows = [(i, 400, ["x"]) for i in range(500)] + [(500, 200_000, ["x"])] + [(1000 + i, 1 + i * 7919 % 5000, ["y"]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, size long, members array<string>")
    for seed in (1, 2, 3, 4):
        got = mixing.mix(docs, ["doc_id"], total=360_000, weights=(2, 1), seed=seed).collect()
        for source, target in (("x", 240_000), ("y", 120_000)):
            own = [r for r in got if r.members == [source]]
            short = target - sum(r.copies * r.size for r in own)
            left_out = [r.size for r in own if r.copies == 0]
            assert own[0].target == target and 0 <= short < min(400, *left_out)


def test_mix_takes_repeated_rows_one_by_one(spark):
    rows = [(None, 7, ["x"])] * 200 + [(i, 1100, ["x"]) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, size long, members array<string>")
    got = mixing.mix(docs, ["doc_id"], total=1000).collect()
    assert len(got) == 220 and 0 <= 1000 - sum(r.copies * r.size for r in got) < 7


LICENSED = [None, "", "no words? !!", "Released under the MIT License.", "UNDER THE MIT-LICENSE under the mit license, Apache License, Version 2.0; cc by nc",
            "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "under the mitß license",
            "éunder the mit license", "mit der Apache 2", "redistribute it under the terms of the BSD 3-Clause license", "apache license version 23",
            "cc by nc cc by nc by nc", "SPDX-License-Identifier: MPL-2.0"]


def test_license_phrases_equal_plain_python(spark):
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(LICENSED)], "doc_id long, text string, n_words string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, t in enumerate(LICENSED):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = sorted((k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(words))
                        if words[k:k + len(phrase.split())] == phrase.split())
        assert got[i].n_words == len(words), t
        assert sorted((h.start, h.label) for h in got[i].phrases) == places, t
    labels = {i: sorted({h.label for h in r.detections}) for i, r in got.items()}
    assert labels[6] == ["gpl-3"] and labels[10] == ["bsd-3"] and labels[13] == ["mpl-2"] and labels[7] == [] and labels[8] == ["mit"]
    assert labels[5] == ["cc-by-nc"] and labels[0] == labels[1] == labels[2] == []
    for r in got.values():
        spans = [(h.start, -h.minus_stop) for h in r.detections]
        assert not any(a != b and b[0] <= a[0] and a[1] <= b[1] for a in spans for b in spans)


def test_there_are_hundreds_of_rules_and_all_compile():
    rules = licenses.rules()
    assert len(rules) > 200 and len({r[0] for r in rules}) == len(rules)
    for *_, pattern, score in rules:
        re.compile(pattern)
        assert 0 <= score <= 1


def test_crc_of_ids_is_of_little_endian_numbers(spark):
    r = packing.token_pieces(frame(spark, ["a b"]), BYTES).withColumn("crc", F.crc32("ids")).first()
    assert r.crc == zlib.crc32(np.frombuffer(r.ids, "<u4").astype("<u4").tobytes())
