"""The pipeline stage by stage, its registration, and the operators that SQL can express."""

import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from farspark.llm.queries import ORACLES, QUERIES
from suite import check
from test_llm_copies import covered, grouped, word_sets

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@here
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert check.compare(spark, check.connect(SF), QUERIES[name], ORACLES[name], SF) is None


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} and set(QUERIES) <= set(names) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "mixing", "best_fit_packing"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(80)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, labels = [], []
    for i in range(240):
        body = text(rng.randint(60, 140))
        if i % 4 == 0:
            body = body.replace(" ", " blargface ", 2)
        rows.append([i, body, "en", f"src{i % 3}", len(body)])
        labels.append((i, 1, int(i % 4 == 0)))
    for i, of in ((240, 1), (241, 2), (242, 2)):
        rows.append([i, rows[of][1] + " extra", "en", "src0", 0])
    passage = text(70)
    for i in (243, 244):
        rows.append([i, f"{text(80)} {passage} {text(80)}", "en", None, 0])
    rows += [[245, None, None, None, None], [246, "", "en", "src1", 0], [247, "naïve " * 3, "fr", "src1", 18], [None, text(50), "en", "src1", 1]]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_the_first_stage_hands_on_a_settled_table(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, corpus)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "Scan parquet" in plan and kept.columns == docs.columns


def test_the_passage_stage_hands_on_a_settled_table(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    cut = corpus_pipeline.drop_repeats(spark, docs, corpus)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "Scan parquet" in plan and cut.columns == docs.columns


@pytest.fixture(scope="module")
def stages(spark, corpus):
    docs, out = spark.read.parquet(f"{corpus}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, corpus)
        docs.write.parquet(f"{corpus}/{name}.parquet")
        docs = spark.read.parquet(f"{corpus}/{name}.parquet")
        out.append((before.collect(), docs.collect(), docs.columns))
    return out


def test_toxic_documents_go_and_clean_ones_stay(stages):
    before, after, columns = stages[0]
    assert columns == COLUMNS
    toxic = {r.doc_id for r in before if r.text and "blargface" in r.text}
    left = {r.doc_id for r in after}
    assert len(toxic & left) <= 2 and len({r.doc_id for r in before} - toxic - left) <= 3


def test_one_of_each_group_stays(stages):
    before, after, columns = stages[1]
    assert columns == COLUMNS
    sets = word_sets([(r.doc_id, r.text) for r in before if r.doc_id is not None])
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert links
    want = {i for i, c in grouped(links, list(sets)).items() if i == c}
    assert {r.doc_id for r in after if r.doc_id is not None} == want and len(after) == len(want) + sum(r.doc_id is None for r in before)


def test_passages_go_and_documents_stay(stages):
    before, after, columns = stages[2]
    assert columns == COLUMNS
    want = covered([(r.doc_id, (r.text or "").encode()) for r in before], corpus_pipeline.PASSAGE_BYTES)
    got = {r.doc_id: r for r in after}
    assert {i: (r.text or "").encode() for i, r in got.items()} == {i: kept for i, (kept, _) in want.items()}
    cut = [i for i, (_, spans) in want.items() if spans]
    assert cut and all(got[i].n_chars == len(got[i].text) for i in cut)


def test_passages_of_just_over_fifty_short_words_go(spark, corpus):
    rng = random.Random(5)
    text = lambda n, k: " ".join("".join(rng.choice("abcdefghij") for _ in range(k)) for _ in range(n))
    passages = [text(51, k) for k in (2, 3, 4, 5)]
    assert [len(p) for p in passages] == [152, 203, 254, 305]
    rows = [(i, f"{text(80, 6)} {passages[i // 2]} {text(80, 6)}", "en", "src0", 0) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for r in corpus_pipeline.drop_repeats(spark, docs, corpus).collect():
        before, after = rows[r.doc_id][1].split(passages[r.doc_id // 2])
        assert passages[r.doc_id // 2] not in r.text and len(before + after) - 6 <= len(r.text) <= len(before + after)


def test_the_mix_repeats_documents_whole(stages):
    before, after, columns = stages[3]
    assert columns == COLUMNS
    rows = {tuple(r) for r in before}
    copies = {}
    for r in after:
        assert tuple(r) in rows
        copies[tuple(r)] = copies.get(tuple(r), 0) + 1
    assert max(copies.values()) <= 3
    size = lambda r: len((r["text"] or "").split())
    sources = sorted({r.source for r in before}, key=lambda s: (s is None, s or ""))
    held = {s: sum(size(r) for r in before if r.source == s) for s in sources}
    from farspark.llm.mixing import WEIGHTS, quotas

    target = quotas({s: 3 * n for s, n in held.items()}, {s: WEIGHTS[i % 3] for i, s in enumerate(sources)}, sum(held.values()))
    for s in sources:
        assert abs(sum(size(r) for r in after if r.source == s) - target[s]) <= 60


def test_every_token_is_packed(spark, stages):
    from tokenizers import Tokenizer

    from farspark.llm.tables import vocabulary

    before, after, _ = stages[4]
    reference = Tokenizer.from_file(vocabulary(corpus_pipeline.TOKENIZER))
    total = sum(len(reference.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before)
    assert sum(r.length for r in after) == total
    by_sequence = {}
    for r in after:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(by_sequence) <= 1.1 * total / 1024 + 1


def test_the_whole_pipeline_equals_its_stages(spark, corpus, stages):
    key = lambda rows: sorted((r.doc_id or -1, r.piece, r.length, r.ids_crc32) for r in rows)
    assert key(corpus_pipeline.run(spark, corpus).collect()) == key(stages[4][1])


def test_the_pipeline_takes_an_empty_table(spark, corpus, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{corpus}/{t}.parquet").filter(F.lit(False)).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_under_null_and_repeated_ids_go(spark):
    rng = random.Random(21)
    body = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(100)) for _ in range(4)]
    rows = [(5, body[0]), (None, body[0] + " more"), (None, body[0] + " other"), (None, body[1]), (5, body[2]), (9, body[2] + " end"),
            (7, body[3]), (7, body[3]), (None, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_hash", F.lit("clash"))
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    got = sorted(((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()))
    assert got == sorted([(5, body[0]), (0, body[1]), (5, body[2]), (7, body[3]), (0, ""), (8, "")])


def test_the_toxicity_sample_is_bounded(spark, monkeypatch):
    from farspark.llm import toxicity

    seen = []
    monkeypatch.setattr(toxicity, "train", lambda bags, labels, prior: seen.append((len(bags), max(map(len, bags)))))
    monkeypatch.setattr(toxicity, "MOST_NGRAMS", 50)
    long = " ".join(f"word{i}" for i in range(500))
    docs = spark.createDataFrame([(1, f"{long} {i}") for i in range(300)] + [(2, "short one"), (2, "short two")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0)], "doc_id long, toxic int")
    toxicity.fit(docs, labels, sample=1)
    assert seen == [(2, 50)]
