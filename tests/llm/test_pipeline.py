"""The pipeline's stages on the smallest table: what each keeps, and the columns it returns."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from edgewise.llm import pii

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, given, SF)
        if name == "bpe":
            assert all(r.round_trip for r in out.collect())
            assert out.count() == given.count()
            break
        assert out.columns == docs.columns
        before, after = {r.doc_id for r in given.collect()}, {r.doc_id for r in out.collect()}
        assert after <= before and len(after) > 0.5 * len(before)
        if name == "pii":
            assert after == before
            base = [f"size(spans_{k.name}) > 0" for k in pii.KINDS if k.base]
            assert pii.find_pii(out).filter(" or ".join(base)).count() == 0
        given = spark.createDataFrame(out.collect(), docs.schema)


def test_stage_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "pii", "mixing", "bpe"]


def test_null_and_repeated_ids(spark):
    words = {k: [f"{k}{i}" for i in range(60)] for k in "abcd"}
    text = lambda k, last="end": " ".join([*words[k], last])
    rows = [
        (None, text("a")), (None, text("b")), (1, text("b", "fin")), (2, text("c")), (2, text("d")), (3, text("c", "fin")),
        (None, None), (4, ""), (4, ""), (5, text("d")), (5, text("d")),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    want = [(None, text("a")), (1, text("b", "fin")), (2, text("c")), (2, text("d")), (None, None), (4, ""), (4, "")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_mixing_of_null_and_repeated_ids(spark):
    rows = [(None, f"null {i}", "en", "s", 6) for i in range(20)] + [(7, f"same {i}", "en", "s", 6) for i in range(20)] + [(i, f"own {i}", "en", "s", 6) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = [r.text for r in corpus_pipeline.mix_sources(spark, docs, "").collect()]
    assert set(mixed) == {r[1] for r in rows} and len(mixed) == 90


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, epochs long, spans_ip string, class_id long"


def odd_documents(spark):
    long = " ".join(f"word{i}" for i in range(30_000))
    texts = [(1, "write to a@b.org now"), (1, "other words under the same id"), (None, "no id at all"), (None, None), (2, ""), (2, ""), (3, long), (4, long + " end"), (5, "plain words"), (5, "plain words"), (6, "\n \t")]
    rows = [(i, t, None if k % 3 else "en", None if k % 4 == 1 else f"s{k % 2}", len(t or ""), 7, 8, "x", 9) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES if s[0] != "bpe"], ids=lambda s: s[0])
def test_odd_documents(spark, tmp_path, stage):
    name, run = stage
    docs = odd_documents(spark)
    spark.createDataFrame([(1, 1, 0), (5, 1, 0), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = run(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    got = out.collect()
    assert all((r.row, r.epochs, r.spans_ip, r.class_id) == (7, 8, "x", 9) for r in got)
    given = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    kept = sorted(((r.doc_id, r.text) for r in got), key=str)
    if name == "toxicity":
        assert kept == given
    if name == "ngram_join":  # the near copy and the repeated row go; texts without words have no near copies
        assert kept == sorted([x for x in given if x[0] not in (4, 5)] + [(5, "plain words")], key=str)
    if name == "pii":
        assert kept == sorted(((i, "write to <EMAIL> now" if t and "@" in t else t) for i, t in given), key=str)
        assert {r.n_chars for r in got if r.text is None} == {0}
    if name == "mixing":
        assert set(kept) <= set(given)
    empty = run(spark, docs.limit(0), str(tmp_path))
    assert empty.columns == docs.columns and empty.count() == 0


def test_tokens_of_odd_documents(spark):
    out = corpus_pipeline.encode_tokens(spark, odd_documents(spark), "")
    assert out.count() == 11 and out.filter("NOT round_trip").count() == 0
    assert corpus_pipeline.encode_tokens(spark, odd_documents(spark).limit(0), "").count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_run_equals_its_stages(spark):
    """Against brute force for the near copies, and the stages' own rules for the rest."""
    from edgewise.llm import toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = {r.doc_id: r for r in toxicity.score_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    left = sorted(i for i, r in scored.items() if r.predicted == 0)
    grams = {}
    for i in left:
        w = (scored[i].text or "").split()
        grams[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in left}
    links = [(a, b) for b in left for a in left if a < b and grams[a] and 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b])]
    for _ in range(len(left)):
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    kept = {i for i in left if label[i] == i}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} <= kept and len({r.doc_id for r in out}) > 0.8 * len(kept)
    times = {}
    for r in out:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert set(times.values()) <= {1, 2, 3} and all(r.round_trip for r in out)
