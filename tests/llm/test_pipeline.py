"""The pipeline on a small table against a brute-force version of its stages."""

import gc
import random
import re
import weakref

import corpus_pipeline
from credence.llm import byte_bpe, language_id, mixing
from credence.llm.common import SPACES
from test_llm import DOC, brute_components, near_texts, prose


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    rng = random.Random(21)
    texts = [(t, "en") for t in near_texts(rng)] + [(prose(lang, rng, rng.randint(5, 40)), lang) for _ in range(150) for lang in [rng.choice(["en", "de", "fr"])]]
    texts += [(t.replace(" ", "  "), lang) for t, lang in texts[-20:] if t]
    rows = [(i, t, lang, f"s{i % 4 if i % 3 else 0}", len(t or "")) for i, (t, lang) in enumerate(texts)]
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    kept = {r.doc_id: r.text for r in language_id.predict(docs, model).filter("NOT rejected").collect()}
    assert len(kept) > 150 and None not in kept.values()
    groups = {}
    for i, t in kept.items():
        groups.setdefault(re.sub(f"[{SPACES}]", "", t), []).append(i)
    kept = {i: kept[i] for i in (min(g, key=lambda j: (-len(kept[j]), j)) for g in groups.values())}
    order = sorted(kept)
    comps = brute_components([kept[i] for i in order])
    want = {order[i] for i, _, c in comps if i == c}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == want and len(out) == len(want)
    codec = byte_bpe.codec(*byte_bpe.vocabulary())
    assert {r.doc_id: r.n_tokens for r in out} == {i: len(codec.packed([kept[i]])[0]) // 4 for i in want}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_duplicates", "source_mixing", "byte_bpe"]


def test_stages_keep_the_columns(spark, tmp_path):
    rows = [(i, f"the house of water number {i} and that is all there is {'x' * i}", "en", None if i % 2 else "a", 1) for i in range(30)]
    docs = spark.createDataFrame(rows, DOC)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / stage.__name__)
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == docs.columns
        docs = after
    assert "text" not in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).columns


def test_the_schedule_is_in_the_result(spark, tmp_path):
    rows = [(i, f"text {i} " + "word " * (i % 50), "en", "big" if i < 400 else f"s{i % 4}", 1) for i in range(600)]
    given = str(tmp_path / "given")
    spark.createDataFrame(rows, DOC).repartition(7).write.parquet(given)
    docs = spark.read.parquet(given)
    want = {r.doc_id: r.position for r in mixing.mix(docs).collect()}
    path = str(tmp_path / "mixed")
    corpus_pipeline.mixture(spark, docs, "").write.parquet(path)
    got = {r.doc_id: (r.position, r.source) for r in corpus_pipeline.tokens(spark, spark.read.parquet(path), "").collect()}
    assert {i: at for i, (at, _) in got.items()} == want and sorted(want.values()) == list(range(600))
    shares = mixing.tempered({"big": 400, **dict.fromkeys("0123", 50)})
    taken = sum(source == "big" for at, source in got.values() if at < 96)
    assert abs(taken - 96 * shares["big"] / sum(shares.values())) <= 1
    without = {r.doc_id: r.position for r in corpus_pipeline.tokens(spark, docs, "").collect()}
    assert without != want and sorted(without.values()) == list(range(600))


def test_a_stage_frees_what_earlier_queries_left_in_the_driver(spark):
    ring = type("Ring", (), {})()
    ring.own, left = ring, weakref.ref(ring)
    gc.disable()
    try:
        del ring
        assert left() is not None
        corpus_pipeline._stage(lambda spark, docs, sf_dir: docs)(spark, spark.range(1), "")
        assert left() is None
    finally:
        gc.enable()


def test_the_driver_does_not_train(spark, monkeypatch):
    monkeypatch.setattr(language_id, "train", None)  # in this process; workers import a module of their own
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, prose(lang, rng, 30), lang, "a", 1) for i in range(60) for lang in [("en", "de", "fr")[i % 3]]], DOC)
    got = language_id.predict(docs, language_id.fit(docs)).collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 57
