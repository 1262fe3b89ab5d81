"""The pipeline's stages, one after another, against what each of them must do to its own input."""

import hashlib
import importlib

import pytest

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    import corpus_pipeline

    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        at = f"file://{tmp_path_factory.mktemp('stage')}/{k}"
        f(spark, docs, SF).write.parquet(at)
        out = spark.read.parquet(at)
        seen.append((name, docs.toPandas(), out.toPandas()))
        docs = out
    return {name: (before, after) for name, before, after in seen}


def test_columns(stages):
    for name in list(stages)[:-1]:
        before, after = stages[name]
        assert list(before.columns) == list(after.columns) and len(after)


def test_quality(spark, stages):
    before, after = stages["quality"]
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    kept = set(after["doc_id"])
    known = before[before["doc_id"].isin(labels.index)]
    right = [(d in kept) == (labels[d] == 1) for d in known["doc_id"]]
    assert sum(right) / len(right) > 0.97
    assert after.merge(before, on=list(before.columns)).shape == after.shape


def test_near_duplicates(stages):
    ops = importlib.import_module("tests.llm.test_operators")
    before, after = stages["near_duplicates"]
    rows = list(zip(before["doc_id"], before["text"], strict=True))
    want = {c for _, _, c in ops.brute_components(rows)}
    assert sorted(after["doc_id"]) == sorted(want)


def test_secrets(stages):
    ops = importlib.import_module("tests.llm.test_operators")
    before, after = stages["secret_masking"]
    after = after.set_index("doc_id")
    hits = 0
    for d, t in zip(before["doc_id"], before["text"], strict=True):
        spans = ops.brute_secrets(t)
        new = after.loc[d, "text"]
        assert not ops.brute_secrets(new) and len(new) == after.loc[d, "n_chars"]
        hits += bool(spans)
        if new == t:
            assert not spans
    assert hits


def test_mixture(stages):
    ops = importlib.import_module("tests.llm.test_operators")
    before, after = stages["mixture"]
    size = lambda f: f["text"].map(lambda t: len(ops.WORD.findall(t or "")))
    had, got = before.assign(s=size(before)).groupby("source")["s"].sum(), after.assign(s=size(after)).groupby("source")["s"].sum()
    want = ops.brute_targets(had.to_dict())
    for s, target in want.items():
        assert abs(got.get(s, 0) - target) <= size(before).max()
    assert after.groupby("doc_id").size().max() <= 3


def test_tokens(stages):
    before, after = stages["tokens"]
    assert sorted(after["doc_id"]) == sorted(before["doc_id"])
    want = {d: hashlib.sha256(t.encode()).hexdigest() for d, t in zip(before["doc_id"], before["text"], strict=True)}
    assert all(want[d] == h for d, h in zip(after["doc_id"], after["decoded_sha256"], strict=True))


def test_run(spark, stages):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(zip(got["doc_id"], got["ids_sha256"], strict=True)) == sorted(zip(stages["tokens"][1]["doc_id"], stages["tokens"][1]["ids_sha256"], strict=True))
