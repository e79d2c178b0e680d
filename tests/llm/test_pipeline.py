"""The pipeline's stages, each on what the one before kept, beside plain versions."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from claimloom import session
from claimloom.llm import packing, tokens
from claimloom.llm.shared import written
from tests.llm import brute
from tests.llm.fixtures import frame, texts


def test_run(spark, tmp_path):
    docs = frame(spark, texts())
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = P.run(spark, str(tmp_path)).toPandas()
    kept = {i: t for i, t in texts() if t and any(c.isalpha() for c in t)}
    first: dict[str, int] = {}
    for i, t in sorted(kept.items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    kept = {i: kept[i] for i in first.values()}
    kept = {i: kept[i] for i, _, c in brute.components(sorted(kept.items()), 5, 80, 100) if i == c}
    left = {i: (k if gone else kept[i]) for i, _, gone, k in brute.stripped(sorted(kept.items()), 20)}
    files = tokens.default_files()
    want = sorted((i, p, s, n) for i, t in left.items() for p, (s, n) in enumerate(packing.cut(len(tokens.encode(t, files)) + 1, 1024)))
    assert sorted(zip(got.doc_id, got.piece, got.start, got.length)) == want


def test_stages_keep_columns_and_stand_empty_tables(spark):
    clashing = {name: F.lit(i) for i, name in enumerate(["gone", "ranges", "of", "found", "kept_id", "kept_sha", "__key", "__id", "Key_", "sha"])}
    docs = frame(spark, texts(n=12)).withColumns(clashing)
    for _, stage in P.STAGES[:-1]:
        kept = stage(spark, docs, "")
        assert kept.columns == docs.columns
        assert {tuple(r[c] for c in clashing) for r in kept.collect()} == {tuple(range(10))}
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), "").collect() == []


@pytest.mark.parametrize("step", [session.cut_lineage, lambda df: written(df, "step")])
def test_steps_collect_the_drivers_garbage(spark, step, monkeypatch):
    """A driver whose heap has grown beyond its share is collected once a step is written, and else left alone."""

    def collections() -> int:
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Young" not in b.getName())

    for share, more in [(2, 0), (0, 1)]:
        monkeypatch.setattr(session, "SWEPT_SHARE", share, raising=False)
        before = collections()
        assert step(spark.range(3)).count() == 3
        assert collections() - before == more
