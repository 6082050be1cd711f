"""The pipeline's stages, each against a brute-force version on its own input, and run() as a whole."""

from collections import defaultdict

import corpus_pipeline as P
from keelstone.llm import lines, mixing, quality

from .test_operators import TEXTS, brute_dedup, brute_join, brute_measure, brute_targets, plain_alignment

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, stage_in = docs.columns, {}
    for k, (name, f) in enumerate(P.STAGES):
        stage_in[name] = docs
        f(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert name == "source mixing" or docs.columns == names
    rows = {k: {r.doc_id: r.text for r in v.collect()} for k, v in stage_in.items()}

    kept = rows["line dedup"]
    for d, t in rows["quality rules"].items():
        w, chars, symbols, *_, rep = brute_measure(t)
        if d in kept:
            assert w >= quality.MIN_WORDS and 2 * rep <= w
    assert len(kept) > 0.5 * len(rows["quality rules"])

    want = brute_dedup([(d, t, 0) for d, t in kept.items()], lines.MIN_WORDS)
    assert rows["n-gram jaccard join"] == {d: want[(d, t)] for d, t in kept.items()}

    table = list(rows["n-gram jaccard join"].items())
    classes, link = brute_join(table)
    after = set(rows["benchmark decontamination"])
    for t, ids in classes.items():
        near = set(ids) | {i for u in link[t] for i in classes[u]}
        assert near & after, "a group lost all of its documents"
        assert len(set(ids) & after) <= 1
        if len(near) == 1:
            assert near <= after
        for u in link[t]:
            assert not (set(ids) & after and set(classes[u]) & after)

    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    low = lambda t: (t or "").lower().encode().split()
    clean = {r.doc_id for r in stage_in["source mixing"].collect()}
    for d, t in rows["benchmark decontamination"].items():
        copied = any(b in t for b in items)
        assert not (copied and d in clean)
        if d not in clean and not copied:
            assert any(plain_alignment(low(b), low(t)) >= 0.4 * len(low(b)) for b in items)

    sizes, taken = defaultdict(int), defaultdict(int)
    source = {r.doc_id: r.source for r in stage_in["source mixing"].collect()}
    for d, t in rows["source mixing"].items():
        sizes[source[d]] += brute_measure(t)[0]
    for r in docs.collect():
        assert 0 < r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, goal in brute_targets(sizes).items():
        assert abs(taken[s] - goal) <= (mixing.EPOCHS + 1) * mixing.BLOCK

    whole = sorted(map(tuple, P.run(spark, SF).collect()))
    assert whole == sorted(map(tuple, docs.collect()))


CASES = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, _h string, c0 string, taken string, grp string"


def cases(spark):
    table = [(d, t, lang, s, len(t or ""), "k", "h", "c", "t", "g") for d, t, lang, s in TEXTS]
    return spark.createDataFrame(table, CASES)


def test_stages_chained_without_a_write_give_the_rows_of_run(spark):
    def chain():
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        for _, stage in P.STAGES:
            docs = stage(spark, docs, SF)
        return docs

    want = sorted(map(tuple, P.run(spark, SF).collect()))
    a = chain()
    b = chain()  # a second chain before the first is read
    assert sorted(map(tuple, a.collect())) == want
    again = P.run(spark, SF)
    assert sorted(map(tuple, b.collect())) == want and sorted(map(tuple, again.collect())) == want and sorted(map(tuple, a.collect())) == want


def test_a_stage_called_twice(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = P.quality_rules(spark, docs, SF)
    second = P.quality_rules(spark, first, SF)
    assert second.count() <= first.count() > 0


def test_run_leaves_only_its_result(spark):
    import os

    from keelstone.llm.common import prepare

    prepare(spark)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(folder))
    out = P.run(spark, SF)
    (new,) = set(os.listdir(folder)) - before
    assert new.startswith("pipeline-") and os.listdir(f"{folder}/{new}") == [str(len(P.STAGES) - 1)]
    assert out.count() > 0


def test_nulls_repeats_clashing_columns_and_empty_tables_through_all_stages(spark):
    docs = cases(spark)
    for df in (docs, docs.union(docs), docs.filter("false"), docs.filter("text IS NULL OR text = ''")):
        x, before = df, None
        for name, stage in P.STAGES:
            x, before = stage(spark, x, SF), x
            if name != "source mixing":
                assert x.columns == docs.columns and x.count() <= before.count()
        got = x.collect()
        assert all(0 < r.taken <= 3 * r.size for r in got)
        if df is not docs and df.isEmpty():
            assert got == []
