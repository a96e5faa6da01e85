"""The pipeline and its queries, on whole small tables."""

import re

import duckdb
import pytest

SF = "/root/testdata/sf0.01"


def test_stages_keep_the_columns_and_take_effect(spark):
    import corpus_pipeline as cp
    from corpusloom.llm.decontam import matched
    from corpusloom.llm.neardup import near_duplicates
    from corpusloom.llm.secrets import base_spans
    from corpusloom.llm.shared import stored, table

    docs = table(spark, SF, "documents")
    columns, n = docs.columns, [docs.count()]
    assert 4 <= len(cp.STAGES) <= 5
    for name, stage in cp.STAGES[:-1]:
        before = docs
        docs = stored(stage(spark, before, SF), name)
        assert docs.columns == columns
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        n.append(docs.count())
        if name == "near_copies":
            assert near_duplicates(docs, percent=80).where("not kept").count() == 0
        if name == "decontamination":
            assert matched(docs, table(spark, SF, "benchmark"), ["doc_id"]).where("contaminated").count() == 0
        if name == "secrets":
            assert n[-1] == n[-2] and not any(base_spans(r.text) for r in docs.select("text").collect())
            assert docs.where("n_chars <> char_length(text)").count() == 0
    assert n[0] > n[1] > n[2] >= n[3] == n[4] > 0.4 * n[0]
    out = cp.run(spark, SF)
    assert out.count() == n[-1] and out.where("taken > 3 * size").count() == 0


def test_stages_equal_brute_force(spark):
    """What the classifier keeps, taken through the other stages by plain loops."""
    import corpus_pipeline as cp
    from test_operators import brute_components, brute_windows

    from corpusloom.llm.secrets import redacted, scan
    from corpusloom.llm.shared import stored, table

    stages = dict(cp.STAGES)
    docs = stored(stages["quality"](spark, table(spark, SF, "documents"), SF), "quality")
    left = {r.doc_id: r.text for r in docs.collect()}
    named = {d for d, _, _, kept in brute_components(sorted(left.items()), 80) if kept}
    left = {i: t for i, t in left.items() if i in named}
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    few = [x for x in items if any(w in t.lower() for w in [" ".join(x[1].lower().split()[:4])] for t in left.values())]  # items whose first words occur at all
    hit = {r[0] for r in brute_windows(list(left.items()), few) if r[5]}
    clean = {i for i in left if i not in hit}
    kept = {}
    for name in ("near_copies", "decontamination", "secrets"):
        docs = stored(stages[name](spark, docs, SF), name)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert kept["near_copies"] == left
    assert set(kept["decontamination"]) <= clean and set(kept["secrets"]) == set(kept["decontamination"])
    rest = clean - set(kept["decontamination"])  # whose items begin otherwise: each of them has a window of some item
    grams = {tuple(w[k : k + 10]) for _, t in items for w in [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())] for k in range(max(1, len(w) - 9))}
    words = {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) for i, t in left.items()}
    dirty = {i for i, w in words.items() if any(tuple(w[k : k + 10]) in grams for k in range(len(w) - 9))}
    assert rest == dirty - hit and hit <= dirty
    for i, t in kept["secrets"].items():
        base, more, *_ = scan(left[i])
        assert t == (redacted(left[i], [*base, *more]) if base or more else left[i])


@pytest.mark.parametrize("name", ["quality", "near_copies", "decontamination", "secrets", "mixture"])
def test_stages_of_clashing_names(spark, name):
    """Extra columns named like what a stage makes are passed on, and change nothing."""
    import corpus_pipeline as cp
    from pyspark.sql import functions as F

    extra = "kept contaminated found g own_0 n_words spans node size target taken positions expected_grade".split()
    plain = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 150")
    docs = plain.select("*", *(F.lit("x").alias(c) for c in extra))
    out, want = dict(cp.STAGES)[name](spark, docs, SF), dict(cp.STAGES)[name](spark, plain, SF)
    assert out.columns == (docs.columns if name != "mixture" else want.columns)
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in want.collect())


def test_stages_of_odd_tables(spark):
    import corpus_pipeline as cp

    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "same text here " * 9, None, "s", 135), (3, "same text here " * 9, None, "s", None)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in cp.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= len(rows)
            docs = out if out.columns == schema.names else docs


@pytest.mark.parametrize("name", ["op5_fixity_audit", "op9_source_mix"])
def test_queries_equal_their_sql(spark, name):
    from corpusloom.llm import registry

    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = registry.QUERIES[name](spark, SF).collect()
    want = c.sql(registry.ORACLE_SQL[name])
    cols = sorted(want.columns)
    plain = lambda rows: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert plain([r[c] for c in cols] for r in found) == plain(c.sql(f"select {', '.join(chr(34) + x + chr(34) for x in cols)} from want").fetchall())
    assert found


def test_registry(spark):
    from corpusloom.llm import registry

    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES if n != "pipeline") == list(range(1, 11))


def test_small_tables_are_in_few_files(spark, tmp_path):
    """However many partitions there are: each file that an executor writes starts processes beside it."""
    import glob

    import corpus_pipeline as cp
    from corpusloom.llm.neardup import near_duplicates
    from corpusloom.llm.shared import shared_dir, table

    cores, hot = spark.sparkContext.defaultParallelism, {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in hot}
    files = lambda: set(glob.glob(shared_dir(spark).removeprefix("file://") + "/*/part-*.parquet"))
    try:
        for k, v in hot.items():
            spark.conf.set(k, v)
        docs, before = table(spark, SF, "documents").repartition(23), files()
        near_duplicates(docs, percent=80).count()
        folders = [f.rsplit("/", 2)[1] for f in files() - before]
        assert {x.split("-")[0] for x in folders} >= {"sketches", "classes", "entries", "members", "edges", "named"}
        assert max(folders.count(x) for x in folders) <= cores
        for name, stage in cp.STAGES[:-1]:
            stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
            assert len(glob.glob(f"{tmp_path}/{name}/part-*.parquet")) <= cores, name
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
