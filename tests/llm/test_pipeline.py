"""The corpus pipeline, stage by stage, on the smallest tables."""

import random

import corpus_pipeline as cp


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, count = docs.columns, docs.count()
    for k, (_, stage) in enumerate(cp.STAGES[:-1]):
        before = docs
        docs = cp.cut(stage(spark, docs, d), "test")
        assert docs.columns == columns
        if k != 3:
            assert docs.join(before, "doc_id", "left_anti").count() == 0
            assert 0.5 * count < docs.count() <= before.count()
    assert cp.STAGES[-1][1](spark, docs, d).where("length > 2048").count() == 0


def test_mixture_keeps_null_ids_and_counts_each_repeated_row(spark):
    from panelspark.llm.mixing import mix_sources

    text = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    rows = [(None, text(1, 30), "a"), (None, text(2, 41), "b"), (None, None, "c")] + [(5, text(k, 10 + k), "b") for k in range(20)] + [(k, text(k, 50), "a") for k in range(10, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = cp.mixed(spark, docs, "")
    assert got.columns == docs.columns
    want = {}
    for r in mix_sources(docs).collect():
        key = (r["doc_id"], r["source"], r["size"])
        want[key] = want.get(key, 0) + r["copies"]
    have = {}
    for r in got.collect():
        key = (r["doc_id"], r["source"], len((r["text"] or "").split()))
        have[key] = have.get(key, 0) + 1
    assert have == {k: v for k, v in want.items() if v}
    assert (None, "c", 0) in have and (None, "a", 30) in have


def test_stages_on_hard_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, an empty table."""
    line = "a licence line that recurs in very many documents of this little corpus and so it goes"
    word = lambda rng: "".join(rng.choices("abcdefghij", k=6))
    text = lambda k: " ".join(map(word, (random.Random(k * 70 + j) for j in range(60)))) + f"\n{line}"
    rows = [(i, text(i), "en", f"s{i % 3}", 9) for i in range(30)]
    rows += [(None, text(77), None, None, None), (40, None, None, "s1", None), (41, "", "en", None, 0), (5, text(5), "en", "s2", 9), (42, line, "en", "s0", 9), (43, "y" * 200_000, "de", "s1", 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    cleaned = cp.cut(cp.drop_lines(spark, docs, str(tmp_path)), "test")
    by = {(r["doc_id"], r["source"]): r for r in cleaned.collect()}
    assert cleaned.count() == len(rows) - 1 and (42, "s0") not in by  # of a document of recurring lines alone nothing is left
    assert by[(0, "s0")]["text"].endswith(line) and not by[(1, "s1")]["text"].endswith(line) and by[(1, "s1")]["n_chars"] == len(by[(1, "s1")]["text"])
    assert by[(40, "s1")]["text"] is None and by[(41, None)]["text"] == "" and by[(None, None)]["n_chars"] is not None
    kept = cp.one_of_each(spark, cleaned, str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted([*range(30), 5, 40, 41, 43])
    assert cp.run(spark, str(tmp_path)).where("length > 2048").count() == 0
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_dropped_lines_do_not_depend_on_how_many_share_a_segment(spark, monkeypatch):
    from test_edges import chains

    from panelspark.llm import line_dedup

    monkeypatch.setattr(line_dedup, "BLOCK", 7)
    rows, tree = chains()
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = sorted(r["doc_id"] for r in cp.drop_lines(spark, docs, "").collect())
    assert got == [i for i, x in enumerate(tree) if tree.count(x) < 3 or x == i]
