"""Hard rows for every operator: nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.llm import ego, hamming, jaccard, line_dedup, mixing, packing, quality, token_counts


def words(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))


def test_line_dedup_keeps_columns_of_any_name(spark):
    line = "this very line recurs in two documents of the table and has more than twenty tokens so that two are enough here"
    rows = [(i, f"{words(i)}\n{line}", f"r{i}", [i], "d") for i in range(2)] + [(None, line, "n", None, None), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _row string, _gone array<int>, d string").withColumnRenamed("_gone", "gone")
    got = {(r["doc_id"], r["_row"]): r for r in line_dedup.drop_recurring_lines(frame).collect()}
    assert got[0, "r0"]["text"].endswith(line) and got[1, "r1"]["text"] == words(1) and got[1, "r1"]["gone"] == [1] and got[1, "r1"]["d"] == "d"
    assert got[None, "n"]["text"] == "" and got[None, None]["text"] is None and got[None, None]["n_lines"] == 0


def test_line_dedup_of_a_very_long_text(spark):
    text = "\n".join(words(i, 12) for i in range(3000))
    got = line_dedup.drop_recurring_lines(spark.createDataFrame([(1, text), (2, text + "\nits own " + "x" * 600_000)], "doc_id long, text string")).collect()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_lines"] == 3000 and by[1]["n_dropped"] == 0
    # Lines of 12 tokens recur from four documents on.
    assert by[2]["n_dropped"] == 0
    got = line_dedup.drop_recurring_lines(spark.createDataFrame([(i, text + "\n" + words(9000 + i, 9)) for i in range(4)], "doc_id long, text string")).collect()
    assert sorted(r["n_dropped"] for r in got) == [0, 3000, 3000, 3000]


def test_three_interleaved_templates_lose_all_repeats(spark):
    forms = ("the quick worker has finished job {} for client {} on that machine", "the quick worker sent mail to {} about order {} of last week", "the quick worker lost touch with {} while {} was still in transfer")
    rows = [(i, forms[i % 3].format(words(2 * i, 1), words(2 * i + 1, 1))) for i in range(60)]
    assert len({len(t.split()) for _, t in rows}) == 1
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: int(i >= 3) for i in range(60)}


def test_elections_place_lines_of_large_segments(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 5)
    rows = [(i, f"one two three {words(i % 2, 8)} then {words(100 + i, 1)} done") for i in range(40)]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: int(i >= 2) for i in range(40)}


def chains():
    """Texts of a line each: words replaced step by step, so that most near pairs join lines that no third is near to; and their templates' numbers by brute force."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = []
    for k in range(6):
        now = ["one", "two", "three", *(word() for _ in range(12))]
        for i in range(20):
            if i % 7 < 6:
                for at in rng.sample(range(3, 15 - 4 * (k % 2)), 2 + k % 2):
                    now[at] = word()
            rows += [" ".join(now)] * (8 if i == 9 else 1)
    rows += ["one two three " + " ".join(word() for _ in range(8)) + " a b c d" for _ in range(30)]
    lines = [r.split() for r in rows]
    tree = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if tree[i] != tree[j] and sum(a != b for a, b in zip(lines[i], lines[j], strict=True)) <= 3:
                old, new = max(tree[i], tree[j]), min(tree[i], tree[j])
                tree = [new if x == old else x for x in tree]
    return rows, tree


@pytest.mark.parametrize("block", [2, 7, 1024])
def test_large_segments_lose_no_near_lines(spark, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rows, tree = chains()
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.drop_recurring_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert len({len(r.split()) for r in rows}) == 1 and len(set(tree)) > 30
    # Lines of 15 tokens recur from three documents on.
    assert got == {i: int(tree.count(x) >= 3 and x != i) for i, x in enumerate(tree)}


def test_narrowing_does_not_repeat_lines_that_are_known_to_be_connected(spark, monkeypatch):
    """Two of 20 words differ from a text that no line is: parts agree for most lines, round after round."""
    monkeypatch.setattr(line_dedup, "BLOCK", 32)
    rng = random.Random(3)
    lines = []
    for i in range(600):
        codes = np.arange(20, dtype=np.uint32)
        codes[rng.sample(range(3, 20), 2)] = [1000 + 2 * i, 1001 + 2 * i]
        lines.append((7, i, 1, codes))
    members = spark.createDataFrame([x[:2] for x in lines], "segment long, line long")
    codes = spark.createDataFrame([(x[1], bytearray(x[3].tobytes())) for x in lines], "line long, codes binary")
    pairs, left = line_dedup._narrowed(members, codes, spark.createDataFrame([x[1:3] for x in lines], "line long, docs long"))
    assert left.count() <= 20 * len(lines)
    near = left.join(codes, "line").groupBy("segment").applyInPandas(line_dedup._compare, "u long, v long")
    assert [r["component"] for r in line_dedup.components(pairs.unionByName(near)).collect()] == [0] * len(lines)


@pytest.mark.parametrize("rule", ["most", "start"])
def test_token_counts_of_every_section(spark, rule):
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    lengths = token_counts.TokenLengths(path, pattern)
    texts = ["a line\n\nanother  one 12345\nÜber 日本\n\n\n", "x" * 5000 + "\n" + "y z " * 2000, None, "", "no newline"]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(0, texts[0], 8), (None, texts[4], 9)]
    got = token_counts.section_tokens(spark.createDataFrame(rows, "doc_id long, text string, section int"), path, pattern, rule).toPandas()
    assert (got["doc_id"].fillna(-1) == 0).sum() == 2 * (texts[0].count("\n")) and got["doc_id"].isna().sum() == 1
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        ends = [k + 1 for k, c in enumerate(raw) if c == 10 and k + 1 < len(raw)] + [len(raw)]
        want, at = [0] * len(ends), 0
        for token in lengths.encoding.encode_ordinary(t or ""):
            size = int(lengths.sizes[token])
            shares = [0] * len(ends)
            for k in range(at, at + size):
                shares[next(s for s, e in enumerate(ends) if k < e)] += (raw[k] & 0xC0) != 0x80
            first = next(s for s, e in enumerate(ends) if at < e)
            # A part of a character has no code point of its own and stays where it starts.
            want[first if rule == "start" or not any(shares) else shares.index(max(shares))] += 1
            at += size
        mine = got[got["doc_id"] == i].drop_duplicates("section").sort_values("section")
        assert mine["tokens"].tolist() == want


def test_jaccard_rows_of_one_id_and_of_none(spark):
    a, b, c = words(1), words(2), words(3)
    rows = [(5, a, "x"), (5, b, "x"), (2, a + " more", "y"), (None, b + " extra", "z"), (None, c, "z"), (None, c, "z"), (9, None, "q"), (9, "", "q")]
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string, row string"), 3, 90).collect()
    assert len(found) == len(rows)
    assert {tuple(r) for r in found} == {(5, 58, 2), (5, 58, 5), (2, 59, 2), (None, 59, 5), (None, 58, None), (9, 0, 9)}


def test_prefix_entries_leave_in_small_frames():
    """A batch of many entries takes little memory beside itself, and every entry of it arrives."""
    rng, lots, percent = np.random.default_rng(3), 50, 80
    prefix = [rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in rng.integers(0, 160, 5000)]
    n = np.array([5 * len(x) + 1 for x in prefix])
    nodes = pd.DataFrame({"doc_id": np.arange(5000) * 3, "comp": np.arange(5000) * 3 // 2, "n": n, "prefix": [x.tobytes() for x in prefix]})
    got = list(jaccard._entries(percent, lots)(iter([nodes])))
    tracemalloc.start()
    for frame in jaccard._entries(percent, lots)(iter([nodes])):
        del frame
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    kinds = {"key": np.uint32, "ids": np.int64, "comp": np.int64, "n": np.int32, "place": np.int32, "group": np.int16}
    cells = [tuple(np.frombuffer(r[c], dtype=k) for c, k in kinds.items()) for frame in got for r in frame.to_dict("records")]
    have = sorted(zip(*(np.concatenate(x).tolist() for x in zip(*cells, strict=True)), strict=True))
    want = []
    for i, (x, size) in enumerate(zip(prefix, n.tolist(), strict=True)):
        band = int(np.floor(np.log(size) / np.log(100 / percent) + 1e-9))
        for group in {band // jaccard.BANDS, (band - 1) // jaccard.BANDS}:
            with np.errstate(over="ignore"):
                code = jaccard.mix(x ^ (np.array([group + 2]).astype(np.uint64) * jaccard.KEY)) >> np.uint64(32)
            want += [(int(k), 3 * i, 3 * i - 3 * i // 2, size, at, group) for at, k in enumerate(code)]
    assert have == sorted(want)
    assert most < 60 * len(want)


def test_hamming_of_repeated_ids_long_codes_and_empty_tables(spark):
    rows = [(1, [0, 0], "a"), (1, [0, 0], "b"), (2, [0, 1], "c"), (3, [-1, -1], "d"), (4, None, "e"), (None, [0, 0], "f"), (5, [0], "g")]
    codes = spark.createDataFrame(rows, "id long, code array<long>, rank string")
    got = [(r["query_id"], r["rank"], r["id"], r["distance"]) for r in hamming.hamming_top_k(codes, codes.where("id = 2"), 4).orderBy("rank").collect()]
    assert got == [(2, 1, 2, 0), (2, 2, 1, 1), (2, 3, 1, 1), (2, 4, 5, 1)]
    assert hamming.hamming_top_k(codes.limit(0), codes, 3).count() == 0 and hamming.hamming_top_k(codes, codes.limit(0), 3).count() == 0
    wide = spark.createDataFrame([(1, [0.5] * 70 + [-1.0] * 30), (2, None), (3, [])], "id long, v array<double>").select("id", hamming.sign_code(F.col("v")).alias("c")).collect()
    assert [len(r["c"]) if r["c"] else None for r in wide] == [2, None, None] and sum(bin(x & (2**64 - 1)).count("1") for x in wide[0]["c"]) == 70


def test_quality_of_hard_rows(spark):
    rows = [(i, words(i) if i % 3 else "!!! ### $$$ " * 30, "x") for i in range(40)] + [(None, words(1), "x"), (50, None, "x"), (51, "", "x"), (52, "z" * 300_000, "x"), (1, words(1), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels).toPandas()
    assert len(got) == len(rows) and got["score"].between(0, 1).all() and not got.loc[got["doc_id"].isna(), "held_out"].any()
    assert got[got["doc_id"] == 1]["score"].nunique() == 1
    # Negative labels are never read: without them nothing changes.
    again = quality.quality_scores(docs, labels.where("quality = 1")).toPandas()
    assert np.allclose(got.sort_values(["doc_id", "score"])["score"], again.sort_values(["doc_id", "score"])["score"])


def test_the_prior_is_found_without_negatives(spark):
    from panelspark.llm.common import cut

    bad = lambda i: " ".join(random.Random(i).choices(["###", "buy!!", "$$$", "NOW", "%%", "click"], k=50))
    rows = [(i, words(i, 50) if i % 10 < 7 else bad(i)) for i in range(1500)]
    every = cut(spark.createDataFrame(rows, "doc_id long, text string").mapInPandas(quality._statistics, "doc_id long, x binary"), "test")
    positives = quality.statistics([t for i, t in rows if i % 10 < 7 and i % 3 == 0])
    centre, scale = quality._scaling(every)
    assert quality.estimated_prior(every, positives, centre, scale) == pytest.approx(0.7, abs=0.06)


def test_embeddings_of_hard_rows(spark, monkeypatch):
    monkeypatch.setattr(ego, "INTERVAL", 4)
    monkeypatch.setattr(ego, "GROUP", 2)
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a, "p"), (1, a, "p"), (1, b, "p"), (2, b, "p"), (None, a, "p"), (3, [0.95, float(np.sqrt(1 - 0.95**2)), 0.0], "p"), (4, [2.0, 0.0], "p"), (5, [3.0, 0.0], "p"), (6, [], "p"), (7, [None, 1.0], "p")]
    rows += [(100 + i, np.random.default_rng(i).normal(size=3).tolist(), "p") for i in range(40)]
    got = ego.embedding_near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string")).collect()
    assert len(got) == len(rows)
    known = [(r, np.array(r[1])) for r in dict.fromkeys((i, tuple(v) if v else None) for i, v, _ in rows) if r[0] is not None and r[1] and None not in r[1] and any(r[1])]
    unit = [(i, v / np.linalg.norm(v)) for (i, _), v in known]
    links = {}
    for k, (i, v) in enumerate(unit):
        links[known[k][0]] = sum(len(v) == len(w) and v @ w >= 0.95 for j, (_, w) in enumerate(unit) if j != k)
    by = {}
    for (i, v, _), r in zip(rows, sorted(range(len(rows))), strict=True):
        by.setdefault(i, []).append(links.get((i, tuple(v) if v else None), 0) if i is not None else 0)
    have = {}
    for r in got:
        have.setdefault(r["vec_id"], []).append(r["n_links"])
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in by.items()}
    assert [r["component_id"] for r in got if r["vec_id"] == 5] == [4] and all(r["component_id"] is None and not r["kept"] for r in got if r["vec_id"] is None)


def test_packing_of_clashing_columns_and_the_programs_share(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(1, words(1, 3000), 1, 2, 3), (1, words(1, 3000), 1, 2, 3), (None, None, 0, 0, 0), (2, "", 0, 0, 0)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, part int, nth int, length int"), path).toPandas()
    assert (got["length"] <= 2048).all() and (got[got["doc_id"] != 1]["length"] == 1).all() and len(got[got["doc_id"] == 1]) % 2 == 0
    rng = np.random.default_rng(7)
    count = np.bincount(np.minimum(2048, rng.lognormal(6, 1, 100_000).astype(int) + 1), minlength=2049)
    plan, bound = packing.configuration_program(count)
    placed = sum(len(c) * n for c, n in plan)
    total = sum(n for _, n in packing.pack_histogram(count))
    assert placed >= 0.9 * count.sum() and bound <= total <= 1.002 * bound + 1


def test_mixing_of_null_and_repeated_rows(spark):
    rows = [(None, words(i, 5 + i), None, 1) for i in range(10)] + [(3, words(3, 30), "a", 1)] * 6 + [(4, None, "b", 1)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string, size int")).toPandas()
    assert len(got) == 17 and (got["taken"] <= 2 * got["size"]).all()
    by = got.assign(source=got["source"].fillna("~")).groupby("source").agg(t=("target", "first"), k=("taken", "sum"))
    assert ((by["t"] - by["k"]).abs() <= 30).all()
