"""The bootstrapping of personal data: the graph iteration against plain Python, additions on a planted sample."""

import math
import random

import pytest

from panelspark.llm import pii


def scores(edges, totals, rounds):
    conf = {}
    for _, k, i, seed, _ in edges:
        conf[i, k] = max(conf.get((i, k), 0.0), float(seed))
    for _ in range(rounds):
        good = {}
        for p, k, i, _, n in edges:
            good[p, k] = good.get((p, k), 0.0) + n * conf[i, k]
        score = {(p, k): min(g / (totals[p] + 1), 0.999) for (p, k), g in good.items()}
        best, seeded = {}, {}
        for p, k, i, seed, _ in edges:
            near = ("R", p[2:].split(" ")[0]) if p[0] == "R" else ("L", p.split(" ")[-1])
            best[i, k, near] = max(best.get((i, k, near), 0.0), score[p, k])
            seeded[i, k] = seeded.get((i, k), False) or seed
        conf = {x: 1.0 if s else 1 - math.prod(1 - v for (i, k, _), v in best.items() if (i, k) == x) for x, s in seeded.items()}
    return score, conf


def test_graph_scores_equal_plain_python(spark):
    rng = random.Random(1)
    patterns = [f"L {a}{b}at" for a in ("", "me ") for b in ("", "look ")] + ["R or so", "R or", "R any", "L by"]
    edges = [(p, k, f"i{i}", (i + len(k)) % 4 == 0, rng.randint(1, 5)) for p in patterns for k in ("email", "phone") for i in rng.sample(range(12), 6)]
    totals = {p: rng.randint(20, 60) for p in patterns}
    got = pii.graph_scores(spark.createDataFrame(edges, "pattern string, kind string, instance string, seed boolean, n long"), spark.createDataFrame(list(totals.items()), "pattern string, total long"), 3)
    want = scores(edges, totals, 3)
    assert {(r["pattern"], r["kind"]): r["score"] for r in got[0].collect()} == pytest.approx(want[0])
    assert {(r["instance"], r["kind"]): r["conf"] for r in got[1].collect()} == pytest.approx(want[1])


def test_additions_on_a_planted_sample_are_precise(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(3, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    before, after = ("write to", "my address is", "kontakt :"), ("if you need me", "for more of it")
    rows, planted = [], {}
    for i in range(300):
        kind = i % 6
        if kind < 2:  # seeds
            inner = f"{rng.choice(before)} {word()}{i}@{word()}.example.org {rng.choice(after)}"
        elif kind == 2:  # identifiers of no fixed form in the contexts of seeds
            hidden = f"{word()}{i}(at){word()}"
            inner = f"{rng.choice(before)} {hidden} {rng.choice(after)}"
            planted[i] = hidden
        else:  # numbers that are no identifiers, and the contexts' words apart
            inner = rng.choice((f"in {1000 + i} they", "write a letter to", "is it for more", f"page {i} of"))
        rows.append((i, f"{prose(rng.randint(5, 30))} {inner} {prose(rng.randint(5, 30))}", "r", "b", "s"))
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string, row string, base string, shaped string")).collect()
    right = wrong = 0
    for r in got:
        for span in filter(None, r["spans"].split(",")):
            kind, a, b = span.split(":")
            if "@" not in (found := rows[r["doc_id"]][1][int(a) : int(b)]):
                right, wrong = right + (planted.get(r["doc_id"]) == found), wrong + (planted.get(r["doc_id"]) != found)
    assert right >= 0.9 * len(planted) and wrong == 0


def test_right_contexts_alone_discover(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows = [(i, f"{word()} user{i}@host.example.org (mailbox) {word()}") for i in range(9)] + [(9, f"{word()} other7(at)host (mailbox) {word()}")]
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[9]["spans"] == "email:7:21" and got[9]["n_added"] == 1 and all(got[i]["n_added"] == 0 for i in range(9))


def test_a_long_text_with_many_matches(spark):
    text = " ".join(f"u{i}@h.example.org {i}" for i in range(4000))
    got = pii.personal_data(spark.createDataFrame([(1, text), (1, text), (2, None)], "doc_id long, text string")).collect()
    assert sorted(r["n_email"] for r in got) == [0, 4000, 4000]
