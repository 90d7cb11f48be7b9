"""Operators on one key that holds all rows: equal to brute force, and no task holds the key."""

from __future__ import annotations

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from provena.operators import audit, baselines, cases, inverted, ordered, retrieval
from provena.plans import retrieval_queries
from provena.sources import files
from pyspark.sql import functions as F


def vectors(n: int, d: int = 6, groups: int = 5, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((groups, d)) * 6
    return middle[rng.integers(0, groups, n)] + rng.standard_normal((n, d)) * 0.3


def test_nearest_of_one_scope_by_bounds(spark):
    made = vectors(1200)
    made[7] = made[5]
    rows = [(i, "all" if i != 3 else "few", f"note {i}", [float(x) for x in v]) for i, v in enumerate(made)]
    cases = spark.createDataFrame(rows, "id long, scope string, note string, vector array<double>").repartition(6)
    queries = cases.filter("id % 20 = 0 or id = 3")
    got = retrieval.nearest_scoped(queries, cases, 4, ["scope"], block_rows=40)
    want = []
    for q in [*range(0, 1200, 20), 3]:
        mine = sorted((float(((made[q] - made[h]) ** 2).sum()), h) for h in range(1200) if h != q and (h == 3) == (q == 3))[:4]
        want += [(q, h, r + 1, round(d, 9), f"note {q}", f"note {h}", rows[q][1]) for r, (d, h) in enumerate(mine)]
    assert sorted((r["q_id"], r["h_id"], r["vector_rank"], round(r["distance"], 9), r["q_note"], r["h_note"], r["scope"]) for r in got.collect()) == sorted(want)
    plain = retrieval.nearest_scoped(queries, cases, 4, ["scope"])
    assert sorted(plain.columns) == sorted(got.columns) and plain.count() == len(want)

    held = retrieval.block_candidates(cases, ["scope"], block_rows=40)
    sizes = held.rows.groupBy("scope", "cell", "part").count().agg(F.max("count").alias("most"), F.count("*").alias("n")).first()
    assert sizes["most"] <= 80 and sizes["n"] >= 30
    probes = retrieval.search_blocks(queries, held, 4, ["scope"]).probes
    assert probes.filter("visited").count() < 0.5 * probes.count()  # far groups are left out by their bounds


def test_nearest_without_scope_or_vectors(spark):
    cases = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(30)] + [(99, None)], "id long, vector array<double>")
    held = retrieval.block_candidates(cases, [], block_rows=5)
    best = retrieval.search_blocks(cases.filter("id in (0, 29, 99)"), held, 2, []).best.collect()
    assert sorted((r["q_id"], r["h_id"], r["vector_rank"]) for r in best) == [(0, 1, 1), (0, 2, 2), (29, 27, 2), (29, 28, 1)]


def test_best_documents_of_a_word_that_all_hold(spark):
    rng = random.Random(2)
    rare = [f"w{i}" for i in range(900)]
    docs = [(i, ["all"] * rng.choice([1, 1, 2, 9]) + rng.choices(rare, k=rng.choice([1, 3, 10, 60]))) for i in range(900)] + [(900, []), (901, ["other"])]
    docs[11] = (11, docs[10][1])
    asked = [(q, w) for q in range(12) for w in {"all", *rng.choices(rare, k=3), "absent"}] + [(99, "absent")]
    frame = spark.createDataFrame(docs, "id long, words array<string>").repartition(5)
    index = inverted.build_index(frame, "id", F.col("words"), block_docs=16)
    words = collections.defaultdict(set)
    for q, w in asked:
        words[q].add(w)
    n, mean = len(docs), sum(len(w) for _, w in docs) / len(docs)
    df = collections.Counter(w for _, ws in docs for w in set(ws))
    idf = {w: math.log(1 + (n - f + 0.5) / (f + 0.5)) for w, f in df.items()}

    def score(q, ws):
        tf = collections.Counter(ws)
        return sum(idf[w] * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in words[q] if tf[w])

    def ranks(of):
        return sorted((q, d, r + 1) for q in words for r, (_, d) in enumerate(sorted((-round(s, 9), d) for d, s in ((d, of(q, ws)) for d, ws in docs) if s)[:5]))

    asked_rows = spark.createDataFrame(asked, "q int, word string")
    found = inverted.best_documents(index, asked_rows, "q", inverted.bm25_part(), 5)
    assert sorted((r["q"], r["doc"], r["rank"]) for r in found.best.collect()) == ranks(score)
    shared = inverted.best_documents(index, asked_rows, "q", inverted.shared_part, 5)
    assert sorted((r["q"], r["doc"], r["rank"]) for r in shared.best.collect()) == ranks(lambda q, ws: len(words[q] & set(ws)))
    counts = {r["q"]: r["n_documents"] for r in inverted.matching_documents(index, asked_rows, "q").collect()}
    assert counts == {q: n for q in words if (n := sum(bool(words[q] & set(ws)) for _, ws in docs))}
    assert index.postings.filter("word = 'all'").agg(F.max(F.size("docs"))).first()[0] <= 48  # no row holds the word's documents
    share = inverted.opened_share(found).first()
    assert share["opened"] < 0.8 * share["postings"]


@pytest.fixture
def uncoalesced(spark):
    """Small tables stay in as many partitions as large ones would have."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scans_of_one_key(spark, uncoalesced):
    n, rng = 3000, random.Random(4)
    rows = [("one" if i % 10 else None, i, rng.choice([0, 0, 0, 1, 5, None]), rng.choice(["a", "b", None])) for i in range(n)]
    rng.shuffle(rows)
    p = ordered.place(spark.createDataFrame(rows, "k string, at int, x int, s string").repartition(7), ["k"], ["at"])
    parts = p.rows.groupBy(ordered.PART).count().collect()
    assert len(parts) >= 3 and max(r["count"] for r in parts) < 0.6 * n  # the key is spread over tasks
    want, sums, last, numbers = {}, collections.Counter(), {}, collections.Counter()
    for k, at, x, s in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        numbers[k] += 1
        want[k, at] = (sums[k], sums[k] + (x or 0), numbers[k], *last.get(k, (None, None)))
        sums[k] += x or 0
        last[k] = (x, s)
    without = {(r["k"], r["at"]): r["t"] for r in ordered.running_sum(p, F.col("x"), "t", own=False).collect()}
    with_own = {(r["k"], r["at"]): r["t"] for r in ordered.running_sum(p, F.col("x"), "t").collect()}
    number = {(r["k"], r["at"]): r["t"] for r in ordered.row_numbers(p, "t").collect()}
    before = {(r["k"], r["at"]): (r["px"], r["ps"]) for r in ordered.previous(p, px="x", ps="s").collect()}
    assert {k: (without[k], with_own[k], number[k], *before[k]) for k in want} == want


def test_exact_percentiles_of_one_group(spark, uncoalesced):
    rng = random.Random(5)
    values = {"hot": [rng.choice([1.0, 2.5, 2.5, 7.0, rng.random() * 9]) for _ in range(2001)], "one": [4.0], "two": [1.0, 2.0], "twenty": [float(i) for i in range(20)]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("hot", None), ("none", None)]
    c = ordered.value_counts(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v")
    shares = (0.0, 0.25, 0.5, 0.95, 1.0)
    got = c.rows.groupBy("k").agg(*(c.nearest_rank(s).alias(f"d{i}") for i, s in enumerate(shares)), *(c.interpolated(s).alias(f"c{i}") for i, s in enumerate(shares))).collect()
    assert {r["k"] for r in got} == set(values)
    for r in got:
        vs = sorted(values[r["k"]])
        assert [r[f"d{i}"] for i in range(5)] == [vs[max(0, math.ceil(round(s * len(vs), 9)) - 1)] for s in shares]
        assert np.allclose([r[f"c{i}"] for i in range(5)], np.quantile(vs, shares))


def test_line_numbers_over_splits_of_one_file(spark, tmp_path):
    rng = random.Random(6)
    texts = {"a.txt": ["x" * rng.choice([0, 1, 7, 300]) + f"é{i}" for i in range(900)], "b.txt": ["", "", "end\r"], "c.txt": []}
    for name, lines in texts.items():
        (tmp_path / name).write_bytes("\n".join(lines).encode() + (b"\n" if name == "a.txt" else b""))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        read = files.split_lines(spark, str(tmp_path))
        got = [(r["path"].rsplit("/", 1)[1], r["line_no"], r["line"]) for r in read.collect()]
        whole = [(r["line_no"], r["line"]) for r in files.split_lines(spark, str(tmp_path), folder=True).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [(name, i + 1, line) for name, lines in texts.items() for i, line in enumerate(lines)]
    assert sorted(got) == sorted(want)
    assert sorted(whole) == [(i + 1, line) for i, (_, _, line) in enumerate(want)]
    (tmp_path / "bad.txt").write_bytes(b"ok\n\xff\n")
    with pytest.raises(Exception, match="(?i)utf"):
        files.split_lines(spark, f"{tmp_path}/bad.txt").collect()


def test_nearest_rows_equals_plain_distances_for_odd_vectors():
    rng = np.random.default_rng(4)
    made = [[float(x) for x in v] for v in rng.standard_normal((300, 5)).astype(np.float32)]
    made[9] = made[8]
    odd = [None, [], [1.0, None, 0.0, 0.0, 0.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0], [1.0, 2.0], [3.0, 2.0], [1e200] * 5]
    rows = [(f"c{i}", v) for i, v in enumerate(made + odd)]

    def distance(a, b):
        if a is None or b is None or None in a or None in b or len(a) != len(b):
            return 2, 0.0
        d = 0.0
        for x, y in zip(a, b, strict=True):
            d += float(np.float64(x - y) * np.float64(x - y))
        return (1, 0.0) if math.isnan(d) else (0, d)

    for held, asked in ((rows, rows), (rows[:3], rows[-9:]), (rows[-8:], rows[:40])):
        side = lambda some: pa.table({"id": pa.array([i for i, _ in some]), "vector": pa.array([v for _, v in some], pa.list_(pa.float64()))})
        with np.errstate(all="ignore"):
            q, h, d = retrieval.nearest_rows(side(asked), side(held), 4)
            want = {(a, i, k, x) for a, v in asked for k, x, i in sorted((*distance(v, w), i) for i, w in held if i != a)[:4]}
        told = lambda x: (2, 0.0) if x is None else (1, 0.0) if math.isnan(x) else (0, x)
        assert {(asked[a][0], held[b][0], *told(x)) for a, b, x in zip(q.tolist(), h.tolist(), d, strict=True)} == want


def test_a_search_measures_by_matrices_and_leaves_texts_out(spark):
    cases = spark.createDataFrame([(i, i % 3, [float(i), 1.0], "text " * i) for i in range(200)], "id long, scope int, vector array<float>, text string")
    near = retrieval.nearest_in_blocks(cases.filter("id % 20 = 0").drop("text"), cases.drop("text"), 3, ["scope"], block_rows=16)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "zip_with" not in plan  # pairs are not rows
    few = retrieval.nearest_scoped(cases.filter("id % 20 = 0"), cases, 3, ["scope"], block_rows=16)
    assert few.filter("length(h_text) <> 5 * h_id or length(q_text) <> 5 * q_id").count() == 0
    want = {(q, h) for q in range(0, 200, 20) for _, h in sorted((abs(q - h), h) for h in range(200) if h != q and h % 3 == q % 3)[:3]}
    assert {(r["q_id"], r["h_id"]) for r in near.collect()} == want == {(r["q_id"], r["h_id"]) for r in few.collect()}


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_link_rules_count_without_copies_of_rows(spark):
    rng = random.Random(8)
    rows = []
    for case in range(80):
        for i in range(rng.choice([1, 3, 4, 4, 4, 5, 9])):
            rows.append((None if case == 0 else case, rng.choice([f"r{i}", f"r{i}", "r0", None]), rng.choice([*cases.STAGES, None]), rng.choice(["d", "d", "d", "e", None]), "o", True, False, "historical"))
    frame = spark.createDataFrame(rows, "case_id long, record_id string, stage string, dut_id string, observation_id string, synthetic boolean, physical_test_performed boolean, role string").repartition(3)
    want = set()
    for case in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == case]
        distinct = lambda i: len({r[i] for r in mine} - {None})  # noqa: B023, E731
        name = None if case is None else str(case)
        want |= {(name, rule) for rule, ok in (("stages", len(mine) == 4 and distinct(2) == 4), ("device", distinct(3) == 1), ("record", distinct(1) == len(mine))) if not ok}
    got = cases.link_violations(frame)
    assert {(r["entity_key"], r["rule_id"]) for r in got.collect()} == want and "Expand" not in _plan(got)
    pivot = cases.stage_pivot(frame, ["case_id"], "record_id")
    assert "distinct" not in _plan(pivot).lower() and "Expand" not in _plan(pivot)
    assert {r["case_id"] for r in pivot.filter("complete").collect()} == {c for c in {r[0] for r in rows} if {r[2] for r in rows if r[0] == c} >= set(cases.STAGES)}


def test_result_rules_move_both_sides_once(spark):
    rng = random.Random(9)
    results = [(q, rng.choice([1, 2, 3, None]) if q % 3 == 0 else h, h + 1, float(h)) for q in range(40) for h in range(rng.choice([1, 2, 5]))] + [(None, 1, 1, 0.0)]
    eligible = [(q, h) for q in range(40) for h in (0, 1, 2, 3, None) if rng.random() < 0.8] * 2 + [(None, 1)]
    frame, known = spark.createDataFrame(results, "q_id long, h_id long, rank int, distance double"), spark.createDataFrame(eligible, "q_id long, h_id long")
    got = retrieval.result_violations(frame, known, k=4)
    want = set()
    for q in {r[0] for r in results}:
        mine = [h for x, h, _, _ in results if x == q]
        name = None if q is None else str(q)
        want |= {(name, rule) for rule, ok in (("C17-most", len(mine) <= 4), ("C17-distinct", len(set(mine) - {None}) == len(mine)), ("C17-eligible", all(q is not None and h is not None and (q, h) in eligible for h in mine))) if not ok}
    assert {(r["entity_key"], r["rule_id"]) for r in got.collect() if r["rule_id"] in ("C17-most", "C17-distinct", "C17-eligible")} == want
    assert "Join" not in _plan(got) and "Expand" not in _plan(got)


def test_run_rules_move_no_lists(spark):
    ids, run = "array<string>", "0" * 32
    rows = spark.createDataFrame([(1, run, "unconfirmed", ["a,b"], ["k", None]), (2, run[:-1] + "1", "refuse", ["a"], []), (3, "x", None, None, [])], f"id long, run_id string, status string, cause_ids {ids}, check_ids {ids}")
    saved = spark.createDataFrame([(run, "unconfirmed", ["a", "b"], ["k", None]), (run[:-1] + "1", "refuse", ["a"], []), ("x", None, None, [])], f"run_id string, status string, cause_ids {ids}, check_ids {ids}")
    got = audit.run_violations(rows, saved)
    assert {(r["entity_key"], r["rule_id"]) for r in got.collect()} == {("1", "ids"), ("2", "empty"), ("3", "run"), ("3", "answer"), ("3", "ids"), ("3", "empty")}
    assert "structstojson" in _plan(got)[_plan(got).index("Join") :] and "_causes" not in _plan(got)  # below the join, ids are one text


def test_texts_are_cut_once_for_tf_idf(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "a c"), (3, None), (4, "c c d")], "id long, t string")
    got = baselines.tf_idf(docs, "id", "t")
    assert "regexp_extract_all" not in _plan(got)
    assert {r["id"] for r in got.collect()} == {1, 2, 4}


def test_documents_of_queries_meet_by_block(spark):
    rows = [(i, [f"w{i % 7}", f"w{i % 5}", "all"] * (1 + i % 3)) for i in range(300)]
    index = inverted.build_index(spark.createDataFrame(rows, "id long, words array<string>"), "id", F.col("words"), block_docs=8)
    asked = spark.createDataFrame([(q, w) for q in range(9) for w in {f"w{q}", "all" if q == 8 else "w0"}], "q long, word string")
    found = inverted.matching_documents(index, asked, "q")
    assert "collect_list" not in _plan(found)  # no query's postings of a block are gathered by a shuffle of their own
    words = {q: {f"w{q}", "all" if q == 8 else "w0"} for q in range(9)}
    assert {(r["q"], r["n_documents"]) for r in found.collect()} == {(q, n) for q, ws in words.items() if (n := sum(bool(ws & set(h)) for _, h in rows))}
    best = inverted.best_documents(index, asked, "q", inverted.shared_part, 3).best
    assert "explode(docs" not in _plan(best) and "CoGroup" in _plan(best)  # no row for each query, word and document
    want = {(q, i, -s) for q, ws in words.items() for s, i in sorted((-len(ws & set(h)), i) for i, h in rows if ws & set(h))[:3]}
    assert {(r["q"], r["doc"], r["score"]) for r in best.collect()} == want


def test_fusion_asks_every_case(spark, tmp_path):
    rng = random.Random(12)
    words = [f"word{i}" for i in range(12)] + ["of", "Word1"]
    docs = [(i, None if i == 5 else "" if i in (6, 9) else " ".join(rng.choices(words, k=9)), "en" if i % 10 else "de", "web") for i in range(90)]
    docs[25] = (25, docs[25][1], None, "web")
    held = [(i, None if i == 31 else [float(rng.randrange(3)), float(rng.randrange(3))], None if i == 41 else i % 2) for i in range(1, 95)]  # many at one distance, some without a document
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(held, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = retrieval_queries.rrf_fusion_vs_vector_only(spark, str(tmp_path)).collect()
    cases = {i: (label, docs[i][2], v, {w for w in (docs[i][1] or "").lower().split() if len(w) > 2}) for i, v, label in held if i < 90 and label is not None and docs[i][2]}
    want = set()
    for q, (label, lang, v, mine) in cases.items():
        apart = lambda h: (1, 0.0) if v is None or cases[h][2] is None else (0, math.dist(v, cases[h][2]))  # noqa: B023, E731
        near = sorted((h for h in cases if h != q and cases[h][:2] == (label, lang)), key=lambda h: (*apart(h), h))[:10]
        shared = {h: len(mine & cases[h][3]) for h in near}
        by_words = sorted(near, key=lambda h: (-shared[h], h))
        score = {h: 1 / (61 + near.index(h)) + 2 / (61 + by_words.index(h)) for h in near}
        fused = sorted(near, key=lambda h: (-score[h], near.index(h)))
        want |= {(q, h, fused.index(h) + 1, round(score[h], 6), near.index(h) + 1, shared[h]) for h in near}
    assert {r["q_id"] for r in got} == set(cases)  # not every twentieth alone
    assert len(got) == len(want) and {(r["q_id"], r["h_id"], r["hybrid_rank"], r["score"], r["vector_only_rank"], r["keyword_overlap"]) for r in got} == want


def test_equal_vectors_are_measured_for_the_smallest_ids_alone(monkeypatch):
    made = np.repeat(np.random.default_rng(3).integers(0, 3, (4, 2)).astype(float), 100, 0)
    ids = np.random.default_rng(4).permutation(400)
    rows = pa.table({"id": pa.array(ids), "vector": pa.array(made.tolist(), pa.list_(pa.float64()))})
    pairs, plain = [], retrieval._distances
    monkeypatch.setattr(retrieval, "_distances", lambda a, b: (pairs.append(len(a)), plain(a, b))[1])
    q, h, d = retrieval.nearest_rows(rows, rows, 5)
    want = {(a, b, x) for a in range(400) for x, _, b in sorted((float(((made[a] - made[b]) ** 2).sum()), ids[b], b) for b in range(400) if b != a)[:5]}
    assert set(zip(q.tolist(), h.tolist(), d, strict=True)) == want and len(q) == 2000
    assert sum(pairs) <= 400 * 4 * 6  # not each with all its equals
