"""Exact top-k, URL rules and quotation links against DuckDB and brute force."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
from provena.llm import queries, sql
from provena.llm.components import connected_components
from provena.llm.quotations import link_quotations, write_conversations
from provena.llm.topk import exact_topk, integer_vectors, search_blocks, tight_order
from provena.llm.url_filters import Rule, judge_urls

from pyspark.sql import functions as F

from tests.llm.helpers import clashing


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def in_duckdb(query, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(f"_{name}", df.toArrow())
        con.execute(f"create table {name} as select * from _{name}")
    return sorted((tuple(r) for r in con.execute(query).fetchall()), key=str)


def test_topk_equals_brute_force_with_ties_and_bad_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [round(rng.choice([-1, 0, 0.5, 1]) * rng.random(), 1) for _ in range(4)], 0) for i in range(140)]
    rows += [(150, None, 0), (151, [1.0, None, 0.0, 0.0], 0), (152, [math.nan, 0.0, 0.0, 0.0], 0), (153, [math.inf, 0.0, 0.0, 0.0], 0), (None, [1.0, 1.0, 1.0, 1.0], 0), rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    v = integer_vectors(clashing(df))
    got = rows_of(exact_topk(v.filter("vec_id % 50 = 0"), v, segment=40, group=2))
    # Row 7 is there twice and counts twice, as in the SQL.
    assert in_duckdb(sql.TOPK, embeddings=df.filter("vec_id is not null")) == got
    ints = {i: [math.floor(256 * float(np.float32(x))) for x in e] for i, e, _ in rows[:140]}
    want = []
    for q in (0, 50, 100):
        best = sorted((-sum(a * b for a, b in zip(ints[q], ints[i], strict=True)), i) for i in [*ints, 7] if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == sorted(want, key=str)


def test_topk_of_few_and_none(spark):
    empty = spark.createDataFrame([], "vec_id long, v array<long>")
    two = spark.createDataFrame([(0, [1, 2]), (1, [3]), (2, [])], "vec_id long, v array<long>")
    assert rows_of(exact_topk(empty, two)) == [] and rows_of(exact_topk(two, empty)) == []
    assert rows_of(exact_topk(two.filter("vec_id = 0"), two)) == [(0, 1, 1, 3), (0, 2, 2, 0)]


def test_topk_keeps_vectors_of_any_finite_size(spark):
    rows = [(0, [1e14, 1.0]), (1, [1e14, -3.0]), (2, [1e30, 0.0]), (3, [-1e300, 5.0]), (4, [0.5, 0.25])]
    v = integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    ints = {r["vec_id"]: r["v"] for r in v.collect()}
    assert len(ints) == 5 and ints[0] == [256 * 10**14, 256] and ints[2][0] == 2**63 - 1024 and ints[3][0] == -(2**63) + 1024
    got = [(r["vec_id"], r["score"]) for r in exact_topk(v.filter("vec_id = 0"), v).orderBy("rank").collect()]
    want = sorted(((max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(ints[0], x, strict=True)))), i) for i, x in ints.items() if i), key=lambda t: (-t[0], t[1]))
    assert [(i, s) for s, i in want] == got


def test_block_search_equals_brute_force():
    rng = np.random.default_rng(1)
    for low, high in ((-3, 3), (-(2**20), 2**20), (-(2**40), 2**40), (0, 4)):
        d, q = rng.integers(low, high, (300, 20)), rng.integers(low, high, (9, 20))
        d[150:] = d[:150]  # ties
        got, _ = search_blocks(np.arange(1000, 1009), q, np.arange(300), d, 5, block=16)
        for j in range(9):
            s = sorted((-sum(int(a) * int(b) for a, b in zip(q[j], x, strict=True)), i) for i, x in enumerate(d.tolist()))[:5]
            assert [(x, i) for a, i, x in got if a == 1000 + j] == [(max(-(2**63), min(2**63 - 1, -x)), i) for x, i in s]


def test_blocks_are_pruned():
    """Vectors without any order leave most blocks on the way, clusters leave them at once; neither changes a result."""
    rng = np.random.default_rng(4)
    unit = lambda x: np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    for d, q, at_once, on_the_way in (
        (unit(rng.normal(size=(8192, 64))), unit(rng.normal(size=(20, 64))), 0.0, 0.3),
        (unit(np.repeat(rng.normal(size=(128, 64)), 64, 0) + 0.05 * rng.normal(size=(8192, 64))), unit(rng.normal(size=(20, 64))), 0.3, 0.0),
    ):
        d = d[rng.permutation(len(d))]
        d = d[tight_order(d)]
        got, work = search_blocks(np.arange(10**6, 10**6 + 20), q, np.arange(len(d)), d, 5)
        assert work.left_at_once >= at_once * work.met and work.left_on_the_way >= on_the_way * work.met and work.share_left > 0.3 and work.share_saved > 0.05
        scores = q @ d.T
        want = [(10**6 + j, int(i), int(scores[j, i])) for j in range(20) for i in np.lexsort((np.arange(len(d)), -scores[j]))[:5]]
        assert got == want
    assert sorted(tight_order(np.zeros((200, 3), np.int64)).tolist()) == list(range(200))


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (None, 9), (10, 11), (3, 1)] + [(100, i) for i in range(101, 140)] + [(i, i + 1) for i in range(200, 260)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert got[1] == got[2] == got[3] == 1 and got[4] == got[5] == 4 and got[7] == 7 and got[11] == 10
    assert {got[i] for i in range(100, 140)} == {100} and {got[i] for i in range(200, 261)} == {200}


PAGES = [
    (1, "http://a.net/x?q#f", '<link rel="canonical" href="http://b.com/y">'), (2, "http://b.com/y", None), (3, "https://C.com/z", '<META http-equiv=refresh content="0; url=http://b.com/y">'),
    (4, None, None), (5, "mailto:x", "<p>"), (6, "http://www.example.net/en/1", "<link href='/de/2' rel=canonical>"), (7, "http://www.example.net/de/2", ""), (8, "http://q.example.net/en", ""),
    (9, "x://example.com/de/", ""), (10, "http://sub.example.com/de/1?x", ""), (11, "http://h.org/fr/", ""), (12, "http://notexample.com/de/", ""), (13, "http://a.net", ""), (1, "http://a.net/x?q#f", None),
]


def test_url_rules_and_aliases(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = rows_of(judge_urls(clashing(pages), queries.URL_RULES))
    assert got == in_duckdb(sql.URL_FILTER, pages=pages)
    verdict = {r[0]: (r[3], r[4]) for r in got}
    assert verdict[1] == ("net/", "block") and verdict[2] == (None, "block") and verdict[3] == (None, "block")
    assert verdict[6] == ("example.net/en/", "allow") and verdict[7] == ("net/", "block") and verdict[4] == (None, "allow")
    assert verdict[12] == (None, "allow") and verdict[13] == (None, "allow") and verdict[10] == ("example.com/de/", "block")


def test_url_allow_wins_over_a_spread_block(spark):
    pages = spark.createDataFrame([(1, "http://bad.net/", None), (2, "http://ok.org/fr/a", None), (3, "http://free.com/", None)], "page_id long, url string, html string")
    hops = spark.createDataFrame([("http://free.com/", "http://bad.net/"), ("http://free.com/", "http://ok.org/fr/a")], "source string, target string")
    got = {r["page_id"]: r["verdict"] for r in judge_urls(pages, queries.URL_RULES, redirects=hops).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow"}
    assert rows_of(judge_urls(pages.limit(0), [Rule("block", "net", "/")])) == []


def test_url_aliases_by_relative_links(spark):
    link = lambda x: f'<link rel="canonical" href="{x}">'
    pages = [
        (1, "https://free.com/a/b/page", link("//example.net/x")), (2, "http://e.org/d/e/f", link("../bad/y.html?q#f")), (3, "http://e.org/d/bad/y.html?q", link("http://t.net/1")),
        (4, "http://g.org", link("z.html")), (5, "http://g.org/z.html", link("http://t.net/2")), (6, "http://k.org/a/b", link("./../../../n")), (7, "http://k.org/n", link("http://t.net/3")),
        (8, "http://m.org/a?x", link("?y")), (9, "http://n.org/a", link("mailto:x@t.net")), (10, "nowhere", link("page.html")), (11, "http://o.org/a", link("c?u=http://t.net/4")),
    ]
    got = {r["page_id"]: (r["verdict"], r["alias_root"]) for r in judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), queries.URL_RULES).collect()}
    assert got[1] == ("block", "example.net/x")
    assert {got[2], got[3]} == {("block", "e.org/d/bad/y.html?q")} and {got[4], got[5]} == {("block", "g.org")} and {got[6], got[7]} == {("block", "k.org/a/b")}
    assert got[8] == ("allow", "m.org/a?x") and got[9] == got[10] == ("allow", None) and got[11] == ("allow", "o.org/a")
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert rows_of(judge_urls(table, queries.URL_RULES)) == in_duckdb(sql.URL_FILTER, pages=table)


def test_addresses_differ_by_their_queries(spark):
    link = lambda x: f'<link rel="canonical" href="{x}">'
    pages = [(1, "http://e.org/i.php?id=1", link("http://bad.net/1")), (2, "http://e.org/i.php?id=2#top", None), (3, "http://e.org/i.php?id=1#part", None), (4, "http://f.org/x", link("/i?a=1&b=/../c")), (5, "http://f.org/i?a=1&b=/../c", link("http://t.net/"))]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = rows_of(judge_urls(table, queries.URL_RULES))
    assert got == in_duckdb(sql.URL_FILTER, pages=table)
    assert {r[0]: r[4] for r in got} == {1: "block", 2: "allow", 3: "block", 4: "block", 5: "block"}


def test_url_rules_on_long_repeated_and_clashing_rows(spark):
    far = "http://long.org/" + "a/../" * 3000 + "b?" + "q" * 50_000
    pages = spark.createDataFrame([(1, far, None), (1, far, None), (None, "http://x.net/", "<link rel=canonical href=http://long.org/z>"), (2, "", ""), (3, "://", None)], "page_id long, url string, html string")
    got = {(r["page_id"], r["verdict"]) for r in judge_urls(clashing(pages).withColumn("node", F.lit(1)).withColumn("host", F.lit("h")), queries.URL_RULES).collect()}
    assert got == {(1, "allow"), (None, "block"), (2, "allow"), (3, "allow")}


TURNS = [
    (1, 0, "user", "Hello there\nfriend"), (1, 1, "assistant", "Bob wrote:\n> hello there\n> friend\n\nI agree"), (1, 2, "user", ">> Hello  there\n>> friend\n> I agree\nfine"),
    (2, 0, "user", "> i agree\n>\n> x\nmm"), (2, 1, "user", None), (2, 2, "user", ""), (3, 0, "user", "> fine"), (3, 1, None, "> > no one said this\n>\n> \nok"), (4, 0, "user", "a > b\n\n\nmm"),
]


def test_quotations(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    got = rows_of(link_quotations(clashing(turns).withColumn("body", F.lit(1)).withColumn("level", F.lit(2))))
    assert got == in_duckdb(sql.QUOTATIONS, conversations=turns)
    by = {r[:2]: r for r in got}
    assert by[1, 1][5:] == (1, 0, 0, 1, "I agree") and by[1, 2][2:8] == (2, 2, 2, 1, 1, 0) and by[2, 0][4:7] == (1, 1, 1) and by[3, 0][4:7] == (1, 1, 2)
    assert by[3, 1][2:6] == (1, 2, 0, None) and by[2, 1][9] is None and by[4, 0][2] == 0
    assert {k: by[k][8] for k in ((1, 0), (1, 1), (1, 2), (3, 0))} == {(1, 0): 0, (1, 1): 1, (1, 2): 2, (3, 0): 0}
    again = rows_of(link_quotations(turns.union(turns)))
    assert again == sorted(got + got, key=str)
    assert rows_of(link_quotations(turns.limit(0))) == []


def test_conversations_in_reply_order(spark, tmp_path):
    """Two threads of one conversation, told in turn, come apart; quotations are gone."""
    told = [
        (7, 0, "user", "first question here"), (7, 1, "user", "second question here"), (7, 2, "assistant", "> first question here\nfirst answer"), (7, 3, "assistant", "Ann wrote:\n> second question here\nsecond answer"),
        (7, 4, "user", "> first answer\n>> first question here\nthanks"), (8, 0, "user", "alone"), (None, 1, "user", "> x"),
    ]
    turns = spark.createDataFrame(told, "conv_id long, turn long, role string, text string")
    write_conversations(link_quotations(turns), f"{tmp_path}/threads")
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/threads").select("conv_id", "root_turn", "reply_depth", "turn", "body").collect()]
    assert [x for x in got if x[0] == 7] == [(7, 0, 0, 0, "first question here"), (7, 0, 1, 2, "first answer"), (7, 0, 2, 4, "thanks"), (7, 1, 0, 1, "second question here"), (7, 1, 1, 3, "second answer")]
    assert (8, 0, 0, 0, "alone") in got and len(got) == 7


def test_quotations_in_long_chains_and_texts(spark):
    n = 70
    chain = [(1, i, "user", (f"> word{i - 1} said\n" if i else "") + f"word{i} said") for i in range(n)]
    long_ = [(2, 0, "user", "line\n" * 20_000 + "end"), (2, 1, "user", "> " * 50 + "deep\n\n" + "> line " * 3000)]
    turns = spark.createDataFrame(chain + long_, "conv_id long, turn long, role string, text string")
    by = {(r["conv_id"], r["turn"]): r for r in link_quotations(turns).collect()}
    assert all(by[1, i]["root_turn"] == 0 and by[1, i]["reply_depth"] == i for i in range(n)) and by[2, 1]["quote_depth"] == 50 and len(by) == n + 2
