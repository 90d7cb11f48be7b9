"""Manifests, whitening and page extraction against brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from provena.llm import merkle, templates, whitening
from pyspark.sql import functions as F

from tests.llm.helpers import clashing, frame, sentence_docs


def digest(*inputs: str) -> str:
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def told(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves: list[str]) -> list[list[str]]:
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def way(levels: list[list[str]], i: int) -> list[tuple[list[str], list[str]]]:
    out = []
    for level in levels[:-1]:
        first = i // 16 * 16
        out.append((level[first:i], level[i + 1 : first + 16]))
        i //= 16
    return out


def manifest(rows: list[tuple]) -> list[tuple]:
    """The query's rows in plain Python."""
    by = collections.defaultdict(list)
    for doc, text, lang, source, n in rows:
        by[source].append((doc is not None, doc or 0, digest(*map(told, (doc, source, lang, n, text))), (doc, source, lang, n, text)))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    within = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    forest = tree([within[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, (_, _, leaf, (doc, _, lang, n, text)) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            steps, f = way(within[s], i) + way(forest, k), leaf
            if doc is not None and text is not None and zlib.crc32(str(doc).encode()) % 5 == 0:
                f = digest(*map(told, (doc, s, lang, n, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))))
            for a, b in steps:
                f = digest(*a, f, *b)
            out.append((doc, leaf, within[s][-1][0], forest[-1][0], digest(*(x for a, b in steps for x in a + b)), f, f == forest[-1][0]))
    return out


def test_manifest_equals_brute_force(spark):
    rows = sentence_docs() + [(1000 + i, f"Text {i} ÄÖ", "en", "hot", 7) for i in range(300)] + [(5000, "One", None, "alone", None), (5001, "", "fr", "", 0), (None, None, None, None, None)] * 2
    rows += [(6000 + i, "A Word " * 20_000 if i == 0 else "Same Text", "de", f"s{i:03}é", 9) for i in range(40)]
    got = [tuple(r) for r in merkle.manifest(clashing(frame(spark, rows, parts=5))).collect()]
    assert sorted(got, key=str) == sorted(manifest(rows), key=str)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_few_rows(spark):
    for rows in ([], [(3, "Only ONE", "en", None, 8)], [(5, "a", "en", "s", 1), (7, "b", "en", "s", 1)]):
        got = merkle.manifest(frame(spark, rows))
        assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        assert sorted(map(tuple, got.collect())) == sorted(manifest(rows))


def test_node_intervals_cover_their_children(spark):
    rows = [(i, str(i), "en", "hot", 1) for i in range(700)]
    nodes = merkle.build(frame(spark, rows), merkle.lowered()).nodes().filter("level > 0").orderBy("level", "lo").collect()
    assert [(r["level"], r["lo"], r["hi"]) for r in nodes if r["level"] == 2] == [(2, 0, 255), (2, 256, 511), (2, 512, 699)]
    assert [(r["lo"], r["hi"]) for r in nodes if r["level"] == 3] == [(0, 699)] and len(nodes) == 44 + 3 + 1
    spoilt = frame(spark, rows).withColumn("text", F.when(F.col("doc_id") == 699, "other").otherwise(F.col("text")))
    assert merkle.build(spoilt, merkle.lowered()).root != merkle.build(frame(spark, rows), merkle.lowered()).root


VECTORS = "vec_id long, embedding array<double>, label int"


def whole(rows: list[tuple]) -> tuple[list, np.ndarray]:
    usable = [(i, [math.floor(1024 * c) + 100_000 for c in v]) for i, v, *_ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    return [i for i, _ in usable], np.array([x for _, x in usable], dtype=object)


def test_whitening_equals_an_eigendecomposition(spark):
    rng = np.random.default_rng(3)
    basis, _ = np.linalg.qr(rng.standard_normal((12, 12)))
    made = rng.standard_normal((400, 12)) * np.array([9, 7, 5, 4, 3, 2, 1.5, 1.2, 1, 0.5, 0.1, 0.01]) @ basis.T + 5
    rows = [(i, list(map(float, v)), 1) for i, v in enumerate(made)]
    rows += [rows[3], (None, rows[4][1], 2), (900, None, 1), (901, [1.0, None] + [0.0] * 10, 1), (902, [float("nan")] * 12, 1), (903, [float("-inf")] + [0.0] * 11, 1), (904, [], 1), (905, [1.0, 2.0], 1)]
    ids, x = whole([r for r in rows if r[0] != 905])
    n, sums = len(x), x.sum(0)
    off = x * n - sums
    c = off.astype(float) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    got = whitening.whiten(clashing(frame(spark, rows, VECTORS))).collect()
    assert len(got) == 8 * n and {r["n"] for r in got} == {n} and all(r["identity_error"] < 1e-10 for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r["component"]].append(r)
    for k in range(1, 9):
        mine = sorted(((r["vec_id"] is None, r["vec_id"] or 0, r["deviation"], r["whitened"]) for r in by[k]))
        e, u = values[-k], vectors[:, -k]
        want = sorted((i is None, i or 0, int((o * o).sum()), float(row @ u) / math.sqrt(e)) for i, o, row in zip(ids, off, c, strict=True))
        assert [m[:3] for m in mine] == [w[:3] for w in want]
        a, b = np.array([m[3] for m in mine]), np.array([w[3] for w in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
        assert all(math.isclose(r["explained"], e / values.sum(), rel_tol=1e-9) for r in by[k])


def test_bidiagonal_factors_hold_the_rows(spark):
    rng = np.random.default_rng(4)
    rows = whitening.whole_vectors(frame(spark, [(i, list(map(float, v)), 0) for i, v in enumerate(rng.standard_normal((60, 6)))], VECTORS))
    mid = whitening.centre(rows)
    f = whitening.bidiagonalise(rows, mid)
    x = mid.rows(np.array([r["x"] for r in rows.collect()]))
    b, u = np.diag(f.alpha) + np.diag(f.beta, 1), x @ f.w
    assert np.abs(u.T @ u - np.eye(6)).max() < 1e-12 and np.abs(f.v.T @ f.v - np.eye(6)).max() < 1e-12
    assert np.abs(x @ f.v - u @ b).max() < 1e-9 * np.abs(x).max()


def test_whitening_of_rows_of_lower_rank(spark):
    equal = whitening.whiten(frame(spark, [(i, [0.5, 0.25], 0) for i in range(5)], VECTORS)).collect()
    assert [(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in equal] == [(None, 0.0, None, 0)] * 10
    line = whitening.whiten(frame(spark, [(i, [i / 4, i / 2, 0.0, 1.0], 0) for i in range(-8, 9)], VECTORS)).collect()
    first = [r for r in line if r["component"] == 1]
    assert len(line) == 4 * 17 and all(abs(r["explained"] - 1) < 1e-9 and r["identity_error"] < 1e-9 for r in first)
    assert all(r["whitened"] is None for r in line if r["component"] > 1)
    assert whitening.whiten(frame(spark, [], VECTORS)).collect() == []
    assert whitening.whiten(frame(spark, [(1, None, 0), (2, [None], 0)], VECTORS)).collect() == []


def test_whitening_is_exact_beyond_small_numbers(spark):
    rows = [(i, [float(i * 2**18), 1.0], 0) for i in range(3)]
    ids, x = whole(rows)
    off = x * 3 - x.sum(0)
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(frame(spark, rows, VECTORS)).collect()}
    assert got == {i: int((o * o).sum()) for i, o in zip(ids, off, strict=True)} and max(got.values()) > 1 << 58
    with pytest.raises(Exception, match="(?i)overflow|too large|int64"):
        whitening.whiten(frame(spark, [(i, [float(i * 2**24), 1.0], 0) for i in range(3)], VECTORS)).collect()


PAGES = "page_id long, url string, html string"


def site(host: str, n: int) -> list[tuple]:
    """Pages of a host whose menu, notice and footer carry no names; one passage stands in all its articles."""
    top = "<div><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></div>"
    out = []
    for i in range(n):
        text = f"<div><h2>Title {i} of {host}</h2><p>The body of page {i} &amp; more.<p>A passage that all share, word for word.</div>"
        out.append((f"http://{host}/{i}", f"<html><body>{top}<div>We use cookies.</div>{text}<div><p>Contact {host}</p></div></body>", f"Title {i} of {host} The body of page {i} & more. A passage that all share, word for word."))
    return out


def test_extraction_deletes_what_recurs_on_a_host(spark):
    made = site("a.example.org", 6) + site("b.example.org", 3)
    alone = site("c.example.org", 1)[0]
    rows = [(i, u, h) for i, (u, h, _) in enumerate(made)] + [(100, alone[0], alone[1]), (101, None, made[0][1]), (102, "http://a.example.org/t", None), (103, "http://a.example.org/e", ""), (None, "no address", "<p>x</p>"), (None, "no address", "<p>x</p>")]
    teaser = "<article><h2>Offer</h2><p>Buy now</p></article>"
    rows += [(200 + i, f"http://n.example.org/{i}", f"<main>{teaser}<article><h1>Own {i}</h1><p>Said once {i}, at length.<p>Same for all</article></main><div>aside {i}</div>") for i in range(4)]
    rows += [(300 + i, f"http://x.example.org/{i}", "<article><p>One article on many pages</article>") for i in range(4)]
    rows += [(400, "http://long.example.org/", "<article>" + "<p>word <b>bold</b></p>" * 20_000)]
    got = {(r["page_id"], r["url"]): r for r in templates.extract(clashing(frame(spark, rows, PAGES, parts=4))).collect()}
    assert [got[i, u]["text"] for i, (u, _, _) in enumerate(made)] == [t for _, _, t in made]
    assert got[0, made[0][0]]["n_template"] >= 3
    assert got[100, alone[0]]["text"].startswith("Home News We use cookies. Title 0")  # nothing else tells of a single page
    assert got[101, None]["text"].startswith("Home News") and got[102, "http://a.example.org/t"]["text"] == got[103, "http://a.example.org/e"]["text"] == ""
    assert [got[200 + i, f"http://n.example.org/{i}"]["text"] for i in range(4)] == [f"Own {i} Said once {i}, at length. Same for all" for i in range(4)]
    assert {got[300 + i, f"http://x.example.org/{i}"]["text"] for i in range(4)} == {"One article on many pages"}
    assert got[400, "http://long.example.org/"]["n_chars"] == 20_000 * 10 - 1
    assert templates.extract(frame(spark, rows, PAGES)).count() == len(rows) and templates.extract(frame(spark, [], PAGES)).collect() == []


def test_recurring_subtrees_equal_brute_force(spark):
    rows = [(i, u, h) for i, (u, h, _) in enumerate(site("a.example.org", 350) + site("b.example.org", 2))]
    rows[:4] = [(i, u, h.replace("Contact a", "Call a")) for i, u, h in rows[:4]]  # on 4 pages: over 3 and over a hundredth
    rows[4:7] = [(i, u, h.replace("Contact a", "Ring a")) for i, u, h in rows[4:7]]  # on 3 pages of 350: under a hundredth
    counts, pages = collections.Counter(), collections.Counter()
    for _, u, h in rows:
        host = u.split("/")[2]
        pages[host] += 1
        counts.update({(host, t) for t, _, _ in templates.read_main(h).subtrees})
    want = {(host, t) for (host, t), n in counts.items() if n >= 3 and 100 * n >= pages[host]}
    read = frame(spark, rows, PAGES).withColumn("host", F.split("url", "/")[2]).mapInArrow(templates._read, templates.READ)
    assert {(r["host"], t) for r in templates.recurring(read).collect() for t in r["template"]} == want and want


def test_page_reader_on_odd_pages():
    said = lambda t: templates.read_main(t).blocks
    assert said("plain text only") == ["plain text only"] and said("<p>a<p>b") == ["a", "b"] and said("a < b <3") == ["a < b <3"]
    assert said("<div><nav>x</nav><p>A &lt;b&gt; &amp;amp; &copy B</p>") == ["A <b> &amp; © B"]
    assert said("<article><header><h1>T</h1></header><p>x <span class=ad>buy</span> y</p><section id=comments><article><p>reader</article></section><form>f</form></article><aside><article><p>other</article></aside>") == ["T", "x", "y"]
    assert said("<div class=with-sidebar><header>Site</header><div class=content><h2>H</h2><p>long prose</p></div><div class=sidebar>s</div></div>") == ["H", "long prose"]
    assert said("<script>if(a<b){'<p>'}") == [] and said("<!-- c --><!-- open <p>x</p>") == []
    assert said("<p title='x>y'>q</p><p title=\"unclosed>r</p>") == ["q", "r"]
    assert said("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"] and said("<ul><li>a<ul><li>b</ul><li>c</ul>") == ["a", "b", "c"]
    assert said("<b>x</b>y<i>z</i> <br>\n w") == ["xyz w"] and said("<p>x&nbsp; y &#65; &unknown;</p>") == ["x y A &unknown;"]
    assert said("<div hidden>no</div><p style='display: none'>no</p><p>yes</p>") == ["yes"]
    assert said("<div id=main class=related><article><p>only</p></article></div>") == ["only"]
    assert len(said("<div>" * 3000 + "x" + "</p></div>" * 10 + "<p>y" * 3)) == 4
