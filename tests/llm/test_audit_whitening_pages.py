"""Filter audit, whitening and main text against plain versions."""

import html
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.llm import catalog, filter_audit, main_text, page_blocks, whitening

from ..conftest import SF_DIR

# -- filter audit --------------------------------------------------------------------------------------------------


def plain_audit(docs, labels):
    """Every order applied to every row."""
    space = re.compile(r"[^\x20\x09-\x0D]+")
    rows = []
    for doc_id, source, text in docs:
        text = text or ""
        words = space.findall(text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": any(doc_id is not None and o is not None and o < doc_id and (t or "") == text for o, _, t in docs)}
        mine = [l for l in labels if l[0] == doc_id and doc_id is not None]
        rows.append((source or "", {k for k, v in fails.items() if v}, any(l[1] == 1 for l in mine), any(l[2] == 1 for l in mine)))
    out = {}
    for part in {r[0] for r in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, letter in enumerate(order, 1):
                here = [r for r in left if letter in r[1]]
                kept = [r for r in left if letter not in r[1]]
                failing = sum(r[0] == part and letter in r[1] for r in rows)
                out[part, order, step] = [len(kept), len(here), failing - len(here),
                                          sum(r[0] == part and r[1] == {letter} for r in rows),
                                          sum(r[2] for r in here), sum(r[3] for r in here)]
                left = kept
    for part, order, step in list(out):
        out[part, order, step].append(sum(v[1] for k, v in out.items() if k[0] == part and k[1][k[2] - 1] == order[step - 1]))
    return out


def test_filter_audit(spark):
    dice = random.Random(4)
    words = ["un", "deux", "Trois", "QUATRE", "a|b", "six", "sept"] + [f"w{k}" for k in range(300)]
    docs = []
    for k in range(70):
        size = dice.choice([3, 150, 199, 200, 260, 420])
        pool = words if dice.random() < 0.7 else words[:6]
        text = dice.choice([" ", "\t\n"]).join(dice.choice(pool) for _ in range(size))
        docs.append((k, dice.choice(["x", "y", None, ""]), text))
    docs += [(k, "x", docs[0][2]) for k in range(100, 110)] + [(0, "y", docs[0][2]), (None, "x", docs[0][2])]
    docs += [(None, None, None), (200, "z", ""), (201, "z", None), (200, "z", ""), (5, "y", docs[5][2]), (300, "x", "long " * 60_000)]
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 120, 2)] + [(4, 1, 1), (4, None, 0), (None, 1, 1)]
    labels = [(a, b, None if c is None else int(c)) for a, b, c in labels]
    odd = "doc_id long, source string, text string, part string, n long, mask int, digest string, quality int"
    df = spark.createDataFrame([(*d, "p", 1, 2, "d", 9) for d in docs], odd)
    marks = spark.createDataFrame([(*l, "x") for l in labels], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.audit(filter_audit.cells_of(df, marks)).collect()
    want = plain_audit(docs, labels)
    assert len(got) == len(want) == 600 * 4
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in got} == want
    assert filter_audit.audit(filter_audit.cells_of(df.limit(0), marks)).count() == 0
    assert filter_audit.audit(filter_audit.cells_of(df, marks.limit(0))).agg(F.sum("good_lost")).first()[0] == 0


def test_filter_audit_of_other_filters(spark):
    cells = spark.createDataFrame([("p", 1, 5, 0, 0), ("p", 3, 2, 1, 1)], "part string, mask int, n long, good long, toxic long")
    rows = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant) for r in filter_audit.audit(cells, "XY").collect()}
    assert rows == {("XY", 1): (0, 7, 0), ("XY", 2): (0, 0, 2), ("YX", 1): (5, 2, 0), ("YX", 2): (0, 5, 2)}
    with pytest.raises(ValueError):
        filter_audit.walk(spark, "ABCDEFG")


# -- whitening -----------------------------------------------------------------------------------------------------


def plain_whitening(rows, count=8):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in kept], float)
    off = x - x.mean(axis=0)
    e, u = np.linalg.eigh(off.T @ off / len(x))
    e, u = e[::-1][:count], u[:, ::-1][:, :count]
    deviation = [sum((len(x) * int(a) - int(s)) ** 2 for a, s in zip(row, x.sum(axis=0))) for row in x]
    return [i for i, _ in kept], deviation, off @ u / np.sqrt(e), e / np.trace(off.T @ off / len(x))


def test_whitening(spark):
    dice = np.random.default_rng(3)
    rows = [(k, v.tolist()) for k, v in enumerate(dice.normal(size=(300, 12)) * np.linspace(0.2, 1, 12))]
    rows += [(5, rows[5][1]), (None, rows[6][1]), (400, None), (401, [None] + [1.0] * 11), (402, [math.nan] * 12),
             (403, [math.inf] * 12), (404, []), (405, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, n int, whitened double")
    got = whitening.whiten(df).collect()
    ids, deviation, white, explained = plain_whitening(rows[:302])
    assert len(got) == 8 * len(ids)
    by = {c: sorted([r for r in got if r.component == c], key=lambda r: (str(r.vec_id), r.deviation)) for c in range(1, 9)}
    order = sorted(range(len(ids)), key=lambda k: (str(ids[k]), deviation[k]))
    for c, rs in by.items():
        assert [r.deviation for r in rs] == [deviation[k] for k in order] and {r.n for r in rs} == {302}
        ours, theirs = np.array([r.whitened for r in rs]), white[order, c - 1]
        assert min(np.abs(ours - theirs).max(), np.abs(ours + theirs).max()) < 1e-9
        assert {round(r.explained / explained[c - 1], 9) for r in rs} == {1.0}
    assert {r.identity_error for r in got}.pop() < 1e-9
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.filter("vec_id = 5")).count() == 0  # equal vectors have no variance


def test_whitening_of_few_dimensions_and_large_numbers(spark):
    rows = [(k, [float(k), 2.0 * k, 1e30 * (k % 3)]) for k in range(20)]  # two dimensions depend on each other
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1, 2} and {r.deviation for r in got} == {None}
    white = np.array([[r.whitened for r in sorted(got, key=lambda r: r.vec_id) if r.component == c] for c in (1, 2)])
    assert np.abs(white @ white.T / 20 - np.eye(2)).max() < 1e-9


def test_characteristic_polynomial(spark):
    dice = np.random.default_rng(1)
    for d in (1, 2, 5, 9):
        a = dice.integers(-9, 9, (d, d)).astype(object)
        m = a @ a.T
        poly = whitening.characteristic_polynomial(spark, m)
        assert poly[d] == 1 and poly[d - 1] == -sum(m.diagonal())
        # Hamilton and Cayley: a matrix is a root of its characteristic polynomial.
        total, power = np.zeros((d, d), dtype=object), np.array([[int(i == j) for j in range(d)] for i in range(d)], dtype=object)
        for c in poly:
            total, power = total + c * power, power @ m
        assert not total.any()


def test_repeated_roots(spark):
    m = np.array([[int(i == j) * [9, 9, 9, 4, 4, 0][i] for j in range(6)] for i in range(6)], dtype=object)
    turn = np.array([[1, 1, 0, 0, 0, 0], [1, -1, 0, 0, 0, 0]] + [[int(i == j) for j in range(6)] for i in range(2, 6)], dtype=object)
    m = turn @ m @ turn.T
    found = whitening.principal(spark, m, 8)
    values = [float(r) for r, _ in found]
    assert np.allclose(values, sorted(np.linalg.eigvalsh(m.astype(float)))[::-1][:5])
    u = np.array([v for _, v in found])
    assert np.allclose(u @ u.T, np.eye(5), atol=1e-12) and np.allclose(m.astype(float) @ u.T, u.T * values)


# -- main text -----------------------------------------------------------------------------------------------------

CASES = [
    ("", ""), ("plain  text\n", "plain text"), ("a < b & c &amp; d &lt;e&gt; &#233; &copy", "a < b & c & d <e> é ©"),
    ("<p>one<p>two<br>three<hr>four", "one\ntwo three\nfour"), ("<p>x<!-- <p>y --><script>'<p>z'</script> w", "x w"),
    ("<p>a<b>b</b><i>c</p>d", "abc\nd"), ("<p>a&nbsp;b c", "a b c"), ("<p>x <span class=ad>buy <span>now</span></span>y", "x y"),
    ("<nav>m</nav><header>h</header><article><header><h1>T</h1></header><p>b</article><footer>f", "T\nb"),
    ("<form><article>a<aside>s</aside><div class='post-comments'><p>c</div>e</article></form>t", "a\ne"),
    ("<body class='nav-open'><div class=page-sidebar><main>m<article class=comment>c</article></main></div>", "m"),
    ("<div class='with-sidebar'>a</div><div id=cookieNotice>b</div><div role=search>c</div><div hidden>d</div>e", "a\ne"),
    ("<article>one</article><article>two</article><div>rest</div>", "one\ntwo"), ("<article><nav>x</nav></article>y", "y"),
    ("<table><tr><td>a<td>b<tr><td>c</table><ul><li>d<li>e</ul>", "a\nb\nc\nd\ne"), ("<style>p{}", ""), ("<a href=\"x>y\">z</a><", "z<"),
    ("<svg><text>no</text></svg><p title='a\"'>t", "t"), ("<p", ""), ("<p>a</div>b</p>", "a\nb"), ("x<![CDATA[y]]>z", "xz"),
]


@pytest.mark.parametrize("page, want", CASES)
def test_blocks(page, want):
    assert "\n".join(t for t, kind in page_blocks.blocks(page) if kind != page_blocks.FURNITURE) == want


def test_suffix_ranks():
    dice = np.random.default_rng(5)
    for size, depth in ((1, 4), (50, 1), (300, 5), (300, 12)):
        stream = dice.integers(0, 3, size)
        keys = [tuple(stream[k:k + depth]) for k in range(size)]
        names = {key: r for r, key in enumerate(sorted(set(keys)), 1)}
        assert main_text.suffix_ranks(stream, depth).tolist() == [names[k] for k in keys]


def sites(dice):
    """Pages of two hosts without marks and one with them, what they should give, and page lists for counting."""
    def words(n):
        return " ".join("".join(dice.choice("abcdefghij") for _ in range(6)) for _ in range(n))

    rows, want = [], {}
    for host in ("one.example", "two.example"):
        menu, foot, note, passage = words(9), words(15), words(14), words(60)
        for k in range(60):
            p = [words(dice.randint(8, 60)) for _ in range(4)]
            if k % 9 == 0:
                p[1] = passage  # on a ninth of the pages: a passage that texts share
            notice = k % 2 == 0
            if k > 50:  # copies
                p = copy if k > 51 else p
            copy = p
            body = f"<p>{p[0]}<p>{p[1]}{'<div>' + note + '</div>' if notice else ''}<div>{p[2]}\n{p[3]}</div>"
            page_id = len(rows)
            rows.append((page_id, f"http://{host}/{k}", f"<body><div>{menu}</div><div>{body}</div><div>{foot}</div>"))
            want[page_id] = "\n".join([p[0], p[1], p[2] + " " + p[3]])
    appeal, passage = words(20), words(60)
    for k in range(30):
        p = [words(40), words(30)] if k % 3 else [passage, words(30)]
        page_id = len(rows)
        rows.append((page_id, f"http://three.example/{k}", f"<div>{words(30)}</div><article><p>{p[0]}<div>{appeal}</div><p>{p[1]}</article>"))
        want[page_id] = "\n".join(p)
    return rows, want


def test_main_text_of_hosts(spark):
    rows, want = sites(random.Random(1))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r.page_id: r.text for r in main_text.extract(df).collect()} == want


def test_boilerplate_counts(spark):
    dice = random.Random(2)
    rows = [(dice.choice(["a", "b"]), " ".join(dice.choice("xxxxxxxxy") for _ in range(dice.choice([0, 3, 11, 12, 13, 18, 60])))) for _ in range(90)]
    got = main_text.boilerplate(spark.createDataFrame(rows, "host string, html string").repartition(7)).collect()
    want, totals = {}, {}
    for host, page in rows:
        totals[host] = totals.get(host, 0) + 1
        found = page_blocks.blocks(page)
        for s in np.unique(main_text.string_hashes(main_text._stream(found, host), main_text.LONG)).tolist():
            want[host, s] = want.get((host, s), 0) + 1
    want = {k: (v, totals[k[0]]) for k, v in want.items() if v >= 2 and v >= main_text.SHARE * totals[k[0]]}
    assert want and {(r.host, r.string): (r.pages, r.total) for r in got} == want


def test_main_text_odd_rows(spark):
    long = "<article>" + "<p>word &amp; word" * 50_000 + "</article>"
    rows = [(1, None, None), (1, None, None), (None, "x", ""), (2, "http://h/a", "<p>a"), (2, "http://h/a", "<p>a"), (2, "http://h/a", "<p>b"),
            (3, "http://h/", long)]
    df = spark.createDataFrame([(*r, "t", 1, "h") for r in rows], "page_id long, url string, html string, text string, n_chars int, host string")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in main_text.extract(df).collect()), key=str)
    texts = ["", "", "", "a", "a", "b", "\n".join(["word & word"] * 50_000)]
    assert got == sorted([(r[0], r[1], t, len(t)) for r, t in zip(rows, texts)], key=str)
    assert main_text.extract(df.limit(0)).count() == 0


def test_main_text_of_the_table(spark):
    want = {}
    for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        want[r.page_id] = "\n".join(p for p in parts if p)
    got = catalog.QUERIES["op13_main_text"](spark, SF_DIR).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
