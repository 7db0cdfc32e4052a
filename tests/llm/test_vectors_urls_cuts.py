"""Whitening, URL filters and fill-in-the-middle against plain Python, and on odd rows."""

import fnmatch
import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from locuspark.llm import entries, fim, url_filter, whitening
from tests.oracle import check

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op12_url_filter", "op13_fill_in_middle"])
def test_query_matches_sql(spark, name):
    check(spark, entries.queries()[name], entries.oracle_sql()[name], SF)


# whitening


def brute_whitening(vectors, k):
    """n, deviation and, up to signs, whitened, explained of each vector, by whole numbers and a plain eigensolver."""
    x = np.floor(1024 * np.array(vectors)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    z = x - s / n
    v = z.T @ z / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    deviation = [sum((n * a - b) ** 2 for a, b in zip(r, s.tolist(), strict=True)) for r in x.tolist()]
    return n, deviation, z @ u / np.sqrt(e), e / np.trace(v)


def rows_of(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["vec_id"] is not None, r["vec_id"] or 0, r["component"]))


def test_whitening_against_a_plain_eigensolver(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = rows_of(entries.op11_whitening(spark, SF))
    given = sorted((r["vec_id"], r["embedding"]) for r in rows.collect())
    n, deviation, white, explained = brute_whitening([v for _, v in given], 8)
    assert [(r["vec_id"], r["component"]) for r in got] == [(i, c + 1) for i, _ in given for c in range(8)]
    assert {r["n"] for r in got} == {n} and [r["deviation"] for r in got[::8]] == deviation
    mine = np.array([r["whitened"] for r in got]).reshape(-1, 8)
    signs = np.sign((mine * white).sum(axis=0))
    assert np.allclose(mine, white * signs, atol=1e-9)
    assert np.allclose([r["explained"] for r in got[:8]], explained, rtol=1e-12)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-12


VECTORS = "vec_id long, embedding array<double>, n long, d long, place long, row string, deviation string, component string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0, 0, "r", "x", "c") for i, v in rows], VECTORS)


def test_odd_vectors(spark):
    rng = random.Random(5)
    good = [(k, [rng.gauss(0, 1) for _ in range(3)]) for k in range(40)]
    bad = [(90, None), (91, [1.0, None, 2.0]), (92, [1.0, float("nan"), 2.0]), (93, [float("inf"), 0.0, 0.0]), (94, [1.0, 2.0]), (95, []), (96, [1e30, 0.0, 0.0])]
    got = rows_of(whitening.whitened(vectors(spark, [*good, *bad, good[0], (None, good[1][1])])))
    all_good = [good[1][1], good[0][1], *(v for _, v in good)]
    n, deviation, white, _ = brute_whitening(all_good, 3)
    assert n == 42 and {r["n"] for r in got} == {42} and len(got) == 42 * 3
    assert [r["vec_id"] for r in got[:9]] == [None] * 3 + [0, 0] + [0, 0] + [0, 0] and got[-1]["vec_id"] == 39
    assert sorted(r["deviation"] for r in got) == sorted(3 * deviation)
    assert np.allclose(sorted(abs(r["whitened"]) for r in got), sorted(np.abs(white).ravel()), atol=1e-10)
    assert whitening.whitened(vectors(spark, [])).count() == 0 and whitening.whitened(vectors(spark, bad[:4])).count() == 0
    assert whitening.whitened(vectors(spark, [(k, [0.5, 0.25]) for k in range(9)])).count() == 0


def test_components_beyond_the_rank_are_left_out(spark):
    line = rows_of(whitening.whitened(vectors(spark, [(k, [k / 4, k / 2, 7.0]) for k in range(30)])))
    assert len(line) == 30 and line[0]["explained"] == pytest.approx(1) and line[0]["identity_error"] < 1e-12
    assert whitening.fit(vectors(spark, [(1, [1.0, 2.0])])).eigenvalues.size == 0


def test_deviations_are_exact_or_null():
    x = np.array([[2**40, 5, 0], [-(2**40), 5, 0], [3, 2**61, 0]], np.int64)
    s = [int(v) for v in x.astype(object).sum(axis=0)]
    whole, rest = whitening.Model(3, tuple(s), None, None, 0).split
    want = [sum((3 * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x.tolist()]
    assert whitening.deviations(x, whole, rest, 3) == [v if v < 2**63 else None for v in want] == [None] * 3
    x = np.array([[2**29, 5], [-(2**29), 6]], np.int64)
    whole, rest = whitening.Model(2, (0, 11), None, None, 0).split
    assert whitening.deviations(x, whole, rest, 2) == [2**60 + 1, 2**60 + 1]


@given(st.integers(1, 9), st.integers(1, 12), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_cholesky_and_rotations(d, rank, seed):
    rng = np.random.default_rng(seed)
    b = rng.normal(size=(d, min(d, rank))) * 10.0 ** rng.integers(-4, 5, size=min(d, rank))
    a = b @ b.T
    low = whitening.pivoted_cholesky(a)
    assert np.allclose(low @ low.T, a, atol=1e-12 * np.abs(a).max())
    values, parts = whitening.jacobi(low)
    assert np.allclose(parts.T @ parts, np.eye(len(values)), atol=1e-11)
    assert np.allclose(parts * values @ parts.T, a, atol=1e-12 * np.abs(a).max()) and (np.diff(values) <= 0).all()


def test_sums_of_matrices_are_added_row_by_row():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 0], pa.int32()), pa.array([[1.0, 2.0], [5.0, 6.0], [10.0, 20.0]])], names=["place", "row"])
    assert [b.to_pylist() for b in whitening.add_rows(iter([batch, batch]))] == [[{"place": 0, "row": [22.0, 44.0]}], [{"place": 1, "row": [10.0, 12.0]}]]


# URL filters


def brute_match(glob, text):
    """A glob by the ends of text that each rest of its positions matches, from the last position on."""
    ends = [False] * len(text) + [True]
    for kind, char in reversed(url_filter.positions(glob)):
        for j in range(len(text) + 1) if kind not in ("run", "all") else range(len(text), -1, -1):
            here = j < len(text)
            if kind in ("run", "all"):
                ends[j] = ends[j] or here and (kind == "all" or text[j] not in "/?") and ends[j + 1]
            else:
                ends[j] = here and (text[j] == char if kind == "char" else text[j] not in "/?") and ends[j + 1]
    return ends[0]


@given(st.lists(st.text(alphabet="ab*?/\\.", max_size=8), max_size=12), st.lists(st.text(alphabet="ab/?.é\n日\x00", max_size=12), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_automaton_against_plain_matching(globs, urls):
    got = url_filter.Automaton(globs).matches(urls)
    assert got.tolist() == [[brute_match(g, u) for g in globs] for u in urls]


def test_patterns_longer_than_words_and_very_long_urls(monkeypatch):
    rng = random.Random(2)
    globs = ["".join(rng.choice("ab") for _ in range(n)) + "**" for n in (1, 62, 63, 64, 65, 130, 300)]
    machine = url_filter.Automaton(globs)
    urls = [g[:-2] + "x" * k for g in globs for k in (0, 3)] + ["", "b" * 200_000]
    for size in (1 << 20, 50):
        monkeypatch.setattr(url_filter, "BLOCK_CHARS", size)
        got = machine.matches(urls)
        assert got.tolist() == [[u.startswith(g[:-2]) for g in globs] for u in urls]
    assert url_filter.Automaton([]).matches(["a", ""]).shape == (2, 0)


def brute_verdict(url, rules, globs):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)(\?[^#]*)?", url or "")
    host, path, query = (x or "" for x in found.groups()) if found else ("", "", "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if ("." + host).endswith("." + r.host) and path.startswith(r.path)]
    if fits:
        best = min(fits, key=lambda r: (-len(r.text), r.verdict != "block", r.text))
        return host, path, best.text, best.verdict
    fits = [(v, g) for v, g in globs if brute_match(g, f".{host}{path}{query}")]
    return host, path, None, min(fits, key=lambda g: (-len(g[1]), g[0] != "block", g[1]))[0] if fits else "allow"


URLS = [
    None, "", "no url", "http://", "://net/", "http://net", "http://net/", "HTTP://Foo.NET/en/", "https://EXAMPLE.net/en/1", "https://x.example.net/en", "https://x.example.net/en?a=/en/", "https://badexample.net/en/",
    "http://evil.org/x.net/", "http://example.com/de/", "http://example.com/de", "http://a.b.example.com/de/x#y", "http://example.com#/de/", "http://org/fr/", "http://ÀB.org/fr/", "http://user@foo.org:80/fr/x", "http://foo.org.:80/fr/",
    "http://my-casino.example.com/en/", "http://casino.de/", "http://a.de/casino/", "http://a.de/x.pdf", "http://a.de/x.pdf?y", "http://a.de/b?replytocom=3", "http://a.de/areplytocom=3", "a://b://net/", "http://a.de/a/b/cart/c", "http://a.gov/x.pdf", "http://n\nt.net/\n/x",
]


def pages(spark, urls):
    return spark.createDataFrame([(k, u, "h", "p", "q", "r") for k, u in enumerate(urls)], "page_id long, url string, host string, path string, query string, rule string")


def test_url_verdicts(spark):
    own = (*url_filter.RULES, url_filter.Rule("block", "gov", ""), url_filter.Rule("allow", "example.com", "/de/x"), url_filter.Rule("block", "a*c.de", "/"))
    urls = [*URLS, "http://a.gov", "http://a.government/", "http://a.gov?x", "http://gov/x", "http://abc.de/", "http://a*c.de/", "http://x.de/" + "y" * 100_000 + ".pdf"]
    for rules, globs in ((url_filter.RULES, url_filter.GLOBS), (own, url_filter.GLOBS), (own, ()), ((), url_filter.GLOBS), ((), ())):
        got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.verdicts(pages(spark, urls), rules, globs).orderBy("page_id").collect()]
        want = [brute_verdict(u, rules, globs) for u in urls]
        assert got == want
        assert sorted(r["page_id"] for r in url_filter.allowed(pages(spark, urls), rules, globs).collect()) == [k for k, w in enumerate(want) if w[3] == "allow"]
    assert url_filter.verdicts(pages(spark, [])).count() == 0
    twice = pages(spark, URLS[6:7]).union(pages(spark, URLS[6:7]))
    assert [r["verdict"] for r in url_filter.verdicts(twice).collect()] == ["block", "block"] and url_filter.allowed(twice).columns == twice.columns


def test_rules_that_are_no_host_and_path():
    for host, path in (("a/b", "/"), ("a", "b/"), ("a", "/b?c")):
        with pytest.raises(ValueError):
            url_filter.Rule("block", host, path)


def test_method_blocks_spam_hosts_of_the_given_pages(spark):
    got = entries.op12_url_filter(spark, "/root/testdata/sf0.01").collect()
    spam = [r for r in got if fnmatch.fnmatch(r["host"], "*casino*") or fnmatch.fnmatch(r["host"], "*adult*")]
    assert spam and all(r["verdict"] == "block" for r in spam if r["rule"] is None)


# fill-in-the-middle


def brute_fim(doc_id, text):
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    text = text or ""
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    one, two, three = text[:a], text[a:b], text[b:]
    return n, *(("spm", a, b - a, f"<S>{three}<P>{one}<M>{two}") if h4 % 100 < 20 else ("psm", a, b - a, f"<P>{one}<S>{three}<M>{two}"))


@given(st.text(alphabet="aé日😀<SPM>", max_size=60), st.integers(1, 400))
@settings(max_examples=200, deadline=None)
def test_boundaries_select_every_code_point(text, chunk):
    old, fim.CHUNK = fim.CHUNK, chunk
    try:
        cuts = fim.Boundaries(np.frombuffer(text.encode(), np.uint8))
        assert [cuts.select(k) for k in range(len(cuts))] == [len(text[:k].encode()) for k in range(len(text) + 1)]
    finally:
        fim.CHUNK = old


def test_containers_of_all_kinds():
    rng = np.random.default_rng(3)
    kinds = set()
    for p in (0.0005, 0.02, 0.3, 0.6, 0.97, 1.0):
        mask = rng.random(1 << 16) < p
        one = fim.container(mask)
        kinds.add(type(one).__name__)
        where = np.flatnonzero(mask).tolist()
        assert [one.select(k) for k in range(0, len(where), 7)] == where[::7] and one.select(len(where) - 1) == where[-1]
    assert kinds == {"Runs", "Members", "Bits"}


def test_fill_in_the_middle(spark):
    rng = random.Random(4)
    texts = [None, "", "a", "<P>", "x<S>y", "<M", "<P", ">", "<", "S>", "é日😀" * 50, "\x00\n \t", "日本" * 90_000, "a" * 70_000 + "é" * 70_000 + "😀b" * 40_000]
    texts += ["".join(rng.choice("ab<>SPM é😀") for _ in range(rng.randrange(40))) for _ in range(300)]
    rows = [*enumerate(texts), (None, "some text"), (7, "again"), (7, "again")]
    docs = spark.createDataFrame([(i, t, "f", "o", 1) for i, t in rows], "doc_id long, text string, form string, output string, n long")
    cut = fim.transform(docs)
    got = [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in cut.collect()]
    order = lambda r: (r[0] is not None, r[0] or 0, r[-1])
    assert sorted(got, key=order) == sorted(((i, *brute_fim(i, t)) for i, t in rows), key=order)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = cut.select("doc_id", fim.restored(cut["output"], cut["form"]).alias("text"))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(tuple, back.collect()), key=key) == sorted(((i, t or "") for i, t in rows), key=key)
    assert fim.transform(docs.where("false")).count() == 0
    assert {r["form"] for r in fim.transform(docs, fim_percent=0).collect()} == {"plain"} and "psm" not in {r["form"] for r in fim.transform(docs, spm_percent=100).collect()}
