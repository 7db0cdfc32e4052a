"""The text operators against plain Python on small tables, and on odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from locuspark.llm import common, decontaminate, entries, html, langid, licenses, mixing, near_dedup, pii, quality, tokens, warc
from tests.oracle import check

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\\x20\\x09-\\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, uid string, key string, spans string, label string, _hash string, boilerplate string"


def table(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r)), "u", "k", "s", "l", "h", "b") for r in rows], DOCS)


def odd_rows():
    long = " ".join(f"w{k % 997}" for k in range(60_000))
    return [(1, None), (2, ""), (3, " \n\t "), (None, "some words here"), (4, "one two"), (4, "one two"), (5, long, "en", "a"), (6, long, "en", "a"), (7, "x" * 200_000), (8, "é日本\x00 a@b.co 1.2.3.4", "xx", None)]


def words(n, rng):
    return [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(400)}" for _ in range(n)]


# words and shingles


@given(st.lists(st.text(alphabet="ab é\n\t\x0b ", max_size=30), max_size=8))
@settings(max_examples=60, deadline=None)
def test_word_hashes(texts):
    row, start, end, h = common.words(pa.array(texts, pa.string()))
    got = collections.defaultdict(list)
    for r, x in zip(row.tolist(), h.tolist(), strict=True):
        got[r].append(x)
    seen = {}
    for k, t in enumerate(texts):
        mine = WORD.findall(t)
        assert len(mine) == len(got[k])
        for w, x in zip(mine, got[k], strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_long_word_goes_over_blocks(monkeypatch):
    monkeypatch.setattr(common, "BLOCK_BYTES", 16)
    texts = ["a" * 50 + " b", "", "b " + "a" * 50]
    row, _, _, h = common.words(pa.array(texts))
    assert row.tolist() == [0, 0, 2, 2] and h[0] == h[3] and h[1] == h[2]


# near duplicates


def brute_classes(docs):
    def bag(t):
        w = WORD.findall(t or "")
        return collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()

    bags, up = {d: bag(t) for d, t in docs}, {d: d for d, _ in docs}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = [d for d, _ in docs]
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = sum((bags[a] & bags[b]).values())
            if both and both / (sum(bags[a].values()) + sum(bags[b].values()) - both) >= 0.8:
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: top(d) for d in ids}


def near_copies(seed, n_groups=4, copies=14):
    rng, docs = random.Random(seed), []
    for _ in range(n_groups):
        base = words(120, rng)
        for c in range(copies):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = "edit"
            docs.append((len(docs), " ".join(w)))
    docs += [(len(docs) + k, " ".join(words(40, rng))) for k in range(10)]
    docs += [(900, "same words again and again and again and again and again " * 9), (901, "same words again and again and again and again and again " * 9 + "same")]
    return docs


def test_near_duplicate_classes(spark):
    docs = near_copies(3)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(table(spark, docs)).collect()}
    assert got == brute_classes(docs)


def cloud(n, seed, edits=(0, 1, 2, 3, 4, 6, 9, 14), size=120):
    """Copies of one text with words changed, put in and left out."""
    rng, docs = random.Random(seed), []
    base = words(size, rng)
    for k in range(n):
        w = list(base)
        for _ in range(rng.choice(edits)):
            at, way = rng.randrange(len(w)), rng.randrange(6)
            w[at : at + 1] = [w[at], f"x{rng.randrange(10**9)}"] if way == 0 else [] if way == 1 else [f"x{rng.randrange(10**9)}"]
        docs.append((k, " ".join(w)))
    return docs


def test_large_groups_lose_no_link(spark):
    """One middle; two middles that share much; three; cuts of one text; runs of one word."""
    docs, rng = [], random.Random(9)
    for seed, sizes in ((40, [150]), (50, [60, 60]), (60, [90, 30, 30])):
        head = None
        for k, n in enumerate(sizes):
            group = cloud(n, seed + k)
            head = head or group[0][1].split()
            group = [" ".join(head[:85] + t.split()[85:]) if k else t for _, t in group]
            docs += list(enumerate(group, len(docs)))
    base = words(150, rng)
    cuts = [" ".join(base[: 40 + 2 * k]) for k in range(55)] + [" ".join(base[k:]) for k in range(0, 60, 3)]
    docs += list(enumerate([*cuts, *("again and " * (20 + 3 * k) for k in range(12))], len(docs)))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(table(spark, docs)).collect()}
    assert got == brute_classes(docs)


def test_one_id_with_several_texts_keeps_them_apart(spark):
    rng = random.Random(12)
    a, b = (" ".join(words(30, rng)) for _ in "ab")
    rows = [(1, a), (1, b), (2, b), (3, a)]
    got = near_dedup.labelled(table(spark, rows)).join(table(spark, rows), "doc_id").select("doc_id", "class_id").distinct().collect()
    assert {r["class_id"] for r in got} == {2, 3}
    kept = [r["text"] for r in near_dedup.drop_near_duplicates(table(spark, rows)).collect()]
    assert sorted(kept) == sorted([a, b])
    only = near_dedup.classes(table(spark, [(1, a), (1, b), (1, None)])).collect()
    assert len({r["class_id"] for r in only}) == 3 and all(r["class_id"] < 0 for r in only)


def test_work_follows_the_size_of_a_group(spark):
    """Rows of tokens, of candidate pairs and of comparisons for one group of near copies."""
    rows = {}
    for n in (200, 800):
        docs = cloud(n, 77)
        whole, pairs_of = near_dedup.compared, near_dedup.group_pairs
        seen = {}

        def pairs(members, labels, similarity):
            sure, found = pairs_of(members, labels, similarity)
            seen["pairs"] = found.count()
            return sure, found

        def stars_of(given, texts):
            seen["compared"] = seen.get("compared", 0) + given.count()
            return whole(given, texts)

        near_dedup.group_pairs, near_dedup.compared = pairs, stars_of
        try:
            near_dedup.classes(table(spark, docs)).count()
        finally:
            near_dedup.group_pairs, near_dedup.compared = pairs_of, whole
        rows[n] = dict(seen)
    assert rows[800]["compared"] <= 6 * rows[200]["compared"] and rows[800]["pairs"] <= 6 * rows[200]["pairs"] + 400


def test_signatures_are_unbiased():
    rng = np.random.Generator(np.random.PCG64(1))
    h = common.mix(np.arange(1, 61, dtype=np.uint64))
    got = []
    for k in range(90):
        a, b = rng.integers(0, 6, 60), rng.integers(0, 6, 60)
        shift = common.mix(h + np.uint64(k * 1000))
        row = np.repeat([0, 1], 60)
        w, x = np.r_[a, b], np.r_[shift, shift]
        live = w > 0
        sig = near_dedup.bag_minhash(row[live], x[live], w[live], 2)
        got.append((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(got)) < 0.02


def test_near_duplicates_of_odd_rows(spark):
    out = near_dedup.classes(table(spark, odd_rows())).collect()
    by = collections.defaultdict(set)
    for r in out:
        by[r["doc_id"]].add(r["class_id"])
    assert len(out) == len(odd_rows())
    assert by[1] == {1} and by[2] == {2} and by[3] == {3} and by[None] == {None} and by[4] == {4} and by[6] == {5} == by[5]
    kept = near_dedup.drop_near_duplicates(table(spark, odd_rows()))
    assert kept.columns == table(spark, []).columns and kept.count() == len(odd_rows()) - 2
    assert near_dedup.classes(table(spark, [])).count() == 0


# quality


def test_quality_sql(spark):
    check(spark, entries.op3_quality_rules, entries.OP3_SQL, SF)


def test_boilerplate_is_cut_and_copies_stay(spark):
    rng = random.Random(5)
    rows = [(k, "Menu and more, click here to read\n" + " ".join(words(30, rng)), "en", "h") for k in range(30)]
    rows += [(100 + k, "Menu and more, click here to read\nshort own", "en", "h") for k in range(3)]
    story = "\n".join(" ".join(words(12, rng)) for _ in range(5))
    rows += [(200 + k, story, "en", "h") for k in range(40)]
    out = {r["doc_id"]: r for r in quality.verdicts(table(spark, rows)).collect()}
    assert all(out[k]["removed_words"] == 7 and out[k]["kept"] for k in range(30))
    assert all(out[200 + k]["removed_words"] == 0 and out[200 + k]["kept"] for k in range(40))
    kept = {r["doc_id"]: r for r in quality.filter_documents(table(spark, rows)).collect()}
    assert "Menu" not in kept[0]["text"] and kept[0]["n_chars"] == len(kept[0]["text"]) and kept[0]["boilerplate"] == "b"
    assert kept[200]["text"] == story


def test_boilerplate_is_no_key_of_its_own_holders(spark):
    rng = random.Random(6)
    line = min(("".join(rng.choice("abcdefgh ijk") for _ in range(58)).strip().ljust(60, "x") for _ in range(4000)), key=lambda x: quality._hash(quality.normal_line(x)))
    n = len(line.split())
    rows = [(k, line + "\n" + " ".join(words(25, rng)), "en", "h") for k in range(20)]
    rows += [(100 + k, f"{line}\n{' '.join(words(12, rng))[:39]}", "en", "only") for k in range(20)]
    depleted = " ".join(rng.choice("bcdfg") + str(k) for k in range(40))
    rows += [(200 + k, f"{depleted}\npage {k}", "en", "left") for k in range(20)]
    out = {r["doc_id"]: r for r in quality.verdicts(table(spark, rows)).collect()}
    assert all(out[k]["removed_words"] == n and out[100 + k]["removed_words"] == n for k in range(20))
    assert all(out[200 + k]["removed_words"] == 40 and not out[200 + k]["kept"] and not out[200 + k]["base_failed"] for k in range(20))


def test_copies_and_large_hosts_do_not_hide_boilerplate(spark):
    rng = random.Random(8)
    line = "Footer of this site, all pages have it"
    own = [line + "\n" + " ".join(words(25, rng)) for _ in range(30)]
    rows = [(k, x, "en", "copied") for k, x in enumerate(own)] + [(100 + k, own[0], "en", "copied") for k in range(100)]
    rows += [(1000 + k, x, "en", "large") for k, x in enumerate(own[:12])]
    rows += [(2000 + k, " ".join(words(12, rng)), "en", "large") for k in range(3000)]
    story = [" ".join(words(12, rng)) for _ in range(6)]
    near = [[*story[: k % 6], story[k % 6] + f" edit{k}", *story[k % 6 + 1 :]] for k in range(120)]
    rows += [(6000 + k, "\n".join(x), "en", "near") for k, x in enumerate(near)]
    out = {r["doc_id"]: r["removed_words"] for r in quality.verdicts(table(spark, rows)).collect()}
    assert {out[k] for k in [*range(30), *range(100, 200), *range(1000, 1012)]} == {len(line.split())}
    assert {out[6000 + k] for k in range(120)} == {0}


def test_null_host_and_repeated_rows(spark):
    rng = random.Random(3)
    rows = [(100 * h + k, "One line of all\n" + " ".join(words(25, rng)), "en", host) for h, (host, n) in enumerate([(None, 9), ("", 9), ("full", 10)]) for k in range(n)]
    rows += [(400, "Line of a repeated row\n" + " ".join(words(25, rng)), "en", "full")] * 20
    out = {r["doc_id"]: r["removed_words"] for r in quality.verdicts(table(spark, rows)).collect()}
    assert {out[k] for k in [*range(9), *range(100, 109), 400]} == {0} and {out[200 + k] for k in range(10)} == {4}
    copies = [(k, "Told again\n" + " ".join(["a tale"] * 20) + "\n" + " ".join(["told twice"] * 10) + f"\nend {k}", "en", "h") for k in range(30)]
    plain = {r["removed_words"] for r in quality.verdicts(table(spark, copies), min_key_share=0).collect()}
    assert plain == {62} and {r["removed_words"] for r in quality.verdicts(table(spark, copies)).collect()} == {0}


def test_quality_of_odd_rows(spark):
    out = quality.verdicts(table(spark, odd_rows())).collect()
    assert len(out) == len(odd_rows())
    assert all(r["base_failed"] and not r["kept"] and r["n_words"] == 0 for r in out if r["doc_id"] in (1, 2, 3))
    assert quality.verdicts(table(spark, [])).count() == 0
    assert quality.filter_documents(table(spark, odd_rows())).columns == table(spark, []).columns


# decontamination


def test_leaks_against_all_windows(spark):
    rng = random.Random(7)
    items = [(k, " ".join(words(rng.randrange(12, 40), rng))) for k in range(25)] + [(90, "two words"), (91, None), (92, "lone"), (93, "three of them"), (94, "three of them")]
    docs = []
    for k in range(90):
        w = words(rng.randrange(5, 120), rng)
        if k % 3 == 0:
            leak = items[k % 25][1].split()
            leak = leak[: len(leak) - k % 4] if k % 2 else leak
            at = rng.randrange(len(w))
            w[at:at] = leak
        if k % 10 == 0:
            w[3:3] = ["lone", "lone", "two", "words"]
        if k % 25 == 1:
            w += ["three", "of", "them"]
        docs.append((k, "\n".join([" ".join(w[:7]), " ".join(w[7:])])))

    def bag(w):
        return collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))

    want = set()
    for d, t in docs:
        w = WORD.findall(t)
        for i, x in items:
            n = len(WORD.findall(x or ""))
            if not n:
                continue
            item = bag(WORD.findall(x))
            for k in range(len(w) - n + 1):
                win = bag(w[k : k + n])
                both = sum((win & item).values())
                if both / (2 * max(1, n - 4) - both) >= 0.8:
                    want.add((d, i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(table(spark, docs), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want) > 15
    left = {r["doc_id"] for r in decontaminate.drop_leaky(table(spark, docs), bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in want}


def test_windows_of_other_items_sizes_do_not_count(spark, monkeypatch):
    """A passage of a long item makes no windows of the sizes of shorter items, whose shingles it does not hold."""
    rng = random.Random(8)
    items = [" ".join(words(n, rng)) for n in range(10, 70)]
    docs = [(k, f"{' '.join(words(30, rng))} {items[k % 60]} {' '.join(words(30, rng))}") for k in range(120)]
    texts = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs]), pa.array([d for d, _ in docs]), pa.array([t for _, t in docs])], names=["doc_id", "text_hash", "text"])
    read = next(decontaminate.read_items(iter([pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(items)], names=["item_id", "text"])])))
    for bits in (22, 14):  # also when many shingles meet by chance
        known = []
        for column in ("tokens", "sized_tokens"):
            at = np.zeros(1 << bits, bool)
            at[read.column(column).flatten().to_numpy().view(np.uint64) >> np.uint64(64 - bits)] = True
            known.append(at)
        spans = [r for b in decontaminate.span_finder(*known, sorted(set(range(10, 70))), 0.8)(iter([texts])) for r in b.to_pylist()]
        for k, (d, t) in enumerate(docs):
            size = 10 + k % 60
            mine = [w | {"at": r["base"] + w["start"]} for r in spans if r["doc_id"] == d for w in r["windows"]]
            assert any(w["size"] == size and w["at"] == 30 for w in mine)
            if bits == 22:
                assert {w["size"] for w in mine} == {size} and len(mine) <= 2 + size // 4
        assert all(WORD.findall(r["span"]) == WORD.findall(docs[r["doc_id"]][1])[r["base"] : r["base"] + max(w["start"] + w["size"] for w in r["windows"])] for r in spans)


def test_leaks_of_odd_rows(spark):
    bench = spark.createDataFrame([(1, "w0 w1 w2 w3 w4 w5 w6 w7"), (None, None), (2, "")], "item_id long, text string")
    got = decontaminate.leaks(table(spark, odd_rows()), bench).collect()
    assert {r["doc_id"] for r in got} == {5, 6}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(table(spark, odd_rows()), none).count() == 0
    assert decontaminate.leaks(table(spark, []), bench).count() == 0


# personal data


def brute_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


@given(st.text(alphabet="0123456789.@+- ()ab_%é\n", max_size=60))
@settings(max_examples=400, deadline=None)
def test_base_spans(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_contexts_find_unseen_identifiers(spark):
    rng = random.Random(2)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(30)]
    rows = [(k, f"some text here token = \"{x}\" and then more words {k}") for k, x in enumerate(hexes)]
    rows += [(50, 'other prose token = "ZX-99-unseen-77" follows'), (51, "plain prose with report 2024-11-23 and code ABC12345 only"), (52, "mail me at a.b@mail.example.com or +1 (555) 123-4567")]
    out = {r["doc_id"]: r for r in pii.report(table(spark, rows)).collect()}
    start = rows[-3][1].index("ZX-99")
    assert out[50]["spans"] == f"id:{start}:{start + 15}" and out[50]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert out[51]["spans"] == "" and out[0]["n_id"] == 1 and (out[52]["n_email"], out[52]["n_phone"]) == (1, 1)
    safe = {r["doc_id"]: r["text"] for r in pii.redact(table(spark, rows)).collect()}
    more = [*rows, (60, 'été token = "AB-4821", and token = "77" here'), (61, "the token = 'secret' of letters"), (62, "ends with token =")]
    got = {r["doc_id"]: r["spans"] for r in pii.report(table(spark, more)).collect()}
    at = [more[-3][1].index(x) for x in ("AB-4821", "77")]
    assert got[60] == f"id:{at[0]}:{at[0] + 7},id:{at[1]}:{at[1] + 2}" and got[61] == "id:13:19" and got[62] == ""
    assert safe[50] == 'other prose token = "[ID]" follows' and safe[52] == "mail me at [EMAIL] or [PHONE]" and safe[51] == rows[-2][1]


def test_personal_data_of_odd_rows(spark):
    out = {r["doc_id"]: r for r in pii.report(table(spark, odd_rows())).collect()}
    assert out[1]["spans"] == "" and out[8]["n_email"] == 1 == out[8]["n_ip"]
    assert pii.report(table(spark, odd_rows())).count() == len(odd_rows()) and pii.report(table(spark, [])).count() == 0
    assert pii.redact(table(spark, odd_rows())).count() == len(odd_rows())


# mixing


def test_mixing_sql(spark):
    check(spark, entries.op6_mixing, entries.oracle_sql()["op6_mixing"], SF)


def test_raked_marginals_meet_targets(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(words(rng.randrange(1, 60), rng)), rng.choice(["en", "en", "de"]), rng.choice(["a", "a", "a", "b", "c"])) for k in range(300)]
    cells = mixing.with_targets(mixing.cell_table(mixing.labelled(table(spark, rows))))
    raked = mixing.rake(cells).collect()
    for d in mixing.DIMENSIONS:
        have, want = collections.Counter(), {}
        for r in raked:
            have[r[d]] += r["weight"]
            want[r[d]] = r[f"target_{d}"]
        assert sum(want.values()) == pytest.approx(1)
        assert all(have[k] == pytest.approx(want[k], rel=1e-4) for k in want)
    out = mixing.sampled(table(spark, rows)).collect()
    whole = sum(r["tokens"] for r in out)
    assert sum(r["tokens"] * r["probability"] for r in out) == pytest.approx(whole / 2, rel=1e-3)
    kept = {r["doc_id"] for r in mixing.sample_documents(table(spark, rows)).collect()}
    assert kept == {r["doc_id"] for r in out if r["sampled"]}


def test_given_targets_and_caps(spark):
    rng = random.Random(14)
    rows = [(k, " ".join(words(rng.randrange(1, 60), rng)), rng.choice(["en", "en", "de"]), rng.choice(["a", "a", "a", "b", "c"])) for k in range(400)]
    targets = spark.createDataFrame([("source", "a", 2.0), ("source", "b", 6.0), ("lang", "en", 0.5), ("lang", "de", 0.5), ("lang", "xx", 9.0)], "dimension string, value string, share double")
    docs = mixing.labelled(table(spark, rows), topic_of=F.when(F.length("text") > 200, "long"))
    low, high = ({(r["dimension"], r["value"]): r for r in mixing.marginals(mixing.calibrated(docs, keep, targets=targets)).collect()} for keep in (0.02, 0.6))
    assert [low["source", v]["target"] for v in "abc"] == pytest.approx([0.25, 0.75, 0]) and {v for d, v in low if d == "topic"} == {"long", "(none)"}
    assert low["lang", "en"]["target"] == pytest.approx(0.5)
    assert all(r["raked"] == pytest.approx(r["target"], abs=1e-4) == pytest.approx(r["expected"], abs=1e-4) for r in low.values())
    assert high["source", "b"]["expected"] < 0.7  # all of it is in, and it is not enough
    sample = mixing.sampled(table(spark, rows), 0.02, targets=targets).collect()
    assert not any(r["sampled"] for r in sample if r["source"] == "c")


def test_mixing_of_odd_rows(spark):
    out = mixing.sampled(table(spark, odd_rows())).collect()
    assert len(out) == len(odd_rows()) and all(r["tokens"] == 0 and not r["sampled"] for r in out if r["doc_id"] == 1)
    assert mixing.sampled(table(spark, [])).count() == 0 == mixing.sample_documents(table(spark, [])).count()


# languages


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_languages_against_plain_compression(spark):
    """The predictions from dictionaries and sizes that plain Python makes, one frame at a time."""
    import zstandard as zstd

    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(9000, "²½① 12 — …", "en"), (9001, "x", None), (9002, "der und die", None), (9003, None, "de")]
    found = collections.defaultdict(collections.Counter)
    for d, text, lang in rows:
        if text and lang and zlib.crc32(str(d).encode()) % 4 != 2:
            found[lang].update("".join(c if c.isalpha() else " " for c in text.lower()).split())
    books = {lang: zstd.ZstdCompressionDict(" ".join(sorted(c, key=lambda w: (c[w], w))).encode(), dict_type=zstd.DICT_TYPE_RAWCONTENT) for lang, c in sorted(found.items())}
    want = {}
    for d, text, _ in rows:
        plain = " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split())
        total = {lang: sum(len(zstd.ZstdCompressor(level=langid.LEVEL, dict_data=b, write_content_size=False, write_dict_id=False).compress(plain[k : k + langid.CHUNK_CHARS].encode())) for k in range(0, len(plain), langid.CHUNK_CHARS)) for lang, b in books.items()}
        want[d] = min(total, key=total.get) if plain else "und"
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(table(spark, rows)).collect()}
    assert got == want


def test_samples_are_bounded_by_rows(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 3)
    rows = [(1, f"same word{'ab'[k % 2]}", "en") for k in range(200)] + [(5, f"other term{chr(97 + k % 26)}{chr(97 + k // 26)}", "de") for k in range(200)]
    model = langid.learn(table(spark, rows))
    assert sorted(model["en"].split()) == [b"same", b"worda", b"wordb"] and len(model.get("de", b"").split()) <= 13


def test_languages_of_odd_rows(spark):
    out = langid.identify(table(spark, odd_rows())).collect()
    assert len(out) == len(odd_rows()) and all(r["lang_pred"] == "und" and r["score"] == 0 for r in out if r["doc_id"] in (1, 2, 3))
    assert {r["lang_pred"] for r in langid.identify(table(spark, [(1, "words")])).collect()} == {"und"}
    assert langid.identify(table(spark, [])).count() == 0


# html


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain text", "plain text"),
        ("<p>cut off <b", "cut off"),
        ("<html><head><title>x</title></head><body>hello &amp am &lt;b&gt;</body>", "hello & am <b>"),
        ("<body><nav><ul><li><a href='/x'>Home</a></li></ul></nav><article><h1>Title</h1><p><b>First, part.<br><p>Second&nbsp;one.</article><footer>&copy; site</footer>", "Title First, part. Second one."),
        ('<body><script>var t="</p>";</script><!-- <p>no</p> --><article><p>a < b and "c"</p></article>', 'a < b and "c"'),
        ("<body><div id='cookie-notice'>We use cookies.</div><div class=post><p>Text of the page, long enough.</p><ul><li>one, item</li></ul></div><div id=comments><p>A reader's comment, which is long, too.</p></div>", "Text of the page, long enough. one, item"),
    ],
)
def test_main_text(page, text):
    assert html.extract(page) == text


LONG = "A long passage, with marks, which says something, and then says more of it, at length. " * 4


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><div class=post><h1>Title</h1><p>Lead.</p><div class=text>{LONG}</div></div></body>", f"Title Lead. {LONG}"),
        (f"<body><h1>Title</h1><p>Lead.</p><div class=text><p>{LONG}</p><p>{LONG}</p></div></body>", f"Title Lead. {LONG} {LONG}"),
        (f"<body><div><p>{LONG * 2}</p><p>{LONG * 2}</p></div><div><p>{LONG}</p></div></body>", f"{LONG * 2} {LONG * 2} {LONG}"),
        (f"<body><div><a href=x>Home page</a></div><article><p>{LONG * 2}</p></article><article><h2>Next</h2><p>{LONG}</p></article></body>", f"{LONG * 2} Next {LONG}"),
        (f"<body><main><article><p>{LONG}</p></article><ul><li>more</li></ul></main></body>", LONG),
    ],
)
def test_main_text_is_whole(page, text):
    assert html.extract(page) == " ".join(text.split())


LINKS = "".join(f"<li><a href=/{k}>Place {k}</a></li>" for k in range(9))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><div class=zone><ul>{LINKS}</ul></div><div class=story><h1>Title</h1><p>{LONG}</p><p>Short end.</p></div><div class=zone-b><span>Our site</span></div></body>", f"Title {LONG} Short end."),
        (f"<body><table><tr><td><ul>{LINKS}</ul></td><td><p>{LONG}</p><p>{LONG}</p></td></tr></table><div>Made by us</div></body>", f"{LONG} {LONG}"),
        (f"<body><div>top</div><p>{LONG}</p><h2>Part</h2><p>{LONG}</p><div>end of the site</div></body>", f"{LONG} Part {LONG}"),
    ],
)
def test_scores_decide(monkeypatch, page, text):
    assert html.extract(page) == " ".join(text.split())
    monkeypatch.setattr(html, "path_scores", lambda blocks, width=2: np.ones(len(blocks)))
    assert html.extract(page) != " ".join(text.split())


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><h2 class='section-header'>Head</h2><p>{LONG}</p><p>x <math><mi>E</mi></math> y</p></article>", f"Head {LONG} x E y"),
        (f"<article><div class='section-header'><h2>Head</h2></div><p>{LONG}</p><object>{LONG}</object></article>", f"Head {LONG} {LONG}"),
        (f"<div class='page widget'><main><p>{LONG}</p></main><div class=widget>More</div></div>", LONG),
        (f"<article><p>{LONG}</p><div class=notice>Closed.</div></article><div id=comments><article class=comment-body><p>{LONG}</p></article></div>", LONG),
    ],
)
def test_article_keeps_its_parts(page, text):
    assert html.extract(page) == " ".join(text.split())


def test_path_scores_by_hand():
    rng = random.Random(1)
    for _ in range(40):
        tags = ["div", "p", "ul", "li", "td", "section"]
        page = "".join(f"<{(x := rng.choice(tags))}>{'<a>' * (k % 4 == 0)}{'w, ' * rng.randrange(1, 30)}{'</a>' * (k % 4 == 0)}</{x}>" for k in range(rng.randrange(1, 12)))
        blocks = html.read_blocks(page)

        def path(node):
            return path(node.parent) + (node.tag,) if node else ()

        ratio = []
        for mark in (False, True):
            per = collections.defaultdict(list)
            for b in blocks:
                plain = max(0, len(b.text) - b.linked)
                per[path(b.node)].append(len(re.findall(r"[^\w\s]", b.text)) * (plain > 0) if mark else plain)
            raw = [sum(per[path(b.node)]) / len(per[path(b.node)]) for b in blocks]
            near = [[(math.exp(-((i - k) ** 2) / 2), raw[i]) for i in range(max(0, k - 2), min(len(raw), k + 3))] for k in range(len(raw))]
            ratio.append([sum(w * x for w, x in n) / sum(w for w, _ in n) for n in near])
        assert html.path_scores(blocks) == pytest.approx([math.sqrt(a * (1 + b)) for a, b in zip(*ratio, strict=True)])


PROSE = "A longer paragraph of plain prose, with commas, clauses, and a full stop at its end, as articles have."


@pytest.mark.parametrize(
    "page, text",
    [
        (f'<body><div class="no-sidebar content"><h1>T</h1><p>{PROSE}</p><p>{PROSE}</p></div></body>', f"T {PROSE} {PROSE}"),
        (f'<body><div id="main-header-wrap" class="page search-page"><h1>T</h1><p>{PROSE}</p></div><div class="sidebar"><p>{PROSE[:40]}</p></div></body>', f"T {PROSE}"),
        (f'<body><div class="related-wrap"><div class="ad-free"><p>{PROSE}</p><p>{PROSE}</p></div><div class="ads"><p>Buy now.</p></div></div></body>', f"{PROSE} {PROSE}"),
        (f'<body><h1>T</h1><p>{PROSE}</p><p>{PROSE}</p><ul><li>one</li><li>two</li></ul><div>Imprint</div></body>', f"T {PROSE} {PROSE} one two"),
        (f'<body><h1>T</h1><p>{PROSE}</p><table><tr><td>1</td><td>2</td></tr></table><ul><li><a href=x>More of this</a></li></ul></body>', f"T {PROSE} 1 2"),
        (f'<body><article><p>{PROSE}</p></article><div class="comments"><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div></body>', PROSE),
    ],
)
def test_names_give_way_to_most_of_the_text(page, text):
    assert html.extract(page) == text


@pytest.mark.parametrize("page", ["<div>t" * 100_000, "<div class=ad>t" * 100_000, "<i>" * 50_000 + "<div></div></b>" * 50_000, "<p><b>x<a '>" * 50_000])
def test_deep_pages_take_seconds(page):
    import time

    began = time.monotonic()
    html.extract(page)
    assert time.monotonic() - began < 20


def test_main_text_of_articles(spark):
    import html as entity

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in html.main_text(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = " ".join(entity.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", body))).split())
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


# tokens


@pytest.fixture(scope="module")
def library():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@given(st.lists(st.sampled_from(["a", "B", " ", "  ", "\n", "\t", " ", "'s", " '", "12", "é", "<|endoftext|>", "!", "日本", "\r\n"]), max_size=14))
@settings(max_examples=300, deadline=None)
def test_pieces_are_safe(library, parts):
    text = "".join(parts)
    cut = tokens.pieces(text)
    assert "".join(cut) == text
    assert sum(len(library.encode(p, add_special_tokens=False)) for p in cut) == len(library.encode(text, add_special_tokens=False))


def test_token_counts(spark, library):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False)) for r in docs.collect()}
    got = tokens.counts(docs, path).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want and all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
    odd = tokens.counts(table(spark, odd_rows()), path).collect()
    assert len(odd) == len(odd_rows()) and all(r["n_tokens"] == 0 == r["n_bytes"] for r in odd if r["doc_id"] in (1, 2))
    assert tokens.counts(table(spark, []), path).count() == 0


# archives


def test_archive_round_trip(spark):
    check(spark, entries.op4_warc, entries.OP4_SQL, SF)
    body = "<p>" + "same page " * 30 + "\r\n\r\nWARC/1.1\r\n é</p>"
    rows = [(3, "http://a/ b", body), (1, None, body), (1, None, body), (2, "u", body), (None, "u", body), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = common.shared_path(spark, "warc")
    assert warc.write_archives(pages, folder) == len(rows)
    out = warc.read_archives(spark, folder).collect()
    kinds = collections.Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in out)
    assert kinds == collections.Counter([(3, "revisit", 1), (1, "response", None), (1, "response", None), (2, "revisit", 1), (None, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None)])
    assert all(r["payload"].decode() == body for r in out if r["page_id"] == 1) and {r["payload_bytes"] for r in out if r["page_id"] in (1, 2, 3)} == {len(body.encode())}
    assert warc.round_trip(pages.limit(0)).count() == 0


def records(n):
    return [warc.record("response", k, f"http://x/{k}", f"page {k}".encode() * 20, len(f"page {k}") * 20, hashlib.sha256(f"page {k}".encode() * 20).hexdigest(), None) for k in range(n)]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_goes_on_after_damage(packed):
    parts = [warc.member(r) if packed else r for r in records(6)]
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 0xFF
    data = parts[0] + b"garbage" + parts[1] + bytes(broken) + parts[3] + parts[4] + parts[5][:-9]
    out = list(warc.salvage(data))
    assert [x["page_id"] for _, x in out if "page_id" in x] == [0, 1, 3, 4]
    gaps = [(at, x["gap_bytes"]) for at, x in out if "gap_bytes" in x]
    first = len(parts[0])
    assert gaps == [(first, 7), (first + 7 + len(parts[1]), len(broken)), (len(data) - len(parts[5]) + 9, len(parts[5]) - 9)]
    assert sum(n for _, n in gaps) + sum(len(parts[k]) for k in (0, 1, 3, 4)) == len(data)


def test_a_writer_that_runs_again_leaves_each_record_once(spark, monkeypatch):
    monkeypatch.setattr(warc.writer, "__defaults__", (3000,))
    rng = random.Random(1)
    rows = [(k, f"u{k}", " ".join(words(rng.randrange(5, 90), rng))) for k in range(120)]
    folder = common.shared_path(spark, "warc")
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), folder)
    out = warc.read_archives(spark, folder).collect()
    assert sorted(r["page_id"] for r in out) == list(range(120)) and len({r["file"] for r in out}) > 3


def test_salvage_inside_a_member():
    parts = [*records(5)]
    parts[2] = parts[2].replace(b"page 2page", b"page XXXXX")
    packed = warc.member(b"".join(parts))
    out = [x for _, x in warc.salvage(packed)]
    assert [x.get("page_id") for x in out] == [0, 1, None, 3, 4]
    assert (out[2]["gap_bytes"], out[2]["inner"]) == (len(parts[2]), len(parts[0] + parts[1]))
    long = b"".join(r for k in range(400) for r in records(5))
    cut = warc.member(long)
    cut = cut[: len(cut) * 2 // 3] + warc.member(records(7)[6])
    out = [x for _, x in warc.salvage(cut)]
    assert [x["page_id"] for x in out if "page_id" in x][-1] == 6 and len(out) > 500 and 1 <= sum("gap_bytes" in x for x in out) <= 2


def test_large_archives_are_read_in_blocks(tmp_path):
    import tracemalloc

    payload = b"some page text, " * (1 << 14)
    one = warc.record("response", 7, "http://x/", payload, len(payload), hashlib.sha256(payload).hexdigest(), None)
    n = (1 << 30) // len(one) + 1
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    with open(tmp_path / "a.warc.gz", "wb") as f:
        for _ in range(n):
            f.write(pack.compress(one))
        f.write(pack.flush())
    tracemalloc.start()
    with warc._store(str(tmp_path / "a.warc.gz"))[0].open_input_file(str(tmp_path / "a.warc.gz")) as f:
        assert sum(x["page_id"] == 7 for _, x in warc.salvage(f)) == n
    assert tracemalloc.get_traced_memory()[1] < 32 << 20
    tracemalloc.stop()


# licences


def test_license_sql(spark):
    check(spark, entries.op1_license_scan, entries.oracle_sql()["op1_license_scan"], SF)


def test_licenses_of_odd_rows(spark):
    mit = dict(licenses.TEMPLATES)["mit-text"]
    half = len(mit) // 2 - 3
    rows = [*odd_rows(), (20, "released, under THE mit license"), (21, f"head\n\n{mit[:half]}\n{mit[half:]}\n\ntail"), (22, "All rights"), (20, "prose about licenses and rights in general")]
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(table(spark, rows)).collect()}
    assert got == {(20, "mit"), (21, "mit-text")}
    assert licenses.scan(table(spark, [])).count() == 0


def test_license_bodies_and_own_templates(spark, monkeypatch):
    bodies = dict(licenses.TEMPLATES)
    wrap = lambda t: "\n".join(" * " + " ".join(t.split()[k : k + 12]) for k in range(0, len(t.split()), 12))
    rows = [(k, f"def f(): pass\n\n{wrap(bodies[n])}\n\nmore code here") for k, n in enumerate(["bsd-3-clause-text", "apache-2.0-notice", "zlib", "gpl-3.0-notice"])]
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(table(spark, rows)).collect()}
    assert {(0, "bsd-3-clause-text"), (1, "apache-2.0-notice"), (2, "zlib"), (3, "gpl-3.0-notice")} <= got

    def dice(a, b):
        x, y = (set(zip(w, w[1:])) for w in (re.sub(r"[^a-z0-9]+", " ", t.lower()).split() for t in (a, b)))
        return 2 * len(x & y) / (len(x) + len(y))

    own = [("house", "You may read this text at home but not elsewhere."), *[(n, bodies[n]) for n in ("bsd-2-clause-text", "bsd-3-clause-text", "mit")]]
    rows = [(1, "you may read this text at home, but not elsewhere"), (2, bodies["bsd-3-clause-text"]), (3, "Released under the MIT License."), (4, bodies["zlib"])]
    got = {(r["doc_id"], r["license"], r["best_dice"]) for r in licenses.scan(table(spark, rows), templates=own).collect()}
    monkeypatch.setattr(licenses, "BROADCAST_CHARS", 10)
    assert got == {(r["doc_id"], r["license"], r["best_dice"]) for r in licenses.scan(table(spark, rows), templates=own).collect()}
    assert licenses.scan(table(spark, rows), templates=[]).count() == 0 == licenses.scan(table(spark, rows), templates=[("one", "word"), ("none", "")]).count()
    assert got == {(d, n, round(dice(t, b), 6)) for d, t in rows for n, b in own if dice(t, b) >= 0.8}


# the pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    now, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        after = common.staged(stage(spark, now, SF), name)
        seen.append((name, now, after))
        now = after
    assert [n for n, _, _ in seen] == ["quality_rules", "near_dedup", "decontaminate", "personal_data", "mixing"]
    assert all(a.columns == docs.columns for _, _, a in seen[:-1])
    ids = lambda df: {r["doc_id"] for r in df.collect()}
    kept = {r["doc_id"] for r in quality.verdicts(docs).collect() if r["kept"]}
    assert ids(seen[0][2]) == kept
    before = [(r["doc_id"], r["text"]) for r in seen[1][1].collect()]
    assert ids(seen[1][2]) == {d for d, c in brute_classes(before).items() if d == c}
    clean = {r["doc_id"]: r["text"] for r in seen[3][2].collect()}
    assert not any(brute_spans(t) for t in clean.values()) and set(clean) == ids(seen[2][2])
    assert ids(seen[4][2]) <= set(clean) and {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == ids(seen[4][2])
    assert math.isclose(sum(r["probability"] * r["tokens"] for r in mixing.sampled(seen[3][2]).collect()), sum(len(WORD.findall(t)) for t in clean.values()) / 2, rel_tol=1e-3)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_copies_are_not_broadcast(spark, how):
    """The copies are 32 times what Spark counts, so a table below its threshold can be far too large for the driver."""
    rows, facts = spark.range(100).selectExpr("id % 7 as k", "id"), spark.range(5).selectExpr("id as k", "id * 10 as v")
    out = common.attach(rows, facts, ["k"], ["id"], how=how)
    assert sorted(((r["id"], r["v"]) for r in out.collect()), key=str) == sorted(((i, i % 7 * 10 if i % 7 < 5 else None) for i in range(100) if how == "left" or i % 7 < 5), key=str)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
