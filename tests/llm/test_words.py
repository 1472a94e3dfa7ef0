import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from softseg.llm import periodic, queries, variants

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, shortest=24, exponent=3):
    """Every stretch that keeps a period and that no neighbour extends, of which the smallest period counts."""
    n, out = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, exponent * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, length, q) for (s, length), q in out.items()), key=lambda r: (r[0], r[2]))


def structured(draw):
    """Texts over few words, with roots that hold unary stretches, repeated."""
    letters, n = draw.choice([1, 2, 2, 3, 4]), draw.randint(0, 200)
    text = [draw.randrange(letters) for _ in range(n)]
    if draw.random() < 0.7 and n > 30:
        root = []
        while len(root) < draw.randint(1, 40):
            root += [draw.randrange(letters)] * draw.randint(1, 14)
        again = (root * draw.randint(2, 9))[: draw.randint(1, 300)]
        at = draw.randint(0, n)
        text = (text[:at] + again + text[at:]) * draw.choice([1, 1, 2, 4])
    return text


@pytest.mark.parametrize("seed", range(3))
def test_runs_of_texts_over_few_words(seed):
    draw = random.Random(seed)
    for _ in range(60):
        texts = [structured(draw) for _ in range(draw.randint(1, 5))]
        want, start = [], 0
        for t in texts:
            want += [(s + start, length, q) for s, length, q in brute_runs(t)]
            start += len(t)
        got = periodic.find_runs(np.array([w for t in texts for w in t], np.int64), np.array([len(t) for t in texts], np.int64))
        assert list(zip(*(x.tolist() for x in got))) == want


def test_other_lengths_and_exponents():
    draw = random.Random(9)
    for shortest, exponent in ((6, 3), (40, 4), (12, 5)):
        for _ in range(40):
            t = structured(draw)
            got = periodic.find_runs(np.array(t, np.int64), np.array([len(t)], np.int64), shortest, exponent)
            assert list(zip(*(x.tolist() for x in got))) == brute_runs(t, shortest, exponent)
    with pytest.raises(ValueError):
        periodic.find_runs(np.zeros(9, np.int64), np.array([9]), 24, 2)


def test_successors_of_ranges():
    order = np.random.default_rng(1).permutation(700)
    tree = periodic.WaveletTree(order)
    draw = np.random.default_rng(2)
    lo, hi = np.sort(draw.integers(0, 701, (2, 500)), axis=0)
    v = draw.integers(0, 720, 500)
    for a, b, x, got in zip(lo, hi, v, tree.successor(lo, hi, v)):
        above = [y for y in order[a:b] if y >= x]
        assert got == min(above) if above else got > 700


def test_factors_compare_both_ways():
    t = np.random.default_rng(4).integers(0, 2, 400)
    ends = np.where(np.arange(400) < 250, 250, 400)
    starts = np.where(np.arange(400) < 250, 0, 250)
    found = periodic.Factors(t + 2 * (starts > 0), starts, ends)
    i = np.random.default_rng(5).integers(0, 120, 300)
    j = i + np.random.default_rng(6).integers(1, 100, 300)
    for a, b, ahead, behind in zip(i, j, found.ahead(i, j), found.behind(i, j)):
        x = next((x for x in range(400) if b + x >= 250 or t[a + x] != t[b + x]))
        y = next((y for y in range(400) if a - y - 1 < 0 or t[a - y - 1] != t[b - y - 1]))
        assert (ahead, behind) == (x, y)
    suffixes = sorted(range(250), key=lambda p: t[p:250].tolist())
    assert [p for p in found.sa if p < 250] == suffixes


def planted(i, text):
    w = WORDS.findall(text or "")
    n, h = len(w), zlib.crc32(str(i).encode())
    if h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]


def test_periods_of_documents(spark, sf, texts):
    rows = queries.op12_periods(spark, sf).collect()
    assert len(rows) == len(texts) and sum(r["n_runs"] for r in rows) >= 15
    for r in rows:
        w = planted(r["doc_id"], texts[r["doc_id"]])
        ids = {}
        runs = brute_runs([ids.setdefault(x, len(ids)) for x in w])
        dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
        top = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if runs else (None,) * 3
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        kept = " ".join(x for k, x in enumerate(w) if k not in dropped)
        want = (len(runs), *top, 1000 * top[1] // top[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())
        assert tuple(r)[1:] == want


def test_runs_of_odd_rows(spark, odd, none):
    rows = periodic.periodic_runs(odd).collect()
    assert len(rows) == odd.count() and periodic.periodic_runs(none).collect() == []
    for r in rows:
        if r["id"] in (1, 2, 3):
            assert (r["n_words"], r["runs"], r["collapsed"]) == (0, [], "")
    long = " ".join(["x"] * 250_000 + [f"w{i % 7}" for i in range(50_000)])
    frame = spark.createDataFrame([(None, long), (None, long), (1, "é b " * 12)], "doc_id long, text string")
    got = sorted(periodic.periodic_runs(frame).collect(), key=lambda r: r["n_words"])
    assert [tuple(s) for s in got[0]["runs"]] == [(0, 24, 2)] and got[0]["collapsed"] == "é b"
    for r in got[1:]:
        assert [tuple(s) for s in r["runs"]] == [(0, 250_000, 1), (250_000, 50_000, 7)] and r["collapsed"] == "x w0 w1 w2 w3 w4 w5 w6"


def brute_variants(counts):
    letters = sorted({c for w in counts for c in w})
    near = {w: set() for w in counts}
    for w in counts:
        for k in range(len(w)):
            for other in [w[:k] + w[k + 1 :]] + [w[:k] + c + w[k + 1 :] for c in letters]:
                if other != w and other in counts:
                    near[w].add(other)
                    near[other].add(w)
    form = {}
    for w, around in near.items():
        top = min(around, key=lambda x: (-counts[x], x)) if around else None
        form[w] = top if top is not None and counts[top] >= 2 * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (n, len(near[w]), form[w], counts.get(form[w]), root(w)) for w, n in counts.items()}


def found_variants(frame):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in frame.collect()}


@pytest.mark.parametrize("narrow, wide", [(16, 1_000), (2, 4)])
def test_variants_of_dense_words(spark, monkeypatch, narrow, wide):
    """Over three letters chunks are shared by many words, so that keys have to grow."""
    monkeypatch.setattr(variants, "NARROW", narrow)
    monkeypatch.setattr(variants, "WIDE", wide)
    draw = random.Random(5)
    counts = {"".join(draw.choice("abé") for _ in range(draw.randint(1, 8))): draw.randint(1, 60) for _ in range(1_200)}
    assert found_variants(variants.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == brute_variants(counts)


def test_spelling_of_documents(spark, sf, texts):
    counts, low = Counter(), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text in texts.items():
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{i}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    want = brute_variants(counts)
    assert found_variants(queries.op13_spelling(spark, sf)) == want and sum(v[2] is not None for v in want.values()) > 100


def test_variants_of_odd_rows(spark, odd, none):
    runs = variants.letter_runs(odd)
    assert runs.columns == ["id", "run"] and variants.letter_runs(none).collect() == []
    assert {r["run"] for r in runs.filter("id = 9").collect()} == {"zürich", "naïve", "another", "text", "under", "the", "same", "id"}
    assert variants.spelling_variants(variants.word_counts(variants.letter_runs(none), "run")).collect() == []
    rows = [("a" * 3_000, 9), ("a" * 3_001, 20), ("x", 1), ("xy", 5), ("", 4), (None, 3), ("tie", 1), ("ties", 2), ("tied", 2), ("chain", 1), ("chains", 2), ("chainsx", 4)]
    got = found_variants(variants.spelling_variants(spark.createDataFrame(rows, "word string, n long")))
    assert got["a" * 3_000] == (9, 1, "a" * 3_001, 20, "a" * 3_001) and got[None] == (3, 0, None, None, None)
    assert got["tie"] == (1, 2, "tied", 2, "tied") and got["chain"] == (1, 1, "chains", 2, "chainsx") and got["chains"] == (2, 2, "chainsx", 4, "chainsx")
    assert got["x"] == (1, 2, "xy", 5, "xy") and got[""] == (4, 1, None, None, "")
    with pytest.raises(ValueError):
        variants.spelling_variants(spark.createDataFrame(rows, "word string, n long"), commoner=1)
