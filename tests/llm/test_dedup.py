import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from softseg.llm import exact_dedup, queries, simhash, suffix_dedup
from softseg.llm.columns import lower_ascii


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_exact_groups(documents, texts):
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[low(t)].append(i)
    for r in exact_dedup.duplicate_groups(documents).collect():
        own = groups[low(texts[r["id"]])]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), r["id"] == max(own))
        assert r["digest"] == hashlib.sha256(low(texts[r["id"]]).encode()).digest()


def test_exact_odd_rows(odd, none):
    rows = exact_dedup.duplicate_groups(odd).collect()
    assert len(rows) == odd.count() and exact_dedup.duplicate_groups(none).collect() == []
    same = [r for r in rows if r["group_size"] == 3]
    assert {(r["id"], r["keep_id"], r["kept"]) for r in same} == {(5, 6, False), (6, 6, True)}
    empty = [r for r in rows if r["id"] in (1, 2)]
    assert {(r["id"], r["keep_id"], r["kept"]) for r in empty} == {(1, 2, False), (2, 2, True)}
    nameless = [r for r in rows if r["id"] is None]
    assert sorted(r["kept"] for r in nameless) == [False, True]
    kept = exact_dedup.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r["kept"] for r in rows)
    assert {r["_digest"] for r in kept.collect()} == {"own _digest"}


def test_rows_alone_with_length_and_prefix_are_not_hashed(spark, documents, texts):
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[low(t)].append(i)
    want = sorted(max(own) for own in groups.values())
    assert sorted(r["doc_id"] for r in exact_dedup.drop_exact_duplicates(documents).collect()) == want
    norm = F.lower(F.coalesce("text", F.lit("")))
    keys = Counter((len(t.encode()), low(t)[:128]) for t in map(lambda t: t or "", texts.values()))
    several = sum(n for n in keys.values() if n > 1)
    maybe = exact_dedup._survivors(documents, F.xxhash64(F.octet_length(norm), F.substring(norm, 1, 128))).filter("maybe").count()
    assert several <= maybe < several + 0.1 * len(texts)


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    bits = Counter(b for s in sh for b in range(64) if xxhash.xxh64_intdigest(s, 42) >> b & 1)
    return sum(1 << b for b, n in bits.items() if 2 * n > len(sh))


def components(fps):
    """Id -> smallest id within reach, by comparing all pairs."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_components(documents, texts):
    want = {i: brute_fingerprint(t) for i, t in texts.items()}
    comp = components(want)
    for r in simhash.near_duplicates(documents).collect():
        assert r["fp"] % (1 << 64) == want[r["id"]] and r["component_id"] == comp[r["id"]]


def test_simhash_pieces(monkeypatch):
    text = " ".join(f"w{i}\n" if i % 7 else f"w{i}" for i in range(500))
    whole = simhash.fingerprint(text)
    assert whole == brute_fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 37)
    assert simhash.fingerprint(text) == whole


@pytest.mark.parametrize("hot_rows", [simhash.HOT_ROWS, 3])
def test_links_join_all_pairs_within_two_bits(spark, hot_rows):
    """Random fingerprints, chains of one and two bits around some of them, and many that share a half."""
    rng = np.random.default_rng(hot_rows)
    fps = set(rng.integers(0, 1 << 64, 150, np.uint64).tolist())
    for v in sorted(fps)[:20]:
        for _ in range(10):
            v ^= sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 4)), replace=False))
            fps.add(v)
    for shift in (0, 32):
        fps |= {(0x1234ABCD << (32 - shift)) | (int(x) << shift) for x in rng.integers(0, 1 << 9, 120)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in sorted(fps)]
    found = simhash.links(spark.createDataFrame(signed, "fp long"), hot_rows).collect()
    assert all(r["a"] != r["b"] for r in found)
    root = {v: v for v in fps}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for r in found:
        a, b = sorted((find(r["a"] % (1 << 64)), find(r["b"] % (1 << 64))))
        root[b] = a
    got = {v: find(v) for v in fps}
    assert got == components({v: v for v in fps})


def test_simhash_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and simhash.near_duplicates(none).collect() == []
    assert {r["component_id"] for r in rows if r["id"] in (1, 2, 3)} == {1} and {r["fp"] for r in rows if r["id"] in (1, 2, 3)} == {0}
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[1] == 1 and ids[2] == ids[3] == 0 and ids[5] == 1 and ids[6] == 0 and ids[None] == 1 and ids[7] + ids[8] == 1


def brute_spans(raws, length=suffix_dedup.LENGTH):
    n = Counter(r[s : s + length] for r in raws for s in range(len(r) - length + 1))
    out = []
    for r in raws:
        cover = np.zeros(len(r) + 2, int)
        for s in range(len(r) - length + 1):
            if n[r[s : s + length]] > 1:
                cover[s + 1 : s + length + 1] = 1
        edge = np.flatnonzero(np.diff(cover))
        out.append(list(zip(edge[::2].tolist(), edge[1::2].tolist())))
    return out


def check_spans(frame, raws):
    """raws: id -> bytes; ids are unique."""
    want = dict(zip(raws, brute_spans(list(raws.values()))))
    for r in suffix_dedup.repeated_spans(frame).collect():
        raw, spans = raws[r["id"]], want[r["id"]]
        assert [(s["start"], s["stop"]) for s in r["spans"]] == spans
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(raw), sum(b - a for a, b in spans), len(spans))
        rest = b"".join(raw[a:b] for a, b in zip([0, *[s[1] for s in spans]], [*[s[0] for s in spans], len(raw)]))
        assert r["kept_sha256"] == hashlib.sha256(rest).hexdigest()


def test_repeats_of_documents(documents, texts):
    check_spans(documents, {i: (t or "").encode() for i, t in texts.items()})


def test_planted_repeats(spark):
    rng = np.random.default_rng(4)
    noise = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage, edge = noise(900), noise(400)
    rows = {i: noise(int(rng.integers(0, 700))) + passage[int(a) : int(a) + int(b)] + noise(int(rng.integers(0, 700))) for i, (a, b) in enumerate(zip(rng.integers(0, 300, 40), rng.integers(380, 900, 40)))}
    rows |= {50: "ab" * 700, 51: "x" * 399, 52: "x" * 400, 53: "y" * 401, 54: noise(30) + edge, 55: edge + noise(30), 56: noise(500) + edge[:399], 57: "é" * 450, 58: "abc" * 300 + "abd" * 300}
    check_spans(spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5), {i: t.encode() for i, t in rows.items()})


def test_long_texts_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(5)
    body = bytes(rng.integers(97, 123, 9_000, dtype=np.uint8))
    body = body[:4_000] + b" ".join(body[i : i + 5] for i in range(4_000, 9_000, 5))

    def strings():
        found = [x for _, *fields in suffix_dedup.text_anchors([body]) for x in zip(*(f.tolist() for f in fields))]
        words = lambda p, b, a: [(s + p - b, e + p - b) for s, e in zip(*suffix_dedup.word_windows(np.frombuffer(body[p - b : p + a], np.uint8), np.array([a + b]))) if s <= b and e >= b + suffix_dedup.CORE]
        return sorted((p, s) for p, lo, hi, *_ in found for s in range(p - hi, p - lo + 1)), sorted((p, *w) for p, _, _, b, a, _ in found if b + a for w in words(p, b, a))

    whole, whole_words = strings()
    suffix_dedup._powers.cache_clear()
    monkeypatch.setattr(suffix_dedup, "PIECE", 2_500)
    parts, parts_words = strings()
    assert parts == whole and len(whole) == len(body) - suffix_dedup.LENGTH + 1
    assert parts_words == whole_words and len(whole_words) == 1_000 - suffix_dedup.WORDS
    monkeypatch.undo()
    suffix_dedup._powers.cache_clear()


def brute_passages(raws, words=suffix_dedup.WORDS):
    """Ids -> maximal runs covered by repeated strings of LENGTH bytes or of so many words."""
    cut = {}
    for i, r in raws.items():
        at = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", r)]
        cut[i] = [(at[k][0], at[k + words - 1][1]) for k in range(len(at) - words + 1)]
        cut[i] = [(a, b) for a, b in cut[i] if suffix_dedup.CORE <= b - a < suffix_dedup.LENGTH] + [(a, a + suffix_dedup.LENGTH) for a in range(len(r) - suffix_dedup.LENGTH + 1)]
    n = Counter(raws[i][a:b] for i, own in cut.items() for a, b in own)
    return {i: suffix_dedup._merged([(a, b) for a, b in own if n[raws[i][a:b]] > 1]) for i, own in cut.items()}


@pytest.mark.parametrize("hot_rows", [suffix_dedup.HOT_ROWS, 2])
def test_passages_of_over_fifty_words(spark, documents, texts, monkeypatch, hot_rows):
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", hot_rows)
    rng = np.random.default_rng(11)
    noise = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(n))
    passages = [noise(n) for n in (50, 51, 60, 70, 120)] + [" ".join("ab"[i % 2] for i in range(90))]
    rows = {i: f"{noise(int(rng.integers(0, 60)))} {passages[i % 6]}\n{noise(int(rng.integers(0, 60)))}" for i in range(40)}
    rows |= {50: noise(55), 51: passages[3], 52: passages[3], 53: f"x{passages[2]}x"}
    raws = {i: t.encode() for i, t in rows.items()} | ({1000 + i: (t or "").encode() for i, t in texts.items()} if hot_rows > 2 else {})
    frame = spark.createDataFrame([(i, t.decode()) for i, t in raws.items()], "doc_id long, text string").repartition(5)
    want = brute_passages(raws)
    for r in suffix_dedup.repeated_spans(frame).collect():
        assert [[s["start"], s["stop"]] for s in r["passages"]] == want[r["id"]]
    assert want[1] and want[51] and not want[0] and not want[50]


def test_hot_cores_are_split(spark, monkeypatch):
    rng = np.random.default_rng(6)
    noise = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage = noise(1_000)
    rows = {i: noise(int(rng.integers(0, 300))) + passage[int(a) :] + noise(int(rng.integers(0, 300))) for i, a in enumerate(rng.integers(0, 500, 30))}
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(4)
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", 2)
    check_spans(frame, {i: t.encode() for i, t in rows.items()})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab\0", max_size=12), st.integers(0, 2)), min_size=1, max_size=40))
def test_deep_shallow_sorts(pairs):
    strings, group = [s.encode() for s, _ in pairs], np.array([g for _, g in pairs])
    old, suffix_dedup.SHALLOW = suffix_dedup.SHALLOW, 8
    try:
        order, common = suffix_dedup.deep_shallow(strings, group)
    finally:
        suffix_dedup.SHALLOW = old
    assert sorted(order.tolist()) == list(range(len(pairs)))
    for p in range(1, len(pairs)):
        a, b = order[p - 1], order[p]
        if group[a] == group[b]:
            assert common[p] == suffix_dedup._common(strings[a], strings[b])
        else:
            assert group[a] < group[b]


def test_repeats_odd_rows(odd, none):
    rows = suffix_dedup.repeated_spans(odd).collect()
    assert len(rows) == odd.count() and suffix_dedup.repeated_spans(none).collect() == []
    by = {r["id"]: r for r in rows}
    assert by[1]["n_bytes"] == 0 and by[1]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[5]["n_removed"] == 0 and by[7]["n_removed"] == by[7]["n_bytes"] and by[7]["n_spans"] == 1


def test_exact_query_agrees_with_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(map(str, con.sql(queries.OP7_SQL).fetchall()))
    got = queries.op7_exact_dedup(spark, sf)
    assert sorted(str(tuple(r)) for r in got.collect()) == want and lower_ascii is not None
