import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from softseg.llm import queries, sanitise
from softseg.llm.bitmaps import bitmap_of

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def counts(kind, match):
    d = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return 16 <= len(d) <= 19 and sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0
    return 8 <= len(d) <= 15 if kind == "phone" else True


def brute_base(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if counts(k, m.group())]


def base_of(frame):
    return [[tuple(s) for s in r["base"]] for r in frame.collect()]


def test_base_spans_of_documents(spark, sf, texts):
    for r in queries.op11_sanitise(spark, sf).collect():
        want = brute_base(texts[r["doc_id"]])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest() and r["spans"].startswith(listed)
        assert [r[f"n_{k}"] for k in BASE] == [sum(s[0] == k for s in want) for k in BASE]
        assert r["n_terms"] == len([s for s in r["spans"].split(",") if s.startswith("term:")])


def test_base_spans_of_odd_strings(spark):
    draw = random.Random(3)
    parts = ["a", "9", "1", "0", "00", "255", "256", ".", "-", " ", "@", "+", "(", ")", "_", "é", "\U0001f600", "4111111111111111", "%", "b.c", "@d.e", "12"]
    made = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 40))) for _ in range(1500)]
    made += ["a" * 100_000, "1" * 100_000, "a@b" + ".c" * 30_000, "+1" + " " * 50_000, "1." * 30_000, " x@y.z 10.0.0.1" * 3_000]
    rows = sanitise.find_personal(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(8)).collect()
    for r in rows:
        text = made[r["id"]]
        if len(text) < 20_000 or not re.fullmatch(r"[a1]+", text):  # a plain engine takes quadratic time on those
            assert [tuple(s) for s in r["base"]] == brute_base(text)
        else:
            assert r["base"] == []


FILL = "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore magna aliqua".split()


def corpus():
    """A person whose surname stands near one address only, and fillers that stand everywhere."""
    draw = random.Random(1)
    fill = lambda n: " ".join(draw.choices(FILL, k=n))
    texts = [fill(40) for _ in range(300)]
    for i in range(5):
        texts.append(f"{fill(10)} {FILL[i]} Quillon {FILL[i + 1]} writes j.q@mail.example.org {fill(10)}")
    texts.append(f"Quillon, without an address. {fill(5)}")
    texts += [f"{fill(6)} u{i}@mail.example.org {fill(6)} Hapaxname{i}" for i in range(20)]
    return list(enumerate(texts))


def brute_terms(rows):
    """Terms that disclose an entity, by the formula."""
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    short = lambda w: w[:3] + "*"
    n, df, both, beside, entity = len(rows), Counter(), defaultdict(set), defaultdict(set), defaultdict(set)
    for i, t in rows:
        w = words(t)
        df.update({x for x in w if len(x) >= 4} | {short(x) for x in w if len(x) >= 4} | {f"{a} {b}" for a, b in zip(w, w[1:])})
        for m in re.finditer(BASE["email"], t):
            entity[m.group()].add(i)
            for c in (t[: m.start()], t[m.end() :]):  # shorter than the reach
                w = words(c)
                at = lambda j: w[j] if 0 <= j < len(w) else ""  # noqa: E731, B023
                for j, x in enumerate(w):
                    for term, width in [(x, 1), (short(x), 1)] * (len(x) >= 4) + [(f"{x} {at(j + 1)}", 2)] * (j + 1 < len(w)):
                        both[m.group(), term].add(i)
                        beside[m.group(), term, i].add((at(j - 1), at(j + width)))
    out = {}
    for (e, t), docs in both.items():
        mentions = len({min(beside[e, t, i]) for i in docs})
        pmi = math.log2(mentions * n / (len(entity[e]) * df[t]))
        content = math.log2(n / len(entity[e]))
        if mentions >= 3 and pmi >= 4 and pmi >= content - 1 and content >= 4:
            out[t] = max(out.get(t, 0), pmi)
    return out


def test_disclosing_terms_by_formula(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["term"]: (r["bits"], r["generalise"]) for r in sanitise.disclosing_terms(docs, sanitise.scan(docs)).collect()}
    want = {t: b for t, b in brute_terms(rows).items() if not t.endswith("*")}
    assert set(got) == set(want) and "quillon" in got and not any(w in got for w in FILL)
    assert {t: b for t, (b, _) in got.items()} == pytest.approx(want)
    # "qui*" discloses as much as the name, so the name is removed and not generalised.
    assert got["quillon"][1] is False


def test_terms_are_marked_wherever_they_stand_and_leave_the_text(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r["id"]: r for r in sanitise.find_personal(docs).collect()}
    clean = {r["doc_id"]: r["text"] for r in sanitise.sanitise(docs).collect()}
    assert len(found) == len(clean) == len(rows)
    for i, t in rows:
        marked = {t[s["start"] : s["end"]] for s in found[i]["terms"]}
        assert ("Quillon" in marked) == ("Quillon" in t) and not marked & set(FILL)
        assert "Quillon" not in clean[i] and "@" not in clean[i] and clean[i].count("[email]") == t.count("@")
        if "Quillon" not in t and "@" not in t:
            assert clean[i] == t


def test_terms_are_generalised_where_their_class_discloses_nothing(spark):
    rows = corpus() + [(1000 + i, f"quick quiet quite quilt {FILL[i % 9]}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["term"]: r["generalise"] for r in sanitise.disclosing_terms(docs, sanitise.scan(docs)).collect()}
    assert got["quillon"] is True
    clean = {r["doc_id"]: r["text"] for r in sanitise.sanitise(docs).collect()}
    assert "Qui*, without an address" in clean[305]


def test_copies_are_one_piece_of_evidence(spark):
    """A hundred copies of a text with an address disclose none of its rare words."""
    text = f"{' '.join(FILL)} Rareword and Otherword j.q@mail.example.org Thirdword {' '.join(FILL)}"
    rows = [(i, text) for i in range(100)] + [(100 + i, " ".join(FILL)) for i in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = sanitise.find_personal(docs).collect()
    assert len(found) == 3_100 and not any(r["terms"] for r in found) and sum(len(r["base"]) for r in found) == 100


def test_odd_rows(odd, none):
    rows = sanitise.find_personal(odd).collect()
    assert len(rows) == odd.count() and all(r["base"] == [] and r["terms"] == [] for r in rows)
    assert sanitise.find_personal(none).collect() == [] and sanitise.sanitise(none).collect() == []
    kept = sanitise.sanitise(odd)
    assert kept.columns == odd.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, odd.collect()))


def test_repeated_rows_share_spans(spark):
    rows = corpus() + [(None, "Quillon again"), (None, "Quillon again"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [r for r in sanitise.find_personal(docs).collect() if r["id"] is None]
    assert len(got) == 2 and all([(s["start"], s["end"]) for s in r["terms"]] == [(0, 7)] for r in got)


def test_sums_before(spark):
    numbers = [random.Random(2).randint(0, 9) for _ in range(1_000)]
    for n in (0, 1, 255, 256, 257, 1_000):
        frame = spark.createDataFrame([(numbers[:n],)], "a array<int>")
        assert frame.select(sanitise.sums_before(frame["a"])).first()[0] == [sum(numbers[:i]) for i in range(n)]


def test_bitmap_passes_all_keys_and_few_others(spark):
    rows = spark.range(20_000).selectExpr("xxhash64(id) as k", "id")
    held = bitmap_of(rows.filter("id % 10 = 0").select("k"), "k").passed(rows, "k")
    got = {r["id"] for r in held.collect()}
    assert {i for i in range(0, 20_000, 10)} <= got and len(got) < 2_000 + 2_500
