import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from softseg.llm import packing, queries, syncmers, token_tree, warc
from softseg.llm.store import new_path
from softseg.llm.tokens import token_ids


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def ids(text):
    return np.frombuffer(token_ids(text), "<u4").tolist()


def test_ids_are_the_vocabularys(reference, texts):
    odd = ["<|endoftext|> hi", "a <|endoftext|><|endoftext|>b", "<|endoftext|", " <|endoftext|> ", "", None, "\x00\x01 é 日本語   \n\n  x's 'LL  ", "a　 b", " a ", "x\n \n y", "1²③ ½x"]
    for t in [*odd, *list(texts.values())[:60]]:
        assert ids(t) == reference(t)


def check_pieces(rows, texts):
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(docs) == set(texts)
    for i, pieces in docs.items():
        want, at = np.array(ids(texts[i]) + [0], "<u4"), 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(want) and p["ids_crc32"] == zlib.crc32(want[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(want)
    for pieces in sequences.values():
        at = 0
        for n, p in enumerate(sorted(pieces, key=lambda p: p["offset"])):
            assert (p["offset"], p["segment"]) == (at, n)
            at += p["length"]
        assert at <= packing.TOKENS and len(pieces) <= packing.SEGMENTS
    return [sum(p["length"] for p in s) for s in sequences.values()]


def test_packing_of_documents(documents, texts):
    lengths = check_pieces(packing.pack(documents).collect(), texts)
    padding = sum(0 if n & (n - 1) == 0 else packing.TOKENS - n for n in lengths)
    assert padding <= 0.01 * sum(lengths)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 90), st.integers(0, 100)), max_size=60), st.integers(1, 6), st.integers(1, 20))
def test_packer_limits(docs, segments, loss):
    packer = packing.Packer(32, segments, loss, pool=8)
    rng, out = random.Random(1), []
    raws = [np.arange(n, dtype="<u4").tobytes() for n, _ in docs]
    for i, (n, share) in enumerate(docs):
        out += packer.add(i, raws[i], bytes(int(rng.random() * 100 < share) for _ in range(n)))
    out += packer.finish()
    seen = defaultdict(list)
    for s in out:
        assert s and sum(map(len, s)) <= 32 and len(s) <= segments and sum(p.loss_tokens for p in s) <= loss
        for p in s:
            seen[p.doc].append(p)
    for i, raw in enumerate(raws):
        assert b"".join(p.ids for p in sorted(seen[i], key=lambda p: p.start)) == raw


def test_packing_odd_rows(odd, none):
    rows = packing.pack(odd).collect()
    assert packing.pack(none).collect() == []
    assert sum(1 for r in rows if r["start"] == 0) == odd.count()
    assert [(r["length"], r["doc_tokens"]) for r in rows if r["id"] == 1] == [(1, 1)]
    with_ids = packing.pack(odd.filter("doc_id = 4"), with_ids=True).collect()
    assert [x for r in sorted(with_ids, key=lambda r: r["start"]) for x in r["ids"]] == [*ids("one"), 0]
    with pytest.raises(ValueError):
        packing.Packer(1000)


def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(3)
    big = "".join(rng.choice("abcé\n") for _ in range(9_000))
    rows = [(1, "http://a/ b", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (5, "u", big), (6, "u", big), (7, "u", "WARC/1.1\r\n\r\n"), (7, "u", "WARC/1.1\r\n\r\n"), (8, "u", "é"), (None, "u", "é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record", F.lit("own")).repartition(3)
    path = new_path(spark, "warc")
    warc.write_archives(pages, path, chunk=1_000)
    table = spark.read.parquet(path)
    assert table.agg(F.max(F.octet_length("data"))).first()[0] < 2_500 and table.filter("chunks > 5").select("record").distinct().count() == 1
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows)
    first = {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 8: 8, None: 8}
    html = {i: (h or "").encode() for i, _, h in rows}
    for r in got:
        body = html[r["id"]]
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r["refers_to"] == (first[r["id"]] if r["record_type"] == "revisit" else None)
    assert sum(r["record_type"] == "response" for r in got) == 5 and [r["url"] for r in got if r["id"] in (1, 2)].count(None) == 1
    small = new_path(spark, "warc")
    warc.write_archives(pages, small, min_revisit=2)
    assert sum(r["record_type"] == "response" for r in warc.read_archives(spark, small).collect()) == 7
    none = new_path(spark, "warc")
    warc.write_archives(pages.limit(0), none)
    assert warc.read_archives(spark, none).collect() == []


def test_damage_is_found(spark):
    path, bad = new_path(spark, "warc"), new_path(spark, "warc")
    warc.write_archives(spark.createDataFrame([(1, "u", "hello")], "page_id long, url string, html string"), path)
    spark.read.parquet(path).withColumn("data", F.expr("cast(replace(cast(data as string), 'hello', 'jello') as binary)")).write.parquet(bad)
    with pytest.raises(Exception, match="digest"):
        warc.read_archives(spark, bad).collect()


def test_archive_query_agrees_with_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    got = queries.op5_warc(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, con.sql(queries.OP5_SQL).fetchall()))


def count(s):
    return len(ids(s))


def replaced(text, start, deleted, inserted):
    start = min(max(start, 0), len(text))
    return text[:start] + inserted + text[start + max(deleted, 0) :]


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.sampled_from(["a", "b ", "  ", "\n", "'s", "1", "é", "語", "!!", "<|endoftext|>", "<|endof", "text|>", "the x " * 90]), max_size=60).map("".join),
    st.lists(st.tuples(st.integers(0, 1400), st.integers(0, 200), st.text("ab \n's<|", max_size=12)), max_size=6),
)
def test_trees_follow_edits(text, edits):
    tree = token_tree.TokenTree(text)
    for e in edits:
        tree.edit(*e)
        text = replaced(text, *e)
        assert tree.text == text and tree.chars == len(text) and tree.tokens == count(text)
        sizes = token_tree.sizes_of(text)
        assert tree.leaves == (sizes, token_tree.counts_of(text, sizes))


def test_leaves_are_pretokens():
    text = "it's 12 words,  here<|endoftext|> é\n"
    sizes = token_tree.sizes_of(text)
    ends = np.cumsum(sizes)
    pieces = [text[e - n : e] for n, e in zip(sizes, ends)]
    assert pieces == ["it", "'s", " 12", " words", ",", " ", " here", "<|endoftext|>", " é", "\n"]
    assert token_tree.counts_of(text, sizes) == [count(p) for p in pieces]


def height_fits(node):
    return node.left is None or (abs(node.left.height - node.right.height) <= 1 and height_fits(node.left) and height_fits(node.right))


def test_edits_reencode_little(texts):
    """Of a text of some million characters, and of one that has no spaces."""
    rng = np.random.default_rng(6)
    for text in (" ".join(texts.values()), "aGk3+b/9" * 5_000):
        tree = token_tree.TokenTree(text)
        for _ in range(40):
            before, at = tree.encoded, int(rng.integers(len(text)))
            tree.edit(at, 5, "x, new words")
            text = replaced(text, at, 5, "x, new words")
            assert tree.encoded - before < 1_000
        assert tree.tokens == count(text) and height_fits(tree.root)


def test_stored_leaves_serve_later_edits(spark, documents, texts):
    edits = F.array(F.struct(F.lit(7).alias("start"), F.lit(3).alias("deleted"), F.lit("new ").alias("inserted")))
    stored = token_tree.token_leaves(documents)
    first = token_tree.edit_leaves(stored, edits)
    again = token_tree.edit_leaves(first.select("id", "text", "sizes", "counts"), edits).collect()
    assert len(again) == len(texts)
    for r in again:
        once = replaced(texts[r["id"]] or "", 7, 3, "new ")
        twice = replaced(once, 7, 3, "new ")
        assert (r["text"], r["n_tokens"], r["edited_tokens"]) == (twice, count(once), count(twice))
        assert r["sizes"] == token_tree.sizes_of(twice) and sum(r["counts"]) == r["edited_tokens"] and r["reencoded_chars"] <= len(twice) + 30


def test_edit_query(spark, sf, texts):
    def edited(t):
        n = len(t)
        for e in ((n // 4, 0, t[:40]), (n // 2, 25, t[:16][::-1]), (3 * n // 4, 60, "")):
            t = replaced(t, *e)
        return t

    for r in queries.op6_token_edits(spark, sf).collect():
        t = texts[r["doc_id"]]
        assert (r["n_tokens"], r["edited_tokens"], r["edited_chars"]) == (count(t), count(edited(t)), len(edited(t)))


def test_edits_odd_rows(odd, none):
    edits = F.array(F.struct(F.lit(2).alias("start"), F.lit(None).cast("int").alias("deleted"), F.lit("XY ").alias("inserted")), F.lit(None).cast("struct<start:int,deleted:int,inserted:string>"))
    rows = {r["id"]: r for r in token_tree.count_edits(odd, edits).collect()}
    assert rows[1]["edited_tokens"] == count("XY ") and rows[4]["edited_tokens"] == count("onXY e")
    assert token_tree.count_edits(none, edits).collect() == []
    assert all(r["n_tokens"] == r["edited_tokens"] for r in token_tree.count_edits(odd, F.lit(None)).collect())
    assert token_tree.token_leaves(none).collect() == [] and token_tree.token_leaves(odd).count() == odd.count()


def brute_anchors(text):
    """(position, hash) of every closed syncmer, from the definition."""
    h = lambda part: int(np.uint64(xxhash.xxh64_intdigest(part.encode("utf-32-be"), 42)).astype(np.int64))
    if len(text) < syncmers.K:
        return [(0, h(text) & 0xFFFFFFFF)] if text else []
    inner = [h(text[i : i + syncmers.INNER]) for i in range(len(text) - syncmers.INNER + 1)]
    found = []
    for i in range(len(text) - syncmers.K + 1):
        own = inner[i : i + syncmers.PLACES]
        if min(own) in (own[0], own[-1]):
            found.append((i, h(text[i : i + syncmers.K]) & 0xFFFFFFFF))
    return found


def brute_likeness(a, b):
    x, y = {h for _, h in a}, {h for _, h in b}
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0


ODD_TEXTS = ["", "a", "x" * 31, "x" * 32, "y" * 500, "東京都" * 40, "\U0001f600é" * 33, "one two three " * 9]


def test_syncmers_by_definition(spark, texts, monkeypatch):
    monkeypatch.setattr(syncmers, "BLOCK", 50)
    data = dict(enumerate([*ODD_TEXTS, *sorted(texts.values(), key=len)[50:70]]))
    rows = spark.createDataFrame(list(data.items()), "doc_id long, text string")
    for r in syncmers.anchors(rows).collect():
        assert [(a["pos"], a["hash"]) for a in r["anchors"]] == brute_anchors(data[r["id"]])


def test_fingerprints_and_likeness_by_definition(spark, texts):
    data = [(f"doc-{i:03}", t) for i, t in enumerate([*ODD_TEXTS, *sorted(texts.values(), key=len)[50:70]])]
    got = {r["id"]: r for r in syncmers.fingerprint_edits(spark.createDataFrame(data, "doc_id string, text string")).collect()}
    as_text = lambda anchors: "".join(f"{p:08x}{h:08x}" for p, h in anchors)
    order = sorted(data, reverse=True)
    assert len(got) == len(order)
    for n, (i, a) in enumerate(order):
        b = order[(n + 1) % len(order)][1]
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        own, other, nxt = brute_anchors(a), brute_anchors(edited), brute_anchors(b)
        r = got[i]
        assert (r["edited"], r["fingerprint"], r["edited_fingerprint"]) == (edited, as_text(own), as_text(other))
        assert r["near_edited"] == pytest.approx(brute_likeness(own, other)) and r["near_next"] == pytest.approx(brute_likeness(own, nxt))


def test_a_letter_before_a_text_without_spaces(spark):
    rng = random.Random(5)
    text = "".join(chr(0x4E00 + rng.randrange(3_000)) for _ in range(4_000))
    r = syncmers.fingerprint_edits(spark.createDataFrame([(2, "x" + text), (1, text)], "doc_id long, text string")).first()
    assert r["near_next"] > 0.98


def test_edited_fingerprints(spark, sf, texts):
    order = sorted(texts, reverse=True)
    rows = {r["doc_id"]: r for r in queries.op8_syncmers(spark, sf).collect()}
    assert set(rows) == set(order)
    near = []
    for n, i in enumerate(order):
        a, b = texts[i], texts[order[(n + 1) % len(order)]]
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        assert rows[i]["n_chars"] == len(a) and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        nxt = rows[order[(n + 1) % len(order)]]
        assert (rows[i]["fingerprint"] == nxt["fingerprint"]) <= (rows[i]["near_next"] == 1.0)
        near.append((rows[i]["near_edited"], rows[i]["near_next"]))
    assert 0.35 < np.mean([a for a, _ in near]) < 0.65 and np.mean([b for _, b in near]) < 0.1


def test_next_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "BUCKET_BYTES", 9)
    data = [(i * 7 % 101, f"t{i}") for i in range(60)]
    rows = spark.createDataFrame(data, "id long, text string").withColumn("digest", F.unhex(F.md5("text"))).repartition(5)
    found = syncmers.with_next(rows, {"n": F.length("text")}).collect()
    assert all(r["next_n"] == len(r["next_text"]) for r in found)
    got = {r["id"]: r["next_text"] for r in found}
    order = sorted(data, reverse=True)
    assert got == {i: order[(n + 1) % len(order)][1] for n, (i, _) in enumerate(order)}


def test_syncmers_odd_rows(odd, none):
    rows = syncmers.fingerprint_edits(odd).collect()
    assert len(rows) == odd.count() and syncmers.fingerprint_edits(none).collect() == []
    by = {r["id"]: r for r in rows}
    assert by[1]["fingerprint"] == "" and by[1]["near_edited"] == 1.0 and by[2]["n_chars"] == 0
    same = [r for r in rows if r["id"] == 5]
    assert same[0]["fingerprint"] == same[1]["fingerprint"]
    alone = syncmers.fingerprint_edits(odd.filter("doc_id = 9 and text like 'z%'")).first()
    assert alone["near_next"] == 1.0


def test_long_texts_keep_all_their_anchors(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(100_000)}" for _ in range(6_000)]
    rows = [(n, " ".join([*words[: 100 * n], *(f"x{i}" for i in range(20)), *words[100 * n + 20 :]])) for n in range(1, 6)] + [(9, " ".join(words))]
    found = {r["id"]: r for r in syncmers.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len({r["fingerprint"] for r in found.values()}) == 6
    assert all(0.98 < found[i]["near_next"] < 1.0 for i in found)
    assert all(len(r["fingerprint"]) > 16 * 2_000 for r in found.values())
