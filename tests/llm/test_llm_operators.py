"""The corpus operators against brute force, on a table of hard cases and on the smallest driver table."""

from __future__ import annotations

import os
import random
import sys
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute

from keyloom.llm import components, contamination, jaccard, kernels, lines, packing, quality, registry, sharding, substrings, suffixes, urls, warc

DATA = "/root/testdata/sf0.001"
#: Columns that clash with those the operators make.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, n_lines long, spans string, component_id long, `size` long, bucket long"


def hard_cases():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgé", k=rng.randint(1, 9)))
    sentence = lambda n: " ".join(word() for _ in range(n))
    passage, lines_ = sentence(70), [sentence(6) for _ in range(4)]
    base = sentence(120).split()
    docs = [
        (1, None), (2, ""), (3, "   \t\n"), (4, "one"), (5, "One two"), (6, "x" * 60), (7, "x" * 200), (8, "ab" * 80), (None, passage), (None, None),
    ]
    docs += [(10, passage + " tail"), (11, "head " + passage), (12, passage), (12, passage), (9, sentence(30) + " " + passage + " " + sentence(30))]
    docs += [(20 + i, "\n".join([sentence(4), *lines_, sentence(3)])) for i in range(3)]
    for i in range(40):
        near = list(base)
        for _ in range(i // 8):
            near[rng.randrange(len(near))] = word()
        docs.append((100 + i, " ".join(near)))
    docs += [
        (200, " ".join(["again and again"] * 40)), (201, "\n\n\n\n\n"), (202, "\n".join(["same line"] * 9)), (203, "é" * 100 + " " + "ü" * 40),
        (204, sentence(20_000)), (205, "Ends. Here! Now? " * 50), (2**40, passage),
    ]
    docs += [(300 + i, " ".join(sentence(12) for _ in range(i))) for i in range(12)]
    return docs


@pytest.fixture(scope="module")
def cases():
    return hard_cases()


@pytest.fixture(scope="module")
def docs(spark, cases):
    rows = [(d, t, "en", None, None, 7, 8, "s", 9, 10, 11) for d, t in cases]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


JOINS = [
    jaccard.Join(),
    jaccard.Join(shingle=5, percent=80),
    # families dealt to tiles, with and without a count of links
    jaccard.Join(shingle=2, percent=70, tile=200),
    jaccard.Join(shingle=2, percent=70, tile=200, count_links=False),
    jaccard.Join(count_links=False, most_bits=12, leaf=4, groups=32),
]


@pytest.mark.parametrize("join", JOINS)
def test_jaccard(docs, cases, none, join):
    got = jaccard.near_duplicates(docs, join)
    want = brute.op1(cases, join.shingle, join.percent)
    if join.count_links:
        assert rows(got, "doc_id", "n_shingles", "component_id", "n_links") == want
    else:
        assert rows(got, "doc_id", "n_shingles", "component_id") == sorted((r[:3] for r in want), key=str)
    assert jaccard.near_duplicates(none, join).count() == 0


def test_tree_discards_what_cannot_link():
    """Of members of two far groups a query reaches its own group alone, and all that link."""
    rng = np.random.default_rng(5)
    base = [rng.integers(0, 2**63, 120, dtype=np.uint64) for _ in range(2)]
    sets = [np.unique(np.concatenate((b[rng.permutation(120)[:114]], rng.integers(0, 2**63, 6, dtype=np.uint64)))) for b in base for _ in range(100)]
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    one = np.concatenate(sets)
    join = jaccard.Join(percent=80)
    members = jaccard.Members(one, one, bounds, join)
    for x in range(0, 200, 7):
        near = set(members.tree.query(members.points[x], len(sets[x]), join).tolist())
        linked = {y for y in range(200) if 100 * (i := len(np.intersect1d(sets[x], sets[y]))) >= 80 * (len(sets[x]) + len(sets[y]) - i)}
        assert linked <= near and {y // 100 for y in near} == {x // 100}


def test_near_copies_leave_one_row_a_class(spark):
    """A group of near copies around the threshold: rows between the steps stay in proportion."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(400):
        t = list(base)
        for _ in range(i % 6):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        texts.append((i, " ".join(t)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for count in (True, False):
        join = jaccard.Join(shingle=3, percent=90, count_links=count)
        _, found = jaccard.links(docs, join)
        assert found.count() <= 400
        got = jaccard.near_duplicates(docs, join)
        want = brute.op1(texts, 3, 90)
        assert rows(got, "doc_id", "n_shingles", "component_id", *(["n_links"] if count else [])) == sorted(
            (r[: 4 if count else 3] for r in want), key=str,
        )


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


A, B = thue_morse(2048), thue_morse(2048).translate(str.maketrans("ab", "ba"))


def test_strings_built_to_collide(spark):
    """Words, lines and passages that agree modulo 2**64 under any odd base."""
    docs = spark.createDataFrame([(1, f"x y {A}"), (2, f"x y {B}")], "doc_id long, text string")
    assert rows(jaccard.near_duplicates(docs), "doc_id", "component_id", "class_id") == [(1, 1, 1), (2, 2, 2)]
    assert {r["n_dup_lines"] for r in quality.quality(spark.createDataFrame([(1, f"{A}\n{B}")], "doc_id long, text string")).collect()} == {0}
    words = [f"w{i}" for i in range(60)]
    passages = [(i, " ".join([*words[:30], x, *words[30:]])) for i, x in enumerate((A, B))]
    got = substrings.without_passages(spark.createDataFrame(passages, "doc_id long, text string"))
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute.op9(passages)
    packed = [(0, f"x {A} {B}")]
    from tokenizers import Tokenizer
    import public_tokenizers

    ids = [
        t for r in sorted(
            packing.pack(spark.createDataFrame(packed, "doc_id long, text string")).collect(), key=lambda r: r["start"],
        ) for t in r["ids"]
    ]
    assert ids == [*Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(packed[0][1], add_special_tokens=False).ids, 0]


def test_quality(docs, cases, none):
    got = quality.quality(docs)
    assert rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == brute.op3(cases)
    assert got.filter("base_failed and kept").count() == 0
    assert quality.quality(none).count() == 0
    assert quality.kept_rows(docs).columns == docs.columns


def test_fertility_by_plain_encoding(docs, cases):
    import math
    from collections import Counter

    import sentencepiece

    rules = quality.Rules()
    sp = sentencepiece.SentencePieceProcessor(model_file=rules.vocabulary)
    got = {(r["doc_id"], r["n_words"]): r for r in quality.quality(docs).collect()}
    for d, t in cases:
        words = brute.SPACED.findall(t or "")
        ids = [i for w in words for i in sp.encode(w)]
        r = got[d, len(words)]
        assert r["n_tokens"] == len(ids) and r["n_byte_tokens"] == sum(sp.is_byte(i) for i in ids)
        if ids:
            h = -sum(n / len(ids) * math.log2(n / len(ids)) for n in Counter(ids).values())
            assert r["entropy_bits"] == pytest.approx(max(h, 0), abs=1e-9)


def test_verdicts_by_plain_statement(spark, cases):
    """Scripts, bands and reasons against a text-by-text statement, on hard cases and texts that some band rejects."""
    import sentencepiece

    rules = quality.Rules()
    sp = sentencepiece.SentencePieceProcessor(model_file=rules.vocabulary)
    rng = random.Random(8)
    blob = " ".join("".join(rng.choices("ABCDEFabcdef0123456789+/", k=60)) for _ in range(60))
    texts = [(d, t, ("en", "de", None, "xx")[i % 4]) for i, (d, t) in enumerate(cases)]
    texts += [
        (1000, blob, "en"), (1001, " ".join(f"a{i % 3}" for i in range(400)), "fr"), (1002, " ".join(rng.choices("αβγδε ζηθικ", k=900)), None),
        (1003, "漢字かな交じり文 " * 30, "ja"), (1004, "“quoted” – text… " * 40, None), (1005, "😀 😀😀 " * 40, None), (1006, "Привет мир " * 15, "ru"),
        (1007, "𐌰𐌱𐌲 " * 30, None),
    ]
    if os.path.isdir(DATA):
        texts += [(r["doc_id"] + 10_000, r["text"], r["lang"]) for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()]
    got = quality.quality(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    want = brute.quality(texts, rules, sp)
    assert rows(got, "doc_id", "script", "reason", "kept") == want
    assert {r[2] for r in want} >= {"", "base", "entropy", "fertility"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_bands_reject_junk_and_no_good_text(spark):
    fitted = "/root/testdata/sf0.1"
    read = lambda t: spark.read.parquet(f"{fitted}/{t}.parquet")
    assert quality.fit(read("documents"), read("labels")) == quality.LANGUAGE_BANDS
    judged = quality.quality(read("documents")).join(read("labels"), "doc_id").filter("not base_failed")
    beyond = {
        r["quality"]: (r["rejected"], r["n"]) for r in judged.groupBy("quality").agg(
            F.sum((~F.col("kept")).cast("int")).alias("rejected"), F.count("*").alias("n"),
        ).collect()
    }
    assert beyond[1][0] == 0 and 10 * beyond[0][0] > 8 * beyond[0][1]
    # an unknown language has its script's wide band
    other = quality.quality(read("documents").withColumn("lang", F.lit("xx")))
    assert other.filter("not kept and not base_failed").count() == 0
    assert quality.quality(read("documents").drop("lang")).filter("not kept and not base_failed").count() == 0


def test_suffixes(docs, cases, none):
    got = suffixes.without_substrings(docs)
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.op4(cases)
    assert suffixes.without_substrings(none).count() == 0


def test_longest_previous_factors_agree_with_the_segments():
    rng = random.Random(2)
    texts = [bytes(rng.choices(b"ab", k=rng.randint(0, 30))) for _ in range(8)]
    ids = [3, 1, 4, 1, 5, 9, 2, 6]
    whole = suffixes.longest_previous_factors(texts, ids)
    buffer = np.frombuffer(b"".join(t + bytes([255]) * 16 for t in texts), np.uint8)
    at, starts, docs, want = 0, [], [], []
    for t, d, f in zip(texts, ids, whole):
        for i in range(len(t) - 8 + 1):
            starts.append(at + i)
            docs.append(d)
            want.append(f[i] >= 8)
        at += len(t) + 16
    got = suffixes.has_previous_factor(buffer, np.array(starts), np.array(docs), 8)
    assert got.tolist() == want


def test_lines(docs, cases, none):
    got = lines.without_repeated_lines(docs)
    assert got.columns == [*docs.columns, "n_lines_", "n_lines_removed"] and got.filter("n_lines <> 8").count() == 0
    assert rows(got.withColumn("sha", F.sha2(F.encode("text", "UTF-8"), 256)), "doc_id", "n_lines_", "n_lines_removed", "sha") == brute.op5(cases)
    assert lines.without_repeated_lines(docs, counts=False).columns == docs.columns
    assert lines.without_repeated_lines(none).count() == 0


def test_packing(docs, cases, none):
    from tokenizers import Tokenizer
    import public_tokenizers

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    pieces = [r.asDict() for r in packing.pack(docs).collect()]
    want = sorted(tuple([*plain.encode(t or "", add_special_tokens=False).ids, 0]) for _, t in cases)
    by_doc, sequences = {}, {}
    for p in pieces:
        assert p["length"] == len(p["ids"]) and p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
        sequences.setdefault(p["sequence_id"], []).append(p)
    got, open_doc = [], []
    for s in sorted(sequences):
        at = 0
        for p in sorted(sequences[s], key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
            if p["start"] == 0:
                open_doc = []
            assert p["start"] == len(open_doc)
            open_doc = open_doc + p["ids"]
            if len(open_doc) == p["doc_tokens"]:
                got.append(tuple(open_doc))
        assert 0 < at <= 1024
    assert sorted(got) == want and not by_doc
    assert packing.pack(none).count() == 0


def test_packing_ids_with_added_tokens(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    contract = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [
        f"hi {end} there", end, f"{end}{end}", f"a{end}b", f"a  {end}  b", f"x\n\n{end}\n\ny. {end}", f"\t{end}\t z {end}é",
        "<|endof text|> <|endoftext|", f"\u3000{end}\u3000 q", f" {end}" * 400, f"<{end}>", f"<|endoftext{end}",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in packing.pack(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    for i, t in enumerate(texts):
        assert [x for _, ids in sorted(got[i]) for x in ids] == [*contract.encode(t, add_special_tokens=False).ids, 0], t


def test_cuts_are_optimal():
    rng = random.Random(4)
    p = packing.Packer(length=16, stride=5, stride_penalty=4)
    for _ in range(30):
        n = rng.randint(1, 60)
        ends = np.array(sorted(rng.sample(range(1, n + 1), min(n, 3))))
        marks = np.array(sorted(rng.sample(range(1, n + 1), min(n, 5))))
        penalty = {x: p.stride_penalty for x in [*range(p.stride, n + 1, p.stride), n]} | {
            int(x): p.sentence_penalty for x in marks
        } | {int(x): 0 for x in ends} | {0: 0}
        best = {0: 0}
        for j in sorted(penalty):
            if j:
                best[j] = min(best[i] + p.length - (j - i) + penalty[j] for i in best if i < j and j - i <= p.length)
        got = [0, *packing.cuts(n, ends, marks, p).tolist()]
        assert sum(p.length - (b - a) + penalty[b] for a, b in zip(got, got[1:])) == best[n]


def test_contamination(spark, docs, cases, none):
    items = [
        (1, " ".join(cases[8][1].split()[5:25])), (2, "One two"), (3, None), (4, ""), (5, "one two three four five six seven eight nine ten eleven"),
        (2, "One two"), (6, "again and again and again"),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = brute.op7(cases, items)
    for rules in (contamination.Windows(), contamination.Windows(block_windows=3)):
        got = contamination.digest(contamination.matches(docs, benchmark, rules))
        assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
        clean = contamination.clean_rows(docs, benchmark, rules)
        assert clean.count() == sum(not w[5] for w in want) and clean.columns == docs.columns
    empty = spark.createDataFrame([], "item_id long, text string")
    assert contamination.digest(contamination.matches(docs, empty)).filter("contaminated").count() == 0
    assert contamination.digest(contamination.matches(none, benchmark)).count() == 0


def test_items_without_id_contaminate(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"head {passage} tail"), (2, "clean text"), (3, "short item here")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, passage), (7, "short item"), (None, "short item"), (None, None)], "item_id long, text string")
    for rules in (contamination.Windows(), contamination.Windows(block_windows=1)):
        found = contamination.digest(contamination.matches(docs, benchmark, rules))
        assert rows(found, "doc_id", "n_hit", "n_items", "items_sha256", "contaminated") == [
            (1, 11, 0, brute.sha(b""), True), (2, 0, 0, brute.sha(b""), False), (3, 2, 1, brute.sha(b"7"), True),
        ]
        assert [r["doc_id"] for r in contamination.clean_rows(docs, benchmark, rules).collect()] == [2]


def test_sharding(docs, cases, none):
    got = sharding.shard(docs, [1.0] * 24)
    assert rows(got, "doc_id", "size", "text_crc32", "shard", "grown_shard") == brute.op8(cases)
    by_shard = {}
    for r in got.collect():
        by_shard.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert sharding.shard(none, [1.0] * 24).count() == 0


def test_weighted_shards(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    n = {r["shard"]: r["count"] for r in sharding.shard(ids, [1.0, 3.0], grown=None).groupBy("shard").count().collect()}
    assert 0.73 < n[1] / 20_000 < 0.77


def test_suffixes_in_several_passes(spark, docs):
    from keyloom.llm.repeats import Sketch

    rnd = np.random.default_rng(6)
    text = ["".join(chr(97 + c) for c in rnd.integers(0, 26, 400)) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(text)] + [(300 + i, t[:150]) for i, t in enumerate(text[:20])]
    some = spark.createDataFrame(rows, "doc_id long, text string")
    small = suffixes.Factors(sketch=Sketch(rows=2, most_bits=12))
    runs = [suffixes.candidates(some, f)[0].selectExpr("sum(length(many))").first()[0] for f in (suffixes.Factors(), small)]
    assert runs[1] < 2 * runs[0]  # one sketch of that size fills up and sends nearly all
    for df in (some, docs):
        got = [sorted(tuple(r) for r in suffixes.without_substrings(df, f).select("doc_id", "n_removed", "n_spans", "kept_sha256").na.fill(-1).collect()) for f in (None, small)]
        assert got[0] == got[1]


def test_substrings(docs, cases, none):
    got = substrings.without_passages(docs)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute.op9(cases)
    assert substrings.without_passages(none).count() == 0


def test_many_repeated_lines(spark):
    long = [(1, "\n".join(["one line", "two"] * 100_000)), (2, "one line\ntwo\none line\nnew")]
    got = lines.without_repeated_lines(spark.createDataFrame(long, "doc_id long, text string"))
    assert rows(got.withColumn("sha", F.sha2(F.encode("text", "UTF-8"), 256)), "doc_id", "n_lines", "n_lines_removed", "sha") == brute.op5(long)


def test_saturated_sketch_loses_nothing(docs, cases):
    from keyloom.llm.repeats import Sketch

    got = substrings.without_passages(docs, substrings.Passages(sketch=Sketch(rows=1, most_bits=12)))
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute.op9(cases)


def test_warc(spark, tmp_path):
    odd = "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nhello é"
    pages = [
        (1, "http://a.com/\r\nX: y", "<p>"), (2, None, "<p>"), (3, "u", None), (4, "u", ""), (5, "u", odd), (6, "u", odd), (7, "u", "x" * 3_000_000),
        (None, "v", "<p>"), (None, "v", "alone"), (8, "u", "twice"), (8, "u", "twice"), (8, "w", "twice"), (9, "u", "twice"),
    ]
    df = spark.createDataFrame([(*p, "extra", "d") for p in pages], "page_id long, url string, html string, record_type string, digest string")
    assert rows(warc.round_trip(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == brute.op10(pages)
    for mb in (0, 8):
        path = str(tmp_path / f"w{mb}")
        warc.write(df, path, warc.Archive(archive_mb=mb))
        found = warc.assemble(warc.read(spark, path)).collect()
        assert len({r["request"]["id"] for r in found}) == len({r["record_id"] for r in found}) == len(pages)
        held = sorted(r["response"]["block"].partition(b"\r\n\r\n")[2] for r in found if r["response"]["type"] == "response")
        assert held == sorted({(h or "").encode() for _, _, h in pages})
        archives = len([f for f in os.listdir(path) if f.startswith("part-")])
        assert archives == len(pages) if mb == 0 else archives < len(pages)
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_urls(spark):
    link = lambda u: f'<html><head><LINK href="{u}" rel="canonical"></head>'
    pages = [
        (1, "http://a.org/x", link("https://www.example.com/en/1")), (2, "http://b.org/y", link("http://a.org/x#f")), (3, "https://EXAMPLE.com/en/2", ""), (4, None, None), (5, "no scheme", "x"), (
            6, "http://c.org", link("http://s.net/fr/1"),
        ),
        (7, "http://d.org/p", '<meta http-equiv="refresh" content="0; url=/q">'), (8, "http://d.org/q", link("http://s.net/es/")), (9, "http://S.net/es/?q", None), (10, "http://b.com", None), (
            11, "http://e.org/", link("http://e.org/"),
        ),
    ]
    got = {
        r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"], r["decided_by"]) for r in urls.judge(
            spark.createDataFrame(pages, "page_id long, url string, html string"), registry.URL_RULES,
        ).collect()
    }
    assert got[1][2:] == (None, "allow", "alias") and got[2][2:] == (None, "allow", "alias")
    assert got[3] == ("example.com", "/en/2", "example.com/en/", "block", "rule")
    assert got[4] == ("", "", None, "allow", "default") == got[5]
    assert got[6] == ("c.org", "", None, "block", "alias") and got[7][3:] == got[8][3:] == ("block", "alias")
    assert got[9] == (
        "s.net", "/es/", "net/es/", "block", "rule",
    ) and got[10] == ("b.com", "", None, "allow", "default") and got[11][3:] == ("allow", "default")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string"), registry.URL_RULES).count() == 0


def test_url_targets_against_the_standard_library(spark):
    from html import unescape
    from urllib.parse import urldefrag, urljoin

    page = "http://h.org/a/b/c?q=1"
    hrefs = [
        "http://h/x?page=2&amp;ref=x", "d", "../d?x", "./", "..", "../../../e", "/f/../g", "?z=1&amp;y", "#top", "", "/r?u=http://k.org/",
        "//k.org/p", "&#x2f;n&#47;m", "a&amp;lt;b", "caf&eacute;", "&#x1F600;", "x&nope;y", "http://h.org/x#f",
    ]
    df = spark.createDataFrame([(i, page, h) for i, h in enumerate(hrefs)], "i long, url string, target string")
    got = {r["i"]: r["t"] for r in df.select("i", urls.resolved(F.col("url"), urls.unescaped(F.col("target"))).alias("t")).collect()}
    assert {h: urldefrag(got[i])[0] for i, h in enumerate(hrefs)} == {h: urldefrag(urljoin(page, unescape(h)))[0] for h in hrefs}


def test_blocks_reach_aliases_of_ordinary_html(spark):
    block = "http://s.net/es/"
    pages = [
        (1, "http://h.org/x?page=2&ref=x", f'<link rel="canonical" href="{block}1">'), (
            2, "http://i.org/y", '<link rel="canonical" href="http://h.org/x?page=2&amp;ref=x">',
        ),
        (3, "http://j.org/a/b", "<link rel='nofollow Canonical' href='c'>"), (
            4, "http://j.org/a/c", f'<link rel="canonical" href="{block}2">',
        ), (5, "http://j.org/c", None),
        (6, "http://k.org/a", f"<meta http-equiv=refresh content=\"0; URL='{block}3'\">"), (
            7, "http://l.org/a", '<link rel="canonical" data-href="http://s.net/es/" href="mailto:x">',
        ),
    ]
    got = {
        r["page_id"]: (r["verdict"], r["decided_by"]) for r in urls.judge(
            spark.createDataFrame(pages, "page_id long, url string, html string"), registry.URL_RULES,
        ).collect()
    }
    assert got == {i: ("block", "alias") for i in (1, 2, 3, 4, 6)} | {5: ("allow", "default"), 7: ("allow", "default")}


def web(n, seed):
    """Pages that name each other by ordinary and odd markup."""
    rng = random.Random(seed)
    hosts = ["a.org", "b.org", "www.example.com", "example.com", "s.net", "c.net"]
    address = lambda: f"http://{rng.choice(hosts)}{rng.choice(['/', '/en/', '/es/', '/fr/', '/x/y/'])}{rng.randrange(12)}{rng.choice(['', '', '?q=1&r=2'])}"
    target = lambda: rng.choice([address(), address().replace("&", "&amp;"), "/en/3", "../4", "5", "//c.net/es/6", "?q=1", "#top", "mailto:x@y"])
    pages = []
    for i in range(n):
        t = target()
        html = rng.choice([
            "", "<p>canonical refresh</p>", f'<link rel="canonical" href="{t}">', f"<LINK href='{t}' rel='alternate canonical'>", f'<!-- <link rel="canonical" href="http://s.net/es/1"> -->', f'<base href="http://b.org/en/z/"><link rel=canonical href="{t}">',
            f'<meta http-equiv="Refresh" content="0; url={t}">', f'<script>var x = \'<link rel="canonical" href="http://s.net/fr/9">\';</script>', f'<link rel="canonical" href="{t}"><link rel="canonical" href="{target()}">', f'<link rel="stylesheet" href="{t}">',
        ])
        pages.append((i, rng.choice([address(), address(), address(), None, "nothing"]), html))
    return pages


@pytest.mark.parametrize("seed", range(3))
def test_aliases_against_the_standard_library(spark, seed):
    pages = web(150, seed)
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), registry.URL_RULES)
    want = brute.urls(pages, registry.URL_RULES)
    assert rows(got, "page_id", "verdict", "decided_by") == want
    assert {r[2] for r in want} == {"rule", "alias", "default"}


def test_alias_sql(spark, tmp_path):
    """The SQL states the equivalence too, on pages without ``base`` elements and dot segments."""
    import duckdb

    pages = [p for p in web(300, 9) if "base" not in p[2] and "../" not in p[2]]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    df.write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages/*.parquet')")
    want = con.execute(registry.oracle_sql()["op2_url_filters"]).fetchall()
    got = urls.judge(df, registry.URL_RULES).select("page_id", "host", "path", "rule", "verdict", "decided_by").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and any(r[-1] == "alias" for r in want)


def test_components(spark):
    rng = random.Random(7)
    chain = [(i, i + 1) for i in range(60)]
    edges = chain + [
        (rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)
    ] + [(500, 500 + i) for i in range(50)] + [(1, None), (5, 5)]
    least = {}

    def root(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x

    for a, b in edges:
        if b is not None:
            x, y = sorted((root(a), root(b)))
            least[y] = x
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in least}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_previous_factors_by_hand():
    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 400):
        doc, common = rng.integers(0, 12, n), rng.integers(0, 6, n)
        common[0] = 0
        for least in (1, 3):
            want = []
            for i in range(n):
                best = 0
                for step in (-1, 1):
                    j, m = i, 9
                    while 0 <= j + step < n:
                        m = min(m, common[j] if step < 0 else common[j + 1])
                        j += step
                        if doc[j] < doc[i]:
                            best = max(best, m)
                            break
                want.append(best if best >= least else 0)
            assert suffixes.previous_factors(doc, common, least).tolist() == want


def test_words_equal_regular_expressions(cases):
    import pyarrow as pa

    column = pa.array([t for _, t in cases])
    for table, pattern, lower in ((kernels.SPACED, brute.SPACED, False), (kernels.ALNUM, brute.ALNUM, True)):
        got = []
        for chunk in kernels.chunks(column, 1000):
            w = kernels.Words(chunk, table, lower)
            raw = w.data.tobytes()
            got += [[raw[a:b].decode() for a, b in zip(w.start[x:y], w.end[x:y])] for x, y in zip(w.bounds[:-1], w.bounds[1:])]
        assert got == [pattern.findall(brute.low(t or "") if lower else t or "") for _, t in cases]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    df = registry.queries()[name](spark, DATA)
    cursor = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    want = sorted((tuple(r[columns.index(c)] for c in sorted(columns)) for r in cursor.fetchall()), key=str)
    assert rows(df, *sorted(df.columns)) == want and sorted(columns) == sorted(df.columns)


def test_pipeline_stages_on_hard_cases(spark, docs, none, cases, tmp_path):
    """Every stage by itself on nulls, ties, repeated rows, long texts and clashing columns, and on an empty table."""
    import corpus_pipeline as C

    items = [(1, "again and again again and again again and again"), (None, "One two"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clash = docs.withColumn("_row_key", F.lit("mine")).withColumn("N_LINES_REMOVED", F.lit(5)).withColumn("own", F.lit(1))
    stages = dict(C.STAGES)
    lang = [(d, t, "en") for d, t in cases]
    import sentencepiece

    rules = quality.Rules()
    good = {(r[0], i) for i, r in enumerate(brute.quality(lang, rules, sentencepiece.SentencePieceProcessor(model_file=rules.vocabulary))) if r[3]}
    want = {
        "quality_rules": sorted((str(d) for d, _ in good)),
        "line_dedup": sorted(str(d) for d, _ in cases),
        "decontamination": sorted(str(r[0]) for r in brute.op7(cases, items) if not r[5]),
    }
    for name, stage in C.STAGES:
        got = stage(spark, clash, str(tmp_path))
        if name in want:
            assert got.columns == clash.columns and sorted(str(r["doc_id"]) for r in got.collect()) == want[name], name
        if name != "packing":
            assert got.filter("_row_key <> 'mine' or N_LINES_REMOVED <> 5 or own <> 1 or n_lines <> 8").count() == 0
        assert stage(spark, none.withColumn("own", F.lit(1)), str(tmp_path)).count() == 0, name
    after = stages["line_dedup"](spark, clash, str(tmp_path))
    assert rows(after.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("s")), "doc_id", "s") == sorted(
        ((r[0], r[3]) for r in brute.op5(cases)), key=str,
    )
    left = stages["near_duplicates"](spark, clash, str(tmp_path))
    one = brute.op1(cases, 5, 80)
    # a document of each component, and all without words, rows alike once
    assert len({(r["doc_id"], r["text"]) for r in left.collect()}) == left.count()
    assert {r["doc_id"] for r in left.collect() if r["doc_id"] is not None} == {r[0] for r in one if r[0] is not None and (r[0] == r[2] or r[1] == 0)}
    packed = stages["packing"](spark, clash, str(tmp_path))
    assert packed.filter("start = 0").count() == len(cases)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline_stages(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    cases = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()]
    stages = dict(C.STAGES)
    kept = stages["quality_rules"](spark, docs, DATA)
    assert kept.columns == docs.columns
    failed = {r[0] for r in brute.op3(cases) if r[-1]}
    assert not failed & {r["doc_id"] for r in kept.collect()}
    after = stages["line_dedup"](spark, docs, DATA)
    assert after.columns == docs.columns and rows(after.select("doc_id", F.sha2("text", 256).alias("s")), "doc_id", "s") == sorted(
        ((r[0], r[3]) for r in brute.op5(cases)), key=str,
    )
    left = stages["near_duplicates"](spark, docs, DATA)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {r[0] for r in brute.op1(cases, 5, 80) if r[0] == r[2]}
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{DATA}/benchmark.parquet").to_pylist()]
    clean = stages["decontamination"](spark, docs, DATA)
    assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in brute.op7(cases, items) if not r[5]}
    assert C.run(spark, DATA).select("sequence_id").distinct().count() > 0
