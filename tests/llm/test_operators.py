"""Operators on Spark: planted cases, nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions

import public_tokenizers
from stratum.llm import bpe, language_id, media, ngram_join, packing, pii, secret_scan, suffix_dedup, topk_search, url_filter
from stratum.llm import components
from stratum.llm.queries import URL_GLOBS, URL_RULES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(seed=1, n=60):
    """Invented prose with exact and near copies, shared passages, nulls, empty and one-word texts, and a long one."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage = prose(40)
    texts = [prose(rng.randint(20, 120)) for _ in range(n)]
    for i in range(0, n, 6):
        texts[i] += " " + passage + " " + prose(10)
    texts[7] = texts[3]
    near = texts[11].split()
    near[len(near) // 2] = "changed"
    texts[12] = " ".join(near)
    texts[13] = None
    texts[14] = ""
    texts[15] = "word"
    texts[16] = "word"
    texts[17] = prose(30000)
    texts[18] = "a" * 700
    rows = [(i, t, "en" if i % 2 else "de", "s", 1) for i, t in enumerate(texts)]
    return rows + [rows[5]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_remove_repeats_equals_brute_force(spark, docs):
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    seen, want = set(), {}
    for doc in sorted(texts):
        data, mark = texts[doc], bytearray(len(texts[doc]))
        for p in range(len(data) - 99):
            w = data[p : p + 100]
            if w in seen:
                mark[p : p + 100] = b"\1" * 100
            seen.add(w)
        want[doc] = (bytes(b for b, m in zip(data, mark) if not m), len(re.findall(b"\1+", bytes(mark))))
    rows = suffix_dedup.remove_repeats(docs.withColumnRenamed("source", "Kept")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (bytes(r.kept), len(r.runs or []), r.n_bytes) == (*want[r.doc_id], len(texts[r.doc_id]))
    assert want[7][0] == b"" and want[18][1] == 1


@pytest.mark.parametrize("constant", [None, "HOT_LOCAL", "HOT_TOTAL", "PART", "SORT_BYTES"])
def test_hot_anchors_are_split_without_loss(spark, monkeypatch, constant):
    """Where windows are compared follows from the constants, what comes out does not."""
    if constant:
        monkeypatch.setattr(suffix_dedup, constant, 1)
    rng = random.Random(4)
    line = "".join(rng.choice("abcdefgh ") for _ in range(70))
    rows = [(i, "".join(rng.choice("xyz") for _ in range(90)) + line + "".join(rng.choice("uvw") for _ in range(12 + 60 * (i % 2)))) for i in range(300)]
    rows += [(900 + i, rows[i][1][40:]) for i in range(40)]
    seen, want = set(), {}
    for doc, text in rows:
        mark = bytearray(len(text))
        for p in range(len(text) - 99):
            if text[p : p + 100] in seen:
                mark[p : p + 100] = b"\1" * 100
            seen.add(text[p : p + 100])
        want[doc] = sum(mark)
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    assert {r.doc_id: sum(x.end - x.start for x in r.runs or []) for r in out.collect()} == want


def test_rows_that_share_an_id_but_not_a_text_keep_what_occurs_once(spark):
    rng = random.Random(5)
    a, b, c = ("".join(rng.choice("abcdefghij") for _ in range(200)) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (2, b), (None, c), (None, a + "."), (3, c)]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = collections.Counter((r.doc_id, r.text, bytes(r.kept).decode()) for r in out)
    first = {(None, c, c), (None, a + ".", a + "."), (2, b, b)}
    assert got == {**dict.fromkeys(first, 1), (2, b, b): 2, (1, a, ""): 1, (2, a, ""): 1, (3, c, ""): 1}


@pytest.mark.parametrize(("constant", "value"), [(None, 0), ("BUCKET", 1), ("HELD", 1), ("BLOCK", 40), ("BLOCK_BYTES", 20_000)])
def test_jaccard_classes_equal_brute_force(spark, monkeypatch, constant, value):
    if constant:
        monkeypatch.setattr(ngram_join, constant, value)
    rng = random.Random(9)
    rows = documents(2, 40)[:-1]
    base = rows[30][1].split() + [f"v{i}" for i in range(200)]
    for i in range(330):  # one group of near copies larger than a block
        words = list(base)
        words[rng.randrange(len(words))] = f"x{i}"
        rows.append((1000 + i, " ".join(words), "en", "s", 1))
    rows.append((5000, rows[20][1].upper(), "en", "s", 1))
    sets = {}
    for doc, text, *_ in rows:
        w = (text or "").lower().split()
        sets[doc] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    links, root = collections.Counter(), {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    out = ngram_join.jaccard_classes(spark.createDataFrame([*rows, (None, "no id", "en", "s", 1)], SCHEMA)).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: (r.class_id, r.n_links) for r in out} == {d: (find(d), links[d]) for d in ids}
    assert links[1000] >= 300


def test_centres_of_stars_are_spread(spark, monkeypatch):
    star = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(40)] + [(2999, 6000), (6000, 6001)]
    found = {r.node: r.root for r in components.connected_components(spark.createDataFrame([*star, (None, 3)], "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(3000), 0), **dict.fromkeys(range(5000, 5041), 5000), 6000: 0, 6001: 0}


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (300, 200), (300, 250)]
    found = {r.node: r.root for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 200: 200, 250: 200, 300: 200}


def test_top_k_with_ties_repeats_and_odd_vectors(spark):
    rows = [(i, [0.1 * (i % 3), 0.5, -0.25], 0) for i in range(20)] + [(0, [0.0, 0.5, -0.25], 0), (50, None, 1), (51, [1.0, None, 0.0], 1), (52, [1.0, float("nan"), 0.0], 1), (None, [1.0, 1.0, 1.0], 1), (53, [], 1), (54, [1.0], 1)]
    vectors = topk_search.quantize(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), "vec_id", "embedding")
    out = topk_search.exact_top_k(vectors.where("id in (0, 1, 54)"), vectors, 5, block_bytes=100).collect()
    own = {i: np.floor(256 * np.float32([0.1 * (i % 3), 0.5, -0.25]).astype(float)).astype(int) for i in range(20)}
    for q in (0, 1):
        want = sorted((-int(own[q] @ own[i]), i) for i in own if i != q)[:5]
        assert sorted((r["rank"], r.id, r.score) for r in out if r.query_id == q) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert not [r for r in out if r.query_id == 54]
    assert topk_search.exact_top_k(vectors.where("id < 0"), vectors).count() == 0 and topk_search.exact_top_k(vectors, vectors.where("id < 0")).count() == 0


def test_packing_places_every_piece(spark, docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack(docs, path, 64).collect()
    encode = packing.tokenizer(path).encode_ordinary
    lengths = collections.Counter()
    for r in rows:
        lengths[r.doc_id] += r.length
    for doc, text, *_ in documents()[:-1]:
        assert lengths[doc] == (len(encode(text or "")) + 1) * (2 if doc == 5 else 1)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= -(-sum(lengths.values()) // 64) * 1.05 + 1
    assert packing.pack(none, path).count() == 0


def test_bpe_round_trip(docs, none):
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = bpe.decode_ids(bpe.encode_texts(docs.withColumnRenamed("lang", "IDS"), *vocabulary), *vocabulary)
    assert out.columns == ["doc_id", "text", "source", "n_chars", "ids", "decoded"]
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in out.collect())
    assert bpe.encode_texts(none, *vocabulary).count() == 0
    both = bpe.round_trip(docs.withColumnRenamed("lang", "Decoded"), *vocabulary)
    assert both.columns == ["doc_id", "text", "source", "n_chars", "ids", "decoded"]
    assert sorted((r.doc_id, r.ids, r.decoded) for r in both.collect()) == sorted((r.doc_id, r.ids, r.decoded) for r in out.collect())


def test_url_rules(spark):
    urls = ["http://a.example.net/en/x", "http://EXAMPLE.net/en/", "http://x.net/", "http://x.net", "http://example.com/de/1?q", "http://notexample.com/de/", "ftp://b.org/fr/#f", "http://b.org/en", "nothing", None, "", "http://evil.org/.example.net/en/", "http://spam-farm.example.org/x", "http://a.net?x/"]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, Rule string")
    long = spark.createDataFrame([(1, "http://x.net/" + "a/" * 200_000)] * 2, "page_id long, url string")
    assert {(r.rule, r.verdict, len(r.path)) for r in url_filter.filter_urls(long, URL_RULES, URL_GLOBS).collect()} == {("net/", "block", 400_001)}
    assert url_filter.filter_urls(df.limit(0), URL_RULES, URL_GLOBS).count() == 0
    got = [(r.rule, r.verdict) for r in url_filter.filter_urls(df, URL_RULES, URL_GLOBS).orderBy("page_id").collect()]
    assert got == [("example.net/en/", "allow"), ("example.net/en/", "allow"), ("net/", "block"), (None, "allow"), ("example.com/de/", "block"), (None, "allow"), ("org/fr/", "allow")] + [(None, "allow")] * 5 + [(None, "block"), (None, "allow")]


def test_secrets_are_learned(spark, none):
    rng = random.Random(3)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    words = "river stone lamp green cloud under water house".split()
    rows = [(i, " ".join(rng.choices(words, k=40)) + f'\ntoken = "{hexa(40)}" and more ' + " ".join(rng.choices(words, k=30))) for i in range(900)]
    model = secret_scan.train(spark.createDataFrame(rows, "doc_id long, text string"))
    given = [(1, "the passphrase: correct-horse-battery-staple", 1), (2, "version 7.20.1 of 2024-01-09", 1), (3, None, 1), (4, "", 1), (5, "token=abcdef", 1), (5, "token=abcdef", 1), (6, "a river " * 20000 + "pwd: S3cr3t!x", 1)]
    test = spark.createDataFrame(given, "doc_id long, text string, Spans int")
    out = secret_scan.scan_secrets(test, model)
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append([(s.kind, s.start, s.end) for s in r.spans])
    assert got == {1: [[("crf", 16, 44)]], 2: [[]], 3: [[]], 4: [[]], 5: 2 * [[("assign", 0, 12)]], 6: [[("crf", 160005, 160013)]]} and out.columns == ["doc_id", "text", "spans"]
    empty = secret_scan.train(none)
    assert secret_scan.scan_secrets(none, empty).count() == 0 and secret_scan.all_spans("token=abcdef", secret_scan.Tagger(empty)) == [("assign", 0, 12)]


def test_personal_data_is_found_and_redacted(spark, none):
    rng = random.Random(5)
    phone = lambda: f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"
    rows = [(i, f"call {phone()} now or version {i}.{i}.0 in 2024") for i in range(200)] + [(300 + i, f"numbers {i} 20 30 4000 50 60, id {rng.randint(10**7, 10**8)}") for i in range(200)]
    model = pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    text = "call +1&& (555)&& 555-1234&& now, mail a@b.cd"
    kinds = [(k, text[s:e]) for k, s, e in pii.all_spans([text, ""], model)[0]]
    assert ("email", "a@b.cd") in kinds and any(k == "phone_found" for k, _ in kinds)
    df = spark.createDataFrame([(1, "to a@b.cd!", "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, spans string")
    assert [r.text for r in pii.redact(df, model).orderBy("doc_id").collect()] == ["to [EMAIL]!", None, ""]
    assert pii.find_personal_data(none, pii.train(none)).count() == 0


def test_every_number_of_a_list_is_found(spark):
    rng = random.Random(12)
    number = lambda: f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    wide = lambda: f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    rows = [(i, f"call {number()}, {number()} or {wide()}") for i in range(300)] + [(300 + i, f"numbers {i} 20 30 4000 50 60, id {rng.randint(10**7, 10**8)}") for i in range(300)]
    model = pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    for text, want in (("call 555-123-4567, 555-987-6543", {"555-123-4567", "555-987-6543"}), ("call +1 555 123 4567 / (555) 987-6543", {"+1 555 123 4567", "(555) 987-6543"}), ("numbers 7 20 30 4000 50 60", set())):
        assert {text[s:e] for _, s, e in pii.all_spans([text], model)[0]} == want


def test_language_of_held_out_words(spark, none):
    rng = random.Random(6)
    make = {"aa": "bcdxyz", "bb": "klmopq"}
    text = lambda lang: " ".join("".join(rng.choice(make[lang]) for _ in range(rng.randint(2, 6))) for _ in range(40))
    rows = [(i, text(lang), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df)
    test = spark.createDataFrame([(1, text("aa")), (2, text("bb").upper()), (3, None), (4, "12 !?"), (5, "")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(test, model).collect()}
    assert got[1][0] == "aa" and got[2][0] == "bb" and got[1][1] > 0.8 and got[3] == got[4] == got[5] == ("und", 0.0)
    words, marginal, *_ = language_id.Labeller(model).words([text("aa") + " " + text("bb")])
    assert (marginal[:35].argmax(1) == 0).mean() > 0.9 and (marginal[45:].argmax(1) == 1).mean() > 0.9
    assert language_id.identify(test, language_id.train(none)).where("lang_pred <> 'und'").count() == 0
    odd = spark.createDataFrame([(1, "½ ² Ⅷ", 7), (1, "½ ² Ⅷ", 7), (2, text("aa"), 7), (3, (text("bb") + " ") * 3000, 7)], "doc_id long, text string, SCORE int")
    out = language_id.identify(odd, model)
    assert sorted((r.doc_id, r.lang_pred) for r in out.collect()) == [(1, "und"), (1, "und"), (2, "aa"), (3, "bb")] and "SCORE" not in out.columns


def test_models_do_not_depend_on_how_rows_are_dealt_out(spark):
    docs = spark.createDataFrame(documents(4, 120), SCHEMA)
    for make in (language_id.train, pii.train, secret_scan.train):
        a, b = make(docs.repartition(1)), make(docs.repartition(5, "text"))
        assert repr(a) == repr(b)


def test_media_columns(spark):
    image = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    rows = [(1, media.encode_bmp(image), 9), (2, media.encode_netpbm(image), 9), (3, None, 9), (4, b"", 9), (5, b"P6 9 9 255\n", 9)]
    out = media.media_columns(spark.createDataFrame(rows, "id int, media binary, WIDTH int"), size=(8, 8), tile=4).orderBy("id").collect()
    assert [r.width for r in out] == [4, 4, None, None, None] and out[0].samples == out[1].samples == image.tobytes()
    assert len(out[0].tiles) == 4 and out[0].dhash == out[1].dhash and out[3].tiles is None
    long = media.encode_netpbm(np.tile(image, (3000, 16, 1)))
    both = media.media_columns(spark.createDataFrame([(1, long), (1, long)], "id int, media binary")).collect()
    assert both[0] == both[1] and both[0].height == 12000
    assert media.media_columns(spark.createDataFrame([], "id int, media binary")).count() == 0
    texts = spark.createDataFrame([(1, "é" * 96), (2, None), (3, "x" * 193)], "id int, text string")
    payload = texts.select("id", media.text_payload(texts.text).alias("p")).withColumn("m", media.payload_ppm(functions.col("p")))
    assert [(len(r.p), bytes(r.m[:13])) for r in payload.orderBy("id").collect()] == [(192, b"P6\n64 1\n255\n\xc3"), (192, b"P6\n64 1\n255\n "), (384, b"P6\n64 2\n255\nx")]


def test_null_ids_and_empty_tables(spark, none):
    assert suffix_dedup.remove_repeats(none).count() == 0 and ngram_join.jaccard_classes(none).count() == 0
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefghij") for _ in range(150))
    out = suffix_dedup.remove_repeats(spark.createDataFrame([(None, text), (3, text)], "doc_id long, text string")).collect()
    assert {r.doc_id: len(r.kept) for r in out} == {None: 150, 3: 0}
