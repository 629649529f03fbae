"""The corpus pipeline against a plain version of what its stages decide."""

import random
from itertools import combinations

import corpus_pipeline
from stratum.llm import language_id
from stratum.llm.common import materialize, read


def test_stages_keep_columns_and_decide(spark, sf):
    docs = read(spark, sf, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(spark, stage(spark, docs, sf), name)
        seen[name] = docs.toPandas()
        if name != "packing":
            assert docs.columns == columns
    raw = read(spark, sf, "documents").toPandas()
    assert set(seen["language_id"].doc_id) == set(raw.doc_id[raw.text.fillna("").str.contains(r"[^\W\d_]")])
    shingles = {}
    for doc, text in zip(seen["language_id"].doc_id, seen["language_id"].text):
        w = text.lower().split()
        shingles[doc] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])
    root = {d: d for d in shingles}
    ids = sorted(shingles)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(shingles[a] & shingles[b])
            if common and 5 * common >= 4 * (len(shingles[a]) + len(shingles[b]) - common):
                x, y = root[a], root[b]
                for d, r in root.items():
                    if r in (x, y):
                        root[d] = min(x, y)
    assert set(seen["ngram_join"].doc_id) == {d for d, r in root.items() if d == r}
    kept, met = {}, set()
    for doc, text in sorted(zip(seen["ngram_join"].doc_id, seen["ngram_join"].text)):
        data, mark = text.encode(), bytearray(len(text.encode()))
        for p in range(len(data) - 99):
            w = data[p : p + 100]
            if w in met:
                mark[p : p + 100] = b"\1" * 100
            met.add(w)
        at, out = 0, []
        for c in text:
            n = len(c.encode())
            if not all(mark[at : at + n]):
                out.append(c)
            at += n
        kept[doc] = "".join(out)
    after = seen["suffix_dedup"]
    assert dict(zip(after.doc_id, after.text)) == kept and (after.n_chars == after.text.str.len()).all()
    assert set(seen["pii"].doc_id) == set(after.doc_id) == set(seen["packing"].doc_id)
    assert not seen["pii"].text.str.contains(r"@mail\d").any()
    assert seen["packing"].groupby("sequence_id").length.sum().max() <= 2048


def test_language_stage_keeps_even_mixes(spark, sf):
    docs = read(spark, sf, "documents")
    best: dict[str, list[str]] = {}
    for r in docs.where("lang is not null and text is not null").orderBy("doc_id").collect():
        best.setdefault(r.lang, []).extend(r.text.split())
    langs = sorted(best)
    assert len(langs) == 4
    mixes = [c for n in (3, 4) for c in combinations(langs, n)]
    texts = ["\n".join(" ".join(best[lang][30 * i : 30 * i + 30]) for i in range(6) for lang in mix) for mix in mixes]
    rows = [(10**9 + i, t, None, "mixed", len(t)) for i, t in enumerate(texts)]
    both = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, both, sf).where(f"doc_id >= {10**9}").collect()}
    assert kept == {r[0] for r in rows}


def test_words_without_a_sure_label_are_unsure():
    labeller = language_id.Labeller({"langs": list("abcd"), "index": {}, "weights": language_id.np.zeros((1, 4), "f"), "trans": language_id.np.zeros((4, 4), "f")})
    assert labeller.documents(["some words"])[2][0] < corpus_pipeline.LEAST_SCORE


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Runs string, spans int, kept string, class_id int, lang_pred string"


def test_stages_on_empty_tables(spark, sf):
    none = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, sf)
        assert out.collect() == [] and (name == "packing" or out.columns == none.columns)


def test_stages_on_nulls_repeats_and_clashing_columns(spark, sf):
    rng = random.Random(2)
    words = {"en": "the of river stone lamp green cloud under water house", "de": "der und fluss stein lampe wolke unter wasser haus mit"}
    prose = lambda lang, k=60: " ".join(rng.choice(words[lang].split()) + rng.choice(["", "s", "en"]) for _ in range(k))
    more = ("r", 1, "k", 2, "p")
    rows = [(i, prose("en" if i % 2 else "de"), "en" if i % 2 else "de", "s", 1, *more) for i in range(80)]
    twin, other = rows[7], (8, prose("en"), None, None, None, None, None, None, None, None)
    extra = [twin, twin, other, (None, prose("en"), None, None, None, *more), (200, None, "en", "s", 1, *more), (201, "", "en", "s", 1, *more), (202, "½ 12", "en", "s", 1, *more), (203, rows[11][1] + " mail a.b@c.de", "en", "s", 1, *more)]
    docs = spark.createDataFrame(rows + extra, SCHEMA)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(spark, stage(spark, docs, sf), name)
        seen[name] = [r.asDict() for r in docs.collect()]
        assert name == "packing" or docs.columns == spark.createDataFrame([], SCHEMA).columns
    ids = lambda name: sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in seen[name])
    assert ids("language_id") == sorted([*range(80), 7, 7, 8, -1, 203])
    assert ids("ngram_join") == ids("suffix_dedup") == ids("pii") == sorted([*range(80), 8, -1])  # 203 is a near copy of 11
    assert {(r["Runs"], r["spans"], r["kept"], r["class_id"], r["lang_pred"]) for r in seen["pii"] if r["doc_id"] not in (8, None)} == {more}
    assert {r["doc_id"] for r in seen["packing"]} == {*range(80), None}


def test_language_stage_drops_scripts_that_were_not_learned(spark, sf):
    rng = random.Random(1)
    foreign = [" ".join("".join(rng.choice(signs) for _ in range(rng.randint(2, 9))) for _ in range(80)) for signs in ("абвгдежзийклмноп", "αβγδεζηθικλμν", "漢字仮名交文書言語")]
    docs = read(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    both = docs.unionByName(spark.createDataFrame([(10**9 + i, t, None, "s", 1) for i, t in enumerate(foreign)], docs.schema))
    assert corpus_pipeline.identify_language(spark, both, sf).where(f"doc_id >= {10**9}").count() == 0
