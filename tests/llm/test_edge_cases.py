"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ebbline.llm import additive_ann, bpe, hilbert_shards, html_extract, jaccard_join, language_id, packing, quality, topk_pivot, url_filter

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, score double, queue string, accepted boolean, term long"
LONG = "The Quick brown fox's 99 jumps; über-straße <|endoftext|> \x1c\n" * 4_000


def rows():
    texts = ["the cat sat on the mat", "the cat sat on the mat", "", None, "   \n\t ", LONG, "a" * 70_000, "!!! ??? 123", "THE CAT sat on the mat", "über straße schön"]
    return [(i, t, "de" if i == 9 else "en", [None, "s1", "s2"][i % 3], 0, 1, 0.5, "q", True, 7) for i, t in enumerate(texts)] + [(1, "the cat sat on the mat", "en", "s1", 0, 1, 0.5, "q", True, 7), (None, "no id here", None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def test_encode(spark, docs, library):
    got = bpe.encode_documents(docs, PATH).collect()
    want = []
    for r in rows():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        told = library.decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(told.encode()).hexdigest(), list(ids), told))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    back = {r["doc_id"]: r["text"] for r in bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH).collect()}
    assert back[0] == "the</w> cat</w> sat</w> on</w> the</w> mat</w>"
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("weights", [None, {"s1": 3, "s2": 1}])
def test_packing(spark, docs, library, weights):
    got = packing.pack(docs, PATH, weights, length=64).collect()
    pieces = {}
    for r in got:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for d, text, *_ in rows():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted(pieces[(d, len(ids))], key=lambda r: r["start"])
        covered = [x for r in own for x in r["ids"]]
        copies = len(covered) // len(ids)
        assert sorted(covered) == sorted(ids * copies) and all(r["ids"] == ids[r["start"] : r["start"] + r["length"]] for r in own)
        assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in own)
    fill = {}
    for r in got:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    sizes = []
    for k in sorted(fill):
        at = 0
        for offset, n in sorted(fill[k]):
            assert offset == at
            at += n
        sizes.append(at)
    assert sorted(fill) == list(range(len(fill))) and set(sizes[:-1]) == {64}
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_shards(spark, docs):
    for law in ("rows", "bytes"):
        got = hilbert_shards.hilbert_shards(docs, 4, law).collect()
        assert len(got) == len(rows())
        want = sorted((r[0] if r[0] is not None else -1, len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows())
        assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in got) == want
        by = {}
        for r in got:
            by.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(4))
        if law == "rows":
            assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(by) == 4
    assert hilbert_shards.hilbert_shards(docs.limit(0), 4).count() == 0
    assert sorted(r["shard"] for r in hilbert_shards.hilbert_shards(docs.limit(2), 24).collect()) == [0, 1]


def test_language(spark, docs):
    model = language_id.train(docs)
    got = language_id.identify(docs, model).collect()
    assert len(got) == len(rows()) and {"doc_id", "text", "lang_pred", "score", "accepted"} <= set(got[0].asDict())
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["rejected"] for i in (2, 3, 4, 7)) and by[9]["lang_pred"] == "de" and by[0]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language_id.train(docs.limit(0)) is None
    assert {r["lang_pred"] for r in language_id.identify(docs, None).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), model).count() == 0


def test_quality(spark, docs):
    labels = spark.createDataFrame([(0, 1, 0), (7, 0, 0), (1, 1, 0), (6, 0, 1), (None, 1, 0), (5, None, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.classify(docs, model).collect()
    assert len(got) == len(rows()) and all(0 <= r["quality_score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[0]["accepted"] and not by[7]["accepted"] and by[0]["queue"] == "q"
    assert quality.train(docs, labels.limit(0)) is None
    assert quality.classify(docs, None).count() == len(rows())
    assert quality.classify(docs.limit(0), model).count() == 0


def test_jaccard(spark, docs):
    got = {r["doc_id"]: r for r in jaccard_join.jaccard_components(docs).collect()}
    assert got[1]["component_id"] == got[8]["component_id"] == got[0]["component_id"] == 0 and got[0]["n_shingles"] == 4
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in (2, 3, 4)] == [(0, 2), (0, 3), (0, 4)]
    assert got[None]["component_id"] is None and got[6]["n_shingles"] == 1
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


PAGE = "<html><body><nav>menu</nav><article><h1>T&eacute;st</h1><p>one &amp; <b>two</b><br>three<p>four<div class='comments'>c</div></article><footer>f</footer></body>"
URLS = ["http://A.example.ORG/es/1?q#f", "https://example.org/en/1x", None, "no url", "x://y", "http://h.com/fr/a", "http://h.com/de/a", "ftp://k.net/z#://q", "http://h.com/de/a"]


def pages(spark):
    html = [PAGE, "", None, "plain <text", "<p>a<p>b", "<script>var x='</p>'</script><p>z", PAGE * 2, "<div hidden>x</div><!-- c", PAGE]
    return spark.createDataFrame([(i, u, h, "clash", "x") for i, (u, h) in enumerate(zip(URLS, html, strict=True))] + [(None, None, None, None, None)], "page_id long, url string, html string, host string, text string")


def test_urls(spark):
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages(spark)).collect()}
    assert (got[0]["host"], got[0]["path"], got[0]["rule"], got[0]["verdict"]) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[1]["rule"] == "example.org/en/1" and got[1]["verdict"] == "block"
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in (2, 3, None)] == [("", "", None, "allow")] * 3
    assert (got[4]["host"], got[4]["path"]) == ("y", "") and got[5]["verdict"] == "allow" and got[6]["rule"] == "com/de/" and got[7]["path"] == "/z"
    assert url_filter.judge_urls(pages(spark).limit(0)).count() == 0


def test_html(spark):
    got = {r["page_id"]: r for r in html_extract.extract(pages(spark)).collect()}
    assert got[0]["text"] == "Tést\n\none & two three\n\nfour" and got[0]["n_chars"] == len(got[0]["text"])
    assert [got[i]["text"] for i in (1, 2, None)] == ["", "", ""] and got[4]["text"] == "a\n\nb" and got[5]["text"] == "z" and got[7]["text"] == ""
    assert html_extract.extract(pages(spark).limit(0)).count() == 0


VECTORS = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [0.0, 0.0]), (9, [1.0]), (None, [1.0, 1.0]), (3, [0.0, 1.0])]


def test_vectors(spark):
    table = spark.createDataFrame([(i, v, 0, 1) for i, v in VECTORS], "vec_id long, embedding array<float>, rank int, query_id int")
    rows_ = topk_pivot.valid_vectors(table, "vec_id", "embedding")
    got = [tuple(r) for r in topk_pivot.top_k(rows_, rows_.where("vec_id in (1, 3)"), 2).orderBy("query_id", "rank").collect()]
    assert got[:2] == [(1, 1, 2, 1), (1, 2, 3, 0)] and {g[0] for g in got} == {1, 3}
    assert topk_pivot.top_k(rows_.limit(0), rows_, 2).count() == 0 == topk_pivot.top_k(rows_, rows_.limit(0), 2).count()
    some = topk_pivot.valid_vectors(table, "vec_id", "embedding", zero_ok=False)
    assert {r["vec_id"] for r in some.collect()} == {1, 2, 3, 9}
    near = additive_ann.nearest(some, some.where("vec_id = 1"), 5).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in near] == [(2, 1.0), (3, 0.0), (3, 0.0)]
    assert additive_ann.nearest(some.limit(0), some, 2).count() == 0 == additive_ann.nearest(some, some.limit(0), 2).count()
