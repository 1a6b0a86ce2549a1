"""Every operator and stage on odd rows, and on no rows."""

import pytest

import corpus_pipeline
from fragloom.llm import edit_fingerprints, lm_score, media, mixing, pieces, simhash, substrings, token_counts, toxicity, url_filters

OPERATORS = {
    "token_counts": lambda d, l: token_counts.token_counts(d),
    "pieces": lambda d, l: pieces.digests(d),
    "mixing": lambda d, l: mixing.mix(d, l),
    "edit_fingerprints": lambda d, l: edit_fingerprints.document_fingerprints(d),
    "toxicity": lambda d, l: toxicity.toxicity(d, l),
    "media": lambda d, l: media.digests(media.store(d)),
    "lm_score": lambda d, l: lm_score.lm_scores(d),
    "simhash": lambda d, l: simhash.near_dedup(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(spark, odd, labels, name):
    got = OPERATORS[name](odd, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd.select("doc_id").collect())
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    if name != "edit_fingerprints":  # whose rows also depend on the next document
        assert by[7][0] == by[7][1]  # repeated rows are alike
        strip = lambda r: {k: v for k, v in r.asDict().items() if k not in ("doc_id", "held_out", "component_id")}
        assert strip(by[1][0]) == strip(by[2][0]) and strip(by[3][0]) == strip(by[4][0])


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, odd, labels, name):
    assert OPERATORS[name](odd.limit(0), labels.limit(0)).count() == 0


def test_values_of_odd_rows(spark, odd, labels):
    n = {r.doc_id: r.n_tokens for r in token_counts.token_counts(odd).collect()}
    assert n[3] == n[4] == n[5] == 0 and n[6] > 60_000
    m = {r.doc_id: r for r in media.digests(media.store(odd)).collect()}
    assert m[3].n_bytes == 0 and m[3].payload_bytes == 64 and m[4].payload_sha256 == m[3].payload_sha256
    s = {r.doc_id: r for r in simhash.near_dedup(odd).collect()}
    assert {s[i].fingerprint for i in (3, 4, 5)} == {"0" * 16} and {s[i].component_id for i in (3, 4, 5)} == {3} and s[2].component_id == 1
    f = {r.doc_id: r for r in edit_fingerprints.document_fingerprints(odd).collect()}
    assert f[1].fingerprint == f[2].fingerprint and f[3].n_chars == 0 and f[1].class_id == f[2].class_id == 1
    p = {r.doc_id: r for r in pieces.digests(odd).collect()}
    assert p[3].n_tokens == 0 and all(r.round_trip for r in p.values())


def test_repeats_of_odd_rows(spark, odd):
    got = {(r.doc_id, r.first_doc_id) for r in substrings.repeats(odd).collect()}
    assert {(2, 1), (11, 1)} <= got | {(11, 2)} and all(a in (2, 11) for a, _ in got)
    assert substrings.repeats(odd.limit(0)).count() == 0


@pytest.mark.parametrize("i", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, odd, labels, tmp_path, i):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    name, stage = corpus_pipeline.STAGES[i]
    out = stage(spark, odd, str(tmp_path))
    rows = out.collect()
    if i < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == odd.columns and any(r.doc_id is None for r in rows)
        assert {r.doc_id for r in rows} >= {6, 7, 8, 9, 10}
    else:
        assert len(rows) == odd.count()
    assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0


def test_odd_pages(spark):
    pages = spark.createDataFrame(
        [(1, None, None, "x"), (2, "", "", "x"), (3, "no scheme", None, "x"), (4, "HTTP://A.Example.COM/en/7?x", None, "x"), (4, "HTTP://A.Example.COM/en/7?x", None, "x"), (None, "x://net#f", "<a href=//b.c/>", "x")],
        "page_id long, url string, html string, verdict string",
    ).selectExpr("*", "url as host", "url as path", "url as rule", "1 as trust", "2 as distrust", "3 as neutral", "4 as ruled", "5 as src")
    got = {r.page_id: r for r in url_filters.judge(pages).collect()}
    assert all(got[i].host == "" and got[i].path == "" and got[i].rule is None and got[i].verdict == "allow" for i in (1, 2, 3))
    assert (got[4].host, got[4].path, got[4].rule, got[4].verdict) == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert url_filters.judge(pages).count() == 6 and url_filters.judge(pages.limit(0)).count() == 0
