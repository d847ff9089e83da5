"""The pipeline on the smallest tables: each stage's effect, and the whole of it."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tessera.llm.near_duplicates import near_duplicate_groups, shingle_set
from tessera.llm.simhash import words_of

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def all_links(texts):
    """Pairs of keys of a Jaccard similarity of at least 0.8 over five-word shingles, counted shingle by shingle over all pairs."""
    sets = {k: set(shingle_set(words_of(t or ""), 5).tolist()) for k, t in texts.items()}
    holders, both = defaultdict(list), Counter()
    for k, s in sets.items():
        for x in s:
            holders[x].append(k)
    for ks in holders.values():
        both.update((a, b) for i, a in enumerate(ks) for b in ks[i + 1 :])
    empty = [k for k, s in sets.items() if not s]
    return [(a, b) for (a, b), n in both.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)] + list(zip(empty, empty[1:]))


def connected(keys, links):
    up = {k: k for k in keys}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {k: root(k) for k in keys}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, docs, SF).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_stages(spark, stages):
    rows = {k: v.collect() for k, v in stages.items()}
    for name in ("quality", "line_dedup", "near_duplicates", "mix"):
        assert stages[name].columns == COLUMNS
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in rows["quality"]}
    assert all((k in kept) == (q == 1) for k, q in labels.items())
    assert {r.doc_id for r in rows["line_dedup"]} == kept and all(r.n_chars == len(r.text) for r in rows["line_dedup"])
    texts = {r.doc_id: r.text for r in rows["line_dedup"]}
    near = sorted(r.doc_id for r in rows["near_duplicates"])
    assert near == sorted(set(connected(texts, all_links(texts)).values()))
    assert max(Counter(r.doc_id for r in rows["mix"]).values()) <= 3
    assert len(rows["sentencepiece"]) == len(rows["mix"]) and all(r.same and r.n_pieces == len(r.ids) for r in rows["sentencepiece"])


def test_near_duplicates_by_all_pairs(spark):
    """Every link among all pairs of a larger table, and no group that links don't make."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    links = all_links(texts)
    want, got = connected(texts, links), {r.k: r.g for r in near_duplicate_groups(docs).collect()}
    assert len(links) > 100 and all(got[a] == got[b] for a, b in links)
    assert len(set(got.values())) == len(set(want.values()))


def test_run(spark, stages):
    whole = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.n_pieces) for r in whole.collect()) == sorted((r.doc_id, r.n_pieces) for r in stages["sentencepiece"].collect())


def test_odd_rows(spark, tmp_path):
    """Nulls, empty texts and repeats in any column go through all stages."""
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some text here", None, "b", None), (3, "word " * 50, "en", None, 5), (3, "word " * 50, "en", None, 5)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs.collect()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(0), SF).count() == 0
