"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest

from millrace.llm import bwt_dedup, chaining, decontam, jaccard, media, mixing, pii, quality, sharding, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, slot long, q int, tok long, rep long, _copies long, bucket int"
WORDS = "red green blue cyan teal pink gold grey lime plum rust jade".split()


def prose(n, seed=1):
    x, out = seed, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x // 7 % 12] + str(x // 91 % 50))
    return " ".join(out)


def rows():
    texts = {
        1: prose(120), 2: prose(120), 3: None, 4: "", 5: "   \n\t ", 6: "é" * 400, 7: "a" * 300_000, 8: prose(20_000, 9), 9: prose(120)[:-8] + " changed",
        10: "call +1 (415) 555-1234 or a.b@c.example, 10.0.0.1", 11: "\U0001f600 " * 60, 12: "x", 13: "x y", 14: prose(60, 5) + " " + prose(120, 77),
    }
    extra = (0.5, 1, 2, 3, 4, 5, 6, 7)
    out = [(i, t, "en", "a" if i % 3 else None, None, *extra) for i, t in texts.items()]
    return [*out, out[0], out[0], (None, prose(120), None, "a", 3, *extra), (None, None, None, None, None, *[None] * 8)]


BENCHMARK = [(1, prose(60, 5)), (2, None), (3, ""), (None, "tiny item"), (3, prose(15, 40))]
LABELS = [(1, 1, 0), (2, 1, 0), (4, 0, 1), (7, 0, 1), (8, 1, 0), (9, None, None), (None, 1, 1), (6, 0, 0), (6, 1, 0), (11, 0, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def benchmark_items(spark):
    return spark.createDataFrame(BENCHMARK, "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


N = len(rows())


def test_pii(docs, empty):
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    assert pii.find(docs).count() == N
    assert len(found[10].base) == 3 and not found[3].base and not found[7].base
    assert pii.find(empty).count() == 0


def test_toxicity(docs, empty, labels):
    fitted = toxicity.fit(docs, labels)
    scores = toxicity.scored(docs, *fitted)
    assert scores.columns == docs.columns and scores.where("score between 0 and 1").count() == N
    assert toxicity.scored(empty, *toxicity.fit(empty, labels)).count() == 0


def test_quality(docs, empty, labels):
    scores = quality.scored(docs, quality.fit(docs, labels))
    assert scores.where("score between 0 and 1").count() == N
    nothing = quality.fit(empty, labels)
    assert quality.scored(docs, nothing).where("score <> 0.5").count() == 0
    assert quality.keep_good(empty, labels).count() == 0


def test_chaining(docs, empty):
    found = chaining.shared_passages(docs).collect()
    pairs = {(r.doc_id, r.other_id) for r in found}
    assert {(2, 1), (9, 1), (None, 1)} <= pairs and not any(r.doc_id in (3, 4, 5, 6, 7, 11, 12, 13) for r in found)
    assert chaining.shared_passages(empty).count() == 0


def test_sharding(docs, empty):
    out = sharding.two_pass_shuffle(docs, bytes_column="text").collect()
    assert len(out) == N
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sharding.two_pass_shuffle(empty).count() == 0 and sharding.shard_documents(docs).where("size = 1 and text_crc32 = 0").count() == 3


def test_bwt(docs, empty):
    out = {(r.doc_id, r.n_bytes): r for r in bwt_dedup.remove_repeats(docs).collect()}
    whole = len(prose(120))
    assert out[2, whole].n_removed == whole and out[2, whole].n_spans == 1 and out[1, whole].n_removed == 0
    assert out[None, whole].n_removed == whole and out[3, 0].n_removed == 0 and out[7, 300_000].n_removed == 0
    assert bwt_dedup.remove_repeats(docs).count() == N and bwt_dedup.remove_repeats(empty).count() == 0


def test_mixing(docs, empty):
    out = mixing.mix(docs)
    assert out.count() == N and out.where("_copies < 0 or _copies > 3").count() == 0
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mix(empty).count() == 0 and mixing.mix(docs.where("text is null or text = ''")).where("_copies * _size > 0").count() == 0


def test_media(docs, empty):
    out = media.store(docs).collect()
    assert len(out) == N and {r.payload_bytes for r in out if r.n_bytes == 0} == {192}
    assert media.store(empty).count() == 0


def test_jaccard(docs, empty):
    out = jaccard.jaccard_components(docs, 3, 90).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out}
    assert len(out) == N and {(r.n_shingles, r.component_id) for r in out if r.doc_id is None} == {(118, 1), (0, None)} and got[2][1] == 1 and got[9][1] == 1 and got[3] == (0, 3) and got[5] == (0, 5) and got[12] == (1, 12)
    assert jaccard.keep_one(docs).columns == docs.columns
    assert jaccard.jaccard_components(empty).count() == 0 and jaccard.keep_one(empty).count() == 0


def test_decontamination(docs, empty, benchmark_items):
    hits = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, benchmark_items).collect()}
    assert (14, 1) in hits and not any(d in (3, 4, 5, 12, 13) for d, _ in hits)
    kept = decontam.decontaminate(docs, benchmark_items)
    assert kept.where("doc_id = 14").count() == 0 and kept.where("text is null").count() == 2 and kept.columns == docs.columns
    assert decontam.contaminated(empty, benchmark_items).count() == 0 and decontam.decontaminate(docs, benchmark_items.limit(0)).count() == N


def test_pipeline_stages(spark, tmp_path, docs, benchmark_items, labels):
    corpus = pytest.importorskip("corpus_pipeline")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark_items.write.parquet(f"{tmp_path}/benchmark.parquet")
    at = plain
    for i, (_, stage) in enumerate(corpus.STAGES):
        at = stage(spark, at, str(tmp_path))
        assert i == len(corpus.STAGES) - 1 or at.columns == plain.columns
    assert at.columns == [*plain.columns, "shard", "slot"]
    for _, stage in corpus.STAGES:
        assert stage(spark, plain.limit(0), str(tmp_path)).count() == 0
