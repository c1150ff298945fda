import math
import zlib

import numpy as np
import pytest
from cases import edge_docs, edge_texts, empty_docs

from ebbflow.llm import quality as q
from ebbflow.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return q.train(table(spark, SF, "documents"), table(spark, SF, "labels"))


def test_held_out_rows(spark):
    rows = q.op9_quality(spark, SF).collect()
    assert len(rows) == 1000
    label = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    right = total = 0
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if r.held_out and r.doc_id in label:
            total += 1
            right += r.predicted == label[r.doc_id]
    assert total > 50 and right / total > 0.95


def test_labels_of_held_out_rows_do_not_matter(spark, model):
    labels = table(spark, SF, "labels")
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 4 = 2, 1 - quality, quality) quality")
    again = q.train(table(spark, SF, "documents"), flipped)
    assert (again.weight == model.weight).all()


def test_edge_cases(spark, model):
    rows = q.score(edge_docs(spark), model).collect()
    assert len(rows) == len(edge_texts()) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 9 or r.doc_id == 10}) == 1
    assert q.score(empty_docs(spark), model).count() == 0
    kept = q.keep_good(edge_docs(spark), model)
    assert kept.columns == edge_docs(spark).columns
    assert kept.count() == sum(r.score >= q.KEEP_SCORE for r in rows)
    assert q.keep_good(empty_docs(spark), model).count() == 0


@pytest.mark.parametrize("told, share", [([(1, 1), (2, 1), (3, 1), (None, 0)], 4 / 5), ([(1, 0)], 1 / 3), ([], 1 / 2)])
def test_without_both_classes_nothing_is_rejected(spark, told, share):
    labels = spark.createDataFrame(told, "doc_id long, quality int")
    for docs in (edge_docs(spark), empty_docs(spark)):
        model = q.train(docs, labels)
        held = [i for i, _ in told if i is not None and zlib.crc32(str(i).encode()) % 4 == 2]
        rows = q.score(docs, model).collect()
        if not held:
            assert all(abs(r.score - share) < 1e-6 for r in rows)
        assert q.keep_good(docs, model).count() == docs.count() == len(rows)


def test_a_labelled_id_that_repeats_is_one_row(spark):
    docs = spark.createDataFrame([(k % 2 + 1, f"text {k}") for k in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    a, b = q.train(docs, labels), q.train(docs.repartition(7).orderBy(q.F.desc("text")), labels)
    assert (a.weight == b.weight).all()


def plain_fit(texts, labels, counts, seed=7):
    """The same gradient steps, word by word, for one text at a time with dense vectors."""
    rng, hasher = np.random.default_rng(seed), q.Hasher()
    vectors = rng.uniform(-1 / q.DIM, 1 / q.DIM, (1 << q.BUCKET_BITS, q.DIM)).astype(np.float32)
    out = np.zeros((2, q.DIM), np.float32)
    weighs = [counts[c] / sum(counts) / (labels.count(c) / len(labels)) for c in (0, 1)]
    at, steps = 0, q.EPOCHS * len(texts)
    for _ in range(q.EPOCHS):
        for i in rng.permutation(len(texts)):
            rate, at = q.RATE * (1 - at / steps), at + 1
            found = hasher.features(texts[i])
            hidden = vectors[found].astype(np.float64).mean(axis=0)
            p = np.exp(out @ hidden - (out @ hidden).max())
            p /= p.sum()
            error = (p - np.eye(2)[labels[i]]) * weighs[labels[i]]
            back = error @ out
            out -= (rate * np.outer(error, hidden)).astype(np.float32)
            distinct, n = np.unique(found, return_counts=True)
            for bucket, share in zip(distinct, n / len(found)):
                vectors[bucket] -= (rate * len(distinct) ** 0.5 * share * back).astype(np.float32)
    return vectors @ (out[1] - out[0])


def test_fit_equals_a_plain_one():
    texts = ["good words here and there", "bad junk junk junk", "more good words", "junk 123 junk", "fine prose with words"]
    labels = [1, 0, 1, 0, 1]
    got = q.fit(texts, labels, (2, 3))
    want = plain_fit(texts, labels, (2, 3))
    assert np.allclose(got.weight, want, atol=1e-4)
    hasher = q.Hasher()
    for t in texts:
        logit = float(np.mean(want[hasher.features(t)]))
        assert abs(got.score(hasher, t) - 1 / (1 + math.exp(-logit))) < 1e-4


def test_features_of_repeated_words_meet():
    h = q.Hasher()
    pairs = [set(h.features(f"{w} {w}").tolist()) for w in ("alpha", "beta")]
    assert len(pairs[0] & pairs[1]) >= 2  # the prior and the pair of equal words
