import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cohortcart.llm import quality_classifier as qc
from cohortcart.llm import quality_rules as qr
from tests.llm import odd

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MASK = (1 << 64) - 1


def base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(inside), failed)


def _long(x: int) -> bytes:
    return x.to_bytes(8, "little")


def buckets(text, n):
    """Bucket numbers; a long is hashed with the hash before it as seed."""
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text or "")]
    two = [xxhash.xxh64_intdigest(_long(b), xxhash.xxh64_intdigest(_long(a), 42)) for a, b in zip(h, h[1:], strict=False)]
    return [x & n - 1 for x in h] + [(x & n - 1) + n for x in two]


def scores(texts: list, trusted: list[bool], s: qr.RuleSettings):
    raw, target = Counter(), Counter()
    grams = [buckets(t, s.buckets) for t in texts]
    for g, good in zip(grams, trusted, strict=True):
        raw.update(g)
        if good:
            target.update(g)
    ratio = {}
    for half in (0, 1):
        mine = [b for b in raw if b // s.buckets == half]
        n_raw, n_target = sum(raw[b] for b in mine), sum(target[b] for b in mine)
        for b in mine:
            ratio[b] = round(math.log((target[b] + s.smoothing) / (n_target / n_raw * raw[b] + s.smoothing)), 4) \
                if n_target else 0.0
    return [sum(ratio[b] for b in g) / max(len(g), 1) for g in grams]


def check_rules(out, rows, good, settings):
    want = {}
    for r, score in zip(rows, scores([r[1] for r in rows], [r[0] in good for r in rows], settings), strict=True):
        want.setdefault(odd.key((r[0], *base(r[1]))), []).append(score)
    assert len(out) == len(rows)
    for r in out:
        mine = want[odd.key((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"],
                             r["n_repeat_words"], r["base_failed"]))]
        assert min(abs(r["score"] - x) for x in mine) < 1e-9
        assert r["kept"] == (not r["base_failed"] and r["score"] >= settings.threshold)


def test_rules_on_odd_documents(spark):
    settings = qr.RuleSettings(buckets=1 << 10)
    out = qr.quality_rules(odd.documents(spark, clash=True), odd.labels(spark), settings).collect()
    good = {i for i in range(60) if i % 9} - {3}
    check_rules(out, odd.rows(), good, settings)


def test_rules_without_labels_and_empty(spark):
    docs, none = odd.documents(spark), odd.labels(spark).where("false")
    out = qr.quality_rules(docs, none).collect()
    assert all(r["score"] == 0 and r["kept"] == (not r["base_failed"]) for r in out)
    assert qr.quality_rules(odd.empty(spark), odd.labels(spark)).count() == 0


def test_rules_target_counts_every_trusted_document(spark):
    """More trusted ids than the target was once limited to (200,000); each counts."""
    from pyspark.sql import functions as F

    n = 200_500
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    docs = spark.range(n + 500).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"))
    settings = qr.RuleSettings(buckets=1 << 4)
    got = qr.bucket_counts(docs, qr.trusted_ids(labels), settings).agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    assert (got["raw"], got["target"]) == (3 * (n + 500), 3 * n)


def test_rules_filter_keeps_columns(spark):
    docs = odd.documents(spark, clash=True)
    kept = qr.keep_good(docs, odd.labels(spark))
    assert kept.columns == docs.columns
    want = sum(r["kept"] for r in qr.quality_rules(docs, odd.labels(spark)).collect())
    assert kept.count() == want > 0


def test_rules_query_against_brute_force(spark):
    from cohortcart.llm.queries import op9_quality_rules, table

    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    marks = {}
    for r in table(spark, sf, "labels").collect():
        marks.setdefault(r["doc_id"], []).append(r["quality"] == 1 and r["toxic"] == 0)
    check_rules(op9_quality_rules(spark, sf).collect(), rows, {k for k, v in marks.items() if all(v)}, qr.RuleSettings())


def test_isotonic_pools_violators():
    at, rate = qc.isotonic(np.array([0., 1, 2, 3]), np.array([1., 1, 2, 1]), np.array([0., 1, 0, 1]))
    assert rate.tolist() == [0, 1 / 3, 1] and at.tolist() == [0, pytest.approx(5 / 3), 3]


def test_classifier_normal_sums_equal_whole_matrix(spark):
    sample = qc.labelled_statistics(odd.documents(spark), odd.labels(spark), qc.ClassifierSettings()).cache()
    sums = qc._normal_sums(sample, lambda x: np.hstack([x, np.ones((len(x), 1))]), len(qc.STATISTICS) + 1)
    rows = sample.toPandas()
    z = np.hstack([rows[list(qc.STATISTICS)].to_numpy(), np.ones((len(rows), 1)), rows[["y"]].to_numpy()])
    np.testing.assert_allclose(sum(sums.values()), z.T @ z, rtol=1e-9)
    assert qc.HELD_OUT_FOLD not in sums


def test_classifier_on_odd_documents(spark):
    docs = odd.documents(spark, clash=True)
    out = qc.quality_scores(docs, odd.labels(spark)).collect()
    assert len(out) == len(odd.rows())
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    kept = qc.keep_good(docs, odd.labels(spark))
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in out)


def test_classifier_without_labels_one_kind_and_empty(spark):
    labels = odd.labels(spark)
    assert {r["score"] for r in qc.quality_scores(odd.documents(spark), labels.where("false")).collect()} == {0.5}
    assert {r["score"] for r in qc.quality_scores(odd.documents(spark), labels.where("quality = 1")).collect()} == {1.0}
    assert qc.quality_scores(odd.empty(spark), labels).count() == 0


def test_classifier_held_out_accuracy(spark):
    from cohortcart.llm.queries import op2_quality_classifier, table

    sf = "/root/testdata/sf0.01"
    marks = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    rows = [r for r in op2_quality_classifier(spark, sf).collect() if r["held_out"] and r["doc_id"] in marks]
    right = sum(r["predicted"] == marks[r["doc_id"]] for r in rows)
    assert right >= 0.95 * len(rows)
    good = [r["score"] for r in rows if marks[r["doc_id"]]]
    bad = [r["score"] for r in rows if not marks[r["doc_id"]]]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.97


def test_one_id_on_many_texts_is_bounded_and_spread(spark):
    """Two fifths of all rows share an id; the sample stays bounded by rows and no task gets them all."""
    text = F.concat_ws(" ", *[F.concat(F.lit("w"), (F.col("id") * k % 97).cast("string")) for k in range(1, 9)],
                       F.expr("repeat('z ', int(id % 50))"))
    docs = spark.range(3000).select(F.when(F.col("id") % 5 < 2, F.lit(4)).otherwise(F.col("id") + 10).alias("doc_id"),
                                    text.alias("text"))
    labels = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"),
                                      F.lit(0).alias("toxic"))
    settings = qc.ClassifierSettings(max_labelled=400)
    sample = qc.labelled_statistics(docs, labels, settings)
    assert 100 < sample.count() < 600
    everything = qc.labelled_statistics(docs, labels, qc.ClassifierSettings())
    sizes = [r["count"] for r in everything.repartition(16, "deal").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * sum(sizes) / 16
    assert qc.quality_scores(docs, labels, settings).count() == 3000


def test_scores_equal_a_plain_fit(spark):
    """Ridge, calibration and scores from all labelled rows at once, without partitions or folds' sums."""
    docs, labels, settings = odd.documents(spark), odd.labels(spark), qc.ClassifierSettings(features=24)
    model = qc.fit_classifier(docs, labels, settings)
    rows = qc.labelled_statistics(docs, labels, settings).toPandas()
    x, y, folds = rows[list(qc.STATISTICS)].to_numpy(), rows["y"].to_numpy(), rows["fold"].to_numpy()
    assert np.allclose(model.mean, x.mean(axis=0), rtol=1e-6)
    z = model.lifted(x)

    def ridge(some, penalty):
        a = z[some].T @ z[some] + np.diag(np.append(np.full(z.shape[1] - 1, penalty * some.sum()), 1e-9 * some.sum()))
        return np.linalg.solve(a, z[some].T @ y[some])

    errors = {p: sum(((z[folds == k] @ ridge(folds != k, p) - y[folds == k]) ** 2).sum() for k in set(folds)) for p in qc.PENALTIES}
    best = min(errors, key=errors.get)
    assert np.allclose(model.weights[:, -1], ridge(np.ones(len(y), dtype=bool), best), atol=1e-6)
    left_out = np.array([z[i] @ ridge(folds != folds[i], best) for i in range(len(y))])
    bins = np.round(np.clip(left_out, -1, 2) * qc.CALIBRATION_BINS).astype(int)
    at = sorted(set(bins))
    steps = qc.isotonic(np.array(at) / qc.CALIBRATION_BINS, np.array([float((bins == b).sum()) for b in at]),
                        np.array([y[bins == b].sum() for b in at]))
    stats = docs.select("doc_id", "text", qc.statistics(F.col("text")).alias("s")).select("doc_id", "text", "s.*").toPandas()
    want = np.clip(np.interp(model.lifted(stats[list(qc.STATISTICS)].to_numpy()) @ model.weights[:, -1], *steps), 0, 1)
    got = qc.quality_scores(docs, labels, settings).toPandas()
    assert np.allclose(sorted(got["score"]), sorted(want), atol=1e-3)
    assert (got["predicted"] == (got["score"] >= settings.keep_at)).all()
