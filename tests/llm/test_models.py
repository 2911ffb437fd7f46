import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import entries, quality_crf, toxicity

SF = "/root/testdata/sf0.1"


def held_out(spark, query, label):
    out = query(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label), "doc_id").where("held_out").toPandas()
    y, s = out[label].to_numpy(), out["score"].to_numpy()
    order = np.argsort(np.argsort(s, kind="stable"), kind="stable") + 1
    n1 = y.sum()
    return out, (order[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_toxicity_of_held_out_documents(spark):
    out, auc = held_out(spark, entries.op5_toxicity, "toxic")
    hit = out["predicted"] == 1
    assert auc > 0.92 and (out["predicted"] == out["toxic"]).mean() > 0.96
    assert out["toxic"][hit].mean() > 0.85 and hit[out["toxic"] == 1].mean() > 0.9


def test_quality_of_held_out_documents(spark):
    out, auc = held_out(spark, entries.op7_quality, "quality")
    assert auc > 0.99 and (out["predicted"] == out["quality"]).mean() > 0.98


@pytest.mark.parametrize("module, column", [(toxicity, "toxic"), (quality_crf, "quality")])
def test_odd_rows_and_missing_labels(spark, odd_docs, no_docs, labels, module, column):
    for told in (labels, labels.limit(0), labels.withColumn(column, F.lit(1))):
        model = module.fit(odd_docs, told)
        out = module.score(odd_docs, model, "found").collect()
        assert len(out) == odd_docs.count() and all(0 <= r.found <= 1 for r in out)
        assert len({r.found for r in out if not r.text}) == 1
        assert module.score(no_docs, model, "found").count() == 0
    kept = module.reject(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() <= odd_docs.count()


def test_labels_of_held_out_rows_are_never_read(spark):
    docs, told = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    for module, column in ((toxicity, "toxic"), (quality_crf, "quality")):
        m, r = module.HELD_OUT
        out = F.crc32(F.col("doc_id").cast("string")) % m == r
        flipped = told.withColumn(column, F.when(out, 1 - F.col(column)).otherwise(F.col(column)))
        some = docs.limit(50).cache()
        a, b = ({x.doc_id: x.s for x in module.score(some, module.fit(docs, t), "s").collect()} for t in (told, flipped))
        assert a == pytest.approx(b)


def test_label_model_finds_the_class():
    r = np.random.default_rng(0)
    y = r.random(4000) < 0.15
    votes = np.zeros((4000, 9), int)
    for k in range(6):
        votes[:, k] = (r.random(4000) < np.where(y, 0.5, 0.01)).astype(int)
    votes[:, 6] = votes[:, 0]  # tells the same again
    votes[:, 7] = r.random(4000) < 0.1  # tells nothing
    votes[:, 8] = -(votes[:, :6] == 0).all(1).astype(int)
    model = toxicity.LabelModel.fit(votes)
    p = model.posterior(votes)
    assert ((p > 0.5) == y).mean() > 0.94 and abs(model.prior - y.mean()) < 0.05
    assert model.parent[6] == 0 or model.parent[0] == 6
    once = toxicity.LabelModel.fit(votes[:, [0, 1, 2, 3, 4, 5, 7, 8]]).posterior(votes[:, [0, 1, 2, 3, 4, 5, 7, 8]])
    assert np.abs(p - once).mean() < 0.01  # told twice, the evidence counts once


def test_posterior_follows_the_joint_distribution():
    """The posterior of every vote pattern, from products of class balance and tables along the forest."""
    r = np.random.default_rng(2)
    table = r.random((2, 3, 3, 3)) + 0.1
    table /= table.sum(3, keepdims=True)
    model = toxicity.LabelModel(0.3, np.array([-1, 0, 0]), table)
    votes = np.array([(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])
    joint = [[w * table[y][0, 1, a + 1] * table[y][1, a + 1, b + 1] * table[y][2, a + 1, c + 1] for a, b, c in votes] for y, w in ((0, 0.7), (1, 0.3))]
    assert np.allclose(sum(map(sum, joint)), 1.0)
    assert np.allclose(model.posterior(votes), np.array(joint[1]) / np.sum(joint, axis=0))


def test_forest_links_dependent_voters_without_a_circle():
    r = np.random.default_rng(3)
    y = r.random(3000) < 0.3
    votes = (r.random((3000, 6)) < np.where(y, 0.6, 0.1)[:, None]).astype(int)
    for k, of in ((3, 0), (4, 0), (5, 3)):
        same = r.random(3000) < 0.8
        votes[same, k] = votes[same, of]
    p = y.astype(float)
    shared = toxicity.mutual_information(votes, p)
    slow = 0.0
    for q in (p, 1 - p):
        for a in (0, 1):
            for b in (0, 1):
                both = q[(votes[:, 0] == a) & (votes[:, 3] == b)].sum()
                slow += both * np.log(both * q.sum() / q[votes[:, 0] == a].sum() / q[votes[:, 3] == b].sum())
    assert shared[0, 3] == pytest.approx(slow)
    parent = toxicity.forest(votes, p)
    assert {frozenset((k, int(v))) for k, v in enumerate(parent) if v >= 0} == {frozenset((0, 3)), frozenset((0, 4)), frozenset((3, 5))}


def test_toxicity_without_labels_and_with_few():
    """The fixed words and patterns decide where nothing was mined; scores keep to them where nothing was seen."""
    m = len(toxicity.INSULTS)
    model = toxicity.ToxicityModel(tuple((w, False) for w in toxicity.INSULTS), np.r_[-4.0, np.zeros(m), 8.0, np.zeros(4), 2.0, 4.0, 6.0, 2.0])
    bad = ["You are such a pathetic loser", "I will find you", "what IDIOTS", "you deserve to die"]
    fine = ["", "The work of the world is plain prose.", "Shut the door and get out of the rain.", "50% of f(x) = a*b"]
    assert (model.score(bad) >= 0.7).all() and (model.score(fine) < 0.2).all()


def test_samples_are_bounded_and_take_an_id_once(spark):
    from quillon.llm.batches import labelled_sample

    docs = spark.createDataFrame([(k % 40, f"text {k}") for k in range(4000)], "doc_id long, text string")
    told = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(0, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    rows = labelled_sample(docs, told, "toxic", 10_000, (3, 1)).collect()
    wanted = [k for k in range(40) if zlib.crc32(str(k).encode()) % 3 != 1]
    assert sorted(int(r.text.split()[1]) % 40 for r in rows) == wanted
    assert {int(r.text.split()[1]) % 40: r.label for r in rows} == {k: 1 if k == 0 else k % 2 for k in wanted}


def test_long_documents_are_learnt_from_too(spark):
    """With fewer lines than documents have, a share of the documents is taken, whatever their length."""
    good, bad = "plain words of prose in a line.", "%% $$ && ## @@ ** ^^ %%"
    docs = spark.createDataFrame([(k, "\n".join(f"{good if k % 2 else bad} {k} {j}" for j in range(1500 if k % 4 < 2 else 3))) for k in range(200)], "doc_id long, text string")
    told = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")
    model = quality_crf.fit(docs, told, max_lines=40_000)
    out = {r.doc_id: r.s for r in quality_crf.score(docs, model, "s").collect()}
    assert all((out[k] >= 0.7) == (k % 2 == 1) for k in out)


def test_document_quality_falls_with_the_weighted_share_of_bad_lines():
    r = np.random.default_rng(4)
    model = quality_crf.QualityModel(r.normal(size=3 * quality_crf.N_OWN + 3), r.normal(size=(2, 2)), np.array([0.5, -1.3]))
    texts = ["\n".join(r.choice(["a line of words here.", "%% $$", "WORD WORD", "x"], size=r.integers(1, 9))) for _ in range(60)] + ["", "\n\n"]
    feats = [quality_crf.line_features(t) for t in texts]
    want = []
    for f in feats:
        x = quality_crf.with_neighbours(f[:, 1:].astype(float), np.array([0])) @ model.weights
        p = quality_crf.marginals(x, np.array([0]), np.array([len(f)]), model.trans)[0]
        mean = np.clip((f[:, 0] * p).sum() / f[:, 0].sum(), 0.001, 0.999)
        want.append(1 / (1 + np.exp(-(0.5 - 1.3 * np.log(mean / (1 - mean))))))
    assert np.allclose(model.score(texts), want)


def test_training_climbs_to_the_likelihood_s_top():
    """At the weights that training finds the gradient of the penalised log-likelihood, by differences, is about nothing."""
    r = np.random.default_rng(5)
    lengths = np.array([3, 2, 4, 5, 1])
    starts = np.cumsum(lengths) - lengths
    x, y = r.normal(size=(15, 4)), r.integers(0, 2, 15)

    def objective(par):
        _, _, log_z = quality_crf.marginals(x @ par[:4], starts, lengths, par[4:].reshape(2, 2))
        told = (x @ par[:4])[y == 1].sum() + sum(par[4:].reshape(2, 2)[y[s + k], y[s + k + 1]] for s, n in zip(starts, lengths) for k in range(n - 1))
        return (told - log_z) / len(y) - 0.5 * 0.01 * (par**2).sum()

    weights, trans = quality_crf._train(x, y, starts, lengths, steps=3000, l2=0.01)
    par = np.r_[weights, trans.ravel()]
    slope = [(objective(par + 1e-4 * e) - objective(par - 1e-4 * e)) / 2e-4 for e in np.eye(len(par))]
    assert np.abs(slope).max() < 0.01


def test_marginals_equal_enumeration():
    r = np.random.default_rng(1)
    lengths = np.array([3, 1, 4])
    starts = np.cumsum(lengths) - lengths
    bad, trans = r.normal(size=8), r.normal(size=(2, 2))
    p, counts, log_z = quality_crf.marginals(bad, starts, lengths, trans)
    want, told, z = np.zeros(8), np.zeros((2, 2)), 0.0
    for s, n in zip(starts, lengths):
        paths = [[(k >> i) & 1 for i in range(n)] for k in range(1 << n)]
        w = np.array([np.exp(sum(bad[s + i] for i in range(n) if q[i]) + sum(trans[q[i], q[i + 1]] for i in range(n - 1))) for q in paths])
        z += np.log(w.sum())
        for q, x in zip(paths, w / w.sum()):
            want[s : s + n] += x * np.array(q)
            for i in range(n - 1):
                told[q[i], q[i + 1]] += x
    assert np.allclose(p, want) and np.allclose(counts, told) and np.isclose(log_z, z)


def test_pipeline_over_odd_rows(spark, tmp_path, odd_docs, no_docs, labels):
    """Nulls, repeated ids and rows, an empty and a long text, clashing columns; and an empty table: end to end."""
    for name, docs, told in (("odd", odd_docs, labels), ("none", no_docs, labels.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        told.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        stage = docs
        for _, f in corpus_pipeline.STAGES[:-1]:
            stage = f(spark, stage, f"{tmp_path}/{name}")
            assert stage.columns == docs.columns
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        kept = stage.collect()
        assert sorted(str(r.doc_id) for r in out if r.piece == 0) == sorted(str(r.doc_id) for r in kept)
    assert not out


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns
        docs = spark.createDataFrame(after.collect(), docs.schema)
        assert 0.6 * before < docs.count() < before, name
        before = docs.count()
    assert docs.select("text").distinct().count() == before
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.select("doc_id").distinct().count() == before


@pytest.mark.parametrize("kinds", [(), (0,), (1,)])
def test_quality_keeps_all_without_labels_of_both_kinds(odd_docs, labels, kinds):
    kept = quality_crf.reject(odd_docs, labels.where(labels["quality"].isin(*kinds)) if kinds else labels.limit(0))
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
