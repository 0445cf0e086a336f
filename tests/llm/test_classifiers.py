import zlib

import numpy as np

from quire.llm import quality, toxicity


def accuracy(spark, sf, module, label, folds, held):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = module.classify(docs, module.train(docs, labels)).collect()
    marks = {r["doc_id"]: r[label] for r in labels.collect()}
    assert len(found) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held) for r in found)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    own = [r["predicted"] == marks[r["doc_id"]] for r in found if r["held_out"] and r["doc_id"] in marks]
    return np.mean(own)


def test_quality_held_out(spark):
    assert accuracy(spark, "/root/testdata/sf0.01", quality, "quality", 3, 1) > 0.97


def test_toxicity_held_out(spark):
    """Of 97 toxic rows a few carry no abuse at all; the answer 0 everywhere has a recall of 0 and an accuracy of 0.88."""
    sf = "/root/testdata/sf0.1"
    assert accuracy(spark, sf, toxicity, "toxic", 5, 0) > 0.975
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    own = toxicity.classify(docs, toxicity.train(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    toxic = [r["predicted"] for r in own if r["toxic"] == 1]
    assert sum(toxic) >= 0.88 * len(toxic) and sum(r["predicted"] for r in own if r["toxic"] == 0) <= 0.005 * len(own)


def test_label_model_by_hand():
    """Two honest voters, one that speaks at random, and rows that none speaks of: the random one gets a small weight."""
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.2
    a, b, noise = truth & (rng.random(4000) < 0.7), truth & (rng.random(4000) < 0.6), rng.random(4000) < 0.1
    label = np.where(rng.random(4000) < 0.3, truth, -1)
    votes = np.stack([a, b, noise, ~(a | b | noise), label == 1, label == 0], 1).astype(float)
    model = toxicity.label_model(votes, np.ones(4000), np.array([1, 1, 1, -1, 1, -1]))
    assert min(model.on[0], model.on[1]) > 3 and model.on[2] < min(model.on[0], model.on[1]) / 4 and model.on[3] < -1
    assert abs(model.posterior(votes).sum() - truth.sum()) < 0.15 * truth.sum()


def test_discriminant_is_a_log_density_difference():
    rng = np.random.default_rng(0)
    x, y = np.vstack([rng.normal(0, 1, (200, 3)), rng.normal(1, 2, (300, 3))]), np.repeat([0, 1], [200, 300])
    model = quality.fit(x, y, pooled=0.0, ridge=0.0)
    dens = []
    for c in (0, 1):
        own = x[y == c]
        shared = sum((x[y == k] - x[y == k].mean(0)).T @ (x[y == k] - x[y == k].mean(0)) for k in (0, 1)) / len(x)
        w = 3 / (3 + len(own))
        cov = (1 - w) * np.cov(own.T, bias=True) + w * shared
        off = x - own.mean(0)
        dens.append(np.log((len(own) + 0.5) / 501) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(dens[0] - dens[1])))


def edge_rows(spark):
    docs = spark.createDataFrame([(1, "fine text here", 1.0), (1, "fine text here", 1.0), (2, None, 2.0), (None, "", 3.0), (3, "x" * 200_000, None)], "doc_id long, text string, score double")
    return docs, spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 1, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")


def test_edges(spark):
    docs, labels = edge_rows(spark)
    for module, keep in ((quality, quality.keep_good), (toxicity, toxicity.drop_toxic)):
        for marks in (labels, labels.limit(0)):
            model = module.train(docs, marks)
            assert module.classify(docs, model).count() == 5
            assert module.classify(docs.limit(0), model).count() == 0
            assert keep(docs, model).columns == docs.columns


def test_voters(spark):
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 1
        words = ["calm", "river", "stone", f"w{i}"] * 5 + (["zorgel" + "abcdef"[i % 6]] if bad and i % 2 else ["Idiot!"] if bad else [])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = {r["doc_id"]: r["predicted"] for r in toxicity.classify(docs, model).collect()}
    assert found == {i: int(i % 5 == 1) for i in range(600)}
    assert model.score("an imbecile") > 0.5 and model.score("") < 0.5 and model.score("a zorgelious") > 0.5
