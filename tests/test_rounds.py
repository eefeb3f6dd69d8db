import random

import numpy as np
import pytest

from inkgraph.operators import ensemble, evaluate

RECORD = "page int, run_id int, record_ord int, x1 int, y1 int, x2 int, y2 int, confidence double, name string"


def sequential(rows, least, differ):
    out = []
    for page in {r[0] for r in rows}:
        todo = sorted(r for r in rows if r[0] == page)
        free = [True] * len(todo)
        for i, a in enumerate(todo):
            if not free[i]:
                continue
            best = a
            for j, b in enumerate(todo):
                if not free[j] or b[1] <= a[1]:
                    continue
                w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
                if w <= 0 or h <= 0:
                    continue
                size = [(r[5] - r[3], r[6] - r[4]) for r in (a, b)]
                union = sum(x * y for x, y in size) - w * h
                if w * h / union > least and all(abs(size[0][k] - size[1][k]) < differ * min(size[0][k], size[1][k]) for k in (0, 1)):
                    free[j] = False
                    best = b if b[7] > best[7] else best
            out.append(best)
    return sorted(out)


@pytest.mark.parametrize(("seed", "runs"), [(1, 2), (2, 5), (3, 12)])
def test_claims_equal_the_sequential_form(spark, seed, runs):
    rng = random.Random(seed)
    rows = []
    for k in range(220):
        x, y = rng.randint(0, 40), rng.randint(0, 40)
        rows.append((rng.randint(1, 3), rng.randrange(runs), k, x, y, x + rng.randint(0, 25) + 10, y + rng.choice([0, 12, 20]), rng.choice([0.1, 0.5, 0.7, 0.9]), f"r{k}"))
    got = ensemble.claim(spark.createDataFrame(rows, RECORD), ["page"], least=0.3, differ=0.6)
    want = sequential(rows, 0.3, 0.6)
    assert got.columns == RECORD.replace(" int", "").replace(" double", "").replace(" string", "").split(", ")
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) < len(rows)
    assert ensemble.claim(spark.createDataFrame([], RECORD), ["page"]).count() == 0


def test_a_long_chain_of_rivals(spark):
    rows = [(1, k, 0, 4 * k, 0, 4 * k + 10, 10, 0.5, "") for k in range(15)]  # each overlaps the next only
    got = ensemble.claim(spark.createDataFrame(rows, RECORD), ["page"], least=0.3, differ=0.5)
    assert sorted(r.run_id for r in got.collect()) == list(range(0, 15, 2))


def scored_results(spark, seed):
    rng = random.Random(seed)
    rows = []
    for doc in range(12):
        for res in rng.sample(range(5), rng.randint(1, 5)):
            for _ in range(rng.randint(1, 4)):
                rows.append((f"f{doc}", res, f"k{rng.randrange(4)}", rng.randrange(2), [float(rng.randint(-2, 3)) for _ in range(4)]))
    return spark.createDataFrame(rows, "file_id string, res_iter int, identity_key string, target int, features array<double>")


@pytest.mark.parametrize("seed", [1, 2])
def test_means_score_a_crowd_as_the_records_do(spark, seed):
    results = scored_results(spark, seed)
    rng = np.random.default_rng(seed)
    crowd = np.round(rng.uniform(-1, 1, (4, 30)), 1)  # ties and zeros
    crowd[:, 0] = 0
    total = results.where("target = 1").select("file_id", "identity_key").distinct().count()
    got = evaluate.hits(evaluate.feature_means(results), crowd)
    table = spark.createDataFrame([(i, crowd[:, i].tolist()) for i in range(30)], "candidate int, weights array<double>")
    scored = results.crossJoin(table).withColumn("score", evaluate.dot("features", "weights"))
    want = {r.candidate: r.recall for r in evaluate.model_recall(scored, total, by=["candidate"]).collect()}
    assert {i: n / total for i, n in enumerate(got.tolist())} == pytest.approx(want) and len(set(want.values())) > 3


def test_training_reads_the_records_once(spark):
    results = scored_results(spark, 5)
    total = results.where("target = 1").select("file_id", "identity_key").distinct().count()
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    counted = results.mapInArrow(count, results.schema)
    w, recall = evaluate.train_weights(counted, total, ideal=1.1, size=4, population=10, elite=2, rounds=12, seed=3)
    assert seen.value == 2 * results.count()  # means, and right keys; not twelve rounds of ten candidates
    again = results.withColumn("score", evaluate.dot("features", evaluate.F.array(*[evaluate.F.lit(float(x)) for x in w])))
    assert evaluate.model_recall(again, total).first()[0] == pytest.approx(recall)
