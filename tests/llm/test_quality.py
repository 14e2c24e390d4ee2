import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm.queries import op4_quality_rules
from tessella.llm.quality import STATISTICS, fit_rules, held_out, lasso, quality_scores, statistics, train

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in op4_quality_rules(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    test = [d for d in labels if got[d].held_out]
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d in got)
    assert np.mean([got[d].predicted == labels[d] for d in test]) > 0.9
    good, bad = ([got[d].score for d in test if labels[d] == y] for y in (1, 0))
    assert np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good]) > 0.85
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


def test_column_equals_model(spark):
    rng = np.random.default_rng(1)
    x = rng.random((400, len(STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.4)).astype(float)
    model = fit_rules(x, y)
    assert 0 < len(model.rules) < 120 and ((model.score(x) > 0.5) == (y > 0)).mean() > 0.97
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], ", ".join(["i int", *(f"stat_{s} double" for s in STATISTICS)]))
    got = [r.s for r in rows.select("i", model.column().alias("s")).orderBy("i").collect()]
    assert np.allclose(got, model.score(x))


def test_lasso_drops_noise():
    rng = np.random.default_rng(2)
    z = rng.integers(0, 2, (500, 20)).astype(float)
    _, w = lasso(z, (z[:, 3] > 0).astype(float), 0.02)
    assert abs(w[3]) > 1 and (np.abs(np.delete(w, 3)) < 0.05).all()


def test_statistics_by_hand():
    s = dict(zip(STATISTICS, statistics(pa.array(["AB cd cd! 12|\n", ""]))[0], strict=True))
    assert s["upper"] == 2 / 6 and s["digits"] == 2 / 14 and s["bangs"] == 1 / 14 and s["lines"] == 1 / 14
    assert s["log_words"] == pytest.approx(np.log1p(4)) and s["distinct_words"] == 1.0
    assert (statistics(pa.array([""]))[0] == 0).all()


def slow_statistics(text):
    """The statistics by their names, in plain Python."""
    data, w = text.encode(), re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    size, n = max(len(data), 1), max(len(w), 1)
    count = lambda b: sum(data.count(bytes([c])) for c in b)
    upper, lower = count(range(65, 91)), count(range(97, 123))
    triples = list(zip(w, w[1:], w[2:]))
    out = {"log_bytes": math.log1p(len(data)), "log_words": math.log1p(len(w)), "word_bytes": sum(map(len, w)) / n, "upper": upper / max(upper + lower, 1)}
    out |= {"digits": count(b"0123456789") / size, "marks": count(b"#$%&*@^~<>{}[]\\=+_") / size, "bangs": count(b"!?") / size, "bars": count(b"|") / size, "stops": count(b".,;:") / size, "lines": count(b"\n") / size}
    out |= {"high": sum(c > 127 for c in data) / size, "distinct_words": len(set(w)) / n, "distinct_triples": len(set(triples)) / max(len(triples), 1)}
    return out | {"top_word": max(map(w.count, set(w)), default=0) / n}


def test_scores_by_plain_python(spark, docs, corpus):
    """Every score is that of the learnt rules over statistics that are computed independently."""
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = train(table, spark.read.parquet(f"{SF}/labels.parquet"))
    assert model.rules
    for rows in (quality_scores(table, model).collect(), quality_scores(docs, model).collect()):
        for r in rows:
            s = slow_statistics(r.text or "")
            raw = model.intercept + sum(w for rule, w in model.rules if all((s[STATISTICS[i]] > t) == above for i, above, t in rule.terms))
            assert r.score == pytest.approx(1 / (1 + math.exp(-raw)), abs=1e-9) and r.predicted == int(r.score >= 0.7)


def test_defined_results(spark, docs, corpus, empty):
    labels = spark.createDataFrame([(i, j % 2, 0) for j, (i, _, _) in enumerate(corpus)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = train(docs, labels)
    out = quality_scores(docs, model)
    assert out.count() == len(corpus) and out.columns == [*docs.columns, "score", "predicted"]
    assert quality_scores(empty, model).count() == 0
    none = train(docs, labels.where("false"))
    assert {r.predicted for r in quality_scores(docs, none).collect()} == {1}
    one = quality_scores(docs, train(docs, labels.where("quality = 0"))).select("score").distinct().collect()
    assert len(one) == 1 and one[0].score < 0.5
    assert docs.where(held_out(docs.doc_id)).count() == sum(zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in corpus)
