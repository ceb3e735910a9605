"""Quality, language identification and embedding near-dedup."""

from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from brute import union

from folioflow.llm import langid, quality, shared, vectors

SF = "/root/testdata/sf0.01"
given = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not mounted")


def test_the_discriminant_equals_gaussian_densities():
    rng = np.random.default_rng(1)
    x = [rng.normal(c, 1 + c, (200, 3)) for c in range(2)]
    model = quality.fit(
        np.array([200.0, 200.0]), np.array([v.sum(0) for v in x]), np.array([v.T @ v for v in x])
    )
    means = [v.mean(0) for v in x]
    own = [np.cov(v.T) for v in x]
    pooled = sum((199 / 398) * s for s in own)
    pooled = 0.95 * pooled + 0.05 * np.diag(np.diag(pooled)) + 1e-6 * np.eye(3)
    logs = []
    for c in range(2):
        s = 0.9 * own[c] + 0.1 * pooled
        d = x[1] - means[c]
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1])
    assert np.allclose(model.scores(x[1]), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_statistics_do_not_depend_on_neighbours():
    texts = ["", None, "Short one.", "A\nB\n\n", "ÜBER 9!! $$$ " * 3000, "x"]
    together = quality.statistics(pa.array(texts))
    alone = np.vstack([quality.statistics(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(together, alone) and np.isfinite(together).all()
    assert (together[0] == together[1]).all()


@given
def test_quality_holds_on_documents_it_has_not_learnt_from(spark):
    from folioflow.llm.quality import op2_quality

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op2_quality(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    judged = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p == q for p, q in judged]) > 0.97
    assert np.mean([p for p, q in judged if q == 1]) > 0.97


def test_quality_with_few_labels_and_odd_rows(spark):
    documents = spark.createDataFrame(
        [(1, "one text", "a"), (2, None, "b"), (None, "", "c"), (2, "again " * 9000, "d")], "doc_id bigint, text string, score string"
    )
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 0), (99, 0)], "doc_id bigint, quality int")
    model = quality.fit_quality(documents, labels)
    assert model.means is None
    scored = quality.scored(documents, model).collect()
    assert {r["score"] for r in scored} == {model.share} and len(scored) == 4
    none = quality.fit_quality(documents, labels.where("quality > 5"))
    assert none.share == 0.5
    kept = quality.accepted_documents(documents, documents, labels.where("quality > 5"))
    assert kept.columns == documents.columns and kept.count() == 4
    assert quality.scored(documents.where("doc_id > 9"), none).count() == 0


@given
def test_languages_hold_on_documents_they_were_not_learnt_from(spark):
    rows = langid.op9_language(spark, SF).collect()
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(langs)
    judged = [r["lang_pred"] == langs[r["doc_id"]] for r in rows if r["held_out"]]
    assert np.mean(judged) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_languages_with_odd_rows(spark):
    rows = [(i, t * (i % 5 + 1), lang) for i in range(60) for t, lang in (("the words and the ", "en"), ("der die und das ", "de"))]
    odd = [(500, None, "en"), (501, "", None), (502, "123 !?", "de"), (None, "the words", "en"), (503, "the and " * 9000, None), (503, "the", None)]
    table = spark.createDataFrame([(*r, 1) for r in rows + odd], "doc_id bigint, text string, lang string, mark int")
    model = langid.fit_languages(table)
    assert model.languages == ["de", "en"]
    out = {(r["doc_id"], i): r for i, r in enumerate(langid.predicted_languages(table, model).collect())}
    answer = {d: r["lang_pred"] for (d, _), r in out.items()}
    assert (answer[500], answer[501], answer[502], answer[None], answer[503]) == ("und", "und", "und", "en", "en")
    assert {r["score"] for (d, _), r in out.items() if d in (500, 501, 502)} == {0.0} and len(out) == len(rows + odd)
    assert langid.fit_languages(table.where("lang = 'xx'")) is None
    unknown = langid.predicted_languages(table, None).collect()
    assert {r["lang_pred"] for r in unknown} == {"und"} and len(unknown) == len(out)
    one = langid.fit_languages(table.where("lang = 'en'"))
    assert {r["lang_pred"] for r in langid.predicted_languages(table.where("text = 'the'"), one).collect()} == {"en"}


def test_temperature_and_leader_prefer_what_fits():
    rng = np.random.default_rng(2)
    labels = rng.integers(0, 2, 200)
    cells = [np.array([y * 10 + 1, 5]) for y in labels]
    weights = langid.ftrl(cells, [np.array([0.8, 0.6])] * 200, labels, 2)
    assert weights[1, 0] > weights[1, 1] and weights[11, 1] > weights[11, 0]
    assert np.count_nonzero(weights) <= 6
    sure = np.where(labels[:, None] == np.arange(2), 1.0, 0.0)
    noisy = sure.copy()
    noisy[::3] = noisy[::3, ::-1]
    assert langid._temperature(sure, labels) < langid._temperature(noisy, labels)


def test_multi_sequence_visits_in_order_of_the_sum():
    rng = np.random.default_rng(3)
    a, b = rng.random(9), rng.random(7)
    got = list(vectors.multi_sequence(a, b, np.argsort(a), np.argsort(b), 63))
    sums = [a[i] + b[j] for i, j in got]
    assert sums == sorted(sums) and len(set(got)) == 63


def test_near_vectors_equal_brute_force(spark, monkeypatch):
    # small blocks and cells, so that cells are split and visited
    monkeypatch.setattr(vectors, "RESIDENTS", 20)
    monkeypatch.setattr(vectors, "VISITORS", 30)
    monkeypatch.setattr(vectors, "PER_CELL", 8)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16))
    rows = [(int(i), [float(v) for v in base[i % 12] + rng.normal(0, 0.03 + 0.02 * (i % 5), 16)]) for i in range(300)]
    rows += [(1000 + i, [2 * v for v in rows[0][1]]) for i in range(70)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [None] * 16),
             (2005, [float("inf")] * 16), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (2008, [1.0]), (1000, rows[0][1]), (None, rows[0][1])]
    table = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id bigint, embedding array<float>, label int, fp string")
    out = vectors.near_vectors(table, shared.Scratch(spark)).collect()
    assert len(out) == len(rows)

    def unit(v):
        if not v or any(x is None for x in v):
            return None
        x = np.array(v, np.float32).astype(float)
        return x / np.linalg.norm(x) if np.isfinite(x).all() and x.any() else None

    units = [None if i is None else unit(v) for i, v in rows]
    links, pairs = [0] * len(rows), []
    for i, x in enumerate(units):
        for j, y in enumerate(units):
            if i != j and x is not None and y is not None and len(x) == len(y) and x @ y >= 0.95:
                links[i] += 1
                pairs.append((rows[i][0], rows[j][0]))
    found = union({i for i, _ in rows if i is not None}, pairs)
    expected = sorted((str(i), n, str(found.get(i)), i is None or found[i] == i) for (i, _), n in zip(rows, links, strict=True))
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in out) == expected
    assert vectors.near_vectors(table.where("vec_id > 9999"), shared.Scratch(spark)).count() == 0


def _lone_pairs(rng, count, width, first):
    """Pairs at a cosine of 0.953."""
    rows = []
    for i in range(count):
        x = rng.normal(size=width)
        x /= np.linalg.norm(x)
        y = rng.normal(size=width)
        y -= (x @ y) * x
        y /= np.linalg.norm(y)
        rows += [(first + 2 * i, x), (first + 2 * i + 1, 0.953 * x + np.sqrt(1 - 0.953**2) * y)]
    return rows


@pytest.mark.parametrize("pairs, hot, single", [(300, 1000, 2500), (12, 0, 6000)])
def test_lone_pairs_are_found_beside_a_hot_group(spark, pairs, hot, single):
    rng = np.random.default_rng(pairs)
    rows = _lone_pairs(rng, pairs, 32, 0)
    centre = rng.normal(size=32)
    rows += [(100_000 + i, centre + rng.normal(size=32) * 0.002) for i in range(hot)]
    rows += [(200_000 + i, rng.normal(size=32)) for i in range(single)]
    table = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in rows], "vec_id bigint, embedding array<double>")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(table.repartition(8), shared.Scratch(spark)).collect()}
    assert [found[i] for i in range(2 * pairs)] == [(1, i // 2 * 2) for i in range(2 * pairs)]
    assert {found[100_000 + i] for i in range(hot)} <= {(hot - 1, 100_000)}
