"""What keeps queries inside their limits of time and disk."""

import numpy as np

from mnemospark.operators import mixing, similarity_lsh


def test_all_pairs_by_packed_blocks(spark, monkeypatch):
    """Every pair at the threshold, each once, with several packs; bands take part only beyond the bound."""
    x = np.random.default_rng(2).integers(-3, 4, (9000, 6)).astype(float)
    x = x[np.abs(x).sum(axis=1) > 0]
    rows = spark.createDataFrame([(3 * k, v.tolist()) for k, v in enumerate(x)], "id long, vector array<double>").repartition(3)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(np.round(unit @ unit.T, 6) >= 0.995, 1))
    monkeypatch.setattr(similarity_lsh, "candidates", None)
    got = [(r.a, r.b) for r in similarity_lsh.similar_pairs(rows, 0.995, whole=9000).collect()]
    assert len(got) == len(set(got)) and set(got) == {(3 * int(a), 3 * int(b)) for a, b in zip(i, j, strict=True)}
    assert similarity_lsh.similar_pairs(rows.limit(0), 0.9, whole=1).collect() == []


def test_label_contrasts_place_rows_by_keys_alone(spark, monkeypatch):
    """No text is sorted or written to number the rows; rows alike in all columns stay rows of their own."""
    seen, real = [], mixing.prefix
    monkeypatch.setattr(mixing, "prefix", lambda df, *a, **k: seen.append(df.columns) or real(df, *a, **k))
    rows = [(k % 3, "ab"[k % 2], f"t{k % 6}", None) for k in range(12)]
    got = mixing.label_contrasts(spark.createDataFrame(rows, "id long, label string, t string, more string"), "label", "t", ["id"], 2).collect()
    assert len(seen) == 2 and not any({"t", "more"} & set(c) for c in seen)
    assert sorted((r.id, r.label, r.t) for r in got) == sorted(r[:3] for r in rows)
    of = {t: label for _, label, t, _ in rows}
    assert all(r.n_label == 6 and r.more is None and of[r.same] == r.label and [of[t] != r.label for t in r.others] == [True] * 2 for r in got)
