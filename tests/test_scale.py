"""Kernels and picks that take the place of slower forms, against the plain definition."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import normaliser, text
from corpusloom.operators import duplicates, leakage, sampling
from corpusloom.plans.tables import stage, unstage


@pytest.mark.parametrize("lines", [True, False])
def test_grams(lines):
    rng = random.Random(1)
    for _ in range(200):
        texts = ["".join(rng.choice("ab\né漢😀 ") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 8))]
        want = collections.Counter()
        for i, t in enumerate(texts):
            for part in t.split("\n") if lines else [t]:
                want.update((i, part[k : k + n]) for n in (3, 4, 5) for k in range(len(part) - n + 1))
        grams, found = duplicates.Grams(texts, lines), []
        for n, gram, at in grams.by_size((3, 4, 5)):
            start, times = grams.distinct(gram, at)
            found += zip(zip(grams.text[start].tolist(), grams.strings(start, n).to_pylist()), times.tolist())
        assert len(found) == len(want) and dict(found) == dict(want)


def test_blocking_keys(spark, monkeypatch):
    """The keys picked in the kernel, those of the shuffled join, and the definition."""
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abcé漢😀\n ") for _ in range(rng.randrange(60)))) for i in range(150)] + [(200, None), (201, "ab"), (202, "")]
    own = {i: {part[k : k + n] for part in (t or "").split("\n") for n in (3, 4, 5) for k in range(len(part) - n + 1)} for i, t in rows}
    df = collections.Counter(g for grams in own.values() for g in grams)
    most = max(2, min(200, len(rows) * 50_000 // 1_000_000))
    want = sorted((i, g, df[g]) for i, grams in own.items() for g in sorted((g for g in grams if 2 <= df[g] <= most), key=lambda g: (df[g], -len(g), g))[:12])
    table = spark.createDataFrame(rows, "id int, text string")
    assert sorted(tuple(r) for r in duplicates.blocking_keys(table).collect()) == want
    monkeypatch.setattr(duplicates, "_mixed", lambda hi, lo: hi >> 55)  # many equal hashes
    assert sorted(tuple(r) for r in duplicates.blocking_keys(table).collect()) == want
    monkeypatch.setattr(duplicates, "BROADCAST_GRAMS", 0)
    assert sorted(tuple(r) for r in duplicates.blocking_keys(table).collect()) == want


def test_gram_counts(spark):
    rows = [(1, "aaaa  bb"), (2, None), (3, ""), (4, "ab"), (5, "abc\nabc"), (5, "abc")]
    out = duplicates.gram_counts(spark.createDataFrame(rows, "id int, text string"), (3,), within_lines=True).collect()
    assert sorted(tuple(r) for r in out) == sorted([(1, "aaa", 2), (1, "aa ", 1), (1, "a  ", 1), (1, "  b", 1), (1, " bb", 1), (5, "abc", 2), (5, "abc", 1)])


def test_exact_field_paths(spark):
    """The JVM's way for ASCII and the kernel's for all else agree with the normaliser."""
    fields = ["", None, "A b\tC\x07\r\n", "ﬁ ＡＢ ß", "x\u200b\ufe0f y", "É\u0301", "\x1f\x85z"]
    rows = spark.createDataFrame(list(enumerate(fields)), "i int, t string").withColumn("e", text.exact_field(F.col("t"))).collect()
    assert {r.i: r.e for r in rows} == {i: normaliser.exact_field(t) for i, t in enumerate(fields)}


def test_first_of_each(spark):
    rows = [(i % 3 if i % 5 else 0, i * 7919 % 1000) for i in range(1000)]
    table = spark.createDataFrame(rows, "s int, o int").withColumn("n", F.col("s") * 5 + 1)
    got = sorted((r.s, r.o, r.rank) for r in sampling.first_of_each(table, ["s"], F.col("n"), "o").collect())
    want = [(s, o, k) for s in range(3) for k, o in enumerate(sorted(o for x, o in rows if x == s)[: 5 * s + 1], 1)]
    assert got == want


def plain_controls(cases, pool, seed="controls"):
    """(id, group, band, size) rows: case by case, straight from the definition."""
    order = lambda i: hashlib.sha256(f"{seed}|{i}".encode()).hexdigest()
    out, used = {}, set()
    for key in {(c[1], c[2]) for c in cases}:
        own = sorted(c for c in cases if (c[1], c[2]) == key)
        for (i, *_), (j, *_) in zip(own, sorted((p for p in pool if (p[1], p[2]) == key), key=lambda p: order(p[0]))):
            out[i] = (j, "band")
            used.add(j)
    for i, group, _, size in sorted(cases):
        if i not in out:
            j = min((p for p in pool if p[1] == group and p[0] not in used), key=lambda p: (abs(p[3] - size), order(p[0])))[0]
            out[i] = (j, "nearest")
            used.add(j)
    return sorted((i, *x) for i, x in out.items())


def test_nearest_controls(spark):
    rng = random.Random(9)
    row = lambda i, big: (i, rng.choice("ab"), rng.randrange(4) + big, rng.randrange(8) * 10 + big)
    cases, pool = [row(i, 0) for i in range(40)], [row(1000 + i, i % 3) for i in range(120)]
    ddl = "id int, g string, band int, size int"
    out = sampling.nearest_controls(spark.createDataFrame(cases, ddl), spark.createDataFrame(pool, ddl), ["g"], "band", "size").collect()
    assert sorted((r.case, r.control, r.matching) for r in out) == plain_controls(cases, pool)
    assert {r.matching for r in out} == {"band", "nearest"} and len({r.control for r in out}) == 40
    near = [(1, "a", 9, 100), (2, "a", 9, 101)], [(i, "a", 0, n) for i, n in ((11, 1), (12, 100), (13, 101), (14, 1000))]
    out = sampling.nearest_controls(*[spark.createDataFrame(x, ddl) for x in near], ["g"], "band", "size").collect()
    assert sorted((r.case, r.control, r.difference) for r in out) == [(1, 12, 0), (2, 13, 0)]
    with pytest.raises(ValueError):
        sampling.nearest_controls(spark.createDataFrame(pool, ddl), spark.createDataFrame(cases, ddl), ["g"], "band", "size")


def test_representatives(spark):
    rows = [(1, 0, "a b"), (2, 0, "a bc"), (3, 0, "abc "), (4, 1, None), (5, 1, ""), (6, 2, None)]
    out = leakage.representatives(spark.createDataFrame(rows, "id int, root int, text string")).filter("is_representative").collect()
    assert sorted((r.root, r.id) for r in out) == [(0, 2), (1, 5), (2, 6)]


def test_unstage(spark):
    table = stage(spark.range(5), "test", sweep=True)
    assert table.count() == 5
    unstage(table)
    with pytest.raises(Exception):
        spark.read.parquet(table.staged_path)


def test_neighbours(spark, monkeypatch):
    import numpy as np

    from corpusloom.operators import neighbours

    rng = np.random.default_rng(2)
    u = rng.integers(-2, 3, (60, 3)).astype(float)  # many ties
    rows = spark.createDataFrame([(i, u[i].tolist()) for i in range(60)], "id bigint, u array<double>").repartition(5)
    queries = rows.filter("id % 7 = 0").selectExpr("id as query", "u as q")
    want = sorted((q, n, k + 1) for q in range(0, 60, 7) for k, n in enumerate(sorted((i for i in range(60) if i != q), key=lambda i: (-(u[q] @ u[i]), i))[:4]))
    assert sorted(tuple(r) for r in neighbours.nearest(rows, queries, 4).collect()) == want
    monkeypatch.setattr(neighbours, "BLOCK", 2)
    assert sorted(tuple(r) for r in neighbours.nearest(rows, queries, 4).collect()) == want
    assert neighbours.nearest(rows, queries.limit(0), 4).count() == 0


def test_strategy_limits(spark):
    from corpusloom.operators import metrics
    from corpusloom.plans import q_eval

    out = q_eval.strategy(spark, "/root/testdata/sf0.01").filter("t_keep in (0.1, 0.4) and t_exclude in (0.6, 0.9)").collect()
    assert len(out) == 4
    for r in out:
        for side, worst in (("keep", 0.95), ("exclude", 0.3)):
            limits = [metrics.clopper_pearson(r[f"{side}_{n}_errors"], r[f"{side}_{n}_n"]) for n in ("sample", "audit")]
            assert [r[f"{side}_sample_limit"], r[f"{side}_audit_limit"]] == pytest.approx(limits) and r[f"{side}_limit"] == pytest.approx(max(limits))
            assert r[f"{side}_passes"] == (r[f"{side}_sample_n"] >= 10 and max(limits) <= worst)
        assert r.passes == (r.keep_passes and r.exclude_passes and r.workload_passes)


def test_paired_bootstrap(spark):
    from corpusloom.operators import metrics

    rows = [(i, i % 60, i % 2, 0.5 + (0.3 if i % 2 else -0.3), 0.5 + (0.4 if i % 2 else -0.4)) for i in range(600)]
    out = {r.metric: r for r in metrics.paired_bootstrap(spark.createDataFrame(rows, "id int, c int, y int, a double, b double"), "c", "a", "b", "y", 200).collect()}
    assert out["d_brier"].upper < 0 and out["d_log_loss"].upper < 0 and out["d_false_positive"].median == 0 and out["d_brier"].valid == 200
    none = spark.createDataFrame([(1, 1, 0.4, 0.6)], "c int, y int, a double, b double")
    assert {r.metric for r in metrics.paired_bootstrap(none, "c", "a", "b", "y", 50).collect() if r.lower is None} >= {"d_false_positive"}


def test_near_pairs_by_sketch(spark, monkeypatch):
    """All pairs at the threshold, with their cosines, without a table of the texts' n-grams or of vectors."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randrange(3, 9))) for _ in range(3000)]
    rows = []
    for k in range(24):
        base = rng.choices(words, k=150)
        for c in range(6):  # copies with more and more other words, around the threshold
            rows.append((10 * k + c, " ".join(rng.choice(words) if rng.random() < 0.04 * c else w for w in base)))
    rows += [(1000, "a short text"), (1001, "a short text!"), (1002, None)]
    counts = {i: collections.Counter(t[k : k + n] for n in (3, 4, 5) for k in range(len(t) - n + 1)) for i, t in rows if t}
    df = collections.Counter(g for c in counts.values() for g in c)
    idf = {g: np.log((1 + len(counts)) / (1 + n)) + 1 for g, n in df.items() if 2 <= n <= int(0.995 * len(counts))}
    vectors = {i: {g: (1 + np.log(n)) * idf[g] for g, n in c.items() if g in idf} for i, c in counts.items()}
    length = {i: sum(w * w for w in v.values()) ** 0.5 for i, v in vectors.items()}
    cosine = {(a, b): sum(w * vectors[b].get(g, 0) for g, w in vectors[a].items()) / (length[a] * length[b]) for a in vectors for b in vectors if a < b}
    staged = []
    monkeypatch.setattr(duplicates, "stage", lambda df, label, *a, **b: (staged.append(label), stage(df, label, *a, **b))[1])
    table = spark.createDataFrame(rows, "id int, text string")
    found = {(r.left, r.right): r.similarity_ppm for r in duplicates.near_pairs(table).collect()}
    candidates = {(r.left, r.right) for r in duplicates.blocked_pairs(duplicates.blocking_keys(table.filter("length(text) >= 3"))).collect()}
    want = {p: cosine[p] for p in candidates if cosine[p] >= 0.8}
    assert 20 < len(want) < len(candidates) and found.keys() == want.keys() and all(abs(found[p] - 1e6 * c) <= 1 for p, c in want.items())
    assert "near-sketches" in staged and not {"term-weights", "vectors", "gram-counts"} & set(staged)
