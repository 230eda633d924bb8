import collections
import hashlib
import re

import public_tokenizers
import tiktoken

import brute
import corpus_pipeline
from corpusloom.llm import bpe


def test_stages(spark, sf, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "mixing", "bpe"]
    steps = dict(corpus_pipeline.STAGES)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    tame = steps["toxicity"](spark, docs, sf)
    left = {r.doc_id for r in tame.collect()}
    assert tame.columns == docs.columns and sum(labels[i] for i in left if i in labels) <= 0.1 * sum(labels.values())
    assert sum(1 - labels[i] for i in left if i in labels) >= 0.97 * sum(1 - x for x in labels.values())

    unique = steps["exact_dedup"](spark, docs, sf)
    first = {}
    for i, t in sorted(tuple(r) for r in docs.select("doc_id", "text").collect()):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), i)
    assert unique.columns == docs.columns and sorted(r.doc_id for r in unique.collect()) == sorted(first.values())

    apart = steps["near_dedup"](spark, docs, sf)
    want = {i for i, _, _, kept in brute.near([tuple(r) for r in docs.select("doc_id", "text").collect()], 5) if kept}
    assert apart.columns == docs.columns and {r.doc_id for r in apart.collect()} == want

    # Each text floor(rate) or ceil(rate) times, whole copies of the row; the rates are those of the plain targets.
    mixed = steps["mixing"](spark, docs, sf)
    rows = {r.doc_id: tuple(r) for r in docs.collect()}
    targets = brute.mix_targets([(r.doc_id, r.source, r.text) for r in docs.collect()])
    assert mixed.columns == docs.columns
    taken = collections.Counter()
    for r in mixed.collect():
        assert tuple(r) == rows[r.doc_id]
        taken[r.doc_id] += 1
    for i, row in rows.items():
        size, target = targets[row[docs.columns.index("source")]]
        assert int(target / size) <= taken[i] <= int(target / size) + 1

    assert sorted(tuple(r) for r in steps["bpe"](spark, docs, sf).collect()) == encoded(docs.collect())


def encoded(rows):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = bpe.read_ranks(file.read())
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for r in rows:
        ids = coder.encode_ordinary(r.text or "")
        out.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    return sorted(out)


def test_run(spark, sf, docs):
    """All stages in a row: what each brute-force version leaves of the classifier's own decisions."""
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    tame = corpus_pipeline.drop_toxic(spark, docs, sf).collect()
    first = {}
    for r in sorted(tame, key=lambda r: r.doc_id):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", r.text or ""), r)
    kept = {i for i, _, _, kept in brute.near([(r.doc_id, r.text) for r in first.values()], 5) if kept}
    left = {r.doc_id: r for r in first.values() if r.doc_id in kept}
    targets = brute.mix_targets([(r.doc_id, r.source, r.text) for r in left.values()])
    rows = sorted(tuple(r) for r in out.collect())
    taken = collections.Counter(r[0] for r in rows)
    assert set(taken) <= set(left)
    for i, r in left.items():
        size, target = targets[r.source]
        assert int(target / size) <= taken[i] <= int(target / size) + 1
    assert rows == encoded([left[i] for i in taken.elements()])
