"""The pipeline against brute force from its stages' definitions, on a small table."""

import random

import corpus_pipeline
from vaultlake.llm import simhash


def test_pipeline(spark, tmp_path):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 999)) for _ in range(40))
    base = [text() for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, t, "en", "s0", len(t)) for i, t in enumerate(base[:5])] + [(200, "too short", "en", "s1", 9), (201, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert name == "bpe" or docs.columns == df.columns
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
    good = {i for i, t, *_ in rows if t and len(t.split()) >= 10}
    assert seen[0] == good and seen[1] == {i for i in good if not i < 5}
    alone = {i for i in seen[1] if not any(j < i and (simhash.fingerprint(dict((r[0], r[1]) for r in rows)[i]) ^ simhash.fingerprint(dict((r[0], r[1]) for r in rows)[j])).bit_count() <= 4 for j in seen[1])}
    assert seen[2] == alone and seen[3] <= seen[2] and seen[4] == seen[3]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == seen[4]
