"""The pipeline's stages, each on what the one before kept, against brute force."""

import re
from collections import Counter

from test_models import brute_components, check_packing
from test_native import without_repeated_lines


def test_stages(spark, docs_of, edge_rows, tmp_path):
    import corpus_pipeline as c

    rows = edge_rows + [(700 + i, f"river stone password=a1b2c3d4e5f6{i:06d} harbour {4000000000000000 + i} light {i}", "en", "s") for i in range(30)]
    docs = docs_of(rows)
    columns = docs.columns
    key = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())

    def stage(k, docs):
        c.STAGES[k][1](spark, docs, "").write.parquet(f"{tmp_path}/{k}")
        return spark.read.parquet(f"{tmp_path}/{k}")

    spoken = stage(0, docs)
    assert spoken.columns == columns
    assert key(spoken) == Counter((i, t) for i, t, *_ in rows if any(x.isalpha() for x in t or ""))
    assert spoken.filter("lang is null").count() == 0
    before = [(r["doc_id"], r["text"]) for r in spoken.collect()]
    lined = stage(1, spoken)
    assert lined.columns == columns
    assert key(lined) == Counter((i, t) for i, _, _, t in without_repeated_lines(before))
    assert lined.filter("n_chars <> length(text)").count() == 0
    before = [(r["doc_id"], r["text"]) for r in lined.collect()]
    part = brute_components(before, 5, 80)
    near = stage(2, lined)
    assert near.columns == columns
    assert key(near) == Counter((i, t) for i, t in before if i is None or part[i][1] == i)
    clean = stage(3, near)
    assert clean.columns == columns
    assert key(clean) == Counter((i, re.sub("(?<=password=)[0-9a-f]{18}", "<SECRET>", t)) for i, t in key(near).elements())
    check_packing(stage(4, clean).collect(), list(key(clean).elements()))


def test_run(spark):
    import corpus_pipeline as c

    assert c.run(spark, "/root/testdata/sf0.001").count() > 100
