"""Rows without an id, or that share one, are judged by their own texts."""

import random

from strandlake.llm import decontaminate, near_dedup

from .conftest import prose


def test_decontamination_keeps_clean_rows(spark):
    rng = random.Random(2)
    item = prose(rng, 30)
    clean = [prose(rng, 50) for _ in range(4)]
    leak = f"{prose(rng, 10)} {item} {prose(rng, 10)}"
    docs = spark.createDataFrame([(None, clean[0]), (None, leak), (None, clean[1]), (7, leak), (7, clean[2]), (8, clean[3])], "doc_id long, text string")
    kept = decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r.text for r in kept.collect()) == sorted(clean) and kept.columns == docs.columns


def test_near_copies_by_their_own_texts(spark):
    rng = random.Random(3)
    bases = [prose(rng, 120).split() for _ in range(4)]
    near = lambda words, k: " ".join([*words[:k], "edited", *words[k + 1 :]])
    texts = [" ".join(b) for b in bases]
    rows = [(None, texts[0]), (None, near(bases[0], 60)), (None, texts[1]), (None, near(bases[1], 50)), (None, near(bases[1], 70))]
    rows += [(1, texts[2]), (5, near(bases[2], 40)), (5, texts[3]), (5, "a text of its own"), (5, "a text of its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {frozenset(t) for t in ((rows[0][1], rows[1][1]), [r[1] for r in rows[2:5]], [r[1] for r in rows[5:7]], [texts[3]], ["a text of its own"])}
    kept = [r.text for r in near_dedup.drop_near_copies(docs).collect()]
    assert len(kept) == len(want) and all(sum(t in group for t in kept) == 1 for group in want)
    assert texts[2] in kept  # of ids 1 and 5, the smallest stays
    groups = near_dedup.near_groups(docs).collect()
    assert len({r.class_no for r in groups}) == len(want)
    assert len(groups) == len(rows) and sum(r.kept for r in groups) == len(want)
    assert sorted(r.group_size for r in groups) == [1, 2, 2, 2, 2, 2, 2, 3, 3, 3]
