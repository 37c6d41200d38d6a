import collections
import hashlib
import re

import numpy as np
import pytest

from strandlake.llm import decontaminate, exact_dedup, line_dedup, near_dedup
from strandlake.llm.components import components
from strandlake.llm.near_dedup import bag_signatures

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bag(text):
    w = WORD.findall((text or "").translate(LOW))
    return collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def alike(a, b):
    shared = sum((a & b).values())
    return shared >= 0.8 * (sum(a.values()) + sum(b.values()) - shared) - 1e-9


def classes(rows):
    """Smallest id of each id's class, by brute force over all pairs."""
    bags, up = {i: bag(t) for i, t in rows}, {i: i for i, _ in rows}
    texts = dict(rows)

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(bags)
    for x in ids:
        for y in ids:
            if x < y and ((texts[x] or "") == (texts[y] or "") or (bags[x] and bags[y] and alike(bags[x], bags[y]))):
                a, b = top(x), top(y)
                up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_exact_matches_brute_force(corpus):
    rows = corpus.select("doc_id", "text").collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r.text].append(r.doc_id)
    want = {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    got = exact_dedup.exact_dedup(corpus).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize(("radix", "rounds"), [(2, 3), (4, 1), (16, 2)])
def test_exact_does_not_depend_on_rounds(corpus, radix, rounds):
    plain = sorted(map(tuple, exact_dedup.exact_dedup(corpus).collect()))
    assert sorted(map(tuple, exact_dedup.exact_dedup(corpus, radix=radix, rounds=rounds).collect())) == plain


def test_exact_awkward(awkward, empty):
    got = exact_dedup.exact_dedup(awkward).collect()
    assert len(got) == 14
    assert [r.kept for r in got if r.doc_id == 8].count(True) == 1
    blank = [r for r in got if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert len(blank) == 3 and {r.keep_id for r in blank} == {2} and {r.group_size for r in blank} == {3}
    assert {r.keep_id for r in got if r.doc_id in (6, 7)} == {7}
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.drop_exact_copies(awkward)
    assert kept.columns == awkward.columns and kept.count() == 10 and exact_dedup.drop_exact_copies(empty).count() == 0


def test_near_matches_brute_force(corpus):
    want = classes([(r.doc_id, r.text) for r in corpus.collect()])
    sizes = collections.Counter(want.values())
    got = near_dedup.near_groups(corpus).collect()
    assert {r.doc_id: r.class_id for r in got} == want and len(got) == corpus.count()
    assert all(r.group_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got)


def test_near_awkward(awkward, empty):
    got = near_dedup.near_groups(awkward).collect()
    assert len(got) == 14
    by_id = {r.doc_id: r for r in got}
    assert by_id[7].class_id == 6 and by_id[3].class_id == 3 and by_id[4].class_id == 4 and by_id[9].group_size == 1
    assert near_dedup.near_groups(empty).count() == 0
    kept = near_dedup.drop_near_copies(awkward.where("doc_id > 2"))
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()} == {3, 4, 5, 6, 8, 9, 10, 11}


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    items = rng.integers(1, 2**63, 60).astype(np.uint64)
    a, b = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
    rows = np.concatenate([np.zeros(60, int), np.ones(60, int)])
    weights = np.concatenate([a, b])
    keep = weights > 0
    got = bag_signatures(rows[keep], np.concatenate([items, items])[keep], weights[keep], 3, 4096)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((got[0] == got[1]).mean() - want) < 4 * (want * (1 - want) / 4096) ** 0.5
    assert np.isinf(got[2].view(np.float64)).all()


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (103, 101), (7, 7), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[103] == got[101] == got[100] == 100 and 200 not in got


def brute_contaminated(docs, items, window=20, share=0.8):
    out = set()
    for i, text in docs:
        w = [x for x in re.split(decontaminate.SEPARATOR, (text or "").lower()) if x]
        for j, item in items:
            m = [x for x in re.split(decontaminate.SEPARATOR, (item or "").lower()) if x]
            n, span = len(m), min(len(m), window)
            if n < 5:
                continue
            for start in range(-n + 1, len(w)):
                equal = [0 <= start + k < len(w) and w[start + k] == m[k] for k in range(n)]
                if any(sum(equal[s : s + span]) >= share * span - 1e-9 for s in range(n - span + 1)):
                    out.add((i, j))
                    break
    return out


@pytest.fixture(scope="module")
def leaks(spark):
    import random

    from .conftest import prose

    rng = random.Random(9)
    items = [(k, prose(rng, n, 400)) for k, n in enumerate([3, 5, 6, 13, 20, 35, 60, 13])] + [(50, None)]
    docs = [(k, prose(rng, rng.randrange(1, 80), 400)) for k in range(60)]
    for k, (_, text) in enumerate(items[1:-1] * 4):
        words = text.split()
        for _ in range(len(words) // 7 if k > 7 else 0):
            words[rng.randrange(len(words))] = "changed"
        part = words[: max(5, len(words) // 2)] if k % 4 == 3 else words
        docs.append((100 + k, f"{prose(rng, 9, 400)} {' '.join(part).upper() if k % 2 else ', '.join(part)} {prose(rng, 5, 400)}"))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), docs, items


def test_contaminated_matches_brute_force(leaks):
    docs, items, doc_rows, item_rows = leaks
    want = brute_contaminated(doc_rows, item_rows)
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert found <= want
    # A passage with so many substitutions that no seed is clean may be missed; none of these is.
    assert len(found) >= 0.98 * len(want) and len(want) > 20


def test_contaminated_without_broadcast(leaks):
    docs, items, *_ = leaks
    plain = sorted(map(tuple, decontaminate.contaminated(docs, items).collect()))
    assert sorted(map(tuple, decontaminate.contaminated(docs, items, broadcast_seeds=0).collect())) == plain


def test_contaminated_awkward(spark, awkward, empty, leaks):
    _, items, *_ = leaks
    assert decontaminate.contaminated(awkward, items).count() == 0
    assert decontaminate.contaminated(empty, items).count() == 0 and decontaminate.contaminated(awkward, items.limit(0)).count() == 0
    kept = decontaminate.drop_contaminated(awkward, items)
    assert kept.columns == awkward.columns and kept.count() == 14
    own = spark.createDataFrame([(1, awkward.where("doc_id = 11").first().text)], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.contaminated(awkward, own).collect()] == [11]


def test_lines(spark, awkward, empty):
    lines = [f"On {k} May host{k} was restarted by the night watch at gate {k}" for k in range(5)]
    fields = [f"dear reader number one please find the long report about {w} in the annex below" for w in ("wheat", "barley", "maize", "rye")]
    docs = [(k, f"own text of document {'abcdefgh'[k]} alone\n{lines[k % 5]}\n{fields[k % 4]}") for k in range(8)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.kept_text, r.n_lines, r.n_dropped) for r in line_dedup.drop_recurring_lines(df).collect()}
    assert got == {k: (t.split("\n")[0], 3, 2) for k, t in docs}
    same = line_dedup.drop_recurring_lines(awkward)
    assert same.count() == 14 and same.where("n_dropped > 0").count() == 0 and line_dedup.drop_recurring_lines(empty).count() == 0
    few = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    assert line_dedup.drop_recurring_lines(few).where("n_dropped > 0").count() == 0
