"""Many short pairs aligned as rows of one array."""

import random

from strandlake.operators import edit_align

from .test_polish import planted


def test_side_by_side_is_path():
    """Pairs aligned together have the paths that each has alone, ties too."""
    rng = random.Random(2)
    asks = []
    for _ in range(400):
        letters = rng.choice(["ACGT", "AC", "A", "ACé", "Aā"])
        ref = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 7, 8, 9, 60, 300])))
        query = planted(rng, ref, rng.randrange(25)) if ref else rng.choice(["", "A", "ACGTACGTACGTACGTACGTACGT"])
        asks.append(edit_align.Ask(query, ref + "ACCA" * rng.randrange(3), rng.choice(["NW", "SHW"]), rng.choice([None, 4096, 3])))
    assert edit_align.paths(asks) == [edit_align.path(*ask) for ask in asks]


def test_chains_go_on_together():
    """Chains that wait for each other give the parts that each gives alone, and their chunks are aligned many at a time."""
    rng = random.Random(4)
    jobs = []
    for _ in range(60):
        ref = "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 5, 200, 900])))
        jobs.append((planted(rng, ref, len(ref) // 20) if ref else "ACG", ref, 100, 40, rng.choice(["NW", "HW", "HWT"]), rng.choice([1, 5])))
    assert edit_align.chains([edit_align.steps(*job) for job in jobs]) == [list(edit_align.chain(*job)) for job in jobs]


def test_words_hash_as_by_symbol():
    """Hashes by doubling are those by one symbol after another."""
    text = "".join(random.Random(6).choice("ACGTé") for _ in range(90))
    for k in (1, 2, 3, 31, 32, 33):
        want = []
        for at in range(len(text) - k + 1):
            value = 0
            for symbol in text[at : at + k]:
                value = (value * 0xD1342543DE82EF95 + ord(symbol)) % 2**64
            value = ((value ^ value >> 31) * 0x9E3779B97F4A7C15) % 2**64
            want.append(value ^ value >> 29)
        assert edit_align.word_places(text, k, 1)[0].tolist() == want
