"""The growing clone index against one load of everything."""

import random

import pytest

from codesieve.operators import clone_index, sketch


def _texts(seed, n):
    r = random.Random(seed)
    base = [" ".join(r.choice("a b c d e f g h").strip() + str(r.randint(0, 3)) for _ in range(40)) for _ in range(6)]
    out = []
    for i in range(n):
        w = base[i % 6].split()
        for _ in range(r.choice((0, 0, 1, 2))):
            w[r.randrange(40)] = "x"
        out.append((i, " ".join(w)))
    return out + [(n, "too short"), (n + 1, None)]


def test_loads_equal_one_load(spark, tmp_path):
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    make = lambda name, **k: clone_index.CloneIndex(spark, f"file://{tmp_path}/{name}", 3, 2, bits=4, **k)
    rows = _texts(1, 30)
    pairs = lambda x: sorted(map(tuple, x.verified(1, 2).collect()))
    whole = make("whole")
    assert whole.load(df(rows)) == 32
    grown = make("grown")
    assert [grown.load(df(rows[:10])), grown.load(df(rows[5:])), grown.load(df(rows))] == [10, 22, 0]
    assert pairs(grown) == pairs(whole) and len(pairs(whole)) > 5
    sets = sketch.first_of_each(sketch.signed_sets(df(rows), 3, 2, ("T1",)))
    assert {(a, b) for a, b, *_ in pairs(whole)} <= {(r.left, r.right) for r in sketch.candidates(sets).collect()}
    # changed texts and texts that go
    later = [(i, t) for i, t in _texts(2, 30) if i < 4] + rows[4:20]
    assert grown.load(df(later), complete=True) == 4
    fresh = make("fresh")
    fresh.load(df(later))
    assert pairs(grown) == pairs(fresh)
    # other settings pass all texts again
    other = make("grown", profile="T2")
    assert other.load(df(later)) == len(later)
    assert make("none").load(df([])) == 0
    with pytest.raises(ValueError):
        make("bad", n_bands=3)
