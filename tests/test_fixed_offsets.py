"""Units compared at fixed offsets, against all pairs of units."""

import random

from foliomatch.operators.matching import MAX_HASH_DISTANCE, OFFSETS, best_fixed_offset, fixed_offset_matches


def test_matches_and_what_is_the_same_by_brute_force(spark):
    rng = random.Random(5)
    near = [0x0123456789ABCDEF ^ rng.getrandbits(8) for _ in range(6)]
    units = [(i, p, rng.choice(["x", "y", "z", None]), rng.choice([f"{h:016x}" for h in near] + [None]), rng.randrange(9)) for i in range(6) for p in range(rng.randrange(1, 8))]
    pairs = [(a, b) for a in range(7) for b in range(a + 1, 7)]
    of = lambda i: [u for u in units if u[0] == i]
    want = []
    for a, b in pairs:
        for _, lp, x, g, area in of(a):
            for _, rp, y, h, other in of(b):
                same = x is not None and x == y
                close = g is not None and h is not None and (int(g, 16) ^ int(h, 16)).bit_count() <= MAX_HASH_DISTANCE
                if rp - lp in OFFSETS and (same or close):
                    want.append((a, b, rp - lp, lp, rp, area, other, same))
    rows = spark.createDataFrame(units, "archive_id long, pos int, pixel string, dhash string, area long")
    got = fixed_offset_matches(spark.createDataFrame(pairs, "a long, b long"), rows)
    assert want and sorted(map(tuple, got.select("a", "b", "shift", "lp", "rp", "l_area", "r_area", "same").collect())) == sorted(want)
    equal = {(r.a, r.b): r.equal or 0 for r in best_fixed_offset(got).collect()}
    assert equal == {(a, b): sum(w[:3] == (a, b, 0) and w[7] for w in want) for a, b in {w[:2] for w in want}}
