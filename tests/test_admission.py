import random
import time

import numpy as np

from resultloom.operators.admission import Limit


def plain(times, most, micros):
    held, out = [], []
    for t in times:
        free = sum(t - h < micros for h in held) < most
        out.append(free)
        if free:
            held.append(t)
    return out


def test_admissions_equal_the_plain_rule_in_any_chunks():
    rng = random.Random(1)
    for _ in range(150):
        most, micros = rng.choice([1, 2, 3, 7, 30]), rng.choice([1, 5, 20, 60])
        times = sorted(rng.randrange(rng.choice([20, 200, 2000])) for _ in range(rng.randrange(300)))
        limit, got, at = Limit(most, micros), [], 0
        while at < len(times):
            step = rng.choice([1, 2, 50, 400])
            got += limit.admits(np.array(times[at : at + step], np.int64)).tolist()
            at += step
        assert got == plain(times, most, micros)


def test_a_long_burst_costs_what_it_admits():
    times = np.sort(np.random.default_rng(2).integers(0, 600_000_000, 5_000_000))
    start = time.perf_counter()
    admitted = Limit(30, 60_000_000).admits(times)
    assert time.perf_counter() - start < 2 and 300 <= admitted.sum() <= 330
