import math

import numpy as np

from plansight.llm import near_dedup


def test_the_looks_at_a_pair_share_one_miss_probability():
    """A pair at the threshold, its matches independent: the chance that any look prunes it, by surviving() on each number of matches."""
    share, batch, alive, lost = near_dedup.SHARE[0] / near_dedup.SHARE[1], near_dedup.BATCH, {0: 1.0}, 0.0
    for compared in range(batch, near_dedup.HASHES + 1, batch):
        following = {}
        for m, chance in alive.items():
            for k in range(batch + 1):
                following[m + k] = following.get(m + k, 0.0) + chance * math.comb(batch, k) * share**k * (1 - share) ** (batch - k)
        alive = {}
        for m, chance in following.items():
            # m matches, spread so that only the last look can prune
            left, right = np.zeros((1, compared), np.uint16), np.ones((1, compared), np.uint16)
            right[0, :m] = 0
            if len(near_dedup.surviving(left, right, np.array([0]), np.array([0]))[0]):
                alive[m] = chance
            else:
                lost += chance
    assert lost <= near_dedup.MISS
