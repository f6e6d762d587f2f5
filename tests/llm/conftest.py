import random

import pytest


@pytest.fixture(scope="session")
def words():
    """Seeded prose of invented words."""
    rng = random.Random(5)
    parts = "an the re tion ing er st ou ha ble ed nd on es or".split()

    def make(n, seed=None):
        r = random.Random(seed) if seed is not None else rng
        return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n))

    return make
