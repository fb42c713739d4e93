import random
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parent.parent)]


@pytest.fixture
def words():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghiklmnoprstuvwé") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    return lambda n, seed: " ".join(random.Random(seed).choices(vocabulary, k=n))
