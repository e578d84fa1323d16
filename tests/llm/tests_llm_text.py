"""Made-up prose for the tests."""

import random


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    syllables = "an be co de er fi go hu in jo ka lo mi no or pe qu ra se to".split()
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))
