"""Made-up texts for the tests of the corpus operators."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def words(rng: random.Random, n: int) -> str:
    """n words, most of them rare."""
    return " ".join(rng.choice(WORDS) + str(rng.randrange(10_000)) for _ in range(n))
