"""Helpers of these tests."""


def words(rng, n, vocabulary=5000):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))
