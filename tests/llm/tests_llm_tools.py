import random

WORDS = "the of and river stone bright window carry under seven market quiet letter garden".split()


def sentence(rng: random.Random, n: int) -> str:
    """Words most of which are met once."""
    return " ".join(rng.choice(WORDS) if rng.random() < 0.3 else "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(3, 9))) for _ in range(n))


def parts(a: list[tuple], nodes) -> dict:
    """Least node of each node's component."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in a:
        p, q = find(x), find(y)
        root[max(p, q)] = min(p, q)
    return {n: find(n) for n in nodes}
