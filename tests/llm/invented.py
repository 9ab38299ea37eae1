def prose(rng, n):
    """n invented words."""
    return " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "".join(rng.choice(["ba", "ko", "ri", "tu", "ne", "sal"]) for _ in range(rng.randint(1, 4))) for _ in range(n))
