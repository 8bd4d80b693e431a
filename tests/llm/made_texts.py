"""Made-up prose for the tests."""


def prose(rng, words, language="en"):
    parts = {"en": ["the", "ing", "er", "on", "th", "and"], "de": ["ein", "sch", "ung", "ver", "ge", "heit"],
             "fr": ["eau", "que", "ment", "oi", "tre", "ç"]}[language]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(words))
