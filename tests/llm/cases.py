"""Small tables with the cases every operator has to bear."""

import random

WORDS = [a + b + c for a in ("ka", "lo", "mi", "tu", "re") for b in ("n", "st", "v", "") for c in ("a", "or", "ing", "u", "ed")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def near(rng: random.Random, text: str, edits: int) -> str:
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(WORDS) + "x"
    return " ".join(words)


def document_rows(seed: int = 1, groups: int = 12, copies: int = 5) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars, clash): groups of near and exact copies, odd texts, ties and nulls."""
    rng = random.Random(seed)
    texts: list[str | None] = []
    common = prose(rng, 14)
    for _ in range(groups):
        base = prose(rng, rng.choice([4, 9, 12, 18, 25, 40, 120]))
        texts.append(base)
        for _ in range(copies):
            texts.append(near(rng, base, rng.choice([0, 1, 1, 2, 4, 9])))
        texts.append(base + " " + rng.choice(WORDS))
        texts.append(prose(rng, 20) + "\n" + common + "\n" + prose(rng, 10))
    texts += [None, "", " \n\t", "one", "one two", "Ünï cödé " * 30, "a" * 700, "na " * 300, "\U0001f600 " * 60, prose(rng, 6000)]
    rows = [(i, t, "en", "s", len(t or ""), "x") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [(3, rows[0][1], None, None, None, None), rows[1], rows[1], (None, rows[2][1], "en", None, 1, "x"), (None, None, None, None, None, None)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"
