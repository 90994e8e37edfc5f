"""Small corpora for the corpus operators and the brute-force answers they are held against."""

import random

WORDS = [a + b for a in ("ab", "the", "Of", "straße", "né", "x1", "don't", "…") for b in ("", "ly", "ing.", "日本")]


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def messy_rows(words):
    rng = random.Random(3)
    shared = prose(rng, 60)
    long = "\n".join(prose(rng, 400) for _ in range(40))
    texts = [
        None,
        "",
        "   \t\n ",
        "one",
        "two words",
        "A b\tC\x0bd\x0ce\r\nf  g   h \n i",
        "the <|endoftext|> end",
        "a b   c\x85d\x1ce",
        "x" * 3000,
        long,
        long,
        long + " tail",
        "to be " * 300,
        "Same line here\n" * 30,
        "### *** $$$ " * 40 + prose(rng, 20),
        prose(rng, 30) + " " + shared + " " + prose(rng, 30),
        shared + " " + prose(rng, 30),
        prose(rng, 19),
        prose(rng, 20),
        "ab " * 45,
    ]
    texts += [prose(rng, rng.randint(1, 300)) for _ in range(60)]
    texts += [t + " more" for t in texts[-10:]] + texts[-5:]
    rows = [(k, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", None]), len(t or "")) for k, t in enumerate(texts)]
    rows[40] = (None, rows[40][1], None, None, None)
    return rows + [rows[20], rows[20]]


def words(text):
    return (text or "").encode().split()


def shingles(text, n):
    w = words(text)
    if not w:
        return []
    return [b" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))]
