"""A small table with every odd case, and brute-force versions of the operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, kept boolean, block string, node long"


def texts() -> list[str | None]:
    rng = random.Random(5)
    vocabulary = [a + b + c for a in ("th", "on", "re", "é") for b in ("a", "e", "in") for c in ("st", "nd", "ß", "")]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, shared = make(120).split(), make(60)
    near = []
    for i in range(30):
        w = list(base)
        w[rng.randrange(len(w))] = f"x{i}"
        near.append(" ".join(w))
    out: list[str | None] = [None, "", " \t\n ", "one", "Two  words", "A\tb\x0bc\x0cd\r\n e  f g", "same line\nSAME LINE \nsame line", "<|endoftext|> a  b   c", "x " * 3000, make(9000)]
    out += near + [make(200)] * 12 + [make(80) + " " + shared + "\n" + make(40) for _ in range(12)]
    out += [f"Header line\n{make(70)}\n  header LINE\t\n\nfooter" for _ in range(11)] + [make(rng.randrange(1, 90)) for _ in range(60)]
    out += [make(60) + "\n" + make(9) + "###*** a|b <c> $%&" for _ in range(8)]
    return out


def documents(spark):
    rows = [(i, t, "en", "src0" if i % 3 else None, None, i, None, "b", 1) for i, t in enumerate(texts())]
    rng = random.Random(6)
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
