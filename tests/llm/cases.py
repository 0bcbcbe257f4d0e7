"""Fixtures that every operator must survive: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, key long, fp long, u long, bucket int"


def texts(seed=1, n=60):
    r = random.Random(seed)
    voc = ["alpha", "Beta", "gamma,", "ÉTÉ", "don't", "naïve", "日本語", "x1", "42", "(ok)", "straße", "fin.\n", "\ttab", "a  b", " nb", "　"]
    out = [None, "", " ", "\n\n", "a", "word " * 3000, "é" * 5000, "é", "<|endoftext|> and <|endoftext|>", "x" * 20000, "tail   \n  \n", "don't  'll we've", "1234567 12 3"]
    for _ in range(n):
        out.append(" ".join(r.choice(voc) for _ in range(r.randint(1, 120))))
    out += out[14:20] + ["word " * 3000]
    return out


def rows(seed=1, n=60):
    found = [(i, t, None if i % 7 == 3 else ["en", "de"][i % 2], f"s{i % 3}", None, "w", 1, 2, 3, 4) for i, t in enumerate(texts(seed, n))]
    return found + [found[20], found[1], (None, "no id at all here", "en", None, None, None, None, None, None, None)]
