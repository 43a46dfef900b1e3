"""Brute-force forms of the corpus operators and awkward texts."""

import collections
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, score double, kept string, rid long, runs string, node int"

LOREM = " ".join(f"w{i * i % 97}x{i % 31}" for i in range(400))
EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "one two three"), (6, LOREM), (7, LOREM), (8, "before " + LOREM[100:900] + " after"),
    (9, "z" * 700), (10, "ab" * 300), (11, LOREM.upper()), (12, "é" * 150 + LOREM[:300]), (12, "é" * 150 + LOREM[:300]), (13, LOREM + " tail words here"),
    (14, " ".join(f"q{i}" for i in range(9000))), (15, "  two  spaces\n\nlines \r\n<|im_end|> <|endoftext|> 漢字 ²"), (16, " ".join(["same"] * 200)),
    (17, "line one here\nline one here\nline two"), (None, "no id " + LOREM[:250]), (18, "no id " + LOREM[:250]),
]


def documents(spark, rows=None):
    """Texts with extra columns whose names clash with those the operators make."""
    rows = EDGE if rows is None else rows
    return spark.createDataFrame([(i, t, 0.5, "k", 7, "r", 3) for i, t in rows], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def covered(sequences, length):
    """For each sequence the places covered by a window that starts at least twice anywhere."""
    seen = collections.Counter(tuple(s[i : i + length]) for s in sequences for i in range(len(s) - length + 1))
    out = []
    for s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - length + 1):
            if seen[tuple(s[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def shingles(text, n=5):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
