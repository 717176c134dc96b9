"""Rows that every operator has to take."""

SMALL = "/root/testdata/sf0.001"

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
#: nulls, empty and white texts, a very long one, ties, repeated rows, repeated ids, odd characters
ODD = [
    (1, "The cat sat on the mat and looked at the dog by the door", "en", "a"),
    (2, "THE CAT SAT on the mat and looked at the dog by the door", "en", None),
    (3, None, "en", "b"),
    (4, "", None, "b"),
    (5, " \t\n\r ", "en", "b"),
    (6, LONG, "en", "c"),
    (7, LONG + " end", None, None),
    (7, "same id, another text\nwith two lines", "en", "a"),
    (8, "repeated row", "en", "a"),
    (8, "repeated row", "en", "a"),
    (None, "no id at all", "en", "a"),
    (None, None, None, None),
    (9, "Üben <|endoftext|> naïve \U0001f600 日本語 \x00\x1c it's  1²3", "de", "a"),
    (10, "one", "en", "z"),
    (11, "two words", "en", "z"),
]
#: columns whose names the operators use themselves
CLASH = ["id", "row", "_row", "fp", "size", "score", "word", "block", "digest", "conv", "label", "_place", "start", "ids"]
