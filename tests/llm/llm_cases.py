"""Rows shared by the tests of the training-data operators."""

SMALL = "/root/testdata/sf0.001"
A = "The quick brown fox jumps over the lazy dog while seven wizards brew a strong potion for the queen of hearts tonight"
EDGE = [
    (1, A + " and leaves.", "en", "s0", 1),
    (2, A + " and leaves.", "en", "s0", 1),
    (2, A + " and leaves.", "en", "s0", 1),
    (3, A + " or stays here.\nA second line, +1 (555) 010-9999 mail x.y@z.org!", None, None, None),
    (3, "same id, other text", "en", "s1", 5),
    (4, "", "en", "s1", 0),
    (5, None, "en", "s1", None),
    (None, A + " and leaves.", "de", "s2", 2),
    (None, None, None, None, None),
    (7, "x" * 5000 + " 4111 1111 1111 1111 ip 10.0.0.256 10.0.0.25", "en", "s2", 0),
    (8, (A + ". ") * 40, "en", "s0", 0),
    (-9, " \t\n ", "fr", "s0", 0),
    (10, "Ünïcödé 😀 a@b.c_d@e.fg 中文 +49 (30) 1234567. password=df1974350 1234-5678", "de", "s3", 0),
]
