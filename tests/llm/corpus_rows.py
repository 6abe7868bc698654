"""Rows that the training-data tests share."""

SF = "/root/testdata/sf0.001"
# columns whose names the operators use inside
CLASH = "_h string, _row int, kept string, words int, g int, doc string, th string, n int, _may int, stratum string"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + CLASH
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def row(i, text, lang="en", source="src1"):
    return (i, text, lang, source, len(text or ""), "h", 1, "k", 2, 3, "d", "t", 4, 5, "s")


EDGES = [
    row(1, None), row(2, ""), row(3, " \t\n "), row(4, "a"), row(5, "a  b"), row(6, "a\tb"), row(7, "a b"),
    row(8, PASSAGE + " tail of the first"), row(9, "head of the second " + PASSAGE), row(10, PASSAGE + " tail of the first"),
    row(11, LONG), row(12, LONG + " more"), row(13, "Ünïcödé ß Σίσυφος 日本語 <|endoftext|> 😀 don't  stop\r\n", None, None),
    row(14, "same line\nsame line\nother\nsame line", "fr", "src2"), row(15, "x " * 300, "de", "src0"),
    row(16, " ".join(str(k) for k in range(40)), "es", "src0"), row(17, "#*$% & | < > !!! " * 30),
    row(18, " ".join(str(k) for k in range(40)), "es", "src0"), row(0, "A B"),
]
