"""Small documents with every odd case: nulls, empty, blank and long texts, repeats, clashing columns."""
LONG = " ".join(f"w{i % 911} x{i // 911}" for i in range(40_000))
ODD = [(1, "Plain words here, and more words.\nSecond line."), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, LONG), (None, "no id at all"),
       (7, "repeat me"), (7, "repeat me"), (8, "é ü ñ \U0001F600 \u0000 nul space  two  blanks \n x"), (9, "x" * 70_000), (10, "a")]


def odd_docs(spark, extra: str):
    """ODD with a source, a lang and one column named ``extra`` that a result uses too."""
    rows = [(i, t, None if k % 5 == 0 else f"s{k % 3}", None if k % 4 == 0 else "en", k) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, lang string, `{extra}` long")
