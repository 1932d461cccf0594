"""Trained operators: held-out accuracy and odd rows."""
from helpers import odd_docs
from pyspark.sql import functions as F

from shopsignal.llm import language_id, license_scan, toxicity
from shopsignal.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_language_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op6_language_id"](spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and len(held) > 100
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark):
    df = odd_docs(spark, "score")
    model = language_id.learn(spark.read.parquet(f"{SF}/documents.parquet"), F.lit(True))
    out, names = language_id.identify(df, model)
    assert out.columns[:5] == df.columns and names["score"] == "score_"
    by = {(r.doc_id, r.text): r for r in out.collect()}
    for k in ((2, None), (3, ""), (4, " \n\t ")):
        assert by[k].lang_pred == "und" and by[k].score_ == 0 and not by[k].accepted
    assert by[5, df.filter("doc_id = 5").first().text].lang_pred == by[6, df.filter("doc_id = 6").first().text].lang_pred
    digits, _ = language_id.identify(spark.createDataFrame([("12 34 …",), ("ß",)], "text string"), model)
    assert digits.collect()[0].lang_pred == "und" and digits.collect()[1].lang_pred != "und"
    none = language_id.learn(df.limit(0), F.lit(True))
    assert none == {} and language_id.identify(df, none)[0].first().lang_pred == "und"
    assert language_id.identify(df.limit(0), model)[0].count() == 0


def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op10_toxicity"](spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    toxic = [p for y, p in held if y == 1]
    clean = [p for y, p in held if y == 0]
    assert sum(toxic) >= 0.7 * len(toxic) and sum(clean) <= 0.03 * len(clean)


def sentences(n):
    words = ("lamp", "river", "walked", "green", "table", "song", "paper", "window", "north", "slow", "water", "cloud")
    return [" ".join(words[(i * k + k) % len(words)] for k in range(3, 11)) for i in range(n)]


def test_toxicity_tolerates_inserted_characters():
    clean = sentences(400)
    insults = ("idiot", "moron", "worthless", "clown")
    docs = [(i, 0, [s, clean[-i]]) for i, s in enumerate(clean)]
    docs += [(1000 + i, 1, [f"{s} {insults[i % 4]} {clean[i - 7]}"]) for i, s in enumerate(clean)]
    scorer = toxicity.Scorer(toxicity.fit(docs))

    def score(t):
        return scorer.scores([t.encode()])[0]
    for bad in ("you idiot", "idixot river", "i.d.i.o.t", "i d i o t", "w-o-r-t-h-l-e-s-s song", "MORON table"):
        assert score("the green lamp " + bad) >= 0.7, bad
    for good in ("the green lamp", "", "river water table", "12 34"):
        assert score(good) < 0.3, good


def test_toxicity_odd_rows(spark):
    df = odd_docs(spark, "predicted")
    labels = spark.createDataFrame([(1, 1), (7, 0), (None, 1), (9, None), (7, 0)], "doc_id long, toxic int")
    model = toxicity.learn(df, labels, F.lit(True))
    out, names = toxicity.score_texts(df, model)
    rows = out.collect()
    assert len(rows) == df.count() and names["predicted"] == "predicted_" and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.learn(df, labels.limit(0), F.lit(True)) is toxicity.CONSTANT
    assert toxicity.score_texts(df.limit(0), model)[0].count() == 0


def test_license_query(spark):
    marks = {"apache": "Licensed under the Apache License", "mit": "Released under the MIT", "gpl": "GNU General Public", "proprietary": "All rights reserved",
             "cc-by-nc": "CC BY-NC"}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: set(filter(None, r.families.split(","))) for r in QUERIES["op4_license_scan"](spark, SF).collect()}
    assert got == {d: {k for k, m in marks.items() if m in t} for d, t in texts.items()}


def test_license_variants_and_odd_rows(spark):
    model = license_scan.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    families = {"Code released under the MIT license": "mit", "licensed under the apache license version 2.0": "apache",
                "This work is licensed under the GNU General Public License, version 2": "gpl", "all rights reserved": "proprietary"}
    for text, family in families.items():
        assert license_scan.scan_text(text.encode(), model)[1] == [family], text
    for text in ("the license of the river was under the table", "rights", "version 2.0 of the song", "", "\n\n"):
        assert license_scan.scan_text(text.encode(), model)[1] == [], text
    df = odd_docs(spark, "lines")
    out, names = license_scan.scan(df, model)
    assert out.count() == df.count() and names["lines"] == "lines_"
    assert license_scan.scan(df.limit(0), model)[0].count() == 0
    assert license_scan.learn(df.limit(0)).predict([b"released", b"under", b"the", b"mit", b"license"])[0] == "mit"


def test_hash_sample_is_bounded_and_repeats(spark):
    from shopsignal.llm.common import hash_sample
    df = spark.range(5000).selectExpr("id", "id % 7 AS x")
    one, two = ({r.id for r in hash_sample(d, 100, "id").collect()} for d in (df, df.repartition(9)))
    assert one == two and len(one) == 100
    assert hash_sample(df.limit(0), 10, "id").count() == 0 and hash_sample(df.filter("id < 5"), 10, "id").count() == 5


GNU_HEADER = """# This {0} is free software: you can redistribute it and/or modify
# it under the terms of the GNU {1}General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""


def test_license_wrapped_notices_titles_and_tags(spark):
    import textwrap
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = license_scan.learn(docs)

    def found(text):
        return license_scan.scan_text(text.encode(), model)[1]
    prose = docs.orderBy("doc_id").first().text
    for family, header in {"gpl": ("program", ""), "agpl": ("program", "Affero "), "lgpl": ("library", "Lesser ")}.items():
        text = GNU_HEADER.format(*header)
        flat = " ".join(text.replace("#", "").split())
        for form in (text, text.replace("\n", "\r\n"), text.replace("\n", "\n\n"), flat, *("\n".join(textwrap.wrap(flat, w)) for w in (30, 50, 100))):
            assert found(form) == [family], form
            assert family in found(prose + "\n" + form + "\n" + prose), form
    apache = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
    mit = ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files '
           '(the "Software"), to deal in the Software without restriction')
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    for family, notice in {"apache": apache, "mit": mit, "bsd": bsd, "cc-by-sa": license_scan.TEMPLATES["cc-by-sa"][1],
                           "cc-by-nc": license_scan.TEMPLATES["cc-by-nc"][1], "cc-by": license_scan.TEMPLATES["cc-by"][1]}.items():
        for width in (25, 40, 70):
            assert set(found(textwrap.fill(notice, width))) == {family}, (family, width)
    for text, family in {"MIT License": "mit", "The MIT License (MIT)": "mit", "Apache License\nVersion 2.0, January 2004": "apache",
                         "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": "gpl", "BSD 3-Clause License": "bsd", "Mozilla Public License Version 2.0": "mpl",
                         "// SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0": "gpl",
                         "SPDX-License-Identifier: CC-BY-NC-4.0": "cc-by-nc", "SPDX-License-Identifier: BSD-3-Clause": "bsd"}.items():
        assert found(text) == [family], text
    assert found("# SPDX-License-Identifier: (MIT OR Apache-2.0)") == ["mit", "apache"]
    for text in ("SPDX-License-Identifier: Zlib", "the mit of the river", "a public song\nof the license", "you can redistribute\nit under the table"):
        assert found(text) == [], text
    assert license_scan.scan_text(b"one\n" + GNU_HEADER.format("program", "").encode() + b"\nMIT License", model) == (6, ["gpl", "mit"], [1, 5], [1.0, 1.0])


def test_samples_take_one_row_of_a_hot_id(spark):
    docs = spark.createDataFrame([(7, f"the river {chr(97 + i % 26) * (1 + i // 26)} was green") for i in range(300)] +
                                 [(100 + i, "lamp song table") for i in range(5)], "doc_id long, text string")
    one = language_id.learn(docs.withColumn("lang", F.lit("en")), F.lit(True), sample_docs=10)
    assert one["en"].count(b"river") == 1 and one["en"].count(b"lamp") == 1


def test_toxicity_link_uses_whole_texts(spark, monkeypatch):
    """The link's documents are scored over their whole texts, beyond the sentences learned from."""
    clean = sentences(400)
    docs = [(i, f"{s}. {clean[-i]}. " * 50) for i, s in enumerate(clean)]
    docs += [(1000 + i, ". ".join([s] * 70 + ["you idiot"] + [s] * 70)) for i, s in enumerate(clean)]
    docs += [(1000 + i, "zz " * 1000 + "you idiot moron") for i in range(0, 400, 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(d >= 1000)) for d in sorted({d for d, _ in docs})], "doc_id long, toxic int")
    seen = []
    real = toxicity.fit

    def fit(documents, whole=None, **options):
        seen.extend(documents)
        return real(documents, whole=lambda model, ids: seen.append(whole(model, ids)) or seen[-1], **options)
    monkeypatch.setattr(toxicity, "fit", fit)
    toxicity.learn(df, labels, F.lit(True), sentences=200)
    *documents, found = seen
    assert len(documents) == len({d[0] for d in documents}) == 800      # a row per id, though 200 ids have two
    texts = dict(sorted(docs, reverse=True))                            # the least text of each id
    assert 0 < len(found) < 800 and all(len(v) == 2 for v in found.values())
    assert min(v[0] for d, v in found.items() if d >= 1000 and "idiot" in texts[d]) > max(v[0] for d, v in found.items() if d < 1000)
