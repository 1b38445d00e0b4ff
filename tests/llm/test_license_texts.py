"""Entire license texts, set in several paragraphs, alone and inside longer documents."""

from pathloom.llm import licenses

MIT = next(t for n, t in licenses.KNOWN if n == "MIT" and "\n\n" in t)
ISC = next(t for n, t in licenses.KNOWN if n == "ISC" and "\n\n" in t)
BSD3 = next(t for n, t in licenses.TEXTS if n == "BSD-3-Clause")
APACHE = next(t for n, t in licenses.KNOWN if n == "Apache-2.0" and len(t) > 200).replace(" http://", "\n\n    http://").replace(" Unless", "\n\nUnless")

CASES = [
    (f"MIT License\n\nCopyright (c) 2020 X\n\n{MIT}\n", "MIT", 2, "MIT"),
    (f"ISC License\nCopyright (c) 2020 X\n\n{ISC}", "ISC", 2, "ISC"),
    (f"# Tool\n\nSome words.\n\n{MIT}\n\nThe end.", None, 1, "MIT"),
    (f"{BSD3}\n\nThe rest.\n\n{ISC}", None, 2, "BSD-3-Clause,ISC"),
    ("/*\n" + "\n".join(f" * {x}" for x in f"Copyright 2020 X\n\n{APACHE}".split("\n")) + "\n */\n\ncode", None, 1, "Apache-2.0"),
    (MIT.replace("conditions:\n\n", "conditions:\n\nand one more\n\n"), None, 0, ""),
    (MIT.split("\n\n")[0], None, 0, ""),
]
FILES = dict(licenses.FILES)
CASES += [
    (f"preface\n\n{FILES['Apache-2.0']}\n\nafterwards", None, 6, "Apache-2.0"),  # the file, its terms with and without title and end, and the notice of the appendix
    ("\n".join(f"# {x}" for x in f"Copyright (c) 2021 X\n\n{FILES['MPL-2.0']}".split("\n")), "MPL-2.0", 2, "MPL-2.0"),  # and the notice of its exhibit
    (FILES["CC0-1.0"].replace('"', "\u201d").replace("'", "\u2019"), "CC0-1.0", 1, "CC0-1.0"),
    ("\n\n".join(["before", f"/*\n * (c) 1999 Y\n *\n{dict(licenses.SHORT)['Zlib']}\n */", "after"]), None, 1, "Zlib"),
    ("; Copyright 2003 B\n" + dict(licenses.SHORT)["BSL-1.0"].replace("organization", "organisation"), "BSL-1.0", 1, "BSL-1.0"),
    (FILES["GPL-3.0"], "GPL-3.0", 5, "GPL-3.0"),
    (FILES["GPL-2.0"].replace("gratis", "free"), None, 0, ""),
    ("\n\n".join(["The end.", "the start"] * 3000 + [MIT]), None, 1, "MIT"),
]


def test_entire_texts_are_found(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "doc_id long, text string")
    out = {r["doc_id"]: (r["whole_license"], r["n_hits"], r["licenses"]) for r in licenses.scanned(rows).collect()}
    assert out == {i: c[1:] for i, c in enumerate(CASES)}


def test_sql_agrees_on_entire_texts(spark, tmp_path):
    import duckdb

    rows = [(i, c[0]) for i, c in enumerate(CASES)] + [(100, None), (101, ""), (102, "\n\n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect(config={"max_temp_directory_size": "1GB", "temp_directory": f"{tmp_path}/spill"})
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    a, b = licenses.query(spark, str(tmp_path)).toArrow(), con.sql(licenses.ORACLE).to_arrow_table()
    assert sorted(map(str, a.to_pylist())) == sorted(map(str, b.select(a.column_names).to_pylist()))
