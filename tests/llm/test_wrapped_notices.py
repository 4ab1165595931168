"""License scans of notices that are wrapped, as they stand in files."""

import textwrap

from siltstone.llm import licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version."""


def commented(text, mark):
    return "\n".join(f"{mark} {line}" for line in text.split("\n"))


def test_wrapped_notices(spark):
    docs = {
        1: "Copyright (c) 2020 Someone\n\n" + MIT,
        2: GPL,
        3: "first words\n" + commented(GPL, "#") + "\n#\n" + commented(MIT, "//"),
        4: "Permission is hereby granted, free of charge, to any person obtaining a copy\n\nof this software and associated documentation files",
        5: "Released under the MIT License.\n" + MIT,
        6: "\n".join(licenses.words_of(licenses.TEMPLATES["BSD"][0])),
        7: "the license of the house\nis free to any person of the place\nand the software is in the copy",
        8: "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0.",
        9: "a long line before " * 40 + "Licensed under the Apache\r\nLicense, Version 2.0. " + "and words after " * 40,
    }
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {(r["doc_id"], r["paragraph"], r["family"]) for r in licenses.scan(df).collect()}
    assert got == {(1, 2, "MIT"), (2, 0, "GPL"), (3, 1, "GPL"), (3, 6, "MIT"), (5, 0, "MIT"), (5, 1, "MIT"), (6, 0, "BSD"), (8, 0, "CC-BY-NC"), (8, 1, "CC-BY"), (9, 0, "Apache-2.0")}


def test_every_template_at_every_width(spark):
    want, rows = set(), []
    for family, texts in licenses.TEMPLATES.items():
        for text in texts:
            for width in (1, 30, 50, 72):
                if "\n" in (wrapped := textwrap.fill(text, width, break_long_words=False, break_on_hyphens=False)):
                    want.add((len(rows), family))
                    rows.append((len(rows), f"some words\n\n{wrapped}\n\nmore words"))
    got = [(r["doc_id"], r["family"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert set(got) == want and len(got) == len(want)
