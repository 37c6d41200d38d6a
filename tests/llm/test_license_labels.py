"""Label sets of licence texts that the bag of words alone can't tell apart."""

from strandlake.llm import license_scan

LABELS = {
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "Licensed under CC BY-SA 4.0.": "cc-by-sa",
    "Licensed under CC BY-NC-SA 4.0.": "cc-by-nc,cc-by-sa",
    "Licensed under CC BY 4.0.": "",
    "Licensed under CC BY 4.0, Raleigh NC": "",
    "Released under the MIT License": "mit",
    "Released under the MIT": "mit",
    "Released under the Apache License": "apache",
    "Licensed under the BSD license, version 2.0": "",
    "Licensed under Apache version 2.0 license": "apache",
    "This work is licensed under the Mozilla Public License, version 3": "",
    "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License": "",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License": "gpl",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "",
}


def labels(spark, texts):
    found = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {texts[r.doc_id]: r.labels for r in found}


def test_labels_are_exact(spark):
    assert labels(spark, list(LABELS)) == LABELS


def test_marks_belong_to_templates():
    assert set(license_scan.MARKS) <= {text for _, text in license_scan.TEMPLATES}
    assert set(license_scan.NOT_AFTER) <= {m for marks in license_scan.MARKS.values() for m in marks}


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:"""


def test_wrapped_texts(spark):
    commented = "\n".join(f" * {line}" for line in BSD.split("\n"))
    narrow = "\n".join(MIT.split())
    filler = "\n".join(f"some other line number {k} of the file" for k in range(40))
    want = {MIT: "mit", BSD: "bsd", commented: "bsd", narrow: "mit", f"{filler}\n{MIT}\n{filler}": "mit", f"{filler}\n{BSD}\n{filler}\n{MIT}": "bsd,mit", filler: ""}
    assert labels(spark, list(want)) == want


def test_windows_hold_the_word():
    for n in (1, 5, 31, 32, 33, 64, 65, 96, 97, 200):
        for at in range(n):
            assert license_scan._windows(at, n, 64) == [s for s in range(0, max(n - 32, 1), 32) if s <= at < s + 64]
