"""Licences as they are found: re-wrapped, titled, with notices, and whole long ones."""

import re
import textwrap

from sonamark.llm import licences

NAMES = ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")


def text_of(name):
    return licences.importlib.resources.files("sonamark.llm").joinpath("licence_texts", f"{name}.txt").read_text(encoding="utf-8")


def wrapped(text, width):
    """Paragraphs wrapped to a width; a notice is a line of its own, as in any file."""
    parts = [p for p in re.split(r"\n[ \t]*\n|(?mi:^([ \t]*copyright (?:\(c\)|\[).*)$)", text) if p and p.strip()]
    notice = re.compile(r"(?i)\s*copyright (\(c\)|\[)")
    return "\n\n".join(p if notice.match(p) else textwrap.fill(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False) for p in parts)


def check(spark, cases):
    rows = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(cases)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.licence for r in licences.scan_licences(rows).collect()}
    assert [(want, got[i], text[:300]) for i, (want, text) in enumerate(cases) if want != got[i]] == []


def test_rewrapped(spark):
    names = ("ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause")
    cases = [(n, f"{title}Copyright (c) 2020, Someone\nAll rights reserved.\n\n" + wrapped(licences.KNOWN[n], w)) for n in names for title in ("", licences.TITLES[n][0] + "\n\n") for w in range(20, 121)]
    assert any(re.search(r"(?mi)^copyright notice", text) for n, text in cases if n == "ISC")
    check(spark, cases)


def test_usual_files(spark):
    isc = licences.KNOWN["ISC"].replace("provided that the above copyright", "provided that the above\ncopyright")
    bsd = licences.KNOWN["BSD-3-Clause"].replace("the above copyright notice, this", "the above\n   copyright notice, this")
    cases = [("ISC", isc), ("ISC", f"ISC License\n\nCopyright 2021 The Foo Authors\n\n{isc}"), ("BSD-3-Clause", f"BSD 3-Clause License\n\n(c) 2021 Foo\n\n{bsd}"), ("MIT", "The MIT License (MIT)\nCopyright \u00a9 Ann\n" + licences.KNOWN["MIT-body"]), ("BSD-3-Clause", re.sub(r"(?m)^\d\. ", "* ", bsd)), (None, isc.replace("fee", "a fee"))]
    cases += [("MIT", f"MIT License\n{notice}\n{licences.KNOWN['MIT-body']}") for notice in ("Copyright Foo, Inc.", "copyright: the foo developers", "Copyright, 2019-2021 Foo", "# Copyright (C) Foo", "Copyright by Ann", "\u00a9 2020 Foo", "(c) Copyright Foo", "Copyright <year> <holder>")]
    check(spark, cases)


def test_whole_texts(spark):
    cases = [(n, text_of(n)) for n in NAMES] + [(n, wrapped(text_of(n), w)) for n in NAMES for w in range(35, 115, 3)]
    cases += [(n, text_of(n)[: licences.END.search(text_of(n)).end()]) for n in NAMES if n not in ("LGPL-3.0", "MPL-2.0")]
    cases += [("Apache-2.0", text_of("Apache-2.0").replace("[yyyy] [name of copyright owner]", "2020 Someone"))]
    check(spark, cases)
