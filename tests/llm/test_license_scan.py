import random
import re

from tidemill.llm import license_scan as S

TEXTS = [
    None, "", "Released under the MIT License, (MIT license)!", "apache license; GNU General Public License version 3", "Licensed under the Apache License, Version 2.0.", "mitlicense mit-license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy", "SPDX-License-Identifier: GPL-3.0-or-later", "no licence at all", "x " * 30_000 + "MIT license", "cc by nc sa 4.0 and BSD 3-Clause license", "MIT MIT license license",
]


def words(t):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def test_base_places(spark):
    df = spark.createDataFrame([(i, t, "l", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, labels string, base int")
    got = {r.doc_id: r for r in S.license_report(df).collect()}
    for i, t in enumerate(TEXTS):
        w = words(t)
        at = sorted((j, label) for p, label in S.BASE.items() for j in range(len(w)) if w[j:j + len(p.split())] == p.split())
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1
    assert "apache-2.0" in got[4].labels and "gpl-3" in got[7].labels and "mit" in got[6].labels and "cc-by-nc-sa-4.0" in got[10].labels and got[8].labels == ""


def sample(parsed, rng):
    """A text that an expression of literals, classes, groups, alternatives and repetitions matches."""
    out = ""
    for op, x in parsed:
        op = str(op)
        if op == "LITERAL":
            out += chr(x)
        elif op == "IN":
            out += chr(x[0][1])
        elif op == "ANY":
            out += "z"
        elif op == "MAX_REPEAT":
            out += "".join(sample(x[2], rng) for _ in range(rng.choice([x[0], min(x[1], x[0] + 1)])))
        elif op == "SUBPATTERN":
            out += sample(x[3], rng)
        elif op == "BRANCH":
            out += sample(rng.choice(x[1]), rng)
        else:
            assert op == "ASSERT_NOT", op
    return out


def test_every_match_has_one_of_its_rules_keywords():
    rng = random.Random(0)
    rules = S.build_rules()
    assert len(rules) > 200 and len({r.pattern.pattern for r in rules}) == len(rules)
    for r in rules:
        parsed = re._parser.parse(r.pattern.pattern)
        for _ in range(30):
            text = sample(parsed, rng)
            assert r.pattern.fullmatch(text) and set(r.keywords) & set(text.split(" ")), (r, text)


LABELLED = {
    "Licensed under GPLv3": "gpl-3", "GPLv2+ applies": "gpl-2", "under the terms of the LGPLv2.1": "lgpl-2.1", "AGPLv3": "agpl-3", "this is MPLv2 code": "mpl-2.0", "GPL3": "gpl-3", "Apache2 license": "apache-2.0",
    "SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: LGPL-2.1-only": "lgpl-2.1", "GNU GPL v2 or any later version": "gpl-2", "GNU General Public License, version 3": "gpl-3",
    "released into the public domain": "public-domain", "Licence: BSD": "bsd", "the BSD 3-Clause licence": "bsd-3-clause", "CC BY-SA 4.0": "cc-by-sa-4.0", "http://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa-4.0",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd", "Mozilla Public License 2.0": "mpl-2.0",
    "Distributed under the Boost Software License, Version 1.0.": "bsl-1.0", "MIT licensed": "mit", "http://www.apache.org/licenses/LICENSE-2.0": "apache-2.0", "Unauthorized copying of this file, via any medium is strictly prohibited": "proprietary",
    "License: MIT": "mit", 'license = "MIT"': "mit", '"license": "MIT"': "mit", "The license is MIT.": "mit", "licensed under the MIT": "mit", "under the terms of the ISC license": "isc", "dual licensed under BSD": "bsd",
    "GPLv2 with classpath exception": "gpl-2-classpath", "with the Classpath Exception": "gpl-2-classpath",
}
PROSE = [
    "This tool is used by the ruby community and provided by php.", "Published by MIT in 2020.", "The Apache helicopters flew over the boost pump.", "He studied at MIT and then at the university of Illinois.",
    "Vim is an editor; curl fetches pages.", "The Python Software Foundation met in spring.", "General public opinion on library books is good.", "Creative commons in the village were grazed by sheep.",
    "Our elastic bands come in two sizes.", "The zlib code was written in C.", "A driving license is needed here.", "The eclipse was seen by the European Union's public.", "Open software is a common goal.", "The isc met; cc: all.",
    "Admission is subject to MIT rules.", "Data available under MIT supervision.", "Papers published under ISC in Zurich.", "Driver license mit Foto.", "Die Licence: mitgebracht.", "A classpath exception occurred in Java.",
    "It is covered under BSD care.", "Released under MIT pressure: nothing.",
]


def test_labels_and_prose(spark):
    rows = [*LABELLED, *PROSE]
    got = {r.doc_id: r for r in S.license_report(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    for i, t in enumerate(rows):
        labels = got[i].labels.split(",")
        assert LABELLED[t] in labels if t in LABELLED else labels == [""] and got[i].score == 0, (t, labels)


def test_suppression_against_all_pairs():
    rng = random.Random(1)
    for _ in range(200):
        found = []
        for k in range(rng.randrange(12)):
            a = rng.randrange(10)
            found.append((a, a + rng.randrange(1, 5), rng.choice([10, 50]), k))
        rank = lambda x: (-x[2], x[0] - x[1], x[3], x[0])
        want = [any(rank(y) < rank(x) and y[0] <= x[0] and y[1] >= x[1] for y in found) for x in found]
        assert S.suppressed(found) == want


def test_empty(spark):
    assert S.license_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
