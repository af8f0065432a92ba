import random
import re
import textwrap

import pytest

from vaultlens.llm import licence_texts as T, licences

MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction. "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
    "The Software is provided \"as is\", without warranty of any kind, express or implied."
)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Prose here. Licensed under the Apache License, Version 2.0. More", [("Apache-2.0", 1, 1)]),
        (MIT, [("MIT", 0, 1)]),
        # the notice without the disclaimer behind it, and the short form twice
        (MIT.split("\n")[0] + "\nReleased under the MIT License. Released under the  MIT license!", [("MIT", 0, 3)]),
        ("Licensed under CC BY-NC 4.0.\nAll rights reserved.\n", [("All-Rights-Reserved", 1, 1), ("CC-BY-NC-4.0", 0, 1)]),
        # parts of a rule that another sentence parts don't make it
        ("Licensed under the Apache License, Version 2.0 (the License). Well. You may not use this file except in compliance with the License. You may obtain a copy of the License at", [("Apache-2.0", 0, 1)]),
        ("We licensed under the Apache License, Version 2.0, nothing", []),
        ("", []),
        (None, []),
        ("é" * 50_000 + "\nReleased under the MIT License.", [("MIT", 1, 1)]),
    ],
)
def test_rules(spark, text, want):
    rows = licences.licences(spark.createDataFrame([(1, text, 5)], "doc_id long, text string, ids int")).collect()
    assert sorted((r.licence, r.first_sentence, r.times) for r in rows) == want


def test_repeated_rows_and_none(spark, nothing):
    df = spark.createDataFrame([(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "All rights reserved")], "doc_id long, text string")
    assert sorted(str((r.doc_id, r.licence)) for r in licences.licences(df).collect()) == ["(1, 'MIT')", "(1, 'MIT')", "(None, 'All-Rights-Reserved')"]
    assert licences.licences(nothing).count() == 0


def test_rules_use_known_sentences():
    assert all(i in licences.SENTENCES for _, ids in licences.RULES for i in ids)
    assert len(set(licences.SENTENCES.values())) == len(licences.SENTENCES)
    assert len({licence for licence, _ in licences.RULES}) >= 40


def test_the_filter_lets_every_known_sentence_through():
    # every opening of a short statement, which "under" stands for, may go before them
    assert all(any(w in s for w in licences.TELLING) or re.search(licences.OR, s) for s in licences.KNOWN)


def sentence(texts, wrap=0, mark="", caps=False):
    text = " ".join(texts)
    lines = textwrap.wrap(text.upper() if caps else text, wrap, break_long_words=False, break_on_hyphens=False) if wrap else [text]
    return "Some file of ours.\n\n" + "\n".join(mark + x for x in lines) + "\n\nThe end"


def notices():
    """Each licence's own notice, in the wording of its text."""
    out = {"MIT": T.MIT, "MIT-0": [T.MIT_0], "ISC": [T.ISC], "0BSD": [T.ZERO_BSD], "BSD-2-Clause": T.BSD[:3], "BSD-3-Clause": T.BSD[:4], "BSD-4-Clause": [*T.BSD[:3], T.BSD[4]], "Apache-2.0": [*T.APACHE, "http://www.apache.org/licenses/LICENSE-2.0"]}
    out |= {"MPL-2.0": T.MPL, "EPL-2.0": [T.EPL.format("v. 2.0", "2.0")], "Unlicense": T.UNLICENSE, "Zlib": T.ZLIB, "BSL-1.0": [T.BOOST], "WTFPL": [T.WTFPL], "PostgreSQL": [T.POSTGRESQL], "CC0-1.0": [T.CC0], "OFL-1.1": [T.OFL]}
    for name, versions, short in T.GNU_NAMES:
        for v in versions:
            later = T.GNU.format("program", name, f"either version {v} of the License, or (at your option) any later version.")
            out[f"{short}-{v if '.' in v else v + '.0'}-or-later"] = [later, T.HOPE.format("program"), f"See the {name} for more details."]
    for licence, called in T.NAMES.items():
        out.setdefault(licence, [f"This work is licensed under the {called[-1]}."])
    return out


def test_standard_notices_whole_wrapped_and_in_comments(spark):
    rows = []
    for licence, texts in notices().items():
        for how, text in enumerate((sentence(texts), sentence(texts, 60), sentence(texts, 70, " * "), sentence(texts, 34, "# "), sentence(texts, 80, "// ", True))):
            rows.append((how, licence, text))
    # numbered and lettered lists
    rows += [(5, "BSD-3-Clause", f"{T.BSD[0]}\n\n" + "\n".join(f"  {m} {x}" for m, x in zip(marks, T.BSD[1:4]))) for marks in (("1.", "2.", "3."), ("(a)", "(b)", "(c)"), ("*", "*", "*"), ("i)", "ii)", "iii)"))]
    df = spark.createDataFrame([(k, text) for k, (_, _, text) in enumerate(rows)], "doc_id long, text string")
    found = {}
    for r in licences.licences(df).collect():
        found.setdefault(r.doc_id, set()).add(r.licence)
    assert {rows[k][:2]: found.get(k) for k in range(len(rows))} == {x[:2]: {x[1]} for x in rows}


def brute(text):
    """(licence, first unit, times) by plain Python."""
    lowered = re.sub(r"(?m)^[^\w\n]*(?:[0-9]{1,2}|[a-z]|[ivx]{1,4})\)[ \t]", "", re.sub(r"([.!?;:])[ \t\n\r\f\v]+", r"\1\n", (text or "").lower()))
    units = [u for x in lowered.split("\n") if (u := re.sub(r"[\W_]+", " ", x).strip()) and not re.fullmatch("[0-9]{1,2}|[a-z]|[ivx]{1,4}", u)]
    ids, at = [], 0
    while at < len(units):
        k = next((k for k in range(min(licences.UNITS, len(units) - at), 0, -1) if T.normal(" ".join(units[at : at + k])) in licences.KNOWN), 0)
        ids.append((licences.KNOWN[T.normal(" ".join(units[at : at + k]))] if k else 0, at))
        at += k or 1
    out = {}
    for licence, want in licences.RULES:
        at = 0
        while at < len(ids):
            if tuple(i for i, _ in ids[at : at + len(want)]) == want:
                first, n = out.get(licence, (ids[at][1], 0))
                out[licence] = (min(first, ids[at][1]), n + 1)
                ids[at : at + len(want)] = [(-1, p) for _, p in ids[at : at + len(want)]]
                at += len(want)
            else:
                at += 1
    return sorted((licence, *v) for licence, v in out.items())


def test_against_brute_force(spark, docs):
    rng, pool = random.Random(8), [*T.MIT, *T.BSD, *T.APACHE, *T.MPL, *T.ZLIB, "Released under GPLv3.", "All rights reserved.", "Some prose here; more of it.", "Copyright 2020 by us", "SPDX-License-Identifier: MIT"]
    texts = [rng.choice(["\n", " ", "\n\n"]).join(rng.choice(pool) for _ in range(rng.randrange(1, 9))) for _ in range(120)]
    texts = [t if rng.random() < 0.5 else textwrap.fill(t, 50, break_long_words=False, break_on_hyphens=False) for t in texts]
    texts += [r.text for r in docs.collect()]
    have = {}
    for r in licences.licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        have.setdefault(r.doc_id, []).append((r.licence, r.first_sentence, r.times))
    assert {k: sorted(v) for k, v in have.items()} == {k: v for k, t in enumerate(texts) if (v := brute(t))}
