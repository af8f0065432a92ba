"""Public wording of licence notices, and rules over their sentences.

Every sentence stands here in its full wording; what repeats with other names and versions is made by rule.
"""

from __future__ import annotations

import re


#: Words with which short statements begin, and what they may begin with.
FORM = "^(this (work|software|project|program|file) is )?(licensed|released|distributed|available) under (the |an? )?"
OPENINGS = ["this", "licensed", "released", "distributed", "available"]


def normal(sentence: str) -> str:
    """Lower case, letters and digits, single spaces; the words of FORM are one word."""
    return re.sub(FORM, "under ", re.sub(r"[\W_]+", " ", sentence.lower()).strip())


MIT = [
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
]
MIT_0 = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.'
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ZERO_BSD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."
BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
]
APACHE = [
    'Licensed under the Apache License, Version 2.0 (the "License");',
    "you may not use this file except in compliance with the License.",
    "You may obtain a copy of the License at",
]
MPL = [
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
]
EPL = "This program and the accompanying materials are made available under the terms of the Eclipse Public License {} which is available at https://www.eclipse.org/legal/epl-{}/"
UNLICENSE = [
    "This is free and unencumbered software released into the public domain.",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
]
ZLIB = [
    "This software is provided 'as-is', without any express or implied warranty.",
    "In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
]
BOOST = 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'
WTFPL = "This program is free software. It comes without any warranty, to the extent permitted by applicable law."
POSTGRESQL = "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."
CC0 = "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."
OFL = "This Font Software is licensed under the SIL Open Font License, Version 1.1."
HOPE = "This {} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
GNU = "This {} is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, {}"
#: GNU licences: name, versions, short name.
GNU_NAMES = [("GNU General Public License", ("2", "3"), "GPL"), ("GNU Lesser General Public License", ("2.1", "3"), "LGPL"), ("GNU Affero General Public License", ("3",), "AGPL")]
PROGRAMS = ["program", "library", "file", "software"]

#: Names by which short statements call a licence.
NAMES = {
    "MIT": ["MIT License", "MIT licence"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License"],
    "BSD-4-Clause": ["BSD 4-Clause License"],
    "0BSD": ["BSD Zero Clause License"],
    "ISC": ["ISC License"],
    "MIT-0": ["MIT No Attribution License"],
    "Zlib": ["zlib License"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "Unlicense": ["Unlicense"],
    "WTFPL": ["WTFPL", "Do What The F*ck You Want To Public License"],
    "MPL-1.1": ["Mozilla Public License 1.1", "Mozilla Public License Version 1.1"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0"],
    "EPL-1.0": ["Eclipse Public License 1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v. 2.0"],
    "EUPL-1.2": ["European Union Public Licence 1.2", "EUPL 1.2"],
    "CDDL-1.0": ["Common Development and Distribution License 1.0"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "PostgreSQL": ["PostgreSQL License"],
    "NCSA": ["University of Illinois/NCSA Open Source License"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"],
    "MS-PL": ["Microsoft Public License"],
    "AFL-3.0": ["Academic Free License version 3.0"],
    "Python-2.0": ["Python Software Foundation License Version 2"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0"],
    "ODbL-1.0": ["Open Database License 1.0"],
    "GPL-2.0-only": ["GNU General Public License, version 2", "GNU GPL version 2", "GPLv2"],
    "GPL-3.0-only": ["GNU General Public License, version 3", "GNU GPL version 3", "GPLv3"],
    "LGPL-2.1-only": ["GNU Lesser General Public License, version 2.1", "LGPLv2.1"],
    "LGPL-3.0-only": ["GNU Lesser General Public License, version 3", "LGPLv3"],
    "AGPL-3.0-only": ["GNU Affero General Public License, version 3", "AGPLv3"],
}
CREATIVE = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _kind, _long in CREATIVE.items():
    for _v in ("2.0", "2.5", "3.0", "4.0"):
        _scope = {"4.0": "International", "3.0": "Unported"}.get(_v, "Generic")
        NAMES[f"CC-{_kind}-{_v}"] = [f"CC {_kind} {_v}", f"Creative Commons {_long} {_v} {_scope} License", f"Creative Commons {_long} {_v} License", f"Creative Commons {_long} {_v}"]


class Catalogue:
    """Sentences by number, other wordings of them, and ordered rules (licence, numbers that stand in a row)."""

    def __init__(self):
        self.sentences: dict[int, str] = {}
        self.known: dict[str, int] = {}
        self.rules: list[tuple[str, tuple[int, ...]]] = []

    def id(self, *wordings: str) -> int:
        """The number of a sentence; other wordings get the same."""
        texts = [normal(w) for w in wordings]
        found = next((self.known[t] for t in texts if t in self.known), len(self.sentences) + 1)
        self.sentences.setdefault(found, texts[0])
        for t in texts:
            self.known.setdefault(t, found)
        return found

    def rule(self, licence: str, *ids: int) -> None:
        if (licence, ids) not in self.rules:
            self.rules.append((licence, ids))


def catalogue() -> Catalogue:
    c = Catalogue()
    whole, *rest = MIT
    mit = c.id(whole, whole.replace(", including without limitation", "\n").split("\n")[0])
    notice, as_is = c.id(rest[0]), c.id(rest[1], rest[1].replace(", INCLUDING BUT", "\n").split("\n")[0])
    head, source, binary, names, adverts = (c.id(x) for x in BSD)
    c.rule("BSD-4-Clause", head, source, binary, adverts)
    c.rule("BSD-3-Clause", head, source, binary, names)
    c.rule("BSD-2-Clause", head, source, binary)
    c.rule("MIT", mit, notice, as_is)
    c.rule("MIT", mit, notice)
    c.rule("MIT", mit)
    c.rule("MIT-0", c.id(MIT_0))
    c.rule("ISC", c.id(ISC, ISC.replace("and/or", "and")))
    c.rule("0BSD", c.id(ZERO_BSD))
    apache, use, copy = c.id(APACHE[0]), c.id(APACHE[1]), c.id(APACHE[2], APACHE[2] + " http://www.apache.org/licenses/LICENSE-2.0", APACHE[2] + " https://www.apache.org/licenses/LICENSE-2.0")
    c.rule("Apache-2.0", apache, use, copy)
    c.rule("Apache-2.0", apache)
    mpl = [c.id(MPL[0]), c.id(MPL[1], MPL[1].replace("https", "http"), MPL[1].replace("You", "you"))]
    c.rule("MPL-2.0", *mpl)
    c.rule("MPL-2.0", mpl[0])
    for v in ("1.0", "2.0"):
        for shown in (v, f"v{v}", f"v. {v}"):
            c.rule(f"EPL-{v}", c.id(EPL.format(shown, v)))
    free = [c.id(x) for x in UNLICENSE]
    c.rule("Unlicense", *free)
    c.rule("Unlicense", free[0])
    zlib = [c.id(x) for x in ZLIB]
    c.rule("Zlib", *zlib)
    c.rule("BSL-1.0", c.id(BOOST))
    c.rule("WTFPL", c.id(WTFPL))
    c.rule("PostgreSQL", c.id(POSTGRESQL))
    c.rule("CC0-1.0", c.id(CC0))
    c.rule("OFL-1.1", c.id(OFL))
    for program in PROGRAMS:
        hope = c.id(HOPE.format(program))
        for name, versions, short in GNU_NAMES:
            see = c.id(f"See the {name} for more details.")
            for v in versions:
                full = v if "." in v else f"{v}.0"
                later = c.id(GNU.format(program, name, f"either version {v} of the License, or (at your option) any later version."), GNU.format(program, name, f"either version {v} of the License, or any later version."))
                only = c.id(GNU.format(program, name, f"version {v} of the License."), GNU.format(program, name, f"version {v}."))
                for own, kind in ((later, "or-later"), (only, "only")):
                    c.rule(f"{short}-{full}-{kind}", own, hope, see)
                    c.rule(f"{short}-{full}-{kind}", own, hope)
                    c.rule(f"{short}-{full}-{kind}", own)
    for licence, called in NAMES.items():
        forms = [f"Licensed under {name}" for name in called]
        c.rule(licence, c.id(*forms, f"SPDX-License-Identifier: {licence}"))
        later = licence.replace("-only", "-or-later")
        if later != licence:
            c.rule(later, c.id(*(f"{f} or later" for f in forms), *(f"{f} or any later version" for f in forms), f"SPDX-License-Identifier: {later}"))
    for program in PROGRAMS:
        c.rule("GPL-unspecified", c.id(f"This {program} is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License."))
    c.rule("Public-Domain", c.id("This work is dedicated to the public domain.", "This work is in the public domain.", "This software is in the public domain.", "Released into the public domain."))
    c.rule("All-Rights-Reserved", c.id("All rights reserved."))
    return c
