"""The licenses that operator 5 looks for: names in the phrases that state a license, standard headers, whole texts.

``license_texts`` holds whole texts as the licenses' authors print them. Each is cut into passages; a passage that another
text of the catalogue shares by half or more names no license and is left out.
"""

from __future__ import annotations

import re
from functools import cache
from pathlib import Path

BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a passage, and of the runs by which passages are compared.
PASSAGE, RUN = 28, 5

# Names of licenses, as they follow "under the" and the like.
NAMES = {
    "Apache": ["Apache License"],
    "Apache-1.1": ["Apache License 1.1", "Apache License, Version 1.1", "Apache Software License 1.1", "Apache-1.1"],
    "Apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0", "Apache Software License 2.0", "Apache License v2.0"],
    "MIT": ["MIT License", "MIT", "Expat License"],
    "ISC": ["ISC License", "ISC"],
    "zlib": ["zlib License", "zlib/libpng License"],
    "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0", "Boost Software License - Version 1.0", "BSL-1.0"],
    "BSD": ["BSD License", "BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause", "3-Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License"],
    "BSD-4-Clause": ["BSD 4-Clause License", "BSD-4-Clause", "4-Clause BSD License"],
    "0BSD": ["0BSD", "Zero-Clause BSD License"],
    "Unlicense": ["Unlicense"],
    "WTFPL": ["WTFPL"],
    "EPL-1.0": ["Eclipse Public License 1.0", "Eclipse Public License v1.0", "Eclipse Public License, Version 1.0", "EPL-1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License, Version 2.0", "EPL-2.0"],
    "EUPL-1.1": ["European Union Public Licence 1.1", "EUPL 1.1", "EUPL v1.1"],
    "EUPL-1.2": ["European Union Public Licence 1.2", "EUPL 1.2", "EUPL v1.2"],
    "CDDL-1.0": ["Common Development and Distribution License 1.0", "Common Development and Distribution License, Version 1.0", "CDDL-1.0"],
    "Artistic-1.0": ["Artistic License 1.0", "Artistic-1.0"],
    "Artistic-2.0": ["Artistic License 2.0", "Artistic-2.0"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1", "SIL Open Font License 1.1", "OFL-1.1"],
    "ODbL-1.0": ["Open Database License 1.0", "Open Database License v1.0", "ODbL", "ODbL-1.0"],
    "ODC-By-1.0": ["Open Data Commons Attribution License", "ODC-By-1.0"],
    "PDDL-1.0": ["Public Domain Dedication and License", "PDDL-1.0"],
    "PSF-2.0": ["Python Software Foundation License Version 2", "PSF License", "PSF-2.0"],
    "MPL-1.0": ["Mozilla Public License 1.0", "Mozilla Public License, Version 1.0", "MPL 1.0"],
    "MPL-1.1": ["Mozilla Public License 1.1", "Mozilla Public License, Version 1.1", "Mozilla Public License Version 1.1", "MPL 1.1"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"],
    "CC0-1.0": ["CC0 1.0", "CC0", "Creative Commons Zero", "Creative Commons CC0"],
    "GPL": ["GNU General Public License", "GNU GPL", "GPL"],
    "LGPL": ["GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPL"],
    "AGPL": ["GNU Affero General Public License", "GNU AGPL", "AGPL"],
    "GFDL": ["GNU Free Documentation License", "GFDL"],
}
_GNU = {
    "GPL": (["GNU General Public License", "GNU GPL", "GPL"], ["1", "2", "3"]),
    "LGPL": (["GNU Lesser General Public License", "GNU LGPL", "LGPL"], ["2.1", "3"]),
    "AGPL": (["GNU Affero General Public License", "GNU AGPL", "AGPL"], ["3"]),
    "GFDL": (["GNU Free Documentation License", "GFDL"], ["1.1", "1.2", "1.3"]),
}
_CC = {
    "BY": ["Attribution"],
    "BY-SA": ["Attribution-ShareAlike", "Attribution-Share Alike"],
    "BY-NC": ["Attribution-NonCommercial", "Attribution-Non-Commercial"],
    "BY-ND": ["Attribution-NoDerivatives", "Attribution-NoDerivs"],
    "BY-NC-SA": ["Attribution-NonCommercial-ShareAlike", "Attribution-Non-Commercial-Share Alike"],
    "BY-NC-ND": ["Attribution-NonCommercial-NoDerivatives", "Attribution-NonCommercial-NoDerivs"],
}
#: Licenses without a version; one of the family that has a version stands for them.
FAMILIES = ["Apache", "BSD", "GPL", "LGPL", "AGPL", "GFDL"]
# Names, titles and sentences that state a license by themselves.
NOTICES = [
    ("MIT", "MIT License"),
    ("BSD", "BSD License"),
    ("CC0-1.0", "CC0 1.0"),
    ("CC0-1.0", "Creative Commons Zero"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-2.0", "GPLv2"),
    ("GPL-3.0", "GPLv3"),
    ("LGPL-3.0", "LGPLv3"),
    ("LGPL-2.1", "LGPLv2.1"),
    ("AGPL-3.0", "AGPLv3"),
    ("GPL-1.0", "GNU General Public License Version 1, February 1989"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June"),
    ("LGPL-2.0", "GNU Library General Public License Version 2, June 1991"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("LGPL-2.0", "under the GNU Library General Public License, version 2"),
    (
        "MIT",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the"
        " Software.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "zlib",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter"
        " it and redistribute it freely",
    ),
    ("zlib", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and"
        " accompanying documentation covered by this license",
    ),
    (
        "BSD",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following"
        " disclaimer.",
    ),
    (
        "BSD-3-Clause",
        "nor the names of its contributors may be used to endorse or promote products derived from this software without"
        " specific prior written permission.",
    ),
    (
        "BSD-4-Clause",
        "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    ),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form"),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    ("EPL-1.0", "are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"),
    ("EPL-2.0", "are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("CDDL-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License"),
    ("CC0-1.0", "has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("CC0-1.0", "has waived all copyright and related or neighboring rights to"),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
]


def split(text: str) -> list[str]:
    return [w for w in re.split(BREAK, text.lower()) if w]


@cache
def notices() -> list[tuple[str, str]]:
    """(license, phrase or standard header) of every license known by name."""
    names = [(license, name) for license, own in NAMES.items() for name in own]
    out = list(NOTICES)
    for family, (own, versions) in _GNU.items():
        for v in versions:
            license = f"{family}-{v if '.' in v else v + '.0'}"
            names += [(license, form) for n in own for form in (f"{n} version {v}", f"{n} v{v}", f"{n} {v}", f"{n}v{v}")]
            full = own[0]
            published = "as published by the Free Software Foundation"
            out.append((license, f"under the terms of the {full} {published}, either version {v} of the License"))
            out.append((license, f"under the terms of the {full} version {v} {published}"))
            out.append((license, f"under the terms of the {full}, version {v}, {published}"))
    for kind, own in _CC.items():
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            license = f"CC-{kind}-{v}"
            names += [(license, f"CC {kind} {v}"), *((license, f"Creative Commons {n} {v}") for n in own)]
            out += [(license, f"creativecommons.org/licenses/{kind}/{v}")]
    for license, name in names:
        # A single word may name an institute too.
        starts = ("under the", "under", "under a", "License:") if len(split(name)) > 1 else ("licensed under", "licensed under the", "released under the")
        out += [(license, f"{start} {name}") for start in (*starts, "SPDX-License-Identifier:")]
    # Phrases that differ in punctuation only are the same words.
    return list({(license, *split(text)): (license, text) for license, text in out}.values())


@cache
def passages() -> list[tuple[str, str]]:
    """(license, passage) of the whole texts; a passage that versions of one family share stands for the family."""
    texts = {p.stem: split(p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}

    def runs(words: list[str]) -> set[tuple[str, ...]]:
        return {tuple(words[i : i + RUN]) for i in range(len(words) - RUN + 1)}

    known, out = {name: runs(words) for name, words in texts.items()}, {}
    for name, words in texts.items():
        for at in range(0, len(words) - RUN, PASSAGE):
            own = runs(words[at : at + PASSAGE])
            owners = {n for n in known if n == name or 2 * len(own & known[n]) >= len(own)}
            family = name.rsplit("-", 1)[0]
            # What versions of one family share names the family; what families share names none.
            shared = family if family in FAMILIES and all(n.rsplit("-", 1)[0] == family for n in owners) else None
            license = name if len(owners) == 1 else shared
            if len(own) > RUN and license:
                out[license, " ".join(words[at : at + PASSAGE])] = None
    return list(out)
