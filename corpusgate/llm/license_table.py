"""The known side of the licence scan: published texts, their headings and notices."""

from __future__ import annotations

from pathlib import Path

UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, "
    "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
    "purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the "
    "author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
    "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
    "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to "
    "this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
    "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
    "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>"
)
BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
    "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, "
    "execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to "
    "whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and "
    "this entire statement, including the above license grant, this restriction and the following disclaimer, must be "
    "included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such "
    "copies or derivative works are solely in the form of machine-executable object code generated by a source language "
    "processor.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO "
    "EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE."
)

# Lines, in canonical form, that only name a licence.
HEADINGS = [
    "license", "mit license", "the mit license", "mit license mit", "the mit license mit", "expat license",
    "mit no attribution", "mit no attribution license", "isc license", "the isc license", "isc license isc",
    "bsd license", "bsd 2 clause license", "the bsd 2 clause license", "simplified bsd license", "bsd 3 clause license",
    "the bsd 3 clause license", "new bsd license", "modified bsd license", "bsd zero clause license", "zero clause bsd",
    "zero clause bsd license", "0bsd", "zlib license", "the zlib license", "zlib libpng license", "the unlicense",
    "unlicense", "boost software license version 1 0 august 17th 2003", "boost software license version 1 0",
    "apache license", "apache license version 2 0", "apache license version 2 0 january 2004", "version 2 0 january 2004",
    "http www apache org licenses", "https www apache org licenses", "mozilla public license version 2 0",
    "creative commons legal code", "cc0 1 0 universal",
]

_PUBLISHED_BY_FSF = "general public license as published by the free software foundation either version"
_OR_LATER = "of the license or at your option any later version"
# Wordings, in canonical form, that put something under a licence wherever they stand.
WORDINGS = [
    ("AGPL-3.0-or-later", f"gnu affero {_PUBLISHED_BY_FSF} 3 {_OR_LATER}"),
    ("Apache-2.0", "licensed under the apache license version 2 0"),
    ("BSL-1.0", "distributed under the boost software license version 1 0"),
    ("CC-BY-4.0", "creative commons attribution 4 0 international license"),
    ("CC-BY-NC-4.0", "creative commons attribution non commercial 4 0 international license"),
    ("CC-BY-NC-4.0", "licensed under cc by nc 4 0"),
    ("CC-BY-SA-4.0", "creative commons attribution sharealike 4 0 international license"),
    ("GPL-2.0-or-later", f"gnu {_PUBLISHED_BY_FSF} 2 {_OR_LATER}"),
    ("GPL-3.0", "licensed under the gnu general public license version 3"),
    ("GPL-3.0-or-later", f"gnu {_PUBLISHED_BY_FSF} 3 {_OR_LATER}"),
    ("LGPL-2.1-or-later", f"gnu lesser {_PUBLISHED_BY_FSF} 2 1 {_OR_LATER}"),
    ("LGPL-3.0-or-later", f"gnu lesser {_PUBLISHED_BY_FSF} 3 {_OR_LATER}"),
    ("MIT", "distributed under the mit license"),
    ("MIT", "licensed under the mit license"),
    ("MIT", "released under the mit license"),
    ("MPL-2.0", "subject to the terms of the mozilla public license v 2 0"),
]

_NAMES = {
    "Artistic": "Artistic-1.0-Perl", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0",
    "LGPL-3": "LGPL-3.0",
}
_END = "END OF TERMS AND CONDITIONS"


def published(short: dict[str, str]) -> list[tuple[str, str]]:
    """``(license, text)`` of all known licences, with the forms a text is published in.

    ``short`` has the texts of 0BSD and MIT, from which ISC and MIT-0 differ by a clause.
    """
    rows = list(short.items())
    granted = "is hereby granted."
    notice = "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    isc = short["0BSD"].replace(granted, notice)
    rows += [("ISC", isc), ("ISC", isc.replace("and/or distribute", "and distribute"))]
    head, _, tail = short["MIT"].partition(", subject to the following")
    rows += [("MIT-0", head + ".\n\n" + tail[tail.index("THE SOFTWARE IS") :]), ("Unlicense", UNLICENSE), ("BSL-1.0", BOOST)]
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        if path.stem == "BSD":
            third, disclaimer = text.index("3. Neither"), text.index("THIS SOFTWARE IS")
            rows += [("BSD-3-Clause", text), ("BSD-2-Clause", text[:third] + text[disclaimer:])]
            continue
        name = _NAMES.get(path.stem, path.stem)
        rows.append((name, text))
        if _END in text:
            terms = text[: text.index(_END)]
            rows += [(name, terms), (name, terms + _END)]
    return rows
