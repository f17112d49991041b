"""Public licence texts beyond the fixed list, and short notices that name a licence.

Headers and clauses are matched by containment as in ``licenses``.  A notice is too short for
shingles; it is found word by word: what is licensed "under" a named licence, an SPDX line,
or "all rights reserved".
"""

from __future__ import annotations

import re

from gsx.llm.licenses import TEMPLATES


def _gnu(name: str, version: str) -> str:
    return (
        f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
        f"{name} as published by the Free Software Foundation; either version {version} of the License, or (at "
        f"your option) any later version. This program is distributed in the hope that it will be useful, but "
        f"WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        f"PURPOSE. See the GNU {name} for more details."
    )


_BSD2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
    "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
    "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution."
)
TEXTS = TEMPLATES | {
    "GPL-2.0": _gnu("General Public License", "2"),
    "LGPL-2.1": _gnu("Lesser General Public License", "2.1"),
    "LGPL-3.0": _gnu("Lesser General Public License", "3"),
    "AGPL-3.0": _gnu("Affero General Public License", "3"),
    "BSD-2-Clause": _BSD2,
    "BSD-3-Clause": _BSD2
    + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public "
        "License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"
    ),
    "EPL-1.0": (
        "All rights reserved. This program and the accompanying materials are made available under the terms of the "
        "Eclipse Public License v1.0 which accompanies this distribution, and is available at "
        "http://www.eclipse.org/legal/epl-v10.html"
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring "
        "rights to this software to the public domain worldwide. This software is distributed without any warranty."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the "
        "software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, "
        "display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors "
        "be held liable for any damages arising from the use of this software. Permission is granted to anyone to "
        "use this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions"
    ),
}

_VERSION = rb"(?:[\s,(-]*(?:version\s*|v\.?\s*)?(\d(?:\.\d)?)\b)?"
_LICENCE = rb"(?:\s+(?:software\s+)?(?:public\s+)?licen[cs]e)?"
#: Name of a licence -> pattern; the last group, if any, is its version.
_NAMES = [
    ("AGPL", rb"(?:gnu\s+)?(?:affero\s+general\s+public\s+licen[cs]e|agpl)(?:\s*\(agpl\))?" + _VERSION),
    ("LGPL", rb"(?:gnu\s+)?(?:(?:lesser|library)\s+general\s+public\s+licen[cs]e|lgpl)(?:\s*\(lgpl\))?" + _VERSION),
    ("GPL", rb"(?:gnu\s+)?(?:general\s+public\s+licen[cs]e|gpl)(?:\s*\(gpl\))?" + _VERSION),
    ("Apache", rb"apache" + _LICENCE + _VERSION),
    ("MPL", rb"(?:mozilla\s+public\s+licen[cs]e|mpl)" + _VERSION),
    ("EPL", rb"(?:eclipse\s+public\s+licen[cs]e|epl)" + _VERSION),
    ("EUPL", rb"(?:european\s+union\s+public\s+licen[cs]e|eupl)" + _VERSION),
    ("BSL", rb"(?:boost\s+software\s+licen[cs]e|bsl)" + _VERSION),
    ("Artistic", rb"artistic" + _LICENCE + _VERSION),
    ("CC0", rb"(?:creative\s+commons\s+)?cc0" + _VERSION),
    ("BSD-2-Clause", rb"(?:(?:2|two)[\s-]clause\s+bsd|simplified\s+bsd|bsd[\s-]2)\b"),
    ("BSD-3-Clause", rb"(?:(?:3|three)[\s-]clause\s+bsd|(?:new|modified|revised)\s+bsd|bsd[\s-]3)\b"),
    ("BSD", rb"bsd\b"),
    ("MIT", rb"(?:mit|expat)\b"),
    ("ISC", rb"isc\b"),
    ("Unlicense", rb"unlicense\b"),
    ("Zlib", rb"zlib\b"),
    ("WTFPL", rb"wtfpl\b"),
]
_CC = re.compile(
    rb"(?:creative\s+commons|cc)[\s-]+(?:by\b|attribution)((?:[\s-]*(?:nc|sa|nd|non-?commercial|share-?alike|no-?deriv\w*)\b)*)"
    rb"(?:\s+licen[cs]e)?" + _VERSION
)
_LEAD = re.compile(
    rb"(?:\bunder\s+(?:(?:the|an?|terms|conditions|of|and)\s+)*|spdx-license-identifier:\s*|\blicen[cs]e:\s*)"
)
_COMPILED = [(name, re.compile(pattern)) for name, pattern in _NAMES]
_RESERVED = re.compile(rb"\ball\s+rights\s+reserved\b")


def _named(low: bytes, at: int) -> str | None:
    if m := _CC.match(low, at):
        parts = ["CC-BY"]
        for code, word in ((b"nc", b"commercial"), (b"nd", b"deriv"), (b"sa", b"share")):
            if re.search(rb"\b" + code + rb"\b", m[1]) or word in m[1]:
                parts.append(code.decode().upper())
        return "-".join([*parts, *([m[2].decode()] if m[2] else [])])
    for name, pattern in _COMPILED:
        if m := pattern.match(low, at):
            version = (m[1] or b"").decode() if pattern.groups else ""
            return name + (f"-{version}" if "." in version else f"-{version}.0" if version else "")
    return None


def notices(data: bytes) -> list[tuple[str, int]]:
    """(licence-notice, byte at which it begins) of every notice."""
    low = data.lower()
    found = [(f"{n}-notice", m.start()) for m in _LEAD.finditer(low) if (n := _named(low, m.end()))]
    found += [("all-rights-reserved", m.start()) for m in _RESERVED.finditer(low)]
    return sorted(found, key=lambda f: f[1])
