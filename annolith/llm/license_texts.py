"""Public license wordings (fixed values): what license_scan compares blocks with, and the words that tell a license.

Complete texts of the short licenses, the notices that the long ones prescribe for files, and common one-line notices.
Complete texts of long licenses are a parameter: `from_folder` reads a folder of them.
"""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass(frozen=True)
class Template:
    license: str
    text: str
    #: Words that must stand in a stretch for it to be this license and not a relative of it.
    telling: str = ""


_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation '
    'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions:"
)
_MIT_CONDITION = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
    "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:"
)
_BSD_1 = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
)
_BSD_2 = (
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission."
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, '
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
    "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
    "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE."
)
_APACHE_GRANT = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
    "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
)
_APACHE_WARRANTY = (
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
    '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific '
    "language governing permissions and limitations under the License."
)


def _gnu(subject: str, name: str, version: str, later: bool) -> str:
    """The notice that the GNU licenses prescribe."""
    which = f"either version {version} of the License, or (at your option) any later version" if later else f"version {version} of the License"
    verb = "as published by the Free Software Foundation" + ("; " if version.startswith("2") else ", ") + which
    return f"{subject} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} {verb}."


_GNU = (
    ("GPL", "General Public License", ("2", "3"), "gnu general"),
    ("LGPL", "Lesser General Public License", ("2.1", "3"), "gnu lesser"),
    ("AGPL", "Affero General Public License", ("3",), "gnu affero"),
)


def _short(license_: str, name: str, telling: str) -> list[Template]:
    """One-line notices of a license by its name."""
    forms = (f"Licensed under the {name}.", f"Released under the {name}.", f"Distributed under the {name}.", f"This work is licensed under the {name}.")
    return [Template(license_, x, telling) for x in forms]


def _all() -> tuple[Template, ...]:
    out = [
        Template("MIT", f"{_MIT_GRANT}\n\n{_MIT_CONDITION}\n\n{_AS_IS}", "sublicense noninfringement"),
        Template("MIT", _MIT_GRANT, "sublicense furnished"),
        Template("MIT", _AS_IS, "noninfringement dealings"),
        Template(
            "ISC",
            f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}",
            "fee disclaims tortious appear",
        ),
        Template("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.", "fee appear"),
        Template("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_WARRANTY}", "fee disclaims tortious"),
        Template("BSD-3-Clause", f"{_BSD_GRANT}\n\n{_BSD_1}\n\n{_BSD_2}\n\n{_BSD_3}\n\n{_BSD_WARRANTY}", "redistributions binary endorse"),
        Template("BSD-2-Clause", f"{_BSD_GRANT}\n\n{_BSD_1}\n\n{_BSD_2}\n\n{_BSD_WARRANTY}", "redistributions binary"),
        Template("BSD", _BSD_GRANT, "redistribution source binary"),
        Template("BSD", _BSD_WARRANTY, "holder contributors disclaimed"),
        Template("Apache-2.0", f"{_APACHE_GRANT}\n\n{_APACHE_WARRANTY}", "apache 2 0 compliance"),
        Template("Apache-2.0", _APACHE_GRANT, "apache 2 0 compliance"),
        Template(
            "MPL-2.0",
            "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
            "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
            "mozilla 2 0 obtain",
        ),
        Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla 2 0"),
        Template(
            "EPL-2.0",
            "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
            "available at https://www.eclipse.org/legal/epl-2.0/",
            "eclipse 2 0",
        ),
        Template(
            "EPL-1.0",
            "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public "
            "License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
            "eclipse accompanies",
        ),
        Template(
            "Zlib",
            "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
            "for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any "
            "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
            "restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
            "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is "
            "not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
            "original software.\n\n3. This notice may not be removed or altered from any source distribution.",
            "misrepresented acknowledgment altered",
        ),
        Template(
            "BSL-1.0",
            "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
            "https://www.boost.org/LICENSE_1_0.txt)",
            "boost 1 0",
        ),
        Template("BSL-1.0", "Distributed under the Boost Software License, Version 1.0.", "boost 1 0"),
        Template(
            "Unlicense",
            "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, "
            "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
            "commercial or non-commercial, and by any means.",
            "unencumbered anyone",
        ),
        Template("Unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered"),
        Template(
            "WTFPL",
            "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is "
            "allowed as long as the name is changed.\n\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, "
            "DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO.",
            "fuck verbatim",
        ),
        Template("CC0-1.0", "Released into the public domain under CC0 1.0.", "cc0 1 0"),
        Template(
            "CC0-1.0",
            "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
            "waived neighboring",
        ),
        Template("Proprietary", "All rights reserved.", "all rights reserved"),
    ]
    for short, name, versions, telling in _GNU:
        for version in versions:
            license_ = f"{short}-{version if '.' in version else version + '.0'}"
            number = version.replace(".", " ")
            for subject in ("This program", "This library") if short == "LGPL" else ("This program",):
                out.append(Template(f"{license_}-or-later", _gnu(subject, name, version, True), f"{telling} {number} later redistribute"))
                out.append(Template(f"{license_}-only", _gnu(subject, name, version, False), f"{telling} {number} redistribute"))
            out += _short(license_, f"GNU {name}, version {version}", f"{telling} {number}")
            out += _short(license_, f"{short} v{version}", f"{short} v {number}") + _short(license_, f"GNU {short} v{version}", f"gnu {short} v {number}")
            out.append(Template(license_, f"{short}-{version if '.' in version else version + '.0'} License", f"{short} {number} license"))
    out += _short("MIT", "MIT License", "mit license") + [Template("MIT", "The MIT License (MIT)", "mit license")]
    out += _short("ISC", "ISC License", "isc license")
    out += _short("Apache-2.0", "Apache License, Version 2.0", "apache 2 0")
    out += _short("MPL-2.0", "Mozilla Public License, version 2.0", "mozilla 2 0")
    out += _short("EPL-2.0", "Eclipse Public License 2.0", "eclipse 2 0") + [Template("EPL-2.0", "Eclipse Public License - v 2.0", "eclipse 2 0")]
    out += _short("BSD-3-Clause", "BSD 3-Clause License", "bsd 3 clause") + _short("BSD-2-Clause", "BSD 2-Clause License", "bsd 2 clause")
    out += _short("BSD-3-Clause", "3-Clause BSD License", "3 clause bsd") + _short("BSD-2-Clause", "2-Clause BSD License", "2 clause bsd")
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        name = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
        long = "-".join(name[x] for x in kind.split("-"))
        parts, words = kind.lower().replace("-", " "), long.lower().replace("-", " ")
        out.append(Template(f"CC-{kind}-4.0", f"Licensed under CC {kind} 4.0.", f"cc {parts} 4 0"))
        out.append(Template(f"CC-{kind}-4.0", f"This work is licensed under CC {kind} 4.0.", f"cc {parts} 4 0"))
        out.append(Template(f"CC-{kind}-4.0", f"This work is licensed under a Creative Commons {long} 4.0 International License.", f"creative commons {words} 4 0"))
    return tuple(out)


TEMPLATES = _all()


def from_folder(folder: str) -> tuple[Template, ...]:
    """Complete texts of licenses, a file for each, named by the license (and .txt); they have no telling words, as their
    length tells them apart."""
    out = []
    for name in sorted(os.listdir(folder)):
        path = os.path.join(folder, name)
        if os.path.isfile(path) and not os.path.islink(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                out.append(Template(name.removesuffix(".txt"), f.read()))
    return tuple(out)
