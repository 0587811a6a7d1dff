"""Wordings of licenses and of notices that name them: the templates of the license scan.

``NAMES`` with ``PHRASES`` give the one-line notices; ``NOTICES`` are longer
passages as their publishers word them.  Further texts, as the full GPL, can be
given to the scan as a parameter of the same form.  ``demands`` says which words
a stretch must hold whole to be a notice of this license and no other: names
with their versions, wherever a template states them.
"""

from __future__ import annotations

# Names of licenses by their short identifiers. Fixed values.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"],
    "MIT": ["MIT License", "MIT licence", "terms of the MIT license"],
    "ISC": ["ISC License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "BSD-3-Clause"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License version 2.0", "GNU General Public License v2", "GNU General Public License v2.0", "GNU GPL version 2", "GNU GPL v2", "GPLv2", "GPL v2", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License version 3.0", "GNU General Public License v3", "GNU General Public License v3.0", "GNU GPL version 3", "GNU GPL v3", "GPLv3", "GPL v3", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPL version 2.1", "LGPLv2.1", "LGPL-2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3", "LGPL version 3", "LGPLv3", "LGPL-3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3", "AGPL version 3", "AGPLv3", "AGPL-3.0"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"],
    "EPL-1.0": ["Eclipse Public License, version 1.0", "Eclipse Public License v1.0"],
    "EPL-2.0": ["Eclipse Public License, version 2.0", "Eclipse Public License 2.0", "EPL 2.0"],
    "BSL-1.0": ["Boost Software License, Version 1.0"],
    "Zlib": ["zlib License", "zlib/libpng License"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal", "CC0 1.0"],
    "CC-BY-3.0": ["CC BY 3.0", "Creative Commons Attribution 3.0 Unported License"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-3.0": ["CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
}

# How notices name a license. Fixed values.
PHRASES = [
    "licensed under {}",
    "licensed under the {}",
    "licensed under a {}",
    "released under {}",
    "released under the {}",
    "distributed under the {}",
    "available under the {}",
    "published under {}",
    "subject to the {}",
    "under the terms of the {}",
    "SPDX-License-Identifier: {}",
]

_WARRANTY_MIT = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_WARRANTY_BSD = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission."
)


def _gnu(name: str, version: str, kind: str) -> list[str]:
    """The notice of a GNU license, and its last two paragraphs."""
    return [
        f"This {kind} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software "
        f"Foundation, either version {version} of the License, or (at your option) any later version.",
        f"This {kind} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software "
        f"Foundation; version {version} of the License.",
        f"This {kind} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
        f"or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of "
        f"the GNU {name} version {version} along with this {kind}.",
    ]


# Notices and license texts as their publishers word them. Fixed values.
NOTICES = {
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain '
        "a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations "
        "under the License.",
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, "
        "non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly "
        "perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ],
    "MIT": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY_MIT,
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS.",
    ],
    "BSD-2-Clause": [_BSD_TWO + " " + _WARRANTY_BSD, _BSD_TWO],
    "BSD-3-Clause": [f"{_BSD_TWO} {_BSD_THIRD} {_WARRANTY_BSD}", f"{_BSD_TWO} {_BSD_THIRD}", _BSD_THIRD],
    "GPL-2.0": _gnu("General Public License", "2", "program"),
    "GPL-3.0": _gnu("General Public License", "3", "program"),
    "LGPL-2.1": _gnu("Lesser General Public License", "2.1", "library"),
    "LGPL-3.0": _gnu("Lesser General Public License", "3", "library"),
    "AGPL-3.0": _gnu("Affero General Public License", "3", "program"),
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You "
        "can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/",
    ],
    "EPL-1.0": [
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which "
        "accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    ],
    "BSL-1.0": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
        'covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative '
        "works of the Software, and to permit third-parties to whom the Software is furnished to do so",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
}


def templates() -> dict[str, list[str]]:
    """All wordings by license."""
    out = {name: [phrase.format(n) for n in names for phrase in PHRASES] for name, names in NAMES.items()}
    for name, texts in NOTICES.items():
        out[name] = [*out[name], *texts]
    return out


# Names with their versions as the longer notices spell them; a notice that states one of a license's must hold one whole. Fixed values.
STATED = {
    "Apache-2.0": ["Apache License, Version 2.0"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0"],
    "EPL-1.0": ["Eclipse Public License v1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0"],
    "BSL-1.0": ["Boost Software License, Version 1.0"],
}
_GNU = {"GPL-2.0": ("General Public License", "2"), "GPL-3.0": ("General Public License", "3"), "LGPL-2.1": ("Lesser General Public License", "2.1"), "LGPL-3.0": ("Lesser General Public License", "3"), "AGPL-3.0": ("Affero General Public License", "3")}


def demands() -> dict[tuple[str, str], list[str]]:
    """By license and wording, what a stretch must hold word by word, versions to their end."""
    out = {(name, phrase.format(n)): [n] for name, names in NAMES.items() for n in names for phrase in PHRASES}
    for name, texts in NOTICES.items():
        for text in texts:
            out[name, text] = [n for n in STATED.get(name, []) if n in text]
            if name in _GNU:
                kind, version = _GNU[name]
                out[name, text] = [f"GNU {kind}", f"version {version}"]
    return out
