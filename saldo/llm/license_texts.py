"""Wordings by which texts state their license. The notices and texts as the licenses themselves give them."""

_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:"
)
_SOURCE = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
)
_BINARY = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution."
)
_ENDORSE = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission."
)
_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction'
)
_MIT = (
    f"{_GRANT}, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or "
    "sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
    "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
    'of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT "
    "OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "
    '"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
    "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
    "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any "
    "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
    "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
    "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
    "is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
    "original software. 3. This notice may not be removed or altered from any source distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
    "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
    "commercial or non-commercial, and by any means."
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
    "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
)


def _gnu(name: str, version: int, later: bool) -> str:
    """The header that the GNU licenses ask for in each file."""
    which = f"either version {version} of the License, or (at your option) any later version." if later else f"version {version}."
    return (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        f"{name} as published by the Free Software Foundation, {which}"
    )


#: Template -> (license, wording).
TEXTS = {
    "Apache-2.0": ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    "Apache-2.0-header": ("Apache-2.0", _APACHE),
    "BSD": ("BSD", _REDISTRIBUTION),
    "BSD-2-Clause": ("BSD-2-Clause", f"{_REDISTRIBUTION} 1. {_SOURCE} 2. {_BINARY} {_DISCLAIMER}"),
    "BSD-3-Clause": ("BSD-3-Clause", f"{_REDISTRIBUTION} 1. {_SOURCE} 2. {_BINARY} 3. {_ENDORSE} {_DISCLAIMER}"),
    "CC-BY-4.0": ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    "CC-BY-NC-4.0": ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    "CC-BY-SA-4.0": (
        "CC-BY-SA-4.0",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-4.0-name": ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    "GPL-2.0": ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    "GPL-3.0": ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    "LGPL-3.0": ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    "GPL-2.0-or-later": ("GPL-2.0-or-later", _gnu("General Public License", 2, True)),
    "GPL-3.0-or-later": ("GPL-3.0-or-later", _gnu("General Public License", 3, True)),
    "LGPL-3.0-or-later": ("LGPL-3.0-or-later", _gnu("Lesser General Public License", 3, True)),
    "AGPL-3.0-or-later": ("AGPL-3.0-or-later", _gnu("Affero General Public License", 3, True)),
    "GPL-2.0-only": ("GPL-2.0", _gnu("General Public License", 2, False)),
    "GPL-3.0-only": ("GPL-3.0", _gnu("General Public License", 3, False)),
    "ISC": ("ISC", _ISC),
    "MIT": ("MIT", "Released under the MIT License."),
    "MIT-grant": ("MIT", _GRANT),
    "MIT-text": ("MIT", _MIT),
    "MPL-2.0": ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    "Unlicense": ("Unlicense", _UNLICENSE),
    "Zlib": ("Zlib", _ZLIB),
}
#: Identifiers whose tag line counts as a notice.
_TAGGED = (
    "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0-only",
    "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
)
TEXTS |= {f"{x}-tag": (x.removesuffix("-only"), f"SPDX-License-Identifier: {x}") for x in _TAGGED}
