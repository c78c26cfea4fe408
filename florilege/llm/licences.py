"""Licence templates: what a licence, its notice or a reference to it says. All are public texts.

Fixed values: words are compared without case and punctuation, so these may stand in any layout. A label may have several
templates, whole licences and short references."""

_AS_IS = """AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS
FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING
IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution."""

_BY_HOLDER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "' + _AS_IS

_FREE = """is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {n}
of the License, or (at your option) any later version."""

_HOPE = """is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the GNU {name} for more details."""


def _gnu(label: str, name: str, n: str) -> list[tuple[str, str]]:
    return [
        (label, f"This program {_FREE.format(name=name, n=n)} This program {_HOPE.format(name=name)}"), (label, f"under the terms of the GNU {name} version {n}"), (label, f"under the terms of the GNU {name} v{n}"),
        (label, f"licensed under the GNU {name}, version {n}"), (label, f"released under the GNU {name}, version {n}"), (label, f"SPDX-License-Identifier: {label}-only"), (label, f"SPDX-License-Identifier: {label}-or-later"),
    ]


def _creative(label: str, letters: str, name: str) -> list[tuple[str, str]]:
    return [(label, f"licensed under {letters}"), (label, f"available under {letters}"), (label, f"under a Creative Commons {name} License"), (label, f"under the Creative Commons {name} License"), (label, f"Creative Commons {name} 4.0 International")]


#: label and text
TEMPLATES: list[tuple[str, str]] = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mit", "under the MIT License"), ("mit", "under the terms of the MIT License"), ("mit", "SPDX-License-Identifier: MIT"),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("apache-2.0", "under the Apache License, Version 2.0"), ("apache-2.0", "under the Apache 2.0 License"), ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("bsd-2-clause", f"{_BSD} {_BY_HOLDER}"), ("bsd-2-clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("bsd-3-clause", f"""{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific
prior written permission. {_BY_HOLDER}"""),
    ("bsd-3-clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The
origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation
would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be
removed or altered from any source distribution."""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
http://mozilla.org/MPL/2.0/."""),
    ("mpl-2.0", "under the Mozilla Public License, version 2.0"), ("mpl-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source
code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("public-domain", "released into the public domain"), ("public-domain", "dedicated to the public domain"),
    *_gnu("gpl-2.0", "General Public License", "2"), *_gnu("gpl-3.0", "General Public License", "3"), *_gnu("lgpl-2.1", "Lesser General Public License", "2.1"), *_gnu("lgpl-3.0", "Lesser General Public License", "3"),
    *_gnu("agpl-3.0", "Affero General Public License", "3"),
    *_creative("cc-by", "CC BY 4.0", "Attribution"), *_creative("cc-by-sa", "CC BY-SA", "Attribution-ShareAlike"), *_creative("cc-by-nc", "CC BY-NC", "Attribution-NonCommercial"), *_creative("cc-by-nd", "CC BY-ND", "Attribution-NoDerivatives"),
    *_creative("cc-by-nc-sa", "CC BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), *_creative("cc-by-nc-nd", "CC BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    ("cc0", "CC0 1.0 Universal"), ("cc0", "under the Creative Commons Zero"),
]

#: phrase and label
PHRASES: list[tuple[str, str]] = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
