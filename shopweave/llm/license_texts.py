"""Licence texts and one-line notices, digests of long licences, and spellings that licence matching holds equal."""

# fixed values: equivalent spellings (left is read as right), single words in lower case
SPELLINGS = """
acknowledgement acknowledgment
analogue analog
analyse analyze
artefact artifact
authorisation authorization
authorised authorized
calibre caliber
cancelled canceled
capitalisations capitalizations
catalogue catalog
categorise categorize
centre center
emphasised emphasized
favour favor
favourite favorite
fulfil fulfill
fulfilment fulfillment
https http
initialise initialize
judgement judgment
labelling labeling
labour labor
licence license
licenced licensed
licences licenses
maximise maximize
modelled modeled
modelling modeling
offence offense
optimise optimize
organisation organization
organise organize
practise practice
programme program
realise realize
recognise recognize
signalling signaling
utilisation utilization
whilst while
wilful willful
"""

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO
THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS
FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF
ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution.
"""

# fixed values: (licence, text)
KNOWN = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software.
""" + _WARRANTY),
    ("MIT-0", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so.
""" + _WARRANTY),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
""" + _ISC_WARRANTY),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
is hereby granted.
""" + _ISC_WARRANTY),
    ("BSD-2-Clause", _BSD_TWO + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_TWO + """3. Neither the name of the copyright holder nor the names of its contributors may be
used to endorse or promote products derived from this software without specific prior written permission.
""" + _BSD_WARRANTY),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the
authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and
to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be
appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "Licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

# fixed values: (licence, first two words, canonical digest) of long licences, as published: whole, and up to the end of the terms
DIGESTS = [
    ("Apache-2.0", "apache license", "2a0e79f9ef770a2c026a8996e68c55752825d9e5dd24151e44f7800e98620598"),
    ("Apache-2.0", "apache license", "336afa221a66766e5d71af3cfb899191b0659de3327b5746e8790a2eaf85fe05"),
    ("Artistic-1.0-Perl", "the artistic", "ab9e0a4960f3366c6e09c86510fe9dd469d242185a905b440792fcc4a45b46ef"),
    ("BSD-3-Clause", "redistribution and", "48c8a35a4353dae3524b849cfd2c781b3c935e964f465e15fb0bc23f23cf96ad"),
    ("CC0-1.0", "creative commons", "3e6e368fd02abd67188d1bf25b196ac79f5782b2079e9579134c5e3f71f9ab74"),
    ("GFDL-1.2-only", "gnu free", "763fd67087ee54c1928a00c7e66bd59138dfa48fb7cf636fe42a828b1c489bcd"),
    ("GFDL-1.3-only", "gnu free", "d76fb8c45f11b761aa1870334672b79fa828bbbd142bbd27f820e7f118b97ad6"),
    ("GPL-1.0-only", "gnu general", "3b7c00b08d5c6de2349faf7a31bb6e49ff8a2273a7cfdd16f96859720b00d9ef"),
    ("GPL-1.0-only", "gnu general", "f4d5622e8488e9135bbad4562a4dddb47eb06044ce19b0c0d2064503f5933de5"),
    ("GPL-2.0-only", "gnu general", "9aae015a6322bbdec1a61c624a33b2c7d3b56283db1642e6e18d7820d4957b61"),
    ("GPL-2.0-only", "gnu general", "3c9f4977ae65ec51dce2737640196c8c2d45aa4ba394ba71168fae3b8a4cc93f"),
    ("GPL-3.0-only", "gnu general", "ab75edbf73a72121bdba9fb3af792f1b33a1533edb22a286043c7478d958ee63"),
    ("GPL-3.0-only", "gnu general", "5d527914d4539f34149cd198edb1e5de52322047d37781b3bd66403f12dc40e1"),
    ("LGPL-2.0-only", "gnu library", "2f0a8618627c179dd830ddb8fa74635ae037468a5880f3b46a73915ae1990c24"),
    ("LGPL-2.0-only", "gnu library", "d449b5d838ee652333de62d88304ddcf67663cda782f1c7257ee9c9dae33dfb4"),
    ("LGPL-2.1-only", "gnu lesser", "56d21d93f6012cbd7f1195b72528da245ccf843598ff833a87101eb36863f95b"),
    ("LGPL-2.1-only", "gnu lesser", "a7bd7bcc6f59de5c915482fc3cacdd5a1b6b27c24354df724c2ef3672dce9475"),
    ("LGPL-3.0-only", "gnu lesser", "f0cae4b317f4f263dca8e79625f8d9c7618c87e0ca6665c79b0f1c12ac856938"),
    ("MPL-1.1", "mozilla public", "37c464d014e7991cce21efad605e9a1549cdb4a1f6536357a7290d78a40ee996"),
    ("MPL-2.0", "mozilla public", "7eb42cd7f8edde0699d303a531b8d604a4370bd579346f5e1d615398ffe83791"),
]
