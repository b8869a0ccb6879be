"""Templates of public licenses: (label, wording with markup, whether it is a whole text).

Fixed values: the wordings are those that the licenses' stewards publish, the markup marks what may be left out or
replaced. A label may hold regions by name, as {version}.
"""

from __future__ import annotations

_LEFT_OUT = lambda text: f"<<beginOptional>>{text}<<endOptional>>"

_WITHOUT_WARRANTY = """
THIS SOFTWARE IS PROVIDED BY <<var;name=provider;words=1-12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
<<var;name=liable;words=1-12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_TWO_CLAUSES = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: <<beginOptional>>1<<endOptional>> Redistributions of source code must retain the above copyright notice, this list
of conditions and the following disclaimer. <<beginOptional>>2<<endOptional>> Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
with the distribution.
"""

TEMPLATES = [
    ("MIT", """
<<beginOptional>><<beginOptional>>The<<endOptional>> MIT License <<beginOptional>>(MIT)<<endOptional>><<var;name=holder;words=0-40>><<endOptional>>
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all
copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name=liable;words=1-12>> BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
""", True),
    ("ISC", """
Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name=author;words=1-12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name=liable;words=1-12>> BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
""", True),
    ("BSD-2-Clause", _TWO_CLAUSES + _WITHOUT_WARRANTY, True),
    ("BSD-3-Clause", _TWO_CLAUSES + """
<<beginOptional>>3<<endOptional>> Neither the name of <<var;name=owner;words=1-12>> nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission.
""" + _WITHOUT_WARRANTY, True),
    ("Zlib", """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:
<<beginOptional>>1<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required. <<beginOptional>>2<<endOptional>> Altered source versions must be plainly marked as such, and must not be misrepresented as being
the original software. <<beginOptional>>3<<endOptional>> This notice may not be removed or altered from any source distribution.
""", True),
    ("Apache-2.0", """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at <<var;name=scheme;match=https?>>://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License.
""", True),
    ("GPL-{version}-or-later", """
This <<var;name=kind;words=1-3>> is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it
under the terms of the GNU General Public License as published by the Free Software Foundation, either version
<<var;name=version;match=[0-9]+>> of the License, or (at your option) any later version.
""", True),
    ("Apache-{version}", f"""
{_LEFT_OUT("Released")} {_LEFT_OUT("Licensed")} under the {_LEFT_OUT("terms of the")} Apache License {_LEFT_OUT("Version")} <<var;name=version;match=[0-9]+;words=1-2>>
""", False),
    ("GPL-{version}", f"""
{_LEFT_OUT("Released")} {_LEFT_OUT("Licensed")} under the {_LEFT_OUT("terms of the")} GNU General Public License {_LEFT_OUT("Version")} <<var;name=version;match=[0-9]+;words=1-2>>
""", False),
    ("LGPL-{version}", f"""
{_LEFT_OUT("Released")} {_LEFT_OUT("Licensed")} under the {_LEFT_OUT("terms of the")} GNU Lesser General Public License {_LEFT_OUT("Version")} <<var;name=version;match=[0-9]+;words=1-2>>
""", False),
    ("AGPL-{version}", f"""
{_LEFT_OUT("Released")} {_LEFT_OUT("Licensed")} under the {_LEFT_OUT("terms of the")} GNU Affero General Public License {_LEFT_OUT("Version")} <<var;name=version;match=[0-9]+;words=1-2>>
""", False),
    ("MIT-notice", f"""
{_LEFT_OUT("Released")} {_LEFT_OUT("Licensed")} {_LEFT_OUT("Distributed")} under the {_LEFT_OUT("terms of the")} MIT License
""", False),
    ("CC-BY-{terms}-{version}", f"""
Licensed under {_LEFT_OUT("a")} {_LEFT_OUT("the")} CC BY <<var;name=terms;match=nc|sa|nd;words=0-2>> <<var;name=version;match=[0-9];words=0-2>>
""", False),
    ("SPDX-{id}", "SPDX License Identifier <<var;name=id;words=1-1>>", False),
]
