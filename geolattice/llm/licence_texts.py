"""Public licence texts that operator 2 knows: the short ones as they are, the long ones by the digests of their canonical forms."""

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""

_ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
"""

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.

In jurisdictions that recognize copyright laws, the author or authors
of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit
of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this
software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.
"""


def _titled(licence: str, body: str, *titles: str) -> list[tuple[str, str]]:
    return [(licence, f"{t}\n\n{body}" if t else body) for t in ("", *titles)]


#: Licence and its text, as it is found with and without a title.
TEXTS: list[tuple[str, str]] = [
    *_titled("MIT", _MIT, "MIT License", "The MIT License", "The MIT License (MIT)"),
    *_titled("ISC", _ISC, "ISC License", "The ISC License"),
    *_titled("ISC", _ISC.replace("and/or distribute", "and distribute"), "ISC License", "The ISC License"),
    *_titled("0BSD", _ISC.replace(", provided that the above\ncopyright notice and this permission notice appear in all copies", ""), "BSD Zero Clause License", "Zero-Clause BSD"),
    *_titled("Zlib", _ZLIB, "zlib License", "The zlib/libpng License"),
    *_titled("Unlicense", _UNLICENSE, "The Unlicense"),
    *_titled("Unlicense", _UNLICENSE + "\nFor more information, please refer to <https://unlicense.org/>\n", "The Unlicense"),
]
for _rights in ("", "All rights reserved.\n\n"):
    TEXTS += _titled("BSD-2-Clause", _rights + _BSD_HEAD + _BSD_TAIL, "BSD 2-Clause License", "The BSD 2-Clause License")
    TEXTS += _titled("BSD-3-Clause", _rights + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL, "BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License")

#: Licence and the digest of its whole text's canonical form; tests reckon them again where the texts are at hand.
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "4225605d4c3647ef2075217a0d52c9ca"),
    ("Apache-2.0", "2f973fce6821968caa77d834b80cee7c"),
    ("Apache-2.0", "a90697331248535821cbca3716b02146"),
    ("Artistic-1.0-Perl", "a8b0fb0c6e43a3b36bdc159e59dbfd1e"),
    ("CC0-1.0", "93a180096f6cfcf2c0dd24f75c2eec48"),
    ("GFDL-1.2", "7a0a547ecac612b526676be523eacf80"),
    ("GFDL-1.3", "3a13e6bba8a8c2836d5cc9b501cd619e"),
    ("GPL-1.0", "738cc3b112640d95d4cd79a58967ecea"),
    ("GPL-1.0", "dbf3c47f5a8f127e58d08cabc1ebb916"),
    ("GPL-1.0", "21fa8693acc5194a648fe02e11f65a72"),
    ("GPL-2.0", "5e39ace6e62f5a7fe9c17b4da986ad8c"),
    ("GPL-2.0", "68380dbeadb093b94ecf563db7312db7"),
    ("GPL-2.0", "f2c06efe640b4a281cbe5337cdde80ab"),
    ("GPL-3.0", "8c6822e47417eea0c9f81cf5f2447393"),
    ("GPL-3.0", "c6e3371f21808ec12136735f091080c0"),
    ("GPL-3.0", "7953c2a35c921fbf3e8a6c8e784329c4"),
    ("LGPL-2.0", "74cf7fcef3b29a39165a795b2cad3a3a"),
    ("LGPL-2.0", "c396ba2f94537628797123bc12cd2d6e"),
    ("LGPL-2.0", "97832943be1e344d51af5aee1b658e4f"),
    ("LGPL-2.1", "f998bc436710cfece156aaa84fd26dd4"),
    ("LGPL-2.1", "3054b3781b1af43f906dc753acad15ee"),
    ("LGPL-2.1", "eaf6afb73fc860a002bfbccbe6f07ce7"),
    ("LGPL-3.0", "993aef82f34a705d491848394cf21cd6"),
    ("MPL-1.1", "9fa8ae3e869a929215034d82982372b5"),
    ("MPL-2.0", "beff5c91fc0720a8ca80fd87a03bd54a"),
]
