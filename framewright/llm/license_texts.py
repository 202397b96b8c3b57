"""Licence texts and notices, by SPDX identifier."""

from __future__ import annotations

_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_PERMISSION = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""

_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""

#: Whole texts, without their copyright lines (which canonical form drops).
TEXTS = {
    "MIT": f"""MIT License

{_PERMISSION}, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

{_DISCLAIMER}
""",
    "MIT-0": f"""MIT No Attribution

{_PERMISSION}.

{_DISCLAIMER}
""",
    "ISC": """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
""",
    "0BSD": """BSD Zero Clause License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
""",
    "BSD-2-Clause": f"""BSD 2-Clause License

{_BSD_START}
{_BSD_END}
""",
    "BSD-3-Clause": f"""BSD 3-Clause License

{_BSD_START}
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

{_BSD_END}
""",
    "Zlib": """zlib License

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>
""",
}

#: Titles that stand above the short texts, or do not.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT"),
    "MIT-0": ("MIT No Attribution", "MIT No Attribution License"),
    "ISC": ("ISC License", "The ISC License", "ISC"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License"),
    "Zlib": ("zlib License", "The zlib License"),
}

#: SHA-256 of the canonical forms of long texts: whole, and without the notes on how to apply them (with and without their
#: closing line) or exhibits.
DIGESTS = {
    "Apache-2.0": ("865f7b0d882ecbae362b1823e2ae250667dfad39760ffda9bada2c579ea3326f", "8939bdea1012cb2fb4c44118ce93c0495f9695101a6e32a54d1a8a3bc471f634", "3f6f869d7111126e6b192e03bb947a4e558fd6e32f36a1f5fae83c7f76d34c10"),
    "Artistic-1.0-Perl": ("e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2",),
    "BSD-3-Clause": ("21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651",),
    "CC0-1.0": ("cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",),
    "GFDL-1.2-only": ("94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60", "84f3c9e8cdded0036378e7e6eb92ac6570731434d2fc46027f259264dc16501e"),
    "GFDL-1.3-only": ("a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826", "ccfa2750c2a3b9dae93f959cfa64078cc3a306c4a4cd4cfaf18365396202da90"),
    "GPL-1.0-only": ("8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    "GPL-2.0-only": ("efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    "GPL-3.0-only": ("eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    "LGPL-2.0-only": ("61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    "LGPL-2.1-only": ("4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    "LGPL-3.0-only": ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",),
    "MPL-1.1": ("f7acdbee0d4664d81de2d7cd8ed816ec6b9a21e93ce84fb85ed3b6ec5ce41094", "7e25725c58c43d1f05d7ddc92051f296ea6d3ef663c97f31d028a3b9be950ae8"),
    "MPL-2.0": ("cdb5877b9b73b693216820ac5a0090510c6fd9df7c38876e551b865cce774ddd", "d8e0fea7a5627bdd20cb5d4a7545da7eb4b0af5a452cc31a0c8d117f11008f29"),
}

#: Names of licences, as notices write them.
NAMES = {
    "0BSD": ("Zero-Clause BSD License",),
    "AGPL-3.0-only": ("GNU Affero General Public License, version 3", "GNU AGPL version 3", "AGPLv3"),
    "AGPL-3.0-or-later": ("GNU Affero General Public License, version 3 or later", "GNU Affero General Public License, version 3 or any later version"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache License v2.0"),
    "Artistic-2.0": ("Artistic License 2.0",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License"),
    "BSL-1.0": ("Boost Software License 1.0", "Boost Software License, Version 1.0"),
    "CC-BY-3.0": ("Creative Commons Attribution 3.0 License", "CC BY 3.0"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"),
    "CC-BY-NC-ND-4.0": ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC BY-NC-ND 4.0"),
    "CC-BY-NC-SA-4.0": ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC BY-NC-SA 4.0"),
    "CC-BY-ND-4.0": ("Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0"),
    "CC-BY-SA-3.0": ("Creative Commons Attribution-ShareAlike 3.0 License", "CC BY-SA 3.0"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0"),
    "EPL-1.0": ("Eclipse Public License 1.0", "Eclipse Public License, Version 1.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, Version 2.0"),
    "EUPL-1.2": ("European Union Public Licence 1.2", "EUPL 1.2"),
    "GFDL-1.3-only": ("GNU Free Documentation License, version 1.3",),
    "GPL-2.0-only": ("GNU General Public License, version 2", "GNU GPL version 2", "GPLv2"),
    "GPL-2.0-or-later": ("GNU General Public License, version 2 or later", "GNU General Public License, version 2 or any later version"),
    "GPL-3.0-only": ("GNU General Public License, version 3", "GNU GPL version 3", "GPLv3"),
    "GPL-3.0-or-later": ("GNU General Public License, version 3 or later", "GNU General Public License, version 3 or any later version"),
    "ISC": ("ISC License",),
    "LGPL-2.1-only": ("GNU Lesser General Public License, version 2.1", "LGPLv2.1"),
    "LGPL-2.1-or-later": ("GNU Lesser General Public License, version 2.1 or later", "GNU Lesser General Public License, version 2.1 or any later version"),
    "LGPL-3.0-only": ("GNU Lesser General Public License, version 3", "LGPLv3"),
    "LGPL-3.0-or-later": ("GNU Lesser General Public License, version 3 or later", "GNU Lesser General Public License, version 3 or any later version"),
    "MIT": ("MIT License", "MIT"),
    "MIT-0": ("MIT No Attribution License",),
    "MPL-1.1": ("Mozilla Public License 1.1", "Mozilla Public License, Version 1.1"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0"),
    "MS-PL": ("Microsoft Public License",),
    "ODbL-1.0": ("Open Database License 1.0", "Open Database License (ODbL) v1.0"),
    "OFL-1.1": ("SIL Open Font License 1.1", "SIL Open Font License, Version 1.1"),
    "PSF-2.0": ("Python Software Foundation License Version 2",),
    "Unlicense": ("Unlicense",),
    "WTFPL": ("WTFPL",),
    "Zlib": ("zlib License",),
}

#: What stands before a name in a notice; each also with "the", and by the identifier instead of a name.
OPENINGS = (
    "Licensed under",
    "Released under",
    "Distributed under",
    "Available under",
    "License:",
    "This work is licensed under",
    "This project is licensed under",
    "This software is licensed under",
    "This program is licensed under",
    "This file is licensed under",
    "This code is licensed under",
)


def known_texts() -> dict[str, list[str]]:
    """The short texts, under each title that they go by and without one."""
    out = {}
    for name, text in TEXTS.items():
        body = text.partition("\n\n")[2] if name in TITLES else text
        out[name] = [f"{title}\n\n{body}" for title in TITLES.get(name, ())] + [body]
    return out


def known_notices() -> dict[str, list[str]]:
    """Every opening with every name and identifier, and the identifier lines."""
    out = {}
    for name, titles in NAMES.items():
        said = [f"{opening} {the}{title}" for opening in OPENINGS for the in ("", "the ") for title in (*titles, name)]
        out[name] = [f"SPDX-License-Identifier: {name}", *said]
    return out
