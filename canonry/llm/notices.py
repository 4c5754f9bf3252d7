"""License notices that the scan looks for: headers, texts and short grants.

Each row has its own id, so several wordings of one license are told apart. Notices that differ in a
version or a family name alone are cut so short around it that the other one's text stays under the
containment: at most 8 words with a version at an end (all shingles are needed), about 20 with it inside.
Long licenses are known by their opening passage. All notices have five words or more.
"""

from __future__ import annotations

#: Headers and texts.
TEXTS = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
     "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
     "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
     'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
     "the specific language governing permissions and limitations under the License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
     "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
     "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
     "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
     "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("ISC-text", "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
     "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
     "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
     "products derived from this software without specific prior written permission."),
    ("BSD-4-Clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
     "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for "
     "any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
     "restrictions"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
     "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, "
     "and transmit the Software, and to prepare derivative works of the Software"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
     "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
     "purpose, commercial or non-commercial, and by any means."),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing "
     "it is allowed as long as the name is changed."),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
     "v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-2.0", "made available under the terms of the Eclipse Public License 2.0 which is available at "
     "https://www.eclipse.org/legal/epl-2.0"),
    ("EPL-2.0-text", "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\"). ANY "
     "USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to "
     "this software to the public domain worldwide. This software is distributed without any warranty."),
    ("CC0-1.0-waived", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ('BSD',
     'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the'
     ' following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this '
     'list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above '
     'copyright notice, this list of conditions and the following disclaimer in the documentation and/or other '
     "materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS "
     'AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY '
     'AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR'
     ' ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, '
     'PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER '
     'CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR '
     'OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH '
     'DAMAGE.'),
    ('Apache-2.0-text',
     'Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, '
     'REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, '
     'reproduction, and distribution as defined by Sections 1 through 9 of this document. "Licensor" shall mean the '
     'copyright owner or entity authorized by the copyright owner that is granting the License. "Legal Entity" shall '
     'mean the union of the acting entity and all other entities that control, are controlled by, or are under common '
     'control with that entity. For the purposes of this definition, "control" means (i) the power, direct or '
     'indirect, to cause the direction or management of such entity, whether by contract or otherwise, or (ii) '
     'ownership of fifty percent (50%) or more of the outstanding shares, or (iii) beneficial ownership of'),
    ('GPL-2.0-text',
     'GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 '
     'Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim '
     'copies of this license document, but changing it is not allowed. Preamble The licenses for most software are '
     'designed to take away your freedom to share and change it. By contrast, the GNU General Public License is '
     'intended to guarantee your freedom to share and change free software--to make sure the software is free for all '
     "its users. This General Public License applies to most of the Free Software Foundation's software and to any "
     'other program whose authors commit to using it. (Some other Free Software Foundation software is covered by the '
     'GNU Lesser General Public License'),
    ('GPL-3.0-text',
     'GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. '
     '<https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but '
     'changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for software and'
     ' other kinds of works. The licenses for most software and other practical works are designed to take away your '
     'freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your'
     ' freedom to share and change all versions of a program--to make sure it remains free software for all its users.'
     ' We, the Free Software Foundation, use the GNU General Public License for most of our software; it applies also '
     'to any other'),
    ('LGPL-2.1-text',
     'GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, '
     'Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute '
     'verbatim copies of this license document, but changing it is not allowed. [This is the first released version of'
     ' the Lesser GPL. It also counts as the successor of the GNU Library Public License, version 2, hence the version'
     ' number 2.1.] Preamble The licenses for most software are designed to take away your freedom to share and change'
     ' it. By contrast, the GNU General Public Licenses are intended to guarantee your freedom to share and change '
     'free software--to make sure the software is free for all its users. This license, the Lesser General Public '
     'License, applies to'),
    ('LGPL-3.0-text',
     'GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. '
     '<https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but '
     'changing it is not allowed. This version of the GNU Lesser General Public License incorporates the terms and '
     'conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed '
     'below. 0. Additional Definitions. As used herein, "this License" refers to version 3 of the GNU Lesser General '
     'Public License, and the "GNU GPL" refers to version 3 of the GNU General Public License. "The Library" refers to'
     ' a covered work governed by this License, other than an Application or a Combined Work as defined below. An '
     '"Application" is any work that makes use'),
    ('MPL-2.0-text',
     'Mozilla Public License Version 2.0 ================================== 1. Definitions -------------- 1.1. '
     '"Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns '
     'Covered Software. 1.2. "Contributor Version" means the combination of the Contributions of others (if any) used '
     'by a Contributor and that particular Contributor\'s Contribution. 1.3. "Contribution" means Covered Software of a'
     ' particular Contributor. 1.4. "Covered Software" means Source Code Form to which the initial Contributor has '
     'attached the notice in Exhibit A, the Executable Form of such Source Code Form, and Modifications of such Source'
     ' Code Form, in each case including portions thereof. 1.5. "Incompatible With Secondary Licenses" means (a) that '
     'the initial Contributor has attached the notice described in Exhibit B to the Covered Software; or (b) that the '
     'Covered Software was made'),
    ('CC0-1.0-text',
     'Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT '
     'PROVIDE LEGAL SERVICES. DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE AN ATTORNEY-CLIENT RELATIONSHIP. CREATIVE '
     'COMMONS PROVIDES THIS INFORMATION ON AN "AS-IS" BASIS. CREATIVE COMMONS MAKES NO WARRANTIES REGARDING THE USE OF'
     ' THIS DOCUMENT OR THE INFORMATION OR WORKS PROVIDED HEREUNDER, AND DISCLAIMS LIABILITY FOR DAMAGES RESULTING '
     'FROM THE USE OF THIS DOCUMENT OR THE INFORMATION OR WORKS PROVIDED HEREUNDER. Statement of Purpose The laws of '
     'most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined '
     'below) upon the creator and subsequent owner(s) (each and all, an "owner") of an original work of authorship '
     'and/or a database (each, a "Work"). Certain owners wish to permanently relinquish those rights to a'),
    ('Artistic-1.0-text',
     'The "Artistic License" Preamble The intent of this document is to state the conditions under which a Package may'
     ' be copied, such that the Copyright Holder maintains some semblance of artistic control over the development of '
     'the package, while giving the users of the package the right to use and distribute the Package in a more-or-less'
     ' customary fashion, plus the right to make reasonable modifications. Definitions: "Package" refers to the '
     'collection of files distributed by the Copyright Holder, and derivatives of that collection of files created '
     'through textual modification. "Standard Version" refers to such a Package if it has not been modified, or has '
     'been modified in accordance with the wishes of the Copyright Holder as specified below. "Copyright Holder" is '
     'whoever is named in the copyright or copyrights for'),
    ('GFDL-1.3-text',
     'GNU Free Documentation License Version 1.3, 3 November 2008 Copyright (C) 2000, 2001, 2002, 2007, 2008 Free '
     'Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of '
     'this license document, but changing it is not allowed. 0. PREAMBLE The purpose of this License is to make a '
     'manual, textbook, or other functional and useful document "free" in the sense of freedom: to assure everyone the'
     ' effective freedom to copy and redistribute it, with or without modifying it, either commercially or '
     'noncommercially. Secondarily, this License preserves for the author and publisher a way to get credit for their '
     'work, while not being considered responsible for modifications made by others. This License is a kind of '
     '"copyleft", which means that derivative works of the document must themselves be'),
)

_LATER = "under the terms of the {} as published by the Free Software Foundation, either version {} of the License, or"
_ONLY = "under the terms of the {} as published by the Free Software Foundation, version {} of the License"
_NAMED = "under the terms of the {} version {} as published by the Free Software Foundation"
_GNU = (("GPL-2.0", "GNU General Public License", "2"), ("GPL-3.0", "GNU General Public License", "3"),
        ("LGPL-2.0", "GNU Library General Public License", "2"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1"),
        ("LGPL-3.0", "GNU Lesser General Public License", "3"), ("AGPL-3.0", "GNU Affero General Public License", "3"))

#: Names of licenses in grants.
_NAMES = {
    "MIT": ("the MIT License", "an MIT license", "the MIT/X11 License"),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License", "Apache License 2.0", "Apache-2.0"),
    "BSD": ("the BSD License", "a BSD-style license", "the terms of the BSD license"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License", "the Modified BSD License",
                     "BSD-3-Clause"),
    "ISC": ("the ISC License",), "Zlib": ("the zlib License", "the zlib/libpng License"), "Unlicense": ("the Unlicense license",),
    "BSL-1.0": ("the Boost Software License, Version 1.0", "the Boost Software License 1.0"),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "the MPL 2.0", "MPL-2.0"),
    "EPL-1.0": ("the Eclipse Public License 1.0", "the Eclipse Public License v1.0", "EPL-1.0"),
    "EPL-2.0": ("the Eclipse Public License 2.0", "the Eclipse Public License v2.0", "the Eclipse Public License, version 2.0", "EPL-2.0"),
    "CDDL-1.0": ("the Common Development and Distribution License",),
    "Artistic-2.0": ("the Artistic License 2.0",), "WTFPL": ("the WTFPL license",), "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0"),
    "GFDL-1.3": ("the GNU Free Documentation License, Version 1.3", "the GNU Free Documentation License 1.3"),
    "OFL-1.1": ("the SIL Open Font License, Version 1.1", "the SIL Open Font License 1.1"),
}
for _id, _name, _version in _GNU:
    _short = _id.split("-")[0]
    _version = {"LGPL-2.0": "2.0"}.get(_id, _version)  # "v2" begins "v2.1"
    _NAMES[_id] = (f"the {_name}, version {_version}", f"the {_name} v{_version}", f"the {_name} {_version}",
                   f"the {_short}v{_version} license", f"the {_short} v{_version}", f"{_short} version {_version}", _id)
for _id, _name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"),
                   ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
                   ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
    for _version, _place in (("4.0", "International"), ("3.0", "Unported")):
        _NAMES[f"CC-{_id}-{_version}"] = (
            f"CC {_id} {_version}", f"the CC {_id} {_version} license", f"a Creative Commons {_name} {_version} {_place} License",
            f"the Creative Commons {_name} {_version} {_place} License", f"the Creative Commons {_name} {_version} License",
            f"Creative Commons {_name} {_version}")

_VERBS = ("Licensed", "Released", "Distributed", "Available", "Published", "Provided")


def _words(text: str) -> int:
    return len("".join(c if c.isalnum() else " " for c in text).split())


def _grants() -> list[tuple[str, str]]:
    rows = []
    for license_id, names in _NAMES.items():
        texts = []
        for name in names:
            own = f"under {name}"
            if _words(own) < 5:
                texts += [f"{verb} {own}" for verb in _VERBS]
            else:
                # At most 8 words where the version is at the end.
                texts.append(own if _words(own) <= 8 or not name[-1].isdigit() else name)
            # Without "under the terms", which all of them would share.
            texts.append(f"of {name}" if _words(f"of {name}") >= 5 else f"terms of {name}")
            if _words(texts[-1]) > 8 and name[-1].isdigit():
                texts[-1] = name
            if _words(texts[-1]) < 5:
                texts[-1] = f"the {texts[-1]}"
            if _words("SPDX License Identifier " + license_id) >= 5:
                texts.append(f"SPDX-License-Identifier: {license_id}")
        rows += [(f"{license_id}-short" + (f"-{i}" if i else ""), text) for i, text in enumerate(dict.fromkeys(texts))]
    return rows


#: (license_id, text) of every notice.
NOTICES = (
    *TEXTS,
    *((f"{i}-or-later", _LATER.format(name, version)) for i, name, version in _GNU),
    *((f"{i}-only", _ONLY.format(name, version)) for i, name, version in _GNU),
    *((f"{i}-named", _NAMED.format(name, version)) for i, name, version in _GNU),
    *_grants(),
)
