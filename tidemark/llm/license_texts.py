"""Licence notices and opening passages of licence texts in public use, by SPDX identifier.

Of whole licence texts, title lines and granting passages are held, not every section.
"""

from __future__ import annotations

_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_CLAUSES = ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES'

TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MIT", _MIT),
    ("MIT", _MIT + ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice"),
    ("MIT-0", _MIT + ', and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED "AS IS"'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES'),
    ("BSD-2-Clause OR BSD-3-Clause", _BSD),
    ("BSD-2-Clause", _BSD + _CLAUSES + _BSD_END),
    ("BSD-3-Clause", _BSD + _CLAUSES + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission." + _BSD_END),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software'),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("LGPL-2.0-or-later", "GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
]

_NAMES = {"MIT": ["MIT"], "ISC": ["ISC"], "BSD-2-Clause": ["BSD 2-Clause", "2-Clause BSD"], "BSD-3-Clause": ["BSD 3-Clause", "3-Clause BSD"], "Zlib": ["zlib"], "BSL-1.0": ["Boost Software"]}
TEMPLATES += [(spdx, f"{verb} under the {name} License") for spdx, names in _NAMES.items() for name in names for verb in ("Released", "Licensed", "Distributed")]
TEMPLATES += [(spdx, f"{verb} under the {name}") for spdx, name in [("MPL-2.0", "Mozilla Public License 2.0"), ("MPL-2.0", "Mozilla Public License, version 2.0"), ("EPL-1.0", "Eclipse Public License 1.0"), ("EPL-2.0", "Eclipse Public License 2.0"), ("Apache-2.0", "Apache License 2.0")] for verb in ("Released", "Licensed", "Distributed")]

#: Identifier, name, and per version its words in a notice and the date in the title line.
_GNU = [("GPL", "General", {"2.0": ("2", "June 1991"), "3.0": ("3", "29 June 2007")}), ("LGPL", "Lesser General", {"2.1": ("2.1", "February 1999"), "3.0": ("3", "29 June 2007")}), ("AGPL", "Affero General", {"3.0": ("3", "19 November 2007")})]
for _id, _name, _versions in _GNU:
    for _version, (_v, _date) in _versions.items():
        _spdx, _license = f"{_id}-{_version}", f"GNU {_name} Public License"
        _free = f"is free software: you can redistribute it and/or modify it under the terms of the {_license}"
        TEMPLATES += [
            (_spdx, f"This work is licensed under the {_license}, version {_v}"),
            (_spdx, f"{_license} Version {_v}, {_date}"),
            (f"{_spdx}-or-later", f"This work is licensed under the {_license}, version {_v} or later"),
            (f"{_spdx}-or-later", f"This work is licensed under the {_license}, version {_v} or (at your option) any later version"),
            (f"{_spdx}-or-later", f"{_free} as published by the Free Software Foundation, either version {_v} of the License, or (at your option) any later version."),
            (f"{_spdx}-only", f"{_free} version {_v} as published by the Free Software Foundation."),
            (f"{_spdx}-only", f"{_free} as published by the Free Software Foundation; version {_v} of the License."),
            (f"{_spdx}-only", f"{_free} as published by the Free Software Foundation, version {_v}."),
        ]

_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _kind, _name in _CC.items():
    for _version, _scope in {"4.0": "International", "3.0": "Unported", "2.5": "Generic", "2.0": "Generic"}.items():
        TEMPLATES += [(f"CC-{_kind}-{_version}", f"Licensed under CC {_kind} {_version}"), (f"CC-{_kind}-{_version}", f"This work is licensed under a Creative Commons {_name} {_version} {_scope} License")]
