"""Notices that name licence families, and texts that only sound alike."""

from __future__ import annotations

# Licence families, the names they go by, and sentences of their public notices.
FAMILIES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "apache-2.0": (
        ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache Software License 2.0"),
        ("you may not use this file except in compliance with the License",
         "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
         "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS "
         "OF ANY KIND, either express or implied")),
    "mit": (
        ("MIT License", "The MIT License", "MIT license (Expat)"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
         "associated documentation files, to deal in the Software without restriction",
         "The above copyright notice and this permission notice shall be included in all copies or substantial "
         "portions of the Software",
         "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED")),
    "gpl": (
        ("GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL", "GPL-3.0",
         "GPL-2.0-or-later", "GPLv3"),
        ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
         "the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
         "You should have received a copy of the GNU General Public License along with this program")),
    "lgpl": (
        ("GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "LGPL-2.1", "LGPLv3"),
        ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
         "You should have received a copy of the GNU Lesser General Public License along with this library")),
    "agpl": (
        ("GNU Affero General Public License", "GNU Affero General Public License, version 3", "AGPL-3.0"),
        ("under the terms of the GNU Affero General Public License as published by the Free Software Foundation",)),
    "bsd": (
        ("BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "Modified BSD License"),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided "
         "that the following conditions are met",
         "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
         "following disclaimer",
         "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
         "promote products derived from this software")),
    "mpl-2.0": (
        ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
         "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/")),
    "isc": (
        ("ISC License", "The ISC License"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
         "hereby granted",)),
    "cc-by": (
        ("Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC-BY-4.0", "Creative Commons "
         "Attribution License"), ()),
    "cc-by-sa": (
        ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC-BY-SA-3.0"), ()),
    "cc-by-nc": (
        ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC-BY-NC-4.0"), ()),
    "cc0": (
        ("CC0 1.0 Universal", "CC0 1.0 Public Domain Dedication", "the public domain"),
        ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
         "this work",)),
    "proprietary": (
        ("a proprietary license",),
        ("All rights reserved.", "All rights reserved. No part of this publication may be reproduced or distributed "
         "without the prior written permission of the publisher",
         "This document is proprietary and confidential. Unauthorized copying of this file is strictly prohibited")),
}

# How notices name a licence.
PHRASES = ("Licensed under {}", "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.",
           "This work is licensed under a {}", "distributed under the terms of the {}", "This project is available "
           "under the {}", "SPDX-License-Identifier: {}", "License: {}", "{}")

# SPDX identifiers of the families, which stand behind a tag in headers of files.
IDENTIFIERS: dict[str, tuple[str, ...]] = {
    "apache-2.0": ("Apache-2.0",),
    "mit": ("MIT",),
    "gpl": ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"),
    "lgpl": ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "agpl": ("AGPL-3.0-only", "AGPL-3.0-or-later"),
    "bsd": ("BSD-2-Clause", "BSD-3-Clause"),
    "mpl-2.0": ("MPL-2.0",),
    "isc": ("ISC",),
    "cc-by": ("CC-BY-4.0",),
    "cc-by-sa": ("CC-BY-SA-4.0",),
    "cc-by-nc": ("CC-BY-NC-4.0",),
    "cc0": ("CC0-1.0",),
}
TAGS = ("SPDX-License-Identifier: {}", "License: {}")

# Sentences that share words with notices and are none.
OTHERS = (
    "His driving license was suspended after the second version of the test.",
    "The general public was invited to a free concert in the park.",
    "Without permission from the city no file may be copied to the archive.",
    "The software is provided to all students and the license fee is paid by the school.",
    "The committee reserved the right to change the conditions of any kind of contract.",
    "She moved from Boston, where she studied at MIT, to work on a new software project.",
    "The Apache helicopter was under repair and version 2 of the report was published.",
    "All tables are reserved for the members, and the source of the water is public.",
    "They were granted permission to use the hall for any purpose.",
    "He bought a fishing license under his own name at the office.",
    "Creative people share work in common rooms and the public domain name was sold.",
    "The distribution of the binary was released under the old name.",
)
