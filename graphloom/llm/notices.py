"""What the licence classifier learns from: names, phrasings and passages of common licence families, and sentences that
speak of licences and rights without being a notice."""

from __future__ import annotations

#: How the families are called.
NAMES = {
    "MIT": ["MIT License", "MIT licence", "MIT", "Expat License", "MIT/X11 license", "The MIT License (MIT)", "MIT-style license", "MIT X11"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache-2.0", "Apache Software License", "Apache licence v2", "Apache 2 license", "ASL 2.0"],
    "GPL": ["GNU General Public License, version 3", "GNU General Public License version 2 or later", "GNU GPL", "GPLv3", "GPLv2", "GPL-3.0", "GPL-2.0-or-later", "GPL license", "General Public License", "GPL v3+", "GPL", "GNU General Public License", "GPL version 3", "GNU GPL version 2"],
    "LGPL": ["GNU Lesser General Public License, version 3", "GNU LGPL", "LGPLv3", "LGPL-2.1", "LGPL", "Lesser General Public License", "GNU Library General Public License", "LGPL-3.0-or-later", "LGPL version 2.1"],
    "AGPL": ["GNU Affero General Public License, version 3", "GNU AGPL", "AGPLv3", "AGPL-3.0", "AGPL", "Affero General Public License", "AGPL-3.0-only", "GNU AGPL version 3"],
    "BSD": ["BSD 3-Clause License", "BSD license", "BSD-3-Clause", "BSD-2-Clause", "two-clause BSD license", "New BSD License", "Simplified BSD licence", "BSD", "modified BSD license", "3-clause BSD license"],
    "MPL": ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL-2.0", "MPL 2.0", "MPL", "Mozilla Public Licence version 1.1"],
    "CC-BY": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution licence", "CC BY 3.0", "CC-BY", "Creative Commons Attribution"],
    "CC-BY-SA": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution Share Alike licence", "CC BY-SA 3.0", "CC-BY-SA", "Creative Commons Attribution-ShareAlike"],
    "CC-BY-NC": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution Non-Commercial licence", "CC BY-NC 3.0", "CC-BY-NC", "Creative Commons Attribution-NonCommercial"],
    "CC0": ["CC0 1.0 Universal", "CC0", "CC0-1.0", "Creative Commons Zero", "CC0 1.0 public domain dedication", "Creative Commons CC0 licence", "CC Zero"],
}
#: How a name is put into a sentence.
PHRASINGS = [
    "Licensed under the {}.", "Released under the {}.", "This project is licensed under the {}.", "This work is licensed under a {}.", "{}", "License: {}", "Licence {}", "SPDX-License-Identifier: {}",
    "Distributed under the terms of the {}.", "This code is {} licensed.", "Available under {}.", "The source code is covered by the {}.", "Published under the {}; see the file LICENSE.", "You may use it under the {}.", "{} applies.", "Copyright 2017 Roe and others, {}.", "Everything in here is {}.", "The text and its pictures are {}, unless stated otherwise.", "These files are made available under {} terms.", "Lizenziert unter {}.", "Sous licence {}.", "Bajo la licencia {}.", "{} (see COPYING)",
]
#: Longer passages of the licences and of notices.
PASSAGES = {
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "Apache-2.0": ["you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0", "Licensed to the Apache Software Foundation under one or more contributor license agreements", "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, see the Apache License"],
    "GPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "it under the terms of the GNU General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU General Public License along with this program."],
    "LGPL": ["under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU Lesser General Public License along with this library."],
    "AGPL": ["under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU Affero General Public License along with this program."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Use of this source code is governed by a BSD-style license"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org/MPL/2.0/"],
    "CC-BY": ["To view a copy of this license, visit creativecommons.org/licenses/by/4.0/", "You are free to share and adapt the material for any purpose, with attribution (CC BY)."],
    "CC-BY-SA": ["To view a copy of this license, visit creativecommons.org/licenses/by-sa/4.0/", "Share it under the same terms, with attribution: Creative Commons ShareAlike (CC BY-SA)."],
    "CC-BY-NC": ["To view a copy of this license, visit creativecommons.org/licenses/by-nc/4.0/", "Free for non-commercial use with attribution: Creative Commons NonCommercial (CC BY-NC)."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Dedicated to the public domain under CC0, creativecommons.org/publicdomain/zero/1.0/"],
    "proprietary": [
        "All rights reserved.", "Copyright 2020 Example Company. All rights reserved.", "© 2019 Example Ltd. All rights reserved worldwide.", "(c) Roe Publishing, all rights reserved", "No part of this publication may be reproduced or transmitted in any form without permission of the publisher.", "Copyright (c) 2015 Example GmbH, all rights reserved.",
        "Unauthorised copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.", "This document is confidential and proprietary to Example Inc.", "Reproduction without written permission of the copyright holder is prohibited.", "Copyright Example, 2021. All Rights Reserved. Do not distribute.", "Not to be copied or reproduced without permission.", "Tous droits réservés.", "Alle Rechte vorbehalten.", "Todos los derechos reservados.",
    ],
}
#: Licences of no family above; like the made-up ones of ``other_names`` they teach that a notice's phrasing is not
#: enough.
OTHER_LICENCES = ["Boost Software License", "Eclipse Public License 2.0", "Common Development and Distribution License", "SIL Open Font License 1.1", "PostgreSQL License", "Python Software Foundation License", "Microsoft Public License", "NCSA Open Source License", "Academic Free License 3.0", "Open Database License", "CeCILL licence", "EPL-2.0", "CDDL-1.0", "BSL-1.0", "OFL-1.1", "Ms-PL"]
#: Licences and sentences that nothing is trained on; the floor on a family's probability is set by them.
CALIBRATE_NAMES = ["Q Public License", "Sleepycat License", "Zope Public License 2.1", "Vim License", "Ruby License", "IBM Public License", "LaTeX Project Public License", "Open Software License 3.0", "Unicode License", "curl license", "Blue Oak Model License", "LPPL-1.3c", "OSL-3.0", "ZPL"]
CALIBRATE_LINES = [
    "The general public was not admitted.", "Our Apache server answers on port 80.", "BSD sockets are described in chapter four.", "They met at MIT under the dome.", "He lost his licence after the accident.", "The public library lends creative toys.", "Mozilla moved to a new office.",
    "Her common sense is reserved for holidays.", "Zero copies were left at the door.", "A GNU is an antelope of the plains.", "Lesser known artists were licensed to sell at the market.", "The copyright office opens at nine.", "Attribution of the painting is in doubt.", "MIT won the game by two points.",
    "Two clauses of the treaty were struck out.", "Share alike, said the teacher, and they did.", "All rights of way are closed in winter.", "The software was sold to the public in 1999.", "The kernel of the nut was bitter.", "The licence plate was missing.",
]
#: Words of which one must stand beside a name of one or two words for the name to count.
BESIDE = ["licence", "license", "licensed", "licenced", "licences", "licenses", "licensing", "copyright", "spdx", "terms", "subject", "under", "released", "distributed", "published", "publish", "covered", "covers", "governed", "governs", "offered", "available", "redistribute", "source", "code", "software", "files", "file", "repository", "library", "clause", "only", "later", "port"]
FAMILIES = list(PASSAGES)
#: What the classifier's answer is compared with: names and the heart of the passages.
TEMPLATES = {f: NAMES.get(f, []) + PASSAGES[f] for f in FAMILIES} | {"proprietary": ["all rights reserved", "proprietary and confidential", "may be reproduced without permission", "copying prohibited", "reproduction prohibited without permission", "reproduced without permission", "tous droits réservés", "alle rechte vorbehalten", "todos los derechos reservados"]}
BEFORE = ["", "Copyright (c) 2019 Jane Roe.", "(c) 2021 The Authors -", "Note:", "/*", "Files in this folder:", "© 2018 Example Ltd.", "#", "Data and code:", "By the team, 2020."]
AFTER = ["", "See the LICENSE file for details.", "Thanks to all contributors.", "*/", "Read more on our site.", "Version 1.2", "-->", "Contributions welcome."]
#: Sentences of the kind that is no notice, and what they speak of.
SPEAKS_OF = ["a driving license", "the license of the pub", "her fishing licence", "the copyright of old songs", "a licence fee", "public rights", "the general public", "free software", "an Apache helicopter", "the MIT campus", "Mozilla and other browsers", "the public domain", "attribution in science", "commercial use of land", "permission to build", "the rights of all children", "a reserved table", "the source of the river", "software versions", "creative work in common rooms", "warranty conditions", "version 2.0 of the plan"]
MENTIONS = ["{} is needed to rent a car.", "They talked about {} for an hour.", "{} was renewed by the council.", "We read a book on {} and its history.", "She asked whether {} would matter.", "Nobody knew what {} meant to the village.", "The report on {} is due in May.", "In 2019 {} changed little.", "mit der Frage nach {} begann der Abend", "sur la question de {} il ne dit rien"]
PLAIN = ["Note:", "Files in this folder:", "Thanks to all contributors.", "Read more on our site.", "Version 1.2", "Contributions welcome.", "By the team, 2020.", "Copyright law is taught on Mondays.", "All seats are reserved until noon.", "You may copy the recipe by hand.", "mit", "mit freundlichen Grüßen", "version 2.0", "public", "general", "commons", "license", "by the sea", "all", "reserved", "Mozilla", "Apache", "creative"]


def examples():
    """(family, notice) of every family: each name in each phrasing, each passage in varied surroundings."""
    k = 0
    for family in FAMILIES:
        for name in NAMES.get(family, []):
            for phrasing in PHRASINGS:
                notice = phrasing.format(name)
                yield family, notice
                yield family, f"{BEFORE[k % len(BEFORE)]} {notice} {AFTER[k // 3 % len(AFTER)]}".strip()
                k += 1
        for passage in PASSAGES[family]:
            for before in BEFORE:
                for after in AFTER:
                    yield family, f"{before} {passage} {after}".strip()


def other_names():
    """Names of licences of no family: some that there are, and some put together."""
    yield from OTHER_LICENCES
    for i, first in enumerate(["Acme", "Orion", "Delta", "Harbour", "Quartz", "Maple", "Zenith", "Willow"]):
        for k, kind in enumerate(["Public", "Open Source", "Community", "Software", "General", "Free", "Attribution", "Lesser"]):
            yield f"{first} {kind} {('License', 'Licence')[(i + k) % 2]}{('', ' 2.0', ', version 1', ' v3')[(i * 3 + k) % 4]}"


def others():
    """Notices of licences of no family."""
    for k, name in enumerate(other_names()):
        for j, phrasing in enumerate(PHRASINGS):
            if (j + k) % 3 == 0:
                yield phrasing.format(name)


def calibration():
    """Paragraphs that no family should take, none of which is trained on."""
    yield from CALIBRATE_LINES
    for name in CALIBRATE_NAMES:
        for phrasing in PHRASINGS:
            yield phrasing.format(name)


def mentions():
    yield from PLAIN
    for sentence in MENTIONS:
        for what in SPEAKS_OF:
            yield sentence.format(what)
