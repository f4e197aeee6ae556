"""Recall of the license scan on wordings that are no template, and its precision on prose that uses the same words."""

import pytest
from pyspark.sql import functions as F

from terrascope.llm import licenses

FREE = ("{} is free software{} you can redistribute it and/or modify\nit under the terms of the GNU {} as published by\nthe Free "
        "Software Foundation{} either version {} of the License, or\n(at your option) any later version.")
SAID = [
    ("MIT", "MIT License\n\nCopyright (c) 2021 Jane Roe"),
    ("MIT", "The MIT License (MIT)\nCopyright (c) 2014 Some Company"),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "The code is available under the MIT License, see LICENSE for details."),
    ("MIT", "// SPDX-License-Identifier: MIT"),
    ("MIT", "All sources here are distributed under the permissive MIT license unless stated otherwise."),
    ("Apache-2.0", "This project is licensed under the Apache 2.0 license."),
    ("Apache-2.0", "licensed under the Apache License 2.0"),
    ("Apache-2.0", "Apache License\nVersion 2.0, January 2004"),
    ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Released under Apache 2.0 by the maintainers of the project."),
    ("GPL-3.0", FREE.format("Foo", ":", "General Public License", ",", 3)),
    ("GPL-3.0", "This script is released under the GPLv3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0"),
    ("GPL-2.0", FREE.format("This program", ";", "General Public License", ";", 2)),
    ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-only */"),
    ("GPL-2.0", "Distributed under the GPL, version 2 or later."),
    ("LGPL-2.1", FREE.format("This library", ";", "Lesser General Public\nLicense", ";", "2.1")),
    ("LGPL-2.0", FREE.format("This collection", ";", "Library General\nPublic License", ";", 2)),
    ("GPL-3.0", "The whole tool is distributed under the GNU GPL version 3 or any later version."),
    ("LGPL-3.0", FREE.format("The parser", ":", "Lesser General Public License", ",", 3)),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("AGPL-3.0", FREE.format("This server", ":", "Affero General Public License", ",", 3)),
    ("AGPL-3.0", "This service is licensed under the AGPLv3 license."),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was "
                "not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "The library is released under the Mozilla Public License, version 2.0."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that "
                     "the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, "
                     "this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce "
                     "the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n"
                     "   and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE AUTHOR "
                     '"AS IS" AND ANY EXPRESS OR IMPLIED\nWARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
                     "MERCHANTABILITY\nAND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("BSD-2-Clause", "Licensed under the simplified BSD license."),
    ("BSD-3-Clause", "* SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "This package is distributed under the 3-clause BSD license."),
    ("ISC", "This module is released under the ISC license."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt or copy at "
                "http://www.boost.org/LICENSE_1_0.txt)"),
    ("EPL-2.0", "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\n"
                "which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("Zlib", "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the author be held liable "
             "for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any "
             "purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following "
             "restrictions:"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "The data set is released under CC0 1.0, with no rights reserved."),
    ("CC-BY-4.0", "Text is available under the Creative Commons Attribution 4.0 licence."),
    ("CC-BY-SA-4.0", "Content on this site is licensed under a Creative Commons Attribution-ShareAlike 4.0 International license."),
    ("CC-BY-NC-SA-4.0", "The lectures are licensed under CC BY-NC-SA 4.0"),
    ("CC-BY-NC-ND-4.0", "This article is distributed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 "
                        "International License"),
]
PROSE = [
    "She lost her driving license in March and walked to MIT every day.",
    "Harvard licensed the patent under a deal that MIT refused.",
    "The council granted a license for the market; version 3 of the plan was distributed under the doors.",
    "Copyright 2020 by the town. All rights reserved.",
    "The warranty on the engine is limited to two years, and permission to travel was granted.",
    "A fishing licence costs 4.0 pounds and is available under the counter.",
    "He compared the wording of public licenses in his thesis on software and creative commons.",
    "The Apache language was taught under a license from the state in 2004.",
    "Her novels are in the public domain now, and the boost to sales was large.",
    "Redistribution of income is permitted provided that the following government agrees.",
    "The eclipse was public, and 2 licenses for telescopes were sold.",
    "Licensed under the BSD License, version 9.",
    "Licensed under the MIT No Attribution License.",
    "Licensed under CC BY-SA 3.0.",
    "MIT License talks failed in the end, said the company.",
    "The general public was free to modify the license plates.",
]


@pytest.fixture(scope="module")
def found(spark):
    texts = [t for _, t in SAID] + PROSE + [f"Before it, prose.\n\n{t}\n\nAfter it, more prose." for _, t in SAID]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = licenses.scan_licenses(df).orderBy("doc_id").select(licenses.license_names().alias("names")).collect()
    return [r["names"] for r in rows]


def test_recall_on_other_wordings(found):
    for got in (found[:len(SAID)], found[len(SAID) + len(PROSE):]):
        missed = [(name, text, names) for (name, text), names in zip(SAID, got) if name not in names]
        assert 1 - len(missed) / len(SAID) >= 0.9, missed
        assert [(name, text, names) for (name, text), names in zip(SAID, got) if set(names) - {name}] == []


def test_precision_on_prose(found):
    got = found[len(SAID):len(SAID) + len(PROSE)]
    assert [(text, names) for text, names in zip(PROSE, got) if names] == []


def test_every_template_names_its_license(spark):
    said = [(name, text) for name, texts in licenses.all_templates().items() for text in texts]
    df = spark.createDataFrame(said, "name string, text string")
    rows = licenses.scan_licenses(df).withColumn("names", licenses.license_names())
    assert rows.filter(F.size("names") != 1).select("name", "text", "names").collect() == []
    assert rows.filter(~F.array_contains("names", F.col("name"))).select("name", "text", "names").collect() == []


def test_own_templates_and_result_names(spark):
    df = spark.createDataFrame([("Copyright under our own rules 7.", "old")], "text string, licenses string")
    got = licenses.scan_licenses(df, templates={"own": ("Copyright under our own rules 7",)}).head()
    assert [f.license for f in got["licenses"].found] == ["own"]
