"""Licences in headers, notices and tags as files have them, in each form of comment."""

import pytest

from shrinkwise.llm.licenses import SLOT_WORDS, known_sentences, scan, scan_licenses

GPL_HOPE = "This {} is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the\nGNU General Public License for more details."
BSD = (
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice,\n   this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n"
)
HEADERS = {
    "BSD-2-Clause": BSD + "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS",
    "BSD-3-Clause": BSD + "3. Neither the name of Foo Inc. nor the names of its contributors may be\n   used to endorse or promote products derived from this software without\n   specific prior written permission.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without"
        " limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\n"
        "The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software."
    ),
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n\n"
    + GPL_HOPE.format("library"),
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\n"
    + GPL_HOPE.format("program"),
    "GPL-2.0": "Frobnicate is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation.\n\n" + GPL_HOPE.format("driver"),
    "GPL-3.0-or-later": "Frobnicate is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "Zlib": "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial"
    " applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.\n   (See accompanying file LICENSE_1_0.txt or copy at\n         https://www.boost.org/LICENSE_1_0.txt)",
    "Apache-2.0": (
        "Licensed to the Apache Software Foundation (ASF) under one\nor more contributor license agreements.  See the NOTICE file\ndistributed with this work for additional information\nregarding copyright ownership.  The ASF licenses this file\n"
        "to you under the Apache License, Version 2.0 (the\n\"License\"); you may not use this file except in compliance\nwith the License.  You may obtain a copy of the License at\n\n  http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "EPL-2.0": "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/",
}
COMMENTS = ["", "# ", "// ", " * ", "-- ", ";; ", "! ", "% ", "dnl ", "REM "]


def found_in(text):
    findings, left = scan(text, known_sentences())
    return [f.license for f in findings], left


@pytest.mark.parametrize("comment", COMMENTS)
@pytest.mark.parametrize("license_id", HEADERS)
def test_headers_in_each_form_of_comment(license_id, comment):
    header = f"Copyright (c) 2020 Some One\n\n{HEADERS[license_id]}"
    text = "\n".join(f"{comment}{line}".rstrip() for line in header.splitlines())
    assert found_in(f"{text}\n") == ([license_id], 0)


@pytest.mark.parametrize("holder", ["Foo Inc.", "J. R. Doe, Ltd.", "the copyright holder", "The Regents of the University of Some Place"])
def test_any_holder_stands_in_a_slot(holder):
    for names in ("the names of its contributors", "the names of any contributors"):
        clause = f"Neither the name of {holder} nor {names} may be used to endorse or promote products derived from this software without specific prior written permission."
        assert found_in(f"{BSD}3. {clause}") == (["BSD-3-Clause"], 0)
    long = " ".join(["name"] * (SLOT_WORDS + 1))
    assert found_in(BSD + clause.replace(holder, long)) == (["BSD-2-Clause"], 0)


def test_clauses_on_advertising_and_of_authors():
    last = "4. The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission."
    ads = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software.\n"
    assert found_in(BSD + last) == (["BSD-3-Clause"], 0) and found_in(BSD + ads + last) == (["BSD-4-Clause"], 0)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("This project is licensed under the MIT License - see the LICENSE file for details.", ["MIT"]),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
        ("It is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 3.0 Unported License", ["CC-BY-NC-ND-3.0"]),
        ("The use is governed by an MIT license.", ["MIT"]),
        ("Use is governed by a BSD-style license that can be found in the LICENSE file.", ["BSD-3-Clause"]),
        ("License: MIT", ["MIT"]),
        ("name: x\nversion: 1\nlicense: Apache-2.0\nauthor: y", ["Apache-2.0"]),
        ('{"name": "x",\n "license": "ISC",\n "main": "y"}', ["ISC"]),
        ('[package]\nname = "x"\nlicense = "MIT OR Apache-2.0"\n', ["MIT", "Apache-2.0"]),
        ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", ["Apache-2.0", "MIT"]),
        ("The code is licensed under the MIT License and the texts are licensed under CC BY 4.0.", ["MIT", "CC-BY-4.0"]),
        ("Released under the GPL v2 or any later version.", ["GPL-2.0-or-later"]),
        ("SPDX-License-Identifier: MIT OR Apache-2.0", ["MIT", "Apache-2.0"]),
        ("// SPDX-License-Identifier: (GPL-2.0-only OR BSD-2-Clause)\n#include <x.h>", ["GPL-2.0", "BSD-2-Clause"]),
        ("/* SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 AND LGPL-2.1+ */", ["GPL-2.0-or-later", "LGPL-2.1-or-later"]),
        ("<!-- SPDX-License-Identifier: CC0-1.0 -->", ["CC0-1.0"]),
        ("# SPDX-License-Identifier: MIT\n# SPDX-License-Identifier: Apache-2.0\n", ["MIT", "Apache-2.0"]),
        ("GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007", ["GPL-3.0"]),
        ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n", ["Apache-2.0"]),
        ("The grant is provided under MIT supervision and covered by GPL lawyers.", []),
        ("License holders are asked to renew. The license: a story.", []),
        ("Released under pressure, published by a zlib fan, licensed under terms unknown.", []),
    ],
)
def test_notices_and_tags(text, expected):
    assert found_in(text) == (expected, 0)


def test_tags_of_unknown_licences_are_open():
    assert found_in("SPDX-License-Identifier: LicenseRef-Own\n") == ([], 1)


def test_rows_of_files(spark):
    rows = [("a", HEADERS["MIT"]), ("a", HEADERS["MIT"]), ("b", None), (None, "License: MIT"), ("c", ""), ("d", "Neither the name of " * 20_000)]
    found = scan_licenses(spark.createDataFrame(rows, "rel_path string, text string")).collect()
    assert sorted((r.rel_path or "", r.licenses) for r in found) == [("", ["MIT"]), ("a", ["MIT"]), ("a", ["MIT"]), ("b", []), ("c", []), ("d", [])]
    assert scan_licenses(spark.createDataFrame([], "rel_path string, text string")).collect() == []
