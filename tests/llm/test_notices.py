"""License notices as they are written, and lines that are none."""

from tidelane.llm.licenses import scan

NOTICES = {
    "MIT": ["MIT License", "The MIT License (MIT)", "Licensed under the MIT license.", "Licensed under MIT License", "This project is licensed under the MIT License - see the LICENSE file for details.", "SPDX-License-Identifier: MIT", "// SPDX-License-Identifier: MIT", "# Distributed under the MIT License.", "Code is released under the MIT license.", "This library is available under the MIT License"],
    "Apache-2.0": ["Licensed under the Apache License 2.0", "Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");", "SPDX-License-Identifier: Apache-2.0", "/* SPDX-License-Identifier: Apache-2.0 */", "Released under the Apache 2.0 license.", "Apache License 2.0", "It is distributed under the Apache License v2.0", "All code is made available under the Apache-2.0 license."],
    "BSD-3-Clause": ["SPDX-License-Identifier: BSD-3-Clause", "Licensed under the BSD 3-Clause License.", "Released under the 3-Clause BSD License", "Use is governed by terms under the New BSD License", "BSD 3-Clause License"],
    "BSD-2-Clause": ["SPDX-License-Identifier: BSD-2-Clause", "Licensed under the Simplified BSD License", "BSD 2-Clause License"],
    "GPL-2.0": ["SPDX-License-Identifier: GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0+", "Licensed under GPLv2", "Released under the GNU GPL v2.", "Licensed under the GNU General Public License v2.0", "Distributed under the GNU General Public License version 2.0"],
    "GPL-3.0": ["SPDX-License-Identifier: GPL-3.0-or-later", "Released under GPLv3.", "Licensed under the GNU General Public License v3", "It is free software under the GNU GPLv3", "This work is licensed under the GNU General Public License, version 3."],
    "LGPL-2.1": ["SPDX-License-Identifier: LGPL-2.1-only", "Licensed under the GNU Lesser General Public License v2.1", "Available under LGPLv2.1"],
    "LGPL-3.0": ["SPDX-License-Identifier: LGPL-3.0", "Distributed under the GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["SPDX-License-Identifier: AGPL-3.0-only", "Licensed under the AGPLv3.", "Licensed under the GNU Affero General Public License v3.0"],
    "MPL-2.0": ["SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License 2.0", "Released under the MPL 2.0", "Mozilla Public License 2.0"],
    "ISC": ["SPDX-License-Identifier: ISC", "Licensed under the ISC License.", "ISC License"],
    "CC-BY-SA-4.0": ["Licensed under CC-BY-SA-4.0.", "Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-3.0": ["Text is available under a Creative Commons Attribution 3.0 Unported License.", "Photos under CC BY 3.0", "Licensed under the Creative Commons Attribution 3.0 License"],
    "CC-BY-NC-4.0": ["LICENSED UNDER CC BY-NC 4.0", "Shared under CC BY-NC 4.0"],
    "CC0-1.0": ["Released under CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0", "Licensed under CC0 1.0."],
    "EPL-2.0": ["SPDX-License-Identifier: EPL-2.0", "Made available under the Eclipse Public License 2.0"],
    "Unlicense": ["SPDX-License-Identifier: Unlicense", "Released under the Unlicense"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "Zlib": ["Licensed under the zlib License", "SPDX-License-Identifier: Zlib"],
    "All-Rights-Reserved": ["Copyright 2021 Example Inc. All rights reserved.", "ALL RIGHTS RESERVED"],
}
OTHERS = [
    "He lost his driving license in Apache county.", "A license to kill", "The license of this work isn't known.", "Licensed under the terms of the contract", "It is not released under the MIT License.", "We license software to others", "public domain",
    "She studied at MIT under professor Smith", "under the sea", "a permission is needed to enter", "under the new general license", "GPL", "the copyright of the photos", "SPDX-License-Identifier: Proprietary-1.0", "Creative commons are places where people meet under a tree",
]


def test_notices_are_named():
    asked = [(name, line) for name, lines in NOTICES.items() for line in lines]
    text = "\n\n".join(line for _, line in asked)
    alone = [{x[1] for x in scan(line)} for _, line in asked]
    assert sum(name in found for (name, _), found in zip(asked, alone)) >= 0.95 * len(asked)
    assert all(found <= {name} for (name, _), found in zip(asked, alone))
    together = {(x[0], x[1]) for x in scan(text)}
    assert sum((2 * k, name) in together for k, (name, _) in enumerate(asked)) >= 0.95 * len(asked)


def test_other_lines_are_not():
    assert [(line, x[1]) for line in OTHERS for x in scan(line)] == []
