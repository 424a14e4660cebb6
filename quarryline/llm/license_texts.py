"""What licence families are called and how their notices read."""

#: Names that a one-line notice may use.
NAMES: dict[str, list[str]] = {
    "mit": ["MIT License", "MIT license terms", "the MIT License", "the MIT/X11 License", "MIT", "the Expat License"],
    "apache-2.0": ["Apache License, Version 2.0", "the Apache License, Version 2.0", "the Apache 2.0 license", "Apache-2.0", "Apache License 2.0", "the Apache Software License 2.0"],
    "gpl": ["GNU General Public License, version 3", "the GNU General Public License", "the GNU General Public License version 2", "GPL-3.0", "GPLv3", "GPLv2 or later", "the GNU GPL"],
    "lgpl": ["GNU Lesser General Public License, version 3", "the GNU Lesser General Public License", "LGPL-2.1", "LGPLv3", "the GNU LGPL"],
    "agpl": ["GNU Affero General Public License, version 3", "the GNU Affero General Public License", "AGPL-3.0", "AGPLv3", "the GNU AGPL"],
    "bsd": ["BSD License", "the 3-Clause BSD License", "the 2-Clause BSD License", "BSD-3-Clause", "BSD-2-Clause", "the New BSD License", "a BSD-style license"],
    "mpl-2.0": ["Mozilla Public License, Version 2.0", "the Mozilla Public License", "MPL-2.0", "the MPL 2.0"],
    "isc": ["ISC License", "the ISC License", "ISC"],
    "unlicense": ["The Unlicense", "the Unlicense", "Unlicense"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC BY-NC-SA 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0", "a Creative Commons Attribution-NonCommercial license"],
    "cc-by": ["CC BY 4.0", "the Creative Commons Attribution 4.0 International License", "CC-BY-4.0", "CC BY 3.0", "a Creative Commons Attribution license"],
    "cc-by-sa": ["CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0", "CC BY-SA 3.0", "a Creative Commons Attribution-ShareAlike license"],
    "cc0": ["CC0 1.0", "CC0", "the CC0 1.0 Universal Public Domain Dedication", "CC0-1.0"],
}

#: Sentences around a name; {} is the name.
FRAMES = [
    "Licensed under {}.", "Released under {}.", "Released under the {}.", "This work is licensed under {}.", "This work is licensed under the {}.",
    "This software is licensed under {}.", "This project is distributed under the terms of {}.", "Available under {}, see LICENSE for details.",
    "This file is subject to the terms of {}.", "The code is made available under {}.", "SPDX-License-Identifier: {}", "License: {}", "Content on this site is licensed under {}.",
    "{}", "[{}]", "**License:** {}", "Licence: {}", "license = \"{}\"", "This repository uses the {}.", "See the {} for the full text.", "Distributed under {}; see the LICENSE file.",
]

#: Well-known paragraphs of the families' texts.
PARAGRAPHS: dict[str, list[str]] = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}

#: Paragraphs that use the same words and license nothing.
UNKNOWN = [
    "The license of the driver was checked at the border.", "A fishing license costs ten dollars a year and is valid until spring.", "She asked for permission to use the software on her laptop.",
    "The general public was not allowed into the building.", "Apache helicopters flew over the field at noon.", "He studied at MIT before he moved to the west coast.",
    "All rights reserved.", "Copyright 2019 the authors.", "Please read the terms of service before you sign up.", "The commons of the village were open to all creative people.",
    "The new version of the program was released under great pressure.", "Attribution of the painting to the master is uncertain.", "This work was supported by a public grant of the foundation.",
    "The software is distributed on two disks and comes with a manual.", "Mozilla announced a new browser for the public last week.", "The terms of the contract were made available to the public.",
    "Released under the old name, the song became a hit.", "The restaurant holds a license to sell beer and wine.", "Version 2.0 of the protocol was published in March.", "Content on this site may change without notice.",
    "You can obtain a copy of the report at the front desk.", "The public domain of the king reached to the sea.", "GNU is an animal that lives in the south of Africa.", "The file is subject to change.", "See LICENSE for details.",
    "International patents are handled by another office.", "This project is distributed over four towns.", "The warranty does not cover damage by water.", "Use of this machine without permission is forbidden.", "Any person obtaining a ticket may enter.",
]
