"""Licence scan: a trained paragraph classifier whose predictions are confirmed against templates.

Paragraphs are the lines of a text and, where lines are wrapped or stand in comments, the sentences that several of
them make; long ones are read in overlapping windows of words. Their word 1- to 3-grams that occur in the names and
notices of licences (those of stop words alone left out) are the sparse features of a multinomial logistic
regression over the licence families and an unknown class. It is trained here: names in frames, perturbed notices,
names of licences that are none of the families, look-alike sentences, and paragraphs from a bounded sample of the
documents (``SAMPLE_DOCS`` texts, ``SAMPLE_CHARS`` characters of each from a place that its hash picks) that name no
licence. Its temperature is fitted on frames, cuts of notices and whole licences that training never sees, so that
the unknown class's probability holds for licences it doesn't know; ``LicenceModel.report`` has the figures.

A prediction is confirmed where the paragraph holds enough of a template of the family and the words that tell the
family and its version from the others (``MARKS``). Without these words it stays unconfirmed; families whose
templates hold as much of the paragraph are named in ``others``: a fragment that several licences share is ambiguous.
A paragraph may name several families.

A paragraph without a feature has the unknown class by construction, so only the others are scored; whole texts
are scanned.

Defined results: a finding covers whole lines, ``paragraph`` is the number of the first, ``begin`` and ``end`` are
character offsets. Null and empty texts and unknown paragraphs give no rows; repeated rows repeat their findings; a
null id stays null; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.sources.io import read_table

UNKNOWN = "unknown"
SAMPLE_DOCS, SAMPLE_CHARS = 256, 4000
MIN_PROBABILITY, MIN_SIMILARITY = 0.5, 0.4
#: Words of one window, and from one to the next; a wrapped sentence is followed over that many lines.
WINDOW, STRIDE, WRAPPED = 64, 32, 40
_WORD = re.compile(r"[a-z0-9]+(?:[.\-'][a-z0-9]+)*")
_STOP = frozenset("a an and any are as at be by for from in is it its may not of on or that the this to under with you your use used all no other which without such shall will has have if only must can do".split())
_COMMENT = re.compile(r"\s*(?:/\*+|\*+/|\*+|//+!?|#+|--+|;+|%+|>+|<!--|-->|\"\"\"|rem\b)?\s*", re.I)
_ENDS = re.compile(r"[.!?]['\")\]]*\s*(?:\*/|-->)?\s*$")

#: Notices and key sentences of well-known licences.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache 2.0 license",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "apache-1.1": ("Licensed under the Apache Software License, Version 1.1.", "SPDX-License-Identifier: Apache-1.1"),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GPL v2",
        "Distributed under the GNU GPL version 2",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the LGPL, version 2.1",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Licensed under the AGPL version 3",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "mpl-1.1": ("The contents of this file are subject to the Mozilla Public License Version 1.1", "SPDX-License-Identifier: MPL-1.1"),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License, Version 1.0.", "SPDX-License-Identifier: EPL-2.0"),
    "eupl": ("Licensed under the EUPL, Version 1.2 or later.", "Licensed under the European Union Public Licence 1.2", "SPDX-License-Identifier: EUPL-1.2"),
    "boost": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "zlib": (
        "Released under the zlib License",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "SPDX-License-Identifier: Zlib",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-nd": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "cc-by-nc-sa": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "cc-by-nc-nd": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal",
        "Dedicated to the public domain under the CC0 dedication",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License",
    ),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Released under the Unlicense"),
    "ofl": ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", "SPDX-License-Identifier: OFL-1.1"),
}
#: What the families are called, with their versions.
NAMES: dict[str, tuple[str, ...]] = {
    "mit": ("MIT License", "MIT licence", "MIT-style license", "MIT/X11 license"),
    "apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache Software License 2.0", "Apache-2.0"),
    "apache-1.1": ("Apache License, Version 1.1", "Apache Software License 1.1", "Apache 1.1 license", "Apache-1.1"),
    "gpl": ("GNU General Public License", "GNU General Public License, version 2", "GNU General Public License v3.0", "GNU GPL", "GNU GPL v3", "GPL version 2", "GPLv3", "GPL-2.0-only"),
    "lgpl": ("GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU LGPL", "LGPL version 3", "LGPLv3", "LGPL-3.0-only"),
    "agpl": ("GNU Affero General Public License", "GNU Affero General Public License v3.0", "GNU AGPL", "AGPL version 3", "AGPLv3", "AGPL-3.0-or-later"),
    "bsd": ("BSD License", "BSD 2-Clause License", "3-clause BSD license", "BSD-style license", "New BSD License", "BSD-3-Clause"),
    "mpl-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0", "MPL 2.0", "MPL-2.0"),
    "mpl-1.1": ("Mozilla Public License 1.1", "Mozilla Public License, version 1.1", "MPL 1.1", "MPL-1.1"),
    "epl": ("Eclipse Public License 2.0", "Eclipse Public License, Version 2.0", "Eclipse Public License v1.0", "EPL 2.0", "EPL-2.0"),
    "eupl": ("European Union Public Licence 1.2", "European Union Public License, version 1.1", "EUPL", "EUPL 1.2", "EUPL, Version 1.2", "EUPL-1.2"),
    "boost": ("Boost Software License", "Boost Software License, Version 1.0", "Boost License 1.0", "BSL-1.0"),
    "zlib": ("zlib License", "zlib/libpng license", "zlib licence"),
    "cc-by": ("Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 3.0 License", "CC BY 4.0", "CC-BY-4.0", "CC BY 3.0"),
    "cc-by-sa": ("Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 3.0 License", "CC BY-SA 4.0", "CC-BY-SA-4.0", "CC BY-SA 3.0"),
    "cc-by-nc": ("Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 3.0 License", "CC BY-NC 4.0", "CC-BY-NC-4.0", "CC BY-NC 3.0"),
    "cc-by-nd": ("Creative Commons Attribution-NoDerivatives 4.0 International License", "Creative Commons Attribution-NoDerivatives 3.0 License", "CC BY-ND 4.0", "CC-BY-ND-4.0", "CC BY-ND 3.0"),
    "cc-by-nc-sa": ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "Creative Commons Attribution-NonCommercial-ShareAlike 3.0 License", "CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0", "CC BY-NC-SA 3.0"),
    "cc-by-nc-nd": ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "Creative Commons Attribution-NonCommercial-NoDerivatives 3.0 License", "CC BY-NC-ND 4.0", "CC-BY-NC-ND-4.0", "CC BY-NC-ND 3.0"),
    "cc0": ("CC0 1.0 Universal", "CC0 1.0", "CC0 public domain dedication", "Creative Commons Zero v1.0 Universal"),
    "isc": ("ISC License", "ISC licence"),
    "unlicense": ("Unlicense", "Unlicense license"),
    "ofl": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1", "Open Font License", "OFL-1.1"),
}
_LICENCE = "(?:licen[cs]e|licen[cs]ing)"
#: Per family, on words in lower case with one blank between: what tells it, and its version, from all others.
MARKS: dict[str, str] = {
    "mit": rf"mit {_LICENCE}|mit-style|mit x11|identifier mit|(?:to|obtaining) any person obtaining a copy of this|person obtaining a copy of this software|deal in the software without restriction|use copy modify merge publish",
    "apache-2.0": rf"apache(?: software)? {_LICENCE}(?: version| v\.?)? v?2(?:\.0)?(?![\d.])|apache 2(?:\.0)?(?![\d.])|apache-2\.0|apache\.org licenses license-2\.0",
    "apache-1.1": rf"apache(?: software)? {_LICENCE}(?: version| v\.?)? v?1\.1|apache 1\.1|apache-1\.1",
    "gpl": rf"gnu general public {_LICENCE}|(?<!lesser )(?<!affero )(?<!library )general public {_LICENCE}(?= v)|gnu gpl|(?<![\w-])gpl(?:v?[123])?(?![\w])|gpl-[123]\.0",
    "lgpl": rf"lesser general public {_LICENCE}|library general public {_LICENCE}|(?<![\w-])lgpl(?:v?[23])?(?![\w])|lgpl-[23]",
    "agpl": rf"affero general public {_LICENCE}|(?<![\w-])agpl(?:v?3)?(?![\w])|agpl-3",
    "bsd": rf"(?<![\w-])bsd(?:-style)?(?: [23]-clause)? {_LICENCE}|[23]-clause bsd|bsd [23]-clause|bsd-[23]-clause|bsd-style|redistribution and use in source and binary forms",
    "mpl-2.0": rf"mozilla public {_LICENCE}(?: version| v\.?)? v?2(?:\.0)?(?![\d.])|mpl v?2(?:\.0)?(?![\d.])|mpl-2\.0",
    "mpl-1.1": rf"mozilla public {_LICENCE}(?: version| v\.?)? v?1\.1|mpl v?1\.1|mpl-1\.1",
    "epl": rf"eclipse public {_LICENCE}|(?<![\w-])epl v?[12]\.0|epl-[12]\.0",
    "eupl": rf"european union public {_LICENCE}|(?<![\w-])eupl",
    "boost": rf"boost (?:software )?{_LICENCE}|bsl-1\.0|person or organization obtaining a copy of the software",
    "zlib": rf"zlib(?: libpng)? {_LICENCE}|identifier zlib|provided 'as-is' without any express or implied warranty|provided as-is without any express or implied warranty",
    "cc-by": rf"creative commons attribution (?:[1-4]\.\d|{_LICENCE}|international|unported)|(?<![\w-])cc[ -]by(?= [1-4]\.\d|-[1-4]\.\d)",
    "cc-by-sa": r"creative commons attribution[ -]share-?alike|(?<![\w-])cc[ -]by-sa",
    "cc-by-nc": r"creative commons attribution[ -]non-?commercial(?![ -](?:share|no-?deriv))|(?<![\w-])cc[ -]by-nc(?!-(?:sa|nd))",
    "cc-by-nd": r"creative commons attribution[ -]no-?deriv\w*|(?<![\w-])cc[ -]by-nd",
    "cc-by-nc-sa": r"creative commons attribution[ -]non-?commercial[ -]share-?alike|(?<![\w-])cc[ -]by-nc-sa",
    "cc-by-nc-nd": r"creative commons attribution[ -]non-?commercial[ -]no-?deriv\w*|(?<![\w-])cc[ -]by-nc-nd",
    "cc0": r"(?<![\w-])cc0|creative commons zero|waived all copyright and related",
    "isc": rf"(?<![\w-])isc {_LICENCE}|identifier isc|use copy modify and or distribute this software for any purpose",
    "unlicense": r"(?<![\w-])unlicense(?![\w])|free and unencumbered software released into the public domain",
    "ofl": rf"open font {_LICENCE}|ofl-1\.1",
}
#: Where a name may stand; every fourth one is kept from training.
FRAMES = (
    "Released under the {}.", "Licensed under the {}", "This project is licensed under the terms of the {}.", "This file is available under the {}", "{}", "Distributed under {}", "License: {}", "SPDX-License-Identifier: {}",
    "This work is licensed under a {}.", "Licensed under {}.", "The code may be used under the terms of the {}", "Published under the {} by its authors", "All files here are covered by the {}.", "This software is made available under {}", "See the {} for details.", "It is free software under the {}.",
    "Source code is subject to the {}", "Dual licensed under the {} or a commercial license", "You may use it under the {}, at your option", "Our documentation is shared under {}",
)
#: Licences that are none of the families: some teach the unknown class, the others only test it.
OTHERS = ("Microsoft Public License", "Common Development and Distribution License 1.0", "Open Software License 3.0", "PostgreSQL License", "Ruby License", "IBM Public License 1.0", "Educational Community License, Version 2.0", "Q Public License 1.0", "JSON License", "Commons Clause License", "PHP License, version 3.01", "W3C Software Notice and License", "Sun Public License, Version 1.0", "Netscape Public License 1.1", "Example Company Proprietary License", "Standard Commercial License", "End User License Agreement", "Site License Agreement, version 4", "Open Government Licence v3.0", "Nokia Open Source License 1.0", "Apache License, Version 3.0", "Mozilla Public License 3.0", "Artistic License 1.0", "University of Illinois License")
HELD_OTHERS = ("Academic Free License v3.0", "Server Side Public License, version 1", "CeCILL Free Software License 2.1", "Sleepycat License", "NASA Open Source Agreement 1.3", "Python Software Foundation License 2.0", "Artistic License 2.0", "Business Source License 1.1", "Open Database License v1.0", "Lucent Public License 1.02", "Reciprocal Public License 1.5", "Elastic License 2.0", "Vim License", "LaTeX Project Public License 1.3c")
#: Sentences with the words of licences that grant nothing.
_ALIKE = (
    "He drove without a license for three years.", "The driver's license must be renewed every five years.", "All rights reserved.", "The software was released in May and sold many copies.", "A general public meeting was held under the bridge.",
    "She published her work under the name of a foundation.", "Apache helicopters flew over the valley.", "The MIT campus lies on the river.", "Students from MIT released a new study.", "Creative people share common attributes.",
    "The law grants permission to any person to copy the document for private use.", "Version 2.0 of the program was published in the spring.", "The source of the river and its binary star names.", "Our terms of service apply to this website.", "Copyright 2020 by the author.",
    "The library is free and open to the public.", "Mozilla is a foundation.", "Free of charge delivery on all orders.", "International attribution of art works is hard.", "The license plate was found in the mud.",
)


def words_of(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def grams(words: list[str]) -> set[str]:
    """1- to 3-grams with a word that is no stop word."""
    found = {w for w in words if w not in _STOP}
    for n in (2, 3):
        for i in range(len(words) - n + 1):
            part = words[i : i + n]
            if any(w not in _STOP for w in part):
                found.add(" ".join(part))
    return found


def _runs(words: list[str]) -> set[tuple[str, ...]]:
    return set(zip(words, words[1:], words[2:], strict=False)) if len(words) > 2 else {tuple(words)} if words else set()


def _plain(words: list[str]) -> str:
    return f" {' '.join(words)} "


class LicenceModel:
    """Families, features and weights; ``scan`` is all a worker needs."""

    def __init__(self, negatives: list[str], templates: dict[str, tuple[str, ...]] = TEMPLATES, rounds: int = 120):
        self.families = [*sorted(templates), UNKNOWN]
        self.runs = {f: [_runs(words_of(t)) for t in (*templates[f], *NAMES.get(f, ()))] for f in sorted(templates)}
        self.marks = {f: re.compile(MARKS.get(f) or re.escape(" ".join(words_of(templates[f][0])))) for f in sorted(templates)}
        own = [g for f in templates for t in (*templates[f], *NAMES.get(f, ())) for g in grams(words_of(t))]
        vocab = sorted({*own, *(w for t in OTHERS for w in grams(words_of(t)) if " " not in w and w in set(own))})
        self.index = {g: i for i, g in enumerate(vocab)}
        self.anchors = frozenset(w for g in vocab for w in g.split() if w not in _STOP)
        train, held = self._examples(templates, negatives)
        x, y = self._matrix([t for t, _ in train]), np.array([self.families.index(f) for _, f in train])
        k = len(self.families)
        weights, bias = np.zeros((len(vocab), k), np.float32), np.zeros(k, np.float32)
        bias[-1] = 2.0
        target = np.eye(k, dtype=np.float32)[y]
        balance = (1 / np.sqrt(np.bincount(y, minlength=k)[y])).astype(np.float32)
        balance /= balance.sum()
        g_w, g_b = np.full_like(weights, 1e-6), np.full_like(bias, 1e-6)
        for _ in range(rounds):  # full-batch gradients with per-weight steps and a small ridge
            miss = (self._softmax(x @ weights + bias) - target) * balance[:, None]
            d_w, d_b = x.T @ miss + 1e-5 * weights, miss.sum(axis=0)
            g_w += d_w * d_w
            g_b += d_b * d_b
            weights -= 0.3 * d_w / np.sqrt(g_w)
            bias -= 0.3 * d_b / np.sqrt(g_b)
        self.weights, self.bias = weights, bias
        self.temperature, self.held_out_accuracy, self.report = 1.0, 1.0, {}
        self._calibrate(held)

    def _calibrate(self, held: list[tuple[str, str, str]]) -> None:
        """Temperature, accuracy, precision and recall on examples of frames, cuts and licences that training didn't see."""
        raw = self._matrix([t for t, _, _ in held]) @ self.weights + self.bias
        y = np.array([self.families.index(f) for _, f, _ in held])
        loss = {t: -np.log(np.maximum(self._softmax(raw / t)[np.arange(len(y)), y], 1e-9)).mean() for t in (0.5, 0.7, 1.0, 1.4, 2.0, 3.0)}
        self.temperature = min(loss, key=loss.get)
        p = self._softmax(raw / self.temperature)
        best, unknown = p.argmax(axis=1), len(self.families) - 1
        self.held_out_accuracy = float((best == y).mean())
        said = (best != unknown) & (p.max(axis=1) >= MIN_PROBABILITY)
        sure = np.array([any(f[6] and f[3] == self.families[b] for f in self.scan(t)) for (t, _, _), b in zip(held, best, strict=True)])
        share = lambda a, b: float(a.sum() / max(1, b.sum()))
        kinds = np.array([kind for _, _, kind in held])
        self.report = {
            "examples": len(held), "accuracy": self.held_out_accuracy, "temperature": self.temperature,
            "precision": share(said & (best == y), said), "recall": share(said & (best == y), y != unknown),
            "precision_confirmed": share(sure & (best == y), sure), "recall_confirmed": share(sure & (best == y), y != unknown),
            **{f"accuracy_{kind}": share((best == y) & (kinds == kind), kinds == kind) for kind in sorted(set(kinds.tolist()))},
            "unknown_confirmed": share(sure & (y == unknown), y == unknown),
        }

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def _matrix(self, texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.index)), np.float32)
        for i, t in enumerate(texts):
            x[i, [self.index[g] for g in grams(words_of(t)) if g in self.index]] = 1
        return x

    def _examples(self, templates: dict[str, tuple[str, ...]], negatives: list[str]) -> tuple[list[tuple[str, str]], list[tuple[str, str, str]]]:
        """(text, family) to train with, and (text, family, kind) that training doesn't see."""
        rng = random.Random(1)
        clean = [p for p in negatives if not any(m.search(_plain(words_of(p))) for m in self.marks.values())]
        filler = [w for p in clean for w in p.split()][:5000] or ["lorem"]
        some = lambda n: [rng.choice(filler) for _ in range(rng.randrange(n + 1))]
        cut = len(clean) * 4 // 5
        train = [(t, UNKNOWN) for t in clean[:cut]] + [(t, UNKNOWN) for t in _ALIKE] * 4
        held = [(t, UNKNOWN, "paragraph") for t in clean[cut:]]
        cased = lambda t: (t.upper, t.lower, t.__str__, t.__str__, t.__str__)[rng.randrange(5)]()

        def framed(names: tuple[str, ...], family: str, kind: str, teach: bool) -> None:
            for name in names:
                for i, frame in enumerate(FRAMES):
                    line = frame.format(name)
                    if i % 4 == 3 or not teach:
                        held.append((line, family, kind))
                    else:
                        train.append((line, family))
                        train.append((cased(" ".join([*some(8), line, *some(8)])), family))

        invented = tuple(f"{rng.choice(filler).title()} {kind} {rng.choice(('1.0', '1.1', '2.0', 'v3.0', '4.0'))}" for kind in ("Public License", "Software License, Version", "License", "Open License, version", "General License", "Attribution License", "License v.") for _ in range(4))
        framed((*OTHERS, *invented), UNKNOWN, "other_frame", True)
        framed(HELD_OTHERS, UNKNOWN, "other_licence", False)
        for family, texts in templates.items():
            framed(NAMES.get(family, ()), family, "frame", True)
            for t in texts:
                whole = t.split()
                for n in range(24):
                    words = whole
                    if n:
                        words = [w for w in words if rng.random() > 0.06] or words
                        words = some(6) * (n % 2) + words + some(6) * (n % 3 == 0)
                    if n % 5 == 4 and len(words) > 16:
                        at = rng.randrange(len(words) - 12)
                        words = words[at : at + 12]
                    train.append((cased(" ".join(words)) if n else t, family))
                for _ in range(4 if len(whole) > 12 else 0):  # a line more or less at either end, and words that are wrong
                    words = whole[rng.randrange(3) : len(whole) - rng.randrange(3)]
                    held.append((" ".join(rng.choice(filler) if rng.random() < 0.08 else w for w in words), family, "notice"))
        return train, held

    def similarity(self, words: list[str], family: str) -> tuple[float, int]:
        """Best share of a template's word triples that the paragraph holds, or of the paragraph's that a template of at least its length holds."""
        own, plain = _runs(words), _plain(words)
        best, which = 0.0, -1
        for i, runs in enumerate(self.runs[family]):
            if len(runs) == 1:  # a name of three words at most
                share = float(f" {' '.join(next(iter(runs)))} " in plain)
            else:
                both = len(own & runs)
                share = both / len(runs)
                if len(own) >= 4:
                    share = max(share, both / len(own))
            if share > best:
                best, which = share, i
        return best, which

    def classify(self, words: list[str]) -> tuple[str, float]:
        at = [self.index[g] for g in grams(words) if g in self.index]
        z = ((self.weights[at].sum(axis=0) + self.bias) / self.temperature)[None, :]
        p = self._softmax(z)[0]
        best = int(p.argmax())
        return self.families[best], float(p[best])

    def _judge(self, words: list[str]) -> dict[str, tuple[float, float, bool, str]]:
        """Family -> probability, similarity, whether it is confirmed, the families that as much speaks for."""
        found: dict[str, tuple[float, float, bool, str]] = {}
        for at in range(0, max(1, len(words) - WINDOW + STRIDE), STRIDE) if len(words) > WINDOW else (0,):
            part = words[at : at + WINDOW] if len(words) > WINDOW else words
            if self.anchors.isdisjoint(part):
                continue
            plain = _plain(part)
            marked = {f: m.search(plain) for f, m in self.marks.items()}
            marked = {f: m for f, m in marked.items() if m}
            family, p = self.classify(part)
            own = {family: (p, part)} if family != UNKNOWN and p >= MIN_PROBABILITY else {}
            if len(marked) > 1 or (marked and family not in marked):  # what stands around each name by itself
                spans = sorted((m.start(), m.end(), f) for f, m in marked.items())
                for i, (_, end, f) in enumerate(spans):
                    begin = max((e for _, e, _ in spans[:i]), default=0)
                    stop = min((s for s, _, _ in spans[i + 1 :] if s >= end), default=len(plain))
                    near = plain[begin:stop].split()
                    name, q = self.classify(near)
                    if name == f and q >= MIN_PROBABILITY and f not in own:
                        own[f] = (q, near)
            if marked and "mit" not in own and re.search(r" (?:or|and) mit | mit (?:or|and) ", plain):
                own["mit"] = (MIN_PROBABILITY, [*part, "mit", "license"])
                marked["mit"] = None
            for f, (q, near) in own.items():
                share, _ = self.similarity(near, f)
                others = "" if f in marked else ",".join(g for g in self.runs if g != f and share > 0 and self.similarity(near, g)[0] >= share)
                new = (q, share, f in marked and share >= MIN_SIMILARITY, others)
                if f not in found or (new[2], new[0]) > (found[f][2], found[f][0]):
                    found[f] = new
        return found

    def scan(self, text: str) -> Iterator[tuple[int, int, int, str, float, float, bool, str]]:
        """(paragraph, begin, end, family, probability, similarity, confirmed, others) of every paragraph that isn't unknown."""
        lines = text.split("\n")
        begins, at = [], 0
        for line in lines:
            begins.append(at)
            at += len(line) + 1
        single: dict[int, dict] = {}
        hits = []
        for n, line in enumerate(lines):
            words = words_of(line)
            if not self.anchors.isdisjoint(words):
                hits.append(n)
                found = self._judge(words)
                if found:
                    single[n] = found
        done = -1
        joined: list[tuple[int, int, dict]] = []
        for n in hits:
            if n <= done:
                continue
            first, last = self._sentence(lines, n)
            done = last
            if last > first:
                whole = self._judge(words_of("\n".join(_COMMENT.sub("", x, count=1) for x in lines[first : last + 1])))
                whole = {f: v for f, v in whole.items() if v[2]}
                parts = [single.get(k, {}) for k in range(first, last + 1)]
                sure = {f for own in parts for f, v in own.items() if v[2]}
                torn = any(not v[2] for own in parts for v in own.values())  # a line alone was taken for something that it doesn't prove
                more = {f: v for f, v in whole.items() if torn or f not in sure}
                if more:
                    for k in range(first, last + 1):
                        single[k] = {f: v for f, v in single.get(k, {}).items() if v[2] and f not in more}
                    inner = [k for k in hits if first <= k <= last]
                    joined.append((inner[0], inner[-1], more))
        rows = [(n, n, f, v) for n, found in single.items() for f, v in found.items()] + [(a, b, f, v) for a, b, found in joined for f, v in found.items()]
        for first, last, family, (p, share, sure, others) in sorted(rows, key=lambda r: r[:3]):
            yield first, begins[first], begins[last] + len(lines[last]), family, p, share, sure, others

    @staticmethod
    def _sentence(lines: list[str], n: int) -> tuple[int, int]:
        """The lines of the sentence that runs through line ``n``: wrapped lines end where a sentence, a comment or a paragraph does."""
        bare = lambda k: _COMMENT.sub("", lines[k], count=1).strip()
        first = last = n
        while first > 0 and n - first < WRAPPED and bare(first - 1) and not _ENDS.search(lines[first - 1]) and len(lines[first - 1]) < 160:
            first -= 1
        while last + 1 < len(lines) and last - n < WRAPPED and not _ENDS.search(lines[last]) and len(lines[last]) < 160 and bare(last + 1):
            last += 1
        return first, last


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> LicenceModel:
    """Trains with paragraphs of a bounded sample of documents (the first by a hash of the text) as negatives, at most four a document."""
    known = docs.where("text is not null").select("text")
    n = known.count()
    # only the texts whose hash is low enough to be among the first are read further; four times as many as needed, so that copies can go
    share = max(1, min(1 << 30, math.ceil((1 << 30) * 4 * sample_docs / max(1, n))))
    low = F.pmod("h", F.lit(1 << 30))
    begin = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - sample_chars, F.lit(0)) + 1) + 1
    some = known.withColumn("h", F.xxhash64("text")).where(low < share).select("h", F.substr("text", begin.cast("int"), F.lit(sample_chars)).alias("t")).distinct().orderBy(low, "h", "t").limit(sample_docs).collect()
    lines: dict[str, None] = {}
    for i, r in enumerate(some):
        own = [x for x in r["t"].split("\n") if x.strip()]
        random.Random(i).shuffle(own)
        lines |= dict.fromkeys(own[:4])
    return LicenceModel(list(lines))


def scan_documents(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """A row per licence paragraph: doc_id, paragraph, begin, end, family, probability, similarity, confirmed, others."""
    shared = docs.sparkSession.sparkContext.broadcast(model or learn(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = shared.value.scan
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.string()]
        names = ["doc_id", "paragraph", "begin", "end", "family", "probability", "similarity", "confirmed", "others"]
        for batch in batches:
            rows = [(doc, *found) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True) if text.is_valid for found in scan(text.as_py())]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, paragraph int, begin long, end long, family string, probability double, similarity double, confirmed boolean, others string")


def op2_licence_scan(spark, sf_dir: str) -> DataFrame:
    return scan_documents(read_table(spark, f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_licence_scan": op2_licence_scan}
SQL: dict[str, str] = {}
