"""Operator 9: license scans by template-markup matching.

A template is a licence's wording with two marks: ``{...}`` is an optional region
and ``<name:n>`` a replaceable region of at most ``n`` words.  It is compiled into
a token automaton (states are positions between tokens, optional regions are
skip edges, replaceable regions are bounded wildcard loops), which a document's
words drive from every place where its first mandatory word stands.  A template
is accepted if some run reads all of its mandatory wording exactly, in order; what
follows the wording in a document is not read.  A notice or header behind one of ``DENIALS``
("is not licensed under ...") is not accepted.  Typographic quotes, dashes and bullets
are no part of the templates' words.

The base rule looks for a few phrases whose words stand consecutively.  Words are
the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z, i.e. of ASCII
letters and digits and all other characters.

``score`` is 1 where a template is accepted, else the largest share of a
template's mandatory words that a run has read; below ``FAINT`` it counts as 0.

Defined results: null text is empty (no words, null first and last word, empty
labels, score 0); repeated rows each get a row; a text may have any number of labels, and of
several runs that read part of a template the longest counts (ties do not matter); texts are
read whole; columns besides doc_id and text are not read, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .common import map_rows, prepare, table

#: Fixed values of the base rule.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Regions that several templates share.
_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <holders:12> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD_OPENING = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_SOURCE = "{1} {a} {i} redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_BSD_BINARY = "{2} {b} {ii} redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_ADVERTISING = "{3} {c} {iii} all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by <organization:16>"
_BSD_NAMES = "neither the name of <the copyright holder:12> nor the names of <its:4> contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_AS_IS = "this software is provided by <holders:12> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <holders:12> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_ISC_OPENING = "permission to use copy modify and {or} distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = "the software is provided as is and <the author:12> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <the author:12> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
_GPL_OPENING = "<program:4> is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
_GPL_REST = "<program:4> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with <program:4> if not"

_CC = "licensed under {a} {the} {terms of the} creative commons"
_MIT_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of <software:8> the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice {including the next paragraph} shall be included in all copies or substantial portions of the software "

#: label: template.  Words are compared after the same normalisation as the texts.
#: A *-text or *-header holds the whole mandatory wording, a *-notice one sentence that refers to a licence or opens it.
TEMPLATES = {
    "mit-notice": "released under the {terms of the} mit license",
    "apache-2.0-notice": "licensed under the apache license version 2 0 {the license}",
    "gpl-3.0-notice": "this <work:3> is licensed under the gnu general public license {either} version 3 {or later}",
    "gpl-2.0-notice": "this <work:3> is licensed under the gnu general public license {either} version 2 {or later}",
    "cc-by-4.0-notice": "licensed under {a} {creative commons} cc by 4 0",
    "cc-by-nc-4.0-notice": "licensed under {a} cc by nc 4 0",
    "cc-by-sa-4.0-notice": "licensed under {a} cc by sa 4 0",
    "cc-by-4.0-name-notice": _CC + " attribution 4 0 {international} {public} license",
    "cc-by-sa-4.0-name-notice": _CC + " attribution sharealike 4 0 {international} {public} license",
    "cc-by-nc-4.0-name-notice": _CC + " attribution noncommercial 4 0 {international} {public} license",
    "cc-by-nd-4.0-name-notice": _CC + " attribution noderivatives 4 0 {international} {public} license",
    "mit-opening-notice": "permission is hereby granted free of charge to any person obtaining a copy of <software:8> the software to deal in the software without restriction",
    "bsd-opening-notice": _BSD_OPENING,
    "isc-opening-notice": _ISC_OPENING,
    "gpl-opening-notice": _GPL_OPENING,
    "apache-2.0-opening-notice": "licensed under the apache license version 2 0 the license you may not use <this file:4> except in compliance with the license",
    "mpl-2.0-opening-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense-opening-notice": "this is free and unencumbered software released into the public domain",
    "mit-text": _MIT_GRANT + _AS_IS,
    "json-text": _MIT_GRANT + "the software shall be used for good not evil " + _AS_IS,
    "bsd-2-clause-text": f"{_BSD_OPENING} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_AS_IS}",
    "bsd-3-clause-text": f"{_BSD_OPENING} {_BSD_SOURCE} {_BSD_BINARY} {{3}} {{c}} {{iii}} {_BSD_NAMES} {_BSD_AS_IS}",
    "bsd-4-clause-text": f"{_BSD_OPENING} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_ADVERTISING} {{4}} {{d}} {{iv}} {_BSD_NAMES} {_BSD_AS_IS}",
    "isc-text": f"{_ISC_OPENING} provided that the above copyright notice and this permission notice appear in all copies {_ISC_AS_IS}",
    "0bsd-text": f"{_ISC_OPENING} {_ISC_AS_IS}",
    "unlicense-text": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law "
    + _AS_IS
    + " {for more information please refer to <address:6>}",
    "zlib-text": "this software is provided as is without any express or implied warranty in no event will <the authors:12> be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions {1} the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required {2} altered source versions must be plainly marked as such and must not be misrepresented as being the original software {3} this notice may not be removed or altered from any source distribution",
    "bsl-1.0-text": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use <this file:4> except in compliance with the license you may obtain a copy of the license at <scheme:1> {www} apache org licenses license 2 0 {txt} {html} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "gpl-2.0-header": f"{_GPL_OPENING} either version 2 of the license or at your option any later version {_GPL_REST}",
    "gpl-3.0-header": f"{_GPL_OPENING} either version 3 of the license or at your option any later version {_GPL_REST}",
    "gpl-2.0-only-header": f"{_GPL_OPENING} version 2 {{of the license}} {_GPL_REST}",
    "gpl-3.0-only-header": f"{_GPL_OPENING} version 3 {{of the license}} {_GPL_REST}",
    "mpl-2.0-header": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <scheme:1> {www} mozilla org mpl 2 0",
}
#: The same headers for the other GNU licences.
for _id, _name, _version in (("lgpl-2.1", "gnu lesser general", "2 1"), ("lgpl-3.0", "gnu lesser general", "3"), ("agpl-3.0", "gnu affero general", "3")):
    _opening, _rest = _GPL_OPENING.replace("gnu general", _name), _GPL_REST.replace("gnu general", _name)
    TEMPLATES[f"{_id}-header"] = f"{_opening} either version {_version} of the license or at your option any later version {_rest}"
    TEMPLATES[f"{_id}-only-header"] = f"{_opening} version {_version} {{of the license}} {_rest}"
    TEMPLATES[f"{_id[:4]}-opening-notice"] = _opening
#: How licences are named in a sentence, beside the notices above, and SPDX identifiers.
_NAMED = {
    "mit": ["mit license"], "apache-2.0": ["apache license {version} 2 0", "apache 2 0 license"], "gpl-2.0": ["gnu general public license {version} 2", "{gnu} gpl v2", "{gnu} gplv2"], "gpl-3.0": ["gnu general public license {version} 3", "{gnu} gpl v3", "{gnu} gplv3"],
    "lgpl-2.1": ["gnu lesser general public license {version} 2 1", "{gnu} lgpl v2 1"], "lgpl-3.0": ["gnu lesser general public license {version} 3", "{gnu} lgpl v3", "{gnu} lgplv3"], "agpl-3.0": ["gnu affero general public license {version} 3", "{gnu} agpl v3", "{gnu} agplv3"],
    "mpl-2.0": ["mozilla public license {version} 2 0", "mozilla public license v 2 0"], "epl-2.0": ["eclipse public license {version} 2 0"], "bsl-1.0": ["boost software license {version} 1 0"], "zlib": ["zlib license"], "unlicense": ["unlicense"],
    "isc": ["isc license"], "bsd-2-clause": ["bsd 2 clause license", "2 clause bsd license"], "bsd-3-clause": ["bsd 3 clause license", "3 clause bsd license"], "cc0-1.0": ["{creative commons} cc0 1 0"],
    "cc-by-4.0": ["{creative commons} cc by 4 0"], "cc-by-sa-4.0": ["{creative commons} cc by sa 4 0"], "cc-by-nc-4.0": ["{creative commons} cc by nc 4 0"], "cc-by-nd-4.0": ["{creative commons} cc by nd 4 0"], "cc-by-nc-sa-4.0": ["{creative commons} cc by nc sa 4 0"], "cc-by-nc-nd-4.0": ["{creative commons} cc by nc nd 4 0"],
}
_SPDX = """MIT Apache-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 EPL-2.0
  BSL-1.0 Zlib Unlicense ISC BSD-2-Clause BSD-3-Clause CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0""".split()
#: What the notices above already cover.
_COVERED = {("released", "mit"), ("licensed", "apache-2.0"), *(("licensed", f"cc-by{x}-4.0") for x in ("", "-nc", "-sa"))}
for _verb in ("licensed", "released", "distributed", "available"):
    for _id, _forms in _NAMED.items():
        for _k, _form in enumerate(_forms):
            if _k or (_verb, _id) not in _COVERED:
                TEMPLATES[f"{_id}-{_verb}{_k or ''}-notice"] = f"{_verb} under {{a}} {{the}} {{terms of}} {{the}} {_form}"
TEMPLATES |= {f"{x.lower()}-spdx": "spdx license identifier " + re.sub("[.-]", " ", x.lower()) for x in _SPDX}
FAINT = 0.5
#: Words that, among the three before a notice or header, deny it.
DENIALS = {b"not", b"never", b"cannot", b"no", b"longer", b"t"}

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """Steps are ("word", w), ("open", end) for an optional region that may be skipped to ``end``, ("any", n) for up to n words."""

    def __init__(self, label: str, template: str):
        self.label, self.steps = label, []
        self.denies = label.endswith(("-notice", "-header"))
        opened: list[int] = []
        for part in re.findall(r"\{|\}|<[^:>]*:\d+>|[^\s{}<>]+", template):
            if part == "{":
                opened.append(len(self.steps))
                self.steps.append(["open", 0])
            elif part == "}":
                self.steps[opened.pop()][1] = len(self.steps)
            elif part[0] == "<":
                self.steps.append(["any", int(part[1:-1].rpartition(":")[2])])
            else:
                self.steps += [["word", w] for w in words_of(part)]
        depth, ends, self.weight = 0, [], []
        for i, (kind, x) in enumerate(self.steps):
            while ends and ends[-1] <= i:
                ends.pop()
            self.weight.append(int(kind == "word" and not ends))
            if kind == "open":
                ends.append(x)
        self.total = sum(self.weight)
        self.first = next(i for i, w in enumerate(self.weight) if w)
        self.key = self.steps[self.first][1]

    def closure(self, states: dict) -> dict:
        """states: (step, words already taken by a replaceable region) -> mandatory words read."""
        stack = list(states.items())
        while stack:
            (i, n), got = stack.pop()
            if i < len(self.steps):
                kind, x = self.steps[i]
                to = [(x, 0), (i + 1, 0)] if kind == "open" else [(i + 1, 0)] if kind == "any" else []
                for s in to:
                    if states.get(s, -1) < got:
                        states[s] = got
                        stack.append((s, got))
        return states

    def run(self, words: list[bytes], at: int) -> float:
        """The share of the mandatory words read by the best run whose first mandatory word stands at ``at``."""
        states, best = self.closure({(self.first, 0): 0}), 0
        for p in range(at, len(words)):
            then: dict = {}
            for (i, n), got in states.items():
                if i < len(self.steps):
                    kind, x = self.steps[i]
                    if kind == "word" and x == words[p]:
                        s, g = (i + 1, 0), got + self.weight[i]
                    elif kind == "any" and n < x:
                        s, g = (i, n + 1), got
                    else:
                        continue
                    if then.get(s, -1) < g:
                        then[s] = g
            if not then:
                break
            states = self.closure(then)
            best = max(best, max(states.values()))
            if best == self.total:
                return 1.0
        return best / self.total


def scanner(templates: dict[str, str] | None = None):
    automata = [Automaton(k, t) for k, t in (templates or TEMPLATES).items()]
    phrases = [(p.encode().split(), label) for p, label in PHRASES]
    starts: dict[bytes, list] = {}
    for a in automata:
        starts.setdefault(a.key, []).append(a)
    marks = str.maketrans("\u2018\u2019\u201c\u201d\u2022\u2013\u2014", " " * 7)  # typographic marks are no part of a licence's words
    second = {a.label: next((a.steps[i][1] for i in range(a.first + 1, len(a.steps)) if a.weight[i]), None) for a in automata}

    def scan(text: str | None):
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        words = words_of(text)
        have = set(words)
        places, base = [], set()
        for phrase, label in phrases:
            if have.issuperset(phrase):
                n = len(phrase)
                found = [i for i, w in enumerate(words) if w == phrase[0] and words[i : i + n] == phrase]
                places += found
                base |= {label} if found else set()
        labels, score = set(base), 0.0
        n_words, read = len(words), words if not text or text.isascii() else words_of(text.translate(marks))
        have = set(read)
        for key in starts.keys() & have:
            todo = [a for a in starts[key] if second[a.label] is None or second[a.label] in have]
            if todo:
                for i, w in enumerate(read):
                    if w == key:
                        denied = not DENIALS.isdisjoint(read[max(0, i - 3) : i])
                        for a in todo:
                            if not (denied and a.denies) and (s := a.run(read, i)) >= FAINT:
                                score = max(score, s)
                                labels |= {a.label} if s == 1.0 else set()
        return n_words, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score

    return scan


def scan_documents(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    prepare(docs.sparkSession)

    def make():
        scan = scanner(templates)
        return lambda doc_id, text: [(doc_id, *scan(text))]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), make, f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")


def query(spark, sf_dir) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))
