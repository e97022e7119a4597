"""Licence scans: normalised passages against licence templates by the Dice coefficient
of their word bigrams; size bounds prune the templates that can reach the threshold."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise, product
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import table
from rivulet.session import ship

THRESHOLD = 0.8
#: Whole licence texts, a file for each: the identifier, and after a plus sign a variant.
TEXTS = Path(__file__).parent / "licences"

_TOKEN = re.compile(r"[^\W_]+(?:\.\d+)*")
#: Lines that name the holder, not the licence.
_HOLDER = re.compile(r"^[^\w\n]*(?:copyright\b[^\w\n]*(?:\(c\)|©|<|\d{4})|©|\(c\)\W*\d{4})[^\n]*$", re.I | re.M)


def normalise(text: str) -> list[str]:
    """Words in lower case, punctuation and white space dropped, version numbers kept whole."""
    return _TOKEN.findall(text.lower())


@dataclass(frozen=True)
class Template:
    """A licence's whole text, or a notice: wording that varies around a name that must stand in it whole."""

    license: str
    text: str
    names: tuple[str, ...] = ()


# Licence names, identifiers and the customary wording of notices.
_STEMS = ("Licensed under the {}", "Released under the {}", "Distributed under the {}", "This work is licensed under the {}", "This software is licensed under the terms of the {}")
_NAMES = {
    "MIT": ("MIT License", "MIT Licence"),
    "ISC": ("ISC License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "MPL-1.1": ("Mozilla Public License, Version 1.1", "Mozilla Public License 1.1"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"),
    "Zlib": ("zlib License",),
    "Unlicense": ("The Unlicense", "Unlicense License"),
    "NCSA": ("University of Illinois/NCSA Open Source License",),
    "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"),
    "Artistic-1.0": ("Artistic License 1.0",),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero 1.0"),
}
_GNU = {"GPL": ("General", ("1", "2", "3")), "LGPL": ("Lesser General", ("2.1", "3")), "AGPL": ("Affero General", ("3",)), "GFDL": ("Free Documentation", ("1.2", "1.3"))}
_CC = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
_HEADERS = {
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License, Version 2.0",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Mozilla Public License, v. 2.0",
    ),
}
_LATER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, "
    "either version {version} of the License, or (at your option) any later version."
)


def notices() -> list[Template]:
    """Customary one-line notices, file headers and SPDX lines."""
    out, names = [], {k: list(v) for k, v in _NAMES.items()}
    for short, (kind, versions) in _GNU.items():
        name = f"GNU {kind} {'License' if short == 'GFDL' else 'Public License'}"
        for v in versions:
            spdx = f"{short}-{v}" if "." in v else f"{short}-{v}.0"
            names[spdx] = [f"{name}, version {v}", f"{name} v{v}", f"{name} {v}", f"GNU {short} v{v}", f"{short}v{v}", f"{short}-{v}.0" if "." not in v else f"{short}-{v}"]
            out.append(Template(spdx, _LATER.format(name=name, version=v), (name, f"version {v}")))
    for parts in (("BY",), ("BY", "SA"), ("BY", "NC"), ("BY", "ND"), ("BY", "NC", "SA"), ("BY", "NC", "ND")):
        for v in ("2.0", "2.5", "3.0", "4.0"):
            names[f"CC-{'-'.join(parts)}-{v}"] = [f"CC {'-'.join(parts)} {v}", f"Creative Commons {'-'.join(parts)} {v}", f"Creative Commons {'-'.join(_CC[x] for x in parts)} {v}", f"Creative Commons {'-'.join(_CC[x] for x in parts)} {v} International License"]
    for spdx, own in names.items():
        for stem, name in product(_STEMS, own):
            out.append(Template(spdx, stem.format(name), (name,)))
            if "under the {}" in stem:  # as in: Licensed under CC BY 4.0
                out.append(Template(spdx, stem.replace("the {}", "{}").format(name), (name,)))
        out.append(Template(spdx, f"SPDX-License-Identifier: {spdx}", ("SPDX License Identifier", spdx)))
    out.append(Template("Apache-2.0", "Apache License, Version 2.0", ("Apache License, Version 2.0",)))
    return out + [Template(k, text, (name,)) for k, (text, name) in _HEADERS.items()]


def templates() -> list[Template]:
    """Notices, and the whole texts below ``TEXTS``."""
    return notices() + [Template(p.stem.split("+")[0], p.read_text(encoding="utf-8")) for p in sorted(TEXTS.glob("*.txt"))]


def bigrams(words: list[str]) -> Counter:
    return Counter(pairwise(words))


def dice(a: Counter, b: Counter) -> float:
    """2 |A and B| / (|A| + |B|) over multisets; 0 where both are empty."""
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    both = sum(min(n, many[g]) for g, n in few.items() if g in many)
    return 2 * both / max(1, a.total() + b.total())


#: Words that say little of a passage (fixed values): templates are looked for by their other bigrams.
_COMMON = frozenset("a an and any are as at be by for from in is it its may must no not of on or other such that the this to under which with you your work license licensed software".split())


class Matcher:
    """Passages of a text that match a template: word windows of any place and, within the bounds that
    the threshold sets, any size.

    A window of n bigrams can reach the threshold t with a template of m only if n t / (2 - t) <= m <=
    n (2 - t) / t, and only if they share at least m t / (2 - t). So it holds one of any m - m t / (2 - t) + 1
    of the template's bigrams: the least common ones are looked up at every place of a text, and
    only their templates are tried there, where bigrams of theirs lie densely enough.
    """

    def __init__(self, known: list[Template], threshold: float) -> None:
        self.t = threshold
        self.license: list[str] = []
        self.grams: list[dict[tuple[str, str], int]] = []  # bigram -> its number
        self.caps: list[np.ndarray] = []
        self.names: list[list[list[str]]] = []
        self.seeds: dict[tuple[str, str], list[int]] = {}
        self.sizes: list[int] = []
        seen = set()
        for x in sorted(known, key=lambda x: x.license):
            words = normalise(_HOLDER.sub("", x.text))
            own = bigrams(words)
            if (x.license, *words) in seen or not own:
                continue
            seen.add((x.license, *words))
            i = len(self.license)
            self.license.append(x.license)
            self.grams.append({g: k for k, g in enumerate(own)})
            self.caps.append(np.array(list(own.values())))
            self.names.append([normalise(n) for n in x.names])
            self.sizes.append(own.total())
            rare = sorted(own.elements(), key=lambda g: ((g[0] in _COMMON) + (g[1] in _COMMON), -len(g[0]) - len(g[1]), g))
            one = [g for g in rare if any(g in pairwise(n) for n in self.names[i])][:1]  # a name stands in every match
            for g in dict.fromkeys(one or rare[: own.total() - self.least(i) + 1]):
                self.seeds.setdefault(g, []).append(i)

    def least(self, i: int) -> int:
        """Bigrams that a window must share with template i."""
        return max(1, math.ceil(self.sizes[i] * self.t / (2 - self.t) - 1e-9))

    def window(self, i: int, hits: tuple[np.ndarray, np.ndarray], names: list[tuple[np.ndarray, np.ndarray]], a: int, b: int) -> tuple[float, int, int, int] | None:
        """(dice, shared, first, last bigram) of the best window for template i among bigrams a to b - 1:
        the highest Dice, then the earliest and shortest. hits: places and numbers of the template's bigrams;
        names: first and last bigram of every place of each of its names."""
        lo, hi = np.searchsorted(hits[0], (a, b))
        at, gram = hits[0][lo:hi], hits[1][lo:hi]
        need, m = self.least(i), self.sizes[i]
        most = int(m * (2 - self.t) / self.t + 1e-9)
        if len(at) < need:
            return None
        stop = np.searchsorted(at, at + most)  # hits of the longest window from each
        index = np.arange(len(at))
        order = np.argsort(gram, kind="stable")
        nth = np.empty(len(at), np.int64)  # how often the bigram occurs before here
        starts = np.flatnonzero(np.diff(gram[order], prepend=-1))
        nth[order] = index - np.repeat(starts, np.diff([*starts, len(at)]))
        passed = np.zeros(len(self.caps[i]), np.int64)
        best, s, done = None, 0, 0
        while s < len(at):
            if stop[s] - s < need:
                s += 1
                continue
            np.add.at(passed, gram[done:s], 1)
            done = s
            part = slice(s, stop[s])
            shared = np.cumsum(nth[part] - passed[gram[part]] < self.caps[i][gram[part]])
            if shared[-1] < need:  # later starts gain at most the hits that come in at the end
                s = max(s + 1, int(np.searchsorted(stop, stop[s] + need - shared[-1])))
                continue
            size = at[part] - at[s] + 1
            score = 2 * shared / (size + m)
            for first, last in names:
                k = np.searchsorted(first, at[s])
                score[at[part] < (last[k] if k < len(first) and last[k] < b else b)] = 0
            k = int(np.argmax(score))
            if score[k] >= self.t - 1e-12 and (best is None or score[k] > best[0]):
                best = (float(score[k]), int(shared[k]), int(at[s]), int(at[s + k]))
            s += 1
        return best

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(licence, dice, first line, last line) of the matches, in order. Lines that name a holder are no
        words. Of all windows the one that shares most bigrams with its template is taken, then the highest
        Dice, the first licence by name; then of those that overlap none taken before, and so on."""
        lower = text.lower()
        if "copyright" in lower or "©" in lower or "(c)" in lower:
            text = _HOLDER.sub("", text)
        words = normalise(text)
        grams = list(pairwise(words))
        tried = sorted({i for g in grams if g in self.seeds for i in self.seeds[g]})
        if not tried:
            return []
        hits, names, kept = {}, {}, []
        where: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            where.setdefault(w, []).append(i)
        for i in tried:
            named = []
            for name in self.names[i]:
                first = np.array([k for k in where.get(name[0], ()) if words[k : k + len(name)] == name], np.int64)
                named.append((first, first + len(name) - 2))  # bigrams a to b hold words a to b + 1
            if all(len(f) for f, _ in named):
                own = self.grams[i]
                found = [(k, own[g]) for k, g in enumerate(grams) if g in own]
                if len(found) >= self.least(i):
                    hits[i] = tuple(np.array(x, np.int64) for x in zip(*found, strict=True))
                    names[i] = named
        spans, todo = [], [(0, len(grams), None)]
        while todo:
            a, b, above = todo.pop()
            best = {i: w for i in (hits if above is None else above) if (w := self.window(i, hits[i], names[i], a, b))}
            if best:
                i = min(best, key=lambda i: (-best[i][1], -best[i][0], self.license[i], i))
                score, _, first, last = best[i]
                spans.append((self.license[i], score, first, last + 1))
                # a window before ends with the word before the match
                todo += [(a, first - 1, list(best)), (last + 2, b, list(best))]
        if spans:
            ends = [m.start() for m in _TOKEN.finditer(text.lower())]
            breaks = np.flatnonzero(np.frombuffer(text.lower().encode("utf-32-le"), np.uint32) == 10)
            line = np.searchsorted(breaks, ends)
            kept = [(x, d, int(line[a]), int(line[b])) for x, d, a, b in sorted(spans, key=lambda x: x[2])]
        return kept


def scan_licenses(docs: DataFrame, known: list[Template] | None = None, threshold: float = THRESHOLD, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and its matches (license, dice, first_line, last_line; lines
    from 0), by :class:`Matcher`. No row moves; whole texts are read. Null and empty texts have
    no matches; repeated rows and extra columns change nothing; an empty table gives no rows. The
    templates (by default :func:`templates`, 300 KB) are broadcast."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(templates() if known is None else known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(shared.value, threshold)
        kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("first_line", pa.int32()), ("last_line", pa.int32())]))
        names = ("license", "dice", "first_line", "last_line")
        for batch in batches:
            out = [[dict(zip(names, x, strict=True)) for x in m.scan(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "matches"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, matches array<struct<license: string, dice: double, first_line: int, last_line: int>>")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    return out.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(names, ",").alias("licenses"),
        F.array_max(F.transform("matches", lambda m: m["dice"])).alias("best_dice"),
    )
