"""Licence notices by the Dice coefficient of word bigrams. DataFrame functions only.

A text and the templates are normalised to words (lower case letters and digits) and compared as sets of word bigrams. What is
compared of a text are its lines, and its blocks of lines for templates of several lines: a piece carries a licence if 2 * common / (piece + template) is
at least `percent` / 100.

* Lines: every line against every template.
* Blocks (`licence_blocks`): for a template of w words, every window of w words of the text (the whole text, if it is shorter). Windows run over line ends, so a notice that is
  wrapped anew is found, wherever in a text it stands, also within a longer line.

Sizes prune: a piece of n bigrams can only reach a template of m bigrams if n lies between m * p / (200 - p) and
m * (200 - p) / p; it must also share c = m * p / (200 - p) of them, so that one of any m - c + 1 is present, and only texts that
hold one of the rarest words of the templates are looked at. A window with c common bigrams holds c places of the template's bigrams within its words, so the windows to be
compared are those round any c successive places that lie close enough. All tests are exact: nothing that would match is lost.

Defined cases: null and empty texts have no line; lines of one word have no bigram and match nothing; repeated lines
and rows match each; null ids are carried; an empty table gives an empty result; a tie between templates reports each; a very long text is one row's work (lines are
rows of their own; its words are one array). Extra columns are not read.
Nothing is shuffled: a text's windows are compared within its row, and only the best one of each template leaves it. Templates are a parameter of bounded size that goes into the plan as literals.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Short licence notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Released to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "Licensed under the Mozilla Public License, version 2.0.",
}

#: The public texts of whole notices and headers, each of several lines where it is used.
BLOCKS = {
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
        "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}

def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))


def needed_words(templates: dict[str, str], percent: int) -> list[str]:
    """A line that matches holds one of these words.

    With m bigrams in the template at least c = ceil(m * p / (200 - p)) are common (the line has no fewer), so of any
    m - c + 1 of them one is present; the last ones are taken, and of each its longer word.
    """
    out = set()
    for t in templates.values():
        b = bigrams_of(t)
        common = least_common(len(b), percent)
        ranked = sorted(b, key=lambda x: (max(map(len, x.split())), x), reverse=True)
        out |= {max(x.split(), key=lambda w: (len(w), w)) for x in ranked[: len(b) - common + 1]}
    return sorted(out)


def line_bigrams(line: Column) -> Column:
    w = F.regexp_extract_all(F.lower(line), F.lit("[a-z0-9]+"), F.lit(0))
    pairs = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def licence_lines(docs: DataFrame, templates: dict[str, str] | None = None, *, percent: int = 80, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col, line_no (from 0), licence, n_common, n_line, n_template, dice: every line that carries a licence."""
    templates = templates or TEMPLATES
    sizes = {k: len(bigrams_of(t)) for k, t in templates.items()}
    least, most = min(sizes.values()) * percent // (200 - percent), -(-max(sizes.values()) * (200 - percent) // percent)
    hint = "(?i)" + "|".join(needed_words(templates, percent))
    has = F.col(text).rlike(hint)
    lines = docs.where(has).select(id_col, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).where(F.col("line").rlike(hint))
    grams = lines.select(id_col, "line_no", line_bigrams(F.col("line")).alias("grams")).where((F.size("grams") >= max(1, least)) & (F.size("grams") <= most))
    one = lambda k, t: F.struct(F.lit(k).alias("licence"), F.lit(sizes[k]).alias("n_template"), F.when((F.size("grams") * (200 - percent) >= sizes[k] * percent) & (F.size("grams") * percent <= sizes[k] * (200 - percent)), F.size(F.array_intersect("grams", F.array(*map(F.lit, bigrams_of(t)))))).otherwise(0).alias("n_common"))
    scored = grams.select(id_col, "line_no", F.size("grams").alias("n_line"), F.explode(F.array(*[one(k, t) for k, t in templates.items() if sizes[k]])).alias("x")).where(F.col("x.n_common") * 200 >= (F.col("n_line") + F.col("x.n_template")) * percent)
    return scored.select(id_col, "line_no", "x.licence", F.col("x.n_common").cast("long").alias("n_common"), F.col("n_line").cast("long").alias("n_line"), F.col("x.n_template").cast("long").alias("n_template"), F.round(2 * F.col("x.n_common") / (F.col("n_line") + F.col("x.n_template")), 6).alias("dice"))


def least_common(n_template: int, percent: int) -> int:
    """So many bigrams a piece that matches has in common with the template."""
    return -(-n_template * percent // (200 - percent))


def best_window(b: Column, n_words: Column, licence: str, template: str, percent: int) -> Column:
    """struct(dice, first, licence, n_common, n_window, n_template) of the text's best window, or null. b: the text's bigrams, in order; first: less the place of its first word."""
    grams, w = bigrams_of(template), len(words_of(template))
    m, c, known = len(grams), least_common(len(grams), percent), F.array(*map(F.lit, grams))
    at = F.array_compact(F.transform(b, lambda x, i: F.when(x.isin(grams), i)))

    def of(places: Column) -> Column:
        """Starts of windows that hold c successive places: from the last one's less the window's length to the first one's."""
        last = F.greatest(n_words - w, F.lit(0))
        span = lambda i: F.struct(F.greatest(F.get(places, i + (c - 1)) - (w - 2), F.lit(0)).alias("lo"), F.least(F.get(places, i), last).alias("hi"))
        none = F.array().cast("array<int>")
        each = F.when(F.size(places) >= c, F.transform(F.sequence(F.lit(0), F.size(places) - c), span))
        starts = F.array_distinct(F.flatten(F.transform(each, lambda x: F.when(x["lo"] <= x["hi"], F.sequence(x["lo"], x["hi"])).otherwise(none))))
        held = F.transform(starts, lambda s: F.struct(s.alias("s"), F.array_distinct(F.slice(b, s + 1, F.lit(w - 1))).alias("win")))
        sized = F.transform(held, lambda x: F.struct(x["s"].alias("s"), F.size(x["win"]).alias("n"), F.size(F.array_intersect(x["win"], known)).alias("common")))
        good = F.filter(sized, lambda x: x["common"] * 200 >= (x["n"] + m) * percent)
        dice = lambda x: F.round(2 * x["common"] / (x["n"] + m), 6)
        return F.array_max(F.transform(good, lambda x: F.struct(dice(x).alias("dice"), (-x["s"]).alias("first"), F.lit(licence).alias("licence"), x["common"].cast("long").alias("n_common"), x["n"].cast("long").alias("n_window"), F.lit(m).cast("long").alias("n_template"))))

    return F.get(F.transform(F.array(at), of), F.lit(0))


def licence_blocks(docs: DataFrame, templates: dict[str, str] | None = None, *, percent: int = 80, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col, licence, word_no (where the window begins, from 0), n_common, n_window, n_template, dice: of each text and template the best window of the template's
    number of words, if it carries the licence; ties to the first window. Windows run over line ends."""
    templates = {k: t for k, t in (BLOCKS if templates is None else templates).items() if len(words_of(t)) > 1}
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    needed = needed_words(templates, percent)
    some = docs.select(F.col(id_col).alias("_id"), words.alias("_w")).where(F.exists("_w", lambda x: x.isin(needed))).withColumn("_n", F.size("_w"))
    tail = F.greatest(F.col("_n") - 1, F.lit(0))
    some = some.withColumn("_b", F.zip_with(F.slice("_w", F.lit(1), tail), F.slice("_w", F.lit(2), tail), lambda a, b: F.concat_ws(" ", a, b)))
    every = F.array(*[best_window(F.col("_b"), F.col("_n"), k, t, percent) for k, t in templates.items()])
    best = some.select("_id", F.explode(F.array_compact(every)).alias("x"))
    return best.select(F.col("_id").alias(id_col), "x.licence", (-F.col("x.first")).alias("word_no"), "x.n_common", "x.n_window", "x.n_template", "x.dice")


def licences_found(docs: DataFrame, templates: dict[str, str] | None = None, blocks: dict[str, str] | None = None, *, percent: int = 80, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col, kind (line or block), place (of the line or of the window's first word), licence, n_common, n_piece, n_template, dice."""
    lines = licence_lines(docs, templates, percent=percent, text=text, id_col=id_col).select(id_col, F.lit("line").alias("kind"), F.col("line_no").alias("place"), "licence", "n_common", F.col("n_line").alias("n_piece"), "n_template", "dice")
    wide = licence_blocks(docs, blocks, percent=percent, text=text, id_col=id_col).select(id_col, F.lit("block").alias("kind"), F.col("word_no").alias("place"), "licence", "n_common", F.col("n_window").alias("n_piece"), "n_template", "dice")
    return lines.unionByName(wide)
