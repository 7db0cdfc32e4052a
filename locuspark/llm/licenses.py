"""License scans by Dice's coefficient over word bigrams; DataFrame functions only.

A unit is a line, a paragraph (between blank lines) or the whole text, normalised to lower
case words of letters and digits. A unit is compared only with templates that its number of
bigrams allows to reach the wanted coefficient, as ``2*min/(min+max)`` bounds it from above:
an equi-join on that number, with each template under all numbers that it allows.
Before that, a text must hold one of a few words, and a unit one of a few bigrams, that no match
can do without.

Defined results: null and empty texts match nothing; of several templates all that reach
the coefficient are reported; repeated units add up in ``n_units``; repeated rows and rows
with a null doc_id are reported together; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DICE = 0.8
#: Bigrams from which on a template counts as long.
LONG = 40

_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Public licence notices and licence texts.
TEMPLATES = [
    ("agpl-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("bsd-2-clause", "Licensed under the BSD 2-Clause License."),
    ("bsd-3-clause", "Licensed under the BSD 3-Clause License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd-2-clause-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. " + _BSD_DISCLAIMER),
    ("bsd-3-clause-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_DISCLAIMER),
    ("gpl-3.0-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("mit-full", "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]


#: Characters of templates up to which their tables are sent to all tasks; larger ones are joined by shuffles.
BROADCAST_CHARS = 1 << 22


def normal(text: Column) -> Column:
    """Lower-case words of letters and digits with single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))


def bigrams(w: Column) -> Column:
    """The distinct word bigrams of an array of words."""
    return F.array_distinct(F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(1))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b)))


def template_table(spark: SparkSession, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """license, t_grams and t_n: a small table of the caller's texts."""
    rows = spark.createDataFrame(list(templates), "license string, body string")
    return rows.select("license", bigrams(F.split(normal(F.col("body")), " ")).alias("t_grams")).withColumn("t_n", F.size("t_grams"))


def rare_grams(dice: float, templates: Sequence[tuple[str, str]] = TEMPLATES) -> dict[tuple[str, str], int]:
    """Bigrams of which every unit that reaches the coefficient with some template has one, with the least number of bigrams of such a unit.

    Such a unit shares at least ``dice / (2 - dice)`` of the template's bigrams, so it has one
    of any larger remainder of them; those with the longest words make the remainder.
    """
    found: dict[tuple[str, str], int] = {}
    for _, body in templates:
        w = "".join(c if c.isalnum() else " " for c in body.lower()).split()
        grams = sorted(set(zip(w, w[1:], strict=False)), key=lambda g: (-max(map(len, g)), g))
        least = math.ceil(len(grams) * dice / (2 - dice) - 1e-9)
        for g in grams[: len(grams) - least + 1]:
            found[g] = min(least, found.get(g, least))
    return found


def units(docs: DataFrame, dice: float, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """doc_id and the words of each line, paragraph and whole text that has one of the rare bigrams.

    Whole texts are first tested for one word of each such bigram. Bigrams of long templates are
    looked for only in units that are long enough.
    """
    grams = rare_grams(dice, templates)
    if not grams:
        return docs.where("false").select(F.col("doc_id").cast("long"), F.split("text", " ").alias("w"))
    marks = F.array(*map(F.lit, sorted({max(g, key=lambda w: (len(w), w)) for g in grams})))
    text = F.replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    plain = docs.select(F.col("doc_id").cast("long"), F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}\n]+", " ").alias("plain"))
    held = plain.where(F.arrays_overlap(F.split(F.translate("plain", "\n", " "), " "), marks))
    lines = F.split("plain", "\n")
    paragraphs = F.filter(F.split("plain", "\n *\n"), lambda p: p.contains("\n"))
    whole = F.when(F.col("plain").contains("\n"), F.array("plain")).otherwise(F.array().cast("array<string>"))
    parts = held.select("doc_id", F.explode(F.concat(lines, paragraphs, whole)).alias("part"))
    named = parts.select("doc_id", F.regexp_replace("part", "[ \n]+", " ").alias("unit"))
    padded, some = F.concat(F.lit(" "), "unit", F.lit(" ")), F.lit(False)
    for x, y in sorted(g for g, least in grams.items() if least < LONG):
        some = some | F.contains(padded, F.lit(f" {x} {y} "))
    w = F.split(F.trim("unit"), " ")
    if long := [f"{x} {y}" for (x, y), least in sorted(grams.items()) if least >= LONG]:
        some = some | ((F.size(w) > LONG) & F.arrays_overlap(bigrams(w), F.lit(long)))
    return named.where(some).select("doc_id", w.alias("w"))


def scan(docs: DataFrame, dice: float = DICE, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, license, n_units, best_dice of the documents in which a template (name, text) is found."""
    sizes = F.sequence(F.ceil(F.col("t_n") * (dice / (2 - dice)) - F.lit(1e-9)).cast("int"), F.floor(F.col("t_n") * ((2 - dice) / dice) + F.lit(1e-9)).cast("int"))
    bodies = template_table(docs.sparkSession, templates)
    sized = bodies.select("license", F.explode(sizes).alias("n"))
    grams = units(docs, dice, templates).select("doc_id", bigrams(F.col("w")).alias("grams")).withColumn("n", F.size("grams"))
    shared = F.size(F.array_intersect("grams", "t_grams"))
    few = sum(len(body) for _, body in templates) <= BROADCAST_CHARS
    sized, bodies = (F.broadcast(x) if few else x for x in (sized, bodies))
    pairs = grams.join(sized, "n").join(bodies, "license").select("doc_id", "license", (2 * shared / (F.col("n") + F.col("t_n"))).alias("dice"))
    return pairs.where(F.col("dice") >= dice).groupBy("doc_id", "license").agg(F.count("*").alias("n_units"), F.round(F.max("dice"), 6).alias("best_dice"))
