"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Words are runs of lower-cased ASCII letters and digits; a shingle is five of them. A text is read in windows of four shingles
(eight words) that start every two, the first of them two before the text, so every shingle lies in two windows. A window's signature has 32 one-row bands, each
the least of its shingle hashes under another permutation (XOR with a constant, of well-mixed hashes). The templates'
signatures are taken over windows of the same kind at every offset.

A window that shares a part J of its shingles with a template's window retrieves it with probability 1 - (1 - J)**32. The
hardest case, a notice that is one single shingle, has J = 1/4 at least in each of two windows: 1 - (3/4)**64, over 0.99999998. Of a
longer template any one window suffices. A template counts if at least ``LEAST`` of its distinct shingles are in the
document, compared as words, not as hashes.

Only DataFrame functions run. Texts are not shuffled where candidates (numbers of templates) are counted and few, and so broadcast;
the templates' shingles are a constant of the plan.

Edge cases: null and empty texts, and those of fewer than five words, have no licenses; templates of fewer than five words are
refused; rows of one doc_id and one text count as one and get equal results; a row without doc_id is judged by its text;
an empty table gives an empty result; extra columns are kept and helper columns start with ``__cv_``.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _io

K, WIDTH, STEP, BANDS, LEAST = 5, 4, 2, 32, 0.8
#: Documents with candidates, and candidates in them, that may be broadcast; beyond it texts are shuffled.
MOST_BROADCAST, MOST_CANDIDATES = 200_000, 1_000_000

#: Public wordings of license notices, by SPDX identifier; short notices, then full texts and headers.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Released into the public domain under CC0 1.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT-full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC-full": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause-full": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
        "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
        "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause-third": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Zlib-full": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program."
    ),
}


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]++", " "), " "), lambda w: w != "")


def shingles_of(words: Column) -> Column:
    """Shingles as words joined by blanks, in order; none of fewer than five words."""
    n = F.size(words)
    return F.when(n >= K, F.transform(F.slice(words, 1, F.greatest(n - K + 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + j) for j in range(1, K)]))).otherwise(F.array().cast("array<string>"))


def _hashed(words: Column) -> Column:
    """Hashes of the shingles, without building them."""
    n = F.size(words)
    return F.when(n >= K, F.transform(F.slice(words, 1, F.greatest(n - K + 1, F.lit(0))), lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, K)]))).otherwise(F.array().cast("array<bigint>"))


def _constants() -> list[int]:
    x, out = 0x9E3779B97F4A7C15, []
    for _ in range(BANDS):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        y = x ^ (x >> 29)
        out.append(y - (1 << 64) if y >= 1 << 63 else y)
    return out


def with_bands(df: DataFrame, hashes: str, step: int, first: int = 0) -> DataFrame:
    """``df`` with a row for each band value of each window of the array ``hashes``, from the place ``first``, in place of it.

    A window is a row of WIDTH columns before its bands are made, so that they run in generated code.
    """
    rest = [c for c in df.columns if c != hashes]
    starts = F.when(F.size(hashes) > 0, F.sequence(F.lit(first), F.greatest(F.size(hashes) - 1, F.lit(0)), F.lit(step)))  # a filter here would be pushed below the hashes and repeat them
    windows = F.transform(starts, lambda s: F.struct(*[F.get(F.col(hashes), s + j).alias(f"h{j}") for j in range(WIDTH)]))
    each = df.select(*rest, F.explode(windows).alias("w")).select(*rest, "w.*")
    each = each.select("*", F.explode(F.array(*[F.struct(F.lit(b).alias("b"), F.lit(c).alias("c")) for b, c in enumerate(_constants())])).alias("p"))
    least = F.least(*[F.col(f"h{j}").bitwiseXOR(F.col("p.c")) for j in range(WIDTH)])  # nulls before the start and beyond the end are skipped
    return each.select(*rest, F.xxhash64("p.b", least).alias("band"))


def templates_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license, words) of every template."""
    rows = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("t")) for k, v in templates.items()])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.license", words_of(F.col("r.t")).alias("words"))


def _distinct_shingles(template: str) -> list[str]:
    words = re.findall("[a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in template))
    return list(dict.fromkeys(" ".join(words[i : i + K]) for i in range(len(words) - K + 1)))


def _number(names: list[str], license: Column) -> Column:
    """The place of a license's name in ``names``."""
    return (F.array_position(F.array(*map(F.lit, names)), license) - 1).cast("int")


def retrieve(docs: DataFrame, templates: DataFrame, text: str = "text") -> DataFrame:
    """Distinct (doc_id, key, license) that share a band in some window; ``key`` is a hash of the text."""
    known = with_bands(templates.select("license", _hashed(F.col("words")).alias("h")), "h", 1).distinct()
    read = docs.filter(F.col(text).isNotNull()).select("doc_id", F.xxhash64(text).alias("key"), words_of(F.col(text)).alias("w"))
    read = with_bands(read.select("doc_id", "key", _hashed(F.col("w")).alias("h")), "h", STEP, -STEP)
    return read.join(F.broadcast(known), "band").select("doc_id", "key", "license").distinct()


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text", least: float = LEAST) -> DataFrame:
    """All columns of ``docs`` with ``__cv_licenses``: array of (license, containment), sorted."""
    templates = templates or TEMPLATES
    if sum(map(len, templates.values())) > 1 << 20:
        raise ValueError("templates beyond a megabyte are not broadcast; scan with them in blocks")
    if short := [k for k, v in templates.items() if len(re.findall("[a-z0-9]+", v.lower())) < K]:
        raise ValueError(f"a template needs five words: {short}")
    names = sorted(templates)
    table = templates_table(docs.sparkSession, templates)
    found = _io.materialize(retrieve(docs, table, text)).groupBy("doc_id", "key").agg(F.collect_list(_number(names, F.col("license"))).alias(_io.OWN + "candidates"))
    found = found.withColumnsRenamed({"doc_id": _io.OWN + "id", "key": _io.OWN + "key"})
    if _io.is_small(found, MOST_BROADCAST, MOST_CANDIDATES, F.size(_io.OWN + "candidates")):
        found = F.broadcast(found)
    known = F.from_json(F.lit(json.dumps([_distinct_shingles(templates[n]) for n in names])), "array<array<string>>")
    own = F.col(_io.OWN + "own")
    share = lambda c: F.struct(F.get(F.array(*map(F.lit, names)), c).alias("license"), (F.size(F.array_intersect(F.get(known, c), own)) / F.size(F.get(known, c))).alias("containment"))
    empty = F.array().cast("array<struct<license:string,containment:double>>")
    out = docs.join(found, F.col("doc_id").eqNullSafe(F.col(_io.OWN + "id")) & (F.xxhash64(text) == F.col(_io.OWN + "key")), "left")
    out = out.withColumn(_io.OWN + "words", F.when(F.col(_io.OWN + "candidates").isNotNull(), words_of(F.col(text))))
    out = out.withColumn(_io.OWN + "own", shingles_of(F.col(_io.OWN + "words")))  # a step of its own, so that words are made once
    kept = F.array_sort(F.filter(F.transform(_io.OWN + "candidates", share), lambda s: s["containment"] >= least))
    return out.withColumn(_io.OWN + "licenses", F.coalesce(kept, empty)).select(*[f"`{c}`" for c in docs.columns], _io.OWN + "licenses")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan(_io.read(spark, sf_dir, "documents").select("doc_id", "text"))
    found = F.col(_io.OWN + "licenses")
    return out.select("doc_id", F.size(found).cast("long").alias("n_licenses"), F.array_join(F.transform(found, lambda s: s["license"]), ",").alias("licenses"), F.round(F.array_max(F.transform(found, lambda s: s["containment"])), 6).alias("best"))


_VALUES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
ORACLE = f"""
WITH t AS (SELECT id, [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] AS s FROM
        (SELECT id, list_filter(string_split(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'), ' '), lambda v: v <> '') AS w FROM (VALUES {_VALUES}) v(id, x))),
ts AS (SELECT DISTINCT id, unnest(s) AS g FROM t), n AS (SELECT id, count(*) AS n FROM ts GROUP BY id),
d AS (SELECT doc_id, list_filter(string_split(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda v: v <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) AS g FROM d WHERE len(w) >= 5),
m AS (SELECT doc_id, id, count(*)::DOUBLE / any_value(n.n) AS c FROM g JOIN ts USING (g) JOIN n USING (id) GROUP BY doc_id, id),
k AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids, max(c) AS best FROM m WHERE c >= {LEAST} GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_licenses, coalesce(ids, '') AS licenses, round(best, 6) AS best FROM documents LEFT JOIN k USING (doc_id)
"""
