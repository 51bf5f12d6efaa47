"""Licence scan with DataFrame functions only: TF-IDF cosine of notices and files to templates, then directories.

A file's units are its sentences, its lines, its header blocks (runs of lines without a line that
holds no word, so wrapped notices are whole) and the file itself. Each unit that holds one of a
few licence words is compared by TF-IDF cosine with each template: titles, one-line notices,
header paragraphs and whole licence texts. The weights of the templates' terms come from all
files (in how many each occurs); any other term weighs as much as the templates' terms do on average.
A unit is scored by expressions over the array of its terms, where it stands: nothing is exploded
or shuffled. A file is a licence file if its name says so or if most of its words are in units that
match. Files without a licence of their own take that of the nearest ancestor directory with a
licence file, by joins on directory paths.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

_PERMISSION = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions:"
)
_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."
_APACHE_REST = (
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License."
)
_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
    "or (at your option) any later version."
)
_GPL_REST = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
    "See the GNU General Public License for more details."
)
_GPL_COPY = "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
# Templates by licence: titles, notices, header paragraphs, whole texts (fixed values: the licences' own words).
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", _APACHE, _APACHE_REST, f"{_APACHE} You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 {_APACHE_REST}", "Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["Released under the MIT License.", "This project is licensed under the MIT License.", "MIT License", "The MIT License (MIT)", _PERMISSION, f"{_PERMISSION} {_NOTICE} {_AS_IS}", f"MIT License Copyright (c) {_PERMISSION} {_NOTICE} {_AS_IS}", "SPDX-License-Identifier: MIT"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "GNU General Public License Version 3, 29 June 2007", _GPL, f"{_GPL} {_GPL_REST} {_GPL_COPY}", "SPDX-License-Identifier: GPL-3.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "BSD-3-Clause": [_BSD, _BSD_NAMES, f"{_BSD} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_NAMES} {_BSD_AS_IS}", "BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"],
    "BSD-2-Clause": [f"{_BSD} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_AS_IS}", "BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", _MPL, "Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0"],
}
COSINE = 0.75
#: A unit is compared only if it holds one of these (fixed values); each template holds one.
MARKS = ("licen", "permission", "redistribut", "warrant", "endorse")
#: Words of ASCII letters and digits, with dots inside numbers kept.
WORD = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"
LINE = r"\r\n|\n|\r"
#: Between blocks: line ends around at least one line without a word.
GAP = r"(?:\r\n|\n|\r)(?:[^A-Za-z0-9\r\n]*(?:\r\n|\n|\r))+"
#: Between sentences: white space after a stop, which stays with the sentence as a line feed does not.
STOP = r"[.;:!?][\"')\]]*[ \t\r\n]+"
LICENCE_NAME = r"(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$"
SALTS = 16


def template_words(text: str) -> Counter:
    return Counter(re.findall(WORD, text.lower()))


class Weights:
    """Weights of terms, and unit vectors of templates, from how many of n files hold each term."""

    def __init__(self, templates: dict[str, list[str]], n: int, df: dict[str, int]) -> None:
        lines = [(k, template_words(t)) for k, ts in templates.items() for t in ts]
        terms = sorted({w for _, c in lines for w in c})
        self.idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in terms}
        self.outside = sum(self.idf.values()) / max(1, len(self.idf))
        self.vectors: list[tuple[str, dict[str, float]]] = []
        for name, counts in lines:
            v = {w: c * self.idf[w] for w, c in counts.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            self.vectors.append((name, {w: x / norm for w, x in v.items()}))

    def postings(self) -> dict[str, list[dict]]:
        """Of each term: its weight in each template (k) that holds it."""
        out: dict[str, list[dict]] = {w: [] for w in self.idf}
        for k, (_, v) in enumerate(self.vectors):
            for w, x in v.items():
                out[w].append({"k": k, "x": x})
        return out


def _with(value: Column, f) -> Column:
    """f(value), where ``value`` is computed once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _constant(value, kind: str) -> Column:
    """A literal of any type, folded when the plan is made."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _marked(low: Column) -> Column:
    return reduce(lambda x, y: x | y, [F.contains(low, F.lit(m)) for m in MARKS])


def _terms(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit(f"({WORD})"), 1)


def term_files(files: DataFrame, text_col: str, terms: list[str]) -> tuple[int, dict[str, int]]:
    """How many files there are, and how many hold each of these terms (bounded, so collected)."""
    held = F.array_intersect(_constant(terms, "array<string>"), _terms(F.lower(F.coalesce(F.col(text_col), F.lit("")))))
    got = files.select(F.explode_outer(held).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return files.count(), {r["w"]: r["n"] for r in got.collect() if r["w"] is not None}


def _matches(text: Column, w: Weights, cosine: float) -> Column:
    """An array of (kind, words, cosine, licence) of the units of a text that match a template."""
    idf = _constant(w.idf, "map<string,double>")
    postings = _constant(w.postings(), "map<string,array<struct<k:int,x:double>>>")
    names = _constant([n for n, _ in w.vectors], "array<string>")

    def near(terms: Column) -> Column:
        """Templates whose part on the unit's terms, which bounds the cosine, is long enough."""
        hits = F.flatten(F.transform(F.array_distinct(F.filter(terms, lambda t: F.map_contains_key(postings, t))), lambda t: F.element_at(postings, t)))
        return _with(hits, lambda h: F.filter(F.array_distinct(F.transform(h, lambda p: p["k"])), lambda k: F.aggregate(h, F.lit(1e-9), lambda acc, p: acc + F.when(p["k"] == k, p["x"] * p["x"]).otherwise(F.lit(0.0))) >= cosine**2))

    def weighed(terms: Column) -> Column:
        """(term, weight) of each distinct term."""

        def runs(s: Column) -> Column:
            first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
            return _with(first, lambda a: F.zip_with(a, F.concat(F.slice(a, F.lit(2), F.size(a)), F.array(F.size(s))), lambda i, j: F.struct(F.get(s, i).alias("t"), ((j - i) * F.coalesce(F.element_at(idf, F.get(s, i)), F.lit(w.outside))).alias("w"))))

        return _with(F.sort_array(terms), runs)

    def best(vector: Column, ks: Column) -> Column:
        norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, r: acc + r["w"] * r["w"]))
        held = F.flatten(F.transform(F.filter(vector, lambda r: F.map_contains_key(postings, r["t"])), lambda r: F.transform(F.element_at(postings, r["t"]), lambda p: F.struct(p["k"].alias("k"), (p["x"] * r["w"]).alias("y")))))
        dot = lambda h, k: F.aggregate(h, F.lit(0.0), lambda acc, p: acc + F.when(p["k"] == k, p["y"]).otherwise(F.lit(0.0)))
        return _with(norm, lambda n: _with(held, lambda h: F.array_min(F.transform(ks, lambda k: F.struct((-F.round(dot(h, k) / n, 9)).alias("c"), F.get(names, k).alias("licence"))))))

    def scored(kind: int, units: Column) -> Column:
        """Of the units of one kind."""
        said = F.transform(F.filter(F.transform(units, lambda u: F.lower(u)), _marked), _terms)
        kept = F.filter(F.transform(said, lambda t: F.struct(t.alias("t"), near(t).alias("ks"))), lambda u: F.size(u["ks"]) > 0)
        one = lambda u: F.struct(F.lit(kind).alias("kind"), F.size(u["t"]).cast("long").alias("words"), _with(weighed(u["t"]), lambda v: best(v, u["ks"])).alias("best"))
        return F.filter(F.transform(kept, one), lambda r: r["best"]["c"] <= -cosine)

    def found(t: Column) -> Column:
        # a text that is one block, a block that is one line, are one unit
        blocks = F.filter(F.split(t, GAP), lambda b: F.exists(F.array(F.lower(b)), _marked))
        several = F.filter(blocks, lambda b: b.rlike(LINE))
        lines = F.flatten(F.transform(several, lambda b: F.split(b, LINE)))
        sentences = F.flatten(F.transform(F.filter(blocks, lambda b: b.rlike(STOP)), lambda b: F.split(b, STOP)))
        whole = F.when(t.rlike(GAP), F.array(t)).otherwise(F.array().cast("array<string>"))
        return F.concat(scored(0, sentences), scored(1, lines), scored(2, blocks), scored(3, whole))

    marked = F.exists(F.array(F.lower(text)), _marked)
    none = F.array().cast("array<struct<kind:int,words:bigint,best:struct<c:double,licence:string>>>")
    return F.when(F.coalesce(marked, F.lit(False)), _with(text, found)).otherwise(none)


def licensed(files: DataFrame, *, path_col: str = "path", text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), templates: dict[str, list[str]] = TEMPLATES, cosine: float = COSINE, file_share: float = 0.5) -> DataFrame:
    """One row per row of ``files``: the columns in ``keep``, own (sorted licences of its units), n_units, best_cosine, licence_file, licences, inherited_from.

    Of several templates the one with the largest cosine counts, then the first licence by name;
    units of several kinds that match count each, but where the file as a whole matches, its
    licence is that one alone. ``licences`` are the file's own or, where it
    has none, those of the licence files of the nearest ancestor directory (``inherited_from``;
    null if none or own). A null path has no directory; null and empty texts have no units; several
    licence files of one directory count together. Rows are judged one by one, so rows that
    repeat a key, or have none, keep their own findings; very long texts are read whole. Columns
    not named are not read; an empty table gives no rows.
    """
    base = files.select(*keep, F.col(path_col).alias("_path"), F.col(text_col).alias("_text"))
    vocabulary = sorted({w for ts in templates.values() for t in ts for w in template_words(t)})
    n, df = term_files(base, "_text", vocabulary)
    w = Weights(templates, n, df)
    text = F.col("_text")
    name = F.element_at(F.split("_path", "/"), -1)
    directory = F.when(F.instr("_path", "/") > 0, F.regexp_replace("_path", "/[^/]*$", "")).otherwise("")
    # written once, without the texts: directories and findings are read three times below
    rows = base.select(
        *keep,
        F.when(F.col("_path").isNotNull(), directory).alias("_dir"),
        F.coalesce(name.rlike(LICENCE_NAME), F.lit(False)).alias("_named"),
        _matches(text, w, cosine).alias("_found"),
        F.when(F.exists(F.array(F.lower(F.coalesce(text, F.lit("")))), _marked), F.size(_terms(F.lower(text)))).otherwise(F.lit(0)).alias("_words"),
    )
    share = lambda k: F.aggregate(F.filter("_found", lambda r: r["kind"] == k), F.lit(0).cast("long"), lambda acc, r: acc + r["words"])
    whole = F.filter("_found", lambda r: r["kind"] == 3)
    own = F.array_sort(F.array_distinct(F.transform(F.when(F.size(whole) > 0, whole).otherwise(F.col("_found")), lambda r: r["best"]["licence"])))
    rows = rows.select(
        *keep,
        "_dir",
        own.alias("own"),
        F.size("_found").cast("long").alias("n_units"),
        F.coalesce(-F.array_min(F.transform("_found", lambda r: r["best"]["c"])), F.lit(0.0)).alias("best_cosine"),
        ((F.size("_found") > 0) & (F.col("_named") | (F.greatest(*(share(k) for k in range(4))) >= file_share * F.col("_words")))).alias("licence_file"),
    )
    rows = written(rows, "licences")
    at = rows.where(F.col("licence_file") & F.col("_dir").isNotNull()).select("_dir", F.explode("own").alias("l")).distinct().groupBy("_dir").agg(F.array_sort(F.collect_list("l")).alias("given"))
    # distinct directories meet those with licence files by each of their ancestors
    dirs = rows.where((F.size("own") == 0) & F.col("_dir").isNotNull()).select("_dir").distinct()
    parts = F.split("_dir", "/")
    ancestors = dirs.select("_dir", F.posexplode(F.when(F.col("_dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))))).alias("depth", "up"))
    nearest = ancestors.join(at.withColumnRenamed("_dir", "up"), "up").groupBy("_dir").agg(F.max_by(F.struct("up", "given"), F.col("depth")).alias("near"))
    # a directory may hold most files: its row is repeated, its files are dealt over the repeats
    nearest = nearest.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        rows.withColumn("_salt", F.pmod(F.xxhash64(*keep, "own"), F.lit(SALTS)).cast("int")).join(nearest, ["_dir", "_salt"], "left")
        .select(
            *keep,
            "own",
            "n_units",
            "best_cosine",
            "licence_file",
            F.when(F.size("own") > 0, F.col("own")).otherwise(F.coalesce("near.given", F.array().cast("array<string>"))).alias("licences"),
            F.when(F.size("own") == 0, F.col("near.up")).alias("inherited_from"),
        )
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, as files ``source/lang/doc_id``."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    return licensed(documents).select("doc_id", F.array_join("own", ",").alias("own"), "n_units", F.round("best_cosine", 6).alias("best_cosine"), "licence_file", F.array_join("licences", ",").alias("licences"), "inherited_from")


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    templates = ", ".join(f"({k}, {quoted(name)}, {quoted(t)})" for k, (name, t) in enumerate((name, t) for name, ts in TEMPLATES.items() for t in ts))
    marked = lambda c: "(" + " OR ".join(f"contains({c}, {quoted(m)})" for m in MARKS) + ")"
    word, line, gap, stop = map(quoted, (WORD, LINE, GAP, STOP))
    return f"""
WITH f AS (SELECT doc_id, coalesce(text, '') AS text, concat_ws('/', source, lang) AS dir FROM documents),
t AS (SELECT * FROM (VALUES {templates}) AS t(k, licence, text)),
tw AS (SELECT k, licence, w, count(*) AS tf FROM (SELECT k, licence, unnest(regexp_extract_all(lower(text), {word})) AS w FROM t) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents),
df AS (SELECT w, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), {word})) AS w FROM f) GROUP BY w),
idf AS (SELECT w, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS idf FROM (SELECT DISTINCT w FROM tw) LEFT JOIN df USING (w), n),
o AS (SELECT avg(idf) AS o FROM idf),
tv AS (SELECT k, licence, w, tf * idf / sqrt(sum(pow(tf * idf, 2)) OVER (PARTITION BY k)) AS x FROM tw JOIN idf USING (w)),
b AS (SELECT * FROM (SELECT doc_id, unnest(regexp_split_to_array(text, {gap})) AS u FROM f) WHERE {marked("lower(u)")}),
u AS (SELECT doc_id, 2 AS kind, u FROM b UNION ALL SELECT doc_id, 1, unnest(regexp_split_to_array(u, {line})) FROM b WHERE regexp_matches(u, {line})
      UNION ALL SELECT doc_id, 0, unnest(regexp_split_to_array(u, {stop})) FROM b WHERE regexp_matches(u, {stop}) UNION ALL SELECT doc_id, 3, text FROM f WHERE regexp_matches(text, {gap})),
m AS (SELECT row_number() OVER () AS id, doc_id, kind, lower(u) AS u FROM u WHERE {marked("lower(u)")}),
uw AS (SELECT id, w, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(u, {word})) AS w FROM m) GROUP BY ALL),
un AS (SELECT id, sum(tf) AS words, sqrt(sum(pow(tf * coalesce(idf, o), 2))) AS norm FROM uw LEFT JOIN idf USING (w), o GROUP BY id),
d AS (SELECT id, k, licence, round(sum(tf * idf * x) / any_value(norm), 9) AS c FROM uw JOIN tv USING (w) JOIN idf USING (w) JOIN un USING (id) GROUP BY ALL),
best AS (SELECT id, c, licence FROM d WHERE c >= {COSINE} QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, licence) = 1),
r AS (SELECT doc_id, kind, words, c, licence, bool_or(kind = 3) OVER (PARTITION BY doc_id) AS whole FROM best JOIN m USING (id) JOIN un USING (id)),
own AS (SELECT doc_id, list_sort(list(DISTINCT licence) FILTER (WHERE kind = 3 OR NOT whole)) AS own, count(*) AS n_units, max(c) AS best_cosine,
        greatest(sum(words) FILTER (WHERE kind = 0), sum(words) FILTER (WHERE kind = 1), sum(words) FILTER (WHERE kind = 2), sum(words) FILTER (WHERE kind = 3)) AS words FROM r GROUP BY doc_id),
a AS (SELECT f.doc_id, dir, own, coalesce(n_units, 0) AS n_units, round(coalesce(best_cosine, 0.0), 6) AS best_cosine, coalesce(words >= 0.5 * len(regexp_extract_all(lower(text), {word})), false) AS licence_file FROM f LEFT JOIN own USING (doc_id)),
lic AS (SELECT dir AS up, list_sort(list(DISTINCT l)) AS given FROM (SELECT dir, unnest(own) AS l FROM a WHERE licence_file) GROUP BY dir),
near AS (SELECT dir, up, given FROM (SELECT DISTINCT dir FROM a) JOIN lic ON up = '' OR dir = up OR starts_with(dir, up || '/') QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(up) DESC) = 1)
SELECT doc_id, coalesce(array_to_string(own, ','), '') AS own, n_units, best_cosine, licence_file, coalesce(array_to_string(coalesce(own, given), ','), '') AS licences, CASE WHEN own IS NULL THEN up END AS inherited_from
FROM a LEFT JOIN near USING (dir)
"""


SQL = _sql()
