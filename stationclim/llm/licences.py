"""License scans: canonical digest lookup.

A text is brought to a canonical form: lower case, copyright lines dropped,
equivalent spellings replaced, everything but letters and digits taken as one
blank.  The SHA-256 of the canonical form is hash-joined with the digests of
known licences.  The join is on the digest of an *entire* text, never on
parts of it; a licence that differs in one word is not found.

Three kinds of entire text are looked up: the whole document, every line of
it (a notice such as "Released under the MIT License." stands on a line of
its own), and every run of whole blocks between blank lines that is as long
as a known text (the header above some code).  The table of known texts is an
argument; ``KNOWN`` holds common notices and the licences in
``known_licences/``, as wrapped there and with one line a paragraph.

Spark expressions; Arrow for the runs of blocks and the lookup inside a row.
The table of digests is broadcast after a check of its size; a line or run
whose canonical length is that of no known text is dropped before it is hashed.

Defined results: null and empty texts have an empty canonical form, which is
no licence; repeated rows are each answered; a line or run found twice counts
twice; a run of one line counts as a line, a run inside a longer known one or
in a document that is a known text as a whole does not count;
of several names for one canonical form the smallest is reported; an empty
table of known texts finds nothing; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.sizing import broadcast_if_small

# Equivalent spellings (as whole words), left form -> right form.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
    ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("favour", "favor"),
    ("non commercial", "noncommercial"), ("per cent", "percent"), ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"), ("http", "https"),
)

# Known texts.
_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_BODY = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""


def _forms(name: str, body: str, *titles: str) -> list[tuple[str, str]]:
    """A licence's text as wrapped and with one line a paragraph, numbered or with bullets, bare or under each title."""
    flat = "\n\n".join(" ".join(p.split()) for p in re.split(r"\n\s*\n", body))
    listed = [x for b in (body, flat) for x in (b, re.sub(r"(?m)^[ ]*\d\. ", "* ", b) if name.startswith("BSD") else b)]
    return [(name, (t + "\n\n" if t else "") + b) for b in dict.fromkeys(listed) for t in ("", *titles)]


_TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License",),
    "BSD-2-Clause": ("BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'),
    "Unlicense": ("The Unlicense",),
}
_TEXTS = [x for f in sorted((Path(__file__).parent / "known_licences").glob("*.txt"))
          for x in _forms(f.stem, f.read_text("utf-8"), *_TITLES.get(f.stem, ()))]
KNOWN = (
    *_TEXTS,
    *_forms("ISC", _ISC_BODY, *_TITLES["ISC"]),
    *_forms("Apache-2.0", _APACHE_NOTICE),
    ("MIT", _MIT_BODY),
    ("MIT", "MIT License\n\n" + _MIT_BODY),
    ("MIT", "The MIT License\n\n" + _MIT_BODY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC_BODY),
    ("ISC", "ISC License\n\n" + _ISC_BODY),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
)

SMALL_TABLE = 10_000  # known digests (64 characters each) that every executor holds

# A line that only names a copyright holder, or reserves all rights.
COPYRIGHT_LINE = r"(?m)^[ \t#*/;-]*(copyright|\(c\)|©)[^\n]*$|^[ \t#*/;-]*all rights reserved\.?[ \t]*$"


_ONE_WORD = tuple(x for x in SPELLINGS if " " not in x[0])
_PHRASES = tuple(x for x in SPELLINGS if " " in x[0])


def _spelled(c: Column, pairs) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(f" {old} "), F.lit(f" {new} "))
    return c


def canonical_lines(text: Column) -> Column:
    """Array of the lines' canonical forms, but for spellings of several words; null text is one empty line."""
    c = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    mentions = F.contains(c, F.lit("copyright")) | F.contains(c, F.lit("(c)")) | F.contains(c, F.lit("©")) | F.contains(
        c, F.lit("all rights reserved"))
    c = F.when(mentions, F.regexp_replace(c, COPYRIGHT_LINE, " ")).otherwise(c)
    c = F.replace(F.regexp_replace(c, r"[^\p{L}\p{N}\n]+", " "), F.lit("\n"), F.lit(" \n "))
    c = _spelled(F.concat(F.lit(" "), c, F.lit(" ")), _ONE_WORD)
    return F.transform(F.split(c, "\n"), lambda x: F.trim(x))


def _phrased(c: Column) -> Column:
    return F.trim(_spelled(F.concat(F.lit(" "), c, F.lit(" ")), _PHRASES))


def whole_form(lines: Column) -> Column:
    """The canonical form of the whole text, from its canonical lines."""
    return _phrased(F.array_join(F.filter(lines, lambda x: x != ""), " "))


def canonical(text: Column) -> Column:
    return whole_form(canonical_lines(text))


def known_texts(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(digest, canonical_length, license_id) of known (id, text) pairs."""
    rows = spark.createDataFrame(list(known), "id string, body string").withColumn("c", canonical(F.col("body")))
    return (rows.where(F.col("c") != "").groupBy(F.sha2("c", 256).alias("digest"))
            .agg(F.min("id").alias("license_id"), F.max(F.length("c")).alias("canonical_length")))


def _block_runs(text: str, lengths: list[int]) -> list[tuple[int, int, str]]:
    """(first block, last block, digest) of the runs of blocks of canonical lines that are as long as a known text.

    Neither the whole text nor a single line, which are looked up as such.
    """
    blocks = [b for b in re.split("\n\n+", text.strip("\n")) if b]
    forms = []
    for b in blocks:
        c = f" {b.replace(chr(10), ' ')} "
        for old, new in _PHRASES:
            c = c.replace(f" {old} ", f" {new} ")
        forms.append(c.strip(" "))
    joined = " ".join(forms)
    at, begin, end = 0, [], {}
    for i, c in enumerate(forms):
        begin.append(at)
        end[at + len(c)] = i
        at += len(c) + 1
    out = []
    for i, o in enumerate(begin):
        for n in lengths:
            if o + n > len(joined):
                break
            j = end.get(o + n)
            if j is not None and n < len(joined) and (i < j or "\n" in blocks[i]):
                out.append((i, j, hashlib.sha256(joined[o:o + n].encode("utf-8", "surrogatepass")).hexdigest()))
    return out


_RUN = pa.struct([("i", pa.int32()), ("j", pa.int32()), ("id", pa.string())])
_RUNS = T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("id", T.StringType())]))


def _with_runs(df: DataFrame, lengths: list[int]) -> DataFrame:
    """``df`` with the runs of its column ``blocks`` in that column's place; a run's ``id`` is its digest."""
    kept = [c for c in df.columns if c != "blocks"]

    def run(batches):
        for b in batches:
            runs = [[dict(zip("ij", x), id=x[2]) for x in _block_runs(t.as_py(), lengths)] for t in b.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(kept)], pa.array(runs, pa.list_(_RUN))], names=[*kept, "runs"])

    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("runs", _RUNS)])
    return df.select(*kept, "blocks").mapInArrow(run, schema)


def _looked_up(df: DataFrame, by_digest: dict[str, str]) -> DataFrame:
    """(doc_id, text_digest, f, runs): the licences of ``line_digests`` and of the runs of ``blocks`` that are known.

    ``by_digest`` has a checked number of entries and goes to every executor once.
    """
    lengths = sorted({n for n, _ in by_digest.values()})
    table = df.sparkSession.sparkContext.broadcast({d: name for d, (_, name) in by_digest.items()})

    def run(batches):
        names = table.value
        for b in batches:
            f = [[names[d] for d in ds.as_py() if d in names] for ds in b.column(2)]
            runs = [[{"i": i, "j": j, "id": names[d]} for i, j, d in _block_runs(t.as_py(), lengths) if d in names] for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(f, pa.list_(pa.string())), pa.array(runs, pa.list_(_RUN))],
                                             names=["doc_id", "text_digest", "f", "runs"])

    schema = T.StructType([df.schema["doc_id"], df.schema["text_digest"], T.StructField("f", T.ArrayType(T.StringType())),
                           T.StructField("runs", _RUNS)])
    return df.select("doc_id", "text_digest", "line_digests", "blocks").mapInArrow(run, schema)


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Per document: doc_id, text_digest, license_id (the whole text; null if unknown), n_notices, notice_ids.

    Lines and runs of blocks are looked up inside the row while the known
    digests are at most ``SMALL_TABLE`` (checked): they go to every executor as
    one table, so that no line is shuffled.  A larger table is joined line by
    line and run by run; only its distinct lengths reach the driver, which are
    no more than the longest known text has characters.
    """
    base = docs.select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    base = base.select("doc_id", "lines", F.array_join("lines", "\n").alias("blocks"),
                       F.sha2(whole_form(F.col("lines")), 256).alias("text_digest"))
    side, small = broadcast_if_small(known, SMALL_TABLE)
    whole = side.select(F.col("digest").alias("text_digest"), "license_id")
    if small:
        by_digest = {r.digest: (r.canonical_length, r.license_id) for r in known.collect()}
        lengths = sorted({n for n, _ in by_digest.values()})
        lines = F.filter(F.transform("lines", _phrased), lambda x: F.length(x).isin(lengths))
        digests = F.transform(lines, lambda x: F.sha2(x, 256))
        with_lines = _looked_up(base.withColumn("line_digests", digests), by_digest)
    else:
        rid = base.withColumn("rid", F.monotonically_increasing_id())
        lengths = known.select("canonical_length").distinct()
        lens = sorted(r[0] for r in lengths.collect())
        lines = rid.select("rid", F.explode("lines").alias("line")).select("rid", _phrased(F.col("line")).alias("c"))
        lines = lines.join(lengths, F.length("c") == F.col("canonical_length"), "left_semi")
        hit = (lines.select("rid", F.sha2("c", 256).alias("digest")).join(known, "digest")
               .groupBy("rid").agg(F.collect_list("license_id").alias("f")))
        runs = (_with_runs(rid.select("rid", "blocks"), lens).select("rid", F.explode("runs").alias("r"))
                .select("rid", "r.i", "r.j", F.col("r.id").alias("digest")).join(known, "digest")
                .groupBy("rid").agg(F.collect_list(F.struct("i", "j", F.col("license_id").alias("id"))).alias("runs")))
        with_lines = rid.drop("lines", "blocks").join(hit, "rid", "left").join(runs, "rid", "left").select(
            "doc_id", "text_digest", F.coalesce("f", F.array().cast("array<string>")).alias("f"), "runs")
    longest = F.filter("runs", lambda x: ~F.exists("runs", lambda y: (y["i"] <= x["i"]) & (y["j"] >= x["j"]) & (
        y["j"] - y["i"] > x["j"] - x["i"])))
    inside = F.when(F.col("license_id").isNull(), F.transform(longest, lambda x: x["id"]))
    out = with_lines.join(whole, "text_digest", "left").withColumn(
        "f", F.concat("f", F.coalesce(inside, F.array().cast("array<string>"))))
    return out.select(
        "doc_id", "text_digest", "license_id", F.size("f").cast("long").alias("n_notices"),
        F.concat_ws(",", F.array_sort(F.array_distinct("f"))).alias("notice_ids"))


def _sql_spelled(c: str, pairs) -> str:
    for old, new in pairs:
        c = f"replace({c}, ' {old} ', ' {new} ')"
    return c


def _sql_canonical(text: str, pairs=(*_ONE_WORD, *_PHRASES)) -> str:
    c = f"lower(coalesce({text}, ''))"
    c = f"regexp_replace({c}, '(?m)^[ \\t#*/;-]*(copyright|\\(c\\)|©)[^\\n]*$|^[ \\t#*/;-]*all rights reserved\\.?[ \\t]*$', ' ', 'g')"
    c = f"' ' || trim(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
    return f"trim({_sql_spelled(c, pairs)})"


def oracle() -> str:
    """DuckDB: the same canonical form; all lines, and all runs of blocks, are listed and joined with the known texts.

    A run is a block's begin and a block's end that stand as far apart as a known text is long.
    """
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in KNOWN)
    block = _sql_spelled("' ' || replace(b, chr(10), ' ') || ' '", _PHRASES)
    return f"""
with known as (select id, {_sql_canonical('body')} as c from (values {values}) v(id, body)),
k as (select sha256(c) as digest, min(id) as license_id, max(length(c)) as n from known where c <> '' group by 1),
sizes as (select distinct n from k),
d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
l as (select rid, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from d),
c as (select rid, {_sql_canonical('line')} as c from l),
h as (select rid, license_id as id from c join k on sha256(c.c) = k.digest where c.c <> ''),
t as (select rid, trim(string_agg({_sql_canonical('line', _ONE_WORD)}, chr(10) order by pos), chr(10)) as t from l group by rid),
bl as (select rid, list_filter(regexp_split_to_array(t, '\n\n+'), lambda x: x <> '') as blocks from t),
bf as (select rid, blocks, list_transform(blocks, lambda b: trim({block})) as forms from bl),
b as (select rid, unnest(blocks) as b, unnest(forms) as form, generate_subscripts(forms, 1) as i from bf),
place as (select rid, i, contains(b, chr(10)) as many, sum(length(form) + 1) over (partition by rid order by i) - 1 as fin, length(form) as len,
         sum(length(form) + 1) over (partition by rid) - 1 as total from b),
span as (select s.rid, s.i, e.i as j from place s cross join sizes join place e on e.rid = s.rid and e.fin = s.fin - s.len + sizes.n
         where sizes.n < s.total and (s.i < e.i or (s.i = e.i and s.many))),
r as (select span.rid, i, j, k.license_id as id from span join bf using (rid) join k on k.digest = sha256(array_to_string(forms[i:j], ' '))),
longest as (select rid, id from r where not exists (select 1 from r o where o.rid = r.rid and o.i <= r.i and o.j >= r.j and o.j - o.i > r.j - r.i)),
w as (select rid, doc_id, sha256({_sql_canonical('text')}) as text_digest, k.license_id from d left join k on k.digest = sha256({_sql_canonical('text')})),
f as (select * from h union all select rid, id from longest semi join (select rid from w where license_id is null) using (rid)),
g as (select rid, count(*) as n, string_agg(distinct id, ',' order by id) as ids from f group by rid)
select doc_id, text_digest, license_id, coalesce(g.n, 0) as n_notices, coalesce(g.ids, '') as notice_ids from w left join g using (rid)
"""
