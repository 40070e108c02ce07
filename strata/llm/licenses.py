"""License scans: phrase places, and an exact set-similarity join of text blocks with license templates.

Words have A-Z lower-cased. A phrase's places are where its words stand consecutively in the whole text.

Templates go by size: those with at most twice the words of the shortest one are a class, and so on. For each class a
block is a window of 2L words, every L words, with L the class's longest template: so any L words in a row lie in one
block, whatever lines they are wrapped into. A template fits a block when the share of the template's distinct words
that the block has (containment) is at least `THRESHOLD`. A block's other words don't matter, so blocks are sets of the
class's words, ordered by their number of blocks in the corpus, rarest first. The join is exact and filtered by
 - length: a fitting block has at least o = ceil(THRESHOLD |T|) template words;
 - prefix: a fitting block has one of the first |T| - o + 1 words of the template, by which templates are looked up;
 - position: the look-up knows the word's place i in the template, and the block its place j, so both share at most
   1 + min(|T| - i - 1, |B| - j - 1) words from there on; a pair is counted only if that is enough. (Its first shared
   word is in the prefix, and later ones allow less, so any meeting that passes is the first one's.)
What passes is counted word by word. Templates are a configured list (its words are checked to be at most
`MAX_TEMPLATE_WORDS`), which goes out with the tasks; every document is joined inside its own row.

Null text counts as empty, and an empty text has no block. Repeated rows are scanned each by itself, very long texts
whole, other columns don't matter. A document's score is its best containment, 1 where a phrase stands.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import GAP, table, words

#: Phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Wording of license notices and of whole licenses, with their labels.
TEMPLATES = (
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("released under the mit license", "mit-notice"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit-text"),
    (
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details. You should have received a copy of the GNU General Public License along with this program. If not, see
        <https://www.gnu.org/licenses/>.""",
        "gpl-3.0-header",
    ),
    (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
        "apache-2.0-header",
    ),
    (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
        OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
        OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
        "isc",
    ),
    (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
        permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
        notice and this permission notice shall be included in all copies or substantial portions of the Software. THE
        SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "mit",
    ),
    (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY
        THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
        THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
        COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
        DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
        BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
        (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
        POSSIBILITY OF SUCH DAMAGE.""",
        "bsd-3-clause",
    ),
)
THRESHOLD, MAX_TEMPLATE_WORDS = 0.8, 10_000


def _places(docs: DataFrame, phrases) -> DataFrame:
    """Adds _places to a frame with _words."""
    wanted = [(p.split(), label) for p, label in phrases]
    first = sorted({p[0] for p, _ in wanted})
    docs = docs.withColumn("_begin", F.filter(F.sequence(F.lit(0), F.size("_words") - 1), lambda i: F.get("_words", i).isin(first)) if first else F.array().cast("array<int>"))
    docs = docs.withColumn("_begin", F.when(F.size("_words") > 0, F.col("_begin")).otherwise(F.array().cast("array<int>")))

    def of(phrase: list[str], label: str) -> Column:
        def fits(i: Column) -> Column:
            test = F.lit(True)
            for k, word in enumerate(phrase):
                test = test & F.coalesce(F.get("_words", i + k) == word, F.lit(False))
            return test

        return F.transform(F.filter("_begin", fits), lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))

    found = [of(p, label) for p, label in wanted]
    return docs.withColumn("_places", F.array_sort(F.concat(*found)) if found else F.array().cast("array<struct<at: int, label: string>>")).drop("_begin")


def _blocks(words_: Column, vocabulary: list[str], longest: int) -> Column:
    """Per block its distinct words of the vocabulary."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(words_) / longest) - 2, F.lit(0)).cast("int"))
    own = lambda k: F.array_distinct(F.filter(F.slice(words_, k * longest + 1, 2 * longest), lambda w: w.isin(vocabulary)))
    return F.transform(starts, own)


def split(text: str) -> list[str]:
    """A template's words, by the rule for documents."""
    return [w for w in re.split(GAP, text.translate({i: i + 32 for i in range(65, 91)})) if w]


@dataclass(frozen=True)
class Class:
    """Templates of about one size as (label, distinct words), their vocabulary and the longest one's number of words."""

    sets: list[tuple[str, list[str]]]
    vocabulary: list[str]
    longest: int


def classes(given) -> list[Class]:
    """Classes of templates, shortest first."""
    sized = sorted(((split(t), label) for t, label in given), key=lambda x: (len(x[0]), x[1]))
    out: list[list] = []
    for own, label in sized:
        if not out or len(own) > 2 * len(out[-1][0][0]):
            out.append([])
        out[-1].append((own, label))
    made = [Class([(label, sorted(set(own))) for own, label in some], sorted({w for own, _ in some for w in own}), len(some[-1][0])) for some in out]
    if (n := sum(len(c.vocabulary) for c in made)) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"{n} template words; at most {MAX_TEMPLATE_WORDS} are sent to all tasks")
    return made


def order(docs: DataFrame, groups: list[Class], text: str = "text") -> list[list[str]]:
    """Each class's words by the corpus's number of blocks, rarest first, ties by word."""
    split_ = docs.select(words(F.col(text).cast("string")).alias("w"))
    each = [F.transform(F.flatten(_blocks(F.col("w"), c.vocabulary, c.longest)), lambda w, k=k: F.struct(F.lit(k).alias("k"), w.alias("w"))) for k, c in enumerate(groups)]
    counted = split_.select(F.explode(F.concat(*each)).alias("x")).groupBy("x.k", "x.w").count()
    count = {(r.k, r.w): r["count"] for r in counted.collect()}  # as many rows as template words
    return [sorted(c.vocabulary, key=lambda w, k=k: (count.get((k, w), 0), w)) for k, c in enumerate(groups)]


def _ints(values: list[int]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<int>")


def _joined(blocks: Column, own: Class, ranked: list[str], threshold: float) -> Column:
    """KIND of the blocks that a template of the class fits."""
    rank = {w: i + 1 for i, w in enumerate(ranked)}
    sets = [(label, sorted(rank[w] for w in s), max(1, math.ceil(threshold * len(s) - 1e-9))) for label, s in own.sets]
    index: dict[int, list[tuple[int, int]]] = {}
    for t, (_, ranks, least) in enumerate(sets):
        for i, r in enumerate(ranks[: len(ranks) - least + 1]):
            index.setdefault(r, []).append((t, i))
    head, words_ = sorted(index), F.array(*map(F.lit, ranked))
    entry = lambda t, i: F.struct(F.lit(t + 1).alias("t"), F.lit(len(sets[t][1]) - i - 1).alias("left"), F.lit(sets[t][2]).alias("least"))
    lists, least = F.array(*(F.array(*(entry(*x) for x in index[r])) for r in head)), min(x[2] for x in sets)
    table_ = F.array(*(F.struct(F.lit(label).alias("label"), _ints(ranks).alias("t"), F.lit(o).alias("least")) for label, ranks, o in sets))

    def met(b: Column) -> Column:
        """Templates by the prefix words that a block (sorted ranks) has, as far as length and position allow."""
        found = F.filter(F.transform(b, lambda r, j: F.struct(r.alias("r"), j.alias("j"))), lambda x: x["r"].isin(head))
        may = lambda x: F.filter(F.element_at(lists, F.array_position(_ints(head), x["r"]).cast("int")), lambda e: (F.size(b) >= e["least"]) & (1 + F.least(e["left"], F.size(b) - x["j"] - 1) >= e["least"]))
        return F.array_distinct(F.flatten(F.transform(found, lambda x: F.transform(may(x), lambda e: e["t"]))))

    def of(x: Column) -> Column:
        pairs = F.transform(met(x["ranks"]), lambda t: F.element_at(table_, t))
        counted = F.transform(pairs, lambda t: F.struct(t["label"].alias("label"), t["least"].alias("least"), F.size(t["t"]).alias("n"), F.size(F.array_intersect(t["t"], x["ranks"])).alias("both")))
        good = F.filter(counted, lambda t: t["both"] >= t["least"])
        return F.transform(good, lambda t: F.struct(x["block"].alias("block"), t["label"].alias("label"), (t["both"] / t["n"]).alias("containment")))

    placed = F.transform(blocks, lambda b, k: F.struct((k * own.longest).alias("block"), b.alias("words")))
    long = F.filter(placed, lambda x: F.size(x["words"]) >= least)
    ranks = F.transform(long, lambda x: F.struct(x["block"].alias("block"), F.array_sort(F.transform(x["words"], lambda w: F.array_position(words_, w).cast("int"))).alias("ranks")))
    return F.flatten(F.transform(ranks, of))


KIND = "array<struct<block: int, label: string, containment: double>>"


def scan(docs: DataFrame, phrases=PHRASES, given=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, places array<struct<at, label>>, blocks array<struct<block, label, containment>> (a block is told by
    the number of words before it); one row per input row."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = _places(docs.select("doc_id", words(F.col("text")).alias("_words")), phrases)
    blocks, groups = F.array().cast(KIND), classes(given)
    if groups:
        parts = []
        for k, (own, ranked) in enumerate(zip(groups, order(docs, groups))):
            found = found.withColumn(f"_blocks{k}", _blocks(F.col("_words"), own.vocabulary, own.longest))
            parts.append(_joined(F.col(f"_blocks{k}"), own, ranked, threshold).cast(KIND))
        blocks = F.array_sort(F.concat(*parts))
    return found.select("doc_id", F.size("_words").cast("long").alias("n_words"), F.col("_places").alias("places"), blocks.alias("blocks"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    own, at = F.transform("blocks", lambda b: b["label"]), F.transform("places", lambda p: p["at"])
    base = F.transform("places", lambda p: p["label"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.greatest(F.when(F.size("places") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0))).alias("score"),
    )


_WORDS = "list_filter(regexp_split_to_array(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_CLASSES = classes(TEMPLATES)
ORACLE = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, doc_id, {_WORDS.format("text")} as w, text from d),
p(p, label) as (values {", ".join(f"({p.split()!r}, '{label}')" for p, label in PHRASES)}),
s as (select r, i, w, unnest(range(0, len(w))) as i0 from (select r, w, 0 as i from w where list_has_any(w, {sorted({p.split()[0] for p, _ in PHRASES})!r}))),
b as (select r, i0 as i, label from s, p where w[i0 + 1] = p[1] and w[i0 + 1 : i0 + len(p)] = p),
t(t, label, longest) as (values {", ".join(f"({own!r}, '{label}', {c.longest})" for c in _CLASSES for label, own in c.sets)}),
l as (select r, w, longest, unnest(range(0, greatest(cast(ceil(len(w) / longest) as bigint) - 1, 1))) as k from w, (select distinct longest from t)),
m as (select r, label, len(list_intersect(t, lw)) / len(t) as c from (select r, longest, list_distinct(w[k * longest + 1 : k * longest + 2 * longest]) as lw from l) join t using (longest) where len(list_intersect(t, lw)) >= ceil({THRESHOLD} * len(t) - 1e-9)),
bs as (select r, count(*) as n_base, min(i) as first_word, max(i) as last_word, string_agg(distinct label, ',' order by label) as base_labels from b group by r),
ls as (select r, string_agg(distinct label, ',' order by label) as labels from (select r, label from b union all select r, label from m) group by r),
ms as (select r, max(c) as c from m group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
  greatest(case when n_base > 0 then 1.0 else 0.0 end::double, coalesce(c, 0)::double) as score
from w left join bs using (r) left join ls using (r) left join ms using (r)
"""
