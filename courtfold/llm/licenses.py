"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
#: A window has WINDOW shingles, so it overlaps the next by SHINGLE - 1 words and each shingle has one window.
WINDOW = 4
BROADCAST_KEYS = 5_000_000

_NO_WARRANTY_BSD = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
    "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
    "THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} General Public License as published by the Free Software Foundation, either version {1} "
    "of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} General Public License for more details."
)
#: Notices by which the licenses ask to be named, and public license texts or the passages by which they are applied.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "apache-2.0-passage": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "mit": "Released under the MIT License",
    "mit-opening": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction"
    ),
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
        "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-2-clause-text": _BSD + _NO_WARRANTY_BSD,
    "bsd-3-clause-text": (
        _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        + _NO_WARRANTY_BSD
    ),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-2.0-header": _GNU.format("", "2"),
    "gpl-3.0-header": _GNU.format("", "3"),
    "lgpl-3.0-header": _GNU.format("Lesser", "3"),
    "agpl-3.0-header": _GNU.format("Affero", "3"),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form "
        "or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
}


def bands_for(miss: float, window: int = WINDOW) -> int:
    """Bands of one row so that a window sharing one of its shingles with a template is missed with at most this probability."""
    return math.ceil(math.log(miss) / math.log(1 - 1 / window))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _shingle_hash(words: Column, at: Column) -> Column:
    return F.xxhash64(*[F.get(words, at + i) for i in range(SHINGLE)])


def _turns(bands: int) -> Column:
    """One rotation for each band, as rows: a single short expression then serves all of them."""
    return F.explode(F.array(*[F.lit(64 * i // bands) for i in range(bands)])).alias("turn")


def _band(shingle: str) -> Column:
    """Hash function of the row's band: a rotation of the 64-bit shingle hash, so other bits of it decide the order."""
    return F.expr(f"shiftleft({shingle}, turn) | shiftrightunsigned({shingle}, 64 - turn)")


def _shingles(words: Column) -> Column:
    """The shingles as strings, in order."""
    n = F.size(words) - (SHINGLE - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda p: F.array_join(F.slice(words, p, SHINGLE), " "))).otherwise(
        F.array().cast("array<string>")
    )


def license_scan(
    docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text",
    threshold: float = 0.8, miss: float = 0.001,
) -> DataFrame:
    """One row per document and template found: doc_id, template, containment, start_word, n_places.

    Words are runs of letters and digits in lower case. A template of n words matches where a span of n words holds
    at least `threshold` of its distinct five-word shingles; containment is that of the best span wherever it begins, start_word its first word
    (counted from 0, the first of equal spans), n_places how many runs of neighbouring beginnings reach the threshold, so copies without a word between count once.
    Each window of each whole text is hashed; `miss` bounds the probability that a window with one shingle of a template isn't retrieved. A retrieved window brings
    its neighbours' shingles, and longer matches have many windows. Null, empty and short texts have
    no matches. Rows of one id are one document, repeated rows too, and each of its texts is checked; a null id is an id. Other columns are ignored.
    """
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    bands = bands_for(miss)
    library = spark.createDataFrame(list(templates.items()), "template string, notice string").select(
        "template", _words(F.col("notice")).alias("t_words")
    ).filter(F.size("t_words") >= SHINGLE)
    keys = (
        library.select("template", "t_words", F.explode(F.sequence(F.lit(0), F.size("t_words") - SHINGLE)).alias("offset"))
        .select("template", _shingle_hash(F.col("t_words"), F.col("offset")).alias("h"))
        .select("template", "h", _turns(bands)).select("template", _band("h").alias("key")).distinct()
    )
    library = library.select("template", F.size("t_words").alias("n"), F.array_distinct(_shingles(F.col("t_words"))).alias("wanted")).select(
        "template", "n", F.size("wanted").alias("n_wanted"), F.explode("wanted").alias("shingle")
    )
    if sum(len(t) for t in templates.values()) * bands <= BROADCAST_KEYS:  # more characters than shingles
        keys, library = F.broadcast(keys), F.broadcast(library)
    windows = (
        docs.select(F.col(id_col).alias("doc_id"), F.md5(F.col(text_col).cast("string")).alias("copy"), _words(F.col(text_col).cast("string")).alias("words"))
        .filter(F.size("words") >= SHINGLE)
        .select("doc_id", "copy", "words", F.explode(F.sequence(F.lit(0), F.size("words") - SHINGLE, F.lit(WINDOW))).alias("at"))
    )
    hashed = windows.select(
        "doc_id", "copy", "words", "at",
        *[F.when(F.col("at") + i <= F.size("words") - SHINGLE, _shingle_hash(F.col("words"), F.col("at") + i)).alias(f"h{i}")  # null beyond the last, and least() passes over nulls
        for i in range(WINDOW)],
    )
    names = [f"h{i}" for i in range(WINDOW)]
    banded = hashed.select("doc_id", "copy", "words", "at", *names, _turns(bands)).select("doc_id", "copy", "words", "at", F.least(*map(_band, names)).alias("key"))
    begin = F.greatest(F.col("at") - WINDOW, F.lit(0))
    hits = banded.join(keys, "key").select(
        "doc_id", "copy", "template", begin.alias("begin"),
        F.array_join(F.slice("words", begin + 1, F.col("at") - begin + 2 * WINDOW + SHINGLE - 1), " ").alias("around"),
    ).distinct()
    found = hits.select("doc_id", "copy", "template", "begin", F.posexplode(_shingles(F.split("around", " "))).alias("i", "shingle")).join(
        library, ["template", "shingle"]
    )
    return _best_spans(found.select("doc_id", "copy", "template", "n", "n_wanted", "shingle", (F.col("begin") + F.col("i")).alias("place")), threshold)


def _best_spans(found: DataFrame, threshold: float) -> DataFrame:
    """The best spans of n words over the places at which a text (doc_id, copy) has shingles of a template.

    A span counts a shingle at its first place there, so a place adds one to the spans that begin after the shingle's place before and
    end behind this one. Running sums of where these ranges open and close are the numbers of different shingles of all spans.
    A window holds the places of one text, which came as one row.
    """
    text = ["doc_id", "copy", "template"]
    before = F.lag("place").over(Window.partitionBy(*text, "shingle").orderBy("place"))
    opens = F.greatest(F.col("place") - F.col("n") + SHINGLE, F.coalesce(before + 1, F.lit(0)), F.lit(0))
    steps = (
        found.repartition(*text).select(*text, "n_wanted", "place", opens.alias("opens")).filter("opens <= place")  # not a place that came twice
        .select(*text, "n_wanted", F.explode(F.array(
            F.struct(F.col("opens").alias("start"), F.lit(1).alias("step")), F.struct((F.col("place") + 1).alias("start"), F.lit(-1).alias("step"))
        )).alias("s")).select(*text, "n_wanted", "s.*")
    )
    along = Window.partitionBy(*text).orderBy("start")
    held = steps.select(*text, "start", (F.sum("step").over(along) / F.col("n_wanted")).alias("containment"))
    places = held.select(*text, "start", "containment", F.lag("containment", 1, 0.0).over(along).alias("last")).filter(F.col("containment") >= threshold)
    return (
        places.groupBy("doc_id", "template")
        .agg(F.max(F.struct("containment", (-F.col("start")).alias("minus_start"))).alias("best"), F.count_if(F.col("last") < threshold).alias("n_places"))
        .select("doc_id", "template", F.col("best.containment").alias("containment"), (-F.col("best.minus_start")).alias("start_word"), "n_places")
    )
