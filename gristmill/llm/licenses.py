"""License scans by diagonal voting, with DataFrame functions only.

All rolling k-word grams of a text are hashed and joined to the places where the templates hold the same
gram. A hit at document word i and template word j votes for the diagonal i - j, if the words of the gram
are the template's too; diagonals a few words apart (insertions, deletions) are merged, and a merged span
counts if the words that its votes cover are a large enough part of the template.

The join is a broadcast one: the templates have as many grams as words. One more gram at the end of each
text meets a row of its own and carries what is known of the text, so texts without votes stay and the
texts are read once. What is shuffled is narrow: votes by text and template, then spans by text. All steps
on votes are windows and sums, so a text with very many costs a sort of them.

Nulls: a null text has no words; a null id stays null. Short texts have no grams. Repeated rows are rows of
their own, ties (equal scores) keep all labels. Very long texts are worked on as one row of words. An empty
table gives an empty result. Other columns are not looked at, whatever they are called.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ALNUM_WORD, LOWER, UPPER, quoted, table

GRAM = 4
#: Diagonals at most so far apart are one alignment.
MERGE = 4
#: Part of a template's words that a span must cover; a template of fewer words than SHORT must be covered whole.
COVER = 0.75
SHORT = 12

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
_WARRANTY = """
    the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
    merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for
    any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the
    software or the use or other dealings in the software
"""
_BSD = """
    redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are
    met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
    2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
    documentation and or other materials provided with the distribution
"""
_BSD_WARRANTY = """
    this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not
    limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright
    holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited
    to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of
    liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this
    software even if advised of the possibility of such damage
"""
#: Public license texts, the notices that name them, and their key sentences.
TEMPLATES = {
    "mit": [
        """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
        the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish
        distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to
        the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial
        portions of the software""" + _WARRANTY,
        """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
        the software to deal in the software without restriction""",
        "released under the mit license",
    ],
    "apache-2": [
        """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may
        obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing
        software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express
        or implied see the license for the specific language governing permissions and limitations under the license""",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    ],
    "bsd": [
        _BSD + """3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission""" + _BSD_WARRANTY,
        _BSD + _BSD_WARRANTY,
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    ],
    "gpl-3": [
        "licensed under the gnu general public license version 3",
        """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as
        published by the free software foundation either version 3 of the license or at your option any later version this program is
        distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or
        fitness for a particular purpose see the gnu general public license for more details""",
        """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as
        published by the free software foundation either version 3 of the license""",
    ],
    "gpl-2": [
        """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as
        published by the free software foundation either version 2 of the license or at your option any later version""",
    ],
    "lgpl": [
        "licensed under the gnu lesser general public license",
        """this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as
        published by the free software foundation""",
    ],
    "agpl-3": [
        """this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as
        published by the free software foundation either version 3 of the license""",
    ],
    "mpl-2": [
        """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with
        this file you can obtain one at http mozilla org mpl 2 0""",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
    ],
    "isc": [
        """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that
        the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims
        all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the
        author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data
        or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or
        performance of this software""",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    ],
    "zlib": [
        """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any
        damages arising from the use of this software permission is granted to anyone to use this software for any purpose including
        commercial applications and to alter it and redistribute it freely subject to the following restrictions""",
    ],
    "unlicense": [
        """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or
        distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any
        means""",
    ],
    "cc-by-nc": ["licensed under cc by nc 4 0"],
    "cc-by-sa": ["licensed under cc by sa 4 0"],
    "cc-by": ["licensed under a creative commons attribution 4 0 international license"],
}
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _fold(text: Column) -> Column:
    """A-Z in lower case. ``lower`` knows more letters, so it serves for ASCII texts alone."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(text.isNull(), "").when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def gram_rows(templates: dict[str, list[str]], gram: int) -> list[str]:
    """Rows of SQL values: template, label, length, at, words of every gram."""
    rows = []
    for label, texts in templates.items():
        for k, text in enumerate(texts):
            words = re.findall(ALNUM_WORD, text.lower())
            if len(words) < gram:
                raise ValueError(f"template of {label} is shorter than {gram} words")
            rows += [f"('{label}/{k}', '{label}', {len(words)}, {i}, '{' '.join(words[i : i + gram])}')" for i in range(len(words) - gram + 1)]
    return rows


def template_grams(spark: SparkSession, templates: dict[str, list[str]], gram: int) -> DataFrame:
    """th (hash), template, label, length, at, words of every gram, and a row of nulls but th = 0."""
    df = spark.sql(f"SELECT * FROM VALUES {', '.join([*gram_rows(templates, gram), '(NULL, NULL, NULL, NULL, NULL)'])} AS t(template, label, length, at, words)")
    parts = F.split("words", " ")
    return df.withColumn("th", F.when(F.col("words").isNull(), F.lit(0)).otherwise(F.xxhash64(*[F.get(parts, F.lit(k)) for k in range(gram)])))


def _phrase_places(words: Column, phrase: str, line: Column) -> Column:
    """Word numbers where a phrase starts; only texts that hold it look at each word."""
    want = phrase.split()
    fits = lambda i: F.reduce(
        F.array(*[F.get(words, i + k) == w for k, w in enumerate(want)]), F.lit(True), lambda a, b: a & b
    )
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - len(want), F.lit(0))), lambda i: F.coalesce(fits(i), F.lit(False)))
    return F.when(F.contains(line, F.lit(phrase)), places).otherwise(F.array().cast("array<int>"))


def votes_of(texts: DataFrame, grams: DataFrame, gram: int) -> DataFrame:
    """Votes (rid, template, label, length, d, j, i) of texts(rid, info, words), and a row with rid and info for each text."""
    words = F.col("words")
    rolled = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(F.col("words"), i + k) for k in range(1, gram)]))
    rows = texts.withColumn("hashes", rolled).select("rid", "info", "words", F.posexplode(F.concat("hashes", F.array(F.lit(0).cast("long")))).alias("i", "h"))
    t = grams.select(F.col("th"), "template", "label", "length", F.col("at").alias("j"), F.col("words").alias("want"))
    same = F.concat_ws(" ", *[F.get(F.col("words"), F.col("i") + k) for k in range(gram)]) == F.col("want")
    last = F.col("i") == F.size("words")
    rows = rows.join(F.broadcast(t), F.col("h") == F.col("th")).where(F.when(F.col("want").isNull(), last).otherwise(same & ~last))
    return rows.select(
        "rid", F.when(F.col("want").isNull(), F.col("info")).alias("info"), "template", "label", "length", (F.col("i") - F.col("j")).alias("d"), "j", "i"
    )


def spans_of(votes: DataFrame, gram: int, merge: int, cover: float) -> DataFrame:
    """rid, info (of one row a text) and span (of those large enough): votes by diagonal, neighbouring diagonals merged."""
    own = Window.partitionBy("rid", "template")
    by_diagonal = own.orderBy("d", "j")
    far = F.coalesce(F.col("d") - F.lag("d").over(by_diagonal) > merge, F.lit(False)).cast("long")
    votes = votes.withColumn("far", far)
    votes = votes.withColumn("part", F.sum("far").over(by_diagonal.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    places = Window.partitionBy("rid", "template", "part").orderBy("j")
    votes = votes.withColumn("gain", F.least(F.lit(gram), F.coalesce(F.col("j") - F.lag("j").over(places), F.lit(gram))))
    parts = votes.groupBy("rid", "template", "part").agg(
        F.first("info", ignorenulls=True).alias("info"), F.first("label").alias("label"), F.first("length").alias("length"),
        F.sum("gain").alias("covered"), F.min("i").alias("first_word"), (F.max("i") + gram - 1).alias("last_word"),
    )
    enough = F.col("covered") >= F.when(F.col("length") < SHORT, F.col("length")).otherwise(F.col("length") * cover)
    span = F.struct((F.col("covered") / F.col("length")).alias("score"), "label", "first_word", "last_word")
    return parts.select("rid", "info", F.when(enough, span).alias("span"))


def scan(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", templates: dict[str, list[str]] = TEMPLATES,
    phrases: dict[str, str] = PHRASES, gram: int = GRAM, merge: int = MERGE, cover: float = COVER,
) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels (comma-joined), score, spans."""
    rows = df.select(
        F.monotonically_increasing_id().alias("rid"), quoted(key).alias("k"), F.trim(F.regexp_replace(_fold(quoted(text)), _BETWEEN, " ")).alias("line")
    )
    rows = rows.withColumn("words", F.when(F.col("line") == "", F.array().cast("array<string>")).otherwise(F.split("line", " ")))
    rows = rows.withColumn("places", F.array(*[_phrase_places(F.col("words"), p, F.col("line")) for p in phrases]))
    every = F.flatten("places")
    labels = F.array_compact(F.array(*[F.when(F.size(F.get("places", F.lit(k))) > 0, F.lit(v)) for k, v in enumerate(phrases.values())]))
    info = F.struct(
        "k", F.size("words").cast("long").alias("n_words"), F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"), F.array_sort(F.array_distinct(labels)).alias("base"),
    )
    votes = votes_of(rows.select("rid", info.alias("info"), "words"), template_grams(df.sparkSession, templates, gram), gram)
    spans = spans_of(votes, gram, merge, cover)
    out = spans.groupBy("rid").agg(F.first("info", ignorenulls=True).alias("info"), F.array_sort(F.collect_list("span")).alias("spans"))
    found = F.array_sort(F.array_distinct(F.concat("info.base", F.transform("spans", lambda s: s["label"]))))
    score = F.when(F.size("info.base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)))
    return out.select(
        F.col("info.k").alias(key), "info.n_words", "info.n_base", "info.first_word", "info.last_word",
        F.array_join("info.base", ",").alias("base_labels"), F.array_join(found, ",").alias("labels"), score.cast("double").alias("score"), "spans",
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")


def brute_force(text: str | None, templates: dict[str, list[str]], phrases: dict[str, str], gram: int = GRAM, merge: int = MERGE, cover: float = COVER) -> tuple:
    """n_words, n_base, first_word, last_word, base labels, labels by plain loops; for tests."""
    words = re.findall(ALNUM_WORD, "".join(c.lower() if c in UPPER else c for c in text or ""))
    places, base = [], set()
    for phrase, label in phrases.items():
        want = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(want)] == want]
        places += at
        base |= {label} if at else set()
    labels = set(base)
    for label, texts in templates.items():
        for t in texts:
            own = re.findall(ALNUM_WORD, t.lower())
            votes = sorted((i - j, j) for i in range(len(words) - gram + 1) for j in range(len(own) - gram + 1) if words[i : i + gram] == own[j : j + gram])
            part: set = set()
            for k, (d, j) in enumerate(votes):
                if k and d - votes[k - 1][0] > merge:
                    part = set()
                part |= set(range(j, j + gram))
                if len(part) >= (len(own) if len(own) < SHORT else cover * len(own)):
                    labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels))


def _sql() -> str:
    """The query's rows by strings instead of hashes."""
    phrase = "list_filter(range(len(w)), lambda i: array_to_string(w[i + 1:i + {n}], ' ') = '{p}')"
    places = ", ".join(phrase.format(n=len(p.split()), p=p) for p in PHRASES)
    base = ", ".join(f"CASE WHEN len({phrase.format(n=len(p.split()), p=p)}) > 0 THEN '{v}' END" for p, v in PHRASES.items())
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM_WORD}') AS w FROM documents
), info AS (
  SELECT rid, doc_id, len(w)::BIGINT AS n_words, flatten([{places}]) AS spots, list_sort(list_distinct(list_filter([{base}], lambda x: x IS NOT NULL))) AS base FROM d
), grams AS (SELECT rid, i, array_to_string(w[i + 1:i + {GRAM}], ' ') AS g FROM d, LATERAL (SELECT unnest(range(len(w) - {GRAM - 1})) AS i)
), votes AS (
  SELECT rid, template, label, length, i, j, i - j AS d FROM grams JOIN (VALUES {", ".join(gram_rows(TEMPLATES, GRAM))}) AS t(template, label, length, j, g) USING (g)
), marked AS (
  SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY rid, template ORDER BY d, j) > {MERGE} THEN 1 ELSE 0 END AS far FROM votes
), parted AS (SELECT *, sum(far) OVER (PARTITION BY rid, template ORDER BY d, j ROWS UNBOUNDED PRECEDING) AS part FROM marked
), covered AS (
  SELECT rid, template, label, length, part, count(DISTINCT p) AS n FROM (SELECT *, unnest(range(j, j + {GRAM})) AS p FROM parted) GROUP BY ALL
), found AS (
  SELECT rid, list(DISTINCT label) AS labels, max(n / length) AS score FROM covered
  WHERE n >= CASE WHEN length < {SHORT} THEN length ELSE length * {COVER}::DOUBLE END GROUP BY rid
)
SELECT doc_id, n_words, len(spots)::BIGINT AS n_base, list_min(spots)::BIGINT AS first_word, list_max(spots)::BIGINT AS last_word, array_to_string(base, ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, coalesce(labels, [])))), ',') AS labels, CASE WHEN len(base) > 0 THEN 1 ELSE coalesce(score, 0) END::DOUBLE AS score
FROM info LEFT JOIN found USING (rid)
"""


OP7_SQL = _sql()
