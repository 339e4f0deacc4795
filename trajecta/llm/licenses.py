"""License scans by diagonal voting.

All rolling word k-grams of a document are joined with the k-grams of the templates. Each hit votes for the diagonal
document position - template position. A diagonal with the votes of all k-grams of its template is a full place; in
long templates, diagonals next to each other (words inserted or left out) are merged and judged by the share of the
template's k-grams that they hold. Both are verified on the document's own words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajecta.llm.common import alnum_words, cut, gram_hashes, gram_texts, small

GRAM = 3
#: Neighbouring diagonals differ by at most so many words.
DRIFT = 4
#: Least share of a long template's k-grams in a span.
COVER = 0.6

# Fixed values: (label, phrase) of the base, whose words must stand consecutively.
PHRASES = [
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
    ("mit", "under the mit license"),
]
# Fixed values: (label, passage) of well-known license texts and notices.
TEMPLATES = [
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    # whole notices and clauses; names and years that licensees fill in lie between passages
    ("agpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("apache-2", "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form"),
    ("artistic-2", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-nd", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("mit", "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("wtfpl", "do what the fuck you want to public license terms and conditions for copying distribution and modification you just do what the fuck you want to"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
]


def template_table(spark: SparkSession, phrases: list, templates: list) -> DataFrame:
    """(template, label, base, words): the phrases and passages as word arrays."""
    rows = [(k, label, k < len(phrases), text.split()) for k, (label, text) in enumerate([*phrases, *templates])]
    return spark.createDataFrame(rows, "template int, label string, base boolean, words array<string>")


#: What tells texts apart: the id (0 if there is none), whether there is none, and a hash of the text.
KEY = ["id_", "none_", "text_"]


def keyed(docs: DataFrame, *more: Column | str) -> DataFrame:
    """KEY and more columns of the documents."""
    return docs.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("id_"), F.col("doc_id").isNull().alias("none_"), F.xxhash64("text").alias("text_"), *more)


def spans(docs: DataFrame, phrases: list | None = None, templates: list | None = None, gram: int = GRAM, drift: int = DRIFT, cover: float = COVER) -> DataFrame:
    """One row per verified place: KEY, doc_id, label, base, start and length in words, cover (share of the template held).

    A phrase of the base needs all its words in a row; a passage needs `cover` of its k-grams on merged diagonals.
    Phrases have `gram` words at least. Null and empty texts, and documents of fewer words than a k-gram, have no
    places. Texts are told apart by KEY: rows that repeat a doc_id with other texts have places of their own, rows that
    are equal share theirs, and rows without a doc_id are scanned like all others. Other columns are ignored.
    """
    spark = docs.sparkSession
    known = template_table(spark, PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)
    grams = known.select("template", "label", "base", "words", F.size("words").alias("n"), F.posexplode_outer(gram_hashes("words", gram)).alias("at", "h"))
    docs = keyed(docs.where(F.col("text").isNotNull()), "doc_id", "text")
    rolled = docs.select(*KEY, alnum_words(F.col("text")).alias("w")).select(*KEY, F.posexplode_outer(gram_hashes("w", gram)).alias("i", "h"))
    # the templates are constants of this module or of the caller, so their k-grams are few
    hits = rolled.join(F.broadcast(grams.select("template", "at", "h")), "h").select(*KEY, "template", "at", "i", (F.col("i") - F.col("at")).alias("diagonal"))
    # distinct places, since equal rows give each of them again
    votes = cut(hits.groupBy(*KEY, "template", "diagonal").agg(F.count_distinct("i").alias("votes"), F.min("i").alias("lo"), F.max("i").alias("hi")))

    facts = F.broadcast(known.select("template", "label", "base", "words", (F.size("words") - gram + 1).alias("n_grams"), F.size("words").alias("n")))
    full = votes.join(facts, "template").where("base AND votes = n_grams").select(*KEY, "template", F.col("diagonal").alias("start"), F.col("n").alias("length"))
    by_place = Window.partitionBy(*KEY, "template").orderBy("diagonal", "lo")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by_place) > drift) | (F.col("lo") - F.lag("hi").over(by_place) > F.col("n")), F.lit(True))
    runs = votes.join(facts.drop("words", "label"), "template").where("NOT base").withColumn("apart", apart).withColumn("run", F.sum(F.col("apart").cast("int")).over(by_place))
    merged = runs.groupBy(*KEY, "template", "run").agg(F.sum("votes").alias("votes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("n_grams").alias("n_grams"))
    merged = merged.where(F.col("votes") >= F.col("n_grams") * cover - 1e-9)
    likely = merged.select(*KEY, "template", F.col("lo").alias("start"), (F.col("hi") - F.col("lo") + gram).alias("length"))
    places = cut(full.unionByName(likely))

    marked = docs.join(small(places.select(*KEY).distinct()), KEY, "left_semi")
    # equal rows count once: a place would else be verified as often as its text is there
    texts = marked.groupBy(*KEY).agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text")).select(*KEY, "doc_id", alnum_words(F.col("text")).alias("w"))
    seen = places.join(texts, KEY).join(facts, "template").select(*KEY, "doc_id", "label", "base", "start", "length", "n", "words", F.expr("slice(w, start + 1, length)").alias("span"))
    share = F.size(F.array_intersect(gram_texts("span", gram), gram_texts("words", gram))) / F.size(F.array_distinct(gram_texts("words", gram)))
    judged = seen.withColumn("cover", F.when(F.col("base"), (F.col("span") == F.col("words")).cast("double")).otherwise(share))
    return judged.where(F.col("cover") >= F.when(F.col("base"), 1.0).otherwise(cover) - 1e-9).select(*KEY, "doc_id", "label", "base", "start", "length", "cover")


def summary(docs: DataFrame, **options) -> DataFrame:
    """One row per document: its words, base places and labels; documents without a place are kept with zeros."""
    found = spans(docs, **options)

    def labels(kept: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(kept, F.col("label")))), ",")

    base = F.col("base")
    per_doc = found.groupBy(*KEY).agg(F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"), labels(base).alias("base_labels"), labels(F.lit(True)).alias("labels"), F.max("cover").alias("score"))
    sizes = keyed(docs, "doc_id", F.size(alnum_words(F.col("text"))).cast("long").alias("n_words"))
    zero = {"n_base": 0, "base_labels": "", "labels": "", "score": 0.0}
    return sizes.join(per_doc, KEY, "left").fillna(zero).select("doc_id", "n_words", F.col("n_base").cast("long"), F.col("first_word").cast("long"), F.col("last_word").cast("long"), "base_labels", "labels", "score")
