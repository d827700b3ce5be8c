"""License scan: ordered signature rules behind a keyword prefilter.

A rule is a regular expression over the words of a text (lower-cased, one space apart). The rules are made of
licence names and statement forms, a form for each way in which texts state a licence. Each rule has a
keyword, a word that all its matches have: the rule runs only on texts with that word, looked for among the
words that the rule sees, and a text without any keyword is not kept. What the rules find overlaps: a detection is dropped if it lies within another one of
higher priority, or within a longer one of the same. The three base phrases are never dropped.

Positions come from splitting at the matches and summing words in a window over one rule of one text, so a
text with very many matches costs in proportion to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallmap.llm.common import lower_ascii, materialize

#: What words are apart by: a word is a run of digits, letters, or anything outside ASCII, before A-Z are lower-cased.
_NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label, keyword, name as a regular expression over words, SPDX identifier as one.
NAMES = (
    ("mit", "mit", "(?:the )?mit", "mit"),
    ("mit0", "mit", "(?:the )?mit (?:0|no attribution)", "mit 0"),
    ("apache", "apache", "(?:the )?apache", "apache(?: [12] [01])?"),
    ("apache2", "apache", "(?:the )?apache(?: software)?(?: license)?(?: version)? (?:2 0|2)", "apache 2 0"),
    ("gpl", "gpl", "(?:the )?(?:gnu )?gpl", "gpl [23] 0(?: only| or later)?"),
    ("gpl", "general", "(?:the )?(?:gnu )?general public", "gpl"),
    ("gpl2", "general", "(?:the )?(?:gnu )?general public license(?: as published by the free software foundation)? version 2", "gpl 2 0(?: only| or later)?"),
    ("gpl3", "general", "(?:the )?(?:gnu )?general public license(?: as published by the free software foundation)? version 3", "gpl 3 0(?: only| or later)?"),
    ("lgpl", "lgpl", "(?:the )?(?:gnu )?lgpl", "lgpl [23] [01](?: only| or later)?"),
    ("lgpl", "lesser", "(?:the )?(?:gnu )?lesser general public", "lgpl"),
    ("agpl", "agpl", "(?:the )?(?:gnu )?agpl", "agpl 3 0(?: only| or later)?"),
    ("agpl", "affero", "(?:the )?(?:gnu )?affero general public", "agpl"),
    ("fdl", "documentation", "(?:the )?gnu free documentation", "gfdl 1 [123]"),
    ("bsd", "bsd", "(?:the |a )?bsd", "bsd(?: source)?"),
    ("bsd2", "bsd", "(?:the |a )?(?:2|two|simplified)(?: clause)? bsd", "bsd 2 clause"),
    ("bsd3", "bsd", "(?:the |a )?(?:3|three|new|revised|modified)(?: clause)? bsd", "bsd 3 clause"),
    ("isc", "isc", "(?:the )?isc", "isc"),
    ("mpl", "mozilla", "(?:the )?mozilla public", "mpl"),
    ("mpl", "mpl", "(?:the )?mpl(?: [12] [01])?", "mpl [12] [01]"),
    ("epl", "eclipse", "(?:the )?eclipse public", "epl [12] 0"),
    ("cddl", "cddl", "(?:the )?cddl", "cddl 1 [01]"),
    ("cpl", "common", "(?:the )?common public", "cpl 1 0"),
    ("eupl", "eupl", "(?:the )?eupl", "eupl 1 [012]"),
    ("artistic", "artistic", "(?:the )?artistic", "artistic [12] 0"),
    ("zlib", "zlib", "(?:the )?zlib(?: libpng)?", "zlib"),
    ("boost", "boost", "(?:the )?boost software", "bsl 1 0"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "(?:the )?wtfpl", "wtfpl"),
    ("psf", "python", "(?:the )?python software foundation", "psf 2 0"),
    ("postgresql", "postgresql", "(?:the )?postgresql", "postgresql"),
    ("ofl", "ofl", "(?:the )?(?:sil )?ofl", "ofl 1 [01]"),
    ("ofl", "font", "(?:the )?(?:sil )?open font", "ofl"),
    ("odbl", "database", "(?:the )?open database", "odbl 1 0"),
    ("cc0", "cc0", "(?:the )?(?:creative commons )?cc0(?: 1 0)?", "cc0 1 0"),
    ("cc-by", "cc", "(?:a |the )?(?:creative commons )?cc by(?: [1-4] [05])?", "cc by [1-4] [05]"),
    ("cc-by-sa", "cc", "(?:a |the )?(?:creative commons )?cc by sa(?: [1-4] [05])?", "cc by sa [1-4] [05]"),
    ("cc-by-nd", "cc", "(?:a |the )?(?:creative commons )?cc by nd(?: [1-4] [05])?", "cc by nd [1-4] [05]"),
    ("cc-by-nc", "cc", "(?:a |the )?(?:creative commons )?cc by nc(?: [1-4] [05])?", "cc by nc [1-4] [05]"),
    ("cc-by-nc-sa", "cc", "(?:a |the )?(?:creative commons )?cc by nc sa(?: [1-4] [05])?", "cc by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "cc", "(?:a |the )?(?:creative commons )?cc by nc nd(?: [1-4] [05])?", "cc by nc nd [1-4] [05]"),
    ("cc-by", "commons", "(?:a |the )?creative commons attribution(?: [1-4] [05])?", "cc by"),
    ("cc-by-sa", "commons", "(?:a |the )?creative commons attribution share ?alike(?: [1-4] [05])?", "cc by sa"),
)

#: Form of a statement, priority, confidence. @ stands for a name, # for an SPDX identifier.
FORMS = (
    ("spdx license identifier #", 50, 1.0),
    ("licensed under (?:the terms (?:and conditions )?of )?@(?: license)?", 40, 0.98),
    ("(?:released|distributed|published|available|provided|made available) under (?:the terms (?:and conditions )?of )?@(?: license)?", 40, 0.95),
    ("(?:subject to|governed by|covered by) (?:the terms (?:and conditions )?of )?@(?: license)?", 35, 0.9),
    ("@ licensed", 30, 0.85),
    ("license(?:s)? (?:is |type |name )?@", 25, 0.8),
    ("@ license", 20, 0.75),
)

#: Statements without a name: label, keyword, pattern, priority, confidence.
NOTICES = (
    ("all-rights-reserved", "reserved", "all rights reserved", 15, 0.7),
    ("copyright", "copyright", "copyright (?:c |by )?(?:19|20)[0-9][0-9]", 10, 0.5),
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy", 45, 0.97),
    ("isc", "modify", "permission to use copy modify and or distribute this software for any purpose", 45, 0.97),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice", 45, 0.95),
    ("public-domain", "domain", "(?:in|into|to) the public domain", 15, 0.7),
    ("proprietary", "proprietary", "proprietary and confidential", 15, 0.7),
    ("cc-by", "commons", "creative commons attribution", 12, 0.6),
)


def rules() -> list[tuple]:
    """All rules: rule, label, keyword, pattern, priority, confidence, base."""
    made = [(label, phrase.split()[0], phrase, 100, 0.9, True) for phrase, label in BASE]
    for form, priority, confidence in FORMS:
        for label, keyword, name, spdx in NAMES:
            key = "spdx" if "#" in form else keyword
            made.append((label, key, form.replace("@", name).replace("#", spdx), priority, confidence, False))
    made += [(*x, False) for x in NOTICES]
    # A match begins after a space and ends before one, which it leaves to its neighbours.
    return [(i, label, key, f"(?<= )(?:{p})(?= )", priority, c, base) for i, (label, key, p, priority, c, base) in enumerate(made)]


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _keywords(line: Column) -> Column:
    """Those of the rules' keywords that are words of a line."""
    keys = F.array(*[F.lit(k) for k in sorted({r[2] for r in rules()})])
    return F.filter(keys, lambda k: F.contains(line, F.concat(F.lit(" "), k, F.lit(" "))))


def detections(texts: DataFrame) -> DataFrame:
    """texts (uid, line: words one space apart, with a space at either end) -> uid, rule, label, priority,
    confidence, base, start, stop: all matches of all rules, by words from 0, stop not included."""
    spark, known = texts.sparkSession, rules()
    as_row = "(%d,'%s','%s','%s',%d,%sD,%s)"
    values = ",".join(as_row % (i, label, key, p, priority, c, str(base).lower()) for i, label, key, p, priority, c, base in known)
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t(rule, label, keyword, pattern, priority, confidence, base)")
    hits = texts.select("uid", "line", F.explode(_keywords(F.col("line"))).alias("keyword")).join(F.broadcast(table), "keyword")
    hits = hits.withColumn("found", F.regexp_extract_all("line", F.col("pattern"), F.lit(0))).where(F.size("found") > 0)
    pieces = F.transform(F.split("line", F.col("pattern"), -1), _spaces)
    hits = hits.withColumn("words", F.transform(F.arrays_zip(pieces.alias("gap"), F.transform("found", _spaces).alias("own")), lambda x: x))
    rows = hits.select("uid", "rule", "label", "priority", "confidence", "base", F.posexplode("words").alias("nth", "w"))
    rows = rows.select("*", F.col("w.gap").alias("gap"), F.coalesce("w.own", F.lit(-1)).alias("own"))
    so_far = Window.partitionBy("uid", "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Each gap before a match ends with the space before its first word; the line begins with one.
    start = F.sum("gap").over(so_far) + F.coalesce(F.sum(F.greatest("own", F.lit(0))).over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - 1
    rows = rows.withColumn("start", start).where("own >= 0")
    return rows.select("uid", "rule", "label", "priority", "confidence", "base", "start", (F.col("start") + F.col("own") + 1).alias("stop"))


def resolved(found: DataFrame) -> DataFrame:
    """Without detections that lie within one of higher priority, or within a longer or earlier-ruled one of the
    same priority. Base detections all stay."""
    priorities = sorted({r[4] for r in rules()}, reverse=True)
    order = Window.partitionBy("uid").orderBy(F.col("start"), F.col("stop").desc(), F.col("priority").desc(), "rule").rowsBetween(Window.unboundedPreceding, -1)
    # An enclosing one starts earlier, or at the same place and is no shorter; of those, the farthest stop.
    far = {p: F.max(F.when(F.col("priority") >= p, F.col("stop"))).over(order) for p in priorities}
    # One that starts and stops alike but has lower priority may come first only if shorter: it can't enclose.
    inside = F.lit(False)
    for p, stop in far.items():
        inside = F.when(F.col("priority") == p, F.coalesce(stop >= F.col("stop"), F.lit(False))).otherwise(inside)
    return found.withColumn("inside", inside).where("base or not inside").drop("inside")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    detections (start, stop, label, confidence; in order of start).

    Very long texts are scanned whole. Null text: as an empty one. Without a detection: n_base 0, null first and last word, empty labels, score 0.
    score: the confidence of the surest detection that stays. Ties in place and priority go to the earlier
    rule. Repeated rows and null ids keep a row each. An empty table gives no rows. Other columns of docs are
    not looked at.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    line = F.concat(F.lit(" "), F.trim(F.regexp_replace(lower_ascii(text), _NOT_WORD, " ")), F.lit(" "))
    lines = docs.select(F.col(id_col).alias("doc_id"), line.alias("line"))
    words = F.when(F.col("line") == "  ", 0).otherwise(_spaces(F.col("line")) - 1).cast("long")
    slim = lines.select("doc_id", words.alias("n_words"), F.when(F.size(_keywords(F.col("line"))) > 0, F.col("line")).alias("line"))
    slim = materialize(slim.withColumn("uid", F.monotonically_increasing_id()), "license-texts")
    found = resolved(detections(slim.where("line is not null").select("uid", "line")))
    base = F.col("base")
    joined = lambda x: F.array_join(F.array_sort(F.collect_set(x)), ",")
    digest = found.groupBy("uid").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.max("confidence").alias("score"),
        F.array_sort(F.collect_list(F.struct("start", "stop", "label", "confidence"))).alias("detections"),
    )
    out = slim.select("uid", "doc_id", "n_words").join(digest, "uid", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "detections",
    )
