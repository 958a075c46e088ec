"""License scan by ordered signature rules, in DataFrame operations only.

A text becomes lower-case words; a keyword prefilter passes texts that can hold a license at all. Around every
anchor word of a passing text a snippet of neighbouring words is cut, with the anchor marked by ``@``. Rules are
regular expressions over snippets; each names its anchor and one needed word, so few rules meet a snippet and a
match belongs to one anchor. Matches are intervals of words. An interval that lies inside another one of better
or equal priority (longer first among equals) is suppressed; the labels are those of the rest, and base phrases
are labelled always.

Defined cases: a null text has no words; a null doc_id is kept; repeated rows get equal results, one each; texts
of any length are scanned whole; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Word and separator classes over text in which A-Z still stand.
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
SEPARATOR = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words before and after an anchor that a rule can see.
BEFORE, AFTER = 14, 18

# Base phrases and their labels; the anchor is marked.
BASE = [
    ("mit", "under the mit @license", "mit"),
    ("apache-2", "apache @license version 2", "apache"),
    ("cc-by-nc", "@cc by nc", "nc"),
]

# Label, needed word, names as regular expressions over words.
NAMES = [
    ("mit", "mit", "mit"),
    ("mit-0", "mit", "mit (?:0|no attribution)"),
    ("apache-1.1", "apache", "apache (?:software )?(?:license )?(?:version |v)?1 1"),
    ("apache-2", "apache", "apache (?:software )?(?:license )?(?:version |v)?2(?: 0)?"),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("0bsd", "0bsd", "0bsd"),
    ("0bsd", "zero", "zero clause bsd"),
    ("bsd", "bsd", "bsd(?: style)?"),
    ("gpl-1", "1", "(?:gnu )?(?:gpl|general public license)(?: version| v)? 1(?: 0)?"),
    ("gpl-2", "2", "(?:gnu )?(?:gpl|general public license)(?: version| v)? 2(?: 0)?"),
    ("gpl-2", "gplv2", "(?:gnu )?gplv2"),
    ("gpl-3", "3", "(?:gnu )?(?:gpl|general public license)(?: version| v)? 3(?: 0)?"),
    ("gpl-3", "gplv3", "(?:gnu )?gplv3"),
    ("gpl", "gpl", "(?:gnu )?gpl"),
    ("gpl", "general", "gnu general public"),
    ("lgpl-2", "2", "(?:gnu )?(?:lgpl|(?:lesser|library) general public license)(?: version| v)? 2(?: 0)?"),
    ("lgpl-2.1", "2", "(?:gnu )?(?:lgpl|lesser general public license)(?: version| v)? 2 1"),
    ("lgpl-3", "3", "(?:gnu )?(?:lgpl|lesser general public license)(?: version| v)? 3(?: 0)?"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl"),
    ("lgpl", "lesser", "gnu lesser general public"),
    ("agpl-3", "3", "(?:gnu )?(?:agpl|affero general public license)(?: version| v)? 3(?: 0)?"),
    ("agpl", "agpl", "(?:gnu )?agpl"),
    ("agpl", "affero", "(?:gnu )?affero general public"),
    ("gfdl", "gfdl", "(?:gnu )?gfdl(?: 1 [123])?"),
    ("gfdl", "documentation", "gnu free documentation"),
    ("mpl-1.1", "1", "(?:mpl|mozilla public license)(?: version| v)? 1 1"),
    ("mpl-2", "2", "(?:mpl|mozilla public license)(?: version| v)? 2(?: 0)?"),
    ("mpl", "mozilla", "mozilla public"),
    ("epl-1", "1", "(?:epl|eclipse public license)(?: version| v)? 1(?: 0)?"),
    ("epl-2", "2", "(?:epl|eclipse public license)(?: version| v)? 2(?: 0)?"),
    ("cddl-1", "cddl", "cddl(?: 1 [01])?"),
    ("cddl-1", "development", "common development and distribution"),
    ("cpl-1", "common", "common public"),
    ("eupl", "european", "european union public"),
    ("eupl", "eupl", "eupl(?: 1 [012])?"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("libpng", "libpng", "libpng"),
    ("boost-1", "boost", "boost software"),
    ("boost-1", "bsl", "bsl 1 0"),
    ("artistic-1", "artistic", "artistic(?: license)? 1 0"),
    ("artistic-2", "artistic", "artistic(?: license)? 2 0"),
    ("artistic", "artistic", "(?:perl )?artistic"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("postgresql", "postgresql", "postgresql"),
    ("python-2", "python", "python(?: software foundation)?(?: 2 0)?"),
    ("psf", "psf", "psf(?: 2 0)?"),
    ("php-3", "php", "php(?: 3 0[01]?)?"),
    ("ruby", "ruby", "ruby"),
    ("openssl", "openssl", "openssl"),
    ("ofl-1", "font", "(?:sil )?open font"),
    ("ofl-1", "ofl", "(?:sil )?ofl(?: 1 [01])?"),
    ("odbl-1", "database", "open (?:data commons )?(?:open )?database"),
    ("odbl-1", "odbl", "odbl(?: 1 0)?"),
    ("odc-by-1", "odc", "odc by(?: 1 0)?"),
    ("pddl-1", "pddl", "pddl(?: 1 0)?"),
    ("ms-pl", "microsoft", "microsoft public"),
    ("ms-rl", "microsoft", "microsoft reciprocal"),
    ("cecill", "cecill", "cecill(?: [bc])?(?: 2 [01])?"),
    ("bsl-1.1", "business", "business source"),
    ("sspl-1", "sspl", "sspl(?: 1 0)?"),
    ("sspl-1", "server", "server side public"),
    ("elastic-2", "elastic", "elastic(?: 2 0)?"),
    ("openrail", "openrail", "(?:creativeml )?openrail(?: m)?"),
    ("llama-community", "community", "llama (?:[23] )?community"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa"),
    ("afl-3", "academic", "academic free"),
    ("osl-3", "osl", "osl 3 0"),
    ("upl-1", "universal", "universal permissive"),
    ("vim", "vim", "vim"),
    ("w3c", "w3c", "w3c(?: software)?"),
    ("x11", "x11", "x11"),
    ("ogl-uk", "government", "open government"),
    ("etalab", "ouverte", "licence ouverte(?: open)?"),
]
# Names in the wording of one family of content licenses, with its elements.
CONTENT = [
    ("cc-by", "by", "attribution"),
    ("cc-by-sa", "by sa", "attribution share ?alike"),
    ("cc-by-nc", "by nc", "attribution non ?commercial"),
    ("cc-by-nd", "by nd", "attribution no ?deriv(?:atives|s)"),
    ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:atives|s)"),
]
VERSION = "(?: (?:version |v)?[1-4] [05])?"
# Single signatures: label, priority, needed word, expression.
SINGLE = [
    ("gpl-3", 2, "general", "gnu general public @license(?: v| version)? 3"),
    ("gpl-2", 2, "general", "gnu general public @license(?: v| version)? 2"),
    ("gpl", 3, "general", "gnu general public @license"),
    ("lgpl", 3, "lesser", "gnu lesser general public @license"),
    ("mpl-2", 2, "mozilla", "mozilla public @license(?: v| version)? 2(?: 0)?"),
    ("mit", 1, "opensource", "opensource org @licenses mit"),
    ("bsd-3-clause", 1, "opensource", "opensource org @licenses bsd 3 clause"),
    ("apache-2", 1, "apache", "apache org @licenses license 2 0"),
    ("gpl", 1, "gnu", "gnu org @licenses (?:old licenses )?gpl(?: [123] 0)?"),
    ("lgpl", 1, "gnu", "gnu org @licenses (?:old licenses )?lgpl(?: [123] [01])?"),
    ("agpl", 1, "gnu", "gnu org @licenses agpl(?: 3 0)?"),
    ("cc0", 1, "publicdomain", "creativecommons org @publicdomain zero(?: 1 0)?"),
    ("cc0", 2, "cc0", "@cc0(?: 1 0)?"),
    ("cc0", 2, "0", "@cc 0(?: 1 0)?"),
    ("cc0", 2, "zero", "@cc zero"),
    ("public-domain", 3, "domain", "(?:in|into|to) the @public domain"),
    ("all-rights-reserved", 4, "reserved", "all @rights reserved"),
    ("proprietary", 3, "proprietary", "proprietary @license"),
    ("other", 5, "license", "this work is @licensed under"),
    ("other", 5, "license", "@licensed under"),
    ("other", 5, "license", "@license agreement"),
]
# Phrases of license bodies that name no license.
BODIES = [
    ("mit", 3, "charge", "@permission is hereby granted free of charge to any person obtaining a copy"),
    ("boost-1", 3, "charge", "@permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("isc", 3, "fee", "@permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee"),
    ("zlib", 3, "anyone", "@permission is granted to anyone to use this software for any purpose"),
    ("bsd", 3, "binary", "@redistribution and use in source and binary forms with or without modification"),
    ("bsd-3-clause", 3, "contributors", "nor the @names of its contributors may be used to endorse"),
    ("bsd-4-clause", 3, "advertising", "all @advertising materials mentioning features or use of this software"),
    ("unlicense", 3, "free", "this is free and @unencumbered software released into the public domain"),
]
# Words before an anchor that stands in too many texts to be a keyword alone.
UNDER = "(?:licensed|released|distributed|available|published|provided|covered|redistributed)"
# By anchor, what every rule of that anchor needs in a text; words stand apart by any separators.
KEYWORDS = {
    "license": "license", "licence": "licence", "licenses": "licenses", "licensed": "licensed", "under": f"{UNDER} under", "cc": "cc (?:by|0|zero)", "cc0": "cc0",
    "creative": "creative commons", "public": "public domain", "publicdomain": "publicdomain zero", "rights": "rights reserved",
    "permission": "permission (?:is hereby granted|is granted to anyone|to use copy)", "redistribution": "redistribution and use in source", "names": "names of its contributors",
    "advertising": "advertising materials mentioning", "unencumbered": "unencumbered software",
}
#: Confidence by priority; none without a match.
CONFIDENCE = {0: 0.9, 1: 1.0, 2: 0.95, 3: 0.85, 4: 0.6, 5: 0.3}


def signatures() -> list[tuple[str, int, str, str, str]]:
    """(label, priority, anchor, needed word, expression): names in every wording they occur in."""
    rules = [(label, 0, need, text) for label, text, need in BASE]
    for label, need, name in NAMES:
        rules += [
            (label, 1, need, f"spdx @license identifier {name}(?: only| or later)?"),
            (label, 2, need, f"{UNDER} @under (?:the )?(?:terms of )?(?:the )?{name}(?: license| licence)?"),
            (label, 3, need, f"{name} @license"),
            (label, 3, need, f"{name} @licence"),
            (label, 3, need, f"@license {name}"),
        ]
    for label, short, long in CONTENT:
        need = short.split()[-1]
        rules += [
            (label, 1, need, f"spdx @license identifier cc {short}{VERSION}"),
            (label, 1, need, f"creativecommons org @licenses {short}{VERSION}"),
            (label, 2, need, f"@cc {short}{VERSION}"),
            (label, 2, "attribution", f"@creative commons {long}{VERSION}"),
        ]
    rules += SINGLE + BODIES
    anchor = lambda text: text.split("@", 1)[1].split()[0].split("(")[0]
    return [(label, rank, anchor(text), need, f"(?<= ){text}(?= )") for label, rank, need, text in rules]


def prefilter() -> str:
    """An expression that every text with a match of any rule meets."""
    return "(?i)" + "|".join(KEYWORDS[a].replace(" ", SEPARATOR) for a in sorted({r[2] for r in signatures()}))


def rule_table(spark: SparkSession) -> DataFrame:
    """All signatures with their number, which breaks ties; its size is fixed by this module."""
    cells = [F.struct(F.lit(i).alias("rule"), *[F.lit(v).alias(c) for v, c in zip(r, ("label", "priority", "anchor", "need", "pattern"))]) for i, r in enumerate(signatures())]
    return spark.range(1).select(F.inline(F.array(*cells)))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def detections(docs: DataFrame) -> DataFrame:
    """``(doc_id, h, rule, label, priority, first, last)``: every match in texts that pass the prefilter.

    ``h`` is the hash of the text: with the id it names a row, so repeated rows share their matches.
    """
    anchors = sorted({r[2] for r in signatures()})
    gated = docs.filter(F.col("text").rlike(prefilter())).select("doc_id", F.xxhash64("text").alias("h"), F.filter(F.split(lower_ascii(F.col("text")), SEPARATOR), lambda x: x != "").alias("w"))
    places = F.filter(F.transform("w", lambda x, i: F.when(x.isin(anchors), i)), lambda i: i.isNotNull())
    def snippet(i: Column) -> Column:
        start = F.greatest(i - BEFORE, F.lit(0))
        return F.struct(
            i.alias("place"), start.alias("start"), F.get("w", i).alias("anchor"),
            F.concat(F.lit(" "), F.array_join(F.slice("w", start + 1, i - start), " "), F.when(i > start, F.lit(" ")).otherwise(F.lit("")), F.lit("@"),
                     F.array_join(F.slice("w", i + 1, F.lit(AFTER)), " "), F.lit(" ")).alias("snippet"),
        )
    cut = gated.select("doc_id", "h", F.explode(F.transform(places, snippet)).alias("s")).select("doc_id", "h", "s.*")
    met = cut.join(F.broadcast(rule_table(docs.sparkSession)), "anchor").filter(F.contains("snippet", F.col("need")))
    # The part before the match is taken whole: positions of expressions count UTF-16 units, those of left() code points.
    at = met.filter("snippet rlike pattern").withColumn("ahead", F.expr("regexp_extract(snippet, concat('(?s)^(.*?)', pattern), 1)"))
    blanks = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    first = F.col("start") + blanks(F.col("ahead")) - 1
    return at.withColumn("first", first.cast("long")).withColumn("last", (F.col("first") + blanks(F.regexp_substr("snippet", F.col("pattern")))).cast("long")).select(
        "doc_id", "h", "rule", "label", "priority", "first", "last").distinct()


def unsuppressed(found: DataFrame) -> DataFrame:
    """Matches that lie in no other match of better or equal priority; base phrases only among the rest stay as they are.

    In order of start (longer first, then priority and rule), an interval is inside an earlier one exactly if the
    largest end so far reaches its own end; that is tested per priority.
    """
    line = Window.partitionBy("doc_id", "h").orderBy("first", F.desc("last"), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.lit(False)
    for p in sorted(CONFIDENCE):
        reach = F.max(F.when(F.col("priority") == p, F.col("last"))).over(line)
        inside = inside | ((F.lit(p) <= F.col("priority")) & F.coalesce(reach >= F.col("last"), F.lit(False)))
    return found.withColumn("__in", inside).filter("not __in").drop("__in")


def license_scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` of every row."""
    base_rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    found = detections(base_rows)
    base = found.filter("priority = 0").groupBy("doc_id", "h").agg(
        F.count("*").alias("n_base"), F.min("first").alias("first_word"), F.max("first").alias("last_word"), F.array_sort(F.collect_set("label")).alias("base"))
    own = unsuppressed(found).groupBy("doc_id", "h").agg(
        F.collect_set("label").alias("own"), F.max(F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), F.col("priority"))).alias("score"))
    facts = base.select(F.col("doc_id").alias("d"), "h", "n_base", "first_word", "last_word", "base", F.lit(None).cast("array<string>").alias("own"), F.lit(None).cast("double").alias("score")).unionByName(
        own.select(F.col("doc_id").alias("d"), "h", F.lit(None).cast("long").alias("n_base"), F.lit(None).cast("long").alias("first_word"), F.lit(None).cast("long").alias("last_word"), F.lit(None).cast("array<string>").alias("base"), "own", "score"))
    facts = facts.groupBy("d", F.col("h").alias("g")).agg(*[F.max(c).alias(c) for c in ("n_base", "first_word", "last_word", "base", "own", "score")])
    rows = base_rows.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    joined = rows.join(facts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    listed = F.array_sort(F.array_union(F.coalesce("base", none), F.coalesce("own", none)))
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.array_join(F.coalesce("base", none), ",").alias("base_labels"), F.array_join(listed, ",").alias("labels"),
        F.greatest(F.coalesce("score", F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(CONFIDENCE[0])).otherwise(F.lit(0.0))).alias("score"),
    )
