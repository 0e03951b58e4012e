"""License scans by ordered signature rules, in DataFrame functions only.

A text is put in normal form: A-Z in lower case, words of letters, digits and non-ASCII characters, each between two
spaces. A rule is a regular expression over that form with a keyword that must be in the text first, a label, a
priority and a weight. Only rules whose keyword is there are run. Where detections overlap, one inside another
interval goes, of equal intervals the lower priority goes, and then a detection that one of a higher priority overlaps
goes, whether that one is itself overlapped by a still higher one or not.

Defined results: null and empty texts have no words and no detections (score 0, empty labels); repeated rows each get a
row; ties of priority go to the label first in order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from setwise.llm.common import lookup, materialise, table, text_key, ascii_lower

#: Texts with a form that a task scans.
FORMS = 500
#: Base phrases and labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: ASCII characters that are no part of a word, before and after A-Z becomes lower case.
BREAK_RAW, BREAK = "\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F", "\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F"
#: Names of licences: label, keyword, pattern of the name over words, SPDX words.
NAMES = (
    ("mit", "mit", "mit", "mit"),
    ("x11", "x11", "x11", "x11"),
    ("isc", "isc", "isc", "isc"),
    ("apache-2.0", "apache", "apache (software )?license (version )?2( 0)?|apache 2( 0)?", "apache 2 0"),
    ("apache-1.1", "apache", "apache (software )?license (version )?1 1|apache 1 1", "apache 1 1"),
    ("bsd-2-clause", "bsd", "(simplified |freebsd |2 clause |two clause )bsd|bsd (2|two) clause", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(new |modified |revised |3 clause |three clause )bsd|bsd (3|three) clause", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", "(original |4 clause |four clause )bsd|bsd (4|four) clause", "bsd 4 clause"),
    ("0bsd", "bsd", "0bsd|zero clause bsd|bsd zero clause", "0bsd"),
    ("gpl-1.0", "gpl", "gplv1|gpl (version |v)?1( 0)?", "gpl 1 0"),
    ("gpl-2.0", "gpl", "gplv2|gpl (version |v)?2( 0)?", "gpl 2 0"),
    ("gpl-3.0", "gpl", "gplv3|gpl (version |v)?3( 0)?", "gpl 3 0"),
    ("gpl-2.0", "general public", "(gnu )?general public license (version |v)?2( 0)?", "gpl 2 0 only"),
    ("gpl-3.0", "general public", "(gnu )?general public license (version |v)?3( 0)?", "gpl 3 0 only"),
    ("gpl-2.0-or-later", "general public", "general public license (version |v)?2( 0)? or (any )?later", "gpl 2 0 or later"),
    ("gpl-3.0-or-later", "general public", "general public license (version |v)?3( 0)? or (any )?later", "gpl 3 0 or later"),
    ("lgpl-2.0", "lgpl", "lgplv2|lgpl (version |v)?2( 0)?", "lgpl 2 0"),
    ("lgpl-2.1", "lgpl", "lgplv2 1|lgpl (version |v)?2 1", "lgpl 2 1"),
    ("lgpl-3.0", "lgpl", "lgplv3|lgpl (version |v)?3( 0)?", "lgpl 3 0"),
    ("agpl-3.0", "agpl", "agplv3|agpl (version |v)?3( 0)?", "agpl 3 0"),
    ("mpl-1.1", "mpl", "mpl 1 1", "mpl 1 1"),
    ("mpl-2.0", "mpl", "mpl 2( 0)?", "mpl 2 0"),
    ("epl-1.0", "epl", "epl 1 0", "epl 1 0"),
    ("epl-2.0", "epl", "epl 2 0", "epl 2 0"),
    ("cddl-1.0", "cddl", "cddl( 1 0)?", "cddl 1 0"),
    ("eupl-1.2", "eupl", "eupl( 1 2)?", "eupl 1 2"),
    ("artistic-2.0", "artistic", "artistic license (version )?2( 0)?", "artistic 2 0"),
    ("bsl-1.0", "boost", "boost software license( (version )?1 0)?", "bsl 1 0"),
    ("zlib", "zlib", "zlib( libpng)?", "zlib"),
    ("unlicense", "unlicense", "(the )?unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl"),
    ("postgresql", "postgresql", "postgresql licen[cs]e", "postgresql"),
    ("python-2.0", "python", "python software foundation license|python license", "psf 2 0"),
    ("ofl-1.1", "font license", "(sil )?open font license( (version )?1 1)?", "ofl 1 1"),
    ("odbl-1.0", "odbl", "odbl( 1 0)?", "odbl 1 0"),
    ("pddl-1.0", "public domain", "public domain dedication and license", "pddl 1 0"),
    ("ms-pl", "microsoft", "microsoft public license", "ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal license", "ms rl"),
    ("vim", "vim license", "vim license", "vim"),
    ("ncsa", "ncsa", "(university of illinois )?ncsa( open source license)?", "ncsa"),
    ("afl-3.0", "academic", "academic free license( (version )?3 0)?", "afl 3 0"),
    ("osl-3.0", "open software", "open software license( (version )?3 0)?", "osl 3 0"),
    ("gfdl", "free documentation", "(gnu )?free documentation license( (version )?1 [1-3])?", "gfdl 1 3"),
    ("elastic-2.0", "elastic", "elastic license( 2 0)?", "elastic 2 0"),
    ("sspl-1.0", "server side", "server side public license( (version )?1)?", "sspl 1 0"),
    ("busl-1.1", "business source", "business source license( 1 1)?", "busl 1 1"),
    ("lgpl-2.1", "lesser", "(gnu )?lesser general public license (version |v)?2 1", "lgpl 2 1 only"),
    ("lgpl-3.0", "lesser", "(gnu )?lesser general public license (version |v)?3( 0)?", "lgpl 3 0 only"),
    ("agpl-3.0", "affero", "(gnu )?affero general public license (version |v)?3( 0)?", "agpl 3 0 only"),
    ("mpl-1.1", "mozilla", "mozilla public license (version )?1 1", "mpl 1 1 only"),
    ("mpl-2.0", "mozilla", "mozilla public license (version )?2( 0)?", "mpl 2 0 only"),
    ("epl-1.0", "eclipse", "eclipse public license (version )?1( 0)?", "epl 1 0 only"),
    ("epl-2.0", "eclipse", "eclipse public license (version )?2( 0)?", "epl 2 0 only"),
    ("eupl-1.2", "european union", "european union public licen[cs]e( (version )?1 2)?", "eupl 1 2 only"),
    ("odbl-1.0", "database", "open (data commons open )?database license", "odbl 1 0 only"),
    ("cecill", "cecill", "cecill( [bc])?( (version )?2 [01])?", "cecill 2 1"),
)
#: Sentences that name no licence, or are its own words: label, keyword, pattern, priority, weight.
PHRASES = (
    ("reserved", "rights reserved", "all rights( are)? reserved", 2, 0.8),
    ("reserved", "rights reserved", "some rights( are)? reserved", 2, 0.5),
    ("copyright", "copyright", "copyright( c)? (19|20)[0-9]{2}( (19|20)[0-9]{2})?", 1, 0.4),
    ("copyright", "copyright", "copyright( c)? by", 1, 0.3),
    ("proprietary", "proprietary", "proprietary and confidential", 2, 0.9),
    ("proprietary", "permission", "without( the)?( express| prior)?( written)? permission", 1, 0.6),
    ("proprietary", "reproduc", "may not be (copied|reproduced|distributed)", 1, 0.6),
    ("public-domain", "public domain", "(in|into|to) the public domain", 2, 0.8),
    ("public-domain", "public domain", "public domain dedication", 2, 0.8),
    ("cc0-1.0", "cc0", "cc0( 1 0)?( universal)?", 3, 0.95),
    ("gpl", "general public license", "(gnu )?general public license", 1, 0.7),
    ("lgpl", "lesser general", "(gnu )?lesser general public license", 2, 0.8),
    ("agpl", "affero", "(gnu )?affero general public license", 2, 0.8),
    ("mit", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy", 4, 1.0),
    ("isc", "hereby granted", "permission to use copy modify and( or)? distribute this software for any purpose", 4, 1.0),
    ("bsd", "redistribution", "redistribution and use in source and binary forms", 4, 0.95),
    ("bsd-3-clause", "endorse", "be used to endorse or promote products derived from this software", 4, 0.95),
    ("gpl", "redistribute it", "you can redistribute it and or modify it under the terms of the gnu", 4, 1.0),
    ("no-warranty", "warranty", "without warranty of any kind", 1, 0.5),
    ("no-warranty", "warranties", "without warranties or conditions of any kind", 1, 0.5),
    ("spdx", "spdx", "spdx license identifier", 1, 0.6),
    ("unlicense", "unencumbered", "free and unencumbered software released into the public domain", 4, 1.0),
    ("zlib", "express or implied", "this software is provided as is without any express or implied warranty", 4, 0.95),
    ("permission", "permission", "(used|reprinted|reproduced) (with|by) permission", 1, 0.5),
    ("fair-use", "fair use", "fair use", 1, 0.3),
    ("fair-use", "fair dealing", "fair dealing", 1, 0.3),
    ("apache-2.0", "licensed under the apache", "licensed under the apache license version 2 0 the license", 4, 1.0),
    ("apache-2.0", "apache org", "apache org licenses license 2 0", 4, 0.95),
    ("apache-1.1", "apache software foundation", "this product includes software developed by the apache software foundation", 4, 0.9),
    ("gpl-2.0-or-later", "version 2 of the license", "either version 2 of the license or at your option any later version", 4, 1.0),
    ("gpl-3.0-or-later", "version 3 of the license", "either version 3 of the license or at your option any later version", 4, 1.0),
    ("gpl", "copy of the gnu general public", "you should have received a copy of the gnu general public license", 4, 0.95),
    ("lgpl", "copy of the gnu lesser", "you should have received a copy of the gnu lesser general public license", 4, 0.95),
    ("agpl", "copy of the gnu affero", "you should have received a copy of the gnu affero general public license", 4, 0.95),
    ("gpl", "gnu org licenses", "gnu org licenses( gpl)?( html)?", 2, 0.7),
    ("gfdl", "documentation license", "copy distribute and or modify this document under the terms of the gnu free documentation license", 4, 1.0),
    ("mpl-2.0", "mozilla org", "mozilla org mpl 2 0", 4, 0.95),
    ("mpl-2.0", "mozilla public", "this source code form is subject to the terms of the mozilla public license v 2 0", 4, 1.0),
    ("mpl-1.1", "mozilla public", "the contents of this file are subject to the mozilla public license version 1 1", 4, 1.0),
    ("epl-1.0", "eclipse public", "made available under the terms of the eclipse public license v1 0", 4, 1.0),
    ("epl-2.0", "eclipse public", "made available under the terms of the eclipse public license( v)? 2 0", 4, 1.0),
    ("cddl-1.0", "distribution license", "common development and distribution license( (version )?1 0)?", 3, 0.9),
    ("hpnd", "permission to use", "permission to use copy modify and distribute this software and its documentation for any purpose", 4, 0.9),
    ("bsd", "redistributions of source", "redistributions of source code must retain the above copyright notice", 4, 0.9),
    ("bsd", "redistributions in binary", "redistributions in binary form must reproduce the above copyright notice", 4, 0.9),
    ("bsd-4-clause", "use of this software", "all advertising materials mentioning features or use of this software must display", 4, 0.95),
    ("bsd", "any express or implied", "this software is provided by the (copyright holders and contributors|author|regents and contributors) as is and any express or implied warranties", 4, 0.9),
    ("unlicense", "unlicense org", "unlicense org", 3, 0.8),
    ("cc0-1.0", "creativecommons", "creativecommons org publicdomain zero 1 0", 4, 0.95),
    ("public-domain", "creativecommons", "creativecommons org publicdomain mark 1 0", 4, 0.9),
    ("public-domain", "public domain", "dedicated to the public domain", 3, 0.9),
    ("public-domain", "public domain", "(is|are|was) (now )?in the public domain", 3, 0.85),
    ("proprietary", "proprietary", "proprietary (software|information|rights|notice)", 2, 0.7),
    ("proprietary", "prior written permission", "without( the)? prior written permission( of)?", 2, 0.7),
    ("proprietary", "may be reproduced", "no part of this (publication|book|document|work) may be reproduced", 3, 0.9),
    ("reserved", "all rights", "all rights (remain|are hereby|not expressly granted are) reserved", 2, 0.8),
    ("copyright", "copyright holder", "copyright holders?", 1, 0.4),
    ("copyright", "copyright notice", "copyright notice", 1, 0.4),
    ("no-warranty", "warranty", "without any warranty", 1, 0.5),
    ("no-warranty", "warranties", "makes? no (representations or )?warranties", 2, 0.5),
    ("no-warranty", "implied warrant", "implied warrant(y|ies) of merchantability", 2, 0.6),
    ("eula", "license agreement", "end user license agreement", 3, 0.8),
    ("eula", "software license", "software license agreement", 2, 0.7),
    ("non-commercial", "licensed for", "licensed for (personal|non commercial|academic|educational|internal)( and (personal|non commercial|academic|educational))? use", 3, 0.8),
    ("dual", "dual licensed", "dual licensed", 2, 0.6),
    ("odc-by-1.0", "attribution license", "open data commons attribution license( 1 0)?", 3, 0.9),
    ("cdla", "data license agreement", "community data license agreement (permissive|sharing)( (version )?[12] 0)?", 3, 0.9),
    ("openrail", "rail license", "open ?rail license", 3, 0.9),
    ("llama", "community license", "llama [0-9]( [0-9])? community license( agreement)?", 3, 0.9),
    ("ogl-uk-3.0", "government licence", "open government licence( v3( 0)?| version 3( 0)?)?", 3, 0.9),
    ("w3c", "w3c software", "w3c software (notice and )?(and document )?license", 3, 0.9),
    ("qpl-1.0", "q public license", "q public license( (version )?1 0)?", 3, 0.9),
    ("ipl-1.0", "ibm public license", "ibm public license( (version )?1 0)?", 3, 0.9),
    ("cpl-1.0", "common public license", "common public license( (version )?1 0)?", 3, 0.9),
    ("spl-1.0", "sun public license", "sun public license( (version )?1 0)?", 3, 0.9),
    ("npl-1.1", "netscape public license", "netscape public license( (version )?1 [01])?", 3, 0.9),
    ("rpl-1.5", "reciprocal public license", "reciprocal public license( (version )?1 [15])?", 3, 0.9),
    ("apsl-2.0", "apple public", "apple public source license( (version )?[12] [0-2])?", 3, 0.9),
    ("php-3.01", "php license", "(the )?php license( (version )?3 01?)?", 3, 0.9),
    ("ruby", "ruby license", "(the )?ruby license", 3, 0.8),
    ("zpl-2.1", "zope public license", "zope public license( (version )?2 [01])?", 3, 0.9),
    ("openssl", "openssl license", "openssl license", 3, 0.9),
    ("curl", "curl license", "curl license", 2, 0.7),
    ("json", "json license", "json license", 2, 0.8),
    ("upl-1.0", "permissive license", "universal permissive license( (v|version )?1 0)?", 3, 0.9),
    ("mulanpsl-2.0", "permissive software license", "mulan permissive software license( v2)?", 3, 0.9),
    ("hippocratic", "hippocratic license", "hippocratic license( [1-3] [01])?", 3, 0.9),
    ("commons-clause", "clause license condition", "commons clause license condition", 3, 0.9),
)
#: One of these stands in every text that a rule or a base phrase can match: verbs of a grant, and parts of all other rules' keywords.
GRANTS = ("licensed", "released", "distributed", "published", "available", "provided", "covered")
GATE = (
    "licen", *GRANTS[1:], "rights", "copyright", "public", "permission", "spdx", "warrant", "proprietary", "reproduc", "unencumbered", "redistribut", "endorse",
    "creative", "cc", "fair", "apache", "bsd", "gpl", "mpl", "epl", "cddl", "eupl", "artistic", "boost", "zlib", "wtfpl", "postgresql", "python", "odbl",
    "cecill", "database", "microsoft", "ncsa", "academic", "software", "documentation", "elastic", "server", "business", "union", "lesser", "affero", "mozilla", "eclipse",
    "hereby", "implied",
)
CC_KINDS = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")
CC_LONG = {"by": "attribution", "sa": "share ?alike", "nd": "no ?derivat(ive)?s?( works)?", "nc": "non ?commercial"}


def rules() -> list[tuple[str, str, str, int, float]]:
    """label, keyword, pattern, priority, weight: each name alone (2), after a grant (3), as an SPDX tag (4) and as `X license` (3)."""
    out = []
    grant = f"({'|'.join(GRANTS)})( to you)? under (the )?(terms (and conditions )?of )?(the )?(an? )?"
    for label, keyword, name, spdx in NAMES:
        if len(name) > 4 or not name.isalnum():
            out.append((label, keyword, f"({name})", 2, 0.7))
        out.append((label, " under ", f"{grant}({name})( licen[cs]e)?", 3, 0.95))
        out.append((label, "licen", f"(the )?({name}) licen[cs]e", 3, 0.85))
        out.append((label, "spdx", f"spdx license identifier {spdx}", 4, 1.0))
    for kind in CC_KINDS:
        label, tail = "cc-" + kind.replace(" ", "-"), "( (license )?(version )?[1-4] [05])?( (international|unported))?"
        longer = " ".join(CC_LONG[x] for x in kind.split())
        out.append((label, f"cc {kind}", f"cc {kind}{tail}", 2, 0.9))
        out.append((label, "creative commons", f"creative commons {longer}{tail}( licen[cs]e)?", 3, 0.95))
        out.append((label, "creativecommons", f"creativecommons org licenses {kind}( [1-4] [05])?", 4, 0.95))
        out.append((label, " under ", f"{grant}cc {kind}{tail}", 3, 1.0))
    return out + list(PHRASES)


def _spaced(pattern: str) -> str:
    """A pattern over words, for the form in which each word stands between two spaces of its own."""
    return " " + pattern.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(  )?") + " "


def _normal(text: Column) -> Column:
    """' w1  w2 ' of the words of a text."""
    words = F.array_remove(F.split(ascii_lower(text), f"[{BREAK}]+"), "")
    return F.when(F.size(words) > 0, F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))).otherwise(F.lit(""))


def _words_in(part: Column) -> Column:
    """Words of a stretch of the normal form that begins and ends between words."""
    return ((F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))) / 2).cast("long")


def detections(texts: DataFrame, key: str = "key", form: str = "form") -> DataFrame:
    """key, label, weight, start, end (characters of the form) of what the rules find and suppression leaves, for distinct keys."""
    listed = rules()
    fields = [F.struct(F.lit(a).alias("label"), F.lit(b).alias("keyword"), F.lit(_spaced(c)).alias("pattern"), F.lit(d).alias("priority"), F.lit(float(e)).alias("weight"), F.lit(k).alias("rule")) for k, (a, b, c, d, e) in enumerate(listed)]
    plain = F.replace(F.col(form), F.lit("  "), F.lit(" "))
    # The rules of a keyword are tried only where it stands; each pattern is a literal, compiled once a task.
    tried = []
    for word in sorted({r[1] for r in listed}):
        own = [F.when(F.rlike(form, F.lit(_spaced(r[2]))), F.lit(k)) for k, r in enumerate(listed) if r[1] == word]
        tried.append(F.when(F.contains("plain", F.lit(word)), F.array_compact(F.array(*own))).otherwise(F.array().cast("array<int>")))
    gated = texts.withColumn("plain", plain).select(key, form, F.explode(F.flatten(F.array(*tried))).alias("rule"))
    hits = gated.select(key, form, F.element_at(F.array(*fields), F.col("rule") + 1).alias("r"))
    pieces = F.arrays_zip(F.split(F.col(form), F.col("r.pattern"), -1).alias("before"), F.regexp_extract_all(form, F.col("r.pattern"), F.lit(0)).alias("hit"))
    found = hits.select(key, "r", F.posexplode(pieces).alias("k", "piece"))
    sizes = found.select(key, "r", "k", F.length("piece.before").alias("skip"), F.length("piece.hit").alias("size"))
    so_far = W.partitionBy(key, "r.rule").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("skip") + F.coalesce("size", F.lit(0))).over(so_far), F.lit(0)) + F.col("skip")
    spans = sizes.withColumn("start", start).where("size is not null").select(key, "r.label", "r.priority", "r.weight", "start", (F.col("start") + F.col("size")).alias("end"))
    # Of those that begin at or before it, the furthest end tells whether an interval holds this one.
    order = [F.col("start"), F.desc("end"), F.desc("priority"), F.col("label"), F.desc("weight")]
    before = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(key).orderBy(*order).rowsBetween(1, W.unboundedFollowing)
    outer = spans.withColumn("reach", F.max("end").over(before)).where("reach is null or reach < end").drop("reach")
    stronger = [F.coalesce(F.max(F.when(F.col("priority") > p, F.col("end"))).over(before) > F.col("start"), F.lit(False)) | F.coalesce(F.min(F.when(F.col("priority") > p, F.col("start"))).over(after) < F.col("end"), F.lit(False)) for p in (1, 2, 3)]
    beaten = F.when(F.col("priority") == 1, stronger[0]).when(F.col("priority") == 2, stronger[1]).when(F.col("priority") == 3, stronger[2]).otherwise(F.lit(False))
    return outer.withColumn("beaten", beaten).where("not beaten").select(key, "label", "weight", "start", "end")


def gate_words() -> list[str]:
    """The parts of GATE that are needed: those that some rule's keyword holds, grants by their verbs, and the base phrases' words."""
    need = {r[1] for r in rules()} - {" under "}
    return [g for g in GATE if g in GRANTS or g in ("cc", "public", "rights") or any(g in k for k in need)]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).select("doc_id", "text", F.regexp_count("text", F.lit(f"[^{BREAK_RAW}]+")).cast("long").alias("n_words"), text_key(F.col("text")).alias("key"))
    low = F.lower("text")
    hit = functools.reduce(operator.or_, [F.contains(low, F.lit(w)) for w in gate_words()])
    forms = rows.select("doc_id", "key", "n_words", F.when(hit, _normal(F.col("text"))).otherwise(F.lit("")).alias("form"))
    forms = materialise(forms, "forms")  # whole texts are read once; few of them have a form
    n_base, heads, tails, base = F.lit(0), [], [], []
    for phrase, label in BASE:
        p = _spaced(phrase)
        n = ((F.length("form") - F.length(F.replace("form", F.lit(p), F.lit("")))) / len(p)).cast("long")
        n_base = n_base + n
        heads.append(F.when(F.contains("form", F.lit(p)), _words_in(F.substring_index("form", p, 1))))
        tails.append(F.when(F.contains("form", F.lit(p)), F.col("n_words") - _words_in(F.substring_index("form", p, -1)) - len(phrase.split())))
        base.append(F.when(F.contains("form", F.lit(p)), F.lit(label)))
    rows_out = forms.select("doc_id", "key", "n_words", n_base.cast("long").alias("n_base"), F.least(*heads).alias("first_word"), F.greatest(*tails).alias("last_word"), F.array_sort(F.array_compact(F.array(*base))).alias("base"))
    texts = forms.where("form <> ''")
    texts = texts.repartition(max(1, -(-texts.count() // FORMS)), "key").groupBy("key").agg(F.first("form").alias("form"))  # by rows, as they cost more than their bytes say
    found = detections(texts).groupBy("key").agg(F.collect_set("label").alias("found"), F.max("weight").alias("score"))
    rows_out = lookup(rows_out, materialise(found, "detections"), ["key"])
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce("score", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0))
    return rows_out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def op10(spark, sf_dir) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
