"""License scan by ordered signature rules, with DataFrame functions only.

A text becomes its words (ASCII letters and digits, and whatever is not ASCII) between single spaces. Every rule is a
regular expression over those, behind a keyword that its matches contain; a cheap test of the whole text for the few words
that any rule needs comes first, so most texts see no rule at all. Matches are marked in place, which gives their word
intervals in one pass. Of overlapping detections, one that lies inside another of higher priority, or inside a longer
one of the same priority, is suppressed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.common import load, text_of

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same for a text whose A-Z are still upper case.
RAW_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The phrases that the base counts, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: One of these is in every text that any rule can match.
ANCHORS = ("licen", "gpl", "commons", "reserved", "copyright", "public", "spdx", "warrant", "clause", "cc")

_LICENSE = "licen[sc]ed?"
_VERSION = "(?: version| v| ver)?"
#: label, names (regular expressions over words), versions as words. A name with a version and the word license is
#: specific; with the word license alone it names the family.
VERSIONED = (
    ("apache", "apache(?: software)?", "1 0;1 1;2 0;2"),
    ("mpl", "mozilla public|mpl", "1 0;1 1;2 0"),
    ("epl", "eclipse public|epl", "1 0;2 0"),
    ("cpl", "common public", "0 5;1 0"),
    ("eupl", "european union public|eupl", "1 0;1 1;1 2"),
    ("cddl", "common development and distribution|cddl", "1 0;1 1"),
    ("artistic", "artistic|perl artistic", "1 0;2 0"),
    ("afl", "academic free", "1 1;1 2;2 0;2 1;3 0"),
    ("osl", "open software", "1 0;1 1;2 0;2 1;3 0"),
    ("ecl", "educational community", "1 0;2 0"),
    ("apsl", "apple public source", "1 0;1 1;1 2;2 0"),
    ("php", "php", "3 0;3 01"),
    ("python", "python(?: software foundation)?|psf", "2 0;2"),
    ("ofl", "sil open font|open font", "1 0;1 1"),
    ("zpl", "zope public", "1 1;2 0;2 1"),
    ("lppl", "latex project public", "1 0;1 1;1 2;1 3c;1 3"),
    ("openldap", "openldap public", "2 8;2 7;2 6;2 5;2 0"),
    ("cecill", "cecill(?: b| c)?", "1 0;1 1;2 0;2 1"),
    ("elastic", "elastic", "2 0"),
    ("sspl", "server side public", "1 0;1"),
    ("busl", "business source", "1 1;1 0"),
    ("odbl", "open database|odbl", "1 0"),
    ("ngpl", "nethack general public", "1 0"),
    ("nasa", "nasa open source agreement|nasa", "1 3"),
    ("rpl", "reciprocal public", "1 1;1 5"),
    ("spl", "sun public", "1 0"),
    ("upl", "universal permissive", "1 0"),
    ("ncsa", "university of illinois ncsa(?: open source)?|ncsa", "1 0"),
    ("boost", "boost(?: software)?", "1 0"),
    ("mulan", "mulan(?: psl| permissive software)", "1;2"),
    ("w3c", "w3c(?: software)?(?: notice and)?", "1 0"),
    ("unicode", "unicode(?: data files and software)?", "1;3"),
)
#: label, names; the word license follows or they stand for themselves.
PLAIN = (
    ("mit", "(?:the )?mit|expat|massachusetts institute of technology", True), ("isc", "isc|internet systems consortium", True),
    ("bsd", "(?:the )?(?:new |revised |modified |simplified )?bsd|berkeley software distribution", True), ("zlib", "zlib|zlib libpng", True),
    ("x11", "x11|x consortium", True), ("openssl", "openssl", True), ("sleepycat", "sleepycat", True), ("vim", "vim", True),
    ("qpl", "q public|qt public", True), ("ruby", "ruby", True), ("ftl", "freetype(?: project)?", True), ("ijg", "independent jpeg group", True),
    ("curl", "curl", True), ("postgresql", "postgresql", True), ("unlicense", "(?:the )?unlicense", False), ("wtfpl", "wtfpl|do what the fuck you want to public", True),
    ("beerware", "beer ?ware", True), ("ms-pl", "microsoft public|ms pl", True), ("ms-rl", "microsoft reciprocal|ms rl", True), ("json", "json", True),
    ("ipl", "ibm public", True), ("intel", "intel open source", True), ("nokia", "nokia open source", True), ("lucent", "lucent public", True),
    ("tcl", "tcl tk", True), ("hpnd", "historical permission notice and disclaimer", True), ("0bsd", "zero clause bsd|0bsd|bsd zero clause", True), ("mit-0", "mit no attribution|mit 0", True),
    ("public-domain", "(?:in|into|to) the public domain|public domain dedication", False), ("cc0", "cc0(?: 1 0)?(?: universal)?", False), ("cc0", "creative commons zero", False),
    ("pddl", "open data commons public domain dedication(?: and license)?", False), ("odc-by", "open data commons attribution", True),
    ("proprietary", "proprietary|commercial", True), ("commons-clause", "commons clause", False),
    ("copyright", "copyright (?:c )?(?:19|20)[0-9]{2}|copyrighted", False), ("as-is", "provided as is without warrant(?:y|ies)|without warranty of any kind", False),
    ("spdx", "spdx license identifier", False), ("dual", "dual licensed", False), ("licensed", "licensed(?: to you)? under|under (?:the terms of )?(?:this|the) license", False),
)
_GNU = (
    ("gpl", "general public license|gpl", "1 2 3"), ("lgpl", "lesser general public license|library general public license|lgpl", "2 2.1 3"),
    ("agpl", "affero general public license|agpl", "1 3"), ("gfdl", "free documentation license", "1.1 1.2 1.3"),
)
_CC = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
_CC_WORDS = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?(?: work)?s?"}


def alternatives(names: str) -> list[tuple[str, str]]:
    """Each alternative of an expression beside its keyword: the longest text between spaces that all its matches hold."""
    out, depth, part = [], 0, ""
    for c in names + "|":
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            fixed = re.sub(r"\(\?:[^()]*\)\??|\[[^]]*\](?:\{\d+\})?", "|", part)  # what varies or may be missing
            out.append((part, max((x.strip() for x in re.sub(r".\?", "|", fixed).split("|")), key=len)))
            part = ""
        else:
            part += c
    return out


def rules() -> list[tuple[str, int, str, str, bool]]:
    """(label, priority, keyword, expression, base) of every rule, most specific first; generated from the tables above."""
    out: list[tuple[str, int, str, str, bool]] = []
    for label, names, versions in VERSIONED:
        for name, keyword in alternatives(names):
            for v in versions.split(";"):
                number = f"{_VERSION} ?{v.replace(' ', ' ?')}"
                out.append((f"{label}-{v.replace(' ', '.')}", 3, keyword, f"{name}(?: {_LICENSE}{number}|{number} {_LICENSE})", False))
            out.append((label, 2, keyword, f"{name} {_LICENSE}", False))
    for label, names, versions in _GNU:
        for name, keyword in alternatives(names):
            for v in versions.split():
                exact = f"(?:gnu )?{name}(?: {_LICENSE})?{_VERSION} ?v?{v.replace('.', ' ')}(?: 0)?"
                out.append((f"{label}-{v if '.' in v else v + '.0'}-or-later", 4, keyword, f"{exact} or (?:any )?(?:later|newer)(?: version)?", False))
                out.append((f"{label}-{v if '.' in v else v + '.0'}-only", 4, keyword, f"{exact} only", False))
                out.append((f"{label}-{v if '.' in v else v + '.0'}", 3, keyword, exact, False))
            out.append((label, 2, keyword, f"(?:gnu )?{name}", False))
    for kind in _CC:
        parts = kind.split()
        words = " ".join(_CC_WORDS[p] for p in parts)
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            out.append((f"cc-{'-'.join(parts)}-{v.replace(' ', '.')}", 3, f"cc {kind}", f"cc {kind}(?: {_LICENSE})?{_VERSION} {v}", False))
            out.append((f"cc-{'-'.join(parts)}-{v.replace(' ', '.')}", 3, "creative commons", f"creative commons {words}(?: {v} (?:international|unported|generic)|(?: international| unported| generic)?(?: public)?(?: {_LICENSE})?{_VERSION} {v})", False))
        out.append((f"cc-{'-'.join(parts)}", 2, f"cc {kind}", f"cc {kind}", False))
        out.append((f"cc-{'-'.join(parts)}", 2, "creative commons", f"creative commons {words}", False))
    out += [("creative-commons", 1, "creative commons", "creative commons", False)]
    for n, word in ((2, "two|2"), (3, "three|3"), (4, "four|4")):
        out.append((f"bsd-{n}-clause", 3, "bsd", f"(?:bsd (?:{word}) clause|(?:{word}) clause bsd)(?: {_LICENSE})?", False))
    for label, names, license_follows in PLAIN:
        for name, keyword in alternatives(names):
            out.append((label, 2 if license_follows else 1, keyword, f"{name} {_LICENSE}" if license_follows else name, False))
    for spdx in ("mit", "isc", "zlib", "apache 2 0", "bsd 2 clause", "bsd 3 clause", "mpl 2 0", "epl 2 0", "cc0 1 0", "unlicense", "wtfpl", "bsl 1 0", "ncsa", "postgresql", "artistic 2 0"):
        out.append((spdx.replace(" ", "-", 1).replace(" ", "." if spdx[-1].isdigit() else "-"), 4, "spdx", f"spdx license identifier {spdx}", False))
    out += [(label, 2 if phrase != "all rights reserved" else 1, phrase, phrase, True) for phrase, label in BASE]
    return out


def _table(table: list[tuple[str, int, str, str, bool]]) -> Column:
    row = lambda r: F.struct(F.lit(r[0]).alias("label"), F.lit(r[1]).alias("priority"), F.lit(r[2]).alias("keyword"), F.lit(f"(?<= )({r[3]})(?= )").alias("expression"), F.lit(r[4]).alias("base"))
    return F.array(*(row(r) for r in table))


def _detections(norm: Column, rule: Column) -> Column:
    """Word intervals [start, stop) of a rule's matches: each is marked by two control characters, which no word holds."""
    marked = F.split(F.regexp_replace(norm, rule["expression"], F.lit("\x01$1\x02")), " ")
    at = lambda mark, test: F.array_compact(F.transform(marked, lambda w, i: F.when(test(w, mark), i - 1)))  # noqa: E731  the first item is empty
    return F.transform(
        F.arrays_zip(at("\x01", lambda w, m: w.startswith(m)).alias("start"), at("\x02", lambda w, m: w.endswith(m)).alias("stop")),
        lambda x: F.struct(x["start"].alias("start"), (-(x["stop"] + 1)).alias("minus_stop"), (-rule["priority"]).alias("minus_priority"), rule["label"].alias("label"), rule["base"].alias("base")),
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: list[tuple[str, int, str, str, bool]] | None = None) -> DataFrame:
    """One row for each row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is the highest priority (1 generic to 4 an exact identifier) of a detection that is not suppressed, over 4;
    0 if there is none. Null and empty texts have no words; null ids stay null, repeated rows give equal rows, an empty
    table none; other columns are ignored.
    """
    table = table or rules()
    raw = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t")).withColumn("low", F.lower("t"))
    gate = None
    for anchor in ANCHORS:  # lower case of all letters finds at least what that of A-Z does
        has = F.col("low").contains(anchor)
        if anchor == "cc":
            has = has & F.col("low").rlike(r"(?<![a-z0-9])cc(?:0|[\x00-\x2F\x3A-\x60\x7B-\x7F]+by)")
        gate = has if gate is None else gate | has
    # Words lie between separators; one at either end of the text has an empty item beyond it.
    ends = [F.substring("t", at, 1).rlike(RAW_SEPARATOR).cast("int") for at in (1, -1)]
    n_words = F.when(F.col("t") == "", 0).otherwise(F.size(F.split("t", RAW_SEPARATOR)) - ends[0] - ends[1])
    words = F.array_remove(F.split(F.translate("t", _UPPER, _UPPER.lower()), SEPARATOR), "")
    text = raw.select("doc_id", n_words.cast("long").alias("n_words"), F.when(gate, F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))).alias("norm"))
    open_ = F.filter(_table(table), lambda r: F.col("norm").contains(r["keyword"]))
    found = text.select("doc_id", "n_words", F.when(F.col("norm").isNotNull(), F.array_sort(F.flatten(F.transform(open_, lambda r: _detections(F.col("norm"), r))))).alias("hits"))
    # In the order of (start, -stop, -priority), what contains a detection comes before it: for each priority the farthest stop so far is enough.
    levels = sorted({r[1] for r in table})
    start = F.struct(*(F.lit(0).alias(f"p{p}") for p in levels), F.lit(0).alias("top"), F.array().cast("array<string>").alias("labels"))

    def step(s, h):
        stop, priority = -h["minus_stop"], -h["minus_priority"]
        over = F.greatest(*(F.when(F.lit(p) >= priority, s[f"p{p}"]).otherwise(0) for p in levels), F.lit(0))
        kept = over < stop
        return F.struct(
            *(F.when(priority == p, F.greatest(s[f"p{p}"], stop)).otherwise(s[f"p{p}"]).alias(f"p{p}") for p in levels),
            F.when(kept, F.greatest(s["top"], priority)).otherwise(s["top"]).alias("top"),
            F.when(kept | h["base"], F.array_union(s["labels"], F.array(h["label"]))).otherwise(s["labels"]).alias("labels"),
        )

    base = F.filter("hits", lambda h: h["base"])
    kept = found.select("doc_id", "n_words", base.alias("base"), F.when(F.size("hits") > 0, F.aggregate("hits", start, step)).alias("kept"))
    starts = F.transform("base", lambda h: h["start"])
    return kept.select(
        "doc_id", "n_words", F.coalesce(F.when(F.col("base").isNotNull(), F.size("base")), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform("base", lambda h: h["label"]))), ","), F.lit("")).alias("base_labels"),
        F.coalesce(F.array_join(F.array_sort("kept.labels"), ","), F.lit("")).alias("labels"),
        F.coalesce(F.col("kept.top") / 4.0, F.lit(0.0)).cast("double").alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(load(spark, sf_dir, "documents"))
