"""Licence detection with ordered signature rules, all within the row of a document.

A rule is a regular expression over lower-cased words joined by blanks, anchored at its first
word. A text is looked at only if it has one of a few gate words, which every rule needs; there,
rules are tried only at words some rule starts with, and only those that start with it. Each
detection is an interval of words. One that lies within another of equal or better priority is
suppressed; of equal intervals the better priority, then the earlier rule stays.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words of the lower-cased text; A-Z are still in the text where words are taken from it.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GATES = ("license", "licence", "licenses", "licences", "licensed", "licenced", "unlicense", "spdx", "cc", "cc0",
         "permission", "redistribution", "domain", "copyleft", "wtfpl", "cddl", "eupl",
         *(f"{name}{v}{n}" for name, v, n in product(("gpl", "lgpl", "agpl"), ("", "v"), (2, 3))))
_OTHER = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]"
GATE = rf"(?i)(?:^|{_OTHER})(?:{'|'.join(GATES)})(?:$|{_OTHER})"

BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

_L = r" licen[sc]e"


def _v(major: int, rest: str = "(?: 0)?") -> str:
    """A version in its written forms: "3.0", "version 3", "v 3", "v3"."""
    return rf"(?:(?: version| v)? {major}| v{major}){rest}"


# Names by label; the first word is fixed. More specific names stand before general ones.
NAMES = {
    "agpl-3.0": rf"gnu affero general public{_L}{_v(3)}", "agpl": rf"gnu affero general public{_L}",
    "lgpl-2.0": rf"gnu library general public{_L}{_v(2)}", "lgpl-2.1": rf"gnu lesser general public{_L}{_v(2, ' 1')}",
    "lgpl-3.0": rf"gnu lesser general public{_L}{_v(3)}", "lgpl": rf"gnu (?:lesser|library) general public{_L}",
    "gpl-1.0": rf"gnu general public{_L}{_v(1)}", "gpl-2.0": rf"gnu general public{_L}{_v(2)}",
    "gpl-3.0": rf"gnu general public{_L}{_v(3)}", "gpl": rf"gnu general public{_L}",
    "gfdl-1.2": rf"gnu free documentation{_L}{_v(1, ' 2')}", "gfdl-1.3": rf"gnu free documentation{_L}{_v(1, ' 3')}",
    "gfdl": rf"gnu free documentation{_L}",
    "apache-1.1": rf"apache(?: software)?{_L}{_v(1, ' 1')}", "apache-2.0": rf"apache(?: software)?{_L}{_v(2)}",
    "apache": rf"apache(?: software)?{_L}", "mit": rf"mit{_L}", "mit-0": rf"mit no attribution{_L}", "x11": rf"x11{_L}",
    "isc": rf"isc{_L}", "zlib": rf"zlib{_L}", "libpng": rf"libpng{_L}", "ncsa": rf"ncsa(?: open source)?{_L}",
    "bsd-2-clause": rf"bsd 2 clause{_L}", "bsd-3-clause": rf"bsd 3 clause{_L}", "bsd-4-clause": rf"bsd 4 clause{_L}",
    "bsd-zero": rf"bsd zero clause{_L}", "bsd": rf"bsd(?: style)?{_L}",
    "mpl-1.1": rf"mozilla public{_L}{_v(1, ' 1')}", "mpl-2.0": rf"mozilla public{_L}{_v(2)}", "mpl": rf"mozilla public{_L}",
    "epl-1.0": rf"eclipse public{_L}{_v(1)}", "epl-2.0": rf"eclipse public{_L}{_v(2)}", "epl": rf"eclipse public{_L}",
    "cddl-1.0": rf"common development and distribution{_L}", "eupl": rf"european union public{_L}", "artistic-2.0": rf"artistic{_L}{_v(2)}",
    "artistic": rf"artistic{_L}", "boost": rf"boost software{_L}", "postgresql": rf"postgresql{_L}", "python": rf"python software foundation{_L}",
    "ofl-1.1": rf"sil open font{_L}", "ms-pl": rf"microsoft public{_L}", "odbl": rf"open database{_L}", "osl-3.0": rf"open software{_L}",
    "cc0": r"cc0", "cc-by-nc-nd": r"cc by nc nd(?: \d)?(?: \d)?", "cc-by-nc-sa": r"cc by nc sa(?: \d)?(?: \d)?",
    "cc-by-nc": r"cc by nc(?: \d)?(?: \d)?", "cc-by-nd": r"cc by nd(?: \d)?(?: \d)?", "cc-by-sa": r"cc by sa(?: \d)?(?: \d)?",
    "cc-by-4.0": r"cc by 4 0", "cc-by-3.0": r"cc by 3 0", "cc-by": r"cc by",
}
# Short forms, the version often in one word with the name.
SHORT = (
    ("gpl-2.0", r"(?:gplv2|gpl2)(?: 0)?"), ("gpl-3.0", r"(?:gplv3|gpl3)(?: 0)?"), ("lgpl-2.1", r"lgplv2 1"),
    ("lgpl-3.0", r"(?:lgplv3|lgpl3)(?: 0)?"), ("agpl-3.0", r"(?:agplv3|agpl3)(?: 0)?"),
    ("gpl-2.0", rf"gpl{_v(2)}{_L}"), ("gpl-3.0", rf"gpl{_v(3)}{_L}"), ("lgpl-2.1", rf"lgpl{_v(2, ' 1')}{_L}"),
    ("lgpl-3.0", rf"lgpl{_v(3)}{_L}"), ("agpl-3.0", rf"agpl{_v(3)}{_L}"),
    ("apache-2.0", rf"apache{_v(2)}{_L}"), ("mpl-2.0", rf"mpl{_v(2)}{_L}"), ("mpl-1.1", rf"mpl{_v(1, ' 1')}{_L}"),
    ("bsd-2-clause", rf"2 clause bsd{_L}"), ("bsd-3-clause", rf"3 clause bsd{_L}"), ("bsd-4-clause", rf"4 clause bsd{_L}"),
    ("bsd-3-clause", rf"(?:new|modified|revised) bsd{_L}"), ("bsd-2-clause", rf"(?:simplified|freebsd) bsd{_L}"),
)
# Phrases that introduce a name; the first word is fixed.
LEADS = ("licensed under(?: the)?(?: terms of the)?", "released under(?: the)?(?: terms of the)?",
         "distributed under(?: the)?(?: terms of the)?", "available under(?: the)?(?: terms of the)?")
# Sentences that stand for a licence by themselves.
TEXTS = {
    "mit": r"permission is hereby granted free of charge to any person obtaining a copy",
    "isc": r"permission to use copy modify and or distribute this software for any purpose",
    "bsd": r"redistribution and use in source and binary forms",
    "public-domain": r"(?:dedicated|released) (?:in|to|into) the public domain",
    "unlicense": r"this is free and unencumbered software released into the public domain",
    "wtfpl": r"do what the fuck you want to public license", "copyleft": r"copyleft",
}
CERTAIN, STRONG, NAMED = 1.0, 0.95, 0.8


@dataclass(frozen=True)
class Rule:
    """Words to match, where ``first`` is the set of words the pattern can start with."""

    first: tuple[str, ...]
    pattern: str
    label: str
    priority: int
    weight: float


def _first(pattern: str) -> tuple[str, ...]:
    head = re.match(r"\(\?:[a-z0-9|]+\)|[a-z0-9]+", pattern)[0]
    return tuple(head.removeprefix("(?:").removesuffix(")").split("|"))


def signature_rules() -> list[Rule]:
    """Whole sentences, then introduced names, then SPDX tags, then bare names."""
    rules = [Rule(_first(p), p, label, 1, CERTAIN) for label, p in TEXTS.items()]
    named = [*NAMES.items(), *SHORT]
    rules += [Rule(_first(lead), f"{lead} {p}", label, 1, CERTAIN) for lead in LEADS for label, p in named]
    rules += [Rule(("spdx",), "spdx license identifier " + label.replace("-", " ").replace(".", " "), label, 1, STRONG)
              for label in NAMES]
    rules += [Rule(_first(p), p, label, 2, NAMED) for label, p in named]
    return rules


RULES = signature_rules()
# No rule spans more words, and no word starts more rules; both are checked by tests.
MOST_WORDS, MOST_RULES = 16, 96


def _lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _candidates(words: Column) -> Column:
    """(s, first word, text) at every word some rule starts with."""
    starts = sorted({w for r in RULES for w in r.first} | {p.split(" ")[0] for p, _ in BASE})
    marked = F.transform(words, lambda w, i: F.when(
        _lower(w).isin(starts),
        F.struct(i.alias("s"), _lower(w).alias("first"),
                 _lower(F.array_join(F.slice(words, i + 1, MOST_WORDS), " ")).alias("text"))))
    return F.filter(marked, F.isnotnull)


def _matches(place: Column) -> Column:
    """(s, last, priority, rule) of the rules that match at one place. ``last`` is minus the end."""
    by_first: dict[str, list[int]] = {}
    for i, r in enumerate(RULES):
        for w in r.first:
            by_first.setdefault(w, []).append(i)
    none = F.array().cast("array<struct<rule:int,found:string>>")
    tried = none
    for w, ids in by_first.items():
        tries = F.array(*[F.struct(F.lit(i).alias("rule"), F.regexp_extract(
            place["text"], rf"^({RULES[i].pattern})(?: |$)", 1).alias("found")) for i in ids])
        tried = F.when(place["first"] == w, tries).otherwise(tried)
    priority = F.array(*[F.lit(r.priority) for r in RULES])
    return F.transform(F.filter(tried, lambda m: m["found"] != ""), lambda m: F.struct(
        place["s"].alias("s"), (-place["s"] - F.size(F.split(m["found"], " "))).alias("last"),
        F.get(priority, m["rule"]).alias("priority"), m["rule"].alias("rule")))


def _kept(found: Column) -> Column:
    """Detections not within an earlier one of equal or better priority.

    Sorted by start and falling end, a container stands before what it contains, and starts at
    most MOST_WORDS before it: looking back over so many places is enough.
    """
    back = MOST_WORDS * MOST_RULES

    def suppressed(x: Column, i: Column) -> Column:
        before = F.slice(found, F.greatest(F.lit(1), i + 1 - back), F.least(i, F.lit(back)))
        return F.exists(before, lambda y: (y["last"] <= x["last"]) & (y["priority"] <= x["priority"]))
    flagged = F.transform(found, lambda x, i: F.when(~suppressed(x, i), x))
    return F.filter(flagged, F.isnotnull)


def _base(phrase: str, label: str) -> Column:
    """(start, label) of every place of one base phrase."""
    places = F.coalesce("_places", F.array().cast("array<struct<s:int,first:string,text:string>>"))
    here = F.filter(places, lambda p: (p["text"] == phrase) | p["text"].startswith(phrase + " "))
    return F.transform(here, lambda p: F.struct(p["s"].cast("long").alias("start"), F.lit(label).alias("label")))


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, base, detections) of every row of ``docs`` (doc_id, text, any others).

    ``base`` lists (start, label) of every place of a base phrase; ``detections`` lists
    (start, end, label, priority, weight) of what suppression leaves, in order. A null or empty
    text has no words and empty lists; rows are judged one by one, so null or repeated ids,
    repeated rows and empty tables need no care. Nothing is shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select("doc_id", F.rlike(text, F.lit(GATE)).alias("_gate"),
                        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_words"))
    places = words.select("doc_id", F.size("_words").cast("long").alias("n_words"), F.when(
        F.col("_gate"), _candidates(F.col("_words"))).alias("_places"))
    none = "array<struct<s:int,last:int,priority:int,rule:int>>"
    found = places.select(
        "doc_id", "n_words", "_places", F.coalesce(F.array_sort(F.flatten(F.transform("_places", _matches))),
                                                   F.array().cast(none)).alias("_found"))
    base = F.concat(*[_base(phrase, label) for phrase, label in BASE])
    labels, weights = (F.array(*[F.lit(getattr(r, a)) for r in RULES]) for a in ("label", "weight"))
    return found.select("doc_id", "n_words", base.alias("base"), F.transform(
        _kept(F.col("_found")), lambda d: F.struct(
            d["s"].cast("long").alias("start"), (-d["last"]).cast("long").alias("end"), F.get(labels, d["rule"]).alias("label"),
            d["priority"].alias("priority"), F.get(weights, d["rule"]).alias("weight"))).alias("detections"))


def summarised(scan: DataFrame) -> DataFrame:
    """One digest per row of a scan: counts, first and last place, labels, and the best weight."""
    base_labels = F.transform("base", lambda b: b["label"])
    all_labels = F.concat(base_labels, F.transform("detections", lambda d: d["label"]))

    def listed(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    starts = F.transform("base", lambda b: b["start"])
    return scan.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), listed(base_labels).alias("base_labels"), listed(all_labels).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["weight"])), F.lit(0.0)).alias("score"),
        F.size("detections").cast("long").alias("n_detections"))
