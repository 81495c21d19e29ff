"""License scan by ordered signature rules, in native columns only.

Signatures are regexes over the padded word form of a text (every word between
two spaces): names with and without a version, abbreviations, version
spellings, sentences of license texts and notices, addresses, declared and SPDX
identifiers.  A name after "licensed under" and the like ranks higher.  A rule
runs only on texts holding every word its regex
cannot match without, read from the pattern itself.  Of
overlapping detections, one contained in a better-ranked one (priority, then
length, then rule order) is suppressed.  The base phrases are counted beside.
Both steps take time about linear in the matches, so a very long text of notices
holds its task for as long as its bytes need.

Defined results: null or empty text has no words and no labels; with no base
place first_word and last_word are null; equal texts get equal results; an
empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_WORD, ascii_lower, let, split_words

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Word patterns: words separated by spaces; (a|b), [ab] and a trailing ? keep
# their regex meaning per word.  LIC is either spelling of the word.
LIC = "licen[cs]e"
NC = "(noncommercial|non commercial)"
ND = "(noderivatives|no derivatives|noderivs|no derivs|no derivative works)"
SA = "(sharealike|share alike)"

# family -> (names, abbreviations clear alone, abbreviations clear only beside
# a version word or the word license, {label: version words}).
FAMILIES = {
    "agpl": ((f"gnu? affero general public {LIC} agpl?",), ("agpl",), (), {"agpl-1.0": "1", "agpl-3.0": "3"}),
    "gpl": ((f"gnu? general public {LIC} gpl?",), ("gpl",), (), {"gpl-1.0": "1", "gpl-2.0": "2", "gpl-3.0": "3"}),
    "lgpl": ((f"gnu? lesser general public {LIC} lgpl?", f"gnu? library general public {LIC} lgpl?"), ("lgpl",), (),
             {"lgpl-2.0": "2", "lgpl-2.1": "2 1", "lgpl-3.0": "3"}),
    "gfdl": ((f"gnu? free documentation {LIC} (gfdl|fdl)?",), ("gfdl",), (),
             {"gfdl-1.1": "1 1", "gfdl-1.2": "1 2", "gfdl-1.3": "1 3"}),
    "apache": ((f"apache software? {LIC}",), (), ("apache", "asl"),
               {"apache-1.0": "1", "apache-1.1": "1 1", "apache-2.0": "2"}),
    "mpl": ((f"mozilla public {LIC} mpl?",), (), ("mpl",), {"mpl-1.0": "1", "mpl-1.1": "1 1", "mpl-2.0": "2"}),
    "epl": ((f"eclipse public {LIC} epl?",), (), ("epl",), {"epl-1.0": "1", "epl-2.0": "2"}),
    "cddl": ((f"common development and distribution {LIC} cddl?",), ("cddl",), (), {"cddl-1.0": "1", "cddl-1.1": "1 1"}),
    "cpl": ((f"common public {LIC} cpl?",), (), ("cpl",), {"cpl-1.0": "1"}),
    "eupl": ((f"european union public {LIC} eupl?",), ("eupl",), (),
             {"eupl-1.0": "1", "eupl-1.1": "1 1", "eupl-1.2": "1 2"}),
    "osl": ((f"open software {LIC} osl?",), (), ("osl",), {"osl-2.1": "2 1", "osl-3.0": "3"}),
    "afl": ((f"academic free {LIC} afl?",), (), ("afl",), {"afl-2.1": "2 1", "afl-3.0": "3"}),
    "ecl": ((f"educational community {LIC} ecl?",), (), ("ecl",), {"ecl-1.0": "1", "ecl-2.0": "2"}),
    "artistic": ((f"artistic {LIC}",), (), ("artistic",), {"artistic-1.0": "1", "artistic-2.0": "2"}),
    "bsl": ((f"boost software {LIC} bsl?",), (), (), {"bsl-1.0": "1"}),
    "busl": ((f"business source {LIC} (busl|bsl)?",), ("busl",), (), {"busl-1.1": "1 1"}),
    "sspl": ((f"server side public {LIC} sspl?",), ("sspl",), (), {"sspl-1.0": "1"}),
    "upl": ((f"universal permissive {LIC} upl?",), (), ("upl",), {"upl-1.0": "1"}),
    "cecill": ((f"cecill free? software? {LIC} agreement?",), (), ("cecill",), {"cecill-2.0": "2", "cecill-2.1": "2 1"}),
    "python": ((f"python software foundation {LIC}", f"python {LIC}"), (), ("psf",), {"python-2.0": "2"}),
    "php": ((f"php {LIC}",), (), (), {"php-3.0": "3", "php-3.01": "3 01"}),
    "ofl": ((f"sil? open font {LIC} ofl?",), (), ("ofl",), {"ofl-1.0": "1", "ofl-1.1": "1 1"}),
    "odbl": ((f"open database {LIC} odbl?",), ("odbl",), (), {"odbl-1.0": "1"}),
    "odc-by": ((f"open data commons attribution {LIC}",), (), (), {"odc-by-1.0": "1"}),
    "pddl": ((f"public domain dedication and {LIC} pddl?",), ("pddl",), (), {"pddl-1.0": "1"}),
    "cc0": (("creative commons zero cc0?",), ("cc0",), (), {"cc0-1.0": "1"}),
    **{family: ((f"creative commons {named} {LIC}?",), (family.replace("-", " "),), (),
                {f"{family}-{v}": v.replace(".", " ").removesuffix(" 0") for v in ("1.0", "2.0", "2.5", "3.0", "4.0")})
       for family, named in {
           "cc-by": "attribution", "cc-by-sa": f"attribution {SA}", "cc-by-nd": f"attribution {ND}",
           "cc-by-nc": f"attribution {NC}", "cc-by-nc-sa": f"attribution {NC} {SA}",
           "cc-by-nc-nd": f"attribution {NC} {ND}"}.items()},
}
# label -> names without a version.
NAMES = {
    "mit": (f"mit {LIC}", f"expat {LIC}", f"mit style {LIC}"),
    "x11": (f"x11 {LIC}",),
    "bsd": (f"bsd {LIC}", f"bsd style {LIC}", f"bsd type {LIC}"),
    "bsd-2-clause": (f"simplified bsd {LIC}?", f"freebsd {LIC}", f"bsd 2 clause {LIC}?", f"bsd two clause {LIC}?",
                     f"2 clause bsd {LIC}?", f"two clause bsd {LIC}?"),
    "bsd-3-clause": (f"new bsd {LIC}", f"revised bsd {LIC}", f"modified bsd {LIC}", f"bsd 3 clause {LIC}?",
                     f"bsd three clause {LIC}?", f"3 clause bsd {LIC}?", f"three clause bsd {LIC}?", f"bsd new {LIC}"),
    "bsd-4-clause": (f"original bsd {LIC}", f"old bsd {LIC}", f"bsd 4 clause {LIC}?", f"bsd four clause {LIC}?",
                     f"4 clause bsd {LIC}?", f"four clause bsd {LIC}?"),
    "0bsd": (f"zero clause bsd {LIC}?", f"bsd zero clause {LIC}?", f"0 clause bsd {LIC}?", f"bsd 0 clause {LIC}?", "0bsd"),
    "isc": (f"isc {LIC}", f"internet (systems|software) consortium {LIC}"),
    "zlib": (f"zlib libpng? {LIC}", f"libpng {LIC}"),
    "ruby": (f"ruby {LIC}", f"ruby s {LIC}"),
    "ms-pl": (f"microsoft public {LIC}",),
    "ms-rl": (f"microsoft reciprocal {LIC}",),
    "unlicense": ("the? unlicense",),
    "wtfpl": ("wtfpl", f"do what the fuck you want to public {LIC}"),
    "public-domain": ("released (into|to) the public domain", "dedicated to the public domain",
                      "placed (in|into) the public domain"),
}
# label -> sentences of a license's own text or notice, and its addresses.
BODIES = {
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
            "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    "x11": ("shall not be used in advertising or otherwise to promote the sale use or other dealings in this software",),
    "isc": ("permission to use copy modify and (or)? distribute this software for any purpose with or without fee is hereby granted provided that",),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted",
            "redistributions of source code must retain the above copyright notice",
            "redistributions in binary form must reproduce the above copyright notice"),
    "bsd-3-clause": ("nor the names of its contributors may be used to endorse or promote products derived from this software",
                     "the name of the author may not be used to endorse or promote products derived from this software"),
    "bsd-4-clause": ("all advertising materials mentioning features or use of this software must display the following (acknowledgement|acknowledgment)",),
    "apache-2.0": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an",
                   "apache org licenses license 2 0",
                   "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    "apache-1.1": ("apache org licenses license 1 1",),
    "apache-1.0": ("apache org licenses license 1 0",),
    "perl": ("under the same terms as perl itself",),
    "gpl-3.0": (f"the gnu general public {LIC} is a free copyleft {LIC} for software and other kinds of works",),
    "agpl-3.0": ("if your software can interact with users remotely through a computer network",),
    "lgpl-2.1": ("this is the first released version of the lesser gpl",),
    "lgpl-2.0": ("this is the first released version of the library gpl",),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license", "mozilla org mpl 2 0"),
    "mpl-1.1": ("mozilla org mpl mpl 1 1",),
    "epl-1.0": ("eclipse org legal epl v10",),
    "epl-2.0": ("eclipse org legal epl (v20|2 0)",),
    "artistic-1.0": ("the intent of this document is to state the conditions under which a package may be copied",),
    "artistic-2.0": ("this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed",),
    "bsl-1.0": ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
                "boost org license 1 0"),
    "zlib": ("altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
             "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
             "in no event will the authors be held liable for any damages arising from the use of this software"),
    "php": ("products derived from this software may not be called php",),
    "python": ("psf is making python available to licensee on an",),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
    "wtfpl": ("you just do what the fuck you want to",),
    "ofl-1.1": ("scripts sil org ofl",),
    "ms-pl": ("opensource org licenses ms pl",),
    "cc0-1.0": ("creativecommons org publicdomain zero 1 0",),
    **{label: (f"creativecommons org licenses {' '.join(re.split('[.-]', label)[1:])}",)
       for family, row in FAMILIES.items() if family.startswith("cc-") for label in row[3]},
}
# The no-condition grant: the ISC sentence that does not go on with its proviso.
UNCONDITIONAL = ("0bsd", "permission to use copy modify and (or)? distribute this software for any purpose with or without "
                 "fee is hereby granted", "(?! provided  that )")
# Identifiers that say a license only after the word itself ("License: MIT").
DECLARED = ("bsd", "apache", "mpl", "mit", "x11", "isc", "zlib", "apache-1.0", "apache-1.1", "apache-2.0",
            "mpl-1.0", "mpl-1.1", "mpl-2.0",
            "epl-1.0", "epl-2.0", "cpl-1.0", "osl-2.1", "osl-3.0", "afl-2.1", "afl-3.0", "ecl-1.0", "ecl-2.0",
            "artistic-1.0", "artistic-2.0", "bsl-1.0", "upl-1.0", "cecill-2.0", "cecill-2.1", "python-2.0", "php-3.0",
            "php-3.01", "ms-pl", "ms-rl", "ofl-1.0", "ofl-1.1", "odc-by-1.0")
# A name after these words ranks as high as a sentence of the license.
CONTEXT = ("(licensed|released|distributed|available|published|provided) under the? terms? of? the?",
           "(terms|conditions) of the?")
# Words too frequent to look a rule up by while it has another one.
FREQUENT = {"license", "licenses", "identifier", "public", "general", "software", "open", "free", "version", "terms", "of",
            "and", "the", "this", "commons", "documentation", "distribute", "distribution", "permission", "copyright"}
SPDX, SENTENCE, NAME = 4, 3, 2
MAX_PRIORITY = SPDX
PRIORITIES = (SPDX, SENTENCE, NAME)
RUN = 64  # elements scanned at once by running()


def _words(pattern: str) -> str:
    """Regex over padded words: a trailing ``?`` makes the whole word optional."""
    out, depth, word = [], 0, ""
    for ch in pattern + " ":
        depth += (ch == "(") - (ch == ")")
        if ch == " " and not depth:
            if word:
                optional = word.endswith("?")
                body = word[:-1] if optional else word
                if body.startswith("("):
                    body = "|".join("  ".join(part.split()) for part in body[1:-1].split("|"))
                out.append(f"(?: (?:{body}) ){'?' if optional else ''}")
            word = ""
        else:
            word += ch
    return "".join(out)


_CONTEXT = "|".join(map(_words, CONTEXT))


def _needed(pattern: str) -> list[str]:
    """Words that every match of a word pattern holds: neither optional nor one of several."""
    plain = re.sub(r"\([^()]*\)\??", " ", pattern)
    return sorted({w for w in plain.split() if re.fullmatch("[a-z0-9]+", w)})


def _minor(version: str) -> str:
    return "".join(f"(?: {w} )" for w in version.split()[1:]) or "(?: 0 )?"


def _number(version: str, marked: bool = False) -> str:
    """Regex of a version's spellings; ``marked`` asks for a v or the word version."""
    major = version.split()[0]
    first = f"(?:(?: (?:version|ver|v) )(?: v?{major} )|(?: v{major} ))" if marked else f"(?: (?:version|ver|v) )?(?: v?{major} )"
    return first + _minor(version)


def signatures() -> list[tuple[int, str, int, list[str], str]]:
    """(order, label, priority, needed words, regex) of every rule."""
    rules: list[tuple[int, str, int, list[str], str]] = []

    def add(label: str, priority: int, pattern: str, after: str = "", before: str = "") -> None:
        lead = f"(?:{_CONTEXT})?" if priority == NAME else ""
        rules.append((len(rules), label, priority, _needed(pattern), lead + before + _words(pattern) + after))

    for family, (names, clear, unclear, versions) in FAMILIES.items():
        for name in names:
            add(family, NAME, name)
        for short in clear:
            add(family, NAME, short)
        for short in unclear:
            if f"{short} {LIC}" not in names and not any(n.startswith(f"{short} ") for n in names):
                add(family, NAME, f"{short} {LIC}")
        for label, version in versions.items():
            number = _number(version)
            major, tail = version.split()[0], _minor(version)
            for name in names:
                add(label, NAME, name, number)
                add(label, NAME, name, before=f"(?: (?:version|v) )(?: {major} ){tail}(?: of )(?: the )?")
                if family.endswith("gpl"):
                    add(label, NAME, f"{name} as published by the free software foundation", "(?: either )?" + number)
            for short in clear:
                add(label, NAME, short, number)
            for short in unclear:
                add(label, NAME, short, _number(version, marked=True))
                add(label, NAME, short, f"(?: {major} )" + tail + _words(LIC))
            for short in clear + unclear:
                if " " not in short:
                    add(label, NAME, f"{short}v{major}", tail)
                    if short in clear and not short[-1].isdigit():
                        add(label, NAME, f"{short}{major}", tail)
    for label, names in NAMES.items():
        for name in names:
            add(label, NAME, name)
    for label, sentences in BODIES.items():
        for sentence in sentences:
            add(label, SENTENCE, sentence)
    add(UNCONDITIONAL[0], SENTENCE, UNCONDITIONAL[1], UNCONDITIONAL[2])
    for label in DECLARED:
        add(label, SENTENCE, f"(license|licence|licensed) (under|is)? the? {' '.join(re.split('[.-]', label))}")
    for label in sorted({label for row in FAMILIES.values() for label in row[3]} | (set(NAMES) - {"bsd", "public-domain"})):
        add(label, SPDX, f"spdx license identifier {' '.join(re.split('[.-]', label))} (only|or later)?")
    return rules


def _keyword(needed: list[str]) -> str:
    """The needed word a rule is looked up by: a long one that is not frequent, if any."""
    return max(needed, key=lambda w: (w not in FREQUENT, len(w), w))


def padded(words: Column) -> Column:
    return F.concat(F.lit(" "), F.concat_ws("  ", words), F.lit(" "))


def _count(text: Column) -> Column:
    """Words in a piece of padded text."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))) / 2).cast("int")


def _scan(values: Column, step) -> Column:
    """Running ``step`` over a short array; costs the square of its length."""
    return F.aggregate(values, F.array().cast("array<int>"), lambda out, x: F.concat(
        out, F.array(step(F.try_element_at(out, F.lit(-1)), x))))


def running(values: Column, step) -> Column:
    """Inclusive running ``step`` (null-safe on its first operand, associative) over an int array.

    Runs of ``RUN`` elements are scanned alone and moved by the scan of their last
    values, so that the time is about linear in the length.
    """
    runs = let(values, lambda v: F.transform(
        F.sequence(F.lit(0), F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / RUN).cast("int")),
        lambda i: _scan(F.slice(v, i * RUN + 1, RUN), step)))
    return let(runs, lambda rs: let(
        _scan(F.transform(rs, lambda r: F.try_element_at(r, F.lit(-1))), step),
        lambda ends: F.flatten(F.transform(rs, lambda r, i: F.transform(r, lambda x: step(F.get(ends, i - 1), x))))))


def places(text: Column, regex: Column) -> Column:
    """Structs (start, stop, led) of every match in padded text: words, stop exclusive; led by a context or not."""
    steps = F.filter(F.zip_with(
        F.split(text, regex), F.regexp_extract_all(text, regex, F.lit(0)),
        lambda gap, hit: F.struct(_count(gap).alias("gap"), _count(hit).alias("hit"),
                                  hit.rlike(f"^(?:{_CONTEXT})").alias("led"))), lambda s: s["hit"].isNotNull())

    def spans(s: Column) -> Column:
        stops = running(F.transform(s, lambda x: x["gap"] + x["hit"]), lambda a, x: F.coalesce(a, F.lit(0)) + x)
        return F.zip_with(s, stops, lambda x, stop: F.struct(
            (stop - x["hit"]).alias("start"), stop.alias("stop"), x["led"].alias("led")))
    return let(steps, spans)


def unsuppressed(found: Column) -> Column:
    """Detections that none with a better rank contains, by start.

    Sorted by start, then longest, best and first rule first, a detection comes
    after all that contain it and rank better; of those before it, one with
    at least its priority that ends no earlier is such a one.
    """
    ordered = F.transform(F.array_sort(F.transform(found, lambda d: F.struct(
        d["start"].alias("start"), (-d["stop"]).alias("back"), (-d["priority"]).alias("worse"), d["rule"].alias("rule"),
        d["label"].alias("label")))), lambda d: F.struct(
            d["start"].alias("start"), (-d["back"]).alias("stop"), d["rule"].alias("rule"), d["label"].alias("label"),
            (-d["worse"]).alias("priority")))

    def reach(all_: Column, priority: int) -> Column:
        stops = F.transform(all_, lambda d: F.when(d["priority"] >= priority, d["stop"]).otherwise(F.lit(-1)))
        return running(stops, lambda a, x: F.greatest(a, x))  # greatest skips a null

    def keep(all_: Column) -> Column:
        return let(F.struct(*[reach(all_, p).alias(f"p{p}") for p in PRIORITIES]), lambda far: F.filter(
            all_, lambda d, i: F.coalesce(F.coalesce(*[F.when(d["priority"] == p, F.get(far[f"p{p}"], i - 1))
                                                       for p in PRIORITIES]) < d["stop"], F.lit(True))))
    return let(ordered, keep)


def live_rules(words: Column) -> Column:
    """Rules (rule, label, priority, needed, regex) all of whose needed words are in ``words``."""
    by_word: dict[str, list[Column]] = {}
    for i, label, priority, needed, regex in signatures():
        by_word.setdefault(_keyword(needed), []).append(F.struct(
            F.lit(i).alias("rule"), F.lit(label).alias("label"), F.lit(priority).alias("priority"),
            F.array(*map(F.lit, needed)).alias("needed"), F.lit(regex).alias("regex")))
    rules = F.create_map(*[x for word, group in by_word.items() for x in (F.lit(word), F.array(*group))])
    vocabulary = F.array(*map(F.lit, sorted({w for rule in signatures() for w in rule[3]})))

    def of(present: Column) -> Column:
        looked_up = F.filter(F.transform(present, lambda w: F.try_element_at(rules, w)), lambda g: g.isNotNull())
        return F.filter(F.flatten(looked_up), lambda r: F.forall(r["needed"], lambda w: F.array_contains(present, w)))
    return let(F.array_intersect(words, vocabulary), of)


def detections(words: Column, text: Column) -> Column:
    """Unsuppressed detections (start, stop, rule, label, priority) in words and their padded text."""
    found = F.flatten(F.transform(live_rules(words), lambda r: F.transform(places(text, r["regex"]), lambda s: F.struct(
        s["start"].alias("start"), s["stop"].alias("stop"), r["rule"].alias("rule"),
        r["label"].alias("label"),
        F.greatest(r["priority"], F.when(s["led"], F.lit(SENTENCE))).alias("priority")))))
    return unsuppressed(found)


def base_places(text: Column) -> Column:
    """Structs (start, stop, label) of the base phrases in padded text."""
    phrases = F.array(*[F.struct(F.lit(f" {'  '.join(p.split())} ").alias("phrase"), F.lit(label).alias("label"))
                        for p, label in BASE.items()])
    live = F.filter(phrases, lambda p: F.contains(text, p["phrase"]))
    return F.flatten(F.transform(live, lambda p: F.transform(places(text, p["phrase"]), lambda s: F.struct(
        s["start"].alias("start"), s["stop"].alias("stop"), p["label"].alias("label")))))


def _labels(items: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(items, lambda x: x["label"])))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base (places), found (detections) of every row."""
    words = split_words(ascii_lower(F.col("text")), NON_WORD)
    scanned = let(words, lambda w: let(padded(w), lambda t: F.struct(
        F.size(w).cast("long").alias("n_words"), base_places(t).alias("base"),
        detections(w, t).alias("found"))))
    return docs.select("doc_id", scanned.alias("s")).select("doc_id", "s.*")


def summarise(scanned: DataFrame) -> DataFrame:
    """The per-document digest of :func:`scan`."""
    base, found = F.col("base"), F.col("found")
    starts = F.transform(base, lambda b: b["start"].cast("long"))
    best = F.array_max(F.transform(found, lambda d: d["priority"])) / F.lit(float(MAX_PRIORITY))
    both = F.array_sort(F.array_union(_labels(base), _labels(found)))
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(_labels(base), ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.size(base) > 0, F.lit(0.25)).otherwise(F.lit(0.0))).alias("score"))
