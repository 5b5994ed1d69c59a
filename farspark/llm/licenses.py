"""License detection by ordered signature rules, in DataFrame functions only.

A text becomes its words with one space around each. A keyword prefilter says which licenses can occur at all; only
their rules run. Every hit is an interval of words; a hit inside the interval of another one is suppressed when the other is
longer or, for equal intervals, comes from the rule of higher priority. Everything happens inside the row, so
nothing is shuffled and a lost task costs its own rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Runs of characters between words: ASCII but for letters and digits.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases that always count, by their words, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Label, keyword that any mention contains, and the license's name as a pattern over words.
NAMES = (
    ("mit", "mit", "(?:the )?mit(?: expat)?"),
    ("apache-2", "apache", "(?:the )?apache(?: software)?(?: license)?(?: version)? 2(?: 0)?"),
    ("apache-1", "apache", "(?:the )?apache(?: software)?(?: license)?(?: version)? 1(?: [01])?"),
    ("apache", "apache", "(?:the )?apache(?: software)?"),
    ("gpl-3", "gpl|general public", "(?:the )?(?:gnu )?(?:gpl|general public license) ?(?:version |v)?3(?: 0)?"),
    ("gpl-2", "gpl|general public", "(?:the )?(?:gnu )?(?:gpl|general public license) ?(?:version |v)?2(?: 0)?"),
    ("gpl", "gpl|general public", "(?:the )?(?:gnu )?(?:gpl|general public license)"),
    ("lgpl-3", "lgpl|general public", "(?:the )?(?:gnu )?(?:lgpl|lesser general public license) ?(?:version |v)?3(?: 0)?"),
    ("lgpl-2", "lgpl|general public", "(?:the )?(?:gnu )?(?:lgpl|(?:lesser|library) general public license) ?(?:version |v)?2(?: [01])?"),
    ("lgpl", "lgpl|general public", "(?:the )?(?:gnu )?(?:lgpl|lesser general public license)"),
    ("agpl-3", "affero", "(?:the )?(?:gnu )?affero general public license ?(?:version |v)?3(?: 0)?"),
    ("agpl", "affero", "(?:the )?(?:gnu )?affero general public license"),
    ("agpl-3", "agpl", "(?:the )?(?:gnu )?agpl ?v?3(?: 0)?"),
    ("bsd-2", "bsd", "(?:the )?(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd)"),
    ("bsd-3", "bsd", "(?:the )?(?:(?:new|revised|modified) bsd|bsd 3 clause|3 clause bsd)"),
    ("bsd-4", "bsd", "(?:the )?(?:original bsd|bsd 4 clause|4 clause bsd)"),
    ("bsd-0", "0bsd", "(?:the )?0bsd"),
    ("bsd", "bsd", "(?:the )?bsd"),
    ("mpl-2", "mpl|mozilla", "(?:the )?(?:mpl|mozilla public license) ?(?:version |v)?2(?: 0)?"),
    ("mpl-1", "mpl|mozilla", "(?:the )?(?:mpl|mozilla public license) ?(?:version |v)?1(?: [01])?"),
    ("mpl", "mozilla", "(?:the )?mozilla public"),
    ("epl-2", "eclipse", "(?:the )?eclipse public license ?(?:version |v)?2(?: 0)?"),
    ("epl-1", "eclipse", "(?:the )?eclipse public license ?(?:version |v)?1(?: 0)?"),
    ("cddl-1", "cddl", "(?:the )?cddl ?(?:version |v)?1(?: [01])?"),
    ("cddl-1", "common development", "(?:the )?common development and distribution license ?(?:version |v)?1(?: [01])?"),
    ("isc", "isc", "(?:the )?isc"),
    ("zlib", "zlib", "(?:the )?zlib(?: libpng)?"),
    ("boost-1", "boost", "(?:the )?boost software(?: license)?(?: version)?(?: 1 0)?"),
    ("artistic-2", "artistic", "(?:the )?artistic license ?(?:version |v)?2(?: 0)?"),
    ("artistic", "artistic", "(?:the )?artistic"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl", "(?:the )?wtfpl"),
    ("python-2", "python", "(?:the )?python software foundation(?: license)?(?: version 2)?"),
    ("eupl-1", "eupl", "(?:the )?eupl(?: (?:version |v)?1(?: [12])?)?"),
    ("ofl-1", "open font", "(?:the )?(?:sil )?open font(?: license)?(?: version)?(?: 1(?: 1)?)?"),
    ("odbl-1", "open database", "(?:the )?open database(?: license)?(?: v?1(?: 0)?)?"),
    ("gfdl", "free documentation", "(?:the )?(?:gnu )?free documentation(?: license)?(?: version 1(?: [123])?)?"),
    ("cc0", "cc0", "(?:the )?(?:creative commons )?cc0(?: 1 0)?"),
    ("cc-by-nc-nd", "cc|creative", "(?:the )?(?:creative commons|cc) (?:by|attribution) (?:nc|non ?commercial) (?:nd|no ?deriv(?:ative)?s)(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc", "(?:the )?cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "share", "(?:the )?creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?"),
    ("cc-by-nc", "cc", "(?:the )?cc by nc(?: [1-4] [05])?"),
    ("cc-by-nc", "commercial", "(?:the )?creative commons attribution non ?commercial(?: [1-4] [05])?"),
    ("cc-by-nd", "cc|creative", "(?:the )?(?:creative commons|cc) (?:by|attribution) (?:nd|no ?deriv(?:ative)?s)(?: [1-4] [05])?"),
    ("cc-by-sa", "cc", "(?:the )?cc by sa(?: [1-4] [05])?"),
    ("cc-by-sa", "share", "(?:the )?creative commons attribution share ?alike(?: [1-4] [05])?"),
    ("cc-by", "cc", "(?:the )?cc by(?: [1-4] [05])?"),
    ("cc-by", "creative", "(?:the )?creative commons attribution(?: [1-4] [05])?"),
)

#: How a license is mentioned around its name, and how sure such a mention is. First ones take priority.
FORMS = (
    ("spdx license identifier {0}", 1.0),
    ("(?:this (?:work|file|project|program|software|code|text) is |is |are )?(?:dual )?(?:licensed|released|distributed|made available|provided|published|available) under (?:the terms of |the terms and conditions of |a |an )?{0}(?: licen[sc]e)?", 0.95),
    ("(?:redistribute it and or modify it |use of this source code is governed by |subject to |governed by |in accordance with )(?:under )?(?:the terms of )?{0}(?: licen[sc]e)?", 0.9),
    ("under (?:the terms of )?{0} licen[sc]e", 0.85),
    ("licen[sc]e {0}", 0.7),
    ("{0} licen[sc]e", 0.7),
)
#: A phrase is certain.
PHRASE_SCORE = 1.0



def rules() -> list[tuple[int, str, str, str, float]]:
    """Every rule: priority (small first), label, keywords, pattern over ` word word `, score."""
    out = [(i, label, label.split("-")[0], phrase, PHRASE_SCORE) for i, (phrase, label) in enumerate(PHRASES.items())]
    for form, score in FORMS:
        out += [(len(out) + i, label, keywords, form.format(name), score) for i, (label, keywords, name) in enumerate(NAMES)]
    return [(priority, label, keywords, f"(?i) {pattern}(?= )", score) for priority, label, keywords, pattern, score in out]


def spaced(text: Column) -> Column:
    """The words of a text with one space before, between and after them; one space for a text without words."""
    return F.regexp_replace(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), GAP, " ")


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def _hits(words: Column, rule: Column) -> Column:
    """Intervals of words where a rule matches, by what lies between its matches."""
    between = F.transform(F.split(words, rule["pattern"], -1), _spaces)
    inside = F.transform(F.regexp_extract_all(words, rule["pattern"], F.lit(0)), _spaces)

    def hit(n: Column, i: Column) -> Column:
        start = _total(F.slice(between, 1, i + 1)) + _total(F.slice(inside, 1, i))
        return F.struct(start.cast("long").alias("start"), (-(start + n)).cast("long").alias("minus_stop"),
                        rule["priority"].alias("priority"), rule["label"].alias("label"), rule["score"].alias("score"))

    return F.when(F.size(between) > 1, F.transform(inside, hit)).otherwise(F.transform(F.slice(inside, 1, 0), hit))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Add `n_words`, `phrases` and `detections` to every row.

    `phrases` holds every place of a fixed phrase, `detections` the hits of all rules that are left after suppression, both
    as intervals of words from 0: start, minus_stop (the end, negated: the order is by start, longest first), priority,
    label and score. A null or empty text has no words and empty arrays. Rows are judged one by one: repeated rows repeat
    their result, other columns stay (those called like a result are replaced; names with `_` in front are the
    operator's), and an empty table gives an empty one.
    """
    every = rules()
    table = F.array(*(F.struct(F.lit(a).alias("priority"), F.lit(b).alias("label"), F.lit(c).alias("keywords"),
                               F.lit(d).alias("pattern"), F.lit(e).alias("score")) for a, b, c, d, e in every))
    lowered = F.lower("_words")
    gates = []
    for keywords in dict.fromkeys(r[2] for r in every):
        found = F.lit(False)
        for k in keywords.split("|"):
            found = found | F.contains("_lower", F.lit(k))
        gates.append(F.when(found, F.lit(keywords)))
    out = df.withColumn("_words", spaced(F.col(text))).withColumn("_lower", lowered).withColumn("_gates", F.array_compact(F.array(*gates)))
    active = F.when(F.size("_gates") > 0, F.filter(table, lambda r: F.array_contains("_gates", r["keywords"])))
    out = out.withColumn("_hits", F.array_sort(F.flatten(F.transform(active, lambda r: _hits(F.col("_words"), r)))))
    none = F.expr("cast(array() AS array<struct<start: bigint, minus_stop: bigint, priority: int, label: string, score: double>>)")
    hits = F.coalesce("_hits", none)
    # In this order whatever covers a hit comes before it, so the furthest end so far decides.
    state = F.struct(F.lit(0).cast("long").alias("end"), none.alias("kept"))
    kept = F.aggregate(hits, state, lambda s, h: F.struct(
        F.greatest(s["end"], -h["minus_stop"]).alias("end"),
        F.when(-h["minus_stop"] > s["end"], F.concat(s["kept"], F.array(h))).otherwise(s["kept"]).alias("kept")), lambda s: s["kept"])
    return out.withColumns({
        "n_words": (_spaces(F.col("_words")) - 1).cast("long"),
        "phrases": F.filter(hits, lambda h: h["priority"] < len(PHRASES)),
        "detections": kept,
    }).drop("_words", "_lower", "_gates", "_hits")
