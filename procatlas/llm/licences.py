"""Licence scan, in DataFrame functions only.

1. Statements: every piece of every text (a line's sentence or part of one) alone, and together with the pieces behind it
   up to the end of its sentence; in a piece longer than any template also its runs of words, at every position.  Only
   those without any telling term are left out, which by its weights a template cannot be near without.
2. Sparse TF-IDF vectors of statements and of licence templates meet on their terms; the cosine picks the template.
   Document frequencies of the templates' terms are counted over all documents; a term that no template has is as rare
   as a term can be.
   A statement that is a label and a licence's name or SPDX identifier has that licence.
3. A file with a statement above the threshold has the licence of its best one (header).  A file that is a licence
   file, by name or because the statement is most of its text, gives its licence to its directory.
4. Files without a header take the licence of the nearest directory above them that has one, by joins on the path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procatlas.session import cut

#: Licence templates: identifier and header wordings (fixed values).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or"),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("LGPL-3.0", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or"),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause Simplified License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Licensed under the ISC License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC0-1.0", "Licensed under CC0 1.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("Proprietary", "All rights reserved"),
)
#: Names after a label such as ``License:`` or ``SPDX-License-Identifier:``, words as ``terms`` cuts them (fixed values).
NAMES = {
    "Apache-2.0": ("apache-2.0", "apache 2.0", "apache license 2.0", "apache license version 2.0", "apache software license 2.0"),
    "MIT": ("mit", "mit license", "the mit license"),
    "GPL-2.0": ("gpl-2.0", "gplv2", "gpl v2", "gpl 2.0", "gnu gpl v2", "gnu general public license v2.0", "gnu general public license version 2"),
    "GPL-3.0": ("gpl-3.0", "gplv3", "gpl v3", "gpl 3.0", "gnu gpl v3", "gnu general public license v3.0", "gnu general public license version 3"),
    "LGPL-3.0": ("lgpl-3.0", "lgplv3", "lgpl v3", "lgpl 3.0", "gnu lesser general public license v3.0", "gnu lesser general public license version 3"),
    "AGPL-3.0": ("agpl-3.0", "agplv3", "agpl v3", "agpl 3.0", "gnu affero general public license v3.0", "gnu affero general public license version 3"),
    "BSD-2-Clause": ("bsd-2-clause", "bsd 2-clause", "bsd 2-clause license", "simplified bsd license"),
    "BSD-3-Clause": ("bsd-3-clause", "bsd 3-clause", "bsd 3-clause license", "new bsd license", "modified bsd license"),
    "MPL-2.0": ("mpl-2.0", "mpl 2.0", "mozilla public license 2.0", "mozilla public license version 2.0"),
    "ISC": ("isc", "isc license"),
    "Unlicense": ("unlicense", "the unlicense"),
    "CC0-1.0": ("cc0-1.0", "cc0 1.0", "cc0"),
    "CC-BY-4.0": ("cc-by-4.0", "cc by 4.0", "cc-by 4.0"),
    "CC-BY-SA-4.0": ("cc-by-sa-4.0", "cc by-sa 4.0", "cc-by-sa 4.0"),
    "CC-BY-NC-4.0": ("cc-by-nc-4.0", "cc by-nc 4.0", "cc-by-nc 4.0"),
    "Proprietary": ("proprietary", "all rights reserved"),
}
_LABEL = r"(?i)\b(?:spdx-license-identifier|licen[cs]e)\s*:\s*"
_NAMED = r"(?i)^(?:licen[cs]e|copying|notice|unlicense)(?:[.-][a-z0-9.]+)?$"
# Dots and hyphens belong to a term only inside it.
_CUT = r"[^a-z0-9.-]+|[.-]+(?![a-z0-9.-])|(?<![a-z0-9.-])[.-]+"
# No statement goes on over the end of a sentence or a line without terms.
_ENDS = r"(?<=[.!?])[^\w\n]*\n|(?<=[.!?])\s+|\n[^A-Za-z0-9\n]*(?=\n)"
THRESHOLD = 0.6
#: A run of words inside a longer sentence has to be closer, as its ends are free.
INSIDE = 0.8


def terms(text: Column) -> Column:
    """Lower-case words; dots and hyphens at their ends are no part of them."""
    return F.filter(F.split(F.lower(text), _CUT), lambda w: w != "")


def template_table(spark) -> DataFrame:
    """(template, licence, term, tf)."""
    rows = spark.createDataFrame([(k, *t) for k, t in enumerate(TEMPLATES)], "template int, licence string, wording string")
    return rows.select("template", "licence", F.explode(terms(F.col("wording"))).alias("term")).groupBy("template", "licence", "term").agg(F.count("*").alias("tf"))


def _named(statement: Column) -> Column:
    """The licence that a statement of a label and a name has, wherever the label stands; the first known one of several
    labels, or of those that SPDX joins with OR or AND."""
    table = F.create_map(*(F.lit(x) for licence, names in NAMES.items() for name in names for x in (name, licence)))

    def known(name: Column) -> Column:
        rest = F.array_join(terms(name), " ")
        first = F.regexp_replace(F.element_at(F.split(rest, r" (?:or|and|with) "), 1), r"-(?:only|or-later)$", "")
        return F.coalesce(F.element_at(table, rest), F.element_at(table, first))

    each = F.transform(F.slice(F.split(statement, _LABEL), F.lit(2), F.lit(1_000_000_000)), known)
    return F.when(statement.rlike(_LABEL), F.coalesce(known(F.regexp_replace(statement, "^.*?" + _LABEL, "")),
                                                      F.get(F.array_compact(each), F.lit(0))))


class Telling:
    """Terms that a statement needs one of to reach the threshold with any template.

    Of each template's terms, by falling idf, only the last ones whose weights are too small a part of its norm are
    left out: a statement that shares no more than those has a smaller cosine, by Cauchy and Schwarz.
    """

    def __init__(self, templates: list, threshold: float):
        of: dict[int, list] = {}
        for r in templates:
            of.setdefault(r.template, []).append(r)
        self.longest = max(sum(r.tf for r in rows) for rows in of.values())
        #: Telling term -> lengths of the templates that it tells.
        self.lengths: dict[str, set[int]] = {}
        for rows in of.values():
            rows.sort(key=lambda r: (r.idf, r.term))
            least = max(0.0, threshold - 1e-6) ** 2 * sum(r.w * r.w for r in rows)
            rest = 0.0
            for r in rows:
                rest += r.w * r.w
                if rest >= least:
                    self.lengths.setdefault(r.term, set()).add(sum(x.tf for x in rows))
        #: For lower-case text; labels are found by the second part.
        self.pattern = "(?<![a-z0-9])(?:" + "|".join(t.replace(".", r"\.") for t in sorted(self.lengths)) + ")(?![a-z0-9])|licen[cs]e"

    def inside(self, text: Column) -> Column:
        return F.lower(text).rlike(self.pattern)


def statements(files: DataFrame, telling: Telling) -> DataFrame:
    """(path, n_terms, line, part, words, statement, run): the statements of every text that hold a telling term.

    ``line`` and ``part`` give the place of the first piece; ``words`` counts those of that piece alone, and 0 where it
    holds no telling term itself.  ``run`` marks runs of words inside a piece, each as long as a template.
    """
    size = telling.longest  # pieces behind the first one have a term each, so more are never needed
    found = (files.where(telling.inside(F.col("text"))).select("path", "n_terms", F.regexp_replace("text", r"\r\n?", "\n").alias("text"))
             .select("path", "n_terms", F.posexplode(F.split("text", _ENDS)).alias("line", "sentence")).where(telling.inside(F.col("sentence")))
             .select("path", "n_terms", "line", F.split("sentence", r"\n|(?<=;)\s+").alias("pieces")))
    hits = lambda pieces: F.filter(F.transform(pieces, lambda s, i: F.when(telling.inside(s), i + 1)), lambda i: i.isNotNull())
    starts = F.array_distinct(F.flatten(F.transform(hits(F.col("pieces")), lambda i: F.sequence(F.greatest(F.lit(1), i - size), i))))
    found = (found.withColumn("starts", starts)
             .select("path", "n_terms", "line", F.explode(F.transform("starts", lambda i: F.struct(i.alias("part"), F.slice("pieces", i, F.lit(size + 1)).alias("window")))).alias("q"))
             .select("path", "n_terms", "line", "q.part", "q.window"))
    count = lambda s: F.size(terms(s))
    # pieces are added while none is without terms and those added before have fewer words than the longest template
    own = F.get("window", F.lit(0))
    step = lambda a, s: (F.when((a["more"] >= size) | (count(s) == 0), F.struct(a["texts"].alias("texts"), F.lit(size).alias("more")))
                         .otherwise(F.struct(F.concat(a["texts"], F.array(F.concat_ws(" ", F.element_at(a["texts"], -1), s))).alias("texts"),
                                             (a["more"] + count(s)).alias("more"))))
    grown = F.aggregate(F.slice("window", F.lit(2), F.lit(size)), F.struct(F.array(own).alias("texts"), F.lit(0).alias("more")), step, lambda a: a["texts"])
    place = ("path", "n_terms", "line", "part")
    found = found.where(count(own) > 0).select(*place, F.when(telling.inside(own), count(own)).otherwise(0).alias("words"), own.alias("own"), grown.alias("texts"))
    found = found.withColumn("own", F.when(F.col("words") > size, terms(F.col("own"))))
    lengths = F.create_map(*(x for t, ns in sorted(telling.lengths.items()) for x in (F.lit(t), F.array(*map(F.lit, sorted(ns))))))
    told = F.filter(F.transform("own", lambda w, i: F.struct((i + 1).alias("i"), F.element_at(lengths, w).alias("ns"))), lambda t: t["ns"].isNotNull())
    runs = F.flatten(F.transform("told", lambda t: F.flatten(F.transform(t["ns"], lambda n: F.transform(
        F.sequence(F.greatest(F.lit(1), t["i"] - n + 1), F.least(t["i"], F.size("own") - n + 1)), lambda k: F.struct(k.alias("k"), n.alias("n")))))))
    entry = lambda words, statement, run: F.struct(words.alias("words"), statement.alias("statement"), F.lit(run).alias("run"))
    whole = F.transform(F.filter("texts", telling.inside), lambda s: entry(F.col("words"), s, False))
    inner = F.transform("runs", lambda r: entry(r["n"], F.array_join(F.slice("own", r["k"], r["n"]), " "), True))
    return (found.withColumn("told", told).withColumn("runs", F.array_distinct(runs))
            .select(*place, F.explode(F.when(F.col("runs").isNull(), whole).otherwise(F.concat(whole, inner))).alias("q")).select(*place, "q.*"))


def headers(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(path, licence, cosine, share): the best statement of each file that reaches the threshold.

    ``share`` is the part of the file's words that its statements with that licence make up.
    """
    spark = files.sparkSession
    templates = template_table(spark)
    vocabulary = sorted({r.term for r in templates.select("term").distinct().collect()})  # terms of the fixed templates
    known = F.array(*map(F.lit, vocabulary))
    listed = files.where("path IS NOT NULL").select("path", "text", F.size(F.split(F.trim("text"), r"\s+")).alias("n_terms"))
    held = F.array_intersect(F.split(F.lower("text"), _CUT), known)
    counted = (listed.where("text IS NOT NULL").select(F.explode(held).alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    total = listed.count()
    idf = lambda df: F.log((F.lit(total) + 1) / (df + 1)) + 1
    weights = cut(templates.join(counted, "term", "left").select("template", "licence", "term", "tf", (F.col("tf") * idf(F.coalesce("df", F.lit(0)))).alias("w"),
                                                                idf(F.coalesce("df", F.lit(0))).alias("idf")), "templates")
    weights = weights.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("template"))))
    telling = Telling(weights.select("template", "term", "tf", "w", "idf").collect(), threshold)  # fixed templates
    found = cut(statements(listed, telling).withColumn("sid", F.monotonically_increasing_id()), "statements")
    per_term = found.select("sid", F.explode(terms(F.col("statement"))).alias("term")).groupBy("sid", "term").agg(F.count("*").alias("tf"))
    rarest = float(spark.range(1).select(idf(F.lit(0))).first()[0])
    per_term = per_term.join(weights.select("term", "idf").distinct(), "term", "left").select(
        "sid", "term", (F.col("tf") * F.coalesce("idf", F.lit(rarest))).alias("sw"))
    per_term = cut(per_term, "weights")
    norms = per_term.groupBy("sid").agg(F.sqrt(F.sum(F.col("sw") * F.col("sw"))).alias("snorm"))
    close = (per_term.join(weights, "term").groupBy("sid", "template", "licence", "norm").agg(F.sum(F.col("sw") * F.col("w")).alias("dot"))
             .join(norms, "sid").select("sid", "template", "licence", F.round(F.col("dot") / F.col("norm") / F.col("snorm"), 6).alias("cosine")))
    best = close.groupBy("sid").agg(F.min(F.struct(-F.col("cosine"), "template", "licence")).alias("b")).select(
        "sid", (-F.col("b.col1")).alias("cosine"), F.col("b.template").alias("template"), F.col("b.licence").alias("licence"))
    near = found.join(best.where(F.col("cosine") >= threshold), "sid").where(~F.col("run") | (F.col("cosine") >= INSIDE)).select("path", "licence", "cosine", "line", "part", "n_terms", "words")
    labelled = found.where("not run").withColumn("licence", _named(F.col("statement"))).where("licence IS NOT NULL")
    named = near.union(labelled.select("path", "licence", F.lit(1.0).alias("cosine"), "line", "part", "n_terms", "words"))
    # a row of each place: a piece counts its words once
    named = named.groupBy("path", "licence", "line", "part").agg(F.max("cosine").alias("cosine"), F.max("n_terms").alias("n_terms"), F.max("words").alias("words"))
    return (named.groupBy("path", "licence").agg(F.min(F.struct(-F.col("cosine"), "line", "part")).alias("first"),
                                                 (F.sum("words") / F.max("n_terms")).alias("share"))
            .groupBy("path").agg(F.min(F.struct("first", "licence", "share")).alias("b"))
            .select("path", "b.licence", (-F.col("b.first.col1")).alias("cosine"), F.least("b.share", F.lit(1.0)).alias("share")))


def scan(files: DataFrame, threshold: float = THRESHOLD, mostly: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, licence, origin, cosine, licence_path) for every row of ``files`` (path, text), behind its columns ``keep``.

    ``origin`` is ``header`` (the file names its licence), ``directory`` (taken from the licence file ``licence_path`` of
    the nearest directory above) or null with a null licence.  Ties between statements go to the higher cosine, then
    the earlier place; between templates to the earlier one; between licence files of a directory to one known by its
    name, then the higher cosine, then the smaller path.  Null and empty texts have no header and can inherit; rows
    that repeat a path have the best header of them all; a null path has no licence; other columns are ignored.
    """
    found = cut(headers(files, threshold), "headers")
    folder = lambda p: F.regexp_replace(p, r"/?[^/]*$", "")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    owners = (found.withColumn("by_name", name.rlike(_NAMED)).where(F.col("by_name") | (F.col("share") >= mostly))
              .groupBy(folder(F.col("path")).alias("above")).agg(F.min(F.struct(~F.col("by_name"), -F.col("cosine"), "path", "licence")).alias("b"))
              .select("above", F.col("b.licence").alias("owner_licence"), F.col("b.path").alias("licence_path"), (-F.col("b.col2")).alias("owner_cosine")))
    owners = cut(owners, "owners")
    folders = files.where("path IS NOT NULL").select(folder(F.col("path")).alias("folder")).distinct()
    # every directory above, deepest first: the folder itself, then one part less each time
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - k), "/"))
    nearest = (folders.select("folder", F.posexplode(F.array_distinct(above)).alias("up", "above")).join(owners, "above")
               .groupBy("folder").agg(F.min(F.struct("up", "owner_licence", "licence_path", "owner_cosine")).alias("b")).select("folder", "b.*").drop("up"))
    rows = files.select("path", *keep).join(found.select("path", "licence", "cosine"), "path", "left").withColumn("folder", folder(F.col("path")))
    own = F.col("licence").isNotNull()
    return (rows.join(nearest, "folder", "left")
            .select(*keep, "path", F.coalesce("licence", "owner_licence").alias("licence"),
                    F.when(own, "header").when(F.col("owner_licence").isNotNull(), "directory").alias("origin"),
                    F.when(own, F.col("cosine")).otherwise(F.col("owner_cosine")).alias("cosine"),
                    F.when(~own, F.col("licence_path")).alias("licence_path")))
