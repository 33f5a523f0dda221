"""Personal data by weak supervision, in DataFrame functions only.

1. Candidates: matches of the base patterns that pass their checks, and looser forms beside them.
2. Labelers vote on each candidate: the pattern's own shape, gazetteers, context that speaks for it, context that speaks
   against it, and its borders.  A vote is 1, 0 or -1 (abstains).
3. Expectation-maximisation over the counts of vote patterns estimates, for each kind, the share of true spans and how
   far each labeler can be relied on.
4. A logistic span classifier is fitted to the estimated labels on votes and form, and decides on the looser
   candidates.  Base spans always stay.

The texts are read once; steps 3 and 4 see at most a few hundred distinct vote patterns of each kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procatlas.session import cut

#: Kinds in the order of the results.
KINDS = ("email", "ip", "card", "phone", "id")
LABELERS = 5
FORMS = 2
EM_ROUNDS = 30
FIT_ROUNDS = 200

# Possessive runs and look-behinds change no match; they keep long runs of the same characters linear.
_LOCAL = "A-Za-z0-9._%+-"
_EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_DIGIT_RUN = r"[0-9][0-9\x20-]{15,}"
_LOOSE_EMAIL = r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63}){1,8}"
_LOOSE_PHONE = r"(?:\([0-9]{3}\) ?|(?<![0-9])[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])"
_LOOSE_ID = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

#: Gazetteers and context words (fixed values).
TOP_DOMAINS = ("com org net edu gov mil int info biz eu uk us ca au de fr es it nl be ch at pl pt se no dk fi ie br mx ar cl co "
               "jp cn in kr ru io me dev app").split()
_FOR = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|reach|write|correo|kontakt|courriel|adresse|from|to)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|client|login|logged|from|node|adresse|servidor)\b",
    "card": r"(?i)\b(?:card|credit|debit|visa|mastercard|amex|payment|carte|tarjeta|karte|pan)\b",
    "phone": r"(?i)\b(?:phone|tel|telefon|telephone|téléphone|teléfono|call|mobile|cell|fax|contact)\b",
    "id": r"(?i)\b(?:ssn|social|security|tax|taxpayer|identity|identification)\b",
}
_AGAINST = {
    "email": r"(?i)\b(?:git|ssh|scp|version)\b",
    "ip": r"(?i)\b(?:version|release|section|chapter|v|ver|clause)\b",
    "card": r"(?i)\b(?:isbn|order|tracking|invoice|serial|hash|checksum)\b",
    "phone": r"(?i)\b(?:isbn|order|invoice|serial|part|model|version|room)\b",
    "id": r"(?i)\b(?:isbn|order|part|model|serial|version|room)\b",
}
_CONTEXT = 40

_SPANS = "array<struct<s:int,e:int,v:string>>"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def _pieces(found: Column, gaps: Column) -> Column:
    """(start, end, value) of ``found`` that stand between ``gaps``, in code points."""
    return _let(F.struct(found.alias("found"), gaps.alias("gaps")), lambda b: _placed(b["found"], b["gaps"]))


def _placed(found: Column, gaps: Column) -> Column:
    places = F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1)).otherwise(F.array().cast("array<int>"))
    ends = F.aggregate(places, F.array(F.lit(0)).cast("array<int>"), lambda acc, k: F.array_append(
        acc, F.element_at(acc, -1) + F.length(F.get(gaps, k)) + F.length(F.get(found, k))))
    return _let(ends, lambda e: F.transform(places, lambda k: F.struct(
        (F.get(e, k) + F.length(F.get(gaps, k))).alias("s"), F.get(e, k + 1).alias("e"), F.get(found, k).alias("v"))))


def spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<s, e, v>>; code points, end exclusive."""
    return _pieces(F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1))


def _if(condition: Column, value: Column) -> Column:
    return F.when(condition, value).otherwise(F.array().cast(_SPANS))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    digits = F.reverse(_digits(v))
    value = lambda i: F.substring(digits, i, 1).cast("int")
    doubled = lambda i: F.when(i % 2 == 0, value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0)).otherwise(value(i))
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + doubled(i))
    return F.length(digits).between(16, 19) & (total % 10 == 0)


def _byte_parts(v: Column) -> Column:
    return F.forall(F.split(v, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _card_runs(text: Column) -> Column:
    """``[0-9]([ -]?[0-9])+`` of at least 16 characters: longest runs of digits and single separators.

    A run of digits and separators is cut where two separators meet; this needs no nested repetition, which would
    overflow on very long runs.
    """
    parts = lambda r: _pieces(F.split(r["v"], r"[\x20-]{2,}", -1),
                              F.concat(F.array(F.lit("")), F.regexp_extract_all(r["v"], F.lit(r"[\x20-]{2,}"), 0)))
    shifted = lambda r: F.transform(parts(r), lambda p: F.struct(
        (r["s"] + p["s"]).alias("s"), (r["s"] + p["s"] + F.length(F.regexp_replace(p["v"], r"[\x20-]+$", ""))).alias("e"),
        F.regexp_replace(p["v"], r"[\x20-]+$", "").alias("v")))
    return F.flatten(F.transform(spans(text, _DIGIT_RUN), shifted))


def base_spans(text: Column) -> dict[str, Column]:
    """Base spans of each kind that pass their checks."""
    return {
        "email": _if(F.instr(text, "@") > 0, spans(text, _EMAIL)),
        "ip": _if(text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), F.filter(spans(text, _IP), lambda m: _byte_parts(m["v"]))),
        "card": _if(text.rlike(_DIGIT_RUN), F.filter(_card_runs(text), lambda m: _luhn(m["v"]))),
        "phone": _if(F.instr(text, "+") > 0, F.filter(spans(text, _PHONE), lambda m: F.length(_digits(m["v"])).between(8, 15))),
    }


def _loose_spans(text: Column) -> dict[str, Column]:
    return {
        "email": _if(text.rlike(r"[(\[]at[)\]]"), spans(text, _LOOSE_EMAIL)),
        "phone": _if(text.rlike(r"[0-9]{3}\)? ?[-. ]?[0-9]{3}[-. ][0-9]{4}"), spans(text, _LOOSE_PHONE)),
        "id": _if(text.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), spans(text, _LOOSE_ID)),
    }


def _gazetteer(kind: str, v: Column) -> Column:
    """1 when a list or numbering plan knows the value, else 0."""
    digits = _digits(v)
    known = {
        "email": F.lower(F.regexp_extract(v, r"([A-Za-z0-9-]+)$", 1)).isin(TOP_DOMAINS),
        "ip": ~F.regexp_extract(v, r"^0*([0-9]+)", 1).isin("", "0", "127", *map(str, range(224, 256))),
        "card": F.substring(digits, 1, 1).isin("2", "3", "4", "5", "6"),
        "phone": F.when(v.startswith("+"), ~digits.startswith("0")).otherwise(F.regexp_extract(digits, "^(.)", 1).isin(*"23456789")),
        "id": ~(digits.startswith("000") | digits.startswith("666") | digits.startswith("9")),
    }[kind]
    return known.cast("int")


def _voted(text: Column, kind: str, found: Column, base: bool) -> Column:
    """Candidates of one kind with votes and form."""
    before = lambda m: F.substring(text, F.greatest(m["s"] - _CONTEXT + 1, F.lit(1)), F.least(m["s"], F.lit(_CONTEXT)))
    border = lambda m: F.when(F.substring(text, m["e"] + 1, 1).rlike(r"[\p{L}0-9_]")
                              | ((m["s"] > 0) & F.substring(text, m["s"], 1).rlike(r"[\p{L}0-9_]")), 0).otherwise(1)
    return F.transform(found, lambda m: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), m["s"].alias("s"), m["e"].alias("e"), F.lit(base).alias("base"),
        F.array(F.lit(1 if base else -1), _gazetteer(kind, m["v"]), F.when(before(m).rlike(_FOR[kind]), 1).otherwise(-1),
                F.when(before(m).rlike(_AGAINST[kind]), 0).otherwise(-1), border(m)).alias("votes"),
        F.array((F.length(m["v"]) >= 12).cast("int"), m["v"].rlike(r"[()\[\]]").cast("int")).alias("form")))


def with_candidates(docs: DataFrame, name: str = "found") -> DataFrame:
    """``docs`` and a column of the candidates in ``text`` with their votes."""
    text = F.coalesce("text", F.lit(""))
    base, loose = base_spans(text), _loose_spans(text)
    found = docs.select("*", *(c.alias(f"__base_{k}") for k, c in base.items()), *(c.alias(f"__loose_{k}") for k, c in loose.items()))
    own = F.concat(*(_voted(text, k, F.col(f"__base_{k}"), True) for k in base))
    more = F.concat(*(_voted(text, k, F.col(f"__loose_{k}"), False) for k in loose))
    found = found.select(*docs.columns, own.alias("__own"), more.alias("__more"))
    free = F.filter("__more", lambda c: ~F.exists("__own", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
    return found.select(*docs.columns, F.concat("__own", free).alias(name))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, found) for every row."""
    return with_candidates(docs.select("doc_id", "text")).select("doc_id", "found")


def _sum(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, p: s + value(p))


def span_model(found: DataFrame) -> dict[int, list[float]]:
    """Weights of the span classifier by kind: intercept, votes, forms.

    The input of the estimation is one row per kind with the counts of its distinct patterns.
    """
    patterns = (found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes", "c.form").agg(F.count("*").cast("double").alias("n"))
                .groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("votes", "form", "n"))).alias("pats")))
    places = F.array(*map(F.lit, range(LABELERS)))
    kind_of = "struct<share:double,a:array<double>,b:array<double>>"
    start = F.struct(F.lit(0.5).alias("share"), F.array_repeat(F.lit(0.8), LABELERS).alias("a"),
                     F.array_repeat(F.lit(0.3), LABELERS).alias("b")).cast(kind_of)

    def fits(votes: Column, rates: Column) -> Column:
        """Probability of the votes, given how often each labeler says yes."""
        return F.aggregate(places, F.lit(1.0), lambda p, j: p * F.when(F.get(votes, j) == 1, F.get(rates, j))
                           .when(F.get(votes, j) == 0, 1 - F.get(rates, j)).otherwise(1.0))

    def judged(m: Column) -> Column:
        return F.transform("pats", lambda p: _let(
            F.struct((m["share"] * fits(p["votes"], m["a"])).alias("y"), ((1 - m["share"]) * fits(p["votes"], m["b"])).alias("z")),
            lambda t: F.struct(p["votes"].alias("votes"), p["form"].alias("form"), p["n"].alias("n"), (t["y"] / (t["y"] + t["z"])).alias("r"))))

    def better(q: Column) -> Column:
        yes = lambda w, j: _sum(q, lambda p: F.when(F.get(p["votes"], j) == 1, w(p)).otherwise(0.0))
        any_ = lambda w, j: _sum(q, lambda p: F.when(F.get(p["votes"], j) >= 0, w(p)).otherwise(0.0))
        true, false = (lambda p: p["n"] * p["r"]), (lambda p: p["n"] * (1 - p["r"]))
        return F.struct(((_sum(q, true) + 1) / (_sum(q, lambda p: p["n"]) + 2)).alias("share"),
                        F.transform(places, lambda j: (yes(true, j) + 4) / (any_(true, j) + 5)).alias("a"),
                        F.transform(places, lambda j: (yes(false, j) + 1) / (any_(false, j) + 5)).alias("b")).cast(kind_of)

    em = F.aggregate(F.sequence(F.lit(1), F.lit(EM_ROUNDS)), start, lambda m, i: _let(judged(m), better))
    labelled = cut(patterns.select("kind", "pats", em.alias("m")).select("kind", judged(F.col("m")).alias("q")), "reliability")

    size = 1 + LABELERS + FORMS
    feature = lambda p: F.concat(F.array(F.lit(1.0)), F.transform(p["votes"], lambda v: F.when(v == 1, 1.0).when(v == 0, -1.0).otherwise(0.0)),
                                 F.transform(p["form"], lambda v: v.cast("double")))
    rows = F.transform("q", lambda p: F.struct(feature(p).alias("x"), (p["n"] / _sum(F.col("q"), lambda t: t["n"])).alias("n"), p["r"].alias("r")))
    dot = lambda w, x: F.aggregate(F.zip_with(w, x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    errors = lambda w: F.transform("rows", lambda p: F.struct(
        p["x"].alias("x"), (p["n"] * (p["r"] - 1 / (1 + F.exp(-dot(w, p["x"]))))).alias("g")))
    dims = F.array(*map(F.lit, range(size)))
    down = lambda w: _let(errors(w), lambda e: F.transform(
        dims, lambda d: F.get(w, d) * 0.999 + 2.0 * _sum(e, lambda p: p["g"] * F.get(p["x"], d)))).cast("array<double>")
    fit = F.aggregate(F.sequence(F.lit(1), F.lit(FIT_ROUNDS)), F.array_repeat(F.lit(0.0), size).cast("array<double>"), lambda w, i: down(w))
    # one row of weights for each of the five kinds
    return {r.kind: list(r.w) for r in labelled.select("kind", rows.alias("rows")).select("kind", fit.alias("w")).collect()}


def _accepted(weights: dict[int, list[float]], found: str = "found") -> Column:
    """Candidates that stay: base spans, and others the classifier takes."""
    def takes(c: Column) -> Column:
        out = F.lit(False)
        for kind, w in weights.items():
            z = F.lit(float(w[0]))
            for j in range(LABELERS):
                v = F.get(c["votes"], F.lit(j))
                z = z + F.when(v == 1, float(w[1 + j])).when(v == 0, -float(w[1 + j])).otherwise(0.0)
            for j in range(FORMS):
                z = z + F.get(c["form"], F.lit(j)) * float(w[1 + LABELERS + j])
            out = F.when(c["kind"] == kind, z >= 0).otherwise(out)
        return out

    return F.filter(found, lambda c: c["base"] | takes(c))


def _shown(items: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(items, lambda c: F.concat_ws(":", F.get(name, c["kind"]), c["s"], c["e"])), ",")


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found) for every row of (doc_id, text).

    Counts and digest are of the base spans; ``spans`` shows all of them as kind:start:end, ordered by kind and start.
    ``found`` holds the spans as structs.  Null and empty texts have none; rows with null or repeated doc_ids are kept as
    they are; other columns are ignored; an empty table gives an empty result.
    """
    stored = cut(candidates(docs), "candidates")
    kept = stored.select("doc_id", F.array_sort(F.transform(_accepted(span_model(stored)), lambda c: F.struct(
        c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"), c["base"].alias("base")))).alias("found"))
    own = F.filter("found", lambda c: c["base"])
    count = lambda k: F.size(F.filter("found", lambda c: c["base"] & (c["kind"] == KINDS.index(k)))).cast("long").alias(f"n_{k}")
    return kept.select("doc_id", *map(count, KINDS[:4]), F.sha2(_shown(own), 256).alias("base_sha256"), _shown(F.col("found")).alias("spans"), "found")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each found span of ``text`` replaced by its kind in angle brackets, all other columns as they are.

    Overlapping spans are replaced together, under the kind that begins first.  ``n_chars``, if there, is counted anew.
    Candidates are found once to fit the classifier and once more beside the text, so the text is never shuffled.
    """
    weights = span_model(cut(candidates(docs), "candidates"))
    inner = with_candidates(docs, "__found")
    spans_ = F.array_sort(F.transform(_accepted(weights, "__found"), lambda c: F.struct(c["s"].alias("s"), (-c["e"]).alias("e"), c["kind"].alias("kind"))))
    name = F.array(*map(F.lit, KINDS))
    kind_of = "struct<at:int,out:array<string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")).cast(kind_of)
    step = lambda acc, c: F.when(c["s"] < acc["at"], F.struct(F.greatest(acc["at"], -c["e"]).alias("at"), acc["out"].alias("out")).cast(kind_of)).otherwise(
        F.struct((-c["e"]).alias("at"), F.concat(acc["out"], F.array(F.substring(F.col("text"), acc["at"] + 1, c["s"] - acc["at"]),
                                                                      F.concat(F.lit("<"), F.get(name, c["kind"]), F.lit(">")))).alias("out")).cast(kind_of))
    whole = F.aggregate("__spans", start, step, lambda acc: F.concat(
        F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    out = inner.withColumn("__spans", spans_)
    out = out.withColumn("text", F.when(F.size("__spans") > 0, whole).otherwise(F.col("text"))).drop("__found", "__spans")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
