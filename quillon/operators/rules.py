"""Rule tables as data: classification, extraction, routing, templates, requirements, drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import CLOSINGS, closing_fits, for_search, is_number_placeholder, once, squeeze, tokens, valid_official_date, valid_official_number

from .phrases import rule_hits

# Fixed value: what a letter that rests on a fixed snapshot must say.
SNAPSHOT_NOTICE = "Bu sonuç yalnızca projeyle birlikte sabitlenmiş yarışma veri kümesine dayanır; mevzuatın güncelliği/yürürlüğü doğrulanmamıştır ve güncel hukuki görüş değildir."
#: Rule tables up to this many rows are broadcast.
BROADCAST_RULES = 10_000
#: Up to this many patterns become literals of the plan.
LITERAL_RULES = 256


def small(rules: DataFrame) -> DataFrame:
    """A rule table, broadcast if it is as small as rule tables are."""
    return F.broadcast(rules) if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else rules


def token_line(text_tokens: Column) -> Column:
    """Tokens between single blanks, with one at both ends."""
    return F.concat(F.lit(" "), F.array_join(text_tokens, " "), F.lit(" "))


def phrase_pattern(phrase_tokens: Column) -> Column:
    """A pattern over token lines: contiguous tokens, those of five or more characters also as the beginning of a longer word."""
    return token_line(F.transform(phrase_tokens, lambda t: F.when(F.length(t) >= 5, F.concat(t, F.lit("[^ ]*"))).otherwise(t)))


def keyword_weight(keyword: Column, own: Column) -> Column:
    return F.coalesce(own, F.when(F.contains(keyword, F.lit(" ")), 1.5).otherwise(1.0))


def classify(docs: DataFrame, keywords: DataFrame, id_column: str = "doc_id", text_column: str = "text", default: str = "general") -> DataFrame:
    """``keywords`` (label, keyword, weight or null) over documents: label, score, confidence, matched keywords.

    Rules are tested where the documents are; only hits are shuffled. Few rules are literals of the plan, each pattern
    compiled once. Many are found by their first token, or its first five characters, and only those found are tried.
    """
    rules = keywords.withColumn("_kt", tokens(F.col("keyword"))).filter(F.size("_kt") > 0).select("label", "keyword", phrase_pattern(F.col("_kt")).alias("_p"), keyword_weight(F.col("keyword"), F.col("weight")).alias("_w"), F.left(F.get("_kt", F.lit(0)), F.lit(5)).alias("_first"))
    slim = once(docs.select(docs[id_column].alias("doc"), docs[text_column].alias("_text")), _tl=token_line(tokens(F.col("_text")))).select("doc", "_tl")
    few = rules.limit(LITERAL_RULES + 1).collect()
    if len(few) <= LITERAL_RULES:
        tried = [F.when(F.col("_tl").rlike(r["_p"]), F.struct(F.lit(r["label"]).alias("label"), F.lit(r["keyword"]).alias("keyword"), F.lit(r["_w"]).alias("_w"))) for r in few]
        met = F.array_compact(F.array(*tried)) if tried else F.array().cast("array<struct<label:string,keyword:string,_w:double>>")
        hits = slim.select("doc", F.inline(met))
    else:
        firsts = F.array_distinct(F.transform(F.split(F.trim("_tl"), " "), lambda t: F.left(t, F.lit(5))))
        found = slim.select("doc", F.explode(firsts).alias("_first")).join(small(rules), "_first").groupBy("doc").agg(F.collect_list(F.struct("label", "keyword", "_p", "_w")).alias("_r"))
        hits = slim.join(found, "doc").select("doc", "_tl", F.explode("_r").alias("r")).filter(F.expr("_tl rlike r._p")).select("doc", "r.label", "r.keyword", "r._w")
    scored = hits.groupBy("doc", "label").agg(F.sum("_w").alias("score"), F.sort_array(F.collect_set("keyword")).alias("matched"))
    best = Window.partitionBy("doc").orderBy(F.desc("score"), "label")
    ranked = scored.withColumn("_r", F.row_number().over(best)).withColumn("_second", F.lead("score").over(best)).filter("_r = 1")
    close = F.col("_second").isNotNull() & ((F.col("score") - F.col("_second") < 0.75) | (F.col("_second") >= 0.5 * F.col("score")))
    sure = F.least(0.55 + 0.09 * F.col("score"), F.lit(0.97))
    ranked = ranked.withColumn("confidence", F.round(F.when(close, F.least(sure, F.lit(0.58))).otherwise(sure), 2))
    out = slim.select("doc").join(ranked.select("doc", "label", "score", "confidence", "matched"), "doc", "left")
    return out.select("doc", F.coalesce("label", F.lit(default)).alias("label"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("confidence", F.lit(0.35)).alias("confidence"), F.coalesce("matched", F.array().cast("array<string>")).alias("matched"))


def first_match(rows: DataFrame, text: Column, rules: DataFrame, id_column: str, default: str) -> DataFrame:
    """The label of the first rule (place, phrase, label) whose phrase the text holds."""
    slim = rows.select(rows[id_column].alias("id"), text.alias("_t"))
    hits = rule_hits(slim, rules, "_t").groupBy("id").agg(F.min(F.struct("place", "label"))["label"].alias("label"))
    return slim.select("id").join(hits, "id", "left").fillna({"label": default})


def domain_scores(rows: DataFrame, text: Column, rules: DataFrame, id_column: str) -> DataFrame:
    """Weighted substring rules (domain, phrase, weight): domain, score, runner-up, and whether the two are too close."""
    slim = rows.select(rows[id_column].alias("id"), text.alias("_t"))
    sums = rule_hits(slim, rules, "_t").groupBy("id", "domain").agg(F.sum("weight").alias("score"))
    best = Window.partitionBy("id").orderBy(F.desc("score"), "domain")
    top = sums.withColumn("_r", F.row_number().over(best)).withColumn("second", F.lead("score").over(best)).filter("_r = 1").drop("_r")
    unclear = F.coalesce((F.col("second") >= 3) & (F.col("second") >= 0.55 * F.col("score")), F.lit(False))
    return top.withColumn("ambiguous", unclear)


def resolved_domain(scores: DataFrame, hint_weight: float = 5.0) -> DataFrame:
    """(id, domain, score, second) to a status: 'none' without evidence, 'unclear' with a strong runner-up, else 'resolved'."""
    strong = F.coalesce((F.col("second") >= hint_weight) & (F.col("second") >= 0.8 * F.col("score")), F.lit(False))
    return scores.withColumn("status", F.when(F.col("score") <= 0, "none").when(strong, "unclear").otherwise("resolved"))


def labelled_lines(docs: DataFrame, aliases: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fields from 'label: value' lines; a label alone takes the next line. ``aliases`` (alias, field, priority).

    Of several values of a field the highest priority wins, then the first line.
    """
    lines = docs.select(docs[id_column].alias("doc"), F.posexplode(F.split(docs[text_column], "\n")).alias("line", "_raw"))
    order = Window.partitionBy("doc").orderBy("line")
    cut = lines.withColumn("_next", F.lead("_raw").over(order)).withColumn("_label", for_search(F.regexp_extract("_raw", r"^\s*([^:]{1,60}?)\s*:", 1))).withColumn("_value", squeeze(F.regexp_extract("_raw", r"^[^:]{1,60}:(.*)$", 1)))
    found = cut.filter("_label <> ''").join(small(aliases), F.col("_label") == for_search(F.col("alias")))
    own = F.col("_value") != ""
    value = F.when(own, F.col("_value")).otherwise(squeeze(F.coalesce("_next", F.lit(""))))
    rank = F.when(own, F.col("priority")).otherwise(F.col("priority") - 15)
    best = Window.partitionBy("doc", "field").orderBy(F.desc("_rank"), "line")
    valid = found.withColumn("value", value).withColumn("_rank", rank).filter((F.col("value") != "") & ~F.col("value").rlike(r"^[\[.…_\-\s\]]+$"))
    return valid.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select("doc", "field", "value", "line")


def value_fault(field: Column, value: Column) -> Column:
    """Why an extracted value is not one, or null."""
    v = squeeze(value)
    blank = v.isNull() | (v == "") | v.rlike(r"^[\[.…_\-\s\]]+$") | (F.upper(v) == "[DOLDURULACAK]")
    return F.when(blank, "placeholder").when(F.length(v) > 300, "too_long").when((field == "sender") & (F.size(F.split(v, " ")) > 8), "too_many_words").when((field == "date") & ~valid_official_date(v), "not_a_date")


def signature_sender(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The first of the three lines after a closing phrase that looks like a name."""
    lines = docs.select(docs[id_column].alias("doc"), F.posexplode(F.filter(F.transform(F.split(docs[text_column], "\n"), squeeze), lambda x: x != "")).alias("line", "raw"))
    order = Window.partitionBy("doc").orderBy("line")
    ahead = F.array(*[F.lead("raw", k).over(order) for k in (1, 2, 3)])
    closing = "|".join(x.rstrip(".") for xs in CLOSINGS.values() for x in xs)
    after = lines.withColumn("_ahead", ahead).filter(F.col("raw").rlike(f"(?iu)(?:{closing}|arz ederim|rica ederim|sincerely|regards)[.,]?$"))
    name = F.filter("_ahead", lambda x: x.isNotNull() & x.rlike(r"^(?:\p{Lu}[\p{L}.'-]+ ){1,3}\p{Lu}[\p{L}.'-]+$"))
    return after.groupBy("doc").agg(F.min_by(F.get(name, F.lit(0)), "line").alias("sender")).filter("sender is not null")


def first_contacts(text: Column) -> Column:
    """The first mail address, phone number, numeric date and request sentence, and a two-sentence summary."""
    sentences = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), squeeze), lambda s: s != "")
    request = F.get(F.filter(sentences, lambda s: F.lower(s).rlike("(?iu)talep|rica|arz ed|request|please")), F.lit(0))
    pick = lambda p: F.nullif(F.regexp_extract(text, p, 0), F.lit(""))
    return F.struct(pick(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").alias("email"), pick(r"\+[0-9][ ().0-9-]{7,}[0-9]").alias("phone"), pick(r"\b\d{1,2}\.\d{1,2}\.\d{4}\b").alias("date"), request.alias("request"), F.array_join(F.slice(sentences, 1, 2), " ").alias("summary"))


def missing_fields(required: Column, present: Column) -> Column:
    return F.array_except(required, present)


def route(docs: DataFrame, units: DataFrame, text: Column, id_column: str = "doc_id", fallback: str | None = None, k: int = 4) -> DataFrame:
    """Ranked units (unit, keywords, responsibilities, places): 4 a keyword, 1 a responsibility token, 6 a place.

    A best score under 4 puts the fallback unit first. Only the best ``k`` of each document are kept. Few units are one
    array beside every row, in which each document ranks them by itself: no rows of pairs, no shuffle. More are matched
    in pairs, and each document's are brought together again.
    """
    slim = once(docs.select(docs[id_column].alias("doc"), for_search(text).alias("_q")), _qt=F.array_distinct(F.regexp_extract_all("_q", F.lit("[0-9a-zçğıöşü]+"), F.lit(0))))
    folded = lambda c: F.transform(c, lambda x: for_search(x))
    listed = units.select("unit", folded("keywords").alias("_k"), F.array_distinct(tokens(F.array_join("responsibilities", " "))).alias("_rt"), folded("places").alias("_p"))

    def score(u: Column) -> Column:
        held = lambda xs: F.size(F.filter(xs, lambda x: F.contains(F.col("_q"), x)))
        points = (4 * held(u["_k"]) + F.size(F.array_intersect("_qt", u["_rt"])) + 6 * held(u["_p"])).cast("double")
        # Ascending order is best first, ties by unit.
        return F.struct((-points).alias("lost"), u["unit"].alias("unit"))

    if listed.limit(LITERAL_RULES + 1).count() <= LITERAL_RULES:
        beside = listed.agg(F.collect_list(F.struct("unit", "_k", "_rt", "_p")).alias("_units"))
        each = once(slim.join(F.broadcast(beside)), _s=F.array_sort(F.transform("_units", score))).select("doc", "_s")
    else:
        # Rows of one id stay apart by their number within the id.
        numbered = slim.withColumn("_i", F.monotonically_increasing_id())
        each = numbered.join(small(listed)).select("doc", "_i", score(F.struct("unit", "_k", "_rt", "_p")).alias("_u")).groupBy("doc", "_i").agg(F.array_sort(F.collect_list("_u")).alias("_s"))
    first = F.lit(False) if fallback is None else F.get("_s", F.lit(0))["lost"] > -4
    lifted = F.concat(F.filter("_s", lambda u: u["unit"] == fallback), F.filter("_s", lambda u: u["unit"] != fallback))
    ranked = once(each, _r=F.when(first, lifted).otherwise(F.col("_s")))
    out = ranked.select("doc", "_r", F.posexplode(F.slice("_r", 1, k)).alias("_n", "_u"))
    points, second = -F.col("_u.lost"), F.coalesce(-F.get("_r", F.col("_n") + 1)["lost"], F.lit(0.0))
    margin = F.round(F.greatest(points - second, F.lit(0.0)) / F.greatest(points, F.lit(1.0)), 2)
    review = (points < 4) | ((second > 0) & (margin < 0.20))
    return out.select("doc", F.col("_u.unit").alias("unit"), points.alias("score"), (F.col("_n") + 1).alias("rank"), margin.alias("margin"), review.alias("needs_review"))


def template_for(kind: Column, table: dict[str, str], default: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), kind), F.lit(default))


def selected_rules(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """Requirement rules for documents (doc, types, evidence).

    A rule (rule, categories, types_wanted, subtypes, excluded) applies if its categories meet the types, one of its
    subtypes is in the evidence, its types meet them too unless a subtype did, and nothing excluded is there. An empty
    list asks for nothing.
    """
    some = lambda xs: F.exists(xs, lambda t: F.contains(F.col("evidence"), t))
    by_category = (F.size("categories") == 0) | F.arrays_overlap("categories", "types")
    by_subtype = (F.size("subtypes") > 0) & some(F.col("subtypes"))
    by_type = (F.size("types_wanted") == 0) | F.arrays_overlap("types_wanted", "types") | by_subtype
    applies = by_category & ((F.size("subtypes") == 0) | by_subtype) & by_type & ~some(F.col("excluded"))
    return docs.join(small(rules), applies).select("doc", "rule")


def with_sources(rules: DataFrame, sources: DataFrame) -> DataFrame:
    return rules.join(sources, "source")


def draft(subject: Column, summary: Column, closing: Column, fields: Column, required: Column) -> Column:
    """Paragraphs, closing and missing fields of a letter, from the document's own fields."""
    return F.struct(F.concat(F.lit("Konu: "), F.coalesce(subject, F.lit("[DOLDURULACAK]"))).alias("heading"), F.filter(F.array(summary), lambda p: F.trim(p) != "").alias("paragraphs"), closing.alias("closing"), F.array_except(required, F.map_keys(fields)).alias("missing"))


# Templates that a letter may have, what its metadata must name, and the version of its rules.
TEMPLATES = ["ust_yazi_v1", "cevap_yazisi_v1", "bilgilendirme_yazisi_v1", "eksik_bilgi_talebi_v1"]
LETTER_METADATA = ["template_version", "data_class", "routing_unit_id", "official_writing_rules"]
LETTER_LISTS = ["attachments", "distribution", "interest", "contact", "initials"]


def compliance(letter: dict[str, Column], rules_version: str) -> Column:
    """Errors and warnings of a letter, its score, and whether it passed, which it does without errors.

    ``letter``: texts template, selected_template, institution, subject, recipient, date, number, relation, closing,
    signer, signer_title, signature (null or empty: not given); arrays of texts paragraphs, attachments, distribution,
    interest, contact, initials, missing_fields; metadata, a map of texts; references, an array of structs (verified,
    snapshot, relied_on, notice). A date, number or signature that is not given is a warning; given and malformed, a
    date or number is an error. The body ends with its one closing. Of 15 checks each error costs one, a warning 0.04.
    """
    given = lambda name: F.coalesce(letter[name] != "", F.lit(False))
    paragraphs, references = letter["paragraphs"], letter["references"]
    closings = F.array(*[F.lit(x) for x in sorted({x for xs in CLOSINGS.values() for x in xs})])
    known = letter["relation"].isin(list(CLOSINGS))
    ends = (F.size(F.filter(paragraphs, lambda p: F.array_contains(closings, F.trim(p)))) == 1) & (F.element_at(paragraphs, -1) == letter["closing"])

    def repeats(name: str) -> Column:
        folded = F.transform(letter[name], lambda x: F.lower(F.trim(x)))
        return F.exists(folded, lambda x: x == "") | (F.size(F.array_distinct(folded)) < F.size(folded))

    unsigned = F.filter(F.array(F.when(~given("signer"), F.lit("imzalayan")), F.when(~given("signer_title"), F.lit("unvan"))), lambda x: x.isNotNull())
    declared = F.size(F.array_except(unsigned, letter["missing_fields"])) == 0
    metadata = F.size(F.array_except(F.array(*[F.lit(k) for k in LETTER_METADATA]), F.map_keys(letter["metadata"]))) > 0
    snapshot = F.exists(references, lambda r: r["snapshot"])
    errors = {
        "template": ~letter["template"].isin(TEMPLATES), "template_differs": letter["template"] != letter["selected_template"],
        "institution": ~given("institution"), "subject": ~given("subject"), "recipient": ~given("recipient"),
        "date": given("date") & ~valid_official_date(letter["date"]), "number": given("number") & ~is_number_placeholder(letter["number"]) & ~valid_official_number(letter["number"]),
        "body": F.size(paragraphs) == 0, "relation": ~known, "closing": known & ~closing_fits(letter["closing"], letter["relation"]), "ending": ~F.coalesce(ends, F.lit(False)),
        **{name: repeats(name) for name in LETTER_LISTS},
        "metadata": metadata, "rules_version": ~metadata & (F.element_at(letter["metadata"], "official_writing_rules") != rules_version),
        "unverified_reference": F.exists(references, lambda r: ~r["verified"]), "signer": (F.size(unsigned) > 0) & ~declared,
        "snapshot_notice": snapshot & ~F.array_contains(paragraphs, SNAPSHOT_NOTICE), "snapshot_relied_on": F.exists(references, lambda r: r["snapshot"] & (r["relied_on"] | (r["notice"] != SNAPSHOT_NOTICE))),
    }
    warnings = {"date": ~given("date"), "number": ~given("number") | is_number_placeholder(letter["number"]), "no_reference": F.size(references) == 0, "signer": (F.size(unsigned) > 0) & declared, "signature": ~given("signature"), "snapshot": snapshot, "missing_fields": F.size(letter["missing_fields"]) > 0}
    lists = [F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks.items()])) for checks in (errors, warnings)]
    score = F.round(F.greatest(F.lit(0.0), 1 - F.size(lists[0]) / 15 - 0.04 * F.size(lists[1])), 2)
    return F.struct(lists[0].alias("errors"), lists[1].alias("warnings"), score.alias("score"), (F.size(lists[0]) == 0).alias("passed"))
