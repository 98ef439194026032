"""Contracts and gates: blockers, referential checks, text layers, redaction, evidence checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import is_relative_path, is_sha256, is_web_address, masked, squeeze


def blockers(checks: dict[str, Column]) -> Column:
    """The names of the conditions that hold, in order; a condition that is null blocks."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks.items()]))


# What the gates accept.
VERIFIED_TEXT = ["text_layer_available", "ocr_verified"]
SNAPSHOT_TEXT = ["text_layer_available", "ocr_candidate_unverified"]
SNAPSHOT_STATUS = "competition_snapshot_not_currentness_verified"
PUBLIC_DOMAINS = ["official_writing", "general_application", "kgm_infrastructure", "road_transport"]
PROJECT_DOMAINS = ["aviation", "communications", "official_writing", "general_application", "internal_administration", "kgm_infrastructure", "maritime", "railway", "road_transport"]


def _blank(name: str) -> Column:
    return F.trim(F.col(name)) == ""


def _source_faults(domains: list[str]) -> dict[str, Column]:
    """What every gate of chunks asks of a source: its digest, its domain and its pages."""
    return {"source_sha256": ~is_sha256(F.col("source_sha256")), "domain": ~F.col("domain").isin(domains), "pages": F.col("page").isNull() | F.col("page_end").isNull() | (F.col("page_end") < F.col("page"))}


def public_blockers() -> Column:
    """Why a chunk (columns as in the chunk schema) may not be shown as a public source; null blocks."""
    required = {f"no_{c}": _blank(c) for c in ("title", "section", "article", "text", "source", "context_text")}
    return blockers({
        "source_kind": F.col("source_kind") != "public_legislation", "not_approved": ~F.col("approved_for_active_rag"), "validity": F.col("validity_status") != "verified", "text_status": ~F.col("ocr_status").isin(VERIFIED_TEXT),
        "no_document_id": F.col("document_id") == "", **required, "source_url": ~is_web_address(F.col("source_url")), **_source_faults(PUBLIC_DOMAINS),
    })


def snapshot_blockers() -> Column:
    """Why a chunk may not be part of a fixed snapshot, which must not claim to be current law; null blocks, but for the address."""
    required = {f"no_{c}": _blank(c) for c in ("title", "section", "text", "source", "context_text")}
    path = F.coalesce((F.trim("source") != "") & ~is_relative_path(F.col("source")), F.lit(False))
    return blockers({
        "source_kind": F.col("source_kind") != "competition_snapshot", "active": F.col("approved_for_active_rag"), "validity": F.col("validity_status") != "needs_verification", "status": F.col("status") != SNAPSHOT_STATUS, "text_status": ~F.col("ocr_status").isin(SNAPSHOT_TEXT),
        "no_document_id": F.col("document_id") == "", **required, "source_path": path, "source_url": F.col("source_url").isNotNull() & ~is_web_address(F.col("source_url")), **_source_faults(PROJECT_DOMAINS),
    })


def manifest_blockers() -> Column:
    """Why a manifest record may not be activated; null blocks."""
    return blockers({
        "document_id": F.col("document_id") == "", "review": F.col("review_status") != "approved", "scope": F.col("scope_status") != "active", "validity": F.col("validity_status") != "verified", "file": (F.col("pdf_status") != "MATCHED") | (F.col("files") != 1),
        "text": ~F.col("text_layer_status").isin("available", "ocr_verified"), "ocr": F.col("ocr_required"), "reviewer": _blank("reviewed_by"), "reviewed_at": F.col("reviewed_at").isNull(), "source_sha256": ~is_sha256(F.col("source_sha256")), "domain": ~F.col("domain").isin(PUBLIC_DOMAINS),
    })


def ingestion_blockers() -> Column:
    return blockers({"quality": F.col("quality") != "uygun", "chunks": F.col("chunk_count") == 0, "sections": F.col("article_count") == 0, "approval": ~F.col("approved")})


def envelope_faults(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document, declared, found, fault): counts that differ, chunks without document, documents without chunks."""
    counts = chunks.groupBy("document").agg(F.count(F.lit(1)).alias("found"))
    both = documents.select(F.col("document").alias("_d"), F.col("chunk_count").alias("declared")).join(counts, F.col("_d") == F.col("document"), "full_outer")
    fault = F.when(F.col("_d").isNull(), "orphan_chunks").when(F.col("found").isNull(), "no_chunks").when(F.col("declared") != F.col("found"), "count_differs")
    return both.select(F.coalesce("_d", "document").alias("document"), "declared", F.coalesce("found", F.lit(0)).cast("long").alias("found"), fault.alias("fault")).filter("fault is not null")


def manifest(records: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Records with the files of their key: MATCHED, MISSING or DUPLICATE."""
    found = files.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("path"))
    out = records.join(found, records[key] == found["_k"], "left").drop("_k").fillna({"files": 0})
    return out.withColumn("pdf_status", F.when(F.col("files") == 0, "MISSING").when(F.col("files") == 1, "MATCHED").otherwise("DUPLICATE"))


def manifest_summary(records: DataFrame, source_records: int, unmatched: int) -> DataFrame:
    """One row: the counts of a manifest's records by state, their domains, and what its caller counted.

    ``records`` (pdf_status, candidate, approved, scope_status, ocr_required, text_layer_status, domain); a null state
    counts nowhere, and as the domain 'unknown'. Domains are few, so their counts meet in one map, in order.
    """
    states = {
        "matched_pdf": F.col("pdf_status") == "MATCHED", "missing_pdf": F.col("pdf_status") == "MISSING", "duplicate_pdf": F.col("pdf_status") == "DUPLICATE", "candidates": F.col("candidate"), "approved": F.col("approved"),
        "review_required": F.col("scope_status") == "review_required", "out_of_scope": F.col("scope_status") == "out_of_scope", "ocr_required": F.col("ocr_required"), "read_errors": F.col("text_layer_status") == "read_error", "not_inspected": F.col("text_layer_status") == "not_inspected",
    }
    by_domain = records.groupBy(F.coalesce("domain", F.lit("unknown")).alias("_d")).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(c).alias(k) for k, c in states.items()])
    sums = by_domain.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("records"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in states], F.map_from_entries(F.array_sort(F.collect_list(F.struct("_d", "_n")))).alias("domains"))
    return sums.select(F.lit(source_records).cast("long").alias("source_records"), "records", *states, F.lit(unmatched).cast("long").alias("unmatched_files"), "domains")


def unmatched_files(records: DataFrame, files: DataFrame, key: str) -> DataFrame:
    return files.join(records, key, "left_anti")


def merged(old: DataFrame, updates: DataFrame, key: str, columns: list[str], digest: str | None = None) -> DataFrame:
    """Keyed update; null leaves a value. Unknown keys, repeated keys and changed digests make rows of ``fault``."""
    new = updates.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_new_{c}") for c in columns], *([F.col(digest).alias("_digest")] if digest else []), F.count(F.lit(1)).over(Window.partitionBy(key)).alias("_times"))
    both = old.withColumn("_old", F.lit(True)).join(new, F.col(key) == F.col("_k"), "full_outer")
    fault = F.when(F.col("_old").isNull(), "unknown_key").when(F.col("_times") > 1, "repeated_key")
    if digest:
        fault = fault.when(F.col("_digest") != F.col(digest), "digest_differs")
    values = [F.when(fault.isNull(), F.coalesce(f"_new_{c}", c)).otherwise(F.col(c)).alias(c) if c in columns else F.coalesce(F.col(c), F.col("_k")).alias(c) if c == key else F.col(c) for c in old.columns]
    return both.select(*values, fault.alias("fault"))


def absent(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet: what a resumed job still has to do."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def text_layer(pages: DataFrame) -> DataFrame:
    """Quality of each document's (doc, page, text) text layer, with the reasons for which it needs OCR."""
    n = F.length(F.trim("text"))
    agg = pages.groupBy("doc").agg(F.sum(n).alias("characters"), F.count(F.lit(1)).alias("pages"), F.avg(n).alias("_avg"), F.avg(F.when(n >= 80, 1.0).otherwise(0.0)).alias("_share"), F.max(F.contains("text", F.lit("�"))).alias("_broken"))
    reasons = blockers({"few_characters": F.col("_avg") < 200, "few_readable_pages": F.col("_share") < 0.70, "replacement_characters": F.col("_broken")})
    out = agg.select("doc", "characters", "pages", F.round("_avg", 2).alias("average"), F.round("_share", 3).alias("readable_share"), reasons.alias("reasons"))
    return out.withColumn("quality", F.when(F.size("reasons") > 0, "yetersiz").otherwise("uygun"))


def merged_pages(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """Weak pages replaced by their OCR text where that is readable, then each document's pages joined in order."""
    better = pages.join(ocr.select("doc", "page", F.col("text").alias("_o")), ["doc", "page"], "left")
    weak = (F.length(F.trim("text")) < 80) & (F.length(F.trim("_o")) > F.length(F.trim("text")))
    chosen = better.select("doc", F.struct("page", F.when(weak, F.col("_o")).otherwise(F.col("text")).alias("text")).alias("_p"))
    return chosen.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list("_p")), lambda p: p["text"]), "\n\n").alias("text"))


def ocr_lines(words: DataFrame) -> DataFrame:
    """(doc, page, x, y, text, confidence) words in reading order: bands of eight pixels, then left to right."""
    band = F.floor(F.col("y") / 8)
    rows = words.groupBy("doc", "page", band.alias("band")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "text"))), lambda w: w["text"]), " ").alias("text"), F.round(F.avg("confidence"), 4).alias("confidence"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    return rows


def ocr_pages(words: DataFrame) -> DataFrame:
    return words.groupBy("doc", "page").agg(F.round(F.avg("confidence"), 4).alias("mean"), F.round(F.min("confidence"), 4).alias("least"), F.round(F.avg(F.when(F.col("confidence") < 0.5, 1.0).otherwise(0.0)), 4).alias("low_share"))


def ocr_documents(pages: DataFrame) -> DataFrame:
    """Means of page means; pages without words count as empty."""
    return pages.groupBy("doc").agg(F.round(F.avg("mean"), 4).alias("mean"), F.min("least").alias("least"), F.count_if(F.col("mean").isNull()).alias("empty_pages"))


def unit_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return F.struct(clamp(x0 / width).alias("x0"), clamp(y0 / height).alias("y0"), clamp(x1 / width).alias("x1"), clamp(y1 / height).alias("y1"))


# Patterns of personal data and secrets.
PERSONAL = {"IBAN": r"(?i)\bTR\s*\d{2}(?:\s*\d){22}\b", "EMAIL": r"(?i)(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+(?![\w.-])", "PHONE": r"(?<!\d)(?:\+?90\s*)?0?5\d{2}(?:[\s().-]*\d){7}(?!\d)"}
SECRET = {"API_TOKEN": r"(?i)\b(?:AIza[0-9A-Za-z_-]{20,}|sk-[0-9A-Za-z_-]{16,}|gh[pousr]_[0-9A-Za-z]{20,}|Bearer\s+[0-9A-Za-z._~-]{16,})\b"}
SECRET_FIELDS = ["apikey", "authorization", "accesstoken", "refreshtoken", "password", "parola", "secret", "token"]
CITIZEN = r"(?<!\d)[1-9]\d{10}(?!\d)"


def valid_citizen_number(c: Column) -> Column:
    """The tenth and eleventh digit of a national number check the others."""
    d = F.transform(F.split(c, ""), lambda x: x.cast("int"))
    total = lambda places: sum((F.get(d, F.lit(i)) for i in places), F.lit(0))
    tenth = F.pmod(total(range(0, 9, 2)) * 7 - total(range(1, 8, 2)), F.lit(10))
    return F.coalesce((F.get(d, F.lit(9)) == tenth) & (F.get(d, F.lit(10)) == total(range(10)) % 10), F.lit(False))


def private_findings(text: Column, patterns: dict[str, str] | None = None) -> Column:
    """struct(kind, sample) of personal data and secrets; samples are masked."""
    found = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), _finding(kind)) for kind, p in (patterns or PERSONAL | SECRET).items()]
    if patterns is None:
        citizens = F.filter(F.regexp_extract_all(text, F.lit(CITIZEN), F.lit(0)), valid_citizen_number)
        found.append(F.transform(citizens, _finding("TCKN")))
    return F.concat(*found)


def _finding(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), masked(x).alias("sample"))


def redacted(text: Column, patterns: dict[str, str] | None = None) -> Column:
    """The text with each finding replaced by its kind; national numbers only if their check digits are right."""
    for kind, p in (patterns or PERSONAL | SECRET).items():
        text = F.regexp_replace(text, p, f"[{kind}]")
    if patterns is None:
        parts = F.split(text, CITIZEN, -1)
        numbers = F.transform(F.regexp_extract_all(text, F.lit(CITIZEN), F.lit(0)), lambda x: F.when(valid_citizen_number(x), F.lit("[TCKN]")).otherwise(x))
        text = F.when(text.rlike(CITIZEN), F.concat(F.array_join(F.zip_with(F.slice(parts, 1, F.size(numbers)), numbers, lambda a, b: F.concat(a, b)), ""), F.element_at(parts, -1))).otherwise(text)
    return text


def redacted_map(m: Column) -> Column:
    """A map of fields with the values of secret-named ones gone and the others redacted."""
    names = F.array(*[F.lit(n) for n in SECRET_FIELDS])
    return F.transform_values(m, lambda k, v: F.when(F.array_contains(names, F.regexp_replace(F.lower(k), "[^a-z]", "")), F.lit("[SECRET]")).otherwise(redacted(v)))


def allowed_by_class(data_class: Column, destination: Column) -> Column:
    """Whether data of a class may go to a destination: only synthetic and public data leave."""
    return F.when(destination == "local", True).when(data_class.isin("synthetic", "public"), True).otherwise(False)


def cited_evidence(rows: DataFrame) -> DataFrame:
    """(cited, allowed, quote, source_text, lines, known_lines): faults of a proposal's evidence."""
    return rows.withColumn("faults", blockers({"not_allowed": F.size(F.array_except("cited", "allowed")) > 0, "quote": ~F.contains(F.lower(squeeze(F.col("source_text"))), F.lower(squeeze(F.col("quote")))), "line": F.size(F.array_except("lines", "known_lines")) > 0}))


def evidence_confidence(lines: DataFrame) -> DataFrame:
    """Mean confidence of each decision's lines: 1 without one, and 0 without a place where places are asked for."""
    return lines.groupBy("decision").agg(F.round(F.avg(F.coalesce("confidence", F.lit(1.0))), 4).alias("confidence"), F.round(F.avg(F.when(F.col("bbox").isNull(), 0.0).otherwise(F.coalesce("confidence", F.lit(1.0)))), 4).alias("placed_confidence"))


def decision(checks: dict[str, Column]) -> Column:
    """struct(checks, applied): all named checks must pass."""
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in checks.items()])
    return F.struct(each.alias("checks"), F.forall(each, lambda c: c["passed"]).alias("applied"))


def kept_or_all(items: Column, accepted: Column) -> Column:
    """The accepted ones, or all if none is."""
    both = F.array_intersect(items, accepted)
    return F.when(F.size(both) > 0, both).otherwise(items)


def proposal_applied(choice: Column, allowed: Column, confidence: Column, flagged: Column, least: float = 0.80) -> Column:
    return F.array_contains(allowed, choice) & (confidence >= least) & ~F.coalesce(flagged, F.lit(False))


def inventory_match(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Files by path: whether bytes and digest are as listed."""
    both = expected.join(found.select("path", F.col("bytes").alias("_b"), F.col("sha256").alias("_s")), "path", "left")
    return both.withColumn("status", F.when(F.col("_s").isNull(), "missing").when((F.col("_b") == F.col("bytes")) & (F.col("_s") == F.col("sha256")), "same").otherwise("changed")).drop("_b", "_s")


_KINDS = {"string": "^STRING$", "boolean": "^BOOLEAN$", "integer": r"^(?:BIGINT|DECIMAL\((?:19|[23]\d),0\))$", "number": "^(?:BIGINT|DECIMAL.*|DOUBLE|FLOAT)$", "object": "^OBJECT<", "array": "^ARRAY<", "null": "^VOID$"}


def strict_json(schema: dict) -> Callable[[Column], Column]:
    """A check of JSON texts against a closed subset of JSON schema: the first fault, or null.

    Types (one, or a list with "null"), required and unknown properties, bounds, sizes, enumerations and constants. A
    text that is no JSON, holds more than one value, repeats a key or has a number that is not finite is "not JSON"; a
    null text is "null". The schema is compiled to expressions over Spark's VARIANT, so no text leaves the JVM; faults of
    properties come in the order of the schema. An integer written as 1.0 is none.
    """

    def fault(v: Column, s: dict, path: str) -> Column:
        wanted = s.get("type")
        kinds = [wanted] if isinstance(wanted, str) else list(wanted or [])
        said = F.schema_of_variant(v)
        is_ = lambda kind: said.rlike(_KINDS[kind])
        found: list[Column] = []
        if kinds:
            found.append(F.when(~reduce(lambda a, b: a | b, [is_(k) for k in kinds]), F.lit(f"{path}: not {' or '.join(kinds)}")))
        number = F.try_variant_get(v, "$", "double")
        text = F.try_variant_get(v, "$", "string")
        values = [*s.get("enum", []), *([s["const"]] if "const" in s else [])]
        if values:
            same = [is_("null") if x is None else is_("boolean") & (text == str(x).lower()) if isinstance(x, bool) else is_("number") & (number == float(x)) if isinstance(x, (int, float)) else is_("string") & (text == x) for x in values]
            found.append(F.when(~reduce(lambda a, b: a | b, same), F.lit(f"{path}: not allowed")))
        outside = [c for name, c in (("minimum", number < s.get("minimum", 0)), ("maximum", number > s.get("maximum", 0))) if name in s]
        if outside:
            found.append(F.when(is_("number") & reduce(lambda a, b: a | b, outside), F.lit(f"{path}: out of bounds")))

        def sized(kind: str, size: Column, suffix: str) -> None:
            wrong = [c for name, c in ((f"min{suffix}", size < s.get(f"min{suffix}", 0)), (f"max{suffix}", size > s.get(f"max{suffix}", 0))) if name in s]
            if wrong:
                found.append(F.when(is_(kind) & reduce(lambda a, b: a | b, wrong), F.lit(f"{path}: {suffix.lower()}")))

        sized("string", F.char_length(text), "Length")
        known = s.get("properties", {})
        if known or "object" in kinds:
            held = F.try_variant_get(v, "$", "map<string,variant>")
            names = F.map_keys(held)
            unknown = F.get(F.array_sort(F.array_except(names, F.array(*[F.lit(k) for k in known]).cast("array<string>"))), F.lit(0))
            found.append(F.when(is_("object") & unknown.isNotNull(), F.concat(F.lit(f"{path}."), unknown, F.lit(": unknown"))))
            found += [F.when(is_("object") & ~F.array_contains(names, k), F.lit(f"{path}.{k}: missing")) for k in s.get("required", [])]
            sized("object", F.size(names), "Properties")
            found += [F.when(is_("object") & F.array_contains(names, k), fault(F.try_element_at(held, F.lit(k)), inner, f"{path}.{k}")) for k, inner in known.items()]
        items = F.try_variant_get(v, "$", "array<variant>")
        sized("array", F.size(items), "Items")
        if "items" in s:
            each = F.filter(F.transform(items, lambda x: fault(x, s["items"], f"{path}[]")), lambda f: f.isNotNull())
            found.append(F.when(is_("array"), F.get(each, F.lit(0))))
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    def check(text: Column) -> Column:
        # The parser stops at the end of a value; inside an array and inside an object only one whole value is right.
        alone = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
        named = F.map_keys(F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}"))), "$", "map<string,variant>"))
        whole = F.coalesce((F.size(alone) == 1) & (F.size(named) == 1), F.lit(False))
        return F.when(text.isNull(), "null").when(~whole, "not JSON").otherwise(fault(F.try_parse_json(text), schema, "$"))

    return check
