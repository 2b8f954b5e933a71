"""Guidance catalogs: entries and pages bound to approvals by hash, matching of observations, reading aloud.

Entries and pages carry ``payload``, their JSON, for the hash; a row's ``problem`` names the first broken rule, so a
catalog is used only if none of its rows has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import box
from ..functions.text import canonical_sha256, match_form
from .conversation import ordered_case
from .layout import lines
from .matching import overlapping

# What an entry's hash covers, the least confidence, the room in mm around a field that is read with it.
ENTRY_KEYS = ("document_id", "document_version", "page", "field_id", "field_type", "surrounding_text", "keywords", "forbidden_keywords", "instruction", "reading_mode", "source_text", "source")
LEAST_CONFIDENCE = 0.85
CROP = (45.0, 15.0, 45.0, 8.0)


def entry_hash(payload: Column) -> Column:
    return canonical_sha256(payload, keep=ENTRY_KEYS)


def page_hash(payload: Column) -> Column:
    return canonical_sha256(payload, drop=("approval",))


def _blank(text: Column) -> Column:
    return F.coalesce(F.trim(text) == "", F.lit(True))


def _unapproved(content: Column) -> list[tuple[str, Column]]:
    approved = F.col("approval.status") == "approved"
    return [
        ("approval_status", ~F.coalesce(F.col("approval.status").isin("draft", "approved"), F.lit(False))),
        ("reviewer", approved & (_blank(F.col("approval.reviewed_by")) | _blank(F.col("approval.reviewed_at")))),
        ("changed_after_approval", approved & ~F.col("approval.content_sha256").eqNullSafe(content)),
    ]


def _bad_source(source: str = "source") -> Column:
    return _blank(F.col(f"{source}.reference")) | ~F.coalesce(F.col(f"{source}.sha256").rlike(r"^[0-9a-f]{64}\z"), F.lit(False))


def checked_entries(entries: DataFrame, purpose: str) -> DataFrame:
    """Entries with ``content_sha256`` and ``problem`` (null if sound); production entries must quote their source."""
    if purpose not in ("demo", "production"):
        raise ValueError("a catalog is for demo or production")
    rows = entries.withColumn("content_sha256", entry_hash(F.col("payload")))
    strict = (F.lit(purpose) == "production") & (F.col("approval.status") == "approved")
    quotes = strict | F.col("reading_mode").isNotNull() | F.col("source_text").isNotNull()
    copies = F.count("*").over(Window.partitionBy("document_id", "document_version", "page", "field_id"))
    blank = _blank(F.col("document_id"))
    for c in ("document_version", "field_id", "surrounding_text", "instruction"):
        blank = blank | _blank(F.col(c))
    words = lambda c: F.exists(F.coalesce(c, F.array(F.lit(""))), lambda w: _blank(w))
    rules = [
        ("text", blank), ("page", F.coalesce(F.col("page") < 1, F.lit(True))), ("field_type", ~F.coalesce(F.col("field_type").isin("checkbox", "signature"), F.lit(False))),
        ("keywords", words("keywords") | words("forbidden_keywords") | (F.size("keywords") == 0)), *_unapproved(F.col("content_sha256")),
        ("verbatim", quotes & (~F.col("reading_mode").eqNullSafe("verbatim") | _blank(F.col("source_text")) | F.contains("source_text", F.lit("\0")))),
        ("instruction_differs", quotes & ~F.col("instruction").eqNullSafe(F.col("source_text"))),
        ("source", (strict | F.col("source").isNotNull()) & _bad_source()), ("repeated", copies > 1),
    ]
    return rows.withColumn("problem", F.nullif(ordered_case([(n, F.coalesce(h, F.lit(False))) for n, h in rules], ""), F.lit("")))


def checked_pages(pages: DataFrame) -> DataFrame:
    rows = pages.withColumn("content_sha256", page_hash(F.col("payload")))
    copies = F.count("*").over(Window.partitionBy("document_id", "document_version", "page"))
    rules = [
        ("text", _blank(F.col("document_id")) | _blank(F.col("document_version")) | _blank(F.col("source_text")) | F.contains("source_text", F.lit("\0")) | F.coalesce(F.col("page") < 1, F.lit(True)) | ~F.col("reading_mode").eqNullSafe("verbatim")),
        ("source", _bad_source()), ("page_count", F.col("page_count") < F.col("page")), *_unapproved(F.col("content_sha256")), ("repeated", copies > 1),
    ]
    return rows.withColumn("problem", F.nullif(ordered_case([(n, F.coalesce(h, F.lit(False))) for n, h in rules], ""), F.lit("")))


def supported(documents: DataFrame, entries: DataFrame) -> DataFrame:
    """The (document_id, document_version, page) rows that have an approved entry."""
    return documents.join(entries.where("approval.status = 'approved'"), ["document_id", "document_version", "page"], "left_semi")


#: Statuses, the first that holds wins.
STATUSES = ("demo_only", "invalid_input", "unverified_document", "low_confidence", "needs_review", "unsupported_document", "no_match", "ambiguous", "unapproved", "matched")


def match(observed: DataFrame, entries: DataFrame, purpose: str, demo: bool = False, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """Observations (id, document_id, document_version, page, field_type, surrounding_text, three confidences,
    identity_verified, needs_review) with status and, where matched, the entry's field, text and hash.

    Entries of a document's page are joined on that key; an entry hits if the text has all its keywords and none that
    is forbidden.
    """
    if not 0 < least <= 1:
        raise ValueError("the least confidence lies above 0 and is at most 1")
    key = ["document_id", "document_version", "page"]
    e = entries.select(*key, F.col("field_id"), F.col("field_type").alias("e_type"), F.transform("keywords", lambda w: w).alias("keywords"), "forbidden_keywords", F.col("approval.status").alias("e_status"), "content_sha256", "reading_mode", "source_text", "instruction")
    words = lambda c: F.split(match_form(F.array_join(c, "␞")), "␞")  # noqa: E731  # one pass of the normaliser for all keywords
    e = e.withColumns({"keywords": words("keywords"), "forbidden_keywords": F.when(F.size("forbidden_keywords") > 0, words("forbidden_keywords")).otherwise(F.array().cast("array<string>"))})
    texts = observed.withColumn("_text", match_form(F.col("surrounding_text")))
    pairs = texts.select("id", *key, "field_type", "_text").join(e, key)
    hit = (F.col("e_type") == F.col("field_type")) & F.forall("keywords", lambda w: F.contains("_text", w)) & ~F.exists("forbidden_keywords", lambda w: F.contains("_text", w))
    read = F.when(F.col("reading_mode") == "verbatim", F.col("source_text")).otherwise(F.col("instruction"))
    found = pairs.withColumn("hit", F.coalesce(hit, F.lit(False))).groupBy("id").agg(
        F.count_if("hit").alias("hits"), F.min(F.when(F.col("hit"), F.struct("field_id", "e_status", read.alias("text"), "content_sha256", "reading_mode"))).alias("e")
    )
    bad = lambda c: F.coalesce(~F.col(c).between(0, 1) | F.isnan(c) | (F.col(c) < least), F.lit(True))
    rules = [
        ("demo_only", F.lit(purpose == "demo" and not demo)),
        ("invalid_input", _blank(F.col("document_id")) | _blank(F.col("document_version")) | F.coalesce(F.col("page") < 1, F.lit(True)) | ~F.coalesce(F.col("field_type").isin("checkbox", "signature"), F.lit(False)) | F.col("surrounding_text").isNull() | F.col("needs_review").isNull()),
        ("unverified_document", ~F.coalesce("identity_verified", F.lit(False))),
        ("low_confidence", bad("document_confidence") | bad("detection_confidence") | bad("ocr_confidence")),
        ("needs_review", F.coalesce("needs_review", F.lit(True))), ("unsupported_document", F.col("hits").isNull()), ("no_match", F.col("hits") == 0), ("ambiguous", F.col("hits") > 1),
        ("unapproved", F.col("e.e_status") != "approved"),
    ]
    out = observed.join(found, "id", "left").withColumn("status", ordered_case([(n, F.coalesce(h, F.lit(False))) for n, h in rules], "matched"))
    ok = lambda c: F.when(F.col("status") == "matched", F.col(c))
    return out.select(*observed.columns, "status", ok("e.field_id").alias("field_id"), ok("e.text").alias("instruction"), ok("e.content_sha256").alias("content_sha256"), ok("e.reading_mode").alias("reading_mode"))


def read_pages(asked: DataFrame, pages: DataFrame, purpose: str, demo: bool = False) -> DataFrame:
    """Asked (document_id, document_version, page) with status and an approved page's text, whole and unchanged."""
    key = ["document_id", "document_version", "page"]
    p = pages.select(*key, F.col("approval.status").alias("_status"), "source_text", "content_sha256")
    rules = [
        ("demo_only", F.lit(purpose == "demo" and not demo)), ("invalid_input", _blank(F.col("document_id")) | _blank(F.col("document_version")) | F.coalesce(F.col("page") < 1, F.lit(True))),
        ("unsupported_document", F.col("_status").isNull()), ("unapproved", F.col("_status") != "approved"),
    ]
    out = asked.join(p, key, "left").withColumn("status", ordered_case([(n, F.coalesce(h, F.lit(False))) for n, h in rules], "matched"))
    return out.select(*key, "status", *(F.when(F.col("status") == "matched", F.col(c)).alias(c) for c in ("source_text", "content_sha256")))


def read_documents(pages: DataFrame, purpose: str, demo: bool = False) -> DataFrame:
    """Per document version: status and, if pages 1 to page_count are all there and approved, the whole text (pages
    joined by an empty line) and a hash over the pages' hashes."""
    order = F.array_sort(F.collect_list(F.struct("page", "page_count", F.col("approval.status").alias("status"), "source_text", "content_sha256")))
    rows = pages.groupBy("document_id", "document_version").agg(order.alias("p"))
    count = F.col("p")[0]["page_count"]
    whole = (count == F.size("p")) & F.forall("p", lambda x: x["page_count"] == count) & F.forall(F.transform("p", lambda x, i: x["page"] == i + 1), lambda ok: ok)
    status = ordered_case([("demo_only", F.lit(purpose == "demo" and not demo)), ("incomplete_document", ~F.coalesce(whole, F.lit(False))), ("unapproved", F.exists("p", lambda x: x["status"] != "approved"))], "matched")
    text = F.array_join(F.transform("p", lambda x: x["source_text"]), "\n\n")
    payload = F.to_json(F.struct("document_id", "document_version", F.lit("\n\n").alias("page_separator"), F.transform("p", lambda x: x["content_sha256"]).alias("pages")))
    rows = rows.withColumns({"status": status, "text": text}).withColumn("sha", canonical_sha256(payload))
    ok = lambda c: F.when(F.col("status") == "matched", F.col(c))
    return rows.select("document_id", "document_version", "status", ok("text").alias("source_text"), ok("sha").alias("content_sha256"))


def observations(fields: DataFrame, words: DataFrame, detections: DataFrame, context: DataFrame) -> DataFrame:
    """Observations of fields (doc_id, id, type, box, confidence, needs_review): the words around a field, line by line,
    and the least confidences; nothing around or no detection counts as 0.

    ``context`` (doc_id, document_id, document_version, page, confidence, normalize_confidence, identity_verified,
    needs_review) speaks for the page.
    """
    left, top, right, bottom = CROP
    f = fields.withColumn("kind", F.when(F.col("type") == "choice", "checkbox").otherwise(F.col("type"))).withColumn("key", F.concat_ws("␞", "doc_id", "id"))
    cx, cy = F.greatest(F.lit(0.0), F.col("x") - left), F.greatest(F.lit(0.0), F.col("y") - top)
    f = f.withColumns({"cx": cx, "cy": cy, "cw": F.least(F.lit(210.0), F.col("x") + F.col("w") + right) - cx, "ch": F.least(F.lit(297.0), F.col("y") + F.col("h") + bottom) - cy})
    w = words.select("doc_id", "ord", "text", *(F.col(c).alias(f"w{c}") for c in "xywh"), F.col("confidence").alias("wconf"))
    near = f.select("doc_id", "key", "cx", "cy", "cw", "ch").join(w, "doc_id").where(overlapping(box("w"), box("c")))
    around = near.select(F.col("key").alias("doc_id"), "ord", "text", *(F.col(f"w{c}").alias(c) for c in "xywh"), F.col("wconf").alias("confidence"))
    text = lines(around).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "\n").alias("surrounding_text"))
    ocr = near.groupBy("key").agg(F.min("wconf").alias("ocr_confidence"))
    d = detections.select("doc_id", F.col("kind").alias("dkind"), *(F.col(c).alias(f"d{c}") for c in "xywh"), F.col("confidence").alias("dconf"))
    seen = f.select("doc_id", "key", "kind", *"xywh").join(d, "doc_id").where((F.col("kind") == F.col("dkind")) & overlapping(box("d"), box()))
    seen = seen.groupBy("key").agg(F.min("dconf").alias("dconf"))
    c = context.select("doc_id", "document_id", "document_version", "page", F.col("confidence").alias("c_conf"), "normalize_confidence", "identity_verified", F.col("needs_review").alias("c_review"))
    out = f.join(text.withColumnRenamed("doc_id", "key"), "key", "left").join(ocr, "key", "left").join(seen, "key", "left").join(c, "doc_id", "left")
    least = lambda known, *v: F.coalesce(F.when(known, F.least(*v)), F.lit(0.0))
    return out.select(
        "doc_id", F.col("key").alias("id"), F.col("id").alias("own_id"), "document_id", "document_version", "page", F.col("kind").alias("field_type"), F.coalesce("surrounding_text", F.lit("")).alias("surrounding_text"),
        least(F.col("normalize_confidence").isNotNull(), F.col("c_conf"), F.col("normalize_confidence")).alias("document_confidence"), least(F.col("dconf").isNotNull(), F.col("confidence"), F.col("dconf")).alias("detection_confidence"),
        F.coalesce("ocr_confidence", F.lit(0.0)).alias("ocr_confidence"), F.coalesce("identity_verified", F.lit(False)).alias("identity_verified"),
        (F.coalesce("needs_review", F.lit(True)) | F.coalesce("c_review", F.lit(True))).alias("needs_review"),
    )


def checked_context(context: DataFrame, fields: DataFrame) -> DataFrame:
    """Contexts (doc_id, payload, confidence, identity_verified, field_order, analysis_sha256, approval, report) with
    ``problem``: what keeps them from guiding through the fields (doc_id, id, type) of the present analysis."""
    ids = fields.where("type in ('choice', 'checkbox', 'signature')").groupBy("doc_id").agg(F.collect_set("id").alias("ids"))
    rows = context.join(ids, "doc_id", "left").withColumns({"own": canonical_sha256(F.col("payload"), drop=("approval",)), "seen": canonical_sha256(F.col("report"))})
    order, have = F.col("field_order"), F.coalesce("ids", F.array().cast("array<string>"))
    approved = (F.col("approval.status") == "approved") & ~_blank(F.col("approval.reviewed_by")) & ~_blank(F.col("approval.reviewed_at")) & (F.col("approval.content_sha256") == F.col("own"))
    same = (F.size(order) == F.size(have)) & (F.size(F.array_except(order, have)) == 0) & (F.size(F.array_except(have, order)) == 0)
    holds = lambda c: F.coalesce(c, F.lit(False))
    rules = [
        ("identity", ~holds((F.col("confidence") >= LEAST_CONFIDENCE) & (F.col("confidence") <= 1) & F.col("identity_verified"))),
        ("order", ~holds((F.size(order) > 0) & (F.size(F.array_distinct(order)) == F.size(order)) & ~F.exists(order, _blank))), ("approval", ~holds(approved)),
        ("analysis_changed", ~holds(F.col("analysis_sha256") == F.col("seen"))), ("fields_differ", ~holds(same)),
    ]
    return rows.withColumn("problem", F.nullif(ordered_case(rules, ""), F.lit(""))).drop("ids", "own", "seen")


def playback(matches: DataFrame) -> DataFrame:
    """Per doc_id of matches (doc_id, position, status, field_id): whether guidance can run, else the first reason."""
    steps = matches.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", "status", "field_id"))).alias("s"))
    wrong = F.filter("s", lambda x: x["status"] != "matched")
    ids = F.transform("s", lambda x: x["field_id"])
    reason = F.when(F.size(wrong) > 0, wrong[0]["status"]).when(F.size(F.array_distinct(ids)) < F.size(ids), "ambiguous_field_mapping")
    return steps.select("doc_id", F.size("s").alias("total"), reason.isNull().alias("ready"), reason.alias("reason"))


def positions(commands: DataFrame, total: int) -> DataFrame:
    """Where playback stands after each command (session, seq, command) of n, p, r, s, q: a clamped running sum.

    Clamping makes it a fold over a session's commands.
    """
    order = F.array_sort(F.collect_list(F.struct("seq", "command")))
    rows = commands.groupBy("session").agg(order.alias("c"))
    move = lambda x: F.when(x["command"] == "n", 1).when(x["command"] == "p", -1).otherwise(0)
    step = lambda acc, x: F.struct(F.array_append(acc["all"], F.greatest(F.lit(0), F.least(F.lit(total - 1), acc["at"] + move(x)))).alias("all"), F.greatest(F.lit(0), F.least(F.lit(total - 1), acc["at"] + move(x))).alias("at"))
    places = F.aggregate("c", F.struct(F.array().cast("array<int>").alias("all"), F.lit(0).alias("at")), step, lambda acc: acc["all"])
    return rows.select("session", F.explode(F.arrays_zip("c", places.alias("index"))).alias("z")).select("session", "z.c.seq", "z.c.command", (F.col("z.index") + 1).alias("position"))


def approve(entry: DataFrame, key: dict, reviewer: str, at: str, hash_of=entry_hash) -> DataFrame:
    """The one row that ``key`` names, approved over its present content; any other number of rows is an error."""
    row = entry
    for k, v in key.items():
        row = row.where(F.col(k) == v)
    row = row.withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(1))))  # one row; a count over what the key names
    one = F.when(F.col("_n") == 1, F.lit("approved")).otherwise(F.raise_error(F.lit("the key names several entries")))
    approval = F.struct(one.alias("status"), F.lit(reviewer).alias("reviewed_by"), F.lit(at).alias("reviewed_at"), hash_of(F.col("payload")).alias("content_sha256"))
    return row.withColumn("approval", approval).drop("_n")


def draft(entry: DataFrame, key: dict, changes: dict[str, Column]) -> DataFrame:
    """All rows, with changes applied to the rows that ``key`` names, which fall back to drafts."""
    named = F.lit(True)
    for k, v in key.items():
        named = named & (F.col(k) == v)
    out = entry.withColumns({c: F.when(named, v).otherwise(F.col(c)) for c, v in changes.items()})
    blank = F.struct(F.lit("draft").alias("status"), F.lit("").alias("reviewed_by"), F.lit("").alias("reviewed_at"), F.lit("").alias("content_sha256"))
    return out.withColumn("approval", F.when(named, blank).otherwise(F.col("approval")))


def stages(runs: DataFrame, order: list[str]) -> DataFrame:
    """Runs (run, stage, ok, reasons) as events in ``order``; whatever follows a failed or missing stage is blocked."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("stage"))
    wanted = runs.select("run").distinct().withColumn("stage", F.explode(F.array(*map(F.lit, order))))
    rows = wanted.join(runs, ["run", "stage"], "left").withColumn("place", place)
    by = Window.partitionBy("run").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.bool_and(F.coalesce("ok", F.lit(False))).over(by), F.lit(True))
    status = F.when(~before, "blocked").when(F.col("ok").isNull(), "missing").when(F.col("ok"), "passed").otherwise("failed")
    return rows.select("run", "place", "stage", status.alias("status"), F.when(before, F.col("reasons")).alias("reasons"))
