"""Form structure from detections and words, as joins and windows: labels beside a box, headings and clauses above a
group of boxes, roles, scores, numbered fields and warnings. All tables are keyed by doc_id."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import clamp01
from ..functions.text import trimmed
from .layout import connected_groups, in_row_or_stack, lines

# Fixed values, mm: overlap that makes a row, room between a label and its box, between clause lines, above a signature.
ROW_OVERLAP, OPTION_GAP, LABEL_GAP, CLAUSE_GAP, SIDE_MARGIN, ABOVE_GAP, TITLE_LENGTH = 0.8, 14.0, 40.0, 10.0, 2.0, 8.0, 40
# What a missing label, a missing title, an unknown role and an official's role cost; the trust limit.
NO_LABEL, NO_TITLE, UNKNOWN_ROLE, OFFICIAL_ROLE, TRUST = 0.20, 0.15, 0.25, 0.30, 0.85
# Marks of required fields and of headings, keywords of roles, dates and private labels, id prefixes.
REQUIRED = ["[필수]", "(필수)", "필수항목", "필수기재"]
STARS = ["*", "＊", "✱"]
STAR_NOTICE = "(표시|표기).{0,15}(필수|반드시)"
HEAD = ["*", "＊", "※", "■", "□", "○", "●", "◆", "◇", "▶", "·", "-", "1.", "2.", "3."]
TAIL = ["동의", "동의서", "여부", "확인", "선택", "사항", "안내"]
ROLES = {
    "representative": ["법정대리인", "대리인", "보호자", "후견인", "위임인", "대리"],
    "official": ["담당자", "접수자", "확인자", "취급자", "검토자", "처리자", "접수부서"],
    "applicant": ["신청인", "본인", "작성자", "가입자", "예금주", "신청자", "청구인"],
}
DATES = ["일자", "날짜", "생년월일", "년월일", "작성일", "신청일"]
PRIVATE = "성명 이름 성함 주민등록번호 주민번호 생년월일 외국인등록번호 여권번호 운전면허 주소 거주지 연락처 전화 휴대폰 이메일 계좌 예금주 카드번호 사업자등록번호 서명 날인".split()
PREFIX = {"choice": "consent", "checkbox": "checkbox", "signature": "signature", "text_input": "text", "date": "date", "unknown": "unknown"}


def _has(text: Column, words: list[str]) -> Column:
    return reduce(or_, (F.contains(text, F.lit(w)) for w in words))


def _close(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def _quoted(words: list[str]) -> str:
    return "|".join(rf"\Q{w}\E" for w in words)


def without_marks(text: Column) -> Column:
    """Text without marks of required fields, leading bullets and trailing colons; single spaces."""
    bare = trimmed(F.regexp_replace(text, _quoted(REQUIRED), " "))
    bare = F.regexp_replace(bare, rf"(?U)^(?:(?:{_quoted(HEAD)})\s+)+", "")
    return trimmed(F.regexp_replace(F.regexp_replace(bare, r"[ :：·\-]+\z", ""), r"(?U)\s+", " "))


def is_heading(text: Column) -> Column:
    text = trimmed(text)
    marked = text.rlike(rf"(?U)^(?:{_quoted(HEAD)})\s")
    short = (F.length(text) <= TITLE_LENGTH) & without_marks(text).rlike(rf"(?:{'|'.join(TAIL)})\z")
    return (text != "") & (marked | short)


def is_required(text: Column, star_rule: Column) -> Column:
    return _has(_close(text), REQUIRED) | (star_rule & _has(text, STARS))


def role(label: Column) -> Column:
    """The one role whose keywords a label has, or null where none or several have."""
    found = F.array_compact(F.array(*(F.when(_has(_close(label), words), name) for name, words in ROLES.items())))
    return F.when(F.size(found) == 1, found[0])


def sensitivity(kind: Column, title: Column) -> Column:
    return F.when(kind.isin("choice", "checkbox") & ~_has(_close(title), PRIVATE), "public").otherwise("private")


def _chain(pairs: DataFrame, key: list[str], side: str, limit: float) -> DataFrame:
    """Of words (wx, wright, ...) beside a box (x, right), those that are reached from the box without too wide a gap."""
    if side == "left":
        by = Window.partitionBy(*key).orderBy(F.desc("wx"), F.desc("word"))
        room = F.coalesce(F.lag("wx").over(by), F.col("x")) - F.col("wright")
    else:
        by = Window.partitionBy(*key).orderBy("wx", "word")
        room = F.col("wx") - F.coalesce(F.lag("wright").over(by), F.col("right"))
    rows = pairs.withColumn("room", room).withColumn("cut", F.max((F.col("room") > limit).cast("int")).over(by))
    return rows.where("cut = 0")


def _label(chain: DataFrame, key: list[str]) -> DataFrame:
    text = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("wx", "word", "text"))), lambda s: s["text"]), " "))
    return chain.groupBy(*key).agg(text.alias("label"), F.min("wconf").alias("label_conf"), F.max("wright").alias("label_right"), F.min("wx").alias("label_left"))


def _beside(boxes: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs of a box and a word on its row."""
    w = words.select("doc_id", F.col("ord").alias("word"), "text", F.col("x").alias("wx"), (F.col("x") + F.col("w")).alias("wright"), F.col("y").alias("wy"), (F.col("y") + F.col("h")).alias("wbottom"), F.col("confidence").alias("wconf"))
    pairs = boxes.withColumns({"right": F.col("x") + F.col("w"), "bottom": F.col("y") + F.col("h")}).join(w, "doc_id")
    return pairs.where(F.least("bottom", "wbottom") - F.greatest("y", "wy") >= ROW_OVERLAP)


def left_labels(boxes: DataFrame, words: DataFrame, limit: float = LABEL_GAP) -> DataFrame:
    """(doc_id, ord, label, label_conf, ...) of the words that lead up to each box (doc_id, ord, x, y, w, h)."""
    key = ["doc_id", "ord"]
    return _label(_chain(_beside(boxes.select(*key, *"xywh"), words).where(F.col("wright") <= F.col("x") + 0.5), key, "left", limit), key)


def rows_of(boxes: DataFrame) -> DataFrame:
    """Boxes (doc_id, component, ord, x, y, w, h) with the row of their group: the first box in reading order takes all
    that overlap it upright, the first one left takes the next row, and so on. A fold on the group's array."""
    item = F.struct("y", "x", "ord", "h", "w")
    groups = boxes.groupBy("doc_id", "component").agg(F.array_sort(F.collect_list(item)).alias("m"))
    overlap = lambda a, b: F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    none = F.filter(F.transform("m", lambda b: F.struct(b.alias("first"), F.array(b).alias("all"))), lambda r: F.lit(False))

    def add(rows, b):
        mine = lambda r: overlap(r["first"], b) >= ROW_OVERLAP
        place = F.array_position(F.transform(rows, mine), F.lit(True))
        grown = F.transform(rows, lambda r, i: F.when(i + 1 == place, F.struct(r["first"], F.array_append(r["all"], b).alias("all"))).otherwise(r))
        return F.when(place > 0, grown).otherwise(F.array_append(rows, F.struct(b.alias("first"), F.array(b).alias("all"))))

    found = groups.select("doc_id", "component", F.posexplode(F.aggregate("m", none, add)).alias("row", "r"))
    return found.select("doc_id", "component", "row", F.explode("r.all").alias("b")).select("doc_id", "component", "row", "b.*")


def option_labels(boxes: DataFrame, words: DataFrame, limit: float = OPTION_GAP) -> DataFrame:
    """(doc_id, component, row, ord, label, label_conf) of checkboxes: per row, all labels lie left or all lie right.

    The side with more labels wins, then the one whose labels are closer; a tie within the margin gives no labels.
    """
    key = ["doc_id", "component", "row", "ord"]
    by = Window.partitionBy("doc_id", "component", "row").orderBy("x", "y", "ord")
    rows = rows_of(boxes).withColumns({"before": F.lag(F.col("x") + F.col("w")).over(by), "next": F.lead("x").over(by)})
    pairs = _beside(rows, words)
    left = pairs.where((F.col("wright") <= F.col("x") + 0.5) & (F.col("before").isNull() | (F.col("wx") >= F.col("before"))))
    right = pairs.where((F.col("wx") >= F.col("right") - 0.5) & (F.col("next").isNull() | (F.col("wx") < F.col("next"))))
    named = lambda side, chain: _label(_chain(chain, key, side, limit), key).select(*key, *(F.col(c).alias(f"{side}_{c}") for c in ("label", "label_conf", "label_left", "label_right")))
    both = rows.join(named("left", left), key, "left").join(named("right", right), key, "left")
    of = Window.partitionBy("doc_id", "component", "row")
    n_left, n_right = F.count("left_label").over(of), F.count("right_label").over(of)
    near_left = F.coalesce(F.sum(F.col("x") - F.col("left_label_right")).over(of), F.lit(0.0))
    near_right = F.coalesce(F.sum(F.col("right_label_left") - (F.col("x") + F.col("w"))).over(of), F.lit(0.0))
    tie = F.abs(near_left - near_right) <= SIDE_MARGIN * F.greatest(n_left, F.lit(1))
    side = F.when(n_left > n_right, "left").when(n_left < n_right, "right").when(tie, None).when(near_left < near_right, "left").otherwise("right")
    both = both.withColumn("side", side)
    pick = lambda c: F.when(F.col("side") == "left", F.col(f"left_{c}")).when(F.col("side") == "right", F.col(f"right_{c}"))
    return both.select(*key, "x", "y", "w", "h", without_marks(F.coalesce(pick("label"), F.lit(""))).alias("label"), pick("label_conf").alias("label_conf"))


def titles(groups: DataFrame, page_lines: DataFrame, inputs: DataFrame) -> DataFrame:
    """(doc_id, component, title, clause, heading columns) of groups (doc_id, component, x, y, w, h).

    Lines above a group are walked upward while gaps are small; a line on an input's row ends the walk, a heading
    gives the title, the lines before it the clause.
    """
    on_input = (
        page_lines.alias("l").join(inputs.select("doc_id", F.col("y").alias("iy"), F.col("h").alias("ih")).alias("i"), "doc_id")
        .where(F.least(F.col("l.y") + F.col("l.h"), F.col("iy") + F.col("ih")) - F.greatest(F.col("l.y"), F.col("iy")) > 0).select("doc_id", "line").distinct().withColumn("blocked", F.lit(True))
    )
    above = page_lines.select("doc_id", "line", "text", F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("w").alias("lw"), F.col("h").alias("lh"), F.col("confidence").alias("lconf"))
    above = groups.select("doc_id", "component", "y").join(above, "doc_id").where(F.col("ly") + F.col("lh") <= F.col("y") + 0.5).join(on_input, ["doc_id", "line"], "left")
    by = Window.partitionBy("doc_id", "component").orderBy(F.desc("ly"), F.desc("lx"), "line")
    room = F.coalesce(F.lag("ly").over(by), F.col("y")) - (F.col("ly") + F.col("lh"))
    stop = (room > CLAUSE_GAP) | F.coalesce("blocked", F.lit(False))
    above = above.withColumn("stop", stop).withColumn("head", ~F.col("stop") & is_heading(F.col("text")))
    earlier = F.coalesce(F.max((F.col("stop") | F.col("head")).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    walked = above.withColumn("earlier", earlier).where("earlier = 0 and not stop")
    clause = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("ly", "lx", "line", "text")))), lambda s: s["text"]), " ")
    top = F.max_by(F.struct(without_marks(F.col("text")).alias("title"), "text", "line", "lx", "ly", "lw", "lconf"), F.when(F.col("head"), F.col("ly")))
    found = walked.groupBy("doc_id", "component").agg(F.trim(clause).alias("clause"), F.max("head").alias("has_head"), top.alias("hd"), F.min(F.when(~F.col("head"), F.col("lconf"))).alias("clause_conf"))
    hd = lambda c: F.when(F.col("has_head") & (F.col("hd.title") != ""), F.col(f"hd.{c}"))
    return found.select("doc_id", "component", "clause", "clause_conf", F.coalesce(F.when(F.col("has_head"), F.col("hd.title")), F.lit("")).alias("title"), hd("text").alias("head_text"), hd("lx").alias("head_x"), hd("ly").alias("head_y"), hd("lw").alias("head_w"), hd("lconf").alias("head_conf"))


def star_rule(page_lines: DataFrame) -> DataFrame:
    return page_lines.groupBy("doc_id").agg(F.max(F.col("text").rlike(STAR_NOTICE)).alias("star_rule"))


_FIELD = ["doc_id", "type", "title", "role", "options", "required", "x", "y", "w", "h", "clause_text", "confidence", "ambiguous", "first"]


def _choices(detections: DataFrame, words: DataFrame, page_lines: DataFrame, stars: DataFrame) -> DataFrame:
    checks = detections.where("kind = 'checkbox'")
    grouped = checks.join(connected_groups(checks, in_row_or_stack), ["doc_id", "ord"])
    options = option_labels(grouped, words).join(checks.select("doc_id", "ord", "confidence"), ["doc_id", "ord"])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "ord", "label", "w", "h"))), lambda o: F.struct(o["label"], o["x"], o["y"], o["w"], o["h"]))
    groups = options.groupBy("doc_id", "component").agg(
        listed.alias("options"), F.count("*").alias("n"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("right"), F.max(F.col("y") + F.col("h")).alias("bottom"),
        F.min("confidence").alias("box_conf"), F.min("label_conf").alias("word_conf"), F.count_if(F.col("label") == "").alias("unnamed"), F.min("ord").alias("first"),
    ).withColumns({"w": F.col("right") - F.col("x"), "h": F.col("bottom") - F.col("y")})
    found = titles(groups, page_lines, detections.where("kind in ('text_input', 'date', 'signature')"))
    rows = groups.join(found, ["doc_id", "component"], "left").join(stars, "doc_id", "left")
    named = F.filter(F.transform("options", lambda o: o["label"]), lambda s: s != "")
    own = F.coalesce("title", F.lit(""))
    title = F.when(own != "", own).when(F.size(named) > 0, F.concat(F.array_join(named, " / "), F.lit(" 선택"))).otherwise("")
    head = F.coalesce("head_text", F.lit(""))
    top, left = F.coalesce("head_y", "y"), F.least("x", F.coalesce("head_x", "x"))
    wide = F.greatest("right", F.coalesce(F.col("head_x") + F.col("head_w"), "right")) - left
    who = F.coalesce(role(head), F.lit("applicant"))
    score = F.least("box_conf", "word_conf", "head_conf", "clause_conf") - F.when(F.col("head_text").isNull(), NO_TITLE).otherwise(0.0) - F.when(F.col("unnamed") > 0, NO_LABEL).otherwise(0.0) - F.when(who == "official", OFFICIAL_ROLE).otherwise(0.0)
    return rows.select(
        "doc_id", F.when(F.col("n") >= 2, "choice").otherwise("checkbox").alias("type"), title.alias("title"), who.alias("role"), "options",
        is_required(F.concat_ws(" ", head, title), F.coalesce("star_rule", F.lit(False))).alias("required"), left.alias("x"), top.alias("y"), wide.alias("w"), (F.col("bottom") - top).alias("h"),
        F.coalesce("clause", F.lit("")).alias("clause_text"), clamp01(score).alias("confidence"), F.lit(False).alias("ambiguous"), "first",
    )


def _inputs(detections: DataFrame, words: DataFrame, page_lines: DataFrame, stars: DataFrame) -> DataFrame:
    rows = detections.where("kind <> 'checkbox'").select("doc_id", "ord", "kind", "x", "y", "w", "h", "confidence")
    # a signature without a label takes the words of the nearest line above it
    near = rows.where("kind = 'signature'").join(page_lines.select("doc_id", F.col("text").alias("up"), F.col("confidence").alias("up_conf"), F.col("x").alias("lx"), F.col("w").alias("lw"), (F.col("y") + F.col("h")).alias("lb"), F.col("y").alias("ly")), "doc_id")
    near = near.where((F.col("y") - F.col("lb")).between(0, ABOVE_GAP) & (F.least(F.col("lx") + F.col("lw"), F.col("x") + F.col("w")) - F.greatest("lx", "x") > 0))
    up = near.groupBy("doc_id", "ord").agg(F.max_by(F.struct("up", "up_conf"), F.struct("lb", -F.col("ly"), -F.col("lx"))).alias("u"))
    rows = rows.join(left_labels(rows, words), ["doc_id", "ord"], "left").join(up, ["doc_id", "ord"], "left").join(stars, "doc_id", "left")
    close = _close(without_marks(F.coalesce("label", F.lit(""))))
    dated = _has(close, DATES)
    signature = (F.col("kind") == "signature") & ~((close != "") & dated & ~_has(close, ["서명", "날인", "서명란"]))
    rows = rows.withColumn("signs", signature)
    label = F.coalesce("label", F.when(F.col("signs"), F.col("u.up")), F.lit(""))
    label_conf = F.coalesce("label_conf", F.when(F.col("signs"), F.col("u.up_conf")))
    rows = rows.withColumns({"text": label, "text_conf": label_conf})
    bare = without_marks(F.col("text"))
    title = F.when(~F.col("signs") | _close(bare).rlike(r"서명\z"), bare).when(bare == "", "서명").otherwise(F.concat(bare, F.lit(" 서명")))
    one = role(F.col("text"))
    unknown = F.col("signs") & one.isNull()
    who = F.when(unknown, "unknown").otherwise(F.coalesce(one, F.lit("applicant")))
    kind = F.when(F.col("signs"), "signature").when(F.col("kind").isin("text_input", "unknown", "signature") & _has(_close(bare), DATES), "date").otherwise(F.col("kind"))
    needed = is_required(F.col("text"), F.coalesce("star_rule", F.lit(False))) | (F.col("signs") & (who == "applicant"))
    score = F.least("confidence", "text_conf") - F.when(F.col("text") == "", NO_LABEL).otherwise(0.0) - F.when(unknown, UNKNOWN_ROLE).otherwise(0.0) - F.when(~F.col("signs") & (who == "official"), OFFICIAL_ROLE).otherwise(0.0)
    none = F.array().cast("array<struct<label:string,x:double,y:double,w:double,h:double>>")
    return rows.select(
        "doc_id", kind.alias("type"), title.alias("title"), who.alias("role"), none.alias("options"), needed.alias("required"), "x", "y", "w", "h",
        F.lit("").alias("clause_text"), clamp01(score).alias("confidence"), unknown.alias("ambiguous"), F.col("ord").alias("first"),
    )


def build(detections: DataFrame, words: DataFrame) -> DataFrame:
    """Fields (doc_id, id, type, title, role, options, required, sensitivity, x, y, w, h, clause_text, ord, confidence,
    ambiguous) from detections (doc_id, ord, kind, x, y, w, h, confidence) and words, all in mm of an A4 page."""
    page_lines = lines(words)
    stars = star_rule(page_lines)
    drafts = _choices(detections, words, page_lines, stars).select(*_FIELD).unionByName(_inputs(detections, words, page_lines, stars).select(*_FIELD))
    by = Window.partitionBy("doc_id").orderBy("y", "x", "first")
    prefix = F.create_map(*(F.lit(x) for kv in PREFIX.items() for x in kv))
    rows = drafts.withColumn("ord", F.row_number().over(by) - 1).withColumn("prefix", F.coalesce(F.try_element_at(prefix, F.col("type")), F.lit("unknown")))
    number = F.row_number().over(Window.partitionBy("doc_id", "prefix").orderBy("ord"))
    return rows.select(
        "doc_id", F.concat("prefix", F.lit("_"), F.lpad(number.cast("string"), 2, "0")).alias("id"), "type", "title", "role", "options", "required",
        sensitivity(F.col("type"), F.col("title")).alias("sensitivity"), "x", "y", "w", "h", "clause_text", "ord", "confidence", "ambiguous",
    )


def warnings(fields: DataFrame) -> DataFrame:
    """(doc_id, id or null, warning): unnamed options, no title, low confidence, an official's field, signatures that
    cannot be told apart."""
    rules = {
        "option_without_label": F.exists("options", lambda o: o["label"] == ""), "no_title": F.col("title") == "",
        "low_confidence": F.col("confidence") < TRUST, "official_field": F.col("role") == "official",
    }
    own = fields.select("doc_id", "id", F.explode(F.array_compact(F.array(*(F.when(holds, name) for name, holds in rules.items())))).alias("warning"))
    signs = fields.where("type = 'signature'")
    page = signs.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("ambiguous").alias("unclear"), F.countDistinct("role").alias("roles"))
    rules = {"unclear_signature": F.col("unclear") > 0, "several_signatures": (F.col("n") >= 2) & (F.col("unclear") > 0), "repeated_role": F.col("roles") < F.col("n")}
    whole = page.select("doc_id", F.lit(None).cast("string").alias("id"), F.explode(F.array_compact(F.array(*(F.when(holds, name) for name, holds in rules.items())))).alias("warning"))
    return own.unionByName(whole)


def downgraded(fields: DataFrame) -> DataFrame:
    """After ``pii.classified``: the decided sensitivity, with the clause of a downgraded field blanked."""
    out = fields.withColumn("clause_text", F.when(F.col("decided") == "public", F.col("clause_text")).otherwise(F.lit("")))
    return out.withColumn("sensitivity", F.col("decided"))


def targets(fields: DataFrame) -> DataFrame:
    """Where a pen can go: the centre of each option, or of a field without options that has a box."""
    rows = fields.select("doc_id", "ord", "id", "type", "x", "y", "w", "h", F.posexplode_outer("options").alias("pos", "o"))
    name = F.when(F.col("o").isNull(), F.col("id")).otherwise(F.concat("id", F.lit(":"), F.col("o.label")))
    mid = lambda a, s: F.when(F.col("o").isNull(), F.col(a) + F.col(s) / 2).otherwise(F.col(f"o.{a}") + F.col(f"o.{s}") / 2)
    place = (F.col("ord") * 1000 + F.coalesce("pos", F.lit(0))).alias("ord")
    return rows.select(F.col("doc_id").alias("doc"), place, name.alias("id"), F.col("type").alias("kind"), mid("x", "w").alias("x"), mid("y", "h").alias("y")).where("x is not null and y is not null")


def label_rows(fields: DataFrame, width: float = 210.0, height: float = 297.0) -> DataFrame:
    """Training labels of a structure: signatures (class 0), checkboxes and options (class 1), by (y, x); centre and
    size as shares of the page."""
    box = F.struct("x", "y", "w", "h")
    own = F.when(F.size("options") == 0, F.when(F.col("type") == "signature", 0).when(F.col("type") == "checkbox", 1))
    single = fields.where(own.isNotNull() & F.col("x").isNotNull()).select("doc_id", "ord", F.lit(-1).alias("pos"), own.alias("class_id"), box.alias("b"))
    each = fields.select("doc_id", "ord", F.posexplode("options").alias("pos", "o")).select("doc_id", "ord", "pos", F.lit(1).alias("class_id"), F.struct("o.x", "o.y", "o.w", "o.h").alias("b"))
    rows = single.unionByName(each)
    by = Window.partitionBy("doc_id").orderBy(F.bround("b.y", 4), F.bround("b.x", 4), "ord", "pos")
    share = {"cx": (F.col("b.x") + F.col("b.w") / 2) / width, "cy": (F.col("b.y") + F.col("b.h") / 2) / height, "nw": F.col("b.w") / width, "nh": F.col("b.h") / height}
    return rows.select("doc_id", (F.row_number().over(by) - 1).alias("line"), "class_id", *(v.alias(k) for k, v in share.items()))
