"""Operators on forms against values worked out by hand (FIXTURES.md sections 2 to 4) or plain Python."""

import json
import math
import re

import pytest
from pyspark.sql import functions as F

from paperlake.functions import pii, text as t
from paperlake.operators import catalog, evaluation, layout, metrics, structure

SPELLINGS = [
    "900101-1234567", "9001011234567", "900101 1234567", "900101–1234567", "900101—1234567", "900101－1234567", "900101.1234567", "900101 - 1234567", "900101-\n1234567",
    "900101​-1234567", "９００１０１-１２３４５６７", "９００１０１１２３４５６７", "9001\n011234567", "900101-123 4567", "900101 1234 567", "900101 - - 1234567", "9OO1O1-1234567", "90010l-1234567", "9001O1-l234567",
]
TYPES = [
    ("연락처 010-1234-5678", "phone_mobile"), ("연락처 01012345678", "phone_mobile"), ("사무실 02-123-4567", "phone_landline"), ("사무실 031-123-4567", "phone_landline"),
    ("메일 hong.gildong@example.co.kr 로 보내주세요", "email"), ("카드 4111-1111-1111-1111", "card"), ("카드 4111111111111111", "card"), ("계좌번호 110-123-456789", "account"),
    ("국민은행 123456-78-901234", "account"), ("여권번호 M12345678", "passport"), ("운전면허 11-22-123456-01", "driver_license"), ("사업자등록번호 123-45-67891", "business_number"),
    ("건강보험증번호 1234567890", "health_insurance"), ("주소 경기도 성남시 분당구 판교로 235", "address"), ("주소 서울 강남구 역삼동 123-45", "address"), ("생년월일 1990-01-01", "birthdate"),
    ("생년월일 900101", "birthdate"), ("성명 김철수", "name"), ("신청인 이영희 (서명)", "name"),
]


def test_spellings_and_types_in_spark(spark):
    rows = [(i, x, "rrn", x) for i, x in enumerate(SPELLINGS)] + [(100 + i, f"아래 칸에 {x} 라고 적혀 있습니다.", "rrn", x) for i, x in enumerate(SPELLINGS)]
    rows += [(200 + i, x, kind, None) for i, (x, kind) in enumerate(TYPES)]
    found = pii.detect(spark.createDataFrame(rows, "id int, text string, kind string, value string")).collect()
    for r in found:
        spans = [s for s in r.spans if s.pii_type == r.kind]
        assert len(spans) == 1, (r.text, r.spans)
        assert r.value is None or r.text[spans[0].start : spans[0].end] == r.value


def test_letters_read_as_digits_take_part_as_in_the_rules():
    """Look-alike letters beside each other are digits too, and separators between digits do not count: with them
    "ll 010.1234.5678" has the thirteen digits of a resident number."""
    spans = {(s["pii_type"], "call 010.1234.5678 now"[s["start"] : s["end"]]) for s in pii.candidates("call 010.1234.5678 now")}
    assert {("phone_mobile", "010.1234.5678"), ("rrn", "ll 010.1234.5678")} <= spans
    assert {s["pii_type"] for s in pii.candidates("tel 010 - 1234--5678")} == {"phone_mobile"}


def test_payload_guard(spark):
    values = [{"a": "연락처 010-1234-5678", "b": [1, True, None]}, {"a": ["900101", "1234567"]}, {"n": 9001011234567}, {"a": "no data"}]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(9, None)], "id int, j string")
    got = {r.id: r.g for r in df.select("id", pii.guard_payload(F.col("j")).alias("g")).collect()}
    assert json.loads(got[0].payload) == {"a": "연락처 [PII:PHONE_1]", "b": [1, True, None]} and got[0].problem is None
    assert got[1].payload is None and got[2].payload is None and got[1].problem and got[2].problem
    assert json.loads(got[3].payload) == {"a": "no data"} and got[9].payload is None and got[9].problem is None


BOXES = "array<struct<ord:int,kind:string,x:double,y:double,w:double,h:double,confidence:double>>"


def measured(spark, truth, predictions, confidence):
    box = lambda many: many and [(i, *b) for i, b in enumerate(many)]
    df = spark.createDataFrame([("a", box(truth), box(predictions))], f"image string, truth {BOXES}, predictions {BOXES}")
    return {r.kind: r for r in metrics.detection_metrics(df, ["checkbox", "signature"], 0.5, confidence).collect()}


def test_detection_metrics(spark):
    truth = [("checkbox", 10.0, 10.0, 20.0, 20.0, 1.0), ("signature", 50.0, 50.0, 20.0, 10.0, 1.0)]
    got = measured(spark, truth, [("checkbox", 10.0, 10.0, 20.0, 20.0, c) for c in (0.99, 0.98)], 0.5)
    assert (got["checkbox"].tp, got["checkbox"].fp, got["signature"].fn, got["signature"].recall) == (1, 1, 1, 0)
    assert got["checkbox"].precision == 0.5 and math.isclose(got["checkbox"].f1, 2 / 3)
    two = [("checkbox", 0.0, 0.0, 10.0, 10.0), ("checkbox", 8.0, 0.0, 10.0, 10.0)]
    assert measured(spark, [(*b, 1.0) for b in two], [(*two[0], 0.7), (*two[1], 0.9)], 0.8)["checkbox"].fn == 1
    assert measured(spark, None, None, 0.5)["checkbox"].tp is None
    background = measured(spark, [], [("checkbox", 0.0, 0.0, 10.0, 10.0, 0.99)], 0.5)["checkbox"]
    assert (background.fp, background.precision, background.recall) == (1, 0, None)


def test_mask_metrics(spark):
    boxes = lambda many: spark.createDataFrame([("a", *map(float, b)) for b in many], "image string, x double, y double, w double, h double")
    images = spark.createDataFrame([("a", 100, 100)], "image string, width int, height int")
    r = metrics.mask_metrics(images, boxes([(0, 0, 10, 10), (5, 0, 10, 10)]), boxes([(0, 0, 10, 10)] * 2 + [(20, 0, 10, 10)])).first()
    assert (r.truth, r.masked, r.uncovered, r.excess, r.excess_rate) == (150, 200, 50, 100, 0.5) and math.isclose(r.uncovered_rate, 1 / 3)
    assert metrics.mask_metrics(images, boxes([]), boxes([])).first().uncovered_rate is None


def test_guidance_metrics(spark):
    key = "struct<document_id:string,document_version:string,page:int,field_id:string>"
    e = ("fictional-survey", "demo-1", 1, "participation")
    rows = [("matched", e, True, e), ("matched", e, True, None), ("needs_review", None, True, None), ("needs_review", None, True, e), ("matched", e, False, None)]
    r = metrics.guidance_metrics(spark.createDataFrame(rows, f"status string, answered {key}, labelled boolean, expected {key}")).first()
    assert (r.correct_match, r.wrong_match, r.correct_rejection, r.missed_match, r.unlabelled) == (1, 1, 1, 1, 1)
    assert (r.accuracy, r.wrong_rate, r.rejection_rate, r.reasons) == (0.5, 0.5, 0.4, "needs_review=2")


def test_dataset_audit(spark):
    rows = [("a", "train", "included", "f", "s", "x"), ("b", "test", "unknown", "f", "s", "y"), ("c", "external", "excluded", "f", "s", "x")]
    df = spark.createDataFrame(rows, "alias string, split string, training_membership string, form_id string, source_id string, image_sha256 string")
    got = evaluation.audit(df).collect()
    one = {r.finding: r.samples for r in got if r.finding != "cross_split"}
    assert one == {"training_overlap": ["b", "c"], "unknown_training": ["b"], "duplicate": ["a", "c"]}
    assert sum(r.finding == "cross_split" for r in got) == 3


def test_coco_fractions_and_crowds(spark):
    images = spark.createDataFrame([(3, 100, 100), (4, 100, 100), (5, 9, 9)], "id int, width int, height int")
    kinds = spark.createDataFrame([(8, "checkbox")], "id int, name string")
    marks = spark.createDataFrame([(1, 3, 8, [10.25, 11.5, 20.5, 21.75], 0), (2, 4, 8, [1.0, 1.0, 2.0, 2.0], 1)], "id int, image_id int, category_id int, bbox array<double>, iscrowd int")
    got = {r.image_id: r for r in evaluation.truth_from_coco(images, kinds, marks).collect()}
    assert got[3].truth[0].bbox == [10.25, 11.5, 20.5, 21.75] and got[3].problem is None
    assert got[4].truth is None and got[4].problem == "crowd" and got[5].truth == []


def test_predictions_go_back_through_the_homography(spark):
    ddl = "id string, ord int, coordinate_system string, kind string, bbox array<double>, confidence double, width int, height int, normalized_width int, normalized_height int, source_to_normalized array<double>"
    row = ("a", 0, "normalized_a4_mm", "checkbox", [25.0, 47.0, 40.0, 20.0], 0.9, 100, 100, 210, 297)
    rows = [(*row, [2.0, 0.0, 5.0, 0.0, 2.0, 7.0, 0.0, 0.0, 1.0]), ("b", *row[1:], [0.0] * 9)]
    got = {r.id: r.box for r in evaluation.predictions(spark.createDataFrame(rows, ddl)).collect()}
    assert all(map(math.isclose, got["a"].bbox, (10, 20, 20, 10))) and got["b"] is None


def test_approval_is_bound_to_the_content(spark):
    key = {"document_id": "d", "document_version": "1", "page": 1, "field_id": "f"}
    payload = json.dumps(key | {"field_type": "checkbox", "keywords": ["동의"], "note": "not hashed"}, ensure_ascii=False)
    approval = "struct<status:string,reviewed_by:string,reviewed_at:string,content_sha256:string>"
    ddl = f"document_id string, document_version string, page int, field_id string, field_type string, surrounding_text string, keywords array<string>, forbidden_keywords array<string>, instruction string, reading_mode string, source_text string, source struct<reference:string,sha256:string>, payload string, approval {approval}"
    df = spark.createDataFrame([("d", "1", 1, "f", "checkbox", "동의함", ["동의"], [], "check it", None, None, None, payload, ("draft", "", "", ""))], ddl)
    done = catalog.approve(df, key, "reviewer", "2026-01-01T00:00:00Z")
    assert catalog.checked_entries(done, "demo").first().problem is None
    changed = done.withColumn("payload", F.replace("payload", F.lit("checkbox"), F.lit("signature")))
    assert catalog.checked_entries(changed, "demo").first().problem == "changed_after_approval"
    assert catalog.checked_entries(done.withColumn("payload", F.replace("payload", F.lit("not hashed"), F.lit("new"))), "demo").first().problem is None
    assert catalog.draft(done, key, {"instruction": F.lit("new")}).first().approval.status == "draft"
    seen = spark.createDataFrame([(1, "d", "1", 1, "checkbox", "개인정보 동 의", 1.0, 1.0, 1.0, True, False), (2, "d", "2", 1, "checkbox", "동의", 1.0, 1.0, 1.0, True, False), (3, "d", "1", 1, "checkbox", "동의", 1.0, 1.0, 0.5, True, False)],
        "id int, document_id string, document_version string, page int, field_type string, surrounding_text string, document_confidence double, detection_confidence double, ocr_confidence double, identity_verified boolean, needs_review boolean")
    got = {r.id: (r.status, r.field_id) for r in catalog.match(seen, catalog.checked_entries(done, "production"), "production").collect()}
    assert got == {1: ("matched", "f"), 2: ("unsupported_document", None), 3: ("low_confidence", None)}


def test_form_structure(spark):
    words = [("성명", 20.0, 40.0), ("[필수]", 34.0, 40.0), ("작성일", 20.0, 55.0), ("*", 20.0, 80.0), ("개인정보", 24.0, 80.0), ("수집", 44.0, 80.0), ("동의", 56.0, 80.0), ("동의함", 30.0, 92.0), ("동의하지않음", 66.0, 92.0), ("신청인", 20.0, 120.0), ("서명", 34.0, 120.0)]
    boxes = [("text_input", 60.0, 39.0, 60.0, 7.0), ("text_input", 60.0, 54.0, 60.0, 7.0), ("checkbox", 22.0, 92.0, 4.0, 4.0), ("checkbox", 58.0, 92.0, 4.0, 4.0), ("signature", 60.0, 118.0, 50.0, 9.0)]
    w = spark.createDataFrame([("d", i, s, x, y, 4.0 * len(s), 4.0, 1.0) for i, (s, x, y) in enumerate(words)], "doc_id string, ord int, text string, x double, y double, w double, h double, confidence double")
    d = spark.createDataFrame([("d", i, *b, 1.0) for i, b in enumerate(boxes)], "doc_id string, ord int, kind string, x double, y double, w double, h double, confidence double")
    fields = structure.build(d, w).orderBy("ord").collect()
    assert [(f.id, f.type, f.role) for f in fields] == [("text_01", "text_input", "applicant"), ("date_01", "date", "applicant"), ("consent_01", "choice", "applicant"), ("signature_01", "signature", "applicant")]
    assert [o.label for o in fields[2].options] == ["동의함", "동의하지않음"] and fields[2].sensitivity == "public"
    assert fields[0].title == "성명" and fields[0].required and fields[0].sensitivity == "private"
    assert structure.warnings(structure.build(d, w)).where("warning in ('no_title', 'option_without_label')").count() == 0


def packed(body, size, overlap):
    if len(body) <= size:
        return [body]
    out, now = [], ""
    for piece in filter(None, (x.strip() for x in re.split(r"(?<=\.)\s+", body))):
        longer = f"{now} {piece}" if now else piece
        if len(longer) <= size:
            now = longer
            continue
        if now:
            out.append(now)
        now = f"{now[-overlap:] if overlap else ''} {piece}".strip() if now else piece
        while len(now) > size:
            out.append(now[:size])
            now = now[size - overlap :]
    return out + ([now] if now else [])


@pytest.mark.parametrize("size,overlap", [(500, 50), (40, 7), (9, 3)])
def test_chunks(spark, size, overlap):
    texts = ["", "short one.", "One two three. " * 30, "x" * 1200, "Aa bb cc. " + "y" * 95 + ". Then the end of it. Done"]
    got = [r.c for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", t.chunks("x", size, overlap).alias("c")).orderBy("i").collect()]
    assert all(len(c) <= size for many in got for c in many)
    assert got == [packed(x, size, overlap) for x in texts]
    for bad in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            t.chunks("x", *bad)


def test_regions_are_merged_until_none_overlap(spark):
    df = spark.createDataFrame([("d", 100.0, 20.0, 5.0, 5.0), ("d", 100.0, 30.0, 5.0, 5.0), ("d", 100.0, 200.0, 5.0, 5.0), ("d", 300.0, 10.0, 5.0, 5.0)], "doc_id string, x double, y double, w double, h double")
    got = layout.reading_regions(df, 210, 297).collect()
    assert [(r.x, r.y, r.w, r.h) for r in got] == [(55, 5, 95, 38), (55, 185, 95, 28)]
