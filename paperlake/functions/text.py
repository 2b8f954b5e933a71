"""Text functions as Catalyst columns: tokens, sentences, digit runs, checksums, masks."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F

from .geometry import bound

#: Hangul runs, Latin runs and digit runs.
WORD = "[가-힣]+|[a-z]+|[0-9]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Particles, the longer ones first.
PARTICLES = (
    "으로써 으로서 이라도 에서는 에게서 이라고 에서 에게 한테 께서 으로 라도 이나 보다 처럼 같이 까지 부터 조차 마저 밖에 이며 이란 이든 만큼 라는 "
    "은 는 이 가 을 를 의 에 와 과 도 만 로 며 나 께"
).split()


def word_tokens(text: Column | str, particles=PARTICLES) -> Column:
    """Lower-case runs of Hangul, Latin letters and digits; a Hangul run loses one particle if two syllables stay.

    Text is taken as composed (NFC); ``composed`` makes it so.
    """
    text = F.lower(_col(text))
    if particles:
        ending = rf"(?<![가-힣])([가-힣]{{2,}}?)(?:{'|'.join(particles)})(?![가-힣])"
        text = F.when(text.rlike("[가-힣]"), F.regexp_replace(text, ending, "$1")).otherwise(text)
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def composed(text: Column | str, form: str = "NFC") -> Column:
    """Normalised text; only what is not ASCII goes through Python."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    text = _col(text)
    return F.when(text.rlike(r"^\p{ASCII}*\z"), text).otherwise(run(F.when(~text.rlike(r"^\p{ASCII}*\z"), text)))


def match_form(text: Column | str) -> Column:
    """Text for matching: NFKC, case folded, without white space; ASCII text stays in the engine."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else re.sub(r"\s+", "", unicodedata.normalize("NFKC", t).casefold()))

    text = _col(text)
    plain = text.rlike(r"^\p{ASCII}*\z")
    return F.when(plain, F.regexp_replace(F.lower(text), r"[\s\x1c-\x1f]+", "")).otherwise(run(F.when(~plain, text)))


def canonical_sha256(payload: Column | str, drop: tuple = (), ascii_only: bool = False, keep: tuple = ()) -> Column:
    """SHA-256 of JSON text in one spelling: sorted keys, no spaces; ``drop`` leaves out keys of the outer object and
    ``keep``, where given, names the only ones. Null where it is no finite JSON."""

    def number(name):
        raise ValueError(name)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                value = json.loads(t, parse_constant=number)
                if isinstance(value, dict):
                    value = {k: v for k, v in value.items() if k not in drop and (not keep or k in keep)}
                out.append(hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only, allow_nan=False).encode()).hexdigest())
            except (TypeError, ValueError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(_col(payload))


def char_ngrams(word: Column | str, size: int) -> Column:
    """Character n-grams; a shorter word is its only gram."""
    if size < 1:
        raise ValueError("size must be positive")
    word = _col(word)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - (size - 1), F.lit(1))), lambda i: F.substring(word, i, F.lit(size)))
    return F.when(F.length(word) == 0, F.array().cast("array<string>")).otherwise(grams)


def search_tokens(text: Column | str) -> Column:
    """Words and the 2- and 3-grams of Hangul runs, with repetitions."""
    hangul = F.filter(word_tokens(text, ()), lambda w: w.rlike("^[가-힣]") & (F.length(w) >= 2))
    long = F.filter(hangul, lambda w: F.length(w) >= 3)
    return F.concat(word_tokens(text), F.flatten(F.transform(hangul, lambda w: char_ngrams(w, 2))), F.flatten(F.transform(long, lambda w: char_ngrams(w, 3))))


def strip_particle(word: Column | str, particles=PARTICLES) -> Column:
    return F.regexp_replace(_col(word), rf"^([가-힣]{{2,}}?)(?:{'|'.join(particles)})\z", "$1")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def sentences(text: Column | str) -> Column:
    """Pieces that end at . ! ? before white space, or at a line's end; trimmed, without empty ones."""
    return F.filter(F.transform(F.split(_col(text), r"(?U)(?<=[.!?])\s+|\n+"), trimmed), lambda s: s != "")


def chunks(body: Column | str, size: int = 500, overlap: int = 50) -> Column:
    """Sentences packed into pieces of at most ``size`` characters; each piece but the first begins with the last
    ``overlap`` characters of the one before. A sentence longer than that is cut. A fold inside Catalyst."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap less than it")
    body = _col(body)
    step = size - overlap
    pieces = F.filter(F.transform(F.split(body, r"(?U)(?<=\.)\s+"), trimmed), lambda s: s != "")
    joined = lambda a, b: F.when(a == "", b).otherwise(F.concat_ws(" ", a, b))

    def add(acc, piece):
        longer = joined(acc["now"], piece)
        tail = F.substring(acc["now"], F.greatest(F.length(acc["now"]) - overlap + 1, F.lit(1)), F.lit(overlap))
        next_ = trimmed(joined(tail, piece))
        fits = F.length(longer) <= size
        kept = F.concat(acc["done"], F.when(acc["now"] == "", F.array().cast("array<string>")).otherwise(F.array(acc["now"])))
        return F.when(fits, F.struct(acc["done"].alias("done"), longer.alias("now"))).otherwise(bound(next_, lambda n: cut_up(kept, n)))

    def cut_up(done, text):
        cuts = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step).cast("int"))
        hard = F.transform(F.when(cuts > 0, F.sequence(F.lit(0), cuts - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(text, i * step + 1, F.lit(size)))
        return F.struct(F.concat(done, hard).alias("done"), F.substring(text, cuts * step + 1, F.length(text)).alias("now"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    packed = F.aggregate(pieces, start, add, lambda acc: F.filter(F.array_append(acc["done"], acc["now"]), lambda c: c != ""))
    return F.when(F.length(body) <= size, F.array(body)).otherwise(packed)


def digit_runs(text: Column | str, least: int = 7) -> Column:
    """Number of digit runs of ``least`` digits or more, joined across white space, dot and dash."""
    plain = F.regexp_replace(_col(text), r"(?U)(?<=\d)[\s.\-]+(?=\d)", "")
    return F.size(F.regexp_extract_all(plain, F.lit(rf"(?U)\d{{{least},}}"), F.lit(0)))


def fingerprint(text: Column | str) -> Column:
    """First 12 hexadecimal digits of the SHA-256."""
    return F.substring(F.sha2(_col(text), 256), 1, 12)


def luhn_ok(number: Column | str) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of ten."""
    digits = F.regexp_replace(_col(number), "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def business_number_ok(number: Column | str) -> Column:
    """Ten digits whose weighted sum (1 3 7 1 3 7 1 3 5, and the tens of the ninth's product) matches the last."""
    digits = F.regexp_replace(_col(number), "[^0-9]", "")
    at = lambda i: F.try_element_at(F.split(digits, ""), F.lit(i)).try_cast("int")
    weights = [1, 3, 7, 1, 3, 7, 1, 3, 5]
    total = sum((at(i + 1) * w for i, w in enumerate(weights)), F.lit(0)) + F.floor(at(9) * 5 / 10)
    return (F.length(digits) == 10) & (F.pmod(10 - total % 10, F.lit(10)) == at(10))


def resident_number_ok(number: Column | str) -> Column:
    """13 digits: a real date whose century the seventh digit gives."""
    digits = F.regexp_replace(_col(number), "[^0-9]", "")
    seventh = F.substring(digits, 7, 1)
    century = F.when(seventh.isin("1", "2", "5", "6"), "19").when(seventh.isin("3", "4", "7", "8"), "20")
    return (F.length(digits) == 13) & F.coalesce(F.try_to_date(F.concat(century, F.substring(digits, 1, 6)), "yyyyMMdd").isNotNull(), F.lit(False))


def compact(text: Column | str, drop: str = r"\s") -> Column:
    """Lower case without the characters of the class ``drop``."""
    return F.regexp_replace(F.lower(_col(text)), f"[{drop}]+", "")


def display_width(text: Column | str) -> Column:
    """Characters, with wide ones (Hangul, CJK, kana, full-width forms) as two."""
    text = _col(text)
    return F.length(text) + F.length(F.regexp_replace(text, "[^ᄀ-ᅟ⺀-꓏가-힣豈-﫿︰-﹯＀-｠￠-￦]", ""))


def object_particle(word: Column | str, with_final: str, without_final: str) -> Column:
    """One of two particles, by whether the last Hangul syllable ends in a consonant."""
    code = F.ascii(F.substring(_col(word), -1, 1))
    return F.when(code.between(44032, 55203) & (F.pmod(code - 44032, F.lit(28)) > 0), with_final).otherwise(without_final)


# Punctuation that three readers of a phrase leave out besides white space.
PUNCTUATION = {
    "intent": r"""\s.,!?~·"'()\[\]{}<>:;/\\-""",
    "guard": r"""\s.,!?~·…"'()\[\]{}""",
}
INSTITUTION = "[가-힣]{2,}(?:법률|법|시행령|시행규칙|위원회|공단|공사|은행|보험|청|부|처|원|국|과|센터|재단|협회)"
NO_INSTITUTIONS = (
    "지원 신청 확인 이용 사용 적용 제공 결정 판단 부분 전부 일부 본인 직원 기관 내용 경우 이유 방법 정보 동의 서류 서명 설명 권리 의무 기간 목적 항목 대상"
).split()
NUMBER = r"\d[\d,]*(?:\.\d+)?\s*(?:퍼센트|개월|만원|억원|천원|원|년|일|월|주|회|건|명|세|%)?"
PLAIN_WORDS = {
    "파기해야 합니다": "지워야 합니다", "파기합니다": "지웁니다", "보유 및 이용 기간": "가지고 있는 기간", "보유·이용기간": "가지고 있는 기간", "고유식별정보": "주민등록번호 같은 정보",
    "제3자에게 제공": "다른 기관에 넘기는 것", "제3자 제공": "다른 기관에 넘기는 것", "개인정보처리자": "개인정보를 다루는 기관", "정보주체": "본인", "제3자": "다른 기관",
}


def squashed(text: Column | str, reader: str) -> Column:
    """A phrase as one of its readers sees it: "intent" lower-cases too."""
    text = _col(text)
    return F.regexp_replace(F.lower(text) if reader == "intent" else text, f"[{PUNCTUATION[reader]}]+", "")


def unsupported(answer: Column | str, evidence: Column | str) -> Column:
    """Numbers (with their unit), institutions and Latin names of an answer that its evidence does not have: in that
    order, each once."""
    answer, evidence = _col(answer), _col(evidence)
    close = squashed(evidence, "guard")
    numbers = F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(NUMBER), F.lit(0)), lambda n: F.regexp_replace(n, r"[,\s]", "")))
    places = F.array_except(F.regexp_extract_all(answer, F.lit(INSTITUTION), F.lit(0)), F.array(*map(F.lit, NO_INSTITUTIONS)))
    names = F.regexp_extract_all(answer, F.lit(r"\b[A-Z][A-Za-z]{1,}\b"), F.lit(0))
    absent = lambda words, text: F.filter(words, lambda w: ~F.contains(text, w))
    return F.array_distinct(F.concat(absent(numbers, close), absent(F.array_except(places, numbers), evidence), absent(F.array_except(names, F.concat(numbers, places)), evidence)))


def unsupported_summary(tokens: Column) -> dict[str, Column]:
    """How many of the tokens hold a digit, and how many do not."""
    numbers = F.size(F.filter(tokens, lambda t: t.rlike("[0-9]")))
    return {"numbers": numbers, "others": F.size(tokens) - numbers}


def plain_language(text: Column | str, words: dict[str, str] = PLAIN_WORDS) -> Column:
    """Hard terms by plain ones, the longest first."""
    text = _col(text)
    for hard in sorted(words, key=len, reverse=True):
        text = F.replace(text, F.lit(hard), F.lit(words[hard]))
    return text
