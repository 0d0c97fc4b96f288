"""Recognisers, masks and normalisation on single texts."""

import random
import re

import pytest

from veilspark.functions import ner
from veilspark.functions.detect import detect, extract, resolve, without_contained
from veilspark.functions.masks import mask_value
from veilspark.functions.normalise import Shadow
from veilspark.plans.entities import RULES, TAGS, Span, business_number_ok, chosen, luhn_ok, minguo_date_ok, national_id_ok, rule

ALL = set(TAGS)


def kinds(text, **k):
    return [s.entity for s in detect(text, ALL, **k)]


def masked(text):
    out, at = "", 0
    for s in detect(text, ALL):
        out += text[at : s.start] + mask_value(s.entity, text[s.start : s.end])
        at = s.end
    return out + text[at:]


def _id(letter, digits, off=0):
    """An ID with its check digit, from the table of letters as pairs of digits; off makes it wrong."""
    pairs = dict(zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", (10, 11, 12, 13, 14, 15, 16, 17, 34, 18, 19, 20, 21, 22, 35, 23, 24, 25, 26, 27, 28, 29, 32, 30, 31, 33)))
    weighted = pairs[letter] // 10 + 9 * (pairs[letter] % 10) + sum(w * int(d) for w, d in zip(range(8, 0, -1), digits))
    return f"{letter}{digits}{(-weighted + off) % 10}"


def _business(first, ok):
    """The first number from `first` on that is valid or not, by the sum of the digits of weighted digits."""
    for n in range(first, first + 100):
        d = f"{n:08d}"
        total = sum(int(x) for w, c in zip("12121241", d) for x in str(int(w) * int(c)))
        if (total % 5 == 0 or (d[6] == "7" and (total + 1) % 5 == 0)) == ok:
            return d


_RNG = random.Random(13)
IDS = [_id(c, _RNG.choice("1289") + f"{_RNG.randrange(10**7):07d}") for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]


@pytest.mark.parametrize("v", IDS)
def test_national_id(v):
    assert national_id_ok(v) and kinds(v) == ["TW_NATIONAL_ID"]


@pytest.mark.parametrize("v", [_id(c, "2" + f"{_RNG.randrange(10**7):07d}", _RNG.randint(1, 9)) for c in "AFIOWZ"] + [IDS[0].lower(), "A3" + IDS[0][2:], "X" + IDS[1], IDS[2] + "1", IDS[3][:4] + "C" + IDS[3][5:]])
def test_no_national_id(v):
    assert "TW_NATIONAL_ID" not in kinds(v)


def test_checksums():
    for first in range(10_000_000, 99_000_000, 7_654_321):
        assert business_number_ok(_business(first, True)) and not business_number_ok(_business(first, False))
    assert luhn_ok("4111111111111111") and not luhn_ok("4111111111111112")
    assert minguo_date_ok("1090229")
    assert not any(map(minguo_date_ok, "1000229 1101301 1101132 1100431 991200".split()))


def test_resolution_against_trying_all():
    rng = random.Random(17)
    for _ in range(400):
        spans = [Span(rng.choice("AB"), a, a + rng.randint(1, 6), rng.choice([0.5, 0.7, 0.9]), "x", k) for k in range(rng.randint(0, 12)) for a in [rng.randint(0, 20)]]
        free, want = set(range(40)), []
        for s in sorted(spans, key=lambda s: (s.score, s.end - s.start, -s.start, -s.order), reverse=True):
            if free >= set(range(s.start, s.end)):
                free -= set(range(s.start, s.end))
                want.append(s)
        assert resolve(spans) == sorted(want, key=lambda s: s.start)
        inside = lambda a, b: a.entity == b.entity and b.start <= a.start and a.end <= b.end and a.score <= b.score
        left = without_contained(spans)
        assert left == [s for s in spans if not any(inside(s, o) and (not inside(o, s) or o.order < s.order) for o in spans if o is not s)]


def test_guards_and_more_rules():
    every = [r._replace(may=lambda t: True) for r in RULES]
    rng = random.Random(19)
    parts = ["0912345678", "０９１２-345-678", "02-2720 ", "(037)123456", "12345675", "a@b.tw", "生日", "1000101", "AB12345678", "4111-1111-1111-1111", "代號: 12", "0021234567890", "信義路4段1號", " ", "x", "帳號"]
    for _ in range(2000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 5)))
        assert extract(t, ALL) == [s._replace(order=s.order) for s in _unguarded(every, t)]
    ticket = rule("TICKET", "Ticket", r"T-\d{4}", lambda v, c: 0.9 if c else 0.3, context=("票號",))
    assert [(s.entity, s.start, s.end) for s in detect("票號T-1234", ALL | {"TICKET"}, extra=[ticket])] == [("TICKET", 2, 8)]
    assert detect("T-1234", ALL | {"TICKET"}, extra=[ticket]) == [] and chosen(["TICKET"], (ticket,)) == ["TICKET"]


def _unguarded(rules, text):
    from veilspark.functions import detect as module

    kept, module.RULES = module.RULES, tuple(rules)
    try:
        return extract(text, ALL)
    finally:
        module.RULES = kept


@pytest.mark.parametrize("text,kind", [(p, "TW_MOBILE") for p in ("0912345678", "0912-345-678", "0912-345678")] + [(p, "TW_PHONE") for p in ("02-27208889", "(02)2720-8889", "04-2228-9111", "03-5776085", "037-123456")] + [("手機0912345678", "TW_MOBILE"), ("保單號碼0912345678", "TW_POLICY_NO"), ("帳號0123456789012", "TW_BANK_ACCOUNT"), ("4111-1111-1111-1111", "CREDIT_CARD"), ("統編1234\n5675開發票", "TW_UBN"), ("總機(02)2720 8889", "TW_PHONE"), ("身分證A１２３４５６７８９", "TW_NATIONAL_ID"), ("手機０９１２３４５６７８", "TW_MOBILE"), ("生日１０００１０１", "BIRTHDAY"), ("台北市大安區信義路四段1號5樓", "LOC"), ("test@exam\nple.com", "EMAIL_ADDRESS")])
def test_found(text, kind):
    assert kinds(text) == [kind]


@pytest.mark.parametrize("text", ["091234567", "09123456789", "A0912345678", "2023-12345678", "訂單1234-5678", "3.1415926", "編號1000101已出貨", "統計值1234567890筆", "代號1號機", "代號1234行員", "合計 12345675 元", "012345678901234", "0912345678A", "0912-345-678X", "統編12345675Q", "檔案2023-0912-345-678號", "0912\n\n345678", "0912  345678", "0912\t345678", "編號A12345\n6780核對", "編號02-2720\n8889資料", "數量２０二十件", "道路施工3號出口請改道", "台北市大安區歡迎您", "end of line.\nNext line 123", ""])
def test_left_alone(text):
    assert masked(text) == text


@pytest.mark.parametrize("text,want", [("客戶生日1000101", "客戶生日100****"), ("客戶生日990101", "客戶生日99****"), ("這筆AB12345678資料", "這筆AB******78資料"), ("卡號4111111111111111", "卡號" + "*" * 12 + "1111"), ("4111 1111 1111 1111", "**** **** **** 1111"), ("代號111", "代號***"), ("代號:23", "代號:**"), ("郵局帳號00212345678901", "郵局帳號" + "*" * 10 + "8901"), ("賣方統一編號:10458574", "賣方統一編號:10****74"), ("A12345\n6789", "A1****\n**89"), ("A12345 6789", "A1**** **89"), ("qwe@\ngmail\n.com", "q***@\ngmail\n.com"), ("電話02-2720\n8889分機3", "電話02-****\n**89分機3"), ("電話02 2720 8889", "電話02 **** **89")])
def test_masks(text, want):
    assert masked(text) == want


def test_shadow():
    s = Shadow("A12345\n6789")
    assert s.text == "A123456789" and s.back(6, 7) == (7, 8)
    assert Shadow("手機 0912345678 已登記").text == "手機 0912345678 已登記"
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice("a1-@ 　\r\n\t字.") for _ in range(rng.randint(0, 14)))
        keep = [True] * len(t)
        for m in re.finditer("[ 　\r\n]+", t):
            run, a, b = m.group(), m.start(), m.end()
            lines = len(re.findall("\r\n|\n|\r", run))
            before = a > 0 and (t[a - 1] in "a1@." or a > 1 and t[a - 1] == "-" and t[a - 2] in "a1")
            if before and b < len(t) and t[b] in "a1@." and (lines == 1 and len(run) <= 3 or lines == 0 and len(run) == 1):
                keep[a:b] = [False] * (b - a)
        s = Shadow(t)
        assert s.text == "".join(c for c, k in zip(t, keep) if k)
        places = [i for i, k in enumerate(keep) if k]
        assert [s.back(i, i + 1) for i in range(len(places))] == [(p, p + 1) for p in places]


def test_allow_list():
    assert kinds("A123456789", allow=["A123456789x"]) == ["TW_NATIONAL_ID"]
    assert kinds("ref A123456789.", allow=["f A123456789"]) == []


def test_selection():
    assert chosen(["EMAIL_ADDRESS", "BOGUS"]) == ["EMAIL_ADDRESS"]
    for bad in ([], ["BOGUS"]):
        with pytest.raises(ValueError):
            chosen(bad)


def test_ner():
    text = "甲" * 30 + "。" + "乙" * 30
    assert [c for _, c in ner.chunks(text, 40)][0][-1] == "。"
    assert [len(c) for _, c in ner.chunks("字" * 100, 40)] == [40, 40, 20] and list(ner.chunks("")) == []
    long = "x" * 398 + "王小明" + "y"
    assert [(s.start, s.end) for s in ner.rule_ner(long, ALL)] == [(398, 401)]
    assert ner.realign("○王小明", "王小明", 0) == (1, 4)
    sizes = []
    find = lambda parts: sizes.append(len(parts)) or [[("PERSON", "王小明", p.index("王小明") - 1)] if "王小明" in p else [] for p in parts]
    body = ("字" * 399 + "。") * 9 + "王小明" + "字" * 50
    assert [(s.start, s.end) for s in ner.by_chunks(find, "x")(body, ALL)] == [(3600, 3603)] and sizes == [8, 2]
    with pytest.raises(ValueError):
        ner.by_chunks(lambda parts: [[("PERSON", "不在", 0)] for _ in parts], "x")("字", ALL)
    with pytest.raises(ner.NerTimeout):
        ner.by_chunks(lambda parts: [[] for _ in parts], "x", -1)("字", ALL)
    with pytest.raises(ValueError):
        ner.realign("王小明x王小明", "王小明", 3)


def test_a_batch_of_texts_is_looked_through_in_one_go(monkeypatch):
    from veilspark.functions import detect as kernel

    parts = ["0912345678", "09123\n45678", "０９１２３４５６７８", "0912-345-678", "02-2720 1234", "02-2720\n0001", "電話", "保單", "帳號", "生日", "統編", "A123456789", "K182504372", "K18250\n4372", "12345675", "0800101", "1234567890123", "4111111111111111", "a.b@c.tw", "代號:123", "台北市信義路四段5號", "\0", " ", "　", "\r\n", "-", "x", "號", "。"]
    rng = random.Random(7)
    texts = [None, "", "x" * 600 + "手機0912345678"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    for allow, join_broken, wanted in (([], True, ALL), (["0912345678", "號"], True, ALL), ([], False, ALL), ([], True, {"TW_MOBILE", "TW_UBN"})):
        assert kernel.detect_all(texts, wanted, allow, join_broken) == [detect(t, wanted, allow, join_broken) if t is not None else [] for t in texts]
    looks = []
    monkeypatch.setattr(kernel, "look", lambda t, look=kernel.look: (looks.append(1), look(t))[1])
    kernel.detect_all([f"手機09{k:08d}" for k in range(1000)], ALL)
    assert len(looks) < 5


def test_findings_apart_are_not_resolved_text_by_text(monkeypatch):
    from veilspark.functions import detect as kernel

    texts = ["手機" + (f"0912\n{k:06d}" if k % 2 else f"0912{k:06d}") + f"與02-2720{k % 9:04d}" for k in range(1000)]
    want = [detect(t, ALL) for t in texts]
    calls = []
    for name in ("resolve", "without_contained", "Shadow"):
        monkeypatch.setattr(kernel, name, lambda *a, f=getattr(kernel, name): (calls.append(1), f(*a))[1])
    assert kernel.detect_all(texts, ALL) == want and {len(w) for w in want} == {2} and len(calls) < 5
